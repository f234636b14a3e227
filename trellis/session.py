"""Session construction and the few session-level helpers every job shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast only below this many bytes of estimated payload (checked, never assumed).
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, partitions: int = 8, app: str = "trellis") -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRELLIS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # reliable checkpoints of dropped DataFrames are removed by the context cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder for lineage cuts.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read from
    the session. Only a local-mode session with no setting (tests, bench) gets a
    fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    local = tempfile.mkdtemp(prefix="trellis-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *folders: str) -> DataFrame:
    """``df`` written once as Parquet below the checkpoint folder and read back. For data-sized tables: a checkpoint keeps
    plain rows, Parquet codes repeated values and compresses. How the rows were partitioned is lost. ``folders``: columns
    whose values get folders of their own; a filter on them reads no others."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    (df.write.partitionBy(*folders) if folders else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


#: Bytes of input files behind a bucket of tables that lie by their subject; of small inputs, less.
BUCKET_BYTES, SMALL_BUCKET_BYTES = 4 * 1024 * 1024, 256 * 1024


def bucket_count(frames: list[DataFrame]) -> int:
    """Buckets for tables made of ``frames``: by the size of their input files, so a bucket stays bounded; few for small inputs,
    else at least as many as the session shuffles into."""
    spark = frames[0].sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    fs, size = None, 0
    for f in {f for df in frames for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        fs = fs or path.getFileSystem(spark._jsc.hadoopConfiguration())
        size += fs.getFileStatus(path).getLen()
    return max(min(parts, size // SMALL_BUCKET_BYTES + 1), size // BUCKET_BYTES + 1) if size else parts


def bucketed(df: DataFrame, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """``df`` written once as a table in ``buckets`` by ``key`` below the checkpoint folder and read back: what is grouped or joined
    by ``key`` with tables of as many buckets needs no shuffle. ``dealt``: its rows lie so already."""
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}"
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name).select(*df.columns)


def laid(df: DataFrame, buckets: int | None, dealt: bool = True) -> DataFrame:
    """``df`` stored, in buckets by its subject ``s`` if a number of them is given."""
    return bucketed(df, "s", buckets, dealt) if buckets else stored(df)


def joined_in_place(left: DataFrame, right: DataFrame, also: str, how: str = "inner", key: str = "s") -> DataFrame:
    """``left`` and ``right``, joined on ``key`` and ``also``, where both lie by ``key``: a plain second equality would deal both again
    by the two columns, so it is looked at inside the join by ``key``."""
    r = right.withColumnsRenamed({key: f"_{key}", also: f"_{also}"})
    cond = (F.col(key) == F.col(f"_{key}")) & F.array_contains(F.array(f"_{also}"), F.col(also))
    return left.join(r.hint("shuffle_hash"), cond, how).drop(f"_{key}", f"_{also}")


def with_once(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a last column ``name``, whose value is taken once per row. Of a plain column the optimizer copies the
    expression into every filter on it and beside every other reader; of a generator it does not."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def estimated_bytes(df: DataFrame, row_bytes_expr=None) -> int:
    """Measured payload of a (small) side: sum of string bytes plus a fixed row overhead.

    This is an action over the candidate side only; the result decides whether the
    side may be broadcast.
    """
    if row_bytes_expr is None:
        parts = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields]
        row_bytes_expr = sum(parts[1:], parts[0]) if parts else F.lit(0)
    row = df.agg(F.coalesce(F.sum(row_bytes_expr + F.lit(16)), F.lit(0)).alias("b")).first()
    return int(row["b"])


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the measured size is under the bound; else leave the shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what ``--py-files`` does),
    once per application. Needed by the Arrow-batched Python passes."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="trellis-pyfiles-"), "trellis.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
