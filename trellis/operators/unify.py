"""Field unification (UNI2-UNI6): project raw VARIANT documents to the unified names.

``rules`` maps a unified name to candidate dotted paths. Only paths present in the
sample are used (UNI2): by default the first document in a stated order (the source
system's behaviour, C6), or ``sample="all"`` (present anywhere, one ``bool_or``
aggregate). The sample is one row (or one aggregate row) on the driver, never data.

Each unified field comes out as ``ARRAY<STRING>`` (UNI4): one path -> its value
(array -> elements, JSON null -> empty); several paths -> the first value, then
objects and array elements of later paths appended, later primitives dropped (C8).
``scalars`` exposes element 1 per field.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.jsonpath import is_array, is_object, variant_strings, with_paths
from trellis.session import cut_lineage, stored

LINK_MARK = "_links.webui"


def link_base(endpoint: str | None) -> str:
    """UNI5/C9: ``scheme://host/wiki`` of the endpoint (port and path dropped)."""
    if not endpoint:
        return ""
    u = urlparse(endpoint)
    return f"{u.scheme}://{u.hostname}/wiki"


def _path_cols(rules: dict[str, list[str]]) -> dict[str, str]:
    out = {}
    for i, (name, paths) in enumerate(rules.items()):
        for j, path in enumerate(paths):
            out[f"_u{i}_{j}"] = path
    return out


def detect_paths(df: DataFrame, rules: dict[str, list[str]], doc: str = "doc", overrides: str | None = None,
                 order_by: list[str] | None = None, sample: str = "first") -> dict[str, list[str]] | None:
    """UNI2: the rule paths present in the sample; ``None`` for an empty collection."""
    cols = _path_cols(rules)
    probe = with_paths(df, doc, cols, overrides)
    flags = [F.col(c).isNotNull() for c in cols]
    if sample == "all":
        row = probe.agg(*[F.max(f.cast("int")).alias(c) for f, c in zip(flags, cols)], F.count(F.lit(1)).alias("_n")).first()
        if row is None or row["_n"] == 0:
            return None
    else:
        ordered = probe.orderBy(*order_by) if order_by else probe
        row = ordered.select(*[f.alias(c) for f, c in zip(flags, cols)]).first()
        if row is None:
            return None
    present = {}
    for i, (name, paths) in enumerate(rules.items()):
        keep = [p for j, p in enumerate(paths) if row[f"_u{i}_{j}"]]
        if keep:
            present[name] = keep
    return present


def unify(df: DataFrame, rules: dict[str, list[str]], present: dict[str, list[str]], keep: list[str] = (),
          doc: str = "doc", overrides: str | None = None, base_url: str = "") -> DataFrame:
    """UNI3-UNI5: one select of generated columns; every rule name becomes a column."""
    paths = {}
    for i, (name, plist) in enumerate(present.items()):
        for j, path in enumerate(plist):
            paths[f"_v{i}_{j}"] = path
    cur = with_paths(df, doc, paths, overrides)
    out = [F.col(k) for k in keep]
    slot = {name: i for i, name in enumerate(present)}
    for name in rules:
        plist = present.get(name)
        if not plist:
            out.append(F.array().cast("array<string>").alias(name))
            continue
        vals = []
        for j, path in enumerate(plist):
            v = F.col(f"_v{slot[name]}_{j}")
            if LINK_MARK in path and base_url:
                s = F.try_variant_get(v, "$", "string")
                prim = v.isNotNull() & ~F.is_variant_null(v) & ~is_object(v) & ~is_array(v)
                v = F.when(prim, F.concat(F.lit(base_url), s).cast("variant")).otherwise(v)
            vals.append(v)
        parts = [variant_strings(vals[0])]
        for v in vals[1:]:
            parts.append(F.when(is_object(v) | is_array(v), variant_strings(v)).otherwise(F.array().cast("array<string>")))
        out.append((parts[0] if len(parts) == 1 else F.concat(*parts)).alias(name))
    return cur.select(*out)


def scalars(df: DataFrame, names=V.UNIFIED_FIELDS) -> DataFrame:
    """First element of every unified field (the single-valued view)."""
    return df.select(*[F.try_element_at(F.col(c), F.lit(1)).alias(c) if c in names else F.col(c) for c in df.columns])


def unify_all(frames: dict[str, DataFrame], rules: dict[str, list[str]] = None, doc: str = "doc",
              overrides: str | None = "ext", order_by: list[str] | None = None, sample: str = "first",
              base_url: str = "", keep: list[str] = ()) -> tuple[dict[str, DataFrame], list[tuple[str, bool]]]:
    """UNI6: every collection; the step fails only when every collection fails (an
    empty collection fails; no collection at all fails).

    The documents of all collections are written once. Detection reads them (one job: with ``sample="first"`` it evaluates
    the rule paths of one document a collection), then each collection is unified by the paths found alone."""
    rules = rules or V.FIELD_RULES
    if not frames:
        raise RuntimeError("unification failed for every collection")
    cols = _path_cols(rules)
    order_by = list(order_by or [])
    carry = list(dict.fromkeys(list(keep) + order_by))
    union = None
    for label, df in frames.items():
        d = df.select(F.lit(label).alias("_label"), doc, *([overrides] if overrides else []), *carry)
        union = d if union is None else union.unionByName(d)
    union = stored(union, "_label")
    of_label = {label: union.where(F.col("_label") == label) for label in frames}
    if sample == "all":
        seen = with_paths(union, doc, cols, overrides).groupBy("_label").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in cols])
    else:
        first = None
        for df in of_label.values():
            d = (df.orderBy(*order_by) if order_by else df).limit(1).select("_label", doc, *([overrides] if overrides else []))
            first = d if first is None else first.unionByName(d)
        # one row a collection, written: else the paths would be evaluated below the limits, for all rows
        seen = with_paths(cut_lineage(first), doc, cols, overrides).select("_label", *[F.col(c).isNotNull().alias(c) for c in cols])
    rows = {r["_label"]: r for r in seen.collect()}
    out, status = {}, []
    for label, df in of_label.items():
        row = rows.get(label)
        if row is None:
            status.append((label, False))
            continue
        present = {}
        for i, (name, paths) in enumerate(rules.items()):
            kept = [p for j, p in enumerate(paths) if row[f"_u{i}_{j}"]]
            if kept:
                present[name] = kept
        out[label] = unify(df, rules, present, list(keep), doc, overrides, base_url)
        status.append((label, True))
    if not any(ok for _, ok in status):
        raise RuntimeError("unification failed for every collection")
    return out, status
