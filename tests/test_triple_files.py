"""N-Triples files are compressed; their lines repeat their IRIs."""

import glob
import gzip

from trellis import vocab as V
from trellis.sources import sinks, triples

T = "s string, p string, o string, o_kind string, o_lang string"


def test_triple_files_are_compressed(spark, tmp_path):
    df = spark.createDataFrame([(f"{V.NS}s{i}", V.TITLE, f"t {i}", "literal", None) for i in range(500)], T)
    sinks.write_ntriples(df, f"file:{tmp_path}/nt")
    files = [f for f in glob.glob(f"{tmp_path}/nt/part-*")]
    assert files and all(f.endswith(".gz") for f in files)
    assert sum(len(gzip.open(f).read().splitlines()) for f in files) == 500
    assert triples.read_ntriples(spark, f"file:{tmp_path}/nt").select("s", "o").distinct().count() == 500
