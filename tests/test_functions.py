"""Scalars: IRI templates (MAP1), tokens (IDX2), text helpers, HTML helpers (EXT1-EXT4, PRS4)."""

from pyspark.sql import functions as F

from trellis.functions import html as H
from trellis.functions.iri import iri_encode, iri_template, local_name
from trellis.functions.text import first_sentence, tokens


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_iri_encode_cases(spark):
    assert _one(spark, iri_encode(F.col("x")), "MIDDLE EAST") == "MIDDLE%20EAST"
    assert _one(spark, iri_encode(F.col("x")), "Customer#000000001") == "Customer%23000000001"
    assert _one(spark, iri_encode(F.col("x")), "Müller-Lüdenscheidt") == "Müller-Lüdenscheidt"
    assert _one(spark, iri_encode(F.col("x")), "a*b/c") == "a%2Ab%2Fc"
    assert _one(spark, iri_encode(F.col("x")), "plain_id.1~x") == "plain_id.1~x"


def test_iri_template_null_and_empty(spark):
    assert _one(spark, iri_template(F.col("x")), None) is None
    assert _one(spark, iri_template(F.col("x")), "") is None
    assert _one(spark, iri_template(F.col("x")), "p1").endswith("#p1")


def test_local_name(spark):
    assert _one(spark, local_name(F.col("x")), "http://e.org/o#Page") == "Page"
    assert _one(spark, local_name(F.col("x")), "http://e.org/o/Page") == ""


def test_tokens(spark):
    got = _one(spark, tokens(F.col("x")), "NATION_3 in AMERICA, don't 3.5 Größe! e.g.")
    assert got == ["nation_3", "in", "america", "don't", "3.5", "größe", "e.g"]


def test_first_sentence_and_words(spark):
    assert _one(spark, first_sentence(F.col("x")), "  Hello there. Next one") == "Hello there"
    assert _one(spark, first_sentence(F.col("x")), ". starts with a dot") is None


# ---- HTML helpers (pure per-row functions used inside Arrow tasks) -------------

def _table(html):
    rows = {}
    for t, r, c, h, v in H.tables(html):
        rows.setdefault((t, r), {})[h] = v
    return rows


def test_table_with_headers():
    assert _table("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr></table>") == {(0, 1): {"A": "1", "B": ""}}


def test_table_without_headers_loses_first_row():
    assert _table("<table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>") == {
        (0, 1): {"Row_0": "1", "Row_1": "2"}}


def test_blank_and_duplicate_headers():
    assert _table("<table><tr><th></th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>") == {
        (0, 1): {"Row_0": "1", "B": "2"}}
    assert _table("<table><tr><th>A</th><th>A</th></tr><tr><td>1</td><td>2</td></tr></table>") == {(0, 1): {"A": "1"}}


def test_short_row_gives_empty():
    assert _table("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>") == {(0, 1): {"A": "1", "B": ""}}


def test_nested_table_rows_also_in_outer():
    html = ("<table><tr><th>A</th></tr><tr><td><table><tr><th>X</th></tr><tr><td>in</td></tr></table></td></tr>"
            "</table>")
    got = _table(html)
    assert got[(1, 1)] == {"X": "in"}
    assert (0, 1) in got and (0, 2) in got  # the inner rows are rows of the outer table too


def test_no_rows_no_table():
    assert _table("<table></table>") == {}
    assert _table("<p>x</p>") == {}


def test_visible_text_rules():
    html = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
            "<body><p>Hello <b>wor</b>ld<p>Next &amp; more</p><!-- c --><ul><li>a<li>b</ul></body></html>")
    assert H.visible_text(html) == "T Hello world Next & more a b"


def test_text_blocks():
    html = "<body><div><p>one</p><p>  </p><h2>two x</h2><div><p>three <p>four</div></div></body>"
    assert H.text_blocks(html) == ["one", "two x", "three", "four"]


def test_iri_encode_paths_agree(spark):
    vals = ["a b#c%d", "x\ty", "Ünïcode «q» !$&'()*+,/:;=?@[]", "100%", "tab\tand space", "ctl\x01z"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r["r"] for r in df.select(iri_encode(F.col("x")).alias("r")).collect()]

    def ref(v):  # keep unreserved ASCII and everything from U+00A0; escape the rest by UTF-8 byte
        keep = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
        return "".join(ch if ch in keep or ord(ch) >= 0xA0 else "".join(f"%{b:02X}" for b in ch.encode()) for ch in v)

    assert got == [ref(v) for v in vals]
