"""EXT1-EXT6 as Spark passes."""


from trellis.operators import extract


def test_tables_rows_numbering_and_bindings(spark):
    df = spark.createDataFrame([
        ("q", "n2", "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr><tr><td>2</td><td>x</td></tr></table>"),
        ("q", "n1", "<p>no table</p>"),
        ("q", "n3", None),
    ], "query string, s string, content string")
    numbered = extract.number_results(df, "query", ["s"])
    assert {r["s"]: r["result_no"] for r in numbered.collect()} == {"n1": 1, "n2": 2, "n3": 3}
    cells = extract.html_tables(numbered, "content", ["query", "result_no"])
    rows = {r["row_no"]: dict(r["row"]) for r in extract.table_rows(cells, ["query", "result_no"]).collect()}
    assert rows == {1: {"A": "1", "B": ""}, 2: {"A": "2", "B": "x"}}
    b = extract.bindings_map(numbered, ["s", "content"]).where("s = 'n3'").first()["bindings"]
    assert dict(b) == {"s": "n3"}                      # unbound variables omitted (EXT6)


def test_html_text_and_blocks_columns(spark):
    df = spark.createDataFrame([(1, "<h1>T</h1><p>a&amp;b</p><script>x</script>"), (2, None)], "k int, h string")
    t = {r["k"]: r["text"] for r in extract.html_text(df, "h").collect()}
    assert t == {1: "T a&b", 2: None}
    bl = {r["k"]: r["blocks"] for r in extract.html_blocks(df, "h").collect()}
    assert bl[1] == ["T", "a&b"]


def test_html_page_text_against_serial_brute_force(spark, sf):
    """No SQL twin parses HTML: check the distributed query against a serial pass
    over the same fixture, with the snippet rule written out in plain Python."""
    import pandas as pd

    import __spark_entry__ as E
    from trellis.functions.html import visible_text

    got = {r["page_id"]: (r["n_chars"], r["snippet"]) for r in E.queries()["html_page_text"](spark, sf).collect()}
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    want = {}
    for pid, html in zip(pages["page_id"], pages["html"]):
        text = visible_text(html) if isinstance(html, str) else None
        snip = None if text is None else (text if len(text) < 300 else text[:300] + "...")
        want[int(pid)] = (None if text is None else len(text), snip)
    assert got == want


def test_result_numbers_keep_null_and_equal_rows(spark):
    """Every row gets one number: nulls in the query or order column and equal rows too."""
    rows = [("q", 2, "a"), ("q", 2, "a"), ("q", 2, "b"), ("q", None, "n"), ("q", 1, "c"), (None, 7, "x"), (None, None, "y"), (None, 7, "x")]
    out = extract.number_results(spark.createDataFrame(rows, "q string, k int, content string"), "q", ["k"])
    assert out.columns == ["q", "k", "content", "result_no"]
    got = out.collect()
    assert sorted(map(str, ((r.q, r.k, r.content) for r in got))) == sorted(map(str, rows))
    for q in ("q", None):
        mine = sorted((r.result_no, -1 if r.k is None else r.k) for r in got if r.q == q)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [k for _, k in mine] == sorted(k for _, k in mine)


def test_parsing_is_dealt_over_tasks_and_trees_are_freed_at_once(spark):
    """A small file with many rows is one read task, but many parse tasks; a parsed page leaves no circles for the collector."""
    import gc

    from trellis.functions import html as H

    page = "<h1>T</h1><table><tr><th>A</th></tr><tr><td>1</td></tr></table>"
    df = spark.range(400).selectExpr("id", f"'{page}' AS h").coalesce(1)
    tasks = lambda out: out.selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks(extract.html_tables(df, "h", ["id"])) == tasks(extract.html_text(df, "h")) == 4
    assert extract.html_tables(df, "h", ["id"]).distinct().count() == 400
    gc.collect()
    gc.disable()
    try:
        for _ in range(50):
            assert H.visible_text(page) == "T A 1"
        assert gc.collect() < 50
    finally:
        gc.enable()


def test_pages_are_parsed_in_parts_of_bounded_size():
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([None, *["x" * (1 << 20)] * 39])], names=["k", "h"])
    parts = list(extract._slices(iter([whole]), "h"))
    assert max(b.column(1).nbytes for b, _ in parts) <= 2 * extract.TOGETHER
    assert [v for _, texts in parts for v in texts] == whole.column(1).to_pylist()
