"""Sinks (SNK1-SNK4): dated snapshots, JSON export, named-graph replacement,
extraction results. Every replacement is a dynamic partition overwrite: one write,
other partitions untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _dynamic(writer):
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def write_snapshot(df: DataFrame, path: str, label: str, date: str) -> None:
    """SNK1: replace earlier content of the same date and label only."""
    out = df.withColumn("label", F.lit(label)).withColumn("snapshot_date", F.lit(date).cast("date"))
    _dynamic(out.write).partitionBy("label", "snapshot_date").parquet(path)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """SNK2: every collection as JSON lines under ``path/<label>``."""
    for label, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{label}")


def write_quads(quads: DataFrame, path: str) -> None:
    _dynamic(quads.write).partitionBy("g").parquet(path)


def replace_graph(spark: SparkSession, path: str, triples: DataFrame, g: str) -> None:
    """SNK3: replace one named graph, leave the others. Checks there is something to
    write first (an empty input leaves the stored graph as it was)."""
    if triples.isEmpty():
        raise ValueError(f"nothing to import into graph {g!r}")
    q = triples.select(F.lit(g).alias("g"), "s", "p", "o", "o_kind", "o_lang", *[c for c in ("o_dtype",) if c in triples.columns])
    _dynamic(q.write).partitionBy("g").parquet(path)


def _by_row_no(a, b):
    return F.when(a["row_no"] < b["row_no"], -1).when(a["row_no"] > b["row_no"], 1).otherwise(0)


def write_extraction(cells: DataFrame, path: str, bindings: DataFrame | None = None) -> None:
    """SNK4: one JSON line per (query, result): ``{"query": q, "Result_n": {<variables>,
    "Table_i": [row maps]}}``. ``bindings(query, result_no, bindings MAP<STRING,STRING>)``
    (EXT6) carries the result's other variables; results without tables keep them too.
    Each line holds one result."""
    rows = cells.groupBy("query", "result_no", "table_no", "row_no").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "value")))).alias("row"))
    tables = rows.groupBy("query", "result_no", "table_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row")), _by_row_no), lambda x: x["row"]).alias("rows"))
    results = tables.groupBy("query", "result_no").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Table_"), F.col("table_no").cast("string")), "rows"))).alias("tables"))
    inner_tables = F.expr("substring(to_json(tables), 2, length(to_json(tables)) - 2)")
    if bindings is not None:
        results = bindings.select("query", "result_no", "bindings").join(results, ["query", "result_no"], "full")
        inner_vars = F.expr("substring(to_json(bindings), 2, length(to_json(bindings)) - 2)")
        body = F.concat_ws(",", F.when(F.size("bindings") > 0, inner_vars),
                           F.when(F.col("tables").isNotNull(), inner_tables))
    else:
        body = inner_tables
    obj = F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}"))
    key = F.concat(F.lit("Result_"), F.col("result_no").cast("string"))
    line = F.concat(F.expr("substring(to_json(named_struct('query', query)), 1, length(to_json(named_struct('query', query))) - 1)"),
                    F.lit(',"'), key, F.lit('":'), obj, F.lit("}"))
    results.select(line.alias("value")).write.mode("overwrite").text(path)


def _nt_escape(c):
    for ch, rep in (("\\", r"\\"), ('"', r'\"'), ("\n", r"\n"), ("\r", r"\r")):
        c = F.replace(c, F.lit(ch), F.lit(rep))
    return c


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as N-Triples lines (the mapper's file output, read back by SRC5), literals with their language or else their
    datatype (``o_dtype``, where there is such a column). Lines repeat their IRIs, so files are compressed (``.gz``)."""
    typed = F.concat(F.lit("^^<"), F.col("o_dtype"), F.lit(">")) if "o_dtype" in triples.columns else F.lit(None).cast("string")
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(
        F.concat(F.lit('"'), _nt_escape(F.col("o")), F.lit('"'),
                 F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).otherwise(F.coalesce(typed, F.lit("")))))
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), obj, F.lit(" ."))
    triples.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


_RDF_HEADER = ('<?xml version="1.0"?>\n<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#" '
               'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
               'xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">\n')


def _xml_escape(c):
    for ch, rep in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(ch), F.lit(rep))
    return c


def write_ontology_xml(frames: dict[str, DataFrame], path: str) -> None:
    """The ontology as one RDF/XML document (``owl:Class`` elements with
    ``rdfs:subClassOf`` and language-tagged ``rdfs:label``), readable by SRC4.
    Ontology-sized: one document per ontology."""
    edges = frames["class_edges"].select(F.col("sub").alias("iri"), F.concat(
        F.lit('<rdfs:subClassOf rdf:resource="'), _xml_escape(F.col("sup")), F.lit('"/>')).alias("x"))
    labels = frames["labels"].select("iri", F.concat(
        F.lit('<rdfs:label xml:lang="'), _xml_escape(F.col("lang")), F.lit('">'), _xml_escape(F.col("text")),
        F.lit("</rdfs:label>")).alias("x"))
    sups = frames["class_edges"].select(F.col("sup").alias("iri"), F.lit("").alias("x"))
    parts = edges.unionByName(labels).unionByName(sups)
    classes = parts.groupBy("iri").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("body")).select(
        F.concat(F.lit('<owl:Class rdf:about="'), _xml_escape(F.col("iri")), F.lit('">'), F.col("body"),
                 F.lit("</owl:Class>\n")).alias("c"))
    doc = classes.agg(F.concat(F.lit(_RDF_HEADER), F.array_join(F.array_sort(F.collect_list("c")), ""),
                               F.lit("</rdf:RDF>\n")).alias("value"))
    doc.write.mode("overwrite").text(path)
