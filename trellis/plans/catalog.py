"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``, and their DuckDB twins.

Every query reads the driver tables whole (or data Spark derives from them); limits
appear only where paging is the feature.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.iri import local_name
from trellis.operators import enrich, extract, graph, inference, mapping, search
from trellis.operators.closure import transitive_closure
from trellis.plans import build as B
from trellis.plans import fixtures
from trellis.plans import oracle as O
from trellis.session import joined_in_place, stored


def _round(col: str, n: int = 6):
    return F.round(F.col(col), n).alias(col)


# ---------------------------------------------------------------- search (flagship)

def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.build_cached(spark, sf_dir)
    res = search.search_build(b, fixtures.searches_frame(spark, sf_dir))
    return res.select(*[c for c in search.RESULT_COLUMNS if c != "totalScore"], _round("totalScore"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.build_cached(spark, sf_dir)
    res = search.search_build(b, fixtures.searches_frame(spark, sf_dir), texts=False)
    res = res.withColumn("totalScore", F.round("totalScore", 6))
    return search.page(res, n=2, pages_through=True, contents=b.contents).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "page", "link", "totalScore")


def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.build_cached(spark, sf_dir)
    res = search.search_build(b, fixtures.searches_frame(spark, sf_dir), texts=False)
    return search.result_counts(res)


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRH1/SRH2 alone: per (search, entry) BM25 score over title, label and whole content (IDX5)."""
    idx = B.full_index(spark, sf_dir)
    m = search.text_match(idx, fixtures.searches_frame(spark, sf_dir))
    # matches lie by subject: the entries' digests come to them
    ent = idx.entries.select("entry_id", "s", F.md5(F.col("value").cast("binary")).alias("value_md5"))
    return joined_in_place(m, ent, "entry_id").select("query_id", "s", "field", "value_md5", _round("score"))


def clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRH1-SRH3: BM25 matches under must / must-not / prefix / phrase clauses, over title, label and whole content."""
    idx = B.full_index(spark, sf_dir)
    m = search.text_match(idx, fixtures.clause_searches_frame(spark, sf_dir))
    # matches lie by subject: the entries' digests come to them
    ent = idx.entries.select("entry_id", "s", F.md5(F.col("value").cast("binary")).alias("value_md5"))
    return joined_in_place(m, ent, "entry_id").select("query_id", "s", "field", "value_md5", _round("score"))


def search_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRH + PRS1-PRS8: display columns of every result."""
    from trellis.operators.present import present
    b = B.build_cached(spark, sf_dir)
    res = search.search_build(b, fixtures.searches_frame(spark, sf_dir), texts=False)
    p = present(res, contents=b.contents)
    return p.select("query_id", "link", "displayTitle", "source", "snippet", "dateLine", "breadcrumbText",
                    "breadcrumbLinks", _round("totalScore"))


def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF10 + EXT2-EXT6 + MAP9: a user SELECT over the union graph picks nodes with
    HTML content; their tables become numbered results, rows, and content-graph terms."""
    from trellis.operators.mapping import map_table_rows
    knowledge = B.knowledge_triples(spark, sf_dir)
    sel = graph.run_selects(spark, graph.as_quads(knowledge, V.GRAPH_KNOWLEDGE), {"pages": (
        f"SELECT s, o AS content FROM quads WHERE p = '{V.CONTENT}' AND o LIKE '%<table%'")})["pages"]
    numbered = extract.number_results(sel.withColumn("query", F.lit("pages")), "query", ["s"])
    cells = extract.html_tables(numbered, "content", ["query", "result_no"])
    rows = extract.table_rows(cells, ["query", "result_no"])
    return map_table_rows(rows, "custkey", "name", prefix="cust_row_")


# ---------------------------------------------------------------- graph build pieces

def entity_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.knowledge_set(spark, sf_dir)


def union_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.build_cached(spark, sf_dir)
    u = graph.union_graph(b.quads)
    per_g = b.quads.groupBy("p").agg(F.count(F.lit(1)).alias("n_quads"))
    return (u.groupBy("p").agg(F.count(F.lit(1)).alias("n_triples"), F.countDistinct("s").alias("n_subjects"))
            .join(per_g, "p"))


def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.build_cached(spark, sf_dir)
    return graph.graph_sizes(b.quads)


def entity_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.build_cached(spark, sf_dir)
    e = joined_in_place(b.entities, b.contents, "content_id", "left")
    return e.select("s", "link", "title", "content", "email", "creationTime", "lastUpdateTime",
                    F.array_join(F.array_sort("types_arr"), V.TYPES_SEPARATOR).alias("types"),
                    F.array_join(F.transform(F.array_sort("ancestors"), lambda x: x["title"]), V.ANCESTOR_SEPARATOR).alias("ancestorTitles"))


def _place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> orders -> customer -> nation -> region as (child, parent)."""
    L = fixtures.load(spark, sf_dir, "lineitem")
    Ord = fixtures.load(spark, sf_dir, "orders")
    C = fixtures.load(spark, sf_dir, "customer")
    N = fixtures.load(spark, sf_dir, "nation")
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        L.select(F.concat(F.lit("line_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("child"),
                 k("order_", "l_orderkey").alias("parent"))
        .unionByName(Ord.select(k("order_", "o_orderkey").alias("child"), k("customer_", "o_custkey").alias("parent")))
        .unionByName(C.select(k("customer_", "c_custkey").alias("child"), k("nation_", "c_nationkey").alias("parent")))
        .unionByName(N.select(k("nation_", "n_nationkey").alias("child"), k("region_", "n_regionkey").alias("parent")))
    )


def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> orders -> customer -> nation -> region, depth = shortest path."""
    clo = transitive_closure(_place_edges(spark, sf_dir))
    return clo.select("desc", "anc", F.col("depth").cast("bigint").alias("depth"))


def tour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF7 by interval labels: root, depth and number of descendants of every node of the same forest."""
    from trellis.operators.intervals import descendant_counts, forest_labels
    labels = forest_labels(_place_edges(spark, sf_dir))
    return descendant_counts(labels, "root", "depth").select("node", "root", F.col("depth").cast("bigint").alias("depth"), F.col("n").alias("n_descendants"))


def _direct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type triples alone: the rule sets without their other predicates."""
    rules = {label: replace(r, objects=()) for label, r in mapping.ENTITY_RULES.items()}
    t = mapping.map_entities(fixtures.entity_frames(spark, sf_dir), rules)
    return t.select("s", F.col("o").alias("cls"))


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = _direct_types(spark, sf_dir)
    onto = inference.ontology_frames(spark)
    t = inference.infer_types(direct, inference.class_closure(onto["class_edges"]))
    return t.select("s", local_name(F.col("cls")).alias("type"))


def mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # titles and contents are read several times: mapped once
    knowledge = stored(B.knowledge_triples(spark, sf_dir).where(F.col("p").isin(V.TITLE, V.CONTENT)))
    content = fixtures.term_triples(fixtures.term_frame(spark, sf_dir))
    return enrich.link_mentions(enrich.artifacts_from_graph(knowledge), enrich.terms_from_graph(content))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = B.full_index(spark, sf_dir)
    cf = idx.counts.groupBy("field", "term").agg(F.sum("tf").cast("bigint").alias("cf"))
    return idx.term_df.join(cf, ["field", "term"]).select("field", "term", F.col("df").cast("bigint").alias("df"), "cf")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.full_index(spark, sf_dir).index_stats.select("field", F.col("n_docs").cast("bigint").alias("n_docs"), _round("avg_dl"))


# ---------------------------------------------------------------- HTML

def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer pages' HTML content -> body cells (header row consumed)."""
    pages = fixtures.entity_frames(spark, sf_dir)["pages"].where(F.col("content").isNotNull())
    cells = extract.html_tables(pages, "content", ["_id"])
    return cells.select(F.col("_id").alias("page"), "table_no", "row_no", "col_no", "header", "value")


def html_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of raw web pages: its length, digest and 300-character snippet."""
    pages = fixtures.load(spark, sf_dir, "pages").select("page_id", "html")
    t = extract.html_text(pages, "html", "text").drop("html")
    from trellis.operators.present import snippet
    return t.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
                    snippet(F.col("text")).alias("snippet"))


# ---------------------------------------------------------------- raw JSON side

def raw_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses -> complete chains -> items -> normalised -> unified (scalars)."""
    from trellis.operators.unify import scalars
    from trellis.plans import raw, raw_fixtures
    frames, _status = raw.unified(raw_fixtures.landed(spark, sf_dir))
    out = None
    for df in frames.values():
        s = scalars(df)
        out = s if out is None else out.unionByName(s)
    return out


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM12: retrieval counts per label after normalisation."""
    from trellis.operators.normalize import retrieval_counts
    from trellis.plans import raw, raw_fixtures
    return retrieval_counts(raw.normalized(raw_fixtures.landed(spark, sf_dir)))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNI1-UNI3 on the JSON text column of ``events``."""
    from trellis.operators.unify import detect_paths, scalars, unify
    ev = fixtures.load(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    rules = {"k": ["k", "k.missing", "props.k"]}
    present = detect_paths(ev, rules, order_by=["event_id"])
    return scalars(unify(ev, rules, present, keep=["event_id"]), names=("k",))


def _exchange_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid

    from trellis.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exchange/{name}-{uuid.uuid4().hex}"


def landed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1-SRC3 + NRM1/NRM2 from files: landed responses derived from the tables are
    written as JSON lines, read back, chain-checked, flattened and cleaned."""
    from trellis.operators.normalize import clean_items
    from trellis.plans import raw_fixtures
    from trellis.sources import landed
    path = _exchange_dir(spark, "landed")
    raw_fixtures.responses(spark, sf_dir).write.mode("overwrite").json(path)
    items = clean_items(landed.landed_items(spark, path))
    return items.groupBy("label").agg(F.count(F.lit(1)).alias("n_items"))


def ntriples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5 + N-Triples sink: mapped triples written as N-Triples lines and read back;
    counts and literal lengths per predicate prove the escaping exact."""
    from trellis.sources import sinks, triples
    path = _exchange_dir(spark, "ntriples")
    sinks.write_ntriples(B.knowledge_set(spark, sf_dir), path)
    t = triples.read_ntriples(spark, path)
    return t.groupBy("p", "o_kind").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.length("o")).cast("bigint").alias("chars"))


def landed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from landed JSON responses: complete chains -> items -> normalised -> unified ->
    mapped -> linked -> indexed -> searched."""
    from trellis.operators.unify import scalars
    from trellis.plans import raw, raw_fixtures
    frames, _status = raw.unified(raw_fixtures.landed(spark, sf_dir))
    b = B.build_graph(spark, {label: scalars(df) for label, df in frames.items()}, fixtures.term_frame(spark, sf_dir))
    res = search.search_build(b, fixtures.searches_frame(spark, sf_dir))
    return res.select(*[c for c in search.RESULT_COLUMNS if c != "totalScore"], _round("totalScore"))


def ontology_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF3 + INF4: customers and suppliers in nations in regions under a transitive property with an
    equivalent, an inverse and a super-property with a domain, and two equivalent classes."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    iri = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"),
                                        F.lit(None).cast("string").alias("o_lang"))
    C, S, N = (fixtures.load(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    triples = (
        iri(C, k("customer_", "c_custkey"), "partOf", k("nation_", "c_nationkey"))
        .unionByName(iri(S, k("supplier_", "s_suppkey"), "within", k("nation_", "s_nationkey")))
        .unionByName(iri(N, k("nation_", "n_nationkey"), "within", k("region_", "n_regionkey")))
        .unionByName(iri(C, k("customer_", "c_custkey"), V.RDF_TYPE, F.lit("Customer")))
    )
    axioms = spark.createDataFrame(
        [("partOf", "transitive", None), ("partOf", "equivalentProperty", "within"), ("hasPart", "inverseOf", "partOf"),
         ("partOf", "subPropertyOf", "relatedTo"), ("relatedTo", "domain", "Part"), ("Customer", "equivalentClass", "Client")],
        "p string, kind string, arg string")
    return inference.infer_fixpoint(triples, axioms).select("s", "p", "o")


def html_rendered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT1 on known text: every document rendered into one of three HTML shapes, extracted again."""
    t = F.col("text")
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;")):
        t = F.replace(t, F.lit(raw), F.lit(ref))
    head = F.lit("<html><head><style>p{margin:0}</style><script>if (a<b) x('</p>')</script></head><body><!-- no -->")
    shape = lambda a, b: F.concat(head, F.lit(a), t, F.lit(b))
    html = (F.when(F.col("doc_id") % 3 == 0, shape("<p>", "<p></body></html>"))
            .when(F.col("doc_id") % 3 == 1, shape("<div><ul><li><b>", "</b></ul></div>"))
            .otherwise(shape("<table><tr><th><td>", "</table><br>")))
    docs = fixtures.load(spark, sf_dir, "documents").select("doc_id", html.alias("html"))
    out = extract.html_text(docs, "html", "text")
    return out.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def ontology_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 in the loop: the ontology written as RDF/XML to the shared folder, read back
    with Spark's XML source, and used for type inference over the mapped entities."""
    from trellis.sources import ontology, sinks
    path = _exchange_dir(spark, "ontology")
    sinks.write_ontology_xml(inference.ontology_frames(spark), path)
    onto = ontology.read_ontology(spark, path)
    direct = _direct_types(spark, sf_dir)
    t = inference.infer_types(direct, inference.class_closure(onto["class_edges"]))
    return t.select("s", local_name(F.col("cls")).alias("type"))


# ---------------------------------------------------------------- registry

def queries() -> dict:
    return {
        "graph_search": graph_search,
        "result_pages": result_pages,
        "result_counts": result_counts,
        "bm25_scores": bm25_scores,
        "entity_triples": entity_triples,
        "union_graph": union_graph,
        "graph_sizes": graph_sizes,
        "entity_star": entity_star,
        "ancestor_closure": ancestor_closure,
        "tour_labels": tour_labels,
        "inferred_types": inferred_types,
        "mention_links": mention_links,
        "term_stats": term_stats,
        "index_stats": index_stats,
        "html_table_rows": html_table_rows,
        "html_page_text": html_page_text,
        "html_rendered_text": html_rendered_text,
        "landed_search": landed_search,
        "ontology_fixpoint": ontology_fixpoint,
        "clause_search": clause_search,
        "search_present": search_present,
        "content_terms": content_terms,
        "raw_unified": raw_unified,
        "landed_roundtrip": landed_roundtrip,
        "ontology_types": ontology_types,
        "ntriples_roundtrip": ntriples_roundtrip,
        "snapshot_counts": snapshot_counts,
        "event_props": event_props,
    }


def oracle_sql() -> dict:
    G, I, S = O.GRAPH_CTES, O.INDEX_CTES, O.SEARCH_CTES
    line_key = "'line_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)"
    place_closure = (
            "WITH RECURSIVE edges AS ("
            f" SELECT {line_key} AS child, 'order_' || CAST(l_orderkey AS VARCHAR) AS parent FROM lineitem"
            " UNION ALL SELECT 'order_' || CAST(o_orderkey AS VARCHAR), 'customer_' || CAST(o_custkey AS VARCHAR) FROM orders"
            " UNION ALL SELECT 'customer_' || CAST(c_custkey AS VARCHAR), 'nation_' || CAST(c_nationkey AS VARCHAR) FROM customer"
            " UNION ALL SELECT 'nation_' || CAST(n_nationkey AS VARCHAR), 'region_' || CAST(n_regionkey AS VARCHAR) FROM nation),"
            " clo AS (SELECT child AS \"desc\", parent AS anc, 1 AS depth FROM edges"
            " UNION SELECT c.\"desc\", e.parent, c.depth + 1 FROM clo c JOIN edges e ON c.anc = e.child)")
    return {
        "graph_search": O.with_ctes(G, I, S, body=(
            "SELECT query_id, link, title, content, email, creationTime, lastUpdateTime, types, ancestorTitles, "
            "ancestorLinks, round(totalScore, 6) AS totalScore FROM results")),
        "result_pages": O.with_ctes(G, I, S, body=(
            "SELECT query_id, rank, CAST((rank - 1) // 10 + 1 AS INTEGER) AS page, link, totalScore FROM ("
            " SELECT query_id, link, round(totalScore, 6) AS totalScore, row_number() OVER (PARTITION BY query_id "
            " ORDER BY round(totalScore, 6) DESC NULLS LAST, creationTime DESC NULLS LAST, link ASC NULLS LAST, "
            " title ASC NULLS LAST, content ASC NULLS LAST, email ASC NULLS LAST, lastUpdateTime ASC NULLS LAST) AS rank"
            " FROM results) WHERE rank <= 20")),
        "result_counts": O.with_ctes(G, I, S, body="SELECT query_id, count(*) AS n_results FROM results GROUP BY query_id"),
        "bm25_scores": O.with_ctes(
            f"ent AS ({O.ENTITIES_SQL})", f"kg AS ({O.KNOWLEDGE_SQL})",
            f"class_edges AS ({O._class_edges})", f"og AS ({O.ONTOLOGY_SQL})", f"cg AS ({O.CONTENT_SQL})",
            "ug AS (SELECT DISTINCT s, p, o, o_kind, o_lang FROM (SELECT * FROM kg UNION ALL SELECT * FROM og "
            "UNION ALL SELECT * FROM cg))",
            O.FULL_INDEX_CTES, S.split("refs AS")[0].rstrip().rstrip(","),
            body="SELECT query_id, s, field, md5(value) AS value_md5, round(score, 6) AS score FROM matched"),
        "entity_triples": O.with_ctes(f"ent AS ({O.ENTITIES_SQL})", body=O.KNOWLEDGE_SQL),
        "union_graph": O.with_ctes(G, body=(
            "SELECT u.p, u.n_triples, u.n_subjects, q.n_quads FROM "
            "(SELECT p, count(*) AS n_triples, count(DISTINCT s) AS n_subjects FROM ug GROUP BY p) u "
            "JOIN (SELECT p, count(*) AS n_quads FROM quads GROUP BY p) q ON u.p = q.p")),
        "graph_sizes": O.with_ctes(G, body="SELECT g, count(*) AS n_triples FROM quads GROUP BY g"),
        "entity_star": O.with_ctes(G, I, S, body=(
            "SELECT p.s, p.link, p.title, p.content, p.email, p.creationTime, p.lastUpdateTime, "
            f"array_to_string(list_sort(list_distinct(list(tn.tname))), {O.q(V.TYPES_SEPARATOR)}) AS types, "
            f"{O.ancestors('t')} AS ancestorTitles "
            "FROM props p JOIN type_names tn ON tn.s = p.s LEFT JOIN anc_pairs ap ON ap.s = p.s "
            "GROUP BY p.s, p.link, p.title, p.content, p.email, p.creationTime, p.lastUpdateTime")),
        "ancestor_closure": place_closure + " SELECT \"desc\", anc, CAST(min(depth) AS BIGINT) AS depth FROM clo GROUP BY \"desc\", anc",
        "tour_labels": place_closure + (
            ", nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges)"
            " SELECT node, coalesce(u.root, node) AS root, coalesce(u.depth, 0) AS depth, coalesce(d.n, 0) AS n_descendants FROM nodes"
            " LEFT JOIN (SELECT \"desc\", arg_max(anc, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM clo GROUP BY \"desc\") u ON u.\"desc\" = node"
            " LEFT JOIN (SELECT anc, count(*) AS n FROM clo GROUP BY anc) d ON d.anc = node"),
        "inferred_types": O.INFERRED_TYPES_SQL,
        "ontology_types": O.INFERRED_TYPES_SQL,  # same inference, ontology read from its file
        "mention_links": O.with_ctes(
            f"ent AS ({O.ENTITIES_SQL})", f"kg AS ({O.KNOWLEDGE_SQL})", f"cg AS ({O.CONTENT_SQL})",
            f"artifacts AS ({O.ARTIFACTS_SQL})", f"links AS ({O.LINKS_SQL})",
            body="SELECT artifact, term FROM links"),
        "term_stats": O.with_ctes(G, O.FULL_INDEX_CTES, body=(
            "SELECT d.field, d.term, d.df, c.cf FROM term_df d JOIN "
            "(SELECT field, term, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY field, term) c USING (field, term)")),
        "index_stats": O.with_ctes(G, O.FULL_INDEX_CTES, body="SELECT field, n_docs, round(avg_dl, 6) AS avg_dl FROM stats"),
        "search_present": O.with_ctes(G, I, S, body=O.PRESENT_BODY),
        "clause_search": O.with_ctes(G, O.DIGEST_INDEX_CTES, O.CLAUSE_CTES, body=(
            "SELECT query_id, s, field, value AS value_md5, round(score, 6) AS score FROM clause_matched")),
        "content_terms": (
            f"SELECT DISTINCT {O.q(V.NS + 'cust_row_')} || CAST(c_custkey AS VARCHAR) AS s, {O.q(V.TITLE)} AS p, "
            "c_name AS o, 'literal' AS o_kind, NULL::VARCHAR AS o_lang FROM customer"),
        "raw_unified": O.RAW_UNIFIED_SQL,
        "ontology_fixpoint": O.ONTOLOGY_FIXPOINT_SQL,
        "html_rendered_text": (
            "SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, "
            "trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM documents)"),
        "snapshot_counts": O.SNAPSHOT_COUNTS_SQL,
        "landed_roundtrip": O.LANDED_ITEMS_SQL,
        "ntriples_roundtrip": O.with_ctes(f"ent AS ({O.ENTITIES_SQL})", f"kg AS ({O.KNOWLEDGE_SQL})", body=(
            "SELECT p, o_kind, count(*) AS n, CAST(sum(length(o)) AS BIGINT) AS chars FROM kg GROUP BY p, o_kind")),
        "event_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "html_table_rows": (
            "SELECT 'customer_' || CAST(c_custkey AS VARCHAR) AS page, 0 AS table_no, 1 AS row_no, col_no, header, value "
            "FROM customer, (SELECT unnest([0, 1, 2, 3]) AS col_no) k "
            "CROSS JOIN LATERAL (SELECT CASE col_no WHEN 0 THEN 'custkey' WHEN 1 THEN 'name' WHEN 2 THEN 'nation' ELSE 'segment' END AS header, "
            "CASE col_no WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_name WHEN 2 THEN CAST(c_nationkey AS VARCHAR) "
            "ELSE c_mktsegment END AS value)"),
    }


def landed_search_sql() -> str:
    """The landed chain with all searches in SQL: too large for the tables the twins run on, so tests hold the query against it on a
    small fixture."""
    G, I, S = O.GRAPH_CTES, O.INDEX_CTES, O.SEARCH_CTES
    return O.with_ctes(G.replace(f"ent AS ({O.ENTITIES_SQL})", f"ent AS MATERIALIZED ({O.RAW_UNIFIED_SQL})")
                                    .replace(f"kg AS ({O.KNOWLEDGE_SQL})", f"kg AS MATERIALIZED ({O.KNOWLEDGE_SQL})"), I, S, body=(
            "SELECT query_id, link, title, content, email, creationTime, lastUpdateTime, types, ancestorTitles, "
            "ancestorLinks, round(totalScore, 6) AS totalScore FROM results"))
