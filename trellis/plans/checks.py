"""Registered queries for operators that the graph build and the searches do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.text import iso_utc
from trellis.operators import enrich, extract, graph, index, inference, mapping
from trellis.operators.normalize import clean_items
from trellis.operators.unify import detect_paths, unify, unify_all
from trellis.plans import build as B
from trellis.plans import fixtures
from trellis.plans import oracle as O
from trellis.plans.catalog import _exchange_dir
from trellis.sources import landed, sinks, triples


def _key(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def incomplete_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, SRC3, NRM2: one request per customer, one page per order; some pages failed, some are not
    JSON, some hold items that are no objects."""
    o = fixtures.load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("request_id"), "o_orderkey")
    good = F.concat(F.lit('{"results":[{"id":"'), F.col("o_orderkey").cast("string"), F.lit('"}'),
                    F.when(F.col("o_orderkey") % 5 == 0, F.lit(',"text",7,null')).otherwise(F.lit("")), F.lit("]}"))
    pages = o.select(
        F.lit("2024-03-05").cast("date").alias("snapshot_date"), F.lit("comments").alias("label"), "request_id",
        F.lit(None).cast("string").alias("parent_key"), F.col("o_orderkey").cast("int").alias("page_no"),
        (F.col("o_orderkey") % 41 != 0).alias("ok"),
        F.when(F.col("o_orderkey") % 37 == 0, F.lit("<html>busy</html>")).otherwise(good).alias("body"))
    items = clean_items(landed.flatten_responses(landed.drop_incomplete_chains(landed.parse_bodies(pages))))
    return items.select("request_id", "page_no", F.try_variant_get("doc", "$._id", "string").alias("id"))


def array_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP6: array fields give a triple per element."""
    o = fixtures.load(spark, sf_dir, "orders")
    rows = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("name"), F.collect_set(_key("o ", "o_orderkey")).alias("author"))
    rules = mapping.EntityRules("pages", "Page", "_id", ((V.TITLE, "literal", "name"), (V.AUTHOR, "iri", "author")))
    out = mapping.map_to_triples(rows.select(_key("c", "o_custkey").alias("_id"), "name", "author"), rules)
    return out.select("s", "p", "o", "o_kind")


def graph_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF4, GRF5: child and parent joined on shared variables, an optional property."""
    quads = graph.as_quads(B.knowledge_triples(spark, sf_dir), V.GRAPH_KNOWLEDGE)
    m = graph.match(quads, [("?child", V.ANCESTOR, "?parent"), ("?parent", V.TITLE, "?title")], [("?child", V.AUTHOR, "?author")])
    return m.select("child", "parent", "title", "author")


def stored_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SRC5: named graphs written, one replaced, all read back."""
    path = _exchange_dir(spark, "quads")
    N, R = fixtures.load(spark, sf_dir, "nation"), fixtures.load(spark, sf_dir, "region")
    title = lambda df, s, o: df.select(s.alias("s"), F.lit(V.TITLE).alias("p"), F.col(o).alias("o"), F.lit("literal").alias("o_kind"),
                                       F.lit("en").alias("o_lang"))
    first = title(N, _key("n", "n_nationkey"), "n_name").withColumn("g", F.lit("nations"))
    sinks.write_quads(first.unionByName(title(R, _key("old", "r_regionkey"), "r_name").withColumn("g", F.lit("regions"))), path)
    sinks.replace_graph(spark, path, title(R, _key("r", "r_regionkey"), "r_name"), "regions")
    return spark.read.parquet(path).select("g", "s", "p", "o", "o_kind", "o_lang").where(F.col("g").isNotNull()).unionByName(
        triples.load_triples(spark, f"{path}/g=regions", graph="again").select("g", "s", "p", "o", "o_kind", "o_lang"))


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK2: dated snapshots of two labels, one written twice, and the JSON export, read back."""
    path = _exchange_dir(spark, "snapshot")
    C, S = fixtures.load(spark, sf_dir, "customer"), fixtures.load(spark, sf_dir, "supplier")
    customers = C.select(_key("c", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = S.select(_key("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    sinks.write_snapshot(customers, path, "customers", "2024-03-05")
    sinks.write_snapshot(customers, path, "suppliers", "2024-03-05")
    sinks.write_snapshot(suppliers, path, "suppliers", "2024-03-05")
    sinks.export_json({"suppliers": suppliers}, f"{path}-json")
    stored = spark.read.parquet(path).select(F.col("label").cast("string").alias("label"), "id", "name")
    return stored.unionByName(spark.read.schema("id string, name string").json(f"{path}-json/suppliers").select(F.lit("exported").alias("label"), "id", "name"))


def reference_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF5: orders that reference a customer reference its class and the classes above it."""
    refs = fixtures.load(spark, sf_dir, "orders").select(_key("o", "o_orderkey").alias("s"), _key("c", "o_custkey").alias("o"))
    types = fixtures.load(spark, sf_dir, "customer").select(_key("c", "c_custkey").alias("s"), F.lit("Customer").alias("cls"))
    edges = spark.createDataFrame([("Customer", "Client"), ("Client", "Agent")], "sub string, sup string")
    return inference.expand_references(refs, types, inference.class_closure(edges))


def class_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF1, INF2, INF4: customers and suppliers typed by nation, nations in regions that include each other in a circle, every
    nation's class equivalent to one of another name, a range whose class has an equivalent."""
    C, S, N, R, Ord = (fixtures.load(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region", "orders"))
    n_regions = R.count()
    iri = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"),
                                        F.lit(None).cast("string").alias("o_lang"))
    t = (iri(C, _key("customer_", "c_custkey"), V.RDF_TYPE, _key("nation_", "c_nationkey"))
         .unionByName(iri(C, _key("customer_", "c_custkey"), V.RDF_TYPE, F.col("c_mktsegment")))
         .unionByName(iri(S.join(N, F.col("s_nationkey") == F.col("n_nationkey")), _key("supplier_", "s_suppkey"), V.RDF_TYPE, F.col("n_name")))
         .unionByName(iri(Ord, _key("order_", "o_orderkey"), "placedBy", _key("customer_", "o_custkey"))))
    edges = (N.select(_key("nation_", "n_nationkey").alias("sub"), _key("region_", "n_regionkey").alias("sup"))
             .unionByName(R.select(_key("region_", "r_regionkey").alias("sub"), F.concat(F.lit("region_"), ((F.col("r_regionkey") + 1) % n_regions).cast("string")).alias("sup"))))
    axioms = (N.select(_key("nation_", "n_nationkey").alias("p"), F.lit("equivalentClass").alias("kind"), F.col("n_name").alias("arg"))
              .unionByName(spark.createDataFrame([("placedBy", "range", "Client"), ("Party", "equivalentClass", "Client")], "p string, kind string, arg string")))
    out = inference.infer_fixpoint(t, axioms, edges)
    return out.where(F.col("p") == V.RDF_TYPE).select("s", F.col("o").alias("cls"))


XSD = "http://www.w3.org/2001/XMLSchema#"


def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: literals with datatypes, languages and escapes written as N-Triples and read back."""
    path = _exchange_dir(spark, "typed")
    o, d = fixtures.load(spark, sf_dir, "orders"), fixtures.load(spark, sf_dir, "documents")
    t = lambda df, s, p, x, lang, dtype: df.select(s.alias("s"), F.lit(V.NS + p).alias("p"), x.cast("string").alias("o"), F.lit("literal").alias("o_kind"),
                                                   lang.cast("string").alias("o_lang"), dtype.cast("string").alias("o_dtype"))
    none, order = F.lit(None), _key(V.NS + "o", "o_orderkey")
    out = (t(o, order, "price", F.col("o_totalprice").cast("decimal(18,2)"), none, F.lit(XSD + "decimal"))
           .unionByName(t(o, order, "date", iso_utc(F.col("o_orderdate")), none, F.lit(XSD + "dateTime")))
           .unionByName(t(o, order, "status", F.col("o_orderstatus"), none, none))
           .unionByName(t(d, _key(V.NS + "d", "doc_id"), "text", F.col("text"), F.col("lang"), none)))
    sinks.write_ntriples(out, path)
    back = triples.read_ntriples(spark, path)
    return back.select("s", "p", F.md5(F.col("o").cast("binary")).alias("o_md5"), "o_lang", "o_dtype")


def table_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP9: two user rule sets over the rows of extracted tables: customers with a type, a title, a link to their nation's
    node and a constant; segments as nodes of their own."""
    pages = fixtures.entity_frames(spark, sf_dir)["pages"].where(F.col("content").isNotNull())
    rows = extract.table_rows(extract.html_tables(pages, "content", ["_id"]), ["_id"])
    rules = [mapping.EntityRules("customers", "Client", "custkey", (
                 (V.TITLE, "literal", "name"), (V.NS + "inNation", "iri", "nation", "nation_"), (V.NS + "status", "constant_iri", V.NS + "active"),
                 (V.EMAIL, "literal", "email")), prefix="client "),
             mapping.EntityRules("segments", "Segment", "segment", ((V.TITLE, "literal", "segment"),), prefix="segment_")]
    return mapping.map_rows(rows, rules).select("s", "p", "o", "o_kind")


def several_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNI4: a field of several paths: the first value, then later arrays and objects; a later plain value is dropped."""
    o = fixtures.load(spark, sf_dir, "orders")
    text = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key")).alias("a"), F.array("o_orderstatus", "o_orderpriority").alias("list"),
                              F.col("o_orderstatus").alias("plain"), F.when(F.col("o_custkey") % 2 == 0, F.struct(F.col("o_custkey").alias("c"))).alias("object")))
    docs = o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.try_parse_json(text).alias("doc"))
    rules = {"v": ["a.key", "list", "plain", "object", "nowhere"]}
    paths = detect_paths(docs, rules, sample="all")
    return unify(docs, rules, paths, keep=["o_orderkey"]).select("o_orderkey", F.array_join("v", "|").alias("v"))


def unify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNI6: which collections could be unified, and how many documents each holds; empty ones are not."""
    from trellis.plans import raw, raw_fixtures
    frames = raw.normalized(raw_fixtures.landed(spark, sf_dir))
    frames["drafts"] = frames["posts"].where(F.lit(False))
    out, status = unify_all(frames, order_by=raw.ORDER, keep=["label"])
    counts = None
    for label, df in out.items():
        n = df.select(F.lit(label).alias("label"))
        counts = n if counts is None else counts.unionByName(n)
    counts = counts.groupBy("label").agg(F.count("*").alias("n"))
    return spark.createDataFrame(status, "label string, unified boolean").join(counts, "label", "left")


def partial_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP8: labels without a frame are skipped, the others mapped."""
    frames = fixtures.entity_frames(spark, sf_dir)
    return mapping.map_entities({k: frames[k] for k in ("users", "comments")}).distinct().groupBy("p", "o_kind").agg(F.count("*").alias("n"))


def mention_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENR6: linking the documents to benchmark texts, to no terms, and no artifacts to any."""
    d = fixtures.load(spark, sf_dir, "documents").select(_key("d", "doc_id").alias("artifact"), "text")
    terms = fixtures.load(spark, sf_dir, "benchmark").select(_key("b", "item_id").alias("term"), F.col("text").alias("title"))
    links = enrich.link_mentions(d, terms).agg(F.lit("links").alias("case"), F.count("*").alias("n"))
    title = fixtures.term_triples(terms.select(F.col("term").alias("s"), "title"))
    failed = []
    for case, run in (("no terms", lambda: enrich.link_mentions(d, terms.where(F.lit(False)))),
                      ("no artifacts", lambda: enrich.artifacts_from_graph(title.where(F.lit(False))))):
        try:
            run()
        except ValueError:
            failed.append((case, 0))
    return links.unionByName(spark.createDataFrame(failed, "case string, n long"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX3, SRH3: phrases of three words from every benchmark text, as they stand and with up to two tokens between, over title, label and
    whole content: matches by position, and their score."""
    from trellis.functions.text import tokens
    from trellis.operators import search
    idx = B.full_index(spark, sf_dir)
    words = F.slice(tokens(F.col("text")), 2, 3)
    b = fixtures.load(spark, sf_dir, "benchmark").where(F.size(tokens(F.col("text"))) > 4)
    exact = b.select(_key("e", "item_id").alias("query_id"), F.array_join(words, " ").alias("phrase"), F.lit(0).alias("slop"))
    ends = F.array(F.get(tokens(F.col("text")), F.lit(1)), F.get(tokens(F.col("text")), F.lit(3)))
    loose = b.select(_key("l", "item_id").alias("query_id"), F.array_join(ends, " ").alias("phrase"), F.lit(2).alias("slop"))
    m = search.phrase_match(idx, exact.unionByName(loose))
    ent = idx.entries.select("entry_id", "s", F.md5(F.col("value").cast("binary")).alias("value_md5"))
    return m.join(ent, ["entry_id", "s"]).select("query_id", "s", "field", "value_md5", "n", F.round("score", 6).alias("score"))


def bucket_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF9: changes between two written states of a store: some orders go, some change their status, others stay."""
    o = fixtures.load(spark, sf_dir, "orders")
    quad = lambda df, status: df.select(F.lit("orders").alias("g"), _key("o", "o_orderkey").alias("s"), F.lit(V.TITLE).alias("p"), status.alias("o"),
                                        F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"))
    before, after = _exchange_dir(spark, "before"), _exchange_dir(spark, "after")
    graph.write_buckets(quad(o, F.col("o_orderstatus")), before)
    status = F.when(F.col("o_orderkey") % 509 == 0, F.lit("changed")).otherwise(F.col("o_orderstatus"))
    graph.write_buckets(quad(o.where("o_orderkey % 1009 <> 0"), status), after)
    return graph.bucket_delta(spark, before, after).select("change", "s", "o")


def versioned_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: nations and regions as versions of a store: a reader of the second version keeps its rows while regions are replaced."""
    from trellis.sources import versions
    path = _exchange_dir(spark, "versions")
    N, R = fixtures.load(spark, sf_dir, "nation"), fixtures.load(spark, sf_dir, "region")
    title = lambda df, s, o: df.select(s.alias("s"), F.lit(V.TITLE).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit("en").alias("o_lang"))
    versions.replace_graph(spark, path, title(N, _key("n", "n_nationkey"), F.col("n_name")), "nations")
    versions.replace_graph(spark, path, title(R, _key("old", "r_regionkey"), F.upper("r_name")), "regions")
    before = versions.read(spark, path)
    versions.replace_graph(spark, path, title(R, _key("r", "r_regionkey"), F.col("r_name")), "regions")
    state = lambda df, name: df.select(F.lit(name).alias("state"), "g", "s", "o", "o_lang")
    return state(before, "before").unionByName(state(versions.read(spark, path), "after"))


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX3: an index of document texts brought through three states by segments: all but every fifth text; all, where every
    seventh has another language; all but every eleventh. Its terms, document and collection frequencies and summed weights."""
    from trellis.operators import segments
    path = _exchange_dir(spark, "segments")
    d = fixtures.load(spark, sf_dir, "documents")
    g = lambda df, lang: df.select(_key("d", "doc_id").alias("s"), F.lit(V.TITLE).alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), lang.alias("o_lang"))
    other = F.when(F.col("doc_id") % 7 == 0, F.lit("xx")).otherwise(F.col("lang"))
    segments.update(spark, path, g(d.where("doc_id % 5 <> 0"), F.col("lang")))
    segments.update(spark, path, g(d, other))
    segments.update(spark, path, g(d.where("doc_id % 11 <> 0"), other))
    idx = segments.open_index(spark, path)
    sums = idx.postings.groupBy("field", "term").agg(F.sum("tf").cast("long").alias("cf"), F.round(F.sum("w"), 6).alias("w"))
    return idx.term_df.join(sums, ["field", "term"]).select("term", F.col("df").cast("long").alias("df"), "cf", "w")


def star_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF2, GRF4, GRF6 over a store laid out by graph and predicate: nodes with a link, a title and a time, and the time optional."""
    from trellis.operators import layout
    store = layout.write_store(graph.as_quads(B.knowledge_triples(spark, sf_dir), V.GRAPH_KNOWLEDGE), _exchange_dir(spark, "layout"))
    out = store.star({"link": V.LINK, "title": V.TITLE, "creationTime": V.CREATION_TIME}, required=("link", "title"))
    n = store.star_count([V.LINK, V.TITLE])
    return out.select("s", "link", "title", "creationTime", F.lit(n).cast("long").alias("n_subjects"))


def language_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX4: index entries keep the language of their literal."""
    d = fixtures.load(spark, sf_dir, "documents")
    g = d.select(_key("d", "doc_id").alias("s"), F.lit(V.RDFS_LABEL).alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.col("lang").alias("o_lang"))
    return index.index_entries(g).select("s", "field", F.md5(F.col("value").cast("binary")).alias("value_md5"), "lang")


def extraction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT5, EXT6, SNK4: numbered results with their variables and tables, written and read back."""
    path = _exchange_dir(spark, "extraction")
    pages = fixtures.entity_frames(spark, sf_dir)["pages"].where(F.col("content").isNotNull()).select(F.lit("pages").alias("query"), F.col("_id").alias("s"), "title", "content")
    numbered = extract.number_results(pages, "query", ["s"])
    cells = extract.html_tables(numbered, "content", ["query", "result_no"])
    bindings = extract.bindings_map(numbered, ["s", "title"]).select("query", "result_no", "bindings")
    sinks.write_extraction(cells, path, bindings)
    line = spark.read.text(path)
    at = lambda p: F.get_json_object("value", p)
    no = F.regexp_extract("value", r'"Result_(\d+)":', 1)
    body = line.select(no.cast("bigint").alias("result_no"), at("$.query").alias("query"),
                       F.regexp_replace("value", r'"Result_\d+":', '"Result":').alias("value"))
    return body.select("query", "result_no", at("$.Result.s").alias("s"), at("$.Result.title").alias("title"),
                       at("$.Result.Table_0[0].custkey").alias("custkey"), at("$.Result.Table_0[0].segment").alias("segment"))


def queries() -> dict:
    return {f.__name__: f for f in (incomplete_chains, array_triples, graph_patterns, stored_graphs, snapshot_files,
                                    reference_expansion, class_axioms, language_index, extraction_file, typed_literals, table_row_rules,
                                    several_paths, unify_status, partial_mapping, mention_guards, phrase_search, bucket_changes,
                                    versioned_graphs, incremental_index, star_patterns)}


def oracle_sql() -> dict:
    q = O.q
    kg = (f"ent AS ({O.ENTITIES_SQL})", f"kg AS ({O.KNOWLEDGE_SQL})")
    title = f"{q(V.TITLE)} AS p"
    return {
        "incomplete_chains": (
            "SELECT CAST(o_custkey AS VARCHAR) AS request_id, CAST(o_orderkey AS INTEGER) AS page_no, CAST(o_orderkey AS VARCHAR) AS id "
            "FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 41 = 0 OR o_orderkey % 37 = 0)"),
        "array_triples": (
            f"SELECT DISTINCT {q(V.NS + 'c')} || o_custkey AS s, {title}, o_orderpriority AS o, 'literal' AS o_kind FROM orders "
            f"UNION ALL SELECT {q(V.NS + 'c')} || o_custkey, {q(V.AUTHOR)}, {q(V.NS + 'o%20')} || o_orderkey, 'iri' FROM orders "
            f"UNION ALL SELECT DISTINCT {q(V.NS + 'c')} || o_custkey, {q(V.RDF_TYPE)}, {q(V.NS + 'Page')}, 'iri' FROM orders"),
        "graph_patterns": O.with_ctes(*kg, body=(
            f"SELECT a.s AS child, a.o AS parent, t.o AS title, x.o AS author FROM (SELECT s, o FROM kg WHERE p = {q(V.ANCESTOR)}) a "
            f"JOIN (SELECT s, o FROM kg WHERE p = {q(V.TITLE)}) t ON t.s = a.o "
            f"LEFT JOIN (SELECT s, o FROM kg WHERE p = {q(V.AUTHOR)}) x ON x.s = a.s")),
        "stored_graphs": (
            f"SELECT 'nations' AS g, 'n' || n_nationkey AS s, {title}, n_name AS o, 'literal' AS o_kind, 'en' AS o_lang FROM nation UNION ALL "
            f"SELECT g, 'r' || r_regionkey, {q(V.TITLE)}, r_name, 'literal', 'en' FROM region, (SELECT unnest(['regions', 'again']) AS g)"),
        "snapshot_files": (
            "SELECT 'customers' AS label, 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL "
            "SELECT l, 's' || s_suppkey, s_name FROM supplier, (SELECT unnest(['suppliers', 'exported']) AS l)"),
        "reference_expansion": (
            "SELECT DISTINCT 'o' || o_orderkey AS s, 'c' || o_custkey AS o FROM orders UNION ALL "
            "SELECT 'o' || o_orderkey, c FROM orders, (SELECT unnest(['Customer', 'Client', 'Agent']) AS c) "
            "WHERE o_custkey IN (SELECT c_custkey FROM customer)"),
        "class_axioms": (
            "WITH RECURSIVE edges AS (SELECT 'nation_' || n_nationkey AS sub, 'region_' || n_regionkey AS sup FROM nation "
            "UNION ALL SELECT 'region_' || r_regionkey, 'region_' || ((r_regionkey + 1) % (SELECT count(*) FROM region)) FROM region "
            "UNION ALL SELECT 'nation_' || n_nationkey, n_name FROM nation UNION ALL SELECT n_name, 'nation_' || n_nationkey FROM nation "
            "UNION ALL SELECT 'Party', 'Client' UNION ALL SELECT 'Client', 'Party'), "
            "clo AS (SELECT sub, sup FROM edges UNION SELECT c.sub, e.sup FROM clo c JOIN edges e ON c.sup = e.sub), "
            "types AS (SELECT 'customer_' || c_custkey AS s, 'nation_' || c_nationkey AS cls FROM customer "
            "UNION ALL SELECT 'customer_' || c_custkey, c_mktsegment FROM customer "
            "UNION ALL SELECT 'supplier_' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey "
            "UNION ALL SELECT 'customer_' || o_custkey, 'Client' FROM orders) "
            "SELECT s, cls FROM types UNION SELECT s, sup FROM types JOIN clo ON cls = sub"),
        "typed_literals": (
            f"SELECT {q(V.NS + 'o')} || o_orderkey AS s, {q(V.NS)} || p AS p, md5(o) AS o_md5, NULL::VARCHAR AS o_lang, d AS o_dtype FROM ("
            f"SELECT o_orderkey, 'price' AS p, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o, {q(XSD + 'decimal')} AS d FROM orders "
            f"UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), {q(XSD + 'dateTime')} FROM orders "
            "UNION ALL SELECT o_orderkey, 'status', o_orderstatus, NULL FROM orders) UNION ALL "
            f"SELECT {q(V.NS + 'd')} || doc_id, {q(V.NS + 'text')}, md5(text), lang, NULL FROM documents"),
        "table_row_rules": (
            f"SELECT {q(V.NS + 'client%20')} || c_custkey AS s, p, o, k AS o_kind FROM (SELECT c_custkey, unnest(["
            f"{{'p': {q(V.RDF_TYPE)}, 'o': {q(V.NS + 'Client')}, 'k': 'iri'}}, {{'p': {q(V.TITLE)}, 'o': c_name, 'k': 'literal'}}, "
            f"{{'p': {q(V.NS + 'inNation')}, 'o': {q(V.NS + 'nation_')} || c_nationkey, 'k': 'iri'}}, "
            f"{{'p': {q(V.NS + 'status')}, 'o': {q(V.NS + 'active')}, 'k': 'iri'}}], recursive := true) FROM customer) "
            f"UNION ALL SELECT DISTINCT {q(V.NS + 'segment_')} || c_mktsegment, {q(V.RDF_TYPE)}, {q(V.NS + 'Segment')}, 'iri' FROM customer "
            f"UNION ALL SELECT DISTINCT {q(V.NS + 'segment_')} || c_mktsegment, {q(V.TITLE)}, c_mktsegment, 'literal' FROM customer"),
        "several_paths": (
            "SELECT o_orderkey, o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || "
            "CASE WHEN o_custkey % 2 = 0 THEN '|{\"c\":' || o_custkey || '}' ELSE '' END AS v FROM orders"),
        "unify_status": (f"SELECT label, n > 0 AS unified, nullif(n, 0) AS n FROM ({O.SNAPSHOT_COUNTS_SQL} UNION ALL SELECT 'drafts', 0)"),
        "partial_mapping": O.with_ctes(f"ent AS (SELECT * FROM ({O.ENTITIES_SQL}) WHERE label IN ('users', 'comments'))", f"kg AS ({O.KNOWLEDGE_SQL})", body=(
            "SELECT p, o_kind, count(*) AS n FROM kg GROUP BY p, o_kind")),
        "mention_guards": (
            "SELECT 'links' AS \"case\", count(*) AS n FROM (SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))) "
            "UNION ALL SELECT unnest(['no terms', 'no artifacts']), 0"),
        "phrase_search": O.with_ctes(O.GRAPH_CTES, O.DIGEST_INDEX_CTES, f"""
b AS (SELECT item_id, {O.tokens('text')} AS t FROM benchmark),
ph AS (SELECT 'e' || item_id AS query_id, t[2:4] AS terms, 0 AS slop FROM b WHERE len(t) > 4 UNION ALL SELECT 'l' || item_id, [t[2], t[4]], 2 FROM b WHERE len(t) > 4),
firsts AS (SELECT p.query_id, p.terms, p.slop, e.s, e.field, e.value, e.lang, e.toks, unnest(range(1, len(e.toks) + 1)) AS i1 FROM ph p
  JOIN entry_toks e ON list_contains(e.toks, p.terms[1]) AND list_contains(e.toks, p.terms[2]) AND (len(p.terms) < 3 OR list_contains(e.toks, p.terms[3]))),
seconds AS (SELECT *, i1 + list_position(toks[i1 + 1:], terms[2]) AS i2 FROM firsts WHERE toks[i1] = terms[1]),
thirds AS (SELECT *, CASE WHEN len(terms) = 3 THEN i2 + list_position(toks[i2 + 1:], terms[3]) ELSE i2 END AS i3 FROM seconds WHERE i2 > i1),
gaps AS (SELECT *, i3 - i1 - len(terms) + 1 AS gap FROM thirds WHERE len(terms) = 2 OR i3 > i2),
freqs AS (SELECT query_id, s, field, value, lang, len(toks) AS dl, count(*) AS n, sum(1.0 / (1 + gap)) AS freq FROM gaps WHERE gap <= slop GROUP BY ALL),
idfs AS (SELECT q.query_id, d.field, sum(ln(1 + (st.n_docs - d.df + 0.5) / (d.df + 0.5))) AS idf FROM (SELECT query_id, unnest(terms) AS term FROM ph) q
  JOIN term_df d USING (term) JOIN stats st USING (field) GROUP BY ALL)
""", body=f"SELECT f.query_id, f.s, f.field, f.value AS value_md5, f.n, "
                                     f"round(idf * freq / (freq + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * dl / avg_dl)), 6) AS score "
                                     "FROM freqs f JOIN idfs USING (query_id, field) JOIN stats USING (field)"),
        "bucket_changes": (
            "SELECT 'removed' AS change, 'o' || o_orderkey AS s, o_orderstatus AS o FROM orders WHERE o_orderkey % 1009 = 0 OR o_orderkey % 509 = 0 UNION ALL "
            "SELECT 'added', 'o' || o_orderkey, 'changed' FROM orders WHERE o_orderkey % 509 = 0 AND o_orderkey % 1009 <> 0"),
        "versioned_graphs": (
            "SELECT state, 'nations' AS g, 'n' || n_nationkey AS s, n_name AS o, 'en' AS o_lang FROM nation, (SELECT unnest(['before', 'after']) AS state) UNION ALL "
            "SELECT 'before', 'regions', 'old' || r_regionkey, upper(r_name), 'en' FROM region UNION ALL "
            "SELECT 'after', 'regions', 'r' || r_regionkey, r_name, 'en' FROM region"),
        "incremental_index": (
            f"WITH e AS (SELECT DISTINCT doc_id, text, {O.tokens('text')} AS toks FROM documents WHERE doc_id % 11 <> 0), "
            "st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_dl FROM e), "
            "tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM e) GROUP BY doc_id, term), "
            "df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term) "
            f"SELECT term, df, any_value(cf) AS cf, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * dl / avg_dl))), 6) AS w "
            "FROM tf JOIN df USING (term), st GROUP BY term, df"),
        "star_patterns": O.with_ctes(*kg, body=(
            f"SELECT l.s, l.o AS link, t.o AS title, c.o AS creationTime, (SELECT count(DISTINCT a.s) FROM kg a JOIN kg b ON a.s = b.s "
            f"WHERE a.p = {q(V.LINK)} AND b.p = {q(V.TITLE)}) AS n_subjects FROM (SELECT s, o FROM kg WHERE p = {q(V.LINK)}) l "
            f"JOIN (SELECT s, o FROM kg WHERE p = {q(V.TITLE)}) t ON t.s = l.s LEFT JOIN (SELECT s, o FROM kg WHERE p = {q(V.CREATION_TIME)}) c ON c.s = l.s")),
        "language_index": "SELECT DISTINCT 'd' || doc_id AS s, 'label' AS field, md5(text) AS value_md5, lang FROM documents",
        "extraction_file": (
            "SELECT 'pages' AS query, row_number() OVER (ORDER BY 'customer_' || c_custkey) AS result_no, 'customer_' || c_custkey AS s, "
            "c_name AS title, CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment FROM customer"),
    }
