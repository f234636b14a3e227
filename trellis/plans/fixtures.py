"""Graph-shaped inputs derived from the driver tables (FIXTURES.md part C).

Every frame is a lazy projection/join of the parquet tables, so its size grows with
them. Unified entity columns: ``_id, type, name, email, title, link, content, author,
creationTime, lastUpdateTime, ancestor`` (missing ones are null).

* spaces   <- region            (``region_<k>``)
* pages    <- nation (ancestor region), customer (ancestor nation, HTML content)
* comments <- orders (ancestor customer page, author = customer name, creation time)
* users    <- supplier          (persons keyed by name)
* teams    <- distinct documents.lang; channels <- distinct (lang, source)
* posts    <- documents (ancestor channel, title = first sentence) and
              conversations (turn 0 titled, later turns answer turn 0)
* terms    <- benchmark (content graph; title = first two words)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.text import first_sentence, iso_utc

BASE = "http://example.org/"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unified(df: DataFrame, **cols) -> DataFrame:
    out = []
    for f in V.UNIFIED_FIELDS:
        c = cols.get(f)
        out.append((c if c is not None else F.lit(None)).cast("string").alias(f))
    return df.select(*out)


def _key(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _link(kind: str, col) -> F.Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), F.col(col).cast("string"))


def customer_html(c: DataFrame) -> F.Column:
    """Small, fixed-size HTML body per customer: heading, one paragraph, one table."""
    td = lambda col: F.concat(F.lit("<td>"), F.col(col).cast("string"), F.lit("</td>"))
    return F.concat(
        F.lit("<h1>"), F.col("c_name"), F.lit("</h1><p>Segment "), F.col("c_mktsegment"), F.lit("</p>"),
        F.lit("<table><tr><th>custkey</th><th>name</th><th>nation</th><th>segment</th></tr><tr>"),
        td("c_custkey"), td("c_name"), td("c_nationkey"), td("c_mktsegment"),
        F.lit("</tr></table>"),
    )


def entity_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    region = load(spark, sf_dir, "region")
    nation = load(spark, sf_dir, "nation")
    customer = load(spark, sf_dir, "customer")
    orders = load(spark, sf_dir, "orders")
    supplier = load(spark, sf_dir, "supplier")
    documents = load(spark, sf_dir, "documents")
    conversations = load(spark, sf_dir, "conversations")

    spaces = _unified(region, _id=_key("region_", "r_regionkey"), name=F.col("r_name"),
                      link=_link("region", "r_regionkey"), type=F.lit("global"))
    nation_pages = _unified(nation, _id=_key("nation_", "n_nationkey"), title=F.col("n_name"),
                            link=_link("nation", "n_nationkey"), ancestor=_key("region_", "n_regionkey"),
                            type=F.lit("page"))
    customer_pages = _unified(customer, _id=_key("customer_", "c_custkey"), title=F.col("c_name"),
                              link=_link("customer", "c_custkey"), ancestor=_key("nation_", "c_nationkey"),
                              content=customer_html(customer), type=F.lit("page"))
    cust_names = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("_author"))
    order_comments = orders.join(cust_names, "o_custkey", "left")
    comments = _unified(order_comments, _id=_key("order_", "o_orderkey"),
                        title=F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
                        link=_link("order", "o_orderkey"), ancestor=_key("customer_", "o_custkey"),
                        author=F.col("_author"), content=F.col("o_orderpriority"),
                        creationTime=iso_utc(F.col("o_orderdate")), type=F.lit("comment"))
    users = _unified(supplier, _id=_key("supplier_", "s_suppkey"), name=F.col("s_name"),
                     email=F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@example.org")),
                     link=_link("supplier", "s_suppkey"))
    langs = documents.select("lang").distinct()
    teams = _unified(langs, _id=F.concat(F.lit("team_"), F.col("lang")), name=F.col("lang"),
                     link=F.concat(F.lit(f"{BASE}team/"), F.col("lang")))
    chans = documents.select("lang", "source").distinct()
    channels = _unified(chans, _id=F.concat(F.lit("channel_"), F.col("lang"), F.lit("_"), F.col("source")),
                        name=F.col("source"), ancestor=F.concat(F.lit("team_"), F.col("lang")),
                        link=F.concat(F.lit(f"{BASE}channel/"), F.col("lang"), F.lit("/"), F.col("source")))
    doc_posts = _unified(documents, _id=_key("doc_", "doc_id"), title=first_sentence(F.col("text")),
                         content=F.col("text"), link=_link("doc", "doc_id"),
                         ancestor=F.concat(F.lit("channel_"), F.col("lang"), F.lit("_"), F.col("source")),
                         type=F.lit("message"))
    conv_id = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    conv_posts = _unified(
        conversations, _id=conv_id,
        title=F.when(F.col("turn") == 0, first_sentence(F.col("text"))),
        content=F.col("text"), author=F.col("role"),
        link=F.concat(F.lit(f"{BASE}conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")),
        ancestor=F.when(F.col("turn") > 0, F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_0"))),
        type=F.lit("message"))
    return {
        "users": users,
        "spaces": spaces,
        "pages": nation_pages.unionByName(customer_pages),
        "comments": comments,
        "teams": teams,
        "channels": channels,
        "posts": doc_posts.unionByName(conv_posts),
    }


def term_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-graph terms: ``(s, title)``, the whole text of every benchmark item and the market segments."""
    b = load(spark, sf_dir, "benchmark").select(
        F.concat(F.lit(V.NS + "term_"), F.col("item_id").cast("string")).alias("s"), F.col("text").alias("title"))
    seg = load(spark, sf_dir, "customer").select(
        F.concat(F.lit(V.NS + "segment_"), F.lower("c_mktsegment")).alias("s"), F.col("c_mktsegment").alias("title")).distinct()
    return b.unionByName(seg)


def term_triples(terms: DataFrame) -> DataFrame:
    return terms.select("s", F.lit(V.TITLE).alias("p"), F.col("title").alias("o"),
                        F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"))


def searches_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of keyword searches derived from the data: one per benchmark item (its
    whole text) and one per nation (nation and region name)."""
    b = load(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")
    return b.unionByName(place_searches_frame(spark, sf_dir))


def place_searches_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per nation: nation and region name."""
    return load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"),
        F.concat_ws(" ", "n_name", "r_name").alias("text"))


def clause_searches_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches with structured clauses (SRH3), one per region: its name as text, the
    word prefix ``cust``, ``must`` = customer for one-word names, ``must_not`` = the
    customer number token equal to the region key, the name as a phrase for two-word names.
    Two more per region have clauses alone: the words of its name as ``must``, and its name
    as a phrase."""
    r = load(spark, sf_dir, "region")
    key9 = F.lpad(F.col("r_regionkey").cast("string"), 9, "0")
    none = F.array().cast("array<string>")
    only = lambda kind, must, phrase: r.select(
        F.concat(F.lit(kind), F.col("r_regionkey").cast("string")).alias("query_id"), F.lit("").alias("text"),
        none.alias("prefix"), must.alias("must"), none.alias("must_not"), phrase.alias("phrase"))
    null = F.lit(None).cast("string")
    clauses_only = only("m", F.split("r_name", " "), null).unionByName(only("p", none, F.col("r_name")))
    return clauses_only.unionByName(r.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("query_id"),
        F.col("r_name").alias("text"),
        F.array(F.lit("cust")).alias("prefix"),
        F.when(~F.col("r_name").contains(" "), F.array(F.lit("customer"))).otherwise(F.array().cast("array<string>")).alias("must"),
        F.array(key9).alias("must_not"),
        F.when(F.col("r_name").contains(" "), F.col("r_name")).alias("phrase"),
    ))
