"""Landed API responses derived from the driver tables (input of SRC1-SRC3).

Items are rendered with ``to_json(struct(...))`` and grouped into response pages of
at most ``PAGE`` items keyed by (parent, item key div PAGE), so no page grows with
the data. Shapes follow FIXTURES.md A1/A2:

* spaces   <- nation   (``{"results":[...]}``; id is replaced by the home page tail)
* pages    <- customer, plus one home page per nation (listed under the space key)
* comments <- orders   (listed under their customer page)
* users    <- supplier (members of two groups each; only some have a personal space)
* teams    <- region   (bare objects, one request per team)
* channels <- nation   (``{"value":[...]}`` under their team)
* posts    <- conversations (``{"value":[...]}`` under the conversation)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import first_sentence, iso_utc
from trellis.plans.fixtures import load
from trellis.sources.landed import parse_bodies

PAGE = 100
SNAPSHOT = "2024-03-05"


def _s(c):
    return F.col(c).cast("string")


def _pages(items: DataFrame, label: str, request: F.Column, parent: F.Column, seq: F.Column, wrapper: str) -> DataFrame:
    """Group item JSON into response bodies of at most PAGE items per (request, page)."""
    d = items.select(request.alias("request_id"), parent.alias("parent_key"),
                     F.floor(seq / PAGE).cast("int").alias("page_no"), seq.alias("_seq"), F.col("_j"))
    g = d.groupBy("request_id", "parent_key", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("_seq", "_j"))).alias("_items"))
    joined = F.array_join(F.transform("_items", lambda x: x["_j"]), ",")
    if wrapper == "results":
        body = F.concat(F.lit('{"results":['), joined, F.lit('],"_links":{"base":"https://wiki.example.org"}}'))
    else:
        body = F.concat(F.lit('{"value":['), joined, F.lit('],"@odata.nextLink":null}'))
    return g.select(F.lit(SNAPSHOT).cast("date").alias("snapshot_date"), F.lit(label).alias("label"),
                    "request_id", "parent_key", "page_no", F.lit(True).alias("ok"), body.alias("body"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_bodies(responses(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed responses, bodies not parsed."""
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    customer = load(spark, sf_dir, "customer")
    orders = load(spark, sf_dir, "orders")
    supplier = load(spark, sf_dir, "supplier")
    conv = load(spark, sf_dir, "conversations")

    spaces = nation.select(F.col("n_nationkey").alias("_k"), F.to_json(F.struct(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("N"), _s("n_nationkey")).alias("key"),
        F.col("n_name").alias("name"),
        F.struct(F.concat(F.lit("/rest/api/content/home"), _s("n_nationkey")).alias("homepage")).alias("_expandable"),
        F.struct(F.concat(F.lit("/spaces/N"), _s("n_nationkey")).alias("webui")).alias("_links"),
    )).alias("_j"))
    out = _pages(spaces, "spaces", F.lit("spaces"), F.lit(None).cast("string"), F.col("_k"), "results")

    n_comments = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"))
    cust = customer.join(n_comments, customer["c_custkey"] == n_comments["o_custkey"], "left")
    cust_pages = cust.select(F.col("c_nationkey").alias("_nk"), F.col("c_custkey").alias("_k"), F.to_json(F.struct(
        F.concat(F.lit("c"), _s("c_custkey")).alias("id"), F.lit("page").alias("type"), F.col("c_name").alias("title"),
        F.array(F.struct(F.concat(F.lit("home"), _s("c_nationkey")).alias("id"))).alias("ancestors"),
        F.struct(F.struct(F.concat(F.lit("<p>"), F.col("c_mktsegment"), F.lit("</p>")).alias("value")).alias("view")).alias("body"),
        F.when(F.col("_n").isNotNull(), F.struct(F.struct(F.col("_n").alias("size")).alias("comment"))).alias("children"),
        F.struct(F.struct(F.col("c_name").alias("displayName")).alias("createdBy")).alias("history"),
        F.struct(F.concat(F.lit("/pages/c"), _s("c_custkey")).alias("webui")).alias("_links"),
    )).alias("_j"))
    home_pages = nation.select(F.col("n_nationkey").alias("_nk"), F.lit(-1).cast("bigint").alias("_k"), F.to_json(F.struct(
        F.concat(F.lit("home"), _s("n_nationkey")).alias("id"), F.lit("page").alias("type"),
        F.concat(F.col("n_name"), F.lit(" home")).alias("title"),
        F.array().cast("array<struct<id:string>>").alias("ancestors"),
        F.struct(F.concat(F.lit("/pages/home"), _s("n_nationkey")).alias("webui")).alias("_links"),
    )).alias("_j"))
    pg = cust_pages.unionByName(home_pages)
    out = out.unionByName(_pages(pg, "pages", F.concat(F.lit("pages:N"), _s("_nk")), F.concat(F.lit("N"), _s("_nk")),
                                 F.col("_k"), "results"))

    oc = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    comments = oc.select("o_custkey", F.col("o_orderkey").alias("_k"), F.to_json(F.struct(
        F.concat(F.lit("o"), _s("o_orderkey")).alias("id"), F.lit("comment").alias("type"),
        F.concat(F.lit("Re: Order "), _s("o_orderkey")).alias("title"),
        F.struct(F.struct(F.concat(F.lit("<p>"), F.col("o_orderpriority"), F.lit("</p>")).alias("value")).alias("view")).alias("body"),
        F.struct(F.struct(F.col("c_name").alias("displayName")).alias("createdBy"),
                 iso_utc(F.col("o_orderdate")).alias("createdDate")).alias("history"),
        F.struct(F.concat(F.lit("/comments/o"), _s("o_orderkey")).alias("webui")).alias("_links"),
    )).alias("_j"))
    out = out.unionByName(_pages(comments, "comments", F.concat(F.lit("comments:c"), _s("o_custkey")),
                                 F.concat(F.lit("c"), _s("o_custkey")), F.col("_k"), "results"))

    member = F.to_json(F.struct(
        F.col("s_name").alias("displayName"),
        F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@example.org")).alias("email"),
        F.when(F.col("s_acctbal") >= 0, F.struct(F.struct(F.concat(F.lit("/~s"), _s("s_suppkey")).alias("webui")).alias("_links")))
        .alias("personalSpace"),
    )).alias("_j")
    by_nation = supplier.select(F.col("s_nationkey").alias("_g"), F.col("s_suppkey").alias("_k"), member)
    everyone = supplier.select(F.lit(-1).alias("_g"), F.col("s_suppkey").alias("_k"), member)
    users = by_nation.unionByName(everyone)
    out = out.unionByName(_pages(users, "users", F.concat(F.lit("members:g"), _s("_g")), _s("_g"), F.col("_k"), "results"))

    teams = region.select(
        F.lit(SNAPSHOT).cast("date").alias("snapshot_date"), F.lit("teams").alias("label"),
        F.concat(F.lit("team:t"), _s("r_regionkey")).alias("request_id"), F.lit(None).cast("string").alias("parent_key"),
        F.lit(0).alias("page_no"), F.lit(True).alias("ok"),
        F.to_json(F.struct(
            F.concat(F.lit("t"), _s("r_regionkey")).alias("id"), F.col("r_name").alias("displayName"),
            F.concat(F.lit("Team "), F.col("r_name")).alias("description"),
            F.concat(F.lit("https://teams.example.org/t"), _s("r_regionkey")).alias("webUrl"),
        )).alias("body"))
    out = out.unionByName(teams)

    channels = nation.select("n_regionkey", F.col("n_nationkey").alias("_k"), F.to_json(F.struct(
        F.concat(F.lit("ch"), _s("n_nationkey")).alias("id"), F.col("n_name").alias("displayName"),
        F.concat(F.lit("Channel "), F.col("n_name")).alias("description"),
        F.concat(F.lower("n_name"), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("https://teams.example.org/ch"), _s("n_nationkey")).alias("webUrl"),
    )).alias("_j"))
    out = out.unionByName(_pages(channels, "channels", F.concat(F.lit("channels:t"), _s("n_regionkey")),
                                 F.concat(F.lit("t"), _s("n_regionkey")), F.col("_k"), "value"))

    posts = conv.select("conv_id", F.col("turn").alias("_k"), F.to_json(F.struct(
        F.concat(F.lit("m"), _s("conv_id"), F.lit("_"), _s("turn")).alias("id"),
        F.when(F.length("text") > 0, F.lit("message")).otherwise(F.lit("systemEventMessage")).alias("messageType"),
        F.when(F.col("turn") == 0, first_sentence(F.col("text"))).alias("subject"),
        F.struct(F.col("text").alias("content")).alias("body"),
        F.struct(F.struct(F.col("role").alias("displayName")).alias("user")).alias("from"),
        F.concat(F.lit("https://teams.example.org/m"), _s("conv_id"), F.lit("_"), _s("turn")).alias("webUrl"),
        F.struct(F.concat(F.lit("conv"), _s("conv_id")).alias("channelId")).alias("channelIdentity"),
    )).alias("_j"))
    out = out.unionByName(_pages(posts, "posts", F.concat(F.lit("posts:conv"), _s("conv_id")),
                                 F.concat(F.lit("conv"), _s("conv_id")), F.col("_k"), "value"))
    return out
