"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bins, chat, cover_tree, exact_dedup, lattice, middle, packing, quality, simhash, sitetree, toxicity, training_order, warc
from trellis.llm.common import materialise
from trellis.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gumbel_topk_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.sample_segmentations(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(extra)))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.id_digests(packing.pack(docs, _tokenizer("byte_bpe_50k.json"), added_tokens=True))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op6_simhash_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialise(quality.text_stats(docs).drop("text"), "text-stats")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = quality.learn(stats.join(labels, "doc_id"))
    failed = quality.base_failed()
    return stats.select("doc_id", *quality.COUNTS, failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return training_order.sequence_digests(training_order.round_trip(docs, _tokenizer("byte_bpe_50k.json"), "epoch-0", added_tokens=True))


def op9_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_warc_split_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.payload_digests(warc.round_trip(_table(spark, sf_dir, "pages")))


def op11_middle_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.digests(middle.transform(middle.store(_table(spark, sf_dir, "documents"))))
    return made.select(F.expr("try_cast(key AS long)").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bins.assign(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_gumbel_topk_segmentations, op2_chat_prefix_targets, op3_hilbert_packing, op4_site_style_tree, op5_string_kernel_toxicity, op6_simhash_anchor_cover, op7_quality_decision_list,
        op8_feistel_shards, op9_chunk_recipes, op10_warc_split_reader, op11_middle_frames, op12_best_fit_shards, op13_cover_tree_negatives,
    )}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_PROBE = r"'\### Assistant: </turn> ok'"

ORACLE: dict[str, str] = {
    "op2_chat_prefix_targets": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_PROBE} UNION ALL SELECT -7, 1, 'assistant', {_PROBE}),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(length('### ') + length(role) + length(': ') + length(regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')) + length('-</turn>-')) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM o GROUP BY conv_id
""",
    "op9_chunk_recipes": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""",
    "op10_warc_split_reader": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT h, list_reduce(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', substr(sha1(h), i + 1, 1)) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM f)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS BIGINT) * CAST(pow(2, 4 - j) AS BIGINT)))::BIGINT, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h) JOIN b USING (h)
""",
    "op11_middle_frames": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(x, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
""",
    "op13_cover_tree_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 3
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
