"""Registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, codes, dialogues, html, language, mixing, neighbours, quality, secrets, sharding, simhash, twins, vectors, warc
from .common import table


def op1_quality_rules(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_rules(documents, table(spark, sf_dir, "labels"))
    return quality.quality_rules(documents.select("doc_id", "text"), model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op2_html(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op3_sharding(spark, sf_dir):
    held = sharding.records(table(spark, sf_dir, "documents"))
    slot_map = sharding.SlotMap(spark).create(sharding.slot_bytes(held))
    return sharding.shard_documents(held, slot_map).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark, sf_dir):
    return simhash.with_hex(simhash.simhash_components(table(spark, sf_dir, "documents")))


def op8_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.train_language(documents))


def op9_mixing(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_codes(spark, sf_dir):
    found, codebooks = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def op12_dialogues(spark, sf_dir):
    return dialogues.digests(dialogues.repair(dialogues.damage(table(spark, sf_dir, "conversations"))))


def op13_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_html, op3_sharding, op4_bpe, op5_neighbours, op6_warc, op7_simhash, op8_language, op9_mixing, op10_secrets, op11_codes, op12_dialogues, op13_vectors, pipeline)}
ORACLES: dict[str, str] = {
    "op11_codes": twins.CODES,
    "op12_dialogues": twins.DIALOGUES,
    "op13_vectors": twins.VECTORS,
    "op9_mixing": r"""
WITH m AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  substr(md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), ''), CASE WHEN doc_id IS NULL THEN text END)), 1, 9) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS reach FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level FROM r
  WINDOW e AS (ORDER BY reach, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT level FROM l WHERE level <= reach ORDER BY reach, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce((SELECT level FROM c) * weight, cap)) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
u AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM (SELECT source, h, sum(size) AS n FROM m GROUP BY source, h)),
f AS (SELECT p.source, min(u.h) AS h FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE u.upto > p.target - p.whole * p.source_size GROUP BY p.source),
b AS (SELECT p.*, f.h AS last, 2 * (p.target - p.whole * p.source_size - (u.upto - u.n)) >= u.n AS with_last FROM p
  LEFT JOIN f ON f.source IS NOT DISTINCT FROM p.source LEFT JOIN u ON u.source IS NOT DISTINCT FROM p.source AND u.h = f.h)
SELECT m.doc_id, m.size, b.source_size, b.target, CAST(m.size * (b.whole + CASE WHEN b.last IS NULL OR m.h < b.last OR (m.h = b.last AND b.with_last) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.source
""",
    "op6_warc": """
WITH body AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
digest AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM body),
grouped AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM digest),
judged AS (SELECT *, payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS again FROM grouped)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM judged
""",
}
