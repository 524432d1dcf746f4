"""The opN queries: thin forms of the operators over the whole documents table, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from . import common, licenses, mixing, packing, paragraphs, passages, quality, repetition, sharding, simhash, sketches, token_store


def op1_mix(spark, sf_dir):
    d = mixing.schedule(common.documents(spark, sf_dir))
    return d.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark, sf_dir):
    d = simhash.classes(common.documents(spark, sf_dir))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_store(spark, sf_dir, tokenizer=None, end_id=1):
    folder = common.table_path(spark, "token_store")
    token_store.write_store(common.documents(spark, sf_dir), folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id)

    def digested(batches):
        for b in batches:
            crc = [token_store.crc32_of(x.as_py()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, pa.int64()), b.column("verified")], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    d = token_store.read_store(spark, folder)
    return d.mapInArrow(digested, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long, verified boolean")


def op4_repeated_paragraphs(spark, sf_dir):
    """Repeated lines, and passages of 51 words or more; a passage's cluster has 16 digits, a line's 32."""
    columns = ("doc_id", "paragraph", "n_words", "cluster", "copies", "kept", "first_doc_id")
    docs = common.documents(spark, sf_dir)
    found = common.settled(spark, "passages", lambda: passages.repeated(docs))
    return paragraphs.repeated(docs).select(*columns).union(found.withColumn("cluster", F.lower(F.lpad(F.hex("cluster"), 16, "0"))).select(*columns))


def not_held_out(labels):
    """Labelled rows that may be learnt from: crc32 of the doc_id's text modulo 3 isn't 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op5_quality(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = quality.learn(docs, not_held_out(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return quality.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_fingerprints(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = sketches.with_next(docs.withColumn("sketch", sketches.sketch(F.col("text"))), ["doc_id", "text", "sketch"])
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    d = d.withColumn("edited", sketches.edited(F.col("text"), F.col("n_chars"), F.col("next.text")))
    d = d.withColumn("edited_sketch", sketches.sketch(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketches.as_string(F.col("sketch")).alias("fingerprint"), sketches.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next.sketch")).alias("near_next"))


def op7_licenses(spark, sf_dir):
    return licenses.scan(common.documents(spark, sf_dir))


def op8_packing(spark, sf_dir, tokenizer=None):
    return packing.packed_documents(common.documents(spark, sf_dir), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op9_repetition(spark, sf_dir):
    return repetition.verdicts(common.documents(spark, sf_dir))


def op10_sharding(spark, sf_dir):
    d = sharding.shard(common.documents(spark, sf_dir))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
capped AS (
  SELECT source, source_size, rank, (rank % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap,
         (SELECT sum(source_size) FROM totals)::DOUBLE AS total FROM ranked),
shares AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM capped),
level AS (
  SELECT share AS level FROM shares WHERE share * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target FROM shares, level),
queued AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal, row_number() OVER () AS id,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT id, source, size, target, goal, begun + e.range * source_size AS a FROM queued, range(3) e),
cut AS (
  SELECT *, a + size AS b, least(greatest(a, goal), a + size) AS c FROM copies),
fragments AS (
  SELECT id, source, a AS word, c - a AS words, c / target AS finish FROM cut WHERE c > a UNION ALL
  SELECT id, source, c, b - c, b / target FROM cut WHERE b > c),
finished AS (
  SELECT id, words, coalesce(sum(words) OVER (ORDER BY finish, source NULLS LAST, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM fragments),
served AS (
  SELECT id, sum(greatest(0, least(words, (SELECT sum(source_size) FROM totals) - ahead)))::BIGINT AS taken FROM finished GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN served USING (id)
"""



def _op7_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = f"translate(coalesce(text, ''), '{common.ASCII_UPPER}', '{common.ASCII_LOWER}')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    starts = []
    for label, p in licenses.PHRASES.items():
        hit = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        starts.append(f"list_filter(range(len(w)), lambda i: {hit}) AS \"p_{label}\"")
    names = [f'"p_{x}"' for x in licenses.PHRASES]
    labels = ", ".join(f"CASE WHEN len({n}) > 0 THEN '{x}' END" for n, x in zip(names, licenses.PHRASES))
    hits = []
    for t in licenses.parsed():
        tokens, n = quoted(t["tokens"]), len(t["tokens"])
        held = f"list_intersect({tokens}, w[s + 1:s + {t['length']}])"
        must = f"len(list_intersect({quoted(t['must'])}, w[s + 1:s + {t['length']}])) = {len(t['must'])}"
        hits.append(f"""SELECT doc_id, '{t['label']}' AS label, list_max(list_transform(list_filter(range(len(w)), lambda s: list_contains({tokens}, w[s + 1])),
    lambda s: CASE WHEN {must} THEN len({held}) ELSE 0 END)) / {n}.0 AS score FROM words WHERE len(list_intersect({tokens}, w)) >= {t['need']}""")
    return f"""
WITH d AS (SELECT doc_id, {lowered} AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
base AS (SELECT doc_id, w, {', '.join(starts)} FROM words),
places AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat({', '.join(names)}) AS spots,
                  list_filter([{labels}], lambda x: x IS NOT NULL) AS bl FROM base),
hits AS (SELECT doc_id, list(DISTINCT label) AS ml, max(score) AS best FROM ({' UNION ALL '.join(hits)}) WHERE score >= {licenses.CONTAINMENT} GROUP BY doc_id)
SELECT p.doc_id, n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
       array_to_string(list_sort(bl), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ml, [])))), ',') AS labels,
       CASE WHEN len(bl) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM places p LEFT JOIN hits h ON p.doc_id = h.doc_id
"""


def queries():
    return {f.__name__: f for f in (
        op1_mix, op2_simhash, op3_token_store, op4_repeated_paragraphs, op5_quality, op6_fingerprints, op7_licenses, op8_packing, op9_repetition, op10_sharding)}


def oracle_sql():
    return {"op1_mix": OP1_SQL, "op7_licenses": _op7_sql()}
