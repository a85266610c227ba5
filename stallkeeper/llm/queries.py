"""Registered queries of the operators and the corpus pipeline, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, fracsketch, media, mixing, packing, periodic, simhash, spelling, subword, token_counts
from .common import new_folder, table
from .compaction import ShardStore
from .exact import DedupStore

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Shares of the expected tokens by domain (language and quality); domains left out get none.
WEIGHTS = {"en 1": 0.5, "de 1": 0.15, "fr 1": 0.15, "es 1": 0.15, "en 0": 0.02, "de 0": 0.01, "fr 0": 0.01, "es 0": 0.01}
#: A document is kept from this score on.
QUALITY = 0.3


def crc_fold(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def quality_model(spark: SparkSession, sf_dir: str) -> subword.SubwordModel:
    """Trained on labels outside the held-out fold only."""
    labels = table(spark, sf_dir, "labels").filter(crc_fold() != 0).select("doc_id", "quality")
    sample = subword.labelled_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, 4000)
    return subword.fit(sample, F.col("quality"), epochs=4, rate=1.0)


def domain_model(spark: SparkSession, sf_dir: str, asked: str = "quality is not null") -> subword.SubwordModel:
    """Classifier of language and quality, from the labelled rows that ``asked`` leaves."""
    labels = table(spark, sf_dir, "labels").filter(asked).select("doc_id", "quality")
    sample = subword.labelled_sample(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), labels, 3000)
    return mixing.domain_model(sample, F.concat("lang", F.lit(" "), F.col("quality").cast("string")), rate=1.0)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = domain_model(spark, sf_dir)
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"), model, WEIGHTS)
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    return mixed.select("doc_id", "n_tokens", F.get(F.array(*[F.lit(c) for c in model.classes]), best - 1).alias("domain"), "posteriors", "rate")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fracsketch.sketch_report(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), fracsketch.as_text(F.col("own")).alias("fingerprint"),
                       fracsketch.as_text(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_id_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bestfit.write_matrices(bestfit.id_matrices(table(spark, sf_dir, "documents"), BYTE_BPE))
    return rows.select("matrix_row", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "position_resets", "doc_ids", "doc_starts")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role IS NOT NULL),
b AS (SELECT r.conv_id, w.perspective, r.turn, CASE WHEN r.role = w.perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN r.role = w.perspective THEN NULL ELSE coalesce(r.role, 'unknown') END AS name,
  CASE WHEN r.role = w.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || coalesce(r.role, 'unknown') || '|>' || chr(10) END AS head, r.text
  FROM r JOIN w ON r.conv_id IS NOT DISTINCT FROM w.conv_id),
c AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM b),
d AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name NULLS FIRST, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end" FROM c)
SELECT conv_id, perspective, turn, role, name, rendered, CAST("end" - length(rendered) AS BIGINT) AS start, "end",
  CASE WHEN role = 'assistant' THEN CAST("end" - length(rendered) + length(head) AS BIGINT) ELSE "end" END AS mask_start, "end" AS mask_end FROM d
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subword.scored(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), 1)
    return rows.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= QUALITY, 1).otherwise(0).alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals appended and compacted; every document with the live shard that holds it, read back from there."""
    store = ShardStore(spark, new_folder(spark, "shards"), target=64 << 20)
    docs = table(spark, sf_dir, "documents")
    for k in range(4):
        store.append(docs.filter(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.lit(0)) == k))
        store.compact()
    store.vacuum(0)  # nobody else uses this store
    return store.rows().select("row.doc_id", F.concat_ws("/", "run", "shard").alias("shard"), F.sha2(F.encode("row.text", "UTF-8"), 256).alias("text_sha256"),
                               "row.lang", "row.source", "row.n_chars")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least six letters and five occurrences, their usual spelling and the last one of it."""
    return spelling.spelling_forms(spelling.word_counts(table(spark, sf_dir, "documents")).filter("n >= 5"))


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents; in one of ten, told by the id's crc32, the words from some place on repeat the few that come first there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("words"), place(i)))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("b.less")
    return rows.select("doc_id", "n_runs", "b.start", length.alias("length"), "b.period", F.floor(1000 * length / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals added to a store; every document with the row of its text that stays."""
    store, docs = DedupStore(spark, new_folder(spark, "dedup")), table(spark, sf_dir, "documents")
    for k in range(3):
        store.add(docs.filter(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0)) == k))
    return store.report().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS norm FROM d),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept FROM k)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w
"""


def queries() -> dict:
    every = (op1_mixing, op2_packing, op3_token_counts, op4_fingerprints, op5_id_matrices, op6_media, op7_chat, op8_simhash, op9_quality, op10_sharding,
             op11_spelling, op12_runs, op13_exact_dedup)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL, "op13_exact_dedup": OP13_SQL}
