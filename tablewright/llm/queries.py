"""The registered queries of this package: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import ann, bestfit, chat, decontaminate, langid, maintext, quality, simhash, spelling, tokenout, toxicity, upsert, urlfilter
from tablewright.llm.common import crc_of_id, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), lambda id_: id_ % 100 == 0, k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    model = toxicity.train(docs.filter(~held_out), _table(spark, sf_dir, "labels"))
    made = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(docs, model).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.packed_sequences(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.formatted(rows.unionByName(probe)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    made = docs.select("doc_id", held_out.alias("held_out"), langid.predicted(docs, model).alias("p"))
    return made.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    made = quality.scored(docs.select("doc_id", "text", "source", "lang", "n_chars"), model, "q")
    score = F.col("q.score")
    return made.select(
        "doc_id",
        F.col("q.content").alias("content_score"),
        F.col("q.metadata").alias("metadata_score"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        (score >= quality.KEEP_AT).alias("keep"),
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = urlfilter.judged(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return made.select("page_id", "host", "path", "rule", "verdict", "probability")


def op11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = _table(spark, sf_dir, "clients"), _table(spark, sf_dir, "client_changes")
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    folder, most = f"{shared_folder(spark)}/clients-{uuid.uuid4().hex}", upsert.file_rows(clients.count())
    upsert.write_table(clients.filter(crc(F.col("client_id")) % 7 > 3), "client_id", folder, most)

    def decide(first):
        h = crc(first) % 16
        return h <= 7, F.coalesce(F.col("op") == "D", F.lit(False)) | (crc(F.col("change_id")) % 8 < h)

    stayed = upsert.upsert(spark, folder, clients.schema, "client_id", changes, ["seq", "change_id"], ["source", "segment", "city", "balance"], decide, most)
    return upsert.report(spark, folder, clients.schema, stayed)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = pages.select("page_id", "url", maintext.extracted(pages, maintext.train()).alias("text"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


_ALL = (
    op1_ann,
    op2_toxicity,
    op3_packed_ids,
    op4_simhash,
    op5_best_fit,
    op6_chat,
    op7_language,
    op8_decontamination,
    op9_quality,
    op10_urls,
    op11_upsert,
    op12_main_text,
    op13_spelling,
)


def packing_search_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on op5_best_fit: sequences before and after its search, and the least possible."""
    return bestfit.search_gain(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (*_ALL, packing_search_gain)}


_OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(body + length(role) + 24) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id
"""

_OP8_SQL = r"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM it WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT doc_id, dw.size, k, item FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against plain Python in tests/llm."""
    return {"op6_chat": _OP6_SQL, "op8_decontamination": _OP8_SQL}
