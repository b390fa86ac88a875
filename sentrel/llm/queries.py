"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat_format, exact_dedup, language_id, license_scan, near_dedup, packing, quality, resampling, secret_scan, sentencepiece_codec, suffix_dedup

PIECE_MODEL = "piece_bpe_32k.model"


def byte_tokenizer() -> tuple[str, str, str]:
    """Files and pattern of the byte-level tokenizer that packing counts in."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(_read(spark, sf_dir, "labels")))
    return quality.score(docs, model)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(words=secret_scan.dictionary(docs)))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_read(spark, sf_dir, "conversations"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECE_MODEL)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(_read(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", F.size("ids").alias("n_pieces"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), byte_tokenizer())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(PIECE_MODEL))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=10, n=1, buckets=10_000, least_words=20, seed=2024)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_nearest": op2_nearest,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE: dict[str, str] = {
    "op4_chat_format": """
        WITH placed AS (
            SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos
            FROM conversations),
        prefix AS (
            SELECT conv_id, pos, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS seen,
                   max(pos) OVER (PARTITION BY conv_id) AS turns
            FROM placed),
        whole AS (SELECT seen, min(conv_id) AS conv_id, max(turns) AS turns, count(*) AS copies FROM prefix WHERE pos = turns GROUP BY seen),
        kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefix p WHERE p.pos < p.turns AND p.pos = whole.turns AND p.seen = whole.seen))
        SELECT conv_id, (pos - 1) // 64 AS part, max(turns) AS turns, max(copies) AS copies,
               string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
        FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, (pos - 1) // 64
    """,
    # crc32 of the UTF-8 bytes of every different word, by a table of 256 entries
    "op12_importance_resampling": r"""
        WITH step AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)),
        tab AS (SELECT list(v ORDER BY b) AS v FROM step),
        found AS (
            SELECT 's' AS side, row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
            UNION ALL
            SELECT 't', 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        used AS (SELECT side, n, unnest(ws) AS w FROM found),
        per AS (SELECT side, n, w, count(*) AS k FROM used GROUP BY ALL),
        hashed AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
                                      lambda c, x: xor(c >> 8, v[CAST((xor(c, x) & 255) + 1 AS INT)])), 4294967295) % 10000 AS b
            FROM (SELECT DISTINCT w FROM per), tab),
        counted AS (SELECT b, sum(CASE side WHEN 's' THEN k ELSE 0 END)::DOUBLE AS s, sum(CASE side WHEN 't' THEN k ELSE 0 END)::DOUBLE AS t FROM per JOIN hashed USING (w) GROUP BY b),
        gains AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS g FROM counted),
        weights AS (SELECT n, sum(k * g) AS weight FROM per JOIN hashed USING (w) JOIN gains USING (b) WHERE side = 's' GROUP BY n),
        scored AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
            FROM found LEFT JOIN weights USING (n) WHERE side = 's'),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS total FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= total * 10 // 100 THEN place END AS rank FROM placed
    """,
    # positions in hexadecimal digits, two a byte; a span ends where the next removed string does not touch it
    "op13_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        blocks AS (SELECT r, doc_id, 400 * k AS base, substr(h, 800 * k + 1, 800 + 98) AS block FROM (SELECT *, unnest(range((n + 399) // 400)) AS k FROM d)),
        w AS (SELECT r, doc_id, base + q AS p, substr(block, 2 * q + 1, 100) AS s FROM (SELECT *, unnest(range(greatest(octet_length(encode(block)) // 2 - 49, 0))) AS q FROM blocks)),
        g AS (SELECT r, p FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE least < doc_id),
        e AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM g),
        spans AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS k FROM e) GROUP BY r, k),
        between_spans AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS c FROM spans),
        left_over AS (
            SELECT r, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM between_spans JOIN d USING (r) GROUP BY r)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN left_over USING (r)
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
