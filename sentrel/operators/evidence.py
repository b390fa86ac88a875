"""Lexical evidence retrieval, template briefs and their fail-closed validation."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.normalize import brief_key, tokens

TOP, EXCERPT = 5, 600


class BriefProvider(Protocol):
    """Makes briefs (as ``template_briefs`` does) of pairs and their retrieved evidence; a model behind it runs where its caller says."""

    def __call__(self, pairs: DataFrame, evidence: DataFrame) -> DataFrame: ...


#: Different words of pairs that documents are filtered by, and blocks of documents a word is dealt to beyond.
KNOWN_WORDS, BLOCKS = 4096, 32

#: Fixed patterns: wording that no brief may hold.
UNSAFE = [r"\bcauses?\b", r"\bproves?\b", r"\bstop taking\b", r"\b(start|change) (a |your )?(dose|treatment)\b", r"\b(is|are) (safe|unsafe)\b"]


def retrieve(documents: DataFrame, pairs: DataFrame, limit: int = TOP) -> DataFrame:
    """drug, event, rank, document_id, relevance, excerpt: documents that share words with a pair.

    Relevance is the share of the pair's words. Words of documents meet words of pairs in one
    equi-join, so a pair is never held against every document. Up to KNOWN_WORDS different words of
    pairs go to the documents, which then hold no other words; beyond, the join is dealt by word and
    block of documents, so a word of every document lies in BLOCKS tasks. Documents have document_id,
    title, content; ties go to the smaller document_id.
    """
    queries = pairs.select("drug", "event").distinct().withColumn("words", tokens(F.concat_ws(" ", "drug", "event")))
    wanted = queries.select("drug", "event", F.size("words").alias("n"), F.explode("words").alias("word"))
    words = [r.word for r in wanted.select("word").distinct().limit(KNOWN_WORDS + 1).collect()]
    text = tokens(F.concat_ws(" ", "title", "content"))
    if len(words) <= KNOWN_WORDS:
        held = documents.select("document_id", F.explode(F.filter(text, lambda w: w.isin(words))).alias("word"))
        met = held.join(wanted, "word")
    else:
        held = documents.select("document_id", F.pmod(F.xxhash64("document_id"), F.lit(BLOCKS)).alias("block"), F.explode(text).alias("word"))
        met = held.join(wanted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")))), ["word", "block"])
    found = met.groupBy("drug", "event", "document_id").agg((F.count("*") / F.greatest(F.first("n"), F.lit(1))).alias("relevance"))
    place = Window.partitionBy("drug", "event").orderBy(F.desc("relevance"), "document_id")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)
    return best.join(documents.select("document_id", F.substring("content", 1, EXCERPT).alias("excerpt")), "document_id").select("drug", "event", "rank", "document_id", F.least("relevance", F.lit(1.0)).alias("relevance"), "excerpt")


def template_briefs(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """One brief a pair: drug, event, brief_key, status, headline, uncertainty, claims, evidence_ids.

    One claim per retrieved document; abstained without any.
    """
    cited = evidence.groupBy("drug", "event").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("e"))
    claims = F.transform("e", lambda d: F.struct(F.concat(F.lit("Document "), d["document_id"].cast("string"), F.lit(" is available for expert review.")).alias("text"), F.array(d["document_id"].cast("string")).alias("citation_ids")))
    some = F.col("e").isNotNull()
    none = F.array().cast("array<struct<text:string,citation_ids:array<string>>>")
    return pairs.select("drug", "event").distinct().join(cited, ["drug", "event"], "left").select(
        "drug", "event", brief_key(F.col("drug"), F.col("event")).alias("brief_key"), F.when(some, "generated").otherwise("abstained").alias("status"),
        F.when(some, F.concat(F.lit("Retrieved evidence for "), "drug", F.lit(" and "), "event")).otherwise("Evidence brief unavailable").alias("headline"), F.lit("Reports support review only; they do not establish causality or incidence.").alias("uncertainty"),
        F.coalesce(claims, none).alias("claims"), F.coalesce(F.transform("e", lambda d: d["document_id"].cast("string")), F.array().cast("array<string>")).alias("evidence_ids"),
    )


def violations(briefs: DataFrame) -> DataFrame:
    """``briefs`` with errors: why a brief can't stand (empty: it can)."""
    unknown = F.filter(F.transform("claims", lambda c, i: F.struct(i.alias("i"), F.array_sort(F.array_except(c["citation_ids"], F.col("evidence_ids"))).alias("ids"))), lambda u: F.size(u["ids"]) > 0)
    citing = F.transform(unknown, lambda u: F.concat(F.lit("claim "), u["i"].cast("string"), F.lit(" cites unavailable evidence: "), F.array_join(u["ids"], ", ")))
    text = F.concat_ws(" ", F.col("headline"), F.col("uncertainty"), F.array_join(F.transform("claims", lambda c: c["text"]), " "))
    unsafe = F.when(text.rlike("(?i)" + "|".join(UNSAFE)), F.array(F.lit("causal, safety or treatment language"))).otherwise(F.array().cast("array<string>"))
    errors = (
        F.when((F.col("status") == "abstained") & (F.size("claims") > 0), F.array(F.lit("abstained briefs cannot contain claims")))
        .when(F.col("status") == "abstained", F.array().cast("array<string>"))
        .when(F.size("evidence_ids") == 0, F.array(F.lit("no retrieved evidence")))
        .when(F.size("claims") == 0, F.array(F.lit("no claims")))
        .otherwise(F.concat(citing, unsafe))
    )
    return briefs.withColumn("errors", errors)


def fail_closed(briefs: DataFrame) -> DataFrame:
    """Briefs with errors turned into abstentions that give the joined reasons."""
    told = violations(briefs)
    bad = F.size("errors") > 0
    return told.withColumns({
        "abstention_reason": F.when(bad, F.array_join("errors", "; ")).when(F.col("status") == "abstained", "No relevant evidence was retrieved."),
        "status": F.when(bad, "abstained").otherwise(F.col("status")), "headline": F.when(bad, "Evidence brief unavailable").otherwise(F.col("headline")),
        "claims": F.when(bad, F.array().cast("array<struct<text:string,citation_ids:array<string>>>")).otherwise(F.col("claims")),
    })


def require_signals(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """The pairs, if every one is among the signals (whatever the case); else ValueError."""
    there = signals.select(F.upper("drug").alias("drug"), F.upper("event").alias("event")).distinct()
    missing = pairs.select(F.upper("drug").alias("drug"), F.upper("event").alias("event")).join(there, ["drug", "event"], "left_anti")
    if not missing.isEmpty():
        raise ValueError("a pair is not among the signals")
    return pairs
