"""Checks of structure between a source and what was made of it. All are columns over pairs(pair_id, before, after)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NUMBER = r"\d+(?:\.\d+)?"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def bold_labels(text: Column) -> Column:
    """Labels in bold at the beginning of lines, in order."""
    return _found(text, r"(?m)^\s*(?:[-*+]\s+)?\*\*([^*\n]+)\*\*", 1)


def structure_changes(pairs: DataFrame) -> DataFrame:
    """Headings and bold labels that went, numbers that came, and those of them that no two numbers of the source give."""
    numbers = lambda c: F.transform(_found(F.col(c), NUMBER), lambda x: x.cast("double"))
    base = pairs.select(
        "pair_id",
        T.headings(F.coalesce("before", F.lit(""))).alias("hb"),
        T.headings(F.coalesce("after", F.lit(""))).alias("ha"),
        bold_labels(F.col("before")).alias("lb"),
        bold_labels(F.col("after")).alias("la"),
        F.array_distinct(numbers("before")).alias("nb"),
        F.array_distinct(numbers("after")).alias("na"),
    )
    fresh = F.array_except("na", "nb")
    return base.select(
        "pair_id",
        F.size("hb").alias("headings_before"),
        F.size("ha").alias("headings_after"),
        F.when(F.size("ha") == F.size("hb"), "same").when(F.size("ha") > F.size("hb"), "split").otherwise("merged").alias("heading_state"),
        F.array_except("lb", "la").alias("labels_lost"),
        fresh.alias("numbers_new"),
        F.filter(fresh, lambda x: ~T.derivable(F.col("nb"), x)).alias("numbers_made_up"),
    )


def pattern_checks(texts: DataFrame, checks: DataFrame) -> DataFrame:
    """texts(case_id, text) and checks(case_id, kind: must/never, pattern) -> whether each check holds."""
    found = F.regexp_like(F.coalesce("text", F.lit("")), F.col("pattern"))
    return checks.join(texts, "case_id", "left").select("case_id", "kind", "pattern", F.when(F.col("kind") == "must", found).otherwise(~found).alias("holds"))


def pattern_hits(sentences: DataFrame, pattern: str) -> DataFrame:
    """Hits of a pattern by document, and the sentences that have one."""
    n = T.count(F.col("text"), pattern)
    return sentences.groupBy("doc_id").agg(F.sum(n).alias("hits"), F.count_if(n > 0).alias("sentences_hit"))


def source_changes(watched: DataFrame) -> DataFrame:
    """watched(source_id, reviewed, head, error, and if it likes enabled): the state of each watched source."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("head").isNull(), "gone").when(F.col("reviewed").isNull(), "new").when(F.col("reviewed") == F.col("head"), "unchanged").otherwise("changed")
    if "enabled" in watched.columns:
        state = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").otherwise(state)
    return watched.select("source_id", state.alias("state"))


def change_counts(changes: DataFrame) -> DataFrame:
    """How many sources are in each state."""
    return changes.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def watched_files(files: DataFrame) -> DataFrame:
    """files(source_id, filename, previous_filename, patterns): those that touch what is watched, by their name or the one they had before."""
    return files.filter(T.touches(F.col("filename"), F.col("previous_filename"), F.col("patterns")))
