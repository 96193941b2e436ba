"""Validation of corpus ledgers: constraints as queries that return what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE, SHA = r"^\d{4}-\d{2}-\d{2}$", "^[0-9a-f]{64}$"


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that are true, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in checks]))


def source_problems(sources: DataFrame) -> DataFrame:
    """sources(id, status, raw_sha256, license, retrieved) -> id, problem."""
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    found = reasons(
        (blank("id"), "no id"),
        (~F.col("status").isin("candidate", "adopted", "rejected"), "unknown status"),
        ((F.col("status") == "adopted") & ~F.coalesce(F.col("raw_sha256").rlike(SHA), F.lit(False)), "no digest"),
        ((F.col("status") == "adopted") & blank("license"), "no license"),
        (~valid_date(F.col("retrieved")), "bad date"),
    )
    again = sources.groupBy("id").count().filter("count > 1").select("id", F.lit("id occurs again").alias("problem"))
    return sources.select("id", F.explode(found).alias("problem")).unionByName(again)


def excerpt_problems(excerpts: DataFrame, sources: DataFrame) -> DataFrame:
    """excerpts(id, source_id, status, split, text, text_sha256, preserve) against sources -> id, problem."""
    known = sources.select(F.col("id").alias("source_id"), F.col("status").alias("source_status"))
    rows = excerpts.join(known, "source_id", "left")
    text = F.coalesce("text", F.lit(""))
    found = reasons(
        (F.col("source_status").isNull(), "unknown source"),
        ((F.col("status") == "adopted") & (F.coalesce("source_status", F.lit("")) != "adopted"), "source not adopted"),
        (F.coalesce("text_sha256", F.lit("")) != F.sha2(text, 256), "digest differs"),
        (~F.coalesce(F.col("split").isin("tuning", "final"), F.lit(False)), "unknown split"),
        (F.exists(F.coalesce("preserve", F.array().cast("array<string>")), lambda p: ~F.contains(text, p)), "preserved passage not in text"),
    )
    return rows.select("id", F.explode(found).alias("problem"))


def broken_chains(steps: DataFrame) -> DataFrame:
    """steps(excerpt_id, step, input_sha256, output_sha256): steps whose input isn't the output of the one before."""
    before = F.lag("output_sha256").over(Window.partitionBy("excerpt_id").orderBy("step"))
    return steps.withColumn("before", before).filter("before is not null and not (input_sha256 <=> before)").select("excerpt_id", "step")


def split_leaks(excerpts: DataFrame) -> DataFrame:
    """Lineages and texts that occur in more than one split."""
    keys = F.array(F.struct(F.lit("lineage").alias("by"), F.col("lineage_id").alias("value")), F.struct(F.lit("text").alias("by"), F.col("text_sha256").alias("value")))
    rows = excerpts.select("split", F.inline(keys)).filter("value is not null")
    return rows.groupBy("by", "value").agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def ledger_counts(excerpts: DataFrame) -> DataFrame:
    """Excerpts by group, split, source and role, and how many are adopted."""
    return excerpts.groupBy("group", "split", "source_id", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "adopted").alias("adopted"))


def constraint_report(checks: dict[str, DataFrame]) -> DataFrame:
    """How many rows break each named constraint."""
    parts = [df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("check"), "broken") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
