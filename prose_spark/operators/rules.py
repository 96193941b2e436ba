"""Rule-based notation checks over a corpus: documents x rule table x profile x glossary -> findings and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import notation
from ..functions.arrow import pieces

_FINDING = pa.struct(
    [("rule_id", pa.string()), ("category", pa.string()), ("offset", pa.int32()), ("length", pa.int32()), ("line", pa.int32()), ("column", pa.int32()), ("text", pa.string()),
     ("candidates", pa.list_(pa.string())), ("reason_code", pa.string()), ("count", pa.int32())]
)
SCHEMA = "doc_id long, rule_id string, category string, offset int, length int, line int, column int, text string, candidates array<string>, reason_code string, count int"


def check_documents(documents: DataFrame, rules: list[dict] | None = None, profile: str = "general-tech", markdown: bool = True, protected: tuple[str, ...] = (), use: tuple[str, ...] = ()) -> DataFrame:
    """documents(doc_id, text) -> a row per finding. Rules, a table of bounded size, travel with the task."""
    if profile not in notation.PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    table = notation.RuleTable(rules if rules is not None else notation.seed_rules())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [notation.check(t or "", table, profile, markdown, protected, use) for t in batch.column("text").to_pylist()]
            lists = pa.array(found, pa.list_(_FINDING))
            ids = pa.array([d for d, f in zip(batch.column("doc_id").to_pylist(), found) for _ in f], pa.int64())
            flat = lists.flatten()
            yield pa.RecordBatch.from_arrays([ids, *flat.flatten()], ["doc_id", *[f.name for f in _FINDING]])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def category_counts(findings: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Findings of each category by document, zero-filled; with documents(doc_id), those without a finding too."""
    counts = findings.groupBy("doc_id").pivot("category", list(notation.CATEGORIES)).count()
    if documents is not None:
        counts = documents.select("doc_id").join(counts, "doc_id", "left")
    return counts.na.fill(0)


def run_status(findings: DataFrame, documents: DataFrame, fail_on: str = "error") -> DataFrame:
    """Whether each document fails at a level: that category or a heavier one among the flagged."""
    heavy = notation.CATEGORIES[: notation.CATEGORIES.index(fail_on) + 1]
    bad = findings.filter(F.col("category").isin(*heavy)).select("doc_id").distinct().withColumn("failed", F.lit(True))
    return documents.select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.coalesce("failed", F.lit(False)).alias("failed"))


def coverage(rules: list[dict], profile: str) -> list[tuple[str, str, str]]:
    """(id, title, category under the profile) of the rules that a check applies."""
    return [(r["id"], r["title"], r["profiles"][profile]) for r in rules]


def rule_problems(rules: list[dict]) -> list[str]:
    """What is wrong with a rule table: ids, enumerations, patterns, and examples that don't give what they say."""
    out = []
    ids = [r.get("id") for r in rules]
    out += [f"{i}: id occurs again" for i in {i for i in ids if ids.count(i) > 1}]
    for r in rules:
        name = r.get("id") or "?"
        if r.get("kind") not in ("patterns", "outside", "forms", "consistency"):
            out.append(f"{name}: unknown kind")
            continue
        if set(r.get("profiles", ())) != set(notation.PROFILES) or not set(r["profiles"].values()) <= set(notation.CATEGORIES):
            out.append(f"{name}: profiles must map {', '.join(notation.PROFILES)} to categories")
            continue
        try:
            notation.RuleTable([r]).compiled
        except (re.error, KeyError) as e:
            out.append(f"{name}: {e}")
            continue
        for example in r.get("examples", ()):
            got = {f["category"] for f in notation.check(example["text"], notation.RuleTable([r]), example["profile"]) if f["rule_id"] == r["id"]}
            if got != {example["category"]}:
                out.append(f"{name}: example {example['text']!r} gives {sorted(got)}")
    return sorted(out)


def glossary_terms(lines: DataFrame) -> DataFrame:
    """Glossary lines (value, pos) -> kind, term, first occurrences in order. `use:`, `protect:` or a bare term; # comments."""
    said = F.trim(F.regexp_replace("value", "^﻿", ""))
    kind = F.when(said.startswith("use:"), "use").otherwise("protect")
    term = F.trim(F.regexp_replace(said, "^(?:use|protect):", ""))
    rows = lines.filter((said != "") & ~said.startswith("#")).select("pos", kind.alias("kind"), term.alias("term")).filter("term <> ''")
    return rows.groupBy("kind", "term").agg(F.min("pos").alias("pos"))
