"""Validation of suites, tasks, reviews and decisions: each check gives the rows that break it as (id, problem), one row a problem.

A null counts as a missing value; an empty table has no problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ledger import reasons

# What suites, reviews and decisions may hold.
DIMENSIONS = ("readability", "naturalness", "style")
STATUSES = ("pass", "fail", "uncertain")
PREFERENCES = ("original", "candidate", "tie", "uncertain", "not_applicable")
MODES = ("A", "B", "C", "D")
OPERATIONS = ("plan", "draft", "continue", "revise", "critique")
NEED_ORIGINAL = ("continue", "revise", "critique")
ISSUES = ("number", "condition", "negation", "actor", "speech_act", "omission", "addition", "style", "readability", "other")
SEVERITIES = ("minor", "major", "critical")
DECISIONS = ("confirmed_problem", "no_problem", "unresolved")
SPLITS = ("tuning", "final")


def blank(c: Column) -> Column:
    return F.length(T.strip(F.coalesce(c, F.lit("")))) == 0


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*allowed), F.lit(False))


def _incomplete(c: Column) -> Column:
    """Whether a list is null or empty or has a blank entry."""
    return c.isNull() | (F.size(c) == 0) | F.exists(c, blank)


def _problems(rows: DataFrame, *checks: tuple[Column, str], key: str = "id") -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.explode(reasons(*checks)).alias("problem"))


def _again(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).count().filter("count > 1").select("id", F.lit("id occurs again").alias("problem"))


def case_problems(cases: DataFrame) -> DataFrame:
    """Suite cases(id, request, context, text, domain, preserve, forbid, covers): a text or a context, and no empty list."""
    c = F.col
    return _problems(
        cases,
        (blank(c("id")), "no id"),
        (F.exists(F.array("request", "context", "text", "domain"), lambda x: x.isNull()), "field missing"),
        (blank(c("text")) & blank(c("context")), "no input"),
        *[(_incomplete(c(x)), f"{x} empty") for x in ("preserve", "forbid", "covers")],
    ).unionByName(_again(cases))


def control_problems(controls: DataFrame) -> DataFrame:
    """Suite controls(id, context, text, candidate, expected)."""
    c = F.col
    return _problems(
        controls,
        (blank(c("id")), "no id"),
        (c("context").isNull() | c("text").isNull(), "field missing"),
        (blank(c("text")) & blank(c("context")), "no input"),
        (blank(c("candidate")), "no candidate"),
        (~one_of(c("expected"), ("pass", "fail")), "unknown expectation"),
    ).unionByName(_again(controls))


def task_problems(tasks: DataFrame) -> DataFrame:
    """Tasks(id, mode, operation, request, original, candidate): what each mode needs."""
    c = F.col
    bare = blank(c("original"))
    return _problems(
        tasks,
        *[(blank(c(x)), f"no {x}") for x in ("id", "request", "candidate")],
        (~one_of(c("mode"), MODES), "unknown mode"),
        (one_of(c("mode"), ("B", "C")) & bare, "no original"),
        (one_of(c("mode"), ("D",)) & ~one_of(c("operation"), OPERATIONS), "unknown operation"),
        (one_of(c("mode"), ("D",)) & one_of(c("operation"), NEED_ORIGINAL) & bare, "no original"),
    ).unionByName(_again(tasks))


def pair_problems(pairs: DataFrame) -> DataFrame:
    """Pairs(id, mode, original, candidates: name to text): two named candidates, the same names in all pairs (those of the smallest id)."""
    c = F.col
    names = F.sort_array(F.map_keys("candidates"))
    first = pairs.agg(F.min_by(names, "id").alias("names")).withColumn("k", F.lit(1))  # one row
    rows = pairs.withColumn("k", F.lit(1)).join(F.broadcast(first), "k", "left")
    return _problems(
        rows,
        (blank(c("id")), "no id"),
        (~one_of(c("mode"), ("B",)), "mode is not B"),
        (blank(c("original")), "no original"),
        (F.coalesce(F.size("candidates"), F.lit(0)) != 2, "not two candidates"),
        (F.exists(F.map_keys("candidates"), lambda n: blank(n) | n.isin("tie", "uncertain")), "bad candidate name"),
        (F.exists(F.map_values("candidates"), blank), "no candidate"),
        (~names.eqNullSafe(c("names")), "other candidates"),
    ).unionByName(_again(pairs))


def _judged(of: str = "") -> list[tuple[Column, str]]:
    """Checks of a verdict and its scores (a map of dimensions to 1..5 or null)."""
    at = lambda x: F.col(of + x)
    return [
        (~one_of(at("contract"), STATUSES), "unknown contract"),
        (F.sort_array(F.map_keys(at("scores"))) != F.array(*map(F.lit, sorted(DIMENSIONS))), "score dimensions"),
        (F.coalesce(F.exists(F.filter(F.map_values(at("scores")), lambda v: v.isNotNull()), lambda v: ~v.between(1, 5)), F.lit(False)), "score not 1 to 5"),
        (blank(at("reason")), "no reason"),
    ]


def review_problems(reviews: DataFrame) -> DataFrame:
    """Reviews(id, mode, contract, scores, preference, reason): a preference only where two texts were compared and the contract is kept."""
    c = F.col
    none = one_of(c("preference"), ("not_applicable",))
    return _problems(
        reviews,
        *_judged(),
        (~one_of(c("preference"), PREFERENCES), "unknown preference"),
        (~one_of(c("contract"), ("pass",)) & ~one_of(c("preference"), ("uncertain", "not_applicable")), "preference without a pass"),
        (one_of(c("mode"), ("A", "D")) & ~none, "preference without a comparison"),
        (one_of(c("mode"), ("B", "C")) & none, "comparison without a preference"),
        (~one_of(c("mode"), MODES), "unknown mode"),
    ).unionByName(_again(reviews))


def candidate_problems(answers: DataFrame) -> DataFrame:
    """Answers(id, candidate, contract, scores, reason, issues: category, severity, quote, reason): issues quote their candidate word for word."""
    text = F.coalesce("candidate", F.lit(""))
    any_issue = lambda bad: F.coalesce(F.exists("issues", bad), F.lit(False))
    return _problems(
        answers,
        *_judged(),
        (any_issue(lambda i: ~one_of(i["category"], ISSUES)), "unknown issue"),
        (any_issue(lambda i: ~one_of(i["severity"], SEVERITIES)), "unknown severity"),
        (any_issue(lambda i: blank(i["quote"]) | ~F.contains(text, F.coalesce(i["quote"], F.lit("")))), "quote not in candidate"),
        (any_issue(lambda i: blank(i["reason"])), "issue without a reason"),
    )


def pair_review_problems(reviews: DataFrame) -> DataFrame:
    """Reviews of pairs(id, left_contract, right_contract, preference, reason): a side is preferred only if both pass."""
    c = F.col
    both = one_of(c("left_contract"), ("pass",)) & one_of(c("right_contract"), ("pass",))
    return _problems(
        reviews,
        (~one_of(c("left_contract"), STATUSES) | ~one_of(c("right_contract"), STATUSES), "unknown contract"),
        (~one_of(c("preference"), ("left", "right", "tie", "uncertain")), "unknown preference"),
        (~both & ~one_of(c("preference"), ("uncertain",)), "preference without two passes"),
        (blank(c("reason")), "no reason"),
    ).unionByName(_again(reviews))


def question_problems(questions: DataFrame) -> DataFrame:
    """Questions(id, document_id, prompt, options, answer_index, evidence, verified_by, verification_reason, original); ids are unique in a document."""
    c = F.col
    again = questions.groupBy("document_id", "id").count().filter("count > 1").select("id", F.lit("id occurs again").alias("problem"))
    return _problems(
        questions,
        *[(blank(c(x)), f"no {x}") for x in ("id", "prompt", "evidence", "verified_by", "verification_reason")],
        (c("options").isNull() | (F.size("options") < 2) | F.exists("options", blank), "fewer than two options"),
        (F.size(F.array_distinct("options")) != F.size("options"), "options repeated"),
        (~F.coalesce(c("answer_index").between(F.lit(0), F.size("options") - 1), F.lit(False)), "no such answer"),
        (~F.contains(F.coalesce("original", F.lit("")), F.coalesce("evidence", F.lit(""))), "evidence not in text"),
    ).unionByName(again)


def decision_problems(decisions: DataFrame, findings: DataFrame, findings_sha: str, problem_types: tuple[str, ...]) -> DataFrame:
    """Decisions(finding_id, findings_sha256, status, split, problem_type, confirmer, reason, quote, preserve, forbid, rule_ids) against
    findings(finding_id, original, result) whose file has that digest: one decision for each finding, and what its status needs."""
    c = F.col
    known = findings.select(F.col("finding_id").alias("_finding"), "original", "result")
    rows = decisions.join(known, c("finding_id") == c("_finding"), "left")
    open_ = one_of(c("status"), ("unresolved",))
    quote = F.coalesce("quote", F.lit(""))
    lists = [c(x) for x in ("preserve", "forbid", "rule_ids")]
    found = _problems(
        rows,
        (c("_finding").isNull(), "unknown finding"),
        (~F.coalesce(c("findings_sha256") == findings_sha, F.lit(False)), "made from other findings"),
        (~one_of(c("status"), DECISIONS) | ~one_of(c("split"), SPLITS) | ~one_of(c("problem_type"), problem_types), "unknown status, split or type"),
        (~open_ & (blank(c("confirmer")) | blank(c("reason")) | blank(c("quote"))), "confirmer, reason or quote missing"),
        (F.exists(F.array(*lists), lambda x: x.isNull() | F.exists(x, blank)), "list with a blank"),
        (one_of(c("status"), ("confirmed_problem",)) & F.exists(F.array(*lists), lambda x: F.size(x) == 0), "confirmed without preserve, forbid or rules"),
        (c("_finding").isNotNull() & ~F.contains(F.coalesce("original", F.lit("")), quote) & ~F.contains(F.coalesce("result", F.lit("")), quote), "quote not in text"),
        key="finding_id",
    )
    undecided = findings.join(decisions.select("finding_id"), "finding_id", "left_anti").select(c("finding_id").alias("id"), F.lit("no decision").alias("problem"))
    return found.unionByName(_again(decisions, "finding_id")).unionByName(undecided)


def excerpt_case_problems(cases: DataFrame, excerpts: DataFrame, split: str, by: str = "source") -> DataFrame:
    """Cases(id, document_id, original, request, audience) against adopted excerpts(id, source_id, status, split, text_sha256) by the digest of the text:
    of the split asked for, and counted by `source` or by `excerpt` (then with one excerpt of each source). Of excerpts of one text the smallest id counts."""
    c = F.col
    adopted = excerpts.filter("status = 'adopted'").groupBy(c("text_sha256").alias("_sha"))
    adopted = adopted.agg(F.min(F.struct(c("id").alias("excerpt"), "source_id", c("split").alias("has"))).alias("e")).select("_sha", "e.*")
    rows = cases.withColumn("_of", F.sha2("original", 256)).join(adopted, c("_of") == c("_sha"), "left")
    there = c("_sha").isNotNull()
    wanted = c("source_id") if by == "source" else c("excerpt")
    out = _problems(
        rows,
        (~there, "not an adopted excerpt"),
        (there & ~c("has").eqNullSafe(F.lit(split)), "other split"),
        (there & ~c("document_id").eqNullSafe(wanted), "other document id"),
        *[(there & blank(c(x)), f"no {x}") for x in ("request", "audience")],
    ).unionByName(_again(cases))
    if by == "excerpt":
        several = rows.filter(there).groupBy(c("source_id").alias("id")).agg(F.count_distinct("excerpt").alias("n")).filter("n > 1")
        out = out.unionByName(several.select("id", F.lit("several excerpts of one source").alias("problem")))
    return out
