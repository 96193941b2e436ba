"""Evaluation analytics: votes, scores, severities, agreement, resampling. Missing, failed and zero are kept apart:
rates are null without a denominator."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS_RANK = ("pass", "uncertain", "fail", "missing")


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def grouped_status(reviews: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """reviews(by..., status) counted over all keys, zero groups too."""
    counts = reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "uncertain")])
    return keys.join(counts, by, "left").na.fill(0, ["n", "pass", "fail", "uncertain"])


def vote_summary(votes: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(pair_id, reviewer) and votes(pair_id, reviewer, preference, both_pass): expected, completed, missing, choices."""
    rows = expected.join(votes, ["pair_id", "reviewer"], "left")
    done = F.col("preference").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("missing"),
        F.count_if(F.col("both_pass")).alias("both_pass"),
        *[F.count_if(F.col("preference") == p).alias(f"prefer_{p}") for p in ("a", "b", "tie")],
    )


def variant_summary(reviews: DataFrame) -> DataFrame:
    """reviews(variant, contract: pass/fail/uncertain): fail rates over the decided and over all."""
    fail, passed = F.count_if(F.col("contract") == "fail"), F.count_if(F.col("contract") == "pass")
    return reviews.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), fail.alias("fail"), passed.alias("pass"), rate(fail, fail + passed).alias("fail_rate_decided"), rate(fail, F.count(F.lit(1))).alias("fail_rate_all")
    )


def severity_summary(issues: DataFrame) -> DataFrame:
    """issues(variant, document_id, severity): issues and different documents by severity, major or critical together too."""
    heavy = F.col("severity").isin("major", "critical")
    docs = lambda cond: F.count_distinct(F.when(cond, F.col("document_id")))
    by = [x for s in ("minor", "major", "critical") for x in (F.count_if(F.col("severity") == s).alias(f"{s}_issues"), docs(F.col("severity") == s).alias(f"{s}_documents"))]
    return issues.groupBy("variant").agg(*by, docs(heavy).alias("major_or_critical_documents"))


def score_distribution(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores(by..., score): how often each value, and the mean of those that aren't null."""
    each = scores.filter("score is not null").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))
    bars = each.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("score", "n")))).alias("distribution"))
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.avg("score").alias("mean")).join(bars, by, "left")


def disagreements(reviews: DataFrame, key: list[str]) -> DataFrame:
    """Items that got more than one different verdict, with the verdicts."""
    return reviews.groupBy(*key).agg(F.sort_array(F.collect_set("contract")).alias("verdicts"), F.count(F.lit(1)).alias("reviews")).filter(F.size("verdicts") > 1)


def quiz_scores(questions: DataFrame, readers: DataFrame, answers: DataFrame) -> DataFrame:
    """questions(document_id, question_id, variant, correct), readers(reader, document_id), answers(reader, question_id, choice):
    scores by variant, by document and variant, and over all. A missing answer is missing, not wrong."""
    asked = questions.join(readers, "document_id").join(answers, ["reader", "question_id"], "left")
    right, given = F.count_if(F.col("choice") == F.col("correct")), F.count("choice")
    return (
        asked.groupingSets([["variant"], ["document_id", "variant"], []], "document_id", "variant")
        .agg(F.count(F.lit(1)).alias("asked"), given.alias("answered"), (F.count(F.lit(1)) - given).alias("missing"), right.alias("correct"), rate(right, given).alias("score"), F.grouping_id().alias("level"))
    )


def document_means(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """outcomes(by..., document_id, value): every document weighs the same, however often it occurs."""
    inner = outcomes.groupBy(*by, "document_id").agg(F.avg("value").alias("m"))
    return inner.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.avg("m").alias("mean"))


def bootstrap(documents: DataFrame, resamples: int = 9999, seed: int = 0, level: float = 0.95, key: str = "document_id") -> DataFrame:
    """documents(document_id, value), one per document: percentile interval of the mean by resampling; `insufficient` below two
    documents, `degenerate` if all are equal, else `estimated`. Resamples are drawn as Poisson counts by column functions:
    each task holds one number per resample, never the documents."""
    # The draws of a document depend on its id alone, so that they don't change with the partitioning.
    base = documents.select("value", F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    drawn = base.select("value", "h", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    u = (F.pmod(F.xxhash64("h", "r"), F.lit(2**52)).cast("double") + 0.5) / 2.0**52
    # inverse of the Poisson(1) distribution function
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum(((u > s).cast("int") for s in steps[1:]), (u > steps[0]).cast("int"))
    sums = drawn.select("r", "value", weight.alias("w")).groupBy("r").agg(rate(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ends = sums.agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    facts = documents.agg(F.count("value").alias("documents"), F.avg("value").alias("mean"), F.min("value").alias("a"), F.max("value").alias("b"))
    status = F.when(F.col("documents") < 2, "insufficient").when(F.col("a") == F.col("b"), "degenerate").otherwise("estimated")
    both = facts.withColumns({"status": status, "k": F.lit(1)}).join(ends.withColumn("k", F.lit(1)), "k")  # a row each
    keep = F.col("status") == "estimated"
    return both.select("documents", "mean", "status", F.when(keep, F.col("lo")).alias("low"), F.when(keep, F.col("hi")).alias("high"))


def bootstrap_exact(values: DataFrame, resamples: int = 9999, seed: int = 0, level: float = 0.95, most: int = 100_000) -> DataFrame:
    """The same interval with multinomial resamples of Python's generator, for a set of documents of checked size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import random
        from statistics import fmean

        data = [v for b in batches for v in b.column(0).to_pylist() if v is not None]
        if len(data) > most:
            raise ValueError(f"over {most} documents: use bootstrap()")
        low = high = None
        state = "insufficient" if len(data) < 2 else "degenerate" if len(set(data)) == 1 else "estimated"
        if state == "estimated":
            rng = random.Random(seed)
            means = sorted(fmean(rng.choices(data, k=len(data))) for _ in range(resamples))
            at = lambda q: (lambda p: means[int(p)] + (means[min(int(p) + 1, len(means) - 1)] - means[int(p)]) * (p - int(p)))(q * (len(means) - 1))
            low, high = at((1 - level) / 2), at((1 + level) / 2)
        row = [[len(data)], [fmean(data) if data else None], [state], [low], [high]]
        types = [pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["documents", "mean", "status", "low", "high"])

    return values.select(F.col("value").cast("double").alias("value")).coalesce(1).mapInArrow(run, "documents long, mean double, status string, low double, high double")


def exact_percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], near: float = 0.001, most: int = 10_000) -> DataFrame:
    """by..., and a column per entry of wanted: {name: (column, share)}, percentiles with linear interpolation of the values that aren't null.

    Spark's own holds a group's different values in one task. Here a sketch gives two marks near each wanted place (`near`: how far off, as
    a share of the rows); the rows between marks are counted, and only a part that holds a wanted rank is sorted by value. Counts are exact and
    every row belongs to one part, so the sketch decides how much is sorted, never what comes out. Marks are broadcast for up to `most`
    groups; more are joined by exchanges."""
    columns = sorted({c for c, _ in wanted.values()})
    marks = lambda c: sorted({min(1.0, max(0.0, p + d)) for k, p in wanted.values() if k == c for d in (-near, near)})
    keys = [F.col(k).alias(f"_{i}") for i, k in enumerate(by)]
    ours = [f"_{i}" for i in range(len(by))]
    same = lambda x, y, names: reduce(lambda p, q: p & q, [F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names], F.lit(True))
    each = lambda make: F.explode(F.array(*[F.struct(F.lit(i).alias("c"), *make(c)) for i, c in enumerate(columns)]))

    small = F.broadcast if rows.select(*keys).distinct().limit(most + 1).count() <= most else lambda table: table
    sketch = rows.groupBy(*keys).agg(*[F.percentile_approx(F.col(c).cast("double"), marks(c), 10_000).alias(f"m{i}") for i, c in enumerate(columns)], F.lit(0).alias("k"))
    sketch = sketch.select(*ours, each(lambda c: [F.col(f"m{columns.index(c)}").alias("marks")]).alias("x")).select(*ours, "x.*")
    values = rows.select(*keys, each(lambda c: [F.col(c).cast("double").alias("v")]).alias("x")).select(*ours, "x.*").filter("v is not null")
    part = F.size(F.filter("marks", lambda m: m <= F.col("v")))
    dealt = values.alias("x").join(small(sketch.alias("y")), same("x", "y", [*ours, "c"])).select(*[f"x.{n}" for n in [*ours, "c", "v"]], part.alias("part"))

    parts = dealt.groupBy(*ours, "c", "part").agg(F.count(F.lit(1)).alias("n"))
    here = Window.partitionBy(*ours, "c")  # a row per part: twice the wanted places and one
    order = here.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"total": F.sum("n").over(here), "before": F.coalesce(F.sum("n").over(order), F.lit(0))})
    # of each wanted place, the ranks (from 0) at either side of it
    asked = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(columns.index(c)).alias("c"), F.lit(float(p)).alias("p")) for i, (c, p) in enumerate(wanted.values())])
    parts = parts.select(*ours, "c", "part", "before", "n", "total", F.explode(F.filter(asked, lambda a: a["c"] == F.col("c"))).alias("a"))
    at = F.col("total").cast("double") - 1
    parts = parts.select(*ours, "c", "part", "before", "n", F.col("a.w").alias("w"), (at * F.col("a.p")).alias("at")).withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
    places = parts.filter("rank >= before and rank < before + n").groupBy(*ours, "c", "part", "before").agg(F.collect_set(F.struct("w", "at", "rank")).alias("asked"))

    counted = dealt.alias("x").join(small(places.alias("y")), same("x", "y", [*ours, "c", "part"])).groupBy(*[f"x.{n}" for n in [*ours, "c", "part", "v"]]).agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy(*ours, "c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("upto", F.sum("k").over(run))
    ends = counted.alias("x").join(small(places.alias("y")), same("x", "y", [*ours, "c", "part"])).select(*[F.col(f"x.{n}") for n in [*ours, "v", "k"]], (F.col("before") + F.col("upto")).alias("upto"), F.explode("asked").alias("a"))
    ends = ends.filter("a.rank < upto and a.rank >= upto - k").groupBy(*ours, "a.w", "a.at").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    found = ends.groupBy(*ours).agg(*[F.max(F.when(F.col("w") == i, value)).alias(name) for i, name in enumerate(wanted)])
    groups = rows.groupBy(*keys).agg(F.lit(0).alias("k"))
    out = groups.alias("x").join(found.alias("y"), same("x", "y", ours), "left")
    return out.select(*[F.col(f"x._{i}").alias(k) for i, k in enumerate(by)], *[F.col(f"y.{n}") for n in wanted])


def _with_percentiles(rows: DataFrame, by: list[str], stats: list[Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Aggregates and exact percentiles of the same groups."""
    here, there = rows.groupBy(*by).agg(*stats), exact_percentiles(rows, by, wanted)
    match = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in by], F.lit(True))
    return here.alias("x").join(there.alias("y"), match).select("x.*", *[F.col(f"y.{n}") for n in wanted])


def spread(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Minimum, median and maximum of columns, nulls left out."""
    stats = [x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    out = _with_percentiles(rows, by, [F.count(F.lit(1)).alias("runs"), *stats], {f"{c}_median": (c, 0.5) for c in columns})
    return out.select(*by, "runs", *[f"{c}_{x}" for c in columns for x in ("min", "median", "max")])


def percentiles(rows: DataFrame, by: list[str], column: str, at: list[float]) -> DataFrame:
    """Percentiles with linear interpolation."""
    return exact_percentiles(rows, by, {f"p{int(p * 100)}": (column, p) for p in at})


def run_summary(runs: DataFrame) -> DataFrame:
    """runs(label, errors_left, kept_protected): runs without errors, mean of what is left, runs that kept what was protected."""
    stats = [F.count(F.lit(1)).alias("runs"), F.count_if(F.col("errors_left") == 0).alias("error_free"), F.avg("errors_left").alias("mean_left"), F.count_if("kept_protected").alias("protected_kept")]
    out = _with_percentiles(runs, ["label"], stats, {"median_left": ("errors_left", 0.5)})
    return out.select("label", "runs", "error_free", "mean_left", "median_left", "protected_kept")


def confusion(rows: DataFrame, human: str, machine: str) -> DataFrame:
    """Binary verdicts of two graders (true: problem): the matrix and three rates, in one row."""
    h, m = F.col(human), F.col(machine)
    cells = [F.count_if(h & m).alias("both"), F.count_if(~h & m).alias("machine_only"), F.count_if(h & ~m).alias("human_only"), F.count_if(~h & ~m).alias("neither")]
    out = rows.filter(h.isNotNull() & m.isNotNull()).agg(*cells)
    return out.select(
        "*",
        rate(F.col("both"), F.col("both") + F.col("machine_only")).alias("precision"),
        rate(F.col("both"), F.col("both") + F.col("human_only")).alias("recall"),
        rate(F.col("both") + F.col("neither"), F.col("both") + F.col("neither") + F.col("machine_only") + F.col("human_only")).alias("agreement"),
    )


def tally(rows: DataFrame, signal: str, by: list[str]) -> DataFrame:
    """A signal that is true, false or null: signalled, available, unavailable, and the rate among the available."""
    s = F.col(signal)
    return rows.groupBy(*by).agg(
        F.count_if(s).alias("signalled"), F.count(s).alias("available"), F.count_if(s.isNull()).alias("unavailable"), rate(F.count_if(s), F.count(s)).alias("rate")
    )


def stability(scores: DataFrame, key: list[str]) -> DataFrame:
    """Repeats of a score: different values, whether one has the majority, the range, and repeats off the most frequent value."""
    each = scores.filter("value is not null").groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*key).agg(
        F.sum("n").alias("repeats"),
        F.count(F.lit(1)).alias("distinct_values"),
        (F.max("n") * 2 > F.sum("n")).alias("has_majority"),
        (F.max("value") - F.min("value")).alias("value_range"),
        (F.sum("n") - F.max("n")).alias("flips"),
    )


def claim_scores(claims: DataFrame) -> DataFrame:
    """claims(case_id, side: output/reference, supported): precision and recall; a case without claims is null, not zero."""
    of = lambda s: (F.count_if((F.col("side") == s) & F.col("supported")), F.count_if(F.col("side") == s))
    p, r = of("output"), of("reference")
    return claims.groupBy("case_id").agg(rate(*p).alias("precision"), rate(*r).alias("recall"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """runs(run_id, config, calls, cost) -> sums, and whether all have one configuration and no id twice."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("calls").alias("calls"), F.sum("cost").alias("cost"), (F.count_distinct("config") == 1).alias("same_config"), (F.count_distinct("run_id") == F.count("run_id")).alias("ids_unique")
    )


def crosstab(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def worst_status(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key..., status): missing over fail over uncertain over pass; null counts as missing."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_RANK)), F.coalesce("status", F.lit("missing")))
    return rows.groupBy(*key).agg(F.max_by(F.coalesce("status", F.lit("missing")), rank).alias("status"))


def transitions(before: DataFrame, after: DataFrame, kinds: DataFrame) -> DataFrame:
    """kinds(case_id, problem_type) with the statuses of two runs: fixed, regressed, ... by problem type, and whether to hold."""
    rows = kinds.join(before.select("case_id", F.col("status").alias("b")), "case_id", "left").join(after.select("case_id", F.col("status").alias("a")), "case_id", "left")
    pair = F.concat_ws(">", F.coalesce("b", F.lit("missing")), F.coalesce("a", F.lit("missing")))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("fail>pass", "fixed", "pass>fail", "regressed", "fail>fail", "still_fail", "pass>pass", "still_pass")]), pair), F.lit("uncertain_or_missing"))
    out = rows.withColumn("t", kind).groupBy("problem_type").pivot("t", ["fixed", "regressed", "still_fail", "still_pass", "uncertain_or_missing"]).count().na.fill(0)
    return out.withColumn("hold", (F.col("regressed") > 0) | (F.col("uncertain_or_missing") > 0))


def two_order_verdict(rows: DataFrame, key: list[str]) -> DataFrame:
    """Verdicts of both presentation orders: the common one, else uncertain."""
    one = (F.count("verdict") == 2) & (F.min("verdict") == F.max("verdict"))
    return rows.groupBy(*key).agg(F.when(one, F.min("verdict")).otherwise("uncertain").alias("verdict"))


def adoption(checks: DataFrame) -> DataFrame:
    """checks(name, passed): adopt only if all passed."""
    return checks.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("adopt"), F.sort_array(F.collect_list(F.when(~F.coalesce("passed", F.lit(False)), F.col("name")))).alias("against"))


def joined_judgments(outputs: DataFrame, items: DataFrame, judgments: DataFrame) -> DataFrame:
    """outputs(source_id, case_id), items(id, source_id), judgments(id, status): every output with its status or `missing`."""
    judged = items.join(judgments, "id", "left").select("source_id", "status")
    return outputs.join(judged, "source_id", "left").select("source_id", "case_id", F.coalesce("status", F.lit("missing")).alias("status"))


def coverage_gaps(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, unknown or there more than once."""
    a, b = wanted.select(key).distinct().withColumn("w", F.lit(1)), got.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).filter("state is not null")


def _ranked(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """Different ids with their place (from 1) in the order of a seeded hash. The upper bits of the hash name a bucket, whose sizes (1,024 rows
    at most) say where it begins: no task ranks them all."""
    rows = ids.select(key).withColumn("h", F.xxhash64(key, F.lit(seed))).withColumn("bucket", F.shiftright("h", 54))
    starts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    return rows.withColumn("nth", nth).join(F.broadcast(starts), "bucket").select(key, (F.col("before") + F.col("nth")).alias("nth"))


def balanced_assignment(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """pairs(pair_id, document_id) -> which candidate is shown first: half of the documents each (one more or less if they are odd),
    one orientation per document, in a seeded order."""
    turned = _ranked(pairs.select("document_id").distinct(), "document_id", seed)
    return pairs.join(turned.select("document_id", (F.pmod("nth", F.lit(2)) == seed % 2).alias("swapped")), "document_id")


def reader_assignment(pairs: DataFrame, side: str, seed: int = 0) -> DataFrame:
    """pairs(pair_id, document_id, first, second: names of the candidates) -> pair_id, document_id, variant that a reader of `left` or `right` gets."""
    shown = F.when(F.col("swapped"), F.col("second")).otherwise(F.col("first"))
    other = F.when(F.col("swapped"), F.col("first")).otherwise(F.col("second"))
    return balanced_assignment(pairs, seed).select("pair_id", "document_id", (shown if side == "left" else other).alias("variant"))


def schedule(inputs: DataFrame, versions: list[str], runs: int) -> DataFrame:
    """Inputs, runs and versions interleaved: input, run, version, in that order. Both lists are small parameters."""
    slots = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(v).alias("version")) for r in range(1, runs + 1) for v in versions])
    return inputs.select("input", F.inline(slots)).orderBy("run", "input", "version")


def shuffled_batches(items: DataFrame, size: int = 15, seed: int = 20261016) -> DataFrame:
    """Grading items in a seeded order, numbered, in batches of `size`; rows of one id have one number."""
    rows = items.join(_ranked(items.select("id").distinct(), "id", seed), "id")
    return rows.select("*", F.format_string("g%03d", "nth").alias("label"), F.floor((F.col("nth") - 1) / size).alias("batch"))


def first_and_more(rows: DataFrame, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in that order (all if `most` is 0 or less), and one row that says how many more there are."""
    shown = rows.orderBy(*order) if most <= 0 else rows.orderBy(*order).limit(most)
    left = F.lit(0).cast("long") if most <= 0 else F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - most)
    return shown, rows.agg(F.count(F.lit(1)).alias("rows"), left.alias("more")).select("more")


CONTENT = ("request", "context", "audience", "original", "candidate")


def grader_pairs(assigned: DataFrame, decisions: DataFrame, tasks: DataFrame, judgments: DataFrame) -> DataFrame:
    """assigned(source_id, variant, content...), decisions(source_id, variant, status), tasks(id, source_id, variant, content...), judgments(id, contract)
    -> source_id, variant, human, machine, problem. Both graders must have seen the same content; a task without a judgment is `missing`."""
    key = ["source_id", "variant"]
    same = F.lit(True)
    for c in CONTENT:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    judged = tasks.join(judgments.select("id", "contract"), "id", "left")
    theirs = judged.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("contract").alias("contract"), *[F.max(c).alias(f"_{c}") for c in CONTENT])
    rows = assigned.select(*key, *CONTENT, F.lit(1).alias("ours")).join(theirs, key, "full_outer").join(decisions.select(*key, "status"), key, "left")
    said = F.create_map(*[F.lit(x) for x in ("confirmed_problem", "fail", "no_problem", "pass", "unresolved", "uncertain")])
    problem = (
        F.when(F.col("ours").isNull(), "unknown candidate").when(F.col("n").isNull(), "no task").when(F.col("n") > 1, "several tasks").when(~same, "other content").when(F.col("status").isNull(), "no decision")
    )
    return rows.select(*key, F.try_element_at(said, F.col("status")).alias("human"), F.coalesce("contract", F.lit("missing")).alias("machine"), problem.alias("problem"))


def labelled_run(run: DataFrame, labels: DataFrame, key: str = "case_id") -> DataFrame:
    """Every case of a run with its label; `problem` names cases that have none."""
    known = labels.withColumn("_known", F.lit(True))
    return run.join(known, key, "left").withColumn("problem", F.when(F.col("_known").isNull(), "no label")).drop("_known")


def document_outcomes(reviews: DataFrame) -> DataFrame:
    """reviews(document_id, first, second: contracts of the two versions, selected: first, second or tie) -> per document the share of failures of
    the second less that of the first, over reviews that decided both, and the balance of preferences (second 1, first -1), over reviews that both passed."""
    decided = F.col("first").isin("pass", "fail") & F.col("second").isin("pass", "fail")
    worse = (F.col("second") == "fail").cast("int") - (F.col("first") == "fail").cast("int")
    vote = F.when(F.col("selected") == "first", -1).when(F.col("selected") == "second", 1).when(F.col("selected") == "tie", 0)
    vote = F.when((F.col("first") == "pass") & (F.col("second") == "pass"), vote)
    return reviews.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(decided).alias("determined"), F.count(vote).alias("votes"), F.avg(F.when(decided, worse)).alias("fail_rate_difference"), F.avg(vote).alias("preference_balance")
    )


def paired_estimates(outcomes: DataFrame, exact: bool = False, resamples: int = 9999, seed: int = 0) -> DataFrame:
    """document_outcomes() -> metric, documents, mean, status, low, high, for both metrics over documents that have them."""
    parts = []
    for metric in ("fail_rate_difference", "preference_balance"):
        own = outcomes.filter(F.col(metric).isNotNull()).select("document_id", F.col(metric).alias("value"))
        found = bootstrap_exact(own, resamples, seed) if exact else bootstrap(own, resamples, seed)
        parts.append(found.select(F.lit(metric).alias("metric"), "documents", "mean", "status", "low", "high"))
    return parts[0].unionByName(parts[1])


# What is asked of each kind of document.
ASPECTS = {
    "core": ("negation_polarity", "condition_scope", "actor_target", "modality_strength", "ungrounded_specificity", "unnecessary_change"),
    "gov-org": ("negation_polarity", "condition_scope", "actor_target", "modality_strength", "numbers_order", "ungrounded_specificity", "unnecessary_change"),
    "tech": ("negation_polarity", "condition_scope", "numbers_order", "ungrounded_specificity", "unnecessary_change"),
    "essay": ("negation_polarity", "sentence_function", "rhetoric_tone", "ungrounded_specificity", "unnecessary_change"),
    "all": ("negation_polarity", "condition_scope", "actor_target", "modality_strength", "sentence_function", "numbers_order", "ungrounded_specificity", "unnecessary_change", "rhetoric_tone"),
}


def aspect_gaps(cases: DataFrame, verdicts: DataFrame, aspects: dict[str, tuple[str, ...]] = ASPECTS) -> DataFrame:
    """cases(case_id, profile), verdicts(case_id, aspect, value) -> case_id, aspect, state: `missing`, `not asked` or `unknown value`."""
    table = F.create_map(*[x for k, v in aspects.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = cases.select("case_id", F.explode(F.try_element_at(table, F.col("profile"))).alias("aspect")).withColumn("asked", F.lit(1))
    rows = asked.join(verdicts.withColumn("given", F.lit(1)), ["case_id", "aspect"], "full_outer")
    bad = ~F.coalesce(F.col("value").isin("pass", "fail", "uncertain"), F.lit(False))
    state = F.when(F.col("given").isNull(), "missing").when(F.col("asked").isNull(), "not asked").when(bad, "unknown value")
    return rows.select("case_id", "aspect", state.alias("state")).filter("state is not null")
