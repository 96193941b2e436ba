"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines that hold a word; all sequences together, in the order of
(doc_id, content), with a gap after each, are the text whose suffixes are sorted. A line's ID is a 128-bit hash of
its bytes. Prefix doubling gives every suffix the rank of its first 1, 2, 4, ... lines: the different pairs of ranks are sorted by
sampled range partitioning, and a pair's place in that order is its rank, so that ranks compare as the prefixes do. Suffixes of
equal rank are one interval of the suffix array in which the longest common prefix is at least that long. A suffix alone in its
interval parts from its neighbours in that round, can't begin a repeated run of that length and leaves; so the rows of each
round are those that repeat, no more.

How far two suffixes of one interval agree (their longest common prefix) follows from the rounds: from the last one down, each in which
their ranks are still equal lengthens it by its power of two. A place and the earliest suffix of its interval so give a repeated run,
maximal to the right; those that continue the run of the line before are left out, so that it is maximal to the left (`repeated_runs`).

The interval of any length l is that of the two ranks of the largest power of two within l, at its start and at its end.
A repeated run counts if it has `min_words` words. Every line of such a run lies in the shortest window of that many
words that begins at some line of it or in the shortest that ends at some line of it, and these windows are at most
min_words lines long. So two windows a line, each looked up in the ranks, tell exactly which lines are in a later copy of a
repeated run; those are deleted, the first copy in the text's order stays.

Defined cases: null text has no lines and stays null; lines without a word are never deleted; rows equal in doc_id and
text are one document (each of them gives the same result); null doc_ids come first; an empty table gives no rows; other
columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

LINES = "doc_id long, h long, base long, at long, h1 long, h2 long, ahead int, behind int"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def line_rows(documents: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """A row per line that holds a word. at: its place in the text of all lines; base: of its document's first line;
    ahead, behind: lines of the shortest window of min_words words that begins, ends here (0: there is none)."""
    light = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
        F.filter(_lines(F.col("text")), _has_word).alias("lines"),
    ).select(
        "doc_id",
        "h",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h1"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("h2"),  # the seed of the line's hash is that of the 1
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)).cast("int")).alias("words"),
    )
    # Written first: range partitioning samples its input, and would read all texts for that.
    light = scratch.save(light.filter(F.size("words") > 0)).dropDuplicates(["doc_id", "h"])
    dealt = light.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            count = np.diff(batch.column("words").offsets.to_numpy())
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("h1", "h2", "words")}
            first = np.cumsum(count) - count
            base = offset + first + np.arange(len(count))  # a gap of one after each document
            offset += int(count.sum()) + len(count)
            lo, hi = np.repeat(first, count), np.repeat(first + count, count)
            total = np.concatenate([[0], np.cumsum(flat["words"], dtype=np.int64)])
            i = np.arange(len(lo))
            end = np.searchsorted(total, total[i] + min_words)  # the window [i, end)
            begin = np.searchsorted(total, total[i + 1] - min_words, side="right") - 1  # the window [begin, i]
            cols = [
                batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(count)), count))),
                pa.array(np.repeat(batch.column("h").to_numpy(), count)),
                pa.array(np.repeat(base, count)),
                pa.array(np.repeat(base - first, count) + i),
                pa.array(flat["h1"]),
                pa.array(flat["h2"]),
                pa.array(np.where(end <= hi, end - i, 0).astype(np.int32)),
                pa.array(np.where(begin >= lo, i - begin + 1, 0).astype(np.int32)),
            ]
            out = pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in LINES.split(", ")])
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    return dealt.mapInArrow(run, LINES)


def _ranked(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """rows(at, key...) -> with `rank`, the place of the key in the order of all keys that occur twice or more, and `earliest`, the
    first place that has it. Keys that occur once leave.

    Keys are counted with a map-side combine; different keys are sorted by range partitioning, in which a row's number grows
    with the partition's. The join back has each key once on one side, so that a hot key's rows can be split over tasks."""
    groups = scratch.save(rows.groupBy(*key).agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    order = groups.repartitionByRange(*key).sortWithinPartitions(*key)
    ranks = scratch.save(order.select(*[F.col(k).alias(f"_{k}") for k in key], F.monotonically_increasing_id().alias("rank"), "earliest"))
    on = F.lit(True)
    for k in key:
        on &= F.col(k) == F.col(f"_{k}")
    return rows.join(ranks.hint("shuffle_merge"), on).drop(*key, *[f"_{k}" for k in key])


def prefix_ranks(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """line_rows -> (those of lines that repeat, with rank and earliest; by power of two the ranks of prefixes: base, at, rank, earliest)."""
    first = scratch.save(_ranked(rows, ["h1", "h2"], scratch))
    levels = [first.select("base", "at", "rank", "earliest")]
    while True:
        half, level = 2 ** (len(levels) - 1), levels[-1]
        after = level.select(F.col("base").alias("_base"), (F.col("at") - half).alias("_at"), F.col("rank").alias("right"))
        pairs = level.join(after.hint("shuffle_merge"), (F.col("at") == F.col("_at")) & (F.col("base") == F.col("_base")))
        more = scratch.save(_ranked(pairs.select("base", "at", F.col("rank").alias("left"), "right"), ["left", "right"], scratch))
        if more.isEmpty():
            return first, levels
        levels.append(more)


def _windows(first: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Windows of min_words words whose lines all repeat, with the ranks at their two ends: doc_id, h, base, start, length, left, right."""
    doc = ["doc_id", "h", "base"]
    ahead = first.filter("ahead > 0").select(*doc, F.col("at").alias("start"), F.col("ahead").alias("length"))
    behind = first.filter("behind > 0").select(*doc, (F.col("at") - F.col("behind") + 1).alias("start"), F.col("behind").alias("length"))
    windows, found = scratch.save(ahead.unionByName(behind).distinct()), []
    for k, level in enumerate(levels):
        place = level.select(F.col("at").alias("_at"), F.col("rank").alias("_rank"))
        own = windows.filter(F.col("length").between(2**k, 2 ** (k + 1) - 1))
        own = own.join(place.hint("shuffle_merge"), F.col("start") == F.col("_at")).drop("_at").withColumnRenamed("_rank", "left")
        if k:
            own = own.join(place.hint("shuffle_merge"), F.col("start") + F.col("length") - 2**k == F.col("_at")).drop("_at").withColumnRenamed("_rank", "right")
        else:
            own = own.withColumn("right", F.col("left"))
        found.append(own)
    return scratch.save(reduce(DataFrame.unionByName, found))


def _repeated(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """The windows of intervals with two members or more, with the earliest start of each and its members' number."""
    key = ["length", "left", "right"]
    intervals = windows.groupBy(*key).agg(F.min("start").alias("earliest"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    intervals = scratch.save(intervals.select(*[F.col(c).alias(f"_{c}") for c in key], "earliest", "copies"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in key])
    return scratch.save(windows.join(intervals.hint("shuffle_merge"), same).select("doc_id", "h", "base", "start", "length", "earliest", "copies"))


def _runs(repeated: DataFrame, first: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Maximal runs of later copies: doc_id, h, line, lines, copies, source_doc_id, source_line."""
    begin = first.filter("ahead > 0").select(F.col("at").alias("_at"), "ahead")
    later = repeated.filter("start > earliest").join(begin.hint("shuffle_merge"), (F.col("start") == F.col("_at")) & (F.col("length") == F.col("ahead")))
    before = Window.partitionBy("base").orderBy("start")
    goes_on = (F.lag("start").over(before) == F.col("start") - 1) & (F.lag("earliest").over(before) == F.col("earliest") - 1)
    runs = later.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).filter("not goes_on")
    runs = scratch.save(runs.select("doc_id", "h", "base", "start", "earliest", "copies", F.lit(0).cast("long").alias("lines")))
    # Few rows meet large tables here: Spark may broadcast them while they are below its own threshold.
    for k in range(len(levels) - 1, -1, -1):
        rank = lambda c, k=k: levels[k].select(F.col("at").alias(f"_{c}"), F.col("rank").alias(f"rank_{c}"))
        met = runs.join(rank("here"), F.col("start") + F.col("lines") == F.col("_here"), "left")
        met = met.join(rank("there"), F.col("earliest") + F.col("lines") == F.col("_there"), "left")
        more = F.when(F.col("rank_here") == F.col("rank_there"), F.lit(2**k)).otherwise(0)
        runs = scratch.save(met.withColumn("lines", F.col("lines") + more).select(*runs.columns))
    source = first.select(F.col("at").alias("_at"), F.col("doc_id").alias("source_doc_id"), (F.col("at") - F.col("base")).alias("source_line"))
    runs = runs.join(source, F.col("earliest") == F.col("_at"))
    return runs.select("doc_id", "h", (F.col("start") - F.col("base")).alias("line"), "lines", "copies", "source_doc_id", "source_line")


def _later(repeated: DataFrame) -> DataFrame:
    """(doc_id, h, gone): stretches of a document's lines with words that later copies hold: array of (from, size), apart and in order."""
    stretch = repeated.filter("start > earliest").select("doc_id", "h", (F.col("start") - F.col("base")).alias("from"), (F.col("start") - F.col("base") + F.col("length")).alias("to"))
    order = Window.partitionBy("doc_id", "h").orderBy("from", "to")
    covered = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = stretch.withColumn("opens", (covered.isNull() | (F.col("from") > covered)).cast("int"))
    opened = opened.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = opened.groupBy("doc_id", "h", "part").agg(F.min("from").cast("int").alias("from"), F.max("to").cast("int").alias("to"))
    one = F.struct("from", (F.col("to") - F.col("from")).alias("size"))
    return parts.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(one)).alias("gone"))


def _ranked_windows(documents: DataFrame, min_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    rows = scratch.save(line_rows(documents, min_words, scratch))
    first, levels = prefix_ranks(rows, scratch)
    scratch.drop(rows)
    return _repeated(_windows(first, levels, scratch), scratch), first, levels


def later_copies(documents: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(doc_id, h, gone): the stretches, among a document's lines with words, that are in later copies."""
    return _later(_ranked_windows(documents, min_words, scratch)[0])


def repeated_runs(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """Later copies of runs of min_words words or more, each against the earliest place that has its first min_words words: doc_id, line
    (among the document's lines with words, from 0), lines (how far the two agree), copies (places with those first words), source_doc_id,
    source_line. Rows equal in doc_id and text give their runs once."""
    scratch = Scratch(documents.sparkSession, "line-runs")
    return _runs(*_ranked_windows(documents, min_words, scratch), scratch).drop("h")


def _deleted(documents: DataFrame, gone: DataFrame) -> DataFrame:
    whole = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
    )
    text = F.col("row.text")
    found = gone.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), *[c for c in gone.columns if c not in ("doc_id", "h")])
    more = [c for c in gone.columns if c not in ("doc_id", "h", "gone")]
    joined = whole.join(found.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), "left").select("row", "gone", *more)
    n_lines = F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0)).cast("long")
    numbered = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), _lines(text)).alias("lines"), n_lines.alias("n_lines"), *more)
    worded = F.filter(F.transform("lines", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    pick = lambda w: F.flatten(F.transform("gone", lambda g: F.slice(w, g["from"] + 1, g["size"])))
    marked = numbered.select("row", "lines", "n_lines", F.when(F.col("gone").isNotNull(), F.transform(F.array(worded), pick)[0]).alias("deleted"), *more)
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("deleted"))
    return marked.select(
        "row",
        F.when(F.col("deleted").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("text"),
        "n_lines",
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
        *more,
    )


def line_dedup(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """documents(doc_id, text, ...) -> (row: all input columns as a struct, text: what stays, n_lines, deleted: numbers of the deleted lines)."""
    scratch = Scratch(documents.sparkSession, "line-dedup")
    return _deleted(documents, scratch.save(later_copies(documents, min_words, scratch)))


def line_report(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (line numbers from 0), kept (false if only copies were there), text_sha256 of what stays, and of its
    `repeated_runs` their number n_runs, longest_run (lines) and most_copies (zeros without a run)."""
    scratch = Scratch(documents.sparkSession, "line-dedup")
    repeated, first, levels = _ranked_windows(documents, min_words, scratch)
    runs = _runs(repeated, first, levels, scratch).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_runs"), F.max("lines").alias("longest_run"), F.max("copies").alias("most_copies"))
    runs = scratch.save(runs.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), "n_runs", "longest_run", "most_copies"))
    gone = _later(repeated)
    gone = gone.join(runs.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), "left")
    gone = scratch.save(gone.select("doc_id", "h", "gone", "n_runs", "longest_run", "most_copies"))
    out = _deleted(documents, gone)
    empty = ~_has_word(F.col("text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        F.size("deleted").cast("long").alias("n_deleted"),
        "deleted",
        F.coalesce((F.size("deleted") == 0) | ~empty, F.lit(True)).alias("kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        zero("n_runs"),
        zero("longest_run"),
        zero("most_copies"),
    )


def without_copies(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents, all columns, without lines that are later copies; those of which nothing is left go. A column n_chars follows the text.

    A null text stays null and its row stays; repeated rows each stay or go alike; an empty table gives no rows."""
    out = line_dedup(documents, min_words).filter((F.size("deleted") == 0) | _has_word(F.col("text")))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
