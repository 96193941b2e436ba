"""Preservation of text, structure checks and literal search."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from ..functions import prose
from ..functions import text as T
from ..functions.arrow import pieces


def preserved(pairs: DataFrame, context: int = 20) -> DataFrame:
    """pairs(pair_id, before, after) -> equality modulo blanks, sizes, paragraphs and where the first difference is.

    The common prefix is found by bisection on prefixes, so the work per pair is a few comparisons of strings."""
    a, b = T.without_blanks(F.col("before")), T.without_blanks(F.col("after"))
    base = pairs.select("pair_id", a.alias("a"), b.alias("b"), T.paragraphs(F.col("before")).alias("before_paragraphs"), T.paragraphs(F.col("after")).alias("after_paragraphs"))
    size = F.least(F.length("a"), F.length("b"))
    probe = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2.0), 30 - k).cast("int")),
        F.lit(0),
        lambda at, step: F.when((at + step <= size) & (F.substring(F.col("a"), at + 1, step) == F.substring(F.col("b"), at + 1, step)), at + step).otherwise(at),
    )
    same = F.col("a") == F.col("b")
    place = F.when(~same, probe + 1)
    cut = lambda c: F.when(~same, F.substring(F.col(c), F.greatest(F.lit(1), F.col("position") - context), F.least(F.lit(context), F.col("position") - 1) + context))
    return base.withColumn("position", place).select(
        "pair_id",
        same.alias("identical"),
        F.length("a").alias("before_chars"),
        F.length("b").alias("after_chars"),
        "before_paragraphs",
        "after_paragraphs",
        "position",
        cut("a").alias("before_context"),
        cut("b").alias("after_context"),
    )


def newline_insertions(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, before, after) -> whether newlines were inserted and nothing else was done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [prose.only_newlines_inserted(a or "", b or "") for a, b in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist())]
            names = ["only_newlines_inserted", "non_newline_identical", "newlines_removed", "inserted_newlines"]
            cols = [pa.array([r[n] for r in rows], pa.int64() if n == names[3] else pa.bool_()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), *cols], ["pair_id", *names])

    kept = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "before", "after")
    return kept.mapInArrow(run, "pair_id long, only_newlines_inserted boolean, non_newline_identical boolean, newlines_removed boolean, inserted_newlines long")


def brackets(documents: DataFrame) -> DataFrame:
    """Bracket findings: doc_id, check_id, line, column, text, expected, opening_line, opening_column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for kind, at, ch, expected, opening in prose.bracket_findings(text or ""):
                    rows.append((doc, f"BRACKET-{kind}", *prose.place(text, at), ch, expected, *(prose.place(text, opening) if opening is not None else (None, None))))
            cols = list(zip(*rows)) or [[]] * 8
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = ["doc_id", "check_id", "line", "column", "text", "expected", "opening_line", "opening_column"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    # A text without any bracket never reaches Python.
    some = documents.filter(F.col("text").rlike(f"[{''.join('\\' + c for c in ''.join(prose.BRACKETS) + ''.join(prose.BRACKETS.values()))}]"))
    return some.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, check_id string, line int, column int, text string, expected string, opening_line int, opening_column int"
    )


def in_order(findings: DataFrame) -> DataFrame:
    """Bracket findings by document, line and column; those without an opening come after those with one."""
    return findings.orderBy("doc_id", "line", "column", F.col("opening_line").asc_nulls_last(), F.col("opening_column").asc_nulls_last(), "check_id")


def bracket_balance(documents: DataFrame) -> DataFrame:
    """Openings and closings of each document, all kinds together."""
    cls = lambda chars: "[" + "".join("\\" + c for c in chars) + "]"
    t = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.regexp_count(t, F.lit(cls(prose.BRACKETS))).alias("opened"), F.regexp_count(t, F.lit(cls(prose.BRACKETS.values()))).alias("closed"))


def code_point_counts(documents: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    total, solid = F.length(t), T.visible_length(t)
    return documents.select("doc_id", total.alias("codepoints"), (total - solid).alias("blank_codepoints"), solid.alias("solid_codepoints"), T.newline_sequences(t).alias("newlines"))


#: Literals up to this size travel to the tasks as one automaton; more are joined by hashes.
AUTOMATON_BYTES = 8_000_000
_HIT = "doc_id long, item_id long, offset int, line int, column int"


def _hits(found: list[tuple[int | None, int, int]], starts: dict[int | None, list[int]]) -> pa.RecordBatch:
    """Rows of hits (document, item, offset), placed by the starts of the document's lines."""
    line = [bisect_right(starts[doc], at) for doc, _, at in found]
    cols = [[d for d, _, _ in found], [i for _, i, _ in found], [at for _, _, at in found], line, [at - starts[d][n - 1] + 1 for (d, _, at), n in zip(found, line)]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], ["doc_id", "item_id", "offset", "line", "column"])


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def forbidden_literals(documents: DataFrame, literals: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """All occurrences, overlapping too, of literals(item_id, text): doc_id, item_id, offset, line, column.

    Lines and columns are found where the hits are: no text leaves its task. Literals of more than `most_bytes` never come
    to the driver; they are joined with hashes of the documents' windows. Both ways give the same rows."""
    literals = literals.filter(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = literals.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:
        return _joined_literals(documents, literals)
    return _searched_literals(documents, literals.groupBy("text").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).collect())


def _searched_literals(documents: DataFrame, needles: list) -> DataFrame:
    """One pass over the documents with an Aho-Corasick automaton."""
    table = [(r["text"], list(r["ids"])) for r in needles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for needle, ids in table:
            finder.add_word(needle, (len(needle), ids))
        finder.make_automaton()
        for batch in pieces(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = ((doc, i, end - n + 1) for end, (n, ids) in finder.iter(text or "") for i in ids)
                while part := list(islice(found, 50_000)):
                    yield _hits(part, {doc: _line_starts(text)})

    return documents.mapInArrow(run, _HIT) if table else documents.sparkSession.createDataFrame([], _HIT)


def _joined_literals(documents: DataFrame, literals: DataFrame, prefix: int = 12) -> DataFrame:
    """A hash join of the documents' windows with the literals' first code points, of which only ids, offsets and hashes travel; then each
    document's candidates are compared with its text."""
    sized = literals.select("item_id", F.col("text").alias("needle"), F.least(F.length("text"), F.lit(prefix)).alias("n"))
    lengths = sorted(r["n"] for r in sized.select("n").distinct().collect())  # at most `prefix` of them

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for n in lengths:
                    for at in range(0, len(text or "") - n + 1, 50_000):
                        places = range(at, min(at + 50_000, len(text) - n + 1))
                        keys = np.fromiter((xxh64_intdigest(text[i : i + n], n) for i in places), np.uint64, len(places)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array(keys)], ["doc_id", "offset", "key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxh64_intdigest(x[:n], n) for x, n in zip(batch.column("needle").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("needle"), pa.array(np.array(keys, np.uint64).view(np.int64))], ["item_id", "needle", "_key"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for doc, text, candidates in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "candidates"))):
                found = [(doc, c["item_id"], c["offset"]) for c in candidates if text.startswith(c["needle"], c["offset"])]
                if found:
                    yield _hits(found, {doc: _line_starts(text)})

    places = documents.filter(F.col("text").isNotNull())
    keys = sized.mapInArrow(hashed, "item_id long, needle string, _key long")
    met = places.mapInArrow(windows, "doc_id long, offset int, key long").join(keys, F.col("key") == F.col("_key"))
    met = met.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.collect_set(F.struct("offset", "item_id", "needle")).alias("candidates"))
    return places.join(met, F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select("doc_id", "text", "candidates").mapInArrow(compared, _HIT)


def missing_literals(documents: DataFrame, needles: list[str]) -> DataFrame:
    """Required literals that a document lacks: doc_id, text."""
    lacking = F.array_compact(F.array(*[F.when(~F.contains(F.coalesce("text", F.lit("")), F.lit(n)), F.lit(n)) for n in needles]))
    return documents.select("doc_id", F.explode(lacking).alias("text"))


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two trees of (path, sha256): missing, extra and changed paths."""
    a, b = left.select("path", F.col("sha256").alias("a")), right.select("path", F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).filter("state is not null")
