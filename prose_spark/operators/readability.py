"""Readability: documents -> blocks -> sentences -> additive counters, located candidates and pointers.

One Arrow pass finds blocks and sentences, or counts them where counters are all that is asked for; what follows is columns, windows and
aggregates. Counters add up, so corpus totals are partial sums with ratios taken last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose
from ..functions import text as T
from ..functions.arrow import pieces

COUNTERS = ["chars", "kanji", "hiragana", "paragraphs", "long_paragraphs", "sentences", "sentence_chars", "long_sentences", "short_runs", "commas"]
_SENTENCES = pa.list_(pa.struct([("sent", pa.int32()), ("offset", pa.int32()), ("line", pa.int32()), ("text", pa.string())]))
_BLOCKS = "doc_id long, block int, line int, text string, sentences array<struct<sent int, offset int, line int, text string>>"


def split_blocks(documents: DataFrame, markdown: bool | str = True) -> DataFrame:
    """documents(doc_id, text) -> a row per paragraph with its sentences. markdown: for all, or the name of a boolean column."""
    flag = F.col(markdown) if isinstance(markdown, str) else F.lit(markdown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc, text, md in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "md"))):
                for n, block in enumerate(prose.blocks(text or "", bool(md))):
                    parts = [{"sent": k, "offset": o, "line": block.line_at(o), "text": s} for k, (o, s) in enumerate(prose.sentences(block.text))]
                    for c, v in zip(out, (doc, n, block.numbers[0], block.text, parts)):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), _SENTENCES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "block", "line", "text", "sentences"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("md")).mapInArrow(run, _BLOCKS)


def sentence_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, block, sent, offset, line, text."""
    return blocks.select("doc_id", "block", F.inline("sentences"))


def _is_short(said: Column, short: int) -> Column:
    return (T.visible_length(said) < short) & T.ends_with_terminator(said)


def document_metrics(
    documents: DataFrame, markdown: bool | str = True, paragraph: int = 200, sentence: int = 46, short: int = 20, run: int = 3
) -> DataFrame:
    """A row per row of documents: all counters, zero without prose. Numbers alone leave the pass, and nothing is shuffled."""
    flag = F.col(markdown) if isinstance(markdown, str) else F.lit(markdown)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [prose.counters(t or "", bool(md), paragraph, sentence, short, run) for t, md in zip(batch.column("text").to_pylist(), batch.column("md").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * len(COUNTERS)))], ["doc_id", *COUNTERS])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("md"))
    return rows.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTERS))


def with_ratios(metrics: DataFrame) -> DataFrame:
    """Unrounded ratios; 0.0 where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return metrics.withColumns(
        {
            "kanji_ratio": over("kanji", "chars"),
            "hiragana_ratio": over("hiragana", "chars"),
            "avg_paragraph_length": over("chars", "paragraphs"),
            "avg_sentence_length": over("sentence_chars", "sentences"),
            "commas_per_sentence": over("commas", "sentences"),
        }
    )


def corpus_total(metrics: DataFrame) -> DataFrame:
    """The sum of all documents, in one row."""
    return metrics.agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def long_paragraphs(blocks: DataFrame, least: int = 200) -> DataFrame:
    n = T.visible_length(F.col("text"))
    return blocks.filter(n >= least).select("doc_id", "block", "line", n.alias("length"), T.preview(F.col("text")).alias("preview"))


def long_sentences(sentences: DataFrame, least: int = 46) -> DataFrame:
    n = T.visible_length(F.col("text"))
    return sentences.filter(n >= least).select("doc_id", "block", "sent", "line", n.alias("length"), T.preview(F.col("text")).alias("preview"))


def short_runs(blocks: DataFrame, short: int = 20, least: int = 3) -> DataFrame:
    """Runs of consecutive short sentences that end in a terminator, within a block, where they begin."""
    at = blocks.join(short_run_islands(sentence_rows(blocks), short, least).withColumnRenamed("sentences", "n"), ["doc_id", "block"])
    first, last = F.get("sentences", F.col("sent")), F.get("sentences", F.col("sent") + F.col("n").cast("int") - 1)
    body = F.substring(F.col("text"), first["offset"] + 1, last["offset"] + F.length(last["text"]) - first["offset"])
    return at.select("doc_id", "block", first["line"].alias("line"), T.visible_length(body).alias("length"), F.col("n").alias("sentences"), T.preview(body).alias("preview"))


def short_run_islands(sentences: DataFrame, short: int = 20, least: int = 3) -> DataFrame:
    """The same runs found by gaps and islands over sentence rows (doc_id, block, sent, text): start and number of sentences."""
    ok = _is_short(F.col("text"), short)
    order = Window.partitionBy("doc_id", "block").orderBy("sent")
    marked = sentences.select("doc_id", "block", "sent", ok.alias("ok")).withColumn("island", F.sum((~F.col("ok")).cast("int")).over(order))
    return marked.filter("ok").groupBy("doc_id", "block", "island").agg(F.min("sent").alias("sent"), F.count(F.lit(1)).alias("sentences")).filter(F.col("sentences") >= max(1, least)).drop("island")


def top_candidates(candidates: DataFrame, k: int, rank: str = "length", per: list[str] | None = None) -> DataFrame:
    """The k largest of each group, ties by document and place, with the number left out; k <= 0 keeps all."""
    by = Window.partitionBy(*(per or [])).orderBy(F.desc(rank), "doc_id", "line", "block")
    if k <= 0:
        return candidates.withColumn("omitted", F.lit(0).cast("long"))
    kept = candidates.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k).drop("nth")
    left = F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - k).alias("omitted")
    if per:
        return kept.join(candidates.groupBy(*per).agg(left), per)
    # Over all: a distributed top-k in place of the window, and one number for all its rows.
    kept = candidates.orderBy(F.desc(rank), "doc_id", "line", "block").limit(k).withColumn("_all", F.lit(1))
    return kept.join(candidates.agg(left).withColumn("_all", F.lit(1)), "_all").drop("_all")


def pointer_counts(sentences: DataFrame) -> DataFrame:
    """Pointers of each kind by document, by pattern matching in the JVM."""
    return sentences.groupBy("doc_id").agg(*[F.sum(T.count(F.col("text"), p)).alias(kind.replace("-", "_")) for kind, p in T.POINTERS.items()])


def pointers(documents: DataFrame, markdown: bool = True) -> DataFrame:
    """Located pointers of all five kinds: doc_id, kind, line, length, snippet."""
    import re

    patterns = {k: p.replace("\\x{20000}-\\x{2FA1F}", "\U00020000-\U0002fa1f") for k, p in T.POINTERS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: re.compile(p) for k, p in patterns.items()}
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for block in prose.blocks(text or "", markdown):
                    for offset, said in prose.sentences(block.text):
                        for kind, pattern in compiled.items():
                            for m in pattern.finditer(said):
                                a, b = max(0, m.start() - 10), min(len(said), m.end() + 10)
                                shown = ("…" if a else "") + said[a:b] + ("…" if b < len(said) else "")
                                rows.append((doc, kind, block.line_at(offset + m.start()), len(m[0]), shown))
                if markdown:
                    rows += [(doc, "unrendered-bold", *x) for x in prose.unrendered_bold(text or "")]
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "line", "length", "snippet"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, line int, length int, snippet string")
