"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change adds, removes or revises one document's count. As signed amounts (+new, -old, both) changes are additive, so a
batch is summed by key, with a map-side combine, and only these sums are written: one folder per batch id under
the rollup's folder. Totals are sums over batches; no document is counted again.

Commits are idempotent: a batch folder with Spark's success marker is done, and committing its id again does nothing; one
without it is a broken attempt, is never read and is written anew. `compact` sums committed batches into one base folder that
lists their ids, so that a late repeat of an old batch still does nothing.

Defined cases: null source, lang or tokenizer are keys of their own; null counts are 0; null text counts 0 tokens and one
document; keys whose documents and tokens are all taken back are left out of the totals; an empty table gives
no rows; a null doc_id counts like any other; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import tokenizer_path, word_ids

KEY = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, tokens long, docs long"


def count_tokens(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """documents(doc_id, source, lang, text) -> doc_id, source, lang, tokens, n_bytes."""
    file = path or tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [len(x) // 4 for x in coder.encode_all(part.column("text").to_pylist())]
                cols = [*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(tokens, pa.int64()), part.column("n_bytes")]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "lang", "tokens", "n_bytes"])

    text = F.col("text").cast("string")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long, n_bytes long")


def inserted(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Signed changes for documents that come in. rows: source, lang and a column of counts."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"), F.lit(1).cast("long").alias("docs"))


def deleted(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Signed changes for documents that go, by the counts they came with."""
    return inserted(rows, tokenizer, tokens).withColumns({"tokens": -F.col("tokens"), "docs": -F.col("docs")})


def revised(rows: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Signed changes for documents whose count was wrong: the difference, and no document."""
    amount = F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0))
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), amount.cast("long").alias("tokens"), F.lit(0).cast("long").alias("docs"))


class Rollup:
    """The rollup in one folder of a shared store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def _done(self, name: str) -> bool:
        return self._exists(f"{self.folder}/{name}/{'batches/' if name.startswith('base-') else ''}_SUCCESS")

    def _folders(self) -> list[str]:
        """Committed folders, batches and bases alike."""
        if not self._exists(self.folder):
            return []
        return [n for n in sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))) if self._done(n)]

    def _absorbed(self, names: list[str]) -> set[str]:
        """Which of these folders' sums the bases hold. The ids of all batches ever stay in their tables."""
        bases = [f"{self.folder}/{n}/batches" for n in self._folders() if n.startswith("base-")]
        if not bases or not names:
            return set()
        return {r[0] for r in self.spark.read.schema("id string").parquet(*bases).filter(F.col("id").isin(names)).distinct().collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if that id is in already."""
        if not batch or "/" in batch or batch.startswith(("base-", "_", ".")):
            raise ValueError(f"not a batch id: {batch!r}")
        if self._done(batch) or self._absorbed([batch]):
            return False
        sums = changes.groupBy(*KEY).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        return True

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}{'/sums' if n.startswith('base-') else ''}" for n in folders])
        return rows.groupBy(*KEY).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))

    def _live(self) -> list[str]:
        """Folders to sum: a batch that a base holds too (a compaction broken off before its clean-up) counts once."""
        names = self._folders()
        done = self._absorbed(names)
        return [n for n in names if n not in done]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, tokens, docs of all committed batches."""
        return self._sum(self._live()).filter("tokens <> 0 or docs <> 0")

    def compact(self, name: str) -> bool:
        """Sum what is committed into base-<name>, then remove what it sums up; False if that base is there already. The sums are written
        first, the ids after them: a base without its ids is a broken attempt, is never read and is written anew."""
        base = f"base-{name}"
        if self._done(base):
            return False
        old = self._live()
        self._sum(old).write.mode("overwrite").parquet(f"{self.folder}/{base}/sums")
        ids = self.spark.createDataFrame([(n,) for n in old], "id string")
        for n in (n for n in self._folders() if n.startswith("base-")):
            ids = ids.unionByName(self.spark.read.schema("id string").parquet(f"{self.folder}/{n}/batches"))
        ids.distinct().write.mode("overwrite").parquet(f"{self.folder}/{base}/batches")
        for n in old:
            self._fs.delete(self._path(f"{self.folder}/{n}"), True)
        return True


def rollup_report(documents: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The life of a corpus in four batches, the second delivered twice: every document comes in with an estimate of a
    token per four bytes; counts by the tokenizer replace the estimates; counts are revised by one for the end
    token; documents without a token of their own are deleted. Returns the totals after that."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "token-rollup")
    guess = F.ceil(F.col("n_bytes") / 4).cast("long")
    counts = scratch.save(count_tokens(documents, tokenizer).withColumns({"guess": guess, "ended": F.col("tokens") + 1}))
    version, first = tokenizer.rpartition(".")[0], "bytes-by-4"
    book = Rollup(spark, f"{scratch.root}/rollup")
    counted = deleted(counts, first, "guess").unionByName(inserted(counts, version))
    book.commit("load", inserted(counts, first, "guess"))
    book.commit("recount", counted)
    book.commit("recount", counted)
    book.commit("end-token", revised(counts, version, "tokens", "ended"))
    book.commit("no-words", deleted(counts.filter("tokens = 0"), version, "ended"))
    return book.totals()
