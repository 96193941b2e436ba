"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words in
proportion; a target stops at three times its source's size and what it leaves is shared by weight among the others
(the water level is that of the first source, sorted by size over weight, that it does not fill up).

A source's documents are put in the order of a seeded hash and their words laid end to end. This line is cut into blocks of
a fixed number of words. A source of size n and target t gives every block floor(t / n) times and, in a last
pass, as many blocks more as its target asks for, in the order of a seeded permutation of its blocks (the last one drawn is cut to the word). These
draws are its quota. The tree's root holds every source's quota; each node splits its quotas between two halves of the
shards by a multivariate-hypergeometric draw, seeded by the node's place, and a leaf takes from each source as many of the permuted draws
as its quota says, next to those of the leaf before: disjoint, and exact in sum. A shard's pieces are shuffled by a
seeded hash, `turn`.

No task holds all sources: at every node of the tree the draw goes down a second tree, over the sources, from the sum of
all to the single one; a source's task needs its own quota and the sums of the siblings on its path. Subtrees
without a draw of the source are left out, and a source's walk is spread over the subtrees. Draws from more than 10^9 balls are put together from
binomial ones, exactly.

Places on the line come from two sums: within small hash buckets, and over the buckets of a source; so a source
that holds a third of all rows is never in one task.

Defined cases: null text has size 0 and is never taken; null doc_ids are carried; repeated rows are taken each; null is a
source of its own; an empty table gives no rows; other columns are ignored (`mixed_documents` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, word_count


def targets(sized: DataFrame, limit: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sized(source, size) -> a row per source: source, s (its number), source_size, target. Windows run over sources, not rows."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("s", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", F.col("source_size") * limit).withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", "s")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    by = by.withColumn("water", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every))
    return by.select("source", "s", "source_size", F.least("cap", F.col("weight") * F.col("water")).alias("target"))


def _placed(documents: DataFrame, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row per document with its place on its source's line, and the sources."""
    sized = scratch.save(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
        )
    )
    sources = scratch.save(targets(sized))
    rows = sized.count()
    bits = max(0, int(rows // 500).bit_length())
    mixed = F.xxhash64("doc_id", "h", F.lit(seed))
    bucket = F.shiftrightunsigned(mixed, 64 - bits) if bits else F.lit(0).cast("long")
    known = sources.select(F.col("source").alias("_source"), "s", "source_size", "target")
    dealt = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns({"key": mixed, "bucket": bucket})
    sums = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.save(sums.select(F.col("s").alias("_s"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base")))
    inside = Window.partitionBy("s", "bucket").orderBy(F.shiftleft(F.col("key"), 1), "key", "doc_id", "h")
    counted = dealt.withColumns({"nth": F.row_number().over(inside), "run": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = counted.join(sums.hint("shuffle_merge"), (F.col("s") == F.col("_s")) & (F.col("bucket") == F.col("_bucket")))
    return scratch.save(placed.select("s", "bucket", "nth", "doc_id", "h", "size", "source_size", "target", (F.col("base") + F.col("run") - F.col("size")).alias("place"))), sources


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good balls among `draws` of good + bad. numpy's own takes fewer than 10^9 of each: beyond that every ball is drawn
    or not by itself, with the share that is wanted, and what is too many or too few, about the root of it, is drawn in turn."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    if draws < 64:
        got = 0
        for n in range(draws):
            got += int(rng.integers(good + bad - n) < good - got)
        return got
    share = draws / (good + bad)
    g, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    if g + b <= draws:
        return g + hypergeometric(rng, good - g, bad - b, draws - g - b)
    return g - hypergeometric(rng, g, b, g + b - draws)


def permuted(places: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Where a seeded permutation of 0 .. count - 1 takes these places: a Feistel network of four rounds on as many bits as
    count needs, applied again while it leads out of the range. Any place can be asked for without the others."""
    half = np.uint64(max(1, -(-(max(1, count - 1)).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            mixed = (right + np.uint64((seed * 4 + r) % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return left << half | right

    out = once(places.astype(np.uint64))
    while (away := out >= np.uint64(max(1, count))).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def _drawn(first: int, count: int, size: int, take: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pass, block, words) of a source's draws first .. first + count - 1. The short last block of a line comes last in its pass."""
    n_blocks = -(-size // block)
    draws = first + np.arange(count, dtype=np.int64)
    turn, place = draws // n_blocks, draws % n_blocks
    number = place.copy()
    for t in np.unique(turn):
        own = (turn == t) & (place < n_blocks - 1)
        number[own] = permuted(place[own], n_blocks - 1, seed + int(t))
    words = np.minimum(block, size - number * block)
    last = take // size  # the pass that is taken in part
    return turn, number, np.where(turn == last, np.minimum(words, take - last * size - place * block), words)


def _walk(seed: int, number: int, root: list[int], depth: int, top: int, index: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first draw, draws) of one source below the node `index` at depth `top`. root: quotas of the source and of the nodes
    around it in the tree over the sources, up to the sum of all."""

    def split(at: int, place: int, counts: list[int]) -> list[int]:
        """What the left half gets of each of these counts."""
        left = [0] * len(counts)
        left[-1] = counts[-1] - counts[-1] // 2
        for level in range(len(counts) - 2, -1, -1):
            own, other, draws = counts[level], counts[level + 1] - counts[level], left[level + 1]
            right_hand = (number >> level) & 1  # the draw is for the even child, whichever holds this source
            rng = np.random.default_rng([seed, at, place, level, number >> (level + 1)])
            even = hypergeometric(rng, *((other, own) if right_hand else (own, other)), draws)
            left[level] = draws - even if right_hand else even
        return left

    counts, first = root, 0
    for at in range(top):
        left = split(at, index >> (top - at), counts)
        if index >> (top - at - 1) & 1:
            counts, first = [c - x for c, x in zip(counts, left)], first + left[0]
        else:
            counts = left
    stack = [(top, index, counts, first)]
    while stack:
        at, place, counts, first = stack.pop()
        if not counts[0]:
            continue
        if at == depth:
            yield place, first, counts[0]
            continue
        left = split(at, place, counts)
        stack.append((at + 1, 2 * place + 1, [c - x for c, x in zip(counts, left)], first + left[0]))
        stack.append((at + 1, 2 * place, left, first))


def shard_blocks(quotas: DataFrame, shards: int, seed: int, block: int) -> DataFrame:
    """quotas(s, size, take, quota) -> (s, pass, block, words, shard): the draws of every source, each in one shard."""
    depth = shards.bit_length() - 1
    top = max(0, depth - 8)  # a row of work is the 256 shards, or fewer, below one node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, size, take, root, item in zip(*(batch.column(c).to_pylist() for c in ("s", "size", "take", "around", "item"))):
                for shard, first, count in _walk(seed, s, root, depth, top, item):
                    cols = _drawn(first, count, size, take, block, seed * 1000 + s * 10)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(count, s)), *map(pa.array, cols), pa.array(np.full(count, shard))], ["s", "pass", "block", "words", "shard"])

    n = (quotas.agg(F.max("s")).first()[0] or 0) + 1
    path = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1).bit_length()))).alias("level")
    above = quotas.select("s", "quota", path).withColumn("node", F.expr("shiftright(s, level)"))
    sums = above.groupBy("level", "node").agg(F.sum("quota").alias("total"))
    around = above.join(sums, ["level", "node"]).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("level", "total")))["total"].alias("around"))
    work = quotas.join(around, "s").filter("quota > 0").withColumn("item", F.explode(F.sequence(F.lit(0), F.lit((1 << top) - 1))))
    tasks = max(1, min(n << top, 2 * quotas.sparkSession.sparkContext.defaultParallelism))
    return work.repartition(tasks, "s", "item").select("s", "size", "take", "around", "item").mapInArrow(run, "s long, pass long, block long, words long, shard long")


def mix(documents: DataFrame, seed: int = 17, block_words: int = 4096, shard_blocks_each: int = 256) -> tuple[DataFrame, DataFrame]:
    """(placed documents, pieces). A piece is what one shard takes of a document in one pass: first word, words, shard
    and `turn`, by which a shard's pieces are shuffled locally."""
    scratch = Scratch(documents.sparkSession, "mixing")
    placed, sources = _placed(documents, seed, scratch)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = 1 << max(0, -(-total // (block_words * shard_blocks_each)) - 1).bit_length()
    quotas = sources.select(F.col("s").cast("long").alias("s"), F.col("source_size").cast("long").alias("size"), F.round("target").cast("long").alias("take")).filter("size > 0")
    each = f"(take div size) * ceil(size / {block_words}) + ceil((take % size) / {block_words})"
    blocks = scratch.save(shard_blocks(scratch.save(quotas.withColumn("quota", F.expr(each).cast("long"))), shards, seed, block_words))

    key = ["s", "bucket", "nth"]
    spread = F.explode(F.expr(f"sequence(place div {block_words}, (place + size - 1) div {block_words})")).alias("block")
    laid = placed.filter("size > 0").select(*key, "doc_id", "h", "place", "size", spread)
    drawn = blocks.select(F.col("s").alias("_s"), F.col("block").alias("_block"), "pass", "words", "shard")
    met = laid.join(drawn.hint("shuffle_merge"), (F.col("s") == F.col("_s")) & (F.col("block") == F.col("_block")))
    begin = F.col("block") * block_words
    low, high = F.greatest("place", begin), F.least(F.col("place") + F.col("size"), begin + F.col("words"))
    pieces = met.filter(low < high).select(*key, "doc_id", "h", "pass", "block", (low - F.col("place")).alias("first"), (high - low).alias("words"), "shard")
    return placed, pieces.withColumn("turn", F.xxhash64("doc_id", "h", "pass", "block", F.lit(seed + 1)))


def mix_report(documents: DataFrame, **how: int) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard (of the first piece of the first pass that takes one; null if none), n_shards:
    a row per document, the untaken too."""
    placed, pieces = mix(documents, **how)
    own = ["s", "bucket", "nth"]
    keep = {"doc_id": "long", "size": "long", "source_size": "long", "target": "double"}
    rows = placed.select(*own, *keep, F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(c) for c in ("pass", "block", "shard")])
    more = pieces.select(*own, *[F.lit(None).cast(t).alias(c) for c, t in keep.items()], "words", "pass", "block", "shard")
    out = rows.unionByName(more).groupBy(*own)
    at = F.min(F.when(F.col("shard").isNotNull(), F.struct("pass", "block", "shard")))["shard"]
    out = out.agg(*[F.max(c).alias(c) for c in keep], F.sum("words").alias("taken"), at.alias("first_shard"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"))
    return out.select(*keep, "taken", "first_shard", "n_shards")


def mixed_documents(documents: DataFrame, **how: int) -> DataFrame:
    """The mix as rows of `documents`, all columns: each shard's rows together, in their shuffled order.

    What a pass takes of a document is one row where its pieces adjoin (whole documents, nearly always) and goes to the shard of the first of
    them; the text is cut to these words and n_chars follows it. Null and empty texts are never taken; repeated rows are taken each; rows equal in
    doc_id and text share one of them as their source of other columns; an empty table gives no rows."""
    _, pieces = mix(documents, **how)
    own = ["s", "bucket", "nth", "pass"]
    up_to = Window.partitionBy(*own).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("island", F.col("first") - F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    begin = F.min(F.struct("first", "shard", "turn")).alias("at")
    taken = pieces.groupBy(*own, "island", "doc_id", "h").agg(F.sum("words").alias("words"), begin)
    ids = lambda: [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h"]
    taken = taken.select(*ids(), "words", F.col("at.first").alias("first"), F.col("at.shard").alias("shard"), F.col("at.turn").alias("turn"))
    row = F.struct(*[documents[c] for c in documents.columns]).alias("row")
    whole = documents.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    whole = whole.select("row", *ids()).dropDuplicates(["no_id", "id", "h"])
    joined = whole.join(taken.hint("shuffle_merge"), ["no_id", "id", "h"])
    joined = joined.select("row", "words", "first", "shard", "turn").repartition("shard").sortWithinPartitions("shard", "turn")
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    part = F.rtrim(F.array_join(F.slice(words, F.col("first").cast("int") + 1, F.col("words").cast("int")), ""))
    text = F.when(F.col("words") == word_count(text), text).otherwise(part)
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
