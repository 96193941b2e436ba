"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: over the word shingles of the ASCII-lower-cased text, repeats included, a bit is 1 if it is
set in over half of the shingles' XXH64 values (seed 42). Fewer words than a shingle: the whole sequence is
the one shingle; no words: fingerprint zero.

Candidates: each of the 64 bit positions gets a non-zero vector of radius+1 bits; each non-zero vector v
of radius+1 bits gives a table whose mask keeps the positions with an odd inner product with v. The
positions in which two fingerprints differ, `radius` at most, are orthogonal to some v, so that the pair
agrees under that mask: every pair within the radius meets in some table (Pagh, CoveringLSH). Only distinct
fingerprints are hashed, once each.

Links inside a bucket: a bucket of at most `bucket` members is compared in one task, which gives a spanning forest of
its pairs within the radius, never the pairs themselves. A larger bucket is not gathered: its members are hashed again,
under a second covering with other vectors, into buckets within the bucket, and so on. As any covering brings a
pair within the radius together, nothing is lost; members of one bucket agree in more bits at each level, so that
few different fingerprints can remain. Nothing is capped.

Near dedup (`near_dedup`) takes the same covering for candidates, over several fingerprints of a text's words, and compares the shingles of
every candidate pair exactly inside its bucket before any two texts are linked.

Components: links are contracted by repeated minimum-neighbour steps (large-star, small-star), with a table
written to the shared folder after every round.

Defined cases: null text has no words; a null doc_id is kept, is smaller than any other as component_id;
rows that repeat a doc_id each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def vote(features: Iterable[bytes]) -> int:
    """The fingerprint of features, repeats counted; read in stretches, so that a long text's are never held at once."""
    votes, total, digest, features = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest, iter(features)
    while len(h := np.fromiter((digest(s, 42) for s in islice(features, 4096)), np.uint64)):
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(votes * 2 > total, bitorder="little").tobytes(), "little")


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _runs(words: list[bytes], size: int) -> Iterable[bytes]:
    """Shingles of so many words, repeats included; of fewer words, all of them as one; of none, none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return vote(_runs(_words(text), shingle))


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, level: int = 0, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks. Positions take the non-zero vectors in turn, so that masks keep about as many bits each;
    further levels deal the positions out anew."""
    turns = list(range(bits))
    if level:
        turns = [int(i) for i in np.random.default_rng(level).permutation(bits)]
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in turns]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (i, j) between places of an array of fingerprints that connect what pairs within the radius connect: each
    member to its nearest earlier member of every component that it meets."""
    if len(fps) == 2:
        return [(1, 0)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    label = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        away = np.bitwise_count(fps[:i] ^ fps[i])
        near = np.nonzero(away <= radius)[0]
        if not len(near):
            continue
        near = near[np.argsort(away[near], kind="stable")]
        met, at = np.unique(label[near], return_index=True)
        out += [(i, int(near[k])) for k in at]
        label[i] = met[0]
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    return out


def link_fingerprints(fps: DataFrame, radius: int, scratch: Scratch, bucket: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what pairs within the radius connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column("all"):
                own = np.sort(row.values.to_numpy())
                for i, j in forest(own.view(np.uint64), radius):
                    a.append(int(own[i]))
                    b.append(int(own[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows, links = fps.select("fp", F.lit(0).cast("long").alias("key")), []
    for level in count():
        masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, level)])
        keyed = rows.select("fp", "key", F.posexplode(masks).alias("table", "mask"))
        keyed = keyed.select("fp", F.xxhash64(F.lit(level), "key", "table", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        # Sizes first, by map-side counts: no bucket is gathered before its size is known.
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = scratch.save(sizes.select(F.col("key").alias("_key"), "n"))
        met = scratch.save(keyed.join(sizes.hint("shuffle_merge"), F.col("key") == F.col("_key")).select("key", "fp", "n"))
        small = met.filter(F.col("n") <= bucket)
        links.append(small.groupBy("key").agg(F.collect_list("fp").alias("all")).select("all").mapInArrow(run, "a long, b long").distinct())
        rows = met.filter(F.col("n") > bucket).select("fp", "key")
        if rows.isEmpty():  # different fingerprints: each level leaves a bucket about half as many bits to differ in
            break
    return reduce(DataFrame.unionByName, links).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node of the component; nodes without links are left out."""
    edges = scratch.save(links.select("a", "b").filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large-star: larger neighbours of a node go to the least of its neighbourhood
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        low = scratch.save(low.withColumnRenamed("a", "c"))  # a join of two plain exchanges can be split where one node has many neighbours
        large = both.join(low.hint("shuffle_merge"), F.col("a") == F.col("c")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: smaller neighbours of a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "c").hint("shuffle_merge"), F.col("a") == F.col("c"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = scratch.save(small)
        now, then = (t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for t in (after, edges))
        scratch.drop(edges, low)
        edges = after
        if now == then:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(documents: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id; one row per input row."""
    scratch = Scratch(documents.sparkSession, "simhash")
    rows = scratch.save(fingerprints(documents, shingle))
    # One node per distinct fingerprint, named by its smallest document.
    nodes = scratch.save(rows.groupBy("fp").agg(F.min(F.struct("doc_id")).alias("first")).select("fp", F.col("first.doc_id").alias("first")))
    links = scratch.save(link_fingerprints(nodes.select("fp"), radius, scratch))
    member = components(links, scratch)
    rooted = nodes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min(F.struct("first")).alias("least")).select(F.col("root").alias("_root"), F.col("least.first").alias("component_id"))
    named = rooted.join(ids.hint("shuffle_merge"), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    out = rows.join(named.hint("shuffle_merge"), F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_prints(words: list[bytes], prints: int) -> list[int]:
    """Independent 64-bit fingerprints of a bag of words, each word weighted by the root of its count. Texts with most of their
    five-word shingles in common have nearly the same words, and so differ in a few bits; shingles themselves would differ in ten."""
    bag = Counter(words)
    weights = np.rint(16 * np.sqrt(np.fromiter(bag.values(), np.float64, len(bag))))
    votes = np.zeros((prints, 64))
    features = iter(bag)
    for at in range(0, len(bag), 4096):
        own = weights[at : at + 4096]
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in islice(features, 4096)), np.uint64, len(own))
        for p in range(prints):
            x = h + np.uint64(p * 0x9E3779B97F4A7C15 % 2**64)
            if p:
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            votes[p] += own @ np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    return [int.from_bytes(np.packbits(v * 2 > weights.sum(), bitorder="little").tobytes(), "little") for v in votes]


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted 32-bit hashes of the different shingles."""
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, _runs(words, size)), "<u4"))


def _canonical(fps: np.ndarray, radius: int, earlier: np.ndarray) -> np.ndarray:
    """Which members of a bucket have a partner within the radius that no earlier table has brought them together with."""
    i, j = np.triu_indices(len(fps), 1)
    away = fps[i] ^ fps[j]
    near = np.bitwise_count(away) <= radius
    i, j, away = i[near], j[near], away[near]
    for m in earlier:
        if not len(away):
            break
        fresh = (away & m) != 0
        i, j, away = i[fresh], j[fresh], away[fresh]
    return np.unique(np.concatenate([i, j]))


def candidate_buckets(fps: DataFrame, radius: int, scratch: Scratch, bucket: int = 512) -> DataFrame:
    """Different fingerprints (print, fp) -> (bucket, print, fp) so that any two of one print within the radius are in one bucket together;
    members without such a partner are left out, as are those whose partners all meet them in an earlier table."""
    levels: list[DataFrame] = []
    rows = fps.select("print", "fp", F.lit(0).cast("long").alias("key"))
    for level in count():
        masks = covering_masks(radius, level)
        # Each row becomes a row per table: tasks are dealt by what comes out, which no size of what comes in tells.
        rows = rows.repartition(max(1, rows.count() * len(masks) // 2_000_000), "fp")
        tables = F.array(*[F.lit(_signed(m)) for m in masks])
        keyed = rows.select("print", "fp", "key", F.posexplode(tables).alias("table", "mask"))
        keyed = keyed.select("print", "fp", "table", F.xxhash64(F.lit(level), "print", "key", "table", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = scratch.save(sizes.select(F.col("key").alias("_key"), "n"))
        met = scratch.save(keyed.join(sizes.hint("shuffle_merge"), F.col("key") == F.col("_key")).drop("_key"))
        every = np.array(masks, np.uint64)

        def run(batches: Iterator[pa.RecordBatch], every: np.ndarray = every) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, prints, tables = (batch.column(c).to_numpy() for c in ("key", "print", "table"))
                out: list[tuple[int, int, np.ndarray]] = []
                for k, p, t, all_ in zip(keys.tolist(), prints.tolist(), tables.tolist(), batch.column("all")):
                    own = np.sort(all_.values.to_numpy()).view(np.uint64)
                    if len(own) == 2:  # most are
                        away = own[0] ^ own[1]
                        if int(away).bit_count() > radius or t and ((every[:t] & away) == 0).any():
                            continue
                    elif len(stay := _canonical(own, radius, every[:t])):
                        own = own[stay]
                    else:
                        continue
                    out.append((k, p, own))
                n = [len(o) for _, _, o in out]
                flat = np.concatenate([o for _, _, o in out]).view(np.int64) if out else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([k for k, _, _ in out], np.int64), n)), pa.array(np.repeat(np.array([p for _, p, _ in out], np.int32), n)), pa.array(flat)], ["bucket", "print", "fp"]
                )

        small = met.filter(F.col("n") <= bucket).groupBy("key", "print", "table").agg(F.collect_list("fp").alias("all"))
        levels.append(scratch.save(small.mapInArrow(run, "bucket long, print int, fp long")))
        rows = met.filter(F.col("n") > bucket).select("print", "fp", "key")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _verified(units: DataFrame, radius: int, least: float) -> DataFrame:
    """units(unit, side, cross, node, fp, set) -> links (a, b) that connect exactly what pairs of one unit connect whose fingerprints are within the radius
    and whose sets have a Jaccard similarity of `least`; of crossing units, pairs of two sides. Pairs that are connected by then aren't compared."""

    def similar(u: np.ndarray, v: np.ndarray) -> bool:
        if min(len(u), len(v)) < least * max(len(u), len(v)):
            return False
        both = len(np.intersect1d(u, v, assume_unique=True))
        return both >= least * (len(u) + len(v) - both)

    def links(members: list[tuple[int, int, bool, int, bytes]]) -> Iterator[tuple[int, int]]:
        members.sort(key=lambda m: m[0])
        fps = np.array([m[3] for m in members], np.int64).view(np.uint64)
        sides, cross = np.array([m[1] for m in members]), members[0][2]
        sets = [np.frombuffer(m[4], "<u4") for m in members]
        label = np.arange(len(members))
        for i in range(1, len(members)):
            away = np.bitwise_count(fps[:i] ^ fps[i])
            near = np.nonzero((away <= radius) & (sides[:i] != sides[i]) if cross else away <= radius)[0]
            for j in near[np.argsort(away[near], kind="stable")].tolist():
                if label[i] != label[j] and similar(sets[i], sets[j]):
                    label[label == label[i]] = label[j]
                    yield members[i][0], members[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members = None, []
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            found: list[tuple[int, int]] = []
            for u, *member in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "side", "cross", "fp", "set"))):
                if u != unit:
                    found += links(members) if len(members) > 1 else []
                    unit, members = u, []
                members.append(tuple(member))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
        found = list(links(members)) if len(members) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.select("unit", "node", "side", "cross", "fp", "set").mapInArrow(run, "a long, b long")


def _units(buckets: DataFrame, members: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Buckets of fingerprints and the nodes that have them (print, fp, node) -> (unit, side, cross, node, fp): a bucket of at most `most` nodes is a unit.
    A larger one, where many texts share fingerprints, is dealt into blocks; each block, and each two of them, are a unit."""
    twins = members.groupBy("print", "fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twins = twins.select(F.xxhash64(F.lit("same"), "print", "fp").alias("bucket"), "print", "fp")
    # Written first: a join of two plain exchanges can be split where one fingerprint has many nodes.
    all_ = scratch.save(buckets.unionByName(twins)).select("bucket", F.col("print").alias("_print"), F.col("fp").alias("_fp"))
    rows = members.join(all_.hint("shuffle_merge"), (F.col("print") == F.col("_print")) & (F.col("fp") == F.col("_fp")))
    rows = scratch.save(rows.select("bucket", "node", "fp"))
    sizes = scratch.save(rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.count(F.lit(1)).alias("n")))
    rows = rows.join(sizes.hint("shuffle_merge"), F.col("bucket") == F.col("_bucket")).withColumn("blocks", F.ceil(F.col("n") / most).cast("long"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))
    return rows.select(unit.alias("unit"), "side", (F.col("side") != F.col("other")).alias("cross"), "node", "fp")


def near_links(documents: DataFrame, shingle: int, similarity: float, radius: int, prints: int, scratch: Scratch, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): node, doc_id, h (of the smallest row that has it); links connect nodes whose shingles have that similarity.

    A node is a text's sequence of lower-cased words, named by its hash; copies are one node."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = list(map(_words, part.column("text").to_pylist()))
                node = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
                fps = np.array([word_prints(w, prints) for w in words], np.uint64).reshape(-1, prints).view(np.int64)
                own = pa.FixedSizeListArray.from_arrays(pa.array(fps.ravel()), prints).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(node), own], ["doc_id", "h", "node", "fps"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(_words(t), shingle).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    texts = documents.select(*_row_key(), F.col("text").cast("string").alias("text"))
    rows = scratch.save(texts.mapInArrow(read, "doc_id long, h long, node long, fps array<long>"))
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("fps").alias("fps"))
    nodes = scratch.save(nodes.select("node", "first.doc_id", "first.h", "fps"))
    members = scratch.save(nodes.select("node", F.posexplode("fps").alias("print", "fp")))
    buckets = candidate_buckets(scratch.save(members.select("print", "fp").distinct()), radius, scratch)
    units = scratch.save(_units(buckets, members, most, scratch))

    wanted = nodes.join(units.select(F.col("node").alias("_node")).distinct().hint("shuffle_merge"), F.col("node") == F.col("_node"))
    wanted = scratch.save(wanted.select("node", F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h")))
    # No hint: while they are few, Spark may send these rows to the texts; else both sides are shuffled.
    whole = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")))
    sets = scratch.save(whole.select("node", "text").mapInArrow(gather, "node long, set binary").dropDuplicates(["node"]))
    placed = units.join(sets.withColumnRenamed("node", "_node").hint("shuffle_merge"), F.col("node") == F.col("_node"))
    return nodes, scratch.save(_verified(placed, radius, similarity))


def _row_key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]


def near_dedup(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, prints: int = 3) -> DataFrame:
    """The documents' own columns; of each group the row with the smallest doc_id stays, once.

    A group is connected by pairs of texts whose different shingles have that Jaccard similarity. Candidates are texts of which one of
    `prints` fingerprints of the words is within the radius; every such pair's shingles are compared before it may link.

    Null and empty texts, and those without a word, are one group; a null doc_id is the smallest; of rows equal in doc_id and text
    one stays; of rows that tie in doc_id the smaller hash of the text stays; an empty table gives no rows."""
    scratch = Scratch(documents.sparkSession, "near-dedup")
    nodes, links = near_links(documents, shingle, similarity, radius, prints, scratch)
    member = components(links, scratch).withColumnRenamed("node", "_node")
    placed = nodes.join(member.hint("shuffle_merge"), F.col("node") == F.col("_node"), "left")
    ids = lambda: [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h"]
    stay = placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "h")).alias("at")).select("at.doc_id", "at.h")
    stay = scratch.save(stay.select(*ids()))
    own = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), *_row_key()).select("row", *ids())
    kept = own.dropDuplicates(["no_id", "id", "h"]).join(stay.hint("shuffle_merge"), ["no_id", "id", "h"])
    return kept.select(*[F.col("row")[c].alias(c) for c in documents.columns])
