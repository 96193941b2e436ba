"""Exact dedup by deterministic block naming, in DataFrame functions alone.

A document is the byte string of its text after lower-casing A-Z. It is cut into blocks of a fixed
number of bytes. Equal blocks are brought together, sorted and given one integer name; then adjacent
names are paired and each distinct pair gets one integer name, until a document has a single name. Two
documents of one block count have the same last name if and only if their bytes are equal: names come
from comparing contents, so no two contents can share one.

Rows equal in doc_id and SHA-256 are counted as one document first, so that no row is gathered more often than its document. The
contents of blocks travel once, to be compared: blocks of one content get one name, and where all blocks of one 64-bit hash are
found to have the same content, documents look the name up by the hash; where not, by the bytes.

A block (or pair) that occurs once in the corpus needs no name: its document equals no other and leaves.
So what goes on from level to level is only what could still be a copy.

Defined cases: null text counts as empty; a null doc_id is a value of its own and the smallest; rows equal
in doc_id and text are copies of each other (each gives a row, one of them stays); an empty table gives
no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower


#: The right half of a pair that has none; no name is this.
NOTHING = -(2**63)


def _blocks(binary: Column, size: int) -> Column:
    """The blocks of a binary, the last one shorter; at least one. The lambda binds the binary so that it is made once."""
    return F.element_at(
        F.transform(
            F.array(binary),
            lambda b: F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(b) - 1) / size).cast("int"))),
                lambda i: F.substring(b, i * size + 1, F.lit(size)),
            ),
        ),
        1,
    )


def _named(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """rows with key columns -> rows with `name` instead; rows whose key occurs once are left out.

    Counting combines before its shuffle. The join has each key once on the names' side, so the rows of a
    hot key can be split over tasks by the adaptive skew join."""
    names = scratch.save(
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("uses"))
        .filter("uses > 1")
        .sortWithinPartitions(*key)
        .select(*[F.col(k).alias(f"_{k}") for k in key], F.monotonically_increasing_id().alias("name"))
    )
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    return rows.join(names.hint("shuffle_merge"), same).drop(*key, *[f"_{k}" for k in key])


def _gathered(rows: DataFrame) -> DataFrame:
    """(d, n_blocks, width, pos, name) -> a row per document of which every place has a name."""
    got = rows.groupBy("d", "n_blocks", "width").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("got"))
    return got.filter(F.size("got") == F.col("width")).select("d", "n_blocks", F.col("got.name").alias("names"))


def _block_names(docs: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(d, hashes), blocks(doc_id, text_sha256, pos, hash, block) -> (d, n_blocks, width, pos, name) of blocks that occur twice or more."""
    contents = blocks.groupBy("hash", "block").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("hash", "block")
    contents = scratch.save(contents.select("hash", F.monotonically_increasing_id().alias("name")))
    kinds = contents.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.min("name").alias("name"))
    n = F.size("hashes")
    rows = docs.select("d", n.alias("n_blocks"), n.alias("width"), F.posexplode("hashes").alias("pos", "hash"))
    uses = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    names = scratch.save(uses.join(kinds.hint("shuffle_merge"), "hash").select(F.col("hash").alias("_hash"), "name", "kinds"))
    found = rows.join(names.hint("shuffle_merge"), F.col("hash") == F.col("_hash"))
    plain = found.filter("kinds = 1").select("d", "n_blocks", "width", "pos", "name")
    clash = names.filter("kinds > 1").select("_hash")
    if clash.isEmpty():
        return plain
    # Several contents of one hash: these blocks' bytes are brought to their documents. Names below zero are theirs.
    ids = docs.select("d", F.col("doc_id").alias("_doc_id"), F.col("text_sha256").alias("_sha"), n.alias("n_blocks"), n.alias("width"))
    bytes_ = blocks.join(clash, F.col("hash") == F.col("_hash"))
    bytes_ = bytes_.join(ids, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_sha256") == F.col("_sha")))
    bytes_ = scratch.save(bytes_.select("d", "n_blocks", "width", "pos", "block").distinct())
    return plain.unionByName(_named(bytes_, ["block"], scratch).withColumn("name", -1 - F.col("name")))


def exact_dedup(documents: DataFrame, block_bytes: int = 1024, hash_bits: int = 64) -> DataFrame:
    """documents(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256; one row per input row. hash_bits shortens blocks' hashes,
    which changes no result (fewer make clashes, for tests)."""
    scratch = Scratch(documents.sparkSession, "exact-dedup")
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    source = documents.select("doc_id", norm.alias("norm"))
    digest = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits)
    light = source.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(_blocks(F.col("norm"), block_bytes), digest).alias("hashes"))
    docs = light.groupBy("doc_id", "text_sha256", "hashes").agg(F.count(F.lit(1)).alias("copies"))
    docs = scratch.save(docs.withColumn("d", F.monotonically_increasing_id()))
    cut = source.select("doc_id", "norm", F.posexplode(_blocks(F.col("norm"), block_bytes)).alias("pos", "block"))
    blocks = cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "pos", digest(F.col("block")).alias("hash"), "block")
    open_ = scratch.save(_gathered(_block_names(docs, blocks, scratch)))

    done = [open_.filter(F.size("names") == 1)]
    longest = open_.agg(F.max(F.size("names"))).first()[0] or 1
    while longest > 1:
        width = F.ceil(F.size("names") / 2).cast("int")
        pairs = (
            open_.filter(F.size("names") > 1)
            .select("d", "n_blocks", width.alias("width"), F.col("names").alias("all"), F.explode(F.sequence(F.lit(0), width - 1)).alias("pos"))
            .select("d", "n_blocks", "width", "pos", F.get("all", F.col("pos") * 2).alias("left"), F.coalesce(F.get("all", F.col("pos") * 2 + 1), F.lit(NOTHING)).alias("right"))
        )
        open_ = scratch.save(_gathered(_named(pairs, ["left", "right"], scratch)))
        done.append(open_.filter(F.size("names") == 1))
        longest = (longest + 1) // 2

    ends = reduce(DataFrame.unionByName, done).select(F.col("d").alias("_d"), "n_blocks", F.element_at("names", 1).alias("name"))
    ends = scratch.save(docs.select("d", "doc_id", "copies").join(ends.hint("shuffle_merge"), F.col("d") == F.col("_d")).drop("_d"))
    groups = ends.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # Written first: a join of two plain exchanges can be split where one group holds many rows.
    groups = scratch.save(groups.select(F.col("n_blocks").alias("_n"), F.col("name").alias("_name"), "keep_id", "group_size"))
    member = ends.join(groups.hint("shuffle_merge"), (F.col("n_blocks") == F.col("_n")) & (F.col("name") == F.col("_name")))
    joined = docs.join(member.select(F.col("d").alias("_d"), "keep_id", "group_size"), F.col("d") == F.col("_d"), "left")
    alone = F.col("_d").isNull()
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.col("copies")).alias("group_size"),
        ((alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
