"""What Arrow passes share."""

import random
import zlib

import numpy as np
import pyarrow as pa

from prose_spark.functions.arrow import pieces, window_crcs


def test_window_crcs_are_those_of_each_window():
    rng = random.Random(1)
    for size in (1, 2, 3, 7, 20, 21):
        for letters in ("abc", "aé漢𠀀"):
            for n in (0, size - 1, size, size + 1, 90):
                text = "".join(rng.choice(letters) for _ in range(n))
                begins, ends, crcs = window_crcs(np.frombuffer(text.encode(), np.uint8), size)
                windows = [text[i : i + size].encode() for i in range(n - size + 1)]
                assert crcs.tolist() == [zlib.crc32(w) for w in windows]
                assert (ends - begins).tolist() == [len(w) for w in windows]


def test_pieces_are_small_and_whole():
    texts = ["x" * n for n in (5, 0, 70, 300, 1, 2, 90)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    got = list(pieces([batch, batch.slice(0, 0)], 128))
    assert [x for b in got for x in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or b.nbytes <= 128 for b in got) and len(got) > 3


class Caught:
    """Stands for a table, and keeps the function that is to go over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def most_rows(self, **columns):
        """The most rows that came out at once."""
        batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
        return max(b.num_rows for b in self.run(iter([batch])))


TURNS = ["The first server needs 30 ms. The second part must not fail!\n\n- Use `x` for API calls (see https://a.b/c). Really? Yes."] * 4000


def test_item_pass_works_on_pieces_and_leaves_sentences_out(spark):
    from prose_spark.operators import comparison

    n = len(TURNS)
    assert comparison.parsed(Caught()).most_rows(pair_id=range(n), side=["before"] * n, text=TURNS) < n // 2
    pairs = spark.createDataFrame([(1, TURNS[0], "API and 5 ms. " + TURNS[0])], "pair_id long, before string, after string")
    only = comparison.parsed(pairs, want=("items",))
    assert only.filter("sentences is not null").count() == 0
    assert sorted(comparison.item_changes(only).collect()) == sorted(comparison.item_changes(comparison.parsed(pairs)).collect()) != []


def test_alignment_works_on_pieces(spark):
    from prose_spark.operators import comparison

    n = len(TURNS)
    sentences = 3 * 2  # of a pair
    assert comparison.aligned(Caught()).most_rows(pair_id=range(n), before=TURNS, after=TURNS) < sentences * n // 2
    turns = [(1, TURNS[0], "It must fail. " + TURNS[0]), (2, "", "One. Two."), (3, None, "Is it?"), (4, "Same here.", "Same here.")]
    pairs = spark.createDataFrame(turns, "pair_id long, before string, after string")
    canon = lambda df: sorted(map(repr, df.drop("markers", "met").collect()))
    one, two = comparison.aligned(pairs), comparison.alignment(comparison.parsed(pairs))
    assert canon(one) == canon(two) != []
    assert canon(comparison.marker_changes(one)) == canon(comparison.marker_changes(two))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_markdown_works_on_pieces(spark):
    from prose_spark.sources import markup

    n = 20 * len(TURNS)
    texts = TURNS * 20
    assert markup.rows_of(Caught(), "text", markup.markdown_rows).most_rows(doc_id=range(n), body=texts) < n


def test_sentences_work_on_pieces(spark):
    from prose_spark.operators import readability

    n = 20 * len(TURNS)
    assert readability.split_blocks(Caught()).most_rows(doc_id=range(n), text=TURNS * 20, md=[True] * n) < n
