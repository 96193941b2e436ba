"""Packing by vector bin packing with the dot-product heuristic.

A sequence has three capacities: tokens, segments and loss-bearing tokens. Each item (a document, or what is
left of one) has a demand for each. A sequence is filled by taking, again and again, the item that fits and has
the largest inner product between its demands and what the sequence has left, both as shares of capacity. When
nothing more fits whole, the item with the largest product is cut to fill the gap; its rest stays an item.

Each task packs the documents of its own partition, in one pass and without a shuffle, from a pool of bounded
size. What is left when the partition ends is closed at powers of two, which need no padding. A sequence's id is made
of the partition's number and a counter, so a repeated task gives the same ids.

Defined cases: null and empty texts are the end token alone; a null doc_id is carried; rows that repeat a doc_id are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer_path, word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Items in, finished sequences out. An item: [document, first token, tokens left, first loss-bearing token]."""

    def __init__(self, tokens: int = 4096, segments: int = 256, loss: int | None = None):
        self.caps = (tokens, segments, tokens if loss is None else loss)
        self.pool: list[list[int]] = []

    @staticmethod
    def _loss(start: int, length: int, since: int) -> int:
        return max(0, start + length - max(start, since))

    def _most(self, item: list[int], room: int, loss: int) -> int:
        """Tokens of the item that fit into what is left of tokens and of loss-bearing tokens."""
        _, start, length, since = item
        return min(length, room, max(0, since - start) + loss)

    def add(self, document: int, length: int, since: int = 0) -> None:
        self.pool.append([document, 0, length, since])

    def fill(self, last: bool) -> Iterator[list[tuple[int, int, int, int]]]:
        """Sequences of (document, start, length, loss), until less than a sequence is left; `last`: until nothing is."""
        cap_t, cap_s, cap_l = self.caps
        doc, start, left, since = (np.array(c, np.int64) for c in (zip(*self.pool) if self.pool else ((), (), (), ())))
        total = int(left.sum())
        while total >= cap_t or last and total:
            room, slots, loss = cap_t, cap_s, cap_l
            demand = np.maximum(0, start + left - np.maximum(start, since))
            pieces: list[tuple[int, int, int, int]] = []

            def take(i: int, n: int) -> None:
                nonlocal room, slots, loss, total
                x = self._loss(int(start[i]), n, int(since[i]))
                pieces.append((int(doc[i]), int(start[i]), n, x))
                start[i] += n
                left[i] -= n
                demand[i] -= x
                room, slots, loss, total = room - n, slots - 1, loss - x, total - n

            while room and slots and total:
                score = left * (room / cap_t**2) + (slots / cap_s**2) + demand * (loss / cap_l**2)
                open_ = left > 0
                fits = open_ & (left <= room) & (demand <= loss)
                if slots == 1:  # the last segment has to fill the gap
                    fits &= left == room
                if fits.any():
                    i = int(np.argmax(np.where(fits, score, -1)))
                    take(i, int(left[i]))
                    continue
                most = np.where(open_, np.minimum(np.minimum(left, room), np.maximum(0, since - start) + loss), 0)
                if not (top := int(most.max())):
                    break
                take(int(np.argmax(np.where(most == top, score, -1))), top)
            if not pieces:
                raise ValueError("capacities must be positive")
            yield from self._closed(pieces, doc, start, left, cap_t, last or room > 0)
            total = int(left.sum())
            if (gone := left == 0).sum() > len(left) // 2:
                doc, start, left, since = (c[~gone] for c in (doc, start, left, since))
        keep = left > 0
        self.pool = [list(map(int, x)) for x in zip(doc[keep], start[keep], left[keep], since[keep])]

    @staticmethod
    def _closed(pieces: list, doc: np.ndarray, start: np.ndarray, left: np.ndarray, cap: int, short: bool) -> Iterator[list]:
        """A full sequence as it is; a short one cut at powers of two, largest first. Order inside is kept."""
        used = sum(p[2] for p in pieces)
        if not short or used == cap:
            yield pieces
            return
        queue = pieces[::-1]
        while used:
            size = 1 << (used.bit_length() - 1)
            used -= size
            out = []
            while size:
                d, s, n, x = queue.pop()
                if n > size:
                    y = max(0, x - (n - size))  # loss-bearing tokens are a piece's last ones
                    queue.append((d, s + size, n - size, x - y))
                    n, x = size, y
                out.append((d, s, n, x))
                size -= n
            yield out


def pack(
    documents: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    tokens: int = 4096,
    segments: int = 256,
    loss_tokens: int | None = None,
    loss_from: str | None = None,
    pool_documents: int = 1024,
    path: str | None = None,
) -> DataFrame:
    """documents(doc_id, text[, loss_from]) -> a row per piece. loss_from names a column with the index of a
    document's first loss-bearing token (none: all bear loss). A pool holds that many documents before it is packed."""
    file = path or tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(file)
        packer = Packer(tokens, segments, loss_tokens)
        texts: dict[int, tuple[int | None, bytes]] = {}
        end, number, base = end_id.to_bytes(4, "little"), 0, TaskContext.get().partitionId() << 40
        seen = 0

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(8)]
            for pieces in packer.fill(last):
                at = 0
                for d, s, n, x in pieces:
                    key, ids = texts[d]
                    for c, v in zip(out, (key, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]), len(ids) // 4, base + number, at, x)):
                        c.append(v)
                    at += n
                number += 1
            live = {p[0] for p in packer.pool}
            for d in [d for d in texts if d not in live]:
                del texts[d]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                since = part.column("since").to_pylist()
                for key, ids, first in zip(part.column("doc_id").to_pylist(), coder.encode_all(part.column("text").to_pylist()), since):
                    texts[seen] = (key, ids + end)
                    packer.add(seen, len(ids) // 4 + 1, first or 0)
                    seen += 1
                if len(packer.pool) >= pool_documents:
                    yield rows(False)
        if seen:
            yield rows(True)

    since = F.col(loss_from).cast("long") if loss_from else F.lit(None).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), since.alias("since")).mapInArrow(run, SCHEMA)
