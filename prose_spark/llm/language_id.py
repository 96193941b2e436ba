"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Text is read as UTF-8 bytes in windows of a fixed length. One network reads a window forwards and one backwards; both
states at a position give probabilities for that position, so every byte of every text is labelled. A document's
probabilities are the means over its positions; the largest is its language and its score.

Training sees a bounded sample: of each language, `docs_per_lang` documents with the smallest hashes of their ids, a stretch of
`sample_bytes` of each, at most `max_docs` documents in all. It uses text and lang only, of documents with
crc32(doc_id) mod 4 other than 2. Seeds are fixed, so reruns give the same network.

Defined cases: a text that is null or has no letter is `und` with score 0; if nothing can be learnt, all are `und`; a null
doc_id hashes as the empty string; repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Superscripts, fractions and Roman numeral signs are no letters."""
    return bool(text) and any(map(str.isalpha, text))


class ByteGru:
    """Two gated recurrent networks of `hidden` units over windows of bytes, and a softmax on both states.

    Gates in the order update, reset, candidate. Sigmoids are written as (1 + tanh) / 2, with the half folded
    into the weights. Arrays are feature-major: (features, windows)."""

    def __init__(self, labels: list[str], hidden: int = 8, window: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden, self.window = labels, hidden, window
        h, f = hidden, np.float32
        self.w = {}
        for d in "fb":
            self.w[f"E{d}"] = rng.normal(0, 0.3, (3 * h, 256)).astype(f)
            self.w[f"U{d}"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(f)
            self.w[f"V{d}"] = rng.normal(0, 1 / np.sqrt(h), (len(labels), h)).astype(f)
        self.w["c"] = np.zeros((len(labels), 1), f)

    def _scan(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at every position, (window, hidden, n); x: (window, n) bytes. Backwards for d == "b"."""
        h, n = self.hidden, x.shape[1]
        table, u = self.w[f"E{d}"], self.w[f"U{d}"]
        state = np.zeros((h, n), np.float32)
        states, tape = np.empty((len(x), h, n), np.float32), []
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            a = np.take(table, x[t], axis=1)
            rec = u @ state
            gates = a[: 2 * h]
            gates += rec[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r, c = gates[:h], gates[h:], rec[2 * h :]
            cand = r * c
            cand += a[2 * h :]
            np.tanh(cand, out=cand)
            before, new = state, states[t]
            np.subtract(state, cand, out=new)
            new *= z
            new += cand
            state = new
            if keep:
                tape.append((t, before, z, r, c, cand))
        return states, tape

    def _logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.matmul(self.w["Vf"], f)
        out += np.matmul(self.w["Vb"], b)
        out += self.w["c"]
        return out

    def loss_and_gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all real positions and its gradients. x, real: (window, n); y: (n,) label numbers."""
        h, n = self.hidden, x.shape[1]
        runs = {d: self._scan(x, d, True) for d in "fb"}
        logits = self._logits(runs["f"][0], runs["b"][0])
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        weight = (real / max(1, real.sum())).astype(np.float32)
        loss = float(-(np.log(p[:, y, np.arange(n)] + 1e-9) * weight).sum())
        p[:, y, np.arange(n)] -= 1
        p *= weight[:, None, :]
        g = {"c": p.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            states, tape = runs[d]
            g[f"V{d}"] = np.einsum("tkn,thn->kh", p, states)
            up = np.matmul(self.w[f"V{d}"].T, p)
            u, gu = self.w[f"U{d}"], np.zeros_like(self.w[f"U{d}"])
            da = np.empty((len(x), 3 * h, n), np.float32)
            carry = np.zeros((h, n), np.float32)
            for t, before, z, r, c, cand in reversed(tape):
                dh = up[t] + carry
                dcand = dh * (1 - z) * (1 - cand * cand)
                # (1 + tanh(a)) / 2 has the slope 2 s (1 - s) in a
                dz = dh * (before - cand) * 2 * z * (1 - z)
                dr = dcand * c * 2 * r * (1 - r)
                rec = np.concatenate([dz, dr, dcand * r])
                da[t, :h], da[t, h : 2 * h], da[t, 2 * h :] = dz, dr, dcand
                gu += rec @ before.T
                carry = dh * z + u.T @ rec
            ge = np.zeros((256, 3 * h), np.float32)
            np.add.at(ge, x.ravel(), da.transpose(0, 2, 1).reshape(-1, 3 * h))
            g[f"E{d}"], g[f"U{d}"] = ge.T, gu
        return loss, g

    def train(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 128, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches of windows, balanced over labels. x, real: (windows, window); y: (windows,)."""
        rng = np.random.default_rng(seed)
        rows = [np.nonzero(y == k)[0] for k in range(len(self.labels))]
        rows = [r for r in rows if len(r)]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, max(1, batch // len(rows))) for r in rows])
            loss, g = self.loss_and_gradients(np.ascontiguousarray(x[pick].T), real[pick].T, y[pick])
            now = rate * (1 - step / (steps + 1)) ** 0.5
            for k, v in self.w.items():
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                v -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def position_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities summed over the real positions of each window: (windows, labels). windows: (n, window) bytes."""
        x = np.ascontiguousarray(windows.T)
        p = self._logits(self._scan(x, "f", False)[0], self._scan(x, "b", False)[0])
        np.exp(p, out=p)
        real = np.arange(self.window)[:, None] < lengths[None, :]
        p *= (real / p.sum(axis=1))[:, None, :]
        return p.sum(axis=0).T

    def predict(self, texts: list[str | None], at_once: int = 1024) -> np.ndarray:
        """Document probabilities, (texts, labels); zeros where there is nothing to read."""
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        size = self.window
        counts = np.array([-(-len(b) // size) for b in raw], np.int64)
        out = np.zeros((len(raw), len(self.labels)))
        flat = np.frombuffer(b"".join(b.ljust(int(c) * size, b"\0") for b, c in zip(raw, counts)), np.uint8).reshape(-1, size)
        owner = np.repeat(np.arange(len(raw)), counts)
        total = np.array([len(b) for b in raw], np.int64)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        lengths = np.minimum(size, total[owner] - nth * size)
        for at in range(0, len(flat), at_once):
            part = slice(at, at + at_once)
            np.add.at(out, owner[part], self.position_sums(flat[part], lengths[part]))
        return out / np.maximum(1, total)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(documents: DataFrame, docs_per_lang: int = 150, sample_bytes: int = 1024, max_docs: int = 6000) -> list[tuple[str, str]]:
    """(lang, stretch of text): bounded by its parameters whatever the size of the corpus."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    start = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.greatest(F.lit(1), F.length("text") - sample_bytes)).cast("int") + 1
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("order"), F.substring(F.col("text"), start, F.lit(sample_bytes)).alias("part"))
    rows = rows.filter(F.col("part").rlike(r"\p{L}"))
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order", "part"))).filter(F.col("nth") <= docs_per_lang)
    return [(r[0], r[1]) for r in best.orderBy("nth", "lang").limit(max_docs).select("lang", "part").collect()]


def fit(documents: DataFrame, hidden: int = 8, window: int = 64, steps: int = 240, **sample: int) -> ByteGru | None:
    """A network trained on the sample; None if the sample is empty."""
    rows = sorted(training_sample(documents, **sample))
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    x, real, y = [], [], []
    for lang, part in rows:
        raw = part.encode("utf-8", "replace")
        for at in range(0, len(raw), window):
            piece = raw[at : at + window]
            x.append(np.frombuffer(piece.ljust(window, b"\0"), np.uint8))
            real.append(np.arange(window) < len(piece))
            y.append(labels.index(lang))
    model = ByteGru(labels, hidden, window)
    model.train(np.array(x), np.array(real), np.array(y), steps=steps)
    return model


def predict(documents: DataFrame, model: ByteGru | None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, held_out, lang_pred, score, n_positions (bytes labelled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column("text").to_pylist()
                known = np.array([has_letter(t) for t in texts])
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model is not None and known.any():
                    p = model.predict([t if k else None for t, k in zip(texts, known)])
                    best = p.argmax(axis=1)
                    lang = [model.labels[b] if k else UNKNOWN for b, k in zip(best, known)]
                    score = np.clip(np.where(known, p.max(axis=1), 0), 0, 1)
                size = [len(t.encode("utf-8", "replace")) if k else 0 for t, k in zip(texts, known)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(size, pa.int64())],
                    ["doc_id", "held_out", "lang_pred", "score", "n_positions"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_positions long")


def identify(documents: DataFrame, **how: int) -> DataFrame:
    """Train on the table, then predict every row of it."""
    return predict(documents, fit(documents, **how))


def accepted(documents: DataFrame, model: ByteGru | None = None, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language can be told: they have a letter, and one language holds over `least` of the probability.

    Null texts and those without a letter go; where nothing can be learnt (no labelled documents) every text with a letter stays;
    repeated rows stay or go alike; a null doc_id changes nothing; an empty table gives no rows."""
    model = model or fit(documents)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [t if has_letter(t) else None for t in part]
            if model is None:
                yield pd.Series([float(t is not None) for t in texts], dtype="float64")
            else:
                yield pd.Series(np.concatenate([model.predict(texts[at : at + 128]).max(axis=1) for at in range(0, len(texts), 128)]) if texts else [], dtype="float64")

    return documents.filter(score(F.col("text").cast("string")) > least)
