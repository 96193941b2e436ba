"""Quality rules with tokeniser fertility: what a public vocabulary makes of a text.

The words of a text are encoded by a vocabulary with byte fallback. Three measures follow: characters per token (few:
the vocabulary finds no words; very many: a few long pieces again and again), the share of tokens that are raw
bytes, and the entropy of the text's tokens in bits, divided by what as many different tokens would have
(but no more than 1,024 of them: a long text can't go on finding new ones).
Each script has its band, which `fit_bands` narrows by all labelled documents; a text outside its script's
band is rejected, after the base rules. The script is that of most letters; texts without letters are script `none` and have no band.

Base rules: fewer than 50 words, or over half of the words in three-word windows that the text holds twice or more.

Defined cases: null text has no words; a null doc_id is carried; repeated rows are judged each; an empty table gives no
rows; other columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import tokenizer_path


class Band(NamedTuple):
    least_chars: float  # characters per token
    most_chars: float
    most_bytes: float  # share of byte-fallback tokens
    least_entropy: float  # share of the largest possible


#: Different tokens that a text of any length is expected to reach.
DISTINCT = 1024

#: By script. Vocabularies made mostly from Latin text cut others finer and fall back to bytes more often.
BANDS = {
    "latin": Band(1.2, 8.0, 0.10, 0.45),
    "greek": Band(0.7, 6.0, 0.30, 0.40),
    "cyrillic": Band(0.8, 7.0, 0.20, 0.40),
    "arabic": Band(0.5, 6.0, 0.50, 0.40),
    "han": Band(0.25, 4.0, 0.85, 0.35),
    "kana": Band(0.3, 4.0, 0.75, 0.35),
    "hangul": Band(0.25, 4.0, 0.90, 0.35),
    "other": Band(0.2, 8.0, 1.00, 0.30),
}

#: Letters' code points by script, first and last.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}


def script_of(text: str) -> str:
    """The script of most letters, `other` for those of no listed script; the first listed of equals; `none` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points, times = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), return_counts=True)
    letters = np.fromiter((chr(p).isalpha() for p in points.tolist()), bool, len(points))
    points, times = points[letters], times[letters]
    below = np.concatenate([[0], np.cumsum(times)])
    count = {s: sum(int(below[np.searchsorted(points, b, "right")] - below[np.searchsorted(points, a)]) for a, b in r) for s, r in RANGES.items()}
    count["other"] = int(below[-1]) - sum(count.values())
    best = max(count, key=count.get)
    return best if count[best] else "none"


class Pieces(dict):
    """Word -> the ids of its pieces, as little-endian unsigned 16- or 32-bit bytes. Bounded like the other tables of words."""

    LIMIT = 400_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.more: dict[bytes, bytes] = {}
        self.type = np.dtype("<u2" if size <= 65536 else "<u4")
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The pieces of these words; those that aren't known are encoded in one call. The first words met, mostly the frequent ones,
        stay; the rest live in a table that is emptied."""
        new = [w for w in words if w not in self and w not in self.more]
        ids = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else []
        got = {w: np.array(i, self.type).tobytes() for w, i in zip(new, ids)}
        if len(self) + len(got) <= self.LIMIT:
            self.update(got)
        else:
            if len(self.more) + len(got) > self.LIMIT // 4:
                self.more = {w: self.more[w] for w in words if w in self.more}
            self.more |= got
        if not self.more:
            return self
        return {w: self[w] if w in self else self.more[w] for w in words}


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            seen.add(line)
    return len(words), chars, symbols, lines - len(seen), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that come twice or more. Words and windows are numbered exactly, eight bytes each."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(ids):
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:  # three such numbers don't fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    twice = np.isin(windows, again)
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def fertility(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share, entropy share; zeros without tokens."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    count = np.unique(ids, return_counts=True)[1]
    entropy = np.log2(n) - float((count * np.log2(count)).sum()) / n
    return chars / n, float(is_byte[ids].mean()), min(1.0, entropy / np.log2(min(n, DISTINCT))) if n > 1 else 1.0


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", "n_tokens", "chars_per_token", "byte_share", "entropy_share"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy_share double"


def measures(documents: DataFrame, vocabulary: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> counts, the base rules' verdict and measures, a row per row."""
    file = path or tokenizer_path(vocabulary)

    def measure(text: str | None, words: list[bytes], ids: np.ndarray, is_byte: np.ndarray) -> tuple:
        base = base_counts(text or "", words)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        return (*base, failed, script_of(text or ""), len(ids), *fertility(ids, base[1], is_byte))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column("text").to_pylist()
                split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
                table = model.learn(set().union(*split)).__getitem__
                rows = [measure(t, w, np.frombuffer(b"".join(map(table, w)), model.type), model.is_byte) for t, w in zip(texts, split)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows))], NAMES)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def judged(measured: DataFrame, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of `measures` with the verdict: `kept` passes the base rules and lies in its script's band."""
    inside = F.lit(False)
    for script, b in bands.items():
        chars = F.col("chars_per_token").between(b.least_chars, b.most_chars)
        inside |= (F.col("script") == script) & chars & (F.col("byte_share") <= b.most_bytes) & (F.col("entropy_share") >= b.least_entropy)
    return measured.select(*NAMES[:7], (~F.col("base_failed") & inside).alias("kept"), *NAMES[7:])


def quality(documents: DataFrame, vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] = BANDS, path: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> counts, verdicts and measures, a row per row."""
    return judged(measures(documents, vocabulary, path), bands)


def quantiles(values: DataFrame, shares: dict[str, list[float]], least: int = 1, bins: int = 1024) -> dict[str, dict[tuple[str, float], float]]:
    """values(script, the names in `shares`) -> for each script of `least` rows or more, {(name, share): quantile}: what `percentile` gives, from all rows.

    No task holds the values of a script: they are counted in `bins` between the least and the largest, and the bins with the wanted ranks
    divided anew until they hold one value each. The driver gets a row per bin that isn't empty."""
    long = values.unpivot("script", list(shares), "name", "value")
    found: dict[tuple, float] = {}
    count = {}
    spans = []  # script, name, least and largest value, how many values lie below, the ranks that lie inside
    for script, name, n, low, high in long.groupBy("script", "name").agg(F.count("value"), F.min("value"), F.max("value")).collect():
        if n >= least:
            count[script] = n
            spans.append((script, name, low, high, 0, {r for q in shares[name] for r in (int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1))}))
    while spans:
        found |= {(script, name, r): low for script, name, low, high, _, ranks in spans if low == high for r in ranks}
        spans = [s for s in spans if s[2] < s[3]]
        if not spans:
            break
        value = F.col("value")
        place = [
            F.when(
                (F.col("script") == script) & (F.col("name") == name) & value.between(low, high),
                F.struct(F.lit(i).alias("span"), F.least(F.floor((value - low) / F.lit(high - low) * bins), F.lit(bins - 1)).alias("bin")),
            )
            for i, (script, name, low, high, *_) in enumerate(spans)
        ]
        rows = long.select("value", F.coalesce(*place).alias("at")).filter("at is not null").groupBy("at.span", "at.bin")
        below = [s[4] for s in spans]
        inner = []
        for i, _, n, low, high in sorted(rows.agg(F.count("value"), F.min("value"), F.max("value")).collect()):
            script, name, *_, ranks = spans[i]
            if here := {r for r in ranks if below[i] <= r < below[i] + n}:
                inner.append((script, name, low, high, below[i], here))
            below[i] += n
        spans = inner
    out: dict[str, dict[tuple[str, float], float]] = {s: {} for s in count}
    for script, n in count.items():
        for name, q in ((name, q) for name, qs in shares.items() for q in qs):
            r = int((n - 1) * q)
            low, high = found[script, name, r], found[script, name, min(r + 1, n - 1)]
            out[script][name, q] = low + ((n - 1) * q - r) * (high - low)
    return out


def fit_bands(measured: DataFrame, labels: DataFrame, bands: dict[str, Band] = BANDS, lost: float = 0.005, edge: float = 0.001, least: int = 50) -> dict[str, Band]:
    """The bands, narrowed by script to what good documents show: the entropy floor is what all but `lost` of them reach; characters per token and
    the byte share stay within all but `edge` of them at either end, with a tenth (bytes: two hundredths) of room.

    Good documents are all rows of `measured` (see `measures`) that labels(doc_id, quality) calls 1 and the base rules pass; a script
    with fewer than `least` of them keeps its band."""
    scratch = Scratch(measured.sparkSession, "bands")
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id"))
    fit = measured.filter(~F.col("base_failed") & F.col("script").isin(*bands)).join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    shares = {"entropy_share": [lost], "chars_per_token": [edge, 1 - edge], "byte_share": [1 - edge]}
    fit = scratch.save(fit.select("script", *shares))
    out = dict(bands)
    for script, q in quantiles(fit, shares, least).items():
        b = bands[script]
        low, high = q["chars_per_token", edge], q["chars_per_token", 1 - edge]
        out[script] = Band(max(b.least_chars, 0.9 * low), min(b.most_chars, 1.1 * high), min(b.most_bytes, q["byte_share", 1 - edge] + 0.02), max(b.least_entropy, q["entropy_share", lost]))
    scratch.drop(fit)
    return out


def fitted_quality(documents: DataFrame, labels: DataFrame, vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] = BANDS, path: str | None = None) -> DataFrame:
    """`quality` under the bands that all labelled documents give. Texts are measured once, into a scratch table that the result reads."""
    measured = Scratch(documents.sparkSession, "quality").save(measures(documents, vocabulary, path))
    return judged(measured, fit_bands(measured, labels, bands))
