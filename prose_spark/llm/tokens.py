"""Token ids of whole texts by public tokenizers, fast: words are looked up, unknown words are encoded once.

word_bpe_49k never merges across white space, which it drops; so a text's ids are its words' ids in order. Words
here are split at blank and newline only: what else the tokenizer calls white space stays inside a word and is
handled by the tokenizer itself. The tables of words are bounded, which changes no result. A tokenizer of any other
make reads whole texts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: A word of Latin letters with closing punctuation: one run of letters, then one run of marks, for the tokenizer too.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]*)").fullmatch


def byte_letters() -> dict[int, str]:
    """What byte-level tokenizers write for the UTF-8 bytes of the letters from U+00DF to U+00FF."""
    spare = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    sign = {b: chr(256 + spare.index(b)) if b in spare else chr(b) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes."""

    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.by_word = self._drops_blanks(path)
        self.letters = byte_letters()
        self.marks: dict[str, bytes] = {"": b""}
        self.more: dict[str, bytes] = {}

    @staticmethod
    def _drops_blanks(path: str) -> bool:
        """Whether the tokenizer's parts are those for which words can be encoded by themselves: blanks removed, lower case, word ends marked."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        normal = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
        before = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        removes = len(before) == 2 and before[0]["type"] == "Split" and before[0]["behavior"] == "Removed" and before[0]["invert"] and "^\\s" in before[0]["pattern"].get("Regex", "")
        return normal == ["NFC", "Replace", "Lowercase"] and removes and before[1]["type"] == "ByteLevel" and made["model"].get("end_of_word_suffix") == "</w>"

    def _slow(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        got = self.more.get(word)
        if got is not None:
            return got
        if plain := PLAIN(word.lower()):
            run, marks = plain.groups()
            if marks not in self.marks:
                self.marks[marks] = self._slow(marks)
            ids = [t.id for t in self.model.tokenize(run if run.isascii() else run.translate(self.letters))]
            got = b"".join([i.to_bytes(4, "little") for i in ids]) + self.marks[marks]
        else:
            got = self._slow(word)
        # The first words met, which are mostly the frequent ones, stay; the rest live in a table that is emptied.
        if len(self) < self.LIMIT:
            self[word] = got
        else:
            if len(self.more) >= self.LIMIT // 10:
                self.more.clear()
            self.more[word] = got
        return got

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process and file."""
    return WordIds(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
