"""Rule-table checks of notation on one text: what is protected, what rules find, how findings are classed.

Spans are intervals. Protection is a list of disjoint intervals, each with the kind that claimed it first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import cached_property
from typing import NamedTuple

# Profiles, categories, and the shapes of what is protected.
PROFILES = ("general-tech", "public-explanation", "official")
CATEGORIES = ("error", "recommendation", "needs_context", "accepted_variant", "excluded")
FLAGGED = frozenset(CATEGORIES[:3])

CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
DESTINATIONS = (re.compile(r"\]\((?P<dest>[^)\s]*)(?:\s+\"[^\"]*\")?\)"), re.compile(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]*(?P<dest>\S+)", re.M))
ADDRESS = re.compile(r"(?:https?|ftp)://[^\s<>\"'`\)\]）」』、。，．]+")
TAG = re.compile(r"</?[A-Za-z][^>\n]*>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
IGNORE = re.compile(r"<!--\s*(?:kokugo|notation)-ignore-start\s*-->(.*?)(?:<!--\s*(?:kokugo|notation)-ignore-end\s*-->|\Z)", re.S)
FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})")


class Protected:
    """Disjoint intervals with kinds; the first claim on a place stands."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def claim(self, start: int, end: int, kind: str) -> None:
        """Claim what of [start, end) is free."""
        for a, b in self._free(start, end):
            at = bisect_right(self.starts, a)
            self.starts.insert(at, a)
            self.spans.insert(at, (a, b, kind))

    def _free(self, start: int, end: int) -> list[tuple[int, int]]:
        out, at = [], start
        for a, b, _ in self._over(start, end):
            if at < a:
                out.append((at, a))
            at = max(at, b)
        return [*out, (at, end)] if at < end else out

    def _over(self, start: int, end: int) -> list[tuple[int, int, str]]:
        first = max(0, bisect_right(self.starts, start) - 1)
        last = bisect_right(self.starts, end - 1) if end > start else first
        return [s for s in self.spans[first:last] if s[1] > start and s[0] < end]

    def first(self, start: int, end: int) -> str | None:
        return next((kind for _, _, kind in self._over(start, end)), None)

    def masked(self, text: str) -> str:
        """The text with NUL for what is claimed; lengths stay."""
        out, at = [], 0
        for a, b, _ in self.spans:
            out += [text[at:a], "\0" * (b - a)]
            at = b
        return "".join(out) + text[at:]


def _line_ends(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def protect(text: str, markdown: bool = True, terms: tuple[str, ...] = ()) -> Protected:
    """What rules must leave alone: front matter, fences, quotes, comments, ignored regions, code, link targets, URLs, tags, terms."""
    p = Protected()
    if markdown:
        lines = _line_ends(text)
        size, begin = len(text), 0
        if text[slice(*lines[0])].strip() == "---":
            for i, (a, b) in enumerate(lines[1:], 1):
                if text[a:b].strip() in ("---", "..."):
                    p.claim(0, min(b + 1, size), "frontmatter")
                    begin = i + 1
                    break
        fence, since = "", 0
        for a, b in lines[begin:]:
            line = text[a:b]
            if fence:
                if re.match(rf"[ ]{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                    p.claim(since, min(b + 1, size), "fenced_code")
                    fence = ""
            elif m := FENCE.match(line):
                fence, since = m[1], a
            elif re.match(r"[ ]{0,3}>", line):
                p.claim(a, min(b + 1, size), "quote")
        if fence:
            p.claim(since, size, "fenced_code")
        for m in COMMENT.finditer(text):
            p.claim(*m.span(), "html_comment")
        for m in IGNORE.finditer(text):
            p.claim(*m.span(1), "ignore_region")
        at = 0
        for part in re.split(r"(\n[ \t]*\n)", p.masked(text)):
            for m in CODE.finditer(part):
                p.claim(at + m.start(), at + m.end(), "inline_code")
            at += len(part)
        shown = p.masked(text)
        for pattern in DESTINATIONS:
            for m in pattern.finditer(shown):
                p.claim(*m.span("dest"), "url")
    else:
        shown = text
    for m in ADDRESS.finditer(shown):
        p.claim(m.start(), m.start() + len(m[0].rstrip(".,;:)'")), "url")
    if markdown:
        for m in TAG.finditer(shown):
            p.claim(*m.span(), "html")
    for term in terms:
        for m in re.finditer(f"(?={re.escape(term)})", text):
            p.claim(m.start(), m.start() + len(term), f"glossary:{term}")
    return p


def ideograph(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)))


class Hit(NamedTuple):
    rule: dict
    start: int
    end: int
    text: str
    candidates: tuple[str, ...] = ()
    entry: dict = {}
    noun: str | None = None


class RuleTable:
    """Rules as data: id, title, profiles{profile: category}, kind and what the kind needs. Compiled once per worker.

    kinds: patterns (entries: pattern, candidates, ambiguous; optional noun_followers), outside (listed characters, ignore),
    forms (groups of homophone forms), consistency (groups of forms that shouldn't be mixed)."""

    def __init__(self, rules: list[dict]):
        self.rules = rules

    @cached_property
    def compiled(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for r in self.rules:
            if r["kind"] == "patterns":
                out[r["id"]] = [(e, re.compile(e["pattern"], re.M)) for e in r["entries"]]
            elif r["kind"] == "forms":
                table = {f: g for g in reversed(r["groups"]) for f in g["forms"]}
                longest = sorted(table, key=lambda f: (-len(f), f))
                out[r["id"]] = [(table, re.compile("|".join(map(re.escape, longest)) or r"(?!)"))]
            elif r["kind"] == "consistency":
                out[r["id"]] = [(g, [(f["label"], re.compile(f["pattern"], re.M)) for f in g["forms"]]) for g in r["groups"]]
        return out

    def hits(self, rule: dict, text: str) -> list[Hit]:
        made = self.compiled.get(rule["id"], [])
        if rule["kind"] == "patterns":
            found = [
                Hit(rule, m.start(), m.end(), m[0], tuple(m.expand(c) for c in e.get("candidates", ())), e, self._noun(rule, text[m.end() : m.end() + 1]))
                for e, p in made
                for m in p.finditer(text)
                if m[0]
            ]
            found.sort(key=lambda h: (h.start, -h.end))
            kept: list[Hit] = []  # earliest, then longest, none overlapping
            for h in found:
                if not kept or kept[-1].end <= h.start:
                    kept.append(h)
            return kept
        if rule["kind"] == "outside":
            listed = set(rule["listed"]) | set(rule.get("ignore", ""))
            out, run = [], None
            for i, ch in enumerate(text + " "):
                odd = ideograph(ch) and ch not in listed
                if odd and run is None:
                    run = i
                elif not odd and run is not None:
                    out.append(Hit(rule, run, i, text[run:i]))
                    run = None
            return out
        if rule["kind"] == "forms":
            return [Hit(rule, m.start(), m.end(), m[0], (), {"group": table[m[0]]["id"]}) for table, p in made for m in p.finditer(text)]
        return []

    @staticmethod
    def _noun(rule: dict, after: str) -> str | None:
        if "noun_followers" not in rule:
            return None
        if after and after in rule["noun_followers"]:
            return "noun"
        return "compound" if after and (ideograph(after) or "ァ" <= after <= "ヺ") else "verb-possible"


def _class(hit: Hit, profile: str, safe: Protected, used: list[tuple[int, int, str]]) -> tuple[str, str]:
    """(category, reason code): the profile's category, lowered to needs_context where it can't be sure, excluded where protected."""
    if kind := safe.first(hit.start, hit.end):
        return "excluded", f"protected:{kind}"
    category = hit.rule["profiles"][profile]
    if category in ("error", "recommendation"):
        if hit.entry.get("ambiguous"):
            return "needs_context", "ambiguous"
        if hit.noun not in (None, "noun"):
            return "needs_context", "compound-word" if hit.noun == "compound" else "verb-form-possible"
        if any(a < hit.end and hit.start < b for a, b, _ in used):
            return "needs_context", "glossary:use-conflict"
    return category, "rule"


def check(text: str, table: RuleTable, profile: str, markdown: bool = True, protected: tuple[str, ...] = (), use: tuple[str, ...] = ()) -> list[dict]:
    """Findings in the order (offset, rule, length)."""
    text = re.sub("\r\n?", "\n", text)
    safe = protect(text, markdown, protected)
    used = [(m.start(), m.start() + len(t), t) for t in use for m in re.finditer(f"(?={re.escape(t)})", text)]

    def row(rule: dict, start: int, end: int, category: str, reason: str, candidates: tuple[str, ...] = (), count: int | None = None) -> dict:
        line = text.count("\n", 0, start) + 1
        return {
            "rule_id": rule["id"], "category": category, "offset": start, "length": end - start, "line": line, "column": start - (text.rfind("\n", 0, start) + 1) + 1,
            "text": text[start:end], "candidates": list(candidates), "reason_code": reason, "count": count,
        }

    order = lambda f: (f["offset"], f["rule_id"], f["length"])
    found = [row(r, h.start, h.end, *_class(h, profile, safe, used), h.candidates) for r in table.rules for h in table.hits(r, text)]
    found.sort(key=order)
    once = {r["id"] for r in table.rules if r.get("dedupe") == "first_per_text"}
    alike = lambda f: (f["rule_id"], f["text"]) if f["rule_id"] in once and f["category"] != "excluded" else None
    times, seen, kept = Counter(map(alike, found)), set(), []
    for f in found:
        key = alike(f)
        if key is None:
            kept.append(f)
        elif key not in seen:
            seen.add(key)
            kept.append(f | {"count": times[key]})
    flagged = [(f["offset"], f["offset"] + f["length"]) for f in kept if f["category"] in FLAGGED]
    for rule in table.rules:
        if rule["kind"] != "consistency":
            continue
        for _, forms in table.compiled[rule["id"]]:
            spots = {
                label: [m.span() for m in p.finditer(text) if m[0] and not safe.first(*m.span()) and not any(m.start() < b and a < m.end() for a, b in flagged)]
                for label, p in forms
            }
            present = [label for label, _ in forms if spots[label]]
            if len(present) < 2:
                continue
            wanted = next((x for x in present if x in use or any(text[a:b] in use for a, b in spots[x])), None)
            main = wanted or max(present, key=lambda x: (len(spots[x]), -present.index(x)))
            for x in present:
                if x != main:
                    kept.append(row(rule, *spots[x][0], rule["profiles"][profile], "glossary:use" if wanted else "rule", (main,), len(spots[x])))
    return sorted(kept, key=order)


def _by(*categories: str) -> dict[str, str]:
    letter = {"A": "accepted_variant", "R": "recommendation", "N": "needs_context", "E": "error"}
    return dict(zip(PROFILES, (letter[c] for c in categories)))


def seed_rules() -> list[dict]:
    """A small table to begin with; a full one has the same shape."""
    pattern = lambda i, title, cats, *entries, **more: {"id": i, "title": title, "kind": "patterns", "profiles": _by(*cats), "entries": list(entries), **more}
    word = lambda p, *c, **more: {"pattern": p, "candidates": list(c), **more}
    return [
        pattern("KANA-001", "は in greetings", "EEE", word("こんにちわ", "こんにちは"), word("こんばんわ", "こんばんは")),
        pattern("OKURI-001", "shorter okurigana", "ARR", word(r"行な(?P<e>[うわいえっ])", r"行\g<e>")),
        pattern("OKURI-003", "nouns without okurigana", "AAE", word("申し込み", "申込み"), word("取り扱い", "取扱い"), noun_followers="をがのはにでとも、。"),
        pattern("GAIRAI-001", "long vowels at the end", "ARR", word(r"(?P<w>サーバ|ユーザ|コンピュータ)(?!ー)", r"\g<w>ー")),
        pattern("KANJI-002", "adverbs in kana", "ARR", word("予め", "あらかじめ")),
        pattern("KANJI-003", "conjunctions in kana", "ARR", word("且つ", "かつ")),
        pattern("KANJI-004", "conjunctions in official text", "AAR", word("および", "及び")),
        pattern("KANJI-005", "adverbs in official text", "AAR", word("すべて", "全て")),
        pattern("NUM-001", "counters with か", "ARR", word(r"(?P<n>[0-9０-９]+)[ヶヵケカ](?P<c>[所月])", r"\g<n>か\g<c>")),
        pattern("EXPR-001", "すべき", "ARR", word("するべき", "すべき")),
        pattern("EXPR-003", "ございます", "ARA", word("ございます", "あります")),
        pattern("KANA-004", "allowed spellings", "AAA", word("いなづま", "いなずま"), dedupe="first_per_text"),
        {"id": "IJIDOKUN-001", "title": "homophones", "kind": "forms", "profiles": _by("A", "N", "N"), "groups": [{"id": 1, "forms": ["計る", "測る", "量る", "図る"]}], "dedupe": "first_per_text"},
        {"id": "CONSIST-001", "title": "mixed spellings", "kind": "consistency", "profiles": _by("R", "R", "R"), "groups": [{"id": "server", "forms": [{"label": "サーバー", "pattern": "サーバー"}, {"label": "サーバ", "pattern": "サーバ(?!ー)"}]}]},
    ]
