"""Rule data read from a folder."""

import copy
import json

import pytest

from prose_spark.functions import notation
from prose_spark.operators import rules
from prose_spark.sources import rule_files

SOURCES = {"sources": [{"id": "S1", "kind": "内閣告示", "role": "implemented", "retrieved_files": [{"format": "pdf", "pages": 12}]}, {"id": "S2", "kind": "報告", "role": "reference-only"}]}
CHARACTERS = {"chars": ["日", "本", "語", "計", "量"], "readings": {}, "count": 5}
HOMOPHONES = {"entries": [{"id": 7, "variants": [{"forms": ["計る"]}, {"forms": ["量る"]}]}]}


def rule(number, kind, categories=("error", "error", "error"), **how):
    return {
        "id": f"KOKUGO-KANJI-{number:03}", "title": "t", "summary": "s", "family": "kanji", "provenance": "official", "automation": "detect",
        "sources": [{"source_id": "S1", "locator": "1", "pages": "PDF pp.1-3, 12"}],
        "profiles": {p: {"category": c, "basis": "source", "note": "n"} for p, c in zip(notation.PROFILES, categories)},
        "detection": {"kind": kind, **how},
    }


RULES = [
    rule(1, "joyo_outside", ("needs_context",) * 3, ignore_chars="学"),
    rule(2, "patterns", entries=[{"pattern": "(?P<a>こんにち)わ", "candidates": [r"\g<a>は"]}]) | {"examples": {"fix": [{"profile": "official", "before": "こんにちわ", "after": "こんにちは"}], "keep": [{"profile": "official", "text": "こんばんは"}]}},
    rule(3, "ijidokun", ("needs_context",) * 3, entry_ids=[7], dedupe="first_per_text"),
    rule(4, "consistency", ("recommendation",) * 3, groups=[{"id": "g", "forms": [{"label": "甲", "pattern": "甲"}, {"label": "こう", "pattern": "こう"}]}]),
    rule(5, "patterns") | {"automation": "reference", "detection": None, "not_checked": "文脈による"},
]


def files(**more):
    return {"rules": {"schema_version": 1, "rules": copy.deepcopy(RULES)}, "sources": SOURCES, "characters": CHARACTERS, "homophones": HOMOPHONES} | more


def test_rules_are_loaded_and_applied(spark, tmp_path):
    for name, body in files().items():
        (tmp_path / rule_files.FILES[name]).write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    loaded = rule_files.load_rules(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "こんにちわ。日本語学犬を計る。甲とこうと甲。")], "doc_id long, text string")
    got = {(r["rule_id"][-3:], r["text"], r["category"], tuple(r["candidates"])) for r in rules.check_documents(docs, loaded, "official").collect()}
    assert got == {("002", "こんにちわ", "error", ("こんにちは",)), ("001", "犬", "needs_context", ()), ("001", "甲", "needs_context", ()), ("003", "計る", "needs_context", ())}  # what one rule has flagged is no spelling of another
    cover = {r["rule_id"][-3:]: (r["checked"], r["category"], r["not_checked"]) for r in rule_files.coverage(spark, loaded, "official").collect()}
    assert cover["002"] == (True, "error", None) and cover["005"] == (False, None, "文脈による") and len(cover) == 5
    (tmp_path / rule_files.FILES["characters"]).unlink()
    with pytest.raises(ValueError, match="characters.json: missing"):
        rule_files.load_rules(spark, str(tmp_path))


def test_good_rule_data_has_no_problems():
    assert rule_files.rule_file_problems(files()) == []


@pytest.mark.parametrize(
    "change,problem",
    [
        (lambda r: r.update(id="X"), "id of another form"),
        (lambda r: r.update(title=" "), "no title"),
        (lambda r: r.update(family="x"), "unknown family"),
        (lambda r: r.update(sources=[]), "no source"),
        (lambda r: r["sources"][0].update(source_id="S9"), "unknown source S9"),
        (lambda r: r["sources"][0].update(locator=""), "S1: no locator"),
        (lambda r: r["sources"][0].update(pages="p. 3"), "S1: pages of a PDF missing or of another form"),
        (lambda r: r["sources"][0].update(pages="PDF p.13"), "S1: pages outside the PDF"),
        (lambda r: r["sources"][0].update(source_id="S2"), "detects, but rests on reference-only sources"),
        (lambda r: r["profiles"].pop("official"), "profiles incomplete"),
        (lambda r: r["profiles"]["official"].update(category="excluded"), "official: unknown category"),
        (lambda r: r["profiles"]["official"].update(basis="skill-policy"), "official: error not based on the source"),
        (lambda r: r.update(provenance="skill-policy"), "official: error by our own policy"),
        (lambda r: r["profiles"]["official"].update(note=""), "official: no note"),
        (lambda r: r["detection"].update(kind="x"), "unknown detection"),
        (lambda r: r["detection"].update(dedupe="x"), "unknown dedupe"),
        (lambda r: r["detection"]["entries"][0].update(pattern="a*"), "entry 0: matches nothing at all"),
        (lambda r: r["detection"]["entries"][0].update(candidates=[r"\g<b>"]), "entry 0: no group b"),
        (lambda r: r["detection"]["entries"][0].update(ambiguous=True), "entry 0: doesn't say why it is ambiguous"),
        (lambda r: r["detection"].update(entries=[]), "nothing to detect"),
        (lambda r: r["examples"]["fix"][0].update(before="はい"), "not found: はい"),
        (lambda r: r["examples"]["fix"][0].update(after="こんにちわ"), "still found: こんにちわ"),
        (lambda r: r["examples"]["keep"][0].update(text="こんにちわ"), "flagged: こんにちわ"),
    ],
)
def test_what_is_wrong_is_named(change, problem):
    f = files()
    change(f["rules"]["rules"][1])
    assert problem in [p for _, p in rule_files.rule_file_problems(f)]


def test_ids_and_sources():
    f = files()
    f["rules"]["rules"][0]["id"] = f["rules"]["rules"][1]["id"]
    f["sources"] = {"sources": [*SOURCES["sources"], {"id": "S3", "kind": "x"}]}
    assert rule_files.rule_file_problems(f) == [("S3", "unknown kind of source"), ("KOKUGO-KANJI-002", "id occurs again")]
    f = files()
    f["rules"]["rules"][2]["detection"]["entry_ids"] = [8]
    assert rule_files.rule_file_problems(f) == [("KOKUGO-KANJI-003", "unknown homophones")]
    f["rules"]["rules"][2]["detection"] = f["rules"]["rules"][4].pop("not_checked") and RULES[2]["detection"]
    assert rule_files.rule_file_problems(f) == [("KOKUGO-KANJI-005", "doesn't say what is not checked")]
