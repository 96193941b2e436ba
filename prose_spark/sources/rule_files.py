"""Rule data from a folder: the rule file, its sources, the list of official characters and the list of homophones.

The files are read through Spark, so that the folder may be on any file system; what they hold is a table of bounded size."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notation

#: Names of the files in a folder; other names can be given.
FILES = {"rules": "rules.json", "sources": "sources.json", "characters": "characters.json", "homophones": "homophones.json"}
# Enumerations and shapes of the rule data.
VERSION = 1
FAMILIES = ("kanji", "kana", "okurigana", "gairai", "numeral", "punctuation", "expression", "ijidokun", "consistency", "reference")
BINDING = ("内閣告示", "内閣訓令")
SOURCE_KINDS = (*BINDING, "建議", "報告", "答申", "通知")
BASES = ("source", "skill-policy")
KINDS = {"patterns": "patterns", "joyo_outside": "outside", "ijidokun": "forms", "consistency": "consistency"}
RULE_ID = re.compile(r"KOKUGO-[A-Z]+-\d{3}")
PAGES = re.compile(r"PDF (?:全(?P<all>\d+)ページ|pp?\.(?P<list>\d+(?:-\d+)?(?:, \d+(?:-\d+)?)*))")


def read_rule_files(spark: SparkSession, folder: str, names: dict[str, str] = FILES) -> dict[str, dict]:
    """The four documents; ValueError for one that is missing, not JSON or of another version."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    found = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in rows.filter(F.substring_index("path", "/", -1).isin(*names.values())).select("path", "content").collect()}
    out = {}
    for name, file in names.items():
        if file not in found:
            raise ValueError(f"{file}: missing")
        try:
            out[name] = json.loads(found[file])
        except ValueError as e:
            raise ValueError(f"{file}: not JSON") from e
    if out["rules"].get("schema_version") != VERSION or "rules" not in out["rules"]:
        raise ValueError(f"{names['rules']}: version {VERSION} with rules expected")
    return out


def rule_of(raw: dict, files: dict[str, dict]) -> dict:
    """A rule as the engine takes it; rules that no machine detects have the kind `reference`."""
    how = raw.get("detection") or {}
    rule = {"id": raw["id"], "title": raw["title"], "kind": KINDS[how["kind"]] if raw.get("automation") == "detect" and how else "reference"}
    rule["profiles"] = {p: m["category"] for p, m in raw["profiles"].items()}
    rule |= {k: how[k] for k in ("entries", "groups", "dedupe") if k in how} | ({"not_checked": raw["not_checked"]} if "not_checked" in raw else {})
    if "noun_context" in how:
        rule["noun_followers"] = how["noun_context"]["followers"]
    if rule["kind"] == "outside":
        rule |= {"listed": "".join(files["characters"]["chars"]), "ignore": how.get("ignore_chars", "")}
    if rule["kind"] == "forms":
        by_id = {e["id"]: e for e in files["homophones"]["entries"]}
        rule["groups"] = [{"id": i, "forms": [f for v in by_id[i]["variants"] for f in v["forms"]]} for i in how["entry_ids"]]
    return rule


def load_rules(spark: SparkSession, folder: str, names: dict[str, str] = FILES) -> list[dict]:
    """The rules of a folder, for `rules.check_documents` and `rules.coverage`."""
    files = read_rule_files(spark, folder, names)
    return [rule_of(raw, files) for raw in files["rules"]["rules"]]


def _said(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _pages_problem(pages: object, count: int | None) -> str | None:
    if count is None:
        return None
    m = PAGES.fullmatch(pages) if _said(pages) else None
    if m is None:
        return "pages of a PDF missing or of another form"
    spans = [(1, int(m["all"]))] if m["all"] else [tuple(map(int, (part.split("-") * 2)[:2])) for part in m["list"].split(", ")]
    if m["all"] and int(m["all"]) != count or any(not 1 <= a <= b <= count for a, b in spans):
        return "pages outside the PDF"
    return None


def _cited(rule: dict, sources: dict[str, dict]) -> Iterator[str]:
    """What is wrong with a rule's sources."""
    refs = rule.get("sources") or []
    if not refs:
        yield "no source"
    for ref in refs:
        source = sources.get(ref.get("source_id"))
        if source is None:
            yield f"unknown source {ref.get('source_id')}"
            continue
        if not _said(ref.get("locator")):
            yield f"{ref['source_id']}: no locator"
        counts = [f.get("pages") for f in source.get("retrieved_files", ()) if f.get("format") == "pdf"]
        if problem := _pages_problem(ref.get("pages"), counts[0] if counts else None):
            yield f"{ref['source_id']}: {problem}"
    known = [sources[r["source_id"]] for r in refs if r.get("source_id") in sources]
    if known and rule.get("automation") == "detect" and all(s.get("role") != "implemented" for s in known):
        yield "detects, but rests on reference-only sources"


def _categories(rule: dict, sources: dict[str, dict]) -> Iterator[str]:
    """What is wrong with the categories of a rule's profiles."""
    profiles = rule.get("profiles")
    if not isinstance(profiles, dict) or set(profiles) != set(notation.PROFILES):
        yield "profiles incomplete"
        return
    own = rule.get("provenance") == "skill-policy"
    binding = any(sources.get(r.get("source_id"), {}).get("kind") in BINDING for r in rule.get("sources") or ())
    for name, m in profiles.items():
        error = m.get("category") == "error"
        checks = (
            (m.get("category") in notation.CATEGORIES and m.get("category") != "excluded", "unknown category"),
            (m.get("basis") in BASES, "unknown basis"),
            (_said(m.get("note")), "no note"),
            (not (error and own), "error by our own policy"),
            (not error or binding, "error without a binding source"),
            (not error or m.get("basis") == "source", "error not based on the source"),
            (not own or m.get("basis") == "skill-policy", "basis is not our own policy"),
        )
        yield from (f"{name}: {message}" for good, message in checks if not good)


def _detection(rule: dict, files: dict[str, dict]) -> Iterator[str]:
    """What is wrong with how a rule detects, and with its examples."""
    if rule.get("automation") != "detect":
        if not _said(rule.get("not_checked")):
            yield "doesn't say what is not checked"
        return
    how = rule.get("detection")
    if not isinstance(how, dict) or how.get("kind") not in KINDS:
        yield "unknown detection"
        return
    if how.get("dedupe") not in (None, "first_per_text"):
        yield "unknown dedupe"
    for n, entry in enumerate(how.get("entries", ())):
        try:
            pattern = re.compile(entry["pattern"])
        except (re.error, KeyError) as e:
            yield f"entry {n}: {e}"
            continue
        if pattern.match(""):
            yield f"entry {n}: matches nothing at all"
        names = {name for c in entry.get("candidates", ()) for name in re.findall(r"\\g<(\w+)>", c)}
        yield from (f"entry {n}: no group {name}" for name in sorted(names - set(pattern.groupindex)))
        if entry.get("ambiguous") and not _said(entry.get("ambiguity")):
            yield f"entry {n}: doesn't say why it is ambiguous"
    for group in how.get("groups", ()):
        if len({f.get("label") for f in group.get("forms", ())}) < 2:
            yield f"group {group.get('id')}: fewer than two forms"
    known = {e["id"] for e in files["homophones"].get("entries", ())}
    if how["kind"] == "ijidokun" and (not how.get("entry_ids") or not set(how["entry_ids"]) <= known):
        yield "unknown homophones"
    if how["kind"] in ("patterns", "consistency") and not how.get("entries" if how["kind"] == "patterns" else "groups"):
        yield "nothing to detect"


def _examples(rule: dict, files: dict[str, dict]) -> Iterator[str]:
    """Examples that don't show what they say: `fix` (profile, before, after) is found before and not after, `keep` (profile, text) isn't flagged."""
    table = notation.RuleTable([rule_of(rule, files)])
    flagged = lambda text, profile: [f for f in notation.check(text, table, profile) if f["category"] in notation.FLAGGED]
    examples = rule.get("examples") or {}
    for e in examples.get("fix", ()):
        if not flagged(e["before"], e["profile"]):
            yield f"not found: {e['before']}"
        if flagged(e["after"], e["profile"]):
            yield f"still found: {e['after']}"
    for e in examples.get("keep", ()):
        if flagged(e["text"], e["profile"]):
            yield f"flagged: {e['text']}"


def rule_file_problems(files: dict[str, dict]) -> list[tuple[str, str]]:
    """(rule id, problem) of a folder's rule data; empty for good data."""
    sources = {s["id"]: s for s in files["sources"].get("sources", ()) if s.get("id")}
    out = [(s.get("id") or "?", "unknown kind of source") for s in files["sources"].get("sources", ()) if s.get("kind") not in SOURCE_KINDS]
    seen: set[str] = set()
    for rule in files["rules"]["rules"]:
        name = rule.get("id") or "?"
        own = [] if RULE_ID.fullmatch(name) else ["id of another form"]
        own += ["id occurs again"] * (name in seen)
        own += [f"no {field}" for field in ("title", "summary") if not _said(rule.get(field))]
        own += ["unknown family"] * (rule.get("family") not in FAMILIES)
        for part in (_cited(rule, sources), _categories(rule, sources), _detection(rule, files)):
            own += part
        if not own and rule.get("automation") == "detect":
            own += _examples(rule, files)
        seen.add(name)
        out += [(name, problem) for problem in own]
    return out


def coverage(spark: SparkSession, rules: list[dict], profile: str) -> DataFrame:
    """What a check covers and what it doesn't: rule_id, title, checked, category (under the profile; null if for reference only), not_checked."""
    rows = [(r["id"], r["title"], r["kind"] != "reference", r["profiles"][profile] if r["kind"] != "reference" else None, r.get("not_checked")) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, title string, checked boolean, category string, not_checked string")
