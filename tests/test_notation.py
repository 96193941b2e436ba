"""The rule engine on single texts."""

from prose_spark.functions import notation
from prose_spark.operators.rules import rule_problems

TABLE = notation.RuleTable(notation.seed_rules())


def cats(text, rule, profile="official", **how):
    return [f["category"] for f in notation.check(text, TABLE, profile, **how) if f["rule_id"] == rule]


def test_protected_places_are_excluded():
    assert cats("`こんにちわ`と書く。", "KANA-001") == ["excluded"]
    assert cats("```\nこんにちわ\n```\nこんにちわ", "KANA-001") == ["excluded", "error"]
    assert cats("> こんにちわ\nこんにちわ", "KANA-001") == ["excluded", "error"]
    assert cats("---\na: こんにちわ\n---\nx", "KANA-001") == ["excluded"]
    assert cats("<!-- notation-ignore-start -->こんにちわ<!-- notation-ignore-end -->こんにちわ", "KANA-001") == ["excluded", "error"]
    assert cats("こんにちわ", "KANA-001", protected=("こんにちわ",)) == ["excluded"]
    assert cats("https://a.b/こんにちわ を見る", "KANA-001") == ["excluded"]


def test_what_is_not_certain_needs_context():
    assert cats("サーバを再起動する。", "GAIRAI-001", use=("サーバ",)) == ["needs_context"]
    assert cats("申し込み書", "OKURI-003") == ["needs_context"]
    assert cats("申し込みを受ける。", "OKURI-003") == ["error"]


def test_mixed_spellings():
    text = "サーバーを止める。サーバーを再起動する。サーバーを確認する。サーバを停止する。"
    found = [f for f in notation.check(text, TABLE, "general-tech") if f["rule_id"] == "CONSIST-001"]
    assert [(f["text"], f["candidates"], f["count"]) for f in found] == [("サーバ", ["サーバー"], 1)]
    # what another rule has flagged doesn't count as a spelling any more
    assert [f for f in notation.check(text, TABLE, "official") if f["rule_id"] == "CONSIST-001"] == []


def test_first_of_equal_findings_stays_with_the_count():
    found = [f for f in notation.check("いなづま、いなづま。", TABLE, "official") if f["rule_id"] == "KANA-004"]
    assert [(f["offset"], f["count"]) for f in found] == [(0, 2)]


def test_candidates_expand_groups_and_overlaps_go():
    assert [f["candidates"] for f in notation.check("3ヶ所", TABLE, "official") if f["rule_id"] == "NUM-001"] == [["3か所"]]
    rule = {"id": "X", "title": "", "kind": "patterns", "profiles": dict.fromkeys(notation.PROFILES, "error"), "entries": [{"pattern": "ab"}, {"pattern": "abc"}, {"pattern": "cd"}]}
    assert [f["text"] for f in notation.check("abcd", notation.RuleTable([rule]), "official")] == ["abc"]


def test_characters_outside_a_list():
    rule = {"id": "X", "title": "", "kind": "outside", "listed": "日本", "profiles": dict.fromkeys(notation.PROFILES, "needs_context")}
    assert [(f["offset"], f["text"]) for f in notation.check("日本語学a語", notation.RuleTable([rule]), "official")] == [(2, "語学"), (5, "語")]


def test_rule_table_is_checked():
    assert rule_problems(notation.seed_rules()) == []
    good = notation.seed_rules()[0]
    assert rule_problems([good, good]) == ["KANA-001: id occurs again"]
    assert "unterminated" in rule_problems([good | {"entries": [{"pattern": "("}]}])[0] or "missing" in rule_problems([good | {"entries": [{"pattern": "("}]}])[0]
    wrong = good | {"examples": [{"text": "こんにちわ", "profile": "official", "category": "recommendation"}]}
    assert rule_problems([wrong]) == ["KANA-001: example 'こんにちわ' gives ['error']"]


def test_protection_first_claim_stands():
    p = notation.Protected()
    p.claim(2, 5, "a")
    p.claim(0, 8, "b")
    assert p.spans == [(0, 2, "b"), (2, 5, "a"), (5, 8, "b")]
    assert (p.first(3, 4), p.first(4, 6), p.first(8, 9)) == ("a", "a", None)
    assert p.masked("abcdefghij") == "\0" * 8 + "ij"
