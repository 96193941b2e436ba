"""Operators over small tables."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prose_spark.functions import text as T
from prose_spark.operators import comparison, evaluation, feedback, ledger, preservation, readability, rules, structure
from prose_spark.sources import documents as files
from prose_spark.sources import markup, sinks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_metrics_golden(spark):
    m = readability.with_ratios(
        readability.document_metrics(docs(spark, "漢字ひらがな。", "りんご、みかん、ぶどうを買った。次に帰った。", "", "あ" * 45 + "。", "あ" * 44 + "。", None))
    )
    got = {r["doc_id"]: r for r in m.collect()}
    assert (got[0]["chars"], got[0]["kanji"], got[0]["hiragana"]) == (7, 2, 4)
    assert (got[1]["sentences"], got[1]["commas_per_sentence"]) == (2, 1.0)
    assert (got[2]["chars"], got[2]["avg_sentence_length"]) == (0, 0.0)
    assert (got[3]["long_sentences"], got[4]["long_sentences"]) == (1, 0)
    total = readability.corpus_total(m).first()
    assert total["documents"] == 6 and total["chars"] == sum(r["chars"] for r in got.values())


def test_short_runs(spark):
    texts = ["あ。い。う。", "あ。い。", "あ。い。う", "あ。い。う。え", "- あ。\n- い。\n- う。", "# 題\n\nここは短くない長さを超えている文章で書かれています。はい。そう。です。"]
    blocks = readability.split_blocks(docs(spark, *texts))
    got = rows(readability.short_runs(blocks), "doc_id", "line", "length", "sentences", "preview")
    assert got == [(0, 1, 6, 3, "あ。い。う。"), (3, 1, 6, 3, "あ。い。う。"), (5, 3, 9, 3, "はい。そう。です。")]
    assert rows(readability.short_run_islands(readability.sentence_rows(blocks)), "doc_id", "sent", "sentences") == [(0, 0, 3), (3, 0, 3), (5, 1, 3)]


def test_pointers(spark):
    texts = ["初回課金転換率を見る。", "課金転換率を見る。", "運用コストの削減の実現の効果を測る。", "運用コストの削減の実現を測る。", "できないわけではない。"]
    got = rows(readability.pointers(docs(spark, *texts)), "doc_id", "kind", "line", "length")
    assert got == [(0, "kanji-run", 1, 7), (2, "no-chain", 1, 14), (4, "double-negative", 1, 8)]
    counted = readability.pointer_counts(readability.sentence_rows(readability.split_blocks(docs(spark, *texts))))
    assert [(r["kanji_run"], r["no_chain"], r["double_negative"]) for r in counted.orderBy("doc_id").collect()] == [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)]


def test_top_candidates(spark):
    c = spark.createDataFrame([(1, 0, 1, 50), (1, 0, 2, 90), (2, 0, 1, 90), (2, 0, 9, 10)], "doc_id int, block int, line int, length int")
    assert rows(readability.top_candidates(c, 2), "doc_id", "line") == [(1, 2), (2, 1)]
    assert rows(readability.top_candidates(c, 1, per=["doc_id"]), "doc_id", "line", "omitted") == [(1, 2, 1), (2, 1, 1)]
    assert readability.top_candidates(c, 0).count() == 4


def test_text_expressions(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("a　b\x1c c\n", T.visible_length) == 3
    assert one("aaXa\naa", lambda t: T.offsets_of(t, F.lit("aa"))) == [0, 5]
    assert one("ab\ncd", lambda t: T.line_of(t, F.lit(4))) == 2 and one("ab\ncd", lambda t: T.column_of(t, F.lit(4))) == 2
    assert one("![i](x) [a](b(c)) <http://x.y> **b** `c` <i>d</i> http://q.r", T.clean_inline) == "a  b c d"
    assert one("モード A で、モードA", T.mode_of) == "A" and one("モードA モードB", T.mode_of) is None
    assert one('x {"a": {"b": 1}} y', T.json_slice) == '{"a": {"b": 1}}' and one("no", T.json_slice) is None
    assert one("a‮b\x07c", lambda t: T.cleaned(t, 3)) == "a?b"
    assert one("src/a.py", lambda t: T.matches_any_glob(t, F.array(F.lit("src/*.py")))) and one("x", lambda t: T.matches_any_glob(t, F.array().cast("array<string>")))
    assert not one("src/a.pyc", lambda t: T.matches_any_glob(t, F.array(F.lit("src/?.py"))))
    assert one("x y", lambda t: T.in_order(t, ["x", "y"])) and not one("y x", lambda t: T.in_order(t, ["x", "y"]))
    assert one("# A\ntext\n## B", T.headings) == ["A", "B"]
    assert one("x", lambda t: T.derivable(F.array(F.lit(6.0), F.lit(3.0)), F.lit(2.0))) and not one("x", lambda t: T.derivable(F.array(F.lit(6.0), F.lit(3.0)), F.lit(5.0)))
    assert one("x" * 40, T.preview) == "x" * 30 + "…"
    assert one("a\n\nb\nc\n \nd", T.paragraphs) == 3
    assert one("see http://a.b/c). and https://d.e", T.urls) == ["http://a.b/c", "https://d.e"]
    assert one("１２３", lambda t: T.count(t, r"\d")) == 3
    assert [one("mail a.b@c.de, 03-1234-5678, 12345678901", lambda t, k=k: T.sensitive_counts(t)[k]) for k in T.SENSITIVE] == [1, 0, 1, 1]


def test_preserved(spark):
    pairs = spark.createDataFrame([(1, "a b\nc", "ab c"), (2, "abc", "abd"), (3, "", "x"), (4, "ab", "ab")], "pair_id int, before string, after string")
    got = {r["pair_id"]: r for r in preservation.preserved(pairs).collect()}
    assert [got[i]["identical"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[i]["position"] for i in (1, 2, 3, 4)] == [None, 3, 1, None]
    long = "x" * 5000
    far = spark.createDataFrame([(1, long + "a" + long, long + "b" + long)], "pair_id int, before string, after string")
    assert preservation.preserved(far).first()["position"] == 5001


def test_literals(spark):
    d = docs(spark, "aaa\nabab", "none", None)
    items = spark.createDataFrame([(1, "aa"), (2, "abab"), (3, ""), (4, "aa")], "item_id long, text string")
    want = [(0, 1, 0, 1), (0, 1, 1, 1), (0, 2, 4, 2), (0, 4, 0, 1), (0, 4, 1, 1)]
    assert rows(preservation.forbidden_literals(d, items), "doc_id", "item_id", "offset", "line") == want
    assert rows(preservation.forbidden_literals(d, items, most_bytes=0), "doc_id", "item_id", "offset", "line", "column") == rows(preservation.forbidden_literals(d, items), "doc_id", "item_id", "offset", "line", "column")
    assert rows(preservation.missing_literals(d, ["a", "none"]), "doc_id", "text") == [(0, "none"), (1, "a"), (2, "a"), (2, "none")]


def test_many_hits_and_many_lines_take_seconds(spark):
    import time

    d = docs(spark, "needle in a haystack\n" * 50_000)
    items = spark.createDataFrame([(1, "needle"), (2, "haystack\nneedle in a")], "item_id long, text string")
    began = time.time()
    assert preservation.forbidden_literals(d, items).agg(F.max("line"), F.count("*")).first() == (50_000, 99_999)
    assert preservation.forbidden_literals(d, items, most_bytes=0).agg(F.max("line"), F.count("*")).first() == (50_000, 99_999)
    assert docs(spark, "a\n\nb\nc\n" * 50_000).select(T.paragraphs(F.col("text"))).first()[0] == 50_001
    assert time.time() - began < 40


def test_brackets_are_located(spark):
    got = rows(preservation.brackets(docs(spark, "ok (fine)", "x\r\n（「雨）」", None)), "doc_id", "check_id", "line", "column", "opening_line", "opening_column")
    assert got == [(1, "BRACKET-ORDER", 2, 4, 2, 2)]


def pair(spark, before, after, **how):
    return comparison.parsed(spark.createDataFrame([(1, before, after)], "pair_id long, before string, after string"), **how)


@pytest.mark.parametrize(
    "before,after,missing,added",
    [
        ("タイムアウトは30秒である。", "タイムアウトは3秒である。", ["30秒"], ["3秒"]),
        ("30秒間待つ。", "30秒待つ。", [], []),
        ("50パーセントである。", "50%である。", [], []),
        ("3ヶ所を直す。", "3か所を直す。", [], []),
        ("1件と1件と2件。", "1件。", ["1件", "2件"], []),
    ],
)
def test_number_changes(spark, before, after, missing, added):
    got = comparison.item_changes(pair(spark, before, after)).filter("kind = 'number'").collect()
    assert sorted(r["text"] for r in got if r["change"] == "missing") == missing
    assert sorted(r["text"] for r in got if r["change"] == "added") == added


def test_the_last_surplus_is_the_one_that_went(spark):
    got = comparison.item_changes(pair(spark, "1件\n\n1件\n\n1件", "1件")).collect()
    assert sorted(r["line"] for r in got) == [3, 5]


def test_urls_code_terms_and_roles(spark):
    before = "Use `make` and [docs](http://a.b/c).\n\n```\nx = 1\n```\n担当者が API を見る。"
    after = "Use `cmake`.\n\n管理者が GUI を見る。"
    got = {(r["kind"], r["change"], r["text"]) for r in comparison.item_changes(pair(spark, before, after)).collect()}
    assert {("url", "missing", "http://a.b/c"), ("code", "missing", "`make`"), ("code", "missing", "x = 1"), ("code", "added", "`cmake`"), ("term", "missing", "API"), ("term", "added", "GUI"), ("role", "added", "管理者")} <= got
    assert not any(k == "role" and c == "missing" for k, c, _ in got)
    assert comparison.item_changes(pair(spark, before, after), ("管理者",)).filter("kind = 'role'").count() == 0


def test_alignment_against_all_windows(spark):
    rng = random.Random(1)
    data, want = [], {}
    schema = f"pair_id long, side string, items array<{comparison._ITEM}>, sentences array<{comparison._SENTENCE}>"
    for p in range(120):
        sides = {s: [sorted(set(rng.choices("abcdefg", k=rng.randint(0, 4)))) for _ in range(rng.randint(0, 5))] for s in ("before", "after")}
        for s, said in sides.items():
            data.append((p, s, [], [(i, 1, "", u, {}, len(u) >= 2, None) for i, u in enumerate(said)]))
            other = sides["after" if s == "before" else "before"]
            for i, u in enumerate(said):
                best = None
                for a in range(len(other)):
                    for b in (a + 1, a + 2):
                        if b <= len(other):
                            key = (-len(set(u) & set().union(*map(set, other[a:b]))), a, b)
                            best = key if best is None or key < best else best
                want[p, s, i] = (None, None, None) if not u or not other else (0, 0, 1) if best[0] == 0 else (-best[0], best[1], best[2])
    out = comparison.alignment(spark.createDataFrame(data, schema)).collect()
    assert {(r["pair_id"], r["side"], r["pos"]): (r["hits"], r["start"], r["end"]) for r in out} == want


def test_alignment_of_long_texts_is_not_quadratic():
    import time

    rng = random.Random(0)
    words = ["設定", "確認", "再起動", "サーバー", "利用者", "記録", "検索", "です", "ます", "する"] + [f"語{i}" for i in range(400)]
    side = lambda: [sorted({w[i : i + 2] for w in rng.choices(words, k=8) for i in range(len(w) - 1)}) for _ in range(6400)]
    began = time.time()
    comparison.best_windows(side(), side())
    assert time.time() - began < 30


def test_markers_and_style(spark):
    parts = pair(spark, "この設定は必要である。結果はまだ出ない。", "この設定は必要でしょう。結果はまだ出ない。")
    got = {(r["side"], r["kind"]) for r in comparison.marker_changes(comparison.alignment(parts)).collect()}
    assert ("after", "conjecture") in got and ("before", "obligation") in got and not any(k == "negation" for _, k in got)
    style = comparison.style_shift(pair(spark, "見る。読む。", "見ます。読みます。")).first()
    assert (style["style_before"], style["style_after"], style["changed"]) == ("plain", "polite", True)
    none = comparison.style_shift(pair(spark, "x", "y")).first()
    assert (none["style_before"], none["changed"]) == (None, False)


def test_other_analyzers_can_be_named(spark):
    class Words(comparison.BigramAnalyzer):
        def units(self, text):
            return set(text.split())

    comparison.ANALYZERS["words"] = Words
    assert comparison.analyzer("words").units("a b") == {"a", "b"}
    assert isinstance(comparison.analyzer("absent"), comparison.BigramAnalyzer)


def test_rules_over_documents(spark):
    found = rules.check_documents(docs(spark, "こんにちわ、田中です。", "よい。", None), profile="official")
    assert rows(found, "doc_id", "rule_id", "category", "line", "column") == [(0, "KANA-001", "error", 1, 1)]
    assert rules.category_counts(found).first().asDict() == {"doc_id": 0, "error": 1, "recommendation": 0, "needs_context": 0, "accepted_variant": 0, "excluded": 0}
    assert rows(rules.run_status(found, docs(spark, "", "")), "doc_id", "failed") == [(0, True), (1, False)]
    lines = spark.createDataFrame([(0, "# c"), (1, "use: サーバ"), (2, "protect: X"), (3, "X"), (4, "")], "pos int, value string")
    assert rows(rules.glossary_terms(lines), "kind", "term") == [("protect", "X"), ("use", "サーバ")]


def test_bootstrap(spark):
    v = lambda *x: spark.createDataFrame([(n, float(i)) for n, i in enumerate(x)], "document_id long, value double")
    for f in (evaluation.bootstrap, evaluation.bootstrap_exact):
        assert f(v(1)).first()["status"] == "insufficient"
        flat = f(v(0, 0, 0)).first()
        assert (flat["status"], flat["low"]) == ("degenerate", None)
        got = f(v(*range(20)), resamples=2000).first()
        assert got["status"] == "estimated" and 6 < got["low"] < 8.5 and 10.5 < got["high"] < 13
    once, again = (evaluation.bootstrap(v(*range(20)).repartition(n), resamples=500).first() for n in (1, 5))
    assert once == again
    two = evaluation.bootstrap_exact(v(1, -1)).first()
    assert (two["mean"], two["low"], two["high"]) == (0, -1, 1)


def test_clusters_need_documents_and_submitters(spark):
    def qualifies(*findings):
        f = spark.createDataFrame([(i, d, s) for i, (d, s) in enumerate(findings)], "finding_id int, document_id string, submitter string")
        d = f.select("finding_id", F.lit("confirmed_problem").alias("status"), F.lit("tuning").alias("split"), F.lit("p").alias("problem_type"), F.lit("").alias("source_document"), F.array(F.lit("r")).alias("rule_ids"))
        return feedback.failure_clusters(f, d).first()

    ok = qualifies(("a", "x"), ("b", "x"), ("c", "y"))
    assert (ok["documents"], ok["submitters"], ok["qualifies"]) == (3, 2, True)
    assert not qualifies(("a", "x"), ("b", "y"))["qualifies"] and not qualifies(("a", "x"), ("b", "x"), ("c", "x"))["qualifies"]
    assert not qualifies(("a", "x"), ("a", "y"), ("a", "y"))["qualifies"]


def test_shingle_overlaps_against_brute_force(spark):
    import zlib

    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = [base[rng.randint(0, 150) : rng.randint(200, 400)] + "".join(rng.choice("xyz") for _ in range(50)) for _ in range(12)] + ["", "short"]

    def shingles(t):
        c = "".join(t.split())
        return {h for i in range(len(c) - 19) if (h := zlib.crc32(c[i : i + 20].encode())) % 8 == 0}

    d = docs(spark, *texts)
    ids = dict(d.select("doc_id", T.whitespace_free_id(F.col("text"))).collect())
    want = {}
    for i in range(len(texts)):
        for j in range(len(texts)):
            if ids[i] < ids[j] and len(shingles(texts[i]) & shingles(texts[j])) >= 2:
                want[ids[i], ids[j]] = len(shingles(texts[i]) & shingles(texts[j]))
    assert {(r["a"], r["b"]): r["shared"] for r in feedback.overlapping(d).collect()} == want and want


def test_shingle_overlaps_of_more_originals_than_a_crowd(spark):
    import zlib

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, other = word(300), word(300)
    texts = [passage + word(40) for _ in range(90)] + [passage[:200] + word(60) + other[:150] for _ in range(70)] + [other + word(30) for _ in range(5)]

    def shingles(t):
        return {h for i in range(len(t) - 19) if (h := zlib.crc32(t[i : i + 20].encode())) % 8 == 0}

    d = docs(spark, *texts)
    names, own = dict(d.select("doc_id", T.whitespace_free_id(F.col("text"))).collect()), list(map(shingles, texts))
    want = {tuple(sorted((names[i], names[j]))): n for i in range(len(texts)) for j in range(i) if (n := len(own[i] & own[j])) >= 2}
    assert len(want) > 160 * 159 // 2
    for how in ({}, {"chunk": 7}):
        got = [((r["a"], r["b"]), r["shared"]) for r in feedback.overlapping(d, **how).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_shingle_overlaps_send_no_pairs(spark):
    """Originals that share a passage, each with another set of shingles besides: all pairs come out, and none is exchanged to be counted."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, own = word(120), [word(60) for _ in range(40)]
    d = docs(spark, *[passage + own[i // 2] + own[(i + 1) // 2 + 1] for i in range(60)])
    out = feedback.overlapping(d, chunk=1)
    assert out.count() == 60 * 59 // 2
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # no shingle is joined with itself


def test_crowded_shingles_against_brute_force(spark):
    import zlib

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé漢𠀀 ") for _ in range(n))
    passage = word(200)
    texts = [passage[: 60 + 9 * i] + word(50) for i in range(12)] + ["", "short", None]
    texts += [" " + texts[0]] * 3  # copies of one original

    def shingles(t):
        c = "".join((t or "").split())
        return {h for i in range(len(c) - 19) if (h := zlib.crc32(c[i : i + 20].encode())) % 8 == 0}

    d = docs(spark, *texts)
    holders = {}
    for i, name in d.select("doc_id", T.whitespace_free_id(F.coalesce("text", F.lit("")))).collect():
        for h in shingles(texts[i]):
            holders.setdefault(h, set()).add(name)
    want = sorted((h, len(x), min(x)) for h, x in holders.items() if len(x) > 3)
    out = feedback.crowded_shingles(d, crowd=3)
    assert rows(out, "h", "originals", "least") == want and want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and plan.count("Repartition") == 1  # no array of characters a place; one exchange, by shingle


def ticket(case=(), context=(), consent=(), **top):
    body = {
        "schema_version": 1,
        "kind": "jre-feedback",
        "consent": {"version": 1, "storage": True, "ai_processing": False, "publish": False} | dict(consent),
        "context": {"mode": "A", "origin": "artificial", "skill_version": "", "model": ""} | dict(context),
        "case": {"original": "元の文。", "result": "直した文。", "problem_type": "other", "quote": "直した", "quote_in": "result", "severity": "minor", "comment": ""} | dict(case),
    }
    return json.dumps(body | top, ensure_ascii=False).encode()


TICKETS = {
    "a/1.json": (ticket(), None),
    "a/2.json": (ticket(), "sent before"),
    "b/1.json": (ticket(), "sent before"),
    "b/2.json": (ticket(case={"comment": "x", "request": "直して"}), None),
    "c/big.json": (ticket(case={"comment": "x" * 1500}), "file too large"),
    "d/0.json": (b"{", "not JSON"),
    "d/1.json": (b"\xff{}", "not JSON"),
    "d/2.json": (ticket(kind="x"), "other kind or version"),
    "d/3.json": (ticket(schema_version=True), "other kind or version"),
    "d/4.json": (ticket(case={"extra": 1}), "unknown or missing keys"),
    "d/5.json": (ticket(note="x"), "unknown or missing keys"),
    "d/6.json": (ticket(consent={"storage": "true"}), "no consent to storage"),
    "d/7.json": (ticket(consent={"publish": 1}), "consent not true or false"),
    "d/8.json": (ticket(context={"mode": "E"}), "unknown mode or origin"),
    "d/9.json": (ticket(case={"original": " "}), "text missing, empty or too long"),
    "e/1.json": (ticket(case={"comment": "a\x07"}), "control characters"),
    "e/2.json": (ticket(case={"severity": "huge"}), "unknown problem type or severity"),
    "e/3.json": (ticket(case={"quote": "ない"}), "quote not in its text"),
    "e/4.json": (ticket().replace(b'"case": {', b'"case": "x", "other": {'), "parts missing"),
    "e/5.json": (b"[" * 1400, "not JSON"),
    "f g/1.json": (ticket(), "bad submitter"),
    "g/1.json": (ticket(case={"original": "取り 置き"}), "reserved document"),
}


def test_intake(spark):
    rows_ = [(p, p.split("/")[0], len(b), True, b) for p, (b, _) in TICKETS.items()]
    schema = "path string, submitter string, size long, regular boolean, content binary"
    held = spark.range(1).select(T.whitespace_free_id(F.lit("取り置き")).alias("document_id"))
    got = feedback.intake(spark.createDataFrame(rows_, schema), held, most_bytes=1500).collect()
    assert {r["path"]: r["reason"] for r in got} == {p: reason for p, (_, reason) in TICKETS.items()}
    assert all(r["finding_id"] and len(r["finding_id"]) == 13 for r in got if r["reason"] is None)
    few = [(f"a/{i}.json", "a", 400, i != 2, ticket(case={"comment": str(i)})) for i in range(8)]
    got = {r["path"][2]: r["reason"] for r in feedback.intake(spark.createDataFrame(few, schema), most_files=6, total_bytes=1200).collect()}
    assert got == {"0": None, "1": None, "2": "not a regular file", "3": None, "4": "inbox too large", "5": "inbox too large", "6": "too many files", "7": "too many files"}


def test_tickets_are_read_from_folders(spark, tmp_path):
    (tmp_path / "in" / "ann" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "ann" / "deep" / "1.json").write_bytes(ticket())
    (tmp_path / "in" / "2.json").write_bytes(ticket(case={"comment": "2"}))
    (tmp_path / "in" / "ann" / "3.json").symlink_to(tmp_path / "in" / "2.json")
    got = files.read_tickets(spark, str(tmp_path / "in"))
    assert rows(got, "path", "submitter", "regular") == [("2.json", "unassigned", True), ("ann/3.json", "ann", False), ("ann/deep/1.json", "ann", True)]
    assert rows(feedback.intake(got), "path", "reason") == [("2.json", None), ("ann/3.json", "not a regular file"), ("ann/deep/1.json", None)]


def test_inputs_are_expanded(spark, tmp_path):
    root = tmp_path / ".hidden" / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / ".git").mkdir()
    for name, body in (("a.MD", b"\xef\xbb\xbfa"), ("b.Txt", b"b"), ("c.py", b"c"), ("sub/d.mkd", b"\xff"), (".e.md", b"e"), ("node_modules/f.md", b"f"), (".git/g.md", b"g")):
        (root / name).write_bytes(body)
    read = lambda *paths, **how: sorted((r["path"] if r["error"] and r["text"] is None and r["is_markdown"] is None else r["path"].rpartition("/")[2], r["text"], r["error"]) for r in files.read_documents(spark, list(paths), **how).collect())
    assert read(str(root)) == [("a.MD", "a", None), ("b.Txt", "b", None), ("d.mkd", None, "not UTF-8")]
    assert read(str(root / "c.py"), str(root), str(root / "b.Txt")) == [("a.MD", "a", None), ("b.Txt", "b", None), ("c.py", "c", None), ("d.mkd", None, "not UTF-8")]
    assert read(str(root / "*.py"), str(root / "*.nothing"), str(root / "none")) == [(str(root / "*.nothing"), None, f"no files match: {root / '*.nothing'}"), (str(root / "none"), None, f"not found: {root / 'none'}"), ("c.py", "c", None)]
    assert read(str(root / "a.MD"), keep_bom=True) == [("a.MD", "\ufeffa", None)]


def test_ledger(spark):
    s = spark.createDataFrame([("s1", "adopted", "0" * 64, "CC", "2026-01-31"), ("s2", "odd", None, "", "2026-02-30"), ("s2", "candidate", None, "", "2026-01-01")], "id string, status string, raw_sha256 string, license string, retrieved string")
    assert rows(ledger.source_problems(s), "id", "problem") == [("s2", "bad date"), ("s2", "id occurs again"), ("s2", "unknown status")]
    import hashlib

    ok = hashlib.sha256(b"text").hexdigest()
    e = spark.createDataFrame([("e1", "s1", "adopted", "tuning", "text", ok, ["ex"]), ("e2", "s9", "adopted", "other", "text", "x", ["no"])], "id string, source_id string, status string, split string, text string, text_sha256 string, preserve array<string>")
    assert rows(ledger.excerpt_problems(e, s), "id", "problem") == [("e2", "digest differs"), ("e2", "preserved passage not in text"), ("e2", "source not adopted"), ("e2", "unknown source"), ("e2", "unknown split")]
    chain = spark.createDataFrame([("e", 1, "a", "b"), ("e", 2, "b", "c"), ("e", 3, "x", "d")], "excerpt_id string, step int, input_sha256 string, output_sha256 string")
    assert rows(ledger.broken_chains(chain), "step") == [(3,)]


def test_html(spark):
    page = '<html><body><p>out<main class="content x"><h1>題<p>一<p>二<ul><li>甲<li>乙</ul><table><tr><td>a<td>b</table></main><p>after'
    assert [t for _, t in markup.html_rows(page, "main.content")] == ["題", "一", "二", "甲", "乙", "a", "b"]
    ruby = "<p><ruby>漢字<rp>(</rp><rt>かんじ</rt></ruby>と<em class=\"sesame_dot\">強調</em>と<img alt=\"※(外字)\">。</p>"
    assert markup.html_rows(ruby) == [("p", "漢字《かんじ》と［＃傍点］強調［＃傍点終わり］と※(外字)。")]
    assert markup.html_rows("<p>日本\n語 and\n more") == [("p", "日本語 and more")]
    assert markup.decode_html('<meta charset="shift_jis">あ'.encode("cp932")).endswith("あ")
    got = markup.rows_of(spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string"), "html", markup.html_rows)
    assert got.count() == 9


def test_markdown_and_docx(spark):
    text = "---\nx: 1\n---\n# H\npara\n- a\n\n> q\n\n```\nx\n\ny\n```\n| t |\n\n<!-- c -->"
    assert [k for k, _ in markup.markdown_rows(text)] == ["heading", "list", "quote", "fence", "table", "comment"]
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>題</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    d = spark.createDataFrame([(1, bytearray(raw.getvalue())), (2, bytearray(b"no zip"))], "doc_id long, content binary")
    assert rows(markup.rows_of(d, "content", markup.docx_rows), "doc_id", "kind") == [(1, "H1"), (1, "T1.1.1"), (2, "error")]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.md").write_text("no")
    (tmp_path / "d.png").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, [str(tmp_path)]).collect()}
    assert set(got) == {"a.md", "b.txt"}
    assert (got["a.md"]["text"], got["a.md"]["is_markdown"], got["b.txt"]["error"]) == ("# x", True, "not UTF-8")
    assert spark.createDataFrame([("/r/a",), ("/r/.x/a",), ("/q/a",)], "p string").select(files.guarded(F.col("p"), ["/r"])).collect() == [(True,), (False,), (False,)]
    (tmp_path / "s.json").write_text('{"id": "x"}')
    assert files.read_suite(spark, str(tmp_path / "s.json"), "id string, cases array<string>", ["id", "cases"]).first()["problem"] == "missing: cases"


def test_page_table_carries_headings_down(spark):
    lines = spark.createDataFrame([(1, 1, 1, "あ行"), (1, 1, 2, "亜 1"), (1, 2, 1, "哀 2"), (1, 2, 2, "か行"), (1, 2, 3, "下 3")], "doc_id int, page int, pos int, value string")
    got = rows(markup.page_table(lines, "^(.行)$", r"^(\S) \d+$"), "heading", "entry")
    assert got == [("あ行", "亜"), ("あ行", "哀"), ("か行", "下")]


def test_sinks(spark):
    df = spark.createDataFrame([("a|b", 1), ("c\td", 2)], "k string, n long")
    assert sorted(r[0] for r in sinks.markdown_rows(df).collect()) == ["| a\\|b | 1 |", "| c\td | 2 |"]
    assert sorted(r[0] for r in sinks.tsv_rows(df).collect()) == ["a|b\t1", "c\\td\t2"]
    assert rows(sinks.with_total(df, "k", ["n"]).filter("k = 'TOTAL'"), "n") == [(3,)]
    assert sinks.json_rows(df).count() == 2 and sinks.aligned_rows(df, {"k": 5, "n": 3}).first()[0] == "a|b     1"


def test_streaming(spark, tmp_path):
    from prose_spark.streaming import metrics

    docs(spark, "One! Two? mail a@b.cd").write.parquet(str(tmp_path / "in"))
    s = metrics.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    for n, (df, want) in enumerate(((metrics.sentence_stream(s), 3), (metrics.sensitive_stream(s), 1))):
        q = df.writeStream.format("memory").queryName(f"q{n}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(f"q{n}").count() == want


def test_schedules(spark):
    items = spark.createDataFrame([(f"i{n}",) for n in range(40)], "id string")
    out = evaluation.shuffled_batches(items).collect()
    assert Counter(r["batch"] for r in out) == {0: 15, 1: 15, 2: 10} and len({r["label"] for r in out}) == 40
    plan = evaluation.schedule(items.limit(2).withColumnRenamed("id", "input"), ["a", "b"], 2).collect()
    assert [(r["run"], r["version"]) for r in plan[:4]] == [(1, "a"), (1, "b"), (1, "a"), (1, "b")]
    pairs = spark.createDataFrame([(i, f"d{i // 2}") for i in range(400)], "pair_id int, document_id string")
    got = evaluation.balanced_assignment(pairs).collect()
    assert len({(r["document_id"], r["swapped"]) for r in got}) == 200 and 80 <= sum(r["swapped"] for r in got) // 2 <= 120


def test_structure(spark):
    pairs = spark.createDataFrame([(1, "# A\n**Label**: x\n10 and 4", "# A\n## B\n10, 6 and 7"), (2, None, None)], "pair_id int, before string, after string")
    got = {r["pair_id"]: r for r in structure.structure_changes(pairs).collect()}
    assert (got[1]["heading_state"], got[1]["labels_lost"], sorted(got[1]["numbers_new"]), got[1]["numbers_made_up"]) == ("split", ["Label"], [6.0, 7.0], [7.0])
    assert got[2]["heading_state"] == "same"
    texts = spark.createDataFrame([("a", "yes"), ("b", None)], "case_id string, text string")
    checks = spark.createDataFrame([("a", "must", "y.s"), ("a", "never", "yes"), ("b", "must", "x"), ("c", "never", "x")], "case_id string, kind string, pattern string")
    assert rows(structure.pattern_checks(texts, checks), "case_id", "kind", "holds") == [("a", "must", True), ("a", "never", False), ("b", "must", False), ("c", "never", True)]
    watched = spark.createDataFrame([("a", "1", "1", None), ("b", "1", "2", None), ("c", None, "1", None), ("d", "1", None, None), ("e", "1", "1", "x")], "source_id string, reviewed string, head string, error string")
    assert [r[1] for r in rows(structure.source_changes(watched), "source_id", "state")] == ["unchanged", "changed", "new", "gone", "error"]


def test_windowed_counts(spark, tmp_path):
    from prose_spark.streaming import metrics

    rows = spark.sql("select timestamp'2026-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2026-01-01 00:50:00', 'a' union all select timestamp'2026-01-01 03:00:00', 'b'")
    rows.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = metrics.windowed_counts(s, "ts", ["k"]).writeStream.format("memory").queryName("wc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["k"], r["n"]) for r in spark.table("wc").collect()] == [("a", 2)]


def test_ranks_balance_exactly_over_many_documents(spark):
    for n in (2000, 2001):
        pairs = spark.range(n * 2).select(F.col("id").alias("pair_id"), F.format_string("d%d", F.floor(F.col("id") / 2)).alias("document_id"))
        got = evaluation.balanced_assignment(pairs, seed=3)
        per = got.groupBy("document_id").agg(F.count_distinct("swapped").alias("k"), F.first("swapped").alias("s"))
        facts = per.agg(F.count(F.lit(1)), F.max("k"), F.count_if("s")).first()
        assert (facts[0], facts[1]) == (n, 1) and facts[2] in (n // 2, (n + 1) // 2)
        other = evaluation.balanced_assignment(pairs.repartition(7), seed=3)
        assert got.exceptAll(other).isEmpty()
    items = spark.range(3000).select(F.format_string("i%d", "id").alias("id"))
    out = evaluation.shuffled_batches(items, size=7)
    assert sorted(r[0] for r in out.select("nth").collect()) == list(range(1, 3001))
    assert out.groupBy("batch").count().agg(F.max("count")).first()[0] == 7
    by_seed = [[r[0] for r in evaluation.shuffled_batches(items, seed=s).orderBy("nth").limit(50).collect()] for s in (1, 1, 2)]
    assert by_seed[0] == by_seed[1] != by_seed[2]


def test_readers_see_one_side(spark):
    pairs = spark.range(10).select(F.col("id").alias("pair_id"), "id", F.lit("v1").alias("first"), F.lit("v2").alias("second")).withColumnRenamed("id", "document_id")
    left, right = ({r["pair_id"]: r["variant"] for r in evaluation.reader_assignment(pairs, s).collect()} for s in ("left", "right"))
    assert all({left[i], right[i]} == {"v1", "v2"} for i in range(10)) and sorted(left.values()) == ["v1"] * 5 + ["v2"] * 5


def test_first_and_more(spark):
    shown, more = evaluation.first_and_more(spark.range(7), ["id"], 3)
    assert [r[0] for r in shown.collect()] == [0, 1, 2] and more.first()[0] == 4
    shown, more = evaluation.first_and_more(spark.range(2), ["id"], 3)
    assert shown.count() == 2 and more.first()[0] == 0
    shown, more = evaluation.first_and_more(spark.range(7), ["id"], 0)
    assert shown.count() == 7 and more.first()[0] == 0


def test_labels_and_stamps(spark):
    run = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, score int")
    labels = spark.createDataFrame([("a", "pass")], "case_id string, expected string")
    assert rows(evaluation.labelled_run(run, labels).na.fill(""), "case_id", "expected", "problem") == [("a", "pass", ""), ("b", "", "no label")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = spark.sql("select timestamp_seconds(1774836000) as t, timestamp_seconds(1762063200.5) as u").select(T.utc_stamp(F.col("t")), T.utc_stamp(F.col("u"))).first()
            assert tuple(got) == ("2026-03-30T02:00:00Z", "2025-11-02T06:00:00Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_docx_parts(spark):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="1"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:t>題</w:t><w:tab/><w:t>一</w:t></w:r></w:p><w:p/>'
        '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
        '<w:p><w:r><w:t>文</w:t><w:footnoteReference w:id="2"/><w:cr/><w:t>末</w:t></w:r></w:p>'
    )
    parts = {
        "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>注</w:t></w:r></w:p></w:footnote></w:footnotes>',
    }
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    d = spark.createDataFrame([(1, raw.getvalue()), (2, b"no zip"), (3, None)], "doc_id long, content binary")
    got = [tuple(r) for r in markup.docx_lines(d, "content").orderBy("doc_id", "ordinal").select("doc_id", "part", "style", "numbering", "text").collect()]
    assert got[:-1] == [
        (1, "P1", "heading 1", "4:0", "題\t一"), (1, "P2", "", "", ""), (1, "T1.1.1", "", "", "甲 / 乙"), (1, "T1.1.2", "", "", ""), (1, "P3", "", "", "文[^2]\n末"), (1, "N2", "", "", "注"),
    ]
    assert got[-1][:2] == (2, "error")


def test_exact_percentiles_against_spark_s_own(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([None, float("nan"), rng.random(), rng.gauss(0, 1e9), 7.0]) if g != "b" else 3.0, rng.randint(-5, 5)) for g in ("a", "b", None, "c") for _ in range(501)]
    data += [("one", 2.5, 1), ("two", 1.0, None), ("two", 4.0, None), ("none", None, None)]
    d = spark.createDataFrame(data, "g string, x double, n int")
    shares = [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]
    wanted = {f"{c}{i}": (c, p) for c in ("x", "n") for i, p in enumerate(shares)}
    want = sorted(map(repr, d.groupBy("g").agg(*[F.percentile(c, F.lit(p)).alias(k) for k, (c, p) in wanted.items()]).collect()))
    for how in ({}, {"near": 0.0}, {"near": 0.3}, {"most": 2}):
        assert sorted(map(repr, evaluation.exact_percentiles(d, ["g"], wanted, **how).collect())) == want
    plan = evaluation.percentiles(d, ["g"], "x", [0.05])._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan  # which gathers a group's values in one task
