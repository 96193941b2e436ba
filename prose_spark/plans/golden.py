"""Queries over small rows of their own: Japanese text, pages, tickets and scores, which the shared tables don't hold, with the rows that must
come out. Each pair of a builder and its rows is a query and its SQL (a VALUES list)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comparison, evaluation, feedback, preservation, readability, rules, structure, validation
from ..sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"null::{kind}"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{str(value).lower()}::{kind}"


def golden(columns: str, rows: list[tuple]) -> Callable:
    """columns: name and type of each, as in SQL."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))

    def add(build: Callable[[SparkSession], DataFrame]) -> Callable:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(spark).select(*names)
        values = ", ".join("(" + ", ".join(map(_literal, r, kinds)) + ")" for r in rows)
        ORACLES[build.__name__] = f"select * from (values {values or "(" + ", ".join(f"null::{k}" for k in kinds) + ")"}) t({', '.join(names)})"
        return build

    return add


def _texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def _pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs, 1)], "pair_id long, before string, after string")


def _list(c: str) -> Column:
    return F.array_join(c, "|").alias(c)

METRICS = ["漢字ひらがな。", "りんご、みかん、ぶどうを買った。次に帰った。", "", "あ" * 45 + "。", "あ" * 44 + "。", "あ。い。う。", "あ。い。う", "- あ。\n- い。\n- う。", "あ" * 200, "# 題\n\n本文。\n\n```\nコード。\n```\n> 引用です、はい。"]


@golden(
    "doc_id bigint, chars bigint, kanji bigint, hiragana bigint, paragraphs bigint, long_paragraphs bigint, sentences bigint, sentence_chars bigint, long_sentences bigint, short_runs bigint, commas bigint, kanji_ratio double, avg_sentence_length double, commas_per_sentence double",
    [
        (1, 7, 2, 4, 1, 0, 1, 7, 0, 0, 0, 0.285714, 7.0, 0.0),
        (2, 22, 3, 15, 1, 0, 2, 22, 0, 0, 2, 0.136364, 11.0, 1.0),
        (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0),
        (4, 46, 0, 45, 1, 0, 1, 46, 1, 0, 0, 0.0, 46.0, 0.0),
        (5, 45, 0, 44, 1, 0, 1, 45, 0, 0, 0, 0.0, 45.0, 0.0),
        (6, 6, 0, 3, 1, 0, 3, 6, 0, 1, 0, 0.0, 2.0, 0.0),
        (7, 5, 0, 3, 1, 0, 3, 5, 0, 0, 0, 0.0, 1.666667, 0.0),
        (8, 6, 0, 3, 3, 0, 3, 6, 0, 0, 0, 0.0, 2.0, 0.0),
        (9, 200, 0, 200, 1, 1, 1, 200, 1, 0, 0, 0.0, 200.0, 0.0),
        (10, 11, 4, 4, 2, 0, 2, 11, 0, 0, 1, 0.363636, 5.5, 0.5),
    ],
)
def golden_metrics(spark: SparkSession) -> DataFrame:
    out = readability.with_ratios(readability.document_metrics(_texts(spark, METRICS)))
    return out.withColumns({c: F.round(c, 6) for c in ("kanji_ratio", "avg_sentence_length", "commas_per_sentence")})


@golden(
    "doc_id bigint, line int, length int, sentences bigint, preview varchar",
    [
        (1, 3, 9, 3, "はい。そう。です。"),
        (3, 1, 6, 3, "あ。い。う。"),
        (4, 1, 10, 3, "いいえ。はい！そう？"),
    ],
)
def golden_short_runs(spark: SparkSession) -> DataFrame:
    return readability.short_runs(readability.split_blocks(_texts(spark, ["# 題\n\nここは短くない長さを超えている文章で書かれています。はい。そう。です。", "あ。い。", "あ。い。う。え", "いいえ。\nはい！\nそう？\n長い長い長い長い長い長い長い長い長い長い文。"])))


POINTED = ["初回課金転換率を見る。", "課金転換率を見る。", "運用コストの削減の実現の効果を測る。", "運用コストの削減の実現を測る。", "できないわけではない。やらないとは限らない。", "これは（" + "あ" * 40 + "。" + "い" * 25 + "）です。", "これは（短い。文）です。", "**「強調」**です。\n\n前**「強調」**後", "`**a**` と \\**b*\\* です"]


@golden(
    "doc_id bigint, kind varchar, line int, length int, snippet varchar",
    [
        (1, "kanji-run", 1, 7, "初回課金転換率を見る。"),
        (3, "no-chain", 1, 14, "運用コストの削減の実現の効果を測る。"),
        (5, "double-negative", 1, 8, "できないわけではない。"),
        (5, "double-negative", 1, 8, "やらないとは限らない。"),
        (6, "paren-sentence", 1, 68, "これは（ああああああああああああああああああああああああああああああああああああああああ。いいいいいいいいいいいいいいいいいいいいいいいいい）です。"),
        (8, "unrendered-bold", 1, 8, "**「強調」**です。"),
        (8, "unrendered-bold", 3, 8, "前**「強調」**後"),
    ],
)
def golden_pointers(spark: SparkSession) -> DataFrame:
    return readability.pointers(_texts(spark, POINTED))


@golden(
    "doc_id bigint, kanji_run bigint, no_chain bigint, double_negative bigint, paren_sentence bigint",
    [
        (1, 1, 0, 0, 0),
        (2, 0, 0, 0, 0),
        (3, 0, 1, 0, 0),
        (4, 0, 0, 0, 0),
        (5, 0, 0, 2, 0),
        (6, 0, 0, 0, 1),
        (7, 0, 0, 0, 0),
        (8, 0, 0, 0, 0),
        (9, 0, 0, 0, 0),
    ],
)
def golden_pointer_counts(spark: SparkSession) -> DataFrame:
    return readability.pointer_counts(readability.sentence_rows(readability.split_blocks(_texts(spark, POINTED))))


@golden(
    "doc_id bigint, rank int, sent int, length int, omitted bigint",
    [
        (1, 1, 0, 51, 1),
        (1, 1, 1, 61, 1),
        (2, 1, 0, 61, 1),
    ],
)
def golden_longest(spark: SparkSession) -> DataFrame:
    found = readability.long_sentences(readability.sentence_rows(readability.split_blocks(_texts(spark, ["い" * 50 + "。" + "う" * 60 + "。", "あ" * 60 + "。短い。", "え" * 47 + "。"]))))
    out = readability.top_candidates(found, 3)
    return out.select("doc_id", F.col("line").alias("rank"), "sent", "length", "omitted")


@golden(
    "doc_id bigint, check_id varchar, line int, col int, text varchar, expected varchar, opening_line int, opening_column int",
    [
        (1, "BRACKET-ORDER", 1, 4, "）", "」", 1, 2),
        (2, "BRACKET-ORDER", 1, 4, "）", "」", 1, 2),
        (2, "BRACKET-UNCLOSED", 1, 2, "「", "」", None, None),
        (3, "BRACKET-UNEXPECTED", 1, 3, "】", "【", None, None),
        (5, "BRACKET-UNCLOSED", 2, 1, "（", "）", None, None),
        (6, "BRACKET-UNEXPECTED", 1, 2, ")", "(", None, None),
    ],
)
def golden_brackets(spark: SparkSession) -> DataFrame:
    found = preservation.in_order(preservation.brackets(_texts(spark, ["（「雨）」", "（「雨）", "（雨】）", "「よし」（済）", "一行\r\n（二行「三」", "a)b"])))
    return found.withColumnRenamed("column", "col")


PAIRS = [
    ("タイムアウトは30秒である。", "タイムアウトは3秒である。"), ("30秒間待つ。", "30秒待つ。"), ("50パーセントである。", "50%である。"), ("3ヶ所を直す。", "3か所を直す。"),
    ("1件と1件と2件。", "1件。"), ("担当者が確認する。", "管理者が確認する。"), ("`make test` を実行する。", "`make` を実行する。"), ("詳細は https://a.example/x を見る。", "詳細は https://b.example を見る。"),
    ("APIとサーバーを使う。", "APIを使う。"), ("１２件ある。", "12件ある。"),
]


@golden(
    "pair_id bigint, kind varchar, change varchar, pos int, line int, text varchar, item_key varchar",
    [
        (1, "number", "added", 0, 1, "3秒", "3秒"),
        (1, "number", "missing", 0, 1, "30秒", "30秒"),
        (3, "term", "missing", 1, 1, "パーセント", "パーセント"),
        (5, "number", "missing", 1, 1, "1件", "1件"),
        (5, "number", "missing", 2, 1, "2件", "2件"),
        (6, "role", "added", 0, 1, "管理者", "管理者"),
        (7, "code", "added", 0, 1, "`make`", "`make`"),
        (7, "code", "missing", 0, 1, "`make test`", "`make test`"),
        (8, "url", "added", 0, 1, "https://b.example", "https://b.example"),
        (8, "url", "missing", 0, 1, "https://a.example/x", "https://a.example/x"),
        (9, "term", "missing", 1, 1, "サーバー", "サーバー"),
    ],
)
def golden_item_changes(spark: SparkSession) -> DataFrame:
    return comparison.item_changes(comparison.parsed(_pairs(spark, PAIRS))).withColumnRenamed("key", "item_key")


REWRITES = [
    ("設定を変更しないでください。再起動が必要です。", "設定を変更してください。再起動が必要です。"),
    ("この機能は将来使える可能性がある。", "この機能は将来使える。"),
    ("必ず保存する。画面を閉じる。", "画面を閉じる。"),
    ("利用者は設定画面を開き、値を入力して保存する。", "利用者は設定画面を開く。値を入力して保存する。"),
    ("手順を説明します。次に進みます。", "手順を説明する。次に進む。"),
    ("はい。", "いいえ。"),
]


@golden(
    "pair_id bigint, side varchar, pos int, n_units int, hits int, first int, last int, judgeable boolean",
    [
        (1, "after", 0, 5, 5, 0, 1, True),
        (1, "after", 1, 6, 6, 0, 2, True),
        (1, "before", 0, 5, 5, 0, 1, True),
        (1, "before", 1, 6, 6, 0, 2, True),
        (2, "after", 0, 7, 7, 0, 1, True),
        (2, "before", 0, 11, 7, 0, 1, True),
        (3, "after", 0, 4, 4, 0, 2, True),
        (3, "before", 0, 4, 0, 0, 1, True),
        (3, "before", 1, 4, 4, 0, 1, True),
        (4, "after", 0, 10, 9, 0, 1, True),
        (4, "after", 1, 7, 7, 0, 1, True),
        (4, "before", 0, 18, 16, 0, 2, True),
        (5, "after", 0, 5, 4, 0, 1, True),
        (5, "after", 1, 3, 2, 0, 2, False),
        (5, "before", 0, 5, 4, 0, 1, True),
        (5, "before", 1, 3, 2, 0, 2, False),
        (6, "after", 0, 0, None, None, None, False),
        (6, "before", 0, 0, None, None, None, False),
    ],
)
def golden_alignment(spark: SparkSession) -> DataFrame:
    return comparison.alignment(comparison.parsed(_pairs(spark, REWRITES))).withColumnsRenamed({"start": "first", "end": "last"})


@golden(
    "pair_id bigint, side varchar, pos int, line int, text varchar",
    [
        (3, "before", 0, 1, "必ず保存する。"),
    ],
)
def golden_unmatched(spark: SparkSession) -> DataFrame:
    return comparison.unmatched(comparison.alignment(comparison.parsed(_pairs(spark, REWRITES))))


@golden(
    "pair_id bigint, side varchar, kind varchar, pos int, line int, text varchar",
    [
        (1, "before", "negation", 0, 1, "設定を変更しないでください。"),
        (2, "before", "conjecture", 0, 1, "この機能は将来使える可能性がある。"),
    ],
)
def golden_markers(spark: SparkSession) -> DataFrame:
    return comparison.marker_changes(comparison.alignment(comparison.parsed(_pairs(spark, REWRITES))))


@golden(
    "pair_id bigint, polite_before int, plain_before int, polite_after int, plain_after int, style_before varchar, style_after varchar, changed boolean",
    [
        (1, 2, 0, 2, 0, "polite", "polite", False),
        (2, 0, 1, 0, 1, "plain", "plain", False),
        (3, 0, 2, 0, 1, "plain", "plain", False),
        (4, 0, 1, 0, 2, "plain", "plain", False),
        (5, 2, 0, 0, 2, "polite", "plain", True),
        (6, 0, 1, 0, 1, "plain", "plain", False),
    ],
)
def golden_style(spark: SparkSession) -> DataFrame:
    return comparison.style_shift(comparison.parsed(_pairs(spark, REWRITES)))


NOTED = [
    "サーバーを止める。サーバーを再起動する。サーバーを確認する。サーバを停止する。", "`こんにちわ`と書く。\n> こんにちわ\nこんにちわ。", "申し込み書と申し込みを見る。", "いなづま、いなづま。", "https://a.example/こんにちわ を見る。",
    "---\na: 予め\n---\n予め決める。3ヶ月後。",
]


@golden(
    "doc_id bigint, rule_id varchar, category varchar, at_char int, line int, col int, text varchar, candidates varchar, reason_code varchar, times int",
    [
        (1, "CONSIST-001", "recommendation", 0, 1, 1, "サーバー", "サーバ", "glossary:use", 3),
        (1, "GAIRAI-001", "accepted_variant", 30, 1, 31, "サーバ", "サーバー", "rule", None),
        (2, "KANA-001", "error", 20, 3, 1, "こんにちわ", "こんにちは", "rule", None),
        (2, "KANA-001", "excluded", 1, 1, 2, "こんにちわ", "こんにちは", "protected:inline_code", None),
        (2, "KANA-001", "excluded", 14, 2, 3, "こんにちわ", "こんにちは", "protected:quote", None),
        (3, "OKURI-003", "accepted_variant", 0, 1, 1, "申し込み", "申込み", "rule", None),
        (3, "OKURI-003", "accepted_variant", 6, 1, 7, "申し込み", "申込み", "rule", None),
        (4, "KANA-004", "accepted_variant", 0, 1, 1, "いなづま", "いなずま", "rule", 2),
        (5, "KANA-001", "excluded", 18, 1, 19, "こんにちわ", "こんにちは", "protected:url", None),
        (6, "KANJI-002", "accepted_variant", 14, 4, 1, "予め", "あらかじめ", "rule", None),
        (6, "KANJI-002", "excluded", 7, 2, 4, "予め", "あらかじめ", "protected:frontmatter", None),
        (6, "NUM-001", "accepted_variant", 20, 4, 7, "3ヶ月", "3か月", "rule", None),
    ],
)
def golden_notation(spark: SparkSession) -> DataFrame:
    found = rules.check_documents(_texts(spark, NOTED), use=("サーバ",)).withColumnsRenamed({"offset": "at_char", "column": "col", "count": "times"})
    return found.withColumn("candidates", _list("candidates"))


@golden(
    "doc_id bigint, error bigint, recommendation bigint, needs_context bigint, accepted_variant bigint, excluded bigint, failed boolean",
    [
        (1, 0, 1, 0, 0, 0, False),
        (2, 1, 0, 0, 0, 2, True),
        (3, 1, 0, 1, 0, 0, True),
        (4, 0, 0, 0, 1, 0, False),
        (5, 0, 0, 0, 0, 1, False),
        (6, 0, 2, 0, 0, 1, False),
        (7, 0, 0, 0, 0, 0, False),
    ],
)
def golden_notation_counts(spark: SparkSession) -> DataFrame:
    docs = _texts(spark, [*NOTED, "何もない。"])
    found = rules.check_documents(docs, profile="official")
    return rules.category_counts(found, docs).join(rules.run_status(found, docs, "error"), "doc_id")


@golden(
    "doc_id bigint, ordinal int, kind varchar, text varchar",
    [
        (1, 1, "h1", "題"),
        (1, 2, "p", "一"),
        (1, 3, "p", "二"),
        (1, 4, "li", "甲"),
        (1, 5, "li", "乙"),
        (1, 6, "td", "a"),
        (1, 7, "td", "b"),
        (2, 1, "p", "漢字《かんじ》と［＃傍点］強調［＃傍点終わり］と※(外字)。"),
        (2, 2, "p", "次の行"),
        (3, 1, "pre", " a\n  b"),
        (3, 2, "p", "日本語 text more"),
    ],
)
def golden_html(spark: SparkSession) -> DataFrame:
    pages = [
        "<nav>外</nav><main class=content><h1>題<a class=headerlink>¶</a></h1><p>一<p>二<ul><li>甲<li>乙</ul><table><tr><td>a<td>b</table></main><p>外",
        "<main class=content><p><ruby>漢字<rp>(</rp><rt>かんじ</rt><rp>)</rp></ruby>と<em class=sesame_dot>強調</em>と<img alt='※(外字)' src=x>。<br>次の行</p><script>x</script></main>",
        "<main class='content wide'><pre>\n a\n  b\n</pre><p>日本\n語 text\n more</main>",
        "<p>外だけ",
    ]
    return markup.rows_of(_texts(spark, pages), "text", _main_rows)


def _main_rows(html: str) -> list[tuple[str, str]]:
    return markup.html_rows(html, "main.content")


@golden(
    "doc_id bigint, ordinal int, kind varchar, text varchar",
    [
        (1, 1, "heading", "# 題"),
        (1, 2, "paragraph", "本文一\n本文二"),
        (1, 3, "quote", "> 引用"),
        (1, 4, "table", "| a | b |"),
        (1, 5, "list", "- 甲\n- 乙"),
        (1, 6, "comment", "<!-- 注 -->"),
        (2, 1, "fence", "```py\n# x\n\ny\n```"),
        (2, 2, "paragraph", "後"),
        (2, 3, "fence", "~~~~\nz\n~~~\n~~~~"),
        (2, 4, "heading", "#!sh 行"),
    ],
)
def golden_markdown(spark: SparkSession) -> DataFrame:
    texts = ["﻿---\nt: x\n---\n# 題\n本文一\n本文二\n\n> 引用\n\n| a | b |\n\n- 甲\n- 乙\n\n<!-- 注 -->", "```py\n# x\n\ny\n```\n後\n~~~~\nz\n~~~\n~~~~\n#!sh 行"]
    return markup.rows_of(_texts(spark, texts), "text", markup.markdown_rows)


@golden(
    "pair_id bigint, only_newlines_inserted boolean, non_newline_identical boolean, newlines_removed boolean, inserted_newlines bigint",
    [
        (1, True, True, False, 1),
        (2, False, True, True, -1),
        (3, False, False, False, 0),
        (4, True, True, False, 1),
        (5, False, True, True, 0),
    ],
)
def golden_newlines(spark: SparkSession) -> DataFrame:
    return preservation.newline_insertions(_pairs(spark, [("雨が降った。風が吹いた。", "雨が降った。\n風が吹いた。"), ("一\n二", "一二"), ("一", "一。"), ("一\r\n二三", "一\n二\n三"), ("一\n二三", "一二\n三")]))


@golden(
    "pair_id bigint, identical boolean, before_chars int, after_chars int, before_paragraphs int, after_paragraphs int, position int, before_context varchar, after_context varchar",
    [
        (1, True, 12, 12, 2, 1, None, None, None),
        (2, False, 6, 6, 1, 1, 1, "雨が降った。", "雪が降った。"),
        (3, False, 0, 1, 0, 1, 1, "", "一"),
        (4, False, 3, 4, 3, 2, 4, "一二三", "一二三四"),
    ],
)
def golden_preserved(spark: SparkSession) -> DataFrame:
    return preservation.preserved(_pairs(spark, [("雨が 降った。\n\n風が吹いた。", "雨が降った。風が吹いた。"), ("雨が降った。", "雪が降った。"), ("", "一"), ("一\n\n二\n\n三", "一\n\n二三四")]))


TICKETS = [
    ("a/1.json", {}), ("a/2.json", {}), ("b/1.json", {"comment": "別"}), ("b/2.json", {"extra": 1}), ("c/1.json", {"quote": "ない"}), ("c/2.json", {"severity": "huge"}), ("c/3.json", {"original": " "}), ("d d/1.json", {"comment": "x"}), ("e/1.json", {"comment": "a\x07"}),
]


@golden(
    "path varchar, submitter varchar, reason varchar, accepted boolean",
    [
        ("a/1.json", "a", None, True),
        ("a/2.json", "a", "sent before", False),
        ("b/1.json", "b", None, True),
        ("b/2.json", "b", "unknown or missing keys", False),
        ("c/1.json", "c", "quote not in its text", False),
        ("c/2.json", "c", "unknown problem type or severity", False),
        ("c/3.json", "c", "text missing, empty or too long", False),
        ("d d/1.json", "d d", "bad submitter", False),
        ("e/1.json", "e", "control characters", False),
        ("z/1.json", "z", "not JSON", False),
        ("z/2.json", "z", "unknown or missing keys", False),
    ],
)
def golden_tickets(spark: SparkSession) -> DataFrame:
    case = {"original": "元の文。", "result": "直した文。", "problem_type": "other", "quote": "直した", "quote_in": "result", "severity": "minor", "comment": ""}
    top = {
        "schema_version": 1, "kind": feedback.TICKET_KIND, "consent": {"version": 1, "storage": True, "ai_processing": False, "publish": False},
        "context": {"mode": "A", "origin": "artificial", "skill_version": "", "model": ""},
    }
    bodies = [(path, json.dumps(top | {"case": case | more}).encode()) for path, more in TICKETS] + [("z/1.json", b"{"), ("z/2.json", json.dumps(top | {"consent": {}, "case": case}).encode())]
    rows = [(path, path.split("/")[0], len(b), True, b) for path, b in bodies]
    out = feedback.intake(spark.createDataFrame(rows, "path string, submitter string, size long, regular boolean, content binary"))
    return out.withColumn("accepted", F.col("reason").isNull() & F.col("finding_id").isNotNull())


@golden(
    "case_id bigint, documents bigint, mean double, status varchar, low double, high double",
    [
        (1, 2, 0.0, "estimated", -1.0, 1.0),
        (2, 0, None, "insufficient", None, None),
        (3, 1, 1.0, "insufficient", None, None),
        (4, 3, 0.0, "degenerate", None, None),
        (5, 4, 0.5, "estimated", 0.0, 1.0),
    ],
)
def golden_bootstrap(spark: SparkSession) -> DataFrame:
    sets = [[1.0, -1.0], [], [1.0], [0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0]]
    out = [evaluation.bootstrap_exact(spark.createDataFrame([(v,) for v in s], "value double")).withColumn("case_id", F.lit(i).cast("long")) for i, s in enumerate(sets, 1)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@golden(
    "doc_id bigint, kanji int, hiragana int, commas int, ended boolean, preview varchar, mode varchar, json varchar, cleaned varchar, paragraphs int, n_urls int",
    [
        (1, 3, 3, 1, True, "モード A で直す、々と𠮷。", "A", None, "モード A で直す、々と", 1, 0),
        (2, 2, 0, 0, False, "前 {\"a\": {\"b\": 1}} 後」", None, "{\"a\": {\"b\": 1}}", "前 {\"a\": {\"b\"", 1, 0),
        (3, 4, 0, 0, False, "一 二 三 四", None, None, "一??二?三?? ??四", 3, 0),
        (4, 1, 2, 0, False, "見る https://a.example/b). と htt…", None, None, "見る https://a", 1, 2),
        (5, 41, 1, 0, True, "長い文文文文文文文文文文文文文文文文文文文文文文文文文文文文…", None, None, "\u3000長い文文文文文文文文文", 1, 0),
        (6, 0, 0, 0, False, "a\u202eb\x07c モードA モードB", None, None, "a?b?c モードA モ", 1, 0),
    ],
)
def golden_text_functions(spark: SparkSession) -> DataFrame:
    t = F.col("text")
    docs = _texts(spark, ["モード A で直す、々と𠮷。", "前 {\"a\": {\"b\": 1}} 後」", "一\n\n二\n三\r\n \r\n四", "見る https://a.example/b). と http://c.example,", "　長い" + "文" * 40 + "！」", "a‮b\x07c モードA モードB"])
    return docs.select("doc_id", T.kanji(t).alias("kanji"), T.hiragana(t).alias("hiragana"), T.commas(t).alias("commas"), T.ends_with_terminator(t).alias("ended"), T.preview(t).alias("preview"), T.mode_of(t).alias("mode"), T.json_slice(t).alias("json"), T.cleaned(t, 12).alias("cleaned"), T.paragraphs(t).alias("paragraphs"), F.size(T.urls(t)).alias("n_urls"))


PROBLEMS = "id varchar, problem varchar"


@golden(
    PROBLEMS,
    [
        ("b", "no input"),
        ("c", "field missing"),
        ("c", "preserve empty"),
        ("d", "covers empty"),
        ("d", "forbid empty"),
        ("e", "id occurs again"),
    ],
)
def golden_suite_cases(spark: SparkSession) -> DataFrame:
    full, part = ["x"], ["x", " "]
    cases = [("a", "r", "", "t", "d", full, full, full), ("b", "r", " ", "", "d", full, full, full), ("c", None, "c", "t", "d", [], full, full), ("d", "r", "c", "", "d", full, None, part)]
    cases += [("e", "r", "c", "t", "d", full, full, full)] * 2
    lists = "array<string>"
    return validation.case_problems(spark.createDataFrame(cases, f"id string, request string, context string, text string, domain string, preserve {lists}, forbid {lists}, covers {lists}"))


@golden(PROBLEMS, [("b", "no candidate"), ("c", "unknown expectation"), ("d", "field missing"), ("d", "no input")])
def golden_suite_controls(spark: SparkSession) -> DataFrame:
    rows = [("a", "", "t", "x", "pass"), ("b", "c", "", " ", "fail"), ("c", "c", "t", "x", "uncertain"), ("d", None, "", "x", "pass")]
    return validation.control_problems(spark.createDataFrame(rows, "id string, context string, text string, candidate string, expected string"))


@golden(PROBLEMS, [("b", "no original"), ("d", "unknown operation"), ("e", "no original"), ("g", "unknown mode"), ("g", "no request")])
def golden_tasks(spark: SparkSession) -> DataFrame:
    rows = [("a", "A", None, "r", None, "x"), ("b", "B", None, "r", "", "x"), ("c", "C", None, "r", "o", "x"), ("d", "D", "rewrite", "r", "", "x"), ("e", "D", "revise", "r", "", "x"), ("f", "D", "draft", "r", "", "x"), ("g", "E", None, "", "o", "x")]
    return validation.task_problems(spark.createDataFrame(rows, "id string, mode string, operation string, request string, original string, candidate string"))


@golden(
    PROBLEMS,
    [("b", "mode is not B"), ("c", "not two candidates"), ("c", "other candidates"), ("d", "bad candidate name"), ("d", "other candidates"), ("e", "no candidate")],
)
def golden_pair_inputs(spark: SparkSession) -> DataFrame:
    two = {"v1": "x", "v2": "y"}
    rows = [("a", "B", "o", two), ("b", "A", "o", two), ("c", "B", "o", {"v1": "x"}), ("d", "B", "o", {"v1": "x", "tie": "y"}), ("e", "B", "o", {"v1": "x", "v2": " "})]
    return validation.pair_problems(spark.createDataFrame(rows, "id string, mode string, original string, candidates map<string, string>"))


SCORES = {"readability": 5, "naturalness": None, "style": 1}


@golden(
    PROBLEMS,
    [
        ("c", "unknown contract"),
        ("c", "preference without a pass"),
        ("d", "score dimensions"),
        ("e", "score not 1 to 5"),
        ("f", "preference without a pass"),
        ("g", "preference without a comparison"),
        ("h", "comparison without a preference"),
        ("i", "unknown preference"),
        ("i", "no reason"),
    ],
)
def golden_reviews(spark: SparkSession) -> DataFrame:
    rows = [
        ("a", "B", "pass", SCORES, "candidate", "r"), ("b", "A", "fail", SCORES, "not_applicable", "r"), ("c", "B", "maybe", SCORES, "tie", "r"), ("d", "C", "pass", {"style": 3}, "tie", "r"),
        ("e", "B", "pass", SCORES | {"style": 6}, "tie", "r"), ("f", "B", "fail", SCORES, "original", "r"), ("g", "D", "pass", SCORES, "uncertain", "r"), ("h", "C", "pass", SCORES, "not_applicable", "r"),
        ("i", "B", "pass", SCORES, "both", " "),
    ]
    return validation.review_problems(spark.createDataFrame(rows, "id string, mode string, contract string, scores map<string, int>, preference string, reason string"))


@golden(PROBLEMS, [("c", "unknown issue"), ("c", "quote not in candidate"), ("d", "unknown severity"), ("d", "issue without a reason"), ("e", "quote not in candidate")])
def golden_candidate_reviews(spark: SparkSession) -> DataFrame:
    issues = {"a": [], "b": [("number", "major", "三つ", "数が違う")], "c": [("spelling", "minor", "四つ", "r")], "d": [("style", "huge", "ある", "")], "e": [("other", "minor", " ", "r")], "f": None}
    rows = [(k, "箱が三つある。", "pass", SCORES, "r", v) for k, v in issues.items()]
    kind = "array<struct<category: string, severity: string, quote: string, reason: string>>"
    return validation.candidate_problems(spark.createDataFrame(rows, f"id string, candidate string, contract string, scores map<string, int>, reason string, issues {kind}"))


@golden(PROBLEMS, [("b", "preference without two passes"), ("d", "unknown preference"), ("e", "no reason"), ("e", "unknown contract")])
def golden_pair_reviews(spark: SparkSession) -> DataFrame:
    rows = [("a", "pass", "pass", "left", "r"), ("b", "pass", "fail", "left", "r"), ("c", "pass", "fail", "uncertain", "r"), ("d", "pass", "pass", "both", "r"), ("e", None, "pass", "uncertain", "")]
    return validation.pair_review_problems(spark.createDataFrame(rows, "id string, left_contract string, right_contract string, preference string, reason string"))


@golden(
    PROBLEMS,
    [("b", "fewer than two options"), ("b", "no such answer"), ("c", "options repeated"), ("d", "evidence not in text"), ("d", "no verified_by"), ("e", "id occurs again")],
)
def golden_questions(spark: SparkSession) -> DataFrame:
    def row(i: str, doc: str = "x", options: list[str] = ["三", "四"], answer: int = 0, evidence: str = "三つ", by: str = "v") -> tuple:  # noqa: B006
        return i, doc, "いくつ", options, answer, evidence, by, "r", "箱が三つある。"

    rows = [row("a"), row("b", options=["三"], answer=1), row("c", options=["三", "三"]), row("d", evidence="四つ", by=""), row("e"), row("e"), row("a", "y")]
    return validation.question_problems(spark.createDataFrame(rows, "id string, document_id string, prompt string, options array<string>, answer_index int, evidence string, verified_by string, verification_reason string, original string"))


@golden(
    PROBLEMS,
    [
        ("f2", "confirmed without preserve, forbid or rules"),
        ("f3", "made from other findings"),
        ("f4", "unknown status, split or type"),
        ("f5", "quote not in text"),
        ("f6", "confirmer, reason or quote missing"),
        ("f7", "no decision"),
        ("f8", "id occurs again"),
        ("f9", "unknown finding"),
    ],
)
def golden_decisions(spark: SparkSession) -> DataFrame:
    sha, full = "s", ["x"]

    def row(i: str, status: str = "no_problem", split: str = "tuning", who: str = "c", quote: str = "三つ", of: str = sha, rules: list[str] = full) -> tuple:
        return i, of, status, split, "other", who, "r", quote, full, full, rules

    rows = [
        row("f1", "confirmed_problem"), row("f2", "confirmed_problem", rules=[]), row("f3", of="t"), row("f4", split="test"), row("f5", quote="四つ"), row("f6", who=" "), row("f8"), row("f8"), row("f9"),
        row("f0", "unresolved", who="", quote=""),
    ]
    lists = "preserve array<string>, forbid array<string>, rule_ids array<string>"
    decisions = spark.createDataFrame(rows, f"finding_id string, findings_sha256 string, status string, split string, problem_type string, confirmer string, reason string, quote string, {lists}")
    findings = spark.createDataFrame([(f"f{i}", "箱が三つ。", "箱は三つ。") for i in range(9)], "finding_id string, original string, result string")
    return validation.decision_problems(decisions, findings, sha, feedback.PROBLEM_TYPES)


@golden(
    PROBLEMS,
    [("b", "not an adopted excerpt"), ("c", "other split"), ("d", "other document id"), ("e", "no audience"), ("s1", "several excerpts of one source")],
)
def golden_excerpt_cases(spark: SparkSession) -> DataFrame:
    texts = {"x1": ("s1", "adopted", "final", "一"), "x2": ("s1", "adopted", "final", "二"), "x3": ("s2", "adopted", "tuning", "三"), "x4": ("s3", "candidate", "final", "四"), "x5": ("s4", "adopted", "final", "五")}
    excerpts = spark.createDataFrame([(k, *v) for k, v in texts.items()], "id string, source_id string, status string, split string, text string").withColumn("text_sha256", F.sha2("text", 256))
    cases = [("a", "x1", "一", "r", "u"), ("b", "x4", "四", "r", "u"), ("c", "x3", "三", "r", "u"), ("d", "s1", "二", "r", "u"), ("e", "x5", "五", "r", None)]
    return validation.excerpt_case_problems(spark.createDataFrame(cases, "id string, document_id string, original string, request string, audience string"), excerpts, "final", "excerpt")


@golden(
    "source_id varchar, variant varchar, human varchar, machine varchar, problem varchar",
    [
        ("a", "v1", "fail", "fail", None),
        ("a", "v2", "pass", "missing", None),
        ("b", "v1", "uncertain", "pass", "other content"),
        ("c", "v1", None, "pass", "no decision"),
        ("d", "v1", "pass", "missing", "no task"),
        ("e", "v1", None, "pass", "unknown candidate"),
    ],
)
def golden_grader_pairs(spark: SparkSession) -> DataFrame:
    content = "request string, context string, audience string, original string, candidate string"
    said = ("r", None, "u", "o")
    assigned = spark.createDataFrame([(*k, *said, "x") for k in (("a", "v1"), ("a", "v2"), ("b", "v1"), ("c", "v1"), ("d", "v1"))], f"source_id string, variant string, {content}")
    tasks = [("1", "a", "v1", *said, "x"), ("2", "a", "v2", *said, "x"), ("3", "b", "v1", *said, "y"), ("4", "c", "v1", *said, "x"), ("5", "e", "v1", *said, "x")]
    decided = [("a", "v1", "confirmed_problem"), ("a", "v2", "no_problem"), ("b", "v1", "unresolved"), ("d", "v1", "no_problem")]
    judged = [("1", "fail"), ("3", "pass"), ("4", "pass"), ("5", "pass")]
    return evaluation.grader_pairs(
        assigned, spark.createDataFrame(decided, "source_id string, variant string, status string"), spark.createDataFrame(tasks, f"id string, source_id string, variant string, {content}"), spark.createDataFrame(judged, "id string, contract string")
    )


OUTCOMES = [("d1", "pass", "fail", "first"), ("d1", "pass", "pass", "second"), ("d1", "pass", "pass", "tie"), ("d2", "fail", "pass", "uncertain"), ("d3", "uncertain", "pass", None), ("d3", "pass", "pass", "uncertain")]


@golden(
    "document_id varchar, completed bigint, determined bigint, votes bigint, fail_rate_difference double, preference_balance double",
    [("d1", 3, 3, 2, 0.333333, 0.5), ("d2", 1, 1, 0, -1.0, None), ("d3", 2, 1, 0, 0.0, None)],
)
def golden_outcomes(spark: SparkSession) -> DataFrame:
    out = evaluation.document_outcomes(spark.createDataFrame(OUTCOMES, "document_id string, first string, second string, selected string"))
    return out.withColumn("fail_rate_difference", F.round("fail_rate_difference", 6))


@golden(
    "metric varchar, documents bigint, mean double, status varchar, estimated boolean",
    [("fail_rate_difference", 3, -0.222222, "estimated", True), ("preference_balance", 1, 0.5, "insufficient", False)],
)
def golden_paired_estimates(spark: SparkSession) -> DataFrame:
    outcomes = evaluation.document_outcomes(spark.createDataFrame(OUTCOMES, "document_id string, first string, second string, selected string"))
    out = evaluation.paired_estimates(outcomes, exact=True)
    return out.withColumns({"mean": F.round("mean", 6), "estimated": F.col("low").isNotNull() & (F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))})


@golden(
    "case_id varchar, aspect varchar, state varchar",
    [("a", "numbers_order", "missing"), ("a", "rhetoric_tone", "not asked"), ("a", "unnecessary_change", "unknown value")],
)
def golden_aspect_gaps(spark: SparkSession) -> DataFrame:
    given = [("negation_polarity", "pass"), ("condition_scope", "fail"), ("ungrounded_specificity", "uncertain"), ("unnecessary_change", "better"), ("rhetoric_tone", "pass")]
    return evaluation.aspect_gaps(spark.createDataFrame([("a", "tech")], "case_id string, profile string"), spark.createDataFrame([("a", *g) for g in given], "case_id string, aspect string, value string"))


@golden("doc_id bigint, number bigint, problem varchar", [(1, 3, "gap before"), (1, 3, "occurs again"), (2, 2, "4 expected"), (1, 3, "4 expected")])
def golden_table_gaps(spark: SparkSession) -> DataFrame:
    rows = [(1, 1), (1, 3), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (3, 4)]
    return markup.table_gaps(spark.createDataFrame(rows, "doc_id long, number long"), expected=4)


@golden(
    "small varchar, big varchar, added boolean, touched boolean",
    [
        ("行う", "行なう", True, True),
        ("行う", "行ナう", False, True),
        ("", "ああ", True, True),
        ("𠮷(.田", "お𠮷(.の田い", True, False),
        ("甲乙", "乙甲", False, False),
    ],
)
def golden_additions(spark: SparkSession) -> DataFrame:
    rows = [("行う", "行なう", "a/b.md", None), ("行う", "行ナう", "x.txt", "a/old.md"), ("", "ああ", "docs/x", ""), ("𠮷(.田", "お𠮷(.の田い", "x.txt", "y.txt"), ("甲乙", "乙甲", "x.txt", None)]
    d = spark.createDataFrame(rows, "small string, big string, path string, before string")
    patterns = F.array(F.lit("a/*.md"), F.lit("docs/[xy]"))
    return d.select("small", "big", T.only_hiragana_added(F.col("small"), F.col("big")).alias("added"), T.touches(F.col("path"), F.col("before"), patterns).alias("touched"))


@golden("state varchar, n bigint", [("changed", 1), ("disabled", 2), ("error", 1), ("unchanged", 1)])
def golden_change_counts(spark: SparkSession) -> DataFrame:
    rows = [("a", "1", "1", None, True), ("b", "1", "2", None, None), ("c", "1", "2", None, False), ("d", None, None, "x", False), ("e", "1", None, "x", True)]
    return structure.change_counts(structure.source_changes(spark.createDataFrame(rows, "source_id string, reviewed string, head string, error string, enabled boolean")))


@golden(
    "pair_id bigint, headings_before int, headings_after int, heading_state varchar, lost varchar, fresh varchar, made_up varchar",
    [(1, 1, 2, "split", "Label", "6.0|7.0", "7.0"), (2, 2, 1, "merged", "", "9.0|30.0", "30.0"), (3, 0, 0, "same", "", "", "")],
)
def golden_structure(spark: SparkSession) -> DataFrame:
    pairs = [("# A\n**Label**: x\n10 and 4", "# A\n## B\n10, 6 and 7"), ("# A\n# B\n3", "# A\n9 と 30%"), (None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs, 1)], "pair_id long, before string, after string")
    names = {"lost": "labels_lost", "fresh": "numbers_new", "made_up": "numbers_made_up"}
    return structure.structure_changes(rows).withColumns({k: F.array_join(F.col(v).cast("array<string>"), "|") for k, v in names.items()})
