"""The engine's queries over the shared tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import notation
from ..functions import text as T
from ..operators import comparison, evaluation, feedback, ledger, preservation, readability, rules, structure
from ..sources import markup, sinks
from . import golden

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(golden.QUERIES)
ORACLES: dict[str, str] = dict(golden.ORACLES)

# Python's white space, for an engine whose \s is ASCII.
_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; null where there are none."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = "labelled as (select d.doc_id, d.lang, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id))"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation and the next: pair_id, before, after."""
    rows = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select((F.col("conv_id") * 10000 + F.col("turn")).alias("pair_id"), F.col("text").alias("before"), after.alias("after")).filter("after is not null")


PAIRS = """pairs as (select * from (select conv_id * 10000 + turn as pair_id, text as before,
  lead(text) over (partition by conv_id order by turn) as after from conversations) where after is not null)"""

# Sentences of texts without block marks or CJK terminators: depth of brackets by running sums, ends at depth 0.
SENTENCES = rf"""
l as (select doc_id, u.i, trim(regexp_replace(replace(trim(list_extract(string_split(text, chr(10)), u.i), ' ' || chr(9) || chr(10)), '`', ''), '\*+|__|~~', '', 'g'), ' ' || chr(9) || chr(10)) as p
      from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)),
b as (select doc_id, string_agg(p, ' ' order by i) as t from l where p <> '' group by 1),
c as (select doc_id, u.i, substr(t, u.i::bigint, 1) as ch, substr(t, (u.i + 1)::bigint, 1) as nx from b, unnest(range(1, length(t) + 1)) as u(i)),
s1 as (select *, sum(case when contains('「『（(【〈《［[', ch) then 1 when contains('」』）)】〉》］]', ch) then -1 else 0 end) over (partition by doc_id order by i) as run from c),
s2 as (select *, run - least(0, min(run) over (partition by doc_id order by i)) as depth from s1),
m as (select doc_id, string_agg(ch || case when ch in ('!', '?') and depth = 0 and (nx = '' or regexp_matches(nx, '{_BLANK}')) then chr(1) else '' end, '' order by i) as t from s2 group by 1),
s3 as (select doc_id, u.k as sent, trim(list_extract(string_split(t, chr(1)), u.k), ' ' || chr(9) || chr(10)) as s from m, unnest(range(1, len(string_split(t, chr(1))) + 1)) as u(k)),
v as (select *, length(regexp_replace(s, '{_BLANK}', '', 'g')) as n from s3 where s <> '')"""

_COUNTERS = f"""with {SENTENCES},
q as (select doc_id, sent, n, (n < 20 and regexp_matches(s, '[。！？．!?][」』）)】〉》］\\]]*$')) as ok from v),
g as (select *, sum(case when ok then 0 else 1 end) over (partition by doc_id order by sent) as island from q),
r as (select doc_id, count(*) as short_runs from (select doc_id, island from g where ok group by 1, 2 having count(*) >= 3) group by 1),
blocks as (select doc_id, length(regexp_replace(t, '{_BLANK}', '', 'g')) as chars, len(regexp_extract_all(t, '[一-鿿㐀-䶿豈-﫿々]')) as kanji, len(regexp_extract_all(t, '[ぁ-ゖゝ-ゟ]')) as hiragana from b),
st as (select doc_id, count(*) as sentences, sum(n) as sentence_chars, count(*) filter (n >= 46) as long_sentences, sum(len(regexp_extract_all(s, '[、，]'))) as commas from v group by 1),
metrics as (select d.doc_id, coalesce(chars, 0)::bigint as chars, coalesce(kanji, 0)::bigint as kanji, coalesce(hiragana, 0)::bigint as hiragana, (chars is not null)::bigint as paragraphs,
  coalesce(chars >= 200, false)::bigint as long_paragraphs, coalesce(sentences, 0)::bigint as sentences, coalesce(sentence_chars, 0)::bigint as sentence_chars,
  coalesce(long_sentences, 0)::bigint as long_sentences, coalesce(short_runs, 0)::bigint as short_runs, coalesce(commas, 0)::bigint as commas
  from documents d left join blocks using (doc_id) left join st using (doc_id) left join r using (doc_id))"""


@query(_COUNTERS + " select * from metrics")
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.document_metrics(table(spark, sf_dir, "documents"))


@query(_COUNTERS + " select count(*) as documents, " + ", ".join(f"sum({c})::bigint as {c}" for c in readability.COUNTERS) + " from metrics")
def corpus_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.corpus_total(readability.document_metrics(table(spark, sf_dir, "documents")))


@query(_COUNTERS + """ select doc_id, sum(case when ok then 1 else 0 end)::bigint as short_sentences, count(distinct case when ok then island end) as islands from g group by 1""")
def short_sentence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readability.sentence_rows(readability.split_blocks(table(spark, sf_dir, "documents")))
    runs = readability.short_run_islands(s, least=1).groupBy("doc_id").agg(F.sum("sentences").alias("n"), F.count(F.lit(1)).alias("k"))
    out = s.select("doc_id").distinct().join(runs, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("short_sentences"), F.coalesce("k", F.lit(0)).alias("islands"))


@query(_COUNTERS + """ select doc_id, (sent - 1)::int as sent, n as length from (select *, row_number() over (partition by doc_id order by sent) as nth from v) where n >= 46
  order by n desc, doc_id, sent limit 20""")
def longest_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readability.sentence_rows(readability.split_blocks(table(spark, sf_dir, "documents")))
    return readability.long_sentences(s).orderBy(F.desc("length"), "doc_id", "sent").limit(20).select("doc_id", "sent", "length")


@query()
def pointer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.pointer_counts(readability.sentence_rows(readability.split_blocks(table(spark, sf_dir, "documents"))))


@query()
def located_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.pointers(table(spark, sf_dir, "documents"))


@query(f"select doc_id, length(regexp_replace(text, '{_BLANK}', '', 'g')) as n from documents")
def visible_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.visible_length(F.col("text")).alias("n"))


@query(
    f"""with x as (select doc_id, length(text) as codepoints, length(regexp_replace(text, '{_BLANK}', '', 'g')) as solid_codepoints,
    len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) as newlines from documents)
    select doc_id, codepoints, codepoints - solid_codepoints as blank_codepoints, solid_codepoints, newlines from x"""
)
def code_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.code_point_counts(table(spark, sf_dir, "documents"))


@query(f"select sha256(regexp_replace(text, '{_BLANK}', '', 'g'))[1:16] as document_id, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.whitespace_free_id(F.col("text")).alias("document_id"))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query(
    rf"""with x as (select doc_id, list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda y: length(regexp_replace(y, '{_BLANK}', '', 'g')) > 0) as s from documents)
    select doc_id, len(list_filter(range(1, len(s) + 1), lambda i: s[i] and (i = 1 or not s[i - 1]))) as paragraphs from x"""
)
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))


@query(
    f"""with {PAIRS}, x as (select pair_id, regexp_replace(before, '{_BLANK}', '', 'g') as a, regexp_replace(after, '{_BLANK}', '', 'g') as b from pairs)
    select pair_id, a = b as identical, length(a) as before_chars, length(b) as after_chars,
      case when a <> b then len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])) + 1 end as position from x"""
)
def preserved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.preserved(turn_pairs(spark, sf_dir)).select("pair_id", "identical", "before_chars", "after_chars", "position")


@query(
    f"""with {PAIRS}, x as (select pair_id, replace(before, chr(10), '') as a, replace(after, chr(10), '') as b,
      length(before) - length(replace(before, chr(10), '')) as m, length(after) - length(replace(after, chr(10), '')) as n from pairs)
    select pair_id, a = b as non_newline_identical, n - m as inserted_newlines from x"""
)
def newline_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.newline_insertions(turn_pairs(spark, sf_dir)).select("pair_id", "non_newline_identical", "inserted_newlines")


@query(
    r"""with x as (select doc_id, regexp_replace(text, '[^(\[{（［｛「『【〈《〔〖]', '', 'g') as a, regexp_replace(text, '[^)\]}）］｝」』】〉》〕〗]', '', 'g') as b from documents)
    select doc_id, length(a) as opened, length(b) as closed from x"""
)
def bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.bracket_balance(table(spark, sf_dir, "documents"))


@query()
def bracket_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.brackets(table(spark, sf_dir, "documents"))


@query(
    """with h as (select d.doc_id, b.item_id, d.text, b.text as needle from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''),
    p as (select doc_id, item_id, text, u.i from h, unnest(range(0, length(text) - length(needle) + 1)) as u(i) where substr(text, u.i + 1, length(needle)) = needle)
    select doc_id, item_id, i as offset, length(text[1:i]) - length(replace(text[1:i], chr(10), '')) + 1 as line from p"""
)
def literal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return preservation.forbidden_literals(table(spark, sf_dir, "documents"), items).select("doc_id", "item_id", "offset", "line")


@query("select doc_id, t.x as text from documents, (values ('the'), ('der'), ('que')) t(x) where not contains(coalesce(documents.text, ''), t.x)")
def required_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.missing_literals(table(spark, sf_dir, "documents"), ["the", "der", "que"])


@query(
    """with a as (select doc_id::varchar as path, sha256(text) as a from documents where lang <> 'fr'), b as (select doc_id::varchar as path, sha256(lower(text)) as b from documents where lang <> 'es')
    select path, case when b is null then 'missing' when a is null then 'extra' else 'changed' end as state from a full join b using (path) where a is distinct from b"""
)
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    side = lambda lang, t: d.filter(F.col("lang") != lang).select(F.col("doc_id").cast("string").alias("path"), F.sha2(t, 256).alias("sha256"))
    return preservation.tree_diff(side("fr", F.col("text")), side("es", F.lower("text")))


@query(
    r"""select doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}.+-]+@[\p{L}\p{M}\p{N}\p{Pc}-]+(?:\.[\p{L}\p{M}\p{N}\p{Pc}-]+)+')) as email,
    len(regexp_extract_all(text, 'https?://\S+')) as url,
    len(list_filter(regexp_extract_all(text, '[\p{Nd}-]+'), lambda x: regexp_full_match(x, '0\p{Nd}{1,4}-\p{Nd}{1,4}-\p{Nd}{3,4}'))) as phone,
    len(regexp_extract_all(text, '\p{Nd}{10,}')) as long_number from documents"""
)
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.sensitive_scan(table(spark, sf_dir, "documents"))


@query()
def shingle_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.overlapping(table(spark, sf_dir, "documents"))


@query()
def crowded_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.crowded_shingles(table(spark, sf_dir, "documents"))


_TERMS = f"""with {PAIRS}, sides as (select pair_id, 'before' as side, before as t from pairs union all select pair_id, 'after', after from pairs),
terms as (select distinct pair_id, side, unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_.+#/-]*[A-Za-z0-9+#]|[A-Za-z]{{2,}}')) as key from sides),
lone as (select pair_id, key, min(side) as side from terms group by 1, 2 having count(*) = 1)"""


@query(_TERMS + " select pair_id, count(*) filter (side = 'before') as missing, count(*) filter (side = 'after') as added from lone group by 1")
def term_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = comparison.parsed(turn_pairs(spark, sf_dir), markdown=False, want=("items",))
    changes = comparison.presence(comparison.item_rows(parts).filter("kind = 'term'"))
    return changes.groupBy("pair_id").agg(F.count_if(F.col("change") == "missing").alias("missing"), F.count_if(F.col("change") == "added").alias("added"))


@query(_TERMS + " select pair_id, list_sort(list(distinct case when side = 'before' then 'removed' else 'added' end)).list_aggregate('string_agg', ',') as directions from lone group by 1")
def term_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = comparison.parsed(turn_pairs(spark, sf_dir), markdown=False, want=("items",))
    out = comparison.change_directions(comparison.presence(comparison.item_rows(parts).filter("kind = 'term'")))
    return out.select("pair_id", F.array_join("directions", ",").alias("directions"))


#: Pairs with numbers, which the conversations have none of.
_NUMBERED = [(-1, "30 ms and 30 ms, then 5%", "30 ms, then 7%"), (-2, "1.5 GB in 3 parts", "3 parts of 1.5 GB"), (-3, "12", "12 12")]


@query(
    rf"""with {PAIRS}, more as (select * from pairs union all values {", ".join(map(str, _NUMBERED))}),
    sides as (select pair_id, 1 as side, before as t from more union all select pair_id, -1, after from more),
    rows as (select pair_id, side, unnest(string_split(t, chr(10))) as line from sides),
    keys as (select pair_id, side, replace(unnest(regexp_extract_all(line, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*[万億兆]?(?:\s?(?:%|[A-Za-z]+))?')), ' ', '') as key from rows),
    net as (select pair_id, key, sum(side) as n from keys group by 1, 2 having sum(side) <> 0)
    select pair_id, key, case when n > 0 then 'missing' else 'added' end as change, abs(n)::bigint as n from net"""
)
def number_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).unionByName(spark.createDataFrame(_NUMBERED, "pair_id long, before string, after string"))
    parts = comparison.parsed(pairs, markdown=False, want=("items",))
    rows = comparison.surplus(comparison.item_rows(parts).filter("kind = 'number'"))
    return rows.groupBy("pair_id", "key", "change").agg(F.count(F.lit(1)).alias("n"))


@query()
def item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.item_changes(comparison.parsed(turn_pairs(spark, sf_dir), want=("items",)))


@query()
def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = comparison.aligned(turn_pairs(spark, sf_dir))
    return out.select("pair_id", "side", "pos", "n_units", "hits", "start", "end", "judgeable")


@query()
def unmatched_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.unmatched(comparison.aligned(turn_pairs(spark, sf_dir)))


@query()
def marker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.marker_changes(comparison.aligned(turn_pairs(spark, sf_dir)))


@query()
def style_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.style_shift(comparison.parsed(turn_pairs(spark, sf_dir), want=("sentences",)))


@query(
    f"""with {PAIRS}, x as (select pair_id, length(before) as a, length(after) as b from pairs)
    select pair_id, case when b > a then 'up' when b < a then 'down' else 'same' end as size from x"""
)
def metric_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = turn_pairs(spark, sf_dir).select("pair_id", F.length("before").alias("before_size"), F.length("after").alias("after_size"))
    return comparison.metric_directions(sized, ["size"])


@query()
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.rows_of(table(spark, sf_dir, "pages"), "html", markup.html_rows, "page_id")


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.rows_of(table(spark, sf_dir, "documents"), "text", markup.markdown_rows)


@query()
def notation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_documents(table(spark, sf_dir, "documents"))


_MATRIX = [
    ("サーバを再起動する。", "GAIRAI-001", "ARR"),
    ("処理を行なう。", "OKURI-001", "ARR"),
    ("申し込みを受け付ける。", "OKURI-003", "AAE"),
    ("すべての設定を確認する。", "KANJI-005", "AAR"),
    ("AおよびBを指定する。", "KANJI-004", "AAR"),
    ("速い。且つ、安定する。", "KANJI-003", "ARR"),
    ("3ヶ所を直す。", "NUM-001", "ARR"),
    ("時間を計る。", "IJIDOKUN-001", "ANN"),
    ("こんにちわ、田中です。", "KANA-001", "EEE"),
    ("資料がございます。", "EXPR-003", "ARA"),
    ("いなづまが光る。", "KANA-004", "AAA"),
    ("予め確認する。", "KANJI-002", "ARR"),
    ("検討するべきだ。", "EXPR-001", "ARR"),
]
_LETTER = {"A": "accepted_variant", "R": "recommendation", "N": "needs_context", "E": "error"}


@query(
    "select * from (values "
    + ", ".join(f"({i}::bigint, '{rule}', '{profile}', '{_LETTER[c]}')" for i, (_, rule, cats) in enumerate(_MATRIX) for profile, c in zip(notation.PROFILES, cats))
    + ") t(doc_id, rule_id, profile, category)"
)
def notation_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with one known variant each, under every profile."""
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(_MATRIX)], "doc_id long, text string")
    parts = [rules.check_documents(docs, profile=p).select("doc_id", "rule_id", F.lit(p).alias("profile"), "category") for p in notation.PROFILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""with {LABELLED} select count(*) filter (h and m) as both, count(*) filter (not h and m) as machine_only, count(*) filter (h and not m) as human_only, count(*) filter (not h and not m) as neither,
    count(*) filter (h and m) / nullif(count(*) filter (m), 0) as precision, count(*) filter (h and m) / nullif(count(*) filter (h), 0) as recall,
    count(*) filter (h = m) / nullif(count(*), 0) as agreement from (select quality = 0 as h, toxic = 1 as m from labelled where quality is not null and toxic is not null)"""
)
def grader_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select((F.col("quality") == 0).alias("h"), (F.col("toxic") == 1).alias("m"))
    return evaluation.confusion(rows, "h", "m")


@query(f"with {LABELLED} select lang, quality::varchar as quality, toxic::varchar as toxic, count(*) as n from labelled group by all")
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return evaluation.crosstab(rows, ["lang", "quality", "toxic"])


@query(
    f"""with {LABELLED} select source, count(*) filter (toxic = 1) as signalled, count(toxic) as available, count(*) - count(toxic) as unavailable,
    count(*) filter (toxic = 1) / nullif(count(toxic), 0) as rate from labelled group by 1"""
)
def signal_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tally(labelled(spark, sf_dir).withColumn("s", F.col("toxic") == 1), "s", ["source"])


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("quality").isNull(), "uncertain").when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("fail")
    return labelled(spark, sf_dir).withColumn("contract", c)


CONTRACTS = LABELLED + ", c as (select *, case when quality is null then 'uncertain' when quality = 1 and toxic = 0 then 'pass' else 'fail' end as contract from labelled)"


@query(
    f"""with {CONTRACTS} select source as variant, count(*) as n, count(*) filter (contract = 'fail') as fail, count(*) filter (contract = 'pass') as pass,
    count(*) filter (contract = 'fail') / nullif(count(*) filter (contract <> 'uncertain'), 0) as fail_rate_decided, count(*) filter (contract = 'fail') / count(*) as fail_rate_all from c group by 1"""
)
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.variant_summary(contracts(spark, sf_dir).withColumnRenamed("source", "variant"))


@query(
    f"""with {CONTRACTS}, k as (select distinct lang, m from documents, (values ('A'), ('B')) t(m))
    select k.lang, k.m, count(c.doc_id) as n, count(*) filter (contract = 'pass') as pass, count(*) filter (contract = 'fail') as fail, count(*) filter (contract = 'uncertain') as uncertain
    from k left join c on c.lang = k.lang and k.m = 'A' group by 1, 2"""
)
def grouped_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select("lang").distinct().withColumn("m", F.explode(F.array(F.lit("A"), F.lit("B"))))
    rows = contracts(spark, sf_dir).select("lang", F.lit("A").alias("m"), F.col("contract").alias("status"))
    return evaluation.grouped_status(rows, keys, ["lang", "m"])


@query(
    f"""with {LABELLED}, i as (select lang as variant, source as document_id, case when toxic = 1 and quality = 0 then 'critical' when toxic = 1 then 'major' else 'minor' end as severity from labelled where quality is not null)
    select variant, """
    + ", ".join(f"count(*) filter (severity = '{s}') as {s}_issues, count(distinct document_id) filter (severity = '{s}') as {s}_documents" for s in ("minor", "major", "critical"))
    + ", count(distinct document_id) filter (severity in ('major', 'critical')) as major_or_critical_documents from i group by 1"
)
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "critical").when(F.col("toxic") == 1, "major").otherwise("minor")
    rows = labelled(spark, sf_dir).filter("quality is not null").select(F.col("lang").alias("variant"), F.col("source").alias("document_id"), sev.alias("severity"))
    return evaluation.severity_summary(rows)


@query(
    f"""with {LABELLED}, s as (select lang, quality + 2 * toxic as score from labelled), e as (select lang, score, count(*) as n from s where score is not null group by 1, 2),
    b as (select lang, string_agg(score || ':' || n, ' ' order by score) as distribution from e group by 1)
    select s.lang, count(*) as n, count(score) as scored, round(avg(score), 6) as mean, any_value(distribution) as distribution from s left join b using (lang) group by 1"""
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", (F.col("quality") + 2 * F.col("toxic")).alias("score"))
    out = evaluation.score_distribution(rows, ["lang"])
    shown = F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")
    return out.select("lang", "n", "scored", F.round("mean", 6).alias("mean"), shown.alias("distribution"))


@query(
    f"""with {CONTRACTS}, k as (select c.*, sha256(regexp_replace(d.text, '{_BLANK}', '', 'g'))[1:16] as key from c join documents d using (doc_id))
    select key, string_agg(distinct contract, ',' order by contract) as verdicts, count(*) as reviews from k group by 1 having count(distinct contract) > 1"""
)
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select("doc_id", T.whitespace_free_id(F.col("text")).alias("key"))
    out = evaluation.disagreements(contracts(spark, sf_dir).join(keys, "doc_id"), ["key"])
    return out.select("key", F.array_join("verdicts", ",").alias("verdicts"), "reviews")


@query(
    f"""with {LABELLED} select count(*) as expected, count(quality) as completed, count(*) - count(quality) as missing, count(*) filter (quality = 1 and toxic = 0) as both_pass,
    count(*) filter (quality = 1 and toxic = 0) as prefer_a, count(*) filter (quality = 0 and toxic = 1) as prefer_b, count(*) filter (quality = toxic) as prefer_tie from labelled"""
)
def vote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumnRenamed("doc_id", "pair_id").withColumn("reviewer", F.lit("r"))
    choice = F.when(F.col("quality") == F.col("toxic"), "tie").when(F.col("quality") == 1, "a").otherwise("b")
    votes = rows.filter("quality is not null").select("pair_id", "reviewer", choice.alias("preference"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("both_pass"))
    return evaluation.vote_summary(votes, rows.select("pair_id", "reviewer"))


@query(
    """with m as (select l_returnflag, l_suppkey, avg(l_quantity) as m from lineitem group by 1, 2)
    select l_returnflag, count(*) as documents, round(avg(m), 6) as mean from m group by 1"""
)
def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("document_id"), F.col("l_quantity").alias("value"))
    return evaluation.document_means(rows, ["l_returnflag"]).withColumn("mean", F.round("mean", 6))


@query(
    """select l_returnflag, count(*) as runs, min(l_quantity) as l_quantity_min, median(l_quantity) as l_quantity_median, max(l_quantity) as l_quantity_max,
    min(l_extendedprice) as l_extendedprice_min, round(median(l_extendedprice), 6) as l_extendedprice_median, max(l_extendedprice) as l_extendedprice_max from lineitem group by 1"""
)
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return out.withColumn("l_extendedprice_median", F.round("l_extendedprice_median", 6))


@query("select l_linestatus, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) as p{p}" for p in (5, 25, 95)) + " from lineitem group by 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.percentiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.05, 0.25, 0.95])
    return out.select("l_linestatus", *[F.round(c, 4).alias(c) for c in ("p5", "p25", "p95")])


def _source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).filter("quality is not null").groupBy("source").agg(F.avg("quality").alias("value"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(_source_quality(spark, sf_dir), key="source")


@query()
def bootstrap_exact_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_exact(_source_quality(spark, sf_dir).orderBy("source"))


@query(
    f"""with {LABELLED}, e as (select source, quality + 2 * toxic as value, count(*) as n from labelled where quality is not null group by 1, 2)
    select source, sum(n)::bigint as repeats, count(*) as distinct_values, max(n) * 2 > sum(n) as has_majority, max(value) - min(value) as value_range, (sum(n) - max(n))::bigint as flips from e group by 1"""
)
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stability(labelled(spark, sf_dir).select("source", (F.col("quality") + 2 * F.col("toxic")).alias("value")), ["source"])


@query(
    f"""with {LABELLED}, s as (select lang, source, case when quality is null then 4 when quality = 0 then 3 when toxic = 1 then 2 else 1 end as k from labelled)
    select lang, source, case max(k) when 4 then 'missing' when 3 then 'fail' when 2 then 'uncertain' else 'pass' end as status from s group by 1, 2"""
)
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 0, "fail").when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "pass")
    return evaluation.worst_status(labelled(spark, sf_dir).withColumn("status", status), ["lang", "source"])


@query(
    f"""with {LABELLED}, p as (select lang as problem_type, case when quality is null then 'u' when quality = 0 and toxic = 0 then 'fixed' when quality = 1 and toxic = 1 then 'regressed' when quality = 0 then 'still_fail' else 'still_pass' end as t from labelled)
    select problem_type, count(*) filter (t = 'fixed') as fixed, count(*) filter (t = 'regressed') as regressed, count(*) filter (t = 'still_fail') as still_fail, count(*) filter (t = 'still_pass') as still_pass,
    count(*) filter (t = 'u') as uncertain_or_missing, count(*) filter (t in ('regressed', 'u')) > 0 as hold from p group by 1"""
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumnRenamed("doc_id", "case_id")
    known = rows.filter("quality is not null")
    before = known.select("case_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"))
    after = known.select("case_id", F.when(F.col("toxic") == 0, "pass").otherwise("fail").alias("status"))
    return evaluation.transitions(before, after, rows.select("case_id", F.col("lang").alias("problem_type")))


@query("select doc_id, case when quality = 1 and toxic = 0 then 'pass' when quality = 0 and toxic = 1 then 'fail' else 'uncertain' end as verdict from labels")
def two_order_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(F.when(F.col("quality") == 1, "pass").otherwise("fail"), F.when(F.col("toxic") == 0, "pass").otherwise("fail"))
    return evaluation.two_order_verdict(table(spark, sf_dir, "labels").select("doc_id", F.explode(both).alias("verdict")), ["doc_id"])


@query(
    f"""with {LABELLED}, s as (select source as name, avg(quality) >= 0.7 as passed from labelled where quality is not null group by 1)
    select bool_and(passed) as adopt, coalesce(string_agg(name, ',' order by name) filter (not passed), '') as against from s"""
)
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _source_quality(spark, sf_dir).select(F.col("source").alias("name"), (F.col("value") >= 0.7).alias("passed"))
    return evaluation.adoption(checks).select("adopt", F.array_join("against", ",").alias("against"))


@query(
    f"""with {LABELLED}, r as (select unnest([1, 2]) as reader), a as (select lang as variant, source as document_id, quality as correct, case when reader = 1 then quality when toxic = 0 then 1 end as choice from labelled, r where quality is not null)
    select document_id, variant, count(*) as asked, count(choice) as answered, count(*) - count(choice) as missing, count(*) filter (choice = correct) as correct,
    count(*) filter (choice = correct) / nullif(count(choice), 0) as score from a group by grouping sets ((variant), (document_id, variant), ())"""
)
def quiz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).filter("quality is not null")
    q = rows.select(F.col("source").alias("document_id"), F.col("doc_id").alias("question_id"), F.col("lang").alias("variant"), F.col("quality").alias("correct"))
    readers = rows.select(F.col("source").alias("document_id")).distinct().withColumn("reader", F.explode(F.array(F.lit(1), F.lit(2))))
    one, two = rows.select(F.lit(1).alias("reader"), F.col("doc_id").alias("question_id"), F.col("quality").alias("choice")), rows.filter("toxic = 0").select(F.lit(2).alias("reader"), F.col("doc_id").alias("question_id"), F.lit(1).alias("choice"))
    return evaluation.quiz_scores(q, readers, one.unionByName(two)).drop("level")


@query(
    """with e as (select event_type, cast(ts as date) as day, user_id, user_id % 7 as team from events)
    select event_type, day, count(*) as findings, count(distinct user_id) as documents, count(distinct team) as submitters, count(distinct user_id) >= 3 and count(distinct team) >= 2 as qualifies from e group by 1, 2"""
)
def failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", (F.col("user_id") % 7).alias("team"))
    return feedback.clusters(rows, ["event_type", "day"], "user_id", "team")


@query(
    """with x as (select sha256(text) as value, case when doc_id % 2 = 0 then 'tuning' else 'final' end as split from documents)
    select 'text' as by, value, string_agg(distinct split, ',' order by split) as splits from x group by 2 having count(distinct split) > 1"""
)
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 2 == 0, "tuning").otherwise("final")
    rows = table(spark, sf_dir, "documents").select(split.alias("split"), F.lit(None).cast("string").alias("lineage_id"), F.sha2("text", 256).alias("text_sha256"))
    return ledger.split_leaks(rows).select("by", "value", F.array_join("splits", ",").alias("splits"))


@query("select conv_id as excerpt_id, turn as step from (select *, lag(role) over (partition by conv_id order by turn) as b from conversations) where b is not null and b <> role")
def broken_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("role", 256)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("excerpt_id"), F.col("turn").alias("step"), digest.alias("input_sha256"), digest.alias("output_sha256"))
    return ledger.broken_chains(rows)


@query(
    """select source as source_id, lang as role, case when doc_id % 2 = 0 then 'tuning' else 'final' end as split, 'g' as "group", count(*) as n, count(*) filter (quality = 1) as adopted
    from documents left join labels using (doc_id) group by 1, 2, 3"""
)
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    split = F.when(F.col("doc_id") % 2 == 0, "tuning").otherwise("final")
    status = F.when(F.col("quality") == 1, "adopted").otherwise("candidate")
    return ledger.ledger_counts(rows.select(F.lit("g").alias("group"), split.alias("split"), F.col("source").alias("source_id"), F.col("lang").alias("role"), status.alias("status")))


@query(
    """with u as (select conv_id as run_id, turn as pos, turn // 2 as tool_id, role as name from conversations where turn % 2 = 0), r as (select conv_id as run_id, turn // 2 as tool_id, length(text) as output_chars from conversations where turn % 2 = 1)
    select run_id, tool_id, pos, name, output_chars::varchar as output_chars from u left join r using (run_id, tool_id)"""
)
def tool_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "tool_use").otherwise("tool_result")
    rows = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), kind.alias("type"), F.floor(F.col("turn") / 2).alias("tool_id"), F.col("role").alias("name"), F.length("text").alias("size"))
    return feedback.tool_evidence(rows).select("run_id", "tool_id", "pos", "name", F.col("output_chars").cast("string").alias("output_chars"))


@query("select event_type as label, count(*) as runs, count(*) filter (value = 0) as error_free, count(*) filter (user_id % 2 = 0) as protected_kept, round(avg(value), 4) as mean_left, round(median(value), 4) as median_left from events group by 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("value").alias("errors_left"), (F.col("user_id") % 2 == 0).alias("kept_protected"))
    return evaluation.run_summary(rows).withColumns({c: F.round(c, 4) for c in ("mean_left", "median_left")})


@query(
    """with w as (select doc_id from documents where lang <> 'es'), g as (select doc_id, count(*) as n from (select doc_id from labels union all select doc_id from labels where toxic = 1) group by 1)
    select doc_id, case when n is null then 'missing' when w.doc_id is null then 'unknown' else 'repeated' end as state from w full join g using (doc_id) where n is null or w.doc_id is null or n > 1"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").filter("lang <> 'es'").select("doc_id")
    got = table(spark, sf_dir, "labels")
    return evaluation.coverage_gaps(wanted, got.select("doc_id").unionByName(got.filter("toxic = 1").select("doc_id")), "doc_id")


@query()
def balanced_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), T.whitespace_free_id(F.col("text")).alias("document_id"))
    return evaluation.balanced_assignment(rows)


@query("select count(*) as documents, count(*) // 2 as swapped, 1::bigint as orientations from documents")
def assignment_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are swapped, and all pairs of a document alike."""
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pair_id"))
    per = evaluation.balanced_assignment(pairs).groupBy("document_id").agg(F.count_distinct("swapped").alias("k"), F.first("swapped").alias("swapped"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.count_if("swapped").alias("swapped"), F.max("k").alias("orientations"))


@query(
    """with m as (select lang, count(*) as n, sum(length(text))::bigint as chars from documents group by 1)
    select lang as label, n, chars from m union all select 'TOTAL', sum(n)::bigint, sum(chars)::bigint from m"""
)
def report_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return sinks.with_total(rows, "label", ["n", "chars"])


@query("select '| ' || region.r_regionkey || ' | ' || region.r_name || ' |' as value from region")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query(r"select doc_id || chr(9) || replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') as value from documents")
def tsv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.tsv_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""with {LABELLED}, c as (select source as case_id, doc_id % 2 = 0 as out, quality = 1 as supported from labelled where quality is not null)
    select case_id, count(*) filter (out and supported) / nullif(count(*) filter (out), 0) as precision, count(*) filter (not out and supported) / nullif(count(*) filter (not out), 0) as recall from c group by 1"""
)
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("doc_id") % 2 == 0, "output").otherwise("reference")
    rows = labelled(spark, sf_dir).filter("quality is not null").select(F.col("source").alias("case_id"), side.alias("side"), (F.col("quality") == 1).alias("supported"))
    return evaluation.claim_scores(rows)


@query("select count(*) as runs, sum(user_id)::bigint as calls, count(distinct event_type) = 1 as same_config, count(distinct event_id) = count(event_id) as ids_unique, round(sum(value), 2) as cost from events")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return evaluation.merge_runs(e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("config"), F.col("user_id").alias("calls"), F.col("value").alias("cost"))).withColumn("cost", F.round("cost", 2))


@query(
    """with m as (select user_id as run_id, event_type as message_id, max_by(event_id, event_id) as i, max_by(user_id, event_id) as o from events group by 1, 2)
    select run_id, count(*) as turns, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens from m group by 1"""
)
def message_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return feedback.message_usage(e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("message_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens")))


@query("select event_type as run_id, max(event_id) as pos, max_by(user_id, event_id) as size from events group by 1")
def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("pos"), F.lit("result").alias("type"), F.col("user_id").alias("size"))
    return feedback.last_result(e)


@query(
    r"""with x as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
    select doc_id, case when length(t) > 30 then t[1:30] || '…' else t end as preview from x"""
)
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("select distinct d.doc_id, b.item_id is not null as holds from documents d left join benchmark b on contains(d.text, b.text)")
def benchmark_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hits = preservation.forbidden_literals(d, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("doc_id").distinct()
    return d.select("doc_id").join(hits.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("holds"))


@query(
    f"""with {PAIRS}, n as (select pair_id, list_distinct(list_transform(regexp_extract_all(before, '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::double)) as b,
      list_distinct(list_transform(regexp_extract_all(after, '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::double)) as a from pairs)
    select pair_id, 0 as headings_before, 0 as headings_after, 'same' as heading_state, len(list_filter(a, lambda x: not list_contains(b, x)))::int as new from n"""
)
def structure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.structure_changes(turn_pairs(spark, sf_dir))
    return out.select("pair_id", "headings_before", "headings_after", "heading_state", F.size("numbers_new").alias("new"))


@query(
    """select doc_id as source_id, case when quality is null then 'gone' when toxic = 1 then 'changed' else 'unchanged' end as state from documents left join labels using (doc_id)"""
)
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    head = F.when(F.col("quality").isNotNull(), F.coalesce("toxic", F.lit(0)).cast("string"))
    return structure.source_changes(rows.select(F.col("doc_id").alias("source_id"), F.lit("0").alias("reviewed"), head.alias("head"), F.lit(None).cast("string").alias("error")))


@query("select lang, case when doc_id % 3 = 0 then 'never' else 'must' end as kind, (doc_id % 3 = 0) <> regexp_matches(text, '[0-9]{5}') as holds, count(*) as n from documents group by all")
def pattern_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "never").otherwise("must")
    checks = d.select(F.col("doc_id").alias("case_id"), "lang", kind.alias("kind"), F.lit("[0-9]{5}").alias("pattern"))
    held = structure.pattern_checks(d.select(F.col("doc_id").alias("case_id"), "text"), checks).join(checks.select("case_id", "lang"), "case_id")
    return held.groupBy("lang", "kind", "holds").agg(F.count(F.lit(1)).alias("n"))
