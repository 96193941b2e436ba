"""Column expressions on text. All run in the JVM; patterns are Java regular expressions.

Blanks are what Python's str.isspace says: (?U)\\s plus U+001C-U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"
_U = "(?U)"

# Character classes, thresholds and patterns that results depend on.
KANJI = "一-鿿㐀-䶿豈-﫿\\x{20000}-\\x{2FA1F}々"
HIRAGANA = "ぁ-ゖゝ-ゟ"
RUN_KANJI = "一-鿿㐀-䶿々"
NOUN = RUN_KANJI + "ァ-ヶーA-Za-z0-9０-９Ａ-Ｚａ-ｚ"
NEGATIVE = "(?:な(?:い|かっ)|ありません)"
POINTERS = {
    "kanji-run": f"[{RUN_KANJI}]{{7,}}",
    "no-chain": f"(?:[{NOUN}]+の){{3}}[{NOUN}]+",
    "double-negative": (
        f"ない(?:わけ|こと)(?:では|でも|は|も){NEGATIVE}|な(?:く|いで)(?:は|も){NEGATIVE}|ないとは(?:言え|いえ|言い切れ|いいきれ)(?:な(?:い|かっ)|ません)|"
        f"ないと(?:は|も)限(?:らな(?:い|かっ)|りません)|(?:不可能|不要|不必要|無関係|無理)(?:では|でも){NEGATIVE}|否定(?:でき|し(?:え|得))(?:な(?:い|かっ)|ません)|"
        "否め(?:な(?:い|かっ)|ません)|なきにしもあらず"
    ),
    "paren-sentence": r"[（(](?=[^（）()]{60,}[）)])[^（）()]*?[。！？](?=[^（）()]*[^（）()。！？」』\s])[^（）()]*[）)]",
}
URL = r"(?:https?|ftp)://[A-Za-z0-9\-._~:/?#\[\]@!$&'*+,;=%]+"
SENSITIVE = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "url": r"https?://\S+",
    "phone": r"(?<![\d-])0\d{1,4}-\d{1,4}-\d{3,4}(?![\d-])",
    "long_number": r"(?<!\d)\d{10,}(?!\d)",
}


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _U + BLANK, "")


def visible_length(text: Column) -> Column:
    """Code points that aren't blank."""
    return F.length(without_blanks(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"{_U}^{BLANK}+|{BLANK}+$", "")


def lines(text: Column) -> Column:
    """Lines, with CR LF and CR read as LF."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_U + pattern))


def kanji(text: Column) -> Column:
    return count(text, f"[{KANJI}]")


def hiragana(text: Column) -> Column:
    return count(text, f"[{HIRAGANA}]")


def commas(text: Column) -> Column:
    return count(text, "[、，]")


def ends_with_terminator(text: Column) -> Column:
    return text.rlike(r"[。！？．!?][」』）)】〉》］\]]*$")


def preview(text: Column, size: int = 30) -> Column:
    flat = strip(F.regexp_replace(text, f"{_U}{BLANK}+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def snippet(text: Column, start: Column, end: Column, margin: int = 10) -> Column:
    """What is around the 0-based span [start, end)."""
    left, right = F.greatest(F.lit(0), start - margin), F.least(F.length(text), end + margin)
    middle = F.substring(text, left + 1, right - left)
    return F.concat(F.when(left > 0, "…").otherwise(""), middle, F.when(right < F.length(text), "…").otherwise(""))


def clean_inline(line: Column) -> Column:
    """A line without inline Markdown and URLs. The order of steps matters."""
    target = r"\((?:[^()]|\([^()]*\))*\)"
    steps = [
        (rf"!\[[^\]]*\]{target}", ""),
        (rf"\[([^\]]*)\]{target}", "$1"),
        (r"\[([^\]]+)\]\[[^\]]*\]", "$1"),
        (r"<(?:https?|ftp|mailto):[^>\s]+>", ""),
        (URL, ""),
        (r"</?[A-Za-z][^>]*>", ""),
        (r"\*+|__|~~|`", ""),
    ]
    for pattern, instead in steps:
        line = F.regexp_replace(line, _U + pattern, instead)
    return strip(line)


def is_boundary(line: Column) -> Column:
    """Lines that part paragraphs and hold no prose: blank, rule, setext underline, comment, link definition."""
    shapes = [
        rf"^{BLANK}*$",
        r"^\s{0,3}([-*_])(\s*\1){2,}\s*$",
        r"^\s{0,3}(=+|-+)\s*$",
        r"^\s*<!--.*-->\s*$",
        r"^\s{0,3}\[[^\]]+\]:\s*\S+",
    ]
    out = F.lit(False)
    for shape in shapes:
        out |= line.rlike(_U + shape)
    return out


def whitespace_free_id(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the text without blanks."""
    return F.substring(F.sha2(without_blanks(text), 256), 1, 16)


def paragraphs(text: Column) -> Column:
    """Runs of lines with something in them, in one pass over the lines."""
    solid = lambda line: line.rlike(rf"{_U}[^\s\x1c-\x1f]")
    begin = F.struct(F.lit(0).alias("n"), F.lit(False).alias("on"))
    step = lambda seen, line: F.struct((seen["n"] + (solid(line) & ~seen["on"]).cast("int")).alias("n"), solid(line).alias("on"))
    return F.aggregate(lines(text), begin, step, lambda seen: seen["n"])


def newline_sequences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\r\n|\r|\n"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset, lines parted by LF."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def offsets_of(text: Column, needle: Column) -> Column:
    """0-based offsets of all occurrences, overlapping ones too. Texts without the needle cost one scan."""
    n = F.length(needle)
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - n)), lambda i: F.substring(text, i + 1, n) == needle)
    return F.when(F.contains(text, needle) & (n > 0), found).otherwise(F.array().cast("array<int>"))


def sensitive_counts(text: Column) -> dict[str, Column]:
    return {name: count(text, pattern) for name, pattern in SENSITIVE.items()}


def urls(text: Column) -> Column:
    """URLs in order, without closing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,)]+$", ""))


def mode_of(text: Column) -> Column:
    """The one distinct mode letter named in a request; null if none or several."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)モード\s*([ABCD])"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def json_slice(text: Column) -> Column:
    """From the first brace to the last; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def cleaned(text: Column, size: int) -> Column:
    """External text for display: control and direction characters become ?, the rest is cut."""
    return F.substring(F.regexp_replace(text, r"[\p{Cc}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]", "?"), 1, size)


def matches_any_glob(path: Column, patterns: Column) -> Column:
    """Whether the path matches one of the shell patterns (* ? [...]); an empty list matches all."""
    quoted = lambda p: F.regexp_replace(p, r"([.+^$(){}|\\])", r"\\$1")
    regex = lambda p: F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(quoted(p), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$"))
    return (F.size(patterns) == 0) | F.exists(patterns, lambda p: F.regexp_like(path, regex(p)))


def touches(path: Column, before: Column, patterns: Column) -> Column:
    """Whether a file, or the name it had before, matches one of the shell patterns."""
    return matches_any_glob(path, patterns) | F.coalesce((before != "") & matches_any_glob(before, patterns), F.lit(False))


def only_hiragana_added(small: Column, big: Column) -> Column:
    """Whether big is small with nothing but hiragana put in, wherever."""
    literal = lambda ch: F.concat(F.lit(r"\Q"), ch, F.lit(r"\E"))
    parts = F.transform(F.filter(F.split(small, ""), lambda ch: ch != ""), literal)
    return F.regexp_like(big, F.concat(F.lit("^[ぁ-ゖ]*"), F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("[ぁ-ゖ]*"))), ""), F.lit(r"\z")))


def utc_stamp(at: Column) -> Column:
    """A moment as 2026-01-31T00:00:00Z, whatever the session's time zone."""
    since = F.make_dt_interval(secs=F.unix_seconds(at))
    return F.concat(F.replace((F.lit("1970-01-01").cast("timestamp_ntz") + since).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def in_order(text: Column, terms: list[str]) -> Column:
    """Whether the terms' first places increase strictly; false if one is missing."""
    at = [F.locate(t, text) for t in terms]
    out = F.lit(True)
    for one in at:
        out &= one > 0
    for one, two in zip(at, at[1:]):
        out &= one < two
    return out


def lead_has_all(text: Column, terms: list[str], size: int) -> Column:
    """Whether the first `size` code points hold all terms."""
    lead = F.substring(text, 1, size)
    out = F.lit(True)
    for t in terms:
        out &= F.contains(lead, F.lit(t))
    return out


def headings(text: Column) -> Column:
    """Heading texts of a Markdown document, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s{0,3}#{1,6}\s+(.*)$"), F.lit(1))
    return F.transform(found, strip)


def numbering_contiguous(numbers: Column) -> Column:
    """Whether an array of integers is 1, 2, 3, ..."""
    return F.forall(F.transform(numbers, lambda x, i: x == i + 1), lambda x: x)


def derivable(numbers: Column, target: Column) -> Column:
    """Whether a number is in the array or is a sum, difference, product, ratio or percentage of two of its numbers."""
    near = lambda v: F.abs(v - target) < 1e-9
    pair = lambda a, b: near(a + b) | near(a - b) | near(a * b) | F.coalesce(near(F.try_divide(a, b)) | near(F.try_divide(a * 100, b)), F.lit(False))
    return F.exists(numbers, near) | F.exists(numbers, lambda a: F.exists(numbers, lambda b: pair(a, b)))
