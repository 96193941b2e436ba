"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered canonically.

States are a role and whether a line begins a turn or goes on with it. A line is seen as its speaker marker (of a user,
an assistant, a system, of an unknown name that comes again, of one that comes once, or none) and whether it asks a question. Turn-taking is in the transitions:
system first, then user and assistant in alternation. Viterbi decoding so reads unknown names by their place, finds
turns that lack a marker where the order asks for one and keeps "Note:" inside the turn it stands in. Parameters are given,
not learnt.

`parse_transcripts` reads raw transcripts, one text each. `recover` reads a conversation that is spread over rows: rows are put
in order by range partitioning and cut into stretches, so that no task gathers a conversation of any length. One that lies
in several stretches is decoded exactly all the same: the best scores from every state before a partition's part of it to every state
after it are a matrix; matrices of a conversation's parts, one per partition at most, are chained to find the states at the borders; each part is then
decoded between its borders. Names are counted over the whole conversation.

Defined cases: a null text is an empty turn; a null role gives a line without a marker; a row with a null conv_id or turn
is a transcript of its own; equal (conv_id, turn) are ordered by role and a hash of the text; repeated rows are turns each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ROLES = ("system", "user", "assistant")
SPEAKERS = {
    "system": "system|sys|developer|context",
    "user": "user|human|you|me|q|question|instruction|input|prompt|customer|client",
    "assistant": "assistant|ai|bot|chatbot|a|answer|response|output|model|gpt|chatgpt|agent",
}
ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names.split("|")}
_NAME = r"(?P<name>[A-Za-z][A-Za-z0-9_]{0,20})"
#: Ways to write a marker. Known speakers may stand in any; an unknown name only before a colon.
MARKERS = [
    re.compile(rf"<\|(?:im_start\|>)?{_NAME}(?:\|>)? ?"),
    re.compile(rf"\[{_NAME}\]:? ?"),
    re.compile(rf"\*\*{_NAME}(?::\*\*|\*\*:) ?"),
    re.compile(rf"#{{2,4}} {_NAME}: ?"),
    re.compile(rf"{_NAME} ?: ?"),
]
#: How transcripts are written, for rows that have a role: marker by role, and what follows it.
STYLES = [
    ("{}: ", ("System", "User", "Assistant")),
    ("### {}:\n", ("System", "Instruction", "Response")),
    ("[{}] ", ("SYSTEM", "USER", "ASSISTANT")),
    ("**{}:** ", ("System", "Human", "AI")),
    ("<|{}|>\n", ROLES),
    ("{}: ", ("Context", "Q", "A")),
]


def marker(line: str) -> tuple[str, int]:
    """Kind of the line's marker (a role, `other` or `none`) and its length."""
    for n, pattern in enumerate(MARKERS):
        if m := pattern.match(line):
            role = ROLE_OF.get(m["name"].lower())
            if role:
                return role, m.end()
            if n == len(MARKERS) - 1 and m["name"][0].isupper():
                return "other", m.end()
    return "none", 0


class TurnModel:
    """Log probabilities. States: begin of system, user, assistant, then inside of them."""

    KINDS = ("system", "user", "assistant", "other", "once", "none")

    def __init__(self) -> None:
        begin = np.full((3, 6), 0.002)
        for k in range(3):
            begin[k, k], begin[k, 3], begin[k, 4], begin[k, 5] = 0.83, 0.10, 0.02, 0.046
        inside = np.tile([0.0005, 0.001, 0.001, 0.01, 0.05, 0.9375], (3, 1))
        self.emit = np.log(np.concatenate([begin, inside]))
        asks = np.array([0.02, 0.30, 0.08])  # a line that ends in a question mark
        self.question = np.log(np.stack([1 - np.tile(asks, 2), np.tile(asks, 2)], axis=1))
        turn = np.array([[0.02, 0.93, 0.05], [0.01, 0.04, 0.95], [0.01, 0.94, 0.05]])  # who comes next
        stay = 0.6
        step = np.full((6, 6), 1e-12)
        for k in range(3):
            for at in (k, k + 3):
                step[at, k + 3] = stay
                step[at, :3] = (1 - stay) * turn[k]
        self.step = np.log(step)
        self.start = np.log(np.array([0.3, 0.6, 0.1, 1e-12, 1e-12, 1e-12]))

    def seen(self, kinds: list[int], asks: list[bool]) -> np.ndarray:
        """Log probabilities of what is seen, (states, lines)."""
        return self.emit[:, kinds] + self.question[:, np.array(asks, int)]

    def decode(self, kinds: list[int], asks: list[bool], entry: np.ndarray | None = None, last: int | None = None) -> list[int]:
        """The likeliest states, by Viterbi. entry: scores of the states of the line before (none: a conversation begins); last: the state to end in."""
        if not kinds:
            return []
        seen, back = self.seen(kinds, asks), []
        score = self.start + seen[:, 0] if entry is None else (entry[:, None] + self.step).max(axis=0) + seen[:, 0]
        for t in range(1, len(kinds)):
            paths = score[:, None] + self.step
            best = paths.argmax(axis=0)
            back.append(best)
            score = paths[best, range(6)] + seen[:, t]
        states = [int(score.argmax()) if last is None else last]
        for best in reversed(back):
            states.append(int(best[states[-1]]))
        return states[::-1]

    def across(self, kinds: list[int], asks: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Best scores over these lines: from each state of the line before to each state of the last, and from a conversation's begin."""
        seen = self.seen(kinds, asks)
        score = np.concatenate([self.step + seen[:, 0], (self.start + seen[:, 0])[None]])
        for t in range(1, len(kinds)):
            score = (score[:, :, None] + self.step[None]).max(axis=1) + seen[:, t]
        return score[:6], score[6]


class Lines:
    """The lines of a transcript and what is seen of them."""

    def __init__(self, transcript: str):
        self.lines = transcript.split("\n")
        found = [marker(x) for x in self.lines]
        self.length = [n for _, n in found]
        self.kind = [k for k, _ in found]
        self.asks = [x.rstrip().endswith("?") for x in self.lines]

    def names(self) -> Counter:
        """Unknown names, as written."""
        return Counter(x[:n] for x, n, k in zip(self.lines, self.length, self.kind) if k == "other")

    def kinds(self, once: Container[str]) -> list[int]:
        """Numbers of kinds; names in `once` come once in the whole conversation."""
        return [TurnModel.KINDS.index("once" if k == "other" and x[:n] in once else k) for x, n, k in zip(self.lines, self.length, self.kind)]

    def turns(self, states: list[int], first: bool = True) -> list[tuple[bool, str, str]]:
        """(whether it goes on with a turn from before, role, text); `first`: a conversation begins here."""
        out: list[tuple[bool, str, list[str]]] = []
        for line, length, state in zip(self.lines, self.length, states):
            if state < 3 or not out:
                goes_on = state >= 3 and not first
                rest = line if goes_on else line[length:]
                # a marker alone on its line: the text begins on the next
                out.append((goes_on, ROLES[state % 3], [rest] if rest or goes_on or not length else []))
            else:
                out[-1][2].append(line)
        return [(on, role, "\n".join(text)) for on, role, text in out]


def parse(transcript: str, model: TurnModel) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    lines = Lines(transcript)
    once = {name for name, n in lines.names().items() if n == 1}
    return [(role, text) for _, role, text in lines.turns(model.decode(lines.kinds(once), lines.asks))]


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text}<|end|>\n"


def write_transcript(turns: list[tuple[str | None, str | None]], style: int) -> str:
    """Turns as people paste them. A null role leaves the marker out; an unknown one stands as a name."""
    form, names = STYLES[style % len(STYLES)]
    known = dict(zip(ROLES, names))
    return "\n".join((form.format(known.get(r, r.capitalize())) if r else "") + (t or "") for r, t in turns)


def parse_transcripts(transcripts: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """Raw transcripts -> id, turn (from 0), role, text, rendered. A null text has no turns; a null id is carried; repeated rows are read each."""
    model = TurnModel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                turns = parse(text, model) if text is not None else []
                cols = [[key] * len(turns), range(len(turns)), [r for r, _ in turns], [t for _, t in turns], [render(r, t) for r, t in turns]]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "turn", "role", "text", "rendered"])

    rows = transcripts.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, turn long, role string, text string, rendered string")


PIECE = "conv_id long, part long, nth long, role string, text string, continued boolean"
PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("continued", pa.bool_())])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _stretches(conversations: DataFrame, turns_at_once: int) -> DataFrame:
    """Rows in order, written as transcripts of at most so many rows: conv_id, own (a row by itself), part (its partition), stretch, transcript."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    rows = rows.withColumns({"style": style, "h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "h", "salt"]  # the salt parts rows that are equal
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("own", pa.bool_()), ("part", pa.int64()), ("stretch", pa.int64()), ("transcript", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[str | None, str | None]] = []
        now: tuple | None = None  # conversation, whether by itself, style

        def close() -> list[tuple]:
            nonlocal number
            if not held:
                return []
            number += 1
            out = [(now[0], now[1], part, number, write_transcript(held, now[2]))]
            held.clear()
            return out

        for batch in batches:
            out = []
            for conv, turn, role, text, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "style"))):
                own = conv is None or turn is None
                if own or now is None or now[0] != conv or now[1] or len(held) >= turns_at_once:
                    out += close()
                now = (conv, own, kind)
                held.append((role, text))
            yield _batch(schema, out)
        yield _batch(schema, close())

    return dealt.select("conv_id", "turn", "role", "text", "style").mapInArrow(run, "conv_id long, own boolean, part long, stretch long, transcript string")


def _long(stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """Pieces of the turns of conversations in several stretches, decoded as a whole."""
    model, key = TurnModel(), ["conv_id", "part"]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("conv_id", "part", "stretch", "transcript"))
            rows = [(c, p, s, name, n) for c, p, s, t in zip(*cols) for name, n in Lines(t).names().items()]
            yield _batch(pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("stretch", pa.int64()), ("name", pa.string()), ("n", pa.int64())]), rows)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conversation, part, its lines, its kinds, the other columns)."""
        for batch in batches:
            for row in batch.to_pylist():
                lines = Lines("\n".join(t["transcript"] for t in row["texts"]))
                yield row, lines, lines.kinds(set(row["once"] or ()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("across", pa.list_(pa.float64())), ("begin", pa.list_(pa.float64()))])
        for row, lines, kinds in parts(batches):
            across, begin = model.across(kinds, lines.asks)
            yield _batch(schema, [(row["conv_id"], row["part"], across.ravel().tolist(), begin.tolist())])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_conv", pa.int64()), ("_part", pa.int64()), ("entry", pa.list_(pa.float64())), ("last", pa.int32())])
        for batch in batches:
            for conv, chain in zip(batch.column("conv_id").to_pylist(), batch.column("chain").to_pylist()):
                steps = [np.array(c["across"]).reshape(6, 6) for c in chain]
                scores = [np.array(chain[0]["begin"])]
                for step in steps[1:]:
                    scores.append((scores[-1][:, None] + step).max(axis=0))
                last = [int(scores[-1].argmax())]
                for k in range(len(chain) - 1, 0, -1):
                    last.append(int((scores[k - 1] + steps[k][:, last[-1]]).argmax()))
                entry = [None, *(x.tolist() for x in scores[:-1])]
                yield _batch(schema, [(conv, c["part"], e, x) for c, e, x in zip(chain, entry, reversed(last))])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lines, kinds in parts(batches):
            entry = row["entry"]
            states = model.decode(kinds, lines.asks, None if entry is None else np.array(entry), row["last"])
            turns = lines.turns(states, entry is None)
            shift = int(not turns[0][0])  # what goes on from before is numbered 0
            yield _batch(PIECES, [(row["conv_id"], row["part"], n + shift, role, text, on) for n, (on, role, text) in enumerate(turns)])

    once = stretches.mapInArrow(names, "conv_id long, part long, stretch long, name string, n long").groupBy("conv_id", "name").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    once = once.filter("n = 1").groupBy(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).agg(F.collect_list("name").alias("once"))
    texts = stretches.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("stretch", "transcript"))).alias("texts"))
    texts = scratch.save(texts.join(once, (F.col("conv_id") == F.col("_c")) & (F.col("part") == F.col("_p")), "left").select(*key, "texts", "once"))
    chains = scratch.save(texts.mapInArrow(matrices, "conv_id long, part long, across array<double>, begin array<double>"))
    chains = chains.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "across", "begin"))).alias("chain"))
    known = scratch.save(chains.mapInArrow(borders, "_conv long, _part long, entry array<double>, last int"))
    return texts.join(known, (F.col("conv_id") == F.col("_conv")) & (F.col("part") == F.col("_part"))).select(*key, "texts", "once", "entry", "last").mapInArrow(decoded, PIECE)


def recover(conversations: DataFrame, turns_at_once: int = 256) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn (from 0), role, text, rendered, continued. Each conversation is written as a
    transcript, in the style of its id's hash, and parsed again.

    `continued` marks a piece that goes on with the turn of that number from the part before: a turn of any length needn't fit in one task."""
    scratch = Scratch(conversations.sparkSession, "chat")
    model = TurnModel()
    stretches = scratch.save(_stretches(conversations, turns_at_once))
    many = stretches.filter("not own").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = scratch.save(many.select(F.col("conv_id").alias("_conv")))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, part, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "transcript"))):
                rows += [(conv, part, n, role, said, False) for n, (role, said) in enumerate(parse(text, model))]
            yield _batch(PIECES, rows)

    alone = stretches.join(many, ~F.col("own") & (F.col("conv_id") == F.col("_conv")), "left_anti")
    out = alone.select("conv_id", "part", "transcript").mapInArrow(short, PIECE).select("conv_id", F.col("nth").alias("turn"), "role", "text", "continued")
    if not many.isEmpty():
        long = scratch.save(_long(stretches.filter("not own").join(many, F.col("conv_id") == F.col("_conv"), "left_semi"), scratch))
        before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = long.groupBy("conv_id", "part").agg(F.max("nth").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        sizes = sizes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "base")
        long = long.join(sizes, (F.col("conv_id") == F.col("_conv")) & (F.col("part") == F.col("_part")))
        out = out.unionByName(long.select("conv_id", (F.col("base") + F.col("nth") - 1).alias("turn"), "role", "text", "continued"))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    return out.select("conv_id", "turn", "role", "text", rendered.alias("rendered"), "continued")


def recover_turns(conversations: DataFrame, turns_at_once: int = 256) -> DataFrame:
    """`recover` with digests for the texts: conv_id, turn, role, n_chars, text_sha256, rendered_sha256, continued."""
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return recover(conversations, turns_at_once).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), sha("text"), sha("rendered"), "continued")
