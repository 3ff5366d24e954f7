"""Chat formatting by incremental rendering of a template that is treated as a black box."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that have a meaning in the output and so may not stand in a text as they are.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>")
_rest = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}))
_plain = re.compile(rf"([<\[])(\\*)(?={_rest})")
_escaped = re.compile(rf"([<\[])\\(\\*)(?={_rest})")
_turn = re.compile(r"(?:<s>)?<\|turn\|>(.*?)<\|text\|>(.*)</s>\n", re.S)
#: A private-use character whose place in a rendering shows where a text goes.
PROBE = ""


def escape(text: str) -> str:
    """One backslash more after the first character of each control string, however many there are already."""
    return _plain.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2", text)


def marked(turns: list[Turn]) -> str:
    """The standard template: each turn has its role and text between marks."""
    return "<s>" + "".join(f"<|turn|>{escape(role)}<|text|>{escape(text)}</s>\n" for role, text in turns)


#: The output is the joined outputs of single turns, so what a turn adds doesn't depend on the turns before it.
marked.appends = True


def parse(piece: str) -> Turn:
    """Role and text, read back from what the standard template made of a turn."""
    found = _turn.fullmatch(piece)
    if not found:
        raise ValueError("not a turn of this template")
    return unescape(found[1]), unescape(found[2])


Span = tuple[str, int, int, int, int]


class _Rendering:
    """What successive turns add to a template's output, seen through the last turns that it is shown."""

    def __init__(self, template: Template, turns: list[Turn], start: int, history: int | None):
        self.template, self.window, self.start, self.history = template, list(turns), start, history
        self.before, self.fresh = template(self.window), not turns

    def add(self, role: str, text: str) -> Span:
        now = self.template([*self.window, (role, text)])
        before = self.before
        kept = len(before) if now.startswith(before) else next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        rewrote = len(before) - kept
        probe = self.template([*self.window, (role, PROBE)])
        at = probe.rfind(PROBE)
        head, tail = max(0, at - kept), len(probe) - at - len(PROBE)
        piece = now[0 if self.fresh else kept :]
        head += kept if self.fresh else 0
        start = self.start - (0 if self.fresh else rewrote)
        self.start, self.fresh, self.before = start + len(piece), False, now
        self.window.append((role, text))
        if self.history and len(self.window) >= 2 * self.history:
            self.window = self.window[-self.history :]
            self.before = self.template(self.window)
        return piece, start, head, tail, rewrote


def render(turns: Iterable[Turn], template: Template, history: int = 32) -> Iterator[Span]:
    """For each turn: what it adds to the output, where that starts, its code points before and after the text, and how
    many code points of the earlier output it rewrote (0 for a template that only appends).

    The template sees the turn after all of its predecessors, so the work is quadratic in the number of turns. One that says
    of itself (`appends`) that its output is the joined outputs of single turns sees the last `history` to 2 * `history` of
    them, and is held to its word: at 2 * `history` turns, at each doubling and at the end the joined pieces are compared
    with one rendering of all turns. Where they differ, the turns since the last comparison are rendered again with all of
    their predecessors, and so are those that follow. Pieces are given after their comparison, and work stays linear for a
    template that keeps its word.
    """
    if not getattr(template, "appends", False):
        whole = _Rendering(template, [], 0, None)
        for role, text in turns:
            yield whole.add(role, text)
        return
    seen: list[Turn] = []
    held: list[Span] = []
    near, checked, digest, due = _Rendering(template, [], 0, history), 0, hashlib.sha256(), 2 * history
    whole: _Rendering | None = None

    def settle() -> list[Span]:
        """The held spans, if they make what the template makes of all turns so far; else those of whole prefixes."""
        nonlocal whole, checked, digest
        joined = digest.copy()
        for piece, _, _, _, rewrote in held:
            joined.update(piece.encode("utf-8", "surrogatepass"))
        if all(s[4] == 0 for s in held) and joined.digest() == hashlib.sha256(template(seen).encode("utf-8", "surrogatepass")).digest():
            digest, checked = joined, len(seen)
            return held
        whole = _Rendering(template, seen[:checked], held[0][1] if held else 0, None)
        return [whole.add(*turn) for turn in seen[checked:]]

    for role, text in turns:
        if whole is not None:
            yield whole.add(role, text)
            continue
        seen.append((role, text))
        held.append(near.add(role, text))
        if len(seen) == due:
            due *= 2
            yield from settle()
            held = []
    if held:
        yield from settle()


PIECES = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("rewrote", pa.int64()), ("loss", pa.bool_())])


def format_turns(conversations: DataFrame, template: Template = marked, learn: str = "assistant", history: int = 32) -> DataFrame:
    """A row per turn: what the template adds for it (`piece`), where it starts in the conversation's output, and the span
    of its text in the piece (`head` code points before it, `tail` after it), which is under the loss mask where the role
    is `learn`. `rewrote` counts the code points of earlier output that the turn changed; above 0, the template rewrites
    history and spans of earlier turns no longer hold.

    Rows are hashed by conversation, sorted, and streamed through a task in batches: a conversation is one task (its output
    and digests are sequential) that holds its texts, in linear time where the template `appends`: see render(). Turns are
    ordered by turn, nulls first, then role and text. Null texts and roles count as empty; a null conv_id is a conversation of its own; repeated rows are
    turns of their own; an empty table gives no rows; other columns are ignored.
    The rows of a partition come out in order of conversation and turn.
    """

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for b in found:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

        def rows():
            for conv, turns in itertools.groupby(flat(), key=lambda r: r[0]):
                turns, roles = itertools.tee((r[1], r[2]) for r in turns)
                for seq, ((role, _), (piece, start, head, tail, rewrote)) in enumerate(zip(roles, render(turns, template, history))):
                    yield 4 * len(piece) + 64, (conv, seq, role, piece, start, head, tail, rewrote, role == learn)

        yield from batches(rows(), PIECES)

    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = named.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(make, "conv_id long, seq long, role string, piece string, start long, head long, tail long, rewrote long, loss boolean")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrote", pa.int64())])


def read_back(pieces: DataFrame) -> DataFrame:
    """A row per conversation, from the output of format_turns with the standard template alone: its turns are parsed and
    unescaped again, and the text under the loss mask is what lies between head and tail of the learnt pieces."""

    def digest(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for b in found:
                yield from zip(*(b.column(i).to_pylist() for i in range(6)))

        def rows():
            for conv, turns in itertools.groupby(flat(), key=lambda r: r[0]):
                n, chars, learnt, rewritten = 0, 0, 0, 0
                told, loss = hashlib.sha256(), hashlib.sha256()
                for _, piece, head, tail, rewrote, masked in turns:
                    role, text = parse(piece)
                    told.update(f"{role}\n{text}\n".encode())
                    n, chars, rewritten = n + 1, chars + len(piece), rewritten + rewrote
                    if masked:
                        text = unescape(piece[head : len(piece) - tail])
                        learnt += len(text)
                        loss.update(text.encode())
                yield 300, (conv, n, told.hexdigest(), learnt, loss.hexdigest(), chars, rewritten)

        yield from batches(rows(), DIGEST)

    return pieces.select("conv_id", "piece", "head", "tail", "rewrote", "loss").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrote long")
