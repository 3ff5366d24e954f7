"""Packing token sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, partitions, stage, utf8

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: What stands between words that are tokenized together.
MARK = b"\x01"
#: Words whose ids a worker remembers at once.
REMEMBERED = 600_000
#: Branches of bin completion, and rounds times lengths of the relaxations that packing may always take.
NODES, WORK = 6_000, 200_000

PIECES = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class WordIds:
    """Ids of texts as little-endian 32-bit bytes. The vocabulary's pre-tokens never span ASCII white space and its
    normalizer lowers case, so each lowered word is given to the tokenizer once, with others, and its ids are remembered; a comma or full
    stop after an ASCII letter is a pre-token of its own. The result equals encoding the whole text."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"], self.remembered = "false", remembered
        from tokenizers import Tokenizer

        # Kept in the worker process, where later tasks find it again.
        kept = sys.modules.setdefault("junctura_word_ids", types.ModuleType("junctura_word_ids"))
        self.tokenizer, self.known = kept.__dict__.setdefault(f"of {vocabulary}", (Tokenizer.from_file(vocabulary), {}))
        self.ends = {c: self.ids([chr(c)])[0] for c in b".,"}
        # A word of one id, which no word without this character has.
        self.mark = next((np.frombuffer(x, "<u4")[0] for x in self.ids([MARK.decode()]) if len(x) == 4), None)

    def ids(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: words go to the tokenizer as one text with marks between them, and its ids are cut there."""
        if len(words) < 2 or self.mark is None or any(MARK in w for w in words):
            return self.ids([w.decode("utf-8", "replace") for w in words])
        text = (b" " + MARK + b" ").join(words).decode("utf-8", "replace")
        found = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * np.flatnonzero(found == self.mark)).tolist()
        if len(at) != len(words) - 1:
            return self.ids([w.decode("utf-8", "replace") for w in words])
        data = found.tobytes()
        return [data[i:j] for i, j in zip([0, *(i + 4 for i in at)], [*at, len(data)])]

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:  # special tokens are told by case
            return self.ids([text.decode("utf-8", "replace")])[0]
        words = text.lower().split()
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + 2 * len(new) > self.remembered:
                known.clear()
                new = set(words)
            ended = [w for w in new if w[-1] in self.ends and len(w) > 1 and 97 <= w[-2] <= 122]
            new.difference_update(ended)
            new.update(w[:-1] for w in ended if w[:-1] not in known)
            plain = list(new)
            known.update(zip(plain, self.each(plain)))
            known.update((w, known[w[:-1]] + self.ends[w[-1]]) for w in ended)
        return b"".join(map(known.__getitem__, words))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """The ids of each text followed by `end`, cut only where longer than `capacity`: a row per piece with its ids
    (little-endian 32-bit bytes; left out unless keep_ids) and their checksum. A worker remembers the ids of `remembered` words. Null and empty texts have the end alone."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    tail, step = np.asarray([end], "<u4").tobytes(), 4 * capacity

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(vocabulary, remembered)

        def rows():
            for batch in found:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = coder.encode(data.as_py()) + tail
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        yield 48 + (len(piece) if keep_ids else 0), (k, at // step, at // 4, len(piece) // 4, zlib.crc32(piece), piece if keep_ids else None)

        yield from batches(rows(), PIECES)

    made = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("data")).mapInArrow(cut, "key long, piece long, start long, length long, ids_crc32 long, ids binary")
    made = made.withColumnRenamed("key", key)
    return made if keep_ids else made.drop("ids")


def reachable(counts: np.ndarray, room: int) -> list[int]:
    """For each length up to room: the sums up to room of items of at most that length, as bits."""
    mask, bits, out = (1 << (room + 1)) - 1, 1, [1]
    for length, n in enumerate(counts[1 : room + 1].tolist(), 1):
        left, step = min(n, room // length), 1
        while left > 0:
            step = min(step, left)
            bits |= (bits << (step * length)) & mask
            left -= step
            step *= 2
        out.append(bits)
    return out


def fillings(counts: np.ndarray, room: int, tried: int = 50) -> Iterator[tuple[tuple[int, int], ...]]:
    """Undominated fillings of the room as (length, times), the least waste first.

    One item that fits exactly dominates all else. Next comes the exact pair nearest to halves, which spares small items for
    rooms that need them; then others, larger items first. Branches whose sums cannot reach the wanted waste are pruned by
    the bits of reachable sums. A filling is dominated, and passed over, where one available item can take the place of two
    of its items (or of one and of waste); after `tried` of these for a waste, the next waste is taken.
    """
    if room <= 0 or not counts[1 : room + 1].any():
        yield ()
        return
    if counts[room]:
        yield ((room, 1),)
        return
    there = counts[1:room] > 0
    pairs = np.flatnonzero(there & there[::-1]) + 1
    pairs = pairs[(2 * pairs < room) | (2 * pairs == room) & (counts[np.minimum(pairs, room)] > 1)]
    if len(pairs):
        small = int(pairs[-1])
        yield ((small, 2),) if 2 * small == room else ((room - small, 1), (small, 1))
    sums, held = reachable(counts, room), counts.tolist()

    def search(target: int, top: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if target == 0:
            yield ()
            return
        for length in range(min(top, target), 0, -1):
            if not sums[length] >> target & 1:
                return
            for times in range(min(held[length], target // length), 0, -1):
                if sums[length - 1] >> (target - times * length) & 1:
                    for more in search(target - times * length, length - 1):
                        yield ((length, times), *more)

    for waste in range(room):
        if sums[room] >> (room - waste) & 1:
            for i, found in enumerate(search(room - waste, room)):
                items = [length for length, times in found for _ in range(min(times, 2))]
                swaps = {x + y for j, x in enumerate(items) for y in items[:j]}
                if i == 0 or not any(s <= room and held[s] for s in swaps):
                    yield found
                if i >= tried:
                    break


def bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: all items over the capacity, or the items of more than half of it."""
    return max(-(-int(counts @ np.arange(len(counts))) // capacity), int(counts[capacity // 2 + 1 :].sum()))


Pattern = tuple[int, tuple[tuple[int, int], ...]]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of items from the largest down: each goes to the fullest bin that has room, many bins at a time."""
    bins: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {capacity: []}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((f for f, held in bins.items() if f >= length and held), default=capacity)
            n, items = bins[room].pop() if room < capacity else (left, ())
            times = min(room // length, left)
            use = min(n, left // times)
            if n > use and room < capacity:
                bins[room].append((n - use, items))
            bins.setdefault(room - times * length, []).append((use, (*items, (length, times))))
            left -= use * times
    return [held for rows in bins.values() for held in rows]


def complete(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """One descent of bin completion: the largest item left gets its best filling, in as many bins as the counts allow."""
    return branch(counts, capacity, None, 0, 0)


def branch(counts: np.ndarray, capacity: int, best: list[Pattern] | None, least: int, nodes: int) -> list[Pattern]:
    """Branch-and-bound of bin completion from the incumbent `best`; without one, the first descent alone.

    A node takes the largest item left and tries its undominated fillings, the least waste first, each in as many bins as
    the counts allow. What is left of the incumbent's waste, less a bin, bounds the waste of a branch: a filling over it ends
    its node, as those after it waste more, and a branch whose bins and bound of the rest are no better than the incumbent
    isn't entered. A better packing is the new incumbent. The search ends at `least` bins, when all branches are pruned,
    or after `nodes` of them.
    """
    total = lambda patterns: sum(n for n, _ in patterns)
    volume, only = int(counts @ np.arange(len(counts))), best is None
    bins = np.inf if only else total(best)
    chosen: list[Pattern] = []
    stack: list = []
    rest, used, waste = counts.copy(), 0, 0

    def enter():
        there = np.flatnonzero(rest)
        largest = int(there[-1])
        rest[largest] -= 1
        stack.append((largest, fillings(rest.copy(), capacity - largest), used, waste))
        rest[largest] += 1

    if not rest.any():
        return []
    enter()
    while stack:
        largest, options, used, waste = stack[-1]
        if len(chosen) == len(stack):  # back from a branch
            often, items = chosen.pop()
            for length, times in items:
                rest[length] += often * times
        found = next(options, None)
        nodes -= 1
        if found is None or not only and nodes < 0:
            stack.pop()
            continue
        whole = {largest: 1}
        for length, times in found:
            whole[length] = whole.get(length, 0) + times
        often = min(int(rest[length]) // times for length, times in whole.items())
        lost = capacity - sum(length * times for length, times in whole.items())
        if waste + lost > (bins - 1) * capacity - volume:
            stack.pop()
            continue
        for length, times in whole.items():
            rest[length] -= often * times
        chosen.append((often, tuple(sorted(whole.items(), reverse=True))))
        used, waste = used + often, waste + often * lost
        if not rest.any():
            if used < bins:
                best, bins = list(chosen), used
            if only or bins <= least:
                return best
            continue
        if used + bound(rest, capacity) < bins and waste <= (bins - 1) * capacity - volume:
            enter()
    return best


def priced(counts: np.ndarray, lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of a bin of the highest price, with no length more often than it is there, and its price."""
    value, steps = np.zeros(capacity + 1), []
    for i in np.flatnonzero(prices > 1e-12).tolist():
        length, left, times = int(lengths[i]), int(min(counts[i], capacity // lengths[i])), 1
        while left > 0:
            times = min(times, left)
            more = value[: capacity + 1 - times * length] + times * prices[i]
            better = more > value[times * length :] + 1e-12
            value[times * length :][better] = more[better]
            steps.append((i, times, times * length, better))
            left -= times
            times *= 2
    room, out = capacity, np.zeros(len(lengths), np.int64)
    for i, times, size, better in reversed(steps):
        if room >= size and better[room - size]:
            out[i] += times
            room -= size
    return float(value[capacity]), out


def relaxed(counts: np.ndarray, lengths: np.ndarray, capacity: int, enough: float, rounds: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The linear relaxation over all patterns, by the simplex method with patterns made as prices ask for them: patterns
    as columns, how often each is taken, a lower bound of bins, and rounds used. It ends at the optimum, when the bound
    reaches `enough`, or after `rounds`; what is taken adds up to the counts at any time."""
    often = np.minimum(counts, capacity // lengths)
    columns, inverse, taken, least = np.diag(often), np.diag(1.0 / often), counts / often, 0
    for used in range(1, rounds + 1):
        prices = inverse.sum(axis=0)
        price, column = priced(counts, lengths, prices, capacity)
        least = max(least, int(np.ceil(prices @ counts / max(price, 1.0) - 1e-6)))
        if least >= enough or price <= 1 + 1e-9:
            return columns, taken, least, used
        change = inverse @ column
        ratio = np.where(change > 1e-9, taken / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        taken = taken - ratio[out] * change
        taken[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[:, out] = column
    return columns, taken, least, rounds


def by_patterns(counts: np.ndarray, capacity: int, best: list[Pattern], least: int, rounds: int) -> tuple[list[Pattern], int]:
    """The best packing found from relaxations, and the highest lower bound: whole parts of a relaxation are fixed (where
    there are none, once each pattern that is taken half or more, or the one taken most), and the rest is packed by a
    descent, which is compared with the best, and relaxed again."""
    total = lambda patterns: sum(n for n, _ in patterns)
    rest, fixed = counts.copy(), []
    while rest.any() and rounds > 0 and total(best) > least and total(fixed) + bound(rest, capacity) < total(best):
        lengths = np.flatnonzero(rest)
        columns, taken, found, used = relaxed(rest[lengths], lengths, capacity, total(best) - total(fixed), rounds)
        rounds -= used
        if not fixed:
            least = max(least, found)
        if total(fixed) + found >= total(best):
            break
        whole = np.floor(taken + 1e-6).astype(np.int64)
        if not whole.any():
            whole = (taken >= min(0.5, taken.max())).astype(np.int64)
        for j in np.argsort(-taken, kind="stable"):
            there = rest[lengths]
            column = np.minimum(columns[:, j], there)
            if whole[j] and column.any():
                n = min(int(whole[j]), int((there[column > 0] // column[column > 0]).min()))
                rest[lengths] -= n * column
                fixed.append((n, tuple((int(lengths[i]), int(column[i])) for i in np.flatnonzero(column)[::-1])))
        other = fixed + complete(rest, capacity)
        if total(other) < total(best):
            best = other
    return best, least


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, work: int = WORK) -> list[Pattern]:
    """Patterns (bins, ((length, times in a bin), ...)) that pack the histogram's items into few bins.

    Best fit from the largest item down gives the first incumbent, and branch-and-bound over undominated fillings of the bin
    of the largest item improves it, in at most `nodes` branches. If it still has more bins than the lower bound, patterns
    are priced by linear relaxation (by_patterns), which also raises the lower bound. Relaxations take at most `work`
    numbers, or as many as there are items, in rounds of a number per length; where these are fewer than three rounds a
    length, there is none. The input has one entry per length, however many rows there are.
    """
    counts = np.array([histogram.get(length, 0) for length in range(capacity + 1)], np.int64)
    least, total = bound(counts, capacity), lambda patterns: sum(n for n, _ in patterns)
    best = best_fit(counts, capacity)
    if total(best) > least:
        best = branch(counts, capacity, best, least, nodes)
    lengths = max(1, np.count_nonzero(counts))
    rounds = max(work, int(counts.sum())) // lengths
    if total(best) > least and rounds >= 3 * lengths:
        best, _ = by_patterns(counts, capacity, best, least, rounds)
    return best


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a bin, first offset), by length and rank: where the items of each
    length go, in order of their rank among the items of that length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, items in patterns:
        offset = 0
        for length, times in items:
            rows.append((length, used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, rows_per_part: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1 to capacity; all rows are packed.

    The driver packs the histogram of lengths (at most `capacity` numbers) by bin completion. Rows get a rank among those
    of their length by counts per (length, part), prefix sums over these, and a rank within each; a length that most rows
    have is spread over parts. A rank's place is then looked up in the table of patterns, which is as small as the
    histogram. The input should be a staged table: it is read three times.
    Repeated rows are packed as they come; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(1, partitions(spark), sum(histogram.values()) // rows_per_part)
    table = places(bin_completion(histogram, capacity, nodes))
    tied = pieces.withColumn("_part", F.pmod(F.xxhash64(*[c for c in pieces.columns if c in ("doc_id", "piece", "ids_crc32", "tie")]), F.lit(parts)))
    counts = tied.groupBy("length", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_part").orderBy(*[c for c in pieces.columns if c in ("doc_id", "piece", "ids_crc32", "tie")])
    ranked = tied.join(counts, ["length", "_part"]).withColumn("rank", F.col("_before") + F.row_number().over(order) - 1).drop("_part", "_before")

    def place(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] << 44 | table[:, 1]
        for batch in found:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            length, rank = (batch.column(at[n]).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = table[np.searchsorted(starts, length.astype(np.int64) << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in keep), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Documents as token pieces in sequences of at most `capacity`: see token_pieces() and pack()."""
    pieces = token_pieces(docs, capacity, vocabulary, key=key, text=text, keep_ids=False, remembered=remembered).withColumn("tie", F.monotonically_increasing_id())
    return pack(stage(pieces, "pack-pieces"), capacity).drop("tie")
