"""Suffix arrays by induced sorting with true recursion, on numpy vectors in place of single steps."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
VALUES = np.random.default_rng(19920817).integers(1, 1 << 63, 256, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    for i, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[i]) < n:
            held = _powers[i]
            _powers[i] = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums for span_hashes(); one longer than the data."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def smaller_types(data: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than its right neighbour (S type). The end is smaller than all."""
    n = len(data)
    rising = np.append(data[1:] > data[:-1], False)
    at = np.where(np.append(data[1:] != data[:-1], True), np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ decides
    return rising[nearest]


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers below 2^32, by counting in 16-bit digits where there are many."""
    if values.dtype.itemsize <= 2 or len(values) < 1 << 12:
        return np.argsort(values, kind="stable")
    if values.max() < 1 << 16:
        return np.argsort(values.astype(np.uint16), kind="stable")
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]


def ranks_within(sorted_values: np.ndarray) -> np.ndarray:
    """For each of some sorted values, how many equal ones stand before it."""
    n = len(sorted_values)
    starts = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if n else np.empty(0, np.int64)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def scanned(chars: np.ndarray, back: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, opening: bool) -> np.ndarray:
    """The places of `wanted` type in order of their suffixes, in one pass over the characters from small to large.

    What is handled is runs of one character, by their last place: a run gets its slot when the run after it is met, and a
    seed (a place of the other type, in order) is met after the runs of its bucket. A bucket is whole when all its slots are
    taken, so as many whole buckets as there are go together as vectors; places of a run follow as rounds, those with fewer
    equal characters (`back`) still to come first. `opening`: the end of the string comes before all.
    """
    n = len(chars)
    ends = np.flatnonzero(wanted & np.append(chars[1:] != chars[:-1], True))
    letters = int(chars.max()) + 1
    runs = np.bincount(chars[ends], minlength=letters)
    begin = np.zeros(letters + 1, np.int64)
    np.cumsum(runs + np.bincount(chars[seeds], minlength=letters), out=begin[1:])
    home = np.repeat(np.arange(letters), np.diff(begin))
    seeded = begin[:-1] + runs
    slots = np.full(len(home), -1, np.int64)
    slots[seeded[chars[seeds]] + ranks_within(chars[seeds])] = seeds
    head = begin[:-1].copy()
    if opening:
        slots[head[chars[n - 1]]] = n - 1
        head[chars[n - 1]] += 1
    out = [np.empty(0, np.int64)]
    at, width, total = 0, 64, len(slots)
    while at < total:
        open_ = slots[at : at + width] < 0
        gap = int(open_.argmax())
        if not open_[gap]:
            gap = len(open_)
        stop = at + gap
        if stop < total:
            stop = int(begin[home[stop]])
            if stop <= at:  # a bucket that is larger than the window
                stop = int(begin[home[at] + 1])
        width = max(64, 2 * gap)
        met, homes = slots[at:stop], home[at:stop]
        seed = np.arange(at, stop) >= seeded[homes]
        rounds = back[met]
        if not rounds.any():
            out.append(met[~seed])
        elif homes[0] == homes[-1] and (most := int(rounds.max())) < 64:  # one bucket: a vector for each round
            size = int(seeded[homes[0]]) - at
            held, left, by_round = met[:size], rounds[:size], []
            for turn in range(most + 1):
                out.append(held - turn)
                by_round.append((held - turn)[left == turn])
                held, left = held[left > turn], left[left > turn]
            met, rounds = np.concatenate([*by_round, met[size:]]), 0
        else:
            held, many = met[~seed], rounds[~seed] + 1
            place = np.repeat(held, many)
            turn = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
            order = stable_order(turn)
            order = order[stable_order(np.repeat(homes[~seed], many)[order])]
            out.append((place - turn)[order])
            order = stable_order(np.where(seed, n, rounds))
            order = order[stable_order(homes[order])]
            met, rounds, homes = met[order], rounds[order], homes[order]
        before = met - rounds - 1
        found = chars[before]
        keep = (found > homes) & (before >= 0)  # of the wanted type, as a run's neighbour differs from it
        before, found = before[keep], found[keep]
        if len(before):
            order = stable_order(found)
            before, found = before[order], found[order]
            rank = ranks_within(found)
            slots[head[found] + rank] = before
            last = np.append(found[1:] != found[:-1], True)
            head[found[last]] += rank[last] + 1
        at = stop
    return np.concatenate(out)


def induce(data: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S-type ones in order: L types from small to large characters, then S types
    from large to small ones, which is the same pass over the characters turned round."""
    places = np.arange(len(data))
    back = (places - np.maximum.accumulate(np.where(np.append(True, data[1:] != data[:-1]), places, 0))).astype(np.int32)
    low = scanned(data, back, ~small, leftmost, True)
    turns = low[low > 0]
    turns = turns[small[turns - 1]][::-1]
    high = scanned(data.max() - data, back, small, turns, False)[::-1]
    sizes = np.bincount(data)
    many = np.bincount(data[~small], minlength=len(sizes))
    lows = np.tile([True, False], len(sizes)).repeat(np.stack([many, sizes - many], axis=1).ravel())  # L types lead a bucket
    order = np.empty(len(data), np.int64)
    order[lows], order[~lows] = low, high
    return order


def unequal(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each substring differs from the one before it; all characters of neighbours of one size are compared."""
    alike = np.flatnonzero((size[1:] == size[:-1]) & (data[start[1:]] == data[start[:-1]]))
    differ = np.ones(len(start), bool)
    if len(alike):
        sizes = size[alike]
        opens = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(opens, sizes)
        apart = data[np.repeat(start[alike], sizes) + step] != data[np.repeat(start[alike + 1], sizes) + step]
        differ[alike + 1] = np.logical_or.reduceat(apart, opens)
    return differ


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes are classified; substrings between leftmost S types are put in order by a first induction and named by
    their characters; where names repeat, the string of names, at most half as long, is ordered in the same way; a second
    induction gives all suffixes. Takes bytes or non-negative integers that are at most as large as the string is long."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    small = smaller_types(data)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(left) < 2:
        return induce(data, small, left)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    rough = induce(data, small, left[stable_order(data[left])])
    ordered = rough[is_left[rough]]
    size = np.zeros(n, np.int64)
    size[left] = np.append(left[1:] + 1, n + 1) - left
    size[left[-1]] += n  # ends at the end of the string, and so equals no other
    differ = unequal(data, ordered, size[ordered])
    if not differ.all():
        name = np.empty(n, np.int32)
        name[ordered] = np.cumsum(differ) - 1
        ordered = left[suffix_array(name[left])]
    return induce(data, small, ordered)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes up to `most`: for each place in the text, what its suffix has in common with the one before
    it in order; compared 8 bytes at a time, in text order."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.zeros(n + most + 8, np.uint64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    common = np.zeros(n, np.int64)
    active = np.flatnonzero(before < n)
    for k in range(-(-most // 8)):
        apart = words[active + 8 * k] ^ words[before[active] + 8 * k]
        same = apart == 0
        ended, apart = active[~same], apart[~same]
        for i in range(1, 8):
            common[ended] += apart & np.uint64((1 << (8 * i)) - 1) == 0
        active = active[same]
        common[active] += 8
        if not len(active):
            break
    common = np.minimum(common, most)
    return np.minimum(common, np.minimum(n - np.arange(n), n - np.minimum(before, n)))
