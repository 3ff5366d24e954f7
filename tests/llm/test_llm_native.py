"""Mixing, sharding, packing, media and Merkle trees against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from junctura.llm import common, media, merkle, mixing, packing, queries, sharding

DOCS = [
    (0, "One two three. Four five!\nSix", "a"), (1, None, "b"), (2, "", "a"), (3, "Ünïcödé " * 50, None), (4, "x " * 5000, "a"), (4, "x " * 5000, "a"),
    (None, "no id here", "b"), (None, "no id here", "b"), (7, "same text", "c"), (8, "same text", "c"), (9, "A lone line, quite long. " * 20, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "extra", 1) for i, t, s in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, h int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return len([w for w in (t or "").split() if w])


def targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    while True:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        free = [s for s in free if s not in over]


def check_mix(rows, source_of):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[source_of(r)] += r.size
        taken[source_of(r)] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    expect = targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(expect[source_of(r)]) and r.source_size == sizes[source_of(r)]
    assert all(abs(taken[s] - expect[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_small(docs, empty):
    found = mixing.mix(docs, block=7)
    rows = found["taken"].collect()
    assert sorted(r.size for r in rows) == sorted(words(t) for _, t, _ in DOCS)
    by_size = {words(t): s for _, t, s in DOCS}
    check_mix([r for r in rows if r.size], lambda r: by_size[r.size])
    again = mixing.mix(docs.repartition(2), block=7)["taken"].collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(empty)["taken"].count() == 0


def test_mix_table(spark, sf):
    source = {r.doc_id: r.source for r in common.table(spark, sf, "documents").collect()}
    check_mix(queries.op1_mixing(spark, sf).collect(), lambda r: source[r.doc_id])


def test_schedule_is_even(spark, sf):
    slots = mixing.mix(common.table(spark, sf, "documents"), block=16)["schedule"].orderBy("position").collect()
    n = len(slots)
    assert len({r.position for r in slots}) == n
    seen, share = defaultdict(int), defaultdict(int)
    for r in slots:
        share[r.skey] += 1
    for i, r in enumerate(slots):
        assert r.nth == seen[r.skey]
        seen[r.skey] += 1
        assert abs(seen[r.skey] - share[r.skey] * (i + 1) / n) < 2 + np.log2(n)


def test_targets_are_capped(spark):
    rows = spark.createDataFrame([(f"s{s}", s, n) for s, n in (("a", 10), ("b", 1000), ("c", 5), ("d", 300))], "skey string, source string, source_size long")
    got = {r.skey: r.target for r in mixing.source_targets(rows).collect()}
    expect = targets({"a": 10, "b": 1000, "c": 5, "d": 300})
    assert {k[1:]: pytest.approx(v) for k, v in got.items()} == expect


def test_shards(docs, empty, spark, sf):
    rows = sharding.shard_by_bytes(docs, 3).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, _ in DOCS)
    assert sharding.shard_by_bytes(empty).count() == 0
    got = queries.op3_sharding(spark, sf).orderBy("doc_id").collect()
    text = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").collect()}
    total, slots, shards = sum(len(t) + 1 for t in text.values()), defaultdict(int), defaultdict(int)
    for a, b in zip(got, got[1:]):
        assert a.shard <= b.shard
    for r in got:
        assert r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        shards[r.shard] += r.size
    assert set(shards) == set(range(8)) and all(abs(n - total / 8) <= max(map(len, text.values())) + 1 for n in shards.values())


def paragraphs(text):
    return re.findall(r"[^\n.!?]{0,95}[\n.!?]+|[^\n.!?]{1,96}", text)


def plain_fingerprint(text):
    sections, tree = [""], ""
    for h in (hashlib.sha256(p.encode()).hexdigest() for p in paragraphs(text)):
        end = int(h, 16) % 8 == 0
        sections[-1] += h if end else h + ","
        sections += [""] * end
        tree += h[:12] + (",", "|")[end]
    return hashlib.sha256("|".join(hashlib.sha256(x.encode()).hexdigest() for x in sections).encode()).hexdigest() + ":" + tree


def test_merkle(docs, empty, spark, sf):
    ordered = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    got = merkle.edited_fingerprints(docs).collect()
    assert len(got) == len(DOCS) and merkle.edited_fingerprints(empty).count() == 0
    digest = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest()
    texts = [t or "" for _, t, _ in ordered]
    assert sorted(r.edited_sha256 for r in got) == sorted(digest(a, texts[(i + 1) % len(texts)]) for i, a in enumerate(texts))
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[7] == same[8] and same[1] == same[2] and len({same[0], same[1], same[3], same[4], same[7], same[9]}) == 6
    table = sorted((r.doc_id, r.text or "") for r in common.table(spark, sf, "documents").collect())
    follow = {k: (t, table[(i + 1) % len(table)][1]) for i, (k, t) in enumerate(table)}
    for r in queries.op5_merkle(spark, sf).collect():
        a, b = follow[r.doc_id]
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(a), plain_fingerprint(edited))
        for got, other in ((r.near_edited, edited), (r.near_next, b)):
            x, y = set(paragraphs(a)), set(paragraphs(other))
            assert got == pytest.approx(2 * len(x & y) / (len(x) + len(y)) if x or y else 1)
    one = merkle.fingerprints(docs.where("doc_id = 9")).first().fingerprint
    other = merkle.fingerprints(spark.createDataFrame([(9, DOCS[-1][1] + "More. ")], "doc_id long, text string")).first().fingerprint
    pair = spark.createDataFrame([(one, other, one)], "a string, b string, c string").select(merkle.edits(merkle.F.col("a"), merkle.F.col("b")).alias("e"), merkle.edits(merkle.F.col("a"), merkle.F.col("c")).alias("n")).first()
    assert len(pair.e) >= 1 and pair.n == []


def test_merkle_blocks(spark):
    rows = spark.createDataFrame([(i * i, f"text {i}") for i in range(500)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in merkle.with_next(rows).collect()}
    assert got == {i * i: f"text {(i + 1) % 500}" for i in range(500)}


def test_merkle_of_one_key(spark):
    """A key that most rows have is cut by hashes of texts: each row still has one successor, in one circle."""
    rows = spark.range(2000).selectExpr("if(id % 4 = 0, id, null) as doc_id", "concat('text ', id) as text")
    got = {r.text: r.next_text for r in merkle.with_next(rows).collect()}
    at, seen = "text 0", set()
    while at not in seen:
        seen.add(at)
        at = got[at]
    assert len(got) == len(seen) == 2000
    named = [r.doc_id for r in rows.where("doc_id is not null").orderBy("doc_id").collect()]
    assert all(got[f"text {a}"] == f"text {b}" for a, b in zip(named, named[1:]))


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(packing.VOCABULARY))


def test_packing(docs, empty, spark, sf):
    t = tokenizer()
    for frame in (docs, common.table(spark, sf, "documents")):
        rows = [(r.doc_id, r.text or "") for r in frame.collect()]
        expect = []
        for i, text in rows:
            ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
            expect += [(str(i), s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
        got = packing.pack_documents(frame).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expect)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.pack_documents(empty).count() == 0
    kept = packing.token_pieces(docs.where("doc_id = 0"), keep_ids=True).first()
    assert np.frombuffer(kept.ids, "<u4").tolist() == [*t.encode(DOCS[0][1], add_special_tokens=False).ids, 0]


def test_word_ids_equal_whole_texts():
    t = tokenizer()
    import public_tokenizers as P

    w = packing.WordIds(P.path(packing.VOCABULARY))
    for text in ("It's DON'T, end. e.g. a.b.c ... x., ,y ", "<|endoftext|> a <|ENDOFTEXT|>", "é é ÀÉ b\x1cc İstanbul ΣΑΣ.", "á. 12,3. !?., ﬁne ½", " x\u0085y"):
        assert np.frombuffer(w.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_branch_and_bound_finds_the_least():
    rng = np.random.default_rng(15)
    better = 0
    for _ in range(150):
        sizes = rng.integers(4, 21, 9).tolist()
        counts = np.bincount(sizes, minlength=31)
        fits = [m for m in range(1, 1 << 9) if sum(x for i, x in enumerate(sizes) if m >> i & 1) <= 30]
        least = [0] + [99] * 511
        for m in range(1, 512):
            least[m] = 1 + min(least[m & ~f] for f in fits if f & m == f and f & (m & -m))
        first = packing.best_fit(counts, 30)
        assert sum(n * np.bincount([x for x, t in items for _ in range(t)], minlength=31) for n, items in first).tolist() == counts.tolist()
        found = packing.branch(counts, 30, first, 0, 10_000)
        assert sum(n for n, _ in found) == least[511] <= sum(n for n, _ in first)
        better += sum(n for n, _ in found) < sum(n for n, _ in first)
    assert better


def test_bin_completion():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 41, int(rng.integers(1, 60)))
        histogram = dict(zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True))))
        patterns = packing.bin_completion(histogram, 40)
        packed = defaultdict(int)
        for bins, items in patterns:
            assert sum(length * times for length, times in items) <= 40
            for length, times in items:
                packed[length] += bins * times
        assert dict(packed) == histogram
        counts = np.array([histogram.get(i, 0) for i in range(41)])
        free, used = [], 0
        for s in sorted(sizes, reverse=True):  # best fit decreasing
            fits = [i for i, f in enumerate(free) if f >= s]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= s
            else:
                free.append(40 - s)
        used = sum(b for b, _ in patterns)
        assert packing.bound(counts, 40) <= used <= len(free)
    assert packing.bin_completion({}) == []


def test_media(docs, empty, spark, sf):
    got = media.media_columns(docs).collect()
    assert len(got) == len(DOCS) and media.media_columns(empty).count() == 0
    for r in got:
        assert media.decode(r.media).tobytes() == r.payload and len(r.payload) % 192 == 0 and len(r.payload) > 0
    by = {r.doc_id: r for r in got}
    assert by[1].payload == b" " * 192 and (by[7].media, by[7].feature) == (by[8].media, by[8].feature)
    text = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").collect()}
    for r in queries.op10_media(spark, sf).collect():
        payload = text[r.doc_id] + b" " * (-len(text[r.doc_id]) % 192 if text[r.doc_id] else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def plain_coefficients(payload):
    """The 64 lowest cosine coefficients, from means of pixels taken cell by cell."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).sum(axis=2).astype(float)
    n = len(grey)
    edges = [i * n // 32 for i in range(33)]
    cells = np.array([[grey[a : max(b, a + 1), 2 * x : 2 * x + 2].mean() for x in range(32)] for a, b in zip(edges, edges[1:])])
    wave = np.array([[np.cos(np.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)])
    low = np.einsum("ki,ij,lj->kl", wave, cells, wave)
    low[0, 0] = 0
    return low.ravel()


def test_media_features_of_the_table(spark, sf):
    """Features against plain sums, but for coefficients that rounding could put on either side of the median."""
    text = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").collect()}
    told = 0
    for r in queries.op10_media(spark, sf).collect():
        payload = text[r.doc_id] + b" " * (-len(text[r.doc_id]) % 192 if text[r.doc_id] else 192)
        stored = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        low = plain_coefficients(payload)
        apart = np.abs(low - np.median(low)) > 0.05
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).astype(bool)
        assert (bits == (low > np.median(low)))[apart].all()
        told += int(apart.sum())
    assert told > 50 * len(text)  # images of one row have 56 zeros, which tell nothing


def test_png_details():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 12), np.uint8)
    lines = np.zeros((9, 13), np.uint8)
    for r in range(9):  # every filter, by hand
        kind = r % 5
        up = image[r - 1].astype(int) if r else np.zeros(12, int)
        for x in range(12):
            a, b, c = (int(image[r, x - 3]) if x >= 3 else 0), int(up[x]), (int(up[x - 3]) if x >= 3 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[r, x + 1] = (int(image[r, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
        lines[r, 0] = kind
    assert (media.unfilter(lines, 3) == image).all()
    good = media.encode(media.pad(b"hello world"))
    bad = bytearray(good)
    bad[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_bin_completion_of_hot_lengths():
    lengths = [717, 517, 814, 771, 617, 660, 715, 699, 634, 614, 686, 748]
    for often in (1000, 100_000):
        patterns = packing.bin_completion({x: often for x in lengths})
        packed = defaultdict(int)
        for bins, items in patterns:
            assert bins > 0 and sum(length * times for length, times in items) <= 2048
            for length, times in items:
                packed[length] += bins * times
        assert dict(packed) == {x: often for x in lengths} and sum(bins for bins, _ in patterns) == 4 * often
    rng = np.random.default_rng(2)
    for _ in range(3):  # near the relaxation's bound where bins can't be full
        histogram = {int(x): int(n) for x, n in zip(rng.choice(np.arange(200, 1000), 20, replace=False), rng.integers(100, 3000, 20))}
        counts = np.array([histogram.get(x, 0) for x in range(2049)])
        patterns = packing.bin_completion(histogram)
        assert np.array_equal(sum(n * np.bincount([x for x, t in items for _ in range(t)], minlength=2049) for n, items in patterns), counts)
        there = np.flatnonzero(counts)
        least = packing.relaxed(counts[there], there, 2048, np.inf, 10_000)[2]
        assert least <= sum(n for n, _ in patterns) <= least + 1


def test_new_words_go_to_the_tokenizer_together():
    import public_tokenizers as P

    w = packing.WordIds(P.path(packing.VOCABULARY))
    one, asked = w.ids, []
    words = ["plain", "naïve", "it's", "'s", "́x", "a b", "x-$$$", "ΟΔΟΣ", "12.5", "日本", " "]
    w.ids = lambda words: asked.append(words) or one(words)
    assert w.each([x.encode() for x in words]) == one(words) and not asked
    assert w.each([b"a\x01b", b"\x01", b"c"]) == one(["a\x01b", "\x01", "c"])
