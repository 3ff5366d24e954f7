"""Near-duplicate vectors, hard negatives and codebooks against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from junctura.llm import codebooks, hard_negatives, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, h string, row int, v int"


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "h", 3, 4) for r in rows], SCHEMA).repartition(5)


def drawn(seed=1, n=260, width=16, odd=True):
    """Vectors at random, exact copies, crowds of near copies, repeated rows and rows that take no part."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    v[40:70] = v[3]
    v[80:150] = v[5] + rng.normal(size=(70, width)) * 0.12  # a crowd: most pairs link
    v[150:190] = v[6] + rng.normal(size=(40, width)) * 0.3  # some link
    v = v.astype(np.float32)
    labels = [int(x) for x in rng.integers(0, 3, n)]
    labels[40:190] = [1] * 150
    rows = [(i, v[i].tolist(), labels[i]) for i in range(n)]
    if odd:
        w = v[7].tolist()
        rows += [(n, None, 1), (n + 1, [0.0] * width, 1), (n + 2, [None] + w[1:], 1), (n + 3, [float("nan")] + w[1:], 1), (n + 4, [float("inf")] + w[1:], 1), (n + 5, w, None), (n + 6, [], 1), (n + 7, w[:8], labels[7]), (None, w, labels[7]), (7, w, labels[7]), (300, (v[7] * 1e19).tolist(), labels[7])]
    return rows


def fits(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def plain_links(rows):
    n = len(rows)
    ok = [r[2] is not None and fits(r[1]) and any(r[1]) for r in rows]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.93:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(keys, default=None)
        out.append((rows[i][0], len(near[i]), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 8])
def test_near_vectors(spark, block):
    """With blocks of 8 the crowd is a core, and buckets are cut into many blocks."""
    rows = drawn()
    got = near_vectors.linked_vectors(frame(spark, rows), block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_links(rows)
    assert max(r.n_links for r in got) > 60


def test_cores_are_used(spark):
    """A crowd that is a third of all rows is a core: its pairs are not compared, and each vector meets few chunks."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    v[:200] = v[0] + rng.normal(size=(200, 16)) * 0.05
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v.astype(np.float32))]
    got = near_vectors.linked_vectors(frame(spark, rows), block=16).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_links(rows)
    from pyspark.sql import functions as F

    classes = frame(spark, rows).select(F.col("vec_id").alias("id"), F.xxhash64("vec_id").alias("h"), F.lit(1).cast("long").alias("grp"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("v"))
    signed = near_vectors._signed(classes, 4, 11, 20, 11)
    cores = near_vectors._cores(signed, 0.93, 16).groupBy("core_id").count().collect()
    assert sum(r["count"] for r in cores) >= 195 and max(r["count"] for r in cores) > 100
    members = signed.withColumn("core", F.when(F.col("id") < 200, 1).otherwise(0).cast("long"))
    dealt = near_vectors._dealt(members, 16).groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert dealt <= 60  # two blocks of about 16, by hash


def test_planes_find_pairs_at_the_threshold():
    for n in (10, 10**4, 10**6, 10**9):
        bits, tables = near_vectors.planes(n)
        alike = (1 - np.arccos(0.93) / np.pi) ** bits
        assert 1 - (1 - alike) ** tables >= near_vectors.RECALL and n / 2**bits <= 512
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(1, keepdims=True) * v
    w = 0.93 * v + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)  # all at the threshold
    bits, tables = near_vectors.planes(4000)
    h = np.random.default_rng([11, 24]).standard_normal((24, bits * tables))
    same = ((v @ h >= 0) == (w @ h >= 0)).reshape(2000, tables, bits).all(2).any(1)
    assert same.mean() >= 0.999


def plain_negatives(rows):
    base = [(r[0] if r[0] is not None else 1 << 63, i, r[2], np.floor(np.array(r[1], float) * 256)) for i, r in enumerate(rows) if r[2] is not None and fits(r[1])]
    width = max(len(b[3]) for b in base)
    z = np.array([np.pad(b[3], (0, width - len(b[3]))) for b in base])
    out = []
    for i, (key, _, label, _) in enumerate(base):
        if key == 1 << 63 or key % 10:
            continue
        score = (z @ z[i]).astype(int)
        order = sorted(range(len(base)), key=lambda j: (-score[j], base[j][0]))
        for p in [j for j in order if j != i and base[j][2] == label][:5]:
            far = [j for j in order if base[j][2] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:10]
            out += [(key, base[p][0], k + 1, base[j][0], score[p], score[j]) for k, j in enumerate(far)]
    return out


@pytest.mark.parametrize("first", [4096, 20])
def test_hard_negatives(spark, monkeypatch, first):
    """With first scans of 20 rows, bounds are made by several scans; parts of 16 rows cut rings of equal distances."""
    if first == 20:
        monkeypatch.setattr(hard_negatives, "FIRST_SCAN", 20)
        monkeypatch.setattr(hard_negatives, "GROWTH", 3)
        monkeypatch.setattr(hard_negatives, "PART", (16, 16))
        monkeypatch.setattr(hard_negatives, "QUERIES", 8)
    rows = [r for r in drawn(2) if r[0] not in (300,)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(40)] + [(10, rows[11][1], 2)]
    got = sorted(tuple(1 << 63 if x is None else x for x in r) for r in hard_negatives.hard_negatives(frame(spark, rows), every=10).collect())
    expect = sorted(plain_negatives(rows))
    assert len(got) == len(expect) > 500
    # Rows of equal keys and scores may change places.
    assert [g[:1] + g[2:3] + g[4:] for g in got] == [e[:1] + e[2:3] + e[4:] for e in expect] and got == expect


def test_bounds_leave_rings_out(spark):
    """Queries near their pivot pass over far rings: fewer rows are visited than a scan of all would take."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16)) * 3
    v = np.repeat(centers, 100, axis=0) + rng.normal(size=(800, 16)) * 0.02
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v.astype(np.float32))]
    from pyspark.sql import functions as F

    base = frame(spark, rows).select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    old = hard_negatives.PART
    hard_negatives.PART = (16, 16)
    try:
        index = hard_negatives.build_index(base)
    finally:
        hard_negatives.PART = old
    assert len(index.rings) > 8 and index.rings[:, 4].sum() == 800
    slots = F.expr("array(named_struct('slot', 0, 'lo', double('-inf'), 'hi', double('inf'), 'kth', double(6000000)))")
    met = hard_negatives._visits(base.where("row % 10 = 0").select("row", "label", "v", slots.alias("slots")), index, 0, 1 << 40)
    assert 0 < met.count() < 80 * index.rings[:, 5].sum() / 2


def plain_codebooks(rows, entries=16):
    kept = sorted((r for r in rows if fits(r[1])), key=lambda r: (r[0] is None, r[0] or 0, [float(x) for x in r[1]]))
    width = max((len(r[1]) for r in kept), default=0)
    z = [[int(np.floor(float(x) * 4096)) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cuts = [i * width // 8 for i in range(9)]
    books, codes, errors = [], [[] for _ in kept], [0] * len(kept)
    for p in range(8):
        parts = [tuple(x[cuts[p] : cuts[p + 1]]) for x in z]
        book = [list(x) for x in parts[:entries]]
        for again in range(7):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in parts]
            if again < 6:
                groups = defaultdict(list)
                for (_, k), x in zip(near, parts):
                    groups[k].append(x)
                for k, found in groups.items():
                    book[k] = [sum(c) // len(found) for c in zip(*found)]
        for i, (d, k) in enumerate(near):
            codes[i].append(f"{k:02x}")
            errors[i] += d
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = defaultdict(int)
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    return [(r[0], "".join(c), e, by_label[r[2]], digest) for r, c, e in zip(kept, codes, errors)]


@pytest.mark.parametrize("n", [0, 3, 260])
def test_codebooks(spark, n):
    rows = [r for r in drawn(3) if r[0] not in (266, 300)][:n] if n < 260 else [r for r in drawn(3) if r[0] != 300]
    got = [tuple(r) for r in codebooks.coded_vectors(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_codebooks(rows), key=str)


def test_codebooks_of_large_numbers(spark):
    rows = [(i, [float(x)] * 8, 1) for i, x in enumerate([3e38, -3e38, 1e12, 1.0, 2e5, 1e30] * 4)]
    got = codebooks.coded_vectors(frame(spark, rows)).collect()
    assert len(got) == 24 and all(len(r.code) == 16 and r.error >= 0 for r in got)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_vectors.linked_vectors(none).count() == 0 and hard_negatives.hard_negatives(none).count() == 0
    odd = frame(spark, [(0, None, 1), (100, [], 1), (200, [], 2)])
    assert {(r.vec_id, r.n_links, r.kept) for r in near_vectors.linked_vectors(odd).collect()} == {(0, 0, True), (100, 0, True), (200, 0, True)}
    assert hard_negatives.hard_negatives(odd).count() == 0
