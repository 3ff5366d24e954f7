"""Chat, personal data, similarity join, repeated strings, toxicity and the pipeline against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from junctura.llm import chat, common, ngram_join, pii, queries, suffix_array, suffix_dedup, toxicity
from junctura.llm.components import components


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, "y") for i, t in rows], "doc_id long, text string, lang string, n int, cid string").repartition(3)


# chat

CONVERSATIONS = [(1, 0, "system", "be <s>kind</s>"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", "<\\s> <\\\\/s> [\\INST]"), (1, 4, "assistant", "<|turn|>user<|text|>"), (None, 0, "user", "a"), (None, None, None, "b"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]


def test_chat_reads_back(spark):
    frame = spark.createDataFrame([(*r, "z") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, seq string").repartition(2)
    long = spark.range(300).selectExpr("5L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame.drop("seq").unionByName(long))).collect()}
    rows = CONVERSATIONS + [(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    for conv in (1, 2, 5, None):
        turns = sorted(((r[1] if r[1] is not None else -1), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.rewrote) == (len(turns), len(loss), 0)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.marked([(a, t) for _, a, t in turns]))
    assert chat.format_turns(frame.where("false")).count() == 0


def test_chat_query(spark, sf):
    """The registered query over the whole table and conversation -1, against plain digests."""
    turns = defaultdict(list)
    for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    expect = {}
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for _, role, t in rows)
        expect[conv] = (len(rows), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.marked([(role, t) for _, role, t in rows])))
    got = queries.op2_chat(spark, sf).collect()
    assert len(got) == len(expect)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == expect


def test_chat_escapes_and_spans():
    for text in [t or "" for *_, t in CONVERSATIONS] + ["<" * 5 + "s>", "[\\\\INST]", "plain"]:
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    turns = [("user", f"text {i}") for i in range(100)]
    spans = list(chat.render(turns, chat.marked, history=4))
    out = chat.marked(turns)
    for (piece, start, head, tail, rewrote), (_, text) in zip(spans, turns):
        assert rewrote == 0 and out[start : start + len(piece)] == piece and piece[head : len(piece) - tail] == text
    last_only = lambda ts: "".join(f"{r}:{t if i == len(ts) - 1 else '...'}\n" for i, (r, t) in enumerate(ts))
    assert any(s[4] for s in chat.render(turns, last_only))


TEMPLATES = {
    "late rewrite": lambda turns: "".join(f"{r}:{'cut' if i == 0 and len(turns) > 80 else t}\n" for i, (r, t) in enumerate(turns)),
    "numbered": lambda turns: "".join(f"{i} {r}:{t}\n" for i, (r, t) in enumerate(turns)),
    "first again": lambda turns: "".join(f"({turns[0][1]}) {r}:{t}\n" for r, t in turns),
}


@pytest.mark.parametrize("template", sorted(TEMPLATES))
def test_chat_of_long_conversations(spark, template):
    name, template = template, TEMPLATES[template]
    turns = [("user", f"text {i}") for i in range(150)]
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    got = sorted(chat.format_turns(frame, template).collect(), key=lambda r: r.seq)
    out = ""
    for i, r in enumerate(got):
        now = template(turns[: i + 1])
        kept = next((k for k, (a, b) in enumerate(zip(out, now)) if a != b), min(len(out), len(now)))
        assert (r.start, r.piece, r.rewrote) == (kept, now[kept:], len(out) - kept)
        out = out[: r.start] + r.piece
    assert out == template(turns) and len(got) == 150
    assert [r.seq for r in got if r.rewrote] == ([80] if name == "late rewrite" else [])


# personal data

TEXTS = ["mail a.b@c.de, x@y, _a@b.c_d@e.f.g. a@@b.c", "ip 1.2.3.4.5 and 300.1.1.1 0001.2.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 5500005555555559", "call +1 (262) 555-3752! +12 or +49 30 1234567890123456", "tel 262-555-3752 ok", "", "é@é.com ü+1 234 567 8901", "user [at] host [dot] com"]


def base(t):
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 14 <= len(g) <= 19 and luhn(g):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_personal_spans(spark, sf):
    small = documents(spark, [*enumerate(TEXTS), (90, None), (None, "a@b.co")])
    for rows, got in (([(r.doc_id, r.text or "") for r in small.collect()], pii.personal_spans(small)), ([(r.doc_id, r.text or "") for r in common.table(spark, sf, "documents").collect()], queries.op6_pii(spark, sf))):
        expect = {i: base(t) for i, t in rows}
        found = got.collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.base_sha256 == hashlib.sha256(shown(expect[r.doc_id]).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in expect[r.doc_id]) for i in range(4)]
            assert set(filter(None, shown(expect[r.doc_id]).split(","))) <= set(r.spans.split(","))
    assert pii.personal_spans(small.where("false")).count() == 0


def test_added_spans(spark, sf):
    """Planted spans that the strict rules miss are found, decoys that look like them are not; and the tables have some."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("aeilnorst"), int(rng.integers(2, 9))))
    number = lambda n: "".join(map(str, rng.integers(1, 10, n)))
    card = lambda: next(x for x in iter(lambda: "4" + number(15), None) if pii.luhn(x))
    phone = lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}"
    key = lambda n, letters="abcdef": "".join(rng.choice(list(letters + "0123456789"), n))
    plant = {
        "phone": lambda: ("", phone(), f" {card()}"), "phone ": lambda: ("tel ", phone()[3:], ""), "card": lambda: (f"{phone()} ", card(), ""),
        "secret": lambda: ("password=", key(20), ""), "secret ": lambda: ("", "AKIA" + key(16, "QRSTUVWXYZ"), ""), "person": lambda: ("signed ", "Anna Keller", ""),
        "address": lambda: ("lives at ", f"{rng.integers(1, 99)} Baker Street", ", London"), "email": lambda: ("mail ", "a.b (at) host (dot) com", ""),
    }
    decoys = [lambda: next(x for x in iter(lambda: number(16), None) if not pii.luhn(x)), lambda: "The Street", lambda: "release-notes-of-2024-spring", lambda: f"version {number(1)}.{number(1)}.{number(1)}.999", lambda: phone(), lambda: f"{word()}@example.org", lambda: card()]
    rows, expect = [], {}
    for i in range(400):
        before, after = " ".join(word() for _ in range(10)) + " ", " " + " ".join(word() for _ in range(10))
        kind, make = list(plant.items())[i % 8]
        left, span, right = make() if i < 240 else ("", decoys[i % 7](), "")
        rows.append((i, before + left + span + right + after))
        at = len(before + left)
        expect[i] = {f"{kind.strip()}:{at}:{at + len(span)}"} if i < 240 else set()
        if i < 240 and kind == "phone":  # the number beside it counts too
            expect[i].add(f"card:{at + len(span) + 1}:{at + len(span) + 17}")
        if i < 240 and kind == "card":
            expect[i].add(f"phone:{len(before)}:{at - 1}")
    got = {r.doc_id: set(filter(None, r.spans.split(","))) - {shown([x]) for x in base(rows[r.doc_id][1])} for r in pii.personal_spans(documents(spark, rows)).collect()}
    hits = sum(len(got[i] & expect[i]) for i in expect)
    assert hits >= 0.95 * sum(map(len, expect.values())) and hits >= 0.95 * sum(map(len, got.values()))
    table = queries.op6_pii(spark, sf.replace("0.001", "0.01")).collect()
    assert sum(len(list(filter(None, r.spans.split(",")))) - r.n_email - r.n_ip - r.n_card - r.n_phone for r in table) >= 10


def test_labelers_agree_and_mask(spark):
    pattern = lambda kind, *v: 9 * (int("".join(map(str, [0] + [x + 1 for x in v])), 3) + 3**5 * kind)
    counts = {pattern(3, 1, 1, 1, 1, 1): 500, pattern(3, 1, 1, 1, 0, 1): 400, pattern(3, -1, 1, 0, 1, 1): 200, pattern(3, -1, -1, 0, -1, -1): 600, pattern(3, -1, 1, 0, -1, -1): 200}
    scores = pii.span_classifier(counts)
    assert scores[pattern(3, 1, 1, 1, 0, 1)] > 0.9 > 0.1 > scores[pattern(3, -1, -1, 0, -1, -1)] and pii.span_classifier({}) == {}
    assert pii.ballots(pattern(2, 1, 0, -1, 1, 0)) == (2, [1, 0, -1, 1, 0])
    got = {r.doc_id: r.text for r in pii.mask(documents(spark, [(1, "to a@b.co now"), (2, None), (3, "none")])).collect()}
    assert got == {1: "to [EMAIL] now", 2: None, 3: "none"}


# similarity join


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for i, s in enumerate(sets):
        for other in {j for x in s for j in where[x]}:
            o = len(s & sets[other])
            if 100 * o >= 80 * (len(s) + len(sets[other]) - o):
                parent[find(i)] = find(other)
        for x in s:
            where[x].add(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)}


def near_copies(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    common_line = [word() for _ in range(30)]
    bases = [[word() for _ in range(int(rng.integers(20, 120)))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(bases[int(rng.integers(6))])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = word()
        rows.append((i, " ".join(w + common_line * int(rng.integers(2)))))
    return rows + [(n, "one two"), (n + 1, "ONE  two"), (n + 2, ""), (n + 3, None), (n + 4, "a b c d e"), (n + 5, "b c d e a")]


def test_join(spark, sf):
    rows = near_copies(1, 240)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(spark, rows)).collect()}
    assert got == brute_components(rows)
    cut = ngram_join.similar_documents(documents(spark, rows), block=3)  # large buckets, and classes of many pairs
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in cut.collect()} == brute_components(rows)
    table = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, sf).collect()} == brute_components(table)


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(12)
    for n in (1, 5, 9, 100, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for kept in (0, n // 2, n):
            b = np.unique(np.concatenate([a[:kept], rng.integers(0, 1 << 63, int(n * 0.7) + 1).astype(np.uint64)]))
            assert ngram_join.most_common(ngram_join.sketch(a), ngram_join.sketch(b)) >= len(np.intersect1d(a, b))
    assert ngram_join.sketch(np.arange(40, dtype=np.uint64)) is None and ngram_join.most_common(None, b"") == np.inf


def test_join_edges(spark):
    rows = [(None, "p q r s t u v"), (3, "p q r s t u v"), (3, "p q r s t u v"), (5, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(spark, rows)).collect())
    assert got == [("3", 3, 3), ("3", 3, 3), ("5", 0, 5), ("None", 3, 3)]
    assert ngram_join.similar_documents(documents(spark, rows).where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# repeated strings


def brute_removed(rows, width=200):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + width] for _, b in texts for i in range(len(b) - width + 1))
    out = []
    for k, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((str(k), len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_removed(spark, sf):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    shared, shorter = text(400), text(195)
    rows = [(i, text(int(rng.integers(0, 300))) + (shared[int(rng.integers(150)) :] if i % 3 == 0 else shorter) + text(200)) for i in range(30)]
    rows += [(40, "ab" * 400), (41, "a" * 900), (42, "a" * 150), (43, None), (44, ""), (45, shared + text(50) + shared), (46, rows[0][1]), (46, rows[0][1]), (None, text(50)), (47, "é" * 99), (48, "é" * 99)]
    cut = lambda got: sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert cut(suffix_dedup.removed_repeats(documents(spark, rows))) == brute_removed(rows)
    table = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    assert cut(queries.op8_suffix_dedup(spark, sf)) == brute_removed(table)
    assert suffix_dedup.removed_repeats(documents(spark, rows).where("false")).count() == 0


def test_removed_from_very_long_texts(spark):
    """Texts over a stretch (1 MiB), with repeats inside and across, beside a passage that all others have."""
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghijkl "), 1_200_000))
    passage = "".join(rng.choice(list("abcdefghijkl "), 600))
    rows = [(1, long), (2, long[1_048_000:1_049_500] + " end"), (3, long[:250] + passage)] + [(i, f"{i} " * 40 + passage + f" {i * i}" * 40) for i in range(10, 40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed_repeats(documents(spark, rows)).collect()}
    assert got[1] == (1_200_000, 1750, 2) and got[2][1] == 1500 and got[3][1] == 850
    expect = {int(k): (n, gone, runs) for k, n, gone, runs, _ in brute_removed(rows[3:] + [(3, rows[2][1])])}
    assert all(got[i] == expect[i] for i in range(10, 40))


@pytest.mark.parametrize("shard", [300, 2_000, 20_000])
def test_removed_where_anchors_exceed_a_shard(spark, shard):
    """A passage that many texts have among words of their own, some of which are shared by a few, and one text twice."""
    rng = np.random.default_rng(10)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, few = text(260), text(40)
    rows = [(i, text(int(rng.integers(30, 250))) + (few if i % 7 == 0 else "") + passage[: 260 - i % 3 * 20] + (few[: i % 30] if i % 5 == 0 else "") + text(int(rng.integers(0, 250)))) for i in range(150)]
    rows += [(200, passage + text(60) + passage), (201, "ab" * 300), (202, "ab" * 200 + text(20)), (203, rows[0][1]), (203, rows[0][1]), (None, None), (204, "")]
    rows += [(i, text(60) + rows[i][1][100:]) for i in range(20, 40)]
    cut = lambda got: sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert cut(suffix_dedup.removed_repeats(documents(spark, rows), shard=shard)) == brute_removed(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for _ in range(200):
        data = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 70))).astype(np.uint8)
        b = data.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array.suffix_array(data).tolist() == order
        common_ = suffix_array.common_prefixes(data, np.array(order), 24)
        for a, c in zip(order, order[1:]):
            n = next((k for k, (x, y) in enumerate(zip(b[a:], b[c:])) if x != y), min(len(b) - a, len(b) - c))
            assert common_[c] == min(n, 24)


def test_suffix_arrays_recurse():
    """Strings whose names repeat at many levels, long runs, and integers over a large alphabet."""
    a, b = b"b", b"ab"
    while len(b) < 3000:
        a, b = b, b + a
    rng = np.random.default_rng(12)
    phrases = [rng.integers(97, 100, 40).astype(np.uint8).tobytes() for _ in range(4)]
    mixed = b"".join(phrases[i] for i in rng.integers(0, 4, 80))
    for data in (b, b[::-1], mixed, b"a" * 2000 + b"b" + b"a" * 1999, b"abcab" * 500, bytes(range(255, -1, -1)) * 8):
        got = suffix_array.suffix_array(np.frombuffer(data, np.uint8))
        assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    for most in (2, 30, 1500):
        names = rng.integers(0, most, 1500).astype(np.int32)
        listed = names.tolist()
        assert suffix_array.suffix_array(names).tolist() == sorted(range(1500), key=lambda i: listed[i:])
    values = rng.integers(0, 1 << 20, 10_000).astype(np.int32) // 50
    assert (suffix_array.stable_order(values) == np.argsort(values, kind="stable")).all()


# toxicity


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["abba", "abcab", "cabbage", "bacbacbac"]
    auto = toxicity.Automaton([(t, False) for t in terms])
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcg"), int(rng.integers(1, 12)))) for _ in range(3000)] + terms
    for w in words:
        fits = [(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        assert auto.match(w) == (min(fits)[::-1] if fits else None)
    assert toxicity.Automaton([("lowei", True)]).match("loweichaft") == (0, 0)


def test_toxicity_held_out(spark, sf):
    docs, labels = common.table(spark, sf.replace("0.001", "0.01"), "documents"), common.table(spark, sf.replace("0.001", "0.01"), "labels")
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.9
    kept = {r.doc_id for r in toxicity.reject(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if r.predicted == 0}


def test_toxicity_of_misspelt_and_quoted_terms(spark):
    rng = np.random.default_rng(21)
    plain = ["".join(rng.choice(list("abcdeilnorst"), int(rng.integers(2, 9)))) for _ in range(400)] + ["loner", "moral"]
    terms = ["moron", "loser", "disgusting", "trash"]
    text = lambda some: " ".join(rng.permutation([*rng.choice(plain, 40), *some]))
    rows = [(i, text(rng.choice(terms, 3)) if i % 3 == 0 else text(["loner", "moral"] if i % 3 == 1 else [])) for i in range(600)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    lexicon, ordinary, weights = toxicity.train(docs, labels)
    assert {t for t, stem, _ in lexicon if not stem} >= {"moron", "loser"} and "loner" in ordinary
    assert all(w >= 0 for i, w in enumerate(weights[:-1]) if i != toxicity.QUOTED)
    ask = {1: "you m0ron and l0ser, disgust1ng tr@sh", 2: 'they wrote "moron" and "loser" and the word trash', 3: "you moron, loser", 4: "the loner has a moral", 5: "moron " * 300_000}
    got = {r.doc_id: r.predicted for r in toxicity.toxic_scores(documents(spark, [*ask.items(), *((1000 + i, t) for i, t in rows)]), spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")).collect()}
    assert [got[i] for i in range(1, 6)] == [1, 0, 1, 0, 1]
    scorer = toxicity.Scorer(lexicon, ordinary)
    assert scorer.features(ask[1])[2] > 0 and scorer.features(ask[2])[toxicity.QUOTED] > 0 and not any(scorer.features(ask[2])[:4])
    assert scorer.misspell("a Moron") != "a moron" and scorer.features(scorer.misspell("a Moron"))[2] > 0


def area(pairs):
    """The share of pairs of a toxic and another row in which the toxic one scores higher."""
    toxic, other = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in toxic for b in other) / (len(toxic) * len(other))


def test_toxicity_finds_toxic_rows(spark, sf):
    """Recall and the area under the curve, which scores that never call a row toxic fail."""
    docs, labels = common.table(spark, sf.replace("0.001", "0.01"), "documents"), common.table(spark, sf.replace("0.001", "0.01"), "labels")
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, labels).collect()}
    known = [(got[r.doc_id], r.toxic) for r in labels.where("toxic is not null").collect()]
    held = [(r.score, y) for r, y in known if r.held_out]
    caught = [r.predicted for r, y in known if y == 1]
    assert area(held) >= 0.8 and sum(r.predicted for r, y in known if r.held_out and y == 1) >= 0.5 * sum(y for _, y in held)
    assert sum(caught) >= 0.7 * len(caught) and sum(r.predicted for r, y in known if y == 0) <= 0.05 * len(known)
    assert area([(0.0, y) for _, y in held]) == 0.5


def test_toxicity_of_planted_rows(spark):
    """Two in three rows with terms are toxic; in the others the terms are quoted. Both kinds are told apart on new rows."""
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdeilnorst"), int(rng.integers(2, 9)))) for _ in range(500)]
    terms = ["moron", "loser", "disgusting", "trash", "idiot"]

    def text(kind):
        words = rng.choice(plain, 40).tolist()
        for t in rng.choice(terms, 3):
            words.insert(int(rng.integers(len(words))), t if kind == 1 else f'they said "{t}" there')
        return " ".join(words if kind else words[:40])

    kinds = [(1, 2, 0, 1, 0, 0)[i % 6] for i in range(900)]
    rows = [(i, text(k) if k else " ".join(rng.choice(plain, 40))) for i, k in enumerate(kinds)]
    labels = spark.createDataFrame([(i, int(k == 1)) for i, k in enumerate(kinds)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_scores(documents(spark, rows), labels).collect()}
    held = [(got[i], k) for i, k in enumerate(kinds) if got[i].held_out]
    recall = lambda kind, want: sum(r.predicted == want for r, k in held if k == kind) / sum(k == kind for _, k in held)
    assert recall(1, 1) >= 0.95 and recall(2, 0) >= 0.95 and recall(0, 0) >= 0.98
    assert area([(r.score, int(k == 1)) for r, k in held]) >= 0.97


def test_toxicity_edges(spark):
    assert toxicity.reject(documents(spark, [(1, None), (None, "x"), (None, "x")]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 3
    rows = documents(spark, [(1, None), (2, ""), (None, "x"), (2, "")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxic_scores(rows, none).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxic_scores(rows.where("false"), none).count() == 0


# pipeline


def test_pipeline(spark, sf):
    docs = common.table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "packing"]
    held = {"documents": docs}
    for name, work in corpus_pipeline.STAGES:
        last = list(held.values())[-1]
        held[name] = common.stage(work(spark, last, sf), "test")
        if name != "packing":
            assert held[name].columns == docs.columns
    toxic = {r.doc_id for r in queries.op9_toxicity(spark, sf).where("predicted = 1").collect()}
    clean = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    assert sorted(r.doc_id for r in held["toxicity"].collect()) == sorted(k for k, _ in clean)
    groups = brute_components(clean)
    assert sorted(r.doc_id for r in held["ngram_join"].collect()) == sorted(k for k in groups if groups[k][1] == k)
    for r in held["pii"].collect():
        assert not base(r.text or "") and r.n_chars == len(r.text or "")
    often = Counter(r.doc_id for r in held["mixing"].collect())
    assert max(often.values()) <= 3
    pieces = Counter((r.doc_id, r.piece) for r in held["packing"].collect())
    assert {k for k, p in pieces if p == 0} == set(often) and all(n == often[k] for (k, _), n in pieces.items())


def test_pipeline_of_repeated_ids(spark, sf):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(1, text(1), "a"), (1, text(2), "a"), (1, text(2), "a"), (2, text(2), "b"), (3, text(3), "b"), (3, text(4), None), (None, text(5), "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.ngram_stage(spark, frame, sf).collect())
    assert kept == [(0, text(5)), (1, text(1)), (1, text(2)), (3, text(3)), (3, text(4))]
    got = Counter(corpus_pipeline.mixing_stage(spark, frame, sf).collect())
    there = Counter(frame.collect())
    assert got and all(there[r] and n <= 3 * there[r] for r, n in got.items())


def test_pipeline_keeps_every_column(spark, sf):
    """Columns with names of all sorts stay as they are, and rows that are a third of the table cost no task of their own."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(i, text(i), "ab"[i % 2], 777, "mine", 5, i, {"k": i}) for i in range(40)] + [(7, text(7), "b", 777, "mine", 5, 7, {"k": 7})] * 20
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _key string, `a.b` int, n long, row map<string,long>").repartition(5)
    for work, columns in ((corpus_pipeline.ngram_stage, frame.columns), (corpus_pipeline.mixing_stage, frame.columns)):
        got = work(spark, frame, sf)
        assert got.columns == columns
        held = [tuple(r) for r in got.collect()]
        assert all(r in rows for r in held)
        ids = Counter(r[0] for r in held)
        if work is corpus_pipeline.ngram_stage:
            assert ids == Counter(range(40))
        else:
            assert all(n <= (63 if i == 7 else 3) for i, n in ids.items())
    plan = corpus_pipeline.mixing_stage(spark, frame, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(key#" not in plan and "windowspecdefinition(_key#" not in plan


class Claims:
    """A template that says that it appends, whether it does or not."""

    appends = True

    def __init__(self, template):
        self.template = template

    def __call__(self, turns):
        return self.template(turns)


@pytest.mark.parametrize("template", sorted(TEMPLATES))
@pytest.mark.parametrize("n", [10, 64, 65, 150, 300])
def test_chat_holds_templates_to_their_word(template, n):
    template = TEMPLATES[template]
    turns = [("user", f"text {i}") for i in range(n)]
    assert list(chat.render(turns, Claims(template))) == list(chat.render(turns, template))
    joins = lambda ts: "".join(f"{r}:{t}\n" for r, t in ts)
    assert list(chat.render(turns, Claims(joins), 4)) == list(chat.render(turns, joins))
