"""Toxicity by a learnt lexicon, Levenshtein automata over its trie, and context windows."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, stage

#: Labelled rows that the lexicon and the classifier are fitted on, at most.
SAMPLE = 12_000
#: Shortest term of the lexicon, and shortest and longest stem.
SHORTEST, STEMS = 2, (4, 8)
TOKEN = re.compile(r"[\w@$]+")
#: Words before a term that show it is mentioned, and words near it that address someone.
MENTION = frozenset("word words term terms called said says quote quoted quotes insult insults mot terme dit wort wörter sagte nannte palabra término dijo".split())
ADDRESS = frozenset("you your yours youre u ur du dich dir dein tu vous toi ton eres tú usted".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: Quotations of up to 120 characters, in which terms are not learnt, as they don't count there.
SPEECH = "|".join(rf"{a}[^{b}\n]{{1,120}}{b}" for a, b in QUOTES.items())
#: Characters that stand for letters in words that are to pass a filter.
LOOKALIKE = {"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"}
WINDOW = 6
#: Features of a text, and which of them counts quoted terms.
FEATURES, QUOTED = 8, 4


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that labels are never learnt from. A null key is not held out (and has no label)."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


class Automaton:
    """All words within a term's edits of a term (or, for stems, that begin so): Levenshtein automata intersected with
    the trie of the terms, made deterministic as words need it.

    A state is a set of (trie node, edits so far). Terms shorter than 5 allow no edit, others one, from 9 on two.
    match() gives (term, edits) of the best match, or None.
    """

    DEAD = -1

    def __init__(self, terms: list[tuple[str, bool]], states: int = 200_000):
        self.limit = states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]
        self.most = [0]
        self.terms = terms
        for t, (term, stem) in enumerate(terms):
            allowed = self.edits(term)
            at = 0
            for c in term:
                self.most[at] = max(self.most[at], allowed)
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                at = nxt
            self.most[at] = max(self.most[at], allowed)
            self.ends[at] = (t, stem)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.at_end: list[tuple[int, int] | None] = []
        self.at_once: list[tuple[int, int] | None] = []
        self.start = self.add({0: 0})

    def add(self, found: dict[int, int]) -> int:
        todo = list(found.items())
        while todo:  # a character of the term that the word lacks
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and found.get(child, 9) > edits + 1:
                    found[child] = edits + 1
                    todo.append((child, edits + 1))
        if not found:
            return self.DEAD
        key = tuple(sorted(found.items()))
        known = self.ids.get(key)
        if known is None:
            known = self.ids[key] = len(self.sets)
            self.sets.append(found)
            self.moves.append({})
            ends = [(e, self.ends[n][0], self.ends[n][1]) for n, e in found.items() if self.ends[n] and e <= self.cap(n)]
            self.at_end.append(min(((e, t) for e, t, _ in ends), default=None))
            self.at_once.append(min(((e, t) for e, t, stem in ends if stem), default=None))
        return known

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def cap(self, node: int) -> int:
        return self.edits(self.terms[self.ends[node][0]][0])

    def move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            for a, child in self.children[node].items():
                e = edits + (a != c)
                if e <= self.most[child] and out.get(child, 9) > e:
                    out[child] = e
            if edits + 1 <= self.most[node] and out.get(node, 9) > edits + 1:
                out[node] = edits + 1
        nxt = self.moves[state][c] = self.add(out)
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > self.limit:
            self.reset()
        state, best = self.start, None
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.move(state, c)
            if nxt == self.DEAD:
                break
            state = nxt
            if self.at_once[state] and (best is None or self.at_once[state] < best):
                best = self.at_once[state]
        else:
            if self.at_end[state] and (best is None or self.at_end[state] < best):
                best = self.at_end[state]
        return best and (best[1], best[0])


class Scorer:
    """Features of a text: what terms it has, how misspelt, and whether they are quoted or aimed at someone.

    A term is quoted where a word of mention comes shortly before it, or where it stands between quotation marks; what is
    quoted counts for nothing else. Words of `ordinary` are terms only as they are, never as misspellings."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], ordinary: frozenset[str] = frozenset()):
        self.weights = [w for _, _, w in lexicon]
        self.stems = [s for _, s, _ in lexicon]
        self.automaton = Automaton([(t, s) for t, s, _ in lexicon])
        self.ordinary = ordinary
        self.seen: dict[str, tuple[int, int] | None] = {}

    def matches(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """(term, edits) of each word that is a term, or a misspelling of one that isn't ordinary."""
        seen, found = self.seen, {}
        for w in words:
            if w in seen:
                m = seen[w]
            else:
                if len(seen) > 200_000:
                    seen.clear()
                m = self.automaton.match(w)
                if m is not None and m[1] and w in self.ordinary:
                    m = None
                seen[w] = m
            if m is not None:
                found[w] = m
        return found

    def features(self, text: str) -> list[float]:
        text = text.lower()
        words = TOKEN.findall(text)
        found = self.matches(set(words))
        if not found:
            return [0.0] * FEATURES
        kinds = [0.0] * 4  # whole words, stems, words with one edit, with two
        quoted = aimed = strongest = 0.0
        for i, token in enumerate(TOKEN.finditer(text)):
            m = found.get(token[0])
            if m is None:
                continue
            term, edits = m
            if any(x in MENTION for x in words[max(0, i - WINDOW) : i]) or self.in_quotes(text, token.start(), token.end()):
                quoted += 1
                continue
            kinds[edits + 1 if edits else int(self.stems[term])] += 1
            aimed += any(x in ADDRESS for x in words[max(0, i - WINDOW) : i + WINDOW + 1])
            strongest = max(strongest, self.weights[term] * 0.8**edits)
        log = math.log1p
        return [*map(log, kinds), log(quoted), log(aimed), strongest, 100.0 * sum(kinds) / (len(words) + 20)]

    @staticmethod
    def in_quotes(text: str, start: int, end: int, reach: int = 60) -> bool:
        """Whether a quotation mark is open shortly before and closes shortly after."""
        before, after = text[max(0, start - reach) : start], text[end : end + reach]
        return any((before.count(a) % 2 == 1 if a == b else before.rfind(a) > before.rfind(b)) and b in after for a, b in QUOTES.items())

    def misspell(self, text: str) -> str:
        """The text in small letters, each term that allows edits misspelt by one (or two) of them: a lookalike for a letter, else a letter less."""
        text = text.lower()
        found = self.matches(set(TOKEN.findall(text)))

        def change(m: re.Match) -> str:
            w = m[0]
            if w not in found or found[w][1]:
                return w
            term = self.automaton.terms[found[w][0]][0]
            for turn in range(min(Automaton.edits(term), 1 + (zlib.crc32(w.encode()) + m.start()) % 2)):
                at = 1 + (zlib.crc32(w.encode()) + 7 * m.start() + turn) % (min(len(term), len(w)) - 2)
                w = w[:at] + LOOKALIKE.get(w[at], "") + w[at + 1 :]
            return w

        return TOKEN.sub(change, text)


def learn_lexicon(train: DataFrame, support: float = 0.02, ratio: float = 20.0) -> list[tuple[str, bool, float]]:
    """Terms (term, is a stem, log odds) from rows (text, y) by the share of toxic and of other texts that have them.

    A term is in at least `support` of the toxic texts and `ratio` times more often than in others; quotations are left out. A stem of 4 to 8
    characters stands for its words where it is in 1.5 times more toxic texts than any of them; of stems with as many texts
    the longest counts. The driver gets the terms with the support: at most the words and stems of a text over the support.
    """
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return []
    numbered = train.withColumn("i", F.monotonically_increasing_id()).withColumn("text", F.regexp_replace("text", SPEECH, " "))
    words = numbered.select("i", "y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_@$]+"), F.lit(0)))).alias("w")).where(F.length("w") >= SHORTEST)
    terms = words.select("i", "y", F.explode(F.concat(F.array(F.struct(F.col("w").alias("t"), F.lit(False).alias("stem"))), F.transform(F.when(F.length("w") > STEMS[0], F.sequence(F.lit(STEMS[0]), F.least(F.length("w") - 1, F.lit(STEMS[1])))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.substring("w", F.lit(1), k).alias("t"), F.lit(True).alias("stem"))))).alias("t")).select("i", "y", "t.t", "t.stem").distinct()
    positive = terms.where("y = 1").groupBy("t", "stem").agg(F.count("*").alias("p")).where(F.col("p") >= max(3.0, support * pos))
    common = stage(positive, "toxic-terms")
    # Terms with the support: their number is bounded by texts' length over the support.
    counts = terms.where("y = 0").join(common, ["t", "stem"], "left_semi").groupBy("t", "stem").agg(F.count("*").alias("q"))
    rows = common.join(counts, ["t", "stem"], "left").select("t", "stem", "p", F.coalesce("q", F.lit(0)).alias("q")).collect()
    odd = {(r["t"], r["stem"]): (r["p"], math.log((r["p"] + 0.5) / (pos + 1)) - math.log((r["q"] + 0.5) / (neg + 1))) for r in rows}
    strong = {k: v for k, v in odd.items() if v[1] >= math.log(ratio)}
    whole = {t: p for (t, stem), (p, _) in strong.items() if not stem}
    stems = []
    for (t, stem), (p, _) in strong.items():
        if stem and p >= 1.5 * max((q for w, q in whole.items() if w.startswith(t)), default=0) and not any(s and len(u) > len(t) and u.startswith(t) and q >= 0.95 * p for (u, s), (q, _) in strong.items()):
            stems.append(t)
    stems = [t for t in stems if not any(u != t and t.startswith(u) for u in stems)]
    kept = [(t, True) for t in stems] + [(t, False) for t in whole if not any(t.startswith(s) for s in stems)]
    kept.sort(key=lambda k: (-strong[k][0], k))
    return [(t, stem, strong[t, stem][1]) for t, stem in kept]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, free: tuple[int, ...] = (QUOTED,)) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant. More of a feature never lowers the score, but
    for those of `free`: others that would have a weight below 0 are left out one by one, the lowest first."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = list(range(x.shape[1]))
    while True:
        part, w = x[:, keep], np.zeros(len(keep))
        penalty = np.diag([*[ridge] * (len(keep) - 1), 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -35, 35)))
            step = np.linalg.solve(part.T @ (part * (p * (1 - p))[:, None]) + penalty, part.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        below = [(v, k) for v, k in zip(w[:-1], keep) if v < 0 and k not in free]
        if not below:
            out = np.zeros(x.shape[1])
            out[keep] = w
            return out
        keep.remove(min(below)[1])


def ordinary_words(rows: DataFrame, lexicon: list[tuple[str, bool, float]], ratio: float = 20.0) -> frozenset[str]:
    """Words of rows (text, y) that the automaton takes for misspellings but that other texts have too: all of them but those
    that are `ratio` times more often in toxic texts. Their number is bounded by the words of the rows."""

    def variants(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)

        def told():
            for batch in found:
                for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for w, (_, edits) in scorer.matches(set(TOKEN.findall(t.lower()))).items():
                        if edits:
                            yield len(w) + 8, (w, y)

        yield from batches(told(), pa.schema([("w", pa.string()), ("y", pa.int32())]))

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    odds = ratio * (n.get(1, 0) + 1) / (n.get(0, 0) + 1)
    counts = rows.select("text", "y").mapInArrow(variants, "w string, y int").groupBy("w").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    return frozenset(r["w"] for r in counts.where((F.col("n") > F.col("p")) & (F.col("p") + 0.5 < odds * (F.col("n") - F.col("p") + 0.5))).collect())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[list, frozenset, list[float]]:
    """Lexicon, ordinary words and weights from at most `sample` labelled rows that aren't held out (the first by a hash of
    the key; of rows that repeat a key, the least text). Rows without a key or a label don't count. Without labels of both
    kinds the weights give the smoothed share of label 1.

    The ordinary words are those of one half of the rows, and the weights are fitted on the other half, so that they see
    how often a word that is new is taken for a misspelling by chance. Toxic rows count a second time with their terms
    misspelt, as labelled rows have few misspellings."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key")))
    chosen = named.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(sample)
    there = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")  # at most `sample` numbers
    rows = stage(there.groupBy("key").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y", (F.crc32(F.xxhash64("key").cast("string")) % 2).alias("half")), "toxic-train")
    lexicon = learn_lexicon(rows.select("text", "y"))
    ordinary = ordinary_words(rows.where("half = 0"), lexicon)

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, ordinary)
        for batch in found:
            texts, labelled = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [(scorer.features(t), y) for t, y in zip(texts, labelled)]
            got += [(scorer.features(scorer.misspell(t)), 1) for t, y in zip(texts, labelled) if y]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.list_(pa.float64())), pa.array([y for _, y in got], pa.int32())], names=["x", "y"])

    seen = rows.where("half = 1").select("text", "y").mapInArrow(count, "x array<double>, y int").collect()  # at most twice `sample`
    y = np.array([r["y"] for r in seen], float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 2)  # a quarter without labels
        return lexicon, ordinary, [*[0.0] * FEATURES, math.log(share / (1 - share))]
    return lexicon, ordinary, fit(np.array([r["x"] for r in seen]), y).tolist()


SCORES = pa.schema([("key", pa.int64()), ("score", pa.float64())])


def toxic_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """key, held_out, score (0 to 1) and predicted for every row, from its whole text alone.

    Null texts count as empty; a text without a term of the lexicon has the classifier's constant; repeated rows and
    equal texts have equal scores; very long texts are scored whole, one at a time; other columns, also of clashing names,
    are ignored; an empty table gives no rows. Scoring has no shuffle.
    """
    lexicon, ordinary, weights = train(docs, labels, key, text, label, sample)

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, ordinary)

        def rows():
            for batch in found:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = scorer.features(t.as_py() or "")
                    z = sum(a * b for a, b in zip(x, weights)) + weights[-1]
                    yield 16, (k, 1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))

        yield from batches(rows(), SCORES)

    made = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(score, "key long, score double")
    return made.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows that score under 0.5, with all their columns: filtered batch by batch, without a shuffle. Null and empty
    texts, null or repeated keys, very long texts and empty tables are as in toxic_scores(): no row is lost but by score."""
    lexicon, ordinary, weights = train(docs, labels, key, text, label, sample)

    def keep(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, ordinary)
        for batch in found:
            texts = batch.column(batch.schema.names.index(text))
            clean = [sum(a * b for a, b in zip(scorer.features(t.as_py() or ""), weights)) + weights[-1] < 0 for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
