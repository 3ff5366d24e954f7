"""Personal data in texts: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stage

#: Kinds of spans; the first BASE of them have strict rules whose spans stay whatever is learnt.
KINDS = ("email", "ip", "card", "phone", "secret", "person", "address")
BASE = 4
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_host = re.compile(r"@[A-Za-z0-9-]{2,}")
# A quad begins where a run of digits does; runs are taken whole. So no run is read twice.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser patterns. Each repetition is bounded, or ends at the first character that doesn't fit and isn't tried again.
_one_card = re.compile(r"(?<![0-9-])(?:[0-9]{14,16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9-])")
_one_phone = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_written_at = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,63} ?[\[(] ?(?:dot|punkt|point|punto) ?[\])] ?[A-Za-z]{2,24}")
_secret = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+")
_person = re.compile(r"(?<!\w)[A-ZÄÖÜÉÑ][a-zäöüßéèñáíóç]{1,20} [A-ZÄÖÜÉÑ][a-zäöüßéèñáíóç]{1,20}(?!\w)")
_address = re.compile(r"(?<!\w)(?:[0-9]{1,5} [A-Z][a-z]{2,20} (?:Street|Road|Avenue|Lane|Drive)|[A-ZÄÖÜ][a-zäöü]{2,20}(?:straße|strasse|weg|platz) [0-9]{1,4}|(?:rue|calle|avenue|avenida) [A-ZÉÁÑ][a-zéáñ]{2,20},? [0-9]{1,4})(?!\w)")
_digit = re.compile(r"[0-9]")
_before = re.compile(r"[^\W_]+")

#: Words shortly before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": frozenset("email mail e contact contacto kontakt courriel correo write reach address adresse".split()),
    "ip": frozenset("ip host server client from addr address adresse login logged".split()),
    "card": frozenset("card visa mastercard amex karte carte tarjeta credit kreditkarte payment cc".split()),
    "phone": frozenset("phone tel telefon telephone téléphone teléfono call mobile cell fax handy sms whatsapp".split()),
    "secret": frozenset("password passwd pwd passwort clave token secret key apikey bearer auth authorization credential credentials".split()),
    "person": frozenset("name named called mr mrs ms dr herr frau monsieur madame señor señora signed dear sincerely regards nombre nom".split()),
    "address": frozenset("address adresse dirección lives live home at street wohnt habite vive".split()),
}
AGAINST = frozenset("version v ver section chapter isbn issn order invoice sha hash commit build release figure table id ref".split())
#: Gazetteers: top-level domains, country codes, prefixes of access keys, given names, places.
TOP_LEVEL = frozenset("com org net edu gov io de fr es uk eu info biz co us ca ch at be nl it example".split())
COUNTRY = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza", "eyJ")
GIVEN = frozenset("James Mary John Linda Robert Susan Michael Karen David Sarah Thomas Peter Paul Anna Emma Hans Klaus Jürgen Ursula Sabine Stefan Pierre Jean Marie Claire Sophie Luc Antoine José María Juan Carmen Carlos Lucía Miguel Pablo".split())
PLACES = frozenset("London Paris Berlin Madrid Rome Vienna Zurich Hamburg Munich München Köln Lyon Marseille Barcelona Sevilla Valencia Boston Chicago Seattle Dallas Denver Toronto Dublin Brussels Amsterdam".split())
LABELERS = 5
#: Classes of a span's length and of its characters, which the classifier sees beside the votes.
LENGTHS, CHARACTERS = 3, 3
#: What labelers' chances to vote in favour of true and of false spans start from, and as how many votes that counts: few
#: true spans fail what can be checked in them, and few false ones pass it.
BEFORE = ((0.8, 0.2, 2), (0.995, 0.1, 400), (0.8, 0.2, 2), (0.8, 0.2, 2), (0.8, 0.2, 2))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part reaches back from each @ as far as it can."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, valid): all that look like personal data; `valid` for those that the strict rules keep. Looser
    matches of a kind that a strict one of it overlaps are left out, as they are the same mention."""
    if "@" in text:
        strict = list(emails(text))
        for s, e in strict:
            yield "email", s, e, True
        for m in apart(_host.finditer(text), strict):
            if m.start() and text[m.start() - 1] in _local:
                s = m.start()
                while s > max(0, m.start() - 64) and text[s - 1] in _local:
                    s -= 1
                yield "email", s, m.end(), False
    if "at" in text and ("(" in text or "[" in text):
        for m in _written_at.finditer(text):
            yield "email", m.start(), m.end(), False
    if _digit.search(text):
        for m in _ip.finditer(text):
            yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        strict, failed = [], False
        for m in _card.finditer(text):
            if m.end() - m.start() >= 13:
                digits = re.sub("[ -]", "", m[0])
                if len(digits) >= 13:
                    valid = 14 <= len(digits) <= 19 and luhn(digits)
                    yield "card", m.start(), m.end(), valid
                    strict += [m.span()] * valid
                    failed |= not valid
        if failed:
            for m in apart(_one_card.finditer(text), strict):
                if luhn(re.sub("[ -]", "", m[0])):
                    yield "card", m.start(), m.end(), False
        strict = []
        if "+" in text:
            for m in _phone.finditer(text):
                valid = 10 <= sum(c.isdigit() for c in m[0]) <= 15
                yield "phone", m.start(), m.end(), valid
                strict += [m.span()] * valid
        for m in apart(_one_phone.finditer(text), strict):
            yield "phone", m.start(), m.end(), False
        for m in _secret.finditer(text):
            if _digit.search(m[0]) and not m[0].isdigit() and "//" not in m[0]:
                yield "secret", m.start(), m.end(), False
        for m in _address.finditer(text):
            yield "address", m.start(), m.end(), False
    for m in _person.finditer(text):
        if text[m.start() : m.end()].split(" ")[0] in GIVEN or said_before(text, m.start())[-1:] and said_before(text, m.start())[-1] in CUES["person"]:
            yield "person", m.start(), m.end(), False


def apart(found: Iterator[re.Match], spans: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches, in order, that overlap none of the spans, which are in order too."""
    at = 0
    for m in found:
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            yield m


def said_before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _before.findall(text[max(0, start - 32) : start])][-4:]


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Of each labeler 1 for personal data, -1 against, 0 for no opinion: the shape of the span, what can be checked in it,
    a gazetteer, the words before it, and what stands next to it. None of them is right always, so strict and looser spans
    are judged alike."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        last = re.split(r"[.\])@]", span.lower().rstrip(")] "))[-1].strip()
        shape = 1 if len(span) <= 80 and ("." in span.split("@")[-1] or "@" not in span) else -1
        checked, listed = (1 if 2 <= len(last) <= 24 and last.isalpha() else -1), (1 if last in TOP_LEVEL else 0)
    elif kind == "ip":
        parts = span.split(".")
        shape = 1 if len(span) <= 15 and not any(len(p) > 1 and p[0] == "0" for p in parts) else -1
        checked = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        listed = -1 if parts[0] in ("0", "127", "255") else 1 if checked == 1 else 0
    elif kind == "card":
        shape = 1 if _one_card.fullmatch(span) else -1 if len(digits) > 19 else 0
        checked, listed = (1 if luhn(digits) else -1), (1 if digits[0] in "3456" and len(digits) in (14, 15, 16) else -1 if digits[0] == "0" or len(digits) > 19 else 0)
    elif kind == "phone":
        shape = 1 if _one_phone.fullmatch(span) else -1 if len(digits) > 15 else 0
        checked = 1 if 10 <= len(digits) <= 15 else -1
        listed = (1 if span[0] == "+" and any(digits[:n] in COUNTRY for n in (1, 2, 3)) else -1 if digits[0] == "0" and span[0] == "+" else 0)
    elif kind == "secret":
        known = span.startswith(KEYS)
        shape = 1 if known or text[max(0, start - 1) : start] in ("=", ":", '"', "'") and start else 0
        checked = 1 if len(set(span)) >= 8 and sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) >= (2 if known else 4) else -1
        listed = 1 if known else 0
    elif kind == "person":
        first, _, last = span.partition(" ")
        shape, checked = (1 if 3 <= len(last) <= 14 else 0), (-1 if text[start - 2 : start] in (". ", "! ", "? ") or start == 0 else 0)
        listed = 1 if first in GIVEN else -1 if first in PLACES or last in PLACES else 0
    else:
        shape, checked = 1, (1 if digits and digits[0] != "0" else -1)
        listed = 1 if any(w in PLACES for w in _before.findall(text[end : end + 40])) else 0
    said = said_before(text, start)
    context = 1 if any(w in CUES[kind] for w in said) else -1 if said and said[-1] in AGAINST else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    opens = (not left or left.isspace() or left in "(<[:,;\"'=") and (not right or right.isspace() or right in ".,;:)>]\"'!?")
    beside = -1 if left.isalnum() or right.isalnum() or left in ("#", "/") and left else 1 if opens else 0
    return (shape, checked, listed, context, beside)


FOUND = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("kind", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("valid", pa.list_(pa.bool_())), ("pattern", pa.list_(pa.int32()))])
FOUND_DDL = "key long, row long, kind array<int>, start array<long>, end array<long>, valid array<boolean>, pattern array<int>"


def candidate(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, valid, pattern): the pattern has the kind and the votes in base 3, and the classes of the span."""
    out = []
    for kind, s, e, valid in matches(text):
        pattern = KINDS.index(kind)
        for v in votes(text, kind, s, e):
            pattern = 3 * pattern + v + 1
        share = sum(c.isdigit() for c in text[s:e]) / (e - s)
        pattern = LENGTHS * pattern + (e - s > 15) + (e - s > 23)
        pattern = CHARACTERS * pattern + (share > 0.2) + (share > 0.8)
        out.append((KINDS.index(kind), s, e, valid, pattern))
    return out


def ballots(pattern: int) -> tuple[int, list[int]]:
    """The kind and the votes of a pattern."""
    pattern //= LENGTHS * CHARACTERS
    out = []
    for _ in range(LABELERS):
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return pattern, out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """The probability of each pattern's spans to be personal data, by expectation-maximisation over the vote counts.

    For each kind: a prior and, for each labeler, its chances to vote for and against true and false spans, where it votes;
    votes are independent given the truth. All chances are estimated, with some votes beforehand (BEFORE). No labeler is worse
    than chance: where its votes would speak for the other side, they say nothing. Starts from the share of the votes in
    favour.
    """
    out: dict[int, float] = {}
    for k in range(len(KINDS)):
        own = [(p, n, np.array(v)) for p, n in sorted(counts.items()) for kind, v in [ballots(p)] if kind == k]
        if not own:
            continue
        n = np.array([x[1] for x in own], float)
        v = np.array([x[2] for x in own])
        q = np.clip(v.mean(axis=1) / 2 + 0.5, 0.02, 0.98)
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            odds = np.full(len(own), np.log(prior / (1 - prior)))
            for j in range(LABELERS):
                *expected, own_votes = BEFORE[j]
                true, false = (((n * w)[v[:, j] == 1].sum() + own_votes * e) / ((n * w)[v[:, j] != 0].sum() + own_votes) for w, e in zip((q, 1 - q), expected))
                if true > false:
                    odds += np.where(v[:, j] == 1, np.log(true / false), np.where(v[:, j] == -1, np.log((1 - true) / (1 - false)), 0.0))
            q = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        out |= {x[0]: float(p) for x, p in zip(own, q)}
    return out


def features(pattern: int) -> list[float]:
    """Of a span: its kind, the votes on it, and the classes of its length and characters within its kind."""
    kind, v = ballots(pattern)
    within = [float(kind == k and pattern // step % n == c) for k in range(len(KINDS)) for step, n in ((1, CHARACTERS), (CHARACTERS, LENGTHS)) for c in range(1, n)]
    return [float(kind == k) for k in range(len(KINDS))] + [float(x == s) for x in v for s in (-1, 1)] + within + [1.0]


def span_classifier(counts: dict[int, int], ridge: float = 1.0) -> dict[int, float]:
    """Scores of all patterns by logistic regression on the kind, the votes and the span's classes, trained on the probabilities that
    expectation-maximisation gives, each pattern weighted by its spans. The input has at most 7 * 3^7 entries."""
    truth = reliabilities(counts)
    if not truth:
        return {}
    patterns = sorted(truth)
    x, y = np.array([features(p) for p in patterns]), np.array([truth[p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    n /= n.sum() / 1e4
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return {p: float(1 / (1 + np.exp(-np.clip(np.dot(features(p), w), -35, 35)))) for p in patterns}


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A staged row per document with the spans that may be personal data and their votes. No shuffle."""

    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in found:
                for k, row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    got = candidate(t.as_py() or "")
                    yield 32 + 40 * len(got), (k, row, *([g[i] for g in got] for i in range(5)))

        yield from batches(rows(), FOUND)

    made = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")).mapInArrow(scan, FOUND_DDL)
    return stage(made, "pii-candidates")


def learn(found: DataFrame) -> dict[int, float]:
    """The span classifier's scores, from the votes on all candidates: the driver gets a count per pattern of votes."""
    counts = {r["p"]: r["n"] for r in found.select(F.explode("pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    return span_classifier(counts)


def decide(spans: list[tuple[int, int, int, bool, int]], scores: dict[int, float], threshold: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(strict spans, all spans) in order of start and kind: the classifier adds spans that overlap no other."""
    strict = sorted({(s, k, e) for k, s, e, valid, _ in spans if valid})
    taken = list(strict)
    for score, s, k, e in sorted({(-scores.get(p, 0.0), s, k, e) for k, s, e, valid, p in spans if not valid}):
        if -score >= threshold and not any(s < e2 and s2 < e for s2, _, e2 in taken):
            taken.append((s, k, e))
    return strict, sorted(taken)


RESULT = pa.schema([("key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:BASE]), ("base_sha256", pa.string()), ("spans", pa.string())])


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row: the strict spans by kind, a digest of them,
    and all spans as kind:start:end in code points, in order of start and kind.

    Strict spans stay whatever the classifier says; it adds spans of looser patterns (numbers that run into others, local
    telephone numbers, written-out addresses, hosts without a domain, passwords and access keys, persons, streets) where
    the labelers' votes make them likely and no other span overlaps. Null and empty texts have no spans; very long texts
    are read whole, one at a time, in linear time; null and repeated keys and repeated rows are kept; other columns, also
    of clashing names, are ignored; an empty table gives no rows. Texts are read once, without a shuffle.
    """
    found = candidates(docs, key, text)
    scores = learn(found)

    def tell(batches_found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            for batch in batches_found:
                for k, *lists in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    strict, every = decide(list(zip(*lists)), scores, threshold)
                    counts = [sum(x[1] == i for x in strict) for i in range(BASE)]
                    yield 120 + 20 * len(every), (k, *counts, hashlib.sha256(show(strict).encode()).hexdigest(), show(every))

        yield from batches(rows(), RESULT)

    ddl = "key long, " + ", ".join(f"n_{k} long" for k in KINDS[:BASE]) + ", base_sha256 string, spans string"
    return found.select("key", "kind", "start", "end", "valid", "pattern").mapInArrow(tell, ddl).withColumnRenamed("key", key)


def mask(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows with each span of personal data replaced by its kind in brackets, and n_chars, if there, counted again.
    All rows and columns stay; null texts stay null; very long and repeated texts and empty tables as in personal_spans()."""
    scores = learn(candidates(docs, key, text))

    def redact(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            names = batch.schema.names
            out = []
            for t in batch.column(names.index(text)).to_pylist():
                if t is not None:
                    parts, at = [], 0
                    for s, k, e in decide(candidate(t), scores, threshold)[1]:
                        if s >= at:
                            parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    t = "".join([*parts, t[at:]])
                out.append(t)
            columns = {n: batch.column(n) for n in names} | {text: pa.array(out, batch.schema.field(text).type)}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(redact, docs.schema)
