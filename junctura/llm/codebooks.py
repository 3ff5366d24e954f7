"""Vectors as short codes: each part of a vector is named by the nearest entry of a learnt codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import finite

#: Above it, squares are added up as Python's own integers.
LARGE = 1 << 28
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Compressed:
    """`vectors`: (row, id, label, code, error) of the kept rows; `codebooks`: by part a list of entries, each a list of whole
    numbers; `rounds` assignments were followed by new entries."""

    vectors: DataFrame
    codebooks: list[list[list[int]]]

    def sha256(self) -> str:
        """Digest of all entries' components in decimal, by part, entry and place, divided by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for entry in book for x in entry).encode()).hexdigest()


def _whole(lists: pa.Array, width: int) -> np.ndarray:
    values = np.asarray(lists.flatten(), np.int64).reshape(len(lists), width)
    return values if not values.size or np.abs(values // 2).max() < LARGE // 2 else values.astype(object)


def nearest(values: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower one of equal ones) and the squared distance, exact."""
    if not values.shape[1]:
        return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    large = values.dtype == object or max(abs(x) for entry in book for x in entry) >= LARGE
    entries = np.array(book, object if large else np.int64)
    codes, errors = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for at in range(0, len(values), 4096):
        apart = values[at : at + 4096, None, :] - entries[None]
        squares = (apart * apart).sum(2)
        codes[at : at + 4096] = squares.argmin(1)
        errors[at : at + 4096] = np.minimum(squares.min(1), MOST)
    return codes, errors


def _by_part(batch: pa.RecordBatch, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places of its rows, values) of a batch of (part, value, ...)."""
    part = np.asarray(batch.column(0))
    for p, width in enumerate(widths):
        at = np.flatnonzero(part == p)
        if len(at):
            yield p, at, _whole(batch.column(1).take(pa.array(at)), width)


def _moved(distinct: DataFrame, books: list[list[list[int]]], widths: list[int]) -> list[list[list[int]]]:
    """The codebooks after one round over the distinct values: each task adds up its weighted values by entry, and the driver
    gets a row per part, entry and place."""

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in found:
            weight = np.asarray(batch.column(2), np.int64)
            for p, at, values in _by_part(batch, widths):
                codes, _ = nearest(values, books[p])
                for e in np.unique(codes).tolist():
                    own = codes == e
                    n = weight[at][own]
                    # Products with large weights could pass 64 bits.
                    exact = values.dtype != object and int(n.max()) * len(n) < 1 << 30
                    total = (values[own] * n[:, None]).sum(0) if exact else (values[own].astype(object) * n.astype(object)[:, None]).sum(0)
                    held = sums.setdefault((p, e), [0, [0] * widths[p]])
                    held[0] += int(n.sum())
                    held[1] = [a + int(b) for a, b in zip(held[1], total)]
        rows = [(p, e, i, Decimal(x), n) for (p, e), (n, total) in sums.items() for i, x in enumerate(total)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "entry", "place", "total", "n"])

    sums = distinct.mapInArrow(add, "part int, entry int, place int, total decimal(38,0), n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = [[list(entry) for entry in book] for book in books]
    for r in sums.collect():  # at most parts x entries x places of a part
        out[r.part][r.entry][r.place] = int(r.total) // r.n
    return out


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> Compressed:
    """Codes of vectors by product quantization over whole numbers.

    Components become floor(scale * x). A vector is cut into `parts` neighbouring parts; the numbers of each part position are
    aggregated to distinct rows with weights, so that copies, however many, are one row. The codebook of a position starts as
    that part of the `entries` rows of smallest key (a table of fewer rows gives fewer entries), and in each round the
    distinct rows are assigned to their nearest entry and entries move to the floor of the weighted mean, unused ones stay.
    Codes and squared errors of the distinct rows are joined back to the vectors; a value that many rows have is one row of
    one side, so the join can be split.

    Rows whose vector is null or has a null or non-finite component are dropped. Where lengths differ, shorter vectors count
    as if zeros followed; a length that isn't a multiple of `parts` is cut at i * length div parts. Null keys come last where
    the first entries are chosen, equal keys go by the vector; repeated rows are rows of their own. Components past 64 bits
    are cut to them, as are errors. An empty table gives no rows; other columns are ignored.
    """
    v = F.col(vector)
    sized = rows.where(finite(v)).select(F.col(key).alias("id"), F.col(label).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("z"))
    kept = stage(sized.withColumn("row", F.monotonically_increasing_id()), "codebook-rows")
    width = kept.agg(F.max(F.size("z")).alias("w")).first()["w"] or 0
    cuts = [i * width // parts for i in range(parts + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:])]
    padded = F.concat("z", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("z")))
    cut = F.array(*[F.slice(padded, a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    firsts = kept.orderBy(F.col("id").asc_nulls_last(), "z").select(cut.alias("cut")).limit(entries).collect()
    books = [[list(r["cut"][p]) for r in firsts] for p in range(parts)]
    pieces = kept.select("row", "id", "label", F.posexplode(cut).alias("part", "value"))
    distinct = stage(pieces.groupBy("part", "value").agg(F.count("*").alias("n")), "codebook-values")
    if firsts:
        for _ in range(rounds):
            books = _moved(distinct, books, widths)

    def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            codes, errors = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, at, values in _by_part(batch, widths):
                codes[at], errors[at] = nearest(values, books[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.astype(np.int32)), pa.array(errors)], names=["part", "value", "entry", "squares"])

    coded = distinct.mapInArrow(assign, "part int, value array<bigint>, entry int, squares long")
    met = pieces.join(coded, ["part", "value"]).groupBy("row").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("codes"), F.try_sum("squares").alias("error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c["entry"]), 2, "0"))), "")
    return Compressed(met.select("row", "id", "label", code.alias("code"), F.coalesce("error", F.lit(MOST)).alias("error")), books)


def coded_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of compress(): errors are also added up over equal labels, nulls
    together. Labels are aggregated first and joined, so a label that most rows have is no task of its own."""
    found = compress(rows, key=key, vector=vector, label=label, **how)
    held = stage(found.vectors, "codebook-codes")
    errors = held.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    joined = held.join(errors, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))
