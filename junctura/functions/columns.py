"""Names, keys and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strand_sign(code: Column | str) -> Column:
    """0, 1, 2 as '.', '+', '-'; null for anything else."""
    return F.when(_c(code) == 0, ".").when(_c(code) == 1, "+").when(_c(code) == 2, "-")


def cell_name(barcode: Column | str, sample: Column | str) -> Column:
    return F.concat(_c(barcode), F.lit("-"), _c(sample))


def row_name(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(_c(chrom), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def event_name(row: Column | str, kind: Column | str) -> Column:
    return F.concat(_c(row), F.lit("_"), _c(kind))


def splice_key(kind: Column | str, chrom: Column | str, site: Column | str, strand: Column | str) -> Column:
    """The key of a group of competing junctions; start and end groups have keys of their own."""
    return F.concat_ws("|", _c(kind), _c(chrom), _c(site).cast("string"), _c(strand))


def inclusion_ratio(m1: Column | str, m2: Column | str) -> Column:
    """m1 / (m1 + m2); null without coverage."""
    both = _c(m1) + _c(m2)
    return F.when(both > 0, _c(m1) / both)


def excluded(total: Column | str, own: Column | str) -> Column:
    """What a group counts besides a member; null where nothing is to be stored."""
    rest = _c(total) - F.coalesce(_c(own), F.lit(0.0))
    return F.when((_c(total) != 0) & (rest != 0), rest)
