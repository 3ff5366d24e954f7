"""MatrixMarket coordinate files as rows."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measured

#: Largest declared entries and cells; the environment variables raise them.
MOST_ENTRIES, MOST_CELLS = 5_000_000_000, 10**13
ENTRIES_VARIABLE, CELLS_VARIABLE = "JUNCTURA_MAX_MTX_NNZ", "JUNCTURA_MAX_MTX_SHAPE"


@dataclass(frozen=True)
class Header:
    """What the first lines of a file say: rows, columns, entries, and whether entries stand for their mirror images too."""

    rows: int
    cols: int
    entries: int
    symmetric: bool


def header(spark: SparkSession, path: str, what: str = "matrix.mtx", bounded: bool = True) -> Header:
    """From the banner and the dimension line, for which the first lines alone are read. ValueError where the numbers are larger
    than allowed, unless they are taken unbounded."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0 and trim(value) <> '' and (value not like '\\%%' or value like '\\%\\%MatrixMarket%')").limit(2).collect()
    banner = next((r["value"] for r in first if r["value"].startswith("%")), "")
    sizes = next((r["value"] for r in first if not r["value"].startswith("%")), None)
    if sizes is None:
        raise ValueError(f"{what} at {path} has no dimension line")
    rows, cols, entries = map(int, sizes.split()[:3])
    for name, found, variable, most in (("nnz", entries, ENTRIES_VARIABLE, MOST_ENTRIES), ("rows x columns", rows * cols, CELLS_VARIABLE, MOST_CELLS)):
        most = int(os.environ.get(variable, most))
        if bounded and found > most:
            raise ValueError(f"{path}: {what} of {rows} x {cols} with nnz {entries:,} is too large, as {name} may come to {most:,}; {variable} sets the bound")
    return Header(rows, cols, entries, "symmetric" in banner.lower().split())


def shape(spark: SparkSession, path: str, what: str = "matrix.mtx") -> tuple[int, int, int]:
    """Rows, columns and entries that the file declares; see header()."""
    found = header(spark, path, what)
    return found.rows, found.cols, found.entries


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """(row, col from 0, value double) of the entry lines. Files that aren't gzipped are read in splits; the dimension line is
    told by its place, the first line of the first block that isn't a comment (so comments must be shorter than a block)."""

    def parse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = False
        for batch in found:
            value, block = batch.column(0), batch.column(1)
            keep = pc.and_(pc.invert(pc.starts_with(value, "%")), pc.not_equal(pc.utf8_trim_whitespace(value), "")).to_numpy(zero_copy_only=False).copy()
            if not seen:
                first = np.flatnonzero(keep & (block.to_numpy() == 0))
                if len(first):
                    keep[first[0]], seen = False, True
            text = value.filter(pa.array(keep)).to_pylist()
            if text:
                cells = pd.read_csv(io.StringIO("\n".join(text)), sep=r"\s+", header=None)
                x = cells[2].to_numpy(float) if cells.shape[1] > 2 else np.ones(len(cells))
                yield pa.RecordBatch.from_arrays([pa.array(cells[0].to_numpy(np.int64) - 1), pa.array(cells[1].to_numpy(np.int64) - 1), pa.array(x)], names=["row", "col", "value"])

    read = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    return read.mapInArrow(parse, "row long, col long, value double")


def _mirrored(found: DataFrame, symmetric: bool) -> DataFrame:
    return found.unionByName(found.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value")) if symmetric else found


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(row, col from 0, value double) of the file's entries; repeated places are added up. The entries of a symmetric file off
    the diagonal are mirrored."""
    return _mirrored(_parsed(spark, path), header(spark, path, bounded=False).symmetric).groupBy("row", "col").agg(F.sum("value").alias("value"))


def checked_entries(spark: SparkSession, path: str, head: Header, whose: str) -> DataFrame:
    """entries(), with repeated places as they are, from one scan that writes them as a table and counts them: ValueError where
    they aren't as many as declared."""
    found, seen = measured(_parsed(spark, path), n=F.count(F.lit(1)))
    if seen["n"] != head.entries:
        raise ValueError(f"{whose}: the matrix says that it has {head.entries} entries but holds {seen['n']}; is {path} cut off?")
    return _mirrored(found, head.symmetric)
