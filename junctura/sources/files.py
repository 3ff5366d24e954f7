"""Paths in any store that Spark reads, and numbered lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Questions about paths, answered by Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _status(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(str(path))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(p) if fs.exists(p) else None

    def is_dir(self, path: str) -> bool:
        s = self._status(path)
        return s is not None and s.isDirectory()

    def is_file(self, path: str) -> bool:
        s = self._status(path)
        return s is not None and s.isFile()

    def first(self, *paths: str) -> str | None:
        return next((p for p in paths if self.is_file(p)), None)


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_idx from 0, value) of the lines that aren't blank, gzipped or not: rows are counted by block of the file, and
    prefix sums over blocks give where each begins."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = read.groupBy("block").count().select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return read.join(F.broadcast(sizes), "block").select((F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1).alias("line_idx"), "value")


def columns(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """line_idx and the first tab-separated fields of `value`, cast."""
    parts = F.split("value", "\t")
    return df.select("line_idx", *[F.trim(F.get(parts, F.lit(i))).cast(kind).alias(field) for i, (field, kind) in enumerate(fields)])


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    return columns(lines(spark, path), [("barcode", "string")])


def features(spark: SparkSession, path: str) -> DataFrame:
    """(line_idx, gene_id, gene_name, feature_type) of a list with three columns or more, or with two (gene expression)."""
    numbered = lines(spark, path)
    first = numbered.orderBy("line_idx").first()
    width = len(first["value"].split("\t")) if first else 3
    if width < 2:
        raise ValueError(f"features.tsv at {path} has {width} columns; expected 2 or 3")
    found = columns(numbered, [("gene_id", "string"), ("gene_name", "string"), *([("feature_type", "string")] if width > 2 else [])])
    return found if width > 2 else found.withColumn("feature_type", F.lit("Gene Expression"))


JUNCTION_FIELDS = [("chr", "string"), ("start", "long"), ("end", "long"), ("strand_code", "int"), ("intron_motif", "byte"), ("is_annot", "byte"), ("unique_mapped", "long")]


def junction_table(spark: SparkSession, path: str) -> DataFrame:
    return columns(lines(spark, path), JUNCTION_FIELDS)
