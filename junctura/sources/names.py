"""Unique names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import with_index

#: The name of rows without a symbol.
MISSING = "nan"


def make_unique(df: DataFrame, symbol: str, order: str, name: str) -> DataFrame:
    """Adds the symbol with -k after its repetitions in order: k counts up from 1, passing over names that are symbols
    themselves. As no two symbols differ in the suffix alone, names are unique. A null symbol counts as MISSING.

    Rows are numbered once by symbol and order, over as many ranges as there are; a row's repetition is its place less the
    first place of its symbol, so a symbol that most rows have is no task of its own.
    """
    told = df.withColumn("_symbol", F.coalesce(F.col(symbol).cast("string"), F.lit(MISSING)))
    placed = with_index(told, ["_symbol", order], "_place")
    first = placed.groupBy("_symbol").agg(F.min("_place").alias("_first"))
    taken = first.select("_symbol", F.regexp_extract("_symbol", "-([1-9][0-9]{0,8})$", 1).alias("_k")).where("_k <> ''")
    taken = taken.select(F.expr("substring(_symbol, 1, length(_symbol) - length(_k) - 1)").alias("_symbol"), F.col("_k").cast("int").alias("_k")).groupBy("_symbol").agg(F.array_sort(F.collect_list("_k")).alias("_taken"))
    known = placed.join(first.join(taken, "_symbol", "left"), "_symbol").withColumn("_nth", (F.col("_place") - F.col("_first")).cast("int"))
    k = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_nth"), lambda x, t: F.when(t <= x, x + 1).otherwise(x))
    return known.withColumn(name, F.when(F.col("_nth") == 0, F.col("_symbol")).otherwise(F.concat("_symbol", F.lit("-"), k.cast("string")))).select(*df.columns, name)
