"""Samples that depend on keys alone: equal on every run and in every engine that has MD5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.pipeline import Transform


def draw(*key: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the key: its first 7 hexadecimal digits."""
    joined = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k for k in key])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def hash_sample(fraction: float, *key: Column | str) -> Transform:
    """Rows whose draw is under the fraction."""
    return lambda df: df.filter(draw(*key) < fraction)


def k_of_group(k: int, by: Sequence[str], *key: Column | str) -> Transform:
    """k rows of each group, least draw first; all if there are fewer."""

    def run(df: DataFrame) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(draw(*key), *[x for x in key])
        return df.withColumn("own_nth", F.row_number().over(order)).filter(F.col("own_nth") <= k).drop("own_nth")

    return run


def k_of_array(values: Column, k: int, salt: Column) -> Column:
    """k elements of an array by draw, fewer if it has fewer."""
    drawn = F.transform(values, lambda v: F.struct(draw(v.cast("string"), salt).alias("d"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(drawn), 1, k), lambda x: x["v"])


def shuffled(seed: int) -> Transform:
    """All rows in an order drawn at random: a distributed sort."""
    return lambda df: df.orderBy(F.rand(seed))


def slices(n: int, key: str, out: str = "slice") -> Transform:
    """Adds the slice, 0 to n - 1, that a row's hash falls in."""
    return lambda df: df.withColumn(out, F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)).cast("int"))
