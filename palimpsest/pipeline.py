"""Chains of transforms over DataFrames, with a count of rows after each step."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, steps: Iterable[Transform]) -> DataFrame:
    """df through all steps, in order; nothing runs yet."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def flat_map(column: str, values) -> Transform:
    """One row for each element of the array that values(column) gives: 0 drops a row, several multiply it."""
    return lambda df: df.withColumn(column, F.explode(values(F.col(column))))


class Funnel:
    """Counts rows after each named step of a chain, in the run that produces the result (no extra pass).

    rows() gives (step, rows_in, rows_out, accepted) once an action over the result has ended.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._seen.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def chain(self, df: DataFrame, steps: Iterable[tuple[str, Transform]]) -> DataFrame:
        df = self.watch("input", df)
        for name, step in steps:
            df = self.watch(name, df.transform(step))
        return df

    def rows(self) -> list[tuple[str, int, int, float]]:
        counts = [(name, seen.get["n"]) for name, seen in self._seen]
        return [(name, before, after, after / before if before else 0.0) for (_, before), (name, after) in zip(counts, counts[1:], strict=False)]


def funnel_counts(df: DataFrame, steps: Iterable[tuple[str, object]]) -> DataFrame:
    """(step, pos, rows_in, rows_out) for boolean conditions that filter one after another, in a single aggregation."""
    passed, counts, names = F.lit(True), [F.count(F.lit(1)).alias("c0")], []
    for i, (name, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"c{i}"))
        names.append(name)
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("step"), F.col(f"c{i - 1}").alias("rows_in"), F.col(f"c{i}").alias("rows_out")) for i, n in enumerate(names, 1)])
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")
