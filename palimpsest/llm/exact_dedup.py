"""Exact dedup by two passes over a counting Bloom filter.

Pass 1 counts text hashes into the cells of a Bloom filter, saturating at two. Pass 2 probes it: a row with a cell that
was hit once is the only one of its text and passes straight through; only the others shuffle, and exact hashes decide.

The filter has 16 cells a row up to MAX_CELLS; beyond, more rows shuffle, and the result stays exact. Its cells are
merged in segments, a bounded number of tasks' counts at a time; what the driver collects and broadcasts is one
bit a cell, MAX_CELLS / 8 bytes at most (32 MB).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_CELLS = 1 << 28
SEGMENT = 1 << 16
#: So many tasks' counts of a segment are merged at a time.
FAN_IN = 256
CELLS_PER_ROW = 16


def text_hash(text: str):
    """SHA-256 (binary) of the text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(common.text_or_empty(text), f"[{common.SPACE}]+", " "), 256))


def _cells(column: pa.Array, n_cells: int) -> np.ndarray:
    """Two cells for each hash, as a (rows, 2) array."""
    flat = column.cast(pa.binary(32)) if column.type != pa.binary(32) else column
    words = np.frombuffer(flat.buffers()[1], dtype="<u8")[flat.offset * 4 : (flat.offset + len(flat)) * 4].reshape(-1, 4)
    return (words[:, :2] & np.uint64(n_cells - 1)).astype(np.int64)


def _hits(segment: int, part: int, cells: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """The cells of a segment that were hit, and whether each was hit more than once."""
    return pa.RecordBatch.from_pydict({
        "segment": pa.array([segment], pa.int32()), "part": pa.array([part], pa.int32()),
        "cells": pa.array([cells.astype("<u2").tobytes()], pa.binary()), "more": pa.array([np.packbits(more).tobytes()], pa.binary()),
    })


def _counted(n_cells: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            if batch.num_rows:
                cells = _cells(batch.column(0), n_cells)
                cells[cells[:, 0] == cells[:, 1], 1] = -1  # one hit, not two
                found.append(cells.ravel())
        if not found:
            return
        cells, n = np.unique(np.concatenate(found), return_counts=True)
        cells, n = cells[cells >= 0], n[cells >= 0]
        segment, part = cells // SEGMENT, TaskContext.get().partitionId()
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(cells) else []
        for a, b in zip(starts, [*starts[1:], len(cells)], strict=True):
            yield _hits(int(segment[a]), part, cells[a:b] % SEGMENT, n[a:b] > 1)

    return count


def _merged(rows: pa.Table) -> pa.Table:
    """The hits of several parts of a segment as those of one."""
    seen, again = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
    for cells, more in zip(rows.column("cells").to_pylist(), rows.column("more").to_pylist(), strict=True):
        at = np.frombuffer(cells, "<u2")
        again[at] |= seen[at] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)).astype(bool)
        seen[at] = True
    at = np.flatnonzero(seen)
    return pa.Table.from_batches([_hits(rows.column("segment")[0].as_py(), rows.column("part")[0].as_py(), at, again[at])])


def hit_filter(hashes: DataFrame, rows: int, hits: int = 2, max_cells: int = MAX_CELLS, fan_in: int = FAN_IN) -> np.ndarray:
    """Pass 1 over one binary column of SHA-256: the packed bits of the cells that were hit at least `hits` (1 or 2) times.

    What the tasks counted is merged level by level, fan_in tasks to one, so no group grows with the number of tasks.
    """
    n_cells = SEGMENT
    while n_cells < min(rows * CELLS_PER_ROW, max_cells):
        n_cells *= 2
    bits, parts = np.zeros(n_cells // 8, np.uint8), hashes.rdd.getNumPartitions()
    form = "segment int, part int, cells binary, more binary"
    counted = hashes.mapInArrow(_counted(n_cells), form)
    while parts > 1:
        counted = counted.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("segment", "part").applyInArrow(_merged, form)
        parts = -(-parts // fan_in)
    for row in counted.toLocalIterator():
        at = np.frombuffer(row.cells, "<u2")
        more = np.unpackbits(np.frombuffer(row.more, np.uint8), count=len(at)).astype(bool)
        own = np.zeros(SEGMENT, bool)
        own[at[more] if hits > 1 else at] = True
        bits[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.packbits(own)
    return bits


def _probe(bits):
    @F.pandas_udf("boolean")
    def repeated(sha: pd.Series) -> pd.Series:
        table = bits.value
        cells = _cells(pa.array(sha, pa.binary()), len(table) * 8)
        return pd.Series(((table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1))

    return repeated


def possibly_in(df: DataFrame, sha, keys: DataFrame, name: str) -> DataFrame:
    """df with `name`: false only if its hash (a SHA-256 expression) is none of those in the only column of keys."""
    bits = hit_filter(keys, keys.count(), hits=1)
    own = common.free_name(df, "own_sha")
    return df.withColumn(own, sha).withColumn(name, _probe(df.sparkSession.sparkContext.broadcast(bits))(own)).drop(own)


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", hashes: DataFrame | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """df with keep_id, group_size, kept and sha (binary): of rows with equal text_hash(), the smallest doc_id stays.

    A null doc_id sorts first; of rows with the smallest doc_id that are repeated, exactly one stays. A null text counts
    as empty, and all empty texts are equal. Columns of df that are called keep_id, group_size, kept or sha are replaced.
    An empty df gives an empty result. hashes: a table with df's hashes in the column sha, if there is one already;
    if df itself has them there, pass df.
    """
    spark = df.sparkSession
    table = df.drop("keep_id", "group_size", "kept")
    if hashes is None:
        table = table.withColumn("sha", text_hash(text))
        hashes = common.materialize(table.select("sha"))
    bits = hit_filter(hashes.select("sha"), hashes.count(), max_cells=max_cells)
    row, own, first = (common.free_name(df, x) for x in ("row", "own", "first"))
    table = table.withColumn(row, _probe(spark.sparkContext.broadcast(bits))("sha"))
    alone = table.filter(~F.col(row)).select(*[c for c in table.columns if c != row], F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = common.materialize(table.filter(row).withColumn(row, F.monotonically_increasing_id()))
    groups = again.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col(doc_id).alias("id"), F.col(row).alias("row"))).alias(first))
    joined = common.join_counted(again, groups, ["sha"], "group_size", again.count())
    decided = joined.select(*[c for c in table.columns if c != row], F.col(f"{first}.id").alias("keep_id"), "group_size", (F.col(row) == F.col(f"{first}.row")).alias("kept"))
    return alone.unionByName(decided)


def drop_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df that exact_dedup() keeps, with df's columns."""
    clash = {c: common.free_name(df, "own_" + c) for c in df.columns if c.lower() in {"keep_id", "group_size", "kept", "sha"}}
    back = {v: k for k, v in clash.items()}
    return exact_dedup(df.withColumnsRenamed(clash), clash.get(text, text), clash.get(doc_id, doc_id)).filter("kept").select(*[clash.get(c, c) for c in df.columns]).withColumnsRenamed(back)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    rows = common.materialize(common.documents(spark, sf_dir).select("doc_id", text_hash("text").alias("sha")))
    return exact_dedup(rows, hashes=rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
