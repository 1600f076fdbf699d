"""Line dedup: lines found in many documents go, the others stay in place.

Pass 1 explodes each text into its distinct normalised lines, hashes them (128 bits) and counts documents a hash, added
up within each task before the shuffle. Pass 2 drops the lines whose hash is over the threshold and joins the rest by
position. Up to BROADCAST_KEYS such hashes (16 bytes each, counted first) travel to the tasks as a broadcast; beyond
that, line hashes are joined with them by shuffle, with hot lines split off, and each document gets its positions back.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import release, slices

MIN_DOCS = 10
BROADCAST_KEYS = 200_000
#: Hashes a task holds before it sends its counts on.
FLUSH_KEYS = 200_000
_STRIP = b" \t\n\x0b\x0c\r"


def line_hashes(text: bytes) -> list[bytes | None]:
    """A hash for each line of a text; None for lines that are empty once stripped (they never go)."""
    keys = [line.strip(_STRIP).lower() for line in text.split(b"\n")]
    return [hashlib.blake2b(k, digest_size=16).digest() if k else None for k in keys]


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def frequent_lines(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(key binary, n_docs long): the hashes of lines found in at least min_docs rows of df."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])
            seen.clear()
            return made

        for batch in batches:
            for part in slices(batch, "text"):
                for x in _texts(part, "text"):
                    seen.update(set(line_hashes(x)) - {None})
                if len(seen) >= FLUSH_KEYS:
                    yield flushed()
        yield flushed()
        release()

    counted = common.to_python(df.select(common.text_or_empty(text).alias("text"))).mapInArrow(count, "key binary, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _dropping(df: DataFrame, text: str, positions, keep: list[str]) -> DataFrame:
    """df's columns in keep with kept, n_lines, n_dropped; positions(batch) gives for each text a test of (position, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                kept, before, gone = [], [], []
                for x, goes in zip(_texts(batch, text), positions(batch), strict=True):
                    lines = x.split(b"\n")
                    stay = [line for i, (line, key) in enumerate(zip(lines, line_hashes(x), strict=True)) if key is None or not goes(i, key)]
                    kept.append(b"\n".join(stay))
                    before.append(len(lines))
                    gone.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, "kept", "n_lines", "n_dropped"])

    return common.to_python(df).mapInArrow(run, df.select(*keep).schema.add("kept", "string").add("n_lines", "long").add("n_dropped", "long"))


def drop_common_lines(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, keep: list[str] | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """df's columns in `keep` (default: all) with kept (the text left), n_lines (before) and n_dropped.

    Lines are compared stripped and with A-Z in lower case; those found in at least min_docs rows of df go, except empty
    ones. A null or empty text has one empty line. Rows are documents: a repeated row counts as often as it is there.
    Columns of df with the new names are replaced; an empty df gives an empty result.
    """
    spark = df.sparkSession
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("kept", "n_lines", "n_dropped")]
    frequent = common.materialize(frequent_lines(df, text, min_docs))
    own = common.free_name(df, "own_text")
    if frequent.count() <= broadcast_keys:
        keys = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in frequent.select("key").toLocalIterator()))

        def everywhere(batch):
            goes = keys.value
            return [lambda _, key: key in goes] * batch.num_rows

        return _dropping(df.select(*keep, common.text_or_empty(text).alias(own)), own, everywhere, keep)

    row, gone = common.free_name(df, "own_row"), common.free_name(df, "own_gone")
    table = common.materialize(df.select(*keep, common.text_or_empty(text).alias(own), F.monotonically_increasing_id().alias(row)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, keys = [], []
                for i, x in zip(batch.column("row").to_pylist(), _texts(batch, "text"), strict=True):
                    found = set(line_hashes(x)) - {None}
                    rows += [i] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary())], names=["row", "key"])

    lines = common.materialize(table.select(F.col(row).alias("row"), F.col(own).alias("text")).mapInArrow(explode, "row long, key binary"))
    hits = common.join_counted(lines, frequent, ["key"], "n_docs", lines.count())
    by_row = hits.groupBy("row").agg(F.collect_list("key").alias(gone)).withColumnRenamed("row", row)

    def listed(batch):
        sets = [frozenset(x or ()) for x in batch.column(gone).to_pylist()]
        return [lambda _, key, s=s: key in s for s in sets]

    return _dropping(table.join(by_row, row, "left"), own, listed, keep)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_common_lines(common.documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
    SELECT doc_id, pos, parts[pos] AS line, translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (key) GROUP BY doc_id
"""
