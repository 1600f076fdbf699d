"""Token-ID and binary output: documents as rows of a fixed number of token ids, packed best-fit-decreasing.

Texts are encoded (tiktoken, the ranks of a vocabulary file) and cut into segments of at most seq_len ids: nothing is
lost. Segments are dealt by hash to blocks of about BLOCK_BYTES of text, so a long document spreads over many; each block
is packed by itself. A segment goes to the row with the least room that takes it, found by a segment tree over
capacities; longest segments first. Each row has its ids and positions (little-endian binary) and the cumulative segment
lengths, for attention that stops at segment borders.
"""

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import RANKS, cut, read_ranks
from .common import release, slices

SEQ_LEN = 2048
BLOCK_BYTES = 8 << 20
PAD = 0
PACKED = "block int, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"


class CapacityTree:
    """Rows by their free capacity: a segment tree over 0..most whose nodes count rows, and a stack of rows for each leaf."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i //= 2

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest capacity that is `least` or more, and that capacity; it leaves the tree."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i % 2 or not self.count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], seq_len: int) -> list[list[int]]:
    """The numbers of the segments in each row; segments of equal length in the given order."""
    tree, packed = CapacityTree(seq_len), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        if found := tree.take(n):
            row, room = found
            packed[row].append(k)
        else:
            row, room = len(packed), seq_len
            packed.append([k])
        if room > n:
            tree.put(row, room - n)
    return packed


def _segments(ranks: dict[bytes, int], pattern: str, seq_len: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for whole in batches:
            for batch in slices(whole, "text"):
                docs, pieces, counts, rows = [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    parts = [np.array(encoding.encode_ordinary(p), kind) for p in cut(text)]
                    ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
                    for k, a in enumerate(range(0, len(ids), seq_len)):
                        part = ids[a : a + seq_len]
                        docs.append(doc)
                        pieces.append(k)
                        counts.append(len(part))
                        rows.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(counts, pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "piece", "n", "ids"])
        del encoding
        release()

    return run


def _pack(seq_len: int, kind: str, pad: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        block = table.column("block")[0].as_py()
        docs, pieces, lengths, ids = (table.column(c).to_pylist() for c in ("doc_id", "piece", "n", "ids"))
        rows = best_fit_decreasing(lengths, seq_len)
        counted = np.arange(seq_len, dtype=kind)
        out = {name: [] for name in ("ids", "positions", "cu_seqlens")}
        for own in rows:
            ends = np.cumsum([0, *[lengths[k] for k in own]])
            line, places = np.full(seq_len, pad, kind), np.zeros(seq_len, kind)
            line[: ends[-1]] = np.frombuffer(b"".join([ids[k] for k in own]), kind)
            for a, e in zip(ends, ends[1:], strict=False):
                places[a:e] = counted[: e - a]
            out["ids"].append(line.tobytes())
            out["positions"].append(places.tobytes())
            out["cu_seqlens"].append(ends)
        return pa.table({
            "block": pa.array([block] * len(rows), pa.int32()), "row": pa.array(range(len(rows)), pa.int32()), "n_tokens": pa.array([int(e[-1]) for e in out["cu_seqlens"]], pa.int32()),
            "ids": pa.array(out["ids"], pa.binary()), "positions": pa.array(out["positions"], pa.binary()), "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
            "doc_ids": pa.array([[docs[k] for k in own] for own in rows], pa.list_(pa.int64())), "pieces": pa.array([[pieces[k] for k in own] for own in rows], pa.list_(pa.int32())),
        })

    return run


def pack(df: DataFrame, seq_len: int = SEQ_LEN, path: str | None = None, pattern: str = public_tokenizers.PATTERN, pad: int = PAD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df's documents (doc_id, text) as packed rows (PACKED): see the module. Other columns are left out.

    ids and positions are unsigned 16-bit integers if the vocabulary and seq_len allow, else 32-bit; ids past n_tokens are
    pad. A document without tokens (null or empty text) is in no row. Repeated documents are packed as often as they are
    there; null doc_ids stay null, and their segments are dealt by their ids. Rows depend on the documents alone, not on df's
    partitions.
    """
    ranks = read_ranks(path or public_tokenizers.path(RANKS))
    kind = "<u2" if max([*ranks.values(), pad, seq_len]) < 1 << 16 else "<u4"
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"))
    blocks = (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // block_bytes + 1
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    cutup = common.to_python(docs).mapInArrow(_segments(sent, pattern, seq_len, kind), "doc_id long, piece int, n int, ids binary")
    dealt = cutup.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack(seq_len, kind, pad), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files: the ids of a file's rows, read in order, are a matrix of seq_len columns."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, piece, ids array<int>) for each segment of packed rows; wide: their ids are 32-bit."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, pieces, ids = [], [], []
            for row in batch.to_pylist():
                line = np.frombuffer(row["ids"], kind).astype(np.int32)
                docs += row["doc_ids"]
                pieces += row["pieces"]
                ids += [line[a:e] for a, e in zip(row["cu_seqlens"], row["cu_seqlens"][1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    return packed.select("ids", "cu_seqlens", "doc_ids", "pieces").mapInArrow(run, "doc_id long, piece int, ids array<int>")


def op9_pack_tokens(spark, sf_dir: str) -> DataFrame:
    rows = pack(common.documents(spark, sf_dir))
    return rows.select("block", "row", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", "ids", "positions")
