"""What built-in functions can't express, as Arrow-batched functions: sequence diffs, BLEU, all HTML entities."""

from __future__ import annotations

import html
import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIFF = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("src", "tgt")])
_MATCHES = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_INSERTION = T.StructType([T.StructField(n, T.StringType()) for n in ("prefix", "original", "edited")])


def changed_indices(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Indices of a that are deleted or replaced, and of b that are inserted or replace."""
    gone, new = [], []
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, a, b).get_opcodes():
        if kind != "equal":
            gone += range(i1, i2)
            new += range(j1, j2)
    return gone, new


#: Rows of an Arrow batch that are Python objects at a time, and bytes of their texts (with 64 for each text); a longer row is alone.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 16_000_000


def _texts(a: pa.Array) -> bool:
    return any(f(a.type) for f in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary))


def _lists(a: pa.Array) -> list:
    """A column of lists as Python lists; texts go through NumPy, which takes a fraction of to_pylist()'s time, but makes nulls of numbers NaN."""
    if not (pa.types.is_list(a.type) or pa.types.is_large_list(a.type)):
        return a.to_numpy(zero_copy_only=False).tolist() if _texts(a) else a.to_pylist()
    values, found, at = _lists(a.flatten()), [], 0
    for n in a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).tolist():
        found.append(None if n < 0 else values[at : at + n])
        at += max(n, 0)
    return found


def _ends(a: pa.Array) -> np.ndarray:
    """Bytes of the texts, with 64 for each, up to the end of each row; 64 for each value that is no text."""
    if not (pa.types.is_list(a.type) or pa.types.is_large_list(a.type)):
        own = pc.binary_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if _texts(a) else np.zeros(len(a), np.int64)
        return np.cumsum(own + 64)
    ends = np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.append(0, _ends(a.flatten()))[ends]


def _parts(a: pa.Array, b: pa.Array) -> Iterator[Iterator[tuple[list, list]]]:
    """Pairs of two list columns, ROWS_AT_ONCE or BYTES_AT_ONCE of them as Python lists; null lists count as empty."""
    ends, k = _ends(a) + _ends(b), 0
    while k < len(a):
        most = (ends[k - 1] if k else 0) + BYTES_AT_ONCE
        n = min(ROWS_AT_ONCE, max(1, int(np.searchsorted(ends, most, "right")) - k))
        yield ((x or [], y or []) for x, y in zip(*(_lists(c.slice(k, n)) for c in (a, b)), strict=True))
        k += n


@F.arrow_udf(_DIFF)
def _seq_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    src, tgt = [], []
    for part in _parts(a, b):
        found = [changed_indices(x, y) for x, y in part]
        src.append(pa.array([r[0] for r in found], pa.list_(pa.int32())))
        tgt.append(pa.array([r[1] for r in found], pa.list_(pa.int32())))
    whole = lambda parts: pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([whole(src), whole(tgt)], names=["src", "tgt"])


_seq_diff = _seq_diff.asNondeterministic()


def seq_diff(a: Column | str, b: Column | str) -> Column:
    """Struct of src and tgt: the changed indices of two token arrays; null arrays count as empty.

    Named nondeterministic, so that filters on it aren't pushed below it: each would find it anew, in Python workers of its own.
    """
    return _seq_diff(a, b)


def single_insertion(original: str, edited: str, min_chars: int = 0, min_words: int = 0) -> tuple[str, str, str] | None:
    """(common prefix, rest of the original, text inserted after the prefix), or None if the edit doesn't start with an insertion.

    The inserted text must have more than min_chars characters and more than min_words words. Equal texts give None.
    """
    ops = SequenceMatcher(None, original, edited).get_opcodes()
    if len(ops) < 2 or ops[0][0] != "equal" or ops[1][0] != "insert":
        return None
    _, at, _, start, end = ops[1]
    new = edited[start:end]
    if end - start <= min_chars or len(new.split()) <= min_words:
        return None
    return original[:at], original[at:], new


def insertion_column(original, edited, min_chars: int = 100, min_words: int = 10):
    """single_insertion() as a column: struct of prefix, original, edited; null if there is none."""

    @F.pandas_udf(_INSERTION)
    def found(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [single_insertion(x or "", y or "", min_chars, min_words) or (None, None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["prefix", "original", "edited"])

    made = found(original, edited)
    return F.when(made["edited"].isNotNull(), made)


def _grams(tokens: list[str], most: int = 4) -> list[Counter]:
    return [Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)) for n in range(1, most + 1)]


def _bleu(reference: list[str], candidate: list[str], theirs: list[Counter], own: list[Counter]) -> float:
    """bleu() of two sentences with their n-grams."""
    if not candidate or not reference:
        return 0.0
    logs, most = 0.0, len(own)
    for n in range(most):
        a, b = own[n], theirs[n]
        small, large = (a, b) if len(a) < len(b) else (b, a)
        shared = sum(min(k, large[g]) for g, k in small.items() if g in large)
        if not shared:
            return 0.0
        logs += math.log(shared / (len(candidate) - n)) / most
    short = min(0.0, 1 - len(reference) / len(candidate))
    return math.exp(logs + short)


def bleu(reference: list[str], candidate: list[str], most: int = 4) -> float:
    """Sentence BLEU with uniform weights over 1 to 4 word n-grams, unsmoothed, with brevity penalty."""
    return _bleu(reference, candidate, _grams(reference, most), _grams(candidate, most))


def best_matches(source: list[list[str] | None], target: list[list[str] | None], window: int) -> list[tuple[int, int, float]]:
    """(i, j, BLEU) of each source sentence and its best target sentence (of equal ones the first) from window before it to
    window - 1 after; sentences with none there go. Null sentences count as empty."""
    src, tgt = [[s or [] for s in x] for x in (source, target)]
    grams: dict[int, list[Counter]] = {}
    found = []
    for i, s in enumerate(src):
        lo, hi = max(0, i - window), min(len(tgt), i + window)
        if lo >= hi:
            continue
        for j in [j for j in grams if j < lo]:
            del grams[j]
        own = _grams(s)
        for j in range(lo, hi):
            if j not in grams:
                grams[j] = _grams(tgt[j])
        score, minus = max((_bleu(s, tgt[j], own, grams[j]), -j) for j in range(lo, hi))
        found.append((i, -minus, score))
    return found


def best_matches_column(source: Column | str, target: Column | str, window: int) -> Column:
    """best_matches() as a column: array of (i, j, score); null arrays count as empty."""
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf(_MATCHES)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        parts = [pa.array([[{"i": i, "j": j, "score": score} for i, j, score in best_matches(x, y, window)] for x, y in part], kind) for part in _parts(a, b)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run.asNondeterministic()(source, target)


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def aligned_groups(source: list[list[str]], target: list[list[str]], window: int, cutoff: float) -> list[tuple[list[int], list[int]]]:
    """Connected components of sentences whose BLEU is over the cutoff in either direction, within a window of positions."""
    parent = list(range(len(source) + len(target)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(source):
        for j in range(max(0, i - window), min(len(target), i + window)):
            if max(bleu(s, target[j]), bleu(target[j], s)) > cutoff:
                parent[root(i)] = root(len(source) + j)
    found: dict[int, tuple[list[int], list[int]]] = {}
    for x in range(len(parent)):
        group = found.setdefault(root(x), ([], []))
        group[x >= len(source)].append(x if x < len(source) else x - len(source))
    return sorted(((a, b) for a, b in found.values() if a and b), key=lambda g: g[0][0])


_GROUPS = T.ArrayType(T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("source", "target")]))


def aligned_column(source, target, window: int, cutoff: float):
    """aligned_groups() as a column: array of (source, target), the sentence numbers of each group; null arrays count as empty."""

    @F.pandas_udf(_GROUPS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        sents = lambda x: [list(s) for s in x] if x is not None else []
        return pd.Series([[{"source": s, "target": t} for s, t in aligned_groups(sents(x), sents(y), window, cutoff)] for x, y in zip(a, b, strict=True)], dtype=object)

    return run(source, target)


def first_divergence(original: str, edited: str, at_space: bool = False) -> int:
    """The first offset at which two texts differ; at_space: pulled back behind the last white space before it."""
    n = min(len(original), len(edited))
    i = next((k for k in range(n) if original[k] != edited[k]), max(0, n - 1))
    if at_space and n and edited[i] not in "\n ":
        back = max(edited.rfind(" ", 0, i), edited.rfind("\n", 0, i))
        return back + 1
    return i
