"""Windows of sentences (token lists) around an edit: grown to a number of tokens, found again, trimmed of what both sides share."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Sentence = Sequence[str]


def n_tokens(sents: Sequence[Sentence]) -> int:
    return sum(map(len, sents))


def grown(sents: Sequence[Sentence], start: int, end: int, most_tokens: int = 200, most_added: int = 2) -> tuple[list, int]:
    """Sentences start to end with neighbours, one on each side by turns, while there are at most most_tokens and neither side
    has most_added more; and the number of tokens before them."""
    a, b = start, end + 1
    while n_tokens(sents[a:b]) <= most_tokens and b - a < len(sents) and start - a < most_added and b - end - 1 < most_added:
        a, b = max(0, a - 1), min(len(sents), b + 1)
    return list(sents[a:b]), n_tokens(sents[:a])


def located(sents: Sequence[Sentence], first: Sentence, last: Sentence) -> tuple[list, int] | None:
    """The sentences from the one that contains `first` to the one that contains `last` (as text), and the tokens before them."""
    joined = [" ".join(s) for s in sents]
    b = next((i for i, s in enumerate(joined) if " ".join(last) in s), None)
    if b is None:
        return None
    a = next((i for i, s in enumerate(joined[: b + 1]) if " ".join(first) in s), None)
    return None if a is None else (list(sents[a : b + 1]), n_tokens(sents[:a]))


def trimmed(source: Sequence[Sentence], target: Sequence[Sentence], most_tokens: int = 200) -> tuple[list, list, int] | None:
    """Both sides without equal sentences at their starts and ends, taken away by turns until neither has over most_tokens;
    and the tokens taken from the start. None if they stay longer."""
    long = lambda: max(n_tokens(source), n_tokens(target)) > most_tokens
    before, moved = 0, True
    while long() and moved:
        moved = False
        for end in (0, -1):
            if (long() or end) and source and target and list(source[end]) == list(target[end]):
                before += len(source[0]) if end == 0 else 0
                source, target = (source[1:], target[1:]) if end == 0 else (source[:-1], target[:-1])
                moved = True
    return None if long() else (list(source), list(target), before)


def rebased(diff: Sequence[int], before: int) -> list[int]:
    """Indices after `before` tokens were taken from the start; one that falls just before the start goes."""
    moved = [i - before for i in diff]
    return moved[1:] if moved and moved[0] == -1 else moved


_WINDOW = T.StructType([T.StructField("sents", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("before", T.IntegerType())])


def grown_column(sents, first, last, most_tokens: int = 200, most_added: int = 2):
    """grown() as a column: struct of sents and before; null where the sentence numbers aren't in the array."""
    @F.pandas_udf(_WINDOW)
    def run(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, i, j in zip(s, a, b, strict=True):
            found = [list(t) for t in x] if x is not None else []
            ok = i is not None and j is not None and 0 <= i <= j < len(found)
            rows.append(grown(found, int(i), int(j), most_tokens, most_added) if ok else (None, None))
        return pd.DataFrame({"sents": [r[0] for r in rows], "before": pd.array([r[1] for r in rows], dtype="Int32")})

    return run(sents, first, last)


_LOCATED = _WINDOW
_TRIMMED = T.StructType([T.StructField(n, T.ArrayType(T.ArrayType(T.StringType()))) for n in ("source", "target")] + [T.StructField("before", T.IntegerType())])


def _sents(x) -> list[list[str]]:
    return [list(t) for t in x] if x is not None else []


def located_column(sents, first, last):
    """located() as a column: struct of sents and before; null fields where the sentences aren't found."""

    @F.pandas_udf(_LOCATED)
    def run(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None if i is None or j is None else located(_sents(x), list(i), list(j))) or (None, None) for x, i, j in zip(s, a, b, strict=True)]
        return pd.DataFrame({"sents": [r[0] for r in rows], "before": pd.array([r[1] for r in rows], dtype="Int32")})

    return run(sents, first, last)


def trimmed_column(source, target, most_tokens: int = 200):
    """trimmed() as a column: struct of source, target and before; null fields where the sides stay too long."""

    @F.pandas_udf(_TRIMMED)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [trimmed(_sents(x), _sents(y), most_tokens) or (None, None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"source": [r[0] for r in rows], "target": [r[1] for r in rows], "before": pd.array([r[2] for r in rows], dtype="Int32")})

    return run(source, target)


def rebased_column(diff, before):
    """rebased() as a column, of built-in functions."""
    moved = F.transform(diff, lambda i: i - before)
    return F.when(F.get(moved, 0) == -1, F.slice(moved, 2, F.size(moved))).otherwise(moved)


def first_changed_column(original, edited, text):
    """first_changed_sentence() as a column."""

    @F.pandas_udf(T.IntegerType())
    def run(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        plain = lambda x: list(x) if x is not None else []
        return pd.Series([first_changed_sentence(plain(x), plain(y), z or "") for x, y, z in zip(a, b, t, strict=True)], dtype="int32")

    return run(original, edited, text)


_MARK = re.compile(r"<\|REF\|.*?\|>")


def first_changed_sentence(original: Sequence[str], edited: Sequence[str], text: str) -> int:
    """The offset in the edited text behind all of its sentences before the first that differs, reference marks aside."""
    bare = lambda s: _MARK.sub("", s).strip()
    pairs = list(zip(original, edited, strict=False))
    same = next((k for k, (a, b) in enumerate(pairs) if bare(a) != bare(b)), max(0, len(pairs) - 1))
    at = 0
    for s in edited[:same]:
        at = max(at, text.find(s) + len(s))
    return at
