"""Scores of targets given a source and a context, by any language model, and how often the true source wins.

A scorer has score(contexts, targets) -> list of lists: minus the log probability of each target token. It is made once in
each task by a function, so that models needn't be sent.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import arrays, text


class Scorer(Protocol):
    def score(self, contexts: Sequence[Sequence[str]], targets: Sequence[Sequence[str]]) -> list[list[float]]: ...


class NgramScorer:
    """An add-k unigram model of the context, over the words of context and target: a stand-in where there is no model."""

    def __init__(self, k: float = 0.1):
        self.k = k

    def score(self, contexts, targets):
        out = []
        for context, target in zip(contexts, targets, strict=True):
            seen, kinds = Counter(context), len({*context, *target})
            total = len(context) + self.k * kinds
            out.append([-math.log((seen[w] + self.k) / total) for w in target])
        return out


def token_nll(context: Column, target: Column, make_scorer: Callable[[], Scorer] = NgramScorer) -> Column:
    """Array of minus log probabilities of the target's tokens."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(contexts: pd.Series, targets: pd.Series) -> pd.Series:
        empty = lambda s: [list(x) if x is not None else [] for x in s]
        return pd.Series(make_scorer().score(empty(contexts), empty(targets)))

    return run(context, target)


def nll(context: Column, target: Column, make_scorer: Callable[[], Scorer] = NgramScorer) -> Column:
    return F.aggregate(token_nll(context, target, make_scorer), F.lit(0.0), lambda acc, x: acc + x)


def score_pairs(dataset: DataFrame, make_scorer: Callable[[], Scorer] = NgramScorer, most: int = 1024, context_first: bool = False) -> DataFrame:
    """dataset (grounding_true, grounding_false, context, target) with score_true and score_false, cut to `most` tokens."""
    toks = lambda c: text.tokens(F.coalesce(c, F.lit("")))
    rows = dataset.withColumn("own_target", toks("target"))
    for side in ("true", "false"):
        cut = arrays.trimmed(toks(f"grounding_{side}"), toks("context"), F.col("own_target"), most, context_first)
        rows = rows.withColumn("own_cut", cut).withColumn(f"score_{side}", nll(F.concat("own_cut.grounding", "own_cut.context"), F.col("own_target"), make_scorer)).drop("own_cut")
    return rows.drop("own_target")


def margin_accuracy(scores: DataFrame, margins: Sequence[float] = (0.0, math.log(100))) -> DataFrame:
    """(margin, n, accuracy): the share of rows whose false score is over the true one by more than the margin."""
    wins = [F.avg(F.when(F.col("score_false") - F.col("score_true") > m, 1.0).otherwise(0.0)).alias(f"a{i}") for i, m in enumerate(margins)]
    rows = F.array(*[F.struct(F.lit(float(m)).alias("margin"), F.col("n"), F.col(f"a{i}").alias("accuracy")) for i, m in enumerate(margins)])
    return scores.agg(F.count(F.lit(1)).alias("n"), *wins).select(F.explode(rows).alias("r")).select("r.*")


def load_natural(rows: DataFrame) -> DataFrame:
    """Distinct examples (grounding_true, grounding_false, context, target) whose target is a clean sentence."""
    from palimpsest.operators.filters import target_quality

    return rows.select("grounding_true", "grounding_false", "context", "target").filter(target_quality()).distinct()


def load_synthetic(rows: DataFrame, skip: Sequence[int] = (14,)) -> DataFrame:
    """Examples of sources.dumps.read_synthetic() without those at some positions, doubled (see counterfactuals())."""
    from palimpsest.operators.grounding import counterfactuals

    return counterfactuals(rows.filter(~F.col("pos").isin(list(skip))))
