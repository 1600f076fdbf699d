"""Revisions as a stream: each one paired with the page's revision before it, and URLs let through once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "page_id string, seq long, src_text string, tgt_text string"
_STATE = "seq long, text string"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("seq")
    last = state.get if state.exists else None
    made = []
    for seq, text in zip(rows["seq"], rows["text"], strict=True):
        if last is not None and seq <= last[0]:
            continue
        if last is not None:
            made.append((key[0], seq, last[1], text))
        last = (int(seq), text)
    if last is not None:
        state.update(last)
    yield pd.DataFrame(made, columns=["page_id", "seq", "src_text", "tgt_text"])


def revision_pairs(stream: DataFrame) -> DataFrame:
    """(page_id, seq, src_text, tgt_text) from a stream (page_id string, seq long, text string).

    The state is each page's latest revision. A page's revisions may come in any order within a micro-batch; one that
    comes in a later batch than a newer one is left out.
    """
    return stream.groupBy("page_id").applyInPandasWithState(_pair, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def new_urls(stream: DataFrame, column: str = "url", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows whose URL hasn't come within the delay: the work-list of a fetcher. State goes once the watermark passes it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([column])


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "1 hour", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Rows by time window and a column, late ones up to the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n"))


def fetch_progress(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """(url, ts) of each URL's first result that isn't an error (error null): what a fetcher that starts anew needn't ask for again.

    The stream's checkpoint is the crawl's state; a URL that failed passes once it succeeds. Late results come up to the delay.
    """
    return stream.filter("error IS NULL").withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"]).select("url", time)


def outcome_counts(stream: DataFrame) -> DataFrame:
    """Results by outcome (found, empty or failed), for a query in update or complete mode."""
    outcome = F.when(F.col("error").isNull(), "found").when(F.col("error") == "empty", "empty").otherwise("failed")
    return stream.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
