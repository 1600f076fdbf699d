"""From edits and crawled pages to pairs of examples that differ in their source, and to margin accuracy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import grounding, scoring
from palimpsest.sources.sinks import cstr_record


def texts_of_pages(pages: DataFrame) -> DataFrame:
    """(url, text) of pages (url, html): the longest article text of each valid URL."""
    rows = pages.filter(text.valid_url(F.col("url"))).select("url", text.main_article(F.col("html")).alias("text"))
    return grounding.longest_text(rows.filter("text <> ''"), "url")


def build_pairs(edits: DataFrame, pages: DataFrame, key: str = "rev_id") -> DataFrame:
    """Ablation pairs from edits (prefix, original, edited, urls_orig, urls_edit and a key) and crawled pages."""
    return grounding.ablation_pairs(grounding.article_texts(edits, texts_of_pages(pages), key))


def evaluate(dataset: DataFrame, make_scorer: Callable[[], scoring.Scorer] = scoring.NgramScorer, margins: Sequence[float] = (0.0, 6.907755278982137)) -> DataFrame:
    """Margin accuracy of a scorer over a dataset (grounding_true, grounding_false, context, target)."""
    return scoring.margin_accuracy(scoring.score_pairs(dataset, make_scorer), margins)


def attach_grounding(edits: DataFrame, index: DataFrame, pages: DataFrame, length: int = 100, least: int = 5, langs: Sequence[str] = ("en",)) -> DataFrame:
    """edits (rev_id, timestamp, grounding_urls, tgt_tokens, comment_text) with grounding_docs and grounding_snippets.

    index: url, filename, status of crawl records; pages: filename, html. For each URL the record nearest in time with
    status 200; of its text, the window with most of the edit's words. Edits without a snippet go.
    """
    wanted = edits.select(F.col("rev_id"), F.col("timestamp").alias("at"), F.posexplode("grounding_urls").alias("pos", "url"))
    wanted = wanted.withColumn("canonical", text.canonical_url(F.col("url"))).withColumn("row_id", F.struct("rev_id", "pos"))
    records = index.filter("status = '200'").select(text.canonical_url(F.col("url")).alias("canonical"), "filename", grounding.crawl_time(F.col("filename")).alias("taken"))
    chosen = grounding.nearest(wanted, records, ["canonical"], "at", "taken", "filename")
    docs = chosen.join(pages, "filename").select("rev_id", "pos", text.clean_newlines(text.html_to_text(F.col("html"))).alias("doc"))
    docs = docs.filter(text.language(F.col("doc")).isin(list(langs)))
    listed = docs.groupBy("rev_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc"))), lambda x: x["doc"]).alias("grounding_docs"))
    joined = edits.join(listed, "rev_id").withColumn("own_ref", grounding.reference_tokens(F.col("tgt_tokens"), F.col("comment_text")))
    made = joined.withColumn("grounding_snippets", grounding.snippets(F.col("grounding_docs"), F.col("own_ref"), length, least)).drop("own_ref")
    return made.filter(F.size("grounding_snippets") > 0)


def to_cstr(rows: DataFrame, frequency: DataFrame, key: str = "rev_id") -> DataFrame:
    """(counter, record): rows (left_text, tgt_tokens, tgt_text, grounding_snippets) as records of several lines.

    counter numbers the rows in the order of the key: a distributed sort, then numbers by partition.
    """
    tokens = rows.select(key, F.col("tgt_tokens").alias("target"), F.flatten(F.transform("grounding_snippets", text.tokens)).alias("grounding"))
    joined = rows.join(grounding.control_tokens(tokens, frequency, key), key)
    made = joined.select(key, F.col("left_text").alias("context"), F.col("tgt_text").alias("target"), F.col("grounding_snippets").alias("groundings"), "control")
    numbered = made.orderBy(key).rdd.zipWithIndex().map(lambda x: (x[1], *x[0][1:])).toDF("counter long, context string, target string, groundings array<string>, control string")
    return numbered.select("counter", cstr_record().alias("record"))
