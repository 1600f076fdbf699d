"""Corpora of comments, atomic edits and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import python, wikitext
from palimpsest.operators import edits, filters, sampling
from palimpsest.pipeline import chain
from palimpsest.sources import sinks


def comment_corpus(revisions: DataFrame, fraction: float, window: int = 10, negatives: int = 10, least_comment: int = 20, least_tokens: int = 3) -> DataFrame:
    """Sampled revisions with a comment on a section: token contexts and actions of both versions, negative comments.

    A revision is taken by the hash of its id, so reruns agree; its predecessor is the page's revision before it, and has
    to be its parent.
    """
    pairs = edits.revision_pairs(revisions.withColumn("own_rev", F.col("rev_id")).withColumn("text", F.col("text")))
    before = edits.revision_pairs(revisions.select("page_id", "file", "seq", "rev_id"), value="rev_id").select("page_id", "file", "seq", F.col("src_text").alias("before_id"))
    rows = edits.describe_pairs(pairs.join(before, ["page_id", "file", "seq"]).filter("before_id = parent_id").drop("own_rev"))
    rows = rows.filter((F.length("comment_text") >= least_comment) & filters.comment_accepted(least_tokens))
    rows = chain(rows, [edits.negatives_before("page_id", ["file", "seq"], "comment_text"), sampling.hash_sample(fraction, "rev_id"), edits.restrict_to_section, edits.clean_markup, filters.text_length(1, 1_000_000)])
    rows = rows.withColumn("neg_cmnts", sampling.k_of_array(F.col("negatives"), negatives, F.col("rev_id"))).drop("negatives")
    rows = chain(rows, [edits.tokenize, edits.token_diff, edits.changed_sentences()])
    positive = F.transform("tgt_sent_diff", lambda i: F.array_join(F.get(F.col("tgt_sents"), i), " "))
    others = F.array_except(F.transform("tgt_sents", lambda s: F.array_join(s, " ")), positive)
    rows = rows.withColumn("pos_edits", positive).withColumn("neg_edits", sampling.k_of_array(others, negatives, F.col("rev_id")))
    return edits.token_context(window)(rows)


def recontext(rows: DataFrame, window: int = 10) -> DataFrame:
    """Samples with whole token arrays cut to another window."""
    return edits.token_context(window)(rows)


def with_comments(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Samples with the comment and negatives of their revision (rev_id); samples without go."""
    return rows.join(comments, "rev_id")


def shuffled_corpus(rows: DataFrame, seed: int, least_unchanged: int = 10) -> DataFrame:
    return chain(rows, [filters.enough_unchanged(least_unchanged), sampling.shuffled(seed)])


def sample_pages(pages: DataFrame, fraction: float, path: str) -> None:
    """Writes a share of the raw pages (page) as bzip2 text, chosen by their hash."""
    sinks.write_lines(sampling.hash_sample(fraction, "page")(pages), path, F.col("page"), compression="bzip2")


def atomic_edits(revisions: DataFrame, window: int = 5, context: int = 20, most: int = 0) -> DataFrame:
    """Sentences with one contiguous insertion or deletion, matched within the section that the comment names."""
    rows = edits.describe_pairs(edits.revision_pairs(revisions))
    rows = chain(rows, [filters.exclude_titles(("User:", "Talk:")), filters.has_section_title(), filters.has_comment(), edits.restrict_to_section, edits.process_references])
    rows = rows.withColumns({c: python.unescape_html(c) for c in ("src_text", "tgt_text")})
    rows = chain(rows, [edits.clean_markup, edits.tokenize, edits.match_sentences(window, context)])
    rows = rows.withColumn("own", python.seq_diff("source.tokens", "target.tokens")).withColumns({"src_diff": F.col("own.src"), "tgt_diff": F.col("own.tgt")}).drop("own")
    rows = rows.filter(F.col("source.sentence") != F.col("target.sentence"))
    rows = rows.withColumns({"own_s": F.col("source.sentence"), "own_t": F.col("target.sentence")})
    rows = chain(rows, [filters.no_punctuation(["own_s", "own_t"]), filters.contiguous_edit()]).drop("own_s", "own_t")
    return rows.limit(most) if most else rows


def documents(pages: DataFrame, templates: tuple[dict, dict] = ({}, {}), options: wikitext.WikitextOptions = wikitext.WikitextOptions(), **keep) -> DataFrame:
    """(id, revid, title, text) of article pages (sources.dumps.read_pages); pages without text go."""
    found = wikitext.extract(filters.keep_page(**keep)(pages), templates, options)
    return found.filter(F.size("lines") > 0).select("id", "revid", "title", F.array_join("lines", "\n").alias("text"))
