"""From revision dumps to filtered edits, and from edits to insertion triples and clean pairs."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import python, text
from palimpsest.functions.python import first_divergence
from palimpsest.operators import edits, filters
from palimpsest.pipeline import Funnel, chain

#: Title parts of pages that aren't articles.
PAGE_TYPES = ("Talk:", "User talk:", "Wikipedia talk:", "Template talk:", "User:", "Wikipedia:")


def edit_steps(least_text: int = 5, most_text: int = 10_000_000, least_added: int = 3, most_added: int = 100, most_distance: int = 1, min_left: int = 10) -> list:
    """The named steps of extract_additions(); native predicates first, then markup, tokens and diffs."""
    return [
        ("article pages", filters.exclude_titles(PAGE_TYPES)),
        ("no tool edits", filters.comment_blocklist()),
        ("text length", filters.text_length(least_text, most_text)),
        ("find urls", edits.clean_urls()),
        ("has urls", filters.has_urls(src=True, tgt=True)),
        ("strip markup", edits.clean_markup),
        ("clean newlines", edits.clean_newlines()),
        ("tokenize", edits.tokenize),
        ("changed sentences", edits.prune_to_changed_sentences),
        ("token diff", edits.token_diff),
        ("valid diff", filters.has_diff),
        ("spans", edits.edit_spans),
        ("single span", filters.single_edit_span),
        ("additions", filters.additions(least_added, most_added)),
        ("near urls", edits.url_distance(most_distance)),
        ("has grounding", filters.not_empty("grounding_urls")),
        ("context", edits.sentence_context(1, 1)),
        ("enough context", filters.min_context(min_left, 0)),
    ]


def extract_additions(revisions: DataFrame, funnel: Funnel | None = None, **options) -> DataFrame:
    """Single-span additions next to a cited URL, with context, from revisions (sources.dumps.read_revisions)."""
    pairs = edits.describe_pairs(edits.revision_pairs(revisions))
    steps = edit_steps(**options)
    return funnel.chain(pairs, steps) if funnel else chain(pairs, [s for _, s in steps])


IDS = ("rev_id", "page_id", "parent_id", "timestamp", "diff_url")


def insertion_triples(rows: DataFrame, domains: Sequence[str] | None = None, min_chars: int = 100, min_words: int = 10, with_urls: bool = False) -> DataFrame:
    """prefix, original and edited of edits that insert text (original_src_text, original_tgt_text) citing a listed URL.

    with_urls adds urls_orig and urls_edit, the URLs of the two texts. Equal texts and other edits give no row.
    """
    found = rows.withColumn("own", python.insertion_column("original_src_text", "original_tgt_text", min_chars, min_words)).filter("own IS NOT NULL")
    urls = text.urls(F.col("own.edited"))
    found = found.filter(F.size(urls) > 0) if domains is None else found.filter(F.exists(urls, lambda u: text.whitelisted(u, domains)))
    sides = [text.urls(F.col("original_src_text")).alias("urls_orig"), text.urls(F.col("original_tgt_text")).alias("urls_edit")] if with_urls else []
    return found.select("own.*", *[c for c in IDS if c in rows.columns], *sides)


_REF = re.compile(r"<ref.*?</ref>", re.S)
_MARK = re.compile(r"<\|REF\|(\d+)\|>")
_URL = re.compile(text.URL)
_ENDS = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[<]?[A-Z0-9|])")
_PAIR = T.StructType([T.StructField("context", T.StringType()), T.StructField("target_edit", T.StringType()), T.StructField("urls_edit", T.ArrayType(T.StringType())), T.StructField("target_orig", T.StringType()), T.StructField("urls_orig", T.ArrayType(T.StringType()))])


def mark_references(source: str) -> tuple[str, list[str]]:
    """The text with each <ref> as a numbered mark, and the references; leftovers of tags go to the line's end."""
    refs: list[str] = []

    def mark(m: re.Match) -> str:
        if m[0] not in refs:
            refs.append(m[0])
        return f" <|REF|{refs.index(m[0])}|> "

    marked = _REF.sub(mark, source)
    return re.sub(r"<(?:ref|br)[^|\n].*>", "", marked), refs


def _tidy(source: str) -> str:
    words = []
    for word in source.translate(str.maketrans("", "", "[]")).split(" "):
        parts = word.split("\n")
        words.append(" ".join([p for p in parts if re.search(r"[a-zA-Z0-9']", p)] if len(parts) > 1 else parts).strip())
    return " ".join(words).strip()


def first_target(source: str, refs: list[str], domains: Sequence[str] | None = None) -> tuple[str, list[str]]:
    """The first sentence (of 10 characters or more: shorter ones take the next one in, which stays in its place too) and
    the URLs of the references in it and of one that opens the next sentence."""
    sentences = [s for s in _ENDS.split(_tidy(source)) if s] or [""]
    while len(sentences[0]) < 10 and len(sentences) > 1:
        grown = sentences[0] + sentences[1]
        if len(grown) == len(sentences[0]):
            break
        sentences[0] = grown
    marks = _MARK.findall(sentences[0])
    if len(sentences) > 1 and sentences[1].startswith("<|REF"):
        marks += _MARK.findall(sentences[1])[:1]
    urls = [u.replace("</ref>", "") for m in marks if int(m) < len(refs) for u in _URL.findall(refs[int(m)])]
    if domains is not None:
        urls = [u for u in urls if any(d in u for d in domains)]
    return _MARK.sub(" ", sentences[0]).strip(), urls


def clean_pair(original: str, edited: str, domains: Sequence[str] | None = None) -> tuple | None:
    """(context, target_edit, urls_edit, target_orig, urls_orig) of an edit from where its texts part; None if they don't."""
    a, refs_a = mark_references(original)
    b, refs_b = mark_references(edited)
    if a == b:
        return None
    at = first_divergence(a, b, at_space=True)
    before = [s for s in _ENDS.split(_tidy(_MARK.sub("", b[:at]))) if s]
    return " ".join(before[-3:]), *first_target(b[at:], refs_b, domains), *first_target(a[at:], refs_a, domains)


def clean_edit_pairs(rows: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """context, targets and their URLs, and previews og_edit and og_orig; rows that fail or aren't valid go."""

    @F.pandas_udf(_PAIR)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [clean_pair(x or "", y or "", domains) or (None, None, None, None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=[f.name for f in _PAIR])

    made = rows.withColumn("own", run("original_src_text", "original_tgt_text")).filter("own.context IS NOT NULL")
    previews = [F.substring(c, 1, 600).alias(n) for c, n in (("original_tgt_text", "og_edit"), ("original_src_text", "og_orig"))]
    return filters.valid_pair(made.select("own.*", *previews, *[c for c in IDS if c in rows.columns]))
