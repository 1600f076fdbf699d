"""Row filters: each factory gives a transform of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import arrays, text
from palimpsest.pipeline import Transform


def where(condition: Column) -> Transform:
    return lambda df: df.filter(condition)


def page_ids(ids: Sequence[str], column: str = "page_id") -> Transform:
    return where(F.col(column).isin(list(ids)))


def first_pages(n: int, page: str = "page_id", order: Sequence[str] = ("file", "seq")) -> Transform:
    """Rows of the n pages that begin first: each page's first row is found, and the least n of those are joined."""

    def run(df: DataFrame) -> DataFrame:
        begin = df.groupBy(page).agg(F.min(F.struct(*order)).alias("own_first")).orderBy("own_first", page).limit(n)
        return df.join(begin.select(page), page, "left_semi")

    return run


def has_comment(column: str = "comment_text") -> Transform:
    return where(F.length(column) > 0)


def length_between(column: str, least: int, most: int) -> Column:
    """least <= characters < most"""
    return (F.length(column) >= least) & (F.length(column) < most)


def comment_length(least: int, most: int, column: str = "comment_text") -> Transform:
    return where(length_between(column, least, most))


def comment_token_length(least: int, most: int, column: str = "comment_text") -> Transform:
    """Tokens between single spaces: two spaces in a row have an empty token between them."""
    n = F.size(F.split(column, " ", -1))
    return where((n >= least) & (n < most))


def comment_blocklist(parts: Sequence[str] = text.COMMENT_BLOCKLIST, column: str = "comment_text") -> Transform:
    return where(~text.contains_any(F.col(column), parts))


def text_length(least: int, most: int, columns: Sequence[str] = ("src_text", "tgt_text")) -> Transform:
    return lambda df: df.filter(length_between(columns[0], least, most) & length_between(columns[1], least, most))


def exclude_titles(parts: Sequence[str], column: str = "page_title") -> Transform:
    """Drops titles that contain a part anywhere."""
    return where(~text.contains_any(F.col(column), parts))


def has_section_title(column: str = "section_title") -> Transform:
    return where(F.length(column) > 0)


def not_empty(column: str) -> Transform:
    """Keeps rows whose array has elements."""
    return where(F.size(column) > 0)


def has_urls(src: bool = True, tgt: bool = True) -> Transform:
    """Adds grounding_urls, the distinct URLs of the chosen sides, and keeps rows that have some."""
    sides = [F.col(c) for c, on in (("src_urls", src), ("tgt_urls", tgt)) if on]

    def run(df: DataFrame) -> DataFrame:
        every = F.array_distinct(F.concat(*sides)) if sides else F.array().cast("array<string>")
        return df.withColumn("grounding_urls", every).filter(F.size("grounding_urls") > 0)

    return run


def domain_whitelist(domains: Sequence[str], columns: Sequence[str] = ("src_urls", "tgt_urls", "grounding_urls"), by_host: bool = False) -> Transform:
    """Keeps listed URLs in each array column, and rows that have any left."""
    test = text.host_whitelisted if by_host else text.whitelisted

    def run(df: DataFrame) -> DataFrame:
        own = [c for c in columns if c in df.columns]
        df = df.withColumns({c: F.filter(c, lambda u: test(u, domains)) for c in own})
        return df.filter(sum((F.size(c) for c in own), F.lit(0)) > 0)

    return run


def languages(langs: Sequence[str], column: str) -> Transform:
    """Keeps array elements in one of the languages."""
    return lambda df: df.withColumn(column, F.filter(column, lambda x: text.language(x).isin(list(langs))))


def single_edit_span(df: DataFrame) -> DataFrame:
    """Rows with exactly one span of edited target tokens."""
    return df.filter(F.size("tgt_token_diffs") == 1).drop("tgt_token_diffs")


def additions(least: int, most: int) -> Transform:
    """Rows that only add tokens: no source token changed, and least <= added < most."""
    added = F.size("tgt_token_diff")
    return where((F.size("src_token_diff") == 0) & (added == F.size("tgt_tokens") - F.size("src_tokens")) & (added >= least) & (added < most))


def min_context(left: int = 0, right: int = 0) -> Transform:
    """Rows whose context sentences have at least so many tokens; 0 asks nothing."""
    n = lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + F.size(s))
    return where((F.lit(not left) | (n("left_context") >= left)) & (F.lit(not right) | (n("right_context") >= right)))


def has_diff(df: DataFrame) -> DataFrame:
    """Rows with a changed token on either side, none of them before the first."""
    first = F.coalesce(F.get("src_token_diff", 0), F.lit(0)), F.coalesce(F.get("tgt_token_diff", 0), F.lit(0))
    return df.filter(((F.size("src_token_diff") > 0) | (F.size("tgt_token_diff") > 0)) & (first[0] >= 0) & (first[1] >= 0))


def no_words(words: Sequence[str], columns: Sequence[str]) -> Transform:
    """Drops rows in one of whose columns a listed word occurs, in lower case and as a whole word."""
    listed = [w.lower() for w in words]
    return where(~text.any_of([F.exists(text.words(F.lower(c)), lambda w: w.isin(listed)) for c in columns]))


#: Characters that betray leftovers of markup.
PUNCTUATION = ("[", "]", "|", "/", "\\", "$", "#", "@", "%")


def no_punctuation(columns: Sequence[str], blocked: Sequence[str] = PUNCTUATION) -> Transform:
    return where(~text.any_of([text.contains_any(F.col(c), blocked) for c in columns]))


def contiguous_edit(src: str = "src_diff", tgt: str = "tgt_diff", out: str = "type") -> Transform:
    """Adds deletion or insertion where only one side changed, in one run; drops other rows."""
    kind = F.when((F.size(tgt) == 0) & arrays.is_contiguous(F.col(src)), "deletion").when((F.size(src) == 0) & arrays.is_contiguous(F.col(tgt)), "insertion")
    return lambda df: df.withColumn(out, kind).filter(F.col(out).isNotNull())


def valid_pair(df: DataFrame) -> DataFrame:
    """A URL on either side, URL lists that differ, and both targets under 100 words."""
    short = lambda c: F.size(text.space_words(F.col(c))) < 100
    return df.filter((F.size("urls_edit") + F.size("urls_orig") > 0) & (F.col("urls_edit") != F.col("urls_orig")) & short("target_edit") & short("target_orig"))


def url_sides(both: bool) -> Transform:
    """Rows with URLs on both sides, or on either."""
    a, b = F.size("urls_orig") > 0, F.size("urls_edit") > 0
    return where(a & b if both else a | b)


def target_quality(column: str = "target", least: int = 50) -> Column:
    """No pipe, `least` characters or more, and a full stop at the end."""
    return ~F.contains(F.col(column), F.lit("|")) & (F.length(column) >= least) & F.endswith(F.col(column), F.lit("."))


def keep_page(disambiguation: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Transform:
    """Articles (namespace 0) that aren't redirects; optionally no disambiguation pages (a pattern at the start of a line),
    none of the excluded categories and one of the included ones."""
    ok = (F.col("ns") == "0") & F.col("redirect").isNull()
    if disambiguation:
        ok &= ~F.regexp_like("text", F.lit(f"(?m)^(?:{disambiguation})"))
    strings = lambda values: F.array(*[F.lit(v) for v in values])
    if exclude:
        ok &= ~F.arrays_overlap("categories", strings(exclude))
    if include:
        ok &= F.arrays_overlap("categories", strings(include))
    return where(ok)


def comment_accepted(least: int, column: str = "comment_text") -> Column:
    """`least` tokens or more and none of the tools' markers."""
    return (F.size(text.space_words(F.col(column))) >= least) & ~text.contains_any(F.col(column), text.COMMENT_BLOCKLIST)


def comment_rejected(comment: Column, n_changed: Column, most: int) -> Column:
    """No or too many changes; a comment without a section mark or with nothing else; a revert or undo."""
    c = F.trim(comment)
    return (n_changed == 0) | (n_changed > most) | ~F.startswith(c, F.lit("/*")) | F.endswith(c, F.lit("*/")) | F.regexp_like(c, F.lit("(?i)(revert|undo|undid)"))


def enough_unchanged(least: int = 10) -> Transform:
    return where(F.size("tgt_sents") - F.size("tgt_sent_diff") >= least)
