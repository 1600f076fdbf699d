"""From revisions to edits: pairs, tokens, diffs, spans, contexts, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import arrays, python, text
from palimpsest.pipeline import Transform


def revision_pairs(revisions: DataFrame, page: str = "page_id", order: Sequence[str] = ("file", "seq"), value: str = "text") -> DataFrame:
    """revisions with src_text (the one before, of the same page) and tgt_text; a page's first revision gives no row."""
    before = Window.partitionBy(page).orderBy(*order)
    rows = revisions.withColumn("src_text", F.lag(value).over(before)).withColumn("nth", F.row_number().over(before))
    return rows.filter("nth > 1").drop("nth").withColumnRenamed(value, "tgt_text")


def describe_pairs(pairs: DataFrame) -> DataFrame:
    """Adds section_title, comment_text (the rest of the comment) and diff_url."""
    found = text.section_title(F.replace("comment", F.lit("([[WP:HC|HotCat]])"), F.lit("")))
    rows = pairs.withColumn("own_title", found)
    return rows.withColumns({"section_title": F.col("own_title.title"), "comment_text": F.col("own_title.rest"), "diff_url": text.diff_url(F.col("page_title"), F.col("rev_id"), F.col("parent_id"))}).drop("own_title", "comment")


def clean_urls(replacement: str = text.URL_TOKEN) -> Transform:
    """Adds src_urls, tgt_urls and the original texts; URLs in the texts become the replacement."""

    def run(df: DataFrame) -> DataFrame:
        for side in ("src", "tgt"):
            own = F.col(f"{side}_text")
            df = df.withColumns({f"{side}_urls": text.urls(own), f"original_{side}_text": own}).withColumn(f"{side}_text", text.without_urls(own, replacement))
        return df

    return run


def clean_newlines(columns: Sequence[str] = ("src_text", "tgt_text")) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.transform(c, text.clean_newlines) if kinds[c].startswith("array") else text.clean_newlines(F.col(c)) for c in columns})

    return run


def clean_markup(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.clean_wikitext(F.col(c)) for c in ("src_text", "tgt_text")})


def tokenize(df: DataFrame) -> DataFrame:
    """Adds *_sents (tokens of each sentence) and *_tokens for both sides."""
    for side in ("src", "tgt"):
        df = df.withColumn(f"{side}_sents", F.transform(text.sentences(F.col(f"{side}_text")), text.tokens)).withColumn(f"{side}_tokens", F.flatten(f"{side}_sents"))
    return df


def prune_to_changed_sentences(df: DataFrame) -> DataFrame:
    """Where both sides changed in sentences of the same numbers, tokens become those sentences'; without a change, no row."""
    changed = df.withColumn("own_diff", python.seq_diff(*[F.transform(f"{s}_sents", lambda x: F.array_join(x, " ")) for s in ("src", "tgt")]))
    same = F.col("own_diff.src") == F.col("own_diff.tgt")
    some = changed.filter((F.size("own_diff.src") > 0) | (F.size("own_diff.tgt") > 0))
    pick = lambda side: F.flatten(F.transform(f"own_diff.{side}", lambda i: F.get(F.col(f"{side}_sents"), i)))
    return some.withColumns({f"{s}_tokens": F.when(same, pick(s)).otherwise(F.col(f"{s}_tokens")) for s in ("src", "tgt")}).drop("own_diff")


def token_diff(df: DataFrame) -> DataFrame:
    """Adds src_token_diff and tgt_token_diff; rows without a change go."""
    made = df.withColumn("own_diff", python.seq_diff("src_tokens", "tgt_tokens"))
    return made.withColumns({"src_token_diff": F.col("own_diff.src"), "tgt_token_diff": F.col("own_diff.tgt")}).drop("own_diff").filter((F.size("src_token_diff") > 0) | (F.size("tgt_token_diff") > 0))


def edit_spans(df: DataFrame) -> DataFrame:
    return df.withColumn("tgt_token_diffs", arrays.spans(F.col("tgt_token_diff")))


def split_spans(df: DataFrame) -> DataFrame:
    """One row for each target span, as if it were the only change."""
    return df.withColumn("tgt_token_diff", F.explode("tgt_token_diffs")).withColumn("src_token_diff", F.array().cast("array<int>")).drop("tgt_token_diffs")


def url_distance(most: int, token: str = text.URL_TOKEN) -> Transform:
    """grounding_urls become those whose stand-in is fewer than `most` tokens from an edit; adds the distances."""

    def run(df: DataFrame) -> DataFrame:
        for side in ("src", "tgt"):
            df = df.withColumn(f"url_{side}_distances", arrays.distances(arrays.positions(F.col(f"{side}_tokens"), token), F.col(f"{side}_token_diff")))
        near = [arrays.urls_within(F.col(f"{s}_urls"), F.col(f"url_{s}_distances"), most) for s in ("tgt", "src")]
        return df.withColumn("grounding_urls", F.array_distinct(F.concat(*near)))

    return run


def token_context(window: int) -> Transform:
    """Tokens of both sides become the edited ones with `window` around; adds src_action and tgt_action."""

    def run(df: DataFrame) -> DataFrame:
        for side in ("src", "tgt"):
            made = arrays.token_context(F.col(f"{side}_tokens"), F.col(f"{side}_token_diff"), window)
            df = df.withColumn("own_made", made).withColumns({f"{side}_tokens": F.col("own_made.tokens"), f"{side}_action": F.col("own_made.action")}).drop("own_made")
        return df

    return run


def sentence_context(left: int = 1, right: int = 1, inclusive_end: bool = False) -> Transform:
    """The sentences of the edit and those around it.

    The target runs from the first edited token to the last, exclusive unless inclusive_end; the text right of it starts
    at the last edited token (or after it). Columns src_* go.
    """

    def run(df: DataFrame) -> DataFrame:
        diff, sents, toks = F.col("tgt_token_diff"), F.col("tgt_sents"), F.col("tgt_tokens")
        rows = df.filter(F.size(diff) > 0).withColumn("own_offsets", arrays.offsets(sents))
        rows = rows.withColumns({"own_first": F.get(diff, 0), "own_last": F.try_element_at(diff, F.lit(-1))})
        rows = rows.withColumns({"own_a": arrays.sentence_of(F.col("own_offsets"), F.col("own_first")), "own_b": arrays.sentence_of(F.col("own_offsets"), F.col("own_last"))})
        rows = rows.withColumns({"own_min": F.least("own_a", "own_b"), "own_max": F.greatest("own_a", "own_b")})
        lo, hi, first = F.col("own_min"), F.col("own_max"), F.col("own_first")
        last = F.col("own_last") + (1 if inclusive_end else 0)
        n = F.size("own_offsets")
        start = F.get("own_offsets", F.when(lo < 0, lo + n).otherwise(lo))
        end = F.get("own_offsets", hi + 1)
        rows = rows.withColumns({"left_context": arrays.py_slice(sents, lo - left, lo), "right_context": arrays.py_slice(sents, hi + 1, hi + 1 + right), "own_before": arrays.py_slice(toks, start, first), "own_after": arrays.py_slice(toks, last, end), "own_target": arrays.py_slice(toks, first, last), "tgt_sents": arrays.py_slice(sents, lo, hi + 1)})
        rows = rows.withColumns({"tgt_tokens": F.col("own_target"), "tgt_text": F.array_join("own_target", " "), "left_text": F.array_join(F.concat(F.flatten("left_context"), "own_before"), " "), "right_text": F.array_join(F.concat("own_after", F.flatten("right_context")), " ")})
        return rows.drop(*[c for c in rows.columns if c.startswith(("own_", "src_"))])

    return run


def changed_sentences(sents: str = "tgt_sents", diff: str = "tgt_token_diff", out: str = "tgt_sent_diff", tokens: str = "tgt_tokens", compat: bool = False) -> Transform:
    """Adds the numbers of the sentences that hold edited tokens; tokens of one character add none.

    With compat, the token that is tested for its length is that of the edit's own number (the first token for the first edit,
    and so on), and a sentence's end still takes in the next token.
    """
    def run(df: DataFrame) -> DataFrame:
        offs = F.col("own_offsets")
        place = (lambda i: F.least(F.size(F.filter(offs, lambda o: o < i)) - 1, F.size(sents) - 1)) if compat else lambda i: arrays.sentence_of(offs, i)
        token = (lambda i, k: F.get(tokens, k)) if compat else lambda i, k: F.get(tokens, i)
        long = F.filter(F.transform(diff, lambda i, k: F.when(F.length(token(i, k)) > 1, F.greatest(place(i), F.lit(0) if compat else F.lit(-1)))), lambda x: x.isNotNull())
        return df.withColumn("own_offsets", arrays.offsets(F.col(sents))).withColumn(out, F.array_sort(F.array_distinct(long))).drop("own_offsets")

    return run


def project(columns: Sequence[str]) -> Transform:
    """Those of the columns that there are."""
    return lambda df: df.select(*[c for c in columns if c in df.columns])


def drop_prefix(prefix: str) -> Transform:
    return lambda df: df.drop(*[c for c in df.columns if c.startswith(prefix)])


def restrict_to_section(df: DataFrame) -> DataFrame:
    """Both texts become the section that section_title names; rows without one on both sides go."""
    pick = lambda c: F.get(F.filter(text.sections(F.col(c)), lambda s: s["title"] == F.col("section_title")), 0)["text"]
    rows = df.filter(F.length("section_title") > 0).withColumns({"src_text": pick("src_text"), "tgt_text": pick("tgt_text")})
    return rows.filter((F.length("src_text") > 0) & (F.length("tgt_text") > 0))


def split_sections(df: DataFrame) -> DataFrame:
    """One row for each source section with a target section of that title (the last one of a title): section, src_text, tgt_text."""
    both = df.withColumn("own_src", F.explode(text.sections(F.col("src_text")))).withColumn("own_tgt", F.try_element_at(F.filter(text.sections(F.col("tgt_text")), lambda s: s["title"] == F.col("own_src.title")), F.lit(-1)))
    kept = both.filter(F.col("own_tgt").isNotNull())
    return kept.withColumns({"section_title": F.col("own_src.title"), "src_text": F.col("own_src.text"), "tgt_text": F.col("own_tgt.text")}).drop("own_src", "own_tgt")


def process_references(df: DataFrame) -> DataFrame:
    """Adds refs, the target's references; both texts go on without theirs."""
    return df.withColumn("refs", text.references(F.col("tgt_text"))).withColumns({c: text.without_references(F.col(c)) for c in ("src_text", "tgt_text")})


def match_sentences(window: int = 5, context: int = 20) -> Transform:
    """One row for each source sentence with its best match (BLEU; of equal ones the first) among target sentences window
    before it to window - 1 after: struct columns source and target with tokens and contexts, and match_score.

    The source's right context starts at the sentence itself. Adds row_id. A row's matches are found in one call, so nothing is
    shuffled, and no more than the matches is made.
    """

    def run(df: DataFrame) -> DataFrame:
        rows = df.withColumn("row_id", F.monotonically_increasing_id()).withColumn("own_best", python.best_matches_column("src_sents", "tgt_sents", window))
        best = rows.withColumn("own_m", F.explode("own_best")).withColumn("i", F.col("own_m.i"))
        i, j = F.col("i"), F.col("own_m.j")
        side = lambda sents, at, left, right: F.struct(F.get(sents, at).alias("tokens"), F.array_join(F.get(sents, at), " ").alias("sentence"), arrays.py_slice(F.col(sents), F.greatest(at - context, F.lit(0)), at).alias("left_context"), arrays.py_slice(F.col(sents), at + right, at + context + 1).alias("right_context"))
        made = best.withColumns({"source": side("src_sents", i, 0, 0), "target": side("tgt_sents", j, 0, 1), "match_score": F.col("own_m.score")})
        return made.select("row_id", "i", *[c for c in df.columns if c not in ("row_id", "i")], "source", "target", "match_score")

    return run


def align_sentences(window: int = 5, cutoff: float = 0.5, context: int = 20) -> Transform:
    """One row for each group of sentences that match across the two sides (BLEU over the cutoff in either direction, positions
    within the window): struct columns source and target with numbers, tokens and contexts."""

    def side(sents: str, numbers: str):
        at, values = F.col(f"own_group.{numbers}"), F.col(sents)
        lo, hi = F.array_min(at), F.array_max(at) + 1
        tokens = F.flatten(F.transform(at, lambda i: F.get(values, i)))
        return F.struct(at.alias("numbers"), tokens.alias("tokens"), arrays.py_slice(values, F.greatest(lo - context, F.lit(0)), lo).alias("left_context"), arrays.py_slice(values, hi, hi + context).alias("right_context"))

    def run(df: DataFrame) -> DataFrame:
        rows = df.withColumn("own_group", F.explode(python.aligned_column("src_sents", "tgt_sents", window, cutoff)))
        return rows.withColumns({"source": side("src_sents", "source"), "target": side("tgt_sents", "target")}).drop("own_group")

    return run


def split_edits(window: int = 5, cutoff: float = 0.5, context: int = 20) -> Transform:
    """From page texts to matched sentences that differ: sections of one title, references out, markup out, tokens, alignment."""

    def run(df: DataFrame) -> DataFrame:
        rows = df.transform(split_sections).transform(process_references).transform(clean_markup).transform(tokenize).transform(align_sentences(window, cutoff, context))
        return rows.filter(F.col("source.tokens") != F.col("target.tokens"))

    return run


def negatives_before(page: str, order: Sequence[str], comment: str, out: str = "negatives") -> Transform:
    """Adds the comments of the page's earlier rows, in order."""
    before = Window.partitionBy(page).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lambda df: df.withColumn(out, F.collect_list(comment).over(before))


def forward_fill(column: str, by: Sequence[str], order: Sequence[str], out: str) -> Transform:
    """Adds the last value that isn't null, up to the row."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lambda df: df.withColumn(out, F.last(column, True).over(so_far))


def marked_neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str], mark: Column) -> DataFrame:
    """Adds before and after: the nearest mark that isn't null in the rows before and after each row."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("own_mark", mark)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return marked.withColumns({"before": F.last("own_mark", True).over(back), "after": F.first("own_mark", True).over(ahead)}).drop("own_mark")


def revision_counts(revisions: DataFrame, page: str = "page_id", author: str = "username") -> DataFrame:
    """(page, revisions, authors) of each page."""
    return revisions.groupBy(page).agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct(author).alias("authors"))


def near_equals(rows: DataFrame, keys: Sequence[str], source: Column, target: Column, window: int) -> DataFrame:
    """(keys, i, j, value): equal elements of two arrays, the target's from window before i to window - 1 after it.

    Positions are cut into bands of twice the window and joined by value and band, so that a value which is often in both
    meets its like of a band or two, not of the whole arrays.
    """
    band = lambda i: F.floor(i / (2 * window))
    a = rows.select(*keys, F.posexplode(source).alias("i", "value"))
    a = a.withColumn("own_band", F.explode(F.array_distinct(F.array(band(F.col("i") - window), band(F.col("i") + window - 1)))))
    b = rows.select(*keys, F.posexplode(target).alias("j", "value")).withColumn("own_band", band(F.col("j")))
    return a.join(b, [*keys, "value", "own_band"]).filter((F.col("j") >= F.col("i") - window) & (F.col("j") < F.col("i") + window)).drop("own_band")


def islands(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, first, last, n) of runs of consecutive integers."""
    group = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return df.select(*by, value).distinct().withColumn("own_run", group).groupBy(*by, "own_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("own_run")


def window_sum(value: str | Column, by: Sequence[str], order: Sequence[str], length: int, out: str) -> Transform:
    """Adds the sum over the row and the length - 1 before it."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(length - 1), 0)
    return lambda df: df.withColumn(out, F.sum(value).over(frame))
