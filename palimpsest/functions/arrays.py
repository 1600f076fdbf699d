"""Column expressions on token arrays: spans, distances, contexts, windows, trimming to a model's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance of a URL to the nearest edit where there is no edit.
NO_EDIT = 100_000_000
_INTS = "array<int>"


def let(value: Column, then) -> Column:
    """then(value), with value found once: lambdas find an expression anew for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _run(start: Column, end: Column) -> Column:
    """start to end, or nothing."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast(_INTS))


def spans(indices: Column) -> Column:
    """Ascending indices in runs of consecutive ones: [1, 2, 3, 7, 9, 10] gives [[1, 2, 3], [7], [9, 10]]."""
    def parted(xs: Column) -> Column:
        starts = F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) < x - 1))
        ends = F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | (F.get(xs, i + 1) > x + 1))
        return F.zip_with(starts, ends, lambda a, b: F.sequence(a, b))

    return let(indices, parted)


def is_contiguous(indices: Column) -> Column:
    n = F.size(indices)
    return (n > 0) & (F.get(indices, n - 1) - F.get(indices, 0) == n - 1)


def positions(tokens: Column, token: str) -> Column:
    """Where in the array the token is, from 0."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == token, i)), lambda i: i.isNotNull())


def _up_to(values: Column, x: Column) -> Column:
    """How many of the ascending values are x or less, by halving."""
    bits = F.ceil(F.log2(F.size(values) + 1)).cast("int")
    step = lambda n, k: let(n + F.pow(F.lit(2), k).cast("int"), lambda m: F.when(F.get(values, m - 1) <= x, m).otherwise(n))
    return F.aggregate(F.sequence(bits, F.lit(0), F.lit(-1)), F.lit(0), step)


def distances(at: Column, edits: Column) -> Column:
    """For each position the distance to the nearest edited one (ascending): array of (url_index, dist)."""
    def near(es: Column, i: Column) -> Column:
        away = lambda k: F.abs(F.get(es, k) - i)
        return let(_up_to(es, i), lambda n: F.coalesce(F.least(away(n - 1), away(n)), F.lit(NO_EDIT)))

    return let(edits, lambda es: F.transform(at, lambda i, k: F.struct(k.alias("url_index"), near(es, i).cast("int").alias("dist"))))


def urls_within(urls: Column, dists: Column, most: int) -> Column:
    return F.transform(F.filter(dists, lambda d: d["dist"] < most), lambda d: F.get(urls, d["url_index"]))


def token_context(tokens: Column, edits: Column, window: int) -> Column:
    """Struct of tokens and action (1 if edited) of the edited tokens (ascending indices) and up to `window` on either side."""
    def around(es: Column, e: Column, k: Column) -> Column:
        before = _run(F.greatest(e - window, F.coalesce(F.get(es, k - 1) + window + 1, F.lit(0)), F.lit(0)), e - 1)
        after = _run(e + 1, F.least(e + window, F.coalesce(F.get(es, k + 1), F.size(tokens)) - 1, F.size(tokens) - 1))
        beside = lambda run: F.transform(run, lambda i: F.struct(i.alias("i"), F.lit(0).alias("action")))
        return F.concat(beside(before), F.array(F.struct(e.alias("i"), F.lit(1).alias("action"))), beside(after))

    at = let(edits, lambda es: F.flatten(F.transform(es, lambda e, k: around(es, e, k))))
    return let(at, lambda xs: F.struct(F.transform(xs, lambda x: F.get(tokens, x["i"])).alias("tokens"), F.transform(xs, lambda x: x["action"]).alias("action")))


def offsets(sents: Column) -> Column:
    """Running sum of the sentences' lengths, from 0; one longer than the sentences."""
    start = F.array(F.lit(0))
    return F.aggregate(sents, start, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(s))))


def sentence_of(offs: Column, index: Column) -> Column:
    """The number of the sentence that a token is in, -1 if past the last."""
    return F.when(index < F.element_at(offs, -1), F.size(F.filter(offs, lambda o: o <= index)) - 1).otherwise(-1)


def py_slice(values: Column, start: Column, end: Column) -> Column:
    """values[start:end] as Python counts, negative numbers from the end."""
    n = F.size(values)
    fix = lambda x: F.when(x < 0, F.greatest(x + n, F.lit(0))).otherwise(F.least(x, n))
    return F.slice(values, fix(start) + 1, F.greatest(fix(end) - fix(start), F.lit(0)))


def _window_ends(tokens: Column, reference: Column, length: int) -> Column:
    """Struct of top and e: the most reference tokens in a run, and the middle one of the last positions of such runs."""
    def middle(sums: Column) -> Column:
        scored = F.transform(F.sequence(F.lit(length), F.size(sums) - 1), lambda e: F.struct((F.get(sums, e) - F.get(sums, e - length)).alias("c"), e.alias("e")))
        best = lambda xs: let(F.array_max(F.transform(xs, lambda x: x["c"])), lambda top: F.filter(xs, lambda x: x["c"] == top))
        chosen = let(let(scored, best), lambda xs: F.get(xs, F.floor(F.size(xs) / 2).cast("int")))
        return let(chosen, lambda x: F.struct(x["c"].alias("top"), x["e"].alias("e")))

    def counted(hits: Column) -> Column:
        """For each token, how many reference tokens there are up to it."""
        more = F.transform(hits, lambda i, k: F.array_repeat(k + 1, F.coalesce(F.get(hits, k + 1), F.size(tokens)) - i))
        return F.flatten(F.concat(F.array(F.array_repeat(F.lit(0), F.coalesce(F.get(hits, 0), F.size(tokens)))), more))

    hits = F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(reference, t), i)), lambda i: i.isNotNull())
    return F.when(F.size(tokens) > length, let(let(hits, counted), middle))


def best_window(tokens: Column, reference: Column, length: int) -> Column:
    """Struct of tokens, overlap and start: the run of `length` tokens with most reference tokens; of equal ones the middle one.

    A text of up to `length` tokens is returned whole, with the number of distinct reference tokens in it. For a run that
    ends at e, tokens e - length + 1 to e are counted and e - length to e - 1 returned; runs start to count at e = length.
    """
    short = F.struct(tokens.alias("tokens"), F.size(F.array_intersect(tokens, reference)).alias("overlap"), F.lit(0).alias("start"))
    found = lambda w: F.struct(F.slice(tokens, w["e"] - length + 1, F.lit(length)).alias("tokens"), w["top"].alias("overlap"), (w["e"] - length).alias("start"))
    return let(_window_ends(tokens, reference, length), lambda w: F.when(w.isNull(), short).otherwise(found(w)))


def trimmed(grounding: Column, context: Column, target: Column, most: int = 1024, context_first: bool = False) -> Column:
    """Struct of grounding and context, cut so that with target they have at most `most` tokens.

    Always the longer of the two is cut, of equal ones the context: grounding at its end, context at its start. With
    context_first, the context is first cut down to one token. In closed form, not token by token.
    """
    g, c = F.size(grounding), F.size(context)
    over = F.greatest(g + c + F.size(target) - most, F.lit(0))
    first = F.least(over, F.greatest(c - 1, F.lit(0))) if context_first else F.lit(0)
    over, c = over - first, c - first
    # The longer one is cut down to the other's length, and then both by turns, the context first.
    gap_g, gap_c = F.greatest(g - c, F.lit(0)), F.greatest(c - g, F.lit(0))
    by_gap = F.least(over, gap_g + gap_c)
    rest = over - by_gap
    cut_g = F.when(g > c, by_gap).otherwise(0) + F.floor(rest / 2)
    cut_c = F.when(c >= g, by_gap).otherwise(0) + F.ceil(rest / 2)
    keep_g = F.greatest(g - cut_g, F.lit(0)).cast("int")
    drop_c = (F.least(cut_c, c) + first).cast("int")
    return F.struct(F.slice(grounding, F.lit(1), keep_g).alias("grounding"), F.slice(context, drop_c + 1, F.greatest(F.size(context) - drop_c, F.lit(0))).alias("context"))


def counted(values: Column) -> Column:
    """The distinct values in order, each with the number of times it is there: array of (value, n)."""
    def runs(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (F.get(xs, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(xs, i).alias("value"), (F.coalesce(F.get(at, k + 1), F.size(xs)) - i).alias("n"))))

    return let(F.array_sort(values), runs)


def without(values: Column, other: Column) -> Column:
    """values that aren't in other; repeated ones stay repeated."""
    return F.filter(values, lambda v: ~F.array_contains(other, v))
