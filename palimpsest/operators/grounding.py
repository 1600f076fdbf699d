"""Sources of edits: crawl snapshots nearest in time, one text per URL, snippets, control tokens, pairs for ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import arrays, text
from palimpsest.functions.text import STOP_WORDS


#: Of so many most frequent words control_tokens() keeps the counts with each task; each word less frequent is in less
#: than one in 200 of all places.
HOT_WORDS = 200


def filter_index(lines: DataFrame, urls: DataFrame, column: str = "url") -> DataFrame:
    """Index lines whose URL is wanted (left semi; the wanted URLs needn't be distinct)."""
    return lines.join(urls.select(column), column, "left_semi")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, tie: str, k: int = 1) -> DataFrame:
    """The k rows of right nearest in time to each row of left with equal keys, before or after; ties: greatest `tie` first.

    Needs a column row_id that tells left rows apart. Rows without a time come last, and for a left row without one only ties
    decide. Null keys are near nothing. right's rows are numbered by time in each key, and a left row looks up the numbers of
    the k before and the k after it: rows grow with k, not with a key's rows.
    """
    keys, micros = list(on), lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    by_key = Window.partitionBy(*keys)
    last = F.lit((1 << 63) - 1)
    rights = right.withColumn("own_t", F.coalesce(micros(right_time), last))
    rights = rights.withColumns({"own_b": F.row_number().over(by_key.orderBy("own_t", F.col(tie))), "own_a": F.row_number().over(by_key.orderBy("own_t", F.col(tie).desc())), "own_tie": F.row_number().over(by_key.orderBy(F.col(tie).desc()))})
    places = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"own_{x}").alias("number")) for x in ("b", "a", "tie")])
    numbered = rights.withColumn("own_place", F.explode(places)).select(*right.columns, F.col("own_place.side").alias("own_side"), F.col("own_place.number").alias("own_number"))
    # How many rows of right aren't later than each row of left: both sides in one window, right's first at equal times.
    times = right.select(*keys, F.coalesce(micros(right_time), last).alias("own_t"), F.lit(1).alias("own_right"), F.lit(None).alias("own_row"))
    every = left.select(*keys, micros(left_time).alias("own_t"), F.lit(0).alias("own_right"), F.struct(*left.columns).alias("own_row")).unionByName(times)
    upto = by_key.orderBy(F.col("own_t"), F.col("own_right").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = every.withColumn("own_n", F.sum("own_right").over(upto)).filter("own_right = 0")
    wanted = lambda side, numbers: F.transform(numbers, lambda i: F.struct(F.lit(side).alias("side"), i.cast("int").alias("number")))
    n = F.col("own_n")
    ups = F.concat(wanted("b", F.sequence(n - k + 1, n)), wanted("a", F.sequence(n + 1, n + k)))
    spots = F.when(F.col("own_t").isNull(), wanted("tie", F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))).otherwise(ups)
    asked = counted.withColumn("own_place", F.explode(spots)).select("own_row.*", F.col("own_place.side").alias("own_side"), F.col("own_place.number").alias("own_number"))
    joined = asked.join(numbered, [*keys, "own_side", "own_number"]).drop("own_side", "own_number")
    away = F.abs(micros(right_time) - micros(left_time))
    first = Window.partitionBy("row_id").orderBy(away.asc_nulls_last(), F.col(tie).desc())
    return joined.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)


def crawl_time(filename: Column) -> Column:
    """The time in a crawl file's name (14 digits after a hyphen), null if there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(filename, r"-(\d{14})[-.]", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def longest_text(rows: DataFrame, key: str, value: str = "text") -> DataFrame:
    """(key, value): each key's longest text; of equally long ones the greatest."""
    return rows.groupBy(key).agg(F.max(F.struct(F.length(value).alias("length"), F.col(value).alias("value")))["value"].alias(value))


def first_hit(rows: DataFrame, key: str, priority: Sequence[str], value: str) -> DataFrame:
    """(key, value): of each key the value that isn't null with the least priority; keys without one go."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*priority)).alias(value))


def right_biased_merge(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """All keys; a key in both has right's row."""
    return right.unionByName(left.join(right.select(*key).distinct(), list(key), "left_anti"))


def urls_to_fetch(edits: DataFrame, domains: Sequence[str] | None = None, have: DataFrame | None = None) -> DataFrame:
    """(url, year): URLs on either side of the edits with their least year, listed ones only, without those in have (url)."""
    every = edits.select(F.explode(F.concat("urls_orig", "urls_edit")).alias("url"), F.split_part("timestamp", F.lit("-"), F.lit(1)).alias("year"))
    if domains is not None:
        every = every.filter(text.whitelisted(F.col("url"), domains))
    found = every.groupBy("url").agg(F.min("year").alias("year"))
    return found if have is None else found.join(have.select("url"), "url", "left_anti")


def index_years(urls: DataFrame, indexes: Sequence[str]) -> DataFrame:
    """(url, year, index) for each index of the URL's year or before; indexes are few and come as a literal."""
    given = F.array(*[F.lit(i) for i in indexes])
    return urls.withColumn("index", F.explode(F.filter(given, lambda i: F.split_part(i, F.lit("-"), F.lit(1)).cast("int") <= F.col("year").cast("int"))))


def progress(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """One row: wanted, done, not_empty, and their shares; got has url and results (an array)."""
    joined = wanted.select("url").distinct().join(got.select("url", F.size("results").alias("n")), "url", "left")
    made = joined.agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("n").isNotNull()).alias("done"), F.count_if(F.col("n") > 0).alias("not_empty"))
    return made.withColumn("done_share", F.try_divide("done", "wanted")).withColumn("not_empty_share", F.try_divide("not_empty", "done"))


def snippets(docs: Column, reference: Column, length: int, least: int) -> Column:
    """For each text its best window of tokens (see arrays.best_window), joined; texts with a smaller overlap go."""
    made = F.transform(docs, lambda d: arrays.best_window(text.tokens(d), reference, length))
    return F.transform(F.filter(made, lambda w: w["overlap"] >= least), lambda w: F.array_join(w["tokens"], " "))


def reference_tokens(target: Column, comment: Column) -> Column:
    """Tokens of the target and words of the comment that start with a word character, without stop words."""
    every = F.array_union(target, F.split(comment, " "))
    return F.filter(every, lambda t: F.regexp_like(t, F.lit(r"^[\p{L}\p{N}_]")) & ~t.isin(STOP_WORDS["en"]))


def join_snippets(values: Column) -> Column:
    return F.nullif(F.array_join(values, " ;; "), F.lit(""))


def control_tokens(rows: DataFrame, frequency: DataFrame, key: str, default: float = 1e6, parts: int | None = None) -> DataFrame:
    """(key, control): the rarest token that is in both token arrays, target and grounding; else of the target; else n/a.

    frequency: word, count; a word that isn't there counts as default. Ties: by word. One join on words and one on keys. Of
    the HOT_WORDS most frequent words only a row's rarest can be its result, and that is found in the row: those words, which
    are in most rows, aren't joined.
    """
    n = F.coalesce(F.col("count").cast("double"), F.lit(default)).alias("n")
    top = frequency.filter(F.col("word").isNotNull()).groupBy("word").agg(F.min(n).alias("n")).orderBy(F.desc("n"), F.desc("word")).limit(HOT_WORDS)
    hot = top.agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("own_hot")).select(F.col("own_hot.word").alias("own_words"), F.col("own_hot.n").alias("own_ns"))
    shared = F.array_intersect("target", "grounding")
    every = F.when(F.size(shared) > 0, shared).otherwise(F.array_distinct("target"))
    split = rows.select(key, every.alias("own_every")).crossJoin(F.broadcast(hot))
    split = split.select(key, "own_words", "own_ns", F.array_except("own_every", "own_words").alias("own_cold"), F.get(F.array_intersect("own_words", "own_every"), 0).alias("own_best"))
    best = F.struct(F.col("own_best").alias("word"), F.get("own_ns", F.array_position("own_words", F.col("own_best")).cast("int") - 1).alias("known"))
    cold = F.transform("own_cold", lambda w: F.struct(w.alias("word"), F.lit(None).cast("double").alias("known")))
    some = split.select(key, F.explode_outer(F.when(F.col("own_best").isNull(), cold).otherwise(F.concat(cold, F.array(best)))).alias("own")).select(key, "own.*")
    # Rows that need no join have a key that no word is, spread by their own key; what it might find isn't used.
    done = F.col("word").isNull() | F.col("known").isNotNull()
    placed = some.withColumn("own_word", F.when(done, F.concat(F.lit("\0"), F.xxhash64(key).cast("string"))).otherwise(F.col("word")))
    if parts:
        placed = placed.repartition(parts, "own_word")
    counts = frequency.select(F.col("word").alias("own_word"), n)
    counted = placed.join(counts, "own_word", "left").withColumn("n", F.coalesce("known", F.when(F.col("word").isNotNull(), F.col("n")), F.lit(default)))
    return counted.groupBy(key).agg(F.coalesce(F.min_by("word", F.struct("n", "word")), F.lit("n/a")).alias("control"))


def article_texts(edits: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """edits with arrays text_edit and text_orig: texts of URLs new in the edit, and of the original's, in their order.

    texts: url, text, one row a URL. URLs without a text are left out; rows without any have empty arrays.
    """
    sides = {"edit": arrays.without(F.col("urls_edit"), F.col("urls_orig")), "orig": F.col("urls_orig")}
    tagged = F.concat(*[_tagged(urls, side) for side, urls in sides.items()])
    joined = edits.select(key, F.explode(tagged).alias("own")).select(key, "own.*").join(texts, "url")
    ordered = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "text")))), lambda x: x["text"])
    found = joined.groupBy(key).agg(ordered("edit").alias("text_edit"), ordered("orig").alias("text_orig"))
    none = F.array().cast("array<string>")
    return edits.join(found, key, "left").withColumns({c: F.coalesce(c, none) for c in ("text_edit", "text_orig")})


def _tagged(urls: Column, side: str) -> Column:
    return F.transform(urls, lambda u, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), u.alias("url")))


def ablation_pairs(rows: DataFrame) -> DataFrame:
    """Rows with a text on both sides as context, grounding_0, target_0 (the edit), grounding_1, target_1 (the original)."""
    both = rows.filter((F.size("text_edit") > 0) & (F.size("text_orig") > 0))
    return both.select(F.col("prefix").alias("context"), F.get("text_edit", 0).alias("grounding_0"), F.col("edited").alias("target_0"), F.get("text_orig", 0).alias("grounding_1"), F.col("original").alias("target_1"))


def as_dataset(pairs: DataFrame) -> DataFrame:
    """ablation_pairs() under the names that load_natural() reads."""
    return pairs.select(F.col("grounding_0").alias("grounding_true"), F.col("grounding_1").alias("grounding_false"), "context", F.col("target_0").alias("target"))


def counterfactuals(rows: DataFrame) -> DataFrame:
    """Two rows for each example: its source and target, and the new ones, each with the other's source as the false one."""
    both = F.array(
        F.struct(F.col("source").alias("grounding_true"), F.col("new_source").alias("grounding_false"), "context", "target"),
        F.struct(F.col("new_source").alias("grounding_true"), F.col("source").alias("grounding_false"), "context", F.col("new_target").alias("target")),
    )
    return rows.select(F.explode(both).alias("own")).select("own.*")
