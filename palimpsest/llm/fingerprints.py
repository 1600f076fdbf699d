"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (long ones at sentence ends; the first HEAD characters finer, so that short texts have
several), and each distinct paragraph gets a 64-bit digest. A sketch has cells with a count, the XOR of digests and
the XOR of their check hashes; each digest is in three cells. Sketches of two versions subtract cell by cell: what is in
both cancels out, and peeling (a cell that holds one digest gives it, and it leaves its other cells) recovers the digests
in one version only. The fingerprint is the sketch of CELLS cells. If peeling the difference of two fingerprints fails,
larger sketches of the texts follow: as many segments, by digest, as keep some KEYS digests in each, each a single cell at first; for
one that fails, SEGMENT_CELLS cells, then twice, four and eight times as many; should that fail too, its digests are compared one by one.

All of it is built-in functions within a row; the next document's text comes by one shuffle of ranges of doc_id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELLS = 24
HEAD = 240
KEYS = 2
SEGMENT_CELLS = 12
#: Documents in a range of doc_ids.
RANGE_ROWS = 500
MAX_RANGES = 10_000
#: Keys a range that are sampled for the bounds.
SAMPLE = 20
#: Ranges are put together to tasks of about so many rows.
TASK_ROWS = 4000
_FINE = r"[^\n]{16,40}?(?=[ .!?,\n])[.!?,]*|[^\n]{1,40}|\n"
_COARSE = r"[^\n]{120,320}?[.!?]+(?= |\n|$)|[^\n]{1,320}|\n"
_NO_LONGS = "array<bigint>"


def let(value: Column, then) -> Column:
    """then(value), with value found once."""
    return F.get(F.transform(F.array(value), then), 0)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for an empty text."""
    parts = F.concat(F.regexp_extract_all(F.substring(text, 1, HEAD), F.lit(_FINE), F.lit(0)), F.regexp_extract_all(F.substring(text, HEAD + 1, 1 << 30), F.lit(_COARSE), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != "\n"), lambda p: F.xxhash64(p)))


def _keyed(digest: Column, sign: Column, third: int, turn: int) -> Column:
    h = F.xxhash64(digest, F.lit(turn))
    places = [(F.pmod(F.shiftright(h, 20 * j), F.lit(third)) + third * j).cast("int") for j in range(3)]
    return F.struct(digest.alias("d"), sign.alias("s"), F.xxhash64(digest, F.lit(-1)).alias("c"), *[p.alias(f"p{j}") for j, p in enumerate(places)])


def _at(key: Column, i: Column) -> Column:
    return (key["p0"] == i) | (key["p1"] == i) | (key["p2"] == i)


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), c.alias("c"))


def _empty(x: Column) -> Column:
    return (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)


def _pure(x: Column) -> Column:
    """Whether a cell holds one digest."""
    return (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"], F.lit(-1)) == x["c"])


def sketch(plus: Column, minus: Column | None = None, cells: int = CELLS, turn: int = 0) -> Column:
    """The cells (n, k, c) of the digests in plus, less those in minus."""
    keys = F.transform(plus, lambda d: _keyed(d, F.lit(1), cells // 3, turn))
    if minus is not None:
        keys = F.concat(keys, F.transform(minus, lambda d: _keyed(d, F.lit(-1), cells // 3, turn)))
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda cell, q: _cell(cell["n"] + q["s"], cell["k"].bitwiseXOR(q["d"]), cell["c"].bitwiseXOR(q["c"]))
    return let(keys, lambda ks: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.aggregate(F.filter(ks, lambda q: _at(q, i)), empty, add)))


def subtract(a: Column, b: Column) -> Column:
    """The cells of a less those of b."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, steps: Column, n_cells: int = CELLS, turn: int = 0) -> Column:
    """Struct of plus and minus: the digests recovered from cells; null if some can't be in so many steps."""
    none = F.array().cast(_NO_LONGS)

    def state(cs: Column, plus: Column, minus: Column, going: Column) -> Column:
        return F.struct(cs.alias("cells"), plus.alias("plus"), minus.alias("minus"), going.alias("going"))

    def step(s: Column, _: Column) -> Column:
        def take(found: Column) -> Column:
            def without(q: Column) -> Column:
                gone = F.transform(s["cells"], lambda x, i: F.when(_at(q, i), _cell(x["n"] - q["s"], x["k"].bitwiseXOR(q["d"]), x["c"].bitwiseXOR(q["c"]))).otherwise(x))
                plus = F.when(q["s"] == 1, F.concat(s["plus"], F.array(q["d"]))).otherwise(s["plus"])
                minus = F.when(q["s"] == -1, F.concat(s["minus"], F.array(q["d"]))).otherwise(s["minus"])
                return state(gone, plus, minus, F.lit(True))

            return F.when(found.isNull(), state(s["cells"], s["plus"], s["minus"], F.lit(False))).otherwise(let(_keyed(found["k"], found["n"], n_cells // 3, turn), without))

        return F.when(s["going"], let(F.get(F.filter(s["cells"], _pure), 0), take)).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), state(cells, none, none, F.lit(True)), step)
    return let(end, lambda s: F.when(F.forall(s["cells"], _empty), F.struct(s["plus"].alias("plus"), s["minus"].alias("minus"))))


def _segment(x: Column, y: Column) -> Column:
    """What one segment's digests x and y differ in, by sketches of growing size."""
    def tried(cells: int, turn: int) -> Column:
        return let(sketch(x, y, cells, turn), lambda cs: peel(cs, F.size(x) + F.size(y), cells, turn))

    def alone(cell: Column) -> Column:
        one, none = F.array(cell["k"]), F.array().cast(_NO_LONGS)
        plus, minus = F.when(cell["n"] == 1, one).otherwise(none), F.when(cell["n"] == -1, one).otherwise(none)
        return F.when(_empty(cell) | _pure(cell), F.struct(plus.alias("plus"), minus.alias("minus"))).otherwise(F.coalesce(*tries, last))

    tries = [tried(SEGMENT_CELLS * k, turn) for turn, k in ((1, 1), (2, 2), (3, 4), (4, 8))]
    last = F.struct(F.array_except(x, y).alias("plus"), F.array_except(y, x).alias("minus"))
    add = lambda sign: lambda cell, d: _cell(cell["n"] + sign, cell["k"].bitwiseXOR(d), cell["c"].bitwiseXOR(F.xxhash64(d, F.lit(-1))))
    return let(F.aggregate(y, F.aggregate(x, _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")), add(1)), add(-1)), alone)


def differences(a: Column, b: Column, base: Column | None = None) -> Column:
    """Struct of plus and minus: the digests in a only and in b only, recovered from sketches.

    base: the difference of their fingerprints, if there is one; it is tried first.
    """
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    tagged = lambda values, side: F.transform(values, lambda d: let(F.xxhash64(d, F.lit(77)), lambda h: F.struct(d.alias("d"), F.pmod(h, side).alias("g"), F.pmod(F.shiftright(h, 24), side).alias("k"))))
    of = lambda values, name, g: F.filter(values, lambda x: x[name] == g)
    bare = lambda values: F.transform(values, lambda x: x["d"])

    def segments(side: Column) -> Column:
        turns = F.sequence(F.lit(0).cast("long"), side - 1)
        inner = lambda p: F.transform(turns, lambda k: let(pair(bare(of(p["x"], "k", k)), bare(of(p["y"], "k", k))), lambda q: _segment(q["x"], q["y"])))
        return let(pair(tagged(a, side), tagged(b, side)), lambda t: F.transform(turns, lambda g: let(pair(of(t["x"], "g", g), of(t["y"], "g", g)), inner)))

    outer = let(F.greatest(F.ceil(F.sqrt((F.size(a) + F.size(b)) / KEYS)), F.lit(1)).cast("long"), segments)
    all_ = let(F.flatten(outer), lambda parts: F.struct(F.flatten(F.transform(parts, lambda s: s["plus"])).alias("plus"), F.flatten(F.transform(parts, lambda s: s["minus"])).alias("minus")))
    return F.coalesce(peel(base, F.lit(CELLS)), all_) if base is not None else all_


def likeness(n_a: Column, n_b: Column, diff: Column) -> Column:
    """The Jaccard similarity of two digest sets of these sizes that differ so; two empty ones are equal."""
    d = F.size(diff["plus"]) + F.size(diff["minus"])
    return F.when(n_a + n_b + d == 0, F.lit(1.0)).otherwise((n_a + n_b - d) / (n_a + n_b + d)).cast("double")


def shown(cells: Column) -> Column:
    """A sketch as text: each cell's count and the hexadecimal digits (16 each) of the XOR of its digests and of their check hashes.

    That is all that peeling needs: two such texts can be subtracted and peeled.
    """
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), digits(c["k"]), digits(c["c"]))), " ")


def read_sketch(text: Column) -> Column:
    """The cells of a fingerprint as shown() writes it."""
    long = lambda x: F.conv(x, 16, -10).cast("long")
    return F.transform(F.split(text, " "), lambda x: let(F.split(x, ":"), lambda p: _cell(F.get(p, 0), long(F.get(p, 1)), long(F.get(p, 2)))))


def with_next(df: DataFrame, doc_id: str, text: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with `out`: the text of the row after it by doc_id (nulls first, then by a hash of the text), for the last row the first one's.

    Rows are dealt to ranges of (doc_id, hash) between bounds, so rows of one doc_id or none spread as well; only repeated
    rows stay together. Spark's range partitioner finds the bounds from a sample. Each is the first row of its range, which
    also goes to the range before; they come to the driver, 16 bytes each: a range has range_rows rows, or more so that there
    are MAX_RANGES at most. An empty df gives an empty result; a column called `out` is replaced.
    """
    span, at, low, h = (common.free_name(df, x) for x in ("own_range", "own_copy", "own_id", "own_hash"))
    keyed = df.withColumn(low, F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn(h, F.xxhash64(common.text_or_empty(text)))
    n = df.count()
    ranges = int(min(MAX_RANGES, n // range_rows + 1))
    bounds = _firsts(keyed.select(low, h), ranges) or [(0, 0)]
    given = let(F.lit([i for i, _ in bounds]), lambda ids: F.struct(ids.alias("ids"), F.lit([x for _, x in bounds]).alias("hashes")))
    place = _place(F.col(low), F.col(h), given, len(bounds))
    opens = let(given, lambda g: (F.get(g["ids"], F.col(span)) == F.col(low)) & (F.get(g["hashes"], F.col(span)) == F.col(h)))
    before = F.pmod(F.col(span) - 1, F.lit(len(bounds)))
    spots = F.when(opens, F.array(F.struct(F.col(span).alias("at"), F.lit(0).alias("copy")), F.struct(before.alias("at"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col(span).alias("at"), F.lit(0).alias("copy"))))
    dealt = keyed.withColumn(span, place).withColumn(at, F.explode(spots)).withColumn(span, F.col(f"{at}.at")).withColumn(at, F.col(f"{at}.copy"))
    after = Window.partitionBy(span).orderBy(at, low, h)
    dealt = dealt.withColumn(out, F.lead(F.coalesce(text, F.lit(""))).over(after)).filter(F.col(at) == 0).drop(span, at, low, h)
    return dealt.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS))


def _firsts(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The first keys of about so many ranges, in order; SAMPLE keys a range are sent to the driver to find them."""
    conf, name = keys.sparkSession.conf, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = conf.get(name)
    conf.set(name, str(SAMPLE))
    try:
        found = keys.repartitionByRange(ranges, *keys.columns).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys.columns)).alias("first"))
        return sorted(tuple(r.first) for r in found.select("first").collect())
    finally:
        conf.set(name, before)


def _place(x: Column, h: Column, given: Column, n: int) -> Column:
    """The number of the last of n bounds (ids, hashes) that isn't over (x, h), by halving."""
    def step(g: Column):
        def further(a: Column, width: Column) -> Column:
            i = a + width
            fits = (i < n) & ((F.get(g["ids"], i) < x) | ((F.get(g["ids"], i) == x) & (F.get(g["hashes"], i) <= h)))
            return F.when(fits, i).otherwise(a)

        return further

    widths = [1 << k for k in range(max(1, n.bit_length()) - 1, -1, -1)]
    return let(given, lambda g: F.aggregate(F.lit(widths), F.lit(0), step(g)))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of its text; a null text counts as empty. A column of that name is replaced."""
    return df.withColumn(out, shown(sketch(digests(common.text_or_empty(text)))))


def compare(df: DataFrame, a: str, b: str, out: str = "changed") -> DataFrame:
    """df with `out`: the digests only text a has (plus), only text b has (minus), and the likeness of the two (0 to 1)."""
    one, two = common.free_name(df, "own_a"), common.free_name(df, "own_b")
    both = df.withColumn(one, digests(common.text_or_empty(a))).withColumn(two, digests(common.text_or_empty(b)))
    diff = differences(F.col(one), F.col(two), subtract(sketch(F.col(one)), sketch(F.col(two))))
    return both.withColumn(out, diff).withColumn(out, F.struct(f"{out}.plus", f"{out}.minus", likeness(F.size(one), F.size(two), F.col(out)).alias("likeness"))).drop(one, two)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", common.text_or_empty("text").alias("text"))
    rows = with_next(docs, "doc_id", "text", "next").withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next", F.lit(1), quarter)))
    sha = F.sha2("edited", 256)
    cut = rows.select("doc_id", "n_chars", sha.alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next")).alias("b"))
    made = cut.select("*", sketch(F.col("a")).alias("sa"), sketch(F.col("e")).alias("se"), sketch(F.col("b")).alias("sb"))
    near = lambda y, s: let(differences(F.col("a"), F.col(y), subtract(F.col("sa"), F.col(s))), lambda d: likeness(F.size("a"), F.size(y), d))
    return made.select("doc_id", "n_chars", "edited_sha256", shown(F.col("sa")).alias("fingerprint"), shown(F.col("se")).alias("edited_fingerprint"), near("e", "se").alias("near_edited"), near("b", "sb").alias("near_next"))

