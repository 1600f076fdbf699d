"""MinHash near-dedup by ProbMinHash, banding and exact verification.

1. Equal normalised texts (lower case, single spaces) become one text; only one of each goes on.
2. ProbMinHash signatures of the word shingles: each shingle is a Poisson process whose arrivals fall on random registers;
   a register keeps its first arrival. Registers agree with the probability Jaccard similarity of the weighted shingle
   sets (with unit weights, the plain Jaccard similarity). A shingle's process ends as soon as its arrivals come after
   the last register's, so long texts cost about two arrivals a shingle.
3. Banding: texts that agree on all registers of a band share a bucket. Of buckets with the same members, one is kept. Every
   text is paired with two leaders of its bucket, not with every other; pairs whose signatures allow the threshold are
   verified on whole texts. Connected components of the links are the classes so far.
4. In a bucket of several classes, the texts outside its largest class meet all others, by signatures, in blocks of at most
   BLOCK by BLOCK rows; from a block come only pairs that join classes. Where more than BLOCK texts are outside, the bucket
   is first split by what its texts share in further bands, and step 3 is done again (DEPTH times).
5. A family is a component of pairs that may be links by their signatures. Of a family with several classes, the texts outside
   the largest class meet all others in blocks again, now with their texts: verified links that join classes leave a block.
   So of all pairs that share a bucket, those whose estimate allows a link are either verified or in one class anyway.
6. Connected components of the links.

Hot buckets and leaders are split or broadcast within bounds; nothing of the size of the corpus goes to the driver.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import release, slices

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Estimated similarity from which a pair is verified: more than four standard errors below the threshold.
VERIFY = 0.62
#: Rows of a block that is compared with another; buckets with more texts outside their largest class are split first.
BLOCK = 512
#: How often such buckets are split by a further band.
DEPTH = 1
#: Pairs of one leader in a task.
LEADER_PAIRS = 1000
#: Up to so many row numbers (8 bytes each, counted first) are broadcast.
BROADCAST_UIDS = 100_000
#: Up to so many edges (16 bytes each) are one task's.
LOCAL_EDGES = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the shingles of normalised texts; one with fewer words has one shingle, an empty one none."""
    split = [t.split(" ") if t else [] for t in texts]
    split = [s + [""] * (words - len(s)) if 0 < len(s) < words else s for s in split]
    sizes = np.array([len(s) for s in split], np.int64)
    flat = [w for s in split for w in s]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = pd.util.hash_array(np.array(flat, object), categorize=False)
    n = len(own) - words + 1
    made = np.zeros(n, np.uint64)
    for k in range(words):
        made = _mix(made * _GOLD + own[k : k + n])
    of = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n)
    return made[left >= words], of[:n][left >= words]


def probminhash(hashes: np.ndarray, of: np.ndarray, n: int, registers: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n, registers): the hash that arrived first at each register; zero for sets without elements.

    hashes, of: elements and the number of their set; weights: their rates (1 if None). Without weights, an element may be
    repeated in its set.
    """
    first, owner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    live_h, live_of = hashes, of
    rate = np.ones(len(hashes)) if weights is None else weights.astype(float)
    x, turn = np.zeros(len(hashes)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(live_h):
            turn += np.uint64(1)
            drawn = _mix(live_h + turn * _GOLD)
            x = x - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate
            at = live_of * registers + (_mix(drawn ^ _GOLD) % np.uint64(registers)).astype(np.int64)
            wins = np.flatnonzero(x < first[at])
            wins = wins[np.argsort(-x[wins], kind="stable")]
            first[at[wins]], owner[at[wins]] = x[wins], live_h[wins]
            stays = x < first.reshape(n, registers).max(1)[live_of]
            live_h, live_of, x, rate = live_h[stays], live_of[stays], x[stays], rate[stays]
    return owner.reshape(n, registers)


def counted(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, set) with the number of times each is there."""
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[starts], o[starts], np.diff(np.r_[starts, len(h)])


def similarity(a: str, b: str, words: int = WORDS, weighting: str = "unit") -> float:
    """The exact probability Jaccard similarity of two normalised texts; two without words are equal."""
    h, of = shingles([a, b], words)
    h, of, n = counted(h, of)
    x, y = dict(zip(h[of == 0].tolist(), n[of == 0].tolist(), strict=True)), dict(zip(h[of == 1].tolist(), n[of == 1].tolist(), strict=True))
    if not x or not y:
        return float(a == b)
    if weighting == "unit":
        both = len(x.keys() & y.keys())
        return both / (len(x) + len(y) - both)
    # the sum over shared elements d of 1 / sum over e of max(x(e) / x(d), y(e) / y(d)), by order of y(e) / x(e)
    every = x.keys() | y.keys()
    xs, ys = np.array([x.get(k, 0) for k in every], float), np.array([y.get(k, 0) for k in every], float)
    ratio = np.divide(ys, xs, out=np.full(len(xs), np.inf), where=xs > 0)
    order = np.argsort(ratio, kind="stable")
    x_before, y_after = np.cumsum(xs[order]), np.cumsum(ys[order][::-1])[::-1]
    y_after = np.r_[y_after[1:], 0.0]
    shared = (xs[order] > 0) & (ys[order] > 0)
    return float((1 / (x_before / xs[order].clip(1e-300) + y_after / ys[order].clip(1e-300)))[shared].sum())


_SPACES = re.compile("[ \\t-\\r]+")


def words_of(text: str) -> str:
    """Lower case, words parted by single spaces: what shingles are made of."""
    return _SPACES.sub(" ", text.lower()).strip(" ")


def text_key(text: str = "text"):
    """MD5 (binary) of the text in lower case with single spaces."""
    return F.unhex(F.md5(F.encode(F.trim(F.lower(F.regexp_replace(common.text_or_empty(text), f"[{common.SPACE}]+", " "))), "UTF-8")))


def _sign(words: int, bands: int, rows: int, weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                given = batch.column("text").to_pylist()
                texts = list(dict.fromkeys(given))  # copies side by side are signed once
                number = {t: i for i, t in enumerate(texts)}
                texts, n, take = [words_of(t) for t in texts], len(texts), np.array([number[t] for t in given])
                h, of = shingles(texts, words)
                if weighting == "unit":
                    made = probminhash(h, of, n, bands * rows)
                else:
                    h, of, times = counted(h, of)
                    made = probminhash(h, of, n, bands * rows, times)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        keys = _mix(keys * _GOLD + made[:, k::rows])
                some = np.array([bool(t) for t in texts])[take]
                keys, short = keys.view(np.int64)[take], (made & np.uint64(0xFFFF)).astype("<u2")[take]
                ends = np.cumsum(np.r_[0, np.where(some, bands, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid"), pa.array([r.tobytes() for r in short], pa.binary()), pa.ListArray.from_arrays(ends, keys[some].ravel())],
                    names=["uid", "sig", "keys"],
                )
        release()

    return run


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal integers `by`, in rows that are sorted by them, as one batch."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in by])
        start = 0
        for end in (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist():
            yield rows.slice(start, end - start)
            start = end
        held = rows.slice(start)
    if held is not None and held.num_rows:
        yield held


class _Block:
    """Rows of one block: texts outside the largest class (`outer`), and those they meet (`inner`), by places in the block."""

    def __init__(self, rows: pa.RecordBatch):
        outer = rows.column("outer").to_numpy(zero_copy_only=False)
        self.uid, self.class_ = (rows.column(c).to_numpy() for c in ("uid", "class_"))
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(len(outer), -1)
        self.outer, self.inner = np.flatnonzero(outer), np.flatnonzero(~outer)
        # Two texts that are both outside the largest class meet once.
        self.alone = self.class_[self.inner] == rows.column("main").to_numpy()[self.inner]
        self.root = np.unique(self.class_, return_inverse=True)[1]

    def likely(self) -> Iterator[tuple[int, int]]:
        """Places of pairs whose estimate allows a link and whose roots differ when they come."""
        for k in self.outer.tolist():
            far = (self.root[self.inner] != self.root[k]) & (self.alone | (self.uid[self.inner] < self.uid[k]))
            some = self.inner[far]
            for h in some[(self.sig[some] == self.sig[k]).mean(axis=1) >= VERIFY].tolist():
                if self.root[h] != self.root[k]:
                    yield k, h

    def join(self, k: int, h: int) -> tuple[int, int]:
        self.root[self.root == self.root[h]] = self.root[k]
        x, y = int(self.uid[k]), int(self.uid[h])
        return max(x, y), min(x, y)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


_BLOCK_KEY = ["key", "part", "at"]


def _bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, pairs whose estimate allows a link: as many as join classes that were apart."""
    for rows in _runs(batches, _BLOCK_KEY):
        block = _Block(rows)
        if found := [block.join(k, h) for k, h in block.likely()]:
            yield _pairs(found)
    release()


def _within(words: int, weighting: str, threshold: float):
    """Of each block, the verified links that join classes that were apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, _BLOCK_KEY):
            block, texts, found = _Block(rows), rows.column("text"), []
            made: dict[int, tuple[str, np.ndarray]] = {}

            def of(k: int) -> tuple[str, np.ndarray]:
                if k not in made:
                    text = words_of(texts[k].as_py())
                    made[k] = text, np.unique(shingles([text], words)[0])
                return made[k]

            for k, h in block.likely():
                (s, p), (t, q) = of(k), of(h)
                if weighting != "unit":
                    alike = similarity(s, t, words, weighting) >= threshold
                elif min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    alike = False
                else:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    alike = both >= threshold * (len(p) + len(q) - both) and both > 0
                if alike:
                    found.append(block.join(k, h))
            if found:
                yield _pairs(found)
        release()

    return run


def _mingled(rows: DataFrame, total: int) -> DataFrame:
    """Of rows (key, uid, class_, any others; a table of `total`), those of keys with several classes, with n, outside, main.

    n: rows of the key; main: its largest class; outside: rows that aren't in that.
    """
    sizes = rows.groupBy("key", "class_").agg(F.count(F.lit(1)).alias("k"))
    keys = sizes.groupBy("key").agg(F.sum("k").alias("n"), F.max(F.struct("k", "class_")).alias("best")).filter("n > best.k")
    keys = common.materialize(keys.select("key", "n", (F.col("n") - F.col("best.k")).alias("outside"), F.col("best.class_").alias("main")), total)
    return common.materialize(common.join_counted(rows, keys, ["key"], "n", total), total)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of _mingled() dealt to blocks (key, part, at) and sorted by them: every text with all that are outside.

    A text is repeated for each BLOCK texts that are outside, and one that is outside for each BLOCK texts of the key.
    """
    parts, ats = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "outside"))
    part, at = F.pmod(F.xxhash64("uid"), parts).cast("int"), F.pmod(F.xxhash64(F.lit(1), "uid"), ats).cast("int")
    where = lambda part, at, outer: F.struct(part.alias("part"), at.alias("at"), F.lit(outer).alias("outer"))
    inner = F.transform(F.sequence(F.lit(0), ats - 1), lambda k: where(part, k, False))
    outer = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: where(k, at, True))
    places = F.when(F.col("class_") == F.col("main"), inner).otherwise(F.concat(inner, outer))
    dealt = rows.withColumn("place", F.explode(places)).select("*", "place.*").drop("place", "n", "outside")
    return dealt.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)


def _estimated(pairs: DataFrame, signatures: DataFrame, total: int) -> DataFrame:
    """pairs (a, b) with est: the share of equal registers."""
    left, right = _dealt(pairs, signatures, "sig", total)
    return common.materialize(left.join(right, ["b", "salt"]).select("a", "b", _alike("sig_a", "sig_b").alias("est")), total)


def _dealt(pairs: DataFrame, rows: DataFrame, value: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, salt) with value_a of a, and (b, salt, value_b), from rows (uid, value).

    The pairs of one b are dealt to parts of at most LEADER_PAIRS or so, and b's row is repeated for each.
    """
    counts = common.materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), total)
    parts = F.ceil(F.col("n") / LEADER_PAIRS)
    joined = common.join_counted(pairs, counts, ["b"], "n", total)
    left = joined.withColumn("salt", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("n").join(rows.select(F.col("uid").alias("a"), F.col(value).alias(f"{value}_a")), "a")
    right = counts.select("b", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("salt")).join(rows.select(F.col("uid").alias("b"), F.col(value).alias(f"{value}_b")), "b")
    return left, right


def _verified(pairs: DataFrame, texts: DataFrame, words: int, weighting: str, total: int) -> DataFrame:
    """pairs (a, b) with sim, the exact similarity of their texts (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                sims = [similarity(words_of(x), words_of(y), words, weighting) for x, y in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])
        release()

    left, right = _dealt(pairs, texts, "text", total)
    both = left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return common.materialize(common.to_python(both).mapInArrow(run, "a long, b long, sim double"), total)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each node a of the edges of a task but the least of its component, b."""
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate([x[i] for x in held]) for i in (0, 1)]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        if (root[x] == root[y]).all():
            break
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(uid, root) for each node of the edges (a, b): the least node that it is connected with.

    Each task first contracts its own edges to stars. Up to local_edges of those are contracted by one task more. Else
    rounds follow: a node takes the least label among its neighbours' and then its label's label; rounds end when no label
    changes (about the logarithm of the longest path). Each round is written to the shared folder.
    """
    edges = edges.filter("a <> b")
    stars = common.materialize(edges.select("a", "b").mapInArrow(_contracted, "a long, b long"))
    n = stars.count()
    if n <= local_edges:
        whole = common.materialize(stars.repartition(1).mapInArrow(_contracted, "a long, b long"))
        return whole.select(F.col("a").alias("uid"), F.col("b").alias("root")).unionByName(whole.select(F.col("b").alias("uid"), F.col("b").alias("root")).distinct())
    both = common.materialize(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), 2 * n)
    total = both.count()
    labels = common.materialize(both.groupBy(F.col("b").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("root")).withColumn("root", F.least("uid", "root")), total)
    while True:
        seen = common.join_counted(both, labels.select(F.col("uid").alias("b"), "n", "root"), ["b"], "n", total)
        least = seen.groupBy(F.col("a").alias("uid")).agg(F.min("root").alias("near"))
        near = common.materialize(labels.join(least, "uid").select("uid", "n", F.col("root").alias("was"), F.least("root", "near").alias("root")), total)
        jumps = near.groupBy("root").agg(F.count(F.lit(1)).alias("k")).join(near.select(F.col("uid").alias("root"), F.col("root").alias("jump")), "root")
        jumped = common.join_counted(near, common.materialize(jumps, total), ["root"], "k", total)
        done = common.materialize(jumped.select("uid", "n", "was", F.least("root", "jump").alias("root")), total)
        labels = done.drop("was")
        if not done.filter("root <> was").limit(1).count():
            return labels.select("uid", "root")


def _buckets(keyed: DataFrame, total: int) -> DataFrame:
    """keyed (key, uid; `total` rows) in buckets of two or more, with n and the bucket's two leaders, its least and greatest uid.

    Of buckets with the same members (texts alike in many bands), one is left.
    """
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first"), F.max("uid").alias("last")).filter("n > 1")
    members = common.materialize(common.join_counted(keyed, common.materialize(groups, total // 2), ["key"], "n", total), total // 2)
    own = F.xxhash64("uid")
    sets = members.groupBy("key").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.max("last").alias("last"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 20)).alias("y"))
    kept = common.materialize(sets.groupBy("n", "first", "last", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), total // 2)
    size = members.count()
    return common.materialize(common.join_counted(members.drop("n"), kept, ["key"], "n", size), size)


def _ordered(a, b) -> list:
    """The two uids with the less as b, which stands for the leader: so a pair has one form."""
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


class _Links:
    """The pairs compared so far, and the links among them."""

    def __init__(self, texts: DataFrame, words: int, weighting: str, threshold: float):
        self.texts, self.words, self.weighting, self.threshold = texts, words, weighting, threshold
        self.signatures: DataFrame | None = None  # uid, sig of the texts that share a bucket
        self.known: DataFrame | None = None  # a, b, est, linked
        self.settled: DataFrame | None = None
        self.labels: DataFrame | None = None  # uid, root: the classes so far

    def compare(self, pairs: DataFrame, bound: int) -> None:
        """Estimate and, where the estimate allows it, verify those pairs (a, b) that aren't known yet; bound: of their number."""
        if self.known is not None:
            pairs = pairs.join(self.known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = common.materialize(pairs, bound)
        if total := pairs.count():
            self._verify(_estimated(pairs, self.signatures, total), total)
            if self.any():
                self.labels = components(self.edges())
            common.tidy(pairs.sparkSession)

    def with_class(self, rows: DataFrame) -> DataFrame:
        """rows (uid, any others) with class_."""
        if self.labels is None:
            return rows.withColumn("class_", F.col("uid"))
        return rows.join(self.labels, "uid", "left").withColumn("class_", F.coalesce("root", "uid")).drop("root")

    def meet(self, mingled: DataFrame, bound: int) -> None:
        """Compare the texts outside the largest class of their key with all others of it; rows of _mingled()."""
        signed = mingled.select("key", "uid", "class_", "n", "outside", "main").join(self.signatures, "uid")
        self.compare(_in_blocks(signed).mapInArrow(_bridges, "a long, b long").distinct(), bound)

    def settle(self) -> None:
        """Compare the texts of each family of several classes among themselves, and add the links that join classes."""
        likely = self.known.filter(F.col("est") >= VERIFY).select("a", "b")
        rows = common.materialize(self.with_class(components(likely).withColumnRenamed("root", "key")))
        mingled = _mingled(rows, rows.count()).filter("n > 2")  # of two texts, the one pair is known
        n = mingled.count()
        if not n:
            return
        few = F.broadcast(mingled) if n <= BROADCAST_UIDS else mingled
        whole = common.materialize(self.texts.join(few, "uid").join(self.signatures, "uid"), n, 8192)
        found = common.to_python(_in_blocks(whole)).mapInArrow(_within(self.words, self.weighting, self.threshold), "a long, b long")
        self.settled = common.materialize(found.distinct(), n)

    def _verify(self, est: DataFrame, total: int) -> None:
        close = common.materialize(est.filter(F.col("est") >= VERIFY).select("a", "b"), total)
        found = close.count()
        wanted = common.materialize(close.select(F.col("a").alias("uid")).unionByName(close.select(F.col("b").alias("uid"))).distinct(), 2 * found)
        few = wanted.count() <= BROADCAST_UIDS
        texts = common.materialize(self.texts.join(F.broadcast(wanted) if few else wanted, "uid", "left_semi"), found, 8192)
        sims = _verified(close, texts, self.words, self.weighting, found)
        done = est.join(sims, ["a", "b"], "left").select("a", "b", "est", (F.coalesce("sim", F.lit(0.0)) >= self.threshold).alias("linked"))
        self.known = common.materialize(done if self.known is None else self.known.unionByName(done), total)

    def any(self) -> bool:
        return self.known is not None and self.edges().limit(1).count() > 0

    def edges(self) -> DataFrame:
        linked = self.known.filter("linked").select("a", "b")
        return linked if self.settled is None else linked.unionByName(self.settled)


def link(signed: DataFrame, texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, weighting: str = "unit", depth: int = DEPTH) -> DataFrame | None:
    """Verified links (a, b) between distinct texts, or None; signed: uid, sig, keys of each; texts: uid, text of each.

    Not all linked pairs are there, but all that their connected components need. Lost are only pairs that share no band
    (at a similarity of 0.8, three in a million), pairs whose estimate is under VERIFY (at 0.8, about one in a hundred
    thousand), and of two texts that meet only in buckets that are split, those that share no more than `depth` bands (at 0.8
    and a depth of 1, six in a hundred thousand).
    """
    keyed, found = signed.select(F.explode("keys").alias("key"), "uid"), _Links(texts, words, weighting, threshold)
    for level in range(depth + 1):
        members = _buckets(keyed, keyed.count())
        size = members.count()
        if not size:
            break
        if not level:  # most texts are alone in all buckets
            found.signatures = common.materialize(signed.select("uid", "sig").join(members.select("uid").distinct(), "uid", "left_semi"), size, 256)
        stars = members.select(*_ordered(F.col("uid"), F.col("first"))).unionByName(members.select(*_ordered(F.col("uid"), F.col("last"))))
        found.compare(_apart(stars.filter("a <> b").distinct(), found.labels), size)
        # Of three texts, all pairs are known now.
        rows = common.materialize(found.with_class(members.filter("n > 3").select("key", "uid")), size)
        mingled = _mingled(rows, size)
        met = mingled if level == depth else mingled.filter(F.col("outside") <= BLOCK)
        found.meet(met, size)
        if level == depth:
            break
        split = mingled.filter(F.col("outside") > BLOCK).select("key", "uid")
        if not split.limit(1).count():
            break
        further = split.join(signed.select("uid", "keys"), "uid").select("uid", "key", F.explode("keys").alias("next")).filter("key <> next")
        finer = further.select(F.xxhash64(F.least("key", "next"), F.greatest("key", "next")).alias("key"), "uid").distinct()
        keyed = common.materialize(finer, size * 8)
    if found.known is None:
        return None
    if found.known.filter(F.col("est") >= VERIFY).limit(1).count():
        found.settle()
    return common.materialize(found.edges()) if found.any() else None


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs that aren't in one component yet."""
    if labels is None:
        return pairs
    x = labels.select(F.col("uid").alias("a"), F.col("root").alias("ra"))
    y = labels.select(F.col("uid").alias("b"), F.col("root").alias("rb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).select("a", "b")


def _classified(df: DataFrame, text: str, doc_id: str, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighting: str = "unit", **options) -> tuple[DataFrame, DataFrame, str, int]:
    """df as a table with its row numbers; (of_key, n, class_id, class_size, n_links, keeper) of each text; the names' prefix; df's rows.

    keeper: the row that stands for the class.
    """
    own = common.free_name(df, "own_")
    while any(c.lower().startswith(own) for c in df.columns):
        own = "_" + own
    table = common.materialize(df.withColumn(own + "key", text_key(text)).withColumn(own + "row", F.monotonically_increasing_id()))
    ids = table.select(F.col(doc_id).alias("doc_id"), F.col(own + "key").alias("key"), F.col(own + "row").alias("row"))
    total = ids.count()
    copies = ids.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row")).alias("lead"))
    copies = common.materialize(copies.select("key", "n", F.col("lead.doc_id").alias("least"), F.col("lead.row").alias("uid")), total)
    texts = table.select(F.col(own + "row").alias("uid"), common.text_or_empty(text).alias("text"))
    signed = common.to_python(texts).mapInArrow(_sign(words, bands, rows, weighting), "uid long, sig binary, keys array<long>")
    signed = common.materialize(signed.join(copies.select("uid"), "uid", "left_semi"), total, 512)
    edges = link(signed, texts, words=words, weighting=weighting, **options)
    if edges is None:
        roots = copies.withColumn("root", F.col("uid")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        degree = edges.select(F.col("a").alias("uid")).unionByName(edges.select(F.col("b").alias("uid"))).groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"))
        linked = common.materialize(components(edges).join(degree, "uid"))
        roots = copies.join(linked, "uid", "left").withColumn("root", F.coalesce("root", "uid")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    roots = common.materialize(roots, total)
    whole = roots.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("least", "uid")).alias("lead"), F.sum("n").alias("class_size"))
    whole = common.materialize(whole.select("root", "k", F.col("lead.least").alias("class_id"), F.col("lead.uid").alias("keeper"), "class_size"), total)
    of_text = common.join_counted(roots.select("key", "n", "n_links", "root"), whole, ["root"], "k", total)
    return table, common.materialize(of_text.select("key", "n", "n_links", "class_id", "class_size", "keeper"), total), own, total


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, class_id, class_size, n_links) for each row of df: class_id is the least doc_id of its class.

    A class is a connected component of texts whose shingle sets are similar by THRESHOLD or more; texts that are equal but
    for case and white space are in one class, among them all null and empty ones. n_links: verified links of the text to
    different texts (not all that there are: those that join its class). A text of fewer words than a shingle is one
    shingle. A null doc_id sorts first; repeated rows stay. options: words, bands, rows, weighting and those of link().
    """
    table, of_text, own, total = _classified(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", **options)
    ids = table.select("doc_id", F.col(own + "key").alias("key"))
    joined = common.join_counted(ids, of_text, ["key"], "n", total)
    return common.compact(joined.select("doc_id", "class_id", "class_size", "n_links"), total)


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of df for each class, with df's columns: that with the least doc_id; of equal rows, one."""
    table, of_text, own, total = _classified(df, text, doc_id, **options)
    row = own + "row"
    some = common.materialize(of_text.filter("class_size > 1").select("key", "n", F.col("keeper").alias("keeper")), total)
    ids = table.select(F.col(own + "key").alias("key"), F.col(row).alias("row"))
    gone = common.materialize(common.join_counted(ids, some, ["key"], "n", total).filter("row <> keeper").select(F.col("row").alias(row)), total)
    few = gone.count() <= BROADCAST_UIDS
    return table.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*df.columns)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir))
