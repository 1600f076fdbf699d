from palimpsest.functions import windows
from pyspark.sql import functions as F

SENTS = [["a"] * 3, ["b"] * 4, ["c"] * 5, ["d"] * 6, ["e"] * 2]


def test_grown():
    assert windows.grown(SENTS, 2, 2, most_tokens=6) == (SENTS[1:4], 3)
    assert windows.grown(SENTS, 2, 2, most_tokens=100, most_added=2) == (SENTS, 0)
    assert windows.grown(SENTS, 0, 0, most_tokens=0) == (SENTS[:1], 0)


def test_located():
    assert windows.located([["x", "y"], ["z"], ["w"]], ["y"], ["z"]) == ([["x", "y"], ["z"]], 0)
    assert windows.located([["x"]], ["q"], ["x"]) is None


def test_trimmed():
    a, b = [["s"] * 4, ["x"], ["t"] * 4], [["s"] * 4, ["y", "y"], ["t"] * 4]
    assert windows.trimmed(a, b, 4) == ([["x"]], [["y", "y"]], 4)
    assert windows.trimmed(a, b, 100) == (a, b, 0)
    assert windows.trimmed([["x"] * 9], [["y"] * 9], 4) is None
    assert windows.rebased([4, 5], 5) == [0] and windows.rebased([5, 6], 5) == [0, 1]


def test_grown_column(spark):
    df = spark.createDataFrame([(SENTS, 2, 2), (SENTS, 7, 9), (None, 0, 0)], "s array<array<string>>, a int, b int")
    got = df.select(windows.grown_column(F.col("s"), F.col("a"), F.col("b"), 6).alias("w")).collect()
    assert [(r.w.sents, r.w.before) for r in got] == [(SENTS[1:4], 3), (None, None), (None, None)]


def test_first_changed_sentence():
    text = "One. Two <|REF|1|> . Three."
    assert windows.first_changed_sentence(["One.", "Two."], ["One.", "Three."], "One. Three.") == 4
    assert windows.first_changed_sentence(["One."], ["One."], text) == 0


def test_column_forms(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import windows

    sents = [["a", "b"], ["c"], ["d", "e", "f"], ["g"]]
    df = spark.createDataFrame([(sents, ["c"], ["g"], sents[:1] + [["x"]] + sents[2:], [4, 5, 7]), (None, None, None, None, None)], "s array<array<string>>, a array<string>, b array<string>, t array<array<string>>, d array<int>")
    got = df.select(windows.located_column("s", "a", "b").alias("l"), windows.trimmed_column("s", "t", 3).alias("t"), windows.rebased_column(F.col("d"), F.lit(5)).alias("r"), windows.first_changed_column(F.transform("s", lambda x: F.array_join(x, " ")), F.transform("t", lambda x: F.array_join(x, " ")), F.lit("a b x d e f g")).alias("f")).collect()
    found = windows.located(sents, ["c"], ["g"])
    assert (got[0].l.sents, got[0].l.before) == found == (sents[1:], 2)
    assert (got[0].t.source, got[0].t.target, got[0].t.before) == windows.trimmed(sents, sents[:1] + [["x"]] + sents[2:], 3)
    assert got[0].r == windows.rebased([4, 5, 7], 5) == [0, 2]
    assert got[0].f == windows.first_changed_sentence([" ".join(x) for x in sents], [" ".join(x) for x in sents[:1] + [["x"]] + sents[2:]], "a b x d e f g")
    assert got[1].l.sents is None and got[1].f == 0
