"""Counts of short rows in memory and of long rows over segments: the same numbers."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairmine.operators import mt_metrics as MT

ALL = ["bleu", "chrf", "chrf_pp", "meteor"]


def rows(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = ["the", "a", "cat", "Dog's", "3.14", "(no)", "e.g.,", "ﬀ", "Ünder", "中文", "😀", "x-1-2", "&amp;", "..", "!"]
    space = [" ", "  ", "\n", "\t", " ", "\x1c", "　", "-\n"]
    out = [(0, None, "a"), (1, "a", None), (2, "", ""), (3, "a b", " \n"), (4, "", "a"), (5, " ", "a b c d e")]
    for i in range(6, n):
        t = ["".join(rnd.choice(vocab) + rnd.choice(space) for _ in range(rnd.randint(0, 60))) for _ in range(2)]
        if rnd.random() < 0.5:
            t[1] = t[0][:rnd.randint(0, len(t[0]))] + t[1]
        out.append((i, *t))
    return out


def scores(spark, data):
    df = spark.createDataFrame(data, "row_id long, prediction string, reference string").repartition(3)
    return {r.row_id: tuple(None if r[m] is None else round(r[m], 9) for m in ALL) for r in MT.metric_rows(df, ALL).collect()}


def test_long_rows_count_like_short_ones(spark, monkeypatch):
    data = rows()
    short = scores(spark, data)
    assert len(short) == len(data) and short[0] == short[1] == short[3] == (None,) * 4
    monkeypatch.setattr(MT, "BLOCK_BYTES", 300)
    assert scores(spark, data) == short
    monkeypatch.setattr(MT, "LONG_CHARS", -1)
    monkeypatch.setattr(MT, "SEGMENT_UNITS", 7)
    assert scores(spark, data) == short
    monkeypatch.setattr(MT, "LONG_CHARS", 90)        # some of each
    assert scores(spark, data) == short


def test_matches_by_brute_force():
    import numpy as np
    rnd = random.Random(2)
    texts = [["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) for _ in range(2)] for _ in range(40)]
    both = [h for h, _ in texts] + [r for _, r in texts]
    unit, row, side, end, (h, r) = MT._sides(both, 40, "c", lambda x: x)
    got = MT.count_matches(unit, row, side, end, 40, 6)
    for i, (a, b) in enumerate(texts):
        for n in range(1, 7):
            x, y = (Counter(t[j:j + n] for j in range(len(t) - n + 1)) for t in (a, b))
            assert got[n - 1, i] == sum((x & y).values())
    assert (np.array([len(a) for a, _ in texts]) == h).all()


def test_one_text_of_five_million_characters_spreads_over_many_tasks(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(799_999)), lambda i: F.substring(F.md5(i.cast("string")), 1, 5))
    df = spark.range(1).select(F.col("id").alias("row_id"), F.array_join(words, " ").alias("prediction"))
    df = df.withColumn("reference", F.concat(F.col("prediction"), F.lit(" end")))
    long = MT._only_long(MT.eval_frame(df))
    grams = MT.segment_grams(MT._long_rows(long, "c"), "c", 16)
    per_task = [r["count"] for r in grams.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 12 and max(per_task) < 0.25 * sum(per_task)
    assert sum(per_task) == 2 * 4_000_000 * 6 + 18 - 30
    got = MT.metric_rows(df, ["bleu", "meteor"]).first()
    assert got.bleu == pytest.approx(100.0, abs=0.01) and got.meteor == pytest.approx(1.0, abs=0.01)


def test_texts_that_are_not_counted_in_memory_are_not_sent(spark, monkeypatch):
    """Texts of blank rows and of long ones stay out of the short rows' pass; scores are the same."""
    big = "x " * (MT.LONG_CHARS // 2 + 1)
    df = spark.createDataFrame([(1, "a b c d", "a b c e"), (2, "secret", " \n"), (3, None, "secret"), (4, big, "x x")],
                               "row_id long, prediction string, reference string")
    sent, real = [], type(df).mapInArrow

    def spied(self, fn, schema, *a, **kw):
        if "_hyp_low" in self.columns:
            sent.extend(self.collect())
        return real(self, fn, schema, *a, **kw)
    monkeypatch.setattr(type(df), "mapInArrow", spied)
    got = {r.row_id: (r.bleu, r.meteor) for r in MT.metric_rows(df, ["bleu", "meteor"]).collect()}
    assert {r.row_id for r in sent if any(x is not None for x in r[3:])} == {1}
    assert got[2] == got[3] == (None, None) and got[1][1] > 0 and got[4][1] > 0


def test_several_systems_are_counted_like_each_alone():
    import numpy as np
    rnd = random.Random(4)
    for letters, n, longest in (("abc", 40, 30), ("".join(map(chr, range(0x4e00, 0x4e00 + 3000))) + "😀", 30, 200)):
        sides = [["".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n)] for _ in range(3)]
        sides[0][0] = sides[2][0] = sides[2][0] + "xyz" * 9
        got = MT.count_system_matches(*MT._sides(sum(sides, []), n, "c", lambda x: x)[:4], n, 6, 2)
        for s in (0, 1):
            for i in range(n):
                for k in range(1, 7):
                    x, y = (Counter(t[j:j + k] for j in range(len(t) - k + 1)) for t in (sides[s][i], sides[2][i]))
                    assert got[s, k - 1, i] == sum((x & y).values())
    # Units too wide for one key with others.
    unit, end = np.array([0, 1 << 24, 5, 0, 1 << 24, 5, 7]), np.array([3, 3, 3, 7, 7, 7, 7])
    side = np.array([0, 0, 0, 1, 1, 1, 1])
    assert MT.count_matches(unit, side * 0, side, end, 1, 3)[:, 0].tolist() == [3, 2, 1]


def test_13a_words_of_odd_marks(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("a1.,-. \n&quot;<>é9!'(中{|~") for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    split = MT._words_13a()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, x string").select("i", MT.tokenize_13a(F.col("x")).alias("w"))
    assert {r.i: r.w for r in df.collect()} == {i: split(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("long_chars", [None, 90])
def test_compare_runs_reads_the_texts_once(spark, tmp_dir, monkeypatch, long_chars):
    """Both systems come from one pass over the texts; ids that repeat and null texts give the
    rows that each system's own evaluation gives."""
    from pairmine.plans import mt_queries as Q

    docs = [(i, hyp, "en") for i, hyp, _ in rows(30, seed=6)] + [(None, "a b", "en")]
    if long_chars is None:
        docs += [(9, "the cat Dog's 3.14 x", "en"), (9, "a cat", "fr"), (11, None, "en"), (12, "the cat", "en")]
    else:
        monkeypatch.setattr(MT, "LONG_CHARS", long_chars)
    path = str(tmp_dir) + f"/runs{long_chars}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    got = Q.q_compare_runs(spark, path)
    assert "documents.parquet" not in got._jdf.queryExecution().toString()
    a = Q.eval_rows(spark, path, 1)
    t = spark.read.parquet(f"{path}/documents.parquet")
    b = a.select("row_id", "reference").join(
        t.select((F.col("doc_id") + 1).alias("row_id"), F.col("text").alias("prediction")), "row_id")
    want = Q.rounded(MT.compare_runs(*[MT.bleu_rows(x).join(MT.chrf_rows(x), "row_id") for x in (a, b)], ["bleu", "chrf"]))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() >= 26
    assert got.schema == want.schema
