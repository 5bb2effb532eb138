"""op3 quality classifier, op5 toxicity, op6 nearest neighbours: held-out accuracy and recall."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmine.llm import ann, quality, toxicity
from pairmine.llm.common import table
from tests.llm import util

SF = "/root/testdata/sf0.01"


def test_folding_undoes_homoglyphs_and_digits():
    assert toxicity.fold("1D10T Мoroп") == toxicity.fold("idiot moroп")
    m = toxicity.Matcher([(toxicity.fold("idiot"), 2.0), (toxicity.fold("clown") + " ", 3.0)])
    assert m.features("You 1d10ts, а clоwn!") == (5.0, 2.0, 4.0)      # Cyrillic a and o
    assert m.features("class clown in a patriotic clownfish shop")[1] == 0     # exception; whole words; inside words
    assert m.features(None) == (0.0, 0.0, 0.0)
    # Invisible characters, accents, compatibility letters, spelled-out words, signs.
    for text in ("you id\u200biot", "you \u00efd\u00efot", "you i\u0301diot", "you \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d",
                 "you \uff49\uff44\uff49\uff4f\uff54", "you i.d.i.o.t!", "you i-d-1-0-t", "you id!ot", "you i\u00add\u200di\u2060ot"):
        assert m.features(text)[:2] == (2.0, 1.0), text
    assert toxicity.fold("$tupid a$$hole @ss") == toxicity.fold("stupid asshole ass")
    for text in ("v. 1.2.3.4 e.g. A.B", "costs $5 or 5$", "mail me @ home!", "the id, i.e. otter"):
        assert m.features(text)[1] == 0, text


def _accuracy(spark, out, label):
    rows = out.join(table(spark, SF, "labels").select("doc_id", F.col(label).alias("y")), "doc_id").filter("held_out")
    r = rows.select("y", "predicted").collect()
    return sum(x["y"] == x["predicted"] for x in r) / len(r)


def test_toxicity_learns_from_the_training_folds_only(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert _accuracy(spark, out, "toxic") >= 0.9
    lied = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic"))
                             .otherwise(F.col("toxic")).cast("int"))
    again = toxicity.fit(docs, lied)       # held-out labels make no difference
    assert again.entries == model.entries and again.coef == model.coef
    r = out.first()
    assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = util.frame(spark, util.EDGE + [(50, "what an id1ot and a m0ron", "en", "s", 1)], extra=True)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(util.EDGE) + 1 and all(0 <= r["score"] <= 1 for r in out)
    assert [r["doc_id"] for r in out if r["predicted"]] == [50]
    assert toxicity.drop_toxic(docs, model).count() == len(util.EDGE)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_accuracy_and_edges(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    assert _accuracy(spark, quality.score(docs, model), "quality") >= 0.93
    edge = quality.score(util.frame(spark, util.EDGE, extra=True), model).collect()
    assert len(edge) == len(util.EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    blind = quality.fit(util.frame(spark, util.EDGE), labels.limit(0))
    assert {r["score"] for r in quality.score(util.frame(spark, util.EDGE), blind).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def _search(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return ann.search(df, **kw).orderBy("query_id", "rank").collect()


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    cents = rng.normal(size=(30, 32))
    x = (cents[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 32))).astype(np.float32)
    out = _search(spark, [(i, [float(a) for a in v], 0) for i, v in enumerate(x)])
    x = x.astype(float)
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = [r for r in out if r["query_id"] == q]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        hit += len({r["vec_id"] for r in mine} & set(np.argsort(d)[:10].tolist()))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in mine)
    assert hit / 600 >= 0.9


def test_ann_edges_ties_and_bad_vectors(spark):
    v, nan = [1.0, 0.0, 2.0], float("nan")
    rows = [(i, v, 0) for i in range(0, 30)] + [(5, v, 0)]                   # copies, a repeated row
    rows += [(100, v, 0), (200, None, 0), (300, [0.0, 0.0, 0.0], 0), (400, [1.0, nan, 0.0], 0), (500, [1.0, None, 2.0], 0),
             (600, [float("inf"), 1.0, 1.0], 0), (700, [1.0], 0), (None, v, 0)]
    out = _search(spark, rows)
    assert {r["query_id"] for r in out} == {0, 100}
    assert [r["vec_id"] for r in out if r["query_id"] == 0] == list(range(1, 11))
    assert [r["vec_id"] for r in out if r["query_id"] == 100] == list(range(0, 10))
    assert len(_search(spark, [(0, v, 0), (1, [2.0, 2.0, 2.0], 0)])) == 1       # fewer candidates than k
    assert _search(spark, [(0, v, 0)]) == [] and _search(spark, []) == []
