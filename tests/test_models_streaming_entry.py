"""Model plug-ins, incremental scoring stream, and the driver contract."""
import os

import numpy as np
from pyspark.sql import functions as F

from pairmine.operators import models as MD
from pairmine.operators import quality as Q
from pairmine.streaming import incremental as INC


def test_embed_unit_vectors(spark):
    df = spark.createDataFrame([(0, "hello world"), (1, ""), (2, "hallo welt")], "idx long, t string")
    out = {r.idx: np.array(r.vec) for r in MD.embed(df, "t").collect()}
    assert abs(np.linalg.norm(out[0]) - 1) < 1e-5 and np.linalg.norm(out[1]) == 0


def test_translate_and_safe_scores(spark):
    df = spark.createDataFrame([(0, "a"), (1, "boom"), (2, "c")], "idx long, t string")

    def tr(texts, s, t):
        if any(x == "boom" for x in texts):
            raise RuntimeError("bad row")
        return [x.upper() for x in texts]
    out = {r.idx: (r.translation, r.error) for r in MD.translate(df, "t", "xx", "yy", translator=tr).collect()}
    assert out[0] == ("A", None) and out[1][0] is None and "bad row" in out[1][1]
    pairs = spark.createDataFrame([(0, 1, "a", "b"), (0, 2, "a", "boom")], "src_idx long, tgt_idx long, src_text string, tgt_text string")

    def sc(s, t):
        if any(x == "boom" for x in t):
            raise ValueError("x")
        return [0.5] * len(t)
    got = {r.tgt_idx: r.quality for r in Q.score_pairs(pairs, sc).collect()}
    assert got == {1: 0.5, 2: None}


def test_incremental_scoring_stream(spark, tmp_dir):
    cand = os.path.join(tmp_dir, "cand")
    scored = os.path.join(tmp_dir, "scored")
    ck = os.path.join(tmp_dir, "ck")
    rows = [(0, i, "s", f"t{i}") for i in range(5)]
    spark.createDataFrame(rows, INC.CANDIDATE_SCHEMA).write.parquet(cand)
    scorer = lambda s, t: [0.1] * len(t)
    INC.start_incremental_scoring(spark, cand, scored, ck, scorer).awaitTermination()
    assert spark.read.parquet(scored).count() == 5
    more = [(0, i, "s", f"t{i}") for i in range(3, 8)]          # 3 and 4 already scored
    spark.createDataFrame(more, INC.CANDIDATE_SCHEMA).write.mode("append").parquet(cand)
    INC.start_incremental_scoring(spark, cand, scored, ck, scorer).awaitTermination()
    got = spark.read.parquet(scored)
    assert got.count() == 8 and got.select("src_idx", "tgt_idx").distinct().count() == 8


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "margin" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60


def test_oracles_small(spark):
    import sys
    sys.path.insert(0, os.path.dirname(__file__))
    from oracle_harness import compare
    res = compare(spark, "/root/testdata/sf0.001",
                  ["knn_inner_product", "self_knn_density", "pre_rank", "mine_pairs", "bleu_rows",
                   "meteor_rows", "pack_seq2seq", "split_stratified", "read_sentences"], verbose=False)
    assert all(v == "OK" for v in res.values()), res
