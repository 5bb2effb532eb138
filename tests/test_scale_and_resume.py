"""Tiles and bad vectors in the top-k join, lossless sweeps, score-once and resume, model loads."""
import os
import resource

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairmine.operators import knn
from pairmine.operators import models as MD
from pairmine.operators import quality as Q
from pairmine.operators import scoring as SC
from pairmine.operators import trainprep as TP
from pairmine.plans import mining as M
from pairmine.plans import sweep as SW
from pairmine.sources import io as IO
from pairmine.sources.dense_index import dense_index
from pairmine.streaming import incremental as INC


def vecs(spark, rows):
    return spark.createDataFrame(rows, "idx long, vec array<float>")


def test_tiles_do_not_change_the_lists(monkeypatch):
    rng = np.random.default_rng(2)
    S, T = rng.integers(-3, 4, (23, 5)).astype(float), rng.integers(-3, 4, (61, 5)).astype(float)     # many ties
    sid, tid = np.arange(23), rng.permutation(61)
    whole = knn.block_topk(sid, S, tid, T, 6, True, True).sort_values(["src_idx", "tgt_idx"])
    monkeypatch.setattr(knn, "TILE_PAIRS", 40)
    tiled = knn.block_topk(sid, S, tid, T, 6, True, True).sort_values(["src_idx", "tgt_idx"])
    assert whole.reset_index(drop=True).equals(tiled.reset_index(drop=True))


def test_large_block_stays_small():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 8))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = knn.block_topk(np.arange(20_000), x, np.arange(20_000), x, 3, True, False)
    assert len(out) == 60_000
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1024      # MB


@pytest.mark.parametrize("blocks", [1, 3])
def test_nan_and_null_vectors_cost_nobody_else(spark, blocks):
    nan = float("nan")
    src = vecs(spark, [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, None)])
    tgt = vecs(spark, [(0, [0.5, 0.0]), (1, [nan, 0.0]), (2, [float("inf"), nan]), (3, None), (4, [0.1, 0.0])])
    out = knn.exact_topk(src, tgt, 4, n_tgt_blocks=blocks).collect()
    assert sorted((r.src_idx, r.tgt_idx, r.ip_rank) for r in out) == [(0, 0, 1), (0, 4, 2)]


def test_block_plan_is_square_and_bounded():
    n_sb, n_tb = knn.plan_blocks(10 ** 8, 10 ** 8, 64, 4000)
    assert n_sb == n_tb and 10 ** 8 / n_sb * 64 * 8 <= knn.BLOCK_BYTES
    n_sb, n_tb = knn.plan_blocks(10 ** 6, 10 ** 6, 64, 4000)
    assert 8000 <= n_sb * n_tb <= 10000 and 0.8 < n_sb / n_tb < 1.25
    assert knn.plan_blocks(400, 1600, 64, 8) == (1, 1)


def test_density_without_finite_neighbours_and_restricted(spark):
    nan = float("nan")
    two = {r.tgt_idx: r for r in SC.density_stats(vecs(spark, [(0, [nan, 0.0]), (1, [1.0, 0.0])]), 5).collect()}
    assert two[0].avg_neighbor_sim == 0.0 and two[0].density == 0.5 and two[0].has_neighbors          # bonus and penalty still apply (R16)
    rng = np.random.default_rng(4)
    tgt = vecs(spark, [(i, rng.normal(size=4).astype(float).tolist()) for i in range(40)])
    every = {r.tgt_idx: r.density for r in SC.density_stats(tgt, 5).collect()}
    some = {r.tgt_idx: r.density for r in SC.density_stats(tgt, 5, only=tgt.filter("idx % 7 = 1")).collect()}
    assert sorted(some) == [1, 8, 15, 22, 29, 36] and all(every[i] == d for i, d in some.items())


def _sweep_inputs(spark):
    rng = np.random.default_rng(5)
    src = vecs(spark, [(i, rng.normal(size=4).tolist()) for i in range(4)])
    tgt = vecs(spark, [(i, rng.normal(size=4).tolist()) for i in range(12)])
    attrs = lambda df: df.select("idx", F.concat(F.lit("t "), F.col("idx").cast("string")).alias("text"))
    return src, tgt, attrs(src), attrs(tgt)


def _grid(spark, n, **change):
    base = dict(SW.BASELINE_COMMON, base_weight=0.6, z_weight=0.4, sparse_bonus=0.1, crowded_penalty=0.15, search_k=3)
    df = spark.range(1, n + 1).withColumnRenamed("id", "experiment_id")
    for c in SW.GRID_COLUMNS[1:]:
        df = df.withColumn(c, F.lit(change.get(c, base[c])).cast("double"))
    return df


def test_sweep_loses_no_config(spark):
    grid = _grid(spark, 3)
    for i, c in ((2, "z_threshold"), (3, "search_k")):
        grid = grid.withColumn(c, F.when(F.col("experiment_id") != i, F.col(c)))
    gone = _grid(spark, 1, z_threshold=5.0).withColumn("experiment_id", F.lit(4).cast("long"))
    src, tgt, sa, ta = _sweep_inputs(spark)
    # With fewer than three candidates a source has no z-score to gate, so all are taken.
    res = SW.run_sweep(grid.unionByName(gone.withColumn("search_k", F.lit(12.0))), src, tgt, sa, ta,
                       quality_expr=lambda d: F.lit(1.0), materialize=False).results
    got = {r.experiment_id: (r.status, r.error) for r in res.collect()}
    assert got[1] == ("completed", None)
    assert got[2] == ("failed", "missing parameter: z_threshold") and got[3] == ("failed", "missing parameter: search_k")
    assert got[4] == ("failed", "no candidate left")


def test_sweep_takes_a_large_grid(spark):
    src, tgt, sa, ta = _sweep_inputs(spark)
    grid = _grid(spark, 200_000).withColumn("quality_threshold", F.col("experiment_id") / 400_000.0)
    res = SW.run_sweep(grid, src.limit(1), tgt, sa, ta, quality_expr=lambda d: F.lit(0.25), materialize=False).results
    n = {r.successful: r["count"] for r in res.groupBy("successful").count().collect()}
    assert n == {1: 100_000, 0: 100_000}


def test_sweep_plan_sorts_nothing_per_config(spark, monkeypatch):
    src, tgt, sa, ta = _sweep_inputs(spark)
    r = SW.run_sweep(_grid(spark, 2), src, tgt, sa, ta, quality_expr=lambda d: F.lit(1.0), materialize=False).ranked
    plan = r._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "experiment_id" not in "".join(
        line for line in plan.splitlines() if "Window" in line)
    # Chunks of the grid and of the cells make no difference.
    grid = _grid(spark, 7).withColumn("base_weight", F.col("experiment_id") / 10).withColumn("search_k", F.col("experiment_id") + 1.0)
    runs = []
    for chunk, cells in ((1024, 1 << 20), (2, 10)):
        monkeypatch.setattr(SW, "GRID_CHUNK", chunk)
        monkeypatch.setattr(SW, "CELLS", cells)
        out = SW.run_sweep(grid, src, tgt, sa, ta, quality_expr=lambda d: F.lit(1.0), materialize=False).ranked
        runs.append(sorted(tuple(x) for x in out.select("experiment_id", "src_idx", "pre_rank", "tgt_idx", "final_score", "tgt_text_key").collect()))
    assert runs[0] == runs[1] and len(runs[0]) > 20


def test_sweep_equals_single_runs(spark):
    src, tgt, sa, ta = _sweep_inputs(spark)
    grid = _grid(spark, 6).withColumn("base_weight", F.when(F.col("experiment_id") == 1, 1.0).otherwise(0.5))
    grid = grid.withColumn("z_weight", F.when(F.col("experiment_id") == 1, 0.0).otherwise(0.5))
    grid = grid.withColumn("search_k", F.element_at(F.array(*[F.lit(float(k)) for k in (3, 2, 5, 8, 12, 1)]), F.col("experiment_id").cast("int")))
    grid = grid.withColumn("top_after_filtering", F.col("experiment_id").cast("double"))
    ranked = SW.run_sweep(grid, src, tgt, sa, ta, quality_expr=lambda d: F.lit(1.0), materialize=False).ranked
    for r in grid.collect():
        cfg = SC.MiningConfig(**{c: (int(r[c]) if c in SW.INT_PARAMS else r[c]) for c in SW.PARAMETERS})
        one = M.mine_pairs(src, tgt, sa, ta, cfg, quality_expr=lambda d: F.lit(1.0), materialize=False).ranked
        a, b = ([tuple(None if v is None else round(v, 9) for v in x) for x in df.select(*SC.RANKED_COLS).orderBy("src_idx", "pre_rank").collect()]
                for df in (ranked.filter(F.col("experiment_id") == r["experiment_id"]), one))
        assert a == b and a


def test_every_pair_is_scored_once_over_all_outputs(spark, tmp_dir):
    src, tgt, sa, ta = _sweep_inputs(spark)
    log = os.path.join(tmp_dir, "calls")

    def scorer(s, t):
        with open(log, "a") as f:
            f.writelines(f"{a}|{b}\n" for a, b in zip(s, t))
        return [0.9] * len(s)
    res = M.mine_pairs(src, tgt, sa, ta, SC.MiningConfig(search_k=5, quality_threshold=0.5), scorer=scorer)
    n = res.ranked.count()
    for out in (res.final_pairs, res.metrics, res.rank_distribution, res.failures, res.missing_sources):
        out.collect()
    calls = open(log).read().splitlines()
    assert len(calls) == len(set(calls)) == n
    # A resumed run scores nothing that has a quality, and what failed again.
    before = res.scored.select("src_idx", "tgt_idx", F.when(F.col("pre_rank") > 1, F.col("quality")).alias("quality"),
                               F.lit("x").alias("error"))
    again = M.mine_pairs(src, tgt, sa, ta, SC.MiningConfig(search_k=5, quality_threshold=0.5), scorer=scorer, scored_before=before)
    assert again.scored.filter("quality is null").count() == 0
    assert len(open(log).read().splitlines()) - n == 4


def test_failed_scores_are_tried_again(spark, tmp_dir):
    scored = os.path.join(tmp_dir, "scored")
    batch = spark.createDataFrame([(0, i, "s", f"t{i}") for i in range(4)], INC.CANDIDATE_SCHEMA)

    def flaky(s, t):
        if any(x == "t2" for x in t):
            raise RuntimeError("busy")
        return [0.5] * len(t)
    assert INC.score_new_pairs(batch, scored, flaky) == 4
    assert INC.read_scored(spark, scored).filter("quality is null").count() == 1
    assert INC.score_new_pairs(batch, scored, lambda s, t: [0.7] * len(t)) == 1
    got = {r.tgt_idx: r.quality for r in INC.read_scored(spark, scored).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.7, 3: 0.5}
    assert Q.candidate_coverage(batch, INC.read_scored(spark, scored), 1).first().n_remaining == 0


def test_models_load_once_per_process(spark, tmp_dir):
    loads = os.path.join(tmp_dir, "loads")

    def build():
        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts, a, b: list(texts)
    df = spark.range(64).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("t")).repartition(16)
    f = MD.Factory(f"counted-{tmp_dir}", build)
    assert MD.translate(df, "t", "a", "b", translator=f).filter("translation is not null").count() == 64
    pids = open(loads).read().split()
    assert len(pids) == len(set(pids))


def test_model_metric_blank_and_failing_rows(spark):
    ev = spark.createDataFrame([(0, "s", "ab", "abcd"), (1, "s", "a", " "), (2, "s", "boom", "x"), (3, "s", "a", None)],
                               "row_id long, src string, hyp string, ref string")

    def metric(src, hyp, ref):
        if any(h == "boom" for h in hyp):
            raise RuntimeError("bad")
        return [len(h) / 4 for h in hyp]
    out = {r.row_id: r.m for r in MD.model_metric(ev, MD.Factory("m4-test", lambda: metric), "m", "src", "hyp", "ref").collect()}
    assert out == {0: 0.5, 1: None, 2: None, 3: None}


def test_special_tokens_are_not_counted_again(spark):
    df = spark.createDataFrame([("[PAD] a [PAD] [UNK]",)], "t string")
    assert {r.token: r.token_id for r in TP.build_vocab(df, "t").collect()} == \
        {"[PAD]": 0, "[UNK]": 1, "[SOS]": 2, "[EOS]": 3, "a": 4}


def test_dense_index_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    out = dense_index(df, ["k"], num_partitions=2000).collect()
    assert all(r.k == r.idx for r in out) and len(out) == 5000


def test_null_markers_and_broken_grid_cells(spark, tmp_dir):
    p = os.path.join(tmp_dir, "p.csv")
    with open(p, "w") as f:
        f.write("a,b\nx,y\nNA,y\nx,null\n,y\nnone,y\n")
    assert [(r.a, r.b) for r in IO.read_pairs_csv(spark, p, "a", "b").orderBy("idx").collect()] == [("x", "y"), ("none", "y")]
    g = os.path.join(tmp_dir, "g.csv")
    cols = SW.GRID_COLUMNS
    pd.DataFrame([[1] + [0.5] * 12, [2, "oops"] + [0.5] * 11], columns=cols).to_csv(g, index=False)
    assert [r.search_k for r in SW.read_param_grid(spark, g).orderBy("experiment_id").collect()] == [0, None]


def test_mine_corpus_writes_its_sources_in_parallel(spark, monkeypatch):
    from pairmine.plans import io_queries as IQ

    class Written(Exception):
        pass

    def stop(df, *_):
        raise Written(df._jdf.queryExecution().analyzed().toString())

    monkeypatch.setattr(IQ.IO, "write_text_corpus", stop)
    with pytest.raises(Written) as plan:
        IQ.q_mine_corpus(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression [item_id" in str(plan.value)
    assert not any(line.strip().endswith("], 1") for line in str(plan.value).splitlines() if "RepartitionByExpression" in line)
