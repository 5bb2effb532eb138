"""FX-5..FX-8: gate, best pair, margin, run metrics, grids, leaderboard."""
import pytest
from pyspark.sql import functions as F

from pairmine.operators import run_metrics as RM
from pairmine.operators import selection as SEL
from pairmine.plans import sweep as SW


def test_fx5_gate_and_best(spark):
    rows = [(0, 1, 1, 0.74, 0.9, "a"), (0, 2, 2, 0.80, 0.8, "b"), (0, 3, 3, 0.80, 0.7, "c"), (0, 4, 4, None, 0.6, "d")]
    df = spark.createDataFrame(rows, "src_idx long, tgt_idx long, pre_rank int, quality double, final_score double, tgt_text_key string")
    assert SEL.quality_gate(df, 0.75).count() == 2
    best = SEL.best_per_source(df, 0.75).collect()
    assert [r.tgt_idx for r in best] == [2]
    assert SEL.best_per_source(df, 0.9).count() == 0
    fr = SEL.failure_reasons(df, SEL.best_per_source(df, 0.9)).collect()[0]
    assert fr.max_quality == 0.8
    assert SEL.best_per_source(df.withColumn("quality", F.lit(0.75)), 0.75).count() == 1


def _margin(spark, finals, chosen_pos, keys=None):
    keys = keys or [str(i) for i in range(len(finals))]
    rows = [(0, i, i + 1, 1.0 if i == chosen_pos else 0.0, f, keys[i]) for i, f in enumerate(finals)]
    df = spark.createDataFrame(rows, "src_idx long, tgt_idx long, pre_rank int, quality double, final_score double, tgt_text_key string")
    return SEL.best_per_source(df, 0.5).collect()[0].margin


def test_fx6_margin(spark):
    assert _margin(spark, [0.7, 0.6, 0.5], 1) == pytest.approx(-0.1)
    assert _margin(spark, [0.6], 0) == 0.0
    assert _margin(spark, [0.6, 0.9, 0.5], 0, ["x", "x", "y"]) == pytest.approx(0.1)


def test_fx7_run_metrics(spark):
    rows = [(0, 1, -0.1), (1, 1, 0.0), (2, 2, 0.1), (3, 5, 0.2)]
    fp = spark.createDataFrame(rows, "src_idx long, pre_rank int, margin double")
    m = RM.run_summary(fp, 6).collect()[0]
    assert m.total_weighted_score == pytest.approx(2.8)
    assert m.weighted_score == pytest.approx(0.466667, abs=1e-6)
    assert m.success_rate == pytest.approx(66.666667, abs=1e-5)
    assert (m.rank_1_count, m.rank_2_count, m.rank_3_count) == (2, 1, 0)
    assert m.rank_1_percentage == 50.0 and m.rank_2_percentage == 25.0
    assert m.avg_selected_margin == pytest.approx(0.05) and m.std_selected_margin == pytest.approx(0.111803, abs=1e-6)
    one = RM.run_summary(fp.limit(1), 6).collect()[0]
    assert one.std_selected_margin == 0.0
    none = RM.run_summary(fp.filter("false"), 6).collect()[0]
    assert none.successful == 0 and none.weighted_score == 0.0 and none.avg_selected_margin == 0.0


def test_fx8_grids(spark):
    g = SW.grid_minimal(spark)
    assert g.count() == 324 and SW.grid_focused(spark).count() == 864
    assert [r.experiment_id for r in SW.grid_baseline(spark).collect()] == [10001, 10002, 10003]
    r = {x.experiment_id: x for x in g.filter("experiment_id <= 3").collect()}
    assert (r[1].base_weight, r[1].z_weight, r[1].sparse_bonus, r[1].crowded_penalty) == (0.6, 0.4, 0.01, 0.01)
    assert (r[1].cosine_weight, r[1].l2_weight, r[1].sparse_threshold, r[1].crowded_threshold) == (0.6, 0.4, 0.1, 0.1)
    assert (r[2].sparse_threshold, r[2].crowded_threshold) == (0.1, 0.3)
    assert (r[3].sparse_threshold, r[3].crowded_threshold) == (0.3, 0.1)


def test_fx8_leaderboard(spark):
    res = spark.createDataFrame([(1, "completed", 0.5, 0.1), (2, "completed", 0.7, 0.2), (3, "completed", 0.7, 0.3),
                                 (4, "failed", 0.0, 0.0)],
                                "experiment_id long, status string, weighted_score double, avg_selected_margin double")
    assert SW.best_experiment(res).collect()[0].experiment_id == 2
    flags = [r.is_new_best for r in SW.running_best(res).orderBy("experiment_id").collect()]
    assert flags == [True, True, False, False]
    assert SW.best_by_margin(res).collect()[0].experiment_id == 3
    assert SW.best_experiment(res.filter("status = 'failed'")).count() == 0
