"""FX-1..FX-4: top-k join, combined score, local scoring, density, rank ties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmine.operators import scoring as SC
from pairmine.operators.knn import exact_topk
from pairmine.plans import mining as M

TGT = [(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.6, 0.8])]


def vecs(spark, rows):
    return spark.createDataFrame(rows, "idx long, vec array<float>")


def test_fx1_topk_and_score(spark):
    src, tgt = vecs(spark, [(0, [1.0, 0.0])]), vecs(spark, TGT)
    top3 = exact_topk(src, tgt, 3).filter("ip_rank is not null").orderBy("ip_rank").collect()
    assert [r.tgt_idx for r in top3] == [0, 1, 2]          # 2 beats 4 by id
    allk = exact_topk(src, tgt, 100)
    assert allk.count() == 5                                 # no phantom rows (DV-1)
    sc = SC.rescore_candidates(allk, SC.Params.literal(SC.MiningConfig())).orderBy("tgt_idx").collect()
    exp = {0: 1.0, 1: 0.765714, 2: 0.582222, 3: 0.133333, 4: 0.582222}
    for r in sc:
        assert r.score == pytest.approx(exp[r.tgt_idx], abs=1e-6)


@pytest.mark.parametrize("tgt_blocks", [1, 3])
def test_topk_matches_bruteforce(spark, tgt_blocks):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(30, 8)).astype(np.float32)
    t = rng.normal(size=(70, 8)).astype(np.float32)
    t[10] = t[11]                                            # duplicate vectors tie
    src = vecs(spark, [(i, v.tolist()) for i, v in enumerate(s)])
    tgt = vecs(spark, [(i, v.tolist()) for i, v in enumerate(t)])
    got = exact_topk(src, tgt, 7, n_tgt_blocks=tgt_blocks, n_src_blocks=4).toPandas()
    D = np.round(s.astype(np.float64) @ t.astype(np.float64).T, 9)
    Q = np.round(((s[:, None, :].astype(np.float64) - t[None, :, :]) ** 2).sum(-1), 9)
    ids = np.arange(70)
    for i in range(30):
        ip = got[(got.src_idx == i) & got.ip_rank.notna()].sort_values("ip_rank").tgt_idx.tolist()
        assert ip == ids[np.lexsort((ids, -D[i]))][:7].tolist()
        l2 = got[(got.src_idx == i) & got.l2_rank.notna()].sort_values("l2_rank").tgt_idx.tolist()
        assert l2 == ids[np.lexsort((ids, Q[i]))][:7].tolist()


def _adaptive(spark, scores, cfg=SC.MiningConfig()):
    df = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores)], "src_idx long, tgt_idx long, score double")
    return {r.tgt_idx: r for r in SC.local_zscore(df, SC.Params.literal(cfg)).collect()}


def test_fx2_local_scoring(spark):
    out = _adaptive(spark, [0.9, 0.8, 0.7, 0.2])
    assert sorted(out) == [0, 1, 2]
    assert out[0].z_score == pytest.approx(0.928477, abs=1e-6)
    assert out[0].adaptive_score == pytest.approx(0.663797, abs=1e-6)
    out = _adaptive(spark, [1.0] + [0.0] * 30)
    assert len(out) == 31 and out[0].z_score == 5.0 and out[0].adaptive_score == pytest.approx(1.0)
    out = _adaptive(spark, [0.5, 0.5, 0.5])
    assert all(r.adaptive_score == 0.5 and r.z_score == 0 and r.base_score is None for r in out.values())
    out = _adaptive(spark, [0.9, 0.1])
    assert out[0].adaptive_score == 0.9 and out[1].adaptive_score == 0.1
    off = SC.MiningConfig(base_weight=1.0, z_weight=0.0)
    out = _adaptive(spark, [1.2, 0.5, 0.4], off)
    assert [out[i].adaptive_score for i in range(3)] == [1.2, 0.5, 0.4]


def test_fx3_density(spark):
    tgt = vecs(spark, TGT)
    d = {r.tgt_idx: r for r in SC.density_stats(tgt, 2).collect()}
    assert d[0].density == pytest.approx(0.15, abs=1e-6)
    assert d[1].density == pytest.approx(0.02, abs=1e-6)
    assert d[2].density == pytest.approx(0.01, abs=1e-6) and d[4].density == pytest.approx(0.01, abs=1e-6)
    lone = SC.density_stats(vecs(spark, [(7, [1.0, 0.0])]), 20).collect()[0]
    assert lone.density == 0.5 and not lone.has_neighbors
    # Both bonus and penalty
    df = spark.createDataFrame([(0, 1, 0.5, 0.2)], "src_idx long, tgt_idx long, adaptive_score double, _density_raw double")
    cfg = SC.MiningConfig(sparse_threshold=0.1, crowded_threshold=0.3, sparse_bonus=0.3, crowded_penalty=0.15)
    r = SC.density_adjust(df, SC.Params.literal(cfg)).collect()[0]
    assert r.final_score == pytest.approx(0.65)


def test_fx4_rank_ties(spark):
    rows = [(0, 7, 0.92, 1.0), (0, 9, 0.97, 1.0), (0, 3, 0.5, 0.6)]
    df = spark.createDataFrame(rows, "src_idx long, tgt_idx long, adaptive_score double, final_score double")
    on = SC.pre_rank(df, SC.Params.literal(SC.MiningConfig(top_after_filtering=2)))
    assert {r.tgt_idx: r.pre_rank for r in on.collect()} == {9: 1, 7: 2}
    off = SC.pre_rank(df, SC.Params.literal(SC.MiningConfig(top_after_filtering=2, base_weight=1.0, z_weight=0.0)))
    assert {r.tgt_idx: r.pre_rank for r in off.collect()} == {7: 1, 9: 2}


def test_mine_pairs_with_plugin_scorer(spark):
    src = vecs(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    tgt = vecs(spark, TGT)
    attrs = lambda df: df.select("idx", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("text"))
    scorer = lambda s, t: [0.9 if x.endswith("1") else 0.1 for x in t]
    res = M.mine_pairs(src, tgt, attrs(src), attrs(tgt), SC.MiningConfig(search_k=5, quality_threshold=0.5),
                       scorer=scorer, materialize=True)
    fp = res.final_pairs.collect()
    assert [r.tgt_idx for r in fp] == [1, 1]
    m = res.metrics.collect()[0]
    assert m.total == 2 and m.successful == 2 and m.failed == 0


def test_vectors_of_another_length_take_no_part(spark):
    from pairmine.operators import knn
    src = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, None)], "idx long, vec array<float>")
    tgt = spark.createDataFrame([(0, [0.5, 0.0]), (1, [0.1, 0.2]), (2, [9.0, 9.0, 9.0]), (3, [])], "idx long, vec array<float>")
    out = knn.exact_topk(src, tgt, 5).collect()
    assert sorted((r.src_idx, r.tgt_idx) for r in out) == [(0, 0), (0, 1)]
    assert knn.exact_topk(src, tgt.filter("idx > 5"), 5).count() == 0


def test_vectors_without_a_finite_similarity_are_not_compared(spark, monkeypatch):
    """Broken vectors are dropped before the blocks: they cost no pair."""
    from pairmine.operators import knn
    nan, inf = float("nan"), float("inf")
    seen, plan = [], knn.plan_blocks

    def planned(n_s, n_t, *rest):
        seen.append(n_t)
        return plan(n_s, n_t, *rest)
    monkeypatch.setattr(knn, "plan_blocks", planned)
    bad = [(10, [nan, 1.0]), (11, [inf, 0.0]), (12, [-inf, nan]), (13, [None, 1.0]), (14, None)]
    out = exact_topk(vecs(spark, TGT + bad), vecs(spark, TGT + bad), 3).collect()
    assert seen == [len(TGT)] and {r.src_idx for r in out} == {r.tgt_idx for r in out} == set(range(5))


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e18, 1e160])
def test_lists_are_those_of_double_precision(monkeypatch, scale):
    """Near ties that single precision cannot tell apart, and lengths that it cannot hold."""
    from pairmine.operators import knn
    rng = np.random.default_rng(5)
    s = rng.normal(size=(40, 16))
    t = rng.normal(size=(1, 16)) + rng.normal(size=(900, 16)) * 1e-7
    t[rng.random(900) < 0.5] += rng.normal(size=16)
    if scale < 1:
        s = s / scale
    t = t * scale
    products = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: products.append(len(a[1])) or real(*a))
    monkeypatch.setattr(knn, "TILE_PAIRS", 40 * 100)
    got = knn.block_topk(np.arange(40), s, np.arange(900), t, 9, True, False)
    D = np.round(real("ij,kj->ik", s, t), 9)
    for i in range(40):
        own = got[got.src_idx == i].sort_values("ip_rank").tgt_idx.to_numpy()
        assert len(own) == 9
        # equal up to what the last bit of a product may change
        assert np.allclose(D[i, own], np.sort(D[i])[::-1][:9], rtol=1e-13, atol=2e-9)


def test_most_pairs_of_a_large_block_are_passed_over(monkeypatch):
    """Only pairs that may enter a list are computed in double precision, selected and sorted."""
    from pairmine.operators import knn
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    taken, add = [], knn._Best.add
    monkeypatch.setattr(knn._Best, "add", lambda self, rows, *rest: taken.append(len(rows)) or add(self, rows, *rest))
    knn.block_topk(np.arange(1000), x[:1000], np.arange(20_000), x, 10, True, True)
    assert sum(taken) < 0.02 * 2 * 1000 * 20_000


def test_no_tile_is_selected_whole(monkeypatch):
    """The first tile, whose lists are still empty, is passed over by its own k-th best; vectors of
    very different lengths are held to each list's bound."""
    from pairmine.operators import knn
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[4000::50] *= 0.01
    monkeypatch.setattr(knn, "_select_topk", lambda *_: 1 / 0)
    monkeypatch.setattr(knn, "TILE_PAIRS", 50 * 3000)
    got = knn.block_topk(np.arange(50), x[:50], np.arange(9000), x, 12, True, True)
    D = np.round(x[:50] @ x.T, 9)
    Q = np.round(((x[:50, None] - x[None]) ** 2).sum(-1), 9)
    for i in range(50):
        own = got[got.src_idx == i]
        ip, l2 = (own[own[c].notna()].sort_values(c) for c in ("ip_rank", "l2_rank"))
        assert ip.tgt_idx.tolist() == np.argsort(-D[i], kind="stable")[:12].tolist()
        assert l2.tgt_idx.tolist() == np.argsort(Q[i], kind="stable")[:12].tolist()


def test_places_of_a_tile_that_does_not_fill_its_eights():
    from pairmine.operators import knn
    rng = np.random.default_rng(9)
    for shape in ((1, 1), (3, 5), (7, 16), (20, 333)):
        tile, least = rng.random(shape, np.float32), rng.random(shape[0]).astype(np.float32)
        assert knn._places(tile, least).tolist() == np.flatnonzero((tile >= least[:, None]).ravel()).tolist()


def test_the_blocks_of_a_join_are_computed_once(spark):
    """Both lists are merged over one exchange; ids that repeat meet as before."""
    src, tgt = vecs(spark, [(i, [1.0, float(i)]) for i in range(6)]), vecs(spark, TGT + [(4, [0.1, 0.2])])
    joined = exact_topk(src, tgt, 3, n_tgt_blocks=3, n_src_blocks=2)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1
    rows = joined.collect()
    for i in range(6):
        own = [r for r in rows if r.src_idx == i]
        assert sorted(r.ip_rank for r in own if r.ip_rank) == sorted(r.l2_rank for r in own if r.l2_rank) == [1, 2, 3]


def test_runs_of_one_query_share_what_they_search(spark, monkeypatch):
    """failure_reasons makes its scored rows once, covered_sources one density, and
    sweep_best_pairs one search for results and pairs."""
    from pairmine.plans import mining_queries as MQ
    from pairmine.plans import sweep_queries as SQ
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas")
    asked, real = [], SC.density_stats
    monkeypatch.setattr(SC, "density_stats", lambda *a, **kw: asked.append(1) or real(*a, **kw))
    assert plan(MQ.q_failure_reasons(spark, sf)) == 0 and len(asked) == 1
    assert plan(MQ.q_covered_sources(spark, sf)) == 2 and len(asked) == 2
    assert plan(SQ.q_sweep_best_pairs(spark, sf)) == 2 and len(asked) == 3      # the scoring passes only
