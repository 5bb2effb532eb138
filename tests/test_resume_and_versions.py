"""Versioned stages, resumed corpus runs, model jobs that survive bad rows."""
import os

import pytest
from pyspark.sql import functions as F

from pairmine.operators import models as MD
from pairmine.operators import quality as Q
from pairmine.operators import scoring as SC
from pairmine.plans import mining as M
from pairmine.plans import sweep as SW
from pairmine.sources import io as IO
from pairmine.sources import versions
from pairmine.streaming import incremental as INC

CFG = SC.MiningConfig(search_k=3, top_after_filtering=2, quality_threshold=0.0)


def counted(tmp_dir, name="counted"):
    """A factory whose model writes down its loads and the pairs that it scores."""
    loads, calls = os.path.join(tmp_dir, f"{name}-loads"), os.path.join(tmp_dir, f"{name}-calls")

    def build():
        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")

        def score(src, tgt):
            with open(calls, "a") as f:
                f.writelines(f"{a}|{b}\n" for a, b in zip(src, tgt))
            return Q.overlap_scorer(src, tgt)
        return score

    def seen(path):
        return open(path).read().splitlines() if os.path.exists(path) else []
    return MD.Factory(f"{name}-{tmp_dir}", build), lambda: seen(loads), lambda: seen(calls)


def lines(path, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w") as f:
        f.write("\n".join(rows) + "\n")


SRC = ["red apple on a tree", "the old house by the river", "blue sky and sun"]
TGT = ["an apple tree", "house at a river", "sun in the sky", "green grass", "the old tree"]


def mine(spark, root, src, tgt, scorer, stage="stage"):
    lines(f"{root}/src", src)
    lines(f"{root}/tgt", tgt)
    res = M.mine_corpus(spark, f"{root}/src", f"{root}/tgt", f"{root}/pairs", CFG, embedder=MD.EMBEDDER,
                        scorer=scorer, stage_path=f"{root}/{stage}")
    got = sorted((r.src_text, r.tgt_text, r.quality) for r in res.final_pairs.collect())
    assert all(q == Q.overlap_scorer([a], [b])[0] for a, b, q in got)
    return got


def test_resumed_corpus_runs_score_each_pair_of_texts_once(spark, tmp_dir):
    scorer, loads, calls = counted(tmp_dir)
    first = mine(spark, tmp_dir, SRC, TGT, scorer)
    n = len(calls())
    assert n and len(set(calls())) == n
    assert mine(spark, tmp_dir, SRC, TGT, scorer) == first and len(calls()) == n             # the same files
    assert mine(spark, tmp_dir, SRC, TGT[::-1], scorer) == first and len(calls()) == n      # lines moved
    mine(spark, tmp_dir, SRC, ["one more apple tree"] + TGT, scorer)                        # a line inserted
    assert len(calls()) == len(set(calls())) > n
    n = len(calls())
    mine(spark, tmp_dir, TGT, SRC, scorer)                                                  # files swapped
    assert len(calls()) == len(set(calls())) > n
    assert len(loads()) == len(set(loads()))                                                # one load a process
    other, _, _ = counted(tmp_dir, "other")
    with pytest.raises(versions.StageMismatch, match="scorer"):
        mine(spark, tmp_dir, SRC, TGT, other)


def test_stage_of_a_run_is_found_by_its_manifest(spark, tmp_dir):
    scorer, _, _ = counted(tmp_dir)
    mine(spark, tmp_dir, SRC, TGT, scorer)
    sent = [IO.read_sentences(spark, f"{tmp_dir}/{s}") for s in ("src", "tgt")]
    ids = {n: versions.identity(s, "idx", "text") for n, s in zip(("source", "target"), sent)}
    good = M.run_manifest(ids, MD.EMBEDDER, scorer, CFG)
    assert IO.read_stage(spark, f"{tmp_dir}/stage/scored", good).count() == 6
    with pytest.raises(versions.StageMismatch, match="source"):
        IO.read_stage(spark, f"{tmp_dir}/stage/scored", {**good, "source": ids["target"]})


def test_failing_pairs_are_scored_again(spark, tmp_dir):
    def moody(src, tgt):
        if any("river" in t for t in tgt) and not os.path.exists(f"{tmp_dir}/calm"):
            raise RuntimeError("busy")
        return Q.overlap_scorer(src, tgt)
    f = MD.Factory(f"moody-{tmp_dir}", lambda: moody)
    lines(f"{tmp_dir}/src", SRC)
    lines(f"{tmp_dir}/tgt", TGT)
    runs = []
    for _ in range(2):
        res = M.mine_corpus(spark, f"{tmp_dir}/src", f"{tmp_dir}/tgt", f"{tmp_dir}/pairs", CFG, embedder=MD.EMBEDDER,
                            scorer=f, stage_path=f"{tmp_dir}/stage")
        runs.append(res.scored.filter("quality is null").count())
        open(f"{tmp_dir}/calm", "w").close()
    assert runs[0] > 0 and runs[1] == 0


def test_null_texts_have_keys_of_their_own(spark):
    df = spark.createDataFrame([(0, 0, None, "a"), (0, 1, "", "a"), (0, 2, "", "a")],
                               "src_idx long, tgt_idx long, src_text string, tgt_text string")
    scores, new = Q.score_from_store(df, None, lambda s, t: [0.5] * len(s))
    assert new.count() == 2 and scores.count() == 3
    scores, new = Q.score_from_store(df, new, lambda s, t: 1 / 0)
    assert new.count() == 0 and scores.filter("quality = 0.5").count() == 3


def test_versions_are_committed_whole(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    assert versions.latest(spark, path) is None and versions.read_all(spark, path) is None
    a = versions.publish(spark.range(3), path, {"k": 1})
    os.makedirs(f"{path}/v000000000009-dead/data")                # a writer that died
    spark.range(9).write.mode("overwrite").parquet(f"{path}/v000000000009-dead/data")
    assert versions.read_latest(spark, path).count() == 3 and versions.read_manifest(spark, a) == {"k": 1}
    old = versions.read_latest(spark, path)
    versions.publish(old.union(spark.range(2)), path)             # reads what it replaces
    assert versions.read_latest(spark, path).count() == 5 and old.count() == 3
    versions.publish(spark.range(1), path)
    assert [os.path.basename(f)[:13] for f in versions.committed(spark, path)] == ["v000000000002", "v000000000003"]


def test_identity_is_of_rows_not_of_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i long, t string")
    assert versions.identity(a) == versions.identity(a.orderBy(F.desc("i")).repartition(3))
    for rows in ([(1, "x"), (2, None)], [(2, "x"), (1, None), (2, None)], [(1, "x"), (2, ""), (2, None)]):
        assert versions.identity(a) != versions.identity(spark.createDataFrame(rows, "i long, t string"))


def test_one_bad_text_costs_its_own_vector_only(spark):
    def picky(texts):
        if any(t == "boom" for t in texts):
            raise RuntimeError("no")
        return [[len(t), 1.0] for t in texts]
    df = spark.createDataFrame([(0, "a"), (1, "boom"), (2, "ccc")], "idx long, t string").coalesce(1)
    out = {r.idx: (r.vec, r.error) for r in MD.embed(df, "t", factory=picky, errors=True).collect()}
    assert out[1][0] is None and "RuntimeError" in out[1][1]
    assert out[0][0] == pytest.approx([0.5 ** 0.5] * 2) and out[2][1] is None
    short = {r.idx: r.vec for r in MD.embed(df, "t", factory=lambda texts: [[1.0]] * (len(texts) - 1 or 1)).collect()}
    assert all(v == [1.0] for v in short.values())               # a batch of the wrong length is retried by row


def test_factories_go_through_sweep_and_stream(spark, tmp_dir):
    from tests.test_scale_and_resume import _grid, _sweep_inputs
    scorer, loads, calls = counted(tmp_dir)
    src, tgt, sa, ta = _sweep_inputs(spark)
    res = SW.run_sweep(_grid(spark, 2), src, tgt, sa, ta, scorer=scorer).results
    assert res.filter("status = 'completed'").count() == 2
    batch = spark.createDataFrame([(0, i, "a b", f"b {i}") for i in range(4)], INC.CANDIDATE_SCHEMA)
    assert INC.score_new_pairs(batch, f"{tmp_dir}/scored", scorer) == 4
    assert len(loads()) == len(set(loads())) and len(calls()) == len(set(calls()))


# ---- sweeps that are kept as they go

def sweep_into(spark, root, grid, scorer=None, quality=None, **kw):
    from tests.test_scale_and_resume import _sweep_inputs
    return SW.run_sweep_to(grid, f"{root}/results", f"{root}/pairs", *_sweep_inputs(spark), scorer=scorer,
                           quality_expr=quality, best_dir=f"{root}/best", **kw)


def refuse(ids):
    """A quality that some configs never get: those with the given search_k."""
    def quality(df):
        return F.when(F.coalesce(F.least("ip_rank", "l2_rank"), F.lit(0)) > 3,
                      F.raise_error("too far").cast("double")).otherwise(F.lit(0.9))
    return quality


@pytest.mark.parametrize("slice_rows", [1, 3, 100])
def test_a_failing_config_stands_alone(spark, tmp_dir, slice_rows):
    from tests.test_scale_and_resume import _grid
    grid = _grid(spark, 5).withColumn("search_k", F.when(F.col("experiment_id") == 4, 9.0).otherwise(F.col("search_k")))
    res = {r.experiment_id: r for r in sweep_into(spark, tmp_dir, grid, quality=refuse([4]), slice_rows=slice_rows).collect()}
    assert {i: r.status for i, r in res.items()} == {1: "completed", 2: "completed", 3: "completed", 4: "failed", 5: "completed"}
    assert res[4].error == "USER_RAISED_EXCEPTION: too far" and res[4].successful == 0 and res[4].search_k == 9
    pairs = SW.sweep_pairs(spark, f"{tmp_dir}/results", f"{tmp_dir}/pairs")
    assert {r.experiment_id: r["count"] for r in pairs.groupBy("experiment_id").count().collect()} == \
        {i: r.successful for i, r in res.items() if r.successful}
    assert sorted(r.experiment_id for r in SW.pending_experiments(grid, IO.read_results(spark, f"{tmp_dir}/results")).collect()) == [4]


def test_a_killed_sweep_leaves_the_best_of_what_ran(spark, tmp_dir, monkeypatch):
    from tests.test_scale_and_resume import _grid
    grid = _grid(spark, 4).withColumn("quality_threshold", F.element_at(F.array(*[F.lit(x) for x in (2.0, 0.1, 0.1, 0.1)]),
                                                                       F.col("experiment_id").cast("int")))
    real, done = SW.run_sweep, []

    def killed(*a, **kw):
        if len(done) == 2:
            raise KeyboardInterrupt          # not an error of a config: the driver dies
        done.append(1)
        return real(*a, **kw)
    monkeypatch.setattr(SW, "run_sweep", killed)
    with pytest.raises(KeyboardInterrupt):
        sweep_into(spark, tmp_dir, grid, quality=lambda d: F.lit(0.9), slice_rows=1)
    monkeypatch.setattr(SW, "run_sweep", real)
    best = IO.read_best_pairs(spark, f"{tmp_dir}/best")
    assert {r.experiment_id for r in best.collect()} == {2}
    pairs = f"{tmp_dir}/pairs"             # pairs of a slice that died before its results
    dead = spark.read.parquet(pairs).limit(1).withColumns({"experiment_id": F.lit(3).cast("long"), "slice_run": F.lit("x")})
    dead.checkpoint(eager=True).write.mode("append").parquet(pairs)
    res = sweep_into(spark, tmp_dir, grid, quality=lambda d: F.lit(0.9), slice_rows=1)
    assert res.filter("status = 'completed'").count() == 4
    kept = SW.sweep_pairs(spark, f"{tmp_dir}/results", pairs).groupBy("experiment_id").count().collect()
    assert {r["experiment_id"]: r["count"] for r in kept} == {2: 4, 3: 4, 4: 4}
    assert {r.experiment_id for r in IO.read_best_pairs(spark, f"{tmp_dir}/best").collect()} == {2}   # a tie: the first


def test_error_texts_name_the_innermost_error():
    assert SW.error_text(ValueError("plain")) == "ValueError: plain"
    long = "An error occurred while calling o1.x.\n: org.x.Y\nCaused by: a.B: [DIVIDE_BY_ZERO] Division by zero. SQLSTATE: 22012\n at z"
    assert SW.error_text(RuntimeError(long)) == "DIVIDE_BY_ZERO: Division by zero."


def test_model_batches_by_length_waste_less_and_lose_nothing(spark):
    import random

    import numpy as np
    rnd = random.Random(3)
    texts = [None, ""] + [" ".join("w" * rnd.randint(1, 5) for _ in range(int(rnd.paretovariate(0.9)) % 3000)) for _ in range(2000)]
    tokens = np.array([len((t or "").split()) for t in texts])
    plain, sorted_ = (MD.length_batches(tokens, 32, b) for b in (None, 4096))
    for batches in (plain, sorted_):
        assert sorted(np.concatenate(batches).tolist()) == list(range(len(texts))) and max(map(len, batches)) <= 32
    assert all(len(b) * tokens[b].max() <= 4096 or len(b) == 1 for b in sorted_)
    before, after = MD.padding(tokens, plain), MD.padding(tokens, sorted_)
    print("padding before", before, "after", after, "texts", tokens.sum())
    assert after < 0.2 * before
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, t string").repartition(3)
    sizes = MD.Factory("sizes", lambda: lambda x, a, b: [f"{len((t or '').split())}" for t in x])
    assert {r.idx: int(r.translation) for r in MD.translate(df, "t", "a", "b", translator=sizes).collect()} == dict(enumerate(tokens.tolist()))


def test_a_slot_keeps_the_latest_value_only():
    from pairmine.process_cache import process_latest
    built = []
    for key in ("a", "a", "b", "a"):
        assert process_latest("test-slot", key, lambda: built.append(key) or key.upper()) == key.upper()
    assert built == ["a", "b", "a"]


def test_slices_and_halves_search_once(spark, monkeypatch, tmp_dir):
    """Slices and the halves of a failing slice read the same staged lists and density."""
    from tests.test_scale_and_resume import _grid, _sweep_inputs
    calls, real = [], SW.exact_topk
    monkeypatch.setattr(SW, "exact_topk", lambda *a, **kw: calls.append(a[2]) or real(*a, **kw))
    dens, density = [], SW.SC.density_stats
    monkeypatch.setattr(SW.SC, "density_stats", lambda *a, **kw: dens.append(1) or density(*a, **kw))
    src, tgt, sa, ta = _sweep_inputs(spark)
    grid = _grid(spark, 4)
    SW.run_sweep_to(grid, f"{tmp_dir}/results", f"{tmp_dir}/pairs", src, tgt, sa, ta, slice_rows=1,
                    quality_expr=lambda d: F.lit(1.0))
    k = len({r.search_k for r in grid.select("search_k").collect()})
    assert len(calls) == k and len(dens) == 1
    alone = {r.experiment_id: r.weighted_score for r in SW.run_sweep(grid, src, tgt, sa, ta, quality_expr=lambda d: F.lit(1.0)).results.collect()}
    kept = {r.experiment_id: r.weighted_score for r in IO.read_results(spark, f"{tmp_dir}/results").collect()}
    assert alone == pytest.approx(kept)
