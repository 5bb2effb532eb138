"""Parameter sweep: X1-X3 grids (J12 param_cross_product, F8 complement), X4 run_sweep,
X5 failed rows, X6/A12 best_experiment, A13 leaderboard, A14 status_counts,
W7 running_best, J14 pending_experiments, J13 config_candidates.

The whole grid runs as one job (the reference reruns the full pipeline per row,
embedding and retrieval included). Work is factored by the parameters each stage
depends on (SURVEY 4.4):

* exact top-k: once, at the largest ``search_k``; a config with a smaller k keeps
  the rows ranked within its k in either list;
* density: once per target corpus;
* quality (stand-in expression): once per candidate pair, before any expansion;
* everything that depends on the config (adaptive scoring, density adjustment, top-N): in one
  vectorised pass per source over candidates x configs (``top_for_configs``).

The grid is a table throughout, of any size: it is never collected nor written into the
plan, but cut into chunks that meet blocks of sources.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmine.functions import scalar as S
from pairmine.operators import quality as Q
from pairmine.operators import run_metrics as RM
from pairmine.operators import scoring as SC
from pairmine.operators import selection as SEL
from pairmine.operators.knn import exact_topk
from pairmine.plans import mining as M
from pairmine.session import default_parallelism, stage_root
from pairmine.sources import versions
from pairmine.sources import io as IO

# ---------------------------------------------------------------------------
# The three grids, lists in insertion order (the last varies fastest).
GRID_COLUMNS = ["experiment_id", "search_k", "top_after_filtering", "quality_threshold",
                "cosine_weight", "l2_weight", "base_weight", "z_weight", "z_threshold",
                "sparse_bonus", "crowded_penalty", "sparse_threshold", "crowded_threshold"]

MINIMAL_LISTS = [
    ("base_weight", [0.6, 0.7, 0.8]),
    ("sparse_bonus", [0.01, 0.10, 0.3]),
    ("crowded_penalty", [0.01, 0.15, 0.3]),
    ("z_threshold", [-1.0]),
    ("cosine_weight", [0.6, 0.7, 0.8]),
    ("sparse_threshold", [0.1, 0.3]),
    ("crowded_threshold", [0.1, 0.3]),
    ("search_k", [100]),
    ("top_after_filtering", [5]),
    ("quality_threshold", [0.70]),
]

FOCUSED_LISTS = [
    ("base_weight", [0.5, 0.6, 0.7, 0.8]),
    ("z_threshold", [-1.5, -1.0, -0.5]),
    ("cosine_weight", [0.5, 0.6, 0.7, 0.8]),
    ("sparse_bonus", [0.05, 0.10, 0.15]),
    ("crowded_penalty", [0.10, 0.15, 0.20]),
    ("sparse_threshold", [0.3]),
    ("crowded_threshold", [0.1]),
    ("search_k", [100]),
    ("top_after_filtering", [5]),
    ("quality_threshold", [0.50, 0.75]),
]

BASELINE_COMMON = dict(search_k=100, top_after_filtering=5, quality_threshold=0.70,
                       cosine_weight=0.6, l2_weight=0.4, z_threshold=-1.0,
                       sparse_threshold=0.3, crowded_threshold=0.1)
BASELINE_ROWS = [
    # no adaptive scoring, density on
    dict(experiment_id=10001, base_weight=1.0, z_weight=0.0, sparse_bonus=0.1, crowded_penalty=0.15),
    # adaptive scoring on, no density
    dict(experiment_id=10002, base_weight=0.6, z_weight=0.4, sparse_bonus=0.0, crowded_penalty=0.0),
    # neither
    dict(experiment_id=10003, base_weight=1.0, z_weight=0.0, sparse_bonus=0.0, crowded_penalty=0.0),
]
# ---------------------------------------------------------------------------

INT_PARAMS = {"search_k", "top_after_filtering"}
BLOCK_SOURCES = 512     # sources of a block, about, so that its candidates fit in a task
GRID_CHUNK = 1024       # configs that meet a block of sources in one task
NO_KEY = -(1 << 63)     # stands for a missing 64-bit key where nulls cannot travel
CELLS = 1 << 20         # (config, candidate) cells computed at a time: about 100 bytes each


def _typed(c: str) -> F.Column:
    if c == "experiment_id":
        return F.col(c).cast("long")
    return F.col(c).cast("int") if c in INT_PARAMS else F.col(c).cast("double")


def param_cross_product(spark: SparkSession, lists) -> DataFrame:
    """J12 + X1/X2: cartesian product of value lists with 1-based ids, the last list
    varying fastest; z_weight and l2_weight are the complements (F8)."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("_id"))
    for name, values in lists:
        arr = F.array(*[F.lit(float(v)) for v in values])
        df = (df.select("*", F.posexplode(arr).alias(f"_p_{name}", name))
                .withColumn("_id", F.col("_id") * F.lit(len(values)) + F.col(f"_p_{name}"))
                .drop(f"_p_{name}"))
    df = (df.withColumn("experiment_id", F.col("_id") + 1)
            .withColumn("z_weight", S.complement(F.col("base_weight")))
            .withColumn("l2_weight", S.complement(F.col("cosine_weight"))))
    return df.select(*[_typed(c).alias(c) for c in GRID_COLUMNS])


def grid_minimal(spark: SparkSession) -> DataFrame:
    return param_cross_product(spark, MINIMAL_LISTS)


def grid_focused(spark: SparkSession) -> DataFrame:
    return param_cross_product(spark, FOCUSED_LISTS)


def grid_baseline(spark: SparkSession) -> DataFrame:
    """The three ablation rows, ids 10001-10003."""
    rows = [{**BASELINE_COMMON, **r} for r in BASELINE_ROWS]
    df = spark.createDataFrame([tuple(float(r[c]) for c in GRID_COLUMNS) for r in rows],
                               ", ".join(f"{c} double" for c in GRID_COLUMNS))
    return df.select(*[_typed(c).alias(c) for c in GRID_COLUMNS])


def read_param_grid(spark: SparkSession, path: str, start_from: int = 1,
                    max_experiments: int | None = None) -> DataFrame:
    """S5 + P8 + P7: grid CSV (header), ``experiment_id >= start_from``, then the first
    ``max_experiments`` rows by id when given. ``comet_threshold`` is accepted as
    the name of the quality threshold."""
    raw = spark.read.option("header", True).csv(path)
    # A cell that is no number makes its own config fail (X5), not the whole sweep.
    raw = raw.select(*[F.col(c).try_cast("double").alias(c) for c in raw.columns])
    if "comet_threshold" in raw.columns and "quality_threshold" not in raw.columns:
        raw = raw.withColumnRenamed("comet_threshold", "quality_threshold")
    df = raw.select(*[_typed(c).alias(c) for c in GRID_COLUMNS]).filter(F.col("experiment_id") >= start_from)
    if max_experiments:
        df = df.orderBy("experiment_id").limit(int(max_experiments))
    return df


@dataclass
class SweepResult:
    results: DataFrame        # one row per experiment: status, metrics, parameters
    final_pairs: DataFrame    # chosen pairs of every experiment, keyed by experiment_id
    ranked: DataFrame         # top-N rows of every experiment


PARAMETERS = [c for c in GRID_COLUMNS if c != "experiment_id"]


def _errors(g: DataFrame) -> DataFrame:
    """Grid rows with an ``error`` naming their missing parameters (NULL when complete)."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in PARAMETERS]), lambda x: x.isNotNull())
    return g.withColumn("error", F.when(F.size(missing) > 0,
                                        F.concat(F.lit("missing parameter: "), F.array_join(missing, ", "))))


def score_cells(c: dict, g: dict) -> tuple:
    """J4, A1, A2, W1, F1-F6 and W3 of one source for many configs at once.

    ``c``: the source's candidates, arrays of n; ``g``: the configs, columns of shape (m, 1).
    Returns (config, candidate, rank, values): the top ``top_after_filtering`` candidates of each
    config, in rank order. The formulas are those of ``operators.scoring``."""
    k = g["search_k"]
    in_l2 = c["l2_rank"] <= k
    inside = (c["ip_rank"] <= k) | in_l2
    l2 = np.where(in_l2, 1.0 / (1.0 + c["sqd"]), 1.0 / (1.0 + np.sqrt(c["sqd"])))
    score = g["cosine_weight"] * c["dot"] + g["l2_weight"] * l2
    n = inside.sum(axis=1, keepdims=True)
    count = np.maximum(n, 1)
    mean = np.where(inside, score, 0.0).sum(axis=1, keepdims=True) / count
    std = np.sqrt(np.where(inside, (score - mean) ** 2, 0.0).sum(axis=1, keepdims=True) / count)
    on = ~((g["base_weight"] == 1.0) & (g["z_weight"] == 0.0))
    degenerate = (n < 3) | (std < S.Z_EPS)
    active = on & ~degenerate
    z = np.where(active, np.clip((score - mean) / (std + S.Z_EPS), -S.Z_CLIP, S.Z_CLIP), 0.0)
    adaptive = np.where(active, np.clip(g["base_weight"] * score + g["z_weight"] * np.clip(z / 3.0, -1.0, 1.0), 0.0, 1.0), score)
    keep = inside & (~active | (z > g["z_threshold"]))
    dense = ~((g["sparse_bonus"] == 0.0) & (g["crowded_penalty"] == 0.0)) & ~np.isnan(c["_density_raw"])
    density = np.where(dense, c["_density_raw"], 0.5)
    bonus = np.where(dense & (density > g["sparse_threshold"]), g["sparse_bonus"], 0.0)
    penalty = np.where(dense & (density < g["crowded_threshold"]), g["crowded_penalty"], 0.0)
    final = np.where(dense, np.clip(adaptive + bonus - penalty, 0.0, 1.0), adaptive)
    # The best N by a partition: all that reach the N-th largest, ties included, are ordered.
    top = np.maximum(g["top_after_filtering"], 0).astype(np.int64)
    key = np.where(keep, final, -np.inf)
    most = int(top.max(initial=0))
    if 0 < most < key.shape[1]:
        bound = -np.partition(-key, most - 1, axis=1)[:, most - 1:most]
        keep &= key >= bound
    config, cand = np.nonzero(keep)
    second = np.where(on, adaptive, 0.0)[config, cand]
    by = np.lexsort((c["tgt_idx"][cand], -second, -final[config, cand], config))
    config, cand = config[by], cand[by]
    first = np.searchsorted(config, np.arange(len(top)))
    rank = np.arange(len(config)) - first[config] + 1
    kept = rank <= top[config, 0]
    config, cand, rank = config[kept], cand[kept], rank[kept]
    at = (config, cand)
    base = np.where(~on | ~degenerate, 1.0, np.nan) * score
    values = {"cosine_score": c["dot"][cand], "l2_score": l2[at], "score": score[at], "base_score": base[at],
              "z_score": z[at], "adaptive_score": adaptive[at], "density": density[at], "density_bonus": bonus[at],
              "density_penalty": penalty[at], "final_score": final[at]}
    return config, cand, rank, values


def top_for_configs(base: DataFrame, valid: DataFrame, blocks: int) -> DataFrame:
    """J13 + W3: the top-N rows of every config and source.

    Blocks of sources meet chunks of the grid in one task each (a cogroup, as in the top-k
    join): every candidate is sent once per grid chunk and every config once per source block,
    and inside a task one vectorised pass over candidates x configs keeps N rows per config.
    No candidate row is copied per config and nothing is sorted per config. Columns of
    ``base`` that the formulas do not use are passed on."""
    n_configs = valid.count()
    n_chunks = max(1, -(-n_configs // GRID_CHUNK))
    columns = ["src_idx", "tgt_idx", "dot", "sqd", "ip_rank", "l2_rank", "_density_raw"]
    extra = [f for f in base.schema.fields if f.name not in columns + ["cosine_score"]]
    # 64-bit keys with nulls would become floating point in pandas: a null travels as a number.
    wide = {f.name for f in extra if f.dataType.simpleString() == "bigint"}
    passed = lambda f: F.coalesce(f.name, F.lit(NO_KEY)).alias(f.name) if f.name in wide else F.col(f.name)
    left = (base.withColumn("s_block", F.pmod(F.xxhash64("src_idx"), F.lit(blocks)).cast("int"))
            .withColumn("g_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
            .select("s_block", "g_chunk", *columns, *[passed(f) for f in extra]))
    right = (valid.withColumn("chunk", F.pmod(F.xxhash64("experiment_id"), F.lit(n_chunks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    measured = ["cosine_score", "l2_score", "score", "base_score", "z_score", "adaptive_score", "density",
                "density_bonus", "density_penalty", "final_score"]
    schema = ("experiment_id long, quality_threshold double, src_idx long, tgt_idx long, " +
              ", ".join(f"{c} double" for c in measured) + ", pre_rank int" +
              "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra))
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(cands: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(grid):
            return pd.DataFrame({c: [] for c in names})
        out = []
        far = np.iinfo(np.int64).max
        for _, own in cands.groupby("src_idx", sort=False):
            own = own.reset_index(drop=True)
            c = {x: own[x].to_numpy(np.float64) for x in ("dot", "sqd", "_density_raw")}
            c |= {x: own[x].fillna(far).to_numpy(np.int64) if own[x].isna().any() else own[x].to_numpy(np.int64)
                  for x in ("ip_rank", "l2_rank", "tgt_idx")}
            step = max(1, CELLS // len(own))
            for lo in range(0, len(grid), step):
                part = grid.iloc[lo:lo + step]
                g = {x: part[x].to_numpy()[:, None] for x in PARAMETERS}
                config, cand, rank, values = score_cells(c, g)
                rows = own.iloc[cand].reset_index(drop=True)
                out.append(rows.assign(experiment_id=part["experiment_id"].to_numpy()[config],
                                       quality_threshold=part["quality_threshold"].to_numpy()[config],
                                       pre_rank=rank.astype(np.int32), **values)[names])
        out = pd.concat(out)
        return out.astype({f.name: object for f in extra if f.dataType.simpleString() == "string"})

    out = left.groupBy("s_block", "g_chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(run, schema)
    return out.withColumns({c: F.nullif(F.col(c), F.lit(NO_KEY)) for c in wide})


class Searches:
    """What runs over the same corpora share: the density, and the top-k lists by their k.

    Both are staged when a run first asks for them, so that slices, their halves and configs of the
    same ``search_k`` search once."""

    def __init__(self, src_vec: DataFrame, tgt_vec: DataFrame, k_neighbors: int = 20):
        self.src_vec, self.tgt_vec, self.k_neighbors = src_vec, tgt_vec, k_neighbors
        self.lists: dict[int, DataFrame] = {}
        self.density: DataFrame | None = None

    def staged(self, k: int) -> tuple[DataFrame, DataFrame]:
        stage_root(self.src_vec.sparkSession)
        if k not in self.lists:
            self.lists[k] = exact_topk(self.src_vec, self.tgt_vec, k, by=("ip", "l2")).checkpoint(eager=True)
        if self.density is None:
            self.density = SC.density_stats(self.tgt_vec, self.k_neighbors).checkpoint(eager=True)
        return self.lists[k], self.density


def run_sweep(grid: DataFrame, src_vec: DataFrame, tgt_vec: DataFrame, src_attrs: DataFrame,
              tgt_attrs: DataFrame, *, quality_expr=None, scorer=None, k_neighbors: int = 20,
              materialize: bool = True, scored_before: DataFrame | None = None,
              searches: Searches | None = None) -> SweepResult:
    """X4 + X5 + J13: every config of ``grid`` over the same corpora, as one job.

    A config with a missing parameter, or without any candidate left after its gates, is a
    ``failed`` row with its parameters and an ``error``; it does not touch the others.
    With a plug-in ``scorer`` every distinct surviving pair is scored once and staged;
    ``scored_before`` resumes from an earlier scored table. ``searches`` (of the same corpora and
    ``k_neighbors``) keeps what several runs share."""
    if quality_expr is None and scorer is None:
        raise ValueError("a quality model (quality_expr or scorer) is required")
    spark = grid.sparkSession
    g = _errors(grid.select(*[_typed(c).alias(c) for c in GRID_COLUMNS]))
    valid = g.filter("error is null").drop("error")
    k_max = int(valid.agg(F.max("search_k")).first()[0] or 0)

    if searches is not None and k_max > 0:
        cands, dens = searches.staged(k_max)
    else:
        cands = exact_topk(src_vec, tgt_vec, k_max, by=("ip", "l2"))
        dens = SC.density_stats(tgt_vec, k_neighbors)

    sa = M.narrow_attrs(src_attrs, "src_idx", "src_")
    ta = M.narrow_attrs(tgt_attrs, "tgt_idx", "tgt_")
    base = (SC.attach_density(cands, dens).join(ta, "tgt_idx", "left").join(sa, "src_idx", "left")
            .withColumn("cosine_score", F.col("dot")))
    if quality_expr is not None:
        base = base.withColumn("quality", quality_expr(base))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * default_parallelism(spark))
    n_sources = src_vec.count()
    ranked = top_for_configs(base, valid, max(parts, -(-n_sources // BLOCK_SOURCES)))
    if materialize:
        stage_root(spark)
        ranked = ranked.checkpoint(eager=True)
    if quality_expr is None:
        pairs = ranked.select("src_idx", "tgt_idx").distinct()
        todo = pairs if scored_before is None else Q.unscored_pairs(pairs, scored_before)
        stage_root(spark)
        q = Q.score_pairs(M.attach_texts(todo, src_attrs, tgt_attrs), scorer).checkpoint(eager=True)
        if scored_before is not None:
            q = Q.append_scored(Q.usable_scores(scored_before), q)
        ranked = Q.attach_scores(ranked, q)
    chosen = SEL.choose_best(ranked, F.col("quality_threshold"), group_keys=["experiment_id"])
    final_pairs = chosen.filter("is_chosen").drop("is_chosen", "passes")

    # one pass over the ranked rows: chosen-pair aggregates and whether the config ran
    agg = RM.pair_aggregates(chosen, ["experiment_id"], where=F.col("is_chosen"),
                             extra=[F.count(F.lit(1)).alias("_n_ranked")])
    return SweepResult(results=_result_rows(g, agg, n_sources), final_pairs=final_pairs, ranked=ranked)


def _result_rows(g: DataFrame, agg: DataFrame, n_sources: int) -> DataFrame:
    """One row per config of ``g`` (with ``error``); configs without a row in ``agg`` failed."""
    res = RM.finish_metrics(g.join(agg, "experiment_id", "left"), F.lit(n_sources))
    ran = F.coalesce(F.col("_n_ranked") > 0, F.lit(False)) & F.col("error").isNull()
    res = (res.withColumn("status", F.when(ran, F.lit("completed")).otherwise(F.lit("failed")))
           .withColumn("error", F.when(~ran, F.coalesce("error", F.lit("no candidate left")))).drop("_n_ranked"))
    res = res.withColumn("total_pairs", F.col("successful"))
    return res.select("experiment_id", "status", *RM.METRIC_COLS, "total_pairs", *PARAMETERS, "error")


def failed_rows(configs: DataFrame, error: str, n_sources: int) -> DataFrame:
    """Result rows of configs that could not be run at all."""
    g = configs.select(*[_typed(c).alias(c) for c in GRID_COLUMNS]).withColumn("error", F.lit(error))
    none = RM.pair_aggregates(configs.sparkSession.createDataFrame([], "experiment_id long, pre_rank int, margin double"),
                              ["experiment_id"], extra=[F.count(F.lit(1)).alias("_n_ranked")])
    return _result_rows(g, none, n_sources)


def error_text(e: BaseException, limit: int = 500) -> str:
    """What went wrong, without a driver's stack: the message of the innermost error named."""
    text = str(e)
    named = re.findall(r"\[([A-Z][A-Z0-9_.]+)\] ([^\n]*)", text)
    if named:
        return f"{named[-1][0]}: {re.sub(r' SQLSTATE.*', '', named[-1][1])}"[:limit]
    causes = [line for line in text.splitlines() if line.startswith(("Caused by:", "pyspark.errors")) or
              re.match(r"\w*(Error|Exception): ", line)]
    first = (causes or text.strip().splitlines() or [""])[-1 if causes else 0]
    return f"{type(e).__name__}: {first}"[:limit]


def run_sweep_to(grid: DataFrame, results_dir: str, pairs_dir: str, *args, slice_rows: int = 1000,
                 best_dir: str | None = None, **kw) -> DataFrame:
    """K3 + J14 + X5 + K4: a sweep whose results are kept as it goes.

    Pending configs (no completed result in ``results_dir``) run in slices of at most
    ``slice_rows`` by experiment id, and a slice's pairs and results are appended when it is done
    (pairs first: what has no result row is not read), so a late failure costs one slice. A
    slice that fails is cut in two and each half run again (over the same staged lists), until a config that fails for
    itself stands alone: it alone becomes a ``failed`` row with its error. With ``best_dir``
    the pairs of the best experiment so far are published there after each slice that beats
    it, for ``io.read_best_pairs`` at any time. Returns the results; ``sweep_pairs`` reads
    all pairs, keyed by experiment."""
    spark = grid.sparkSession
    if IO._path_exists(spark, f"{results_dir.rstrip('/')}/_SUCCESS"):
        grid = pending_experiments(grid, IO.read_results(spark, results_dir))
    stage_root(spark)
    ids = grid.select("experiment_id").distinct().orderBy("experiment_id").checkpoint(eager=True)
    n_sources = args[0].count()
    searches = Searches(args[0], args[1], kw.get("k_neighbors", 20))

    def keep(results: DataFrame, pairs: DataFrame | None) -> None:
        run = uuid.uuid4().hex
        if pairs is not None:
            pairs.withColumn("slice_run", F.lit(run)).write.mode("append").parquet(pairs_dir)
        IO.append_results(results.withColumn("slice_run", F.lit(run)), results_dir)

    def run(part: list[int]) -> None:
        configs = grid.filter(F.col("experiment_id").isin(part))
        try:
            res = run_sweep(configs, *args, searches=searches, **kw)
            keep(res.results, res.final_pairs)
        except Exception as e:  # noqa: BLE001 - one bad config must not stop the others
            if len(part) == 1:
                keep(failed_rows(configs, error_text(e), n_sources), None)
            else:
                run(part[:len(part) // 2])
                run(part[len(part) // 2:])

    part: list[int] = []
    rows = ids.toLocalIterator()          # a slice of ids at a time
    for row in chain(rows, [None]):
        if row is not None:
            part.append(row["experiment_id"])
        if part and (row is None or len(part) >= slice_rows):
            run(part)
            part = []
            if best_dir:
                publish_best(spark, results_dir, pairs_dir, best_dir)
    return IO.read_results(spark, results_dir).drop("slice_run")


def sweep_pairs(spark: SparkSession, results_dir: str, pairs_dir: str) -> DataFrame:
    """The pairs that belong to the results kept so far, keyed by experiment."""
    runs = IO.read_results(spark, results_dir).filter("status = 'completed'").select("experiment_id", "slice_run")
    return spark.read.parquet(pairs_dir).join(runs, ["experiment_id", "slice_run"]).drop("slice_run")


def publish_best(spark: SparkSession, results_dir: str, pairs_dir: str, best_dir: str) -> bool:
    """K4 + A12 while a sweep runs: the best experiment's pairs as the newest version of
    ``best_dir``, if another experiment (or none) is published there."""
    best = best_experiment(IO.read_results(spark, results_dir)).first()
    if best is None:
        return False
    folder = versions.latest(spark, best_dir)
    if folder and versions.read_manifest(spark, folder).get("experiment_id") == best["experiment_id"]:
        return False
    pairs = sweep_pairs(spark, results_dir, pairs_dir).filter(F.col("experiment_id") == best["experiment_id"])
    return IO.write_best_pairs(pairs, best_dir, {"experiment_id": best["experiment_id"],
                                                 "weighted_score": best["weighted_score"]})


def _key(c: str) -> F.Column:
    """Comparison key of a metric: rounded to 9 decimals, so that sums taken in a
    different order cannot break a tie differently."""
    return F.round(F.col(c), 9)


def best_experiment(results: DataFrame) -> DataFrame:
    """Highest weighted score among completed runs; the first (lowest id) wins
    a tie; failed runs never win. Empty when nothing completed (DV-8)."""
    return (results.filter(F.col("status") == "completed")
            .orderBy(_key("weighted_score").desc(), F.asc("experiment_id")).limit(1))


def best_pairs(sweep: SweepResult) -> DataFrame:
    """K4: the chosen pairs of the best experiment."""
    best = best_experiment(sweep.results).select("experiment_id")
    return sweep.final_pairs.join(F.broadcast(best), "experiment_id")


def leaderboard(results: DataFrame, n: int = 10) -> DataFrame:
    """Top n completed runs by weighted score (ties: run order)."""
    w = Window.orderBy(_key("weighted_score").desc(), F.asc("experiment_id"))
    return (results.filter(F.col("status") == "completed")
            .withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= n))


def best_by_margin(results: DataFrame) -> DataFrame:
    """The completed run with the largest average selected margin."""
    return (results.filter(F.col("status") == "completed")
            .orderBy(_key("avg_selected_margin").desc(), F.asc("experiment_id")).limit(1))


def status_counts(results: DataFrame) -> DataFrame:
    """Completed / failed counts."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def running_best(results: DataFrame) -> DataFrame:
    """Flag each completed run whose weighted score beats every earlier completed run
    (run order = experiment id). The results table is one row per config."""
    w = Window.orderBy("experiment_id").rowsBetween(Window.unboundedPreceding, -1)
    score = F.when(F.col("status") == "completed", _key("weighted_score"))
    prev = F.max(score).over(w)
    return results.withColumn(
        "is_new_best",
        (F.col("status") == "completed") & (prev.isNull() | (_key("weighted_score") > prev)))


def pending_experiments(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Grid rows without a completed result (failed ones run again)."""
    done = results.filter(F.col("status") == "completed").select("experiment_id")
    return grid.join(done, "experiment_id", "left_anti")
