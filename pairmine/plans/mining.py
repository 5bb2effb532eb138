"""X7 mine_pairs: the flagship mining run, composed from operators.

    vectors --exact top-k (J1-J3)--> candidates --J4/F1/F2--> scored
      --A1/A2/W1/F4/P10--> adaptive --J5 density, F6--> final --W3/T2--> top-N
      --[stage table]--> J6 texts --M2 quality--> P9/W4/W5 best pair + margin
      --> A5-A8 run metrics, J8 missing sources, A10 failure reasons, K1 sink

Shuffles: one per side to form blocks (the cogroup), the candidates by ``tgt_idx`` for
the density and the narrow target attributes, then once by ``src_idx`` for all windows
(z-score, top-N, best pair, margin) and the source attributes. Texts are joined to the
rows that need them only. Stages that a literal config turns off are left out of the
plan (O4).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.operators import models as MD
from pairmine.operators import quality as Q
from pairmine.operators import run_metrics as RM
from pairmine.operators import scoring as SC
from pairmine.operators import selection as SEL
from pairmine.operators.knn import exact_topk
from pairmine.session import stage_root
from pairmine.sources import io as IO
from pairmine.sources import versions

QualityExpr = Callable[[DataFrame], Column]


@dataclass
class MiningResult:
    candidates: DataFrame
    ranked: DataFrame
    scored: DataFrame
    final_pairs: DataFrame
    metrics: DataFrame
    rank_distribution: DataFrame
    missing_sources: DataFrame
    failures: DataFrame
    new_scores: DataFrame | None = None      # src_key, tgt_key, quality: what a score store gains


def candidate_table(src_vec: DataFrame, tgt_vec: DataFrame, search_k: int, **kw) -> DataFrame:
    """Exact top-k by inner product and by L2, distinct union."""
    return exact_topk(src_vec, tgt_vec, search_k, by=("ip", "l2"), **kw)


def rank_candidates(cands: DataFrame, density: DataFrame | None, p: SC.Params,
                    group_keys=(), adaptive: bool = True, use_density: bool = True,
                    tgt_keys: DataFrame | None = None) -> DataFrame:
    """J4 -> adaptive -> density -> top-N, for literal or grid parameters.

    What is looked up by target (density, and the narrow attributes ``tgt_keys``) is
    joined first, so that one exchange on ``src_idx`` serves the z-score, the top-N and
    the selection windows."""
    df = SC.attach_density(cands, density if use_density else None)
    extra = []
    if tgt_keys is not None:
        extra = [c for c in tgt_keys.columns if c != "tgt_idx"]
        df = df.join(tgt_keys, "tgt_idx", "left")
    df = SC.rescore_candidates(df, p)
    df = SC.local_zscore(df, p, group_keys) if adaptive else (
        df.withColumn("z_score", F.lit(0.0)).withColumn("adaptive_score", F.col("score"))
          .withColumn("base_score", F.col("score")))
    df = SC.density_adjust(df, p)
    df = SC.pre_rank(df, p, group_keys)
    return df.select(*group_keys, *SC.RANKED_COLS, *extra)


def narrow_attrs(attrs: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per-id attributes without the text, which is hashed to the key of the R12 comparison."""
    a = attrs.withColumn("text_key", F.xxhash64("text")).drop("text")
    return a.select(F.col("idx").alias(key), *[F.col(c).alias(prefix + c) for c in a.columns if c != "idx"])


def attach_keys(ranked: DataFrame, src_attrs: DataFrame, tgt_attrs: DataFrame) -> DataFrame:
    """J6, narrow part: every per-id attribute except the text (labels, text keys), of the
    sides that ``ranked`` does not hold yet."""
    for attrs, key, prefix in ((src_attrs, "src_idx", "src_"), (tgt_attrs, "tgt_idx", "tgt_")):
        if f"{prefix}text_key" not in ranked.columns:
            ranked = ranked.join(narrow_attrs(attrs, key, prefix), key, "left")
    return ranked


def attach_texts(df: DataFrame, src_attrs: DataFrame, tgt_attrs: DataFrame) -> DataFrame:
    """J6, wide part: the two texts, joined onto as few rows as possible."""
    return SEL.attach_text(df, src_attrs.select("idx", "text"), tgt_attrs.select("idx", "text"))


def mine_pairs(src_vec: DataFrame, tgt_vec: DataFrame, src_attrs: DataFrame, tgt_attrs: DataFrame,
               cfg: SC.MiningConfig = SC.MiningConfig(), *, quality_expr: QualityExpr | None = None,
               scorer: "MD.Factory | Q.Scorer | None" = None, materialize: bool = True,
               density: DataFrame | None = None, scored_before: DataFrame | None = None,
               score_store: DataFrame | None = None) -> MiningResult:
    """Full mining run for one configuration.

    ``quality_expr`` builds the quality column from the ranked table with both
    sides' narrow attributes (a Spark expression); otherwise ``scorer`` is a batch
    plug-in over (source text, target text) and the texts of the top-N rows are
    attached first. One of them is required. Texts reach the final pairs only.

    A plug-in's scores are staged as soon as they are made, so every output reads them
    and no two texts are scored twice. ``score_store`` (src_key, tgt_key, quality, as in
    ``new_scores`` of earlier results) resumes by the texts, wherever they stand now;
    ``scored_before`` resumes from an earlier scored table by position, for unchanged corpora:
    its pairs with a quality are not scored again, its failed ones are.
    """
    if quality_expr is None and scorer is None:
        raise ValueError("a quality model (quality_expr or scorer) is required")
    p = SC.Params.literal(cfg)
    adaptive_on = not (cfg.base_weight == 1.0 and cfg.z_weight == 0.0)
    density_on = not (cfg.sparse_bonus == 0.0 and cfg.crowded_penalty == 0.0)
    n_src = src_vec.count()
    cands = candidate_table(src_vec, tgt_vec, cfg.search_k)
    if materialize:
        stage_root(cands.sparkSession)
        cands = cands.checkpoint(eager=True)
    if density_on and density is None:
        # With the candidates at hand, only the targets among them need a density.
        only = cands.select(F.col("tgt_idx").alias("idx")) if materialize else None
        density = SC.density_stats(tgt_vec, cfg.k_neighbors, only=only)
    ranked = rank_candidates(cands, density, p, adaptive=adaptive_on, use_density=density_on,
                             tgt_keys=narrow_attrs(tgt_attrs, "tgt_idx", "tgt_"))
    if materialize:
        ranked = ranked.checkpoint(eager=True)

    keyed = attach_keys(ranked, src_attrs, tgt_attrs)
    new_scores = None
    if quality_expr is not None:
        scored = keyed.withColumn("quality", quality_expr(keyed))
    elif scored_before is not None:
        q = Q.score_pairs(attach_texts(Q.unscored_pairs(keyed, scored_before), src_attrs, tgt_attrs), scorer)
        stage_root(q.sparkSession)
        scored = Q.attach_scores(keyed, Q.append_scored(Q.usable_scores(scored_before), q.checkpoint(eager=True)))
    else:
        q, new_scores = Q.score_from_store(attach_texts(keyed, src_attrs, tgt_attrs), score_store, scorer)
        scored = Q.attach_scores(keyed, q)
    chosen = SEL.choose_best(scored, cfg.quality_threshold)
    final_pairs = attach_texts(chosen.filter("is_chosen").drop("is_chosen", "passes"), src_attrs, tgt_attrs)

    metrics = RM.run_summary(final_pairs, n_src)
    return MiningResult(
        candidates=cands, ranked=ranked.select(*SC.RANKED_COLS), scored=scored, final_pairs=final_pairs,
        metrics=metrics, rank_distribution=RM.rank_distribution(final_pairs),
        missing_sources=SEL.missing_sources(src_vec, ranked),
        failures=SEL.failure_reasons(scored, final_pairs), new_scores=new_scores,
    )


def mine_corpus(spark, src_path: str, tgt_path: str, out_path: str, cfg: SC.MiningConfig = SC.MiningConfig(), *,
                embedder: "MD.Factory", scorer: "MD.Factory | Q.Scorer", stage_path: str | None = None) -> MiningResult:
    """X7 from files to files: S1 load -> M1 embed -> retrieve -> score -> select -> K1 write.

    ``src_path`` and ``tgt_path`` hold one sentence per line; ``embedder`` is an M1 factory.
    With ``stage_path``, qualities are kept there by the two texts that they belong to
    (``scores``, one increment a run) and no later run scores those texts again, whatever
    became of the files: inserted, moved or swapped lines are told apart by what they say.
    Scores of another quality model are refused (``versions.StageMismatch``). The run's scored
    pairs are a stage as well (K8, ``scored``), with a manifest of both inputs, the models and
    the parameters, for readers that want this run's table and no other (S6)."""
    sides, inputs = [], {}
    for name, path in (("source", src_path), ("target", tgt_path)):
        sent = IO.read_sentences(spark, path)
        vec = MD.embed(sent, "text", factory=embedder)
        stage_root(spark)
        sides.append((vec.checkpoint(eager=True), sent))
        if stage_path:
            inputs[name] = versions.identity(sent, "idx", "text")
    (src_vec, src), (tgt_vec, tgt) = sides
    store, owner = None, {"scorer": MD.model_key(scorer)}
    if stage_path:
        for folder in versions.committed(spark, f"{stage_path}/scores"):
            versions.check_manifest(versions.read_manifest(spark, folder), owner, folder)
        store = versions.read_all(spark, f"{stage_path}/scores")
    res = mine_pairs(src_vec, tgt_vec, src, tgt, cfg, scorer=scorer, score_store=store)
    if stage_path:
        if not res.new_scores.isEmpty():
            versions.publish(res.new_scores, f"{stage_path}/scores", owner, keep=None)
        IO.write_stage(res.scored.select("src_idx", "tgt_idx", "quality"), f"{stage_path}/scored",
                       manifest=run_manifest(inputs, embedder, scorer, cfg))
    IO.write_pairs(res.final_pairs.select(*FINAL_PAIR_COLS), out_path)
    return res


def run_manifest(inputs: dict, embedder, scorer, cfg: SC.MiningConfig) -> dict:
    """What a run's stage belongs to: both inputs, both models, every parameter."""
    return {**inputs, "embedder": MD.model_key(embedder), "scorer": MD.model_key(scorer),
            **{k: str(v) for k, v in asdict(cfg).items()}}


FINAL_PAIR_COLS = ["src_idx", "tgt_idx", "src_text", "tgt_text", "cosine_score", "l2_score",
                   "score", "base_score", "z_score", "adaptive_score", "density", "density_bonus",
                   "density_penalty", "final_score", "pre_rank", "quality", "margin"]
