"""Quality scoring of candidate pairs: M2 quality_score, M5 safe_score, P12
quality_inputs, J7 unscored_pairs, J11 attach_scores, U4 append_scored,
A9 candidate_coverage, A16 distinct_scored_keys.

The quality model is a plug-in: any ``scorer(src: pd.Series, tgt: pd.Series) ->
array of float``, or a ``models.Factory`` of one (built once per Python worker), called on
Arrow batches. Only
the distinct pairs that survive top-N are scored, and only those not already in
the scored table. ``stub_quality`` is a deterministic stand-in used by the tests
and the driver-table queries; it is **not** a quality model.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.operators.models import Factory, model_batches, model_of, safe_batch
from pairmine.session import stage_root

Scorer = Callable[[pd.Series, pd.Series], "np.ndarray | pd.Series | list"]

SCORED_SCHEMA = "src_idx long, tgt_idx long, quality double, error string"


def stub_quality(cosine: Column, label_src: Column, label_tgt: Column) -> Column:
    """Stand-in: 0.5 * max(cosine, 0) + 0.5 * [labels equal]. Not a quality model."""
    same = F.when(label_src == label_tgt, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.lit(0.5) * F.greatest(cosine, F.lit(0.0)) + F.lit(0.5) * same


def quality_inputs(pairs: DataFrame, src_text: str = "src_text", tgt_text: str = "tgt_text") -> DataFrame:
    """The distinct (source, target) pairs and their two texts."""
    return pairs.select("src_idx", "tgt_idx", F.col(src_text).alias("src_text"),
                        F.col(tgt_text).alias("tgt_text")).dropDuplicates(["src_idx", "tgt_idx"])


def _safe_batches(scorer: Factory | Scorer, batch_size: int):
    """M5 over the batches of a partition; a factory's model is built once per process."""

    def run(it):
        model = model_of(scorer)
        for part in model_batches(it, ["src_text", "tgt_text"], batch_size):
            got, err = safe_batch(lambda a, b: np.asarray(model(a, b), dtype=float).tolist(),
                                  [part["src_text"], part["tgt_text"]], len(part))
            q = [None if v is None or np.isnan(v) else v for v in got]
            yield pd.DataFrame({"src_idx": part["src_idx"].to_numpy(np.int64), "tgt_idx": part["tgt_idx"].to_numpy(np.int64),
                                "quality": pd.array(q, dtype="Float64"), "error": err})

    return run


def overlap_scorer(src: pd.Series, tgt: pd.Series) -> list[float]:
    """Deterministic stand-in: shared distinct whitespace tokens over all distinct ones
    (Jaccard). Not a quality model."""
    out = []
    for a, b in zip(src, tgt):
        x, y = set((a or "").split()), set((b or "").split())
        out.append(len(x & y) / len(x | y) if x | y else 0.0)
    return out


def score_pairs(pairs: DataFrame, scorer: Factory | Scorer | None, batch_size: int = 128) -> DataFrame:
    """M2: quality for distinct pairs through a batch plug-in (keys travel with the
    batch, so no positional re-attachment is needed, J11). A ``Factory`` is shipped in place of
    its model, which is built once per Python worker; a plain function is shipped as it is."""
    if scorer is None:
        raise ValueError("a quality scorer is required")
    inputs = quality_inputs(pairs)
    return inputs.mapInPandas(_safe_batches(scorer, batch_size), SCORED_SCHEMA)


def text_keyed(inputs: DataFrame) -> DataFrame:
    """Keys of the two texts of each pair (SHA-256): what a quality belongs to, wherever the
    texts stand in their files."""
    def key(c):
        return F.sha2(F.coalesce(F.concat(F.lit("t"), c), F.lit("")), 256)      # a null text is no empty one
    return inputs.withColumn("src_key", key("src_text")).withColumn("tgt_key", key("tgt_text"))


def score_from_store(pairs: DataFrame, store: DataFrame | None, scorer: Factory | Scorer,
                     batch_size: int = 128) -> tuple[DataFrame, DataFrame]:
    """J7 + M2 + J11 by text: qualities of ``pairs`` (with texts), taken from ``store``
    (src_key, tgt_key, quality) where it has them. Returns (scores by src_idx and tgt_idx, new
    rows for the store). Pairs with equal texts are scored once, failed ones again next time;
    both results are staged."""
    keys = ["src_key", "tgt_key"]
    inputs = text_keyed(quality_inputs(pairs))
    stage_root(pairs.sparkSession)
    inputs = inputs.checkpoint(eager=True)
    todo = inputs if store is None else inputs.join(store.select(*keys), keys, "left_anti")
    # One pair of positions stands for all with its two texts.
    one = todo.groupBy(*keys).agg(F.min(F.struct("src_idx", "tgt_idx", "src_text", "tgt_text")).alias("p"))
    scored = score_pairs(one.select("p.*"), scorer, batch_size).checkpoint(eager=True)
    new = (scored.join(inputs.select("src_idx", "tgt_idx", *keys), ["src_idx", "tgt_idx"])
           .select(*keys, "quality", "error"))
    known = usable_scores(new).select(*keys, "quality")
    if store is not None:
        known = store.select(*keys, "quality").unionByName(known)
    scores = inputs.select("src_idx", "tgt_idx", *keys).join(known, keys).select("src_idx", "tgt_idx", "quality")
    return scores.checkpoint(eager=True), usable_scores(new).select(*keys, "quality")


def usable_scores(scored: DataFrame) -> DataFrame:
    """The rows of a scored table that hold a quality. A failed row (NULL quality) is not
    final: its pair counts as unscored and is tried again. A table without a quality
    column lists scored keys only."""
    return scored.filter(F.col("quality").isNotNull()) if "quality" in scored.columns else scored


def unscored_pairs(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidate pairs whose (source, target) key has no quality yet."""
    return candidates.join(usable_scores(scored).select("src_idx", "tgt_idx"), ["src_idx", "tgt_idx"], "left_anti")


def append_scored(old: DataFrame, new: DataFrame) -> DataFrame:
    """U4: old scored rows + new ones (by name). Callers drop the failed rows of ``old``
    (``usable_scores``) whose pairs were tried again."""
    return old.unionByName(new, allowMissingColumns=True)


def attach_scores(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Put scores back on candidates by key; unscored pairs keep NULL quality."""
    return candidates.join(scored.select("src_idx", "tgt_idx", "quality"), ["src_idx", "tgt_idx"], "left")


def distinct_scored_keys(scored: DataFrame) -> DataFrame:
    """Distinct (source, target) keys of a scored table that have a quality."""
    return usable_scores(scored).select("src_idx", "tgt_idx").distinct()


def candidate_coverage(candidates: DataFrame, scored: DataFrame, n_sources: int | Column) -> DataFrame:
    """Candidates, already scored, remaining, average candidates per source."""
    keys = distinct_scored_keys(scored).withColumn("_scored", F.lit(True))
    c = candidates.select("src_idx", "tgt_idx").join(keys, ["src_idx", "tgt_idx"], "left")
    total = n_sources if isinstance(n_sources, Column) else F.lit(n_sources)
    return c.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count("_scored").alias("n_scored"),
        (F.count(F.lit(1)) - F.count("_scored")).alias("n_remaining"),
        F.countDistinct("src_idx").alias("n_sources_with_candidates"),
    ).withColumn("avg_per_source",
                 F.when(total > 0, F.col("n_candidates") / total).otherwise(F.lit(0.0)))
