"""Model plug-ins, sources and sinks on the driver's tables.

The file queries write the tables with the sinks into a folder of their own under the
shared stage folder, read them back with the sources and return what was read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairmine.operators import models as MD
from pairmine.operators import quality as Q
from pairmine.operators import scoring as SC
from pairmine.plans import mining as M
from pairmine.plans import sweep as SW
from pairmine.plans.mining_queries import _final, rounded
from pairmine.plans.mt_queries import eval_rows
from pairmine.plans.prep_queries import training_pairs
from pairmine.session import stage_path
from pairmine.sources import io as IO
from pairmine.sources.tables import table


OVERLAP = MD.Factory("token-overlap", lambda: Q.overlap_scorer)


def _folder(spark) -> str:
    return stage_path(spark, f"io-{uuid.uuid4().hex}")


def q_embed(spark, sf_dir):
    """M1 with the hashed-trigram stand-in over every document (whole texts): the
    components that are not zero."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    vec = MD.embed(docs, "text").select("idx", F.posexplode("vec").alias("cell", "w"))
    return vec.filter("w <> 0").select("idx", "cell", F.round(F.col("w").cast("double"), 6).alias("w"))


def q_translate(spark, sf_dir):
    """M3 with the copy stand-in over both directions of the aligned pairs."""
    pairs = training_pairs(spark, sf_dir)
    out = [MD.translate(pairs, col, a, b).withColumn("direction", F.lit(f"{a}-{b}"))
           for col, a, b in (("src_text", "user", "assistant"), ("tgt_text", "assistant", "user"))]
    return out[0].unionByName(out[1])


def _word_pairs(spark, sf_dir):
    return training_pairs(spark, sf_dir).select(F.col("idx").alias("src_idx"), F.col("idx").alias("tgt_idx"),
                                                "src_text", "tgt_text")


def q_quality_score(spark, sf_dir):
    """M2 + M5 + J11: the token-overlap stand-in through the batch plug-in, joined back."""
    pairs = _word_pairs(spark, sf_dir)
    scored = Q.score_pairs(pairs, OVERLAP)
    return rounded(Q.attach_scores(pairs.select("src_idx", "tgt_idx"), scored))


def length_ratio():
    """Stand-in learned metric: shorter over longer, in characters."""
    def score(src, hyp, ref):
        return [min(len(h), len(r)) / max(len(h), len(r), 1) for h, r in zip(hyp.fillna(""), ref.fillna(""))]
    return score


def q_model_metric(spark, sf_dir):
    """M4 through the plug-in; a blank reference gives NULL."""
    ev = eval_rows(spark, sf_dir)
    return rounded(MD.model_metric(ev, MD.Factory("length-ratio", length_ratio), "length_ratio", "source",
                                   "prediction", "reference"))


def q_read_sentences(spark, sf_dir):
    """K6 -> S1: the documents' lines, written in order and read back with their index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    path = _folder(spark)
    IO.write_text_corpus(ordered.select(F.explode(F.split("text", "\r\n|\r|\n")).alias("line")), "line", path)
    return IO.read_sentences(spark, path)


def q_read_pairs_csv(spark, sf_dir):
    """K1 -> S2: all aligned pairs through a CSV, read back in file order."""
    pairs = training_pairs(spark, sf_dir).orderBy("idx")
    path = _folder(spark)
    IO.write_pairs(pairs.select("idx", "src_text", "tgt_text"), path)
    return IO.read_pairs_csv(spark, path, "src_text", "tgt_text")


def q_read_eval_csv(spark, sf_dir):
    """K2 -> S3 (DV-10): a translation output, every field quoted, read for evaluation."""
    pairs = training_pairs(spark, sf_dir).orderBy("idx")
    path = _folder(spark)
    IO.write_quoted_csv(pairs.select(F.col("src_text").alias("input"), F.col("src_text").alias("translation"),
                                     F.col("tgt_text").alias("reference")), path)
    return IO.read_eval_csv(spark, path, **IO.TRANSLATION_COLUMNS)


def q_write_eval(spark, sf_dir):
    """S3 -> E1-E3 -> K7: an evaluated table written and read back."""
    from pairmine.operators import mt_metrics as MT
    ev = training_pairs(spark, sf_dir).select(F.col("idx").alias("row_id"), F.col("src_text").alias("prediction"),
                                              F.col("tgt_text").alias("reference"))
    path = _folder(spark)
    IO.write_eval(MT.bleu_rows(ev), path)
    back = spark.read.option("header", True).schema("row_id long, bleu double").csv(path)
    return rounded(back)


def q_read_aligned_lines(spark, sf_dir):
    """Two line files of equal length; line breaks inside a text become spaces."""
    pairs = training_pairs(spark, sf_dir).orderBy("idx")
    root = _folder(spark)
    for side in ("src_text", "tgt_text"):
        line = F.concat(F.lit("> "), F.regexp_replace(side, "[\r\n]", " ")).alias("value")
        pairs.select(line).write.text(f"{root}/{side}")
    return IO.read_aligned_lines(spark, f"{root}/src_text", f"{root}/tgt_text")


def q_stage_roundtrip(spark, sf_dir):
    """K8 -> S6: the best pairs as a stage table; an unfinished stage reads as None."""
    _, _, fp = _final(spark, sf_dir)
    path = _folder(spark)
    assert IO.read_stage(spark, path) is None
    IO.write_stage(fp, path, {"last_step": "best_per_source"})
    return rounded(IO.read_stage(spark, path).select("src_idx", "tgt_idx", "pre_rank", "quality"))


def _kept_sweep(spark, sf_dir, grids, **kw):
    """Sweeps of several grids, one after the other, into one results folder (and pairs, best)."""
    from pairmine.plans.mining_queries import _quality_expr
    from pairmine.sources.tables import corpora
    c = corpora(spark, sf_dir)
    root = _folder(spark)
    kw = {"quality_expr": _quality_expr, **kw}
    for grid in grids:
        res = SW.run_sweep_to(grid, f"{root}/results", f"{root}/pairs", c.src_vec, c.tgt_vec, c.src_attrs, c.tgt_attrs,
                              best_dir=f"{root}/best", **kw)
    return root, res


def q_sweep_results_kept(spark, sf_dir):
    """K3 + J14: a sweep in slices of one config into a results folder, resumed: the two runs
    together hold every config once."""
    from pairmine.plans.sweep_queries import failing_grid
    base = SW.grid_baseline(spark)
    _, res = _kept_sweep(spark, sf_dir, [base, base.unionByName(failing_grid(spark))], slice_rows=1)
    return rounded(res.select("experiment_id", "status", "successful", "weighted_score", "error"))


def q_sweep_best_so_far(spark, sf_dir):
    """K4 + A12: what the best-pairs folder names after a sweep in slices of one config."""
    root, _ = _kept_sweep(spark, sf_dir, [SW.grid_baseline(spark)], slice_rows=1)
    cols = ["experiment_id", "src_idx", "tgt_idx", "pre_rank", "final_score", "quality", "margin"]
    return rounded(IO.read_best_pairs(spark, f"{root}/best").select(*cols))


NEAR_RANK = 20      # a quality model that takes no candidate beyond this rank


def q_sweep_isolated(spark, sf_dir):
    """The ablation configs at a smaller search_k, and one whose search reaches candidates that
    the quality model refuses with an error: that one alone fails."""
    from pairmine.plans.mining_queries import _quality_expr

    def strict(df):
        far = F.coalesce(F.least("ip_rank", "l2_rank"), F.lit(0)) > NEAR_RANK
        return F.when(far, F.raise_error("no quality beyond rank 20").cast("double")).otherwise(_quality_expr(df))
    near = SW.grid_baseline(spark).withColumn("search_k", F.lit(NEAR_RANK))
    far = SW.grid_baseline(spark).filter("experiment_id = 10001").withColumn("experiment_id", F.lit(10006).cast("long"))
    _, res = _kept_sweep(spark, sf_dir, [near.unionByName(far)], quality_expr=strict)
    return rounded(res.select("experiment_id", "status", "successful", "weighted_score", "error"))


def q_restore_order(spark, sf_dir):
    """T3 -> K1: the best pairs written in source order; their position in the files."""
    from pairmine.operators import selection as SEL
    _, _, fp = _final(spark, sf_dir)
    path = _folder(spark)
    IO.write_pairs(SEL.restore_order(fp.select("src_idx", "tgt_idx")), path)
    rows = IO.read_pairs_csv(spark, path, "src_idx", "tgt_idx")
    return rows.select("idx", F.col("src_idx").cast("long").alias("src_idx"), F.col("tgt_idx").cast("long").alias("tgt_idx"))


def q_incremental_scoring(spark, sf_dir):
    """Resume path as a stream: the aligned pairs land in two files, the second holding the
    first's pairs as well; every pair is scored once by the token-overlap stand-in."""
    from pairmine.streaming import incremental as INC
    root = _folder(spark)
    pairs = _word_pairs(spark, sf_dir).select("src_idx", "tgt_idx", "src_text", "tgt_text")
    for part in (pairs.filter("src_idx % 3 = 0"), pairs):
        part.write.mode("append").parquet(f"{root}/candidates")
        INC.start_incremental_scoring(spark, f"{root}/candidates", f"{root}/scored", f"{root}/checkpoint",
                                      OVERLAP).awaitTermination()
    return rounded(spark.read.parquet(f"{root}/scored").select("src_idx", "tgt_idx", "quality"))


CORPUS = SC.MiningConfig(search_k=20, top_after_filtering=5, quality_threshold=0.05,
                         sparse_threshold=0.37, crowded_threshold=0.36)


def _corpus_lines(spark, sf_dir):
    """The benchmark items and the assistant turns, one line each (line breaks as spaces)."""
    flat = F.regexp_replace("text", "[\r\n]", " ").alias("line")
    items = table(spark, sf_dir, "benchmark").repartitionByRange("item_id").sortWithinPartitions("item_id")
    turns = (table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null")
             .repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn"))
    return items.select(flat), turns.select(flat)


def _mined(spark, path):
    """The pairs of K1's CSV."""
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rounded(back.select(F.col("src_idx").cast("long").alias("src_idx"), F.col("tgt_idx").cast("long").alias("tgt_idx"),
                               "src_text", "tgt_text", F.col("final_score").cast("double").alias("final_score"),
                               F.col("pre_rank").cast("int").alias("pre_rank"),
                               F.col("quality").cast("double").alias("quality"), F.col("margin").cast("double").alias("margin")), 6)


def q_mine_corpus(spark, sf_dir):
    """X7 from files to files: the benchmark items are the source sentences, the assistant
    turns the target sentences; the pairs are read back from K1's CSV."""
    root = _folder(spark)
    items, turns = _corpus_lines(spark, sf_dir)
    IO.write_text_corpus(items, "line", f"{root}/src")
    IO.write_text_corpus(turns, "line", f"{root}/tgt")
    M.mine_corpus(spark, f"{root}/src", f"{root}/tgt", f"{root}/pairs", CORPUS, embedder=MD.EMBEDDER,
                  scorer=OVERLAP, stage_path=f"{root}/stage")
    return _mined(spark, f"{root}/pairs")


def q_mine_corpus_resumed(spark, sf_dir):
    """X7 + S6 + K8, resumed: a first run over the assistant turns the other way round, against
    which every position differs, and a second one over the turns in order, with the same
    stage folder. The second run's pairs, and how many qualities came from the first: those of
    the pairs of texts that both runs had among their candidates."""
    root = _folder(spark)
    items, turns = _corpus_lines(spark, sf_dir)
    IO.write_text_corpus(items, "line", f"{root}/src")
    back = (table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null")
            .select("conv_id", "turn", F.regexp_replace("text", "[\r\n]", " ").alias("line"))
            .repartitionByRange(F.desc("conv_id"), F.desc("turn")).sortWithinPartitions(F.desc("conv_id"), F.desc("turn")))
    IO.write_text_corpus(back, "line", f"{root}/tgt_before")
    IO.write_text_corpus(turns, "line", f"{root}/tgt")
    for tgt in ("tgt_before", "tgt"):
        M.mine_corpus(spark, f"{root}/src", f"{root}/{tgt}", f"{root}/pairs", CORPUS, embedder=MD.EMBEDDER,
                      scorer=OVERLAP, stage_path=f"{root}/stage")
    return _mined(spark, f"{root}/pairs")


def q_sweep_from_file(spark, sf_dir):
    """S5 + P7 + P8: all grids written as one CSV file, read from experiment 10001 on, the first two
    of them run over the corpora."""
    from pairmine.plans.mining_queries import _quality_expr
    from pairmine.plans.sweep_queries import sweep_grid
    from pairmine.sources.tables import corpora
    c = corpora(spark, sf_dir)
    path = _folder(spark)
    sweep_grid(spark).withColumnRenamed("quality_threshold", "comet_threshold").write.option("header", True).csv(path)
    grid = SW.read_param_grid(spark, path, start_from=10001, max_experiments=2)
    res = SW.run_sweep(grid, c.src_vec, c.tgt_vec, c.src_attrs, c.tgt_attrs, quality_expr=_quality_expr, materialize=False)
    return rounded(res.results)


def q_aligned_first_n(spark, sf_dir):
    """S4 + P7: the first 100 lines of two aligned files."""
    pairs = training_pairs(spark, sf_dir).orderBy("idx")
    root = _folder(spark)
    for side in ("src_text", "tgt_text"):
        pairs.select(F.concat(F.lit("> "), F.regexp_replace(side, "[\r\n]", " "))).write.text(f"{root}/{side}")
    return IO.read_aligned_lines(spark, f"{root}/src_text", f"{root}/tgt_text", first_n=100)


def q_blank_references(spark, sf_dir):
    """Every evaluation row as it is, and again with a blank reference and without a prediction."""
    from pairmine.operators import mt_metrics as MT
    ev = eval_rows(spark, sf_dir).select("row_id", "prediction", "reference")
    blank = ev.select((-1 - F.col("row_id")).alias("row_id"), "prediction", F.lit(" \n\t\u00a0").alias("reference"))
    none = ev.select((-1_000_000_000 - F.col("row_id")).alias("row_id"), F.lit(None).cast("string").alias("prediction"), "reference")
    return rounded(MT.metric_rows(ev.unionByName(blank).unionByName(none), ["bleu", "meteor"]))


def q_density_non_finite(spark, sf_dir):
    """The targets' density with a broken copy of every vector among them (one component
    is no number, or infinite)."""
    from pairmine.sources.tables import corpora
    tgt = corpora(spark, sf_dir).tgt_vec
    broken = tgt.select((F.col("idx") + 1_000_000_000).alias("idx"), F.transform(
        "vec", lambda x, i: F.when(i > 0, x).otherwise(F.lit(float("nan"))).cast("float")).alias("vec"))
    endless = tgt.select((F.col("idx") + 2_000_000_000).alias("idx"), F.transform(
        "vec", lambda x, i: F.when(i > 0, F.lit(0.0)).otherwise(F.lit(float("inf"))).cast("float")).alias("vec"))
    return rounded(SC.density_stats(tgt.unionByName(broken).unionByName(endless), CORPUS.k_neighbors))


QUERIES = {
    "sweep_from_file": q_sweep_from_file,
    "aligned_first_n": q_aligned_first_n,
    "blank_references": q_blank_references,
    "density_non_finite": q_density_non_finite,
    "embed": q_embed,
    "translate": q_translate,
    "quality_score": q_quality_score,
    "model_metric": q_model_metric,
    "read_sentences": q_read_sentences,
    "read_pairs_csv": q_read_pairs_csv,
    "read_eval_csv": q_read_eval_csv,
    "write_eval": q_write_eval,
    "read_aligned_lines": q_read_aligned_lines,
    "stage_roundtrip": q_stage_roundtrip,
    "sweep_results_kept": q_sweep_results_kept,
    "sweep_best_so_far": q_sweep_best_so_far,
    "sweep_isolated": q_sweep_isolated,
    "mine_corpus": q_mine_corpus,
    "mine_corpus_resumed": q_mine_corpus_resumed,
    "restore_order": q_restore_order,
    "incremental_scoring": q_incremental_scoring,
}
