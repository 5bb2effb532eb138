"""Training-data queries on the driver's tables (units 13-16).

Aligned pairs (fixed mapping): in ``conversations`` a user turn is the source and
the assistant turn right after it (same conversation, ``turn + 1``) the target.
Positions follow (conv_id, turn).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.operators import trainprep as TP
from pairmine.session import default_parallelism
from pairmine.sources.dense_index import dense_index
from pairmine.sources.tables import table

BATCH = 8


def _turns(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src_text"))
    asst = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt_text"))
    return user, asst


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, asst = _turns(spark, sf_dir)
    pairs = TP.drop_null_pairs(user.join(asst, ["conv_id", "turn"]), "src_text", "tgt_text")
    return dense_index(pairs, ["conv_id", "turn"])


def _ids(arr):
    return F.array_join(arr, " ")


def q_zip_by_position(spark, sf_dir):
    """Sources and targets indexed on their own, zipped by position."""
    user, asst = _turns(spark, sf_dir)
    keys = user.join(asst.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    src = dense_index(keys, ["conv_id", "turn"]).select("idx", "src_text")
    tgt = dense_index(asst.join(user.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi"),
                      ["conv_id", "turn"]).select("idx", "tgt_text")
    return TP.zip_by_position(src, tgt)


def q_two_direction_pairs(spark, sf_dir):
    return TP.two_direction_pairs(training_pairs(spark, sf_dir), "src_text", "tgt_text", "user", "assistant")


def q_split_positional(spark, sf_dir):
    return TP.split_positional(training_pairs(spark, sf_dir)).select("idx", "split")


def q_split_stratified(spark, sf_dir):
    return TP.split_stratified(training_pairs(spark, sf_dir), "idx", "tgt_text").select("idx", "bucket", "split")


def q_build_vocab(spark, sf_dir):
    """D4 for each language column."""
    pairs = training_pairs(spark, sf_dir)
    src, tgt = (TP.build_vocab(pairs, c).withColumn("side", F.lit(c)) for c in ("src_text", "tgt_text"))
    return src.unionByName(tgt)


def _encoded(spark, sf_dir):
    pairs = training_pairs(spark, sf_dir)
    vs = TP.build_vocab(pairs, "src_text")
    vt = TP.build_vocab(pairs, "tgt_text")
    src = TP.encode_tokens(pairs, "idx", "src_text", vs, "src_ids")
    tgt = TP.encode_tokens(pairs, "idx", "tgt_text", vt, "tgt_ids")
    return src.join(tgt, "idx")


def q_encode_tokens(spark, sf_dir):
    return _encoded(spark, sf_dir).select("idx", _ids(F.col("src_ids")).alias("src_ids"),
                                          _ids(F.col("tgt_ids")).alias("tgt_ids"))


def _packed(spark, sf_dir):
    return TP.pack_seq2seq(_encoded(spark, sf_dir), "src_ids", "tgt_ids")


def q_pack_seq2seq(spark, sf_dir):
    p = _packed(spark, sf_dir)
    return p.select("idx", *[_ids(F.col(c)).alias(c) for c in ("encoder_input", "decoder_input", "label")])


def q_masks(spark, sf_dir):
    p = TP.masks(_packed(spark, sf_dir))
    return p.select("idx", _ids(F.col("encoder_mask")).alias("encoder_mask"),
                    _ids(F.col("decoder_padding_mask")).alias("decoder_padding_mask"))


def _written_masks(batches):
    """Of each row of the decoder mask of (idx, decoder_input): idx, row, the number of ones and the
    hash of its digits with spaces between. One pair's mask is held at a time."""
    for b in batches:
        for idx, ids in zip(b.column(0), b.column(1)):
            mask = TP.causal_mask_array(np.array(ids.as_py(), np.int64))
            n = len(mask)
            digits = np.full((n, 2 * n), ord(" "), np.uint8)
            digits[:, ::2] = mask + ord("0")
            text = digits[:, :-1].tobytes()
            md5 = [hashlib.md5(text[a:a + 2 * n - 1]).hexdigest() for a in range(0, len(text), 2 * n - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([idx.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(mask.sum(axis=1, dtype=np.int32)), pa.array(md5, pa.string())],
                names=["idx", "row", "ones", "mask_md5"])


def q_causal_mask(spark, sf_dir):
    """D7, the whole decoder mask of every pair at the full length: of each of its rows the
    number of ones and the hash of the row written out. The masks, far larger than the pairs, are
    made where they are written out; the number of tasks must not follow the size of the pairs."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * default_parallelism(spark))
    pairs = _packed(spark, sf_dir).select("idx", "decoder_input").repartition(parts, "idx")
    return pairs.mapInArrow(_written_masks, "idx long, row int, ones int, mask_md5 string")


def q_mask_labels(spark, sf_dir):
    p = _packed(spark, sf_dir)
    return p.select("idx", _ids(TP.mask_labels(F.col("label"))).alias("label"))


def q_pad_to_longest(spark, sf_dir):
    """D10 for each side of the pairs."""
    e = _encoded(spark, sf_dir)
    out = []
    for side in ("src_ids", "tgt_ids"):
        p = TP.pad_to_longest(e, "idx", side, BATCH)
        out.append(p.select("idx", F.lit(side).alias("side"), "batch_id",
                            F.col("batch_len").cast("int").alias("batch_len"), _ids(F.col(side)).alias("ids")))
    return out[0].unionByName(out[1])


def q_pack_two_files(spark, sf_dir):
    p = TP.pack_two_files(_encoded(spark, sf_dir), "src_ids", "tgt_ids")
    return p.select("idx", *[_ids(F.col(c)).alias(c) for c in ("encoder_input", "decoder_input", "label")])


def q_shuffle(spark, sf_dir):
    """A repeatable shuffled order."""
    return TP.shuffle_order(training_pairs(spark, sf_dir), "idx", seed=7, epoch=1).select("idx", "shuffle_key", "position")


def q_clean_sentences(spark, sf_dir):
    """D3 for each language column."""
    pairs = training_pairs(spark, sf_dir)
    out = [TP.clean_sentences(pairs, c).select(F.lit(c).alias("side"), F.col(c).alias("sentence"))
           for c in ("src_text", "tgt_text")]
    return out[0].unionByName(out[1])


QUERIES = {
    "zip_by_position": q_zip_by_position,
    "two_direction_pairs": q_two_direction_pairs,
    "split_positional": q_split_positional,
    "split_stratified": q_split_stratified,
    "build_vocab": q_build_vocab,
    "encode_tokens": q_encode_tokens,
    "pack_seq2seq": q_pack_seq2seq,
    "masks": q_masks,
    "mask_labels": q_mask_labels,
    "pad_to_longest": q_pad_to_longest,
    "pack_two_files": q_pack_two_files,
    "shuffle": q_shuffle,
    "clean_sentences": q_clean_sentences,
    "causal_mask": q_causal_mask,
}
