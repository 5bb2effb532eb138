"""Training-data preparation: D1 split_positional, D2 split_stratified, D3
clean_sentences, D4 build_vocab, D5 encode_tokens, D6 pack_seq2seq, D7 masks,
D8/J16 directional_examples, D9 mask_labels, D10 pad_to_longest, D11 shuffle,
D12 pack_two_files, J10 zip_by_position, W9 batch_id, P2 drop_null_pairs, P3 cast_text.

Everything is per row (array functions) except the vocabulary (one aggregation by
token, then a top-N that Spark plans as a per-partition partial top-N) and the
splits (a dense index, see ``sources.dense_index``). The vocabulary is bounded by
its size, so it is broadcast to the encoder join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmine.functions.scalar import pad_to, py_split, py_strip, truncate_to
from pairmine.sources.dense_index import dense_index, rank_within

# ---------------------------------------------------------------------------
# Special token ids and defaults.
PAD, UNK, SOS, EOS = 0, 1, 2, 3
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[SOS]", "[EOS]"]
VOCAB_SIZE = 8000
SEQ_LEN = 350
TRAIN_FRACTION = 0.9
LABEL_IGNORE = -100
MAX_TOKENS_PER_SIDE = 256
VOCAB_BROADCAST_ROWS = 200_000
STRATIFIED_CUTS = (0.98, 0.99)   # train / validation / test = 98 / 1 / 1
# ---------------------------------------------------------------------------


def drop_null_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """P2 + P3: drop rows with a null in either column, cast both to string."""
    return df.dropna(subset=[a, b]).withColumn(a, F.col(a).cast("string")).withColumn(b, F.col(b).cast("string"))


def clean_sentences(df: DataFrame, col: str) -> DataFrame:
    """Stripped, non-blank sentences of one language column."""
    return df.select(py_strip(F.col(col)).alias(col)).filter(F.col(col).isNotNull() & (F.col(col) != ""))


def split_positional(indexed: DataFrame, fraction: float = TRAIN_FRACTION, idx: str = "idx") -> DataFrame:
    """First int(fraction * n) rows (file order) are train, the rest validation."""
    n = indexed.count()
    cut = int(fraction * n)
    return indexed.withColumn("split", F.when(F.col(idx) < cut, F.lit("train")).otherwise(F.lit("validation")))


def length_bucket(tokens: Column) -> Column:
    """Our bucket rule (the README gives none): tokens // 10, capped at 10."""
    return F.least(F.floor(F.size(tokens) / 10), F.lit(10)).cast("int")


def split_stratified(df: DataFrame, id_col: str, tgt_col: str, seed: int = 0,
                     cuts=STRATIFIED_CUTS) -> DataFrame:
    """98/1/1 per target-length bucket. Inside a bucket rows are ordered by
    md5(id || seed); the first floor(0.98*size) are train, up to floor(0.99*size)
    validation, the rest test. The in-bucket rank comes from a dense index, so a
    large bucket is never sorted by one task."""
    keyed = (df.withColumn("bucket", length_bucket(py_split(F.col(tgt_col))))
               .withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))))
    ranked = rank_within(dense_index(keyed, ["bucket", "_h", id_col], "_gidx"), ["bucket"], "_gidx", "_r")
    a, b = cuts
    split = (F.when(F.col("_r") < F.floor(F.lit(a) * F.col("group_size")), F.lit("train"))
              .when(F.col("_r") < F.floor(F.lit(b) * F.col("group_size")), F.lit("validation"))
              .otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("_h", "_gidx", "_r", "group_size")


def build_vocab(df: DataFrame, col: str, size: int = VOCAB_SIZE) -> DataFrame:
    """``[PAD] [UNK] [SOS] [EOS]`` get ids 0-3; then the ``size - 4`` most frequent
    whitespace tokens (count desc, token asc) get ids 4, 5, ...; the special tokens'
    own strings in a text are not counted again.
    Returns ``token, token_id, n``."""
    counts = (df.select(F.explode(py_split(F.col(col))).alias("token"))
                .filter(~F.col("token").isin(SPECIAL_TOKENS)).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(max(0, size - len(SPECIAL_TOKENS)))
    w = Window.orderBy(F.desc("n"), F.asc("token"))  # over at most `size` rows
    words = top.withColumn("token_id", (F.row_number().over(w) + len(SPECIAL_TOKENS) - 1).cast("long"))
    spark = df.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIAL_TOKENS)],
                                     "token string, token_id long, n long")
    return specials.unionByName(words.select("token", "token_id", "n"))


def encode_tokens(df: DataFrame, id_col: str, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """Whitespace tokens -> ids (unknown -> 1), in token order. ``id_col`` names a row: rows
    that share an id, or have none, keep their own tokens (told apart by the text). A vocabulary of at most
    ``VOCAB_BROADCAST_ROWS`` (counted) is broadcast and rows are grouped back in
    the partitioning they already have; a larger one is joined by a shuffle."""
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.md5(F.coalesce(F.col(col), F.lit(""))))
    base = df.select(id_col, col, name.alias("_row")).repartition("_row")
    toks = base.select("_row", F.posexplode(py_split(F.col(col))).alias("pos", "token"))
    v = vocab.filter(~F.col("token").isin(SPECIAL_TOKENS)).select("token", "token_id")
    if v.limit(VOCAB_BROADCAST_ROWS + 1).count() <= VOCAB_BROADCAST_ROWS:
        v = F.broadcast(v)
    # A set: rows that repeat id and text bring the same tokens again.
    ids = (toks.join(v, "token", "left")
               .withColumn("token_id", F.coalesce(F.col("token_id"), F.lit(UNK).cast("long")))
               .groupBy("_row")
               .agg(F.array_sort(F.collect_set(F.struct("pos", "token_id"))).alias("_p")))
    enc = ids.select("_row", F.transform("_p", lambda s: s["token_id"]).alias(out))
    return (base.join(enc, "_row", "left")
                .select(id_col, F.coalesce(F.col(out), F.array().cast("array<long>")).alias(out)))


def pack_seq2seq(df: DataFrame, src_ids: str, tgt_ids: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """encoder = [SOS] + src[:L-2] + [EOS] + pad; decoder = [SOS] + tgt[:L-1] + pad;
    label = tgt[:L-1] + [EOS] + pad; all of length L."""
    sos, eos = F.array(F.lit(SOS).cast("long")), F.array(F.lit(EOS).cast("long"))
    enc = F.concat(sos, truncate_to(F.col(src_ids), seq_len - 2), eos)
    dec = F.concat(sos, truncate_to(F.col(tgt_ids), seq_len - 1))
    lab = F.concat(truncate_to(F.col(tgt_ids), seq_len - 1), eos)
    return (df.withColumn("encoder_input", pad_to(enc, seq_len, PAD))
              .withColumn("decoder_input", pad_to(dec, seq_len, PAD))
              .withColumn("label", pad_to(lab, seq_len, PAD)))


def padding_mask(arr: Column, pad: int = PAD) -> Column:
    """1 where the id is not padding."""
    return F.transform(arr, lambda x: F.when(x != pad, 1).otherwise(0))


def causal_mask(arr: Column, pad: int = PAD) -> Column:
    """The decoder mask row by row: (id != PAD) and column <= row. L x L, built only
    on request. (An array of one lets the rows' lambda hold the padding mask, which is made once.)"""
    return F.element_at(F.transform(F.array(padding_mask(arr, pad)), lambda mask: F.transform(
        F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.concat(
            F.slice(mask, F.lit(1), i + 1), F.array_repeat(F.lit(0), F.size(mask) - i - 1)))), 1)


def causal_mask_array(ids: np.ndarray, pad: int = PAD) -> np.ndarray:
    """``causal_mask`` of one id sequence inside a task, as an L x L array of 0 and 1."""
    return np.tril(np.broadcast_to((ids != pad).astype(np.uint8), (len(ids), len(ids))))


def masks(df: DataFrame) -> DataFrame:
    return (df.withColumn("encoder_mask", padding_mask(F.col("encoder_input")))
              .withColumn("decoder_padding_mask", padding_mask(F.col("decoder_input"))))


def mask_labels(arr: Column, pad: int = PAD) -> Column:
    """Padding in labels -> -100."""
    return F.transform(arr, lambda x: F.when(x == pad, F.lit(LABEL_IGNORE).cast("long")).otherwise(x))


def batch_id(idx: Column, batch_size: int) -> Column:
    """Consecutive chunks of ``batch_size`` by position."""
    return F.floor(idx / F.lit(batch_size)).cast("long")


def pad_to_longest(df: DataFrame, idx: str, col: str, batch_size: int,
                   max_len: int = MAX_TOKENS_PER_SIDE, pad: int = PAD) -> DataFrame:
    """Cut each row to ``max_len``, then pad it to the longest row of its batch.
    A batch is bounded by ``batch_size`` rows."""
    cut = truncate_to(F.col(col), max_len)
    w = Window.partitionBy("batch_id")
    return (df.withColumn("batch_id", batch_id(F.col(idx), batch_size))
              .withColumn(col, cut)
              .withColumn("batch_len", F.max(F.size(col)).over(w))
              .withColumn(col, pad_to(F.col(col), F.col("batch_len"), pad)))


def shuffle_order(df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """A repeatable random order for training batches: ``position`` is the dense index
    by the MD5 of (id, seed, epoch), without a driver round trip or a one-task sort."""
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(str(epoch)))
    return dense_index(df.withColumn("shuffle_key", F.md5(text)), ["shuffle_key", id_col], "position")


def zip_by_position(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """Positional zip of two indexed tables; a count mismatch raises."""
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"row counts differ: {na} vs {nb}")
    return a.join(b, idx)


def two_direction_pairs(df: DataFrame, a: str, b: str, tag_a: str, tag_b: str, id_col: str = "idx") -> DataFrame:
    """The same pairs as A->B and B->A, with language tags."""
    fwd = df.select(id_col, F.lit(tag_a).alias("src_lang"), F.lit(tag_b).alias("tgt_lang"),
                    F.col(a).alias("src_text"), F.col(b).alias("tgt_text"))
    bwd = df.select(id_col, F.lit(tag_b).alias("src_lang"), F.lit(tag_a).alias("tgt_lang"),
                    F.col(b).alias("src_text"), F.col(a).alias("tgt_text"))
    return fwd.unionByName(bwd)


def _ensure_eos(arr: Column) -> Column:
    eos = F.array(F.lit(EOS).cast("long"))
    return F.when((F.size(arr) == 0) | (F.element_at(arr, -1) != EOS), F.concat(arr, eos)).otherwise(arr)


def pack_two_files(df: DataFrame, src_ids: str, tgt_ids: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """D12 (older packing, source and target zipped from two tables): [EOS] is appended
    to both sides unless already last, both are cut to L-2; encoder = [SOS] + src +
    [EOS] + pad, decoder = [SOS] + tgt + [EOS] + pad, label = tgt + [EOS] + pad;
    padding is never negative."""
    sos, eos = F.array(F.lit(SOS).cast("long")), F.array(F.lit(EOS).cast("long"))
    enc = truncate_to(_ensure_eos(F.col(src_ids)), seq_len - 2)
    dec = truncate_to(_ensure_eos(F.col(tgt_ids)), seq_len - 2)
    return (df.withColumn("encoder_input", pad_to(F.concat(sos, enc, eos), seq_len, PAD))
              .withColumn("decoder_input", pad_to(F.concat(sos, dec, eos), seq_len, PAD))
              .withColumn("label", pad_to(F.concat(dec, eos), seq_len, PAD)))
