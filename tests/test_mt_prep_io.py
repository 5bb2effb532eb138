"""FX-9..FX-12: translation metrics, packing, splits, vocabulary, line readers, sinks."""
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmine.operators import mt_metrics as MT
from pairmine.operators import trainprep as TP
from pairmine.plans import prep_queries as PQ
from pairmine.sources import io as IO
from pairmine.sources.dense_index import dense_index


def _eval(spark, rows):
    return spark.createDataFrame(rows, "row_id long, prediction string, reference string")


def test_fx9_metrics(spark):
    df = _eval(spark, [(1, "the cat sat on the mat", "the cat is on the mat"), (2, "a b c", "a b c"),
                       (3, "x y z w", "x y z w"), (4, "foo", "  "), (5, "foo", None), (6, "p q r s", "t u v w")])
    b = {r.row_id: r.bleu for r in MT.bleu_rows(df).collect()}
    assert b[1] == pytest.approx(37.991784, abs=1e-6) and b[2] == 0.0 and b[3] == pytest.approx(100.0)
    assert b[4] is None and b[5] is None and b[6] == 0.0
    c = {r.row_id: r.chrf for r in MT.chrf_rows(df).collect()}
    assert c[1] == pytest.approx(64.577942, abs=1e-6)
    cp = {r.row_id: r.chrf_pp for r in MT.chrf_pp_rows(df).collect()}
    assert cp[1] == pytest.approx(66.360671, abs=1e-6)
    m = {r.row_id: r.meteor for r in MT.meteor_rows(df).collect()}
    assert m[1] == pytest.approx(0.806667, abs=1e-6) and m[4] is None and m[6] == 0.0


def _py_13a(line):
    """Independent Python rendering of the published 13a rules, for the check."""
    import re
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = f" {line} "
    for pat, rep in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                     (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        line = re.sub(pat, rep, line)
    return line.split()


def test_13a_tokens(spark):
    texts = ["Hello, world! It's 3.5-4 &amp; done.", "a-\nb (x) [y] 1,000.5 end.\n", "  q&lt;r  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(MT.tokenize_13a(F.col("t")).alias("x")).collect()]
    assert got == [_py_13a(t) for t in texts]


def test_unicode_chars(spark):
    # combining vowel sign and an astral character count as code points, as in Python
    t = "कि😀a b"
    df = _eval(spark, [(1, t, t)])
    assert MT.chrf_rows(df).collect()[0].chrf == pytest.approx(100.0)


def test_fx10_packing(spark):
    df = spark.createDataFrame([(0, list(range(11, 17)), [21, 22])], "idx long, s array<long>, t array<long>")
    p = TP.masks(TP.pack_seq2seq(df, "s", "t", seq_len=6)).collect()[0]
    assert p.encoder_input == [2, 11, 12, 13, 14, 3]
    assert p.decoder_input == [2, 21, 22, 0, 0, 0]
    assert p.label == [21, 22, 3, 0, 0, 0]
    assert p.encoder_mask == [1] * 6 and p.decoder_padding_mask == [1, 1, 1, 0, 0, 0]
    cm = df.select(TP.causal_mask(F.array(F.lit(2), F.lit(21), F.lit(0))).alias("m")).collect()[0].m
    assert cm == [[1, 0, 0], [1, 1, 0], [1, 1, 0]]
    old = TP.pack_two_files(df, "s", "t", seq_len=6).collect()[0]
    assert old.encoder_input == [2, 11, 12, 13, 14, 3] and old.label == [21, 22, 3, 3, 0, 0]


def test_fx11_split_vocab_labels(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "k long")
    idx = dense_index(df, ["k"])
    s = {r.idx: r.split for r in TP.split_positional(idx).collect()}
    assert sum(v == "train" for v in s.values()) == 9 and s[9] == "validation" and s[8] == "train"
    texts = spark.createDataFrame([(0, "b a b"), (1, "c a b")], "idx long, t string")
    v = {r.token: r.token_id for r in TP.build_vocab(texts, "t", 6).collect()}
    assert v == {"[PAD]": 0, "[UNK]": 1, "[SOS]": 2, "[EOS]": 3, "b": 4, "a": 5}
    enc = {r.idx: r.ids for r in TP.encode_tokens(texts, "idx", "t", TP.build_vocab(texts, "t", 6)).collect()}
    assert enc == {0: [4, 5, 4], 1: [1, 5, 4]}
    lab = spark.createDataFrame([([5, 3, 0, 0],)], "l array<long>").select(TP.mask_labels(F.col("l")).alias("x"))
    assert lab.collect()[0].x == [5, 3, -100, -100]
    rows = spark.createDataFrame([(0, [1, 2]), (1, [1, 2, 3]), (2, list(range(300)))], "idx long, ids array<long>")
    p = {r.idx: r.ids for r in TP.pad_to_longest(rows, "idx", "ids", 2).collect()}
    assert p[0] == [1, 2, 0] and len(p[2]) == 256


def test_split_stratified_complete(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i % 25))) for i in range(400)], "idx long, t string")
    out = TP.split_stratified(df, "idx", "t")
    assert out.count() == 400 and out.select("idx").distinct().count() == 400
    assert out.filter("split = 'train'").count() >= 380


def test_dense_index_is_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    got = sorted((r.k, r.idx) for r in dense_index(df, ["k"], num_partitions=5).collect())
    assert [i for _, i in got] == list(range(1000))


def test_fx12_lines(spark, tmp_dir):
    p = os.path.join(tmp_dir, "c.txt")
    with open(p, "wb") as f:
        f.write("h1\r\nb\rc\n\n d \n \n".encode("utf-8"))
    rows = [(r.idx, r.text) for r in IO.read_sentences(spark, p).orderBy("idx").collect()]
    assert rows == [(0, "h1"), (1, "b"), (2, "c"), (3, "d")]
    q = os.path.join(tmp_dir, "d.txt")
    with open(q, "w") as f:
        f.write("1\n2\n3\n\n4\n")
    al = IO.read_aligned_lines(spark, p, q).orderBy("idx").collect()
    assert al[3].source == " d " and al[3].reference == "4"
    with open(q, "a") as f:
        f.write("5\n")
    with pytest.raises(ValueError):
        IO.read_aligned_lines(spark, p, q)


def test_csv_readers_and_sinks(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pairs.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('text,translated_text,Reference_text\n"a, b","x\ny",ref1\nc,,ref2\nd,e,"  "\n')
    ev = IO.read_eval_csv(spark, p).orderBy("row_id").collect()
    assert [r.prediction for r in ev] == ["x\ny", None, "e"]
    assert IO.read_eval_csv(spark, p + ".missing") is None
    with pytest.raises(ValueError):
        IO.read_eval_csv(spark, p, reference="nope")
    pairs = IO.read_pairs_csv(spark, p, "text", "translated_text").collect()
    assert len(pairs) == 2
    out = os.path.join(tmp_dir, "stage")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert IO.read_stage(spark, out) is None
    IO.write_stage(df, out, {"last_step": "ranked", "total": 1})
    assert IO.read_stage(spark, out).count() == 1 and IO.read_progress(spark, out)["last_step"] == "ranked"
    assert IO.write_pairs(df.filter("false"), os.path.join(tmp_dir, "none")) is False
    res = os.path.join(tmp_dir, "res")
    IO.append_results(spark.createDataFrame([(1, "failed")], "experiment_id long, status string"), res)
    IO.append_results(spark.createDataFrame([(1, "completed")], "experiment_id long, status string"), res)
    assert [r.status for r in IO.read_results(spark, res).collect()] == ["completed"]


def test_param_grid_csv_and_text_sinks(spark, tmp_dir):
    from pairmine.plans import sweep as SW
    g = os.path.join(tmp_dir, "grid.csv")
    SW.grid_minimal(spark).withColumnRenamed("quality_threshold", "comet_threshold") \
        .coalesce(1).write.option("header", True).csv(g)
    got = SW.read_param_grid(spark, g, start_from=5, max_experiments=10).collect()
    assert [r.experiment_id for r in got] == list(range(5, 15)) and got[0].quality_threshold == 0.7
    q = os.path.join(tmp_dir, "q")
    df = spark.createDataFrame([("a \"b\"", "x,y", "r")], "input string, translation string, reference string")
    IO.write_quoted_csv(df, q)
    body = "".join(open(os.path.join(q, f)).read() for f in sorted(os.listdir(q)) if f.endswith(".csv"))
    assert body.splitlines()[0] == '"input","translation","reference"'
    t = os.path.join(tmp_dir, "t")
    IO.write_text_corpus(spark.createDataFrame([(" a ",), ("  ",), ("b",)], "s string"), "s", t)
    assert sorted(r.value for r in spark.read.text(t).collect()) == ["a", "b"]
    e = os.path.join(tmp_dir, "e")
    IO.write_eval(spark.createDataFrame([(0, "p", "r", 1.5)], "row_id long, prediction string, reference string, bleu double"), e)
    assert spark.read.option("header", True).csv(e).collect()[0].bleu == "1.5"


def test_encoding_keeps_rows_of_one_id_and_of_none_apart(spark):
    from pairmine.operators import trainprep as TP
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a"), (None, ""), (2, "b a b"), (2, "b a b"), (3, None)], "id long, t string")
    vocab = TP.build_vocab(df, "t")
    word = {r.token_id: r.token for r in vocab.collect()}
    got = sorted((str(r.id), " ".join(word[i] for i in r.ids)) for r in TP.encode_tokens(df, "id", "t", vocab).collect())
    assert got == [("1", "a b"), ("1", "c"), ("2", "b a b"), ("2", "b a b"), ("3", ""), ("None", ""), ("None", "a")]


def test_null_markers_are_dropped_from_pairs(spark, tmp_dir):
    import os
    path = os.path.join(tmp_dir, "p.csv")
    with open(path, "w") as f:
        f.write("idx,s,t\n0,a,b\n1,NA,b\n2,a,nan\n3,n/a,null\n4,NAN,none\n5,,b\n6,\"a,\"\"x\"\"\",b\n")
    from pairmine.sources import io as IO
    got = [(r.idx, r.s, r.t) for r in IO.read_pairs_csv(spark, path, "s", "t").orderBy("idx").collect()]
    assert got == [(0, "a", "b"), (1, "NAN", "none"), (2, 'a,"x"', "b")]


def test_causal_mask_is_the_same_in_a_task_and_written_out(spark, tmp_dir):
    rows = [(0, [2, 21, 0]), (1, [2, 5, 6, 7]), (2, [0])]
    df = spark.createDataFrame(rows, "idx long, ids array<long>")
    whole = {r.idx: r.m for r in df.select("idx", TP.causal_mask(F.col("ids")).alias("m")).collect()}
    for idx, ids in rows:
        assert whole[idx] == TP.causal_mask_array(np.array(ids)).tolist()
        assert whole[idx] == [[int(x != 0 and j <= i) for j, x in enumerate(ids)] for i in range(len(ids))]
    turns = [(c, t, ("user", "assistant")[t], " ".join("abcdefgh"[:c + t + 1])) for c in range(5) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    out = PQ.q_causal_mask(spark, tmp_dir)
    # the masks are large, the pairs small: the tasks do not follow the pairs' size
    assert out.rdd.getNumPartitions() >= 16
    got = {(r.idx, r.row): (r.ones, r.mask_md5) for r in out.collect()}
    packed = PQ._packed(spark, tmp_dir).collect()
    assert len(got) == 5 * TP.SEQ_LEN and len(packed) == 5
    for r in packed:
        for i in (0, 1, TP.SEQ_LEN - 1):
            row = [int(x != 0 and j <= i) for j, x in enumerate(r.decoder_input)]
            assert got[r.idx, i] == (sum(row), hashlib.md5(" ".join(map(str, row)).encode()).hexdigest())
