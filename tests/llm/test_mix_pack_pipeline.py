"""op7 mixing, op8 packing and the pipeline against plain Python versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pairmine.llm import mixing, packing, toxicity
from pairmine.llm.common import table
from tests.llm import util


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:       # share, stop at the limit, share the excess again
        total = sum(w[s] for s in open_)
        excess = 0.0
        for s in list(open_):
            target[s] += left * w[s] / total
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                excess += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
        left = excess
    return target


def plain_copies(doc_id, text, rate, rows=1):
    """Copies of ``rows`` rows that are alike."""
    key = f"text {hashlib.md5((text or '').encode()).hexdigest()}" if doc_id is None else str(doc_id)
    u = int(hashlib.md5(f"{key}:mix".encode()).hexdigest()[:13], 16) / (1 << 52)
    return min(math.floor(rows * rate) + (u < rows * rate - math.floor(rows * rate)), 3 * rows)


@pytest.mark.parametrize("rows", [util.EDGE, util.prose(200, 6), [], [(1, None, "x", "s", 0)],
                                  [(1, "a", None, "s1", 1), (2, "b " * 90, None, "s2", 1), (3, "c", None, "s3", 1)]])
def test_mixing_matches_the_plain_version(spark, rows):
    out = mixing.rates(util.frame(spark, rows, extra=False)).collect()
    sizes, alike = {}, {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(util.words(t))
        alike[i, s, t or ""] = alike.get((i, s, t or ""), 0) + 1
    target = plain_targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["copies"] <= 3
    expected = []
    for (i, s, t), m in alike.items():
        total = plain_copies(i, t, target[s] / sizes[s] if sizes[s] else 0, m)
        expected += [(str(i), str(s), len(util.words(t)), total // m + (k < total % m)) for k in range(m)]
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["copies"]) for r in out) == sorted(expected)
    mixed = mixing.mix(util.frame(spark, rows, extra=True))
    assert mixed.count() == sum(r["copies"] for r in out)
    assert mixed.columns == util.frame(spark, rows, extra=True).columns


def test_sources_of_null_ids_and_of_repeated_rows_come_near_their_targets(spark):
    rows = [(None, f"one two {i}", "en", "a", 1) for i in range(400)]              # no ids at all
    rows += [(7, "the very same row", "en", "b", 1)] * 400                          # one row again and again
    rows += [(None, None, "en", "c", 1)] * 3 + [(i, "word " * 30, "en", "d", 1) for i in range(100, 200)]
    df = util.frame(spark, rows)
    out = mixing.rates(df).collect()
    taken, target = {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert len(out) == len(rows)
    assert taken["a"] == pytest.approx(target["a"], rel=0.2) and taken["b"] == pytest.approx(target["b"], abs=4)
    again = mixing.rates(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = {r["source"]: r["n"] for r in mixing.mix(df).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert mixed["a"] == sum(r["copies"] for r in out if r["source"] == "a")
    assert mixed["b"] * 4 == pytest.approx(target["b"], abs=4)
    # The DuckDB query of the operator, over the same rows.
    import duckdb
    from pairmine.llm.oracle import SQL
    import pandas as pd
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})  # noqa: F841
    sql = duckdb.sql(SQL["op7_mix_sources"]).fetchall()
    got = sorted((str(r["doc_id"]), r["size"], r["size"] * r["copies"], r["source"], r["copies"]) for r in out)
    assert got == sorted((str(i), size, took, s, c) for i, size, _, _, took, s, c in sql)


def test_mixing_beyond_the_broadcast_bound_is_the_same(spark, monkeypatch):
    df = util.frame(spark, util.prose(80, 8))
    a = sorted(map(str, mixing.rates(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.rates(df).collect())) == a


def check_packing(spark, rows, capacity=1024):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack(util.frame(spark, rows, extra=True), capacity).collect()
    expected = []
    for i, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        n = -(-len(ids) // capacity)
        cuts = [0] + [len(ids) - capacity * (n - 1 - k) for k in range(n)]
        expected += [(str(i), k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(expected)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(r["length"] for r in out) // capacity) if out else 0


@pytest.mark.parametrize("rows", [util.EDGE, util.prose(150, 11), []], ids=["edge", "prose", "empty"])
def test_packing_round_trip(spark, rows):
    n, least = check_packing(spark, rows, 64)
    assert n <= 1.1 * least + 2
    check_packing(spark, rows)


def test_chunked_encoding_equals_whole_texts():
    enc = packing.ChunkEncoder(packing.tokenizer_path(), 50)
    rnd = random.Random(1)
    odd = list(" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　᠎​﻿aA'1.,é") + ["<|endoftext|>", "  ", "'s", "'ll"]
    texts = ["".join(rnd.choice(odd) if rnd.random() < 0.6 else " " for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_plan_is_complete_and_tight():
    rnd = random.Random(2)
    for capacity in (10, 100, 1024):
        for _ in range(20):
            hist = {rnd.randint(1, capacity): rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))}
            used = {}
            patterns = packing.plan(hist, capacity)
            for lengths, number in patterns:
                assert sum(lengths) <= capacity and number > 0
                for n in lengths:
                    used[n] = used.get(n, 0) + number
            assert used == hist
            large = sum(c for n, c in hist.items() if 2 * n > capacity)
            least = max(large, -(-sum(n * c for n, c in hist.items()) // capacity))
            assert sum(c for _, c in patterns) <= 1.25 * least + 2


def test_pipeline_matches_the_plain_version(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    matcher, coef = toxicity.Matcher(model.entries), np.array(model.coef)
    ok = [r for r in rows if toxicity.design(*zip(matcher.features(r[1])))[0] @ coef < 0]
    keep = {int(c) for _, _, c in util.simhash_components(ok)}
    ok = [r for r in ok if r[0] in keep]
    sizes = {}
    redacted = corpus_pipeline.redact_personal_data(spark, util.frame(spark, ok), sf)
    text = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert all(not util.pii_base(t) for t in text.values())
    for i, _, _, s, _ in ok:
        sizes[s] = sizes.get(s, 0) + len(util.words(text[i]))
    target = plain_targets(sizes)
    expected = {}
    for i, _, _, s, _ in ok:
        expected[i] = plain_copies(i, text[i], target[s] / sizes[s] if sizes[s] else 0)
    out = corpus_pipeline.run(spark, sf).collect()
    got = {i: 0 for i in expected}
    for r in out:
        got[r["doc_id"]] += r["piece"] == 0
    assert got == expected


def test_pipeline_stages_take_edge_rows_and_empty_tables(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    for rows in (util.EDGE, []):
        df = util.frame(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
                assert out.count() <= 3 * len(rows)
            else:
                assert out.count() >= len(rows)
