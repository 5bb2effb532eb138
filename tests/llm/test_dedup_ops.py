"""op1 SimHash near-dedup and op10 substring dedup against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmine.llm import simhash, substring
from tests.llm import util


@pytest.mark.parametrize("rows", [util.EDGE, util.prose(120, 1), []], ids=["edge", "prose", "empty"])
def test_simhash_matches_brute_force(spark, rows):
    out = simhash.near_duplicates(util.frame(spark, rows, extra=True))
    assert util.got(out, "doc_id", "fingerprint", "component_id") == util.simhash_components(rows)


def test_every_grid_and_block_size_finds_the_same_links(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:      # chains and clouds of near fingerprints
        for _ in range(6):
            for bit in rnd.sample(range(64), rnd.randint(0, 4)):
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")

    def classes(links):
        parent = list(range(len(fps)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in links:
            assert bin(fps[a] ^ fps[b]).count("1") <= 64
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]

    expected = classes([(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    for cell_rows in (3, 8192):      # tiny blocks: every large cell is dealt out
        found = [(r["a"], r["b"]) for r in simhash.links(df, 4, cell_rows).collect()]
        assert classes(found) == expected


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2 ** 63, 500, dtype=np.uint64) for _ in range(2))
    lower = np.bitwise_count(simhash.segment_counts(a) ^ simhash.segment_counts(b))
    assert (lower <= np.bitwise_count(a ^ b)).all()
    for n in (10, 10 ** 5, 10 ** 8, 10 ** 11):      # any r flips leave the counts of one choice of groups alone
        masks = simhash.cell_masks(n, 4)
        flips = rng.permutation(64)[:4]
        hit = 0
        for f in flips:
            hit |= 3 << (int(f) // 2 * 2)
        assert any(m & hit == 0 for m in masks)


def test_keep_one_never_keeps_a_copy_for_another_text(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdefgh"]
    rows = []
    for n, t in enumerate(texts):
        own = " ".join(f"own{n}x{i}" for i in range(60))      # id 100 + n has this text and, before it, a copy of n's
        rows += [(n, t, "en", "s", 1), (100 + n, t, "en", "s", 1), (100 + n, own, "en", "t", 2), (100 + n, own, "en", "s", 1)]
    kept = sorted(tuple(r) for r in simhash.keep_one(util.frame(spark, rows)).collect())
    assert kept == sorted(rows[0::4] + rows[3::4])


def test_keep_one_keeps_one_of_each_group(spark):
    rows = util.prose(60, 9) + util.EDGE
    # Two unrelated texts under one id, a third one elsewhere, and a near copy of one of them.
    far = [" ".join(f"{w}{i}" for i in range(60)) for w in "xyz"]
    rows += [(5000, far[0], "en", "s", 1), (5000, far[1], "en", "s", 1), (5001, far[2], "en", "s", 1), (5002, far[1], "en", "s", 1)]
    out = simhash.keep_one(util.frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # Plain version: groups of fingerprints, the smallest (id, text hash) of each.
    fps = [util.simhash(r[1]) for r in rows]
    with_id = [i for i, r in enumerate(rows) if r[0] is not None]
    groups = []
    for i in with_id:
        near = [g for g in groups if any(bin(fps[i] ^ fps[j]).count("1") <= 4 for j in g)]
        groups = [g for g in groups if g not in near] + [[i] + [j for g in near for j in g]]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    assert len(got) == len(groups) + sum(r[0] is None for r in rows)
    for g in groups:
        low = min(rows[i][0] for i in g)
        texts = {rows[i][1] or "" for i in g if rows[i][0] == low}
        assert sum((str(low), t) in got for t in texts) == 1
    assert {t for i, t in got if i in ("5000", "5001", "5002")} == set(far)


@pytest.mark.parametrize("rows", [util.EDGE[:-1], util.prose(150, 2), []], ids=["edge", "prose", "empty"])
def test_substring_dedup_matches_brute_force(spark, rows):
    out = substring.dedup(util.frame(spark, rows, extra=True))
    assert util.got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == util.substring_dedup(rows)


def test_substring_dedup_of_sliced_and_hot_texts(spark, monkeypatch):
    rnd = random.Random(4)
    unit = "the same old line again. "
    rows = [(i, (unit * rnd.randint(0, 5) + "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 90)))) * 3)
            for i in range(60)]
    rows = [(i, t, None, None, None) for i, t in rows]
    monkeypatch.setattr(substring, "SLICE", 64)      # long texts in many slices
    monkeypatch.setattr(substring, "FLUSH", 500)     # many sendings
    monkeypatch.setattr(substring, "HOT_BUCKETS", 0.05)
    out = substring.dedup(util.frame(spark, rows))
    assert util.got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == util.substring_dedup(rows)


def test_substring_dedup_returns_the_kept_text(spark):
    passage = "this passage is longer than fifty bytes and is repeated by the second document."
    rows = [(1, "first " + passage, None, None, None), (2, passage + " second", None, None, None)]
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in substring.dedup(util.frame(spark, rows), with_text=True).collect()}
    assert kept == {1: "first " + passage, 2: " second"}


def test_samples_take_as_little_room_in_many_buckets_as_in_few():
    """A bucket that gets few samples of a task does not make each of them larger."""
    rnd = np.random.default_rng(3)
    n, docs = 40_000, 500
    h, c = (rnd.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) for _ in range(2))
    doc = np.sort(rnd.integers(0, docs, n))
    around = rnd.integers(1, 1 << 16, (2, n)).astype(np.uint64)
    lo, length = rnd.integers(0, 8000, n), rnd.integers(1, 32, n)
    for buckets in (8, 256, 2048):
        box = substring._Outbox(buckets, 16)
        for i in range(docs):
            box.doc(10_000 + i, 0)
        box.add(h, c, doc, *around, lo, length)
        sent = list(box.flush())
        assert sum(len(blob) for *_, blob in sent) < 26 * n
        x = substring._SAMPLES.unpack([blob for *_, blob in sent])
        got = sorted(zip((x["h"] * buckets + np.repeat([b for b, *_ in sent], [len(substring._SAMPLES.unpack([z])["h"]) for *_, z in sent])).tolist(),
                         x["c"].tolist(), x["id"].tolist(), x["lo"].tolist(), x["n"].tolist(), x["left"].tolist(), x["right"].tolist()))
        want = sorted(zip((h >> np.uint64(16)).tolist(), (c >> np.uint64(16)).tolist(), (10_000 + doc).tolist(), lo.tolist(),
                          length.tolist(), *around.tolist()))
        assert got == want


def test_runs_and_documents_are_dealt_to_the_same_parts(spark):
    rows = [(i * i - 50, k) for i in range(40) for k in (0, -(1 << 60) + i, (1 << 62) + i)]
    df = spark.createDataFrame(rows, "doc_id long, key long")
    want = [r[0] for r in df.select(F.expr("pmod(xxhash64(doc_id, key), 37)")).collect()]
    assert substring.doc_part(*np.array(rows, np.int64).T, 37).tolist() == want


@pytest.mark.parametrize("most", [0, 100_000])
def test_substring_dedup_of_ids_that_several_texts_share(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "SHARED_IDS", most)
    rnd = random.Random(8)
    part = ["".join(rnd.choice("abcdefgh ") for _ in range(90)) for _ in range(6)]
    rows = [(rnd.choice([1, 2, 3, 4, -7, 1 << 40, None]), "".join(rnd.choice(part) for _ in range(rnd.randint(0, 4))),
             None, None, None) for _ in range(80)]
    out = substring.dedup(util.frame(spark, rows))
    assert util.got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == util.substring_dedup(rows)


def test_shuffles_of_a_stage_leave_the_disk(spark):
    from pairmine.llm.common import DROP_SHUFFLES, staged

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for x in blocks.mkString("|").split("|") if x.startswith("shuffle_")}

    before = shuffles()
    default = spark.conf.get(DROP_SHUFFLES)
    out = staged(spark.range(1000).repartition(7, "id"), "test", drop_shuffles=True)
    time.sleep(1)
    assert not shuffles() - before and spark.conf.get(DROP_SHUFFLES) == default
    assert out.count() == 1000
