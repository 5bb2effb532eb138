"""op11 periodic runs, op12 vector codes and op13 byte-level BPE against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from pairmine.llm import bpe, runs, vector_codes
from pairmine.llm.common import table
from tests.llm import util

SF = "/root/testdata/sf0.001"


# ---- op11

def plain_runs(w, min_length=12):
    """Every maximal stretch of words that agree q apart, for every q; the smallest q of a stretch."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_planted(doc_id, text):
    w = util.words(text)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_digest(doc_id, text):
    w = plain_planted(doc_id, text)
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return (str(doc_id), len(found), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


RUN_COLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def order(rows):
    return sorted(rows, key=str)


def periodic(n_docs, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n_docs):
        w = [str(rnd.randrange(rnd.choice([1, 2, 3, 40]))) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 2)):
            if w:
                a, p = rnd.randrange(len(w)), rnd.randint(1, 9)
                z = min(len(w), a + rnd.randint(p, 8 * p))
                for j in range(a + p, z):
                    w[j] = w[j - p]
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(w), "en", "a", 0))
    return out


@pytest.mark.parametrize("rows", [[r for r in util.EDGE if r[0] != 12], periodic(300, 4), util.prose(60, 3), []],
                         ids=["edge", "periodic", "prose", "empty"])
def test_runs_match_brute_force(spark, rows):
    df = util.frame(spark, rows, extra=True)
    got = order(tuple(str(r[c]) if c == "doc_id" else r[c] for c in RUN_COLS) for r in
                runs.digests(runs.find_runs(runs.with_planted_runs(df), block_words=500)).collect())
    assert got == order(plain_digest(r[0], r[1]) for r in rows)


def test_runs_of_random_words_of_any_least_length():
    rnd = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            k = rnd.choice([1, 2, 3, 30])
            docs.append([rnd.randrange(k) for _ in range(rnd.randint(0, 60))])
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        m = rnd.choice([2, 5, 12])
        s, n, q = runs.runs_of(np.array(sum(docs, []), np.int64), bounds, m)
        assert list(zip(s.tolist(), n.tolist(), q.tolist())) == sorted(
            (a + int(bounds[k]), x, p) for k, d in enumerate(docs) for a, x, p in plain_runs(d, m))


def test_long_texts_of_one_word_and_of_one_period(spark):
    rows = [(1, "word " * 200_000, "en", "a", 0), (2, " ".join(map(str, range(50_000))) + " " + " ".join(map(str, range(50_000))), "en", "a", 0)]
    out = {r["doc_id"]: r for r in runs.find_runs(util.frame(spark, rows)).collect()}
    assert [tuple(x) for x in out[1]["runs"]] == [(0, 200_000, 1)] and bytes(out[1]["collapsed"]) == b"word"
    assert [tuple(x) for x in out[2]["runs"]] == [(0, 100_000, 50_000)]


# ---- op12

def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    books = [[v[p * width:(p + 1) * width] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, _, v in kept:
                part = v[p * width:(p + 1) * width]
                mine.setdefault(near(part, books[p])[1], []).append(part)
            for k, group in mine.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, lab, v in kept:
        best = [near(v[p * width:(p + 1) * width], books[p]) for p in range(parts)]
        coded.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = {}
    for _, lab, _, e in coded:
        total[lab] = total.get(lab, 0) + e
    return order((i, c, e, total[lab], sha) for i, lab, c, e in coded)


VEC = "vec_id long, embedding array<float>, label int"


def got_codes(df):
    return order(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect())


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(scale=0.2, size=(n, dim)), 2)
    x[n // 2:n // 2 + n // 3] = x[0]                 # a third of the rows are one vector
    return [(int(i), [float(np.float32(c)) for c in v], [None, 0, 1][i % 3] if i % 2 else 1) for i, v in zip(rng.permutation(n), x)]


ODD = [(1, None, 0), (2, [], 1), (3, [0.5] * 15 + [None], 0), (4, [float("nan")] * 16, 1), (5, [float("inf")] * 16, 1),
       (9, [0.0] * 16, None), (9, [-0.001] * 16, 0), (9, [0.25] * 16, 0), (None, [0.5] * 16, 0), (9, [0.25] * 16, 0)]


@pytest.mark.parametrize("rows", [vectors(300, 64, 1), vectors(90, 16, 2), ODD], ids=["64", "16", "odd"])
def test_codes_match_the_plain_version(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, VEC).repartition(3)
    for c in ("v", "code", "error", "label_error", "n", "part"):
        df = df.withColumn(c, F.lit("x"))
    assert got_codes(vector_codes.compress(df)) == plain_codes(rows)


def test_codes_of_lengths_that_do_not_divide_and_of_other_lengths(spark):
    rows = [(i, [0.1 * i, 0.2, 0.3], i % 2) for i in range(5)] + [(9, [0.5, 0.5], 0)]
    filled = [(i, v + [0.0] * 13, lab) for i, v, lab in rows[:5]]
    out = vector_codes.compress(spark.createDataFrame(rows, VEC)).collect()
    assert sorted(tuple(r)[:4] for r in out) == [x[:4] for x in plain_codes(filled)]
    assert vector_codes.compress(spark.createDataFrame([], VEC)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, None)], VEC)).count() == 0
    far = vector_codes.compress(spark.createDataFrame([(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0)], VEC)).collect()
    assert all(r["error"] >= 0 for r in far)


def test_trie_and_matrix_give_the_same_nearest_entries():
    rng = np.random.default_rng(5)
    for width, high in ((1, 4), (3, 3), (4, 200), (8, 2)):
        rows = rng.integers(-high, high, size=(5000, width))
        leaves, back, weight = vector_codes.distinct_rows(rows)
        assert (leaves[back] == rows).all() and weight.sum() == len(rows)
        book = rng.integers(-high, high, size=(64, width))
        full = ((leaves[:, None, :] - book[None]) ** 2).sum(2)
        for subtree in (1, 7, 100_000):
            near, dist = vector_codes.nearest_by_trie(leaves, book, subtree)
            assert (near == full.argmin(1)).all() and (dist == full.min(1)).all()


# ---- op13

def reference():
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.ranks_path()),
                             special_tokens={})


def plain_bpe(rows):
    enc = reference()
    out = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return order(out)


BPE_COLS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.mark.parametrize("rows", [util.EDGE + [(20, "x" * 70_000 + " <|endoftext|> it's  \n  end", "en", "a", 0)],
                                  util.prose(120, 9), []], ids=["edge", "prose", "empty"])
def test_bpe_matches_the_library(spark, rows):
    out = bpe.digests(bpe.decode(bpe.encode(util.frame(spark, rows, extra=True), block_chars=3000)))
    assert order(tuple(str(r[c]) if c == "doc_id" else r[c] for c in BPE_COLS) for r in out.collect()) == plain_bpe(rows)


def test_bpe_of_the_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    out = bpe.digests(bpe.encode(docs, with_decoded=True)).collect()
    assert order(tuple(str(r[c]) if c == "doc_id" else r[c] for c in BPE_COLS) for r in out) == plain_bpe(rows)


def test_replay_of_odd_words_and_of_ranks_that_fall():
    import regex
    enc, ranks, find = reference(), bpe.Merges(bpe.load_ranks(bpe.ranks_path())), regex.compile(bpe.word_pattern()).findall
    rnd = random.Random(1)
    alpha = list("abcdeehilnorst ABC'.,!?0129\n\t  é ßü中漢😀́​\x1c\x85 ") + ["the", " the", "ing", "'s", "'LL"]
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000]
    found = [[w.encode() for w in find(t)] for t in texts]
    flat = iter(bpe.replay([w for f in found for w in f], ranks))
    for t, f in zip(texts, found):
        assert [x for _ in f for x in next(flat)] == enc.encode_ordinary(t)
    encoder = bpe.Encoder(bpe.ranks_path(), bpe.word_pattern(), cache_words=10)     # forgets all the time
    for t in texts[:300]:
        assert np.frombuffer(encoder.encode([t, None])[0], np.int32).tolist() == enc.encode_ordinary(t)
    # A table in which a merge makes a pair of a lower rank than its own.
    import tiktoken
    odd = {bytes([b]): 100 + b for b in range(256)} | {b"bc": 5, b"ab": 4, b"abab": 1, b"aa": 3, b"aab": 2, b"ca": 0}
    plain = tiktoken.Encoding("odd", pat_str=r"[\s\S]+", mergeable_ranks=odd, special_tokens={})
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    for w, got in zip(words, bpe.replay([w.encode() for w in words], bpe.Merges(odd))):
        assert got == plain.encode_ordinary(w)


def test_short_words_are_replayed_together_and_ids_decoded_together(monkeypatch):
    """Neither words nor ids are gone through one at a time (op13's seconds a GB)."""
    ranks = bpe.Merges(bpe.load_ranks(bpe.ranks_path()))
    rnd = random.Random(2)
    words = [("".join(rnd.choice("abcdeéßü") for _ in range(rnd.randint(2, 16)))).encode() for _ in range(9000)]
    words += [b"x" * n + b"q" for n in (bpe.SHORT - 2, bpe.SHORT - 1, bpe.SHORT, 500)] + [b"", b"the"]
    assert bpe.replay(words, ranks) == [x for w in words for x in ([] if not w else bpe.replay_index([w], ranks) if w not in ranks.ranks else [[ranks.ranks[w]]]) or [[]]]
    rounds, real = [], bpe.Merges.rank_of
    monkeypatch.setattr(bpe.Merges, "rank_of", lambda self, a, b: rounds.append(len(a)) or real(self, a, b))
    monkeypatch.setattr(bpe, "replay_index", lambda *_: 1 / 0)
    bpe.replay([w for w in words if len(w) <= bpe.SHORT], ranks)
    assert len(rounds) < 400 and sum(rounds) > 9000
    decoder = bpe.Decoder(bpe.ranks_path())
    ids = [ranks.ranks[b] for b in (b"the", b" the", b"a")]
    monkeypatch.setattr(bpe, "DECODE_IDS", 2)
    assert decoder.column(np.array(ids, np.int32), np.array([0, 0, 2, 3, 3])).to_pylist() == [b"", b"the the", b"a", b""]
    assert decoder.column(np.zeros(0, np.int32), np.array([0, 0])).to_pylist() == [b""]
    with pytest.raises(KeyError):
        decoder.decode(np.array([10 ** 7]))
