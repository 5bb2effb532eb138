"""Periodic runs of words: branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and
length >= max(min_length, 2 q) that no neighbouring word extends keeping period q.

The suffixes of many documents are sorted together, words of different documents counting as
different, so every document's suffixes are a stretch of the array of their own:

1. Suffix array by prefix doubling: groups of suffixes that agree on 1, 2, 4, ... words are
   refined until all are told apart; only groups of two or more are sorted again. The rank
   tables of all levels are kept: equal ranks at level k mean equal stretches of 2^k words,
   so a longest common extension, to the right or to the left, takes one look per level.
2. The LCP array gives the LCP intervals by previous and next smaller values; no tree is
   built. For an interval of depth d every suffix i outside its largest child tests whether
   i + d and i - d are in the interval (by the inverse suffix array). If so, and the word
   after the pair differs, a square of period d ends there: a branching tandem repeat.
3. A square is rotated to the left as far as its period holds, in one common extension; what
   comes out is the run, once per period. Multiples of the smallest period give the same
   stretch, of which the smallest is kept.

A run of length L has a pair of suffixes with an LCP of L - q >= min_length / 2 words:
documents without such an LCP have no run and are left after the LCP array.

Everything happens inside the task that reads the texts; nothing is shuffled, whole texts are
used. Memory follows the words handled together (``BLOCK_WORDS``, or one longer document):
about 4 bytes a word and level, with as many levels as the longest repeat has binary digits.

Edge cases: null and empty texts have no words and no runs; a null doc_id is carried along;
repeated rows give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import SPACE

MIN_LENGTH = 12
BLOCK_WORDS = 400_000      # words of the documents that are sorted together
TEST_SLOTS = 1 << 20       # suffixes tested in one go


def suffix_ranks(code: np.ndarray, end: np.ndarray):
    """(suffix array, rank tables by level) of ``code``; ``end[i]`` is the end of i's document.

    The last table is the inverse suffix array. Tables have one more element (-1)."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    new = np.ones(n, bool)
    new[1:] = code[order[1:]] != code[order[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(first, size)
    tables = [rank.astype(np.int32)]
    open_ = np.flatnonzero(np.repeat(size, size) > 1)
    step = 1
    while open_.size:
        pos = order[open_]
        ahead = pos + step
        key = rank[pos] * (n + 1) + np.where(ahead < end[pos], rank[np.minimum(ahead, n)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, pos = key[by], pos[by]
        order[open_] = pos
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[pos] = np.repeat(open_[first], size)
        tables.append(rank.astype(np.int32))
        open_ = open_[np.repeat(size, size) > 1]
        step *= 2
    return order, tables


def common_right(tables, a, b):
    """Number of words that agree from a and b (a < b, one document) on to the right."""
    a, b = a.copy(), b.copy()
    got = np.zeros(len(a), np.int64)
    for k in range(len(tables) - 2, -1, -1):
        same = (tables[k][a] == tables[k][b]).astype(np.int64) << k
        got += same
        a += same
        b += same
    return got


def common_left(tables, a, b, begin):
    """Number of words that agree before a and b (a < b, one document that begins at ``begin``)."""
    a, b = a.copy(), b.copy()
    got = np.zeros(len(a), np.int64)
    for k in range(len(tables) - 2, -1, -1):
        w = 1 << k
        same = (a - w >= begin) & (tables[k][np.maximum(a - w, 0)] == tables[k][np.maximum(b - w, 0)])
        same = same.astype(np.int64) << k
        got += same
        a -= same
        b -= same
    return got


def lcp_intervals(lcp: list[int]):
    """Bounds (lo, hi) of the LCP interval that each boundary x (between slots x - 1 and x)
    splits: lcp[lo] and lcp[hi] are the nearest smaller values. lcp[0] must be -1."""
    n = len(lcp)
    lo, hi = [0] * n, [n] * n
    open_ = []
    for x, v in enumerate(lcp):
        while open_ and lcp[open_[-1]] > v:
            hi[open_.pop()] = x
        if open_:
            top = open_[-1]
            lo[x] = lo[top] if lcp[top] == v else top
        open_.append(x)
    return lo, hi


def branching_squares(order, isa, lcp, code, end, begin):
    """(i, d): squares of period d at i whose next word breaks the period. ``lcp[x]`` is that
    of the slots x - 1 and x, -1 at the first slot of a document that is to be searched."""
    lo, hi = (np.array(x, np.int64) for x in lcp_intervals(lcp.tolist()))
    xs = np.flatnonzero(lcp > 0)
    xs = xs[np.lexsort((xs, hi[xs], lo[xs]))]      # the boundaries of one interval together
    if not len(xs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(xs), bool)
    new[1:] = (lo[xs[1:]] != lo[xs[:-1]]) | (hi[xs[1:]] != hi[xs[:-1]])
    at = np.flatnonzero(new)
    group_lo, group_hi, depth = lo[xs[at]], hi[xs[at]], lcp[xs[at]].astype(np.int64)
    # Children: the stretches between the interval's bounds and its boundaries.
    child_lo = np.insert(xs, at, group_lo)
    child_hi = np.insert(xs, np.append(at[1:], len(xs)), group_hi)
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(xs))) + 1)
    size = child_hi - child_lo
    by = np.lexsort((size, group))
    small = np.ones(len(group), bool)
    small[by[np.append(group[by][1:] != group[by][:-1], True)]] = False      # the largest of each
    child_lo, size, group = child_lo[small], size[small], group[small]
    found_i, found_d = [], []
    upto = np.cumsum(size)
    cut = 0
    while cut < len(size):
        nxt = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + TEST_SLOTS, side="right")))
        s, g = size[cut:nxt], np.repeat(group[cut:nxt], size[cut:nxt])
        slot = np.repeat(child_lo[cut:nxt] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        i, d = order[slot], depth[g]
        for first, second, inside in ((i, i + d, i + d < end[i]), (i - d, i, i - d >= begin[i])):
            other = isa[np.where(inside, np.where(second == i, first, second), 0)]
            hit = inside & (other >= group_lo[g]) & (other < group_hi[g])
            a, p = first[hit], d[hit]
            after = a + 2 * p
            breaks = (after >= end[a]) | (code[np.minimum(after, len(code) - 1)] != code[a + p])
            found_i.append(a[breaks])
            found_d.append(p[breaks])
        cut = nxt
    return np.concatenate(found_i), np.concatenate(found_d)


def runs_of(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH):
    """(start, length, period), sorted by start and period, of the runs in ``words`` (numbers);
    document k is words[bounds[k]:bounds[k + 1]]. Starts count from the first of all words."""
    n = len(words)
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if not n:
        return none
    sizes = np.diff(bounds)
    begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    # Words of different documents never agree, and a document's suffixes stay together.
    code = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1) + words
    order, tables = suffix_ranks(code, end)
    lcp = np.zeros(n, np.int64)
    a, b = np.minimum(order[1:], order[:-1]), np.maximum(order[1:], order[:-1])
    mates = np.flatnonzero(begin[a] == begin[b])
    lcp[1 + mates] = common_right(tables, a[mates], b[mates])
    filled = bounds[:-1][sizes > 0]
    deep = filled[np.maximum.reduceat(lcp, filled) >= (min_length + 1) // 2]
    if not len(deep):
        return none
    keep = np.isin(begin, deep)        # slots of a document are its words' numbers
    slots = np.flatnonzero(keep)
    lcp[filled] = -1
    # The kept documents' slots, numbered on: bounds of intervals stay inside a document.
    isa = np.full(n, -1, np.int64)
    isa[order[slots]] = np.arange(len(slots))
    i, d = branching_squares(order[slots], isa, lcp[slots], code, end, begin)
    start = i - common_left(tables, i, i + d, begin[i])
    length = i + 2 * d - start
    long = length >= min_length
    start, length, period = start[long], length[long], d[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(start), bool)     # of one stretch, the smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    ``runs`` are sorted by start and period; ``collapsed`` (binary, UTF-8) is the text without the words
    that a run holds after its first period, the others joined by one space."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def settle(ids, texts):
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        number = defaultdict()
        number.default_factory = number.__len__
        flat = np.fromiter((number[w] for t in texts for w in t), np.int64, int(bounds[-1]))
        start, length, period = runs_of(flat, bounds, min_length)
        # Words after a run's first period: +1 where a dropped stretch begins, -1 where it ends.
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        first = np.searchsorted(start, bounds)
        local = start - np.repeat(bounds[:-1], np.diff(first))
        values = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)],
                                            fields=list(run_type.value_type))
        collapsed = [b" ".join(t if first[k] == first[k + 1] else compress(t, kept[bounds[k]:bounds[k + 1]]))
                     for k, t in enumerate(texts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)),
             pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values).cast(run_type),
             pa.array(collapsed, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or b"").split())      # splits at the six ASCII white-space bytes
                held += len(texts[-1])
                if held >= block_words:
                    yield settle(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield settle(ids, texts)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about one document in ten made periodic from some word on.

    With h = crc32 of the decimal id, g = h div 10 and n words: where h mod 10 = 0, word
    i >= a becomes word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8);
    words are then joined by one space. Other texts, and rows without an id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", SPACE), lambda w: w != "")))
    n, g = F.size("words").cast("long"), F.expr("h div 10")
    d = d.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    d = d.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)")).withColumn("a", F.col("a").cast("int"))
    text = F.expr("array_join(concat(slice(words, 1, a), transform(sequence(a, cast(n as int) - 1), "
                  "i -> element_at(words, a + (i - a) % p + 1))), ' ')")
    return d.select("doc_id", F.when(F.col("p").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The result of ``find_runs`` with its longest run and hashes of the lists."""
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN CAST(sign(y.length - x.length) AS INT) "
                  "WHEN x.start <> y.start THEN CAST(sign(x.start - y.start) AS INT) "
                  "ELSE CAST(sign(x.period - y.period) AS INT) END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                                                F.lit("\n"))), "")
    out = found.withColumn("best", F.get(best, F.lit(0)))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                      F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                      F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
