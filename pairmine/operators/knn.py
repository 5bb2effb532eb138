"""Exact top-k vector join (J1 knn_inner_product, J2 knn_l2, J3 candidate_union,
J5 self_knn_density neighbours, T1 topk_per_source).

Plan (blocked matrix product, no index object):

* Both sides are hashed into blocks: ``sb = xxhash64(id) mod n_sb`` and
  ``tb = xxhash64(id) mod n_tb``. A block holds at most about ``BLOCK_BYTES`` of vectors;
  beyond that the grid has a few block pairs per core, shaped so that the bytes sent (each
  source to n_tb blocks, which all send lists back, each target to n_sb) are fewest.
  ``cogroup`` on ``(sb, tb)`` brings one source and one target block together in one task.
* In the task the product is computed in tiles of at most ``TILE_PAIRS`` pairs and the k
  best targets per source (ties: similarity, then the smaller target id) are kept as the
  tiles go by, so memory follows the blocks and the tile, not their product. A single-precision
  product with a proven error bound passes over the pairs that cannot enter a list; the others
  are computed in double precision. A task emits at most ``2k`` rows per source; pairs are
  never materialised.
* With several target blocks each of the two lists is cut to k per source by a
  ``row_number`` window of its own over one exchange by source, so that the blocks are computed
  once. The true top-k of a source is always among the rows of its blocks.

A NULL vector, one of another length than most targets, and one with a component that is null or
not finite (it has no finite similarity) takes no part. A pair whose similarity is not finite is never a candidate,
and does not cost its source the finite ones. Work is O(S*T*d) as for any exact flat
search. Similarities are rounded to 9 decimals before ranking, so that tile shapes (BLAS
summation order) and duplicate vectors cannot change the order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.functions.scalar import SIM_DECIMALS
from pairmine.session import default_parallelism

# Byte budget of one block of vectors (FLOAT64 in the task).
BLOCK_BYTES = 64 * 1024 * 1024
# Pairs of one tile of the product: all its temporaries take about 50 bytes a pair.
TILE_PAIRS = 2 * 1024 * 1024
# A block pair below this many pairs is not worth a task of its own.
MIN_TASK_PAIRS = 2 * 1024 * 1024
# Pairs of a tile that are computed one by one, at once; with more than one in DENSE of a tile the
# whole tile is computed.
PAIRS_AT_ONCE = 1 << 16
DENSE = 16
# Squared lengths up to this can be multiplied in single precision.
MAX_SINGLE = 1e30
# Bytes of one row of a list on its way to the merge, about.
RESULT_BYTES = 48
# Block pairs per core; partitions that they are dealt to, per block pair (few share one).
TASKS_PER_CORE, ROOM = 2, 4

KNN_SCHEMA = ("src_idx long, tgt_idx long, dot double, sqd double, "
              "ip_rank int, l2_rank int")


def _select_topk(key: np.ndarray, tid: np.ndarray, k: int, ascending: bool):
    """Per row of ``key`` (n_s x n_t) the k best finite columns: (rows, cols, ranks 1..k).

    Order: key (desc unless ascending), then target id ascending. Ties at the
    k-th value are all considered before the id decides.
    """
    n_s, n_t = key.shape
    kk = min(k, n_t)
    if kk <= 0 or n_s == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    signed = np.where(np.isfinite(key), key if ascending else -key, np.inf)
    keep = np.isfinite(signed)
    if kk < n_t:
        thr = np.partition(signed, kk - 1, axis=1)[:, kk - 1]
        keep &= signed <= thr[:, None]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((tid[cols], signed[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(n_s))
    pos = np.arange(len(rows)) - starts[rows]
    keep = pos < kk
    return rows[keep], cols[keep], (pos[keep] + 1)


class _Best:
    """The k best (row, target) pairs per source row over the tiles seen so far.

    Targets come in ascending order of their ids, so a pair that only equals a full list's last
    one cannot enter it: ``limit`` is what a pair has to exceed. A row of the matrices holds a
    source's pairs in the order they came, with room for as many new ones; when it is full, the
    k best stay (of equal ones the first), and only the last list is put in order."""

    def __init__(self, n_rows: int, k: int, ascending: bool):
        self.n_rows, self.k, self.ascending = n_rows, k, ascending
        self.limit = np.full(n_rows, -np.inf)
        self.fill = np.zeros(n_rows, np.int64)
        self.value_of = np.full((n_rows, 2 * k), -np.inf)
        self.other, self.col = np.zeros((n_rows, 2 * k)), np.zeros((n_rows, 2 * k), np.int64)

    def value(self, dot, sqd):
        return -sqd if self.ascending else dot

    def add(self, rows, cols, dot, sqd):
        """Pairs in ascending order of their row and, as far as they tie, of their target."""
        value = self.value(dot, sqd)
        with np.errstate(invalid="ignore"):
            keep = np.isfinite(value) & (value > self.limit[rows])
        if not keep.any():
            return
        rows, cols, value, other = rows[keep], cols[keep], value[keep], (dot if self.ascending else sqd)[keep]
        count = np.bincount(rows, minlength=self.n_rows)
        if (self.fill + count).max() > self.value_of.shape[1]:
            self.settle()
            more = (self.fill + count).max() - self.value_of.shape[1]
            if more > 0:
                self.value_of = np.pad(self.value_of, ((0, 0), (0, more)), constant_values=-np.inf)
                self.other, self.col = (np.pad(x, ((0, 0), (0, more))) for x in (self.other, self.col))
        at = self.fill[rows] + np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
        self.value_of[rows, at], self.other[rows, at], self.col[rows, at] = value, other, cols
        self.fill += count
        # New limits are worth their cost once lists fill up for the first time.
        if ((self.fill >= self.k) & (self.limit == -np.inf)).any():
            self.settle()

    def settle(self):
        k, wide = self.k, int(self.fill.max(initial=0))
        full = np.flatnonzero(self.fill >= k)
        if not len(full):
            return
        value = self.value_of[full, :wide]
        last = value.min(axis=1) if wide == k else np.partition(value, wide - k, axis=1)[:, wide - k]
        self.limit[full] = last
        over = self.fill[full] > k
        full, value, last = full[over], value[over], last[over, None]
        if not len(full):
            return
        above, equal = value > last, value == last
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (equal & (np.cumsum(equal, axis=1) <= room))
        for x, empty in ((self.value_of, -np.inf), (self.other, 0), (self.col, 0)):
            kept = x[full, :wide][keep].reshape(len(full), k)
            x[full] = empty
            x[full, :k] = kept
        self.fill[full] = k

    def lists(self):
        """((rows, cols, dot, sqd), ranks), row by row and best first."""
        self.settle()
        wide = int(self.fill.max(initial=0))
        order = np.argsort(-self.value_of[:, :wide], axis=1, kind="stable")
        rows, rank = np.nonzero(np.arange(wide) < self.fill[:, None])
        at = (rows, order[rows, rank])
        value, other = self.value_of[at], self.other[at]
        return (rows, self.col[at], *((other, -value) if self.ascending else (value, other))), rank + 1


def _both_lists(sid, tid, lists: dict) -> pd.DataFrame:
    """One row per pair of the given lists (rank column -> (rows, cols, dot, sqd), ranks)."""
    if len(lists) == 2 and len(np.unique(tid)) == len(tid) and len(np.unique(sid)) == len(sid):
        keys = [rows * len(tid) + cols for (rows, cols, _, _), _ in lists.values()]
        every = np.unique(np.concatenate(keys))
        dot, sqd = np.empty(len(every)), np.empty(len(every))
        part = pd.DataFrame({"src_idx": sid[every // len(tid)], "tgt_idx": tid[every % len(tid)], "dot": dot, "sqd": sqd})
        for key, (name, ((_, _, d, q), rank)) in zip(keys, lists.items()):
            at = np.searchsorted(every, key)
            dot[at], sqd[at] = d, q
            ranks, missing = np.zeros(len(every), np.int32), np.ones(len(every), bool)
            ranks[at], missing[at] = rank, False
            part[name] = pd.arrays.IntegerArray(ranks, missing)
        part["dot"], part["sqd"] = dot, sqd
        return part
    part = None             # ids that repeat meet each other's ranks
    for name, ((rows, cols, d, q), rank) in lists.items():
        f = pd.DataFrame({"src_idx": sid[rows], "tgt_idx": tid[cols], "dot": d, "sqd": q,
                          name: pd.array(rank, dtype="Int32")})
        part = f if part is None else part.merge(f, on=["src_idx", "tgt_idx", "dot", "sqd"], how="outer")
    for name in ("ip_rank", "l2_rank"):
        if name not in part:
            part[name] = pd.array([None] * len(part), dtype="Int32")
    return part


def block_topk(sid, S, tid, T, k: int, want_ip: bool, want_l2: bool) -> pd.DataFrame:
    """Top-k lists of one source block against one target block, tile by tile.

    A tile's product is taken in single precision first. Its error is bounded by the vectors'
    lengths; a pair that cannot reach its source's list even so is passed over, and the others are
    computed in double precision, so the lists are those of double precision throughout. (Lengths
    that single precision cannot hold are multiplied in double precision from the start.)"""
    fine = np.isfinite(S).all(axis=1)
    sid, S = sid[fine], S[fine]
    fine = np.isfinite(T).all(axis=1)
    tid, T = tid[fine], T[fine]
    cols = ["src_idx", "tgt_idx", "dot", "sqd", "ip_rank", "l2_rank"]
    if not len(sid) or not len(tid) or k <= 0:
        return pd.DataFrame({c: [] for c in cols})
    by = np.argsort(tid, kind="stable")
    tid, T = tid[by], T[by]
    with np.errstate(over="ignore"):
        s_sq, t_sq = (S * S).sum(axis=1), (T * T).sum(axis=1)
        s_len, t_len = np.sqrt(s_sq), np.sqrt(t_sq.max())
        rough = np.float32 if max(s_sq.max(), t_sq.max()) < MAX_SINGLE else np.float64
        unit = (S.shape[1] + 8) * np.finfo(rough).eps
        slack = {"ip_rank": np.nan_to_num(unit * s_len * t_len, nan=np.inf) + 10.0 ** -SIM_DECIMALS,
                 "l2_rank": np.nan_to_num(unit * (s_len + t_len) ** 2, nan=np.inf) + 10.0 ** -SIM_DECIMALS}
    s_rough, t_rough, t_half = S.astype(rough), T.astype(rough), (t_sq / 2).astype(rough)
    t_step = max(1, min(len(tid), TILE_PAIRS // max(1, min(len(sid), 1024))))
    s_step = max(1, TILE_PAIRS // t_step)
    frames = []
    for i in range(0, len(sid), s_step):
        s, own_sq = S[i:i + s_step], s_sq[i:i + s_step]
        lists = {name: _Best(len(s), k, name == "l2_rank")
                 for name, wanted in (("ip_rank", want_ip), ("l2_rank", want_l2)) if wanted}
        for j in range(0, len(tid), t_step):
            t, sq, half = T[j:j + t_step], t_sq[j:j + t_step], t_half[j:j + t_step]
            with np.errstate(invalid="ignore", over="ignore"):
                tile = s_rough[i:i + s_step] @ t_rough[j:j + t_step].T
                exact, bounds = None, {}
                for name, best in lists.items():
                    bound = best.limit if name == "ip_rank" else (own_sq + best.limit) / 2
                    bound = bound - slack[name][i:i + s_step]
                    open_ = np.flatnonzero(best.limit == -np.inf)
                    if len(open_) and len(t) > k and rough is np.float32:
                        # k pairs of the tile are at least this good, whatever the error of one
                        value = tile[open_] if name == "ip_rank" else tile[open_] - half
                        bound[open_] = np.partition(value, len(t) - k, axis=1)[:, len(t) - k] - 2 * slack[name][i:i + s_step][open_]
                    bounds[name] = bound
                # Lowest product with which a pair may enter any list.
                least = np.minimum.reduce([x if name == "ip_rank" else x + float(half.min()) for name, x in bounds.items()])
                may = _places(tile, least.astype(rough))
                if len(may) * DENSE > tile.size and "l2_rank" in lists:     # lengths that differ: each list for itself
                    hit = (tile - half) >= bounds["l2_rank"].astype(rough)[:, None]
                    if "ip_rank" in lists:
                        hit |= tile >= bounds["ip_rank"].astype(rough)[:, None]
                    may = np.flatnonzero(hit.ravel())
                if len(may) * DENSE > tile.size:
                    dot = s @ t.T
                    sqd = np.round(np.maximum(own_sq[:, None] + sq - 2.0 * dot, 0.0), SIM_DECIMALS)
                    exact = np.round(dot, SIM_DECIMALS), sqd
                    for best in lists.values():
                        key = np.where(best.value(*exact) > best.limit[:, None], best.value(*exact), -np.inf)
                        r, c, _ = _select_topk(key, tid[j:j + t_step], k, False)
                        best.add(r, c + j, exact[0][r, c], exact[1][r, c])
                    continue
                for lo in range(0, len(may), PAIRS_AT_ONCE):
                    r, c = np.divmod(may[lo:lo + PAIRS_AT_ONCE], len(t))
                    dot = np.einsum("ij,ij->i", s[r], t[c])
                    sqd = np.round(np.maximum(own_sq[r] + sq[c] - 2.0 * dot, 0.0), SIM_DECIMALS)
                    dot = np.round(dot, SIM_DECIMALS)
                    for best in lists.values():
                        best.add(r, c + j, dot, sqd)
        frames.append(_both_lists(sid[i:i + s_step], tid, {name: best.lists() for name, best in lists.items()}))
    return pd.concat(frames)[cols]


def _places(tile: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places (flat, ascending) of a tile where it reaches its row's ``least``. They are few: eight
    places are passed over at a time."""
    hit = np.zeros(-(-tile.size // 8) * 8, bool)
    np.greater_equal(tile, least[:, None], out=hit[:tile.size].reshape(tile.shape))
    eights = np.flatnonzero(hit.view(np.uint64))
    at, within = np.nonzero(hit.reshape(-1, 8)[eights])
    return eights[at] * 8 + within


def _block_topk_fn(k: int, want_ip: bool, want_l2: bool):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("src_idx", "tgt_idx", "dot", "sqd", "ip_rank", "l2_rank")})
        return block_topk(left["id"].to_numpy(np.int64), np.stack(left["vec"].to_numpy()).astype(np.float64),
                          right["id"].to_numpy(np.int64), np.stack(right["vec"].to_numpy()).astype(np.float64),
                          k, want_ip, want_l2)

    return fn


def plan_blocks(n_s: int, n_t: int, dim: int, cores: int, listed: int = 0) -> tuple[int, int]:
    """(source blocks, target blocks): blocks within BLOCK_BYTES and, if the work is worth
    it, a few block pairs per core with the fewest bytes sent: vectors to the blocks, and
    ``listed`` result rows of a source from each target block to the merge."""
    rows = max(1, BLOCK_BYTES // max(1, dim * 8))
    n_sb, n_tb = math.ceil(n_s / rows), math.ceil(n_t / rows)
    tasks = min(TASKS_PER_CORE * cores, math.ceil(n_s * n_t / MIN_TASK_PAIRS))
    if n_sb * n_tb < tasks:
        # Sent are n_s * n_tb * (vector + rows) + n_t * n_sb * vector bytes.
        ratio = n_s * (dim * 8 + listed * RESULT_BYTES) / (n_t * dim * 8)
        n_sb = min(n_s, max(n_sb, min(round(math.sqrt(tasks * ratio)), math.ceil(tasks / n_tb))))
        n_tb = min(n_t, max(n_tb, math.ceil(tasks / n_sb)))
    return n_sb, n_tb


def exact_topk(src: DataFrame, tgt: DataFrame, k: int, *, src_id: str = "idx",
               tgt_id: str = "idx", vec: str = "vec", by=("ip", "l2"),
               n_src_blocks: int | None = None, n_tgt_blocks: int | None = None,
               n_src: int | None = None) -> DataFrame:
    """Exact top-k join of two vector tables.

    Returns ``src_idx, tgt_idx, dot, sqd, ip_rank, l2_rank``: one row per pair
    that is among the k largest inner products (``ip_rank``) or the k smallest
    squared distances (``l2_rank``) of its source. A rank is NULL when the pair
    is not in that list. ``k`` larger than the target table yields every target
    once (no phantom rows). ``n_src`` is an upper bound of the source rows, for a
    caller whose source table is expensive to count.
    """
    spark = src.sparkSession
    want_ip, want_l2 = "ip" in by, "l2" in by
    s = src.select(F.col(src_id).cast("long").alias("id"), F.col(vec).alias("vec")).filter("vec is not null")
    t = tgt.select(F.col(tgt_id).cast("long").alias("id"), F.col(vec).alias("vec")).filter("vec is not null")
    # A vector with a component that is null or not finite has no finite similarity to any other.
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    sizes = (t.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("count"), F.count_if(finite).alias("usable"))
             .orderBy(F.desc("count"), F.desc("dim")).first())
    if sizes is None or k <= 0:
        return spark.createDataFrame([], KNN_SCHEMA)
    dim, n_t = sizes["dim"], sizes["usable"]
    s, t = (x.filter((F.size("vec") == dim) & finite) for x in (s, t))
    n_s = s.count() if n_src is None else n_src
    if n_s == 0 or n_t == 0:
        return spark.createDataFrame([], KNN_SCHEMA)
    n_sb, n_tb = plan_blocks(n_s, n_t, dim, default_parallelism(spark), min(k, n_t) * len(by))
    n_sb, n_tb = n_src_blocks or n_sb, n_tgt_blocks or n_tb

    s_rep = (s.withColumn("sb", F.pmod(F.xxhash64("id"), F.lit(n_sb)).cast("int"))
              .withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(n_tb - 1)))))
    t_rep = (t.withColumn("tb", F.pmod(F.xxhash64("id"), F.lit(n_tb)).cast("int"))
              .withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(n_sb - 1)))))
    # Block pairs are few and long: more partitions than pairs, so that hardly two share a task.
    s_rep, t_rep = (x.repartition(ROOM * n_sb * n_tb, "sb", "tb") for x in (s_rep, t_rep))
    partial = (s_rep.groupBy("sb", "tb")
               .cogroup(t_rep.groupBy("sb", "tb"))
               .applyInPandas(_block_topk_fn(k, want_ip, want_l2), KNN_SCHEMA))
    if n_tb == 1:
        return partial
    # Both lists are cut over one exchange: a branch of its own for each would compute the blocks twice.
    partial = partial.repartition("src_idx")
    for name, order in (("ip_rank", F.desc("dot")), ("l2_rank", F.asc("sqd"))):
        if name[:2] in by:
            w = Window.partitionBy("src_idx").orderBy(F.col(name).isNull(), order, F.asc("tgt_idx"))
            place = F.when(F.col(name).isNotNull(), F.row_number().over(w))
            partial = partial.withColumn(name, F.when(place <= k, place))
    partial = partial.filter("ip_rank is not null or l2_rank is not null")
    if len(by) == 1:
        return partial
    return (partial.groupBy("src_idx", "tgt_idx")
            .agg(*[F.max(c).alias(c) for c in ("dot", "sqd", "ip_rank", "l2_rank")]))


def knn_inner_product(src: DataFrame, tgt: DataFrame, k: int, **kw) -> DataFrame:
    """The k targets with the largest inner product per source."""
    return (exact_topk(src, tgt, k, by=("ip",), **kw)
            .filter(F.col("ip_rank").isNotNull())
            .select("src_idx", "tgt_idx", F.col("dot").alias("sim"), F.col("ip_rank").alias("rank")))


def knn_l2(src: DataFrame, tgt: DataFrame, k: int, **kw) -> DataFrame:
    """The k targets with the smallest squared Euclidean distance per source."""
    return (exact_topk(src, tgt, k, by=("l2",), **kw)
            .filter(F.col("l2_rank").isNotNull())
            .select("src_idx", "tgt_idx", F.col("sqd").alias("sq_dist"), F.col("l2_rank").alias("rank")))


def candidate_union(src: DataFrame, tgt: DataFrame, k: int, **kw) -> DataFrame:
    """Distinct union of both id lists, with the values of both searches."""
    return exact_topk(src, tgt, k, by=("ip", "l2"), **kw)


def self_neighbours(vectors: DataFrame, k_neighbors: int, only: DataFrame | None = None,
                    n_only: int | None = None, **kw) -> DataFrame:
    """For each vector (each id of ``only``, when given), its ``k_neighbors + 1`` most
    similar vectors of the same table (itself included, as a flat index search returns it)."""
    left = vectors if only is None else vectors.join(only.select("idx").distinct(), "idx", "left_semi")
    return (exact_topk(left, vectors, k_neighbors + 1, by=("ip",), n_src=n_only if only is not None else None, **kw)
            .select(F.col("src_idx").alias("idx"), F.col("tgt_idx").alias("nbr_idx"),
                    F.col("dot").alias("sim"), F.col("ip_rank").alias("rank")))
