"""Vector code compression: product codes by a lexicographic trie over distinct parts.

1. Every component x becomes the whole number floor(scale * x); a vector is cut into
   ``parts`` equal consecutive parts.
2. A part position's codebook starts as that part of the vectors with the smallest ids.
   A round assigns every part to its nearest entry and replaces each entry by the floor of
   the mean of its parts; an entry without parts stays.
3. Assignment goes over a trie: the distinct parts of a block of vectors, in lexicographic
   order, are the leaves, their common prefixes the inner nodes. The traversal is depth
   first and carries one vector of accumulated squared distances (one number per entry)
   down each edge, so a prefix that many parts share is measured once; a subtree of at most
   ``SUBTREE_LEAVES`` leaves is finished level by level in one go. A leaf takes the argmin
   and adds its part, weighted by the number of vectors that hold it, to the entry's sums.

Whole numbers throughout, so results do not depend on blocks, partitions or reruns. A round
is one pass over the staged whole-number vectors; a task sends one row per (part position,
entry, component), whatever it read, and the driver sees the codebooks only (``entries`` x
dimension numbers).

Edge cases: a vector that is null, empty, holds null or non-finite components or has another
length than the most common one (ties: the longest) takes no part. Repeated ids and rows are
rows of their own; a null id is encoded and sorts last among the first entries, repeated ids
sort by their vectors; fewer vectors than ``entries`` make smaller codebooks. A length that
is no multiple of ``parts`` is filled up with zeros, which add nothing to any distance and
are left out of the printed codebooks. Whole numbers beyond +-limit (2^27 in 64 dimensions) count
as that limit, so that an error always fits a BIGINT. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import checked_broadcast, staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SUBTREE_LEAVES = 2048            # leaves of a subtree measured in one go
MAX_BROADCAST_LABELS = 100_000   # rows of the per-label table that may be broadcast


@dataclass
class Codebooks:
    entries: np.ndarray      # (parts, entries, width) whole numbers
    dim: int                 # components that are not fill

    def text(self) -> str:
        """All entries' components by part, entry and position, comma-joined."""
        parts, _, width = self.entries.shape
        real = [min(width, max(0, self.dim - p * width)) for p in range(parts)]
        return ",".join(str(x) for p in range(parts) for e in self.entries[p] for x in e[:real[p]].tolist())

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def component_limit(dim: int) -> int:
    """Largest whole number of a component for which the errors of ``dim`` of them fit 62 bits."""
    return min(2 ** 30, int(np.sqrt(2.0 ** 62 / dim)) // 2)


def whole_vectors(emb: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame | None, int]:
    """((vec_id, label, v array<int>), dimension) of the vectors that take part; None without any."""
    v = emb.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return None, 0
    dim, limit = dims["d"], float(component_limit(dims["d"]))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(limit)), F.lit(-limit))).cast("int"))
    fill = -dim % parts
    if fill:
        whole = F.concat(whole, F.array_repeat(F.lit(0), fill))
    return v.filter(F.size("v") == dim).select("vec_id", "label", whole.alias("v")), dim


def nearest_by_trie(leaves: np.ndarray, book: np.ndarray, subtree: int = SUBTREE_LEAVES):
    """(nearest entry, squared distance) of each row of ``leaves``: distinct rows in
    lexicographic order."""
    n, width = leaves.shape
    near, dist = np.empty(n, np.int64), np.empty(n, np.int64)
    # opens[i, d]: row i begins a new node at depth d + 1.
    opens = np.ones((n, width), bool)
    opens[1:] = np.logical_or.accumulate(leaves[1:] != leaves[:-1], axis=1)
    todo = [(0, n, 0, np.zeros(len(book), np.int64))]
    while todo:
        lo, hi, depth, above = todo.pop()
        if hi - lo <= subtree:
            nodes, node_of = above[None], np.zeros(hi - lo, np.int64)
            for d in range(depth, width):
                first = opens[lo:hi, d].copy()
                first[0] = True
                at = np.flatnonzero(first)
                nodes = nodes[node_of[at]] + (leaves[lo + at, d][:, None] - book[:, d]) ** 2
                node_of = np.cumsum(first) - 1
            near[lo:hi] = nodes.argmin(axis=1)
            dist[lo:hi] = nodes[np.arange(hi - lo), near[lo:hi]]
            continue
        at = np.append(lo + np.flatnonzero(opens[lo:hi, depth]), hi)
        if at[0] != lo:
            at = np.insert(at, 0, lo)
        below = above + (leaves[at[:-1], depth][:, None] - book[:, depth]) ** 2
        todo.extend((int(at[k]), int(at[k + 1]), depth + 1, below[k]) for k in range(len(below) - 1, -1, -1))
    return near, dist


def distinct_rows(rows: np.ndarray):
    """(distinct rows in lexicographic order, row -> distinct row, how often each occurs)."""
    order = np.lexsort(rows.T[::-1])
    srt = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (srt[1:] != srt[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return srt[at], back, np.diff(np.append(at, len(rows)))


def _matrix(column, parts: int) -> np.ndarray:
    """(vectors, parts, width) of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _next_entries(vecs: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column(0), parts)
            for p in range(parts if len(x) else 0):
                leaves, _, weight = distinct_rows(x[:, p])
                near, _ = nearest_by_trie(leaves, books[p])
                np.add.at(count[p], near, weight)
                np.add.at(total[p], near, leaves * weight[:, None])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                 pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    rows = (vecs.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
            .select("part", "entry", "n", F.posexplode("total").alias("pos", "total"))
            .groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = books.copy()
    for r in rows.collect():        # parts x entries x width rows at most
        out[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return out


def fit(vecs: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of staged whole-number vectors."""
    first = vecs.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _next_entries(vecs, books)
    return Codebooks(books, dim)


def assign(vecs: DataFrame, model: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries in part order, two hex digits each,
    and the squared distances summed over the parts."""
    books = model.entries
    parts = len(books)
    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2), parts)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts if len(x) else 0):
                leaves, back, _ = distinct_rows(x[:, p])
                near, dist = nearest_by_trie(leaves, books[p])
                codes[:, p] = near[back]
                error += dist[back]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                                              pa.array(error)], names=["vec_id", "label", "code", "error"])

    return vecs.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(emb: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every vector that takes part.

    ``label_error`` is the error summed over all rows of the row's label, nulls together:
    the labels are pre-aggregated and joined back, so a hot label is one row."""
    if entries > 256:
        raise ValueError("a code of two hex digits holds at most 256 entries")
    vecs, dim = whole_vectors(emb, parts, scale)
    if vecs is None:
        return emb.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    vecs = staged(vecs, "whole-vectors")
    model = fit(vecs, dim, parts, entries, rounds)
    coded = staged(assign(vecs, model), "codes")
    per = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error"))
                 .withColumnRenamed("label", "_label"), "label-errors")
    return (coded.join(checked_broadcast(per, MAX_BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256")))
