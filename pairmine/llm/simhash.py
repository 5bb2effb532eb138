"""SimHash near-duplicates by a segment-popcount embedding.

1. Every text becomes a 64-bit SimHash fingerprint (word shingles, XXH64).
2. A fingerprint is mapped to its per-segment bit counts (32 segments of two bits). The
   counts are kept in unary, as the fingerprint with the bits of each segment sorted, so
   the Manhattan distance of two embeddings is the popcount of their XOR. One bit flip
   moves one count by one: Manhattan distance <= Hamming distance.
3. Grid range-join: the segments are dealt to G groups. Two embeddings within Manhattan
   distance r agree exactly on at least G - r groups, so each embedding is put in one unit
   cell per choice of G - r groups and only cell mates are compared: first by Manhattan
   distance, then exactly by Hamming distance. Neighbouring cells never have to be
   visited. G follows from the number of distinct fingerprints (any G gives the same
   links; a larger one has smaller cells).
4. A cell emits a spanning forest of its links (at most one row per member), never all
   pairs; components are joined over the cells.

Copies share a fingerprint, so a group of exact copies is one row from step 2 on. A cell
larger than CELL_ROWS is cut into blocks, and every pair of blocks is a task of its own.

Edge cases: null or wordless text has fingerprint 0 and is linked like any other; a row
with a null doc_id is returned and gets its fingerprint's component, but does not link
anything itself; repeated rows are each returned; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.llm.common import components, shuffle_parts, staged

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HASH_SEED = 42
SEGMENT_BITS = 2
CELL_ROWS = 8192          # members of a cell compared by one task at a time
CELL_TARGET = 512         # expected members of a cell
BUFFER_ROWS = 1 << 18     # rows gathered before a comparison pass

_EVEN = 0x5555555555555555


def simhash(data: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text (A-Z lower-cased, ASCII white space splits words)."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[i:j], HASH_SEED)
                          for i, j in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                         dtype="<u8", count=len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, extra: tuple = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed BIGINT with the same bits; BIGINT columns
    ``extra`` are passed through."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((simhash(t, shingle) for t in b.column(1).to_pylist()),
                              dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                                             names=["doc_id", "fp", *extra])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *extra)
    return src.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *extra)))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Unary per-segment bit counts of two-bit segments: 00, 01 or 11 per segment."""
    hi, lo = (fp >> np.uint64(1)) & np.uint64(_EVEN), fp & np.uint64(_EVEN)
    return ((hi & lo) << np.uint64(1)) | (hi | lo)


def cell_masks(n: int, radius: int) -> list[int]:
    """One mask per grid: the bits of the chosen G - radius groups of segments."""
    segments = 64 // SEGMENT_BITS
    # Two random two-bit segments have equal counts with probability 3/8 (1.415 bits).
    g = radius + 1
    while g < min(segments, 12) and n > CELL_TARGET * 2 ** (1.415 * segments * (g - radius) / g):
        g += 1
    bounds = [segments * i // g for i in range(g + 1)]
    groups = [sum(3 << (2 * s) for s in range(bounds[i], bounds[i + 1])) for i in range(g)]
    return [sum(c) for c in combinations(groups, g - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fp, unary, last, radius):
    """Spanning forest of the links inside runs of rows: (child, root) positions.

    ``last[i]`` is the end of row i's run. Compares rows at growing shifts, so the
    temporaries stay linear in the rows."""
    n = len(fp)
    root = np.arange(n)
    act = np.nonzero(root + 1 < last)[0]
    d = 1
    while act.size:
        other = act + d
        near = np.bitwise_count(unary[act] ^ unary[other]) <= radius
        i, j = act[near], other[near]
        hit = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (root[i] != root[j])
        if hit.any():
            _unite(root, i[hit], j[hit])
        d += 1
        act = act[act + d < last[act]]
    child = np.nonzero(root != np.arange(n))[0]
    return child, root[child]


def _unite(root, i, j):
    for a, b in zip(i.tolist(), j.tolist()):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    while True:
        up = root[root]
        if (up == root).all():
            return
        root[:] = up


_CELL_OUT = "grid int, cell long, block int, fp long, rep long, other long"


def _cell_links(radius: int, cell_rows: int):
    """Reads rows sorted by (grid, cell). Yields link rows (block -1: rep, other) and, for
    cells of more than ``cell_rows`` members, their rows with a block number."""

    def out(grid, cell, block, fp, rep, other):
        n = len(rep)
        full = lambda v, t: np.full(n, v, t) if np.isscalar(v) else v.astype(t)
        return pa.RecordBatch.from_arrays(
            [pa.array(full(grid, np.int32)), pa.array(full(cell, np.int64)), pa.array(full(block, np.int32)),
             pa.array(full(fp, np.int64)), pa.array(full(rep, np.int64)), pa.array(full(other, np.int64))],
            names=["grid", "cell", "block", "fp", "rep", "other"])

    def run(batches):
        held = None      # columns grid, cell, fp, rep of the rows not yet compared
        spilled, count = None, 0   # the large cell being dealt out, and its rows so far

        def settle(cols, final):
            nonlocal held, spilled, count
            grid, cell, fp, rep = cols
            n = len(fp)
            new = np.ones(n, bool)
            new[1:] = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])
            at = np.nonzero(new)[0]
            ends = np.append(at[1:], n)
            size = ends - at
            keep_from = n
            if not final:     # the last cell may go on in the next batch
                keep_from = at[-1]
            # A cell already dealt out, or larger than a block, leaves as numbered rows.
            big = size > cell_rows
            if spilled is not None and (int(grid[0]), int(cell[0])) == spilled:
                big[0] = True
            for k in np.nonzero(big)[0]:
                a, z = at[k], ends[k]
                base = count if spilled == (int(grid[a]), int(cell[a])) else 0
                yield out(grid[a:z], cell[a:z], (base + np.arange(z - a)) // cell_rows, fp[a:z], rep[a:z], 0)
                if k == len(at) - 1:
                    spilled, count, keep_from = (int(grid[a]), int(cell[a])), base + (z - a), n
            small = np.repeat(~big, size)
            small[keep_from:] = False
            idx = np.nonzero(small)[0]
            if idx.size:
                runs = np.repeat(np.cumsum(new)[at], size)[idx]
                last = np.searchsorted(runs, runs, side="right")
                f = fp[idx].view(np.uint64)
                child, root = _forest(f, segment_counts(f), last, radius)
                if child.size:
                    yield out(0, 0, -1, 0, rep[idx[root]], rep[idx[child]])
            held = tuple(c[keep_from:] for c in cols) if keep_from < n else None

        for b in batches:
            cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            held = cols if held is None else tuple(np.concatenate(x) for x in zip(held, cols))
            if len(held[0]) >= BUFFER_ROWS:
                yield from settle(held, False)
        if held is not None and len(held[0]):
            yield from settle(held, True)

    return run


def _block_links(radius: int):
    """Links inside and between two blocks of one large cell (rows sorted by pair)."""

    def run(pdf):
        fp = pdf["fp"].to_numpy().view(np.uint64)
        unary = segment_counts(fp)
        side = pdf["side"].to_numpy()
        rep = pdf["rep"].to_numpy()
        root = np.arange(len(fp))
        inside = not side.any()
        right = np.arange(len(fp)) if inside else np.nonzero(side == 1)[0]
        for i in (range(len(fp)) if inside else np.nonzero(side == 0)[0]):
            j = right[i + 1:] if inside else right
            j = j[np.bitwise_count(unary[j] ^ unary[i]) <= radius]
            j = j[(np.bitwise_count(fp[j] ^ fp[i]) <= radius) & (root[j] != root[i])]
            if j.size:
                _unite(root, np.full(len(j), i), j)
        child = np.nonzero(root != np.arange(len(fp)))[0]
        import pandas as pd
        return pd.DataFrame({"a": rep[root[child]], "b": rep[child]})

    return run


def links(fps: DataFrame, radius: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between the names ``rep`` of distinct fingerprints (fp, rep): a subset
    of all links within ``radius`` bits that connects everything they connect."""
    spark = fps.sparkSession
    masks = cell_masks(fps.count(), radius)
    hi = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_EVEN))
    lo = F.col("fp").bitwiseAND(F.lit(_EVEN))
    unary = F.shiftleft(hi.bitwiseAND(lo), 1).bitwiseOR(hi.bitwiseOR(lo))
    cells = fps.withColumn("unary", unary).select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.col("unary").bitwiseAND(F.lit(_signed(m))).alias("cell"))
                            for i, m in enumerate(masks)])).alias("c"), "fp", "rep")
    cells = (cells.select("c.grid", "c.cell", "fp", "rep")
             .repartition(shuffle_parts(spark), "grid", "cell").sortWithinPartitions("grid", "cell"))
    found = staged(cells.mapInArrow(_cell_links(radius, cell_rows), _CELL_OUT), "cells")
    out = found.filter("block = -1").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    large = found.filter("block >= 0")
    if large.limit(1).count():
        blocks = large.groupBy("grid", "cell").agg((F.max("block") + 1).alias("blocks"))
        pairs = (large.join(blocks, ["grid", "cell"])
                 .withColumn("p", F.explode(F.expr("sequence(0, blocks - 1)")))
                 .select("grid", "cell", F.least("block", "p").alias("i"), F.greatest("block", "p").alias("j"),
                         F.when(F.col("block") > F.col("p"), 1).otherwise(0).alias("side"), "fp", "rep"))
        more = staged(pairs.groupBy("grid", "cell", "i", "j").applyInPandas(_block_links(radius), "a long, b long"),
                      "blocks")
        out = out.unionByName(more)
    return out


def _named(fp: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, root): the fingerprints of rows with an id, the smallest doc_id of their
    component, and the fingerprint that the component is told from others by."""
    reps = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "reps")
    # Fingerprints are the nodes; a component is then named after its smallest doc_id.
    roots = components(links(reps.select("fp", F.col("fp").alias("rep")), radius))
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    fp = staged(fingerprints(docs, shingle), "fp")
    return fp.join(_named(fp, radius), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = MAX_DISTANCE) -> DataFrame:
    """One document of each near-duplicate group, all columns kept.

    The one with the smallest doc_id stays; among texts of the group that share it, the one with the
    smallest hash, and of rows that repeat id and text the first by their other columns.
    Groups are told apart by their fingerprints, so unrelated texts under one id each keep a
    row. Rows without an id cannot be told apart and stay."""
    keyed = docs.withColumn("_keep_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    fp = staged(fingerprints(keyed, shingle, ("_keep_key",)), "fp")
    # One row per group, pre-aggregated; a text belongs to one group only.
    first = (fp.filter("doc_id is not null").join(_named(fp, radius), "fp")
             .groupBy("root").agg(F.min(F.struct("doc_id", "_keep_key")).alias("k")).select("k.*"))
    others = [F.col(f"`{c}`") for c in sorted(docs.columns, key=lambda c: c == "text") if c != "doc_id"]
    kept = (keyed.join(first, ["doc_id", "_keep_key"], "left_semi")
            .withColumn("_keep_n", F.row_number().over(Window.partitionBy("doc_id", "_keep_key").orderBy(*others)))
            .filter("_keep_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.unionByName(docs.filter("doc_id is null"))
