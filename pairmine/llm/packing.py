"""Best-fit packing by large-item matching over the histogram of piece lengths.

1. Every document is tokenized, closed by an end token and cut into pieces of at most
   ``capacity`` tokens (only longer documents are cut; the first piece takes the rest).
2. Lengths are whole numbers up to the capacity, so the histogram of lengths (at most
   ``capacity`` rows, whatever the corpus) holds all that a packing plan depends on.
   ``plan`` works on counts: pieces above a third of the capacity, of which a sequence
   holds two at most, are matched greedily, largest first, each with the largest partner
   that fits; the smaller ones then go, largest first, into the tightest gap left.
3. The k-th piece of a length takes the k-th place of that length. k comes from a count
   per (length, bucket of the id) and a rank inside the bucket, so no length, however
   common, is numbered by one task.

Nothing but the histogram reaches the driver, and the plan's runs (pattern, number of
sequences) go to the tasks; their number is bounded by the distinct lengths, not the rows.

Edge cases: null or empty text is the end token alone; repeated rows are pieces of their
own (their order among themselves does not matter, they are alike; rows that share an id
but not the text are told apart by their tokens); an empty table gives an empty result;
a null doc_id is carried along.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.llm.common import shuffle_parts, staged
from pairmine.process_cache import process_cached

CAPACITY = 1024
END_ID = 2
CACHE_CHUNKS = 600_000     # chunks whose ids a worker remembers; emptied when full
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# White space (or what a tokenizer's pattern may count as such) in front of a space.
_NO_CUT = re.compile("[\\s\x85\u180e\u200b\u2060\ufeff] ")


class ChunkEncoder:
    """ids of whole texts as little-endian uint32 bytes, remembering repeated chunks.

    A byte-level BPE splits the text before it merges, and never inside a word: each unit
    is white space, or one optional space with a run of non-white characters. A text cut
    in front of a space that follows a non-white character is therefore encoded chunk by
    chunk, with the same ids, and repeated chunks are looked up.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Bytes that a token stands for: one per character of its byte-level spelling.
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())])
        self.cache: dict = {}
        self.cache_chunks = cache_chunks

    @staticmethod
    def chunks(text: str) -> list:
        """Keys of the chunks: (first,), then each later chunk without its leading space."""
        if "<|" in text:        # may hold a special token's string, which may hold anything
            return [(text,)]
        parts = text.split(" ")
        if _NO_CUT.search(text):
            joined = [parts[0]]
            for part in parts[1:]:
                if joined[-1] and not _NO_CUT.match(joined[-1][-1] + " "):
                    joined.append(part)
                else:
                    joined[-1] += " " + part
            parts = joined
        parts[0] = (parts[0],)
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.chunks(t) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > self.cache_chunks:
            cache.clear()
        new = set(chain.from_iterable(cut)).difference(cache)
        plain = [c for c in new if type(c) is str and c and "<|" not in c and not _NO_CUT.match(c[-1] + " ")]
        for at in range(0, len(plain), 512):
            self._encode_joined(plain[at:at + 512])
        self._encode_each(list(new.difference(plain)))
        return [b"".join([cache[c] for c in cs]) for cs in cut]

    def _encode_each(self, keys: list) -> None:
        for at in range(0, len(keys), 4096):
            part = keys[at:at + 4096]
            strings = [c[0] if type(c) is tuple else " " + c for c in part]
            for c, e in zip(part, self.tok.encode_batch_fast(strings, add_special_tokens=False)):
                self.cache[c] = array("I", e.ids).tobytes()

    def _encode_joined(self, keys: list) -> None:
        """Chunks that may follow each other (see ``chunks``), encoded as one text; the ids
        are told apart by the bytes they stand for."""
        strings = [" " + c for c in keys]
        ids = np.array(self.tok.encode_batch_fast(["".join(strings)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum([len(x.encode()) for x in strings])
        seen = np.cumsum(self.width[ids])
        last = np.searchsorted(seen, ends) + 1
        if seen[-1] != ends[-1] or (seen[last - 1] != ends).any():
            return self._encode_each(keys)
        raw, last, begin = ids.tobytes(), (4 * last).tolist(), 0
        for c, end in zip(keys, last):
            self.cache[c] = raw[begin:end]
            begin = end


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece."""
    path = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 256      # texts encoded together

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = process_cached(f"chunk-encoder:{path}", lambda: ChunkEncoder(path))
        for b in batches:
            for at in range(0, b.num_rows, step):
                sl = b.slice(at, step)
                cols = ([], [], [], [], [])
                for doc, ids in zip(sl.column(0).to_pylist(), enc.encode(sl.column(1).to_pylist())):
                    ids += end
                    total, begin, k = len(ids) // 4, 0, 0
                    n = total % capacity or capacity
                    n = min(n, total)
                    while begin < total:
                        for col, v in zip(cols, (doc, k, begin, n, zlib.crc32(ids[4 * begin:4 * (begin + n)]))):
                            col.append(v)
                        begin, k, n = begin + n, k + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing of a histogram of lengths: (lengths in a sequence, number of such sequences)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    # Sequences under way by gap: [lengths, number].
    gaps: dict[int, list] = defaultdict(list)
    free: list[int] = []      # the gaps in use, ascending

    def add(gap: int, lengths: tuple[int, ...], number: int) -> None:
        if not gaps[gap]:
            insort(free, gap)
        gaps[gap].append((lengths, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large.pop()
        count = left[a]
        while count:
            # The largest partner that fits: lengths up to a remain in ``large``, and a itself.
            at = bisect_left(large, capacity - a + 1) - 1
            if 2 * a <= capacity and count >= 2:
                add(capacity - 2 * a, (a, a), count // 2)
                count %= 2
            elif at >= 0:
                b = large[at]
                m = min(count, left[b])
                add(capacity - a - b, (a, b), m)
                count -= m
                left[b] -= m
                if not left[b]:
                    large.pop(at)
            else:
                add(capacity - a, (a,), count)
                count = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(free, n)
            if at == len(free):
                # No gap left: new sequences, each filled with as many as fit.
                per = capacity // n
                if count >= per:
                    add(capacity - per * n, (n,) * per, count // per)
                    count %= per
                else:
                    add(capacity - count * n, (n,) * count, 1)
                    count = 0
                continue
            gap = free[at]
            lengths, number = gaps[gap].pop()
            if not gaps[gap]:
                free.pop(at)
            # One sequence takes several of a length only when all of its kind do.
            per = min(gap // n, max(1, count // number))
            m = min(number, count // per)
            if m < number:
                add(gap, lengths, number - m)
            add(gap - per * n, lengths + (n,) * per, m)
            count -= per * m
    return [x for gap in free for x in gaps[gap]]


def _runs(patterns, capacity):
    """Per length, the places in rank order: (first rank, first sequence, offset)."""
    seen, at, base = [0] * (capacity + 1), defaultdict(list), 0
    for lengths, number in patterns:
        offset = 0
        for n in lengths:
            at[n].append((seen[n], base, offset))
            seen[n] += number
            offset += n
        base += number
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in at.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and offset; see the module docstring."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, path, end_id), "pieces")
    buckets = 8 * shuffle_parts(spark, 16)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = staged(cut.groupBy("length", "bucket").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_runs(plan(histogram, capacity), capacity))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (cut.withColumn("k", F.row_number().over(inside) - 1)
              .join(counts, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank")))

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, base, offset = runs.value[int(n)]
                i = np.nonzero(length == n)[0]
                r = np.searchsorted(first, rank[i], side="right") - 1
                seq[i], off[i] = base[r] + rank[i] - first[r], offset[r]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32",
                                                    "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
