"""Exact substring dedup by a blockwise construction over cover samples.

Every byte covered by a ``min_len``-byte string that also starts in a document with a
smaller doc_id is removed. The order of suffixes is needed only as far as it tells equal
``min_len``-byte prefixes apart, so the construction is the difference-cover one, cut off
at that depth:

* Cover samples. A difference cover marks positions so that two equal windows are certain
  to hold a sample at the same distance from their start. The content-defined cover used
  here (the leftmost smallest hash of the ``gram``-byte strings in a window; a string
  synchronizing set) has the same property for equal windows with 2 in W + 1 samples
  instead of the 6 in 31 of the position-modulus cover. Each window belongs to exactly
  one sample, each sample to a run of windows.
* Ranks. A sample's rank is its gram's hash together with the hash of the whole run of
  windows it owns: samples of one rank own equal windows. Ranks are taken over the
  corpus, one bucket of samples at a time (``_resolve``), so memory is bounded by a bucket.
* Ties. Where one gram occurs in several documents with different surroundings (the ends
  of a shared passage), rank alone does not decide. Two such runs share a window only if
  the bytes on one side of the gram, over half of what a window holds beside it, are
  equal; hashes of both sides travel with a sample. The bytes of the few runs that agree on
  one are brought together by their gram in a second round, which ranks their windows.

Copies are pre-aggregated: of the samples of one rank a task sends only those of its
smallest document, the others are known to repeat it. Grams that a sample of the corpus
shows to be very common go to the second form (single windows) at once, which spreads
them over all buckets. Equality means equal 96-bit hashes (two independent ones).

Disk. What is shuffled and staged is packed (``_Packed``): sorted columns as differences, byte
by byte, compressed; about 18 bytes a sample and 4 a run, however many buckets there are. Runs meet
their texts in as many parts as there are shuffle partitions, by a hash of (doc_id, key). A text
whose doc_id no other text has gets the key 0. Shuffles are dropped once their stage is written.

Edge cases: null text is empty; texts under ``min_len`` bytes lose nothing; rows that
share a doc_id never remove each other's bytes (neither is smaller); rows with a null
doc_id neither remove nor lose bytes; an empty table gives an empty result; a text of
any length is hashed in slices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import shuffle_parts, staged

MIN_LEN = 50
GRAM = 20                  # bytes of a cover sample's string
SLICE = 1 << 19            # window starts hashed at a time
FLUSH = 3 << 18            # samples a task holds before it sends them
SUB_BUCKETS = 8            # buckets per shuffle partition in the first round, resolved one at a time
SHARED_IDS = 100_000       # so many ids that several texts share are broadcast
HOT_BUCKETS = 2            # a gram that alone would fill so many average buckets counts as hot
HOT_SAMPLE_ROWS = 20_000   # about so many documents are sampled to find hot grams

_M = (1 << 64) - 1


class _Hasher:
    """Polynomial hashes mod 2^64 of byte ranges, from prefix sums."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 2 ** 62)) * 8 + 5
        self.pow = self._powers(base, size)
        self.inv = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        out[1:] = np.uint64(base)
        return np.cumprod(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.pow[:len(data)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start, length: int) -> np.ndarray:
        return mixed((prefix[start + length] - prefix[start]) * self.inv[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _owners(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest g in every window of ``width`` positions."""
    best, span = np.arange(len(g), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        span += step
    return best


class Sampler:
    """Cover samples of texts: hashers and window geometry of one (min_len, gram)."""

    def __init__(self, min_len: int, gram: int):
        self.min_len, self.gram = min_len, gram
        self.width = min_len - gram + 1
        self.half = (min_len - gram) // 2
        self.size = SLICE + min_len + 8
        self.first, self.second = _Hasher(11, self.size), _Hasher(23, self.size)

    def slices(self, texts: list[bytes]):
        """(data, doc of each window, its start in the doc, its start in data, start and end
        of its text part in data): whole short texts together, long texts in overlapping parts."""
        part, total = [], 0
        for k, t in enumerate(texts):
            n = len(t)
            if n < self.min_len:
                continue
            for lo in range(0, n - self.min_len + 1, SLICE):
                piece = t[lo:lo + SLICE + self.min_len - 1]
                if total + len(piece) > self.size:
                    yield self._slice(part)
                    part, total = [], 0
                part.append((k, lo, piece))
                total += len(piece)
        if part:
            yield self._slice(part)

    def _slice(self, part):
        data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
        lens = np.array([len(p) for _, _, p in part])
        starts = np.cumsum(lens) - lens
        count = lens - self.min_len + 1
        which = np.repeat(np.arange(len(part)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        doc = np.array([k for k, _, _ in part])[which]
        first = starts[which]
        return (data, doc, np.array([lo for _, lo, _ in part])[which] + inside, first + inside,
                first, first + lens[which])

    def samples(self, texts: list[bytes]):
        """(h, c, doc, left, right, lo, n, window hashes) per slice: one row per sample,
        owning the n windows from ``lo`` on."""
        for data, doc, at, w, begin, end in self.slices(texts):
            p1 = self.first.prefix(data)
            g = self.first.at(p1, np.arange(len(data) - self.gram + 1), self.gram)
            own = _owners(g, self.width)[w]
            new = np.ones(len(w), bool)
            new[1:] = (own[1:] != own[:-1]) | (w[1:] != w[:-1] + 1)
            lo = np.nonzero(new)[0]
            hi = np.append(lo[1:], len(w)) - 1
            p2 = self.second.prefix(data)
            o, a, z = own[lo], w[lo], w[hi]
            c = mixed(self.second.at(p2, a, self.min_len) * np.uint64(3) + self.second.at(p2, z, self.min_len)
                      + (o - a).astype(np.uint64) * np.uint64(1000003) + (z - a).astype(np.uint64))
            left, right = o - self.half, o + self.gram
            left = self._side(p2, left, left >= begin[lo])
            right = self._side(p2, right, right + self.half <= end[lo])
            yield g[o], c, doc[lo], left, right, at[lo], hi - lo + 1, (p1, p2, a, o)

    def _side(self, prefix, start, inside):
        """16-bit hash of the ``half`` bytes from ``start`` on; 0 where the text part ends."""
        h = self.second.at(prefix, np.where(inside, start, 0), self.half) >> np.uint64(48)
        return np.where(inside, np.maximum(h, np.uint64(1)), np.uint64(0))

    def windows(self, hashes, pick, n):
        """Both hashes, the picked row and the shift of each single window of the rows in ``pick``."""
        p1, p2, a, _ = hashes
        n = n[pick]
        row = np.repeat(pick, n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        w = a[row] + shift
        return self.first.at(p1, w, self.min_len), self.second.at(p2, w, self.min_len), row, shift


def _runs_of(*cols):
    """Start of each run of equal values in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _spans(*cols):
    """(start, end) of the runs of equal values in sorted columns."""
    at = np.flatnonzero(_runs_of(*cols)) if len(cols[0]) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(cols[0]))


class _Packed:
    """Columns of whole numbers as packed blobs: the bytes of each place together (those of small
    numbers are zero), compressed. ``delta`` columns (sorted) are kept as differences from
    the row before, ``low`` columns as those from the blob's least value."""

    def __init__(self, delta: tuple = (), low: tuple = (), **widths: int):
        self.widths, self.delta, self.low = widths, delta, low
        self.size = sum(widths.values())

    def pack(self, cols: dict, start, end):
        """The blob of each range of rows."""
        mat, at = np.empty((self.size, len(next(iter(cols.values())))), np.uint8), 0
        rows, least = np.repeat(np.arange(len(start)), end - start), {}
        for name, width in self.widths.items():
            x = cols[name].astype(np.int64)
            if name in self.delta:
                d = x.copy()
                d[1:] -= x[:-1]
                d[start] = x[start]
                x = d
            elif name in self.low:
                least[name] = np.minimum.reduceat(x, start)
                x = x - least[name][rows]
            mat[at:at + width] = x.view(np.uint8).reshape(-1, 8)[:, :width].T
            at += width
        heads = np.stack([end - start, *[least[n] for n in self.low]], axis=1).astype(np.int64)
        codec = pa.Codec("zstd", compression_level=1)
        for a, z, head in zip(start, end, heads):
            yield head.tobytes() + codec.compress(mat[:, a:z].tobytes(), asbytes=True)

    def unpack(self, blobs: list) -> dict:
        """The rows of all blobs, one blob's after the other's."""
        codec, n_head, parts = pa.Codec("zstd"), 8 * (1 + len(self.low)), []
        for blob in blobs:
            n, *least = np.frombuffer(blob, np.int64, 1 + len(self.low)).tolist()
            mat = codec.decompress(memoryview(blob)[n_head:], n * self.size)
            mat, at, cols = np.frombuffer(mat, np.uint8).reshape(self.size, n), 0, {}
            for name, width in self.widths.items():
                x = np.zeros((n, 8), np.uint8)
                x[:, :width] = mat[at:at + width].T
                cols[name] = x.view(np.int64).reshape(-1)
                at += width
                if name in self.delta:
                    cols[name] = np.cumsum(cols[name])
                elif name in self.low:
                    cols[name] += least[self.low.index(name)]
            parts.append(cols)
        return {name: np.concatenate([x[name] for x in parts]) for name in self.widths}


_SAMPLES = _Packed(("h",), ("id",), h=6, c=6, left=2, right=2, lo=6, n=1, id=8, key=8)
_CONTEXTS = _Packed((), ("id",), lo=6, n=1, gram=1, id=8, key=8)
_RUNS = _Packed(("id",), (), id=8, key=8, lo=6, n=6)


def doc_part(doc_id, key, parts: int) -> np.ndarray:
    """``pmod(xxhash64(doc_id, key), parts)`` of Spark."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, k):
        return x << np.uint64(k) | x >> np.uint64(64 - k)

    h = np.full(len(doc_id), 42, np.uint64)
    for col in (doc_id, key):
        h = (h + p5 + np.uint64(8)) ^ turned(col.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64) % parts


class _RunBox:
    """Runs of one kind and one task, packed by the part of their documents."""

    def __init__(self, kind: int, parts: int):
        self.kind, self.n_parts, self.runs, self.count = kind, parts, [], 0

    def add(self, doc_id, key, lo, n):
        self.runs.append((doc_id, key, lo, n))
        self.count += len(lo)

    def full(self) -> bool:
        return self.count >= FLUSH

    def flush(self):
        """(kind, part, blob)"""
        if not self.count:
            return
        cols = [np.concatenate(x) for x in zip(*self.runs)]
        self.runs, self.count = [], 0
        doc_id, key, lo, n = _joined(*cols) if self.kind == REPEATED else cols
        part = doc_part(doc_id, key, self.n_parts)
        order = np.lexsort((lo, key, doc_id, part))
        part = part[order]
        at, end = _spans(part)
        cols = {"id": doc_id[order], "key": key[order], "lo": lo[order], "n": n[order]}
        for p, blob in zip(part[at].tolist(), _RUNS.pack(cols, at, end)):
            yield self.kind, p, blob


REPEATED, OPEN = 1, 2        # kinds of runs: repeat a smaller document, undecided


class _Outbox:
    """Samples of one task, pre-aggregated and dealt to buckets as packed records."""

    def __init__(self, buckets: int, parts: int):
        self.buckets, self.parts, self.count = buckets, [], 0
        self.docs: list[tuple[int, int]] = []
        self.known = _RunBox(REPEATED, parts)

    def doc(self, doc_id: int, key: int) -> int:
        self.docs.append((doc_id, key))
        return len(self.docs) - 1

    def add(self, h, c, doc, left, right, lo, n):
        self.parts.append(((h >> np.uint64(16)).astype(np.int64), (c >> np.uint64(16)).astype(np.int64), doc.astype(np.int32),
                           left.astype(np.uint16), right.astype(np.uint16), lo, n.astype(np.uint8)))
        self.count += len(h)

    def full(self, more: int) -> bool:
        return self.count >= FLUSH or len(self.docs) + more > 65535

    def flush(self):
        """(bucket, part, blob): samples (part -1), and runs that are known to repeat."""
        docs = np.array(self.docs, dtype=np.int64).reshape(-1, 2)
        parts, self.parts, self.count, self.docs = self.parts, [], 0, []
        if not parts:
            return
        h, c, doc, left, right, lo, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        # h and its bucket as one number; samples of one h stand together in their bucket.
        size = (1 << 48) // self.buckets + 1
        h = h % self.buckets * size + h // self.buckets
        order = np.lexsort((docs[doc, 0], c, h))
        h, c, doc = h[order], c[order], doc[order]
        ids = docs[doc, 0]
        new = _runs_of(h, c)
        known = ids > ids[np.nonzero(new)[0]][np.cumsum(new) - 1]     # repeats a smaller document of this task
        if known.any():
            self.known.add(ids[known], docs[doc[known], 1], lo[order[known]], n[order[known]].astype(np.int64))
            for _, part, blob in self.known.flush():
                yield part % self.buckets, part, blob
            h, c, doc, ids, order = (x[~known] for x in (h, c, doc, ids, order))
        bucket = h // size
        at, end = _spans(bucket)
        cols = {"h": h - bucket * size, "c": c, "left": left[order], "right": right[order],
                "lo": lo[order], "n": n[order], "id": ids, "key": docs[doc, 1]}
        for b, blob in zip(bucket[at].tolist(), _SAMPLES.pack(cols, at, end)):
            yield b, -1, blob


def _joined(doc_id, key, lo, n):
    """Window runs of the same text that touch, as one run."""
    order = np.lexsort((lo, key, doc_id))
    doc_id, key, lo, end = doc_id[order], key[order], lo[order], (lo + n)[order]
    new = _runs_of(doc_id, key)
    new[1:] |= lo[1:] > end[:-1]
    at = np.nonzero(new)[0]
    return doc_id[at], key[at], lo[at], np.maximum.reduceat(end, at) - lo[at]


_SENT = "bucket int, part int, items binary"
_SENT_CONTEXTS = "bucket int, items binary, text binary"
_FOUND = "kind int, part int, items binary"
_MEETING = "part int, kind int, doc_id long, key long, data binary"


def _rows(rows, schema: str):
    """One record batch of the rows."""
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def _send_samples(min_len, gram, buckets, parts, hot):
    def run(batches):
        sampler, box = Sampler(min_len, gram), _Outbox(buckets, parts)
        common = np.array(sorted(hot), dtype=np.uint64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sl = b.slice(at, 512)
                if box.full(sl.num_rows):
                    yield from (_rows([r], _SENT) for r in box.flush())
                ids, keys, texts = (sl.column(i).to_pylist() for i in range(3))
                base = len(box.docs)
                for i, k in zip(ids, keys):
                    box.doc(i, k)
                for h, c, doc, left, right, lo, n, hashes in sampler.samples(texts):
                    if len(common):
                        is_hot = np.isin(h, common)
                        pick = np.nonzero(is_hot)[0]
                        if pick.size:
                            w1, w2, row, shift = sampler.windows(hashes, pick, n)
                            none = np.zeros(len(row), np.uint64)
                            box.add(w1, w2, base + doc[row], none, none, lo[row] + shift, np.ones(len(row), np.int64))
                            h, c, doc, left, right, lo, n = (x[~is_hot] for x in (h, c, doc, left, right, lo, n))
                    box.add(h, c, base + doc, left, right, lo, n)
        yield from (_rows([r], _SENT) for r in box.flush())

    return run


def _buckets(batches, columns: int):
    """Rows sorted by bucket: the columns after it of each bucket, as lists."""
    bucket, held = None, []
    for b in batches:
        for k, *x in zip(*(b.column(i).to_pylist() for i in range(columns))):
            if k != bucket and held:
                yield list(zip(*held))
                held = []
            bucket = k
            held.append(x)
    if held:
        yield list(zip(*held))


def _resolve(parts: int):
    """Rows sorted by bucket. Sorts one bucket at a time and yields the window runs that
    repeat a smaller document and the undecided ones."""

    def settle(blobs, repeated, undecided):
        x = _SAMPLES.unpack(blobs)
        order = np.lexsort((x["id"], x["c"], x["h"]))
        x = {name: col[order] for name, col in x.items()}
        h, ids = x["h"], x["id"]
        new = _runs_of(h, x["c"])
        at = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        repeat = ids > ids[at][group]
        repeated.add(*(x[name][repeat] for name in ("id", "key", "lo", "n")))
        # First runs of a rank stay open if another rank of their gram, in another document,
        # agrees with them on one side.
        first = np.nonzero(~repeat)[0]
        open_ = np.zeros(len(first), bool)
        for side in ("left", "right"):
            around = x[side][first]
            order = np.lexsort((ids[first], group[first], around, h[first]))
            order = order[around[order] > 0]
            if not len(order):
                continue
            i = first[order]
            new_side = _runs_of(h[i], around[order])
            sat = np.nonzero(new_side)[0]
            which = np.cumsum(new_side) - 1
            ranks = np.add.reduceat((new_side | _runs_of(group[i])).astype(np.int64), sat)
            low, high = np.minimum.reduceat(ids[i], sat), np.maximum.reduceat(ids[i], sat)
            open_[order] |= ((ranks > 1) & (low < high))[which]
        undecided.add(*(x[name][first[open_]] for name in ("id", "key", "lo", "n")))

    def run(batches):
        boxes = _RunBox(REPEATED, parts), _RunBox(OPEN, parts)
        for kinds, blobs in _buckets(batches, 3):
            for part, blob in zip(kinds, blobs):
                if part >= 0:               # runs a task already knew to repeat
                    yield _rows([(REPEATED, part, blob)], _FOUND)
            samples = [blob for part, blob in zip(kinds, blobs) if part < 0]
            if samples:
                settle(samples, *boxes)
            for box in boxes:
                if box.full():
                    yield from (_rows([r], _FOUND) for r in box.flush())
        for box in boxes:
            yield from (_rows([r], _FOUND) for r in box.flush())

    return run


def _met(batches):
    """Rows sorted by part and kind: each document's (row in its batch, lo, n of its runs or None)."""
    part, blobs, runs = None, [], {}
    for b in batches:
        out = []
        for row, (p, kind, doc_id, key) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)))):
            if p != part:
                part, blobs, runs = p, [], {}
            if kind == 0:
                blobs.append(b.column(4)[row].as_py())
                continue
            if blobs:
                x = _RUNS.unpack(blobs)
                order = np.lexsort((x["lo"], x["key"], x["id"]))
                x, blobs = {name: col[order] for name, col in x.items()}, []
                runs = {(x["id"][a], x["key"][a]): (x["lo"][a:z], x["n"][a:z]) for a, z in zip(*_spans(x["id"], x["key"]))}
            out.append((row, *runs.get((doc_id, key), (None, None))))
        yield b, out


def _meeting(docs: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The packed runs (kind 0) and then the documents (kind 1) of each part, in one task."""
    runs = found.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"),
                        F.lit(None).cast("long").alias("key"), F.col("items").alias("data"))
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int").alias("part")
    docs = docs.select(part, F.lit(1).alias("kind"), "doc_id", "key", "data")
    return runs.unionByName(docs).repartitionById(parts, "part").sortWithinPartitions("part", "kind")


def _send_contexts(min_len, gram, buckets):
    """The bytes of the runs that were left undecided, dealt out by their gram."""

    def flush(sampler, docs, texts, lo):
        rows = [(doc, o - a, n, g) for g, _, doc, _, _, _, n, (_, _, a, o) in sampler.samples(texts)]
        doc, at, n, g = (np.concatenate(x) for x in zip(*((d, o, n, h) for d, o, n, h in rows)))
        bucket = (g % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((g, bucket))
        doc, at, n, bucket = doc[order], at[order], n[order], bucket[order]
        docs, lo = np.array(docs, np.int64).reshape(-1, 2), np.array(lo, np.int64)
        cols = {"lo": lo[doc], "n": n, "gram": at, "id": docs[doc, 0], "key": docs[doc, 1]}
        start, end = _spans(bucket)
        codec = pa.Codec("zstd", compression_level=1)
        for a, z, blob in zip(start, end, _CONTEXTS.pack(cols, start, end)):
            data = b"".join(texts[i] for i in doc[a:z])
            yield _rows([(int(bucket[a]), blob, codec.compress(data, asbytes=True))], _SENT_CONTEXTS)

    def run(batches):
        sampler, docs, texts, los = Sampler(min_len, gram), [], [], []
        for b, found in _met(batches):
            for row, lo, n in found:
                if lo is None:
                    continue
                doc_id, key, data = (b.column(i)[row].as_py() for i in (2, 3, 4))
                for at, count in zip(lo.tolist(), n.tolist()):
                    docs.append((doc_id, key))
                    texts.append(data[at:at + count + min_len - 1])
                    los.append(at)
                if len(texts) >= FLUSH // 4:
                    yield from flush(sampler, docs, texts, los)
                    docs, texts, los = [], [], []
        if texts:
            yield from flush(sampler, docs, texts, los)

    return run


def _resolve_contexts(min_len, gram, parts):
    """Rows sorted by bucket: ranks the single windows of the undecided runs of a bucket, those at
    one distance from their gram at a time, and yields those that repeat a smaller document."""

    def run(batches):
        sampler, box = Sampler(min_len, gram), _RunBox(REPEATED, parts)
        codec = pa.Codec("zstd")
        for items, texts in _buckets(batches, 3):
            cols, grams = [], []
            for blob, text in zip(items, texts):
                x = _CONTEXTS.unpack([blob])
                size = x["n"] + min_len - 1
                data = np.frombuffer(codec.decompress(text, int(size.sum())), np.uint8)
                begin = np.cumsum(size) - size
                # Whole contexts, as many at a time as the hashes reach.
                cut, z = 0, 0
                while cut < len(size):
                    z = max(cut + 1, int(np.searchsorted(begin + size, begin[cut] + sampler.size - 1, "right")))
                    part = data[begin[cut]:begin[z - 1] + size[z - 1]]
                    hashes = (sampler.first.prefix(part), sampler.second.prefix(part), begin[cut:z] - begin[cut], None)
                    w1, w2, row, shift = sampler.windows(hashes, np.arange(z - cut), x["n"][cut:z])
                    grams.append((w1, w2, row + cut + sum(len(c["n"]) for c in cols), shift, x["gram"][cut:z][row] - shift))
                    cut = z
                cols.append(x)
            x = {name: np.concatenate([c[name] for c in cols]) for name in cols[0]}
            w1, w2, row, shift, at = (np.concatenate(y) for y in zip(*grams))
            by = np.argsort(at, kind="stable")
            for a, z in zip(*_spans(at[by])):
                i = by[a:z]
                ids = x["id"][row[i]]
                order = np.lexsort((ids, w2[i], w1[i]))
                i, ids = i[order], ids[order]
                new = _runs_of(w1[i], w2[i])
                repeat = ids > ids[new][np.cumsum(new) - 1]
                r = row[i][repeat]
                box.add(ids[repeat], x["key"][r], x["lo"][r] + shift[i][repeat], np.ones(len(r), np.int64))
            if box.full():
                yield from (_rows([r], _FOUND) for r in box.flush())
        yield from (_rows([r], _FOUND) for r in box.flush())

    return run


def _ranked(sent: DataFrame, parts: int, resolve, tag: str) -> DataFrame:
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return staged(dealt.mapInArrow(resolve, _FOUND), tag, drop_shuffles=True)


def _hot_grams(docs: DataFrame, min_len: int, gram: int, buckets: int) -> list[int]:
    """Grams whose share of the samples, in a bounded share of the documents, is that of
    HOT_BUCKETS buckets. Only decides how a gram is dealt out, never a result; at most
    buckets / HOT_BUCKETS values."""

    def run(batches):
        sampler = Sampler(min_len, gram)
        for b in batches:
            hs = [h for h, *_ in sampler.samples(b.column(2).to_pylist())]
            if hs:
                v, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["h", "n"])

    rows = docs.count()
    share = min(1.0, HOT_SAMPLE_ROWS / max(rows, 1))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = staged(counts, "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.filter(F.col("n") >= max(total * HOT_BUCKETS / buckets, 50)).select("h").collect()
    return [r["h"] & _M for r in top]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, data) with the ``key`` that tells texts of one doc_id apart: a hash, or 0
    where the doc_id has no other text."""
    key = F.xxhash64("data")
    of_id = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    shared = staged(of_id.filter("a <> z").select(F.col("doc_id").alias("_shared")), "ids", drop_shuffles=True)
    n = shared.limit(SHARED_IDS + 1).count()
    if 0 < n <= SHARED_IDS:
        docs = docs.join(F.broadcast(shared), F.col("doc_id") == F.col("_shared"), "left")
        key = F.when(F.col("doc_id").isNull() | F.col("_shared").isNotNull(), key).otherwise(F.lit(0))
    elif n == 0:
        key = F.when(F.col("doc_id").isNull(), key).otherwise(F.lit(0))
    return docs.select("doc_id", key.cast("long").alias("key"), "data")


def repeated_runs(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """(part, items): packed runs (``_RUNS``) of n window starts whose min_len-byte string also
    starts in a document with a smaller doc_id. ``docs``: doc_id, key, data (non-null)."""
    parts = shuffle_parts(docs.sparkSession)
    buckets = parts * SUB_BUCKETS
    docs = docs.filter("doc_id is not null")
    hot = _hot_grams(docs, min_len, gram, buckets)
    first = _ranked(docs.mapInArrow(_send_samples(min_len, gram, buckets, parts, hot), _SENT), parts, _resolve(parts), "ranks")
    open_ = _meeting(docs, first.filter(F.col("kind") == OPEN), parts)
    second = _ranked(open_.mapInArrow(_send_contexts(min_len, gram, buckets), _SENT_CONTEXTS), parts,
                     _resolve_contexts(min_len, gram, parts), "ties")
    return first.filter(F.col("kind") == REPEATED).unionByName(second).select("part", "items")


def dedup(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")))
    every = _meeting(docs, repeated_runs(docs, min_len, gram), shuffle_parts(docs.sparkSession))

    def run(batches):
        for b, found in _met(batches):
            rows = []
            for row, los, ns in found:
                doc_id, text = b.column(2)[row].as_py(), b.column(4)[row].as_py()
                kept, at, removed, spans = [], 0, 0, 0
                if los is not None:
                    end = -1
                    for lo, hi in zip(los.tolist(), (los + ns - 1 + min_len).tolist()):
                        if lo > end:
                            if end >= 0:
                                removed += end - begin
                            kept.append(text[at:lo])
                            begin, end, spans = lo, hi, spans + 1
                        end = at = max(end, hi)
                    removed += end - begin
                kept = b"".join([*kept, text[at:]])
                rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(),
                             kept if with_text else None))
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = every.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                "kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
