"""Byte-level BPE: merge replay over the distinct words of a block of documents, and decoding.

1. Texts are cut into words (the matches of the tokenizer's pattern). The distinct words of a
   block of about ``BLOCK_CHARS`` characters that the worker has not seen yet are replayed
   together, ``REPLAY_WORDS`` at a time.
2. Replay of words of up to ``SHORT`` bytes: words of like length are the rows of a matrix of
   tokens, next to one of their pairs' ranks. In a round every row makes its leftmost merge of
   lowest rank, all rows at once, and the two pairs that it touches are looked up; rows without a
   merge leave.
   Replay of longer words: an inverted index leads from each pair of tokens to the word positions
   where it stands, over all words together. The pairs present are taken in rank order, each is
   applied at all its positions, and a merge touches its two neighbours only: their pairs
   are looked up and entered in the index.
3. A document's ids are those of its words. Ids of words seen before are remembered, up to
   ``CACHE_WORDS`` words in a worker; then all are forgotten and learned anew.

The merge rule is that of a rank table: of all neighbours in a word, those whose joined bytes have
the lowest rank merge first, the leftmost first among equals. Words are independent, so
replaying by rank over many words is the same as word by word; in the index, where a merge makes a pair of a
rank not above its own, that pair goes first and the rest of the rank's positions wait.

Nothing is shuffled and no stage is kept: a lost executor costs the tasks it ran. Memory
follows one block (or one longer document) and the remembered words. Documents may be as
long, and words as frequent, as they like; a very long word is merged in n log n.

Edge cases: null and empty texts have no ids; a null doc_id and repeated rows are carried along
as rows of their own; special tokens' strings are ordinary text; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.process_cache import process_cached

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 1 << 20       # characters of the documents whose words are replayed together
REPLAY_WORDS = 20_000       # words of one replay; more only make it too large for the processor's cache
SHORT = 32                  # bytes of a word up to which it is replayed in a matrix, whose work is their square
ROWS = 4096                 # words of one matrix
DECODE_IDS = 1 << 18        # ids whose bytes are gathered at once
CACHE_WORDS = 300_000       # words whose ids a worker remembers


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


NO_RANK = np.iinfo(np.int64).max


class Merges:
    """The rank table with what a replay looks up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # (left id, right id) -> id of the joined bytes, for every way to cut a token in two.
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        # The same as sorted arrays, for many lookups at once.
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        by = np.argsort(keys)
        self.pair_keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.pairs.values(), np.int64, len(keys))[by], NO_RANK)
        # The same for pairs of single bytes, as a table (-1: no token).
        self.byte_pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens (NO_RANK: the two do not merge)."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """ids of each word, by replaying merges over many words together."""
    out: list = [None] * len(words)
    short, long = [], []
    for k, w in enumerate(words):
        whole = merges.ranks.get(w)
        if whole is not None or not w:
            out[k] = [whole] if w else []
        else:
            (short if len(w) <= SHORT else long).append(k)
    short.sort(key=lambda k: len(words[k]))
    for lo in range(0, len(short), ROWS):
        part = short[lo:lo + ROWS]
        for k, ids in zip(part, replay_matrix([words[k] for k in part], merges)):
            out[k] = ids
    if long:
        for k, ids in zip(long, replay_index([words[k] for k in long], merges)):
            out[k] = ids
    return out


def replay_matrix(words: list[bytes], merges: Merges) -> list[list[int]]:
    """ids of each (short, not empty) word: one merge of every word in a round."""
    size = np.array([len(w) for w in words])
    width = int(size.max())
    inside = np.arange(width) < size[:, None]
    raw = np.zeros((len(words), width), np.int64)
    raw[inside] = np.frombuffer(b"".join(words), np.uint8)
    token = merges.byte[raw]
    # rank[:, i]: of the tokens i and i + 1; the last column and those beyond a word have none.
    rank = np.full((len(words), width), NO_RANK)
    first = merges.byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]]
    rank[:, :-1] = np.where((first >= 0) & inside[:, 1:], first, NO_RANK)
    done, left, own = np.zeros((len(words), width), np.int64), size.copy(), np.arange(len(words))
    place = np.arange(width)
    while len(own):
        at = rank.argmin(axis=1)
        lowest = rank[np.arange(len(own)), at]
        goes = lowest < NO_RANK
        if not goes.all():
            done[own[~goes]] = token[~goes]
            own, token, rank, at, lowest = (x[goes] for x in (own, token, rank, at, lowest))
            if not len(own):
                break
        row = np.arange(len(own))
        # The token at ``at`` is the merged one; all after its right part move up by one.
        after = place[None, :-1] + (place[None, :-1] > at[:, None])
        token[:, :-1] = np.take_along_axis(token, after, axis=1)
        after = place[None, :-1] + (place[None, :-1] >= at[:, None])
        rank[:, :-1] = np.take_along_axis(rank, after, axis=1)
        rank[:, -1] = NO_RANK
        token[row, at] = lowest
        left[own] -= 1
        has = at + 1 < left[own]
        rank[row[has], at[has]] = merges.rank_of(lowest[has], token[row[has], at[has] + 1])
        rank[row[~has], at[~has]] = NO_RANK
        has = at > 0
        rank[row[has], at[has] - 1] = merges.rank_of(token[row[has], at[has] - 1], lowest[has])
    ids = done[place < left[:, None]].tolist()
    ends = np.cumsum(left).tolist()
    return [ids[a:z] for a, z in zip([0, *ends], ends)]


def replay_index(words: list[bytes], merges: Merges) -> list[list[int]]:
    """ids of each (not empty) word, by replaying merges in rank order over all words together."""
    out: list = [None] * len(words)
    open_ = range(len(words))
    # All open words one after the other; -1 in ``token``: merged away; neighbours end at the
    # word's edges (-1).
    size = np.array([len(words[k]) for k in open_])
    begins = np.concatenate(([0], np.cumsum(size)))
    raw = np.frombuffer(b"".join([words[k] for k in open_]), np.uint8)
    n = len(raw)
    token = merges.byte[raw].tolist()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    before[begins[:-1]], after[begins[1:] - 1] = -1, -1
    # The index: rank of a pair -> positions of its left token, from the first on.
    first = np.append(merges.byte_pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]], -1)
    first[begins[1:] - 1] = -1
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    present, cuts = np.unique(first[at], return_index=True)
    index = defaultdict(list)
    index.update((r, p.tolist()) for r, p in zip(present.tolist(), np.split(at, cuts[1:])))
    after, before = after.tolist(), before.tolist()
    heap = present.tolist()
    pair_of = merges.pairs.get
    while heap:
        rank = heapq.heappop(heap)
        places = sorted(index.pop(rank))
        for done, i in enumerate(places):
            j = after[i]
            if j < 0 or token[i] < 0 or pair_of(token[i] << 32 | token[j]) != rank:
                continue                 # a neighbour took one of the two
            token[i], token[j] = rank, -1
            j = after[i] = after[j]
            h, lower = before[i], False
            if j >= 0:
                before[j] = i
                r = pair_of(rank << 32 | token[j])
                if r is not None:
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(i)
                    lower = r <= rank
            if h >= 0:
                r = pair_of(token[h] << 32 | rank)
                if r is not None:
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(h)
                    lower = lower or r <= rank
            if lower:                    # the new pair goes first
                rest = places[done + 1:]
                if rest and rank not in index:
                    heapq.heappush(heap, rank)
                if rest:
                    index[rank].extend(rest)
                break
    left = np.array(token)
    kept = left >= 0
    ids = left[kept].tolist()
    ends = np.concatenate(([0], np.cumsum(kept)))[begins].tolist()
    for k, a, z in zip(open_, ends, ends[1:]):
        out[k] = ids[a:z]
    return out


class Encoder:
    """ids of texts, block by block, remembering words seen before."""

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS):
        import regex

        self.find = regex.compile(pattern).findall
        self.merges = Merges(load_ranks(path))
        self.known: dict[str, bytes] = {}      # word -> its ids as int32
        self.cache_words = cache_words

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [self.find(t) if t else [] for t in texts]
        if len(self.known) > self.cache_words:
            self.known.clear()
        known = self.known
        new = list(set().union(*found).difference(known))
        for at in range(0, len(new), REPLAY_WORDS):
            part = new[at:at + REPLAY_WORDS]
            known.update(zip(part, (array("i", x).tobytes() for x in replay([w.encode() for w in part], self.merges))))
        return [b"".join(map(known.__getitem__, f)) for f in found]


class Decoder:
    """Bytes that ids stand for."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        # The tokens' bytes one after the other, and where those of an id begin (size -1: no token).
        self.pool = np.frombuffer(b"".join(ranks), np.uint8)
        size = np.array([len(token) for token in ranks], np.int64)
        of = np.array(list(ranks.values()), np.int64)
        self.begin, self.size = np.zeros(of.max() + 1, np.int64), np.full(of.max() + 1, -1, np.int64)
        self.begin[of], self.size[of] = np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, how many each id gives)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise KeyError("an id without a token")
        size, out = self.size[ids], []
        for lo in range(0, len(ids), DECODE_IDS):
            own = size[lo:lo + DECODE_IDS]
            ends = np.cumsum(own)
            at = np.repeat(self.begin[ids[lo:lo + DECODE_IDS]] - (ends - own), own)
            at += np.arange(len(at))
            out.append(self.pool[at])
        return np.concatenate(out) if out else np.zeros(0, np.uint8), size

    def column(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Binary column of the texts whose ids lie between neighbours of ``ends``."""
        data, size = self.decode(ids)
        where = np.concatenate(([0], np.cumsum(size)))[ends]
        if where[-1] - where[0] > np.iinfo(np.int32).max:
            raise ValueError("more decoded bytes than a column holds")
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                     [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           block_chars: int = BLOCK_CHARS, with_decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs`` (doc_id, text). ``with_decoded`` adds
    what ``decode`` would, in the same pass."""
    path, pattern = path or ranks_path(), pattern or word_pattern()

    def run(batches):
        encoder = process_cached(f"bpe:{path}:{pattern}", lambda: Encoder(path, pattern))
        decoder = process_cached(f"bpe-tokens:{path}", lambda: Decoder(path)) if with_decoded else None

        def settle(ids, texts):
            data = encoder.encode(texts)
            ends = np.cumsum([0] + [len(d) // 4 for d in data]).astype(np.int32)
            flat = np.frombuffer(b"".join(data), np.int32)
            cols = {"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
            if decoder:
                cols["decoded"] = decoder.column(flat, ends)
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= block_chars:
                    yield settle(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield settle(ids, texts)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded binary" if with_decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes that the ids stand for (``decoded``, binary)."""
    path = path or ranks_path()

    def run(batches):
        decoder = process_cached(f"bpe-tokens:{path}", lambda: Decoder(path))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = b.column(1)
                if ids.null_count:
                    raise ValueError("a row without ids")
                ends = ids.offsets.to_numpy()
                data = decoder.column(ids.flatten().to_numpy(), ends - ends[0])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the result of ``decode``."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
