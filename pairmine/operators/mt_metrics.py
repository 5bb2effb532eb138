"""Translation metrics as Spark jobs: E1 bleu_rows, E2 chrf_rows, E4 chrf_pp,
E3 meteor_rows (exact stage), E5 corpus_bleu / corpus_chrf, E6 evaluate_table,
A11 metric_means, P11 blank_reference_guard, J15 compare_runs.

Plan: one pass over the texts serves all metrics asked for. Rows of up to ``LONG_CHARS``
characters are counted where they are: an Arrow pass takes many rows together, gives every n-gram a number that is exact within its row (an n-gram is the pair of its first
n-1 units' number and its last unit), and returns the match counts of all orders, one narrow
row per input row, so no n-gram is ever shuffled. A longer row is tokenized by SQL functions and cut into segments of
``SEGMENT_UNITS`` units, which overlap by the n-gram length; segments are dealt over the tasks,
their n-grams counted by ``(row_id, order, gram)`` and clipped there, and one narrow aggregate
closes the row: one text, however long, spreads over the whole cluster. Both ways give the same
counts. The formulas are SQL expressions over the counts. No row is dropped or cut.

Formulas (public definitions): BLEU (Papineni et al. 2002) with exponential
smoothing of zero-match orders, brevity penalty, four orders, no effective order,
the 13a tokenizer; chrF (Popovic 2015): character n-grams 1..6 of the text with
whitespace removed, averaged precision and recall over the orders both sides
have, beta 2; chrF++ adds word 1- and 2-grams; METEOR (Banerjee & Lavie 2005)
exact-match stage only, alpha 0.9, beta 3, gamma 0.5, lowercased whitespace
tokens (no WordNet or stemming stages).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmine.functions.scalar import py_rstrip, py_split, py_strip

# ---------------------------------------------------------------------------
# Fixed values
BLEU_ORDER = 4
CHRF_CHAR_ORDER = 6
CHRF_WORD_ORDER = 2          # chrF++
CHRF_BETA = 2.0
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
# 13a tokenizer: escaped entities, then four regex passes (the space left out of the first
# class: a space set apart by spaces is still only white space).
REPLACED_13A = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
REGEX_13A = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
# Punctuation split off word edges for chrF++ word n-grams (ASCII punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# ---------------------------------------------------------------------------

# Units that n-grams are made of: name -> longest n-gram.
UNITS = {"w": BLEU_ORDER, "c": CHRF_CHAR_ORDER, "p": CHRF_WORD_ORDER}
LONG_CHARS = 1 << 19         # characters of a row's two texts that one task counts in memory
SEGMENT_UNITS = 1 << 14      # units of a longer row that one task counts
BLOCK_BYTES = 1 << 17        # bytes of the short rows' texts counted in one go


def tokenize_13a(text: Column) -> Column:
    """The 13a tokenizer as regexp_replace steps; returns ARRAY<STRING>."""
    t = py_rstrip(text)
    for a, b in REPLACED_13A + ENTITIES_13A:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pat, rep in REGEX_13A:
        t = F.regexp_replace(t, pat, rep)
    return py_split(t)


def _strip_punct_edges(tokens: Column) -> Column:
    """chrF++ word split: a token longer than one character loses one punctuation
    mark from its end, or else from its start, as a separate token."""
    p = F.lit(PUNCTUATION)

    def split(w):
        n = F.length(w)
        last, first = w.substr(n, F.lit(1)), w.substr(F.lit(1), F.lit(1))
        return (F.when(n == 1, F.array(w))
                .when(F.instr(p, last) > 0, F.array(w.substr(F.lit(1), n - 1), last))
                .when(F.instr(p, first) > 0, F.array(first, w.substr(F.lit(2), n - 1)))
                .otherwise(F.array(w)))
    return F.flatten(F.transform(tokens, split))


def eval_frame(df: DataFrame, hyp: str = "prediction", ref: str = "reference",
               num_partitions: int | None = None) -> DataFrame:
    """``row_id``, the two texts, whether the row counts as long, and whether it has no score
    (P11 + DV-6: a NULL or whitespace-only reference, a NULL prediction), dealt out by ``row_id``.

    The partition count is explicit (the session's shuffle partitions, at least four
    tasks per core): texts differ a lot in length, and the work grows after this point, so
    the input size must not let adaptive execution coalesce it into a few tasks.
    """
    out = df.select("row_id", F.col(hyp).alias("_hyp"), F.col(ref).alias("_ref"), *_marks(hyp, ref))
    return _dealt(out, num_partitions)


def _marks(hyp: str, ref: str) -> list[Column]:
    size = F.coalesce(F.length(hyp), F.lit(0)) + F.coalesce(F.length(ref), F.lit(0))
    return [(size > LONG_CHARS).alias("_long"),
            (F.col(ref).isNull() | (py_strip(F.col(ref)) == "") | F.col(hyp).isNull()).alias("_blank")]


def _dealt(rows: DataFrame, num_partitions: int | None = None) -> DataFrame:
    spark = rows.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, "row_id")


def _units(kind: str, text: Column) -> Column:
    """The units of a text: arrays of words, or a string of characters."""
    if kind == "w":
        return tokenize_13a(text)
    if kind == "c":
        return F.regexp_replace(text, _ws(), "")
    if kind == "p":
        return _strip_punct_edges(py_split(text))
    return py_split(F.lower(text))          # METEOR's words


def _shifted(arr: Column, k: int) -> Column:
    """arr[k:] (1-based), empty when k is past the end."""
    return F.slice(arr, k, F.greatest(F.size(arr) - F.lit(k - 1), F.lit(0)))


# ---- short rows: counted in memory, many rows together

def _words_13a():
    """``tokenize_13a`` of one text. The passes whose matches cannot overlap are made by plain
    replacement: the first class one character at a time; a point or comma without another one
    beside it is set apart unless it stands between digits; a dash is, after a digit."""
    import re

    steps = [(re.compile(p).sub, r.replace("$", "\\")) for p, r in REGEX_13A]
    first = re.compile(REGEX_13A[0][0])
    apart = [(c, f" {c} ") for c in map(chr, range(128)) if first.match(c)]
    beside = re.compile(r"[.,](?:([.,])|(?<=[0-9].)[0-9])")       # another mark, or digits on both sides
    edge = re.compile(r"[.,](?:(?<![0-9].)|(?![0-9]))").sub
    dash = re.compile(r"-(?<=[0-9]-)").sub

    def split(text):
        text = text.rstrip()
        for a, b in REPLACED_13A if "\n" in text or "<" in text else ():
            text = text.replace(a, b)
        for a, b in ENTITIES_13A if "&" in text else ():
            text = text.replace(a, b)
        text = f" {text} "
        for c, r in apart:
            if c in text:
                text = text.replace(c, r)
        found = beside.search(text)
        if found and (found[1] or any(m[1] for m in beside.finditer(text))):
            for sub, r in steps[1:3]:
                text = sub(r, text)
        elif found:
            text = edge(r" \g<0> ", text)
        else:
            text = text.replace(".", " . ").replace(",", " , ")
        return dash(" - ", text).split()
    return split


def _words_pp(text):
    """The chrF++ words of one text: one punctuation mark set apart from each word."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in PUNCTUATION:
            out += (w[:-1], w[-1])
        elif len(w) > 1 and w[0] in PUNCTUATION:
            out += (w[0], w[1:])
        else:
            out.append(w)
    return out


_WHITE = np.array([chr(c).isspace() for c in range(0x3002)])       # white space of str.split()


def _sides(texts, n: int, kind: str, split):
    """(unit, row, side, end, sizes of each side) of ``n`` hypotheses (of each system, if there are
    more) and then ``n`` references: the sides' units as numbers, one text after the other;
    ``end`` is the end of a unit's own text. str.split() and its white space are those of ``py_split``."""
    if split is None:           # characters without white space
        unit = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        white = _WHITE[np.minimum(unit, len(_WHITE) - 1)]
        unit = unit[~white].astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        size -= np.diff(np.searchsorted(np.flatnonzero(white), np.cumsum(size)), prepend=0)
    elif kind == "c":
        texts = list(map(split, texts))
        unit = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
    else:
        texts = list(map(split, texts))
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        unit = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
    sides = len(texts) // n
    row = np.repeat(np.tile(np.arange(n), sides), size)
    side = np.repeat(np.repeat(np.arange(sides), n), size)
    return unit, row, side, np.repeat(np.cumsum(size), size), tuple(size.reshape(sides, n))


def count_matches(unit, row, side, end, n_rows: int, max_n: int) -> np.ndarray:
    """Clipped matches (order, row): for every n-gram of a row the lesser of its two counts."""
    return count_system_matches(unit, row, side, end, n_rows, max_n, 1)[0]


def count_system_matches(unit, row, side, end, n_rows: int, max_n: int, systems: int) -> np.ndarray:
    """Clipped matches (system, order, row) of the hypotheses on sides 0, 1, ... with the
    references, the last side.

    A sort key holds an n-gram's row (later: the number of its first units) and as many units as
    fit, above its side. In sorted keys the n-grams of every order are runs of equal beginnings,
    so one sort serves all orders that fit. An n-gram that the references or all hypotheses lack
    cannot grow into one that counts, so only the others go on to the next key."""
    out = np.zeros((systems, max_n, n_rows), np.int64)
    if not len(unit):
        return out
    width = 63 // (systems + 1)     # bits of a count: those of all sides are one number
    if systems > 1 and len(unit) >> width:
        for s in range(systems):
            of = (side == s) | (side == systems)
            out[s] = count_matches(unit[of], row[of], side[of] // systems, end[of], n_rows, max_n)
        return out
    one = np.int64(1) << width * np.arange(systems + 1)
    # Units from 1 on; max_n - 1 zeros after each text stand for its end.
    seen = np.zeros(int(unit.max()) + 1, np.int64)
    seen[unit] = 1
    code = np.cumsum(seen)
    bits = int(code[-1]).bit_length()
    ends = np.append(np.flatnonzero(end[1:] != end[:-1]) + 1, len(unit))
    at = np.arange(len(unit)) + np.repeat(np.arange(len(ends)) * (max_n - 1), np.diff(ends, prepend=0))
    units = np.zeros(int(at[-1]) + max_n, np.int64)
    units[at] = code[unit]
    side_bits, at_bits = systems.bit_length(), int(at[-1]).bit_length()
    prefix, rows, done = row, np.arange(n_rows), 0
    while done < max_n and len(at):
        free = 63 - len(rows).bit_length() - side_bits
        take = min(max_n - done, free // bits)
        low = 0
        if done + take < max_n:     # the places are needed again
            low, take = at_bits, (free - at_bits) // bits
        if take <= 0:               # a unit does not fit beside the others: pairs get numbers first
            prefix, new = np.unique(np.stack([prefix, units[at + done]]), axis=1, return_inverse=True)
            units_at, rows, prefix, take, shift = prefix[1], rows[prefix[0]], new.reshape(-1), 1, 0
        else:
            units_at, shift = None, bits
        key = prefix
        if units_at is None:
            gram = units[done:len(units) - max_n + done + 1].copy()
            for k in range(done + 1, done + take):
                gram <<= bits
                gram |= units[k:len(gram) + k]
            key = prefix << bits * take | gram[at]
        key = (key << side_bits | side) << low
        if low:
            key |= at
        key.sort()
        # Runs of the longest n-grams with their counts, then of the beginnings of those.
        first = np.searchsorted(rows, np.arange(n_rows + 1))      # a row's first prefix
        head = key >> low + side_bits
        count = one[key >> low & (1 << side_bits) - 1]
        for k in range(take, 0, -1):
            ends = np.append(np.flatnonzero(head[1:] != head[:-1]), len(head) - 1)
            count = np.diff(np.cumsum(count)[ends], prepend=0)
            head = head[ends]
            real = head & (1 << bits) - 1 > 0 if units_at is None else units_at[head] > 0
            refs = (count >> width * systems) * real        # n-grams over a text's end are none
            bound = np.searchsorted(head, first << shift * k)
            has = np.flatnonzero(bound[1:] > bound[:-1])
            for s in range(systems):
                common = np.minimum(count >> width * s & (1 << width) - 1, refs)
                out[s, done + k - 1, has] = np.add.reduceat(common, bound[has])
            if k == take and done + take < max_n:
                both = np.flatnonzero((refs > 0) & (count & (1 << width * systems) - 1 > 0))
                size, kept = np.diff(ends, prepend=-1)[both], rows[head[both] >> shift * k]
                again = key[np.repeat(ends[both] + 1 - np.cumsum(size), size) + np.arange(size.sum())]
            head = head >> shift
        done += take
        if done == max_n:
            break
        at, side = again & (1 << low) - 1, again >> low & (1 << side_bits) - 1
        prefix, rows = np.repeat(np.arange(len(both)), size), kept
    return out


def count_alignment(unit, row, side, end, n_rows: int):
    """METEOR's exact stage: (matches, chunks) per row. The k-th last occurrence of a word in one
    text is aligned with its k-th last in the other; a chunk is a run of matches that are
    neighbours on both sides."""
    if not len(unit):
        return np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    word = np.unique(row * (int(unit.max()) + 1) + unit, return_inverse=True)[1]
    keys, places = [], []
    for s in (0, 1):
        at = np.flatnonzero(side == s)[::-1]           # from the last word on
        at = at[np.argsort(word[at], kind="stable")]
        first = np.ones(len(at), bool)
        first[1:] = word[at[1:]] != word[at[:-1]]
        begin = np.flatnonzero(first)
        occurrence = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        keys.append(word[at] * (len(unit) + 1) + occurrence)
        places.append(at)
    _, a, b = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
    h, r = places[0][a], places[1][b]
    by = np.argsort(h)
    h, r = h[by], r[by]
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1] + 1) & (r[1:] == r[:-1] + 1) & (row[h[1:]] == row[h[:-1]])
    return np.bincount(row[h], minlength=n_rows), np.bincount(row[h[~follows]], minlength=n_rows)


def stat_columns(kinds) -> list[str]:
    out = []
    for k in kinds:
        out += ["t_matches", "t_chunks", "t_hyp", "t_ref"] if k == "t" else [
            f"{k}{x}{n}" for n in range(1, UNITS[k] + 1) for x in ("m", "h", "r")]
    return out


def _blocks(whole, texts):
    """The batch's rows, taken together until their texts hold enough bytes; no more is copied at once."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    block = np.cumsum(size) // BLOCK_BYTES
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
    for lo, hi in zip(cuts, [*cuts[1:], whole.num_rows]):
        yield whole.slice(int(lo), int(hi - lo))


def _short_stats(ev: DataFrame, kinds) -> DataFrame:
    names = stat_columns(kinds)
    # Only texts that are counted here are sent: those of short rows that have a score, as they are for
    # n-grams, lowered for METEOR. Blank rows have counts of 0.
    sent = [(c, F.col(c)) for c in ("_hyp", "_ref") if set(kinds) != {"t"}]
    sent += [(f"{c}_low", F.lower(c)) for c in ("_hyp", "_ref") if "t" in kinds]
    src = ev.select("row_id", "_blank", "_long", *[F.when(~F.col("_long") & ~F.col("_blank"), x).alias(c) for c, x in sent])
    id_type = ev.schema["row_id"].dataType.simpleString()

    def run(batches):
        split = {"w": _words_13a(), "c": None, "p": _words_pp, "t": str.split}
        for whole in batches:
            for b in _blocks(whole, whole.columns[3:5]):
                b = b.filter(pc.invert(b.column(2)))
                n_rows = b.num_rows
                if not n_rows:
                    continue
                texts = [c.fill_null("").to_pylist() for c in b.columns[3:]]
                cols = {}
                for k in kinds:
                    both = texts[-2] + texts[-1] if k == "t" else texts[0] + texts[1]
                    unit, row, side, end, sizes = _sides(both, n_rows, k, split[k])
                    if k == "t":
                        cols["t_matches"], cols["t_chunks"] = count_alignment(unit, row, side, end, n_rows)
                        cols["t_hyp"], cols["t_ref"] = sizes
                        continue
                    m = count_matches(unit, row, side, end, n_rows, UNITS[k])
                    for n in range(1, UNITS[k] + 1):
                        cols[f"{k}m{n}"] = m[n - 1]
                        for x, length in zip(("h", "r"), sizes):
                            cols[f"{k}{x}{n}"] = np.maximum(length - (n - 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(cols[c].astype(np.float64)) for c in names]],
                                                 names=["row_id", "_blank", *names])

    return src.mapInArrow(run, f"row_id {id_type}, _blank boolean, " + ", ".join(f"{c} double" for c in names))


# ---- long rows: cut into segments, counted over the cluster

def _only_long(ev: DataFrame) -> DataFrame:
    """The long rows. Chosen after the exchange of ``eval_frame`` (a filter would be pushed below
    it), so that what makes the texts, and their exchange, run once for short and long rows."""
    def run(batches):
        for b in batches:
            yield b.filter(b.column("_long"))
    return ev.mapInArrow(run, ev.schema)


def _long_rows(long: DataFrame, kind: str) -> DataFrame:
    """(row_id, side, x) of the long rows' units."""
    return long.select("row_id", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), _units(kind, F.col("_hyp")).alias("x")),
        F.struct(F.lit(1).alias("side"), _units(kind, F.col("_ref")).alias("x")))))


def segment_grams(sides: DataFrame, kind: str, parts: int) -> DataFrame:
    """One row per n-gram occurrence: ``row_id, side, n, g``.

    A segment carries the units that its last n-grams reach into; the arrays shifted by
    0..max_n-1 are zipped, so one exploded row per position holds every unit an n-gram
    starting there needs; ``stack`` then emits the n-grams, each as the 128 bits of two hashes of
    its units (grams are only compared within a row)."""
    max_n = UNITS[kind]
    size = F.length("x") if kind == "c" else F.size("x")
    last = F.greatest(F.ceil(size / SEGMENT_UNITS).cast("int") - 1, F.lit(0))
    seg = sides.filter(size > 0).withColumn("seg", F.explode(F.sequence(F.lit(0), last)))
    start, length = F.col("seg") * SEGMENT_UNITS + 1, F.lit(SEGMENT_UNITS + max_n - 1)
    piece = F.substring("x", start, length) if kind == "c" else F.slice("x", start, length)
    seg = seg.select("row_id", "side", "seg", piece.alias("x")).repartition(parts, "row_id", "side", "seg")
    if kind == "c":
        seg = seg.withColumn("x", F.filter(F.split("x", ""), lambda c: c != ""))
    zipped = F.arrays_zip(*[_shifted(F.col("x"), k).alias(f"u{k}") for k in range(1, max_n + 1)])
    at = seg.select("row_id", "side", F.posexplode(zipped).alias("pos", "z")).filter(F.col("pos") < SEGMENT_UNITS)
    args = []
    for n in range(1, max_n + 1):
        units = ", ".join(f"z.u{k}" for k in range(1, n + 1))
        args.append(f"{n}, CASE WHEN z.u{n} IS NOT NULL THEN named_struct('a', xxhash64({units}), 'b', xxhash64(1, {units})) END")
    return (at.select("row_id", "side", F.expr(f"stack({max_n}, {', '.join(args)}) AS (n, g)"))
            .filter(F.col("g").isNotNull()))


def _long_grams(long: DataFrame, kind: str, parts: int) -> DataFrame:
    counts = segment_grams(_long_rows(long, kind), kind, parts).groupBy("row_id", "n", "g").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("h"), F.count(F.when(F.col("side") == 1, 1)).alias("r"))
    counts = counts.withColumn("m", F.least("h", "r"))
    return counts.groupBy("row_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("n") == n, F.col(x))), F.lit(0)).cast("double").alias(f"{kind}{x}{n}")
        for n in range(1, UNITS[kind] + 1) for x in ("m", "h", "r")])


def _long_alignment(long: DataFrame, parts: int) -> DataFrame:
    """``count_alignment`` by shuffles: occurrences are numbered per (row, side, word), paired by
    (row, word, occurrence), and a match is a chunk's first unless the pair before it on
    both sides is a match, too."""
    sides = _long_rows(long, "t")
    lens = sides.groupBy("row_id").agg(*[F.sum(F.when(F.col("side") == s, F.size("x"))).cast("double").alias(c)
                                         for s, c in ((0, "t_hyp"), (1, "t_ref"))])
    occ = sides.select("row_id", "side", F.posexplode("x").alias("pos", "tok")).withColumn(
        "occ", F.row_number().over(Window.partitionBy("row_id", "side", "tok").orderBy(F.desc("pos"))))
    m = (occ.groupBy("row_id", "tok", "occ")
         .agg(F.max(F.when(F.col("side") == 0, F.col("pos"))).alias("hp"),
              F.max(F.when(F.col("side") == 1, F.col("pos"))).alias("rp"))
         .filter(F.col("hp").isNotNull() & F.col("rp").isNotNull()).select("row_id", "hp", "rp"))
    before = m.select("row_id", (F.col("hp") + 1).alias("hp"), (F.col("rp") + 1).alias("rp"), F.lit(1).alias("goes_on"))
    per = m.join(before, ["row_id", "hp", "rp"], "left").groupBy("row_id").agg(
        F.count(F.lit(1)).cast("double").alias("t_matches"),
        F.count(F.when(F.col("goes_on").isNull(), 1)).cast("double").alias("t_chunks"))
    return lens.join(per, "row_id", "left").select(
        "row_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("t_matches", "t_chunks", "t_hyp", "t_ref")])


def _long_stats(ev: DataFrame, kinds) -> DataFrame:
    spark = ev.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    long = _only_long(ev)
    out = long.select("row_id", "_blank")
    for k in kinds:
        out = out.join(_long_alignment(long, parts) if k == "t" else _long_grams(long, k, parts), "row_id", "left")
    return out.select("row_id", "_blank", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in stat_columns(kinds)])


def unit_stats(ev: DataFrame, kinds) -> DataFrame:
    """One row per ``row_id`` with ``_blank`` and the counts of all ``kinds`` of units: for n-grams ``<kind>m<n>``
    (matches), ``<kind>h<n>`` (hypothesis) and ``<kind>r<n>`` (reference); for "t" METEOR's
    matches, chunks and lengths."""
    return _short_stats(ev, kinds).unionByName(_long_stats(ev, kinds))


# ---- several systems with the same references: counted together

class CountedSystem:
    """One system's rows in the counts that ``count_systems`` made; stands for its evaluation table."""

    def __init__(self, counted: DataFrame, system: int, kinds, any_long: bool):
        self.counted, self.system, self.kinds, self.any_long = counted, system, kinds, any_long

    def stats(self, kinds) -> DataFrame:
        """``unit_stats`` of this system's rows."""
        if not set(kinds) <= set(self.kinds):
            raise ValueError(f"counted are {self.kinds}, not {kinds}")
        i = self.system
        rows = self.counted.filter(F.col(f"_own{i}"))
        counts = []
        for k in kinds:
            for n in range(1, UNITS[k] + 1):
                counts.append(F.col(f"{k}m{n}_{i}").cast("double").alias(f"{k}m{n}"))
                for x, size in (("h", f"{k}_{i}"), ("r", f"{k}_ref")):
                    counts.append(F.greatest(F.col(size) - (n - 1), F.lit(0)).cast("double").alias(f"{k}{x}{n}"))
        short = rows.filter(~F.col(f"_long{i}")).select("row_id", F.col(f"_blank{i}").alias("_blank"), *counts)
        if not self.any_long:
            return short
        long = rows.filter(F.col(f"_long{i}")).select(
            "row_id", F.col(f"_hyp{i}").alias("_hyp"), "_ref", F.col(f"_long{i}").alias("_long"),
            F.col(f"_blank{i}").alias("_blank"))
        return short.unionByName(_long_stats(long, kinds))


def count_systems(df: DataFrame, metrics, hyps, ref: str = "reference", own=None) -> list[CountedSystem]:
    """The counts of the named n-gram metrics for several systems (columns ``hyps``) with one reference,
    from one pass over the texts: each text is sent, split and numbered once. ``own``: for each
    system the rows that are its rows (all). Checkpointed; long rows keep their texts there."""
    kinds = list(dict.fromkeys(k for m in metrics for k in METRICS[m][0]))
    cols = ["row_id", F.col(ref).alias("_ref"), *[F.col(h).alias(f"_hyp{i}") for i, h in enumerate(hyps)]]
    for i, h in enumerate(hyps):
        cols += [c.alias(f"{name}{i}") for name, c in zip(("_long", "_blank"), _marks(h, ref))]
        cols.append((own[i] if own else F.lit(True)).alias(f"_own{i}"))
    ev = _dealt(df.select(*cols))
    systems = range(len(hyps))
    flags = [f"{x}{i}" for i in systems for x in ("_long", "_blank", "_own")]
    texts = [*[f"_hyp{i}" for i in systems], "_ref"]
    # A blank row's text is not sent.
    used = {f"_hyp{i}": ~F.col(f"_blank{i}") for i in systems}
    used["_ref"] = ~F.expr(" and ".join(f"_blank{i}" for i in systems))
    ev = ev.select("row_id", *flags, *[F.when(used[c], F.col(c)).alias(c) for c in texts])
    names = [x for k in kinds for x in [f"{k}_ref", *[y for i in systems for y in [
        f"{k}_{i}", *[f"{k}m{n}_{i}" for n in range(1, UNITS[k] + 1)]]]]]
    n_flags = len(flags)

    def run(batches):
        split = {"w": _words_13a(), "c": None, "p": _words_pp}
        for whole in batches:
            for b in _blocks(whole, whole.columns[1 + n_flags:]):
                n_rows = b.num_rows
                if not n_rows:
                    continue
                long = [b.column(f"_long{i}").to_numpy(zero_copy_only=False).astype(bool) for i in systems]
                some = np.logical_or.reduce(long)
                sent = [b.column(c).to_pylist() for c in texts]
                # A long hypothesis is not counted here, nor is a reference of long ones only.
                both = [x if x is not None and not skip else "" for c, flag in zip(sent, [*long, np.logical_and.reduce(long)])
                        for x, skip in zip(c, flag)]
                out = {}
                for k in kinds:
                    unit, row, side, end, sizes = _sides(both, n_rows, k, split[k])
                    m = count_system_matches(unit, row, side, end, n_rows, UNITS[k], len(hyps))
                    out[f"{k}_ref"] = sizes[-1]
                    for i in systems:
                        out[f"{k}_{i}"] = sizes[i]
                        for n in range(1, UNITS[k] + 1):
                            out[f"{k}m{n}_{i}"] = m[i, n - 1]
                kept = [pa.array([x if k else None for x, k in zip(c, some)], pa.string()) for c in sent]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:1 + n_flags], *kept, *[pa.array(out[c].astype(np.int32)) for c in names]],
                    names=["row_id", *flags, *texts, *names])

    id_type = ev.schema["row_id"].dataType.simpleString()
    counted = ev.mapInArrow(run, f"row_id {id_type}, " + ", ".join(
        [*[f"{c} boolean" for c in flags], *[f"{c} string" for c in texts], *[f"{c} int" for c in names]]))
    counted = counted.checkpoint(eager=True)
    any_long = [bool(counted.filter(F.col(f"_long{i}")).limit(1).count()) for i in systems]
    return [CountedSystem(counted, i, kinds, any_long[i]) for i in systems]


def _summed(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in stats.columns if c not in ("row_id", "_blank")])


def bleu_from_counts(kind: str = "w") -> Column:
    """Close BLEU from pivoted counts ``wm1..4`` (matches) and ``wh1..4`` (hyp n-grams);
    ``wh1``/``wr1`` are the hypothesis and reference lengths."""
    logs, zeros = [], F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        c, t = F.col(f"{kind}m{n}"), F.col(f"{kind}h{n}")
        zeros = zeros + F.when(c == 0, 1).otherwise(0)
        p = F.when(c > 0, F.lit(100.0) * c / t).otherwise(F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t))
        logs.append(F.log(p))
    sys_len, ref_len = F.col(f"{kind}h1"), F.col(f"{kind}r1")
    bp = F.when(sys_len < ref_len, F.exp(F.lit(1.0) - ref_len / sys_len)).otherwise(F.lit(1.0))
    any_match = sum((F.col(f"{kind}m{n}") for n in range(1, BLEU_ORDER + 1)), F.lit(0.0)) > 0
    score = bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / F.lit(float(BLEU_ORDER)))
    return F.when((F.col(f"{kind}h{BLEU_ORDER}") > 0) & any_match, score).otherwise(F.lit(0.0))


def chrf_from_counts(orders: list[tuple[str, int]], beta: float = CHRF_BETA) -> Column:
    """Close chrF from pivoted counts over the given (kind, n) orders."""
    eff, sp, sr = F.lit(0), F.lit(0.0), F.lit(0.0)
    for kind, n in orders:
        m, h, r = F.col(f"{kind}m{n}"), F.col(f"{kind}h{n}"), F.col(f"{kind}r{n}")
        both = (h > 0) & (r > 0)
        eff = eff + F.when(both, 1).otherwise(0)
        sp = sp + F.when(both, m / h).otherwise(F.lit(0.0))
        sr = sr + F.when(both, m / r).otherwise(F.lit(0.0))
    ap = F.when(eff > 0, sp / eff).otherwise(F.lit(0.0))
    ar = F.when(eff > 0, sr / eff).otherwise(F.lit(0.0))
    f = F.lit(beta * beta)
    score = F.lit(100.0) * (F.lit(1.0) + f) * ap * ar / (f * ap + ar)
    return F.when(ap + ar > 0, score).otherwise(F.lit(0.0))


CHRF_ORDERS = [("c", n) for n in range(1, CHRF_CHAR_ORDER + 1)]
CHRFPP_ORDERS = CHRF_ORDERS + [("p", n) for n in range(1, CHRF_WORD_ORDER + 1)]


def _ws() -> str:
    from pairmine.functions.scalar import WS_CLASS
    return f"{WS_CLASS}+"


def meteor_from_counts() -> Column:
    """Close METEOR from ``t_matches``, ``t_chunks`` and the two lengths."""
    mt = F.col("t_matches")
    prec, rec = mt / F.col("t_hyp"), mt / F.col("t_ref")
    alpha = F.lit(METEOR_ALPHA)
    fmean = prec * rec / (alpha * prec + (F.lit(1.0) - alpha) * rec)
    penalty = F.lit(METEOR_GAMMA) * F.pow(F.col("t_chunks") / mt, F.lit(METEOR_BETA))
    return F.when(mt > 0, (F.lit(1.0) - penalty) * fmean).otherwise(F.lit(0.0))


# Metric -> (units that it counts, formula over the counts).
METRICS = {
    "bleu": (("w",), bleu_from_counts),
    "chrf": (("c",), lambda: chrf_from_counts(CHRF_ORDERS)),
    "chrf_pp": (("c", "p"), lambda: chrf_from_counts(CHRFPP_ORDERS)),
    "meteor": (("t",), meteor_from_counts),
}


def metric_rows(df: DataFrame, metrics, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """``row_id`` and the named metrics, all of them from one pass over the texts. ``df`` is an
    evaluation table, here and in the functions for one metric, or a system that ``count_systems`` counted."""
    kinds = list(dict.fromkeys(k for m in metrics for k in METRICS[m][0]))
    stats = df.stats(kinds) if isinstance(df, CountedSystem) else unit_stats(eval_frame(df, hyp, ref), kinds)
    score = lambda m: F.when(~F.col("_blank"), F.coalesce(METRICS[m][1](), F.lit(0.0))).alias(m)
    return stats.select("row_id", *[score(m) for m in metrics])


def bleu_rows(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per-row BLEU (0-100)."""
    return metric_rows(df, ["bleu"], hyp, ref)


def chrf_rows(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per-row chrF (0-100)."""
    return metric_rows(df, ["chrf"], hyp, ref)


def chrf_pp_rows(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per-row chrF++ (characters 1..6 and words 1..2)."""
    return metric_rows(df, ["chrf_pp"], hyp, ref)


def meteor_rows(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per-row METEOR, exact-match stage."""
    return metric_rows(df, ["meteor"], hyp, ref)


def _corpus(df: DataFrame, metric: str, hyp: str, ref: str) -> DataFrame:
    """E5: counts summed over all rows, then the formula. Rows with a blank reference are
    left out, as in the per-row evaluation."""
    ev = eval_frame(df.filter(F.col(ref).isNotNull() & (py_strip(F.col(ref)) != "") & F.col(hyp).isNotNull()),
                    hyp, ref)
    kinds, formula = METRICS[metric]
    return _summed(unit_stats(ev, kinds)).select(formula().alias(metric))


def corpus_bleu(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """E5: corpus BLEU."""
    return _corpus(df, "bleu", hyp, ref)


def corpus_chrf(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """E5: corpus chrF."""
    return _corpus(df, "chrf", hyp, ref)


def metric_means(scores: DataFrame, cols: list[str]) -> DataFrame:
    """NaN/NULL-ignoring mean of each metric column."""
    return scores.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"mean_{c}") for c in cols])


def compare_runs(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Two evaluations of the same rows joined on ``row_id``; per-row deltas (b - a)."""
    x = a.select("row_id", *[F.col(c).alias(f"{c}_a") for c in cols]).join(
        b.select("row_id", *[F.col(c).alias(f"{c}_b") for c in cols]), "row_id")
    return x.select("row_id", *[f"{c}_a" for c in cols], *[f"{c}_b" for c in cols],
                    *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"delta_{c}") for c in cols])


def evaluate_table(df: DataFrame, hyp: str = "prediction", ref: str = "reference",
                   model_metrics: dict | None = None, src: str | None = None) -> DataFrame:
    """The input rows with BLEU, chrF and METEOR (and model metrics when plug-ins
    are given: name -> scorer(src, hyp, ref) batch function, M4)."""
    out = df.join(metric_rows(df, ["bleu", "chrf", "meteor"], hyp, ref), "row_id", "left")
    for name, fn in (model_metrics or {}).items():
        from pairmine.operators.models import model_metric
        out = out.join(model_metric(df, fn, name, src, hyp, ref), "row_id", "left")
    return out

