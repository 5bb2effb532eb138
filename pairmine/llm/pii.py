"""Personal data by bootstrapped contextual extraction.

1. Base detectors find e-mail addresses, IP addresses, card and phone numbers, and
   quoted secrets; these are the seeds. Candidates are all other tokens with four digits or
   more, digit groups parted by spaces, brackets, dots or hyphens (4 to 20 digits), and
   tokens with an @.
2. Seeds and candidates induce lexical patterns: the word before, the two words before,
   and the words on both sides, each with the token's shape (digits, letters, @), once
   without and once with its separators.
3. The pattern-instance graph is scored iteratively. A pattern's score for a kind is the
   weight of its instances of that kind over all its distinct instances, once enough of
   them support it; an instance's score is the noisy-or of its patterns' scores.
4. Candidates whose score and pattern are sure enough become spans of that kind, and so do
   all occurrences of a seed's instance in any other context. Separators make no difference
   to the instance of a number, and runs as long as a secret are looked up as well.

The graph holds distinct (pattern, instance) edges, is aggregated map-side and joined by
shuffles; nothing but row counts reaches the driver. Base spans always stay, added spans
never overlap them; of added spans that overlap each other the longest stays.

Edge cases: null text is empty; rows are matched by (doc_id, hash of the text), so
repeated rows get the same spans and null ids work; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import checked_broadcast, staged

# The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]
SEED_KINDS = KINDS + ["secret"]

ROUNDS = 3
MIN_SUPPORT = 4.0        # weight of the instances that a pattern needs
MIN_PATTERN = 0.6        # score from which a pattern passes its kind on
SURE = 0.8               # score an instance and one of its patterns need
CONTEXT = 64             # characters looked at on either side
MAX_BROADCAST_TEXTS = 20_000   # texts with added spans that may be broadcast

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?:api[_-]?key|secret|token|password|passwd)[\"']?[ \t]?[:=][ \t]?[\"']?([A-Za-z0-9_/+-]{16,})",
                     re.IGNORECASE)
_CANDIDATE = re.compile(r"[0-9][0-9A-Za-z._%+@/-]{3,}")
_TOKEN = re.compile(r"[0-9A-Za-z_%+@/-]")
_GROUPS = re.compile(r"(?<![0-9A-Za-z@_])[+(]{0,2}[0-9]++(?:[ ().-]{1,3}+[0-9]++)+(?![0-9A-Za-z@_])")
_RUN = re.compile(r"[A-Za-z0-9_/+-]{16,}")      # whatever could be a secret
_SEPARATORS = str.maketrans("", "", " ()+-")     # dots stay: they are part of an IP address
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text):
    """Each @ with its run of local characters back to the last match, and its domain."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted."""
    out = [(a, 0, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _instance(token: str) -> str:
    """What occurrences of one identifier have in common."""
    return token if "@" in token or any(c.isalpha() for c in token) else token.translate(_SEPARATORS)


def _shapes(token: str) -> list[str]:
    """The shape without separators and, if there are any, the one with them."""
    if "@" in token:
        return ["@"]
    digits = sum(c.isdigit() for c in token)
    size = "4" if digits < 8 else "8" if digits < 12 else "12" if digits < 20 else "20"
    plain = size + ("a" if any(c.isalpha() for c in token) else "")
    marks = "".join(sorted(set(c for c in token if not c.isalnum())))
    return [plain, plain + marks] if marks else [plain]


def _patterns(text, start, end):
    before = _WORD.findall(text[max(0, start - CONTEXT):start])[-2:]
    after = _WORD.search(text, end, end + CONTEXT)
    if not before:
        return []
    last = before[-1].lower()
    out = [f"{last} _"]
    if len(before) == 2:
        out.append(f"{before[0].lower()} {last} _")
    if after:
        out.append(f"{last} _ {after.group().lower()}")
    return [f"{words}|{shape}" for shape in _shapes(text[start:end]) for words in out]


def _number_tokens(text):
    at = 0
    while m := _CANDIDATE.search(text, at):
        a, z = m.span()
        while a > at and _TOKEN.match(text[a - 1]):
            a -= 1
        at = z
        while text[z - 1] in "._%+@/-":
            z -= 1
        if sum(c.isdigit() for c in text[a:z]) >= 4:
            yield a, z


def _number_groups(text):
    for m in _GROUPS.finditer(text):
        a, z = m.span()
        if 4 <= sum(c.isdigit() for c in m.group()) <= 20:
            yield a + (text[a] == "(" and ")" not in m.group()), z


def _at_tokens(text):
    """Each run of word characters and ._%+@/- that holds an @."""
    at = last = 0
    while (at := text.find("@", at)) >= 0:
        a = z = at
        while a > last and (text[a - 1].isalnum() or text[a - 1] in "._%+-/"):
            a -= 1
        while z < len(text) and (text[z].isalnum() or text[z] in "._%+-/@"):
            z += 1
        at = last = z
        while z > a and text[z - 1] in "._%+-/@":
            z -= 1
        while a < z and text[a] in "._%+-/":
            a += 1
        if "@" in text[a:z]:
            yield a, z


def occurrences(text: str, base) -> list[dict]:
    """Seeds (kind set) and candidates (kind null) with the patterns around them; runs that
    are only looked up among the seeds have none."""
    found = [(a, z, KINDS[k]) for a, k, z in base]
    taken = _Taken((a, z) for a, z, _ in found)
    secrets = [m.span(1) for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []
    found += [(a, z, "secret") for a, z in secrets if not taken.overlaps(a, z)]
    taken = _Taken((a, z) for a, z, _ in found)
    spans = {s for f in (_number_tokens, _number_groups, _at_tokens) for s in f(text) if not taken.overlaps(*s)}
    found += [(a, z, None) for a, z in sorted(spans)]
    runs = [m.span() for m in _RUN.finditer(text)]
    return ([{"kind": k, "start": a, "end": z, "instance": _instance(text[a:z]), "patterns": _patterns(text, a, z)}
             for a, z, k in found]
            + [{"kind": None, "start": a, "end": z, "instance": _instance(text[a:z]), "patterns": []}
               for a, z in runs if (a, z) not in spans and not taken.overlaps(a, z)])


def _apart(added) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the added spans; of those that overlap the longest."""
    out, group, reach = [], [], 0

    def close():
        taken = []
        for a, k, z in sorted(group, key=lambda s: (s[0] - s[2], s)):
            if all(z <= b or y <= a for b, _, y in taken):
                taken.append((a, k, z))
        out.extend(sorted(taken))
        group.clear()

    for a, k, z in sorted((s["start"], SEED_KINDS.index(s["kind"]), s["end"]) for s in (added if added is not None else ())):
        if a >= reach:
            close()
        group.append((a, k, z))
        reach = max(reach, z)
    close()
    return out


class _Taken:
    """Spans that may overlap each other, asked whether they overlap another one."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((z for _, z in spans), max))    # the furthest end so far

    def overlaps(self, a: int, z: int) -> bool:
        i = bisect_left(self.starts, z)      # the spans before i start before z
        return i > 0 and self.ends[i - 1] > a


_OCC = "array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>"
_FOUND = f"doc_id long, key long, base array<struct<start:int,kind:int,end:int>>, occ {_OCC}"


def _extract(batches):
    occ_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        base, occ = [], []
        for text in b.column(2).to_pylist():
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": z} for a, k, z in spans])
            occ.append(occurrences(text, spans))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, base_type), pa.array(occ, occ_type)],
                                         names=["doc_id", "key", "base", "occ"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, key, added): added spans per text, from the staged extraction."""
    occ = (found.select("doc_id", "key", F.explode("occ").alias("o")).select("doc_id", "key", "o.*")
           .withColumn("pattern", F.explode_outer("patterns")).drop("patterns"))
    edges = staged(occ.filter("pattern is not null").groupBy("pattern", "instance")
                   .agg(F.max("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = (occ.filter("kind is not null").select("instance", "kind").distinct()
             .withColumn("w", F.lit(1.0)))
    seeds = staged(seeds, "seeds")
    scored, patterns = seeds, None
    for _ in range(rounds):
        patterns = (edges.select("pattern", "instance").join(scored, "instance")
                    .groupBy("pattern", "kind").agg(F.sum("w").alias("weight"))
                    .filter(F.col("weight") >= MIN_SUPPORT).join(sizes, "pattern")
                    .withColumn("score", F.col("weight") / F.col("total"))
                    .filter(F.col("score") >= MIN_PATTERN).select("pattern", F.col("kind").alias("to"), "score"))
        patterns = staged(patterns, "patterns")
        reached = (edges.filter("kind is null").join(patterns, "pattern").groupBy("instance", "to")
                   .agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)))))).alias("w")))
        best = (reached.groupBy("instance").agg(F.max(F.struct("w", "to")).alias("b"))
                .select("instance", F.col("b.to").alias("kind"), F.col("b.w").alias("w")))
        scored = staged(seeds.unionByName(best.join(seeds.select("instance").distinct(), "instance", "left_anti")),
                        "scores")
    sure = scored.filter(F.col("w") >= SURE).select("instance", F.col("kind").alias("to"))
    new = (occ.filter("kind is null").join(patterns.filter(F.col("score") >= SURE), "pattern")
           .join(sure, ["instance", "to"]).select("doc_id", "key", "start", "end", F.col("to").alias("kind")))
    known = (occ.filter("kind is null").select("doc_id", "key", "start", "end", "instance").distinct()
             .join(seeds.select("instance", "kind"), "instance").select("doc_id", "key", "start", "end", "kind"))
    secret = occ.filter("kind = 'secret'").select("doc_id", "key", "start", "end", "kind")
    return (new.unionByName(known).unionByName(secret).groupBy("doc_id", "key")
            .agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")))


def _spans_columns(batches):
    for b in batches:
        cols = [[] for _ in range(6)]
        for base, added in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            spans = [(s["start"], s["kind"], s["end"]) for s in base]
            line = ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)
            every = sorted(spans + _apart(added))
            for col, v in zip(cols, (*(sum(k == i for _, k, _ in spans) for i in range(4)),
                                     hashlib.sha256(line.encode()).hexdigest(),
                                     ",".join(f"{SEED_KINDS[k]}:{a}:{z}" for a, k, z in every))):
                col.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                         names=["doc_id", "n_email", "n_ip", "n_card", "n_phone",
                                                "base_sha256", "spans"])


def detect(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""
    found = staged(_keyed(docs).mapInArrow(_extract, _FOUND), "pii")
    added = discover(found, rounds).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = found.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return rows.select("doc_id", "base", "added").mapInArrow(
        _spans_columns, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                        "base_sha256 string, spans string")


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (all columns) with every span of the text replaced by [KIND]; a null text
    stays null, a column n_chars follows the changed texts. Overlapping spans are replaced
    as one, under the first one's kind."""
    found = staged(_keyed(docs).mapInArrow(_extract, _FOUND), "pii")
    added = checked_broadcast(staged(discover(found, rounds), "added"), MAX_BROADCAST_TEXTS)
    added = added.select(F.col("doc_id").alias("_pii_id"), F.col("key").alias("_pii_key"), F.col("added").alias("_pii_added"))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for text, extra in zip(texts, more):
            if text is None:
                out.append(None)
                continue
            spans = [(a, z, KINDS[k]) for a, k, z in base_spans(text)]
            spans += [(a, z, SEED_KINDS[k]) for a, k, z in _apart(extra)]
            parts, at = [], 0
            for a, z, kind in sorted(spans):
                if a >= at:
                    parts += [text[at:a], f"[{kind.upper()}]"]
                at = max(at, z)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_pii_text_key", key).join(
        added, F.col("doc_id").cast("long").eqNullSafe(F.col("_pii_id")) & (F.col("_pii_text_key") == F.col("_pii_key")), "left")
    rows = rows.withColumn("_pii_text", replaced(F.col("text"), F.col("_pii_added")))
    changed = ~F.col("_pii_text").eqNullSafe(F.col("text"))
    put = {"text": F.col("_pii_text").alias("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(changed, F.length("_pii_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*[put.get(c, F.col(f"`{c}`")) for c in docs.columns])
