"""Small fixtures and plain Python versions that the operators are held against."""

from __future__ import annotations

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Nulls, empty and white-space texts, ties, repeated rows, ids out of order, odd characters.
EDGE = [
    (7, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (9, "one two three four five six", "en", "b", 27),
    (2, "one two three four five six", "en", "b", 27),
    (9, "one two three four five six", "en", "b", 27),
    (None, "no id here: call +1 (234) 555-0199 now", "de", "c", 10),
    (11, "É ÀK ﬀ 　 mixed\x1cspaces\x85 end" * 3, "fr", "é", 40),
    (12, "word " * 30000, "en", "a", 150000),
]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:      # columns that clash with names the operators use inside
        from pyspark.sql import functions as F
        for c in ("rep", "fp", "size", "rank", "label", "score", "key", "copies", "t", "pos", "rate"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(n_docs: int, seed: int, words=400):
    """Random prose with shared passages and near copies."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9))) for _ in range(words)]
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    rows = []
    for i in range(n_docs):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 160))]
        if rnd.random() < 0.4:
            w.insert(rnd.randint(0, len(w)), passage)
        text = " ".join(w)
        if rows and rnd.random() < 0.3:
            text = rnd.choice(rows)[1] or ""
            if rnd.random() < 0.6 and text:
                at = rnd.randrange(len(text))
                text = text[:at] + rnd.choice(["x", "", "é", "\n"]) + text[at + 1:]
        rows.append((i * 3 % (4 * n_docs), text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", None]), len(text)))
    rnd.shuffle(rows)
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text, k=4):
    import xxhash
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, radius=4):
    fps = [simhash(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    with_id = [i for i in range(len(rows)) if rows[i][0] is not None]
    for i in with_id:
        for j in with_id:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i in with_id:
        low[find(i)] = min(low.get(find(i), 1 << 62), rows[i][0])
    by_fp = {fps[i]: low[find(i)] for i in with_id}
    return sorted(((str(rows[i][0]), f"{fps[i]:016x}", str(by_fp.get(fps[i]))) for i in range(len(rows))))


def phrase_scan(text, phrases):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for label, p in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
            ",".join(sorted({label for _, label in hits})))


def rule_counts(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii_base(text):
    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0
    out = []
    for k, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return [f"{PII[k][0]}:{a}:{z}" for a, k, z in sorted(out)]


def substring_dedup(rows, length=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1 if i is not None else 0):
            w = b[s:s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1 if i is not None else 0):
            if first[b[s:s + length]] < i:
                cover[s:s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((str(i), len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, *cols):
    return sorted(tuple(str(r[c]) if c.endswith("_id") or c == "doc_id" else r[c] for c in cols) for r in df.collect())
