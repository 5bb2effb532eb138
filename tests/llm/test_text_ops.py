"""op2 license scan, op4 quality rules, op9 PII against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pairmine.llm import licenses, pii, rules
from pairmine.llm.common import table
from tests.llm import util

LICENCE_TEXTS = [
    "Licensed under CC BY-NC 4.0. All rights reserved. all RIGHTS reserved",
    "This work is licensed under the GNU General Public License, version 3. cc by cc by",
    "Permission is hereby granted, free of charge, to any person getting a copy of the software and associated "
    "documentation files",
    "cc. By; bacK cc bY ccby cc-by", "all rights of the reserved general public", "", None, "cc",
    "permission is the of the of the of the of the of the software",
]


def test_license_scan_counts_every_phrase_place(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(LICENCE_TEXTS, 1000)] + util.EDGE
    out = licenses.scan(util.frame(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"])
                   for r in out)
    plain = []
    for i, t, *_ in rows:
        n, k, a, z, names = util.phrase_scan(t, licenses.PHRASES)
        plain.append((str(i), n, k, str(a), str(z), names))
    assert found == sorted(plain)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1000]["labels"] == "cc-by,cc-by-nc,reserved" and by_id[1000]["score"] == 1.0
    assert by_id[1002]["labels"] == "mit" and 0.7 <= by_id[1002]["score"] < 1      # two words differ
    assert by_id[1008]["labels"] == ""
    assert licenses.scan(util.frame(spark, [])).count() == 0


def test_license_scan_tells_near_neighbours_apart(spark):
    cc = "This text is licensed under a Creative Commons {} 4.0 International License."
    texts = {cc.format("Attribution"): "cc-by", cc.format("Attribution-NonCommercial"): "cc-by-nc",
             cc.format("Attribution-ShareAlike"): "cc-by-sa", cc.format("Attribution-NoDerivatives"): "cc-by-nd",
             cc.format("Attribution-NonCommercial-ShareAlike"): "cc-by-nc-sa",
             cc.format("Attribution-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
             "Licensed under the Apache License, Version 1.1": "", "Licensed under the Apache License, Version 2.0": "apache-2.0",
             "Licensed under CC0 1.0": "cc0",
             "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",    # holds the phrase cc by
             "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
             "This work is licensed under the GNU Lesser General Public License": "gpl,lgpl",           # and these the phrase of gpl
             "This work is licensed under the GNU Affero General Public License": "agpl,gpl",
             "This work is licensed under the GNU General Public License": "gpl"}
    out = licenses.scan(util.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    assert {t: next(r["labels"] for r in out if r["doc_id"] == i) for i, t in enumerate(texts)} == texts


def test_license_scan_is_native(spark):
    plan = licenses.scan(util.frame(spark, util.EDGE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rule_counts_match_plain_python(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([
        "a a a a", "a b c a b c", "a b c d a b", "x\nx\n\nx\n \n \ny", "#*$%&|<> ab", "ab ab ab\nab ab ab"])]
    rows += util.EDGE + util.prose(60, 3)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = rules.apply_rules(util.frame(spark, rows, extra=True), labels).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[c] for c in cols)) for r in out) == \
        sorted((str(i), *util.rule_counts(t)) for i, t, *_ in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert rules.apply_rules(util.frame(spark, []), labels.limit(0)).count() == 0


def test_binomial_bound_is_exact(spark):
    cases = [(500, 0, 0.01), (2000, 10, 0.01), (100000, 900, 0.01), (50, 1, 0.04)]
    for n, k, p in cases:
        row = spark.range(1).select(rules.log_binomial_cdf(F.lit(float(n)), F.lit(k).cast("long"), p).alias("x")).first()
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
                for i in range(k + 1)]
        top = max(logs)
        assert row["x"] == pytest.approx(top + math.log(sum(math.exp(x - top) for x in logs)), rel=1e-9)


RULE_ROWS = ("stratum string, n_words long, word_chars long, n_symbols long, n_lines long, "
             "n_dup_lines long, n_repeat_words long, n_capitals long")


def plain_levels(rows, limit=0.04, delta=0.05):
    """{stratum: level} of the joint test, by plain counting."""
    def rejected(r, j):
        _, words, chars, symbols, lines, dup, repeats, capitals = r
        ratios = (symbols / max(words, 1), dup / max(lines, 1), repeats / max(words, 1), capitals / max(chars, 1))
        return any(x > grid[j] for x, (_, _, grid) in zip(ratios, rules.RULES))
    strata = {}
    for r in rows:
        strata.setdefault(r[0], []).append(r)
    tested = {}
    for s, group in strata.items():
        own = (1 - limit) ** len(group) <= delta / len(strata)
        tested.setdefault(s if own else None, []).extend(group)
    level = {}
    for t, group in tested.items():
        best, n = None, len(group)
        for j in range(len(rules.RULES[0][2])):
            k = sum(rejected(r, j) for r in group)
            p = sum(math.comb(n, i) * limit ** i * (1 - limit) ** (n - i) for i in range(k + 1)) if k < n * limit else 1.0
            if p > delta / len(tested):
                break
            best = j
        level[t] = best
    return {s: level[s if s in level else None] for s in strata}


def test_levels_are_certified_jointly_and_small_strata_pooled(spark):
    rnd = random.Random(7)
    sizes = {"en": 900, "de": 300, "fr": 70, "es": 60, "it": 5, "": 2}
    rows = [(s, 100, 500, rnd.choice([0, 0, 0, 3, 12, 60]) if rnd.random() < 0.15 else 0, 10, int(rnd.random() < 0.1),
             rnd.randint(0, 18), rnd.randint(0, 150) if s == "de" else 3) for s, n in sizes.items() for _ in range(n)]
    out = {r["stratum"]: r for r in rules.levels(spark.createDataFrame(rows, RULE_ROWS)).collect()}
    assert {s: r["level"] for s, r in out.items()} == plain_levels(rows)
    assert {s for s, r in out.items() if r["tested"] is None} == {"fr", "es", "it", ""}
    assert {r["n"] for s, r in out.items() if r["tested"] is None} == {137}
    few = spark.createDataFrame(rows[-60:], RULE_ROWS)
    assert {r["level"] for r in rules.levels(few).collect()} == {None}          # the pool is too small as well
    assert rules.levels(few.limit(0)).count() == 0


def test_false_rejections_stay_limited_on_rows_not_used_for_the_choice(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    half = labels.filter("crc32(cast(doc_id as string)) % 2 = 0")
    kept = rules.apply_rules(docs, half).join(labels.join(half, "doc_id", "left_anti"), "doc_id").join(
        docs.select("doc_id", "lang"), "doc_id").filter("NOT base_failed").select("lang", "quality", "kept").collect()
    for lang in {r["lang"] for r in kept}:
        good = [r["kept"] for r in kept if r["lang"] == lang and r["quality"] == 1]
        bad = [r["kept"] for r in kept if r["lang"] == lang and r["quality"] == 0]
        assert good.count(False) <= 0.04 * len(good) + 3 * (0.04 * 0.96 * len(good)) ** 0.5
        print(lang, "good rejected", good.count(False), "of", len(good), "junk kept", bad.count(True), "of", len(bad))
        assert not bad or bad.count(False) > 0      # the rules decide something in every language


PII_TEXTS = [
    "a@b.c x.y+z@d-e.f.g @@ a@b foo@bar..com q@w.e.", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.4 1.2.3", "me@1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 411111111111111100", "+1 (234) 555-0199 +49.30.1234567 +12 +1 2",
    "5@5.5 " * 40, "x" * 3000 + "@", "9" * 3000, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "é+1 234 567 890é",
]


def test_pii_base_spans_match_the_patterns(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(PII_TEXTS, 1000)] + util.EDGE
    out = pii.detect(util.frame(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    plain = sorted((str(i), hashlib.sha256(",".join(util.pii_base(t)).encode()).hexdigest(),
                    *(sum(x.startswith(k) for x in util.pii_base(t)) for k, _ in util.PII)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in out) == plain
    for r in out:
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        assert set(util.pii_base(text)) <= set(r["spans"].split(",")) | {""}
    assert pii.detect(util.frame(spark, [])).count() == 0


def _bootstrap_rows():
    rows, n = [], 4000000000000000
    cards = []
    while len(cards) < 12:
        n += 7
        if pii.luhn(str(n)):
            cards.append(str(n))
    rows += [(i, f"please charge visa {c} today", "en", "s", 1) for i, c in enumerate(cards, 1000)]
    rows.append((100, "please charge visa 4000000000000001 today", "en", "s", 1))     # fails the check digit
    rows.append((101, "the library holds 4000000000000001 books and 4321 chairs", "en", "s", 1))
    rows.append((102, "counted 4000000000000009 grains", "en", "s", 1))
    return rows


def test_pii_patterns_discover_unseen_identifiers(spark):
    out = {r["doc_id"]: r["spans"] for r in pii.detect(util.frame(spark, _bootstrap_rows())).collect()}
    assert out[100] == "card:19:35"
    assert out[102] == "" and "4321" not in out[101]


def test_pii_discovers_spaced_numbers_addresses_and_known_instances(spark):
    texts = [f"please ring me on +1 (2{i}) 555-01{i} tonight" for i in range(10, 20)]
    texts += [f"write to user{i}@mail.example.com about it" for i in range(10)]
    n = 4000000000000000
    while len(texts) < 30:
        n += 7
        if pii.luhn(str(n)):
            texts.append("paid with visa {} {} {} {} today".format(*(str(n)[i:i + 4] for i in range(0, 16, 4))))
    texts += ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "password: correcthorsebatterystaple"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    odd = {100: ("please ring me on (299) 555-0142 tonight", ["phone"], ["(299) 555-0142"]),      # no +
           101: ("write to carol@intranet about it", ["email"], ["carol@intranet"]),                # no dot, no digit
           102: ("paid with visa 4000 0000 0000 0001 today", ["card"], ["4000 0000 0000 0001"]),    # fails the check digit
           103: ("found 24be64439e3e49cf46b2d7c90f3602a3d0b907ff lying around", ["secret"],
                 ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]),
           104: ("he said correcthorsebatterystaple twice", ["secret"], ["correcthorsebatterystaple"]),
           105: ("number 1 210 555 0110 is engaged", ["phone"], ["1 210 555 0110"]),              # a seed, other separators
           106: ("in 2019 2020 and 1234567 there were 12 @ 5", [], [])}
    rows += [(i, t, "en", "s", 1) for i, (t, *_) in odd.items()]
    out = {r["doc_id"]: r["spans"] for r in pii.detect(util.frame(spark, rows)).collect()}
    for i, (text, kinds, parts) in odd.items():
        spans = [s.split(":") for s in out[i].split(",") if s]
        assert [k for k, *_ in spans] == kinds, (text, spans)
        assert [text[int(a):int(z)] for _, a, z in spans] == parts


def test_redact_replaces_spans_and_keeps_rows(spark):
    rows = _bootstrap_rows() + util.EDGE + [(200, "mail a@b.co, ip 10.0.0.1!", "en", "s", 25)]
    out = pii.redact(util.frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    assert sum(map(len, got.values())) == len(rows)
    assert got[200] == [("mail [EMAIL], ip [IP]!", 22)]
    assert got[100][0][0] == "please charge visa [CARD] today"
    assert got[None][0][0] == "no id here: call [PHONE] now"
    assert got[7] == [(None, None)] and got[12][0][1] == 150000


def _duck(rows, name):
    """The operator's DuckDB query over ``rows`` of documents."""
    import duckdb
    import pandas as pd
    from pairmine.llm.oracle import SQL
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})  # noqa: F841
    labels = pd.DataFrame([(0, 1, 0)], columns=["doc_id", "quality", "toxic"])  # noqa: F841
    rel = duckdb.sql(SQL[name])
    return rel.columns, rel.fetchall()


def test_license_scan_equals_its_sql_on_near_notices(spark):
    rnd = random.Random(11)
    notices = [t for _, t in licenses.TEMPLATES + licenses.NEAR_TEMPLATES + licenses.PHRASES]
    texts = list(notices) + LICENCE_TEXTS + ["Licensed under the Apache License, Version 1.1"]
    for _ in range(400):         # words lost, changed, inserted, notices one after the other
        w = " and ".join(rnd.sample(notices, rnd.randint(1, 2))).split()
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(w) + 1)
            w[at:at + rnd.randint(0, 2)] = [rnd.choice(["the", "ShareAlike", "NonCommercial", "2.0", "GNU", "x"])] * rnd.randint(0, 2)
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts, 1000)] + [r for r in util.EDGE if r[0] != 12]
    out = licenses.scan(util.frame(spark, rows, extra=True)).collect()
    cols, expected = _duck(rows, "op2_license_scan")
    norm = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, (norm(tuple(r[c] for c in cols)) for r in out))) == sorted(map(str, map(norm, expected)))
    found = {r["doc_id"]: r["labels"] for r in out}
    assert found[1000 + texts.index("Licensed under the Apache License, Version 1.1")] == ""
    assert found[1000 + notices.index("licensed under a Creative Commons Attribution 4.0 International License")] == "cc-by"


def test_license_scan_is_linear_in_the_text(spark):
    import time
    spent = []
    for n in (20_000, 100_000, 400_000):        # the first one warms up
        df = util.frame(spark, [(1, "some words of a text " * (n // 5) + "all rights reserved", "en", "s", 1)])
        t0 = time.time()
        r = licenses.scan(df).first()
        spent.append(time.time() - t0)
        assert r["n_words"] == n + 3 and r["base_labels"] == "reserved" and r["first_word"] == n
    assert spent[2] < 8 * spent[1] + 2
