"""CSV files with line breaks inside quotes, read in splits: equal to the whole-file reader."""
import os
import random

import pytest
from pyspark.sql import functions as F

from pairmine.sources import io as IO


def field(rnd):
    t = "".join(rnd.choice(["a", "bc", " ", ",", '"', "\n", "\r\n", "é", "😀", "x" * 20, ""]) for _ in range(rnd.randint(0, 9)))
    if any(c in t for c in ',"\n\r') or rnd.random() < 0.3:
        return '"' + t.replace('"', '""') + '"'
    return t


def write(folder, n_files, rows, seed, end="\n"):
    rnd = random.Random(seed)
    os.makedirs(folder)
    for k in range(n_files):
        with open(os.path.join(folder, f"part-{k}.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(("﻿" if k == 0 else "") + "a,b,c" + end)
            f.write("".join(f"{field(rnd)},{field(rnd)},{k}-{i}{end}" for i in range(rows)))
            if k % 2:
                f.write(f'last,"no\nline end",{k}')


@pytest.mark.parametrize("split,end", [("200b", "\n"), ("4k", "\n"), ("64m", "\n"), ("300b", "\r\n")])
def test_records_over_splits_equal_the_whole_file_reader(spark, tmp_dir, split, end):
    path = os.path.join(tmp_dir, "t")
    write(path, 3, 120, 5, end)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert IO.has_line_breaks(spark, path)
        got = IO._read_csv(spark, path, ("a", "b", "c"), None)
        assert (got.select("_fb").distinct().count() > 10) == split.endswith("0b")
        whole = IO._read_csv(spark, path, ("a", "b", "c"), True)
        key = ["_fp", "_fb", "_pos"]
        a, b = ([(r._fp, r.a, r.b, r.c) for r in x.orderBy(*key).collect()] for x in (got, whole))
        if end == "\r\n":       # the whole-file reader takes these line breaks inside quotes for \n, too
            a, b = ([tuple((v or "").replace("\r\n", "\n") for v in r) for r in x] for x in (a, b))
        assert len(a) == 361 and a == b
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pairs_and_evaluation_files_are_read_by_records(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p.csv")
    with open(path, "w") as f:
        f.write('source,prediction,reference\n"one\nline","x ""y""",z\n\nNA,b,c\nd,"e\n\nf",g\n')
    pairs = [(r.idx, r.source, r.prediction) for r in IO.read_pairs_csv(spark, path, "source", "prediction").orderBy("idx").collect()]
    assert pairs == [(0, "one\nline", 'x "y"'), (1, "d", "e\n\nf")]
    ev = IO.read_eval_csv(spark, path, "source", "prediction", "reference").orderBy("row_id")
    assert [tuple(r) for r in ev.collect()] == [(0, "one\nline", 'x "y"', "z"), (1, "NA", "b", "c"), (2, "d", "e\n\nf", "g")]
    plan = IO.csv_records(spark, path)
    assert plan.filter(F.col("record").contains("\n")).count() == 2
