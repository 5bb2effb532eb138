"""Sources and sinks: S1 read_sentences, S2 read_pairs_csv, S3 read_eval_csv,
S4 read_aligned_lines, S6 read_stage, K1 write_pairs, K2 write_quoted_csv,
K3 write_results / read_results, K4 write_best_pairs, K6 write_text_corpus,
K7 write_eval, K8 write_stage (with a progress row).

Positions (``idx``) follow file order: the in-split order of a file is kept by
``monotonically_increasing_id`` taken at the scan, splits are ordered by
(file path, block start), and ``dense_index`` turns that order into 0..n-1 without
a single-partition window. Paths are whatever the caller passes (a shared file
system on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmine.functions.scalar import py_strip
from pairmine.session import stage_root
from pairmine.sources import versions
from pairmine.sources.dense_index import dense_index


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _file_ordered(df: DataFrame) -> DataFrame:
    """Attach the file-order key (path, block start, in-split position) at the scan."""
    return df.select("*", F.col("_metadata.file_path").alias("_fp"),
                     F.col("_metadata.file_block_start").alias("_fb"),
                     F.monotonically_increasing_id().alias("_pos"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (split on \\n, \\r\\n and \\r) with their file-order key."""
    return _file_ordered(spark.read.text(path)).withColumnRenamed("value", "line")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, text)``: each line stripped (Python whitespace), blank lines dropped,
    ``idx`` = position after dropping, in file order. A header line is kept."""
    lines = read_lines(spark, path).withColumn("text", py_strip(F.col("line"))).filter(F.col("text") != "")
    return dense_index(lines, ["_fp", "_fb", "_pos"]).select("idx", "text")


def read_aligned_lines(spark: SparkSession, src_path: str, tgt_path: str, first_n: int | None = None) -> DataFrame:
    """S4 + J10 + P7: two line files, blank lines dropped, lines otherwise kept as they
    are; counts must match (ValueError); optional first N by position."""
    def indexed(path):
        lines = read_lines(spark, path).filter(py_strip(F.col("line")) != "")
        return dense_index(lines, ["_fp", "_fb", "_pos"]).select("idx", "line")
    a, b = indexed(src_path), indexed(tgt_path)
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"line counts differ: {na} vs {nb}")
    out = a.withColumnRenamed("line", "source").join(b.withColumnRenamed("line", "reference"), "idx")
    if first_n:
        out = out.filter(F.col("idx") < int(first_n))
    return out


# The cells that the reference's CSV reader takes for null by default.
NULL_MARKERS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# The columns of the translation output (K2), as read for evaluation (DV-10).
TRANSLATION_COLUMNS = {"source": "input", "prediction": "translation", "reference": "reference"}


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether quoted fields of a CSV hold line breaks: some line has an odd number of quotes."""
    return spark.read.text(path).filter(_odd_quotes(F.col("value"))).limit(1).count() > 0


def _odd_quotes(line):
    return (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1


def _running_state(batches):
    """For each line of a split, in scan order: whether an odd number of quotes came before it
    in the split, and how many records had begun up to it if the split began outside (no0) or
    inside (no1) of quotes. A split is read by one task from its first to its last line."""
    import numpy as np
    import pyarrow as pa

    split, inside, no = None, 0, [0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        odd = b.column(b.schema.get_field_index("odd")).to_numpy(zero_copy_only=False).astype(np.int64)
        where = list(zip(b.column(b.schema.get_field_index("_fp")).to_pylist(), b.column(b.schema.get_field_index("_fb")).to_pylist()))
        cuts = [0] + [i for i in range(1, len(where)) if where[i] != where[i - 1]] + [len(where)]
        before, nos = np.empty(len(odd), np.int64), [np.empty(len(odd), np.int64) for _ in (0, 1)]
        for lo, hi in zip(cuts, cuts[1:]):
            if where[lo] != split:
                split, inside, no = where[lo], 0, [0, 0]
            total = inside + np.cumsum(odd[lo:hi])
            before[lo:hi] = (total - odd[lo:hi]) % 2
            for k in (0, 1):
                nos[k][lo:hi] = no[k] + np.cumsum(before[lo:hi] == k)
                no[k] = int(nos[k][hi - 1])
            inside = int(total[-1]) % 2
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before), *map(pa.array, nos)],
                                         names=[*b.schema.names, "before", "no0", "no1"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks, read in splits:
    ``(_fp, _fb, _pos, record)``, ordered by the first three.

    A line break ends a record where the quotes before it are even (quotes stand around fields
    and are doubled inside them). Every split counts its own quotes; the parity at its beginning
    is the sum over the splits before it (one row per split), and so is the record that its first
    lines may belong to. Lines that are a record by themselves stay where they are; only the
    lines of longer records are brought together, by record. Text inside quotes stays as it is."""
    lines = _file_ordered(spark.read.option("lineSep", "\n").text(path)).withColumn("odd", _odd_quotes(F.col("value")))
    lines = lines.select("value", "_fp", "_fb", "_pos", "odd").mapInArrow(
        _running_state, "value string, _fp string, _fb long, _pos long, odd boolean, before long, no0 long, no1 long")
    order = Window.partitionBy("_fp").orderBy("_fb")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("_fp", "_fb").agg(F.sum(F.col("odd").cast("int")).alias("odd"), F.max("no0").alias("n0"), F.max("no1").alias("n1"))
    splits = splits.withColumn("open", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("n", F.when(F.col("open") == 0, F.col("n0")).otherwise(F.col("n1")))
    last = F.last(F.when(F.col("n") > 0, F.struct(F.col("_fb").alias("fb"), F.col("n").alias("n"))), ignorenulls=True)
    splits = splits.withColumn("carried", last.over(earlier)).select("_fp", "_fb", "open", "carried")
    x = lines.join(splits, ["_fp", "_fb"])           # one row per split on the right: broadcast by its size
    no = F.when(F.col("open") == 0, F.col("no0")).otherwise(F.col("no1"))
    x = x.withColumn("starts", F.col("before") == F.col("open")).withColumn("no", no)
    whole = x.filter("starts AND NOT odd").select("_fp", "_fb", F.col("no").alias("_pos"), F.col("value").alias("record"))
    at = F.when(F.col("no") > 0, F.struct(F.col("_fb").alias("fb"), F.col("no").alias("n"))).otherwise(F.col("carried"))
    parts = x.filter("NOT (starts AND NOT odd)").select("_fp", at.alias("at"), F.struct("_fb", "_pos", "value").alias("line"))
    joined = parts.groupBy("_fp", "at").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("line")), lambda v: v["value"]), "\n").alias("record"))
    joined = joined.select("_fp", F.col("at.fb").alias("_fb"), F.col("at.n").alias("_pos"), "record")
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def _read_csv(spark: SparkSession, path: str, columns, multi_line: bool | None) -> DataFrame:
    """CSV with header, quotes doubled, a BOM dropped; the file-order key beside its columns.
    Read in splits, by lines or, where quoted fields hold line breaks (looked up in the files),
    by records. ``multi_line`` True leaves files with line breaks to the whole-file reader (one
    task a file), for quotes that stand alone inside unquoted fields; False says there are none."""
    split_records = multi_line is None and has_line_breaks(spark, path)
    raw = (spark.read.option("header", True).option("multiLine", bool(multi_line)).option("escape", '"')
           .option("encoding", "UTF-8").csv(path))
    names = [c.lstrip("\ufeff") for c in raw.columns]
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"missing columns {missing}; found {names}")
    if not split_records:
        return _file_ordered(raw).toDF(*names, "_fp", "_fb", "_pos")
    records = csv_records(spark, path)
    # The first record of a file is its header.
    records = records.filter(~((F.col("_fb") == 0) & (F.col("_pos") == 1))).filter("record <> ''")
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.select("_fp", "_fb", "_pos", F.from_csv("record", ddl, {"escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], "_fp", "_fb", "_pos")


def _nulled(df: DataFrame, cols, na_values) -> DataFrame:
    marks = list(na_values)
    return df.withColumns({c: F.when(~F.col(c).isin(marks), F.col(c)) for c in cols}) if marks else df


def read_pairs_csv(spark: SparkSession, path: str, a: str, b: str, na_values=NULL_MARKERS,
                   multi_line: bool | None = None) -> DataFrame:
    """S2 + P2 + P3: two-column CSV with header; cells equal to one of ``na_values`` are
    null; rows with a null in either column dropped; both cast to string; ``idx`` in file
    order."""
    raw = _read_csv(spark, path, (a, b), multi_line).select(a, b, "_fp", "_fb", "_pos")
    df = _nulled(raw, (a, b), na_values).dropna(subset=[a, b])
    df = df.withColumn(a, F.col(a).cast("string")).withColumn(b, F.col(b).cast("string"))
    return dense_index(df, ["_fp", "_fb", "_pos"]).select("idx", a, b)


def read_eval_csv(spark: SparkSession, path: str, source: str = "text",
                  prediction: str = "translated_text", reference: str = "Reference_text",
                  na_values=(), multi_line: bool | None = None) -> DataFrame | None:
    """S3: evaluation CSV; a missing file gives None; missing columns raise. A BOM in
    the header is removed. Only empty fields are null unless ``na_values`` names markers
    (DV-6). Columns become ``row_id, source, prediction, reference`` beside the input's
    own; ``**TRANSLATION_COLUMNS`` reads a translation output (DV-10)."""
    if not _path_exists(spark, path):
        return None
    raw = _read_csv(spark, path, (source, prediction, reference), multi_line)
    own = [c for c in raw.columns if c not in ("_fp", "_fb", "_pos")]
    idx = dense_index(_nulled(raw, own, na_values), ["_fp", "_fb", "_pos"], "row_id")
    named = {"source": source, "prediction": prediction, "reference": reference}
    return idx.select("row_id", *[c for c in own if c not in named],
                      *[F.col(c).cast("string").alias(n) for n, c in named.items()])


def read_stage(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame | None:
    """The newest finished stage table, or None when there is none. With ``manifest`` a
    stage of other inputs, models or parameters is refused (``versions.StageMismatch``)."""
    folder = versions.latest(spark, path)
    if folder is None:
        return None
    if manifest is not None:
        versions.check_manifest(versions.read_manifest(spark, folder), manifest, path)
    return spark.read.parquet(f"{folder}/{versions.DATA}")


def write_stage(df: DataFrame, path: str, progress: dict | None = None, manifest: dict | None = None) -> None:
    """K8: save a stage as a new version (``df`` may read the stage that it replaces) with the
    manifest of what it belongs to and, optionally, a one-row progress table."""
    versions.publish(df, path, manifest)
    if progress is not None:
        spark = df.sparkSession
        row = {k: (str(v) if not isinstance(v, (int, float)) else v) for k, v in progress.items()}
        spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_progress")


def read_progress(spark: SparkSession, path: str) -> dict | None:
    p = f"{path.rstrip('/')}_progress"
    if not _path_exists(spark, f"{p}/_SUCCESS"):
        return None
    rows = spark.read.json(p).collect()
    return rows[0].asDict() if rows else None


def write_pairs(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """K1: final pairs with a header, only when there is at least one pair. The pairs are
    staged first, so what makes them runs once."""
    stage_root(df.sparkSession)
    df = df.checkpoint(eager=True)
    if df.isEmpty():
        return False
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    return True


def write_quoted_csv(df: DataFrame, path: str, cols=("input", "translation", "reference")) -> None:
    """K2: three columns, header, every field quoted."""
    df.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True) \
        .option("escape", '"').csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """K3: append experiment rows, stamped so that a rerun of an experiment wins."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """K3 read side: one row per experiment, the last written one."""
    df = spark.read.parquet(path)
    w = Window.partitionBy("experiment_id").orderBy(F.desc("written_at"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def write_best_pairs(best_pairs: DataFrame, path: str, best: dict | None = None) -> bool:
    """K4: the best experiment's pairs become the newest version of the best-pairs output
    (``read_best_pairs``); the version before stays for its readers. Nothing is written
    without a pair. ``best`` (experiment and score) is the version's manifest."""
    stage_root(best_pairs.sparkSession)
    best_pairs = best_pairs.checkpoint(eager=True)
    if best_pairs.isEmpty():
        return False
    versions.publish(best_pairs, path, best)
    return True


def read_best_pairs(spark: SparkSession, path: str) -> DataFrame | None:
    """K4 read side: the pairs of the best experiment so far, None before the first."""
    return versions.read_latest(spark, path)


def write_text_corpus(df: DataFrame, col: str, path: str) -> None:
    """K6: one stripped, non-blank sentence per line."""
    clean = df.select(py_strip(F.col(col)).alias("value")).filter(F.col("value") != "")
    clean.write.mode("overwrite").text(path)


def write_eval(df: DataFrame, path: str) -> None:
    """K7: input columns plus the score columns, CSV with header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

