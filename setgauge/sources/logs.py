"""Readers for text reports: posture logs and repetition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracks

# Line formats of the two reports.
FIRST_REP = r"First rep:\s*\((\d+),\s*(\d+)\)"
LAST_REP = r"Last rep\s*:\s*\((\d+),\s*(\d+)\)"
D_VALUE = r"D value\s*:\s*([\d.]+)"
REP_LINE = r"Rep \d+: ([\d.]+) seconds"
FATIGUE = r"Fatigue \(Last - First\): (-?[\d.]+)s"
#: Ends each report in a file that holds many (ASCII record separator).
REPORT_END = "\x1e"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each log with their number: path, line_no, line.

    Files are read in splits; a line's place is its split's offset in the
    file and its order inside the split.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"),
        F.col("value").alias("line"),
    )
    numbered = tracks.number_rows(text, ["path"], ["_start", "_order"], F.col("_start"), "line_no")
    return numbered.drop("_start", "_order")


def _group(line: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))


def parse_posture_log(lines: DataFrame, exercise: Column, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Four-line records (RESULT, first rep, last rep, D value) to rows.

    ``lines`` has ``line_no`` per log and ``line``; incomplete records are
    dropped. Each line sees the three after it through a block halo.
    """
    placed = tracks.number_rows(lines, keys, ["line_no"], tracks.block_of("line_no"))
    halo = tracks.with_halo(placed.withColumn("line", F.trim("line")), 0, 3)
    w = tracks.block_window(keys)
    after = [F.lead("line", k).over(w).alias(f"l{k}") for k in (1, 2, 3)]
    records = halo.select("*", *after).filter(F.col("home") & F.col("line").contains("RESULT"))
    first, last, d = F.col("l1"), F.col("l2"), F.col("l3")
    parsed = records.select(
        F.trim(F.element_at(F.split("line", " RESULT"), 1)).alias("video_name"),
        exercise.alias("exercise"),
        _group(first, FIRST_REP, 1).cast("int").alias("first_rep_start"),
        _group(first, FIRST_REP, 2).cast("int").alias("first_rep_end"),
        _group(last, LAST_REP, 1).cast("int").alias("last_rep_start"),
        _group(last, LAST_REP, 2).cast("int").alias("last_rep_end"),
        _group(d, D_VALUE, 1).try_cast("double").alias("d_value"),
    )
    return parsed.na.drop(subset=["first_rep_start", "last_rep_start", "d_value"])


def skipped_sets(lines: DataFrame) -> DataFrame:
    """Sets a posture log skipped, with the reason."""
    hit = r"^(.*?)\s*SKIP: (.*)$"
    return lines.filter(F.col("line").contains("SKIP:")).select(
        F.regexp_extract("line", hit, 1).alias("video_name"), F.regexp_extract("line", hit, 2).alias("reason")
    )


def parse_rep_reports(reports: DataFrame, text: str = "value") -> DataFrame:
    """Whole report texts to one row each with the array of rep durations."""
    t = F.col(text)
    seconds = F.transform(F.regexp_extract_all(t, F.lit(REP_LINE), F.lit(1)), lambda s: s.cast("double"))
    keep = [c for c in reports.columns if c != text]
    return reports.select(
        *keep,
        _group(t, r"Video: ([^\n]*)", 1).alias("video_name"),
        _group(t, r"Movement: ([^\n]*)", 1).alias("movement"),
        _group(t, r"Rep pattern: (\w+)", 1).alias("pattern"),
        _group(t, r"Detected reps: (\d+)", 1).cast("int").alias("rep_count"),
        seconds.alias("durations_s"),
        _group(t, FATIGUE, 1).cast("double").alias("fatigue_s"),
    )


def read_rep_reports(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """Parsed reports: one per file, or with ``end`` any number in files that Spark may split between them."""
    texts = spark.read.text(path, wholetext=True) if end is None else spark.read.text(path, lineSep=end)
    return parse_rep_reports(texts)


def write_rep_reports(texts: DataFrame, path: str, end: str = REPORT_END) -> None:
    """Report texts (column ``value``) to a file per task, each text followed by ``end``."""
    texts.select("value").write.text(path, lineSep=end)


def rep_report_text(reps: DataFrame) -> DataFrame:
    """Report text per set from numbered repetitions (set_id, rep_no, duration_s, pattern, movement)."""
    rows = reps.groupBy("set_id").agg(
        F.array_sort(F.collect_list(F.struct("rep_no", "duration_s"))).alias("r"),
        F.max("pattern").alias("pattern"),
        F.max("movement").alias("movement"),
    )
    lines = F.transform("r", lambda x: F.format_string("Rep %d: %.2f seconds", x["rep_no"], x["duration_s"]))
    change = F.element_at("r", -1)["duration_s"] - F.element_at("r", 1)["duration_s"]
    head = F.format_string(
        "Video: %s\nMovement: %s\nRep pattern: %s\nDetected reps: %d\n\n", "set_id", "movement", "pattern", F.size("r")
    )
    return rows.select(
        "set_id",
        F.concat(head, F.array_join(lines, "\n"), F.format_string("\n\nFatigue (Last - First): %.2fs\n", change)).alias("value"),
    )
