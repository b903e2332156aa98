"""Scans: normalised peak tables, SQLite metadata, JSON spectra, FASTA."""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEAK_SCHEMA = "frame_id long, ms_level int, frame_type string, rt double, scan_offsets array<long>, tof_indices array<long>, intensities array<long>"
SPECTRUM_JSON = "peaks array<array<double>>, rt double, rt_min double, rt_max double, rt_std double, rt_skew double, ims double, ims_std double, ims_skew double, quad_low double, quad_high double"


def read_frames(spark: SparkSession, path: str, kind: str = "dia") -> DataFrame:
    """Frames of one kind from Parquet: 'dia' (level 2, windowed), 'ms1', or 'all'. The filter reaches the scan."""
    df = spark.read.schema(PEAK_SCHEMA).parquet(path)
    if kind == "ms1":
        return df.where("ms_level = 1")
    if kind == "dia":
        return df.where("ms_level = 2 AND frame_type = 'DIA'")
    if kind != "all":
        raise ValueError(f"unknown kind {kind}")
    return df


@dataclass(frozen=True)
class FrameInfo:
    """Three dimension tables of a run: frame -> group, windows of the groups, frame -> time."""

    frame_groups: DataFrame
    windows: DataFrame
    frame_times: DataFrame


def _query(path: str, sql: str) -> list[tuple]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return db.execute(sql).fetchall()


def read_frame_info(spark: SparkSession, database: str, mobility: tuple[float, float] | None = None) -> FrameInfo:
    """The metadata of an acquisition from its SQLite file, on the driver: a row a frame, which is small.

    Rows are keyed by id, in whatever order the file has them. Windows get a number within their group
    by first scan, and isolation bounds.
    """
    from peakloom.operators.reshape import isolation_bounds

    groups = spark.createDataFrame(_query(database, "SELECT Frame, WindowGroup FROM DiaFrameMsMsInfo"), "frame_id long, window_group long")
    raw = _query(database, "SELECT WindowGroup, ScanNumBegin, ScanNumEnd, IsolationMz, IsolationWidth, CollisionEnergy FROM DiaFrameMsMsWindows ORDER BY WindowGroup, ScanNumBegin")
    number: dict[int, int] = {}
    rows = []
    for g, *rest in raw:
        rows.append((g, number.get(g, 0), *rest[:2], *(float(x) for x in rest[2:])))
        number[g] = number.get(g, 0) + 1
    windows = spark.createDataFrame(rows, "window_group long, quad_group_id long, scan_begin long, scan_end long, isolation_mz double, isolation_width double, collision_energy double")
    times = spark.createDataFrame([(i, float(t)) for i, t in _query(database, "SELECT Id, Time FROM Frames")], "frame_id long, rt double")
    return FrameInfo(groups, isolation_bounds(windows, mobility), times)


def read_spectra_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Spectra from files of one JSON array each or, with lines, of an object a line (which Spark can split); peaks become (mz, intensity) structs."""
    df = spark.read.schema(SPECTRUM_JSON).option("multiLine", not lines).json(path)
    return df.withColumn("peaks", F.transform("peaks", lambda p: F.struct(F.get(p, 0).alias("mz"), F.get(p, 1).cast("long").alias("intensity"))))


def read_fasta(spark: SparkSession, path: str, decoy_tag: str = "rev_", make_decoys: bool = True) -> DataFrame:
    """(accession, sequence, is_decoy): records of a FASTA file, entries with the decoy tag dropped when decoys are made by reversal."""
    # a record begins with > at the start of a line; one within a header is text
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[\s*]", ""))
    targets = rows.select(head.alias("accession"), seq.alias("sequence")).where("sequence <> ''")
    tagged = F.col("accession").startswith(decoy_tag)
    if not make_decoys:
        return targets.withColumn("is_decoy", tagged)
    targets = targets.where(~tagged)
    decoys = targets.select(F.concat(F.lit(decoy_tag), "accession").alias("accession"), F.reverse("sequence").alias("sequence"), F.lit(True).alias("is_decoy"))
    return targets.withColumn("is_decoy", F.lit(False)).unionByName(decoys)


def read_table(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """CSV (with a header), Parquet or JSON."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    return {"parquet": reader.parquet, "json": reader.json}[kind](path)
