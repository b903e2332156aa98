"""Expansion of compressed frames, windows and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.intervals import midpoint, scan_to_mobility
from peakloom.functions.profiles import keep_relative


def expand_frames(frames: DataFrame, *, first_scan: str | None = None, keep: tuple[str, ...] = ("frame_id", "rt")) -> DataFrame:
    """One row a peak from (scan_offsets, tof_indices, intensities): keep, scan, tof_index, intensity.

    scan_offsets[k] .. scan_offsets[k + 1] are the peaks of scan k; first_scan is a column to add to k.
    """
    scans = F.transform(F.slice(F.col("scan_offsets"), 2, F.greatest(F.size("scan_offsets") - 1, F.lit(0))), lambda end, k: F.struct(k.alias("scan"), F.get(F.col("scan_offsets"), k).alias("from"), end.alias("to")))
    per_scan = frames.select(*keep, *([first_scan] if first_scan and first_scan not in keep else []), "tof_indices", "intensities", F.explode(scans).alias("s")).where(F.col("s.to") > F.col("s.from"))
    part = lambda c: F.slice(F.col(c), (F.col("s.from") + 1).cast("int"), (F.col("s.to") - F.col("s.from")).cast("int"))
    rows = per_scan.select(*keep, (F.col("s.scan") + (F.col(first_scan) if first_scan else F.lit(0))).alias("scan"), F.explode(F.arrays_zip(part("tof_indices").alias("t"), part("intensities").alias("i"))).alias("p"))
    return rows.select(*keep, "scan", F.col("p.t").alias("tof_index"), F.col("p.i").alias("intensity"))


def isolation_bounds(windows: DataFrame, mobility: tuple[float, float] | None = None) -> DataFrame:
    """windows with iso_low and iso_high, and, given (intercept, slope), the mobility bounds: a high scan is a low mobility."""
    out = windows.withColumns({"iso_low": F.col("isolation_mz") - F.col("isolation_width") / 2, "iso_high": F.col("isolation_mz") + F.col("isolation_width") / 2})
    if mobility:
        out = out.withColumns({"ims_low": scan_to_mobility(F.col("scan_end"), *mobility), "ims_high": scan_to_mobility(F.col("scan_begin"), *mobility)})
    return out


#: Windows of up to so many rows are broadcast; more are shuffled.
MOST_WINDOWS = 100_000
_UNBOUNDED = 2000


def split_by_windows(rows: DataFrame, windows: DataFrame, value: str, lo: str, hi: str, on: list[str] | None = None) -> DataFrame:
    """Each row with every window (of its keys `on`) whose [lo, hi) holds its value: an equi-join whatever the sizes.

    A window is put in the one or two cells that it meets on the grid of the least power of two that is not
    narrower than it; a row has one cell a grid that occurs. So windows of any mix of widths meet
    their rows by cell, with the bounds as residual. Counted windows of up to MOST_WINDOWS are broadcast and rows
    aren't shuffled. Windows without a bound or that hold nothing, and rows without a value, match nothing; an
    infinite bound is one. Columns come in the order of rows, then windows without the keys.
    """
    on = on or []
    low, high = (F.col(f"`{c}`").cast("double") for c in (lo, hi))
    wide = F.when(F.abs(low).isin(float("inf")) | F.abs(high).isin(float("inf")), F.lit(_UNBOUNDED)).otherwise(F.greatest(F.ceil(F.log2(high - low)), F.lit(-1000))).cast("int")
    graded = windows.where((high > low) & ~F.isnan(high)).withColumn("__level", wide)
    counted = graded.groupBy("__level").count().collect()  # a row a power of two
    levels = sorted(r["__level"] for r in counted)
    if not levels:
        return rows.join(windows.drop(*on).limit(0), F.lit(True))

    def cell(x, level):
        return F.when(level >= _UNBOUNDED, F.lit(0.0)).otherwise(F.floor(x / F.pow(F.lit(2.0), level)).cast("double"))

    first, last = cell(low, F.col("__level")), cell(high, F.col("__level"))
    placed = graded.withColumn("__cell", F.explode(F.array_distinct(F.array(first, last)))).withColumns({"__lo": low, "__hi": high}).select(*(F.col(f"`{k}`").alias(f"__on{i}") for i, k in enumerate(on)), "__level", "__cell", "__lo", "__hi", *(c for c in windows.columns if c not in on))
    v = F.col(f"`{value}`").cast("double")
    spread = rows.withColumn("__v", v).where("__v IS NOT NULL AND NOT isnan(__v)").withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__cell", cell(F.col("__v"), F.col("__level")))
    # the cells are exact: dividing by a power of two does not round
    if sum(r["count"] for r in counted) <= MOST_WINDOWS:
        placed = F.broadcast(placed)
    a, b = spread.alias("__a"), placed.alias("__b")
    cond = (F.col("__a.__level") == F.col("__b.__level")) & (F.col("__a.__cell") == F.col("__b.__cell")) & (F.col("__v") >= F.col("__lo")) & (F.col("__v") < F.col("__hi"))
    for i, k in enumerate(on):
        cond = cond & (F.col(f"__a.`{k}`") == F.col(f"__b.__on{i}"))
    return a.join(b, cond).select(*(F.col(f"__a.`{c}`") for c in rows.columns), *(F.col(f"__b.`{c}`") for c in windows.columns if c not in on))


def split_dense_frames(peaks: DataFrame, frame_groups: DataFrame, windows: DataFrame, *, frame: str = "frame_id", group: str = "window_group", quad: str = "quad_group_id", value: str = "mobility", lo: str = "ims_low", hi: str = "ims_high", partitions: int | None = None) -> DataFrame:
    """Peaks of frames with a group, each with every window of its group whose [lo, hi) holds its mobility, rows of a (group, quad, frame) together and by mobility.

    Frames without a group go, and so do peaks that no window holds. frame_groups and windows may be of any size.
    """
    placed = peaks.join(frame_groups.select(frame, group).where(F.col(group).isNotNull()), frame)
    split = split_by_windows(placed, windows, value, lo, hi, [group])
    dealt = split.repartition(partitions, group, quad, frame) if partitions else split.repartition(group, quad, frame)
    return dealt.sortWithinPartitions(group, quad, frame, value)


def annotate(rows: DataFrame, dimension: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Metadata lookup; rows without an entry stay, with nulls, unless how='inner'."""
    return rows.join(dimension, on, how)


def scaled(df: DataFrame, coords: list[tuple[str, float]], suffix: str = "_scaled") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c) / F.lit(s) for c, s in coords})


def raw_spectra(spectra: DataFrame, order: list[str]) -> DataFrame:
    """Spectra for a search: id by a total order, precursor and isolation half width, peaks over a thousandth of the greatest, by mz, and their sum.

    The running number comes from zipWithIndex-like counting of range partitions, not from a global window.
    """
    kept = keep_relative(F.col("peaks"))
    half = (F.col("quad_high") - F.col("quad_low")) / 2
    return with_row_id(spectra.withColumns({"peaks": kept, "precursor_mz": midpoint(F.col("quad_low"), F.col("quad_high")), "isolation_half": half}), order).withColumns(
        {"id": F.concat(F.col("row_id").cast("string"), F.lit("_test")), "tic": F.aggregate("peaks", F.lit(0).cast("long"), lambda s, p: s + p["intensity"].cast("long"))}
    )


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with numbers from 0 in the given total order.

    Range-partitioned and sorted; each partition numbers its own rows from the count of those before,
    of which the driver sees one number a partition.
    """
    from pyspark.sql import Window as W

    from peakloom.workspace import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "row-id")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    bases = df.sparkSession.createDataFrame(before, "__part int, __before long")  # a row a partition
    rank = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, (F.col("__before") + rank - 1).cast("long")).drop("__part", "__before")


def concatenate(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sanity_report(df: DataFrame, positive: list[str]) -> DataFrame:
    """One row: the number of rows and, per column, of rows that are not positive."""
    bad = lambda c: F.sum(F.when(F.coalesce(F.col(c) <= 0, F.lit(True)), 1).otherwise(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *(bad(c).alias(f"bad_{c}") for c in positive))


def viewer_points(df: DataFrame, share: int = 200) -> DataFrame:
    """Projection of peaks for a 2-D viewer (x = mz/10, y = 100*mobility, radius = intensity/max), every share-th by a hash: a sampling operator."""
    most = df.agg(F.max("intensity").alias("most"))
    picked = df.where(F.pmod(F.xxhash64("mz", "mobility", "intensity"), F.lit(share)) == 0)
    return picked.crossJoin(F.broadcast(most)).select((F.col("mz") / 10).alias("x"), (F.col("mobility") * 100).alias("y"), (F.col("intensity") / F.col("most")).alias("radius"))
