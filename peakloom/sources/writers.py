"""Sinks: trace and feature CSV, spectra JSON, Parquet, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from peakloom.functions.intervals import profile_text
from peakloom.sources.json_array import write_json_array

TRACE_COLUMNS = ("mz", "mz_std", "intensity", "rt", "rt_std", "rt_kurtosis", "rt_skew", "rt_start", "rt_end", "mobility", "num_agg", "quad_low", "quad_high", "quad_center", "chromatogram", "num_tot_points")
#: The columns of a feature table, in order.
FEATURE_COLUMNS = tuple(
    "peptide psm_id peptide_len spec_id file_id rank label expmass calcmass charge rt aligned_rt predicted_rt delta_rt_model delta_mass isotope_error average_ppm hyperscore delta_next delta_best matched_peaks longest_b longest_y longest_y_pct missed_cleavages matched_intensity_pct scored_candidates poisson discriminant_score posterior_error spectrum_q peptide_q protein_q ms2_intensity".split()
)


def write_traces_csv(traces: DataFrame, path: str) -> None:
    traces.select(*(profile_text(F.col(c)).alias(c) if c == "chromatogram" else c for c in TRACE_COLUMNS)).write.option("header", True).csv(path)


def write_features_csv(features: DataFrame, path: str) -> None:
    """All feature columns in their order; those the scoring did not make are empty. A file name is required."""
    if not path:
        raise ValueError("a path for the features is required")
    features.select(*(F.col(c) if c in features.columns else F.lit(None).cast("double").alias(c) for c in FEATURE_COLUMNS)).write.option("header", True).csv(path)


def _pairs(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("peaks", F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"].cast("double"))))


def write_spectra_json(spectra: DataFrame, path: str) -> None:
    """JSON lines, in parallel; peaks as [mz, intensity] pairs."""
    _pairs(spectra).write.json(path)


def write_spectra_json_array(spectra: DataFrame, path: str, *, overwrite: bool = False) -> int:
    """One JSON array in one file of a shared folder, written by the tasks and committed whole; the number of spectra."""
    counted = Observation()
    write_json_array(_pairs(spectra).observe(counted, F.count(F.lit(1)).alias("n")), path, overwrite=overwrite)
    return counted.get["n"]


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)


def run_report(traces: DataFrame, spectra: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(metric, value): counts of traces and spectra, and identifications at 1% for each q-value column."""
    rows = traces.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("traces").alias("metric"), "value")
    rows = rows.union(spectra.agg(F.count(F.lit(1)).cast("double")).select(F.lit("spectra"), "*"))
    if scored is not None:
        for q in ("spectrum_q", "peptide_q", "protein_q"):
            if q in scored.columns:
                rows = rows.union(scored.agg(F.sum(F.when((F.col(q) <= 0.01) & (F.col("label") == 1), 1.0).otherwise(0.0))).select(F.lit(f"{q} <= 0.01"), "*"))
    return rows
