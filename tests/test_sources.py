"""Readers, writers, config, scoring."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from peakloom.config import Config
from peakloom.operators import reshape as S
from peakloom.plans import scoring
from peakloom.sources import json_array, readers, writers


def test_config(tmp_path):
    c = Config.from_dict({"tracing": {"min_n": 7}})
    assert c.tracing.min_n == 7 and c.tracing.rt_scaling == 2.4 and c.denoise == Config().denoise
    path = tmp_path / "c.toml"
    Config().write_template(str(path))
    assert Config.from_toml(str(path)) == Config()
    with pytest.raises(FileExistsError):
        Config().write_template(str(path))
    with pytest.raises(ValueError):
        Config.from_dict({"tracing": {"nonsense": 1}})


def test_frame_info_and_windows(spark, tmp_path):
    path = str(tmp_path / "run.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE DiaFrameMsMsInfo (Frame, WindowGroup)")
        db.execute("CREATE TABLE DiaFrameMsMsWindows (WindowGroup, ScanNumBegin, ScanNumEnd, IsolationMz, IsolationWidth, CollisionEnergy)")
        db.execute("CREATE TABLE Frames (Id, Time)")
        db.executemany("INSERT INTO DiaFrameMsMsInfo VALUES (?, ?)", [(2, 1), (3, 1)])
        db.executemany("INSERT INTO DiaFrameMsMsWindows VALUES (?, ?, ?, ?, ?, ?)", [(1, 2, 4, 500, 20, 30), (1, 0, 2, 600, 20, 30)])
        db.executemany("INSERT INTO Frames VALUES (?, ?)", [(3, 0.3), (1, 0.1), (2, 0.2)])
    info = readers.read_frame_info(spark, path, mobility=(1.6, -0.1))
    assert {tuple(r) for r in info.frame_times.collect()} == {(1, 0.1), (2, 0.2), (3, 0.3)}
    rows = {r["quad_group_id"]: r for r in info.windows.collect()}
    assert (rows[0]["scan_begin"], rows[0]["iso_low"], rows[0]["iso_high"]) == (0, 590, 610) and rows[0]["ims_low"] < rows[0]["ims_high"]
    frames = spark.createDataFrame([(2, 2, "DIA", 0.2, [0, 1, 3, 3, 4], [10, 20, 30, 40], [1, 2, 3, 4]), (1, 1, "MS1", 0.1, [0, 1], [5], [6])], readers.PEAK_SCHEMA)
    frames.write.parquet(str(tmp_path / "frames"))
    dia = readers.read_frames(spark, str(tmp_path / "frames"))
    assert dia.count() == 1 and readers.read_frames(spark, str(tmp_path / "frames"), "ms1").count() == 1
    got = S.expand_frames(dia)
    assert {tuple(r) for r in got.select("scan", "tof_index", "intensity").collect()} == {(0, 10, 1), (1, 20, 2), (1, 30, 3), (3, 40, 4)}
    placed = S.split_by_windows(S.annotate(got, info.frame_groups, ["frame_id"]), info.windows, "scan", "scan_begin", "scan_end", ["window_group"])
    assert {(r["tof_index"], r["quad_group_id"]) for r in placed.collect()} == {(10, 0), (20, 0), (30, 0), (40, 1)}


def test_spectra_json_both_forms(spark, tmp_path):
    row = {"peaks": [[500.5, 10], [600.0, 3]], "rt": 1.0, "rt_min": 0.5, "rt_max": 1.5, "rt_std": 0.1, "rt_skew": 0.0, "ims": 0.9, "ims_std": 0.1, "ims_skew": 0.0, "quad_low": 500.0, "quad_high": 520.0}
    (tmp_path / "a.json").write_text("[" + ",\n".join(json.dumps(row) for _ in range(3)) + "]")
    df = readers.read_spectra_json(spark, str(tmp_path / "a.json"))
    assert df.count() == 3 and df.first()["peaks"][0]["intensity"] == 10
    assert writers.write_spectra_json_array(df, str(tmp_path / "b.json")) == 3
    assert json.loads((tmp_path / "b.json").read_text())[0] == row
    writers.write_spectra_json(df, str(tmp_path / "lines"))
    assert readers.read_spectra_json(spark, str(tmp_path / "lines"), lines=True).count() == 3
    out = S.raw_spectra(df.withColumn("k", F.monotonically_increasing_id()), ["k"]).orderBy("row_id").collect()
    assert [r["id"] for r in out] == ["0_test", "1_test", "2_test"] and out[0]["tic"] == 13 and out[0]["precursor_mz"] == 510


def test_trace_and_feature_csv(spark, tmp_path):
    cols = {c: F.lit(1.0) for c in writers.TRACE_COLUMNS if c != "chromatogram"}
    df = spark.range(2).select(*(v.alias(k) for k, v in cols.items()), F.array(F.lit(0.0), F.lit(2.0)).alias("chromatogram"))
    writers.write_traces_csv(df, str(tmp_path / "t"))
    back = readers.read_table(spark, str(tmp_path / "t"), "csv")
    assert tuple(back.columns) == writers.TRACE_COLUMNS and back.first()["chromatogram"] == "[0.0, 2.0]"
    writers.write_features_csv(spark.createDataFrame([("PEPTIDE", 2)], "peptide string, charge int"), str(tmp_path / "f"))
    assert len(readers.read_table(spark, str(tmp_path / "f"), "csv").columns) == 34
    with pytest.raises(ValueError):
        writers.write_features_csv(df, "")


def test_search_finds_the_peptides(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">P1 a->b first\nMSAMPLERPEPTIDEKGGGGGGGK\nLLLLLDDDDR\n>P2\nVVVVTTTTSSSSK\n>rev_P9\nAAAAAAAAK\n")
    proteins = readers.read_fasta(spark, str(tmp_path / "p.fasta"))
    assert {r["accession"] for r in proteins.collect()} == {"P1", "P2", "rev_P1", "rev_P2"}
    peptides = scoring.with_masses(scoring.digest(proteins), variable_mods={"M": 15.994915})
    known = {r["peptide"] for r in peptides.where("NOT is_decoy").collect()}
    assert {"PEPTIDEK", "MSAMPLERPEPTIDEK", "LLLLLDDDDR", "VVVVTTTTSSSSK"} <= known
    target = scoring.fragments(peptides.where("peptide IN ('PEPTIDEK', 'LLLLLDDDDR', 'VVVVTTTTSSSSK') AND site = -1"))
    ions = F.transform(F.concat("b", "y"), lambda m: F.struct(m.alias("mz"), F.lit(100).cast("long").alias("intensity")))
    spectra = target.select(F.col("peptide").alias("spec_id"), ((F.col("mass") + 2 * scoring.PROTON) / 2).alias("precursor_mz"), ions.alias("peaks"))
    got = {r["spec_id"]: r for r in scoring.score_spectra(spectra, peptides).collect()}
    assert {k: v["peptide"] for k, v in got.items()} == {k: k for k in ("PEPTIDEK", "LLLLLDDDDR", "VVVVTTTTSSSSK")}
    assert all(v["label"] == 1 and v["spectrum_q"] == 0 and v["longest_y"] >= len(k) - 2 and v["rank"] == 1 and v["matched_intensity_pct"] > 50 for k, v in got.items())
    report = {r["metric"]: r["value"] for r in writers.run_report(spectra, spectra, spark.createDataFrame(list(got.values()))).collect()}
    assert report["spectrum_q <= 0.01"] == 3


def test_deisotoping_and_tuning(spark):
    from peakloom.functions.profiles import ISOTOPE, deisotope
    from peakloom.plans.tuning import tune

    peaks = [(500.0, 100), (500.0 + ISOTOPE, 60), (500.0 + ISOTOPE / 2, 200), (700.0, 5)]
    df = spark.createDataFrame([(peaks,)], "peaks array<struct<mz:double,intensity:long>>")
    assert [p["intensity"] for p in df.select(deisotope(F.col("peaks")).alias("p")).first()["p"]] == [100, 200, 5]
    best, tried = tune(lambda c: -abs(c.tracing.rt_scaling - 1.0), trials=30)
    assert len(tried) == 30 and abs(best.tracing.rt_scaling - 1.0) < abs(Config().tracing.rt_scaling - 1.0)


def test_linear_discriminant(spark):
    rows = [(float(i % 7) + (3 if i % 2 else 0), float(i % 5), 1 if i % 2 else -1) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    out = scoring.linear_discriminant(df, ["a", "b"], "label").groupBy("label").agg(F.avg("discriminant_score").alias("m")).collect()
    means = {r["label"]: r["m"] for r in out}
    assert means[1] > means[-1] + 2
    assert scoring.linear_discriminant(df.where("label = 1"), ["a"], "label") is None


def test_other_names_of_settings_and_drawn_numbers():
    import random

    from peakloom.plans.tuning import SPACE, drawn

    c = Config.from_dict({"denoise_config": {"ms2_min_n": 7}, "pseudoscan_generation_config": {"min_n": 4}, "some_search_config": {"fasta_path": "a.fasta"}, "output_config": {"debug_traces_csv": "t"}})
    assert (c.denoise.ms2_min_n, c.pseudoscan.min_n, c.search.fasta_path, c.output.traces_csv) == (7, 4, "a.fasta", "t")
    d = drawn(Config(), SPACE, random.Random(1))
    assert isinstance(d.tracing.min_n, int) and 2 <= d.tracing.min_n <= 10 and 0.5 <= d.pseudoscan.rt_scaling <= 2.5


def test_a_whole_run(spark, tmp_path):
    """Four ions of one window rise and fall together over the frames: four traces, one spectrum."""
    from dataclasses import replace

    from peakloom.config import Denoise, Output, Pseudoscan, Search, Tracing
    from peakloom.operators.reshape import isolation_bounds
    from peakloom.plans.run import run
    from peakloom.sources.readers import FrameInfo

    rows = [(f, 1, 0, 10 + s, 1000 * i + s, 400.0 + 50 * i + s * 1e-4, 0.9 + s * 1e-3, 200 * (6 - abs(f - 5)) + s) for f in range(1, 10) for i in range(4) for s in range(3)]
    peaks = spark.createDataFrame(rows, "frame_id long, window_group long, quad_group_id long, scan long, tof_index long, mz double, mobility double, intensity long")
    windows = isolation_bounds(spark.createDataFrame([(1, 0, 0, 50, 500.0, 25.0, 30.0)], "window_group long, quad_group_id long, scan_begin long, scan_end long, isolation_mz double, isolation_width double, collision_energy double"))
    info = FrameInfo(spark.createDataFrame([(f, 1) for f in range(1, 10)], "frame_id long, window_group long"), windows, spark.createDataFrame([(f, float(f)) for f in range(1, 10)], "frame_id long, rt double"))
    (tmp_path / "p.fasta").write_text(">P1\nMSAMPLERPEPTIDEK\n")
    config = Config(denoise=Denoise(ms2_min_n=2), tracing=Tracing(), pseudoscan=Pseudoscan(min_n=2, min_neighbor_intensity=10), search=Search(fasta_path=str(tmp_path / "p.fasta")), output=Output(pseudoscans_json=str(tmp_path / "s"), traces_csv=str(tmp_path / "t"), features_csv=str(tmp_path / "f")))
    got = run(peaks, info, config, least_peaks=3)
    assert got["denoised"].count() == 36 and got["traces"].count() == 4
    (spectrum,) = got["spectra"].collect()
    assert [round(p["mz"]) for p in spectrum["peaks"]] == [400, 450, 500, 550]
    back = readers.read_spectra_json(spark, str(tmp_path / "s"), lines=True).collect()
    assert len(back) == 1 and all(back[0][c] is not None for c in ("rt_std", "rt_skew", "ims_std", "ims_skew"))
    assert got["features"].count() == 0 and (tmp_path / "f").is_dir() and (tmp_path / "t").is_dir()
    assert set(run(peaks, info, replace(config, search=Search(), output=Output()))) == {"denoised", "traces", "spectra"}


def test_json_array_is_committed_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "rows.json")
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('é"\\,\n'), F.col("id").cast("string"))).alias("a.b"))
    json_array.write_json_array(df, path)
    with open(path, encoding="utf-8") as f:
        assert json.load(f) == [{"id": i, "a.b": f'é"\\,\n{i}' if i % 3 else None} for i in range(5000)]
    with pytest.raises(Exception, match="rows.json"):
        json_array.write_json_array(df, path)
    json_array.write_json_array(df.limit(0), path, overwrite=True)
    assert json.loads((tmp_path / "rows.json").read_text()) == []
    assert [p.name for p in tmp_path.iterdir()] == ["rows.json"]


def test_json_array_of_a_failed_job_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text("[1]")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("planned"))).alias("id"))
    with pytest.raises(Exception, match="planned"):
        json_array.write_json_array(bad, str(path), overwrite=True)
    assert path.read_text() == "[1]" and [p.name for p in tmp_path.iterdir()] == ["rows.json"]


def test_json_array_commit_takes_one_attempt_a_partition(tmp_path):
    writer = json_array.JsonArrayWriter(str(tmp_path / "x.json"), False)
    parts = []
    for partition, text in ((1, '{"b":1}'), (0, '{"a":1}'), (0, '{"lost":1}')):
        file = f"{writer.staging}/{partition}-{text[2]}{len(parts)}"
        with open(file, "w") as f:
            f.write(text)
        parts.append(json_array.Part(partition, file, 1))
    writer.commit([*parts[:2], None, json_array.Part(2, "none", 0)])
    assert json.loads((tmp_path / "x.json").read_text()) == [{"a": 1}, {"b": 1}]
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]
