import csv
import hashlib

import pytest
from pyspark.sql import functions as F

from unitcal import sources
from unitcal.operators.series import SeriesError
from unitcal.sources.cdm import CDM_COLUMNS
from unitcal.sources.tables import settings_hash


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def message(event, ttr, risk, **more):
    row = {c: 1.0 for c in CDM_COLUMNS} | {"event_id": event, "time_to_tca": ttr, "mission_id": 3, "risk": risk, "c_object_type": "DEBRIS"}
    row |= more
    return [row[c] for c in CDM_COLUMNS]


@pytest.fixture()
def files(tmp_path):
    train = [message(0, 5.0, -9.0), message(0, 0.5, -5.0), message(0, 3.0, -8.0), message(1, 2.0, -20.0), message(1, 2.0, -6.0, miss_distance="oops")]
    test = [message(0, 4.0, -7.0), message(0, 2.5, -6.5)]
    labels = [message(0, 0.4, -4.0)]
    return {
        "train": write(tmp_path / "train.csv", CDM_COLUMNS, train),
        "test": write(tmp_path / "test.csv", CDM_COLUMNS, test),
        "labels": write(tmp_path / "labels.csv", sources.label_columns(), labels),
        "dir": tmp_path,
    }


def test_raw_files_to_series(spark, files):
    df = sources.build_series(spark, files["train"], files["test"], files["labels"])
    assert df.columns[:103] == list(CDM_COLUMNS) and len(df.columns) == 110
    rows = {(r["event_uid"], r["cdm_index"]): r for r in df.collect()}
    assert [rows["train_0", i]["time_to_tca"] for i in range(3)] == [5.0, 3.0, 0.5]
    assert rows["train_0", 0]["target_log_risk"] == -5.0 and rows["train_0", 0]["is_high_risk"]
    # equal times keep the order of the file; the threshold itself is not high here
    assert [rows["train_1", i]["risk"] for i in range(2)] == [-20.0, -6.0]
    assert rows["train_1", 0]["target_log_risk"] == -6.0 and not rows["train_1", 0]["is_high_risk"]
    assert rows["train_1", 1]["miss_distance"] is None and rows["train_1", 1]["n_cdms"] == 2
    assert rows["test_0", 0]["target_log_risk"] == -4.0 and rows["test_0", 1]["target_time_to_tca"] == 0.4
    assert rows["test_0", 0]["c_object_type"] == "DEBRIS"


def test_round_trip(spark, files, tmp_path):
    df = sources.build_series(spark, files["train"], files["test"], files["labels"])
    path = str(tmp_path / "series")
    sources.write_series(df, path)
    back = sources.load_series(spark, path)
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    plan = back.filter("split = 'test'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(FileNotFoundError):
        sources.load_series(spark, str(tmp_path / "nowhere"))


def test_unlabelled_test_unit_raises(spark, files, tmp_path):
    empty = write(tmp_path / "none.csv", sources.label_columns(), [message(7, 0.4, -4.0)])
    with pytest.raises(SeriesError, match="1 units"):
        sources.build_series(spark, files["train"], files["test"], empty)


def test_wrong_header_raises(spark, tmp_path):
    columns = list(CDM_COLUMNS)
    columns[3], columns[4] = columns[4], columns[3]
    path = write(tmp_path / "bad.csv", columns, [])
    with pytest.raises(sources.SchemaError):
        sources.read_messages(spark, path)
    path = write(tmp_path / "short.csv", CDM_COLUMNS[:-1], [])
    with pytest.raises(sources.SchemaError, match="AP"):
        sources.read_messages(spark, path)


def test_manifest(spark, files):
    digest = hashlib.md5(open(files["train"], "rb").read()).hexdigest()
    expected = spark.createDataFrame([("train.csv", digest), ("test.csv", "0" * 32), ("gone.csv", "0" * 32)], "file string, md5 string")
    table = sources.file_manifest(spark, str(files["dir"]), expected, "*.csv")
    status = {r["file"]: r["status"] for r in table.collect()}
    assert status == {"train.csv": "ok", "test.csv": "mismatch", "gone.csv": "absent", "labels.csv": "unlisted"}
    with pytest.raises(sources.SchemaError):
        sources.require_manifest(table)
    sources.require_manifest(table.filter("status = 'ok'"))


def test_stamp_and_hash(spark, tmp_path):
    assert settings_hash({"a": 1, "b": 2}) == settings_hash({"b": 2, "a": 1}) != settings_hash({"a": 1, "b": 3})
    df = sources.stamp(spark.range(2), "e", {"a": 1}, 42, 2000)
    row = df.first()
    assert row["seed_used"] == 42 and len(row["settings_sha256"]) == 64 and row["stamped_utc"].endswith("Z")
    sources.write_report(df, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    sources.write_report(df, str(tmp_path / "report_p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "report_p")).filter(F.col("id") == 1).count() == 1


def test_manifest_of_files_too_large_for_one_value(spark, tmp_path):
    """files above the bound of Spark's reader; their lines keep every byte."""
    import hashlib
    import random

    noise = random.Random(3).randbytes(90_000)
    contents = {
        "noise.bin": noise, "ended.bin": noise + b"\r\n\n\n", "mark.csv": b"\xef\xbb\xbf" + b"a,b\r\n" * 400, "bare.csv": b"\xef\xbb\xbf" + b"a;b\n" * 400 + b"c",
        "zero.bin": bytes(3000), "small.bin": b"\n\xff", "lines.bin": b"\n" * 1500,
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = {k: spark.conf.get(k, None) for k in (key, "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set(key, "1000")
    try:
        got = {r["file"]: (r["n_bytes"], r["md5"]) for r in sources.file_manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {n: (len(c), hashlib.md5(c).hexdigest()) for n, c in contents.items()}
    assert before == {k: spark.conf.get(k, None) for k in before}
