"""Files in and out, in one file or many, and streams."""

import pytest

from specforge.sources import files
from specforge.streaming.generate import run_stream, stream_table
from specforge.plans.spec import SpecError, from_dict


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a'b", None), (2, None, 2.5), (3, "", -1.0)], "id long, text string, x double")


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "json", "parquet"])
def test_folder(spark, tmp_path, rows, fmt):
    files.write({"t": rows, "none": rows.limit(0)}, f"{tmp_path}/out", fmt)
    assert sorted(r["id"] for r in files.read(spark, f"{tmp_path}/out/t.{fmt}").collect()) == [1, 2, 3]


def test_single_json(spark, tmp_path, rows):
    import json

    files.write({"t": rows, "none": rows.limit(0)}, f"{tmp_path}/all.json")
    got = json.loads((tmp_path / "all.json").read_text())
    assert sorted(r["id"] for r in got["t"]) == [1, 2, 3] and got["none"] == [] and {"id": 2, "text": None, "x": 2.5} in got["t"]
    files.write({"t": rows.repartition(7)}, f"{tmp_path}/all.jsonl")
    lines = [json.loads(x) for x in (tmp_path / "all.jsonl").read_text().splitlines()]
    assert sorted(x["t"]["id"] for x in lines) == [1, 2, 3]
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_tables(spark, f"{tmp_path}/rows.json")["rows"].count() == 2


def test_errors(spark, tmp_path, rows):
    for bad in (lambda: files.read(spark, "x.doc"), lambda: files.write({"a": rows, "b": rows}, f"{tmp_path}/x.csv"), lambda: files.read_tables(spark, f"{tmp_path}/none"), lambda: files.read_tables(spark, str(tmp_path)), lambda: files.FolderSink(str(tmp_path), "xml")):
        with pytest.raises(ValueError):
            bad()


def test_stream(spark, tmp_path):
    spec = from_dict({"tables": [{"name": "t", "row_count": 5, "columns": [{"name": "id", "dtype": "int", "generator": "sequence"}, {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 3}}]}, {"name": "u", "row_count": 5, "columns": [{"name": "x", "dtype": "int", "generator": "int", "constraints": {"unique": True}}]}]})
    seen = []
    q = run_stream(stream_table(spark, spec, "t", 50), lambda df, i: seen.extend(r["x"] for r in df.collect()), f"{tmp_path}/check")
    for _ in range(100):
        if seen:
            break
        q.awaitTermination(0.3)
    q.stop()
    assert seen and set(seen) <= {1, 2, 3}
    with pytest.raises(SpecError):
        stream_table(spark, spec, "u")
