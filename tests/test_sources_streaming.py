import json

import pytest
from pyspark.sql import functions as F

from planloom.operators import catalog as C
from planloom.sources import catalogs, records
from planloom.streaming import pipeline


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "names/names.md": "| Name |\n|---|\n| Ann |\n| Bo |\n",
        "maps/room_names.md": "| Room |\n|------|\n| living room |\n| hall |\n",
        "maps/location_names.md": "| Number | Location | Category |\n|---|---|---|\n| 1 | bed |\n| 2 | side table (p) | furniture |\n| 3 | shelf | (p) |\n| 4 | entrance |\n",
        "objects/objects.md": "# Class drinks (drink)\n\n| Objectname |\n|---|\n| orange_juice |\n| Water |\n\n# Class foods (food)\n| Objectname |\n|---|\n| soup |\n| Water |\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_catalog(spark, folder):
    cat = catalogs.read_catalog(spark, folder)
    got = {(r.group, r.value, r.parent) for r in cat.collect()}
    assert {v for g, v, _ in got if g == "locations"} == {"bed", "side table", "shelf", "entrance"}
    assert {v for g, v, _ in got if g == "placements"} == {"side table", "shelf"}
    assert ("objects", "orange juice", "drinks") in got and ("categories", "food", "foods") in got
    assert {v for g, v, _ in got if g == "names"} == {"Ann", "Bo"} and ("rooms", "living room", None) in got
    issues = {(r.severity, r.code) for r in C.catalog_issues(cat, ["names"], ["objects"], ["names", "clothes"]).collect()}
    assert issues == {("error", "empty_catalog"), ("warning", "duplicates"), ("warning", "object_case")}
    with pytest.raises(RuntimeError):
        C.require_no_errors(C.catalog_issues(cat, ["names"], ["objects"], ["clothes"]))


def test_patterns_and_drift(spark, tmp_path):
    path = tmp_path / "names.yml"
    path.write_text("patterns:\n  - Ann\n  - ' Cy '\n  - Ann\n")
    listed = catalogs.read_patterns(spark, str(path))
    assert sorted(r.value for r in listed.collect()) == ["Ann", "Ann", "Cy"]
    local = spark.createDataFrame([("ann",), ("Bo",), (None,)], "value string")
    assert {(r.key, r.side) for r in C.drift(local, listed).collect()} == {("bo", "only_local"), ("cy", "only_external")}


def test_jsonl_and_benchmark(spark, tmp_path):
    rows = [
        {"id": "a", "input": "go to the hall", "goals": ["go(hall)"], "meta": {"family": "f"}},
        {"id": "b", "input": "GO to  the hall", "goals": ["go(hall)"], "meta": {"family": "f"}},
        {"id": "a", "input": "x", "goals": ["go(x)"]},
        {"id": "c", "input": " ", "goals": ["go(x)"]},
        {"id": "d", "input": "y", "goals": ["go("]},
    ]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    df = records.read_jsonl(spark, str(path))
    assert {(r.id, r.problem) for r in records.benchmark_problems(df).collect()} == {("b", "duplicate input"), ("a", "duplicate id"), ("c", "empty input"), ("d", "invalid goals")}
    with pytest.raises(ValueError):
        records.load_benchmark(df)
    assert records.load_benchmark(df.where("row_id = 0"), ["f"]).count() == 1
    assert records.read_jsonl(spark, str(path), max_rows=2).count() == 2
    problems = [r.problem for r in records.training_rows(df).orderBy("row_id").collect()]
    assert problems[0] is None and problems[3] == "no input" and problems[4].startswith("bad plan")
    records.write_jsonl(df, str(tmp_path / "out"), ["input", "goals"], "row_id")
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_stream(spark, tmp_path):
    rows = [(1, "Go there", ["go(x)"], "2026-01-01 00:00:00"), (2, "go  there", ["go(x)"], "2026-01-01 00:01:00"), (3, "um take it", ["take("], "2026-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "row_id long, input string, goals array<string>, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = pipeline.read_records(spark, str(tmp_path / "in"), "row_id long, input string, goals array<string>, ts timestamp")
    checked = pipeline.checked_stream(pipeline.first_per_text(stream, "ts"))
    q = checked.writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.normalized_input: r.valid for r in spark.sql("select * from checked").collect()}
    assert got == {"go there": True, "take it": False}


def test_gate_before_the_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "go", None), (2, None, "no input")], "row_id long, input string, problem string")
    with pytest.raises(ValueError, match="1 x no input"):
        records.write_checked(df, str(tmp_path / "out"), ["row_id", "input"])
    assert not (tmp_path / "out").exists()
    records.write_checked(df.where("problem is null"), str(tmp_path / "out"), ["row_id", "input"])
    assert spark.read.json(str(tmp_path / "out")).count() == 1
