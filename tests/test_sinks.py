import pytest

from tracewright.sources import sinks


def test_events_are_appended_and_named_when_bad(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "start", 1)], "ts string, type string, n long")
    sinks.append_events(df, path)
    sinks.append_events(df.selectExpr("ts", "'end' as type", "n"), path)
    assert sorted(r["type"] for r in sinks.read_events(spark, path).collect()) == ["end", "start"]
    (tmp_path / "log" / "part-x.txt").write_text('\n{"ts":"a","type":"b"}\n{"ts":"a"}\n')
    with pytest.raises(Exception, match="at line 3"):
        sinks.read_events(spark, path).collect()


def test_bundles_are_written_once(spark, tmp_path):
    root = str(tmp_path / "bundles")
    rows = [("r1", "report.md", "# a\nb"), ("r1", "report.json", '{"a":1}'), ("r2", "report.md", "# c")]
    df = spark.createDataFrame(rows, "run string, name string, content string")
    assert sinks.materialize(df, root, ["run", "name"]) == 3
    assert sinks.materialize(df, root, ["run", "name"]) == 0
    more = spark.createDataFrame([*rows, ("r3", "report.md", "")], "run string, name string, content string")
    assert sinks.materialize(more, root, ["run", "name"]) == 1
    other = spark.createDataFrame([("r1", "report.md", "# changed"), ("r4", "x", "y")], "run string, name string, content string")
    with pytest.raises(sinks.ContentConflict, match="r1/report.md"):
        sinks.materialize(other, root, ["run", "name"])
    got = {(r["run"], r["name"]): r["content"].rstrip("\n") for r in sinks.stored_files(spark, root, ["run", "name"]).collect()}
    assert got == {(a, b): c for a, b, c in rows} | {("r3", "report.md"): ""}
