import json

from folioscope.functions.rules import catalog, rules
from folioscope.sources import sinks

FINDING = "detector string, page string, line int, message string, confidence double, evidence string, suggestion string, needs_review boolean, base string, origin string, snippet string"
ROWS = [("d", "p", 0, "m <x>", 0.9, "e", "", False, "", "curl", ""), ("d", "p", 4, None, 0.6, "e", "", False, "", "curl", ""), ("d", "p", 5, "m", 0.1, "e", "", True, "", "curl", "")]


def test_findings(spark):
    df = spark.createDataFrame(ROWS, FINDING)
    got = [json.loads(r[0]) for r in sinks.findings_json(df).collect()]
    assert [g["severity"] for g in got] == ["high", "medium", "low"]
    sarif = [json.loads(r[0]) for r in sinks.findings_sarif(df).collect()]
    assert [s["level"] for s in sarif] == ["error", "warning", "note"]
    assert [s["locations"][0]["physicalLocation"]["region"]["startLine"] for s in sarif] == [1, 4, 5]


def test_axes_and_numbers():
    assert [sinks.nice_ceiling(x) for x in (0, 1, 1.1, 21, 26, 60, 1000)] == [1, 1, 2, 25, 50, 100, 1000]
    assert [sinks.compact(x) for x in (7, 999, 1000, 1234)] == ["7", "999", "1k", "1.2k"]


def test_dashboard(spark):
    trend = spark.createDataFrame([(1, "s", "a", "x", 10, 1, 2, 7), (2, "s", "a", "y", 1200, 0, 0, 0)], "run_id int, source string, label string, at string, total bigint, error bigint, warning bigint, suggestion bigint")
    checks = spark.createDataFrame([("c<", 5)], "check_id string, n bigint")
    page = sinks.dashboard(trend, checks, spark.createDataFrame(ROWS, FINDING))
    assert "total: 1.2k" in page and "<polyline" in page and "c&lt;" in page and "m &lt;x&gt;" in page
    one = sinks.dashboard(trend.limit(1), checks.limit(0), spark.createDataFrame([], FINDING))
    assert "<polyline" not in one


def test_tables(spark, tmp_path):
    runs = spark.createDataFrame([(1, 3)], "run_id int, total int")
    for _ in range(2):
        sinks.write_history(runs, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    sinks.write_json_lines(runs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["total"] == 3
    pages = spark.createDataFrame([("../x", "t", "u", "r"), ("a", "t", "u", "r")], "page string, title string, url string, revision string")
    assert [json.loads(r[0])["file"] for r in sinks.index_json(pages).collect()] == ["a.md"]


def test_catalog():
    rows = catalog(rules())
    assert rows == sorted(rows) and ("Filler", "existence", "warning", "text", 9, False) in rows and ("Wordiness", "substitution", "warning", "text", 18, True) in rows
