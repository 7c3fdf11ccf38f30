import datetime as dt

from folioscope.operators import runs as R
from folioscope.operators import snapshots as S

RUN = "run_id bigint, run_ts timestamp, source string, label string, total bigint, by_level map<string,bigint>, fingerprints array<string>, loaded_at timestamp, path string, sign int"
SNAP = "run_id bigint, source string, path string, revision string, fetched_at timestamp, loaded_at timestamp, label string, copies int"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def run(i, at, prints, label="a", loaded=None, source="s"):
    return (i, day(at), source, label, None if prints is None else len(prints), None if prints is None else {"error": 1}, prints, day(loaded or at), "x", 0)


def snap(i, path, revision, fetched=1, loaded=1):
    return (i, "s", path, revision, day(fetched), day(loaded), "x", 0)


RUNS = [run(7, 1, ["a", "b", "a"]), run(3, 2, None), run(5, 3, ["b", "c"]), run(5, 3, ["z"], loaded=2), run(9, 4, []), run(20, 1, ["a"], label="other")]
SNAPS = [
    *[snap(7, p, r) for p, r in [("same", 'W/"A1"'), ("changes", "1"), ("goes", "1"), ("late", None), ("error", "5"), ("back", "9"), ("twice", "1")]],
    *[snap(3, p, r) for p, r in [("same", "a1"), ("changes", "2"), ("late", " "), ("error", "error: timeout"), ("twice", "2"), ("new", "1")]],
    snap(3, "twice", "1", fetched=2),
    snap(3, "twice", "1", fetched=2),
    *[snap(5, p, r) for p, r in [("same", '"a1"'), ("changes", None), ("late", "7"), ("error", "6"), ("back", "8"), ("twice", "1"), ("new", "1"), (None, "1")]],
    snap(99, "unknown run", "1"),
]


def tables(spark):
    return spark.createDataFrame(SNAPS, SNAP), spark.createDataFrame(RUNS, RUN)


def test_page_changes(spark):
    snaps, runs = tables(spark)
    got = {(r["run_id"], r["path"], r["change_kind"]) for r in S.page_changes(snaps, runs).collect()}
    # late: its first known revision is no change; error: compared with the last known one; back: added anew, so its old revision does not count
    assert got == {
        (3, "changes", "changed"), (3, "goes", "removed"), (3, "back", "removed"), (3, "new", "added"),
        (5, "error", "changed"), (5, "back", "added"), (5, None, "added"),
        *[(9, p, "removed") for p in ("same", "changes", "late", "error", "back", "twice", "new", None)],
    }


def test_fingerprint_changes(spark):
    _, runs = tables(spark)
    got = {tuple(r) for r in S.fingerprint_changes(runs).collect()}
    # run 3 did not finish, so run 5 is held against run 7; of run 5 the last delivery counts
    assert got == {(5, "c", "added"), (5, "a", "removed"), (9, "b", "removed"), (9, "c", "removed")}


def test_empty_tables(spark):
    snaps, runs = tables(spark)
    assert S.found_changes(snaps.limit(0), runs.limit(0)).collect() == []
    assert S.page_changes(snaps, runs.limit(0)).collect() == []


def test_general_diff_counts_copies(spark):
    cols = "k string, v int"
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), (None, 3), ("z", None)], cols)
    b = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("n", 1), ("z", None)], cols)
    got = {(r["k"], r["change_kind"], r["old_v"], r["new_v"]) for r in S.snapshot_diff(a, b, ["k"], ["v"]).collect()}
    assert got == {("x", "removed", 1, None), ("y", "changed", 1, 2), ("n", "added", None, 1)}


def test_deltas_and_regressions(spark):
    _, runs = tables(spark)
    deltas = {r["run_id"]: r["total_delta"] for r in R.deltas(runs).collect()}
    assert deltas[7] is None and deltas[3] is None and deltas[9] == -2
    findings = spark.createDataFrame([(5, "k", "c", "p", 1, "error"), (5, "k", "c", "p", 9, "error")], "run_id bigint, kind string, check_id string, page string, line int, severity string")
    runs2 = spark.createDataFrame([run(7, 1, ["x:y:z"]), run(5, 3, ["k:c:p", "k:d:p"])], RUN)
    assert [tuple(r) for r in R.regressions(runs2, findings).collect()] == [(5, "k:c:p")]
    counts = {r["run_id"]: (r["new"], r["fixed"]) for r in R.change_counts(runs2).collect()}
    assert counts == {5: (2, 1)}


def test_snapshot_maps(spark):
    rows = [(1, "k", "c", "p", 1, "error"), (1, "k", "c", "p", 2, "error"), (1, "j", "d", "p", 1, None)]
    df = spark.createDataFrame(rows, "run_id bigint, kind string, check_id string, page string, line int, severity string")
    r = R.snapshot(df, ["run_id"]).first()
    assert r["total"] == 3 and r["by_level"] == {"error": 2} and r["by_kind"] == {"k": 2, "j": 1} and r["fingerprints"] == ["j:d:p", "k:c:p"]
