"""Input beyond limits that there used to be, and rows that used to get lost."""

from folioscope.operators import evaluation as E
from folioscope.operators import html_text as H
from folioscope.operators import metrics as M
from folioscope.sources import pages as P


def test_links_with_many_steps_up(spark):
    rows = [("p", "https://h.example/a/b/c/d/e/f/x?q=../z", "".join(f'<a href="{h}">x</a>' for h in ("../../../../../../y/", "../../g", "./k", "../" * 9 + "top", "//o.example/a/../b", "z?u=/a/../b")))]
    got = {r["link"] for r in H.links(spark.createDataFrame(rows, "page string, url string, text string")).collect()}
    assert got == {"https://h.example/y", "https://h.example/a/b/c/d/g", "https://h.example/a/b/c/d/e/f/k", "https://h.example/top", "https://o.example/b", "https://h.example/a/b/c/d/e/f/z?u=/a/../b"}


def test_first_alerts_and_the_number_of_the_others(spark):
    rows = [(f"p{i % 40:02d}", i, "R", "x", "error" if i % 3 else "warning") for i in range(300)]
    alerts = spark.createDataFrame(rows, "page string, line int, rule string, found string, severity string")
    got = sorted((r["severity"], r["place"], r["page"], r["line"]) for r in M.annotations(alerts, 20).collect())
    first = {s: sorted((r[0], r[1]) for r in rows if r[4] == s)[:20] for s in ("error", "warning")}
    assert got == [(s, k, *x) for s in ("error", "warning") for k, x in enumerate(first[s], 1)]
    assert {(r["severity"], r["further"]) for r in M.suppressed(alerts, 20).collect()} == {("error", 180), ("warning", 80)}


def test_defects_without_a_place_take_no_share(spark):
    pages = spark.createDataFrame([(f"p{i}", '{"oneKey": 1}' if i % 2 else "nothing") for i in range(40)], "page string, text string")
    claims = pages.selectExpr("'body_param' AS kind", "page", "1 AS line", "'GET' AS method", "'/a' AS path", "'oneKey' AS name", "'' AS base", "'curl' AS origin", "'' AS value", "'' AS field", "false AS has_auth")
    got = E.mutations(claims, pages, per_kind=8).collect()
    assert len(got) == 8 and all("one_key" in r["text"] for r in got)


def test_many_rules_of_robots(spark):
    rules = spark.createDataFrame([("*", "disallow", f"/d{i}/") for i in range(3000)] + [("*", "allow", "/d7/open")], "agent string, rule string, path string")
    urls = spark.createDataFrame([(1, "https://h/d2999/x"), (2, "https://h/d7/open"), (3, "https://h/other"), (4, "https://h")], "pos int, url string")
    assert sorted(r["pos"] for r in P.allowed(urls, rules, "me").collect()) == [2, 3, 4]
    assert sorted(r["pos"] for r in P.sitemap(spark.createDataFrame([("<loc>https://h/a?b&#61;1&amp;c&eacute;</loc>",)], "xml string")).collect()) == [0]


def test_wide_sides_are_not_broadcast(spark, monkeypatch):
    from folioscope.core import runtime

    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 1000)
    small, wide = spark.createDataFrame([("a" * 10,)], "x string"), spark.createDataFrame([("a" * 2000,)], "x string")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(runtime.broadcast_checked(small)) and not hinted(runtime.broadcast_checked(wide))


def test_written_tables_are_removed(spark):
    import os

    from folioscope.core import runtime

    runtime.written(spark.range(5))
    folder = f"{runtime.shared_folder(spark)}/{runtime._own(spark)}".removeprefix("file:")
    assert os.path.isdir(folder)
    runtime.clear(spark)
    assert not os.path.exists(folder)
