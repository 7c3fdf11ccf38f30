import ast
import json
from pathlib import Path

import pytest

from folioscope.operators import html_text as H
from folioscope.sources import pages as P
from folioscope.sources import paged_api
from folioscope.streaming import monitor

REPO = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_llm_package():
    for path in [*(REPO / "folioscope").rglob("*.py"), *(REPO / "tests").glob("*.py"), REPO / "bench.py", REPO / "compare.py"]:
        if "llm" in path.relative_to(REPO).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_directory(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.mdx").write_text("---\ntitle: T\n---\nx", encoding="utf-8")
    (tmp_path / "y.md").write_text("ü", encoding="utf-8")
    (tmp_path / "z.txt").write_text("no", encoding="utf-8")
    got = {(r["page"], r["title"], r["text"][-1]) for r in P.directory(spark, str(tmp_path)).collect()}
    assert got == {("a/b/x.mdx", "T", "x"), ("y.md", "y", "ü")}
    assert [r["page"] for r in P.directory(spark, str(tmp_path), exclude=("a/**",)).collect()] == ["y.md"]
    changed = spark.createDataFrame([("y.md",), ("y.md",), ("gone",)], "path string")
    assert P.changed(P.directory(spark, str(tmp_path)), changed).count() == 1
    assert P.source(spark, {"type": "filesystem", "root": str(tmp_path)}).count() == 2
    with pytest.raises(ValueError):
        P.source(spark, {"type": "carrier pigeon"})


def test_safe_paths(spark):
    df = spark.createDataFrame([(p,) for p in ["/a/b/", "", "a/../../b", "x.mdx", "..", "a..b"]], "p string")
    assert [r[0] for r in df.select(P.safe_path(df.p)).collect()] == ["a/b.md", "index.md", None, "x.mdx", None, "a..b.md"]


def test_api(spark):
    pages = [{"data": [{"id": "1", "f": {"b": "x", "t": "T"}}], "next": "u2"}, {"data": [{"id": "2", "f": [{"b": "y"}]}, {"id": "3", "f": {"b": " "}}], "next": "u1"}]
    store = {"u1": json.dumps(pages[0]), "u2": json.dumps(pages[1])}
    seen = list(paged_api.responses("u1", "next", {}, lambda u, h: store[u]))
    assert [u for u, _ in seen] == ["u1", "u2"]  # the second page leads back to the first
    df = spark.createDataFrame(seen, "url string, response string")
    got = {tuple(r) for r in P.api_pages(df, "data", {"id": "id", "body": "f.b", "title": "f.t"}).collect()}
    assert got == {("1", "x", "T", "", ""), ("2", "y", "", "", "")}
    with pytest.raises(RuntimeError):
        paged_api.PagedApiReader({"token_env": "NO_SUCH_TOKEN"})


def test_sites(spark):
    xml = spark.createDataFrame([("<loc>https://h/a</loc><loc>\nhttps://h/b?x&amp;y </loc><loc>https://o/c</loc><loc>https://h/a</loc>",)], "xml string")
    urls = P.sitemap(xml)
    assert [r["url"] for r in P.url_filter(urls, "h").orderBy("pos").collect()] == ["https://h/a", "https://h/b?x&y"]
    assert [r["url"] for r in P.url_filter(urls, "h", include=["/b"], limit=5).collect()] == ["https://h/b?x&y"]
    listed = spark.createDataFrame([(0, "# no"), (1, " https://h/a "), (2, "")], "pos int, value string")
    assert [r["url"] for r in P.url_list(listed).collect()] == ["https://h/a"]
    robots = spark.createDataFrame([("User-agent: a\nUser-agent: *\nDisallow: /p # c\nAllow: /p/q\nCrawl-delay: 3",)], "value string")
    rules = P.robots_rules(robots)
    assert {(r["agent"], r["crawl_delay"]) for r in rules.filter("crawl_delay IS NOT NULL").collect()} == {("a", 3.0), ("*", 3.0)}
    some = spark.createDataFrame([(1, "https://h/p/x"), (2, "https://h/p/q/x"), (3, "https://h/")], "pos int, url string")
    assert sorted(r["pos"] for r in P.allowed(some, rules, "me").collect()) == [2, 3]
    assert P.allowed(some, rules.limit(0), "me").count() == 3


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "e"), ("c", "a"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert [tuple(r) for r in P.crawl(edges, seeds).collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert [r["url"] for r in P.crawl(edges, seeds, budget=2).collect()] == ["a", "b"]


def test_fetched_pages(spark):
    df = spark.createDataFrame([("https://h/a/b/?q", "<h1>T</h1><p>x &copy; y</p>", None), ("https://h", None, "timeout")], "url string, html string, error string")
    got = {r["page"]: (r["title"], r["revision"], r["text"]) for r in P.fetched(df).collect()}
    assert got == {"a/b": ("T", "", "# T\nx © y\n"), "index": (None, "error: timeout", "")}


def test_alerts_and_history(spark, tmp_path):
    one = json.dumps({"p.md": [{"Check": "S.R", "Severity": "error", "Line": 3, "Span": [1, 2], "Match": "m", "Message": "x", "Link": ""}]})
    assert [tuple(r)[:4] for r in P.alerts_json(spark.createDataFrame([(one,)], "value string")).collect()] == [("p.md", "S.R", "error", 3)]
    (tmp_path / "a.json").write_text('{"total": 3}\n\n')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["total"] for r in P.history(spark, str(tmp_path), "total int").collect()] == [3]
    assert P.json_lines(spark, str(tmp_path / "none"), "a int").count() == 0


def test_html(spark):
    html = "<nav>n</nav><h2>H <i>i</i></h2><p>a&nbsp;b <code>c</code></p><pre>d\n  e</pre><ul><li>f</li></ul><a href='/x/'>1</a><a href='../y#z'>2</a><a href='w'>3</a><a href='#top'>4</a><script>var a = 1;</script><style>s</style>"
    df = spark.createDataFrame([("p", "https://h/q/r?s", html)], "page string, url string, text string")
    text = H.markdown(df).first()["markdown"]
    assert "## H i\n" in text and "`c`" in text and "```\nd\n e\n```" in text and "f\n" in text and "<" not in text and "n" not in text.split("##")[0]
    assert {r["link"] for r in H.links(df).collect()} == {"https://h/x", "https://h/y", "https://h/q/w"}
    b = H.budget(df).first()
    assert b["inline_script"] == len("var a = 1;") and b["inline_style"] == 1 and b["total"] == len(html)
    assert H.diagnosis(df).first()["verdict"] == "blocked"


LONG = "Words of the page, one after the other. " * 8


@pytest.mark.parametrize(
    ("source", "via", "chars"),
    [
        (f"<body><nav>{LONG}</nav><main><p>{LONG}</p><aside>x</aside></main></body>", "main", 319),
        (f"<main>short</main><div id='content'><p>{LONG}</p></div>", "#content", 319),
        (f"<body><div><div><p>{LONG}</p></div><span>{LONG}</span></div></body>", "densest-block", 319),
        ("<body><main>tiny</main><div>no block</div></body>", "main", 4),
        ("<body><div><p>some</p></div></body>", "densest-block", 4),
        ("<body>bare <b>text</b><script>x</script></body>", "body", 9),
        ("", "body", 0),
    ],
)
def test_main_content(source, via, chars):
    assert H.pick_main(source)[1:] == (via, chars)


def test_json_islands(spark):
    prose = "This is the guide to the index, and you can use it for all of your data in the app that you are on."
    df = spark.createDataFrame([("p", f'<p>x</p><script>window.s = {json.dumps({"a": [prose, prose + " More of the same."], "b": "https://h/x", "c": "{}" * 60})};</script>'), ("q", "<p>one two</p><script>{bad</script>")], "page string, text string")
    got = {r["page"]: (r["origin"], r["text"]) for r in H.best_text(df).collect()}
    assert got["p"][0] == "json" and got["p"][1].count(prose) == 2 and got["q"] == ("html", "one two\n")


def test_stream_folds_each_file_once(spark, tmp_path):
    schema = "run_id bigint, kind string, check_id string, page string, line int, severity string"
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(1, "k", "c", "p", 1, "error"), (1, "k", "c", "p", 5, "warning")], schema).write.parquet(folder)
    for _ in range(2):
        monitor.fold(spark, folder, schema, out, mark)
    spark.createDataFrame([(2, "k", "c", "q", 1, None)], schema).write.mode("append").parquet(folder)
    monitor.fold(spark, folder, schema, out, mark)
    got = {(r["run_id"], r["fingerprint"], r["worst"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "k:c:p", 0, 2), (2, "k:c:q", 2, 1)}
