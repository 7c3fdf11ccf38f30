"""The operators against brute force and hand-made cases."""

import datetime as dt
import itertools
import random
import re

import numpy as np
import pytest

from folioscope.llm import boilerplate, leaks, markup, near_duplicates, packing, repeated_lines, repetition, residue, text

T = dt.datetime(2025, 1, 1)
PAGE = "page_id bigint, text string, url string, loaded_at timestamp"
NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(NAMES) + str(rng.randrange(40)) for _ in range(n))


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


# --- markup


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("plain text, nothing else\n- item\n1. item\na | b | c", []),
        ("---\ntitle: **x**\n---\nplain", []),
        ("```\n<b>no</b> **no**\n```\n`**no**` and `<i>`", []),
        ("Welcome to {{page.title}} and ${name} and <%= x.y %> and [Your name] and $TITLE$", []),
        ("# Head\n\ntext", ["markdown"]),
        ("Head\n----\n\ntext", ["markdown"]),
        ("see [this](/x)", ["markdown"]),
        ("line<br/>", ["html"]),
        ("a &amp; b", ["html"]),
        ("a &lt;br&gt; b", ["html"]),
        ("<!-- c -->", ["html"]),
        ("<Note>\nhm\n</Note>", ["html"]),
        ("<pre><code>\n**no** \\frac\n</code></pre>", ["html"]),
        ("= Head =\n\n# one\n# two", ["wiki"]),
        ("'''bold''' and [[link|text]]", ["wiki"]),
        ("{{note|text}}", ["wiki"]),
        ("\\section{Head}\n\ntext", ["latex"]),
        ("\\begin{verbatim}\n<b> **x**\n\\end{verbatim}", ["latex"]),
        ("the score is $x_1 = 2$ here", ["latex"]),
        ("it costs $5 and $6", []),
        ("<math>x = 1</math>", ["html", "latex"]),
        ("[a](b) <i>c</i> \\emph{d} ''e''", ["html", "latex", "markdown", "wiki"]),
    ],
)
def test_notations(source, found):
    assert markup.Page(source, clean=False).notations() == found


def test_clean_text_keeps_structure():
    text = "---\ntitle: t\n---\n## Head *one*\n\nFirst **bold** [link](/x) &amp; `code`, and more words to make a paragraph of it.\n\n- one item that is long enough to be one\n1. two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```py\nx = 1\n```\n\n$$\na + b\n$$\n\nLast paragraph, with quite a lot of words so that it is content too."
    got = markup.Page(text).render()
    for part in ("## Head one", "First bold link & `code`", "- one item", "1. two", "| a | b |", "| 1 | 2 |", "```py\nx = 1\n```", "$$a + b$$", "Last paragraph"):
        assert part in got
    assert "**" not in got and "---" not in got and "title" not in got


def test_clean_text_of_other_notations():
    assert "# Head" in markup.Page("= Head =\n\nSome '''bold''' words in a paragraph, which is long enough to be kept here.").render()
    got = markup.Page("\\section{Head}\n\nSome \\textbf{bold} words with \\texttt{code} in a paragraph, long enough to be kept.\n\\begin{itemize}\n\\item one of the items, which is long enough\n\\end{itemize}").render()
    assert "# Head" in got and "Some bold words with `code`" in got and "- one of the items" in got
    got = markup.Page("<h2>Head</h2>\n<p>Some <b>bold</b> words&mdash;in a paragraph, which is long enough to be kept here.</p>\n<ul>\n<li>one of the items of the list, a long one</li>\n</ul>").render()
    assert "## Head" in got and "Some bold words—in" in got and "- one of the items" in got


def test_paragraphs_of_a_thin_path_are_left_out_amid_content():
    body = "<p>Each cluster sorts its oldest shard before the next restart begins, and the others wait for it, as they must.</p>\n"
    out = markup.Page("<main>\n" + body * 4 + "<aside>\n" + "<p>See also</p>\n" * 8 + "</aside>\n" + body * 4 + "</main>").render()
    assert "See also" not in out and out.count("Each cluster") == 8


def test_deep_and_unclosed_elements_lose_no_text():
    deep = "<div>\n" * 300 + "<p>at the bottom of it all</p>\n" + "</div>\n" * 300 + "<p>after it</p>"
    out = markup.Page(deep).render()
    assert "at the bottom" in out and "after it" in out
    items = markup.Page("<ul>\n" + "".join(f"<li>item number {chr(97 + k % 26)}\n" for k in range(200)) + "</ul>").render()
    assert items.count("- item number") == 200


def test_text_around_code_elements_on_a_line():
    first, last = "The first paragraph has quite a lot of words, so that it is content.", "The last paragraph has quite a lot of words too, and it is content."
    got = markup.Page(f"<html><body><h1>Head</h1><p>{first}</p><script>var x = 1;</script><pre>a = b\nc = d</pre><p>{last}</p></body></html>").render()
    assert got.index("# Head") < got.index(first) < got.index("```\na = b\nc = d\n```") < got.index(last) and "var x" not in got
    far = f"{first} <pre>\n# no heading\n</pre> {last}"
    assert markup.Page(far).render().split("\n")[0] == first and last in markup.Page(far).render() and "```\n# no heading\n```" in markup.Page(far).render()
    assert markup.Page(far, clean=False).notations() == ["html"]
    assert markup.Page("<pre>x</pre> and **strong** words", clean=False).notations() == ["html", "markdown"]
    for line in (f"Use `<script>` here. {first}", f"<p>A <source src='x'> is void. {first}</p>"):
        assert last in markup.Page(f"{line}\n\n{last}").render()


# --- boilerplate


def site_pages(host, n, rng, start=0):
    out = []
    for i in range(n):
        body = [f"# Title {prose(rng, 2)}", "By the writers of Host, 2025-01-0%d" % (1 + i % 9)] + [x for _ in range(4) for x in (prose(rng, 14) + ".", "")]
        if i % 2:
            body.insert(4, "Share this page with your team and your friends")
        top = ["Skip to content", "- [Blog](/blog/)", "- [Docs](/docs/)", f"Docs / Title {i}"]
        bottom = ["", "Related articles", f"- [{prose(rng, 3)}](/a)", f"- [{prose(rng, 3)}](/b)", "© 2025 Host. All rights reserved", "Back to top"]
        out.append((start + i, "\n".join(top + body + bottom), f"https://{host}/p/{i}", T))
    return out


def test_surroundings(spark):
    rng = random.Random(1)
    rows = site_pages("docs.host.example", 30, rng) + site_pages("www.docs.host.example:443", 10, rng, 100)
    rows.append((500, rows[0][1], None, T))  # no url, but the site's own lines
    got = boilerplate.surroundings(spark.createDataFrame(rows, PAGE)).collect()
    found = {(r["page_id"], r["line_no"]) for r in got}
    for i, t, _, _ in rows:
        lines = t.split("\n")
        own = {k for k, x in enumerate(lines, 1) if x.startswith(("Skip", "- [", "Docs /", "Related", "©", "Back"))}
        assert {k for p, k in found if p == i} == own
    clean = {r["page_id"]: r["text"] for r in boilerplate.main_content(spark.createDataFrame(rows, PAGE)).collect()}
    assert clean[1].startswith("# Title") and "Share this page" in clean[1] and "Back to top" not in clean[1]


def test_long_menus():
    menu = " ".join(f"[Guide to topic {chr(97 + i)}](/guides/topic-{chr(97 + i)})" for i in range(26))
    assert len(menu) > 400 and boilerplate.Lines(f"{menu}\n\nText of the page.").no == [1, 3, 3]
    nav = ["<nav class='all'>"] + [f"<a href='/{i}'>Topic {i}</a>" for i in range(300)] + ["</nav>"]
    page = boilerplate.Lines("\n".join(nav))
    assert page.no == list(range(1, 303)) and set(page.path) == {"nav.all"}


# --- residue


@pytest.mark.parametrize(
    "line",
    ["Please enable JavaScript to view this page.", "<h1>Internal Server Error</h1>", "Coming soon", "TBD", "Lorem ipsum dolor sit amet consectetur adipiscing elit", "Welcome to {{page.title}}, where you sort.", "The current release of [object Object] sorts.", "Install %PRODUCT_NAME%", "Contact undefined before you sort.", "asdf asdf asdf\nqwer test test 123"],
)
def test_residue(spark, line):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40), None, T) for i in range(40)] + [(100, prose(rng, 40) + "\n\n" + line + "\n\n" + prose(rng, 40), None, T)]
    assert [r["page_id"] for r in residue.residue_pages(spark.createDataFrame(rows, PAGE)).collect()] == [100]


@pytest.mark.parametrize(
    "line",
    ["Write the template as `${HOST}` and the engine sorts each token.", "Write the template as %NAME% and the engine sorts each token.", "In scripts, an undefined filter is skipped and a null value sorts tokens.", "Filler text such as lorem ipsum in the demo helps to test the facet.", "The error page of vim reads access denied, which reviewers can restyle.", "A missing field returns 404 Not Found with the code `x`.", "Replace YOUR_API_KEY with the key of it.", "{{citation needed}}", "```\n{{page.title}} [object Object]\n```", "\\texttt{{{doc.title}}}"],
)
def test_no_residue(spark, line):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40), None, T) for i in range(40)] + [(100, prose(rng, 40) + "\n\n" + line + "\n\n" + prose(rng, 40), None, T)]
    assert residue.residue_pages(spark.createDataFrame(rows, PAGE)).collect() == []


# --- near duplicates


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for family in range(12):
        base = prose(rng, 160).split()
        for k in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(k * 2):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
            if k == 3:
                w = w[80:] + w[:80]
            rows.append((len(rows), " ".join(w), None, T))
    rows += [(1000, rows[0][1].upper(), None, T), (1001, rows[0][1], None, T), (1002, "short", None, T)]
    expected = set()
    for (a, x, *_), (b, y, *_) in itertools.combinations(rows, 2):
        s, t = shingles(x), shingles(y)
        if len(words(x)) >= 100 and len(words(y)) >= 100 and len(s & t) / len(s | t) >= 0.7:
            expected.add((a, b))
    pages = spark.createDataFrame(rows, PAGE)
    assert {tuple(r) for r in near_duplicates.pairs(pages).collect()} == expected
    groups = {r["page_id"]: r["group_id"] for r in near_duplicates.groups(pages).collect()}
    for a, b in expected:
        assert groups[a] == groups[b]


def test_blocks_of_a_hot_key_lose_no_pair(spark):
    rows = spark.range(60).selectExpr("CAST(id % 20 = 0 AS BIGINT) AS k", "id AS x")
    got = [(r["x"], r["y"]) for r in near_duplicates.met_in_blocks(rows, "k", ["x"], ["y"], 7).filter("x < y").collect()]
    assert len(got) == len(set(got)) == 57 * 56 // 2 + 3


def test_groups_that_only_a_pair_beside_the_stars_joins(spark):
    """1 and 2, 3 and 4 are near; 2 and 3 are near as well, but only 9, near to neither, has an edge to both."""
    edges = spark.createDataFrame([(1, 2, 90, 100), (3, 4, 90, 100), (2, 9, 50, 100), (3, 9, 45, 100)], "a bigint, b bigint, common int, together int")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (9, 9)], "id bigint, root bigint")
    assert {tuple(r) for r in near_duplicates.parting_pairs(edges, roots).collect()} >= {(2, 3)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.r_[a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)]
    runs, owner = np.r_[a, b] * np.uint64(2), np.repeat([0, 1], 1000)
    s = near_duplicates.sketch(runs, owner, 2, 1024)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08
    few = near_duplicates.sketch(runs[:3], owner[:3], 1, 128)
    assert (few != near_duplicates.EMPTY).all()


def test_components_of_a_very_long_chain(spark):
    """Ids in no order along the chain, which takes many rounds."""
    ids = random.Random(2).sample(range(5000), 700)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint")
    assert {r["root"] for r in near_duplicates.components(spark.createDataFrame([(i,) for i in ids], "id bigint"), edges).collect()} == {min(ids)}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300).withColumnRenamed("id", "id")
    edges = spark.range(250).selectExpr("id AS a", "id + 1 AS b")
    got = {r["id"]: r["root"] for r in near_duplicates.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(251)) and all(got[i] == i for i in range(251, 300))


@pytest.mark.parametrize("line", ["Loading, please wait", "Access denied", "You do not have permission to access this resource.", "Lorem ipsum dolor sit amet consectetur adipiscing elit"])
@pytest.mark.parametrize("n", [3, 60])
def test_residue_that_a_third_of_the_pages_are(spark, line, n):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) if i % 3 else line, None, T) for i in range(n)]
    assert sorted(r["page_id"] for r in residue.residue_pages(spark.createDataFrame(rows, PAGE)).collect()) == list(range(0, n, 3))


@pytest.mark.parametrize(
    "passage",
    ["<div><h1>Page not found</h1><p>{}</p></div>", "{}. Coming soon. {}", "{}. Loading,\nplease wait. {}", "{} you need to enable JavaScript to run this app and {}", "{} You need to enable\nJavaScript to run\nthis app. {}", "{} and lorem ipsum dolor sit amet consectetur then {}", "Access denied. " * 30],
)
def test_residue_within_a_passage(spark, passage):
    rng = random.Random(5)
    text = passage.replace("{}", "the facet sorts every token of one cluster before the next restart and keeps it there", 2)
    rows = [(i, prose(rng, 40), None, T) for i in range(40)] + [(100, text, None, T), (101, "A 503 Service Unavailable response means that the facet\nis restarting; reviewers retry it.", None, T)]
    assert [r["page_id"] for r in residue.residue_pages(spark.createDataFrame(rows, PAGE)).collect()] == [100]


# --- repeated lines


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        host = ["https://a.example/", "HTTP://WWW.A.example:80/x", "https://b.example"][i % 3]
        lines = [prose(rng, 5) for _ in range(3)] + ["All rights reserved 20%02d <b>by</b> Host" % (i % 30)] * (i % 3 == 0 or i % 7 == 0) + ["too short"]
        rng.shuffle(lines)
        rows.append((i, "\r\n".join(lines), host, T + dt.timedelta(days=i // 40)))
    rows += [(5, rows[5][1], rows[5][2], T + dt.timedelta(days=9)), (300, None, "https://b.example", T), (301, "All rights reserved by Host", None, T)]
    pages = {r[0]: r for r in sorted(rows, key=lambda r: r[3])}

    def key(line):
        return " ".join(re.sub(r"\d+", "0", w) for w in words(re.sub(r"<[^<>]*>", "", line)))

    site = lambda u: re.sub(r"^www\.", "", re.search(r"//([^/:]+)", u.lower())[1]) if u else None
    held, total = {}, {}
    for i, t, u, _ in pages.values():
        if site(u):
            total[site(u)] = total.get(site(u), 0) + 1
            for k in {key(x) for x in (t or "").split("\n")}:
                held.setdefault((site(u), k), set()).add(i)
    hot = {k for k, p in held.items() if len(k[1].split()) >= 4 and len(p) >= 5 and len(p) * 100 >= 20 * total[k[0]]}
    expected = {(i, n) for i, t, u, _ in pages.values() if site(u) for n, x in enumerate((t or "").split("\n"), 1) if (site(u), key(x)) in hot}
    assert expected
    df = spark.createDataFrame(rows, PAGE)
    assert {tuple(r) for r in repeated_lines.repeated_lines(df).collect()} == expected
    for r in repeated_lines.rebuilt_pages(df).collect():
        kept = [x for n, x in enumerate((pages[r["page_id"]][1] or "").split("\n"), 1) if (r["page_id"], n) not in expected]
        assert r["text"] == "\n".join(kept)


def test_threshold_crossings_both_ways(spark):
    keys = spark.createDataFrame([("s", 1, 5, 6), ("s", 2, 4, 7), ("s", 3, 5, 5), ("s", 4, 0, 1)], "site string, key bigint, old bigint, n_pages bigint")
    sites = spark.createDataFrame([("s", 20, 30)], "site string, old bigint, site_pages bigint")
    got = {r["key"]: (r["was"], r["now"]) for r in repeated_lines.crossings(keys, sites).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False)}


def test_every_page_comes_out_clean_and_later_runs_rebuild_what_crossed(spark, tmp_path):
    """From the empty state all pages come out; with the saved state only new pages and those whose keys crossed."""
    url = "https://a.example/x"
    first = [(i, f"own words of page {chr(97 + i)}\nRead our friendly newsletter today" if i < 4 else f"own words of page {chr(97 + i)}", url, T) for i in range(10)]
    first += [(100 + i, f"text {chr(97 + i)} stands here alone\nthe footer of site b", "https://b.example/", T) for i in range(5)]
    second = [(20, "one more\nRead our friendly newsletter today", url, T + dt.timedelta(days=1))]
    third = [(20, "one more page without that line", url, T + dt.timedelta(days=2)), (0, "too late", url, T - dt.timedelta(days=1))]
    run, texts, rows, state = {}, {}, [], None
    for day, part in enumerate([first, second, third]):
        rows += part
        out, state = repeated_lines.rebuild(spark.createDataFrame(rows, PAGE), spark.createDataFrame(part, PAGE), state)
        run[day] = {r["page_id"]: r["text"] for r in out.collect()}
        texts |= run[day]
        repeated_lines.save(state, f"{tmp_path}/{day}")
        state = repeated_lines.load(spark, f"{tmp_path}/{day}")
        whole = repeated_lines.rebuilt_pages(spark.createDataFrame(rows, PAGE)).collect()
        assert len(whole) == len({r[0] for r in rows})
        assert texts == {r["page_id"]: r["text"] for r in whole}
    assert len(run[0]) == 15 and run[0][100] == "text a stands here alone" and "newsletter" in run[0][0]
    assert set(run[1]) == {0, 1, 2, 3, 20} and "newsletter" not in run[1][0]
    assert set(run[2]) == {0, 1, 2, 3, 20} and "newsletter" in run[2][0]


# --- packing


def test_packing_holds_every_token_once(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 400))) for i in range(300)] + [(1000, prose(rng, 4000)), (1001, None)]
    kinds = spark.createDataFrame([("short", 256), ("wide", 2048)], "container_kind string, capacity_tokens bigint")
    got = packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string"), kinds, shard_documents=150).toPandas()
    for kind, capacity in (("short", 256), ("wide", 2048)):
        one = got[got.container_kind == kind]
        sizes = one.groupby("doc_id").n_tokens.sum()
        assert all(sizes[i] == packing.count_tokens(t) for i, t in rows)
        filled = one.dropna(subset=["container_id"]).groupby("container_id").n_tokens.sum()
        assert filled.max() <= capacity
        assert 1 - filled.sum() / (len(filled) * capacity) < 0.12
        split = one.groupby("doc_id").piece_no.max()
        assert all((split[i] > 0) == (packing.count_tokens(t) > capacity) or packing.count_tokens(t) == capacity for i, t in rows)
    assert not got.duplicated(["container_kind", "doc_id", "piece_no"]).any()


def test_retrieval_prefers_like_documents():
    terms, times, ends = packing.counted_terms(["red apple fruit sweet", "blue ocean water deep", "red apple pie sweet", "ocean deep water fish"])
    scores = packing.Index(terms, times, np.diff(ends)).scores(0)
    assert scores[2] > scores[1] and scores[2] > scores[3]


def test_counts_are_exact():
    terms, times, ends = packing.counted_terms(["a " * 500 + "b", None, "", "b c"])
    assert ends.tolist() == [0, 2, 2, 2, 4] and sorted(times[:2]) == [1, 500]


def test_the_order_lays_a_topic_side_by_side(spark):
    """Documents of 40 topics, in no order of their own: nearly all of a topic fall into one shard or two neighbouring ones."""
    rng = random.Random(11)
    topics = [[f"topic{chr(97 + t % 26)}{chr(97 + t // 26)}{chr(97 + k)}" for k in range(6)] for t in range(100)]
    rows = [(i, " ".join(rng.choice(topics[i % 100]) if rng.random() < 0.3 else rng.choice(NAMES) for _ in range(60))) for i in range(2000)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [r["doc_id"] for r in packing.in_order(packing.written(packing.measured(documents))).select("part", "doc_id").toPandas().sort_values("part", kind="stable").to_dict("records")]
    assert sorted(order) == list(range(2000))
    near = sum(a % 100 == b % 100 for a, b in zip(order, order[1:], strict=False))
    assert near > 1500


# --- leaks


@pytest.mark.parametrize("most", [500_000, 3])
def test_leaks_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "MOST_TERMS", most)
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([3, 9, 13, 30, 60]))) for i in range(25)]
    documents = []
    for i in range(120):
        w = prose(rng, rng.randrange(0, 80)).split()
        if i % 3 == 0:
            src = items[rng.randrange(len(items))][1].split()
            n = rng.choice([12, 13, 20, len(src)])
            at = rng.randrange(max(1, len(src) - n + 1))
            w[rng.randrange(len(w) + 1) : 0] = [x.upper() + "," for x in src[at : at + n]]
        documents.append((i, " ".join(w)))

    def held(d, t):
        n = min(13, len(t))
        runs = {tuple(d[k : k + n]) for k in range(len(d) - n + 1)}
        return any(tuple(t[k : k + n]) in runs for k in range(len(t) - n + 1))

    expected = {(i, j) for i, d in documents for j, t in items if words(t) and held(words(d), words(t))}
    assert expected
    got = leaks.leaks(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == expected


def test_proximity_against_brute_force(spark):
    rng = random.Random(18)
    items = [(i, " ".join(rng.sample(NAMES, rng.choice([2, 4, 6])))) for i in range(10)]
    documents = [(i, " ".join(rng.choice([*NAMES, *["of"] * 60]) for _ in range(rng.randrange(0, 150)))) for i in range(40)]
    df = {t: sum(t in words(d) for _, d in documents) for t in NAMES}
    expected = set()
    for j, t in items:
        rarest = sorted((x for x in set(words(t)) if df[x]), key=lambda x: (df[x], x))[:3]
        for i, d in documents:
            w = words(d)
            if len(rarest) == 3 and any(set(rarest) <= set(w[k : k + leaks.NEAR]) for k in range(len(w))):
                expected.add((i, j))
    assert expected
    got = leaks.proximity(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == expected


# --- repetition


def test_shares_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        parts = [prose(rng, 10) for _ in range(6)]
        t = " ".join(parts + ([parts[0]] * rng.randrange(4) if i % 2 else []))
        rows.append((i, t, "en", "a"))
    expected = {}
    for i, t, *_ in rows:
        w, seen, hit = words(t), set(), set()
        for k in range(len(w) - 7):
            run = tuple(w[k : k + 8])
            if run in seen:
                hit |= set(range(k, k + 8))
            seen.add(run)
        expected[i] = (len(w), len(hit))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in repetition.shares(df).collect()} == expected
    found = {r["doc_id"] for r in repetition.repetitive(df).collect()}
    assert found == {i for i, (n, h) in expected.items() if n >= 40 and h * 100 >= n * 30}


def test_outliers_survive_contamination(spark):
    """A third of a group repeats itself; the estimate still comes from the others."""
    rng = random.Random(10)
    rows = []
    for i in range(600):
        base = prose(rng, 60)
        rows.append((i, base if i % 3 else " ".join([base] * 3), "en", "a"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r["doc_id"] for r in repetition.repetitive(df).collect()} == {i for i in range(600) if i % 3 == 0}


def test_the_gate_takes_part(spark):
    """Where three quarters of all documents repeat a third to a half of their words, these are the usual ones: over the share, but no outliers."""
    rng = random.Random(20)
    rows = []
    for i in range(400):
        base = prose(rng, 60).split()
        again = rng.randrange(30, 60) if i % 4 else 0
        rows.append((i, " ".join(base + base[:again]), "en", "a"))
    got = repetition.outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    over = {r["doc_id"] for r in got if r["share"] >= 0.3}
    assert len(over) > 250 and len({r["doc_id"] for r in got if r["is_outlier"]} & over) < len(over) / 10


def test_half_of_a_group_by_bins():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, repetition.P))
    d = (x * x).sum(axis=1)
    bins = np.floor(np.log2(d) * repetition.FINE).astype(int)
    rows = [(b, (bins == b).sum(), x[bins == b].sum(axis=0), np.array([(x[bins == b, i] * x[bins == b, j]).sum() for i, j in repetition.PAIRS])) for b in set(bins)]
    mean, cov, n = repetition.half(repetition.pd.DataFrame(rows, columns=["bin", "n", "x_sum", "x_square"]))
    near = x[np.argsort(d)[:500]]
    assert n == 500 and np.allclose(mean, near.mean(axis=0), atol=0.02) and np.allclose(cov, np.cov(near.T, bias=True), atol=0.02)


def test_chi_square():
    assert abs(repetition.chi_square(0.95, 4) - 9.4877) < 1e-3
    assert abs(repetition.chi_square(0.999, 4) - 18.467) < 1e-3


# --- words and sites


def test_words_alike_in_both_engines(spark):
    samples = ["Über_öl 3 naïve—x’s", "a_b c9 ٣ 漢字 Ωmega", "", "İstanbul ﬁn ½ ²"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(text.words_column(df.t)).collect()]
    assert got == [text.words(s) for s in samples]


def test_sites(spark):
    urls = ["https://WWW.Docs.A.example:8080/x?y", "http://docs.a.example", "docs.a.example/p", "//docs.a.example/x", "https://u@docs.a.example/", "", None, "  "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.site_column(df.u)).collect()] == ["docs.a.example"] * 5 + [None] * 3
