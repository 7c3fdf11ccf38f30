"""Every operator over nulls, empty and very long texts, repeated rows, ties, empty tables and clashing further columns."""

import datetime as dt

import pytest

from folioscope.llm import boilerplate, leaks, markup, near_duplicates, packing, repeated_lines, repetition, residue

T = dt.datetime(2025, 1, 1)
PAGE = "page_id bigint, text string, url string, loaded_at timestamp, path string, lines string, site string, key string, words string, runs string, a bigint, _r string, markup string, line_no int"
DOCUMENT = "doc_id bigint, text string, lang string, source string, words string, term string, t string, pos int, shard int, grp string, e string, x0 double, n_tokens string, _r string"
LONG = "Each cluster sorts its oldest shard before the next restart begins again. " * 6000
WIDE = "word " * 60_000


def page(i, text, url="https://a.example/x", at=T):
    return (i, text, url, at, "p", "l", "s", "k", "w", "r", 1, "_", "m", 0)


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, "w", "t", "t", 0, 0, "g", "e", 0.0, "n", "_")


PAGES = [page(None, "a b c d e"), page(1, None), page(2, ""), page(3, "  \n\r\n"), page(4, LONG), page(5, WIDE, None), page(6, LONG), page(6, LONG), page(6, LONG, at=None), page(7, "x", ""), page(8, "```\nopen"), page(9, "{{ [[ '' ** <p <!-- \\begin{verbatim} $$ \\[")]
DOCUMENTS = [document(None, "a"), document(1, None), document(2, ""), document(3, " \n "), document(4, LONG, None, None), document(5, WIDE), document(6, "same words " * 30), document(7, "same words " * 30), document(8, "short")]


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(1, "Oldest shard before the next restart begins again; each cluster sorts its oldest"), (2, None), (3, ""), (4, "same words"), (4, "same words"), (None, "x")], "item_id bigint, text string")
    kinds = spark.createDataFrame([("a", 64), ("a", 32), ("b", 0), ("c", None), (None, 5)], "container_kind string, capacity_tokens bigint")
    return {
        "pages": spark.createDataFrame(PAGES, PAGE),
        "no_pages": spark.createDataFrame([], PAGE),
        "documents": spark.createDataFrame(DOCUMENTS, DOCUMENT),
        "no_documents": spark.createDataFrame([], DOCUMENT),
        "items": items,
        "no_items": items.limit(0),
        "kinds": kinds,
        "no_kinds": kinds.limit(0),
    }


OVER_PAGES = [markup.notations, markup.clean_text, markup.tag_paths, markup.path_ratios, boilerplate.surroundings, boilerplate.main_content, residue.residue_pages, residue.residue_report, near_duplicates.pairs, near_duplicates.groups, repeated_lines.repeated_lines, repeated_lines.rebuilt_pages]


@pytest.mark.parametrize("operator", OVER_PAGES, ids=lambda f: f.__name__)
def test_pages(tables, operator):
    rows = operator(tables["pages"]).collect()
    assert len(rows) == len(set(rows))
    assert all(r["page_id"] is not None for r in rows if "page_id" in r)


@pytest.mark.parametrize("operator", OVER_PAGES, ids=lambda f: f.__name__)
def test_no_pages(tables, operator):
    assert operator(tables["no_pages"]).collect() == []


@pytest.mark.parametrize("operator", [repetition.outliers, repetition.repetitive, repetition.shares], ids=lambda f: f.__name__)
def test_documents(tables, operator):
    assert all(r["doc_id"] is not None for r in operator(tables["documents"]).collect())
    assert operator(tables["no_documents"]).collect() == []


def test_shares_of_edges(tables):
    got = {r["doc_id"]: (r["n_words"], r["share"]) for r in repetition.shares(tables["documents"]).collect()}
    assert got[1] == got[2] == got[3] == (0, 0.0)
    assert got[5][0] == 60_000 and got[5][1] > 0.99
    assert got[8] == (1, 0.0)
    # no run begins before the first of its kind, so its own words count once
    assert got[6] == got[7] and got[6][0] == 60 and 0.8 < got[6][1] <= 1


@pytest.mark.parametrize("operator", [leaks.leaks, leaks.leak_report, leaks.proximity], ids=lambda f: f.__name__)
def test_leaks(tables, operator):
    operator(tables["documents"], tables["items"]).collect()
    assert operator(tables["no_documents"], tables["items"]).collect() == []
    assert operator(tables["documents"], tables["no_items"]).collect() == []


def test_leaked_edges(tables):
    got = {tuple(r) for r in leaks.leaks(tables["documents"], tables["items"]).collect()}
    assert got == {(4, 1), (6, 4), (7, 4)}


def test_packing(tables):
    rows = packing.packed(tables["documents"], tables["kinds"]).collect()
    assert {r["container_kind"] for r in rows} == {"a"}
    assert {r["doc_id"] for r in rows} == set(range(1, 9))
    assert all((r["container_id"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert packing.packed(tables["no_documents"], tables["kinds"]).collect() == []
    assert packing.packed(tables["documents"], tables["no_kinds"]).collect() == []


def test_near_duplicates_of_edges(tables):
    # of three deliveries of page 6 one counts, and page 4 is its copy
    assert [tuple(r) for r in near_duplicates.pairs(tables["pages"]).collect()] == [(4, 6)]
    groups = {r["page_id"]: r["group_id"] for r in near_duplicates.groups(tables["pages"]).collect()}
    assert groups == {4: 4, 5: 5, 6: 4}


def test_clean_text_of_edges(tables):
    got = {r["page_id"]: r["text"] for r in markup.clean_text(tables["pages"]).collect()}
    assert set(got) == set(range(1, 10))
    assert got[1] == got[2] == got[3] == ""
    assert got[8] == "```\nopen\n```"
