import pytest

from folioscope.functions import fix_data
from folioscope.functions import masking as M
from folioscope.functions.rules import preflight, rules, vocabulary_lines
from folioscope.operators import metrics, remediation, structure, style

PAGE = "page string, text string"

# rule: texts that must fire, texts that must not; all written for this test
CASES = {
    "AcronymPlural": (["Collect all the SDK's first."], ["Collect all the SDKs first."]),
    "Acronyms": (["Ask the QRS for a shard."], ["Ask the quick routing service (QRS) for a shard.", "Use JSON or YAML.", "the abc"]),
    "ActionVerbs": (["Navigate to the panel.", "Then log out now."], ["Go to the panel."]),
    "AllowsYouTo": (["The tool allows you to sort."], ["The tool lets you sort."]),
    "AndOr": (["Sort and/or filter."], ["Sort, filter, or both."]),
    "ApiKeyCase": (["Store the Api Key safely."], ["Store the API key safely."]),
    "DataTypes": (["| a | b |\n| --- | --- |\n| `x` | String |"], ["A String of pearls.", "| a | b |\n| --- | --- |\n| `x` | `string` |"]),
    "DirectionalLanguage": (["See the table below."], ["See the following table."]),
    "Editorializing": (["A powerful sorter."], ["A sorter."]),
    "EmDash": (["Sort it — then stop.", "Sort it -- then stop."], ["Sort it: then stop."]),
    "EndpointInCode": (["Call /shards/main/sort now."], ["Call `/shards/main/sort` now."]),
    "Exclamation": (["Done! Go on."], ["Done. Go on."]),
    "FileTypes": (["Upload a .csv file today."], ["Upload a CSV file today."]),
    "Filler": (["You can easily sort."], ["You can sort."]),
    "FirstPerson": (["We recommend sorting."], ["Sort first."]),
    "ForwardSlash": (["Turn left/right here."], ["Turn left or right here.", "`left/right`"]),
    "GenderNeutral": (["Each user sorts his/her shard."], ["Each user sorts their shard."]),
    "HTTPMethodCase": (["Send a get request first."], ["Send a GET request first."]),
    "HeadingCaseH1": (["# Sort your shard"], ["# Sort Your Shard", "# Sort a Shard with the JSON API"]),
    "HeadingCaseH2Plus": (["## Sort Your Shard"], ["## Sort your shard", "### Use the JSON API with Node.js"]),
    "HeadingPunctuation": (["## Sort shards."], ["## Sort shards", "## Sort shards?"]),
    "InclusiveLanguage": (["Put it on the whitelist."], ["Put it on the allowlist."]),
    "LatinAbbreviations": (["Sort shards, e.g. the first."], ["Sort shards, for example the first."]),
    "LegacyHost": (["Send it to old.host.example/x."], ["Send it to new.host.example/x."]),
    "LinkText": (["For sorting, [click here](/s)."], ["See [sorting](/s)."]),
    "Measurements": (["It takes 20ms.", "It is 30 % full."], ["It takes 20 ms.", "It is 30% full."]),
    "NoteThat": (["Note that shards move."], ["Shards move."]),
    "Placeholders": (["Set YOUR_NAME here.", "Pass <shard_id> along.", "Use {shard-id} there."], ["Set `NAME` here."]),
    "Please": (["Please sort."], ["A pleasing sort."]),
    "ProductTerms": (["Copy the Client Key."], ["Copy the client key."]),
    "RequirementKeywords": (["You need to sort."], ["You must sort."]),
    "ScreenComponents": (["Pick from the drop-down menu."], ["Pick from the dropdown."]),
    "Semicolon": (["Sort; then stop."], ["Sort. Then stop."]),
    "SentenceLength": (["Sort " + "one more shard and " * 12 + "stop."], ["Sort one shard. " * 12]),
    "StatusCodeName": (["It returns 404 not found."], ["It returns 404 Not Found."]),
    "Terminology": (["The Javascript client sorts."], ["The JavaScript client sorts."]),
    "TimelessDocs": (["It currently sorts."], ["It sorts."]),
    "UIActions": (["Click on Sort."], ["Click Sort."]),
    "VagueWords": (["Sort via the panel."], ["Sort through the panel."]),
    "Wordiness": (["In order to sort, wait."], ["To sort, wait."]),
}
PACKAGE = rules(legacy_hosts=["old.host.example"])


def test_every_rule_has_cases():
    assert {r.name for r in PACKAGE} == set(CASES)
    assert len(PACKAGE) == 40


def test_rules_fire_and_stay_silent(spark):
    rows = [(f"{rule}/{kind}/{i}.md", "---\ntitle: x\n---\n" + t) for rule, sides in CASES.items() for kind, texts in zip(("bad", "good"), sides, strict=True) for i, t in enumerate(texts)]
    got = {(r["page"].split("/")[0], r["page"]) for r in style.alerts(spark.createDataFrame(rows, PAGE), PACKAGE).collect() if r["rule"] == r["page"].split("/")[0]}
    for page, _ in rows:
        rule, kind, _ = page.split("/")
        assert ((rule, page) in got) == (kind == "bad"), page


def test_alerts_carry_line_and_replacement(spark):
    df = spark.createDataFrame([("d/a.md", "---\ntitle: x\n---\n\n```\nvia\n```\ngo via it"), ("b.md", None)], PAGE)
    rows = [(r["area"], r["rule"], r["line"], r["found"], r["replacement"]) for r in style.alerts(df, PACKAGE).collect()]
    assert rows == [("d", "VagueWords", 8, "via", "through")]


def test_preflight():
    assert preflight({"name": "a", "extends": "existence", "level": "error", "scope": ["text"], "tokens": ["x"]}) == []
    assert len(preflight({"name": "a", "extends": "no", "level": "no", "scope": "heading.h2|heading.h3", "tokens": [True], "swap": {"a": True}})) == 5
    assert vocabulary_lines(["# c", "", "b", "A", "b"]) == ["A", "b"]


def test_counts_rates_and_gates(spark):
    df = spark.createDataFrame([("a", "r", "error", 1, "x", "z"), ("a", "r", "error", 2, "x", "z"), ("b", "s", "suggestion", 1, "y", "z")], "page string, rule string, severity string, line int, found string, area string")
    n = {(r["rule"], r["severity"], r["area"]): (r["n"], r["pages"]) for r in metrics.counts(df).collect()}
    assert n[("r", None, None)] == (2, 1) and n[(None, None, None)] == (3, 2) and n[(None, "error", None)] == (2, 1)
    words = spark.createDataFrame([("a", 1500)], "page string, words int")
    assert metrics.per_thousand(df, words).first()["per_1k"] == 2.0
    assert metrics.per_thousand(df, words.limit(0)).first()["per_1k"] == 0.0
    assert tuple(metrics.gate(df, "warning").first()) == (2, 3)
    assert {r["severity"]: r["n"] for r in metrics.by_severity(df).collect()} == {"error": 2, "warning": 0, "suggestion": 1}
    c = {r["rule"]: (r["before"], r["after"], r["delta"]) for r in metrics.compared(df, df.filter("line = 1"), "rule").collect()}
    assert c == {"r": (2, 1, -1), "s": (1, 1, 0)}
    assert [r["command"] for r in metrics.annotations(df, 1).collect() if r["severity"] == "error"] == ["::error file=a,line=1::r: x"]
    assert "| a\\|b |" in metrics.markdown_table(spark.createDataFrame([("a|b",)], "x string"))
    assert '"ruleIndex": 0' in metrics.sarif(df, "t", ["r", "s"])


# --- masking


def test_segments_make_up_the_text(spark):
    texts = ["---\na: b\n---\nx\n````py\n```\n````\ny `c` z\n~~~\nopen", "no code", "", "```\na\n```", "  ```js\n  x\n  ```\nafter <b>t</b> [l](u \"t\") https://x.example/a)"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], PAGE)
    for r in df.select("text", M.joined(M.segments(df.text)), M.joined(M.all_segments(df.text)), M.blanked(df.text)).collect():
        assert r[0] == r[1] == r[2] and r[3].count("\n") == r[0].count("\n")
    assert df.select(M.prose(df.text)).collect()[4][0] == "\nafter t [l )"


def test_prose_words_and_titles(spark):
    df = spark.createDataFrame([("a", "---\ntitle: 'Über uns'\n---\n# It's *one* ##\nüber öl abc-def\n```\nno\n```")], PAGE)
    assert df.select(M.word_count(df.text), M.front_title(df.text), M.first_heading(df.text), M.body_offset(df.text)).first()[:] == (5, "Über uns", "It's *one*", 3)


def test_indented_code_and_spans(spark):
    text = "para\n\n    code\n\n    more\n\n- item\n\n    no code\n<Card>\n\n    no\n\ntext\n    no, goes on"
    lines = M.page_lines(spark.createDataFrame([("a", text)], PAGE))
    assert sorted(r["line"] for r in M.indented_code(lines).collect()) == [3, 4, 5]
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 12, 14), ("a", 1, 2), ("b", 0, 1)], "page string, start int, end int")
    assert sorted(tuple(r) for r in M.merged_spans(spans).collect()) == [("a", 0, 9), ("a", 12, 14), ("b", 0, 1)]


def test_in_quotes(spark):
    df = spark.createDataFrame([('a "b',), ('"a" b',), ('"a\nb',)], "t string")
    assert [r[0] for r in df.select(M.in_quotes(df.t)).collect()] == [True, False, False]


# --- remediation


def fixed(spark, text):
    return remediation.fixed(spark.createDataFrame([("a", text)], PAGE)).first()


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("Click on it. CLICK ON it. click on it.", "Click it. CLICK it. click it."),
        ("In order to sort, utilize Github.", "To sort, use GitHub."),
        ("`click on` and <b title=\"click on\"> and [x](/via)", "`click on` and <b title=\"click on\"> and [x](/via)"),
        ("```\nvia\n```\nvia", "```\nvia\n```\nthrough"),
        ("Please sort. Please note that it moves.", "Sort. It moves."),
        ('It says "Please wait" first. Please wait.', 'It says "Please wait" first. Wait.'),
        ("## Sort it:\ntext", "## Sort it\ntext"),
        ("# Response: `201 Created`", "# Response: `201 Created`"),
        ("The example below and the list above, e.g. 5GB or 6 %, etc.", "The following example and the preceding list, for example, 5 GB or 6%, and so on."),
        ("Keep in mind that it sorts", "It sorts"),
        ("", ""),
    ],
)
def test_remediation(spark, before, after):
    assert fixed(spark, before)["text"] == after


def test_remediation_never_touches_code(spark):
    import random

    rng = random.Random(3)
    parts = ["via the Api Key\n", "```\nclick on Url via\n```\n", "`via` ", "<via in=\"order to\">", "[x](/via) ", "---\n", "~~~\nvia\n~~~\n", "In order to\n", '"Please go" ', "# Via.\n", "\x01"]
    df = spark.createDataFrame([(str(i), "".join(rng.choice(parts) for _ in range(12))) for i in range(80)], PAGE)
    done = remediation.fixed(df)
    assert done.count() == 80 and remediation.altered_segments(done).count() == 0
    by_rule = {r["rule"]: r["fixes"] for r in remediation.fixes_by_rule(done).collect()}
    assert set(by_rule) <= set(fix_data.FIXES) | set(fix_data.STEMS) | {"HeadingPunctuation"} and by_rule["VagueWords"] > 0


# --- structure


def found(spark, text, policy=None, page="p.md"):
    got = structure.issues(spark.createDataFrame([(page, text)], PAGE), policy).collect()
    return sorted((r["check_id"], r["line"]) for r in got)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# T\n\nx\n### Jump\n\ny", [("heading_skip", 4)]),
        ("# T\nx\n# U\ny\n# V\nz", [("multiple_h1", 3)]),
        ("x", [("missing_title", 1)]),
        ("# T\nx\n## A\ny\n## a\nz", [("duplicate_heading", 5)]),
        ("# T\n\n## A\n```bash\nx\n```\n", [("empty_heading", 1), ("empty_heading", 3)]),
        ("---\ntitle: x\n---\n# T\nx\n```\na\n```\n```Bash\nb\n```\n```perl\nc\n```\n```bash\nd\n```", [("fence_case", 9), ("fence_no_language", 6), ("fence_unapproved", 12)]),
        ("# T\n**Info**: a\n\n**Note** b\n\nx\n\n**Tip**: c\n**Bold** run-in", [("callout_density", 1), ("callout_format", 4), ("callout_retired", 2), ("callout_stacked", 4)]),
        ("# T\nx\n\n| Key | Required |\n| --- | --- |\n| a | Yes |\n| b | Optional |\n| | No |\n\n| a | b | c | d | e | f |\n|---|---|---|---|---|---|\n", [("required_value", 7), ("table_column_name", 4), ("table_empty_cell", 8), ("table_width", 10)]),
        ("# T\nUse A_B.\n\n```bash\nx A_B C_D\nC_D\n```", [("placeholder_unexplained", 5)]),
        ("", [("missing_title", 1)]),
    ],
)
def test_structure(spark, text, expected):
    assert found(spark, text) == expected


def test_second_table_is_checked_too(spark):
    table = "| Key |\n| --- |\n| x |\n"
    assert found(spark, "# T\nx\n\n" + table + "\n" + table) == [("table_column_name", 4), ("table_column_name", 8)]


def test_titles_across_pages(spark):
    df = spark.createDataFrame([("a", "# Same\nx"), ("b", "# same \ny"), ("c", "# Other\nz"), ("s/d", "# Same\nx"), ("n", None)], PAGE)
    policy = structure.Policy(exclude=("s/**", "n"))
    got = {r["page"] for r in structure.issues(df, policy).filter("check_id = 'title_not_unique'").collect()}
    assert got == {"a", "b"}


def test_policy_is_checked():
    with pytest.raises(ValueError):
        structure.Policy(h1_source="nowhere")
    with pytest.raises(ValueError):
        structure.Policy(required_column_values=(True,))


def test_literals_never_rule_out_a_match():
    """Every pattern's matches hold one of the literals taken from it."""
    from folioscope.functions import literals as L
    from folioscope.functions import rule_data as D

    patterns = [p for _, _, _, t in [*D.EXISTENCE.values(), *D.SUBSTITUTION.values()] for p in t] + [p for v in fix_data.FIXES.values() for p, _, _ in v]
    import re

    seen = 0
    texts = [t for sides in CASES.values() for t in sides[0]] + ["In the event that e.g. WHITELISTS of GitHUB, Oauth and man-hours", "left hand navigation, drop down menus, api KEY, Https url"]
    for p in patterns:
        keys = [L.literal(a) for a in L.alternatives(p)]
        if None in keys:
            continue
        for t in texts:
            for m in re.finditer("(?i)" + p.removeprefix("(?i)").replace("\\x{2014}", "—"), t):
                seen += 1
                assert any(k in m[0].lower() for k in keys), (p, m[0])
    assert seen > 40
    assert L.literal(r"a|b") is None and L.literal(r"\bab?c") is None and L.literal(r"colou?r") == "colo" and L.literal("(?i)Xy [z] q") == "xy "
