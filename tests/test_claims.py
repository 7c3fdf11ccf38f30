import pytest

from folioscope.functions import openapi, shell
from folioscope.operators import claims as C
from folioscope.operators import drift as D
from folioscope.operators import evaluation as E
from folioscope.plans.sample_api import DOC

PAGE = "page string, text string"


def claims_of(spark, text):
    return C.claims(spark.createDataFrame([("p", text)], PAGE)).collect()


# --- shell samples


def test_commands_over_lines():
    block = "a \\\n  b\nc 'd\n  e' f\n# g\nh \"i\\\" j\" \\"
    assert list(shell.commands(block)) == [("a b", 0), ("c 'd e' f", 2), ("# g", 4), ('h "i\\" j"', 5)]


@pytest.mark.parametrize(
    ("command", "expected"),
    [
        ("curl http://h/x/", ("http://h", "GET", "/x", "")),
        ("curl -X post '${URL}/x?a=1&b=2#f'", ("${URL}", "POST", "/x", "a=1&b=2")),
        ("curl $URL/", ("$URL", "GET", "/", "")),
        ("curl -XPOST HOST/x", ("HOST", "GET", "/x", "")),
        ("curl --compressed HOST/x -o file", ("HOST", "GET", "/x", "")),
        ("curl -d '{}' HOST/x", ("HOST", "GET", "/x", "")),
        ("curl 'open", None),
        ("curl ftp-less", None),
        ("wget HOST/x", None),
        ("curl -X", None),
    ],
)
def test_curl(command, expected):
    r = shell.curl(command)
    assert (None if r is None else (r["base"], r["method"], r["path"], r["query"])) == expected


@pytest.mark.parametrize(
    ("body", "keys"),
    [('{"b": 1, "a": {"c": 2}}', ["b", "a"]), ('[{"a": 1}, {"b": 2, "a": 3}, 4]', ["a", "b"]), ('{"a": ..., "b": {"c": 1}, "d": "x:y" }', ["a", "b", "d"]), ("plain", []), ("7", []), ("{a: 1}", [])],
)
def test_body_keys(body, keys):
    assert shell.body_keys(body) == keys


def test_claims_of_a_page(spark):
    text = "---\nt: 1\n---\ntext\n\n```bash\ncurl -X PATCH 'HOST/a/b?x=1' \\\n  -H 'Authorization: k' \\\n  --data-binary '{\n  \"m\": 1, \"n\": 2 }'\n```\n\n```python\ncurl HOST/no\n```\n\nSee `GET /a/{id}/` and\n<RouteHighlighter method=\"POST\" path=\"/r\" />\n\n| `order` | string | one of `asc`, `orders`, [`x`](y), `a.b`, `12` |\n"
    got = {(r["kind"], r["line"], r["method"], r["path"], r["name"], r["value"], r["origin"], r["has_auth"]) for r in claims_of(spark, text)}
    assert got == {
        ("endpoint", 7, "PATCH", "/a/b", "", "", "curl", True), ("auth", 7, "PATCH", "/a/b", "", "", "curl", True),
        ("query_param", 7, "PATCH", "/a/b", "x", "", "curl", None), ("body_param", 7, "PATCH", "/a/b", "m", "", "curl", None), ("body_param", 7, "PATCH", "/a/b", "n", "", "curl", None),
        ("endpoint", 17, "GET", "/a/{id}", "", "", "inline", None), ("endpoint", 18, "POST", "/r", "", "", "route_marker", None),
        ("enum_value", 20, "", "", "", "asc", "curl", None),
    }
    assert claims_of(spark, None) == [] and claims_of(spark, "") == []


# --- the index


def test_operations_and_enums():
    d = openapi.Document(DOC)
    ops = {(r[1], r[0]): r for r in d.operations()}
    change = ops[("PATCH", "/{service}/{setting}")]
    assert change[9] == ["maxImport", "onQuery", "order", "useVector"] and change[11] == ["maxImport"]
    assert change[5] and not ops[("DELETE", "/{service}/{setting}")][5] and ops[("DELETE", "/{service}/{setting}")][4]
    assert ops[("POST", "/tasks")][9] == ["maxImport", "onQuery", "order", "useVector"]
    assert d.enums() == {"order": {"asc", "desc"}} and d.named_enums() == {"Order": {"asc", "desc"}}
    assert d.resolved({"$ref": "#/components/schemas/Loop"}) == {} and d.resolved({"$ref": "#/no"}) == {} and d.resolved({"$ref": "x.yml"}) == {}
    assert d.server_bases() == ["http://localhost:7700", "localhost:7700"]


# --- drift

CLAIM = C.SCHEMA


def claim(kind, line, method="", path="", name="", base="", origin="curl", value="", field="", auth=None):
    return (kind, "p", line, method, path, name, base, origin, value, field, "", auth)


def test_findings(spark):
    rows = [
        claim("endpoint", 1, "GET", "/s/limit", auth=True), claim("endpoint", 2, "PUT", "/s/limit"), claim("endpoint", 3, "POST", "/task"), claim("endpoint", 4, "POST", "/q/w/e"),
        claim("endpoint", 5, "POST", "/taskz", origin="inline"), claim("endpoint", 6, "POST", "/q/w/e", origin="inline"), claim("endpoint", 7, "DELETE", "/s/limit"), claim("endpoint", 7, "DELETE", "/s/limit"),
        claim("auth", 8, "GET", "/s/limit", auth=False), claim("auth", 9, "GET", "/s/health", auth=False),
        claim("body_param", 10, "PATCH", "/s/x", "onQuery"), claim("body_param", 11, "PATCH", "/s/x", "onQuerry"), claim("body_param", 12, "PATCH", "/s/x", "zzz"), claim("body_param", 13, "DELETE", "/s/x", "any"),
        claim("query_param", 14, "GET", "/s/x", "offset"), claim("enum_value", 15, field="order", value="asc"), claim("enum_value", 16, field="order", value="descc"), claim("enum_value", 17, field="order", value="up"), claim("enum_value", 18, field="free", value="up"),
    ]
    operations, enums = openapi.tables(spark, DOC)
    df = spark.createDataFrame(rows, CLAIM)
    got = {(r["detector"], r["line"], r["confidence"], r["suggestion"], r["needs_review"]) for r in D.findings(df, operations, enums).collect()}
    assert got == {
        ("unknown_endpoint", 2, 0.9, "DELETE /s/limit", False), ("unknown_endpoint", 3, 0.75, "POST /tasks", False), ("unknown_endpoint", 4, 0.4, "", True),
        ("unknown_endpoint", 5, 0.45, "POST /tasks", True), ("unknown_endpoint", 6, 0.35, "", True), ("deprecated_endpoint", 7, 0.95, "", False), ("missing_auth", 8, 0.65, "", True),
        ("unknown_parameter", 11, 0.85, "onQuery", False), ("unknown_parameter", 12, 0.7, "", False), ("unknown_parameter", 14, 0.7, "", False),
        ("unknown_enum_value", 16, 0.8, "desc", False), ("unknown_enum_value", 17, 0.6, "", True),
    }
    assert [r["line"] for r in D.abstentions(D.matched(df, operations)).collect()] == [13]
    assert D.findings(df.limit(0), operations, enums).collect() == []


def test_scope_and_bases(spark):
    rows = [claim("endpoint", i, "GET", "/s/x", base="URL") for i in range(3)] + [claim("endpoint", 9, "GET", "/none/at/all", base="https://other"), claim("endpoint", 10, "GET", "/none/at/all")]
    df = spark.createDataFrame(rows, CLAIM)
    assert D.base_set(df, ["http://h"]) == ["", "$URL", "${URL}", "URL", "http://h"]
    assert D.base_set(df.filter("line > 1"), []) == [""]
    operations, enums = openapi.tables(spark, DOC)
    assert [r["line"] for r in D.findings(df, operations, enums, ["", "URL"]).collect()] == [10]


def test_verdicts(spark):
    cols = "detector string, page string, line int, message string, confidence double, evidence string, suggestion string, needs_review boolean, base string, origin string, snippet string"
    rows = [("d", "p", i, "m", 0.4, e, "", review, base, "curl", snip) for i, (e, review, base, snip) in enumerate([("GET /x", True, "https://github.com/a", ""), ("GET /x.json", True, "", ""), ("GET /x", True, "", "curl pypi.org"), ("GET /x", True, "", ""), ("GET /x.json", False, "", "")])]
    df = spark.createDataFrame(rows, cols)
    judged = df.withColumn("verdict", D.heuristic_verdict())
    assert [r["line"] for r in D.applied(judged).orderBy("line").collect()] == [3, 4]
    assert tuple(D.verdict_counts(judged).first()) == (3, 0, 3, 2)
    pages = spark.createDataFrame([("p", "\n".join(map(str, range(40))))], PAGE)
    around = D.context(df, pages)
    assert around.filter("line = 3").first()["context"].split("\n") == [str(i) for i in range(15)]
    key = around.filter("line = 3").select(D.verdict_key(D.F.lit("m"))).first()[0]
    verdicts = spark.createDataFrame([(key, True, 0.8, "seen")], "key string, actionable boolean, confidence double, reason string")
    kept = {r["line"]: r for r in D.applied(D.recorded(around, verdicts, "m")).collect()}
    assert kept[3]["confidence"] == 0.8 and not kept[3]["needs_review"] and "seen" in kept[3]["message"]
    assert {r["severity"] for r in D.gated(df).collect()} == {"low"}
    assert {r["level"] for r in D.unified(df).collect()} == {"suggestion"}


# --- evaluation


def test_rates_sweep_and_floors(spark):
    produced = spark.createDataFrame([("a", "d", 0.9), ("a", "e", 0.4), ("a", "e", 0.3), ("b", "d", 0.6)], "page string, detector string, confidence double")
    expected = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "d"), ("c", "d")], "page string, detector string")
    met = E.outcomes(produced, expected, ["page", "detector"], ["confidence"])
    assert tuple(E.scores(met).first()) == (2, 1, 1, 0.6667, 0.6667, 0.6667)
    sweep = {r["threshold"]: (r["reported"], r["tp"], r["fp"], r["fn"]) for r in E.sweep(met).collect()}
    assert sweep[0.0] == (3, 2, 1, 1) and sweep[0.6] == (2, 2, 0, 1) and sweep[0.9] == (1, 1, 0, 2)
    assert E.scores(met.limit(0)).first()[3:] == (0.0, 0.0, 0.0)
    floors = spark.createDataFrame([("a", "g", "precision", 0.5), ("a", "g", "recall", 0.5), ("a", "m", "recall", 0.1)], "arm string, metric_set string, metric string, floor double")
    measured = spark.createDataFrame([("a", "g", "precision", 0.5), ("a", "g", "recall", 0.4)], "arm string, metric_set string, metric string, value double")
    assert {(r["metric_set"], r["metric"]) for r in E.below_floors(measured, floors).collect()} == {("g", "recall"), ("m", "recall")}


def test_mutations_are_found_again(spark):
    body = "```bash\ncurl -X PATCH 'HOST/s/%s' -H 'Authorization: k' --data-binary '{ \"onQuery\": 1 }'\n```\n"
    pages = spark.createDataFrame([(f"p{i}", body % f"n{i}") for i in range(40)], PAGE)
    made = E.mutations(C.curl_claims(pages), pages, per_kind=4).collect()
    assert len({r["page"] for r in made}) == len(made) and {r["name"] for r in made} >= {"rename_body_param", "change_http_verb", "strip_auth_header"}
    operations, enums = openapi.tables(spark, DOC)
    changed = spark.createDataFrame([(r["page"], r["text"]) for r in made], PAGE)
    found = E.beyond_baseline(D.findings(C.claims(changed), operations, enums), D.findings(C.claims(pages), operations, enums), ["page", "detector", "evidence"])
    hit = {(r["page"], r["detector"]) for r in found.collect()}
    for r in made:
        assert (r["page"], r["detector"]) in hit


def test_samples_compositions_and_defaults_of_the_index():
    doc = {
        "security": [{"key": []}],
        "paths": {
            "/a/{id}": {
                "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}, {"name": "sort", "in": "query", "schema": {"$ref": "#/components/schemas/Order"}}],
                "get": {"responses": {"200": {}, "404": {}}},
                "put": {
                    "operationId": "put_a", "security": [{"key": ["a.write", "a.read"]}, {}],
                    "requestBody": {"content": {"application/json": {"schema": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"anyOf": [{"properties": {"x": {}}, "required": ["x"]}]}]}}}},
                },
            }
        },
        "components": {
            "schemas": {
                "Order": {"oneOf": [{"enum": ["asc"]}, {"enum": ["desc", None]}]},
                "Base": {"required": ["name"], "properties": {"name": {}, "parts": {"items": {"$ref": "#/components/schemas/Base"}}, "example": {"enum": ["real"]}}, "example": {"properties": {"no": {"enum": ["sample"]}}}},
            }
        },
    }
    d = openapi.Document(doc)
    assert d.enums() == {"sort": {"asc", "desc"}, "example": {"real"}} and d.named_enums() == {"Order": {"asc", "desc"}}
    assert [(*r[:3], *r[5:]) for r in d.operations()] == [
        ("/a/{id}", "GET", "get:/a/{id}", True, [], ["id"], ["sort"], [], [], [], ["200", "404"]),
        ("/a/{id}", "PUT", "put_a", True, ["a.read", "a.write"], ["id"], ["sort"], ["example", "name", "parts", "x"], [], ["name"], []),
    ]
