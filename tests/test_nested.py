import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.operators import nested as N
from wavemill.operators.nested import metadata_children, metadata_libraries, metadata_projects, shred

KEYS = st.text(max_size=4)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(KEYS, x, max_size=4), max_leaves=12)


def parse(text):
    return N.parse(text, N.decoder())


def plain(v):
    """A value as the parser has it: numbers as text."""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, str)) else N.Number(v)


@given(VALUES, st.sampled_from([None, 1]))
@settings(max_examples=300, deadline=None)
def test_both_parsers_and_back(v, indent):
    text = json.dumps(v, indent=indent)
    assert parse(text) == N._parse_deep(text) == plain(v)


def test_what_is_no_json():
    for text in ("", " ", "{", "[1,]", '{"a":1,}', '{"a" 1}', "nul", "NaN", "-Infinity", "[1] 2", "01", '"\t"', '{"a":1', "[1 2]", "{1:2}", '"\\x"', "\ufeff1", "]", "[}", '{"a"}', "{,}"):
        for read in (parse, N._parse_deep):
            with pytest.raises(ValueError):
                read(text)
    assert parse("1.50") == "1.50" and parse('{"a": 1, "b": 2, "a": 3}') == {"a": "3", "b": "2"}
    n = 0
    for c in N.cells(parse("[" * 50_000 + "]" * 50_000), N._steps((), [("[]",)])):
        n += 1
    assert n == 1


@given(VALUES)
@settings(max_examples=200, deadline=None)
def test_every_scalar_has_one_cell(v):
    got = list(N.cells(plain(v), N._steps((), None)))
    assert len({c[:3] for c in got}) == len(got)

    def scalars(x):
        if isinstance(x, dict):
            return [y for z in x.values() for y in scalars(z)]
        return [y for z in x for y in scalars(z)] if isinstance(x, list) else [x]

    told = [str(x).lower() if isinstance(x, bool) else x if x is None or isinstance(x, str) else str(x) for x in scalars(v)]
    key = lambda x: (x is None, x or "")
    assert sorted((c[4] for c in got if c[3] not in ("object", "array")), key=key) == sorted(told, key=key)


def test_tables_of_any_nesting(spark):
    """Repeated ancestors are found in the data, and a lone element counts where it is told so."""
    texts = ['{"a": {"b": [{"c": [1, 2], "d.e": "x"}, {"d.e": "y", "f": {"g": true}}]}, "h": 1.50}', '{"a": {"b": {"c": 7}}}', "no", '[["p"], ["q", "r"]]']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    t = N.flat_tables(df, "id", "t", lists=[("a", "b"), ("a", "b", "[]", "c")])
    rows = lambda name, *c: sorted(((r.id, r.parent, r.ordinals, *(r[x] for x in c)) for r in t[name].collect()), key=repr)
    assert set(t) == {"", "a.b[]", "a.b[].c[]", "[]", "[][]"}
    assert rows("", "h") == [(0, None, [], "1.50"), (1, None, [], None), (3, None, [], None)]
    assert rows("a.b[]", "d\\.e", "f.g") == [(0, [], [0], "x", None), (0, [], [1], "y", "true"), (1, [], [0], None, None)]
    assert rows("a.b[].c[]", "value") == [(0, [0], [0, 0], "1"), (0, [0], [0, 1], "2"), (1, [0], [0, 0], "7")]
    assert rows("[][]", "value") == [(3, [0], [0, 0], "p"), (3, [1], [1, 0], "q"), (3, [1], [1, 1], "r")]
    with pytest.raises(ValueError):
        N.found_tables(shred(df, "id", "t"), most=1)
    assert N.flat_tables(df.limit(0), "id", "t") == {}


def children(spark, *texts):
    rows = [(i, f"p{i}", t, None, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id long, source_path string, raw_json string, ingested_at timestamp, value string")
    return sorted(tuple(r) for r in metadata_children(df.union(df)).collect())


def test_shapes_of_children(spark):
    got = children(
        spark,
        '{"application": {"authors": [{"name": " A "}, null, "B", {"full_name": "C"}, 7, "  "], "tags": "one", "holoscan_sdk": {"tested_versions": [3.10, {"version": "1.2"}]}, "dependencies": {"libraries": [{"authors": ["no"]}]}}}',
        '[{"app": {"tags": ["no"]}}, {"operator": {"tags": {"name": "t"}, "authors": []}}, 5]',
        '{"package": {"authors": null, "holoscan_sdk": {"tested_versions": {"version": 2}}, "tags": [["deep"]]}}',
        '{"package": ', None, "",
    )
    assert got == [
        (0, 0, "author", 0, "A"), (0, 0, "author", 2, "B"), (0, 0, "author", 4, "7"), (0, 0, "tag", 0, "one"), (0, 0, "tested_version", 0, "3.10"), (0, 0, "tested_version", 1, "1.2"),
        (1, 1, "tag", 0, "t"), (2, 0, "tested_version", 0, "2"),
    ]


def test_projects_and_empty(spark):
    df = spark.createDataFrame([(1, '{"tutorial": {"name": "n", "version": 1.0, "tags": ["a", null], "authors": "x"}}', None), (None, "{}", None)], "record_id long, raw_json string, ingested_at timestamp")
    (r,) = metadata_projects(df).collect()
    assert (r.record_id, r.content, r["name"], r.version, r.n_authors, r.n_tags) == (1, "tutorial", "n", "1.0", 1, 2)
    assert metadata_children(df.limit(0)).count() == 0
    assert shred(df, "record_id", "raw_json").where("kind = 'array'").count() == 1
    lib = spark.createDataFrame([(1, '{"operator": {"dependencies": {"libraries": [{"name": " a ", "version": 1.20}, "b", null]}}}', None)], df.schema)
    assert sorted(tuple(r) for r in metadata_libraries(lib).collect()) == [(1, 0, "operator", 0, "a", "1.20"), (1, 0, "operator", 1, None, None), (1, 0, "operator", 2, None, None)]
