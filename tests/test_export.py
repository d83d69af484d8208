"""Export: files that can be opened, types of sheets, clashing and odd names, bounds, empty tables."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import export as X
from corpusloom.operators import json_views as J

SCHEMA = "key bigint, name string, result string"


def exported(spark, rows, folder):
    X.write(spark.createDataFrame(rows, SCHEMA), folder)
    return folder


def test_texts_are_markdown_files(spark, tmp_path):
    rows = [(1, 'Who: has/the "sword"?', "# Añswer\n\n* one\n"), (2, None, ""), (3, "  a \n b ", "plain"), (4, "x" * 200, '"a JSON text"'), (5, "gone", None), (3, "  a \n b ", "plain")]
    folder = exported(spark, rows, str(tmp_path / "out here"))
    files = {os.path.basename(f).rsplit("-", 1)[0]: open(f, encoding="utf-8").read() for f in glob.glob(f"{folder}/markdown/*/*.md")}
    assert files == {"Who- has-the -sword--": "# Añswer\n\n* one\n", "analysis-result": "", "a b": "plain", "x" * 80: '"a JSON text"'}
    assert not glob.glob(f"{folder}/markdown/*/*.draft")
    read = sorted((r.key, r.body) for r in X.texts(spark, folder).collect())
    assert read == [(1, "# Añswer\n\n* one\n"), (2, ""), (3, "plain"), (4, '"a JSON text"')]


def test_types_keep_every_value(spark, tmp_path):
    rows = [
        {"whole": 1, "wide": 2**53 + 1, "mixed": 1, "code": "007", "yes": True, "odd": True, "some": 5, "text": "1e3", "Name": "a", "name": "b"},
        {"whole": -2, "wide": 0.5, "mixed": 2.5, "code": "12", "yes": False, "odd": "no", "some": None, "text": "x", "key": "k", "row": 4},
    ]
    folder = exported(spark, [(9, "n", json.dumps({"items": rows}))], str(tmp_path / "out"))
    kinds = {r.field: r.kind for r in X.catalogue(spark, folder).collect()}
    assert kinds == {"whole": "bigint", "wide": "string", "mixed": "double", "code": "string", "yes": "boolean", "odd": "string", "some": "bigint", "text": "string", "Name": "string", "name": "string", "key": "string", "row": "bigint"}
    columns = {r.field: r.column for r in X.catalogue(spark, folder).collect()}
    assert len({c.lower() for c in columns.values()} | {"key", "row"}) == len(columns) + 2
    one, two = X.sheet(spark, folder, 0).orderBy("row").collect()
    assert (one["whole"], one["mixed"], one["yes"], one["code"], one["some"]) == (1, 1.0, True, "007", 5)
    assert (two["whole"], two["mixed"], two["yes"], two["code"], two["some"]) == (-2, 2.5, False, "12", None)
    assert (one[columns["Name"]], one[columns["name"]], two[columns["key"]], two[columns["row"]]) == ("a", "b", "k", 4)


VALUES = [
    {"items": [{"a": 1, "b": ["x", "y"]}, "bare", None], "more": [[1, 2], [3]], "at": {"x": {"y": "deep", "z": []}}},
    {"name": "only", "n": 3}, [{"a": 2}, {"c.d `e`": "f"}], {"title": "t", "at": {"x / y": "one", "x": {"y": "two"}}}, {"items": []}, {}, [],
]


def long_cells(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "key bigint, body string").withColumn("v", F.parse_json("body"))
    found = {}
    for r in J.tables(rows, ["key"], "v").collect():
        found.setdefault((r.key, r.t, r.row, r.field), []).append(r.value)
    return {k: "\n".join(sorted(v)) for k, v in found.items()}


def read_cells(spark, folder):
    return {(r.key, r.t, r.row, r.field): r.value for r in X.cells(spark, folder).collect()}


@pytest.mark.parametrize("bounds", [(100, 300), (1, 300), (100, 2), (1, 1)])
def test_cells_are_those_of_the_tables(spark, tmp_path, monkeypatch, bounds):
    """Whatever doesn't become a sheet is exported in long form."""
    monkeypatch.setattr(X, "SHEETS", bounds[0])
    monkeypatch.setattr(X, "FIELDS", bounds[1])
    folder = exported(spark, [(i, "n", json.dumps(v)) for i, v in enumerate(VALUES)], str(tmp_path / "out"))
    assert read_cells(spark, folder) == long_cells(spark, VALUES)
    assert len(glob.glob(f"{folder}/sheets/*")) <= bounds[0]
    assert sorted((r.key, r.body) for r in X.untabled(spark, folder, "bigint").collect()) == [(4, '{"items":[]}'), (5, "{}"), (6, "[]")]
    assert X.texts(spark, folder).collect() == []


def test_nothing_to_export(spark, tmp_path):
    folder = exported(spark, [(1, "n", None)], str(tmp_path / "out"))
    assert [X.texts(spark, folder).count(), X.cells(spark, folder).count(), X.catalogue(spark, folder).count(), X.untabled(spark, folder, "bigint").count()] == [0, 0, 0, 0]
