"""CSV files whose headers differ."""

import pytest
from pyspark.sql import types as T

from lexigauge.operators import clean
from lexigauge.sources import append_features, read_csv_by_name, read_features


def written(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def rows_of(source, *names):
    cells = [source.column_of(n) for n in names]
    return sorted((tuple(r[c] for c in cells) for r in source.rows.collect()), key=str)


@pytest.mark.parametrize("multi_line", [False, True])
def test_swapped_headers(spark, tmp_path, multi_line):
    path = written(tmp_path, {"a.csv": 'id,"Title",body\n1,one,"x, y"\n2,two,z\n', "b.csv": 'body, "Title" ,id\n"p ""q""",three,3\n', "c.csv": "id,\"Title\",body\n4,four,w\n"})
    source = read_csv_by_name(spark, path, multi_line)
    assert source.headers == ["id", "Title", "body"]
    assert rows_of(source, "id", "Title", "body") == [("1", "one", "x, y"), ("2", "two", "z"), ("3", "three", 'p "q"'), ("4", "four", "w")]
    told = {(r.file.rsplit("/", 1)[1], r.position, r.header, r.issue) for r in source.header_issues.collect()}
    assert told == {("b.csv", 1, "body", "differs"), ("b.csv", 2, "Title", "differs"), ("b.csv", 3, "id", "differs")}
    assert source.rows.select("row_id").distinct().count() == 4


def test_missing_odd_and_repeated_names(spark, tmp_path):
    path = written(tmp_path, {"a.csv": "k,[],k\n1,2,3\n", "b.csv": "extra,k\n9,8\n"})
    source = read_csv_by_name(spark, path)
    assert source.headers == ["k", "[]", "k", "extra"]
    assert sorted(tuple(r[c] for c in source.columns) for r in source.rows.fillna("-").collect()) == [("1", "2", "3", "-"), ("8", "-", "-", "9")]
    told = {(r.file.rsplit("/", 1)[1], r.position, r.issue) for r in source.header_issues.collect()}
    assert told == {("a.csv", 2, "invalid"), ("b.csv", 1, "differs"), ("b.csv", 2, "differs")}


def test_ragged_rows_are_those_of_their_own_header(spark, tmp_path):
    path = written(tmp_path, {"a.csv": "a,b,c\n1,2,3\n1,2\n", "b.csv": "b,a\n5,4\n5,4,3\n"})
    rows = clean.clean_csv(read_csv_by_name(spark, path), names=["a", "b"])
    found = sorted((r.text or "", r.reject_reason or "") for r in rows.collect())
    # a file without a column has no valid cell there
    assert found == [("", "invalid_cell"), ("", "ragged"), ("", "ragged"), ("1 2", "")]


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv_by_name(spark, str(tmp_path / "nothing"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv_by_name(spark, str(tmp_path))


def test_feature_tables_as_csv(spark, tmp_path):
    """Tables with other columns, appended; cells that are no numbers."""
    path = str(tmp_path / "features.csv")
    append_features(spark.createDataFrame([("a", 1.5, 2)], "dataset_name string, x double, `dependency_acl:relcl` long"), path)
    append_features(spark.createDataFrame([(7, 'with "quotes", and more', None)], "y long, dataset_name string, x double"), path)
    append_features(spark.createDataFrame([(3.0, "text")], "x double, y string"), path)
    got = sorted((tuple(r[c] for c in ("dataset_name", "x", "y", "dependency_acl:relcl")) for r in read_features(spark, path).collect()), key=str)
    assert got == [("a", 1.5, None, 2.0), ("unnamed_dataset", 3.0, None, None), ('with "quotes", and more', None, 7.0, None)]
    schema = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("y", T.LongType()), T.StructField("z", T.DoubleType())])
    typed = read_features(spark, path, schema)
    assert typed.schema["y"].dataType == T.LongType()
    assert sorted((r.y or 0, r.z) for r in typed.collect()) == [(0, None), (0, None), (7, None)]
