import pytest
from pyspark.sql import functions as F

from lexigauge.functions import clean_text, is_valid_text
from lexigauge.operators import clean as P
from lexigauge.sources import read_csv_text

from .conftest import optimized

CASES = [
    (None, "", False),
    ("", "", False),
    ('"""', "", False),
    ('\\"x\\"', '"x\\', True),
    ("\t a\xa0", "a", True),
    ('{"k": "v"}', '"v"', True),
    ('{"k": 69}', "69", True),
    ('{"a": "x", "b": 1}', '"x", "b": 1', True),
    ('{"a": {"b": x}}', "x}", True),
    ("x}}", "x}", True),
    ('a  {"b" : c', "ac", True),
    ("[]", "[]", False),
    (" [{}] ", "[{}]", False),
    ("   ", "", False),
    (' "abc "  ', "abc ", True),
    ('{ "k" : v }\n', "v", True),
]


@pytest.mark.parametrize("text,cleaned,valid", CASES)
def test_clean_cases(spark, text, cleaned, valid):
    df = spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t")).alias("c"))
    assert df.select("c", is_valid_text(F.col("c")).alias("v")).first()[:] == (cleaned, valid)


def test_whitespace_only_text_is_valid(spark):
    df = spark.createDataFrame([("  ",), (None,)], "t string").select(is_valid_text(F.col("t")))
    assert [r[0] for r in df.collect()] == [True, False]


def test_long_runs_stay_cheap(spark):
    text = " " * 300_000 + "x" + '"' * 300_000 + " {" * 100_000 + "y"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.length(clean_text(F.col("t")))).first()[0] == len(text.strip())


CSV = (
    'a,b,"{""k"": c}",a\n'
    "1,plain,x,y\n"
    '2,"two\nlines",x,y\n'
    '3,"say ""hi""",x,y\n'
    '4,"{""k"": ""v""}",x,y\n'
    "5,[],x,y\n"
    "6,ok,,y\n"
    "7,short\n"
    "8,long,x,y,z\n"
    "\n"
    "9,   ,x,y\n"
)


@pytest.fixture
def csv(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text(CSV, encoding="utf-8")
    return read_csv_text(spark, str(path))


def test_csv_headers(csv):
    assert csv.headers == ["a", "b", "c", "a"]
    assert csv.header_issues.count() == 0
    assert csv.column_of("a") == "c1"


def test_csv_rows(csv):
    rows = P.clean_csv(csv, names=["a", "b"]).orderBy("row_id").collect()
    assert [(r.text, r.reject_reason) for r in rows] == [
        ("1 plain", None),
        ("2 two\nlines", None),
        ('3 say "hi', None),
        ('4 "v"', None),
        (None, "invalid_cell"),
        (None, "invalid_cell"),
        (None, "ragged"),
        (None, "ragged"),
        (None, "invalid_cell"),
    ]


def test_csv_accounting_and_preview(csv):
    rows = P.clean_csv(csv, positions=[2])
    counted = {r.reject_reason: r.n_rows for r in P.row_accounting(rows).collect()}
    assert counted == {"kept": 4, "invalid_cell": 3, "ragged": 2}
    assert [r.text for r in P.preview(rows, "row_id", 2).collect()] == ["plain", "two\nlines"]


def test_selection(csv):
    everything = P.clean_csv(csv).orderBy("row_id").first().text
    assert everything == "1 plain x y"
    nothing = P.clean_csv(csv, positions=[])
    assert P.row_accounting(nothing).filter("reject_reason = 'invalid_text'").first().n_rows == 4
    with pytest.raises(ValueError):
        P.clean_csv(csv, names=["zzz"])
    with pytest.raises(IndexError):
        P.clean_csv(csv, positions=[0])
    with pytest.raises(IndexError):
        csv.columns_at([5])
    assert P.select_fields(["x", "y"], positions=[2]) == ["y"]


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv_text(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv_text(spark, str(tmp_path / "empty.csv"))


def test_header_issues(spark, tmp_path):
    (tmp_path / "h.csv").write_text('{},b\n1,2\n')
    assert [r.position for r in read_csv_text(spark, str(tmp_path / "h.csv")).header_issues.collect()] == [1]


def test_filter_does_not_repeat_the_cleaning(spark):
    df = spark.createDataFrame([(1, "x")], "id long, t string")
    once = optimized(P.clean_rows(df, "id", ["t"])).count("regexp_replace")
    assert optimized(P.kept(P.clean_rows(df, "id", ["t"]))).count("regexp_replace") == once
