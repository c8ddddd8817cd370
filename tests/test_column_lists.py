"""Normalisation over the caller's own column lists."""

import json

import pytest

from lexigauge.fixed_values import BY_SENTENCES, BY_WORDS, N_SENTS, N_WORDS
from lexigauge.operators import features as H


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("a", 4, 10, 8.0, 5.0, 3.0), ("b", 0, 0, 1.0, 1.0, 1.0)], f"dataset_name string, `{N_SENTS}` long, `{N_WORDS}` long, `dependency_acl:relcl` double, own double, other double")


def test_lists_from_files(spark, table, tmp_path):
    (tmp_path / "sents.json").write_text(json.dumps(["own", "dependency_acl:relcl", "not there"], indent=2))
    (tmp_path / "words.json").write_text('["other"]')
    sents, words = (H.read_column_list(spark, str(tmp_path / f"{n}.json")) for n in ("sents", "words"))
    assert (sents, words) == (["own", "dependency_acl:relcl", "not there"], ["other"])
    a, b = H.normalize(table, sents, words).orderBy("dataset_name").collect()
    assert (a["own"], a["dependency_acl:relcl"], a["other"]) == (1.25, 2.0, 0.3)
    assert (b["own"], b["dependency_acl:relcl"], b["other"]) == (None, None, None)
    assert H.normalization_columns(spark, sents, words).count() == 4


def test_defaults_and_denominators(spark, table):
    a = H.normalize(table).orderBy("dataset_name").first()
    assert (a["own"], a["dependency_acl:relcl"]) == (5.0, 2.0)
    assert H.normalization_columns(spark).count() == len(BY_SENTENCES) + len(BY_WORDS)
    a = H.normalize(table, [N_WORDS], ["own"]).orderBy("dataset_name").first()
    assert (a[N_WORDS], a["own"]) == (2.5, 0.5)
    assert H.normalize(table, [], []).columns == table.columns
    with pytest.raises(ValueError):
        H.normalize(table, ["own"], ["own"])


def test_bad_lists(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        H.read_column_list(spark, str(tmp_path / "none.json"))
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError):
        H.read_column_list(spark, str(tmp_path / "empty.json"))
