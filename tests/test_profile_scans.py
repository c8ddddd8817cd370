"""The full profile reads its tables once."""

import pytest

from checks import derived
from lexigauge.operators import text_profile as T
from lexigauge.plans import dataset_features, full_profile
from tests.conftest import optimized, physical


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"Some text {i % 5}. And the other, again {i}! What? Yes.", "ru" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, dataset_name string, text string, lang string")
    docs.write.parquet(f"{folder}/docs")
    derived.tokens(docs).write.parquet(f"{folder}/tokens")
    return spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/tokens")


@pytest.mark.parametrize("grain", ["dataset", "document"])
def test_one_scan_a_table(tables, grain):
    docs, tokens = tables
    plan = physical(full_profile(docs, tokens, grain, "lang"))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 2
    assert sum("upos" in s for s in scans) == 1 and sum("text" in s for s in scans) == 1
    if grain == "dataset":
        assert physical(dataset_features(docs, tokens, "lang")).count("FileScan parquet") == 2


def test_words_are_split_once_more_for_their_table_only(tables):
    docs, _ = tables
    before = optimized(T.readability(T.homogeneity(T.text_counts(docs, "text", "lang"), "text"), "lang")).count("regexp")
    assert optimized(T.profile_datasets(docs, "dataset_name", lang="lang")).count("regexp") <= before + 1


def test_sums_do_not_depend_on_the_plan(tables):
    """As from documents added up, and words counted apart."""
    docs, _ = tables
    got = {r.dataset_name: r for r in T.profile_datasets(docs, "dataset_name", lang="lang").collect()}
    parts = T.profile_documents(docs, ["doc_id", "dataset_name"], lang="lang").collect()
    words = {r.dataset_name: r.n_unique_words for r in T.unique_words_by(docs, "dataset_name").collect()}
    assert got.keys() == {r.dataset_name for r in parts} and None in got
    for name, r in got.items():
        own = [p for p in parts if p.dataset_name == name]
        assert r.n_docs == len(own)
        assert r.n_unique_words == words[name]
        for c in ("n_words", "n_sents", "n_syllables", "n_letters", "n_pairs"):
            assert r[c] == sum(p[c] for p in own)
        assert r.avg_similarity == pytest.approx(sum(p.sum_similarity for p in own) / r.n_pairs)


def test_parts_can_be_left_out(tables):
    docs, _ = tables
    whole = T.profile_datasets(docs, "dataset_name", lang="lang").filter("dataset_name = 's1'").first()
    less = T.profile_datasets(docs, "dataset_name", lang="lang", with_words=False, with_similarity=False).filter("dataset_name = 's1'").first()
    gone = {"n_unique_words", "n_pairs", "sum_similarity", "avg_similarity"}
    assert {c for c in less.asDict() if less[c] is None} == gone
    assert all(less[c] == whole[c] for c in less.asDict() if c not in gone)
