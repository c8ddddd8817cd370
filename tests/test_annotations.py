import pytest

from lexigauge.fixed_values import TEMPLATE_COLUMNS
from lexigauge.operators import annotations as A
from lexigauge.operators import features as H
from lexigauge.plans import dataset_features, full_profile
from lexigauge.plans.profile import flat_profile
from lexigauge.sources import append_features, read_features, union_features, write_normalized

SCHEMA = (
    "doc_id long, dataset_name string, sent_id int, tok_id int, form string, upos string, "
    "head int, deprel string, ent_type string, ent_iob string"
)
# Three sentences, one of a single token; a two-token entity; a relation with a colon.
ROWS = [
    (1, "d", 0, 0, "New", "PROPN", 1, "flat:name", "LOC", "B"),
    (1, "d", 0, 1, "York", "PROPN", 2, "nsubj", "LOC", "I"),
    (1, "d", 0, 2, "grew", "VERB", 2, "ROOT", "", "O"),
    (1, "d", 0, 3, ".", "PUNCT", 2, "punct", "", "O"),
    (1, "d", 1, 4, "Yes", "INTJ", 4, "ROOT", "", "O"),
    (1, "d", 2, 5, "He", "PRON", 9, "nsubj", "", "O"),
    (1, "d", 2, 6, "met", "VERB", 6, "ROOT", "", "O"),
    (1, "d", 2, 9, "Ann", "PROPN", 6, "obj", "PER", "B"),
]


@pytest.fixture
def tokens(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(
        [(1, "d", "New York grew. Yes. He met Ann"), (2, "e", "One")],
        "doc_id long, dataset_name string, text string",
    )


def as_dict(df):
    return {r[1]: r[2] for r in df.collect()}


def test_counts(tokens):
    keys = ["dataset_name"]
    assert as_dict(A.pos_counts(tokens, keys)) == {"PROPN": 3, "VERB": 2, "PUNCT": 1, "INTJ": 1, "PRON": 1}
    assert as_dict(A.entity_counts(tokens, keys)) == {"LOC": 1, "PER": 1}
    assert as_dict(A.dependency_counts(tokens, keys))["flat:name"] == 1


def test_longest_arcs(tokens):
    # longest arcs 1 and 4; the sentence of one token does not count
    assert A.max_arc_length(tokens, ["doc_id"]).first().avg_max_arc_length == pytest.approx(2.5)
    single = tokens.filter("sent_id = 1")
    assert A.max_arc_length(single, ["doc_id"]).first().avg_max_arc_length == 0.0


def test_maps(tokens):
    row = A.token_profile(tokens, ["doc_id"]).first()
    assert row.ner == {"LOC": 1, "PER": 1}
    assert row.dependency_stats["ROOT"] == 3


def test_profile_without_tokens_or_pairs(docs, tokens):
    rows = {r.doc_id: r for r in full_profile(docs, tokens, "document").collect()}
    assert rows[1].pos_ner_analysis.ner == {"LOC": 1, "PER": 1}
    assert rows[2].pos_ner_analysis.pos == {}
    assert rows[2].text_homogeneity is None
    assert rows[2].syntactic_analysis.avg_tree_depth == 0.0


def test_feature_row(docs, tokens):
    table = dataset_features(docs, tokens)
    assert table.columns == TEMPLATE_COLUMNS and len(table.columns) == 86
    rows = {r.dataset_name: r.asDict() for r in table.collect()}
    assert rows["d"]["dependency_flat:name"] == 1
    assert rows["d"]["dependency_acl:relcl"] == 0
    assert rows["d"]["pos_ner_analysis_ner_LOC"] == 1
    assert rows["d"]["syntactic_analysis_avg_tree_depth"] == pytest.approx(2.5)
    assert rows["e"]["text_homogeneity_avg_similarity"] == 0.0
    assert rows["e"]["sentiment_analysis_polarity"] == 0.0


def test_normalize(spark, docs, tokens):
    table = dataset_features(docs, tokens)
    row = H.normalize(table).filter("dataset_name = 'd'").first().asDict()
    assert row["dependency_ROOT"] == pytest.approx(3 / 3)
    assert row["pos_ner_analysis_pos_VERB"] == pytest.approx(2 / 7)
    assert row["basic_statistics_n_words"] == 7
    empty = spark.createDataFrame([("z", 0, 0, 5, 3)], "dataset_name string, basic_statistics_n_sents long, "
                                  "basic_statistics_n_words long, dependency_ROOT long, basic_statistics_n_chars long")
    assert H.normalize(empty).first()[3:] == (None, None)
    assert H.normalize_by_words(empty.drop("basic_statistics_n_words")).first().basic_statistics_n_chars == 3
    assert H.normalization_columns(spark).count() == 73


def test_flatten_keeps_unlisted_maps(spark):
    df = spark.sql("select struct(1 as x, struct('a' as z) as y) as s, map('k', 2) as m")
    assert H.flatten(df).columns == ["s_x", "s_y_z", "m"]
    assert H.flatten(df, {"m": ["k", "l"]}).first()[2:] == (2, None)


def test_template_defaults(spark):
    row = H.template_view(spark.createDataFrame([(5, "x")], "basic_statistics_n_words long, other string")).first()
    assert row.dataset_name == "unnamed_dataset"
    assert row.basic_statistics_n_words == 5 and row.basic_statistics_n_sents == 0


def test_storage(spark, tmp_path, docs, tokens):
    path = str(tmp_path / "features")
    table = dataset_features(docs, tokens)
    append_features(table, path)
    append_features(table.drop("dataset_name").limit(1), path)
    stored = read_features(spark, path)
    assert stored.columns[0] == "dataset_name" and stored.count() == 3
    assert stored.filter("dataset_name = 'unnamed_dataset'").count() == 1
    assert read_features(spark, path, H.feature_schema()).count() == 3
    with pytest.raises(ValueError):
        write_normalized(table, path, source=path)
    write_normalized(H.normalize(table), str(tmp_path / "norm"), source=path)
    assert read_features(spark, str(tmp_path / "norm")).count() == 2
    extra = spark.createDataFrame([(1,)], "more int")
    both = union_features(table.select("dataset_name"), extra)
    assert both.columns == ["dataset_name", "more"] and both.count() == 3


def test_flat_profile_columns(docs, tokens):
    names = flat_profile(full_profile(docs, tokens)).columns
    assert "syntactic_analysis_dependency_stats_flat:name" in names
    assert "pos_ner_analysis_pos_ADJ" in names
