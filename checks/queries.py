"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as D
from lexigauge.fixed_values import READABILITY_METRICS
from lexigauge.functions import clean_text, is_valid_text
from lexigauge.operators import annotations as A
from lexigauge.operators import clean as P
from lexigauge.operators import compare as C
from lexigauge.operators import features as H
from lexigauge.operators import language as L
from lexigauge.operators import moments as M
from lexigauge.operators import text_profile as T
from lexigauge.plans import Comparison, dataset_features, full_profile
from lexigauge.plans import group_report_lines, overall_report_lines
from lexigauge.plans.comparison import fitted_groups
from lexigauge.plans.detected import profile_detected
from lexigauge.plans.profile import flat_profile
from lexigauge.session import materialize, new_folder
from lexigauge.sources import (
    append_features,
    read_csv_by_name,
    read_csv_text,
    read_features,
    write_normalized,
)
from lexigauge.streaming import read_stream, write_available

CHUNK = 500
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of summation does not show.

    By plain arithmetic: engines differ in how they round a double that prints as a tie.
    """

    def shown(c: str, kind: str):
        value = H.column(c)
        return (F.floor(value * 1e6 + 0.5) / 1e6).alias(c) if kind == "double" else value

    return df.select(*[shown(c, kind) for c, kind in df.dtypes])


# --- Cleaning ------------------------------------------------------------------------


def q_clean_text(spark, sf):
    events = D.table(spark, sf, "events")
    return events.select("event_id", clean_text(F.col("props")).alias("cleaned"))


def q_valid_text(spark, sf):
    docs = D.table(spark, sf, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    events = D.broken_events(spark, sf).select(
        F.lit("events").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("text")
    )
    both = docs.unionByName(events)
    return both.select("origin", "id", is_valid_text(F.col("text")).alias("valid"))


def q_select_concat(spark, sf):
    customer = D.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("nation"), "c_name", "c_mktsegment"
    )
    columns = ["nation", "c_name", "c_mktsegment"]
    rows = P.clean_rows(customer, "c_custkey", columns, names=["c_mktsegment", "c_name"])
    return P.kept(rows)


def _broken_rows(spark, sf):
    return P.clean_rows(D.broken_events(spark, sf), "event_id", ["kind", "props"])


def q_valid_filter(spark, sf):
    return P.kept(_broken_rows(spark, sf))


def q_rejected_rows(spark, sf):
    return P.rejected(_broken_rows(spark, sf))


def q_clean_summary(spark, sf):
    return P.row_accounting(_broken_rows(spark, sf))


def q_clean_summary_observed(spark, sf):
    # counted while the kept rows are written
    rows, seen = P.observed(_broken_rows(spark, sf))
    materialize(P.kept(rows), "kept")
    return P.observed_accounting(spark, seen)


def q_clean_preview(spark, sf):
    return P.preview(_broken_rows(spark, sf), "event_id")


def q_stream_clean(spark, sf):
    schema = D.table(spark, sf, "events").schema
    events = read_stream(spark, sf, schema, "events.parquet")
    cleaned = P.clean_rows(events, "event_id", ["event_type", "props"])
    out = new_folder(spark, "stream_out")
    write_available(cleaned, out, new_folder(spark, "stream_state"))
    return spark.read.schema(cleaned.schema).parquet(out)


# --- Sources and sinks ---------------------------------------------------------------


def q_csv_source(spark, sf):
    path = new_folder(spark, "texts_csv")
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs.write.options(header=True, quoteAll=True, escape='"').csv(path)
    rows = P.clean_csv(read_csv_text(spark, path), names=["doc_id", "text"])
    return rows.select("text", "reject_reason")


def q_csv_by_name(spark, sf):
    # two orders of the columns, names that need cleaning
    path = new_folder(spark, "texts_by_name")
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", "\n", " ").alias("text"))
    odd = docs.toDF('"doc_id"', " lang ", "text")
    odd.filter(F.col('`"doc_id"`') % 2 == 0).write.options(header=True, quoteAll=True, escape='"').csv(path)
    swapped = docs.filter("doc_id % 2 = 1").select("text", "doc_id", "lang")
    swapped.write.mode("append").options(header=True, quoteAll=True, escape='"').csv(path)
    rows = P.clean_csv(read_csv_by_name(spark, path), names=["doc_id", "text"])
    return rows.select("text", "reject_reason")


def q_append_union(spark, sf):
    return _appended(spark, sf, new_folder(spark, "features"))


def q_append_union_csv(spark, sf):
    found = _appended(spark, sf, new_folder(spark, "features.csv"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("n_words", "n_sents")})


def _appended(spark, sf, path):
    docs = T.profile_datasets(D.documents(spark, sf), "dataset_name")
    append_features(docs.select("n_words", "n_sents", "dataset_name", "avg_similarity"), path)
    talks = T.basic_stats(D.conversations(spark, sf)).agg(
        F.sum("n_words").alias("n_words"), F.sum("n_sents").alias("n_sents")
    )
    append_features(talks, path)
    return rounded(read_features(spark, path))


def q_normalized_write(spark, sf):
    path = new_folder(spark, "normalized")
    write_normalized(H.normalize(_features(spark, sf)), path, source=sf)
    return rounded(read_features(spark, path))


def q_reference_user_read(spark, sf):
    master = T.basic_stats(D.documents(spark, sf)).select("dataset_name", "avg_word_length")
    user = T.basic_stats(D.benchmark(spark, sf)).select("dataset_name", "avg_word_length")
    both = master.withColumn("role", F.lit("reference")).unionByName(
        user.withColumn("role", F.lit("user"))
    )
    return rounded(
        both.groupBy("role").agg(
            F.count("*").alias("n_rows"), F.avg("avg_word_length").alias("avg_word_length")
        )
    )


# --- Language ------------------------------------------------------------------------


def q_lang_profile(spark, sf):
    return L.fit_profile(D.documents(spark, sf))


def q_lang_detect(spark, sf):
    docs = D.documents(spark, sf)
    profile = materialize(L.fit_profile(docs), "languages")
    return L.detect_language(docs, profile, "doc_id")


def q_profile_detected(spark, sf):
    docs = D.partly_russian(spark, sf)
    languages = materialize(L.fit_profile(docs), "languages")
    found = profile_detected(docs, languages)
    return rounded(found.drop("n_pairs", "sum_similarity", "avg_similarity"))


# --- Texts ---------------------------------------------------------------------------


def q_chunks(spark, sf):
    chunked = T.chunk_texts(D.documents(spark, sf), CHUNK)
    return T.explode_chunks(chunked, ["doc_id"])


def q_sentence_chunks(spark, sf):
    chunked = T.chunk_texts(D.documents(spark, sf), CHUNK, split="sentence")
    return T.explode_chunks(chunked, ["doc_id"])


def q_sentence_split(spark, sf):
    return T.sentence_table(D.documents(spark, sf), ["doc_id"])


def q_word_tokens(spark, sf):
    return T.word_table(D.documents(spark, sf), ["doc_id"])


def q_doc_basic_stats(spark, sf):
    counted = T.basic_stats(D.documents(spark, sf))
    return rounded(counted.select("doc_id", "n_chars", "n_words", "n_sents", "avg_word_length"))


def q_dataset_basic_stats(spark, sf):
    totals = T.profile_datasets(D.documents(spark, sf), "dataset_name", with_words=False, with_similarity=False)
    return rounded(
        totals.select("dataset_name", "n_docs", "n_chars", "n_words", "n_sents", "avg_word_length")
    )


def q_unique_words(spark, sf):
    return T.unique_words(D.documents(spark, sf)).select("doc_id", "n_unique_words")


def q_unique_words_dataset(spark, sf):
    return T.unique_words_by(D.documents(spark, sf), "dataset_name")


def q_unique_words_sketch(spark, sf):
    docs = D.documents(spark, sf)
    parts = materialize(T.unique_word_sketches(docs, ["dataset_name", "lang"]), "sketches")
    merged = T.merged_sketches(parts, ["dataset_name"]).withColumnRenamed("words_sketch", "merged")
    whole = T.unique_word_sketches(docs, ["dataset_name"])
    both = T.unique_words_by(docs, "dataset_name").join(whole, "dataset_name").join(merged, "dataset_name")
    exact, about = F.col("n_unique_words"), T.sketched_words(F.col("words_sketch"))
    return both.select(
        "dataset_name",
        "n_unique_words",
        # four times the error to be expected
        (F.abs(about - exact) <= exact * 4 * 1.04 / 2 ** (T.SKETCH_PRECISION / 2)).alias("within_error"),
        T.same_words(F.col("words_sketch"), F.col("merged")).alias("merge_equals_whole"),
    )


def q_char_classes(spark, sf):
    counted = T.char_classes(D.documents(spark, sf))
    return counted.select("doc_id", "n_letters", "n_spaces", "n_punctuations")


def q_syllable_stats(spark, sf):
    counted = T.syllable_stats(D.documents(spark, sf), lang="lang")
    return counted.select(
        "doc_id",
        "n_syllables",
        "n_monosyllable_words",
        "n_polysyllable_words",
        "n_complex_words",
        "n_simple_words",
    )


def q_long_words(spark, sf):
    return T.long_word_stats(D.documents(spark, sf)).select("doc_id", "n_long_words")


def q_readability_doc(spark, sf):
    scored = T.readability(T.text_counts(D.documents(spark, sf), lang="lang"), "lang")
    return rounded(scored.select("doc_id", *READABILITY_METRICS))


def q_readability_dataset(spark, sf):
    scored = T.profile_datasets(D.documents(spark, sf), "dataset_name", lang="lang", with_words=False, with_similarity=False)
    return rounded(scored.select("dataset_name", *READABILITY_METRICS))


def q_readability_chunked(spark, sf):
    return rounded(T.chunked_readability(D.documents(spark, sf), "doc_id", CHUNK, lang="lang"))


def q_homogeneity(spark, sf):
    scored = T.homogeneity(D.documents(spark, sf))
    return rounded(scored.select("doc_id", "n_pairs", "avg_similarity"))


def q_homogeneity_dataset(spark, sf):
    scored = T.profile_datasets(D.documents(spark, sf), "dataset_name", with_words=False)
    return rounded(scored.select("dataset_name", "n_pairs", "avg_similarity"))


# --- Annotations ---------------------------------------------------------------------


def _tokens(spark, sf):
    return D.tokens(D.documents(spark, sf))


def q_pos_counts(spark, sf):
    return A.pos_counts(_tokens(spark, sf), ["doc_id"])


def q_entity_counts(spark, sf):
    return A.entity_counts(_tokens(spark, sf), ["dataset_name"])


def q_dep_counts(spark, sf):
    return A.dependency_counts(_tokens(spark, sf), ["dataset_name"])


def q_max_arc(spark, sf):
    return rounded(A.max_arc_length(_tokens(spark, sf), ["doc_id"]))


# --- Profiles and feature rows -------------------------------------------------------


def _docs_and_tokens(spark, sf):
    docs = D.documents(spark, sf)
    return docs, D.tokens(docs)


def q_full_profile(spark, sf):
    profile = full_profile(*_docs_and_tokens(spark, sf), grain="document", lang="lang")
    return rounded(
        profile.select(
            "doc_id",
            "dataset_name",
            "basic_statistics.*",
            "readability_statistics.*",
            F.coalesce(F.try_element_at("pos_ner_analysis.pos", F.lit("X")), F.lit(0)).alias("pos_x"),
            F.coalesce(F.try_element_at("pos_ner_analysis.ner", F.lit("PER")), F.lit(0)).alias("ner_per"),
            F.coalesce(
                F.try_element_at("syntactic_analysis.dependency_stats", F.lit("ROOT")), F.lit(0)
            ).alias("dep_root"),
            "syntactic_analysis.avg_max_arc_length",
            F.col("text_homogeneity.avg_similarity"),
        )
    )


def q_flatten_features(spark, sf):
    profile = full_profile(*_docs_and_tokens(spark, sf), grain="dataset", lang="lang")
    return rounded(flat_profile(profile))


def _features(spark, sf):
    return dataset_features(*_docs_and_tokens(spark, sf), lang="lang")


def q_template_view(spark, sf):
    return rounded(_features(spark, sf))


def q_norm_by_sents(spark, sf):
    return rounded(H.normalize_by_sentences(_features(spark, sf)))


def q_norm_by_words(spark, sf):
    return rounded(H.normalize_by_words(_features(spark, sf)))


# --- Comparison ----------------------------------------------------------------------


def _lines(spark, sf):
    return D.table(spark, sf, "lineitem")


def _by_feature(df: DataFrame, features: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """One row per feature from columns that hold arrays in feature order."""
    names = F.array(*[F.lit(f) for f in features]).alias("feature")
    zipped = F.explode(F.arrays_zip(names, *[F.col(c) for c in columns])).alias("e")
    return df.select(*keys, zipped).select(*keys, "e.*")


def q_zscore_fit(spark, sf):
    fit = M.fit_scaler(_lines(spark, sf), D.LINE_FEATURES)
    return rounded(_by_feature(fit, D.LINE_FEATURES, [], ["mean", "scale"]))


def q_zscore_apply(spark, sf):
    customer = D.table(spark, sf, "customer")
    fit = M.fit_scaler(customer, ["c_acctbal"])
    scaled = M.standardize(customer, ["c_acctbal"], fit)
    return rounded(scaled.select("c_custkey", "c_acctbal"))


def q_user_vector(spark, sf):
    lines = _lines(spark, sf)
    fit = M.fit_scaler(lines, D.LINE_FEATURES)
    vector = C.user_vector(lines, D.LINE_FEATURES, fit, "O", "l_linestatus")
    return rounded(_by_feature(vector, D.LINE_FEATURES, ["n_rows"], ["mean", "std"]))


def q_user_vector_all(spark, sf):
    # the reference is all of lineitem, the user's data all of part under the same feature names
    parts = D.table(spark, sf, "part").selectExpr("CAST(p_size AS DOUBLE) AS l_quantity", "p_retailprice AS l_extendedprice")
    vector = C.user_vector(parts, D.LINE_FEATURES, M.fit_scaler(_lines(spark, sf), D.LINE_FEATURES))
    return rounded(_by_feature(vector, D.LINE_FEATURES, ["n_rows"], ["mean", "std"]))


def _line_groups(spark, sf):
    lines = _lines(spark, sf)
    fit, groups = fitted_groups(lines, "l_returnflag", D.LINE_FEATURES)
    return groups, C.user_vector(lines, D.LINE_FEATURES, fit, "O", "l_linestatus")


def q_group_moments(spark, sf):
    groups, _ = _line_groups(spark, sf)
    rows = _by_feature(groups, D.LINE_FEATURES, ["grp", "n_rows"], ["mean", "std", "cov"])
    return rounded(
        rows.select(
            "grp",
            "n_rows",
            "feature",
            "mean",
            "std",
            *[F.col("cov")[i].alias(f"cov_{f}") for i, f in enumerate(D.LINE_FEATURES)],
        )
    )


def q_group_cov_wide(spark, sf):
    vectors = D.table(spark, sf, "embeddings")
    size = vectors.select(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(size)]
    table = vectors.selectExpr("label", *[f"get(embedding, {i}) as {n}" for i, n in enumerate(names)])
    _, groups = fitted_groups(table, "label", names)
    rows = groups.select("grp", F.posexplode("cov").alias("i", "row"))
    return rounded(rows.select("grp", "i", F.posexplode("row").alias("j", "cov")))


def q_mahalanobis(spark, sf):
    return rounded(C.group_distances(*_line_groups(spark, sf)))


def q_euclidean(spark, sf):
    return rounded(C.group_distances(*_line_groups(spark, sf), method="euclidean"))


def q_group_rank(spark, sf):
    return rounded(C.ranked_groups(C.group_distances(*_line_groups(spark, sf))))


def q_feature_diffs(spark, sf):
    return rounded(C.feature_differences(*_line_groups(spark, sf), D.LINE_FEATURES))


def q_key_differences(spark, sf):
    diffs = C.feature_differences(*_line_groups(spark, sf), D.LINE_FEATURES)
    return rounded(C.key_differences(diffs, top_n=1))


def _all_datasets(spark, sf):
    lines = _lines(spark, sf)
    return Comparison(lines, lines, D.LINE_FEATURES).compare_all_to_groups("l_linenumber", "l_suppkey", top_n_features=1)


def q_compare_all_datasets(spark, sf):
    # every supplier against every line number
    report = _all_datasets(spark, sf)
    first = report.key_differences.drop("rank").withColumnRenamed("pos", "feature_pos")
    return rounded(report.scores.join(first, ["dataset_name", "grp"]))


def _text_comparison(spark, sf) -> Comparison:
    master = D.text_features(D.documents(spark, sf), ["doc_id", "lang"])
    user = D.text_features(D.conversations(spark, sf), ["dataset_name"])
    return Comparison(master, user, D.TEXT_FEATURES)


def _group_report(spark, sf):
    return _text_comparison(spark, sf).compare_to_groups("lang", "assistant")


def q_compare_groups(spark, sf):
    report = _group_report(spark, sf)
    return rounded(
        report.scores.join(
            report.details.select("grp", "feature", "user_value", "group_mean", "z_score", "contribution"),
            "grp",
        )
    )


def q_compare_quality(spark, sf):
    labels = D.table(spark, sf, "labels").select("doc_id", "quality")
    master = D.text_features(D.documents(spark, sf), ["doc_id"]).join(labels, "doc_id")
    user = D.text_features(D.benchmark(spark, sf), ["dataset_name"])
    report = Comparison(master, user, D.TEXT_FEATURES).compare_to_groups("quality")
    return rounded(report.scores)


def _overall(spark, sf):
    return _text_comparison(spark, sf).general_comparison("assistant", top_n_features=2)


def q_overall_stats(spark, sf):
    return rounded(_overall(spark, sf).overall_stats)


def q_feature_comparison(spark, sf):
    compared = _overall(spark, sf).feature_comparison
    return rounded(compared.select("feature", "user_value", "z_score", "similarity"))


def q_divergent_features(spark, sf):
    top = _overall(spark, sf).most_divergent_features
    return rounded(top.select("feature", "user_value", "z_score", "similarity"))


def q_report_group(spark, sf):
    return group_report_lines(_group_report(spark, sf))


def q_report_overall(spark, sf):
    return overall_report_lines(_overall(spark, sf))


def all_queries() -> dict[str, Query]:
    return {name[2:]: q for name, q in globals().items() if name.startswith("q_")}
