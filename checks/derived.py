"""Inputs the queries derive from the given tables with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.fixed_values import WS
from lexigauge.functions import sentences
from lexigauge.operators import text_profile as T
from lexigauge.sources import read_table, spread

# Forms that stand for entities in the derived token table.
ENTITY_WORDS = {
    "Orre": "PER",
    "orantion": "PER",
    "rewh": "LOC",
    "hehely": "LOC",
    "ha": "ORG",
    "nd": "ORG",
    "thatin": "MISC",
}
TOKEN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{WS}]"
LONG_FORM = 10
LINE_FEATURES = ["l_quantity", "l_extendedprice"]
TEXT_FEATURES = ["avg_word_length", "automated_readability_index", "coleman_liau_index"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("dataset_name"), "text", "lang"
    )
    return spread(docs, "doc_id")


# Letters that stand for others where a text is made Russian by rule.
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абцдефгхийклмнопкрстуввхызАБЦДЕФГХИЙКЛМНОПКРСТУВВХЫЗ"


def partly_russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, every fifth with its Latin letters replaced by Cyrillic ones and labelled Russian."""
    picked = F.col("doc_id") % 5 == 0
    return documents(spark, sf_dir).withColumns(
        {
            "text": F.when(picked, F.translate("text", LATIN, CYRILLIC)).otherwise(F.col("text")),
            "lang": F.when(picked, F.lit("ru")).otherwise(F.col("lang")),
        }
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").withColumn("dataset_name", F.lit("benchmark"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("role", "dataset_name")


def broken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose cells are damaged by rules on their values."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(value < 2, F.lit('""')).otherwise(F.col("event_type")).alias("kind"),
        F.when(value > 20, F.lit(" [{}] "))
        .when((value > 15) & (F.col("event_type") == "view"), F.lit(None))
        .otherwise(F.col("props"))
        .alias("props"),
    )


def tokens(docs: DataFrame) -> DataFrame:
    """A stand-in for a tagger's output, made by rules on the shape of a token."""
    entity = F.create_map(*[F.lit(x) for pair in ENTITY_WORDS.items() for x in pair])
    def of_sentence(i, toks):
        # a position before the first gives null
        previous = lambda k: F.get(toks, k - 1)
        return F.transform(
            toks,
            lambda f, k: F.struct(i.alias("sent_id"), k.alias("k"), f.alias("form"), previous(k).alias("previous")),
        )

    found = F.transform(sentences(F.col("text")), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)))
    lists = docs.select("doc_id", "dataset_name", found.alias("lists"))
    toks = F.flatten(F.transform("lists", lambda l, i: of_sentence(i, l)))
    with_previous = lists.select("doc_id", "dataset_name", F.posexplode_outer(toks).alias("tok_id", "t"))
    with_previous = with_previous.filter(F.col("tok_id").isNotNull()).select("doc_id", "dataset_name", "tok_id", "t.*")
    form = F.col("form")
    # a token of more than one character is a word
    is_word = (F.length("form") > 1) | form.rlike(r"^[\p{L}\p{N}]")
    upos = (
        F.when(form.rlike(r"^\p{N}+$"), "NUM")
        .when(is_word, "X")
        .when(form.rlike(r"^\p{P}"), "PUNCT")
        .otherwise("SYM")
    )
    deprel = (
        F.when(F.col("k") == 0, "ROOT")
        .when(~is_word, "punct")
        .when(F.length("form") >= LONG_FORM, "acl:relcl")
        .otherwise("dep")
    )
    here = F.try_element_at(entity, form)
    before = F.try_element_at(entity, F.col("previous"))
    iob = F.when(here.isNull(), "O").when(F.equal_null(here, before), "I").otherwise("B")
    return with_previous.select(
        "doc_id",
        "dataset_name",
        "sent_id",
        "tok_id",
        "form",
        upos.alias("upos"),
        (F.col("tok_id") - F.col("k")).alias("head"),
        deprel.alias("deprel"),
        F.coalesce(here, F.lit("")).alias("ent_type"),
        iob.alias("ent_iob"),
    )


def text_features(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The three text features the comparison queries use."""
    counted = T.readability(T.text_counts(docs)).withColumn(
        "avg_word_length",
        T.X.mean_word_length(F.col("n_word_chars"), F.col("n_words")),
    )
    return counted.select(*keys, *TEXT_FEATURES)
