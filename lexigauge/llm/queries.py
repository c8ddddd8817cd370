"""The queries of this package: one per operator, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return done.select("doc_id", *bpe.digests(done))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    scanned = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", *licenses.summary(scanned))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import new_folder
    from . import sharding

    # whole rows are shuffled and written; sizes and checksums are those of the texts read from the shards
    shards = sharding.write_shards(_table(spark, sf_dir, "documents"), new_folder(spark, "shards"), 16)
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    out = fingerprints.compare_versions(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.written(F.col("cells")).alias("fingerprint"),
        fingerprints.written(F.col("edited_cells")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import new_folder
    from . import warc

    folder = new_folder(spark, "warc")
    written = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(written, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeats

    out = drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    out = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *base, "kept", "perplexity")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle
    from .common import ascii_lower

    docs = _table(spark, sf_dir, "documents")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(picked, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    out = merkle.manifest(docs, altered={"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_toxicity, op2_line_dedup, op3_bpe, op4_licenses, op5_sharding, op6_fingerprints, op7_warc,
        op8_decontamination, op9_simhash, op10_suffix_dedup, op11_quality, op12_collocations, op13_merkle,
    )
    return {f.__name__: f for f in ops}


def _shingle_sql(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT k, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT {key} AS k,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
         unnest(range(1, greatest(len(w) - 3, 2))) AS t(i)
    WHERE len(w) > 0"""


OP8_SQL = f"""
WITH d AS ({_shingle_sql("documents", "doc_id")}),
     b AS ({_shingle_sql("benchmark", "item_id")}),
     size AS (SELECT k, count(*) AS n FROM b GROUP BY k)
SELECT d.k AS doc_id, b.k AS item_id, CAST(count(*) AS INTEGER) AS shared, CAST(any_value(n) AS INTEGER) AS n_shingles,
       count(*) / any_value(n) AS containment
FROM d JOIN b ON d.s = b.s JOIN size ON size.k = b.k
GROUP BY d.k, b.k
HAVING 5 * count(*) >= 4 * any_value(n)
"""

#: Digest columns that need no archive; what is read back must equal them.
OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM g
"""


def _phrases_sql(size: int) -> str:
    return f"SELECT lang, {size} AS m, array_to_string(w[i : i + {size - 1}], ' ') AS phrase FROM w, unnest(range(1, len(w) - {size - 2})) AS t(i)"


#: Phrases counted one by one, without stripes; a longer phrase is looked up by its text.
OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
     f AS (SELECT lang, m, phrase, count(*) AS f FROM ({" UNION ALL ".join(map(_phrases_sql, (1, 2, 3, 4)))}) GROUP BY ALL HAVING count(*) >= 30),
     c AS (SELECT * FROM f s WHERE m > 1 AND NOT EXISTS (
               SELECT 1 FROM f o WHERE o.lang = s.lang AND o.m > s.m AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
                                   AND CAST(100 AS HUGEINT) * o.f >= CAST(80 AS HUGEINT) * s.f)),
     k AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
                  array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM c, unnest(range(1, m)) AS t(k)),
     s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
           FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = rest),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN size USING (lang) QUALIFY rank <= 2000
"""


def llm_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op8_decontamination": OP8_SQL, "op12_collocations": OP12_SQL}
