"""The same results in SQL, written from the definitions rather than from the Spark code."""

from __future__ import annotations

from checks.derived import (
    CYRILLIC,
    ENTITY_WORDS,
    LATIN,
    LINE_FEATURES,
    LONG_FORM,
    TEXT_FEATURES,
    TOKEN,
)
from checks.queries import CHUNK
from lexigauge.fixed_values import (
    BASIC_BY_WORDS,
    BY_SENTENCES,
    BY_WORDS,
    COMPLEX_WORD_SYLLABLES,
    DEPENDENCY_RELATIONS,
    ENTITY_LABELS,
    FEATURE_COLUMNS,
    N_SENTS,
    N_WORDS,
    POS_TAGS,
    READABILITY,
    READABILITY_METRICS,
    SENTENCE,
    SMOG,
    SUMMED_COUNTS,
    VOWELS,
    WORD,
    WS,
)



def r6(expr: str) -> str:
    """Six places by plain arithmetic, as the queries do it."""
    return f"floor(({expr}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


# --- Cleaning ------------------------------------------------------------------------


def clean(cell: str) -> str:
    strip = rf"regexp_replace(coalesce({cell}, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"
    quotes = rf"""regexp_replace({strip}, '^"+|"+$', '', 'g')"""
    escaped = rf"""replace({quotes}, '\"', '"')"""
    opener = rf"""regexp_replace({escaped}, '[{WS}]*\{{[{WS}]*"[^"]+"[{WS}]*:[{WS}]*', '', 'g')"""
    return rf"regexp_replace({opener}, '[{WS}]*\}}[{WS}]*$', '')"


def valid(cell: str) -> str:
    only = rf"""regexp_matches({cell}, '^[{WS}]*[{{}}\[\]"]+[{WS}]*$')"""
    return f"coalesce({cell} <> '' AND NOT {only}, false)"


BROKEN = """
SELECT event_id,
       CASE WHEN value < 2 THEN '""' ELSE event_type END AS kind,
       CASE WHEN value > 20 THEN ' [{}] '
            WHEN value > 15 AND event_type = 'view' THEN NULL ELSE props END AS props
FROM events"""
JUDGED = f"""
cells AS (SELECT event_id, {clean("kind")} AS kind, {clean("props")} AS props FROM ({BROKEN})),
judged AS (
  SELECT event_id, concat_ws(' ', kind, props) AS text,
         CASE WHEN NOT ({valid("kind")} AND {valid("props")}) THEN 'invalid_cell'
              WHEN NOT {valid("concat_ws(' ', kind, props)")} THEN 'invalid_text' END AS reject_reason
  FROM cells)"""

CLEANING = {
    "clean_text": f"SELECT event_id, {clean('props')} AS cleaned FROM events",
    "valid_text": f"""
        SELECT 'documents' AS origin, doc_id AS id, {valid("text")} AS valid FROM documents
        UNION ALL SELECT 'events', event_id, {valid("props")} FROM ({BROKEN})""",
    "select_concat": f"""
        WITH c AS (SELECT c_custkey, {clean("c_mktsegment")} AS a, {clean("c_name")} AS b,
                          {clean("CAST(c_nationkey AS VARCHAR)")} AS n FROM customer)
        SELECT c_custkey, a || ' ' || b AS text FROM c
        WHERE {valid("a")} AND {valid("b")} AND {valid("n")}""",
    "valid_filter": f"WITH {JUDGED} SELECT event_id, text FROM judged WHERE reject_reason IS NULL",
    "rejected_rows": f"""
        WITH {JUDGED} SELECT event_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL""",
    "clean_summary": f"""
        WITH {JUDGED} SELECT coalesce(reject_reason, 'kept') AS reject_reason, count(*) AS n_rows
        FROM judged GROUP BY 1""",
    "clean_summary_observed": f"""
        WITH {JUDGED} SELECT coalesce(reject_reason, 'kept') AS reject_reason, count(*) AS n_rows
        FROM judged GROUP BY 1""",
    "clean_preview": f"""
        WITH {JUDGED} SELECT event_id, text FROM judged WHERE reject_reason IS NULL
        ORDER BY event_id LIMIT 10""",
    "stream_clean": f"""
        WITH c AS (SELECT event_id, {clean("event_type")} AS a, {clean("props")} AS b FROM events)
        SELECT event_id, CASE WHEN {valid("a")} AND {valid("b")} THEN a || ' ' || b END AS text,
               CASE WHEN NOT ({valid("a")} AND {valid("b")}) THEN 'invalid_cell' END AS reject_reason
        FROM c""",
    "csv_source": f"""
        WITH c AS (SELECT {clean("CAST(doc_id AS VARCHAR)")} AS a, {clean("lang")} AS b,
                          {clean("text")} AS t FROM documents),
        j AS (SELECT a || ' ' || t AS text,
                     CASE WHEN NOT ({valid("a")} AND {valid("b")} AND {valid("t")})
                          THEN 'invalid_cell' END AS reject_reason FROM c)
        SELECT CASE WHEN reject_reason IS NULL THEN text END AS text, reject_reason FROM j""",
    "csv_by_name": f"""
        WITH c AS (SELECT {clean("CAST(doc_id AS VARCHAR)")} AS a, {clean("lang")} AS b,
                          {clean("replace(text, chr(10), ' ')")} AS t FROM documents),
        j AS (SELECT a || ' ' || t AS text,
                     CASE WHEN NOT ({valid("a")} AND {valid("b")} AND {valid("t")})
                          THEN 'invalid_cell' END AS reject_reason FROM c)
        SELECT CASE WHEN reject_reason IS NULL THEN text END AS text, reject_reason FROM j""",
}

# --- Texts ---------------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id, source AS dataset_name, text, lang FROM documents)"
ROUTE = "CASE WHEN lang = 'ru' THEN {ru} ELSE {other} END"


def chars(cls: str, text: str = "text") -> str:
    return f"CAST(length({text}) - length(regexp_replace({text}, '{cls}', '', 'g')) AS BIGINT)"


def text_ctes(docs: str, key: str, name: str = "prof", extra: str = "") -> str:
    """CTEs ending in `name(key, lang, counts...)`, word by word, over a relation of texts.

    `docs` must have the key, lang and text; `extra` names more columns to carry.
    """
    syllables = ROUTE.format(
        ru=f"len(regexp_extract_all(word, '[{VOWELS}]'))",
        other=f"len(regexp_extract_all(word, '[{VOWELS}]+'))",
    )
    syllables = f"greatest(1, {syllables})"
    limit = ROUTE.format(ru=COMPLEX_WORD_SYLLABLES["ru"], other=COMPLEX_WORD_SYLLABLES["other"])
    carry = f", {extra}" if extra else ""
    return rf"""
    {name}_w AS (SELECT {key}, lang, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM {docs}),
    {name}_y AS (SELECT {key}, word, {syllables} AS syl, {limit} AS lim FROM {name}_w),
    {name}_s AS (
      SELECT {key}, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS n_word_chars,
             CAST(sum(syl) AS BIGINT) AS n_syllables,
             count(*) FILTER (syl = 1) AS n_monosyllable_words,
             count(*) FILTER (syl > 1) AS n_polysyllable_words,
             count(*) FILTER (syl >= lim) AS n_complex_words,
             count(*) FILTER (syl < lim) AS n_simple_words,
             count(*) FILTER (length(word) > 6) AS n_long_words,
             count(DISTINCT lower(word)) AS n_unique_words
      FROM {name}_y GROUP BY {key}),
    {name} AS (
      SELECT d.{key}, d.lang{carry}, CAST(length(d.text) AS BIGINT) AS n_chars,
             {chars(r"[\p{L}]", "d.text")} AS n_letters,
             {chars(f"[{WS}]", "d.text")} AS n_spaces,
             {chars(r"[\p{P}]", "d.text")} AS n_punctuations,
             CAST(len(regexp_extract_all(d.text, '{SENTENCE}')) AS BIGINT) AS n_sents,
             {", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in (
                 "n_words", "n_word_chars", "n_syllables", "n_monosyllable_words",
                 "n_polysyllable_words", "n_complex_words", "n_simple_words", "n_long_words",
                 "n_unique_words"))}
      FROM {docs} d LEFT JOIN {name}_s s ON d.{key} = s.{key})"""


def metric(name: str, lang: str = "lang") -> str:
    ratio = {
        "words_per_sent": "n_words / nullif(n_sents, 0)",
        "syllables_per_word": "n_syllables / nullif(n_words, 0)",
        "complex_per_word": "n_complex_words / nullif(n_words, 0)",
        "letters_per_word": "n_letters / nullif(n_words, 0)",
        "sents_per_word": "n_sents / nullif(n_words, 0)",
        "long_per_word": "n_long_words / nullif(n_words, 0)",
    }

    def formula(kind: str) -> str:
        if name == "smog_index":
            k = SMOG[kind]
            per_sent = "n_complex_words / nullif(n_sents, 0)"
            value = f"{k['factor']}::DOUBLE * sqrt({k['scale']}::DOUBLE * ({per_sent})) + {k['base']}::DOUBLE"
            return f"CASE WHEN n_sents < 3 THEN 0.0::DOUBLE ELSE {value} END"
        k = READABILITY[name][kind]
        terms = [f"({v}::DOUBLE) * ({ratio[t]})" for t, v in k.items() if t != "base"]
        return " + ".join([f"({k['base']}::DOUBLE)", *terms])

    return f"CASE WHEN {lang} = 'ru' THEN {formula('ru')} ELSE {formula('other')} END"


def metrics(lang: str = "lang") -> str:
    return ", ".join(f"{r6(metric(m, lang))} AS {m}" for m in READABILITY_METRICS)


WORD_LENGTH = "coalesce(n_word_chars / nullif(n_words, 0), 0.0::DOUBLE)"


def pair_ctes(docs: str, key: str) -> str:
    """`pairs(key, sim)`: the similarity of every pair of neighbouring sentences."""
    count = "length({t}) - length(replace({t}, c, ''))"
    shared = f"""list_sum(list_transform(list_distinct(string_split(a, '')),
        lambda c: least({count.format(t="a")}, {count.format(t="b")})))"""
    return f"""
    sent_lists AS (SELECT {key}, regexp_extract_all(text, '{SENTENCE}') AS sents FROM {docs}),
    sent_pos AS (SELECT {key}, sents, unnest(range(1, len(sents))) AS i FROM sent_lists),
    sent_pairs AS (SELECT {key}, sents[i] AS a, sents[i + 1] AS b FROM sent_pos),
    pairs AS (SELECT {key}, {shared} / sqrt(length(a)::DOUBLE * length(b)) AS sim FROM sent_pairs)"""


COUNTS = [
    "n_chars", "n_words", "n_sents", "n_word_chars", "n_letters", "n_spaces", "n_punctuations",
    "n_syllables", "n_monosyllable_words", "n_polysyllable_words", "n_complex_words",
    "n_simple_words", "n_long_words",
]

# Per dataset: summed counts, distinct words, and the mean over all pairs of its documents.
BY_DATASET = f"""
{DOCS}, {text_ctes("docs", "doc_id", extra="d.dataset_name")},
sums AS (SELECT dataset_name, 'other' AS lang, count(*) AS n_docs,
                {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)}
         FROM prof GROUP BY dataset_name),
vocabulary AS (
  SELECT dataset_name, count(DISTINCT lower(word)) AS n_unique_words
  FROM prof_w JOIN docs USING (doc_id) GROUP BY dataset_name),
by_dataset AS (SELECT s.*, coalesce(v.n_unique_words, 0) AS n_unique_words
               FROM sums s LEFT JOIN vocabulary v USING (dataset_name))"""
DATASET_PAIRS = f"""
{pair_ctes("docs", "doc_id")},
by_dataset_pairs AS (
  SELECT d.dataset_name, count(p.sim) AS n_pairs, avg(p.sim) AS avg_similarity
  FROM docs d LEFT JOIN pairs p USING (doc_id) GROUP BY d.dataset_name)"""

# Period pieces: cut after the last period of each window, step by step.
PIECES = f"""
steps(doc_id, part, piece, rest) AS (
  SELECT doc_id, 0, '', text FROM documents
  UNION ALL
  SELECT doc_id, part + 1, left(rest, cut), substr(rest, cut + 1)
  FROM (SELECT doc_id, part, rest,
               CASE WHEN instr(reverse(w), '.') > 0 AND length(w) - instr(reverse(w), '.') > 0
                    THEN length(w) - instr(reverse(w), '.') + 1 ELSE length(w) END AS cut
        FROM (SELECT doc_id, part, rest, left(rest, {CHUNK}) AS w FROM steps WHERE rest <> ''))),
pieces AS (SELECT doc_id, part AS i, piece FROM steps WHERE part > 0)"""
SENTENCE_PIECES = """
lists AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+') AS l FROM documents),
pieces AS (SELECT doc_id, i, l[i] AS piece
           FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists))"""
# Packing: walk the pieces, opening a chunk when the running length would pass the limit.
PACKED = f"""
walk(doc_id, i, part_id, used) AS (
  SELECT doc_id, i, 0, length(piece) FROM pieces WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i,
         CASE WHEN w.used + length(p.piece) > {CHUNK} THEN w.part_id + 1 ELSE w.part_id END,
         CASE WHEN w.used + length(p.piece) > {CHUNK} THEN length(p.piece)
              ELSE w.used + length(p.piece) END
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
chunks AS (
  SELECT doc_id, 0 AS part_id, text FROM documents WHERE length(text) <= {CHUNK}
  UNION ALL
  SELECT w.doc_id, w.part_id, string_agg(p.piece, ' ' ORDER BY p.i)
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.i = w.i
  JOIN documents d ON d.doc_id = w.doc_id
  WHERE length(d.text) > {CHUNK} GROUP BY w.doc_id, w.part_id)"""

GRAMS = """
list_concat(list_concat(string_split(word, ''),
  list_transform(range(1, length(word) + 2), lambda k: substr(' ' || word || ' ', CAST(k AS INT), 2))),
  list_transform(range(1, length(word) + 1), lambda k: substr(' ' || word || ' ', CAST(k AS INT), 3)))"""
def lang_profile(docs: str = "documents") -> str:
    return rf"""
lw AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM {docs}),
lv AS (SELECT lang, word, count(*) AS n FROM lw GROUP BY ALL),
lg AS (SELECT lang, n, unnest({GRAMS}) AS gram FROM lv),
lc AS (SELECT lang, gram, sum(n) AS n FROM lg GROUP BY ALL),
lt AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM lc) AS total FROM lc GROUP BY lang),
profile AS (
  SELECT lang, gram, CAST(round(1000 * ln((n + 1) / total)) AS BIGINT) AS weight FROM lc JOIN lt USING (lang)
  UNION ALL SELECT lang, '', CAST(round(1000 * ln(1 / total)) AS BIGINT) FROM lt)"""


DETECTED = f"""
        dv AS (SELECT doc_id, word, count(*) AS n FROM lw GROUP BY ALL),
        dg AS (SELECT doc_id, n, unnest({GRAMS}) AS gram FROM dv),
        known AS (SELECT DISTINCT gram FROM lc),
        one AS (SELECT doc_id FROM dg JOIN known USING (gram) GROUP BY doc_id),
        score AS (SELECT doc_id, u.lang, sum(n * coalesce(p.weight, u.weight)) AS score
                  FROM dg JOIN one USING (doc_id) JOIN profile u ON u.gram = ''
                  LEFT JOIN profile p ON p.gram = dg.gram AND p.lang = u.lang GROUP BY ALL),
        best AS (SELECT doc_id, lang FROM score
                 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""

TEXTS = {
    "lang_profile": f"WITH {lang_profile()} SELECT lang, gram, weight FROM profile",
    "lang_detect": f"""
        WITH {lang_profile()}, {DETECTED}
        SELECT d.doc_id, b.lang AS detected_lang,
               CASE WHEN b.lang = 'ru' THEN 'ru' WHEN b.lang IS NOT NULL THEN 'en' END AS analysis_lang
        FROM documents d LEFT JOIN best b USING (doc_id)""",
    "profile_detected": f"""
        WITH made AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN translate(text, '{LATIN}', '{CYRILLIC}') ELSE text END AS text,
                             CASE WHEN doc_id % 5 = 0 THEN 'ru' ELSE lang END AS lang FROM documents),
        {lang_profile("made")}, {DETECTED},
        docs AS (SELECT m.doc_id, m.text, b.lang AS detected_lang,
                        CASE WHEN b.lang = 'ru' THEN 'ru' WHEN b.lang IS NOT NULL THEN 'en' END AS lang
                 FROM made m LEFT JOIN best b USING (doc_id)),
        {text_ctes("docs", "doc_id", extra="detected_lang")}
        SELECT doc_id, detected_lang, lang AS analysis_lang, {", ".join(SUMMED_COUNTS)}, n_unique_words,
               round({WORD_LENGTH}, 6) AS avg_word_length, {metrics()} FROM prof""",
    "chunks": f"""
        WITH RECURSIVE {PIECES}, {PACKED} SELECT doc_id, part_id, text FROM chunks""",
    "sentence_chunks": f"""
        WITH RECURSIVE {SENTENCE_PIECES}, {PACKED} SELECT doc_id, part_id, text FROM chunks""",
    "sentence_split": f"""
        WITH l AS (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS s FROM documents)
        SELECT doc_id, CAST(i - 1 AS INT) AS sent_id, s[i] AS sentence
        FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM l)""",
    "word_tokens": f"""
        WITH l AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS s FROM documents)
        SELECT doc_id, CAST(i - 1 AS INT) AS word_id, s[i] AS word
        FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM l)""",
    "doc_basic_stats": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id")}
        SELECT doc_id, n_chars, n_words, n_sents, round({WORD_LENGTH}, 6) AS avg_word_length FROM prof""",
    "dataset_basic_stats": f"""
        WITH {BY_DATASET}
        SELECT dataset_name, n_docs, n_chars, n_words, n_sents,
               round({WORD_LENGTH}, 6) AS avg_word_length FROM by_dataset""",
    "unique_words": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id")} SELECT doc_id, n_unique_words FROM prof""",
    "unique_words_sketch": f"""
        WITH w AS (SELECT source AS dataset_name, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents)
        SELECT dataset_name, count(DISTINCT word) AS n_unique_words, true AS within_error, true AS merge_equals_whole
        FROM w GROUP BY dataset_name""",
    "unique_words_dataset": f"""
        WITH {BY_DATASET} SELECT dataset_name, n_unique_words FROM by_dataset""",
    "char_classes": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id")}
        SELECT doc_id, n_letters, n_spaces, n_punctuations FROM prof""",
    "syllable_stats": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id")}
        SELECT doc_id, n_syllables, n_monosyllable_words, n_polysyllable_words, n_complex_words,
               n_simple_words FROM prof""",
    "long_words": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id")} SELECT doc_id, n_long_words FROM prof""",
    "readability_doc": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id")} SELECT doc_id, {metrics()} FROM prof""",
    "readability_dataset": f"""
        WITH {BY_DATASET} SELECT dataset_name, {metrics()} FROM by_dataset""",
    "readability_chunked": f"""
        WITH RECURSIVE {PIECES}, {PACKED},
        parts AS (SELECT doc_id || '-' || part_id AS part, doc_id, lang, c.text
                  FROM chunks c JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
        {text_ctes("parts", "part", extra="d.doc_id")}
        SELECT doc_id, count(*) AS n_parts,
               {", ".join(f"{r6(f'avg({metric(m)})')} AS {m}" for m in READABILITY_METRICS)}
        FROM prof GROUP BY doc_id""",
    "homogeneity": f"""
        WITH {DOCS}, {pair_ctes("docs", "doc_id")}
        SELECT d.doc_id, count(p.sim) AS n_pairs, round(avg(p.sim), 6) AS avg_similarity
        FROM docs d LEFT JOIN pairs p USING (doc_id) GROUP BY d.doc_id""",
    "homogeneity_dataset": f"""
        WITH {DOCS}, {DATASET_PAIRS}
        SELECT dataset_name, n_pairs, round(avg_similarity, 6) AS avg_similarity FROM by_dataset_pairs""",
    "append_union": f"""
        WITH {BY_DATASET}, {DATASET_PAIRS},
        talks AS (SELECT turn AS t, 'other' AS lang, text FROM conversations)
        SELECT dataset_name, n_words, n_sents, round(avg_similarity, 6) AS avg_similarity
        FROM by_dataset JOIN by_dataset_pairs USING (dataset_name)
        UNION ALL
        SELECT 'unnamed_dataset', CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT),
               CAST(sum(len(regexp_extract_all(text, '{SENTENCE}'))) AS BIGINT), NULL FROM talks""",
    "append_union_csv": f"""
        WITH {BY_DATASET}, {DATASET_PAIRS},
        talks AS (SELECT turn AS t, 'other' AS lang, text FROM conversations)
        SELECT dataset_name, n_words, n_sents, round(avg_similarity, 6) AS avg_similarity
        FROM by_dataset JOIN by_dataset_pairs USING (dataset_name)
        UNION ALL
        SELECT 'unnamed_dataset', CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT),
               CAST(sum(len(regexp_extract_all(text, '{SENTENCE}'))) AS BIGINT), NULL FROM talks""",
    "reference_user_read": f"""
        WITH t AS (SELECT 'reference' AS role, text FROM documents
                   UNION ALL SELECT 'user', text FROM benchmark),
        w AS (SELECT role, regexp_extract_all(text, '{WORD}') AS l FROM t)
        SELECT role, count(*) AS n_rows,
               round(avg(coalesce(length(array_to_string(l, '')) / nullif(len(l), 0), 0)), 6)
                 AS avg_word_length
        FROM w GROUP BY role""",
}

# --- Annotations ---------------------------------------------------------------------

_ENTITY = "CASE {c} " + " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in ENTITY_WORDS.items()) + " END"
TOKENS = rf"""
ts AS (SELECT doc_id, source AS dataset_name, regexp_extract_all(text, '{SENTENCE}') AS s FROM documents),
tp AS (SELECT doc_id, dataset_name, s, unnest(range(1, len(s) + 1)) AS si FROM ts),
tl AS (SELECT doc_id, dataset_name, si, regexp_extract_all(s[si], '{TOKEN}') AS f FROM tp),
tf AS (SELECT doc_id, dataset_name, si, f[k] AS form, k
       FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM tl)),
tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY si, k) - 1 AS tok_id,
              {_ENTITY.format(c="form")} AS ent,
              {_ENTITY.format(c="lag(form) OVER (PARTITION BY doc_id, si ORDER BY k)")} AS ent_before
       FROM tf),
tokens AS (
  SELECT doc_id, dataset_name, si - 1 AS sent_id, tok_id, form, tok_id - (k - 1) AS head,
         CASE WHEN regexp_full_match(form, '\p{{N}}+') THEN 'NUM'
              WHEN regexp_full_match(form, '{WORD}') THEN 'X'
              WHEN regexp_full_match(form, '\p{{P}}') THEN 'PUNCT' ELSE 'SYM' END AS upos,
         CASE WHEN k = 1 THEN 'ROOT' WHEN NOT regexp_full_match(form, '{WORD}') THEN 'punct'
              WHEN length(form) >= {LONG_FORM} THEN 'acl:relcl' ELSE 'dep' END AS deprel,
         ent AS ent_type,
         CASE WHEN ent IS NULL THEN 'O' WHEN ent = ent_before THEN 'I' ELSE 'B' END AS ent_iob
  FROM tn)"""


def arc_cte(key: str) -> str:
    keys = "doc_id" if key == "doc_id" else f"{key}, doc_id"
    return f"""
    sentence_arcs AS (SELECT {keys}, sent_id, count(*) AS size, max(abs(tok_id - head)) AS arc
                      FROM tokens GROUP BY {keys}, sent_id),
    arcs AS (SELECT {key}, coalesce(avg(arc) FILTER (size > 1), 0) AS avg_arc
             FROM sentence_arcs GROUP BY {key})"""


ANNOTATIONS = {
    "pos_counts": f"WITH {TOKENS} SELECT doc_id, upos, count(*) AS n FROM tokens GROUP BY ALL",
    "entity_counts": f"""
        WITH {TOKENS} SELECT dataset_name, ent_type, count(*) AS n FROM tokens
        WHERE ent_iob = 'B' GROUP BY ALL""",
    "dep_counts": f"WITH {TOKENS} SELECT dataset_name, deprel, count(*) AS n FROM tokens GROUP BY ALL",
    "max_arc": f"""
        WITH {TOKENS}, {arc_cte("doc_id")}
        SELECT doc_id, round(avg_arc, 6) AS avg_max_arc_length FROM arcs""",
    "full_profile": f"""
        WITH {DOCS}, {text_ctes("docs", "doc_id", extra="d.dataset_name")}, {pair_ctes("docs", "doc_id")},
        {TOKENS}, {arc_cte("doc_id")},
        sims AS (SELECT doc_id, avg(sim) AS sim FROM pairs GROUP BY doc_id),
        tags AS (SELECT doc_id, count(*) FILTER (upos = 'X') AS pos_x,
                        count(*) FILTER (ent_iob = 'B' AND ent_type = 'PER') AS ner_per,
                        count(*) FILTER (deprel = 'ROOT') AS dep_root FROM tokens GROUP BY doc_id)
        SELECT p.doc_id, p.dataset_name, n_sents, n_words, round({WORD_LENGTH}, 6) AS avg_word_length,
               {", ".join(BASIC_BY_WORDS)}, {metrics()},
               coalesce(pos_x, 0) AS pos_x, coalesce(ner_per, 0) AS ner_per,
               coalesce(dep_root, 0) AS dep_root,
               round(coalesce(avg_arc, 0), 6) AS avg_max_arc_length, round(sim, 6) AS avg_similarity
        FROM prof p LEFT JOIN sims USING (doc_id) LEFT JOIN tags USING (doc_id)
        LEFT JOIN arcs USING (doc_id)""",
}

# --- Feature rows --------------------------------------------------------------------


def _q(name: str) -> str:
    return f'"{name}"'


def dataset_sql(columns: list[str]) -> str:
    tags = [
        *[(f"pos_{t}", f"upos = '{t}'") for t in POS_TAGS],
        *[(f"ner_{e}", f"ent_iob = 'B' AND ent_type = '{e}'") for e in ENTITY_LABELS],
        *[(f"dep_{r}", f"deprel = '{r}'") for r in DEPENDENCY_RELATIONS],
    ]
    counts = ", ".join(f"count(*) FILTER ({cond}) AS {_q(name)}" for name, cond in tags)
    return f"""
    WITH {BY_DATASET}, {DATASET_PAIRS}, {TOKENS}, {arc_cte("dataset_name")},
    tags AS (SELECT dataset_name, {counts} FROM tokens GROUP BY dataset_name),
    everything AS (SELECT * FROM by_dataset JOIN by_dataset_pairs USING (dataset_name)
                   LEFT JOIN tags USING (dataset_name) LEFT JOIN arcs USING (dataset_name))
    SELECT dataset_name, {", ".join(columns)} FROM everything"""


def _value(column: str) -> str:
    """SQL for one column of the 86-column row."""
    if column.startswith("dependency_"):
        return f"coalesce({_q('dep_' + column.removeprefix('dependency_'))}, 0)"
    if column.startswith("pos_ner_analysis_"):
        return f"coalesce({_q(column.removeprefix('pos_ner_analysis_'))}, 0)"
    if column.startswith("basic_statistics_"):
        return column.removeprefix("basic_statistics_")
    if column.startswith("readability_statistics_"):
        return f"coalesce({metric(column.removeprefix('readability_statistics_'))}, 0)"
    return {
        "syntactic_analysis_avg_tree_depth": "coalesce(avg_arc, 0)",
        "text_homogeneity_avg_similarity": "coalesce(avg_similarity, 0)",
    }.get(column, "0::DOUBLE")


def template_sql(by_sents: bool, by_words: bool) -> str:
    out = []
    for column in FEATURE_COLUMNS:
        value = _value(column)
        if by_sents and column in BY_SENTENCES:
            value = f"round({value} / nullif({_value(N_SENTS)}, 0), 6)"
        elif by_words and column in BY_WORDS:
            value = f"round({value} / nullif({_value(N_WORDS)}, 0), 6)"
        elif column.startswith(("readability", "syntactic", "text_homogeneity")):
            value = r6(value)
        out.append(f"{value} AS {_q(column)}")
    return dataset_sql(out)


_FLAT = [
    *[f"{c} AS basic_statistics_{c}" for c in ["n_sents", "n_words", *BASIC_BY_WORDS]],
    f"round({WORD_LENGTH}, 6) AS basic_statistics_avg_word_length",
    *[f"{r6(metric(m))} AS readability_statistics_{m}" for m in READABILITY_METRICS],
    *[f"nullif({_q('pos_' + t)}, 0) AS {_q('pos_ner_analysis_pos_' + t)}" for t in POS_TAGS],
    *[f"nullif({_q('ner_' + e)}, 0) AS {_q('pos_ner_analysis_ner_' + e)}" for e in ENTITY_LABELS],
    *[
        f"nullif({_q('dep_' + r)}, 0) AS {_q('syntactic_analysis_dependency_stats_' + r)}"
        for r in DEPENDENCY_RELATIONS
    ],
    "round(avg_arc, 6) AS syntactic_analysis_avg_max_arc_length",
    "round(avg_arc, 6) AS syntactic_analysis_avg_tree_depth",
    "round(avg_similarity, 6) AS text_homogeneity_avg_similarity",
]
FEATURES = {
    "flatten_features": dataset_sql(_FLAT),
    "template_view": template_sql(False, False),
    "norm_by_sents": template_sql(True, False),
    "norm_by_words": template_sql(False, True),
    "normalized_write": template_sql(True, True),
}

# --- Comparison ----------------------------------------------------------------------

Q, E = LINE_FEATURES


def _z(expr: str, feature: str, fit: str = "fit") -> str:
    return f"({expr} - {fit}.m_{feature}) / {fit}.s_{feature}"


def fit_cte(source: str, features: list[str], name: str = "fit") -> str:
    cols = ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN max({f}) > min({f}) THEN stddev_pop({f}) ELSE 1 END AS s_{f}"
        for f in features
    )
    return f"{name} AS (SELECT {cols} FROM {source})"


def scaled_cte(source: str, columns: str, features: list[str], name: str = "scaled") -> str:
    cols = ", ".join(f"{_z('t.' + f, f)} AS {f}" for f in features)
    return f"{name} AS (SELECT {columns}, {cols} FROM {source} t, fit)"


LINES = f"""
{fit_cte("lineitem", LINE_FEATURES)},
{scaled_cte("lineitem", "l_returnflag AS grp, l_linestatus AS name", LINE_FEATURES)},
u AS (SELECT count(*) AS n_rows, avg({Q}) AS q, avg({E}) AS e, stddev_samp({Q}) AS sq,
             stddev_samp({E}) AS se FROM scaled WHERE name = 'O'),
g AS (SELECT grp, count(*) AS n_rows, avg({Q}) AS q, avg({E}) AS e, stddev_samp({Q}) AS sq,
             stddev_samp({E}) AS se, covar_samp({Q}, {Q}) AS cqq, covar_samp({Q}, {E}) AS cqe,
             covar_samp({E}, {E}) AS cee FROM scaled GROUP BY grp)"""
# The inverse of a symmetric 2 x 2 matrix in closed form.
DISTANCES = f"""
{LINES},
d AS (SELECT grp, sqrt((g.cee * (u.q - g.q) ** 2 - 2 * g.cqe * (u.q - g.q) * (u.e - g.e)
                        + g.cqq * (u.e - g.e) ** 2) / (g.cqq * g.cee - g.cqe ** 2)) AS distance,
             sqrt((u.q - g.q) ** 2 + (u.e - g.e) ** 2) AS straight FROM g, u)"""
DIFFS = f"""
{LINES},
long AS (SELECT grp, 0 AS pos, '{Q}' AS feature, u.q AS uv, g.q AS gm, g.sq AS gs FROM g, u
         UNION ALL SELECT grp, 1, '{E}', u.e, g.e, g.se FROM g, u),
diffs AS (SELECT grp, pos, feature, uv AS user_value, gm AS group_mean,
                 (uv - gm) / (gs + 1e-10) AS z_score,
                 abs((uv - gm) / (gs + 1e-10)) * gs AS contribution FROM long)"""
DIFF_COLUMNS = """grp, pos, feature, round(user_value, 6) AS user_value,
    round(group_mean, 6) AS group_mean, round(z_score, 6) AS z_score,
    round(contribution, 6) AS contribution"""

_FEATURE_SQL = {
    "avg_word_length": WORD_LENGTH,
    "automated_readability_index": metric("automated_readability_index"),
    "coleman_liau_index": metric("coleman_liau_index"),
}
_SELECTED = ", ".join(f"{_FEATURE_SQL[f]} AS {f}" for f in TEXT_FEATURES)
A, B, C3 = TEXT_FEATURES


def text_comparison(groups: str, join: str, user: str, where: str) -> str:
    """Scaled master `sm(grp, features)`, user vector `u` and group moments `g`."""
    stats = ", ".join(
        f"avg({f}) AS {f}, stddev_samp({f}) AS sd_{f}" for f in TEXT_FEATURES
    )
    pairs = [(A, A, "aa"), (A, B, "ab"), (A, C3, "ac"), (B, B, "bb"), (B, C3, "bc"), (C3, C3, "cc")]
    covs = ", ".join(f"covar_samp({x}, {y}) AS {n}" for x, y, n in pairs)
    return f"""
    {DOCS}, {text_ctes("docs", "doc_id")},
    master AS (SELECT {groups} AS grp, {_SELECTED} FROM prof {join}),
    {fit_cte("master", TEXT_FEATURES)},
    {scaled_cte("master", "grp", TEXT_FEATURES, "sm")},
    ud AS ({user}), {text_ctes("ud", "id", "uprof", "d.dataset_name")},
    uraw AS (SELECT dataset_name, {_SELECTED} FROM uprof),
    su AS (SELECT dataset_name, {", ".join(_z("t." + f, f) + f" AS {f}" for f in TEXT_FEATURES)}
           FROM uraw t, fit WHERE {where}),
    u AS (SELECT {stats} FROM su),
    g AS (SELECT CAST(grp AS VARCHAR) AS grp, {stats}, {covs} FROM sm GROUP BY 1),
    q AS (SELECT grp, u.{A} - g.{A} AS x, u.{B} - g.{B} AS y, u.{C3} - g.{C3} AS z,
                 aa, ab, ac, bb, bc, cc,
                 aa * (bb * cc - bc * bc) - ab * (ab * cc - ac * bc) + ac * (ab * bc - ac * bb) AS det
          FROM g, u),
    dist AS (SELECT grp, sqrt(((bb * cc - bc * bc) * x * x + (aa * cc - ac * ac) * y * y
                               + (aa * bb - ab * ab) * z * z + 2 * (ac * bc - ab * cc) * x * y
                               + 2 * (ab * bc - ac * bb) * x * z
                               + 2 * (ab * ac - aa * bc) * y * z) / det) AS distance FROM q),
    scores AS (SELECT grp, distance, 'mahalanobis' AS method_used, exp(-distance) AS similarity,
                      CAST(row_number() OVER (ORDER BY exp(-distance) DESC, grp) AS INT) AS rank
               FROM dist)"""


_TALKS = """SELECT conv_id || '-' || turn || '-' || row_number() OVER () AS id, role AS dataset_name,
            'other' AS lang, text FROM conversations"""
_ITEMS = "SELECT item_id AS id, 'benchmark' AS dataset_name, 'other' AS lang, text FROM benchmark"
BY_LANG = text_comparison("lang", "", _TALKS, "dataset_name = 'assistant'")
BY_QUALITY = text_comparison("quality", "JOIN labels USING (doc_id)", _ITEMS, "true")
LANG_DIFFS = "ldiff AS (" + " UNION ALL ".join(
    f"""SELECT grp, {i} AS pos, '{f}' AS feature, u.{f} AS user_value, g.{f} AS group_mean,
        (u.{f} - g.{f}) / (g.sd_{f} + 1e-10) AS z_score,
        abs((u.{f} - g.{f}) / (g.sd_{f} + 1e-10)) * g.sd_{f} AS contribution FROM g, u"""
    for i, f in enumerate(TEXT_FEATURES)
) + ")"
OVERALL = (
    f"""{BY_LANG}, m AS (SELECT {", ".join(
        f"avg({f}) AS {f}, stddev_samp({f}) AS sd_{f}" for f in TEXT_FEATURES)} FROM sm),
    cmp AS ("""
    + " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{f}' AS feature, m.{f} AS master_mean, m.sd_{f} AS master_std,
            u.{f} AS user_value, u.sd_{f} AS user_std,
            (u.{f} - m.{f}) / (m.sd_{f} + 1e-10) AS z_score FROM m, u"""
        for i, f in enumerate(TEXT_FEATURES)
    )
    + ")"
)
COMPARED = """feature, round(user_value, 6) AS user_value, round(z_score, 6) AS z_score,
    round(1 / (1 + abs(z_score)), 6) AS similarity"""
SCORES = """grp, round(distance, 6) AS distance, method_used, round(similarity, 6) AS similarity, rank"""

COMPARISON = {
    "zscore_fit": f"""
        WITH {fit_cte("lineitem", LINE_FEATURES)}
        SELECT '{Q}' AS feature, round(m_{Q}, 6) AS mean, round(s_{Q}, 6) AS scale FROM fit
        UNION ALL SELECT '{E}', round(m_{E}, 6), round(s_{E}, 6) FROM fit""",
    "zscore_apply": f"""
        WITH {fit_cte("customer", ["c_acctbal"])}
        SELECT c_custkey, round({_z("c_acctbal", "c_acctbal")}, 6) AS c_acctbal FROM customer, fit""",
    "user_vector": f"""
        WITH {LINES}
        SELECT n_rows, '{Q}' AS feature, round(q, 6) AS mean, round(sq, 6) AS std FROM u
        UNION ALL SELECT n_rows, '{E}', round(e, 6), round(se, 6) FROM u""",
    "user_vector_all": f"""
        WITH {fit_cte("lineitem", LINE_FEATURES)},
        v AS (SELECT count(*) AS n_rows, avg(p_size) AS q, avg(p_retailprice) AS e FROM part)
        SELECT n_rows, '{Q}' AS feature, round({_z("q", Q)}, 6) AS mean, 0.0::DOUBLE AS std FROM v, fit
        UNION ALL SELECT n_rows, '{E}', round({_z("e", E)}, 6), 0.0::DOUBLE FROM v, fit""",
    "group_moments": f"""
        WITH {LINES}
        SELECT grp, n_rows, '{Q}' AS feature, round(q, 6) AS mean, round(sq, 6) AS std,
               round(cqq, 6) AS cov_{Q}, round(cqe, 6) AS cov_{E} FROM g
        UNION ALL SELECT grp, n_rows, '{E}', round(e, 6), round(se, 6), round(cqe, 6), round(cee, 6) FROM g""",
    "group_cov_wide": """
        WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS grp, unnest(range(1, len(embedding) + 1)) AS i,
                          unnest(embedding)::DOUBLE AS x FROM embeddings),
        f AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY i),
        z AS (SELECT vec_id, grp, v.i, (x - m) / s AS x FROM v JOIN f ON v.i = f.i)
        SELECT a.grp, CAST(a.i - 1 AS INT) AS i, CAST(b.i - 1 AS INT) AS j,
               round(covar_samp(a.x, b.x), 6) AS cov
        FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.grp = b.grp GROUP BY ALL""",
    "mahalanobis": f"""
        WITH {DISTANCES} SELECT grp, round(distance, 6) AS distance, 'mahalanobis' AS method_used FROM d""",
    "euclidean": f"""
        WITH {DISTANCES} SELECT grp, round(straight, 6) AS distance, 'euclidean' AS method_used FROM d""",
    "group_rank": f"""
        WITH {DISTANCES}
        SELECT grp, round(distance, 6) AS distance, 'mahalanobis' AS method_used,
               round(exp(-distance), 6) AS similarity,
               CAST(row_number() OVER (ORDER BY exp(-distance) DESC, grp) AS INT) AS rank FROM d""",
    "compare_all_datasets": f"""
        WITH {fit_cte("lineitem", LINE_FEATURES)},
        {scaled_cte("lineitem", "CAST(l_linenumber AS VARCHAR) AS grp, l_suppkey AS name", LINE_FEATURES)},
        u AS (SELECT CAST(name AS VARCHAR) AS dataset_name, avg({Q}) AS q, avg({E}) AS e FROM scaled WHERE name IS NOT NULL GROUP BY name),
        g AS (SELECT grp, avg({Q}) AS q, avg({E}) AS e, stddev_samp({Q}) AS sq, stddev_samp({E}) AS se, covar_samp({Q}, {Q}) AS cqq,
                     covar_samp({Q}, {E}) AS cqe, covar_samp({E}, {E}) AS cee FROM scaled WHERE grp IS NOT NULL GROUP BY grp),
        d AS (SELECT dataset_name, grp, u.q AS uq, g.q AS gq, u.e AS ue, g.e AS ge, sq, se,
                     sqrt((g.cee * (u.q - g.q) ** 2 - 2 * g.cqe * (u.q - g.q) * (u.e - g.e)
                           + g.cqq * (u.e - g.e) ** 2) / (g.cqq * g.cee - g.cqe ** 2)) AS distance FROM u, g),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_name ORDER BY exp(-distance) DESC, grp) AS INT) AS rank FROM d),
        x AS (SELECT *, (uq - gq) / (sq + 1e-10) AS zq, (ue - ge) / (se + 1e-10) AS ze FROM r WHERE rank <= 3),
        y AS (SELECT *, abs(ze) * se > abs(zq) * sq AS second FROM x)
        SELECT dataset_name, grp, round(distance, 6) AS distance, 'mahalanobis' AS method_used, round(exp(-distance), 6) AS similarity, rank,
               CASE WHEN second THEN 1 ELSE 0 END AS feature_pos, CASE WHEN second THEN '{E}' ELSE '{Q}' END AS feature,
               round(CASE WHEN second THEN ue ELSE uq END, 6) AS user_value, round(CASE WHEN second THEN ge ELSE gq END, 6) AS group_mean,
               round(CASE WHEN second THEN ze ELSE zq END, 6) AS z_score,
               round(CASE WHEN second THEN abs(ze) * se ELSE abs(zq) * sq END, 6) AS contribution FROM y""",
    "feature_diffs": f"WITH {DIFFS} SELECT {DIFF_COLUMNS} FROM diffs",
    "key_differences": f"""
        WITH {DIFFS}, r AS (SELECT *, CAST(row_number() OVER (
            PARTITION BY grp ORDER BY contribution DESC, pos) AS INT) AS rank FROM diffs)
        SELECT {DIFF_COLUMNS}, rank FROM r WHERE rank <= 1""",
    "compare_groups": f"""
        WITH {BY_LANG}, {LANG_DIFFS}
        SELECT {SCORES}, feature, round(user_value, 6) AS user_value,
               round(group_mean, 6) AS group_mean, round(z_score, 6) AS z_score,
               round(contribution, 6) AS contribution
        FROM scores JOIN ldiff USING (grp)""",
    "compare_quality": f"WITH {BY_QUALITY} SELECT {SCORES} FROM scores",
    "overall_stats": f"""
        WITH {OVERALL}
        SELECT pos, feature, abs(round(master_mean, 6)) AS master_mean, round(master_std, 6) AS master_std,
               round(user_value, 6) AS user_value, round(user_std, 6) AS user_std FROM cmp""",
    "feature_comparison": f"WITH {OVERALL} SELECT {COMPARED} FROM cmp",
    "divergent_features": f"""
        WITH {OVERALL} SELECT {COMPARED} FROM cmp ORDER BY abs(z_score) DESC, pos LIMIT 2""",
    "report_group": f"""
        WITH {BY_LANG}, {LANG_DIFFS},
        kd AS (SELECT l.*, row_number() OVER (ORDER BY contribution DESC, pos) AS r
               FROM ldiff l JOIN scores s ON l.grp = s.grp WHERE s.rank = 1),
        lines AS (
          SELECT 0 AS section, 0 AS p, 'Top Statistical Matches' AS text
          UNION ALL SELECT 1, rank, format('{{}}: {{:.1f}}%', grp, similarity * 100) FROM scores
          UNION ALL SELECT 2, 0, 'Key Differences vs ' || grp FROM scores WHERE rank = 1
          UNION ALL SELECT 3, r, format('{{}}: User={{:.2f}}, Group={{:.2f}} (Z={{:.2f}})',
                                        feature, user_value, group_mean, z_score) FROM kd WHERE r <= 3)
        SELECT CAST(row_number() OVER (ORDER BY section, p) AS INT) AS line_no, text FROM lines""",
    "report_overall": f"""
        WITH {OVERALL},
        top AS (SELECT *, row_number() OVER (ORDER BY abs(z_score) DESC, pos) AS r FROM cmp),
        lines AS (
          SELECT 0 AS section, 0 AS p, 'Overall Statistical Comparison' AS text
          UNION ALL SELECT 1, 0, 'Master Data Means: ' ||
            string_agg(format('{{}}={{:.2f}}', feature, abs(master_mean)), ', ' ORDER BY pos) FROM cmp
          UNION ALL SELECT 2, 0, 'User Data Means: ' ||
            string_agg(format('{{}}={{:.2f}}', feature, user_value), ', ' ORDER BY pos) FROM cmp
          UNION ALL SELECT 3, 0, 'Most Divergent Features'
          UNION ALL SELECT 4, r,
            format('{{}}: User={{:.2f}} vs Master={{:.2f}}±{{:.2f}} (Z={{:.2f}}, Similarity={{:.1f}}%)',
                   feature, user_value, abs(master_mean), master_std, z_score,
                   100 / (1 + abs(z_score))) FROM top WHERE r <= 2)
        SELECT CAST(row_number() OVER (ORDER BY section, p) AS INT) AS line_no, text FROM lines""",
}


def all_sql() -> dict[str, str]:
    return {**CLEANING, **TEXTS, **ANNOTATIONS, **FEATURES, **COMPARISON}
