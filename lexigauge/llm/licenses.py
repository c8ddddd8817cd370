"""License scan by ordered signature rules.

A text is reduced to its words (A-Z lower-cased, cut at every other ASCII character), and the rules
are regular expressions over words. A rule is tried only on texts that hold its keyword and every
word that all its matches hold. Detections
are intervals of words. A detection that lies within another of the same or a higher priority is
suppressed; the ones left give the labels. The base phrases are never suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, let, normal_words, text_of

#: The phrases that count as base places, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: (keyword, title as a regex over words, the file or page name its address ends in)
FAMILIES = {
    "apache-1.1": ("apache", "apache (?:software )?license (?:version |v )?1 1", "apache org licenses license 1 1"),
    "apache-2": ("apache", "apache (?:software )?license (?:version |v ?)?2(?: 0)?", "apache org licenses license 2 0"),
    "mit": ("mit", "mit (?:x11 )?license", "opensource org licenses mit"),
    "mit-0": ("mit", "mit no attribution(?: license)?", "opensource org licenses mit 0"),
    "bsd-2": ("bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[sc]e", "opensource org licenses bsd 2 clause"),
    "bsd-3": ("bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e", "opensource org licenses bsd 3 clause"),
    "bsd-4": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd) licen[sc]e", "spdx org licenses bsd 4 clause"),
    "0bsd": ("bsd", "(?:zero clause bsd|bsd zero clause|0bsd) licen[sc]e", "opensource org licenses 0bsd"),
    "isc": ("isc", "isc licen[sc]e", "opensource org licenses isc"),
    "zlib": ("zlib", "zlib(?: libpng)? licen[sc]e", "opensource org licenses zlib"),
    "gpl-1": ("general", "gnu general public licen[sc]e (?:version |v ?)1", "gnu org licenses gpl 1 0"),
    "gpl-2": ("general", "gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2", "gnu org licenses gpl 2 0"),
    "gpl-3": ("general", "gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3", "gnu org licenses gpl 3 0"),
    "lgpl-2": ("library", "gnu library general public licen[sc]e (?:version |v ?)2", "gnu org licenses lgpl 2 0"),
    "lgpl-2.1": ("lesser", "gnu lesser general public licen[sc]e (?:version |v ?)2 1", "gnu org licenses lgpl 2 1"),
    "lgpl-3": ("lesser", "gnu lesser general public licen[sc]e (?:version |v ?)3", "gnu org licenses lgpl 3 0"),
    "agpl-3": ("affero", "gnu affero general public licen[sc]e (?:version |v ?)3", "gnu org licenses agpl 3 0"),
    "gfdl-1.3": ("documentation", "gnu free documentation licen[sc]e (?:version |v ?)1 3", "gnu org licenses fdl 1 3"),
    "mpl-1.1": ("mozilla", "mozilla public licen[sc]e (?:version |v ?)?1 1", "mozilla org mpl 1 1"),
    "mpl-2": ("mozilla", "mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?", "mozilla org mpl 2 0"),
    "epl-1": ("eclipse", "eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?", "eclipse org legal epl v10"),
    "epl-2": ("eclipse", "eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?", "eclipse org legal epl 2 0"),
    "cddl-1": ("distribution", "common development and distribution licen[sc]e", "opensource org licenses cddl 1 0"),
    "cpl-1": ("common", "common public licen[sc]e(?: (?:version |v ?)?1 0)?", "opensource org licenses cpl 1 0"),
    "eupl-1.2": ("european", "european union public licen[sc]e", "joinup ec europa eu software page eupl"),
    "artistic-1": ("artistic", "artistic licen[sc]e (?:version |v ?)?1(?: 0)?", "opensource org licenses artistic license 1 0"),
    "artistic-2": ("artistic", "artistic licen[sc]e (?:version |v ?)?2(?: 0)?", "opensource org licenses artistic license 2 0"),
    "bsl-1": ("boost", "boost software licen[sc]e", "boost org license 1 0"),
    "busl-1.1": ("business", "business source licen[sc]e(?: 1 1)?", "mariadb com bsl11"),
    "unlicense": ("unlicense", "(?:the )?unlicense", "unlicense org"),
    "wtfpl": ("public", "do what the fuck you want to public licen[sc]e", "wtfpl net"),
    "python-2": ("python", "python software foundation licen[sc]e", "docs python org license"),
    "php-3": ("php", "php licen[sc]e (?:version |v ?)?3", "php net license 3 01"),
    "ruby": ("ruby", "ruby licen[sc]e", "ruby lang org en about license"),
    "postgresql": ("postgresql", "postgresql licen[sc]e", "opensource org licenses postgresql"),
    "openssl": ("openssl", "openssl licen[sc]e", "openssl org source license"),
    "ms-pl": ("microsoft", "microsoft public licen[sc]e", "opensource org licenses ms pl"),
    "ms-rl": ("microsoft", "microsoft reciprocal licen[sc]e", "opensource org licenses ms rl"),
    "sspl-1": ("server", "server side public licen[sc]e", "mongodb com licensing server side public license"),
    "elastic-2": ("elastic", "elastic licen[sc]e (?:version |v ?)?2(?: 0)?", "elastic co licensing elastic license"),
    "ofl-1.1": ("font", "sil open font licen[sc]e", "scripts sil org ofl"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[sc]e", "opensource org licenses ncsa"),
    "upl-1": ("universal", "universal permissive licen[sc]e", "opensource org licenses upl"),
    "w3c": ("w3c", "w3c software (?:notice and )?licen[sc]e", "w3 org consortium legal"),
    "odbl-1": ("database", "open (?:data commons open )?database licen[sc]e", "opendatacommons org licenses odbl"),
    "odc-by": ("attribution", "open data commons attribution licen[sc]e", "opendatacommons org licenses by"),
    "pddl-1": ("dedication", "public domain dedication and licen[sc]e", "opendatacommons org licenses pddl"),
    "cc0-1": ("creative", "creative commons (?:zero|cc0|public domain dedication)", "creativecommons org publicdomain zero"),
    "cc-by": ("commons", "creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?", "creativecommons org licenses by"),
    "cc-by-sa": ("commons", "creative commons attribution share ?alike", "creativecommons org licenses by sa"),
    "cc-by-nd": ("commons", "creative commons attribution no ?deriv(?:ative|ativework|ative work)?s?", "creativecommons org licenses by nd"),
    "cc-by-nc": ("commons", "creative commons attribution non ?commercial", "creativecommons org licenses by nc"),
    "cc-by-nc-sa": ("commons", "creative commons attribution non ?commercial share ?alike", "creativecommons org licenses by nc sa"),
    "cc-by-nc-nd": ("commons", "creative commons attribution non ?commercial no ?deriv(?:ative|ativework|ative work)?s?", "creativecommons org licenses by nc nd"),
}

#: (label, keyword, regex over words, priority): phrases of license texts and notices without a title.
NOTICES = [
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy of this software", 4),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 4),
    ("bsd-3", "endorse", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse", 4),
    ("bsd-2", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 2),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 4),
    ("gpl-3", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3", 5),
    ("gpl-2", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2", 5),
    ("lgpl-2.1", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1", 5),
    ("agpl-3", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3", 5),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 4),
    ("bsl-1", "boost", "distributed under the boost software licen[sc]e version 1 0", 4),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 2),
    ("proprietary", "reserved", "all rights reserved", 1),
    ("proprietary", "proprietary", "proprietary and confidential", 1),
    ("gpl", "gpl", "(?:under|of) the (?:gnu )?gpl", 1),
    ("gpl", "general", "gnu general public licen[sc]e", 1),
    ("lgpl", "lesser", "gnu lesser general public licen[sc]e", 1),
    ("agpl", "affero", "gnu affero general public licen[sc]e", 1),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", 1),
    ("cc", "commons", "creative commons licen[sc]e", 1),
]
#: Short names as used in tags and file headers, with their label where that differs.
SHORT = {"gpl-2": "gpl 2 0(?: only| or later)?", "gpl-3": "gpl 3 0(?: only| or later)?", "lgpl-2.1": "lgpl 2 1(?: only| or later)?",
         "lgpl-3": "lgpl 3 0(?: only| or later)?", "agpl-3": "agpl 3 0(?: only| or later)?", "apache-2": "apache 2 0", "mpl-2": "mpl 2 0",
         "epl-2": "epl 2 0", "epl-1": "epl 1 0", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause", "bsd-4": "bsd 4 clause", "bsl-1": "bsl 1 0",
         "cc0-1": "cc0 1 0", "ofl-1.1": "ofl 1 1", "python-2": "psf 2 0", "php-3": "php 3 01", "odbl-1": "odbl 1 0", "pddl-1": "pddl 1 0",
         "cddl-1": "cddl 1 [01]", "cpl-1": "cpl 1 0", "sspl-1": "sspl 1 0", "upl-1": "upl 1 0", "gfdl-1.3": "gfdl 1 3(?: only| or later)?",
         "gpl-1": "gpl 1 0(?: only| or later)?", "lgpl-2": "lgpl 2 0(?: only| or later)?"}
CC = {"cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"}


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex over words, priority) of all rules, the strongest first.

    Each family has a tag, a grant, an address, a title, a short name and a reference to a copy.
    """
    out = []
    for label, (keyword, title, address) in FAMILIES.items():
        short = SHORT.get(label, label.replace("-", " ") + (" [1-4] [05]" if label in CC else ""))
        out += [
            (label, "spdx", f"spdx license identifier {short}", 6),
            (label, keyword, f"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{title}", 5),
            (label, address.split(" ")[0], f"(?:https? )?(?:www )?{address}", 4),
            (label, keyword, f"(?:the )?{title}", 3),
            (label, keyword, f"see (?:the )?(?:file )?(?:license|copying) (?:file )?for (?:the )?(?:full )?(?:text of )?(?:the )?{title}", 5),
            (label, "license", f"license {short}", 3),
        ]
    out += NOTICES
    return sorted(out, key=lambda r: -r[3])


def _count(text: Column) -> Column:
    """Words of a piece that is cut at single blanks: its blanks are those between and around words."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _pattern(regex: Column) -> Column:
    return F.concat(F.lit(" (?:"), regex, F.lit(")(?= )"))


def places(words: Column, regex: Column) -> Column:
    """Intervals (start, stop) of the words that match, from left to right.

    A pattern ends before a blank it doesn't take, so two matches may stand next to each other.
    """

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _count(pair["gap"])
        stop = start + _count(pair["hit"])
        found = F.when(pair["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop")))))
        return F.struct(stop.alias("at"), found.alias("found"))

    # a match begins with a blank, so blanks before it are the words before it
    pattern = _pattern(regex)
    pairs = F.arrays_zip(F.split(words, pattern).alias("gap"), F.regexp_extract_all(words, pattern, F.lit(0)).alias("hit"))
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,stop:int>>")).alias("found"))
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def needed(regex: str) -> list[str]:
    """Words that every match of a regex holds as whole words: those outside of groups that nothing may stick to."""
    # a group whose alternatives all end in a blank stands apart from what follows; any other may be part of a word
    apart = lambda m: "" if all(a.endswith(" ") for a in m[1].split("|")) else "#"
    before = None
    while regex != before:
        before, regex = regex, re.sub(r"\(\?:([^()]*)\)(?:\?|\{\d+,\d+\})?", apart, regex)
    return [w for w in re.sub(r"[^ ]* \?[^ ]*", "#", regex).split(" ") if re.fullmatch("[a-z0-9]+", w)]


def detect(words: Column, table: list[tuple[str, str, str, int]]) -> Column:
    """All matches of the rules: (start, stop, label, priority).

    A rule is tried on texts that hold its keyword and all the words it needs; those are looked up in one
    pass over the text's words. The keyword comes first, as the rarest of them.
    """
    needs = [sorted(dict.fromkeys(needed(r)), key=lambda w: w not in k.split(" ")) for _, k, r, _ in table]
    fields = lambda a, k, r, p, n: F.struct(F.lit(a).alias("label"), F.lit(k).alias("keyword"), F.lit(r).alias("regex"), F.lit(p).alias("priority"), F.array(*map(F.lit, n)).cast("array<string>").alias("needs"))
    listed = F.array(*[fields(*rule, n) for rule, n in zip(table, needs)])
    known = F.array(*[F.lit(w) for w in sorted({w for n in needs for w in n})]).cast("array<string>")

    def gated(present: Column) -> Column:
        return F.filter(listed, lambda r: F.forall(r["needs"], lambda w: F.array_contains(present, w)) & F.contains(words, r["keyword"]))

    tried = let(F.array_intersect(F.split(words, " "), known), gated)
    matching = F.filter(tried, lambda r: F.rlike(words, _pattern(r["regex"])))
    hits = F.transform(matching, lambda r: F.transform(places(words, r["regex"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), r["label"].alias("label"), r["priority"].alias("priority"))))
    return F.flatten(hits)


def suppress(detections: Column, priorities: list[int]) -> Column:
    """Without those that lie within a detection of a higher priority, or a larger or earlier listed one of the same.

    Sorted by start, longest and strongest first, a detection lies within an earlier one if one of its
    priority or more has ended no sooner; so one pass that keeps the furthest end of each priority will do.
    """
    order = F.array_sort(detections, _before)
    ends = F.array(*[F.lit(-1) for _ in priorities])

    def step(acc: Column, d: Column) -> Column:
        level = F.array_position(F.array(*[F.lit(p) for p in priorities]), d["priority"]).cast("int")
        stronger = F.slice(acc["ends"], F.lit(1), level)  # priorities are listed from the highest
        inside = F.array_max(stronger) >= d["stop"]
        moved = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == level, F.greatest(e, d["stop"])).otherwise(e))
        return F.struct(moved.alias("ends"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    # of detections that start together the shorter strong one comes second, and is dropped only by equals or stronger ones
    start = F.struct(ends.alias("ends"), F.slice(detections, 1, 0).alias("kept"))
    return F.aggregate(order, start, step, lambda acc: acc["kept"])


def _before(a: Column, b: Column) -> Column:
    tests = [(a["start"], b["start"]), (b["stop"], a["stop"]), (b["priority"], a["priority"]), (a["label"], b["label"])]
    out = F.lit(0)
    for x, y in reversed(tests):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `n_words`, `base` (places of base phrases) and `detections` (those left of the rules').

    Places are (start, stop, label, priority) in words from 0, stop exclusive. A null text counts as
    empty. Rows are scanned each on their own: repeated ones give the same, an empty table nothing.
    """
    return carried(docs, {text}, ("n_words", "base", "detections"), lambda own: _scanned(own, text))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    base = [(label, phrase, phrase, 9) for phrase, label in BASE.items()]
    table = rules()
    levels = sorted({p for *_, p in table}, reverse=True)
    words = normal_words(text_of(docs, text))
    # one generated row: nothing above it is evaluated twice
    rows = docs.withColumn("_words", F.explode(F.array(words)))
    found = suppress(detect(F.col("_words"), table), levels)
    rows = rows.withColumn("_found", F.explode(F.array(F.struct(found.alias("rules"), detect(F.col("_words"), base).alias("base")))))
    empty = F.slice(F.col("_found.base"), 1, 0)
    return rows.select(
        *[c for c in docs.columns if c not in ("n_words", "base", "detections")],
        F.when(F.trim("_words") == "", 0).otherwise(_count(F.col("_words")) - 1).cast("long").alias("n_words"),
        F.col("_found.base").alias("base"),
        F.coalesce("_found.rules", empty).alias("detections"),
    )


def summary(scanned: DataFrame) -> list[Column]:
    """Columns: number of base places, first and last of them, labels, and a score.

    The score is 1 with a base place, else grows with the priority of the strongest detection.
    """
    starts = F.transform("base", lambda b: b["start"])
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"])))
    strongest = F.array_max(F.transform("detections", lambda d: d["priority"]))
    return [
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(names(F.col("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names(F.col("base")), names(F.col("detections")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(strongest / F.lit(7.0), F.lit(0.0))).alias("score"),
    ]
