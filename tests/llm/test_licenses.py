"""Base places and rules against plain Python over word lists."""

import random
import re

from lexigauge.llm import licenses

RULES = licenses.rules()


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(words):
    return sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def plain_rules(words):
    text = " " + " ".join(words) + " "
    found = []
    for label, keyword, regex, priority in RULES:
        if keyword in text:
            for m in re.finditer(f" (?:{regex})(?= )", text):
                start = text[: m.start()].count(" ")
                found.append((start, start + m.group().count(" "), label, priority))
    found.sort(key=lambda d: (d[0], -d[1], -d[3], d[2]))
    kept = []
    for i, d in enumerate(found):
        if not any(e[1] >= d[1] and e[3] >= d[3] for e in found[:i]):
            kept.append(d)
    return kept


def texts():
    rnd = random.Random(2)
    parts = ["Under the MIT License", "apache license, version 2.0", "CC-BY-NC 4.0", "cc by nc cc by nc", "the", "licensed", "MIT", "license", "ümit",
             "GNU General Public License version 3", "gnu lesser general public license v2 1", "SPDX-License-Identifier: Apache-2.0", "under", "BSD 3-Clause License",
             "https://www.apache.org/licenses/LICENSE-2.0", "released under the mozilla public license 2.0", "All rights reserved.", "see the LICENSE file for the mit license",
             "creative commons attribution non-commercial", "K", "\n", "--", "É", "\x7f", "1", "neither the name of the foo bar nor the names of its contributors may be used to endorse"]
    for _ in range(120):
        yield rnd.choice([" ", ". ", "\n"]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
    yield from [None, "", "...", "under the mit license", "x" * 5000 + " cc by nc " * 400]


def test_scan(spark):
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, "cc by nc", "n"), (3, "cc by nc", "n"), (3, "cc by nc", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, detections string")
    scanned = licenses.scan(docs)
    out = scanned.select("doc_id", "text", "n_words", "base", "detections", *licenses.summary(scanned)).collect()
    assert len(out) == len(rows)
    for r in out:
        words = plain_words(r.text)
        base = plain_base(words)
        rules = plain_rules(words)
        assert r.n_words == len(words)
        assert sorted((b.start, b.label) for b in r.base) == base
        assert [tuple(d) for d in r.detections] == rules, r.text
        assert (r.n_base, r.first_word, r.last_word) == (len(base), min(base)[0] if base else None, max(base)[0] if base else None)
        assert r.base_labels == ",".join(sorted({b for _, b in base}))
        assert r.labels == ",".join(sorted({b for _, b in base} | {d[2] for d in rules})) and 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_rules_compile_and_prefilter_is_sound():
    assert len(RULES) > 300
    for _, keyword, regex, _ in RULES:
        re.compile(regex)
        assert keyword in " ".join(regex.replace("(?:", " ").replace("https?", "https").split()).replace("[sc]", "s") or keyword == "license", (keyword, regex)


def written(regex, rnd):
    """A random text that the regex matches: alternatives chosen, optional parts kept or left out."""
    before = None
    while regex != before:
        before = regex
        regex = re.sub(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", lambda m: rnd.choice(m[1].split("|")) if m[2] is None or m[2] != "?" or rnd.random() < 0.5 else "", regex)
    regex = regex.replace("[^ ]+", "foo")
    return re.sub(r"\[([^]]+)\]", lambda m: m[1][0], re.sub(r"(\[[^]]+\]|.)\?", lambda m: m[1] if rnd.random() < 0.5 else "", regex))


def test_every_match_holds_the_needed_words():
    rnd = random.Random(5)
    for _, _, regex, _ in RULES:
        for _ in range(30):
            text = written(regex, rnd)
            assert re.fullmatch(regex, text), (regex, text)
            assert set(licenses.needed(regex)) <= set(text.split(" ")), (regex, text)
    assert licenses.needed("apache (?:software )?license (?:version |v ?)?2(?: 0)?") == ["apache", "license"]
