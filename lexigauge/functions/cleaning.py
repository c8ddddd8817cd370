"""Removal of JSON debris from text cells, and the validity test for a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigauge.fixed_values import JAVA_WS as WS
from lexigauge.fixed_values import WHITESPACE

# A `{"key":` opener with the whitespace around it. The lookbehind lets a match begin only
# where a whitespace run begins (or where the previous match ended), which keeps the scan
# linear on long runs of blanks.
_OPENER = rf'(?:\G|(?<![{WS}]))[{WS}]*+\{{[{WS}]*+"[^"]+"[{WS}]*+:[{WS}]*+'
_LAST_BRACE = rf"(?<![{WS}])[{WS}]*+\}}[{WS}]*+\z"
_ONLY_PUNCTUATION = rf'^[{WS}]*+[{{}}\[\]"]+[{WS}]*+\z'


def clean_text(text: Column) -> Column:
    """Strip whitespace, outer quotes, `{"key":` openers and one closing brace; null -> ''."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    text = F.btrim(text, F.lit('"'))
    text = F.replace(text, F.lit('\\"'), F.lit('"'))
    # Most cells hold no brace at all: a plain search spares them the regexes.
    text = F.when(F.contains(text, F.lit("{")), F.regexp_replace(text, _OPENER, "")).otherwise(text)
    return F.when(F.contains(text, F.lit("}")), F.regexp_replace(text, _LAST_BRACE, "")).otherwise(text)


def is_valid_text(text: Column) -> Column:
    """True unless the text is null, empty, or nothing but braces, brackets and quotes."""
    return F.coalesce((text != "") & ~text.rlike(_ONLY_PUNCTUATION), F.lit(False))
