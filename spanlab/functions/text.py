"""Text expressions: normalisation, tokens, offsets and identifiers. All are Catalyst expressions unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the evaluation's definitions.
TOKEN = r"\S+"
TOKEN_WITH_GAP = r"\S+\s*"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])(?=\s)"
SENTENCE_OR_BLANK = r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n"


def substring(text: Column, start: Column | int, end: Column | int) -> Column:
    """Code points [start, end)."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    return F.substring(text, start + 1, end - start)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def sanitized(text: Column) -> Column:
    """Without byte-order marks, with line feeds only, in NFC. Python sees only texts that may not be in NFC already."""
    clean = F.replace(F.replace(F.replace(text, F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(clean.rlike("[^\\x{0}-\\x{2FF}]"), _nfc(clean)).otherwise(clean)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    """Budget tokens: runs without white space."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("\n")) + 1).cast("bigint")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: the optimiser never copies it into lambdas, where it would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece_starts(lengths: Column, lead: Column, stride: int = 64) -> Column:
    """Prefix sums of an array of lengths, each plus lead: sums of strides are taken first, then what is left within one."""
    whole = lambda i: F.floor(i / stride).cast("int")

    def strides(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(whole(F.size(n) - 1), F.lit(0))), lambda b: total(F.slice(n, b * stride + 1, stride)))

    starts = let(lengths, lambda n: let(strides(n), lambda sums: F.transform(n, lambda _, i: lead + total(F.slice(sums, 1, whole(i))) + total(F.slice(n, whole(i) * stride + 1, i % stride)))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(starts)


def roman_to_int(text: Column) -> Column:
    """Of a lower-case numeral; null for anything else."""
    value = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0)
    letters = F.split(F.reverse(text), "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    step = lambda a, c: F.struct((a["sum"] + F.when(value(c) < a["top"], -value(c)).otherwise(value(c))).alias("sum"), F.greatest(a["top"], value(c)).alias("top"))
    return F.when(text.rlike("^[ivxlcdm]+$"), F.aggregate(letters, start, step)["sum"])


def int_to_roman(number: Column) -> Column:
    """Of 1 to 3999, lower case."""
    out, rest = F.lit(""), number.cast("int")
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def document_key(query_id: Column) -> Column:
    """The document part of a query's identifier; all of it where nothing would be left."""
    stem = F.regexp_replace(query_id, r"_q[0-9a-zA-Z]*$", "")
    return F.when(stem == "", query_id).otherwise(stem)


def jurisdiction(document_id: Column) -> Column:
    return F.when(F.startswith(document_id, F.lit("us_")), "us").when(F.startswith(document_id, F.lit("eu_")), "eu").otherwise("uk")


def highlighted(text: Column, term: str) -> Column:
    """HTML-escaped, each occurrence of term in <mark>."""
    quote = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, "(?i)(\\Q" + quote(term).replace("\\E", "\\E\\\\E\\Q") + "\\E)", "<mark>$1</mark>")


def context_header(hierarchy: Column, clause_type: Column, terms: Column, refs: Column) -> Column:
    """[Section: … | Type: … | Terms: … | Refs: …] with what there is; empty if there is nothing."""
    some = lambda name, x: F.when(F.length(x) > 0, F.concat(F.lit(name), x))
    parts = F.concat_ws(" | ", some("Section: ", hierarchy), some("Type: ", clause_type), some("Terms: ", F.array_join(F.slice(F.array_sort(terms), 1, 5), ", ")), some("Refs: ", F.array_join(F.slice(refs, 1, 3), ", ")))
    return F.when(parts == "", "").otherwise(F.concat(F.lit("["), parts, F.lit("]\n")))
