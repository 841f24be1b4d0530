"""Clause identifiers: normal forms, and what a breadcrumb claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlab.functions.text import casefold, let, roman_to_int

# Words that are dropped, words that become a prefix, and gold prefixes that a breadcrumb may omit.
DROPPED = ("clause", "paragraph")
KEPT = ("section", "article", "schedule")
GOLD_PREFIXES = ("section_", "article_", "schedule_", "chapter_", "recital_", "part_")


def normalize_identifier(identifier: Column) -> Column:
    """Case folded, one space between words, without 'clause'; 'Schedule 7.1' is schedule_7.1, 'Article XII' article_12."""
    plain = F.regexp_replace(F.regexp_replace(casefold(identifier), r"^\s+|\s+$", ""), r"\s+", " ")

    def body(text: Column) -> Column:
        dropped = text.rlike(rf"^(?:{'|'.join(DROPPED)}) ")
        word = F.when(~dropped, F.regexp_extract(text, rf"^({'|'.join(KEPT)}) ", 1)).otherwise("")
        rest = F.trim(F.regexp_replace(text, rf"^(?:{'|'.join(DROPPED + KEPT)}) ", ""))
        roman, letters = F.regexp_extract(rest, r"^([ivxlcdm]+)((?:\([a-z]{1,3}\))*)$", 1), F.regexp_extract(rest, r"^([ivxlcdm]+)((?:\([a-z]{1,3}\))*)$", 2)
        number = F.when(roman != "", F.concat(roman_to_int(F.nullif(roman, F.lit(""))).cast("string"), letters)).otherwise(rest)
        return F.regexp_replace(F.concat(F.when(word != "", F.concat(word, F.lit("_"))).otherwise(""), number), r"\.+$", "")

    return let(plain, body)


# Fixed value: a numbered component of a breadcrumb, with its word, number and letter.
PATH_TOKEN = r"(?i)^\s*(?:(article|section|schedule|chapter|clause|recital|part)\s+)?(\([a-z]{1,3}\)|\d+(?:\.\d+)*|[ivxlcdm]+\b)(\([a-z]{1,3}\))?"


def claimed_identifier(path: Column) -> Column:
    """Of a '>'-separated breadcrumb: each numbered component replaces what came before, an '(a)' is added to it; null if
    no component is numbered."""

    def token(part: Column) -> Column:
        word, number, letter = (F.regexp_extract(part, PATH_TOKEN, k) for k in (1, 2, 3))
        arabic = F.when(number.rlike(r"^[A-Za-z]+$"), roman_to_int(F.lower(number)).cast("string")).otherwise(number)
        return F.when(number != "", F.concat(F.when(word != "", F.concat(word, F.lit(" "))).otherwise(""), arabic, letter))

    join = lambda held, t: F.when(t.isNull(), held).when(F.startswith(t, F.lit("(")) & held.isNotNull(), F.concat(held, t)).otherwise(t)
    return F.aggregate(F.transform(F.split(path, ">"), token), F.lit(None).cast("string"), join)


def lookup_keys(identifier: Column) -> Column:
    """Keys under which a gold clause is found: its normal form, and that without its prefix."""
    bare = F.regexp_extract(identifier, rf"^(?:{'|'.join(GOLD_PREFIXES)})(.+)$", 1)
    return F.array_distinct(F.array_compact(F.array(normalize_identifier(identifier), F.when(bare != "", normalize_identifier(bare)))))
