"""Ids, names and labels as text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType


def token_id(column: Column, line: Column, token: Column) -> Column:
    """c1_l2_t3, from 1-based numbers."""
    return F.format_string("c%d_l%d_t%d", column.cast("int"), line.cast("int"), token.cast("int"))


def token_numbers(tid: Column) -> list[Column]:
    """Column, line and token of an id; a span behind it doesn't matter."""
    return [F.regexp_extract(tid, r"^c(\d+)_l(\d+)_t(\d+)", i).try_cast("int") for i in (1, 2, 3)]


def parent(tid: Column) -> Column:
    """The token of a candidate: its id without the span in brackets."""
    return F.regexp_replace(tid, r"\[.*$", "")


def folded(name: Column) -> Column:
    """The key under which spellings of a name are one: trimmed, lower case. The sharp s folds to ss, as case folding has it."""
    return F.regexp_replace(F.lower(F.trim(name)), "ß", "ss")


def capitalised(name: Column) -> Column:
    """First letter upper, all others lower case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))


def natural_key(name: Column) -> Column:
    """A sort key that orders runs of digits by value: each is padded, the rest is lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(p, 20, "0")).otherwise(p)), "")


def label_text(status: Column, concept: Column, name: Column, merged_into: Column, auto_name: Column) -> Column:
    """A cluster's state in words."""
    return (
        F.when(status == "merged", F.concat(F.lit("merged into "), merged_into.cast("string")))
        .when(status == "removed", F.lit("removed"))
        .when(status == "labelled", F.concat_ws(": ", concept, name))
        .when(auto_name.isNotNull(), F.concat(F.lit("pending, reads "), auto_name))
        .otherwise(F.lit("pending"))
    )


def page_set_name(stems: Column) -> Column:
    """A name for a set of pages: their sorted names with + between, or, beyond 60 characters, the first, how many more, and a tag of them all."""
    ordered = F.array_sort(stems)
    joined = F.array_join(ordered, "+")
    short = F.concat(F.get(ordered, 0), F.lit("+"), (F.size(stems) - 1).cast("string"), F.lit("more_"), F.substring(F.md5(joined.cast("binary")), 1, 6))
    return F.when((F.size(stems) == 1) | (F.char_length(joined) <= 60), joined).otherwise(short)


def cleaned_reply(reply: Column) -> Column:
    """A reader's answer without code fences, quotes, a leading label, or lines after the first."""
    plain = F.regexp_replace(reply, r"(?s)```[a-zA-Z]*\n?|```", "")
    first = F.regexp_extract(F.trim(plain), r"^([^\n]*)", 1)
    bare = F.regexp_replace(first, r"(?i)^\s*(word|text|reading|transcription|answer)\s*[:=]\s*", "")
    bare = F.regexp_replace(bare, "^[\"'“”‘’`]+|[\"'“”‘’`.]+$", "")
    return F.nullif(F.trim(bare), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp similarity, which built-in functions lack; for short names."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        found = [None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)]
        return pd.Series(found, dtype="float64")

    return F.pandas_udf(each, "double", PandasUDFType.SCALAR)(a, b)
