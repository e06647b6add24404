"""Task records: decoding of test lists, routing by language, solution variants."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetrials.functions.literals import string_list
from codetrials.functions.text import let
from codetrials.schemas import LANGUAGES, VARIANTS

REASON = "reject_reason"

# A list of plain string literals whose escapes mean the same in JSON and in Python.
_SAME_ESCAPE = r"""\\(?:[\\"'ntrbf]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"""
_LITERAL = rf"""(?:"(?:[^"\\\n\r]|{_SAME_ESCAPE})*+"|'(?:[^'\\\n\r]|{_SAME_ESCAPE})*+')"""
_GAP = r"[ \t\n\r]*+"
PLAIN_LIST = rf"\A[ \t]*+\[{_GAP}(?:{_LITERAL}{_GAP}(?:,{_GAP}{_LITERAL}{_GAP})*+)?\]{_GAP}\z"

JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _named_list_udf():  # type: ignore[no-untyped-def]
    """A Python literal holding a list or tuple of strings; anything else gives NULL.

    The functions are nested so that they travel to the workers by value, without this package.
    """

    def parse(text: str | None) -> list[str] | None:
        if text is None:
            return None
        try:
            value = ast.literal_eval(text)
            if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
                return None
            for item in value:
                item.encode("utf-8")
            return list(value)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    def parse_batch(texts: pd.Series) -> pd.Series:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # odd escapes are legal, and there may be very many of them
            return texts.map(parse)

    return F.pandas_udf(parse_batch, T.ArrayType(T.StringType()))


def decode_tests(tasks: DataFrame, test: str = "test", listed: str | None = None, by_name: bool = False) -> DataFrame:
    """Add ``tests ARRAY<STRING>``, NULL where the field cannot be decoded.

    Lists that JSON and Python read alike are parsed as JSON, the others (tuples, trailing commas, joined literals,
    Python-only escapes) by :func:`codetrials.functions.literals.string_list`; both stay in the JVM.  Escapes by
    character name (``\\N{...}``) are in no table here: lists with one are NULL, or, with ``by_name``, read by a Python
    worker, which gets those rows alone.  ``listed`` names a column that holds tests already stored as a list, which is
    taken as it is.
    """
    text = F.col(test)
    plain = F.from_json(F.when(text.rlike(PLAIN_LIST), text), "array<string>", JSON_OPTIONS)
    staged = tasks.withColumn("_plain", plain)
    if listed is not None:
        staged = staged.withColumn("_plain", F.coalesce(F.col(listed), F.col("_plain")))
    staged = staged.withColumn("_literal", F.when(F.col("_plain").isNull(), text))
    tests = F.coalesce(F.col("_plain"), string_list("_literal"))
    if by_name:
        staged = staged.withColumn("_plain", tests)
        named = F.col("_plain").isNull() & F.contains(text, F.lit("\\N{"))
        tests = F.coalesce(F.col("_plain"), _named_list_udf()(F.when(named, text)))
    return staged.withColumn("tests", let(tests, lambda ts: F.when(~F.exists(ts, lambda t: t.isNull()), ts))).drop("_plain", "_literal")


def check_tasks(tasks: DataFrame) -> DataFrame:
    """Add ``reject_reason``: what makes a record unusable, NULL for a good one.

    A record of an unsupported language is never looked at any further, so it has no other reason.
    """
    missing: Column = F.lit(None).cast("string")
    for name in reversed(["task_id", "language", "prompt", *VARIANTS.values(), "test"]):
        missing = F.when(F.col(name).isNull(), F.lit(f"missing {name}")).otherwise(missing)
    missing = F.when(
        (F.col("language") == "Java") & F.col("entry_point").isNull(),
        F.coalesce(missing, F.lit("missing entry_point")),
    ).otherwise(missing)
    unusable = F.when(F.col("tests").isNull(), F.lit("unreadable test"))
    return tasks.withColumn(
        REASON,
        F.when(F.col("language").isNotNull() & ~F.col("language").isin(LANGUAGES), "unsupported language")
        .when(missing.isNotNull(), missing)
        .otherwise(unusable),
    )


def usable(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNull()).drop(REASON)


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNotNull())


def is_handled(language: Column | str = "language") -> Column:
    """Whether a language is supported; false for NULL."""
    language = F.col(language) if isinstance(language, str) else language
    return F.coalesce(language.isin(LANGUAGES), F.lit(False))


def route_language(tasks: DataFrame) -> DataFrame:
    """Records of a supported language."""
    return tasks.where(F.col("language").isin(LANGUAGES))


def skipped_language(tasks: DataFrame) -> DataFrame:
    """The complement of :func:`route_language`."""
    return tasks.where(~is_handled())


def explode_variants(tasks: DataFrame) -> DataFrame:
    """One row per task and solution variant: ``variant`` (``ir``, ``incs``) and ``solution``."""
    pairs = F.array(
        *[F.struct(F.lit(v).alias("variant"), F.col(name).alias("solution")) for v, name in VARIANTS.items()]
    )
    kept = [c for c in tasks.columns if c not in VARIANTS.values()]
    return tasks.select(*kept, F.inline(pairs))


def union_languages(*frames: DataFrame) -> DataFrame:
    """Results of several languages in one table, matched by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
