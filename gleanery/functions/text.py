"""Text and number expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import ANALYST, LABEL_DEFAULT, LABEL_RULES, MOJIBAKE, MOJIBAKE_PAGE, TECHNICIAN

#: Letters, digits and underscore, two at least; the same in Java's and RE2's syntax.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def collapse_space(c: Column) -> Column:
    """Runs of any white space to one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Null to empty, zero-width spaces dropped, no-break spaces and other white space to single spaces."""
    return collapse_space(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "​", ""), " ", " "))


def repair_encoding(c: Column, markers: str = MOJIBAKE) -> Column:
    """UTF-8 that was read as Latin-1, put right where that gives valid UTF-8; all else trimmed only."""
    c = F.trim(c)
    repaired = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    suspect = c.rlike(markers) & c.rlike(r"^[\x00-\xFF]*$")
    return F.when(suspect, F.coalesce(F.when(suspect, repaired), c)).otherwise(c)


def repair_all(df: DataFrame, markers: str = MOJIBAKE) -> DataFrame:
    """Every string column repaired, in one projection."""
    return df.select(*(repair_encoding(F.col(f"`{n}`"), markers).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))


def suspicious(df: DataFrame, markers: str = MOJIBAKE_PAGE) -> Column:
    """Whether any column shows signs of a wrong charset."""
    return reduce(Column.__or__, [F.coalesce(F.col(f"`{n}`").cast("string").rlike(markers), F.lit(False)) for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))])


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def label(c: Column, rules=LABEL_RULES, default: str = LABEL_DEFAULT) -> Column:
    """The label of the first rule whose keyword the lower-cased text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), F.lit(default))
    for word, name in rules:
        out = out.when(low.contains(word), F.lit(name))
    return out.otherwise(F.lit(default))


def technician(c: Column) -> Column:
    """Programmes that start as a technician's, or name an analyst. Null: no."""
    low = F.lower(c)
    return F.coalesce(low.rlike("(?U)" + TECHNICIAN) | low.rlike("(?U)" + ANALYST), F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-cased tokens of two characters or more; null: none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def grams(t: Column) -> Column:
    """Tokens and pairs of neighbours. t: a plain column, or it is computed several times over."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.concat(t, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def unaccent(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "áéíóúñ", "aeioun")


def column_name(c: Column) -> Column:
    """A name to compare columns by: lower case, plain letters, digits, single spaces."""
    return F.trim(F.regexp_replace(unaccent(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.replace(F.translate(F.lower(c), "áéíóú", "aeiou"), F.lit(" "), F.lit("_"))


def number(c: Column) -> Column:
    """The first number in a text, a decimal comma allowed; null without one."""
    plain = F.replace(F.replace(c.cast("string"), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(plain, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def fraction(x: Column) -> Column:
    """Percentages to fractions: beyond 1 in size means percent."""
    return F.when(F.abs(x) > 1, x / 100).otherwise(x)


def annotation(n: Column, share: Column) -> Column:
    return F.format_string("%d\n%.1f%%", n, share * 100)


def clean_tokens(c: Column, stop_words: Sequence[str]) -> Column:
    """Tokens for analysis: letters only, three characters or more, no addresses, no stop words. The lemma is the token itself."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(https?://|www\.)\S+|\S+@\S+", " ")
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,}+(?![\p{N}_])"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
