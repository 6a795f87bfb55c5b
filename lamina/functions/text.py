"""String functions with Python's meaning of white space, case and numbers, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode white space and the four separators that Python adds to it.
SPACE = r"\s\x1c-\x1f"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = rf"(?U)[^{SPACE}]+"
TOKEN_OR_NEWLINE = rf"(?U)[^{SPACE}]+|\n"
#: First characters of a number as str.isdigit sees them.
DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}"


def newlines(text: Column) -> Column:
    """CRLF and CR as LF, as a text file is read."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def tokens(text: Column, newline: bool = False) -> Column:
    """Runs without white space; with ``newline`` each line feed is a token too."""
    return F.regexp_extract_all(text, F.lit(TOKEN_OR_NEWLINE if newline else TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def is_upper(text: Column) -> Column:
    """At least one cased character, and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def starts_with_digit(text: Column) -> Column:
    return text.rlike(rf"\A[{DIGIT}]")


def starts_with_bullet(text: Column) -> Column:
    return text.rlike(r"\A[•\-*+]")


def infer_type(value: Column) -> Column:
    """integer, float, date, boolean or string, in that order of tries; blank values are 'empty'."""
    v = strip(value)
    digits = r"\p{Nd}+(_\p{Nd}+)*"
    integer = v.rlike(rf"\A[+-]?{digits}\z")
    mantissa = rf"({digits}\.?({digits})?|\.{digits})"
    real = v.rlike(rf"(?i)\A[+-]?({mantissa}(e[+-]?{digits})?|inf(inity)?|nan)\z")
    # The forms of dates and the words of booleans.
    date = v.rlike(r"\A(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})")
    boolean = F.lower(v).isin("true", "false", "yes", "no")
    return F.when(F.coalesce(v, F.lit("")) == "", "empty").when(integer, "integer").when(real, "float").when(date, "date").when(boolean, "boolean").otherwise("string")


def as_number(value: Column) -> Column:
    """The number of an integer or float cell, else null."""
    v = F.replace(strip(value), F.lit("_"), F.lit(""))
    return F.when(infer_type(value).isin("integer", "float"), v.try_cast("double"))
