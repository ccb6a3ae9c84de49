"""Column expressions shared by the operators, safe under ANSI mode."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def fdiv(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 NaN; null if either is null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a == 0, F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def at_least(c: Column, threshold: float) -> Column:
    """c >= threshold, false for NaN."""
    return (c >= threshold) & ~F.isnan(c.cast("double"))


def slice1(s: Column, a: Column, b: Column) -> Column:
    """Characters a..b of s, 1-based and inclusive; '' when b < a."""
    return F.when(b < a, F.lit("")).otherwise(F.substring(s, a, b - a + 1))


def gene_of(allele: str | Column) -> Column:
    """The part of an allele name before '*'."""
    return F.split_part(col(allele), F.lit("*"), F.lit(1))


def sequence_hash(s: str | Column) -> Column:
    """'S' and four digits: the last four hex digits of the MD5, modulo 10^4."""
    number = F.conv(F.right(F.md5(col(s)), F.lit(4)), 16, 10).cast("long") % 10000
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), 4, "0"))


def unique_name(name: str | Column, s: str | Column) -> Column:
    """The name up to its first '_', with the hash of the sequence."""
    return F.concat(F.split_part(col(name), F.lit("_"), F.lit(1)), F.lit("_"), sequence_hash(s))


# IUPAC codes and their complements
_CODES, _COMPLEMENTS = "ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"


def reverse_complement(s: str | Column) -> Column:
    """Unchanged where a character is no IUPAC code."""
    s = col(s)
    return F.when(F.upper(s).rlike(f"^[{_CODES}]*$"), F.reverse(F.translate(F.upper(s), _CODES, _COMPLEMENTS))).otherwise(s)


def cigar_span(c: str | Column) -> Column:
    """Reference positions that a CIGAR string covers."""
    steps = F.regexp_extract_all(col(c), F.lit(r"(\d+)[MDNX=]"), F.lit(1))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def cigar_leading_skip(c: str | Column) -> Column:
    """Length of the skip a CIGAR string starts with, else 0."""
    n = F.regexp_extract(col(c), r"^(\d+)N", 1)
    return F.when(n == "", F.lit(0).cast("long")).otherwise(n.cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions, -1 for unequal lengths."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(-1)).otherwise(F.aggregate(differ, F.lit(0), lambda t, x: t + x))


def gene_type(name: str | Column) -> Column:
    """The first of V, D and J that the name contains."""
    name = col(name)
    return F.when(name.contains("V"), "V").when(name.contains("D"), "D").when(name.contains("J"), "J")


def parse_gene_type(name: str) -> str:
    """V, D or J, in either case; anything else is an error."""
    out = name.strip().upper()
    if out not in ("V", "D", "J"):
        raise ValueError(f"{name} is none of V, D and J")
    return out


def base_name(path: str | Column) -> Column:
    """The part of a path behind its last slash."""
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def stem(path: str | Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def replace_extension(path: str | Column, extension: str) -> Column:
    """A path with its last extension replaced."""
    return F.concat(F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{extension.lstrip('.')}"))


def without_gaps(s: str | Column) -> Column:
    return F.replace(col(s), F.lit("-"), F.lit(""))


def windows_within(text: str | Column, pattern: Column, most: int) -> Column:
    """Structs (start, distance) of the windows of a text that differ from
    `pattern` in at most `most` places."""
    text = col(text)
    at = F.when(F.length(text) >= F.length(pattern), F.sequence(F.lit(1), F.length(text) - F.length(pattern) + 1)).otherwise(F.array().cast("array<int>"))
    near = F.transform(at, lambda i: F.struct(i.alias("start"), hamming(F.substring(text, i, F.length(pattern)), pattern).alias("distance")))
    return F.filter(near, lambda x: x["distance"] <= most)


def kmers(s: str | Column, k: int) -> Column:
    """Distinct substrings of length k; an empty array for shorter strings."""
    s = col(s)
    positions = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(positions, lambda i: F.substring(s, i, F.lit(k))))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    sizes = F.filter(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), same)
    return F.left(a, F.coalesce(F.array_max(sizes), F.lit(0)))


def common_suffix(a: Column, b: Column) -> Column:
    return F.reverse(common_prefix(F.reverse(a), F.reverse(b)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
