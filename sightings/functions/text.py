"""Text, array, map and struct helpers, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that would break a tab-separated line.  A carriage
# return followed by a line feed is two characters here and becomes two spaces.
LINE_BREAKERS = "\t\n\r\x0b\x0c\x85\u2028\u2029\x00"
# What is trimmed at both ends, every character up to the blank.
BLANKS = "".join(map(chr, range(0x21)))


def clean_delimiters(c: Column) -> Column:
    """Separators become spaces, control characters and blanks at both ends go.

    Character mapping and trimming, because regular expressions cost several times more.
    """
    return F.trim(F.translate(c, LINE_BREAKERS, " " * len(LINE_BREAKERS)), F.lit(BLANKS))


def null_if_empty(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def clean_delimiters_array(a: Column) -> Column:
    cleaned = F.transform(a, clean_delimiters)
    return null_if_empty(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")))


def join_array(a: Column, separator: str = ";") -> Column:
    """Elements joined by the separator; null for a null or empty array."""
    return F.when(F.size(a) > 0, F.array_join(a, separator))


def remove_nulls(a: Column) -> Column:
    return null_if_empty(F.array_compact(a))


def remove_null_strings(a: Column) -> Column:
    return null_if_empty(F.filter(a, lambda x: F.trim(x) != ""))


def array_union_all(left: Column, right: Column) -> Column:
    """Union of two arrays where a missing side counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(left, empty), F.coalesce(right, empty))


def nested_value(m: Column, *keys: str) -> Column:
    """Value at a path of map keys; null where any key is missing."""
    for key in keys:
        m = m.getItem(key)
    return m


def concept(vocabulary: Column) -> Column:
    return vocabulary.getField("concept")


def concepts(vocabulary: Column) -> Column:
    return vocabulary.getField("concepts")


def lineage(vocabulary: Column) -> Column:
    return vocabulary.getField("lineage")


def year_month(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year, month)


def supplied(c: Column) -> Column:
    return F.coalesce(c, F.lit("NOT_SUPPLIED"))


def fasta(sequence_id: Column, record_id: Column, gene: Column, sequence: Column) -> Column:
    header = F.concat(F.lit(">"), F.coalesce(sequence_id, F.lit("")), F.lit("|"), record_id,
                      F.lit("|"), F.coalesce(gene, F.lit("")))
    return F.concat(header, F.lit("\n"), sequence)


def media_items(json_text: Column) -> Column:
    return F.from_json(json_text, "array<map<string,string>>")


def array_contains_text(a: Column, value: str, case_sensitive: bool) -> Column:
    """False, never null, when the array is null or holds no match."""
    if case_sensitive:
        found = F.exists(a, lambda x: x == F.lit(value))
    else:
        found = F.exists(a, lambda x: F.lower(x) == F.lit(value.lower()))
    return F.coalesce(found, F.lit(False))


def wildcard_regex(pattern: str) -> str:
    """``*`` any text, ``?`` one character, backslash escapes; the rest is literal."""
    special = set("\\^$.|?*+()[]{}")
    out, escaped = [], False
    for ch in pattern:
        if escaped:
            out.append("\\" + ch if ch in special else ch)
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append("\\" + ch if ch in special else ch)
    if escaped:
        out.append("\\\\")
    return "(?s)^" + "".join(out) + "$"


def like_text(c: Column, pattern: str, case_sensitive: bool) -> Column:
    regex = wildcard_regex(pattern)
    return c.rlike(regex if case_sensitive else "(?iu)" + regex)


def array_like_text(a: Column, pattern: str, case_sensitive: bool) -> Column:
    return F.coalesce(F.exists(a, lambda x: like_text(x, pattern, case_sensitive)), F.lit(False))
