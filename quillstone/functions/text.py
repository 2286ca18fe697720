"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """Non-breaking blanks as blanks, all white space collapsed, ends trimmed; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words of three characters or more, numbers only from four digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~(w.rlike("^[0-9]+$") & (F.length(w) <= 3)))


def token_set(c: Column) -> Column:
    """Distinct lower-case ASCII words of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two lists taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def without_markup(c: Column) -> Column:
    """Markdown links as their text, bracketed citations and tags removed, white space collapsed (entities are left to a UDF)."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1")
    s = F.regexp_replace(s, r"\(Citation:[^)]*\)", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def truncated(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last three of a shortened text being dots."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")


def snake(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def text_or_null(c: Column) -> Column:
    """Null for blank texts and the words null, none and n/a."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "null", "none", "n/a"), t)


def short_phrase(c: Column, limit: int = 48, words: int = 8) -> Column:
    """The first clause of a text; of a clause longer than ``limit``, its first words."""
    clause = F.trim(F.element_at(F.split(F.trim(c), r"[.;。；]"), 1))
    few = F.array_join(F.slice(F.split(clause, r"\s+"), 1, words), " ")
    return F.when(F.length(clause) > limit, few).otherwise(clause)


def evidence_ids(c: Column) -> Column:
    """Evidence ids of a list of texts: cut at commas, semicolons and blanks, upper case, E and a number, distinct, in natural order."""
    parts = F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.split(F.upper(F.coalesce(x, F.lit(""))), r"[,;\s]+")))
    kept = F.array_distinct(F.filter(parts, lambda x: x.rlike("^E[0-9]+$")))
    order = lambda a, b: F.substring(a, 2, 9).try_cast("int") - F.substring(b, 2, 9).try_cast("int")
    return F.array_sort(kept, order)


def technique_id(c: Column, parent: bool = False) -> Column:
    """Upper-case technique id, or null if malformed; ``parent`` cuts the part after the period."""
    t = F.upper(F.trim(c))
    ok = F.when(t.rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), t)
    return F.element_at(F.split(ok, r"\."), 1) if parent else ok


def label_parts(c: Column) -> Column:
    """Labels of a text that lists them with commas, semicolons or blanks."""
    return F.filter(F.split(c, r"[,;\s]+"), lambda x: x != "")
