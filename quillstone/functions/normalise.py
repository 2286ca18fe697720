"""Column normalisers shared by all operators. Every function maps a Column to a Column and stays JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings that mean "no value", compared after trimming, lower-casing and collapsing blanks.
STAND_INS = (
    "", "-", "--", "---", ".", "..", "...", "?", "n/a", "na", "n.a.", "n/k", "nan", "nil", "none", "null", "unknown", "undefined",
    "undisclosed", "tbd", "tba", "tbc", "todo", "pending", "missing", "empty", "not available", "not applicable", "not provided",
    "not specified", "not given", "no value", "no data", "no description", "no description available", "no description available.",
    "no description provided.", "no text", "reserved", "** reserved **", "**reserved**", "rejected", "** rejected **",
    "withheld", "[withheld]", "[withheld until publication]", "withheld until publication", "(none)", "<none>", "[none]", "(null)",
    "<null>", "(unknown)", "(empty)", "<empty>", "[]", "{}", "to be determined", "to be announced",
)


def squeeze(c: Column) -> Column:
    """Trimmed text with every run of white space (Unicode included) as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def usable(c: Column) -> Column:
    """False for null, blank and stand-in texts; never null.

    A text of more words than any stand-in has is told by its beginning, without squeezing all of it.
    """
    longer = c.rlike(r"(?U)^\s*(?:\S+\s+){%d}\S" % max(len(s.split()) for s in STAND_INS))
    return F.coalesce(longer | ~F.lower(squeeze(c)).isin(*STAND_INS), F.lit(False))


def usable_list(c: Column) -> Column:
    """A list is usable if any of its elements is."""
    return F.coalesce(F.exists(c, lambda x: usable(x)), F.lit(False))


def input_id(c: Column) -> Column:
    """Upper case, every run of separators or blanks as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"[^\p{L}\p{Nd}]+", "_"), r"^_+|_+$", "")


def base_id(c: Column) -> Column:
    """``CVE_<year>_<number>`` of an id in any notation, without augmentation suffix; null where there is none."""
    found = F.regexp_extract(input_id(c), r"^(CVE_?\d{4}_\d+)(?:_AUGU?MENTED_?\d*)?$", 1)
    return F.when(found != "", F.regexp_replace(found, r"^CVE_?(\d{4}_)", "CVE_$1"))


def advisory_id(c: Column) -> Column:
    """``ADV-<8 digits>`` of an advisory in any notation; null for stand-ins, pending and all-zero numbers."""
    digits = F.regexp_extract(input_id(c), r"^ADV_?(\d{8})$", 1)
    return F.when((digits != "") & (digits != "00000000"), F.concat(F.lit("ADV-"), digits))


def split_name(c: Column) -> Column:
    """train, development or test from any spelling; null means no split."""
    s = F.lower(squeeze(c))
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("dev", "devel", "development", "valid", "val", "validation"), "development")
        .when(s.isin("test", "testing"), "test")
    )


def key_name(c: Column) -> Column:
    """Lower-case name with underscores, so that ``Advisory Feed`` and ``advisory-feed`` agree; null stays null, blank becomes null."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(s != "", s)


def moment_micros(c: Column) -> Column:
    """Microseconds since 1970 (UTC) of a time given as ISO text, slashed text, ``20 May 2087 08:18 UTC``, epoch seconds or milliseconds.

    A time without zone is UTC; anything unreadable is null.
    """
    s = squeeze(c)
    number = F.expr("cast(null as double)")
    number = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("double")).otherwise(number)
    scaled = F.when(F.abs(number) >= 1e17, number / 1e3).when(F.abs(number) >= 1e14, number).when(F.abs(number) >= 1e11, number * 1e3).otherwise(number * 1e6)
    iso = F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    zoned = F.regexp_replace(iso, r" ?(UTC|GMT|utc|gmt|z)$", "Z")
    zoned = F.regexp_replace(zoned, r"([ T]\d{1,2}:\d{2})(?=$|Z|[+-])", "$1:00")
    zoned = F.when(zoned.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & zoned.rlike(r"[:T]\d{2}"), zoned).otherwise(
        F.when(zoned.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(zoned, F.lit(" 00:00:00Z"))).otherwise(F.concat(zoned, F.lit("Z")))
    )
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    worded = F.regexp_replace(s, r" ?(UTC|GMT|utc|gmt|Z)$", "")
    by_word = F.coalesce(
        *[F.try_to_timestamp(F.concat(worded, F.lit(" +0000")), F.lit(p)) for p in ("d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss Z")]
    )
    return (
        F.when(number.isNotNull(), scaled.cast("long"))
        .when(s.rlike(r"^\d{4}[-/]\d"), F.unix_micros(zoned.try_cast("timestamp")))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "), F.unix_micros(by_word))
    )
