"""Problem 9: long exact spans shared between records.

Two operators.

``unit_dedup`` is the method named for the problem: lines or paragraphs are hashed, digests are grouped globally, the
earliest ranked occurrence is kept and the rest is removed, with original offsets. It cannot find a run that starts or
ends inside a unit, which the problem asks for, so the required result comes from ``sharing_pairs`` and ``spans``:

These take the same steps with units that no edit elsewhere can shift. Units are the windows of ``GRAM`` code
points whose hash is the least of ``WINDOW`` neighbouring ones (winnowing); with ``GRAM + WINDOW - 1 = 200`` every run of
200 code points contains a unit that is chosen in every text that has the run. Digests held by one text only are dropped,
and the rest are grouped globally with up to 100 code points on either side; a pair of occurrences counts only where
these are equal, character by character, over at least 200 code points. Exact copies of whole texts are one class,
compared once, whose pairs are made at the end. ``spans`` needs no pairs: see ``extents``.

Defined cases: null and empty texts share nothing; texts are compared as stored, without any normalisation; a run that
is repeated within one text is not shared with itself; the length is counted in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

RUN = 200
GRAM = 100
WINDOW = RUN - GRAM + 1
REACH = RUN - GRAM
PERIOD = 12
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base
    while have < n:
        m = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have : have + m] = out[:m] * np.uint64(step)
        step = step * step & (2**64 - 1)
        have += m
    return out[:n]


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, text numbers, positions, more) of the chosen windows of all texts.

    The choice in a window goes by the upper half of the hash, the rightmost of equals; it depends on the window alone.
    In text of a short period every window chooses the same digest. Units of such a chain that have ``reach`` code points of
    it on either side all have the same surroundings: the first stands for them, and the last stands ``more`` behind it.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    per = np.array([len(r) // 4 for r in raw], np.int64)
    end = np.cumsum(per)
    c = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    n = len(c) - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    with np.errstate(over="ignore"):
        s = np.r_[np.uint64(0), np.cumsum((c + np.uint64(1)) * _powers(BASE, len(c)), dtype=np.uint64)]
        h = (s[gram:] - s[:-gram]) * _powers(INVERSE, n)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    low, span = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)), 1
    while span * 2 <= window:  # low[i]: least of the span values from i on
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = n - window + 1
    low = np.minimum(low[:m], low[window - span : window - span + m])
    doc = np.repeat(np.arange(len(per)), per)
    inside = np.arange(m) + window + gram - 1 <= end[doc[:m]]
    chosen = np.zeros(n, bool)
    chosen[(np.uint64(0xFFFFFFFF) - (low[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    more = np.zeros(len(at), np.int64)
    if len(at) > 2:
        first = np.flatnonzero(np.r_[True, (np.diff(at) > PERIOD) | (h[at[1:]] != h[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])])  # of every chain
        size = np.diff(np.r_[first, len(at)])
        inner = (at - np.repeat(at[first], size) >= reach) & (np.repeat(at[first + size - 1], size) - at >= reach)
        lead = inner & ~np.r_[False, inner[:-1]]
        last = inner & ~np.r_[inner[1:], False]
        more[lead] = at[last] - at[lead]
        at, more = at[~inner | lead], more[~inner | lead]
    d = doc[at]
    return h[at].view(np.int64), d, at - (end - per)[d], more


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): doc_id with its class; the text of every class of at least ``RUN`` code points."""
    d = documents.where(F.length("text") >= RUN).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    c = materialise(d.groupBy("digest").agg(F.min("doc_id").alias("cls"), F.first("text").alias("text")), "texts")
    members = materialise(d.select("doc_id", "digest").join(c.select("digest", "cls"), "digest").select("doc_id", "cls"), "members")
    return members, c.select("cls", "text")


def fingerprints(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:  # about a million code points at a time, a text at least
                texts, size = [], 0
                while at + len(texts) < b.num_rows and size < 1_000_000:
                    texts.append(b.column("text")[at + len(texts)].as_py())
                    size += len(texts[-1])
                h, d, pos, more = winnow(texts)
                ids = b.column("cls").slice(at, len(texts)).take(pa.array(d))
                yield pa.RecordBatch.from_arrays([pa.array(h), ids, pa.array(pos), pa.array(more)], names=["digest", "cls", "pos", "more"])
                at += len(texts)

    return classes.mapInArrow(run, "digest long, cls long, pos long, more long")


def occurrences(classes: DataFrame) -> DataFrame:
    """Units that at least two classes hold, with the code points around them. Texts are read again only for classes that have one."""
    f = materialise(fingerprints(classes), "fingerprints")
    shared = f.groupBy("digest").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("digest")
    at = f.join(shared, "digest", "left_semi").groupBy("cls").agg(F.collect_list(F.struct("digest", "pos", "more")).alias("units"))  # at most one unit a code point of the text
    with_text = at.join(classes, "cls")
    u = with_text.select("cls", "text", F.explode("units").alias("u")).select(
        F.col("u.digest").alias("digest"), "cls", F.col("u.pos").alias("pos"), F.col("u.more").alias("more"),
        F.expr(f"substring(text, cast(greatest(u.pos - {REACH}, 0) as int) + 1, cast(least(u.pos, {REACH}) as int))").alias("before"),
        F.expr(f"substring(text, cast(u.pos as int) + 1, {GRAM})").alias("unit"),
        F.expr(f"substring(text, cast(u.pos as int) + {GRAM} + 1, {REACH})").alias("after"),
    )
    return materialise(u, "occurrences")


def _equal_tail(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if n == 0 or a[len(a) - n :] == b[len(b) - n :]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[len(a) - m :] == b[len(b) - m :]:
            lo = m
        else:
            hi = m - 1
    return lo


def _equal_head(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[:m] == b[:m]:
            lo = m
        else:
            hi = m - 1
    return lo


def matches(occ: DataFrame) -> DataFrame:
    """(digest, cls_a, rep_a, cls_b, rep_b, head, tail): units of two classes that stand in an equal stretch of at least ``RUN`` code points.

    Occurrences of a class with the same surroundings are compared once, by their first position ``rep``.
    """
    rep = occ.groupBy("digest", "cls", "before", "unit", "after").agg(F.min("pos").alias("rep"))
    side = lambda s: rep.select("digest", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "rep", "before", "unit", "after")])
    pairs = side("a").join(side("b"), "digest").where("cls_a < cls_b and unit_a = unit_b").drop("unit_a", "unit_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = np.fromiter((_equal_tail(x, y) for x, y in zip(b.column("before_a").to_pylist(), b.column("before_b").to_pylist())), np.int32, b.num_rows)
            tail = np.fromiter((_equal_head(x, y) for x, y in zip(b.column("after_a").to_pylist(), b.column("after_b").to_pylist())), np.int32, b.num_rows)
            at = np.flatnonzero(head + GRAM + tail >= RUN)
            i = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(i) for c in ("digest", "cls_a", "rep_a", "cls_b", "rep_b")), pa.array(head[at]), pa.array(tail[at])], names=["digest", "cls_a", "rep_a", "cls_b", "rep_b", "head", "tail"])

    return pairs.mapInArrow(check, "digest long, cls_a long, rep_a long, cls_b long, rep_b long, head int, tail int")


def sharing_pairs(documents: DataFrame) -> DataFrame:
    """Every pair of documents with a run in common."""
    members, classes = _classes(documents)
    a, b = (members.select(F.col("doc_id").alias(f"doc_{s}"), F.col("cls").alias(f"cls_{s}")) for s in "ab")
    between = matches(occurrences(classes)).select("cls_a", "cls_b").distinct().join(a, "cls_a").join(b, "cls_b").select("doc_a", "doc_b")
    copies = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("cls_a"))
    within = a.join(copies, "cls_a").join(b, F.col("cls_a") == F.col("cls_b")).where("doc_a < doc_b").select("doc_a", "doc_b")
    both = between.unionByName(within)
    return both.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))


#: Up to this many different surroundings of a unit are compared with each other; more of them by all their runs. Both ways are exact.
COMPARED = 128


def extents(occ: DataFrame, compared: int = COMPARED) -> DataFrame:
    """(digest, cid, left, right): how far from a unit the runs reach that stand in another class too, per different surroundings ``cid`` of it.

    Classes with equal surroundings are one row, whatever their number. Surroundings of one class only are compared with the unit's other
    surroundings, or, where there are many, each of their at most 101 runs of ``RUN`` code points is hashed and grouped, so the work for a unit
    grows in proportion to its surroundings.
    """
    ctx = occ.groupBy("digest", "cid").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), *[F.first(c).alias(c) for c in ("before", "unit", "after")])
    per = ctx.groupBy("digest").agg(F.count("*").alias("k"))
    ctx = materialise(ctx.join(per, "digest"), "surroundings")
    both = ctx.where("lo <> hi").select("digest", "cid", F.length("before").alias("left"), F.length("after").alias("right"))
    few = ctx.where(F.col("k").between(2, compared))
    side = lambda s: few.select("digest", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "lo", "hi", "before", "unit", "after")])
    # one side has surroundings of its own; the other side is in another class
    j = side("a").where("lo_a = hi_a").join(side("b"), "digest").where("cid_a <> cid_b and unit_a = unit_b and (lo_b <> lo_a or hi_b <> lo_a)")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.fromiter((_equal_tail(x, y) for x, y in zip(b.column("before_a").to_pylist(), b.column("before_b").to_pylist())), np.int32, b.num_rows)
            right = np.fromiter((_equal_head(x, y) for x, y in zip(b.column("after_a").to_pylist(), b.column("after_b").to_pylist())), np.int32, b.num_rows)
            at = np.flatnonzero(left + GRAM + right >= RUN)
            i = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("digest").take(i), b.column("cid").take(i), pa.array(left[at]), pa.array(right[at])], names=["digest", "cid", "left", "right"])

    near = j.select("digest", F.col("cid_a").alias("cid"), "before_a", "before_b", "after_a", "after_b").mapInArrow(check, "digest long, cid string, left int, right int")
    text = F.concat("before", "unit", "after")
    # runs with n code points before the unit, where that many stand before and the rest after it
    n = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(REACH) - F.length("after")), F.length("before"))).alias("n")
    possible = F.length("before") + F.length("after") >= REACH
    many = ctx.where((F.col("k") > compared) & possible).select("digest", "cid", "lo", "hi", text.alias("text"), F.length("before").alias("size"), n)
    runs = many.select("digest", "cid", "lo", "hi", "n", F.md5(F.substr("text", F.col("size") - F.col("n") + 1, F.lit(RUN))).alias("run"))
    shared = runs.groupBy("digest", "run").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("digest", "run")
    found = runs.where("lo = hi").join(shared, ["digest", "run"], "left_semi").groupBy("digest", "cid").agg(F.max("n").alias("left"), (F.lit(REACH) - F.min("n")).alias("right"))
    every = both.unionByName(near).unionByName(found)
    return every.groupBy("digest", "cid").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def spans(documents: DataFrame, compared: int = COMPARED) -> tuple[DataFrame, DataFrame]:
    """(members, spans): the merged spans (s, e) of every class of texts that stand in another document too. No pairs of documents are made."""
    members, classes = _classes(documents)
    cid = F.md5(F.concat_ws(":", F.length("before"), F.concat("before", "unit", "after")))
    occ = materialise(occurrences(classes).withColumn("cid", cid), "placed")
    each = occ.select("digest", "cid", "cls", "pos", "more").join(extents(occ, compared), ["digest", "cid"])
    each = each.select("cls", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("more") + GRAM + F.col("right")).alias("e"))
    n = members.groupBy("cls").agg(F.count("*").alias("n"))
    whole = n.where("n > 1").join(classes, "cls").select("cls", F.lit(0).cast("long").alias("s"), F.length("text").cast("long").alias("e"))
    each = each.unionByName(whole).groupBy("cls", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("cls").orderBy("s")  # the spans of one text
    gap = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("s")
    each = each.withColumn("new", gap.cast("int")).withColumn("span", F.sum("new").over(w))
    return members, each.groupBy("cls", "span").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def shared_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end) of every merged span of a document that stands in another one too."""
    members, found = spans(documents)
    return members.join(found, "cls").select("doc_id", F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def shared_amount(documents: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Per document: its code points, how many of them stand elsewhere too, in how many merged spans, and the longest of these."""
    members, found = spans(documents, compared)
    size = F.col("e") - F.col("s")
    per = found.groupBy("cls").agg(F.sum(size).alias("shared_chars"), F.count("*").alias("n_spans"), F.max(size).alias("longest_span"))
    got = members.join(per, "cls").select("doc_id", "shared_chars", "n_spans", "longest_span")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points")).join(got, "doc_id", "left").select("doc_id", "n_code_points", zero("shared_chars"), zero("n_spans"), zero("longest_span"))


def unit_dedup(documents: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, unit_no, start, end, keep) of every line of at least ``least`` code points, white space at its ends aside.

    ``keep`` is true for the occurrence first by doc_id and position of each digest; offsets point into the text as stored.
    Texts are cut at every line feed; blank lines are no units.
    """
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("unit_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    lead = F.length("line") - F.length(F.regexp_replace("line", r"^(?U)\s+", ""))
    unit = at.select("doc_id", "unit_no", (F.col("line_start") + lead).alias("start"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("unit")).where(F.length("unit") >= least)
    unit = unit.select("doc_id", "unit_no", "start", (F.col("start") + F.length("unit")).alias("end"), F.sha2("unit", 256).alias("digest"))
    first = unit.groupBy("digest").agg(F.min(F.struct("doc_id", "unit_no")).alias("first"))
    return unit.join(first, "digest").select("doc_id", "unit_no", "start", "end", ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.unit_no") == F.col("unit_no"))).alias("keep"))
