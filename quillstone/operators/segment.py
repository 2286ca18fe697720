"""Cutting vulnerability descriptions into citable evidence units E1..En that reconstruct the canonical text.

A canonical text holds single blanks only, so a division is a sorted list of blanks that stand between units. Every rule
adds or removes members of that list and no text is moved; units joined by one blank are the text again, whatever the rules.

Defined cases: null and blank texts have no units; a word longer than ``max_chars`` is not cut, its unit is as long as the word.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical

#: Endings after which a period closes no sentence.
NO_STOP = ("e.g.", "i.e.", "etc.", "vs.", "fig.", "no.", "mr.", "mrs.", "ms.", "dr.", "prof.", "u.s.", "u.k.")
#: Fixed value: what may follow the blank at which a clause is cut.
CLAUSE = re.compile(
    r"\s+(?=(?:which\s+(?:allows?|could\s+allow|may\s+allow|can\s+allow)\b|allows?\b|allowing\b|resulting\s+in\b|leading\s+to\b|thereby\b|due\s+to\b|because\b|via\b|through\b|when\b|if\b|by\s+[A-Za-z][A-Za-z-]*ing\b))",
    re.IGNORECASE,
)
#: Fixed value: marks that end a sentence, with the quotes and brackets that close after them.
STOP = re.compile(r"[.!?]+[\"')\]]*(?= )")
#: The average length up to which four or more parts between semicolons are a list and stay together.
LIST_PART = 55


def stops(text: str) -> list[int]:
    """Blanks after a full stop: what follows must look like the start of a sentence, and a period must not be part of a number or an abbreviation."""
    found = []
    for m in STOP.finditer(text):
        at, after = m.end(), text[m.end() + 1]
        starts = after.isupper() or after.isdigit() or after in "\"'([*"
        if m[0][0] == ".":
            number = after.isdigit() and text[max(m.start() - 1, 0)].isdigit() and m.start() > 0
            starts = starts and not number and not text[max(at - 6, 0) : at].lower().endswith(NO_STOP)
        if starts:
            found.append(at)
    return found


def between_semicolons(text: str, a: int, e: int) -> list[int]:
    """Blanks after semicolons of text[a:e], or none if it is a list of short parts."""
    sizes = [len(p.strip()) for p in text[a:e].split(";") if p.strip()]
    if len(sizes) >= 4 and sum(sizes) <= LIST_PART * len(sizes):
        return []
    return [i for i in range(a, e - 1) if text[i] == " " and text[i - 1] == ";" and i > a]


def divided(cuts: list[int], length: int, rule) -> list[int]:
    """``cuts`` and what ``rule(start, end)`` finds in each of their units."""
    edges = [-1, *cuts, length]
    return sorted({*cuts, *(c for a, e in zip(edges, edges[1:]) for c in rule(a + 1, e))})


def apart(blanks: Iterable[int], a: int, e: int, least: int) -> list[int]:
    """Those blanks, from the left, that leave ``least`` characters since the last one taken and up to ``e``."""
    taken: list[int] = []
    for q in blanks:
        if q - a >= least and e - q - 1 >= least:
            taken.append(q)
            a = q + 1
    return taken


def wrapped(text: str, blanks: np.ndarray, a: int, e: int, most: int, least: int) -> list[int]:
    """Blanks at which a unit of more than ``most`` characters is wrapped: the last one in reach, after a comma if there is any."""
    taken, low = [], max(least, int(most * 0.55))
    while e - a > most:
        i, j = np.searchsorted(blanks, (a + low, a + most + 1))
        reach = [int(q) for q in blanks[i:j] if q < e]
        if not reach:  # a word beyond the limit: up to its end
            k = int(np.searchsorted(blanks, a + most + 1))
            if k == len(blanks) or blanks[k] >= e:
                break
            reach = [int(blanks[k])]
        taken.append(max([q for q in reach if text[q - 1] == ","] or reach))
        a = taken[-1] + 1
    return taken


def without_short(cuts: list[int], length: int, least: int) -> list[int]:
    """Cuts before units of ``least`` characters or more; a short first unit joins the next one."""
    ends = [*cuts[1:], length]
    kept = [c for c, e in zip(cuts, ends) if e - c - 1 >= least]
    return kept[1:] if kept and kept[0] < least else kept


def at_most(cuts: list[int], length: int, units: int) -> list[int]:
    """Cuts left when the two neighbours that are shortest together, the first of equals, are joined until there are ``units``."""
    before = {c: p for c, p in zip(cuts, [-1, *cuts])}
    after = {c: n for c, n in zip(cuts, [*cuts[1:], length])}
    span = lambda c: after[c] - before[c]
    queue = [(span(c), c) for c in cuts]
    heapq.heapify(queue)
    while len(before) >= units and queue:
        size, c = heapq.heappop(queue)
        if c not in before or size != span(c):
            continue
        p, n = before.pop(c), after.pop(c)
        for cut, side, far in ((p, after, n), (n, before, p)):
            if cut in side:
                side[cut] = far
                heapq.heappush(queue, (span(cut), cut))
    return sorted(before)


def unit_spans(text: str, aggressive: bool = False, max_chars: int = 420, min_chars: int = 24, max_evidence: int = 12) -> list[tuple[int, int]]:
    """(start, end) of the units of a canonical text."""
    if min_chars < 1 or max_evidence < 1 or max_chars < max(2 * min_chars, 40):
        raise ValueError("min_chars and max_evidence must be positive, and max_chars at least 40 and twice min_chars")
    n = len(text)
    cuts = stops(text)
    if aggressive:
        cuts = divided(cuts, n, lambda a, e: apart(between_semicolons(text, a, e), a, e, min_chars))
        clauses = [m.start() for m in CLAUSE.finditer(text)]
        cuts = divided(cuts, n, lambda a, e: apart(clauses[bisect_right(clauses, a) : bisect_right(clauses, e - 1)], a, e, min_chars))
    if n > max_chars:
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        cuts = divided(cuts, n, lambda a, e: wrapped(text, blanks, a, e, max_chars, min_chars))
    cuts = at_most(without_short(cuts, n, min_chars), n, max_evidence)
    return list(zip([0, *(c + 1 for c in cuts)], [*cuts, n])) if text else []


def evidence_units(text: str, **how) -> list[str]:
    """The units of a canonical text."""
    return [text[a:e] for a, e in unit_spans(text, **how)]


def segment(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    """(key, ord, evidence_id, text): the units of every row's canonical text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [evidence_units(t, **how) for t in b.column("_t").to_pylist()]
            n = np.array([len(c) for c in cuts], np.int64)
            no = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
            cols = [
                b.column(key).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(no.astype(np.int32)),
                pa.array([f"E{k}" for k in no], pa.string()), pa.array([p for c in cuts for p in c], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "ord", "evidence_id", "text"])

    rows = df.select(key, canonical(F.col(text)).alias("_t")).where("_t <> ''")
    return rows.mapInArrow(run, f"`{key}` {kind}, ord int, evidence_id string, text string")


def spans(units: DataFrame, key: str) -> DataFrame:
    """Units with their offsets in the canonical text and their hash: units are joined by one blank."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return units.select("*", start.alias("start")).withColumn("end", F.col("start") + F.length("text")).withColumn("text_sha256", F.sha2("text", 256))
