"""Values a user writes as text: grids, lists of cut-offs, metric names, selections out of what is configured."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _parts(text: str) -> list[str]:
    found = [p.strip() for p in text.split(",") if p.strip()]
    if not found:
        raise ValueError("no values given")
    return found


def shares(text: str, digits: int = 12) -> list[float]:
    """Sorted different numbers in [0, 1] of a comma-separated text."""
    values = sorted({round(float(p), digits) for p in _parts(text)})
    if values[0] < 0 or values[-1] > 1:
        raise ValueError(f"not in [0, 1]: {text}")
    return values


def counts(text: str) -> list[int]:
    """Sorted different positive whole numbers of a comma-separated text."""
    values = sorted({int(p) for p in _parts(text)})
    if values[0] <= 0:
        raise ValueError(f"not positive: {text}")
    return values


def metric(text: str) -> tuple[str, int | None]:
    """``mrr`` or a name with a cut-off, such as ``hit@5``."""
    t = text.strip().lower()
    if t == "mrr":
        return t, None
    m = re.fullmatch(r"(hit|precision|recall|ap)@([1-9]\d*)", t)
    if not m:
        raise ValueError("give mrr or one of hit@K, precision@K, recall@K, ap@K")
    return m[1], int(m[2])


def chosen(wanted: list, configured: list) -> list:
    """``wanted`` in its order and once each, all of which must be configured; without any, all that is configured."""
    unknown = [w for w in wanted if w not in configured]
    if unknown:
        raise ValueError(f"not configured: {unknown}; there are {configured}")
    return list(dict.fromkeys(wanted)) or list(configured)


def first_ids(ids: DataFrame, split: str, n: int) -> DataFrame:
    """The first n ids of every split by id, for a short trial run; all of them if n is 0."""
    from pyspark.sql import Window

    if n <= 0:
        return ids
    w = Window.partitionBy(split).orderBy("input_id")
    return ids.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def exactly(df: DataFrame, ids: DataFrame, policy: str = "exact") -> DataFrame:
    """The rows of given ids; ``exact`` refuses ids that have none and rows of other ids, ``subset`` only the former."""
    lost = ids.join(df.select("input_id").distinct(), "input_id", "left_anti").limit(3).collect()
    extra = df.join(ids.select("input_id"), "input_id", "left_anti").select("input_id").limit(3).collect() if policy == "exact" else []
    if lost or extra:
        raise ValueError(f"ids without rows: {[r[0] for r in lost]}; rows of other ids: {[r[0] for r in extra]}")
    return df.join(ids.select("input_id").distinct(), "input_id", "left_semi")
