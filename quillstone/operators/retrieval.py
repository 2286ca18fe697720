"""Dual-view TF-IDF retrieval of techniques: vocabulary, weights, cosine, fusion, parent collapse, top-N.

The catalogue is the build side: its postings are joined on the token, so only pairs with a token in common are ever
formed. Techniques without one still fill a short list, by id; they come from the first N ids of the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import min_max
from ..functions.text import tokens


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf)."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def idf(items: DataFrame, key: str = "technique_id", text: str = "text") -> DataFrame:
    """(token, df, idf) over the catalogue: ln((N+1)/(df+1)) + 1."""
    n = items.agg(F.count("*").alias("n_items")).scalar()
    per = term_counts(items, key, text).groupBy("token").agg(F.count("*").alias("df"))
    return per.select("token", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(df: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, w): (1 + ln tf) idf; tokens outside of the vocabulary are dropped."""
    return term_counts(df, key, text).join(vocabulary.select("token", "idf"), "token").select(key, "token", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def cosine_scores(queries: DataFrame, items: DataFrame, q: str = "query_id", i: str = "technique_id", text: str = "text", digits: int = 12, least: int = 0) -> DataFrame:
    """(q, i, score) for all pairs that share a token, and at score 0 for every query with the ``least`` first ids of the catalogue.

    Zeros join the products before these are summed, so they cost no further shuffle; with the first n ids among the
    scored ones, the n best of a query are always there.
    """
    v = idf(items, i, text)
    a, b = weights(queries, v, q, text), weights(items, v, i, text)
    na = a.groupBy(q).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na"))
    nb = b.groupBy(i).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    products = a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), "token").select(q, i, (F.col("wa") * F.col("wb")).alias("p"))
    if least:
        few = [r[0] for r in items.select(i).distinct().orderBy(i).limit(least).collect()]  # a parameter
        products = products.unionByName(queries.select(q, F.explode(F.array(*map(F.lit, few))).alias(i), F.lit(0.0).alias("p")))
    dot = products.groupBy(q, i).agg(F.sum("p").alias("dot"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb"))))
    return dot.join(na, q, "left").join(nb, i, "left").select(q, i, F.bround(F.when(F.col("dot") > 0, score).otherwise(0.0), digits).alias("score"))


def top_n(scored: DataFrame, q: str, i: str, n: int, *order) -> DataFrame:
    """Rank 1..n within ``q`` by the given order, then by id."""
    w = Window.partitionBy(q).orderBy(*order, F.col(i))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


DENSE_CELLS = 4_000_000


class Catalogue:
    """A catalogue as one matrix of normed word weights: words (by hash, sorted) x items (by id)."""

    def __init__(self, words: np.ndarray, idf_: np.ndarray, ids: np.ndarray, counted: pa.RecordBatch):
        self.words, self.idf, self.ids = words, idf_, ids
        row, word, w = self.weights(counted, "h")
        self.matrix = np.zeros((len(words), len(ids)))
        self.matrix[word, row] = w

    def weights(self, b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, weight) of the known words of a batch with a list column of word hashes; weights of a row have norm 1."""
        lists = b.column(column)
        row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0), np.int64))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.words, flat).clip(0, len(self.words) - 1)
        known = self.words[at] == flat if len(flat) else np.zeros(0, bool)
        pair, tf = np.unique(row[known] * len(self.words) + at[known], return_counts=True)
        row, word = pair // len(self.words), pair % len(self.words)
        w = (1 + np.log(tf)) * self.idf[word]
        norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
        return row, word, w / norm[row]

    def scores(self, b: pa.RecordBatch, column: str, digits: int) -> np.ndarray:
        """Cosines of every row of a batch with every item."""
        row, word, w = self.weights(b, column)
        s = np.zeros((b.num_rows, len(self.ids)))
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            s[row[first]] = np.add.reduceat(self.matrix[word] * w[:, None], first, axis=0)
        return np.round(s.clip(0, 1), digits)


def _hashes(c) -> Column:
    return F.transform(tokens(F.col(c)), lambda t: F.xxhash64(t))


def small_catalogue(items: DataFrame, i: str, dense_cells: int) -> Catalogue | None:
    """The catalogue as a matrix, if its vocabulary times items is at most ``dense_cells`` (checked before anything is collected)."""
    c = items.agg(F.count_distinct(i).alias("n"), F.max(F.length("text")).alias("chars")).first()
    if not c.n or c.n * (c.chars or 0) > dense_cells:
        return None
    vocabulary = idf(items, i).select(F.xxhash64("token").alias("h"), "idf").orderBy("h").limit(dense_cells // c.n + 1).toArrow()
    h = vocabulary.column("h").to_numpy()
    if not len(h) or len(h) * c.n > dense_cells or len(np.unique(h)) < len(h):
        return None
    got = items.select(i, _hashes("text").alias("h")).orderBy(i).toArrow().combine_chunks().to_batches()[0]  # at most dense_cells words
    return Catalogue(h, vocabulary.column("idf").to_numpy(), np.array(got.column(i).to_pylist(), object), got)


def scored(queries: DataFrame, catalogue: Catalogue, views: tuple[str, ...], finish: Callable, schema: str, q: str, i: str, digits: int) -> DataFrame:
    """Queries scored where they stand, without a shuffle: ``finish(views' scores, ids)`` gives (row, item, further columns) of the result."""
    shared = queries.sparkSession.sparkContext.broadcast(catalogue)  # 8 bytes a cell, dense_cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cat = shared.value
        for whole in batches:
            words = sum(np.asarray(whole.column(f"h{k}").value_lengths().fill_null(0), np.int64) for k in range(len(views)))
            size = np.cumsum(np.minimum(words, len(cat.words)) + 8) * len(cat.ids)
            lo = 0
            while lo < whole.num_rows:  # about 4 million cells at a time, a row at least
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + DENSE_CELLS, side="right")))
                b, lo = whole.slice(lo, hi - lo), hi
                row, item, more = finish([cat.scores(b, f"h{k}", digits) for k in range(len(views))], cat.ids)
                named = {q: b.column(q).take(pa.array(row)), i: pa.array(cat.ids[item], pa.string())} | {k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in more.items()}
                yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    kind = queries.schema[q].dataType.simpleString()
    return queries.select(q, *[_hashes(v).alias(f"h{k}") for k, v in enumerate(views)]).mapInArrow(run, f"`{q}` {kind}, `{i}` string, {schema}")


def _best(keys: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, rank) of the k best items of every row by keys, more being better; ties go by id."""
    n, width = keys[0].shape
    k = min(k, width)
    order = np.lexsort([-x for x in keys[::-1]], axis=1)[:, :k]
    return np.repeat(np.arange(n), k), order.ravel(), np.tile(np.arange(1, k + 1, dtype=np.int32), n)


def _blended(alpha: float, t: np.ndarray, s: np.ndarray, digits: int) -> np.ndarray:
    return np.round(alpha * t + (1 - alpha) * s, digits)


def retrieve(queries: DataFrame, items: DataFrame, n: int = 20, q: str = "query_id", i: str = "technique_id", digits: int = 12, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(q, i, score, rank): the n best techniques of every query. A small catalogue is scored as a matrix, a larger one is joined on tokens. ``q`` is unique."""
    cat = small_catalogue(items, i, dense_cells)
    if cat is None:
        return top_n(cosine_scores(queries, items, q, i, digits=digits, least=n), q, i, n, F.desc("score"))

    def finish(views, ids):
        row, item, rank = _best(views, n)
        return row, item, {"score": views[0][row, item], "rank": rank}

    return scored(queries, cat, ("text",), finish, "score double, rank int", q, i, digits)


def retrieve_grid(queries: DataFrame, items: DataFrame, alphas: list[float], n: int, q: str = "query_id", i: str = "technique_id", digits: int = 12, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(q, i, alpha, score_fused, score_text, score_structure, rank): the n best of every query for every alpha. ``queries`` has columns text and structure."""
    cat = small_catalogue(items, i, dense_cells)
    if cat is None:
        a = cosine_scores(queries, items, q, i, digits=digits, least=n)
        b = cosine_scores(queries.select(q, F.col("structure").alias("text")), items, q, i, digits=digits)
        return grid(fuse_views(a, b, 0.0, q, i, digits), alphas, n, q, i, digits)

    def finish(views, ids):
        t, s = views
        parts = []
        for alpha in alphas:
            f = _blended(alpha, t, s, digits)
            row, item, rank = _best([f, t, s], n)
            parts.append((row, item, np.full(len(row), alpha), f[row, item], t[row, item], s[row, item], rank))
        row, item, *more = (np.concatenate(x) for x in zip(*parts))
        return row, item, dict(zip(("alpha", "score_fused", "score_text", "score_structure", "rank"), more))

    return scored(queries, cat, ("text", "structure"), finish, "alpha double, score_fused double, score_text double, score_structure double, rank int", q, i, digits)


def retrieve_parents(queries: DataFrame, items: DataFrame, alpha: float, q: str = "query_id", i: str = "technique_id", digits: int = 12, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """The best child of every parent and query (see ``collapse_to_parent``), over all techniques."""
    cat = small_catalogue(items, i, dense_cells)
    if cat is None:
        ids = items.select(i).distinct().count()
        a = cosine_scores(queries, items, q, i, digits=digits, least=ids)
        b = cosine_scores(queries.select(q, F.col("structure").alias("text")), items, q, i, digits=digits)
        return collapse_to_parent(fuse_views(a, b, alpha, q, i, digits), q, i)
    parents = np.array([x.split(".")[0] for x in cat.ids], object)
    names, of = np.unique(parents.astype(str), return_inverse=True)
    by_parent = np.argsort(of, kind="stable")
    start = np.searchsorted(of[by_parent], np.arange(len(names)))
    children = pa.array([list(cat.ids[of == k]) for k in range(len(names))], pa.list_(pa.string()))

    def finish(views, ids):
        t, s = views
        f = _blended(alpha, t, s, digits)
        order = np.lexsort((-s, -t, -f), axis=1)
        rank = np.argsort(order, axis=1)
        best = np.take_along_axis(order, np.minimum.reduceat(rank[:, by_parent], start, axis=1), axis=1).ravel()
        row, parent = np.repeat(np.arange(len(t)), len(names)), np.tile(np.arange(len(names)), len(t))
        more = {"score_fused": f[row, best], "score_text": t[row, best], "score_structure": s[row, best]}
        own = {i: pa.array(names[parent], pa.string()), "representative_technique_id": pa.array(ids[best], pa.string()), "source_technique_ids": children.take(pa.array(parent))}
        return row, best, own | more

    schema = "representative_technique_id string, source_technique_ids array<string>, score_fused double, score_text double, score_structure double"
    out = scored(queries, cat, ("text", "structure"), finish, schema, q, i, digits)
    return out.select(q, i, "score_fused", "score_text", "score_structure", "representative_technique_id", "source_technique_ids")


def retrieve_scaled(queries: DataFrame, items: DataFrame, q: str = "query_id", i: str = "technique_id", digits: int = 12, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(q, i, score, scaled): every query with every technique, its score and the score on the scale from the query's lowest (0) to its highest (1)."""
    cat = small_catalogue(items, i, dense_cells)
    if cat is None:
        ids = items.select(i).distinct().count()
        return cosine_scores(queries, items, q, i, digits=digits, least=ids).withColumn("scaled", min_max(F.col("score"), q))

    def finish(views, ids):
        t = views[0]
        low, high = t.min(axis=1, keepdims=True), t.max(axis=1, keepdims=True)
        wide = high - low > 1e-15
        scaled_ = np.where(wide, (t - low) / np.where(wide, high - low, 1.0), 0.0)
        row, item = np.repeat(np.arange(len(t)), t.shape[1]), np.tile(np.arange(t.shape[1]), len(t))
        return row, item, {"score": t.ravel(), "scaled": scaled_.ravel()}

    return scored(queries, cat, ("text",), finish, "score double, scaled double", q, i, digits)


def fuse_views(text_scores: DataFrame, structure_scores: DataFrame, alpha: float, q: str = "query_id", i: str = "technique_id", digits: int = 12) -> DataFrame:
    """(q, i, score_fused, score_text, score_structure): a pair missing in one view has 0 there."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = text_scores.withColumnRenamed("score", "_t").join(structure_scores.withColumnRenamed("score", "_s"), [q, i], "full_outer")
    fused = F.bround(alpha * zero("_t") + (1 - alpha) * zero("_s"), digits)
    return both.select(q, i, fused.alias("score_fused"), zero("_t").alias("score_text"), zero("_s").alias("score_structure"))


ORDER = (F.desc, "score_fused"), (F.desc, "score_text"), (F.desc, "score_structure")


def collapse_to_parent(fused: DataFrame, q: str = "query_id", i: str = "technique_id") -> DataFrame:
    """The best child of every parent by fused, text and structure score and id, under the parent's id, with all its children in order."""
    parent = F.element_at(F.split(i, r"\."), 1)
    p = fused.withColumn("_parent", parent)
    best = F.min_by(F.struct(*fused.columns), F.struct(*[-F.col(c) for _, c in ORDER], F.col(i)))
    g = p.groupBy(q, "_parent").agg(best.alias("b"), F.array_sort(F.collect_set(i)).alias("source_technique_ids"))  # children of one parent
    return g.select(q, F.col("_parent").alias(i), *[F.col(f"b.{c}").alias(c) for _, c in ORDER], F.col(f"b.{i}").alias("representative_technique_id"), "source_technique_ids")


def grid(fused_input: DataFrame, alphas: list[float], n: int, q: str = "query_id", i: str = "technique_id", digits: int = 12) -> DataFrame:
    """Ranks for every alpha from scores computed once: (q, i, alpha, score_fused, score_text, score_structure, rank)."""
    each = fused_input.select(q, i, "score_text", "score_structure", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    each = each.withColumn("score_fused", F.bround(F.col("alpha") * F.col("score_text") + (1 - F.col("alpha")) * F.col("score_structure"), digits))
    w = Window.partitionBy("alpha", q).orderBy(F.desc("score_fused"), F.desc("score_text"), F.desc("score_structure"), i)
    ranked = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select(q, i, "alpha", "score_fused", "score_text", "score_structure", "rank")
