"""Evidence-linked graphs of one record: typed edges, scores, checks, bounded paths, the best explanatory path.

Nodes are rows (input_id, node_id, type, text, evidence_ids, confidence); edges are rows (input_id, src, dst, type, ...).
All joins are within a record.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, token_set

#: Which node types may be linked, and how the link is called.
LAYER_RULES = (
    ("Precondition", "Entry", "enables"),
    ("Precondition", "Behavior", "enables"),
    ("Entry", "VulnType", "characterized_by"),
    ("Entry", "Behavior", "enables"),
    ("VulnType", "Behavior", "enables"),
    ("Behavior", "Impact", "causes"),
)


def drop_alias_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence ids without alias-only units (``aka ...``), unless that would leave none. ``evidence``: (input_id, evidence_id, text)."""
    t = F.lower(F.trim("text"))
    alias = evidence.where(t.startswith("aka ") | (t.contains(" aka ") & (F.length(t) <= 120))).groupBy("input_id").agg(F.collect_set("evidence_id").alias("_alias"))  # units of one record
    j = nodes.join(alias, "input_id", "left")
    kept = F.array_except("evidence_ids", F.coalesce("_alias", F.array().cast("array<string>")))
    return j.withColumn("evidence_ids", F.when(F.size(kept) > 0, kept).otherwise(F.col("evidence_ids"))).drop("_alias")


def layer_rule(src_type: Column, dst_type: Column) -> Column:
    """How a node of one type is linked to one of another; null if no rule links them."""
    return F.coalesce(*[F.when((src_type == a) & (dst_type == b), F.lit(r)) for a, b, r in LAYER_RULES])


def structural_score(evidence: Column, lexical: Column, confidence: Column) -> Column:
    return F.round(0.55 * evidence + 0.25 * lexical + 0.20 * confidence, 6)


def layer_edges(nodes: DataFrame) -> DataFrame:
    """All pairs of a record that a layer rule links, with the evidence overlap and the structural score."""
    side = lambda s: nodes.select("input_id", F.col("node_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("type", "text", "evidence_ids", "confidence")])
    rule = layer_rule(F.col("src_type"), F.col("dst_type"))
    after = F.coalesce(*[F.when(F.col("src_type") == a, F.array(*[F.lit(b) for x, b, _ in LAYER_RULES if x == a])) for a in dict.fromkeys(x for x, _, _ in LAYER_RULES)])
    # the wanted type is part of the key, so only linked layers meet
    src = side("src").withColumn("dst_type", F.explode(after))
    j = src.join(side("dst"), ["input_id", "dst_type"]).withColumn("type", rule)
    ev = jaccard(F.col("src_evidence_ids"), F.col("dst_evidence_ids"))
    lex = jaccard(token_set(F.col("src_text")), token_set(F.col("dst_text")))
    conf = (F.coalesce("src_confidence", F.lit(0.5)) + F.coalesce("dst_confidence", F.lit(0.5))) / 2
    return j.select(
        "input_id", "src", "dst", "type", F.array_intersect("src_evidence_ids", "dst_evidence_ids").alias("shared_evidence_ids"),
        ev.alias("evidence_jaccard"), lex.alias("lexical_jaccard"), conf.alias("confidence_mean"), structural_score(ev, lex, conf).alias("structural_score"),
    )


def dedupe_edges(edges: DataFrame, *order) -> DataFrame:
    """One edge per (record, source, target, type), the first by ``order``."""
    w = Window.partitionBy("input_id", "src", "dst", "type").orderBy(*order)
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def trace_edges(nodes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(input_id, src, dst, type): the record mentions its nodes, and nodes are supported by their evidence. ``chosen``: (input_id, node_id), only these nodes."""
    n = nodes if chosen is None else nodes.join(chosen.select("input_id", "node_id"), ["input_id", "node_id"], "left_semi")
    a = n.select("input_id", F.concat(F.lit("CVE::"), F.col("input_id").cast("string")).alias("src"), F.col("node_id").alias("dst"), F.lit("mentions").alias("type"))
    b = n.select("input_id", F.col("node_id").alias("src"), F.explode("evidence_ids").alias("e"))
    return a.unionByName(b.select("input_id", "src", F.concat(F.lit("EVIDENCE::"), "e").alias("dst"), F.lit("supported_by").alias("type")))


def edge_score(structural: Column, confidence: Column, score: Column, default: float = 0.5) -> Column:
    """The first of three that is a number, clamped to [0, 1]."""
    first = F.coalesce(*[F.nanvl(c, F.lit(None).cast("double")) for c in (structural, confidence, score)], F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), first))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node of the record."""
    ids = nodes.select("input_id", F.col("node_id").alias("_id")).distinct()
    a = edges.join(ids, (edges.input_id == ids.input_id) & (edges.src == ids._id), "left_anti").select("input_id", "src", "dst", "type", F.lit("src").alias("missing"))
    b = edges.join(ids, (edges.input_id == ids.input_id) & (edges.dst == ids._id), "left_anti").select("input_id", "src", "dst", "type", F.lit("dst").alias("missing"))
    return a.unionByName(b)


def stats(nodes: DataFrame) -> DataFrame:
    """Per record: nodes of every type, and whether the core chain is complete."""
    types = ("Precondition", "Entry", "VulnType", "Behavior", "Impact")
    n = {t: F.sum((F.col("type") == t).cast("int")) for t in types}
    return nodes.groupBy("input_id").agg(F.count("*").alias("n_nodes"), *[n[t].alias(f"n_{t.lower()}") for t in types], ((n["Entry"] > 0) & (n["Behavior"] > 0) & (n["Impact"] > 0)).alias("complete_core"))


def support_map(nodes: DataFrame) -> DataFrame:
    """(input_id, evidence_id, node_ids): the nodes of a record each unit supports."""
    return nodes.select("input_id", "node_id", F.explode("evidence_ids").alias("evidence_id")).groupBy("input_id", "evidence_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def simple_paths(nodes: DataFrame, edges: DataFrame, max_nodes: int = 4) -> DataFrame:
    """All simple paths of a record with up to ``max_nodes`` nodes along edges, from nodes that have evidence, with the sums a ranking needs.

    A listing of every path; ``best_path`` finds the first one without it. ``max_nodes`` bounds the joins, and the layer rules the length.
    """
    n = nodes.select("input_id", "node_id", F.col("type").alias("ntype"), F.coalesce("confidence", F.lit(0.5)).alias("conf"), F.size("evidence_ids").alias("n_ev"))
    e = edges.groupBy("input_id", "src", "dst").agg(F.max("structural_score").alias("score"), F.max(F.size("shared_evidence_ids")).alias("shared"))
    zero = F.lit(0.0)
    step = n.where("n_ev > 0").select(
        "input_id", F.array("node_id").alias("path"), F.array("ntype").alias("types"), zero.alias("score_sum"), F.lit(0).alias("shared_sum"),
        F.lit(0).alias("continuous"), F.col("conf").alias("conf_sum"), F.col("node_id").alias("last"),
    )
    found = step
    for _ in range(max_nodes - 1):
        j = step.join(e.withColumnRenamed("src", "last"), ["input_id", "last"]).where(~F.array_contains("path", F.col("dst")))
        j = j.join(n.select("input_id", F.col("node_id").alias("dst"), "ntype", "conf"), ["input_id", "dst"])
        step = j.select(
            "input_id", F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("ntype")).alias("types"), (F.col("score_sum") + F.col("score")).alias("score_sum"),
            (F.col("shared_sum") + F.col("shared")).alias("shared_sum"), (F.col("continuous") + (F.col("shared") > 0).cast("int")).alias("continuous"),
            (F.col("conf_sum") + F.col("conf")).alias("conf_sum"), F.col("dst").alias("last"),
        )
        found = found.unionByName(step)
    return found.drop("last")


CORE = ("Entry", "Behavior", "Impact")


def ordered_core(types: np.ndarray) -> np.ndarray:
    """How many of Entry, Behavior and Impact stand in this order in each row of types (numbers of CORE, else negative): each is looked for after the last one found."""
    n, width = types.shape
    found, last = np.zeros(n, np.int64), np.full(n, -1)
    for k in range(len(CORE)):
        hit = (types == k) & (np.arange(width) > last[:, None])
        there = hit.any(axis=1)
        last = np.where(there, hit.argmax(axis=1), last)
        found += there
    return found


def cover_sizes(masks: np.ndarray) -> np.ndarray:
    """Size of the least set of bits that meets every mask of a row (-1, all bits, for places beyond the path).

    One bit serves a block of masks if their conjunction isn't 0, so this is the least number of blocks the row can be divided into.
    """
    n, width = masks.shape
    joint: dict[int, np.ndarray] = {}
    for part in range(1, 1 << width):
        low = (part & -part).bit_length() - 1
        rest = part & (part - 1)
        joint[part] = masks[:, low] if not rest else masks[:, low] & joint[rest]
    best = {0: np.zeros(n, np.int64)}
    for part in range(1, 1 << width):
        low, rest = part & -part, part & (part - 1)
        least, sub = np.full(n, width + 1), rest
        while True:  # the block of the lowest place
            least = np.minimum(least, np.where(joint[sub | low] != 0, best[rest ^ sub] + 1, width + 1))
            if not sub:
                break
            sub = (sub - 1) & rest
        best[part] = least
    return best[(1 << width) - 1]


def _node(*more: Column | str) -> Column:
    return F.struct("node_id", "type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "evidence_ids", *more)


def records(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """(input_id, n, e): the graph of one record in one row, of nodes that have evidence. ``more``: further columns of nodes that ``n`` shall have."""
    e = edges if "explicit" in edges.columns else edges.withColumn("explicit", F.lit(False))
    held = nodes.where(F.size("evidence_ids") > 0).groupBy("input_id").agg(F.collect_list(_node(*more)).alias("n"))  # one record's nodes
    first = F.struct(F.coalesce("explicit", F.lit(False)), "structural_score")
    pair = e.groupBy("input_id", "src", "dst").agg(F.max(first).alias("x"))
    links = pair.groupBy("input_id").agg(F.collect_list(F.struct("src", "dst", F.col("x.col1").alias("explicit"), F.col("x.structural_score").alias("score"))).alias("e"))
    return held.join(links, "input_id", "left")


def layered_records(nodes: DataFrame, *more: str) -> DataFrame:
    """(input_id, n): ``records`` of nodes and their ``layer_edges``, which the search makes from the row. ``more`` must have their texts."""
    return nodes.where(F.size("evidence_ids") > 0).groupBy("input_id").agg(F.collect_list(_node(*more)).alias("n"))  # one record's nodes


FOUND = "path array<string>, types array<string>, complete boolean, core_coverage int, continuity double, mean_shared double, explicit_ratio double, cover_size int, mean_score double, mean_confidence double, n_paths long"


def best_paths(nodes: DataFrame, edges: DataFrame, max_nodes: int = 4, exact_limit: int = 20) -> DataFrame:
    """The first path of each record and what it was chosen by: complete, covering, continuous, sharing evidence, explicit, short, little evidence, scored, confident, then by node ids.

    Only paths whose nodes all have evidence count. ``edges`` may have a boolean column ``explicit`` (said by the extractor). Nodes and edges meet
    in one row per record, and all paths of a batch of records grow together in arrays.
    """
    kind = nodes.schema["input_id"].dataType.simpleString()
    rows = records(nodes, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _search(b, max_nodes, exact_limit)

    return rows.mapInArrow(run, f"input_id {kind}, {FOUND}")


def _list(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    lists = b.column(name)
    return np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0), np.int64)), lists.flatten()


def _codes(lists: Sequence[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """Texts of several arrays as their places among all different ones, in the order of the texts, and these."""
    kinds = pa.chunked_array(lists, pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(kinds.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    codes = place[kinds.indices.fill_null(0).to_numpy()] if len(order) else np.zeros(len(kinds), np.int64)
    codes[np.asarray(kinds.is_null())] = -1
    return np.split(codes, np.cumsum([len(x) for x in lists])[:-1]), kinds.dictionary.take(order)


_COUNT = np.frompyfunc(lambda x: x.bit_count() if x >= 0 else 0, 1, 1)


def _bits(rec: np.ndarray, owner: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mask for each node of what it has (``names`` of their ``owner``), as bits numbered within the record in the order of names; objects if a record has many.

    Also the name of every bit, record by record, and the record of it.
    """
    width = names.max(initial=0) + 2
    pairs, place = np.unique(rec[owner] * width + names + 1, return_inverse=True)
    bit = place - np.searchsorted(pairs // width, rec[owner])
    if bit.max(initial=0) < 63:
        masks = np.zeros(len(rec), np.int64)
        np.bitwise_or.at(masks, owner, np.int64(1) << bit)
    else:
        masks = np.zeros(len(rec), object)
        for i, k in zip(owner, bit):
            masks[i] |= 1 << int(k)
    return masks, pairs % width - 1, pairs // width


def _jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    count = _COUNT if a.dtype == object else np.bitwise_count
    both, any_ = np.asarray(count(a & b), float), np.asarray(count(a | b), float)
    return np.divide(both, any_, out=np.zeros(len(both)), where=any_ > 0)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does: by the shortest decimal number that stands for the value, halves away from zero."""
    y = np.abs(x) * 10**digits
    out = np.copysign(np.floor(y + 0.5) / 10**digits, x)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6 * np.maximum(1, y * 1e-6)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _best(group: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """Which rows have the largest key of their group."""
    most = np.full(groups, key.min(initial=0), key.dtype)
    np.maximum.at(most, group, key)
    return key == most[group]


class _Graphs:
    """The graphs of a batch of records as arrays, and the first path of each: ``head``, with the record ``of`` it; path, size and sums are those of the heads."""

    def __init__(self, b: pa.RecordBatch, max_nodes: int, exact_limit: int) -> None:
        rec, n = _list(b, "n")
        er, e = _list(b, "e") if "e" in b.schema.names else (None, None)
        self.ids, self.types, self.exact_limit, self.rec = n.field("node_id"), n.field("type"), exact_limit, rec
        none = pa.array([], pa.string())
        (code, a, z), _ = _codes([self.ids, *((none, none) if e is None else (e.field("src"), e.field("dst")))])  # in the order of the ids
        (kind,), kinds = _codes([self.types])
        self.kind, self.kinds = kind, [*kinds.to_pylist(), None]
        core = np.array([CORE.index(t) if t in CORE else -1 for t in self.kinds])[kind]
        self.before = np.array([t == "Precondition" for t in self.kinds])[kind]
        self.code, self.conf, evidence = code, n.field("confidence").to_numpy(zero_copy_only=False), n.field("evidence_ids")
        owner, self.start = np.repeat(np.arange(len(code)), count := np.asarray(evidence.value_lengths(), np.int64)), np.r_[0, np.cumsum(count)]
        (self.names,), said = _codes([evidence.flatten()])
        ids = said.to_pylist()
        natural = sorted(range(len(ids)), key=lambda i: natural_order(ids[i]))
        place = np.full(len(ids) + 1, -1)
        place[natural] = np.arange(len(ids))
        self.names, self.said = place[self.names], [*(ids[i] for i in natural), None]
        self.masks, self.bit_name, self.bit_rec = _bits(rec, owner, self.names)
        masks = self.masks
        self.every, self.count = (-1, _COUNT) if masks.dtype == object else (np.int64(-1), np.bitwise_count)
        src, dst, explicit, score = self.layers(n, np.asarray(b.column("input_id").is_valid())) if er is None else self.told(er, e, a, z)
        overlap = np.asarray(self.count(masks[src] & masks[dst]), float)
        self.src, self.dst, self.explicit, self.score, self.overlap = src, dst, explicit, score, overlap
        lo, hi = np.searchsorted(src, np.arange(len(code))), np.searchsorted(src, np.arange(len(code)), side="right")
        path = np.full((len(code), max_nodes), -1, np.int64)
        path[:, 0] = np.arange(len(code))
        sums = np.zeros((len(code), 4))  # score, explicit, edges with shared evidence, shared evidence
        gain = np.stack([score, explicit, (overlap > 0).astype(float), overlap], axis=1)
        all_paths, all_sums, size = [path], [sums], [np.ones(len(code), int)]
        for k in range(1, max_nodes):
            last = path[:, k - 1]
            more = hi[last] - lo[last]
            at = np.repeat(np.arange(len(path)), more)
            edge = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + np.repeat(lo[last], more)
            fresh = (path[at] != dst[edge][:, None]).all(axis=1)
            at, edge = at[fresh], edge[fresh]
            path = path[at]
            path[:, k] = dst[edge]
            sums = sums[at] + gain[edge]
            all_paths.append(path)
            all_sums.append(sums)
            size.append(np.full(len(path), k + 1))
        path, sums, size = np.concatenate(all_paths), np.concatenate(all_sums), np.concatenate(size)
        kinds = np.where(path >= 0, core[path], -2)
        complete = (kinds[:, 0] == 0) & (kinds[np.arange(len(path)), size - 1] == 2) & (kinds == 1).any(axis=1)
        covered, of = ordered_core(kinds), rec[path[:, 0]]
        total = np.bincount(of, minlength=b.num_rows)
        # what sorts first and is cheap leaves few paths for the rest
        left = np.flatnonzero(_best(of, complete * (len(CORE) + 1) + covered, b.num_rows))
        mean = np.round(sums[left] / np.maximum(size[left] - 1, 1)[:, None], 12)
        for k in (2, 3, 1):
            some = _best(of[left], mean[:, k], b.num_rows)
            left, mean = left[some], mean[some]
        some = _best(of[left], -size[left], b.num_rows)
        left, mean = left[some], mean[some]
        path, size, of = path[left], size[left], of[left]
        sure = np.round(np.where(path >= 0, self.conf[path], 0.0).sum(axis=1) / size, 12)
        least = self.least(path)
        tie = [np.where(path[:, k] >= 0, code[path[:, k]], -1) for k in range(max_nodes)]
        order = np.lexsort((*tie[::-1], -sure, -mean[:, 0], least, of))
        head = order[np.r_[True, of[order][1:] != of[order][:-1]]] if len(order) else order
        self.path, self.of, self.complete, self.covered, self.mean = path[head], of[head], complete[left][head], covered[left][head], mean[head]
        self.cover, self.sure, self.total = least[head], sure[head], total[of[head]]

    def told(self, er: np.ndarray, e: pa.StructArray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges between nodes of the batch, sorted by source: places of their ends, whether they are explicit, scores."""
        width = max(x.max(initial=0) for x in (self.code, a, z)) + 1
        by = np.argsort(self.rec * width + self.code, kind="stable")
        known = (self.rec * width + self.code)[by]

        def find(ids: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.full(len(ids), -1)
            at = np.searchsorted(known, er * width + ids, side="right") - 1
            return np.where((at >= 0) & (ids >= 0) & (known[at] == er * width + ids), by[at], -1)

        src, dst = find(a), find(z)
        ok = np.flatnonzero((src >= 0) & (dst >= 0))
        ok = ok[np.argsort(src[ok], kind="stable")]
        return src[ok], dst[ok], *(np.nan_to_num(np.asarray(e.field(c).to_numpy(zero_copy_only=False), float))[ok] for c in ("explicit", "score"))

    def layers(self, n: pa.StructArray, linked: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of ``layer_edges``, with equal scores. ``linked``: records whose id isn't null, which alone have such edges."""
        key = self.rec * len(self.kinds) + self.kind
        by = np.argsort(key, kind="stable")
        pairs = [(np.zeros(0, np.int64),) * 2]
        for a, b, _ in LAYER_RULES:
            if a in self.kinds and b in self.kinds:
                src = np.flatnonzero((self.kind == self.kinds.index(a)) & linked[self.rec])
                want = self.rec[src] * len(self.kinds) + self.kinds.index(b)
                lo, hi = np.searchsorted(key[by], want), np.searchsorted(key[by], want, side="right")
                at = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                pairs.append((np.repeat(src, hi - lo), by[at]))
        src, dst = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        text = n.field("text").fill_null("").dictionary_encode()
        words = pa.array([sorted({w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1}) for t in text.dictionary.to_pylist()], pa.list_(pa.string())).take(text.indices)
        owner = np.repeat(np.arange(len(self.rec)), np.asarray(words.value_lengths(), np.int64))
        (names,), _ = _codes([words.flatten()])
        evidence, lexical = (_jaccard(m[src], m[dst]) for m in (self.masks, _bits(self.rec, owner, names)[0]))
        score = 0.55 * evidence + 0.25 * lexical + 0.20 * ((self.conf[src] + self.conf[dst]) / 2)
        return src, dst, np.zeros(len(src)), np.nan_to_num(_half_up(score, 6))

    def least(self, path: np.ndarray) -> np.ndarray:
        """Size of the least evidence that covers each path (places of nodes; -1 for none)."""
        inside = path >= 0
        least = cover_sizes(np.where(inside, self.masks[path], self.every))
        union = functools.reduce(operator.or_, [np.where(inside[:, k], self.masks[path[:, k]], 0) for k in range(path.shape[1])])
        for i in np.flatnonzero(np.asarray(self.count(union), int) > self.exact_limit):  # beyond the limit a cover is what the greedy choice finds
            least[i] = len(self.evidence(path[i]))
        return least

    def evidence(self, path: np.ndarray) -> list[str]:
        """The least evidence that covers a path."""
        return minimum_cover([[self.said[c] for c in self.names[self.start[k] : self.start[k + 1]]] for k in path if k >= 0], self.exact_limit)

    def covers(self, paths: np.ndarray) -> list[list[str]]:
        """``evidence`` of every path (a row of one per head): one or two ids are found by masks, more by the search over sets."""
        masks = np.where(paths >= 0, self.masks[paths], self.every)
        joint = functools.reduce(operator.and_, masks.T)
        begin = np.searchsorted(self.bit_rec, self.of)
        low = np.asarray(np.frompyfunc(lambda x: (x & -x).bit_length() - 1, 1, 1)(joint), np.int64)
        found = [[self.said[c]] for c in self.bit_name[begin + np.maximum(low, 0)].tolist()]
        for i in np.flatnonzero(low < 0):  # no id is in all
            needs = [m for m, k in zip(masks[i].tolist(), paths[i].tolist()) if k >= 0]
            two = first_two(needs) if functools.reduce(operator.or_, needs).bit_count() <= self.exact_limit else None
            found[i] = [self.said[self.bit_name[begin[i] + k]] for k in two] if two else self.evidence(paths[i])
        return found

    def precondition(self) -> np.ndarray:
        """For each head the place of a Precondition that an edge leads from to a node of the path, or -1.

        By shared evidence, explicit edges, score, confidence, the size of the cover with it, and its id.
        """
        row = np.full(self.rec.max(initial=-1) + 1, -1)
        row[self.of] = np.arange(len(self.of))
        edge = np.flatnonzero(self.before[self.src])
        at = row[self.rec[self.src[edge]]]
        on = (self.path[at] == self.dst[edge][:, None]).any(axis=1) & (self.path[at] != self.src[edge][:, None]).all(axis=1) & (at >= 0)
        at, edge = at[on], edge[on]
        src = self.src[edge]
        cover = self.least(np.column_stack([src, self.path[at]]))
        order = np.lexsort((self.code[src], cover, -self.conf[src], -self.score[edge], -self.explicit[edge], -self.overlap[edge], at))
        first = order[np.r_[True, at[order][1:] != at[order][:-1]]] if len(order) else order
        chosen = np.full(len(self.of), -1)
        chosen[at[first]] = src[first]
        return chosen

    def lists(self, values: pa.Array) -> pa.ListArray:
        """What the nodes of each head have there."""
        inside = self.path >= 0
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(inside.sum(axis=1))], pa.int32()), values.take(pa.array(self.path[inside])))

    def columns(self) -> list[pa.Array]:
        m = self.mean
        return [
            self.lists(self.ids), self.lists(self.types), pa.array(self.complete), pa.array(self.covered.astype(np.int32)), pa.array(m[:, 2]), pa.array(m[:, 3]), pa.array(m[:, 1]),
            pa.array(self.cover.astype(np.int32)), pa.array(m[:, 0]), pa.array(self.sure), pa.array(self.total),
        ]


NAMES = tuple(c.split()[0] for c in FOUND.split(", "))


def _search(b: pa.RecordBatch, max_nodes: int, exact_limit: int) -> pa.RecordBatch:
    g = _Graphs(b, max_nodes, exact_limit)
    return pa.RecordBatch.from_arrays([b.column("input_id").take(pa.array(g.of)), *g.columns()], names=["input_id", *NAMES])


def explained(rows: DataFrame, max_nodes: int = 4, exact_limit: int = 20) -> DataFrame:
    """What an explanation needs of each of ``records`` (with the nodes' texts) whose best path covers any core type: the path and what it was chosen by.

    And the precondition that leads into it with its text, if there is one, all evidence of these nodes in their order, and the least that covers them.
    """
    kind = rows.schema["input_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g = _Graphs(b, max_nodes, exact_limit)
                text = _list(b, "n")[1].field("text")
                before = g.precondition()
                first = pa.array(before, mask=before < 0)
                both = np.column_stack([before, g.path])
                inside = both >= 0
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(inside.sum(axis=1))], pa.int32()), _list(b, "n")[1].field("evidence_ids").take(pa.array(both[inside])))
                cover = pa.array(g.covers(both), pa.list_(pa.string()))
                cols = [b.column("input_id").take(pa.array(g.of)), *g.columns(), g.lists(text), g.ids.take(first), text.take(first), lists, cover]
                yield pa.RecordBatch.from_arrays(cols, names=["input_id", *NAMES, "texts", "precondition", "precondition_text", "said", "minimum_evidence"]).filter(pa.array(g.covered > 0))

    return rows.mapInArrow(run, f"input_id {kind}, {FOUND}, texts array<string>, precondition string, precondition_text string, said array<array<string>>, minimum_evidence array<string>")


def status(complete, core_coverage):
    return F.when(complete, "complete").when(core_coverage > 0, "partial").otherwise("empty")


def best_path(nodes: DataFrame, edges: DataFrame, max_nodes: int = 4, exact_limit: int = 20) -> DataFrame:
    """The best path of each record as text, what it was chosen by, and its status."""
    g = best_paths(nodes, edges, max_nodes, exact_limit)
    return g.select(
        "input_id", F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"), "core_coverage", F.round("mean_score", 9).alias("mean_score"), "cover_size",
        F.round("continuity", 9).alias("continuity"), F.round("explicit_ratio", 9).alias("explicit_ratio"), status(F.col("complete"), F.col("core_coverage")).alias("status"),
    )


def natural_order(e: str) -> tuple[int, str]:
    return int(e[1:]) if e[1:].isdigit() else 10**9, e


def first_two(needs: list[int]) -> tuple[int, int] | None:
    """The first two bits that meet every need (a mask), where no bit meets all; None if there are no such two."""
    left = functools.reduce(operator.or_, needs)
    while left:
        bit = left & -left
        left ^= bit
        if rest := functools.reduce(operator.and_, [m for m in needs if not m & bit]):
            return bit.bit_length() - 1, (rest & -rest).bit_length() - 1
    return None


def minimum_cover(needs: list[list[str]], exact_limit: int = 20) -> list[str] | None:
    """The least set of evidence ids that meets every need (a list of ids, one of which must be chosen); None if a need has no id.

    Every id is the mask of the needs it meets. Exact, by size and then by natural order, up to ``exact_limit`` different ids: level k
    holds, for every mask that k ids reach, the first k ids that reach it. Above, the id that meets most open needs is taken until none is open.
    """
    masks: dict[str, int] = {}
    for k, need in enumerate(needs):
        for e in need or ():
            masks[e] = masks.get(e, 0) | 1 << k
    whole = (1 << len(needs)) - 1
    ids = sorted(masks, key=natural_order)
    if functools.reduce(operator.or_, masks.values(), 0) != whole:
        return None
    own = [masks[e] for e in ids]
    if len(ids) <= exact_limit:
        level: dict[int, tuple[int, ...]] = {0: ()}
        while whole not in level:
            above: dict[int, tuple[int, ...]] = {}
            for mask, chosen in level.items():
                for i, m in enumerate(own):
                    if m & ~mask:
                        pick = tuple(sorted((*chosen, i)))
                        if pick < above.get(mask | m, (len(own),)):
                            above[mask | m] = pick
            level = above
        return [ids[i] for i in level[whole]]
    picked, left = [], whole
    while left:
        i = max(range(len(own)), key=lambda i: ((own[i] & left).bit_count(), -i))
        picked.append(ids[i])
        left &= ~own[i]
    return picked


def evidence_cover(nodes: DataFrame, exact_limit: int = 20) -> DataFrame:
    """(input_id, cover): the least evidence that supports every node of a record; null if a node has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cover = [minimum_cover(n, exact_limit) for n in b.column("needs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("input_id"), pa.array(cover, pa.list_(pa.string()))], names=["input_id", "cover"])

    kind = nodes.schema["input_id"].dataType.simpleString()
    return nodes.groupBy("input_id").agg(F.collect_list("evidence_ids").alias("needs")).mapInArrow(run, f"input_id {kind}, cover array<string>")
