"""Problem 5: the same or nearly the same records across splits.

Two texts overlap if at least four words in five of the longer one occur in the other in the same order.

Method: hashes of the evaluation side's words and of small sets of them are partitioned, the training side is scanned for hits, and the
containment of every evaluation text in every training text it hits is computed. What is hashed makes the scan lossless, and its
number is linear in the text's length. If the longer text has L words, an overlapping pair shares m >= 0.8 L words, and a text of p words lacks
at most k = p - m of them. Words (with their number of occurrence) are put in one global order, rarest first; words are rare or frequent
(more than ``FREQUENT`` occurrences in all texts).

* The rarest word that a pair shares lies among the first k + 1 of either text. The rare ones of these are hashed alone.
* If that word is frequent, so are all shared words, and the G + 1 rarest of them lie among the first k + G + 1 of either text. Frequent
  words are dealt into G groups by their hash, so two of these are in one group: all pairs of frequent words of a group are hashed. A text with more than k
  rare words among its first k + 1 needs none. G is a fixed part of L up to a power of two, so the pairs are linear in L; a text that can be
  part of pairs on either side of a power of two has those of both.
* A pair of words that more than ``FREQUENT_PAIR`` times ``FREQUENT`` texts hash is hashed with a third word instead: the rarest shared word that is not of the pair lies
  among the first k + 3 of either text.

Any total order is right; the one used takes counts of word and pair hashes in 2^20 cells each, a byte a cell, so that what every worker
holds has a fixed size (2 MB), whatever the corpus. A pair of texts that hits must also agree in length and in a 256-bit sketch of its
words (both necessary conditions) before its texts are read, and the words in order are then compared exactly.

Exact copies (after normalisation) are one class, compared once; the classes' pairs are expanded to rows at the end.

Defined cases: null, blank and stand-in texts and rows without a split take no part; a text without any word takes no
part; texts of up to three words overlap only if their words are equal; repeated rows pair like others, never with
themselves; ids occur once, as the problem states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..session import materialise

CELLS = 1 << 20
#: Words whose cell holds more occurrences than this are hashed in pairs, pairs above four times as many with a third word. Where these lie decides the work, not the result.
FREQUENT = 1 << 10
FREQUENT_PAIR = 4
#: Words of the longer text to a group.
GROUP = 24
BLOCK = 1 << 12
#: Full-width forms U+FF01 to U+FF5E and the ideographic blank, and what they stand for.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def words_text(c: Column) -> Column:
    """The words of a text in lower case, joined by blanks: full-width forms narrowed, invisible characters removed, punctuation dropped."""
    s = F.when(c.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), F.translate(c, WIDE, NARROW)).otherwise(c)
    s = F.regexp_replace(s, r"[\p{Cf}\x{034F}\x{180B}-\x{180D}\x{FE00}-\x{FE0F}]", "")
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{M}\p{N}_]+", " "))


def sides(source_rows: DataFrame, records: DataFrame) -> DataFrame:
    """(id, table, source, split, words) of every usable text of either table."""
    a = source_rows.select(F.col("row_id").alias("id"), F.lit("source_rows").alias("origin"), "source_name", "split", "text")
    b = records.select(F.col("record_id").alias("id"), F.lit("records").alias("origin"), "source_name", "split", F.col("raw_text").alias("text"))
    both = a.unionByName(b).withColumn("split", N.split_name(F.col("split"))).where(F.col("split").isNotNull() & N.usable(F.col("text")))
    return both.select("id", "origin", "source_name", "split", words_text(F.col("text")).alias("words")).where("words <> ''")


def _flat(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.value_lengths(), np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _occurrences(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that tell the n-th occurrence of a word in its text from the others."""
    order = np.lexsort((h, doc))
    sh, sd = h[order], doc[order]
    new = np.r_[True, (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])] if len(h) else np.zeros(0, bool)
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, int)
    out = np.empty(len(h), np.uint64)
    out[order] = _mix(sh + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _hashed(classes: DataFrame) -> DataFrame:
    return classes.select("cls", "has_train", "has_eval", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("h"))


def _grade(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: eight grades an octave."""
    return np.minimum(np.ceil(8 * np.log2(n + 1.0)), 255).astype(np.uint8)


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(44)).astype(np.int64)


def _cell_grades(lists: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often the hashes that ``items`` makes of a batch fall into each of ``CELLS`` cells, as grades."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            n += np.bincount(_cell(items(b)), minlength=CELLS)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)].astype(np.int32)), pa.array(n[at[i : i + (1 << 16)]])], names=["cell", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("x")
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths(), np.int64))
            out = np.zeros((b.num_rows, BLOCK), np.uint8)
            out[row, flat.field("cell").to_numpy() % BLOCK] = _grade(flat.field("n").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([r.tobytes() for r in out], pa.binary())], names=["block", "grades"])

    per = lists.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").cast("long").alias("n"))
    blocks = per.groupBy((F.col("cell") / BLOCK).cast("int").alias("block")).agg(F.collect_list(F.struct("cell", "n")).alias("x"))  # BLOCK entries at most
    out = np.zeros(CELLS, np.uint8)
    for r in blocks.mapInArrow(pack, "block int, grades binary").collect():  # 256 rows at most
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["grades"], np.uint8)
    return out


def grades(classes: DataFrame) -> np.ndarray:
    """Grades of the words of all class texts, and of the pairs of frequent words that these hash: two rows of fixed size."""
    h, limit = _hashed(classes).select("h"), int(_grade(np.array([FREQUENT]))[0])
    words = _cell_grades(h, lambda b: _mix(_flat(b, "h")[0]))
    shared = classes.sparkSession.sparkContext.broadcast(words)  # 1 MB, a constant

    def pairs(b: pa.RecordBatch) -> np.ndarray:
        t = Ranked(*_flat(b, "h"), shared.value, limit)
        first, second = t.pairs()
        return _mix(t.x[first] + t.x[second])

    return np.stack([words, _cell_grades(h, pairs)])


def _once(sig: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the different signatures of every text."""
    order = np.lexsort((sig, doc))
    s, d = sig[order], doc[order]
    return order[np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]] if len(order) else order


class Ranked:
    """The words of a batch of texts, rarest first. Ties go by hash, so the order is total and the same everywhere."""

    def __init__(self, h: np.ndarray, size: np.ndarray, words: np.ndarray, limit: int) -> None:
        doc = np.repeat(np.arange(len(size)), size)
        x, grade = _occurrences(h, doc), words[_cell(_mix(h))]
        order = np.lexsort((x, grade, doc))
        #: hash, text, place among the words of the text
        self.x, self.doc, self.size = x[order], doc[order], size
        self.first = np.cumsum(size) - size
        self.rank = np.arange(len(doc)) - self.first[self.doc]
        self.often = grade[order] > limit
        self.able = size >= 4  # four words can be all but one of five
        self.lacks = size // 5
        self.rare = np.bincount(self.doc[~self.often & (self.rank <= self.lacks[self.doc])], minlength=len(size))

    def singles(self) -> np.ndarray:
        return np.flatnonzero(~self.often & self.able[self.doc] & (self.rank <= self.lacks[self.doc]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the two words of every pair of frequent words of a group, each pair once."""
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 1 << (np.frexp(np.maximum(self.size, 1))[1].astype(np.int64) - 1)
        for longest in (low, 2 * low):  # the power of two at or below the longer text's length
            lacks = self.size - -(-np.maximum(longest, self.size) * 4 // 5)
            groups = np.maximum(longest // GROUP, 1)
            able = self.able & (self.size + self.size // 4 >= longest) & (self.rare <= lacks)
            at = np.flatnonzero(self.often & able[self.doc] & (self.rank <= (lacks + groups)[self.doc]))
            group = (self.x[at] % groups[self.doc[at]].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((self.rank[at], group, self.doc[at]))
            at, group = at[order], group[order]
            i = np.arange(len(at))
            step = 1
            while len(i := i[i + step < len(at)]):
                i = i[(group[i] == group[i + step]) & (self.doc[at[i]] == self.doc[at[i + step]])]
                first.append(at[i])
                second.append(at[i + step])
                step += 1
        a, b = np.concatenate(first), np.concatenate(second)
        once = _once(_mix(self.x[a] + self.x[b]), self.doc[a])
        return a[once], b[once]

    def thirds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of the given pairs of frequent words with each further frequent one that may be the rarest shared beside them."""
        doc = self.doc[a]
        start, end = self.rare[doc], np.minimum(self.lacks[doc] + 3, self.size[doc])
        n = np.maximum(end - start, 0)
        of = np.repeat(np.arange(len(a)), n)
        c = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + (self.first[doc] + start)[of]
        keep = (c != a[of]) & (c != b[of])
        of, c = of[keep], c[keep]
        sig, doc = _mix(self.x[a[of]] + self.x[b[of]] + self.x[c]), doc[of]
        once = _once(sig, doc)
        return sig[once], doc[once]


SIGNATURES = "sig long, cls long, len int, s0 long, s1 long, s2 long, s3 long, has_train boolean, has_eval boolean"


def signatures(classes: DataFrame, counted: np.ndarray) -> DataFrame:
    """The hashes by which texts can hit each other: see the module's text. Texts of under four words have none."""
    shared = classes.sparkSession.sparkContext.broadcast(counted)  # 2 MB, a constant
    limit, limit_pair = (int(x) for x in _grade(np.array([FREQUENT, FREQUENT_PAIR * FREQUENT])))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for b in batches:
            h, size = _flat(b, "h")
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(size)), size)
            # 256-bit sketch of the words
            sketch = np.zeros((len(size), 256), bool)
            sketch[doc, (_mix(h) & np.uint64(255)).astype(np.int64)] = True
            packed = np.packbits(sketch, axis=1, bitorder="little").view(np.int64).reshape(len(size), 4)
            t = Ranked(h, size, words, limit)
            one, (first, second) = t.singles(), t.pairs()
            two = _mix(t.x[first] + t.x[second])
            hot = pairs[_cell(two)] > limit_pair
            three, of = t.thirds(first[hot], second[hot])
            s, w = np.r_[t.x[one], two[~hot], three], np.r_[t.doc[one], t.doc[first[~hot]], of]
            take = pa.array(w)
            cols = [pa.array(s.view(np.int64)), b.column("cls").take(take), pa.array(size[w].astype(np.int32)), *(pa.array(packed[w, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays([*cols, b.column("has_train").take(take), b.column("has_eval").take(take)], names=["sig", "cls", "len", "s0", "s1", "s2", "s3", "has_train", "has_eval"])

    return _hashed(classes).mapInArrow(sign, SIGNATURES)


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, by the bits of integers."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def verify(pairs: DataFrame) -> DataFrame:
    """Pairs (cls_e, cls_t, words_e, words_t) with ``common``, the number of words common in order, where that reaches four fifths of the longer text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, common, longest, own = [], [], [], []
            for i, (x, y) in enumerate(zip(b.column("words_e").to_pylist(), b.column("words_t").to_pylist())):
                p, q = x.split(" "), y.split(" ")
                n = common_in_order(p, q)
                if n * 5 >= max(len(p), len(q)) * 4:
                    keep.append(i)
                    common.append(n)
                    longest.append(max(len(p), len(q)))
                    own.append(len(p))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cls_e").take(at), b.column("cls_t").take(at), pa.array(common, pa.int32()), pa.array(longest, pa.int32()), pa.array(own, pa.int32())], names=["cls_e", "cls_t", "common", "longest", "len_e"])

    return pairs.mapInArrow(check, "cls_e long, cls_t long, common int, longest int, len_e int")


def class_overlaps(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, overlaps): rows with their class, distinct texts, and overlapping pairs of different classes with containment."""
    # normalised once: the rows' texts are read again by the grouping only
    items = materialise(items.withColumn("digest", F.md5("words")), "items")
    # the class id is the least row id that has the text
    c = items.groupBy("digest").agg(F.min("id").alias("cls"), F.max(F.col("split") == "train").alias("has_train"), F.max(F.col("split") != "train").alias("has_eval"), F.first("words").alias("words"))
    classes = materialise(c, "classes")
    members = items.select("id", "origin", "source_name", "split", "digest").join(classes.select("digest", "cls", "has_train", "has_eval"), "digest").drop("digest")
    counted = grades(classes)
    side = lambda s, flag: signatures(classes.where(flag), counted).select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "len", "s0", "s1", "s2", "s3")])
    j = side("e", "has_eval").join(side("t", "has_train"), "sig").where("cls_e <> cls_t")
    longest = F.greatest("len_e", "len_t")
    spare = lambda s: F.col(f"len_{s}") - F.ceil(longest * 4 / F.lit(5))
    only = lambda s, o: sum(F.bit_count(F.col(f"s{k}_{s}").bitwiseAND(F.bitwise_not(F.col(f"s{k}_{o}")))) for k in range(4))
    hits = j.where((F.least("len_e", "len_t") * 5 >= longest * 4) & (only("e", "t") <= spare("e")) & (only("t", "e") <= spare("t"))).select("cls_e", "cls_t").distinct()
    text = lambda s, flag: classes.where(flag).select(F.col("cls").alias(f"cls_{s}"), F.col("words").alias(f"words_{s}"))
    pairs = hits.join(text("e", "has_eval"), "cls_e").join(text("t", "has_train"), "cls_t")
    return members, classes, verify(pairs)


def overlapping_rows(source_rows: DataFrame, records: DataFrame) -> DataFrame:
    """Every pair of a train and an evaluation row that overlap, with containment of the evaluation text in the training text."""
    members, _, found = class_overlaps(sides(source_rows, records))
    members = materialise(members, "members")
    ev = members.where("split <> 'train'").select(*[F.col(c).alias(f"{c}_e") for c in ("id", "origin", "source_name", "split", "cls")], F.col("has_train"))
    tr = members.where("split = 'train'").select(*[F.col(c).alias(f"{c}_t") for c in ("id", "origin", "source_name", "cls")], F.col("has_eval"))
    near = found.select("cls_e", "cls_t", (F.col("common") / F.col("len_e")).alias("containment"))
    same = members.where("has_train and has_eval").select(F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"), F.lit(1.0).alias("containment")).distinct()
    return near.unionByName(same).join(ev.drop("has_train"), "cls_e").join(tr.drop("has_eval"), "cls_t")


def overlapping_pairs(source_rows: DataFrame, records: DataFrame) -> DataFrame:
    p = overlapping_rows(source_rows, records)
    return p.select(F.least("id_e", "id_t").alias("id_a"), F.greatest("id_e", "id_t").alias("id_b"))


def report(source_rows: DataFrame, records: DataFrame) -> DataFrame:
    """Per table, source and evaluation split, and per table and source of the training rows it overlaps: rows, rows leaked, pairs, largest containment.

    ``train_origin`` and ``train_source`` are ``any`` in the rows that count overlaps with whatever training row; these exist for every evaluation
    source, with zeros where nothing leaks. Counts are made over classes of equal texts with their numbers of rows; pairs of rows are never made.
    """
    members, _, found = class_overlaps(sides(source_rows, records))
    members = materialise(members, "members")
    name = lambda c: F.coalesce(c, F.lit("")).alias(c)
    ev = members.where("split <> 'train'").groupBy("cls", "origin", name("source_name"), "split").agg(F.count("*").alias("n_e"), F.first("has_train").alias("has_train"))
    tr = members.where("split = 'train'").groupBy("cls", F.col("origin").alias("train_origin"), F.coalesce("source_name", F.lit("")).alias("train_source")).agg(F.count("*").alias("n_t"))
    ev, tr = materialise(ev, "evaluation"), materialise(tr, "training")
    near = found.select("cls_e", "cls_t", (F.col("common") / F.col("len_e")).alias("c"))
    same = ev.where("has_train").select(F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"), F.lit(1.0).alias("c")).distinct()
    # an evaluation class against the rows of a training source: combined before rows of the class's own sources come in
    hit = near.unionByName(same).join(tr.withColumnRenamed("cls", "cls_t"), "cls_t")
    hit = hit.groupBy("cls_e", "train_origin", "train_source").agg(F.sum("n_t").alias("n_t"), F.max("c").alias("c"))
    whole = hit.groupBy("cls_e").agg(F.sum("n_t").alias("n_t"), F.max("c").alias("c")).select("cls_e", F.lit("any").alias("train_origin"), F.lit("any").alias("train_source"), "n_t", "c")
    key = ["origin", "source_name", "split"]
    per = ev.join(hit.unionByName(whole), F.col("cls") == F.col("cls_e")).groupBy(*key, "train_origin", "train_source").agg(
        F.sum("n_e").alias("rows_leaked"), F.sum(F.col("n_e") * F.col("n_t")).alias("pairs"), F.max("c").alias("max_containment")
    )
    rows = ev.groupBy(*key).agg(F.sum("n_e").alias("n_rows"))
    none = rows.select(*key, F.lit("any").alias("train_origin"), F.lit("any").alias("train_source"), F.lit(0).cast("long").alias("rows_leaked"), F.lit(0).cast("long").alias("pairs"), F.lit(0.0).alias("max_containment"))
    both = per.unionByName(none).groupBy(*key, "train_origin", "train_source").agg(*[F.max(c).alias(c) for c in ("rows_leaked", "pairs", "max_containment")])
    return both.join(rows, key).select(*key, "train_origin", "train_source", "n_rows", "rows_leaked", (F.col("rows_leaked") / F.col("n_rows")).alias("part_leaked"), "pairs", "max_containment")
