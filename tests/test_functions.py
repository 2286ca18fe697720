import pytest
from pyspark.sql import functions as F

from quillstone.functions import normalise as N
from quillstone.functions import scores, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ids(spark):
    got = column(spark, [" cve-2020-0001_augumented_3 ", "CVE–2020–0001", "cve 2020 0001", "Cve_2020_1\t", "T1059", "", None, "CVE-2020-5-augmented-12"], N.base_id)
    assert got == ["CVE_2020_0001", "CVE_2020_0001", "CVE_2020_0001", "CVE_2020_1", None, None, None, "CVE_2020_5"]
    assert column(spark, [" cve-2020-0001_augumented_3 "], N.input_id) == ["CVE_2020_0001_AUGUMENTED_3"]


def test_advisories(spark):
    got = column(spark, ["ADV-00000109", "adv 00000109 ", "ADV_12345678", "ADV-PENDING", "ADV-00000000", "ADV-000000", "n/a", None], N.advisory_id)
    assert got == ["ADV-00000109", "ADV-00000109", "ADV-12345678", None, None, None, None, None]


def test_usable(spark):
    got = column(spark, ["text", "** RESERVED **", " \t", None, "N/A", " ", "none of these", "[withheld until publication]"], N.usable)
    assert got == [True, False, False, False, False, False, True, False]
    assert column(spark, [["", None], ["n/a", "x"], [], None], N.usable_list, "array<string>") == [False, True, False, False]


def test_moments(spark):
    same = ["2087-05-20T08:18:00Z", "2087/05/20 08:18:00", "20 May 2087 08:18 UTC", "2087-05-20T17:18:00+09:00", "2087-05-20T01:18:00-07:00", "3704257080", "3704257080000", "2087-05-20 08:18"]
    got = column(spark, [*same, "unknown", "", None, "2087-13-45T00:00:00Z"], N.moment_micros)
    assert got == [3704257080000000] * len(same) + [None] * 4


def test_splits_and_names(spark):
    assert column(spark, ["TRAIN ", "training", "validation", "dev", " test", "x", None], N.split_name) == ["train", "train", "development", "development", "test", None, None]
    assert column(spark, ["Advisory Feed", "advisory-feed", " ADVISORY_FEED", " ", None], N.key_name) == ["advisory_feed"] * 3 + [None] * 2


def test_tokens(spark):
    assert column(spark, ["CVE-2020-1 foo_bar 12 1234 ab", None], text.tokens) == [["cve", "2020", "foo", "bar", "1234"], []]
    assert column(spark, [["e10, E2;x", "E2 e1"], None], text.evidence_ids, "array<string>") == [["E1", "E2", "E10"], []]
    assert column(spark, ["a b \n c ", None], text.canonical) == ["a b c", ""]
    assert column(spark, ["[x](http://a) <b>y</b> (Citation: z) w"], text.without_markup) == ["x y w"]
    assert column(spark, ["abcdefghij", "abc"], lambda c: text.truncated(c, 6)) == ["abc...", "abc"]
    assert column(spark, ["null", " x ", None], text.text_or_null) == [None, "x", None]
    assert column(spark, [" t1059.001", "T1059", "1059", None], text.technique_id) == ["T1059.001", "T1059", None, None]


def test_scores(spark):
    assert column(spark, ["0.5", "2", "-1", "nan", "x", None], scores.confidence) == [0.5, 1.0, 0.0, None, None, None]
    assert column(spark, [5, 6, 21], scores.support_bucket, "int") == ["tail", "mid", "head"]
    assert column(spark, [1, 3, 5, 10, 20, 21, None], scores.hit_bucket, "int") == ["1", "2-3", "4-5", "6-10", "11-20", ">20", "miss"]
    assert column(spark, [5, 1, 7], lambda c: scores.split_target(c, 1, 2), "int") == [2, 0, 4]
    assert column(spark, [0, 1, 2], lambda c: scores.token_budget(F.lit(1800), F.lit(30), c), "int") == [3100, 3875, 4844]
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "k string, v double")
    assert sorted(r.x for r in df.select(scores.min_max(F.col("v"), "k").alias("x")).collect()) == [0.0, 0.0, 0.0, 1.0]
    assert pytest.approx(1.0) == column(spark, ["1"], scores.confidence)[0]


def test_usable(spark):
    """Stand-ins in any spelling are not usable, and texts of any number of words are, however they begin."""
    texts = [(None, False), ("", False), ("\u00a0 \n", False), ("x", True), ("n/a n/a", True), ("not available not available not available", True), ("  a b c d e f g h", True), ("word " * 5000, True)]
    texts += [(f" {s.upper()}  ".replace(" ", "  \u3000"), False) for s in N.STAND_INS] + [(f"{s} and more words than any stand in", True) for s in N.STAND_INS]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string").select("i", N.usable(F.col("t")).alias("u"))
    assert {r.i: r.u for r in df.collect()} == {i: u for i, (_, u) in enumerate(texts)}
