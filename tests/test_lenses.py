import random
from difflib import SequenceMatcher

import pytest
from leafwright.functions import texts
from leafwright.operators import lenses
from pyspark.sql import functions as F

FIELDS = "id string, title string, authors array<string>, publish_time struct<value: string, utc_offset: string>, content_text string"


def test_pieces():
    assert lenses.word_f1("a b c d e", "a b c d") == pytest.approx(2 / 3) and lenses.word_f1("", "a") == 0 and lenses.word_f1("a b", "a b") == 1
    assert lenses.set_f1(set(), set()) is None and lenses.set_f1({"a"}, {"b"}) == 0


def test_days(spark):
    df = spark.createDataFrame([("2024-03-21 09:00:00", "2024-03-21"), ("2024-03", "2024-03-21"), ("2024-03-XX", "2024-03-21"), (None, "2024-03-21"), ("2024-03-20", "2024-03-21")], "p string, g string")
    assert [r[0] for r in df.select(lenses.day_score(F.col("p"), F.col("g"))).collect()] == [1.0, None, None, None, 0.0]


def test_lax_report(spark):
    kind = "id string, dataset string, site string, route string, content_structure string, page_condition string, title string, authors array<string>, publish_time struct<value: string, utc_offset: string>, update_time struct<value: string, utc_offset: string>, content_text string"
    gold = spark.createDataFrame([("a", "d", "s", "r", "single", None, "T", None, None, None, "w"), ("b", "d", None, "r", "list_page", None, None, None, None, None, None), ("c", "d", "s", "r", None, None, "T", None, None, None, None)], kind)
    pred = spark.createDataFrame([("a", "t", None, None, None, "w", False), ("b", "x", None, None, None, None, None)], "id string, title string, authors array<string>, publish_time struct<value: string, utc_offset: string>, update_time struct<value: string, utc_offset: string>, content_text string, rejected boolean")
    got = {(r.view, r.value): r for r in lenses.lax_report(gold, pred).collect()}
    whole = got["overall", "all"]
    assert (whole.n_pages, whole.n_scored, whole.refusal_accuracy, whole.title, whole.title_n, whole.content, whole.authors_n) == (3, 1, 0.5, 1.0, 1, 1.0, 0) and ("site", "unknown") in got and ("content_structure", "unknown") in got


def test_lenses(spark):
    gold = spark.createDataFrame([("a", "T x", ["张三（摄影）"], ("2024-03-21", None), "abcdefgh"), ("b", None, None, None, None), ("c", "T", ["x"], ("2024-01-01", None), "w")], FIELDS)
    pred = spark.createDataFrame([("a", "t X", ["张三", "记者李四"], ("2024-03-21 10:00:00", None), "efghabcd"), ("b", "x", [], None, "x")], FIELDS)
    lax = {r.id: (r.title, r.authors, r.publish, r.content) for r in lenses.score_lax(gold, pred).collect()}
    assert lax["a"] == (1.0, pytest.approx(2 / 3), 1.0, 0.5) and lax["b"] == (None, None, None, None) and lax["c"] == (0.0, 0.0, None, 0.0)
    words = {r.id: (r.title, r.authors, r.content) for r in lenses.score_words(gold, pred).collect()}
    assert words["b"] == (None, None, None) and words["c"] == (0.0, 0.0, 0.0)
    assert lenses.score_lax(gold.limit(0), pred).count() == 0


def test_matched_equals_difflib():
    r = random.Random(4)
    for n in range(300):
        a, b = ("".join(r.choices("ab" if n % 2 else "abcdé漢", k=r.randint(0, 60))) for _ in range(2))
        b = b + a[5:40] if n % 3 else b
        assert texts.matched(a, b, small=0) == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), (a, b)


def test_lax_content_of_long_texts(spark):
    r = random.Random(6)
    text = "".join(r.choices("abcdefghij klmnopqrstuvwxyz", k=30_000))
    rows = [("a", text), ("b", text), ("c", text), ("d", " ")]
    gold = spark.createDataFrame([(i, None, None, None, t) for i, t in rows], FIELDS)
    pred = spark.createDataFrame([("a", None, None, None, text), ("b", None, None, None, text[: len(text) // 3]), ("d", None, None, None, "x")], FIELDS)
    size, part = len(lenses.lower_text(text)), len(lenses.lower_text(text[: len(text) // 3]))
    assert {x.id: x.content for x in lenses.score_lax(gold, pred).collect()} == {"a": 1.0, "b": pytest.approx(2 * part / (size + part)), "c": 0.0, "d": None}
