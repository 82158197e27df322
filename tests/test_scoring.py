import pytest
from leafwright.functions import texts
from leafwright.operators import scoring
from leafwright.operators.medians import medians
from leafwright.operators.validate import violations
from leafwright.sources.index import read_gold, read_pred, upsert, write_lines

FIELDS = "id string, dataset string, site string, route string, content_structure string, page_condition string, title string, authors array<string>, publish_time struct<value: string, utc_offset: string>, update_time struct<value: string, utc_offset: string>, content_text string"


@pytest.mark.parametrize(
    "pred, gold, f1, dup",
    [("abcd", "abcdefgh", 1 / 2, 0), ("abcdef导航栏", "abcdef", 8 / 11, 0), ("abcdabcd", "abcd", 1 / 2, 1 / 3), ("efghabcd", "abcdefgh", 2 / 3, 0), ("美联储宣布加息_新浪财经", "美联储宣布加息", 2 / 3, 0), ("ＡＢＣ d", "abcd", 1, 0), ("", "", 0, 0), ("ab", "AB", 1, 0)],
)
def test_trigrams(pred, gold, f1, dup):
    got = texts.compare(pred, gold)
    assert got[2] == pytest.approx(f1) and got[3] == pytest.approx(dup)


def test_order_numbers_and_names():
    assert texts.in_order("efghabcd", "abcdefgh") == 1 / 2 and texts.in_order("", "") is None
    assert texts.compare("a 1 2", "b 1 3")[4] == pytest.approx(0) and texts.compare("a", "b")[4] is None
    assert [texts.author_key(n) for n in ("记者通讯员张三（摄影）", "By Jane Roe", "记者", "by")] == ["张三", "janeroe", "记者", "by"]


GOLD = [
    ("p1", "dev", "news_cn", "fixed", "single", "ok", "美联储宣布加息", ["张三"], ("2024-03-21 08:30:00", "+08:00"), ("2024-03-22 10:00:00", "+08:00"), "第一段正文。\n第二段含数字 42。"),
    ("p2", "dev", "example_com", "generic", "single", "ok", "美联储宣布加息", ["张三", "李四"], ("2024-03-21", None), None, "abcdefgh"),
    ("p3", "dev", "example_com", "generic", "list_page", "ok", None, None, None, None, None),
]
PRED = [
    ("p1", None, None, None, None, None, "美联储宣布加息", ["张三（摄影）"], ("2024-03-21 08:30:00", "+08:00"), ("2024-03-22 10:00:00", "+08:00"), "第一段正文。\n第二段含数字 42。", None),
    ("p2", None, None, None, None, None, "美联储宣布加息_新浪财经", ["张三"], ("2024-03-21 09:00:00", None), None, "abcd", None),
    ("p3", None, None, None, None, None, None, None, None, None, None, None),
]


def overall(spark, gold, pred):
    scores = scoring.score_pages(spark.createDataFrame(gold, FIELDS), spark.createDataFrame(pred, FIELDS + ", rejected boolean"))
    return scoring.report(scores).where("view = 'overall'").first()


def test_golden_pages(spark):
    r = overall(spark, GOLD, PRED)
    assert (r.n_pages, r.n_scored) == (3, 2)
    want = {"title_exact": 0.5, "title_sim": 0.8333, "authors_f1": 0.8333, "publish_time_score": 1.0, "content_f1": 0.75, "dup_ratio": 0.0, "num_f1": 1.0, "refusal_accuracy": 1.0}
    assert {k: round(r[k], 4) for k in want} == want


def test_missing_predictions_score_zero_and_views_agree(spark):
    r = overall(spark, GOLD, [p for p in PRED if p[0] != "p2"])
    assert r.title_exact == 0.5 and r.content_f1 == 0.5 and r.publish_time_score == 0.5
    full = scoring.report(scoring.score_pages(spark.createDataFrame(GOLD, FIELDS), spark.createDataFrame(PRED, FIELDS + ", rejected boolean")))
    assert {(x["view"], x["value"], x.n_pages) for x in full.collect()} == {("overall", "all", 3), ("dataset", "dev", 3), ("site", "news_cn", 1), ("site", "example_com", 2), ("route", "fixed", 1), ("route", "generic", 2), ("content_structure", "single", 2), ("content_structure", "list_page", 1)}


def test_tags_cover_every_cell(spark):
    row = lambda i, title, structure="single": (i, "d", "s", "r", structure, None, title, None, None, None, None)
    gold = [row("a", ""), row("b", None), row("c", "x"), row("d", "x"), row("e", None, None)]
    pred = [(*row("a", None), None), (*row("b", "y"), None), (*row("c", ""), None), (*row("d", "X "), None)]
    got = {r.id: (r.title_tag, r.title_exact, r.refusal_correct) for r in scoring.score_pages(spark.createDataFrame(gold, FIELDS), spark.createDataFrame(pred, FIELDS + ", rejected boolean")).collect()}
    assert got == {"a": ("correct_empty", None, None), "b": ("false_fill", 0.0, None), "c": ("miss", 0.0, None), "d": ("ok", 1.0, None), "e": (None, None, 1)}


def test_last_line_latest_and_change(spark):
    lines = spark.createDataFrame([(1, "a", "x"), (3, "a", None), (2, "a", "y"), (4, None, "z")], "line_no long, id string, title string")
    assert [(r.id, r.line_no, r.title) for r in scoring.last_line(lines).collect()] == [("a", 3, None)]
    assert scoring.latest(lines, "id", "line_no").select("line_no").first()[0] == 3
    a, b = (spark.createDataFrame(x, "id string, s double") for x in ([("p", 1.0), ("q", 0.5)], [("p", 1.0), ("q", 1.0), ("r", 0.2)]))
    assert sorted((r.id, r.before, r.after) for r in scoring.changed(a, b, "s").collect()) == [("q", 0.5, 1.0), ("r", None, 0.2)]


def test_files(spark, tmp_path):
    (tmp_path / "pred.jsonl").write_text('{"id": "a", "title": "T"}\n\nno json\n{"title": "x"}\n{"id": "a", "rejected": true}\n')
    good, bad = read_pred(spark, str(tmp_path / "pred.jsonl"))
    assert sorted((r.line_no, r.id, r.rejected) for r in good.collect()) == [(1, "a", None), (5, "a", True)]
    assert sorted((r.line_no, r.error) for r in bad.collect()) == [(3, "not JSON"), (4, "no id")]
    for name, text in (("a.json", '{"pages": [{"id": "p", "authors": ["x"]}]}'), ("b.json", '[{"id": "p", "publish_time": {"value": "2024", "utc_offset": null}}]')):
        (tmp_path / name).write_text(text)
        assert read_gold(spark, str(tmp_path / name)).select("id").first()[0] == "p"
    write_lines(good, str(tmp_path / "out"))
    assert '"title":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_upsert_and_violations(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int"), spark.createDataFrame([("a", 9)], "id string, n int")
    assert sorted(map(str, (tuple(r) for r in upsert(old, new, ["id"]).collect()))) == ["('a', 9)", "('b', 2)", "(None, 3)"]
    gold = spark.createDataFrame([(*GOLD[0], False), (*GOLD[0], False)], FIELDS + ", expect_refusal boolean")
    assert {(r.id, r.rule) for r in violations(gold).collect()} == {("p1", "id_twice")}


def test_tags_of_unknown_times_wrong_texts_and_bad_refusals(spark):
    facts = "id string, dataset string, site string, route string, content_structure string, page_condition string"
    fields = "title string, authors array<string>, publish_time string, content_text string"
    gold = spark.createDataFrame([("a", "d", "s", "r", "single", None, "T", None, "XXXX-XX-XX XX:XX:XX", None), ("b", "d", "s", "r", "list_page", None, None, None, None, None)], f"{facts}, {fields}")
    pred = spark.createDataFrame([("a", "T", None, "2024-01-01 10:00:00", "abcdabcd", None), ("b", "T", None, None, None, None)], f"id string, {fields}, rejected boolean")
    scores = scoring.score_pages(gold, pred)
    a = next(r for r in scores.collect() if r.id == "a")
    assert (a.publish_time_tag, a.publish_time_score, a.publish_time_zone, a.publish_time_confused) == ("gold_all_xx", None, None, None)
    assert (a.content_text_tag, a.content_f1, round(a.dup_ratio, 6), a.num_f1, a.lcs_f1) == ("false_fill", 0.0, round(1 / 3, 6), None, None)
    told = scoring.report(scores).collect()
    assert [r.view for r in told] == sorted((r.view for r in told), key=["overall", *scoring.VIEWS].index)
    assert told[0].publish_time_tags.gold_all_xx == 1 and told[0].refusals.asDict() == {"n": 1, "correct": 0} and sum(told[0].publish_time_zones) == 0
    assert {(r.view, r.value, r.id) for r in scoring.bad_refusals(scores).collect()} >= {("overall", "all", "b"), ("content_structure", "list_page", "b")}
    assert {r.id: r.refusal_correct for r in scoring.refusals(gold, pred).collect()} == {"a": None, "b": 0}


def test_medians_equal_spark(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c"]), r.choice([None, *map(float, range(6))])) for _ in range(200)] + [("d", None), (None, 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {x.g: x.m for x in df.groupBy("g").agg(F.median("v").alias("m")).collect() if x.m is not None}
    assert {x.g: x.median for x in medians(df, "g", "v").collect()} == want and medians(df.limit(0), "g", "v").count() == 0
