import json

from leafwright.operators import validate
from leafwright.pages import gold as tools
from leafwright.pages.connector import HttpModel
from leafwright.plans import iterate
from leafwright.session import cut
from leafwright.sources import index as source
from pyspark.sql import functions as F

P = "<p>The council approved the plan on Monday after a long debate about costs, safety and the harbour.</p>"


def test_numbered_lines_over_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 700), ("b.jsonl", 40)):
        (tmp_path / name).write_text("".join("\n" if i % 50 == 7 else json.dumps({"id": f"{name}{i}", "title": "x" * (i % 90)}) + "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = source.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        got = {(r.file.rsplit("/", 1)[-1], r.line_no): r.line for r in lines.collect()}
        good, bad = source.read_pred(spark, str(tmp_path / "a.jsonl"))
        assert good.count() == 686 and bad.count() == 0 and {r.line_no for r in good.select("line_no").collect()} == {i + 1 for i in range(700) if i % 50 != 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a.jsonl", 700), ("b.jsonl", 40)):
        for i, line in enumerate((tmp_path / name).read_text().split("\n")[:n]):
            assert got[name, i + 1] == line


def test_collecting(spark):
    pages = spark.createDataFrame([("p1", "s", "https://s.example/a/", b'<a href="b#x">1</a><a href="/c">2</a><a href="b">3</a><a href="mailto:x">4</a>'), ("p2", "s", "https://s.example/", b'<a href="/c">2</a><a href="/d">5</a>')], "id string, site string, url string, raw binary")
    assert {(r.url, r.page_id) for r in source.links(pages).collect()} == {("https://s.example/a/b", "p1"), ("https://s.example/c", "p1"), ("https://s.example/d", "p2")}
    assert {r.url for r in source.links(pages, "/d$").collect()} == {"https://s.example/d"}
    html = ('<meta charset = "UTF-8"><script>xx</script>' + P * 40).encode()
    attempts = spark.createDataFrame([("s", i, f"u{i}") for i in range(20)] + [("t", 0, "u0")], "site string, position int, url string")

    def get(url):
        if url == "u1":
            raise OSError("down")
        return (b"<p>short</p>" if url == "u2" else b" " * 3000 if url == "u3" else html), url + "/final"

    fetched = cut(source.index_rows(source.fetch(attempts, get).withColumnRenamed("url", "id"), F.lit("")).drop("note").withColumnRenamed("id", "url"))
    row = fetched.where("site = 't'").first()
    assert row.encoding_declared == "UTF-8" and row.encoding_detected == "ascii" and row.bytes == len(html) and row.visible_text > 1000
    seen = source.fetch(attempts, get).join(fetched.select("url", "bytes", "visible_text").distinct(), "url")
    targets = spark.createDataFrame([("s", 3), ("t", 2)], "site string, target int")
    saved, failed = source.gate(seen, targets)
    assert {(r.site, r.url, r.seq) for r in saved.collect()} == {("s", "u0", 1), ("s", "u4", 2), ("s", "u5", 3), ("t", "u0", 1)}
    assert {(r.url, r.reason.split(":")[0]) for r in failed.collect()} == {("u1", "fetch"), ("u2", "too_small"), ("u3", "empty_shell_suspected")}
    assert {(r.site, r.saved, r.failed) for r in source.run_summary(saved, failed, targets).collect()} == {("s", 3, 3), ("t", 1, 0)}
    index = spark.createDataFrame([(f"s{i % 5}", i) for i in range(40)] + [(None, 1)], "site string, pos int")
    assert {(r.site, r.pos, r.site_rank, r.page_rank) for r in source.sample_sites(index, "pos", 3, 2).collect()} == {("s0", 0, 1, 1), ("s0", 5, 1, 2), ("s1", 1, 2, 1), ("s1", 6, 2, 2), ("s2", 2, 3, 1), ("s2", 7, 3, 2)}


GOLD = "id string, group string, site string, url string, path string, sha1 string, page_condition string, needs_render boolean, content_structure string, expect_refusal boolean, title string, authors array<string>, publish_time struct<value: string, utc_offset: string, utc_offset_source: string>, update_time struct<value: string, utc_offset: string, utc_offset_source: string>, content_text string, content_md string, conversion_flags array<string>, images array<struct<url: string>>, source struct<publisher: string>, provenance map<string, string>, notes string"


def test_record_violations(spark):
    prov = {c: "x" for c in ("title", "authors", "publish_time", "update_time", "content_text", "content_md", "images", "source.publisher")}
    good = {"id": "a", "group": "g", "site": "s", "url": "u", "path": "p", "sha1": "h", "page_condition": "ok", "needs_render": False, "content_structure": "single", "expect_refusal": False, "title": "T", "authors": ["x"], "publish_time": ("2024-01-02 10:00:00", "+08:00", None), "update_time": None, "content_text": "x [[IMG_1]]", "content_md": "[[IMG_1]]", "conversion_flags": [], "images": [("u",)], "source": ("P",), "provenance": prov, "notes": ""}
    bad = good | {"id": "b", "publish_time": ("2024-1-2", "8", "guess"), "update_time": ("2024-01-01 10:00:00", None, "inferred_site_locale"), "content_text": "[[IMG_2]]", "content_md": "x", "provenance": {}, "conversion_flags": None, "title": "", "content_structure": "x", "page_condition": None}
    refused = good | {"id": "c", "expect_refusal": True}
    inverted = good | {"id": "devto__01", "update_time": ("2024-01-01 10:00:00", "+08:00", None)}
    index = spark.createDataFrame([("a", "g", "s", "u", "p", "h"), ("b", "g", "s", "other", "p", "h"), ("c", "g", "s", "u", "p", "h"), ("z", "g", "s", "u", "p", "h")], "id string, group string, site string, url string, path string, sha1 string")
    rows = spark.createDataFrame([tuple(r.values()) for r in (good, bad, refused, inverted, refused)], GOLD)
    found = {}
    for r in validate.record_violations(rows, index).collect():
        found.setdefault(r.id, set()).add(r.rule)
    assert "a" not in found and found["devto__01"] == {"not_in_index"} and found["z"] == {"not_in_gold"}
    assert found["b"] == {"publish_time_form", "publish_time_offset_form", "publish_time_offset_source", "update_time_offset_source_alone", "image_without_mark", "mark_without_image", "image_not_in_markdown", "conversion_flags_missing", "article_empty:title", "update_before_publish", "structure_unknown", "condition_unknown", "differs:url", *(f"provenance_missing:{c}" for c in ("authors", "publish_time", "update_time", "content_text", "content_md", "images", "source.publisher"))}
    assert found["c"] == {"id_twice", "refusal_evidence_missing", "refusal_notes_missing", *(f"refusal_filled:{c}" for c in ("title", "authors", "publish_time", "content_text", "content_md", "images"))}
    assert validate.missing_fields(rows) == [] and "title" in validate.missing_fields(rows.drop("title"))


def test_gold_tools(spark):
    df = spark.createDataFrame([("  a 　 b\n c ", "港口 | 新华网频道", "2026-08-11T17:30+0800"), (None, "A - B", "2026-8-1")], "w string, t string, i string")
    got = df.select(tools.norm_ws(F.col("w")).alias("w"), tools.clean_title(F.col("t")).alias("t"), tools.iso_value(F.col("i")).alias("i")).collect()
    assert [(r.w, r.t, tuple(r.i)) for r in got] == [("a b\n c", "港口", ("2026-08-11 17:30:XX", "+08:00")), (None, "A - B", (None, None))]
    html = f'<title>T</title><meta name="author" content="A"><h1>H</h1><div class="info">来源: X</div><time datetime="2024">now</time><div id="c"><p>one <img src=a.jpg> two</p><div class="ad"><p>buy</p></div><figure><img data-src=b.jpg><figcaption>cap</figcaption></figure><ul><li>x</li></ul></div>'
    pages = spark.createDataFrame([("a", "s", html.encode()), ("b", "t", html.encode()), ("c", "s", None)], "id string, site string, raw binary")
    got = {r.id: r for r in tools.annotate(pages, (tools.Recipe("s", "div#c", ("div.ad",)),)).collect()}
    assert got["a"].content_text == "one [[IMG_1]] two\n[[IMG_2]]\nx" and got["a"].images[1].caption == "cap" and got["b"].content_text is None and got["c"].content_text is None
    shown = {r.id: r for r in tools.evidence_dump(pages).collect()}["a"]
    assert (shown.title_tag, shown.headings, shown.meta["author"], shown.bylines, shown.images) == ("T", ["H"], "A", ["来源: X"], 2)


def test_content_candidates(spark):
    long, short = "x" * 400, "y" * 320
    html = f"<main><div><p>{long}</p></div><div><p>{short}</p><p>{short}</p></div></main><p>{'z' * 299}</p>"
    got = tools.content_candidates(spark.createDataFrame([("a", html.encode()), ("b", None)], "id string, raw binary")).collect()
    assert [(r.id, r.rank, r.tag, r.length) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 1, "main", 1040), ("a", 2, "div", 640), ("a", 3, "div", 400), ("a", 4, "p", 320), ("a", 5, "p", 320)]


def test_iteration(spark, tmp_path):
    pages = spark.createDataFrame([("a", "s", f"<title>Plan</title><article>{P * 4}</article>".encode()), ("n", "s", b"<p>x</p>")], "id string, site string, raw binary")
    gold = spark.createDataFrame([("a", "d", "s", "r", "single", None, "Plan", None, None, None, "\n".join([P[3:-4]] * 4))], "id string, dataset string, site string, route string, content_structure string, page_condition string, title string, authors array<string>, publish_time struct<value: string, utc_offset: string>, update_time struct<value: string, utc_offset: string>, content_text string")
    for i in range(2):
        history = iterate.iterate(pages, gold, str(tmp_path / "h"), f"v{i}", negatives=["n", "gone"])
    row = history.first()
    assert history.count() == 2 and row.scores["content_f1"] == 1 and row.scores["title_exact"] == 1 and (row.negative_correct, row.negative_total, row.pages) == (2, 2, 2)
    control = iterate.control_arm(pages)
    told = {r.metric: r for r in iterate.arms(gold, {"rules": iterate.record.extract(pages), "control": control}).collect()}
    assert told["content_f1"].rules == told["content_f1"].control == 1
    assert {r.stage for r in iterate.stage_times(iterate.record.read(pages)).collect()} == {"decode", "parse", "evidence", "body"}
    assert HttpModel("http://localhost:1", "m").model == "m"
