import pytest
from leafwright.functions.columns import date_on_page, spoken_time, written_time
from leafwright.operators.calibrate import calibrate
from leafwright.pages import body, evidence, names, titles
from leafwright.pages.assist import assist, help_stats
from leafwright.pages.decode import decode
from leafwright.pages.dom import absolute_links, parse, select
from leafwright.pages.record import extract, extract_one, read, resolve
from leafwright.streaming.pages import arrivals, extract_stream, first_fetches
from pyspark.sql import functions as F

P = "<p>The council approved the plan on Monday after a long debate about costs and safety.</p>"


def test_tree_recovers():
    root = parse("<p><b>x<br><p>y</p><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>z</div>")
    assert [p.text() for p in root.all("p")] == ["x", "y"] and [x.text() for x in root.all("li")] == ["a", "b"]
    assert [len(list(tr.all("td"))) for tr in root.all("tr")] == [2, 1] and root.text().endswith("z")
    assert select(root, "ul") is not None and select(root, "div#x") is None
    assert absolute_links(parse('<a href="/a#x">1</a><a href="/a">2</a><a href="mailto:x">3</a>'), "https://h.example/b/") == ["https://h.example/a"]


@pytest.mark.parametrize("raw, used", [(b'<meta charset="utf-8">x', "utf-8"), ("<meta charset=gb18030>中文".encode("gb18030"), "gb18030"), ('<meta charset="utf-8">'.encode() + "中文内容".encode("gb18030"), None), (b"", "utf-8")])
def test_decoding(raw, used):
    text, _, _, got = decode(raw)
    assert used is None or got == used
    assert "�" not in text


def _pages(spark, *pages, **options):
    rows = [(str(i), x[1] if isinstance(x, tuple) else None, (x[0] if isinstance(x, tuple) else x).encode()) for i, x in enumerate(pages)]
    return [r for _, r in sorted((int(r.id), r) for r in resolve(read(spark.createDataFrame(rows, "id string, site string, raw binary")), **options).collect())]


ARTICLE = f"<article>{P * 4}</article>"


def test_meta_beats_json_ld(spark):
    html = '<meta property="og:title" content=""><meta name="twitter:title" content="Meta title"><meta name="pubdate" content="2024年3月1日 8:5"><script type="application/ld+json">{"@graph":[{"@type":["NewsArticle"],"headline":"A &amp;amp; B","author":[{"name":"Jane Roe"},"Tom"],"dateModified":"2024-03-01T10:00:00Z"}]}</script><script type="application/ld+json">{bad</script>'
    (got,) = _pages(spark, html + ARTICLE)
    assert (got.title, got.provenance["title"]) == ("Meta title", "meta:twitter:title") and (got.authors, got.provenance["authors"]) == (["Jane Roe", "Tom"], "json-ld:author")
    assert got.publish_time.value == "2024-03-01 08:05:XX" and (got.update_time.value, got.update_time.utc_offset) == ("2024-03-01 10:00:00", "+00:00")
    assert evidence.json_ld(parse(html))[0]["headline"] == "A & B"


TITLES = [
    ("加息_新浪财经", None, "加息"), ("加息--经济·科技--人民网", None, "加息"), ("加息｜新浪财经", None, "加息｜新浪财经"), ("A plan - Example News", None, "A plan"), ("A plan | kg24", "kg24.example", "A plan"), ("新华网", None, "新华网"), ("A - B study", None, "A - B study"),
    ("A_B_新浪财经", None, "A_B"), ("港口 —— 新华社 | CSDN", None, "港口"), ("_新浪财经", None, "_新浪财经"), ("  A   plan \n today ", None, "A plan today"), ("", None, ""), (None, None, None), ("A--人民网_新浪网", None, "A--人民网"), ("Plan - The Official Website of X", None, "Plan"), ("Guide — Foo documentation", None, "Guide"),
]


def test_title_suffix(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(TITLES)], "i int, t string, s string")
    got = {r.i: r.x for r in df.select("i", titles.without_brand(F.col("t"), F.col("s")).alias("x")).collect()}
    assert [got[i] for i in range(len(TITLES))] == [w for _, _, w in TITLES]


def test_heading_against_title(spark):
    cases = [("Site name", "article", "Harbour opens", True), ("Site name", "banner", "Harbour opens", False), ("Harbour opens today", "article", "Harbour opens", False), ("Site name", "article", "Vol 65 No 6", False), ("Site name", "article", None, False)]
    for title, place, h1, want in cases:
        heading, marks = evidence.heading(parse(f'<div class="{place}"><h1>{h1}</h1></div>')) if h1 else (None, [])
        df = spark.createDataFrame([(title, heading, marks)], "t string, h string, m array<string>")
        assert df.select(titles.contradicted(F.col("t"), F.col("h"), F.col("m"))).first()[0] is want, (title, place, h1)


def test_names(spark):
    df = spark.createDataFrame([([" 张三，", "观察者网", "admin", "Jane Roe", "12345", "OceanBase技术站", None],)], "n array<string>")
    assert df.select(F.transform("n", names.clean)).first()[0] == ["张三", None, None, "Jane Roe", None, "OceanBase技术站", None]
    df = spark.createDataFrame([(["Jane Roe", "Facebook", "May", "News Team"], ["By News Team", "x"])], "n array<string>, l array<string>")
    assert df.select(names.credible(F.col("n"), F.col("l"))).first()[0] == ["Jane Roe", "News Team"]
    content = "本报讯（记者王五、赵六）责任编辑：孙七"
    df = spark.createDataFrame([(["By Jane Roe | x", "By Online Desk follow us", "新华社北京电（记者 王五）港口"], ["港口。李四 摄"], content, ["x"])], "p array<string>, c array<string>, t string, l array<string>")
    assert df.select(names.bylines(*map(F.col, "pctl"))).first()[0] == ["Jane Roe", "孙七（责任编辑）", "王五", "赵六", "李四（摄影）"]
    forms = {"编辑：张三、李四": ["张三（编辑）", "李四（编辑）"], "责编:王五": ["王五（责任编辑）"], "文 | 张三": ["张三"], "执笔：张三 李四": ["张三", "李四"], "澎湃新闻记者 计思敏": ["计思敏"], "by the way": [], "supported by Python.\nFor example": [], "摄影：张三": ["张三（摄影）"], "（记者 王五\n近日）": ["王五"]}
    df = spark.createDataFrame([(k, [k]) for k in forms], "t string, p array<string>")
    none = F.array().cast("array<string>")
    assert {r.t: r.x for r in df.select("t", names.bylines(F.col("p"), none, F.lit(None).cast("string"), none).alias("x")).collect()} == forms


TIMES = {
    "2026-08-11 7:5": ("2026-08-11 07:05:XX", None), "2026 年 8 月 1 日 10:30": ("2026-08-01 10:30:XX", None), "2026-07-10-20:8:00": ("2026-07-10 20:08:00", None), "2026年8月1日 9:5": ("2026-08-01 09:05:XX", None),
    "2026-06-28T03:07:37.000Z": ("2026-06-28 03:07:37", "+00:00"), "2026-06-28T03:07+0800": ("2026-06-28 03:07:XX", "+08:00"), "2026-06-28": ("2026-06-28 XX:XX:XX", None), "发布 2026年6月28日": ("2026-06-28 XX:XX:XX", None), "junk": None, "": None, None: None,
}
SPOKEN = {"June 2, 2024": "2024-06-02 XX:XX:XX", "5th March 2024 | 3:07 PM": "2024-03-05 15:07:00", "Sept. 3, 2024 12:05:09 AM": "2024-09-03 00:05:09", "30.11.2023 9:05": "2023-11-30 09:05:00", "May 2024": None, "16.07.2024": "2024-07-16 XX:XX:XX", "2024-01-02": "2024-01-02 XX:XX:XX", "soon": None}


def test_written_and_spoken_times(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "i int, t string").select("i", written_time(F.col("t")).alias("w"))
    assert [r.w and tuple(r.w) for r in df.orderBy("i").collect()] == list(TIMES.values())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SPOKEN)], "i int, t string").select("i", spoken_time(F.col("t"))["value"].alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == list(SPOKEN.values())
    df = spark.createDataFrame([("2024-05-26 XX:XX:XX", "Manama, May 26 (BNA)\nMay 2024"), ("2024-05-26 XX:XX:XX", "26.05.2024"), ("2024-05-26 XX:XX:XX", "May 27\nMay 2024"), (None, "x")], "v string, p string")
    assert [r[0] for r in df.select(date_on_page(F.col("v"), F.col("p"))).collect()] == [True, True, False, False]


def test_times_of_a_page(spark):
    day = '<meta name="pubdate" content="2024-07-16">'
    both = '<meta property="article:published_time" content="2024-07-16 10:00:00"><meta property="article:modified_time" content="2024-07-16 10:00:00">'
    byline, other, another, copied = _pages(
        spark, f'{day}<div class="info">2024-07-16 10:11 来源</div><div class="date">2024-07-16 10:11</div>{ARTICLE}', f"{day}{ARTICLE}<p>16.07.2024 11:58</p>", f"{day}{ARTICLE}<p>17.07.2024 11:58</p>", both + ARTICLE, offset="+08:00"
    )
    assert byline.publish_time.asDict() == {"value": "2024-07-16 10:11:XX", "utc_offset": "+08:00", "utc_offset_source": "inferred_site_locale"}
    assert other.publish_time.value == "2024-07-16 11:58:00" and another.publish_time.value == "2024-07-16 XX:XX:XX" and copied.update_time is None


def test_site_rules(spark):
    news = f'<h1>港口开放</h1><div class="info">2024-07-16 10:11:12 来源：新华网</div><div id="detail"><p><img src=a.jpg></p><p>新华社记者 李四 摄</p>{"<p>" + "港口正文很长。" * 40 + "</p>"}<p>文字记者：王五、赵六</p><p>海报设计：孙七</p><span class="editor">【责任编辑:周八】</span></div>'
    daily = f'<meta name="author" content="Clerk"><meta name="pubdate" content="2024-07-16"><h1>Ports open</h1><span class="info_l">By ZHOU LANXU in Beijing and SHI JING in Shanghai | chinadaily.com.cn | Updated: 2024-07-16 10:11</span><div id="Content"><figure><img src=a.jpg><figcaption>WANG WU/CHINA DAILY</figcaption></figure>{P * 4}</div>'
    gov = f'<meta name="author" content="张三"><meta name="firstpublishedtime" content="2024-07-10-20:28:00"><meta name="lastmodifiedtime" content="2024-07-10-20:28:00"><div class="share-title">公告</div><div class="pages-date">来源：新华社 x</div><div id="UCAP-CONTENT">{P * 4}</div>'
    unsigned = daily.replace("By ZHOU LANXU in Beijing and SHI JING in Shanghai", "chinadaily.com.cn").replace("WANG WU/CHINA DAILY", "A port")
    got, second, third, fourth = _pages(spark, (news, "news_cn"), (daily, "chinadaily"), (gov, "gov_cn"), (unsigned, "chinadaily"))
    assert got.title == "港口开放" and got.source.publisher == "新华网" and got.publish_time.asDict() == {"value": "2024-07-16 10:11:12", "utc_offset": "+08:00", "utc_offset_source": "inferred_site_locale"}
    assert got.authors[:4] == ["李四（摄影）", "王五", "赵六", "孙七（海报设计）"] and "周八（责任编辑）" in got.authors and got.images[0].caption == "新华社记者 李四 摄"
    assert second.authors == ["ZHOU LANXU", "SHI JING", "WANG WU（摄影）"] and second.publish_time is None and second.update_time.value == "2024-07-16 10:11:XX" and "[[IMG_1]]" in second.content_text
    assert third.title == "公告" and third.authors[0] == "张三（责任编辑）" and third.update_time.value == third.publish_time.value == "2024-07-10 20:28:00" and third.source.publisher == "新华社"
    assert fourth.authors is None


def test_photo_sets(spark):
    figures = lambda n, caption: "<div class=gallery>" + "".join(f"<figure><img src=p{i}.jpg><figcaption>{caption}</figcaption></figure>" for i in range(n)) + "</div>"
    intro = "<p>A short introduction to the pictures of this year’s harbour days and of those who came to see the ships and each other, told in one line of moderate length and no more than that.</p>"
    prose = "<p>" + "The council approved the plan on Monday after a long debate about costs and safety and what it means. " * 2 + "</p>"
    photos = intro + figures(9, "Photo of the harbour")
    beside, inside = figures(9, "Photo of the harbour") + ("<p>" + "x" * 150 + "</p>") * 4, photos.replace("<figure>", "<p>" + "y" * 250 + "</p><figure>", 1)
    refused = [r.route == "refused:photo_set" for r in _pages(spark, photos, intro + figures(7, "Photo of the old harbour at noon"), beside, inside)]
    assert refused == [True, True, False, False]  # an article beside its pictures or between them speaks against a set
    assert _pages(spark, photos, limits={"set_images": 20, "set_captions": 20})[0].route != "refused:photo_set"
    told = calibrate(spark.createDataFrame([("a", None, f"<title>A plan for the town</title><div>{prose * 6}</div>".encode(), False), ("b", None, ("<a href=x>A long enough link text</a>" * 40).encode(), True)], "id string, site string, raw binary, expect_refusal boolean"))
    assert told.first().asDict() == {"pages": 2, "false_refusals": 0, "missed_refusals": 0, "synthetic": 3, "missed_synthetic": 0}


def test_model_help(spark):
    html = f"<title>kg24</title>{P * 4}<p>Jane Roe</p><p>Published on 16 July 2024</p><p>said Mr 朱先生</p>"
    records = resolve(read(spark.createDataFrame([("a", "kg24.example", html.encode()), ("b", None, b"x")], "id string, site string, raw binary")))
    answer = {"title": "The council approved the plan", "authors": ["Jane Roe", "Nobody", "朱先生"], "publish_time": "July 16, 2024"}
    got = {r.id: r for r in assist(records, lambda text: answer).collect()}
    assert got["a"].title == "The council approved the plan" and got["a"].authors == ["Jane Roe"] and got["a"].publish_time is not None and got["a"].route.endswith("+model[title,authors,publish_time]")
    assert not got["b"].asked and got["b"].rejected and got["b"].filled == []

    def fails(text):
        raise ValueError(text)

    assert help_stats(assist(records, fails)).first().asDict() == {"pages": 2, "asked": 1, "failed": 1, "filled_title": 0, "filled_authors": 0, "filled_publish_time": 0}
    assert help_stats(assist(records, None)).first().asked == 0


def test_body():
    html = f"<article><h2>Head</h2>{P * 3}<figure><img data-src=a.jpg><figcaption>A boat</figcaption></figure><table><tr><th>a<th>b<tr><td colspan=2>1|2</table><ul><li>one<ul><li>two</ul></ul><blockquote><p>said</p></blockquote><pre><code class='language-py'>x = 1</code></pre></article><nav>menu</nav>"
    own, origin = body.main_content(parse(html))
    assert origin == "readable" and "A boat" in own.lines and own.flags == ["table_colspan_flattened"]
    assert own.text.count("[[IMG_") == len(own.images) == 1 and "menu" not in own.text
    for part in ("### Head", "| a | b |", "1\\|2", "- one", "  - two", "> said", "```py\nx = 1\n```"):
        assert part in own.md, part
    assert body.densest(parse(f"<div id=a>{P * 4}</div><div id=b>{'<a href=x>' + P + '</a>'}</div>")).attrs["id"] == "a"


def test_extract_rejects_and_survives(spark):
    links = "<a href=x>A long enough link text</a>" * 40
    shots = "".join(f"<figure><img src=p{i}.jpg><figcaption>Photo number {i} of it</figcaption></figure>" for i in range(9)) + "<p>A short introduction to the pictures.</p>"
    rows = [("ok", "x.example", f"<title>Plan approved today</title><article>{P * 4}</article>".encode()), ("list", "x", links.encode()), ("shell", "x", b"<p>short</p>"), ("photos", "x", f"<div>{shots}</div>".encode()), ("pay", "x", f"<div id=chargeWall></div>{P * 9}".encode()), ("null", None, None)]
    df = spark.createDataFrame(rows, "id string, site string, raw binary").selectExpr("*", "1 AS title", "2 AS measures")
    got = {r.id: r for r in extract(df).collect()}
    assert {k: r.route for k, r in got.items()} == {"ok": "metadata+readable", "list": "refused:list_page", "shell": "refused:empty_shell", "photos": "refused:photo_set", "pay": "refused:paywall", "null": "refused:empty_shell"}
    assert got["ok"].title == "Plan approved today" and got["shell"].needs_render and got["photos"].content_structure == "photo_set" and all(r.error is None for r in got.values())
    one, eight = (sorted(map(str, extract(df.repartition(n)).collect())) for n in (1, 8))
    assert one == eight
    assert extract(df.limit(0)).count() == 0


def test_site_rule_vetoes(spark):
    html = f'<meta name="pubdate" content="2024-01-01"><meta name="author" content="Web Team"><h1>Title here</h1><span class="info_l">chinadaily.com.cn | Updated: 2024-01-02 10:00</span><div id="Content">{P * 4}</div>'
    r = extract(spark.createDataFrame([("a", "chinadaily", html.encode())], "id string, site string, raw binary")).first()
    assert r.publish_time is None and r.update_time.value == "2024-01-02 10:00:XX" and r.authors is None and r.route == "site_rules"


def test_one_page(spark):
    got = extract_one(spark, f"<title>A plan</title>{ARTICLE}".encode())
    assert got["title"] == "A plan" and got["content_text"].count("approved") == 4 and got["error"] is None


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "s", f"<article>{P * 4}</article>")], "id string, site string, raw string").write.parquet(str(tmp_path / "pages"))
    pages = spark.readStream.schema("id string, site string, raw string").parquet(str(tmp_path / "pages"))
    query = extract_stream(pages).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("records").count() == 1
    spark.sql("SELECT * FROM VALUES ('a', 's', timestamp'2025-01-01 10:00:00', 1L), ('a', 's', timestamp'2025-01-01 11:00:00', 2L), ('b', 's', timestamp'2025-01-03 10:00:00', 4L) AS t(id, site, fetched_at, bytes)").write.parquet(str(tmp_path / "index"))
    index = spark.readStream.schema("id string, site string, fetched_at timestamp, bytes long").parquet(str(tmp_path / "index"))
    for name, df, mode, n in (("firsts", first_fetches(index), "append", 2), ("days", arrivals(index), "complete", 2)):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() == n


@pytest.mark.parametrize("encoding, body", [("cp1251", "Городской совет в понедельник после долгих споров о расходах одобрил план восстановления набережной и старой пекарни. "), ("big5", "市議會週一經過長時間辯論後通過了修復海濱與老麵包店的計畫，工程預計明年春天開始。"), ("shift_jis", "市議会は月曜日、費用と安全について長い議論を重ねた後、海岸の修復計画を承認しました。"), ("cp1252", "Der Gemeinderat hat am Montag nach längerer Debatte über Kosten und Sicherheit die Pläne für die Mühle und die Brücke größtenteils gebilligt. ")])
def test_encoding_after_long_ascii_head(encoding, body):
    raw = b"<html><head><script>" + b"var x = 1; call(x);\n" * 5000 + b"</script></head><body><p>" + (body * 8).encode(encoding) + b"</p></body></html>"
    text, declared, _, _ = decode(raw)
    assert declared is None and body * 8 in text
