import random
import time
import unicodedata
from collections import Counter
from itertools import product
from pathlib import Path

import pytest
from leafwright.llm import encoding, exemplars, furniture, linemodel, repetition, residue, sitelines

PROSE = "In Norton the hearing was rerouted in silence because the historic bakery had been repaired."


# --- lines repeated across a source
def _brute(rows):
    pages = {i: (s, t) for i, s, t in rows if i is not None and s is not None}

    def norm(x):
        y = "".join(unicodedata.normalize("NFKC", x).casefold().split())
        out, digits = "", False
        for c in y:
            out += "" if c.isdigit() and digits else "0" if c.isdigit() else c
            digits = c.isdigit()
        return None if out in ("", "[[img_0]]") else out

    lines = {i: (s, [norm(x) for x in t.split("\n")] if t is not None else []) for i, (s, t) in pages.items()}
    n, k = Counter(s for s, _ in lines.values()), Counter()
    for s, ls in lines.values():
        k.update((s, x) for x in set(ls) - {None})
    return {(i, j + 1) for i, (s, ls) in lines.items() for j, x in enumerate(ls) if x and k[s, x] >= 4 and k[s, x] >= 0.1 * n[s]}


def test_site_lines_match_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        site = r.choice(["a", "a", "a", "b", None])
        own = [f"Terms of use {i}", "ＴＥＲＭＳ of  use 7", "Follow us", " ", "[[IMG_3]]", f"unique text {chr(97 + i % 26)}{chr(97 + i // 26)}"]
        rows.append((f"p{i}", site, None if i % 17 == 0 else "\n".join(r.sample(own, 4))))
    rows += [rows[0], (None, "a", "Follow us"), ("empty", "a", "")]
    df = spark.createDataFrame(rows, "id string, site string, content string").selectExpr("*", "1 AS hash", "2 AS _row")
    pages = sitelines.line_hashes(df, "id", "site", "content")
    assert {(x.id, x.line_no) for x in sitelines.excess_occurrences(pages, "id", "site").collect()} == _brute(rows)
    removed = sitelines.remove_excess_lines(df, "id", "site", "content").collect()
    kept = {x.id: x for x in removed}
    assert len(removed) == len(rows) and kept["empty"].content == "" and kept[None].content == ""
    for i, _, t in rows:
        if i and t and kept[i].site:
            gone = {j for k, j in _brute(rows) if k == i}
            assert kept[i].content == "\n".join(x for j, x in enumerate(t.split("\n"), 1) if j not in gone) and kept[i].removed == len(gone)
    assert sitelines.excess_occurrences(sitelines.line_hashes(df.limit(0), "id", "site", "content"), "id", "site").count() == 0


def test_lines_as_frequent_elsewhere_are_no_excess(spark):
    r = random.Random(9)
    page = lambda i, *more: "\n".join([f"own text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} of page {chr(97 + i % 7)}", *more])
    rows = [(f"a{i}", "a", page(i, *(["Follow us"] if i < 4 else []), *(["Terms"] if i < 30 else []))) for i in range(40)]
    rows += [(f"b{i}", f"b{i % 5}", page(r.randrange(600), *(["Follow us"] if i % 12 == 0 else []))) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, site string, content string")
    pages = sitelines.line_hashes(df, "id", "site", "content")
    found = {(x.id, x.line_no) for x in sitelines.excess_occurrences(pages, "id", "site").collect()}
    assert {i for i, _ in found} == {f"a{i}" for i in range(30)} and ("a0", 2) not in found and ("a0", 3) in found  # 4 of 40 is a tenth, but other sites have it on a twelfth
    assert sitelines.excess_lines(pages, "site", q=1e9).count() > sitelines.excess_lines(pages, "site").count()


# --- repetition
def _share(text, n):
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
    runs, covered = {}, set()
    for i in range(len(words) - n + 1):
        if tuple(words[i : i + n]) in runs:
            covered |= set(range(i, i + n))
        runs.setdefault(tuple(words[i : i + n]), i)
    return sum(len(words[i]) + 1 for i in covered) / sum(len(w) + 1 for w in words)


def test_repetition(spark):
    r = random.Random(1)
    plain = lambda k: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(k))
    block = plain(20)
    texts = [None, "", "...", plain(200), f"{plain(30)} {block} {plain(9)} {block} {block}", "Yes. yes! YES?", "项目一百二十个正在修复之中，" * 3, "a b c", f"{PROSE} {PROSE} Other words stand here alone.", "x " * 30_000, "\n".join(f"- item: {i}.5" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "'z' AS repeated_share", "'q' AS _n")
    got = {x.doc_id: x for x in repetition.judge(df, "text").collect()}
    assert [got[i].repeated_share for i in (0, 1, 2, 3, 7)] == [0, 0, 0, 0, 0]
    assert got[4].repeated_share == pytest.approx(_share(texts[4], 8), abs=0.01) and got[4].piece_share == 0
    assert got[5].repeated_share == pytest.approx(2 / 3) and got[6].repeated_share == pytest.approx(2 / 3, abs=0.01)
    assert got[8].repeated_share == pytest.approx(len(PROSE) / len(texts[8]), abs=0.05) and got[9].repeated_share > 0.99 and got[10].repeated_share > 0.9
    assert "passages" in got[8].broken and "short" in got[7].broken and got[9].top_word_share == 1
    assert repetition.measure(df.limit(0), "text").count() == 0


# --- wrong encodings
CLEAN = ["Größere Störung über der Mühle für zwölf Wochen", "Créée en 1950, la pépinière ferme la vallée haute grâce à l’été", "В начале весны обсерватория у города снова передала машины", "从槐岗县到湄堰市，窑炉、电网和新建的水库陆续抽检。", "“The engine is temporary,” she said – and left", "A câmara não ampliou a região à noite", "Desde niño pintó la guardería según el censo", "Plain words only", "© 2024 Harborwire. All rights reserved."]


@pytest.fixture(scope="module")
def model():
    r = random.Random(2)
    words = [x.split(" ") for x in CLEAN]
    return encoding.Model([x for _ in range(40) for x in CLEAN] + [" ".join(r.sample(w, len(w))) for _ in range(20) for w in words])


@pytest.mark.parametrize("line, pair", [(x, p) for x, p in product(CLEAN, [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "gb18030"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("gb18030", "latin-1"), ("koi8-r", "cp1251"), ("utf-8 twice", "cp1252")])])
def test_garbled_lines_come_back(model, line, pair):
    bad = encoding.garble(line, pair)
    if bad is None or bad == line or sum(c > "\x7f" for c in line) < 2:
        return
    found = model.verdict(bad, model.label([bad])[0])
    assert found is not None
    if encoding.restore(bad, ">".join(pair)) == line and "�" not in bad:
        assert found[1] == line


def test_clean_and_lost_lines(model, spark):
    for line in [*CLEAN, "GRÖSSERE STÖRUNG", "", "x" * 50_000]:
        assert model.verdict(line, model.label([line])[0]) is None
    df = spark.createDataFrame([("a", "ok\nGr��ere St�rung\nMÃ¼hle über"), ("a", "ok\nGr��ere St�rung\nMÃ¼hle über"), ("b", None), ("c", ""), (None, "Ã¼ber der MÃ¼hle")], "id string, text string").selectExpr("*", "1 AS state")
    got = {(x.id, x.line_no, x.restored) for x in encoding.garbled_lines(df, "id", "text", model).collect()}
    assert {g[:2] for g in got} >= {("a", 2), (None, 1)} and ("a", 2, None) in got and (None, 1, "über der Mühle") in got
    assert encoding.garbled_lines(df.limit(0), "id", "text", model).count() == 0


# --- residue
RESIDUE = ["{{ post.body|raw }}", "Lorem ipsum dolor sit amet consectetur", "asdf asdf jkl; asdf asdf", "404 Not Found\ngatekeeper/1.2", "Home\nSport\nPlease wait while we redirect you…", "请完成安全验证后继续访问\n验证编号88", "- - - - - -", "Ｙｏｕ ｎｅｅｄ ｔｏ ｅｎａｂｌｅ ＪａｖａＳｃｒｉｐｔ ｔｏ ｒｕｎ ｔｈｉｓ ａｐｐ．", "Dear {$name},\nyour order of {$quote} leaves {$city} on {$date}."]
ARTICLES = [PROSE, f"{PROSE}\n{{{{ ad_slot_3 }}}}", "Error 404 pages were reopened last week by Ardria Observatory.", f"{PROSE}\nPlease turn on JavaScript to see the comments.", "模板里的 {{ title }} 会被低洼的林场替换，逄澍舟解释道。", "Why the hearing moved\n[[IMG_1]]", "", " \n ", None]


def test_residue(spark):
    rows = [(f"r{i}", t, None) for i, t in enumerate(RESIDUE)] + [(f"a{i}", t, "ardria_post") for i, t in enumerate(ARTICLES)] + [("r0", RESIDUE[0], None), ("long", PROSE * 5000, None)]
    df = spark.createDataFrame(rows, "id string, text string, site string").selectExpr("*", "1 AS _key")
    fitted = residue.Fitted(fill=exemplars.Fill([PROSE.lower(), *map(str.lower, CLEAN)]))
    assert {x.id for x in residue.residue_pages(df, "id", "text", "site", fitted).collect()} == {f"r{i}" for i in range(len(RESIDUE))}
    assert {x.id for x in residue.residue_pages(df, "id", "text", "site").collect()} == {f"r{i}" for i in range(len(RESIDUE))}
    assert {x.id for x in residue.exclude_residue(df, "id", "text", "site").collect()} == {f"a{i}" for i in range(len(ARTICLES))} | {"long"}
    assert residue.residue_pages(df.limit(0), "id", "text", "site").count() == 0


def test_every_exemplar_finds_itself():
    judge = residue.Judge()
    for x in [*exemplars.RESIDUE, *exemplars.RESIDUE_GENERAL]:
        assert judge.label(exemplars.mask(x.replace("…", "xyzzy").replace("#", "7").replace("@", "ardria post"), "ardria post")) == "residue", x


# --- furniture
def _cut_by_hand(costs, edges):
    best = min(product((0, 1), repeat=len(costs)), key=lambda s: sum(-c if x else 0 for c, x in zip(costs, s)) + sum(w for w, a, b in zip(edges, s, s[1:]) if a != b))
    return [bool(x) for x in best]


def test_min_cut_is_minimal():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 9)
        costs, edges = [r.uniform(-6, 6) for _ in range(n)], [r.uniform(0, 5) for _ in range(n - 1)]
        assert furniture.min_cut(costs, edges) == _cut_by_hand(costs, edges)


PAGE = f"""Home | Sport | World | Log in
You are here: News > A plan
A plan for the harbour
By Ardria Post staff

{PROSE}
[[IMG_1]]
A quiet harbour
Story continues below
{PROSE}
- vineyard: 25.4
Most read
Northern kitchen insured before dawn
2. Why the marsh transferred last week
Next: Why the cable weighed in public
{{{{ ad_slot }}}}
© 2024 Ardria Post. All rights reserved."""
GONE = {1, 2, 9, 12, 13, 14, 15, 16, 17}


def _fitted(model, spread=False):
    """Models fitted on pages of a few sites that end in lines of their own; with ``spread``, exemplars' words are left to the classifier."""
    r = random.Random(6)
    own = ["Join the reading circle of {s} today", "Plant of the week: {w}", "Ask the gardener: {w}", "Printed on paper from the mill at {s}"]
    pages = []
    for i in range(160):
        s = f"site_{i % 4}"
        body = [" ".join(r.sample(PROSE[:-1].split(), 9)) + " " + r.choice("abcdefgh") * 5 + f" {i}." for _ in range(5)]
        pages.append(("\n".join([*body, *(x.format(s=s.replace("_", " "), w=" ".join(r.sample(PROSE[:-1].split(), 3))) for x in own)]), s))
    index = exemplars.Index(residue.labelled(), bags=residue.bags())
    articles = linemodel.article_lines(pages, index, residue.COVERED)
    return residue.Fitted(model, linemodel.residue_model(articles, residue.labelled()["residue"]), linemodel.furniture_model(pages), exemplars.Fill(articles))


def test_other_wordings_of_notices(model):
    judge = residue.Judge(_fitted(model))
    for x in ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Your browser does not support JavaScript. Please enable it to view this page.", "This website requires JavaScript to be enabled in order to work properly.", "HTTP 502 Bad Gateway. The upstream server failed to respond in time.", "Sorry, the page you requested could not be located on our server.", "This site needs JavaScript. Turn it on in your browser and reload the page.", "Please enable\nJavaScript to\nview this page", "Loqua sitdo remtur lorvelsec ipquaqua pistur elsum doloit secad turlaci qualor"]:
        assert judge.residue(x, None)[0], x
    for x in [PROSE, f"{PROSE} Please enable JavaScript to view this page.", "The historic bakery in Norton had been repaired because of an error in the hearing.", "A"]:
        assert not judge.residue(x, None)[0], x


def test_lines_that_repeat_teach_furniture(model):
    fitted = _fitted(model)
    c = furniture.Classifier(fitted)
    text = f"{PROSE}\n\nPlant of the week: a new oak\n{PROSE}\nAsk the gardener: what of moss\nPrinted on paper from the mill at Zanholm"
    assert c.batch([text], ["other_site"], [None]) == [[3, 5, 6]]
    assert furniture.Classifier(residue.Fitted(model)).batch([text], ["other_site"], [None]) != [[3, 5, 6]]
    for x in ["We use cookies and similar technologies to improve your experience.", "Sign in to leave a comment on this story.", "Subscribe to our newsletter to receive the best stories every week."]:
        assert c.kind(exemplars.mask(x, None))[0] == "furniture"
    lines, labels = linemodel.label_by_repetition([("", None), ("a b c d e f g", None), *[(f"x: {i}", "s") for i in range(4)]])
    assert lines == ["a b c d e f g", *["x: #"] * 4] and labels == [0.0, 1.0, 1.0, 1.0, 1.0]
    assert linemodel.LineModel([], []).score("x", ["x"]) == 0.0


def test_frequent_words(spark):
    df = spark.createDataFrame([("The Ox 数据库",), ("the cat 数据",), ("THE the",), (None,), ("",)], "t string")
    frequent, rare = residue.frequent_words(df, "t", 2)
    assert set(frequent) == {"the", "数据"} and frequent["the"] < frequent["数据"] <= rare
    assert residue.frequent_words(df.limit(0), "t")[0] == {}


def test_fitting_on_a_corpus(spark):
    df = spark.createDataFrame([(f"{PROSE}\nTerms {i}\nGrößere Störung {i}", "s") for i in range(30)] + [(None, None), ("", "s")], "t string, s string")
    fitted = residue.fit(df, "t", "s")
    assert fitted.furniture is not None and fitted.residue is not None and "the" in fitted.frequent
    empty = residue.fit(df.limit(0), "t", "s")
    assert residue.Judge(empty).residue(PROSE, None) == (False, PROSE)


def test_line_model_of_a_corpus_is_that_of_its_lines(spark):
    rows = [(exemplars.mask(x, None), float(i % 2), 1.0 + i % 3) for i, x in enumerate([*CLEAN, PROSE, PAGE.replace("\n", " "), "- - -"])]
    got = linemodel.LineModel.of_corpus(spark.createDataFrame(rows, "line string, label double, n double").repartition(3), True)
    want = linemodel.LineModel(*map(list, zip(*rows)), True)
    assert got.bias == pytest.approx(want.bias, abs=1e-5) and got.words == pytest.approx(want.words, abs=1e-5) and got.shapes == pytest.approx(want.shapes, abs=1e-5)


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_passes_of_a_descent_are_no_jobs(spark, monkeypatch):
    lines = [(f"{r} ⟨slot⟩ {PROSE.lower()} {i % 7}", float(i % 2), 1.0 + i % 3) for i, r in enumerate(["quay", "tide", "moor - here:", ""] * 60)] + [("- - -", 0.0, 2.0)]
    df = spark.createDataFrame(lines, "line string, label double, n double").repartition(5)
    monkeypatch.setattr(linemodel, "BLOCK", 11)
    got, jobs = _jobs(spark, "stage", lambda: linemodel.LineModel.of_corpus(df))
    assert jobs < linemodel.ROUNDS / 4
    monkeypatch.setattr(linemodel, "EXCHANGED", 0)
    want = linemodel.LineModel.of_corpus(df)
    alone = linemodel.LineModel(*map(list, zip(*lines)))
    for other in want, alone:
        assert got.bias == pytest.approx(other.bias, abs=1e-5) and got.words == pytest.approx(other.words, abs=1e-5) and got.shapes == pytest.approx(other.shapes, abs=1e-5)
    empty = linemodel.LineModel.of_corpus(df.limit(0))
    assert empty.bias == 0 and not empty.words


def test_blocks_are_narrow_and_sum_right(tmp_path):
    lines = [(f"{w} quayside - {PROSE.lower()}" if w else "- - -", float(i % 2), 1.0 + i % 3) for i, w in enumerate(["tide", "moorings", "", "数据记录"] * 5)]
    block = linemodel.Block(True)
    for line in lines:
        block.add(*line)
    row = block.row()
    names, shapes = row["names"].to_pylist()[0], row["shapes"].to_pylist()[0]
    assert len(names) < 256 and len(shapes) == len(lines) * linemodel.SHAPES  # a byte each
    known = {x: i for i, x in enumerate(sorted(names)[::2])}
    w = [0.01 * (i % 7 - 3) for i in range(len(known))]
    want, rest = [0.0] * len(known), 0.0
    for masked, label, weight in lines:
        own = [(known["\t".join(f)], v) for f, v in linemodel.features(masked, True) if "\t".join(f) in known]
        off = (1 / (1 + 2.718281828459045 ** -(0.3 + sum(w[i] * v for i, v in own))) - label) * weight
        rest += off
        for i, v in own:
            want[i] += v * off
    with open(tmp_path / "lines", "w+b") as file:
        slope = linemodel.Slope(known, file)
        slope.add(row)
        got, over = slope(linemodel.np.array(w), 0.3)
    assert list(got) == pytest.approx(want, abs=1e-5) and over == pytest.approx(rest, abs=1e-5)


def test_words_of_a_window_are_weighed_once(monkeypatch):
    judge, asked, own = residue.Judge(residue.Fitted(residue=linemodel.residue_model([PROSE.lower()], ["page not found #"]))), [], linemodel.LineModel.of_words
    monkeypatch.setattr(linemodel.LineModel, "of_words", lambda self, words: asked.append(words) or own(self, words))
    assert judge.label(PROSE.lower()) == "prose" and len(asked) == 1


def test_residue_fit_takes_few_jobs(spark):
    pages = [(f"{PROSE}\n{PROSE} Twice.\n{PROSE} Thrice.\n{PROSE} {i} times.\nUnder {chr(97 + i)} oak.\nStörung", "a_b") for i in range(12)]
    fitted, jobs = _jobs(spark, "residue", lambda: residue.fit(spark.createDataFrame(pages, "t string, s string"), "t", "s", furniture=False))
    assert 0 < jobs < linemodel.ROUNDS and fitted.residue.words["hearing"] < 0
    index = exemplars.Index(residue.labelled(), bags=residue.bags(), frequent=fitted.frequent, rare=fitted.rare)
    both = residue.words_and_articles(spark.createDataFrame(pages, "t string, s string"), index, fitted.encodings).collect()
    assert {x.line for x in both if x.line} == set(linemodel.article_lines(pages, index, residue.COVERED)) and sum(x.n for x in both if x.w == "oak") == 12


def test_fit_leaves_no_large_checkpoints(spark):
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {x for x in folder.iterdir() if any(x.iterdir())}
    df = spark.createDataFrame([(f"{PROSE}\n{PROSE} Twice.\n{PROSE} Thrice.\n{PROSE} {i} times.\nTerms: {i}\nGrößere Störung {i}", "a_b") for i in range(12)], "t string, s string")
    fitted = residue.fit(df, "t", "s", words=False)
    assert {x for x in folder.iterdir() if any(x.iterdir())} - before <= {x for x in folder.iterdir() if sum(f.stat().st_size for f in x.rglob("part-*")) < 2000}
    assert "grössere" in fitted.fill.known and fitted.residue.words["hearing"] < 0 and ("label", "terms") in fitted.furniture.shapes


def test_fit_leaves_no_shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size
    df = spark.createDataFrame([(f"{PROSE}\n{PROSE} Twice.\n{PROSE} Thrice.\n{PROSE} {i} times.\nTerms: {i}\nGrößere Störung {i}", "a_b") for i in range(12)], "t string, s string")
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = held()
    residue.fit(df, "t", "s")
    for _ in range(20):  # Spark deletes them in the background
        if held() - before <= 3:
            break
        time.sleep(0.5)
    assert held() - before <= 3


def test_residue_models_know_all_texts(spark):
    own = " ".join("Zanholm gardeners moored seventeen barges beside the orchard." for _ in range(400))
    texts = [f"{own}\n{PROSE}\n{PROSE} Twice.\n{PROSE} Thrice.\nUnder {chr(97 + i)} oak." for i in range(20)]
    assert len(own) > encoding.SAMPLE_LONGEST  # no sample holds these
    fitted = residue.fit(spark.createDataFrame([(t, "post") for t in texts], "t string, s string"), "t", "s", furniture=False)
    assert {"gardeners", "barges"} <= fitted.fill.known and fitted.residue.words["gardeners"] < 0


def test_repeated_lines_of_all_texts(spark):
    r = random.Random(8)
    long = " ".join(["quay"] * 5000)  # no sample holds texts of that length
    pages = [("\n".join([long, f"Tide {i}: {r.choice('abc')}", f"Tide {i}: x", "Moor here", *(["Rare"] if i < 2 else []), f"{PROSE} {chr(97 + i)}", *([f"{PROSE} {chr(97 + i)}"] if i % 5 == 0 else [])]), r.choice(["a_b", "c_d", None])) for i in range(24)]
    got = linemodel.repeated_lines(spark.createDataFrame(pages, "t string, s string").repartition(3)).collect()
    assert {(x.line, x.label): x.n for x in got} == Counter(zip(*linemodel.label_by_repetition(pages)))
    assert len(long) > encoding.SAMPLE_LONGEST and any(x.label == 1 for x in got)


def test_furniture(spark, model):
    rows = [("a", PAGE, "ardria_post", "A plan for the harbour"), ("a", PAGE, "ardria_post", "A plan for the harbour"), ("b", PAGE, None, None), ("c", RESIDUE[0], None, None), ("d", None, None, None), ("e", "", None, None)]
    df = spark.createDataFrame(rows, "id string, text string, site string, title string").selectExpr("*", "1 AS line_no", "2 AS _text")
    got = furniture.furniture_lines(df, "id", "text", "site", "title", residue.Fitted(model)).collect()
    assert {x.line_no for x in got if x.id == "a"} == GONE and len([x for x in got if x.id == "a"]) == len(GONE)
    assert {x.line_no for x in got if x.id == "b"} >= GONE - {17} and not [x for x in got if x.id in "cde"]
    text = {x.id: x.text for x in furniture.main_text(df, "id", "text", "site", "title").collect()}
    assert text["a"] == "\n".join(x for i, x in enumerate(PAGE.split("\n"), 1) if i not in GONE) and text["c"] == "" and text["d"] is None
    assert furniture.furniture_lines(df.limit(0), "id", "text", "site", "title").count() == 0


def test_long_garbled_furniture(model):
    line = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in "© 2024 Harborwire. All rights reserved.")
    bad = encoding.garble(line, ("utf-8 twice", "cp1252"))
    classifier = furniture.Classifier(residue.Fitted(model))
    assert len(exemplars.mask(bad, None)) > 240 and encoding.restore(bad, "utf-8 twice>cp1252") == line
    assert classifier.batch([f"{PROSE}\n\n{bad}", f"{PROSE}\n\n{encoding.garble(PROSE.replace('Norton', 'Größe') * 4, ('utf-8', 'cp1252'))}"], ["harborwire", None], [None, None]) == [[3], []]


@pytest.mark.parametrize("pair", [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "gb18030"), ("utf-8", "cp1251"), ("cp1252", "mac_roman")])
def test_short_garbled_span_in_long_clean_line(model, pair):
    clean = f"{CLEAN[2]} " * 40
    bad = f"{clean}{encoding.garble('Störung', pair)} {clean}"
    assert model.verdict(clean, model.label([clean])[0]) is None
    assert model.verdict(bad, model.label([bad])[0]) is not None


RUSSIAN = "город снова передал машины обсерватории"
MIXED = [
    (f"Über Straße: {encoding.garble(RUSSIAN, ('utf-8', 'cp1252'))}", f"Über Straße: {RUSSIAN}"),
    (f"Обсерватория «{encoding.garble('снова передала машины города', ('cp1251', 'koi8-r'))}» — весны", "Обсерватория «снова передала машины города» — весны"),
    (f"{encoding.garble('Größere Störung', ('utf-8', 'cp1252'))} und {encoding.garble('Mühle für zwölf', ('utf-8', 'mac_roman'))}", "Größere Störung und Mühle für zwölf"),
    (f"L’été « Créée » – {encoding.garble('für größere Mühlen', ('utf-8', 'cp1252'))}", "L’été « Créée » – für größere Mühlen"),
    (f"В начале весны {encoding.garble('für größere Mühlen', ('utf-8', 'cp1252'))}", "В начале весны für größere Mühlen"),
]


def test_spans_come_back_and_the_rest_stays(model):
    found = [model.verdict(bad, model.label([bad])[0]) for bad, _ in MIXED]
    assert all(f is not None and f[1] in (None, clean) for f, (_, clean) in zip(found, MIXED))
    assert sum(f[1] is not None for f in found) >= 4  # the capitals of one are rare in the small sample of these tests


def test_random_spans_of_every_pair(model):
    r = random.Random(11)
    told, whole, wrong, asked = 0, 0, 0, 0
    for pair, line in product(encoding.PAIRS, CLEAN):
        words = line.split(" ")
        if len(words) < 6:
            continue
        a = r.randrange(len(words) - 3)
        span = " ".join(words[a : a + 4])
        bad = encoding.garble(span, pair)
        if bad is None or "�" in bad or sum(c > "\x7f" for c in span) < 3 or encoding.restore(bad, ">".join(pair)) != span:
            continue
        mixed = " ".join([*words[:a], bad, *words[a + 4 :]])
        found = model.verdict(mixed, model.label([mixed])[0])
        asked, told = asked + 1, told + (found is not None)
        if found and found[1] is not None:
            whole, wrong = whole + (found[1] == line), wrong + (found[1] != line)
    assert asked >= 50 and told >= 0.9 * asked and whole >= 0.85 * asked and wrong <= 0.05 * asked, (asked, told, whole, wrong)


def test_saved_model(spark, model, tmp_path):
    encoding.save(model, spark, str(tmp_path / "m"))
    assert encoding.load(spark, str(tmp_path / "m")).label(["MÃ¼hle über"]) == model.label(["MÃ¼hle über"])


def test_model_counts_all_lines_of_distinct_texts(spark):
    r = random.Random(4)
    words = [w for x in CLEAN for w in x.split(" ")]
    lines = [f"{' '.join(r.choices(words, k=6))} {i:04}" for i in range(encoding.SAMPLE_PAGES + 500)]
    lines += [y for i, x in enumerate(lines[:300]) if (y := encoding.garble(x, encoding.PAIRS[i % len(encoding.PAIRS)]))] + ["ï¿½ a\\b ~ü", "« – »", "…" * 30_000, "x\u3000\x85y", "Ã¼ �"]
    lines = list(dict.fromkeys(x for x in lines if not x.isascii()))
    df = spark.createDataFrame([(x,) for x in [*lines, *lines[:50], None, "", "plain", "\n".join(lines[:7]) + "\nplain\n"]], "t string").repartition(7)
    got, want = encoding.fit(df, "t"), encoding.Model([*lines, *lines[:7]])
    for table in ("bigrams", "singles", "blocks"):
        a, b = getattr(got, table), getattr(want, table)
        assert a.shape == b.shape and all((x == y).all() for x, y in zip(a, b)), table
    assert encoding.fit(df.limit(0), "t").label(["x", "ü"])[0] == []


def test_counting_takes_one_look_at_words_however_often_they_stand(monkeypatch):
    r = random.Random(6)
    words = [w for x in CLEAN for w in x.split(" ")]
    lines = [f"{' '.join(r.choices(words, k=5))} {i}{r.choice(['', ' ', 'é', '日'])}" for i in range(300)] + ["ï¿½ a ~ü", "\x80\x81ü 日本1", "x\u3000\x85y", "é7", "  ü  "]
    lines = [x for x in dict.fromkeys(lines) if not x.isascii()]
    times = [1 + i % 40 for i in range(len(lines))]
    looks, places = [], encoding._places
    monkeypatch.setattr(encoding, "_places", lambda *a: looks.append(1) or places(*a))
    counter, each = encoding.Counter(), encoding.Counter()
    counter.add(lines, times)
    rows = list(counter.rows())
    assert len(looks) <= 2 * len(encoding.TOGETHER) + 4 * len(encoding.LOSSES)
    each.add([x for x, n in zip(lines, times) for _ in range(n)], [1] * sum(times))
    got, want = encoding.Expander(), encoding.Expander()
    for expander, own in (got, rows), (want, each.rows()):
        for row in own:
            expander.add(*row)
    assert (got.counts == want.counts).all() and got.counts[1:].any(axis=1).all()


def test_sample_is_distinct_and_bounded(spark):
    rows = [("Größere Störung über der Mühle",)] * 500 + [(f"Zeile {i} über Mühlen",) for i in range(40)] + [("ü" * 5000,)]
    df = spark.createDataFrame(rows, "t string")
    assert encoding.sample(df, "t", pages=1000, longest=1000) and len(encoding.sample(df, "t", pages=1000, longest=1000)) == 41
    assert len(encoding.sample(df, "t", pages=10)) == 10
