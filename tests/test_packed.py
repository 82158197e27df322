import pytest
from pyspark.sql import functions as F

from leafwright.operators.packed import may_be_packed, split_packed

CASES = [
    ("Jona Tev and Tamric Lind", ["Jona Tev", "Tamric Lind"]),
    ("By Jona Tev, Ana Roe and Tamric Lind", ["Jona Tev", "Ana Roe", "Tamric Lind"]),
    ("Grismure, Osva", ["Grismure, Osva"]),
    ("Tev, Ana; Lind, Tom", ["Tev, Ana", "Lind, Tom"]),
    ("Ana Tev, PhD, Tom Lind, Jr.", ["Ana Tev, PhD", "Tom Lind, Jr."]),
    ("Gris & Holt Press Bureau", ["Gris & Holt Press Bureau"]),
    ("Ostwick, Nornia and Hesheim Growers Association", ["Ostwick, Nornia and Hesheim Growers Association"]),
    ('"Nerstin ""Ner"" Bortov","Mibel Wend"', ['Nerstin "Ner" Bortov', "Mibel Wend"]),
    ('["Ana Tev", "Tom Lind"]', ["Ana Tev", "Tom Lind"]),
    ('["\\u8c0c\\u65fb", "\\u8340\\u6829"]', ["谌旻", "荀栩"]),
    ("Ana Tev;  ;  Tom Lind; ", ["Ana Tev", "Tom Lind"]),
    ("Ana Tev (text/video), Tom Lind", ["Ana Tev (text/video)", "Tom Lind"]),
    ("薇尔·科尔曼", ["薇尔·科尔曼"]),
    ("Ana Tev · Tom Lind", ["Ana Tev", "Tom Lind"]),
    ("记者 鄢砚禾、邝澍舟", ["鄢砚禾", "邝澍舟"]),
    ("文｜郗翊禾、鄢砚岑（文/图）", ["郗翊禾", "鄢砚岑（文/图）"]),
    ("郗澍汀　荀栩汀", ["郗澍汀", "荀栩汀"]),
    ("滢垣档案馆", ["滢垣档案馆"]),
    ("Ana Tev\nTom Lind\tEva Roe", ["Ana Tev", "Tom Lind", "Eva Roe"]),
    (" ; , ", []),
    ("", []),
]


def test_each_form(spark):
    df = spark.createDataFrame([(str(i), [s]) for i, (s, _) in enumerate(CASES)], "id string, names array<string>")
    got = {}
    for r in split_packed(df, ["id"], "names").collect():
        got.setdefault(r.id, {})[r.item_no] = r["item"]
    for i, (s, want) in enumerate(CASES):
        assert [x for _, x in sorted(got.get(str(i), {}).items())] == want, s


def test_positions_run_over_all_strings_and_rows_count_once(spark):
    rows = [("a", ["Ana Tev", None, "Tom Lind & Eva Roe"])] * 2 + [("b", None), ("c", []), (None, ["A B; C D"])]
    df = spark.createDataFrame(rows, "id string, names array<string>").selectExpr("*", "1 AS item", "2 AS _v")
    got = sorted(map(tuple, split_packed(df, ["id"], "names").collect()), key=str)
    assert got == sorted([("a", 1, "Ana Tev", True), ("a", 2, "Tom Lind", True), ("a", 3, "Eva Roe", True), (None, 1, "A B", True), (None, 2, "C D", True)], key=str)


def test_empty_table_and_long_text(spark):
    schema = "id string, names array<string>"
    assert split_packed(spark.createDataFrame([], schema), ["id"], "names").count() == 0
    long = "; ".join(f"Ana Tev{i}" for i in range(3000))
    assert split_packed(spark.createDataFrame([("a", [long])], schema), ["id"], "names").count() == 3000


@pytest.mark.parametrize("text", [c[0] for c in CASES if len(c[1]) > 1])
def test_prefilter_keeps_every_packed_string(spark, text):
    assert spark.createDataFrame([(text,)], "s string").select(may_be_packed(F.col("s"))).first()[0]
