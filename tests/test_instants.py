from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from leafwright.operators.instants import to_utc

SCHEMA = "n int, value string, off string, zone string, site string, ord string"
NY, BERLIN, SHANGHAI, SYDNEY = "America/New_York", "Europe/Berlin", "Asia/Shanghai", "Australia/Sydney"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return [(r.status, r.utc_value) for r in to_utc(df, "value", "off", "zone", "site", "ord").orderBy("n").collect()]


def test_forms(spark):
    cases = [
        (("2024-05-23 14:58:14", None, SHANGHAI, "s", "ymd"), "2024-05-23 06:58:14"),
        (("2020-02-21T08:04:48.9+00:00", "+05:00", SHANGHAI, "s", "ymd"), "2020-02-21 08:04:48"),
        (("1583597069", None, None, None, None), "2020-03-07 16:04:29"),
        (("1633153082796", None, None, None, None), "2021-10-02 05:38:02"),
        (("2021-10-06-11:07", "UTC+1", None, "s", None), "2021-10-06 10:07:00"),
        (("2023-08-23 08:42:XX", "+0530", None, "s", None), "2023-08-23 03:12:00"),
        (("2024年08月21日09：33：05", None, SHANGHAI, "s", "ymd"), "2024-08-21 01:33:05"),
        (("2020年6月24日 下午12:20", "+8", None, "s", None), "2020-06-24 04:20:00"),
        (("15th November 2019 | 15:35:37", None, NY, "s", "mdy"), "2019-11-15 20:35:37"),
        (("Updated: February 9, 2020 at 12:42 AM", None, NY, "s", "mdy"), "2020-02-09 05:42:00"),
        (("29. Mai 2020 um 6.10 Uhr", None, BERLIN, "b", "dmy"), "2020-05-29 04:10:00"),
        (("le 3 août 2021, 00:50", None, "Europe/Paris", "p", "dmy"), "2021-08-02 22:50:00"),
        (("18 enero 2021 - 17.19 h", None, "Europe/Madrid", "m", "dmy"), "2021-01-18 16:19:00"),
        (("16 de março de 2019 às 12h54", None, "Europe/Lisbon", "l", "dmy"), "2019-03-16 12:54:00"),
        (("25 марта 2023 г. в 23:34", None, "Europe/Sofia", "r", "dmy"), "2023-03-25 21:34:00"),
        (("Sun, 29 May 2022 03:22:42 +0200", None, None, None, None), "2022-05-29 01:22:42"),
        (("2022-10-30 00:41:32 (CEST)", None, NY, "s", "mdy"), "2022-10-29 22:41:32"),
        (("May 1, 2024 7:32 AM EDT", None, None, None, None), "2024-05-01 11:32:00"),
        (("04/03/2021 11:05 PM", None, NY, "s", "mdy"), "2021-04-04 03:05:00"),
        (("04/03/2021 23:05", None, BERLIN, "b", "dmy"), "2021-03-04 22:05:00"),
    ]
    assert run(spark, [c for c, _ in cases]) == [("ok", want) for _, want in cases]


def test_states(spark):
    cases = [
        ((None, None, NY, "s", "mdy"), "empty"), (("  ", None, NY, "s", "mdy"), "empty"), (("yesterday", None, NY, "s", "mdy"), "unread"), (("2021-02-30 10:00", None, NY, "s", "mdy"), "unread"),
        (("2021-06-17", None, NY, "s", "mdy"), "coarse"), (("2021-06-17 10:XX:XX", None, NY, "s", "mdy"), "coarse"), (("2021-06-17 10:00", None, None, None, None), "no_zone"),
        (("2021-03-14 02:30", None, NY, "s", "mdy"), "skipped"), (("2021-11-07 01:30", None, NY, "s", "mdy"), "twice"), (("2021-11-07 01:30", "-05:00", NY, "s", "mdy"), "ok"), (("03/04/2021 10:00", "+00:00", None, None, None), "order"),
    ]
    assert [s for s, _ in run(spark, [c for c, _ in cases])] == [want for _, want in cases]


def test_mixture_learns_a_sources_order(spark):
    rows = [(f"{d}/{m}/2021 10:00", "+00:00", None, "unknown", None) for d in range(13, 29) for m in range(1, 13)] + [("03/04/2021 10:00", "+00:00", None, "unknown", None)]
    assert run(spark, rows)[-1] == ("ok", "2021-04-03 10:00:00")


def test_against_zoneinfo(spark):
    start, cases = datetime(2021, 1, 1), []
    for zone in (NY, BERLIN, SYDNEY, "Asia/Kathmandu", "Australia/Lord_Howe"):
        for i in range(0, 365 * 24 * 60, 997):
            cases.append((start + timedelta(minutes=i), zone))
    got = run(spark, [(t.strftime("%Y-%m-%d %H:%M:%S"), None, z, "s", "ymd") for t, z in cases])
    for (t, z), (status, value) in zip(cases, got):
        a, b = (t.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(timezone.utc) for f in (0, 1))
        if a == b:
            assert (status, value) == ("ok", a.strftime("%Y-%m-%d %H:%M:%S")), (t, z)
        else:
            assert status == ("skipped" if a.astimezone(ZoneInfo(z)).replace(tzinfo=None) != t else "twice"), (t, z)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", status string, p string")
    out = to_utc(df, "value", "off", "zone", "site", "ord")
    assert out.count() == 0 and out.columns.count("status") == 1
