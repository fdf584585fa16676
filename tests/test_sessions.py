"""Session edges, both daylight-saving changes, bar slots, gap fill and the calendar."""

from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.functions.calendar import is_early_close, is_trading_day
from tapewright.operators import bars as A

NY = ZoneInfo("America/New_York")


def ms(*a):
    return int(datetime(*a, tzinfo=NY).timestamp() * 1000)


EDGES = [
    ((2024, 1, 9, 3, 59), "closed"), ((2024, 1, 9, 4, 0), "premarket"), ((2024, 1, 9, 9, 29), "premarket"), ((2024, 1, 9, 9, 30), "regular"),
    ((2024, 1, 9, 15, 59), "regular"), ((2024, 1, 9, 16, 0), "afterhours"), ((2024, 1, 9, 20, 0), "closed"),
    ((2024, 3, 11, 4, 0), "premarket"), ((2024, 11, 4, 3, 59), "closed"),
]


def test_session_edges(spark):
    d = spark.createDataFrame([(ms(*e), want) for e, want in EDGES], "t long, want string")
    bad = d.withColumn("got", S.classify_session(S.to_et_ms("t"))).filter("got <> want").collect()
    assert bad == []


def test_zone_round_trip(spark):
    d = spark.createDataFrame([(ms(2024, m, 10, 12, 0),) for m in range(1, 13)], "t long")
    assert d.filter(S.et_to_utc_ms(S.to_et_ms("t")) != F.col("t")).count() == 0


@pytest.mark.parametrize("hm,tf,start,end", [((9, 15), "1h", (9, 0), (9, 30)), ((9, 45), "1h", (9, 30), (10, 30)), ((15, 45), "4h", (13, 30), (16, 0)), ((4, 0), "30m", (4, 0), (4, 30)), ((19, 59), "4h", (16, 0), (20, 0))])
def test_bar_slots(spark, hm, tf, start, end):
    day = 19_731 * S.DAY_MS
    at = lambda h, m: day + (h * 60 + m) * 60_000
    row = spark.createDataFrame([(at(*hm),)], "t long").select(S.bar_start("t", tf).alias("s")).select("s", S.bar_end("s", tf).alias("e")).first()
    assert (row["s"], row["e"]) == (at(*start), at(*end))


def test_gap_fill_stays_in_session_and_ticker(spark):
    t = [("A", ms(2024, 1, 9, 19, 30), 1, 10.0, 5), ("A", ms(2024, 1, 10, 4, 45), 2, 11.0, 5), ("B", ms(2024, 1, 9, 10, 0), 3, 7.0, 1), ("B", ms(2024, 1, 9, 10, 35), 4, 8.0, 1)]
    trades = spark.createDataFrame(t, "ticker string, ts_ms long, seq long, price double, size long")
    out = A.fill_session_gaps(A.trades_to_bars(trades, "15m"), "15m").filter("filled").collect()
    a = sorted(r["bar_start"] for r in out if r["ticker"] == "A")
    # 19:45, then 04:00, 04:15 and 04:30 of the next day; the night has no bars.
    assert [x % S.DAY_MS // 60_000 for x in a] == [240, 255, 270, 1185] or [x % S.DAY_MS // 60_000 for x in a] == [1185, 240, 255, 270]
    assert {r["close"] for r in out if r["ticker"] == "A"} == {10.0}
    assert [r["close"] for r in out if r["ticker"] == "B"] == [7.0]


def test_volume_is_preserved(spark):
    rows = [("A", ms(2024, 1, 9, 9, 0) + i * 61_000, i, 10.0 + i % 7, 1 + i % 5) for i in range(300)]
    trades = spark.createDataFrame(rows, "ticker string, ts_ms long, seq long, price double, size long")
    for tf in S.TIMEFRAME_MS:
        assert A.trades_to_bars(trades, tf).agg(F.sum("volume")).first()[0] == sum(r[4] for r in rows)


HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25", "2021-12-24", "2023-01-02", "2025-01-09", "2026-04-03"]
OPEN = ["2024-01-02", "2021-12-31", "2024-03-28", "2024-07-05", "2021-06-18"]
EARLY = ["2024-07-03", "2024-11-29", "2024-12-24", "2023-11-24"]


def test_calendar(spark):
    d = spark.createDataFrame([(date.fromisoformat(x),) for x in HOLIDAYS + OPEN + EARLY], "d date")
    got = {r["d"].isoformat(): (r["t"], r["e"]) for r in d.select("d", is_trading_day(F.col("d")).alias("t"), is_early_close(F.col("d")).alias("e")).collect()}
    assert all(got[x] == (False, False) for x in HOLIDAYS)
    assert all(got[x] == (True, False) for x in OPEN)
    assert all(got[x] == (True, True) for x in EARLY)
