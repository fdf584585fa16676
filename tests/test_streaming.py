"""Streams give what the batch operators give; late rows are dropped; state survives a restart."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapewright.functions.rules import rule
from tapewright.streaming import bars as B, factors as FX, signals as GX
from tapewright.streaming.run import append_files, drain_files, stream_parquet
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("W") and n in ORACLE])
def test_stream_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""


def test_dedup_stream_keeps_one_per_key(spark):
    rows = QUERIES["W11_news_dedup_stream"](spark, SF).collect()
    assert rows and len({r["url_id"] for r in rows}) == len(rows) == len({r["title_fp"] for r in rows})


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_restart_resumes_state(spark, tmp_path):
    """Two runs over a growing folder equal one run over the whole."""
    schema = "ticker string, bar_start long, open double, high double, low double, close double, volume long"
    rows = [("A", i, 10.0 + i % 3, 15.0, 9.0, 10.5 + i % 4, 100 + i) for i in range(60)]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    feed(spark, one, rows, schema)
    like = spark.createDataFrame([], schema)
    append_files(FX.bar_close_factors(stream_parquet(spark, f"{one}/in", like)), one)
    for part in (rows[:37], rows[30:]):
        feed(spark, two, part, schema)
        append_files(FX.bar_close_factors(stream_parquet(spark, f"{two}/in", like)), two)
    key = lambda p: sorted((r["bar_start"], r["relative_volume"], r["gap_percent"], r["ema"]) for r in spark.read.parquet(f"{p}/data").collect() if r["ema"] is not None)
    assert key(one) == key(two) and len(key(one)) == 41


def test_cooldown_across_batches(spark, tmp_path):
    path, schema = str(tmp_path), "ticker string, ts_ms long, trade_rate double"
    like = spark.createDataFrame([], schema)
    rules = (rule("busy", ("trade_rate", "gt", 1.0)),)
    for part in ([("A", 0, 2.0), ("A", 30_000, 2.0), ("A", 61_000, 2.0)], [("A", 100_000, 2.0), ("A", 121_000, 0.5), ("A", 130_000, 2.0)]):
        feed(spark, path, part, schema)
        append_files(GX.signals_with_cooldown(stream_parquet(spark, f"{path}/in", like), rules), path)
    assert sorted(r["ts_ms"] for r in spark.read.parquet(f"{path}/data").collect()) == [0, 61_000, 130_000]


def test_keyed_bars_drop_late_trades(spark, tmp_path):
    path = str(tmp_path)
    t0 = 1_704_812_400_000  # 2024-01-09 10:00 US/Eastern
    schema = "ticker string, ts_ms long, seq long, price double, size long"
    like = spark.createDataFrame([], schema)
    for part in ([("A", t0 + 1_000, 1, 10.0, 5), ("A", t0 + 61_000, 2, 11.0, 5)], [("A", t0 + 30_000, 3, 99.0, 5), ("A", t0 + 121_000, 4, 12.0, 5)]):
        feed(spark, path, part, schema)
        drain_files(B.keyed_bars(stream_parquet(spark, f"{path}/in", like), "1m", idle_ms=3_600_000), path)
    got = sorted((r["close"], r["volume"]) for r in spark.read.parquet(f"{path}/data").collect())
    assert got == [(10.0, 5), (11.0, 5)]
    assert [(r["close"], r["volume"]) for r in B.open_bars(spark, path).collect()] == [(12.0, 5)]


def test_snapshot_state_does_not_grow(spark, tmp_path):
    """Batches of one date: the state stays a row a ticker, first entries are recorded once, a new date starts anew."""
    from tapewright.streaming import snapshots as SX

    path = str(tmp_path)
    schema = "date date, ticker string, window_ms long, price double, change_pct double"
    day = [datetime.date(2024, 1, 9), datetime.date(2024, 1, 10)]
    like = spark.createDataFrame([], schema)
    best, sizes = {}, []
    for b in range(13):
        d = day[b // 12]
        rows = [(d, f"T{i}", b * 5_000, 10.0, float((i * 7 + b * 3) % 11)) for i in range(8) if b % 12 == 0 or (i + b) % 3]
        for r in rows:
            best.setdefault((d, b), {})[r[1]] = r[4]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        SX.process_stream(spark, stream_parquet(spark, f"{path}/in", like), path, 2)
        sizes.append((spark.read.parquet(f"{path}/state/{b % 2}").count(), len(os.listdir(f"{path}/state"))))
    assert {n for n, _ in sizes} == {8} and sizes[-1][1] == 2
    want, held = {}, {}
    for (d, b), values in sorted(best.items()):
        now = held.setdefault(d, {})
        now.update(values)
        for t in sorted(now, key=lambda t: (-now[t], t))[:2]:
            want.setdefault((d, t), b * 5_000)
    got = spark.read.parquet(f"{path}/entries").collect()
    assert {(r["date"], r["ticker"]): r["first_entry_ms"] for r in got} == want and len(got) == len(want)


def test_carry_forward_deals_rows_out_once(spark):
    """Repeated rows are not shuffled to find their windows, whatever the sizes say; the wanted windows are those of a semi join."""
    from tapewright.operators.snapshots import carry_forward

    day = [datetime.date(2024, 1, 9), datetime.date(2024, 1, 10), None]
    rows = [(day[i % 3], None if i % 11 == 5 else f"T{i % 4}", None if i % 13 == 7 else (i * 7 % 10) * 5_000, float(i)) for i in range(60)]
    rows = [*{r[:3]: r for r in rows}.values()]
    snap = spark.createDataFrame(rows, "date date, ticker string, window_ms long, change_pct double")
    wanted = snap.filter(F.col("window_ms") % 15_000 == 0).select("date", "window_ms")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        filled = carry_forward(snap)
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate explode")]
    finally:
        spark.conf.set(key, before)
    want, times = [], {}
    for d, _, w, _ in rows:
        if d and w is not None:
            times.setdefault(d, set()).add(w)
    for d, t, w, c in rows:
        if d and w is not None:
            end = min((x[2] for x in rows if x[:2] == (d, t) and x[2] is not None and x[2] > w), default=1 << 60)
            want += [(d, str(t), at, c, at != w, w) for at in times[d] if w <= at < end]
    got = lambda df: sorted((r["date"], str(r["ticker"]), r["window_ms"], r["change_pct"], r["carried"], r["seen_ms"]) for r in df.collect())
    assert got(filled) == sorted(want) and filled.columns == ["date", "window_ms", "ticker", "change_pct", "carried", "seen_ms"]
    assert got(carry_forward(snap, wanted)) == sorted(w for w in want if w[2] % 15_000 == 0)


def test_snapshot_stages_are_cut_from_written_rows(spark, monkeypatch):
    """The stages of the live snapshots read one written snapshot; none of them computes it."""
    from tapewright.plans import q_streaming as Q
    from tapewright.sources.canonical import Tables

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plans, counts = [], []

    def stages(_spark, parts, _path, _run):
        plans.extend(p._jdf.queryExecution().optimizedPlan().toString() for p in parts)
        counts.extend(p.count() for p in parts)

    monkeypatch.setattr(Q, "in_stages", stages)
    t = Tables(spark, SF)
    Q.live_snapshots(t)
    assert len(plans) == 3 and not any("Window" in p or "Aggregate" in p for p in plans)
    assert sum(counts) == Q.snap(t).count()


def test_snapshot_batch_is_ranked_once(spark, tmp_path, monkeypatch):
    """A batch's first entries come from the ranks that it wrote; prior rows are carried to the arrived windows only."""
    from tapewright.operators import snapshots as N
    from tapewright.streaming import snapshots as SX

    path, day, calls = str(tmp_path), datetime.date(2024, 1, 9), []
    schema = "date date, ticker string, window_ms long, change_pct double"
    like = spark.createDataFrame([], schema)
    rank = N.rank_cross_section
    for module in (N, SX):
        monkeypatch.setattr(module, "rank_cross_section", lambda *a: calls.append(a) or rank(*a))
    for rows in ([("A", 0, 3.0), ("B", 0, 1.0), ("B", 5_000, 4.0)], [("C", 10_000, 9.0), ("B", 15_000, 2.0)]):
        spark.createDataFrame([(day, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        SX.process_stream(spark, stream_parquet(spark, f"{path}/in", like), path, 1)
    ranked = sorted((r["window_ms"], r["rank"], r["ticker"], r["seen_ms"]) for r in spark.read.parquet(f"{path}/ranked").collect())
    assert ranked == [
        (0, 1, "A", 0), (0, 2, "B", 0), (5_000, 1, "B", 5_000), (5_000, 2, "A", 0), (10_000, 1, "C", 10_000), (10_000, 2, "B", 5_000), (10_000, 3, "A", 0),
        (15_000, 1, "C", 10_000), (15_000, 2, "A", 0), (15_000, 3, "B", 15_000),
    ]
    assert sorted((r["ticker"], r["first_entry_ms"]) for r in spark.read.parquet(f"{path}/entries").collect()) == [("A", 0), ("B", 5_000), ("C", 10_000)]
    assert len(calls) == 2


def test_live_snapshots_parse_events_once(spark, tmp_path, monkeypatch):
    """Daily rows, trade windows and quote windows come from one written parse of the events, and the snapshot is that of a batch."""
    from tapewright.plans import q_streaming as Q
    from tapewright.sources.canonical import Tables

    at = lambda i: datetime.datetime(2024, 1, 9 + i % 3, 12 + i % 7, i % 60)
    rows = [(i, at(i), None if i % 17 == 5 else i % 4, "view", float(i * 7 % 90), '{"k": %d}' % (i % 9)) for i in range(300)] + [(7, at(7), 3, "view", 49.0, '{"k": 7}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    reads, parts, read = [], [], Tables.read
    monkeypatch.setattr(Tables, "read", lambda self, name: reads.append(name) or read(self, name))
    monkeypatch.setattr(Q, "in_stages", lambda _spark, p, _path, _run: parts.extend(p))
    t = Tables(spark, str(tmp_path))
    Q.live_snapshots(t)
    assert reads == ["events"]
    flat = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    got = [r for p in parts for r in flat(p)]
    assert sorted(got) == flat(Q.snap(t)) and any("-0" in r or "None" in r for r in got)


def test_collector_sums_before_unique_quotes(spark):
    """One quote row a window: the running sums need no shuffle after the join. Repeated quote rows count as before otherwise."""
    from tapewright.operators.snapshots import collector

    d = [datetime.date(2024, 1, 9), None]
    trades = [(d[i % 2 * (i % 5 == 1)], None if i % 7 == 3 else f"T{i % 3}", i * 1_000, 10.0 + i, i, 2.0 * i, 9.0, None if i % 4 else 5, 1.0) for i in range(30)]
    tr = spark.createDataFrame(trades, "date date, ticker string, window_ms long, price double, volume long, turnover double, prev_close double, prev_volume long, change_pct double")
    quotes = [(None if i % 7 == 3 else f"T{i % 3}", i * 1_000, 1.0, None if i % 5 else 2.0, 3, 4) for i in range(0, 30, 2)]
    qu = spark.createDataFrame(quotes, "ticker string, window_ms long, bid double, ask double, bid_size long, ask_size long")
    rows = lambda df: sorted(map(str, df.collect()))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        laid = tr.repartition(4, "date", "ticker")
        shuffles = [collector(laid, qu, u)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(date") for u in (False, True)]
        assert shuffles == [2, 1]
    finally:
        spark.conf.set(key, before)
    assert rows(collector(tr, qu, True)) == rows(collector(tr, qu)) and collector(tr, qu, True).columns == collector(tr, qu).columns
    assert rows(collector(tr, None, True)) == rows(collector(tr))
    one, two = tr.filter("ticker = 'T0' AND window_ms = 0 AND date IS NOT NULL"), qu.filter("ticker = 'T0' AND window_ms = 0")
    assert collector(one, two.union(two)).count() == 2


def test_carry_forward_cuts_slices(spark):
    """The windows of a row are one slice of its date's, not a function call a window; repeated rows of a window keep their windows."""
    from tapewright.operators.snapshots import carry_forward

    day = datetime.date(2024, 1, 9)
    rows = [(day, "A", 0, 1.0), (day, "A", 5_000, 2.0), (day, "A", 5_000, 2.0), (day, "B", 10_000, 3.0), (day, "C", 0, 4.0), (day, "C", 0, 4.0)]
    snap = spark.createDataFrame(rows, "date date, ticker string, window_ms long, change_pct double")
    filled = carry_forward(snap)
    assert "explode(slice(" in filled._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["ticker"], r["window_ms"], r["seen_ms"]) for r in filled.collect())
    want = [("A", 0, 0), ("A", 0, 5_000), ("A", 5_000, 5_000), ("A", 5_000, 5_000), ("A", 10_000, 5_000), ("B", 10_000, 10_000)]
    assert got == sorted(want + [("C", 0, 0), ("C", 0, 0), ("C", 5_000, 0), ("C", 10_000, 0)])
