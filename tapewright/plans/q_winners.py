"""Winner analyses over the premarket trades; the features' minute is ten minutes here."""

from pyspark.sql import functions as F

from tapewright.operators import ticks as K, winners as V
from tapewright.plans.ctes import fragment
from tapewright.plans.q_events import _stage_sql, candidates, event_table
from tapewright.plans.q_events import ANTI, ENTRY, TIMEOUT, WATCH, staged
from tapewright.operators import events as E
from tapewright.plans.registry import query

M = 600_000
TIERS = ((1, 80.0, 600), (2, 60.0, 400), (3, 40.0, 200), (4, 20.0, 0))

fragment(
    "premarket",
    """SELECT *, DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER) AS date FROM clean WHERE et_ms % 86400000 >= 14400000 AND et_ms % 86400000 < 34200000""",
)
fragment(
    "outcome",
    """SELECT *, CASE WHEN max_gain_pct >= 100 THEN 'super' WHEN max_gain_pct >= 50 THEN 'big' WHEN max_gain_pct >= 20 THEN 'medium' WHEN max_gain_pct >= 10 THEN 'small' ELSE 'none' END AS tier,
      coalesce(total_trades / nullif(duration_min, 0), 0) AS trade_rate, CASE WHEN time_to_high_ms > 0 THEN max_gain_pct / (time_to_high_ms / 60000) ELSE 0 END AS price_acceleration FROM (
      SELECT date, ticker, arg_min(price, (ts_ms, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ms, seq)) AS close, CAST(sum(size) AS BIGINT) AS total_volume, count(*) AS total_trades,
        min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_min(ts_ms, (-price, ts_ms)) - min(ts_ms) AS time_to_high_ms, (max(ts_ms) - min(ts_ms)) / 60000 AS duration_min,
        (max(price) - arg_min(price, (ts_ms, seq))) / arg_min(price, (ts_ms, seq)) * 100 AS max_gain_pct FROM premarket GROUP BY 1, 2 HAVING count(*) >= 10)""",
)


def trades(t):
    return V.premarket_trades(K.drop_delayed(t.trades()))


def outcomes(t):
    return V.session_outcomes(trades(t))


OUT_F = "open high low close duration_min max_gain_pct trade_rate price_acceleration"


@query("V1_session_outcomes", "SELECT * FROM outcome", OUT_F)
def _(t):
    return outcomes(t)


@query("V2_gain_tiers", "SELECT tier, count(*) AS n, avg(max_gain_pct) AS mean_gain FROM outcome GROUP BY 1", "mean_gain")
def _(t):
    return outcomes(t).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("max_gain_pct").alias("mean_gain"))


_WIN = "tier IN ('super', 'big', 'medium')"
fragment(
    "covered",
    f"""SELECT o.*, s.ticker IS NOT NULL AS captured, c.gain_at_entry AS gap_pct, CASE WHEN {_WIN} AND s.ticker IS NULL THEN CASE WHEN c.ticker IS NULL THEN 'not_in_candidates'
      WHEN c.gain_at_entry < 11 THEN 'gap_filter' WHEN total_trades < 14 THEN 'low_volume' WHEN time_to_high_ms < 3600000 THEN 'too_fast' ELSE 'timing' END END AS miss_reason
    FROM outcome o LEFT JOIN (SELECT DISTINCT date, ticker FROM stage_entries) s ON s.date = o.date AND s.ticker = o.ticker LEFT JOIN day_candidates c ON c.date = o.date AND c.ticker = o.ticker""",
)


def covered(t):
    sig = E.stage_signals(staged(t), candidates(t), WATCH, ENTRY, ANTI, TIMEOUT, ("date", "ticker"))
    return V.coverage(outcomes(t), sig, candidates(t), 11.0, 14, 3_600_000)


@query("V3_coverage", "SELECT date, ticker, tier, captured, miss_reason FROM covered")
def _(t):
    return covered(t).select("date", "ticker", "tier", "captured", "miss_reason")


@query(
    "V3_coverage_summary",
    f"""SELECT date, count(*) AS n_tickers, count(*) FILTER ({_WIN}) AS n_winners, count(*) FILTER ({_WIN} AND captured) AS n_captured, """
    + ", ".join(f"count(*) FILTER (miss_reason = '{r}') AS n_{r}" for r in ("not_in_candidates", "gap_filter", "low_volume", "too_fast", "timing"))
    + f", coalesce(count(*) FILTER ({_WIN} AND captured) / nullif(count(*) FILTER ({_WIN}), 0), 0) AS coverage FROM covered GROUP BY 1",
    "coverage",
)
def _(t):
    return V.coverage_summary(covered(t))


OFFS = (3_600_000, 7_200_000, 14_400_000)


@query(
    "V4_factors_after_entry",
    f"""SELECT m.date, m.ticker, offset_ms, min(e.ts_ms) AS factor_ms, arg_min_null(trade_rate, e.ts_ms) AS trade_rate, arg_min_null(relative_volume, e.ts_ms) AS relative_volume FROM (
      SELECT c.date, c.ticker, first_entry_ms, CAST(unnest({list(OFFS)}) AS BIGINT) AS offset_ms FROM covered v JOIN day_candidates c USING (date, ticker) WHERE miss_reason IS NOT NULL) m
    LEFT JOIN event_table e ON e.ticker = m.ticker AND e.ts_ms >= first_entry_ms + offset_ms GROUP BY 1, 2, 3""",
    "trade_rate relative_volume",
)
def _(t):
    missed = covered(t).filter("miss_reason IS NOT NULL").join(candidates(t), ["date", "ticker"]).select("date", "ticker", F.col("first_entry_ms").alias("entry_ms"))
    out = V.factors_after_entry(missed, event_table(t), ["trade_rate", "relative_volume"], OFFS)
    return out.select("date", "ticker", "offset_ms", "factor_ms", "trade_rate", "relative_volume")


VC = ["max_gain_pct", "total_volume", "trade_rate"]


@query(
    "V5_top_decile_ratios",
    "SELECT date, " + ", ".join(f"avg({c}) FILTER (r <= k) AS top_{c}, avg({c}) FILTER (r > k) AS rest_{c}, avg({c}) FILTER (r <= k) / nullif(avg({c}) FILTER (r > k), 0) AS ratio_{c}" for c in VC)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY max_gain_pct DESC, ticker) AS r, greatest(3, floor(count(*) OVER (PARTITION BY date) * CAST(0.1 AS DOUBLE))) AS k FROM outcome) GROUP BY 1",
    " ".join(f"{p}_{c}" for c in VC for p in ("top", "rest", "ratio")),
)
def _(t):
    return V.top_decile_ratios(outcomes(t), VC)


WINS, GAINS = (5, 10, 15, 30, 60), (10, 25, 50)
fragment(
    "early",
    "SELECT p.date, p.ticker, " + ", ".join(
        f"max(gain) FILTER (el <= {w * M}) AS gain_{w}min, CAST(sum(size) FILTER (el <= {w * M}) AS BIGINT) AS volume_{w}min, count(*) FILTER (el <= {w * M}) AS trades_{w}min" for w in WINS
    ) + f", coalesce(stddev_pop(ret) FILTER (el <= {5 * M}), 0) * 100 AS volatility_5min, " + ", ".join(f"coalesce(min(el) FILTER (gain >= {g}) / 60000, 0) AS time_to_{g}pct" for g in GAINS)
    + """ FROM (SELECT p.*, p.ts_ms - o.first_ms AS el, (p.price - o.open) / o.open * 100 AS gain, p.price / lag(p.price) OVER (PARTITION BY p.date, p.ticker ORDER BY p.ts_ms, p.seq) - 1 AS ret
      FROM premarket p JOIN outcome o ON o.date = p.date AND o.ticker = p.ticker) p GROUP BY 1, 2""",
)
fragment(
    "features",
    """SELECT *, CASE WHEN gain_5min > 0 THEN gain_5min / 5 ELSE 0 END AS acceleration_5min, trades_5min / 5 AS trade_rate_5min, CASE WHEN gain_10min > 0 THEN gain_10min / 10 ELSE 0 END AS acceleration_10min,
    trades_10min / 10 AS trade_rate_10min, volume_5min / trades_5min AS avg_size_5min FROM early""",
)
FEAT_F = " ".join([f"gain_{w}min" for w in WINS] + ["volatility_5min"] + [f"time_to_{g}pct" for g in GAINS] + ["acceleration_5min", "trade_rate_5min", "acceleration_10min", "trade_rate_10min", "avg_size_5min"])


def features(t):
    return V.early_features(trades(t), outcomes(t), WINS, GAINS, M)


@query("V6_early_features", "SELECT * FROM features", FEAT_F)
def _(t):
    return features(t)


fragment(
    "relative",
    """SELECT f.date, f.ticker, CASE WHEN mv > 0 THEN volume_5min / mv ELSE 0 END AS rel_volume_5min, CASE WHEN mg > 0 THEN gain_5min / mg ELSE 0 END AS rel_gain_5min FROM features f
    JOIN (SELECT date, median(volume_5min) AS mv, median(gain_5min) AS mg FROM features GROUP BY 1) m USING (date)""",
)


@query("V7_median_normalised", "SELECT * FROM relative", "rel_volume_5min rel_gain_5min")
def _(t):
    return V.relative_to_median(features(t), ["volume_5min", "gain_5min"]).select("date", "ticker", "rel_volume_5min", "rel_gain_5min")


fragment("feature_tiers", "SELECT f.*, o.tier, o.max_gain_pct, o.total_volume FROM features f JOIN outcome o ON o.date = f.date AND o.ticker = f.ticker")
FC = ["gain_5min", "volume_5min", "trade_rate_5min"]


def feature_tiers(t):
    return features(t).join(outcomes(t).select("date", "ticker", "tier", "max_gain_pct", "total_volume"), ["date", "ticker"])


@query("V8_tier_statistics", "SELECT tier, count(*) AS n, " + ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in FC) + " FROM feature_tiers GROUP BY 1", " ".join(f"{p}_{c}" for c in FC for p in ("mean", "std")))
def _(t):
    return V.tier_statistics(feature_tiers(t), FC)


@query("V8_tier_ratios", " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER ({_WIN}) AS top_mean, avg({c}) FILTER (tier = 'small') AS rest_mean, avg({c}) FILTER ({_WIN}) / nullif(avg({c}) FILTER (tier = 'small'), 0) AS ratio FROM feature_tiers" for c in FC), "top_mean rest_mean ratio")
def _(t):
    return V.tier_ratios(feature_tiers(t), FC, ("super", "big", "medium"), ("small",))


_VT = "CASE " + " ".join(
    f"WHEN max_gain_pct >= {lo} {'AND max_gain_pct < ' + str(TIERS[i - 1][1]) if i else ''} AND total_volume >= {vol} THEN {n}" for i, (n, lo, vol) in enumerate(TIERS)
) + " ELSE 5 END"


@query("V9_volume_tiers", f"SELECT date, ticker, CAST({_VT} AS INTEGER) AS volume_tier FROM outcome")
def _(t):
    return outcomes(t).select("date", "ticker", V.volume_tier(tiers=TIERS).alias("volume_tier"))


fragment(
    "traj",
    f"""SELECT o.date, o.ticker, o.tier, CAST(i * 5 AS INTEGER) AS minute, arg_max(p.price, (p.ts_ms, p.seq)) AS price, CAST(coalesce(sum(p.size), 0) AS BIGINT) AS cumulative_volume, (max(p.price) - o.open) / o.open * 100 AS gain_pct
    FROM outcome o JOIN (SELECT unnest(range(70)) AS i) g ON TRUE LEFT JOIN premarket p ON p.date = o.date AND p.ticker = o.ticker AND p.ts_ms <= o.first_ms + i * {5 * M // 10} GROUP BY o.date, o.ticker, o.tier, i, o.open""",
)


def traj(t):
    return V.trajectories(trades(t), outcomes(t), 5, 70, M // 10)


@query("V10_trajectories", "SELECT * FROM traj", "price gain_pct")
def _(t):
    return traj(t)


@query(
    "V10_volume_peaks",
    """SELECT date, ticker, arg_min(minute, (-d, minute)) AS volume_peak_minute FROM (SELECT *, cumulative_volume - lag(cumulative_volume) OVER (PARTITION BY date, ticker ORDER BY minute) AS d FROM traj) WHERE d > 0 GROUP BY 1, 2""",
)
def _(t):
    return V.volume_peaks(traj(t))


@query("V11_tier_trajectories", "SELECT tier, minute, count(*) AS n, avg(gain_pct) AS mean_gain, avg(cumulative_volume) AS mean_volume FROM traj GROUP BY 1, 2", "mean_gain mean_volume")
def _(t):
    return V.tier_trajectories(traj(t))


@query(
    "V12_early_signal_class",
    """SELECT f.date, f.ticker, early AS is_early_signal, CASE WHEN early AND big THEN 'early_explosive' WHEN big THEN 'slow_burner' WHEN early THEN 'false_positive' ELSE 'other' END AS signal_type FROM (
      SELECT f.date, f.ticker, (volume_5min > 150 OR rel_volume_5min > 2) AND trade_rate_5min > 0.5 AND gain_5min > 5 AS early, max_gain_pct >= 25 AS big FROM feature_tiers f JOIN relative r ON r.date = f.date AND r.ticker = f.ticker) f""",
)
def _(t):
    f = V.relative_to_median(features(t), ["volume_5min"]).join(outcomes(t).select("date", "ticker", "max_gain_pct"), ["date", "ticker"])
    return V.classify_early(f, 150, 2, 0.5, 5, 25.0).select("date", "ticker", "is_early_signal", "signal_type")
