"""Shared SQL fragments for the counterpart queries; a fragment is added when its name is used."""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    if FRAGMENTS.get(name, sql.strip()) != sql.strip():
        raise ValueError(f"two fragments named {name}")
    FRAGMENTS[name] = sql.strip()


def with_ctes(body: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in FRAGMENTS:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(FRAGMENTS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n]})" for n in order)
    return f"WITH {head}\n{body}"


def _trades(ticker: str) -> str:
    return f"""
SELECT {ticker} AS ticker, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, CAST(20 AS DOUBLE) + value / 10 AS price,
  CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS size, event_id % 5 AS exchange,
  epoch_us(ts) // 1000 * 1000000 AS sip_ns, epoch_us(ts) // 1000 * 1000000 - (event_id % 7) * 400000000 AS part_ns,
  epoch_us(timezone('America/New_York', timezone('UTC', make_timestamp(epoch_us(ts) // 1000 * 1000)))) // 1000 AS et_ms
FROM events"""


fragment("trades", _trades("event_type"))
fragment("wide_trades", _trades("'T' || CAST(user_id AS VARCHAR)"))
_CLEAN = "SELECT * FROM {} WHERE exchange <> 4 OR sip_ns - part_ns <= 1000000000"
fragment("clean", _CLEAN.format("trades"))
fragment("wide_clean", _CLEAN.format("wide_trades"))
_QUOTES = """
SELECT ticker, seq, ts_ms, et_ms, price - CAST(0.01 AS DOUBLE) * (1 + seq % 25) AS bid,
  price + CAST(0.01 AS DOUBLE) * (1 + seq % 17) AS ask, size AS bid_size, 1 + seq % 50 AS ask_size FROM {}"""
fragment("quotes", _QUOTES.format("trades"))
fragment("wide_quotes", _QUOTES.format("wide_trades"))
fragment(
    "profiles",
    """
SELECT 'T' || CAST(c_custkey AS VARCHAR) AS ticker, n_name AS country, c_mktsegment AS sector,
  (c_acctbal + 1000) * 100000 AS market_cap, (c_acctbal + 1000) * 5000 AS float_shares,
  CASE WHEN c_custkey % 10 = 3 THEN 'ETF' WHEN c_custkey % 10 = 7 THEN 'ADRC' ELSE 'CS' END AS type,
  CASE WHEN c_custkey % 11 = 5 THEN DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) END AS delisted
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
fragment(
    "observations",
    """
SELECT doc_id AS obs_id, 'T' || CAST(doc_id % 150 AS VARCHAR) AS symbol,
  1704067200000 + (doc_id * 7919 * 60000) % 2592000000 AS trigger_ms, 1 + doc_id % 10 AS score,
  CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS verdict, source, lang
FROM documents JOIN labels USING (doc_id)""",
)
fragment(
    "samples",
    """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS sample_id,
  'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS orderkey,
  l_linenumber AS linenumber, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  l_extendedprice / 1000 - l_quantity AS ret, l_extendedprice / 1000 AS max_ret,
  CASE WHEN l_returnflag = 'A' THEN 'early' WHEN l_returnflag = 'N' THEN 'mid' ELSE 'late' END AS phase
FROM lineitem""",
)


def session_sql(et: str) -> str:
    m = f"(({et}) % 86400000)"
    return (
        f"CASE WHEN {m} >= 14400000 AND {m} < 34200000 THEN 'premarket' WHEN {m} >= 34200000 AND {m} < 57600000 "
        f"THEN 'regular' WHEN {m} >= 57600000 AND {m} < 72000000 THEN 'afterhours' ELSE 'closed' END"
    )


def session_start_sql(et: str) -> str:
    m = f"(({et}) % 86400000)"
    return (
        f"(({et}) - {m} + CASE WHEN {m} >= 57600000 THEN 57600000 WHEN {m} >= 34200000 THEN 34200000 "
        f"WHEN {m} >= 14400000 THEN 14400000 ELSE 0 END)"
    )


def bar_start_sql(et: str, ms: int) -> str:
    s = session_start_sql(et)
    return f"({s} + ((({et}) - {s}) // {ms}) * {ms})"


def next_boundary_sql(et: str) -> str:
    m = f"(({et}) % 86400000)"
    return (
        f"(({et}) - {m} + CASE WHEN {m} < 14400000 THEN 14400000 WHEN {m} < 34200000 THEN 34200000 "
        f"WHEN {m} < 57600000 THEN 57600000 WHEN {m} < 72000000 THEN 72000000 ELSE 100800000 END)"
    )


def bars_sql(source: str, ms: int) -> str:
    """Bars from trades; `ms` up to four hours."""
    return f"""
SELECT ticker, bar_start, least(bar_start + {ms}, {next_boundary_sql('bar_start')}) AS bar_end,
  {session_sql('bar_start')} AS session, open, high, low, close, volume, trade_count, vwap
FROM (SELECT ticker, {bar_start_sql('et_ms', ms)} AS bar_start,
    arg_min(price, (ts_ms, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ms, seq)) AS close,
    CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count, sum(price * size) / sum(size) AS vwap
  FROM {source} WHERE {session_sql('et_ms')} <> 'closed' GROUP BY 1, 2)"""


fragment("bars", bars_sql("clean", 3600000))
fragment("minute_bars", bars_sql("clean", 60000))
fragment("wide_bars", bars_sql("wide_clean", 3600000))
fragment(
    "daily_bars",
    """
SELECT ticker, et_ms - et_ms % 86400000 AS bar_start, arg_min(price, (ts_ms, seq)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (ts_ms, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count
FROM wide_clean WHERE et_ms % 86400000 >= 14400000 AND et_ms % 86400000 < 72000000 GROUP BY 1, 2""",
)
