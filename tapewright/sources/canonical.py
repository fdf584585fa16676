"""Market-data views of the given star-schema tables: trades, quotes, profiles, observations, samples."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.functions import session as S


class Tables:
    """Lazy readers over one directory of parquet tables; every method declares a plan and runs nothing."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        S.use_utc(spark)
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def trades(self, ticker: str = "event_type", start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Trades with an exchange code and a participant time that lags the report by up to 2.4 s.

        Bounds on the time are literals of the stored column, so they reach the scan.
        """
        e = self.read("events")
        stamp = lambda ms: F.expr(f"TIMESTAMP_NTZ '{datetime.fromtimestamp(ms / 1000, UTC):%Y-%m-%d %H:%M:%S.%f}'")
        if start_ms is not None:
            e = e.filter(F.col("ts") >= stamp(start_ms))
        if end_ms is not None:
            e = e.filter(F.col("ts") < stamp(end_ms + 1))
        key = F.col("event_type") if ticker == "event_type" else F.concat(F.lit("T"), F.col("user_id").cast("string"))
        ms = S.utc_ms("ts")
        return e.select(
            key.alias("ticker"),
            F.col("event_id").alias("seq"),
            ms.alias("ts_ms"),
            (F.lit(20.0) + F.col("value") / 10).alias("price"),
            (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
            (F.col("event_id") % 5).alias("exchange"),
            (ms * 1_000_000).alias("sip_ns"),
            (ms * 1_000_000 - (F.col("event_id") % 7) * 400_000_000).alias("part_ns"),
        )

    def wide_trades(self) -> DataFrame:
        return self.trades("user")

    def quotes(self, ticker: str = "event_type", start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        t = self.trades(ticker, start_ms, end_ms)
        half = lambda m: F.lit(0.01) * (1 + F.col("seq") % m)
        return t.select(
            "ticker", "seq", "ts_ms",
            (F.col("price") - half(25)).alias("bid"),
            (F.col("price") + half(17)).alias("ask"),
            F.col("size").alias("bid_size"),
            (1 + F.col("seq") % 50).alias("ask_size"),
        )

    def profiles(self) -> DataFrame:
        """One row per ticker of the wide trades: country, sector, market value, float, listing type."""
        c, n = self.read("customer"), self.read("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
            F.concat(F.lit("T"), c.c_custkey.cast("string")).alias("ticker"),
            n.n_name.alias("country"),
            c.c_mktsegment.alias("sector"),
            ((c.c_acctbal + 1000) * 100_000).alias("market_cap"),
            ((c.c_acctbal + 1000) * 5_000).alias("float_shares"),
            F.when(c.c_custkey % 10 == 3, "ETF").when(c.c_custkey % 10 == 7, "ADRC").otherwise("CS").alias("type"),
            F.when(c.c_custkey % 11 == 5, F.date_add(F.lit("2024-01-01").cast("date"), (c.c_custkey % 40).cast("int"))).alias("delisted"),
        )

    def observations(self) -> DataFrame:
        """Classified documents as observations spread over the trading month."""
        d, l = self.read("documents"), self.read("labels")
        return d.join(l, "doc_id").select(
            F.col("doc_id").alias("obs_id"),
            F.concat(F.lit("T"), (F.col("doc_id") % 150).cast("string")).alias("symbol"),
            (F.lit(1_704_067_200_000) + (F.col("doc_id") * 7919 * 60_000) % 2_592_000_000).alias("trigger_ms"),
            (1 + F.col("doc_id") % 10).alias("score"),
            F.when(F.col("quality") == 1, "YES").otherwise("NO").alias("verdict"),
            F.col("source").alias("source"),
            F.col("lang").alias("lang"),
        )

    def samples(self) -> DataFrame:
        """Numeric training/research samples: four factors, a 30-minute return and a maximum return."""
        l = self.read("lineitem")
        return l.select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_shipdate").cast("date").cast("string")).alias("sample_id"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("ret"),
            (F.col("l_extendedprice") / 1000).alias("max_ret"),
            F.when(F.col("l_returnflag") == "A", "early").when(F.col("l_returnflag") == "N", "mid").otherwise("late").alias("phase"),
        )
