"""Files of the data lake: schemas, CSV conversion, partitioned writes, pruned scans, latest-version reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapewright.functions.durable import shared_folder
from tapewright.functions.numeric import round_scaled
from tapewright.functions.timewin import latest_by
from tapewright.operators.ticks import drop_delayed

_S, _I, _L, _D, _F = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.FloatType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


_AGG = _struct(ticker=_S, volume=_L, open=_F, close=_F, high=_F, low=_F, window_start=_L, transactions=_L)

# The published file layouts. Unsigned integers are held in the next wider signed type.
SCHEMAS: dict[str, T.StructType] = {
    "minute_aggs_v1": _AGG,
    "day_aggs_v1": _AGG,
    "stock_trades_v1": _struct(
        ticker=_S, conditions=_S, correction=_I, exchange=_I, id=_L, participant_timestamp=_L, price=_D, sequence_number=_L,
        sip_timestamp=_L, size=_F, tape=_I, trf_id=_L, trf_timestamp=_L,
    ),
    "stock_quotes_v1": _struct(
        Ticker=_S, ask_exchange=_I, ask_price=_D, ask_size=_L, bid_exchange=_I, bid_price=_D, bid_size=_L, conditions=_S, indicators=_S,
        participant_timestamp=_L, sequence_number=_L, sip_timestamp=_L, tape=_I, trf_timestamp=_L,
    ),
    "option_trades_v1": _struct(ticker=_S, conditions=_S, correction=_I, exchange=_I, participant_timestamp=_L, price=_D, sip_timestamp=_L, size=_L),
    "option_quotes_v1": _struct(
        ticker=_S, ask_exchange=_I, ask_price=_D, ask_size=_L, bid_exchange=_I, bid_price=_D, bid_size=_L, sequence_number=_L, sip_timestamp=_L
    ),
}
# Delivered as decimals ("21470.0") but stored as integers.
CSV_ROUNDED = ("volume",)


def work_dir(spark: SparkSession) -> str:
    """A new folder for written intermediates below the cluster's shared checkpoint folder."""
    return shared_folder(spark, "work")


def read_csv(spark: SparkSession, path: str, kind: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed read of (gzipped) CSV. Columns outside the layout stay strings; rounded columns come in as doubles.

    `columns` is the file's header where it differs from the layout; malformed fields become null.
    """
    known = {f.name: f.dataType for f in SCHEMAS[kind]}
    names = list(columns or known)
    schema = T.StructType([T.StructField(c, _D if c in CSV_ROUNDED else known.get(c, _S)) for c in names])
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.withColumns({c: round_scaled(F.col(c), 0).cast("long") for c in CSV_ROUNDED if c in names})


def convert_csv(spark: SparkSession, src: str, dst: str, kind: str, columns: Sequence[str] | None = None) -> None:
    """CSV.gz to Parquet (zstd). A gzip file is one task; the day's files are converted side by side."""
    read_csv(spark, src, kind, columns).write.mode("overwrite").option("compression", "zstd").parquet(dst)


def write_by_date(df: DataFrame, path: str, keys: Sequence[str] = ("date",), order: Sequence[str] = ("ticker", "ts_ms"), rows_per_file: int = 50_000_000) -> None:
    """Idempotent partitioned write: only the partitions present in `df` are replaced.

    Tasks take ranges of (keys, order), so a day is as many files as its share of the rows asks for,
    whatever ticker they are of; rows are sorted inside the files, which gives row-group pruning on
    ticker and time.
    """
    cols = list(keys)
    by = [*cols, *[o for o in order if o in df.columns]]
    d = df.repartitionByRange(*by).sortWithinPartitions(*by)
    d.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*cols).parquet(path)


def write_by_ticker(df: DataFrame, path: str, rows_per_file: int = 50_000_000) -> None:
    """Per-ticker folders; tasks take ranges of (ticker, time), so a hot ticker is as many files as its rows ask for."""
    d = df.repartitionByRange("ticker", "date", "ts_ms").sortWithinPartitions("ticker", "date", "ts_ms")
    d.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def scan(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Partition-pruned scan of a date range."""
    df = spark.read.parquet(path)
    if first:
        df = df.filter(F.col("date") >= F.lit(first).cast("date"))
    if last:
        df = df.filter(F.col("date") <= F.lit(last).cast("date"))
    return df.select(*columns) if columns else df


def load_trades(trades: DataFrame, symbols: Sequence[str] | None = None, start_ms: int | None = None, end_ms: int | None = None, clean: bool = True) -> DataFrame:
    """Trades of some symbols and a time span; all predicates are plain comparisons that reach the scan."""
    t = trades
    if symbols is not None:
        t = t.filter(F.col("ticker").isin(*symbols))
    if start_ms is not None:
        t = t.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        t = t.filter(F.col("ts_ms") <= end_ms)
    return drop_delayed(t) if clean else t


def load_for_candidates(rows: DataFrame, candidates: DataFrame, on: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Rows of the candidates only, in one pass (a semi join; small candidate sets are broadcast by their statistics)."""
    return rows.join(candidates.select(*on).distinct(), list(on), "left_semi")


def fill_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def latest_version(df: DataFrame, keys: Sequence[str], version: str, tie: Sequence[str] = ()) -> DataFrame:
    """Last inserted row per key, as a map-side combining aggregate."""
    return latest_by(df, keys, [version, *tie])


def query_bars(bars: DataFrame, ticker: str, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    out = bars.filter((F.col("ticker") == ticker) & (F.col("bar_start") >= start_ms) & (F.col("bar_start") <= end_ms)).orderBy("bar_start")
    return out.limit(limit) if limit else out


def last_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("bar_start").alias("last_bar_start"))


def tickers_with_bars(bars: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return bars.filter((F.col("bar_start") >= start_ms) & (F.col("bar_start") < end_ms)).select("ticker").distinct()


def query_factors(long: DataFrame, ticker: str, factor: str, start_ms: int, end_ms: int) -> DataFrame:
    on = (F.col("ticker") == ticker) & (F.col("factor") == factor) & F.col("ts_ms").between(start_ms, end_ms)
    return long.filter(on).orderBy("ts_ms")


def absent_dates(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of dates that are not stored yet (incremental accumulation)."""
    return incoming.join(stored.select("date").distinct(), "date", "left_anti")


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Sample export as Parquet, CSV (with header) or JSON lines."""
    w = df.write.mode("overwrite")
    {"parquet": lambda: w.parquet(path), "csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path)}[fmt]()
