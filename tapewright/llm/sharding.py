"""Shards by jump consistent hashing: the key and the number of shards decide, without a table of ring points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from tapewright.functions.durable import checkpoint
from tapewright.llm.common import documents

#: Fixed values of the published jump hash: its multiplier, in two halves of 32 bits.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD

#: Steps of the first loop. A key takes about ln(shards) of them, so hardly one is left for the second.
STEPS = 64


def key_of(df: DataFrame, column: str) -> Column:
    """A 64-bit key: the value itself where it is a whole number, else its hash. Null counts as 0."""
    whole = isinstance(df.schema[column].dataType, IntegralType)
    return F.coalesce(F.col(column).cast("long"), F.lit(0)) if whole else F.coalesce(F.xxhash64(F.col(column).cast("string")), F.lit(0))


def _step(state: Column, shards: int) -> Column:
    """The next state (high, low, at, next) of the hash; a finished one stays.

    The key is multiplied modulo 2^64 in parts of 16 and 32 bits, so that no product leaves 63 bits.
    """
    mask = F.lit(0xFFFFFFFF)

    def times_low(x: Column) -> Column:  # x * MULTIPLIER_LOW without its bits from 48 + 32 on; x has 32 bits
        return (x.bitwiseAND(F.lit(0xFFFF)) * MULTIPLIER_LOW) + F.shiftleft((F.shiftright(x, 16) * MULTIPLIER_LOW).bitwiseAND(F.lit(0xFFFF)), 16)

    high, low = state["high"], state["low"]
    product = times_low(low) + 1
    carry = F.shiftright(product, 32) + F.shiftright(F.shiftright(low, 16) * MULTIPLIER_LOW, 16)
    new_low = product.bitwiseAND(mask)
    new_high = (carry.bitwiseAND(mask) + (low * MULTIPLIER_HIGH).bitwiseAND(mask) + times_low(high).bitwiseAND(mask)).bitwiseAND(mask)
    moved = F.struct(new_high.alias("high"), new_low.alias("low"), state["next"].alias("at"))
    moved = moved.withField("next", ((moved["at"] + 1) * (F.lit(2147483648.0) / (F.shiftright(moved["high"], 1) + 1))).cast("long"))
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_shard(df: DataFrame, key: Column, shards: int, name: str) -> DataFrame:
    """`df` with the int column `name`, the shard of the 64-bit `key` among `shards`.

    With one shard more, a key keeps its shard or goes to the new one. What is not done after STEPS steps goes
    on in a second loop of as many steps as there are shards, which always ends the hash.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next")
    )
    done = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), state, lambda s, _: _step(s, shards))
    if shards > STEPS:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards - STEPS)), done, lambda s, _: _step(s, shards))
        done = F.when(done["next"] < shards, rest).otherwise(done)
    return df.withColumn(name, done["at"].cast("int"))


def assign(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """`df` with its shard by the column `key`; all rows of a key, null among them, share one shard. No shuffle."""
    return jump_shard(df, key_of(df, key), shards, name)


def moves(df: DataFrame, key: str, shards: int, more: int) -> DataFrame:
    """The rows of `df` whose shard changes from `shards` to `more` shards, with `shard` and `grown_shard`.

    About (more - shards) / more of the keys move, and only into the new shards.
    """
    return assign(assign(df, key, shards), key, more, "grown_shard").filter("shard <> grown_shard")


def numbered(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """`df` with a gapless number from 0 in each shard, in the given order (nulls first).

    Rows are dealt by ranges of (shard, order, a salt for each row), so neither a large shard nor a third of all rows with
    one value lies in one task. The place within a range is the row's number in its partition; only one row a
    partition and shard is added up.
    """
    salted = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    cols = [shard, *order]
    dealt = salted.withColumn("_salt", F.xxhash64("_row")).repartitionByRange(*cols, "_salt").sortWithinPartitions(*cols, "_salt")
    placed = checkpoint(dealt.drop("_salt", "_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part, F.col(shard).alias("_shard")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row a partition and shard: as few as there are shuffle partitions and shards.
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", "_shard", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    on = (F.shiftright(placed["_at"], 33) == base["_part"]) & placed[shard].eqNullSafe(base["_shard"])
    return placed.join(base, on).select(*df.columns, (F.col("_at") + F.col("_base")).cast("long").alias(name))


def write_sharded(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write `df` as Parquet in one folder a shard; a shard is as many files as its rows ask for."""
    assign(df, key, shards).repartition("shard", F.pmod(F.xxhash64(*df.columns), F.lit(64))).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs`.

    The law is `key`: doc_id and the number of shards decide. Repeated rows and documents of one id share a shard and have
    slots of their own; a null id counts as the key 0, a null text as an empty one. Slots follow doc_id, nulls first.
    """
    text = F.col("text")
    narrow = documents(docs).select(F.col("id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    sharded = assign(assign(narrow, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    return numbered(sharded, "shard", ["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _jump_sql(name: str, shards: int) -> str:
    """DuckDB: a recursive query over (k, b, j) with 128-bit products."""
    return f"""
{name} AS (
  SELECT doc_id, CAST((CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0) END) AS HUGEINT) AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, j, ((k % 4294967296::HUGEINT) * 2862933555777941757::HUGEINT + (((k >> 32) * (2862933555777941757::HUGEINT % 4294967296::HUGEINT)) % 4294967296::HUGEINT) * 4294967296::HUGEINT + 1)
    % 18446744073709551616::HUGEINT AS k2 FROM {name} WHERE j < {shards})
)"""


DIGEST_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END) AS v FROM range(256) r(i))
), {_jump_sql("now", 16)}, {_jump_sql("grown", 17)},
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents
), summed AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM docs, crc_table
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, CAST(n.b AS INTEGER) AS shard, row_number() OVER (PARTITION BY n.b ORDER BY s.doc_id NULLS FIRST) - 1 AS slot, CAST(g.b AS INTEGER) AS grown_shard
FROM summed s JOIN now n ON s.doc_id IS NOT DISTINCT FROM n.doc_id AND n.j >= 16 JOIN grown g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND g.j >= 17
"""
