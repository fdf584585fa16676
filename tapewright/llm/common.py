"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"

#: Ways in which a hot join key is split.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; plain ASCII takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """(id, mark, text, more ...): null text is empty; id and mark, a hash of the text, name a document.

    All other columns of `docs` are left behind, so their names cannot clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), *more)


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, id, mark, text): `row` is a struct of all columns, for operators that return them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (id, mark), where a null id equals a null id."""
    return left["id"].eqNullSafe(right["id"]) & (left["mark"] == right["mark"])


def join_documents(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """`left` with the other columns of `right`, joined by document."""
    r = right.withColumnsRenamed({"id": "_rid", "mark": "_rmark"})
    return left.join(r, left["id"].eqNullSafe(r["_rid"]) & (left["mark"] == r["_rmark"]), how).drop("_rid", "_rmark")


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on `keys` where one key may hold a large share of `big`.

    Rows of `big` are dealt by key and `spread`, each row of `small` goes to every share. Both inputs
    are shuffled just before the join, so adaptive execution can split what is still skewed.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


def with_text(docs: DataFrame, row: str, text: Column) -> list[Column]:
    """The columns of `docs` out of the struct `row`, with a new text and, if there, its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(row)[c]).alias(c) for c in docs.columns]
