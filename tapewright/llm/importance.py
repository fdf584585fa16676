"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.durable import checkpoint
from tapewright.llm.common import documents

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 65_536

#: Labelled documents that fit and calibrate at most, those with the smallest hashes of their ids.
MAX_LABELLED = 20_000

#: n-grams of ratio 1 that every document gets besides its own, so that a few words decide nothing.
PRIOR_NGRAMS = 20

#: Buckets of the toxic model, which tells single words; log-likelihood ratio (G-test) from which a bucket counts.
TOXIC_BUCKETS, TOXIC_TEST = 1 << 20, 10.0

#: Documents are drawn by their odds of being clean to the power 1 / TEMPERATURE: 1 draws by the odds themselves, 0 would keep the likeliest.
TEMPERATURE = 0.5
SEED = 11

#: Ridge of the calibration, a share of the number of labelled documents.
RIDGE = 1e-4


def ngram_buckets(text: str, buckets: int = BUCKETS):
    """Buckets of all tokens and pairs of neighbours; a token after itself is one special pair."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    from tapewright.llm.shingles import mix

    tokens = TOKEN.findall(text.lower())
    h = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[h[:-1] == h[1:]] = 1
    return (np.concatenate([mix(h), pairs]) % np.uint64(buckets)).astype(np.int64)


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(id, quality, clean, toxic, fit): at most `most` labelled ids; those with fit train the target model, the others calibrate."""
    by_id = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("clean"), F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    h = F.xxhash64("id")
    return by_id.orderBy(h, "id").limit(most).select("id", F.col("quality").cast("int").alias("quality"), "clean", F.col("toxic").cast("int").alias("toxic"), (F.pmod(h, F.lit(2)) == 0).alias("fit"))


def log_ratios(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS):
    """Log of target over raw probability of every bucket, or None without target documents.

    The raw model counts all documents, the target model the clean ones of the sample that fit. Each
    task adds up its counts, and at most `buckets` sums reach the driver.
    """
    import numpy as np

    def count(batches: Iterable) -> Iterable:
        import numpy as np

        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, good in zip(b["text"], b["good"]):
                c = ngram_buckets(text, buckets)
                np.add.at(raw, c, 1) if len(c) < 2000 else np.add(raw, np.bincount(c, minlength=buckets), out=raw)
                if good:
                    np.add.at(target, c, 1)
        at = np.nonzero(raw)[0]
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    fit = F.broadcast(sample.filter("fit").select("id", (F.col("clean") == 1).alias("good")))
    marked = documents(docs).join(fit, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = marked.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return None
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def toxic_ratios(docs: DataFrame, sample: DataFrame, buckets: int = TOXIC_BUCKETS):
    """Log of toxic over clean share of documents that have a bucket, 0 where not above by the G-test; None without documents
    of both kinds that fit. Each task adds up its counts, of sampled documents only.
    """
    import numpy as np

    def count(batches: Iterable) -> Iterable:
        import numpy as np

        sums = np.zeros((2, buckets), np.int32)
        n = [0, 0]
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                sums[toxic, np.unique(ngram_buckets(text, buckets))] += 1
                n[toxic] += 1
        at = np.nonzero(sums[1])[0]  # others have no ratio above 0
        yield pd.DataFrame({"bucket": [-1, *at], "clean": [n[0], *sums[0][at]], "toxic": [n[1], *sums[1][at]]})
        rest = np.nonzero((sums[0] > 0) & (sums[1] == 0))[0]
        yield pd.DataFrame({"bucket": rest, "clean": sums[0][rest], "toxic": 0})

    fit = F.broadcast(sample.filter("fit AND (toxic = 1 OR clean = 1)").select("id", "toxic"))
    counted = documents(docs).join(fit, "id").select("text", "toxic").mapInPandas(count, "bucket long, clean long, toxic long")
    sums = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("toxic > 1 OR bucket < 0").toPandas()
    n = sums[sums["bucket"] < 0]
    if not len(n) or not n["clean"].iloc[0] or not n["toxic"].iloc[0]:
        return None
    some = sums[sums["bucket"] >= 0]
    n_clean, n_toxic = float(n["clean"].iloc[0]), float(n["toxic"].iloc[0])
    toxic, clean = some["toxic"].to_numpy(float), some["clean"].to_numpy(float)
    share = (toxic + clean) / (n_toxic + n_clean)
    test = 2 * (toxic * np.log(toxic / (share * n_toxic)) + clean * np.log(np.maximum(clean, 1) / (share * n_clean)))
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    out = np.zeros(buckets, np.float32)
    out[some["bucket"]] = np.where((test > TOXIC_TEST) & (ratio > 0), ratio, 0)
    return out


def toxic_scorer(ratios):
    """Column function: text -> sum of the toxic ratios of its distinct n-grams; a few words in a long text are enough."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([float(ratios[np.unique(ngram_buckets(t, len(ratios)))].sum()) for t in texts], dtype="float64")

    return score


def scorer(ratios, buckets: int = BUCKETS):
    """Column function: text -> mean log ratio of its n-grams, drawn to 0 by the prior ones."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = ngram_buckets(t, buckets)
            out.append(float(ratios[c].sum()) / (len(c) + PRIOR_NGRAMS))
        return pd.Series(out, dtype="float64")

    return score


def sampling_key(log_weight: Column, name: Column, seed: int | Column = SEED) -> Column:
    """Log weight plus Gumbel noise that depends on the document's name and the seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return log_weight - F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1000) -> float:
    """The k-th largest value, exactly: histograms of at most `bins` counts, each inside the last one's bin."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    while lo < hi:
        at = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        rows = df.filter(F.col(col).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["lo"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def calibrate(features, clean):
    """(coefficients, offset) of the log odds of `clean` by a ridge logistic fit, or None with one kind only.

    Both kinds weigh the same, and the targets are drawn in by one document of each kind, so that separable features
    have finite odds. Newton steps on as many rows as there are labelled documents at most.
    """
    import numpy as np

    x, y = np.asarray(features, float), np.asarray(clean, float)
    n_clean, n_other = y.sum(), (1 - y).sum()
    if not n_clean or not n_other:
        return None
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    target = np.where(y == 1, (n_clean + 1) / (n_clean + 2), 1 / (n_other + 2))
    share = np.where(y == 1, 0.5 / n_clean, 0.5 / n_other) * len(y)
    ridge = np.diag([RIDGE * len(y)] * x.shape[1] + [1e-9])
    beta = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        curve = share * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(z.T @ (z * curve[:, None]) + ridge, z.T @ (share * (target - p)) - ridge @ beta)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1] / scale, float(beta[-1] - (beta[:-1] * mean / scale).sum())


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, temperature: float = TEMPERATURE):
    """(table, weight, cutoff): (id, mark, log_weight, key, kept) of every document, log weight as a function of text, and the smallest key kept.

    Two log ratios of hashed n-gram models describe a document: the mean ratio of clean over all text, and the sum of toxic over clean
    ones. Their log odds of clean (good and not toxic) are calibrated on labelled documents that did not train the models; the
    weight of a document is these odds to the power 1 / temperature. k is the number of documents whose odds are 1 or more, and the k
    largest keys are kept: Gumbel top-k, which samples by weight without replacement, so a document whose odds are
    near 1 is kept in some draws and not in others. Without labels of both kinds all are kept. Null and empty texts have ratios
    of 0. Repeated rows share their fate. A null id is a name like any other.
    """
    sample = checkpoint(labelled_sample(labels))
    ratios = log_ratios(docs, sample)
    keep_all = documents(docs).select("id", "mark", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key"), F.lit(True).alias("kept")), None, None
    if ratios is None:
        return keep_all
    quality = scorer(ratios)
    toxic = toxic_ratios(docs, sample)
    evidence = toxic_scorer(toxic) if toxic is not None else lambda text: F.lit(0.0)
    raw = checkpoint(documents(docs).select("id", "mark", quality("text").alias("quality_ratio"), evidence("text").alias("evidence")))
    labelled = sample.filter(~F.col("fit")).select("id", "clean")
    # One document of each labelled id, so that no more rows than the sample's reach the driver.
    held = raw.join(F.broadcast(labelled), "id").groupBy("id").agg(F.min(F.struct("mark", "quality_ratio", "evidence", "clean")).alias("r")).select("r.*").toPandas()
    fitted = calibrate(held[["quality_ratio", "evidence"]], held["clean"])
    if fitted is None:
        return keep_all
    (by_quality, by_evidence), offset = fitted

    def log_odds(ratio: Column, seen: Column) -> Column:
        return ratio * float(by_quality) + seen * float(by_evidence) + offset

    def weight(text: Column) -> Column:
        return log_odds(quality(text), evidence(text)) / temperature

    keyed = raw.select("id", "mark", (log_odds(F.col("quality_ratio"), F.col("evidence")) / temperature).alias("log_weight"))
    keyed = keyed.withColumn("key", sampling_key(F.col("log_weight"), F.struct("id", "mark"), seed))
    k = keyed.filter("log_weight >= 0").count()
    cutoff = kth_largest(keyed, "key", k) if k else float("inf")
    return keyed.withColumn("kept", F.col("key") >= cutoff), weight, cutoff


def digest(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) of every document."""
    out, _, _ = resample(docs, labels, seed)
    return out.select(F.col("id").alias("doc_id"), "log_weight", F.col("key").alias("sample_key"), "kept")


def select(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` without the rejected documents; keys are worked out again on the rows, so texts are not shuffled."""
    _, weight, cutoff = resample(docs, labels, seed)
    if weight is None:
        return docs
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark")).alias("name"), weight(text).alias("log_weight"))
    return rows.filter(sampling_key(F.col("log_weight"), F.col("name"), seed) >= cutoff).select("row.*")
