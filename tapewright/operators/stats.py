"""Research statistics over sample tables: correlations, quantile buckets, tests, threshold searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.numeric import ratio
from tapewright.functions.pvalues import kolmogorov_p, student_p
from tapewright.functions.ranks import RANGES, attach_scalars, average_ranks, exact_quantiles, running_counts

# Outcome tiers by maximum return, right-closed bounds, and the tiers that count as winners.
TIERS = (("loser", 0.0), ("flat", 10.0), ("small", 20.0), ("medium", 50.0))
TOP_TIER = "big"
WINNERS = ("big", "medium")


def tier(value: str = "max_ret") -> Column:
    out = F.lit(TOP_TIER)
    for name, bound in reversed(TIERS):
        out = F.when(F.col(value) <= bound, name).otherwise(out)
    return F.when(F.col(value).isNotNull(), out)


def with_tier(df: DataFrame, value: str = "max_ret") -> DataFrame:
    return df.withColumn("tier", tier(value))


def _weighted_corr(w: Column, x: Column, y: Column) -> Column:
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov = F.sum(w * x * y) / n - mx * my
    vx, vy = F.sum(w * x * x) / n - mx * mx, F.sum(w * y * y) / n - my * my
    return ratio(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_rows: int = 10, p_value: bool = False) -> DataFrame:
    """Rank correlation per key: rho, n and optionally its two-sided p; rho 0 (p 1) below `min_rows`.

    Equal pairs are counted first; ranks come from the distinct values and meet the pair counts by equi
    joins, so ties of any size stay cheap.
    """
    keys = list(keys)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w"))
    rx = average_ranks(pairs, x, keys, "_rx", "_w").drop("n")
    ry = average_ranks(pairs, y, keys, "_ry", "_w").select(*keys, y, "_ry", F.col("n").alias("_n"))
    j = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    # Ranks are centred at their known mean, which keeps the sums small.
    mid = (F.col("_n") + 1) / 2
    a, b, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    g = j.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"))
    rho = ratio("_ab", F.sqrt(F.col("_aa") * F.col("_bb")))
    out = g.select(*keys, "n", F.when(F.col("n") < min_rows, 0.0).otherwise(rho).alias("rho"))
    return _with_p(out, "rho") if p_value else out


def pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_rows: int = 10, p_value: bool = False) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("rho"))
    out = g.withColumn("rho", F.when(F.col("n") < min_rows, 0.0).otherwise(F.col("rho")))
    return _with_p(out, "rho") if p_value else out


def _with_p(df: DataFrame, rho: str) -> DataFrame:
    dof = (F.col("n") - 2).cast("double")
    t = F.col(rho) * F.sqrt(dof / F.greatest(1 - F.col(rho) * F.col(rho), F.lit(1e-300)))
    return df.withColumn("p_value", student_p(t, dof))


def _describe(df: DataFrame, value: str, keys: Sequence[str], quantiles: Mapping[str, float], weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value)
    # Squares are of distances to the overall mean, so that a large mean does not cancel the variance.
    centred = attach_scalars(df, df.agg(F.avg(value).alias("_mid")))
    off = v - F.col("_mid")
    g = centred.groupBy(*keys).agg(
        F.sum(w).alias("n"), (F.sum(w * v) / F.sum(w)).alias("mean"), F.sum(w * off * off).alias("_q"), F.sum(w * off).alias("_s"),
        (F.sum(F.when(v > 0, w).otherwise(0)) / F.sum(w)).alias("pos_rate"),
    )
    q = exact_quantiles(df, value, quantiles, keys, weight)
    j = g.join(q, list(keys)) if keys else attach_scalars(g, q)
    var = F.greatest(F.col("_q") / F.col("n") - F.pow(F.col("_s") / F.col("n"), 2), F.lit(0.0))
    return j.withColumn("std", F.sqrt(var)).drop("_q", "_s")


def quantile_buckets(df: DataFrame, factor: str, value: str, n: int = 5) -> DataFrame:
    """Return distribution per quantile bucket of a factor, bucket -1 being all rows.

    Buckets are right-closed at the exact quantiles; equal edges merge.
    """
    d = df.filter(F.col(factor).isNotNull() & F.col(value).isNotNull()).select(factor, value)
    edges = exact_quantiles(d, factor, {f"q{i}": i / n for i in range(1, n)})
    edges = edges.select(F.array_distinct(F.array(*[f"q{i}" for i in range(1, n)])).alias("_edges"))
    d = attach_scalars(d, edges).withColumn("bucket", F.size(F.filter("_edges", lambda e: e < F.col(factor)))).drop("_edges")
    d = d.withColumn("bucket", F.explode(F.array(F.lit(-1), "bucket")))
    span = d.groupBy("bucket").agg(F.min(factor).alias("lo"), F.max(factor).alias("hi"))
    out = _describe(d, value, ["bucket"], {"median": 0.5, "p95": 0.95, "p05": 0.05})
    return out.join(span, "bucket").select("bucket", "lo", "hi", "n", "mean", "median", "std", "pos_rate", "p95", "p05")


def equal_count_slices(df: DataFrame, factor: str, value: str, slices: int = 5) -> DataFrame:
    """Return statistics of equal-count slices in factor order, ties in the order of the value.

    Identical (factor, value) pairs are counted; a pair count that crosses a slice border is split, so
    every slice has its exact size.
    """
    d = df.filter(F.col(factor).isNotNull() & F.col(value).isNotNull())
    pairs = d.groupBy(factor, value).agg(F.count(F.lit(1)).alias("_w"))
    outer = running_counts(pairs, factor, {"n": "_w"}).select(factor, F.col("before_n").alias("_b"), F.col("total_n").alias("_n"))
    inner = running_counts(pairs, value, {"n": "_w"}, [factor]).select(factor, value, F.col("cnt_n").alias("_c"), F.col("before_n").alias("_bi"))
    p = inner.join(outer, factor).withColumn("_from", F.col("_b") + F.col("_bi")).withColumn("_to", F.col("_from") + F.col("_c"))
    cuts = F.array(*[F.struct(F.lit(i + 1).alias("slice"), F.floor(F.col("_n") * i / slices).alias("lo"), F.floor(F.col("_n") * (i + 1) / slices).alias("hi")) for i in range(slices)])
    p = p.withColumn("_s", F.explode(F.filter(cuts, lambda s: (s["lo"] < F.col("_to")) & (s["hi"] > F.col("_from")))))
    p = p.select(F.col("_s.slice").alias("slice"), value, (F.least("_to", "_s.hi") - F.greatest("_from", "_s.lo")).alias("_w"))
    out = _describe(p, value, ["slice"], {"median": 0.5}, "_w")
    # Sample deviation, as the slices are reported.
    return out.withColumn("std", F.when(F.col("n") > 1, F.col("std") * F.sqrt(F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1)))).select("slice", "n", "mean", "median", "std", "pos_rate")


def per_symbol_correlation(df: DataFrame, x: str, y: str, min_rows: int = 5) -> DataFrame:
    """Number of symbols with a rank correlation, how many are positive, and their mean."""
    r = spearman(df, x, y, ["symbol"], min_rows).filter((F.col("n") >= min_rows) & F.col("rho").isNotNull())
    return r.agg(F.count(F.lit(1)).alias("n_symbols"), F.count(F.when(F.col("rho") > 0, 1)).alias("n_positive"), F.avg("rho").alias("mean_rho"))


def long_factors(df: DataFrame, factors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, factor); the factor count is a small constant."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])
    return df.select(*keep, F.explode(pairs).alias("_pair")).select(*keep, "_pair.factor", "_pair.x").filter(F.col("x").isNotNull())


def welch(df: DataFrame, factors: Sequence[str], group: str, a: str, b: str, min_rows: int = 5, p_value: bool = False) -> DataFrame:
    """Means of two groups per factor with Welch's t and Cohen's d (population variances in d)."""
    d = long_factors(df.filter(F.col(group).isin(a, b)), factors, [group])
    one = lambda g, f: f(F.when(F.col(group) == g, F.col("x")))
    g = d.groupBy("factor").agg(
        *[one(k, f).alias(f"{n}_{s}") for k, s in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "vs"), (F.var_pop, "vp"))]
    ).filter((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows))
    sa, sb = F.col("vs_a") / F.col("n_a"), F.col("vs_b") / F.col("n_b")
    out = g.select(
        "factor", "n_a", "n_b", "mean_a", "mean_b",
        ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)).alias("t_stat"),
        F.coalesce(ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt((F.col("vp_a") + F.col("vp_b")) / 2)), F.lit(0.0)).alias("cohens_d"),
        ratio((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)).alias("_df"),
    )
    return out.withColumn("p_value", student_p(F.col("t_stat"), F.col("_df"))).drop("_df") if p_value else out.drop("_df")


def distribution_by(df: DataFrame, factors: Sequence[str], group: str) -> DataFrame:
    """Mean, deviation and quartiles of each factor per group."""
    d = long_factors(df, factors, [group])
    g = d.groupBy("factor", group).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return g.join(exact_quantiles(d, "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["factor", group]), ["factor", group])


def ks_two_sample(df: DataFrame, factors: Sequence[str], in_a: Column, in_b: Column, p_value: bool = False) -> DataFrame:
    """Largest distance of the two empirical distributions per factor."""
    d = long_factors(df.select("*", in_a.cast("int").alias("_a"), in_b.cast("int").alias("_b")), factors, ["_a", "_b"])
    rc = running_counts(d, "x", {"a": "_a", "b": "_b"}, ["factor"])
    fa, fb = (F.col("before_a") + F.col("cnt_a")) / F.col("total_a"), (F.col("before_b") + F.col("cnt_b")) / F.col("total_b")
    ok = (F.col("total_a") > 0) & (F.col("total_b") > 0)
    out = rc.filter(ok).groupBy("factor").agg(F.max(F.abs(fa - fb)).alias("ks_stat"), F.first("total_a").alias("n_a"), F.first("total_b").alias("n_b"))
    return out.withColumn("p_value", kolmogorov_p(F.col("ks_stat"), F.col("n_a"), F.col("n_b"))) if p_value else out


def single_factor_auc(df: DataFrame, factors: Sequence[str], positive: Column) -> DataFrame:
    """Area under the ROC curve of each factor alone, folded to at least one half."""
    d = long_factors(df.select("*", positive.cast("int").alias("_p")).withColumn("_q", 1 - F.col("_p")), factors, ["_p", "_q"])
    rc = running_counts(d, "x", {"p": "_p", "q": "_q"}, ["factor"])
    wins = F.sum(F.col("cnt_p").cast("double") * (F.col("before_q") + F.col("cnt_q") / 2))
    g = rc.groupBy("factor").agg(wins.alias("_u"), F.first("total_p").alias("n_pos"), F.first("total_q").alias("n_neg"))
    auc = ratio("_u", F.col("n_pos").cast("double") * F.col("n_neg"))
    enough = (F.col("n_pos") >= 3) & (F.col("n_neg") >= 3) & (F.col("n_pos") + F.col("n_neg") >= 10)
    return g.select("factor", "n_pos", "n_neg", F.when(enough, F.greatest(auc, 1 - auc)).otherwise(0.5).alias("auc"))


def threshold_sensitivity(df: DataFrame, factor: str, thresholds: Sequence[float], value: str = "max_ret", winners: Sequence[str] = WINNERS, min_rows: int = 5) -> DataFrame:
    """Precision, recall and mean return above each threshold, all from one pass."""
    win = F.col("tier").isin(*winners)
    aggs = [F.count(F.when(win, 1)).alias("_win")]
    for i, t in enumerate(thresholds):
        on = F.col(factor) > t
        aggs += [F.count(F.when(on, 1)).alias(f"n{i}"), F.count(F.when(on & win, 1)).alias(f"w{i}"), F.avg(F.when(on, F.col(value))).alias(f"r{i}")]
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n_signals"), ratio(f"w{i}", f"n{i}").alias("precision"), F.coalesce(ratio(f"w{i}", "_win"), F.lit(0.0)).alias("recall"), F.col(f"r{i}").alias("avg_return"))
        for i, t in enumerate(thresholds)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows))).filter(F.col("n_signals") >= min_rows)


def _below(name: str):
    return lambda edge: edge < F.col(name)


GRID_PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def condition_matrix(df: DataFrame, factors: Sequence[str], grid: Mapping[str, Sequence[float]] | None = None, value: str = "max_ret", winners: Sequence[str] = WINNERS, min_rows: int = 5) -> DataFrame:
    """Every combination of thresholds (factor > threshold): signals, precision, recall, mean return.

    Rows are counted into the cells between thresholds (at most (k+1)^m of them); only the cells are
    expanded to the combinations they satisfy. Factors without a given grid use exact quantiles.
    """
    grid = dict(grid or {})
    d = _cell_numbers(df.select(*factors, value, F.col("tier").isin(*winners).cast("int").alias("_w")), factors, grid)
    cells = d.groupBy(*[f"_i_{f}" for f in factors], *[f"_g_{f}" for f in factors]).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"), F.sum(value).alias("_s"))
    total = cells.agg(F.sum("_w").alias("_total"))
    cells = _expand_cells(cells, factors)
    g = cells.groupBy(*factors, *[f"_k_{f}" for f in factors]).agg(F.sum("_n").alias("n_signals"), F.sum("_w").alias("_hit"), F.sum("_s").alias("_s")).filter(F.col("n_signals") >= min_rows)
    g = attach_scalars(g, total)
    return g.select(*factors, "n_signals", ratio("_hit", "n_signals").alias("precision"), ratio("_hit", "_total").alias("recall"), ratio("_s", "n_signals").alias("avg_return"))


def condition_medians(df: DataFrame, factors: Sequence[str], grid: Mapping[str, Sequence[float]], value: str = "max_ret", ranges: int = RANGES) -> DataFrame:
    """Exact median of the value for every combination of given thresholds.

    Values are cut into ranges. The cube of (cell, range) counts is expanded to combinations, which locates the range of each
    combination's median; then only the values of that range are looked at, so rows meet the few combinations whose median lies
    among them instead of all that they satisfy.
    """
    d = _cell_numbers(df.select(*factors, value).filter(F.col(value).isNotNull()), factors, grid)
    at, numbers = [f"_i_{f}" for f in factors], [f"_k_{f}" for f in factors]
    pairs = d.groupBy(*at, *[f"_g_{f}" for f in factors], value).agg(F.count(F.lit(1)).alias("_n"))
    edges = pairs.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("_edges"))
    pairs = attach_scalars(pairs, edges).withColumn("_r", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    cube = _expand_cells(pairs.groupBy(*at, *[f"_g_{f}" for f in factors], "_r").agg(F.sum("_n").alias("_n")), factors)
    whole = Window.partitionBy(*factors)
    upto = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    cube = cube.groupBy(*factors, *numbers, "_r").agg(F.sum("_n").alias("_n")).withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_half": (F.sum("_n").over(whole) - 1) / 2})
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    lower, upper = F.floor("_half"), F.ceil("_half")
    located = cube.filter(holds(lower) | holds(upper)).drop("_n")
    inside = pairs.select(*at, "_r", value, F.col("_n").alias("_m"))
    fits = inside["_r"] == located["_r"]
    for f in factors:
        fits = fits & (inside[f"_i_{f}"] >= located[f"_k_{f}"])
    opened = located.join(inside, fits).groupBy(*factors, located["_r"].alias("_range"), "_before", "_half", value).agg(F.sum("_m").alias("_n"))
    within = Window.partitionBy(*factors, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    low, high = (F.max(F.when(holds(k), F.col(value))) for k in (lower, upper))
    ends = opened.groupBy(*factors).agg(low.alias("_low"), high.alias("_high"))
    return ends.select(*factors, ((F.col("_low") + F.col("_high")) / 2).alias("median_return"))


def _cell_numbers(d: DataFrame, factors: Sequence[str], grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Per factor its threshold array and how many of the thresholds the row exceeds; thresholds not given are quantiles, all from one pass."""
    free = [f for f in factors if f not in grid]
    if free:
        q = exact_quantiles(long_factors(d, free, []), "x", {f"_q{i}": p for i, p in enumerate(GRID_PROBS)}, ["factor"])
        arrays = F.array(*[f"_q{i}" for i in range(len(GRID_PROBS))])
        d = attach_scalars(d, q.agg(*[F.max(F.when(F.col("factor") == f, arrays)).alias(f"_g_{f}") for f in free]))
    for f in grid:
        d = d.withColumn(f"_g_{f}", F.array(*[F.lit(float(x)) for x in grid[f]]))
    for f in factors:
        d = d.withColumn(f"_i_{f}", F.size(F.filter(f"_g_{f}", _below(f))))
    return d


def _expand_cells(cells: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Repeat each cell for the combinations it satisfies; the factor columns become thresholds."""
    for f in factors:
        cells = cells.filter(F.col(f"_i_{f}") > 0).withColumn(f"_k_{f}", F.explode(F.sequence(F.lit(1), F.col(f"_i_{f}"))))
        cells = cells.withColumn(f, F.element_at(f"_g_{f}", F.col(f"_k_{f}")))
    return cells


def pareto_frontier(matrix: DataFrame, x: str = "recall", y: str = "precision") -> DataFrame:
    """Rows no other row beats: a running maximum over the (bounded) matrix instead of comparing all pairs."""
    best = matrix.groupBy(x).agg(F.max(y).alias("_best"))
    above = F.max("_best").over(Window.partitionBy(F.lit(0)).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_above", above)
    return matrix.join(best, x).filter((F.col(y) == F.col("_best")) & (F.col("_above").isNull() | (F.col(y) > F.col("_above")))).select(*matrix.columns)


def locate(matrix: DataFrame, conditions: Mapping[str, float]) -> DataFrame:
    out = matrix
    for f, t in conditions.items():
        out = out.filter(F.col(f) == t)
    return out


def evaluate_variants(df: DataFrame, variants: Mapping[str, Column], value: str = "max_ret", winners: Sequence[str] = WINNERS, keys: Sequence[str] = (), min_rows: int = 5) -> DataFrame:
    """Signals, precision, recall, mean return and win rate per named predicate (and key), from one pass."""
    win = F.col("tier").isin(*winners)
    aggs = [F.count(F.when(win, 1)).alias("_win")]
    for i, (_, on) in enumerate(variants.items()):
        aggs += [
            F.count(F.when(on, 1)).alias(f"n{i}"), F.count(F.when(on & win, 1)).alias(f"h{i}"), F.avg(F.when(on, F.col(value))).alias(f"r{i}"),
            F.avg(F.when(on, F.when(F.col(value) > 0, 1.0).otherwise(0.0))).alias(f"p{i}"),
        ]
    rows = [
        F.struct(F.lit(n).alias("variant"), F.col(f"n{i}").alias("n_signals"), ratio(f"h{i}", f"n{i}").alias("precision"), F.coalesce(ratio(f"h{i}", "_win"), F.lit(0.0)).alias("recall"), F.col(f"r{i}").alias("avg_return"), F.col(f"p{i}").alias("win_rate"))
        for i, n in enumerate(variants)
    ]
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows))).filter(F.col("n_signals") >= min_rows)


def best_thresholds(matrix: DataFrame, metric: str = "precision", min_rows: int = 10) -> DataFrame:
    """The matrix row with the greatest metric; ties go to more signals, then to smaller thresholds."""
    factors = [c for c in matrix.columns if c not in ("n_signals", "precision", "recall", "avg_return")]
    return matrix.filter(F.col("n_signals") >= min_rows).orderBy(F.desc(metric), F.desc("n_signals"), *factors).limit(1)


def split_deltas(df: DataFrame, variants: Mapping[str, Column], split: str, explore: str, validate: str, **kw) -> DataFrame:
    """Validation minus exploration per variant."""
    e = evaluate_variants(df, variants, keys=[split], **kw)
    metrics = ("precision", "recall", "avg_return", "win_rate")
    pick = lambda s, m: F.max(F.when(F.col(split) == s, F.col(m)))
    return e.groupBy("variant").agg(
        *[pick(explore, m).alias(f"explore_{m}") for m in metrics], *[pick(validate, m).alias(f"validate_{m}") for m in metrics],
        *[(pick(validate, m) - pick(explore, m)).alias(f"delta_{m}") for m in metrics],
    )


def date_mean_t_test(df: DataFrame, on: Column, split: str, explore: str, validate: str, value: str = "max_ret", p_value: bool = False) -> DataFrame:
    """Pooled-variance t statistic between the date means of two splits."""
    d = df.filter(on).groupBy(split, "date").agg(F.avg(value).alias("m"))
    pick = lambda s: F.when(F.col(split) == s, F.col("m"))
    g = d.agg(*[f(pick(s)).alias(f"{n}_{k}") for s, k in ((explore, "e"), (validate, "v")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))])
    dof = F.col("n_e") + F.col("n_v") - 2
    pooled = ((F.col("n_e") - 1) * F.col("var_e") + (F.col("n_v") - 1) * F.col("var_v")) / F.when(dof > 0, dof)
    t = ratio(F.col("mean_e") - F.col("mean_v"), F.sqrt(pooled * (1 / F.col("n_e") + 1 / F.col("n_v"))))
    out = g.select("n_e", "n_v", "mean_e", "mean_v", t.alias("t_stat"), dof.alias("dof"))
    return out.withColumn("p_value", student_p(F.col("t_stat"), F.col("dof").cast("double"))) if p_value else out


# --- slices ------------------------------------------------------------------------------------------

# Score buckets, best first.
SCORE_BINS = ((8, "8-10"), (6, "6-7"), (4, "4-5"), (0, "1-3"))


def score_bucket(score: str = "score") -> Column:
    out = F.lit(SCORE_BINS[-1][1])
    for edge, label in reversed(SCORE_BINS[:-1]):
        out = F.when(F.col(score) >= edge, label).otherwise(out)
    return out


def slice_metrics(outcomes: DataFrame, key: Column, dimension: str, ret: str, max_ret: str) -> DataFrame:
    """Count, mean return, mean maximum return, win rate and hit rates per slice; missing returns are left out."""
    r, m = F.col(ret), F.col(max_ret)
    share = lambda c, cond: F.coalesce(F.avg(F.when(c.isNotNull(), F.when(cond, 1.0).otherwise(0.0))), F.lit(0.0))
    return outcomes.groupBy(key.cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.avg(r), F.lit(0.0)).alias("avg_return"), F.coalesce(F.avg(m), F.lit(0.0)).alias("avg_max_return"),
        share(r, r > 0).alias("win_rate"),
        *[share(m, m >= x / 100).alias(f"hit_rate_gt_{x}pct") for x in (5, 10, 20, 50)],
    ).select(F.lit(dimension).alias("dimension"), "*")


def best_per_symbol(obs: DataFrame, symbol: str = "symbol", score: str = "score", ts: str = "trigger_ms") -> DataFrame:
    """Best-scored observation per symbol, the earliest among equals; combined on the map side."""
    cols = [c for c in obs.columns if c != symbol]
    return obs.groupBy(symbol).agg(F.max_by(F.struct(*cols), F.struct(F.col(score), -F.col(ts))).alias("_o")).select(symbol, "_o.*").select(*obs.columns)


def top_per_slice(outcomes: DataFrame, key: Column, max_ret: str, n: int = 5, tie: str = "obs_id") -> DataFrame:
    """The n outcomes with the greatest maximum return of every slice (the limit reaches the map side)."""
    w = Window.partitionBy("label").orderBy(F.desc_nulls_last(max_ret), tie)
    return outcomes.withColumn("label", key.cast("string")).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
