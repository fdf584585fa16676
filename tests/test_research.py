"""Ranks, quantiles, p-values, components, deduplication, rules and text helpers."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions.pvalues import student_two_sided
from tapewright.functions.ranks import average_ranks, exact_quantiles
from tapewright.functions.rules import ANTI_PATTERNS, ENTRY_RULES, Condition, keyword_conditions
from tapewright.functions.text import is_roundup, normalize_title, strip_html, title_fingerprint
from tapewright.operators import news as N
from tapewright.operators.events import classify
from tapewright.operators.joins import connected_groups
from tapewright.operators.stats import pareto_frontier, spearman


def skewed(n=3000, seed=2):
    rnd = random.Random(seed)
    return [(i, 7.0 if rnd.random() < 0.35 else round(rnd.gauss(0, 10), 1), rnd.choice("ab")) for i in range(n)]


def test_ranks_and_quantiles(spark):
    rows = skewed()
    d = spark.createDataFrame(rows, "id long, x double, k string")
    v = np.array([r[1] for r in rows])
    got = {r["x"]: r["rank"] for r in average_ranks(d, "x").collect()}
    for x in set(v.tolist()):
        assert got[x] == (v < x).sum() + ((v == x).sum() + 1) / 2
    q = {r["k"]: r for r in exact_quantiles(d, "x", {"p5": 0.05, "p50": 0.5, "p99": 0.99}, ["k"]).collect()}
    for k in "ab":
        vk = [r[1] for r in rows if r[2] == k]
        assert (q[k]["p5"], q[k]["p50"], q[k]["p99"]) == pytest.approx(tuple(np.quantile(vk, [0.05, 0.5, 0.99])))


def test_spearman_and_p(spark):
    rows = [(float(i % 17), float((i * i) % 23)) for i in range(400)]
    d = spark.createDataFrame(rows, "x double, y double")
    r = spearman(d, "x", "y", p_value=True).first()
    rank = lambda v: np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])
    assert r["rho"] == pytest.approx(np.corrcoef(rank([a for a, _ in rows]), rank([b for _, b in rows]))[0, 1])
    assert 0 <= r["p_value"] <= 1
    # Tabulated two-sided 5 % points.
    for t, df in ((12.706, 1), (2.228, 10), (1.984, 100)):
        assert student_two_sided(t, df) == pytest.approx(0.05, abs=1e-4)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(f"t{i}", f"f{i // 2}") for i in range(0, 60)] + [(f"t{i + 1}", f"g{i}") for i in range(0, 59) if rnd.random() < 0.6 for i in (i,)] + [(f"t{i}", f"g{i}") for i in range(0, 59)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for a, _ in edges:
        groups.setdefault(find(a), []).append(a)
    want = {a: min(groups[find(a)]) for a, _ in edges}
    got = {r["ticker"]: r["group_id"] for r in connected_groups(spark.createDataFrame(edges, "ticker string, figi string"), "ticker", "figi").collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_wins(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"u{rnd.randrange(40)}", "t0" if rnd.random() < 0.3 else f"t{rnd.randrange(60)}") for i in range(150)]
    urls, titles, want = set(), set(), []
    for i, u, t in rows:
        if u not in urls and t not in titles:
            want.append(i)
            urls.add(u)
            titles.add(t)
    d = spark.createDataFrame(rows, "order long, url_id string, title_fp string")
    assert sorted(r["order"] for r in N.first_wins(d).collect()) == want


def test_text(spark):
    titles = ["Express News | Acme, Inc. jumps!", "acme inc   jumps", "BREAKING: Acme Inc Jumps", "12 Tech Stocks Moving In Friday's Session", "Top Gainers today", "Acme hits 52-week high"]
    d = spark.createDataFrame([(t,) for t in titles], "title string").select("title", normalize_title().alias("n"), title_fingerprint().alias("f"), is_roundup().alias("r")).collect()
    assert d[0]["n"] == "acme inc jumps" and d[0]["f"] == d[1]["f"] == d[2]["f"] and len(d[0]["f"]) == 16
    assert [x["r"] for x in d] == [False, False, False, True, True, False]
    page = "<p>A &amp; B&#8217;s <b>big</b>\n\n day</p>"
    got = spark.createDataFrame([(page,)], "b string").select(strip_html("b")).first()[0]
    assert got == re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", page))).strip()


def test_rules(spark):
    cols = ["session_phase", "trade_rate", "relative_volume", "price_direction", "gap_percent", "quote_rate", "bid_ask_spread"]
    rows = [("mid", 12.0, 2.5, 0.8, 0.0, 6.0, 20.0), ("mid", 1.0, 2.5, 0.8, 0.0, 6.0, 20.0), ("mid", 30.0, 1.6, 0.9, 1.0, 1.0, 20.0), ("late", 60.0, 9.0, 0.9, 1.0, 9.0, 20.0), ("mid", 60.0, 9.0, 0.6, 1.0, 9.0, 20.0), ("mid", 8.0, None, 0.9, 1.0, 9.0, 20.0)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'session_phase' else 'double'}" for c in cols))
    got = [r["event_name"] for r in classify(d, ENTRY_RULES, ANTI_PATTERNS).collect()]
    assert got == ["momentum_entry", None, "activity_entry", None, None, None]
    assert [c.op for c in keyword_conditions(a__gte=1, b="x", c__between=(0, 1))] == ["gte", "eq", "between"]
    with pytest.raises(KeyError):
        Condition("nope", "gt", 1).column(["a"])


def test_pareto(spark):
    pts = [(0.1, 0.9), (0.1, 0.8), (0.2, 0.9), (0.3, 0.5), (0.3, 0.5), (0.4, 0.4), (0.25, 0.45)]
    d = spark.createDataFrame(pts, "recall double, precision double")
    want = sorted(p for p in pts if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in pts))
    assert sorted((r["recall"], r["precision"]) for r in pareto_frontier(d).collect()) == want


def test_ranges_of_values(spark):
    import bisect
    import random

    from pyspark.sql import functions as F

    from tapewright.functions.ranks import running_counts, with_range

    rnd = random.Random(3)
    for n in (1, 2, 5, 127):
        edges = sorted(rnd.randrange(40) / 2 for _ in range(n))
        values = [rnd.randrange(-4, 90) / 4 for _ in range(200)] + [float("nan")]
        d = spark.createDataFrame([(v, edges) for v in values], "v double, e array<double>")
        for r in with_range(d, "v", "e", n).collect():
            assert r["_r"] == (n if r["v"] != r["v"] else bisect.bisect_left(edges, r["v"]))
    rows = [(None if i % 50 == 0 else i % 3, None if i % 17 == 0 else rnd.randrange(30) / 4) for i in range(400)]
    counts = running_counts(spark.createDataFrame(rows, "k int, v double"), "v", {"n": F.lit(1)}, ["k"], 8)
    assert "lambda" not in counts._jdf.queryExecution().optimizedPlan().toString()  # no walk over all edges
    for r in counts.collect():
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert (r["cnt_n"], r["before_n"], r["total_n"]) == (own.count(r["v"]), sum(v < r["v"] for v in own), len(own))


def test_ranks_of_extreme_winners(spark):
    """Equal winners keep a row each; rows without a factor are no winners but count for the factors that they have."""
    import random

    from tapewright.operators import research as Q

    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), f"s{i % 90}", float(rnd.randrange(30)), None if i % 13 == 0 else rnd.randrange(8) / 2, float("nan") if i % 29 == 0 else float(rnd.randrange(5))) for i in range(120)]
    rows += [("a", "top", 99.0, 2.0, 3.0)] * 2 + [("b", "none", 98.0, None, 1.0)]
    d = spark.createDataFrame(rows, "date string, sample_id string, max_ret double, x double, y double")
    key = lambda v: (v != v, v)
    share, score = {}, {}
    for day in ("a", "b"):
        for i, f in ((3, "x"), (4, "y")):
            own = [key(r[i]) for r in rows if r[0] == day and r[i] is not None]
            for v in set(own):
                higher = sum(o > v for o in own)
                share[day, f, str(v)] = (higher + (own.count(v) + 1) / 2) / len(own), 100 * sum(o < v for o in own) / len(own)
    full = [r for r in rows if r[0] and r[3] is not None]
    pct = lambda r: (share[r[0], "x", str(key(r[3]))][0], share[r[0], "y", str(key(r[4]))][0])
    for r in full:
        score.setdefault(r[0], []).append(round(0.6 * pct(r)[0] + 0.4 * pct(r)[1], 9))
    top = lambda rs, day: sorted((r for r in rs if r[0] == day), key=lambda r: (-r[2], r[1]))[:2]
    got = sorted((r["date"], r["sample_id"], r["n_total"], round(r["x_pct"], 9), round(r["y_pct"], 9), r["overall_rank"]) for r in Q.composite_rank(d, {"x": 0.6, "y": 0.4}).collect())
    want = sorted((r[0], r[1], len(score[r[0]]), *[round(p, 9) for p in pct(r)], 1 + sum(s > round(0.6 * pct(r)[0] + 0.4 * pct(r)[1], 9) for s in score[r[0]])) for day in "ab" for r in top(full, day))
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[5] - w[5]) <= 1 for g, w in zip(got, want, strict=True))
    below = sorted((r["date"], r["sample_id"], r["factor"], round(r["percentile"], 9)) for r in Q.winner_percentiles(d, ["x", "y"]).collect())
    assert below == sorted((r[0], r[1], f, round(share[r[0], f, str(key(r[i]))][1], 9)) for day in "ab" for r in top(rows, day) for i, f in ((3, "x"), (4, "y")) if r[i] is not None)


def test_folds_move_no_rows(spark):
    """The calendar goes to the rows, so that nine readings of the folds shuffle only dates."""
    from tapewright.operators import training as L

    d = spark.createDataFrame([(f"2024-01-{1 + i % 10:02d}", i) for i in range(50)], "date string, i int")
    folds = L.date_folds(d, 3)
    assert {(r["date"], r["fold"]) for r in folds.collect()} == {(f"2024-01-{k + 1:02d}", min(k // 3, 2)) for k in range(10)}
    assert "strategy=broadcast" in folds._jdf.queryExecution().optimizedPlan().toString()
