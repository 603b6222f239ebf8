"""Running totals, bracketed quantiles and curves against plain Python and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwise.operators import evaluate as ev
from ringwise.plans.quantile import exact_quantiles, quantiles_of
from ringwise.plans.running import running_totals


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_per_group(spark, descending):
    r = random.Random(5)
    rows = [(g, s / 1000, r.randrange(9)) for g in ("a", "b", None) for s in r.sample(range(5000), 900)]
    rows += [("hot", s / 7, 1) for s in range(4000)]
    df = spark.createDataFrame(rows, "g string, s double, c long").repartition(7)
    got = {(x.g, x.s): int(x.before_c) for x in running_totals(df, ["g"], "s", ["c"], descending).collect()}
    want = {}
    for g in ("a", "b", None, "hot"):
        total = 0
        for _, s, c in sorted((x for x in rows if x[0] == g), key=lambda x: x[1], reverse=descending):
            want[(g, s)] = total
            total += c
    assert got == want


def test_running_totals_of_nothing_and_nulls(spark):
    assert running_totals(spark.createDataFrame([], "s double, c long"), [], "s", ["c"]).count() == 0
    df = spark.createDataFrame([(None, 2), (1.0, None), (2.0, 5)], "s double, c long")
    assert {x.s: int(x.before_c) for x in running_totals(df, [], "s", ["c"]).collect()} == {None: 0, 1.0: 2, 2.0: 2}


@pytest.mark.parametrize("kind", ["random", "half_equal", "two_values", "one_row", "few"])
def test_quantiles_equal_numpy(spark, kind):
    r = np.random.default_rng(3)
    values = {"random": r.normal(size=60_000), "half_equal": np.concatenate([np.full(30_000, 0.25), r.random(30_000)]),
              "two_values": np.repeat([1.0, 5.0], [3, 2]), "one_row": np.array([4.5]), "few": r.random(7)}[kind]
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    got = exact_quantiles(df, "v", qs).first()
    for i, q in enumerate(qs):
        s, pos = np.sort(values), (len(values) - 1) * q
        lo = int(np.floor(pos))
        hi = min(lo + 1, len(values) - 1)
        assert got[f"q{i}"] == s[lo] + (s[hi] - s[lo]) * (pos - lo)


def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch):
    """A sketch so coarse that its bounds miss the ranks: the brackets open and the result stays exact."""
    from ringwise.plans import quantile
    monkeypatch.setattr(quantile, "ACCURACY", 2)
    monkeypatch.setattr(quantile, "MARGIN", 0.0)
    values = list(range(1001))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, "v", [0.1, 0.5, 0.9]).first()
    assert [got[0], got[1], got[2]] == [100.0, 500.0, 900.0]


def test_quantiles_of_nothing(spark):
    row = exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5, 0.9]).first()
    assert row["q0"] is None and row["q1"] is None


def test_auc_of_counts_beyond_long(spark):
    """10^11 rows: twice the pairs is about 10^22, far over a long."""
    rows = [(i / 10, (i + 1) * 10 ** 9, (11 - i) * 10 ** 9) for i in range(10)]
    got = ev.auc_of_counts(spark.createDataFrame(rows, "s double, pos long, neg long")).first()
    below, twice = 0, 0
    for _, p, n in rows:
        twice += p * (2 * below + n)
        below += n
    P, N = sum(x[1] for x in rows), sum(x[2] for x in rows)
    assert got.auc == float(twice) / (2.0 * P * N) and (got.positives, got.negatives) == (P, N)


def test_auc_and_area_by_brute_force(spark):
    r = random.Random(11)
    rows = [(g, int(r.random() < 0.3), round(r.random(), 2)) for g in "ab" for _ in range(400)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {x.g: x.auc for x in ev.auc(df, by=["g"]).collect()}
    for g in "ab":
        pos = [p for k, y, p in rows if k == g and y]
        neg = [p for k, y, p in rows if k == g and not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[g] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    assert got["one"] is None
    area, pr, pp = 0.0, 0.0, 1.0
    P = sum(y for _, y, _ in rows)
    for t in sorted({p for _, _, p in rows}, reverse=True):
        tp, n = sum(y for _, y, p in rows if p >= t), sum(1 for _, _, p in rows if p >= t)
        area, pr, pp = area + (tp / P - pr) * (tp / n + pp) / 2, tp / P, tp / n
    assert ev.pr_area(ev.curve(df)).first()["pr_area"] == pytest.approx(area, abs=1e-9)


def test_rows_without_score_are_missed_at_every_threshold(spark):
    df = spark.createDataFrame([(1, 0.5, 100), (1, None, 100), (0, -0.5, 100), (0, float("nan"), 100), (0, 0.9, 100)],
                               "y int, p double, amt_cents long")
    got = {x.i: (x.tp, x.fp, x.fn, x.tn) for x in ev.threshold_table(df).collect()}
    assert len(got) == 101 and got[0] == (1, 1, 1, 2) and got[60] == (0, 1, 2, 2)
    only = ev.threshold_table(df.where(F.col("p").isNull())).where("i = 0").first()
    assert (only.fn, only.fn_cents) == (1, 100)


def test_difference_row(spark):
    df = spark.createDataFrame([(1, 0.2, 0.8), (0, 0.6, 0.1), (1, 0.9, 0.9)], "y int, a double, b double")
    got = {x.model: x for x in ev.compare(df, "a", "b").collect()}
    assert (got["difference"].tp, got["difference"].fp, got["difference"].fn) == (1, -1, -1)
    assert got["difference"].auc == pytest.approx(got["b"].auc - got["a"].auc)


def test_quantiles_of_several_columns(spark):
    r = np.random.default_rng(4)
    a, b = r.random(999), np.repeat([2.0, 3.0, 9.0], 333)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, none double")
    got = quantiles_of(df, [("a", 0.75), ("none", 0.5), ("b", 0.5)]).first()
    assert got["q0"] == pytest.approx(np.quantile(a, 0.75), abs=1e-15) and got["q1"] is None and got["q2"] == 3.0
