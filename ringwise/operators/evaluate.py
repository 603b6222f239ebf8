"""Evaluation and money.

Threshold sweeps never multiply rows by the number of thresholds.  Each score
is bucketed once (``b`` with ``b/100 <= p < (b+1)/100``, compared as doubles
exactly like ``p >= i/100``), counts and cents are aggregated per
``(group, b)`` with partial aggregation, and a suffix sum over at most 101
buckets per group gives the confusion counts at every grid threshold.
AUC and curves group by distinct score first; their cumulative counts are
running totals over range partitions (``plans.running``), so raw scores of
any number of digits never meet in one task.

Money is summed in integer cents so every engine gets identical totals.

Fixed values: fraud cost multiplier 4.60, false-positive multiplier 1.63,
review cost 16.33 at a 1.4 % review rate; business cost 2000 per missed
fraud and 50 per false alarm; segment floors precision 0.85 / recall 0.75;
single-threshold floors 0.70 / 0.75; penalty weight 3; sweep 0.05..0.95;
segment grid 0.01..0.99; ten cut-offs 0.1 .. 0.9 and 0.95; override +120 per
recovered fraud and -50 per new false alarm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwise.functions.num import cents, ratio_round, safe_div
from ringwise.functions.params import scalar_row
from ringwise.plans.quantile import exact_quantiles
from ringwise.plans.running import running_totals

FRAUD_MULT, FP_MULT, COST_FLAG, FLAG_RATE = 4.60, 1.63, 16.33, 0.014
COST_FN, COST_FP = 2000, 50
CUTOFFS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95)


def bucket(p) -> Column:
    """Grid bucket of a score: largest ``b`` in [0, 100] with ``p >= b/100``.

    A score below 0, a null or a NaN reaches no threshold of the grid: bucket -1.
    """
    p = F.col(p) if isinstance(p, str) else p
    p = F.when(p.isNull() | F.isnan(p) | (p < 0), F.lit(-1.0)).otherwise(F.least(p, F.lit(1.0)))
    b0 = F.floor(p * 100).cast("long")
    b = (F.when(p < b0 / 100.0, b0 - 1).when(p >= (b0 + 1) / 100.0, b0 + 1).otherwise(b0))
    return F.greatest(F.least(b, F.lit(100)), F.lit(-1))


def labelled(pred: DataFrame) -> DataFrame:
    """Prediction rows with a ground-truth label; amount in cents (missing -> 0)."""
    return (pred.where(F.col("is_fraud_label").isNotNull())
            .withColumn("y", F.col("is_fraud_label").cast("int"))
            .withColumn("p", F.col("fraud_probability"))
            .withColumn("amt_cents", cents(F.coalesce("transaction_amt", F.lit(0.0)))))


def threshold_table(df: DataFrame, by: list[str] | None = None, p: str = "p", y: str = "y",
                    amt: str = "amt_cents") -> DataFrame:
    """Confusion counts and cents at every grid threshold ``i/100``, i = 0..100, per group.

    Every row counts at every threshold: those without a score, or with one below 0, are never flagged (fn or tn).
    """
    by = list(by or [])
    keys = by or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(0))
    per_b = (d.groupBy(*keys, bucket(p).alias("i"))
             .agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"),
                  F.sum(F.when(F.col(y) == 1, F.col(amt)).otherwise(0)).cast("long").alias("cpos"),
                  F.sum(F.when(F.col(y) == 0, F.col(amt)).otherwise(0)).cast("long").alias("cneg")))
    # both branches below read the same aggregate, so its exchange is reused: the input is scanned once
    grid = per_b.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(100).cast("long"))).alias("i"))
    j = grid.join(per_b, keys + ["i"], "left").na.fill(0, ["pos", "neg", "cpos", "cneg"])
    whole = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    out = j.select(*keys, "i", F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"),
                   F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                   F.sum("cpos").over(w).alias("tp_cents"), F.sum("cneg").over(w).alias("fp_cents"),
                   F.sum("cpos").over(whole).alias("CP"), F.sum("cneg").over(whole).alias("CN"))
    out = out.select(*keys, "i", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
                     (F.col("N") - F.col("fp")).alias("tn"), "tp_cents", "fp_cents",
                     (F.col("CP") - F.col("tp_cents")).alias("fn_cents")).where(F.col("i") >= 0)
    return out if by else out.drop("_all")


def _api_metrics(tp="tp", fp="fp", fn="fn") -> list[Column]:
    """Precision/recall rounded to 4 dp with max(1, .) guards; F1 from the rounded pair."""
    prec = ratio_round(F.col(tp), F.greatest(F.col(tp) + F.col(fp), F.lit(1)), 4)
    rec = ratio_round(F.col(tp), F.greatest(F.col(tp) + F.col(fn), F.lit(1)), 4)
    f1 = 2 * prec * rec / F.greatest(F.lit(0.001), prec + rec)
    return [prec.alias("precision"), rec.alias("recall"), f1.alias("f1")]


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] | None = None) -> DataFrame:
    """Tp / fp / fn / tn."""
    yy, hh = F.col(y) == 1, F.col(yhat) == 1
    aggs = [F.count_if(yy & hh).alias("tp"), F.count_if(~yy & hh).alias("fp"),
            F.count_if(yy & ~hh).alias("fn"), F.count_if(~yy & ~hh).alias("tn")]
    return df.groupBy(*(by or [])).agg(*aggs)


def metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, false-positive rate, false-decline rate (zero division -> 0)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    return conf.select("*", prec.alias("precision"), rec.alias("recall"),
                       F.coalesce(safe_div(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
                       F.coalesce(safe_div(tp + tn, tp + fp + fn + tn), F.lit(0.0)).alias("accuracy"),
                       F.coalesce(safe_div(fp, fp + tn), F.lit(0.0)).alias("false_positive_rate"))


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``(by, s, pos, neg)``: positives and negatives per distinct score, aggregated before any shuffle."""
    return df.groupBy(*(by or []), F.col(p).alias("s")).agg(F.sum(y).cast("long").alias("pos"),
                                                           F.sum(1 - F.col(y)).cast("long").alias("neg"))


def auc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """ROC AUC with ties counted half; null when a group has one class only."""
    return auc_of_counts(score_counts(df, y, p, by), by)


def auc_of_counts(per_s: DataFrame, by: list[str] | None = None) -> DataFrame:
    """I3 from ``score_counts``: negatives below each score by running totals, pair counts as decimals of 38 digits."""
    by = list(by or [])
    cum = running_totals(per_s, by, "s", ["neg"])
    pos, neg = F.col("pos").cast("decimal(19,0)"), F.col("neg").cast("decimal(19,0)")
    pairs = (pos * (F.col("before_neg").cast("decimal(19,0)") * F.lit(2).cast("decimal(1,0)") + neg).cast("decimal(19,0)"))
    out = cum.groupBy(*by).agg(F.sum(pairs.cast("decimal(28,0)")).alias("twice"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return out.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("twice").cast("double") / (2.0 * F.col("P") * F.col("N"))).alias("auc"),
                      F.col("P").alias("positives"), F.col("N").alias("negatives"))


def curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """I4: one ROC / precision-recall point per distinct score (threshold = score), with PR area pieces.

    Counts above a score come from running totals over range partitions; the point before it follows from the same
    counts without the score's own rows, so no window runs over the curve.
    """
    per_s = score_counts(df, y, p)
    cum = running_totals(per_s, [], "s", ["pos", "neg"], descending=True)
    total = scalar_row(per_s.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    c = cum.select(F.col("s").alias("threshold"), F.col("before_pos").cast("long").alias("_tp0"),
                   F.col("before_neg").cast("long").alias("_fp0"), "pos", "neg", total.alias("_all")).select(
        "threshold", "_tp0", "_fp0", (F.col("_tp0") + F.col("pos")).alias("tp"), (F.col("_fp0") + F.col("neg")).alias("fp"),
        F.col("_all.P").alias("_p"), F.col("_all.N").alias("_n"))
    tpr = F.coalesce(safe_div("tp", "_p"), F.lit(0.0))
    precision = safe_div("tp", F.col("tp") + F.col("fp"))
    recall0 = F.coalesce(safe_div("_tp0", "_p"), F.lit(0.0))
    precision0 = F.coalesce(safe_div("_tp0", F.col("_tp0") + F.col("_fp0")), F.lit(1.0))
    return c.select("threshold", "tp", "fp", tpr.alias("tpr"), F.coalesce(safe_div("fp", "_n"), F.lit(0.0)).alias("fpr"),
                    precision.alias("precision"), tpr.alias("recall"),
                    ((tpr - recall0) * (precision + precision0) / 2).alias("pr_area_piece"))


def pr_area(points: DataFrame) -> DataFrame:
    """I4: area under the precision-recall curve (trapezoids) and the number of its points."""
    return points.agg(F.round(F.sum("pr_area_piece"), 9).alias("pr_area"), F.count(F.lit(1)).alias("points"))


def best_threshold(pts: DataFrame, precision_min: float = 0.70, recall_min: float = 0.75) -> DataFrame:
    """Among curve points meeting both floors the highest F1; else F1 minus 3 x shortfall; the lowest on ties."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + 1e-12)
    ok = (p >= precision_min) & (r >= recall_min)
    pen = F.greatest(F.lit(0.0), F.lit(precision_min) - p) + F.greatest(F.lit(0.0), F.lit(recall_min) - r)
    score = F.when(ok, f1).otherwise(f1 - 3.0 * pen)
    return (pts.where(p.isNotNull()).select("threshold", "precision", "recall", f1.alias("f1"),
                                           ok.alias("meets_floors"), score.alias("_score"))
            .orderBy(F.desc("meets_floors"), F.desc("_score"), "threshold").limit(1).drop("_score"))


def segment_thresholds(df: DataFrame, seg: str = "customer_segment", precision_min: float = 0.85,
                       recall_min: float = 0.75) -> DataFrame:
    """Per segment, on the grid 0.01..0.99: cheapest feasible threshold (ties: F1, then lowest), else penalised F1."""
    t = threshold_table(df, [seg]).where(F.col("i").between(1, 99))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    f1 = 2 * prec * rec / (prec + rec + 1e-12)
    feasible = (prec + 1e-12 >= precision_min) & (rec + 1e-12 >= recall_min)
    cost = fn * COST_FN + fp * COST_FP
    pen = F.greatest(F.lit(0.0), precision_min - prec) + F.greatest(F.lit(0.0), recall_min - rec)
    c = t.select(seg, (F.col("i") / 100.0).alias("threshold"), "i", prec.alias("precision"), rec.alias("recall"),
                 f1.alias("f1"), cost.alias("business_cost"), feasible.alias("selected"),
                 (f1 - 3.0 * pen).alias("_score"), "tp", "fp", "fn", "tn")
    any_ok = F.max(F.col("selected").cast("int")).over(Window.partitionBy(seg))
    order = Window.partitionBy(seg).orderBy(
        F.desc("selected"),
        F.when(F.col("selected"), F.col("business_cost")).asc_nulls_last(),
        F.when(F.col("selected"), F.col("f1")).desc_nulls_last(),
        F.when(~F.col("selected"), F.col("_score")).desc_nulls_last(), "i")
    return (c.withColumn("_any", any_ok).withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") == 1).drop("_rn", "_any", "_score", "i"))


def business_cost(conf: DataFrame) -> DataFrame:
    """2000 per missed fraud plus 50 per false alarm."""
    return conf.withColumn("business_cost", (F.col("fn") * COST_FN + F.col("fp") * COST_FP).cast("double"))


def _net(tp_c, fn_c, fp_c, flagged: Column) -> Column:
    return ((F.col(tp_c) / 100.0) * FRAUD_MULT - (F.col(fn_c) / 100.0) * FRAUD_MULT
            - (F.col(fp_c) / 100.0) * FP_MULT - flagged * FLAG_RATE * COST_FLAG)


def profit_sweep(lab: DataFrame, lo: int = 5, hi: int = 95) -> DataFrame:
    """I8: net money at every threshold lo/100 .. hi/100 (rows with label and amount)."""
    lab = lab.where(F.col("transaction_amt").isNotNull())
    t = threshold_table(lab).where(F.col("i").between(lo, hi))
    return t.select((F.col("i") / 100.0).alias("threshold"),
                    _net("tp_cents", "fn_cents", "fp_cents", F.col("tp") + F.col("fp")).alias("net_impact"),
                    (F.col("tp_cents") / 100.0).alias("tp_amt"), (F.col("fn_cents") / 100.0).alias("fn_amt"),
                    (F.col("fp_cents") / 100.0).alias("fp_amt"), "tp", "fp", "fn", *_api_metrics())


def profit_best(sweep: DataFrame, current: float = 0.72) -> DataFrame:
    """I8 summary: best threshold (first on ties), net at the curve point nearest ``current``, improvement."""
    best = F.max_by(F.struct("net_impact", "threshold"), F.struct("net_impact", -F.col("threshold")))
    cur = F.min_by("net_impact", F.struct(F.abs(F.col("threshold") - current), "threshold"))
    return sweep.agg(best.alias("_b"), cur.alias("current_net_impact")).select(
        F.col("_b.threshold").alias("optimal_threshold"), F.col("_b.net_impact").alias("optimal_net_impact"),
        F.lit(current).alias("current_threshold"), "current_net_impact",
        (F.col("_b.net_impact") - F.col("current_net_impact")).alias("improvement"))


def evaluation(lab: DataFrame, threshold: float) -> DataFrame:
    """Summary at the active threshold - counts, API metrics, money by outcome, mean amounts."""
    y = F.col("y") == 1
    hit = F.col("p") >= threshold
    a = lab.agg(
        F.count(F.lit(1)).alias("total_evaluated"), F.count_if(y).alias("actual_fraud"),
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
        F.sum(F.when(hit & y, F.col("amt_cents")).otherwise(0)).alias("tp_cents"),
        F.sum(F.when(hit & ~y, F.col("amt_cents")).otherwise(0)).alias("fp_cents"),
        F.sum(F.when(~hit & y, F.col("amt_cents")).otherwise(0)).alias("fn_cents"),
        F.sum(F.when(y, F.col("amt_cents")).otherwise(0)).alias("fraud_cents"),
        F.sum(F.when(~y, F.col("amt_cents")).otherwise(0)).alias("legit_cents"))
    n, nf = F.col("total_evaluated"), F.col("actual_fraud")
    return a.select(
        "total_evaluated", "actual_fraud", (n - nf).alias("actual_legit"),
        ratio_round(nf, F.greatest(n, F.lit(1)), 4).alias("fraud_rate"),
        ratio_round(F.col("fraud_cents"), F.greatest(nf, F.lit(1)) * 100, 2).alias("avg_fraud_amt"),
        ratio_round(F.col("legit_cents"), F.greatest(n - nf, F.lit(1)) * 100, 2).alias("avg_legit_amt"),
        F.lit(threshold).alias("active_threshold"), "tp", "fp", "fn", "tn",
        (F.col("tp_cents") / 100.0).alias("tp_amt"), (F.col("fp_cents") / 100.0).alias("fp_amt"),
        (F.col("fn_cents") / 100.0).alias("fn_amt"), *_api_metrics(),
        ratio_round(F.col("tp") + F.col("tn"), F.greatest(n, F.lit(1)), 4).alias("accuracy"),
        ratio_round(F.col("fp"), F.greatest(F.col("fp") + F.col("tn"), F.lit(1)), 4).alias("fpr"),
        (F.col("tp") + F.col("fp")).alias("flag_count"))


def cutoffs(lab: DataFrame, points=CUTOFFS) -> DataFrame:
    """Counts, API metrics and money at ten cut-offs."""
    t = threshold_table(lab).where(F.col("i").isin(*points))
    return t.select((F.col("i") / 100.0).alias("threshold"), *_api_metrics(),
                    (F.col("tp") + F.col("fp")).alias("flagged"), (F.col("tp_cents") / 100.0).alias("real_tp_amt"),
                    (F.col("fp_cents") / 100.0).alias("real_fp_amt"), (F.col("fn_cents") / 100.0).alias("real_fn_amt"))


def by_segment(lab: DataFrame, threshold: float, seg: str = "customer_segment") -> DataFrame:
    """Per-segment confusion, API metrics and money at the active threshold."""
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    a = lab.where(F.col(seg).isin("VIP", "Regular", "New")).groupBy(seg).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("n_fraud"),
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
        F.sum(F.when(hit & y, F.col("amt_cents")).otherwise(0)).alias("tp_cents"),
        F.sum(F.when(hit & ~y, F.col("amt_cents")).otherwise(0)).alias("fp_cents"),
        F.sum(F.when(~hit & y, F.col("amt_cents")).otherwise(0)).alias("fn_cents"))
    return a.select(seg, "n", "n_fraud", *_api_metrics(), "tp", "fp", "fn", "tn",
                    (F.col("tp_cents") / 100.0).alias("real_tp_amt"), (F.col("fp_cents") / 100.0).alias("real_fp_amt"),
                    (F.col("fn_cents") / 100.0).alias("real_fn_amt"))


def histogram(lab: DataFrame) -> DataFrame:
    """Ten half-open score bins [i/10, (i+1)/10); a score of exactly 1.0 falls in none."""
    p = F.col("p")
    b0 = F.floor(p * 10).cast("long")
    b = F.when(p < b0 / 10.0, b0 - 1).when(p >= (b0 + 1) / 10.0, b0 + 1).otherwise(b0)
    cnt = (lab.withColumn("bin", b).where(F.col("bin").between(0, 9))
           .groupBy("bin").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("y") == 1).alias("fraud")))
    bins = lab.sparkSession.range(0, 10).withColumnRenamed("id", "bin")
    return (bins.join(cnt, "bin", "left").na.fill(0, ["total", "fraud"])
            .select("bin", F.format_string("%.1f-%.1f", F.col("bin") / 10.0, (F.col("bin") + 1) / 10.0).alias("range"),
                    "total", "fraud", (F.col("total") - F.col("fraud")).alias("legit")))


def compare(df: DataFrame, a: str, b: str, y: str = "y", threshold=0.5) -> DataFrame:
    """Confusion, metrics and AUC for two score columns side by side, and a row ``difference`` (second less first).

    ``threshold`` is a number or a Column, such as the threshold of each row's segment.
    """
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    both = df.select(F.col(y).alias("y"), cut.alias("_cut"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(name).cast("double").alias("p")) for name in (a, b)])).alias("_m")
    ).select("y", "_cut", "_m.model", "_m.p")
    conf = metrics(confusion(both.withColumn("yhat", (F.col("p") >= F.col("_cut")).cast("int")), by=["model"]))
    rows = conf.join(auc(both, by=["model"]).select("model", "auc"), "model")
    figures = [c for c in rows.columns if c != "model"]
    change = rows.agg(F.lit("difference").alias("model"), *[
        (F.max(F.when(F.col("model") == b, F.col(c))) - F.max(F.when(F.col("model") == a, F.col(c)))).alias(c) for c in figures])
    return rows.unionByName(change)


def segment_metrics(df: DataFrame, seg: str = "customer_segment") -> DataFrame:
    """Per segment confusion, metrics and AUC (null when the segment has one class)."""
    m = metrics(confusion(df, by=[seg]))
    return m.join(auc(df, by=[seg]).select(seg, "auc"), seg, "left")


def override_impact(base: DataFrame, with_graph: DataFrame, gain: float = 120.0, loss: float = 50.0) -> DataFrame:
    """Money effect of the graph override: +120 per extra true positive, -50 per extra false positive."""
    both = (base.select("tp", "fp", F.lit(0).alias("v"))
            .unionByName(with_graph.select("tp", "fp", F.lit(1).alias("v"))))
    j = both.agg(*[F.max(F.when(F.col("v") == v, F.col(c))).alias(f"{c}{v}") for v in (0, 1) for c in ("tp", "fp")])
    return j.select("tp0", "fp0", "tp1", "fp1", (F.col("tp1") - F.col("tp0")).alias("delta_tp"),
                    (F.col("fp1") - F.col("fp0")).alias("delta_fp"),
                    ((F.col("tp1") - F.col("tp0")) * gain - (F.col("fp1") - F.col("fp0")) * loss).alias("net_impact"))


def money(ev: DataFrame, per_prediction: float = 0.002) -> DataFrame:
    """I16: money panel - saved, lost, false-positive cost, review cost on round(1.4 % of blocked), net, return."""
    reviewed = F.round(F.col("flag_count") * FLAG_RATE).cast("long")
    saved = F.col("tp_amt") * FRAUD_MULT
    lost = F.col("fn_amt") * FRAUD_MULT
    fp_cost = F.col("fp_amt") * FP_MULT
    review = reviewed * COST_FLAG
    net = saved - lost - fp_cost - review
    spend = F.col("total_evaluated") * per_prediction
    return ev.select(saved.alias("saved"), lost.alias("lost"), fp_cost.alias("fp_cost"),
                     reviewed.alias("reviewed"), review.alias("review_cost"), net.alias("net"),
                     safe_div(net, spend).alias("return_per_cost"))


def money_by_segment(segments: DataFrame) -> DataFrame:
    """I16 by segment: saved, lost and false-positive cost in whole units, from the rows of I11."""
    return segments.select("customer_segment", *[F.floor(F.col(c) * m + 0.5).cast("long").alias(n) for c, m, n in (
        ("real_tp_amt", FRAUD_MULT, "saved"), ("real_fn_amt", FRAUD_MULT, "lost"), ("real_fp_amt", FP_MULT, "fp_cost"))])


def latency_profile(df: DataFrame, col: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """Mean, p50/p95/p99 (exact, linear), max and count of a latency column, and rows per second one after another.

    Without groups the quantiles come from rank bracketing (``plans.quantile``)."""
    if not by:
        qs = scalar_row(exact_quantiles(df, col, [0.5, 0.95, 0.99]))
        return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(col), 9).alias("mean_ms"),
                      F.max(col).alias("max_ms"), F.sum(col).alias("_all")).select(
            "n", F.round(safe_div(F.col("n") * 1000.0, "_all"), 6).alias("rows_per_second"), "mean_ms", qs["q0"].alias("p50_ms"), qs["q1"].alias("p95_ms"), qs["q2"].alias("p99_ms"), "max_ms")
    q = F.percentile(col, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return (df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(col), 9).alias("mean_ms"),
                                        q.alias("_q"), F.max(col).alias("max_ms"), F.sum(col).alias("_all"))
            .select(*(by or []), "n", F.round(safe_div(F.col("n") * 1000.0, "_all"), 6).alias("rows_per_second"), "mean_ms", F.col("_q")[0].alias("p50_ms"), F.col("_q")[1].alias("p95_ms"),
                    F.col("_q")[2].alias("p99_ms"), "max_ms"))


def active_threshold(defaults: dict, override: float | None = None) -> float:
    """The override for every segment, else the mean of the segment defaults."""
    return float(override) if override is not None else sum(defaults.values()) / max(1, len(defaults))


def thresholds_in_force(defaults: dict, override: float | None = None) -> dict:
    """Threshold per segment: the override (0.01 to 0.99, four digits) for all of them, else their defaults.

    The result is the ``thresholds`` argument of the scoring operators; no override means a reset.
    """
    if override is None:
        return dict(defaults)
    if not 0.01 <= override <= 0.99:
        raise ValueError(f"threshold {override} is not between 0.01 and 0.99")
    return {seg: round(float(override), 4) for seg in defaults}


def best_points(sweep: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` points of the profit sweep with the highest net (the lower threshold on ties), best first."""
    return sweep.orderBy(F.desc("net_impact"), "threshold").limit(k)


def nearest(curve_df: DataFrame, t: float, col: str = "threshold") -> DataFrame:
    """The curve point closest to ``t`` (lower threshold on ties)."""
    return curve_df.orderBy(F.abs(F.col(col) - t), col).limit(1)


def missed_cards(scored: DataFrame) -> DataFrame:
    """Distinct card keys of frauds the thresholds let through (label 1, prediction 0)."""
    return scored.where((F.col("isFraud") == 1) & (F.col("yhat") == 0)).select("card_id").distinct()
