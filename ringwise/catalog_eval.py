"""Registered evaluation queries (I1-I20, H10) with brute-force DuckDB oracles.

The oracles evaluate every threshold directly over all labelled rows
(``p >= i/100``), an independent check of the bucketed Spark plans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwise.catalog import _g, register, txn
from ringwise.checks.graph_sql import THRESHOLD_SQL, ratio_round_sql
from ringwise.checks.oracle import with_base
from ringwise.functions.decisions import SEGMENT_THRESHOLDS
from ringwise.functions.keys import card_key
from ringwise.operators import evaluate as ev
from ringwise.operators import review, scoring
from ringwise.sources import adapter

ACTIVE = ev.active_threshold(SEGMENT_THRESHOLDS)
D = "CAST({} AS DOUBLE)".format

LAB = """
  SELECT *, CAST(is_fraud_label AS INTEGER) AS y, fraud_probability AS p,
    CAST(round(coalesce(transaction_amt, 0.0)*100) AS BIGINT) AS amt_cents
  FROM predictions WHERE is_fraud_label IS NOT NULL"""

#: The profit sweep only sees rows with label and amount.
LAB_AMT = LAB + " AND transaction_amt IS NOT NULL"


def lab(spark, sf):
    return ev.labelled(adapter.predictions(spark, sf))


def api_sql(tp="tp", fp="fp", fn="fn") -> str:
    prec = ratio_round_sql(tp, f"greatest({tp} + {fp}, 1)", 4)
    rec = ratio_round_sql(tp, f"greatest({tp} + {fn}, 1)", 4)
    return (f"{prec} AS precision, {rec} AS recall, "
            f"2*({prec})*({rec}) / greatest({D('0.001')}, ({prec}) + ({rec})) AS f1")


def grid_sql(lo: int, hi: int, where: str = "") -> str:
    """Brute force: confusion and cents at each i/100 for i in [lo, hi]."""
    t = f"g.i / {D(100)}"
    return f"""
  SELECT g.i, {t} AS threshold,
    count_if(p >= {t} AND y = 1) AS tp, count_if(p >= {t} AND y = 0) AS fp,
    count_if(p < {t} AND y = 1) AS fn, count_if(p < {t} AND y = 0) AS tn,
    CAST(sum(CASE WHEN p >= {t} AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS tp_cents,
    CAST(sum(CASE WHEN p >= {t} AND y = 0 THEN amt_cents ELSE 0 END) AS BIGINT) AS fp_cents,
    CAST(sum(CASE WHEN p < {t} AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS fn_cents
  FROM lab CROSS JOIN range({lo}, {hi + 1}) g(i) {where} GROUP BY g.i"""


NET_SQL = (f"(tp_cents / {D(100)}) * {D(4.6)} - (fn_cents / {D(100)}) * {D(4.6)} - (fp_cents / {D(100)}) * {D(1.63)}"
           f" - (tp + fp) * {D(0.014)} * {D(16.33)}")


# ---------------------------------------------------------------- confusion family (H4 decisions)

def _h4(spark, sf):
    return scoring.binary(lab(spark, sf), p="p")


H4_LAB = LAB + ""
YHAT_SQL = f"CAST(p >= {THRESHOLD_SQL.format(seg='customer_segment')} AS INTEGER)"


@register("i1_confusion", with_base(f"""
SELECT count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp,
  count_if(y = 1 AND yhat = 0) AS fn, count_if(y = 0 AND yhat = 0) AS tn
FROM (SELECT *, {YHAT_SQL} AS yhat FROM lab) x""", lab=LAB))
def q_i1(spark, sf):
    return ev.confusion(_h4(spark, sf))


CONF_SQL = f"""
  SELECT count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp,
    count_if(y = 1 AND yhat = 0) AS fn, count_if(y = 0 AND yhat = 0) AS tn
  FROM (SELECT *, {YHAT_SQL} AS yhat FROM lab) x"""


@register("i2_metrics", with_base("""
SELECT tp, fp, fn, tn, prec AS precision, rec AS recall,
  coalesce(CASE WHEN prec + rec <> 0 THEN 2*prec*rec / (prec + rec) END, 0.0) AS f1,
  coalesce(CASE WHEN tp+fp+fn+tn <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tp+fp+fn+tn AS DOUBLE) END, 0.0) AS accuracy,
  coalesce(CASE WHEN fp + tn <> 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) END, 0.0) AS false_positive_rate
FROM (SELECT *, coalesce(CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END, 0.0) AS prec,
  coalesce(CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END, 0.0) AS rec FROM conf) x""",
    lab=LAB, conf=CONF_SQL))
def q_i2(spark, sf):
    return ev.metrics(ev.confusion(_h4(spark, sf)))


@register("i7_business_cost", with_base("""
SELECT tp, fp, fn, tn, CAST(fn * 2000 + fp * 50 AS DOUBLE) AS business_cost FROM conf""", lab=LAB, conf=CONF_SQL))
def q_i7(spark, sf):
    return ev.business_cost(ev.confusion(_h4(spark, sf)))


# ---------------------------------------------------------------- AUC, curve

AUC_SQL = """
  SELECT {keys} CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      CAST(sum(pos * neg_below * 2 + pos * neg) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)) END AS auc,
    CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS neg_below
        FROM (SELECT {keys} p AS s, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {keys} p) a) b
  {group}"""


@register("i3_auc", with_base(AUC_SQL.format(keys="", part="1", src="lab", group=""), lab=LAB))
def q_i3(spark, sf):
    return ev.auc(lab(spark, sf))


@register("i4_curve", with_base(f"""
SELECT threshold, tp, fp, tpr, fpr, precision, recall,
  (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0.0))
   * (precision + coalesce(lag(precision) OVER (ORDER BY threshold DESC), 1.0)) / 2 AS pr_area_piece
FROM (SELECT threshold, tp, fp,
  coalesce(CAST(tp AS DOUBLE) / nullif(CAST(P AS DOUBLE), 0), 0.0) AS tpr,
  coalesce(CAST(fp AS DOUBLE) / nullif(CAST(N AS DOUBLE), 0), 0.0) AS fpr,
  CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(CAST(P AS DOUBLE), 0), 0.0) AS recall
 FROM (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
   sum(pos) OVER () AS P, sum(neg) OVER () AS N
   FROM (SELECT p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM lab GROUP BY p) a) b) c""", lab=LAB))
def q_i4(spark, sf):
    return ev.curve(lab(spark, sf))


@register("i4_pr_area", with_base(f"""
SELECT round(sum((recall - r0) * (precision + p0) / 2), 9) AS pr_area, count(*) AS points FROM (
  SELECT precision, recall, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0.0) AS r0,
    coalesce(lag(precision) OVER (ORDER BY threshold DESC), 1.0) AS p0
  FROM (SELECT threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(CAST(P AS DOUBLE), 0), 0.0) AS recall
        FROM (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
          sum(pos) OVER () AS P FROM (SELECT p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM lab GROUP BY p) a) b) c) d
""", lab=LAB))
def q_i4_area(spark, sf):
    return ev.pr_area(ev.curve(lab(spark, sf)))


@register("i5_best_threshold", with_base(f"""
SELECT threshold, precision, recall, f1, meets_floors FROM (
  SELECT threshold, precision, recall, 2*precision*recall / (precision + recall + {D('1e-12')}) AS f1,
    precision >= {D(0.70)} AND recall >= {D(0.75)} AS meets_floors,
    CASE WHEN precision >= {D(0.70)} AND recall >= {D(0.75)} THEN 2*precision*recall / (precision + recall + {D('1e-12')})
      ELSE 2*precision*recall / (precision + recall + {D('1e-12')})
        - 3.0 * (greatest(0.0, {D(0.70)} - precision) + greatest(0.0, {D(0.75)} - recall)) END AS sc
  FROM (SELECT threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(CAST(P AS DOUBLE), 0), 0.0) AS recall
        FROM (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
          sum(pos) OVER () AS P FROM (SELECT p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM lab GROUP BY p) a) b) c
) d ORDER BY meets_floors DESC, sc DESC, threshold LIMIT 1""", lab=LAB))
def q_i5(spark, sf):
    return ev.best_threshold(ev.curve(lab(spark, sf)))


# ---------------------------------------------------------------- threshold grids

@register("i6_segment_thresholds", with_base(f"""
SELECT customer_segment, threshold, precision, recall, f1, business_cost, selected, tp, fp, fn, tn FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_segment ORDER BY selected DESC,
      CASE WHEN selected THEN business_cost END ASC NULLS LAST, CASE WHEN selected THEN f1 END DESC NULLS LAST,
      CASE WHEN NOT selected THEN sc END DESC NULLS LAST, i) AS rn
  FROM (SELECT *, 2*precision*recall / (precision + recall + {D('1e-12')}) AS f1,
     2*precision*recall / (precision + recall + {D('1e-12')})
       - 3.0 * (greatest(0.0, {D(0.85)} - precision) + greatest(0.0, {D(0.75)} - recall)) AS sc,
     precision + {D('1e-12')} >= {D(0.85)} AND recall + {D('1e-12')} >= {D(0.75)} AS selected,
     fn * 2000 + fp * 50 AS business_cost
    FROM (SELECT customer_segment, i, i / {D(100)} AS threshold, tp, fp, fn, tn,
       coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall
      FROM (SELECT customer_segment, g.i,
          count_if(p >= g.i / {D(100)} AND y = 1) AS tp, count_if(p >= g.i / {D(100)} AND y = 0) AS fp,
          count_if(p < g.i / {D(100)} AND y = 1) AS fn, count_if(p < g.i / {D(100)} AND y = 0) AS tn
        FROM lab CROSS JOIN range(1, 100) g(i) GROUP BY customer_segment, g.i) a) b) c) d
WHERE rn = 1""", lab=LAB))
def q_i6(spark, sf):
    return ev.segment_thresholds(lab(spark, sf))


SWEEP_SQL = f"""
  SELECT threshold, {NET_SQL} AS net_impact, tp_cents / {D(100)} AS tp_amt, fn_cents / {D(100)} AS fn_amt,
    fp_cents / {D(100)} AS fp_amt, tp, fp, fn, {api_sql()}
  FROM grid"""


@register("i8_profit_sweep", with_base(SWEEP_SQL, lab=LAB_AMT, grid=grid_sql(5, 95)))
def q_i8(spark, sf):
    return ev.profit_sweep(lab(spark, sf))


@register("i8_profit_best", with_base(f"""
SELECT b.threshold AS optimal_threshold, b.net_impact AS optimal_net_impact, {D(0.72)} AS current_threshold,
  c.net_impact AS current_net_impact, b.net_impact - c.net_impact AS improvement
FROM (SELECT * FROM sweep ORDER BY net_impact DESC, threshold LIMIT 1) b,
     (SELECT * FROM sweep ORDER BY abs(threshold - {D(0.72)}), threshold LIMIT 1) c""",
    lab=LAB_AMT, grid=grid_sql(5, 95), sweep=SWEEP_SQL))
def q_i8b(spark, sf):
    return ev.profit_best(ev.profit_sweep(lab(spark, sf)))


@register("i9_evaluation", with_base(f"""
SELECT n AS total_evaluated, nf AS actual_fraud, n - nf AS actual_legit,
  {ratio_round_sql('nf', 'greatest(n, 1)', 4)} AS fraud_rate,
  {ratio_round_sql('fraud_cents', 'greatest(nf, 1) * 100', 2)} AS avg_fraud_amt,
  {ratio_round_sql('legit_cents', 'greatest(n - nf, 1) * 100', 2)} AS avg_legit_amt,
  {D(repr(ACTIVE))} AS active_threshold, tp, fp, fn, tn,
  tp_cents / {D(100)} AS tp_amt, fp_cents / {D(100)} AS fp_amt, fn_cents / {D(100)} AS fn_amt, {api_sql()},
  {ratio_round_sql('tp + tn', 'greatest(n, 1)', 4)} AS accuracy,
  {ratio_round_sql('fp', 'greatest(fp + tn, 1)', 4)} AS fpr, tp + fp AS flag_count
FROM (SELECT count(*) AS n, count_if(y = 1) AS nf, count_if(h AND y = 1) AS tp, count_if(h AND y = 0) AS fp,
  count_if(NOT h AND y = 1) AS fn, count_if(NOT h AND y = 0) AS tn,
  CAST(sum(CASE WHEN h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS tp_cents,
  CAST(sum(CASE WHEN h AND y = 0 THEN amt_cents ELSE 0 END) AS BIGINT) AS fp_cents,
  CAST(sum(CASE WHEN NOT h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS fn_cents,
  CAST(sum(CASE WHEN y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS fraud_cents,
  CAST(sum(CASE WHEN y = 0 THEN amt_cents ELSE 0 END) AS BIGINT) AS legit_cents
  FROM (SELECT *, p >= {D(repr(ACTIVE))} AS h FROM lab) x) a""", lab=LAB))
def q_i9(spark, sf):
    return ev.evaluation(lab(spark, sf), ACTIVE)


@register("i10_cutoffs", with_base(f"""
SELECT threshold, {api_sql()}, tp + fp AS flagged, tp_cents / {D(100)} AS real_tp_amt,
  fp_cents / {D(100)} AS real_fp_amt, fn_cents / {D(100)} AS real_fn_amt
FROM grid WHERE i IN (10, 20, 30, 40, 50, 60, 70, 80, 90, 95)""", lab=LAB, grid=grid_sql(10, 95)))
def q_i10(spark, sf):
    return ev.cutoffs(lab(spark, sf))


@register("i11_by_segment", with_base(f"""
SELECT customer_segment, n, n_fraud, {api_sql()}, tp, fp, fn, tn, tp_cents / {D(100)} AS real_tp_amt,
  fp_cents / {D(100)} AS real_fp_amt, fn_cents / {D(100)} AS real_fn_amt
FROM (SELECT customer_segment, count(*) AS n, count_if(y = 1) AS n_fraud,
  count_if(h AND y = 1) AS tp, count_if(h AND y = 0) AS fp, count_if(NOT h AND y = 1) AS fn,
  count_if(NOT h AND y = 0) AS tn,
  CAST(sum(CASE WHEN h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS tp_cents,
  CAST(sum(CASE WHEN h AND y = 0 THEN amt_cents ELSE 0 END) AS BIGINT) AS fp_cents,
  CAST(sum(CASE WHEN NOT h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS fn_cents
  FROM (SELECT *, p >= {D(repr(ACTIVE))} AS h FROM lab) x
  WHERE customer_segment IN ('VIP', 'Regular', 'New') GROUP BY customer_segment) a""", lab=LAB))
def q_i11(spark, sf):
    return ev.by_segment(lab(spark, sf), ACTIVE)


@register("i12_histogram", with_base(f"""
SELECT g.bin, printf('%.1f-%.1f', g.bin / {D(10)}, (g.bin + 1) / {D(10)}) AS range,
  count(l.p) AS total, count_if(l.y = 1) AS fraud, count(l.p) - count_if(l.y = 1) AS legit
FROM range(0, 10) g(bin) LEFT JOIN lab l ON l.p >= g.bin / {D(10)} AND l.p < (g.bin + 1) / {D(10)}
GROUP BY g.bin""", lab=LAB))
def q_i12(spark, sf):
    return ev.histogram(lab(spark, sf))


I13_SQL = f"""
  SELECT m.model, tp, fp, fn, tn, prec AS precision, rec AS recall,
    coalesce(CASE WHEN prec + rec <> 0 THEN 2*prec*rec / (prec + rec) END, 0.0) AS f1,
    coalesce(CAST(tp + tn AS DOUBLE) / nullif(CAST(tp+fp+fn+tn AS DOUBLE), 0), 0.0) AS accuracy,
    coalesce(CAST(fp AS DOUBLE) / nullif(CAST(fp + tn AS DOUBLE), 0), 0.0) AS false_positive_rate, a.auc
  FROM (SELECT model, count_if(y=1 AND s >= 0.5) AS tp, count_if(y=0 AND s >= 0.5) AS fp,
          count_if(y=1 AND s < 0.5) AS fn, count_if(y=0 AND s < 0.5) AS tn,
          coalesce(CAST(count_if(y=1 AND s >= 0.5) AS DOUBLE) / nullif(CAST(count_if(s >= 0.5) AS DOUBLE), 0), 0.0) AS prec,
          coalesce(CAST(count_if(y=1 AND s >= 0.5) AS DOUBLE) / nullif(CAST(count_if(y=1) AS DOUBLE), 0), 0.0) AS rec
        FROM two GROUP BY model) m
  JOIN (SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
          CAST(sum(pos * neg_below * 2 + pos * neg) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)) END AS auc
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY s
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
              FROM (SELECT model, s, sum(y) AS pos, sum(1 - y) AS neg FROM two GROUP BY model, s) q) r
        GROUP BY model) a ON a.model = m.model"""


@register("i13_compare", with_base("""
SELECT * FROM both_models UNION ALL
SELECT 'difference', b.tp - a.tp, b.fp - a.fp, b.fn - a.fn, b.tn - a.tn, b.precision - a.precision, b.recall - a.recall,
  b.f1 - a.f1, b.accuracy - a.accuracy, b.false_positive_rate - a.false_positive_rate, b.auc - a.auc
FROM both_models a, both_models b WHERE a.model = 'p' AND b.model = 'p2'""",
    two=f"""
  SELECT 'p' AS model, isFraud AS y, fraud_probability AS s FROM transactions UNION ALL
  SELECT 'p2', isFraud, least({D(1)}, fraud_probability + {D(0.05)} * isFraud) FROM transactions""", both_models=I13_SQL))
def q_i13(spark, sf):
    t = txn(spark, sf).select(F.col("isFraud").alias("y"), F.col("fraud_probability").alias("p"),
                              F.least(F.lit(1.0), F.col("fraud_probability") + 0.05 * F.col("isFraud")).alias("p2"))
    return ev.compare(t, "p", "p2")


@register("i14_segment_metrics", with_base(f"""
SELECT c.customer_segment, tp, fp, fn, tn, prec AS precision, rec AS recall,
  coalesce(CASE WHEN prec + rec <> 0 THEN 2*prec*rec / (prec + rec) END, 0.0) AS f1,
  coalesce(CAST(tp + tn AS DOUBLE) / nullif(CAST(tp+fp+fn+tn AS DOUBLE), 0), 0.0) AS accuracy,
  coalesce(CAST(fp AS DOUBLE) / nullif(CAST(fp + tn AS DOUBLE), 0), 0.0) AS false_positive_rate, a.auc
FROM (SELECT customer_segment, count_if(y=1 AND yhat=1) AS tp, count_if(y=0 AND yhat=1) AS fp,
        count_if(y=1 AND yhat=0) AS fn, count_if(y=0 AND yhat=0) AS tn,
        coalesce(CAST(count_if(y=1 AND yhat=1) AS DOUBLE) / nullif(CAST(count_if(yhat=1) AS DOUBLE), 0), 0.0) AS prec,
        coalesce(CAST(count_if(y=1 AND yhat=1) AS DOUBLE) / nullif(CAST(count_if(y=1) AS DOUBLE), 0), 0.0) AS rec
      FROM h GROUP BY customer_segment) c
LEFT JOIN ({AUC_SQL.format(keys='customer_segment,', part='customer_segment', src='h',
                           group='GROUP BY customer_segment')}) a ON a.customer_segment = c.customer_segment""",
    lab=LAB, h=f"SELECT *, {YHAT_SQL} AS yhat FROM lab"))
def q_i14(spark, sf):
    return ev.segment_metrics(_h4(spark, sf))


@register("i16_money", with_base(f"""
SELECT tp_amt * {D(4.6)} AS saved, fn_amt * {D(4.6)} AS lost, fp_amt * {D(1.63)} AS fp_cost,
  CAST(round(flag_count * {D(0.014)}) AS BIGINT) AS reviewed,
  CAST(round(flag_count * {D(0.014)}) AS BIGINT) * {D(16.33)} AS review_cost,
  tp_amt * {D(4.6)} - fn_amt * {D(4.6)} - fp_amt * {D(1.63)} - CAST(round(flag_count * {D(0.014)}) AS BIGINT) * {D(16.33)}
    AS net,
  (tp_amt * {D(4.6)} - fn_amt * {D(4.6)} - fp_amt * {D(1.63)}
    - CAST(round(flag_count * {D(0.014)}) AS BIGINT) * {D(16.33)}) / nullif(n * {D(0.002)}, 0) AS return_per_cost
FROM (SELECT n, tp_cents / {D(100)} AS tp_amt, fp_cents / {D(100)} AS fp_amt, fn_cents / {D(100)} AS fn_amt,
  tp + fp AS flag_count FROM (SELECT count(*) AS n, count_if(h AND y = 1) AS tp, count_if(h AND y = 0) AS fp,
  CAST(sum(CASE WHEN h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS tp_cents,
  CAST(sum(CASE WHEN h AND y = 0 THEN amt_cents ELSE 0 END) AS BIGINT) AS fp_cents,
  CAST(sum(CASE WHEN NOT h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS fn_cents
  FROM (SELECT *, p >= {D(repr(ACTIVE))} AS h FROM lab) x) a) z""", lab=LAB))
def q_i16(spark, sf):
    return ev.money(ev.evaluation(lab(spark, sf), ACTIVE))


@register("i16_money_by_segment", with_base(f"""
SELECT customer_segment, CAST(floor(tp_cents / {D(100)} * {D(4.6)} + {D(0.5)}) AS BIGINT) AS saved,
  CAST(floor(fn_cents / {D(100)} * {D(4.6)} + {D(0.5)}) AS BIGINT) AS lost,
  CAST(floor(fp_cents / {D(100)} * {D(1.63)} + {D(0.5)}) AS BIGINT) AS fp_cost
FROM (SELECT customer_segment,
  CAST(sum(CASE WHEN h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS tp_cents,
  CAST(sum(CASE WHEN h AND y = 0 THEN amt_cents ELSE 0 END) AS BIGINT) AS fp_cents,
  CAST(sum(CASE WHEN NOT h AND y = 1 THEN amt_cents ELSE 0 END) AS BIGINT) AS fn_cents
  FROM (SELECT *, p >= {D(repr(ACTIVE))} AS h FROM lab) x
  WHERE customer_segment IN ('VIP', 'Regular', 'New') GROUP BY customer_segment) a""", lab=LAB))
def q_i16_segments(spark, sf):
    return ev.money_by_segment(ev.by_segment(lab(spark, sf), ACTIVE))


@register("i18_override_decisions", with_base(f"""
SELECT CASE WHEN p >= {D(0.65)} THEN 1 ELSE 0 END AS yhat, customer_segment, count(*) AS n, count_if(y = 1) AS frauds
FROM lab GROUP BY ALL""", lab=LAB))
def q_i18(spark, sf):
    """What an override of 0.65 for every segment decides."""
    in_force = ev.thresholds_in_force(SEGMENT_THRESHOLDS, 0.65)
    return scoring.binary(lab(spark, sf), p="p", thresholds=in_force).groupBy("yhat", "customer_segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("frauds"))


@register("i17_latency_profile", with_base("""
SELECT count(*) AS n, round(count(*) * 1000.0 / sum(latency_ms), 6) AS rows_per_second, round(avg(latency_ms), 9) AS mean_ms, quantile_cont(latency_ms, 0.5) AS p50_ms,
  quantile_cont(latency_ms, 0.95) AS p95_ms, quantile_cont(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms
FROM predictions"""))
def q_i17(spark, sf):
    return ev.latency_profile(adapter.predictions(spark, sf))


@register("i19_nearest", with_base(f"""
SELECT * FROM ({SWEEP_SQL}) s ORDER BY abs(threshold - {D(0.72)}), threshold LIMIT 1""",
    lab=LAB_AMT, grid=grid_sql(5, 95)))
def q_i19(spark, sf):
    return ev.nearest(ev.profit_sweep(lab(spark, sf)), 0.72)


@register("i19_best_points", with_base(f"""
SELECT * FROM ({SWEEP_SQL}) s ORDER BY net_impact DESC, threshold LIMIT 10""", lab=LAB_AMT, grid=grid_sql(5, 95)))
def q_i19_best(spark, sf):
    return ev.best_points(ev.profit_sweep(lab(spark, sf)))


@register("k12_confusion_shares", with_base("""
SELECT cell, count, coalesce(count * 100.0 / nullif(sum(count) OVER (), 0), 0.0) AS percent FROM (
  SELECT 'tp' AS cell, tp AS count FROM conf UNION ALL SELECT 'fp', fp FROM conf UNION ALL
  SELECT 'fn', fn FROM conf UNION ALL SELECT 'tn', tn FROM conf) x""", lab=LAB, conf=CONF_SQL))
def q_k12_cells(spark, sf):
    return review.confusion_shares(ev.confusion(_h4(spark, sf)))


MISSED_SQL = f"""
  SELECT DISTINCT k.card_id FROM keyed k JOIN predictions pr ON pr.transaction_id = CAST(k.TransactionID AS VARCHAR)
  WHERE k.isFraud = 1 AND NOT (pr.fraud_probability >= {THRESHOLD_SQL.format(seg='pr.customer_segment')})"""


def scored_txn(spark, sf, t=None):
    """Transactions with their binary prediction; ``t``: a stored transactions table to read them from."""
    t = txn(spark, sf) if t is None else t
    pr = adapter.predictions(spark, sf, t).select("transaction_id", "customer_segment",
                                                  F.col("fraud_probability").alias("p"))
    keyed = t.select(F.col("TransactionID").cast("string").alias("transaction_id"), "isFraud",
                     card_key().alias("card_id"))
    return scoring.binary(keyed.join(pr, "transaction_id"), p="p")


@register("i20_missed_cards", _g("SELECT card_id FROM missed", "keyed", missed=MISSED_SQL))
def q_i20(spark, sf):
    return ev.missed_cards(scored_txn(spark, sf))


@register("h10_flag_reason")
def q_h10(spark, sf):
    return scoring.flag_reasons(adapter.predictions(spark, sf))
