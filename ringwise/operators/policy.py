"""Policy evaluation (J1-J7), re-aimed from reinforcement learning.

The reference's agents use discount 0, so what they learn is the mean reward
per state and action - an aggregation, built here as one.

Fixed values (reward per action, label and segment):
  APPROVE       fraud -2000, legit +10
  AUTO_APPROVE  fraud -2000, legit +15
  BLOCK         fraud +100,  legit -5000 for VIP, -50 otherwise
  FLAG          fraud +50,   legit -100 for VIP, -25 otherwise
Older reward: -2000 per missed fraud, -50 per false alarm, -10 VIP friction
on any review action.  Hour scale 23 (0.5 when unknown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwise.functions.decisions import encode_segment

ACTIONS = ("APPROVE", "FLAG", "BLOCK", "AUTO_APPROVE")


def states(df: DataFrame) -> DataFrame:
    """State vector (probability, segment number, graph risk, hour / 23 or 0.5)."""
    hour = F.hour("created_at").cast("double")
    return df.select("transaction_id", F.col("fraud_probability").alias("s_prob"),
                     encode_segment("customer_segment").alias("s_segment"),
                     F.col("graph_risk_score").alias("s_risk"),
                     F.coalesce(hour / 23.0, F.lit(0.5)).alias("s_hour"))


def reward(action, is_fraud, segment) -> Column:
    """Reward for an action given the label and segment."""
    a, f, vip = F.col(action), F.col(is_fraud), F.col(segment) == "VIP"
    return (F.when(a == "APPROVE", F.when(f, -2000.0).otherwise(10.0))
            .when(a == "AUTO_APPROVE", F.when(f, -2000.0).otherwise(15.0))
            .when(a == "BLOCK", F.when(f, 100.0).when(vip, -5000.0).otherwise(-50.0))
            .when(a == "FLAG", F.when(f, 50.0).when(vip, -100.0).otherwise(-25.0)))


def reward_v1(action, is_fraud, segment) -> Column:
    """Older reward - missed fraud -2000, false alarm -50, VIP friction -10 on review actions."""
    a, f, vip = F.col(action), F.col(is_fraud), F.col(segment) == "VIP"
    review = a.isin("FLAG", "BLOCK")
    return (F.when(f & ~review, -2000.0).otherwise(0.0) + F.when(~f & review, -50.0).otherwise(0.0)
            + F.when(vip & review, -10.0).otherwise(0.0))


def reward_table(lab: DataFrame) -> DataFrame:
    """J2 as a table: every labelled row against every action (4 actions, an explode - no join)."""
    return (lab.select("transaction_id", "customer_segment", (F.col("is_fraud_label")).alias("is_fraud"),
                       F.explode(F.array(*[F.lit(a) for a in ACTIONS])).alias("action"))
            .withColumn("reward", reward("action", "is_fraud", "customer_segment")))


def compare_strategies(lab: DataFrame, strategies: dict) -> DataFrame:
    """Per strategy total / mean reward, precision / recall / F1 (FLAG + BLOCK = fraud), action counts."""
    parts = [lab.select("customer_segment", F.col("is_fraud_label").alias("is_fraud"),
                        col.alias("action"), F.lit(name).alias("strategy")) for name, col in strategies.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("reward", reward("action", "is_fraud", "customer_segment"))
    hit = F.col("action").isin("FLAG", "BLOCK")
    f = F.col("is_fraud")
    g = u.groupBy("strategy").agg(
        F.sum("reward").alias("total_reward"), F.avg("reward").alias("mean_reward"),
        F.count_if(hit & f).alias("tp"), F.count_if(hit & ~f).alias("fp"), F.count_if(~hit & f).alias("fn"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ACTIONS])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    return g.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                         F.lit(0.0)))


def strategy_difference(compared: DataFrame, first: str, second: str) -> DataFrame:
    """What strategy ``second`` changes against ``first``: recall, precision, F1 (4 digits) and total reward (whole)."""
    def change(c: str, digits: int) -> Column:
        of = [F.max(F.when(F.col("strategy") == s, F.col(c))) for s in (second, first)]
        return F.round(of[0] - of[1], digits).alias(c)

    return compared.agg(F.lit(f"{second} - {first}").alias("strategy"), change("recall", 4), change("precision", 4),
                        change("f1", 4), change("total_reward", 0))


def state_cell(p="fraud_probability", seg="customer_segment", risk="graph_risk_score") -> list[Column]:
    """Binned state: probability decile, segment, graph risk at/above 0.5."""
    pc = F.col(p)
    b0 = F.floor(pc * 10).cast("long")
    dec = F.least(F.when(pc < b0 / 10.0, b0 - 1).when(pc >= (b0 + 1) / 10.0, b0 + 1).otherwise(b0), F.lit(9))
    return [dec.alias("p_decile"), F.col(seg).alias("segment"), (F.col(risk) >= 0.5).alias("risk_high")]


def best_action(lab: DataFrame) -> DataFrame:
    """Per state cell the mean reward of every action and the arg-max (first action order on ties)."""
    order = F.create_map(*[x for i, a in enumerate(ACTIONS) for x in (F.lit(a), F.lit(i))])
    rt = lab.select(*state_cell(), F.col("is_fraud_label").alias("is_fraud"), F.col("customer_segment"),
                    F.explode(F.array(*[F.lit(a) for a in ACTIONS])).alias("action"))
    m = (rt.withColumn("reward", reward("action", "is_fraud", "customer_segment"))
         .groupBy("p_decile", "segment", "risk_high", "action").agg(F.avg("reward").alias("mean_reward"),
                                                                   F.count(F.lit(1)).alias("n")))
    return m.groupBy("p_decile", "segment", "risk_high").agg(
        F.max_by("action", F.struct("mean_reward", -order[F.col("action")])).alias("best_action"),
        F.max("mean_reward").alias("best_mean_reward"), F.max("n").alias("n"))


def moving_average(df: DataFrame, col: str, n: int = 500, run: str = "run", order: str = "created_at",
                   tiebreak: str = "transaction_id") -> DataFrame:
    """Mean of ``col`` over the last ``n`` rows of each run; only full windows are kept.

    No window spans a run (a run may hold a third of all rows): rows are range-sorted by
    (run, order), prefix sums are taken inside each sort partition plus that partition's offset
    (one row per partition), and the window mean is ``(S[i] - S[i-n]) / n`` with ``S[i-n]`` found by an
    equi-join on the global rank.  Exact for integer-valued inputs such as rewards.
    """
    from ringwise.session import cut_lineage
    s = df.select(run, order, tiebreak, F.col(col).cast("double").alias("_x")).orderBy(run, order, tiebreak)
    tagged = cut_lineage(s.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    inpart = Window.partitionBy("_pid").orderBy("_mid")
    tagged = (tagged.withColumn("_ps", F.sum("_x").over(inpart.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_pos", F.row_number().over(inpart)))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = (tagged.groupBy("_pid").agg(F.sum("_x").alias("_t"), F.count(F.lit(1)).alias("_c"))
            .select("_pid", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_toff"),
                    F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_coff")))
    # offs: one row per sort partition - bounded by the partition count, not the data
    g = (tagged.join(F.broadcast(offs), "_pid")
         .select(run, tiebreak, (F.col("_coff") + F.col("_pos") - 1).alias("_r"),
                 (F.col("_toff") + F.col("_ps")).alias("_S")))
    first = g.groupBy(run).agg(F.min("_r").alias("_r0"))
    full = g.join(first, run).where(F.col("_r") - F.col("_r0") >= n - 1)
    prev = g.select((F.col("_r") + n).alias("_r"), F.col("_S").alias("_Sp"))
    return (full.join(prev, "_r", "left")
            .select(run, tiebreak, ((F.col("_S") - F.coalesce("_Sp", F.lit(0.0))) / float(n)).alias("moving_avg")))


def action_mix(df: DataFrame, action: str = "action") -> DataFrame:
    """Action counts and percent of all actions."""
    c = df.groupBy(action).count()
    return c.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))))
