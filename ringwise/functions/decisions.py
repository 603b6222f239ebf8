"""Column-level decision rules.

Fixed values that must equal the reference's behaviour:
  ring threshold                  2 connected fraud cards
  risk step (total connections)   0 -> 0.0, 1 -> 0.3, 2 -> 0.5, >=3 -> 0.7, >=5 -> 0.9
  flag floor                      0.4 x segment threshold
  graph risk that allows a flag   0.5
  segment thresholds              VIP 0.72, Regular 0.88, New 0.82, otherwise 0.5
  segment code                    VIP 1.0, Regular 0.5, otherwise 0.0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringwise.functions.num import fixed

RING_THRESHOLD = 2
SEGMENT_THRESHOLDS = {"VIP": 0.72, "Regular": 0.88, "New": 0.82}
DEFAULT_THRESHOLD = 0.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_step(total) -> Column:
    """Graph risk from the number of connected fraud cards."""
    t = _c(total)
    return (F.when(t >= 5, 0.9).when(t >= 3, 0.7).when(t >= 2, 0.5).when(t == 1, 0.3).otherwise(0.0))


def ring_type(device, email, address) -> Column:
    """The single link type with >= 2 fraud cards, ``multiple`` if several, else ``none``."""
    d, e, a = (_c(x) >= RING_THRESHOLD for x in (device, email, address))
    n_active = d.cast("int") + e.cast("int") + a.cast("int")
    return (F.when(n_active > 1, "multiple").when(d, "device").when(e, "email")
            .when(a, "address").otherwise("none"))


def segment_threshold(segment, thresholds: dict | None = None, default: float = DEFAULT_THRESHOLD) -> Column:
    """Threshold in force for a segment (a 3-entry map literal, so no join)."""
    th = thresholds or SEGMENT_THRESHOLDS
    m = F.create_map(*[x for k, v in th.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(m[_c(segment)], F.lit(float(default)))


def decide(p, threshold, graph_risk, in_ring) -> Column:
    """H5: BLOCK at the threshold; FLAG above 0.4 x threshold when in a ring or risky; else APPROVE."""
    p, t, r, ring = _c(p), _c(threshold), _c(graph_risk), _c(in_ring)
    return (F.when(p >= t, "BLOCK")
            .when((p >= t * 0.4) & (ring | (r >= 0.5)), "FLAG")
            .otherwise("APPROVE"))


def confidence(p, decision) -> Column:
    """H6: BLOCK p, APPROVE 1 - p, FLAG |p - 0.5| + 0.5, to 4 decimals."""
    p, d = _c(p), _c(decision)
    return F.round(F.when(d == "BLOCK", p).when(d == "APPROVE", 1.0 - p)
                   .otherwise(F.abs(p - 0.5) + 0.5), 4)


def encode_segment(segment) -> Column:
    """VIP 1.0, Regular 0.5, anything else 0.0."""
    s = _c(segment)
    return F.when(s == "VIP", 1.0).when(s == "Regular", 0.5).otherwise(0.0)


def flag_reason(p, graph_risk) -> Column:
    """``elevated fraud probability (p)`` / ``high graph risk score (r)`` joined by ``; ``,
    else the borderline wording; first letter upper-case, the rest lower-case."""
    p, r = _c(p), _c(graph_risk)
    text = F.concat_ws("; ",
                       F.when(p >= 0.5, F.concat(F.lit("elevated fraud probability ("), fixed(p, 3), F.lit(")"))),
                       F.when(r >= 0.5, F.concat(F.lit("high graph risk score ("), fixed(r, 3), F.lit(")"))))
    text = F.when(text == "", F.lit("borderline model score with graph risk signal")).otherwise(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)))
