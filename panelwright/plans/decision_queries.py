"""Queries over gates, reviews, state histories and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import HARD_GATES, STATE_EDGES
from ..functions.windows import previous_value
from ..operators import decision as D
from ..operators.factors import build_signals
from ..session import materialise
from ..sources.reports import run_fingerprint
from .check import check_panel, deployment
from .panels import market_panel, stored_market, table
from .registry import register

# One strategy per supplier; its measures come from the whole units it shipped.
_UNITS = """u AS (SELECT 'S'||l_suppkey AS id, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1)"""


def units(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("strategy_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"))


def strategies(spark, folder):
    q = F.col("q")
    level = F.when(q % 3 == 0, "BREACH").otherwise("SAFE")
    return units(spark, folder).select(
        "strategy_id", "q", ((q % 100) / 50.0).alias("dsr"), ((q % 37 - 5) / 10.0).alias("sharpe_mean"), (-(q % 31) / 100.0).alias("max_dd_walk_forward"),
        (-(q % 23) / 100.0).alias("max_dd_oos"), (q % 5 == 0).alias("regime_concentration_flag"), ((q % 97) / 97.0).alias("max_pairwise_corr"),
        F.create_map(F.lit(10000.0), F.lit("SAFE"), F.lit(100000.0), level).alias("capacity"), (q % 4 == 0).cast("int").alias("halt_unexplained_count"))


_STATUS = """st AS (SELECT id, q, CASE
  WHEN (q%100)/50.0 < 0.5 OR (q%37-5) < 0 OR -(q%31)/100.0 < -0.25 OR -(q%23)/100.0 < -0.20 THEN 'REJECTED'
  WHEN (q%100)/50.0 < 0.95 OR q%5=0 OR (q%97)/97.0 > 0.7 OR q%4=0 THEN 'FLAG_REVIEW' ELSE 'APPROVED_CANDIDATE' END AS status,
  concat_ws(',', CASE WHEN (q%100)/50.0 < 0.5 THEN 'dsr_rejected' END, CASE WHEN (q%100)/50.0 >= 0.5 AND (q%100)/50.0 < 0.95 THEN 'dsr_gray_zone' END,
    CASE WHEN q%37-5 < 0 THEN 'negative_oos_sharpe' END, CASE WHEN -(q%31)/100.0 < -0.25 THEN 'drawdown_walk_forward' END,
    CASE WHEN -(q%23)/100.0 < -0.20 THEN 'drawdown_oos' END, CASE WHEN q%5=0 THEN 'regime_concentration' END, CASE WHEN (q%97)/97.0 > 0.7 THEN 'ensemble_correlation' END,
    CASE WHEN q%3=0 THEN 'capacity_breach' END, CASE WHEN q%4=0 THEN 'unexplained_halts' END) AS reasons FROM u)"""


@register("gate_status", f"WITH {_UNITS}, {_STATUS} SELECT id AS strategy_id, status, reasons FROM st")
def gate_status(spark, folder):
    return D.gate_status(strategies(spark, folder)).select("strategy_id", "status", F.array_join("reasons", ",").alias("reasons"))


@register("hard_gates", f"WITH {_UNITS} SELECT id AS strategy_id, (q%3<>0 AND q%5<>0 AND q%7<>0 AND q%11<>0 AND q%13<>0) AS deployable FROM u")
def hard_gates(spark, folder):
    q = F.col("q")
    pairs = [v for name, m in zip(HARD_GATES[:-1], (3, 5, 7, 11)) for v in (F.lit(name), q % m != 0)]
    last = F.when(q % 13 != 0, F.create_map(F.lit(HARD_GATES[-1]), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>"))
    return D.hard_gates(units(spark, folder).withColumn("gates", F.map_concat(F.create_map(*pairs), last))).select("strategy_id", "deployable")


_REVIEW = """rv AS (SELECT id, status, CASE WHEN q%2=0 THEN 'APPROVE' WHEN q%9=1 THEN 'LATER' ELSE 'REJECT' END AS dec, CASE WHEN q%11=0 THEN '' ELSE 'desk' END AS who FROM st)"""


@register("review_apply", f"""WITH {_UNITS}, {_STATUS}, {_REVIEW} SELECT id AS strategy_id,
  CASE WHEN status <> 'FLAG_REVIEW' THEN 'not_under_review' WHEN who = '' OR dec = 'LATER' THEN 'incomplete_review' END AS error,
  CASE WHEN status = 'FLAG_REVIEW' AND who <> '' AND dec <> 'LATER' THEN CASE WHEN dec = 'APPROVE' THEN 'APPROVED' ELSE 'REJECTED' END END AS final FROM rv""")
def review_apply(spark, folder):
    decided = D.gate_status(strategies(spark, folder))
    q = F.col("q")
    reviews = decided.select("strategy_id", F.when(q % 2 == 0, "APPROVE").when(q % 9 == 1, "LATER").otherwise("REJECT").alias("review_decision"),
                             F.when(q % 11 == 0, "").otherwise("desk").alias("reviewed_by"), F.lit("2001-01-01").alias("review_timestamp"))
    return D.apply_reviews(decided, reviews).select("strategy_id", "error", "final")


# Every order is a review update; runs repeat per customer and month.
_UPDATES = """up AS (SELECT o_orderkey AS id, o_custkey % 400 AS s, CASE WHEN o_orderstatus = 'O' THEN 'REJECTED' ELSE 'FLAG_REVIEW' END AS expected,
  o_orderpriority AS who, CASE WHEN o_orderkey % 7 = 0 THEN 'WAIT' WHEN o_orderkey % 2 = 0 THEN 'APPROVE' ELSE 'REJECT' END AS dec,
  strftime(o_orderdate, '%Y-%m-%d') AS stamp, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE strftime(o_orderdate, '%Y') END AS run FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY s, run ORDER BY stamp, id) AS k FROM up)"""


@register("review_conflicts", f"""WITH {_UPDATES} SELECT id AS update_id,
  CASE WHEN run = '' OR dec = 'WAIT' OR expected <> 'FLAG_REVIEW' THEN 'invalid_payload' WHEN s % 3 = 0 THEN 'state_conflict' WHEN who = '5-LOW' THEN 'unknown_reviewer'
    WHEN k > 1 THEN 'duplicate_source_run' END AS rejection,
  CASE WHEN NOT (run = '' OR dec = 'WAIT' OR expected <> 'FLAG_REVIEW' OR s % 3 = 0 OR who = '5-LOW' OR k > 1) THEN CASE WHEN dec = 'APPROVE' THEN 'APPROVED_CANDIDATE' ELSE 'REJECTED' END END AS to_state FROM rk""")
def review_conflicts(spark, folder):
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    updates = table(spark, folder, "orders").select(
        key.alias("update_id"), (F.col("o_custkey") % 400).cast("string").alias("strategy_id"), F.when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("FLAG_REVIEW").alias("expected_state"),
        F.col("o_orderpriority").alias("reviewed_by"), F.when(key % 7 == 0, "WAIT").when(key % 2 == 0, "APPROVE").otherwise("REJECT").alias("review_decision"),
        F.date_format(date, "yyyy-MM-dd").alias("review_timestamp"), F.when(key % 19 == 0, "").otherwise(F.date_format(date, "yyyy")).alias("source_run_id"))
    ids = table(spark, folder, "orders").select((F.col("o_custkey") % 400).alias("s")).distinct()
    current = ids.select(F.col("s").cast("string").alias("strategy_id"), F.when(F.col("s") % 3 == 0, "RESEARCH").otherwise("FLAG_REVIEW").alias("state"))
    checked = D.review_conflicts(updates, current, F.col("reviewed_by") != "5-LOW")
    return checked.select("update_id", "rejection", "to_state")


STATES = ("RESEARCH", "FLAG_REVIEW", "APPROVED_CANDIDATE", "APPROVED_PAPER", "REJECTED", "APPROVED_LIVE")
_STATE = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"
_EDGES = ", ".join(f"('{a}','{b}')" for a, b in STATE_EDGES)


@register("invalid_transitions", f"""WITH e AS (SELECT event_id, user_id, ts, {_STATE} AS to_state, event_type FROM events),
p AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'RESEARCH') AS prev FROM e),
c AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'RESEARCH' ELSE prev END AS from_state FROM p),
ed(a, b) AS (VALUES {_EDGES}),
x AS (SELECT c.*, CASE WHEN event_type = 'error' THEN 'incomplete_event' WHEN from_state <> prev THEN 'broken_chain'
  WHEN NOT EXISTS (SELECT 1 FROM ed WHERE a = from_state AND b = to_state) THEN 'edge_not_allowed' END AS error FROM c)
SELECT event_id AS seq, from_state, to_state, error FROM x WHERE error IS NOT NULL""")
def invalid_transitions(spark, folder):
    pick = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("event_id") % 6 + 1).cast("int"))
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("strategy_id"), F.col("ts").cast("timestamp").alias("timestamp"), pick.alias("to_state"),
        F.when(F.col("event_type") == "error", "").otherwise("desk").alias("actor"), F.col("event_type").alias("reason"))
    claimed = previous_value(events, ["strategy_id"], ["timestamp", "seq"], "to_state", F.date_trunc("day", "timestamp"), "claimed")
    events = claimed.withColumn("from_state", F.when(F.col("seq") % 9 == 0, "RESEARCH").otherwise(F.coalesce("claimed", F.lit("RESEARCH")))).drop("claimed")
    return D.invalid_transitions(events).select("seq", "from_state", "to_state", "error")


@register("result_row", f"""WITH {_UNITS}, {_STATUS}, z AS (SELECT *, CASE WHEN q%17=0 THEN 'CHECKER_ERROR' WHEN q%13=0 THEN 'FAILED_VALIDATION' ELSE 'SUCCESS' END AS run FROM st),
y AS (SELECT *, CASE WHEN run = 'SUCCESS' AND status <> 'FLAG_REVIEW' THEN CASE WHEN status = 'REJECTED' THEN 'REJECTED' ELSE 'APPROVED' END END AS decision FROM z)
SELECT id AS strategy_id, run AS status, decision, run = 'SUCCESS' AND status = 'FLAG_REVIEW' AS review_required, run = 'SUCCESS' AND status = 'APPROVED_CANDIDATE' AND q%2=0 AS deployable,
  CASE WHEN run = 'SUCCESS' THEN (q%37-5)/10.0 END::DOUBLE AS sharpe,
  CASE WHEN run <> 'SUCCESS' THEN run WHEN status = 'FLAG_REVIEW' THEN 'FLAG_REVIEW' WHEN decision = 'APPROVED' THEN 'APPROVED_CANDIDATE' ELSE 'REJECTED' END AS state FROM y""")
def result_row(spark, folder):
    q = F.col("q")
    rows = D.gate_status(strategies(spark, folder)).withColumn("gate_status", F.col("status")).withColumns({
        "status": F.when(q % 17 == 0, "CHECKER_ERROR").when(q % 13 == 0, "FAILED_VALIDATION").otherwise("SUCCESS"), "deployable": q % 2 == 0,
        "metrics": F.struct(F.col("sharpe_mean").alias("sharpe"), F.col("max_dd_oos").alias("drawdown")), "max_sensible": F.lit(100000.0)})
    return D.result_rows(rows).select("strategy_id", "status", "decision", "review_required", "deployable", F.col("metrics.sharpe").alias("sharpe"), "state")


@register("run_fingerprint", """WITH k AS (SELECT *, sha256(l_orderkey||'|'||l_linenumber||'|'||l_quantity::INT) AS k FROM lineitem),
h AS (SELECT p_brand AS strategy_id, count(*) AS n, sum(('0x'||substr(k,1,15))::BIGINT::HUGEINT) AS x, sum(('0x'||substr(k,16,15))::BIGINT::HUGEINT) AS y
  FROM k JOIN part ON l_partkey=p_partkey GROUP BY 1),
i AS (SELECT strategy_id, sha256(n||':'||x||':'||y) AS input_sha256, sha256('{"n_sides":3,"signal":"momentum_7"}') AS config_sha256 FROM h)
SELECT strategy_id, input_sha256, config_sha256, sha256(input_sha256||'|'||config_sha256||'|'||strategy_id) AS run_id FROM i""")
def fingerprint(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("strategy_id")), "l_partkey")
    text = lines.select("strategy_id", F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("row"))
    return run_fingerprint(text, "strategy_id", "row", {"n_sides": 3, "signal": "momentum_7"})


SEARCH = {"candidates": ("momentum_7", "low_vol_14", "carry"), "n_sides": (3,), "vol_target": 0.02, "min_train_days": 730, "test_days": 360,
          "delist_mode": "forced_exit", "rebalance_every": 5}


@register("deployment_decision")
def deployment_decision(spark, folder):
    """Walk-forward, splits, stress, research, regimes and deflation of one panel, as gate rows."""
    panel = stored_market(spark, folder)
    found = deployment(panel, materialise(build_signals(panel)), **SEARCH)
    return found.gates.select(F.explode("gates").alias("gate", "passed"), "deployable")


@register("panel_check")
def panel_check(spark, folder):
    """The whole check of the market panel, with cross-validation, as its result row."""
    rows = market_panel(spark, folder).withColumn("ingest_seq", F.lit(0))
    row = check_panel(rows, "market", final=True, step_seconds=7 * 86400, cv_groups=6, **SEARCH)
    return row.select("strategy_id", "status", "gate_status", "decision", "review_required", "deployable", "state", F.array_join("reasons", ",").alias("reasons"),
                      F.array_join("errors", ",").alias("errors"), "metrics.*", "max_sensible")
