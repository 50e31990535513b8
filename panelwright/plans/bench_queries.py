"""Heavy queries on the supplier panel (asset count grows with the data)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SIGNAL_CANDIDATES, STD_FLOOR
from ..operators import walkforward as W
from ..operators.factors import folded_signals
from ..operators.stats import MIN_IC_BARS, ic_table, panel_ic, with_next_return
from ..session import materialise
from .panels import supplier_panel
from .registry import ALL_FACTORS, SUPPLIER_WEEK, q_day, q_round, register, rounded, with_
from .stats_queries import _ICS, _LONG, _NEXT

_FACTORS = ALL_FACTORS.replace("'BTCUSDT'", "'1'")


def supplier_factors(spark, folder):
    """All factors of the supplier panel; supplier 1 is the benchmark."""
    return folded_signals(materialise(supplier_panel(spark, folder)), benchmark="1")


@register("supplier_signals", with_(SUPPLIER_WEEK, _FACTORS) + f"SELECT {q_day('ts')} AS bar, asset, {', '.join(f'{q_round(c, 12)} AS {c}' for c in SIGNAL_CANDIDATES)} FROM allfac")
def supplier_signals(spark, folder):
    # Factors are rounded to ten digits or twelve already, which rounding to twelve leaves as they are.
    return supplier_factors(spark, folder).select(F.col("timestamp").cast("date").cast("string").alias("bar"), "asset", *SIGNAL_CANDIDATES)


@register("supplier_rank_ic", with_(SUPPLIER_WEEK, _FACTORS, _NEXT, _LONG, _ICS) + f"""SELECT signal, CASE WHEN n >= {MIN_IC_BARS} THEN {q_round('m')} END AS ic_mean,
  CASE WHEN n >= {MIN_IC_BARS} THEN {q_round('sd')} END AS ic_std, CASE WHEN n >= {MIN_IC_BARS} AND sd >= {STD_FLOOR} THEN {q_round('t')} END AS ic_tstat,
  n::BIGINT AS ic_days FROM ictab""")
def supplier_rank_ic(spark, folder):
    panel = materialise(supplier_panel(spark, folder).select("timestamp", "asset", "price", "funding_rate"))
    t = ic_table(panel_ic(folded_signals(with_next_return(panel), benchmark="1"), SIGNAL_CANDIDATES))
    return t.select("signal", rounded("ic_mean"), rounded("ic_std"), rounded("ic_tstat"), "ic_days")


def full_search(spark, folder) -> W.WalkForward:
    """15 signals x 3 sizes x 2 volatility targets over all folds, with two stressed cost levels."""
    return W.WalkForward(supplier_factors(spark, folder), SIGNAL_CANDIDATES, (2, 3, 4), (0.0, 0.05), min_train_days=730, test_days=360,
                         delist_mode="forced_exit", rebalance_every=5)


@register("supplier_search")
def supplier_search(spark, folder):
    r = full_search(spark, folder).fold_results
    return r.select("fold", "signal", F.col("n_long").alias("n"), "vol_target", rounded("sharpe"), rounded("train_return"), rounded("test_return"))
