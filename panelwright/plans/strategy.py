"""One call from raw rows to the tables of a long/short strategy, with every refusal in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.symbols import migration_table
from ..operators import audit as Q
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators.ranking import lag_for_execution, liquidity_percentile, tier_rates
from ..session import materialise, refuse


@dataclass
class StrategyResult:
    """Lazy tables of one strategy run."""

    book: B.Backtest
    violations: DataFrame
    funding_gaps: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        positions = self.book.positions
        return {
            "ranking": B.run_ranking(positions), "exposure": B.run_exposure(positions), "positions": positions, "trades": self.book.trades,
            "pnl": self.book.returns, "turnover": self.book.returns.select("run_id", "timestamp", "turnover"), "violations": self.violations,
            "capacity": self.violations.where("type = 'capacity_limit'"), "funding_gaps": self.funding_gaps,
            "funding_warnings": self.funding_gaps.where("reason = 'active'"), "metrics": self.book.summary,
        }


def run_strategy(df: DataFrame, signal: str = "signal", *, migrations: DataFrame | None = None, smooth: int = 1, liquidity: str | None = None,
                 tiers=None, spreads: DataFrame | None = None, delist_mode: str = "error", require_funding: bool = False, enforce_limits: bool = False,
                 strict: bool = True, **settings) -> StrategyResult:
    """Canonicalise, lag, rank, hold and account. ``settings`` are book and run settings.

    With ``strict`` the run is refused on source collisions, invalid rows, bars too thin to rank and,
    unless ``delist_mode`` is ``forced_exit``, held assets without a price.
    """
    spark = df.sparkSession
    if delist_mode not in ("error", "forced_exit"):
        raise ValueError("delist_mode is 'error' or 'forced_exit'")
    if tiers:
        levels = [t[0] for t in tiers]
        if any(not 0 <= t[0] < 1 or t[1] < 0 or t[2] < 0 for t in tiers) or levels != sorted(set(levels), reverse=True):
            raise ValueError("liquidity tiers need unique thresholds in [0, 1), descending, and rates of at least 0")
    if require_funding and "funding_rate" not in df.columns:
        raise ValueError("this strategy needs a funding_rate column")
    dim = migrations if migrations is not None else migration_table(spark)
    rows = df if "ingest_seq" in df.columns else df.withColumn("ingest_seq", F.monotonically_increasing_id())
    raw = materialise(P.ingest(rows))
    if strict:
        refuse(Q.collisions(P.canonical_assets(raw, dim)), "several source tickers feed one asset at one bar")
    gaps = Q.funding_gaps(raw, dim)
    panel = P.canonical_panel(raw, dim).withColumn("series", F.lit("strategy")).withColumn("sig", F.col(signal))
    tiered = bool(tiers and liquidity and liquidity in df.columns)
    rows = lag_for_execution(panel, ["series"], smooth)
    if "funding_rate" in rows.columns:
        rows = rows.fillna(0.0, ["funding_rate"])
    if tiered:
        rows = tier_rates(liquidity_percentile(rows, liquidity, keys=["series"]), tiers, spreads)
    rows = materialise(rows)
    if strict:
        if rows.isEmpty():
            raise ValueError("no executable signals: the one-bar lag needs at least two bars per asset")
        refuse(P.panel_violations(rows, "sig").where("violations > 0"), "invalid rows")
    grid = B.run_grid(spark, **{"series": "strategy", "tiered": tiered, **settings})
    refuse(grid.where(~B.valid_run()), "invalid settings")
    config = grid.withColumns({"book_id": F.lit("strategy"), "run_id": F.lit("strategy")})
    sides = settings.get("n_long", B.BOOK_DEFAULTS["n_long"]) + settings.get("n_short", B.BOOK_DEFAULTS["n_short"])
    book = B.Backtest(B.prepare_series(rows, ["series"], liquidity if tiered else None), config.select("book_id", "series", *B.BOOK_DEFAULTS),
                      config.select("run_id", "book_id", *B.RUN_DEFAULTS), ["series"], sides)
    if strict:
        refuse(book.refusals(delist_mode).select("error", F.col("timestamp").cast("string")).orderBy("timestamp"), "the book cannot be run")
    invalid = rows.where(F.coalesce(~(F.col(liquidity) > 0), F.lit(True))).withColumn("run_id", F.lit("strategy")) if tiered else None
    breaches = B.violations(book.returns, book.trades, book.exits, book.runs, invalid, liquidity if tiered else None)
    if enforce_limits:
        refuse(breaches.select(F.col("timestamp").cast("string"), "type").orderBy("timestamp"), "risk limit breached")
    return StrategyResult(book, breaches, gaps)
