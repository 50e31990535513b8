"""Fixed values that decide results: word lists, thresholds and default levels."""

from __future__ import annotations

# Quote currencies recognised at the end of a symbol, first match wins.
QUOTE_SUFFIXES = ("USDT", "USDC", "BUSD", "BTC", "ETH")

# Ticker migrations as (source, canonical, price factor, effective instant in UTC).
MIGRATIONS = (
    ("GAL", "G", 60.0, "2024-07-19 08:00:00"),
    ("OMNI", "NOM", 75.0, "2025-10-01 08:00:00"),
    ("MATIC", "POL", 1.0, "2024-09-13 10:00:00"),
    ("NANO", "XNO", 1.0, "2022-01-28 04:00:00"),
    ("VEN", "VET", 100.0, "2018-07-25 04:00:00"),
    ("BCC", "BCH", None, None),
    ("ANTOLD", "ANT", None, None),
)

# The factor columns a search may rank on, in order of preference on ties.
SIGNAL_CANDIDATES = (
    "reversal_1", "momentum_7", "momentum_14", "momentum_30",
    "vol_adj_momentum_14", "vol_adj_momentum_30", "carry",
    "resid_reversal_14", "resid_reversal_30", "low_vol_14", "low_vol_30",
    "funding_surprise", "vol_adj_carry", "carry_mom_z", "carry_lowvol_z",
)

# Fixed values: (fee, slippage) levels of the cost stress, and the two used inside walk-forward.
COST_STRESS_TIERS = ((0.0004, 0.0005), (0.0008, 0.001), (0.0012, 0.002), (0.0008, 0.002), (0.0015, 0.004))
WALK_FORWARD_STRESS = ((0.0008, 0.001), (0.0015, 0.002))

# Capital levels of the capacity curve.
AUM_LEVELS = (10_000.0, 100_000.0, 1_000_000.0, 10_000_000.0)

# Gates that alone decide deployability.
HARD_GATES = ("wf_positive", "oos_positive", "no_risk_violations", "no_capacity_violations", "reality_check_pass")

# Allowed strategy state changes.
STATE_EDGES = (
    ("RESEARCH", "REJECTED"), ("RESEARCH", "FLAG_REVIEW"), ("RESEARCH", "APPROVED_CANDIDATE"),
    ("RESEARCH", "FAILED_VALIDATION"), ("RESEARCH", "CHECKER_ERROR"),
    ("FLAG_REVIEW", "REJECTED"), ("FLAG_REVIEW", "APPROVED_CANDIDATE"),
    ("APPROVED_CANDIDATE", "REJECTED"), ("APPROVED_CANDIDATE", "APPROVED_PAPER"),
    ("APPROVED_PAPER", "REJECTED"), ("APPROVED_PAPER", "APPROVED_LIVE"),
    ("REJECTED", "RESEARCH"), ("APPROVED_LIVE", "REJECTED"),
)

# Bar widths in seconds with a conventional number of periods per year.
BAR_YEARS = ((86400.0, 365.0), (14400.0, 2190.0), (3600.0, 8760.0))

# Reasons for missing funding that need no investigation.
EXPECTED_FUNDING_REASONS = ("not_listed", "delisted", "migration")

EULER_GAMMA = 0.5772156649015329
MIGRATION_WINDOW_DAYS = 7
# A standard deviation below this is a constant series up to rounding.
STD_FLOOR = 1e-12
