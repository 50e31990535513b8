"""Registration of queries with their SQL, and the shared shapes of both sides.

Results that go to a comparison carry calendar days as text, counts as BIGINT and measures rounded
after all arithmetic, so that sums taken in another order compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.numeric import col_of
from .panels import FIXTURE_MIGRATIONS, OVERLAP_DAYS, SYMBOL_OF_BRAND

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def day(column="timestamp", name: str = "bar") -> Column:
    return F.date_format(col_of(column), "yyyy-MM-dd").alias(name)


def rounded(column, digits: int = 6, name: str | None = None) -> Column:
    alias = name or (column if isinstance(column, str) else None)
    out = F.round(col_of(column).cast("double"), digits) + F.lit(0.0)
    return out.alias(alias) if alias else out


def count(column, name: str | None = None) -> Column:
    alias = name or (column if isinstance(column, str) else None)
    out = col_of(column).cast("bigint")
    return out.alias(alias) if alias else out


# --- SQL side --------------------------------------------------------------------------------

def q_round(expr: str, digits: int = 6) -> str:
    return f"(CASE WHEN round({expr},{digits})=0 THEN 0.0::DOUBLE ELSE round({expr},{digits})::DOUBLE END)"


def q_day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _panel_sql(name: str, asset: str, unit: str, source: str) -> str:
    return f"""{name} AS (
  SELECT date_trunc('{unit}', l_shipdate)::TIMESTAMP AS ts, {asset} AS asset,
         round(100*(1+avg(l_discount)),8) AS price, sum(l_quantity) AS volume,
         round(sum(l_extendedprice),2) AS quote_volume, round((avg(l_tax)-0.04)/100,10) AS funding_rate
  FROM {source} GROUP BY 1,2)"""


_NAMED = " ".join(f"WHEN '{b}' THEN '{s}'" for b, s in SYMBOL_OF_BRAND.items())
_SYMBOL = f"CASE p_brand {_NAMED} ELSE upper(replace(p_brand,'#',''))||'USDT' END"
_JOINED = "lineitem JOIN part ON l_partkey=p_partkey"

BRAND_WEEK = _panel_sql("panel", "p_brand", "week", _JOINED)
BRAND_DAY = _panel_sql("panel", "p_brand", "day", _JOINED)
SUPPLIER_WEEK = _panel_sql("panel", "l_suppkey::VARCHAR", "week", "lineitem")
MARKET = _panel_sql("panel", _SYMBOL, "week", _JOINED)
MARKET_DAY = _panel_sql("panel", _SYMBOL, "day", _JOINED)
USER_DAY = """panel AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS ts, user_id::VARCHAR AS asset, round(avg(value)+1,8) AS price,
         count(*)::DOUBLE AS volume FROM events GROUP BY 1,2)"""

_ROWS = ", ".join(
    f"('{s}','{c}',{'NULL' if f is None else f}::DOUBLE,{'NULL' if e is None else repr(e)}::TIMESTAMP)"
    for s, c, f, e in FIXTURE_MIGRATIONS)
MIGRATION_DIM = f"mig(source, canonical, factor, effective) AS (VALUES {_ROWS})"
_FEED_COLUMNS = "ts, volume, quote_volume, CASE WHEN volume % 7 = 3 THEN NULL ELSE funding_rate END AS funding_rate"
FEED = f"""{MIGRATION_DIM},
feed AS (
  SELECT {_FEED_COLUMNS}, m.source||'USDT' AS asset, price*factor AS price, 0 AS ingest_seq
  FROM panel JOIN mig m ON asset = m.canonical||'USDT' AND ts < effective + INTERVAL {OVERLAP_DAYS} DAY
  UNION ALL
  SELECT {_FEED_COLUMNS}, asset, price, 1 FROM panel LEFT JOIN mig m ON asset = m.canonical||'USDT'
  WHERE effective IS NULL OR ts >= effective)"""
CANON = """named AS (
  SELECT f.*, f.asset AS source_asset,
         regexp_replace(upper(f.asset), '(USDT|USDC|BUSD|BTC|ETH)$', '') AS base,
         regexp_extract(upper(f.asset), '(USDT|USDC|BUSD|BTC|ETH)$', 1) AS quote FROM feed f),
canon AS (
  SELECT n.* EXCLUDE (asset, base, quote, price), coalesce(m.canonical, n.base)||n.quote AS asset,
         CASE WHEN m.factor IS NOT NULL AND n.ts < m.effective THEN n.price/m.factor ELSE n.price END AS price,
         CASE WHEN m.factor IS NOT NULL AND n.ts < m.effective THEN m.factor ELSE 1.0::DOUBLE END AS price_adjustment_factor
  FROM named n LEFT JOIN mig m ON m.source = n.base)"""
COLLAPSED = """clean AS (
  SELECT ts, asset, arg_max(price, ingest_seq) AS price, arg_max(volume, ingest_seq) AS volume,
         arg_max(quote_volume, ingest_seq) AS quote_volume, arg_max(source_asset, ingest_seq) AS source_asset,
         arg_max(price_adjustment_factor, ingest_seq) AS price_adjustment_factor,
         sum(coalesce(funding_rate,0)) AS funding_rate FROM canon GROUP BY 1,2)"""

RETURNS = """ret AS (SELECT *, price/lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM panel)"""


def _frame(k):
    return f"OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _price_factor_columns():
    out = []
    for k in (7, 14, 30):
        f = _frame(k)
        full, sd = f"count(r) {f} = {k}", f"stddev_samp(r) {f}"
        out.append(f"CASE WHEN {full} THEN round(sum(r) {f},10) END AS momentum_{k}")
        out.append(f"CASE WHEN {full} AND {sd} >= 1e-12 THEN round(sum(r) {f} / {sd},10) END AS vol_adj_momentum_{k}")
        out.append(f"CASE WHEN {full} THEN round(-({sd}),10) END AS low_vol_{k}")
    f = _frame(14)
    out.append("round(-lag(r) OVER (PARTITION BY asset ORDER BY ts),10) AS reversal_1")
    lagged = "lag(funding_rate) OVER (PARTITION BY asset ORDER BY ts)"
    out.append(f"round(-{lagged},10) AS carry")
    out.append(f"CASE WHEN count(funding_rate) {f} = 14 THEN round(-({lagged} - avg(funding_rate) {f}),12) END AS funding_surprise")
    out.append(f"CASE WHEN count(r) {f} = 14 AND stddev_samp(r) {f} >= 1e-12 THEN round(-{lagged} / stddev_samp(r) {f},10) END AS vol_adj_carry")
    return ",\n  ".join(out)


FACTORS = f"""{RETURNS},
fac AS (SELECT *,
  {_price_factor_columns()}
  FROM ret)"""


def residual_sql(k: int) -> str:
    """The definition on the dense grid, which the Spark side never builds."""
    w = f"OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"""grid_{k} AS (
  SELECT t.ts, a.asset, p.r, b.r AS m, row_number() OVER (PARTITION BY a.asset ORDER BY t.ts) - 1 AS i
  FROM (SELECT DISTINCT ts FROM ret) t CROSS JOIN (SELECT DISTINCT asset FROM ret) a
  LEFT JOIN ret p ON p.ts=t.ts AND p.asset=a.asset
  LEFT JOIN ret b ON b.ts=t.ts AND b.asset='BTCUSDT'),
fit_{k} AS (
  SELECT ts, asset, i, CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) {w} = {k}
    AND var_samp(m) {w} <> 0 THEN -(sum(r) {w} - covar_samp(r,m) {w}/var_samp(m) {w}*sum(m) {w}) END AS v FROM grid_{k}),
res_{k} AS (
  SELECT ts, asset, CASE WHEN asset='BTCUSDT' THEN CASE WHEN i >= {k} THEN 0.0 END
    ELSE round(lag(v) OVER (PARTITION BY asset ORDER BY ts),10) END AS resid_reversal_{k} FROM fit_{k})"""


def z_sql(column: str) -> str:
    spread = f"stddev_pop({column}) OVER (PARTITION BY ts)"
    return f"CASE WHEN {spread} < 1e-12 THEN 0.0 ELSE ({column} - avg({column}) OVER (PARTITION BY ts)) / {spread} END"


ALL_FACTORS = f"""{FACTORS},
{residual_sql(14)},
{residual_sql(30)},
allfac AS (
  SELECT f.*, r14.resid_reversal_14, r30.resid_reversal_30,
    round({z_sql('vol_adj_carry')} + {z_sql('vol_adj_momentum_14')},10) AS carry_mom_z,
    round({z_sql('vol_adj_carry')} + {z_sql('low_vol_14')},10) AS carry_lowvol_z
  FROM fac f JOIN res_14 r14 USING (ts, asset) JOIN res_30 r30 USING (ts, asset))"""


def exec_sql(signal: str = "momentum_7", source: str = "fac", thin: int | None = None) -> str:
    """Ranked rows of one signal, one bar late, with bar numbers."""
    cut = f" WHERE ts IN (SELECT ts FROM xl GROUP BY ts HAVING count(*) >= {thin})" if thin else ""
    return f"""xl AS (
  SELECT ts, asset, price, funding_rate, quote_volume, lag({signal}) OVER (PARTITION BY asset ORDER BY ts) AS sig
  FROM {source} WHERE {signal} IS NOT NULL QUALIFY sig IS NOT NULL),
x0 AS (SELECT * FROM xl{cut}),
bars AS (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS idx, lead(ts) OVER (ORDER BY ts) AS next_ts
  FROM (SELECT DISTINCT ts FROM x0)),
xs AS (SELECT x0.*, bars.idx FROM x0 JOIN bars USING (ts)),
legs AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sig DESC, asset) AS up,
  row_number() OVER (PARTITION BY idx ORDER BY sig, asset DESC) AS dn FROM xs)"""


def book_sql(n: int = 3, every: int = 5) -> str:
    """Holdings by counting presence since the last rebalance, and moves by a full join."""
    return f"""pos AS (
  SELECT l.idx AS entry, b.idx, b.ts, b.next_ts, l.asset, CASE WHEN l.up <= {n} THEN 1.0/{n} ELSE -1.0/{n} END AS u
  FROM legs l JOIN bars b ON b.idx BETWEEN l.idx AND l.idx + {every - 1}
  WHERE l.idx % {every} = 0 AND (l.up <= {n} OR l.dn <= {n})
    AND (SELECT count(*) FROM xs p WHERE p.asset=l.asset AND p.idx > l.idx AND p.idx <= b.idx) = b.idx - l.idx),
mv AS (
  SELECT coalesce(n.idx, p.idx+1) AS idx, coalesce(n.asset, p.asset) AS asset, coalesce(n.u,0) AS un, coalesce(p.u,0) AS up
  FROM pos n FULL JOIN pos p ON n.idx = p.idx+1 AND n.asset = p.asset
  WHERE coalesce(n.idx, p.idx+1) <= (SELECT max(idx) FROM bars)),
mvp AS (
  SELECT mv.*, bars.ts, a.price, a.price/b.price-1 AS r, a.funding_rate, a.quote_volume
  FROM mv JOIN bars USING (idx) LEFT JOIN xs a ON a.idx=mv.idx AND a.asset=mv.asset
  LEFT JOIN xs b ON b.idx=mv.idx-1 AND b.asset=mv.asset)"""


def equity_sql(fee: float = 0.0004, slip: float = 0.0005, gross: float = 2.0, start: float = 100000.0) -> str:
    half = gross / 2
    return f"""bar AS (
  SELECT idx, ts, {half}*sum(up*coalesce(r,0)) AS pr, -{half}*sum(up*coalesce(funding_rate,0)) AS fr,
         {half}*sum(abs(un-up)) AS turnover FROM mvp GROUP BY 1,2),
ret_bar AS (SELECT *, turnover*{fee} AS fee_r, turnover*{slip} AS slip_r, pr+fr-turnover*{fee}-turnover*{slip} AS ret FROM bar),
grow AS (SELECT *, product(1+ret) OVER (ORDER BY idx) AS g FROM ret_bar),
eq AS (SELECT *, {start}*g AS equity, {start}*coalesce(lag(g) OVER (ORDER BY idx),1) AS equity_before FROM grow),
curve AS (SELECT *, equity/greatest({start}, max(equity) OVER (ORDER BY idx)) - 1 AS drawdown FROM eq)"""


def sliced_sql(p: str, source: str, every: int = 5, fee: str = "0.0004", slip: str = "0.0005") -> str:
    """Books of many slices at once: ``source`` has k (slice), n, ts, asset, price, funding_rate,
    quote_volume and a non-null s. Ends in {p}_curve with one row per slice and bar."""
    return f"""{p}_xl AS (SELECT *, lag(s) OVER (PARTITION BY k, asset ORDER BY ts) AS sig FROM {source} QUALIFY sig IS NOT NULL),
{p}_bars AS (SELECT k, ts, row_number() OVER (PARTITION BY k ORDER BY ts)-1 AS idx FROM (SELECT DISTINCT k, ts FROM {p}_xl)),
{p}_xs AS (SELECT x.*, b.idx, b.idx - row_number() OVER (PARTITION BY x.k, x.asset ORDER BY x.ts) AS isl FROM {p}_xl x JOIN {p}_bars b USING (k, ts)),
{p}_pres AS (SELECT *, max(idx) OVER (PARTITION BY k, asset, isl) AS last_idx FROM {p}_xs),
{p}_legs AS (SELECT *, row_number() OVER (PARTITION BY k, idx ORDER BY sig DESC, asset) AS up,
  row_number() OVER (PARTITION BY k, idx ORDER BY sig, asset DESC) AS dn, count(*) OVER (PARTITION BY k, idx) AS ranked FROM {p}_pres),
{p}_thin AS (SELECT DISTINCT k, ts FROM {p}_legs WHERE ranked < 2*n),
{p}_pos AS (SELECT l.k, b.idx, b.ts, l.asset, CASE WHEN l.up <= l.n THEN 1.0/l.n ELSE -1.0/l.n END AS u
  FROM {p}_legs l JOIN {p}_bars b ON b.k = l.k AND b.idx BETWEEN l.idx AND least(l.idx + {every - 1}, l.last_idx)
  WHERE l.idx % {every} = 0 AND (l.up <= l.n OR l.dn <= l.n)),
{p}_mv AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.idx, b.idx+1) AS idx, coalesce(a.asset, b.asset) AS asset, coalesce(a.u,0) AS un, coalesce(b.u,0) AS ub
  FROM {p}_pos a FULL JOIN {p}_pos b ON a.k = b.k AND a.idx = b.idx+1 AND a.asset = b.asset),
{p}_bar AS (SELECT m.k, m.idx, t.ts, sum(ub*coalesce(x.price/y.price-1,0)) AS pr, -sum(ub*coalesce(x.funding_rate,0)) AS fr, sum(abs(un-ub)) AS turnover
  FROM {p}_mv m JOIN {p}_bars t ON t.k=m.k AND t.idx=m.idx LEFT JOIN {p}_xs x ON x.k=m.k AND x.idx=m.idx AND x.asset=m.asset
  LEFT JOIN {p}_xs y ON y.k=m.k AND y.idx=m.idx-1 AND y.asset=m.asset GROUP BY 1,2,3),
{p}_ret AS (SELECT *, pr+fr-turnover*{fee}-turnover*{slip} AS ret FROM {p}_bar),
{p}_curve AS (SELECT *, 100000.0*g AS equity, 100000.0*coalesce(lag(g) OVER (PARTITION BY k ORDER BY idx),1) AS equity_before,
  g/greatest(1.0, max(g) OVER (PARTITION BY k ORDER BY idx)) - 1 AS drawdown
  FROM (SELECT *, product(1+ret) OVER (PARTITION BY k ORDER BY idx) AS g FROM {p}_ret))"""


PPY = "(365.25*86400.0/604800.0)"


def summary_sql(curve: str, where: str = "true") -> str:
    """Run summary per slice of a curve on weekly bars."""
    act = "FILTER (idx > 0)"
    return f"""SELECT k, arg_max(equity, idx) AS final_equity, arg_max(equity, idx)/100000.0 - 1 AS total_return, count(*) {act} AS periods,
  power(arg_max(equity, idx)/100000.0, {PPY}/greatest(count(*) {act},1)) - 1 AS annualized_return,
  stddev_samp(ret) {act} * sqrt({PPY}) AS annualized_volatility, avg(ret) {act} / stddev_samp(ret) {act} * sqrt({PPY}) AS sharpe,
  min(drawdown) AS max_drawdown, count(*) FILTER (idx > 0 AND ret > 0) AS winning_periods, count(*) FILTER (idx > 0 AND ret < 0) AS losing_periods,
  sum(turnover*0.0004*equity_before) AS total_fees, sum(turnover*0.0005*equity_before) AS total_slippage,
  sum(pr*equity_before) AS price_pnl, sum(fr*equity_before) AS funding_pnl, avg(turnover) {act} AS average_turnover
  FROM {curve} WHERE {where} GROUP BY k"""


def q_cdf(x: str, steps: int = 400) -> str:
    """Normal distribution function by Simpson's rule from 0 to x."""
    weight = f"CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END"
    return f"(0.5 + ({x})/{steps}/3/sqrt(2*pi())*list_sum(list_transform(range(0,{steps + 1}), lambda i: ({weight})*exp(-power(({x})*i/{steps}.0,2)/2))))"


def q_quantile(name: str, p: str) -> str:
    """CTE {name}(x): the normal quantile of ``p`` (above one half) by bisection."""
    return f"""{name}_walk(k, lo, hi, p) AS (SELECT 0, 0.0::DOUBLE, 8.0::DOUBLE, ({p})::DOUBLE UNION ALL
  SELECT k+1, CASE WHEN c < p THEN (lo+hi)/2 ELSE lo END, CASE WHEN c < p THEN hi ELSE (lo+hi)/2 END, p
  FROM (SELECT *, {q_cdf('(lo+hi)/2')} AS c FROM {name}_walk) WHERE k < 45),
{name}(x) AS (SELECT (lo+hi)/2 FROM {name}_walk WHERE k = 45)"""
