"""The correctness oracle: each query of ``plans.queries`` as DuckDB SQL.

The SQL is written from the reference's semantics, not from our Spark plans:
window formulations where we use aggregates (``row_number`` instead of
``min_by`` / ``max_by``), a recursive fold where we use a closed form, a
relational join where we build and explode arrays.  Tables ``orders``,
``lineitem``, ``events`` and ``customer`` are views over the same parquet.

Portability rules (Spark 4 vs DuckDB): ``x / nullif(y, 0)`` for
``try_divide``; ``isodow(d) >= 6`` for ``dayofweek(d) IN (1, 7)``; explicit
NULLS FIRST / LAST; doubles rounded at the edge with the same two-step rule
as ``functions.columns.edge_round``.
"""

from __future__ import annotations

from stakeperf.config import LedgerConfig, active_assets
from stakeperf.sources.fixtures import LEDGER_END, LEDGER_START, PRICES_END, PRICES_START, PRIORITY_SYMBOL


def R(x: str) -> str:
    """Nine significant digits (see ``edge_round``): nine decimals and twelve
    digits first, then by a power of ten, half away from zero."""
    z = f"CAST(printf('%.11e', CAST(CAST({x} AS DECIMAL(38,9)) AS DOUBLE)) AS DOUBLE)"
    k = "(8 - floor(log10(abs(z))))"
    return (f"(SELECT CASE WHEN z = 0 THEN 0.0 WHEN {k} >= 0 THEN round(z * pow(10, {k})) / pow(10, {k}) + 0.0 "
            f"ELSE round(z / pow(10, -{k})) * pow(10, -{k}) + 0.0 END FROM (SELECT {z} AS z))")


def NEXT(d: str) -> str:
    return f"({d} + CASE isodow({d}) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)"


def PREV(d: str) -> str:
    return f"({d} - CASE isodow({d}) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END)"


def WEEKEND(d: str) -> str:
    return f"(isodow({d}) >= 6)"


def MONEY(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def TEXT(x: str) -> str:
    """R toString of a number: all digits in plain notation.  DuckDB's own
    text; where that has an exponent, its digits shifted by hand."""
    v = f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"
    d = f"replace(replace(split_part({v}, 'e', 1), '.', ''), '-', '')"
    e = f"CAST(split_part({v}, 'e', 2) AS INTEGER)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    plain = rf"regexp_replace(regexp_replace({v}, '\.0*$', ''), '^-0$', '0')"
    return (f"coalesce(CASE WHEN {v} NOT LIKE '%e%' THEN {plain} WHEN {e} < 0 THEN {sign} || '0.' || repeat('0', -{e} - 1) || rtrim({d}, '0') "
            f"ELSE {sign} || rpad({d}, CAST(greatest({e} + 1, length({d})) AS INTEGER), '0') END, '')")


STAKING_START, STAKING_END = LedgerConfig().start.isoformat(), LedgerConfig().end.isoformat()
ASSETS = active_assets()
ASSET_COLS = [a.column for a in ASSETS]
SYMBOL_VALUES = ", ".join(f"('{a.symbol}')" for a in ASSETS)
PRIORITY_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_SYMBOL.items())
MODEL = "'m' || CAST({} % 21 AS VARCHAR)"

# name -> (dependencies, SQL body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTE[name] = (deps, body)


# ------------------------------------------------------------- fixtures
cte("fx_scores", (), f"""
  SELECT {MODEL.format('user_id')} AS model_name,
         user_id // 21 AS roundNumber,
         event_id AS seq,
         CASE event_type WHEN 'view' THEN 'mmc' WHEN 'click' THEN 'fnc_v4' ELSE event_type END AS displayName,
         CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE CAST(day(ts) AS VARCHAR) END AS day,
         CASE WHEN event_id % 53 <> 0 THEN round(value - 50, 2) + 0.0 END AS payoutPending,
         CAST(event_id % 37 AS DOUBLE) AS atRisk
  FROM events""")

cte("flat", (), f"""
  SELECT {MODEL.format('o.o_custkey')} AS model_name, o.o_orderkey AS roundNumber, o.o_totalprice AS atRisk,
         CASE WHEN l.l_orderkey IS NOT NULL THEN
           row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
             l.l_shipdate, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag) - 1 END AS seq,
         strftime(l.l_shipdate, '%Y-%m-%d %H:%M:%S') AS date,
         l.l_linenumber AS day,
         CASE l.l_returnflag WHEN 'A' THEN 'mmc' WHEN 'N' THEN 'fnc_v4' WHEN 'R' THEN 'other' END AS displayName,
         l.l_extendedprice AS payoutPending, l.l_quantity AS payoutSettled,
         l.l_discount / 7 AS percentile,
         CASE l.l_linenumber % 4 WHEN 0 THEN l.l_tax * 1e-12 WHEN 1 THEN l.l_tax * 1e28 ELSE l.l_tax / 3 END AS value
  FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")

cte("registry", (), f"""
  SELECT model_name, 'id-' || substr(md5(model_name), 1, 12) AS model_id
  FROM (SELECT DISTINCT {MODEL.format('c_custkey')} AS model_name FROM customer
        UNION SELECT 'm_none')""")

cte("scored_models", (), f"SELECT DISTINCT {MODEL.format('o_custkey')} AS model_name FROM orders")

cte("px_priced", (), f"""
  SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority {PRIORITY_CASE} END AS symbol,
         {MONEY('o_totalprice')} / count(*) AS price
  FROM orders GROUP BY ALL HAVING symbol IS NOT NULL""")

cte("fx_prices", ("px_priced",), f"""
  SELECT d.date, s.symbol, p.price
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d
  CROSS JOIN (VALUES {SYMBOL_VALUES}) s(symbol)
  LEFT JOIN px_priced p ON p.date = d.date AND p.symbol = s.symbol""")

cte("fx_token_prices", (), f"""
  SELECT CAST(ts AS DATE) AS date, 'NMR-USD' AS symbol, {MONEY('value')} / count(*) AS price
  FROM events WHERE event_type = 'purchase' GROUP BY 1""")

cte("fx_investments", (), f"""
  SELECT CAST(o_orderdate AS DATE) AS date,
         {MONEY("CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END")} AS GLDInv,
         {MONEY("CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END")} AS ETHInv,
         {MONEY("CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END")} AS NMRInv
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")

cte("fx_fixedincome", (), f"""
  SELECT CAST(l_shipdate AS DATE) AS date, {MONEY('l_extendedprice')} AS BondInv
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1""")

cte("fx_cash", (), f"""
  SELECT CAST(l_shipdate AS DATE) AS date, {MONEY('l_extendedprice')} AS Principal,
         {MONEY('l_tax')} AS Interest, -{MONEY('l_discount')} AS Adjustments
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")

# ------------------------------------------------------------- staking half
# D2 + F2: metric filter, casts (failures -> NULL), blank date -> NULL.
cte("scores", ("fx_scores",), """
  SELECT model_name, roundNumber, seq, displayName, nullif(trim(date), '') AS date,
         try_cast(day AS DOUBLE) AS day, payoutPending, atRisk
  FROM fx_scores WHERE displayName IN ('mmc', 'fnc_v4')""")

# One plain window per (model, round) -- the brute-force form of
# the blocked lag.
cte("ts0", ("scores",), """
  SELECT *, payoutPending / nullif(atRisk, 0) AS returns,
         row_number() OVER w AS _k,
         lag(payoutPending) OVER w AS _lp
  FROM scores
  WINDOW w AS (PARTITION BY model_name, roundNumber ORDER BY day ASC NULLS LAST, seq ASC)""")

cte("ts", ("ts0",), """
  SELECT model_name, roundNumber, seq, displayName, date, day, payoutPending, atRisk, returns,
         coalesce(CASE WHEN _k = 1 THEN payoutPending ELSE payoutPending - _lp END, 0.0) AS dailypayout,
         atRisk + payoutPending AS stakeandpayout,
         coalesce(CASE WHEN _k = 1 THEN 0.0 ELSE returns - lag(returns) OVER
           (PARTITION BY model_name, roundNumber ORDER BY day ASC NULLS LAST, seq ASC) END, 0.0) AS dailyrets
  FROM ts0""")

# A1-A3: per (model, date); walletestimate by ranking rows, the weighted
# return in the source's own form (weights first, then the sum).
cte("bd0", ("ts",), """
  SELECT *, date AS date_full, try_cast(substr(date, 1, 10) AS DATE) AS d,
         sum(stakeandpayout) OVER (PARTITION BY model_name, try_cast(substr(date, 1, 10) AS DATE)) AS _s,
         row_number() OVER (PARTITION BY model_name, try_cast(substr(date, 1, 10) AS DATE)
                            ORDER BY day ASC NULLS LAST, date ASC, roundNumber ASC, seq ASC) AS _k
  FROM ts WHERE try_cast(substr(date, 1, 10) AS DATE) IS NOT NULL""")

cte("bd1", ("bd0",), """
  SELECT model_name, d AS date,
         coalesce(sum(dailypayout), 0.0) AS totalpayout,
         coalesce(sum(atRisk), 0.0) AS cumstake,
         CASE WHEN count(day) = count(*) THEN max(CASE WHEN _k = 1 THEN atRisk END) END AS walletestimate,
         CASE WHEN max(_s) > 0 THEN coalesce(sum(stakeandpayout / _s * dailyrets), 0.0) ELSE 0.0 END AS NMRwtret
  FROM bd0 GROUP BY model_name, d""")

# Change from the previous date of the model, then the returns.
cte("bd", ("bd1",), """
  SELECT *, totalpayoutdailychg / nullif(cumstake, 0) AS "return",
         totalpayoutdailychg / nullif(walletestimate, 0) AS leveredreturn
  FROM (SELECT *, totalpayout - lag(totalpayout) OVER (PARTITION BY model_name ORDER BY date) AS totalpayoutdailychg
        FROM bd1)""")

# Weekend -> next weekday, then one weekday back; keep the latest
# source date per new date.
cte("bdb", ("bd",), f"""
  SELECT *, coalesce({PREV(f"CASE WHEN {WEEKEND('date')} THEN {NEXT('date')} ELSE date END")},
                     date - 1) AS new_date
  FROM bd""")

cte("bizbd", ("bdb",), """
  SELECT model_name, new_date AS date, totalpayout, cumstake, walletestimate, NMRwtret,
         totalpayoutdailychg, "return", leveredreturn
  FROM bdb
  QUALIFY row_number() OVER (PARTITION BY model_name, new_date ORDER BY date DESC) = 1""")

# Roll-up over models.
cte("allm", ("bizbd",), """
  SELECT *, totalpayoutdailychg / nullif(cumstake, 0) AS "return",
         totalpayoutdailychg / nullif(walletestimate, 0) AS leveredreturn
  FROM (SELECT date, coalesce(sum(totalpayout), 0.0) AS totalpayout, coalesce(sum(cumstake), 0.0) AS cumstake,
               coalesce(sum(walletestimate), 0.0) AS walletestimate,
               coalesce(sum(totalpayoutdailychg), 0.0) AS totalpayoutdailychg
        FROM bizbd GROUP BY date)""")

cte("tokpx", ("fx_token_prices",), f"""
  SELECT date, regexp_replace(symbol, '-USD', '') AS asset, price FROM fx_token_prices
  WHERE date BETWEEN DATE '{STAKING_START}' AND DATE '{STAKING_END}'
    AND regexp_replace(symbol, '-USD', '') IN
        (SELECT regexp_replace(symbol, '-USD', '') FROM fx_token_prices GROUP BY 1 HAVING count(price) > 0)""")

# The semi join first, then the lag over the matched dates.
cte("nmr", ("tokpx", "allm"), """
  SELECT date, price AS NMR,
         coalesce(price / nullif(lag(price) OVER (ORDER BY date), 0) - 1, 0.0) AS NMRreturn
  FROM tokpx WHERE asset = 'NMR' AND date IN (SELECT date FROM allm)""")

cte("allmc", ("allm", "nmr"), """
  SELECT a.*, n.NMR, n.NMRreturn, a."return" + n.NMRreturn AS return_currency,
         a.leveredreturn + n.NMRreturn AS leveredreturn_currency
  FROM allm a LEFT JOIN nmr n USING (date)""")

# Raw rows re-dated, last row per new date, fallback to the
# model's latest date - 1 (a direct ranking of raw rows, not the two-level
# summary the library uses).
cte("bts0", ("ts",), f"""
  SELECT *, date AS date_full, try_cast(substr(date, 1, 10) AS DATE) AS d0
  FROM ts WHERE try_cast(substr(date, 1, 10) AS DATE) IS NOT NULL""")

cte("bts1", ("bts0",), f"""
  SELECT *, {PREV(f"CASE WHEN {WEEKEND('d0')} THEN {NEXT('d0')} ELSE d0 END")} AS new_date FROM bts0""")

cte("bts", ("bts1",), """
  SELECT model_name, coalesce(new_date, max(new_date) OVER (PARTITION BY model_name) - 1) AS date,
         roundNumber, seq, displayName, day, payoutPending, atRisk, returns, dailypayout, stakeandpayout, dailyrets
  FROM (SELECT * FROM bts1
        QUALIFY row_number() OVER (PARTITION BY model_name, new_date
          ORDER BY date_full DESC, roundNumber DESC, (day IS NULL) DESC, day DESC, seq DESC) = 1)""")

cte("dagg", ("bts",), """
  SELECT model_name, date, coalesce(sum(payoutPending), 0.0) AS ts_totalpayout,
         coalesce(sum(dailypayout), 0.0) AS ts_totalpayoutdailychg
  FROM bts GROUP BY model_name, date""")

# Per-model cumulative balances; ``h`` routes models
# without per-round rows to the D12 formulas.
cte("cum_model", ("bizbd", "dagg", "nmr", "bts"), """
  SELECT *, cumbalance * NMR AS cumUSD, cumstakebalance * NMR AS cumstakeUSD
  FROM (
    SELECT b.model_name, b.date,
           coalesce(CASE WHEN h THEN coalesce(a.ts_totalpayout, b.totalpayout, 0.0) ELSE 0.0 END, 0.0) AS totalpayout,
           coalesce(b.cumstake, 0.0) AS cumstake,
           coalesce(b.walletestimate, 0.0) AS walletestimate,
           coalesce(b.NMRwtret, 0.0) AS NMRwtret,
           coalesce(CASE WHEN h THEN coalesce(a.ts_totalpayoutdailychg, b.totalpayoutdailychg, 0.0) ELSE 0.0 END, 0.0)
             AS totalpayoutdailychg,
           coalesce(CASE WHEN h THEN coalesce(a.ts_totalpayout, b.totalpayout, 0.0) + b.walletestimate
                         ELSE b.walletestimate END, 0.0) AS cumbalance,
           coalesce(CASE WHEN h THEN coalesce(a.ts_totalpayout, b.totalpayout, 0.0) + b.cumstake
                         ELSE b.cumstake END, 0.0) AS cumstakebalance,
           coalesce(n.NMR, 1.0) AS NMR
    FROM (SELECT *, model_name IN (SELECT model_name FROM bts) AS h FROM bizbd) b
    LEFT JOIN dagg a ON a.model_name = b.model_name AND a.date = b.date
    LEFT JOIN nmr n ON n.date = b.date)""")

cte("cum_missing", ("bizbd", "nmr"), """
  SELECT *, cumbalance * NMR AS cumUSD, cumstakebalance * NMR AS cumstakeUSD
  FROM (
    SELECT b.model_name, b.date, CAST(0 AS DOUBLE) AS totalpayout, coalesce(b.cumstake, 0.0) AS cumstake,
           coalesce(b.walletestimate, 0.0) AS walletestimate, coalesce(b.NMRwtret, 0.0) AS NMRwtret,
           CAST(0 AS DOUBLE) AS totalpayoutdailychg, coalesce(b.walletestimate, 0.0) AS cumbalance,
           coalesce(b.cumstake, 0.0) AS cumstakebalance, coalesce(n.NMR, 1.0) AS NMR
    FROM bizbd b LEFT JOIN nmr n ON n.date = b.date)""")

# The portfolio rows of the cumulative table.
cte("cum_port", ("allmc", "nmr"), """
  SELECT a.date, a.cumstake, a.walletestimate, CAST(0 AS DOUBLE) AS cumbalance, CAST(0 AS DOUBLE) AS cumstakebalance,
         coalesce(n.NMR, 1.0) AS NMR, CAST(0 AS DOUBLE) * coalesce(n.NMR, 1.0) AS cumUSD, CAST(0 AS DOUBLE) * coalesce(n.NMR, 1.0) AS cumstakeUSD
  FROM allmc a LEFT JOIN nmr n ON n.date = a.date""")

# ------------------------------------------------------------- ledger half
cte("ap", ("fx_prices",), f"""
  SELECT date, regexp_replace(symbol, '-USD', '') AS asset, price FROM fx_prices
  WHERE symbol IN (SELECT * FROM (VALUES {SYMBOL_VALUES}) v(s))
    AND date BETWEEN DATE '{LEDGER_START}' AND DATE '{LEDGER_END}'""")

cte("live", ("ap",), """
  SELECT * FROM ap WHERE asset IN (SELECT asset FROM ap GROUP BY asset HAVING count(price) > 0)""")

cte("rets", ("live",), """
  SELECT date, asset, coalesce(price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0) - 1, 0.0) AS ret
  FROM live""")

cte("blotter", ("fx_investments", "fx_fixedincome"), """
  SELECT coalesce(i.date, f.date) AS date, coalesce(i.GLDInv, 0.0) AS GLDInv, coalesce(i.ETHInv, 0.0) AS ETHInv,
         coalesce(i.NMRInv, 0.0) AS NMRInv, coalesce(f.BondInv, 0.0) AS BondInv
  FROM fx_investments i FULL OUTER JOIN fx_fixedincome f ON i.date = f.date""")

cte("wf", ("ap", "blotter", "fx_cash"), f"""
  SELECT d.date, {', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in ASSET_COLS)},
         coalesce(b.GLDInv, 0.0) AS GLDInv, coalesce(b.ETHInv, 0.0) AS ETHInv, coalesce(b.NMRInv, 0.0) AS NMRInv,
         coalesce(b.BondInv, 0.0) AS BondInv, coalesce(c.Principal, 0.0) AS Principal,
         coalesce(c.Interest, 0.0) AS Interest, coalesce(c.Adjustments, 0.0) AS Adjustments
  FROM (SELECT DISTINCT date FROM ap) d
  LEFT JOIN blotter b ON b.date = d.date LEFT JOIN fx_cash c ON c.date = d.date""")

cte("cashbal", ("wf",), """
  SELECT date, sum((Principal + Interest + Adjustments) - (GLDInv + ETHInv + NMRInv + BondInv))
               OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cashbalance
  FROM wf""")

cte("flows", ("wf",), """
  SELECT date, 'GLD' AS asset, GLDInv AS inv FROM wf UNION ALL
  SELECT date, 'ETH', ETHInv FROM wf UNION ALL
  SELECT date, 'NMR', NMRInv FROM wf UNION ALL
  SELECT date, 'Bond', BondInv FROM wf""")

cte("balx", ("rets", "flows"), """
  SELECT r.asset, r.date, r.ret, coalesce(f.inv, 0.0) AS inv,
         row_number() OVER (PARTITION BY r.asset ORDER BY r.date) AS i
  FROM rets r LEFT JOIN flows f ON f.date = r.date AND f.asset = r.asset""")

# The recurrence as a plain fold: B_1 = inv_1, B_i = B_{i-1} * (1 + r_i) + inv_i.
cte("balances", ("balx",), """
  SELECT * FROM (
    WITH RECURSIVE fold(asset, i, date, balance) AS (
      SELECT asset, i, date, inv FROM balx WHERE i = 1
      UNION ALL
      SELECT x.asset, x.i, x.date, fold.balance * (1 + x.ret) + x.inv
      FROM fold JOIN balx x ON x.asset = fold.asset AND x.i = fold.i + 1)
    SELECT asset, date, balance FROM fold)""")

cte("wide_prices", ("ap",), f"""
  SELECT date, {', '.join(f"max(CASE WHEN asset = '{c}' THEN price END) AS {c}" for c in ASSET_COLS)}
  FROM ap GROUP BY date""")

cte("cal_days", (), """
  SELECT DISTINCT CAST(ts AS DATE) AS date FROM events""")

cte("cal", ("cal_days",), """
  SELECT CAST(g AS DATE) AS date,
         isodow(CAST(g AS DATE)) < 6 AND CAST(g AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15') AS is_biz
  FROM (SELECT min(date) - 10 AS lo, max(date) + 10 AS hi FROM cal_days) r,
       generate_series(CAST(r.lo AS TIMESTAMP), CAST(r.hi AS TIMESTAMP), INTERVAL 1 DAY) t(g)""")


def _with(*names: str) -> str:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTE[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]}\n)" for n in seen) + "\n"


def _r(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(R(f'"{c}"') + f' AS "{c}"' if c in doubles else f'"{c}"' for c in cols)


SCORE_COLS = ["model_name", "roundNumber", "atRisk", "seq", "date", "day", "displayName",
              "payoutPending", "payoutSettled", "percentile", "value"]
SCORE_D: set[str] = set()  # source values, compared in full
CLEAN_COLS = ["model_name", "roundNumber", "seq", "displayName", "date", "day", "payoutPending", "atRisk"]
TS_COLS = CLEAN_COLS + ["returns", "dailypayout", "stakeandpayout", "dailyrets"]
TS_D = {"returns", "dailypayout", "stakeandpayout", "dailyrets"}
BD_COLS = ["model_name", "date", "totalpayout", "cumstake", "walletestimate", "NMRwtret",
           "totalpayoutdailychg", "return", "leveredreturn"]
PORT_COLS = ["date", "totalpayout", "cumstake", "walletestimate", "totalpayoutdailychg", "return", "leveredreturn"]
CUM_COLS = ["model_name", "date", "totalpayout", "cumstake", "walletestimate", "NMRwtret",
            "totalpayoutdailychg", "cumbalance", "cumstakebalance", "NMR", "cumUSD", "cumstakeUSD"]
CUM_ALL_COLS = ["date", "cumstake", "walletestimate", "cumbalance", "cumstakebalance", "NMR", "cumUSD", "cumstakeUSD"]
ALLD = set(CUM_COLS + BD_COLS + PORT_COLS + ["NMRreturn", "return_currency", "leveredreturn_currency"]) - {
    "model_name", "date"}
WF_COLS = ["date", *ASSET_COLS, "GLDInv", "ETHInv", "NMRInv", "BondInv", "Principal", "Interest", "Adjustments"]

_score_text = ", ".join(
    ["coalesce(date, '') AS date", f"{TEXT('day')} AS day", "coalesce(displayName, '') AS displayName"]
    + [f"{TEXT(c)} AS {c}" for c in ("payoutPending", "payoutSettled", "percentile", "value")])

_text_cols = ", ".join(
    ["model_name", "CAST(roundNumber AS VARCHAR) AS roundNumber", "CAST(atRisk AS VARCHAR) AS atRisk",
     "CAST(seq AS VARCHAR) AS seq", "coalesce(date, '') AS date", f"{TEXT('day')} AS day",
     "coalesce(displayName, '') AS displayName"]
    + [f"{TEXT(c)} AS {c}" for c in ("payoutPending", "payoutSettled", "percentile", "value")])

_profile = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(\"{c}\") AS n_values, "
    f"count(*) = 0 AS table_is_empty, count(\"{c}\") = 0 AS is_empty_series FROM wide_prices"
    for c in ["date", *ASSET_COLS])

ORACLE_SQL: dict[str, str] = {
    "scan_models": _with("fx_scores") + """
      SELECT model_name, roundNumber, seq, displayName, date, nullif(day, '') AS day, payoutPending, atRisk
      FROM fx_scores""",
    "scan_model_files": _with("fx_scores") + """
      SELECT model_name, roundNumber, CASE WHEN NOT regexp_matches(model_name, '[369]$') THEN displayName END AS displayName,
             date, nullif(day, '') AS day, payoutPending, atRisk FROM fx_scores""",
    "staked_daily_files": _with("ts") + "SELECT " + _r([c for c in TS_COLS if c not in ("seq", "displayName")], TS_D)
        + ", CASE WHEN NOT regexp_matches(model_name, '[369]$') THEN displayName END AS displayName FROM ts",
    "read_responses": _with("flat") + "SELECT " + _r(SCORE_COLS, SCORE_D) + """,
             dense_rank() OVER (PARTITION BY model_name ORDER BY roundNumber DESC) - 1 AS rec_pos FROM flat""",
    "model_status": _with("registry", "fx_scores") + """
      SELECT r.model_name, count(s.model_name) > 0 AS ok, count(s.model_name) AS n_rows,
             count(CASE WHEN trim(s.date) <> '' AND try_cast(substr(s.date, 1, 10) AS DATE) IS NULL THEN 1 END) AS bad_date,
             count(CASE WHEN trim(s.day) <> '' AND try_cast(s.day AS DOUBLE) IS NULL THEN 1 END) AS bad_day,
             0::BIGINT AS "bad_payoutPending", 0::BIGINT AS "bad_atRisk"
      FROM registry r LEFT JOIN fx_scores s USING (model_name) GROUP BY r.model_name""",
    "rejected_cells": _with("fx_scores") + """
      SELECT model_name, roundNumber, seq, 'date' AS "column", date AS cell FROM fx_scores WHERE trim(date) <> '' AND try_cast(substr(date, 1, 10) AS DATE) IS NULL
      UNION ALL
      SELECT model_name, roundNumber, seq, 'day', day FROM fx_scores WHERE trim(day) <> '' AND try_cast(day AS DOUBLE) IS NULL""",
    "cumulative_default_columns": _with("cum_missing") + """
      SELECT model_name, date, CAST(0 AS DOUBLE) AS totalpayout, """ + R("cumstake") + """ AS cumstake, CAST(0 AS DOUBLE) AS walletestimate,
             CAST(0 AS DOUBLE) AS "NMRwtret", CAST(0 AS DOUBLE) AS totalpayoutdailychg, CAST(0 AS DOUBLE) AS cumbalance,
             """ + R("cumstakebalance") + """ AS cumstakebalance, """ + R("NMR") + """ AS "NMR", CAST(0 AS DOUBLE) AS "cumUSD", """ + R("cumstakeUSD") + """ AS "cumstakeUSD"
      FROM cum_missing""",
    "asset_prices": _with("ap") + f"""
      SELECT date, asset, {R('price')} AS price FROM ap WHERE date BETWEEN DATE '{PRICES_START}' AND DATE '{PRICES_END}'""",
    "drop_empty_series": _with("live") + f"SELECT date, asset, {R('price')} AS price FROM live",
    "asset_returns": _with("rets") + f"SELECT date, asset, {R('ret')} AS ret FROM rets",
    "asset_values": _with("ap") + f"""
      SELECT d.date, a.asset, CAST(0 AS DOUBLE) AS value FROM (SELECT DISTINCT date FROM ap) d
      CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in ASSET_COLS)}) a(asset)""",
    "asset_balances": _with("balances") + f"SELECT date, asset, {R('balance')} AS balance FROM balances",
    "investment_blotter": _with("blotter") + "SELECT " + _r(
        ["date", "GLDInv", "ETHInv", "NMRInv", "BondInv"], set()) + " FROM blotter",
    "working_frame": _with("wf") + "SELECT " + _r(WF_COLS, set()) + " FROM wf",
    "cash_balance": _with("cashbal") + f"SELECT date, {R('cashbalance')} AS cashbalance FROM cashbal",
    "nmr_ledger": _with("wf", "balances") + f"""
      SELECT w.date, coalesce({R('b.balance')}, 0.0) AS NMR, w.NMRInv
      FROM wf w LEFT JOIN balances b ON b.date = w.date AND b.asset = 'NMR'""",
    "table_profile": _with("wide_prices") + _profile,
    "flatten_scores": _with("flat") + "SELECT " + _r(SCORE_COLS, SCORE_D) + " FROM flat",
    "null_scores_default": _with("flat") + "SELECT " + _r(SCORE_COLS, SCORE_D).replace(
        '"seq"', 'coalesce("seq", 0) AS "seq"', 1) + " FROM flat",
    "filter_scores": _with("flat") + "SELECT " + _r(SCORE_COLS, SCORE_D)
    + " FROM flat WHERE displayName IN ('mmc', 'fnc_v4')",
    "filter_scores_parity": _with("flat") + "SELECT " + _r(SCORE_COLS, SCORE_D) + """
      FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY roundNumber DESC, seq NULLS FIRST) AS i FROM flat)
      WHERE displayName = CASE WHEN i % 2 = 1 THEN 'mmc' ELSE 'fnc_v4' END""",
    "filter_scores_documents": _with("flat") + "SELECT " + _r(SCORE_COLS, SCORE_D) + """, rec_pos
      FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY roundNumber DESC, seq NULLS FIRST) AS i,
                   dense_rank() OVER (PARTITION BY model_name ORDER BY roundNumber DESC) - 1 AS rec_pos FROM flat)
      WHERE displayName = CASE WHEN i % 2 = 1 THEN 'mmc' ELSE 'fnc_v4' END""",
    "stringify_scores": _with("flat") + f"""
      SELECT model_name, roundNumber, atRisk, seq, {_score_text}
      FROM flat WHERE displayName IN ('mmc', 'fnc_v4')""",
    "round_numbers": f"SELECT DISTINCT {MODEL.format('o_custkey')} AS model_name, o_orderkey AS roundNumber FROM orders",
    "model_ids": _with("registry", "scored_models") + """
      SELECT s.model_name, r.model_id FROM scored_models s LEFT JOIN registry r USING (model_name)""",
    "run_summary": _with("registry", "scored_models") + """
      SELECT count(*) AS total_models, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS successful,
             CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed,
             coalesce(string_agg(CASE WHEN NOT ok THEN model_name END, ', ' ORDER BY model_name), '') AS failed_names
      FROM (SELECT r.model_name, s.model_name IS NOT NULL AS ok
            FROM registry r LEFT JOIN scored_models s USING (model_name))""",
    "clean_scores": _with("scores") + "SELECT " + _r(CLEAN_COLS, set()) + " FROM scores",
    "staked_daily": _with("ts") + "SELECT " + _r(TS_COLS, TS_D) + " FROM ts",
    "staked_by_date": _with("bd") + "SELECT " + _r(BD_COLS, ALLD) + " FROM bd",
    "weekend_flags": _with("bd") + f"SELECT DISTINCT model_name, date, {WEEKEND('date')} AS is_weekend FROM bd",
    "bizday_shift": f"""
      SELECT date, {WEEKEND('date')} AS is_weekend, {NEXT('date')} AS next_biz, {PREV('date')} AS prev_biz
      FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""",
    "bizday_shift_holidays": _with("cal") + f"""
      SELECT e.date, {WEEKEND('e.date')} AS is_weekend,
             (SELECT min(c.date) FROM cal c WHERE c.date > e.date AND c.is_biz) AS next_biz,
             (SELECT max(c.date) FROM cal c WHERE c.date < e.date AND c.is_biz) AS prev_biz
      FROM cal_days e""",
    "bizday_offsets": """
      WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events),
      days AS (SELECT CAST(unnest(generate_series(min(date) - INTERVAL 200 DAY, max(date) + INTERVAL 200 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
      biz AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM days WHERE isodow(day) < 6 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-15')),
      r AS (SELECT date, (SELECT max(k) FROM biz WHERE day <= date) AS upto, (SELECT max(k) FROM biz WHERE day < date) AS under FROM e)
      SELECT r.date, a.day AS back_21, b.day AS back_2, c.day AS on_5, d.day AS on_64
      FROM r JOIN biz a ON a.k = under - 20 JOIN biz b ON b.k = under - 1 JOIN biz c ON c.k = upto + 5 JOIN biz d ON d.k = upto + 64""",
    "bizday_by_date": _with("bizbd") + "SELECT " + _r(BD_COLS, ALLD) + " FROM bizbd",
    "bizday_ts": _with("bts") + "SELECT " + _r(TS_COLS, TS_D) + " FROM bts",
    "allmodels": _with("allm") + "SELECT " + _r(PORT_COLS, ALLD) + " FROM allm",
    "nmr_prices": _with("nmr") + f"SELECT date, {R('NMR')} AS NMR, {R('NMRreturn')} AS NMRreturn FROM nmr",
    "allmodels_currency": _with("allmc") + "SELECT " + _r(
        PORT_COLS + ["NMR", "NMRreturn", "return_currency", "leveredreturn_currency"], ALLD) + " FROM allmc",
    "daily_aggregates": _with("dagg") + f"""
      SELECT model_name, date, {R('ts_totalpayout')} AS ts_totalpayout,
             {R('ts_totalpayoutdailychg')} AS ts_totalpayoutdailychg FROM dagg""",
    "cumulative_by_model": _with("cum_model") + "SELECT " + _r(CUM_COLS, ALLD) + " FROM cum_model",
    "cumulative_missing_ts": _with("cum_missing") + "SELECT " + _r(CUM_COLS, ALLD) + " FROM cum_missing",
    "cumulative_allmodels": _with("cum_port") + "SELECT " + _r(CUM_ALL_COLS, ALLD) + " FROM cum_port",
    "cumulative_all": _with("cum_model", "cum_port") + "SELECT " + _r(CUM_COLS, ALLD) + """ FROM (
        SELECT * FROM cum_model
        UNION ALL
        SELECT 'allmodels' AS model_name, date, CAST(NULL AS DOUBLE) AS totalpayout, cumstake, walletestimate,
               CAST(NULL AS DOUBLE) AS NMRwtret, CAST(NULL AS DOUBLE) AS totalpayoutdailychg,
               cumbalance, cumstakebalance, NMR, cumUSD, cumstakeUSD
        FROM cum_port)""",
    "sink_roundtrip_scores": _with("flat") + f"""
      SELECT {_text_cols} FROM flat WHERE displayName IN ('mmc', 'fnc_v4')""",
    "sink_roundtrip_cash": _with("cashbal") + f"SELECT date, {R('cashbalance')} AS cashbalance FROM cashbal",
}
