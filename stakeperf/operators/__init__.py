"""Relational and time-series operators; each is a lazy DataFrame -> DataFrame
function built from Spark windows, aggregates and joins.

* ``scores``     -- ingest of nested score records (flatten, filter, stringify, ids, summary)
* ``staking``    -- per-round differences, per-(model, date) summary, business-day re-dating
* ``portfolio``  -- roll-up over models, token prices and returns, currency adjustment
* ``cumulative`` -- re-dated raw rows, daily aggregates, cumulative balances
* ``assets``     -- prices, returns, zero grid, running balances
* ``ledger``     -- blotter, working frame, cash balance, token ledger
* ``calendar``   -- holiday calendars and business-day shifts
* ``quality``    -- table profile
* ``windows``    -- blocked prefix sums and lags (bounded tasks under key skew)
"""
