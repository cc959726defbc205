"""NAV analytics and scenario tables in DuckDB SQL."""

from __future__ import annotations

import re

KEYS = ["africa", "america", "asia", "europe", "middle_east"]
ROBUST = [
    "total_return", "annualized_return", "sharpe_ratio", "max_drawdown", "average_turnover",
    "fees_as_initial_cash",
]
WIDE = ["total_return", "excess_total_return", "alpha_annualized", "beta"]


def sharpe(x: str) -> str:
    return f"coalesce(avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252), 0)"


VIEWS = {
    "v_navr": """SELECT *, nav / start - 1 AS r, nav / greatest(max(nav) OVER (PARTITION BY
          portfolio_id ORDER BY date), 1000000) - 1 AS drawdown
      FROM (SELECT *, coalesce(lag(nav) OVER (PARTITION BY portfolio_id ORDER BY date), 1000000)
              AS start FROM v_nav) AS x""",
    "v_slug": """SELECT *, replace(lower(benchmark_key), ' ', '_') AS benchmark FROM v_bench""",
    "v_base": """SELECT portfolio_id, s.benchmark, close FROM (
        SELECT portfolio_id, k.benchmark, first FROM (SELECT portfolio_id, min(date) AS first
          FROM v_nav GROUP BY ALL) f, (SELECT DISTINCT benchmark FROM v_slug) k) a
      ASOF JOIN v_slug s ON a.benchmark = s.benchmark AND a.first > s.date""",
    "v_aligned": """SELECT x.*, x.close / coalesce(b.close, first(x.close) OVER (
          PARTITION BY x.portfolio_id, x.benchmark ORDER BY x.date)) * 1000000 AS benchmark_nav
      FROM (SELECT n.*, s.benchmark, s.close FROM (SELECT v_navr.*, k.bkey FROM v_navr,
              (SELECT DISTINCT benchmark AS bkey FROM v_slug) k) n
            ASOF JOIN v_slug s ON n.bkey = s.benchmark AND n.date >= s.date) x
      LEFT JOIN v_base b ON x.portfolio_id = b.portfolio_id AND x.benchmark = b.benchmark""",
    "v_metrics": f"""SELECT *, end_nav / 1000000 - 1 AS total_return,
        pow(end_nav / 1000000, 252.0 / trading_days) - 1 AS annualized_return,
        CASE WHEN max_drawdown < 0 THEN (pow(end_nav / 1000000, 252.0 / trading_days) - 1)
          / abs(max_drawdown) ELSE 0 END AS calmar_ratio
      FROM (SELECT portfolio_id, 1000000.0::DOUBLE AS start_nav, arg_max(nav, date) AS end_nav,
              count(*) AS trading_days,
              coalesce(stddev_samp(r), 0) * sqrt(252) AS annualized_volatility,
              {sharpe("r")} AS sharpe_ratio, least(min(drawdown), 0) AS max_drawdown,
              avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_day_rate
            FROM v_navr GROUP BY portfolio_id) AS x""",
    "v_benr": """SELECT *, r - b AS a FROM (SELECT *, benchmark_nav / coalesce(lag(benchmark_nav)
          OVER w, 1000000) - 1 AS b,
        benchmark_nav / greatest(max(benchmark_nav) OVER w, 1000000) - 1 AS bdd
      FROM v_aligned WINDOW w AS (PARTITION BY portfolio_id, benchmark ORDER BY date)) AS x""",
    "v_relative": f"""SELECT *, pow(1 + total_return, 252.0 / observations) - 1
          AS annualized_return, strategy - total_return AS excess_total_return,
        (ms - beta * mb) * 252 AS alpha_annualized
      FROM (SELECT portfolio_id, benchmark, min(date) AS start_date, count(*) AS observations,
              arg_max(benchmark_nav, date) / 1000000 - 1 AS total_return,
              arg_max(nav, date) / arg_min(start, date) - 1 AS strategy,
              least(min(bdd), 0) AS max_drawdown, stddev_samp(a) * sqrt(252) AS tracking_error,
              {sharpe("a")} AS information_ratio, avg(r) AS ms, avg(b) AS mb,
              CASE WHEN var_samp(b) > 1e-12 THEN covar_samp(r, b) / var_samp(b) ELSE 0 END AS beta,
              CASE WHEN count(*) > 1 THEN regr_sxy(r, b) / nullif(sqrt(regr_sxx(r, b)
                * regr_syy(r, b)), 0) ELSE 0 END AS correlation
            FROM v_benr GROUP BY portfolio_id, benchmark) AS x""",
    "v_annual": """SELECT portfolio_id, series, year(date) AS year, product(1 + r) - 1
          AS annual_return
      FROM (SELECT portfolio_id, 'nav' AS series, date, r FROM v_navr
            UNION ALL SELECT portfolio_id, benchmark, date, b FROM v_benr) AS x GROUP BY ALL""",
    "v_exec": """SELECT n.*, coalesce(total_fees, 0) AS total_fees,
        coalesce(total_fees, 0) / 1000000 AS fees_as_initial_cash,
        coalesce(filled_orders, 0) AS filled_orders,
        coalesce(rejected_orders, 0) AS rejected_orders, r.* EXCLUDE (portfolio_id)
      FROM (SELECT portfolio_id, avg(cash / nav) AS average_cash_weight,
              max(cash / nav) AS maximum_cash_weight FROM v_nav GROUP BY ALL) n
      LEFT JOIN (SELECT portfolio_id, sum(fees) AS total_fees,
              count(*) FILTER (filled_quantity > 0) AS filled_orders,
              count(*) FILTER (filled_quantity = 0) AS rejected_orders
            FROM v_executed GROUP BY ALL) o USING (portfolio_id)
      LEFT JOIN (SELECT portfolio_id, avg(turnover) AS average_turnover,
              quantile_cont(turnover, 0.5) AS median_turnover, avg(entered_count)
                AS average_entries, avg(exited_count) AS average_exits,
              avg(entered_count) FILTER (i > 1) AS average_entries_after_initial,
              avg(exited_count) FILTER (i > 1) AS average_exits_after_initial
            FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY execution_date)
                    AS i FROM v_rebalance) AS y GROUP BY ALL) r USING (portfolio_id)""",
    "v_summary": "SELECT * FROM v_metrics LEFT JOIN v_exec USING (portfolio_id) LEFT JOIN (SELECT"
    " portfolio_id, " + ", ".join(
        f"max({c}) FILTER (benchmark = '{k}') AS {k}_{c}" for k in KEYS for c in WIDE
    ) + " FROM v_relative GROUP BY portfolio_id) w USING (portfolio_id)",
    "v_regime_rows": """SELECT *, c / max(c) OVER (PARTITION BY portfolio_id, regime ORDER BY date)
          - 1 AS dd
      FROM (SELECT n.portfolio_id, n.date, n.r, d.regime, d.trailing_return,
              product(1 + r) OVER (PARTITION BY portfolio_id, regime ORDER BY n.date) AS c
            FROM v_navr n ASOF JOIN v_regimes d ON n.date >= d.date) AS x""",
    "v_episode_rows": """SELECT *, max(nav) OVER (PARTITION BY portfolio_id ORDER BY date) AS peak
      FROM (SELECT portfolio_id, date, nav FROM v_nav UNION ALL
            SELECT portfolio_id, (min(date) - 1)::DATE, 1000000 FROM v_nav GROUP BY ALL) AS x""",
    "v_worst": """SELECT DISTINCT ON (portfolio_id) portfolio_id, date AS trough_date,
        nav AS trough_nav, peak AS peak_nav, nav / peak - 1 AS max_drawdown
      FROM v_episode_rows ORDER BY portfolio_id, nav / peak - 1, date""",
}

QUERIES = {
    "benchmark_nav": "SELECT * FROM v_aligned",
    "performance_metrics": "SELECT * FROM v_metrics",
    "benchmark_metrics": "SELECT * FROM v_relative",
    "annual_returns": "SELECT portfolio_id, year, " + ", ".join(
        f"max(annual_return) FILTER (series = '{s}') AS {s}" for s in ["nav", *KEYS]
    ) + " FROM v_annual GROUP BY ALL",
    "annual_excess": """SELECT a.portfolio_id, a.year, b.series AS benchmark,
          a.annual_return AS strategy_return, b.annual_return AS benchmark_return,
          a.annual_return - b.annual_return AS excess_return
        FROM v_annual a JOIN v_annual b USING (portfolio_id, year)
        WHERE a.series = 'nav' AND b.series <> 'nav'""",
    "drawdown_series": "SELECT * FROM v_navr",
    "drawdown_episode": """SELECT w.portfolio_id,
          min(date) FILTER (date <= trough_date AND nav = peak_nav) AS peak_date, trough_date,
          min(date) FILTER (date > trough_date AND nav >= peak_nav) AS recovery_date,
          count(*) FILTER (date > trough_date AND nav >= peak_nav) > 0 AS recovered,
          any_value(peak_nav) AS peak_nav, any_value(trough_nav) AS trough_nav,
          any_value(max_drawdown) AS max_drawdown
        FROM v_worst w JOIN v_episode_rows e ON w.portfolio_id = e.portfolio_id
        GROUP BY w.portfolio_id, trough_date""",
    "regime_attribution": """SELECT x.portfolio_id, regime, count(*) AS trading_days,
          avg(trailing_return) AS mean_trailing_return, avg(r) AS mean_daily_return,
          pow(1 + avg(r), 252) - 1 AS conditional_annualized_return,
          avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_day_rate,
          arg_max(c, date) - 1 AS compounded_return_on_regime_days,
          sum(ln(1 + r)) AS log_return_contribution,
          sum(ln(1 + r)) / any_value(total) AS share_of_total_log_return,
          min(dd) AS conditional_max_drawdown
        FROM v_regime_rows x JOIN (SELECT portfolio_id, sum(ln(1 + r)) AS total FROM v_navr
                                   GROUP BY ALL) t ON x.portfolio_id = t.portfolio_id
        GROUP BY x.portfolio_id, regime""",
    "equal_weight_nav": """SELECT date, benchmark_return,
          product(1 + benchmark_return) OVER (ORDER BY date) * 1000000 AS universe_equal_weight_nav
        FROM (SELECT date, coalesce(avg(r), 0) AS benchmark_return
              FROM (SELECT *, p / lag(p) OVER (PARTITION BY code ORDER BY date) - 1 AS r
                    FROM (SELECT *, 1000 + sqrt(close) AS p FROM v_pit_member) AS w) AS x WHERE is_universe_member GROUP BY date) AS y""",
    "monthly_nav": """SELECT a.*, b.normalized AS reference_normalized FROM v_monthly a
        JOIN v_monthly b ON a.date = b.date AND b.portfolio_id = 'NATION_2'""",
    "execution_diagnostics": "SELECT * FROM v_exec",
    "rejection_report": """SELECT portfolio_id, reason, count(*) AS rejected_orders
        FROM v_executed WHERE filled_quantity = 0 GROUP BY ALL""",
    "backtest_summary": "SELECT * FROM v_summary",
    "scenario_comparison": "SELECT * FROM v_sc_results",
    "scenario_nav": "SELECT * FROM v_sc_nav",
    "scenario_turnover": "SELECT * FROM v_sc_turns",
    "robustness_summary": "SELECT profile, count(*) AS scenarios, " + ", ".join(
        f"min({c}) AS {c}_min, quantile_cont({c}, 0.5) AS {c}_median, max({c}) AS {c}_max"
        for c in ROBUST
    ) + ", avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_return_rate, "
    + ", ".join(
        f"avg(CASE WHEN {k}_excess_total_return > 0 THEN 1.0 ELSE 0.0 END) AS beat_{k}_rate"
        for k in KEYS
    ) + " FROM v_sc_results GROUP BY profile",
    "scenario_pivot": """SELECT setting, avg(total_return) FILTER (profile = 'baseline') AS baseline,
          avg(total_return) FILTER (profile = 'momentum') AS momentum
        FROM v_sc_results GROUP BY setting""",
    "size_exposure": """SELECT p.portfolio_id, size_bucket, count(*) AS observations,
          avg(mv / nav) AS average_weight, min(mv / nav) AS minimum_weight,
          max(mv / nav) AS maximum_weight, avg(mv) AS average_market_value
        FROM (SELECT portfolio_id, date, size_bucket, sum(market_value) AS mv FROM v_positions
              JOIN v_master USING (code) GROUP BY ALL) p
        JOIN v_ledger l ON p.portfolio_id = l.portfolio_id AND p.date = l.date
        GROUP BY p.portfolio_id, size_bucket""",
    "diagnostic_summary": """SELECT * FROM (SELECT *, CASE WHEN length(portfolio_id) = 8
            THEN 'baseline' ELSE 'momentum' END AS model FROM v_exec) e
        LEFT JOIN v_picked USING (model)
        LEFT JOIN (SELECT model, avg(s) AS mean_replacement_spread,
            avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS positive_replacement_rate
          FROM (SELECT *, entrant_mean_excess_return - exit_mean_excess_return AS s
                FROM v_replaced) AS x GROUP BY model) r USING (model)""",
}
VIEWS["v_monthly"] = """SELECT portfolio_id, last_day(date) AS date,
    arg_max(nav, date) / 1000000 * 100 AS normalized FROM v_nav
  GROUP BY portfolio_id, last_day(date)"""

# Scenario portfolios: two rankers, three book sizes, three cost multiples. Every holding is valued on
# every market date at its last price.
VIEWS.update({
    "v_sc_px": "SELECT code, date, 1000 + sqrt(close) AS px FROM v_bars",
    "v_sc_days": "SELECT DISTINCT date FROM v_bars",
    "v_sc_pick": """SELECT model, k, date, code, 0.98 / count(*) OVER (PARTITION BY model, k, date) AS w
      FROM (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY score DESC, code) AS place
            FROM (SELECT *, row_number() OVER (PARTITION BY model, date, industry
                    ORDER BY score DESC, code) AS ir
                  FROM (SELECT 'baseline' AS model, date, code, industry, baseline_score AS score
                        FROM v_pred UNION ALL
                        SELECT 'momentum', date, code, industry, momentum_score FROM v_pred) AS a) AS b
            WHERE ir <= 2) AS c, (SELECT unnest([3, 5, 8]) AS k) AS s
      WHERE place <= k""",
    "v_sc_held": """SELECT h.*, p.px AS base FROM (
        SELECT model || '_top' || k || '_cost' || times || 'x' AS scenario, code, w, start, stop, times
        FROM v_sc_pick JOIN (SELECT date, start, lead(start) OVER (ORDER BY date) AS stop
            FROM (SELECT s.date, min(d.date) AS start FROM (SELECT DISTINCT date FROM v_sc_pick) s
                  JOIN v_sc_days d ON d.date > s.date GROUP BY s.date) AS x) AS t USING (date),
          (SELECT unnest([0, 1, 2]) AS times) AS n) h
      ASOF JOIN v_sc_px p ON h.code = p.code AND h.start >= p.date""",
    "v_sc_growth": """SELECT scenario, start, stop, day, any_value(times) AS times, sum(w) AS invested,
        1 + sum(w * (px / base - 1)) AS growth
      FROM (SELECT h.*, d.date AS day FROM v_sc_held h JOIN v_sc_days d
            ON d.date >= start AND (stop IS NULL OR d.date <= stop)) v
      ASOF JOIN v_sc_px p ON v.code = p.code AND v.day >= p.date GROUP BY scenario, start, stop, day""",
    "v_sc_moves": """SELECT scenario, coalesce(n.start, o.start) AS start, o.w AS old, n.w AS new,
        coalesce(n.w, 0) - coalesce(o.w, 0) AS moved
      FROM (SELECT scenario, start, code, w FROM v_sc_held) n
      FULL JOIN (SELECT h.scenario, h.stop AS start, h.code, h.w * px / base / growth AS w
                 FROM v_sc_held h JOIN v_sc_growth g ON h.scenario = g.scenario AND h.start = g.start
                   AND h.stop = g.day
                 ASOF JOIN v_sc_px p ON h.code = p.code AND h.stop >= p.date) o
        USING (scenario, start, code)""",
    "v_sc_cost": """SELECT scenario, start, sum(abs(moved)) AS turnover,
        count(*) FILTER (old IS NULL) AS entered_count, count(*) FILTER (new IS NULL) AS exited_count,
        count(*) FILTER (moved <> 0) AS orders,
        sum(greatest(moved, 0)) * 0.00081 + sum(greatest(-moved, 0)) * 0.00131 AS cost
      FROM v_sc_moves GROUP BY scenario, start""",
    "v_sc_chain": """SELECT *, 1000000 * coalesce(product(grown * (1 - cost * times)) OVER (
          PARTITION BY scenario ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)
          AS before
      FROM (SELECT scenario, start, arg_max(growth, day) AS grown, any_value(times) AS times
            FROM v_sc_growth GROUP BY scenario, start) AS x JOIN v_sc_cost USING (scenario, start)""",
    "v_sc_nav": """SELECT scenario AS portfolio_id, day AS date, before * (1 - cost * c.times) * growth
          AS nav, before * (1 - cost * c.times) * (1 - invested) AS cash
      FROM v_sc_growth g JOIN v_sc_chain c USING (scenario, start)
      WHERE stop IS NULL OR day < stop""",
    "v_sc_turns": """SELECT scenario AS portfolio_id, start AS execution_date, turnover, entered_count,
        exited_count FROM v_sc_cost""",
    "v_sc_orders": """SELECT scenario AS portfolio_id, abs(moved) * before AS filled_quantity,
        abs(moved) * before * times * CASE WHEN moved > 0 THEN 0.00081 ELSE 0.00131 END AS fees
      FROM v_sc_moves JOIN v_sc_chain USING (scenario, start) WHERE moved <> 0""",
    "v_sc_results": """SELECT *, portfolio_id AS scenario, split_part(portfolio_id, '_', 1) AS profile,
        substr(portfolio_id, 10) AS setting FROM v_sc_summary""",
})
# The NAV statistics above, over the scenarios' tables.
_OWN = {"v_nav": "v_sc_nav", "v_executed": "v_sc_orders", "v_rebalance": "v_sc_turns"} | {
    n: n.replace("v_", "v_sc_", 1)
    for n in ("v_navr", "v_base", "v_aligned", "v_metrics", "v_benr", "v_relative", "v_exec", "v_summary")
}
for _name in ("v_navr", "v_base", "v_aligned", "v_metrics", "v_benr", "v_relative", "v_exec", "v_summary"):
    VIEWS[_OWN[_name]] = re.sub(r"\bv_\w+", lambda m: _OWN.get(m.group(), m.group()), VIEWS[_name])
