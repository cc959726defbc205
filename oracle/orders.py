"""Selection, orders, fills and ledgers in DuckDB SQL."""

from __future__ import annotations

from oracle.research import QUERIES as RESEARCH

FEE = (
    "(greatest(5.0::DOUBLE, ({n}) * 3.0::DOUBLE / 10000) + ({n}) * 0.1::DOUBLE / 10000"
    " + CASE WHEN {s} = 'SELL' THEN ({n}) * 5.0::DOUBLE / 10000 ELSE 0 END)"
)


def fee(notional: str, side: str = "side") -> str:
    return FEE.format(n=notional, s=side)


def ledger(fills: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_flows": f"""SELECT portfolio_id, code, date,
            sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END)::BIGINT AS change,
            sum(CASE WHEN side = 'BUY' THEN -quantity * price ELSE quantity * price END
              - {fee("quantity * price")}) AS cash_flow
          FROM {fills} GROUP BY ALL""",
        f"{prefix}_spans": f"""SELECT portfolio_id, code, date AS held_from, lead(date) OVER w
              AS changed_on, (sum(change) OVER w)::BIGINT AS quantity,
            (sum(change) OVER w - change)::BIGINT AS quantity_before
          FROM {prefix}_flows WINDOW w AS (PARTITION BY portfolio_id, code ORDER BY date)""",
    }


VIEWS = {
    "v_fills": """SELECT o_custkey AS portfolio_id, date, code,
        CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
        l_quantity::BIGINT AS quantity, price
      FROM v_trades JOIN orders ON l_orderkey = o_orderkey""",
    "v_requests": """SELECT n_name AS portfolio_id, date, code, side,
        sum(quantity)::BIGINT AS quantity, max(price) AS score,
        side = 'SELL' AND sum(quantity) >= 45 AS is_full_exit
      FROM v_fills JOIN customer ON portfolio_id = c_custkey
      JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, date, code, side""",
    "v_limits": """SELECT *, round_even(preclose * (1 + rate) * 100, 0) / 100 AS limit_up,
        round_even(preclose * (1 - rate) * 100, 0) / 100 AS limit_down
      FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS preclose,
              CASE WHEN is_st THEN 0.05::DOUBLE WHEN left(code, 3) IN ('688', '689') THEN 0.2
                WHEN left(code, 1) IN ('4', '8') OR left(code, 2) = '92' THEN 0.3
                ELSE 0.1 END AS rate FROM v_panel) AS x""",
    "v_executed": f"""SELECT *, CASE WHEN reason = '' THEN {fee("notional")} ELSE 0 END AS fees,
        CASE WHEN reason <> '' THEN 'REJECTED' WHEN filled_quantity = quantity THEN 'FILLED'
          ELSE 'PARTIALLY_FILLED' END AS status
      FROM (SELECT *, coalesce(filled_quantity * price, 0) AS notional
        FROM (SELECT *, CASE WHEN reason = '' THEN whole ELSE 0 END::BIGINT AS filled_quantity,
                CASE WHEN reason = '' THEN open * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END
                  * (5.0::DOUBLE / 10000)) END AS price
          FROM (SELECT *, CASE WHEN quantity * open < 1000 AND NOT is_full_exit
                    THEN 'BELOW_MIN_TRADE_VALUE'
                  WHEN NOT is_trading OR volume <= 0
                    OR (side = 'BUY' AND coalesce(open >= limit_up * (1 - 1e-6::DOUBLE), false))
                    OR (side = 'SELL' AND coalesce(open <= limit_down * (1 + 1e-6::DOUBLE), false))
                    THEN 'SUSPENDED_OR_LIMIT_LOCKED'
                  WHEN whole <= 0 THEN 'CAPACITY_OR_CASH_LIMIT' ELSE '' END AS reason
            FROM (SELECT r.*, open, volume, is_trading, limit_up, limit_down,
                    least(quantity, floor(volume * 0.5::DOUBLE)) AS whole
                  FROM v_requests r JOIN v_limits USING (date, code)) AS a) AS b) AS c) AS d""",
    "v_desk_fills": """SELECT portfolio_id, date, code, side, filled_quantity AS quantity, price
      FROM v_executed WHERE filled_quantity > 0""",
    **ledger("v_desk_fills", "v_desk"),
    **ledger("v_fills", "v_cust"),
    "v_changes": """SELECT portfolio_id, held_from AS execution_date,
        count(*) FILTER (quantity > 0 AND quantity_before <= 0) AS entered_count,
        count(*) FILTER (quantity <= 0 AND quantity_before > 0) AS exited_count
      FROM v_desk_spans GROUP BY ALL""",
    "v_rebalance": """SELECT d.*, coalesce(entered_count, 0) AS entered_count,
        coalesce(exited_count, 0) AS exited_count, coalesce(traded_notional / nav, 0) AS turnover,
        coalesce(large_notional / nav, 0) AS large_target_weight,
        coalesce(mid_notional / nav, 0) AS mid_target_weight
      FROM (SELECT portfolio_id, date AS execution_date, sum(notional) AS traded_notional,
              sum(fees) AS fees, count(*) FILTER (filled_quantity > 0) AS filled_orders,
              count(*) FILTER (filled_quantity = 0) AS rejected_orders,
              count(*) FILTER (bought AND size_bucket = 'LARGE') AS large_selected_count,
              count(*) FILTER (bought AND size_bucket = 'MID') AS mid_selected_count,
              sum(notional) FILTER (bought AND size_bucket = 'LARGE') AS large_notional,
              sum(notional) FILTER (bought AND size_bucket = 'MID') AS mid_notional
            FROM (SELECT *, side = 'BUY' AND filled_quantity > 0 AS bought FROM v_executed
                  LEFT JOIN v_master USING (code)) AS x GROUP BY ALL) d
      LEFT JOIN v_changes USING (portfolio_id, execution_date)
      LEFT JOIN (SELECT portfolio_id, date AS execution_date, nav FROM v_nav) n
        USING (portfolio_id, execution_date)""",
    "v_positions": """SELECT h.portfolio_id, h.date, h.code, h.quantity,
        h.quantity * b.close AS market_value
      FROM (SELECT s.*, v.date FROM v_cust_spans s JOIN (SELECT DISTINCT portfolio_id, date
              FROM v_cust_flows) v ON s.portfolio_id = v.portfolio_id AND v.date >= held_from
              AND (changed_on IS NULL OR v.date < changed_on) WHERE quantity <> 0) h
      ASOF JOIN v_bars b ON h.code = b.code AND h.date >= b.date""",
    "v_ledger": """SELECT portfolio_id, date, cash, coalesce(market_value, 0) AS market_value,
        coalesce(holdings, 0) AS holdings, cash + coalesce(market_value, 0) AS nav
      FROM (SELECT portfolio_id, date, sum(cash_flow) OVER (PARTITION BY portfolio_id ORDER BY date)
              + 1000000 AS cash
            FROM (SELECT portfolio_id, date, sum(cash_flow) AS cash_flow FROM v_cust_flows
                  GROUP BY ALL) AS x) c
      LEFT JOIN (SELECT portfolio_id, date, sum(market_value) AS market_value,
                   count(*) AS holdings FROM v_positions GROUP BY ALL) p
        USING (portfolio_id, date)""",
    "v_cand": """SELECT date, code, baseline_score AS score, industry, size_bucket, tradable,
        idio_vol_60 FROM v_pred""",
    "v_universe": """SELECT date, code, momentum_60_5 AS score, industry, size_bucket, tradable
      FROM v_frame WHERE momentum_60_5 IS NOT NULL""",
    "v_quota": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date
          ORDER BY score DESC, code) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY date, industry ORDER BY score DESC, code)
                AS industry_rank FROM v_cand) AS x WHERE industry_rank <= 2) AS y
      WHERE place <= 5""",
    "v_desk_holdings": """SELECT portfolio_id, rebalance AS date, code, quantity FROM (
        SELECT portfolio_id, code, date_trunc('month', date) AS m,
          sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END)::BIGINT AS quantity
        FROM v_requests GROUP BY ALL) n
      JOIN (SELECT date_trunc('month', date) AS m, max(date) AS rebalance FROM v_bars GROUP BY ALL)
        e USING (m) WHERE quantity > 0""",
    "v_latest": RESEARCH["latest_scores"],
    "v_plan_rows": """SELECT portfolio_id, code, coalesce(quantity, 0) AS current_quantity,
        coalesce(target_weight, 0) AS target_weight
      FROM (SELECT portfolio_id, code,
              sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END)::BIGINT AS quantity
            FROM v_requests WHERE date <= (SELECT max(date) FROM v_latest)
            GROUP BY portfolio_id, code
            HAVING sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) > 0) h
      FULL JOIN (SELECT DISTINCT r.portfolio_id, l.code, (1 - 0.02::DOUBLE) / 5 AS target_weight
                 FROM v_requests r, v_latest l WHERE baseline_rank <= 5) t
        USING (portfolio_id, code)""",
    "v_last_bar": """SELECT code, arg_max(close, date) AS price,
        arg_max(industry, date) AS industry, arg_max(size_bucket, date) AS size_bucket
      FROM v_panel WHERE date <= (SELECT max(date) FROM v_latest) GROUP BY code""",
    "v_plan": f"""SELECT *, CASE WHEN action IN ('BUY', 'SELL') THEN
          {fee("estimated_notional", "action")} ELSE 0 END AS estimated_fees,
        CASE action WHEN 'SELL' THEN 1 WHEN 'BUY' THEN 2 ELSE 3 END AS priority
      FROM (SELECT *, order_quantity * reference_price AS estimated_notional
        FROM (SELECT *, CASE WHEN small THEN 'HOLD' ELSE side END AS action,
                CASE WHEN small THEN 'BELOW_MIN_TRADE_VALUE' WHEN band
                  THEN 'WITHIN_REBALANCE_BAND' ELSE 'TARGET_REBALANCE' END AS reason,
                CASE WHEN small THEN 0 ELSE abs(target_quantity - current_quantity) END
                  AS order_quantity
          FROM (SELECT *, CASE WHEN target_quantity > current_quantity THEN 'BUY'
                    WHEN target_quantity < current_quantity THEN 'SELL' ELSE 'HOLD' END AS side,
                  target_quantity <> current_quantity AND target_quantity <> 0 AND
                    abs(target_quantity - current_quantity) * reference_price < 20000 AS small
            FROM (SELECT *, CASE WHEN band THEN current_quantity ELSE
                      (floor(floor(equity * target_weight / reference_price) / 10) * 10)::BIGINT
                      END AS target_quantity
              FROM (SELECT *, target_weight > 0 AND current_quantity > 0 AND abs(current_quantity
                        * reference_price / equity - target_weight) <= 0.02::DOUBLE AS band
                FROM (SELECT r.*, b.price AS reference_price, b.industry, b.size_bucket,
                        1000000 + sum(current_quantity * b.price) OVER (PARTITION BY portfolio_id)
                          AS equity, (SELECT max(date) FROM v_latest) AS signal_date,
                        l.security_name, l.baseline_score AS model_score, l.baseline_reason_1,
                        l.baseline_reason_2
                      FROM v_plan_rows r JOIN v_last_bar b USING (code)
                      LEFT JOIN v_latest l USING (code)) AS a) AS c) AS d) AS e) AS f) AS g""",
}


def sensitivity() -> str:
    parts = []
    for m in (0.0, 1.0, 2.0, 3.0):
        step = f"(5.0::DOUBLE * {m} / 10000)"
        price = f"price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * {step})"
        parts.append(
            f"SELECT portfolio_id, {m}::DOUBLE AS cost_multiplier, count(*) AS fills,"
            f" sum(quantity * price) AS traded_notional,"
            f" sum({m}::DOUBLE * {fee(f'quantity * {price}')}) AS total_fees,"
            f" sum(abs(quantity * {price} - quantity * price)) AS slippage_cost"
            " FROM v_fills GROUP BY portfolio_id"
        )
    return " UNION ALL ".join(parts)


QUERIES = {
    "order_fees": f"""SELECT portfolio_id, side, count(*) AS fills, sum(quantity * price)
          AS notional, sum({fee("quantity * price")}) AS fees
        FROM v_fills GROUP BY portfolio_id, side""",
    "order_feasibility": "SELECT * FROM v_executed",
    "order_priority": """SELECT *, row_number() OVER (PARTITION BY portfolio_id, date ORDER BY
          side DESC, CASE WHEN side = 'SELL' THEN score ELSE -score END, code) AS priority
        FROM v_requests""",
    "signal_schedule": """SELECT c.date AS signal_date, min(b.date) AS execution_date, c.code,
          any_value(c.score) AS score
        FROM v_cand c JOIN (SELECT DISTINCT date FROM v_bars) b ON b.date > c.date
        GROUP BY c.date, c.code""",
    "execution_candidates": """SELECT s.*, coalesce(p.is_trading AND NOT p.is_st, false) AS tradable
        FROM (SELECT c.date AS signal_date, min(b.date) AS execution_date, c.code,
                any_value(c.score) AS score
              FROM v_cand c JOIN (SELECT DISTINCT date FROM v_bars) b ON b.date > c.date
              GROUP BY c.date, c.code) s
        LEFT JOIN v_panel p ON p.code = s.code AND p.date = s.execution_date""",
    "rebalance_summary": "SELECT * FROM v_rebalance",
    "ledger_nav": "SELECT * FROM v_ledger",
    "action_bookings": """SELECT portfolio_id, code, count(*) AS bookings,
          sum(quantity * cash_dividend_per_share) AS cash_dividend,
          sum(floor(quantity * bonus_share_ratio))::BIGINT AS bonus_quantity,
          sum(floor(quantity * rights_share_ratio))::BIGINT AS rights_eligible_quantity
        FROM v_actions JOIN v_desk_spans USING (code) WHERE quantity > 0 AND held_from < ex_date
          AND (changed_on IS NULL OR changed_on >= ex_date) GROUP BY portfolio_id, code""",
    "cost_sensitivity": sensitivity(),
    "candidate_ranks": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date
          ORDER BY score DESC, code) AS rank FROM v_universe) AS x WHERE tradable""",
    "top_k_quota": "SELECT * FROM v_quota",
    "desired_weights": """SELECT *, 1.0 AS equal, 1 / CASE WHEN idio_vol_60 IS NOT NULL
            THEN greatest(idio_vol_60, f) ELSE mid END AS inverse_volatility,
          exp(least(greatest((score - m) / (s + 1e-12), -2), 2)) AS score_tilt
        FROM v_quota JOIN (SELECT date, greatest(quantile_cont(idio_vol_60, 0.1)
              FILTER (idio_vol_60 > 0), 1e-6) AS f, quantile_cont(idio_vol_60, 0.5) AS mid,
            avg(score) AS m, stddev_pop(score) AS s FROM v_quota GROUP BY date) q USING (date)""",
    "portfolio_preflight": """SELECT *, CASE WHEN eligible < 5 THEN 'TOO_FEW_CANDIDATES'
            WHEN eligible <= 8 THEN 'EXIT_RANK_NOT_BELOW_POOL'
            WHEN industry_active AND industry_capacity < 5 THEN 'INDUSTRY_CAPACITY'
            WHEN size_active AND large_count < 2 THEN 'LARGE_SHORTAGE' END AS violation,
          min(nullif(eligible, 0)) OVER () AS smallest,
          min(nullif(eligible, 0)) OVER () >= 10 AS sufficient
        FROM (SELECT date, count(*) FILTER (tradable) AS eligible,
                count(*) FILTER (tradable AND size_bucket = 'LARGE') AS large_count,
                count(*) FILTER (tradable AND industry = 'UNKNOWN') AS unknown_count,
                count(*) FILTER (tradable AND size_bucket = 'LARGE') > 0 AND
                  count(*) FILTER (tradable AND size_bucket = 'MID') > 0 AS size_active,
                count(*) FILTER (tradable AND industry <> 'UNKNOWN') > 0 AS industry_active
              FROM v_universe GROUP BY date) a
        JOIN (SELECT date, sum(least(n, 2))::BIGINT AS industry_capacity FROM (SELECT date,
                industry, count(*) FILTER (tradable) AS n FROM v_universe GROUP BY ALL) AS i
              GROUP BY date) c USING (date)""",
    "scenario_grid": """SELECT format('exit{}_replace{}_band{:.3f}', e, r, b) AS scenario,
          e AS exit_rank, r AS max_replacements, b AS band, date,
          count(*) FILTER (rank <= e) AS inside_buffer, least(r, count(*)) AS may_replace
        FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank
              FROM v_cand) c, (SELECT unnest([6, 8, 10]) AS e) x, (SELECT unnest([1, 2]) AS r) y,
          (SELECT unnest([0.05, 0.10, 0.20]::DOUBLE[]) AS b) z
        WHERE rank <= 10 GROUP BY e, r, b, date""",
    "holdings_retained": """SELECT portfolio_id, h.date, count(*) AS holdings,
          count(c.code) AS retained, count(*) = count(c.code) AS all_retained
        FROM v_desk_holdings h LEFT JOIN v_cand c ON h.date = c.date AND h.code = c.code
        GROUP BY portfolio_id, h.date""",
    "target_quantities": """SELECT *, target_quantity - quantity AS change,
          CASE WHEN price IS NULL THEN 'REVIEW' WHEN target_quantity > quantity THEN 'BUY'
            WHEN target_quantity < quantity THEN 'SELL' ELSE 'HOLD' END AS side,
          CASE WHEN price IS NULL THEN 'NO_PRICE' WHEN band THEN 'WITHIN_REBALANCE_BAND' ELSE 'TARGET_REBALANCE' END AS band_reason
        FROM (SELECT *, CASE WHEN band THEN quantity
                ELSE floor(equity * target_weight / price)::BIGINT END AS target_quantity
          FROM (SELECT *, target_weight > 0 AND quantity > 0
                  AND abs(quantity * price / equity - target_weight) <= 0.02::DOUBLE AS band
            FROM (SELECT portfolio_id, date, code, coalesce(h.quantity, 0) AS quantity,
                    coalesce(t.target_weight, 0) AS target_weight, close AS price,
                    1000000 + coalesce(w.held, 0) AS equity
                  FROM v_desk_holdings h
                  FULL JOIN (SELECT DISTINCT d.portfolio_id, q.date, q.code,
                               (1 - 0.02::DOUBLE) / 5 AS target_weight
                             FROM v_desk_holdings d JOIN v_quota q ON d.date = q.date) t
                    USING (portfolio_id, date, code)
                  LEFT JOIN v_bars USING (date, code)
                  LEFT JOIN (SELECT portfolio_id, date, sum(quantity * close) AS held
                             FROM v_desk_holdings JOIN v_bars USING (date, code) GROUP BY ALL) w
                    USING (portfolio_id, date)) AS a) AS b) AS c""",
    "order_plan": "SELECT * FROM v_plan",
    "order_plan_summary": """SELECT portfolio_id, any_value(signal_date) AS signal_date,
          any_value(equity) AS estimated_equity,
          count(*) FILTER (target_weight > 0) AS target_positions,
          sum(target_weight) AS target_exposure,
          coalesce(sum(estimated_notional) FILTER (action = 'BUY'), 0) AS estimated_buy_notional,
          coalesce(sum(estimated_notional) FILTER (action = 'SELL'), 0) AS estimated_sell_notional,
          sum(estimated_fees) AS estimated_fees
        FROM v_plan GROUP BY portfolio_id""",
}
