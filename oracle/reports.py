"""Evaluation reports in DuckDB SQL."""

from __future__ import annotations

from barloom.config import MODEL_FEATURES

T = "target_excess_return"


def rank_of(value: str, keys: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {keys} ORDER BY {value})"
        f" + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0"
        f" - (count(*) OVER (PARTITION BY {keys}) + 1) / 2.0"
    )


def ic(source: str, keys: str, x: str) -> str:
    return (
        f"SELECT {keys}, sum(dx * dy) / nullif(sqrt(sum(dx * dx) * sum(dy * dy)), 0) AS rank_ic,"
        f" count(*) AS n FROM (SELECT {keys}, {rank_of(x, keys)} AS dx, {rank_of(T, keys)} AS dy"
        f" FROM {source} WHERE {x} IS NOT NULL AND {T} IS NOT NULL) AS r GROUP BY {keys}"
    )


def top(source: str, extra: str = "") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {extra}date, model ORDER BY score DESC, code)"
        f" <= 5 AS selected FROM {source}"
    )


POSITIVE = "avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END)"
IR = "avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)"


def stacked(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{s}' AS model, {s}_score AS score FROM {source}"
        for s in ("baseline", "momentum")
    )


def features(source: str, strip: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT date, code, {T}, '{f.removesuffix('_z') if strip else f}' AS feature, {f} AS value"
        f" FROM {source}"
        for f in MODEL_FEATURES
    )


VIEWS = {
    "v_stacked": stacked("v_pred"),
    "v_ic": f"SELECT * FROM ({ic('v_stacked', 'model, date', 'score')}) WHERE rank_ic IS NOT NULL",
    "v_top": top("v_stacked"),
    "v_known": """SELECT p.* FROM v_pred p, v_splits WHERE (date < validation_start
        AND label_end_date < validation_start) OR (date >= validation_start AND date < test_start
        AND label_end_date < test_start)""",
    "v_known_long": features("v_known", False),
    "v_long": features("v_pred", True),
    "v_long_ic": "SELECT * FROM (" + ic("v_long", "feature, date", "value")
    + ") WHERE rank_ic IS NOT NULL",
    "v_fold_stacked": stacked("v_fold_rows"),
    "v_segments": "SELECT * FROM v_stacked WHERE size_bucket IN ('LARGE', 'MID')",
    "v_regimes": """SELECT date, trailing_return, CASE WHEN trailing_return > 0.1 THEN 'BULL'
        WHEN trailing_return < -0.1 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime
      FROM (SELECT date, close / lag(close, 120) OVER (ORDER BY date) - 1 AS trailing_return
            FROM v_bench WHERE benchmark_key = 'ASIA') AS x""",
    "v_replaced": """SELECT date, model, count(*) FILTER (now AND NOT was) AS entrants,
        count(*) FILTER (was AND NOT now) AS observable_exits,
        avg(target_excess_return) FILTER (now AND NOT was) AS entrant_mean_excess_return,
        avg(target_excess_return) FILTER (was AND NOT now) AS exit_mean_excess_return
      FROM (SELECT a.*, a.selected AS now, b.code IS NOT NULL AS was FROM
              (SELECT *, dense_rank() OVER (ORDER BY date) AS i FROM v_top) a LEFT JOIN
              (SELECT *, dense_rank() OVER (ORDER BY date) AS i FROM v_top) b
              ON b.selected AND a.model = b.model AND a.i = b.i + 1 AND a.code = b.code
            WHERE a.i > 1) AS x
      GROUP BY date, model""",
    "v_selection": """SELECT coalesce(y, 'ALL') AS period, model, grp AS "group",
        avg(forward_return) AS mean_forward_return,
        avg(target_excess_return) AS mean_excess_return,
        avg(CASE WHEN target_excess_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_excess_rate,
        count(*) AS observations, count(DISTINCT date) AS rebalance_dates
      FROM (SELECT *, year(date)::VARCHAR AS y,
              CASE WHEN selected THEN 'selected' ELSE 'not_selected' END AS grp FROM v_top) AS x
      GROUP BY GROUPING SETS ((model, grp), (model, grp, y))""",
    "v_picked": """SELECT model, avg(target_excess_return) FILTER (selected)
          AS selected_mean_excess_return,
        avg(target_excess_return) FILTER (NOT selected) AS remainder_mean_excess_return,
        avg(target_excess_return) FILTER (selected)
          - avg(target_excess_return) FILTER (NOT selected) AS selection_spread,
        count(*) FILTER (selected AND target_excess_return > 0) / count(*) FILTER (selected)
          AS selected_positive_rate
      FROM v_top GROUP BY model""",
}


def ablation_picks(profile: str, k: int) -> str:
    return f"""SELECT scenario,
        avg({T}) FILTER (s) AS {profile}_selected_mean_excess_return,
        avg({T}) FILTER (NOT s) AS {profile}_remainder_mean_excess_return,
        avg({T}) FILTER (s) - avg({T}) FILTER (NOT s) AS {profile}_selection_spread,
        count(*) FILTER (s AND {T} > 0) / count(*) FILTER (s) AS {profile}_selected_positive_rate
      FROM (SELECT *, row_number() OVER (PARTITION BY scenario, date ORDER BY score DESC, code)
              <= {k} AS s FROM v_ablated) AS x GROUP BY scenario"""


QUERIES = {
    "rank_ic_daily": "SELECT * FROM v_ic",
    "factor_report": f"""SELECT feature, o.observations, mean_rank_ic, rank_ic_std,
          rank_ic_ir_annualized, positive_ic_rate
        FROM (SELECT feature, count(value) AS observations FROM v_known_long GROUP BY feature) o
        LEFT JOIN (SELECT feature, avg(rank_ic) AS mean_rank_ic,
            stddev_samp(rank_ic) AS rank_ic_std, {IR} * sqrt(12) AS rank_ic_ir_annualized,
            {POSITIVE} AS positive_ic_rate
          FROM ({ic('v_known_long', 'feature, date', 'value')}) AS d
          WHERE rank_ic IS NOT NULL GROUP BY feature) s USING (feature)""",
    "rank_ic_summary": f"""SELECT fold_id, model, count(*) AS rebalance_dates,
          avg(rank_ic) AS mean_rank_ic, {IR} AS rank_ic_ir, {POSITIVE} AS positive_rank_ic_rate
        FROM ({ic("(SELECT * FROM v_fold_stacked WHERE split = 'test')",
                  "fold_id, model, date", "score")}) AS d
        WHERE rank_ic IS NOT NULL GROUP BY fold_id, model""",
    "segment_model_report": f"""SELECT size_bucket, model, count(*) AS rebalance_dates,
          sum(n_rows)::BIGINT AS observations, avg(rank_ic) AS mean_rank_ic,
          {IR} * sqrt(12) AS rank_ic_ir_annualized,
          avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END)
            AS positive_ic_rate,
          avg(top) AS mean_top_quintile_excess_return,
          avg(CASE WHEN top > 0 THEN 1.0 ELSE 0.0 END) AS top_quintile_positive_rate
        FROM (SELECT size_bucket, model, date, count(*) AS n_rows,
                avg({T}) FILTER (score >= q) AS top
              FROM (SELECT s.*, q FROM v_segments s JOIN (SELECT size_bucket, model, date,
                      quantile_cont(score, 0.8) AS q FROM v_segments GROUP BY ALL) c
                    USING (size_bucket, model, date)) AS x GROUP BY ALL) d
        LEFT JOIN ({ic('v_segments', 'size_bucket, model, date', 'score')}) i
          USING (size_bucket, model, date) GROUP BY size_bucket, model""",
    "factor_year_report": f"""SELECT year, feature, coalesce(rebalance_dates, 0)
            AS rebalance_dates, observations, mean_rank_ic, positive_ic_rate
        FROM (SELECT year(date) AS year, feature, count(value) AS observations
              FROM v_long GROUP BY ALL) o
        LEFT JOIN (SELECT year(date) AS year, feature, count(*) AS rebalance_dates,
              avg(rank_ic) AS mean_rank_ic, {POSITIVE} AS positive_ic_rate
              FROM v_long_ic GROUP BY ALL) s USING (year, feature)""",
    "selection_report": 'SELECT * FROM (SELECT * FROM v_selection) AS x',
    "segment_attribution": """SELECT coalesce(y, 'ALL') AS period, model, size_bucket,
          avg(c) AS average_selected_count, avg(share) AS average_selected_share,
          avg(f) AS mean_forward_return, avg(e) AS mean_excess_return,
          avg(share * f) AS average_forward_return_contribution,
          avg(share * e) AS average_excess_return_contribution, count(*) AS rebalance_dates
        FROM (SELECT model, date, size_bucket, year(date)::VARCHAR AS y, count(*) AS c,
                count(*) / sum(count(*)) OVER (PARTITION BY model, date) AS share,
                avg(forward_return) AS f, avg(target_excess_return) AS e
              FROM v_top WHERE selected GROUP BY model, date, size_bucket) AS d
        GROUP BY GROUPING SETS ((model, size_bucket), (model, size_bucket, y))""",
    "market_regime": """SELECT b.date, regime, trailing_return FROM
          (SELECT DISTINCT date FROM v_bars) b ASOF JOIN v_regimes r ON b.date >= r.date""",
    "market_regime_report": f"""SELECT model, regime, count(*) AS rebalance_dates,
          sum(trailing_return * n_rows) / nullif(sum(n_rows) FILTER (trailing_return IS NOT NULL), 0)
            AS mean_trailing_return,
          avg(rank_ic) AS mean_rank_ic,
          avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END)
            AS positive_ic_rate,
          avg(top) AS selected_mean_excess_return,
          avg(CASE WHEN top > 0 THEN 1.0 ELSE 0.0 END) AS selected_positive_rate
        FROM (SELECT model, date, count(*) AS n_rows, avg({T}) FILTER (selected) AS top
              FROM v_top GROUP BY ALL) d
        JOIN (SELECT p.date, r.regime, r.trailing_return FROM
                (SELECT DISTINCT date FROM v_pred) p ASOF JOIN v_regimes r ON p.date >= r.date) g
          USING (date)
        LEFT JOIN v_ic USING (model, date) GROUP BY model, regime""",
    "replacement_report": """SELECT *, entrant_mean_excess_return - exit_mean_excess_return
          AS replacement_spread FROM v_replaced""",
    "selected_return_summary": "SELECT * FROM v_picked",
    "factor_ablation": f"""SELECT * FROM (SELECT DISTINCT scenario, removed_group,
            remaining_features FROM v_ablated) s
        JOIN (SELECT scenario, count(*) AS rebalance_dates, avg(rank_ic) AS mean_rank_ic,
            {IR} AS rank_ic_ir, {POSITIVE} AS positive_rank_ic_rate
          FROM ({ic('v_ablated', 'scenario, date', 'score')}) AS d WHERE rank_ic IS NOT NULL
          GROUP BY scenario) i USING (scenario)
        JOIN ({ablation_picks('institution', 5)}) a USING (scenario)
        JOIN ({ablation_picks('personal', 2)}) b USING (scenario)""",
}
