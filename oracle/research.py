"""Factors, labels, standardisation, splits and scores in DuckDB SQL."""

from __future__ import annotations

from barloom.config import BASELINE_WEIGHTS, FACTOR_GROUPS, MODEL_FEATURES, RAW_FEATURES

Z = MODEL_FEATURES
MOMENTUM = {"momentum_20_5_z": 0.5, "momentum_60_5_z": 0.5}


def linear(weights: dict[str, float]) -> str:
    scale = sum(abs(w) for w in weights.values())
    return "0.0::DOUBLE" + "".join(f" + {f} * {w / scale!r}::DOUBLE" for f, w in weights.items())


def each(template: str, names=Z, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in names)


FRAMES = """WINDOW w AS (PARTITION BY code ORDER BY date),
 w5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 w20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 w60 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
 w120 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"""

VIEWS = {
    "v_ret": """SELECT *, close / lag(close) OVER w - 1 AS return_1,
        row_number() OVER w AS listing_days, ln(1 + volume) AS act,
        (2 * close - high - low) / nullif(high - low, 0) AS clv
      FROM v_panel WINDOW w AS (PARTITION BY code ORDER BY date)""",
    "v_market": """SELECT date, quantile_cont(return_1, 0.5) AS market_return
      FROM v_ret GROUP BY date""",
    "v_res": """SELECT r.*, market_return, return_1 - market_return AS residual_return,
        abs(return_1) / nullif(amount, 0) * 1000000 AS impact
      FROM v_ret r LEFT JOIN v_market m ON r.date = m.date""",
    "v_fit": f"""SELECT *,
        CASE WHEN count(close) OVER w60 = 60 THEN regr_sxx(ln(close), listing_days) OVER w60 END
          AS sxx,
        CASE WHEN count(close) OVER w60 = 60 THEN regr_syy(ln(close), listing_days) OVER w60 END
          AS syy,
        CASE WHEN count(close) OVER w60 = 60 THEN regr_sxy(ln(close), listing_days) OVER w60 END
          AS sxy
      FROM v_res {FRAMES}""",
    "v_ts1": f"""SELECT *,
        lag(close, 5) OVER w / lag(close, 20) OVER w - 1 AS momentum_20_5,
        lag(close, 5) OVER w / lag(close, 60) OVER w - 1 AS momentum_60_5,
        CASE WHEN sxx IS NULL THEN NULL
             WHEN greatest(syy - sxy * sxy / sxx, 0) = 0 THEN 0
             ELSE sxy / sxx / sqrt(greatest(syy - sxy * sxy / sxx, 0) / 58 / sxx) END
          AS trend_quality_60,
        CASE WHEN count(residual_return) OVER w5 >= 5 THEN -sum(residual_return) OVER w5 END
          AS reversal_5,
        CASE WHEN count(close) OVER w120 >= 120 THEN close / max(close) OVER w120 - 1 END
          AS high_position_120,
        CASE WHEN count(residual_return) OVER w60 >= 40
             THEN stddev_samp(residual_return) OVER w60 END AS idio_vol_60,
        CASE WHEN count(residual_return) OVER w60 >= 40 THEN sqrt(avg(
             CASE WHEN residual_return < 0 THEN residual_return * residual_return
                  WHEN residual_return IS NOT NULL THEN 0 END) OVER w60) END AS downside_vol_60,
        CASE WHEN count(act) OVER w20 >= 15
             THEN (act - avg(act) OVER w20) / nullif(stddev_samp(act) OVER w20, 0) END
          AS volume_z20,
        CASE WHEN count(clv) OVER w5 >= 3 THEN avg(clv) OVER w5 END AS clv_5,
        CASE WHEN count(amount) OVER w20 >= 15 THEN quantile_cont(amount, 0.5) OVER w20 END
          AS median_amount_20,
        CASE WHEN count(impact) OVER w20 >= 15 THEN avg(impact) OVER w20 END AS amihud_20
      FROM v_fit {FRAMES}""",
    "v_ts": f"""SELECT *,
        CASE WHEN count(sign(residual_return) * volume_z20) OVER w5 >= 3
             THEN avg(sign(residual_return) * volume_z20) OVER w5 END
          AS price_volume_confirmation_5
      FROM v_ts1 {FRAMES}""",
    "v_factors": """SELECT *, coalesce(is_trading AND NOT is_st AND is_universe_member
          AND listing_days >= 120 AND median_amount_20 > 0 AND liquidity_percentile > 0.2, false) AS tradable
      FROM (SELECT *, CASE WHEN median_amount_20 IS NOT NULL THEN
              (rank() OVER (PARTITION BY date ORDER BY median_amount_20 NULLS LAST)
               + (count(*) OVER (PARTITION BY date, median_amount_20) - 1) / 2.0)
              / count(median_amount_20) OVER (PARTITION BY date) END AS liquidity_percentile
            FROM v_ts) AS x""",
    "v_fwd": """SELECT *, exit_close / entry_open - 1 AS forward_return FROM (
        SELECT code, date, lead(open, 1) OVER w AS entry_open, lead(close, 20) OVER w AS exit_close,
          lead(date, 20) OVER w AS label_end_date
        FROM v_panel WINDOW w AS (PARTITION BY code ORDER BY date)) AS x""",
    "v_label": """SELECT *, CASE WHEN target_rank IS NOT NULL THEN least(floor(target_rank * 5), 4)::INTEGER END AS relevance FROM (
        SELECT *, CASE WHEN target_excess_return IS NOT NULL THEN
            (rank() OVER (PARTITION BY date ORDER BY target_excess_return NULLS LAST)
             + (count(*) OVER (PARTITION BY date, target_excess_return) - 1) / 2.0)
            / count(target_excess_return) OVER (PARTITION BY date) END AS target_rank
        FROM (SELECT f.*, m.mid AS benchmark_forward_return,
                forward_return - m.mid AS target_excess_return
              FROM v_fwd f LEFT JOIN (SELECT date, quantile_cont(forward_return, 0.5) AS mid
                                      FROM v_fwd GROUP BY date) m ON f.date = m.date) AS y) AS z""",
    "v_month_end": "SELECT max(date) AS date FROM v_panel GROUP BY date_trunc('month', date)",
    "v_frame": """SELECT f.*, l.label_end_date, l.forward_return, l.benchmark_forward_return,
        l.target_excess_return, l.target_rank, l.relevance
      FROM v_factors f JOIN v_label l ON f.date = l.date AND f.code = l.code
      WHERE f.date IN (SELECT date FROM v_month_end)""",
}


def standardize(source: str, name: str) -> dict[str, str]:
    """Views of the standardisation steps; `name` ends up with the raw and `_z` columns."""
    raw_to_z = ", ".join(f"{c}::DOUBLE AS {c}_z" for c in RAW_FEATURES)
    steps = {
        f"{name}_0": f"SELECT *, {raw_to_z} FROM {source} WHERE tradable",
        f"{name}_1": "SELECT x.* REPLACE (" + each(
            "CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}"
        ) + f") FROM {name}_0 x JOIN (SELECT date, " + each(
            "quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}"
        ) + f" FROM {name}_0 GROUP BY date) q ON x.date = q.date",
        f"{name}_2": "SELECT x.* REPLACE (" + each(
            "CASE WHEN (SELECT count(*) FILTER (industry <> 'UNKNOWN') > 0 FROM "
            + f"{name}_0) THEN x.{{c}} - q.{{c}} ELSE x.{{c}} END AS {{c}}"
        ) + f") FROM {name}_1 x JOIN (SELECT date, industry, " + each(
            "quantile_cont({c}, 0.5) AS {c}"
        ) + f" FROM {name}_1 GROUP BY date, industry) q"
        " ON x.date = q.date AND x.industry = q.industry",
        f"{name}_3": "SELECT x.* REPLACE (" + each(
            "CASE WHEN caps >= 10 AND n_{c} >= 10 AND market_cap > 0 THEN {c} - (my_{c}"
            " + coalesce(sxy_{c} / nullif(sxx_{c}, 0), 0) * (ln(market_cap) - mx_{c}))"
            " ELSE {c} END AS {c}"
        ) + f") FROM {name}_2 x JOIN (SELECT date, count(market_cap) AS caps, " + each(
            "regr_count({c}, ln(market_cap)) AS n_{c}, regr_sxx({c}, ln(market_cap)) AS sxx_{c},"
            " regr_sxy({c}, ln(market_cap)) AS sxy_{c}, regr_avgx({c}, ln(market_cap)) AS mx_{c},"
            " regr_avgy({c}, ln(market_cap)) AS my_{c}"
        ) + f" FROM {name}_2 GROUP BY date) q ON x.date = q.date",
        f"{name}_4": "SELECT x.*, " + each("abs({c} - med_{c}) AS dev_{c}, med_{c}")
        + f" FROM {name}_3 x JOIN (SELECT date, " + each("quantile_cont({c}, 0.5) AS med_{c}")
        + f" FROM {name}_3 GROUP BY date) q ON x.date = q.date",
        name: "SELECT x.* REPLACE (" + each(
            "CASE WHEN mad_{c} > 0 THEN CASE WHEN {c} IS NOT NULL THEN"
            " least(greatest(({c} - med_{c}) / (1.4826 * mad_{c}), -8), 8) END"
            " WHEN std_{c} > 0 THEN CASE WHEN {c} IS NOT NULL THEN"
            " least(greatest(({c} - mean_{c}) / std_{c}, -8), 8) END ELSE 0 END AS {c}"
        ) + f") FROM {name}_4 x JOIN (SELECT date, " + each(
            "quantile_cont(dev_{c}, 0.5) AS mad_{c}, avg({c}) AS mean_{c},"
            " stddev_pop({c}) AS std_{c}"
        ) + f" FROM {name}_4 GROUP BY date) q ON x.date = q.date",
    }
    return steps


VIEWS.update(standardize("v_frame", "v_std"))
VIEWS["v_last_frame"] = "SELECT * FROM v_frame WHERE date = (SELECT max(date) FROM v_frame)"
VIEWS.update(standardize("v_last_frame", "v_last"))
VIEWS["v_dataset"] = (
    "SELECT * FROM v_std WHERE target_rank IS NOT NULL AND label_end_date IS NOT NULL AND "
    + each("{c} IS NOT NULL", sep=" AND ")
)
VIEWS["v_pred"] = (
    f"SELECT *, {linear(BASELINE_WEIGHTS)} AS baseline_score, {linear(MOMENTUM)} AS momentum_score"
    " FROM v_dataset"
)
VIEWS["v_splits"] = """SELECT
    max(date) FILTER (i = vi) AS validation_start, max(date) FILTER (i = ti) AS test_start
  FROM (SELECT *, least(greatest(vi + 1, floor(c * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT), c - 1)
          AS ti
        FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS c,
                greatest(1, floor(count(*) OVER () * 0.6::DOUBLE)::BIGINT) AS vi
              FROM (SELECT DISTINCT date FROM v_dataset) AS d) AS n) AS m"""
VIEWS["v_fold_dates"] = """SELECT date, row_number() OVER (ORDER BY date) - 1 AS i,
    count(*) OVER () AS c FROM (SELECT DISTINCT date FROM v_dataset) AS d"""
# 24 training, 6 validation and 6 test months, expanding.
VIEWS["v_folds"] = """SELECT k + 1 AS fold_id, 30 + k * 6 AS t0, least(30 + k * 6 + 6, c) AS t1,
    24 + k * 6 AS v0
  FROM (SELECT DISTINCT c FROM v_fold_dates) AS s, range(0, 1000) AS r(k) WHERE 30 + k * 6 < c"""
VIEWS["v_fold_bounds"] = """SELECT fold_id, min(date) AS train_start,
    max(date) FILTER (i < v0) AS train_end, min(date) FILTER (i >= v0) AS validation_start,
    max(date) FILTER (i < t0) AS validation_end, min(date) FILTER (i >= t0) AS test_start,
    max(date) FILTER (i < t1) AS test_end
  FROM v_folds, v_fold_dates WHERE i < t1 GROUP BY fold_id"""
VIEWS["v_fold_rows"] = """SELECT * FROM (
    SELECT p.*, b.fold_id, CASE WHEN p.date <= train_end AND label_end_date < validation_start
        THEN 'train' WHEN p.date BETWEEN validation_start AND validation_end
          AND label_end_date < test_start THEN 'validation'
        WHEN p.date BETWEEN test_start AND test_end THEN 'test' END AS split
    FROM v_pred p, v_fold_bounds b WHERE p.date BETWEEN train_start AND test_end) AS x
  WHERE split IS NOT NULL"""

QUERIES = {
    "daily_returns": "SELECT * FROM v_res",
    "momentum_factors": "SELECT * FROM v_ts",
    "trend_quality": "SELECT * FROM v_ts",
    "reversal_factor": "SELECT * FROM v_ts",
    "high_position": "SELECT * FROM v_ts",
    "risk_factors": "SELECT * FROM v_ts",
    "activity_factors": "SELECT * FROM v_ts",
    "clv_factor": "SELECT * FROM v_ts",
    "liquidity_factors": "SELECT * FROM v_factors",
    "tradable_universe": "SELECT * FROM v_factors",
    "raw_factors": "SELECT * FROM v_factors",
    "forward_labels": "SELECT * FROM v_label",
    "month_end_sample": "SELECT * FROM v_bars WHERE date IN (SELECT max(date) FROM v_bars "
    "GROUP BY date_trunc('month', date))",
    "winsorize": "SELECT * FROM v_std_1",
    "neutralize": "SELECT * FROM v_std_3",
    "robust_zscore": "SELECT * FROM (SELECT *, (momentum_60_5 - med) / (1.4826 * mad) AS z_raw,"
    " (momentum_60_5 - mean) / nullif(std, 0) AS z_std, CASE WHEN mad > 0 THEN CASE WHEN"
    " momentum_60_5 IS NOT NULL THEN least(greatest((momentum_60_5 - med) / (1.4826 * mad), -8), 8)"
    " END WHEN std > 0 THEN CASE WHEN momentum_60_5 IS NOT NULL THEN least(greatest("
    "(momentum_60_5 - mean) / std, -8), 8) END ELSE 0 END AS z FROM (SELECT x.*, s.mean, s.std,"
    " s.mad FROM (SELECT f.date, f.code, f.momentum_60_5, m.med FROM v_frame f JOIN (SELECT date,"
    " quantile_cont(momentum_60_5, 0.5) AS med FROM v_frame GROUP BY date) m ON f.date = m.date) x"
    " JOIN (SELECT f.date, avg(momentum_60_5) AS mean, stddev_pop(momentum_60_5) AS std,"
    " quantile_cont(abs(momentum_60_5 - med), 0.5) AS mad FROM v_frame f JOIN (SELECT date,"
    " quantile_cont(momentum_60_5, 0.5) AS med FROM v_frame GROUP BY date) m ON f.date = m.date"
    " GROUP BY f.date) s ON x.date = s.date) AS y) AS q",
    "standardized_factors": "SELECT * FROM v_std",
    "research_dataset": "SELECT * FROM v_dataset",
    "purged_split": """SELECT date, code, CASE
          WHEN date < validation_start AND label_end_date < validation_start THEN 'train'
          WHEN date >= validation_start AND date < test_start AND label_end_date < test_start
            THEN 'validation'
          WHEN date >= test_start THEN 'test' ELSE 'purged' END AS split
        FROM v_dataset, v_splits""",
    "walk_forward_folds": "SELECT fold_id, split, date, code FROM v_fold_rows",
    "fold_summary": """SELECT b.fold_id, train_start, train_end,
          max(date) FILTER (split = 'train') AS effective_train_end_after_purge,
          validation_start, validation_end,
          max(date) FILTER (split = 'validation') AS effective_validation_end_after_purge,
          test_start, test_end, count(*) FILTER (split = 'train') AS train_rows,
          count(*) FILTER (split = 'validation') AS validation_rows,
          count(*) FILTER (split = 'test') AS test_rows
        FROM v_fold_bounds b JOIN v_fold_rows r ON b.fold_id = r.fold_id GROUP BY ALL""",
    "fold_overlap": """SELECT count(*) AS predictions, count(DISTINCT (date, code)) AS keys,
          count(*) - count(DISTINCT (date, code)) AS overlapping
        FROM v_fold_rows WHERE split = 'test'""",
    "baseline_scores": "SELECT * FROM v_pred",
    "walk_forward_scores": "SELECT * FROM v_fold_rows WHERE split = 'test'",
    "score_ranks": """SELECT date, code, row_number() OVER (PARTITION BY date
          ORDER BY baseline_score DESC, code) AS baseline_rank, row_number() OVER
          (PARTITION BY date ORDER BY momentum_score DESC, code) AS momentum_rank FROM v_pred""",
    "top_k_per_date": """SELECT * FROM (SELECT date, code, baseline_score, row_number() OVER
          (PARTITION BY date ORDER BY baseline_score DESC, code) AS rank FROM v_pred) AS x
        WHERE rank <= 5""",
}
_parts = ", ".join(
    f"({{'o': -({f} * {w!r}::DOUBLE), 'i': {i}, 'l': '{f.removesuffix('_z')}'}})"
    for i, (f, w) in enumerate(BASELINE_WEIGHTS.items())
)
REASONS = (
    f"list_sort([{_parts}])[1].l AS baseline_reason_1,"
    f" list_sort([{_parts}])[2].l AS baseline_reason_2"
)
QUERIES["score_reasons"] = f"SELECT date, code, {REASONS}, " + ", ".join(
    f"{f} * {w!r}::DOUBLE AS {f}_contribution" for f, w in BASELINE_WEIGHTS.items()
) + " FROM v_pred"
QUERIES["latest_scores"] = (
    "SELECT date, code, security_name, size_bucket, industry, baseline_score, row_number() OVER"
    " (PARTITION BY date ORDER BY baseline_score DESC, code) AS baseline_rank, baseline_reason_1,"
    " baseline_reason_2, " + ", ".join(RAW_FEATURES)
    + f" FROM (SELECT *, {linear(BASELINE_WEIGHTS)} AS baseline_score, {REASONS} FROM v_last"
    " WHERE " + each("{c} IS NOT NULL", sep=" AND ") + ") AS x"
)


def ablated() -> str:
    parts = []
    for group, removed in {"none": [], **FACTOR_GROUPS}.items():
        kept = {f: w for f, w in BASELINE_WEIGHTS.items() if f not in removed}
        name = "full_model" if group == "none" else f"remove_{group}"
        parts.append(
            f"SELECT '{name}' AS scenario, '{group}' AS removed_group, {len(kept)}"
            f" AS remaining_features, date, code, target_excess_return, {linear(kept)} AS score"
            " FROM v_fold_rows WHERE split = 'test'"
        )
    return " UNION ALL ".join(parts)


VIEWS["v_ablated"] = ablated()
