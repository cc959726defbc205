"""Tables written and read back: what the readers must return."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

QUERIES = {
    "load_benchmarks": "SELECT date, benchmark_key, close FROM v_bench",
    "load_membership": """SELECT code, effective_from, effective_to, size_bucket,
        'point_in_time' AS membership_mode FROM v_members""",
    "load_industry_history": "SELECT * FROM v_industry WHERE code IN (SELECT code FROM v_master)",
    "load_positions": """SELECT code, (sum(quantity) % 10)::BIGINT AS quantity FROM v_fills
        GROUP BY code HAVING sum(quantity) % 10 > 0""",
    "load_predictions": "SELECT date, code, label_end_date, baseline_score FROM v_pred",
    "signal_table": """SELECT date, code, industry, size_bucket, tradable, baseline_score AS score
        FROM v_pred""",
    "resolve_constituents": """SELECT snapshot_date, '000005' AS index_code, code,
        'S' || code AS security_name FROM v_snapshots""",
}
