"""Fixture views, cleaning, point-in-time joins, feeds and data-quality reports in DuckDB SQL."""

from __future__ import annotations

PAD = "CASE WHEN length({0}::VARCHAR) < 6 THEN lpad({0}::VARCHAR, 6, '0') ELSE {0}::VARCHAR END"
SEQ = "(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)"
START, END = "DATE '1996-01-01'", "DATE '2001-06-30'"


def bars(source: str, extra: str = "") -> str:
    return (
        f"SELECT code, date{extra}, arg_min(price, seq) AS open, max(price) AS high,"
        " min(price) AS low, arg_max(price, seq) AS close, sum(l_quantity) AS volume,"
        f" round(sum(l_extendedprice), 2) AS amount FROM {source} GROUP BY code, date{extra}"
    )


def symbol(x: str) -> str:
    text = (
        f"regexp_replace(regexp_replace(regexp_replace(upper(trim(({x})::VARCHAR)), '\\.0$', ''),"
        " '^(SH|SZ|BJ)\\.', ''), '\\.(SH|SZ|BJ)$', '')"
    )
    return (
        f"CASE WHEN regexp_full_match({text}, '\\d{{1,6}}') THEN lpad({text}, 6, '0')"
        f" ELSE {text} END"
    )


def exchange(code: str) -> str:
    return (
        f"CASE WHEN left({code}, 1) IN ('4', '8') OR left({code}, 2) = '92' THEN 'BSE'"
        f" WHEN left({code}, 1) IN ('0', '3') THEN 'SZSE' WHEN left({code}, 1) = '6' THEN 'SSE'"
        " ELSE 'UNKNOWN' END"
    )


def board(code: str) -> str:
    return (
        f"CASE WHEN left({code}, 3) IN ('300', '301') THEN 'CHINEXT'"
        f" WHEN left({code}, 3) IN ('688', '689') THEN 'STAR'"
        f" WHEN {exchange(code)} = 'BSE' THEN 'BSE'"
        f" WHEN {exchange(code)} IN ('SSE', 'SZSE') THEN 'MAIN' ELSE 'UNKNOWN' END"
    )


def classify(order: str) -> str:
    key = "(coalesce(change_date, DATE '9999-12-31'), l_orderkey, l_linenumber, l_partkey," \
        " l_extendedprice)" if order == "latest" else \
        "(l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
    pick = "arg_max" if order == "latest" else "arg_min"
    return (
        f"SELECT code, '{order}' AS kind, trim({pick}(p_brand, row{key})) AS industry_code,"
        f" trim({pick}(p_type, row{key})) AS industry_name, {START} AS effective_from,"
        " false AS is_point_in_time FROM (SELECT t.*, date AS change_date, p_brand, p_type"
        " FROM v_trades t JOIN part ON l_partkey = p_partkey) AS x"
        " GROUP BY code"
    )


VIEWS = {
    "v_trades": f"""SELECT {PAD.format("l_suppkey")} AS code, l_shipdate::DATE AS date,
        l_extendedprice / l_quantity AS price, row{SEQ} AS seq, lineitem.* FROM lineitem""",
    "v_bars": bars("v_trades"),
    "v_master": f"""SELECT {PAD.format("s_suppkey")} AS code, s_name AS security_name,
        r_name AS industry, n_name AS nation,
        CASE WHEN s_acctbal >= 6300 THEN 'LARGE' WHEN s_acctbal >= 2600 THEN 'MID'
             ELSE 'SMALL' END AS size_bucket,
        s_acctbal < 0 AS is_st, abs(s_acctbal) + 1 AS shares
      FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey)
        ON s_nationkey = n_nationkey""",
    "v_panel": """SELECT b.*, security_name, industry, is_st,
        volume > 0 AND amount > 0 AS is_trading, shares * close AS market_cap, 100 AS lot_size
      FROM v_pit_member b LEFT JOIN v_master m ON b.code = m.code""",
    "v_bench": """SELECT date, industry AS benchmark_key,
        round(sum(l_extendedprice), 2) / sum(l_quantity) AS close
      FROM v_trades t JOIN v_master m ON t.code = m.code GROUP BY ALL""",
    "v_nav": """SELECT *, nav * share AS cash FROM (
        SELECT nation AS portfolio_id, industry AS profile, date,
          900000 + 1000 * sqrt(round(sum(l_extendedprice), 2) / sum(l_quantity)) AS nav,
          round(avg(l_discount), 8) AS share
        FROM v_trades t JOIN v_master m ON t.code = m.code GROUP BY ALL) AS x""",
    "v_dirty": f"""SELECT date, code, open, high,
        CASE WHEN batch = 1 AND volume < 4 THEN high * 2 ELSE low END AS low, close,
        CASE WHEN batch = 1 AND volume > 45 THEN -volume ELSE volume END AS volume,
        CASE WHEN amount <= 250000 THEN amount END AS amount,
        CASE WHEN batch = 1 THEN volume > 20 AND volume <= 45 END AS is_trading, batch
      FROM (SELECT *, 0 AS batch FROM v_bars UNION ALL SELECT *, 1 AS batch FROM
            ({bars("(SELECT * FROM v_trades WHERE l_returnflag = 'R')")})) AS x""",
    "v_checked": """SELECT *, count(*) OVER (PARTITION BY code, date) AS copies,
        coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND amount >= 0
          AND high >= greatest(open, close, low) AND low <= least(open, close, high), false)
          AS valid
      FROM v_dirty QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY batch DESC) = 1""",
    "v_snapshots": """SELECT max_date AS snapshot_date, code,
        CASE WHEN volume >= 230 THEN 'LARGE' WHEN volume >= 140 THEN 'MID' ELSE 'SMALL' END
          AS size_bucket
      FROM (SELECT code, date_trunc('month', date) AS m, sum(volume) AS volume
            FROM v_bars GROUP BY ALL) v
      JOIN (SELECT date_trunc('month', date) AS m, max(date) AS max_date
            FROM v_bars GROUP BY ALL) c USING (m) WHERE volume >= 62""",
    "v_snapdates": """SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS i,
        (lead(snapshot_date) OVER (ORDER BY snapshot_date) - 1)::DATE AS until
      FROM (SELECT DISTINCT snapshot_date FROM v_snapshots) AS x""",
    "v_members": """SELECT code, min(snapshot_date) AS effective_from,
        arg_max(coalesce(until, DATE '9999-12-31'), i) AS until_date,
        NULLIF(arg_max(coalesce(until, DATE '9999-12-31'), i), DATE '9999-12-31') AS effective_to,
        any_value(size_bucket) AS size_bucket, 'S' || code AS security_name
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY code ORDER BY i) AS run FROM (
              SELECT s.*, i, until, CASE WHEN lag(i) OVER w = i - 1
                AND lag(size_bucket) OVER w = size_bucket THEN 0 ELSE 1 END AS fresh
              FROM v_snapshots s JOIN v_snapdates USING (snapshot_date)
              WINDOW w AS (PARTITION BY code ORDER BY i)) AS a) AS b
      GROUP BY code, run""",
    "v_industry": """SELECT code, effective_from,
        (lead(effective_from) OVER (PARTITION BY code ORDER BY effective_from) - 1)::DATE
          AS effective_to, industry_code, industry_name, 'SW' AS industry_standard, pit
          AS is_point_in_time
      FROM (SELECT code, date_trunc('year', date)::DATE AS effective_from,
              min(p_brand) AS industry_code, max(p_brand) AS industry_name,
              count(*) FILTER (p_brand = 'Brand#9') = 0 AS pit
            FROM v_trades JOIN part ON l_partkey = p_partkey GROUP BY ALL) AS x""",
    "v_pit_member": """SELECT b.*, i.code IS NOT NULL AS is_universe_member,
        coalesce(i.size_bucket, 'UNKNOWN') AS size_bucket
      FROM v_bars b LEFT JOIN v_members i ON b.code = i.code
        AND b.date BETWEEN effective_from AND until_date
      WHERE b.code IN (SELECT code FROM v_members)""",
    "v_pit_industry": """SELECT b.*, coalesce(industry_name, 'UNKNOWN') AS industry, industry_code,
        coalesce(is_point_in_time, false) AS industry_is_point_in_time
      FROM v_bars b LEFT JOIN v_industry i ON b.code = i.code AND b.date >= effective_from
        AND (effective_to IS NULL OR b.date <= effective_to)""",
    "v_status": """SELECT code, date, CASE WHEN tax >= 0.02 THEN open * 0.98 END AS preclose,
        tax < 0.07 AS is_trading, flag = 'R' AND tax = 0.03 AS is_st
      FROM (SELECT code, date, arg_min(price, seq) AS open, max(l_linestatus) AS state,
              max(l_tax) AS tax, min(l_returnflag) AS flag FROM v_trades GROUP BY ALL) AS x
      WHERE state = 'O' AND code IN (SELECT """ + PAD.format("s_suppkey")
    + """ FROM supplier WHERE s_acctbal >= 1000)""",
    "v_raw": """SELECT b.*, turnover FROM v_bars b JOIN (SELECT code, date,
        round(avg(l_discount), 8) AS turnover FROM v_trades GROUP BY ALL) t USING (code, date)""",
    "v_adjusted": """SELECT code, date, open * f AS open, high * f AS high, low * f AS low,
        close * f AS close, volume, amount
      FROM (SELECT *, CASE WHEN date < DATE '1998-01-01' THEN 0.9::DOUBLE ELSE 1 END AS f
            FROM v_bars WHERE volume < 128) AS x""",
    "v_listed": f"""SELECT code, security_name, {exchange("code")} AS exchange,
        {board("code")} AS board, 'STOCK' AS instrument_type, is_st AS is_st_current
      FROM v_master""",
    "v_matched": f"""SELECT * FROM (
        SELECT *, count(*) FILTER (close IS NULL OR raw_close IS NULL) OVER (PARTITION BY code)
          AS unmatched
        FROM (SELECT code, date, open AS raw_open, high AS raw_high, low AS raw_low,
                close AS raw_close, volume, amount, turnover FROM v_raw
              WHERE date BETWEEN {START} AND {END}) r
        FULL JOIN (SELECT code, date, open, high, low, close FROM v_adjusted
                   WHERE date BETWEEN {START} AND {END}) a USING (code, date)) AS x
      WHERE unmatched <= 1 AND close IS NOT NULL AND raw_close IS NOT NULL""",
    "v_assembled": """SELECT *, round_even(preclose * (1 + limit_rate) * 100, 0) / 100 AS limit_up,
        round_even(preclose * (1 - limit_rate) * 100, 0) / 100 AS limit_down,
        preclose IS NOT NULL AND status_is_point_in_time AS limit_rule_is_point_in_time,
        CASE WHEN turnover > 0 AND volume > 0 THEN volume / turnover * raw_close END AS market_cap,
        CASE WHEN turnover > 0 AND volume > 0 THEN 'turnover_implied_float_market_cap'
             ELSE 'UNAVAILABLE' END AS market_cap_source
      FROM (SELECT *, CASE WHEN is_st THEN 0.05::DOUBLE WHEN board = 'STAR' THEN 0.2
              WHEN board = 'CHINEXT' AND date >= DATE '2020-08-24' THEN 0.2
              WHEN board = 'BSE' THEN 0.3 ELSE 0.1 END AS limit_rate
            FROM (SELECT m.code, m.date, open, high, low, close, raw_open, raw_high, raw_low,
                    raw_close, volume, amount, turnover, exchange, board, instrument_type,
                    close / raw_close AS adjustment_factor, 100 AS lot_size,
                    s.code IS NOT NULL AS status_is_point_in_time,
                    coalesce(s.is_st, is_st_current) AS is_st,
                    volume > 0 AND amount > 0 AND (coalesce(s.is_trading, false)
                      OR NOT (count(s.code) OVER (PARTITION BY m.code) > 0)) AS is_trading,
                    coalesce(preclose, lag(raw_close) OVER (PARTITION BY m.code ORDER BY m.date))
                      AS preclose,
                    CASE WHEN s.code IS NOT NULL THEN 'history_k_data'
                      WHEN count(s.code) OVER (PARTITION BY m.code) = 0
                      THEN 'current_master_fallback' END AS status_source
                  FROM v_matched m JOIN v_listed USING (code)
                  LEFT JOIN v_status s ON m.code = s.code AND m.date = s.date) AS a) AS b""",
    "v_actions": """SELECT code, ex_date, round(sum(cash), 10) AS cash_dividend_per_share,
        round(sum(bonus), 10) AS bonus_share_ratio, round(sum(rights), 10) AS rights_share_ratio,
        max(price) AS rights_price, string_agg(DISTINCT src, '+' ORDER BY src) AS source
      FROM (SELECT code, date AS ex_date, round(l_tax * 10, 4) / 10 AS cash,
              (round(l_discount * 10, 4) + CASE WHEN l_linenumber > 3 THEN 0.5 ELSE 0 END) / 10
                AS bonus, 0.0::DOUBLE AS rights, NULL::DOUBLE AS price, 'dividend_feed' AS src
            FROM v_trades WHERE l_returnflag = 'A'
            UNION ALL
            SELECT code, date, 0, 0, round(l_discount * 10, 4) / 10, price, 'rights_feed'
            FROM v_trades WHERE l_returnflag = 'R' AND l_quantity > 1) AS x
      GROUP BY code, ex_date""",
    "v_listings": f"""SELECT raw, name, c_custkey, {symbol("raw")} AS code FROM (
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '*st ' || c_name
            WHEN c_acctbal > 9000 THEN 'SST' || c_name ELSE c_name END AS name,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'sh.' || plain WHEN 'AUTOMOBILE'
            THEN plain || '.SZ' WHEN 'MACHINERY' THEN plain || '.0'
            WHEN 'HOUSEHOLD' THEN '  ' || c_custkey || ' ' ELSE 'X' || plain END AS raw
        FROM (SELECT customer.*, ['600', '300', '688', '830', '510'][n_regionkey + 1]
                || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS plain
              FROM customer JOIN nation ON c_nationkey = n_nationkey) AS x) AS y""",
    "v_stored": "SELECT * FROM v_assembled UNION ALL SELECT * FROM v_assembled WHERE volume > 124",
    "v_audit": """SELECT code, CASE WHEN error IS NOT NULL THEN 'FAIL' WHEN n_rows < 120
          THEN 'WARN' ELSE 'PASS' END AS status, error, n_rows AS rows, start_date, end_date,
        pit, cap, pit / n_rows AS point_in_time_status_coverage,
        cap / n_rows AS market_cap_coverage
      FROM (SELECT code, count(*) AS n_rows, min(date) AS start_date, max(date) AS end_date,
              CASE WHEN count(*) > count(DISTINCT date) THEN 'duplicate date/code rows'
                WHEN min(least(open, high, low, close, raw_open, raw_high, raw_low, raw_close)) <= 0
                THEN 'non-positive or missing adjusted/raw prices' END AS error,
              count(*) FILTER (status_is_point_in_time) AS pit,
              count(*) FILTER (market_cap > 0) AS cap
            FROM v_stored GROUP BY code) AS x""",
    "v_orphans": """SELECT code, 'MASTER_WITHOUT_BARS' AS problem FROM v_listed
        WHERE code NOT IN (SELECT code FROM v_assembled)
      UNION ALL SELECT DISTINCT code, 'BARS_WITHOUT_MASTER' FROM v_assembled
        WHERE code NOT IN (SELECT code FROM v_listed)""",
    "v_audit_summary": """SELECT failures = 0 AS passed, * FROM (
        SELECT count(*) AS symbols, sum(rows) FILTER (status <> 'FAIL')::BIGINT AS rows,
          min(start_date) FILTER (status <> 'FAIL') AS start_date,
          max(end_date) FILTER (status <> 'FAIL') AS end_date,
          (SELECT string_agg(DISTINCT benchmark_key, '+' ORDER BY benchmark_key) FROM v_bench)
            AS benchmarks,
          count(*) FILTER (status = 'FAIL') + (SELECT count(DISTINCT problem) FROM v_orphans)
            + (SELECT max((exchange = 'UNKNOWN')::INTEGER) FROM v_listed)
            + (SELECT (count(DISTINCT benchmark_key) < 5)::INTEGER FROM v_bench) AS failures,
          count(*) FILTER (status = 'WARN') AS warnings,
          (SELECT count(DISTINCT code) FROM v_industry) AS industry_history_symbols,
          (SELECT count(*) FROM v_actions) AS corporate_action_rows,
          sum(pit) FILTER (status <> 'FAIL') / sum(rows) FILTER (status <> 'FAIL')
            AS point_in_time_status_coverage,
          sum(cap) FILTER (status <> 'FAIL') / sum(rows) FILTER (status <> 'FAIL')
            AS market_cap_coverage
        FROM v_audit) AS x""",
    "v_active": f"""SELECT code, arg_max(size_bucket, effective_from) AS size_bucket
      FROM v_members WHERE {END} BETWEEN effective_from AND until_date GROUP BY code""",
    "v_gates": f"""SELECT true AS point_in_time_membership,
        large_members >= 270 AND mid_members >= 450 AS universe_completeness,
        failed = 0 AND status_full AS historical_security_status,
        (SELECT count(*) = (SELECT count(*) FROM v_listed) FROM v_listed l
          JOIN (SELECT code, min(effective_from) AS known FROM v_industry WHERE is_point_in_time
                GROUP BY code) i USING (code)
          LEFT JOIN (SELECT code, min(effective_from) AS first FROM v_members GROUP BY code) m
            USING (code)
          WHERE known <= greatest({START}, coalesce(first, {START}))) AS point_in_time_industry,
        true AS historical_industry_required,
        (SELECT count(*) > 0 FROM v_actions) AS corporate_actions,
        failed = 0 AS raw_and_adjusted_prices,
        (SELECT count(DISTINCT benchmark_key) = 5 FROM v_bench) AS required_benchmarks,
        (SELECT passed FROM v_audit_summary) AS storage_audit_passed, large_members, mid_members
      FROM (SELECT (SELECT count(*) FROM v_active WHERE size_bucket = 'LARGE') AS large_members,
              (SELECT count(*) FROM v_active WHERE size_bucket = 'MID') AS mid_members,
              count(*) FILTER (status = 'FAIL') AS failed,
              bool_and(point_in_time_status_coverage = 1) AS status_full FROM v_audit) AS x""",
}

QUERIES = {
    "load_bars": """SELECT m.*, i.industry, i.industry_is_point_in_time,
          m.volume > 0 AND m.amount > 0 AS is_trading, 100 AS lot_size
        FROM v_pit_member m JOIN v_pit_industry i ON m.code = i.code AND m.date = i.date""",
    "load_actions": "SELECT * FROM v_actions",
    "corporate_actions": f"SELECT * FROM v_actions WHERE ex_date BETWEEN {START} AND {END}",
    "normalize_symbol": f"""SELECT raw, code, {exchange("code")} AS exchange,
        {board("code")} AS board FROM v_listings""",
    "security_master": f"""SELECT code, trim(arg_max(name, c_custkey)) AS security_name,
          {exchange("code")} AS exchange, {board("code")} AS board, 'STOCK' AS instrument_type,
          regexp_matches(trim(arg_max(name, c_custkey)), '^(\\*?ST|S\\*?ST)', 'i')
            AS is_st_current, 'listing' AS source
        FROM v_listings WHERE regexp_full_match(code, '\\d{{6}}') AND {exchange("code")} <> 'UNKNOWN'
        GROUP BY code""",
    "clean_bars": """SELECT *, false AS is_st, 'UNKNOWN' AS industry, 100 AS lot_size FROM (
          SELECT * REPLACE (coalesce(is_trading, false) AS is_trading) FROM v_checked
          WHERE valid) AS x""",
    "data_quality": """SELECT count(*) FILTER (valid) AS rows,
          count(DISTINCT code) FILTER (valid) AS symbols, min(date) FILTER (valid) AS start_date,
          max(date) FILTER (valid) AS end_date,
          (SELECT count(*) FROM v_dirty) - count(*) AS duplicate_rows_removed,
          count(*) FILTER (NOT valid) AS invalid_rows_removed,
          count(*) FILTER (valid AND NOT coalesce(is_trading, false)) AS non_trading_rows
        FROM v_checked""",
    "upsert_bars": f"""SELECT code, date, open, high, low, close, volume, amount FROM (
          SELECT *, 1 AS b FROM v_adjusted WHERE date >= {START}
          UNION ALL SELECT code, date, open, high, low, close, volume, amount, 0 FROM v_bars) AS x
        QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY b DESC) = 1""",
    "upsert_store": f"""SELECT code, date, open, high, low, close, volume, amount FROM (
          SELECT *, 1 AS b FROM v_adjusted WHERE date >= {START}
          UNION ALL SELECT code, date, open, high, low, close, volume, amount, 0 FROM v_bars) AS x
        QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY b DESC) = 1""",
    "vendor_history": """SELECT kind, code, date, open, high, low, close,
          CASE WHEN kind = 'stock' THEN volume WHEN volume <= 60 THEN amount END AS volume,
          CASE WHEN kind = 'index' THEN 0 WHEN volume <= 60 THEN amount END AS amount,
          turnover / 100 AS turnover
        FROM (SELECT 'stock' AS kind UNION ALL SELECT 'index') k, v_bars
        JOIN (SELECT code, date, round(avg(l_discount) * 100, 6) AS turnover FROM v_trades
              GROUP BY ALL) t USING (code, date)""",
    "source_priority": f"""SELECT code, date, ['eastmoney', 'sina', 'tencent'][p] AS
          source_endpoint, close, volume
        FROM (SELECT *, min(p) OVER (PARTITION BY code, date_trunc('month', date)) AS best
              FROM ({bars("(SELECT *, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END"
                          " AS p FROM v_trades)", ", p")}) AS b) AS x WHERE p = best""",
    "latest_industry": f"{classify('latest')} UNION ALL {classify('first')}",
    "benchmark_series": f"""SELECT date, benchmark_key,
          CASE WHEN date >= {START} THEN close + 1 ELSE close END AS close,
          (SELECT greatest({START}, min(date)) FROM v_bench) AS expected_start,
          (SELECT least({END}, max(date)) FROM v_bench) AS expected_end FROM v_bench""",
    "membership_rules": """SELECT count(*) AS intervals,
          count(*) FILTER (NOT regexp_full_match(code, '\\d{6}')) AS invalid_codes,
          count(*) FILTER (effective_to < effective_from) AS reversed_intervals,
          0 AS invalid_buckets, count(*) FILTER (effective_to IS NULL) AS open_intervals
        FROM v_members""",
    "membership_intervals": "SELECT * FROM v_members",
    "pit_membership": "SELECT * FROM v_pit_member",
    "snapshot_membership": """SELECT b.code, b.date, m.size_bucket FROM v_bars b JOIN (
          SELECT code, arg_max(size_bucket, effective_from) AS size_bucket FROM v_members
          GROUP BY code) m USING (code)""",
    "industry_history": "SELECT * FROM v_industry WHERE code IN (SELECT code FROM v_master)",
    "pit_industry": "SELECT * FROM v_pit_industry",
    "status_enrich": """SELECT r.code, r.date, coalesce(s.is_st, l.is_st_current) AS is_st,
          volume > 0 AND amount > 0 AND (coalesce(s.is_trading, false)
            OR count(s.code) OVER w = 0) AS is_trading,
          s.code IS NOT NULL AS status_is_point_in_time,
          CASE WHEN s.code IS NOT NULL THEN 'history_k_data' WHEN count(s.code) OVER w = 0
            THEN 'current_master_fallback' END AS status_source,
          coalesce(preclose, lag(close) OVER (PARTITION BY r.code ORDER BY r.date)) AS preclose
        FROM v_raw r LEFT JOIN v_status s ON r.code = s.code AND r.date = s.date
        LEFT JOIN v_listed l ON r.code = l.code WINDOW w AS (PARTITION BY r.code)""",
    "market_cap": """SELECT code, date, CASE WHEN turnover > 0 THEN volume / turnover END
          AS float_shares_estimate,
          CASE WHEN turnover > 0 THEN volume / turnover * close END AS market_cap,
          CASE WHEN turnover > 0 THEN 'turnover_implied_float_market_cap' ELSE 'UNAVAILABLE' END
            AS market_cap_source FROM v_raw""",
    "price_limits": "SELECT * FROM v_assembled",
    "assemble_bars": "SELECT * FROM v_assembled",
    "audit_symbols": "SELECT * FROM v_audit",
    "audit_coverage": f"""SELECT code, 'MASTER_WITHOUT_BARS' AS problem FROM (SELECT DISTINCT code
            FROM v_listings WHERE regexp_full_match(code, '\\d{{6}}')
              AND {exchange("code")} <> 'UNKNOWN') AS l
          WHERE code NOT IN (SELECT code FROM v_assembled)
        UNION ALL SELECT DISTINCT code, 'BARS_WITHOUT_MASTER' FROM v_assembled
          WHERE code NOT IN (SELECT code FROM v_listings
            WHERE regexp_full_match(code, '\\d{{6}}') AND {exchange("code")} <> 'UNKNOWN')""",
    "audit_summary": "SELECT * FROM v_audit_summary",
    "quality_gates": f"""SELECT *, CASE WHEN research_ready THEN 'FORMAL' WHEN
            universe_completeness AND raw_and_adjusted_prices AND required_benchmarks
            AND storage_audit_passed THEN 'LIMITED_RESEARCH' ELSE 'ENGINEERING_ONLY' END
            AS evidence_grade, {START} < {END} AS survivorship_bias, stored_active >= 30 AND
            (SELECT min(effective_from) <= last_day({START}) FROM v_members) AS stored_usable
        FROM (SELECT *, universe_completeness AND raw_and_adjusted_prices AND required_benchmarks
                AND storage_audit_passed AND point_in_time_membership
                AND historical_security_status AND point_in_time_industry AND corporate_actions
                AS research_ready, (SELECT count(*) FROM v_active) AS stored_active
              FROM v_gates) AS x""",
    "universe_segments": """SELECT code, arg_min(security_name, p) AS security_name,
          arg_min(universe_segment, p) AS universe_segment, arg_min(size_bucket, p)
            AS size_bucket, count(*) AS segments
        FROM (SELECT code, security_name, 'csi300' AS universe_segment, 'LARGE' AS size_bucket,
                0 AS p FROM v_master WHERE size_bucket = 'LARGE'
              UNION ALL SELECT code, security_name, 'csi500', 'MID', 1 FROM v_members
                WHERE effective_to IS NULL AND size_bucket = 'MID'
              UNION ALL SELECT code, security_name, 'csi1000', 'SMALL', 2 FROM v_members
                WHERE effective_to IS NULL) AS x GROUP BY code""",
    "sample_universe": """SELECT * FROM v_bars WHERE code IN
          (SELECT DISTINCT code FROM v_bars ORDER BY code LIMIT 7)""",
    "backfill_gaps": f"""SELECT code, request_start, request_end,
          coalesce(lo <= request_start AND hi >= request_end, false) AS complete,
          CASE WHEN coalesce(lo > request_start, true)
            THEN least(coalesce(lo - 1, request_end), request_end)::DATE END AS missing_head_to,
          CASE WHEN coalesce(hi < request_end, true)
            THEN greatest(coalesce(hi + 1, request_start), request_start)::DATE END
            AS missing_tail_from
        FROM (SELECT l.code, greatest({START}, coalesce(first - 252, {START}))::DATE
                AS request_start,
                (CASE WHEN coalesce(still, true) THEN {END} ELSE least({END}, last + 60) END)::DATE
                AS request_end
              FROM v_listed l LEFT JOIN (SELECT code, min(effective_from) AS first,
                  max(effective_to) AS last, bool_or(until_date >= {END}) AS still
                FROM v_members GROUP BY code) m USING (code)) AS b
        LEFT JOIN (SELECT code, min(date) AS lo, max(date) AS hi FROM v_adjusted GROUP BY code) h
          USING (code)""",
    "run_manifest": """SELECT count(*) AS rows, count(DISTINCT date) AS rebalance_dates,
          (SELECT count(*) FROM v_known k, v_splits WHERE k.date < validation_start) AS train_rows,
          (SELECT count(*) FROM v_known k, v_splits WHERE k.date >= validation_start)
            AS validation_rows,
          (SELECT count(*) FROM v_pred p, v_splits WHERE p.date >= test_start) AS test_rows,
          (SELECT max(date) FROM v_last) AS latest_scored_date,
          (SELECT count(*) FROM v_last) AS latest_symbols,
          (SELECT count(*) FROM v_last WHERE size_bucket = 'LARGE') AS latest_large,
          (SELECT count(*) FROM v_last WHERE size_bucket = 'MID') AS latest_mid,
          (SELECT count(*) FROM v_last WHERE size_bucket = 'SMALL') AS latest_small,
          (SELECT max(fold_id) FROM v_fold_rows WHERE split = 'test') AS folds,
          (SELECT count(*) FROM v_fold_rows WHERE split = 'test') AS out_of_sample_rows,
          (SELECT min(date) FROM v_fold_rows WHERE split = 'test') AS out_of_sample_start,
          (SELECT max(date) FROM v_fold_rows WHERE split = 'test') AS out_of_sample_end
        FROM v_pred""",
}
