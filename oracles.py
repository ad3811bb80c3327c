"""SQL counterparts of the registered queries, written for DuckDB and independent of the package.

Series are dense here and recursions are folded step by step with ``list_reduce``, so the
closed forms of the engine are checked against the definitions they were derived from.
"""

from __future__ import annotations

from itertools import product

CLOSED = (
    "croston", "sba", "tsb", "adida", "prophet", "weighted_ma", "ma_benchmark",
    "exponential_trend", "intelligent_growth", "advanced_ensemble", "ensemble",
)
WEIGHTS = {
    "croston": 1.2, "sba": 1.3, "tsb": 1.4, "prophet": 1.5, "weighted_ma": 1.3,
    "exponential_trend": 1.2, "intelligent_growth": 1.9,
}
METRICS = ("mae", "rmse", "smape", "mae_pct", "bias", "bias_pct", "score_pct", "mase")

JOINED = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

LINES = f"""lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_number, 'P-' || l_partkey AS sku, o_orderdate AS booked_date,
    n_name AS country,
    CASE p_type WHEN 'ECONOMY' THEN 'SYS01: Economy' WHEN 'LARGE' THEN 'SYS02: Large' WHEN 'MEDIUM' THEN 'SYS03: Medium'
      WHEN 'PROMO' THEN 'SYS04: Promo' WHEN 'STANDARD' THEN 'SYS05: Standard' ELSE p_type END AS system,
    'FACTORY_' || s_nationkey AS factory, p_brand AS cell, c_mktsegment AS item_class, p_name AS description,
    CAST(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18,2)) AS qty,
    CAST(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18,2)) AS shipped_qty,
    CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18,2)) AS cancelled_qty,
    CAST(l_extendedprice * 30 AS DECIMAL(18,2)) AS egp_amount,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS usd_amount,
    CAST(CASE WHEN l_linenumber % 2 = 1 THEN p_size * l_quantity
      WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN p_size * l_quantity ELSE 0 END / 1000 AS DECIMAL(18,6)) AS weight_tons,
    CASE WHEN l_partkey % 10 = 0 THEN 'Prime' WHEN l_partkey % 3 = 0 THEN 'Standard' ELSE 'Non-Standard' END AS item_category,
    date_trunc('month', o_orderdate)::DATE AS period_month
  FROM {JOINED})"""

RAW = f"""raw AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN '  p-' || l_partkey || chr(9) ELSE 'P-' || l_partkey END AS item,
    CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS qty, o_orderdate AS booked,
    l_orderkey AS order_number, n_name AS country, p_type AS system, s_nationkey AS factory, p_brand AS cell,
    c_mktsegment AS item_class, p_name AS description, l_extendedprice AS price, p_size, l_returnflag, l_linestatus, l_quantity,
    CASE WHEN l_linenumber % 2 = 1 THEN p_size * l_quantity END AS calc
  FROM {JOINED})"""

CALENDAR = """CAST(year(booked_date) AS INT) AS year, CAST(quarter(booked_date) AS INT) AS quarter,
    CAST(month(booked_date) AS INT) AS month, CAST(week(booked_date) AS INT) AS week,
    date_trunc('year', booked_date)::DATE AS period_year, date_trunc('quarter', booked_date)::DATE AS period_quarter,
    date_trunc('month', booked_date)::DATE AS period_month, date_trunc('week', booked_date)::DATE AS period_week"""
KEYS = "order_number, sku, booked_date, country, system, factory, cell, item_class"
MEASURES = ("qty", "egp_amount", "usd_amount", "weight_tons", "shipped_qty", "cancelled_qty")
VIEW = ("qty", "egp_amount", "usd_amount", "weight_tons")


def sums(measures) -> str:
    return ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in measures)


def dbl(measures) -> str:
    return ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in measures)


MERGED = f"{LINES}, merged AS (SELECT {KEYS}, min(item_category) AS item_category, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)} FROM lines GROUP BY {KEYS})"


def r(expr: str, digits: int, alias: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


# --- ingest, validation, dashboards -------------------------------------------------------


def relational() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_lines"] = f"WITH {LINES} SELECT {KEYS}, description, {dbl(MEASURES)}, item_category, {CALENDAR} FROM lines"
    q["item_lists"] = """SELECT 'P-' || p_partkey AS sku, p_partkey % 3 = 0 AS is_standard, p_partkey % 10 = 0 AS is_prime
      FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 10 = 0"""
    q["merge_splits"] = f"WITH {MERGED} SELECT {KEYS}, {dbl(MEASURES)} FROM merged"
    q["processed_fact"] = f"""WITH {MERGED}, texts AS (SELECT sku, max(description) AS description FROM lines GROUP BY sku),
      d AS (SELECT {KEYS}, item_category, {dbl(MEASURES)} FROM merged),
      e AS (SELECT *, qty + shipped_qty + cancelled_qty AS total_ordered FROM d)
      SELECT {KEYS}, item_category, {', '.join(MEASURES)}, description, {CALENDAR}, total_ordered,
        CASE WHEN total_ordered = 0 THEN 0 ELSE {r('shipped_qty / total_ordered * 100', 9, 'fulfillment_rate').replace(' AS ', ' END AS ')},
        CASE WHEN qty = 0 THEN 0 ELSE {r('egp_amount / qty', 9, 'unit_price_egp').replace(' AS ', ' END AS ')},
        CASE WHEN qty = 0 THEN 0 ELSE {r('usd_amount / qty', 9, 'unit_price_usd').replace(' AS ', ' END AS ')}
      FROM e JOIN texts USING (sku)"""
    q["item_descriptions"] = f"WITH {LINES} SELECT sku, max(description) AS description FROM lines GROUP BY sku"
    q["item_descriptions_by_order"] = """WITH firsts AS (
        SELECT 'P-' || l_partkey AS sku, c_mktsegment AS description,
          min(strftime(o_orderdate, '%Y%m%d') || '/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0')) AS seen
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
      SELECT sku, arg_max(description, seen) AS description FROM firsts GROUP BY sku"""
    q["item_labels"] = f"WITH {LINES} SELECT DISTINCT sku, description, sku || ' - ' || description AS label FROM lines"
    q["system_names"] = f"WITH {LINES} SELECT system, count(*) AS n FROM lines GROUP BY system"
    q["view_monthly_sku"] = f"""WITH {LINES} SELECT sku, period_month, item_category, {sums(VIEW)}, period_month AS period_start
      FROM lines GROUP BY sku, period_month, item_category"""
    for dim in ("country", "system", "factory", "cell"):
        q[f"view_{dim}"] = f"""WITH {LINES} SELECT {dim}, period_month, {sums(VIEW)}, count(DISTINCT sku) AS unique_skus
          FROM lines GROUP BY {dim}, period_month"""
    q["summary_overview"] = f"""WITH {MERGED} SELECT count(*) AS total_rows, CAST(sum(qty) AS DOUBLE) AS total_qty,
      CAST(sum(egp_amount) AS DOUBLE) AS total_egp, CAST(sum(usd_amount) AS DOUBLE) AS total_usd,
      CAST(sum(weight_tons) AS DOUBLE) AS total_tons, min(booked_date)::DATE AS date_min, max(booked_date)::DATE AS date_max,
      date_diff('day', min(booked_date), max(booked_date)) AS span_days FROM merged"""
    q["summary_items"] = f"""WITH {LINES} SELECT count(DISTINCT sku) AS total_unique,
      count(DISTINCT sku) FILTER (item_category = 'Standard') AS standard_items,
      count(DISTINCT sku) FILTER (item_category = 'Prime') AS prime_items,
      count(DISTINCT sku) FILTER (item_category = 'Non-Standard') AS non_standard_items FROM lines"""
    q["summary_dimensions"] = f"""WITH {LINES} SELECT count(DISTINCT country) AS countries, count(DISTINCT system) AS systems,
      count(DISTINCT factory) AS factories, count(DISTINCT cell) AS cells, count(DISTINCT year(booked_date)) AS years FROM lines"""
    rankings = (
        ("top_items_by_qty", "sku", "qty"), ("top_items_by_usd", "sku", "usd_amount"),
        ("top_countries_by_usd", "country", "usd_amount"), ("top_systems_by_qty", "system", "qty"),
        ("top_factories_by_tons", "factory", "weight_tons"),
    )
    parts = [
        f"""(SELECT '{name}' AS ranking, CAST(row_number() OVER (ORDER BY sum({m}) DESC, {d}) AS INT) AS rank, {d} AS member,
          CAST(sum({m}) AS DOUBLE) AS value FROM lines GROUP BY {d} ORDER BY sum({m}) DESC, {d} LIMIT 10)"""
        for name, d, m in rankings
    ]
    q["top_performers"] = f"WITH {LINES} " + " UNION ALL ".join(parts)

    # Values of a row in order of the raw column names, from booked date to unit weight.
    num = lambda x: f"CAST({x} AS DECIMAL(38,9))"
    shipped, returned = "l_linestatus = 'F'", "l_returnflag = 'R'"
    values = ("strftime(booked, '%Y-%m-%d %H:%M:%S.%f')", num("calc"), num(f"CASE WHEN {returned} THEN l_quantity ELSE 0 END"), "cell", "country", "description",
        "'FACTORY_' || factory", "item_class", num(f"CASE WHEN {shipped} THEN 0 ELSE price END"), "order_number", "system", "item",
        num("CAST(price * 30 AS DECIMAL(18,2))"), num("qty"), num(f"CASE WHEN {shipped} THEN price ELSE 0 END"),
        num(f"CASE WHEN {shipped} AND NOT {returned} THEN l_quantity ELSE 0 END"), num("p_size"))
    line = ", ".join(f"coalesce(CAST({v} AS VARCHAR), '\\N')" for v in values)
    q["input_fingerprint"] = f"""WITH {RAW} SELECT count(*) AS "rows",
      CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {line})), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS input_hash FROM raw"""
    q["quality_missing"] = f"""WITH {RAW} SELECT count(*) AS total_rows, count(*) FILTER (item IS NULL) AS missing_sku,
      count(*) FILTER (qty IS NULL) AS missing_qty, count(*) FILTER (booked IS NULL) AS missing_date,
      count(*) FILTER (item IS NULL) * 100.0::DOUBLE / count(*) AS missing_sku_pct,
      count(*) FILTER (qty IS NULL) * 100.0::DOUBLE / count(*) AS missing_qty_pct,
      count(*) FILTER (booked IS NULL) * 100.0::DOUBLE / count(*) AS missing_date_pct FROM raw"""
    q["quality_duplicates"] = f"""WITH {RAW}, kinds AS (SELECT DISTINCT item, qty, booked, order_number, country, system, factory, cell,
      item_class, description, price, p_size, calc, l_returnflag = 'R' AS returned, l_linestatus, l_quantity * (l_returnflag = 'R')::INT AS c,
      l_quantity * (l_linestatus = 'F' AND l_returnflag <> 'R')::INT AS s FROM raw)
      SELECT (SELECT count(*) FROM raw) - count(*) AS duplicates FROM kinds"""
    q["quality_duplicates_narrow"] = f"""WITH {RAW}, kinds AS (SELECT DISTINCT item, qty, booked FROM raw)
      SELECT (SELECT count(*) FROM raw) - count(*) AS duplicates FROM kinds"""
    classified = """SELECT count(*) FILTER (l_partkey % 3 = 0) AS standard_items, count(*) FILTER (l_partkey % 10 = 0) AS prime_items,
      count(*) FILTER (l_partkey % 3 <> 0) AS non_standard_items,
      count(*) FILTER (l_partkey % 3 = 0) * 100.0::DOUBLE / count(*) AS standard_pct,
      count(*) FILTER (l_partkey % 10 = 0) * 100.0::DOUBLE / count(*) AS prime_pct FROM lineitem"""
    q["quality_classification"] = classified
    dates = """SELECT min(o_orderdate)::DATE AS date_min, max(o_orderdate)::DATE AS date_max,
      date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days,
      date_diff('day', min(o_orderdate), max(o_orderdate)) / 365.25::DOUBLE AS span_years
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    q["quality_date_range"] = dates
    cards = f"""SELECT count(DISTINCT item) AS unique_items, count(DISTINCT order_number) AS unique_orders,
      count(DISTINCT country) AS unique_countries, count(DISTINCT system) AS unique_systems,
      count(DISTINCT factory) AS unique_factories, count(DISTINCT cell) AS unique_cells FROM raw"""
    q["quality_cardinalities"] = f"WITH {RAW} {cards}"
    splits = """SELECT count(*) FILTER (n > 1) AS split_groups, count(*) AS total_groups,
      count(*) FILTER (n > 1) * 100.0::DOUBLE / count(*) AS split_percentage
      FROM (SELECT count(*) AS n FROM raw GROUP BY order_number, item)"""
    q["quality_split_groups"] = f"WITH {RAW} {splits}"
    q["quality_rules"] = f"""WITH {RAW}, c AS ({cards}), d AS ({dates}), m AS (SELECT
        count(*) FILTER (item IS NULL) * 100.0::DOUBLE / count(*) AS sku, count(*) FILTER (booked IS NULL) * 100.0::DOUBLE / count(*) AS date FROM raw)
      SELECT 'missing_sku_pct' AS rule, sku AS observed, 5.0::DOUBLE AS threshold, 'warning' AS severity, sku > 5 AS fired FROM m
      UNION ALL SELECT 'missing_date_pct', date, 10, 'warning', date > 10 FROM m
      UNION ALL SELECT 'few_items', unique_items, 100, 'recommendation', unique_items < 100 FROM c
      UNION ALL SELECT 'long_history', span_years, 2, 'recommendation', span_years >= 2 FROM d
      UNION ALL SELECT 'short_history', span_years, 2, 'warning', span_years < 2 FROM d"""
    q["validation_long"] = f"""WITH {RAW}, a AS (SELECT count(*) AS total_rows, count(*) FILTER (item IS NULL) AS missing_sku,
        count(*) FILTER (qty IS NULL) AS missing_qty, count(*) FILTER (booked IS NULL) AS missing_date FROM raw),
      b AS (SELECT *, missing_sku * 100.0::DOUBLE / total_rows AS missing_sku_pct, missing_qty * 100.0::DOUBLE / total_rows AS missing_qty_pct,
        missing_date * 100.0::DOUBLE / total_rows AS missing_date_pct FROM a),
      u AS (SELECT * EXCLUDE (date_min, date_max) FROM b, (SELECT total_rows - n AS duplicates FROM a, (SELECT count(*) AS n FROM
        (SELECT DISTINCT item, qty, booked, order_number, country, system, factory, cell, item_class, description, price, p_size, calc,
          l_returnflag = 'R', l_linestatus, l_quantity * (l_returnflag = 'R')::INT,
          l_quantity * (l_linestatus = 'F' AND l_returnflag <> 'R')::INT FROM raw))), ({dates}), ({cards}), ({splits}), ({classified}))
      UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM u) ON COLUMNS(*) INTO NAME metric VALUE value"""

    dirty = """dirty AS (SELECT
        CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN ' nan ' WHEN 2 THEN 'P-' || l_partkey WHEN 3 THEN chr(9) || 'p-' || l_partkey || ' ' ELSE 'p-' || l_partkey END AS item,
        CASE l_linenumber % 5 WHEN 0 THEN q WHEN 1 THEN '-' || q WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE ' ' || q || '.5 ' END AS qty,
        CASE l_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')
          WHEN 3 THEN 'soon' END AS booked,
        CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'NAN' WHEN 3 THEN lower(p_type) WHEN 4 THEN '  ' || p_type || chr(10) ELSE p_type END AS system,
        CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN ' Land ' ELSE 'Land' END AS country,
        CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS order_number
      FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    read = "coalesce(try_strptime(booked, '%Y-%m-%d'), try_strptime(booked, '%d/%m/%Y'), try_strptime(booked, '%Y%m%d'))"
    text = lambda c: f"CASE WHEN trim({c}, {blank}) IS NULL OR trim({c}, {blank}) IN ('nan', 'NAN') THEN 'Unknown' ELSE trim({c}, {blank}) END"
    q["clean_dirty_lines"] = f"""WITH {dirty}, c AS (SELECT {text('order_number')} AS order_number, upper(trim(item, {blank})) AS sku, {read}::DATE AS booked_date,
        {text('country')} AS country, {text('system')} AS name, coalesce(TRY_CAST(trim(qty) AS DOUBLE), 0) AS qty FROM dirty)
      SELECT order_number, sku, booked_date, country, CASE WHEN name = '' THEN 'Unknown' ELSE CASE lower(name) WHEN 'economy' THEN 'SYS01: Economy' WHEN 'eco' THEN 'SYS01: Economy'
        WHEN 'large' THEN 'SYS02: Large' WHEN 'medium' THEN 'SYS03: Medium' WHEN 'promo' THEN 'SYS04: Promo' WHEN 'standard' THEN 'SYS05: Standard' ELSE name END END AS system, qty
      FROM c WHERE sku IS NOT NULL AND sku <> 'NAN' AND booked_date IS NOT NULL"""
    q["quality_unreadable"] = f"""WITH {dirty} SELECT 'Booked Date' AS "column", count(booked) AS present, count(*) FILTER (booked IS NOT NULL AND {read} IS NULL) AS unreadable FROM dirty
      UNION ALL SELECT 'SO Remaining Qty', count(qty), count(*) FILTER (qty IS NOT NULL AND TRY_CAST(trim(qty) AS DOUBLE) IS NULL) FROM dirty"""
    q["quality_dirty"] = f"""WITH {dirty}, a AS (SELECT count(*) AS total_rows, count(*) - count(item) AS missing_sku, count(*) - count(qty) AS missing_qty, count(*) - count(booked) AS missing_date,
        date_diff('day', min({read}), max({read})) AS span_days FROM dirty),
      s AS (SELECT count(*) FILTER (n > 1) AS split_groups, count(*) AS total_groups FROM (SELECT count(*) AS n FROM dirty WHERE item IS NOT NULL AND order_number IS NOT NULL GROUP BY order_number, item)),
      u AS (SELECT *, missing_sku * 100.0::DOUBLE / total_rows AS missing_sku_pct, missing_qty * 100.0::DOUBLE / total_rows AS missing_qty_pct, missing_date * 100.0::DOUBLE / total_rows AS missing_date_pct,
        span_days / 365.25::DOUBLE AS span_years, split_groups * 100.0::DOUBLE / total_groups AS split_percentage FROM a, s)
      UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM u) ON COLUMNS(*) INTO NAME metric VALUE value"""
    q["system_aliases"] = f"""WITH {LINES}, top AS (SELECT system FROM lines WHERE system LIKE 'SYS%' GROUP BY system ORDER BY count(*) DESC, system DESC LIMIT 1),
      a(canonical, alias, ord) AS (VALUES ('SYS01: Economy', 'economy', 0), ('SYS01: Economy', 'Eco', 1), ('SYS02: Large', 'Large', 2), ('SYS03: Medium', 'MEDIUM', 3),
        ('SYS04: Promo', 'promo', 4), ('SYS05: Standard', 'Standard', 5)) SELECT a.* FROM a JOIN top ON canonical = system"""
    q["weight_sum_small"] = f"SELECT p_brand AS cell, {r('sum(CASE WHEN l_linenumber % 2 = 1 THEN p_size * l_quantity ELSE 0 END * 1e-7)', 9, 'tons')} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"

    kpi = {
        "executive": (None, ("qty", "usd_amount", "egp_amount", "weight_tons")),
        "country": ("country", ("qty", "usd_amount", "weight_tons")),
        "factory": ("factory", ("qty", "egp_amount")),
        "system": ("system", ("qty", "usd_amount", "weight_tons")),
        "cell": ("cell", ("qty", "egp_amount")),
    }
    for name, (dim, measures) in kpi.items():
        tail = f", count(DISTINCT {dim}) AS members, count(*)::DOUBLE / count(DISTINCT {dim}) AS rows_per_member" if dim else ""
        q[f"kpi_{name}"] = f'WITH {MERGED} SELECT count(*) AS "rows", {sums(measures)}{tail} FROM merged'
    q["monthly_revenue"] = f"WITH {LINES} SELECT period_month, {sums(['usd_amount'])} FROM lines GROUP BY period_month"
    q["factory_production"] = f"WITH {LINES} SELECT factory, {sums(['qty'])} FROM lines GROUP BY factory"
    top = lambda d, m, k: f"SELECT {d}, {sums([m])} FROM lines GROUP BY {d} ORDER BY sum({m}) DESC, {d} LIMIT {k}"
    for d, m, k in (("country", "usd_amount", 8), ("country", "qty", 10), ("system", "usd_amount", 10), ("system", "qty", 15), ("factory", "egp_amount", 8), ("cell", "qty", 20)):
        q[f"top_k_{d}_{m}"] = f"WITH {LINES} {top(d, m, k)}"
    for d, m, k in (("country", "usd_amount", 8), ("factory", "egp_amount", 8), ("system", "usd_amount", 8)):
        q[f"share_{d}"] = f"WITH {LINES}, top AS ({top(d, m, k)}) SELECT *, {r(f'{m} / (SELECT sum({m}) FROM top) * 100', 6, 'share_pct')} FROM top"
    for d, k in (("country", 5), ("factory", 5), ("system", 8), ("cell", 10)):
        q[f"trend_topk_{d}"] = f"""WITH {LINES}, top AS ({top(d, 'qty', k)}) SELECT {d}, period_month, {sums(['qty'])} FROM lines
          WHERE {d} IN (SELECT {d} FROM top) GROUP BY {d}, period_month"""
    for d, b, k in (("factory", "egp_amount", 8), ("system", "usd_amount", 10)):
        q[f"scaled_pair_{d}"] = f"""WITH {LINES}, top AS (SELECT {d}, {sums(['qty', b])} FROM lines GROUP BY {d} ORDER BY sum(qty) DESC, {d} LIMIT {k}),
          m AS (SELECT max(qty) AS ma, max({b}) AS mb FROM top)
          SELECT top.*, {r(f'CASE WHEN mb > 0 THEN {b} * ma / mb ELSE 0 END', 4, f'{b}_scaled')} FROM top, m"""
    q["top_k_system_per_country"] = f"""WITH {LINES} SELECT country, system, {sums(['qty'])},
        CAST(row_number() OVER (PARTITION BY country ORDER BY sum(qty) DESC, system) AS INT) AS rank
      FROM lines GROUP BY country, system QUALIFY row_number() OVER (PARTITION BY country ORDER BY sum(qty) DESC, system) <= 3"""
    q["cell_order_histogram"] = f"""WITH {MERGED}, c AS (SELECT cell, count(*) AS n FROM merged GROUP BY cell)
      SELECT CAST(n // 50 * 50 AS BIGINT) AS bin_start, count(*) AS members FROM c GROUP BY 1"""
    q["factory_cell_rollup"] = f"""WITH {LINES}, p AS (SELECT factory, cell, sum(qty) AS qty FROM lines GROUP BY factory, cell
        ORDER BY sum(qty) DESC, factory, cell LIMIT 30)
      SELECT factory, cell, {sums(['qty'])}, CAST(2 - grouping(factory) - grouping(cell) AS INT) AS depth FROM p GROUP BY ROLLUP (factory, cell)"""
    q["item_kpis"] = f"""WITH {LINES} SELECT sku, {sums(['qty', 'usd_amount'])}, count(DISTINCT order_number) AS orders,
      min(item_category) AS item_category FROM lines GROUP BY sku"""
    q["item_monthly"] = f"WITH {LINES} SELECT sku, period_month, {sums(['qty'])} FROM lines GROUP BY sku, period_month"
    q["search_items"] = f"""WITH {LINES} SELECT DISTINCT sku, description FROM lines
      WHERE regexp_matches(sku, 'RED|^p-1.$', 'i') OR regexp_matches(description, 'RED|^p-1.$', 'i')"""
    q["search_items_default"] = f"WITH {LINES} SELECT DISTINCT sku, description FROM lines ORDER BY sku, description LIMIT 50"
    wheres = {
        "filter_years": "year(booked_date) IN (1996, 1998)",
        "filter_period": "strftime(booked_date, '%Y-%m') BETWEEN '1996-03' AND '1997-02'",
        "filter_countries": "country IN ('NATION_1', 'NATION_2')",
        "filter_combined": "year(booked_date) IN (1997, 1999) AND system IN ('SMALL', 'SYS04: Promo') AND country <> 'NATION_3'",
        "filter_excludes": "country NOT IN ('NATION_0', 'NATION_4') AND system <> 'SMALL'",
        "filter_category": "item_category = 'Prime' AND cell = 'Brand#7'",
    }
    for name, cond in wheres.items():
        q[name] = f"WITH {LINES} SELECT country, system, count(*) AS n, {sums(['qty'])} FROM lines WHERE {cond} GROUP BY country, system"
    return q


# --- series -------------------------------------------------------------------------------

KEY = {"item": "sku", "system": "system", "cell": "cell", "prime": "item_category", "standard": "item_category"}
UNIT = {"M": "month", "Q": "quarter", "Y": "year", "W": "week"}
LABEL = {
    "M": "strftime(period_start, '%Y-%m')",
    "Q": "strftime(period_start, '%Y') || 'Q' || quarter(period_start)",
    "Y": "strftime(period_start, '%Y')",
    "W": "CAST(period_start AS VARCHAR) || '/' || CAST((period_start + INTERVAL 6 DAY)::DATE AS VARCHAR)",
}


def sparse(level: str, metric: str = "qty", freq: str = "M") -> str:
    where = {"prime": "WHERE item_category = 'Prime'", "standard": "WHERE item_category = 'Standard'"}.get(level, "")
    return f"""{LINES}, monthly AS (SELECT '{level}' AS level, {KEY[level]} AS series_key,
      date_trunc('{UNIT[freq]}', booked_date)::DATE AS period_start, CAST(sum({metric}) AS DOUBLE) AS value
      FROM lines {where} GROUP BY 2, 3)"""


def dense(level: str, metric: str = "qty", freq: str = "M") -> str:
    step = {"M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR", "W": "INTERVAL 7 DAY"}[freq]
    return f"""{sparse(level, metric, freq)}, spans AS (SELECT level, series_key, unnest(generate_series(min(period_start)::TIMESTAMP,
        max(period_start)::TIMESTAMP, {step}))::DATE AS period_start FROM monthly GROUP BY level, series_key),
      dense AS (SELECT s.level, s.series_key, CAST(row_number() OVER w - 1 AS INT) AS t, period_start, coalesce(m.value, 0) AS value
        FROM spans s LEFT JOIN monthly m USING (series_key, period_start) WINDOW w AS (PARTITION BY s.series_key ORDER BY period_start)),
      sized AS (SELECT series_key, t, period_start, value AS v, CAST(count(*) OVER (PARTITION BY series_key) AS INT) AS full_n,
        sum(value) OVER (PARTITION BY series_key) AS full_sum FROM dense)"""


def observed(level: str, kind: str = "full") -> str:
    """The dense steps a forecast may see, with n as their number, for series of enough length."""
    if kind == "full":
        return f"{dense(level)}, obs AS (SELECT series_key, t, v, full_n AS n FROM sized WHERE full_n >= 12 AND round(full_sum, 9) <> 0)"
    return f"""{dense(level)}, obs AS (SELECT series_key, t, v, full_n - greatest(3, full_n // 5) AS n FROM sized
      WHERE full_n >= 24 AND round(full_sum, 9) <> 0 AND t < full_n - greatest(3, full_n // 5))"""


SERIES = (
    ("item", "qty", "M"), ("item", "usd_amount", "Q"), ("system", "weight_tons", "M"),
    ("cell", "qty", "W"), ("prime", "qty", "M"), ("standard", "usd_amount", "Y"),
)

# Statistics of every series, recursions folded step by step.
STATS = """
 s0 AS (SELECT series_key, n, list(v ORDER BY t) AS vs, sum(v) AS sum_v, avg(v) AS mean_v, min(v) AS min_v,
   count(*) FILTER (v > 0) AS nnz, avg(v) FILTER (v > 0) AS mean_pos, stddev_pop(v) FILTER (v > 0) AS sd_pos,
   coalesce(list(t ORDER BY t) FILTER (v > 0), []) AS hits,
   avg(v) FILTER (t >= n - 12) AS m12, stddev_pop(v) FILTER (t >= n - 12) AS sd12,
   avg(v) FILTER (t >= n - 3) AS a3, avg(v) FILTER (t >= n - 6 AND t < n - 3) AS b3, avg(v) FILTER (t < 12) AS f12,
   coalesce(regr_slope(v, t), 0) AS slope, coalesce(regr_slope(v, t) FILTER (t < n // 2), 0) AS slope1,
   coalesce(regr_slope(v, t) FILTER (t >= n // 2), 0) AS slope2,
   sum(v) FILTER (t >= n - 12) AS recent,
   coalesce(CASE WHEN n >= 24 THEN sum(v) FILTER (t >= n - 24 AND t < n - 12) ELSE sum(v) FILTER (t < n - 12) END, 0) AS earlier,
   greatest(3, least(12, n // 4)) AS w FROM obs GROUP BY series_key, n),
 s1 AS (SELECT *, sd12 / (m12 + 1) AS vol12, CASE WHEN n >= 12 THEN 0.3 + 0.2 * exp(-sd12 / (m12 + 1)) ELSE 0.35 END AS alpha,
   (a3 - b3) / 3 AS trend3, list_filter(hits, lambda i: i >= 1) AS ups,
   CASE WHEN hits[1] = 0 THEN hits ELSE list_prepend(0, hits) END AS marks FROM s0),
 s2 AS (SELECT *,
   CASE WHEN nnz = 0 THEN 0 ELSE list_reduce(list_prepend(mean_pos, list_transform(ups, lambda i: vs[i + 1])), lambda s, x: 0.25 * x + 0.75 * s) END AS size,
   CASE WHEN nnz = 0 THEN 1 ELSE list_reduce(list_prepend(n::DOUBLE / nnz, list_transform(range(1, len(marks)), lambda k: (marks[k + 1] - marks[k])::DOUBLE)),
     lambda s, x: 0.25 * x + 0.75 * s) END AS gap,
   list_reduce(list_prepend(nnz::DOUBLE / n, list_transform(vs[2:], lambda x: (x > 0)::INT::DOUBLE)), lambda p, x: 0.15 * x + 0.85 * p) AS prob,
   list_reduce(vs, lambda s, x: alpha * x + (1 - alpha) * s) AS es,
   list_transform(range(n // 12), lambda k: list_sum(vs[12 * k + 1 : 12 * k + 12])) AS years,
   list_transform(range(CASE WHEN n >= 12 THEN 4 ELSE 2 END), lambda b: list_transform(range(n // (b + 1)), lambda i: list_sum(vs[i * (b + 1) + 1 : (i + 1) * (b + 1)]))) AS buckets
   FROM s1),
 s3 AS (SELECT *, least(greatest(trend3, -0.15 * es), 0.15 * es) AS es_trend,
   list_filter(list_transform(range(1, len(years)), lambda k: CASE WHEN years[k] > 0 THEN (years[k + 1] - years[k]) / years[k] END), lambda x: x IS NOT NULL) AS growths,
   list_filter(list_transform(range(1, len(years)), lambda k: CASE WHEN years[k] > 0 THEN k END), lambda x: x IS NOT NULL) AS ages,
   greatest(list_avg(list_transform(range(len(buckets)), lambda b: list_avg(buckets[b + 1][greatest(1, len(buckets[b + 1]) - 2) : len(buckets[b + 1])]) / (b + 1))), 0) AS adida
   FROM s2),
 s4 AS (SELECT *, CASE WHEN len(growths) = 0 THEN 0 ELSE list_sum(list_transform(range(1, len(growths) + 1), lambda j: j * growths[j])) / (len(growths) * (len(growths) + 1) / 2.0::DOUBLE) END AS wg,
   CASE WHEN len(growths) = 0 THEN 0 ELSE list_sum(list_transform(range(1, len(growths) + 1), lambda j: ages[j] * growths[j])) / list_sum(ages)::DOUBLE END AS wg_age
   FROM s3),
 wm AS (SELECT series_key, sum(exp(-3 + 3.0::DOUBLE * (t - (n - w)) / (w - 1)) * v) / sum(exp(-3 + 3.0::DOUBLE * (t - (n - w)) / (w - 1))) AS wma
   FROM obs JOIN (SELECT series_key, w FROM s0) USING (series_key) WHERE t >= n - w GROUP BY series_key),
 wd AS (SELECT series_key, CASE WHEN any_value(n) >= 2 * any_value(w) THEN (avg(v) FILTER (t >= n - w) - avg(v) FILTER (t >= n - 2 * w AND t < n - w)) / any_value(w) ELSE 0 END AS drift
   FROM obs JOIN (SELECT series_key, w FROM s0) USING (series_key) GROUP BY series_key),
 xt AS (SELECT series_key, sum(g) AS s0_, sum(g * t) AS s1_, sum(g * t * t) AS s2_, sum(g * y) AS y0_, sum(g * t * y) AS y1_
   FROM (SELECT series_key, t, exp(2 * (-1 + t::DOUBLE / (n - 1))) AS g, CASE WHEN v > -1 THEN ln(v + 1) END AS y FROM obs) GROUP BY series_key),
 xl AS (SELECT series_key, (s0_ * y1_ - s1_ * y0_) / (s0_ * s2_ - s1_ * s1_) AS lb, (y0_ - (s0_ * y1_ - s1_ * y0_) / (s0_ * s2_ - s1_ * s1_) * s1_) / s0_ AS la FROM xt),
 p0 AS (SELECT series_key, t % 12 AS ph, avg(v) FILTER (v > 0) AS pm, avg(v) AS am, avg(t) AS tm FROM obs GROUP BY 1, 2),
 p1 AS (SELECT p0.series_key, ph, am, tm, n, coalesce(pm / mean_pos, 1) AS idx FROM p0 JOIN s0 USING (series_key)),
 p2 AS (SELECT *, (coalesce(lag(idx) OVER o, 0) + idx + coalesce(lead(idx) OVER o, 0)) / 3 AS sm FROM p1 WINDOW o AS (PARTITION BY series_key ORDER BY ph)),
 season AS (SELECT series_key, ph, am, tm, CASE WHEN n >= 24 THEN sm / avg(sm) OVER (PARTITION BY series_key) ELSE 1 END AS idx FROM p2),
 line AS (SELECT series_key, CASE WHEN (m12 - f12) / (f12 + 1) < -0.3 THEN 0 ELSE slope END AS b FROM s0)
"""


def paths(horizon: str = "12") -> str:
    """Closed-form methods per step; ``horizon`` may refer to n."""
    return f"""{STATS},
 fc0 AS (SELECT s4.*, h, horizon, drift, wma, b AS line_b, mean_v - b * (n - 1) / 2 AS line_a, la, lb
   FROM (SELECT *, {horizon} AS horizon FROM s4) s4 JOIN wm USING (series_key) JOIN wd USING (series_key) JOIN xl USING (series_key) JOIN line USING (series_key),
   LATERAL (SELECT unnest(range(1, horizon + 1)) AS h)),
 fc1 AS (SELECT fc0.*, a.idx AS idx, z.am - (line_a + line_b * z.tm) AS resid FROM fc0
   JOIN season a ON a.series_key = fc0.series_key AND a.ph = (h - 1) % 12
   JOIN season z ON z.series_key = fc0.series_key AND z.ph = (n + h - 1) % 12),
 fc2 AS (SELECT *,
   CASE WHEN nnz = 0 THEN 0 ELSE greatest(size / greatest(1, gap) + trend3 * h * 0.3, 0) END AS croston,
   CASE WHEN nnz = 0 THEN 0 ELSE greatest(size / greatest(1, gap) * 0.875 * idx, 0) END AS sba,
   CASE WHEN nnz = 0 THEN 0 ELSE greatest(prob * size * CASE WHEN vol12 > 0.5 THEN 0.9 ELSE 1 END, 0) END AS tsb,
   greatest(es + es_trend * h, 0) AS exp_smoothing,
   greatest(line_a + line_b * (n + h - 1) + CASE WHEN n >= 24 THEN resid ELSE 0 END, 0) AS prophet,
   greatest((wma + least(greatest(drift, -0.1 * wma), 0.15 * wma) * h) * idx, 0) AS weighted_ma,
   greatest(a3, 0) AS ma_benchmark,
   greatest(least(exp(la + lb * (n + h - 1)) - 1, m12 * (1.5 + exp(-0.5 * vol12))) * exp(-0.05 * (h - 1)) + mean_v * (1 - exp(-0.05 * (h - 1))), 0) AS exponential_trend
   FROM fc1),
 fc3 AS (SELECT *, 0.5 * croston + 0.3 * sba + 0.2 * tsb AS base,
   years[len(years)] * (1 + CASE WHEN wg > 0.15 THEN greatest(least(wg, 0.40), 0.03) WHEN wg < -0.15 THEN greatest(wg, -0.10) ELSE greatest(least(wg, 0.08), -0.03) END) AS y1,
   CASE WHEN m12 > 0 THEN vs[n - 11 + (h - 1) % 12] / m12 ELSE 1 END AS shape FROM fc2),
 fc4 AS (SELECT *, y1 * (1 + 0.75 * wg) AS y2, sum(base) FILTER (h <= 12) OVER (PARTITION BY series_key) AS t1,
   coalesce(sum(base) FILTER (h > 12 AND h <= 24) OVER (PARTITION BY series_key), 0) AS t2 FROM fc3),
 fc5 AS (SELECT *, CASE WHEN len(years) < 2 THEN exp_smoothing ELSE greatest(CASE
     WHEN h <= 12 AND t1 > 0 AND (y1 = 0 OR abs(t1 - y1) / y1 > 0.35) THEN y1 / least(12, horizon) * shape
     WHEN h > 12 AND h <= 24 AND t2 > 0 AND (y2 = 0 OR abs(t2 - y2) / y2 > 0.35) THEN y2 / least(12, horizon - 12) * shape
     ELSE base END, 0) END AS intelligent_growth FROM fc4)"""


def advanced(source: str, out: str, members=tuple(WEIGHTS), weights=WEIGHTS) -> str:
    """CTEs that add the advanced ensemble of some members to ``source`` as ``out``."""
    sds = ", ".join(f"stddev_pop({m}) OVER (PARTITION BY series_key) AS sd_{m}" for m in members)
    vals = ", ".join(f"CASE WHEN sd_{m} >= 1e-6 THEN {m} END" for m in members)
    num = " + ".join(f"CASE WHEN sd_{m} >= 1e-6 THEN {weights[m]}::DOUBLE * {m} ELSE 0 END" for m in members)
    den = " + ".join(f"CASE WHEN sd_{m} >= 1e-6 THEN {weights[m]}::DOUBLE ELSE 0 END" for m in members)
    return f"""
 {out}_a AS (SELECT *, {sds} FROM {source}),
 {out}_b AS (SELECT *, list_filter([{vals}], lambda x: x IS NOT NULL) AS good, ({num}) / nullif({den}, 0) AS mean_w FROM {out}_a),
 {out}_c AS (SELECT *, list_median(good) AS med FROM {out}_b),
 {out}_d AS (SELECT *, list_median(list_transform(good, lambda x: abs(x - med))) AS mad FROM {out}_c),
 {out} AS (SELECT * EXCLUDE (good, mean_w, med, mad, {', '.join(f'sd_{m}' for m in members)}), CASE WHEN len(good) = 0 THEN exp_smoothing ELSE greatest(
     mean_w * (1 - least(abs(mean_w - med) / (3 * mad + 1e-6), 1)) + med * least(abs(mean_w - med) / (3 * mad + 1e-6), 1), 0) END AS advanced_ensemble FROM {out}_d)"""


def all_closed(level: str, kind: str = "full", horizon: str = "12") -> str:
    return f"""{observed(level, kind)}, {paths(horizon)}, {advanced('fc5', 'fc6')},
 fc AS (SELECT *, (croston + sba + exp_smoothing) / 3 AS ensemble FROM fc6)"""


# --- fitted methods -----------------------------------------------------------------------

# Every parameter set of every series is folded step by step, in a recursive table with a row for each length of the history.
HOLT = tuple(product((0.05, 0.1, 0.2, 0.3, 0.5), (0.02, 0.1, 0.3), (0.8, 0.9, 0.95, 0.98)))
WINTERS = tuple(product((0.05, 0.15, 0.3, 0.5), (0.02, 0.1), (0.05, 0.15, 0.3), (0.9, 0.98)))


def _grid(points, names: str) -> str:
    rows = ", ".join("(" + ", ".join([str(i), *(f"{x}::DOUBLE" for x in p)]) + ")" for i, p in enumerate(points))
    return f"(SELECT * FROM (VALUES {rows}) AS g(g, {names}))"


def draw(*keys: str) -> str:
    """Uniform number in [0, 1): 32 bits of the MD5 of the keys and the seed."""
    return f"CAST('0x' || substr(md5({' || '.join(f'{k} || chr(124)' for k in keys)} || '42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def fits(origins: str, horizon: int) -> str:
    """CTEs ``holt``, ``winters`` and ``ar``: (sid, i, h, yhat) from the first i steps, for the lengths i in ``origins``
    (a condition on i and n). They read ``obs``."""
    return f"""
 ids AS (SELECT series_key, n, CAST(row_number() OVER (ORDER BY series_key) AS INT) AS sid FROM obs GROUP BY series_key, n),
 st AS (SELECT sid, t, v, n FROM obs JOIN ids USING (series_key, n)),
 ahead AS (SELECT unnest(range(1, {horizon + 1})) AS h),
 h0 AS (SELECT sid, n, avg(v) AS m, sum(v * (t - 4.5)) / 82.5::DOUBLE AS b FROM st WHERE t < 10 GROUP BY sid, n),
 hr AS (SELECT sid, n, g, alpha, alpha * share AS beta, phi, 0 AS i, m - 5.5 * b AS level, b AS slope, 0.0::DOUBLE AS err
     FROM h0, {_grid(HOLT, 'alpha, share, phi')}
   UNION ALL SELECT hr.sid, hr.n, g, alpha, beta, phi, i + 1, level + phi * slope + alpha * (v - level - phi * slope),
     phi * slope + beta * (v - level - phi * slope), err + (v - level - phi * slope) * (v - level - phi * slope)
     FROM hr JOIN st ON st.sid = hr.sid AND st.t = i),
 hb AS (SELECT sid, i, min(struct_pack(err := err, g := g, level := level, slope := slope, phi := phi)) AS s FROM hr WHERE {origins} GROUP BY sid, i),
 holt AS (SELECT sid, i, h, greatest(s.level + s.slope * s.phi * (1 - s.phi ** h) / (1 - s.phi), 0) AS yhat FROM hb, ahead),
 w0 AS (SELECT sid, n, list(v ORDER BY t) AS c, avg(v) FILTER (t < 12) AS c1, avg(v) FILTER (t >= 12) AS c2 FROM st WHERE t < 24 AND n >= 24 GROUP BY sid, n),
 wr AS (SELECT sid, n, g, alpha, share, gamma, phi, k, 0 AS i, c1 + k AS level, (c2 - c1) / 12 AS slope, 0.0::DOUBLE AS err,
     CASE WHEN k = 0 THEN list_transform(range(1, 13), lambda j: (c[j] - c1 + c[j + 12] - c2) / 2)
       ELSE list_transform(range(1, 13), lambda j: greatest(((c[j] + 1) / greatest(c1 + 1, 1e-9) + (c[j + 12] + 1) / greatest(c2 + 1, 1e-9)) / 2, 0.05)) END AS ring
     FROM w0, {_grid(WINTERS, 'alpha, share, gamma, phi')}, (SELECT unnest([0, 1]) AS k)
   UNION ALL SELECT sid, n, g, alpha, share, gamma, phi, k, i, lv, share * (lv - level) + (1 - share) * phi * slope, err + miss * miss,
     list_append(ring[2:], CASE WHEN k = 0 THEN gamma * (z - lv) + (1 - gamma) * ring[1] ELSE greatest(gamma * z / greatest(lv, 1e-9) + (1 - gamma) * ring[1], 0.05) END)
     FROM (SELECT *, CASE WHEN k = 0 THEN alpha * (z - ring[1]) + (1 - alpha) * base ELSE alpha * z / ring[1] + (1 - alpha) * base END AS lv,
         CASE WHEN k = 0 THEN z - base - ring[1] ELSE z - base * ring[1] END AS miss
       FROM (SELECT wr.* EXCLUDE (i), i + 1 AS i, v + k AS z, CASE WHEN k = 0 THEN level + phi * slope ELSE greatest(level + phi * slope, 1e-9) END AS base
         FROM wr JOIN st ON st.sid = wr.sid AND st.t = wr.i))),
 wb AS (SELECT sid, i, k, min(struct_pack(err := err, g := g, level := level, slope := slope, phi := phi, ring := ring)) AS s FROM wr WHERE {origins} GROUP BY sid, i, k),
 wp AS (SELECT a.sid, a.i, CASE WHEN a.s.err < m.s.err THEN 0 ELSE 1 END AS k, CASE WHEN a.s.err < m.s.err THEN a.s ELSE m.s END AS s
   FROM wb a JOIN wb m ON a.sid = m.sid AND a.i = m.i AND a.k = 0 AND m.k = 1),
 winters AS (SELECT sid, i, h, greatest(CASE WHEN k = 0 THEN s.level + s.slope * s.phi * (1 - s.phi ** h) / (1 - s.phi) + s.ring[(h - 1) % 12 + 1]
     ELSE (s.level + s.slope * s.phi * (1 - s.phi ** h) / (1 - s.phi)) * s.ring[(h - 1) % 12 + 1] - 1 END, 0) AS yhat FROM wp, ahead),
 d0 AS (SELECT *, coalesce(v - lag(v) OVER w, 0) AS d FROM st WINDOW w AS (PARTITION BY sid ORDER BY t)),
 d1 AS (SELECT *, lag(d) OVER w AS a, lag(d, 12) OVER w AS b FROM d0 WINDOW w AS (PARTITION BY sid ORDER BY t)),
 d2 AS (SELECT sid, n, t, v, d, t + 1 AS i, greatest(t - 12, 0) AS cnt, sum(d * d) FILTER (t >= 13) OVER w AS dd, sum(d * a) FILTER (t >= 13) OVER w AS da,
   sum(d * b) FILTER (t >= 13) OVER w AS db, sum(a * a) FILTER (t >= 13) OVER w AS aa, sum(b * b) FILTER (t >= 13) OVER w AS bb,
   sum(a * b) FILTER (t >= 13) OVER w AS ab, [{', '.join(f'lag(d, {k}) OVER o' for k in range(11, -1, -1))}] AS past
   FROM d1 WINDOW w AS (PARTITION BY sid ORDER BY t ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY sid ORDER BY t)),
 d3 AS (SELECT *, aa * bb - ab * ab AS det, CASE WHEN aa > 1e-9 THEN da / aa ELSE 0 END AS one, CASE WHEN bb > 1e-9 THEN db / bb ELSE 0 END AS twelve
   FROM d2 WHERE n >= 24 AND {origins}),
 d4 AS (SELECT *, CASE WHEN det > 1e-9 * greatest(aa * bb, 1e-9) THEN (da * bb - db * ab) / det ELSE 0 END AS p1,
   CASE WHEN det > 1e-9 * greatest(aa * bb, 1e-9) THEN (db * aa - da * ab) / det ELSE 0 END AS p12 FROM d3),
 d5 AS (SELECT *, cnt * ln(greatest(dd - 2 * one * da + one * one * aa, 1e-9) / cnt) + 2 AS s1, cnt * ln(greatest(dd - 2 * twelve * db + twelve * twelve * bb, 1e-9) / cnt) + 2 AS s2,
   cnt * ln(greatest(dd - 2 * (p1 * da + p12 * db) + p1 * p1 * aa + p12 * p12 * bb + 2 * p1 * p12 * ab, 1e-9) / cnt) + 4 AS s3 FROM d4),
 d6 AS (SELECT sid, i, v, d, past, CASE WHEN s1 <= s2 AND s1 <= s3 THEN one WHEN s2 <= s3 THEN 0 ELSE p1 END AS f1,
   CASE WHEN s1 <= s2 AND s1 <= s3 THEN 0 WHEN s2 <= s3 THEN twelve ELSE p12 END AS f12 FROM d5),
 arr AS (SELECT sid, i, 0 AS h, v AS y, d, past, f1, f12 FROM d6
   UNION ALL SELECT sid, i, h + 1, y + step, step, list_append(past[2:], step), f1, f12
   FROM (SELECT *, f1 * d + f12 * past[1] AS step FROM arr WHERE h < {horizon})),
 ar AS (SELECT sid, i, h, greatest(y, 0) AS yhat FROM arr WHERE h > 0)"""


def bend(j: int, x: str) -> str:
    return f"greatest({x} - {j + 1} * 0.8::DOUBLE / 6, 0)"


def basis_value(t: str, x: str) -> str:
    """Value of basis function i at step t, where x is t as a share of the history."""
    rows = [f"WHEN i = 0 THEN 1 WHEN i = 1 THEN {x}", *(f"WHEN i = {2 + j} THEN {bend(j, x)}" for j in range(6))]
    rows += [f"WHEN i = {8 + 2 * k + s} THEN {f}({k + 1} * pi() * ({t} % 12) / 6)" for k in range(3) for s, f in enumerate(("cos", "sin"))]
    return f"CASE {' '.join(rows)} END"


def change_points(level: str) -> str:
    """CTEs ``coef`` (series_key, n, i, c) of the ridge regression on the basis: the inverse of the normal equations of every
    length and branch by Gauss-Jordan, a step for each of the 14 columns. Unused columns are zero, with 1 on the diagonal."""
    off = "(lam = 0 AND i BETWEEN 1 AND 7 OR n < 24 AND i >= 8)"
    steps = "".join(
        f""" g{k + 1} AS MATERIALIZED (SELECT g.n, g.lam, g.i, g.j, CASE WHEN g.i = {k} THEN g.val / p.val ELSE g.val - r.val / p.val * c.val END AS val
   FROM g{k} g JOIN g{k} r ON r.n = g.n AND r.lam = g.lam AND r.i = g.i AND r.j = {k} JOIN g{k} c ON c.n = g.n AND c.lam = g.lam AND c.i = {k} AND c.j = g.j
   JOIN g{k} p ON p.n = g.n AND p.lam = g.lam AND p.i = {k} AND p.j = {k}),
"""
        for k in range(14)
    )
    return f"""{observed(level)}, {STATS},
 br AS (SELECT series_key, n, CASE WHEN (m12 - f12) / (f12 + 1) > 0.5 THEN 0.25::DOUBLE WHEN (m12 - f12) / (f12 + 1) < -0.3 THEN 0 ELSE 1 END AS lam FROM s0),
 cols AS (SELECT unnest(range(14)) AS i),
 kx AS MATERIALIZED (SELECT n, lam, t, i, CASE WHEN {off} THEN 0 ELSE {basis_value('t', '(t::DOUBLE / (n - 1))')} END AS b
   FROM (SELECT n, lam, unnest(range(n)) AS t FROM (SELECT DISTINCT n, lam FROM br)), cols),
 g0 AS MATERIALIZED (SELECT a.n, a.lam, a.i, c.i AS j, sum(a.b * c.b) + CASE WHEN a.i <> c.i THEN 0 WHEN any_value(a.lam) = 0 AND a.i BETWEEN 1 AND 7
     OR any_value(a.n) < 24 AND a.i >= 8 THEN 1 WHEN a.i >= 8 THEN (0.05::DOUBLE / 15) ** 2 WHEN a.i >= 2 THEN a.lam ELSE 0 END AS val
   FROM kx a JOIN kx c USING (n, lam, t) GROUP BY a.n, a.lam, a.i, c.i
   UNION ALL SELECT n, lam, i, j + 14, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END FROM (SELECT DISTINCT n, lam FROM br), cols, (SELECT i AS j FROM cols)),
{steps} rhs AS (SELECT series_key, n, lam, i, sum(b * v) AS s FROM obs JOIN br USING (series_key, n) JOIN kx USING (n, lam, t) GROUP BY ALL),
 coef AS (SELECT series_key, rhs.n, rhs.lam, g.i, sum(g.val * s) AS c FROM rhs JOIN g14 g ON g.n = rhs.n AND g.lam = rhs.lam AND g.j = rhs.i + 14 GROUP BY ALL)"""


def nodes(dims: tuple[str, str]) -> str:
    """CTE ``node``: monthly sums of the total, of the first dimension, and of the pairs."""
    a, b = dims
    month = "date_trunc('month', booked_date)::DATE AS period_start, CAST(sum(qty) AS DOUBLE) AS value FROM lines GROUP BY ALL"
    return f"""{LINES}, node AS (SELECT 0 AS depth, '[]' AS series_key, CAST(NULL AS VARCHAR) AS parent, {month}
   UNION ALL SELECT 1, '["' || {a} || '"]', '[]', {month}
   UNION ALL SELECT 2, '["' || {a} || '","' || {b} || '"]', '["' || {a} || '"]', {month})"""


def reconciled(dims: tuple[str, str], variance: str) -> str:
    """Means of the last three months of every node, made to add up by solving for the tree from the Lagrange conditions:
    each parent's multiplier shifts it and its children in proportion to their variances. With q the variance of a middle node,
    s that of its children in sum and g the gap between it and them, its multiplier is (q * top - g) / (q + s)."""
    return f"""WITH {nodes(dims)},
 span AS (SELECT series_key, depth, parent, unnest(generate_series(min(period_start)::TIMESTAMP, (SELECT max(period_start) FROM node)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS period_start
   FROM node GROUP BY series_key, depth, parent),
 obs AS (SELECT s.series_key, s.depth, s.parent, coalesce(value, 0) AS v, row_number() OVER (PARTITION BY s.series_key ORDER BY period_start DESC) AS back,
   abs(coalesce(value, 0) - lag(coalesce(value, 0)) OVER (PARTITION BY s.series_key ORDER BY period_start)) AS d FROM span s LEFT JOIN node USING (series_key, period_start)),
 base AS (SELECT series_key, depth, parent, CASE WHEN count(*) < 3 THEN avg(v) ELSE greatest(avg(v) FILTER (back <= 3), 0) END AS y,
   greatest({'abs(avg(v))' if variance == 'level' else 'coalesce(avg(d), 0) ** 2'}, 1e-6) AS q FROM obs GROUP BY ALL),
 kids AS (SELECT parent AS series_key, sum(y) AS ky, sum(q) AS s FROM base WHERE depth = 2 GROUP BY parent),
 mid AS (SELECT series_key, y, q, s, y - ky AS g FROM base JOIN kids USING (series_key) WHERE depth = 1),
 top AS (SELECT any_value(b.y) AS y, any_value(b.q) AS q, (any_value(b.y) - sum(m.y - m.q * m.g / (m.q + m.s))) / (any_value(b.q) + sum(m.q * m.s / (m.q + m.s))) AS l
   FROM base b, mid m WHERE b.depth = 0),
 mult AS (SELECT series_key, (g + q * l) / (q + s) AS l FROM mid, (SELECT l FROM top)),
 fixed AS (SELECT b.depth, b.series_key, b.parent, b.y, CASE b.depth WHEN 0 THEN b.y - b.q * top.l WHEN 1 THEN b.y + b.q * top.l - b.q * own.l ELSE b.y + b.q * up.l END AS value
   FROM base b CROSS JOIN top LEFT JOIN mult own ON own.series_key = b.series_key LEFT JOIN mult up ON up.series_key = b.parent)
 SELECT depth, series_key, parent, CAST(h AS INT) AS h, {r('y', 6, 'yhat')}, {r('value', 6, 'value')} FROM fixed, (SELECT unnest(range(1, 13)) AS h)"""


def fitted_members() -> str:
    """All methods at the end of each history, without trees: ``fc`` has a column for each."""
    es = lambda x: f"CASE WHEN n < 24 THEN exp_smoothing ELSE {x} END"
    blend = lambda *w: " + ".join(f"{x}::DOUBLE * {m}" for x, m in zip(w, ("holt_winters", "arima", "exp_smoothing", "iets")))
    members = (*WEIGHTS, "arima", "holt_winters", "lstm", "lightgbm")
    weights = {**WEIGHTS, "arima": 1.6, "holt_winters": 1.4, "lstm": 1.8, "lightgbm": 1.7}
    return f"""{observed('item')}, {paths()}, {fits('i = n', 12)},
 ff0 AS (SELECT fc5.*, CASE WHEN {draw('series_key', 'h')} > nnz::DOUBLE / n THEN 0 ELSE holt.yhat END AS iets, {es('winters.yhat')} AS holt_winters, {es('ar.yhat')} AS arima
   FROM fc5 JOIN ids USING (series_key, n) JOIN holt USING (sid, h) LEFT JOIN winters USING (sid, h) LEFT JOIN ar USING (sid, h)),
 ff1 AS (SELECT *, {es(f"greatest({blend(0.35, 0.25, 0.20, 0.20)}, 0)")} AS lstm, {es(blend(0.4, 0.3, 0.2, 0.1))} AS lightgbm FROM ff0),
 {advanced('ff1', 'ff2', members, weights)}, fc AS (SELECT * FROM ff2)"""


def rolling_sql() -> str:
    """Features and label of every rolling origin; a list of the history is folded at each origin for exponential smoothing."""
    m = "(holt_winters + arima + exp_smoothing + iets) / 4"
    return f"""WITH RECURSIVE {observed('item')}, {fits('i BETWEEN 24 AND n - 4', 3)},
 o0 AS (SELECT series_key, sid, i, list(v ORDER BY t) FILTER (t < i) AS vs, count(*) FILTER (v > 0 AND t < i) AS nnz, avg(v) FILTER (t < i) AS mean_v,
     avg(v) FILTER (t >= i - 12 AND t < i) AS m12, stddev_pop(v) FILTER (t >= i - 12 AND t < i) AS sd12, avg(v) FILTER (t >= i - 3 AND t < i) AS a3,
     avg(v) FILTER (t >= i - 6 AND t < i - 3) AS b3, avg(v) FILTER (t >= i - 6 AND t < i) AS last6, list(v ORDER BY t) FILTER (t >= i AND t < i + 3) AS following
   FROM (SELECT sid, unnest(range(24, n - 3)) AS i FROM ids) JOIN st USING (sid) JOIN ids USING (sid) GROUP BY series_key, sid, i),
 o1 AS (SELECT *, list_reduce(vs, lambda s, x: (0.3 + 0.2 * exp(-sd12 / (m12 + 1))) * x + (0.7 - 0.2 * exp(-sd12 / (m12 + 1))) * s) AS es, (a3 - b3) / 3 AS tr,
     CASE WHEN mean_v > 0 THEN mean_v ELSE 1 END AS k FROM o0),
 o2 AS (SELECT o1.*, h, greatest(es + least(greatest(tr, -0.15 * es), 0.15 * es) * h, 0) AS exp_smoothing, winters.yhat AS holt_winters, ar.yhat AS arima,
     CASE WHEN {draw('series_key', 'h')} > nnz::DOUBLE / i THEN 0 ELSE holt.yhat END AS iets
   FROM o1 JOIN holt USING (sid, i) JOIN winters USING (sid, i, h) JOIN ar USING (sid, i, h))
 SELECT series_key, CAST(i AS INT) AS origin, CAST(h AS INT) AS h, {r('holt_winters / k', 6, 'f_holt_winters')}, {r('arima / k', 6, 'f_arima')},
   {r('exp_smoothing / k', 6, 'f_exp_smoothing')}, {r('iets / k', 6, 'f_iets')}, {r(f'({m}) / k', 6, 'f_mean')},
   {r('stddev_pop_of / k', 6, 'f_sd')}, {r('list_median([holt_winters, arima, exp_smoothing, iets]) / k', 6, 'f_median')}, {r('vs[i] / k', 6, 'f_last')},
   {r('last6 / k', 6, 'f_last6')}, CAST(h - 1 AS DOUBLE) AS f_step, {r('following[h] / k', 6, 'label')}
 FROM (SELECT *, list_stddev_pop([holt_winters, arima, exp_smoothing, iets]) AS stddev_pop_of FROM o2)"""


GROWTH = """CASE WHEN earlier > 0 THEN (recent - earlier) / earlier * 100 WHEN recent = 0 THEN 0 ELSE 100 END AS yoy,
   CASE WHEN n >= 24 AND slope2 > slope1 * 1.5 THEN 'accelerating'
     WHEN n >= 24 AND slope2 < slope1 * 0.5 AND slope > mean_v * 0.01 THEN 'decelerating'
     WHEN slope > mean_v * 0.01 THEN 'growing' WHEN slope < -mean_v * 0.01 THEN 'declining' ELSE 'stable' END AS direction"""


def long(source: str, keys: str) -> str:
    parts = [f"SELECT {keys}, '{m}' AS method, {i} AS ord, CAST({m} AS DOUBLE) AS yhat FROM {source}" for i, m in enumerate(CLOSED)]
    return " UNION ALL ".join(parts)


def finished(level: str, horizon: str = "12") -> str:
    flat = lambda sd, m: f"(CASE WHEN {m} <> 0 THEN {sd} / {m} ELSE 0 END) < 0.01"
    return f"""{all_closed(level, horizon=horizon)}, g0 AS (SELECT *, {GROWTH} FROM fc),
 g1 AS (SELECT series_key, h, n, method, ord, yhat, slope, mean_v, recent, yoy, direction,
     yhat + CASE WHEN abs(slope) > 0.001 * mean_v THEN slope * h ELSE 0 END AS tilted
   FROM ({long('g0', 'series_key, h, n, slope, mean_v, recent, yoy, direction')})),
 g2 AS (SELECT *, stddev_pop(yhat) OVER p AS sd, avg(yhat) OVER p AS av, stddev_pop(tilted) OVER p AS tsd, avg(tilted) OVER p AS tav
   FROM g1 WINDOW p AS (PARTITION BY series_key, method)),
 g3 AS (SELECT * EXCLUDE (yhat), CASE WHEN {flat('sd', 'av')} THEN CASE WHEN {flat('tsd', 'tav')} THEN yhat ELSE tilted END ELSE yhat END AS yhat FROM g2),
 g4 AS (SELECT *, sum(yhat) OVER (PARTITION BY series_key, method) AS total FROM g3),
 final AS (SELECT series_key, h, n, method, ord, CASE WHEN yoy > 5 AND direction IN ('growing', 'accelerating') AND total > 0 AND total < 0.7 * recent
   THEN yhat * least(0.88 * recent / total, 1.5) ELSE yhat END AS yhat FROM g4)"""


def scored(level: str, compat: bool = False) -> str:
    base = f"""{observed(level, 'holdout')}, tests AS (SELECT series_key, max(full_n) - greatest(3, max(full_n) // 5) AS cut,
      greatest(3, max(full_n) // 5) AS test FROM sized WHERE full_n >= 24 AND round(full_sum, 9) <> 0 GROUP BY series_key), {paths('test').replace('FROM (SELECT *, test AS horizon FROM s4) s4', 'FROM (SELECT s4.*, test AS horizon FROM s4 JOIN tests USING (series_key)) s4')}"""
    if compat:
        base += f""", {advanced('fc5', 'fc6', ('croston', 'sba', 'weighted_ma'))},
 fc AS (SELECT * REPLACE (exp_smoothing AS prophet), (exp_smoothing + croston + weighted_ma) / 3 AS ensemble FROM fc6)"""
    else:
        base += f""", {advanced('fc5', 'fc6')}, fc AS (SELECT *, (croston + sba + exp_smoothing) / 3 AS ensemble FROM fc6)"""
    return f"""{base},
 naive AS (SELECT series_key, avg(abs(d)) AS naive FROM (SELECT series_key, v - lag(v) OVER (PARTITION BY series_key ORDER BY t) AS d FROM obs) GROUP BY series_key),
 m0 AS (SELECT f.series_key, method, ord, CASE WHEN abs(yhat) < 1e-9 THEN 0 ELSE yhat END AS f, sized.v AS a FROM ({long('fc', 'series_key, h, n')}) f
   JOIN sized ON sized.series_key = f.series_key AND sized.t = f.n + f.h - 1),
 m1 AS (SELECT series_key, method, ord, avg(abs(a - f)) AS mae, sqrt(avg((a - f) * (a - f))) AS rmse,
   coalesce(avg(abs(a - f) / ((abs(a) + abs(f)) / 2)) FILTER (abs(a) + abs(f) > 0), 1) * 100 AS smape,
   coalesce(avg(abs(a - f) / a) FILTER (a > 0), 0) * 100 AS mae_pct, avg(f - a) AS bias,
   avg(f - a) / CASE WHEN avg(a) > 0 THEN avg(a) ELSE 1 END * 100 AS bias_pct, bool_and(f = 0) AS empty FROM m0 GROUP BY 1, 2, 3),
 m2 AS (SELECT m1.* EXCLUDE (mae_pct), mae_pct, mae_pct + abs(bias_pct) AS score_pct, CASE WHEN naive > 0 THEN mae / naive ELSE 0 END AS mase FROM m1 JOIN naive USING (series_key)),
 metrics AS (SELECT series_key, method, ord, CASE WHEN empty THEN 0 ELSE mae END AS mae, CASE WHEN empty THEN 0 ELSE rmse END AS rmse,
   CASE WHEN empty THEN 100 ELSE smape END AS smape, CASE WHEN empty THEN 100 ELSE mae_pct END AS mae_pct, CASE WHEN empty THEN 0 ELSE bias END AS bias,
   CASE WHEN empty THEN NULL ELSE bias_pct END AS bias_pct, CASE WHEN empty THEN NULL ELSE score_pct END AS score_pct,
   CASE WHEN empty THEN 0 ELSE mase END AS mase, CASE WHEN empty THEN 'empty' ELSE 'ok' END AS status FROM m2)"""


def best(by: str) -> str:
    where = "" if by == "smape" else "WHERE status = 'ok'"
    return f"""best AS (SELECT series_key, method, ord, {by} FROM metrics {where}
      QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY round({by}, 9), ord) = 1)"""


def forecasting() -> dict[str, str]:
    q: dict[str, str] = {}
    for level, metric, freq in SERIES:
        name = f"{level}_{UNIT[freq]}"
        q[f"series_{name}"] = f"WITH {sparse(level, metric, freq)} SELECT *, {LABEL[freq]} AS period FROM monthly"
        q[f"dense_{name}"] = f"WITH {dense(level, metric, freq)} SELECT * FROM dense"
    for freq in ("M", "Y"):
        q[f"series_status_{UNIT[freq]}"] = f"""WITH {dense('item', 'qty', freq)}, p AS (SELECT series_key, max(full_n) AS n, sum(v) AS total FROM sized GROUP BY 1)
          SELECT *, CASE WHEN total = 0 THEN 'zero' WHEN n < 12 THEN 'insufficient' ELSE 'ok' END AS status,
            CASE WHEN total = 0 THEN 'metric has no data' WHEN n < 12 THEN 'history of ' || n || ' periods is shorter than 12' END AS reason FROM p"""
    q["yearly_totals"] = f"WITH {dense('item')} SELECT series_key, CAST(year(period_start) AS INT) AS year, sum(value) AS value FROM dense GROUP BY 1, 2"
    for level in ("item", "cell"):
        q[f"demand_profile_{level}"] = f"""WITH {observed(level)}, {STATS}, d AS (SELECT series_key, n, nnz * 100.0::DOUBLE / n AS pct,
            CASE WHEN nnz > 1 THEN (hits[len(hits)] - hits[1])::DOUBLE / (nnz - 1) ELSE n END AS adi,
            CASE WHEN nnz > 1 THEN (sd_pos / mean_pos) ** 2 ELSE 0 END AS cv2 FROM s0)
          SELECT series_key, n, {r('pct', 9, 'pct_non_zero')}, {r('adi', 9, 'adi')}, {r('cv2', 9, 'cv2')},
            pct < 50 OR adi > 1.32 AS is_intermittent, cv2 > 0.5 AS is_volatile FROM d"""
        q[f"growth_profile_{level}"] = f"""WITH {observed(level)}, {STATS}, g AS (SELECT *, {GROWTH} FROM s0)
          SELECT series_key, yoy > 5 AND direction IN ('growing', 'accelerating') AS has_growth, {r('yoy', 6, 'yoy_growth_pct')},
            {r('slope', 6, 'trend_slope')}, direction AS trend_direction, {r('recent', 6, 'recent_sum')}, {r('earlier', 6, 'earlier_sum')} FROM g"""
        q[f"seasonal_index_{level}"] = f"WITH {observed(level)}, {STATS} SELECT series_key, CAST(ph AS INT) AS phase, {r('idx', 6, 'idx')} FROM season"
    for level, suffix in (("item", ""), ("cell", "_cell")):
        head = f"WITH {observed(level)}, {paths()}"
        for m in ("croston", "sba", "tsb", "adida", "exp_smoothing", "weighted_ma", "ma_benchmark", "exponential_trend", "prophet"):
            name = "trend_season" if m == "prophet" else m
            q[f"fc_{name}{suffix}"] = f"{head} SELECT series_key, CAST(h AS INT) AS h, {r(m, 6, 'yhat')} FROM fc2"
        q[f"fc_intelligent_growth{suffix}"] = f"WITH {observed(level)}, {paths('24')} SELECT series_key, CAST(h AS INT) AS h, {r('intelligent_growth', 6, 'yhat')} FROM fc5"
        q[f"fc_advanced_ensemble_closed{suffix}"] = f"WITH {all_closed(level)} SELECT series_key, CAST(h AS INT) AS h, {r('advanced_ensemble', 6, 'yhat')} FROM fc"
        q[f"fc_finished_{level}"] = f"WITH {finished(level)} SELECT series_key, CAST(h AS INT) AS h, method, {r('yhat', 6, 'yhat')} FROM final"
    q["fc_growth_base"] = f"WITH {observed('item')}, {paths()} SELECT series_key, CAST(h AS INT) AS h, {r('base', 6, 'yhat')} FROM fc3"
    q["fc_ensemble"] = f"WITH {all_closed('item')} SELECT series_key, CAST(h AS INT) AS h, {r('ensemble', 6, 'yhat')} FROM fc"
    q["fc_smart_calibration"] = f"""WITH {observed('item')}, {paths('30')},
      k0 AS (SELECT *, years[len(years)] * (1 + greatest(least(wg_age, 0.1), -0.05)) AS z1 FROM fc3),
      k1 AS (SELECT *, z1 * (1 + 0.7 * wg_age) AS z2, sum(croston) FILTER (h <= 12) OVER p AS k_t1, sum(croston) FILTER (h > 12) OVER p AS k_t2,
        vs[n - 11 + (h - 1) % 12] / CASE WHEN m12 > 0 THEN m12 ELSE 1 END AS form FROM k0 WINDOW p AS (PARTITION BY series_key))
      SELECT series_key, CAST(h AS INT) AS h, {r('''CASE WHEN len(years) < 2 OR len(growths) = 0 THEN croston ELSE greatest(CASE
        WHEN h <= 12 AND k_t1 > 0 AND (z1 = 0 OR abs(k_t1 - z1) / z1 > 0.35) THEN z1 / 12 * form
        WHEN h > 12 AND k_t2 > 0 AND (z2 = 0 OR abs(k_t2 - z2) / z2 > 0.35) THEN z2 / 18 * form ELSE croston END, 0) END''', 6, 'yhat')} FROM k1"""
    shown = ", ".join(r(m, 6, m) for m in METRICS)
    q["backtest_metrics_item"] = f"WITH {scored('item')} SELECT series_key, method, {shown}, status FROM metrics"
    q["backtest_metrics_cell"] = f"WITH {scored('cell')} SELECT series_key, method, {shown}, status FROM metrics"
    q["backtest_metrics_compat"] = f"WITH {scored('item', True)} SELECT series_key, method, {shown}, status FROM metrics"
    band = "CASE WHEN smape < 10 THEN 'Excellent' WHEN smape < 20 THEN 'Good' WHEN smape <= 50 THEN 'Acceptable' ELSE 'Poor' END AS band"
    for level in ("item", "cell"):
        q[f"best_method_{level}"] = f"WITH {scored(level)}, {best('smape')} SELECT series_key, method, {r('smape', 6, 'smape')}, {band} FROM best"
    q["best_method_by_mae"] = f"WITH {scored('item')}, {best('mae')} SELECT series_key, method, {r('mae', 6, 'mae')} FROM best"
    q["accuracy_ranking"] = f"""WITH {scored('item')} SELECT method, {r('avg(score_pct)', 6, 'score_pct')}, {r('avg(mae)', 6, 'mean_mae')} FROM metrics
      WHERE method <> 'intelligent_growth' GROUP BY method, ord ORDER BY avg(score_pct) NULLS LAST, ord LIMIT 12"""
    report = report_sql()
    q["forecast_report_closed"] = f"{report} SELECT series_key, period, type, {r('value', 6, 'value')}, method FROM report"
    q["report_totals"] = f"""{report} SELECT series_key, {r("sum(value) FILTER (type = 'Historical')", 4, 'historical_total')},
      {r("sum(value) FILTER (type = 'Forecast')", 4, 'forecast_total')}, {r("avg(value) FILTER (type = 'Forecast')", 4, 'forecast_avg')} FROM report GROUP BY series_key"""
    for name, by, where in (("score_all", "score_pct", ""), ("smape", "smape", "WHERE method <> 'intelligent_growth'"), ("score", "score_pct", "WHERE method <> 'intelligent_growth'")):
        shown_by = ", ".join(dict.fromkeys((r(by, 6, by), r("mae", 6, "mae"))))
        q[f"method_ranking_{name}"] = f"""WITH {scored('item')}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key
          ORDER BY round({by}, 9) NULLS LAST, ord) AS INT) AS rank FROM metrics {where}) SELECT series_key, rank, method, {shown_by} FROM ranked WHERE rank <= 12"""
    q["forecast_year_totals"] = f"""WITH {finished('item', '24')} SELECT series_key, method, {r('sum(yhat) FILTER (h <= 12)', 4, 'year1_total')},
      {r('sum(yhat) FILTER (h > 12)', 4, 'year2_total')} FROM final GROUP BY series_key, method"""
    for m, name in (("iets", "iets"), ("holt_winters", "holt_winters"), ("arima", "seasonal_ar"), ("lstm", "fixed_blend"), ("lightgbm", "meta_blend"), ("advanced_ensemble", "advanced_ensemble")):
        q[f"fc_{name}"] = f"WITH RECURSIVE {fitted_members()} SELECT series_key, CAST(h AS INT) AS h, {r(m, 6, 'yhat')} FROM fc"
    q["rolling_origins"] = rolling_sql()
    for dim in ("country", "cell"):
        q[f"rolled_up_{dim}_year"] = f"""WITH {LINES} SELECT {dim}, CAST(year(booked_date) AS INT) AS year, count(*) AS n_lines, {sums(('qty', 'usd_amount'))},
          count(DISTINCT sku) AS exact_items, TRUE AS items_within_bound FROM lines GROUP BY 1, 2"""
    q["node_series_cell_item"] = f"WITH {nodes(('cell', 'sku'))} SELECT * FROM node"
    q["reconciled_cell_item"] = reconciled(("cell", "sku"), "level")
    q["reconciled_cell_item_naive"] = reconciled(("cell", "sku"), "naive")
    q["reconciled_country_system"] = reconciled(("country", "system"), "level")
    for level in ("item", "cell"):
        q[f"fc_change_points_{level}"] = f"""WITH {change_points(level)}, ahead AS (SELECT unnest(range(1, 13)) AS h)
          SELECT series_key, CAST(h AS INT) AS h, {r(f"greatest(sum(c * {basis_value('(n + h - 1)', '((n + h - 1)::DOUBLE / (n - 1))')}), 0)", 4, 'yhat')}
          FROM coef, ahead GROUP BY series_key, h"""
        q[f"trend_segments_{level}"] = f"""WITH {change_points(level)} SELECT series_key,
            CASE lam WHEN 0 THEN 'flat' WHEN 0.25 THEN 'changing' ELSE 'linear' END AS branch, CAST(i - 1 AS INT) AS segment,
            {r('0.8::DOUBLE / 6 * (i - 1) * (n - 1)', 6, 'from_step')},
            {r('sum(c) OVER (PARTITION BY series_key ORDER BY i) / (n - 1)', 4, 'slope')} FROM coef WHERE i BETWEEN 1 AND 7"""
    draw = lambda tag: f"CAST('0x' || substr(md5(series_key || '|' || path || '|' || h || '|{tag}|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    value = """CASE WHEN hit < len(positives)::DOUBLE / n AND len(positives) > 0
        THEN positives[CAST(floor(pick * len(positives)) AS INT) + 1] * (1 + (noise - 0.5) * 0.4) ELSE 0 END"""
    q["bootstrap_paths"] = f"""WITH {observed('item')}, b AS (SELECT series_key, max(n) AS n, coalesce(list(v ORDER BY t) FILTER (v > 0), []) AS positives FROM obs GROUP BY series_key),
      d AS (SELECT *, {draw('pick')} AS pick, {draw('hit')} AS hit, {draw('noise')} AS noise
        FROM b, (SELECT unnest(range(1, 6)) AS path), (SELECT unnest(range(1, 13)) AS h))
      SELECT series_key, CAST(path AS INT) AS path, CAST(h AS INT) AS h, {r(value, 6, 'yhat')} FROM d"""
    q["run_metadata"] = f"""WITH {sparse('item')} SELECT 'item' AS level, 'qty' AS target_metric, 'M' AS frequency, 12 AS periods_ahead,
      CAST(NULL AS VARCHAR) AS filters, 16 AS models_used, count(DISTINCT series_key) AS series, count(*) AS periods FROM monthly"""
    return q


def report_sql() -> str:
    """Two chains of CTEs over the same names: the backtest goes into a subquery of its own."""
    chosen = f"(WITH {scored('item')}, {best('smape')} SELECT series_key, method FROM best)"
    return f"""WITH {finished('item')}, picked AS {chosen},
 pick AS (SELECT DISTINCT f.series_key, coalesce(p.method, 'intelligent_growth') AS method FROM final f LEFT JOIN picked p USING (series_key)),
 ends AS (SELECT series_key, max(period_start) AS last FROM dense GROUP BY series_key),
 report AS (SELECT series_key, strftime(period_start, '%Y-%m') AS period, 'Historical' AS type, value, 'Actual' AS method FROM dense
   UNION ALL SELECT series_key, strftime(last + to_months(CAST(h AS INT)), '%Y-%m'), 'Forecast', yhat, method
   FROM final JOIN pick USING (series_key, method) JOIN ends USING (series_key))"""


def oracle_sql() -> dict[str, str]:
    return relational() | forecasting()
