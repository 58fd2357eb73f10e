"""DuckDB SQL for every registered query, written apart from the Spark code.

The model is derived from the test tables by common table expressions; ratios are rounded
by whole-number division, half away from zero, so both engines give the same double.
"""

from __future__ import annotations

from marketlens.plans.marts import MARTS

DAY_US = 86_400_000_000

MODEL = {
    "raw_o": """
        SELECT k AS order_id, k AS customer_id, st AS order_status,
               p AS order_purchase_timestamp, a AS order_approved_at,
               c AS order_delivered_carrier_date,
               CASE WHEN s = 'F' AND k % 50 <> 7
                    THEN coalesce(c, a, p) + to_seconds(k * 32452843 % 1900800) END
                    AS order_delivered_customer_date,
               CASE WHEN k % 113 <> 0 THEN d + to_days(CAST(10 + k % 20 AS INTEGER)) END
                    AS order_estimated_delivery_date
        FROM (SELECT *, CASE WHEN s <> 'P' AND k % 89 <> 0
                             THEN coalesce(a, p) + to_seconds(k * 15485863 % 432000) END AS c
              FROM (SELECT *, CASE WHEN k % 97 <> 0 THEN p + to_seconds(k * 104729 % 172800) END AS a
                    FROM (SELECT o_orderkey AS k, o_orderstatus AS s,
                                 CASE WHEN o_orderkey % 1009 = 0 THEN NULL
                                      ELSE map {'F': 'delivered', 'O': 'shipped', 'P': 'canceled'}[o_orderstatus]
                                 END AS st,
                                 o_orderdate + to_days(8036) AS d,
                                 o_orderdate + to_days(8036) + to_seconds(o_orderkey * 7919 % 86400) AS p
                          FROM orders)))""",
    "o": """
        SELECT *, order_status IS NOT DISTINCT FROM 'delivered' AS is_delivered,
               order_status IS NOT DISTINCT FROM 'canceled' AS is_canceled,
               epoch_us(order_approved_at) - epoch_us(order_purchase_timestamp) AS approval_us,
               epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp) AS actual_us,
               epoch_us(order_estimated_delivery_date) - epoch_us(order_purchase_timestamp) AS promised_us,
               epoch_us(order_estimated_delivery_date) - epoch_us(order_delivered_customer_date) AS buffer_us,
               epoch_us(order_delivered_carrier_date) - epoch_us(order_approved_at) AS pre_us,
               epoch_us(order_delivered_customer_date) - epoch_us(order_delivered_carrier_date) AS transit_us,
               CAST(date_diff('day', CAST(order_estimated_delivery_date AS DATE),
                              CAST(order_delivered_customer_date AS DATE)) AS INTEGER) AS delay_days,
               CASE WHEN order_delivered_customer_date IS NULL THEN NULL
                    ELSE coalesce(CAST(order_delivered_customer_date AS DATE)
                                  > CAST(order_estimated_delivery_date AS DATE), FALSE) END AS is_late
        FROM raw_o""",
    "known": """
        SELECT *, CASE WHEN delay_days < -6 THEN 1 WHEN delay_days < 0 THEN 2 WHEN delay_days < 1 THEN 3
                       WHEN delay_days < 4 THEN 4 WHEN delay_days < 8 THEN 5 WHEN delay_days >= 8 THEN 6
                  END AS band,
               if(is_late, 'Late', 'On time / Early') AS lateness
        FROM o WHERE is_delivered AND order_delivered_customer_date IS NOT NULL""",
    "cu": """
        SELECT o_orderkey AS customer_id, concat(o_custkey, '-', o_orderkey % 8) AS customer_unique_id,
               n_name AS customer_state
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "i": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_shipdate + to_days(8036) AS shipping_limit_date,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS DECIMAL(12,2)) AS freight_value,
               CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_quantity AS DECIMAL(12,2)) AS item_total_value
        FROM lineitem""",
    "raw_pr": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 61 <> 0 THEN p_brand END AS product_category_name,
               CASE WHEN p_partkey % 61 <> 0 THEN CAST(length(p_name) AS INTEGER) END AS product_name_lenght,
               CASE WHEN p_partkey % 61 <> 0 THEN CAST(length(p_type) AS INTEGER) END
                    AS product_description_lenght,
               CASE WHEN p_partkey % 499 <> 1 THEN p_size END AS product_weight_g
        FROM part""",
    "tr": """
        SELECT DISTINCT p_brand AS product_category_name,
               'cat_' || split_part(p_brand, '#', 2) AS product_category_name_english
        FROM part WHERE p_brand <> 'Brand#7' AND p_brand <> 'Brand#13'""",
    "pr": """
        SELECT raw_pr.*, product_category_name_english AS translated,
               coalesce(product_category_name_english, 'unknown') AS product_category
        FROM raw_pr LEFT JOIN tr USING (product_category_name)""",
    "se": "SELECT s_suppkey AS seller_id FROM supplier",
    "r": """
        SELECT event_id AS review_id, event_id - (event_id % 3) * (event_id % 2) AS order_id,
               CASE WHEN event_id % 101 <> 0 THEN CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INTEGER) END
                    AS review_score,
               event_type || chr(10) || 'says "' || props || '", twice' AS review_comment_message,
               ts AS review_creation_date, ts + to_days(1) AS review_answer_timestamp
        FROM events""",
    "scored": """
        SELECT order_id, sum(review_score) AS s, count(review_score) AS n FROM r GROUP BY order_id""",
    "sold": """
        SELECT o.order_id, order_purchase_timestamp, price, freight_value, item_total_value
        FROM o JOIN i USING (order_id) WHERE is_delivered""",
    "by_month": """
        SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS mon,
               count(DISTINCT order_id) AS n, sum(price) AS gmv
        FROM sold GROUP BY ALL""",
}

NEEDS = {
    "o": ["raw_o"],
    "known": ["o"],
    "pr": ["raw_pr", "tr"],
    "scored": ["r"],
    "sold": ["o", "i"],
    "by_month": ["sold"],
}


def _ordered(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for each in [*_ordered(NEEDS.get(name, [])), name]:
            if each not in found:
                found.append(each)
    return found


def with_model(names: str, select: str, **extra: str) -> str:
    ctes = {name: MODEL[name] for name in _ordered(names.split())} | extra
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n" + select


def half_up(hundredths: str, den: str) -> str:
    """hundredths / den to the nearest whole number, half away from zero, as a double of two decimals."""
    n, d = f"CAST({hundredths} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    whole = f"sign({n}) * sign({d}) * ((2 * abs({n}) + abs({d})) // nullif(2 * abs({d}), 0))"
    return f"CAST({whole} AS DOUBLE) / 100"


def ratio(num: str, den: str) -> str:
    return half_up(f"100 * ({num})", den)


def days(us: str) -> str:
    return half_up(f"100 * sum({us})", f"count({us}) * CAST({DAY_US} AS HUGEINT)")


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


LATE_N = "count(*) FILTER (WHERE is_late)"
LATE_RATE = ratio(f"100 * {LATE_N}", "count(is_late)")
LATE_DELAY = ratio("sum(delay_days) FILTER (WHERE is_late)", "count(delay_days) FILTER (WHERE is_late)")
BAND_NAME = (
    "CASE {0} WHEN 1 THEN '7+ days early' WHEN 2 THEN '1-6 days early' WHEN 3 THEN 'On estimated date' "
    "WHEN 4 THEN '1-3 days late' WHEN 5 THEN '4-7 days late' WHEN 6 THEN '7+ days late' {1} END"
)
# The average score of an order is taken to eighteen decimals, as a whole number.
E18 = "CAST(1000000000000000000 AS HUGEINT)"
ORDER_SCORE = f"(2 * s * {E18} + n) // nullif(2 * n, 0)"
AVG_SCORE = half_up(f"100 * sum({ORDER_SCORE})", f"{E18} * count({ORDER_SCORE})")
LOW_RATE = ratio("100 * count(*) FILTER (WHERE s <= 2 * n)", "count(*)")
RATED = f"count(*) AS reviewed_orders, {AVG_SCORE} AS avg_review_score, {LOW_RATE} AS low_rating_rate_pct"


def share(source: str, key: str, count_name: str, share_name: str) -> str:
    return (
        f"SELECT {key}, count(*) AS {count_name}, {ratio('100 * count(*)', f'(SELECT count(*) FROM {source})')} "
        f"AS {share_name} FROM {source} GROUP BY {key}"
    )


def overall(count_name: str, delay_name: str) -> str:
    return with_model(
        "known",
        f"""SELECT count(*) AS {count_name}, {days("actual_us")} AS avg_delivery_days,
            {half_up("100 * CAST(2 * quantile_cont(actual_us, 0.5) AS HUGEINT)", f"CAST({2 * DAY_US} AS HUGEINT)")}
              AS median_delivery_days,
            {LATE_RATE} AS late_rate_pct, {LATE_DELAY} AS {delay_name} FROM known""",
    )


def growth(rows: str) -> str:
    """Months of ``rows`` (mon, n, gmv) with growth against the row before."""
    step = "OVER (ORDER BY mon)"
    return (
        f"SELECT mon, n, gmv, {ratio('100 * (n - pn)', 'pn')} AS order_mom_pct, "
        f"{half_up('10000 * CAST(100 * (gmv - pg) AS HUGEINT)', '100 * pg')} AS gmv_mom_pct "
        f"FROM (SELECT *, lag(n) {step} AS pn, lag(gmv) {step} AS pg FROM ({rows}))"
    )


def monthly_mart(where: str) -> str:
    sold = MODEL["by_month"].replace("FROM sold", f"FROM sold {where}")
    return with_model(
        "sold",
        f"""SELECT mon AS "month", n AS orders, {dbl("gmv")} AS merchandise_gmv,
            {ratio("gmv", "n")} AS merchandise_aov, order_mom_pct, gmv_mom_pct FROM ({growth(sold)})""",
    )


def mom(since: str) -> str:
    return with_model(
        "by_month",
        f"""SELECT mon AS "month", n AS orders, {dbl("gmv")} AS merchandise_gmv, order_mom_pct, gmv_mom_pct
            FROM ({growth("SELECT * FROM by_month")}) WHERE mon >= DATE '{since}'""",
    )


def states(columns: str, least: int) -> str:
    return with_model(
        "known cu",
        f"""SELECT customer_state, count(*) AS delivered_orders, {columns}
            FROM known JOIN cu USING (customer_id) GROUP BY customer_state HAVING count(*) >= {least}""",
    )


STATE_SPEED = (
    f"{days('actual_us')} AS avg_delivery_days, {LATE_RATE} AS late_rate_pct, "
    f"{LATE_DELAY} AS avg_delay_days_for_late_orders"
)
STATE_PROMISE = (
    f"{days('promised_us')} AS avg_promised_days, {days('actual_us')} AS avg_actual_delivery_days, "
    f"{days('buffer_us')} AS avg_delivery_buffer_days, {LATE_RATE} AS late_rate_pct"
)
STATE_PRIORITY = (
    f"{LATE_N} AS late_orders, {LATE_RATE} AS late_rate_pct, {days('actual_us')} AS avg_actual_delivery_days, "
    f"{days('promised_us')} AS avg_promised_days, {days('buffer_us')} AS avg_buffer_days"
)
STAGE_COLUMNS = (
    f"{days('pre_us')} AS avg_pre_carrier_days, {days('transit_us')} AS avg_transit_days, "
    f"{days('actual_us')} AS avg_total_delivery_days"
)
STAGED = "known WHERE order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL"
RISK = f"{LATE_N} AS late_orders, {LATE_RATE} AS late_rate_pct, {days('actual_us')} AS avg_delivery_days"


def sellers(least: int) -> str:
    return with_model(
        "known i",
        f"""SELECT seller_id, count(*) AS seller_orders, {dbl("sum(gmv)")} AS merchandise_gmv, {RISK}
            FROM (SELECT seller_id, order_id, sum(price) AS gmv FROM i GROUP BY ALL) JOIN known USING (order_id)
            GROUP BY seller_id HAVING count(*) >= {least}""",
    )


def categories(least: int, gmv: bool) -> str:
    value = f"{dbl('sum(gmv)')} AS merchandise_gmv," if gmv else ""
    return with_model(
        "known i pr",
        f"""SELECT product_category, count(*) AS category_orders, {value} {RISK}
            FROM (SELECT order_id, product_category, sum(price) AS gmv
                  FROM i JOIN pr USING (product_id) GROUP BY ALL) JOIN known USING (order_id)
            GROUP BY product_category HAVING count(*) >= {least}""",
    )


# ---------------------------------------------------------------- profiling

RAW_COLUMNS = {
    "orders": ("raw_o", "order_id customer_id order_status order_purchase_timestamp order_approved_at "
               "order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date"),
    "customers": ("cu", "customer_id customer_unique_id customer_state"),
    "order_items": ("i", "order_id order_item_id product_id seller_id shipping_limit_date price freight_value"),
    "products": ("raw_pr", "product_id product_category_name product_name_lenght product_description_lenght "
                 "product_weight_g"),
    "sellers": ("se", "seller_id"),
    "category_translation": ("tr", "product_category_name product_category_name_english"),
    "reviews": ("r", "review_id order_id review_score review_comment_message review_creation_date "
                "review_answer_timestamp"),
}
ALL_RAW = " ".join(cte for cte, _ in RAW_COLUMNS.values())


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def profile_shape() -> str:
    parts = [
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(cols.split())} AS column_count, "
        f"'{','.join(cols.split())}' AS column_names FROM {cte}"
        for t, (cte, cols) in RAW_COLUMNS.items()
    ]
    return with_model(ALL_RAW, _union(parts))


def _duplicates(cte: str, cols: str) -> str:
    listed = ", ".join(cols.split())
    return f"(SELECT count(*) FROM {cte}) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {cte}))"


def profile_tables() -> str:
    parts = []
    for t, (cte, cols) in RAW_COLUMNS.items():
        missing = [f"(SELECT count(*) FROM {cte} WHERE {c} IS NULL)" for c in cols.split()]
        parts.append(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {cte}) AS row_count, "
            f"{len(missing)} AS column_count, {_duplicates(cte, cols)} AS duplicate_rows, "
            f"{' + '.join(missing)} AS missing_cells, "
            f"{' + '.join(f'CAST({m} > 0 AS INTEGER)' for m in missing)} AS missing_columns"
        )
    return with_model(ALL_RAW, _union(parts))


def profile_missing() -> str:
    parts = []
    for t, (cte, cols) in RAW_COLUMNS.items():
        found = _union(
            [f"SELECT '{c}' AS c, count(*) AS n FROM {cte} WHERE {c} IS NULL" for c in cols.split()]
        )
        parts.append(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {cte}) AS row_count, "
            f"{len(cols.split())} AS column_count, {_duplicates(cte, cols)} AS duplicate_rows, "
            f"c AS column_name, coalesce(n, 0) AS missing_count "
            f"FROM (SELECT 1) LEFT JOIN ({found}) ON n > 0"
        )
    return with_model(ALL_RAW, _union(parts))


def null_counts(table: str, only_found: bool = False) -> str:
    cte, cols = RAW_COLUMNS[table]
    parts = _union(
        [
            f"SELECT '{c}' AS column_name, count(*) AS null_count FROM {cte} WHERE {c} IS NULL"
            for c in cols.split()
        ]
    )
    return with_model(cte, f"SELECT * FROM ({parts}) WHERE null_count >= {int(only_found)}")


def key_uniqueness() -> str:
    single = (
        ("orders", "raw_o", "order_id"),
        ("customers", "cu", "customer_id"),
        ("products", "raw_pr", "product_id"),
        ("sellers", "se", "seller_id"),
    )
    parts = [
        f"SELECT '{t}' AS table_name, '{k}' AS key_columns, count(*) AS row_count, "
        f"count(DISTINCT {k}) AS distinct_keys FROM {cte}"
        for t, cte, k in single
    ]
    parts.append(
        "SELECT 'order_items', 'order_id,order_item_id', (SELECT count(*) FROM i), "
        "(SELECT count(*) FROM (SELECT DISTINCT order_id, order_item_id FROM i))"
    )
    return with_model("raw_o cu raw_pr se i", _union(parts))


def entity_counts() -> str:
    entities = (
        ("customer records", "cu", "customer_id"),
        ("real customers", "cu", "customer_unique_id"),
        ("orders", "raw_o", "order_id"),
        ("orders with items", "i", "order_id"),
        ("products sold", "i", "product_id"),
        ("active sellers", "i", "seller_id"),
    )
    parts = [f"SELECT '{e}' AS entity, count(DISTINCT {c}) AS distinct_count FROM {t}" for e, t, c in entities]
    return with_model("cu raw_o i", _union(parts))


LINKS = (
    ("orders", "raw_o", "customer_id", "customers", "cu"),
    ("order_items", "i", "order_id", "orders", "raw_o"),
    ("order_items", "i", "product_id", "products", "raw_pr"),
    ("order_items", "i", "seller_id", "sellers", "se"),
)


def _orphans(cte: str, key: str, parent: str) -> str:
    return (
        f"(SELECT count(*) FROM {cte} AS ch WHERE NOT EXISTS "
        f"(SELECT 1 FROM {parent} AS pa WHERE pa.{key} IS NOT DISTINCT FROM ch.{key}))"
    )


def orphan_counts() -> str:
    parts = [
        f"SELECT '{ct}' AS child_table, '{k}' AS key_column, '{pt}' AS parent_table, "
        f"{_orphans(cc, k, pc)} AS orphans"
        for ct, cc, k, pt, pc in LINKS
    ]
    return with_model("raw_o cu i raw_pr se", _union(parts))


def _rules(parts: list[str]) -> str:
    return f"SELECT rule, violations, violations = 0 AS passed FROM ({_union(parts)})"


def unique_keys() -> str:
    keys = (
        ("orders", "o", "order_id"),
        ("customers", "cu", "customer_id"),
        ("products", "pr", "product_id"),
        ("sellers", "se", "seller_id"),
    )
    parts = [
        f"SELECT '{t}.{k} is unique' AS rule, (SELECT count(*) FROM {cte}) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT {k} FROM {cte})) AS violations"
        for t, cte, k in keys
    ]
    return with_model("o cu pr se", _rules(parts))


def foreign_keys() -> str:
    parts = [
        f"SELECT '{ct}.{k} exists in {pt}' AS rule, {_orphans(cc, k, pc)} AS violations"
        for ct, cc, k, pt, pc in LINKS
        if ct == "order_items"
    ]
    return with_model("raw_o i raw_pr se", _rules(parts))


ORPHANED = "raw_o WHERE order_id NOT IN (SELECT order_id FROM i)"

ORDER_COLUMNS = (
    "order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at, "
    "order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date"
)
DURATIONS = (
    "approval_us / 1000000 / 3600 AS approval_hours, actual_us / 1000000 / 86400 AS delivery_days, delay_days, is_late"
)
UNREADABLE = "order_id % 41 = 0 OR order_id % 43 = 0 OR order_id % 47 = 0"
PARSED_CARRIER = (
    f"CASE WHEN {UNREADABLE} THEN NULL ELSE order_delivered_carrier_date END AS order_delivered_carrier_date"
)
PROCESSED_PRODUCTS = (
    "SELECT product_id, product_category_name, product_name_lenght AS product_name_length, "
    "product_description_lenght AS product_description_length, product_weight_g, product_category FROM pr"
)


def digests(table: str, select: str) -> str:
    """Rows, known values and digest of each column; numbers and times as whole numbers."""
    text = """CASE WHEN typeof(COLUMNS(*)) = 'DOUBLE' THEN CAST(CAST(floor(1000 * TRY_CAST(CAST(COLUMNS(*) AS VARCHAR) AS DOUBLE)) AS HUGEINT) AS VARCHAR)
        WHEN typeof(COLUMNS(*)) LIKE 'DECIMAL%' THEN CAST(CAST(100 * TRY_CAST(CAST(COLUMNS(*) AS VARCHAR) AS DECIMAL(20,2)) AS HUGEINT) AS VARCHAR)
        WHEN typeof(COLUMNS(*)) LIKE 'TIMESTAMP%' THEN CAST(epoch_us(TRY_CAST(CAST(COLUMNS(*) AS VARCHAR) AS TIMESTAMP)) AS VARCHAR)
        WHEN typeof(COLUMNS(*)) = 'BOOLEAN' THEN CASE CAST(COLUMNS(*) AS VARCHAR) WHEN 'true' THEN '1' WHEN 'false' THEN '0' END
        ELSE CAST(COLUMNS(*) AS VARCHAR) END"""
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count, column_name, count(val) AS known,
            CAST(coalesce(sum(CAST('0x' || substr(md5(val), 1, 8) AS BIGINT)), 0) AS BIGINT) AS digest
        FROM (FROM (SELECT {text} FROM ({select})) UNPIVOT INCLUDE NULLS (val FOR column_name IN (COLUMNS(*))))
        GROUP BY column_name"""


def stored_contents(orders: str, items: str, reviews: str, more: tuple[tuple[str, str], ...] = ()) -> str:
    tables = (
        ("customers", "FROM cu"),
        ("products", PROCESSED_PRODUCTS),
        ("sellers", "FROM se"),
        ("orders", orders),
        ("reviews", reviews),
        ("order_items", items),
        *more,
    )
    return with_model("cu pr se o r i", _union([digests(t, select) for t, select in tables]))


def losses() -> str:
    """Planted losses per typed column of the delivered texts."""
    dates = ("order_purchase_timestamp", "order_approved_at", "order_delivered_customer_date", "order_estimated_delivery_date")
    carrier = "order_delivered_carrier_date"
    given = f"order_id % 41 = 0 OR ({carrier} IS NOT NULL AND (order_id % 43 = 0 OR order_id % 47 <> 0))"
    cut = f"order_id % 41 = 0 OR ({carrier} IS NOT NULL AND order_id % 43 = 0)"
    bad_price = "order_id % 59 = 0 OR order_id % 61 = 0 OR order_id % 67 = 0"
    checks = [
        *(("orders", "raw_o", d, f"{d} IS NOT NULL", "FALSE") for d in dates),
        ("orders", "raw_o", carrier, given, cut),
        ("order_items", "i", "order_item_id", "order_item_id IS NOT NULL", "FALSE"),
        ("order_items", "i", "shipping_limit_date", "order_id % 53 = 0 OR shipping_limit_date IS NOT NULL", "order_id % 53 = 0"),
        ("order_items", "i", "price", f"{bad_price} OR price IS NOT NULL", bad_price),
        ("order_items", "i", "freight_value", "freight_value IS NOT NULL", "FALSE"),
        *(("products", "raw_pr", c, f"{c} IS NOT NULL", "FALSE") for c in ("product_name_lenght", "product_description_lenght")),
        ("reviews", "r", "review_score", "review_id % 71 = 0 OR review_score IS NOT NULL", "review_id % 71 = 0"),
        *(("reviews", "r", c, f"{c} IS NOT NULL", "FALSE") for c in ("review_creation_date", "review_answer_timestamp")),
    ]
    parts = [
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) FILTER (WHERE {present}) AS present, "
        f"count(*) FILTER (WHERE {gone}) AS lost FROM {cte}"
        for table, cte, column, present, gone in checks
    ]
    return with_model("raw_o i raw_pr r", _union(parts))


def oracle_queries() -> dict[str, str]:
    delivered_count = "count(DISTINCT order_id)"
    q: dict[str, str] = {}

    # business overview
    q["q02_1_coverage"] = with_model(
        "o",
        "SELECT min(order_purchase_timestamp) AS first_order_date, "
        "max(order_purchase_timestamp) AS last_order_date, count(*) AS total_orders FROM o",
    )
    q["q02_2_status_share"] = with_model("o", share("o", "order_status", "orders", "order_share_pct"))
    q["q02_3_delivered_overview"] = with_model(
        "sold",
        f"""SELECT {delivered_count} AS delivered_orders, {dbl("sum(price)")} AS merchandise_gmv,
            {dbl("sum(freight_value)")} AS freight_revenue, {dbl("sum(item_total_value)")} AS gross_order_value,
            {ratio("sum(price)", delivered_count)} AS merchandise_aov FROM sold""",
    )
    q["q02_4_monthly"] = with_model(
        "by_month",
        f"""SELECT mon AS "month", n AS orders, {dbl("gmv")} AS merchandise_gmv, {ratio("gmv", "n")} AS aov
            FROM by_month""",
    )
    q["q02_5_mom_growth"] = mom("2017-02-01")

    # fulfillment
    q["q03_1_overall"] = overall("delivered_orders", "avg_delay_days_for_late_orders")
    band_share = ratio("100 * count(*)", "(SELECT count(*) FROM known)")
    q["q03_2_bands"] = with_model(
        "known",
        f"""SELECT {BAND_NAME.format("band", "ELSE 'Unknown'")} AS delivery_band, count(*) AS orders,
            {band_share} AS share_pct FROM known GROUP BY band""",
    )
    q["q03_3_state"] = states(STATE_SPEED, 100)
    q["q03_3_state_min_200"] = states(STATE_SPEED, 200)
    q["q03_4_stage"] = with_model("known", f"SELECT {STAGE_COLUMNS} FROM {STAGED}")
    stage = with_model(
        "known",
        f"SELECT lateness AS delivery_status, count(*) AS orders, {STAGE_COLUMNS} FROM {STAGED} GROUP BY lateness",
    )
    q["q03_5_stage_late_vs_ontime"] = stage
    q["q03_6_promise_state"] = states(STATE_PROMISE, 100)
    q["q03_6_promise_state_min_200"] = states(STATE_PROMISE, 200)
    q["q03_7_priority_state"] = states(STATE_PRIORITY, 100)
    q["q03_7_priority_state_min_200"] = states(STATE_PRIORITY, 200)

    # sellers and categories
    q["q04_1_top_sellers"] = with_model(
        "o i",
        f"""SELECT seller_id, {delivered_count} AS orders, count(*) AS items_sold,
            {dbl("sum(price)")} AS merchandise_gmv, {dbl("sum(freight_value)")} AS freight_value,
            {ratio("sum(price)", delivered_count)} AS gmv_per_order
            FROM i JOIN o USING (order_id) WHERE is_delivered GROUP BY seller_id
            ORDER BY sum(price) DESC, seller_id LIMIT 20""",
    )
    q["q04_2_seller_risk"] = sellers(100)
    q["q04_2_seller_risk_min_185"] = sellers(185)
    q["q04_3_top_categories"] = with_model(
        "o i pr",
        f"""SELECT product_category, {delivered_count} AS orders, count(*) AS items_sold,
            {dbl("sum(price)")} AS merchandise_gmv,
            {ratio("sum(price)", delivered_count)} AS category_revenue_per_order,
            {ratio("sum(price)", "count(price)")} AS avg_item_price
            FROM i JOIN pr USING (product_id) JOIN o USING (order_id) WHERE is_delivered
            GROUP BY product_category ORDER BY sum(price) DESC, product_category LIMIT 20""",
    )
    q["q04_4_category_risk"] = categories(300, gmv=False)
    q["q04_4_category_risk_min_700"] = categories(700, gmv=False)

    # customer experience
    q["q05_1_review_dist"] = with_model("r", share("r", "review_score", "reviews", "share_pct"))
    q["q05_2_late_vs_review"] = with_model(
        "known scored",
        f"SELECT lateness AS delivery_status, {RATED} FROM known JOIN scored USING (order_id) GROUP BY lateness",
    )
    q["q05_3_delay_vs_review"] = with_model(
        "known scored",
        f"""SELECT {BAND_NAME.format("band", "")} AS delivery_band, {RATED}
            FROM known JOIN scored USING (order_id) GROUP BY band""",
    )
    repeat = with_model(
        "o cu",
        f"""SELECT count(*) AS unique_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers,
            {ratio("100 * count(*) FILTER (WHERE n > 1)", "count(*)")} AS repeat_customer_rate_pct,
            {ratio("sum(n)", "count(*)")} AS avg_orders_per_customer
            FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n
                  FROM cu JOIN o USING (customer_id) GROUP BY customer_unique_id)""",
    )
    q["q05_4_repeat_customers"] = repeat

    # marts
    q["vw_executive_kpis"] = with_model(
        "sold",
        f"""SELECT (SELECT count(*) FROM o) AS total_orders, {delivered_count} AS delivered_orders,
            {dbl("sum(price)")} AS merchandise_gmv,
            {ratio("sum(price)", delivered_count)} AS merchandise_aov,
            {ratio("100 * (SELECT count(*) FROM o WHERE is_canceled)", "(SELECT count(*) FROM o)")}
              AS cancellation_rate_pct FROM sold""",
    )
    q["vw_monthly_business"] = monthly_mart(
        "WHERE order_purchase_timestamp >= TIMESTAMP '2017-01-01' AND order_purchase_timestamp < TIMESTAMP '2018-09-01'"
    )
    q["vw_monthly_business_all_months"] = monthly_mart("")
    q["vw_order_status"] = q["q02_2_status_share"]
    q["vw_delivery_bands"] = with_model(
        "known",
        f"""SELECT {BAND_NAME.format("band", "")} AS delivery_band, band AS sort_order, count(*) AS orders,
            {band_share} AS share_pct FROM known GROUP BY band""",
    )
    q["vw_state_fulfillment"] = states(STATE_PRIORITY, 100)
    q["vw_state_fulfillment_min_200"] = states(STATE_PRIORITY, 200)
    q["vw_fulfillment_stage"] = stage
    q["vw_seller_performance"] = sellers(100)
    q["vw_seller_performance_min_185"] = sellers(185)
    q["vw_category_performance"] = categories(300, gmv=True)
    q["vw_category_performance_min_700"] = categories(700, gmv=True)
    q["vw_review_distribution"] = with_model("r", share("r", "review_score", "reviews", "review_share_pct"))
    q["vw_delivery_customer_experience"] = with_model(
        "known scored",
        f"""SELECT {BAND_NAME.format("band", "")} AS delivery_band, band AS sort_order,
            lateness AS delivery_status, {RATED}
            FROM known JOIN scored USING (order_id) GROUP BY band, lateness""",
    )
    q["vw_repeat_customer_kpis"] = repeat
    q["vw_fulfillment_kpis"] = overall("analyzable_delivered_orders", "avg_delay_days_late")

    # profiling and validation
    q["profile_shape"] = profile_shape()
    q["profile_missing"] = profile_missing()
    q["profile_tables"] = profile_tables()
    q["key_uniqueness"] = key_uniqueness()
    q["entity_counts"] = entity_counts()
    q["orphan_counts"] = orphan_counts()
    q["null_counts_orders"] = null_counts("orders")
    q["null_counts_by_status"] = with_model(
        "raw_o",
        """SELECT order_status, count(*) FILTER (WHERE order_approved_at IS NULL) AS order_approved_at,
           count(*) FILTER (WHERE order_delivered_carrier_date IS NULL) AS order_delivered_carrier_date,
           count(*) FILTER (WHERE order_delivered_customer_date IS NULL) AS order_delivered_customer_date
           FROM raw_o WHERE order_status IS NOT NULL GROUP BY order_status""",
    )
    q["orders_without_items"] = with_model("raw_o i", f"SELECT {ORDER_COLUMNS} FROM {ORPHANED}")
    q["orders_without_items_by_status"] = with_model(
        "raw_o i",
        f"SELECT order_status, count(*) AS orders FROM {ORPHANED} AND order_status IS NOT NULL GROUP BY order_status",
    )
    q["product_missing"] = null_counts("products", only_found=True)
    q["review_profile"] = with_model(
        "r",
        """SELECT count(*) AS row_count, count(DISTINCT review_id) AS distinct_reviews,
           count(DISTINCT order_id) AS distinct_orders,
           count(*) FILTER (WHERE review_score IS NULL) AS missing_scores FROM r""",
    )
    q["reviews_per_order_hist"] = with_model(
        "r",
        "SELECT n AS reviews, count(*) AS orders FROM (SELECT order_id, count(*) AS n FROM r GROUP BY order_id) GROUP BY n",
    )
    q["assert_unique_keys"] = unique_keys()
    q["assert_foreign_keys"] = foreign_keys()

    # cleaning
    q["clean_parse_ts"] = with_model(
        "raw_o",
        f"""SELECT order_id, order_purchase_timestamp, order_approved_at, {PARSED_CARRIER},
            order_delivered_customer_date, order_estimated_delivery_date FROM raw_o""",
    )
    q["clean_parse_ts_items"] = with_model(
        "i",
        """SELECT order_id, order_item_id, product_id, seller_id,
           CASE WHEN order_id % 53 <> 0 THEN shipping_limit_date END AS shipping_limit_date FROM i""",
    )
    q["clean_parse_ts_reviews"] = with_model(
        "r",
        """SELECT review_id, date_trunc('second', review_creation_date) AS review_creation_date,
           date_trunc('second', review_answer_timestamp) AS review_answer_timestamp FROM r""",
    )
    q["clean_is_delivered"] = with_model("o", "SELECT order_id, order_status, is_delivered FROM o")
    q["clean_is_canceled"] = with_model("o", "SELECT order_id, order_status, is_canceled FROM o")
    q["clean_approval_hours"] = with_model(
        "o", "SELECT order_id, approval_us / 1000000 / 3600 AS approval_hours FROM o"
    )
    q["clean_delivery_days"] = with_model("o", "SELECT order_id, actual_us / 1000000 / 86400 AS delivery_days FROM o")
    q["clean_delay_days"] = with_model("o", "SELECT order_id, delay_days FROM o")
    q["clean_is_late"] = with_model("o", "SELECT order_id, delay_days, is_late FROM o")
    q["clean_item_total"] = with_model(
        "i",
        f"""SELECT order_id, order_item_id, product_id, {dbl("price")} AS price,
            {dbl("freight_value")} AS freight_value, {dbl("item_total_value")} AS item_total_value FROM i""",
    )
    q["clean_rename_products"] = with_model(
        "raw_pr",
        """SELECT product_id, product_category_name, product_name_lenght AS product_name_length,
           product_description_lenght AS product_description_length, product_weight_g FROM raw_pr""",
    )
    q["clean_translate_category"] = with_model(
        "pr", "SELECT product_id, product_category_name, translated AS product_category FROM pr"
    )
    q["clean_fill_category"] = with_model("pr", "SELECT product_id, product_category_name, product_category FROM pr")

    # sources and sinks
    read_items = """SELECT * REPLACE (CASE WHEN order_id % 53 <> 0 THEN shipping_limit_date END AS shipping_limit_date) FROM i"""
    read_reviews = """SELECT * REPLACE (date_trunc('second', review_creation_date) AS review_creation_date,
        date_trunc('second', review_answer_timestamp) AS review_answer_timestamp) FROM r"""
    read_orders = f"""SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
            {PARSED_CARRIER}, order_delivered_customer_date, order_estimated_delivery_date,
            is_delivered, is_canceled, {DURATIONS} FROM o"""
    q["src_raw_csv"] = stored_contents(read_orders, read_items, read_reviews, (("category_translation", "FROM tr"),))
    timed = "('orders', 'order_items', 'reviews')"
    q["src_raw_csv_layouts"] = f"SELECT * FROM ({q['src_raw_csv']}) WHERE table_name IN {timed}"
    q["src_raw_csv_text"] = with_model(
        "r",
        """SELECT review_id, order_id, review_score, review_comment_message,
           date_trunc('second', review_creation_date) AS review_creation_date FROM r""",
    )
    q["src_processed"] = stored_contents(
        f"SELECT {ORDER_COLUMNS}, is_delivered, is_canceled, {DURATIONS} FROM o", "FROM i", "FROM r"
    )
    q["src_tristate_flags"] = with_model("o", "SELECT order_id, is_delivered, is_canceled, is_late FROM o")
    q["sink_processed"] = q["sink_publish"] = q["src_processed"]
    q["cast_losses"] = losses()
    views = [name for name in q if name in MARTS]
    q["q04_3_top_categories_split"] = q["q04_3_top_categories"]
    q["vw_category_performance_split"] = q["vw_category_performance"]
    q["clean_translate_category_split"] = q["clean_translate_category"]
    q["src_raw_csv_text_split"] = q["src_raw_csv_text"]
    q["sink_view"] = q["sink_marts"] = _union([digests(v, q[v]) for v in views])
    return q
