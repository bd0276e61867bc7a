"""DuckDB SQL for the registered queries, written on the given tables only.

Each text starts with the common table expressions it needs. Where the Spark
plan avoids work (candidate bounds, weighted cells, per-order sums), the SQL does
the plain thing instead: all pairs, window functions over everything.
"""

from __future__ import annotations

from storelens.operators.questions import HEADINGS, TOPICS

CTES = {
    # raw tables
    "places": "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "r_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
               n_name AS customer_city, r_name AS customer_state
        FROM customer LEFT JOIN places ON c_nationkey = n_nationkey""",
    "r_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS order_approved_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS order_delivered_carrier_date,
               (SELECT MIN(l_shipdate) FROM lineitem
                WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) AS order_delivered_customer_date,
               o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date
        FROM orders""",
    "r_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight_value
        FROM lineitem""",
    "r_payments": """
        SELECT o_orderkey AS order_id, 1 AS payment_sequential, o_orderpriority AS payment_type,
               CAST(1 + o_orderkey % 12 AS INTEGER) AS payment_installments,
               CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
        FROM orders
        UNION ALL
        SELECT o_orderkey, 2, 'voucher', 1, CAST(10 AS DECIMAL(12,2)) FROM orders WHERE o_orderkey % 10 = 0""",
    "r_reviews": """
        SELECT event_id AS review_id, event_id - event_id % 2 AS order_id,
               CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INTEGER) AS review_score
        FROM events""",
    "r_translation": """
        SELECT DISTINCT p_brand AS product_category_name,
               'category_' || substr(p_brand, 7) AS product_category_name_english
        FROM part WHERE p_brand NOT IN ('Brand#10', 'Brand#20')""",
    "clean_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_brand = 'Brand#13' THEN 'unknown' ELSE p_brand END AS product_category_name,
               CAST(p_size AS DOUBLE) AS product_weight_g, CAST(2 * p_size AS DOUBLE) AS product_length_cm,
               CAST(NULL AS DOUBLE) AS product_height_cm, p_retailprice AS product_width_cm
        FROM part""",
    "r_products": """
        SELECT p.*, COALESCE(t.product_category_name_english, 'unknown') AS product_category_name_english
        FROM clean_products p LEFT JOIN r_translation t USING (product_category_name)""",
    "rollup": """
        SELECT order_id, first(payment_type ORDER BY payment_sequential) AS payment_type,
               MAX(payment_installments) AS payment_installments, SUM(payment_value) AS payment_value
        FROM r_payments GROUP BY order_id""",
    # star schema
    "fact": """
        SELECT i.*, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
               o.order_delivered_carrier_date, o.order_delivered_customer_date, o.order_estimated_delivery_date,
               p.product_category_name, p.product_category_name_english,
               c.customer_unique_id, c.customer_city, c.customer_state,
               i.price + i.freight_value AS total_amount,
               CAST(year(o.order_purchase_timestamp) AS INTEGER) AS year,
               CAST(month(o.order_purchase_timestamp) AS INTEGER) AS month,
               CAST(quarter(o.order_purchase_timestamp) AS INTEGER) AS quarter,
               strftime(o.order_purchase_timestamp, '%Y-%m') AS year_month,
               dayname(o.order_purchase_timestamp) AS day_of_week,
               y.payment_type, y.payment_installments, y.payment_value
        FROM r_items i LEFT JOIN r_orders o USING (order_id) LEFT JOIN r_products p USING (product_id)
        LEFT JOIN r_customers c USING (customer_id) LEFT JOIN rollup y USING (order_id)""",
    "delivery": """
        SELECT CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp))
                          / 86400000000) AS INTEGER) AS delivery_days
        FROM r_orders WHERE order_delivered_customer_date IS NOT NULL""",
    # recency, frequency, monetary
    "snap": "SELECT MAX(order_purchase_timestamp) + INTERVAL 1 DAY AS day FROM fact",
    "rfm": """
        SELECT customer_unique_id,
               CAST(floor((epoch_us((SELECT day FROM snap)) - epoch_us(MAX(order_purchase_timestamp)))
                          / 86400000000) AS INTEGER) AS recency,
               COUNT(DISTINCT order_id) AS frequency, SUM(total_amount) AS monetary
        FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id""",
    "ranked": """
        SELECT *, row_number() OVER (ORDER BY frequency, customer_unique_id) AS frequency_rank FROM rfm""",
    "edges": """
        SELECT {r25} AS r1, {r50} AS r2, {r75} AS r3, {m25} AS m1, {m50} AS m2, {m75} AS m3,
               COUNT(*) AS n FROM (SELECT recency AS r, CAST(monetary AS DOUBLE) AS m FROM rfm)""",
    "scores": """
        SELECT customer_unique_id, recency, frequency, monetary,
               CASE WHEN recency <= r1 THEN 4 WHEN recency <= r2 THEN 3 WHEN recency <= r3 THEN 2 ELSE 1 END AS R_score,
               CASE WHEN frequency_rank <= 1 + (n - 1) * 0.25 THEN 1 WHEN frequency_rank <= 1 + (n - 1) * 0.5 THEN 2
                    WHEN frequency_rank <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS F_score,
               CASE WHEN CAST(monetary AS DOUBLE) <= m1 THEN 1 WHEN CAST(monetary AS DOUBLE) <= m2 THEN 2
                    WHEN CAST(monetary AS DOUBLE) <= m3 THEN 3 ELSE 4 END AS M_score
        FROM ranked, edges""",
    "centres": """
        SELECT * FROM (VALUES (0, 4, 4, 4), (1, 4, 2, 2), (2, 2, 3, 4), (3, 1, 2, 3), (4, 2, 2, 1))
        AS t(cluster, r, f, m)""",
    "clustered": """
        SELECT s.*, (SELECT c.cluster FROM centres c
                     ORDER BY (s.R_score - c.r) ** 2 + (s.F_score - c.f) ** 2 + (s.M_score - c.m) ** 2, c.cluster
                     LIMIT 1) AS cluster
        FROM scores s""",
    "means": """
        SELECT cluster, COUNT(*) AS n_customers, {e_recency} AS recency, {e_frequency} AS frequency,
               {e_monetary} AS monetary, {e_R_score} AS R_score, {e_F_score} AS F_score, {e_M_score} AS M_score
        FROM clustered GROUP BY cluster""",
    "labelled": """
        SELECT *, CASE WHEN monetary >= m_mid * 1.3::DOUBLE AND frequency >= 1.05::DOUBLE THEN 'VIP'
                       WHEN recency <= r_mid AND monetary >= m_mid THEN 'Loyal'
                       WHEN recency <= r_mid THEN 'New'
                       WHEN monetary >= m_mid THEN 'At Risk' ELSE 'Lost' END AS base
        FROM means, (SELECT median(recency) AS r_mid, median(monetary) AS m_mid FROM means)""",
    "profile": """
        SELECT cluster, n_customers, recency, frequency, monetary, R_score, F_score, M_score,
               CAST(round_even(CAST(100::DOUBLE * n_customers / (SELECT SUM(n_customers) FROM means)
                    AS DECIMAL(38,10)), 2) AS DOUBLE) AS pct,
               base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY cluster) = 1 THEN ''
                       ELSE '_' || row_number() OVER (PARTITION BY base ORDER BY cluster) END AS label
        FROM labelled""",
    "segments": """
        SELECT c.*, p.label AS segment FROM clustered c JOIN profile p USING (cluster)""",
    # churn
    "churn": """
        SELECT customer_unique_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
               CASE WHEN recency > 180 THEN 1 ELSE 0 END AS churn,
               score AS churn_probability, CASE WHEN score > 0.5::DOUBLE THEN 1 ELSE 0 END AS churn_prediction
        FROM (SELECT *, floor(100 * (('0x' || substr(md5(customer_unique_id), 1, 8))::BIGINT
                              / 4294967296::DOUBLE)) / 100::DOUBLE AS score FROM rfm)""",
    "scored": "SELECT churn AS label, churn_probability AS score, churn_prediction AS prediction FROM churn",
    "cust_reviews": """
        SELECT customer_unique_id, CAST(SUM(review_score) AS DOUBLE) / NULLIF(COUNT(review_score), 0) AS avg_review_score,
               COUNT(review_score) AS n_reviews
        FROM (SELECT DISTINCT order_id, customer_unique_id FROM fact WHERE customer_unique_id IS NOT NULL)
        LEFT JOIN r_reviews USING (order_id) GROUP BY customer_unique_id""",
    # recommendation
    "popular": """
        SELECT *, row_number() OVER (ORDER BY n_customers DESC, n_purchases DESC, product_id) AS popularity_rank
        FROM (SELECT product_id, COUNT(order_id) AS n_purchases,
                     COUNT(DISTINCT customer_unique_id) AS n_customers,
                     MIN(product_category_name_english) AS category
              FROM fact GROUP BY product_id HAVING COUNT(order_id) >= 30)""",
    "favourites": """
        SELECT customer_unique_id, category,
               CAST(row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, category) AS INTEGER) AS fav_rank
        FROM (SELECT customer_unique_id, product_category_name_english AS category, COUNT(*) AS n
              FROM fact WHERE customer_unique_id IS NOT NULL AND product_category_name_english IS NOT NULL
              GROUP BY 1, 2)""",
    "bought": "SELECT DISTINCT customer_unique_id, product_id FROM fact WHERE customer_unique_id IS NOT NULL",
    "recos": """
        SELECT customer_unique_id, product_id, category,
               CAST(row_number() OVER (PARTITION BY customer_unique_id ORDER BY source, a, b) AS INTEGER) AS rank
        FROM (SELECT f.customer_unique_id, t.product_id, t.category, 0 AS source, f.fav_rank AS a, t.cat_rank AS b
              FROM favourites f JOIN lists t USING (category)
              UNION ALL
              SELECT c.customer_unique_id, p.product_id, p.category, 1, p.popularity_rank, 0
              FROM (SELECT DISTINCT customer_unique_id FROM bought) c, popular p
              WHERE NOT EXISTS (SELECT 1 FROM favourites f JOIN lists t USING (category)
                                WHERE f.customer_unique_id = c.customer_unique_id AND t.product_id = p.product_id)) x
        WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_unique_id = x.customer_unique_id
                          AND b.product_id = x.product_id)
        QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY source, a, b) <= {n}""",
    # questions
    "asked": """
        SELECT 'c-' || conv_id || '-' || turn AS question_id, text AS question
        FROM conversations WHERE role = 'user'
        UNION ALL
        SELECT 'p-' || p_partkey, CASE p_partkey % 8
            WHEN 0 THEN 'Top ' || p_size || ' catégories par revenu'
            WHEN 1 THEN 'Quelle ville a le plus de ventes en ' || (1990 + p_size) || ' ?'
            WHEN 2 THEN 'أفضل ' || p_size || ' منتجات'
            WHEN 3 THEN 'Les ' || p_size || ' meilleurs clients'
            WHEN 4 THEN 'Payment methods by value for ' || p_name
            WHEN 5 THEN 'Show the review score of ' || p_name
            WHEN 6 THEN 'Meilleurs' || p_size || ' segments'
            ELSE 'Revenue per MONTH, rows ' || p_size END
        FROM part""",
}


def lists(n: int) -> str:
    """The n best products of each category."""
    return f"""
        SELECT category, product_id,
               CAST(row_number() OVER (PARTITION BY category ORDER BY popularity_rank) AS INTEGER) AS cat_rank
        FROM popular WHERE category IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY popularity_rank) <= {n}"""


def quantile(x: str, p: float) -> str:
    """Linear interpolation between neighbours over a group, NULLs left out."""
    values, at = f"list({x} ORDER BY {x}) FILTER ({x} IS NOT NULL)", f"((COUNT({x}) - 1) * {p}::DOUBLE)"
    lo = f"({values})[CAST(floor({at}) AS BIGINT) + 1]"
    hi = f"({values})[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({at} - floor({at})))"


def cents(x: str) -> str:
    return f"CAST(ROUND(SUM({x}), 2) AS DOUBLE)"


def up(x: str, digits: int = 2) -> str:
    """Half away from zero."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def even(x: str, digits: int = 2) -> str:
    """Half to even."""
    return f"CAST(round_even(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def mean(x: str) -> str:
    return f"CAST(SUM({x}) AS DOUBLE) / COUNT({x})"


def pct(part: str, whole: str) -> str:
    return up(f"100::DOUBLE * {part} / {whole}")


def _filled() -> dict[str, str]:
    ctes = dict(CTES)
    ctes["edges"] = ctes["edges"].format(
        **{f"{c}{int(p * 100)}": quantile(c, p) for c in "rm" for p in (0.25, 0.5, 0.75)}
    )
    measures = ("recency", "frequency", "monetary", "R_score", "F_score", "M_score")
    ctes["means"] = ctes["means"].format(**{f"e_{m}": even(mean(m)) for m in measures})
    return ctes


def _query(last: str, body: str, **changes: str) -> str:
    """`body` after every common table expression up to and including `last`."""
    ctes = _filled()
    ctes["lists"] = lists(20)
    ctes = {k: ctes[k] for k in list(CTES)[: list(CTES).index("favourites")]} | {
        "lists": ctes["lists"],
        **{k: ctes[k] for k in list(CTES)[list(CTES).index("favourites"):]},
    }
    ctes["recos"] = ctes["recos"].replace("{n}", "5")
    for name, text in changes.items():
        ctes[name] = text
    needed = list(ctes)[: list(ctes).index(last) + 1] if last else []
    heavy = {"fact", "rfm", "scores", "clustered", "segments", "popular", "favourites", "bought", "recos", "r_orders"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({ctes[n]})" for n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _histogram(source: str, x: str, bins: int) -> str:
    return f"""
        SELECT CAST(bin AS INTEGER) AS bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi,
               (SELECT COUNT(*) FROM {source}
                WHERE CAST(least(floor((CAST({x} AS DOUBLE) - s.lo) / s.w), {bins - 1}) AS BIGINT) = b.bin) AS n
        FROM (SELECT MIN(CAST({x} AS DOUBLE)) AS lo,
                     (MAX(CAST({x} AS DOUBLE)) - MIN(CAST({x} AS DOUBLE))) / {bins}::DOUBLE AS w FROM {source}) s,
             range({bins}) AS b(bin)"""


def _kde(source: str, x: str) -> str:
    """Every grid point against every value."""
    values = f"(SELECT CAST({x} AS DOUBLE) AS v, 1 AS c FROM {source})"
    return f"""
        SELECT CAST(point AS INTEGER) AS point, ROUND(x, 3) AS x,
               ROUND(SUM(c * exp(-0.5 * ((x - v) / h) ** 2)) / (MAX(n) * MAX(h) * sqrt(2 * pi())), 12) AS density
        FROM (SELECT point, lo + point * ((hi - lo) / 199) AS x, n, sd * n::DOUBLE ** (-0.2) AS h
              FROM (SELECT MIN(CAST({x} AS DOUBLE)) AS lo, MAX(CAST({x} AS DOUBLE)) AS hi, COUNT(*) AS n,
                           stddev_samp(CAST({x} AS DOUBLE)) AS sd FROM {source}), range(200) r(point)), {values}
        GROUP BY point, x"""


def _describe(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    return f"""
        SELECT '{x}' AS "column", COUNT({x}) AS count, {even(f'AVG({d})')} AS mean, {even(f'stddev_samp({d})')} AS std,
               {even(f'MIN({d})')} AS min, {even(quantile(d, 0.25))} AS p25, {even(quantile(d, 0.5))} AS p50,
               {even(quantile(d, 0.75))} AS p75, {even(f'MAX({d})')} AS max FROM rfm"""


def _hit_rate(leak_free: bool, n_users: int | None = None) -> str:
    sampled = "" if n_users is None else f""" AND customer_unique_id IN (
        SELECT customer_unique_id FROM (SELECT DISTINCT customer_unique_id FROM fact
                                        WHERE customer_unique_id IS NOT NULL AND product_id IS NOT NULL)
        ORDER BY substr(md5(customer_unique_id || '|42'), 1, 8), customer_unique_id LIMIT {n_users})"""
    held = f"""
        SELECT customer_unique_id, product_id, category FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY
                       substr(md5(customer_unique_id || '|' || product_id), 1, 8), product_id) AS i,
                   COUNT(*) OVER (PARTITION BY customer_unique_id) AS n
            FROM (SELECT customer_unique_id, product_id, MIN(product_category_name_english) AS category
                  FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1, 2))
        WHERE i = 1 AND n >= 2{sampled}"""
    changes = {
        "bought": f"""
            SELECT DISTINCT f.customer_unique_id, f.product_id FROM fact f
            JOIN ({held}) h ON f.customer_unique_id = h.customer_unique_id AND f.product_id <> h.product_id""",
        "recos": CTES["recos"].replace("{n}", "10"),
    }
    if leak_free:
        changes["favourites"] = f"""
            SELECT customer_unique_id, category,
                   row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, category) AS fav_rank
            FROM (SELECT f.customer_unique_id, f.product_category_name_english AS category, COUNT(*) AS n
                  FROM fact f JOIN ({held}) h
                    ON f.customer_unique_id = h.customer_unique_id AND f.product_id <> h.product_id
                  WHERE f.product_category_name_english IS NOT NULL GROUP BY 1, 2)"""
    return _query("recos", f"""
        SELECT CAST(SUM(hit) AS DOUBLE) / COUNT(*) AS hit_rate, COUNT(*) AS n_evaluated,
               100::DOUBLE / (SELECT COUNT(DISTINCT product_category_name_english) FROM fact) AS random_baseline
        FROM (SELECT h.customer_unique_id, MAX(CASE WHEN r.category = h.category THEN 1 ELSE 0 END) AS hit
              FROM ({held}) h LEFT JOIN recos r ON r.customer_unique_id = h.customer_unique_id
              GROUP BY h.customer_unique_id)""", **changes)


def all_sql() -> dict[str, str]:
    category = "product_category_name_english"
    fill = {"lists": lists(1), "recos": CTES["recos"].replace("{n}", "30")}
    sql: dict[str, str] = {}

    # cleaning and the star schema
    sql["clean_orders"] = """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS order_approved_at,
               CASE WHEN o_orderstatus = 'F' THEN date_trunc('day', o_orderdate) END AS order_delivered_carrier_date,
               CAST(NULL AS TIMESTAMP) AS order_delivered_customer_date,
               date_trunc('day', o_orderdate) AS order_estimated_delivery_date
        FROM orders"""
    sql["clean_products"] = _query("clean_products", "SELECT * FROM clean_products")
    sql["translate_categories"] = _query(
        "r_products", f"SELECT product_id, product_category_name, {category} FROM r_products")
    sql["date_features"] = """
        SELECT o_orderkey AS order_id, o_orderdate AS order_purchase_timestamp,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
               CAST(quarter(o_orderdate) AS INTEGER) AS quarter, strftime(o_orderdate, '%Y-%m') AS year_month,
               strftime(o_orderdate, '%A') AS day_of_week
        FROM orders"""
    sql["payment_rollup"] = _query("rollup", """
        SELECT order_id, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value
        FROM rollup""")
    sql["fact_sales"] = _query("fact", """
        SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
                          CAST(total_amount AS DOUBLE) AS total_amount, CAST(payment_value AS DOUBLE) AS payment_value)
        FROM fact""")
    sql["dim_customers"] = _query("r_customers", "SELECT DISTINCT * FROM r_customers")
    sql["dim_products"] = _query("r_products", f"""
        SELECT DISTINCT product_id, product_category_name, {category}, product_weight_g,
               product_length_cm, product_height_cm, product_width_cm FROM r_products""")
    sql["dim_sellers"] = _query("places", """
        SELECT DISTINCT s_suppkey AS seller_id, n_name AS seller_city, r_name AS seller_state
        FROM supplier LEFT JOIN places ON s_nationkey = n_nationkey""")
    sql["table_inventory"] = _query("fact", " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows FROM {source}" for name, source in {
            "fact_sales": "fact", "dim_customers": "(SELECT DISTINCT * FROM r_customers)",
            "dim_products": "(SELECT DISTINCT * FROM r_products)", "dim_sellers": "supplier",
            "orders": "r_orders", "reviews": "r_reviews", "payments": "r_payments",
            "geolocation": "places"}.items()))
    short = ", ".join(f"substr(id, 1, {n}) || '...' AS short_{n}" for n in (10, 15, 20, 30))
    sql["short_ids"] = _query("popular", f"""
        SELECT product_id, {short} FROM (SELECT product_id, CAST(product_id AS VARCHAR) AS id FROM popular)
        UNION ALL
        SELECT NULL, {short} FROM (SELECT customer_unique_id AS id FROM rfm)""")

    # business questions
    revenue = f"{cents('total_amount')} AS revenue"
    orders = "COUNT(DISTINCT order_id) AS orders"
    per_order = up("CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id)")
    sql["total_revenue"] = _query("fact", f"SELECT {cents('total_amount')} AS total_revenue FROM fact")
    sql["total_orders"] = _query("fact", "SELECT COUNT(DISTINCT order_id) AS total_orders FROM fact")
    sql["total_customers"] = _query(
        "fact", "SELECT COUNT(DISTINCT customer_unique_id) AS total_customers FROM fact")
    sql["avg_order_value"] = _query("fact", f"SELECT {per_order} AS avg_order_value FROM fact")
    sql["kpis"] = _query("fact", f"""
        SELECT {cents('total_amount')} AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
               COUNT(DISTINCT customer_unique_id) AS total_customers, {per_order} AS avg_order_value FROM fact""")
    sql["monthly_sales"] = _query("fact", f"SELECT year_month, {orders}, {revenue} FROM fact GROUP BY year_month")
    sql["monthly_sales_since"] = _query("fact", f"""
        SELECT year_month, {orders}, {revenue} FROM fact WHERE year_month >= '2000-01' GROUP BY year_month""")
    sql["top_products"] = _query("fact", f"""
        SELECT product_id, COUNT(*) AS times_sold, COUNT(DISTINCT order_id) AS unique_orders, {revenue}
        FROM fact GROUP BY product_id ORDER BY times_sold DESC, product_id LIMIT 10""")
    top_categories = f"""
        SELECT {category} AS category, {orders}, {revenue} FROM fact GROUP BY 1
        ORDER BY revenue DESC, category NULLS FIRST"""
    sql["top_categories"] = _query("fact", f"{top_categories} LIMIT 10")
    top_cities = f"""
        SELECT customer_city, customer_state, {orders}, {revenue} FROM fact GROUP BY 1, 2
        ORDER BY revenue DESC, customer_city NULLS FIRST, customer_state NULLS FIRST LIMIT 10"""
    sql["top_cities"] = _query("fact", top_cities)
    sql["top_cities_label"] = _query("fact", f"""
        SELECT customer_city || ' (' || customer_state || ')' AS city, orders, revenue FROM ({top_cities})""")
    sql["top_city_one"] = _query("fact", f"""
        SELECT customer_city, {revenue} FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 1""")
    sql["top_customers"] = _query("fact", f"""
        SELECT customer_unique_id, customer_city, customer_state, {orders},
               {cents('total_amount')} AS total_spent
        FROM fact GROUP BY 1, 2, 3 ORDER BY total_spent DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 10""")
    sql["rfm_sql"] = _query("fact", f"""
        SELECT customer_unique_id,
               CAST(floor((epoch_us((SELECT date_trunc('day', MAX(order_purchase_timestamp)) + INTERVAL 1 DAY FROM fact))
                           - epoch_us(MAX(order_purchase_timestamp))) / 86400000000) AS INTEGER) AS recency_days,
               COUNT(DISTINCT order_id) AS frequency, {cents('total_amount')} AS monetary
        FROM fact GROUP BY 1 ORDER BY monetary DESC, 1 NULLS FIRST LIMIT 20""")
    sql["payment_mix"] = _query("r_payments", f"""
        SELECT payment_type, COUNT(*) AS transactions, {cents('payment_value')} AS total_value
        FROM r_payments GROUP BY 1""")
    sql["installments"] = _query("r_payments", """
        SELECT payment_installments, COUNT(*) AS transactions FROM r_payments GROUP BY 1""")
    sql["review_distribution"] = _query("r_reviews", f"""
        SELECT review_score, COUNT(*) AS total, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct
        FROM r_reviews GROUP BY 1""")
    sql["order_status"] = _query("r_orders", f"""
        SELECT order_status, COUNT(*) AS total, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct
        FROM r_orders GROUP BY 1""")
    sql["review_by_category"] = _query("fact", f"""
        SELECT {category} AS category, {up(mean('review_score'))} AS avg_score, COUNT(*) AS num_reviews
        FROM fact JOIN r_reviews USING (order_id) GROUP BY 1 HAVING COUNT(*) >= 100
        ORDER BY avg_score DESC, category NULLS FIRST LIMIT 15""")
    sql["avg_delivery"] = _query("r_orders", f"""
        SELECT {up("AVG((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000)")}
               AS avg_delivery_days
        FROM r_orders WHERE order_delivered_customer_date IS NOT NULL""")
    sql["top_categories_param"] = _query("fact", f"""
        SELECT category, revenue FROM (
            SELECT {category} AS category, {revenue} FROM fact WHERE year_month >= '2000-01' GROUP BY 1)
        ORDER BY revenue DESC, category NULLS FIRST LIMIT 5""")

    # exploration
    sql["missing_values"] = _query("fact", """
        SELECT "column", n_missing FROM (
            UNPIVOT (SELECT COUNT(*) - COUNT(COLUMNS(*)) FROM fact) ON COLUMNS(*) INTO NAME "column" VALUE n_missing)
        WHERE n_missing > 0""")
    days = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    calendar = ", ".join(f"({i}, '{d}')" for i, d in enumerate(days))
    sql["orders_by_weekday"] = _query("fact", f"""
        SELECT position, d.day_of_week, COUNT(DISTINCT order_id) AS orders
        FROM (VALUES {calendar}) d(position, day_of_week) LEFT JOIN fact USING (day_of_week) GROUP BY 1, 2""")
    sql["delivery_stats"] = _query("delivery", f"""
        SELECT {mean('delivery_days')} AS mean, {quantile('delivery_days', 0.5)} AS median,
               MAX(delivery_days) AS max FROM delivery""")
    sql["histogram_delivery"] = _query("delivery", _histogram("delivery", "delivery_days", 50))
    sql["histogram_rfm"] = _query("rfm", " UNION ALL ".join(
        f"SELECT *, '{x}' AS measure FROM ({_histogram('rfm', x, 50)})"
        for x in ("recency", "frequency", "monetary")))
    sql["kde_delivery"] = _query("delivery", _kde("delivery", "delivery_days"))
    sql["kde_rfm"] = _query("rfm", " UNION ALL ".join(
        f"SELECT *, '{x}' AS measure FROM ({_kde('rfm', x)})" for x in ("recency", "frequency", "monetary")))
    months = ", ".join(
        f"CAST(ROUND(COALESCE(SUM(total_amount) FILTER (month = {m}), 0), 2) AS DOUBLE) AS m{m}" for m in range(1, 13))
    sql["category_month_matrix"] = _query("fact", f"""
        SELECT {category} AS category, {months} FROM fact WHERE {category} IS NOT NULL GROUP BY 1
        ORDER BY SUM(total_amount) DESC, 1 LIMIT 10""")
    sql["best_month"] = _query("fact", f"""
        SELECT year_month, {revenue} FROM fact WHERE year_month IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
    facts = {
        "Total Revenue": f"(SELECT format('{{:,.2f}}', {cents('total_amount')}) || ' BRL' FROM fact)",
        "Total Orders": "(SELECT format('{:,}', COUNT(DISTINCT order_id)) FROM fact)",
        "Total Customers": "(SELECT format('{:,}', COUNT(DISTINCT customer_unique_id)) FROM fact)",
        "Avg Order Value": f"(SELECT format('{{:.2f}}', {per_order}) || ' BRL' FROM fact)",
        "Top Category": f"(SELECT category FROM ({top_categories}) LIMIT 1)",
        "Top City": f"(SELECT customer_city || ' (' || customer_state || ')' FROM ({top_cities}) LIMIT 1)",
        "Best Month": f"""(SELECT year_month || ' (' || format('{{:,.2f}}', revenue) || ' BRL)' FROM (
            SELECT year_month, {revenue} FROM fact WHERE year_month >= '2000-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))""",
        "Avg Delivery": f"(SELECT format('{{:,.2f}}', {mean('delivery_days')}) || ' days' FROM delivery)",
        "5-star Reviews": f"""(SELECT format('{{:,.2f}}', {pct('COUNT(*) FILTER (review_score = 5)', 'COUNT(*)')}) || '%'
            FROM r_reviews)""",
        "Credit Card Share": f"""(SELECT format('{{:,.2f}}', {pct("COUNT(*) FILTER (payment_type = '1-URGENT')", 'COUNT(*)')})
            || '%' FROM r_payments)""",
    }
    sql["insights"] = _query("delivery", " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS insight, {value} AS value"
        for i, (name, value) in enumerate(facts.items(), 1)))
    sql["plot_sample"] = _query("rfm", """
        SELECT customer_unique_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM rfm
        ORDER BY substr(md5(customer_unique_id || '|42'), 1, 8), customer_unique_id LIMIT 10000""")
    sql["dq_report"] = _query("churn", """
        SELECT 'fact_not_empty' AS check, COUNT(*) > 0 AS ok, CAST(COUNT(*) AS VARCHAR) AS observed FROM fact
        UNION ALL SELECT 'revenue_positive', SUM(total_amount) > 0, CAST(ROUND(SUM(total_amount), 2) AS VARCHAR) FROM fact
        UNION ALL SELECT 'no_null_total', COUNT(*) = COUNT(total_amount),
                         CAST(COUNT(*) - COUNT(total_amount) AS VARCHAR) FROM fact
        UNION ALL SELECT 'enough_segments', COUNT(DISTINCT segment) >= 4, CAST(COUNT(DISTINCT segment) AS VARCHAR) FROM segments
        UNION ALL SELECT 'has_vip', COUNT(*) > 0, CAST(COUNT(*) AS VARCHAR) FROM segments WHERE segment = 'VIP'
        UNION ALL SELECT 'probability_in_range', COUNT(*) = 0, CAST(COUNT(*) AS VARCHAR) FROM churn
                  WHERE churn_probability NOT BETWEEN 0 AND 1""")

    # recency, frequency, monetary and segments
    sql["rfm"] = _query("rfm", "SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM rfm")
    sql["rfm_describe"] = _query(
        "rfm", " UNION ALL ".join(_describe(x) for x in ("recency", "frequency", "monetary")))
    sql["frequency_rank"] = _query("ranked", "SELECT customer_unique_id, frequency, frequency_rank FROM ranked")
    sql["rfm_scores"] = _query("scores", """
        SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary),
               CAST(R_score AS VARCHAR) || F_score || M_score AS RFM_score FROM scores""")
    sql["score_distribution"] = _query("scores", " UNION ALL ".join(
        f"SELECT '{s}' AS score_name, {s} AS score, COUNT(*) AS n FROM scores GROUP BY {s}"
        for s in ("R_score", "F_score", "M_score")))
    z = ", ".join(
        f"ROUND(({s} - (SELECT AVG({s}) FROM scores)) / (SELECT stddev_pop({s}) FROM scores), 9) AS z_{s}"
        for s in ("R_score", "F_score", "M_score"))
    sql["standardise_scores"] = _query(
        "scores", f"SELECT customer_unique_id, R_score, F_score, M_score, {z} FROM scores")
    sql["assign_to_centres"] = _query(
        "clustered", "SELECT customer_unique_id, R_score, F_score, M_score, cluster FROM clustered")
    sql["silhouette"] = _query("clustered", """
        , z AS MATERIALIZED (
            SELECT cluster, (R_score - (SELECT AVG(R_score) FROM scores)) / (SELECT stddev_pop(R_score) FROM scores) AS r,
                   (F_score - (SELECT AVG(F_score) FROM scores)) / (SELECT stddev_pop(F_score) FROM scores) AS f,
                   (M_score - (SELECT AVG(M_score) FROM scores)) / (SELECT stddev_pop(M_score) FROM scores) AS m
            FROM clustered),
        numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cluster, r, f, m) AS i FROM z),
        sums AS MATERIALIZED (
            SELECT a.i, a.cluster AS own, b.cluster AS other, COUNT(*) AS n,
                   SUM(sqrt((a.r - b.r) ** 2 + (a.f - b.f) ** 2 + (a.m - b.m) ** 2)) AS d
            FROM numbered a, numbered b WHERE a.i <> b.i GROUP BY 1, 2, 3),
        sides AS (
            SELECT i, MAX(CASE WHEN own = other THEN d / n END) AS a, MIN(CASE WHEN own <> other THEN d / n END) AS b
            FROM sums GROUP BY i)
        SELECT ROUND(AVG(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette
        FROM sides""")
    sql["segment_profile"] = _query("profile", "SELECT * FROM profile")
    sql["segment_table"] = _query("segments", """
        SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary),
               CAST(R_score AS VARCHAR) || F_score || M_score AS RFM_score FROM segments""")
    sql["segment_distribution"] = _query("segments", f"""
        SELECT segment, COUNT(*) AS n, {even('100::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM segments)')} AS pct
        FROM segments GROUP BY 1""")
    sql["segment_summary"] = _query("segments", f"""
        SELECT segment, COUNT(*) AS n_customers, {up(mean('recency'))} AS avg_recency,
               {up(mean('frequency'))} AS avg_frequency, {up(mean('monetary'))} AS avg_monetary
        FROM segments GROUP BY 1""")
    sql["segment_lookup"] = _query("segments", """
        SELECT customer_unique_id, segment, recency, frequency, CAST(monetary AS DOUBLE) AS monetary
        FROM segments WHERE customer_unique_id = 'Customer#000000007'""")
    sql["segment_box"] = _query("segments", f"""
        SELECT segment, q1, median, q3,
               (SELECT MIN(CAST(monetary AS DOUBLE)) FROM segments s WHERE s.segment = b.segment
                AND CAST(monetary AS DOUBLE) >= q1 - 1.5::DOUBLE * (q3 - q1)) AS lo_whisker,
               (SELECT MAX(CAST(monetary AS DOUBLE)) FROM segments s WHERE s.segment = b.segment
                AND CAST(monetary AS DOUBLE) <= q3 + 1.5::DOUBLE * (q3 - q1)) AS hi_whisker
        FROM (SELECT segment, {quantile('m', 0.25)} AS q1, {quantile('m', 0.5)} AS median, {quantile('m', 0.75)} AS q3
              FROM (SELECT segment, CAST(monetary AS DOUBLE) AS m FROM segments) GROUP BY segment) b""")

    # churn
    sql["customer_reviews"] = _query("cust_reviews", "SELECT * FROM cust_reviews")
    sql["churn_features"] = _query("cust_reviews", f"""
        , per AS (
            SELECT customer_unique_id, MIN(order_purchase_timestamp) AS first_purchase,
                   MAX(order_purchase_timestamp) AS last_purchase, COUNT(DISTINCT order_id) AS frequency,
                   CAST(SUM(total_amount) AS DOUBLE) AS monetary, {mean('total_amount')} AS avg_order_value,
                   CAST(SUM(freight_value) AS DOUBLE) AS total_freight, COUNT(order_item_id) AS n_items,
                   COUNT(DISTINCT product_id) AS n_products, COUNT(DISTINCT {category}) AS n_categories,
                   COUNT(DISTINCT seller_id) AS n_sellers, COUNT(DISTINCT payment_type) AS n_payment_methods,
                   {mean('payment_installments')} AS avg_installments
            FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
        days AS (
            SELECT *, CAST(floor((epoch_us((SELECT day FROM snap)) - epoch_us(last_purchase)) / 86400000000) AS INTEGER)
                      AS recency,
                   CAST(floor((epoch_us(last_purchase) - epoch_us(first_purchase)) / 86400000000) AS INTEGER)
                      AS lifetime_days FROM per)
        SELECT d.*, CAST(frequency AS DOUBLE) / (lifetime_days + 1) AS purchase_frequency,
               monetary / frequency AS monetary_per_order,
               COALESCE(avg_review_score, (SELECT {quantile('avg_review_score', 0.5)} FROM cust_reviews)) AS avg_review_score,
               n_reviews
        FROM days d JOIN cust_reviews USING (customer_unique_id)""")
    sql["churn_rate"] = _query("churn", f"""
        SELECT COUNT(*) AS customers, CAST(SUM(churn) AS BIGINT) AS churned,
               {pct('SUM(churn)', 'COUNT(*)')} AS churn_rate FROM churn""")
    sql["impute_median"] = _query("rfm", f"""
        , gappy AS (
            SELECT customer_unique_id, recency,
                   CASE WHEN recency % 7 <> 0 THEN CAST(monetary AS DOUBLE) / recency END AS per_day,
                   CASE WHEN frequency % 5 <> 0 THEN CAST(monetary AS DOUBLE) END AS spend FROM rfm)
        SELECT customer_unique_id, recency,
               COALESCE(per_day, (SELECT {quantile('per_day', 0.5)} FROM gappy)) AS per_day,
               COALESCE(spend, (SELECT {quantile('spend', 0.5)} FROM gappy)) AS spend
        FROM gappy""")
    draw = "('0x' || substr(md5(customer_unique_id || '|42'), 1, 8))::BIGINT"
    sql["stratified_split"] = _query("churn", f"""
        SELECT customer_unique_id, churn, {draw} < CAST(floor(0.2 * 4294967296) AS BIGINT) AS is_test FROM churn""")
    sql["stratified_split_exact"] = _query("churn", f"""
        SELECT customer_unique_id, churn,
               row_number() OVER (PARTITION BY churn ORDER BY {draw}, customer_unique_id)
               <= ROUND(COUNT(*) OVER (PARTITION BY churn) * 0.2) AS is_test FROM churn""")
    sql["class_weights"] = _query("churn", """
        SELECT customer_unique_id, churn, (SELECT COUNT(*) FROM churn)::DOUBLE
               / ((SELECT COUNT(DISTINCT churn) FROM churn) * COUNT(*) OVER (PARTITION BY churn)) AS weight FROM churn""")
    sql["tracked_features"] = _query("segments", f"""
        SELECT customer_unique_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, R_score, F_score, M_score,
               CASE WHEN monetary > 0 THEN {up('CAST(monetary AS DOUBLE) / (frequency + 1)')} ELSE 0 END AS avg_order_value,
               CASE WHEN frequency > 0 THEN {up('CAST(monetary AS DOUBLE) / frequency')} ELSE 0 END AS monetary_per_order,
               CASE WHEN recency > 180 THEN 1 ELSE 0 END AS churn FROM segments""")
    sql["confusion"] = _query("scored", """
        SELECT l.v AS label, p.v AS prediction,
               (SELECT COUNT(*) FROM scored s WHERE s.label = l.v AND s.prediction = p.v) AS n
        FROM (VALUES (0), (1)) l(v), (VALUES (0), (1)) p(v)""")
    sql["classification_metrics"] = _query("scored", """
        SELECT CAST(n00 + n11 AS DOUBLE) / (n00 + n01 + n10 + n11) AS accuracy,
               CASE WHEN n11 + n01 = 0 THEN 0 ELSE CAST(n11 AS DOUBLE) / (n11 + n01) END AS precision,
               CASE WHEN n11 + n10 = 0 THEN 0 ELSE CAST(n11 AS DOUBLE) / (n11 + n10) END AS recall,
               CASE WHEN 2 * n11 + n01 + n10 = 0 THEN 0 ELSE CAST(2 * n11 AS DOUBLE) / (2 * n11 + n01 + n10) END AS f1
        FROM (SELECT COUNT(*) FILTER (label = 0 AND prediction = 0) AS n00, COUNT(*) FILTER (label = 0 AND prediction = 1) AS n01,
                     COUNT(*) FILTER (label = 1 AND prediction = 0) AS n10, COUNT(*) FILTER (label = 1 AND prediction = 1) AS n11
              FROM scored)""")
    sql["roc_auc"] = _query("scored", """
        SELECT CAST(SUM(CASE WHEN p.score > n.score THEN 2 WHEN p.score = n.score THEN 1 ELSE 0 END) AS DOUBLE)
               / (2 * COUNT(*)) AS roc_auc
        FROM scored p JOIN scored n ON p.label = 1 AND n.label = 0""")
    sql["roc_curve"] = _query("scored", """
        SELECT 'inf'::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
        UNION ALL
        SELECT t.score, CAST(COUNT(*) FILTER (s.label = 0 AND s.score >= t.score) AS DOUBLE) / COUNT(*) FILTER (s.label = 0),
               CAST(COUNT(*) FILTER (s.label = 1 AND s.score >= t.score) AS DOUBLE) / COUNT(*) FILTER (s.label = 1)
        FROM (SELECT DISTINCT score FROM scored) t, scored s GROUP BY t.score""")
    sql["score_density"] = _query("scored", " UNION ALL ".join(f"""
        SELECT {label} AS label, *, n / ((SELECT COUNT(*) FROM scored WHERE label = {label}) *
               (SELECT (MAX(score) - MIN(score)) / 30::DOUBLE FROM scored WHERE label = {label})) AS density
        FROM ({_histogram(f'(SELECT score FROM scored WHERE label = {label})', 'score', 30)})""" for label in (0, 1)))
    sql["churn_bands"] = _query("churn", """
        SELECT customer_unique_id, churn_probability,
               CASE WHEN churn_probability > 0.7::DOUBLE THEN 'high'
                    WHEN churn_probability > 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM churn""")
    sql["churn_summary"] = _query("churn", f"""
        SELECT COUNT(*) AS total, CAST(SUM(churn) AS BIGINT) AS churned, {up('AVG(churn_probability)', 4)} AS avg_prob,
               {pct('SUM(churn)', 'COUNT(*)')} AS actual_rate, {pct('SUM(churn_prediction)', 'COUNT(*)')} AS predicted_rate
        FROM churn""")
    sql["churn_lookup"] = _query("churn", """
        SELECT customer_unique_id, recency, frequency, monetary, churn_probability, churn_prediction
        FROM churn WHERE customer_unique_id = 'Customer#000000007'""")
    sql["top_risk"] = _query("churn", """
        SELECT customer_unique_id, recency, frequency, monetary, churn_probability FROM churn
        WHERE churn_prediction = 1 ORDER BY churn_probability DESC, customer_unique_id LIMIT 20""")

    # recommendation
    sql["popular_products"] = _query("popular", "SELECT product_id, n_purchases, n_customers, category FROM popular")
    sql["popularity_rank"] = _query("popular", "SELECT product_id, popularity_rank FROM popular")
    sql["popular_products_top"] = _query("popular", """
        SELECT product_id, category, n_purchases, n_customers FROM popular ORDER BY popularity_rank LIMIT 20""")
    sql["category_stats"] = _query("fact", f"""
        SELECT {category} AS category, COUNT(order_id) AS n_purchases, COUNT(DISTINCT customer_unique_id) AS n_customers
        FROM fact WHERE {category} IS NOT NULL GROUP BY 1""")
    sql["customer_history"] = _query("fact", f"""
        SELECT customer_unique_id, COUNT(DISTINCT order_id) AS n_orders, COUNT(DISTINCT product_id) AS n_products,
               COUNT(DISTINCT {category}) AS n_categories
        FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1""")
    sql["favourite_categories"] = _query("favourites", "SELECT * FROM favourites")
    sql["top_per_category"] = _query("lists", "SELECT * FROM lists")
    reco = "SELECT customer_unique_id, product_id, rank, 10::DOUBLE - rank AS score FROM recos"
    sql["recommendations"] = _query("recos", reco)
    sql["recommendations_fill"] = _query("recos", reco, **fill)
    sql["reco_category_mix"] = _query("recos", """
        SELECT category, COUNT(*) AS n FROM recos WHERE category IS NOT NULL GROUP BY 1
        ORDER BY n DESC, category LIMIT 15""")
    sql["hit_rate"] = _hit_rate(False)
    sql["hit_rate_leak_free"] = _hit_rate(True)
    sql["hit_rate_500"] = _hit_rate(False, 500)
    sql["reco_lookup"] = _query("recos", """
        SELECT customer_unique_id, FALSE AS fallback, rank, product_id, 10::DOUBLE - rank AS score,
               CAST(NULL AS VARCHAR) AS category
        FROM recos WHERE customer_unique_id IN (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)
        UNION ALL
        SELECT id, TRUE, CAST(popularity_rank AS INTEGER), product_id, NULL, category
        FROM (SELECT c_name AS id FROM customer UNION SELECT s_name FROM supplier), popular
        WHERE popularity_rank <= 10 AND id NOT IN (SELECT customer_unique_id FROM recos)""")

    # what must hold of fitted models, and what is stored and read back
    names = "('LogisticRegression'), ('RandomForest'), ('GradientBoosting')"
    sql["customer_churn_check"] = _query("rfm", """
        SELECT customer_unique_id, CAST(recency AS BIGINT) AS recency, frequency, lifetime_days,
               CAST(CASE WHEN recency > 180 THEN 1 ELSE 0 END AS BIGINT) AS churn,
               CAST(monetary AS DOUBLE) AS monetary, TRUE AS probability_in_range, TRUE AS prediction_fits
        FROM rfm JOIN (SELECT customer_unique_id, CAST(floor((epoch_us(MAX(order_purchase_timestamp))
                              - epoch_us(MIN(order_purchase_timestamp))) / 86400000000) AS BIGINT) AS lifetime_days
                       FROM fact GROUP BY 1) USING (customer_unique_id)""")
    sql["tested_models_check"] = _query("churn", f"""
        SELECT model, COUNT(*) AS n_test, CAST(SUM(churn) AS BIGINT) AS n_positive, TRUE AS cells_add_up
        FROM churn, (VALUES {names}) m(model)
        WHERE {draw} < CAST(floor(0.2 * 4294967296) AS BIGINT) GROUP BY model""")
    valued = f""" (
            SELECT place, feature, 0.5::DOUBLE - churn AS g, value FROM (
                SELECT CAST(recency > 180 AS INTEGER) AS churn, unnest([0, 1, 2, 3, 4]) AS place,
                       unnest(['frequency', 'lifetime_days', 'n_items', 'n_products', 'n_sellers']) AS feature,
                       unnest([CAST(frequency AS DOUBLE), CAST(lifetime_days AS DOUBLE), CAST(n_items AS DOUBLE),
                               CAST(n_products AS DOUBLE), CAST(n_sellers AS DOUBLE)]) AS value
                FROM ({sql["churn_features"]}))) """
    sql["boosted_first_cut"] = f"""
        SELECT n.node,
               CASE n.node WHEN 0 THEN b.feature END AS feature, CASE n.node WHEN 0 THEN b.cut END AS cut,
               CASE n.node WHEN 0 THEN round(b.gain, 6) END AS gain,
               CASE n.node WHEN 1 THEN round(-0.1 * b.g1 / (b.h1 + 1), 9)
                           WHEN 2 THEN round(-0.1 * b.g2 / (b.h2 + 1), 9) END AS leaf
        FROM (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS node) n, (
            SELECT *, g1 * g1 / (h1 + 1) + g2 * g2 / (h2 + 1) - (g1 + g2) * (g1 + g2) / (h1 + h2 + 1) AS gain
            FROM (
                SELECT e.place, e.feature, e.cut,
                       SUM(l.g) FILTER (l.value <= e.cut) AS g1, SUM(0.25::DOUBLE) FILTER (l.value <= e.cut) AS h1,
                       SUM(l.g) FILTER (l.value > e.cut) AS g2, SUM(0.25::DOUBLE) FILTER (l.value > e.cut) AS h2
                FROM (SELECT DISTINCT place, feature, unnest(cuts) AS cut FROM (
                          SELECT place, feature, quantile_cont(value, {[i / 16 for i in range(1, 16)]}) AS cuts
                          FROM {valued} GROUP BY place, feature)) e
                JOIN {valued} l ON l.place = e.place GROUP BY ALL
            ) WHERE h1 >= 1 AND h2 >= 1 ORDER BY gain DESC, place, cut LIMIT 1) b"""
    sql["churn_lr_check"] = _query("churn", f"""
        SELECT COUNT(*) AS n_train, CAST(SUM(churn) AS BIGINT) AS n_positive, 15 AS n_coefficients,
               TRUE AS gradient_is_zero
        FROM churn WHERE {draw} >= CAST(floor(0.2 * 4294967296) AS BIGINT)""")
    sql["model_comparison_check"] = """
        SELECT 'GradientBoosting,LogisticRegression,RandomForest' AS models, CAST(1 AS BIGINT) AS n_best,
               TRUE AS best_is_highest, TRUE AS all_above_half"""
    sql["feature_importance_check"] = """
        SELECT feature, TRUE AS not_negative, TRUE AS sums_to_one FROM (SELECT unnest([
            'frequency', 'monetary', 'lifetime_days', 'avg_order_value', 'total_freight', 'n_items', 'n_products',
            'n_categories', 'n_sellers', 'n_payment_methods', 'avg_installments', 'avg_review_score', 'n_reviews',
            'purchase_frequency', 'monetary_per_order']) AS feature)"""
    sql["kmeans_segments_check"] = _query("scores", """
        SELECT COUNT(*) AS n_customers, CAST(5 AS BIGINT) AS n_clusters, TRUE AS all_nearest, TRUE AS not_above_fixed
        FROM scores""")
    sql["best_k_check"] = """
        SELECT CAST(k AS INTEGER) AS k, TRUE AS not_rising, TRUE AS agrees_with_elbow, TRUE AS in_range,
               TRUE AS best_is_highest FROM range(2, 11) r(k)"""
    sql["run_log_check"] = """
        SELECT run_name, params, 'accuracy,f1,precision,recall,roc_auc' AS metrics, TRUE AS in_range FROM (VALUES
            ('LogisticRegression', 'C,max_iter,model_path,model_type,n_features,needs_scaling,test_size'),
            ('RandomForest', 'max_depth,model_path,model_type,n_estimators,n_features,needs_scaling,test_size'),
            ('GradientBoosting', 'max_depth,model_path,model_type,n_estimators,n_features,needs_scaling,test_size'))
        t(run_name, params)"""
    sql["best_run"] = "SELECT TRUE AS named, TRUE AS is_highest, TRUE AS has_model"
    sql["table_preview_check"] = _query("fact", """
        SELECT least(100, COUNT(*)) AS n_rows, TRUE AS all_known FROM fact""")
    sql["csv_roundtrip"] = _query("r_translation", " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT COUNT(*) FROM {source}) AS n_rows, TRUE AS same"
        for name, source in (
            ("customers", "r_customers"), ("orders", "r_orders"), ("order_items", "r_items"),
            ("payments", "r_payments"), ("reviews", "r_reviews"), ("products", "part"),
            ("sellers", "supplier"), ("geolocation", "places"), ("category_translation", "r_translation"))))
    sql["save_load"] = sql["table_inventory"].replace("AS n_rows", "AS n_rows, TRUE AS same")
    sql["build_warehouse"] = sql["table_inventory"]
    for name, parts in {
        "derived_tables": {"customer_segments": "segment_table", "segment_profile": "segment_profile",
                           "recommendations": "recommendations", "popular_products": "popular_products",
                           "category_stats": "category_stats"},
        "recommendation_artifacts": {"customer_categories": "favourite_categories",
                                     "top_per_category": "top_per_category", "popular_products": "popular_products"},
    }.items():
        sql[name] = " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, COUNT(*) AS n_rows, TRUE AS same FROM ({sql[of]})"
            for table, of in parts.items())
    sql["recommendation_artifacts"] += " UNION ALL SELECT * FROM (" + _query(
        "bought", "SELECT 'customer_products' AS table_name, COUNT(*) AS n_rows, TRUE AS same FROM bought") + ")"
    sql["expected_tables"] = """
        SELECT 'table_' || name AS check, TRUE AS ok, 'present' AS observed FROM (VALUES
            ('fact_sales'), ('dim_customers'), ('dim_products'), ('dim_sellers'), ('orders'), ('reviews'), ('payments'),
            ('customer_segments'), ('customer_churn'), ('popular_products'), ('recommendations')) t(name)"""
    sql["required_columns"] = _query("fact", " UNION ALL ".join(
        f"SELECT 'column_{c}' AS check, TRUE AS ok, CAST(COUNT({c}) AS VARCHAR) AS observed FROM fact"
        for c in ("order_id", "customer_unique_id", "product_id", "total_amount", "order_purchase_timestamp")))
    sql["served_shapes"] = _query("segments", """
        SELECT shape, TRUE AS ok FROM (VALUES ('top_categories_limit'), ('top_cities_limit'),
            ('unknown_segment'), ('top_risk_limit'), ('unknown_gets_fallback'), ('popular_limit')) t(shape)
        UNION ALL
        SELECT 'five_segments', COUNT(DISTINCT segment) = 5 AND bool_or(segment = 'VIP') AND bool_or(segment = 'Loyal')
        FROM segments""")
    sql["review_by_category_bound"] = sql["review_by_category"].replace("COUNT(*) >= 100", "COUNT(*) >= 1600")
    sql["model_reload"] = _query("rfm", "SELECT COUNT(*) AS n_customers, TRUE AS same FROM rfm")
    sql["plot_sample_500"] = sql["plot_sample"].replace("LIMIT 10000", "LIMIT 500")
    money = {"total_revenue", "avg_order_value", "revenue", "monetary", "total_spent", "total_value", "pct", "avg_score",
             "avg_delivery_days"}
    columns = {
        "total_revenue": "total_revenue", "total_orders": "total_orders", "total_customers": "total_customers",
        "avg_order_value": "avg_order_value", "monthly_sales": "year_month orders revenue",
        "top_products": "product_id times_sold unique_orders revenue", "top_categories": "category orders revenue",
        "top_cities": "customer_city customer_state orders revenue",
        "rfm_sql": "customer_unique_id recency_days frequency monetary",
        "top_customers": "customer_unique_id customer_city customer_state orders total_spent",
        "payment_mix": "payment_type transactions total_value", "installments": "payment_installments transactions",
        "review_distribution": "review_score total pct", "review_by_category": "category avg_score num_reviews",
        "avg_delivery": "avg_delivery_days", "order_status": "order_status total pct",
    }

    def cell(name: str) -> str:
        return f"coalesce(CAST({f'CAST({name} AS DECIMAL(20,2))' if name in money else name} AS VARCHAR), 'NULL')"

    sql["question_pack"] = " UNION ALL ".join([
        *(f"""SELECT '{name}' AS question, COUNT(*) AS n_rows, TRUE AS ran,
                     md5(coalesce(string_agg(line, chr(10) ORDER BY line), '')) AS digest
              FROM (SELECT {" || '|' || ".join(map(cell, names.split()))} AS line FROM ({sql[name]}))"""
          for name, names in columns.items()),
        "SELECT 'broken', CAST(0 AS BIGINT), FALSE, CAST(NULL AS VARCHAR)"])
    gappy = """
        SELECT * REPLACE (CASE WHEN n % 11 <> 0 THEN total_amount END AS total_amount,
                          CASE WHEN n % 13 <> 0 THEN order_purchase_timestamp END AS order_purchase_timestamp)
        FROM (SELECT *, CAST(substr(customer_unique_id, 10, 20) AS BIGINT) AS n FROM fact)"""
    sql["rfm_scores_gaps"] = _query("fact", f"""
        , gappy AS MATERIALIZED ({gappy}),
        g AS MATERIALIZED (
            SELECT customer_unique_id, COUNT(DISTINCT order_id) AS frequency,
                   COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS monetary,
                   CAST(floor((epoch_us((SELECT MAX(order_purchase_timestamp) + INTERVAL 1 DAY FROM gappy))
                               - epoch_us(MAX(order_purchase_timestamp))) / 86400000000) AS INTEGER) AS recency
            FROM gappy WHERE customer_unique_id IS NOT NULL GROUP BY 1),
        q AS (SELECT {", ".join(f"{quantile(c, p)} AS {c}{i}" for c in ("recency", "monetary")
                                for i, p in enumerate((0.25, 0.5, 0.75)))}, COUNT(*) AS n FROM g),
        s AS (SELECT customer_unique_id, recency, frequency, monetary,
                     CASE WHEN recency IS NULL THEN NULL
                          ELSE 4 - (CAST(recency > recency0 AS INTEGER) + CAST(recency > recency1 AS INTEGER)
                                    + CAST(recency > recency2 AS INTEGER)) END AS R_score,
                     CAST(1 + (place > 1 + (n - 1) * 0.25)::INTEGER + (place > 1 + (n - 1) * 0.5)::INTEGER
                          + (place > 1 + (n - 1) * 0.75)::INTEGER AS INTEGER) AS F_score,
                     1 + CAST(monetary > monetary0 AS INTEGER) + CAST(monetary > monetary1 AS INTEGER)
                       + CAST(monetary > monetary2 AS INTEGER) AS M_score
              FROM (SELECT *, row_number() OVER (ORDER BY frequency, customer_unique_id) AS place FROM g), q)
        SELECT *, CAST(R_score AS VARCHAR) || F_score || M_score AS RFM_score FROM s""")

    # questions
    topics = {name: "|".join(words) for name, words in TOPICS.items()}
    cases = " ".join(f"WHEN regexp_matches(lower(question), '{words}') THEN '{t}'" for t, words in topics.items())
    sql["question_topics"] = _query("asked", f"SELECT *, CASE {cases} ELSE 'other' END AS topic FROM asked",
                                    ).replace("{n}", "5")
    edge = r"(?:^|[^\p{L}\p{N}_])"
    ranked = rf"regexp_extract(lower(question), '{edge}(?:top|meilleurs?|premiers?|أفضل)\s*(\d+)', 1)"
    plain = rf"TRY_CAST(regexp_extract(lower(question), '{edge}(\d+)(?:$|[^\p{{L}}\p{{N}}_])', 1) AS BIGINT)"
    sql["question_top_n"] = _query("asked", f"""
        SELECT *, NULLIF(CASE WHEN {ranked} <> '' THEN TRY_CAST({ranked} AS BIGINT)
                              WHEN {plain} BETWEEN 1 AND 100 THEN {plain} END, 0) AS requested_n FROM asked""")
    heads = " ".join(f"WHEN topic = '{t}' THEN '{h}'" for t, h in HEADINGS.items())
    asked_n = "COALESCE(requested_n, n)"
    sql["answer_table"] = f"""
        WITH topic AS MATERIALIZED ({sql["question_topics"]}), top AS MATERIALIZED ({sql["question_top_n"]}),
        q AS (SELECT question_id, topic, requested_n FROM topic JOIN top USING (question_id)),
        best AS MATERIALIZED ({sql["top_categories"]}),
        shown AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY revenue DESC, category NULLS FIRST) AS i, COUNT(*) OVER () AS n,
                   {{line}} AS line FROM best)
        SELECT question_id, 0 AS position, CASE {heads} ELSE 'Result' END AS line FROM q
        UNION ALL
        SELECT question_id, CAST(i AS INTEGER), i || '. ' || line FROM q, shown WHERE i <= {asked_n}
        UNION ALL
        SELECT question_id, CAST(requested_n + 1 AS INTEGER), '... and ' || (n - requested_n) || ' more rows'
        FROM q, (SELECT MAX(n) AS n FROM shown) WHERE n > requested_n""" .replace("{line}", """concat_ws(' — ',
                       '**' || category || '**', '**' || replace(format('{:,}', orders), ',', ' ') || '**',
                       '**' || replace(format('{:,.2f}', revenue), ',', ' ') || ' BRL**')""")
    sql["format_results"] = _query("fact", f"""
        SELECT year_month, replace(format('{{:,}}', orders), ',', ' ') AS orders,
               replace(format('{{:,.2f}}', revenue), ',', ' ') || ' BRL' AS revenue
        FROM (SELECT year_month, {orders}, {revenue} FROM fact GROUP BY year_month)""")
    return sql
