"""The sixteen standing business questions as a pack of SQL over the stored tables."""

from __future__ import annotations

_SALES, _ORDERS, _PAYMENTS, _REVIEWS = (
    f"storelens_{t}" for t in ("fact_sales", "orders", "payments", "reviews"))

PACK = {
    "total_revenue": f"SELECT round(sum(total_amount), 2) AS total_revenue FROM {_SALES}",
    "total_orders": f"SELECT count(DISTINCT order_id) AS total_orders FROM {_SALES}",
    "total_customers": f"SELECT count(DISTINCT customer_unique_id) AS total_customers FROM {_SALES}",
    "avg_order_value": f"""
        SELECT round(sum(total_amount) / count(DISTINCT order_id), 2) AS avg_order_value FROM {_SALES}""",
    "monthly_sales": f"""
        SELECT year_month, count(DISTINCT order_id) AS orders, round(sum(total_amount), 2) AS revenue
        FROM {_SALES} GROUP BY year_month ORDER BY year_month""",
    "top_products": f"""
        SELECT product_id, count(*) AS times_sold, count(DISTINCT order_id) AS unique_orders,
               round(sum(total_amount), 2) AS revenue
        FROM {_SALES} GROUP BY product_id ORDER BY times_sold DESC, product_id LIMIT 10""",
    "top_categories": f"""
        SELECT product_category_name_english AS category, count(DISTINCT order_id) AS orders,
               round(sum(total_amount), 2) AS revenue
        FROM {_SALES} GROUP BY category ORDER BY revenue DESC, category LIMIT 10""",
    "top_cities": f"""
        SELECT customer_city, customer_state, count(DISTINCT order_id) AS orders,
               round(sum(total_amount), 2) AS revenue
        FROM {_SALES} GROUP BY customer_city, customer_state
        ORDER BY revenue DESC, customer_city, customer_state LIMIT 10""",
    "rfm_sql": f"""
        SELECT customer_unique_id,
               CAST(timestampdiff(DAY, max(order_purchase_timestamp), (
                   SELECT date_trunc('DAY', max(order_purchase_timestamp)) + INTERVAL 1 DAY FROM {_SALES})) AS INT)
               AS recency_days,
               count(DISTINCT order_id) AS frequency, round(sum(total_amount), 2) AS monetary
        FROM {_SALES} GROUP BY customer_unique_id ORDER BY monetary DESC, customer_unique_id LIMIT 20""",
    "top_customers": f"""
        SELECT customer_unique_id, customer_city, customer_state, count(DISTINCT order_id) AS orders,
               round(sum(total_amount), 2) AS total_spent
        FROM {_SALES} GROUP BY customer_unique_id, customer_city, customer_state
        ORDER BY total_spent DESC, customer_unique_id, customer_city, customer_state LIMIT 10""",
    "payment_mix": f"""
        SELECT payment_type, count(*) AS transactions, round(sum(payment_value), 2) AS total_value
        FROM {_PAYMENTS} GROUP BY payment_type ORDER BY total_value DESC""",
    "installments": f"""
        SELECT payment_installments, count(*) AS transactions FROM {_PAYMENTS}
        GROUP BY payment_installments ORDER BY payment_installments""",
    "review_distribution": f"""
        SELECT review_score, count(*) AS total,
               round(100.0 * count(*) / (SELECT count(*) FROM {_REVIEWS}), 2) AS pct
        FROM {_REVIEWS} GROUP BY review_score ORDER BY review_score""",
    "review_by_category": f"""
        SELECT f.product_category_name_english AS category, round(avg(r.review_score), 2) AS avg_score,
               count(*) AS num_reviews
        FROM {_SALES} f JOIN {_REVIEWS} r ON f.order_id = r.order_id
        GROUP BY category HAVING count(*) >= 100 ORDER BY avg_score DESC, category LIMIT 15""",
    "avg_delivery": f"""
        SELECT round(avg(timestampdiff(MICROSECOND, order_purchase_timestamp, order_delivered_customer_date)
                         / 86400000000D), 2) AS avg_delivery_days
        FROM {_ORDERS} WHERE order_delivered_customer_date IS NOT NULL""",
    "order_status": f"""
        SELECT order_status, count(*) AS total,
               round(100.0 * count(*) / (SELECT count(*) FROM {_ORDERS}), 2) AS pct
        FROM {_ORDERS} GROUP BY order_status ORDER BY total DESC""",
}
