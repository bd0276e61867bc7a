"""Explicit types of the nine raw tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(17, 4)  # exact, and a sum of two still fits one machine word


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_text, _int, _real = T.StringType(), T.IntegerType(), T.DoubleType()

RAW = {
    "customers": _table(
        ("customer_id", _text),
        ("customer_unique_id", _text),
        ("customer_zip_code_prefix", _text),
        ("customer_city", _text),
        ("customer_state", _text),
    ),
    "orders": _table(
        ("order_id", _text),
        ("customer_id", _text),
        ("order_status", _text),
        ("order_purchase_timestamp", _text),
        ("order_approved_at", _text),
        ("order_delivered_carrier_date", _text),
        ("order_delivered_customer_date", _text),
        ("order_estimated_delivery_date", _text),
    ),
    "order_items": _table(
        ("order_id", _text),
        ("order_item_id", _int),
        ("product_id", _text),
        ("seller_id", _text),
        ("shipping_limit_date", _text),
        ("price", AMOUNT),
        ("freight_value", AMOUNT),
    ),
    "payments": _table(
        ("order_id", _text),
        ("payment_sequential", _int),
        ("payment_type", _text),
        ("payment_installments", _int),
        ("payment_value", AMOUNT),
    ),
    "reviews": _table(
        ("review_id", _text),
        ("order_id", _text),
        ("review_score", _int),
        ("review_comment_title", _text),
        ("review_comment_message", _text),
        ("review_creation_date", _text),
        ("review_answer_timestamp", _text),
    ),
    "products": _table(
        ("product_id", _text),
        ("product_category_name", _text),
        ("product_name_lenght", _int),
        ("product_description_lenght", _int),
        ("product_photos_qty", _int),
        ("product_weight_g", _real),
        ("product_length_cm", _real),
        ("product_height_cm", _real),
        ("product_width_cm", _real),
    ),
    "sellers": _table(
        ("seller_id", _text),
        ("seller_zip_code_prefix", _text),
        ("seller_city", _text),
        ("seller_state", _text),
    ),
    "geolocation": _table(
        ("geolocation_zip_code_prefix", _text),
        ("geolocation_lat", _real),
        ("geolocation_lng", _real),
        ("geolocation_city", _text),
        ("geolocation_state", _text),
    ),
    "category_translation": _table(
        ("product_category_name", _text),
        ("product_category_name_english", _text),
    ),
}
