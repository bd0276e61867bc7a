from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storelens.session import close, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    close(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not present")
    return SF


@pytest.fixture(scope="session")
def mart(spark, sf):
    import __spark_entry__ as entry

    return entry.mart(spark, sf)


FACT = (
    "order_id string, order_item_id int, product_id string, seller_id string, "
    "customer_unique_id string, customer_city string, customer_state string, "
    "product_category_name_english string, price decimal(17,4), freight_value decimal(17,4), "
    "total_amount decimal(18,4), order_purchase_timestamp timestamp_ntz, year_month string, "
    "month int, day_of_week string, payment_type string, payment_installments int"
)


@pytest.fixture(scope="session")
def make_fact(spark):
    """Builds a fact table from dicts; what a row leaves out is NULL."""
    import datetime as dt
    from decimal import Decimal

    from pyspark.sql import types as T

    schema = T._parse_datatype_string(FACT)

    def value(field, row):
        v = row.get(field.name)
        if v is None:
            return None
        if isinstance(field.dataType, T.DecimalType):
            return Decimal(str(v))
        if isinstance(field.dataType, T.TimestampNTZType) and isinstance(v, str):
            return dt.datetime.fromisoformat(v)
        return v

    def build(rows: list[dict]):
        return spark.createDataFrame([tuple(value(f, r) for f in schema) for r in rows], schema)

    return build
