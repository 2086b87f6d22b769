"""Fixed schemas of the data model (explicit StructTypes, never inferred)."""

from pyspark.sql import types as T

# retail_sales data contract; key (store_id, sku, date)
RETAIL_SALES = T.StructType([
    T.StructField("store_id", T.StringType(), False),
    T.StructField("sku", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("units_sold", T.IntegerType(), False),
    T.StructField("price", T.DecimalType(10, 2), False),
    T.StructField("on_hand", T.IntegerType(), False),
])
RETAIL_SALES_KEY = ("store_id", "sku", "date")

# daily sales as delivered (raw) and after the transform chain (processed)
DAILY_SALES = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("sales", T.DoubleType(), True),
    T.StructField("items", T.LongType(), True),
    T.StructField("store_id", T.StringType(), True),
    T.StructField("product_category", T.StringType(), True),
])
DAILY_SALES_COLUMNS = ["date", "sales", "items", "store_id", "product_category"]

# Processed columns and their expected type family (F2).
PROCESSED_REFERENCE = {
    "date": "timestamp", "sales": "float", "items": "integer",
    "store_id": "string", "product_category": "string",
    "year": "integer", "month": "integer", "day": "integer",
    "is_weekend": "boolean", "sales_normalized": "float",
}

def type_family(dt: T.DataType) -> str:
    """Map a Spark type to the coarse family used by schema checks
    (int32 and int64 are both "integer")."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.StringType):
        return "string"
    return dt.simpleString()
