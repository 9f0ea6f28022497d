"""Record layouts of the topics, wide tables and statistics tables.

Fixed values: field names and their order are the wire contract.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

STRING = StringType()
LONG = LongType()
MONEY = DecimalType(18, 2)
TEXT_MAP = MapType(STRING, STRING)


def layout(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


COMMON = layout(mid=STRING, is_new=STRING, vc=STRING, ch=STRING, ar=STRING)
PAGE = layout(page_id=STRING, last_page_id=STRING, item=STRING, during_time=LONG)
DISPLAYS = ArrayType(layout(item_type=STRING, item=STRING))

# The start object has no fixed fields, so it is a map.
PAGE_LOG = layout(common=COMMON, page=PAGE, start=TEXT_MAP, displays=DISPLAYS, ts=LONG)

# Search terms are read through a map-typed page, as the SQL job declares it.
PAGE_VIEW = layout(common=TEXT_MAP, page=TEXT_MAP, ts=LONG)

CDC = layout(table=STRING, type=STRING, data=TEXT_MAP)

ROUTES = layout(
    source_table=STRING,
    operate_type=STRING,
    sink_type=STRING,
    sink_table=STRING,
    sink_columns=STRING,
    sink_pk=STRING,
    sink_extend=STRING,
)

ORDER_INFO = layout(
    id=LONG,
    province_id=LONG,
    order_status=STRING,
    user_id=LONG,
    total_amount=MONEY,
    activity_reduce_amount=MONEY,
    coupon_reduce_amount=MONEY,
    original_total_amount=MONEY,
    feight_fee=MONEY,
    expire_time=STRING,
    create_time=STRING,
    operate_time=STRING,
)

ORDER_DETAIL = layout(
    id=LONG,
    order_id=LONG,
    sku_id=LONG,
    order_price=MONEY,
    sku_num=LONG,
    sku_name=STRING,
    create_time=STRING,
    split_total_amount=MONEY,
    split_activity_amount=MONEY,
    split_coupon_amount=MONEY,
)

PAYMENT_INFO = layout(
    id=LONG,
    order_id=LONG,
    user_id=LONG,
    total_amount=MONEY,
    subject=STRING,
    payment_type=STRING,
    create_time=STRING,
    callback_time=STRING,
)

FAVOR_INFO = layout(
    sku_id=LONG,
    create_time=STRING,
)
CART_INFO = layout(
    sku_id=LONG,
    create_time=STRING,
)
REFUND_INFO = layout(
    sku_id=LONG,
    order_id=LONG,
    refund_amount=MONEY,
    create_time=STRING,
)
COMMENT_INFO = layout(
    sku_id=LONG,
    appraise=STRING,
    create_time=STRING,
)

ORDER_WIDE = layout(
    detail_id=LONG,
    order_id=LONG,
    sku_id=LONG,
    order_price=MONEY,
    sku_num=LONG,
    sku_name=STRING,
    province_id=LONG,
    order_status=STRING,
    user_id=LONG,
    total_amount=MONEY,
    activity_reduce_amount=MONEY,
    coupon_reduce_amount=MONEY,
    original_total_amount=MONEY,
    feight_fee=MONEY,
    split_feight_fee=MONEY,
    split_activity_amount=MONEY,
    split_coupon_amount=MONEY,
    split_total_amount=MONEY,
    expire_time=STRING,
    create_time=STRING,
    operate_time=STRING,
    create_date=STRING,
    create_hour=STRING,
    province_name=STRING,
    province_area_code=STRING,
    province_iso_code=STRING,
    province_3166_2_code=STRING,
    user_age=IntegerType(),
    user_gender=STRING,
    spu_id=LONG,
    tm_id=LONG,
    category3_id=LONG,
    spu_name=STRING,
    tm_name=STRING,
    category3_name=STRING,
)

PAYMENT_WIDE = layout(
    payment_id=LONG,
    subject=STRING,
    payment_type=STRING,
    payment_create_time=STRING,
    callback_time=STRING,
    detail_id=LONG,
    order_id=LONG,
    sku_id=LONG,
    order_price=MONEY,
    sku_num=LONG,
    sku_name=STRING,
    province_id=LONG,
    order_status=STRING,
    user_id=LONG,
    total_amount=MONEY,
    activity_reduce_amount=MONEY,
    coupon_reduce_amount=MONEY,
    original_total_amount=MONEY,
    feight_fee=MONEY,
    split_feight_fee=MONEY,
    split_activity_amount=MONEY,
    split_coupon_amount=MONEY,
    split_total_amount=MONEY,
    order_create_time=STRING,
    province_name=STRING,
    province_area_code=STRING,
    province_iso_code=STRING,
    province_3166_2_code=STRING,
    user_age=IntegerType(),
    user_gender=STRING,
    spu_id=LONG,
    tm_id=LONG,
    category3_id=LONG,
    spu_name=STRING,
    tm_name=STRING,
    category3_name=STRING,
)

# Column order of the statistics tables in the analytic store.
VISITOR_STATS = [
    "stt", "edt", "vc", "ch", "ar", "is_new",
    "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum", "ts",
]
PRODUCT_STATS = [
    "stt", "edt", "sku_id", "sku_name", "sku_price", "spu_id", "spu_name", "tm_id", "tm_name",
    "category3_id", "category3_name", "display_ct", "click_ct", "favor_ct", "cart_ct",
    "order_sku_num", "order_amount", "order_ct", "payment_amount", "paid_order_ct",
    "refund_order_ct", "refund_amount", "comment_ct", "good_comment_ct", "ts",
]
PROVINCE_STATS = [
    "stt", "edt", "province_id", "province_name", "area_code", "iso_code", "iso_3166_2",
    "order_amount", "order_count", "ts",
]
KEYWORD_STATS = ["keyword", "ct", "source", "stt", "edt", "ts"]
