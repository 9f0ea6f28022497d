"""Business codes shared by the operators."""

# Codes of comments.
APPRAISE = {"good": "1201", "soso": "1202", "bad": "1203", "auto": "1204"}

# Keyword sources.
KEYWORD_SEARCH = "SEARCH"
KEYWORD_CLICK = "CLICK"
KEYWORD_CART = "CART"
KEYWORD_ORDER = "ORDER"

# Page ids and item types that carry meaning.
PAGE_GOOD_DETAIL = "good_detail"
PAGE_GOOD_LIST = "good_list"
ITEM_TYPE_SKU = "sku_id"

# Sink types of the routing table.
SINK_DIM = "hbase"
SINK_FACT = "kafka"

# Topic names.
TOPIC_RAW_LOG = "ods_base_log"
TOPIC_RAW_DB = "ods_base_db_m"
TOPIC_START = "dwd_start_log"
TOPIC_PAGE = "dwd_page_log"
TOPIC_DISPLAY = "dwd_display_log"
TOPIC_ORDER_INFO = "dwd_order_info"
TOPIC_ORDER_DETAIL = "dwd_order_detail"
TOPIC_PAYMENT_INFO = "dwd_payment_info"
TOPIC_FAVOR = "dwd_favor_info"
TOPIC_CART = "dwd_cart_info"
TOPIC_REFUND = "dwd_order_refund_info"
TOPIC_COMMENT = "dwd_comment_info"
TOPIC_UNIQUE_VISIT = "dwm_unique_visit"
TOPIC_BOUNCE = "dwm_user_jump_detail"
TOPIC_ORDER_WIDE = "dwm_order_wide"
TOPIC_PAYMENT_WIDE = "dwm_payment_wide"
TOPIC_PRODUCT_STATS = "dws_product_stats"

# Records that do not parse.
TOPIC_DEAD_LETTER = "dead_letter"
