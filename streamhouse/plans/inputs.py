"""Maps the test tables to the layouts of the warehouse's inputs (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamhouse import constants as C
from streamhouse.functions.texts import to_json_value
from streamhouse.functions.times import SECOND_PATTERN, to_second_text
from streamhouse.operators.neighbours import with_neighbour
from streamhouse.operators.wide import Dims
from streamhouse.schemas import ROUTES

SESSION_GAP_MS = 30 * 60 * 1000
DAY_MS = 24 * 3600 * 1000
PRODUCT_SHIFT_DAYS = 9131
PRODUCT_COUNT = 100

ROUTE_ROWS = [
    ("nation", "insert", C.SINK_DIM, "DIM_BASE_PROVINCE", "n_nationkey,n_name", "n_nationkey", None),
    ("nation", "update", C.SINK_DIM, "DIM_BASE_PROVINCE", "n_nationkey,n_name", "n_nationkey", None),
    (
        "orders",
        "insert",
        C.SINK_FACT,
        "dwd_order_info",
        "o_orderkey,o_custkey,o_totalprice,o_orderdate",
        "o_orderkey",
        None,
    ),
    ("customer", "insert", C.SINK_FACT, "dwd_customer", "", "c_custkey", None),
    ("part", "insert", "clickhouse", "part", "p_partkey", "p_partkey", None),
]


class Inputs:
    """The warehouse's inputs, derived from the tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """A table; its schema is read from the file once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    # -- logs ---------------------------------------------------------------------------

    def events(self) -> DataFrame:
        """Events with ``ts`` in epoch milliseconds and ``k`` from the properties."""
        return self.table("events").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
            F.from_json("props", "k int")["k"].alias("k"),
        )

    def page_log(self) -> DataFrame:
        """Page logs; the previous page counts if the same user was on it in the last half hour."""
        page_id = (
            F.when(F.col("event_type") == "view", C.PAGE_GOOD_DETAIL)
            .when(F.col("event_type") == "click", C.PAGE_GOOD_LIST)
            .otherwise(F.col("event_type"))
        )
        events = with_neighbour(
            self.events().withColumn("page_id", page_id),
            key=F.col("user_id"),
            ts_ms=F.col("ts"),
            reach_ms=SESSION_GAP_MS,
            value=F.col("page_id"),
            name="last_page_id",
            forward=False,
            ties=(F.col("event_id"),),
        )
        return self._log(events, F.col("last_page_id"))

    def plain_log(self) -> DataFrame:
        """Logs without a previous page, for operators that do not look at it."""
        page_id = (
            F.when(F.col("event_type") == "view", C.PAGE_GOOD_DETAIL)
            .when(F.col("event_type") == "click", C.PAGE_GOOD_LIST)
            .otherwise(F.col("event_type"))
        )
        return self._log(
            self.events().withColumn("page_id", page_id), F.lit(None).cast("string")
        )

    @staticmethod
    def _log(events: DataFrame, last_page_id: Column) -> DataFrame:
        def shown(kind: str, item: Column) -> Column:
            return F.struct(F.lit(kind).alias("item_type"), item.cast("string").alias("item"))

        return events.select(
            F.struct(
                F.col("user_id").cast("string").alias("mid"),
                F.when(F.expr("(user_id + ts div 86400000) % 4 = 0"), "0").otherwise("1").alias("is_new"),
                F.concat(F.lit("v"), F.col("user_id") % 3).alias("vc"),
                F.concat(F.lit("ch"), F.col("user_id") % 5).alias("ch"),
                (F.col("user_id") % 25).cast("string").alias("ar"),
            ).alias("common"),
            F.struct(
                "page_id",
                last_page_id.alias("last_page_id"),
                F.col("k").cast("string").alias("item"),
                F.floor(F.col("value") * 1000).alias("during_time"),
            ).alias("page"),
            F.when(F.col("event_type") == "signup", F.struct(F.lit("icon").alias("entry"))).alias(
                "start"
            ),
            F.when(
                F.col("event_type") == "view",
                F.array(shown("sku_id", F.col("k")), shown("activity_id", F.col("k") + 1)),
            ).alias("displays"),
            "ts",
        )

    def page_view(self) -> DataFrame:
        """Logs with a map-typed page; search pages carry the name of part ``k`` as item."""
        log = self.plain_log()
        is_search = F.col("page.page_id") == C.PAGE_GOOD_LIST
        parts = self.table("part").select("p_partkey", "p_name")
        searched = log.join(
            parts, is_search & (F.col("page.item").cast("bigint") == F.col("p_partkey")), "left"
        )
        item = F.when(is_search, F.col("p_name")).otherwise(F.col("page.item"))
        return searched.select(
            F.create_map(
                F.lit("page_id"), F.col("page.page_id"), F.lit("item"), item
            ).alias("page"),
            "ts",
        )

    def shifted_log(self) -> DataFrame:
        """Logs moved to the years of the orders."""
        return self.plain_log().withColumn(
            "ts", F.col("ts") - F.lit(PRODUCT_SHIFT_DAYS * DAY_MS)
        )

    def event_facts(self, kind: str) -> DataFrame:
        """Favours (from clicks) or cart additions (from purchases), moved like the logs."""
        return (
            self.events()
            .where(F.col("event_type") == kind)
            .select(
                F.col("k").cast("bigint").alias("sku_id"),
                to_second_text(
                    F.timestamp_millis(F.col("ts") - F.lit(PRODUCT_SHIFT_DAYS * DAY_MS))
                ).alias("create_time"),
            )
        )

    # -- orders -------------------------------------------------------------------------

    def order_info(self, province: bool = False) -> DataFrame:
        created = F.col("o_orderdate").cast("timestamp")
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
            to_second_text(created).alias("create_time"),
            created.alias("event_time"),
        )
        if not province:
            return orders.withColumn("province_id", F.lit(None).cast("bigint"))
        homes = self.table("customer").select(
            "c_custkey", F.col("c_nationkey").cast("bigint").alias("province_id")
        )
        return orders.join(homes, F.col("user_id") == F.col("c_custkey"), "left").drop("c_custkey")

    def _details(self, lines: DataFrame) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("sku_id"),
            price.alias("order_price"),
            F.col("l_quantity").cast("bigint").alias("sku_num"),
            F.lit(None).cast("string").alias("sku_name"),
            to_second_text(F.col("created")).alias("create_time"),
            price.alias("split_total_amount"),
            F.col("created").alias("event_time"),
            "l_returnflag",
            "l_linestatus",
        )

    def order_detail(self) -> DataFrame:
        """Order lines created when their order was."""
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        lines = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return self._details(lines.withColumn("created", F.col("o_orderdate").cast("timestamp")))

    def shipped_detail(self) -> DataFrame:
        """Order lines created when they were shipped."""
        lines = self.table("lineitem")
        return self._details(lines.withColumn("created", F.col("l_shipdate").cast("timestamp")))

    def payment_info(self) -> DataFrame:
        paid = F.timestamp_seconds(
            F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 3600
        )
        return (
            self.table("orders")
            .where(F.col("o_orderstatus") == "F")
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("user_id"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
                F.col("o_orderpriority").alias("subject"),
                (F.lit(1101) + F.col("o_orderkey") % 3).cast("string").alias("payment_type"),
                to_second_text(paid).alias("create_time"),
                to_second_text(paid).alias("callback_time"),
                paid.alias("event_time"),
            )
        )

    def as_products(self, df: DataFrame) -> DataFrame:
        """Map part keys to the products that the events mention."""
        return df.withColumn("sku_id", F.col("sku_id") % PRODUCT_COUNT)

    def refunds(self) -> DataFrame:
        lines = self.order_detail().where(F.col("l_returnflag") == "R")
        return lines.withColumn("refund_amount", F.col("split_total_amount"))

    def comments(self) -> DataFrame:
        appraise = F.when(F.col("l_linestatus") == "O", C.APPRAISE["good"]).otherwise(
            C.APPRAISE["bad"]
        )
        lines = self.order_detail().where(F.col("l_returnflag") == "A")
        return lines.withColumn("appraise", appraise)

    # -- dimensions ---------------------------------------------------------------------

    def dims(self, *names: str) -> Dims:
        """The named dimensions, or all of them."""
        build = {
            "user": self.dim_user,
            "province": self.dim_province,
            "sku": self.dim_sku,
            "spu": self.dim_spu,
            "trademark": self.dim_trademark,
            "category3": self.dim_category3,
        }
        return Dims(**{n: build[n]() for n in (names or build)})

    def dim_user(self) -> DataFrame:
        born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") * 37 % 14600).cast("int"))
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("ID"),
            F.date_format(born, "yyyy-MM-dd").alias("BIRTHDAY"),
            F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("GENDER"),
        )

    def dim_province(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("string").alias("ID"),
            F.col("n_name").alias("NAME"),
            F.col("n_regionkey").cast("string").alias("AREA_CODE"),
            F.concat(F.lit("I"), "n_nationkey").alias("ISO_CODE"),
            F.concat(F.lit("CN-"), "n_nationkey").alias("ISO_3166_2"),
        )

    @staticmethod
    def _tm_id() -> Column:
        return F.regexp_extract("p_brand", r"(\d+)", 1)

    @staticmethod
    def _category3_id() -> Column:
        return F.conv(F.substring(F.md5("p_type"), 1, 15), 16, 10)

    def dim_sku(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("ID"),
            F.col("p_name").alias("SKU_NAME"),
            F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("PRICE"),
            F.col("p_size").cast("string").alias("SPU_ID"),
            self._category3_id().alias("CATEGORY3_ID"),
            self._tm_id().alias("TM_ID"),
        )

    def dim_spu(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_size").cast("string").alias("ID")).agg(
            F.min("p_name").alias("SPU_NAME")
        )

    def dim_trademark(self) -> DataFrame:
        return self.table("part").groupBy(self._tm_id().alias("ID")).agg(
            F.min("p_brand").alias("TM_NAME")
        )

    def dim_category3(self) -> DataFrame:
        return self.table("part").groupBy(self._category3_id().alias("ID")).agg(
            F.min("p_type").alias("NAME")
        )

    # -- change records -----------------------------------------------------------------

    def routes(self) -> DataFrame:
        return self.spark.createDataFrame(ROUTE_ROWS, ROUTES)

    def _records(self, table: Column, kind: Column, data: DataFrame) -> DataFrame:
        return to_json_value(
            data.select(
                table.alias("table"), kind.alias("type"), F.struct(*data.columns).alias("data")
            )
        )

    def change_values(self) -> DataFrame:
        """JSON change records: dimension inserts and updates, facts, unrouted and dirty ones."""
        nation = self.table("nation")
        renamed = nation.withColumn("n_name", F.concat("n_name", F.lit("!")))
        orders = self.table("orders").withColumn(
            "o_orderdate", F.date_format("o_orderdate", SECOND_PATTERN)
        )
        finished = F.col("o_orderstatus") == "F"
        events = self.table("events")
        no_table = events.where(F.col("event_type") == "error").select(
            F.lit(None).cast("string").alias("table"),
            F.lit("insert").alias("type"),
            F.struct("event_id").alias("data"),
        )
        no_data = events.where(F.col("event_type") == "signup").select(
            F.lit("events").alias("table"),
            F.lit("insert").alias("type"),
            F.struct(F.lit(None).cast("string").alias("event_id")).alias("data"),
        )
        insert = F.lit("insert")
        parts = [
            self._records(F.lit("nation"), insert, nation),
            self._records(F.lit("nation"), F.lit("update"), renamed),
            self._records(F.lit("orders"), F.when(finished, "bootstrap-insert").otherwise("insert"), orders),
            self._records(F.lit("orders"), F.lit("delete"), orders.where(F.col("o_orderstatus") == "P")),
            self._records(F.lit("customer"), insert, self.table("customer")),
            self._records(F.lit("part"), insert, self.table("part")),
            self._records(F.lit("supplier"), insert, self.table("supplier")),
            to_json_value(no_table),
            to_json_value(no_data),
        ]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        return union

    def customer_changes(self) -> DataFrame:
        """Each order updates its customer's balance; a return also blanks the segment."""
        update = F.create_map(
            F.lit("c_custkey"),
            F.col("o_custkey").cast("string"),
            F.lit("c_acctbal"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        )
        blank = F.create_map(F.lit("c_mktsegment"), F.lit(None).cast("string"))
        return self.table("orders").select(
            F.when(F.col("o_orderstatus") == "P", F.map_concat(update, blank))
            .otherwise(update)
            .alias("data"),
            "o_orderdate",
            "o_orderkey",
        )
