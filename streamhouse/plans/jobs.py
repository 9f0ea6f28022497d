"""The warehouse's streaming jobs: topics in, topics, dimension tables and statistics out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from streamhouse import constants as C
from streamhouse import schemas as S
from streamhouse.functions.times import created_at, event_time, to_epoch_ms
from streamhouse.operators import cdc, keyword, logs, product, province, visitor, visits, wide
from streamhouse.operators.windows import RECORD, pulse, with_watermark
from streamhouse.sinks.tables import DIM_BUCKETS, StatsSink, create_dims, upsert_dim
from streamhouse.sinks.topics import publish, to_topic
from streamhouse.sources.tables import latest_version, parts_of, read_dim, read_parts, write_version
from streamhouse.sources.topics import TEXT, Bus, create_topic_view, read_parsed, read_records, read_topic
from streamhouse.streaming.late import OUT, is_late, late_input, told_late, watermark_before, with_inputs
from streamhouse.streaming.processors import bounces_stream, repaired, with_first_days
from streamhouse.streaming.runner import checkpoint_of, start

CDC_RECORD = StructType([*S.CDC.fields]).add("ts", S.LONG).add("xid", S.LONG).add("xoffset", S.LONG)

# Delays are one millisecond over the allowed disorder: a row exactly at the watermark is late.
IN_ORDER = "1 millisecond"
SOME_DISORDER = "3001 milliseconds"

DIM_TABLES = {
    "user": ("DIM_USER_INFO", ("ID", "BIRTHDAY", "GENDER")),
    "province": ("DIM_BASE_PROVINCE", ("ID", "NAME", "AREA_CODE", "ISO_CODE", "ISO_3166_2")),
    "sku": ("DIM_SKU_INFO", ("ID", "SKU_NAME", "PRICE", "SPU_ID", "CATEGORY3_ID", "TM_ID")),
    "spu": ("DIM_SPU_INFO", ("ID", "SPU_NAME")),
    "trademark": ("DIM_BASE_TRADEMARK", ("ID", "TM_NAME")),
    "category3": ("DIM_BASE_CATEGORY3", ("ID", "NAME")),
}


@dataclass(frozen=True)
class Warehouse:
    """Where a deployment keeps its topics, tables and checkpoints.

    ``idle``: how far a silent topic may hold back the windows of a statistic behind page log and orders; without it, for
    good. ``lexicon``: words by which runs of Chinese text become keywords; without it each stays one.
    """

    spark: SparkSession
    bus: Bus
    dims: str
    stats: StatsSink
    routes: Callable[[], DataFrame] | None = None
    checkpoints: str | None = None
    available_now: bool = False
    window: str = "10 seconds"
    bounce_ms: int = visits.BOUNCE_MS
    dim_buckets: int = DIM_BUCKETS
    idle: str | None = None
    lexicon: Callable[[], DataFrame] | None = None

    def records(self, topic: str, schema: StructType, text: bool = False) -> DataFrame:
        return read_records(self.spark, self.bus, topic, schema, text=text)

    def dim_tables(self, *names: str) -> wide.Dims:
        """Newest versions of the dimensions; one that was never written is empty."""
        found = {}
        for name in names or DIM_TABLES:
            table, columns = DIM_TABLES[name]
            empty = S.layout(**{c: S.STRING for c in columns})
            dim = read_dim(self.spark, self.dims, table, empty)
            found[name] = dim.toDF(*[c.upper() for c in dim.columns])
        return wide.Dims(**found)

    def start(
        self, name: str, df: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append"
    ) -> StreamingQuery:
        return start(df, name, write, self.checkpoints, self.available_now, mode=mode)

    def beat(self, inputs: Sequence[tuple[DataFrame, Column]]) -> DataFrame | None:
        return None if self.idle is None else pulse(inputs, self.idle)

    def folder(self, name: str) -> str:
        """The checkpoint of a job."""
        return checkpoint_of(self.spark, name, self.checkpoints)

    def publish(self, rows: DataFrame, name: str, batch_id: int) -> None:
        publish(rows, self.bus, name, batch_id, self.folder(name))

    def start_topics(self, name: str, rows: DataFrame) -> StreamingQuery:
        """Publish ``topic`` and ``value`` rows."""
        return self.start(name, rows, lambda df, batch: self.publish(df, name, batch))

    def start_windows(
        self, name: str, df: DataFrame, inputs: Sequence[DataFrame], write: Callable[[DataFrame, int], None]
    ) -> StreamingQuery:
        """``write`` the closed windows; publish input rows that came after their window had closed."""

        def split(batch: DataFrame, batch_id: int) -> None:
            before = watermark_before(batch.sparkSession, self.folder(name), batch_id)
            kept = batch.where(F.col(OUT).isNotNull() | is_late(before, self.window)).persist()
            try:
                write(kept.where(F.col(OUT).isNotNull()).select(f"{OUT}.*"), batch_id)
                late = told_late(kept, before, self.window, C.TOPIC_DEAD_LETTER)
                publish(late, self.bus, f"{name}_late", batch_id, self.folder(name), "late")
            finally:
                kept.unpersist()

        return self.start(name, with_inputs(df, inputs), split)

    def start_stats(
        self, name: str, df: DataFrame, table: str, columns: list[str], inputs: Sequence[DataFrame] = ()
    ) -> StreamingQuery:
        """Append windows to a table of the analytic store."""
        return self.start_windows(name, df, inputs, lambda b, i: self.stats.append(b, table, columns, name, i))


def log_outputs(log: DataFrame) -> DataFrame:
    """``topic`` and ``value`` of all outputs of each log row, in one pass over a stream.

    With a ``raw`` column the outputs are the text that came in, with ``is_new`` repaired, and
    displays are its elements with the page added, so fields without a column stay as well.
    """

    def record(topic: str, value: Column) -> Column:
        return F.struct(F.lit(topic).alias("topic"), value.alias("value"))

    page_id = F.col("page.page_id")
    if "raw" in log.columns:
        whole = logs.with_flag(F.col("raw"), F.col("common.is_new"))
        shown = F.from_json("raw", "displays array<string>")["displays"]
        value = lambda d: logs.with_page(d, page_id)
    else:
        whole, shown = F.to_json(F.struct(*log.columns)), F.col("displays")
        value = lambda d: F.to_json(
            F.struct(d["item_type"].alias("item_type"), d["item"].alias("item"), page_id.alias("page_id"))
        )
    page = F.array(record(C.TOPIC_PAGE, whole))
    displays = F.transform(shown, lambda d: record(C.TOPIC_DISPLAY, value(d)))
    outputs = F.when(logs.is_start(log), F.array(record(C.TOPIC_START, whole))).otherwise(
        F.coalesce(F.concat(page, displays), page)
    )
    return log.select(F.inline(outputs))


def dead_letters(bad: DataFrame, topic: str) -> DataFrame:
    """``topic`` and ``value`` of records that do not parse: where they came from, and their text."""
    record = F.struct(F.lit(topic).alias("source_topic"), "position", "value")
    return bad.select(F.lit(C.TOPIC_DEAD_LETTER).alias("topic"), F.to_json(record).alias("value"))


def split_log(w: Warehouse) -> StreamingQuery:
    """Repair new-visitor flags and split the raw log into start, page and display topics."""
    parsed = read_parsed(w.spark, w.bus, C.TOPIC_RAW_LOG, S.PAGE_LOG)
    tagged = with_first_days(parsed.good)
    lost = dead_letters(parsed.bad, C.TOPIC_RAW_LOG)
    stream = tagged.unionByName(lost.select(F.lit("lost").alias("kind"), F.struct("topic", "value").alias("lost")), allowMissingColumns=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            outputs = log_outputs(repaired(batch))
            bad = batch.where("kind = 'lost'").select("lost.topic", "lost.value")
            w.publish(outputs.unionByName(bad), "split_log", batch_id)
        finally:
            batch.unpersist()

    return w.start("split_log", stream, write, mode="update")


def refresh_routes(spark: SparkSession, folder: str, config: DataFrame, batch_id: int) -> DataFrame:
    """The routes for a micro-batch: those of the batches before, overwritten by the configuration. Stored where that changes them."""
    version = latest_version(spark, folder, before=batch_id)
    known = None if version is None else read_parts(spark, folder, parts_of(spark, folder, version), S.ROUTES)
    routes = cdc.load_routes(config, known)
    if known is not None and routes is known:
        return known
    write_version(routes, folder, batch_id)
    return read_parts(spark, folder, parts_of(spark, folder, batch_id), S.ROUTES)


def route_changes(w: Warehouse) -> StreamingQuery:
    """Route change records to fact topics and dimension tables, as configured right now.

    The routes in use are a table beside the job's checkpoint, with a version for each micro-batch that changed them. So a
    route that left the configuration stays in use after a restart, and a repeated batch starts from what it
    started from at first.
    """
    stored = f"{w.folder('route_changes')}/routes"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routes = refresh_routes(spark, stored, w.routes(), batch_id)
        tables = create_dims(spark, w.dims, routes)
        records, bad = logs.parse_json(batch, CDC_RECORD, keep=("position",))
        routed = cdc.route(cdc.clean(records), routes).withColumnRenamed("ts", "at").persist()
        try:
            facts, dims = cdc.split_routed(routed)
            fact_rows = facts.select(
                F.col("sink_table").alias("topic"), F.to_json("data").alias("value")
            )
            lost = dead_letters(bad, C.TOPIC_RAW_DB)
            w.publish(fact_rows.unionByName(lost), "route_changes", batch_id)
            # At most one row per dimension route.
            for row in dims.select(F.upper("sink_table").alias("t")).distinct().collect():
                if row.t not in tables:
                    raise ValueError(f"no insert route creates the dimension {row.t}")
                schema, pk = tables[row.t]
                changes = cdc.dim_changes(dims, row.t)
                upsert_dim(spark, w.dims, row.t, schema, pk, changes, batch_id, w.dim_buckets)
        finally:
            routed.unpersist()

    return w.start("route_changes", read_topic(w.spark, w.bus, C.TOPIC_RAW_DB), write)


def unique_visit(w: Warehouse) -> StreamingQuery:
    log = w.records(C.TOPIC_PAGE, S.PAGE_LOG).drop(RECORD)  # a repeat is no first visit
    first = visits.unique_visits(log).select(*log.columns)
    return w.start_topics("unique_visit", to_topic(first, C.TOPIC_UNIQUE_VISIT))


def bounce_detail(w: Warehouse) -> StreamingQuery:
    log = w.records(C.TOPIC_PAGE, S.PAGE_LOG).drop(RECORD)  # a repeat changes no bounce
    bounced = bounces_stream(log, w.bounce_ms, IN_ORDER)
    rows = bounced.select(F.lit(C.TOPIC_BOUNCE).alias("topic"), "value")
    return w.start_topics("bounce_detail", rows)


def _timed(df: DataFrame, column: str, delay: str, offset: str | None = None) -> DataFrame:
    at = F.timestamp_millis(to_epoch_ms(F.col(column), offset))
    return with_watermark(df.withColumn("event_time", at), delay)


def order_wide(w: Warehouse) -> StreamingQuery:
    """Join orders with details, then look up the dimensions as of each micro-batch."""
    orders = _timed(w.records(C.TOPIC_ORDER_INFO, S.ORDER_INFO), "create_time", SOME_DISORDER)
    details = _timed(w.records(C.TOPIC_ORDER_DETAIL, S.ORDER_DETAIL), "create_time", SOME_DISORDER)
    joined = wide.order_wide(orders, details, wide.Dims()).drop("event_time")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = wide.enrich_order_wide(batch, w.dim_tables(), F.now())
        w.publish(to_topic(rows, C.TOPIC_ORDER_WIDE), "order_wide", batch_id)

    return w.start("order_wide", joined, write)


def payment_wide(w: Warehouse) -> StreamingQuery:
    pay = _timed(w.records(C.TOPIC_PAYMENT_INFO, S.PAYMENT_INFO), "callback_time", SOME_DISORDER)
    orders = _timed(w.records(C.TOPIC_ORDER_WIDE, S.ORDER_WIDE), "create_time", SOME_DISORDER)
    rows = wide.payment_wide(pay, orders).drop("event_time")
    return w.start_topics("payment_wide", to_topic(rows, C.TOPIC_PAYMENT_WIDE))


def visitor_stats(w: Warehouse) -> StreamingQuery:
    topics = (C.TOPIC_PAGE, C.TOPIC_UNIQUE_VISIT, C.TOPIC_BOUNCE)
    inputs = {topic: w.records(topic, S.PAGE_LOG, text=True) for topic in topics}
    beat = w.beat([(inputs[C.TOPIC_PAGE], event_time(F.col("ts")))])
    stats = visitor.visitor_stats(*inputs.values(), w.window, SOME_DISORDER, beat)
    late = [late_input(df, topic, event_time(F.col("ts")), TEXT) for topic, df in inputs.items()]
    return w.start_stats("visitor_stats", stats, "visitors_stats", S.VISITOR_STATS, late)


def product_stats(w: Warehouse) -> StreamingQuery:
    """Window totals per SKU; dimensions, table and topic once per micro-batch."""
    schemas = {
        C.TOPIC_PAGE: S.PAGE_LOG,
        C.TOPIC_ORDER_WIDE: S.ORDER_WIDE,
        C.TOPIC_FAVOR: S.FAVOR_INFO,
        C.TOPIC_CART: S.CART_INFO,
        C.TOPIC_PAYMENT_WIDE: S.PAYMENT_WIDE,
        C.TOPIC_REFUND: S.REFUND_INFO,
        C.TOPIC_COMMENT: S.COMMENT_INFO,
    }
    inputs = {topic: w.records(topic, schema, text=True) for topic, schema in schemas.items()}
    page, orders, favors, carts, payments, refunds, comments = inputs.values()
    beat = w.beat([(page, event_time(F.col("ts"))), (orders, created_at(orders))])
    branches = [
        product.page_measures(page, IN_ORDER, beat),
        product.order_measures(orders, w.window, IN_ORDER, beat),
        product.favor_measures(favors),
        product.cart_measures(carts),
        product.payment_measures(payments, w.window, IN_ORDER, beat),
        product.refund_measures(refunds, w.window, IN_ORDER, beat),
        product.comment_measures(comments),
    ]
    times = {C.TOPIC_PAGE: event_time(F.col("ts")), C.TOPIC_PAYMENT_WIDE: created_at(payments, "payment_create_time")}
    late = [late_input(df, topic, times.get(topic, created_at(df)), TEXT) for topic, df in inputs.items()]
    totals = product.product_totals(branches, w.window, IN_ORDER, beat)

    def write(batch: DataFrame, batch_id: int) -> None:
        """One micro-batch's windows, with dimensions, to the store and the topic."""
        dims = w.dim_tables("sku", "spu", "trademark", "category3")
        rows = product.with_product_dims(batch, dims).persist()
        try:
            w.stats.append(rows, "product_stats", S.PRODUCT_STATS, "product_stats", batch_id)
            w.publish(to_topic(rows, C.TOPIC_PRODUCT_STATS), "product_stats", batch_id)
        finally:
            rows.unpersist()

    return w.start_windows("product_stats", totals, late, write)


def province_stats(w: Warehouse) -> StreamingQuery:
    orders = create_topic_view(
        w.spark, w.bus, C.TOPIC_ORDER_WIDE, S.ORDER_WIDE, "order_wide", "province_stats", text=True
    )
    stats = province.province_stats(orders, w.window)
    late = late_input(orders, C.TOPIC_ORDER_WIDE, created_at(orders), TEXT)
    return w.start_stats("province_stats", stats, "province_stats", S.PROVINCE_STATS, [late])


def keyword_stats(w: Warehouse) -> StreamingQuery:
    view = create_topic_view(
        w.spark, w.bus, C.TOPIC_PAGE, S.PAGE_VIEW, "page_view", "keyword_stats", text=True
    )
    stats = keyword.search_keywords(view, w.window) if w.lexicon is None else keyword.search_texts(view, w.window)
    searched = view.where(keyword.is_search())  # other rows are in no window
    late = late_input(searched, C.TOPIC_PAGE, keyword.searched_at(), TEXT)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if w.lexicon is None else keyword.keywords_of_texts(batch, w.lexicon())
        w.stats.append(rows, "keyword_stats", S.KEYWORD_STATS, "keyword_stats", batch_id)

    return w.start_windows("keyword_stats", stats, [late], write)


def product_keyword_stats(w: Warehouse) -> StreamingQuery:
    fields = S.layout(
        spu_name=S.STRING, click_ct=S.LONG, cart_ct=S.LONG, order_ct=S.LONG, stt=S.STRING, edt=S.STRING
    )
    stats = create_topic_view(
        w.spark, w.bus, C.TOPIC_PRODUCT_STATS, fields, "product_stats", "product_keyword_stats"
    )
    if w.bus.once:
        stats = with_watermark(stats.withColumn("event_time", F.try_to_timestamp("stt")), SOME_DISORDER)

    def write(batch: DataFrame, batch_id: int) -> None:
        words = keyword.product_keywords(batch, w.lexicon() if w.lexicon else None)
        w.stats.append(words, "keyword_stats", S.KEYWORD_STATS, "product_keyword_stats", batch_id)

    return w.start("product_keyword_stats", stats, write)


JOBS: dict[str, Callable[[Warehouse], StreamingQuery]] = {
    "split_log": split_log,
    "route_changes": route_changes,
    "unique_visit": unique_visit,
    "bounce_detail": bounce_detail,
    "order_wide": order_wide,
    "payment_wide": payment_wide,
    "visitor_stats": visitor_stats,
    "product_stats": product_stats,
    "province_stats": province_stats,
    "keyword_stats": keyword_stats,
    "product_keyword_stats": product_keyword_stats,
}
