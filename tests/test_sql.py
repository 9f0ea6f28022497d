"""The statistics written in SQL give what the operators give."""

from __future__ import annotations

import pytest

from streamhouse.functions.tables import register
from streamhouse.operators import keyword, province, wide
from streamhouse.plans.inputs import Inputs
from streamhouse.session import tune

SMALL = "/root/testdata/sf0.001"

PRODUCT_KEYWORDS = """
WITH split AS (SELECT s.*, k.word FROM product_stats s JOIN LATERAL ik_analyze(s.spu_name) AS k(word))
SELECT split.word AS keyword, m.ct, m.source, string(split.stt) AS stt, string(split.edt) AS edt
FROM split JOIN LATERAL keywordProductC2R(split.click_ct, split.cart_ct, split.order_ct) AS m(ct, source)
"""

SEARCH_KEYWORDS = """
WITH hits AS (
  SELECT window(timestamp_millis(v.ts div 1000 * 1000), '10 seconds') AS span, k.word
  FROM page_view v JOIN LATERAL ik_analyze(v.page['item']) AS k(word)
  WHERE v.page['page_id'] = 'good_list')
SELECT word AS keyword, count(1) AS ct, 'SEARCH' AS source,
       date_format(span.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(span.end, 'yyyy-MM-dd HH:mm:ss') AS edt
FROM hits GROUP BY span, word
"""

PROVINCE = """
SELECT date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS stt,
       date_format(w.end, 'yyyy-MM-dd HH:mm:ss') AS edt,
       province_id, province_name, province_area_code AS area_code,
       province_iso_code AS iso_code, province_3166_2_code AS iso_3166_2,
       count(DISTINCT order_id) AS order_count, sum(split_total_amount) AS order_amount
FROM (SELECT *, window(to_timestamp(create_time), '10 seconds') AS w FROM order_wide) AS placed
GROUP BY w, province_id, province_name, province_area_code, province_iso_code, province_3166_2_code
"""


@pytest.fixture
def tables(spark):
    tune(spark)
    register(spark)
    return Inputs(spark, SMALL)


def test_product_keywords(spark, tables, rows):
    stats = spark.createDataFrame(
        [("Red Ring", 2, 0, 3, "2024-01-01 00:00:00", "2024-01-01 00:00:10"),
         ("bolt", 0, 1, 0, "2024-01-01 00:00:00", "2024-01-01 00:00:10"),
         ("none", 0, 0, 0, "2024-01-01 00:00:00", "2024-01-01 00:00:10"),
         (None, 1, 1, 1, "2024-01-01 00:00:00", "2024-01-01 00:00:10")],
        "spu_name string, click_ct long, cart_ct long, order_ct long, stt string, edt string",
    )
    stats.createOrReplaceTempView("product_stats")
    got = spark.sql(PRODUCT_KEYWORDS)
    assert rows(got) == rows(keyword.product_keywords(stats))
    assert got.count() == 5
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_keywords(spark, tables, rows):
    view = tables.page_view()
    view.createOrReplaceTempView("page_view")
    columns = ("keyword", "ct", "source", "stt", "edt")
    assert rows(spark.sql(SEARCH_KEYWORDS), *columns) == rows(keyword.search_keywords(view), *columns)


def test_province_stats(spark, tables, rows):
    orders = wide.order_wide(tables.order_info(True), tables.order_detail(), tables.dims("province"))
    orders.createOrReplaceTempView("order_wide")
    want = province.province_stats(orders)
    money = "CAST(order_amount AS DOUBLE) AS order_amount"
    columns = [c for c in want.columns if c != "order_amount"]
    got = spark.sql(PROVINCE).selectExpr(*columns, money)
    assert rows(got) == rows(want.selectExpr(*columns, money))


def test_lateral_functions_on_a_stream(spark, tables, tmp_path, rows):
    spark.createDataFrame([("Red ring",), ("--",)], "t string").write.parquet(f"{tmp_path}/in")
    spark.readStream.schema("t string").parquet(f"{tmp_path}/in").createOrReplaceTempView("texts")
    words = spark.sql("SELECT keyword FROM texts, LATERAL ik_analyze(t) AS T(keyword)")
    query = (
        words.writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [("red",), ("ring",)]
