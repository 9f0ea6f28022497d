"""Table functions for SQL, usable in lateral joins on tables and streams."""

# The names of the SQL functions are public.

from __future__ import annotations

from pyspark.sql import SparkSession

from streamhouse import constants as C
from streamhouse.functions.texts import WORD


def register(spark: SparkSession) -> None:
    """Define ``ik_analyze(text)`` and ``keywordProductC2R(click, cart, order)``.

    Both are SQL functions, so that they become part of the calling query's plan.
    """
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION ik_analyze(text STRING)
        RETURNS TABLE(word STRING)
        RETURN SELECT explode(regexp_extract_all(lower(text), r'{WORD}', 0))
        """
    )
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION keywordProductC2R(
            click_ct BIGINT, cart_ct BIGINT, order_ct BIGINT)
        RETURNS TABLE(ct BIGINT, source STRING)
        RETURN SELECT inline(filter(
            array(
                named_struct('ct', click_ct, 'source', '{C.KEYWORD_CLICK}'),
                named_struct('ct', cart_ct, 'source', '{C.KEYWORD_CART}'),
                named_struct('ct', order_ct, 'source', '{C.KEYWORD_ORDER}')),
            m -> m.ct > 0))
        """
    )
