"""The star-schema tables seen as report data: an order is a report, its parts are drugs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.operators.contingency import Terms, number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, drug: str = "brand", event: str = "segment") -> DataFrame:
    """report_id, received_date, drug (brand or part), event (segment or flag), serious, age_group, sex, year, position."""
    return _observations(spark, sf_dir, drug, event, lambda c: c, lambda c: c)


def numbered(spark: SparkSession, sf_dir: str, drug: str = "brand", event: str = "segment", upper: bool = False) -> tuple[DataFrame, Terms | None]:
    """``observations`` (``upper``: drugs and events in upper case) and their terms; drugs and events are then numbers of these.

    Where there are too many for reports to hold them as bits, drugs and events stay names and there are no terms.
    """
    case = F.upper if upper else lambda c: c
    parts, lines, customers = (table(spark, sf_dir, t) for t in ("part", "lineitem", "customer"))
    names = customers.select(case(F.col("c_mktsegment"))) if event == "segment" else lines.select("l_returnflag", "l_linestatus").distinct().select(case(_flag()))
    # a line names its part itself, so parts are as many as they like
    terms = Terms.of(parts.select(case(_brand())), names) if drug == "brand" else None
    if terms is None:
        return _observations(spark, sf_dir, drug, event, case, case), None
    return _observations(spark, sf_dir, drug, event, lambda c: number(case(c), terms.drugs), lambda c: number(case(c), terms.events)), terms


def _brand() -> Column:
    return F.upper("p_brand")


def _flag() -> Column:
    return F.concat_ws("-", "l_returnflag", "l_linestatus")


def _observations(spark: SparkSession, sf_dir: str, drug: str, event: str, drug_as: Callable[[Column], Column], event_as: Callable[[Column], Column]) -> DataFrame:
    lines, orders, part, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer"))
    # what an order or a part says is worked out before it meets the lines: once each, not once a line
    if drug == "brand":
        lines = lines.join(part.select("p_partkey", drug_as(_brand()).alias("drug")), F.col("l_partkey") == F.col("p_partkey"))
    name = F.col("drug") if drug == "brand" else drug_as(F.concat(F.lit("PART "), F.col("l_partkey").cast("string")))
    what = F.lit(None) if event == "segment" else event_as(_flag())
    lines = lines.select(F.col("l_orderkey").alias("report_id"), name.alias("drug"), what.alias("flag"), F.col("l_linenumber").alias("position"))
    customer = customer.select("c_custkey", "c_mktsegment", event_as(F.col("c_mktsegment")).alias("segment")) if event == "segment" else customer
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.to_date("o_orderdate").alias("received_date"), (F.col("o_orderpriority") == "1-URGENT").alias("serious"),
        F.col("c_mktsegment").alias("age_group"), F.col("o_orderstatus").alias("sex"), F.year("o_orderdate").alias("year"), *(["segment"] if event == "segment" else []),
    )
    # lines meet their orders last: so they lie by report, and what groups reports moves nothing
    rows = lines.join(orders, F.col("report_id") == F.col("o_orderkey"))
    return rows.select("report_id", "received_date", "drug", F.col(event).alias("event"), "serious", "age_group", "sex", "year", "position")


OBSERVATIONS_SQL = """
SELECT l_orderkey AS report_id, CAST(o_orderdate AS DATE) AS received_date, {drug} AS drug, {event} AS event, o_orderpriority = '1-URGENT' AS serious,
       c_mktsegment AS age_group, o_orderstatus AS sex, year(o_orderdate) AS year, l_linenumber AS position
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
"""
DRUGS = {"brand": "upper(p_brand)", "part": "'PART ' || l_partkey"}
EVENTS = {"segment": "c_mktsegment", "flag": "l_returnflag || '-' || l_linestatus"}


def observations_sql(drug: str = "brand", event: str = "segment") -> str:
    return OBSERVATIONS_SQL.format(drug=DRUGS[drug], event=EVENTS[event])
