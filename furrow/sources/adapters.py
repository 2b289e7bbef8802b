"""Shape the driver's TPC-H-like tables into the long statistics schema.

``obs_long`` is the aggregated monthly table (one row per period x location x
class x statistic, with national and all-class totals); ``obs_raw`` is the
line-item grain table with text values, injected nulls and spelling variants
that the cleaning operators are meant to handle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.tables import read_table

SERIES_KEYS = ["LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"]

# Fixed values of the long schema (labels of totals, statistics and units).
TOTAL_LOCATION = "U.S. TOTAL"
TOTAL_CLASS = "ALL CLASSES"
STAT_UNITS = {
    "AREA PLANTED": "THOUSAND ACRES",
    "AREA HARVESTED": "THOUSAND ACRES",
    "PRODUCTION": "THOUSAND CWT",
    "YIELD": "POUNDS PER ACRE",
}
FIRST_YEAR = 1995

_DEC = "decimal(18,2)"


def _joined_lines(spark: SparkSession, sf_dir: str, extra: list[str]) -> DataFrame:
    """lineitem joined to supplier -> nation and part, inner on keys.

    No hints: nation is tiny, and whether supplier/part fit a broadcast is
    decided by Catalyst from scan sizes and by AQE from runtime sizes.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", *extra)
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return (li.join(su, li.l_suppkey == su.s_suppkey)
              .join(na, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(pa, F.col("l_partkey") == F.col("p_partkey")))


def period_idx(year: Column, month: Column) -> Column:
    return ((year - F.lit(FIRST_YEAR)) * 12 + month).cast("int")


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly long table with totals from GROUPING SETS, four statistics."""
    # Exact sums in integer hundredths (quantity, price) and ten-thousandths
    # (quantity x (1 - discount)): bigint sums stay on the fast path, unlike
    # decimal sums whose result precision exceeds 18 digits.
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    d = _joined_lines(spark, sf_dir, []).select(
        F.year("l_shipdate").cast("int").alias("YEAR"),
        F.month("l_shipdate").cast("int").alias("MONTH"),
        F.col("n_name").alias("loc"),
        F.col("p_type").alias("cls"),
        cents("l_quantity").alias("q"),
        (cents("l_quantity") * (F.lit(100) - cents("l_discount"))).alias("qh"),
        cents("l_extendedprice").alias("p"),
    )
    # Sum line items once at the finest grain, then expand the grouping sets
    # over that small table: the 4x Expand of GROUPING SETS never runs on
    # line-item rows.
    fine = d.groupBy("YEAR", "MONTH", "loc", "cls").agg(
        F.sum("q").alias("q"), F.sum("qh").alias("qh"), F.sum("p").alias("p"))
    g = (fine.groupingSets([["YEAR", "MONTH", "loc", "cls"], ["YEAR", "MONTH", "loc"],
                            ["YEAR", "MONTH", "cls"], ["YEAR", "MONTH"]],
                           "YEAR", "MONTH", "loc", "cls")
          .agg((F.sum("q") / F.lit(100.0)).alias("AREA PLANTED"),
               (F.sum("qh") / F.lit(10000.0)).alias("AREA HARVESTED"),
               (F.sum("p") / F.lit(100.0)).alias("PRODUCTION"),
               F.grouping("loc").alias("g_loc"), F.grouping("cls").alias("g_cls")))
    g = g.select(
        "YEAR", "MONTH",
        F.when(F.col("g_loc") == 1, F.lit(TOTAL_LOCATION)).otherwise(F.col("loc")).alias("LOCATION_DESCRIPTION"),
        F.when(F.col("g_cls") == 1, F.lit(TOTAL_CLASS)).otherwise(F.col("cls")).alias("CLASS_DESCRIPTION"),
        "AREA PLANTED", "AREA HARVESTED", "PRODUCTION",
        (F.col("PRODUCTION") / F.col("AREA PLANTED")).alias("YIELD"),
    )
    long = g.unpivot(["YEAR", "MONTH", "LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"],
                     list(STAT_UNITS), "STATISTIC_DESCRIPTION", "VALUE")
    unit = F.lit(None).cast("string")
    for stat, u in STAT_UNITS.items():
        unit = F.when(F.col("STATISTIC_DESCRIPTION") == stat, F.lit(u)).otherwise(unit)
    return long.select(
        F.concat(F.lit("Shipments, "), F.lower("STATISTIC_DESCRIPTION"),
                 F.lit(", by nation and part type")).alias("TABLE_NAME"),
        F.lit("LINEITEM").alias("COMMODITY_DESCRIPTION"),
        "CLASS_DESCRIPTION", "YEAR", "MONTH",
        period_idx(F.col("YEAR"), F.col("MONTH")).alias("period_idx"),
        F.lit("SHIP MONTH").alias("REFERENCE_PERIOD_DESCRIPTION"),
        "LOCATION_DESCRIPTION", "STATISTIC_DESCRIPTION", "VALUE",
        unit.alias("UNIT_DESCRIPTION"),
    )


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item grain raw table: text VALUE with 'n/a' and nulls, null YEAR
    and CLASS cases, padded lower-case statistic names and unit variants."""
    j = _joined_lines(spark, sf_dir, ["l_linenumber", "l_returnflag", "l_linestatus", "l_tax"])
    ln = F.col("l_linenumber")
    stat = (F.when(F.col("l_returnflag") == "R", F.lit("YIELD"))
             .when(F.col("l_returnflag") == "A", F.lit(" yield "))
             .otherwise(F.lit("AREA PLANTED")))
    unit = (F.when(F.col("l_returnflag") == "N", F.lit("THOUSAND ACRES"))
             .when(F.col("l_linestatus") == "O", F.lit("POUNDS PER ACRE"))
             .when(F.col("l_tax") > 0.06, F.lit("CWT PER ACRE"))
             .otherwise(F.lit("pounds / acre")))
    value = (F.when(ln == 7, F.lit("n/a"))
              .when((ln == 3) & (F.col("l_discount") == 0), F.lit(None).cast("string"))
              .otherwise(F.col("l_extendedprice").cast(_DEC).cast("string")))
    year = F.when((ln == 4) & (F.col("l_quantity") > 45), F.lit(None).cast("int")) \
            .otherwise(F.year("l_shipdate").cast("int"))
    return j.select(
        F.lit("Line items, by nation and part type, 1995 to present").alias("TABLE_NAME"),
        ln.cast("int").alias("TABLE_NUMBER"),
        F.col("p_brand").alias("COMMODITY_DESCRIPTION"),
        F.when(ln == 6, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("CLASS_DESCRIPTION"),
        year.alias("YEAR"),
        F.month("l_shipdate").cast("int").alias("MONTH"),
        F.lit("SHIP MONTH").alias("REFERENCE_PERIOD_DESCRIPTION"),
        F.col("n_name").alias("LOCATION_DESCRIPTION"),
        stat.alias("STATISTIC_DESCRIPTION"),
        value.alias("VALUE"),
        unit.alias("UNIT_DESCRIPTION"),
    )
