"""Relational tables read as allele evidence: parts are positions, line items are reads over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbase.session import table

REF = "substr('ACGT', cast((p_partkey * 7 + p_size) % 4 as int) + 1, 1)"
ALLELE = """case when l_partkey % 5 = 0 and l_orderkey % 2 = 0 then substr('ACGT', cast((l_partkey + l_linenumber % 2) % 4 as int) + 1, 1)
 when l_partkey % 7 = 0 then substr('ACGT', cast((l_partkey + 1) % 4 as int) + 1, 1)
 when l_orderkey % 97 = 0 then substr('ACGT', cast(l_linenumber % 4 as int) + 1, 1) else ref end"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """contig, pos, ref, allele, qual, fwd, nqs, rel_pos of every line item."""
    ref = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.expr(REF).alias("ref"))
    rows = table(spark, sf, "lineitem").join(ref, F.col("l_partkey") == F.col("pos"))
    return rows.select(
        (F.col("l_suppkey") % 3).alias("contig"), "pos", "ref", F.expr(ALLELE).alias("allele"), (2 + F.col("l_quantity").cast("int") % 39).alias("qual"),
        (F.col("l_linestatus") == "O").alias("fwd"), (F.col("l_orderkey") % 3 != 0).alias("nqs"), ((F.col("l_orderkey") % 100) / 100.0).alias("rel_pos"),
    )


def read_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as intervals: contig, first, last and a weight."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("contig"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_quantity").cast("int") - 1).alias("last"),
        F.lit(1).alias("depth"), F.col("l_linenumber").alias("weight"),
    )
