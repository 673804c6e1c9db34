"""ST1 to ST5: allele counts over a stream of evidence, finalized by position.

Reads come in order of their start, from one micro-batch to the next. A site is
final once a later read of its contig starts beyond it, so the watermark is a
position per contig, not a time. A micro-batch is aggregated by site, joined
with the sites still open by one more aggregation, and parted by its contig's
watermark: what is final is appended, the rest is the next state. No key holds
its rows together, so a hot contig spreads over its sites. State and output lie
in a folder per micro-batch, which one that runs again writes anew, so results
stay exact. Results equal those of batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftbase.functions import scalars as S
from siftbase.session import cut

#: A read start that finalizes every open site of its contig.
FLUSH = 2**31 - 1
SITE = ["contig", "pos", "allele"]
SITES = "contig string, pos long, allele string, n long, qsum long, fwd long, miss double"
MARKS = "contig string, mark long"


def _counts(sites: DataFrame) -> DataFrame:
    """Sites put together; counts are summed, chances of being wrong multiplied."""
    return sites.groupBy(*SITE).agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "qsum", "fwd")], F.product("miss").alias("miss"))


def _drop(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def stream_alleles(evidence: DataFrame, folder: str) -> StreamingQuery:
    """Starts the query that appends allele counts to ``folder`` as their sites become final; ``final_alleles`` reads them.

    ``evidence`` is a stream of contig, read_start, pos, allele, qual, nqs,
    rel_pos, fwd. A read that starts before its contig's watermark fails the query
    instead of giving its site a second row. A row with read_start ``FLUSH``
    finalizes its contig. The query ends when all that is there has been read;
    started again with more input it goes on with the state it left.
    """
    number = lambda c: F.col(c).cast("long").alias(c)
    rows = evidence.select("contig", number("read_start"), number("pos"), "allele", number("qual"), "fwd", (1.0 - S.snp_logit(F.col("qual"), F.col("nqs"), F.col("rel_pos"))).alias("miss"))

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/state/{k - 1}"
        sites = spark.read.schema(SITES).parquet(f"{before}/sites") if k else spark.createDataFrame([], SITES)
        marks = spark.read.schema(MARKS).parquet(f"{before}/marks") if k else spark.createDataFrame([], MARKS)
        reads = batch.where(F.col("read_start") < FLUSH).select(*SITE, F.lit(1).alias("n"), F.col("qual").alias("qsum"), F.col("fwd").cast("long").alias("fwd"), "miss")
        new = cut(batch.groupBy("contig").agg(F.max("read_start").alias("mark"), F.min("read_start").alias("low")))
        late = new.join(marks.withColumnRenamed("mark", "was"), "contig").where("low < was").first()
        if late:
            raise ValueError(f"{late['contig']}: a read that starts at {late['low']} comes after sites before {late['was']} were finalized")
        marks = marks.unionByName(new.select("contig", "mark")).groupBy("contig").agg(F.max("mark").alias("mark"))
        marks = cut(marks)
        parted = cut(_counts(sites.unionByName(_counts(reads))).join(marks, "contig"))
        parted.where("pos < mark").drop("mark").write.mode("overwrite").parquet(f"{folder}/final/batch={k}")
        parted.where("pos >= mark").drop("mark").write.mode("overwrite").parquet(f"{folder}/state/{k}/sites")
        marks.write.mode("overwrite").parquet(f"{folder}/state/{k}/marks")
        if k > 1:
            _drop(spark, f"{folder}/state/{k - 2}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def final_alleles(spark: SparkSession, folder: str) -> DataFrame:
    """What a stream has finalized: contig, pos, allele, n, qsum, fwd, p_any."""
    rows = spark.read.schema(f"{SITES}, batch long").parquet(f"{folder}/final")
    return rows.select(*SITE, "n", "qsum", "fwd", (1.0 - F.col("miss")).alias("p_any"))


def open_sites(spark: SparkSession, folder: str) -> DataFrame:
    """ST4: the sites that are still open; none after a flush of every contig."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    last = max(int(s.getPath().getName()) for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path))
    return spark.read.schema(SITES).parquet(f"{folder}/state/{last}/sites")
