"""Observation tables from the general-purpose test tables.

obs: contig, frag_id, site, pos, allele, qual, weight; one row for each (contig, frag_id, site).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseframe.functions.scalars import phred_weight
from phaseframe.plans.storage import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations: supplier = site, return flag = allele, quantity = quality; the last line wins."""
    latest = Window.partitionBy("l_linestatus", "l_orderkey", "l_suppkey").orderBy(F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_shipdate"), F.desc("l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem")
    own = lines.select("l_linestatus", "l_orderkey", "l_suppkey", "l_returnflag", "l_quantity", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    rows = dealt(own, lines.count(), "l_linestatus", "l_orderkey", "l_suppkey").withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    allele = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rows.select(
        F.col("l_linestatus").alias("contig"),
        F.col("l_orderkey").alias("frag_id"),
        (F.col("l_suppkey") + 1).cast("int").alias("site"),
        (F.col("l_suppkey") * 1000).cast("long").alias("pos"),
        allele.alias("allele"),
        F.col("l_quantity").cast("int").alias("qual"),
    ).withColumn("weight", phred_weight(F.col("qual")))


def obs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user's week = fragment, hour = site, event type = allele, value = quality."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0)
    rows = read(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(4)).cast("int").alias("contig"),
        (F.col("user_id") * 10000 + F.floor((hour + 72) / 168.0)).alias("frag_id"),
        hour.alias("hour"),
        "event_type",
        F.floor(F.col("value") * 40 / 490).cast("int").alias("qual"),
        "event_id",
    )
    rows = rows.groupBy("contig", "frag_id", "hour").agg(F.max_by(F.struct("event_type", "qual"), "event_id").alias("e"))
    types = rows.select(F.col("e.event_type").alias("event_type")).distinct().agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    hours = rows.select("contig", "hour").distinct().withColumn("site", F.dense_rank().over(Window.partitionBy("contig").orderBy("hour"))).withColumn("start", F.min("hour").over(Window.partitionBy("contig")))
    joined = rows.join(hours, ["contig", "hour"]).crossJoin(types)
    return joined.select(
        "contig", "frag_id", "site", ((F.col("hour") - F.col("start")) * 60).cast("long").alias("pos"), (F.array_position("types", F.col("e.event_type")) - 1).cast("int").alias("allele"), F.col("e.qual").alias("qual")
    ).withColumn("weight", phred_weight(F.col("qual")))


def sites_of(obs: DataFrame) -> DataFrame:
    return obs.select("contig", "site", "pos").distinct()


def frags_of(obs: DataFrame) -> DataFrame:
    return obs.groupBy("contig", "frag_id").agg(
        F.min("site").alias("first_site"), F.max("site").alias("last_site"), F.min("pos").alias("first_base"), F.max("pos").alias("last_base"), F.count("*").alias("n_sites")
    )


def parts_by_remainder(obs: DataFrame, parts: int = 3) -> DataFrame:
    """obs with a part for each fragment, by its id; what relational tests use instead of phasing."""
    return obs.withColumn("part", F.pmod("frag_id", F.lit(parts)).cast("int"))


def parts_by_week(obs: DataFrame) -> DataFrame:
    """obs of events with one part for each third of the users and week."""
    return obs.withColumn("part", ((F.floor(F.col("frag_id") / 10000) % 3) * 10000 + F.col("frag_id") % 10000).cast("int"))
