"""Databases, pages and committed batches: what the given tables look like after they went through each connector."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import credit
from marginalia.sources import connectors, io

from .bindings import N_WORDS, query


@query("s8_database_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P' AND o_custkey >= 10")
def database_scan(spark, sf_dir):
    """orders written as databases and scanned by ranges of row ids; the comparison of o_custkey is the database's."""
    connectors.register(spark)
    rows = io.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = io.shared_dir(spark, "database")
    rows.write.format("database").option("table", "orders").mode("append").save(path)
    return connectors.scan(spark, path, "orders", rows.schema, [("o_custkey", ">=", 10)]).where("o_orderstatus <> 'P'")


@query("s1_paged_scan", "SELECT conv_id, turn, role, text FROM conversations")
def paged_scan(spark, sf_dir):
    """conversations laid out as pages of ten threads, each naming the next, and read as a stream into committed batches."""
    connectors.register(spark)
    path = io.shared_dir(spark, "pages")
    threads = io.table(spark, sf_dir, "conversations")
    connectors.write_pages(threads.withColumn("page", F.floor(F.col("conv_id") / 10)), "page", path)
    stream = spark.readStream.format("pages").load(path)
    out = f"{path}-read"
    stream.select("page", "place", "item").writeStream.format("commits").option("path", out).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.format("commits").schema("page string, place int, item string").load(out)
    return rows.select(F.from_json("item", threads.schema).alias("x")).select("x.conv_id", "x.turn", "x.role", "x.text")


@query("s17_grade_sink", f"SELECT doc_id AS user_id, CASE WHEN doc_id % 2 = 0 THEN 'monday' ELSE 'tuesday' END AS batch, CASE WHEN {N_WORDS} >= 50 THEN 'complete' ELSE 'incomplete' END AS posted_grade FROM documents")
def grade_sink(spark, sf_dir):
    """Two batches of grades. The first is sent twice, the second time with other grades: what has committed stays."""
    connectors.register(spark)
    path = io.shared_dir(spark, "grades")
    grades = io.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.when(T.word_count(F.col("text")) >= 50, "complete").otherwise("incomplete").alias("posted_grade"))
    even = grades.where("user_id % 2 = 0")
    credit.submit(even, path, "monday")
    credit.submit(even.withColumn("posted_grade", F.lit("incomplete")), path, "monday")
    credit.submit(grades.where("user_id % 2 = 1"), path, "tuesday")
    return credit.submitted(spark, path, "user_id long, posted_grade string")
