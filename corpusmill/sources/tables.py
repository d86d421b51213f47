"""Readers and writers: Parquet tables, line queues, JSON journals and knowledge tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` dealt out by a key over as many tasks as a shuffle has, for work on each row that costs far more than the row: a small file is one split."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """(title): one per line; blank lines and lines that begin with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title <> '' AND NOT startswith(title, '#')")


def write_queue(titles: DataFrame, path: str, header: str) -> None:
    """A header comment, then one title per line, in the order of the titles."""
    spark = titles.sparkSession
    head = spark.createDataFrame([(0, f"# {header}")], "k int, value string")
    rows = head.union(titles.select(F.lit(1), F.col("title")))
    rows.orderBy("k", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that does not parse gives nulls and is dropped."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt IS NULL").drop("_corrupt")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(topic, term, value) from JSON files of the shapes {topic: {term: value}}, {term: value} and [{term, value}]; a value that is no text stays JSON.  A missing folder or a file that is no JSON gives no rows."""
    kind = "map<string,string>"
    try:
        raw = spark.read.text(path, wholetext=True).select("value")
        raw.limit(1).count()
    except AnalysisException:
        raw = spark.createDataFrame([], "value string")
    listed = raw.select(F.explode(F.from_json("value", "array<struct<term:string,value:string>>")).alias("x")).select(F.lit(None).cast("string").alias("topic"), "x.term", "x.value").filter("term IS NOT NULL")
    outer = raw.filter("startswith(trim(value), '{')").select(F.explode(F.from_json("value", kind)).alias("topic", "inner"))
    nested = outer.select("topic", F.col("inner"), F.when(F.startswith("inner", F.lit("{")), F.from_json("inner", kind)).alias("m"))
    deep = nested.filter("m IS NOT NULL").select("topic", F.explode("m").alias("term", "value"))
    flat = nested.filter("m IS NULL").select(F.lit(None).cast("string").alias("topic"), F.col("topic").alias("term"), F.col("inner").alias("value"))
    return deep.unionByName(flat).unionByName(listed)


def fetch_pages(titles: DataFrame, snapshot: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, resolved, text, status) of titles in a snapshot (title, text, disambiguation): redirects (title, target) are followed once; status is ok, redirected, disambiguation or missing."""
    to = titles.select("title").distinct().join(redirects.select("title", F.col("target").alias("_to")), "title", "left").withColumn("resolved", F.coalesce("_to", "title"))
    rows = to.join(snapshot.select(F.col("title").alias("resolved"), "text", F.coalesce("disambiguation", F.lit(False)).alias("_d"), F.lit(True).alias("_there")), "resolved", "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_d"), "disambiguation").when(F.col("_to").isNotNull(), "redirected").otherwise("ok")
    return rows.select("title", "resolved", F.when(~status.isin("missing", "disambiguation"), F.col("text")).alias("text"), status.alias("status"))


def write_lexicon(terms: DataFrame, path: str) -> None:
    """JSON lines {topic, terms: {term: target}}, one folder for each topic."""
    rows = terms.groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "target")))).alias("terms"))
    rows.write.mode("overwrite").partitionBy("topic").json(path)


def write_artefacts(rows: DataFrame, path: str, by: str) -> None:
    """Text contents, one folder for each value of `by`."""
    rows.select(by, "content").write.mode("overwrite").partitionBy(by).text(path)
