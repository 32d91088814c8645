"""The given tables, and the scholarly records derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as X


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` when the files give fewer tasks than there are cores.

    A table of many files or row groups is read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Corpus:
    """Lazy views of one data folder. Nothing is read before an action needs it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # -- texts --------------------------------------------------------------------------

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id").withColumnRenamed("doc_id", "document_id")

    @cached_property
    def chunks(self) -> DataFrame:
        """One chunk per document, with its filterable metadata."""
        return self.documents.select(
            F.col("document_id").alias("chunk_id"), "text", "lang", "source",
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels").withColumnRenamed("doc_id", "document_id")

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def questions(self) -> DataFrame:
        """Every user turn as a question of its own."""
        return self.turns.filter("role = 'user'").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
        )

    # -- vectors ------------------------------------------------------------------------

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")

    @cached_property
    def centroids(self) -> DataFrame:
        """One query vector per label: the mean of its members. 64 partial means per label."""
        means = (
            self.vectors.select("label", F.posexplode("vector").alias("pos", "x"))
            .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        )
        packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
        return packed.select(F.col("label").cast("long").alias("query_id"), F.col("xs.x").alias("vector"))

    # -- papers -------------------------------------------------------------------------

    @cached_property
    def papers(self) -> DataFrame:
        orders = self.table("orders")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        date = F.to_date("o_orderdate")
        return orders.join(customers, orders.o_custkey == customers.c_custkey, "left").select(
            F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("owner_id"),
            F.concat(F.lit("Study "), (F.col("o_custkey") % 97).cast("string"), F.lit(" of "), F.lower("o_orderstatus")).alias("title"),
            F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("status"),
            date.alias("published"), F.year(date).alias("year"),
            F.floor(F.col("o_totalprice") / 1000).alias("citation_count"),
            F.col("c_nationkey").alias("venue_id"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """Line items with the part they name."""
        part = self.table("part").select("p_partkey", "p_type", "p_brand")
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        return items.join(part, items.l_partkey == part.p_partkey)

    @cached_property
    def paper_authors(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).distinct()

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))

    @cached_property
    def paper_topics(self) -> DataFrame:
        return self.links.select(F.col("l_orderkey").alias("paper_id"), F.col("p_type").alias("topic")).distinct()

    @cached_property
    def paper_methods(self) -> DataFrame:
        return self.links.select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("method")).distinct()

    @cached_property
    def citations(self) -> DataFrame:
        """Two references per order, to earlier keys; self and missing targets dropped."""
        key = F.col("o_orderkey")
        pairs = self.table("orders").select(
            key.alias("src"), F.explode(F.array(F.floor(key / 2), key - 1 - key % 13)).alias("dst")
        )
        known = self.table("orders").select(key.alias("dst"))
        return pairs.filter("dst >= 0 AND dst <> src").distinct().join(known, "dst", "left_semi").select("src", "dst")

    @cached_property
    def records(self) -> DataFrame:
        return self.records_of(spread(self.table("orders"), "o_orderkey"))

    def records_of(self, orders: DataFrame) -> DataFrame:
        """Two provider feeds describing the same orders under differently written ids."""
        k = F.col("o_orderkey")
        key = k.cast("string")
        both = orders.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("feed"))
        first = F.col("feed") == 0
        number = F.lpad((k % 100000).cast("string"), 5, "0")
        return both.select(
            (k * 2 + F.col("feed")).alias("arrival"),
            F.when(first, "openalex").otherwise("crossref").alias("provider"),
            F.when(first, F.concat(F.lit("https://openalex.org/w"), key)).otherwise(F.concat(F.lit("cr-"), key)).alias("provider_id"),
            F.when(k % 4 == 3, None)
            .when(first & (k % 4 == 0), F.concat(F.lit(" https://doi.org/10.1000/ORD."), key, F.lit(". ")))
            .when(first & (k % 4 == 1), F.concat(F.lit("doi:10.1000/Ord."), key))
            .when(first, F.concat(F.lit("http://dx.doi.org/10.1000/ord."), key, F.lit(",")))
            .otherwise(F.concat(F.lit("10.1000/ORD."), key)).alias("doi"),
            F.when(k % 3 == 0, F.concat(
                F.when(first, "arXiv:").otherwise("https://arxiv.org/abs/"), F.lit("2101."), number,
                F.when(first, "v2").otherwise("?x=1"))).alias("arxiv_id"),
            F.when(k % 5 == 0, F.concat(F.when(first, "pmid:").otherwise("https://pubmed.ncbi.nlm.nih.gov/"), key,
                                        F.when(k % 10 == 0, "/").otherwise(""))).alias("pmid"),
            F.when(k % 50 == 49, "  ").otherwise(
                F.concat(F.lit("  Study  "), (F.col("o_custkey") % 97).cast("string"), F.when(first, " of ").otherwise("\tOF "),
                         F.lower("o_orderstatus"), F.lit(" "))).alias("title"),
            F.when(k % 7 == 0, None).otherwise(F.concat(F.lit("Priority\n"), "o_orderpriority")).alias("abstract"),
            F.concat(F.lit("c. "), F.year("o_orderdate").cast("string"), F.when(first, "").otherwise("-01-01")).alias("published"),
            F.when(first, F.concat(F.lit("Customer  "), F.col("o_custkey").cast("string"), F.lit("; Clerk "), (k % 11).cast("string"), F.lit(" ,Customer "), F.col("o_custkey").cast("string")))
            .otherwise(F.concat(F.lit("Clerk "), (k % 11).cast("string"))).alias("authors"),
            F.when(first, F.col("o_orderpriority")).alias("venue"),
            F.when(first, None).otherwise(F.col("o_orderpriority")).alias("journal"),
            F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("https://example.org/"), key, F.when(first, ".pdf").otherwise(""))).alias("pdf_url"),
            F.concat(F.lit(" https://example.org/view/"), key, F.lit(" ")).alias("url"),
            F.concat(F.col("o_orderstatus"), F.lit(";"), F.lower("o_orderstatus"), F.lit("; "), F.lower("o_orderpriority"), F.lit(";;"), F.col("o_orderpriority")).alias("keywords"),
        )

    # -- events -------------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
            "failed", F.col("event_type") == "error").withColumn("component", F.col("user_id") % 10)
