"""A trigram index kept beside the nodes, so that a lookup reads the postings of its rarest trigrams only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import similarity, trigrams
from .buckets import BucketTable


class TrigramIndex:
    """Under ``root``: postings (gram, n, id) in the order of gram and n, gram frequencies, and the names in buckets by id.

    Two texts of q and n trigrams are alike by at least t only if n lies between t q and q / t and they share at least
    t q. So one of any q - t q + 1 of the question's trigrams is shared: the rarest of them are read, by filters that
    reach the files, and only the names of these candidates are compared.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def build(self, nodes: DataFrame, column: str = "name") -> TrigramIndex:
        """Writes the index of ``nodes(id, column)``, ids unique; texts without a trigram are alike with nothing and left out."""
        named = nodes.select("id", F.col(column).alias("text")).where("id is not null and text is not null")
        grams = named.withColumn("grams", trigrams(F.col("text"))).where("size(grams) > 0")
        postings = grams.select(F.explode("grams").alias("gram"), F.size("grams").alias("n"), "id")
        # Ranges of gram and length: a frequent trigram is split over several files, and files have narrow bounds.
        postings.repartitionByRange(self.buckets, "gram", "n", "id").sortWithinPartitions("gram", "n").write.parquet(f"{self.root}/postings")
        self.spark.read.parquet(f"{self.root}/postings").groupBy("gram").agg(F.count("*").alias("m")).orderBy("gram").write.parquet(f"{self.root}/frequencies")
        BucketTable(self.spark, f"{self.root}/names", ["id"], self.buckets).upsert(grams.select("id", "text"))
        return self

    def candidates(self, term: str, least: float) -> DataFrame | None:
        """(id) of all texts that can be alike by ``least``, and some more; None where a lookup can't leave any out."""
        own = self.spark.range(1).select(trigrams(F.lit(term)).alias("g")).first().g
        q = len(own)
        if q == 0 or least <= 0:
            return None
        known = self.spark.read.parquet(f"{self.root}/frequencies").where(F.col("gram").isin(own)).collect()  # a row for each trigram of the question
        often = {r.gram: r.m for r in known}
        needed = max(1, math.ceil(least * q - 1e-9))
        rare = sorted(own, key=lambda g: (often.get(g, 0), g))[: q - needed + 1]
        low, high = math.ceil(least * q - 1e-9), math.floor(q / least + 1e-9)
        postings = self.spark.read.parquet(f"{self.root}/postings")
        return postings.where(F.col("gram").isin(rare) & F.col("n").between(low, high)).select("id").distinct()

    def find(self, term: str, least: float = 0.2) -> DataFrame:
        """(id, text, similarity) of the texts that are alike by at least ``least``."""
        names = BucketTable(self.spark, f"{self.root}/names", ["id"])
        ids = self.candidates(term, least)
        rows = names.read() if ids is None else names.find(ids)
        return rows.withColumn("similarity", similarity(F.col("text"), F.lit(term))).where(F.col("similarity") >= least)
