"""Search over names, paths and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine, embedding, embedding_of, embedding_words, relevance, similarity, tokens
from ..graph import Graph
from ..scratch import Scratch


def by_name(nodes: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Names, paths and summaries that contain the term, most relevant first; a report of ``limit`` rows."""
    has = lambda c: F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    summary = F.col("summary") if "summary" in nodes.columns else F.lit(None).cast("string")
    found = nodes.where(has(F.col("name")) | has(F.col("file")) | has(summary))
    return found.withColumn("relevance", relevance(F.col("name"), F.col("file"), summary, term)).orderBy("relevance", "name", "id").limit(limit)


def fuzzy(nodes: DataFrame, term: str, least: float = 0.2, column: str = "name", index=None) -> DataFrame:
    """Nodes whose text is alike by trigrams; with a ``TrigramIndex`` of them only its candidates are compared."""
    if index is not None and (ids := index.candidates(term, least)) is not None:
        nodes = nodes.join(ids, "id", "left_semi")
    return nodes.withColumn("similarity", similarity(F.col(column), F.lit(term))).where(F.col("similarity") >= least)


def graded(nodes: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Grades: 100 the whole text, 80 in the name, 75 in the route, 70 in the file, 55 in the summary, else 40, for
    nodes in which any word of the text occurs; a report of ``limit`` rows."""
    words = [w for w in text.lower().split() if len(w) > 1]
    column = lambda c: F.coalesce(F.lower(F.col(c)), F.lit("")) if c in nodes.columns else F.lit("")
    fields = [column(c) for c in ("name", "file", "route_path", "summary", "full_path")]
    hit = lambda c: reduce(Column.__or__, (c.contains(w) for w in words), F.lit(False))
    any_hit = reduce(Column.__or__, map(hit, fields))
    if "tags" in nodes.columns:
        any_hit = any_hit | F.coalesce(F.exists("tags", lambda t: hit(F.lower(t))), F.lit(False))
    name, file, route, summary, _ = fields
    grade = F.when(name == text.lower(), 100).when(hit(name), 80).when(hit(route), 75).when(hit(file), 70).when(hit(summary), 55).otherwise(40)
    return nodes.where(any_hit).withColumn("grade", grade).orderBy(F.desc("grade"), "name", "id").limit(limit)


def nearest(rows: DataFrame, vector: Column, column: str = "embedding", least: float = 0.25, limit: int = 15) -> DataFrame:
    """Rows with a cosine above ``least``, the nearest ones first (to nine digits, then by the first column); a report of ``limit`` rows."""
    found = rows.withColumn("cosine", F.round(cosine(F.col(column), vector), 9))
    return found.where(F.col("cosine") > least).orderBy(F.desc("cosine"), rows.columns[0]).limit(limit)


def resolve(graph: Graph, text: str, aliases: DataFrame | None = None, workflows: DataFrame | None = None, limit: int = 25, index=None) -> DataFrame:
    """(id, score, sources) of what a question may mean: points of several searches are added, 100 at most.

    Exact name 100; alias 25; a workflow of the node's alias or one that holds it 15; name 10; file 10; route 15;
    trigrams above 0.35 the best 20, 15 each; embedding above a cosine of 0.25 the best 15, up to 20 and at least 8; steps
    from the eight best of these 20. ``aliases(id, alias)``, ``workflows(id, workflow)``. ``sources`` are the names of the
    searches that gave points. ``index``: a ``TrigramIndex`` of the names. Nodes with a null name or file are found by what they have. A report of ``limit`` rows.
    """
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "resolve")
    # A table of short rows may be one file and one split; what is computed for each node is dealt over all tasks.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes = scratch.save(graph.nodes.select(*(c for c in ("id", "name", "file", "route_path") if c in graph.nodes.columns)).repartition(tasks), "nodes")
    words = tokens(F.lit(text))
    has = lambda c: F.coalesce(F.exists(words, lambda w: F.lower(c).contains(w)), F.lit(False))
    point = lambda df, n, source: df.select("id", F.lit(n).cast("double").alias("score"), F.lit(source).alias("source"))
    parts = [point(nodes.where(F.lower("name") == text.lower()), 100, "exact"), point(nodes.where(has(F.col("name"))), 10, "node"), point(nodes.where(has(F.col("file"))), 10, "file")]
    alike = fuzzy(nodes.select("id", "name"), text.lower(), 0.35, index=index).where(F.round("similarity", 9) > 0.35)
    parts.append(point(alike.orderBy(F.desc(F.round("similarity", 9)), "id").limit(20), 15, "trigram"))
    if "route_path" in nodes.columns:
        parts.append(point(nodes.where(has(F.col("route_path"))), 15, "api"))
    if aliases is not None:
        parts.append(point(aliases.where(F.exists(words, lambda w: F.lower(F.col("alias")) == w)).select("id").distinct(), 25, "alias"))
    if workflows is not None:
        parts.append(point(workflows.where(has(F.col("workflow"))).select("id").distinct(), 15, "workflow"))
    own = nodes.select("id", embedding(embedding_words(F.concat_ws(" ", "name", "file"))).alias("embedding"))
    own = scratch.save(own, "embeddings")  # else the optimizer repeats the expression wherever the cosine uses it
    near = nearest(own, F.array(*map(F.lit, embedding_of(text))))
    points = F.greatest(F.lit(8.0), F.floor(20 * F.least(F.lit(1.0), F.col("cosine") / 0.5)).cast("double"))
    parts.append(near.select("id", points.alias("score"), F.lit("embedding").alias("source")))
    base = scratch.save(reduce(DataFrame.union, parts), "base")
    seeds = base.groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(8).select(F.col("id").alias("at"))
    grown = graph.directed("BOTH").select("at", "to").join(F.broadcast(seeds), "at", "left_semi").select(F.col("to").alias("id")).distinct()
    total = base.union(point(grown, 20, "graph")).groupBy("id").agg(F.least(F.lit(100.0), F.sum("score")).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))
    return total.join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)


def seed_aliases(nodes: DataFrame) -> DataFrame:
    """(id, alias): the words of each node's name, split at case, dots and underscores."""
    spaced = F.regexp_replace(F.col("name"), r"([a-z0-9])([A-Z])", "$1 $2")
    return nodes.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: F.length(w) > 1))).alias("alias"))
