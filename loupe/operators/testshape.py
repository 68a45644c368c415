"""Test structure: scores of examples, pressure of files, and what to do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions import scores
from loupe.operators import graph, similarity
from loupe.operators.tables import cut

#: Similarity of related and of table-like examples, lines of a table case, nodes of shared scaffolding.
RELATED, ALIKE, CASE_LINES, SCAFFOLD_NODES, MOST_ADVICE = 0.7, 0.85, 12, 40, 10


def scored(examples: DataFrame) -> DataFrame:
    """examples (file, name, lines, decisions, mocks, assertions) with score and smells."""
    of = [F.col(c) for c in ("lines", "decisions", "mocks", "assertions")]
    return examples.withColumn("score", scores.example_score(*of)).withColumn("smells", scores.smells(*of))


def cluster_weight(kind: Column, similarity: Column) -> Column:
    return F.when(kind == "table", 0.5).when(similarity >= ALIKE, 2.0).otherwise(0.0)


def classify(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters (file, root, similarity) with their kind from members (file, root, lines, decisions, is_table, nodes): table, duplication, or dropped."""
    sums = members.groupBy("file", "root").agg(F.count("*").alias("size"), F.bool_and((F.col("lines") <= CASE_LINES) & (F.col("decisions") == 0) & ~F.col("is_table")).alias("plain"), F.sum("nodes").alias("nodes"))
    kind = F.when(F.col("plain") & (F.col("size") >= 3) & (F.col("similarity") >= ALIKE), "table").when(F.floor(F.col("nodes") / F.col("size")) >= SCAFFOLD_NODES, "duplication")
    return clusters.join(sums, ["file", "root"]).withColumn("kind", kind).where("kind IS NOT NULL").drop("plain", "nodes")


def clusters(sets: DataFrame) -> DataFrame:
    """Clusters (file, root, similarity, size, kind) of examples (id, part, tokens, file, lines, decisions, is_table, nodes): connected by pairs that are similar enough, kept if they are a table or repeat scaffolding."""
    pairs = cut(similarity.similar_pairs(sets, RELATED))
    found = similarity.cluster(pairs, sets)
    members = cut(graph.components(pairs.select("a", "b"))).join(sets.withColumnRenamed("id", "node"), "node")
    return classify(members.select("file", "root").distinct().join(found.drop("size"), "root"), members)


def file_reports(details: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a file from scored examples (file, group, score, mocks, assertions) and clusters (file, kind, similarity, size)."""
    hot = (F.col("score") >= scores.HOT_SCORE) | (F.col("assertions") == 0)
    sums = details.groupBy("file").agg(
        F.count("*").alias("examples"), scores.rounded(F.avg("score")).alias("average_score"), F.max("score").alias("max_score"), F.sum(F.col("score") - 1).alias("own"),
        F.count_if(hot).alias("hot"), F.count_distinct(F.when(hot, F.col("group"))).alias("hot_groups"), F.count_if(F.col("mocks") >= scores.MOCK_HEAVY).alias("mocked"),
    )
    weight = cluster_weight(F.col("kind"), F.col("similarity"))
    shared = clusters.groupBy("file").agg(F.sum(weight * (F.col("size") - 1)).alias("shared"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if((F.col("kind") != "table") & (weight > 0)).alias("duplications"))
    both = sums.join(shared, "file", "left").fillna({"shared": 0.0, "tables": 0, "duplications": 0})
    act = scores.action(*(F.col(c) for c in ("examples", "hot", "hot_groups", "mocked", "tables", "duplications")))
    return both.select("file", "examples", "average_score", "max_score", scores.rounded(F.col("own") + F.col("shared")).alias("pressure"), act.alias("action"))


def recommendations(details: DataFrame, most: int = MOST_ADVICE) -> DataFrame:
    """(file, nth, confidence, name, advice): one for each smell, surest first and then in order, at most `most` a file."""
    level = {"no-assertions": (0, "HIGH"), "large": (0, "HIGH"), "logic": (1, "MEDIUM"), "mock-heavy": (1, "MEDIUM"), "assertion-heavy": (1, "MEDIUM")}
    rank = F.create_map(*(F.lit(x) for k, (r, _) in level.items() for x in (k, r)))
    name = F.create_map(*(F.lit(x) for k, (_, n) in level.items() for x in (k, n)))
    rows = details.select("file", "ord", "name", F.posexplode("smells").alias("at", "advice")).withColumn("rank", rank[F.col("advice")]).withColumn("confidence", name[F.col("advice")])
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("rank", "ord", "at")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("file", "nth", "confidence", "name", "advice")
