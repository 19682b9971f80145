"""The area tree over the given tables: world, regions, nations, customers as municipalities."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names; a temporary one only on one machine."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed, but as files: their sizes are known. A checkpoint goes by the estimate of its plan, the product of
    all that was joined, and where step follows on step these are numbers that take minutes to multiply."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        checkpointed(spark.range(0))  # names a folder, or says why there is none
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, level, parent_id, entity_type, pop_latest, area_km2, representatives, municipal_level)."""
    key = F.col("c_custkey")
    leaves = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key).alias("id"), F.col("c_name").alias("name"), F.lit(3).alias("level"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"),
        F.col("c_mktsegment").alias("entity_type"), F.when(key % 17 != 0, F.floor(F.abs("c_acctbal"))).cast("long").alias("pop_latest"),
        F.when(key % 23 != 0, (key * 37) % 50000).cast("long").alias("hectares"), F.when(key % 11 != 0, key % 3).cast("long").alias("representatives"),
        F.lit(None).cast("int").alias("municipal_level"),
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    inner = nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(2).alias("level"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit("Nation").alias("entity_type"),
        F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") % 7).cast("long").alias("representatives"), F.when(F.col("n_nationkey") % 3 == 0, 3).alias("municipal_level"),
    ).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("level"), F.lit("w").alias("parent_id"), F.lit("Region").alias("entity_type"), F.lit(None).cast("long").alias("representatives"), F.when(F.col("r_regionkey") == 2, 2).alias("municipal_level")))
    nations = leaves.groupBy("parent_id").agg(F.sum("pop_latest").alias("pop_latest"), F.sum("hectares").alias("hectares"))
    regions = nations.join(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), F.concat(F.lit("r"), "n_regionkey").alias("r")), "parent_id").groupBy(F.col("r").alias("parent_id")).agg(F.sum("pop_latest").alias("pop_latest"), F.sum("hectares").alias("hectares"))
    world = regions.agg(F.sum("pop_latest").alias("pop_latest"), F.sum("hectares").alias("hectares"))
    sums = nations.unionByName(regions).withColumnRenamed("parent_id", "id")
    root = world.select(F.lit("w").alias("id"), F.lit("World").alias("name"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit("Country").alias("entity_type"), "pop_latest", "hectares", F.lit(None).cast("long").alias("representatives"), F.lit(3).alias("municipal_level"))
    tree = leaves.unionByName(inner.join(sums, "id", "left")).unionByName(root)
    tree = tree.withColumn("area_km2", (F.col("hectares").cast("decimal(14,0)") / 100).cast("decimal(12,2)")).drop("hectares")
    return checkpointed(tree)  # plans climb the tree and read it several times


#: The same tree for DuckDB, and its closure.
AREAS_SQL = """
leaf AS (SELECT 'c'||c_custkey AS id, c_name AS name, 3 AS level, 'n'||c_nationkey AS parent_id, c_mktsegment AS entity_type,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) END AS pop, CASE WHEN c_custkey % 23 <> 0 THEN (c_custkey*37) % 50000 END AS ha,
  CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 3 END AS seats, CAST(NULL AS INT) AS mlevel FROM customer),
nat AS (SELECT 'n'||n_nationkey AS id, n_name AS name, 2 AS level, 'r'||n_regionkey AS parent_id, 'Nation' AS entity_type,
  (SELECT CAST(sum(pop) AS BIGINT) FROM leaf WHERE leaf.parent_id = 'n'||n_nationkey) AS pop, (SELECT CAST(sum(ha) AS BIGINT) FROM leaf WHERE leaf.parent_id = 'n'||n_nationkey) AS ha,
  CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey % 7 AS BIGINT) END AS seats, CASE WHEN n_nationkey % 3 = 0 THEN 3 END AS mlevel FROM nation),
reg AS (SELECT 'r'||r_regionkey AS id, r_name AS name, 1 AS level, 'w' AS parent_id, 'Region' AS entity_type,
  (SELECT CAST(sum(pop) AS BIGINT) FROM nat WHERE nat.parent_id = 'r'||r_regionkey) AS pop, (SELECT CAST(sum(ha) AS BIGINT) FROM nat WHERE nat.parent_id = 'r'||r_regionkey) AS ha,
  CAST(NULL AS BIGINT) AS seats, CASE WHEN r_regionkey = 2 THEN 2 END AS mlevel FROM region),
area AS (SELECT *, CAST(ha / 100.0 AS DECIMAL(12,2)) AS km2 FROM (SELECT * FROM leaf UNION ALL SELECT * FROM nat UNION ALL SELECT * FROM reg UNION ALL
  SELECT 'w', 'World', 0, NULL, 'Country', (SELECT CAST(sum(pop) AS BIGINT) FROM reg), (SELECT CAST(sum(ha) AS BIGINT) FROM reg), NULL, 3)),
closure AS (SELECT id AS ancestor, id AS node, 0 AS dist FROM area UNION ALL SELECT c.ancestor, a.id, c.dist + 1 FROM closure c JOIN area a ON a.parent_id = c.node)
"""


def with_areas(sql: str) -> str:
    return f"WITH RECURSIVE {AREAS_SQL} {sql}"
