"""What several operators share: the folder all executors reach, tables written there, connected components."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; `bytes.split()` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (one machine, tests) a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """As written; then `old`, a table that `written` made and nothing else reads any more, is deleted."""
    new = written(df, name)
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in old.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return new


#: Ids that are broadcast at most: 16 MB of them.
BROADCAST_IDS = 2_000_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids as the side of a join: broadcast if there are at most `most`, so that the other side stays where it
    is; else both are shuffled."""
    return F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash")


def small(batches, rows: int = 512):
    """The Arrow batches, cut to at most `rows` rows: what a task makes of one stays small beside its text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan of one column, one row back."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that links reach.

    Alternating stars: each round hangs larger neighbours, then smaller ones, on the smallest neighbour, until the
    edges are stars. Minima are combined before the shuffle; each round's edges are a table in the shared folder.
    Loops only list their node; edges with a null end are left out.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL"), name)  # made once
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)")).alias("s")
    last = now.agg(*mark).first()
    while last["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = rewritten(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name, now)
        before, last = last, now.agg(*mark).first()
        if before == last:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    alone = loops.join(found, "node", "left_anti")
    return found.union(roots.union(alone).distinct().select("node", F.col("node").alias("component")))
