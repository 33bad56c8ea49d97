"""What the operators share: tables in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local master gets a temporary one; a cluster has none that
    all executors see, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="narrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_narrata_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `durable` made and that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_narrata_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ranges(df: DataFrame, each: int) -> int:
    """How many ranges of hashes what comes of df is dealt to, so that a range doesn't grow with the input: one for each
    `each` bytes that the optimizer expects of df, at least the number of shuffle partitions. Where it expects nothing
    (an RDD), that number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // each)) if size < 1 << 58 else least


def of_kind(df: DataFrame, kind: int) -> DataFrame:
    """The rows of an exchange's output with kind = `kind`. The condition holds a random zero, as the optimizer would push any
    other below the exchange, and each reader would then make the rows anew."""
    return df.where(F.col("kind") + F.floor(F.rand()) == kind)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 2000):
    """Yields (first row, last row + 1) so that a slice has at most `rows` rows and its texts about `limit` bytes, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if i > first and (size + n > limit or i - first >= rows):
            yield first, i
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def bipartite_groups(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bipartite graph: each row's and each column's group (a row's number), the number of rows if alone."""
    n = len(mask)
    rows = np.where(mask.any(1), np.arange(n), n)
    while True:
        columns = np.where(mask, rows[:, None], n).min(0)
        new = np.minimum(rows, np.where(mask, columns[None], n).min(1))
        if (new == rows).all():
            return rows, columns
        rows = new


def _unfinished(pairs: DataFrame) -> bool:
    """Whether (u, v), u > v, is anything but stars around their smallest nodes: a node with two ends above it, or on both sides."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(pairs.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] > 0


def star_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): (node, component) for each node that has an edge;
    component is the smallest node of its component. Alternates large and small stars until only
    stars are left, which takes rounds of the order of the logarithm of the nodes; edges that are stars take none. Each round is
    written to the shared folder and the one before it deleted; a round has one write, as small tables over many partitions cost
    more in writes than in joins. Only a count a round reaches the driver. Null ends and loops are no edges; no edges give no rows."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = durable(pairs, name)
    while _unfinished(pairs):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        two = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(two).alias("e"))
        new = durable(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        discard(pairs)
        pairs = new
    leaves = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return leaves.union(roots)
