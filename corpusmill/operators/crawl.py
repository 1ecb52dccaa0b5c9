"""Breadth-first crawl over a link table, level by level."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import files
from corpusmill.sources.tables import shared_dir


def crawl_bfs(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of all that seeds (node) reach over links (src, dst) within ``depth`` steps, at the least depth.

    Each level joins only its frontier and drops what was seen; levels are written to the shared folder, so lineage stays short.
    """
    spark, root = seeds.sparkSession, f"{shared_dir(seeds.sparkSession)}/crawl-{uuid.uuid4().hex}"
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier.write.parquet(f"{root}/level=0")
    seen = spark.read.parquet(f"{root}/level=0")
    for d in range(1, depth + 1):
        step = seen.where(F.col("depth") == d - 1).join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)).write.parquet(f"{root}/level={d}")
        level = spark.read.schema("node string, depth int").parquet(f"{root}/level={d}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


class Reach:
    """Everything that seeds reach over a link table, however deep: rounds that move the frontier alone.

    Links lie bucketed by their source and the visited set by its node, in as many buckets. A round shuffles its frontier to the links'
    buckets and what it finds to those of the visited set; neither links nor visited nodes move. Rounds are partitions of the visited table,
    and ``done.json`` names the last whole one: a run that is begun again drops what is beyond it and goes on from there.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.name = f"reach_{hashlib.md5(self.root.encode()).hexdigest()}"

    def table(self, kind: str, schema: str, parted: str = "", by: str = "") -> DataFrame:
        """A bucketed table over files that may be there already."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
        self.spark.sql(f"CREATE TABLE {self.name}_{kind} ({schema}) USING parquet {parted} CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{kind}'")
        if parted and files.names(self.spark, f"{self.root}/{kind}"):
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}_{kind}")
        return self.spark.table(f"{self.name}_{kind}")

    def done(self) -> int:
        """The last whole round, -1 before the first."""
        return json.loads(files.read_text(self.spark, f"{self.root}/done.json") or '{"round": -1}')["round"]

    def visited(self) -> DataFrame:
        return self.table("visited", "node string, depth int, round int", "PARTITIONED BY (round)", "node")

    def _put(self, nodes: DataFrame, depth: int) -> bool:
        """Writes a round; whether it has any nodes."""
        rows = nodes.select("node", F.lit(depth).alias("depth"), F.lit(depth).alias("round"))
        rows.repartition(self.buckets, "node").write.mode("append").format("parquet").partitionBy("round").bucketBy(self.buckets, "node").option("path", f"{self.root}/visited").saveAsTable(f"{self.name}_visited")
        files.put_text(self.spark, f"{self.root}/done.json", json.dumps({"round": depth}))
        return not self.spark.table(f"{self.name}_visited").where(F.col("round") == depth).isEmpty()

    def run(self, seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
        """(node, depth): seeds (node) and all they reach over links (src, dst), at the least depth; at most ``rounds`` more rounds. Nulls reach nothing, repeats and loops add nothing."""
        if not files.names(self.spark, f"{self.root}/links"):
            rows = links.where("src is not null and dst is not null").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
            rows.repartition(self.buckets, "src").write.format("parquet").bucketBy(self.buckets, "src").option("path", f"{self.root}/links").saveAsTable(f"{self.name}_links")
        edges, at = self.table("links", "src string, dst string", by="src"), self.done()
        for name in files.names(self.spark, f"{self.root}/visited"):
            if name.startswith("round=") and int(name[6:]) > at:
                files.delete(self.spark, f"{self.root}/visited/{name}")
        self.visited()
        more = True
        if at < 0:
            more, at = self._put(seeds.where("node is not null").select(F.col("node").cast("string").alias("node")).distinct(), 0), 0
        while more and (rounds is None or rounds > 0):
            seen = self.spark.table(f"{self.name}_visited")
            more, at = self._put(self.step(seen, edges, at), at + 1), at + 1
            rounds = None if rounds is None else rounds - 1
        return self.spark.table(f"{self.name}_visited").select("node", "depth")

    def step(self, seen: DataFrame, edges: DataFrame, at: int) -> DataFrame:
        """The nodes that round ``at`` leads to and that no round has seen."""
        frontier = seen.where(F.col("round") == at).select("node").repartition(self.buckets, "node")
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).repartition(self.buckets, "node").distinct()
        return found.join(seen.select("node"), "node", "left_anti")
