"""Graphs on disk: snapshots with a manifest, file scans, JSON payloads, tables of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, folder_depth, language
from ..graph import RELATIONSHIPS, Graph
from ..operators.traversal import walk

MANIFEST = "snapshot_id string, parent string, version long, created_at timestamp, checksum string"


class SnapshotStore:
    """A folder for each snapshot (nodes, edges) and a manifest of appended rows; any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        path = f"{self.root}/manifest"
        return self.spark.read.schema(MANIFEST).parquet(path) if self._exists(path) else self.spark.createDataFrame([], MANIFEST)

    def create(self, snapshot_id: str, graph: Graph, parent: str | None = None) -> None:
        if self.exists(snapshot_id):
            raise ValueError(f"snapshot {snapshot_id} exists")
        graph.nodes.write.parquet(f"{self.root}/{snapshot_id}/nodes")
        graph.edges.write.partitionBy("type").parquet(f"{self.root}/{snapshot_id}/edges")
        # The checksum doesn't depend on the order of the rows.
        found = self.load(snapshot_id)
        total = found.edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst", "type").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        version = (self.manifest().agg(F.max("version")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(parent).cast("string").alias("parent"), F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("created_at"), F.sha2(F.lit(f"{total.n}:{total.h}"), 256).alias("checksum"))
        row.write.mode("append").parquet(f"{self.root}/manifest")

    def load(self, snapshot_id: str) -> Graph:
        base = f"{self.root}/{snapshot_id}"
        return Graph(self.spark.read.parquet(f"{base}/nodes"), self.spark.read.parquet(f"{base}/edges"))

    def exists(self, snapshot_id: str) -> bool:
        return self._exists(f"{self.root}/{snapshot_id}/nodes")

    def delete(self, snapshot_id: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{snapshot_id}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def list(self) -> list[str]:
        """Ids of the snapshots whose data are there, oldest first."""
        return [r.snapshot_id for r in self.manifest().orderBy("version").collect() if self.exists(r.snapshot_id)]

    def latest(self) -> str | None:
        return (self.list() or [None])[-1]

    def verify(self, snapshot_id: str) -> bool:
        edges = self.load(snapshot_id).edges
        total = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst", "type").cast("decimal(38,0)")), F.lit(0)).alias("h")).select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("h").cast("string")), 256)).first()[0]
        return self.manifest().where(F.col("snapshot_id") == snapshot_id).first().checksum == total

    def _related(self, snapshot_id: str, at: str, to: str) -> list[str]:
        steps = self.manifest().where("parent is not null").select(F.col(at).alias("at"), F.col(to).alias("to"), F.lit(0).alias("ordinal"))
        start = self.spark.createDataFrame([(snapshot_id, snapshot_id)], "source string, node string")
        return [r.node for r in walk(steps, start).where("depth > 0").orderBy("depth", "node").collect()]

    def ancestors(self, snapshot_id: str) -> list[str]:
        """Root first."""
        return self._related(snapshot_id, "snapshot_id", "parent")[::-1]

    def descendants(self, snapshot_id: str) -> list[str]:
        return self._related(snapshot_id, "parent", "snapshot_id")

    def is_ancestor(self, a: str, b: str) -> bool:
        return a in self.ancestors(b)


#: Folders that a scan leaves out.
SKIPPED = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", ".next", "target", "vendor")


#: Top folders that a scan of a large tree goes into, and how many files make a tree large.
SOURCE_FOLDERS = ("src", "app", "lib", "api", "services", "models", "server", "backend", "core", "internal", "pkg", "routes", "controllers", "handlers", "db", "database", "domain", "modules", "features", "components", "utils", "helpers", "middleware", "workers")
LARGE_TREE = 3_000


def list_folders(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED, large: int = LARGE_TREE) -> tuple[list[str], list[str]]:
    """The folders to scan below a root, itself included, and the top folders that are left out as the tree is large.

    Level by level, one listing call for all folders of a level; folders named in ``skipped`` or beginning with a dot are
    never entered. A tree with ``large`` files or more is scanned in SOURCE_FOLDERS only. Names go through the driver.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level, under, n = [(top, None)], {None: [top.toString()]}, {None: 0}
    while level:
        below = []
        for folder, branch in level:
            for status in files.listStatus(folder):
                path = status.getPath()
                if status.isDirectory():
                    name = path.getName()
                    if name in skipped or name.startswith("."):
                        continue
                    own = name if branch is None else branch
                    below.append((path, own))
                    under.setdefault(own, []).append(path.toString())
                    n.setdefault(own, 0)
                else:
                    n[branch] += 1
        level = below
    left_out = [b for b in under if b is not None and b.lower() not in SOURCE_FOLDERS] if sum(n.values()) >= large else []
    return [p for b, paths in under.items() if b not in left_out for p in paths], sorted(left_out)


def scan_files(spark: SparkSession, root: str, max_bytes: int = 500_000, skipped: tuple[str, ...] = SKIPPED, large: int = LARGE_TREE) -> DataFrame:
    """Files below a folder: path, size, extension, language, depth, line count, preview, hash; binaries have no text.

    Folders as ``list_folders`` gives them; files are listed and read by tasks, those above ``max_bytes`` are not opened.
    """
    folders, _ = list_folders(spark, root, skipped, large)
    files = spark.read.format("binaryFile").load(folders)
    kept = files.where(F.col("length") <= max_bytes)
    path = F.substring_index("path", root.rstrip("/").removeprefix("file://") + "/", -1)
    binary = F.instr(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), "\x00") > 0
    text = F.when(~binary, F.decode("content", "UTF-8"))
    lines = F.when(F.length(text) > 0, F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0)).otherwise(0)
    return kept.select(path.alias("path"), F.col("length").alias("size_bytes"), extension(path).alias("extension"), language(path).alias("language"), folder_depth(path).alias("depth"), lines.alias("line_count"), F.substring(text, 1, 500).alias("preview"), F.sha2("content", 256).alias("content_hash"))


def from_payload(symbols: DataFrame, edges: DataFrame) -> Graph:
    """``symbols(id, name, kind, ...)`` and ``edges(source_id, target_id, kind)`` to a graph; unknown kinds become USES."""
    kind = F.upper("kind")
    known = F.when(kind.isin(*RELATIONSHIPS), kind).when(kind == "CALL", "CALLS").when(kind == "IMPORT", "IMPORTS").when(kind == "INHERITANCE", "INHERITS").when(kind == "IMPLEMENTATION", "IMPLEMENTS").when(kind == "REFERENCE", "REFERENCES").otherwise("USES")
    nodes = symbols.withColumn("node_type", F.coalesce("kind", F.lit("unknown"))).drop("kind")
    return Graph(nodes, edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), known.alias("type")))


def read_json_graph(spark: SparkSession, nodes: str, edges: str) -> Graph:
    return Graph(spark.read.json(nodes), spark.read.json(edges))


def read_database(spark: SparkSession, url: str, nodes: str = "nodes", edges: str = "edges", key: str = "id", parts: int = 1, bounds: tuple[int, int] | None = None, **options) -> Graph:
    """Tables of a database by JDBC; with bounds of a numeric key, in so many parallel reads."""

    def read(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if bounds:
            reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
        return reader.load()

    return Graph(read(nodes), read(edges))
