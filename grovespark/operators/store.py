"""A persisted graph: versioned tables, their merges, and synchronisation with a source tree.

A version is a commit that names one folder per table; a change writes only the tables it touches and commits once, so
readers see a whole version or the one before. Merges are joins and aggregates over whole tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.operators import extraction, linking, relational, search
from grovespark.operators.incremental import CommitLog
from grovespark.session import cut

SCHEMAS = {
    "nodes": "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, return_type string, is_exported boolean",
    "edges": "source string, target string, kind string, line int, col int, metadata string, provenance string",
    "files": "path string, content_hash string, language string, node_count int, errors int",
    "refs": "from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string",
    "vocabulary": "segment string, name string",
}
EDGE_KEY = ["source", "target", "kind", "line", "col"]


def canonical_json(row: Column) -> Column:
    """A struct as JSON with its fields as given and nulls kept: equal rows give equal bytes."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON, over its columns in order of name."""
    return F.sha2(canonical_json(F.struct(*sorted(columns))), 256)


def changed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): 'added', 'modified' or 'removed', by content hash; both (path, content_hash). A file whose stored hash is
    null counts as modified; equal ones are left out; null paths are no files."""
    s = stored.where("path is not null").select("path", F.col("content_hash").alias("_s"), F.lit(True).alias("_in")).dropDuplicates(["path"])
    c = current.where("path is not null").select("path", F.col("content_hash").alias("_c"), F.lit(True).alias("_now")).dropDuplicates(["path"])
    state = F.when(F.col("_in").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_s").isNull() | ~F.col("_s").eqNullSafe(F.col("_c")), "modified")
    return s.join(c, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def first_wins(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both by identity: what is there already stays, of several new ones the least of the other columns."""
    cols = old.columns
    rest = [c for c in cols if c not in EDGE_KEY]
    both = old.select(*cols, F.lit(0).alias("_v")).unionByName(new.select(*cols, F.lit(1).alias("_v")))
    return both.groupBy(*EDGE_KEY).agg(F.min(F.struct("_v", *rest)).alias("_r")).select(*EDGE_KEY, *[F.col(f"_r.{c}") for c in rest]).select(*cols)


class GraphStore:
    """Tables of SCHEMAS and key-value metadata under `root`. Every method that changes something is one commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)

    def _head(self) -> dict:
        c = self.log.chain()
        return c[-1] if c else {"n": 0, "tables": {}, "metadata": {}}

    def table(self, name: str) -> DataFrame:
        at = self._head()["tables"].get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(at) if at else self.spark.createDataFrame([], SCHEMAS[name])

    def metadata(self) -> dict[str, str]:
        return dict(self._head()["metadata"])

    def version(self) -> int:
        """Number of the newest commit; 0 before the first."""
        return self._head()["n"]

    def write(self, tables: dict[str, DataFrame], metadata: dict[str, str] | None = None) -> int:
        """A new version with these tables and metadata; other tables and keys stay."""
        head = self._head()
        paths = dict(head["tables"])
        for name, df in tables.items():
            paths[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            fields = [f.split()[0] for f in SCHEMAS[name].split(", ")]
            kinds = dict(f.split() for f in SCHEMAS[name].split(", "))
            df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in fields]).write.parquet(paths[name])
        return self.log.commit(head["n"], {"tables": paths, "metadata": head["metadata"] | (metadata or {})})

    def set_metadata(self, key: str, value: str) -> int:
        return self.write({}, {key: value})

    def clear(self) -> int:
        """An empty version; the metadata go too. Folders of older versions may be removed when nobody reads them."""
        return self.log.commit(self._head()["n"], {"tables": {}, "metadata": {}})

    def upsert_nodes(self, new: DataFrame) -> int:
        """Last write wins by id; nodes without a required field are left out; the vocabulary follows the names."""
        n = cut(relational.upsert(self.table("nodes"), relational.valid_nodes(new), ["id"]))
        return self.write({"nodes": n, "vocabulary": search.vocabulary(n)})

    def insert_edges(self, new: DataFrame) -> int:
        """New edges whose ends are both nodes; what is there already stays."""
        return self.write({"edges": first_wins(self.table("edges"), relational.attached(new, self.table("nodes")))})

    def append_refs(self, new: DataFrame) -> int:
        return self.write({"refs": self.table("refs").unionByName(new.select(*self.table("refs").columns))})

    def delete_files(self, paths: DataFrame) -> int:
        """Files (path) with their nodes, and edges and references of these."""
        gone = paths.select(F.col("path").alias("file_path"))
        n = cut(relational.without(self.table("nodes"), gone, ["file_path"]))
        refs = self.table("refs").join(n.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi")
        return self.write({"nodes": n, "edges": relational.attached(self.table("edges"), n), "refs": refs, "files": relational.without(self.table("files"), paths, ["path"]), "vocabulary": search.vocabulary(n)})

    def heal_vocabulary(self) -> bool:
        """Builds the vocabulary if it is empty while there are nodes; True if it did."""
        if not self.table("vocabulary").isEmpty() or self.table("nodes").isEmpty():
            return False
        self.write({"vocabulary": search.vocabulary(self.table("nodes"))})
        return True

    def is_stale(self, extraction_version: int) -> bool:
        """True if what is stored was extracted by an older version, or by none that is known."""
        return int(self.metadata().get("extraction_version", "0")) < extraction_version

    def sync(self, current: DataFrame, extract: Callable[[DataFrame], DataFrame] = extraction.extract, extraction_version: int = 1) -> DataFrame:
        """Brings the graph to the state of a tree and gives (path, state) of what changed.

        current: (path, language, content). Only added and modified files are extracted. Nodes of modified and removed
        files go, with their edges and references; edges from other files into modified ones are linked again to the new
        symbol of the same kind and name, and are lost if there is none. Then the new references, and older ones that
        were left over, are resolved against all symbols. All of it is one commit; nothing changed, no commit.
        """
        cur = cut(current.select("path", "language", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash")))
        change = cut(changed_files(self.table("files"), cur))
        if change.isEmpty():
            return change
        dirty, gone = change.where("state <> 'removed'").select("path"), change.where("state <> 'added'").select(F.col("path").alias("file_path"))
        old_nodes, old_edges = self.table("nodes"), self.table("edges")
        kept = cut(relational.without(old_nodes, gone, ["file_path"]))
        lost_to = old_nodes.join(gone, "file_path", "left_semi").select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
        lost = old_edges.where("kind <> 'contains'").join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(lost_to, "target").select("source", "kind", "target_name", "target_kind")
        rows = cut(extract(cur.join(dirty, "path", "left_semi")))
        lang = cur.select("path", F.col("language").alias("_lang"))
        fresh = rows.where("row = 'node'").join(lang, "path").select("id", "kind", "name", "qualified_name", F.col("path").alias("file_path"), F.col("_lang").alias("language"), "start_line", "end_line", "docstring", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("return_type"), F.lit(True).alias("is_exported"))
        nodes = cut(relational.upsert(kept.select(*fresh.columns), fresh, ["id"]))
        flat = lambda df, how: df.select("source", "target", "kind", "line", F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("metadata"), F.lit(how).alias("provenance"))
        direct = flat(rows.where("row = 'edge'").withColumn("kind", F.col("edge_kind")), "extracted")
        again = flat(linking.relink(lost, fresh).withColumn("line", F.lit(None).cast("int")), "relinked")
        old_refs = self.table("refs").join(kept.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi")
        new_refs = rows.where("row = 'ref'").join(lang, "path").select(F.col("source").alias("from_node_id"), F.col("name").alias("reference_name"), F.col("edge_kind").alias("reference_kind"), "line", F.lit(None).cast("int").alias("col"), F.col("path").alias("file_path"), F.col("_lang").alias("language"))
        refs = cut(old_refs.select(*new_refs.columns).unionByName(new_refs).distinct())
        base = first_wins(relational.attached(old_edges, kept), direct.unionByName(again).select(*old_edges.columns))
        solved = cut(linking.resolve(refs, nodes, base))
        linked = linking.to_edges(solved, nodes).withColumn("metadata", F.lit(None).cast("string")).select(*old_edges.columns)
        edges = relational.attached(first_wins(base, linked), nodes)
        left = refs.join(solved.select(*refs.columns[:3]).distinct(), refs.columns[:3], "left_anti")
        counts = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("node_count"))
        bad = rows.where("row = 'error'").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("errors"))
        before = self.table("files").select("path", F.col("errors").alias("_before"))
        f = cur.select("path", "content_hash", "language").join(counts, "path", "left").join(bad, "path", "left").join(before, "path", "left").join(dirty.withColumn("_d", F.lit(True)), "path", "left")
        f = f.select("path", "content_hash", "language", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("errors", F.when(F.col("_d").isNull(), F.col("_before")), F.lit(0)).alias("errors"))
        state = "partial" if not f.where("node_count = 0").isEmpty() else "complete"
        self.write({"nodes": nodes, "edges": edges, "refs": left, "files": f, "vocabulary": search.vocabulary(nodes)}, {"state": state, "extraction_version": str(extraction_version)})
        return change


def write_documents(df: DataFrame, key: str, folder: str) -> None:
    """One folder of JSON lines per value of a key, for readers that want a part; rows in no order."""
    df.write.partitionBy(key).option("ignoreNullFields", "false").json(folder)


def stable_json(value: object) -> str:
    """A driver-side document as JSON with sorted keys, byte for byte the same for equal values."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False)


def borrowed_index(own_root: str | None, index_root: str, index_is_root: bool = True, own_repository: str | None = None, index_repository: str | None = None) -> bool:
    """True if a graph belongs to another working tree of the same repository: roots differ, the index lies at the root of a
    tree itself, and both are not known to be different repositories."""
    if not own_root or own_root == index_root or not index_is_root:
        return False
    return not (own_repository and index_repository and own_repository != index_repository)
