"""The index on storage: immutable snapshots of the fact tables.

A write makes new versions of tables, a folder each, and then one manifest that names the version of every table; the last manifest is current. So a write of several tables
shows as a whole or not at all, readers keep theirs, and a failed write leaves the current one as it was. An update writes only through joins on paths, so it works on any
file system that Spark writes to and that renames a file in one step. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass import schema

TABLES = {"files": schema.FILES, "exports": schema.EXPORTS, "members": schema.MEMBERS, "edges": schema.EDGES, "packages": schema.PACKAGES, "meta": schema.META, "ids": "path string, file_id long"}
OWNER = {"files": "path", "exports": "file_path", "members": "file_path"}
FINGERPRINT = ("source_mtime", "source_size", "content_hash", "parser_cache_version")


def dense_ids(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, file_id): the rank of each path from 0. With `known` ids, these stay and new paths follow after the largest.

    Ranks come from a range partitioning: each task numbers its own rows, and starts after the sum of the partitions before.
    """
    from lodeglass.storage import materialize

    fresh = paths.select("path").distinct()
    start = 0
    if known is not None:
        fresh = fresh.join(known, "path", "left_anti")
        start = (known.agg(F.max("file_id")).first()[0] or -1) + 1 if not known.isEmpty() else 0
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(fresh.repartitionByRange(n, "path").withColumn("part", F.spark_partition_id()), "ids")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, at = {}, start
    for part in sorted(counts):
        offsets[part], at = at, at + counts[part]
    base = F.create_map(*[F.lit(x) for k, v in offsets.items() for x in (k, v)]) if offsets else F.create_map().cast("map<int,int>")
    row = F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
    out = ranged.select("path", (F.try_element_at(base, F.col("part")) + row).cast("long").alias("file_id"))
    return out if known is None else known.join(paths.select("path").distinct(), "path", "left_semi").select("path", "file_id").union(out)


class IndexStore:
    """An index below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.root}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("manifest") if n.startswith("m="))

    def _versions(self, manifest: int | None = None) -> dict[str, str]:
        """The version of each table, by the current manifest or the one given."""
        known = [manifest] if manifest is not None else self._manifests()[-1:]
        if not known:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifest/m={known[0]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return "files" in self._versions()

    def load(self, table: str) -> DataFrame:
        """The current snapshot; an empty table before the first write. An index of another schema version is refused."""
        if table not in TABLES:
            raise KeyError(table)
        if table != "meta" and self.meta().get("schema_version", str(schema.SCHEMA_VERSION)) != str(schema.SCHEMA_VERSION):
            raise RuntimeError("the index has another schema version; build it again")
        version = self._versions().get(table)
        return self._read(table, version) if version else self.spark.createDataFrame([], TABLES[table])

    def _read(self, table: str, version: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/v={version}")

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.load(t) for t in TABLES}

    def _stage(self, table: str, df: DataFrame, staged: dict[str, str]) -> DataFrame:
        """Writes a new version that no manifest names yet."""
        staged[table] = uuid.uuid4().hex
        columns = [c.split(" ")[0] for c in _split(TABLES[table])]
        df.select(*columns).write.parquet(f"{self.root}/{table}/v={staged[table]}")
        return self._read(table, staged[table])

    def _commit(self, staged: dict[str, str], keep: int = 2) -> None:
        """Makes staged versions current, all at once, and deletes versions that none of the last `keep` manifests names."""
        known = self._manifests()
        number = known[-1] + 1 if known else 0
        draft, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/m={number}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps({**self._versions(), **staged}).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError("another writer has changed the index")
        known.append(number)
        for old in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/m={old}"), False)
        named = [self._versions(m) for m in known[-keep:]]
        for table in TABLES:
            for n in self._names(table):
                if n.startswith("v=") and n[2:] not in {v.get(table) for v in named}:
                    self._fs.delete(self._path(f"{self.root}/{table}/{n}"), True)

    def _write(self, table: str, df: DataFrame) -> None:
        staged: dict[str, str] = {}
        self._stage(table, df, staged)
        self._commit(staged)

    def write_full(self, files: DataFrame, exports: DataFrame, members: DataFrame, edges: DataFrame | None = None, packages: DataFrame | None = None) -> None:
        """Everything anew: ids by path, one row per key (the last by lines), rows with impossible kinds or visibilities refused."""
        self._check(exports)
        self._check(members)
        staged: dict[str, str] = {}
        files = self._stage("files", files, staged)
        self._stage("exports", unique(exports, "name"), staged)
        self._stage("members", unique(members, "dotted_name"), staged)
        self._stage("ids", dense_ids(files), staged)
        packages = self._stage("packages", packages, staged) if packages is not None else self.load("packages")
        self._stage("edges", edges if edges is not None else self._edges(files, packages), staged)
        self._commit(staged)

    def upsert(self, files: DataFrame, exports: DataFrame, members: DataFrame) -> None:
        """Replaces the rows of the given files; known ids stay."""
        self._check(exports)
        self._check(members)
        paths, staged = files.select("path").distinct(), {}
        for table, new, key in (("files", files, None), ("exports", exports, "name"), ("members", members, "dotted_name")):
            owner = OWNER[table]
            rest = self.load(table).join(paths.select(F.col("path").alias(owner)), owner, "left_anti")
            written = self._stage(table, rest.unionByName(unique(new, key) if key else new, allowMissingColumns=True), staged)
            if table == "files":
                self._stage("ids", dense_ids(written, self.load("ids")), staged)
        self._commit(staged)

    def delete(self, paths: DataFrame) -> None:
        """Drops files with their symbols and ids. Edges stay until they are rebuilt."""
        staged: dict[str, str] = {}
        for table, owner in (*OWNER.items(), ("ids", "path")):
            self._stage(table, self.load(table).join(paths.select(F.col("path").alias(owner)).distinct(), owner, "left_anti"), staged)
        self._commit(staged)

    def refresh_fingerprints(self, prints: DataFrame) -> None:
        """Sets the fingerprint columns of known files, nothing else."""
        new = prints.select("path", *[F.col(c).alias(f"_{c}") for c in FINGERPRINT])
        joined = self.load("files").join(new, "path", "left")
        self._write("files", joined.select("path", *[(F.when(F.col("_content_hash").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in FINGERPRINT else F.col(c)) for c in [x.split(" ")[0] for x in _split(schema.FILES)] if c != "path"]))

    def fingerprints(self) -> DataFrame:
        """Stored fingerprints; files with a missing part of theirs are left out."""
        return self.load("files").select("path", *FINGERPRINT).na.drop()

    def rebuild_ids(self) -> None:
        self._write("ids", dense_ids(self.load("files")))

    def rebuild_edges(self) -> None:
        """From all files, not only changed ones."""
        self._write("edges", self._edges(self.load("files"), self.load("packages")))

    @staticmethod
    def _edges(files: DataFrame, packages: DataFrame) -> DataFrame:
        from lodeglass.operators.resolve import build_edges

        return build_edges(files, packages)

    def write_meta(self, values: dict[str, str | None]) -> None:
        rows = [(k, v) for k, v in {**self.meta(), "schema_version": str(schema.SCHEMA_VERSION), **values}.items() if v is not None]
        self._write("meta", self.spark.createDataFrame(rows, schema.META))

    def meta(self) -> dict[str, str]:
        """All entries; there are as many as names were ever written."""
        return {r["key"]: r["value"] for r in self.load("meta").collect()}

    def clear(self, drop: bool = False) -> None:
        """Empties the tables, or deletes the folder."""
        if drop:
            self._fs.delete(self._path(self.root), True)
            return
        staged: dict[str, str] = {}
        for table, ddl in TABLES.items():
            self._stage(table, self.spark.createDataFrame([], ddl), staged)
        self._commit(staged)

    @staticmethod
    def _check(symbols: DataFrame) -> None:
        wrong = symbols.where(~schema.valid_symbol(F.col("kind"), F.col("visibility"))).limit(1).collect()
        if wrong:
            raise ValueError(f"kind or visibility out of range: {wrong[0]}")


class MemoryStore:
    """The same tables as views of one session, for tests and short-lived use. Loading an empty store is an error; edges and meta are not kept."""

    def __init__(self):
        self._tables: dict[str, DataFrame] = {}

    def write_full(self, files: DataFrame, exports: DataFrame, members: DataFrame, **_) -> None:
        self._tables = {"files": files, "exports": unique(exports, "name"), "members": unique(members, "dotted_name")}

    def load(self, table: str) -> DataFrame:
        if not self._tables:
            raise RuntimeError("the store is empty")
        return self._tables[table]

    def rebuild_edges(self) -> None:
        pass

    def write_meta(self, values: dict[str, str | None]) -> None:
        pass


def unique(symbols: DataFrame, name: str) -> DataFrame:
    """One row per (name, file): exports keep the last by lines, members the first."""
    rest = [c for c in symbols.columns if c not in (name, "file_path")]
    pick = F.max_by if name == "name" else F.min_by
    at = F.struct(F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)))
    return symbols.groupBy(name, "file_path").agg(pick(F.struct(*rest), at).alias("_r")).select(name, "file_path", "_r.*")


def _split(ddl: str) -> list[str]:
    """Fields of a DDL text, at its top-level commas."""
    out, depth, run = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(run.strip())
            run = ""
        else:
            run += c
    return [*out, run.strip()]
