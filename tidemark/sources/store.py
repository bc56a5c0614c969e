"""Append-only versioned tables: every change is a new row, the latest version of a key counts.

A table is a folder of Parquet files with the table's columns plus ``version`` and
``op`` (``put`` or ``delete``).  Appends never rewrite files: each write has a folder
of its own, and becomes visible when a numbered manifest that names it is renamed
into place, which fails if that number is taken.  So a write that breaks off leaves the
table as it was, readers see whole versions only, and of two writers at once one gets
:class:`ConcurrentWriteError`.  Compaction writes a new folder and then moves the manifest on.
A table whose key is None is a log: all its rows count.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.errors import ConcurrentWriteError, DuplicateKeyError, UnknownTableError

#: Versions after which an append compacts the table.
COMPACT_AFTER = 32


class Store:
    """The tables below one folder of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- manifests: small numbered JSON files, the highest counts
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, table: str) -> dict | None:
        folder = self._path(f"{table}/_manifests")
        if not self._fs().exists(folder):
            return None
        names = sorted(f.getPath().getName() for f in self._fs().listStatus(folder) if f.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = self._fs().open(self._path(f"{table}/_manifests/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": int(names[-1].removesuffix(".json"))}

    def _known(self, table: str) -> dict:
        found = self._manifest(table)
        if found is None:
            raise UnknownTableError(table)
        return found

    def _commit(self, table: str, manifest: dict) -> None:
        """Puts the manifest that follows ``manifest['number']`` into place, unless another writer has."""
        number = manifest.get("number", 0) + 1
        body = json.dumps({k: v for k, v in manifest.items() if k != "number"})
        temp, final = self._path(f"{table}/_manifests/{uuid.uuid4().hex}.tmp"), self._path(f"{table}/_manifests/{number:010d}.json")
        out = self._fs().create(temp, True)
        out.write(bytearray(body.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temp, final, no_options)
        except Exception as failed:
            self._fs().delete(temp, False)
            if self._fs().exists(final):
                raise ConcurrentWriteError(f"{table}: version {number} was committed by another writer") from failed
            raise

    def exists(self, table: str) -> bool:
        return self._manifest(table) is not None

    def tables(self) -> list[str]:
        """The tables made so far."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = self._fs().listStatus(root) if self._fs().exists(root) else []
        return sorted(name for name in (f.getPath().getName() for f in found if f.isDirectory()) if self.exists(name))

    def create(self, table: str, schema: StructType, key: str | None = "id") -> None:
        """Makes the table unless it is there; an existing one keeps its rows."""
        if not self.exists(table):
            self._commit(table, {"key": key, "schema": schema.jsonValue(), "versions": [], "folder": 0})

    def _write(self, table: str, m: dict, rows: DataFrame, version: int, folder: int) -> list:
        place = f"f{folder}/version={version}/writer={uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.root}/{table}/{place}")
        return [version, place]

    def append(self, table: str, rows: DataFrame, op: str = "put") -> int:
        """Adds a version; gives its number."""
        m = self._known(table)
        schema = StructType.fromJson(m["schema"])
        version = max((v for v, _ in m["versions"]), default=0) + 1
        out = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
        written = self._write(table, m, out.withColumn("op", F.lit(op)), version, m["folder"])
        self._commit(table, m | {"versions": [*m["versions"], written]})
        if len(m["versions"]) + 1 >= COMPACT_AFTER and m["key"] is not None:
            self.compact(table)
        return version

    def insert(self, table: str, rows: DataFrame) -> int:
        """As append, but keys that are there, or stand twice in ``rows``, are an error."""
        key = self._known(table)["key"]
        twice = rows.groupBy(key).count().where("count > 1").limit(1).count()
        if twice or rows.join(self.read(table).select(key), key, "left_semi").limit(1).count():
            raise DuplicateKeyError(f"{table}: keys exist already")
        return self.append(table, rows)

    def delete(self, table: str, keys: DataFrame) -> int:
        return self.append(table, keys, "delete")

    def versions(self, table: str) -> DataFrame:
        """All committed versions, with ``version`` and ``op``; one scan."""
        m = self._known(table)
        schema = StructType.fromJson(m["schema"]).add("op", "string")
        if not m["versions"]:
            return self.spark.createDataFrame([], schema.add("version", "long"))
        base = f"{self.root}/{table}/f{m['folder']}"
        read = self.spark.read.schema(StructType(schema.fields).add("version", "long").add("writer", "string")).option("basePath", base)
        return read.parquet(*(f"{self.root}/{table}/{place}" for _, place in m["versions"])).drop("writer")

    def read(self, table: str, at_version: int | None = None) -> DataFrame:
        """The latest row of each key that isn't deleted, as of a version."""
        key = self._known(table)["key"]
        rows = self.versions(table)
        if at_version is not None:
            rows = rows.where(F.col("version") <= at_version)
        if key is None:
            return rows.where("op <> 'delete'").drop("op", "version")
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
        return rows.withColumn("_n", last).where("_n = 1 and op <> 'delete'").drop("_n", "op", "version")

    def compact(self, table: str) -> None:
        """Rewrites the current rows as one version in a new folder."""
        m = self._known(table)
        folder, version = m["folder"] + 1, max((v for v, _ in m["versions"]), default=0) + 1
        written = self._write(table, m, self.read(table).withColumn("op", F.lit("put")), version, folder)
        self._commit(table, m | {"folder": folder, "versions": [written]})

    def reset(self, table: str) -> None:
        m = self._known(table)
        self._commit(table, m | {"folder": m["folder"] + 1, "versions": []})

    def reset_all(self) -> None:
        """Empties every table; earlier files stay until they are removed by hand."""
        for table in self.tables():
            self.reset(table)

    def export_json(self, table: str, path: str) -> None:
        self.read(table).write.mode("overwrite").json(path)

    def export_all(self, path: str, tables: list[str] | None = None) -> DataFrame:
        """Each table as JSON below ``path``, and ``statistics``: ``tbl``, ``n_rows``."""
        counts = None
        for table in tables or self.tables():
            self.export_json(table, f"{path}/{table}")
            one = self.read(table).agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("tbl"), "n_rows")
            counts = one if counts is None else counts.unionByName(one)
        counts.coalesce(1).write.mode("overwrite").json(f"{path}/statistics")
        return self.spark.read.json(f"{path}/statistics")
