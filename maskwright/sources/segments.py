"""A keyed table as a log of segments: rows are added and deleted without rewriting it, and each change is a new version.

A change writes Parquet files of its own - a segment of rows, or of deleted keys - and then a manifest that lists the segments of the new version.
The manifest is written aside and renamed to ``<version>.json``, which fails if that version exists: of two writers one is first, and the other goes on from the new
version.  Readers open the latest manifest and see that version until they ask again, whatever is added, deleted or compacted meanwhile; files that no
kept version names are removed by ``vacuum`` alone.

Each segment has the number of the version that brought it.  A deletion counts for segments of smaller numbers; adding a key that is there
replaces its row.  ``compact`` writes the rows that are left into one segment with the number of the version it read, so that what was added or deleted meanwhile
still counts after it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROADCAST_KEYS = 1_000_000  #: deleted keys that may be broadcast; beyond, the join shuffles
RETRIES = 50  #: times that a writer starts again because another one was first


class _Files:
    """Small files in the store's own file system, through Spark's Hadoop client."""

    def __init__(self, spark: SparkSession, root: str):
        self.fs_of, self.jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.fs_of.Path(root).getFileSystem(conf)
        self.context = self.fs_of.FileContext.getFileContext(self.fs.getUri(), conf)
        self.once = spark._sc._gateway.new_array(getattr(self.fs_of, "Options$Rename"), 0)

    def names(self, folder: str) -> list[str]:
        path = self.fs_of.Path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.fs_of.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Whether the file is new and now there, whole; false if there was one."""
        aside = self.fs_of.Path(f"{path}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(aside, self.fs_of.Path(path), self.once)
            return True
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.fs_of.Path(path), True)


class SegmentStore:
    """Rows with a distinct ``key``.  ``arrange`` (a function of a DataFrame) lays out the rows of a segment before they are written."""

    def __init__(self, spark: SparkSession, path: str, key: str, arrange=None):
        self.spark, self.path, self.key, self.arrange, self.files = spark, path.rstrip("/"), key, arrange or (lambda df: df), _Files(spark, path)

    # -------------------------------------------------------- versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest; an empty one before the first."""
        there = self.versions()
        if version is None and not there:
            return {"version": 0, "schema": None, "segments": [], "deletes": []}
        if version is not None and version not in there:
            raise ValueError(f"there is no version {version}")
        return json.loads(self.files.read(f"{self.path}/manifests/{there[-1] if version is None else version}.json"))

    def _commit(self, change) -> int:
        """Make ``change`` (manifest -> manifest, or None to give up) the next version; the version, or that of the manifest where it gave up."""
        for _ in range(RETRIES):
            base = self.manifest()
            new = change(json.loads(json.dumps(base)))
            if new is None:
                return base["version"]
            new["version"] = base["version"] + 1
            if self.files.write_new(f"{self.path}/manifests/{new['version']}.json", json.dumps(new)):
                return new["version"]
        raise RuntimeError("other writers were first each time")

    # -------------------------------------------------------- changes

    def _written(self, df: DataFrame, kind: str) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{kind}/{name}")
        return {"name": name, "rows": self.spark.read.schema(df.schema).parquet(f"{self.path}/{kind}/{name}").count()}

    def _segment(self, rows: DataFrame) -> tuple[dict, dict, str]:
        """A written segment (of repeated keys the least row), its keys as deletions, and its schema."""
        if rows.filter(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"{self.key} is null")
        others = [c for c in rows.columns if c != self.key]
        once = rows.groupBy(self.key).agg(F.min(F.struct(*others)).alias("__r")).select(*[F.col(self.key) if c == self.key else F.col("__r")[c].alias(c) for c in rows.columns])
        segment = self._written(self.arrange(once), "rows")
        keys = self.spark.read.parquet(f"{self.path}/rows/{segment['name']}").select(self.key)
        return segment, self._written(keys, "deletes"), rows.schema.json()

    def build(self, rows: DataFrame) -> int:
        """The store's rows are these, whatever it held."""
        segment, _, schema = self._segment(rows)
        return self._commit(lambda m: m | {"schema": schema, "segments": [segment | {"number": m["version"] + 1}], "deletes": []})

    def add(self, rows: DataFrame) -> int:
        """These rows too; they replace those of equal keys."""
        known = self.manifest()["schema"]
        if known:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromJson(json.loads(known)).fields])
        segment, keys, schema = self._segment(rows)

        def change(m: dict) -> dict:
            number = m["version"] + 1
            gone = [keys | {"number": number}] if m["segments"] else []
            return m | {"schema": m["schema"] or schema, "segments": [*m["segments"], segment | {"number": number}], "deletes": [*m["deletes"], *gone]}

        return self._commit(change)

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of these keys; keys that are not there are passed over."""
        gone = self._written(keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct(), "deletes")
        return self._commit(lambda m: m | {"deletes": [*m["deletes"], gone | {"number": m["version"] + 1}]})

    def compact(self) -> int:
        """One segment of all rows, without deletions.  Rows and deletions that come meanwhile are kept; a ``build`` meanwhile makes it give up."""
        base = self.manifest()
        if not base["segments"]:
            return base["version"]
        segment = self._written(self.arrange(self.load(base["version"])), "rows")
        old, until = {s["name"] for s in base["segments"]}, base["version"]

        def change(m: dict) -> dict | None:
            if not old <= {s["name"] for s in m["segments"]}:
                return None
            later = lambda xs: [x for x in xs if x["number"] > until]
            return m | {"segments": [segment | {"number": until}, *later(m["segments"])], "deletes": later(m["deletes"])}

        return self._commit(change)

    def vacuum(self, keep: int = 1) -> int:
        """Remove the manifests but the last ``keep`` and the files that no kept one names; how many files and folders went.

        A reader of an older version loses its files, and so does a writer that has not committed: run it when neither is about."""
        if keep < 1:
            raise ValueError("one version has to stay")
        versions = self.versions()
        named = {x["name"] for m in map(self.manifest, versions[-keep:]) for x in m["segments"] + m["deletes"]}
        gone = [f"manifests/{v}.json" for v in versions[:-keep]]
        gone += [f"{kind}/{n}" for kind in ("rows", "deletes") for n in self.files.names(f"{self.path}/{kind}") if n not in named]
        for x in gone:
            self.files.delete(f"{self.path}/{x}")
        return len(gone)

    # -------------------------------------------------------- reading

    def _numbered(self, some: list[dict], kind: str, schema: StructType) -> DataFrame:
        """All rows of some segments, with ``__number``: one scan, the numbers joined by the folder's name (a row for each segment)."""
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{s['name']}" for s in some])
        numbers = self.spark.createDataFrame([(s["name"], s["number"]) for s in some], "__name string, __number long")
        named = rows.withColumn("__name", F.regexp_extract(F.col("_metadata.file_path"), rf"({kind}-[0-9a-f]{{32}})/[^/]*$", 1))
        return named.join(F.broadcast(numbers), "__name").drop("__name")

    def load(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest one now."""
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing has been stored yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        last = max([d["number"] for d in m["deletes"]], default=0)
        hit, clean = [s for s in m["segments"] if s["number"] < last], [s for s in m["segments"] if s["number"] >= last]
        parts = []
        if clean:
            parts.append(self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{s['name']}" for s in clean]))
        if hit:
            gone = self._numbered(m["deletes"], "deletes", StructType([schema[self.key]])).groupBy(self.key).agg(F.max("__number").alias("__gone"))
            if sum(d["rows"] for d in m["deletes"]) <= BROADCAST_KEYS:
                gone = F.broadcast(gone)
            rows = self._numbered(hit, "rows", schema).join(gone, self.key, "left")
            parts.append(rows.filter(F.col("__gone").isNull() | (F.col("__number") >= F.col("__gone"))).select(*schema.names))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def stats(self) -> dict:
        """version, rows, segments and deletions (those still listed)."""
        m = self.manifest()
        return {"version": m["version"], "rows": self.load(m["version"]).count() if m["schema"] else 0, "segments": len(m["segments"]), "deletes": sum(d["rows"] for d in m["deletes"])}
