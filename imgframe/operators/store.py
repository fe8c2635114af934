"""Elements as a stored table that changes: bucketed by instance, in versions.

Every bucket is one file of one version; a manifest says of which. Reading gives the elements as a table that is dealt
by instance already, so that updates, encoding and groupings by instance need no shuffle. A change rewrites the
buckets that hold its instances and leaves the others' files alone. It takes effect with its manifest, which is put in
place by one rename: of two writers that start from the same version one fails. Files that no bucket uses any more are
deleted after that, or, if the writer died before, when the table is opened the next time; so readers of older versions
must have finished.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .elements import ELEMENTS, Operation, apply

COLUMNS = [c.split()[0] for c in ELEMENTS.split(", ")]
BUCKET = re.compile(r"_(\d+)(?:\.[^/]*)?$")


class ConflictError(RuntimeError):
    """Another change took effect since the table was opened."""


class ElementStore:
    """A table of elements in a folder that driver and executors share; ``create`` or ``open`` one."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict):
        self.spark, self.folder, self.manifest = spark, folder.rstrip("/"), manifest
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._clear()

    @classmethod
    def create(cls, elements: DataFrame, folder: str, buckets: int) -> ElementStore:
        """Writes ``elements`` as version 0; a folder that holds a table already is an error."""
        if buckets < 1:
            raise ValueError("a table has one bucket at least")
        store = cls(elements.sparkSession, folder, {"version": -1, "buckets": buckets, "current": [-1] * buckets})
        if store._latest(store) is not None:
            raise ConflictError(f"{folder} holds a table")
        store._write(elements, range(buckets))
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> ElementStore:
        store = cls(spark, folder, {"version": -1, "buckets": 0, "current": []})
        found = cls._latest(store)
        if found is None:
            raise FileNotFoundError(folder)
        return cls(spark, folder, found)

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    def elements(self) -> DataFrame:
        """All elements, dealt by instance."""
        if not any(v >= 0 for v in self.manifest["current"]):
            return self.spark.createDataFrame([], ELEMENTS)
        name = f"elements_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({ELEMENTS.replace(' long', ' bigint')}, version int) USING parquet PARTITIONED BY (version) CLUSTERED BY (instance) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/data'")
        for version in sorted({v for v in self.manifest["current"] if v >= 0}):
            if self._files(version):
                self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (version={version})")
        return self.spark.table(name).select(*COLUMNS)

    def change(self, operations: Sequence[Operation], instances: DataFrame, strict: bool = False) -> list[int]:
        """The operations applied to the data sets of ``instances`` (instance); the buckets that were rewritten."""
        touched, rows = self._touched(instances)
        if not touched:
            return []
        wanted = instances.select("instance").where("instance IS NOT NULL").distinct()
        changed = apply(rows.join(wanted, "instance", "left_semi").select(*COLUMNS), operations, strict)
        self._write(changed.unionByName(rows.join(wanted, "instance", "left_anti").select(*COLUMNS)), touched)
        return touched

    def put(self, elements: DataFrame) -> list[int]:
        """Data sets in place of those of the same instances; the buckets that were rewritten."""
        instances = elements.select("instance").distinct()
        touched, rows = self._touched(instances)
        if touched:
            self._write(rows.join(instances, "instance", "left_anti").select(*COLUMNS).unionByName(elements.select(*COLUMNS).where("instance IS NOT NULL")), touched)
        return touched

    def _bucket(self, instance: Column) -> Column:
        return F.pmod(F.hash(instance.cast("long")), F.lit(self.buckets)).cast("int")

    def _touched(self, instances: DataFrame) -> tuple[list[int], DataFrame]:
        """The buckets of instances, and all that these buckets hold; no other file is read."""
        found = instances.where("instance IS NOT NULL").select(self._bucket(F.col("instance")).alias("b")).distinct().collect()  # at most all buckets
        touched = sorted(r["b"] for r in found)
        current = self.manifest["current"]
        files = [f for v in {current[b] for b in touched} if v >= 0 for b, f in self._files(v) if b in touched and current[b] == v]
        reader = self.spark.read.schema(ELEMENTS)
        return touched, reader.parquet(*files) if files else self.spark.createDataFrame([], ELEMENTS)

    def _write(self, elements: DataFrame, touched: Sequence[int]) -> None:
        version = self.manifest["version"] + 1
        place, name = f"{self.folder}/data/version={version}", f"writing_{uuid.uuid4().hex}"
        staged = f"{self.folder}/staged/{name}"
        rows = elements.select(F.col("instance").cast("long").alias("instance"), *COLUMNS[1:]).repartition(self.buckets, "instance")
        rows.write.bucketBy(self.buckets, "instance").sortBy("instance", "path").option("path", staged).format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay
        current = list(self.manifest["current"])
        for b in touched:
            current[b] = version
        manifest = {"version": version, "buckets": self.buckets, "current": current}
        if self._fs.exists(self._path(f"manifest/{version}.json")):
            raise ConflictError(f"version {version} is there already")
        self._fs.delete(self._path(place), True)  # of a writer that died before its manifest
        self._fs.mkdirs(self._path("data"))
        self._fs.mkdirs(self._path("manifest"))
        self._fs.rename(self._path(staged), self._path(place))
        draft = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"manifest/{version}.json")):
            raise ConflictError(f"version {version} is there already")
        self.manifest = manifest
        self._clear()

    def _path(self, name: str):
        inside = name if name.startswith(self.folder) else f"{self.folder}/{name}"
        return self.spark._jvm.org.apache.hadoop.fs.Path(inside)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _files(self, version: int) -> list[tuple[int, str]]:
        """(bucket, file) of a version."""
        folder = f"{self.folder}/data/version={version}"
        return [(int(BUCKET.search(n)[1]), f"{folder}/{n}") for n in self._names(f"data/version={version}") if n.startswith("part-")]

    @staticmethod
    def _latest(store: ElementStore) -> dict | None:
        versions = [int(n.removesuffix(".json")) for n in store._names("manifest") if re.fullmatch(r"\d+\.json", n)]
        if not versions:
            return None
        text = store.spark.read.text(f"{store.folder}/manifest/{max(versions)}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _clear(self) -> None:
        """Deletes the files of versions up to this one that no bucket uses."""
        current = self.manifest["current"]
        for version in range(self.manifest["version"] + 1):
            for bucket, file in self._files(version):
                if current[bucket] != version:
                    self._fs.delete(self._path(file), False)
