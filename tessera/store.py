"""Generations of an index: immutable folders of Parquet tables and one pointer.

A generation is written beside the others under a staging name, read back and counted, then renamed, and the pointer file is replaced at
once; readers resolve the pointer once and pin what they read, so an update never changes a running read.  One owner writes at a time.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "tessera-store-1"
TABLES = ("files", "skips", "sources", "facts", "entities", "relations", "postings", "lengths", "blast", "stats")


class StoreBusy(RuntimeError):
    """Another owner writes."""


class StoreCorrupt(RuntimeError):
    """What is read is not what was written."""


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        os.makedirs(f"{path}/generations", exist_ok=True)
        os.makedirs(f"{path}/pins", exist_ok=True)

    @contextlib.contextmanager
    def owner(self) -> Iterator[None]:
        with open(f"{self.path}/lock", "a") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise StoreBusy(self.path) from e
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    @staticmethod
    def name(snapshot_id: str, derivation_id: str) -> str:
        return hashlib.sha256(json.dumps(["repo", snapshot_id, derivation_id]).encode()).hexdigest()

    def current(self) -> str | None:
        try:
            with open(f"{self.path}/CURRENT") as f:
                name = f.read().strip()
        except FileNotFoundError:
            return None
        return name if os.path.exists(f"{self.path}/generations/{name}/manifest.json") else None

    def manifest(self, name: str) -> dict:
        try:
            with open(f"{self.path}/generations/{name}/manifest.json") as f:
                found = json.load(f)
        except (OSError, ValueError) as e:
            raise StoreCorrupt(f"{name}: {e}") from e
        if found.get("version") != VERSION or found.get("name") != name:
            raise StoreCorrupt(f"{name}: not of this version or not this generation")
        return found

    def read(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"file://{self.path}/generations/{name}/{table}")

    def write(self, folder: str, table: str, df: DataFrame, by: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> int:
        """Rows written; their number is observed while they are written and must be read back."""
        from pyspark.sql import Observation

        seen = Observation()
        out = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
        out = out.observe(seen, F.count(F.lit(1)).alias("n"))  # after the sampling of ranges, which reads rows as well
        out.write.mode("overwrite").partitionBy(*by).parquet(f"file://{folder}/{table}")
        return int(seen.get["n"])

    def publish(self, snapshot_id: str, derivation_id: str, tables: dict[str, tuple[DataFrame, tuple[str, ...], tuple[str, ...]]], more: dict) -> str:
        """Write a generation of (table: (rows, partition columns, sort columns)) and make it the current one."""
        name = self.name(snapshot_id, derivation_id)
        staging = f"{self.path}/generations/.{name}-{uuid.uuid4().hex}"
        os.makedirs(staging)
        try:
            counts = {t: self.write(staging, t, *x) for t, x in tables.items()}
            for t, n in counts.items():
                if (got := self.spark.read.schema(tables[t][0].schema).parquet(f"file://{staging}/{t}").count()) != n:
                    raise StoreCorrupt(f"{t}: wrote {n} rows, read {got}")
            body = {"version": VERSION, "name": name, "snapshot_id": snapshot_id, "derivation_id": derivation_id, "rows": counts, **more}
            with open(f"{staging}/manifest.json", "w") as f:
                json.dump(body, f, ensure_ascii=False, sort_keys=True)
                f.flush()
                os.fsync(f.fileno())
            final = f"{self.path}/generations/{name}"
            if os.path.exists(final):
                shutil.rmtree(final)
            os.rename(staging, final)
        except BaseException:
            shutil.rmtree(staging, ignore_errors=True)
            raise
        self.point(name)
        self.sweep()
        return name

    def point(self, name: str) -> None:
        part = f"{self.path}/.CURRENT-{uuid.uuid4().hex}"
        with open(part, "w") as f:
            f.write(name)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, f"{self.path}/CURRENT")

    @contextlib.contextmanager
    def pin(self) -> Iterator[str]:
        """The current generation, kept from the sweep while it is read."""
        while True:
            name = self.current()
            if name is None:
                raise FileNotFoundError(f"{self.path}: nothing indexed yet")
            mark = f"{self.path}/pins/{name}.{os.getpid()}.{uuid.uuid4().hex}"
            open(mark, "w").close()
            if self.current() == name:
                break
            os.remove(mark)
        try:
            yield name
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(mark)

    def sweep(self) -> list[str]:
        """Takes away generations that are neither current nor pinned, and what crashed writers left."""
        pinned = set()
        for mark in os.listdir(f"{self.path}/pins"):
            name, pid, _ = mark.split(".")
            if os.path.exists(f"/proc/{pid}") or not os.path.isdir("/proc"):
                pinned.add(name)
            else:
                os.remove(f"{self.path}/pins/{mark}")
        gone = [g for g in os.listdir(f"{self.path}/generations") if g != self.current() and g not in pinned]
        for g in gone:
            shutil.rmtree(f"{self.path}/generations/{g}", ignore_errors=True)
        return gone

    def status(self) -> dict:
        """What the current generation holds, from its manifest alone; no owner is needed."""
        name = self.current()
        return {"indexed": False} if name is None else {"indexed": True, **self.manifest(name)}

    def verify(self, name: str) -> None:
        """Every table has the rows of its manifest, and every source the bytes of its digest."""
        for table, n in self.manifest(name)["rows"].items():
            if self.read(name, table).count() != n:
                raise StoreCorrupt(f"{name}: {table}")
        wrong = self.read(name, "sources").where(F.concat(F.lit("sha256:"), F.sha2("data", 256)) != F.col("digest")).limit(1).count()
        if wrong:
            raise StoreCorrupt(f"{name}: a source does not have its digest")
