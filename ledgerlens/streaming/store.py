"""Keyed tables that a stream adds to: rows in hash buckets, in runs that are merged level by level.

Each batch writes one run, with a folder for each bucket that it touches. ``FANOUT`` runs of a level become one of the next, so after n
batches there are at most ``(FANOUT - 1) * log(n)`` runs, and a batch reads only the buckets that its keys fall into. Which runs count is
said by a manifest for each batch that appears in one step after all its files; a batch that is repeated starts from the manifest
before its own and overwrites what it wrote, and readers see committed batches only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FANOUT = 64, 4
Run = dict


@dataclass
class KeyedStore:
    """``newest`` makes one row per key from rows that carry ``__run``, the batch of their run."""

    spark: SparkSession
    root: str
    key: str
    newest: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS
    fanout: int = FANOUT

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path("manifest")
        files = self._files(folder)
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def runs(self, before: int | None = None) -> list[Run]:
        """The committed runs, or those of the last batch before ``before``."""
        ids = [i for i in self._manifests() if before is None or i < before]
        return self._load(ids[-1]) if ids else []

    def _load(self, batch: int) -> list[Run]:
        stream = self._files(self._path("manifest")).open(self._path(f"manifest/{batch}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, runs: list[Run], buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of the runs with their ``__run``; only the files of ``buckets`` if they are named. None without a run."""
        out = None
        for run in runs:
            rows = self.spark.read.schema(run["schema"]).parquet(f"{self.root}/runs/{run['name']}")
            if buckets is not None:
                rows = rows.where(F.col("__bucket").isin(buckets))
            rows = rows.drop("__bucket").withColumn("__run", F.lit(run["batch"]).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def current(self) -> DataFrame | None:
        """One row per key of the committed batches."""
        rows = self.read(self.runs())
        return None if rows is None else self.newest(rows)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys: at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def known(self, keys: DataFrame, batch: int) -> DataFrame | None:
        """One row per stored key in the buckets of ``keys``, as before the batch."""
        rows = self.read(self.runs(batch), self.touched(keys))
        return None if rows is None else self.newest(rows)

    def _write(self, rows: DataFrame, name: str, level: int, batch: int) -> Run:
        placed = rows.withColumn("__bucket", self.bucket())
        # a bucket is one file, unless it is large
        placed.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/runs/{name}")
        return {"name": name, "level": level, "batch": batch, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)}

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the batch's rows (one per key), merge full levels and commit."""
        runs = self.runs(batch)
        made = [self._write(rows, f"{batch}-0", 0, batch)]
        runs.append(made[0])
        level = 0
        while sum(r["level"] == level for r in runs) >= self.fanout:
            full = [r for r in runs if r["level"] == level]
            merged = self._write(self.newest(self.read(full)), f"{batch}-{level + 1}", level + 1, max(r["batch"] for r in full))
            made.append(merged)
            runs = [r for r in runs if r["level"] != level] + [merged]
            level += 1
        self._commit(runs, batch)
        for run in made[:-1]:  # merged at once
            self._files(self._path("runs")).delete(self._path(f"runs/{run['name']}"), True)

    def _commit(self, runs: list[Run], batch: int) -> None:
        target, draft = self._path(f"manifest/{batch}.json"), self._path(f"manifest/{batch}.draft")
        files = self._files(target)
        stream = files.create(draft, True)
        stream.write(json.dumps(runs).encode())
        stream.close()
        files.delete(target, False)
        if not files.rename(draft, target):
            raise OSError(f"can't commit {target}")
        # the manifest before stays, in case this batch is repeated; older ones go with the runs that only they name
        ids = [i for i in self._manifests() if i <= batch]
        kept = {r["name"] for i in ids[-2:] for r in self._load(i)}
        for old in ids[:-2]:
            for run in self._load(old):
                if run["name"] not in kept:
                    files.delete(self._path(f"runs/{run['name']}"), True)
            files.delete(self._path(f"manifest/{old}.json"), False)
