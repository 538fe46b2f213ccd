"""A keyed table that takes updates, as Parquet files and versions.

Rows are dealt into buckets by a hash of their key, each bucket a folder. A version is a small file that
names the folder of each bucket; readers take the last version, or one that they ask for, and see it
whole. A change reads and rewrites only the buckets that it touches, and is seen when its version
is written, last of all: a change that dies leaves the version before it as it was. One writer changes a
table at a time; a second one that began from the same version fails instead of undoing the first."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.operators import ingest

from . import fs

BUCKETS = 32
_BUCKET = "bucket__"


class Conflict(RuntimeError):
    """Another writer has written the version that a change was about to."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in fs.names(self.spark, f"{self.path}/versions") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        version = max(self.versions()) if version is None else version
        return json.loads(fs.read_text(self.spark, f"{self.path}/versions/v{version:010d}.json"))

    def _commit(self, version: int, buckets: int, schema: str, folders: dict[str, str]) -> int:
        text = json.dumps({"version": version, "buckets": buckets, "schema": json.loads(schema), "folders": folders})
        try:
            fs.write_new(self.spark, f"{self.path}/versions/v{version:010d}.json", text)
        except FileExistsError:
            raise Conflict(f"version {version} of {self.path} was written meanwhile") from None
        return version

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Rows in a new folder, one folder a bucket; large buckets are many files."""
        data = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, self._bucket(buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{data}")
        return {n.split("=")[1]: f"{data}/{n}" for n in fs.names(self.spark, f"{self.path}/{data}") if n.startswith(_BUCKET)}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> int:
        """The table's first version. Keys must be distinct."""
        if self.versions():
            raise Conflict(f"{self.path} is a table")
        # what files give back may be null anywhere
        schema = re.sub(r'("(?:nullable|containsNull|valueContainsNull)": ?)false', r"\1true", rows.schema.json())
        return self._commit(0, buckets, schema, self._write(rows, buckets))

    # reading

    def _rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for b, f in sorted(manifest["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _touched(self, keys: DataFrame, manifest: dict) -> list[str]:
        """Buckets of the keys of ``keys``: numbers, at most as many as there are buckets."""
        return [str(r[0]) for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of some keys; other buckets are not read."""
        manifest = self.manifest()
        return self._rows(manifest, self._touched(keys, manifest)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    # changes

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """A new version whose touched buckets hold ``change`` of their rows."""
        manifest = self.manifest()
        touched = self._touched(keys, manifest)
        if not touched:
            return manifest["version"]
        schema = StructType.fromJson(manifest["schema"])
        new = change(self._rows(manifest, touched)).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        folders = {b: f for b, f in manifest["folders"].items() if b not in touched} | self._write(new, manifest["buckets"])
        return self._commit(manifest["version"] + 1, manifest["buckets"], schema.json(), folders)

    def _distinct(self, new: DataFrame, order: str | None) -> DataFrame:
        if order is None:
            return new.where(F.col(self.key).isNotNull())
        rest = [c for c in new.columns if c != self.key]
        last = new.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rest), order).alias("row__"))
        return last.select(self.key, *[f"row__.{c}" for c in rest if c != order])

    def upsert(self, new: DataFrame, order: str | None = None) -> int:
        """Rows of ``new`` in place of those of the same key. Keys of ``new`` are distinct, or the row
        largest in ``order`` is the last of its key; rows without a key are left out."""
        rows = self._distinct(new, order)
        return self._change(new, lambda old: ingest.upsert(old, rows, self.key))

    def insert_ignore(self, new: DataFrame) -> int:
        """Rows of ``new`` whose key is not there yet."""
        rows = new.where(F.col(self.key).isNotNull())
        return self._change(rows, lambda old: ingest.insert_ignore(old, rows, self.key))

    def mark_duplicates(self, mapping: DataFrame) -> int:
        """``duplicate_of`` of the pages of ``mapping`` (mirror, canonical)."""
        return self._change(mapping.select(F.col("mirror").alias(self.key)), lambda old: ingest.mark_duplicates(old, mapping))

    def add_vectors(self, new: DataFrame) -> DataFrame:
        """Vectors with a new id are added; the counts given, added and skipped."""
        counts = ingest.add_vectors(self.lookup(new), new)[1].first()
        self._change(new, lambda old: ingest.add_vectors(old, new)[0])
        return self.spark.createDataFrame([counts], "given long, added long, skipped long")

    def delete_where(self, condition: Column) -> DataFrame:
        """Delete the rows of a condition, in whose buckets alone anything is written; the number deleted."""
        gone = self.read().where(condition)
        counted = gone.agg(F.count("*").alias("deleted")).first()
        self._change(gone, lambda old: old.where(~F.coalesce(condition, F.lit(False))))
        return self.spark.createDataFrame([counted], "deleted long")

    def delete_session(self, session: str) -> DataFrame:
        return self.delete_where(F.col("metadata")["session_id"] == session)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all versions but the last ``keep``, and delete the folders that no version names."""
        known = self.versions()
        kept = known[-max(keep, 1) :]
        used = {f for v in kept for f in self.manifest(v)["folders"].values()}
        for v in known[: -max(keep, 1)]:
            fs.delete(self.spark, f"{self.path}/versions/v{v:010d}.json")
        gone = []
        for data in fs.names(self.spark, f"{self.path}/data"):
            for name in fs.names(self.spark, f"{self.path}/data/{data}"):
                if name.startswith(_BUCKET) and f"data/{data}/{name}" not in used:
                    gone.append(f"data/{data}/{name}")
                    fs.delete(self.spark, f"{self.path}/{gone[-1]}")
        return gone
