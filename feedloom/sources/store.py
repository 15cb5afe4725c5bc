"""Several stored tables that change together.

A table is a set of immutable segments: folders of parquet files, one folder per bucket of the key's hash. What the
tables consist of stands in a manifest, one small file per commit; readers follow the one with the largest number.
A commit first writes all segments and then puts the next manifest in place by a rename, so results, cache and ledger
of one run become visible at once or not at all, and a run that dies in between leaves files nobody reads.

Rows carry the 64-bit hash of their key, and the files a Bloom filter of these hashes. An insert asks only
the buckets of its batch, and while the batch is small the files skip the row groups that cannot hold its keys.
The ledger keeps the last batch of each stream: one that is delivered again is not stored again. A store has one
writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.upsert import evolve, last_per_key
from feedloom.plans.layout import BROADCAST_ROWS
from feedloom.plans.ordering import grouped_position
from feedloom.plans.staging import stage, stage_counting
from feedloom.plans.winners import KEY, one_per_key

# Buckets of a table; rows of a batch up to which its key hashes are looked up in the files.
BUCKETS, LOOKED_UP = 32, 5_000
_HASH, _BUCKET = "_key_hash", "_bucket"


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


class Store:
    """The state of a store as of one manifest, and the changes made to it since; ``commit`` makes them visible."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
        found = self._manifests()
        blank = {"version": 0, "tables": {}, "last_id": {}, "ledger": {}}
        self.state = json.loads(self._read_text(found[-1])) if found else blank

    def _manifests(self) -> list[str]:
        """Manifest files in order; only whole ones have this name."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = (s.getPath().toString() for s in files.listStatus(folder))
        return sorted((n for n in names if n.endswith(".json")), key=lambda n: n.rsplit("/", 1)[1])

    def _read_text(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path).collect())

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table in today's schema; one that was never written is empty."""
        return self._rows(name, schema).select(schema.names)

    def _rows(self, name: str, schema: T.StructType, buckets: Sequence[str] | None = None) -> DataFrame:
        """The rows of some or all buckets with their key's hash."""
        fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
        wanted = T.StructType([*fields, T.StructField(_HASH, T.LongType(), True)])
        table = self.state["tables"].get(name, {})
        paths = [f"{segment}/{_BUCKET}={b}" for b, segments in table.items() if buckets is None or b in buckets for segment in segments]
        return self.spark.read.schema(wanted).parquet(*paths) if paths else self.spark.createDataFrame([], wanted)

    def _segment(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        writer = rows.repartition(_BUCKET).sortWithinPartitions(_BUCKET, _HASH).write.partitionBy(_BUCKET)
        writer = writer.option("compression", "zstd")
        writer.option(f"parquet.bloom.filter.enabled#{_HASH}", "true").parquet(path)
        return path

    def _keyed(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.withColumn(_HASH, key_hash(keys)).withColumn(_BUCKET, F.pmod(F.col(_HASH), F.lit(BUCKETS)).cast("string"))

    def _buckets(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(_BUCKET).distinct().collect()]

    def stored_keys(self, name: str, batch: DataFrame, schema: T.StructType, keys: Sequence[str], rows: int) -> DataFrame:
        """The stored keys that a batch of so many rows, written with its hashes, may meet."""
        columns = T.StructType([schema[k] for k in keys])
        stored = self._rows(name, columns, self._buckets(batch))
        if rows <= LOOKED_UP:
            hashes = [r[0] for r in batch.select(_HASH).distinct().collect()]
            # Up to as many values the files' own filters are asked; it is a setting of the reader.
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKED_UP))
            stored = stored.filter(F.col(_HASH).isin(hashes))
        return stored

    def insert(self, name: str, batch: DataFrame, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> int:
        """Add the rows whose key is not stored, first in ``order`` wins; returns how many.

        Rows that miss a required value are skipped; a column ``id`` of the schema is numbered on in key order.
        """
        keys = list(keys)
        for field in schema.fields:
            if not field.nullable:
                batch = batch.filter(F.col(field.name).isNotNull())
        # Written by ``one_per_key``: only keys are looked up and numbered, and what is left of them meets the rows once.
        rows = self._keyed(one_per_key(batch, [F.col(k) for k in keys], order), keys)
        fresh, n = stage_counting(rows.select(*KEY, *keys, _HASH, _BUCKET), "store-batch")
        if self.state["tables"].get(name):
            known = self.stored_keys(name, fresh, schema, keys, n).select(*keys, _HASH)
            fresh, n = stage_counting(fresh.join(known, [*keys, _HASH], "left_anti"), "store-new")
        if not n:
            return 0
        chosen = fresh.select(*KEY)
        if "id" in schema.names and "id" not in keys:
            last = self.state["last_id"].get(name, 0)
            placed = grouped_position(fresh.select(*KEY, *keys), [], [F.col(k) for k in keys], name="_place")
            rows, chosen = rows.drop("id"), placed.select(*KEY, (F.col("_place") + last).alias("id"))
            self.state["last_id"][name] = last + n
        rows = rows.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, list(KEY))
        segment = self._segment(name, self._laid_out(rows, schema))
        table = self.state["tables"].setdefault(name, {})
        for bucket in self._buckets(self.spark.read.parquet(segment)):
            table.setdefault(str(bucket), []).append(segment)
        return n

    def replace(self, name: str, batch: DataFrame, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> int:
        """Put the batch in place of stored rows with its keys, last in ``order`` wins; only their buckets are written again."""
        keys = list(keys)
        latest, n = stage_counting(self._keyed(last_per_key(batch, keys, order), keys), "store-batch")
        self._swap(name, latest.select(*keys, _HASH, _BUCKET), latest, schema, keys)
        return n

    def replace_slices(self, name: str, slices: DataFrame, rows: DataFrame, schema: T.StructType, keys: Sequence[str]) -> None:
        """Delete every stored row of the given slices (rows of ``keys``) and add ``rows``, which may be empty.

        A table is either kept by row keys or by slices: all its rows of one slice lie in one bucket.
        """
        keys = list(keys)
        gone = stage(self._keyed(slices.select(*keys).distinct(), keys), "store-slices")
        inside = self._keyed(rows.join(gone.select(*keys), keys, "left_semi"), keys)
        self._swap(name, gone, stage(inside, "store-batch"), schema, keys)

    def _swap(self, name: str, gone: DataFrame, rows: DataFrame, schema: T.StructType, keys: list[str]) -> None:
        """New segments for the buckets of ``gone``: their stored rows but those with a key of ``gone``, and ``rows``."""
        buckets = self._buckets(gone)
        if not buckets:
            return
        old = self._rows(name, schema, buckets).join(gone.select(*keys, _HASH), [*keys, _HASH], "left_anti")
        old = old.withColumn(_BUCKET, F.pmod(F.col(_HASH), F.lit(BUCKETS)).cast("string"))
        merged, n = stage_counting(self._laid_out(rows, schema).unionByName(old), "store-merged")
        segment = self._segment(name, merged) if n else None
        left = set(self._buckets(merged)) if n else set()
        table = self.state["tables"].setdefault(name, {})
        for bucket in buckets:
            table[bucket] = [segment] if bucket in left else []

    def _laid_out(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        """Today's schema and the columns of the store; a time of creation that is not given is that of the commit."""
        if "created_at" in schema.names:
            given = F.col("created_at") if "created_at" in rows.columns else F.lit(None)
            rows = rows.withColumn("created_at", F.coalesce(given.cast("timestamp"), self.now))
        whole = T.StructType([*schema.fields, T.StructField(_HASH, T.LongType()), T.StructField(_BUCKET, T.StringType())])
        return evolve(rows, whole)

    def seen(self, stream: str, batch: int) -> bool:
        """Whether this batch of a stream is stored already."""
        return self.state["ledger"].get(stream, -1) >= batch

    def commit(self, **batches: int) -> int:
        """Make the changes visible, and the batches of the named streams stored; returns the version."""
        version = self.state["version"] + 1
        self.state["version"] = version
        self.state["ledger"].update(batches)
        jvm = self.spark._jvm
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{name}")
        target, draft = path(f"{version:012d}.json"), path(f"_{uuid.uuid4().hex}")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(draft, False)
        out.write(json.dumps(self.state).encode())
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"version {version} of {self.root} was written by someone else")
        return version
