"""Points that batches change in place, as numbered snapshots.

A snapshot is a base, dealt over folders by a hash of the id, and the deltas since: the rows that
each commit put or deleted, whole points and nothing else.  A commit writes its delta, then names
the new snapshot in a manifest that is renamed into place, which only one writer can do; before
that, readers and a failed writer's successor see the old state.  Deltas are folded into a new base
once they hold a share of it.  Readers of older snapshots keep them until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import read_keyed, write_keyed

GONE, VERSION = "_gone", "_version"
FEW_ROWS = 20_000
KEYS = T.StructType([T.StructField("value", T.StringType()), T.StructField("id", T.StringType())])


class Conflict(RuntimeError):
    """Another writer has made the snapshot that this one was about to make."""


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    base: str | None = None
    base_rows: int = 0
    deltas: tuple[str, ...] = ()
    delta_rows: int = 0
    tag: str | None = None  # whatever the last writer says about itself, such as a batch number


class PointStore:
    """Points under ``root``.  ``lookups``: columns, besides the id, that points are found by.

    ``fold``: deltas are folded into the base once they hold this share of its rows, and FEW_ROWS at
    least.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, lookups: Sequence[str] = ("canonicalId", "matchKey"), buckets: int = 64, fold: float = 0.1) -> None:
        self.spark, self.root, self.schema, self.lookups, self.buckets, self.fold = spark, root.rstrip("/"), schema, tuple(lookups), buckets, fold
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("manifests"))

    # --- snapshots ---

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("manifests")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The given snapshot, or the newest; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Snapshot()
        stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(**held | {"deltas": tuple(held["deltas"])})

    def _publish(self, new: Snapshot) -> int:
        draft, final = self._path(f"manifests/{uuid.uuid4().hex}.draft"), self._path(f"manifests/{new.version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)  # fails where the file is there already
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new.version} is there already") from e
            raise
        return new.version

    # --- reading ---

    def _base(self, s: Snapshot, ids: DataFrame | None = None) -> DataFrame:
        if s.base is None:
            return self.spark.createDataFrame([], self.schema)
        return read_keyed(self.spark, f"{self.root}/{s.base}/points", self.schema, "id", self.buckets, ids).select(self.schema.names)

    def _changes(self, s: Snapshot) -> DataFrame | None:
        """The last row of every id that the deltas hold."""
        if not s.deltas:
            return None
        kinds = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField(VERSION, T.LongType())])
        rows = self.spark.read.schema(kinds).parquet(*[f"{self.root}/{d}" for d in s.deltas])
        return rows.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("*"), VERSION).alias("x")).select("x.*")

    def _overlaid(self, base: DataFrame, changes: DataFrame | None) -> DataFrame:
        if changes is None:
            return base
        return base.hint("merge").join(changes.select("id"), "id", "left_anti").select(self.schema.names).unionByName(changes.filter(~F.col(GONE)).select(self.schema.names))

    def read(self, version: int | None = None) -> DataFrame:
        """All points of a snapshot."""
        s = self.snapshot(version)
        return self._overlaid(self._base(s), self._changes(s))

    def get(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """The points of the given ids (column ``id``), from the folders that may hold them."""
        s = self.snapshot(version)
        ids = ids.select("id").distinct()
        changes = self._changes(s)
        changes = changes.hint("merge").join(ids, "id", "left_semi") if changes is not None else None
        return self._overlaid(self._base(s, ids), changes)

    def find(self, values: DataFrame, version: int | None = None) -> DataFrame:
        """The points that have one of the values (column ``value``) in a lookup column now."""
        s = self.snapshot(version)
        values = values.select("value").filter("value is not null and value <> ''").distinct()
        changes = self._changes(s)
        ids = self.spark.createDataFrame([], "id string")
        if s.base is not None:
            ids = read_keyed(self.spark, f"{self.root}/{s.base}/keys", KEYS, "value", self.buckets, values).select("id")
        if changes is not None:
            ids = ids.unionByName(self._key_rows(changes.filter(~F.col(GONE))).hint("merge").join(values, "value", "left_semi").select("id"))
        own = self.get(ids, s.version)
        for c in self.lookups:  # a point may have lost the value by which it was found
            own = own.hint("merge").join(values.select(F.col("value").alias(c), F.lit(True).alias(f"_by_{c}")), c, "left")
        hit = F.coalesce(*[F.col(f"_by_{c}") for c in self.lookups])
        return own.filter(hit).select(self.schema.names)

    # --- writing ---

    def _key_rows(self, points: DataFrame) -> DataFrame:
        values = F.array_distinct(F.array(*[F.col(c).cast("string") for c in self.lookups]))
        return points.select(F.explode(values).alias("value"), F.col("id").cast("string").alias("id")).filter("value is not null and value <> ''")

    def _new_base(self, points: DataFrame) -> tuple[str, int]:
        name = f"base-{uuid.uuid4().hex}"
        write_keyed(points.select(self.schema.names), f"{self.root}/{name}/points", "id", self.buckets)
        whole = read_keyed(self.spark, f"{self.root}/{name}/points", self.schema, "id", self.buckets)
        write_keyed(self._key_rows(whole), f"{self.root}/{name}/keys", "value", self.buckets)
        return name, whole.count()

    def write(self, points: DataFrame, tag: str | None = None) -> int:
        """``points`` as the whole table."""
        now = self.snapshot()
        name, n = self._new_base(points)
        return self._publish(Snapshot(now.version + 1, name, n, tag=tag))

    def clear(self) -> int:
        return self._publish(Snapshot(self.snapshot().version + 1))

    def commit(self, put: DataFrame | None = None, delete: DataFrame | None = None, tag: str | None = None) -> int:
        """Puts whole points and deletes ids (column ``id``) in one step; an id in both is put.  Returns the new version.

        Several rows of one id in ``put`` are an error of the caller: one of them stays.
        """
        now = self.snapshot()
        version = now.version + 1
        rows = [] if put is None else [put.select(*self.schema.names, F.lit(False).alias(GONE))]
        if delete is not None:
            gone = delete.select("id").distinct()
            gone = gone if put is None else gone.join(put.select("id"), "id", "left_anti")
            rows.append(gone.select(*[self._value_or_null(f) for f in self.schema.fields], F.lit(True).alias(GONE)))
        if not rows:
            return now.version
        name = f"delta-{uuid.uuid4().hex}"
        all_ = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        all_.withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{self.root}/{name}")
        n = self.spark.read.parquet(f"{self.root}/{name}").count()
        new = Snapshot(version, now.base, now.base_rows, (*now.deltas, name), now.delta_rows + n, tag or now.tag)
        self._publish(new)
        return self.compact() if new.delta_rows > max(FEW_ROWS, self.fold * new.base_rows) else version

    @staticmethod
    def _value_or_null(field: T.StructField) -> Column:
        return F.col("id") if field.name == "id" else F.lit(None).cast(field.dataType).alias(field.name)

    def replace_merged(self, survivors: DataFrame, duplicates: DataFrame) -> int:
        """A merge: survivors in, duplicates out, in one step."""
        return self.commit(put=survivors, delete=duplicates)

    def compact(self) -> int:
        """The same points with all deltas folded into a new base."""
        now = self.snapshot()
        name, n = self._new_base(self.read(now.version))
        return self._publish(replace(now, version=now.version + 1, base=name, base_rows=n, deltas=(), delta_rows=0))

    def vacuum(self, keep: int = 1) -> None:
        """Forgets all but the newest ``keep`` snapshots, and removes the folders that only others need."""
        kept = self.versions()[-keep:]
        needed = {"manifests"}
        for v in kept:
            s = self.snapshot(v)
            needed |= {s.base, *s.deltas}
        for v in set(self.versions()) - set(kept):
            self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        for status in self._fs.listStatus(self._path("")):
            if (name := status.getPath().getName()) not in needed:
                self._fs.delete(self._path(name), True)
