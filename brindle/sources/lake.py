"""A table with snapshots over Parquet: versions, merges, time travel, change sets, schema changes, expiry.

``path/v<n>/`` holds the files of version n and ``path/_manifest/<n>.json`` what is known of it. A version becomes visible when its manifest
file appears, which is created only if it doesn't exist: of two writers, one fails and can try again. Nothing is changed in place.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Version:
    number: int
    parent: int | None
    schema: str
    files: str
    rows: int
    checksum: str
    change: str
    at: float
    protected: bool = False
    renames: list = field(default_factory=list)  # (old, new) pairs, in order


class Lake:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests, by the file system that Spark itself uses
    def _manifest(self, n: int):
        return self._new(f"{self.path}/_manifest/{n:08d}.json")

    def versions(self) -> list[Version]:
        folder = self._new(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().toString() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [Version(**json.loads(self._read(n))) for n in names]

    def _read(self, name: str) -> str:
        io = self._fs.open(self._new(name))
        try:
            return bytes(b & 255 for b in self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(io)).decode()
        finally:
            io.close()

    def _write(self, v: Version, replace: bool = False) -> None:
        out = self._fs.create(self._manifest(v.number), replace)  # raises if another writer was first
        out.write(bytearray(json.dumps(asdict(v)).encode()))
        out.close()

    def snapshots(self) -> DataFrame:
        rows = [(v.number, v.parent, v.rows, v.checksum, v.change, v.at, v.protected) for v in self.versions()]
        return self.spark.createDataFrame(rows, "version int, parent int, rows long, checksum string, change string, at double, protected boolean")

    def current(self) -> Version | None:
        v = self.versions()
        return v[-1] if v else None

    def commit(self, df: DataFrame, change: str, renames: list | None = None) -> Version:
        """Write ``df`` as the next version."""
        cur = self.current()
        n = cur.number + 1 if cur else 1
        files = f"{self.path}/v{n}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(files)
        back = self.spark.read.schema(df.schema).parquet(files)
        r = back.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("c")).first()
        v = Version(n, cur.number if cur else None, df.schema.json(), files, r["n"], r["c"], change, time.time(), renames=renames or [])
        self._write(v)
        return v

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the current one by default."""
        all_ = {v.number: v for v in self.versions()}
        v = all_[version if version is not None else max(all_)]
        return self.spark.read.schema(StructType.fromJson(json.loads(v.schema))).parquet(v.files)

    def merge(self, changes: DataFrame, keys: list[str], columns: list[str] | None = None, delete: str | None = None) -> Version:
        """Rows of ``changes`` replace those of equal key or are added; ``columns``: only these are taken over for rows that were there. Rows where the
        flag ``delete`` holds take their key out. Keys must be unique among the changes and are compared null-safe."""
        old = self.read()
        c = changes.withColumn("_delete", F.coalesce(F.col(delete), F.lit(False)) if delete else F.lit(False))
        if not c.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key occurs twice among the changes")
        a, b = old.alias("a"), c.withColumn("_here", F.lit(True)).alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        j = a.withColumn("_there", F.lit(True)).join(b, on, "full_outer")
        both = F.col("_there").isNotNull() & F.col("_here").isNotNull()
        pick = columns or [x for x in old.columns if x not in keys and x in changes.columns]
        out = []
        for x in old.columns:
            new = F.col(f"b.{x}") if x in changes.columns else F.lit(None)
            keep = F.col(f"a.{x}")
            out.append(F.when(F.col("_here").isNull(), keep).when(both & F.lit(x not in pick), keep).otherwise(new).cast(old.schema[x].dataType).alias(x))
        return self.commit(j.where(~F.coalesce("_delete", F.lit(False))).select(*out), "merge")

    def insertions(self, a: int, b: int) -> DataFrame:
        return self.read(b).exceptAll(self.read(a).select(*self.read(b).columns))

    def deletions(self, a: int, b: int) -> DataFrame:
        return self.read(a).exceptAll(self.read(b).select(*self.read(a).columns))

    def protect(self, version: int) -> None:
        v = next(v for v in self.versions() if v.number == version)
        v.protected = True
        self._write(v, replace=True)

    def expire(self, keep: int) -> list[int]:
        """Drop all but the last ``keep`` versions and the protected ones, manifests first; gives their numbers."""
        all_ = self.versions()
        old = [v for v in all_[:-keep] if not v.protected] if keep > 0 else []
        gone, carried = {v.number for v in old}, []
        for v in all_:  # renames go over to the next version that stays, for with_history_names
            carried += v.renames
            if v.number not in gone:
                if carried != v.renames:
                    v.renames = carried
                    self._write(v, replace=True)
                carried = []
        for v in old:
            self._fs.delete(self._manifest(v.number), False)
            self._fs.delete(self._new(v.files), True)
        return [v.number for v in old]

    def compact(self, files: int) -> Version:
        """The same rows in fewer files, as a new version."""
        return self.commit(self.read().coalesce(files), "compact")

    # schema changes
    def add_column(self, name: str, type_: str, default=None) -> Version:
        return self.commit(self.read().withColumn(name, F.lit(default).cast(type_)), f"add {name}")

    def drop_column(self, name: str) -> Version:
        return self.commit(self.read().drop(name), f"drop {name}")

    def rename_column(self, old: str, new: str) -> Version:
        return self.commit(self.read().withColumnRenamed(old, new), f"rename {old} to {new}", [(old, new)])

    def widen_column(self, name: str, type_: str) -> Version:
        """Only to a type that holds every value of the old one."""
        order = ["tinyint", "smallint", "int", "bigint"]
        old = self.read().schema[name].dataType.simpleString()
        if not ((old in order and type_ in order and order.index(type_) >= order.index(old)) or (old, type_) == ("float", "double")):
            raise ValueError(f"{old} to {type_} could lose values")
        return self.commit(self.read().withColumn(name, F.col(name).cast(type_)), f"widen {name}")

    def add_field(self, struct: str, name: str, type_: str) -> Version:
        return self.commit(self.read().withColumn(struct, F.col(struct).withField(name, F.lit(None).cast(type_))), f"add {struct}.{name}")

    def with_history_names(self, version: int) -> DataFrame:
        """An old version under today's names: later renames are applied."""
        df = self.read(version)
        for v in self.versions():
            if v.number > version:
                for a, b in v.renames:
                    df = df.withColumnRenamed(a, b)
        return df
