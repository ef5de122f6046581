"""Append-only records with versions: the newest version of a key is what stands, earlier ones stay readable.

A write states the version it has seen of each key. Keys that moved on since are refused and come back with the version found; the others are
written as the next version. A write's files become visible with its marker, which is created exclusively (file systems whose
create is not exclusive need one writer at a time); a writer that loses the race compares again. So a key is replaced whole or
not at all, and a failed write leaves no trace. Amounts are kept as exact text, and binary floats are refused by type.
Rows lie in folders by hash bucket of the key, so reading one document reads one bucket.

extraction records (S07-S09): key document_id. Scenario sets (S13, S14): key company_id.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS, ATTEMPTS = 32, 5


def _mapped(kind: T.DataType, at: str, exact: bool) -> T.DataType:
    """The type as stored (exact: decimals as text), refusing floats wherever they are nested."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError(f"{at} is a binary float; amounts are kept as exact text")
    if isinstance(kind, T.DecimalType):
        return T.StringType() if exact else kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_mapped(kind.elementType, f"{at}[]", exact), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_mapped(kind.keyType, f"{at}.key", exact), _mapped(kind.valueType, f"{at}.value", exact), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _mapped(f.dataType, f"{at}.{f.name}", exact), True) for f in kind.fields])
    return kind


def stored(rows: DataFrame) -> DataFrame:
    """Decimals as text at any depth; a float anywhere is an error before anything is written."""
    kinds = {f.name: (f.dataType, _mapped(f.dataType, f.name, True)) for f in rows.schema.fields}
    return rows.select(*[F.col(n).cast(new).alias(n) if new != old else F.col(n) for n, (old, new) in kinds.items()])


def restored(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored rows in the types they were written from (nested ones may hold nulls)."""
    return rows.select(*[F.col(f.name).cast(_mapped(f.dataType, f.name, False)).alias(f.name) for f in schema.fields], *[c for c in rows.columns if c not in schema.names])


class Versioned:
    """A versioned table under `root`, a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.schema = schema
        self.kept = T.StructType([T.StructField(f.name, _mapped(f.dataType, f.name, True)) for f in schema.fields])
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def commits(self) -> list[str]:
        """The data folder that each marker names, in order; one marker per write. A marker that stays empty is a writer that died."""
        folder, io = self._path("commits"), self._jvm.org.apache.commons.io.IOUtils
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        out = []
        for name in names:
            for wait in range(20):
                stream = self._fs.open(self._path(f"commits/{name}"))
                text = io.toString(stream, "UTF-8")
                stream.close()
                if text:
                    break
                time.sleep(0.1)
            out.append(text)
        return out

    def history(self) -> DataFrame:
        """Every version of every key, as stored."""
        full = T.StructType([*self.kept.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        folders = [f"{self.root}/data/{c}" for c in self.commits() if c]
        found = [f for f in folders if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f))]  # a write without accepted rows has none
        if not found:
            return self.spark.createDataFrame([], full)
        parts = [self.spark.read.schema(full).parquet(f) for f in found]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def versions(self) -> DataFrame:
        return self.history().groupBy(*self.keys).agg(F.max("version").alias("current"))

    def latest(self) -> DataFrame:
        """The rows of each key's newest version, in their own types, with the version."""
        h = self.history()
        newest = h.groupBy(*self.keys).agg(F.max("version").alias("version"))
        return restored(h.join(newest, [*self.keys, "version"], "left_semi"), self.schema).drop("bucket")

    def one(self, *key) -> DataFrame:
        """The newest version of one key; only its bucket is read."""
        bucket = self.spark.range(1).select(_bucket(*[F.lit(k).cast(self.schema[n].dataType) for n, k in zip(self.keys, key)]).alias("b")).first().b
        mine = self.history().where(F.col("bucket") == bucket)
        for n, k in zip(self.keys, key):
            mine = mine.where(F.col(n) == F.lit(k))
        top = mine.groupBy(*self.keys).agg(F.max("version").alias("version"))
        return restored(mine.join(F.broadcast(top), [*self.keys, "version"], "left_semi"), self.schema).drop("bucket")

    def _mark(self, number: int, folder: str) -> bool:
        """Make a write visible. False if another one took the number."""
        self._fs.mkdirs(self._path("commits"))
        try:
            out = self._fs.create(self._path(f"commits/{number:012d}"), False)
        except Exception as e:  # the file system names it by class: FileAlreadyExistsException
            if "exist" not in str(e).lower():
                raise
            return False
        out.writeBytes(folder)
        out.close()
        return True

    def write(self, rows: DataFrame, seen: str = "seen_version") -> DataFrame:
        """Write rows (the schema, and the version the writer has seen of their key, 0 for none). Returns the refused keys with the
        version found. The rows of one key state one version; a key that states several is refused."""
        body = stored(rows.select(*self.schema.names, seen))
        for _ in range(ATTEMPTS):
            number = len(self.commits()) + 1
            stated = body.groupBy(*self.keys).agg(F.min(seen).alias("_low"), F.max(seen).alias("_high"))
            judged = stated.join(self.versions(), self.keys, "left").withColumn("current", F.coalesce("current", F.lit(0)))
            fresh = (F.col("_low") == F.col("_high")) & (F.col("_low") == F.col("current"))
            folder = uuid.uuid4().hex
            accepted = body.join(judged.where(fresh).select(*self.keys), self.keys, "left_semi").withColumn("version", F.col(seen).cast("long") + 1).drop(seen)
            refused_at = f"{self.root}/refused/{folder}"
            judged.where(~F.coalesce(fresh, F.lit(False))).select(*self.keys, F.col("_high").alias("seen"), F.col("current").alias("found")).write.parquet(refused_at)
            accepted.withColumn("bucket", _bucket(*self.keys)).write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            if self._mark(number, folder):
                return self.spark.read.parquet(refused_at)
        raise RuntimeError(f"other writers committed {ATTEMPTS} times in a row")


def _bucket(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
