"""Incidents in versions: a commit writes the months that it changes and claims the next version; readers keep theirs.

`path`/data/commit=.../ym=yyyy-MM holds what a commit wrote of a month, `path`/versions one small file a version, which tells for
each month the commit that holds it, and for each writer the last batch that it has committed. A commit is made from the newest
version; if another writer has claimed the next one meanwhile, it is made anew from that. So no writer loses what another wrote, a
batch that is run again changes nothing, and a month that nothing changes is never written again.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import settled

#: What a change gives: rows that are new or take the place of those with their _id, and the ids (_id) of rows that go; either may be None.
Change = Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None] | None]


def month(date: str = "date") -> Column:
    """The month that a row is kept in; rows without a date have one of their own."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


class Store:
    """A table of rows with `_id` and `date` at `path`, in versions. Any number of writers may commit at the same time.

    A claim is a link (local paths) or a rename that fails where its target is (HDFS and stores that rename like it); a store of
    objects without either needs a file system that gives one.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    # Files.

    def _local(self) -> str | None:
        return re.sub("^file:(//)?", "", self.path) if re.match("file:|/", self.path) else None

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, p = self._fs(spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _claim(self, spark: SparkSession, manifest: dict) -> bool:
        """Writes a version's file if no one has; False if it is there."""
        own, name = f"{self.path}/versions/.claim-{uuid.uuid4().hex}", f"{self.path}/versions/{manifest['version']:012d}.json"
        fs, p = self._fs(spark, own)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if (local := self._local()) is None:
                return fs.rename(p, self._fs(spark, name)[1])
            folder = f"{local}/versions/"
            os.link(folder + os.path.basename(own), folder + os.path.basename(name))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(p, False)

    # Reading.

    def newest(self, spark: SparkSession) -> int | None:
        """The number of the newest version; None if there is none."""
        return max((int(m[1]) for n in self._names(spark, "versions") if (m := re.fullmatch(r"(\d+)\.json", n))), default=None)

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        version = self.newest(spark) if version is None else version
        if version is None:
            raise FileNotFoundError(f"no store at {self.path}")
        return json.loads(spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0])

    def read(self, spark: SparkSession, version: int | dict | None = None) -> DataFrame:
        """The rows of a version (the newest, unless told), with `ym`, their month: filters on it choose the folders that are read."""
        found = version if isinstance(version, dict) else self.manifest(spark, version)
        schema = StructType.fromJson(found["schema"])
        names = [f.name for f in schema]
        if not found["months"]:
            return spark.createDataFrame([], schema).withColumn("ym", F.lit("none"))
        folders = [f"{self.path}/data/commit={c}/ym={m}" for m, c in sorted(found["months"].items())]
        whole = StructType([*schema.fields]).add("commit", "string").add("ym", "string")
        return spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders).select(*names, "ym")

    def rows(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """read() without the month."""
        return self.read(spark, version).drop("ym")

    # Writing.

    def create(self, rows: DataFrame) -> int:
        """Version 0 of the store; ValueError if there is one."""
        spark = rows.sparkSession
        empty = {"version": -1, "months": {}, "writers": {}, "schema": rows.schema.jsonValue()}
        made = self._made(spark, empty, rows, None)
        if not self._claim(spark, made):
            raise ValueError(f"there is a store at {self.path}")
        return 0

    def commit(self, spark: SparkSession, change: Change, writer: str | None = None, number: int | None = None) -> int:
        """Makes the next version by change(rows of the newest one), as often as another writer is first; the number of the version that has it.

        A writer that names itself and numbers its batches may run one again: what it has committed is not committed twice.
        """
        while True:
            base = self.manifest(spark)
            if writer is not None and base["writers"].get(writer, -1) >= number:
                return base["version"]
            made = change(self.read(spark, base).drop("ym"))
            upserts, gone = made or (None, None)
            if upserts is None and gone is None and writer is None:
                return base["version"]
            new = self._made(spark, base, upserts, gone)
            if writer is not None:
                new["writers"][writer] = number
            if self._claim(spark, new):
                return new["version"]

    def _made(self, spark: SparkSession, base: dict, upserts: DataFrame | None, gone: DataFrame | None) -> dict:
        """The next manifest, its data written: the months that hold, or held, a row that changes."""
        schema = StructType.fromJson(base["schema"])
        new = {"version": base["version"] + 1, "months": dict(base["months"]), "writers": dict(base["writers"]), "schema": base["schema"]}
        names = [f.name for f in schema]
        kept = self.read(spark, base)
        if upserts is not None:
            # Each row in the columns and types of the store; what is read three times is written once.
            upserts = settled(upserts.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]), "changes").withColumn("ym", month())
        ids = None
        for df in (upserts, gone):
            if df is not None:
                one = df.select(F.col("_id").cast(schema["_id"].dataType).alias("_id"))
                ids = one if ids is None else ids.unionByName(one)
        if ids is None:
            return new
        ids = settled(ids.distinct(), "changed-ids")
        touched = kept.join(ids, "_id", "left_semi").select("ym")
        if upserts is not None:
            touched = touched.unionByName(upserts.select("ym"))
        # As many as there are months.
        months = [r["ym"] for r in touched.distinct().collect()]
        if not months:
            return new
        rows = kept.where(F.col("ym").isin(months)).join(ids, "_id", "left_anti").select(*names, "ym")
        if upserts is not None:
            rows = rows.unionByName(upserts.select(*names, "ym"))
        commit = uuid.uuid4().hex
        target = f"{self.path}/data/commit={commit}"
        # By range: a month of very many rows is written by many tasks.
        rows.repartitionByRange("ym", "date", "_id").sortWithinPartitions("ym", "date", "_id").write.partitionBy("ym").parquet(target)
        held = {n.partition("=")[2] for n in self._names(spark, f"data/commit={commit}") if n.startswith("ym=")}
        for m in months:
            new["months"].pop(m, None)
        new["months"] |= dict.fromkeys(sorted(held), commit)
        return new

    # Single changes.

    def insert(self, rows: DataFrame, key: str = "hash") -> int:
        """Adds the rows whose `key` the newest version lacks, one for each (the smallest _id): added again, or by two writers at once, they are there once."""

        def change(stored: DataFrame):
            first = rows.groupBy(key).agg(F.min("_id").alias("_first"))
            own = rows.join(first, key).where(F.col("_id") == F.col("_first")).select(rows.columns)
            new = settled(own.join(stored.select(key), key, "left_anti").select(rows.columns), "insertions")
            return None if new.isEmpty() else (new, None)

        return self.commit(rows.sparkSession, change)

    def update(self, rows: DataFrame) -> int:
        """Puts rows in the place of those with their _id; ids that the store lacks are added."""
        return self.commit(rows.sparkSession, lambda _: (rows, None))

    def delete(self, ids: DataFrame) -> int:
        """Takes out the rows of ids (_id)."""
        return self.commit(ids.sparkSession, lambda _: (None, ids))
