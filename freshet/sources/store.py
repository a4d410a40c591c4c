"""Tables that are published together: Parquet folders and one pointer file that names them.

A publication writes new folders and then swaps the pointer, so readers see all tables of it or none.
Rows lie in slices by a hash of a column; a table's number of slices follows its size when it is first
written, and a publication may replace single slices only. For one writer at a time, which is what a
stream's micro-batches are; several writers need a table format made for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 200_000


def slice_of(column: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slices)).cast("int")


class PublishedTables:
    """`by`: the column that slices a table; tables without one are a single slice.

    `least`: slices of a sliced table at the least, for tables that start small and grow.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict, by: dict[str, str] | None = None, least: int = 1):
        self.spark, self.root, self.schemas, self.by, self.least = spark, root.rstrip("/"), schemas, by or {}, least
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))
        self._pointer = self._path(f"{self.root}/current.json")

    def current(self) -> dict:
        """Token of the last publication, and of each table its slice number and the folder of each slice."""
        if not self._fs.exists(self._pointer):
            return {"token": None, "tables": {}, "retired": []}
        stream = self._fs.open(self._pointer)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _folders(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*sorted(folders))

    def read(self, name: str) -> DataFrame:
        return self._folders(name, list(self.current()["tables"].get(name, {}).get("folders", {}).values()))

    def slices_with(self, name: str, keys: DataFrame, column: str) -> list[int]:
        """Slices of a table that may hold the keys; at most as many as it has."""
        slices = self.current()["tables"].get(name, {}).get("slices", 1)
        return sorted(r[0] for r in keys.select(slice_of(column, slices)).distinct().collect())

    def read_slices(self, name: str, wanted: list[int]) -> DataFrame:
        folders = self.current()["tables"].get(name, {}).get("folders", {})
        return self._folders(name, [folders[str(s)] for s in wanted if str(s) in folders])

    def publish(self, tables: dict[str, DataFrame], token: str | None = None, replace: dict[str, list[int]] | None = None, unused: Sequence[str] = ()) -> None:
        """K6: write the tables, then swap the pointer. `replace` names the slices that a table's rows replace;
        without it they replace the table. A token that is published already is not published again. `unused`
        names folders that the tables of before refer to and these do not; they go when replaced slices go."""
        now = self.current()
        if token is not None and now["token"] == token:
            return
        listed, retired = dict(now["tables"]), [*unused]
        for name, df in tables.items():
            old = listed.get(name, {"slices": None, "folders": {}})
            column, wanted = self.by.get(name), (replace or {}).get(name)
            slices = 1
            if column is not None:
                slices = old["slices"] if wanted is not None and old["slices"] else max(self.least, -(-df.count() // SLICE_ROWS))
            folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
            rows = df.withColumn("_slice", slice_of(column, slices) if column is not None else F.lit(0))
            rows.hint("rebalance", "_slice").write.partitionBy("_slice").parquet(folder)
            written = {
                s.getPath().getName().split("=")[1]: s.getPath().toString()
                for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("_slice=")
            }
            kept = {s: f for s, f in old["folders"].items() if wanted is not None and int(s) not in wanted}
            retired += [f for s, f in old["folders"].items() if s not in kept]
            listed[name] = {"slices": slices, "folders": {**kept, **written}}
        self._swap({"token": token, "tables": listed, "retired": retired})
        for folder in now["retired"]:  # replaced by the publication before; its readers have had a whole one to finish
            self._fs.delete(self._path(folder), True)

    def _swap(self, pointer: dict) -> None:
        fresh = self._path(f"{self.root}/next-{uuid.uuid4().hex}.json")
        out = self._fs.create(fresh, False)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self._conf).rename(fresh, self._pointer, rename)
