"""A live catalogue in a folder (T15): a base, the changes since, and a manifest that readers see whole.

Each micro-batch writes the latest row of each of its keys as a folder of its own; every
`compact_every` batches the base and all changes become a new base. A manifest names the
base, the changes and the last batch. It is written under a new number by a rename, so a
reader takes the one of the highest number and sees all of a batch or nothing of it, while
files that older manifests name stay for `keep` manifests more. A batch that is delivered
again after a failure is known by its number and left out.

Readers scan one row a key in the base and at most `compact_every` small folders beside it.
Rows of a null key are keys of their own; of rows with one time, one is kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muxlake.operators.timing import latest_per_key

MANIFESTS = "_manifests"


class CatalogStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str = "ts", compact_every: int = 16, keep: int = 4):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.compact_every, self.keep = compact_every, keep
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(MANIFESTS)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(MANIFESTS)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{MANIFESTS}/{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The state that readers see: number, base, changes, last batch, schema."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {"number": 0, "base": None, "changes": [], "batch": -1, "schema": None}

    def _commit(self, state: dict) -> None:
        state = state | {"number": state["number"] + 1}
        part = self._path(f"{MANIFESTS}/_{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if not self._fs.rename(part, self._path(f"{MANIFESTS}/{state['number']}.json")):
            raise RuntimeError(f"another writer has committed manifest {state['number']} of {self.path}")
        self._expire()

    def _expire(self) -> None:
        """Deletes manifests beyond those kept, and folders that no kept one names."""
        numbers = self._numbers()
        kept = [self._manifest(n) for n in numbers[-self.keep - 1 :]]
        named = {x for m in kept for x in (m["base"], *m["changes"]) if x}
        for n in numbers[: -self.keep - 1]:
            old = self._manifest(n)
            for name in {x for x in (old["base"], *old["changes"]) if x} - named:
                self._fs.delete(self._path(name), True)
            self._fs.delete(self._path(f"{MANIFESTS}/{n}.json"), False)

    def _rows(self, state: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        names = [x for x in (state["base"], *state["changes"]) if x]
        parts = self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in names])
        return latest_per_key(parts, self.keys, [self.order])

    def read(self) -> DataFrame:
        """The latest row of each key, as of the last committed batch."""
        state = self.manifest()
        if state["schema"] is None:
            raise FileNotFoundError(f"no catalogue in {self.path}")
        return self._rows(state)

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch; False if it was there already."""
        state = self.manifest()
        if batch <= state["batch"]:
            return False
        change = f"change-{batch}-{uuid.uuid4().hex[:8]}"
        latest_per_key(rows, self.keys, [self.order]).select(*rows.columns).write.parquet(f"{self.path}/{change}")
        schema = state["schema"] or rows.select(*[F.col(c) for c in rows.columns]).schema.json()
        self._commit(state | {"changes": [*state["changes"], change], "batch": batch, "schema": schema})
        if len(state["changes"]) + 1 >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Base and changes become one base; readers go on with what they had."""
        state = self.manifest()
        if not state["changes"]:
            return
        base = f"base-{state['number'] + 1}-{uuid.uuid4().hex[:8]}"
        columns = [f["name"] for f in json.loads(state["schema"])["fields"]]
        self._rows(state).select(*columns).write.parquet(f"{self.path}/{base}")
        self._commit(state | {"base": base, "changes": []})


def upsert_catalog(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: str = "ts", compact_every: int = 16):
    """A query that keeps the catalogue in a folder up to date with a stream; CatalogStore(spark, path, keys).read() gives it."""
    store = CatalogStore(spark, path, keys, order, compact_every)

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
