"""Persistent counts per key, kept by signed deltas.

The store is a stack of layers. A delta is folded per key and becomes a layer of its own, so it costs its own size and never a rewrite
of the whole; layers of like size are merged now and then, so there are never more than a logarithm of them, and a record is moved as
often at most. What counts is named by a manifest that one rename makes visible: a reader, or a job that starts again, sees the state
before a delta or after it, never a mixture. A delta has a name, and one that was taken is not taken again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A layer is merged with the newer ones once they hold together at least this share of its rows.
MERGE_SHARE = 0.5


class SignedCounts:
    """Counts at ``path`` with the key columns and value columns of ``schema`` (keys first); values are summed, null keys are keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.values = [f.split()[0] for f in schema.split(", ")][len(keys) :]

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop
        return hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop.fs.Path

    def _names(self, prefix: str) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path(self.path))) if n.startswith(prefix))

    def _manifest(self) -> tuple[int, dict]:
        """(version, {layers: [[folder, rows], …], taken: [names of deltas]})."""
        names = self._names("manifest-")
        if not names:
            return 0, {"layers": [], "taken": []}
        return int(names[-1].split("-")[1]), json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{names[-1]}").collect()))

    def _layer(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _folded(self, df: DataFrame) -> DataFrame:
        """One row per key, combined before the shuffle; keys whose values all fell to zero leave."""
        sums = df.groupBy(*self.keys).agg(*[F.sum(v).cast("bigint").alias(v) for v in self.values])
        return sums.where(" or ".join(f"{v} <> 0" for v in self.values))

    def _write(self, df: DataFrame) -> list:
        folder, seen = f"layer-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count("*").alias("n")).write.parquet(f"{self.path}/{folder}")
        return [folder, seen.get["n"]]

    def read(self) -> DataFrame:
        layers = [f for f, _ in self._manifest()[1]["layers"]]
        if not layers:
            return self.spark.createDataFrame([], self.schema)
        return self._layer(layers) if len(layers) == 1 else self._folded(self._layer(layers))

    def layers(self) -> int:
        return len(self._manifest()[1]["layers"])

    def apply(self, deltas: DataFrame, name: str | None = None) -> bool:
        """Take a delta (rows of the schema, any number per key); False if one of that name was taken before."""
        version, state = self._manifest()
        if name is not None and name in state["taken"]:
            return False
        layers = state["layers"]
        folded = self._folded(deltas.select(*self.keys, *self.values))
        # the layers to merge with: from the oldest one that the newer ones, the delta among them, have caught up with
        own = self._write(folded)
        start, newer = len(layers), own[1]
        for i in range(len(layers) - 1, -1, -1):
            if newer >= MERGE_SHARE * layers[i][1]:
                start = i
            newer += layers[i][1]
        if start < len(layers):
            own = self._write(self._folded(self._layer([f for f, _ in layers[start:]] + [own[0]])))
        kept = [*layers[:start], own]
        self._commit(version + 1, {"layers": kept, "taken": [*state["taken"], *([name] if name is not None else [])]})
        self._clean({f for f, _ in kept} | {f for f, _ in layers}, version)
        return True

    def _commit(self, version: int, state: dict) -> None:
        fs, path = self._fs()
        part, to = path(f"{self.path}/.manifest-{uuid.uuid4().hex}"), path(f"{self.path}/manifest-{version:09d}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(part, to):
            raise RuntimeError(f"{to} can't be committed: another writer was first")

    def _clean(self, used: set[str], version: int) -> None:
        """Remove what neither this version nor the one before it names: a reader of the last version may still be at work."""
        fs, path = self._fs()
        for n in self._names("layer-"):
            if n not in used:
                fs.delete(path(f"{self.path}/{n}"), True)
        for n in self._names("manifest-"):
            if int(n.split("-")[1]) < version:
                fs.delete(path(f"{self.path}/{n}"), False)


def loaded_between(df: DataFrame, after: object | None, until: object | None, at: str = "loaded_at") -> DataFrame:
    """Rows loaded after one time and until another; a row without a load time counts as loaded before all others."""
    t = F.col(at).cast("timestamp")
    if after is not None:
        df = df.where(t > F.lit(after))
    if until is not None:
        df = df.where(t.isNull() | (t <= F.lit(until)))
    return df


def halfway(df: DataFrame, at: str = "loaded_at") -> object | None:
    """The middle between the first and the last load of a table; null for an empty one."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    return df.agg(F.timestamp_micros(((F.min(t) + F.max(t)) / 2).cast("bigint"))).first()[0]


def row_changes(rows: DataFrame, after: object | None, until: object | None, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """Signed rows (the columns of ``rows`` and ``sign``) that lead from the table as it stood at one time to how it stood at another.

    A row loaded in between comes in as it stood at the end; one loaded before and deleted in between goes out as it was and comes in
    deleted. Found by the two times alone, without a comparison of both states. ``after`` null means from nothing, ``until`` null to the end.
    """
    t = F.col(deleted).cast("timestamp")
    gone = lambda at: t.isNotNull() & (F.lit(True) if at is None else t <= F.lit(at))
    seen = lambda at: F.when(gone(at), F.col(deleted)).alias(deleted)
    rest = [c for c in rows.columns if c != deleted]
    new = loaded_between(rows, after, until, loaded).select(*rest, seen(until), F.lit(1).alias("sign"))
    if after is None:
        return new
    turned = loaded_between(rows, None, after, loaded).where(gone(until) & ~gone(after))
    out = turned.select(*rest, F.lit(None).cast(rows.schema[deleted].dataType).alias(deleted), F.lit(-1).alias("sign"))
    return new.unionByName(out).unionByName(turned.select(*rest, F.col(deleted), F.lit(1).alias("sign")))
