"""Size-tiered compaction of immutable shards under a versioned manifest, with DataFrame operations only.

A table is a folder of shards (Parquet files) and manifests `v<number>.json`. A version lists its
shards with rows, bytes and tier; a reader sees the shards of one version and no others. A
commit claims the next version by creating a file that must not exist yet, which the file system
decides, so of two writers one loses and tries again upon the newer version with the shards it has written.
A claim names its writer; one older than LEASE_S without a manifest is a lost writer's and is taken over.

`append` writes an arrival as small shards. `compact` sorts shards into tiers, each `fan_in` times
as large as the one before, and merges runs of at least `fan_in` shards of a tier, cut so that
each merged file comes near the target size; files at the target are left alone. A merge
reads whole shards into one task, without any shuffle, and a round runs many merges as one job.
A merge whose inputs another writer has merged meanwhile is given up.

A writer leases the name of its folder before it writes there and gives the lease back after its commit. `vacuum`
deletes the shards that no version in use lists and no lease covers, so it may run beside any writer; leases
older than LEASE_S are lost writers'.

Nulls, empty texts and extra columns are kept as they are; a batch has to have the table's columns, by name and
type and in any order, else it is refused. Repeated rows stay repeated. An empty batch commits a version without new shards.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Bytes of a shard that merges aim at; a merge task holds one shard's rows in a stream.
TARGET = 256 << 20
FAN_IN = 4
SMALLEST = 1 << 20
#: Merges that run as one job.
MERGES_PER_JOB = 128
#: Seconds after which a lease or claim is a lost writer's: longer than any write of a batch or merge takes.
LEASE_S = 24 * 3600.0


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    tier: int


class ShardedTable:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fan_in: int = FAN_IN, smallest: int = SMALLEST, lease_s: float = LEASE_S):
        self.spark, self.folder, self.lease_s = spark, folder.rstrip("/"), lease_s
        self.target, self.fan_in, self.smallest = target, fan_in, smallest

    # Files, through the same file systems that Spark itself uses

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[tuple[str, int]]:
        fs, at = self._fs(), self._path(name)
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(at)] if fs.exists(at) else []

    # Versions

    def version(self) -> int:
        """The newest committed one, 0 before any."""
        return max((int(n[1:-5]) for n, _ in self._list("manifests") if n[0] == "v" and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        text = self.spark.read.text(f"{self.folder}/manifests/v{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _create(self, name: str, body: str) -> bool:
        """Whether this writer, and no other, created a file; its content follows."""
        fs, at = self._fs(), self._path(name)
        fs.mkdirs(at.getParent())
        if not fs.createNewFile(at):
            return False
        self._put(name, body)
        return True

    def _put(self, name: str, body: str) -> None:
        out = self._fs().create(self._path(name), True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()

    def _age(self, name: str) -> float:
        """Seconds since a file was written; none for one that is gone."""
        fs, at = self._fs(), self._path(name)
        try:
            return time.time() - fs.getFileStatus(at).getModificationTime() / 1000
        except Py4JJavaError:
            return 0.0

    def _move(self, name: str, to: str) -> bool:
        try:
            return bool(self._fs().rename(self._path(name), self._path(to)))
        except Py4JJavaError:  # some file systems report a missing source so
            return False

    def commit(self, version: int, schema: str, shards: list[Shard]) -> int:
        """Writes the manifest aside and gives it its name, if this writer has the claim to it."""
        body = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        me, final, claim = uuid.uuid4().hex, f"manifests/v{version:08d}.json", f"manifests/.claim-{version:08d}"
        fs = self._fs()
        taken = lambda: fs.exists(self._path(final))
        if not taken() and not self._create(claim, me):
            # One of several heirs of a lost writer moves its claim away; then all may claim anew.
            lost = self._age(claim) > self.lease_s and self._move(claim, f"manifests/.lost-{me}")
            if not lost or taken() or not self._create(claim, me):
                raise Conflict(f"version {version} is being committed")
        if taken():
            raise Conflict(f"version {version} exists")
        self._put(f"manifests/.{me}", body)
        if not self._move(f"manifests/.{me}", final):
            raise Conflict(f"version {version} could not be committed")
        return version

    # Shards

    def tier(self, size: int) -> int:
        """0 up to `smallest` bytes, then one more for each factor fan_in."""
        n, bound = 0, self.smallest
        while size > bound:
            n, bound = n + 1, bound * self.fan_in
        return n

    def _written(self, name: str) -> list[Shard]:
        return [Shard(f"shards/{name}/{f}", size, self.tier(size)) for f, size in sorted(self._list(f"shards/{name}")) if f.endswith(".parquet")]

    @contextlib.contextmanager
    def _leased(self, kind: str) -> Iterator[str]:
        """A new folder's name, safe from vacuum until it is committed; it is deleted if it is not."""
        name = f"{kind}-{uuid.uuid4().hex}"
        self._create(f"leases/{name}", name)
        try:
            yield name
        except BaseException:
            self._fs().delete(self._path(f"shards/{name}"), True)
            raise
        finally:
            self._fs().delete(self._path(f"leases/{name}"), False)

    def append(self, batch: DataFrame, tries: int = 20) -> int:
        """Writes a batch as it is partitioned and commits it, upon a newer version if need be."""
        batch = self._fitting(batch)
        with self._leased("append") as name:
            batch.write.parquet(f"{self.folder}/shards/{name}")
            written = self._written(name)
            for n in range(tries):
                now = self.manifest()
                self._fitting(batch, now)
                try:
                    return self.commit(now["version"] + 1, now["schema"] or batch.schema.json(), [*self._shards(now), *written])
                except Conflict:
                    time.sleep(min(2.0, 0.05 * 2**n))
            raise Conflict(f"{tries} versions were committed by others first")

    def _fitting(self, batch: DataFrame, now: dict | None = None) -> DataFrame:
        """The batch with the table's columns in the table's order."""
        schema = (self.manifest() if now is None else now)["schema"]
        if schema is None:
            return batch
        want, own = ({f.name: f.dataType for f in x} for x in (StructType.fromJson(json.loads(schema)), batch.schema))
        if want != own:
            differ = sorted(c for c in want.keys() | own.keys() if want.get(c) != own.get(c))
            raise ValueError(f"the batch and the table differ in columns or types: {', '.join(differ)}")
        return batch.select(*[F.col(f"`{c}`") for c in want])

    def _shards(self, manifest: dict) -> list[Shard]:
        return [Shard(**s) for s in manifest["shards"]]

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of similarly sized shards to merge, each of up to the target size."""
        out = []
        tiers = sorted({s.tier for s in shards})
        for tier in tiers:
            own = sorted((s for s in shards if s.tier == tier and s.size < self.target // 2), key=lambda s: (s.size, s.path))
            if len(own) < self.fan_in:
                continue
            run, size = [], 0
            for s in own:
                if run and size + s.size > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.size
            if run:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> int:
        """Merges tier by tier until no tier has enough small shards; one commit for each round. The newest version."""
        while True:
            now = self.manifest()
            runs = self.runs(self._shards(now))[:MERGES_PER_JOB]
            if not runs:
                return now["version"]
            kind = StructType.fromJson(json.loads(now["schema"]))
            one = lambda run, kind=kind: self.spark.read.schema(kind).parquet(*[f"{self.folder}/{s.path}" for s in run]).coalesce(1)
            gone = {s.path for run in runs for s in run}
            with self._leased("merge") as name:
                reduce(DataFrame.union, map(one, runs)).write.parquet(f"{self.folder}/shards/{name}")
                while True:
                    shards = self._shards(now)
                    if not gone <= {s.path for s in shards}:
                        raise Conflict("another writer has merged the same shards")
                    try:
                        self.commit(now["version"] + 1, now["schema"], [*(s for s in shards if s.path not in gone), *self._written(name)])
                        break
                    except Conflict:
                        time.sleep(0.2)
                        now = self.manifest()  # an append came first: the merge holds as well upon its version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes shards that none of the newest `keep` versions lists, as long as no one reads older ones. How many.

        Files are listed first, then leases, then versions: a file whose writer held a lease and gave it back
        in between is in the versions read last.
        """
        found = {d: [f for f, _ in self._list(f"shards/{d}") if f.endswith(".parquet")] for d, _ in self._list("shards")}
        leases = {n for n, _ in self._list("leases") if self._age(f"leases/{n}") <= self.lease_s}
        last = self.version()
        used = {s["path"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        gone = [f"shards/{d}/{f}" for d, own in found.items() if d not in leases for f in own if f"shards/{d}/{f}" not in used]
        for path in gone:
            self._fs().delete(self._path(path), False)
        for d, own in found.items():  # folders, of lost writers' unfinished files too
            if d not in leases and not any(f"shards/{d}/{f}" in used for f in own):
                self._fs().delete(self._path(f"shards/{d}"), True)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing is committed")
        kind = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self.folder}/{s['path']}" for s in now["shards"]]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)


def op2_sharding(spark, sf_dir: str, arrivals: int = 8) -> DataFrame:
    """All documents, arriving in parts by a hash of their id, compacted after each arrival; what the last version holds.

    Targets and tiers are those of production. An arrival is written in as many shards as it is read in.
    """
    docs = common.read(spark, sf_dir, "documents")
    table = ShardedTable(spark, common.scratch(spark, "sharded"))
    for part in range(arrivals):
        table.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == part))
        table.compact()
        table.vacuum()
    return table.read().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")
    )


#: The rows that the table must hold, in DuckDB SQL.
OP2_SQL = """
SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""
