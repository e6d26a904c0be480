"""Keyed tables kept on disk, of which a merge rewrites only the buckets it touches.

A table is a folder. Its rows lie in buckets by the hash of their key, one Parquet
folder a bucket; a manifest names the folder of every bucket, and a merge writes new
folders for the buckets its batch has keys in, then a manifest that names them. Rows
of other buckets are neither read nor written. A merge writes the rows it adds or
changes apart from those it keeps, with the old rows beside them, so what tells a
version from the one before is read as it lies.

The newest manifest is the table. It appears by one rename, so a merge that dies
leaves the table as it was, and of two writers of one version the second fails
(``FileAlreadyExistsException``) and can merge again. The file system must have an
atomic rename. A manifest also holds how far each source was folded in: a batch
repeated after a restart changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a merge does where a key has a row already (``add``: sums, rows of zeros go).
MODES = ("replace", "coalesce", "ignore", "add")

#: Parts a merge writes: rows of the table (untouched, of a new key, changed), then
#: rows of the version before (of a key that went, as they were before a change).
TABLE_PARTS = ("kept", "came", "now")
#: What the parts that tell two versions apart count in ``changes``.
SIGNS = {"came": 1, "now": 1, "gone": -1, "was": -1}


def _folders(manifest: dict) -> set[str]:
    """The folders of a version's rows; manifests of old tables name one a bucket."""
    return {f for found in manifest["folders"].values() for f in ([found] if isinstance(found, str) else found)}


def _by_bucket(written: dict[str, dict[str, str]]) -> dict[str, list[str]]:
    """The folders of the table's rows by bucket, from those written by part."""
    found: dict[str, list[str]] = {}
    for part in TABLE_PARTS:
        for bucket, folder in written.get(part, {}).items():
            found.setdefault(bucket, []).append(folder)
    return found


def _part_type(schema: T.StructType, names: Sequence[str]) -> T.ArrayType:
    row = T.StructType([T.StructField(c, schema[c].dataType) for c in names])
    return T.ArrayType(T.StructType([T.StructField("_part", T.StringType()), T.StructField("_row", row)]))


class KeyedTable:
    """A table below ``path``, which all executors share, with one row per ``key``.

    ``schema`` is that of its rows, key included. ``buckets`` counts only when the
    table is made; choose it so that a bucket is what one task can hold when the
    table is as large as it will be, or ``resize`` later. Null is a key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str | Sequence[str],
                 mode: str = "replace", buckets: int = 64):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.spark, self.path, self.mode, self._buckets = spark, path.rstrip("/"), mode, buckets
        self.key = [key] if isinstance(key, str) else list(key)
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.rest = [c for c in self.schema.names if c not in self.key]

    def _file(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._file(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions whose manifest is there, oldest first."""
        folder, files = self._file(f"{self.path}/manifests"), self._files()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        """The newest version; 0 is the empty table."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Number of buckets, folders of each bucket that has rows, the mark of each source,
        and the folders by part that tell the version from the one before."""
        version = self.version() if version is None else version
        if version == 0:
            return {"buckets": self._buckets, "folders": {}, "folded": {}}
        stream = self._files().open(self._file(f"{self.path}/manifests/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        draft = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        out = self._files().create(self._file(draft))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._file(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        plain = gateway.new_array(rename, 1)
        plain[0] = rename.valueOf("NONE")  # an existing target is an error
        context.rename(self._file(draft), self._file(f"{self.path}/manifests/{version:020d}.json"), plain)

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest one)."""
        return self._read(sorted(_folders(self.manifest(version))))

    def _step(self, since: int, until: int | None, parts: Sequence[str]) -> DataFrame | None:
        """Rows of the parts that tell ``until`` from ``since``, with ``_n``, if they need
        no comparison: ``since`` is empty or the version just before."""
        after = self.manifest(until)
        found = {"came": _folders(after)}
        if _folders(self.manifest(since)):
            if (self.version() if until is None else until) != since + 1 or "changes" not in after:
                return None
            found = after["changes"]
        told = [self._read(sorted(found[p])).withColumn("_n", F.lit(SIGNS[p])) for p in parts if found.get(p)]
        return reduce(DataFrame.unionByName, told) if told else self._read([]).withColumn("_n", F.lit(0))

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that tell two versions apart, with ``_n``: -1 for a row that went, 1
        for one that came; a changed row is both. Reads only the buckets that differ, and
        of one merge only the rows it added, changed or removed."""
        told = self._step(since, until, list(SIGNS))
        if told is not None:
            return told
        before, after = _folders(self.manifest(since)), _folders(self.manifest(until))
        gone, come = sorted(before - after), sorted(after - before)
        signed = self._read(gone).withColumn("_n", F.lit(-1)).unionByName(
            self._read(come).withColumn("_n", F.lit(1)))
        return signed.groupBy(*self.schema.names).agg(F.sum("_n").cast("int").alias("_n")).filter("_n <> 0")

    def key_changes(self, since: int, until: int | None = None) -> DataFrame:
        """Keys that went (``_n`` -1) or came (1) between two versions."""
        told = self._step(since, until, ["came", "gone"])
        if told is not None:
            return told.select(*self.key, "_n")
        found = self.changes(since, until).groupBy(*self.key).agg(F.sum("_n").cast("int").alias("_n"))
        return found.filter("_n <> 0")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _reduced(self, batch: DataFrame, seq: str | None) -> DataFrame:
        """One row per key of a batch, summed up before it meets the table."""
        if extra := set(batch.columns) - set(self.schema.names) - {seq}:
            raise ValueError(f"the table has no columns {sorted(extra)}")
        missing = [F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.rest if c not in batch.columns]
        rows = batch.select("*", *missing)
        if not self.rest:
            return rows.select(*self.key).distinct()
        if self.mode == "add":
            found = [F.sum(c).alias(c) for c in self.rest]
        elif seq is None:
            raise ValueError("seq names the column that orders the rows of a batch")
        elif self.mode == "coalesce":
            found = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in self.rest]
        else:
            pick = F.max_by if self.mode == "replace" else F.min_by
            row = pick(F.struct(*self.rest), F.col(seq)).alias("_row")
            return rows.groupBy(*self.key).agg(row).select(*self.key, "_row.*")
        return rows.groupBy(*self.key).agg(*found)

    def _merged(self, old: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
        """At most one old and one new row per key, made rows of the parts they belong to
        (``_part``); grouped within slices of buckets, as many as fill the tasks."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        spread = both.withColumn("_bucket", self._bucket(buckets)).withColumn(
            "_slice", F.pmod(F.hash(*self.key), F.lit(-(-tasks // buckets)))).repartition("_bucket", "_slice")
        had, has = F.col("_first") == 0, F.col("_last") == 1
        ends = [F.min("_new").alias("_first"), F.max("_new").alias("_last")]
        groups = spread.groupBy("_bucket", "_slice", *self.key)
        if not self.rest:
            return groups.agg(*ends).select(
                *self.key, "_bucket", F.when(had, F.lit("kept")).otherwise(F.lit("came")).alias("_part"))
        add = self.mode == "add"

        def of(new: int, c: str) -> Column:
            value = F.when(F.col("_new") == new, F.col(c))
            return F.max(value) if add else F.any_value(value, ignoreNulls=F.lit(True))

        made = [of(1, c) if not add else F.sum(c).cast(self.schema[c].dataType) for c in self.rest]
        found = groups.agg(*ends, *(of(0, c).alias(f"_old_{c}") for c in self.rest),
                           *(v.alias(f"_new_{c}") for v, c in zip(made, self.rest, strict=True)))

        def value(c: str) -> Column:
            before, after = F.col(f"_old_{c}"), F.col(f"_new_{c}")
            if add:
                return after
            if self.mode == "coalesce":
                return F.coalesce(after, before)
            return F.when(has, after).otherwise(before) if self.mode == "replace" else F.when(had, before).otherwise(after)

        def same(c: str) -> Column:
            pair = F.col(f"_old_{c}"), value(c)
            if "map<" in self.schema[c].dataType.simpleString():
                pair = tuple(F.to_json(F.struct(v.alias(c))) for v in pair)
            return pair[0].eqNullSafe(pair[1])

        before = F.struct(*(F.col(f"_old_{c}").alias(c) for c in self.rest))
        after = F.struct(*(value(c).alias(c) for c in self.rest))
        stays = F.coalesce(F.greatest(F.lit(False), *(F.col(f"_new_{c}") != 0 for c in self.rest)),
                           F.lit(False)) if add else F.lit(True)
        equal = reduce(lambda x, y: x & y, [same(c) for c in self.rest])

        def part(name: str, row: Column) -> Column:
            return F.struct(F.lit(name).alias("_part"), row.alias("_row"))

        parts = (F.when(~had & ~stays, F.array().cast(_part_type(self.schema, self.rest)))
                 .when(~had, F.array(part("came", after))).when(~stays, F.array(part("gone", before)))
                 .when(equal, F.array(part("kept", before))).otherwise(
                     F.array(part("now", after), part("was", before))))
        return found.select("_bucket", *self.key, F.explode(parts).alias("_p")).select(
            *self.key, "_p._row.*", "_bucket", "_p._part")

    def _write(self, rows: DataFrame) -> dict[str, dict[str, str]]:
        """Writes rows with their ``_part`` and ``_bucket``; by part, the folder of every
        bucket that got some."""
        run, files, found = uuid.uuid4().hex, self._files(), {}
        rows.write.partitionBy("_part", "_bucket").parquet(f"{self.path}/data/{run}")
        for part in (s.getPath() for s in files.listStatus(self._file(f"{self.path}/data/{run}"))):
            if part.getName().startswith("_part="):
                names = [s.getPath().getName() for s in files.listStatus(part)]
                found[part.getName().removeprefix("_part=")] = {
                    n.removeprefix("_bucket="): f"{run}/{part.getName()}/{n}" for n in names if n.startswith("_bucket=")}
        return found

    def merge(self, batch: DataFrame, seq: str | None = None, marks: dict[str, int] | None = None) -> int:
        """Folds a batch in by the table's mode and returns the version that holds it.

        ``seq`` orders the rows of one batch: the last of a key counts (``ignore``: the
        first). ``marks`` says how far the batch goes, as a rising number per source; if
        the table is already that far, nothing is done. The batch is reduced to one row
        per key and checked for the buckets it touches (at most the number of buckets
        comes to the driver) before old rows are read.
        """
        version = self.version()
        now = self.manifest(version)
        if marks and all(now["folded"].get(s, -1) >= n for s, n in marks.items()):
            return version
        kept = f"{self.path}/batches/{uuid.uuid4().hex}"
        self._reduced(batch, seq).write.parquet(kept)
        new = self.spark.read.schema(self.schema).parquet(kept)
        touched = {str(r[0]) for r in new.select(self._bucket(now["buckets"])).distinct().collect()}
        old = self._read(sorted(_folders({"folders": {b: f for b, f in now["folders"].items() if b in touched}})))
        folders = {b: f for b, f in now["folders"].items() if b not in touched}
        written = self._write(self._merged(old, new, now["buckets"])) if touched else {}
        self._commit(version + 1, now | {
            "folders": folders | _by_bucket(written), "folded": now["folded"] | (marks or {}),
            "changes": {part: sorted(found.values()) for part, found in written.items() if part in SIGNS}})
        self._files().delete(self._file(kept), True)
        return version + 1

    def resize(self, buckets: int) -> int:
        """Writes the whole table into another number of buckets."""
        version = self.version()
        now = self.manifest(version)
        rows = self.read(version).withColumn("_part", F.lit("kept")).withColumn(
            "_bucket", self._bucket(buckets)).repartition("_bucket")
        self._commit(version + 1, now | {"buckets": buckets, "folders": _by_bucket(self._write(rows)), "changes": {}})
        return version + 1

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions older than the last ``keep`` and every folder only they, or
        merges that died, have written. Not to be run beside a merge."""
        files, versions = self._files(), self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        live = set().union(*(_folders(m) | {f for part in m.get("changes", {}).values() for f in part} for m in kept))
        for v in versions[:-keep]:
            files.delete(self._file(f"{self.path}/manifests/{v:020d}.json"), False)
        data = self._file(f"{self.path}/data")

        def below(folder, name: str = ""):
            """Folders of buckets below a run, with their names; tables written before
            merges told their parts apart have them right there."""
            for found in (s.getPath() for s in files.listStatus(folder)):
                if found.getName().startswith("_bucket="):
                    yield found, f"{name}/{found.getName()}"
                elif found.getName().startswith("_part="):
                    yield from below(found, f"{name}/{found.getName()}")

        for run in (s.getPath() for s in (files.listStatus(data) if files.exists(data) else [])):
            for folder, name in list(below(run, run.getName())):
                if name not in live:
                    files.delete(folder, True)
        files.delete(self._file(f"{self.path}/batches"), True)
