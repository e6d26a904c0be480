"""Findings kept from run to run, so that a fragment is scanned once per rule set.

A store is a folder with one Parquet table per rule set and run, one row per
fragment that the run was the first to scan: its key and its matches, which may
be none. A run reads only the keys of earlier runs, tries the rules on fragments
it has no row for, and appends those. Another rule set has tables of its own, so
changed rules scan everything again.

A table counts once its write is complete, and writing a run again replaces it;
so a run that died changes nothing, and a repeated one neither.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators import scan as C
from regspark.operators.joins import is_short, spread_join

SCHEMA = f"key string, _hits {C.HITS}"


def rules_version(rules: Sequence[C.Rule]) -> str:
    """Names a rule set by its content; the order of the rules matters not."""
    told = sorted(json.dumps(asdict(r), sort_keys=True, default=list) for r in rules)
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:32]


def _key():
    """A fragment's text and the lines it answers for."""
    return F.concat_ws("-", "digest", F.col("own_lines").cast("string"))


class FindingStore:
    """Matches of all fragments scanned so far, below ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, rules: Sequence[C.Rule]) -> str:
        return f"{self.path}/rules={rules_version(rules)}"

    def runs(self, rules: Sequence[C.Rule]) -> list[str]:
        """Folders of the complete runs of a rule set."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(self._folder(rules))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [s.getPath() for s in files.listStatus(folder)]
        return sorted(p.toString() for p in found if files.exists(path(p, "_SUCCESS")))

    def scanned(self, rules: Sequence[C.Rule], runs: Sequence[str] | None = None) -> DataFrame:
        """(key, _hits) of every fragment scanned under these rules."""
        runs = self.runs(rules) if runs is None else runs
        read = self.spark.read.schema(SCHEMA)
        return read.parquet(*runs) if runs else self.spark.createDataFrame([], SCHEMA)

    def unseen(self, frags: DataFrame, rules: Sequence[C.Rule], run: str | None = None) -> DataFrame:
        """The fragments that no complete run but ``run`` itself has scanned.

        Only keys are shuffled to find out; the texts move only if too many are new
        to tell all tasks their keys.
        """
        keyed = frags.withColumn("key", _key())
        earlier = [r for r in self.runs(rules) if not r.endswith(f"/run={run}")]
        if not earlier:
            return keyed
        new = keyed.select("key").distinct().join(self.scanned(rules, earlier).select("key"), "key", "left_anti")
        return keyed.join(F.broadcast(new) if is_short(new) else new, "key", "left_semi")

    def scan(self, frags: DataFrame, rules: Sequence[C.Rule], run: str) -> DataFrame:
        """Findings for every layer holding the fragment, as ``scan_distinct`` gives
        them; only unseen fragments are matched, and kept under the name ``run``."""
        todo = self.unseen(frags, rules, run)
        once = todo.groupBy("key").agg(F.first(C.own_hits(rules)).alias("_hits"))
        once.select("key", "_hits").write.mode("overwrite").parquet(f"{self._folder(rules)}/run={run}")
        hits = self.scanned(rules).filter(F.size("_hits") > 0).dropDuplicates(["key"])
        places = frags.drop("raw").withColumn("key", _key())
        found = spread_join(places, hits, ["key"], "file").drop("digest").withColumnRenamed("key", "digest")
        return C.per_layer(found)
