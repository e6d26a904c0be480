"""Study tables kept current: every batch of changes moves them by what it changed.

Base tables and study tables are ``KeyedTable``s below one folder. A batch is merged
into the base tables; ``refresh`` then takes from each table what came and went since
its readers last looked (an updated row is the old one going and the new one coming)
and adds it to the study tables, whose rows of zeros vanish. Distinct counts rest on
tables of how many rows support a key: a key counts from its first to its last row.

Each study table holds the version of its sources it stands at, committed together
with its rows. So a refresh that died goes on where it stopped, and a second one
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators.joins import is_short, spread_join
from regspark.operators.stored import KeyedTable

#: name -> (schema, key, mode) of the tables that batches are merged into.
BASE = {
    "tags": ("tag_id long, repo_id long, last_pushed timestamp, status string", ["tag_id"], "replace"),
    "repo_layers": ("layer_id long, repo_id long", ["layer_id", "repo_id"], "ignore"),
    "occurrences": ("layer_id long, file string, start_line int, fragment_hash string, file_type string",
                    ["layer_id", "file", "start_line"], "replace"),
}
#: name -> (schema, key) of the tables that follow them; all are sums.
FOLLOWING = {
    "month_histogram": ("key string, count long", ["key"]),
    "status_histogram": ("key string, count long", ["key"]),
    "filetype_frequency": ("file_type string, n long", ["file_type"]),
    "layer_repos": ("layer_id long, repos long", ["layer_id"]),
    "held": ("fragment_hash string, layer_id long, n long", ["fragment_hash", "layer_id"]),
    "reached": ("fragment_hash string, repo_id long, n long", ["fragment_hash", "repo_id"]),
    "reached_by": ("fragment_hash string, layer_id long, n long", ["fragment_hash", "layer_id"]),
    "repos_per_secret": ("fragment_hash string, repo_count long, layer_count long", ["fragment_hash"]),
    "secret_count_distribution": ("repo_count long, secret_count long", ["repo_count"]),
}


def _meet(rows: DataFrame, delta: DataFrame, spread: str) -> DataFrame:
    """Stored rows joined to changes by layer. Where the changes are few, every task
    gets them and the stored rows are read but not shuffled."""
    if is_short(delta):
        return rows.join(F.broadcast(delta), "layer_id")
    return spread_join(rows, delta, ["layer_id"], spread)


def _side_by_side(spark: SparkSession, *tasks: Callable[[], object]) -> None:
    """Runs jobs that do not need each other's results at the same time."""
    with ThreadPoolExecutor(max(len(tasks), 1)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]:
            done.result()


class LiveStudy:
    """Histograms, layer uniqueness and secret reach below ``path``, kept current.

    ``held`` and ``reached`` are as large as the relations (secret, layer) and (secret,
    repository); an exact distinct count that can also fall needs them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        kinds = BASE | {name: (*kind, "add") for name, kind in FOLLOWING.items()}
        self.tables = {name: KeyedTable(spark, f"{path.rstrip('/')}/{name}", schema, key, mode, buckets)
                       for name, (schema, key, mode) in kinds.items()}

    def __getitem__(self, name: str) -> KeyedTable:
        return self.tables[name]

    def apply(self, batch_id: int, seq: str, **batches: DataFrame) -> None:
        """Merges a batch (frames by name of base table) and refreshes what follows. A
        batch repeated with its number changes nothing."""
        merges = (partial(self[name].merge, rows, seq, {"batch": batch_id}) for name, rows in batches.items())
        _side_by_side(self.spark, *merges)
        self.refresh()

    def refresh(self) -> None:
        """Brings all study tables to the newest versions of the base tables. Tables that
        do not follow each other are brought up at the same time."""
        n = F.col("_n").cast("long")
        _side_by_side(
            self.spark,
            partial(self._follow, "month_histogram", "tags", lambda d: d.filter(F.col("last_pushed").isNotNull()).select(
                P.month_key(F.col("last_pushed")).alias("key"), n.alias("count"))),
            partial(self._follow, "status_histogram", "tags", lambda d: d.select(
                P.blank_to_unknown(F.col("status")).alias("key"), n.alias("count"))),
            partial(self._follow, "filetype_frequency", "occurrences", lambda d: d.select(
                P.blank_to_unknown(F.col("file_type")).alias("file_type"), n.alias("n"))),
            partial(self._follow, "layer_repos", "repo_layers", lambda d: d.select("layer_id", n.alias("repos"))),
            partial(self._follow, "held", "occurrences", lambda d: d.select("fragment_hash", "layer_id", n.alias("n"))))
        _side_by_side(self.spark, partial(self._reach, "reached", "repo_id"), partial(self._reach, "reached_by", "layer_id"))
        self._count_reach()
        self._follow("secret_count_distribution", "repos_per_secret", lambda d: d.select(
            "repo_count", n.alias("secret_count")))

    def _span(self, name: str, source: str) -> tuple[int, int]:
        """Version of the source a table stands at, and the newest."""
        return self[name].manifest()["folded"].get(source, 0), self[source].version()

    def _follow(self, name: str, source: str, told) -> None:
        """Adds to a table what ``told`` makes of the changes of its source."""
        since, until = self._span(name, source)
        if since < until:
            self[name].merge(told(self[source].changes(since, until)), marks={source: until})

    def _reach(self, name: str, by: str) -> None:
        """Pairs (secret, ``by``) over the join of held layers and repository links: the
        change of one side meets the newest other side, that of the other the old one."""
        (held_from, held_to), (links_from, links_to) = self._span(name, "held"), self._span(name, "repo_layers")
        if (held_from, links_from) == (held_to, links_to):
            return
        held, links = self["held"], self["repo_layers"]
        new_pairs = _meet(links.read(links_to), held.key_changes(held_from, held_to), "repo_id")
        new_links = _meet(held.read(held_from).select("fragment_hash", "layer_id"),
                          links.changes(links_from, links_to), "fragment_hash")
        found = new_pairs.select("fragment_hash", by, "_n").unionByName(new_links.select("fragment_hash", by, "_n"))
        self[name].merge(found.withColumnRenamed("_n", "n"), marks={"held": held_to, "repo_layers": links_to})

    def _count_reach(self) -> None:
        """Distinct repositories and layers per secret: keys that came or went in both tables."""
        spans = {source: self._span("repos_per_secret", source) for source in ("reached", "reached_by")}
        if all(since == until for since, until in spans.values()):
            return
        repos, layers = (self[source].key_changes(*span) for source, span in spans.items())
        n, none = F.col("_n").cast("long"), F.lit(0).cast("long")
        told = repos.select("fragment_hash", n.alias("repo_count"), none.alias("layer_count")).unionByName(
            layers.select("fragment_hash", none.alias("repo_count"), n.alias("layer_count")))
        self["repos_per_secret"].merge(told, marks={source: until for source, (_, until) in spans.items()})

    def layer_uniqueness(self) -> DataFrame:
        """1 for layers of exactly one repository."""
        return self["layer_repos"].read().select("layer_id", (F.col("repos") == 1).cast("int").alias("is_unique"))

    def shown(self) -> DataFrame:
        """All study tables as rows (table, key, measure, value), to compare or export."""
        def long(df: DataFrame, table: str, key: str, *measures: str) -> DataFrame:
            cells: list[Column] = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value"))
                                   for m in measures]
            return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"),
                             F.explode(F.array(*cells)).alias("_c")).select("table", "key", "_c.*")

        out = long(self.layer_uniqueness(), "layer_uniqueness", "layer_id", "is_unique")
        for name in ("month_histogram", "status_histogram", "filetype_frequency", "repos_per_secret",
                     "secret_count_distribution"):
            table = self[name]
            out = out.unionByName(long(table.read(), name, table.key[0], *table.rest))
        return out
