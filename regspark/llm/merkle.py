"""Merkle manifest of a dataset: one tree per group of rows, one over the groups.

A leaf is the digest of a row's fields. Leaves follow each other by the order
column; every ``ARITY`` consecutive nodes become one parent, until a single node,
the group's subroot, remains. The subroots, ordered by group, form a tree of the
same kind, whose root stands for the whole dataset.

Verifying a row means to fold it up to the root along its path. A parent keeps
copies of its hash state from before each child slot, so folding a replaced child
resumes the state at its slot and feeds it the replacement and the siblings to
the right, never those to the left again.

Work is dealt in blocks of two levels (``ARITY``^2 nodes of one group), whatever
the sizes of the groups. Places of rows come from one range partitioned sort, in
which a range's rows are numbered as they lie and only ranges are counted, so a
group that holds most rows is spread like any other. Blocks are written once;
the levels above them shrink by ``ARITY``^2 a time and are read back as the path
of each block. All tables between are in the shared folder, so a lost task
repeats only itself.

Null fields have a digest of their own, a null group is a group (the first), a
null order value comes first. Rows of equal order follow each other by leaf, then
as they were read; repeated rows are leaves of their own. Other columns, names
that clash included, are ignored; an empty table gives no rows. Texts are hashed
whole, where they are read, and never moved.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from regspark.session import fresh_path

#: Children of a node, and levels that one block of a task holds.
ARITY, HEIGHT = 16, 2
SPAN = ARITY ** HEIGHT

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<slot int, run array<binary>>>"


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: ``-`` for null, else byte count, colon and value of each."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, columns)), 256))


class Parent:
    """A node over a run of children: its digest, and the state before each slot."""

    __slots__ = ("before", "digest", "text")

    def __init__(self, children: Iterable[bytes]):
        state, self.before, text = sha256(), [], []
        for child in children:
            self.before.append(state.copy())
            text.append(child)
            state.update(child)
        self.text, self.digest = b"".join(text), _hex(state.digest())

    def folded(self, slot: int, child: bytes) -> bytes:
        """The digest with ``child`` in ``slot``."""
        state = self.before[slot].copy()
        state.update(child + self.text[64 * (slot + 1):])
        return _hex(state.digest())

    def siblings(self, slot: int) -> bytes:
        return self.text[:64 * slot] + self.text[64 * (slot + 1):]


def _hex(digest: bytes) -> bytes:
    return digest.hex().encode()


def levels(nodes: Sequence[bytes], height: int) -> list[list[Parent]]:
    """Parents of each level above ``nodes`` (digests as hex text): ``height`` of them."""
    found = []
    for _ in range(height):
        found.append([Parent(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [p.digest for p in found[-1]]
    return found


def height_of(size: int, total: int) -> int:
    """Levels that a block of ``size`` nodes builds in a group of ``total``."""
    if total > SPAN:
        return HEIGHT
    height = 0
    while size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, f"merkle-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with their ``place`` (from 0) in their ``group`` and its ``total``.

    Ranges along (group, order) are sorted and numbered apart; what comes before a
    range in its group is a sum over ranges, one row per range and group.
    """
    keys = ["group", *order]
    ranged = _stored(
        nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranges")
    found = ranged.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = found.select(
        F.col("group").alias("g"), F.col("part").alias("p"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(W.partitionBy("group")).alias("total"))
    same = F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))
    return ranged.join(parts, same).select(
        *nodes.columns, (F.col("at") + F.col("shift")).alias("place"), "total")


def _blocked(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """One row per block of a group: its members in order."""
    member = F.struct("place", "digest", *payload)
    return nodes.groupBy("group", F.floor(F.col("place") / SPAN).alias("block")).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))


def _tops(blocks: DataFrame) -> DataFrame:
    """The node each block ends in: nodes of the levels above."""
    def run(batches):
        for batch in batches:
            digests = []
            for total, members in zip(batch.column("total").to_pylist(), batch.column("members"), strict=True):
                nodes = [_hex(d) for d in members.values.field("digest").to_pylist()]
                height = height_of(len(nodes), total)
                digests.append(levels(nodes, height)[-1][0].digest if height else nodes[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("block"),
                 pa.array([-(-t // SPAN) for t in batch.column("total").to_pylist()], pa.int64()),
                 pa.array([bytes.fromhex(d.decode()) for d in digests], pa.binary())],
                ["group", "place", "total", "digest"])

    group = blocks.schema["group"].dataType.simpleString()
    return blocks.mapInArrow(run, f"group {group}, place long, total long, digest binary")


def _above(tops: DataFrame, most: int) -> DataFrame:
    """For each node (group, place): the runs on its way to the subroot, and that.

    ``most`` is the number of nodes in the largest group.
    """
    if most <= 1:
        return tops.select("group", "place", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    blocks = _stored(_blocked(tops), "level")
    upper = _above(_tops(blocks), -(-most // SPAN))

    def run(batches):
        for batch in batches:
            rows = []
            for group, total, members, path, top in zip(
                    batch.column("group").to_pylist(), batch.column("total").to_pylist(), batch.column("members"),
                    batch.column("path").to_pylist(), batch.column("top").to_pylist(), strict=True):
                members = members.values
                nodes = members.field("digest").to_pylist()
                runs = [nodes]
                hexed = levels([_hex(d) for d in nodes], height_of(len(nodes), total))
                for parents in hexed[:-1]:
                    runs.append([bytes.fromhex(p.digest.decode()) for p in parents])
                runs = runs[:len(hexed)]
                for at, place in enumerate(members.field("place").to_pylist()):
                    own = []
                    for level in runs:
                        first = at // ARITY * ARITY
                        own.append({"slot": at - first, "run": level[first:first + ARITY]})
                        at //= ARITY
                    rows.append((group, place, own + path, top))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (batch.column("group").type, pa.int64(), batch.column("path").type, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["group", "place", "path", "top"])

    kind = tops.schema["group"].dataType.simpleString()
    return _with_upper(blocks, upper).mapInArrow(run, f"group {kind}, place long, path {PATH}, top binary")


def _with_upper(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    upper = upper.select(F.col("group").alias("g"), F.col("place").alias("p"), "path", "top")
    same = F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("p"))
    return blocks.join(upper, same).drop("g", "p")


def _fold(batches, names: list[str], schema: pa.Schema, proofs: bool):
    """Rows of blocks to rows of leaves, each folded up to the root."""
    for batch in batches:
        for row in range(batch.num_rows):
            total, members, path, top, over, root = (
                batch.column(c)[row] for c in ("total", "members", "path", "top", "over", "root"))
            members = members.values
            nodes = [_hex(d) for d in members.field("digest").to_pylist()]
            own = levels(nodes, height_of(len(nodes), total.as_py()))
            steps = [*path.as_py(), *over.as_py()]
            upper = [(s["slot"], Parent(map(_hex, s["run"]))) for s in steps]
            beyond = b"".join(p.siblings(slot) for slot, p in upper)
            root, top = _hex(root.as_py()), _hex(top.as_py())
            tails: dict[int, bytes] = {}
            columns = [[] for _ in schema.names]
            for at, (node, other) in enumerate(zip(nodes, members.field("other").to_pylist(), strict=True)):
                digest, where = node if other is None else _hex(other), at
                for parents in own:
                    digest = parents[where // ARITY].folded(where % ARITY, digest)
                    where //= ARITY
                for slot, parent in upper:
                    digest = parent.folded(slot, digest)
                head = own[0][at // ARITY].siblings(at % ARITY) if own else b""
                run = at // ARITY
                if run not in tails:
                    where, parts = run, []
                    for parents in own[1:]:
                        parts.append(parents[where // ARITY].siblings(where % ARITY))
                        where //= ARITY
                    tails[run] = b"".join([*parts, beyond])
                proof = head + tails[run]
                values = [node.decode(), top.decode(), root.decode(), sha256(proof).hexdigest(), digest.decode(),
                          digest == root]
                if proofs:
                    values.append([proof[i:i + 64].decode() for i in range(0, len(proof), 64)])
                for column, value in zip(columns[1:], values, strict=True):
                    column.append(value)
            columns[0] = members.field("id")
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)],
                names)


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source",
             fields: Sequence[str] = FIELDS, tampered: Mapping[str, Column] | None = None,
             where: Column | None = None, proofs: bool = False) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and the root it folds to.

    A leaf is the digest of ``fields``. Rows ``where`` holds are verified with the
    columns of ``tampered`` in place of their own; all others with what they are.
    With ``proofs`` the sibling digests themselves are given too, from the leaf's
    run up to the root's. ``id_col`` is a number, by which rows are ordered.
    """
    spark: SparkSession = docs.sparkSession
    own = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("binary")
    if tampered:
        other = F.when(F.lit(True) if where is None else where, leaf([(own | dict(tampered))[c] for c in fields]))
    leaves = _stored(docs.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf(list(own.values())).alias("digest"),
        other.alias("other"), F.monotonically_increasing_id().alias("row")), "leaves")
    result = T.StructType([T.StructField(id_col, leaves.schema["id"].dataType)] + [
        T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    ] + [T.StructField("verified", T.BooleanType())] + (
        [T.StructField("proof", T.ArrayType(T.StringType()))] if proofs else []))

    blocks = _stored(_blocked(_numbered(leaves, ["id", "digest", "row"]), ["id", "other"]), "blocks")
    most = blocks.agg(F.max("total")).first()[0]
    if most is None:
        return spark.createDataFrame([], result)
    upper = _stored(_above(_tops(blocks), -(-most // SPAN)), "paths")

    # The groups' subroots are the leaves of one more tree.
    subroots = upper.where(F.col("place") == 0).select(
        F.lit(0).alias("group"), F.col("group").alias("name"), F.col("top").alias("digest"))
    numbered = _stored(_numbered(subroots, ["name"]), "subroots")
    groups = numbered.count()
    over = _stored(_above(numbered.select("group", "place", "total", "digest"), groups), "roots")
    named = numbered.select("place", "name").join(over, "place").select(
        "name", F.col("path").alias("over"), F.col("top").alias("root"))
    rows = _with_upper(blocks, upper).join(named, F.col("group").eqNullSafe(F.col("name"))).drop("name", "group")
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in result.fields])
    names = result.names
    return rows.mapInArrow(lambda batches: _fold(batches, names, kinds, proofs), result)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
