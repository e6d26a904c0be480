"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

Every text is the set of its 5-word shingles. All sets follow one order of
tokens: frequent ones last, the rest by hash. Two sets of the wanted similarity
share a token within their prefixes; if both prefixes are longer by k tokens,
they share at least k more there. A document's prefix is lengthened where that
costs less than verifying the candidates it spares: where its prefix holds
frequent tokens. The passes are

1. per document, the size and key of its set, and local counts of tokens; those
   that make up at least 2^-22 of all tokens are the frequent ones (so there are
   at most 2^22, which go to all tasks);
2. prefix tokens, dealt by token; those of a single set go;
3. pairs that meet under a token at places from which enough of both sets can
   still be shared. Under a token of many sets, all meet a few of them first;
   later only sets of different components do, the largest one left out on one
   side, so a large group of copies never makes all its pairs. There every set
   has its parities with it, a bit per token (the parity of how many tokens fall
   on a bit): two sets differ in at least as many tokens as their parities do in
   bits, so most pairs of sets that only share a passage are never made;
4. a pair must share the tokens its prefixes require, and the bit maps of its
   sets must leave the similarity possible; then the sets are compared in full.

Each test excludes only pairs that cannot be similar, so every link between
different sets is found unless both are already known to be in one component.

Equal sets are one set from pass 2 on, so exact copies cost one row each. A set
is known by a 64-bit key and a token by a 64-bit hash.

Texts without words (null, empty) have no shingles and are linked with nothing;
so are rows with a null id, whose component is null. Fewer than five words are
one shingle. Repeated rows are copies of each other; rows of one id but
different text are sets of their own. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regspark.llm import arrays
from regspark.session import fresh_path

SHINGLE = 5
#: Similarity as a fraction.
ABOVE, BELOW = 75, 100
#: Share of all tokens that makes a token frequent, as a power of one half.
FREQUENT_BITS = 22
#: A token is counted as frequent from this many sets on, in any corpus.
LEAST_FREQUENT = 16
#: Tokens counted together in a task, and the count from which they are reported.
COUNTED, LEAST_COUNT = 1 << 23, 2
#: The longest extension of a prefix, in tokens.
LONGEST = 8
#: Sets under a token from which they don't all meet at once, and about how many
#: of them meet all others first. Tokens of one of PIVOT_KINDS kinds prefer the
#: same sets, so a group that shares many tokens has few of them.
MANY, PIVOTS, PIVOT_KINDS = 16, 2, 8
#: Ranks from which, in turn, sets of other components meet the rest; the last
#: meeting also makes up for ranks that a set has not met while in the main component.
MEETINGS = (PIVOTS, 16)
#: The most bits of a set's parities; larger sets are told apart by their bit maps.
MOST_PARITIES = 1 << 12
#: Ids sent to all tasks; more are joined by shuffling.
SENT_IDS = 1 << 21


def token_sets(data: np.ndarray, off: np.ndarray):
    """Sorted distinct shingle hashes of each row."""
    starts, ends, rows = arrays.words(data, off, arrays.NOT_SPACE)
    hashes = arrays.word_hashes(data, starts, ends)
    shingles = arrays.windows(hashes, SHINGLE)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(shingles[a:b - SHINGLE + 1])
        elif b > a:
            yield arrays.windows(hashes[a:b], b - a) + np.uint64(b - a)
        else:
            yield hashes[:0]


def set_key(tokens: np.ndarray) -> int:
    """A hash of the set, as a signed long."""
    total = arrays.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(arrays.mix(np.array([total + np.uint64(len(tokens))]))[0].astype(np.int64))


def prefix(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set in the global order, and its extension (1: none)."""
    n = len(tokens)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[at] == tokens
        weight = counts[at[common]]
        order = np.lexsort((tokens[common], weight))
        ordered, weight = np.concatenate([tokens[~common], tokens[common][order]]), weight[order]
    else:
        ordered, weight = tokens, np.zeros(0, np.int64)
    shared = -(-ABOVE * n // BELOW)
    first = n - shared + 1
    met = first - (n - len(weight))
    if met < 1:
        return ordered[:first], 1
    longest = min(LONGEST, shared)
    rows = np.cumsum(weight)[met - 1:met - 1 + longest].astype(float)
    cost = rows * (1 + n / np.arange(1, longest + 1))
    more = int(cost.argmin()) + 1
    return ordered[:first + more - 1], more


def bit_map(tokens: np.ndarray) -> list[int]:
    """8 to 16 bits per token, a power of two in all, as 64-bit words."""
    bits = max(64, 1 << (8 * len(tokens) - 1).bit_length())
    word = np.zeros(bits // 64, np.uint64)
    place = tokens & np.uint64(bits - 1)
    np.bitwise_or.at(word, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return word.astype(np.int64).tolist()


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of tokens falls on it, as 64-bit words.

    One to two bits per token, a power of two in all, up to MOST_PARITIES.
    """
    bits = min(MOST_PARITIES, max(64, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(p: Column, q: Column) -> Column:
    """The bits in which two sets' parities differ; their sets differ in as many tokens or more.

    The wider parities are folded to the width of the others.
    """
    def folded(bits, other):
        return F.aggregate(F.sequence(F.lit(1), F.floor(F.size(bits) / F.size(other)).cast("int") - 1),
                           F.slice(bits, F.lit(1), F.size(other)),
                           lambda x, i: F.zip_with(x, F.slice(bits, i * F.size(other) + 1, F.size(other)),
                                                   lambda a, b: a.bitwiseXOR(b)))

    def count(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)

    return F.when(F.size(p) == F.size(q), count(p, q)).when(
        F.size(p) > F.size(q), count(folded(p, q), q)).otherwise(count(p, folded(q, p)))


def overlap_needed(n: Column, m: Column) -> Column:
    """The least intersection of similar sets of sizes ``n`` and ``m``."""
    return F.ceil(F.lit(ABOVE) * (n + m) / F.lit(ABOVE + BELOW))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _batch(kinds: str, *columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    names = [k.split() for k in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, names, strict=True)],
                                      [n for n, _ in names])


SIZES = "doc_id long, n int, key long, token long, count long, parity array<long>"


def _sizes(texts: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, key; parity, once a task for each set), and rows of counted tokens."""
    def run(batches):
        held, size, seen = [], 0, set()

        def counted():
            tokens, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            often = count >= LEAST_COUNT
            return tokens[often].astype(np.int64).tolist(), count[often].tolist()

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [], [])
            for row, data, off in arrays.blocks(batch.column(1)):
                for i, tokens in enumerate(token_sets(data, off), row):
                    key = set_key(tokens) if len(tokens) and ids[i] is not None else None
                    new = key is not None and key not in seen
                    for column, value in zip(out, (ids[i], len(tokens), key, None, None,
                                                   parities(tokens) if new else None), strict=True):
                        column.append(value)
                    if new:
                        seen.add(key)
                        held.append(tokens)
                        size += len(tokens)
                if size >= COUNTED:
                    tokens, count = counted()
                    none = [None] * len(tokens)
                    yield _batch(SIZES, none, none, none, tokens, count, none)
                    held, size, seen = [], 0, set()
            yield _batch(SIZES, *out)
        tokens, count = counted()
        none = [None] * len(tokens)
        yield _batch(SIZES, none, none, none, tokens, count, none)

    return texts.mapInArrow(run, SIZES)


def _frequent(counted: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and their counts; at most 2^FREQUENT_BITS."""
    least = max(LEAST_FREQUENT, -(-total >> FREQUENT_BITS))
    found = counted.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= least).toPandas()
    tokens = found["token"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["count"].to_numpy(np.int64)[order]


#: ``at`` is the set's size and the token's place, 32 bits each. Of the token's
#: hash 48 bits do: tokens that share them only make a candidate more.
PREFIXES = "token long, key long, at long"


def _prefixes(texts: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Prefix tokens with the set's key and size, and their place."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, data, off in arrays.blocks(batch.column(1)):
                found, keys, at, seen = [], [], [], set()
                for i, tokens in enumerate(token_sets(data, off), row):
                    if not len(tokens) or not ids[i].is_valid or (key := set_key(tokens)) in seen:
                        continue
                    seen.add(key)
                    ordered, _ = prefix(tokens, frequent, counts)
                    found.append((ordered >> np.uint64(16)).astype(np.int64))
                    keys.append(np.full(len(ordered), key))
                    at.append((len(tokens) << 32) + np.arange(len(ordered)))
                if found:
                    yield _batch(PREFIXES, *(np.concatenate(c) for c in (found, keys, at)))

    return texts.mapInArrow(run, PREFIXES)


MAPS = "key long, n int, more int, prefix array<long>, bits array<long>"


def _maps(texts: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Bit map of each set; the prefix only where it is extended."""
    def run(batches):
        for batch in batches:
            for _, data, off in arrays.blocks(batch.column(1)):
                out = ([], [], [], [], [])
                for tokens in token_sets(data, off):
                    if len(tokens):
                        ordered, more = prefix(tokens, frequent, counts)
                        for column, value in zip(out, (
                                set_key(tokens), len(tokens), more,
                                ordered.astype(np.int64).tolist() if more > 1 else [], bit_map(tokens)), strict=True):
                            column.append(value)
                yield _batch(MAPS, *out)

    return texts.mapInArrow(run, MAPS)


SETS = "key long, tokens array<long>"


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, data, off in arrays.blocks(batch.column(1), 1 << 19):
                found = [t for t in token_sets(data, off) if len(t)]
                yield _batch(SETS, [set_key(t) for t in found], [t.astype(np.int64) for t in found])

    return texts.mapInArrow(run, SETS)


class _Join:
    """The passes over one table.

    Every step is written to the shared folder; all but the sizes and the last
    roots are removed at the end.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        self.texts = _texts(docs, id_col, text_col)
        self.written: list[tuple[str, str]] = []
        first = self.kept(_sizes(self.texts), "sizes")
        self.members = first.where(F.col("token").isNull()).select("doc_id", "n", "key")
        self.parity = first.where(F.col("parity").isNotNull()).select("key", "parity").dropDuplicates(["key"])
        total = self.members.agg(F.sum("n")).first()[0] or 0
        self.order = _frequent(first.where(F.col("token").isNotNull()), total)
        self.met = self.kept(self._met(), "prefixes")
        self.roots = None

    def kept(self, frame: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, f"ngrams-{label}")
        frame.write.parquet(path)
        self.written.append((label, path))
        return self.spark.read.parquet(path)

    def tidy(self) -> None:
        """Removes what the result does not read."""
        roots = [path for label, path in self.written if label == "roots"][-1:]
        context = self.spark.sparkContext
        for label, path in self.written:
            if label != "sizes" and path not in roots:
                place = context._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

    def _met(self) -> DataFrame:
        """Prefix rows of tokens that at least two sets have, with their number."""
        token = Window.partitionBy("token")
        rows = _prefixes(self.texts, *self.order).withColumns(
            {"low": F.min("key").over(token), "high": F.max("key").over(token)}).where("low < high")
        rows = rows.drop("low", "high").dropDuplicates(["token", "key"])
        return rows.select("token", "key", F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND(
            F.lit((1 << 32) - 1)).alias("place"), F.count("*").over(token).alias("sets"))

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """Texts of one document for each set in ``pairs``."""
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = self.members.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id")) \
            .join(keys, "key", "left_semi").select("doc_id")
        ids = self.kept(ids, "ids")
        if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:
            ids = F.broadcast(ids)
        return self.texts.join(ids, "doc_id", "left_semi")

    def pairs(self, left: DataFrame, right: DataFrame, apart: Column | None = None) -> DataFrame:
        """Distinct pairs (a < b) of sets that meet where they can still be similar, and whose parities allow it."""
        u, v = left.alias("u"), right.alias("v")
        needed = overlap_needed(F.col("u.size"), F.col("v.size"))
        possible = F.least(F.col("u.size") - F.col("u.place"), F.col("v.size") - F.col("v.place")) >= needed
        meet = possible & (apart if apart is not None else F.col("u.key") < F.col("v.key"))
        if "parity" in left.columns:
            meet &= differing(F.col("u.parity"), F.col("v.parity")) <= F.col("u.size") + F.col("v.size") - 2 * needed
        joined = u.join(v, (F.col("u.token") == F.col("v.token")) & meet)
        return joined.select(F.least("u.key", "v.key").alias("a"), F.greatest("u.key", "v.key").alias("b")).distinct()

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that share enough of their prefixes and whose bit maps allow the similarity."""
        pairs = self.kept(pairs, "pairs")
        maps = self.kept(_maps(self.texts_of(pairs), *self.order).dropDuplicates(["key"]), "maps")
        x, y = (maps.select(*[F.col(c).alias(f"{c}_{s}") for c in maps.columns]) for s in "ab")
        both = pairs.join(x, F.col("a") == F.col("key_a")).join(y, F.col("b") == F.col("key_b"))

        def folded(bits, other):
            half = F.floor(F.size(bits) / 2).cast("int")
            return F.when(F.size(bits) > F.size(other), F.zip_with(
                F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(bits)

        def missing(bits, other):
            return F.aggregate(F.zip_with(bits, other, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))),
                               F.lit(0), lambda s, c: s + c)

        bits_a, bits_b = folded(F.col("bits_a"), F.col("bits_b")), folded(F.col("bits_b"), F.col("bits_a"))
        needed = overlap_needed(F.col("n_a"), F.col("n_b"))
        extended = F.least("more_a", "more_b")
        shared = F.when(extended > 1, F.size(F.array_intersect("prefix_a", "prefix_b"))).otherwise(1)
        return self.kept(both.where((shared >= extended) & (F.col("n_a") - missing(bits_a, bits_b) >= needed)
                                    & (F.col("n_b") - missing(bits_b, bits_a) >= needed)).select("a", "b"), "possible")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets are similar."""
        pairs = self.kept(pairs, "checked")
        sets = _sets(self.texts_of(pairs))
        x, y = (sets.select(F.col("key").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
        both = F.size(F.array_intersect("tokens_a", "tokens_b"))
        union = F.size("tokens_a") + F.size("tokens_b")
        similar = F.lit(BELOW) * both >= F.lit(ABOVE) * (union - both)
        return self.kept(pairs.join(x, "a").join(y, "b").where(similar).select("a", "b"), "links")

    def rooted(self, frame: DataFrame, *columns: str) -> DataFrame:
        """Adds the root of the set in each of ``columns``, as ``root_<column>``."""
        for c in columns:
            if self.roots is None:
                frame = frame.withColumn(f"root_{c}", F.col(c))
            else:
                roots = self.roots.select(F.col("key").alias(f"of_{c}"), F.col("root").alias(f"root_{c}"))
                frame = frame.join(roots, F.col(c) == F.col(f"of_{c}"), "left").withColumn(
                    f"root_{c}", F.coalesce(f"root_{c}", c)).drop(f"of_{c}")
        return frame

    def link(self, links: DataFrame) -> None:
        """Joins the components that ``links`` connect."""
        edges = self.rooted(links, "a", "b").where("root_a <> root_b").select(
            F.least("root_a", "root_b").alias("root"), F.greatest("root_a", "root_b").alias("key")).distinct()
        found = self.stars(edges)
        if self.roots is not None:
            new = found.select(F.col("key").alias("was"), F.col("root").alias("now"))
            old = self.roots.join(new, F.col("root") == F.col("was"), "left").select(
                "key", F.coalesce("now", "root").alias("root"))
            found = old.unionByName(found.select("key", "root")).groupBy("key").agg(F.min("root").alias("root"))
        self.roots = self.kept(found, "roots")

    def stars(self, edges: DataFrame) -> DataFrame:
        """Each key with the least key of its component, from edges (root < key).

        Large-star and small-star steps in turn, until nothing changes.
        """
        def state(frame):
            return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("root", "key").cast("decimal(38,0)"))).first())

        edges = self.kept(edges, "edges")
        was, now = None, state(edges)
        while was != now:
            both = edges.select(F.col("key").alias("u"), F.col("root").alias("v")).unionAll(
                edges.select(F.col("root").alias("u"), F.col("key").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
            large = both.join(least, "u").where("v > u").select("root", F.col("v").alias("key")).distinct()
            small = large.groupBy("key").agg(F.min("root").alias("m"))
            edges = large.join(small, "key").select(
                F.col("m").alias("root"), F.explode(F.array("key", "root")).alias("key")).where("root < key").distinct()
            edges = self.kept(edges, "edges")
            was, now = now, state(edges)
        return edges

    def apart(self, pairs: DataFrame) -> DataFrame:
        return self.rooted(pairs, "a", "b").where("root_a <> root_b").select("a", "b")

    def run(self) -> None:
        rank = F.pmod(F.xxhash64(F.pmod("token", F.lit(PIVOT_KINDS)), "key"), F.lit(1 << 31)) * F.col("sets") / F.lit(1 << 31)
        few = self.met.where(F.col("sets") <= MANY)
        many = self.kept(self.met.where(F.col("sets") > MANY).join(self.parity, "key"), "many")
        first = self.pairs(few, few).unionAll(
            self.pairs(many, many.where(rank < PIVOTS), F.col("u.key") != F.col("v.key"))).distinct()
        possible = self.possible(first)
        # A set meets the least of its candidates first; what that joins need not be compared again.
        nearest = possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        self.link(self.verified(nearest))
        self.link(self.verified(self.apart(possible.join(nearest, ["a", "b"], "left_anti"))))

        # ``met``: the set has met all others of lower rank, or is in their component. A set of the main
        # component may be outside the next one, and then still has those ranks before it.
        rows = many.withColumns({"rank": rank, "met": F.lit(PIVOTS)})
        for high in (*MEETINGS[1:], None):
            rooted = self.rooted(rows, "key")
            of_root = rooted.groupBy("token", "root_key").agg(F.count("*").alias("n"))
            main = of_root.groupBy("token").agg(F.max_by("root_key", F.struct("n", "root_key")).alias("main"),
                                                F.count("*").alias("roots")).where("roots > 1").drop("roots")
            rooted = self.kept(rooted.join(main, "token"), "many")
            others = F.col("rank") >= PIVOTS if high is None else (F.col("rank") >= PIVOTS) & (F.col("rank") < high)
            rest = self.pairs(rooted.where("root_key <> main"), rooted.where(others),
                              (F.col("u.root_key") != F.col("v.root_key")) & (F.col("v.rank") >= F.col("u.met")))
            self.link(self.verified(self.possible(rest)))
            if high is not None:
                rows = rooted.withColumn("met", F.when(F.col("root_key") != F.col("main"), high).otherwise(
                    F.col("met"))).drop("root_key", "main")
        self.tidy()

    def result(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every document."""
        rooted = self.rooted(self.members, "key")
        least = rooted.where(F.col("root_key").isNotNull()).groupBy("root_key").agg(F.min("doc_id").alias("least"))
        return rooted.join(least, "root_key", "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id linked, itself included).

    Documents link when the intersection of their shingle sets is at least
    ABOVE / BELOW of their union.
    """
    join = _Join(docs, id_col, text_col)
    join.run()
    return join.result()


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of least id of every component, with all its columns.

    Of repeated rows one stays. Rows of one id but different text stay or go
    together; they stay if any of them is the least of its component.
    """
    found = components(docs, id_col=id_col, text_col=text_col)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    kept = docs.join(ids.where("NOT stays").select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
    if ids.where("stays AND n > 1").limit(1).count() == 0:
        return kept
    return kept.where(F.col(id_col).isNull()).unionByName(
        kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]))
