"""Near-duplicate components: an inverted join over MinHash coordinates, confirmed on full shingle sets.

Documents with equal shingle sets form one class. A class has ``COORDINATES`` signature coordinates, each made of the
minima of two permutations; each (coordinate, value) is a posting list. Two sets of similarity 0.8 agree in a coordinate
with probability 0.64, and in at least ``MATCHES`` of them with all but about one chance in a hundred thousand, while
sets that merely use the same common words hardly agree at all. Values that no other class has are dropped, classes with
fewer than ``MATCHES`` shared values have no partner, and the others post only their prefix: so many of their rarest
values that two lists of ``MATCHES`` common values must meet in one. Who meets is compared on full sets:
100 * intersection >= threshold * union.

Links are found in three rounds, each skipping pairs that are already in one component: every class with the best hub
of its lists (the class with the fewest values of its own), every class with the hub of each list, then whatever is
left in lists that still hold several components, by an exact prefix join of their full sets with bounds on where they
meet. So a group of n near copies costs about n comparisons, and no link between different components is left out.

Texts without words have the empty set and are linked with nothing; fewer words than a shingle make one shingle. In
``components_of`` rows that share a doc_id tie their sets together. Null ids take part in nothing, have a null component and are kept. Empty
tables give no rows. Clashing extra columns are kept, working names avoid them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import LOWER, MULTIPLIER, NOT_SPACE, append_columns, blocks, fresh, mix64, words, words_of_rows
from chatmill.session import materialise, shared_dir

COORDINATES, MATCHES = 32, 9
FILTER_BITS = 26  # of the filter that thins the texts before their sets are built: 8 MB at most
FACTORS = np.random.default_rng(2024).integers(0, 1 << 63, 2 * COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, _, data, offsets in blocks(texts):
        starts, _, hashes = words(LOWER[data], NOT_SPACE)
        at = words_of_rows(starts, offsets)
        run = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                run = mix64(run * MULTIPLIER + hashes[i : i + len(run)])
            for a, b in zip(at[:-1], at[1:]):
                if b - a >= size:
                    yield np.unique(run[a : b - size + 1])
                elif b > a:
                    one = np.full(1, b - a, dtype=np.uint64)
                    for h in hashes[a:b]:
                        one = mix64(one * MULTIPLIER + h)
                    yield one
                else:
                    yield run[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Keys of the set's posting lists: the minima of each coordinate's two permutations, told apart by coordinate."""
    least = np.full(2 * COORDINATES, ~np.uint64(0))
    for lo in range(0, len(shingles), 4096):  # a long text's set in pieces
        least = np.minimum(least, (FACTORS[:, None] * shingles[None, lo : lo + 4096]).min(axis=1))
    return mix64(mix64(least[::2] ^ PLACES) * MULTIPLIER + least[1::2])


def name_of(shingles: np.ndarray) -> int:
    """The set's identity, independent of order."""
    return int(mix64(shingles ^ MULTIPLIER).sum(dtype=np.uint64).astype(np.int64)) if len(shingles) else 0


def sign(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, id, keys): id names the set; it and the keys are null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, keys = [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(b.column(1), size):
                    n.append(len(s))
                    ids.append(name_of(s) if len(s) else None)
                    keys.append(signature(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "id", "keys"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return source.mapInArrow(run, "doc_id long, n_shingles long, id long, keys array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """(id, n, doc, alone, key) of the prefix: the rarest of each class's shared values, enough for MATCHES common ones to meet."""
    every = classes.select("id", "n", "doc", F.explode("keys").alias("key"))
    lists = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").withColumnRenamed("key", "_key")
    shared = every.join(lists, F.col("key") == F.col("_key")).groupBy("id", "n", "doc").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("v"))  # COORDINATES values
    prefix = F.slice("v", F.lit(1), F.size("v") - (MATCHES - 1))
    kept = shared.filter(F.size("v") >= MATCHES).select("id", "n", "doc", (COORDINATES - F.size("v")).alias("alone"), F.explode(prefix).alias("p"))
    return kept.select("id", "n", "doc", "alone", F.col("p.key").alias("key"))


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``column``: joins on it move the other side only."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def full_sets(docs: DataFrame, members: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(id, shingles) of the given classes (id, doc), each from the text of one document that has it.

    A bit filter of fixed size over the documents' ids thins the texts in place; those it lets through wrongly are
    dropped by the join.
    """
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    bits = members.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {1 << FILTER_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[bits["w"].to_numpy(dtype=np.int64)] = bits["b"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            keep = np.flatnonzero((shared.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1))
            if len(keep):
                with np.errstate(over="ignore"):
                    sets = list(shingle_sets(b.column(2).take(pa.array(keep)), size))
                    ids = [name_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep)), pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc", "id", "shingles"])

    doc = F.col("doc_id").cast("long").alias("doc")
    found = docs.filter(F.col("doc_id").isNotNull()).select(doc, F.col(text).alias("_text")).select(place.alias("at"), "doc", "_text").mapInArrow(run, "doc long, id long, shingles array<long>")
    wanted = members.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"))
    # rows of one doc_id and text are the same set: one of them
    return found.join(wanted, (F.col("id") == F.col("_id")) & (F.col("doc") == F.col("_doc"))).select("id", "shingles").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Only the few sets of the b side move; a hot b can be split."""
    pairs = materialise(pairs, "pairs")
    right = materialise(sets.join(pairs.select("b").distinct(), F.col("id") == F.col("b"), "left_semi"), "hub-sets")
    left = pairs.join(sets.select(F.col("id").alias("a_id"), F.col("shingles").alias("a_set")), F.col("a") == F.col("a_id"))
    both = left.join(right.select(F.col("id").alias("b_id"), F.col("shingles").alias("b_set")), F.col("b") == F.col("b_id"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(100 * common >= threshold * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")


def connect(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of the edges (a, b): alternating large and small stars until nothing changes."""
    now, last = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "_a")
        large = both.join(least, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select("b", "m").filter("b <> m").withColumnRenamed("b", "a").withColumnRenamed("m", "b")
        now = materialise(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")  # roots are not listed
        last = state


def labelled(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """``members`` with their component so far: their own id if they have no link."""
    if components is None:
        return members.withColumn("component", F.col("id"))
    c = components.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return members.join(c, F.col("id") == F.col("_id"), "left").withColumn("component", F.coalesce("_component", "id")).drop("_id", "_component")


def prefix_pairs(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): all pairs of members (id, component) in different components that may reach the threshold.

    Shingles are ordered by rarity among the members. Sets this similar share one within a short prefix of each; where
    the pair meets bounds the intersection, so common shingles that many copies share lead to no pair.
    """
    own = sets.join(members.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("id", "component", F.size("shingles").alias("n"), "shingles")
    each = own.select("id", "component", "n", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1").withColumnRenamed("s", "_s")
    shared = each.join(counts, F.col("s") == F.col("_s")).groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("v"))  # a text's shingles
    # those that one set alone has come first in the order; they take places but lead nowhere
    placed = shared.select("id", "component", "n", F.size("v").alias("m"), F.posexplode("v").alias("i", "p")).select("id", "component", "n", F.col("p.s").alias("s"), (F.col("n") - F.col("m") + F.col("i")).alias("at"))
    probe = materialise(placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold / 100)), "prefixes")
    index = probe.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * threshold / (100 + threshold)))
    y = index.select(*[F.col(c).alias(f"{c}2") for c in index.columns])
    smaller = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("id2") < F.col("id")))
    room = (100 + threshold) * F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= threshold * (F.col("n") + F.col("n2"))
    near = smaller & (100 * F.col("n2") >= threshold * F.col("n")) & (F.col("component") != F.col("component2")) & room
    return probe.join(y, (F.col("s") == F.col("s2")) & near).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def link(docs: DataFrame, classes: DataFrame, sure: DataFrame, size: int, threshold: int, text: str) -> DataFrame:
    """(id, component) of the classes that are linked with another."""
    posted = materialise(postings(classes), "postings")
    sets = bucketed(full_sets(docs, posted.select("id", "doc").distinct(), size, text), "sets", "id")
    lists = posted.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("_key"))
    members = materialise(posted.drop("doc").join(lists, F.col("key") == F.col("_key")).drop("_key"), "members")
    hubs = members.groupBy("key").agg(F.min(F.struct("alone", "id", "n")).alias("hub"))
    hubs = materialise(hubs.select(F.col("key").alias("_key"), F.col("hub.id").alias("hub"), F.col("hub.alone").alias("hub_alone"), F.col("hub.n").alias("hub_n")), "hubs")
    fits = (100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")) & (F.col("id") != F.col("hub"))
    met = members.join(hubs, (F.col("key") == F.col("_key")) & fits)
    best = materialise(met.groupBy("id").agg(F.min(F.struct("hub_alone", "hub")).alias("h")).select(F.col("id").alias("a"), F.col("h.hub").alias("b")), "best")

    edges, components = sure, None
    edges = materialise(edges.unionByName(confirmed(best, sets, threshold)), "links")
    components = connect(edges)

    now = labelled(members, components)
    hub_component = labelled(hubs.withColumnRenamed("hub", "id"), components).select(F.col("_key").alias("_k"), F.col("id").alias("hub"), "hub_n", F.col("component").alias("hub_component"))
    apart = now.join(hub_component, (F.col("key") == F.col("_k")) & (F.col("component") != F.col("hub_component")) & fits)
    pairs = apart.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    more = materialise(confirmed(pairs, sets, threshold), "links")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        components = connect(edges)

    now = materialise(labelled(members, components), "members")
    split = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select(F.col("key").alias("_key"))
    left = materialise(now.join(split, F.col("key") == F.col("_key")).select("id", "component").distinct(), "left")
    more = materialise(confirmed(prefix_pairs(left, sets, threshold), sets, threshold), "links")
    if not more.isEmpty():
        components = connect(edges.unionByName(more))
    return components


def _classes(known: DataFrame) -> DataFrame:
    """The distinct sets, each with a document that has it."""
    return known.filter("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))


def components_of(docs: DataFrame, words_per_shingle: int = 5, threshold: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    signed = materialise(sign(docs, words_per_shingle, text), "signed")
    known = signed.filter(F.col("doc_id").isNotNull())
    classes = _classes(known)
    rows = known.select("doc_id", "n_shingles", "id")
    # a doc_id with several sets ties them together
    several = rows.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("m")).filter("b <> m").select(F.col("doc_id").alias("_d"), "b")
    sure = rows.filter("id IS NOT NULL").join(several, F.col("doc_id") == F.col("_d")).select(F.col("id").alias("a"), "b").distinct()
    found = labelled(rows, link(docs, materialise(classes, "classes"), sure, words_per_shingle, threshold, text))
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("first")).withColumnRenamed("component", "_c")
    named = found.join(first, F.col("component") == F.col("_c"), "left").withColumn("component_id", F.coalesce("first", "doc_id"))
    nulls = signed.filter(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return named.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).unionByName(nulls)


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 5, threshold: int = 80, text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, and all without an id; with their own columns.

    Here texts are linked, not ids: rows of one id whose texts are not alike are documents of their own. Of rows with one id
    and the same shingles the one with the smallest text stays; rows without a shingle all stay.
    """
    signed = materialise(sign(docs, words_per_shingle, text), "signed")
    known = signed.filter(F.col("doc_id").isNotNull())
    no_ties = known.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    rows = labelled(known.select("doc_id", "id"), link(docs, materialise(_classes(known), "classes"), no_ties, words_per_shingle, threshold, text))
    first = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("first")).select("first.doc_id", "first.id")
    wordless = rows.filter("component IS NULL").select("doc_id", F.lit(None).cast("long").alias("id")).distinct()
    kept = materialise(first.unionByName(wordless), "kept")
    several = materialise(known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    doc, cls = fresh(docs, "_doc", "_class")
    own = F.col("doc_id").cast("long")
    single = kept.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias(doc))
    out = docs.filter(F.col("doc_id").isNull()).unionByName(docs.join(single, own == F.col(doc), "left_semi"))
    if several.isEmpty():
        return out
    again = append_columns(docs.join(several.withColumnRenamed("doc_id", doc), own == F.col(doc), "left_semi"), text, [T.StructField(cls, T.LongType())], lambda x: [_names_of(x, words_per_shingle)])
    mine = kept.select(F.col("doc_id").alias(doc), F.col("id").alias(f"{cls}_r"))
    left = again.join(mine, (own == F.col(doc)) & F.col(cls).eqNullSafe(F.col(f"{cls}_r")), "left_semi")
    one = left.filter(F.col(cls).isNotNull()).groupBy("doc_id", cls).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{text}`")).alias("r")).select("r.*")
    return out.unionByName(one).unionByName(left.filter(F.col(cls).isNull()).drop(cls))


def _names_of(texts: pa.Array, size: int) -> pa.Array:
    """The class of each text: the name of its set, null without shingles."""
    with np.errstate(over="ignore"):
        return pa.array([name_of(s) if len(s) else None for s in shingle_sets(texts, size)], pa.int64())
