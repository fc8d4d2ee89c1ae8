"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Every text is hashed once into its word sequence (the node that equal texts share), the size of
   its set of five-word shingles and 32 band hashes of a densified one-permutation sketch.
2. Bands form buckets. The two members of a bucket of two are candidates. Members of larger buckets
   are sketched again, from their full sets, into 128 bands of 12 values: such buckets hold hardly
   more than true neighbours. A pair at the threshold shares none of 32 bands of four with a
   probability of 6e-11, and none of 128 bands of 12 with one of 3e-9.
3. A fine bucket yields a star: its centre paired with each other member, so pairs grow with the
   members, not with their square. The centre is the member that meets most others over all its
   buckets, such as the original among its edited copies.
4. Candidates are confirmed by an exact count over full sets; components of the confirmed links come
   from repeated joins with minimum labels.
5. A star misses links between two other members. Let d(x) be the symmetric difference of x and some
   reference. The difference of x and y is |d(x)| + |d(y)| - 2 |d(x) & d(y)|, so a member that doesn't
   link to the reference can link to another only if their differences share elements, and more than
   half of d(y) unless y is larger than the reference. Where a bucket holds members of several
   components, these differences are joined by their rarest elements, as many as that bound asks for,
   and a pair counts if enough elements follow the shared one in both. Pairs so found are confirmed
   like the others, and no other pair of a bucket can link.
6. The reference needn't be in the bucket: it is the first among the centres that the bucket's centre
   meets anywhere. So the buckets of edited copies share their original, and a member has one
   difference or a few, where it would have one for each of its buckets' centres.

Nodes are 64-bit hashes of word sequences. Sets, pairs and links stay in tables of the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import sketch as sk
from codeloom.llm.common import Scratch, kept_rows, map_arrow, replace_columns, table

#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85

OUTPUTS = ["n_shingles", "component_id", "kept"]


def _node(own: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(own), digest_size=8).digest(), "little", signed=True)


def _arrow_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, text -> row, doc_id, node, n_shingles, bands."""
    hasher = sk.Hasher()
    empty = np.empty(0, np.uint64)
    for batch in batches:
        nodes, sizes, bands = [], [], []
        for text in batch.column(2).to_pylist():
            own = sk.words(text)
            shingles = hasher.shingles(own)
            nodes.append(_node(own) if own else None)
            sizes.append(len(shingles))
            bands.append(sk.sketch(shingles) if own else empty)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _arrow_lists(bands)],
            names=["row", "doc_id", "node", "n_shingles", "bands"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, crowded, text -> node, crowded, shingles."""
    hasher = sk.Hasher()
    for batch in batches:
        sets = [hasher.shingles(sk.words(text)) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], _arrow_lists(sets)], names=["node", "crowded", "shingles"])


def _fine_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, shingles -> node, size, fine bands."""
    for batch in batches:
        column = batch.column(1)
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        rows = [sk.fine_sketch(flat[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), _arrow_lists(rows)], names=["node", "size", "bands"])


def _components(scratch: Scratch, name: str, links: DataFrame) -> DataFrame:
    """a, b -> node, root: the least node that can be reached, for every node with a link."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.put(f"{name}-edges", both)
    labels = scratch.put(f"{name}-0", both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hopped = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a label is a node too: take over the label that it has by now
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        turn += 1
        new = scratch.put(f"{name}-{turn}", hopped.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "root")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def _similar_sizes(a: str, b: str) -> Column:
    """A set much larger than the other cannot meet the threshold."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _pairs(rows: DataFrame) -> DataFrame:
    """node, size, other, other_size -> a, na, b, nb with a < b, each pair of similar sizes once."""
    ends = (F.struct(F.col("node").alias("n"), F.col("size").alias("s")), F.struct(F.col("other").alias("n"), F.col("other_size").alias("s")))
    near = rows.where(_similar_sizes("size", "other_size") & (F.col("node") != F.col("other")))
    low, high = F.least(*ends), F.greatest(*ends)
    return near.select(low["n"].alias("a"), low["s"].alias("na"), high["n"].alias("b"), high["s"].alias("nb")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, na, b, nb -> a, b: the pairs whose full sets meet the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= THRESHOLD * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _stars(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """The members of fine buckets, each with its bucket's centre: bucket, node, size, members, other, other_size, other_rank."""
    fine = map_arrow(sets.where("crowded").select("node", "shingles"), _fine_bands, "node bigint, size bigint, bands array<bigint>")
    fine = scratch.put("fine", fine.select("node", "size", F.explode("bands").alias("bucket")))
    shared = fine.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = scratch.put("buckets", fine.join(shared, "bucket"))
    scratch.drop("fine")
    met = buckets.groupBy("node").agg(F.sum("members").alias("met"))
    # one number orders by meetings, then by node
    ranked = buckets.join(met, "node").withColumn("rank", F.shiftleft("met", 20) + F.pmod("node", F.lit(1 << 20)))
    centres = ranked.groupBy("bucket").agg(F.max_by("node", "rank").alias("other"), F.max_by("size", "rank").alias("other_size"), F.max("rank").alias("other_rank"))
    stars = scratch.put("stars", buckets.join(centres, "bucket"))
    scratch.drop("buckets")
    return stars


def _open_pairs(scratch: Scratch, stars: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of members of a bucket in different components that may link, by their differences from a reference."""
    named = stars.where("members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("other").alias("centre")).where("low <> high")
    best = stars.groupBy("node").agg(F.max(F.struct("other_rank", "other", "other_size")).alias("best"))
    refs = several.join(best.withColumnRenamed("node", "centre"), "centre").select("bucket", "best.other", "best.other_size")
    members = named.drop("other", "other_size").join(refs, "bucket").select("node", "size", "root", "other", "other_size").distinct()
    of_ref = roots.select(F.col("node").alias("other"), F.col("root").alias("own"))
    apart = (F.col("root") != F.coalesce("own", "other")).alias("apart")
    members = members.where("node <> other").join(of_ref, "other", "left").select("node", "size", "root", "other", "other_size", apart)
    both = members.join(sets.select("node", F.col("shingles").alias("s")), "node").join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("c")), "other")
    both = both.withColumn("delta", F.concat(F.array_except("s", "c"), F.array_except("c", "s"))).drop("s", "c").withColumn("d", F.size("delta"))
    a, b = 100 + THRESHOLD, 100 - THRESHOLD
    # one end at least of an open pair lies outside the reference's component: that one asks, unless it
    # links to the reference, which is then a pair of its own
    linked = a * F.col("d") <= b * (F.col("size") + F.col("other_size"))
    both = both.withColumns({"asks": F.col("apart") & ~linked, "joins": F.col("apart") & linked}).drop("apart")
    deltas = scratch.put("deltas", both.select("*", F.explode("delta").alias("e")).drop("delta"))

    # only an element of members of several components, one of which asks, can open a pair
    common = deltas.groupBy("other", "e").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("asks").alias("asked"))
    common = common.where("low <> high and asked").select("other", "e", "n")
    own = Window.partitionBy("other", "node")
    # the other elements come first, so they needn't be listed to count places
    place = F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "e"))
    # the elements shared with any partner that doesn't link to the reference, and with any partner at all
    least_told = F.floor((a * F.col("d") - b * (F.col("size") - F.col("other_size"))) / (2 * a)) + 1
    least_asked = F.ceil((a * F.col("d") - b * (F.col("size") + F.col("other_size"))) / (a + b))
    ranked = deltas.join(common, ["other", "e"]).withColumn("place", place)
    ranked = ranked.withColumns({"told": F.col("place") <= F.col("d") - least_told + 1, "asked": F.col("asks") & (F.col("place") <= F.col("d") - least_asked + 1)})
    ranked = scratch.put("ranked", ranked.where("told or asked").select("other", "e", "node", "size", "root", "d", "place", "told", "asked"))
    asked = ranked.where("asked").select("other", "e", *(F.col(c).alias(f"x_{c}") for c in ("node", "size", "root", "d", "place")))
    # from the first shared element on, both differences must hold as many as the pair has to share
    room = 1 + F.least(F.col("d") - F.col("place"), F.col("x_d") - F.col("x_place"))
    enough = 2 * a * room >= a * (F.col("d") + F.col("x_d")) - b * (F.col("size") + F.col("x_size"))
    met = asked.join(ranked.where("told"), ["other", "e"]).where((F.col("x_root") != F.col("root")) & _similar_sizes("x_size", "size") & enough)
    met = met.select("node", "size", F.col("x_node").alias("other"), F.col("x_size").alias("other_size"))
    return _pairs(met.unionByName(deltas.where("joins").select("node", "size", "other", "other_size")))


def components(docs: DataFrame) -> DataFrame:
    """row, doc_id, text -> row, doc_id, n_shingles, component_id, kept; one row for each row.

    ``row`` is unique. ``docs`` must be a stable scan, such as a Parquet table: it is read twice.
    """
    scratch = Scratch(docs.sparkSession)
    schema = "row bigint, doc_id bigint, node bigint, n_shingles bigint, bands array<bigint>"
    sketches = scratch.put("sketches", map_arrow(docs.select("row", "doc_id", "text"), _sketches, schema))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = sketches.where("node is not null").groupBy("node")
    nodes = scratch.put("nodes", nodes.agg(first, F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")))

    rows = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("other"), F.min_by("size", "node").alias("other_size"), F.count(F.lit(1)).alias("members"))
    members = scratch.put("members", rows.join(shared.where("members > 1"), "bucket").drop("bucket"))
    wanted = members.groupBy("node").agg((F.max("members") > 2).alias("crowded")).join(nodes.select("node", F.col("first.row").alias("row")), "node")
    texts = docs.select("row", "text").join(wanted, "row").select("node", "crowded", "text")
    sets = scratch.put("sets", map_arrow(texts, _full_sets, "node bigint, crowded boolean, shingles array<bigint>"))

    stars = _stars(scratch, sets)
    pairs = scratch.put("pairs", _pairs(members.where("members = 2").drop("members").unionByName(stars.select("node", "size", "other", "other_size"))))
    scratch.drop("members")
    links = scratch.put("links", confirmed(pairs, sets))
    roots = _components(scratch, "roots", links)
    open_pairs = scratch.put("open-pairs", _open_pairs(scratch, stars, roots, sets).join(pairs, ["a", "na", "b", "nb"], "left_anti"))
    scratch.drop("deltas", "ranked", "stars", "pairs")
    further = scratch.put("further", confirmed(open_pairs, sets))
    scratch.drop("open-pairs", "sets")
    if further.limit(1).count():
        roots = _components(scratch, "all-roots", links.unionByName(further))

    least = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("best"))
    linked = roots.join(least, "root").select("node", "best")
    # only nodes with copies or links differ from their document
    told = nodes.where("copies > 1").select("node", "first").join(linked, "node", "full")
    told = scratch.put("told", told.select("node", F.coalesce("best", "first").alias("best")))
    scratch.drop("nodes", "links", "further")
    out = sketches.select("row", "doc_id", "node", "n_shingles").join(told, "node", "left")
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull() & F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with n_shingles, component_id and kept.

    A text without words has no shingles, links with nothing and is kept. component_id is the least
    id among the documents that can be reached over links, kept says whether it is the row's own, so
    rows that share that id are all kept. Rows without an id belong to the component of their text;
    only in a component without any id one of them is kept. Input columns named like an output are
    replaced. ``docs`` must be a stable scan, such as a Parquet table, because it is read more than
    once and its rows are told apart by their place in the scan.
    """
    docs = replace_columns(docs, OUTPUTS)
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    found = components(keyed.select(F.col("__row").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return keyed.join(found.select(F.col("row").alias("__row"), *OUTPUTS), "__row").select(*docs.columns, *OUTPUTS)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with the columns of ``docs``."""
    return kept_rows(docs, lambda d: annotate(d, id_col, text_col), OUTPUTS, "kept")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return components(docs).select("doc_id", *OUTPUTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_near_dedup": op9_near_dedup}

ORACLES = {
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                       lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
                WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
              FROM s a JOIN rare USING (g) JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
              WHERE 100 * i >= 85 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
        c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """
}
