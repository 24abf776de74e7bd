"""Near-duplicate embeddings by NN-descent on a neighbour graph started from random hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import components, release, stored
from mediaops.llm.grouped import spanning_edges, stream_groups
from mediaops.llm.topk import clean
from mediaops.llm.words import mix

#: Neighbours kept for each vector at first, and at most where a list is saturated (its last entry still
#: a link); trees of the first graph, the size of their leaves and the neighbours taken from each;
#: updates a vector takes from one meeting.
K, MOST_K, TREES, LEAF, FROM_LEAF, UPDATES = 8, 16, 12, 128, 4, 3
#: Vectors compared at once in the descent, where links of whole components are counted, and in the exact pass.
BLOCK, COUNT_BLOCK, EXACT_BLOCK = 512, 2048, 2048
#: The descent ends when a round changes a smaller share of the lists' entries. What it leaves undone
#: the audit sees.
CHANGED = 0.05
#: Hyperplanes drawn at once to part a group that is too large; vectors of one direction do not
#: differ by more along any of them.
PLANES, SAME = 6, 1e-9
#: The audit compares hashed probes with all vectors: so many in its first round, at most so many in
#: one round, until so many of them hold a true link. Above the share of all vectors it gives up
#: (small tables are probed whole). The recall it asks for.
PROBES, ROUND, LINKED, SHARE, MIN_RECALL = 256, 4096, 300, 1 / 8, 0.95


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision. Each is divided by its greatest component first, so that no
    square overflows or vanishes."""
    x = column.combine_chunks()
    x = x.flatten().to_numpy().astype(float).reshape(len(x), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(seed: list[int], d: int, bits: int) -> np.ndarray:
    return np.random.default_rng([*seed, d]).normal(size=(d, bits))


def by_length(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, places, unit vectors) for the vectors of each length of a batch."""
    length = np.diff(v.offsets.to_numpy())
    for d in np.unique(length).tolist():
        own = np.flatnonzero(length == d)
        yield d, own, matrix(pa.chunked_array([v.take(pa.array(own))]))


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Length -> mean of the unit vectors of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, own, x in by_length(batch.column(0)):
                n, s = total.get(d, (0, 0.0))
                total[d] = (n + len(own), s + x.sum(0))
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64()))], ["d", "n", "s"])

    out: dict[int, list] = {}
    for r in vectors.select("v").mapInArrow(run, "d long, n long, s array<double>").toLocalIterator():
        n, s = out.get(r.d, (0, 0.0))
        out[r.d] = (n + r.n, s + np.array(r.s))
    return {d: s / n for d, (n, s) in out.items()}


def leaves(vectors: DataFrame, bits: int, seed: int) -> DataFrame:
    """(leaf, tree, id): the cell of each vector under ``bits`` random hyperplanes through the mean
    of all vectors, for TREES draws."""
    centre = vectors.sparkSession.sparkContext.broadcast(means(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, own, x in by_length(batch.column(1)):
                x = x - centre.value[d]
                for t in range(TREES):
                    cell = ((x @ directions([seed, t], d, bits) > 0) << np.arange(bits)).sum(1).astype(np.uint64)
                    leaf = mix(mix(cell) + np.uint64(d * TREES + t)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.full(len(own), t, np.int32)), pa.array(ids[own])], ["leaf", "tree", "id"])

    return vectors.select("id", "v").mapInArrow(run, "leaf long, tree int, id long")


def parted(members: DataFrame, vectors: DataFrame, block: int, fill: int, seed: int) -> DataFrame:
    """(grp, id) of (grp, tree, id) with no group above ``block``: a larger one is parted by random
    hyperplanes through its own mean into cells of about ``fill`` rows, again and again until all
    fit. Only vectors of one direction cannot be parted (no spread along any draw); these are
    dealt by hash, each block with the group's least id, to which all of them are equal."""
    done, turn = [], 0
    while True:
        sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
        done.append(members.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= block)).select("grp"), "grp").select("grp", "id"))
        large = sizes.filter(F.col("n") > block)
        if not large.limit(1).count():
            break

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree, p = batch.column(1).to_numpy(), np.zeros((batch.num_rows, PLANES))
                for d, own, x in by_length(batch.column(4)):
                    for t in np.unique(tree[own]).tolist():
                        at = tree[own] == t
                        p[own[at]] = x[at] @ directions([seed, t, 1 + turn], d, PLANES)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(p[:, j]) for j in range(PLANES)]], ["grp", "tree", "id", "n", *[f"p{j}" for j in range(PLANES)]])

        names = [f"p{j}" for j in range(PLANES)]
        rows = members.join(large, "grp").join(vectors.select("id", "v"), "id").select("grp", "tree", "id", "n", "v")
        sides = stored(rows.mapInArrow(run, "grp long, tree int, id long, n long, " + ", ".join(f"{p} double" for p in names)), "sides")
        spread = F.greatest(*[F.max(p) - F.min(p) for p in names])
        own = sides.groupBy("grp").agg(*[F.avg(p).alias(f"mean_{p}") for p in names], spread.alias("spread"), F.min("id").alias("pivot"))
        sides = sides.join(own, "grp")
        blocks = F.ceil(F.col("n") / F.lit(block - 1)).cast("int")
        equal = sides.filter(F.col("spread") <= SAME)
        equal = equal.filter("id <> pivot").withColumn("blk", F.pmod(F.xxhash64("id"), blocks)).unionByName(equal.filter("id = pivot").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))))
        done.append(stored(equal.select(F.xxhash64("grp", "blk").alias("grp"), "id"), "equal-parts"))
        cell = F.lit(0)
        for j, p in enumerate(names):
            used = F.col("n") > F.lit(fill * 2**j)
            cell = cell + F.when(used & (F.col(p) > F.col(f"mean_{p}")), 2**j).otherwise(0)
        members = stored(sides.filter(F.col("spread") > SAME).select(F.xxhash64("grp", cell).alias("grp"), "tree", "id"), "parts")
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def best(pairs: DataFrame) -> DataFrame:
    """The neighbour graph (id, nb, s, k, fresh): of each id the pairs with the greatest s, as many as
    the greatest ``k`` of its rows says, ties to the smaller nb. ``fresh`` is 1 only where all rows
    of the pair are."""
    once = pairs.groupBy("id", "nb").agg(F.max("s").alias("s"), F.max("k").alias("k"), F.min("fresh").alias("fresh"))
    ranked = once.groupBy("id").agg(F.max("k").alias("k"), F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "nb", "fresh"))).alias("x"))
    ranked = ranked.select("id", "k", F.explode(F.slice("x", F.lit(1), F.col("k"))).alias("x"))
    return ranked.select("id", F.col("x.nb").alias("nb"), (-F.col("x.d")).alias("s"), "k", F.col("x.fresh").alias("fresh"))


def enlarged(graph: DataFrame, threshold: float) -> DataFrame | None:
    """The graph with twice the ``k`` for every list that is saturated, whose entries become fresh and
    all others old, so that the descent goes on around them; None if no list is."""
    full = graph.groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("most"), F.min("s").alias("least"))
    full = stored(full.filter((F.col("n") >= F.col("most")) & (F.col("most") < MOST_K) & (F.col("least") >= threshold)).select("id", F.lit(1).alias("more")), "saturated")
    if not full.limit(1).count():
        return None
    more = F.coalesce("more", F.lit(0))
    return stored(graph.join(full, "id", "left").select("id", "nb", "s", (F.col("k") * (1 + more)).cast("int").alias("k"), more.cast("int").alias("fresh")), "graph")


def meetings(groups: DataFrame, keys: list[str], take: int) -> DataFrame:
    """Compare all rows (id, v, floor) of each group; (id, nb, s) for the ``take`` best neighbours of
    each row that are above its floor."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        ids = rows["id"].to_numpy()
        if len(ids) < 2:
            return None
        x = matrix(rows["v"])
        s = x @ x.T
        s[ids[:, None] == ids[None, :]] = -2
        top = np.argsort(-s, axis=1, kind="stable")[:, :take]
        got = np.take_along_axis(s, top, 1)
        keep = got > np.maximum(rows["floor"].to_numpy(), -1.5)[:, None]
        r, c = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(ids[top[r, c]]), pa.array(got[r, c])], ["id", "nb", "s"]) if len(r) else None

    return stream_groups(groups, keys, work, "id long, nb long, s double")


def first_graph(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    bits = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    cells = parted(stored(leaves(vectors, bits, seed).withColumnRenamed("leaf", "grp"), "leaves"), vectors, 2 * LEAF, LEAF, seed)
    rows = cells.join(vectors.select("id", "v"), "id").withColumn("floor", F.lit(-2.0))
    return best(meetings(rows.select("grp", "id", "v", "floor"), ["grp"], FROM_LEAF).select("id", "nb", "s", F.lit(K).alias("k"), F.lit(1).alias("fresh")))


def descend(graph: DataFrame, vectors: DataFrame, seed: int) -> DataFrame:
    """One round: the neighbours and reverse neighbours of every vector meet each other. Where very
    many have a vector as neighbour they are parted, like with like, into meetings of at most BLOCK."""
    floors = graph.groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("s").alias("s")).select("id", F.when(F.col("n") >= F.col("k"), F.col("s")).otherwise(-2.0).alias("floor"))
    known = vectors.select("id", "v").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    out = graph.select(F.col("id").alias("host"), F.col("nb").alias("id"), "fresh")
    guests = out.union(graph.select(F.col("nb").alias("host"), "id", "fresh")).union(graph.select(F.col("id").alias("host"), "id", F.lit(0))).groupBy("host", "id").agg(F.max("fresh").alias("fresh"))
    guests = stored(guests.select(F.col("host").alias("grp"), F.lit(0).alias("tree"), "id", "fresh"), "guests")
    changed = guests.filter("fresh = 1").select("grp").distinct()
    rows = parted(guests.drop("fresh").join(changed, "grp"), vectors, BLOCK, BLOCK // 2, seed).join(known, "id")
    news = meetings(rows.select("grp", "id", "v", "floor"), ["grp"], UPDATES)
    pairs = graph.select("id", "nb", "s", "k", F.lit(0).alias("fresh")).union(news.select("id", "nb", "s", F.lit(K), F.lit(1)))
    out = stored(best(pairs), "graph")
    release(guests)
    return out


def refined(graph: DataFrame, vectors: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Descents until the lists settle; then saturated ones are enlarged, and the descent goes on
    around them, until no list is saturated or all of these are at MOST_K."""
    while True:
        entries = graph.agg(F.count("*"), F.sum("fresh")).first()
        size = entries[1] or 0  # all entries at first, later those of enlarged lists
        while (entries[1] or 0) > CHANGED * size and entries[1]:
            old, graph, seed = graph, descend(graph, vectors, seed), seed + 1
            release(old)
            entries = graph.agg(F.count("*"), F.sum("fresh")).first()
        more = enlarged(graph, threshold)
        if more is None:
            return graph
        release(graph)
        graph = more


def crossed(members: DataFrame, block: int) -> DataFrame:
    """Rows (grp, n, ...) with the blocks ``lo`` and ``hi`` that they meet in: every two blocks of a
    group, ``i`` being their own."""
    spread = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = members.withColumn("i", F.pmod(F.xxhash64("id"), spread).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), spread - 1)))
    return rows.select("grp", F.least("i", "k").alias("lo"), F.greatest("i", "k").alias("hi"), "i", "id", "m", "v")


def linked_here(t: pa.Table, threshold: float) -> np.ndarray:
    """Which rows of one meeting of ``crossed`` are linked; a pair of one block only where it meets itself."""
    ids, side, x = t["id"].to_numpy(), t["i"].to_numpy(), matrix(t["v"])
    linked = x @ x.T >= threshold
    linked &= ids[:, None] != ids[None, :]
    if t["lo"][0].as_py() != t["hi"][0].as_py():
        linked &= side[:, None] != side[None, :]
    return linked


def listed(graph: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (id, component) of the graph's entries at or above the threshold. No list need
    hold all links: inside a component they are counted, block by block."""
    near = graph.filter(F.col("s") >= threshold).select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b"))
    parts = stored(components(near), "vector-parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    members = parts.join(sizes, "component").join(vectors, "id").select(F.col("component").alias("grp"), "n", "id", "m", "v")
    return stored(counted(members, threshold), "vector-links"), parts


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): summed ``m`` of the other rows of the same group at or above the threshold. Every two
    blocks of a group meet: the exact way for what lists are too short for."""
    def work(t: pa.Table) -> pa.RecordBatch | None:
        linked = linked_here(t, threshold)
        return pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array((linked * t["m"].to_numpy()).sum(1))], ["id", "links"])

    return stream_groups(crossed(members, COUNT_BLOCK), ["grp", "lo", "hi"], work, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def exact(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) as ``counted`` and the edges (a, b) that span all components: all vectors of a
    length meet, block by block. The time grows with the square of the table."""
    rows = vectors.withColumn("grp", F.size("v"))
    rows = rows.join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp")

    def work(t: pa.Table) -> pa.RecordBatch | None:
        linked = linked_here(t, threshold)
        ids, links = t["id"].to_numpy(), (linked * t["m"].to_numpy()).sum(1)
        a, b = spanning_edges(ids, linked)
        own = ids[links > 0]
        if not len(own):
            return None
        links = np.concatenate([links[links > 0], np.zeros(len(a), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, np.array(b, np.int64)])), pa.array(links), pa.array([*own.tolist(), *a], pa.int64())], ["id", "links", "nb"])

    met = stored(stream_groups(crossed(rows, EXACT_BLOCK), ["grp", "lo", "hi"], work, "id long, links long, nb long"), "met")
    return met.groupBy("id").agg(F.sum("links").alias("links")), met.filter("id <> nb").select(F.col("nb").alias("a"), F.col("id").alias("b"))


def true_links(vectors: DataFrame, probes: list[tuple[int, np.ndarray]], threshold: float) -> dict[int, int]:
    """id -> summed ``m`` of the other vectors at or above the threshold, for a bounded list of
    (id, unit vector), each compared with all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            v = batch.column(1)
            length = np.diff(v.offsets.to_numpy())
            for d in np.unique(length).tolist():
                own = np.flatnonzero(length == d)
                at = [i for i, (_, p) in enumerate(shared.value) if len(p) == d]
                if at:
                    x = matrix(pa.chunked_array([v.take(pa.array(own))]))
                    hit = np.array([shared.value[i][1] for i in at]) @ x.T >= threshold
                    hit &= np.array([shared.value[i][0] for i in at])[:, None] != batch.column(0).to_numpy()[own][None, :]
                    n[at] += (hit * batch.column(2).to_numpy()[own]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in shared.value], pa.int64()), pa.array(n)], ["id", "n"])

    return {r.id: r.n for r in vectors.select("id", "v", "m").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def audit(vectors: DataFrame, linked: DataFrame, n: int, threshold: float) -> float | None:
    """Recall of (id, links) on vectors drawn by hash, whatever was found for them, each compared
    with all ``n`` vectors. Probes are drawn in growing rounds until LINKED of them hold a true link
    and only these count: the lesser of their links found in all and the mean share found of each.
    None (unknown) where SHARE of a large table holds too few. A table probed whole is known: it
    may hold no link at all (1.0)."""
    u = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    most, drawn, size = (n if n <= ROUND else max(ROUND, int(n * SHARE))), 0, PROBES
    found, true = [], []
    while drawn < most and len(true) < LINKED:
        size = min(size, most - drawn)
        part = vectors.filter((u >= drawn / n) & (u < (drawn + size) / n))
        rows = part.join(linked, "id", "left").select("id", "v", F.coalesce("links", F.lit(0)).alias("links")).collect()
        units = [matrix(pa.chunked_array([pa.array([r.v], pa.list_(pa.float64()))]))[0] for r in rows]
        links = true_links(vectors, [(r.id, u) for r, u in zip(rows, units, strict=True)], threshold) if rows else {}
        held = [r for r in rows if links.get(r.id)]
        found += [min(r.links, links[r.id]) for r in held]
        true += [links[r.id] for r in held]
        drawn, size = drawn + size, min(2 * size, ROUND)
    if len(true) < LINKED and drawn < n:
        return None
    if not true:
        return 1.0
    found, true = np.array(found, float), np.array(true, float)
    return float(min(found.sum() / true.sum(), (found / true).mean()))


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, column: str = "embedding", max_graphs: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall for every vector.

    Vectors are linked if their cosine, in double precision, is at least ``threshold`` and the
    search has brought them together. Equal vectors are one node of a neighbour graph. The graph
    starts from the cells of random hyperplanes and is refined in rounds: neighbours of a vector
    meet one another, and each keeps its K nearest, until a round changes less than CHANGED of the
    list entries.
    Lists that are full of links are enlarged, to MOST_K at most, and the descent goes on around
    them. Entries at the threshold make components; inside a component every pair is compared, in
    one block of COUNT_BLOCK where it fits, so no link there is lost to a list's bound. An audit
    compares hashed probes with all vectors; under MIN_RECALL another graph is started and merged,
    at most ``max_graphs`` in all. Where the recall stays under it, or links are so rare that it is
    unknown, an exact pass over all pairs of vectors gives the result instead.
    ``recall`` is the last audit's figure, 1.0 after the exact pass.

    Nulls: vectors that are null, empty, zero or hold null or non-finite components have no links
    and are kept; a null vec_id likewise. Vectors of different lengths never link. Rows that repeat
    a vec_id are answered each. Other columns are not read. An empty table gives no rows.
    """
    v = F.col(column)
    ok = clean(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    kind = embeddings.schema[column].dataType.elementType.simpleString()
    as_is = v if kind in ("float", "double") else F.transform(v, lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, as_is).alias("v"))
    rows = stored(rows, "vectors")
    vectors = stored(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")).select("id", "v", "m"), "distinct-vectors")
    n = vectors.count()
    linked, parts, recall, graph = None, None, None, None
    for g in range(max_graphs if n else 0):
        start = first_graph(vectors, n, g)
        graph = stored(start if graph is None else best(graph.union(start)), "graph")
        graph = refined(graph, vectors, threshold, 1000 * (g + 1))
        linked, parts = listed(graph, vectors, threshold)
        recall = audit(vectors, linked, n, threshold)
        if recall is None or recall >= MIN_RECALL:
            break
    if n and (recall is None or recall < MIN_RECALL):
        linked, found = exact(vectors, threshold)
        linked, parts, recall = stored(linked, "vector-links"), stored(components(found), "vector-parts"), 1.0
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    of_class = vectors.join(linked, "id", "left").join(parts, "id", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(of_class, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def op4_near_vectors(spark, sf_dir: str) -> DataFrame:
    """near_vectors (nulls and ties: see there) over all embeddings at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9).drop("recall")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS component FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, component = vec_id AS kept
FROM embeddings e LEFT JOIN least_of l ON e.vec_id = l.a LEFT JOIN counts c ON e.vec_id = c.a
"""
