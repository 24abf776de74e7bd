"""Blockwise comparison inside groups: no task holds a whole group, no group is written as pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import components, release, stored


def stream_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each value of ``keys``: rows are dealt by the keys, sorted, and
    groups cut from the stream of batches, which spares the cost of one call per tiny group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            changed = np.zeros(max(table.num_rows - 1, 0), bool)
            for k in keys:
                v = table[k].to_numpy()
                changed |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), table.num_rows]
            whole = cuts if last else cuts[:-1]
            return [table.slice(a, b - a) for a, b in zip(whole, whole[1:], strict=False)], table.slice(whole[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first = [held[0].column(held[0].schema.get_field_index(k))[0] for k in keys]
            if [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1] for k in keys] == first:
                continue  # one group goes on
            done, rest = groups(pa.Table.from_batches(held).combine_chunks(), False)
            for group in done:
                out = work(group)
                if out is not None:
                    yield out
            held = rest.to_batches()
        if held:
            for group in groups(pa.Table.from_batches(held).combine_chunks(), True)[0]:
                out = work(group)
                if out is not None:
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def spanning_edges(ids: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (least id of the part, id) that span the connected parts of a boolean matrix."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    left = np.ones(n, bool)
    a, b = [], []
    for s in order:
        if not left[s]:
            continue
        left[s] = False
        front = np.array([s])
        while len(front):
            reached = linked[front].any(0) & left
            front = np.flatnonzero(reached)
            left[front] = False
            a.extend([int(ids[s])] * len(front))
            b.extend(ids[front].tolist())
    return a, b


def blocks_of(n: Column, size: Column, block: int, block_bytes: int) -> Column:
    """Into how many blocks a group of ``n`` rows and ``size`` bytes is dealt."""
    return F.greatest(F.ceil(n / F.lit(block)), F.ceil(size / F.lit(block_bytes)), F.lit(1)).cast("int")


Comparer = Callable[[pa.Table], Callable[[np.ndarray], np.ndarray]]


def link_within_groups(members: DataFrame, payload: list[str], comparer: Comparer, guide: tuple[DataFrame, Comparer] | None = None) -> DataFrame:
    """Edges (a, b) that connect what is alike inside each group, for all pairs of a group.

    ``members``: grp, id, pivot (the group's least id), blocks (into how many the group is dealt,
    by hashed id) and the payload. First the rows of each block are compared with the group's
    pivot, then those that it has not joined with all of their block: groups of close copies take
    time linear in their size. Only groups of several blocks that are still in several parts go
    on: there every two blocks are compared, skipping pairs already joined, so a row is copied
    once for each block of its group. With a ``guide`` (rows of id and something small to tell by
    what may be alike, and the comparer for it) only these small rows are copied so; a row goes
    with its payload just to the pairs of blocks in which it may be like a row of another part.

    comparer(rows) gives a function from a boolean matrix of the pairs asked for to the matrix of
    those that are alike. Each call gives spanning edges only, never more than the rows it read.
    """
    blocks = F.col("blocks")
    members = members.withColumn("i", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    pivots = members.filter("id = pivot").withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = members.filter("id <> pivot").unionByName(pivots)

    def within(rows: pa.Table) -> pa.RecordBatch | None:
        ids = rows["id"].to_numpy()
        if len(ids) < 2:
            return None
        compare, first = comparer(rows), np.zeros((len(ids), len(ids)), bool)
        at = ids == rows["pivot"].to_numpy()
        first[np.flatnonzero(at)[:1]] = True
        linked = compare(first & ~np.eye(len(ids), dtype=bool))
        linked |= linked.T
        joined = linked[np.flatnonzero(at)[:1]].any(0) | at
        rest = ~(joined[:, None] & joined[None, :]) & ~first & ~first.T & ~np.eye(len(ids), dtype=bool)
        if rest.any():
            linked |= compare(rest)
        return edges(ids, linked)

    def edges(ids: np.ndarray, linked: np.ndarray) -> pa.RecordBatch | None:
        a, b = spanning_edges(ids, linked | linked.T)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    found = stored(stream_groups(own.select("grp", "i", "id", "pivot", *payload), ["grp", "i"], within, "a long, b long"), "links")
    large = members.filter("blocks > 1")
    if not large.limit(1).count():
        return found
    parts = components(found)
    large = stored(large.join(parts.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id")), "large-groups")
    open_groups = stored(large.groupBy("grp").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("grp"), "open-groups")
    if not open_groups.limit(1).count():
        release(large, open_groups)
        return found
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("k")
    opened = large.join(open_groups, "grp")

    def in_pairs(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("grp", "id", "i", "part", *more, other).filter("k <> i")
        return rows.select("grp", F.least("i", "k").alias("lo"), F.greatest("i", "k").alias("hi"), "i", "id", "part", *more)

    def asked(rows: pa.Table) -> np.ndarray:
        part, side = rows["part"].to_numpy(), rows["i"].to_numpy()
        return (part[:, None] != part[None, :]) & (side[:, None] < side[None, :])

    met = None
    if guide:
        signs, likely = guide
        small = opened.select("grp", "id", "i", "part", "blocks").distinct().join(signs, "id")

        def meets(rows: pa.Table) -> pa.RecordBatch | None:
            wanted = asked(rows)
            found = likely(rows)(wanted) if wanted.any() else wanted
            rows = rows.select(["grp", "lo", "hi", "id"]).filter(pa.array(found.any(0) | found.any(1)))
            return rows.combine_chunks().to_batches()[0] if rows.num_rows else None

        names = [c for c in signs.columns if c != "id"]
        met = stored(stream_groups(in_pairs(small, *names), ["grp", "lo", "hi"], meets, "grp long, lo int, hi int, id long").distinct(), "rows-to-meet")
        pairs = opened.join(met, ["grp", "id"]).select("grp", "lo", "hi", "i", "id", "part", *payload)
    else:
        pairs = in_pairs(opened, *payload)

    def across(rows: pa.Table) -> pa.RecordBatch | None:
        wanted = asked(rows)
        return edges(rows["id"].to_numpy(), comparer(rows)(wanted)) if wanted.any() else None

    more = stored(stream_groups(pairs, ["grp", "lo", "hi"], across, "a long, b long"), "links")
    release(large, open_groups, *([] if met is None else [met]))
    return found.union(more)
