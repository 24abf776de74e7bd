"""The prefix trie of conversations, as intervals of their sorted order.

Conversations are sorted by the digests of their turns. A prefix then covers an interval of rows: from
any row that has it, as far left and right as the common prefixes of neighbouring rows are that long.
Each candidate prefix finds both ends for itself, by binary search over a sparse table of range
minima. What a node is asked for adds up over its rows, so a node that reaches over several blocks of
the order is put together from one partial row a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import stored

#: Rows and turns of a block, about; bytes of a turn's digest; candidates that search at a time.
BLOCK_ROWS, BLOCK_TURNS = 1 << 15, 1 << 19
DIGEST = 16
CHUNK = 1 << 18
#: Parts into which the nodes below one parent are dealt.
SALTS = 32

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Nodes at a block's edges: the prefix's and its parent's digest, bytes above and with the last turn, ids that end there.
EDGE = "parent binary, prefix binary, block int, on_first boolean, on_last boolean, above long, upto long, ends binary"
_NAMES = [c.split()[0] for c in f"{NODE}, {EDGE}".split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in f"{NODE}, {EDGE}".split(", ")]


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... values."""
    out, k = [values], 1
    while 2 * k <= len(values):
        out.append(np.minimum(out[-1][:-k], out[-1][k:]))
        k *= 2
    return out


def reach(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray, step: int) -> np.ndarray:
    """The last row to the left (step -1) or right (1) up to which all common prefixes are at least
    ``depth`` long; ``table`` is over the gaps, the k-th between rows k and k + 1."""
    at, gaps = row.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        start = at - (1 << k) if step < 0 else at
        inside = (start >= 0) & (start + (1 << k) <= gaps)
        far = np.zeros(len(at), bool)
        far[inside] = table[k][start[inside]] >= depth[inside]
        at[far] += step << k
    return at


def least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Range minima over rows low to high, both included."""
    out = np.empty(len(low), np.int64)
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << k) + 1])
    return out


def sha256_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def path_digests(key: bytes) -> list[bytes]:
    """A digest of each prefix of a row's turns, the empty one first."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, DIGEST):
        out.append(h.copy().digest())
        h.update(key[at : at + DIGEST])
    return out


def block_nodes(keys: list[bytes], ids: np.ndarray, sizes: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """The trie nodes of one block of sorted rows: whole ones, and partial ones at its edges, taken as
    if nothing lay beyond."""
    m = len(keys)
    length = np.array([len(k) // DIGEST for k in keys])
    first = np.concatenate([[0], np.cumsum(length)])
    words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, DIGEST // 8)
    row = np.repeat(np.arange(m), length)
    turn = np.arange(len(row)) - first[row]  # counted from 0
    bytes_to = np.concatenate([[0], np.cumsum(sizes)])
    common = length.copy()
    if len(row):
        before = np.where((row > 0) & (turn < length[row - 1]), first[row - 1] + turn, 0)
        differ = (row == 0) | (turn >= length[row - 1]) | (words != words[before]).any(1)
        np.minimum.at(common, row[differ], turn[differ])
    common[0] = 0
    shared = bytes_to[first[:-1] + common] - bytes_to[first[:-1]]
    shared[0] = 0
    shared_to = np.cumsum(shared)
    leaf_to = np.concatenate([[0], np.cumsum(np.append(common[1:] < length[:-1], True) & (length > 0))])
    gaps, minima = sparse_table(common[1:]), sparse_table(ids)
    left, right = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    for at in range(0, len(row), CHUNK):
        own = slice(at, at + CHUNK)
        left[own] = reach(gaps, row[own], turn[own] + 1, -1)
        right[own] = reach(gaps, row[own], turn[own] + 1, 1)
    node = np.flatnonzero(left == row)  # the candidate at its interval's first row stands for the prefix
    i, d, r = row[node], turn[node] + 1, right[node]
    above = np.where(d > 1, first[left[np.maximum(node - 1, 0)]] + d - 2, -1)  # the parent's candidate; -1: the root
    children = np.bincount(above[above >= 0], minlength=len(row))[node]
    smallest = least(minima, i, r)
    least_of = np.zeros(len(row), np.int64)
    least_of[node] = smallest
    n = r - i + 1
    base = bytes_to[node] - bytes_to[first[i]]
    saved = shared_to[r] - shared_to[i] - (n - 1) * base
    leaves = leaf_to[r + 1] - leaf_to[i]
    paths = path_digests(keys[0]), path_digests(keys[-1])
    # rows that equal the one before end at the same node
    starts = np.flatnonzero(np.append(True, (common[1:] != length[1:]) | (length[1:] != length[:-1])))
    ends = dict(zip(starts.tolist(), [*starts[1:].tolist(), m], strict=True))
    edge = (i == 0) | (r == m - 1)
    parent_edge = np.ones(len(row), bool)
    parent_edge[node] = edge
    parent_open = (above < 0) | parent_edge[above]
    nothing = hashlib.sha256(b"").hexdigest()

    def digest_of(k: int, up: int) -> bytes:
        return paths[0 if i[k] == 0 else 1][d[k] - up]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    total = int(shared_to[-1])
    turnless = ids[: ends[0]].astype("<i8").tobytes() if length[0] == 0 else None
    rows = [(int(ids.min()), 0, None, m, int((above < 0).sum()), int(leaf_to[-1]), total, None, None, paths[0][0], block, True, True, 0, 0, turnless)]
    for k in range(len(node)):
        a, depth = int(i[k]), int(d[k])
        run = ids[a : ends[a]] if length[a] == depth else None
        common_part = (int(smallest[k]), depth, int(least_of[above[k]]) if not parent_open[k] else None, int(n[k]), int(children[k]), int(leaves[k]), int(saved[k]))
        # the parent of a whole node lies on the first or last row's path if it is open at all
        up = None
        if edge[k]:
            up = digest_of(k, 1)
        elif parent_open[k]:
            up = paths[0][0] if depth == 1 else paths[0 if left[node[k] - 1] == 0 else 1][depth - 1]
        if edge[k]:
            rows.append((*common_part, None, up, digest_of(k, 0), block, a == 0, int(r[k]) == m - 1, int(base[k]), int(base[k] + sizes[node[k]]), None if run is None else run.astype("<i8").tobytes()))
        else:
            rows.append((*common_part, nothing if run is None else sha256_of(run.tolist()), up, None, block, None, None, None, None, None))
        if len(rows) == 8192:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows)
        sizes = t["sizes"].combine_chunks()
        yield from block_nodes(t["key"].to_pylist(), t["conv_id"].to_numpy(), sizes.flatten().to_numpy(), TaskContext.get().partitionId())


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids that end at each prefix, whose runs come one after the other."""
    prefix, h, begun = None, None, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([h.hexdigest()])], ["prefix", "ends_sha256"])

    for batch in batches:
        for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != prefix:
                if h is not None:
                    yield out()
                prefix, h, begun = p, hashlib.sha256(), False
            h.update(("," * begun + ",".join(map(str, np.frombuffer(ids, "<i8").tolist()))).encode())
            begun = True
    if h is not None:
        yield out()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, key, sizes): key is the turns' digests of 16 bytes one after
    the other, sizes the bytes of their texts. conv_id is unique and not null. One row per node, as in
    ``op12_prefix_trie``; no conversations give no rows."""
    spark = conversations.sparkSession
    rows, turns = conversations.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BLOCK_ROWS), -(-turns // BLOCK_TURNS))
    dealt = conversations.select("key", "conv_id", "sizes").repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = stored(dealt.mapInArrow(_blocks, f"{NODE}, {EDGE}"), "trie-nodes")
    whole, edges = found.filter("prefix is null"), found.filter("prefix is not null")

    # what each block's first row shares with the last row of the block before
    order = edges.filter("depth = 0").select("block").withColumn("previous", F.lag("block").over(Window.orderBy("block")))
    firsts = edges.filter("on_first and depth > 0").select("block", "prefix", "upto").join(order, "block")
    lasts = edges.filter("on_last and depth > 0").select(F.col("block").alias("previous"), "prefix")
    met = firsts.join(lasts, ["previous", "prefix"]).groupBy("block").agg(F.count("*").alias("met"), F.max("upto").alias("met_bytes"))
    bounds = order.join(met, "block", "left").select("block", "previous", *(F.when(F.col("previous").isNotNull(), F.coalesce(c, F.lit(0))).alias(c) for c in ("met", "met_bytes")))
    last_depth = edges.filter("on_last").groupBy("block").agg(F.max("depth").alias("last_depth"))
    after = bounds.filter("previous is not null").select(F.col("previous").alias("block"), F.col("met").alias("next_met")).join(last_depth, "block")
    goes_on = after.filter("last_depth > 0 and next_met >= last_depth").select("block", F.lit(1).alias("goes_on"))
    one = lambda c: F.when(c, 1).otherwise(0)
    part = edges.join(bounds.select("block", "met", "met_bytes"), "block", "left").join(goes_on, "block", "left")
    part = part.withColumn("saved_tokens", F.col("saved_tokens") + F.when(F.col("on_first") & (F.col("depth") <= F.col("met")), F.col("met_bytes") - F.col("above")).otherwise(0))
    part = part.withColumn("n_children", F.col("n_children") - one(F.col("on_first") & (F.col("depth") + 1 <= F.col("met"))))
    part = part.withColumn("n_leaves", F.col("n_leaves") - one(F.col("on_last") & F.col("goes_on").isNotNull()))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = stored(part.groupBy("prefix", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), *sums), "trie-edges")
    runs = edges.filter("ends is not null").select("prefix", "ends", "block").repartition("prefix").sortWithinPartitions("prefix", "block")
    ends = runs.mapInArrow(_ends, "prefix binary, ends_sha256 string")
    merged = merged.join(ends, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    merged = merged.withColumn("n_leaves", F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")))

    names = [c.split()[0] for c in NODE.split(", ")]
    parents = merged.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("open_parent"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    below = whole.filter("parent is not null").select("parent", *names).unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent", *names))
    below = below.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))  # one parent may have most nodes below it
    below = below.join(parents, ["parent", "salt"], "left").withColumn("parent_conv_id", F.col("open_parent")).select(*names)
    return below.unionByName(whole.filter("parent is null").select(*names))


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """Each conversation as (conv_id, key, sizes), its turns in order: null turn first, equal ones by role
    and text. Rows without conv_id take no part. Only digests are gathered, never texts."""
    turn = conversations.filter("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    numbered = turn.select("conv_id", F.struct(at.alias("at"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size")).alias("t"))
    gathered = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("key"), F.col("t.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with turns of the one five of them share: of c - c % 5 the first
    crc32(c) % 9 turns (all, if fewer; none, if absent), then their own turns after so many."""
    own = stored(own, "conversations")
    donors = own.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("donor"), F.substring("key", 1, 8 * DIGEST).alias("donor_key"), F.slice("sizes", 1, 8).alias("donor_sizes"))
    crc: Column = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    both = own.withColumn("donor", F.expr("conv_id - conv_id % 5")).withColumn("h", crc.cast("int")).join(donors, "donor", "left")
    head, head_sizes = F.expr(f"coalesce(substring(donor_key, 1, {DIGEST} * h), X'')"), F.expr("coalesce(slice(donor_sizes, 1, h), array())")
    tail = F.expr(f"substring(key, {DIGEST} * h + 1, greatest(length(key) - {DIGEST} * h, 0))")
    return both.select("conv_id", F.concat(head, tail).alias("key"), F.concat(head_sizes, F.expr("slice(sizes, h + 1, size(sizes))")).alias("sizes"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations: one row per node. Null roles and texts are empty,
    a null turn comes first, equal turns are ordered by role and text, so repeated rows stay repeated
    turns; rows without conv_id take no part. An empty table gives no rows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(stored(rebuilt(hashed_turns(rows)), "rebuilt"))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS k, list(strlen(text) ORDER BY pos) AS b,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: i::UBIGINT)), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::UBIGINT) ELSE s // 2 END))) % 9 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, coalesce(list_slice(d.k, 1, o.h), []) || coalesce(list_slice(o.k, o.h + 1, len(o.k)), []) AS k, coalesce(list_slice(d.b, 1, o.h), []) || coalesce(list_slice(o.b, o.h + 1, len(o.b)), []) AS b
  FROM own o LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 5
), member AS (
  SELECT conv_id, d, array_to_string(list_slice(k, 1, d), '') AS node, array_to_string(list_slice(k, 1, d - 1), '') AS above, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, d = len(k) AS ends
  FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT node, any_value(d) AS d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
  FROM member GROUP BY node
), kids AS (SELECT above, count(*) AS n FROM node WHERE d > 0 GROUP BY above),
below AS (
  SELECT DISTINCT a.node AS top, b.node AS node FROM member a JOIN member b ON a.conv_id = b.conv_id AND b.d >= a.d
), summed AS (
  SELECT top, sum((n.n - 1) * n.bytes)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM below JOIN node n ON n.node = below.node LEFT JOIN kids k ON k.above = below.node GROUP BY top
)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN p.conv_id END AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM node n JOIN summed s ON s.top = n.node LEFT JOIN kids k ON k.above = n.node LEFT JOIN node p ON p.node = n.above
"""
