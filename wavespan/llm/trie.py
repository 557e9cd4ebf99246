"""The prefix trie of conversations, with totals over every subtree by centroid decomposition.

A node is a distinct sequence of first turns, known by its smallest conversation and its depth: a
conversation passes one node of each depth. Turns enter as fingerprints; texts are not moved.

Totals over subtrees come from splitting the tree at centroids. A node weighs as many conversations
as pass it, so that the weight of a subtree is a plain sum over its members. The centroid of a
component is its lightest subtree of more than half the weight; without it every part left has at
most half. What the component holds at and below its centroid is added to the nodes from the
centroid up to the component's top, and the parts are split in turn. Every node and each of its
descendants are parted by exactly one centroid that lies between them, hence counted once.
Components of more than ``LOCAL_NODES`` nodes are split by joins, a round for all of them; smaller
ones lie in one task and are split there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.batches import whole_groups
from wavespan.session import stored

LOCAL_NODES = 1 << 14
#: Conversations whose decimal ids make one piece of a digest's input.
IDS_AT_ONCE = 1 << 14
#: Leading characters of role and text that order rows of the same turn; fingerprints follow.
LEAD = 64


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(more))


def running(rows: DataFrame, key: str, order: list[str], xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``rank`` (from 1) among those of equal ``key`` (not null) in the given order,
    and for each column of ``xors`` the running exclusive or, ``run_<column>``.

    Rows are dealt by ranges of key and order, so that a key with very many rows spreads over many
    tasks. Each task counts its own rows; one line per task says where its first key goes on.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    at = rows.columns.index(key)
    spots = [rows.columns.index(x) for x in xors]
    names = [*rows.columns, "part", "rank", *[f"run_{x}" for x in xors]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, carry = TaskContext.get().partitionId(), None, 0, [0] * len(xors)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            sizes = np.diff(np.append(starts, n))
            rank = np.arange(1, n + 1) - np.repeat(starts, sizes)
            goes_on = keys[0] == last
            if goes_on:
                rank[:sizes[0]] += count
            runs = []
            for i, spot in enumerate(spots):
                values = batch.column(spot).to_numpy()
                run = np.bitwise_xor.accumulate(values)
                run = run ^ np.repeat(run[starts] ^ values[starts], sizes)
                if goes_on:
                    run[:sizes[0]] ^= carry[i]
                carry[i] = run[-1]
                runs.append(pa.array(run))
            last, count = keys[-1], rank[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array(rank), *runs],
                names=names)

    more = ["part bigint", "rank bigint", *[f"run_{x} bigint" for x in xors]]
    told = stored(sorted_rows.mapInArrow(scan, _schema(rows, *more)))
    ends = told.groupBy("part").agg(
        F.min(key).alias("first"), F.max(F.struct(key, "rank", *[f"run_{x}" for x in xors])
                                         ).alias("end")).orderBy("part").collect()
    offsets, before = [], None
    for line in ends:
        goes_on = before is not None and before[0] == line["first"]
        if goes_on:
            offsets.append((line["part"], *before))
        end = tuple(line["end"])
        if goes_on and end[0] == before[0]:
            end = (end[0], end[1] + before[1],
                   *[a ^ b for a, b in zip(end[2:], before[2:], strict=True)])
        before = end
    if not offsets:
        return told.drop("part")
    columns = ["__key", "__n", *[f"__{x}" for x in xors]]
    fixes = told.sparkSession.createDataFrame(
        offsets, "part bigint, " + ", ".join(f"{c} bigint" for c in columns))
    # a line for each task of the sort at most
    fixed = told.join(F.broadcast(fixes), "part", "left")
    on = F.col("__key").eqNullSafe(F.col(key))
    return fixed.select(
        *rows.columns, F.when(on, F.col("rank") + F.col("__n")).otherwise(F.col("rank")).alias("rank"),
        *[F.when(on, F.col(f"run_{x}").bitwiseXOR(F.col(f"__{x}"))).otherwise(F.col(f"run_{x}"))
          .alias(f"run_{x}") for x in xors])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, rank, e1, e2, bytes: the turns of each conversation by ``turn`` (null first).

    Rows of one turn follow role, then text. A null role or text counts as empty; rows without a
    conv_id take no part. (e1, e2) is a fingerprint of role and text. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.left(role, F.lit(LEAD)).alias("lead_role"), F.left(text, F.lit(LEAD)).alias("lead"),
        F.xxhash64(F.lit(1), role, text).alias("e1"), F.xxhash64(F.lit(2), role, text).alias("e2"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"))
    found = running(rows, "conv_id", ["turn", "lead_role", "lead", "e1", "e2", "row"])
    return found.select("conv_id", "rank", "e1", "e2", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations for :func:`prefix_trie` from ``numbered`` ones, unchanged."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return turns.withColumnRenamed("rank", "pos").join(convs, "conv_id"), convs


def with_shared_heads(turns: DataFrame, family: int = 5, heads: int = 9
                      ) -> tuple[DataFrame, DataFrame]:
    """As :func:`as_they_are`, after every conversation c has taken its first h turns from c - c %
    ``family`` (remainders from 0 on, also for negative c), h = crc32(decimal c) % ``heads``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    sized = convs.select("conv_id", "own", base.alias("base"), h.alias("h")).join(
        convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    sized = stored(sized.select(
        "conv_id", "base", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    first = turns.where(F.col("rank") < heads).withColumnRenamed("conv_id", "base")
    head = sized.join(first, "base").where(F.col("rank") <= F.col("h")).select(
        "conv_id", F.col("rank").alias("pos"), "e1", "e2", "bytes", "length")
    rest = turns.where(F.col("rank") > h).join(sized, "conv_id").select(
        "conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("pos"), "e1", "e2", "bytes",
        "length")
    return head.unionByName(rest), sized.select("conv_id", "length")


def digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 from rows (owner, depth, conv_id), conversations ascending.

    Ids are written out in ranges, and the pieces of one node stream through its hash in order.
    """
    keys = ["owner", "depth"]
    dealt = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            owner, depth, conv = (batch.column(x).to_numpy() for x in (*keys, "conv_id"))
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True):
                for i in range(a, b, IDS_AT_ONCE):
                    ids = conv[i:min(i + IDS_AT_ONCE, b)].tolist()
                    out.append((owner[a], depth[a], part, number, ",".join(map(str, ids)).encode()))
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5,
                                                [pa.int64()] * 4 + [pa.binary()], strict=True)],
                names=[*keys, "part", "number", "ids"])

    pieces = dealt.mapInArrow(write, "owner bigint, depth bigint, part bigint, number bigint, "
                                     "ids binary")
    pieces = pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "number")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(x).to_pylist() for x in (*keys, "ids")),
                                         strict=True):
                if (owner, depth) == node:
                    state.update(b"," + ids)
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids)
            yield _digest_rows(out)
        if node is not None:
            yield _digest_rows([(*node, state.hexdigest())])

    return pieces.mapInArrow(digest, "owner bigint, depth bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)],
        names=["owner", "depth", "ends_sha256"])


def centroid_totals(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """For each node of one tree, the sums of ``values`` over its subtree.

    ``parent`` names an earlier node, or is -1 at the top; ``weight`` is that of the subtree.
    """
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    weight, gone = list(weight), [False] * n
    sums = [[0] * n for _ in values]
    tops = [0] if n else []
    while tops:
        top = tops.pop()
        half, c, deeper = weight[top], top, top
        while deeper is not None:
            c, deeper = deeper, None
            for x in children[c]:
                if not gone[x] and 2 * weight[x] > half:
                    deeper = x
                    break
        below = [c]
        for x in below:
            below += [y for y in children[x] if not gone[y]]
        totals = [sum([v[x] for x in below]) for v in values]
        gone[c] = True
        tops += [x for x in children[c] if not gone[x]]
        x = c
        while True:
            for s, total in zip(sums, totals, strict=True):
                s[x] += total
            if x == top:
                break
            x = parent[x]
            weight[x] -= weight[c]
        if c != top:
            tops.append(top)
    return sums


TOP = ["top_owner", "top_depth"]
NODE = ["owner", "depth"]


def _within_tasks(state: DataFrame, values: list[str]) -> DataFrame:
    """owner, depth and s_<value> for whole components that fit a task."""
    names = [*NODE, *[f"s_{v}" for v in values]]
    dealt = state.repartition(*TOP).sortWithinPartitions(*TOP, "depth")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, TOP):
            c = {x: table.column(x).to_numpy() for x in table.column_names}
            n = table.num_rows
            cuts = np.flatnonzero(np.any([c[x][1:] != c[x][:-1] for x in TOP], axis=0)) + 1
            out = [np.empty(n, dtype=np.int64) for _ in values]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                owner, depth = c["owner"][a:b].tolist(), c["depth"][a:b].tolist()
                place = {node: i for i, node in enumerate(zip(owner, depth, strict=True))}
                parent = [place.get((p, d - 1), -1) for p, d in
                          zip(c["parent_owner"][a:b].tolist(), depth, strict=True)]
                found = centroid_totals(parent, c["weight"][a:b].tolist(),
                                        [c[v][a:b].tolist() for v in values])
                for o, v, s in zip(out, values, found, strict=True):
                    o[a:b] = c[f"s_{v}"][a:b] + np.array(s, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["owner"]), pa.array(c["depth"]), *map(pa.array, out)], names=names)

    columns = [*NODE, *TOP, "parent_owner", "weight", *values, *[f"s_{v}" for v in values]]
    return dealt.select(*columns).mapInArrow(split, ", ".join(f"{x} bigint" for x in names))


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str],
                   local_nodes: int = LOCAL_NODES) -> DataFrame:
    """owner, depth, s_<value>: sums over each node's subtree.

    ``nodes`` (owner, depth, parent_owner, weight and the values, all long) form one tree with a
    node of depth 0; parent_owner is -1 there. ``paths`` (conv_id, pos, owner, parent_owner) says
    which node a conversation passes at each depth. The number of rounds grows with the logarithm
    of the weight over ``local_nodes``.
    """
    top = nodes.where("depth = 0").select("owner").first()
    sums = [f"s_{v}" for v in values]
    columns = [*NODE, "parent_owner", "weight", *values, *sums, *TOP]
    state = nodes.select(
        *NODE, "parent_owner", "weight", *values, *[F.lit(0).cast("long").alias(s) for s in sums],
        F.lit(top[0] if top else 0).cast("long").alias("top_owner"),
        F.lit(0).cast("long").alias("top_depth"))
    done = []
    while True:
        large = stored(state.groupBy(*TOP).agg(
            F.count(F.lit(1)).alias("n"), F.max("weight").alias("whole")).where(
            F.col("n") > local_nodes).drop("n"))
        if not large.take(1):
            break
        done.append(_within_tasks(state.join(large, TOP, "left_anti"), values))
        heavy = state.join(large, TOP)
        centroids = stored(
            heavy.where(2 * F.col("weight") > F.col("whole")).groupBy(*TOP).agg(
                F.min_by(F.struct(*NODE, "weight"), "weight").alias("c")).select(
                *TOP, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"),
                F.col("c.weight").alias("c_weight")))
        # the node that the owner's conversation passes right below the centroid's depth
        step = paths.select(F.col("conv_id").alias("owner"), (F.col("pos") - 1).alias("c_depth"),
                            F.col("owner").alias("child"), F.col("parent_owner").alias("above"))
        is_c = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
        under = (F.col("depth") > F.col("c_depth")) & F.col("above").eqNullSafe(F.col("c_owner"))
        marked = stored(
            heavy.drop("whole").join(centroids, TOP).join(step, ["owner", "c_depth"], "left").select(
                *columns, "c_owner", "c_depth", "child", is_c.alias("is_c"), under.alias("under")))
        totals = marked.where("is_c or under").groupBy(*TOP).agg(
            *[F.sum(v).alias(f"t_{v}") for v in values])
        line = centroids.join(totals, TOP).join(
            paths.select(F.col("conv_id").alias("c_owner"), F.col("pos").alias("depth"), "owner"),
            "c_owner").where(F.col("depth").between(F.col("top_depth"), F.col("c_depth"))).select(
            *NODE, F.col("c_weight").alias("off"), *[f"t_{v}" for v in values])
        moved = marked.join(line, NODE, "left").select(
            *NODE, "parent_owner",
            (F.col("weight") - F.when(F.col("is_c"), 0).otherwise(
                F.coalesce("off", F.lit(0)))).alias("weight"), *values,
            *[(F.col(f"s_{v}") + F.coalesce(f"t_{v}", F.lit(0))).alias(f"s_{v}") for v in values],
            F.when(F.col("under"), F.col("child")).otherwise(F.col("top_owner")).alias("top_owner"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            "is_c")
        moved = stored(moved)
        done.append(moved.where("is_c").select(*NODE, *sums))
        state = moved.where("not is_c").select(*columns)
    done.append(_within_tasks(state, values))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """The trie's nodes from ``turns`` (conv_id, pos from 1, e1, e2, bytes, length) and ``convs``
    (conv_id, length; also those without a turn): conv_id (smallest member), depth, parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens sums, over the subtree, (n_convs - 1) times the bytes of a node's last text;
    ends_sha256 hashes the ids of the conversations that end in the node. Without a conversation
    there is no node. Two sequences of turns count as the same if fingerprints of 128 bits agree.
    """
    pos = F.col("pos")
    tagged = turns.select("conv_id", "pos", "bytes", "length",
                          F.xxhash64("e1", "e2", pos).alias("t1"),
                          F.xxhash64(F.lit(7), "e2", "e1", pos).alias("t2"))
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("pos"),
                          F.lit(0).cast("long").alias("bytes"), "length",
                          F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"))
    rows = running(tagged.unionByName(starts), "conv_id", ["pos"], ("t1", "t2"))
    key = ["pos", "run_t1", "run_t2"]
    found = stored(rows.groupBy(*key).agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"),
        F.min("bytes").alias("bytes"),
        F.sum(F.col("length") - F.col("pos") + 1).alias("weight")))
    shared = found.where("n_convs > 1").select(*key, "owner")
    owned = stored(rows.join(shared, key, "left").select(
        "conv_id", "pos", "length", F.coalesce("owner", "conv_id").alias("owner")))
    # one row per conversation and depth on both sides
    above = owned.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("owner").alias("parent_owner"))
    paths = stored(owned.select("conv_id", "pos", "owner").join(above, ["conv_id", "pos"], "left").select(
        "conv_id", "pos", "owner", F.coalesce("parent_owner", F.lit(-1)).alias("parent_owner"),
        F.col("parent_owner").isNotNull().alias("has_parent")))
    nodes = found.select("owner", F.col("pos").alias("depth"), "n_convs", "bytes", "weight").join(
        paths.where("conv_id = owner").select("owner", F.col("pos").alias("depth"), "parent_owner",
                                              "has_parent"), NODE)
    children = nodes.where("has_parent").groupBy(
        F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").select(
        *NODE, "parent_owner", "has_parent", "weight", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    sums = subtree_totals(nodes, paths, ["leaf", "saved"], local_nodes)
    hashes = digests(owned.where("pos = length").select("owner", F.col("pos").alias("depth"), "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, NODE).join(hashes, NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("has_parent"), F.col("parent_owner")).alias("parent_conv_id"),
        "n_convs", "n_children", F.col("s_leaf").alias("n_leaves"),
        F.col("s_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
