"""Near duplicates: one-permutation MinHash with optimal densification.

A document is the set of its distinct word shingles. One hash of each shingle picks a bin by its
first bits and competes for the bin's minimum with the others; an empty bin copies the first
filled one of its own random order. Runs of bins form bands, and documents that share a band's
value form a bucket.

Equal sets are first folded into one class. In each bucket every member is then compared with one
centre only, so candidate edges form stars and grow with the members, not with their square.
Where a bucket's members are not all connected after that, the pairs that could still matter are
looked at in tiles of bounded size that hand on links only. All links are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded
from wavespan.llm.components import components
from wavespan.session import stored, unstore

BINS = 128
#: Chance that a pair at the very threshold shares no band.
MISS = 1e-4
#: Bits of 128 in which the one-bit sketches of a pair at the threshold never differ in practice.
SLACK_DEVIATIONS = 7
#: Orders in which buckets choose their centres.
CENTRES = 4
TILE = 256
#: Text whose shingles are held at once.
SLICE_BYTES = 8 << 20

SIGNATURES = ("doc_id bigint, n_shingles bigint, hi bigint, lo bigint, s1 bigint, s2 bigint, "
              "bands array<bigint>")


def rows_per_band(percent: int) -> int:
    """The longest bands that miss a pair at the threshold with at most the chance ``MISS``."""
    share = percent / 100
    return max(r for r in range(1, BINS) if (1 - share ** r) ** (BINS // r) <= MISS)


def bits_moments(percent: int) -> tuple[float, float]:
    """Expectation and variance of a pair's differing sketch bits at the threshold, if all bins are
    filled. A set of fewer shingles than bins fills some of them with copies: its variance is as
    many times larger as there are bins for a shingle."""
    p = (1 - percent / 100) / 2
    return BINS * p, BINS * p * (1 - p)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words.

    Words are runs without white space, A-Z in lower case. Fewer words than ``width`` form one
    shingle; no word, or no text, none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(split.offsets)
    bounds = bounds - bounds[0]
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    # of bytes, lower() changes A-Z only
    of = np.array([xxhash.xxh64_intdigest(w.encode().lower()) for w in words], dtype=np.uint64)
    real = np.array([bool(w) for w in words], dtype=bool)
    which = np.asarray(coded.indices)
    hashes, real = of[which], real[which]
    factors = [mixed(np.array([i + 1], dtype=np.uint64))[0] | np.uint64(1) for i in range(width)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h = hashes[a:b][real[a:b]]
        n = len(h) - width + 1
        if not len(h):
            yield h
        elif n < 1:
            yield np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], dtype=np.uint64)
        else:
            total = h[:n] * factors[0]
            for i in range(1, width):
                total = mixed(total) + h[i:n + i] * factors[i]
            yield np.unique(mixed(total))


PROBES = np.stack([np.random.default_rng(i).permutation(BINS) for i in range(BINS)])
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum of each bin (32 bits) of a sorted set that is not empty, densified."""
    at = np.searchsorted(found, EDGES)
    ends = np.append(at[1:], len(found))
    filled = at < ends
    values = (found[np.minimum(at, len(found) - 1)] << np.uint64(7)) >> np.uint64(32)
    if not filled.all():
        donors = PROBES[np.arange(BINS), filled[PROBES].argmax(axis=1)]
        values = np.where(filled, values, values[donors])
    return values


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``SIGNATURES`` of (doc_id, text): size and fingerprint of the set, sketch and bands."""
    rows = rows_per_band(percent)
    bands = BINS // rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = list(shingle_sets(batch.column(1), width))
            signs = np.zeros((len(sets), BINS), dtype=np.uint64)
            marks = np.zeros((len(sets), 2), dtype=np.int64)
            for i, found in enumerate(sets):
                if len(found):
                    signs[i] = signature(found)
                    marks[i] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
            bits = np.packbits((signs & np.uint64(1)).astype(np.uint8), axis=1)
            bits = np.ascontiguousarray(bits).view("<i8").reshape(len(sets), 2)
            parts = signs[:, :bands * rows].reshape(len(sets), bands, rows)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands))
            for i in range(rows):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
            keys = np.ascontiguousarray(keys).view(np.int64).ravel()
            offsets = pa.array(np.arange(0, len(keys) + 1, bands), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 *(pa.array(np.ascontiguousarray(x)) for x in (*marks.T, *bits.T)),
                 pa.ListArray.from_arrays(offsets, pa.array(keys))],
                names=[c.split()[0] for c in SIGNATURES.split(", ")])

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(sign, SIGNATURES)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (column 1) are of about ``SLICE_BYTES``, whole texts each."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its shingles, for a table of (node, text)."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = list(shingle_sets(batch.column(1), width))
            cuts = np.cumsum([0, *map(len, sets)], dtype=np.int64).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(expand, "node bigint, shingles array<bigint>")


def similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("long")
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def close(n1: str, n2: str, sketch1: tuple[str, str], sketch2: tuple[str, str],
          percent: int) -> Column:
    """False for pairs that can't reach the threshold by size, or by sketch in practice: beyond the
    expectation at the threshold and ``SLACK_DEVIATIONS`` deviations."""
    mean, variance = bits_moments(percent)
    spread = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(BINS)) / F.least(n1, n2)) * F.lit(variance))
    bits = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
                for x, y in zip(sketch1, sketch2, strict=True)), F.lit(0))
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
            & (bits <= F.lit(mean) + F.lit(float(SLACK_DEVIATIONS)) * spread))


def star_edges(members: DataFrame, percent: int) -> DataFrame:
    """(centre, node): every member of a bucket with the bucket's centre, each pair once.

    ``members``: band, node, n, s1, s2. The centre is the least node in one of ``CENTRES`` random
    orders, the same in all buckets of an order, so that buckets of the same documents agree.
    """
    order = F.xxhash64("node", F.pmod("band", F.lit(CENTRES)))
    centres = stored(members.groupBy("band").agg(
        F.min(F.struct(order.alias("o"), F.col("node").alias("centre"), F.col("n").alias("cn"),
                       F.col("s1").alias("c1"), F.col("s2").alias("c2"))).alias("c"),
        F.count("*").alias("size")).where("size > 1").select("band", "c.*"))
    pairs = members.join(centres, "band").where("node <> centre")
    return pairs.where(close("n", "cn", ("s1", "s2"), ("c1", "c2"), percent)).select(
        "centre", "node").distinct()


def tile_links(percent: int):
    """Finds links between members of different components in one tile of a bucket."""
    mean, variance = bits_moments(percent)

    def find(table: pa.Table) -> pa.Table:
        left = np.array(table.column("minor").to_pylist(), dtype=bool)
        node, label, n, band = (table.column(c).to_numpy() for c in ("node", "label", "n", "band"))
        bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
        bits = np.stack([table.column(c).to_numpy() for c in ("s1", "s2")], axis=1)
        bits = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        sets = table.column("shingles").combine_chunks()
        cuts, flat = np.asarray(sets.offsets), np.asarray(sets.flatten()).view(np.uint64)
        cuts = cuts - cuts[0]
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        differ = (BINS - bits[li] @ bits[ri].T) / 2
        least = np.minimum(n[li, None], n[ri])
        small = least * 100 >= np.maximum(n[li, None], n[ri]) * percent
        allowed = mean + SLACK_DEVIATIONS * np.sqrt(np.maximum(1.0, BINS / least) * variance)
        ok = (differ <= allowed) & small & (label[li, None] != label[ri])
        at = np.argwhere(ok)
        at = at[np.argsort(differ[at[:, 0], at[:, 1]], kind="stable")]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        a, b = [], []
        for x, y in zip(li[at[:, 0]].tolist(), ri[at[:, 1]].tolist(), strict=True):
            one, two = root(int(label[x])), root(int(label[y]))
            if one == two:
                continue
            shared = bands[x] == bands[y]
            if bands[x][shared.argmax()] != band[x]:
                continue  # looked at in the first bucket that the two share
            p, q = flat[cuts[x]:cuts[x + 1]], flat[cuts[y]:cuts[y + 1]]
            both = len(p) + len(q) - len(np.union1d(p, q))
            if both * 100 >= (len(p) + len(q) - both) * percent:
                parent[max(one, two)] = min(one, two)
                a.append(int(node[x]))
                b.append(int(node[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return find


def remaining_links(members: DataFrame, classes: DataFrame, labels: DataFrame,
                    sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that stars could not see: between members of one bucket that were not compared
    and are not connected yet.

    In a bucket, members outside of its largest component meet all members, in tiles of about
    ``TILE`` by ``TILE``. A tile gives at most one link for each two components it joins.
    """
    named = members.join(labels.select("node", F.col("root").alias("label")), "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    per_label = named.groupBy("band", "label").agg(F.count("*").alias("size"))
    buckets = per_label.groupBy("band").agg(
        F.max(F.struct("size", F.col("label"))).alias("major"), F.sum("size").alias("size"),
        F.count("*").alias("labels"))
    # two members are a star; of two components one may be the centre alone, which met all
    open_buckets = stored(buckets.where("labels > 1 and size > 2").select(
        "band", F.col("major.label").alias("major"), "size",
        (F.col("size") - F.col("major.size")).alias("minors")))
    rows = stored(named.join(open_buckets, "band").select(
        "band", "node", "label", "n", "s1", "s2", (F.col("label") != F.col("major")).alias("minor"),
        F.ceil(F.col("size") / TILE).alias("rights"), F.ceil(F.col("minors") / TILE).alias("lefts")))
    full = rows.join(sets, "node").join(classes.select("node", "bands"), "node")
    place = F.xxhash64("node")
    right = full.select("*", F.explode(F.expr("sequence(0L, lefts - 1)")).alias("i"),
                        F.pmod(place, F.col("rights")).alias("j")).withColumn("minor", F.lit(False))
    left = full.where("minor").select("*", F.pmod(place, F.col("lefts")).alias("i"),
                                      F.explode(F.expr("sequence(0L, rights - 1)")).alias("j"))
    found = stored(left.unionByName(right).groupBy("band", "i", "j").applyInArrow(
        tile_links(percent), "a bigint, b bigint"))
    return found, [open_buckets, rows]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents are linked if their sets of ``width``-word shingles are alike to at least
    ``percent`` in a hundred; a component is what links reach, named by its least doc_id, and
    ``kept`` marks rows that bear that name. Texts without words, null ones included, are linked
    with nothing and are kept, as are rows without ``doc_id``. Rows that repeat an id with other
    words count as one document of several texts. Other columns are ignored.
    """
    rows = stored(signatures(docs, width, percent))
    classes = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"),
        F.any_value("s1").alias("s1"), F.any_value("s2").alias("s2"),
        F.any_value("bands").alias("bands")))
    members = classes.select("node", "n", "s1", "s2", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(shared.select("band"), "band"))
    edges = stored(star_edges(members, percent))

    # grows with the corpus, so never broadcast: the plan is the same at every size
    nodes = members.select("node").distinct().hint("merge")
    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    sets = stored(full_sets(wanted.join(nodes, "node", "left_semi"), width))
    links = stored(
        edges.join(sets, "node").join(
            sets.select(F.col("node").alias("centre"), F.col("shingles").alias("other")), "centre")
        .where(similar(F.col("shingles"), F.col("other"), percent))
        .select(F.col("centre").alias("a"), F.col("node").alias("b")))
    unstore(edges)
    labels = components(links)
    more, used = remaining_links(members, classes, labels, sets, percent)
    labels = components(links.unionByName(more))
    unstore(*used, members, sets)
    named = rows.join(classes.select("hi", "lo", "node"), ["hi", "lo"], "left").join(
        labels, "node", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    name = F.when(linked, F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", name.alias("component_id"),
                        F.col("doc_id").eqNullSafe(name).alias("kept"))
