"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Only the histogram, at most ``capacity`` numbers, reaches the driver. Lengths are placed longest
first, each time into the open packs with the fewest tokens so far, all packs of one pattern at a
time. Documents then find their pack by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded, whole_groups
from wavespan.llm.tokens import BATCH_BYTES, MAX_WORDS, encoder
from wavespan.session import stored

CAPACITY = 2048
PAD_ID = 0

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


PACKED_NAMES = [c.split()[0] for c in PIECES.split(", ")] + ["sequence_id", "offset"]

#: Bits of an id in binary form.
WIDTH = 16


def narrow(ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) >> WIDTH:
        raise ValueError(f"an id needs more than {WIDTH} bits")
    return ids.astype(f"<u{WIDTH // 8}").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
                 with_ids: bool = False, binary: bool = False, with_crc: bool = True,
                 max_words: int = MAX_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Cut every document (doc_id, text), encoded and closed by ``end_id``, into pieces of
    ``capacity`` ids and one shorter piece.

    A null text counts as empty and gives one piece with ``end_id`` only. Rows may repeat; each
    is a document of its own. Other columns are ignored. ``binary`` ids are little-endian unsigned
    numbers of ``WIDTH`` bits; a larger id raises. ``part`` and ``nth`` number the pieces of a
    length in the task that cut them. Without ``with_crc`` the checksums are null. ``max_words``
    remembered words and ``batch_bytes`` of texts encoded at a time bound a worker's memory.
    """
    schema = PIECES + ", part bigint, nth bigint" + (
        ", ids binary" if binary else ", ids array<bigint>") * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer, max_words), np.array([end_id], dtype="<u4")
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            doc, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
            for name, found in zip(batch.column(0).to_pylist(), words.encode(batch.column(1), batch_bytes),
                                   strict=True):
                found = np.concatenate([found, end])
                for i in range(0, len(found), capacity):
                    piece = found[i:i + capacity]
                    doc.append(name)
                    start.append(i)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()) if with_crc else None)
                    total.append(len(found))
                    nth.append(seen[len(piece)])
                    seen[len(piece)] += 1
                    if with_ids:
                        ids.append(narrow(piece) if binary else piece.astype(np.int64))
            arrays = [pa.array(x, pa.int64())
                      for x in (doc, start, length, crc, total, [part] * len(doc), nth)]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary() if binary else pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, their lengths) for a histogram of piece lengths.

    Longest first; a length goes to the open packs with the fewest tokens, as long as they have
    room, and opens new packs otherwise.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []  # ascending, those with open packs

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(spaces, space)
        room[space].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # packs that took this length have less room and are looked at again only in their turn
        while left:
            if not spaces or spaces[-1] < length:
                put(capacity - length, left, (length,))
                break
            space = spaces[-1]
            count, lengths = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop()
            taken = min(count, left)
            if taken < count:
                put(space, count - taken, lengths)
            put(space - length, taken, (*lengths, length))
            left -= taken
    return [pattern for found in room.values() for pattern in found]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, the runs of ranks that patterns take: first rank, packs' first id, copies
    in a pack and the offset of the first copy."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for count, lengths in found:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            runs.setdefault(length, []).append((used.get(length, 0), first, copies, offset))
            used[length] = used.get(length, 0) + count * copies
            offset += copies * length
        first += count
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True))
            for k, v in runs.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """``__rank`` from 0 among the pieces of a length: ``nth`` after those of earlier parts. A line
    for each length and part is shuffled, no piece."""
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("length", "part",
                                 F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")))
    return (pieces.join(starts, ["length", "part"])
            .withColumn("__rank", F.col("__before") + F.col("nth")).drop("__before", "part", "nth"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: no overlap, no gap, at most ``capacity`` each.

    ``pieces`` is read three times and should be stored. It has ``part`` and ``nth``, as
    :func:`token_pieces` gives them, and these go. Lengths must lie in 1 to ``capacity``, which
    bounds the histogram that is collected.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"piece lengths must lie in 1 to {capacity}")
    places = slots(patterns(histogram, capacity))
    rows = ranked(pieces)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    at, of = rows.columns.index("__rank"), rows.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(at).to_numpy(zero_copy_only=False)
            length = batch.column(of).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(length[order])) + 1)
            for rows_of in groups if len(rank) else []:
                size = int(length[rows_of[0]])
                from_rank, packs, copies, offsets = places[size]
                run = np.searchsorted(from_rank, rank[rows_of], side="right") - 1
                nth = rank[rows_of] - from_rank[run]
                sequence[rows_of] = packs[run] + nth // copies[run]
                offset[rows_of] = offsets[run] + nth % copies[run] * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names, "sequence_id", "offset"])

    return rows.mapInArrow(place, schema + ", sequence_id bigint, offset bigint").drop("__rank")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = PAD_ID) -> DataFrame:
    """The token arrays themselves: sequence_id, n_ids (before padding), ids.

    ``packed`` carries ``ids`` per piece, as an array. A sequence is padded to ``capacity`` unless
    its number of ids is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.when(
        F.bit_count("n_ids") == 1, 0).otherwise(F.lit(capacity) - F.col("n_ids")).cast("int"))
    return rows.select("sequence_id", "n_ids", F.concat(ids, pad).alias("ids"))


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, pad_id: int = PAD_ID,
                     max_words: int = MAX_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Every piece of ``docs`` as it lies in its padded sequence.

    ``length`` and ``ids_crc32`` are those of the ids found in the sequence at the piece's offset.
    The first piece of a sequence carries the padded sequence, ``sequence``. Pieces are sorted by
    sequence and offset, so that a task joins, pads and checks whole batches of sequences at once.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity=capacity, with_ids=True, binary=True,
                                 with_crc=False, max_words=max_words, batch_bytes=batch_bytes),
                    compression="zstd")
    columns = ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids"]
    dealt = pack(pieces, capacity).select(*columns).repartition("sequence_id").sortWithinPartitions(
        "sequence_id", "offset")
    names = [*PACKED_NAMES, "sequence"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["sequence_id"]):
            c = {x: table.column(x).to_numpy() for x in columns[:-1] if x != "doc_id"}
            blobs = table.column("ids").to_pylist()
            length = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // (WIDTH // 8)
            flat = np.frombuffer(b"".join(blobs), f"<u{WIDTH // 8}")
            first = np.flatnonzero(np.append(True, np.diff(c["sequence_id"]) != 0))
            n_ids = np.add.reduceat(length, first)
            size = np.where(n_ids & (n_ids - 1) == 0, n_ids, capacity)
            begin = np.cumsum(size) - size
            out = np.full(int(size.sum()), pad_id, dtype="<i4")
            out[np.arange(len(flat)) + np.repeat(begin - (np.cumsum(n_ids) - n_ids), n_ids)] = flat
            pieces_of = np.diff(np.append(first, len(length)))
            at = np.repeat(begin, pieces_of) + c["offset"]
            raw = memoryview(out).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(),
                                                                strict=True)]
            bounds, empty = np.zeros(len(length) + 1, dtype=np.int32), np.ones(len(length), dtype=bool)
            bounds[first + 1], empty[first] = size, False
            sequence = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds, dtype=np.int32)),
                                                pa.array(out), mask=pa.array(empty))
            arrays = [table.column("doc_id").combine_chunks(), pa.array(c["start"]), pa.array(length),
                      pa.array(crc, pa.int64()), pa.array(c["doc_tokens"]), pa.array(c["sequence_id"]),
                      pa.array(c["offset"]), sequence]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"{x} bigint" for x in PACKED_NAMES) + ", sequence array<int>"
    return bounded(dealt).mapInArrow(fill, schema)
