"""Token files: one concatenated id array with Elias-Fano coded document boundaries.

The corpus is cut into segments in ascending ``doc_id`` order. A segment holds whole documents: a
concatenated array of unsigned 16-bit ids (32-bit if the vocabulary needs it), the Elias-Fano code
of the documents' ends within it with its select samples, and the documents' names. Segments are
rows of a Parquet table, so Spark's committer makes the write safe against lost and repeated tasks
on any file system, and a reader takes in one segment at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded
from wavespan.llm.eliasfano import EliasFano
from wavespan.llm.tokens import encoder

SEGMENT_IDS = 1 << 17
#: Words that a worker remembers while it writes; nothing else needs its memory then.
WORDS = 500_000
#: Bytes of text that it encodes at a time.
TEXT_BYTES = 8 << 20

#: Characters by which rows that share an id are ordered and dealt to tasks.
HEAD = 64

SEGMENTS = ("shard bigint, segment bigint, n_docs bigint, n_ids bigint, id_bytes bigint, "
            "width bigint, lower binary, upper binary, samples binary, names array<bigint>, "
            "ids binary")


def _segment(shard: int, segment: int, names: list, sizes: list[int], ids: list[np.ndarray],
             id_bytes: int) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    code = EliasFano.encode(ends, int(ends[-1]))
    flat = np.concatenate(ids).astype(f"<u{id_bytes}").tobytes()
    row = {"shard": shard, "segment": segment, "n_docs": len(names), "n_ids": int(ends[-1]),
           "id_bytes": id_bytes, "width": code.width}
    arrays = [pa.array([v], pa.int64()) for v in row.values()]
    arrays += [pa.array([v], pa.binary()) for v in (code.lower, code.upper, code.samples)]
    arrays += [pa.array([names], pa.list_(pa.int64())), pa.array([flat], pa.binary())]
    return pa.RecordBatch.from_arrays(
        arrays, names=[*row, "lower", "upper", "samples", "names", "ids"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                 segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) into a token table at ``path``.

    Every document gets ``end_id`` after its ids. A null text counts as empty; documents without
    ``doc_id`` come first; rows that repeat a ``doc_id`` follow each other in the order of their
    first ``HEAD`` characters, then of a hash of their texts. A segment closes with the document that brings it to ``segment_ids`` ids, so one
    document longer than that makes a segment of its own. Other columns are ignored.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, WORDS)
        id_bytes = 2 if max(words.size, end_id + 1) <= 1 << 16 else 4
        shard, number = TaskContext.get().partitionId(), 0
        names, sizes, ids, total = [], [], [], 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            found_in = words.encode(batch.column(1), TEXT_BYTES)
            for name, found in zip(batch.column(0).to_pylist(), found_in, strict=True):
                names.append(name)
                sizes.append(len(found) + 1)
                ids += [found.astype(f"<u{id_bytes}"), end]
                total += len(found) + 1
                if total >= segment_ids:
                    yield _segment(shard, number, names, sizes, ids, id_bytes)
                    names, sizes, ids, total, number = [], [], [], 0, number + 1
        if names:
            yield _segment(shard, number, names, sizes, ids, id_bytes)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that share an id spread by their first characters and a hash, equal ones by their place
    order = [F.col("doc_id"), F.substring("text", 1, HEAD), F.xxhash64("text")]
    (bounded(rows.withColumn("place", F.monotonically_increasing_id()))
     .repartitionByRange(*order, "place").sortWithinPartitions(*order, "text")
     .select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(path))


def read_segment(row: dict) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of one segment."""
    code = EliasFano(row["n_docs"], row["width"], row["lower"], row["upper"], row["samples"])
    return code, np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}")


def document_ids(row: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of a segment, found by select alone."""
    code, ids = read_segment(row)
    return ids[code[i - 1] if i else 0:code[i]]


def _bases(segments: DataFrame) -> DataFrame:
    """Number of ids before each segment: within its shard, then before the shard."""
    small = segments.select("shard", "segment", "n_ids")
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1)
    shards = small.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard: as many as the write had tasks
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (small.join(shards, "shard")
            .select("shard", "segment",
                    (F.coalesce(F.sum("n_ids").over(within), F.lit(0)) + F.col("base"))
                    .alias("base")))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document of a token table: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) and, if asked for, the ids. Ends of
    documents come from select."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    schema = ("shard bigint, segment bigint, doc_id bigint, local_start bigint, n_tokens bigint, "
              "ids_crc32 bigint" + ", ids array<bigint>" * with_ids)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, ids = read_segment(row)
                ids = ids.astype("<u4")
                ends = np.fromiter((code[i] for i in range(code.n)), dtype=np.int64, count=code.n)
                starts = np.concatenate([[0], ends[:-1]])
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                arrays = [pa.array(np.full(n, row["shard"])), pa.array(np.full(n, row["segment"])),
                          pa.array(row["names"], pa.int64()), pa.array(starts, pa.int64()),
                          pa.array(ends - starts, pa.int64()),
                          pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["shard", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int64) for p in parts],
                                           pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = segments.mapInArrow(documents, schema)
    columns = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return found.join(_bases(segments), ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), *columns)
