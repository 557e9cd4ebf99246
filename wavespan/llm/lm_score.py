"""Language-model scores: cross-entropy difference of two matched bigram models.

The target model is counted over a table of wanted texts, the background model over the whole
corpus. Both share the ids of one public vocabulary and one kind of smoothing: a bigram's share
after its first id, drawn towards the unigram share, which is drawn towards an equal share for all
ids. A document's score is its mean loss a token under the target model minus that under the
background model: the lower, the closer to the target.

Unigram counts are bounded by the vocabulary. Bigram counts are not, so they are never gathered in
one place: the corpus is cut into blocks of documents, every block states its distinct bigrams with
their counts, one shuffle by bigram sums them up, and the sums return to the blocks that asked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded
from wavespan.llm.tokens import encoder
from wavespan.session import stored

#: A block closes with the document that brings it to this many tokens, a row of it likewise.
BLOCK_TOKENS = 2 << 20
ROW_TOKENS = 1 << 16
#: Pseudo-counts that draw bigrams to unigrams and unigrams to an equal share.
PULL = 20.0
FLOOR = 1.0

#: Words that a worker remembers; the models' shuffles need the memory afterwards.
MEMORY_WORDS = 150_000
TEXT_BYTES = 3 << 20
#: Tokens of a block whose losses are looked up at once.
SLICE_TOKENS = 1 << 18

BLOCKS = "block bigint, names array<bigint>, sizes array<bigint>, ids binary"


def token_blocks(docs: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of documents' concatenated ids, several to a block; a null text counts as empty."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, MEMORY_WORDS)
        kind = "<u2" if words.size <= 1 << 16 else "<u4"
        block = TaskContext.get().partitionId() << 32
        names, ids, total, in_block = [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                 pa.array([b"".join(x.tobytes() for x in ids)], pa.binary())],
                names=["block", "names", "sizes", "ids"])

        for batch in batches:
            found_in = words.encode(batch.column(1), TEXT_BYTES)
            for name, found in zip(batch.column(0).to_pylist(), found_in, strict=True):
                names.append(name)
                ids.append(found.astype(kind))
                total += len(found)
                if total >= min(ROW_TOKENS, block_tokens):
                    yield row()
                    in_block += total
                    names, ids, total = [], [], 0
                    if in_block >= block_tokens:
                        block, in_block = block + 1, 0
        if names:
            yield row()
        words.forget()

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(cut, BLOCKS)


def pairs_of(sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbouring ids within documents, and the positions of their second ids."""
    second = np.ones(len(ids), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    second[starts[starts < len(ids)]] = False
    at = np.flatnonzero(second)
    wide = ids.astype(np.int64)
    return wide[at - 1] << 32 | wide[at], at


def counts(blocks: DataFrame, size: int) -> DataFrame:
    """block, pair, n: a block's distinct bigrams; unigrams count as pairs with the negative id
    ``-1 - id``."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def counted(block: int, parts: list[dict]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(p["ids"] for p in parts), kind)
        sizes = np.array([n for p in parts for n in p["sizes"]], dtype=np.int64)
        pairs, n = np.unique(pairs_of(sizes, ids)[0], return_counts=True)
        single, m = np.unique(ids, return_counts=True)
        found = np.concatenate([-1 - single.astype(np.int64), pairs])
        n = np.concatenate([m, n]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), block)), pa.array(found), pa.array(n)],
            names=["block", "pair", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block cut in two by a file's split is stated in two parts, whose counts add up
        rows = (row for batch in batches for row in batch.to_pylist())
        for block, parts in itertools.groupby(rows, key=lambda row: row["block"]):
            yield counted(block, list(parts))

    return blocks.mapInArrow(count, "block bigint, pair bigint, n bigint")


class Model:
    """Smoothed log shares of bigrams from their counts and those of single ids."""

    def __init__(self, single: np.ndarray, pull: float = PULL, floor: float = FLOOR):
        self.pull, self.single = pull, single
        self.share = (single + floor) / (single.sum() + floor * len(single))

    def loss(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        return -np.log((n + self.pull * self.share[second]) / (self.single[first] + self.pull))

    def first_loss(self, ids: np.ndarray) -> np.ndarray:
        return -np.log(self.share[ids])


def singles(table: DataFrame, size: int) -> np.ndarray:
    """Counts of single ids, at most one row an id of the vocabulary."""
    rows = table.where("pair < 0").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[-1 - rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def score(docs: DataFrame, target: DataFrame, tokenizer: str, pull: float = PULL,
          floor: float = FLOOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means a token) and score, their difference.

    ``docs`` and ``target`` are tables of (doc_id, text). Texts are taken whole; a null or empty
    one has 0 tokens and null losses. Repeated rows are scored each for itself and all count in
    the background; an empty target gives a model of equal shares. Other columns are ignored.
    """
    size = encoder(tokenizer).size
    blocks = stored(token_blocks(docs, tokenizer, block_tokens))
    wanted = counts(token_blocks(target, tokenizer, block_tokens), size)
    wanted = stored(wanted.groupBy("pair").agg(F.sum("n").alias("n")))
    asked = stored(counts(blocks, size))
    of_target = Model(singles(wanted, size), pull, floor)
    of_all = Model(singles(asked, size), pull, floor)
    # a common bigram has a row a block: its counts add up where they lie, and the join of the sums
    # with the blocks is one that Spark splits where a key is common
    counted = asked.where("pair >= 0").select("pair", F.col("n").alias("n_all"),
                                              F.lit(0).cast("long").alias("n_target"))
    sums = counted.unionByName(wanted.where("pair >= 0").select(
        "pair", F.lit(0).cast("long").alias("n_all"), F.col("n").alias("n_target")))
    sums = sums.groupBy("pair").agg(F.sum("n_all").alias("n_all"),
                                    F.sum("n_target").alias("n_target"))
    summed = asked.where("pair >= 0").select("block", "pair").join(sums, "pair").select(
        "block", "pair", "n_all", "n_target")

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n_all, n_target = (batch.column(i).to_numpy(zero_copy_only=False)
                                      for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(of_target.loss(pairs, n_target)),
                 pa.array(of_all.loss(pairs, n_all))],
                names=["block", "pair", "target_loss", "all_loss"])

    known = summed.mapInArrow(
        losses, "block bigint, pair bigint, target_loss double, all_loss double")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs = pairs[order]
        by_pair = [right.column(c).to_numpy()[order] for c in ("target_loss", "all_loss")]
        names, n, sums = [], [], [np.zeros((2, 0))]
        for row in left.to_pylist():
            names += row["names"]
            n += row["sizes"]
            flat = np.frombuffer(row["ids"], "<u2" if size <= 1 << 16 else "<u4")
            ends = np.cumsum(np.array(row["sizes"], dtype=np.int64))
            first = 0
            while first < len(ends):  # whole documents, a slice at a time
                start = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + SLICE_TOKENS)))
                part = ends[first:last] - start
                sizes = np.diff(part, prepend=0)
                ids = flat[start:start + int(part[-1])].astype(np.int64)
                codes, at = pairs_of(sizes, ids)
                where = np.searchsorted(pairs, codes)
                per = []
                for model, loss in zip((of_target, of_all), by_pair, strict=True):
                    each = model.first_loss(ids)
                    if len(at):
                        each[at] = loss[where]
                    total = np.concatenate([[0.0], np.cumsum(each)])
                    per.append(total[part] - total[part - sizes])
                sums.append(np.array(per))
                first = last
        per, n = np.concatenate(sums, axis=1), np.array(n, dtype=np.int64)
        empty = n == 0
        means = per / np.maximum(n, 1)
        return pa.table([pa.array(names, pa.int64()), pa.array(n),
                         *(pa.array(x, mask=empty) for x in (*means, means[0] - means[1]))],
                        names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        apply, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, "
               "score double")

