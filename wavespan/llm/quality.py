"""Quality rules: bands of zstandard ratios, over whole documents and over fixed chunks.

Text that repeats itself compresses far better than prose of its length, and text without the
regularities of a language far worse. How well prose compresses depends on its length, so each
length has limits of its own: a centre and a robust spread of the ratios that the corpus itself
shows at that length, for whole texts and for chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded

#: From this many UTF-8 bytes on: least and greatest bytes per compressed byte (level 3), whatever
#: the corpus. Prose of alphabets lies near 1.5 at 400 bytes, 1.9 at 1,500, 2.2 at 6,000 and 2.4 to
#: 3 beyond. Fitted limits lie within these and come near them where a corpus has few texts.
BANDS = (
    (0, 0.0, 1000.0),
    (128, 0.0, 2.4),
    (256, 1.0, 2.4),
    (512, 1.15, 2.5),
    (1024, 1.3, 2.7),
    (2048, 1.4, 2.9),
    (4096, 1.45, 3.0),
    (8192, 1.45, 3.1),
    (16384, 1.5, 3.4),
    (65536, 1.5, 4.0),
)
CHUNK_BYTES = 2048
#: A document whose chunks are mostly out of their band goes, whatever it measures as a whole.
CHUNK_SHARE = 0.5
LEVEL = 3

#: Lengths are fitted in bins of a quarter octave, from ``FIT_FROM`` bytes to the longest string.
BINS_PER_OCTAVE = 4
FIT_FROM, FIT_TO = 128, 1 << 31
#: So many texts weigh what a bin's neighbours say of it, and so many what ``BANDS`` say of those.
FIT_WEIGHT, WIDE_WEIGHT = 5.0, 1.0
#: A neighbour ``d`` bins away counts ``exp(-d * d / 2)``; farther ones than this not at all.
REACH = 4
#: Robust standard deviations around the centre, and the least deviation as a share of the centre.
WIDTH = 3.5
LEAST_SPREAD = 0.01
#: Ratios are counted in cells of this width, all from ``MOST_RATIO`` on in one.
CELL, MOST_RATIO = 0.002, 8.0

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
          "n_dup_lines bigint, n_repeat_words bigint, ratio double, n_chunks bigint, "
          "bad_chunks bigint, base_failed boolean, kept boolean")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    d = len(codes)
    pair = a[:-1] * d + a[1:]
    if d ** 3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * d + a[2:]
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i:n - 2 + i] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class Bands:
    def __init__(self, bands, level: int = LEVEL):
        self.starts = [b[0] for b in bands]
        self.least = [b[1] for b in bands]
        self.most = [b[2] for b in bands]
        self.compressor = zstandard.ZstdCompressor(level=level)

    def measure(self, data: bytes) -> tuple[float, bool]:
        """The ratio, and whether it lies outside of the band of its length."""
        if not data:
            return 0.0, False
        ratio = len(data) / len(self.compressor.compress(data))
        i = int(np.searchsorted(self.starts, len(data), side="right")) - 1
        return ratio, not self.least[i] <= ratio <= self.most[i]


def cuts(size: int, chunk_bytes: int) -> list[int]:
    """Where the chunks of a text of ``size`` bytes begin, and its end."""
    return [*range(0, max(1, size // chunk_bytes) * chunk_bytes, chunk_bytes), size]


def length_bin(size: int) -> int:
    return int(np.floor(np.log2(size) * BINS_PER_OCTAVE))


def fit(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> tuple:
    """Bands of whole texts and bands of chunks, from all ``docs`` that pass the base rule.

    A bin of lengths is centred on the median of its ratios and reaches ``WIDTH`` standard
    deviations, estimated by the median deviation, to both sides, within ``BANDS``; both estimates
    are drawn towards those of the neighbouring bins, the more the fewer texts it has. Equal texts
    and equal chunks count once. Null texts and those of under ``FIT_FROM`` bytes take no part, very
    long ones do as a whole and by chunks. Without texts the bands are ``BANDS``. Only counts by
    length bin and ratio cell reach the driver.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)

        def row(chunk: bool, data: bytes) -> tuple:
            ratio = min(len(data) / len(compressor.compress(data)), MOST_RATIO)
            key = hashlib.blake2b(data, digest_size=8).digest()
            return (chunk, length_bin(len(data)), int(ratio / CELL),
                    int.from_bytes(key, "little", signed=True))

        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                data = text.encode()
                if len(data) < FIT_FROM or base_rule(data.split())[1]:
                    continue
                rows.add(row(False, data))
                at = cuts(len(data), chunk_bytes)
                if len(at) > 2:
                    rows.update(row(True, data[a:b]) for a, b in zip(at, at[1:]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.bool_()] + [pa.int64()] * 3, strict=True)],
                names=["chunk", "bin", "cell", "key"])

    texts = bounded(docs.where("text is not null").select("text"))
    found = texts.mapInArrow(measure, "chunk boolean, bin bigint, cell bigint, key bigint")
    counts: dict[tuple[bool, int], list[tuple[float, int]]] = {}
    for r in found.distinct().groupBy("chunk", "bin", "cell").count().collect():
        counts.setdefault((r["chunk"], r["bin"]), []).append(((r["cell"] + 0.5) * CELL, r["count"]))
    return tuple(fitted({k: v for (c, k), v in counts.items() if c == chunk})
                 for chunk in (False, True))


def median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    sums = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(sums, sums[-1] / 2)])


def from_neighbours(own: dict[int, tuple[float, float, float]], at: int, least: float,
                    most: float) -> tuple[float, float]:
    """Centre and variance that the bins around ``at`` let expect there.

    Centres change steadily with length, so theirs are carried on along a weighted line; variances
    are averaged. The band from ``least`` to ``most`` counts as ``WIDE_WEIGHT`` texts more.
    """
    centre, variance = (least + most) / 2, ((most - least) / (2 * WIDTH)) ** 2
    near = [(j, *own[at + j]) for j in range(-REACH, REACH + 1) if j and at + j in own]
    if not near:
        return centre, variance
    j, c, spread, n = np.array(near, dtype=float).T
    w = n * np.exp(-j * j / 2)
    weight = w.sum()
    mid, mean = w @ j / weight, w @ c / weight
    slope = (w * (j - mid)) @ (c - mean) / (w @ (j - mid) ** 2 + WIDE_WEIGHT)
    total = weight + WIDE_WEIGHT
    return ((weight * (mean - slope * mid) + WIDE_WEIGHT * centre) / total,
            (w @ spread ** 2 + WIDE_WEIGHT * variance) / total)


def fitted(counts: dict[int, list[tuple[float, int]]]) -> tuple:
    """Bands from (ratio, how many) of each length bin.

    One rule for every number of texts: a bin's own centre and variance count by its ``n`` texts,
    those expected from its neighbours by ``FIT_WEIGHT``.
    """
    own = {}
    for k, found in counts.items():
        ratios, n = np.array(found, dtype=float).T
        centre = median(ratios, n)
        spread = max(1.4826 * median(np.abs(ratios - centre), n), LEAST_SPREAD * centre)
        own[k] = centre, spread, n.sum()
    starts = {b[0] for b in BANDS}
    starts |= {int(np.ceil(2 ** (k / BINS_PER_OCTAVE)))
               for k in range(length_bin(FIT_FROM), length_bin(FIT_TO) + 1)}
    rows = []
    for start in sorted(starts):
        _, least, most = [b for b in BANDS if b[0] <= start][-1]
        if start >= FIT_FROM:
            at = length_bin(start)
            centre, variance = from_neighbours(own, at, least, most)
            c, spread, n = own.get(at, (0.0, 0.0, 0.0))
            share = n / (n + FIT_WEIGHT)
            centre = share * c + (1 - share) * centre
            reach = WIDTH * np.sqrt(share * spread ** 2 + (1 - share) * variance)
            least, most = float(max(least, centre - reach)), float(min(most, centre + reach))
        rows.append((start, least, most))
    return tuple(rows)


def base_rule(words: list[bytes]) -> tuple[int, bool]:
    """Words in repeated windows, and whether the text fails the base rule."""
    repeats = repeat_words(words)
    return repeats, len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)


def judge(text: str, limits: Bands, chunk_limits: Bands, chunk_bytes: int = CHUNK_BYTES,
          chunk_share: float = CHUNK_SHARE) -> tuple:
    """What ``SCHEMA`` lists after doc_id, for one whole text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    repeats, failed = base_rule(words)
    ratio, out = limits.measure(data)
    at = cuts(len(data), chunk_bytes)
    chunks = len(at) - 1
    bad = (sum(chunk_limits.measure(data[a:b])[1] for a, b in zip(at, at[1:]))
           if chunks > 1 else int(out))
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            duplicate_lines(text), repeats, ratio, chunks, bad, failed,
            not failed and not out and bad <= chunk_share * chunks)


def score(docs: DataFrame, bands=None, chunk_bytes: int = CHUNK_BYTES,
          chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text) with the base counts, ratios and verdicts.

    A null text counts as empty. Empty and short texts fail the base rule of ``MIN_WORDS`` words.
    The last chunk takes in what is left over and is judged by its own length. Texts are taken
    whole; repeated rows give repeated results; other columns are ignored. ``bands`` are a pair,
    of whole texts and of chunks, as ``fit`` returns them; by default those of ``docs``.
    """
    bands = bands or fit(docs, chunk_bytes, level)
    kinds = [pa.int64()] * 6 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = [Bands(b, level) for b in bands]
        for batch in batches:
            rows = [(doc, *judge(text, *limits, chunk_bytes, chunk_share)) for doc, text in
                    zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return bounded(rows).mapInArrow(measure, SCHEMA)


def keep(docs: DataFrame, bands=None, chunk_bytes: int = CHUNK_BYTES,
         chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Each row is judged where it lies: no join on ``doc_id``, and rows that share one are judged
    each for itself. ``bands`` as in ``score``.
    """
    bands = bands or fit(docs, chunk_bytes, level)
    at = docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = [Bands(b, level) for b in bands]
        for batch in batches:
            yield batch.filter(pa.array([
                judge(text or "", *limits, chunk_bytes, chunk_share)[-1]
                for text in batch.column(at).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(passing, docs.schema)
