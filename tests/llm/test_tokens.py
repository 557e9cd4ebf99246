import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespan.llm import packing, tokenfile
from wavespan.llm.eliasfano import EliasFano
from wavespan.llm.tokens import default_path, encoder


def whole(texts):
    return [np.frombuffer(x, "<u4") for x in encoder(default_path()).whole(texts)]


def test_words_joined_equal_whole_texts():
    rng = random.Random(5)
    parts = ["foo", "Foo,", "don't", "x's", " ", "  ", "\n", "\n\n", "\t", "é", "ÄÖ!", "日本", "12",
             "a1b", "...", "'", "<|endoftext|>", "\u00a0", "\u3000", "\x1c", "end."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))
             for _ in range(1500)]
    found = list(encoder(default_path()).encode(texts))
    assert [f.tolist() for f in found] == [w.tolist() for w in whole(texts)]


@pytest.mark.parametrize("values, universe", [
    ([], 0), ([0], 0), ([5], 5), ([3, 3, 3, 9], 9), (list(range(3000)), 3000),
    (np.sort(np.random.default_rng(1).integers(0, 10**7, 5000)).tolist(), 10**7),
    ([1] * 700 + [10**9], 10**9)])
def test_elias_fano_round_trip(values, universe):
    code = EliasFano.encode(np.array(values, dtype=np.int64), universe)
    assert code.values().tolist() == values
    assert [code[i] for i in range(len(values))] == values
    if len(values) > 1000 and universe > 10**6:
        assert len(code.lower) + len(code.upper) < len(values) * (3 + np.log2(universe / len(values))) / 8


def test_token_file_round_trip(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokenfile.write_tokens(odd_docs, path, default_path(), segment_ids=50)
    rows = tokenfile.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    texts = sorted(odd_docs.select("doc_id", "text").collect(),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc, _), ids in zip(rows, texts, whole([t or "" for _, t in texts]), strict=True):
        ids = np.append(ids, 2).astype("<u4")
        assert (row.doc_id, row.start, row.n_tokens) == (doc, start, len(ids))
        assert row.ids == ids.tolist() and row.ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)
    segment = spark.read.parquet(path).where("n_docs > 1").first().asDict()
    ends = np.cumsum([0] + [len(tokenfile.document_ids(segment, i))
                            for i in range(segment["n_docs"])])
    assert ends[-1] == segment["n_ids"]


def test_documents_are_found_by_the_stored_samples(spark, docs, tmp_path):
    path, broken = f"file://{tmp_path}/ids", f"file://{tmp_path}/broken"
    frame = docs(*[(i, "one two three") for i in range(600)])
    tokenfile.write_tokens(frame.coalesce(1), path, default_path(), segment_ids=1 << 20)
    segments = spark.read.parquet(path)
    spoilt = F.concat(F.substring("samples", 1, 8), F.lit(bytes([3] + [0] * 7)),
                      F.expr("substring(samples, 17)"))
    segments.withColumn("samples", F.when(F.length("samples") > 8, spoilt).otherwise(
        F.col("samples"))).write.parquet(broken)
    right = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert segments.where("length(samples) > 8").count()
    assert len(right) == 600
    with pytest.raises(Exception):
        assert tokenfile.read_tokens(spark, broken).orderBy("start").collect() == right


def test_rows_that_share_id_and_opening_are_dealt_over_tasks(spark, docs, tmp_path):
    path, opening = f"file://{tmp_path}/ids", "word " * 20
    frame = docs(*[(None, opening + str(i)) for i in range(200)], *[(7, opening)] * 200)
    joins_small_tasks = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joins_small_tasks, "false")
    try:
        tokenfile.write_tokens(frame, path, default_path())
    finally:
        spark.conf.set(joins_small_tasks, "true")
    per_task = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()
    assert max(r.n for r in per_task) < 200
    rows = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 200 + [7] * 200
    texts = [opening + str(i) for i in range(200)] + [opening] * 200
    assert sorted(r.ids_crc32 for r in rows) == sorted(
        zlib.crc32(np.append(x, 2).astype("<u4").tobytes()) for x in whole(texts))


def test_token_file_of_no_documents(spark, docs, tmp_path):
    path = f"file://{tmp_path}/none"
    tokenfile.write_tokens(docs(), path, default_path())
    assert tokenfile.read_tokens(spark, path).count() == 0


def test_patterns_hold_every_piece_and_fit():
    rng = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 101, 60), rng.integers(1, 500, 60))}
    found = packing.patterns(histogram, 100)
    placed = {}
    for count, lengths in found:
        assert sum(lengths) <= 100
        for length in lengths:
            placed[length] = placed.get(length, 0) + count
    assert placed == histogram
    assert packing.patterns({}, 100) == []
    assert sorted(packing.patterns({60: 2, 30: 3}, 100)) == [(1, (30,)), (2, (60, 30))]


def test_packing_covers_every_id_once(spark, odd_docs):
    pieces = packing.token_pieces(odd_docs, default_path(), capacity=64, with_ids=True)
    packed = packing.pack(pieces.withColumn("bucket", pieces.start), 64).collect()
    texts = {}
    for row in odd_docs.collect():
        texts.setdefault(row.doc_id, []).append(len(whole([row.text or ""])[0]) + 1)
    by_sequence = {}
    for p in packed:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
        assert p.doc_tokens in texts[p.doc_id] and p.length == len(p.ids)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(p.length for p in packed) == sum(map(sum, texts.values()))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    frame = spark.createDataFrame([(p.sequence_id, p.offset, p.length, p.ids) for p in packed],
                                  "sequence_id long, offset long, length long, ids array<long>")
    rows = packing.sequences(frame, 64).collect()
    assert len(rows) == len(by_sequence)
    assert all(len(r.ids) == (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 64) for r in rows)


def test_packing_of_no_documents(docs):
    assert packing.pack(packing.token_pieces(docs(), default_path())).count() == 0


def test_packed_sequences_hold_the_ids_at_their_places(odd_docs):
    rows = packing.packed_sequences(odd_docs, default_path(), capacity=64).collect()
    assert {f for r in rows for f in r.asDict()} == {*packing.PACKED_NAMES, "sequence"}
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(np.append(whole([r.text or ""])[0], 1).tolist())
    padded = {r.sequence_id: r.sequence for r in rows if r.offset == 0}
    assert all((r.sequence is None) == (r.offset > 0) for r in rows)
    used = dict.fromkeys(padded, 0)
    for r in rows:
        found = padded[r.sequence_id][r.offset:r.offset + r.length]
        assert any(t[r.start:r.start + r.length] == found and len(t) == r.doc_tokens
                   for t in texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(found, "<u4").tobytes())
        used[r.sequence_id] += r.length
    assert sum(used.values()) == sum(len(t) for ts in texts.values() for t in ts)
    for i, n in used.items():
        assert len(padded[i]) == (n if n & (n - 1) == 0 else 64)
        assert not any(padded[i][n:])
