import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from wavespan.llm import QUERIES, linededup, mixing, quality
from wavespan.llm.tokens import default_path, encoder


def corpus(seed=12):
    rng = random.Random(seed)
    sounds = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "or", "est")]

    def prose(n):
        return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 3)))
                        for _ in range(n))

    rows = [(i, prose(rng.randint(60, 200)) + f"\nRead {i} more pages like this one\n"
             + prose(rng.randint(20, 60)), "abcd"[i % 4]) for i in range(60)]
    rows += [(100 + i, rows[i][1], "b") for i in range(8)]  # exact copies
    rows += [(200 + i, rows[20 + i][1] + " yes", "c") for i in range(8)]  # near copies
    rows += [(300, "too short", "a"), (301, "so " * 900, "a"), (302, None, None)]
    return rows


def test_stages(spark, docs, tmp_path):
    frame, seen = docs(*corpus()), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != "pack_sequences":
            assert now.columns == frame.columns
    clean = {r[0] for r in corpus() if r[0] < 300}
    assert {r.doc_id for r in seen["quality_rules"]} == clean
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert sum("more pages" in t for t in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    left = {r.doc_id for r in seen["near_dedup"]}
    assert left == {d for d in lines if d < 100}
    sizes = {r.doc_id: len(r.text.encode().split()) for r in seen["near_dedup"]}
    copies = {}
    for r in seen["mix_sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= left and max(copies.values()) <= 3
    assert abs(sum(sizes[d] * n for d, n in copies.items()) / sum(sizes.values()) - 1) < 0.25
    texts = {r.doc_id: r.text for r in seen["mix_sources"]}
    found = {}
    for p in seen["pack_sequences"]:
        found.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    for doc, parts in found.items():
        ids = np.append(np.frombuffer(encoder(default_path()).whole([texts[doc]])[0], "<u4"), 1)
        ids = ids.astype("<u4")
        assert sum(n for _, n, _ in parts) == len(ids) * copies[doc]
        assert all(crc == zlib.crc32(ids[s:s + n].tobytes()) for s, n, crc in parts)


def test_run_reads_the_table(spark, docs, tmp_path):
    docs(*corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert rows.count() > 0 and "sequence_id" in rows.columns
    docs().write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_stages_equal_their_operators_on_odd_rows(spark, odd_docs):
    kept = corpus_pipeline.quality_rules(spark, odd_docs, "").collect()
    want = [r.doc_id for r in quality.score(odd_docs).collect() if r.kept]
    assert [r.doc_id for r in kept] == want
    lines = corpus_pipeline.line_dedup(spark, odd_docs, "").count()
    assert lines == linededup.drop_recurring(odd_docs).count()
    one = corpus_pipeline.near_dedup(spark, odd_docs, "").collect()
    assert sum(r.text == "one" for r in one) == 1
    mixed = corpus_pipeline.mix_sources(spark, odd_docs, "").count()
    assert mixed == sum(r.copies for r in mixing.plan(odd_docs).collect())


def test_repeated_rows_and_clashing_names(docs):
    text = "one two three four five six seven"
    rows = docs((1, text), (1, text), (2, text), (1, "other words of the same number here now"),
                (None, text), (None, text)).withColumn("n_lines", F.lit("mine")).withColumn(
        "n_dropped", F.lit(5))
    kept = corpus_pipeline.near_dedup(None, rows, "").collect()
    other = "other words of the same number here now"
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, text), (0, text), (1, text), (1, other)]
    lines = corpus_pipeline.line_dedup(None, rows, "")
    assert lines.columns == rows.columns
    assert {(r.n_lines, r.n_dropped) for r in lines.collect()} == {("mine", 5)}


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
