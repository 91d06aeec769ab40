"""Shared helpers, the pipeline and the registry."""

import os

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import Scratch, components


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t7…😀", max_size=30)), max_size=8))
def test_words_match_a_regex(texts):
    import re

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for at, to, data, offsets in X.slices(batch, "text", 8):
        start, end, first = X.words(data, offsets, X.BLANK_WORD)
        for i in range(to - at):
            got.append([data[s:e].tobytes() for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)])
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]


def test_span_hashes_are_of_content():
    data = np.frombuffer(b"xxabcabcyyabc", np.uint8)
    h = X.span_hash(X.prefix_hash(data), np.array([2, 5, 10, 0]), np.array([5, 8, 13, 3]))
    assert h[0] == h[1] == h[2] != h[3]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    low = {x: x for e in edges for x in e}
    while True:
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    want = {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.component for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(40)]
    near = texts[0].split()
    near[3] = "changed"
    texts += [" ".join(near), texts[1], "123", None, ""]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        new = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert new.dtypes == docs.dtypes
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["language_id"] == set(range(42)) and kept["line_dedup"] == set(range(41)) and kept["ngram_jaccard_join"] == set(range(40))
    assert kept["mixing"] == kept["packing"] < set(range(40)) and len(kept["mixing"]) >= 30
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == kept["packing"]


def test_pipeline_near_copies_that_share_lines(spark, tmp_path):
    """A near copy loses most lines to line dedup; its remains are still one of the group, and a clean text with a common line stays."""
    import corpus_pipeline as P

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    lines = [[" ".join(rng.choice(words, 12)) for _ in range(12)] for _ in range(6)]
    near = [*lines[0][:5], "one line that was changed here and there today", *lines[0][6:]]
    shared = [*lines[1][:2], *(" ".join(rng.choice(words, 12)) for _ in range(10))]
    texts = ["\n".join(x) for x in [*lines, near, shared]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[1:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5, 7} and len(left[7].split("\n")) == 10 and all(left[i] == texts[i] for i in range(6))


def test_registry():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(e.oracle_sql()) <= set(names)


def test_scratch_is_shared_and_dropped(spark):
    s = Scratch(spark)
    df = s.store(spark.range(5).withColumn("x", F.lit("a")))
    assert s.root.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5
    s.drop(df)
    assert not os.path.exists(df._scratch_path)
