"""Fill-in-middle, decontamination and resampling against brute force, and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination as C
from factloom.llm import fill_middle as M
from factloom.llm import queries as Q
from factloom.llm import resampling as R
from tests.llm.test_documents import AWKWARD, corpus, make, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["one\ntwo\nthree", "\n\n\n", "no end", "ends\n", "\n", "é\nü\n😀😀\nx", "has <P> in it\nx", "a <S>\nb", "<M>", "<\n<P\n<S\n<M", "a  b c\td\n e", "\r\n\r\nx\r", "x" * 70_000 + "\n" + "y\n" * 3000, None, ""]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def units(text, unit):
    return {"line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+"), "char": re.compile(r".", re.S)}[unit].findall(text)


def filled(doc_id, text, s):
    text = text or ""
    u = units(text, s.unit)
    h = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in s.marks) or h3 % 100 >= s.rate:
        return doc_id, len(u), "plain", None, None, text
    if h4 % 100 < s.spm:
        return doc_id, len(u), "spm", len(pre), len(mid), s.suffix + suf + s.prefix + pre + s.middle + mid
    return doc_id, len(u), "psm", len(pre), len(mid), s.prefix + pre + s.suffix + suf + s.middle + mid


@pytest.mark.parametrize("setting", [M.Setting(), M.Setting(unit="word", seed="x", rate=60, spm=20), M.Setting(unit="char", spm=100), M.Setting(unit="char", rate=0), M.Setting(prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")])
def test_fill_middle(spark, setting):
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(rng.choice(list("ab \n\té😀"), int(rng.integers(0, 40)))) for _ in range(300)] + corpus()
    docs = make(spark, texts)
    got = M.fill_middle(docs, setting)
    assert sorted(map(tuple, got.collect())) == sorted(filled(i, t, setting) for i, t in enumerate(texts))
    back = {r.doc_id: r.t for r in got.select("doc_id", M.restored(F.col("output"), F.col("form"), setting).alias("t")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_fill_middle_settings():
    for bad in (dict(unit="page"), dict(prefix=""), dict(prefix="<S>"), dict(prefix="<S>x"), dict(prefix=">a", suffix="b>")):
        with pytest.raises(ValueError, match="sentinel|unit"):
            M.Setting(**bad)


def leaks(texts, items, size):
    """doc -> (words, hit words, items)."""
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in wins}
    out = []
    for i, text in enumerate(texts):
        w, hit, named = words(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (win := tuple(w[at : at + n])) in wins:
                    hit |= set(range(at, at + n))
                    named |= wins[win]
        out.append((i, len(w), len(hit), len(named), sorted(named), bool(hit)))
    return out


@pytest.mark.parametrize("seed,size", [(0, 10), (1, 3), (2, 1), (3, 2)])
def test_decontamination(spark, seed, size):
    rng = np.random.default_rng(seed)
    items = [(f"i{k}", prose(rng, int(rng.integers(1, 30)))) for k in range(25)] + [("one", "w1"), ("none", " . "), (None, prose(rng, 12)), ("null", None), ("hot", "w2 " * 14), ("same", "w3 w3 w4"), ("É", "ÉCOLE Élan écoLE")]
    items += [("copy", items[0][1].upper()), (items[1][0], items[1][1])]
    texts = corpus(seed)
    for k, t in enumerate(texts[:20]):
        if t:
            w = items[k][1].split()
            at = int(rng.integers(0, len(w)))
            texts[k] = t + " -- " + ", ".join(w[at:] * 2).title() + " " + t[:30]
    texts += ["w2 " * 40, "w2 w3 w3 w3 w4", "école ÉLAN", "ÉCOLE élan", "Élan école élan ÉcolE", items[4][1].replace(" ", "\n\t")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(map(tuple, C.decontaminate(make(spark, texts), bench, C.Setting(size=size)).collect()))
    assert got == leaks(texts, items, size)


def near(texts, items, size, slack):
    """doc -> items whose window's words stand within len(window) + slack words, and that do not occur exactly."""
    out = {}
    exact = {i: set(named) for i, _, _, _, named, _ in leaks(texts, items, size)}
    for i, text in enumerate(texts):
        w, found = words(text), set()
        for item, t in items:
            v = words(t)
            for at in range(max(1, len(v) - size + 1)) if v else ():
                need = Counter(v[at : at + size])
                wide = sum(need.values()) + slack
                found |= {item for x in range(len(w)) if not need - Counter(w[x : x + wide])}
        out[i] = len(found - exact[i])
    return out


def test_proximity(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary, int(rng.integers(2, 7))))) for k in range(12)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))) for _ in range(40)] + ["", None]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for slack in (0, 3):
        got = C.decontaminate(make(spark, texts), bench, C.Setting(size=4, slack=slack))
        assert {r.doc_id: r.n_near for r in got.collect()} == near(texts, items, 4, slack)


def resampled(rows, target, s):
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, s.n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % s.buckets
    here, there = Counter(), Counter()
    for _, t in rows:
        here.update(map(bucket, grams(words(t))))
    for t in target:
        there.update(map(bucket, grams(words(t))))
    S, T = sum(here.values()), sum(there.values())
    gain = lambda x: math.floor(1000 * math.log((there[x] + 1) * (S + s.buckets) / ((here[x] + 1) * (T + s.buckets))))
    out, n = [], 0
    for i, t in rows:
        g = [gain(bucket(x)) for x in grams(words(t))]
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        n += len(words(t)) >= s.least_words
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(t)) >= s.least_words])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0], -r[2], r[1]))[: s.percent * n // 100]
    for k, r in enumerate(drawn):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("setting,pages", [(R.Setting(), None), (R.Setting(n=3, buckets=50, percent=50, least_words=5), None), (R.Setting(n=2, percent=100, least_words=0), 300), (R.Setting(n=1, buckets=1, seed="z"), 1)])
def test_resampling(spark, monkeypatch, setting, pages):
    if pages:
        monkeypatch.setattr(R, "PAGE_BYTES", pages)
        monkeypatch.setattr(R, "BLOCK_WORDS", 40)
    texts = corpus(3) + ["É é É", "Tab\tand\nline w1 w2", None]
    rng = np.random.default_rng(0)
    target = [prose(rng, 30) for _ in range(6)] + [None, "", "never seen here"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(make(spark, texts).repartition(3), bench, setting)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(list(enumerate(texts)), target, setting)


def test_resampling_of_repeated_and_missing_ids(spark):
    rows = [(None, "a b " * 12), (None, "a b " * 12), (5, "c d " * 15), (5, "c d " * 15), (7, None)]
    got = R.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("c",)], "text string"), R.Setting(percent=50))
    out = [tuple(r) for r in got.collect()]
    assert len(out) == 5 and sorted(r[4] for r in out if r[4]) == [1, 2]
    assert [r[:4] for r in sorted(out, key=str)] == [r[:4] for r in resampled(rows, ["c"], R.Setting(percent=50))]


@pytest.mark.parametrize("texts", AWKWARD)
def test_awkward_tables(spark, texts):
    """Nulls, empty tables, repeated rows, long texts, and extra columns with the operators' own names."""
    docs = make(spark, texts)
    odd = docs.select("*", *(F.lit("x").alias(c) for c in ("key", "term", "pos", "ws", "h", "h1", "output", "block", "page", "t", "n", "word", "start", "win", "gain", "score")))
    bench = spark.createDataFrame([(1, "same text here again and again"), (2, None)], "item_id long, text string").withColumn("words", F.lit(1)).withColumn("item", F.lit(2))
    fim, leak = M.fill_middle(odd), C.decontaminate(odd, bench, C.Setting(size=4, slack=2))
    assert sorted(map(tuple, fim.collect())) == sorted(filled(i, t, M.Setting()) for i, t in enumerate(texts))
    assert sorted(tuple(r)[:6] for r in leak.collect()) == leaks(texts, [(1, "same text here again and again")], 4)
    assert R.resample(odd, bench).count() == len(texts)
    empty = bench.limit(0)
    assert C.decontaminate(odd, empty).where("contaminated or n_items > 0").isEmpty() and R.resample(odd, empty).count() == len(texts)


def test_queries_run_over_whole_tables(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op11_fill_middle", "op12_decontamination", "op13_importance_resampling"):
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() == n and name in Q.ORACLES
