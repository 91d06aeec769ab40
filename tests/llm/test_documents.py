"""Operators on documents against brute force, and on awkward tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id as L
from factloom.llm import license_scan as C
from factloom.llm import line_dedup as D
from factloom.llm import mixing as M
from factloom.llm import ngram_join as N
from factloom.llm import packing as P
from factloom.llm import suffix_dedup as S
from factloom.llm import token_counts as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def make(spark, texts, lang=None, source=None):
    rows = [(i, t, (lang or {}).get(i, "en"), (source or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def corpus(seed=0):
    """Unique texts, exact and near copies, shared passages and lines, empty and long ones."""
    rng = np.random.default_rng(seed)
    out = [prose(rng, int(rng.integers(1, 120))) for _ in range(30)]
    base = prose(rng, 200)
    passage = prose(rng, 90)
    for k in range(12):
        w = base.split()
        for j in rng.choice(200, k, replace=False):
            w[j] = f"x{k}_{j}"
        out.append(" ".join(w))
    out += [out[3], out[3].upper(), base + "\n" + passage, passage + "\n" + prose(rng, 30), prose(rng, 20) + " " + passage]
    out += ["", None, " \n ", "one", "one two", "ONE  two", "a" * 3000, "é" * 900, prose(rng, 3000)]
    line = " ".join(rng.choice(WORDS, 12))
    out += [f"{prose(rng, 15)}\n{line}\nshort\ntiny\n{prose(rng, 9)}" for _ in range(6)]
    return out


AWKWARD = [
    [],
    [None],
    [None, None, "", ""],
    ["same text here again and again"] * 9,
    ["  ", "\t", "\n\n", "…", "12", "😀"],
    ["x " * 30000, "y" * 50000, None],
]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- n-gram Jaccard join


def brute_components(texts, k=5, num=80, den=100):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    low = list(range(len(texts)))
    while True:
        new = low[:]
        for i, j in itertools.combinations(range(len(sets)), 2):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                new[i] = new[j] = min(new[i], new[j])
        if new == low:
            return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, low, strict=True))]
        low = new


@pytest.mark.parametrize("setting", [N.Setting(), N.Setting(small=2, star_rounds=0), N.Setting(small=2, star_rounds=0, broadcast_rows=-1, broadcast_bytes=-1), N.Setting(num=60), N.Setting(k=1, num=50, small=2, star_rounds=1, star_keys=1)])
def test_ngram_join(spark, setting):
    texts = corpus()
    got = rows(N.ngram_jaccard_join(make(spark, texts), setting), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(texts, setting.k, setting.num, setting.den)


def test_ngram_join_hot_passage(spark):
    """Many texts that are mostly one passage: every segment is crowded, links are few."""
    rng = np.random.default_rng(5)
    passage = prose(rng, 40)
    texts = [f"{passage} {prose(rng, int(rng.integers(4, 14)))}" for _ in range(60)]
    got = rows(N.ngram_jaccard_join(make(spark, texts), N.Setting(small=3, star_rounds=1, star_keys=1)), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(texts)


@pytest.mark.parametrize("texts", AWKWARD)
def test_ngram_join_awkward(spark, texts):
    got = rows(N.ngram_jaccard_join(make(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(texts)


def test_ngram_join_repeated_rows_and_columns(spark):
    df = make(spark, ["a b c d e f", "a b c d e f", "q"]).withColumn("cls", F.lit(1)).withColumn("component", F.lit("x"))
    assert rows(N.ngram_jaccard_join(df.union(df)), "doc_id", "component_id") == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert rows(N.keep_one(df), "doc_id", "cls") == [(0, 1), (2, 1)]


def test_segments_agree():
    """Similar sets agree on more segments than can differ, for sizes around every band's ends."""
    rng = np.random.default_rng(1)
    low, counts = N.bands(80, 100)
    for n in sorted({x + d for x in low[:9] for d in (-1, 0, 1) if x + d >= low[0]}):
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(len(a) * 0.2)
            b = np.unique(np.concatenate([a[: len(a) - drop // 2], rng.integers(0, 1 << 63, drop // 3, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common):
                continue
            shared = {k for k, _ in N.schemes(len(a), N.Setting())} & {k for k, _ in N.schemes(len(b), N.Setting())}
            band = max(shared)
            x, y = (N.segments(s, counts[band])[0] for s in (a, b))
            assert (x != y).sum() <= N.apart(min(len(a), len(b)), 80, 100)
            assert N.sketch_gap(N.sketch(a), N.sketch(b)) <= len(a) + len(b) - 2 * common


# --- licences


def brute_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for label, p in C.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_license_scan(spark):
    texts = corpus() + [
        "Released Under the MIT license. And again: under the mit License", "Licensed under the Apache License, Version 2.0.", "cc-by-nc 4.0", "cc by", "under the mit", "license apache license version 2",
        "Permission is hereby granted, free of charge, to ANY person obtaining one copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "This work is licensed under the GNU General Public License, version 3.", "under the mit license" + " z" * 4000 + " cc by nc",
    ]
    out = C.license_scan(make(spark, texts))
    got = rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == [(i, *brute_places(t)) for i, t in enumerate(texts)]
    labels = {r.doc_id: (r.labels, r.score) for r in out.collect()}
    n = len(corpus())
    assert labels[n + 6][0] == "mit" and 0.8 <= labels[n + 6][1] < 1 and labels[n + 7] == ("gpl-3", 1.0) and labels[0] == ("", 0.0)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in out.collect())


@pytest.mark.parametrize("texts", AWKWARD)
def test_license_scan_awkward(spark, texts):
    df = make(spark, texts).withColumn("key", F.lit(1)).withColumn("t", F.lit(2))
    assert C.license_scan(df).count() == len(texts)
    assert rows(C.license_scan(df.union(df)), "doc_id", "n_base") == rows(C.license_scan(df).union(C.license_scan(df)), "doc_id", "n_base")


# --- repeated byte strings


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in enumerate(raw):
        keep = np.ones(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                keep[i : i + length] = False
        gone = np.concatenate([[False], ~keep])
        out.append((d, len(b), int((~keep).sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("setting", [S.Setting(), S.Setting(length=80, gram=16), S.Setting(length=60, gram=8, pairs=2, batch=16), S.Setting(length=80, gram=16, hot=2), S.Setting(broadcast_bytes=-1)])
def test_suffix_dedup(spark, setting):
    texts = corpus(3)
    got = rows(S.remove_repeats(make(spark, texts), setting, whole=False), *COLUMNS)
    assert got == brute_repeats(texts, setting.length)


def test_suffix_dedup_crowds(spark):
    """One passage in many texts with different surroundings, through pairs, windows and the hot path."""
    rng = np.random.default_rng(2)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, int(rng.integers(0, 40)))} {passage[: int(rng.integers(150, len(passage)))]} {prose(rng, int(rng.integers(0, 40)))}" for _ in range(80)]
    want = brute_repeats(texts, 120)
    for setting in (S.Setting(length=120, gram=16), S.Setting(length=120, gram=16, pairs=3, batch=40), S.Setting(length=120, gram=16, hot=10), S.Setting(length=120, gram=16, hot=10, part=50, broadcast_bytes=0)):
        assert rows(S.remove_repeats(make(spark, texts), setting, whole=False), *COLUMNS) == want


def test_suffix_dedup_levels_are_suffix_arrays():
    """Entries of a level stand in the order of their bytes from the anchor on, after merges too."""
    rng = np.random.default_rng(4)
    family = S.Family(S.Setting(length=40, gram=8, batch=16))
    width = family.half + 40
    for _ in range(9):
        n = int(rng.integers(5, 30))
        head = np.stack([rng.integers(0, 9, n), rng.integers(0, 99, n), np.full(n, family.half), np.full(n, 40), np.zeros(n)], 1).astype(np.int64)
        family.push(head, rng.integers(97, 99, (n, width)).astype(np.uint8))
    family.flush()
    sizes = [len(level[0]) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    for level in family.levels:
        ahead = [bytes(row[family.half :]) for row in level[1]]
        assert ahead == sorted(ahead)


@pytest.mark.parametrize("texts", AWKWARD)
def test_suffix_dedup_awkward(spark, texts):
    df = make(spark, texts).withColumn("key", F.lit("x")).withColumn("lo", F.lit(1))
    got = rows(S.remove_repeats(df, whole=False), *COLUMNS)
    assert got == brute_repeats(texts, 400)


def test_suffix_dedup_equal_ids(spark):
    long = "z" + " ".join(WORDS)
    df = spark.createDataFrame([(1, long), (1, long), (1, "other"), (None, "more")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in S.remove_repeats(df).collect())
    assert got == [(4, 0), (5, 0), (len(long), len(long)), (len(long), len(long))]


def test_keep_one_of_repeated_ids(spark):
    """Rows of one id are one document: linked by any of its texts, one row stays; rows without an id stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (3, b), (4, c), (4, c), (None, c), (None, c), (5, None), (5, None)]
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 4, 5]
    also = spark.createDataFrame([(1, a), (7, a), (0, a), (9, b)], "doc_id long, text string")  # 0 and 9 are not among the documents
    assert sorted(r.doc_id for r in N.keep_one(spark.createDataFrame([(1, a), (7, "cut")], "doc_id long, text string"), also=also).collect()) == [1]


# --- packing


def test_best_bounds():
    rng = np.random.default_rng(0)
    for _ in range(80):
        h = {int(x): int(rng.integers(1, 9)) for x in rng.integers(0, 40, rng.integers(1, 11))}
        k = int(rng.integers(1, 6))
        cost = lambda bs: sum(c * (min(b for b in bs if b >= x) - x) for x, c in h.items())  # noqa: B023, E731
        keys = sorted(h)
        best = min(cost([*c, keys[-1]]) for r in range(k) for c in itertools.combinations(keys[:-1], min(r, len(keys) - 1)))
        got = P.best_bounds(h, k)
        assert cost(got) == best and len(got) <= k and got == sorted(set(got))


def test_pack(spark):
    texts = corpus()
    s = P.Setting(buckets=4, budget=300, longest=256)
    got = P.pack(make(spark, texts), s).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert Counter({d: sum(r.n_tokens for r in got if r.doc_id == d) for d in words}) == Counter(words)
    for key, batch in itertools.groupby(sorted(got, key=lambda r: (r.bucket, r.batch, r.place)), key=lambda r: (r.bucket, r.batch)):
        batch = list(batch)
        assert [r.place for r in batch] == list(range(len(batch)))
        assert len({r.bucket_tokens for r in batch}) == 1 and all(0 <= r.padding == r.bucket_tokens - r.n_tokens for r in batch)
        assert len(batch) == 1 or len(batch) * batch[0].bucket_tokens <= s.budget
    for b in {r.bucket for r in got}:
        sizes = Counter(r.batch for r in got if r.bucket == b)
        assert sorted(sizes) == list(range(len(sizes))) and all(n == max(sizes.values()) for k, n in sizes.items() if k < len(sizes) - 1)


@pytest.mark.parametrize("texts", AWKWARD)
def test_pack_awkward(spark, texts):
    df = make(spark, texts).withColumn("bucket", F.lit(9)).withColumn("size", F.lit(9))
    out = P.pack(df.union(df), P.Setting(longest=10_000))
    assert {r.doc_id for r in out.collect()} == set(range(len(texts))) and (not texts or out.count() >= 2 * len(texts))


# --- mixing


def brute_budgets(leaves, s):
    """Water filling from the top, one round of saturation at a time."""
    caps = {k: v * s.max_epochs if all(s.weights.get(lv, {}).get(n, 1.0) > 0 for lv, n in zip(M.LEVELS, k, strict=True)) else 0 for k, v in leaves.items()}

    def fill(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        kids = sorted({k[: depth + 1] for k in leaves if k[:depth] == prefix})
        cap = {k: sum(c for x, c in caps.items() if x[: depth + 1] == k) for k in kids}
        w = {k: s.weights.get(M.LEVELS[depth], {}).get(k[-1], 1.0) for k in kids}
        got, open_, left = dict.fromkeys(kids, 0.0), {k for k in kids if w[k] > 0}, budget
        while open_:
            total = sum(w[k] for k in open_)
            full = {k for k in open_ if cap[k] <= left * w[k] / total + 1e-9}
            if not full:
                got |= {k: left * w[k] / total for k in open_}
                break
            for k in full:
                got[k] = cap[k]
            left -= sum(cap[k] for k in full)
            open_ -= full
        return {x: b for k in kids for x, b in fill(k, got[k]).items()}

    total = s.tokens if s.tokens is not None else int(sum(leaves.values()) * s.share)
    return {k: int(b + 1e-6) for k, b in fill((), float(total)).items()}


SETTINGS = [
    M.Setting(), M.Setting(weights={"domain": {"domain0": 5.0}, "lang": {"fr": 0.0, "en": 3.0}, "source": {"s1": 10.0}}, share=0.7, max_epochs=2), M.Setting(share=3.0, max_epochs=3), M.Setting(tokens=50),
    M.Setting(weights={"lang": {"en": 0.0, "fr": 0.0, "de": 0.0}}), M.Setting(share=1.0, max_epochs=1),
]


@pytest.mark.parametrize("s", SETTINGS)
def test_mixing(spark, s):
    texts = corpus(7)
    lang = {i: ("en", "fr", "de")[i % 5 % 3] for i in range(len(texts))}
    source = {i: f"s{i % 4}" for i in range(len(texts))}
    df = make(spark, texts, lang, source)
    dom = {x: f"domain{zlib.crc32(x.encode()) % 3}" for x in source.values()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    leaves, members = Counter(), {}
    for i in range(len(texts)):
        k = (dom[source[i]], lang[i], source[i])
        leaves[k] += words[i]
        members.setdefault(k, []).append(i)
    want = []
    for k, b in brute_budgets(leaves, s).items():
        whole = min(b // leaves[k], s.max_epochs) if leaves[k] else 0
        want += [(i, e) for i in members[k] for e in range(whole)]
        if whole < s.max_epochs:
            left = b - whole * leaves[k]
            for h, _, i in sorted((hashlib.md5(f"{s.seed}|{whole}|{i}".encode()).hexdigest(), str(i), i) for i in members[k]):
                left -= words[i]
                if left < 0:
                    break
                want.append((i, whole))
    assert rows(M.mix(df, s), "doc_id", "_epoch") == sorted(want)


@pytest.mark.parametrize("texts", AWKWARD)
def test_mixing_awkward(spark, texts):
    df = make(spark, texts).withColumn("lang", F.lit(None).cast("string")).withColumn("budget", F.lit(1)).withColumn("supply", F.lit(1)).withColumn("domain", F.lit(3))
    out = M.mix(df, M.Setting(share=1.0, max_epochs=1))
    assert out.columns == [*df.columns, "_epoch"] and {r.doc_id for r in out.collect()} <= set(range(len(texts)))
    if texts and any(texts):
        assert sum(len((t or "").split()) for t in texts) == M.mix(df, M.Setting(share=1.0, max_epochs=1)).select(F.sum(P.n_words("text"))).first()[0]


# --- token counts


def brute_tokens(word, scores, unknown):
    word = T.MARK + word
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(-(best[i - 1][0] + n * unknown), best[i - 1][1] + n)] + [(-(best[j][0] + scores[word[j:i]]), best[j][1] + 1) for j in range(i) if word[j:i] in scores]
        s, c = min(options)
        best[i] = (-s, c)
    return best[-1][1]


def test_token_counts(spark):
    scores = T.rank_scores()
    texts = corpus() + ["café naïve 中文 mixed-case Words; un" + "x" * 200]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in T.token_counts(make(spark, texts), scores).collect()}
    known = {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        for w in set(words):
            known.setdefault(w, brute_tokens(w, scores, -20.0) if len(w) < 400 else None)
        if all(known[w] is not None for w in words):
            assert got[i] == (len(words), sum(known[w] for w in words))
    small = {r.doc_id: r.n_tokens for r in T.token_counts(make(spark, texts), scores, most_nodes=50).collect()}
    assert small == {k: v[1] for k, v in got.items()}


@pytest.mark.parametrize("texts", AWKWARD)
def test_token_counts_awkward(spark, texts):
    df = make(spark, texts).withColumn("n_tokens", F.lit(1))
    assert T.token_counts(df).count() == len(texts)


# --- lines


def brute_lines(texts, min_lines, line_chars):
    seen, marks = set(), set()
    for d, t in enumerate(texts):
        if t is None:
            continue
        ls = t.split("\n")
        for i in range(len(ls)):
            for n in {1, min_lines}:
                run = tuple(ls[i : i + n])
                if len(run) < n or n == 1 and (min_lines > 1 or line_chars > 0) and len(ls[i]) < line_chars:
                    continue
                if (n, run) in seen:
                    marks |= {(d, i + j) for j in range(n)}
                seen.add((n, run))
    out = []
    for d, t in enumerate(texts):
        ls = t.split("\n") if t is not None else []
        gone = {i for x, i in marks if x == d}
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


@pytest.mark.parametrize(("min_lines", "line_chars"), [(2, 40), (3, 1000), (5, 20), (1, 1)])
def test_line_dedup(spark, min_lines, line_chars):
    texts = corpus() + ["a\nb\nc\nd\ne\nf", "x\na\nb\nc\nd\ne\ny", "a\nb\na\nb\na\nb", "c\nd\ne\nf\ng", "q\n\n\n\nq"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_runs) for r in D.line_dedup(make(spark, texts), min_lines, line_chars).collect()))
    assert got == brute_lines(texts, min_lines, line_chars)


@pytest.mark.parametrize("texts", AWKWARD)
def test_line_dedup_awkward(spark, texts):
    df = make(spark, texts).withColumn("key", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("line", F.lit(2))
    got = sorted((r.doc_id, r.text or "") for r in D.line_dedup(df).collect())
    assert got == sorted((d, t or "") for d, t, *_ in brute_lines(texts, 2, 40))
    assert D.line_dedup(df.union(df)).count() == 2 * len(texts)


def test_line_dedup_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    texts = corpus()
    assert sorted((r.doc_id, r.text or "") for r in D.line_dedup(make(spark, texts)).collect()) == [(d, t or "") for d, t, *_ in brute_lines(texts, 2, 40)]


# --- language


def speech(rng, lang, n):
    parts = {"en": ["the", "ing", "th", "er", "and", "of"], "fr": ["le", "é", "eau", "ou", "que", "ç"], "el": ["και", "το", "ως", "ία"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = np.random.default_rng(0)
    langs = ["en", "fr", "el"] * 40
    texts = [speech(rng, x, 40) for x in langs] + [speech(rng, "en", 60) + " " + speech(rng, "fr", 50), None, "", "123 … 45", " …", "Ω"]
    df = make(spark, texts, dict(enumerate(langs + [None] * 6)))
    model = L.Model.fit(df.where(~L.held_out()).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in L.language_id(df, model).collect()}
    assert all(got[i].lang_pred == x for i, x in enumerate(langs))
    spans = got[120].spans
    assert [s.lang for s in spans] == ["en", "fr"] and abs(spans[0].last - 59) <= 2 and got[120].lang_pred == "en" and 0.4 < got[120].score < 0.6
    assert [got[i].lang_pred for i in range(121, 125)] == ["und"] * 4 and got[121].score == 0 and got[125].lang_pred == "el"
    assert {r.doc_id for r in df.where(L.held_out()).collect()} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r.doc_id for r in L.accepted(df.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("und"))).collect()} == set(range(len(texts))) - {121, 122, 123, 124}


def brute_language(texts, labelled, langs, s):
    """Predictions word by word: trigram frequencies, candidates by script, the best of all paths by a full Viterbi."""

    def words(t):
        low = (t or "").translate({c: c + 32 for c in [*range(0x41, 0x5B), *(set(range(0xC0, 0xDF)) - {0xD7})]})
        return re.findall(rb"[a-zA-Z\x80-\xff]+", low.encode())

    def cells(w):
        z = b" " + w + b" "
        return [((z[i] << 16 | z[i + 1] << 8 | z[i + 2]) * 0x9E3779B97F4A7C15 % 2**64) >> 47 for i in range(len(w))]

    count, script = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, x in labelled:
        for w in words(t):
            count[x].update(cells(w))
            script[x][int(L.SCRIPT_OF[w[0]])] += 1
    log = {x: {} for x in langs}
    total = {x: sum(count[x].values()) + 0.5 * L.CELLS for x in langs}
    for c in set().union(*count.values()):
        raw = {x: np.log((count[x][c] + 0.5) / total[x]) for x in langs}
        for x in langs:
            log[x][c] = np.float32(raw[x] - max(raw.values()))
    none = {x: np.log(0.5 / total[x]) for x in langs}
    none = {x: np.float32(v - max(none.values())) for x, v in none.items()}
    out = []
    for t in texts:
        ws = words(t)
        if not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
            continue
        rows = []
        for w in ws:
            y = {x: sum(float(log[x].get(c, none[x])) for c in cells(w)) for x in langs}
            sc = int(L.SCRIPT_OF[w[0]])
            ok = [x for x in langs if script[x][sc] / max(1, sum(script[x].values())) >= s.script_share] or langs
            top = max(y[x] for x in ok)
            rows.append([max(s.floor, y[x] - top) if x in ok else s.floor for x in langs])
        path = L.viterbi(np.array(rows), s.penalty)
        votes, total_y = Counter(path.tolist()), np.array(rows).sum(0)
        j = max(votes, key=lambda c: (votes[c], total_y[c], -c))
        out.append((langs[j], votes[j] / len(ws)))
    return out


def test_language_id_against_brute_force(spark):
    rng = np.random.default_rng(11)
    langs = ["el", "en", "fr"]
    texts = [speech(rng, langs[i % 3], int(rng.integers(1, 30))) for i in range(90)]
    texts += [f"{speech(rng, 'en', int(rng.integers(1, 30)))} {speech(rng, 'fr', int(rng.integers(1, 30)))} {speech(rng, 'el', int(rng.integers(0, 9)))}" for _ in range(40)]
    texts += ["", None, "1 2", "É", "ÀÉÎ THE Ing", "Ж", "你好 the", "a1b2"]
    labels = {i: langs[i % 3] for i in range(90)}
    df = make(spark, texts, {i: labels.get(i) for i in range(len(texts))})
    learn = [(t, labels[i]) for i, t in enumerate(texts) if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    model = L.Model.fit(df.where(~L.held_out()).select("doc_id", "text", "lang"))
    got = [(r.lang_pred, r.score) for r in L.language_id(df, model, spans=False).orderBy("doc_id").collect()]
    want = brute_language(texts, learn, langs, L.Setting())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_viterbi_certificate():
    rng = np.random.default_rng(3)
    model = L.Model(["a", "b", "c"], None, None, L.Setting(penalty=5.0))
    for _ in range(200):
        n = int(rng.integers(1, 30))
        y = -rng.random((n, 3)) * 4
        y -= y.max(1, keepdims=True)
        first = np.array([0, n])
        got, want = model.label(y, first), L.viterbi(y, 5.0)
        value = lambda p: y[np.arange(n), p].sum() - 5.0 * (p[1:] != p[:-1]).sum()  # noqa: B023, E731
        assert value(got) == pytest.approx(value(want))
        if n <= 6:
            assert value(want) == pytest.approx(max(value(np.array(p)) for p in itertools.product(range(3), repeat=n)))


@pytest.mark.parametrize("texts", AWKWARD)
def test_language_id_awkward(spark, texts):
    df = make(spark, texts)
    model = L.Model.fit(df.select("doc_id", "text", "lang"))
    out = L.language_id(df, model)
    assert out.count() == len(texts) and all(0 <= r.score <= 1 for r in out.collect())
    assert L.language_id(df, None).where("lang_pred <> 'und'").count() == 0
    assert L.accepted(df.withColumn("lang", F.lit(None).cast("string"))).count() == sum(any(map(str.isalpha, t or "")) for t in texts)
