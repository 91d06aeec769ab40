"""Cases that once went wrong: one id under several labels or vectors, columns of any name, missing ids."""

from pyspark.sql import functions as F

from factloom.llm import mixing as M
from factloom.llm import packing as P
from factloom.llm.hnsw_dedup import hnsw_dedup

VECTORS = "vec_id long, label string, embedding array<double>"


def test_one_id_under_two_labels(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "a", [1.0, 0.01]), (3, "b", [1.0, 0.02]), (4, "b", [0.0, 1.0])]
    got = sorted(tuple(r) for r in hnsw_dedup(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_one_id_with_two_vectors(spark):
    rows = [(5, "a", [1.0, 0.0]), (5, "a", [0.0, 1.0]), (2, "a", [1.0, 0.01]), (3, "a", [0.01, 1.0]), (5, "a", [1.0, 0.0])]
    got = sorted(tuple(r) for r in hnsw_dedup(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(2, 1, 2, True), (3, 1, 2, False), (5, 1, 2, False), (5, 1, 2, False), (5, 1, 2, False)]


def test_mixing_with_names_of_its_own(spark):
    rows = [(i, f"word {i} and more", "en", f"s{i % 3}", 1, "x", None, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _whole int, _lang string, _times int, _epoch int")
    plain = M.mix(docs.select("doc_id", "text", "lang", "source"), M.Setting(max_epochs=2, share=0.8)).select("doc_id", "_epoch")
    out = M.mix(docs, M.Setting(max_epochs=2, share=0.8))
    assert out.columns == ["doc_id", "text", "lang", "source", "_whole", "_lang", "_times", "_epoch"]
    assert sorted(map(tuple, out.select("doc_id", "_epoch").collect())) == sorted(map(tuple, plain.collect()))
    assert out.where("_whole <> 1 or _lang <> 'x' or _times is not null").isEmpty()


def test_packing_without_ids(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    out = P.pack(docs)
    assert out.count() == 5000 and out.select("bucket", "batch", "place").distinct().count() == 5000


def test_longest_intervals_of_lines(spark):
    """How far each place repeats an earlier one, in powers of two, and where first."""
    import numpy as np

    from factloom.llm import line_dedup as D

    rng = np.random.default_rng(2)
    block = [f"line {x}" for x in rng.integers(0, 1000, 13)]
    texts = ["\n".join([f"l{x}" for x in rng.integers(0, 6, int(rng.integers(0, 20)))] + (block if i % 3 == 0 else [])) for i in range(14)]
    places = [(i, j) for i, t in enumerate(texts) for j in range(len(t.split("\n")))]
    lines = {(i, j): t.split("\n")[j:] for i, t in enumerate(texts) for j in range(len(t.split("\n")))}
    want, n = set(), 1
    while n <= 32:
        first = {}
        for p in places:
            if len(lines[p]) >= n:
                first.setdefault(tuple(lines[p][:n]), p)
        want |= {(*p, n, first[tuple(lines[p][:n])]) for p in places if len(lines[p]) >= n and first[tuple(lines[p][:n])] < p}
        n *= 2
    best = {}
    for i, j, n, f in want:
        best[i, j] = max(best.get((i, j), (0, (0, 0))), (n, f))
    got = D.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.doc_id, r.line): (r.n_lines, tuple(r["first"])) for r in got.collect()} == best and max(n for n, _ in best.values()) >= 8


def test_elements_in_common():
    import numpy as np

    from factloom.llm import ngram_join as N

    rng = np.random.default_rng(0)
    left, right = ([np.unique(rng.integers(0, 60, int(rng.integers(1, 40)))).astype(np.uint64) for _ in range(n)] for n in (17, 9))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert N._in_common(left, right).tolist() == want == N._in_common(left, right, most=5).tolist()


def test_whole_license_texts(spark):
    """Whole texts between comment marks, with words changed, left out and put in; the end of one alone is none."""
    import numpy as np

    from factloom.llm import license_scan as C

    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i, (label, text) in enumerate(C.BODIES):
        words = text.split()
        changed = [w for w in words if rng.random() > 0.04]
        for j in rng.choice(len(changed), len(changed) // 25, replace=False):
            changed[j] = "other"
        lines = "\n".join("# " + " ".join(changed[j : j + 9]) for j in range(0, len(changed), 9))
        rows += [(2 * i, f"def f(): pass\n{lines}\nimport os"), (2 * i + 1, " ".join(words[-len(words) // 3 :]))]
        want[2 * i] = (label, len(changed))
    got = {r.doc_id: r for r in C.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, n) in want.items():
        assert label in got[i].labels.split(",") and max(s["last"] - s["first"] + 1 for s in got[i].spans if s["label"] == label) > 0.85 * n, label
        assert not [s for s in got[i + 1].spans or [] if s["last"] - s["first"] > 40]


def test_verification_in_rounds(spark):
    from factloom.llm import ngram_join as N
    from tests.llm.test_documents import corpus, make

    docs = make(spark, corpus(4))
    one, many = ({r.doc_id: r.component_id for r in N.ngram_jaccard_join(docs, s).collect()} for s in (N.Setting(), N.Setting(round_bytes=2000, rounds=3)))
    assert one == many and any(k != v for k, v in one.items())


def test_words_without_regular_expressions(spark, capsys):
    import re

    from factloom.llm import decontamination as D

    texts = ["".join(map(chr, range(0x80))), "Ab,C  d-É7\n\x00Zz\x7fÀb ", "", None, "É", " - ", "😀a B"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", D.split(F.col("text")).alias("ws"))
    lower = {c: c + 32 for c in range(65, 91)}
    assert {r.i: r.ws for r in rows.collect()} == {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for i, t in enumerate(texts)}
    rows.explain()
    assert "regexp" not in capsys.readouterr().out


def test_gains_are_listed_without_holding_many_blocks(spark, capsys, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from factloom.llm import resampling as R

    monkeypatch.setattr(R, "PAGE_BYTES", 40)
    stored = []
    store = R.Scratch.store
    monkeypatch.setattr(R.Scratch, "store", lambda self, df, *a: (out := store(self, df, *a), stored.append(out._scratch_path))[0])
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} same words here {i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    out = R.weights(docs, docs.select("text").limit(3), R.Setting(least_words=1))
    assert {r.doc_id: r.n_features for r in out.collect()} == dict.fromkeys(range(200), 6)
    assert max(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{stored[0].removeprefix('file:')}/*.parquet")) <= R.FILE_PAGES
    out.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_pairs_meet_in_groups(spark):
    """A class with many partners is dealt over groups, each with its set first, and no stored or joined set goes along with a pair."""
    from factloom.llm import ngram_join as N
    from tests.llm.test_documents import corpus, make

    docs = make(spark, corpus(5))
    one, many = ({r.doc_id: r.component_id for r in N.ngram_jaccard_join(docs, s).collect()} for s in (N.Setting(), N.Setting(group=1)))
    assert one == many and any(k != v for k, v in one.items())
    join = N._Join(docs, N.Setting())
    digests = join.scratch.store(join.docs.mapInArrow(N.digest(N.Setting()), "doc_id long, row long, n_shingles long, cls long, sketch binary"))
    join.classes = digests.where("n_shingles > 0").dropDuplicates(["cls"])
    owner, *members = [r.cls for r in join.classes.select("cls").limit(9).collect()]
    rows = join.met(spark.createDataFrame([(owner, i % 3, m) for i, m in enumerate(members)], "owner long, chunk int, member long")).select("owner", "chunk", "role", "cls").collect()
    groups = {c: [(r.role, r.cls) for r in rows if r.chunk == c] for c in range(3)}
    assert all(x[0] == (0, owner) and all(r == 1 for r, _ in x[1:]) for x in groups.values()) and sorted(c for x in groups.values() for r, c in x if r) == sorted(members)


def test_index_is_sorted_part_by_part(spark, monkeypatch):
    """A task that gets many parts of the index sorts one at a time, and gives a pair that meets in all of them once."""
    import numpy as np

    from factloom.llm import ngram_join as N
    from tests.llm.test_documents import corpus, make

    parts, sets = 10, 40
    packed = []
    for segment in range(200):
        keys = np.arange(1, sets // 2 + 1, dtype=np.uint64) + np.uint64(segment * 1000)
        packed += N._pack(np.repeat(N.X.mix(keys), 2), np.arange(sets, dtype=np.int64) << 1 | 1, parts)
    packed.sort(key=lambda row: row[0])
    longest, sort = [], np.lexsort
    monkeypatch.setattr(N.np, "lexsort", lambda columns: (longest.append(len(columns[0])), sort(columns))[1])
    both = [[b for b in run(iter([N._packed_batch(packed[:500]), N._packed_batch(packed[500:])]))] for run in (N.bucket_pairs(8), N._neighbours(8))]
    monkeypatch.setattr(N.np, "lexsort", sort)
    assert max(longest) < 2 * 200 * sets / parts
    assert sorted(p for x in both[0] for p in zip(*(x.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True)) == [(0, 4 * i, 4 * i + 2) for i in range(sets // 2)]

    few = np.zeros((3, 2), np.int64)
    asked = np.array([(2 * i, 2 * i + 2 * j) for i in range(1, 30) for j in range(1, 5)], np.int64)
    assert {tuple(p) for x in (asked, asked[::-1]) for p in N._unseen(x, few).tolist()} == {tuple(p) for p in asked.tolist()}
    docs = make(spark, corpus(4))
    one = {r.doc_id: r.component_id for r in N.ngram_jaccard_join(docs, N.Setting()).collect()}
    monkeypatch.setattr(N, "PART_ENTRIES", 20)
    assert one == {r.doc_id: r.component_id for r in N.ngram_jaccard_join(docs, N.Setting(small=2, star_rounds=0)).collect()} and any(k != v for k, v in one.items())
