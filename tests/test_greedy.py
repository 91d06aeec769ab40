"""Greedy operators against the sequential rules they carry out."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import greedy as G
from factloom.streaming import labels as L


def drawn(rows, per):
    """(id, turn): groups in turn by name, twins of taken rows skipped. rows: group, id, a, b."""
    queues = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        queues[r[0]].append(r)
    seen, count, out = set(), Counter(), []
    while any(queues[g] and count[g] < per for g in queues):
        for g in sorted(queues):
            while queues[g] and count[g] < per:
                _, i, a, b = queues[g].pop(0)
                keys = {("a", a), ("b", b)} - {("a", None), ("b", None)}
                if keys & seen:
                    continue
                seen |= keys
                out.append((i, count[g]))
                count[g] += 1
                break
    return sorted(out)


@pytest.mark.parametrize("seed,n,kinds,per", [(0, 60, 8, 10**6), (1, 200, 40, 12), (2, 300, 1000, 10**6), (3, 150, 3, 5), (4, 0, 1, 3), (5, 250, 60, 1)])
def test_draw_in_turn(spark, seed, n, kinds, per):
    rng = np.random.default_rng(seed)
    groups = ["g" + str(min(int(x), 4)) for x in rng.geometric(0.4, n)]  # one group holds two fifths
    rows = [(groups[i], i, f"a{rng.integers(kinds)}" if rng.random() < 0.9 else None, f"b{rng.integers(kinds)}" if rng.random() < 0.5 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, a string, b string")
    got = G.draw_in_turn(df, "g", ["id"], [F.col("a"), F.col("b")], None if per == 10**6 else per)
    assert sorted((r.id, r.turn) for r in got.collect()) == drawn(rows, per)


def test_draw_of_copies(spark):
    """All rows alike: the first of the first group only."""
    df = spark.range(500).select((F.col("id") % 7).cast("string").alias("g"), "id", F.lit("same").alias("a"))
    assert [(r.g, r.id, r.turn) for r in G.draw_in_turn(df, "g", ["id"], [F.col("a")]).collect()] == [("0", 0, 0)]


def filled(rows, caps):
    left, out = dict(caps), []
    for g, i, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if size is not None and size >= 0 and g in left and size <= left[g]:
            left[g] -= size
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("seed,n,most,cap", [(0, 300, 20, 100), (1, 500, 1000, 1500), (2, 400, 3, 10_000), (3, 200, 50, 0), (4, 0, 5, 5)])
def test_fill(spark, seed, n, most, cap):
    rng = np.random.default_rng(seed)
    rows = [(f"g{rng.integers(4)}" if rng.random() < 0.9 else None, i, int(rng.integers(-1, most)) if rng.random() < 0.95 else None) for i in range(n)]
    caps = [("g0", cap), ("g1", cap // 2), ("g2", cap + 7), (None, 9)]
    df = spark.createDataFrame(rows, "g string, id long, size long")
    got = G.fill(df, "g", ["id"], "size", spark.createDataFrame(caps, "g string, cap long"))
    assert sorted(r.id for r in got.collect()) == filled(rows, caps) and got.columns == ["g", "id", "size"]


def test_fill_of_many_rows_in_one_group(spark):
    rng = np.random.default_rng(7)
    rows = [("g", i, int(s)) for i, s in enumerate(rng.pareto(1.1, 100_000) * 10)]
    df = spark.createDataFrame(rows, "g string, id long, size long").repartition(8)
    got = G.fill(df, "g", ["id"], "size", spark.createDataFrame([("g", 900_000)], "g string, cap long"))
    assert sorted(r.id for r in got.select("id").collect()) == filled(rows, [("g", 900_000)])


def checked(replies, classes, predicates, least):
    names, pairs, out = set(predicates), set(), []
    for line, predicate, name, ps, texts, whole in replies:
        name = (name or "").strip(" ")
        ps = [tuple(p) for p in ps or []]
        for why, bad in (
            ("no name", not name), ("name not in capitals", name != name.upper() or not name.replace("_", "").isalnum()), ("unknown predicate", predicate not in predicates), ("same name", name == predicate),
            ("name taken", name in names), ("no pairs", not ps), ("pair repeated", len(set(ps)) < len(ps)), ("unknown class", any(c not in classes for p in ps for c in p)),
            ("pair taken", any((predicate, p) in pairs for p in ps)), ("too few texts", (texts or 0) < least), ("nothing left of the predicate", bool(whole)),
        ):
            if bad:
                break
        else:
            why = None
            names.add(name)
            pairs |= {(predicate, p) for p in ps}
        out.append((line, why))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_check_splits(spark, seed):
    rng = np.random.default_rng(seed)
    classes, predicates = [f"c{i}" for i in range(9)], ["HAS", "USES"]
    replies = []
    for line in range(150):
        ps = [(f"c{rng.integers(10)}" if rng.random() < 0.1 else f"c{rng.integers(9)}", f"c{rng.integers(9)}") for _ in range(rng.integers(0, 4))]
        name = str(rng.choice(["", " ", "low", "HAS", "___", "A-B"])) if rng.random() < 0.15 else f" N_{rng.integers(60)} "
        replies.append((line, str(rng.choice(["HAS", "USES", "NONE"], p=[0.5, 0.45, 0.05])), name, ps if rng.random() < 0.95 else None, int(rng.integers(0, 20)), bool(rng.random() < 0.05)))
    df = spark.createDataFrame(replies, "line long, predicate string, name string, pairs array<struct<s:string,o:string>>, texts int, all_pairs boolean")
    got = G.check_splits(df, spark.createDataFrame([(c,) for c in classes], "class string"), spark.createDataFrame([(p,) for p in predicates], "predicate string"), 2)
    want = checked(replies, set(classes), set(predicates), 2)
    assert sorted((r.line, r.reason) for r in got.collect()) == want
    assert {"pair taken", "name taken", None} <= {w for _, w in want}


def test_chain_of_claims(spark):
    """Each shares a key with the next: every second one is served."""
    claims = spark.createDataFrame([(i, k) for i in range(12) for k in (i, i + 1)], "turn long, key long")
    assert sorted(r.turn for r in G.first_come(claims).collect()) == [0, 2, 4, 6, 8, 10]
    assert G.first_come(claims.limit(0)).isEmpty()


def merged(parts, pins, top):
    """Rounds: keys of all parts, components of those that share one, pins united."""
    into = {p: p for p in parts}
    held = defaultdict(Counter)
    for predicate, part, pin, weight in pins:
        held[predicate, part][pin] += weight
    while True:
        owners = defaultdict(list)
        for (predicate, part), c in held.items():
            for pin, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]:
                owners[predicate, pin].append(part)
        low = {p: p for p in held}
        changed = True
        while changed:
            changed = False
            for (predicate, _), ps in owners.items():
                least = min(low[predicate, p] for p in ps)
                for p in ps:
                    if low[predicate, p] != least:
                        low[predicate, p], changed = least, True
        if all(low[p] == p for p in low):
            return into, held
        into = {p: low.get(q, q) for p, q in into.items()}
        new = defaultdict(Counter)
        for p, c in held.items():
            new[low[p]].update(c)
        held = new


@pytest.mark.parametrize("seed,pins_each,kinds", [(0, 6, 60), (1, 3, 20), (2, 8, 400), (3, 2, 5)])
def test_merge_again(spark, seed, pins_each, kinds):
    rng = np.random.default_rng(seed)
    parts = [(f"p{i % 3}", f"x{i:03d}") for i in range(60)]
    pins = [(p, x, f"k{rng.integers(kinds):03d}", int(rng.integers(1, 4))) for p, x in parts[:-2] for _ in range(pins_each)]
    into, held = G.merge_again(spark.createDataFrame(parts, "predicate string, part string"), spark.createDataFrame(pins, "predicate string, part string, pin string, weight long"))
    want, united = merged(parts, pins, 2)
    assert {(r.predicate, r.part): (r.predicate, r.into) for r in into.collect()} == want
    assert {(r.predicate, r.part, r.pin): r.weight for r in held.collect()} == {(*p, k): w for p, c in united.items() for k, w in c.items()}


def test_merging_changes_keys(spark):
    """a and b unite by k1; only their united pins make k9 strong enough to take c in. A cycle of keys is one part."""
    pins = [("p", "a", "k1", 5), ("p", "a", "k2", 4), ("p", "a", "k9", 3), ("p", "b", "k1", 5), ("p", "b", "k3", 4), ("p", "b", "k9", 3), ("p", "c", "k9", 1)]
    pins += [("q", x, k, 1) for x, ks in (("a", "12"), ("b", "23"), ("c", "31")) for k in ks]
    df = spark.createDataFrame(pins, "predicate string, part string, pin string, weight long")
    into, _ = G.merge_again(df.select("predicate", "part"), df)
    assert sorted(tuple(r) for r in into.collect()) == [(p, x, "a") for p in "pq" for x in "abc"]


def test_ask_in_halves(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def ask(prompts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(prompts))
        if any(p.startswith("bad") for p in prompts):
            raise PermissionError("refused")
        return [p[::-1] for p in prompts]

    items = [(i, str(i // 16), f"bad {i}" if i in (3, 40) else f"good {i}") for i in range(50)]
    df = spark.createDataFrame(items, "id long, batch string, prompt string")
    got = {r.id: r for r in G.ask_in_halves(df, ask, lambda e: isinstance(e, PermissionError)).collect()}
    assert {i for i, r in got.items() if r.refused} == {3, 40} and all(got[i].reply == p[::-1] for i, _, p in items if i not in (3, 40))
    assert max(r.rounds for r in got.values()) == 1 + math.log2(16) and got[20].rounds == 1
    calls = [c.read_text() for c in log.iterdir()]
    assert len(calls) == len(set(calls)) == 4 + 2 * 2 * 4  # two of four batches halve four times
    with pytest.raises(Exception, match="2 replies"):
        G.ask_in_halves(df, lambda p: p[:2], lambda e: isinstance(e, PermissionError)).collect()


def labelled(names, batch):
    """Sequential rule: requests of `batch` names of a group, each with the labels before."""
    out = {}
    for g in sorted({g for g, _, _ in names}):
        mine = list(dict.fromkeys(n for h, _, n in sorted(names, key=lambda x: x[1]) if h == g))
        used = []
        for at in range(0, len(mine), batch):
            got = {n: next((u for u in used if u[-1] == n[-1]), n) for n in mine[at : at + batch]}
            used += [x for x in dict.fromkeys(got.values()) if x not in used]
            out |= {(g, n): x for n, x in got.items()}
    return out


def test_labels_with_a_running_vocabulary(spark, tmp_path):
    """Files land one by one, the stream stops and starts again from its checkpoint: the labels are those of one pass."""

    def ask(names, used):
        return {n: next((u for u in used if u[-1] == n[-1]), n) for n in names}

    rng = np.random.default_rng(0)
    names = [(f"g{rng.integers(2)}", i, f"n{rng.integers(60)}") for i in range(90)]
    path = str(tmp_path / "names")
    for at in (0, 30, 60):
        for lo in (at, at + 15):
            spark.createDataFrame(names[lo : lo + 15], "group string, turn long, name string").coalesce(1).write.mode("append").parquet(path)
        L.start(L.name_files(spark, path), ask, str(tmp_path / "out"), str(tmp_path / "state"), batch=4).awaitTermination()
    got = defaultdict(set)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[r.group, r.name].add(r.label)
    assert {k: list(v) for k, v in got.items()} == {k: [v] for k, v in labelled(names, 4).items()}
