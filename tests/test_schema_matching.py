import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import matching as M
from factloom.operators import schema as S


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_saturation(spark):
    support = spark.createDataFrame([(n,) for n in (1, 2, 3, 3, 10, 40)], "support long")
    got = dict(rows(S.saturation(support, 40, (5, 20, 40), 2), "texts", "expected"))
    for k, v in got.items():
        assert v == pytest.approx(sum(S.hypergeometric_tail(40, n, k, 2) for n in (1, 2, 3, 3, 10, 40)), abs=1e-8)


def test_validate(spark):
    facts = spark.createDataFrame([("A", "R", "B"), ("A", "R", "Z"), ("B", "R", "A"), ("A", "Q", "B"), ("B", "Q", "A"), ("A", "X", "B")], "s string, p string, o string")
    t = spark.createDataFrame
    got = {r[:3]: r[3] for r in rows(S.validate(facts, t([("A",), ("B",)], "name string"), t([("R",), ("Q",)], "name string"), t([("A", "R", "B")], "s string, p string, o string"), t([("Q", "A", "any")], "p string, ps string, po string")), "s", "p", "o", "errors")}
    assert got["A", "R", "B"] == [] and got["A", "R", "Z"] == ["object class", "pattern"] and got["B", "R", "A"] == ["pattern"]
    assert got["A", "Q", "B"] == [] and got["B", "Q", "A"] == ["pin"] and got["A", "X", "B"] == ["predicate", "pattern"]


#: Whose rule: (predicate, class of s or any, class of o or any, target, line, swap).
RULES = [("EATS", None, None, "(none)", 1, False), ("EATS", None, "Plant", "GRAZES", 2, False), ("EATS", None, "Animal", "EATEN_BY", 3, True), ("EATS", "Owl", "Animal", "HUNTS", 4, False)]
RULE_COLUMNS = "predicate string, if_s string, if_o string, target string, line int, swap boolean"


def test_rules_most_specific_wins(spark):
    facts = spark.createDataFrame([("Owl", "EATS", "Animal"), ("Fox", "EATS", "Animal"), ("Owl", "EATS", "Stone"), ("Fox", "EATS", "Plant"), ("Owl", "SEES", "Fox")], "s string, p string, o string")
    rules = spark.createDataFrame(RULES, RULE_COLUMNS)
    got = {r[:2]: r[2] for r in rows(S.apply_rules(facts, rules), "s", "o", "target")}
    assert got == {("Owl", "Animal"): "HUNTS", ("Fox", "Animal"): "EATEN_BY", ("Owl", "Stone"): "(none)", ("Fox", "Plant"): "GRAZES", ("Owl", "Fox"): None}
    entity = spark.createDataFrame([("Fox", "Canid"), ("Animal", "Prey")], "source string, target string")
    got = {r[:2]: r[2:] for r in rows(S.translate(facts, entity, rules), "s", "o", "ts", "tp", "to")}
    assert got["Fox", "Animal"] == ("Prey", "EATEN_BY", "Canid") and got["Owl", "Stone"] == (None, None, None)


def test_conflicts(spark):
    rules = spark.createDataFrame([("P", "A", None, "X", 1), ("P", None, "B", "Y", 2), ("Q", "A", None, "X", 3), ("Q", None, "B", "Y", 4), ("Q", "A", "B", "X", 5)], "predicate string, if_s string, if_o string, target string, line int")
    assert rows(S.rule_conflicts(rules), "predicate", "left", "right") == [("P", 1, 2)]


def test_merge_compare_and_reversal(spark):
    t = spark.createDataFrame
    base = t([("k", "K", 1)], "key string, name string, line int")
    add = t([("k", "kk", 1, False), ("m", "M2", 2, False), ("m", "M1", 3, False), ("h", "H", 4, True)], "key string, name string, line int, held_out boolean")
    assert rows(S.merge(base, add, "key", "name"), "key", "name") == [("k", "K"), ("m", "M2")]
    assert rows(S.compare(base, add, ["key"]), "key", "where") == [("h", "right"), ("k", "both"), ("m", "right")]
    assert S.same_schema(base, base) and not S.same_schema(base, add.select("key", "name", "line"))
    pat = t([("A", "R", "B")], "s string, p string, o string")
    assert rows(S.reversal_doubts(t([("B", "R", "A"), ("A", "R", "B"), ("C", "R", "A")], "s string, p string, o string"), pat), "s", "o") == [("B", "A")]


def test_representative(spark):
    pool = [dict(group="g", text="t1", maintainer="m1"), dict(group="g", text="t1", maintainer="m1"), dict(group="g", text="t2", maintainer="m2"), dict(group="h", text="t1", maintainer="m3")]
    assert [(c["group"], c["text"]) for c in S.representative(pool, 3)] == [("g", "t1"), ("h", "t1"), ("g", "t2")]
    df = spark.createDataFrame([("e", "g", f"t{i}", f"m{i % 3}") for i in range(10)], "entry string, grp string, txt string, who string")
    assert S.representative_examples(df, "entry", 3, "grp", "txt", "who").count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_representative_over_many_rows(spark, seed):
    """What is kept of a frequent entry decides as all of its rows would: the 61st row with a new maintainer is still found."""
    rng = random.Random(seed)
    rows = [("one", "Z", f"t{i:02d}", "m0") for i in range(60)] + [("one", "Z", "t60", "m1"), ("one", "B", "t00", "m0")]
    for e in range(25):
        n_texts, n_makers, n_groups = rng.choice((2, 4, 30)), rng.choice((1, 3, 20)), rng.choice((1, 5, 40))
        rows += [(f"e{e}", f"g{rng.randrange(n_groups)}", f"t{rng.randrange(n_texts):02d}", f"m{rng.randrange(n_makers)}") for _ in range(rng.choice((3, 40, 300)))]
    df = spark.createDataFrame(rows, "entry string, grp string, txt string, who string")
    for n in (1, 2, 4):
        got = {}
        for r in S.representative_examples(df, "entry", n, "grp", "txt", "who").orderBy("entry", "place").collect():
            got.setdefault(r.entry, []).append(r.txt)
        want = {e: [c["text"] for c in S.representative([dict(group=g, text=t, maintainer=m) for x, g, t, m in rows if x == e], n)] for e in {r[0] for r in rows}}
        assert got == want


def test_request_chunks(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "k int, n int").coalesce(1)
    got = S.request_chunks(df, 3, 1000, "k", "n").groupBy("part", "chunk").count().collect()
    assert max(r["count"] for r in got) == 3 and sum(r["count"] for r in got) == 20


def fact(s, sc, p, o, oc):
    return dict(subject=s, subject_class=sc, predicate=p, object=o, object_class=oc)


TRUTH = [
    fact("MODIS", "Instrument", "ABOARD", "Aqua", "Spacecraft"), fact("AIRS", "Instrument", "ABOARD", "Aqua", "Spacecraft"), fact("MODIS Snow Cover", "Dataset", "ACQUIRED_BY", "MODIS", "Instrument"),
    fact("MODIS Snow Cover", "Dataset", "HAS_TIME_SPAN", "2002–2023", "TimeSpan"), fact("CERES", "Instrument", "ABOARD", "Aqua", "Spacecraft"),
]
FOUND = [
    fact("the MODIS", "Instrument", "ABOARD", "Aqua", "Spacecraft"), fact("AIRS", "Dataset", "ABOARD", "Aqua", "Spacecraft"),
    fact("MODIS Snow Cover 5-Min Swath", "Dataset", "ACQUIRED_BY", "Moderate Resolution Imaging (MODIS)", "Instrument"), fact("MODIS Snow Cover", "Dataset", "HAS_TIME_SPAN", "the period 2002–2023", "Dataset"),
    fact("MODIS", "Instrument", "ABOARD", "Terra", "Spacecraft"), fact("the MODIS", "Instrument", "ABOARD", "Aqua", "Satellite"),
]


def test_match_record():
    got = M.match_record(TRUTH, FOUND)
    assert (0, 0, "exact", False) in got and (1, 1, "exact", False) in got and (3, 3, "partial", False) in got
    assert all(g != 4 for g, *_ in got)
    vetoed = M.match_record(TRUTH, FOUND, lambda g, e: g["predicate"] == "HAS_TIME_SPAN")
    assert (3, 3, "partial", False) not in vetoed


def test_symmetric_swap():
    got = M.match_record([fact("X", "A", "ALSO_KNOWN_AS", "Y", "B")], [fact("Y", "B", "ALSO_KNOWN_AS", "X", "A")])
    assert got == [(0, 0, "exact", True)]


def test_match_records(spark):
    schema = "record string, i int, subject string, subject_class string, predicate string, object string, object_class string"
    t = spark.createDataFrame([("r", i, *f.values()) for i, f in enumerate(TRUTH)] + [("q", 0, *TRUTH[0].values())], schema)
    e = spark.createDataFrame([("r", i, *f.values()) for i, f in enumerate(FOUND)], schema)
    assert [(r.g, r.e, r.level) for r in M.match_records(t, e).orderBy("g").collect()] == [(g, e_, lv) for g, e_, lv, _ in M.match_record(TRUTH, FOUND)]
    ban = spark.createDataFrame([("r", 3, 3)], "record string, g int, e int")
    assert (3, 3) not in rows(M.match_records(t, e, ban), "g", "e")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 2)), max_size=12))
def test_best_pairing_is_optimal(edges):
    got = M.best_pairing(edges)
    assert len(set(got.values())) == len(got) and all((a, b) in edges for a, b in got.items())

    def total(pairs):
        return (-len(pairs), *(sum(edges[p][i] for p in pairs) for i in range(3)))

    best = min(total([(a, b) for a, b in zip(range(4), perm, strict=True) if (a, b) in edges and keep >> a & 1]) for perm in permutations(range(4)) for keep in range(16))
    assert total(list(got.items())) == best
