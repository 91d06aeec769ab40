"""Queries do their whole table: fixtures whose rows an earlier filter or cap left out."""

import random
from collections import Counter
from itertools import combinations, permutations

import pytest

from factloom.functions import stats
from factloom.operators import graph
from factloom.plans import quality, records, schemas, selection, texts


def write(spark, folder, **tables):
    """Small tables, (schema, rows) by name, where the queries look for them."""
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_repaired_encoding_reads_past_200_characters(spark, tmp_path):
    long = "a" * 300 + " é – ü"
    at = write(spark, tmp_path, documents=("doc_id long, text string", [(1, long), (2, "kurz é"), (3, "x" * 500), (4, "b" * 300 + " Ã©")]))
    # the text of 4 looks damaged itself, so that its repair goes too far: seen only if the whole text is read
    assert {r.doc_id: r.right for r in texts.repaired_encoding(spark, at).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_text_contains_reads_every_language(spark, tmp_path):
    at = write(spark, tmp_path, documents=("doc_id long, lang string, text string", [(1, "en", "on the of"), (2, "de", "on the of it"), (3, None, "the of"), (4, "fr", "bathe offer"), (5, "en", None)]))
    assert {r.doc_id: r.found for r in texts.text_contains(spark, at).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def brute_pairs(truth, found):
    """(pairs, costs, negative) of the best pairing of equal names, by trying all."""
    best = (0, (0, 0))
    for n in range(1, min(len(truth), len(found)) + 1):
        for gs in combinations(truth, n):
            for es in permutations(found, n):
                if all(g[0] == e[0] and g[2] == e[2] for g, e in zip(gs, es, strict=True)):
                    differ = [(g[1] != e[1]) + (g[3] != e[3]) for g, e in zip(gs, es, strict=True)]
                    cost = (sum(x > 0 for x in differ), sum(differ))
                    best = max(best, (n, tuple(-c for c in cost)))
    return best


def test_assignment_matching_pairs_every_order(spark, tmp_path):
    rng = random.Random(5)
    part = [(1, "Brand#11", "STANDARD A"), (2, "Brand#22", "STANDARD B"), (3, "Brand#11", "SMALL A"), (4, "Brand#11", "STANDARD C")]
    items = [(o, line, rng.choice(part)[0], rng.choice("AN"), rng.choice("FO")) for o in range(1, 31) for line in range(1, 8)]
    at = write(spark, tmp_path, part=("p_partkey long, p_brand string, p_type string", part), lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string", items))
    kind = {k: (b, t.split()[0]) for k, b, t in part}
    facts = {(str(o), i): (kind[p][0], f, kind[p][1], s) for o, i, p, f, s in items}
    got = {}
    for r in schemas.assignment_matching(spark, at).collect():
        assert r.level == "exact" and not r.swapped and r.g % 2 == 0 and r.e % 2 == 1
        g, e = facts[r.record, r.g], facts[r.record, r.e]
        assert g[0] == e[0] and g[2] == e[2]
        differ = (g[1] != e[1]) + (g[3] != e[3])
        n, (a, b) = got.get(r.record, (0, (0, 0)))
        got[r.record] = (n + 1, (a - (differ > 0), b - differ))
    for o in range(1, 31):
        side = lambda odd, o=o: [facts[str(o), i] for i in range(1, 8) if i % 2 == odd]
        assert got.get(str(o), (0, (0, 0))) == brute_pairs(side(0), side(1))
    assert len(got) > 20


def orders(spark, folder):
    """Orders 1 to 20 of five items each; flag N stands in the known records' text, A does not."""
    items = [(o, line, "NA"[(o // 10 + line) % 2]) for o in range(1, 21) for line in range(1, 6)]
    return items, write(spark, folder, orders=("o_orderkey long", [(o,) for o in range(1, 21)]), lineitem=("l_orderkey long, l_linenumber int, l_returnflag string", items))


def test_row_errors_checks_every_order(spark, tmp_path):
    items, at = orders(spark, tmp_path)
    want = Counter()
    for o, line, flag in items:
        known = o % 10 == 0
        want[", ".join(e for e, is_so in (("incomplete", line == 4), ("id unknown", not known), ("no source text", line == 3), ("source not in text", known and line != 3 and flag == "A")) if is_so)] += 1
    assert {r.errors: r.n for r in records.row_errors(spark, at).collect()} == dict(want)


def test_unlinked_rows_walks_every_order(spark, tmp_path):
    _, at = orders(spark, tmp_path)
    # an order's first two items link it to parts 2 and 3; item 4 joins parts 1 and 5, item 5 parts 2 and 6
    assert {r.l_linenumber: r.n for r in records.unlinked_rows(spark, at).collect()} == {4: 20}


def judged_tables(spark, folder, sources):
    """Six judged documents of each source."""
    rng = random.Random(sources)
    docs = [(i, "en", f"src{i % sources}") for i in range(6 * sources)]
    labels = [(i, rng.randint(0, 1), int(rng.random() < (0.8 if i % 2 else 0.4))) for i, *_ in docs]
    at = write(spark, folder, documents=("doc_id long, lang string, source string", docs), labels=("doc_id long, quality int, toxic int", labels))
    pairs = {s: [[0, 0], [0, 0]] for _, _, s in docs}
    for (i, _, s), (_, quality, toxic) in zip(docs, labels, strict=True):
        pairs[s][i % 2][0] += int(toxic == 1 and quality == 0)
        pairs[s][i % 2][1] += int(toxic == 1)
    return at, [(tuple(x), tuple(y)) for x, y in pairs.values()]


def test_sign_flip_takes_every_source(spark, tmp_path):
    for n in (1, 13):
        at, pairs = judged_tables(spark, tmp_path / str(n), n)
        want, got = stats.sign_flip(pairs), quality.sign_flip_exact(spark, at).first()
        assert (got.as_far, got.tried, got.p) == (want["as_far"], 2**n, round(want["p"], 6))
    with pytest.raises(ValueError, match="too many"):
        quality.sign_flip_exact(spark, judged_tables(spark, tmp_path / "many", quality.MOST_FLIPPED + 1)[0])


def test_lineage_walk_starts_from_every_order(spark, tmp_path):
    at = write(spark, tmp_path, orders=("o_orderkey long, o_custkey long", [(1, 7), (97, 8)]), customer=("c_custkey long, c_nationkey long", [(7, 3), (8, 4)]), nation=("n_nationkey long, n_regionkey long", [(3, 0), (4, 0)]))
    assert {(r.node, r.depth) for r in selection.lineage_walk(spark, at).collect()} == {("o#1", 0), ("o#97", 0), ("c#7", 1), ("c#8", 1), ("n#3", 2), ("n#4", 2), ("r#0", 3)}


def test_walk_raises_when_it_is_not_at_the_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "child string, parent string")
    start = spark.createDataFrame([("n0",)], "node string")
    assert graph.walk(chain, start, 4).count() == 5
    with pytest.raises(RuntimeError, match="deeper"):
        graph.walk(chain, start, 3)
