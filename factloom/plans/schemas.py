"""Queries of schema induction, validation, translation and matching on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import matching as M
from factloom.operators import schema as S
from factloom.plans.quality import table

RULES = [("BUYS", None, None, "(none)", 1), ("BUYS", "BUILDING", None, "BUILDS", 2), ("BUYS", None, "ASIA", "IMPORTS", 3), ("BUYS", "BUILDING", "ASIA", "OFFSHORES", 4), ("BUYS", "MACHINERY", None, "MAKES", 5)]
RULE_COLUMNS = "predicate string, if_s string, if_o string, target string, line int"
RULES_SQL = "rules(predicate, if_s, if_o, target, line) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RULES) + ")"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that buy in regions, as facts: id, s, p, o."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # one row a nation
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("s"), F.lit("BUYS").alias("p"), F.col("r_name").alias("o"))


FACTS_SQL = "f AS (SELECT c_custkey AS id, c_mktsegment AS s, 'BUYS' AS p, r_name AS o FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def support_counts(spark, sf_dir):
    """Orders and suppliers behind each pattern of brand and type (AGG-01)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return S.support_counts(li.join(p, F.col("l_partkey") == F.col("p_partkey")), ["p_brand", "p_type"], "l_orderkey", "l_suppkey")


def breadth_table(spark, sf_dir):
    """Patterns by how many regions have them (AGG-28)."""
    f = facts(spark, sf_dir).withColumn("entry", F.concat_ws(" ", "s", (F.col("id") % 40).cast("string")))
    return S.breadth(S.support_counts(f, ["entry"], "id", "o"), 2)


def saturation_curve(spark, sf_dir):
    """Words expected to reach two documents in random subsets of the labelled ones (AGG-27)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("support"))
    n = docs.count()
    out = S.saturation(words, n, [*(k for k in (25, 50, 100) if k < n), n], 2)
    return out.select("texts", F.round("expected", 3).alias("expected"))


def representative_examples(spark, sf_dir):
    """Five diverse examples of each part type over brands (AGG-02)."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return S.representative_examples(li.select("p_type", "p_brand", "l_orderkey", "l_suppkey"), "p_type", 5, "p_brand", "l_orderkey", "l_suppkey")


def label_lookup(spark, sf_dir):
    """Labels of the three slots of each fact, counted (JOIN-06)."""
    labels = spark.createDataFrame([("BUILDING", "Sector"), ("BUYS", "RELATES_TO"), ("ASIA", "Place"), ("EUROPE", "Place")], "name string, label string")
    out = S.with_labels(facts(spark, sf_dir).toDF("id", "subject", "predicate", "object"), labels)
    return out.groupBy("subject_label", "predicate_label", "object_label").agg(F.count(F.lit(1)).alias("n"))


def induced_support(spark, sf_dir):
    """Support of classes, predicates and patterns from partly labelled facts and titles (AGG-01)."""
    labels = spark.createDataFrame([("BUILDING", "Sector"), ("MACHINERY", "Sector"), ("BUYS", "RELATES_TO"), ("ASIA", "Place"), ("EUROPE", "Place")], "name string, label string")
    t = facts(spark, sf_dir).select((F.col("id") % 40).alias("text"), (F.col("id") % 7).alias("maintainer"), F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
    titles = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("text"), (F.col("s_suppkey") % 7).alias("maintainer"), F.lit("Supplier").alias("label"))
    return S.induced_support(t, labels, titles)


def pattern_validation(spark, sf_dir):
    """Facts by their schema errors (JOIN-07, FLT-04, FLT-05)."""
    t = spark.createDataFrame
    out = S.validate(
        facts(spark, sf_dir).withColumn("p", F.when(F.col("id") % 3 == 0, "SELLS").otherwise(F.col("p"))), t([("BUILDING",), ("MACHINERY",), ("ASIA",), ("EUROPE",), ("AFRICA",)], "name string"),
        t([("BUYS",), ("SELLS",)], "name string"), t([("BUILDING", "BUYS", "ASIA"), ("MACHINERY", "BUYS", "EUROPE")], "s string, p string, o string"), t([("SELLS", "BUILDING", "any")], "p string, ps string, po string"),
    )
    return out.groupBy(F.array_join("errors", ", ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def rule_lookup_most_specific(spark, sf_dir):
    """The target of each fact by the most specific rule (JOIN-11)."""
    return S.apply_rules(facts(spark, sf_dir), spark.createDataFrame(RULES, RULE_COLUMNS)).groupBy("s", "o", "target").agg(F.count(F.lit(1)).alias("n"))


def rule_conflicts(spark, sf_dir):
    """Rules that customers make for a nation, for an account's range, or for both: pairs that no third one settles (JOIN-14)."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("predicate"), F.when(k % 3 != 1, F.concat(F.lit("nation "), F.col("c_nationkey"))).alias("if_s"), F.when(k % 3 != 0, F.concat(F.lit("range "), F.floor(F.col("c_acctbal") / 1000))).alias("if_o"),
        F.concat(F.lit("to "), k % 5).alias("target"), k.alias("line"),
    )
    # the first customer of a condition makes its rule
    return S.rule_conflicts(c.groupBy("predicate", "if_s", "if_o").agg(F.min_by("target", "line").alias("target"), F.min("line").alias("line")))


def translate_facts(spark, sf_dir):
    """Facts in another schema (JOIN-12, PRJ-10)."""
    entity = spark.createDataFrame([("BUILDING", "Construction"), ("MACHINERY", "Industry"), ("ASIA", "East"), ("EUROPE", "West")], "source string, target string")
    rules = spark.createDataFrame(RULES, RULE_COLUMNS).withColumn("swap", F.col("target") == "IMPORTS")
    return S.translate(facts(spark, sf_dir), entity, rules).groupBy("ts", "tp", "to").agg(F.count(F.lit(1)).alias("n"))


def reachability_flags(spark, sf_dir):
    """Whether a rule can give each truth, with its classes too (JOIN-13)."""
    truth = facts(spark, sf_dir).select("id", "s", F.when(F.col("id") % 2 == 0, "IMPORTS").otherwise("SHIPS").alias("p"), "o")
    entity = spark.createDataFrame([("x", "BUILDING"), ("y", "ASIA")], "source string, target string")
    return S.reachability(truth, entity, spark.createDataFrame(RULES, RULE_COLUMNS)).groupBy("reachable", "strict").agg(F.count(F.lit(1)).alias("n"))


def schema_compare_full_outer(spark, sf_dir):
    """Brand and size patterns of two halves of the parts (JOIN-17)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return S.compare(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_brand", "p_size"])


def schema_merge(spark, sf_dir):
    """One spelling for each key, base first, held-out additions refused (JOIN-18)."""
    p = table(spark, sf_dir, "part").select(F.lower("p_type").alias("key"), F.concat("p_type", F.lit(" "), (F.col("p_partkey") % 3).cast("string")).alias("name"), F.col("p_partkey").alias("line"), (F.col("p_partkey") % 5 == 0).alias("held_out"))
    return S.merge(p.where("p_partkey % 7 = 0").select("key", "name", "line"), p.where("p_partkey % 7 <> 0"), "key", "name")


def reversal_doubts(spark, sf_dir):
    """Patterns that fit only the other way round (SCA-44)."""
    f = facts(spark, sf_dir)
    turned = f.select("id", F.when(F.col("id") % 4 == 0, F.col("o")).otherwise(F.col("s")).alias("s"), "p", F.when(F.col("id") % 4 == 0, F.col("s")).otherwise(F.col("o")).alias("o"))
    return S.reversal_doubts(turned, f.where("o = 'ASIA'").select("s", "p", "o").distinct())


def min_support_cut(spark, sf_dir):
    """Entries with the first reason for leaving them out (FLT-11)."""
    support = S.support_counts(facts(spark, sf_dir), ["s", "p", "o"], "id", "o").select("s", "p", "o", "support")
    return S.deferred(support, 5, spark.createDataFrame([("BUILDING",), ("ASIA",), ("EUROPE",), ("AFRICA",)], "name string"))


def conflicting_classes(spark, sf_dir):
    """Repeated facts of a record, and the same fact with other classes (SET-06)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    g = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("l_returnflag", "l_linestatus").alias("classed"))
    return g.groupBy((F.col("rows") > F.col("classed")).alias("repeated"), (F.col("classed") > 1).alias("conflicting")).agg(F.count(F.lit(1)).alias("facts"))


def table_states(spark, sf_dir):
    """States of translation rows: repeated, no match, suggested (FLT-09, FLT-12, SRC-14)."""
    p = table(spark, sf_dir, "part").select(F.lower(F.trim("p_brand")).alias("source"), F.when(F.col("p_size") > 40, F.lit("(none)")).otherwise(F.col("p_type")).alias("target"), (F.col("p_partkey") % 9 == 0).alias("checked"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source", "target"))
    states = F.array_compact(F.array(F.when(n > 1, "repeated"), F.when(F.col("target") == "(none)", "no match"), F.when(~F.col("checked"), "suggested")))
    return p.select("source", states.alias("states")).groupBy("source", F.array_join("states", ",").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def held_out_leakage(spark, sf_dir):
    """Source lines that name held-out positions (FLT-13)."""
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("from #"), (F.col("o_orderkey") % 30).cast("string"), F.lit(" and #"), (F.col("o_custkey") % 30).cast("string")).alias("line"))
    named = lines.select("o_orderkey", F.explode(F.regexp_extract_all("line", F.lit(r"#(\d+)"))).alias("p")).withColumn("p", F.col("p").cast("int"))
    bad = named.where((F.col("p") >= 6) & ((F.col("p") - 6) % 3 == 2))
    return bad.groupBy("p").agg(F.countDistinct("o_orderkey").alias("lines"))


def rules_format(spark, sf_dir):
    """Rule lists that are ascending, unique and in range (FLT-14)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", (F.col("o_orderkey") % 20).cast("string"), (F.col("o_custkey") % 25).cast("string")).alias("rules"))
    ids = F.transform(F.split("rules", ","), lambda x: x.cast("int"))
    ok = (F.array_sort(F.array_distinct(ids)) == ids) & F.forall(ids, lambda x: (x >= 1) & (x <= 20))
    return o.groupBy(ok.alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def qualifier_duplicates(spark, sf_dir):
    """Qualifiers that a subject of a record has more than once (SCA-24)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.lower("l_returnflag").alias("qualifier")).agg(F.count(F.lit(1)).alias("n"))
    return li.where("n > 1").groupBy("qualifier").agg(F.count(F.lit(1)).alias("subjects"), F.max("n").alias("most"))


def record_states(spark, sf_dir):
    """Ground-truth states of records, and what each purpose selects (FLT-03)."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.min("quality").alias("q"))
    d = docs.join(l, "doc_id", "left")
    state = F.when(F.col("files").isNull(), "absent").when(F.col("files") > 1, "in two files").when(F.col("q").isNull(), "bad mark").when(F.col("q") == 0, "unfinished").otherwise("finished")
    return d.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("records"), F.count(F.when((state == "finished") & (F.col("doc_id") % 3 != 2), 1)).alias("schema_evidence"))


def one_to_one_exact_pairs(spark, sf_dir):
    """Pairs that equal keys allow one to one: the lesser count of each key (JOIN-09)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    p = M.exact_multiset_pairs(li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1"), ["l_orderkey", "l_returnflag", "l_linestatus"])
    return p.groupBy("l_returnflag", "l_linestatus").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("keys"))


def assignment_matching(spark, sf_dir):
    """Optimal pairing of each order's even and odd items, with equal part brands as facts (JOIN-08, JOIN-09, JOIN-10)."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    fact = li.select(
        F.col("l_orderkey").cast("string").alias("record"), F.col("l_linenumber").cast("int").alias("i"), F.col("p_brand").alias("subject"), F.col("l_returnflag").alias("subject_class"),
        F.lit("HAS").alias("predicate"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("object"), F.col("l_linestatus").alias("object_class"),
    )
    return M.match_records(fact.where("i % 2 = 0"), fact.where("i % 2 = 1"))


def two_level_matches(spark, sf_dir):
    """Facts of customers against other wordings of them: equal, held in longer words, another one, swapped ends; every fifth partial pair is vetoed (JOIN-10, JOIN-16)."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("record"), "c_custkey", "c_name", "c_mktsegment", F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("place"))
    fact = lambda i, s, p, o: F.struct(F.lit(i).alias("i"), s.alias("subject"), F.lit("Buyer").alias("subject_class"), F.lit(p).alias("predicate"), o.alias("object"), F.lit("Thing").alias("object_class"))
    other = F.when(k % 3 == 0, F.upper("c_mktsegment")).when(k % 3 == 1, F.concat(F.lit("the "), F.lower("c_mktsegment"), F.lit(" market"))).otherwise(F.lit("none of it"))
    truth = F.array(fact(0, F.col("c_name"), "HAS", F.col("c_mktsegment")), fact(1, F.col("c_name"), "ALSO_KNOWN_AS", F.col("place")))
    found = F.array(fact(0, F.col("c_name"), "HAS", other), fact(1, F.col("place"), "ALSO_KNOWN_AS", F.lower("c_name")))
    vetoes = c.where(k % 5 == 0).select("record", F.lit(0).alias("g"), F.lit(0).alias("e"))
    return M.match_records(c.select("record", F.inline(truth)), c.select("record", F.inline(found)), vetoes)


def compared_projection(spark, sf_dir):
    """Statuses of compared facts as one wide relation (PRJ-11)."""
    f = facts(spark, sf_dir)
    status = F.when(F.col("id") % 6 == 0, "exact").when(F.col("id") % 6 == 1, "partial").when(F.col("id") % 6 == 2, "missed").when(F.col("id") % 6 == 3, "extra").when(F.col("id") % 6 == 4, "untranslatable").otherwise("pending")
    with_truth = f.withColumn("status", status)
    out = with_truth.where("status in ('exact', 'partial')").select("id", "status", F.col("s").alias("truth"), F.col("o").alias("found"))
    out = out.unionByName(with_truth.where("status = 'missed'").select("id", "status", F.col("s").alias("truth")), allowMissingColumns=True)
    out = out.unionByName(with_truth.where("status in ('extra', 'untranslatable', 'pending')").select("id", "status", F.col("o").alias("found")), allowMissingColumns=True)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count("truth").alias("truth"), F.count("found").alias("found"))


def origin_split(spark, sf_dir):
    """References to the extracted and the true side of an origin text (PRJ-12, JOIN-25)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("060/x.jsonl#"), F.col("o_orderkey").cast("string"), F.lit("; 050/batch_1.csv#"), F.col("o_custkey").cast("string")).alias("origin"))
    parts = F.split("origin", "; ")
    pick = lambda step: F.regexp_extract(F.element_at(F.filter(parts, lambda x: x.startswith(step)), 1), r"#(\d+)$", 1).cast("bigint")
    return o.select("o_orderkey", pick("060/").alias("extracted"), pick("050/").alias("truth"))


def partial_union_runs(spark, sf_dir):
    """Partial pairs of all runs, one row a pair with its runs (SET-07)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linestatus", F.year("l_shipdate").alias("run"))
    return li.groupBy("l_suppkey", "l_linestatus").agg(F.array_join(F.transform(F.array_sort(F.collect_set("run")), lambda x: x.cast("string")), ",").alias("runs"))


def stale_verdicts(spark, sf_dir):
    """Verdicts whose pair no longer exists (JOIN-16, JOIN-22)."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"))
    live = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    stale = v.join(live, ["l_orderkey", "l_linenumber"], "left_anti")
    return stale.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("stale"))


def guarded_row_merge(spark, sf_dir):
    """Drafted values joined by row position only where the content still agrees (JOIN-23)."""
    a = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    b = a.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "changed").otherwise(F.col("p_brand")).alias("brand"), (F.col("p_size") * 2).alias("drafted"))
    j = a.join(b, "p_partkey")
    return j.groupBy((F.col("p_brand") == F.col("brand")).alias("agrees")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p_brand") == F.col("brand"), F.col("drafted"))).alias("drafted"))


def induction_trace(spark, sf_dir):
    """Predicates that match a pattern at each stage (OPS-15)."""
    p = table(spark, sf_dir, "part").select("p_type", "p_size")
    stages = F.array(F.struct(F.lit("found").alias("stage"), F.lit(True).alias("ok")), F.struct(F.lit("supported").alias("stage"), (F.col("p_size") > 10).alias("ok")), F.struct(F.lit("kept").alias("stage"), (F.col("p_size") > 30).alias("ok")))
    return p.where(F.col("p_type").rlike("^[A-M]")).select("p_type", F.inline(stages)).where("ok").groupBy("stage").agg(F.countDistinct("p_type").alias("predicates"), F.count(F.lit(1)).alias("facts"))


def reproduction_check(spark, sf_dir):
    """Recorded numbers against recomputed ones (OPS-13)."""
    now = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    then = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg((F.round(F.sum("o_totalprice"), 2) + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("recorded"))
    return now.join(then, "o_orderstatus").select("o_orderstatus", (F.abs(F.col("value") - F.col("recorded")) < 0.01).alias("reproduced"))


QUERIES = {f.__name__: f for f in (
    support_counts, breadth_table, saturation_curve, representative_examples, label_lookup, induced_support, pattern_validation, rule_lookup_most_specific, rule_conflicts, translate_facts, reachability_flags,
    schema_compare_full_outer, schema_merge, reversal_doubts, min_support_cut, conflicting_classes, table_states, held_out_leakage, rules_format, qualifier_duplicates, record_states,
    one_to_one_exact_pairs, assignment_matching, two_level_matches, compared_projection, origin_split, partial_union_runs, stale_verdicts, guarded_row_merge, induction_trace, reproduction_check,
)}

_BEST = f"""{FACTS_SQL}, {RULES_SQL},
  m AS (SELECT DISTINCT f.s, f.o, r.* FROM f JOIN rules r ON r.predicate = f.p AND (if_s IS NULL OR if_s = f.s) AND (if_o IS NULL OR if_o = f.o)),
  b AS (SELECT s, o, target FROM (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY (if_s IS NOT NULL)::INT + (if_o IS NOT NULL)::INT DESC, line) AS k FROM m) WHERE k = 1)"""

ORACLES = {
    "support_counts": "SELECT p_brand, p_type, count(DISTINCT l_orderkey) AS support, count(DISTINCT l_suppkey) AS maintainers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    "breadth_table": f"""WITH {FACTS_SQL}, e AS (SELECT s || ' ' || (id % 40) AS entry, count(DISTINCT id) AS support, count(DISTINCT o) AS m FROM f GROUP BY 1)
      SELECT CASE m WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3 or more' END AS found_in, count(*) AS entries FROM e WHERE support >= 2 GROUP BY 1""",
    "saturation_curve": """WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), w AS (SELECT w, count(*)::DOUBLE AS f FROM (SELECT unnest(list_distinct(string_split(text, ' '))) AS w FROM d) GROUP BY 1),
      n AS (SELECT count(*)::DOUBLE AS n FROM d), k AS (SELECT DISTINCT k FROM (SELECT unnest([25.0, 50.0, 100.0, (SELECT n FROM n)])::DOUBLE AS k) WHERE k <= (SELECT n FROM n)), x AS (SELECT unnest([0.0, 1.0]) AS x),
      s AS (SELECT f, count(*) AS c FROM w GROUP BY 1),
      t AS (SELECT f, c, k, sum(CASE WHEN f >= x AND k >= x AND n - f >= k - x THEN exp(lgamma(f + 1) - lgamma(x + 1) - lgamma(f - x + 1) + lgamma(n - f + 1) - lgamma(k - x + 1) - lgamma(n - f - k + x + 1)
        - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) ELSE 0 END) AS below FROM s, k, x, n GROUP BY 1, 2, 3)
      SELECT k::BIGINT AS texts, round(sum(c * CASE WHEN f >= 2 THEN greatest(0, 1 - below) ELSE 0 END), 3) AS expected FROM t GROUP BY 1""",
    "label_lookup": f"""WITH {FACTS_SQL} SELECT CASE s WHEN 'BUILDING' THEN 'Sector' END AS subject_label, CASE p WHEN 'BUYS' THEN 'RELATES_TO' END AS predicate_label, CASE WHEN o IN ('ASIA', 'EUROPE') THEN 'Place' END AS object_label, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "induced_support": f"""WITH {FACTS_SQL}, l AS (SELECT id % 40 AS t, id % 7 AS m, CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN 'Sector' END AS s, 'RELATES_TO' AS p, CASE WHEN o IN ('ASIA', 'EUROPE') THEN 'Place' END AS o FROM f),
      e AS (SELECT t, m, 'class' AS kind, s AS entry FROM l UNION ALL SELECT t, m, 'class', o FROM l UNION ALL SELECT t, m, 'predicate', p FROM l UNION ALL SELECT t, m, 'pattern', s || ' ' || p || ' ' || o FROM l
        UNION ALL SELECT s_suppkey % 40, s_suppkey % 7, 'class', 'Supplier' FROM supplier)
      SELECT kind, entry, count(DISTINCT t) AS support, count(DISTINCT m) AS maintainers FROM e WHERE entry IS NOT NULL GROUP BY 1, 2""",
    "pattern_validation": f"""WITH {FACTS_SQL}, g AS (SELECT s, CASE WHEN id % 3 = 0 THEN 'SELLS' ELSE p END AS p, o FROM f)
      SELECT concat_ws(', ', CASE WHEN s NOT IN ('BUILDING', 'MACHINERY', 'ASIA', 'EUROPE', 'AFRICA') THEN 'subject class' END, CASE WHEN o NOT IN ('BUILDING', 'MACHINERY', 'ASIA', 'EUROPE', 'AFRICA') THEN 'object class' END,
        CASE WHEN p = 'BUYS' AND NOT ((s = 'BUILDING' AND o = 'ASIA') OR (s = 'MACHINERY' AND o = 'EUROPE')) THEN 'pattern' END, CASE WHEN p = 'SELLS' AND s <> 'BUILDING' THEN 'pin' END) AS errors, count(*) AS n FROM g GROUP BY 1""",
    "rule_lookup_most_specific": f"WITH {_BEST} SELECT f.s, f.o, target, count(*) AS n FROM f LEFT JOIN b ON b.s = f.s AND b.o = f.o GROUP BY 1, 2, 3",
    "rule_conflicts": """WITH c AS (SELECT c_mktsegment AS predicate, CASE WHEN c_custkey % 3 <> 1 THEN 'nation ' || c_nationkey END AS s, CASE WHEN c_custkey % 3 <> 0 THEN 'range ' || floor(c_acctbal / 1000)::BIGINT END AS o, c_custkey % 5 AS target, c_custkey AS line FROM customer),
      r AS (SELECT predicate, s, o, arg_min(target, line) AS target, min(line) AS line FROM c GROUP BY 1, 2, 3)
      SELECT a.predicate, a.line AS "left", b.line AS "right" FROM r a JOIN r b ON a.predicate = b.predicate AND a.s IS NOT NULL AND a.o IS NULL AND b.o IS NOT NULL AND b.s IS NULL AND a.target <> b.target
      WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.predicate = a.predicate AND x.s = a.s AND x.o = b.o)""",
    "translate_facts": f"""WITH {_BEST}, e(source, target) AS (VALUES ('BUILDING', 'Construction'), ('MACHINERY', 'Industry'), ('ASIA', 'East'), ('EUROPE', 'West')),
      x AS (SELECT nullif(b.target, '(none)') AS tp, coalesce(b.target = 'IMPORTS', false) AS w, e1.target AS a, e2.target AS c FROM f LEFT JOIN b ON b.s = f.s AND b.o = f.o LEFT JOIN e e1 ON e1.source = f.s LEFT JOIN e e2 ON e2.source = f.o)
      SELECT CASE WHEN w THEN c ELSE a END AS ts, tp, CASE WHEN w THEN a ELSE c END AS "to", count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "reachability_flags": f"""WITH {FACTS_SQL} SELECT id % 2 = 0 AS reachable, id % 2 = 0 AND s IN ('BUILDING', 'ASIA') AND o IN ('BUILDING', 'ASIA') AS strict, count(*) AS n FROM f GROUP BY 1, 2""",
    "schema_compare_full_outer": """WITH a AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 1)
      SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.p_size, b.p_size) AS p_size, CASE WHEN a.p_brand IS NULL THEN 'right' WHEN b.p_brand IS NULL THEN 'left' ELSE 'both' END AS "where" FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_size = b.p_size""",
    "schema_merge": """WITH p AS (SELECT lower(p_type) AS key, p_type || ' ' || (p_partkey % 3) AS name, p_partkey AS line, p_partkey % 5 = 0 AS h, p_partkey % 7 = 0 AS base FROM part)
      SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY base DESC, line, name) AS k FROM p WHERE base OR NOT h) WHERE k = 1""",
    "reversal_doubts": f"""WITH {FACTS_SQL}, t AS (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN o ELSE s END AS s, p, CASE WHEN id % 4 = 0 THEN s ELSE o END AS o FROM f), q AS (SELECT DISTINCT s, p, o FROM f WHERE o = 'ASIA')
      SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.s = t.s AND q.p = t.p AND q.o = t.o) AND EXISTS (SELECT 1 FROM q WHERE q.s = t.o AND q.p = t.p AND q.o = t.s)""",
    "min_support_cut": f"""WITH {FACTS_SQL} SELECT s, p, o, count(DISTINCT id) AS support, CASE WHEN count(DISTINCT id) < 5 THEN 'too little support' WHEN s NOT IN ('BUILDING', 'ASIA', 'EUROPE', 'AFRICA') THEN 'subject class left out'
      WHEN o NOT IN ('BUILDING', 'ASIA', 'EUROPE', 'AFRICA') THEN 'object class left out' END AS reason FROM f GROUP BY 1, 2, 3""",
    "conflicting_classes": """WITH g AS (SELECT l_orderkey, l_suppkey, count(*) AS n, count(DISTINCT l_returnflag || l_linestatus) AS c FROM lineitem GROUP BY 1, 2) SELECT n > c AS repeated, c > 1 AS conflicting, count(*) AS facts FROM g GROUP BY 1, 2""",
    "table_states": """WITH p AS (SELECT lower(trim(p_brand)) AS source, CASE WHEN p_size > 40 THEN '(none)' ELSE p_type END AS target, p_partkey % 9 = 0 AS checked FROM part), s AS (SELECT *, count(*) OVER (PARTITION BY source, target) AS n FROM p)
      SELECT source, concat_ws(',', CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN target = '(none)' THEN 'no match' END, CASE WHEN NOT checked THEN 'suggested' END) AS state, count(*) AS n FROM s GROUP BY 1, 2""",
    "held_out_leakage": """WITH l AS (SELECT o_orderkey, unnest([o_orderkey % 30, o_custkey % 30])::INTEGER AS p FROM orders) SELECT p, count(DISTINCT o_orderkey) AS lines FROM l WHERE p >= 6 AND (p - 6) % 3 = 2 GROUP BY 1""",
    "rules_format": """SELECT o_orderkey % 20 < o_custkey % 25 AND o_orderkey % 20 >= 1 AND o_custkey % 25 <= 20 AS ok, count(*) AS n FROM orders GROUP BY 1""",
    "qualifier_duplicates": "WITH g AS (SELECT l_orderkey, lower(l_returnflag) AS qualifier, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT qualifier, count(*) AS subjects, max(n) AS most FROM g WHERE n > 1 GROUP BY 1",
    "record_states": """WITH l AS (SELECT doc_id, count(*) AS n, min(quality) AS q FROM labels GROUP BY 1), s AS (SELECT d.doc_id, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'in two files' WHEN q IS NULL THEN 'bad mark' WHEN q = 0 THEN 'unfinished' ELSE 'finished' END AS state FROM documents d LEFT JOIN l USING (doc_id))
      SELECT state, count(*) AS records, count(*) FILTER (state = 'finished' AND doc_id % 3 <> 2) AS schema_evidence FROM s GROUP BY 1""",
    "one_to_one_exact_pairs": """WITH a AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) FILTER (l_linenumber % 2 = 0) AS x, count(*) FILTER (l_linenumber % 2 = 1) AS y FROM lineitem GROUP BY 1, 2, 3)
      SELECT l_returnflag, l_linestatus, sum(least(x, y))::BIGINT AS pairs, count(*) AS keys FROM a WHERE x > 0 AND y > 0 GROUP BY 1, 2""",
    "two_level_matches": """SELECT c_custkey::VARCHAR AS record, 0 AS g, 0 AS e, CASE WHEN c_custkey % 3 = 0 THEN 'exact' ELSE 'partial' END AS level, false AS swapped FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 5 <> 0)
      UNION ALL SELECT c_custkey::VARCHAR, 1, 1, 'exact', true FROM customer""",
    "compared_projection": f"""WITH {FACTS_SQL}, s AS (SELECT *, CASE id % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' WHEN 2 THEN 'missed' WHEN 3 THEN 'extra' WHEN 4 THEN 'untranslatable' ELSE 'pending' END AS status FROM f)
      SELECT status, count(*) AS rows, count(*) FILTER (id % 6 IN (0, 1, 2)) AS truth, count(*) FILTER (id % 6 <> 2) AS found FROM s GROUP BY 1""",
    "origin_split": "SELECT o_orderkey, o_orderkey AS extracted, o_custkey AS truth FROM orders",
    "partial_union_runs": "SELECT l_suppkey, l_linestatus, string_agg(DISTINCT year(l_shipdate)::VARCHAR, ',' ORDER BY year(l_shipdate)::VARCHAR) AS runs FROM lineitem GROUP BY 1, 2",
    "stale_verdicts": """WITH v AS (SELECT o_orderkey AS k, (o_orderkey % 7 + 1)::INTEGER AS l_linenumber FROM orders) SELECT l_linenumber, count(*) AS stale FROM v WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = v.k AND l.l_linenumber = v.l_linenumber) GROUP BY 1""",
    "guarded_row_merge": "SELECT p_partkey % 10 <> 0 AS agrees, count(*) AS n, sum(CASE WHEN p_partkey % 10 <> 0 THEN p_size * 2 END)::BIGINT AS drafted FROM part GROUP BY 1",
    "induction_trace": """WITH p AS (SELECT p_type, unnest(list_filter(['found', 'supported', 'kept'], lambda x: x = 'found' OR (x = 'supported' AND p_size > 10) OR (x = 'kept' AND p_size > 30))) AS stage FROM part WHERE regexp_matches(p_type, '^[A-M]'))
      SELECT stage, count(DISTINCT p_type) AS predicates, count(*) AS facts FROM p GROUP BY 1""",
    "reproduction_check": "SELECT o_orderstatus, o_orderstatus <> 'P' AS reproduced FROM orders GROUP BY 1",
}
