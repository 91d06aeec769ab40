"""Queries of record-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import stats as S
from factloom.operators import records as R
from factloom.plans.quality import table


def describes_rows(spark, sf_dir):
    """The describes fact of each supplier (PRJ-05)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("  "), F.regexp_replace("s_name", "#", "  "), F.lit(" ")).alias("title"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("Supplier").alias("c"))
    return R.describes_rows(s, entity_class="c")


def describes_problems(spark, sf_dir):
    """What is wrong with describes facts (SCA-21)."""
    d = describes_rows(spark, sf_dir).withColumn("subject", F.when(F.col("id").cast("long") % 5 == 0, "other").otherwise(F.col("subject")))
    d = d.unionByName(d.where("cast(id as long) % 7 = 0"))
    out = R.describes_problems(d, spark.createDataFrame([("Supplier",)], "name string"))
    return out.groupBy(F.array_join("problems", ", ").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


def clean_field_columns(spark, sf_dir):
    """Fields with their cleaned text and method (PRJ-06)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<b>"), "p_name", F.lit("</b> &amp; co")).alias("title"))
    return R.cleaned_fields(p, ["title"])


def export_instances(spark, sf_dir):
    """Instances of facts by slot (PRJ-13)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.export_instances(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("subject"), F.lit("PART_OF").alias("predicate"), F.col("r_name").alias("object")))


def pin_keys(spark, sf_dir):
    """Patterns as pin keys, counted (SCA-39)."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("s"), F.when(F.col("c_custkey") % 5 != 0, F.lit("Place")).alias("o"))
    return c.groupBy(R.pin_key("s", "o").alias("pin")).agg(F.count(F.lit(1)).alias("n"))


def consolidated_names(spark, sf_dir):
    """Part types folded over case and order (AGG-34)."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("t"))
    return R.consolidate(p, F.lower("t"), "t")


def status_counts(spark, sf_dir):
    """Suppliers as steps: shipments after their last return (AGG-40)."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("step"), "l_shipdate", "l_returnflag")
    steps = li.where("l_returnflag = 'R'").groupBy("step").agg(F.max("l_shipdate").alias("ran_at"))
    return R.out_of_date(steps, li.select("step", F.col("l_shipdate").alias("changed_at")))


def wrong_row_bounds(spark, sf_dir):
    """The most toxic documents of each source that its labelled ones leave possible (AGG-26)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("toxic").alias("sample"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("wrong"))
    return n.select("*", S.wrong_bound_udf("documents", "sample", "wrong").alias("most"))


def t_quantiles(spark, sf_dir):
    """Quantiles of Student's t for as many degrees of freedom as nations have customers, less one (SCA-30)."""
    df = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.count(F.lit(1)) - 1).alias("df")).select("df").distinct().where("df > 0")
    return S.with_t(df, "df").select("df", F.round("t", 4).alias("t"))


def quantity_words(spark, sf_dir):
    """Words with the only quantity as one word (SCA-04)."""
    from factloom.functions.keys import quantity_words_udf

    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a "), F.col("p_size").cast("string"), F.lit(" km (km) "), F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1))).alias("t"))
    return p.select("p_partkey", F.array_join(quantity_words_udf("t"), "|").alias("words"))


def _order_facts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    head = F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.lit("part "), (F.col("l_linenumber") % 3).cast("string")))
    return li.select(
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("id"), "l_linenumber", head.alias("subject"), F.lit("Item").alias("subject_class"), F.lit("HAS").alias("predicate"),
        F.concat(F.lit("part "), (F.col("l_linenumber") + 1).cast("string")).alias("object"), F.when(F.col("l_linenumber") == 4, "").otherwise("Item").alias("object_class"),
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.concat(F.lit("flag "), "l_returnflag")).alias("source_text"),
    )


def row_errors(spark, sf_dir):
    """Errors of the facts of all orders against their record's text; one order in ten is a known record (FLT-04)."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("id"), F.lit("sold with flag N; and flag R.").alias("text"))
    return R.row_errors(_order_facts(spark, sf_dir).drop("l_linenumber"), o).groupBy(F.array_join("errors", ", ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def unlinked_rows(spark, sf_dir):
    """Facts of all orders that nothing links to their record (SET-08)."""
    rows = _order_facts(spark, sf_dir).where("l_linenumber <> 3").select("id", "subject", "object", "l_linenumber")
    return R.unlinked_rows(rows).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (describes_rows, describes_problems, clean_field_columns, export_instances, pin_keys, consolidated_names, status_counts, wrong_row_bounds, t_quantiles, quantity_words, row_errors, unlinked_rows)}

_ROWS = r"""s AS (SELECT s_suppkey::VARCHAR AS id, trim(regexp_replace('  ' || regexp_replace(s_name, '#', '  ', 'g') || ' ', '\s+', ' ', 'g')) AS t, CASE WHEN s_suppkey % 4 = 0 THEN 'X' ELSE 'Supplier' END AS c, s_suppkey AS k FROM supplier)"""
ORACLES = {
    "describes_rows": f"WITH {_ROWS} SELECT id, id AS subject, 'CatalogEntry' AS subject_class, 'DESCRIBES' AS predicate, t AS object, c AS object_class, '(record structure)' AS source_text FROM s",
    "describes_problems": f"""WITH {_ROWS}, d AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE k % 7 = 0)
      SELECT concat_ws(', ', CASE WHEN k % 5 = 0 THEN 'subject is not the record' END, CASE WHEN c = 'X' THEN 'class undecided' END, CASE WHEN k % 7 = 0 THEN 'several describes rows' END) AS problems, count(*) AS n FROM d GROUP BY 1""",
    "clean_field_columns": "SELECT p_partkey, '<b>' || p_name || '</b> &amp; co' AS title, p_name || ' & co' AS title_clean, 'parsed' AS title_clean_method FROM part",
    "export_instances": """SELECT n_nationkey AS id, unnest([0, 1, 2])::INTEGER AS place, unnest(['subject', 'predicate', 'object']) AS slot, unnest([n_name, 'PART_OF', r_name]) AS name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "pin_keys": "SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'any' END || ' -> ' || CASE WHEN c_custkey % 5 <> 0 THEN 'Place' ELSE 'any' END AS pin, count(*) AS n FROM customer GROUP BY 1",
    "consolidated_names": """WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS t FROM part), n AS (SELECT lower(t) AS key, t, count(*) AS n FROM p GROUP BY 1, 2)
      SELECT key, first(t ORDER BY n DESC, t) AS name, sum(n)::BIGINT AS rows, count(*) AS spellings, count(*) > 1 AS merged FROM n GROUP BY 1""",
    # by the facts' construction: items 1, 2 and 3 name the order's own parts, 5 goes on from the part of 1, the others stand apart
    "unlinked_rows": """WITH h AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS one FROM lineitem GROUP BY 1)
      SELECT l_linenumber, count(*) AS n FROM lineitem JOIN h USING (l_orderkey) WHERE l_linenumber IN (4, 6, 7) OR (l_linenumber = 5 AND NOT one) GROUP BY 1""",
    "status_counts": """WITH s AS (SELECT l_suppkey AS step, max(l_shipdate) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
      SELECT step, count(*) FILTER (l_shipdate > r) AS waiting, false AS never_ran FROM s JOIN lineitem ON l_suppkey = step GROUP BY 1""",
    "row_errors": """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_returnflag AS f FROM lineitem)
      SELECT concat_ws(', ', CASE WHEN i = 4 THEN 'incomplete' END, CASE WHEN k % 10 <> 0 THEN 'id unknown' END, CASE WHEN i = 3 THEN 'no source text' END, CASE WHEN i <> 3 AND k % 10 = 0 AND f = 'A' THEN 'source not in text' END) AS errors, count(*) AS n FROM l GROUP BY 1""",
    # bisection of the distribution function, integrated by Simpson's rule
    "t_quantiles": """WITH RECURSIVE d AS (SELECT DISTINCT count(*) - 1 AS df FROM customer GROUP BY c_nationkey HAVING count(*) > 1), k AS (SELECT df, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS c FROM d),
      r AS (SELECT df, c, 0.0::DOUBLE AS lo, 16.0::DOUBLE AS hi, 0 AS step FROM k
        UNION ALL SELECT df, c, CASE WHEN area < 0.475 THEN m ELSE lo END, CASE WHEN area < 0.475 THEN hi ELSE m END, step + 1
        FROM (SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * c * pow(1 + pow((lo + hi) / 2 * i / 1000.0, 2) / df, -(df + 1) / 2.0))) * (lo + hi) / 2 / 3000.0 AS area FROM r WHERE step < 45))
      SELECT df, round(lo, 4) AS t FROM r WHERE step = 45""",
    # the most b of n with a chance of 0.05 or more that k of them show w or fewer
    "wrong_row_bounds": """WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), g AS (SELECT source, count(*) AS documents, count(toxic) AS sample, coalesce(sum(toxic), 0)::BIGINT AS wrong FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1),
      b AS (SELECT *, unnest(range(wrong, documents - sample + wrong + 1)) AS bad FROM g), x AS (SELECT *, unnest(range(0, wrong + 1)) AS x FROM b),
      p AS (SELECT source, documents, sample, wrong, bad, sum(CASE WHEN x <= bad AND sample - x <= documents - bad THEN exp(lgamma(bad + 1) - lgamma(x + 1) - lgamma(bad - x + 1) + lgamma(documents - bad + 1) - lgamma(sample - x + 1)
        - lgamma(documents - bad - sample + x + 1) - lgamma(documents + 1) + lgamma(sample + 1) + lgamma(documents - sample + 1)) ELSE 0 END) AS chance FROM x GROUP BY ALL)
      SELECT source, documents, sample, wrong, max(bad) AS most FROM p WHERE chance >= 0.05 - 1e-9 GROUP BY ALL""",
    "quantity_words": "SELECT p_partkey, (p_size * 1000) || ' m|' || lower(split_part(p_type, ' ', 1)) AS words FROM part",
}
