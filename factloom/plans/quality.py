"""Queries of the quality metrics, on labels joined to documents: toxic as prediction, low quality as truth."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import stats as S

#: Sources of an exact test at most: 2^24 assignments.
MOST_FLIPPED = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, said, true, both: predicted, true and agreeing positives of each labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    said, true = F.col("toxic") == 1, F.col("quality") == 0
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", said.cast("long").alias("said"), true.cast("long").alias("true"), (said & true).cast("long").alias("both")
    )


JUDGED = """j AS (SELECT l.doc_id, d.lang, d.source, l.quality, l.toxic, (l.toxic = 1)::BIGINT AS said, (l.quality = 0)::BIGINT AS "true",
  (l.toxic = 1 AND l.quality = 0)::BIGINT AS "both" FROM labels l JOIN documents d USING (doc_id))"""


def _numbers() -> list:
    both, said, true = F.sum("both"), F.sum("said"), F.sum("true")
    return [
        both.alias("pairs"), said.alias("extracted"), true.alias("truth"),
        F.round(S.ratio(both, said), 6).alias("precision"), F.round(S.ratio(both, true), 6).alias("recall"), F.round(S.ratio(2 * both, said + true), 6).alias("f1"),
    ]


NUMBERS = """sum("both")::BIGINT AS pairs, sum(said)::BIGINT AS extracted, sum("true")::BIGINT AS truth,
  round(sum("both") / nullif(sum(said), 0), 6) AS precision, round(sum("both") / nullif(sum("true"), 0), 6) AS recall,
  round(2 * sum("both") / nullif(sum(said) + sum("true"), 0), 6) AS f1"""


def pooled_metrics_by_lang(spark, sf_dir):
    """Pooled precision, recall and F1 (AGG-06, AGG-07)."""
    return judged(spark, sf_dir).groupBy("lang").agg(*_numbers())


def clustered_wilson_by_lang(spark, sf_dir):
    """Precision with its clustered Wilson range, sources as clusters (AGG-09)."""
    parts = judged(spark, sf_dir).groupBy("lang", "source").agg(F.sum("both").alias("a"), F.sum("said").alias("b"))
    return _rounded(S.clustered_wilson(parts, ["lang"]))


def clustered_wilson_returnflag(spark, sf_dir):
    """Share of returned items by line status, suppliers as clusters (AGG-09)."""
    items = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_suppkey", (F.col("l_returnflag") == "R").cast("long").alias("r"))
    parts = items.groupBy("l_linestatus", "l_suppkey").agg(F.sum("r").alias("a"), F.count(F.lit(1)).alias("b"))
    return _rounded(S.clustered_wilson(parts, ["l_linestatus"]))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _wilson_sql(parts: str, group: str) -> str:
    t = ", ".join(f"({df}, {q!r})" for df, q in S.t_table())
    z = S.Z
    return f"""
WITH t(df, q) AS (VALUES {t}), {parts},
s AS (SELECT {group}, count(*) FILTER (b > 0) AS n, sum(a) FILTER (b > 0)::DOUBLE AS sa, sum(b) FILTER (b > 0)::DOUBLE AS sb,
  sum(a * a) FILTER (b > 0)::DOUBLE AS aa, sum(a * b) FILTER (b > 0)::DOUBLE AS ab, sum(b * b) FILTER (b > 0)::DOUBLE AS bb FROM p GROUP BY 1),
v AS (SELECT *, sa / sb AS p FROM s),
d AS (SELECT *, CASE WHEN p > 0 AND p < 1 AND n > 1 THEN greatest(1.0, n / (n - 1.0) * (aa - 2 * p * ab + p * p * bb) / (sb * sb) / (p * (1 - p) / sb)) END AS deff FROM v),
e AS (SELECT d.*, CASE WHEN n > 1 THEN (CASE WHEN p > 0 AND p < 1 THEN least(greatest(sb / deff, n), sb) ELSE n END) * pow({z} / q, 2) END AS n_eff FROM d LEFT JOIN t ON t.df = n - 1),
w AS (SELECT *, (p + {z * z} / (2 * n_eff)) / (1 + {z * z} / n_eff) AS c,
  {z} * sqrt(p * (1 - p) / n_eff + {z * z} / (4 * n_eff * n_eff)) / (1 + {z * z} / n_eff) AS h FROM e)
SELECT {group}, round(p, 6) AS value, round(CASE WHEN n_eff IS NULL THEN NULL WHEN p = 0 THEN 0.0 ELSE greatest(0.0, c - h) END, 6) AS low,
  round(CASE WHEN n_eff IS NULL THEN NULL WHEN p = 1 THEN 1.0 ELSE least(1.0, c + h) END, 6) AS high,
  n AS n_clusters, round(sb, 6) AS n_items, round(n_eff, 6) AS n_eff, round(deff, 6) AS deff FROM w"""


def per_class_metrics(spark, sf_dir):
    """Numbers of every class of each kind, most errors first within a kind (AGG-10)."""
    j = judged(spark, sf_dir)
    long = j.select("said", "true", "both", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("class")) for k in ("lang", "source")))).alias("x"))
    out = long.select("said", "true", "both", "x.*").groupBy("kind", "class").agg(*_numbers())
    cost = F.col("extracted") + F.col("truth") - 2 * F.col("pairs")
    return out.withColumn("cost_rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(cost), "class")).cast("long"))


def per_record_numbers(spark, sf_dir):
    """Numbers of each record, here a source (AGG-11)."""
    return judged(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("records"), *_numbers())


def strata_shares(spark, sf_dir):
    """Shares of each stratum in the sample and in the pool, and the sample's F1 there (AGG-12)."""
    pool = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("pool"))
    sample = judged(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("sample"), *_numbers()).select("source", "sample", "f1")
    both = pool.join(sample, "source", "left").withColumn("sample", F.coalesce("sample", F.lit(0)))
    one = Window.partitionBy(F.lit(0))
    return both.select(
        "source", "pool", "sample", "f1", F.round(F.col("pool") / F.sum("pool").over(one), 6).alias("pool_share"), F.round(S.ratio("sample", F.sum("sample").over(one)), 6).alias("sample_share")
    )


def describes_confusion(spark, sf_dir):
    """Confusion of two labels with shares of its row (AGG-08)."""
    n = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("quality")), 6))


def describes_accuracy(spark, sf_dir):
    """Accuracy, the majority class's accuracy and the macro average (AGG-08)."""
    j = table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("s"))
    by = j.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("t") == F.col("s")).cast("long")).alias("hit"))
    return by.agg(
        F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"), F.round(F.max("n") / F.sum("n"), 6).alias("majority"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro")
    )


def cohen_kappa(spark, sf_dir):
    """Agreement of two raters: observed, expected, kappa (AGG-25)."""
    n = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = n.groupBy("x").agg(F.sum("n").alias("r")), n.groupBy("y").agg(F.sum("n").alias("c"))
    chance = rows.join(cols, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("rc"))
    one = total.crossJoin(F.broadcast(chance))  # one row each
    # integers until the last division: kappa = (t * same - rc) / (t * t - rc)
    return one.select(
        "t", F.round(S.ratio("same", "t"), 6).alias("p_o"), F.round(S.ratio(F.col("rc"), F.col("t") * F.col("t")), 6).alias("p_e"),
        F.round(S.ratio(F.col("t") * F.col("same") - F.col("rc"), F.col("t") * F.col("t") - F.col("rc")), 6).alias("kappa"),
    )


def label_agreement(spark, sf_dir):
    """Specific agreement of each label: twice the common count over both raters' counts (AGG-25)."""
    j = table(spark, sf_dir, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y"))
    long = j.select(F.explode(F.array(F.struct(F.col("x").alias("label"), (F.col("x") == F.col("y")).alias("same")), F.struct(F.col("y").alias("label"), (F.col("x") == F.col("y")).alias("same")))).alias("z")).select("z.*")
    return long.groupBy("label").agg(F.count(F.lit(1)).alias("named"), F.round(F.avg(F.col("same").cast("double")), 6).alias("agreement"))


def holm_adjust(spark, sf_dir):
    """Holm's adjusted p-values of each market segment (AGG-24)."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c_acctbal") < 0).cast("long")).alias("k"))
    p = c.select("c_mktsegment", F.round(F.col("k") / F.col("n") / 10, 6).alias("p"))
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy("p", "c_mktsegment")
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(one) - F.row_number().over(order) + 1) * F.col("p"))
    return p.withColumn("s", step).select("c_mktsegment", "p", F.round(F.max("s").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("adjusted"))


def sign_flip_exact(spark, sf_dir):
    """Exact paired permutation test over all 2^n assignments of n sources (AGG-23).

    Sums of either half of the sources meet in one cross join, so each assignment is one row and one comparison of integers.
    """
    d = judged(spark, sf_dir)
    halves = d.withColumn("g", F.col("doc_id") % 2).groupBy("source").agg(*(F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0)).alias(f"{n}{g}") for g in (0, 1) for n, c in (("n", "both"), ("d", "said"))))
    pairs = [(r.n0, r.d0, r.n1, r.d1) for r in halves.orderBy("source").limit(MOST_FLIPPED + 1).collect()]
    if len(pairs) > MOST_FLIPPED:
        raise ValueError(f"more than {MOST_FLIPPED} sources are too many for an exact test")

    def sums(part, names):
        out = [(0, 0, 0, 0)]
        for p in part:
            out = [tuple(map(sum, zip(s, x, strict=True))) for x in (p, p[2:] + p[:2]) for s in out]
        return spark.createDataFrame(out, ", ".join(f"{n} long" for n in names))

    half = (len(pairs) + 1) // 2
    a, b, c, d = (F.col(x) + F.col(y) for x, y in zip("abcd", "efgh", strict=True))
    a0, b0, c0, d0 = (sum(p[i] for p in pairs) for i in range(4))
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731  a product of two products may pass 64 bits
    far = wide(F.abs(a * d - c * b)) * F.lit(Decimal(b0 * d0)) >= wide(b * d) * F.lit(Decimal(abs(a0 * d0 - c0 * b0)))
    out = sums(pairs[:half], "abcd").crossJoin(F.broadcast(sums(pairs[half:], "efgh"))).agg(F.sum(far.cast("long")).alias("as_far"), F.count(F.lit(1)).alias("tried"))
    return out.withColumn("p", F.round(F.col("as_far") / F.col("tried"), 6))


def spread_across_repeats(spark, sf_dir):
    """Least, most, mean and width of a number over repeats, null where a repeat lacks it (AGG-20)."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return o.groupBy("o_orderpriority").agg(F.count("v").alias("repeats"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.max("v") - F.min("v"), 4).alias("width"))


def pooled_repeats(spark, sf_dir):
    """Records' means over runs, then the ratio; variance of runs within records and between them (AGG-21)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("run")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("a"), F.count(F.lit(1)).alias("b"))
    rec = li.groupBy("l_suppkey").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.var_samp(F.col("a") / F.col("b")).alias("within"))
    return rec.agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("a") / F.sum("b"), 6).alias("value"), F.round(F.avg("within"), 6).alias("within"), F.round(F.var_samp(F.col("a") / F.col("b")), 6).alias("between"))


def paired_bootstrap(spark, sf_dir):
    """Paired bootstrap of the difference between two halves, sources as records (AGG-22)."""
    d = judged(spark, sf_dir).withColumn("g", F.col("doc_id") % 2).groupBy("source").agg(
        *(F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0)).alias(n) for g, n, c in ((0, "na", "both"), (0, "da", "said"), (1, "nb", "both"), (1, "db", "said")))
    )
    return S.paired_bootstrap(spark, d, seed=7)


def difference_verdicts(spark, sf_dir):
    """What the range of a difference allows to say (SCA-43), and its text in points (SCA-42)."""
    r = _rounded(S.clustered_wilson(judged(spark, sf_dir).groupBy("lang", "source").agg(F.sum("both").alias("a"), F.sum("true").alias("b")), ["lang"]))
    gap = r.select("lang", (F.col("value") - 0.5).alias("d"), (F.col("low") - 0.5).alias("lo"), (F.col("high") - 0.5).alias("hi"))
    verdict = F.when(F.col("lo").isNull(), "no range").when(F.col("lo") > 0, "higher").when(F.col("hi") < 0, "lower").otherwise("can't tell")
    return gap.select("lang", F.round("d", 6).alias("d"), verdict.alias("verdict"), F.when(F.col("d").isNull(), "no value").otherwise(F.format_string("%+.1f points", F.col("d") * 100)).alias("text"))


def provenance_groups(spark, sf_dir):
    """Truth found or not by group of who drafted it, with precision of what each found (AGG-13, JOIN-19)."""
    j = judged(spark, sf_dir).withColumn("drafted_by", F.when(F.col("doc_id") % 3 == 0, "person").when(F.col("doc_id") % 3 == 1, "model").otherwise("not checked"))
    return j.groupBy("drafted_by").agg(*_numbers(), F.sum(F.col("true") - F.col("both")).alias("not_found"))


PROVENANCE = """(CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'model' ELSE 'not checked' END)"""


def found_in_repeats(spark, sf_dir):
    """How many facts were found in k of n repeats (AGG-14)."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.countDistinct(F.dayofweek("ts")).alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("facts"))


def margin_assumptions(spark, sf_dir):
    """The largest record's share of the items and the share of the catalog that was evaluated (AGG-16)."""
    per = judged(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pool = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("catalog"))
    return per.agg(F.max("n").alias("largest"), F.sum("n").alias("items")).crossJoin(F.broadcast(pool)).select("largest", "items", F.round(F.col("largest") / F.col("items"), 6).alias("largest_share"), F.round(F.col("items") / F.col("catalog"), 6).alias("catalog_share"))


def numbers_without_twins(spark, sf_dir):
    """The numbers with and without records that have a twin (AGG-17)."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    twins = text.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    j = judged(spark, sf_dir).join(text.join(twins, "h", "left_semi").select("doc_id", F.lit(1).alias("twin")), "doc_id", "left")
    return j.agg(*_numbers()).withColumn("records", F.lit("all")).unionByName(j.where("twin is null").agg(*_numbers()).withColumn("records", F.lit("without twins")))


def multiset_multiplicity(spark, sf_dir):
    """How often each translated element occurs (AGG-18)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return li.groupBy("l_returnflag", "n").agg(F.count(F.lit(1)).alias("groups"))


def mismatch_frequency(spark, sf_dir):
    """Mismatches of slots between what was said and what is true, most frequent first (AGG-19)."""
    j = judged(spark, sf_dir).where(F.col("quality") == F.col("toxic"))
    return j.groupBy("source", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("said")).agg(F.count(F.lit(1)).alias("n"))


def removals_by_reason(spark, sf_dir):
    """Removed rows by reason and how many records have any (AGG-15, AGG-42)."""
    j = judged(spark, sf_dir)
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("lang") != "en", "other language")))
    return j.select("source", F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("removed"), F.countDistinct("source").alias("records"))


def recall_by_rule(spark, sf_dir):
    """Recall by annotation rule and F1 by half of the text length (AGG-37)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = judged(spark, sf_dir).join(docs, "doc_id")
    half = F.when(F.col("n_chars") <= 1000, "short").otherwise("long")
    return j.groupBy(half.alias("half"), (F.col("doc_id") % 4).alias("rule")).agg(*_numbers())


def runs_by_group(spark, sf_dir):
    """F1 of each record in every run, then the mean of each group of runs (JOIN-24, AGG-38)."""
    j = judged(spark, sf_dir).groupBy("lang", (F.col("doc_id") % 5).alias("run")).agg(*_numbers())
    return j.groupBy("lang").agg(F.count("f1").alias("runs"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_samp("f1"), 6).alias("sd_f1"))


def second_opinion(spark, sf_dir):
    """Found and agreed in k of the repeats of a second reader (AGG-41, FLT-15)."""
    j = judged(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("repeats"), F.sum("said").alias("found"), F.sum("both").alias("exact"))
    ok = (F.col("exact") >= 0) & (F.col("exact") <= F.col("found")) & (F.col("found") <= F.col("repeats"))
    return j.where(ok).select("source", "repeats", "found", "exact", F.when(F.col("found") == 0, "none").when(F.col("exact") == F.col("found"), "all").otherwise("some").alias("agree"))


QUERIES = {f.__name__: f for f in (
    pooled_metrics_by_lang, clustered_wilson_by_lang, clustered_wilson_returnflag, per_class_metrics, per_record_numbers, strata_shares, describes_confusion, describes_accuracy,
    cohen_kappa, label_agreement, holm_adjust, sign_flip_exact, spread_across_repeats, pooled_repeats, paired_bootstrap, difference_verdicts, provenance_groups, found_in_repeats,
    margin_assumptions, numbers_without_twins, multiset_multiplicity, mismatch_frequency, removals_by_reason, recall_by_rule, runs_by_group, second_opinion,
)}

ORACLES = {
    "pooled_metrics_by_lang": f"WITH {JUDGED} SELECT lang, {NUMBERS} FROM j GROUP BY lang",
    "difference_verdicts": f"""WITH r AS ({_wilson_sql(f'''{JUDGED}, p AS (SELECT lang, source, sum("both") AS a, sum("true") AS b FROM j GROUP BY 1, 2)''', "lang")}), g AS (SELECT lang, value - 0.5 AS d, low - 0.5 AS lo, high - 0.5 AS hi FROM r)
      SELECT lang, round(d, 6) AS d, CASE WHEN lo IS NULL THEN 'no range' WHEN lo > 0 THEN 'higher' WHEN hi < 0 THEN 'lower' ELSE 'can''t tell' END AS verdict, CASE WHEN d IS NULL THEN 'no value' ELSE printf('%+.1f points', d * 100) END AS text FROM g""",
    "clustered_wilson_by_lang": _wilson_sql(f"""{JUDGED}, p AS (SELECT lang, source, sum("both") AS a, sum(said) AS b FROM j GROUP BY 1, 2)""", "lang"),
    "clustered_wilson_returnflag": _wilson_sql("p AS (SELECT l_linestatus, l_suppkey, sum((l_returnflag = 'R')::INT) AS a, count(*) AS b FROM lineitem GROUP BY 1, 2)", "l_linestatus"),
    "per_class_metrics": f"""WITH {JUDGED}, x AS (SELECT 'lang' AS kind, lang AS class, said, "true", "both" FROM j UNION ALL SELECT 'source', source, said, "true", "both" FROM j),
      g AS (SELECT kind, class, {NUMBERS} FROM x GROUP BY 1, 2)
      SELECT *, row_number() OVER (PARTITION BY kind ORDER BY extracted + truth - 2 * pairs DESC, class) AS cost_rank FROM g""",
    "per_record_numbers": f"WITH {JUDGED} SELECT source, count(*) AS records, {NUMBERS} FROM j GROUP BY 1",
    "strata_shares": f"""WITH {JUDGED}, p AS (SELECT source, count(*) AS pool FROM documents GROUP BY 1), s AS (SELECT source, count(*) AS sample, {NUMBERS} FROM j GROUP BY 1),
      b AS (SELECT p.source, pool, coalesce(sample, 0) AS sample, f1 FROM p LEFT JOIN s ON s.source = p.source)
      SELECT source, pool, sample, f1, round(pool / sum(pool) OVER (), 6) AS pool_share, round(sample / nullif(sum(sample) OVER (), 0), 6) AS sample_share FROM b""",
    "describes_confusion": "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS row_share FROM labels GROUP BY 1, 2",
    "describes_accuracy": """WITH b AS (SELECT quality AS t, count(*) AS n, sum((quality = 1 - toxic)::INT) AS hit FROM labels GROUP BY 1)
      SELECT round(sum(hit) / sum(n), 6) AS accuracy, round(max(n) / sum(n), 6) AS majority, round(avg(hit / n), 6) AS macro FROM b""",
    "cohen_kappa": """WITH n AS (SELECT quality AS x, 1 - toxic AS y, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n)::BIGINT AS t, sum(CASE WHEN x = y THEN n ELSE 0 END)::BIGINT AS same FROM n),
      e AS (SELECT coalesce(sum(r * c), 0)::BIGINT AS rc FROM (SELECT x, sum(n) AS r FROM n GROUP BY 1) a JOIN (SELECT y, sum(n) AS c FROM n GROUP BY 1) b ON x = y)
      SELECT t, round(same / t, 6) AS p_o, round(rc / (t * t), 6) AS p_e, round((t * same - rc) / nullif(t * t - rc, 0), 6) AS kappa FROM t, e""",
    "label_agreement": """WITH j AS (SELECT quality AS x, 1 - toxic AS y FROM labels), l AS (SELECT x AS label, x = y AS same FROM j UNION ALL SELECT y, x = y FROM j)
      SELECT label, count(*) AS named, round(avg(same::INT), 6) AS agreement FROM l GROUP BY 1""",
    "holm_adjust": """WITH p AS (SELECT c_mktsegment, round(sum((c_acctbal < 0)::INT) / count(*) / 10, 6) AS p FROM customer GROUP BY 1),
      s AS (SELECT *, row_number() OVER (ORDER BY p, c_mktsegment) AS k, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, c_mktsegment) + 1) * p) AS s FROM p)
      SELECT c_mktsegment, p, round(max(s) OVER (ORDER BY k), 6) AS adjusted FROM s""",
    "sign_flip_exact": f"""WITH {JUDGED}, h AS (SELECT source, sum(CASE WHEN doc_id % 2 = 0 THEN "both" ELSE 0 END) AS n0, sum(CASE WHEN doc_id % 2 = 0 THEN said ELSE 0 END) AS d0,
      sum(CASE WHEN doc_id % 2 = 1 THEN "both" ELSE 0 END) AS n1, sum(CASE WHEN doc_id % 2 = 1 THEN said ELSE 0 END) AS d1 FROM j GROUP BY 1),
      t AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS i FROM h), m AS (SELECT unnest(range(1::BIGINT << (SELECT count(*) FROM h)::INTEGER)) AS mask),
      s AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN n1 ELSE n0 END) AS a, sum(CASE WHEN (mask >> i) & 1 = 1 THEN d1 ELSE d0 END) AS b,
      sum(CASE WHEN (mask >> i) & 1 = 1 THEN n0 ELSE n1 END) AS c, sum(CASE WHEN (mask >> i) & 1 = 1 THEN d0 ELSE d1 END) AS d FROM m, t GROUP BY 1),
      f AS (SELECT mask, abs(a * d - c * b) AS x, b * d AS y FROM s), z AS (SELECT x AS x0, y AS y0 FROM f WHERE mask = 0)
      SELECT sum((x * y0 >= x0 * y)::INT)::BIGINT AS as_far, count(*) AS tried, round(sum((x * y0 >= x0 * y)::INT) / count(*), 6) AS p FROM f, z""",
    "spread_across_repeats": """WITH o AS (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
      SELECT o_orderpriority, count(v) AS repeats, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 4) AS mean, round(max(v) - min(v), 4) AS width FROM o GROUP BY 1""",
    "pooled_repeats": """WITH l AS (SELECT l_suppkey, year(l_shipdate) AS run, sum((l_returnflag = 'R')::INT) AS a, count(*) AS b FROM lineitem GROUP BY 1, 2),
      r AS (SELECT l_suppkey, avg(a) AS a, avg(b) AS b, var_samp(a / b) AS w FROM l GROUP BY 1)
      SELECT count(*) AS records, round(sum(a) / sum(b), 6) AS value, round(avg(w), 6) AS within, round(var_samp(a / b), 6) AS "between" FROM r""",
    "provenance_groups": f"""WITH {JUDGED} SELECT {PROVENANCE} AS drafted_by, {NUMBERS}, sum("true" - "both")::BIGINT AS not_found FROM j GROUP BY 1""",
    "found_in_repeats": "WITH e AS (SELECT event_type, user_id, count(DISTINCT dayofweek(ts)) AS k FROM events GROUP BY 1, 2) SELECT event_type, k, count(*) AS facts FROM e GROUP BY 1, 2",
    "margin_assumptions": f"""WITH {JUDGED}, p AS (SELECT source, count(*) AS n FROM j GROUP BY 1)
      SELECT max(n) AS largest, sum(n)::BIGINT AS items, round(max(n) / sum(n), 6) AS largest_share, round(sum(n) / (SELECT count(*) FROM documents), 6) AS catalog_share FROM p""",
    "numbers_without_twins": f"""WITH {JUDGED}, w AS (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents), x AS (SELECT j.*, n FROM j JOIN w USING (doc_id))
      SELECT 'all' AS records, {NUMBERS} FROM x UNION ALL SELECT 'without twins', {NUMBERS} FROM x WHERE n = 1""",
    "multiset_multiplicity": "WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, n, count(*) AS groups FROM g GROUP BY 1, 2",
    "mismatch_frequency": f"WITH {JUDGED} SELECT source, quality AS truth, 1 - toxic AS said, count(*) AS n FROM j WHERE quality = toxic GROUP BY 1, 2, 3",
    "removals_by_reason": f"""WITH {JUDGED}, r AS (SELECT source, 'low quality' AS reason FROM j WHERE quality = 0 UNION ALL SELECT source, 'toxic' FROM j WHERE toxic = 1 UNION ALL SELECT source, 'other language' FROM j WHERE lang <> 'en')
      SELECT reason, count(*) AS removed, count(DISTINCT source) AS records FROM r GROUP BY 1""",
    "recall_by_rule": f"""WITH {JUDGED} SELECT CASE WHEN n_chars <= 1000 THEN 'short' ELSE 'long' END AS half, j.doc_id % 4 AS rule, {NUMBERS} FROM j JOIN documents d ON d.doc_id = j.doc_id GROUP BY 1, 2""",
    "runs_by_group": f"""WITH {JUDGED}, r AS (SELECT lang, doc_id % 5 AS run, {NUMBERS} FROM j GROUP BY 1, 2)
      SELECT lang, count(f1) AS runs, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS sd_f1 FROM r GROUP BY 1""",
    "second_opinion": f"""WITH {JUDGED}, s AS (SELECT source, count(*) AS repeats, sum(said)::BIGINT AS found, sum("both")::BIGINT AS exact FROM j GROUP BY 1)
      SELECT *, CASE WHEN found = 0 THEN 'none' WHEN exact = found THEN 'all' ELSE 'some' END AS agree FROM s WHERE exact <= found AND found <= repeats""",
}
