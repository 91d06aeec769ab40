"""Queries of record selection: deduplication, folds, splits, samples, joins, diffs and censuses."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import relational as R
from factloom.plans.quality import table


def first_copy_dedupe(spark, sf_dir):
    """The first document of each text (SET-02)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return R.first_copy(docs, ["h"], ["doc_id"]).select("doc_id", "lang", "copies")


def best_copy_per_key(spark, sf_dir):
    """The first copy that passed a check, else the first (AGG-05)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower("text"), 256).alias("h"))
    return R.best_copy(docs, ["h"], F.col("source") >= "src5", ["doc_id"]).select("doc_id", "source", "copies")


def spelling_fold(spark, sf_dir):
    """The most frequent spelling of each set of words (AGG-03)."""
    parts = table(spark, sf_dir, "part").select(F.array_join(F.array_sort(F.split(F.lower("p_type"), " ")), " ").alias("key"), F.col("p_type").alias("spelling"))
    return R.spelling_fold(parts, ["key"], "spelling")


def majority_vote_first_named(spark, sf_dir):
    """The role with most turns of a conversation, ties to the one named first (AGG-04)."""
    return R.majority_vote(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"])


def latest_by_key(spark, sf_dir):
    """The latest event type of each user and hour; conflicting equal times are left out (JOIN-15)."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("t"), "event_type")
    return R.latest_by_key(e, ["user_id"], "t", "event_type")


def twin_kinds(spark, sf_dir):
    """Documents that share their whole text, their notes or their title with another (JOIN-04)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.expr("substring(text, instr(text, '\n') + 1)").alias("notes"))
    return R.twin_kinds(docs, "doc_id", "title", "notes")


def anti_join_candidates(spark, sf_dir):
    """Records outside the pool that have text (JOIN-02, FLT-01, FLT-02)."""
    docs = table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def pool_join_unmatched(spark, sf_dir):
    """Pool rows with and without their record (JOIN-01)."""
    pool = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pool.join(docs, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def stratum_lookup(spark, sf_dir):
    """The stratum of each record, small ones in one bucket (JOIN-05)."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, sf_dir, "nation").join(n.where("n >= 55"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_nationkey", F.col("n_name").alias("stratum"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(names), "c_nationkey", "left")  # one row a nation
    return c.groupBy(F.coalesce("stratum", F.lit("(small)")).alias("stratum")).agg(F.count(F.lit(1)).alias("records"))


def pool_split_parts(spark, sf_dir):
    """The place of each record in the pool and its part (WIN-01)."""
    pool = R.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return pool.select("doc_id", "position", R.pool_part(F.col("position")).alias("part"))


def rank_maintainers(spark, sf_dir):
    """Suppliers by number of items (WIN-02)."""
    return R.rank_groups(table(spark, sf_dir, "lineitem"), "l_suppkey").select("l_suppkey", "rows", F.col("rank").cast("long").alias("rank"))


def hash_rank_sample(spark, sf_dir):
    """The 50 documents with the smallest hashes (WIN-07)."""
    return R.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 50, "7", "doc_id")


def stratified_hash_sample(spark, sf_dir):
    """5 documents of each source by hash (WIN-06)."""
    out = R.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, "7", "doc_id")
    return out.select("doc_id", "source", F.col("place").cast("long").alias("place"))


def seeded_group_order(spark, sf_dir):
    """The whole seeded order of each language; every prefix is a sample (WIN-03)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("h", R.hash_order("3", "lang", "doc_id"))
    return R.numbered_by_group(docs, "lang", "h", "doc_id").select("doc_id", "lang", (F.col("position") + 1).alias("place"))


def largest_remainder_allocation(spark, sf_dir):
    """100 places over the sources (WIN-05)."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return R.largest_remainder(n, "source", "size", 100)


def fair_prefix(spark, sf_dir):
    """Documents before the first unlabelled one of their language (FLT-10)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    taken = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("ok"))
    both = docs.join(taken, "doc_id", "left").withColumn("ok", F.col("ok") | (F.col("doc_id") % 7 != 0))
    return R.fair_prefix(both, "lang", "doc_id", F.col("ok")).select("doc_id", "lang")


def keyed_diff(spark, sf_dir):
    """Changes between two versions of the orders (SET-05)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where(F.col("o_orderkey") % 11 != 0).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    old = o.where(F.col("o_orderkey") % 13 != 0)
    return R.keyed_diff(old, new, ["o_orderkey"])


def common_records_of_runs(spark, sf_dir):
    """Suppliers that every year has (JOIN-21)."""
    li = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("run"), F.col("l_suppkey").alias("record"), F.lit("same").alias("fp"))
    return R.common_records(li, "run", "record", "fp")


def top_n_by_criterion(spark, sf_dir):
    """The first ten suppliers by each of three criteria (WIN-08)."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.countDistinct("l_partkey").alias("parts"))
    out = [R.top_n(s, 10, F.desc(c), "l_suppkey").select(F.lit(c).alias("criterion"), "l_suppkey", F.col(c).cast("double").alias("value")) for c in ("items", "quantity", "parts")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def first_n_more(spark, sf_dir):
    """The first three suppliers of each part type and how many more (WIN-09)."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey").distinct()
    by = Window.partitionBy("p_brand").orderBy("l_suppkey")
    n = d.withColumn("k", F.row_number().over(by)).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("l_suppkey")))).alias("first"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return n.select("p_brand", F.concat(F.array_join(F.transform("first", lambda x: x.cast("string")), ", "), more).alias("listing"))


def next_records(spark, sf_dir):
    """The next 20 records of the pool that are not labelled, from position 30 (WIN-10)."""
    pool = R.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").where("position >= 30")
    return pool.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("position").limit(20)


def run_order(spark, sf_dir):
    """Runs in the order of the time and suffix in their names (WIN-12)."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), (F.col("o_orderkey") % 4).cast("string")).alias("run")).distinct()
    by = Window.partitionBy(F.lit(0)).orderBy(F.regexp_extract("run", r"^(\d+)", 1), F.regexp_extract("run", r"-(\d+)$", 1).cast("int"))
    return o.select("run", F.row_number().over(by).cast("long").alias("turn"))


def content_rank(spark, sf_dir):
    """A rank of equal rows that only their content decides (WIN-11)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.sha2(F.concat_ws("|", "p_name", "p_brand", F.col("p_partkey").cast("string")), 256).alias("h"))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("h")).cast("long").alias("turn"))


def connected_components(spark, sf_dir):
    """Components of the graph of nations that suppliers and customers share by key (SET-08)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.lit(10_000_000) + F.col("c_custkey") % 50).cast("long").alias("b"))
    s = table(spark, sf_dir, "supplier").select((F.lit(20_000_000) + F.col("s_suppkey")).alias("a"), (F.lit(10_000_000) + F.col("s_nationkey")).cast("long").alias("b"))
    return G.connected_components(c.union(s))


def merge_chain_resolve(spark, sf_dir):
    """Merges followed to their end: each part size into the one half as large (SET-09)."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("old")).distinct().where("old > 1")
    return G.resolve_chains(sizes.select("old", F.floor(F.col("old") / 2).cast("int").alias("new")))


def lineage_walk(spark, sf_dir):
    """Everything that all orders come from: order, customer, nation, region (JOIN-20)."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o#"), "o_orderkey").alias("child"), F.concat(F.lit("c#"), "o_custkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c#"), "c_custkey"), F.concat(F.lit("n#"), "c_nationkey"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n#"), "n_nationkey"), F.concat(F.lit("r#"), "n_regionkey"))
    edges = o.union(c).union(n)
    start = o.select(F.col("child").alias("node"))
    return G.walk(edges, start)


def set_algebra(spark, sf_dir):
    """Ids in both, in one and in either of two lists (SET-04)."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    counted = [(n, x.agg(F.count(F.lit(1)).alias("n"))) for n, x in (("both", a.intersect(b)), ("first only", a.exceptAll(b)), ("second only", b.exceptAll(a)), ("either", a.union(b).distinct()))]
    out = [x.select(F.lit(n).alias("set"), "n") for n, x in counted]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def batches_union(spark, sf_dir):
    """Batches of several files as one relation, first copy of an id wins (SET-01, SET-02)."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("first").alias("batch"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("second").alias("batch"))
    both = a.unionByName(b)
    return R.first_copy(both, ["id"], ["batch"]).select("id", "batch", "copies")


def census_fill_rate(spark, sf_dir):
    """Fill rate, distinct values and length of every column of the documents (AGG-32)."""
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source", F.col("doc_id").cast("string").alias("doc_id"))
    long = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in docs.columns))).alias("x")).select("x.*")
    filled = F.coalesce(F.trim("v"), F.lit("")) != ""
    return long.groupBy("field").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(filled, 1)).alias("filled"), F.round(F.avg(filled.cast("double")), 6).alias("rate"),
        F.count_distinct(F.when(filled, F.sha2("v", 256))).alias("values"), F.min(F.length("v")).cast("long").alias("shortest"), F.max(F.length("v")).cast("long").alias("longest"),
    )


def top_values(spark, sf_dir):
    """The five most common values of each field (AGG-32, WIN-14)."""
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("v")), F.struct(F.lit("source").alias("field"), F.col("source").alias("v")))).alias("x")).select("x.*")
    n = docs.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "v")).cast("long")).where("rank <= 5")


def completeness_check(spark, sf_dir):
    """Rows, ids, missing and repeated ids, first and last date (SRC-04)."""
    o = table(spark, sf_dir, "orders")
    return o.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("ids"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"),
        (F.count("o_orderkey") - F.countDistinct("o_orderkey")).alias("repeated"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"),
    )


def funnel_removed_by_check(spark, sf_dir):
    """How many rows each check removes, in order, and which sources it empties (AGG-30)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    d = docs.join(first, "h").join(labelled, "doc_id", "left")
    check = F.when(F.col("n") == 0, "1 empty").when(F.col("n") < 300, "2 short").when(F.col("doc_id") != F.col("first"), "3 copy").when(F.col("l").isNull(), "4 unlabelled").otherwise("kept")
    return d.groupBy(check.alias("check")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"))


def discard_ledger_balance(spark, sf_dir):
    """In = kept + discarded, by stage (OPS-01, OPS-02)."""
    f = funnel_removed_by_check(spark, sf_dir)
    total = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("came"))
    return f.agg(F.sum(F.when(F.col("check") == "kept", F.col("rows")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("check") != "kept", F.col("rows")).otherwise(0)).alias("discarded")).crossJoin(F.broadcast(total)).withColumn(
        "balanced", F.col("came") == F.col("kept") + F.col("discarded")
    )


def per_text_stats(spark, sf_dir):
    """Words of the texts of each language: count, least, most, mean, median, deviation, total, none (AGG-29, AGG-39)."""
    n = table(spark, sf_dir, "documents").select("lang", F.regexp_count("text", F.lit(r"[^ \n\t\r]+")).cast("long").alias("n"))
    return n.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n"), 6).alias("middle"),
        F.round(F.stddev_samp("n"), 6).alias("deviation"), F.sum("n").alias("total"), F.count_if(F.col("n") == 0).alias("none"),
    )


def cost_by_period(spark, sf_dir):
    """Items priced by the period that holds their date (AGG-35)."""
    periods = spark.createDataFrame([("1992-01-01", "1994-12-31", 0.5), ("1995-01-01", "1996-12-31", 0.75), ("1997-01-01", "2100-01-01", 1.25)], "since string, until string, price double")
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    priced = li.join(F.broadcast(periods), F.col("day").between(F.col("since"), F.col("until")))  # three rows
    return priced.groupBy("l_returnflag", "since").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(F.col("l_quantity") * F.col("price")), 2).alias("cost"))


def usage_by_model(spark, sf_dir):
    """Totals and rates per record by step and kind (AGG-36)."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("records"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum("value") / F.countDistinct("user_id"), 4).alias("per_record"))


def price_book_pivot(spark, sf_dir):
    """Prices by tier and kind as columns (PRJ-14)."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 2))
    return o.select("o_orderpriority", *(F.col(c).alias(f"price_{c.lower()}") for c in ("F", "O", "P")))


def flatten_leaves(spark, sf_dir):
    """Path and value of the leaves of nested rows (PRJ-07)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = F.array(F.struct(F.lit("nation.name").alias("path"), F.col("n_name").alias("value")), F.struct(F.lit("nation.region.name").alias("path"), F.col("r_name").alias("value")))
    return n.select("n_nationkey", F.explode(leaves).alias("x")).select("n_nationkey", "x.path", "x.value")


def content_fingerprint(spark, sf_dir):
    """sha256 of each row's canonical text (SCA-31)."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.sha2(F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment"), 256).alias("fingerprint"))


def json_shape_check(spark, sf_dir):
    """Whether each JSON answer has the needed shape (SCA-36)."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_parse_json("props").alias("v"))
    shape = F.when(F.col("v").isNull(), "invalid").when(F.schema_of_variant("v").startswith("OBJECT"), "object").otherwise("other")
    return e.groupBy("event_type", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def iso_time_order(spark, sf_dir):
    """Times of events written with Z, an offset, neither, or as a date, read as UTC (SCA-32)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    turn = F.col("event_id") % 4
    ahead = F.col("ts") + F.expr("interval 2 hours")
    written = F.when(turn == 0, F.concat(at("ts"), F.lit("Z"))).when(turn == 1, F.concat(at(ahead), F.lit("+02:00"))).when(turn == 2, at("ts")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", written.alias("written")).select("event_id", "written", F.date_format(F.to_timestamp("written"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def duration_money_text(spark, sf_dir):
    """Durations and money as text (SCA-33)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 100000).alias("s"), F.round("o_totalprice", 2).alias("m"))
    text = F.when(F.col("s") < 60, F.format_string("%d s", "s")).when(F.col("s") < 3600, F.format_string("%d min %d s", F.floor(F.col("s") / 60), F.col("s") % 60)).otherwise(F.format_string("%d h %d min", F.floor(F.col("s") / 3600), F.floor(F.col("s") % 3600 / 60)))
    return o.select("o_orderkey", text.alias("duration"))


def _ok(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def document_text(spark, sf_dir):
    """Named non-empty fields as one text (PRJ-03), fingerprinted."""
    docs = table(spark, sf_dir, "documents")
    block = [F.when(_ok(c), F.concat(F.lit(f"{c}: "), F.trim(c))) for c in ("lang", "source", "text")]
    return docs.select("doc_id", F.sha2(F.concat_ws("\n\n", *block), 256).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (
    first_copy_dedupe, best_copy_per_key, spelling_fold, majority_vote_first_named, latest_by_key, twin_kinds, anti_join_candidates, pool_join_unmatched, stratum_lookup, pool_split_parts,
    rank_maintainers, hash_rank_sample, stratified_hash_sample, seeded_group_order, largest_remainder_allocation, fair_prefix, keyed_diff, common_records_of_runs, top_n_by_criterion, first_n_more,
    next_records, run_order, content_rank, connected_components, merge_chain_resolve, lineage_walk, set_algebra, batches_union, census_fill_rate, top_values, completeness_check,
    funnel_removed_by_check, discard_ledger_balance, per_text_stats, cost_by_period, usage_by_model, price_book_pivot, flatten_leaves, content_fingerprint, json_shape_check, iso_time_order,
    duration_money_text, document_text,
)}

_FUNNEL = """d AS (SELECT doc_id, source, length(text) AS n, min(doc_id) OVER (PARTITION BY text) AS f FROM documents),
  c AS (SELECT d.source, CASE WHEN n = 0 THEN '1 empty' WHEN n < 300 THEN '2 short' WHEN d.doc_id <> f THEN '3 copy' WHEN l.doc_id IS NULL THEN '4 unlabelled' ELSE 'kept' END AS "check"
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  g AS (SELECT "check", count(*) AS rows, count(DISTINCT source) AS sources FROM c GROUP BY 1)"""

ORACLES = {
    "first_copy_dedupe": "SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies FROM documents GROUP BY text",
    "best_copy_per_key": "SELECT doc_id, source, copies FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY source < 'src5', doc_id) AS k, count(*) OVER (PARTITION BY lower(text)) AS copies FROM documents) WHERE k = 1",
    "spelling_fold": """WITH n AS (SELECT array_to_string(list_sort(string_split(lower(p_type), ' ')), ' ') AS key, p_type AS spelling, count(*) AS n FROM part GROUP BY 1, 2)
      SELECT key, first(spelling ORDER BY n DESC, spelling) AS spelling, count(*) AS spellings, sum(n)::BIGINT AS rows FROM n GROUP BY 1""",
    "majority_vote_first_named": """WITH n AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2)
      SELECT conv_id, first(role ORDER BY n DESC, f) AS role, count(*) > 1 AS disagree FROM n GROUP BY 1""",
    "latest_by_key": """WITH e AS (SELECT user_id, date_trunc('hour', ts) AS t, event_type FROM events), m AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS m FROM e)
      SELECT user_id, t, min(event_type) AS event_type FROM m WHERE t = m GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1 AND trim(min(event_type)) <> ''""",
    "twin_kinds": r"""WITH s AS (SELECT doc_id, split_part(text, chr(10), 1) AS t, substring(text, instr(text, chr(10)) + 1) AS n FROM documents),
      c AS (SELECT *, count(*) OVER (PARTITION BY t, n) AS w, count(*) OVER (PARTITION BY n) AS cn, count(*) OVER (PARTITION BY t) AS ct FROM s),
      k AS (SELECT doc_id, CASE WHEN trim(t) <> '' AND trim(n) <> '' AND w > 1 THEN 'whole text' WHEN trim(n) <> '' AND cn > 1 THEN 'notes only' WHEN trim(t) <> '' AND ct > 1 THEN 'title only' END AS kind FROM c)
      SELECT * FROM k WHERE kind IS NOT NULL""",
    "anti_join_candidates": "SELECT doc_id, lang, source FROM documents d WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "pool_join_unmatched": "SELECT d.source, count(*) AS n FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2 GROUP BY 1",
    "stratum_lookup": """WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
      SELECT CASE WHEN n.n >= 55 THEN n_name ELSE '(small)' END AS stratum, count(*) AS records FROM customer c JOIN n USING (c_nationkey) JOIN nation ON n_nationkey = c.c_nationkey GROUP BY 1""",
    "pool_split_parts": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
      SELECT *, CASE WHEN position >= 6 AND (position - 6) % 3 = 2 THEN 'held-out' ELSE 'tuning' END AS part FROM p""",
    "rank_maintainers": "SELECT l_suppkey, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1",
    "hash_rank_sample": "SELECT doc_id, source, sha256('7|' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 50",
    "stratified_hash_sample": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || doc_id), doc_id) AS place FROM documents QUALIFY place <= 5",
    "seeded_group_order": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3|' || lang || '|' || doc_id), doc_id) AS place FROM documents",
    "largest_remainder_allocation": """WITH n AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT *, size * 100 // (sum(size) OVER ())::BIGINT AS w, size * 100 % (sum(size) OVER ())::BIGINT AS m FROM n),
      r AS (SELECT *, row_number() OVER (ORDER BY m DESC, source) AS k, 100 - sum(w) OVER () AS rest FROM q) SELECT source, size, (w + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS places FROM r""",
    "fair_prefix": """WITH d AS (SELECT d.doc_id, lang, coalesce((l.doc_id IS NOT NULL), false) AND true AS has FROM documents d LEFT JOIN labels l USING (doc_id)),
      t AS (SELECT doc_id, lang, CASE WHEN has THEN true ELSE doc_id % 7 <> 0 END AS ok FROM d), g AS (SELECT lang, min(doc_id) FILTER (NOT ok) AS gap FROM t GROUP BY 1)
      SELECT doc_id, t.lang FROM t JOIN g USING (lang) WHERE gap IS NULL OR doc_id < gap""",
    "keyed_diff": """WITH a AS (SELECT o_orderkey, o_orderstatus s, o_orderpriority p FROM orders WHERE o_orderkey % 13 <> 0),
      b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END s, o_orderpriority p FROM orders WHERE o_orderkey % 11 <> 0),
      j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p THEN 'changed' END AS change
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) SELECT * FROM j WHERE change IS NOT NULL""",
    "common_records_of_runs": "SELECT l_suppkey AS record FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate)) = (SELECT count(DISTINCT year(l_shipdate)) FROM lineitem)",
    "top_n_by_criterion": """WITH s AS (SELECT l_suppkey, count(*) AS items, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
      (SELECT 'items' AS criterion, l_suppkey, items::DOUBLE AS value FROM s ORDER BY items DESC, l_suppkey LIMIT 10) UNION ALL
      (SELECT 'quantity', l_suppkey, quantity FROM s ORDER BY quantity DESC, l_suppkey LIMIT 10) UNION ALL (SELECT 'parts', l_suppkey, parts::DOUBLE FROM s ORDER BY parts DESC, l_suppkey LIMIT 10)""",
    "first_n_more": """WITH d AS (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY l_suppkey) AS k FROM d)
      SELECT p_brand, string_agg(l_suppkey::VARCHAR, ', ' ORDER BY l_suppkey) FILTER (k <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS listing FROM k GROUP BY 1""",
    "next_records": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
      SELECT doc_id, position FROM p WHERE position >= 30 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id) ORDER BY position LIMIT 20""",
    "run_order": """WITH r AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') || '-' || (o_orderkey % 4) AS run FROM orders)
      SELECT run, row_number() OVER (ORDER BY split_part(run, '-', 1), split_part(run, '-', 2)::INT) AS turn FROM r""",
    "content_rank": "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY sha256(p_name || '|' || p_brand || '|' || p_partkey)) AS turn FROM part",
    "connected_components": """WITH RECURSIVE e AS (SELECT c_custkey AS a, 10000000 + c_custkey % 50 AS b FROM customer UNION SELECT 20000000 + s_suppkey, 10000000 + s_nationkey FROM supplier),
      f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, m) AS (SELECT a, a FROM f UNION SELECT f.b, least(r.m, f.b) FROM r JOIN f ON f.a = r.x)
      SELECT x AS node, min(m) AS component FROM r GROUP BY 1""",
    "merge_chain_resolve": """WITH RECURSIVE s AS (SELECT DISTINCT p_size AS old, (p_size // 2)::INTEGER AS new FROM part WHERE p_size > 1),
      r(old, new) AS (SELECT old, new FROM s UNION ALL SELECT r.old, s.new FROM r JOIN s ON s.old = r.new) SELECT old, min(new)::INTEGER AS new FROM r GROUP BY 1""",
    "lineage_walk": """WITH RECURSIVE e AS (SELECT 'o#' || o_orderkey AS child, 'c#' || o_custkey AS parent FROM orders UNION ALL SELECT 'c#' || c_custkey, 'n#' || c_nationkey FROM customer UNION ALL SELECT 'n#' || n_nationkey, 'r#' || n_regionkey FROM nation),
      r(node, depth) AS (SELECT 'o#' || o_orderkey, 0 FROM orders UNION SELECT e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.node) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""",
    "set_algebra": """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
      SELECT 'both' AS "set", count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first only', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'second only', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b)""",
    "batches_union": "WITH u AS (SELECT c_custkey AS id, 'first' AS batch FROM customer UNION ALL SELECT s_suppkey, 'second' FROM supplier) SELECT id, min(batch) AS batch, count(*) AS copies FROM u GROUP BY 1",
    "census_fill_rate": """WITH l AS (SELECT 'text' AS field, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'doc_id', doc_id::VARCHAR FROM documents),
      f AS (SELECT *, coalesce(trim(v), '') <> '' AS ok FROM l)
      SELECT field, count(*) AS rows, count(*) FILTER (ok) AS filled, round(avg(ok::INT), 6) AS rate, count(DISTINCT v) FILTER (ok) AS "values", min(length(v)) AS shortest, max(length(v)) AS longest FROM f GROUP BY 1""",
    "top_values": """WITH l AS (SELECT 'lang' AS field, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents)
      SELECT field, v, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, v) AS rank FROM l GROUP BY 1, 2 QUALIFY rank <= 5""",
    "completeness_check": """SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS ids, count(*) - count(o_orderkey) AS missing, count(o_orderkey) - count(DISTINCT o_orderkey) AS repeated,
      strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders""",
    "funnel_removed_by_check": f"WITH {_FUNNEL} SELECT * FROM g",
    "discard_ledger_balance": f"""WITH {_FUNNEL} SELECT sum(CASE WHEN "check" = 'kept' THEN rows ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN "check" <> 'kept' THEN rows ELSE 0 END)::BIGINT AS discarded,
      (SELECT count(*) FROM documents) AS came, sum(rows) = (SELECT count(*) FROM documents) AS balanced FROM g""",
    "per_text_stats": r"""WITH n AS (SELECT lang, len(regexp_extract_all(text, '[^ \n\t\r]+')) AS n FROM documents)
      SELECT lang, count(*) AS texts, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(median(n), 6) AS middle, round(stddev_samp(n), 6) AS deviation, sum(n)::BIGINT AS total, count(*) FILTER (n = 0) AS none FROM n GROUP BY 1""",
    "cost_by_period": """WITH p(since, until, price) AS (VALUES ('1992-01-01', '1994-12-31', 0.5::DOUBLE), ('1995-01-01', '1996-12-31', 0.75), ('1997-01-01', '2100-01-01', 1.25))
      SELECT l_returnflag, since, count(*) AS items, round(sum(l_quantity * price), 2) AS cost FROM lineitem JOIN p ON strftime(l_shipdate, '%Y-%m-%d') BETWEEN since AND until GROUP BY 1, 2""",
    "usage_by_model": "SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS records, round(sum(value), 2) AS total, round(sum(value) / count(DISTINCT user_id), 4) AS per_record FROM events GROUP BY 1",
    "price_book_pivot": """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS price_f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS price_o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS price_p FROM orders GROUP BY 1""",
    "flatten_leaves": """SELECT n_nationkey, 'nation.name' AS path, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'nation.region.name', r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "content_fingerprint": "SELECT c_custkey, sha256(c_name || '|' || c_nationkey || '|' || c_mktsegment) AS fingerprint FROM customer",
    "json_shape_check": """SELECT event_type, CASE WHEN NOT json_valid(props) THEN 'invalid' WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END AS shape, count(*) AS n FROM events GROUP BY 1, 2""",
    "iso_time_order": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS written,
      CASE event_id % 4 WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc FROM events""",
    "duration_money_text": """WITH o AS (SELECT o_orderkey, o_orderkey * 37 % 100000 AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min ' || (s % 60) || ' s' ELSE (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' END AS duration FROM o""",
    "document_text": r"""SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(coalesce(lang, '')) <> '' THEN 'lang: ' || trim(lang) END, CASE WHEN trim(coalesce(source, '')) <> '' THEN 'source: ' || trim(source) END, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'text: ' || trim(text) END)) AS fingerprint FROM documents""",
}
