"""Queries of the greedy rules: draws in turn, caps, ordered acceptance, merging again, halved requests, labels with a running vocabulary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.operators import greedy as G
from factloom.plans.quality import table
from factloom.sources.sinks import shared_folder
from factloom.streaming import labels as L


def round_robin_draw(spark, sf_dir):
    """30 documents of each source in turn, texts with the same words or the same words below the first line only once (WIN-04)."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).where("source is not null")
    docs = docs.select("doc_id", "source", words(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), words(F.substring_index("text", "\n", -1)).alias("notes"))
    keys = [F.concat_ws("|", "title", "notes"), F.nullif("notes", F.lit(""))]
    return G.draw_in_turn(docs, "source", ["doc_id"], keys, 30).select("doc_id", "source", "turn")


def greedy_cap(spark, sf_dir):
    """Parts of each brand, dear ones first, as many as fit a size of 300 together; smaller ones may fit where one did not (WIN-13)."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    caps = p.select("p_brand").distinct().withColumn("cap", F.lit(300))
    return G.fill(p, "p_brand", [F.desc("p_retailprice"), "p_partkey"], "p_size", caps).select("p_brand", "p_partkey", "p_size")


def split_acceptance(spark, sf_dir):
    """New names that customers' orders propose for pairs of priority and clerk, accepted in the order of customers unless name or a pair is taken (SCA-40)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    pair = F.struct(F.col("o_orderpriority").alias("s"), F.concat(F.lit("clerk"), (F.col("o_orderkey") % 50).cast("string")).alias("o"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(pair)).alias("pairs"), F.count(F.lit(1)).alias("texts"))
    k = F.col("c_custkey")
    name = F.when(k % 19 == 0, " ").when(k % 13 == 0, F.concat(F.lit("n"), k.cast("string"))).when(k % 31 == 0, "MACHINERY").otherwise(F.concat_ws("_", F.lit("N"), F.col("c_nationkey").cast("string"), (k % 40).cast("string")))
    pairs = F.when(k % 29 == 0, F.concat("pairs", F.slice("pairs", 1, 1))).otherwise(F.col("pairs"))
    replies = c.join(o, k == F.col("o_custkey"), "left").select(
        k.alias("line"), F.when(k % 17 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("predicate"), name.alias("name"), pairs.alias("pairs"), "texts", (k % 23 == 0).alias("all_pairs")
    )
    classes = table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderpriority", F.concat(F.lit("clerk"), (F.col("o_orderkey") % 50).cast("string")))).alias("class")).where("class <> 'clerk7'")
    out = G.check_splits(replies, classes, c.select(F.col("c_mktsegment").alias("predicate")), least_texts=2)
    return out.select("line", "name", "reason")


def merged_again_parts(spark, sf_dir):
    """Nations as parts of order priorities, merged while they share one of their two strongest clerks (SET-10)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    pins = o.groupBy(F.col("o_orderpriority").alias("predicate"), F.format_string("%02d", "c_nationkey").alias("part"), F.format_string("%03d", F.col("o_orderkey") % 400).alias("pin")).agg(F.floor(F.sum("o_totalprice")).alias("weight"))
    into, _ = G.merge_again(pins.select("predicate", "part"), pins)
    return into


def _shout(prompts: list[str]) -> list[str]:
    """The stand-in for a service that refuses what ends in 5."""
    if any(p.endswith("5") for p in prompts):
        raise PermissionError("refused")
    return [p.upper() for p in prompts]


def halved_requests(spark, sf_dir):
    """Customers in requests of 64, those refused asked again in halves down to single ones (OPS-04)."""
    c = table(spark, sf_dir, "customer")
    items = c.select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 64).cast("string").alias("batch"), F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 37).cast("string")).alias("prompt"))
    return G.ask_in_halves(items, _shout, lambda e: isinstance(e, PermissionError)).select("id", "reply", "refused")


def _like_before(names: list[str], used: list[str]) -> dict[str, str | None]:
    """The stand-in for a labeler: the first label used that ends alike, else the name itself."""
    return {n: next((u for u in used if u[-1] == n[-1]), n) for n in names}


def running_labels(spark, sf_dir):
    """Customers labelled as they arrive in four files, five of a nation at a time, each with the nation's labels so far (OPS-05)."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    names = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("group"), F.col("c_custkey").alias("turn"), F.col("c_name").alias("name"))
    end = names.agg(F.max("turn")).head()[0] or 0
    for i in range(4):
        part = names.where((F.col("turn") >= i * (end // 4 + 1)) & (F.col("turn") < (i + 1) * (end // 4 + 1)))
        part.coalesce(1).write.mode("append").parquet(f"{path}/names")  # a file an arrival
    L.start(L.name_files(spark, f"{path}/names"), _like_before, f"{path}/labels", f"{path}/state", batch=5).awaitTermination()
    return spark.read.schema("group string, name string, label string").parquet(f"{path}/labels").select(F.col("group").cast("int").alias("nation"), "name", "label")


QUERIES = {f.__name__: f for f in (round_robin_draw, greedy_cap, split_acceptance, merged_again_parts, halved_requests, running_labels)}

ORACLES = {
    "round_robin_draw": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, trim(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS title,
    trim(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[-1]), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS notes FROM documents WHERE source IS NOT NULL
), t AS (
  SELECT dense_rank() OVER (ORDER BY source) AS g, {'id': doc_id, 'pos': row_number() OVER (PARTITION BY source ORDER BY doc_id), 'w': md5('w' || title || '|' || notes), 'n': CASE WHEN notes <> '' THEN md5('n' || notes) END} AS x FROM d
), q AS (SELECT list(xs ORDER BY g) AS qs, count(*) AS n FROM (SELECT g, list(x ORDER BY x.pos) AS xs FROM t GROUP BY g)),
r AS (
  SELECT 0::BIGINT AS step, list_transform(range(n), lambda i: 0::BIGINT) AS last, []::VARCHAR[] AS seen, NULL::BIGINT AS id, NULL::BIGINT AS turn FROM q
  UNION ALL
  SELECT step + 1, CASE WHEN x IS NULL THEN last ELSE list_transform(last, lambda v, i: CASE WHEN i = g THEN x.pos ELSE v END) END,
    CASE WHEN x IS NULL THEN seen ELSE list_concat(seen, list_filter([x.w, x.n], lambda v: v IS NOT NULL)) END, x.id, (step // n)::BIGINT
  FROM (SELECT r.step, r.last, r.seen, q.n, (r.step % q.n + 1) AS g, list_filter(q.qs[r.step % q.n + 1], lambda y: y.pos > r.last[r.step % q.n + 1] AND NOT list_contains(r.seen, y.w) AND (y.n IS NULL OR NOT list_contains(r.seen, y.n)))[1] AS x FROM r, q WHERE r.step < 30 * q.n)
)
SELECT r.id AS doc_id, d.source, turn FROM r JOIN d ON d.doc_id = r.id WHERE r.id IS NOT NULL""",
    "greedy_cap": """
WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
r AS (
  SELECT p_brand, p_partkey, p_size, k, CASE WHEN p_size <= 300 THEN 300 - p_size ELSE 300 END AS rest, p_size <= 300 AS kept FROM p WHERE k = 1
  UNION ALL SELECT p.p_brand, p.p_partkey, p.p_size, p.k, CASE WHEN p.p_size <= rest THEN rest - p.p_size ELSE rest END, p.p_size <= rest FROM r JOIN p ON p.p_brand = r.p_brand AND p.k = r.k + 1
)
SELECT p_brand, p_partkey, p_size FROM r WHERE kept""",
    "split_acceptance": """
WITH RECURSIVE o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority || '>clerk' || (o_orderkey % 50))) AS ps, count(*) AS texts FROM orders GROUP BY 1),
p AS (
  SELECT c_custkey AS line, CASE WHEN c_custkey % 17 = 0 THEN 'OTHER' ELSE c_mktsegment END AS predicate, coalesce(texts, 0) AS texts, c_custkey % 23 = 0 AS whole,
    CASE WHEN c_custkey % 19 = 0 THEN ' ' WHEN c_custkey % 13 = 0 THEN 'n' || c_custkey WHEN c_custkey % 31 = 0 THEN 'MACHINERY' ELSE 'N_' || c_nationkey || '_' || (c_custkey % 40) END AS name,
    coalesce(CASE WHEN c_custkey % 29 = 0 THEN list_concat(ps, ps[1:1]) ELSE ps END, []) AS ps
  FROM customer LEFT JOIN o ON o_custkey = c_custkey
), s AS (
  SELECT *, list_transform(ps, lambda x: predicate || '>' || x) AS keys, CASE WHEN trim(name) = '' THEN 'no name' WHEN name <> upper(name) THEN 'name not in capitals' WHEN predicate = 'OTHER' THEN 'unknown predicate'
    WHEN name = predicate THEN 'same name' WHEN name IN (SELECT c_mktsegment FROM customer) THEN 'name taken' END AS one,
    CASE WHEN len(ps) = 0 THEN 'no pairs' WHEN len(list_distinct(ps)) < len(ps) THEN 'pair repeated' WHEN len(list_filter(ps, lambda x: x LIKE '%>clerk7')) > 0 THEN 'unknown class' END AS two,
    CASE WHEN texts < 2 THEN 'too few texts' WHEN whole THEN 'nothing left of the predicate' END AS three FROM p
), a AS (SELECT *, row_number() OVER (ORDER BY line) AS k FROM s WHERE one IS NULL AND two IS NULL AND three IS NULL),
r AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS line, []::VARCHAR[] AS names, []::VARCHAR[] AS taken, false AS ok
  UNION ALL
  SELECT k, line, CASE WHEN good THEN list_append(names, name) ELSE names END, CASE WHEN good THEN list_concat(taken, keys) ELSE taken END, good
  FROM (SELECT a.k, a.line, a.name, a.keys, r.names, r.taken, NOT list_contains(r.names, a.name) AND NOT list_has_any(r.taken, a.keys) AS good FROM r JOIN a ON a.k = r.k + 1)
), w AS (SELECT a.line, a.name, a.keys FROM r JOIN a USING (k) WHERE r.ok),
wn AS (SELECT name, line FROM w), wp AS (SELECT unnest(keys) AS key, line FROM w),
lp AS (SELECT DISTINCT s.line FROM (SELECT line, unnest(keys) AS key FROM s) s JOIN wp ON wp.key = s.key AND wp.line < s.line)
SELECT s.line, s.name, coalesce(s.one, CASE WHEN wn.line < s.line THEN 'name taken' END, s.two, CASE WHEN lp.line IS NOT NULL THEN 'pair taken' END, s.three) AS reason
FROM s LEFT JOIN wn ON wn.name = s.name LEFT JOIN lp ON lp.line = s.line""",
    "halved_requests": """
SELECT c_custkey AS id, CASE WHEN (c_custkey % 37)::VARCHAR NOT LIKE '%5' THEN c_mktsegment || ' ' || (c_custkey % 37) END AS reply, (c_custkey % 37)::VARCHAR LIKE '%5' AS refused FROM customer""",
    "running_labels": """
WITH n AS (SELECT c_nationkey AS nation, c_name AS name, right(c_name, 1) AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer),
f AS (SELECT nation, x, arg_min(name, place) AS label, min(place) AS first FROM n GROUP BY 1, 2)
SELECT n.nation, n.name, CASE WHEN f.first < n.place // 5 * 5 THEN f.label ELSE n.name END AS label FROM n JOIN f ON f.nation = n.nation AND f.x = n.x""",
}
