"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination as leaks
from factloom.llm import fill_middle as middle
from factloom.llm import language_id as language
from factloom.llm import resampling
from factloom.llm.hnsw_dedup import hnsw_dedup
from factloom.llm.license_scan import license_scan
from factloom.llm.line_dedup import line_dedup
from factloom.llm.mixing import Setting as Mix
from factloom.llm.mixing import mix, n_words
from factloom.llm.ngram_join import ngram_jaccard_join
from factloom.llm.packing import pack
from factloom.llm.suffix_dedup import remove_repeats
from factloom.llm.token_counts import token_counts
from factloom.llm.topk_search import topk_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have similarity 0.8 or more."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and the licenses named in every document."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the bytes of 400-byte strings that start elsewhere too; text: what remains, cut characters as U+FFFD."""
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of sequences in the length buckets with the least padding."""
    return pack(_table(spark, sf_dir, "documents"))


#: Domains 3 : 2 : 1, twice as much English as any other language, sources alike.
MIX = Mix(weights={"domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 1.0}, "lang": {"en": 2.0}}, share=0.6, max_epochs=2)


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source within its budget, once for each epoch."""
    out = mix(_table(spark, sf_dir, "documents"), MIX)
    return out.select("doc_id", "lang", "source", F.col("_epoch").alias("epoch"), n_words("text").cast("long").alias("n_tokens"))


def op6_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50."""
    return topk_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with cosine 0.93 or more."""
    return hnsw_dedup(_table(spark, sf_dir, "embeddings"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its runs of lines that occurred before."""
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language.Model.fit(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    out = language.language_id(docs, model, spans=False)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


#: Lines, every text that can be changed, half of them suffix first.
FIM = middle.Setting(unit="line", seed="7", rate=100, spm=50)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two lines and put together anew; digests of the output and of the text restored from it."""
    out = middle.fill_middle(_table(spark, sf_dir, "documents"), FIM)
    back = F.sha2(middle.restored(F.col("output"), F.col("form"), FIM), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside 10 consecutive words of a benchmark item, and the items."""
    out = leaks.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), leaks.Setting(size=10))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the tenth that a seeded draw takes."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), resampling.Setting(n=1, buckets=10_000, percent=10, least_words=20, seed="2024"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_length_packing": op4_length_packing,
    "op5_hierarchical_mixing": op5_hierarchical_mixing,
    "op6_voronoi_topk": op6_voronoi_topk,
    "op7_hnsw_near_dedup": op7_hnsw_near_dedup,
    "op8_trie_token_counts": op8_trie_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_fill_middle": op11_fill_middle,
    "op12_decontamination": op12_decontamination,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""",
    "op5_hierarchical_mixing": r"""
WITH RECURSIVE step(n, c) AS (
  SELECT 0, list_transform(range(256), lambda x: x::BIGINT)
  UNION ALL SELECT n + 1, list_transform(c, lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM step WHERE n < 8
), z AS (
  SELECT source, 'domain' || xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(source)) + 1), lambda i: ('0x' || hex(encode(source))[2 * i - 1 : 2 * i])::BIGINT)),
    lambda a, x: xor(a // 256, c[1 + xor(a % 256, x)])), 4294967295) % 3 AS domain FROM (SELECT DISTINCT coalesce(source, '') AS source, (SELECT c FROM step WHERE n = 8) AS c FROM documents)
), d AS (
  SELECT doc_id, lang, d.source, domain, coalesce(lang, '') AS l, coalesce(d.source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents d JOIN z ON z.source = coalesce(d.source, '')
), leaf AS (SELECT domain, l, s, sum(n)::DOUBLE AS supply, 2.0::DOUBLE * sum(n) AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'domain0' THEN 3.0::DOUBLE WHEN 'domain1' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (SELECT floor(sum(supply) * 0.6) FROM leaf) AS budget FROM leaf GROUP BY domain),
f1 AS (SELECT *, cap / w * (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) <= budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fits FROM n1),
g1 AS (SELECT domain, CASE WHEN fits THEN cap ELSE greatest(0, budget - coalesce(sum(cap) FILTER (fits) OVER (), 0)) * w / (sum(w) FILTER (NOT fits) OVER ()) END AS budget FROM f1),
n2 AS (SELECT domain, l, sum(cap) AS cap, CASE l WHEN 'en' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, any_value(g1.budget) AS budget FROM leaf JOIN g1 USING (domain) GROUP BY domain, l),
f2 AS (SELECT *, cap / w * (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) <= budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fits FROM n2),
g2 AS (SELECT domain, l, CASE WHEN fits THEN cap ELSE greatest(0, budget - coalesce(sum(cap) FILTER (fits) OVER (PARTITION BY domain), 0)) * w / (sum(w) FILTER (NOT fits) OVER (PARTITION BY domain)) END AS budget FROM f2),
n3 AS (SELECT domain, l, s, supply, cap, 1.0::DOUBLE AS w, g2.budget FROM leaf JOIN g2 USING (domain, l)),
f3 AS (SELECT *, cap / w * (sum(w) OVER (PARTITION BY domain, l) - coalesce(sum(w) OVER (PARTITION BY domain, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) <= budget - coalesce(sum(cap) OVER (PARTITION BY domain, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fits FROM n3),
g3 AS (SELECT domain, l, s, supply, CASE WHEN fits THEN cap ELSE greatest(0, budget - coalesce(sum(cap) FILTER (fits) OVER (PARTITION BY domain, l), 0)) * w / (sum(w) FILTER (NOT fits) OVER (PARTITION BY domain, l)) END AS budget FROM f3),
b AS (SELECT domain, l, s, floor(budget + 1e-6)::BIGINT AS budget, supply::BIGINT AS supply FROM g3),
p AS (SELECT *, CASE WHEN supply > 0 THEN least(budget // supply, 2) ELSE 0 END AS whole FROM b),
o AS (
  SELECT d.*, whole, budget - whole * supply AS rest, sum(n) OVER (PARTITION BY domain, l, s ORDER BY md5('0|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS through FROM d JOIN p USING (domain, l, s)
)
SELECT doc_id, lang, source, unnest(range(whole + CASE WHEN whole < 2 AND through <= rest THEN 1 ELSE 0 END)) AS epoch, n AS n_tokens FROM o
""",
    "op6_voronoi_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM s),
w AS (
  SELECT doc_id, i, 1 AS n, x AS run FROM l WHERE length(x) >= 40
  UNION ALL
  SELECT a.doc_id, a.i, 2, a.x || chr(10) || b.x FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1
), r AS (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, i) AS k FROM w),
g AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM r WHERE k > 1 UNION ALL SELECT doc_id, i + 1 FROM r WHERE k > 1 AND n = 2)
), c AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (p.i IS NULL) AS n_runs
  FROM g LEFT JOIN g p ON p.doc_id = g.doc_id AND p.i = g.i - 1 GROUP BY 1
), t AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1
)
SELECT s.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  CASE WHEN ls IS NOT NULL THEN sha256(coalesce(t.text, '')) END AS kept_sha256
FROM s LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op7_hnsw_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(vec_id, m) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.vec_id
), c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id)
""",
    "op11_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), k AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, text, n, u, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), s AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT k, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, s WHERE len(ws) >= n)
), o AS (SELECT g.k, g.i, g.n, w.item FROM g JOIN w USING (n, win)),
h AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) FROM o) GROUP BY k),
m AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM o) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN m USING (k)
""",
    "op13_importance_resampling": r"""
WITH RECURSIVE step(n, c) AS (
  SELECT 0, list_transform(range(256), lambda x: x::BIGINT)
  UNION ALL SELECT n + 1, list_transform(c, lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM step WHERE n < 8
), d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), f AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(ws) AS w FROM d) GROUP BY ALL),
t AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
v AS (SELECT coalesce(x.w, t.w) AS w, coalesce(x.n, 0) AS s, coalesce(t.n, 0) AS t FROM (SELECT w, sum(n) AS n FROM f GROUP BY w) x FULL JOIN t ON x.w = t.w),
e AS (
  SELECT w, s, t, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || hex(encode(w))[2 * i - 1 : 2 * i])::BIGINT) AS bytes, (SELECT c FROM step WHERE n = 8) AS c FROM v
), u AS (
  SELECT w, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a // 256, c[1 + xor(a % 256, x)])), 4294967295) % 10000 AS bucket FROM e
), z AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM u GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE))))::BIGINT AS gain FROM z),
a AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM f JOIN u USING (w) JOIN g USING (bucket) GROUP BY k),
x AS (
  SELECT doc_id, len(ws) >= 20 AS open, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM d LEFT JOIN a USING (k)
), y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (ORDER BY open DESC, score DESC, doc_id) AS place, count(*) FILTER (open) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= n * 10 // 100 THEN place END AS rank FROM r
""",
}
