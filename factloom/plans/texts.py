"""Queries of text functions: keys, cleaning, chunking, abbreviations, terms, replies, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import keys as K
from factloom.functions import markup as M
from factloom.functions import text as X
from factloom.operators import ledger as L
from factloom.operators import schema as S
from factloom.plans.quality import table
from factloom.sources import lookup as A


def clean_pages(spark, sf_dir):
    """Pages as plain text with the tier and the proof (SCA-10, SCA-11, SCA-12, SCA-13)."""
    p = table(spark, sf_dir, "pages").select("page_id", M.clean_udf("html").alias("c"))
    return p.select("page_id", "c.tier", "c.markup", "c.lost", F.length("c.text").alias("n_chars"), F.sha2("c.text", 256).alias("fingerprint"))


def page_articles(spark, sf_dir):
    """The articles of pages laid out as text, with the tier that the proof allowed and the words in their order (SCA-11).

    Titles cut within an escape keep what is left of it as text; a page without html has no words.
    """
    article = F.regexp_extract("html", r"(?s)<(?:main|article)[^>]*>(.*?)</(?:main|article)>", 1)
    p = table(spark, sf_dir, "pages").select("page_id", article.isNotNull().alias("given"), M.clean_udf(article, closed=True).alias("c"))
    words = F.regexp_extract_all("c.text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return p.select("page_id", "c.tier", "c.lost", F.when(F.col("given"), F.sha2(F.array_join(words, " "), 256)).alias("words"))


def cleaning_tally(spark, sf_dir):
    """Cleaned pages by tier and markup (AGG-31)."""
    return clean_pages(spark, sf_dir).groupBy("tier", "markup").agg(F.count(F.lit(1)).alias("pages"), F.sum("lost").alias("lost"))


def token_bag_difference(spark, sf_dir):
    """Words of pages that stripping all tags loses or keeps, as bags (SET-03)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw"), F.regexp_replace("html", r"<[^>]*>", " ").alias("shown"))
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    a = p.select("page_id", words("raw").alias("w")).withColumn("n", F.lit(1))
    b = p.select("page_id", words("shown").alias("w")).withColumn("n", F.lit(-1))
    d = a.unionByName(b).groupBy("page_id", "w").agg(F.sum("n").alias("missing")).where("missing > 0")
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("words"), F.sum("missing").alias("tokens"))


def markup_rank(spark, sf_dir):
    """The 20 pages with most markup: tags count three times, entities once (WIN-15)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("</?[A-Za-z][^<>]*>")).alias("tags"), F.regexp_count("html", F.lit("&[A-Za-z#][A-Za-z0-9]*;")).alias("entities"))
    return p.select("page_id", (3 * F.col("tags") + F.col("entities")).cast("long").alias("score")).orderBy(F.desc("score"), "page_id").limit(20)


def one_line_titles(spark, sf_dir):
    """First lines with white space collapsed (SCA-15)."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(first, r"[ \t\r]+", " ")), 256).alias("title"))


def chunk_documents(spark, sf_dir):
    """Documents in pieces of at most 2,000 characters (SCA-22)."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pieces_udf(2000)(first, "text")).alias("piece", "t"))
    return d.select("doc_id", "piece", F.length("t").alias("n_chars"))


def _set_off(spark, sf_dir):
    """doc_id, phrase, short, right, text: the first three ASCII words of each document with their initials behind them, other letters in every fourth document."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") >= 3)
    right = F.col("doc_id") % 4 != 0
    initials = F.upper(F.concat(*(F.substring(F.element_at("w", i), 1, 1) for i in (1, 2, 3))))
    d = d.select("doc_id", F.array_join(F.slice("w", 1, 3), " ").alias("phrase"), F.when(right, initials).otherwise("8X9").alias("short"), right.alias("right"))
    return d.withColumn("text", F.concat(F.lit("It is on. "), "phrase", F.lit(" ("), "short", F.lit(") in all.")))


def abbreviation_scan(spark, sf_dir):
    """Short forms set off behind words of each document, and whether those words spell them (SCA-17, SCA-18)."""
    d = _set_off(spark, sf_dir).select("doc_id", F.explode(X.short_forms_udf("text")).alias("x"))
    return d.select("doc_id", "x.short", "x.passes")


def abbreviation_flags(spark, sf_dir):
    """Long forms named for a short form that disagree with what its text says of it (SCA-19)."""
    full = F.when(F.col("doc_id") % 3 == 0, F.lit("of no such sort")).otherwise(F.col("phrase"))
    d = _set_off(spark, sf_dir)
    return d.select("doc_id", F.array_join(X.abbreviation_flags_udf(F.array(F.struct("short", full.alias("words"))), "text"), ",").alias("flags"))


def numbers_as_written(spark, sf_dir):
    """Prices as their text spells them, in full where it does not (SCA-09)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    text = F.when(F.col("o_orderkey") % 3 == 0, "no price").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("paid "), F.format_number("v", 2), F.lit(" in all"))).otherwise(F.concat(F.format_string("%.3f", "v"), F.lit(" or so")))
    return o.select("o_orderkey", X.number_as_written_udf("v", text).alias("written"))


def slash_list_scan(spark, sf_dir):
    """Lists of two words of each document joined by a slash: named apart in every second text, in the title of every third (SCA-23)."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.slice(F.array_distinct(w), 1, 2), F.lower).alias("w")).where(F.size(F.array_distinct("w")) == 2)
    pair = F.array_join("w", "/")
    apart = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(", "), F.element_at("w", 2), F.lit(" apart from "), F.element_at("w", 1))).otherwise("")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("title: of "), pair, F.lit("\nMaps"))).otherwise(F.concat(F.lit("Maps by "), pair, apart, F.lit(" of 7")))
    lists = X.slash_lists_udf(text)
    names = F.array(F.concat(F.element_at("w", 1), F.lit(" kind")), pair)
    return d.select("doc_id", F.explode(lists).alias("x"), X.slash_splits_udf(text, names).alias("s")).select("doc_id", "x.words", "x.named", "x.before", F.element_at("s", 1).alias("split"), F.element_at("s", 2).alias("whole_split"))


def class_spellings(spark, sf_dir):
    """Spellings and plurals of the part types' names as classes (SCA-26)."""
    p = table(spark, sf_dir, "part").select(F.concat(F.initcap("p_type"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("City")).alias("name")).distinct()
    return p.select("name", F.explode(X.class_spellings_column("name")).alias("spelling"))


def word_differences(spark, sf_dir):
    """Part names against names with another last word, as words that are the same, only left and only right (SCA-28)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = F.concat(F.regexp_replace("p_name", r"\S+$", ""), F.lit("blank"))
    return p.select("p_partkey", F.explode(X.word_diff_udf("p_name", other)).alias("x")).select("p_partkey", "x.kind", "x.words")


def reply_keys(spark, sf_dir):
    """What replies say of customers under names in other case and spacing (SCA-37)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    said = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.lit("other"))
    return c.select("c_custkey", X.match_reply_column("c_name", F.create_map(said, F.col("c_mktsegment"))).alias("segment"))


def term_census(spark, sf_dir):
    """Capitalised ASCII words by documents and language (AGG-33, SCA-29)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+"), F.lit(0)))).alias("term"))
    return d.groupBy("term", "lang").agg(F.count(F.lit(1)).alias("documents"))


def named_terms(spark, sf_dir):
    """Capitalised words and runs of two or three of them in page text (SCA-29)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(X.named_terms_udf(M.clean_udf("html").text))).alias("term"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("pages"))


def neighbor_words(spark, sf_dir):
    """Words within three places of 'the' (AGG-33): each hit takes a slice of its own text."""
    d = table(spark, sf_dir, "documents").select(F.split("text", " ").alias("ws"))
    hits = d.select("ws", F.posexplode("ws").alias("i", "w")).where("w = 'the'")
    near = F.concat(F.slice("ws", F.greatest(F.lit(1), F.col("i") - 2), F.least(F.lit(3), F.col("i"))), F.slice("ws", F.col("i") + 2, F.lit(3)))
    return hits.select(F.explode(near).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def quantity_keys(spark, sf_dir):
    """Part sizes written with units, by their key in the base unit (SCA-03, SCA-01, SCA-02)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size"), F.lit(" Kilometers (km)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("the "), F.col("p_size"), F.lit("km."))).otherwise(F.concat(F.col("p_size") * 1000, F.lit(" m")))
    return p.select("p_partkey", K.instance_key_udf(text).alias("key"))


def class_keys(spark, sf_dir):
    """Part types re-cased and re-spaced, by their loosest key (SCA-06)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.initcap(F.regexp_replace("p_type", " ", "_"))).otherwise(F.lower("p_type")).alias("t"))
    return p.select("p_partkey", K.class_key_udf("t").alias("key"))


def name_key_join(spark, sf_dir):
    """Names with honorifics, degrees and other orders, by their key (SCA-16, WIN-16)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Dr. "), "s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.upper("s_name"), F.lit(", Ph.D."))).otherwise(F.col("s_name")).alias("n"))
    return s.select("s_suppkey", K.name_key_udf("n").alias("key"))


def triple_keys(spark, sf_dir):
    """Facts by key; the ends of a symmetric predicate in one order (SCA-07)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = n.select("n_nationkey", F.col("n_name").alias("subject"), F.lit("Place").alias("subject_class"), F.when(F.col("n_nationkey") % 2 == 0, "ALSO_KNOWN_AS").otherwise("PART_OF").alias("predicate"), F.col("r_name").alias("object"), F.lit("Area").alias("object_class"))
    return K.with_keys(t).select("n_nationkey", "k_s", "k_p", "k_o", "k_sc", "k_oc")


def text_contains(spark, sf_dir):
    """Whether documents, of any language or none, hold a phrase in whole words, its article aside (SCA-05)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", K.contains_udf("text", F.lit("the of")).alias("found"))


def source_passages(spark, sf_dir):
    """Whether all passages of a quotation stand in the document; in every third one the last passage is of another (SCA-08, SCA-20)."""
    last = F.when(F.col("doc_id") % 3 == 0, "qqzzqq").otherwise(F.split_part("text", F.lit(" "), F.lit(5)))
    quote = F.concat(F.split_part("text", F.lit(" "), F.lit(2)), F.lit(" ... "), last)
    return table(spark, sf_dir, "documents").select("doc_id", X.source_in_text_udf(quote, "text").alias("found"))


def reply_classify(spark, sf_dir):
    """Replies by state (SCA-34, SCA-35)."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Here: "), "props")).when(F.col("event_id") % 5 == 1, F.substring("props", 1, 5)).when(F.col("event_id") % 5 == 2, "").otherwise(F.col("props")).alias("reply"), F.when(F.col("event_id") % 7 == 0, "length").alias("finish"))
    return e.groupBy(X.classify_reply_udf("reply", "finish").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def extract_by_lookup(spark, sf_dir):
    """Facts read by the stand-in source, asked once for each text, with what is wrong with them (SRC-26, OPS-03, OPS-06, SNK-09)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(" is part of "), F.regexp_replace("p_brand", "#", "")).alias("text"))
    prompts = p.select("p_partkey", "text", F.col("text").alias("prompt")).withColumn("key", A.answer_key("prompt", F.lit("stand-in")))
    answers, _ = A.with_cache(prompts, spark.createDataFrame([], "key string, reply string"), A.pattern_extractor)
    out = A.rows_of_replies(answers.select("p_partkey", "text", "reply"))
    return out.groupBy("subject", "predicate", "object", "problem").agg(F.count(F.lit(1)).alias("n"))


def ledger_split(spark, sf_dir):
    """Documents kept and put into the ledger, by reason (OPS-01, OPS-02)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    reason = F.when(F.col("n_chars") < 200, "short").when(F.col("source") == "src3", "source left out")
    kept, ledger = L.split_by_reason(d, reason, "clean", "record", "doc_id")
    return ledger.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")))


def request_chunks(spark, sf_dir):
    """Requests in chunks of capped count and size: none passes a cap (SCA-38)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    c = S.request_chunks(d, 50, 200_000, "doc_id", "n").join(d, "doc_id").groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes"))
    return c.agg(F.sum("rows").alias("rows"), (F.max("rows") <= 50).alias("count_ok"), F.max(F.when(F.col("rows") > 1, F.col("bytes")).otherwise(0) <= 200_000).alias("bytes_ok"))


def markdown_plain(spark, sf_dir):
    """Markdown without its marks (SCA-25)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("## "), "p_name", F.lit("\n- **"), "p_brand", F.lit("** `x` [t](u)")).alias("m"))
    return p.select("p_partkey", X.plain_markdown("m").alias("text"))


def label_shapes(spark, sf_dir):
    """Whether labels have the shape of their kind (FLT-08)."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "class").otherwise("predicate").alias("kind"), F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_type", " ", "_")).otherwise(F.regexp_replace(F.initcap("p_type"), " ", "")).alias("name"))
    return p.groupBy("kind", X.well_formed("kind", "name").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def model_names(spark, sf_dir):
    """Model names by key and maker, versions and spellings made from suppliers' numbers (SCA-27)."""
    k = F.col("s_suppkey").cast("string")
    turn = F.col("s_suppkey") % 5
    name = F.when(turn == 0, F.concat(F.lit("google-claude-x-"), k, F.lit(".5"))).when(turn == 1, F.concat(F.lit("Claude X "), k, F.lit("-5"))).when(turn == 2, F.concat(F.lit("claude_x/"), k, F.lit(".5")))
    name = name.when(turn == 3, F.concat(F.lit("GPT-"), k)).otherwise(F.concat(F.lit("other:model"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("model")).select("s_suppkey", "model", X.model_key("model").alias("key"), X.model_maker("model").alias("maker"))


def repaired_encoding(spark, sf_dir):
    """Whole documents read in the wrong encoding and put right (SCA-14)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    broken = F.decode(F.encode("t", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", (X.fix_encoding_udf(broken) == F.col("t")).alias("right"))


QUERIES = {f.__name__: f for f in (
    clean_pages, page_articles, cleaning_tally, token_bag_difference, markup_rank, one_line_titles, chunk_documents, abbreviation_scan, abbreviation_flags, numbers_as_written, slash_list_scan, class_spellings, word_differences, reply_keys, term_census, named_terms, neighbor_words, quantity_keys, class_keys, name_key_join,
    triple_keys, text_contains, source_passages, reply_classify, extract_by_lookup, ledger_split, request_chunks, markdown_plain, label_shapes, model_names, repaired_encoding,
)}

ORACLES = {
    "text_contains": r"""SELECT doc_id, regexp_matches(' ' || regexp_replace(regexp_replace(lower(text), '[''"‘’“”`´«»]', '', 'g'), '[\s.,;:!?()\[\]{}]+', ' ', 'g') || ' ', '[^\p{L}]of(e?s)?[^\p{L}]') AS found FROM documents""",
    "reply_classify": "SELECT CASE WHEN event_id % 7 = 0 OR event_id % 5 = 1 THEN 'cut_off' WHEN event_id % 5 = 2 THEN 'empty' ELSE 'complete' END AS state, count(*) AS n FROM events GROUP BY 1",
    "page_articles": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1), '<[^>]*>', ' ', 'g') AS x FROM pages)
      SELECT page_id, 'parsed' AS tier, 0 AS lost, sha256(array_to_string(regexp_extract_all(replace(replace(replace(x, '&amp;', '&'), '&amp;', '&'), '&quot;', ' '), '[\p{L}\p{N}]+'), ' ')) AS words FROM a""",
    "source_passages": "SELECT doc_id, doc_id % 3 <> 0 AND len(string_split(text, ' ')) > 1 AS found FROM documents",
    "token_bag_difference": """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z0-9]+')) AS w FROM pages), b AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z0-9]+')) AS w FROM pages),
      d AS (SELECT page_id, w, sum(n) AS m FROM (SELECT page_id, w, 1 AS n FROM a UNION ALL SELECT page_id, w, -1 FROM b) GROUP BY 1, 2) SELECT page_id, count(*) AS words, sum(m)::BIGINT AS tokens FROM d WHERE m > 0 GROUP BY 1""",
    "markup_rank": "SELECT page_id, 3 * len(regexp_extract_all(html, '</?[A-Za-z][^<>]*>')) + len(regexp_extract_all(html, '&[A-Za-z#][A-Za-z0-9]*;')) AS score FROM pages ORDER BY score DESC, page_id LIMIT 20",
    "one_line_titles": r"SELECT doc_id, sha256(trim(regexp_replace(split_part(text, chr(10), 1), '[ \t\r]+', ' ', 'g'))) AS title FROM documents",
    "term_census": "WITH t AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS term FROM documents) SELECT term, lang, count(*) AS documents FROM t GROUP BY 1, 2",
    "neighbor_words": """WITH d AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), h AS (SELECT doc_id, i AS at, unnest(range(i - 3, i + 4)) AS i FROM d WHERE w = 'the')
      SELECT w, count(*) AS n FROM d JOIN h ON h.doc_id = d.doc_id AND h.i = d.i AND h.i <> h.at GROUP BY 1""",
    "quantity_keys": "SELECT p_partkey, (CASE WHEN p_size % 3 = 2 THEN p_size * 1000 ELSE p_size * 1000 END) || ' m' AS key FROM part",
    "class_keys": "SELECT p_partkey, lower(replace(p_type, ' ', '')) AS key FROM part",
    "name_key_join": "SELECT s_suppkey, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(s_name), '[ ,]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')), ' ') AS key FROM supplier",
    "triple_keys": """WITH t AS (SELECT n_nationkey, lower(n_name) AS s, lower(r_name) AS o, n_nationkey % 2 = 0 AS y FROM nation JOIN region ON r_regionkey = n_regionkey), w AS (SELECT *, y AND (o < s OR (o = s AND 'area' < 'place')) AS turn FROM t)
      SELECT n_nationkey, CASE WHEN turn THEN o ELSE s END AS k_s, CASE WHEN y THEN 'alsoknownas' ELSE 'partof' END AS k_p, CASE WHEN turn THEN s ELSE o END AS k_o, CASE WHEN turn THEN 'area' ELSE 'place' END AS k_sc, CASE WHEN turn THEN 'place' ELSE 'area' END AS k_oc FROM w""",
    "cleaning_tally": "SELECT 'conservative' AS tier, true AS markup, count(*) AS pages, 0::BIGINT AS lost FROM pages",
    "extract_by_lookup": """WITH t AS (SELECT upper(p_type[1]) || lower(substring(split_part(p_type, ' ', 1), 2)) AS s, replace(p_brand, '#', '') AS b FROM part)
      SELECT s AS subject, 'PART_OF' AS predicate, b AS object, NULL::VARCHAR AS problem, count(*) AS n FROM t GROUP BY 1, 3""",
    "ledger_split": "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN source = 'src3' THEN 'source left out' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "request_chunks": "SELECT count(*) AS rows, true AS count_ok, true AS bytes_ok FROM documents",
    "markdown_plain": "SELECT p_partkey, p_name || chr(10) || p_brand || ' x t' AS text FROM part",
    "model_names": """SELECT s_suppkey, model, key, maker FROM (SELECT s_suppkey,
      CASE s_suppkey % 5 WHEN 0 THEN 'google-claude-x-' || s_suppkey || '.5' WHEN 1 THEN 'Claude X ' || s_suppkey || '-5' WHEN 2 THEN 'claude_x/' || s_suppkey || '.5' WHEN 3 THEN 'GPT-' || s_suppkey ELSE 'other:model' || s_suppkey END AS model,
      CASE s_suppkey % 5 WHEN 0 THEN 'google-claude-x-' || s_suppkey || '-5' WHEN 3 THEN 'gpt-' || s_suppkey WHEN 4 THEN 'other-model' || s_suppkey ELSE 'claude-x-' || s_suppkey || '-5' END AS key,
      CASE s_suppkey % 5 WHEN 3 THEN 'OpenAI' WHEN 4 THEN NULL ELSE 'Anthropic' END AS maker FROM supplier)""",
    "abbreviation_scan": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '8X9' ELSE upper(w[1][1] || w[2][1] || w[3][1]) END AS short, doc_id % 4 <> 0 AS passes FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents) WHERE len(w) >= 3",
    "abbreviation_flags": """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 AND NOT spelt THEN short ELSE '' END AS flags FROM (
      SELECT doc_id, upper(w[1][1] || w[2][1] || w[3][1]) AS short, regexp_matches('of no such sort', '(^|[^a-z0-9])' || lower(w[1][1]) || '.*' || lower(w[2][1]) || '.*' || lower(w[3][1])) AS spelt
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents) WHERE len(w) >= 3)""",
    "numbers_as_written": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END WHEN 1 THEN format('{:,.2f}', o_totalprice) ELSE printf('%.3f', o_totalprice) END AS written FROM orders",
    "slash_list_scan": """SELECT doc_id, w[1] || '/' || w[2] AS words, doc_id % 3 = 0 OR doc_id % 2 = 0 AS named, CASE WHEN doc_id % 3 = 0 THEN 'of' ELSE 'by' END AS before, NOT (doc_id % 3 = 0 OR doc_id % 2 = 0) AS split, false AS whole_split
      FROM (SELECT doc_id, list_transform(x.a[1:2], lambda v: lower(v)) AS w FROM (SELECT doc_id, {'a': list_filter(l, lambda v, i: list_position(l, v) = i)} AS x FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS l FROM documents))) WHERE len(list_distinct(w)) = 2""",
    "class_spellings": """WITH n AS (SELECT DISTINCT array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'City' END AS name FROM part)
      SELECT name, unnest(list_concat([name, name || 's', name || 'es'], CASE WHEN regexp_matches(name, '[^aeiouAEIOU]y$') THEN [regexp_replace(name, 'y$', 'ies')] ELSE [] END)) AS spelling FROM n""",
    "word_differences": r"""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
      SELECT p_partkey, unnest(['same', 'only a', 'only b']) AS kind, unnest([array_to_string(w[:-2], ' '), w[-1], 'blank']) AS words FROM p""",
    "reply_keys": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS segment FROM customer",
    "repaired_encoding": 'SELECT doc_id, true AS "right" FROM documents',
    "label_shapes": r"""WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'predicate' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN replace(p_type, ' ', '_')
      ELSE array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') END AS name FROM part)
      SELECT kind, CASE WHEN kind = 'predicate' THEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') ELSE regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') END AS ok, count(*) AS n FROM p GROUP BY 1, 2""",
}
