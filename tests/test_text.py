import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import markup as M
from factloom.functions import text as X


CASES = {
    # lists, nested and left open
    "<p>Buy<ol><li>milk<li>bread</ol>today": ("Buy\n\n1. milk\n2. bread\ntoday", "parsed"),
    "<ul><li>fruit<ul><li>plum</ul><li>nuts</ul>": ("- fruit\n\n- plum\n\n- nuts", "parsed"),
    # tables, with and without end tags
    "<table><tr><th>year<th>rain</tr><tr><td>1999<td>12 mm</table>": ("year | rain\n\n1999 | 12 mm", "parsed"),
    "<td>left</td> <td>right</td>": ("left | right", "parsed"),
    # links and images
    "see<a href='ftp://h.net/f'>this file</a>now": ("see this file [ftp://h.net/f]now", "parsed"),
    "<a href=https://h.net>https://h.net</a>": ("https://h.net", "parsed"),
    "<img alt='a hill' src=\"hill.gif\">": ("[image: hill.gif]", "parsed"),
    "<img>": ("[image]", "parsed"),
    # parts of words, and things that are no tags
    "CO<sub>2</sub>e and m<sup>2</sup>": ("CO_2 e and m^2", "parsed"),
    "<i>half</i>way": ("halfway", "parsed"),
    "if x<y and <unknown> then": ("if x<y and <unknown> then", "parsed"),
    "a <svg:path/>b": ("a b", "parsed"),
    # what is not shown
    "<!-- note -->seen<style>p {}</style>": ("seen", "parsed"),
    "<head><title>Top</title></head>body": ("Top body", "conservative"),
    # escapes in escapes
    "fish &amp;amp;amp; chips": ("fish & chips", "parsed"),
    "&lt;em&gt;so&lt;/em&gt;": ("so", "parsed"),
    "line<br>line<hr>line": ("line\nline\nline", "parsed"),
}


@pytest.mark.parametrize("raw", CASES)
def test_clean(raw):
    text, tier = CASES[raw]
    got = M.clean(raw)
    assert got == M.Cleaned(got.text, tier, M.unescape(raw) != raw or len(M.scan(raw)) > 1 or "img" in raw)
    assert "\n".join(got.text.split()) == "\n".join(text.split()) and not M.missing_tokens(raw, got.text)


def test_layout_of_lines():
    assert M.render("<p>one</p><p>two</p>") == "one\n\ntwo" and M.render("<ol><li>a</li><li>b</li></ol>") == "1. a\n2. b"
    assert M.render("<div>" * 3000 + "deep") == "deep"


def test_text_that_the_layout_would_lose_falls_back():
    # the address of an image with a text for it, inside what is not shown
    assert M.clean("<title>A <b>name</b></title><p>x").tier == "conservative"
    assert M.clean('<p title="a>b">x').text


def test_clean_without_markup(spark):
    assert M.clean("  two\u00a0words \t\n\n\n\nmore ") == M.Cleaned("two words\n\nmore", "parsed", False)
    assert M.clean(None).text == ""
    raws = ["  two\u00a0words \t\n\n\n\nmore ", None, "", " \n ", "x\u2003\ny", " " * 30000 + "z", "a" + " " * 30000 + "b", *CASES]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string")
    got = {r.i: r.c for r in df.select("i", M.clean_udf("r").alias("c")).collect()}
    for i, r in enumerate(raws):
        c = M.clean(r)
        assert (got[i].text, got[i].tier, got[i].markup, got[i].lost) == (c.text, c.tier, c.markup, 0)


def test_missing_tokens():
    raw = "<a href='u/7'>map</a> of <b>all</b>"
    assert M.missing_tokens(raw, "map of all") == {"u": 1, "7": 1} and not M.missing_tokens(raw, "map u/7 of all")


def test_pieces_keep_every_word_and_fit():
    rng = random.Random(5)
    for most in (60, 200, 900):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.choice((1, 4, 9, 250)))) for _ in range(120)]
        notes = "".join(w + rng.choice((" ", ". ", "\n\n", "? ")) for w in words).strip()
        got = X.pieces({"title": "Nine lives", "notes": notes, "other": None}, most)
        assert all(len(p) <= most for p in got)
        assert all(p.startswith(f"title: Nine lives\n\nnotes (part {i} of {len(got)}): ") for i, p in enumerate(got, 1))
        assert "".join("".join(p.split("): ", 1)[1].split()) for p in got) == "".join(notes.split())
    assert X.pieces({"title": "T", "notes": None}) == ["title: T"] and X.pieces({"title": " "}) == []


def test_chunks_prefer_paragraphs_then_sentences_then_spaces():
    cut = lambda text, room: [text[a:b] for a, b in X.chunk_spans(text, room)]
    assert cut("one. two\n\nthree four", 12) == ["one. two", "three four"]
    assert cut("one. two three four", 12) == ["one.", "two three", "four"]
    assert cut("aaa bbb ccc", 8) == ["aaa bbb", "ccc"] and cut("x" * 7, 3) == ["xxx", "xxx", "x"] and cut("", 3) == []
    with pytest.raises(ValueError, match="no room"):
        X.chunk_spans("x", 0)


@pytest.mark.parametrize(
    ("short", "words", "ok"),
    [("MODIS", "the Moderate Resolution Imaging Spectroradiometer", True), ("DSWx", "Dynamic Surface Water Extent", True), ("ABC", "nothing fits", False), ("S1", "Sentinel-1", True), ("T", "the temperature", True), ("-x", "minus x", False)],
)
def test_long_form(short, words, ok):
    assert (X.long_form(short, words) is not None) is ok


def test_short_forms():
    got = X.short_forms("We used surface air temperature (SAT). Later, heat content, HC, fell in Aqua, Terra, and so on.")
    assert ("SAT", "We used surface air temperature", True) in got and ("HC", "heat content", True) in got
    assert not any(s == "Terra" for s, _, _ in got)


@pytest.mark.parametrize(("v", "text", "out"), [(1.5, "of 1.50 m", "1.50"), (1000, "1,000 km", "1,000"), (2020.0, "", "2020"), (1e-6, "", "0.000001"), (True, "", None), ([1], "", None), (" a \n b ", "", "a b"), (float("nan"), "", None)])
def test_slot(v, text, out):
    assert X.slot(v, text) == out


@pytest.mark.parametrize(
    ("reply", "state"),
    [('{"a": 1}', "object"), ('```json\n{"a": {"b": 2}}\n```', "object"), ('Sure: {"a": 1} ok', "object"), ("no json", "none"), ('{"a": [1, "x}', "unterminated"), ('{"a": 1} {"b": 2}', "several"), ("{a: 1} rest", "invalid")],
)
def test_find_json(reply, state):
    assert X.find_json(reply)[0] == state


def test_replies():
    assert X.classify_reply('{"a": 1}') == "complete" and X.classify_reply("", None) == "empty" and X.classify_reply("x", "length") == "cut_off" and X.classify_reply('{"a": 1') == "cut_off" and X.classify_reply('{"a": 1', "stop") == "malformed"
    assert X.classify_reply("no", "content_filter") == "refused" and X.classify_reply("I can't help with that.") == "refused" and X.classify_reply("prose") == "malformed"
    assert X.has_fields({"a": 1}, a=int) and not X.has_fields({"a": True}, a=int)
    assert X.match_reply(["Aqua", "terra sat"], {"Aqua": 1, "Terra  Sat": 2, "TERRA SAT": 3}) == {"Aqua": 1, "terra sat": 2}


def test_small_things():
    got = X.slash_lists("Level 2/3 (EDR/RDR) of Terra/Aqua, see http://a/b; Terra rose, Aqua fell")
    assert got == [("2/3 (EDR/RDR", [("2", "EDR"), ("3", "RDR")], False, "Level"), ("Terra/Aqua", [("Terra",), ("Aqua",)], True, "of")]
    assert X.slash_splits("Level 2/3 (EDR/RDR) data", ["EDR data", "Level 2/3 (EDR/RDR)", "data"]) == [True, False, False]
    # a title's list counts as named, and so does the same list elsewhere
    assert [g.named for g in X.slash_lists("title: Snow/Ice maps\nMaps of Snow/Ice and Sea/Land")] == [True, True, False]
    assert [g.named for g in X.slash_lists("Maps of Snow/Ice")] == [False]
    # a bare number needs the word before its list
    assert X.slash_splits("The RSI 1/2/3 sensors", ["RSI 3", "Level 3", "RSI 1/2/3"]) == [True, False, False]
    # what has empty items or is part of an address is no list
    assert X.slash_lists("a//b c/ www.x.com/y and/or+if") == [("and/or+if", [("and",), ("or",), ("if",)], False, "y")]
    assert [g.words for g in X.slash_lists("A/B\n[C/D] E/F/G")] == ["A/B\n[C/D", "E/F/G"]
    assert "Big Blue Sea" in X.named_terms("the Big Blue Sea is")
    assert X.word_diff("a b c", "a x c") == [("same", "a"), ("only a", "b"), ("only b", "x"), ("same", "c")]
    assert X.fix_encoding("cafÃ©") == "café" and X.fix_encoding("café") == "café"
    assert X.class_spellings("SeaBody") == ["SeaBody", "SeaBodys", "SeaBodyes", "SeaBodies"]
    assert X.unnamed_pins("holds one of the Channels", [("Channel", "any"), ("Grid", "Channel")]) == ["Grid"]
    assert X.stray_classes("a DataSet near DataSets and SeaBody", {"DataSet"}) == ["SeaBody"]


def test_columns(spark):
    df = spark.createDataFrame([("&lt;b&gt;x&lt;/b&gt; y", "**bold** [t](u)", "Claude Model-X.5")], "raw string, md string, m string")
    r = df.select(M.clean_udf("raw").alias("c"), X.plain_markdown("md").alias("p"), X.model_key("m").alias("k"), X.source_in_text_udf(F.lit("x ... y"), "raw").alias("s")).first()
    assert r.c.text == "x y" and r.c.lost == 0 and r.p == "bold t" and r.k == "claude-model-x-5" and r.s
    assert df.select(X.well_formed(F.lit("predicate"), F.lit("HAS_PART")).alias("a"), X.well_formed(F.lit("class"), F.lit("has part")).alias("b")).first() == (True, False)


def test_more_columns(spark):
    df = spark.createDataFrame(
        [(1500.0, "of 1,500 kg", "Aqua/Terra fly", "SeaBody", "holds Channels near DataSet", "a b", "a c", {"Terra  Sat": "x"}), (None, None, None, None, None, None, None, None)],
        "v double, t string, lists string, c string, d string, a string, b string, reply map<string, string>",
    )
    r = df.select(
        X.number_as_written_udf("v", "t").alias("number"), X.slash_lists_udf("lists").alias("lists"), X.slash_splits_udf("lists", F.array(F.lit("Aqua"))).alias("splits"),
        X.class_spellings_column("c").alias("spelled"), X.unnamed_pins_udf("d", F.array(F.struct(F.lit("Channel").alias("s"), F.lit("Grid").alias("o")))).alias("pins"),
        X.stray_classes_udf("d", F.array(F.lit("Other"))).alias("stray"), X.word_diff_udf("a", "b").alias("diff"), X.match_reply_column(F.lit("terra sat"), F.col("reply")).alias("match"),
        X.abbreviation_flags_udf(F.array(F.struct(F.lit("SAT").alias("short"), F.lit("nothing here").alias("words"))), F.lit("We used surface air temperature (SAT).")).alias("flags"),
    ).collect()
    one, null = r
    assert one.number == "1,500" and [(x.words, x["items"], x.named) for x in one.lists] == [("Aqua/Terra", ["Aqua", "Terra"], False)] and one.splits == [True]
    assert one.spelled == X.class_spellings("SeaBody") and one.pins == ["Grid"] and one.stray == ["DataSet"] and one.match == "x" and one.flags == ["SAT"]
    assert [tuple(x) for x in one["diff"]] == [("same", "a"), ("only a", "b"), ("only b", "c")]
    assert null.number is None and null.lists == [] and null.stray == [] and null.match is None


def test_escapes_that_were_cut_off():
    raw = "<h1>sun &amp; rain&amp</h1><p>&quot;hail&quot &#65;&#x42; &copy2 &copy; &notit; &amp;amp; &am"
    assert M.clean(raw).text == 'sun & rain&\n\n"hail" AB ©2 © ¬it; & &am'
    assert M.clean(raw, closed=True) == M.Cleaned('sun & rain&amp\n\n"hail&quot AB &copy2 © &notit; & &am', "parsed", True)


def test_page_articles_cut_within_an_escape(spark, tmp_path):
    import duckdb

    from factloom.plans import texts

    htmls = ["<article><h1>a &amp; b&am</h1><p>a &amp; b&amp;&amp; c</p></article>", "<article><h1>a &amp; b&amp</h1><p>a &amp; b</p></article>", "<article><h1>x&quot</h1><p>x&quot;y</p></article>", "<p>x&amp</p>", "", None]
    spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, tier, lost, words FROM ({texts.ORACLES['page_articles']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in texts.page_articles(spark, str(tmp_path)).orderBy("page_id").collect()] == want


def test_words_that_hold_the_letters_doi_are_no_addresses():
    words = lambda text: [g.words for g in X.slash_lists(text)]
    assert words("Maps by gaasta/radoie, doing/done, adoiemente+artaco and ado/doi.") == ["gaasta/radoie", "doing/done", "adoiemente+artaco", "ado/doi."]
    for address in ("doi:10.5067/X/Y", "DOI:a/b", "(doi:10.5067/X/Y)", "doi.pangaea.de/10.1594/P.1", "doi/10.5067/X", "doi10.5067/X", "x/doi/abs/10.1175/J", "https://doi.org/10.5067/X/Y", "DOIs:10.5067/X/Y"):
        assert words(f"See {address} for more") == []
    assert X.slash_splits("Maps by dodo/doie of 7", ["dodo kind", "dodo/doie"]) == [True, False]


def test_slash_list_scan_of_words_with_doi(spark, tmp_path):
    import duckdb

    from factloom.plans import texts

    pairs = ["gaasta radoie", "doie mente", "doi doing", "esci ncodoie x", "dodo DOI", "Doie doie", "doi", "", None]
    rows = [(i * 6 + k, t) for i, t in enumerate(pairs) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, words, named, before, split, whole_split FROM ({texts.ORACLES['slash_list_scan']}) ORDER BY 1").fetchall()
    assert len(want) == 30 and [tuple(r) for r in texts.slash_list_scan(spark, str(tmp_path)).orderBy("doc_id").collect()] == want
