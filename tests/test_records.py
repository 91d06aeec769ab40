from factloom.operators import records as R
from factloom.operators import schema as S


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


FACT = "id string, subject string, subject_class string, predicate string, object string, object_class string, source_text string"


def test_row_errors(spark):
    facts = spark.createDataFrame(
        [("1", "Aqua", "C", "P", "x", "C", "Aqua flew"), ("1", "Aqua", "C", "P", "x", "C", "Terra flew"), ("1", "Aqua", "C", "P", "", "C", None), ("9", "a", "C", "P", "b", "C", "a"), ("1", "1", "CatalogEntry", "DESCRIBES", "t", "X", ""), ("1", "1", "CatalogEntry", "describes", "t", "X", "")], FACT
    )
    got = [r.errors for r in R.row_errors(facts, spark.createDataFrame([("1", "The Aqua flew.")], "id string, text string")).orderBy("id", "predicate", "source_text").collect()]
    assert sorted(map(tuple, got)) == sorted([(), ("source not in text",), ("incomplete", "no source text"), ("id unknown",), ("several describes rows",), ("several describes rows",)])


def test_unlinked_rows(spark):
    t = spark.createDataFrame([("r", "r", "A"), ("r", "The A", "B"), ("r", "C", "D"), ("q", "x", "y")], "id string, subject string, object string")
    assert rows(R.unlinked_rows(t), "id", "subject") == [("q", "x"), ("r", "C")]


def test_describes(spark):
    rec = spark.createDataFrame([("1", " a \n title ", None), ("2", None, "Dataset")], "id string, title string, c string")
    d = R.describes_rows(rec, entity_class="c")
    assert rows(d, "id", "object", "object_class") == [("1", "a title", "X"), ("2", "", "Dataset")]
    assert rows(R.describes_problems(d, spark.createDataFrame([("Other",)], "name string")), "id", "problems") == [("1", ["class undecided"]), ("2", ["class not in the schema"])]


def test_induced_support(spark):
    t = spark.createDataFrame([(1, "m", "a", "p", "b"), (1, "m", "a", "p", "b"), (2, "n", "a", "q", "b")], "text int, maintainer string, subject string, predicate string, object string")
    labels = spark.createDataFrame([("a", "A"), ("b", "B"), ("p", "P")], "name string, label string")
    titles = spark.createDataFrame([(3, "m", "A")], "text int, maintainer string, label string")
    assert rows(S.induced_support(t, labels, titles), "kind", "entry", "support", "maintainers") == [("class", "A", 3, 2), ("class", "B", 2, 2), ("pattern", "A P B", 1, 1), ("predicate", "P", 1, 1)]


def test_small_ones(spark):
    df = spark.createDataFrame([("a", None), (" ", "B")], "s string, o string")
    assert rows(df.select(R.pin_key("s", "o").alias("k")), "k") == [("a -> any",), ("any -> B",)]
    f = R.cleaned_fields(spark.createDataFrame([(1, "<b>x</b>")], "k int, title string"), ["title"])
    assert rows(f, "k", "title", "title_clean", "title_clean_method") == [(1, "<b>x</b>", "x", "parsed")]
