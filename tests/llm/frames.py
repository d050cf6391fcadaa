"""Small tables with what real ones hold: nulls, empty and long texts, repeated rows, ties,
and extra columns named like the operators' own."""

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, task int, length long, score double, kept boolean, y int"


def docs_frame(spark, texts, first_id=0):
    rows = [(first_id + k, t, "en", "s", len(t or ""), 1, 2, 3, 0.5, True, 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "one two three four",
    "One  two\nthree four",
    "one two three four five six seven eight nine ten eleven twelve",
    "word " * 30_000,
    "x" * 50_000,
    PASSAGE,
    f"before {PASSAGE.upper()} after",
    "日本語 текст ελληνικά é́ 🙂 ½ Ⅷ",
    "mail a.b@c-d.org or +49 (30) 123-4567, 10.0.0.256 and 10.0.0.255; 4111 1111 1111 1111",
    "<|endoftext|> is text too",
]


def odd_docs(spark):
    """The texts above, one of them again with its id (a repeated row), another with a new
    id, and a row without id."""
    docs = docs_frame(spark, ODD_TEXTS)
    again = docs.where("doc_id = 4")
    copy = docs_frame(spark, ["one two three four"], 100)
    nameless = spark.createDataFrame([(None, "a row without id") + (None,) * 9], DOC_SCHEMA)
    return docs.unionByName(again).unionByName(copy).unionByName(nameless)


def with_odd_names(docs):
    """The rows with extra columns named like the columns that operators work with."""
    names = "_row _text _words _spans _items _lang _score _rejected _ROW_ doc_id_ _fp _n"
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(names.split())})
