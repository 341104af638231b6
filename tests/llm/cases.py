"""Small tables with the odd rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards boldly quote poems about rivers and hills near town"
ODD = [
    (1, PROSE, "en", "a", 1, "x", "y"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None),
    (4, " \n\t ", "en", "b", 4, None, None),
    (5, PROSE, "en", "a", 1, "x", "y"),
    (6, " ".join(f"word{i}" for i in range(30_000)), "en", "b", 1, None, None),
    (None, PROSE, "en", "a", 1, None, None),
    (8, "spam!! \U0001f600 ▁under  nbsp  two  spaces\n\nline\r\n", "de", "c", 9, None, None),
    (1, PROSE, "en", "a", 1, "x", "y"),
    (9, "one", "en", "a", 3, None, None),
]


#: Names that operators use inside or give their results.
CLASHING = "id hash part at ids uid label labels tier rep root links names sketch band bucket copies group class_id side blocks fill pos width item_id shift kind line contaminated coverage anomaly base_failed n_words n_tokens held_out predicted lossless start y h made".split()


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHING))


def empty(spark):
    return odd(spark).limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
