"""License scans: ordered signature rules over whole texts.

A text is lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; rules are regular expressions over
the words with single spaces between, hundreds of them, written by hand (`license_signatures`). One expression tells
which texts hold any keyword phrase, and a rule runs only where its own one stands.
Every find is an interval of words with its rule's tier (3: a grant or an identifier, 2: a named version,
1: a mention). A find is suppressed when an interval of its tier or a higher one contains it; of equal
intervals the higher tier stays, then the rule that comes first. Labels of the rest are the result.

The main path is DataFrame functions alone. A row carries its words only if the gate lets it through, and then
once for each keyword found; finds of a row meet in windows over that row.

Defined results: a null or empty text has no words and no labels; repeated rows and null ids are judged row by
row; a text of any length is scanned whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spindrift.llm.license_signatures import SIGNATURES

#: Fixed values of the base rule: phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.95}


def rules() -> list[tuple[int, str, str, int, str]]:
    """Place, label, keyword phrase, tier and expression of every rule, in order.

    A find takes the space before its first word, and ends before a space.
    """
    lines = [line.split("; ") for line in SIGNATURES.strip().split("\n") if not line.startswith("#")]
    return [(k, label, f" {key}", int(tier), f" (?:{expression})(?= )") for k, (label, tier, key, expression) in enumerate(lines)]


def any_of(phrases: list[str]) -> str:
    """One expression that stands wherever a phrase does: common beginnings are looked at once."""
    ends: dict[str, list[str]] = {}
    for p in sorted(set(phrases)):
        ends.setdefault(p[:1], []).append(p[1:])
    if "" in ends:
        return ""
    parts = [first + any_of(rest) for first, rest in ends.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def worded(docs: DataFrame) -> DataFrame:
    """doc_id and body: the words of a text with a space around each, one space if there are none."""
    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    return docs.select("doc_id", F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ").alias("body"))


def _base(body: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base (labels) of a body."""
    n = spaces(body) - 1
    counts = [F.regexp_count(body, F.lit(f" {p}(?= )")) for p, _ in BASE]
    firsts = [F.when(F.contains(body, F.lit(f" {p} ")), spaces(F.substring_index(body, f" {p} ", 1))) for p, _ in BASE]
    lasts = [F.when(F.contains(body, F.lit(f" {p} ")), n - spaces(F.substring_index(body, f" {p} ", -1)) - (p.count(" ") + 1)) for p, _ in BASE]
    gate = F.contains(body, F.lit(" license "))
    total = counts[0] + counts[1] + counts[2]
    return {
        "n_words": n.cast("long"),
        "n_base": F.when(gate, total).otherwise(0).cast("long"),
        "first_word": F.when(gate, F.least(*firsts)).cast("long"),
        "last_word": F.when(gate, F.greatest(*lasts)).cast("long"),
        "base": F.when(gate, F.filter(F.array(*(F.when(F.contains(body, F.lit(f" {p} ")), label) for p, label in BASE)), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")),
    }


def _rule_table(spark: SparkSession, known: list[tuple[int, str, str, int, str]]) -> DataFrame:
    rows = ", ".join(f"({k}, '{label}', '{key}', {tier}, '{expression}')" for k, label, key, tier, expression in known)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(place, label, keyword, tier, expression)")


def found(docs: DataFrame) -> DataFrame:
    """Every find of every row, suppressed ones too, and one row with nulls for rows without finds:
    uid, doc_id, base columns, label, tier, start and end (words, end excluded), suppressed."""
    known = rules()
    keys = sorted({key for _, _, key, _, _ in known})
    gate = F.col("body").rlike(any_of(keys))
    base = _base(F.col("body"))
    rows = worded(docs).withColumns({"uid": F.monotonically_increasing_id(), **base})
    rows = rows.withColumn("keys", F.when(gate, F.filter(F.split(F.lit(";".join(keys)), ";"), lambda k: F.contains("body", k))))
    rows = rows.withColumn("body", F.when(F.size("keys") > 0, F.col("body")))
    hits = rows.select("uid", "doc_id", *base, "body", F.explode_outer("keys").alias("keyword")).join(F.broadcast(_rule_table(docs.sparkSession, known)), "keyword", "left")
    parts = F.arrays_zip(F.expr("regexp_extract_all(body, expression, 0)").alias("m"), F.expr("split(body, expression, -1)").alias("p"))
    cut = hits.withColumn("parts", F.when(F.regexp_like("body", F.col("expression")), parts)).drop("body", "keyword", "expression")
    each = cut.select("uid", "doc_id", *base, "label", "tier", "place", F.posexplode_outer("parts").alias("k", "part")).where("part is null or part.m is not null")
    each = each.select("uid", "doc_id", *base, F.when(F.col("part").isNotNull(), F.col("label")).alias("label"), "tier", "place", "k", spaces(F.col("part.p")).alias("before"), spaces(F.col("part.m")).alias("long"))
    # Rows without a find are one row each from here on.
    each = each.repartition("uid")
    of_rule = Window.partitionBy("uid", "place").orderBy("k")
    each = each.withColumn("start", F.sum(F.col("before") + F.col("long")).over(of_rule) - F.col("long")).withColumn("end", F.col("start") + F.col("long"))
    order = Window.partitionBy("uid").orderBy(F.col("start"), F.col("end").desc(), F.col("tier").desc(), F.col("place")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(*(F.when(F.col("tier") == t, F.max(F.when((F.col("tier") >= t) & F.col("label").isNotNull(), F.col("end"))).over(order)) for t in CONFIDENCE))
    return each.withColumn("suppressed", F.coalesce(over >= F.col("end"), F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (of the surest find), a row for each row."""
    stays = F.col("label").isNotNull() & ~F.col("suppressed")
    sure = F.coalesce(*(F.when(F.col("tier") == t, F.lit(c)) for t, c in CONFIDENCE.items()))
    joined = found(docs).groupBy("uid").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")),
        F.collect_set(F.when(stays, F.col("label"))).alias("more"),
        F.max(F.when(stays, sure)).alias("sure"),
    )
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", "more")).alias("labels"), F.coalesce("sure", F.when(F.size("base") > 0, CONFIDENCE[1]).otherwise(0.0)).alias("score"))
