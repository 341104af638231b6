"""The place directory and its companions: scans, header checks, drop rules and lookups."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.errors import DirectorySchemaError, InvalidPlaceCode, NoRelease
from spindrift.functions import codes
from spindrift.functions.projection import national_grid
from spindrift.operators.nodes import numbered
from spindrift.tables import settled

#: The directory's columns.
COLUMNS = ("pcds", "doterm", "east1m", "north1m", "usrtypind", "oa21cd", "lat", "long")
REASONS = ("terminated", "northern_ireland", "large_user", "no_grid_reference", "outside_national_grid")
TOLERANCE_M = 1000.0


@dataclass
class Directory:
    """nodes (node_id, code, easting, northing, area), excluded (code) and how many rows fell to each reason."""

    nodes: DataFrame
    excluded: DataFrame
    rows_read: int
    dropped: dict[str, int]


def text_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV file with a header, every cell as text; a byte order mark is skipped; quoted cells may hold line breaks.

    One pass over the lines tells whether a file may be split at line breaks: where a line has an odd number of quotes,
    a quoted cell goes on in the next one, and each file is read whole by one task.
    """
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1
    broken = not spark.read.text(path).where(odd).isEmpty()
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=broken, quote='"', escape='"')


def require(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """df, or an error that names all columns that it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise DirectorySchemaError(f"columns are missing: {', '.join(lacking)}")
    return df


def drop_reason(gb_only: bool = False) -> Column:
    """The first rule that drops a row of (code and raw columns), else null."""
    east, north = F.expr("try_cast(east1m as bigint)"), F.expr("try_cast(north1m as bigint)")
    rule = F.when(~codes.blank(F.col("doterm")), REASONS[0])
    if gb_only:
        rule = rule.when(codes.is_northern(F.col("code")), REASONS[1])
    rule = rule.when(F.trim(F.coalesce("usrtypind", F.lit(""))) == "1", REASONS[2])
    rule = rule.when(codes.blank(F.col("east1m")) | codes.blank(F.col("north1m")) | codes.blank(F.col("lat")) | codes.blank(F.col("long")), REASONS[3])
    return rule.when(~F.coalesce(codes.on_grid(east, north), F.lit(False)), REASONS[4])


def classified(raw: DataFrame, gb_only: bool = False) -> DataFrame:
    """The rows of a directory with their canonical code and reason."""
    return require(raw).withColumn("code", codes.canonical(F.col("pcds"))).withColumn("reason", drop_reason(gb_only))


def resolved(kept: DataFrame) -> DataFrame:
    """code, easting, northing, area: northern places by projection of their coordinates, the others as given.

    One pass finds how many given references lie over TOLERANCE_M from the projection; any refuses the file.
    """
    rows = kept.select("code", F.col("east1m").cast("long").alias("e"), F.col("north1m").cast("long").alias("n"), F.coalesce("oa21cd", F.lit("")).alias("area"), F.col("long").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    rows = settled(national_grid(rows, "lon", "lat", "pe", "pn"), "projected")
    north_rows = codes.is_northern(F.col("code"))
    off = F.sqrt((F.col("e") - F.col("pe")) ** 2 + (F.col("n") - F.col("pn")) ** 2)
    bad = rows.where(~north_rows & (off > TOLERANCE_M)).agg(F.count("*").alias("n"), F.max(off).alias("worst")).first()
    if bad["n"]:
        raise DirectorySchemaError(f"{bad['n']} grid references contradict their coordinates, by up to {bad['worst']:.0f} m")
    return rows.select("code", F.when(north_rows, F.bround("pe")).otherwise(F.col("e")).cast("long").alias("easting"), F.when(north_rows, F.bround("pn")).otherwise(F.col("n")).cast("long").alias("northing"), "area")


def read_directory(spark: SparkSession, path: str, gb_only: bool = False) -> Directory:
    rows = classified(text_scan(spark, path), gb_only).persist()
    try:
        counted = {r["reason"]: (r["n"], r["bad"]) for r in rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("code").isNull()).alias("bad")).collect()}
        if invalid := sum(bad for _, bad in counted.values()):
            raise InvalidPlaceCode(f"{invalid} rows have no valid place code")
        nodes = numbered(resolved(rows.where("reason is null")), ["code", "easting", "northing", "area"])
        excluded = rows.where(F.col("reason") == REASONS[2]).select("code").distinct()
        return Directory(nodes, excluded, sum(n for n, _ in counted.values()), {k: n for k, (n, _) in counted.items() if k})
    finally:
        rows.unpersist()


def read_pairs(spark: SparkSession, paths: list[str], key: Column | None = None) -> DataFrame:
    """key, value: the first two columns by place, blank rows left out, repeated keys summed over all files."""
    parts = None
    for path in paths:
        df = text_scan(spark, path)
        if len(df.columns) < 2:
            continue
        part = df.select(F.col(f"`{df.columns[0]}`").alias("raw"), F.col(f"`{df.columns[1]}`").alias("number"))
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return spark.createDataFrame([], "key string, value long")
    named = F.trim("raw") if key is None else key
    return parts.where(~codes.blank(F.col("raw")) & ~codes.blank(F.col("number"))).select(named.alias("key"), F.col("number").cast("long").alias("n")).where("key is not null").groupBy("key").agg(F.sum("n").alias("value"))


def aligned(nodes: DataFrame, raw: DataFrame, columns: list[str]) -> DataFrame:
    """node_id, code and columns of a directory (all of its rows), blank where it has none; of repeated codes
    the last row counts. raw needs an ascending `row_no` to tell which is last."""
    lacking = [c for c in ("pcds", *columns) if c not in raw.columns]
    if lacking:
        raise KeyError(f"columns are missing: {', '.join(lacking)}")
    last = raw.select(codes.canonical(F.col("pcds")).alias("code"), "row_no", *columns).where("code is not null").groupBy("code").agg(*(F.max_by(F.coalesce(c, F.lit("")), "row_no").alias(c) for c in columns))
    return nodes.select("node_id", "code").join(last, "code", "left").na.fill("", columns).select("node_id", "code", *columns)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A data set by its suffix: Parquet with its types, or CSV as text."""
    return spark.read.parquet(path) if path.endswith((".parquet", ".pq")) else text_scan(spark, path)


def write_records(df: DataFrame, path: str) -> None:
    """By suffix; nulls stay nulls in Parquet and are blank in CSV; without rows the header alone is written."""
    if path.endswith((".parquet", ".pq")):
        df.write.parquet(path)
    else:
        df.write.csv(path, header=True, nullValue="", emptyValue="")


RELEASE_TITLE = re.compile(r"ONS Postcode Directory \((January|February|March|April|May|June|July|August|September|October|November|December) 20\d\d\)", re.I)
ALLOWED_HOSTS = ("www.arcgis.com", "geoportal.statistics.gov.uk")


def choose_latest(features: DataFrame) -> DataFrame:
    """The newest release of a portal's answer: id, title, created (milliseconds)."""
    found = features.where(F.col("title").rlike(RELEASE_TITLE.pattern.replace("(January", "(?i)(January", 1)) & ~F.lower("title").contains("user guide")).orderBy(F.col("created").desc(), "id").limit(1)
    if found.isEmpty():
        raise NoRelease("no release among the portal's items")
    return found


def checked_url(url: str) -> str:
    """url, if it is https and of a host that is allowed."""
    m = re.fullmatch(r"https://([^/:@]+)(/.*)?", url)
    if not m or m[1].lower() not in ALLOWED_HOSTS:
        raise ValueError("only https addresses of the statistics portal are fetched")
    return url


