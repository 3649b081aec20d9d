"""Entity catalogs in Markdown tables and pattern lists in YAML, as ``group, value, pos, parent``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = "`group` string, value string, pos int, parent string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, line`` of one small text file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "line"))


def _cells(line: Column) -> Column:
    """Trimmed cells of a table row."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\s*\|", ""), r"\|\s*$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def _table(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    return rows.where(~F.col("line").rlike(r"^[\s|:\-]+$")).withColumn("cells", _cells(F.col("line")))


def _entries(df: DataFrame, group: str, value: Column, parent: Column | None = None) -> DataFrame:
    order = Window.orderBy("pos")  # the lines of one catalog file
    return df.select(
        F.lit(group).alias("group"), value.alias("value"), F.row_number().over(order).cast("int").alias("pos"), (F.lit(None).cast("string") if parent is None else parent).alias("parent")
    )


def read_single_column(spark: SparkSession, path: str, group: str) -> DataFrame:
    """A one-column table; the header is dropped."""
    rows = _table(spark, path)
    header = rows.agg(F.min("pos")).first()[0]
    return _entries(rows.where(F.col("pos") > F.lit(header)), group, F.get("cells", F.lit(0)))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """``number | name (p) | category``: groups ``locations`` and, for names marked (p), ``placements``; the category is the parent.

    Every numbered row counts, whether its category cell is there or not.
    """
    rows = _table(spark, path).where(F.get("cells", F.lit(0)).rlike(r"^\d+$"))
    name = F.trim(F.regexp_replace(F.get("cells", F.lit(1)), r"\(p\)", ""))
    parent = F.nullif(F.trim(F.regexp_replace(F.coalesce(F.get("cells", F.lit(2)), F.lit("")), r"\(p\)", "")), F.lit(""))
    marked = F.exists("cells", lambda c: F.endswith(c, F.lit("(p)")))
    return _entries(rows, "locations", name, parent).unionByName(_entries(rows.where(marked), "placements", name, parent))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Sections ``# Class plural (singular)`` with a one-column table each: groups ``objects`` (parent: plural), ``categories`` (parent: plural).

    A table belongs to the heading above it; the heading of its column is no object.
    """
    blank = lambda c: F.trim(F.replace(c, F.lit("_"), F.lit(" ")))
    lines = _lines(spark, path)
    words = F.split(F.trim(F.ltrim(F.trim("line"), F.lit("#"))), r"\s+")
    headings = (
        lines.where(F.startswith(F.trim("line"), F.lit("#")))
        .select("pos", words.alias("words"))
        .where((F.get("words", F.lit(0)) == "Class") & F.get("words", F.lit(2)).rlike(r"^\(.+\)"))
        .select("pos", blank(F.get("words", F.lit(1))).alias("plural"), blank(F.substring_index(F.substring_index(F.get("words", F.lit(2)), ")", 1), "(", -1)).alias("singular"))
    )
    # every row takes the last heading before it: two short lists of one file
    rows = _table(spark, path).select(F.col("pos").alias("at"), F.get("cells", F.lit(0)).alias("cell")).where(~F.col("cell").isin("", "Objectname"))
    above = rows.join(F.broadcast(headings), F.col("pos") < F.col("at")).groupBy("at", "cell").agg(F.max_by("plural", "pos").alias("plural")).withColumnRenamed("at", "pos")
    return _entries(above, "objects", blank(F.col("cell")), F.col("plural")).unionByName(_entries(headings, "categories", F.col("singular"), F.col("plural")))


def read_catalog(spark: SparkSession, folder: str, names: str = "names/names.md", rooms: str = "maps/room_names.md", locations: str = "maps/location_names.md", objects: str = "objects/objects.md") -> DataFrame:
    """All catalogs of a folder in one long frame."""
    return (
        read_single_column(spark, f"{folder}/{names}", "names")
        .unionByName(read_single_column(spark, f"{folder}/{rooms}", "rooms"))
        .unionByName(read_locations(spark, f"{folder}/{locations}"))
        .unionByName(read_objects(spark, f"{folder}/{objects}"))
    )


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of the list ``patterns`` in a YAML file; stripped, blanks dropped.

    PyYAML is used where it is installed; a plain block list is read without it.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        listed = (yaml.safe_load(text) or {}).get("patterns", [])
    except ImportError:
        listed, inside = [], False
        for line in text.splitlines():
            if not line.startswith((" ", "-", "\t", "#")) and line.strip():
                inside = line.split(":")[0].strip() == "patterns"
            elif inside and line.strip().startswith("- "):
                listed.append(line.strip()[2:].strip().strip("\"'"))
    if not isinstance(listed, list):
        raise ValueError(f"patterns must be a list in {path}")
    return spark.createDataFrame([(str(v).strip(),) for v in listed if str(v).strip()], "value string")


def from_rows(catalog: DataFrame) -> DataFrame:
    """The long form of a catalog table with ``entry_group, entry_value, pos, parent``."""
    return catalog.select(F.col("entry_group").alias("group"), F.col("entry_value").alias("value"), "pos", "parent")
