"""JSON-lines and benchmark readers, report and record writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions import goals as G
from planloom.functions import validate as V
from planloom.functions.columns import strip, text_key
from planloom.operators.plans import once, source_row_problem
from planloom.functions.payload import goals_json

META = "struct<family:string,category:string,difficulty:string,surface_template_id:string,goal_signature:array<string>,entity_kinds:array<string>,slot_names:array<string>>"
RECORD = f"id string, input string, goals array<string>, response string, family string, meta {META}"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD, max_rows: int = 0, meta_as_text: bool = False) -> DataFrame:
    """Rows of a JSON-lines file with ``row_id`` (file order within a split); ``max_rows`` 0 reads all.

    With ``meta_as_text`` the meta field is kept as JSON text, as older files hold it.
    """
    wanted = schema.replace(f"meta {META}", "meta string") if meta_as_text else schema
    rows = spark.read.schema(wanted).json(path).withColumn("row_id", F.monotonically_increasing_id())
    return rows.orderBy("row_id").limit(max_rows) if max_rows > 0 else rows


def benchmark_problems(df: DataFrame) -> DataFrame:
    """``row_id, id, problem`` of the cases that may not be scored.

    Ids must be present and unique, inputs present and unique but for case and white
    space, plans valid.  Uniqueness is counted, the copies are not gathered.
    """
    rows = once(df, parsed=G.parse_goals(F.col("goals")), __key=text_key(F.coalesce("input", F.lit(""))))
    rows = once(rows, __bad=F.size(V.issues(F.col("goals"), F.col("parsed"))) > 0)
    ids = rows.groupBy("id").agg(F.count("*").alias("__ids"), F.min("row_id").alias("__id_first"))
    texts = rows.groupBy("__key").agg(F.min("row_id").alias("__text_first"))
    checked = rows.join(ids, rows["id"].eqNullSafe(ids["id"])).drop(ids["id"]).join(texts, "__key")
    problem = (
        F.when(F.col("id").isNull() | (strip(F.col("id")) == ""), "missing id")
        .when((F.col("__ids") > 1) & (F.col("row_id") > F.col("__id_first")), "duplicate id")
        .when(F.col("__key") == "", "empty input")
        .when(F.col("row_id") > F.col("__text_first"), "duplicate input")
        .when(F.col("__bad"), "invalid goals")
    )
    return checked.select("row_id", "id", problem.alias("problem")).where("problem is not null")


def load_benchmark(df: DataFrame, families: list[str] | None = None, max_rows: int = 0) -> DataFrame:
    """The checked cases: problems raise before anything is filtered or cut."""
    bad = benchmark_problems(df).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    out = df.where(F.coalesce("meta.family", F.lit("unknown")).isin(*families)) if families else df
    return out.orderBy("row_id").limit(max_rows) if max_rows > 0 else out


def training_rows(df: DataFrame) -> DataFrame:
    """``row_id, input, response, family, category, problem``; ``problem`` is null for usable rows."""
    rows = once(df, parsed=G.parse_goals(F.col("goals")))
    return rows.select(
        "row_id",
        "input",
        goals_json(F.col("goals")).alias("response"),
        F.coalesce("family", "meta.family", F.lit("unknown")).alias("family"),
        F.coalesce("meta.category", F.lit("unknown")).alias("category"),
        source_row_problem(F.col("input"), F.col("goals"), F.col("parsed")).alias("problem"),
    )


def write_jsonl(df: DataFrame, path: str, columns: list[str], order: str | None = None) -> None:
    """One JSON object per row, fields in the given order."""
    rows = df.orderBy(order) if order else df
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def write_checked(df: DataFrame, path: str, columns: list[str], problem: str = "problem", order: str | None = None) -> None:
    """:func:`write_jsonl` behind a gate: rows with a ``problem`` raise and nothing is written."""
    bad = df.where(F.col(problem).isNotNull()).groupBy(problem).agg(F.count("*").alias("n")).orderBy(F.desc("n"), problem).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['n']} x {r[problem]}" for r in bad))
    write_jsonl(df, path, columns, order)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, cases: DataFrame, path: str) -> None:
    """Report and cases as two JSON folders under ``path``."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    cases.write.mode("overwrite").json(f"{path}/cases")
