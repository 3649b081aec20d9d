"""The boundary to a model: everything around the call is built in, the call is a plug-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions import goals as G
from planloom.functions.payload import chat_messages, cut_at, extract_goals, translation
from planloom.operators.plans import usable_payload


def translate(df: DataFrame, id_col: str, normalized: str, system: str, model: Callable, stop: str = "<|im_end|>") -> DataFrame:
    """Prompt, call and parse.  ``model(iterator of pandas frames)`` gets ``id, normalized_input, messages`` and yields ``id, normalized_input, output, elapsed_ms``.

    The plug-in runs once per task, so a model is loaded once per worker.
    """
    kind = df.schema[id_col].dataType.simpleString()
    prompts = df.select(id_col, F.col(normalized).alias("normalized_input"), chat_messages(system, F.col(normalized)).alias("messages"))
    called = prompts.mapInPandas(model, f"`{id_col}` {kind}, normalized_input string, output string, elapsed_ms double")
    parsed = called.withColumn("goals", extract_goals(cut_at(F.col("output"), stop)))
    parsed = parsed.withColumn("parsed", G.parse_goals(F.col("goals")))
    usable = usable_payload(F.col("goals"), F.col("parsed"))
    result = translation(F.trim(F.col("output")), usable, F.col("goals"), F.col("normalized_input"))
    return parsed.select(id_col, result.alias("r"), "elapsed_ms").select(id_col, "r.*", "elapsed_ms")
