"""JSON inside model output, chat messages and training pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom.functions.columns import let


def json_block(text: Column) -> Column:
    """The first balanced ``{...}`` block, braces counted blindly; null if none closes."""

    def from_brace(tail: Column) -> Column:
        # only braces matter: positions where depth returns to zero, from a fold over the braces
        chars = F.split(tail, "")
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

        def step(acc: Column, ch: Column) -> Column:
            depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
            at = acc["at"] + 1
            end = F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"])
            return F.struct(at.alias("at"), depth.alias("depth"), end.alias("end"))

        end = F.aggregate(chars, start, step, lambda acc: acc["end"])
        return let(end, lambda e: F.when(e > 0, F.substring(tail, F.lit(1), e)))

    at = F.instr(text, "{")
    return F.when(at > 0, from_brace(F.substring(text, at, F.length(text))))


def extract_goals(text: Column) -> Column:
    """Goals of the first JSON block of a model output; null if there is no block or it does not parse."""
    return F.from_json(json_block(text), "goals array<string>", {"mode": "PERMISSIVE"})["goals"]


def prediction_payload(answer: Column) -> Column:
    """JSON text of what an answer holds under ``prediction``, else the answer itself; an empty object for what is no object."""
    inside = F.get_json_object(answer, "$.prediction")
    return F.coalesce(inside, F.when(F.from_json(answer, "map<string,string>").isNotNull() & F.startswith(F.trim(answer), F.lit("{")), answer), F.lit("{}"))


def cut_at(text: Column, stop: str) -> Column:
    """The text before the first stop token."""
    return F.substring_index(text, stop, 1)


def translation(raw: Column, usable: Column, goals: Column, normalized: Column, kept: int = 200) -> Column:
    """``struct<normalized_input, goals, error, raw>``: the payload, or the error with the head of the raw output."""
    return F.struct(
        normalized.alias("normalized_input"),
        F.when(usable, goals).alias("goals"),
        F.when(~usable, "no valid plan in output").alias("error"),
        F.when(~usable, F.substring(raw, 1, kept)).alias("raw"),
    )


def chat_messages(system: str, user: Column, assistant: Column | None = None) -> Column:
    """``array<struct<role, content>>`` of a chat prompt or training example."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    parts = [message("system", F.lit(system)), message("user", user)]
    if assistant is not None:
        parts.append(message("assistant", assistant))
    return F.array(*parts)


def goals_json(goals: Column) -> Column:
    return F.to_json(F.struct(goals.alias("goals")))


def training_pair(text: Column, goals: Column, family: Column, category: Column) -> Column:
    return F.struct(text.alias("input"), goals_json(goals).alias("response"), family.alias("family"), category.alias("category"))


def training_arrays(prompt_ids: Column, answer_ids: Column, limit: int = 512, ignore: int = -100) -> Column:
    """``struct<input_ids, attention_mask, labels>``: prompt positions are masked in the labels, all cut to ``limit``."""
    ids = F.slice(F.concat(prompt_ids, answer_ids), 1, limit)
    labels = F.slice(F.concat(F.transform(prompt_ids, lambda _: F.lit(ignore)), answer_ids), 1, limit)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"))


def pad(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def padded_width(longest: Column, multiple: int = 8) -> Column:
    """A batch's width: its longest row, rounded up to a multiple."""
    return (F.ceil(longest / multiple) * multiple).cast("int")


def list_lines(text: Column) -> Column:
    """Items of a Markdown list: lines that begin with '- ', '* ' or 'N.'."""
    lines = F.transform(F.split(text, "\\r?\\n"), lambda x: F.regexp_extract(x, r"^\s*(?:[-*]\s+|\d+\.\s*)(.*\S)\s*$", 1))
    return F.filter(lines, lambda x: x != "")
