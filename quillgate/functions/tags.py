"""Reading and writing the ``<think>``/``<answer>`` layout of a completion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions.text import (
    as_col,
    bind,
    char_before_last,
    is_blank,
    rest_from,
    strip,
    stripped,
    text_or_empty,
)

# Tags of a completion and the markers around reference material.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
ANSWER_OPEN, ANSWER_CLOSE = "<answer>", "</answer>"
REFERENCE_BEGIN, REFERENCE_END = "【参考问答对】", "【问题】"


def _after(text: Column, tag: str) -> Column:
    return rest_from(text, F.instr(text, tag) + F.lit(len(tag)))


def _answer_in(tail: Column) -> Column:
    """Answer span of the part behind the think block; tolerant of missing tags."""

    def up_to_last_close(opened: Column) -> Column:
        return F.when(
            F.contains(opened, F.lit(ANSWER_CLOSE)), char_before_last(opened, ANSWER_CLOSE)
        ).otherwise(opened)

    def span(part: Column) -> Column:
        return F.when(F.contains(part, F.lit(ANSWER_OPEN)), bind(_after(part, ANSWER_OPEN), up_to_last_close)).otherwise(part)

    bare = F.replace(F.replace(bind(tail, span), F.lit(ANSWER_OPEN), F.lit("")), F.lit(ANSWER_CLOSE), F.lit(""))
    return strip(bare)


def _closed_think(text: Column) -> Column:
    head = F.substring_index(text, THINK_CLOSE, 1)
    return strip(F.replace(head, F.lit(THINK_OPEN), F.lit("")))


def parse_tolerant(value: Column | str) -> Column:
    """``struct<think, answer>``; without a closing think tag the whole text is the answer."""

    def parts(text: Column) -> Column:
        closed = F.contains(text, F.lit(THINK_CLOSE))
        return F.struct(
            F.when(closed, _closed_think(text)).otherwise("").alias("think"),
            _answer_in(F.when(closed, _after(text, THINK_CLOSE)).otherwise(text)).alias("answer"),
        )

    return bind(text_or_empty(value), parts)


def parse_diagnostic(value: Column | str) -> Column:
    """``struct<think, answer, format_ok, format_reason>``; never passes a cut-off think as an answer."""

    def parts(text: Column) -> Column:
        closed = F.contains(text, F.lit(THINK_CLOSE))
        first_open = F.instr(text, THINK_OPEN)
        unclosed = F.when(
            first_open > 0,
            strip(
                F.concat(
                    F.substring(text, F.lit(1), first_open - 1),
                    rest_from(text, first_open + F.lit(len(THINK_OPEN))),
                )
            ),
        ).otherwise("")
        return F.struct(
            closed.alias("closed"),
            F.when(closed, _closed_think(text)).otherwise(unclosed).alias("think"),
            F.when(closed, _answer_in(_after(text, THINK_CLOSE))).otherwise("").alias("answer"),
        )

    def diagnosed(p: Column) -> Column:
        reasons = F.concat_ws(
            "+",
            F.when(~p["closed"], "missing_think_close"),
            F.when(p["think"] == "", "empty_think"),
            F.when(p["answer"] == "", "empty_answer"),
        )
        return F.struct(
            p["think"].alias("think"),
            p["answer"].alias("answer"),
            (reasons == "").alias("format_ok"),
            F.when(reasons == "", "ok").otherwise(reasons).alias("format_reason"),
        )

    return bind(bind(text_or_empty(value), parts), diagnosed)


def tags_in_order(value: Column | str) -> Column:
    """First open think < first close think < first open answer behind it < last close answer."""

    def ordered(text: Column) -> Column:
        behind = _after(text, THINK_CLOSE)
        opened = F.instr(text, THINK_OPEN)
        return (
            (opened > 0)
            & (opened < F.instr(text, THINK_CLOSE))
            & F.contains(behind, F.lit(ANSWER_OPEN))
            & F.contains(_after(behind, ANSWER_OPEN), F.lit(ANSWER_CLOSE))
        )

    return bind(text_or_empty(value), ordered)


def references_of(value: Column | str, begin: str = REFERENCE_BEGIN, end: str = REFERENCE_END) -> Column:
    """Text between the two markers.

    No begin marker gives the empty string.  When the end marker is missing, or stands
    directly behind the begin marker, everything behind the begin marker is returned.
    """
    prompt = text_or_empty(value)
    body = _after(prompt, begin)
    cut = F.instr(body, end)
    chosen = F.when(cut > 1, F.substring(body, F.lit(1), cut - 1)).otherwise(body)
    return F.when(F.contains(prompt, F.lit(begin)), strip(chosen)).otherwise("")


def wrap_completion(think: Column | str, answer: Column | str) -> Column:
    return F.concat(
        F.lit(f"{THINK_OPEN}\n"),
        stripped(think),
        F.lit(f"\n{THINK_CLOSE}\n\n{ANSWER_OPEN}\n"),
        stripped(answer),
        F.lit(f"\n{ANSWER_CLOSE}"),
    )


def completion_text(messages: Column | str) -> Column:
    """Generated text of a message list: the content of its last message."""
    msgs = as_col(messages)
    return F.when(F.size(msgs) > 0, F.coalesce(F.element_at(msgs, -1)["content"], F.lit(""))).otherwise("")


def format_defaults(think: Column, answer: Column, format_ok: Column, format_reason: Column) -> tuple[Column, Column]:
    """Fill the two format columns of an inference row that was not parsed diagnostically."""
    ok = F.coalesce(format_ok, ~is_blank(think) & ~is_blank(answer))
    reason = F.coalesce(F.nullif(format_reason, F.lit("")), F.when(ok, "ok").otherwise("unmarked_empty"))
    return ok, reason
