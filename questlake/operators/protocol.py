"""Parsing of model turns: visible actions and the strict raw protocol, as CASE chains in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from questlake.functions.text import lstrip, occurrences, strip

# Fixed values of the protocol.
ACTION = r"(?s)<(search|answer)>(.*?)</\1>"
RESERVED = r"</?(?:think|search|answer|information)>|<\|(?:im_end|endoftext)\|>"

INVALID = "invalid"


def has_information(raw: Column) -> Column:
    return raw.contains("<information>") | raw.contains("</information>")


def _action(raw: Column, reserved: bool) -> Column:
    kinds = F.regexp_extract_all(raw, F.lit(ACTION), F.lit(1))
    content = strip(F.get(F.regexp_extract_all(raw, F.lit(ACTION), F.lit(2)), F.lit(0)))
    ok = ~has_information(raw) & (F.size(kinds) == 1) & (F.coalesce(content, F.lit("")) != "")
    if reserved:
        ok = ok & ~F.coalesce(content, F.lit("")).rlike(RESERVED)
    return F.struct(F.when(ok, F.get(kinds, F.lit(0))).otherwise(INVALID).alias("type"), F.when(ok, content).otherwise("").alias("content"))


def parse_action(raw: Column) -> Column:
    """struct(type, content): the one search or answer element of a visible turn, else invalid."""
    return _action(raw, False)


def action_candidate(raw: Column) -> Column:
    """As parse_action, but content with a reserved tag is invalid too."""
    return _action(raw, True)


def strict_parts(raw: Column) -> tuple[Column, Column, Column, Column]:
    """(fits, reasoning, type, content) of a turn of one think element, white space, and one search or answer element that ends in the end
    token; only for texts in which the think tags stand once each. By places of tags, so nothing is matched twice."""
    close = F.instr(raw, "</think>")
    after = lstrip(F.substr(raw, close + len("</think>")))
    kind = F.when(F.startswith(after, F.lit("<search>")), "search").when(F.startswith(after, F.lit("<answer>")), "answer")
    head, tail = len("<search>"), len("</search><|im_end|>")  # the other kind's tags are as long
    ends = F.endswith(after, F.concat(F.lit("</"), kind, F.lit("><|im_end|>")))
    fits = F.startswith(raw, F.lit("<think>")) & (close > 0) & F.coalesce(ends, F.lit(False)) & (F.length(after) >= head + tail)
    begin = F.lit(len("<think>") + 1)
    return fits, F.substr(raw, begin, close - begin), kind, F.substr(after, F.lit(head + 1), F.length(after) - (head + tail))


def parse_raw(raw: Column, ended: Column) -> Column:
    """struct(strict_valid, valid_action, ended_with_im_end, reasoning_content, type, content, error).

    ``ended``: the last token is the end token.
    """
    fits, thought, kind, body = strict_parts(raw)
    reasoning, content = strip(thought), strip(body)
    error = (
        F.when(~F.coalesce(ended, F.lit(False)), "missing_im_end")
        .when(raw.contains("�"), "decode_error")
        .when((occurrences(raw, "<think>") != 1) | (occurrences(raw, "</think>") != 1), "invalid_think_count")
        .when(has_information(raw), "forged_information")
        .when(~fits, "raw_protocol_mismatch")
        .when(reasoning == "", "empty_think")
        .when(content == "", "empty_action")
        .when(reasoning.rlike(RESERVED), "reserved_tag_in_think")
        .when(content.rlike(RESERVED), "reserved_tag_in_action")
    )
    strict = error.isNull()
    never = error.isin("forged_information", "empty_action", "reserved_tag_in_action")
    valid = F.when(strict, True).when(never, False).otherwise(action_candidate(raw)["type"] != INVALID)
    return F.struct(
        strict.alias("strict_valid"),
        valid.alias("valid_action"),
        F.coalesce(ended, F.lit(False)).alias("ended_with_im_end"),
        F.when(strict, reasoning).otherwise("").alias("reasoning_content"),
        F.when(strict, kind).otherwise(INVALID).alias("type"),
        F.when(strict, content).otherwise("").alias("content"),
        error.alias("error"),
    )


def assistant_message(parsed: Column) -> Column:
    """The history message of a strictly valid turn; raises on others."""
    shown = F.concat(F.lit("<"), parsed["type"], F.lit(">"), parsed["content"], F.lit("</"), parsed["type"], F.lit(">"))
    message = F.struct(F.lit("assistant").alias("role"), shown.alias("content"), parsed["reasoning_content"].alias("reasoning_content"))
    return F.when(parsed["strict_valid"], message).otherwise(F.raise_error(F.lit("an invalid generation can't enter the history")).cast("struct<role:string,content:string,reasoning_content:string>"))
