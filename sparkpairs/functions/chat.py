"""Chat formatting (F9-F13): messages, template rendering, JSON export, masking split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkpairs.functions.constants import RESPONSE_PART, TURN_END, TURN_START
from sparkpairs.functions.text import col_, mark_content, py_strip

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), col_(content).alias("content"))


def to_messages(system, original, corrected=None) -> Column:
    """system, marked user turn, and (for training) the assistant turn."""
    msgs = [message("system", system), message("user", mark_content(original))]
    if corrected is not None:
        msgs.append(message("assistant", corrected))
    return F.array(*msgs)


def render_chat(messages, add_generation_prompt: bool = False, system_mode: str = "fold") -> Column:
    """turn-based chat template without the leading BOS token.

    ``fold``: a leading system message becomes a prefix of the first turn
    (followed by a blank line); ``own_turn``: it is rendered as its own user
    turn. ``assistant`` is rendered as ``model``; turn contents are stripped.
    """
    msgs = col_(messages)
    first = F.element_at(msgs, 1)
    if system_mode == "fold":
        has_sys = (F.size(msgs) > 0) & (first["role"] == "system")
        prefix = F.when(has_sys, F.concat(first["content"], F.lit("\n\n"))).otherwise(F.lit(""))
        loop = F.when(has_sys, F.slice(msgs, 2, F.greatest(F.size(msgs) - 1, F.lit(0)))).otherwise(msgs)
    elif system_mode == "own_turn":
        prefix = F.lit("")
        loop = msgs
    else:
        raise ValueError(f"unknown system_mode {system_mode!r}")

    def turn(m, i):
        role = F.when(m["role"].isin("assistant"), F.lit("model")) \
                .when(m["role"] == "system", F.lit("user")).otherwise(m["role"])
        return F.concat(F.lit(TURN_START), role, F.lit("\n"),
                        F.when(i == 0, prefix).otherwise(F.lit("")),
                        py_strip(m["content"]), F.lit(TURN_END + "\n"))

    body = F.array_join(F.transform(loop, turn), "")
    if add_generation_prompt:
        body = F.concat(body, F.lit(RESPONSE_PART))
    return body


def json_string(c) -> Column:
    """A JSON string literal (quotes and escapes included) for a string column."""
    j = F.to_json(F.array(col_(c)))
    return F.substring(j, 2, F.length(j) - 2)


def chat_json(messages) -> Column:
    """``{"conversations": [...]}`` with Python's default separators."""
    def one(m):
        return F.concat(F.lit('{"role": '), json_string(m["role"]), F.lit(', "content": '),
                        json_string(m["content"]), F.lit("}"))
    return F.concat(F.lit('{"conversations": ['), F.array_join(F.transform(col_(messages), one), ", "), F.lit("]}"))


def prompt_part(text, response_part: str = RESPONSE_PART) -> Column:
    """text before the first response marker (all of it when absent)."""
    t = col_(text)
    pos = F.instr(t, response_part)
    return F.when(pos > 0, F.substring(t, 1, pos - 1)).otherwise(t)


def response_part_text(text, response_part: str = RESPONSE_PART) -> Column:
    """text after the first response marker, the part that is trained on."""
    t = col_(text)
    pos = F.instr(t, response_part)
    return F.when(pos > 0, F.substring(t, pos + len(response_part), 2147483647)).otherwise(F.lit(""))
