"""Chat formatting with a grammar and its parser.

    conversation = { turn }
    turn         = "<|im_start|>" role [" null" | " esc"] "\\n" content "<|im_end|>\\n"

No marker may occur in content. A role is letters, digits, "_" and "-", with all else as %XX of its UTF-8; a null role is
"~". The rendered text is parsed again and compared with the source; turns that don't come back are escaped (one more
backslash in every "<", backslashes, "|") until the whole conversation does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
MARKERS = (START, "<|im_end|>")
HEADER = re.compile(r"<\|im_start\|>(~|(?:[A-Za-z0-9_-]|%[0-9A-F]{2})*)( null| esc)?\n")
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
Turn = tuple[str | None, str | None]


def render_role(role: str | None) -> str:
    return "~" if role is None else "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "".join(f"%{b:02X}" for b in c.encode()) for c in role)


def render(turns: list[Turn], escaped: set[int] = frozenset()) -> str:
    out = []
    for i, (role, text) in enumerate(turns):
        flag = " null" if text is None else " esc" if i in escaped else ""
        out += [START, render_role(role), flag, "\n", ESCAPE.sub(r"<\\\1|", text or "") if i in escaped else text or "", END]
    return "".join(out)


def parse(text: str) -> list[Turn] | None:
    """The turns; None if the text isn't in the grammar. Reads each character once, from left to right."""
    turns: list[Turn] = []
    at = 0
    while at < len(text):
        m = HEADER.match(text, at)
        end = text.find(END, m.end()) if m else -1
        if end < 0:
            return None
        content = text[m.end() : end]
        if any(x in content for x in MARKERS) or (m[2] == " null" and content):
            return None
        turns.append((None if m[1] == "~" else unquote(m[1]), None if m[2] == " null" else UNESCAPE.sub(r"<\1|", content) if m[2] else content))
        at = end + len(END)
    return turns


def format_turns(turns: list[Turn]) -> tuple[str, set[int]]:
    """(text that parses to the turns, numbers of the escaped ones)."""
    escaped: set[int] = set()
    while parse(text := render(turns, escaped)) != turns:
        more = {i for i, t in enumerate(turns) if i not in escaped and parse(render([t])) != [t]}
        if not more:
            raise ValueError("a conversation doesn't come back from its text")
        escaped |= more
    return text, escaped


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_escaped, rendered) of each conversation.

    Turns are in the order of turn, then role, then text, nulls first; repeated rows are repeated turns. Null roles and
    texts come back as nulls. Rows with a null conv_id make up one conversation, as in a GROUP BY. No rows, no
    conversations. Other columns aren't read.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, escaped, n = [], [], []
            for turns in batch.column(1).to_pylist():
                got, marked = format_turns([(t["role"], t["text"]) for t in turns])
                text.append(got)
                escaped.append(len(marked))
                n.append(len(turns))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(escaped, pa.int32()), pa.array(text, pa.string())], ["conv_id", "n_turns", "n_escaped", "rendered"])

    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).mapInArrow(run, "conv_id long, n_turns int, n_escaped int, rendered string")


#: For roles without characters that are written as %XX.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, role, text, coalesce(contains(text, '<|im_start|>') OR contains(text, '<|im_end|>'), false) AS esc FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(CASE WHEN esc THEN 1 ELSE 0 END) AS INTEGER) AS n_escaped,
       string_agg('<|im_start|>' || coalesce(role, '~') || CASE WHEN text IS NULL THEN ' null' WHEN esc THEN ' esc' ELSE '' END || chr(10)
                  || CASE WHEN esc THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE coalesce(text, '') END || '<|im_end|>' || chr(10),
                  '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM t GROUP BY conv_id
"""
