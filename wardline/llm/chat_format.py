"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template says how the turn of each role opens and closes and which roles carry loss.  Control strings inside
a text are escaped, so a formatted conversation can be read back exactly: a backslash is doubled, and a single
backslash goes after the first character of a control string, which then is none any more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import require


@dataclass(frozen=True)
class Template:
    """Opening and closing marks by role, marks for any other role, roles with loss, and the allowed turns.

    Every mark starts with "<" or "[" and has no backslash; no opening mark starts with another one.  The
    opening of another role is `other[0]`, its name, `other[1]`.
    """

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    after: dict[str, tuple[str, ...]] = field(default_factory=dict)
    last: tuple[str, ...] = ()

    @property
    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))

    def __post_init__(self) -> None:
        if any(not m or m[0] not in "<[" or "\\" in m for m in self.controls):
            raise ValueError("a mark starts with < or [ and has no backslash")


CHAT = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("<<ROLE>>", "<<TEXT>>", "<</TEXT>>"),
    loss=frozenset({"assistant"}),
    # A conversation starts with an optional system turn; then users and assistants take turns.
    after={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    """`text` without any control string; `unescape` gives it back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    rests = [re.escape(m[1:]) for m in template.controls]
    return F.regexp_replace(text, f"([<\\[])({'|'.join(rests)})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _state(roles: Column, template: Template) -> Column:
    """The role of the last turn if all turns are allowed, else null."""
    edges = [f"{a}>{b}" for a, nexts in template.after.items() for b in nexts]
    step = lambda s, r: F.when(F.concat(s, F.lit(">"), r).isin(*edges), r)
    return F.aggregate(roles, F.lit("").cast("string"), step)


def format_chats(
    turns: DataFrame, template: Template = CHAT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: its id, valid, segments (text, loss), formatted, and spans (start, length) of the text under loss.

    Turns are ordered by number, role and text; a null text or role counts as empty.  valid: the machine takes
    every turn and ends in a state where a conversation may end; others are formatted all the same, and a role
    without marks is written with its name.  Spans count characters of `formatted` from 0.  Rows with a null id
    are one conversation.  A conversation is one row of the result, so its turns meet in one task.
    """
    rows = require(turns, conv_id, turn, role, text).toDF("id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce(F.col("role").cast("string"), F.lit("")), "text": F.coalesce("text", F.lit(""))})
    known = list(template.marks)
    pick = lambda k, other: F.coalesce(*[F.when(F.col("role") == r, F.lit(template.marks[r][k])) for r in known], other)
    named = F.concat(F.lit(template.other[0]), escape(F.col("role"), template), F.lit(template.other[1]))
    rows = rows.withColumns({"head": pick(0, named), "tail": pick(1, F.lit(template.other[2])), "body": escape(F.col("text"), template)})
    loss = F.col("role").isin(*template.loss) if template.loss else F.lit(False)
    rows = rows.select("id", F.struct("turn", "role", "text", "head", "body", "tail", loss.alias("loss")).alias("t"))
    chats = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    segment = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
    parts = F.flatten(F.transform("t", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["loss"]), segment(x["tail"], F.lit(False)))))
    end = _state(F.transform("t", lambda x: x["role"]), template)
    chats = chats.select("id", F.coalesce(end.isin(*template.last), F.lit(False)).alias("valid"), parts.alias("segments"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def place(acc: Column, s: Column) -> Column:
        n = F.char_length(s["text"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    spans = F.aggregate("segments", nothing, place, lambda acc: acc["spans"])
    return chats.select(F.col("id").alias(conv_id), "valid", "segments", formatted.alias("formatted"), spans.alias("spans"))


def parse_chats(chats: DataFrame, template: Template = CHAT, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation: its id, turns (role, text) and losses (the texts under loss), from `formatted` and `spans` alone."""
    closings = sorted({m[1] for m in template.marks.values()} | {template.other[2]}, key=lambda m: (-len(m), m))
    parts = F.split("formatted", "|".join(re.escape(c) for c in closings))
    # After the last closing mark nothing is left.
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        rest = F.substring(p, len(template.other[0]) + 1, 2**31 - 1)
        at = F.locate(template.other[1], rest)
        role, body = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + len(template.other[1]), F.lit(2**31 - 1))
        for name, (head, _) in template.marks.items():
            own = F.startswith(p, F.lit(head))
            role = F.when(own, F.lit(name)).otherwise(role)
            body = F.when(own, F.substring(p, len(head) + 1, 2**31 - 1)).otherwise(body)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    losses = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select(conv_id, F.transform(parts, turn).alias("turns"), losses.alias("losses"), F.char_length("formatted").cast("long").alias("formatted_chars"))
