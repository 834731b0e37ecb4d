"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template names the markers, the roles that may follow each state and the roles whose
text is under the loss. Turns become text segments with a loss flag each; control strings
inside roles and texts are escaped so that the output can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, small_batches


@dataclass(frozen=True)
class Template:
    """``follow[state]`` are the roles that may come next (the state is the last role, at first ``start``);
    a conversation may end in one of ``final``. Every control string holds ``guard``, before whose
    second character an escaped text has ``escape``."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    after_turn: str = "\n"
    guard: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    follow: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}, hash=False)
    final: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        return text.replace(self.guard, self.guard[0] + self.escape + self.guard[1:])

    def escaped_role(self, role: str) -> str:
        """A role ends at a line feed, so its own become escape and ``n``."""
        return self.escaped(role).replace("\n", self.escape + "n")

    def unescaped(self, text: str, role: bool = False) -> str:
        one = re.escape(self.escape) + "(.)"
        return re.sub(one, lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)

    def segments(self, turns) -> list[tuple[str, bool]]:
        """Text segments of (role, text) turns in order, each with its loss flag."""
        out = []
        for role, text in turns:
            out.append((self.opening + self.escaped_role(role) + self.after_role, False))
            out.append((self.escaped(text), role in self.loss_roles))
            out.append((self.closing + self.after_turn, False))
        return out

    def is_valid(self, roles) -> bool:
        state = "start"
        for role in roles:
            if role not in self.follow.get(state, ()):
                return False
            state = role
        return state in self.final

    def read(self, text: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turn = re.compile(re.escape(self.opening) + "(.*?)" + re.escape(self.after_role) + "(.*?)" + re.escape(self.closing + self.after_turn), re.S)
        out, at = [], 0
        while at < len(text):
            found = turn.match(text, at)
            if not found:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescaped(found[1], True), self.unescaped(found[2])))
            at = found.end()
        return out


CHATML = Template()
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FORMATTED = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss_spans", SPAN), T.StructField("valid", T.BooleanType())])
READ = T.StructType([T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("loss_text", T.StringType())])


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", template: Template = CHATML) -> DataFrame:
    """One row per conversation: key, ``formatted`` text, ``loss_spans`` (code points of the formatted text whose tokens count
    in the loss, one span a turn) and ``valid`` (the machine accepts the order of roles).

    Turns stand in the order of ``order``; those of equal or null order by role, then text. Repeated rows
    are turns of their own. A null role or text is empty. A null key is a conversation of its own. No rows: no
    conversations. Other columns are left out. A conversation is one value of the result, so it needs to fit in a task.
    """
    small_batches(turns.sparkSession, 1000)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = turns.groupBy(F.col(key).alias(key)).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), empty(role).alias("role"), empty(text).alias("text")))).alias("turns")
    )

    def make():
        def apply(rows):
            texts, spans, valid = [], [], []
            for row in rows:
                parts = template.segments([(t["role"], t["text"]) for t in row])
                at, marked = 0, []
                for part, loss in parts:
                    if loss:
                        marked.append({"start": at, "end": at + len(part)})
                    at += len(part)
                texts.append("".join(p for p, _ in parts))
                spans.append(marked)
                valid.append(template.is_valid([t["role"] for t in row]))
            return [texts, spans, valid]

        return apply

    return append_columns(groups, "turns", FORMATTED, make).drop("turns")


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Replace what :func:`format_chats` made by ``turns`` (role and text, unescaped) and ``loss_text`` (the texts under the loss, joined),
    both read from the formatted text and its spans. ``formatted`` and ``valid`` stay."""

    def make():
        def apply(rows):
            turns = [[{"role": r, "text": t} for r, t in template.read(row["formatted"])] for row in rows]
            loss = ["".join(template.unescaped(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"]) for row in rows]
            return [pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), loss]

        return apply

    given = formatted.withColumn("both", F.struct("formatted", "loss_spans"))
    return append_columns(given, "both", READ, make).drop("both", "loss_spans")


def turns_digest(turns: Column) -> Column:
    """SHA-256 of role, line feed, text, line feed of every turn."""
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)
