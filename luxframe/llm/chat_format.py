"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles checks the order of the turns.  Every turn becomes three segments
(head, text, tail); a segment carries its loss flag, and joining the segments gives the formatted text.
Control strings inside texts and roles are escaped by a backslash after their first character, backslashes are
doubled, a newline in a role gets a backslash in front; so ``\\x`` always stands for ``x`` and the formatted text can
be read back exactly.

Turns are ordered by turn, role and text (nulls first), so ties and repeated rows have a defined place and are all
kept.  Null roles and texts are empty; rows without a conversation id form one conversation.  Conversations in a wrong
order are formatted all the same, with ``valid`` false and the number of turns accepted before the first fault.
An empty table gives an empty result.  One conversation is one output row, so it is put together in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import pick


@dataclass(frozen=True)
class Template:
    """Markers, trained roles, control strings and the transitions of the role machine."""

    head: str = "<|im_start|>"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self):
        for marker in (self.head, self.tail):
            borders = [k for k in range(1, len(marker)) if marker[:k] == marker[-k:]]
            if borders or not any(marker.startswith(c) for c in self.controls):
                raise ValueError("a marker starts with a control string and must not overlap itself")
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _walk(turns: Column, template: Template) -> Column:
    """State after the last turn and the number of turns accepted so far; ``fault`` is never left."""
    moves = [(f"{state}>{role}", role) for state, roles in template.moves.items() for role in roles]
    table = F.create_map(*[F.lit(part) for move in moves for part in move])

    def step(walked: Column, turn: Column) -> Column:
        reached = F.coalesce(F.try_element_at(table, F.concat(walked["state"], F.lit(">"), turn["role"])), F.lit("fault"))
        good = walked["good"] + F.when(reached != "fault", 1).otherwise(0)
        return F.struct(reached.alias("state"), good.alias("good"))

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("good")), step)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, segments array<struct<text, loss>>, valid, good_turns`` of every conversation."""
    template = template or Template()
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string")
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    gathered = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def segments(turn: Column) -> Column:
        role = F.replace(escape(turn["role"], template), F.lit("\n"), F.lit("\\\n"))
        head = F.concat(F.lit(template.head), role, F.lit("\n"))
        parts = [
            (head, F.lit(False)),
            (escape(turn["text"], template), turn["role"].isin(*template.loss_roles)),
            (F.lit(template.tail), F.lit(False)),
        ]
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    walked = gathered.withColumn("walked", _walk(F.col("turns"), template))
    return walked.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.col("walked.state").isin(*template.final).alias("valid"),
        F.col("walked.good").alias("good_turns"),
    )


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: str, template: Template | None = None) -> Column:
    """``array<struct<role, text>>`` parsed from a formatted text."""
    template = template or Template()
    pieces = F.split(F.col(text), re.escape(template.tail).replace("\\\n", "\\n"))
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    shape = r"(?s)^((?:[^\\\n]++|\\.)*+)\n(.*)$"

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.head) + 1))
        found = [unescape(F.regexp_extract(body, shape, i)) for i in (1, 2)]
        return F.struct(found[0].alias("role"), found[1].alias("text"))

    return F.transform(turns, parse)


def loss_text(segments: str = "segments") -> Column:
    """Everything under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(output: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and checksums of a written output, read back from its texts and flags."""
    texts = output.select("conv_id", formatted().alias("formatted"), loss_text().alias("trained"), "valid")
    read = texts.withColumn("turns", read_turns("formatted", template))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
