"""Conversations as training text, by Spark expressions alone.

A conversation's turns are collected as structs and sorted; adjacent turns of one
role become one block; escaped texts and the template's marks are concatenated.
Escaping is reversible: a backslash goes behind the first character of whatever
reads like a control string, and one more if there are some already, so that no
text can hold a mark.  Everything is linear in the length of a conversation,
which must fit a row, as its formatted text does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of widespread chat formats; no text keeps one of them in clear.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>")


@dataclass(frozen=True)
class Template:
    """The marks of a block: ``open``, the role, a line break, texts with ``between`` them, ``close``.

    Marks are control strings: each begins with ``<`` or ``[``, and none can
    begin inside another one.  Texts of the role ``learnt`` are under the loss.
    """

    open: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    learnt: str = "assistant"
    control: tuple[str, ...] = CONTROL

    def __post_init__(self):
        marks = self.strings()
        if any(len(m) < 3 or m[0] not in "<[" or "\\" in m or "\n" in m for m in marks):
            raise ValueError("control strings begin with < or [ and hold no backslash or line break")
        if any(a[i:].startswith(b) or b.startswith(a[i:]) for a in marks for b in marks for i in range(a is b or a == b, len(a)) if i or a != b):
            raise ValueError("control strings may not overlap")

    def strings(self) -> list[str]:
        return list(dict.fromkeys((self.open, self.between, self.close, *self.control)))

    def pattern(self, backslashes: str) -> str:
        rests = "|".join(re.escape(m[1:]) for m in self.strings())
        return rf"([<\[]){backslashes}({rests})"


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern(r"(\\*)"), r"$1\\$2$3")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern(r"\\(\\*)"), "$1$2$3")


def _quoted(mark: str) -> str:
    return re.escape(mark)


def merged_blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, blocks): each conversation's blocks as (role, texts), in order.

    Rows are sorted by turn, null turns first, equal turns by role and text.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    sorted_turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns, starts = F.col("turns"), F.col("starts")
    at = lambda i: F.get(turns, i)["role"]
    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(turns))
    blocks = F.transform(starts, lambda s, k: F.struct(at(s).alias("role"), F.transform(F.slice(turns, s + 1, ends(k) - s), lambda t: t["text"]).alias("texts")))
    return sorted_turns.select("conv_id", "turns", begins.alias("starts")).select("conv_id", blocks.alias("blocks"))


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, segments) per conversation.

    segments (text, loss) are the formatted text cut at the borders of the loss
    mask: their texts, one after the other, are ``formatted``, and loss is true
    for each escaped text of the learnt role by itself.  A null role or text is
    the empty one; a null conv_id is a conversation of its own; repeated rows
    are turns of their own; an empty table gives no rows; other columns are
    ignored.  Roles are percent-encoded, so that any role can be read back.
    """

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def written(block: Column) -> Column:
        learnt, no = block["role"] == template.learnt, F.lit(False)
        texts = F.transform(block["texts"], lambda t: escape(t, template))
        head = F.concat(F.lit(template.open), F.url_encode(block["role"]), F.lit("\n"))
        by_text = F.flatten(F.transform(texts, lambda t, k: F.array(segment(F.when(k == 0, head).otherwise(template.between), no), segment(t, F.lit(True)))))
        whole = F.array(segment(F.concat(head, F.array_join(texts, template.between)), no))
        return F.concat(F.when(learnt, by_text).otherwise(whole), F.array(segment(F.lit(template.close + "\n"), no)))

    segments = merged_blocks(conversations).select("conv_id", F.flatten(F.transform("blocks", written)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with turns (role, text), parsed from its text, and loss_text, all text under the mask, unescaped."""

    def turns(block: Column) -> Column:
        body = F.substring_index(F.substr(block, F.instr(block, "\n") + 1), template.close, 1)
        role = F.url_decode(F.substring_index(block, "\n", 1))
        return F.transform(F.split(body, _quoted(template.between), -1), lambda t: F.struct(role.alias("role"), unescape(t, template).alias("text")))

    blocks = F.filter(F.split("formatted", _quoted(template.open), -1), lambda _, i: i > 0)
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(learnt, "")})


#: A conversation whose texts read like control strings.
PROBE = "</s>[INST] ok [/INST]"


def chat_report(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what is read back from the formatted conversations and a probe of id -7."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    back = read_back(format_conversations(own.unionByName(probe), template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
