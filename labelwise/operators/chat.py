"""Chat messages, prompt rendering and targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..spec import TaskSpec


@dataclass(frozen=True)
class ChatTemplate:
    """How a message list becomes one prompt string.

    Each message renders as ``open + role + role_sep + content + close``;
    the generation prompt (an opened assistant turn) is appended at the
    end.  Defaults follow the public ChatML layout.
    """

    open: str = "<|im_start|>"
    role_sep: str = "\n"
    close: str = "<|im_end|>\n"
    generation_role: str = "assistant"
    eos: str = "<|im_end|>"
    pad_id: int | None = None
    eos_id: int = 0

    def message(self, role: Column, content: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit(self.role_sep), content, F.lit(self.close))

    @property
    def generation_prompt(self) -> str:
        return f"{self.open}{self.generation_role}{self.role_sep}"

    @property
    def pad_token_id(self) -> int:
        """Own pad id, else the eos id."""
        return self.pad_id if self.pad_id is not None else self.eos_id


CHATML = ChatTemplate()


def user_turn(instruction, text, spec: TaskSpec) -> Column:
    i = F.col(instruction) if isinstance(instruction, str) else instruction
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(i, F.lit(spec.user_separator), t)


def messages(instruction, text, spec: TaskSpec) -> Column:
    """``[system(spec.system_prompt), user(instruction + sep + text)]``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(spec.system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user_turn(instruction, text, spec).alias("content")),
    )


def render(msgs, template: ChatTemplate = CHATML, add_generation_prompt: bool = True) -> Column:
    """Message array -> one prompt string."""
    m = F.col(msgs) if isinstance(msgs, str) else msgs
    body = F.array_join(F.transform(m, lambda x: template.message(x["role"], x["content"])), "")
    return F.concat(body, F.lit(template.generation_prompt)) if add_generation_prompt else body


def target(output, template: ChatTemplate = CHATML) -> Column:
    """Stripped label text followed by the end-of-sequence marker."""
    o = F.col(output) if isinstance(output, str) else output
    return F.concat(py_strip(o), F.lit(template.eos))


def with_prompts(records: DataFrame, spec: TaskSpec, template: ChatTemplate = CHATML) -> DataFrame:
    """Adds ``prompt`` and ``target`` to instruction records."""
    return records.withColumn("prompt", render(messages("instruction", "input", spec), template)).withColumn(
        "target", target("output", template)
    )


def flatten_messages(records: DataFrame, key: str, spec: TaskSpec) -> DataFrame:
    """P7 as rows: ``(key, pos, role, content)``."""
    return records.select(key, F.posexplode(messages("instruction", "input", spec)).alias("pos", "m")).select(
        key, "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def conversation_segments(conversations: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """P8 over a long message table ``(conv_id, turn, role, text)``.

    Every message renders independently (narrow, no grouping); the
    generation prompt is one extra segment after each conversation's last
    turn.  Concatenating segments in ``(conv_id, turn)`` order gives each
    conversation's prompt; nothing ever gathers a whole conversation into
    one row, so a conversation of any length is fine.  A null role or text
    counts as empty.
    """
    seg = conversations.select(
        "conv_id", "turn", template.message(_or_empty("role"), _or_empty("text")).alias("segment")
    )
    tail = conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn(
        "segment", F.lit(template.generation_prompt)
    )
    return seg.unionByName(tail)


def conversation_summary(conversations: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Per conversation: turns, role counts and rendered prompt length
    (messages plus the generation prompt).

    One aggregation of sums and counts: partial-aggregated map-side, so a
    conversation of any size costs one small row per task in the shuffle.
    """
    fixed = len(template.open) + len(template.role_sep) + len(template.close)
    seg_len = F.length(_or_empty("role")) + F.length(_or_empty("text")) + F.lit(fixed)  # = length of the rendered message
    return conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        (F.sum(seg_len) + F.lit(len(template.generation_prompt))).alias("prompt_chars"),
    )
