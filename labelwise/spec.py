"""Task parameters for one binary text-classification task.

Every constant the operators need lives in a ``TaskSpec``; operators take
the spec as an argument, so the same plan runs on any vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class TaskSpec:
    instruction: str
    system_prompt: str
    positive: str
    negative: str
    # user turn = instruction + user_separator + text
    user_separator: str
    # Spellings (compared after strip + lower) that map to each class
    positive_aliases: tuple[str, ...]
    negative_aliases: tuple[str, ...]
    # Words that signal a class when they appear anywhere in an output
    positive_signals: tuple[str, ...]
    negative_signals: tuple[str, ...]
    # Display fallbacks
    undetermined_text: str = "undetermined"
    no_output_text: str = "no output"
    seed: int = 42
    max_length: int = 256
    ignore_index: int = -100
    failures_per_mode: int = 8
    snippet_chars: int = 120
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        # signals match as substrings: one inside an opposite one would hit both
        for a, b in ((self.positive_signals, self.negative_signals), (self.negative_signals, self.positive_signals)):
            inside = [(x, y) for x in a for y in b if x in y]
            if inside:
                raise ValueError(f"signal words contain opposite ones: {inside}")

    @property
    def labels(self) -> tuple[str, str]:
        """Fixed label order: positive first, then negative."""
        return (self.positive, self.negative)

    def with_(self, **kw) -> "TaskSpec":
        return replace(self, **kw)


# ---------------------------------------------------------------------------
# The strings and numbers of this spec, and the defaults above,
# must equal the original task's for identical prompts, label vocabulary and
# output parsing.
# ---------------------------------------------------------------------------
CHINESE_REVIEWS = TaskSpec(
    instruction="判断下面中文评论的情感倾向，只输出“正面”或“负面”。",
    system_prompt="你是中文情感分类器。请严格只输出“正面”或“负面”，不要解释。",
    positive="正面",
    negative="负面",
    user_separator="\n\n评论：",
    positive_aliases=("1", "positive", "pos", "正面", "好评"),
    negative_aliases=("0", "negative", "neg", "负面", "差评"),
    positive_signals=("正面", "积极", "好评"),
    negative_signals=("负面", "消极", "差评"),
    undetermined_text="无法判断",
    no_output_text="无输出",
)

# Vocabulary used when binding to the driver's (multilingual, mostly
# English) ``documents`` table.  Our own wording.
ENGLISH_REVIEWS = TaskSpec(
    instruction="Classify the sentiment of the review below. Answer only positive or negative.",
    system_prompt="You are a sentiment classifier. Answer with exactly one word: positive or negative.",
    positive="positive",
    negative="negative",
    user_separator="\n\nReview: ",
    positive_aliases=("1", "positive", "pos", "good"),
    negative_aliases=("0", "negative", "neg", "bad"),
    positive_signals=("positive", "favourable", "good"),
    negative_signals=("negative", "adverse", "bad"),
)
