"""Raw labelled text -> instruction records.

Plan shape at scale: the strip/filter/label steps are narrow (one codegen
stage over the scan).  Dedup groups on a SHA-256 digest of the text, so the
shuffle carries ~50 bytes per row instead of the text; the surviving keys
are then semi-joined back on the row key.  When the input is already
hash-partitioned by that key (e.g. it came out of a sort-merge join on it),
the semi-join re-uses that partitioning and the text is never shuffled
for dedup.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_is_valid, normalize_label
from ..functions.text import py_strip
from ..spec import TaskSpec

# Candidate column names, tried in this order (fixed values).
TEXT_COLUMNS = ("text", "review", "sentence", "comment", "content")
LABEL_COLUMNS = ("label", "labels", "sentiment")


def detect_column(df: DataFrame, preferred: Iterable[str], purpose: str) -> str:
    """The schema's column that stands earliest in ``preferred``."""
    order = {name: place for place, name in enumerate(preferred)}
    usable = order.keys() & set(df.columns)
    if not usable:
        raise KeyError(f"no {purpose} column: wanted one of {list(order)}, table has {sorted(df.columns)}")
    return min(usable, key=order.get)


def to_records(
    df: DataFrame,
    spec: TaskSpec,
    key: str = "row_idx",
    text_col: str | None = None,
    label_col: str | None = None,
    split_col: str | None = "split",
    class_names: dict[int, str] | None = None,
    strict: bool = True,
    keep: Sequence[str] = (),
    dedup: bool = True,
    null_text_as_none: bool = False,
) -> DataFrame:
    """P1-P5 + L5: ``(split, key, instruction, input, output, *keep)``.

    Text is stripped (Unicode whitespace), empty texts are dropped *before*
    the label is normalised (a bad label on an empty row is not an error),
    labels go through P4, and exact duplicates of (text, label) within a
    split keep the row with the smallest ``key`` (first wins).  A null text
    is dropped, or with ``null_text_as_none`` becomes the text ``"None"``
    (the original's ``str(None)``).
    """
    known = {*TEXT_COLUMNS, *LABEL_COLUMNS} & set(df.columns)
    if not known and not (text_col and label_col) and df.isEmpty():
        return _no_records(df, key, keep)  # an empty split may lack its columns
    text_col = text_col or detect_column(df, TEXT_COLUMNS, "text")
    label_col = label_col or detect_column(df, LABEL_COLUMNS, "label")
    has_split = split_col is not None and split_col in df.columns
    split = F.col(split_col) if has_split else F.lit("train")
    raw_text = F.col(text_col).cast("string")
    if null_text_as_none:
        raw_text = F.coalesce(raw_text, F.lit("None"))
    cleaned = F.when(raw_text.isNotNull(), py_strip(raw_text))
    staged = df.select(
        split.alias("split"),
        F.col(key),
        cleaned.alias("input"),
        F.col(label_col).alias("__label_raw"),
        *[F.col(c) for c in keep],
    ).filter(F.length("input") > 0)
    if strict:
        out_label = normalize_label(staged, "__label_raw", spec, class_names, strict=True)
    else:
        # quarantine: rows with unknown labels are dropped here; see
        # ``quarantined`` for the rejected rows.
        staged = staged.filter(label_is_valid(staged, "__label_raw", spec, class_names))
        out_label = normalize_label(staged, "__label_raw", spec, class_names, strict=False)
    records = staged.select(
        "split",
        key,
        F.lit(spec.instruction).alias("instruction"),
        "input",
        out_label.alias("output"),
        *keep,
    )
    return dedup_first(records, key) if dedup else records


def _no_records(df: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    kind = dict(df.dtypes)
    fields = ["split string", f"`{key}` {kind.get(key, 'bigint')}", "instruction string", "input string", "output string"]
    fields += [f"`{c}` {kind.get(c, 'string')}" for c in keep]
    return df.sparkSession.createDataFrame([], ", ".join(fields))


def records_from_pair(
    texts: DataFrame,
    labels: DataFrame,
    spec: TaskSpec,
    key: str,
    text_col: str | None = None,
    label_col: str | None = None,
    split_col: str = "split",
    class_names: dict[int, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """P1-P5 + L5 when texts and labels are two tables joined on ``key``
    (``labels`` carries the split).  Same result as ``to_records`` on their
    join, planned so that the text crosses the network at most once:

    1. narrow pass: sha256 + length of the stripped text are computed on
       the text scan itself, then joined to the labels (split, label) and
       grouped to the first key per (split, label, digest, length);
    2. the surviving keys (with split and label) are joined back: the only
       join that moves text.  How is left to the optimizer's sizes: it
       broadcasts a small key set (no text moves then), and can prune the
       text side of a shuffle join by a runtime bloom filter of the keys.
    Column names are detected (P1) when not given.
    """
    text_col = text_col or detect_column(texts, TEXT_COLUMNS, "text")
    label_col = label_col or detect_column(labels, LABEL_COLUMNS, "label")
    t = py_strip(F.col(text_col).cast("string"))
    narrow = texts.select(key, F.sha2(t, 256).alias("__d"), F.length(t).alias("__n"))
    lab = labels.select(key, F.col(split_col).alias("split"), F.col(label_col).alias("__label_raw"))
    staged = narrow.join(lab, key).filter(F.col("__n") > 0)
    staged = staged.select(
        key, "split", normalize_label(staged, "__label_raw", spec, class_names).alias("output"), "__d", "__n"
    )
    firsts = staged.groupBy("split", "output", "__d", "__n").agg(F.min(key).alias(key)).select(key, "split", "output")
    full = texts.select(key, t.alias("input"), *[F.col(c) for c in keep]).join(firsts, key)
    return full.select("split", key, F.lit(spec.instruction).alias("instruction"), "input", "output", *keep)


def quarantined(
    df: DataFrame,
    spec: TaskSpec,
    key: str = "row_idx",
    text_col: str | None = None,
    label_col: str | None = None,
    class_names: dict[int, str] | None = None,
) -> DataFrame:
    """Rows a strict run would fail on: non-empty text, unknown label."""
    text_col = text_col or detect_column(df, TEXT_COLUMNS, "text")
    label_col = label_col or detect_column(df, LABEL_COLUMNS, "label")
    ok = label_is_valid(df, label_col, spec, class_names)
    return df.filter((F.length(py_strip(F.col(text_col).cast("string"))) > 0) & ~ok).select(
        F.col(key), F.col(label_col).cast("string").alias("raw_label")
    )


def dedup_first(records: DataFrame, key: str, scope: Sequence[str] = ("split",)) -> DataFrame:
    """Keep the smallest ``key`` per (scope, output, input); ``key`` is
    unique within its scope.

    Same text with different labels keeps both; nothing is removed across
    scopes.  The group key is (scope, output, sha256(input), length(input)),
    so the shuffle moves fixed-width digests, never the text; map-side
    partial aggregation collapses hot duplicate groups before the shuffle.
    """
    digest = F.sha2(F.col("input"), 256)
    firsts = (
        records.groupBy(*scope, "output", digest.alias("__d"), F.length("input").alias("__n"))
        .agg(F.min(key).alias("__first"))
        .select(*[F.col(c).alias(f"__s_{c}") for c in scope], "__first")
    )
    # a row is named by (scope, key): keys may be numbered anew in each split
    same = F.col(key) == F.col("__first")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return records.join(firsts, on=same, how="left_semi")


def split_stats(records: DataFrame, spec: TaskSpec, splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """A1: records / positive / negative per split; absent splits show 0."""
    spark = records.sparkSession
    names = spark.createDataFrame([(s, i) for i, s in enumerate(splits)], "split string, split_ord int")
    counts = records.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("output") == spec.positive).alias("positive"),
        F.count_if(F.col("output") == spec.negative).alias("negative"),
    )
    return (
        names.join(counts, "split", "left")
        .select(
            "split",
            "split_ord",
            *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("records", "positive", "negative")],
        )
    )
