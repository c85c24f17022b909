"""A Python model's answers leave a worker part by part."""

import pandas as pd
import pytest
from pyspark.sql import types as T

from labelwise.operators.score import PandasScorer
from labelwise.operators.workers import PART_CHARS

CALLS = []


class Frame:
    """Stands for a DataFrame: hands out what runs in a task."""

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])

    def mapInPandas(self, run, schema):
        return run


def _lengths():
    def model(texts):
        CALLS.append(len(texts))
        if any(t == "bad" for t in texts):
            raise ValueError("bad text")
        return [None if t is None else len(t) for t in texts]

    return model


def _batch():
    texts = ["x" * (PART_CHARS // 50)] * 200 + [None, "bad", "", "y"]
    return pd.DataFrame({"k": range(len(texts)), "t": texts})


def _answers(scorer, batches):
    parts = list(scorer.apply(Frame(), "k", "t")(iter(batches)))
    return parts, pd.concat(parts)


def test_answers_of_a_batch_leave_in_parts():
    CALLS.clear()
    batch = _batch()
    parts, out = _answers(PandasScorer(_lengths, batched=True, isolate=True, call_rows=8), [batch, batch[:0], batch[190:]])
    assert [len(p) for p in parts] == [56, 56, 56, 36, 14]
    assert out["k"].tolist() == [*range(204), *range(190, 204)]
    assert max(CALLS) == 8
    assert out["error"].notna().sum() == 2 and set(out.loc[out["error"].notna(), "t"]) == {"bad"}
    assert out["raw_output"].tolist()[:2] == [str(PART_CHARS // 50)] * 2 and out["raw_output"].tolist()[-4:] == ["", None, "0", "1"]


def test_calls_keep_their_size():
    CALLS.clear()
    batch = _batch()[:200]
    parts, out = _answers(PandasScorer(_lengths, batched=True), [batch])
    assert CALLS == [200] and len(parts) == 1 and len(out) == 200
    with pytest.raises(RuntimeError):
        _answers(PandasScorer(_lengths, batched=True, isolate=True, call_rows=8, most_errors=1), [pd.concat([_batch()] * 2)])


def test_single_texts_leave_in_parts():
    parts, out = _answers(PandasScorer(lambda: lambda t: "a"), [_batch()])
    assert len(parts) == 4 and out["raw_output"].tolist() == ["a"] * 204
