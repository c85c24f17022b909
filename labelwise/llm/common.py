"""Helpers shared by the operators of this subpackage.

Text is handed to Python in Arrow batches as UTF-8 bytes.  ``bytes.split()``
cuts at exactly U+0020 and U+0009..U+000D, so its pieces are the words
``[^\\x20\\x09-\\x0D]+`` of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(key: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores in front as it takes not to
    clash (ignoring case) with a column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def append_columns(
    df: DataFrame, make: Callable[[], Callable[[list], Sequence]], text: str, fields: Sequence[tuple[str, str]]
) -> DataFrame:
    """``df`` plus ``fields`` computed from the text column in one Arrow pass.

    ``make()`` runs once per task and returns a function from the batch's
    texts (bytes or None) to one sequence per field.  Names must be free in
    ``df`` (see ``fresh_names``).
    """
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType(list(df.schema.fields) + list(added.fields))
    kinds = [T._parse_datatype_string(t) for _, t in fields]
    column = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = make()
        for b in batches:
            if not b.num_rows:
                continue
            new = work(b.column(column).cast(pa.binary()).to_pylist())
            arrays = [pa.array(v, to_arrow_type(k)) for v, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *arrays], names=[*b.schema.names, *[n for n, _ in fields]]
            )

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it instead
    of running its plan again, and a lost executor costs nothing but a
    re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
