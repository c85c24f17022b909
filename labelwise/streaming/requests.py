"""A replayable source of prediction requests.

Requests are appended to a folder in numbered batches (``batch=1``, ``batch=2``,
...), each written in full before its ``_SUCCESS`` file.  The stream's offset is
the number of the last batch taken, so a query that restarts from its
checkpoint reads exactly the batches it had not finished: every request is
answered once.  Batches are never changed, and nothing is lost when a reader
dies: the folder is the log.

    spark.dataSource.register(RequestLog)
    requests = spark.readStream.format("request_log").load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.files import names_in, numbers_in
from ..sources.lines import python_file

SCHEMA = "request_id bigint, text string, mode string"


def append_requests(requests: DataFrame, folder: str) -> int:
    """Write the next batch; its number.  One writer at a time."""
    spark = requests.sparkSession
    done = [n for n in numbers_in(spark, folder, "batch") if "_SUCCESS" in names_in(spark, f"{folder}/batch={n}")]
    number = max(done, default=0) + 1
    requests.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return number


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int

    def __post_init__(self):
        super().__init__((self.path, self.group))


class RequestLog(DataSource):
    """Format ``request_log``; ``path`` is the folder."""

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RequestReader(self.options["path"], schema)


class RequestReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path.rstrip("/"), schema.names
        self.last = 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """The last batch of the unbroken run of finished ones."""
        fs, root = python_file(self.path)
        while fs.get_file_info(f"{root}/batch={self.last + 1}/_SUCCESS").type == pafs.FileType.File:
            self.last += 1
        return {"batch": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, root = python_file(self.path)
        self.last = max(self.last, end["batch"])
        out = []
        for n in range(start["batch"] + 1, end["batch"] + 1):
            files = fs.get_file_info(pafs.FileSelector(f"{root}/batch={n}"))
            for f in sorted((f.path for f in files if f.base_name.endswith(".parquet"))):
                with fs.open_input_file(f) as source:
                    groups = pq.ParquetFile(source).num_row_groups
                out += [RowGroup(f"{_scheme(self.path)}{f}", g) for g in range(groups)]
        return out

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        fs, inner = python_file(partition.path)
        with fs.open_input_file(inner) as source:
            table = pq.ParquetFile(source).read_row_group(partition.group, columns=self.names)
        kinds = pa.schema([("request_id", pa.int64()), ("text", pa.string()), ("mode", pa.string())])
        yield from table.select(self.names).cast(kinds).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is removed: the folder stays replayable."""


def _scheme(path: str) -> str:
    """What ``python_file`` takes off a path of this store."""
    if path.startswith("file:") or path.startswith("/"):
        return "file:"
    scheme, _, rest = path.partition("://")
    return f"{scheme}://{rest.partition('/')[0]}" if scheme == "hdfs" else f"{scheme}://"
