"""A streaming source that follows growing files.

Spark's own file stream takes a file once; log files grow. The offset of this
source is ``{path: [identity, bytes]}`` and a micro-batch is the byte ranges
between two offsets, cut so that one busy file feeds many tasks.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.listing import without_checksums
from ..sources.ranges import LINE_DDL, LINE_SCHEMA, RANGE_BYTES, complete_end, open_file, read_lines


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    identity: str


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.pattern = re.compile(options.get("namepattern", ""))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Identity and end of the last complete line of every file."""
        found: dict[str, list] = {}
        for root in self.roots:
            for folder, _, names in os.walk(root):
                for name in without_checksums(names):
                    path = os.path.join(folder, name)
                    if not self.pattern.search(name) or not os.path.isfile(path):
                        continue
                    try:
                        stat = os.stat(path)
                        with open_file(path) as f:
                            found[path] = [f"{stat.st_dev}-{stat.st_ino}", complete_end(f, stat.st_size)]
                    except OSError:  # gone since its folder was listed
                        continue
        return found

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        out = []
        for path, (identity, size) in end.items():
            known = start.get(path)
            # Another file under the name, or one that shrank, is read from the beginning.
            low = known[1] if known and known[0] == identity and known[1] <= size else 0
            for at in range(low, size, self.range_bytes):
                out.append(FileRange(path, at, min(at + self.range_bytes, size), identity))
        return out

    def read(self, partition: FileRange):
        """A file that is gone or replaced since the batch was planned gives no lines: the range was
        another file's, and the next batch reads the new one from its beginning."""
        try:
            for batch in read_lines(partition.path, partition.start, partition.end, identity=partition.identity):
                lines = batch.filter(pa.compute.is_null(batch.column("reason")))
                yield pa.RecordBatch.from_arrays(lines.columns[:5], schema=LINE_SCHEMA)
        except FileNotFoundError:
            return


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINE_DDL

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_stream(
    spark: SparkSession, roots: str | list[str], name_pattern: str = "", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Complete lines as they appear: path, chunk, offset, end_offset, line, bytes."""
    spark.dataSource.register(TailSource)
    stream = (
        spark.readStream.format("log_tail")
        .option("roots", json.dumps([roots] if isinstance(roots, str) else list(roots)))
        .option("namePattern", name_pattern)
        .option("rangeBytes", str(range_bytes))
        .load()
    )
    return stream.select(
        "path", F.col("start").alias("chunk"), "offset", "end_offset", F.col("line").cast("string").alias("line"),
        (F.col("end_offset") - F.col("offset")).alias("bytes"),
    )
