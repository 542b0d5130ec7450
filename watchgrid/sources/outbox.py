"""Streaming sink: messages of a bounded number of rows, each row delivered exactly once.

Tasks write their messages as JSON lines into staged files. A batch is delivered by its entry in a ledger, which
names its files and is put in place by one rename; what no entry names was never delivered. A batch that runs again
after its entry was made finds it and drops its new files, and a batch that failed leaves none. A ledger belongs to
one query: it is named by the path, so each query needs its own.

A message of one row is that row; one of several is {"type": "batch", "messages": [...], "count": n}.

Options: path, and most, the rows of a message.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from watchgrid.sources.tail import opened

MOST, EVERY = 50, "100 milliseconds"


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    messages: int
    rows: int


def message(rows: list[str]) -> str:
    return rows[0] if len(rows) == 1 else f'{{"type":"batch","messages":[{",".join(rows)}],"count":{len(rows)}}}'


class OutboxWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("most", MOST))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """One file of messages for the task's rows; none if it has no rows."""
        where, top = opened(self.path)
        name, held, messages, rows, out = f"{uuid.uuid4().hex}.jsonl", [], 0, 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                held.append(json.dumps(row, default=str, ensure_ascii=False))
                rows += 1
                if out is None:
                    where.create_dir(f"{top}/staged", recursive=True)
                    out = where.open_output_stream(f"{top}/staged/{name}")
                if len(held) == self.most:
                    out.write(message(held).encode() + b"\n")
                    held, messages = [], messages + 1
        if held:
            out.write(message(held).encode() + b"\n")
            messages += 1
        if out is not None:
            out.close()
        return Staged(name if out is not None else None, messages, rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        where, top = opened(self.path)
        entry = f"{top}/ledger/{batchId:012d}.json"
        if where.get_file_info(entry).type == fs.FileType.File:
            self.abort(messages, batchId)
            return
        where.create_dir(f"{top}/ledger", recursive=True)
        staged = [m for m in messages if m and m.file]
        draft = f"{top}/staged/{uuid.uuid4().hex}.draft"
        where.create_dir(f"{top}/staged", recursive=True)
        with where.open_output_stream(draft) as f:
            f.write(json.dumps({"batch": batchId, "files": [m.file for m in staged], "messages": sum(m.messages for m in staged), "rows": sum(m.rows for m in staged)}).encode())
        where.move(draft, entry)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        where, top = opened(self.path)
        for m in messages:
            if m and m.file:
                where.delete_file(f"{top}/staged/{m.file}")


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema: object, overwrite: bool) -> OutboxWriter:
        return OutboxWriter({k.lower(): v for k, v in self.options.items()})


def deliver(stream: DataFrame, path: str, checkpoint: str, most: int = MOST, every: str | None = EVERY) -> StreamingQuery:
    """Start delivering a stream's rows every so often, at most so many in a message; with every None, what is there once."""
    stream.sparkSession.dataSource.register(Outbox)
    writer = stream.writeStream.format("outbox").options(path=path, most=str(most)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """batch, message and the number of rows of each message delivered."""
    entries = spark.read.schema("batch long, files array<string>").json(f"{path}/ledger/*.json").select("batch", F.explode("files").alias("file"))
    lines = spark.read.text(f"{path}/staged/*.jsonl").select(F.col("value").alias("message"), F.substring_index(F.input_file_name(), "/", -1).alias("file"))
    count = F.coalesce(F.get_json_object("message", "$.count").cast("int"), F.lit(1))
    several = F.get_json_object("message", "$.type") == "batch"
    return lines.join(entries, "file").select("batch", "message", F.when(several, count).otherwise(1).alias("n"))
