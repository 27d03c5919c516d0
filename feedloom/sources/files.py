"""One file from many tasks: the rows are made and packed in parallel, one task writes them one after another, without a sort.

Each partition becomes a file of record batches beside the wanted one; their numbers are the order of the rows. The task that joins
them holds a batch at a time. Paths are what pyarrow's file systems and Hadoop both open, such as a shared folder or an hdfs address.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

Part = str | pa.RecordBatch


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it; of a local one as Hadoop writes it, without escapes."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:(//)?(?=/)", "", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _spooled(df: DataFrame, staged: str) -> list[str]:
    """The rows as files of record batches in ``staged``, in order; one for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (b for b in batches if b.num_rows)
        first = next(rows, None)
        if first is None:
            return
        task = TaskContext.get()
        name = f"{staged}/{task.taskAttemptId()}.part"
        system, inner = opened(name)
        with system.open_output_stream(inner) as file, pa.ipc.new_stream(file, first.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in chain([first], rows):
                out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"place": [task.partitionId()], "name": [name]})

    return [r["name"] for r in sorted(df.mapInArrow(run, "place long, name string").collect())]


def _batches(name: str) -> Iterator[pa.RecordBatch]:
    system, inner = opened(name)
    with system.open_input_stream(inner) as file, pa.ipc.open_stream(file) as batches:
        yield from batches


def whole_file(spark: SparkSession, path: str, parts: list[DataFrame | str], write: Callable[[Iterator[Part], pa.NativeFile], object]) -> None:
    """What ``write`` makes of the parts in order (texts, and the record batches of DataFrames), in one task, as the file ``path``.

    It appears under its name when it is whole: after a failure there is none. An existing file is an error.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    where = fs.makeQualified(where)
    if fs.exists(where):
        raise FileExistsError(path)
    staged = f"{where.toString()}.{uuid.uuid4().hex}.parts"
    fs.mkdirs(hadoop.Path(staged))
    try:
        listed = [p if isinstance(p, str) else _spooled(p, staged) for p in parts]

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                target = f"{staged}/{TaskContext.get().taskAttemptId()}.whole"
                system, inner = opened(target)
                with system.open_output_stream(inner) as file:
                    write((x for p in listed for x in ([p] if isinstance(p, str) else chain.from_iterable(map(_batches, p)))), file)
                yield pa.RecordBatch.from_pydict({"target": [target]})

        target = spark.range(0, 1, 1, 1).mapInArrow(joined, "target string").collect()[0][0]
        if not fs.rename(hadoop.Path(target), where):
            raise OSError(f"cannot name {path}")
    finally:
        fs.delete(hadoop.Path(staged), True)
