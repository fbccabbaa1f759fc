"""Python data source "arrow_stripes": folders of Arrow IPC stream stripes, plain or compressed as a whole.

A folder has stripe_<n>.arrow files, each a schema and record batches, as one zstd or lz4 frame or bare; beside a
stripe there may be stripe_<n>.deleted, a bitmap whose bit i (lowest first) says that row i is deleted. Options:
path, a folder on a file system that pyarrow opens on the driver and on all executors; keep_deleted, to leave the bitmaps out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

_NAME = re.compile(r"stripe_(\d+)\.arrow$")
# The first bytes of a frame.
MAGIC = {b"\x28\xb5\x2f\xfd": "zstd", b"\x04\x22\x4d\x18": "lz4"}


def _files(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/(?!/)", "file:///", path)  # as Hadoop writes it
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def stripe_files(path: str) -> list[tuple[int, str]]:
    """(number, file) of a folder's stripes, by number."""
    from pyarrow import fs

    store, root = _files(path)
    found = [(int(m[1]), f.path) for f in store.get_file_info(fs.FileSelector(root)) if (m := _NAME.search(f.path))]
    return sorted(found)


def read_stripe(store, file: str) -> pa.Table:
    with store.open_input_stream(file, compression=None) as raw:
        data = raw.read()
    codec = MAGIC.get(data[:4])
    stream = pa.input_stream(pa.BufferReader(data), compression=codec) if codec else pa.BufferReader(data)
    table = pa.ipc.open_stream(stream).read_all()
    for i, f in enumerate(table.schema):
        if pa.types.is_fixed_size_binary(f.type) and f.type.byte_width == 16:  # uuid, as canonical text
            import uuid

            text = pa.chunked_array([pa.array([None if x is None else str(uuid.UUID(bytes=x)) for x in table.column(i).to_pylist()], pa.string())])
            table = table.set_column(i, f.name, text)
    return table


def live(table: pa.Table, bitmap: bytes) -> pa.Table:
    import numpy as np

    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[: len(table)]
    dead = np.zeros(len(table), bool)
    dead[: len(bits)] = bits.astype(bool)
    return table.filter(pa.array(~dead))


class _Stripe(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)


class _Reader(DataSourceReader):
    def __init__(self, path: str, keep_deleted: bool):
        self.path, self.keep_deleted = path, keep_deleted

    def partitions(self) -> list[InputPartition]:
        return [_Stripe(f) for _, f in stripe_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = _files(self.path)
        table = read_stripe(store, partition.value)
        bitmap = re.sub(r"\.arrow$", ".deleted", partition.value)
        if not self.keep_deleted and store.get_file_info(bitmap).type != fs.FileType.NotFound:
            with store.open_input_stream(bitmap) as f:
                table = live(table, f.read())
        yield from table.to_batches()


class _Writer(DataSourceWriter):
    """Each task writes its rows as stripes of its own; numbers are dealt out by task, so they leave gaps."""

    def __init__(self, path: str, codec: str, rows: int, schema: StructType):
        self.path, self.codec, self.rows, self.schema = path, codec, rows, schema

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from itertools import islice

        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        store, root = _files(self.path)
        store.create_dir(root)
        kind = to_arrow_schema(self.schema)
        at = TaskContext.get().partitionId() * 1_000_000 + 1
        while part := list(islice(rows, self.rows)):
            table = pa.Table.from_pylist([r.asDict() for r in part], kind)
            sink = pa.BufferOutputStream()
            out = pa.CompressedOutputStream(sink, self.codec) if self.codec != "none" else sink
            with pa.ipc.new_stream(out, kind) as w:
                w.write_batch(table.combine_chunks().to_batches()[0])
            if out is not sink:
                out.close()
            with store.open_output_stream(f"{root}/stripe_{at:06d}.arrow") as f:
                f.write(sink.getvalue())
            at += 1
        return WriterCommitMessage()


class ArrowStripes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_stripes"

    def schema(self) -> StructType:
        files = stripe_files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no stripes to take a schema from")
        return from_arrow_schema(read_stripe(_files(self.options["path"])[0], files[0][1]).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], str(self.options.get("keep_deleted", "false")).lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("codec", "none"), int(self.options.get("rows", "10000")), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowStripes)
