"""Token-id files: flat unsigned integers with 64-bit document offsets, read through memory maps.

Documents are dealt by ranges of their id and sorted, each partition writes one ``.bin`` of ids (16 bits where the
vocabulary allows, else 32, little-endian), one ``.off`` of n + 1 offsets (unsigned 64-bit, in ids, from 0) and one
``.ids`` (Arrow) of document ids. The places of partitions in the whole are prefix sums over one manifest row for
each partition. Files are named after the task attempt and only those in the manifest count, so a lost or repeated
task leaves no half file in the result. Files lie in the shared folder, through its own file system.

Null and empty texts have the end id only. Null ids come first; equal ids are ordered by text. Repeated rows are
written as often as they occur. Columns other than id and text are ignored. An empty table has no parts.
"""

from __future__ import annotations

import bisect
import mmap
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, new_path, partitions, per_worker, strings
from .encoding import Encoder



def opened(uri: str):
    """File system and path of a URI, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The numbers of a file: a memory map where it is in a mounted folder, else its bytes."""
    from pyarrow import fs

    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            size = f.seek(0, 2)
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype) if size else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


@dataclass
class TokenFiles:
    """``parts``: (name, documents, ids, first document, first id) in order; the last two are prefix sums."""

    path: str
    dtype: str
    id_type: str
    parts: list[tuple[str, int, int, int, int]]

    @property
    def n_docs(self) -> int:
        return self.parts[-1][3] + self.parts[-1][1] if self.parts else 0

    @property
    def n_ids(self) -> int:
        return sum(p[2] for p in self.parts)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, through the maps."""
        if not 0 <= i < self.n_docs:
            raise IndexError(i)
        name, *_ = part = self.parts[bisect.bisect_right(self.parts, i, key=lambda p: p[3]) - 1]
        off = mapped(f"{self.path}/{name}.off", "<u8")
        a, b = off[i - part[3] : i - part[3] + 2].tolist()
        return mapped(f"{self.path}/{name}.bin", self.dtype)[a:b]

    def delete(self) -> None:
        """Delete the files; frames of ``read`` must not be used any more."""
        system, at = opened(self.path)
        system.delete_dir(at)

    def read(self, spark: SparkSession) -> DataFrame:
        """id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files."""
        path, dtype = self.path, self.dtype
        rows = spark.createDataFrame([(p[0], p[4]) for p in self.parts], "name string, base bigint").repartition(max(1, len(self.parts)), "name")

        def run(batches):
            for batch in batches:
                for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                    off, ids = mapped(f"{path}/{name}.off", "<u8").astype(np.int64), mapped(f"{path}/{name}.bin", dtype)
                    system, at = opened(f"{path}/{name}.ids")
                    with system.open_input_file(at) as f:
                        names = pa.ipc.open_file(f).read_all().column("id").combine_chunks()
                    for a in range(0, len(names), 10_000):
                        b = min(len(names), a + 10_000)
                        crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist())]
                        yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(base + off[a:b]), pa.array(np.diff(off[a : b + 1])), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

        return rows.mapInArrow(run, f"id {self.id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def write(docs: DataFrame, tokenizer: str, end_id: int | None = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write all ids in ascending order of document ids."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = id_text(docs, id_col, text_col)
    rows = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    system, at = opened(path)
    system.create_dir(at, recursive=True)
    width = np.dtype(dtype).itemsize
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        name, out, off, ids, n = f"part-{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}", None, None, None, 0
        system, at = opened(path)
        docs = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    encoder = per_worker(lambda: Encoder(tokenizer, dtype), (tokenizer, dtype))
                    out, off, raw = (system.open_output_stream(f"{at}/{name}.{x}") for x in ("bin", "off", "ids"))
                    ids = pa.ipc.new_file(raw, pa.schema([("id", batch.column("id").type)]))
                    off.write(np.zeros(1, "<u8"))
                lengths = np.empty(batch.num_rows, np.int64)
                for i, text in enumerate(strings(batch.column("text"))):
                    b = encoder.ids(text) + end
                    out.write(b)
                    lengths[i] = len(b) // width
                off.write((n + np.cumsum(lengths)).astype("<u8"))
                n, docs = n + int(lengths.sum()), docs + batch.num_rows
                ids.write_batch(pa.RecordBatch.from_arrays([batch.column("id")], ["id"]))
        finally:
            if out is not None:
                for f in (ids, raw, off, out):
                    f.close()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([t.partitionId()], pa.int32()), pa.array([name]), pa.array([docs]), pa.array([n])], ["part", "name", "docs", "ids"])

    # one row for each partition
    rows_of = sorted(rows.mapInArrow(run, "part int, name string, docs bigint, ids bigint").collect(), key=lambda r: r["part"])
    parts, d, n = [], 0, 0
    for r in rows_of:
        parts.append((r["name"], r["docs"], r["ids"], d, n))
        d, n = d + r["docs"], n + r["ids"]
    return TokenFiles(path, dtype, rows.schema["id"].dataType.simpleString(), parts)
