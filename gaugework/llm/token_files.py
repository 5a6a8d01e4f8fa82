"""Token ids in Arrow stream files of fixed-size lists, read back without copies.

A file is an Arrow IPC stream.  Each record batch has the columns `ids` and `mask`, both fixed-size
lists of SEQUENCE entries, so sequence i of a batch is one slice of a memory-mapped buffer.  The
mask is true on tokens and false on the padding after a file's last token.  A side file holds the
documents (doc_id, start, n_tokens), starts counted within the file.  Files cover ranges of doc_id
in ascending order; a manifest of one row per file turns starts in a file into starts in the corpus.

Defined cases: a null text is empty (its end id only); a null doc_id stands first; rows that repeat
are documents of their own, in input-independent order of (doc_id, text); an empty table gives no file
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm import common
from gaugework.llm.encoding import id_encoder

SEQUENCE = 1024
#: Sequences in a record batch.
BATCH = 256
MANIFEST = "first_id long, file_no int, path string, n_docs long, n_tokens long"


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _list_type(dtype: np.dtype, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class _Writer:
    """One attempt's file: filled sequence by sequence, visible only through the manifest row of a task that ended."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, sequence: int) -> None:
        self.path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        self.dtype, self.sequence = dtype, sequence
        self.sink = system.open_output_stream(_open(f"{self.path}.arrows")[1])
        self.side = system.open_output_stream(_open(f"{self.path}.docs")[1])
        self.schema = _list_type(dtype, sequence)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs = pa.ipc.new_stream(self.side, self.docs_schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0

    def add(self, ids: list, encoded: list[bytes], end: int) -> None:
        tail = np.array([end], dtype=self.dtype)
        starts, sizes = [], []
        for x in encoded:
            a = np.frombuffer(x, dtype=self.dtype)
            starts.append(self.total)
            sizes.append(len(a) + 1)
            self.total += len(a) + 1
            self.held += len(a) + 1
            self.waiting += [a, tail]
        self.n_docs += len(ids)
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.docs_schema))
        if self.held >= self.sequence * BATCH:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.sequence * self.sequence
            self._write(flat[:whole], whole)
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, valid: int) -> None:
        step = self.sequence * BATCH
        for at in range(0, len(flat), step):
            part = flat[at : at + step]
            mask = pa.array(np.arange(at, at + len(part)) < valid)
            ids = pa.FixedSizeListArray.from_arrays(pa.array(part), self.sequence)
            self.out.write_batch(pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(mask, self.sequence)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            pad = -len(flat) % self.sequence
            self._write(np.concatenate([flat, np.zeros(pad, dtype=self.dtype)]), len(flat))
        for x in (self.out, self.docs, self.sink, self.side):
            x.close()


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end: int, sequence: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, writer, first = TaskContext.get().partitionId(), None, None
    encoder = id_encoder(tokenizer)
    for rows in batches:
        for lo in range(0, rows.num_rows, 500):
            some = rows.slice(lo, 500)
            ids = some.column(0).to_pylist()
            if writer is None:
                writer, first = _Writer(folder, part, encoder.dtype, sequence), ids[0]
            writer.add(ids, encoder.encode(some.column(1).to_pylist()), end)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([first], pa.int64()), pa.array([part], pa.int32()), pa.array([writer.path]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.total], pa.int64())],
            names=["first_id", "file_no", "path", "n_docs", "n_tokens"],
        )


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the files; returns the manifest (first_id, file_no, path, n_docs, n_tokens), itself a written table."""
    spark = docs.sparkSession
    common.prepare(spark)
    n = common.shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    ordered = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return common.materialize(ordered.mapInArrow(lambda it: _write(it, folder, tokenizer, end_id, sequence), MANIFEST), "token-manifest", f"{folder}/manifest")


class TokenFile:
    """Random access to one file: sequence(i) and mask(i) are views of the mapped file."""

    def __init__(self, path: str) -> None:
        system, name = _open(f"{path}.arrows")
        local = system.type_name == "local"
        self.source = pa.memory_map(name) if local else system.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = np.cumsum([0] + [b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.rows[-1])

    def _at(self, i: int, column: int):
        b = int(np.searchsorted(self.rows, i, side="right")) - 1
        lists = self.batches[b].column(column)
        size = lists.type.list_size
        return lists.values.slice((i - int(self.rows[b])) * size, size)

    def sequence(self, i: int) -> np.ndarray:
        return self._at(i, 0).to_numpy()

    def mask(self, i: int) -> pa.Array:
        return self._at(i, 1)

    def span(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids from start on, as views of the batches that hold them."""
        size = self.batches[0].column(0).type.list_size if self.batches else 1
        while length > 0:
            b = int(np.searchsorted(self.rows * size, start, side="right")) - 1
            inside = start - int(self.rows[b]) * size
            flat = self.batches[b].column(0).values
            piece = flat.slice(inside, min(length, len(flat) - inside)).to_numpy()
            yield piece
            start, length = start + len(piece), length - len(piece)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for row in rows.to_pylist():
            file = TokenFile(row["path"])
            system, name = _open(f"{row['path']}.docs")
            with system.open_input_stream(name) as f:
                for docs in pa.ipc.open_stream(f):
                    sums = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc = 0
                        for ids in file.span(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    base = row["base"]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), pa.array(docs.column(1).to_numpy() + base), docs.column(2), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document as the files have it: doc_id, start in the corpus, n_tokens, ids_crc32."""
    # One row per file, so this window's single task stays small.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))
    spark = manifest.sparkSession
    spread = files.repartition(common.shuffle_partitions(spark), "path")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
