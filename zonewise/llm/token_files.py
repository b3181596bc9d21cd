"""Token ids in binary files: one zstandard frame per document, a shared dictionary, an offset index.

A store is a folder with

* ``dictionary.zdict``: the dictionary, trained on the serialized ids of a bounded sample (empty if
  there was too little to train on),
* ``part-<task>-<random>.ids``: one file per task, documents in ascending doc_id order,
* ``manifest``: a Parquet table with a row for each valid file. A file without a row is left over from a
  task that was run again, and no reader looks at it.

A file is: magic, frames, index, footer. The index has for each document its id, offset, size
and number of ids; the footer says where the index is and carries the hash of the dictionary, so a document
is read with one seek, and never with another dictionary than it was written with.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonewise.llm import common
from zonewise.llm.encoding import encoder

MAGIC = b"TIDS0001"
FOOTER = struct.Struct("<QQ32s8s")  # index offset, documents, dictionary hash, magic
INDEX = np.dtype([("null_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n_ids", "<u8")])
# Documents the dictionary is trained on at most, bytes of each of them at most, and its size.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
# Bytes of text encoded at once, where a batch has fewer: the more, the fewer distinct words to look up.
ENCODED_BYTES = 1 << 21
MANIFEST = "path string, first_id bigint, part int, documents bigint, ids bigint, bytes bigint"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for ``samples``, or an empty one where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _zdict(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class Writer:
    """Writes one file. Frames go out as they come; only the index is held."""

    def __init__(self, stream, dictionary: bytes, dtype: str):
        self.stream, self.dtype = stream, dtype
        self.hash = hashlib.sha256(dictionary + dtype.encode()).digest()
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True, **_zdict(dictionary)).compress
        self.index: list[tuple] = []
        self.stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.compress(ids.astype(self.dtype).tobytes())
        self.stream.write(frame)
        self.index.append((doc_id is None, doc_id or 0, self.at, len(frame), len(ids)))
        self.at += len(frame)

    def finish(self) -> int:
        index = np.array(self.index, INDEX)
        self.stream.write(index.tobytes())
        self.stream.write(FOOTER.pack(self.at, len(index), self.hash, MAGIC))
        return self.at + index.nbytes + FOOTER.size


class Reader:
    """Reads one file: all documents in order, or one by its id."""

    def __init__(self, stream, dictionary: bytes, dtype: str):
        self.stream, self.dtype = stream, dtype
        end = stream.size()
        stream.seek(end - FOOTER.size)
        at, n, written_with, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        if written_with != hashlib.sha256(dictionary + dtype.encode()).digest():
            raise ValueError("the file was written with another dictionary or id type")
        stream.seek(at)
        self.index = np.frombuffer(stream.read(n * INDEX.itemsize), INDEX)
        self.decompress = zstandard.ZstdDecompressor(**_zdict(dictionary)).decompress

    def _frame(self, i: int) -> np.ndarray:
        self.stream.seek(int(self.index["offset"][i]))
        return np.frombuffer(self.decompress(self.stream.read(int(self.index["size"][i]))), self.dtype)

    def get(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id, None if the file has none."""
        found = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null_id"] == 0))
        return self._frame(int(found[0])) if len(found) else None

    def __iter__(self):
        for i, row in enumerate(self.index):
            yield None if row["null_id"] else int(row["doc_id"]), self._frame(i)


def _open(path: str, write: bool = False):
    fs, local = pafs.FileSystem.from_uri(path)
    return fs.open_output_stream(local) if write else fs.open_input_file(local)


@dataclass(frozen=True)
class Store:
    """A written store."""

    folder: str
    dtype: str

    def dictionary(self) -> bytes:
        with _open(f"{self.folder}/dictionary.zdict") as stream:
            return stream.read()

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def ids(self, spark: SparkSession, doc_id: int) -> np.ndarray | None:
        """Ids of one document: its file by the manifest, its place by the file's index."""
        upto = self.manifest(spark).where(F.col("first_id").isNull() | (F.col("first_id") <= doc_id))
        latest = upto.orderBy(F.col("first_id").desc_nulls_last(), F.col("part").desc()).limit(1).collect()
        if not latest:
            return None
        with _open(latest[0].path) as stream:
            return Reader(stream, self.dictionary(), self.dtype).get(doc_id)


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, spaces_matter: bool = False, dtype: str = "<u2"
) -> Store:
    """Encode the documents (``doc_id``, ``text``) and write them as a store in ``folder`` (a URI all executors reach).

    Documents are in ascending doc_id order over all files; null ids come first, rows of one id are in the order of
    their texts. A null text counts as empty and holds the end id only. No documents give an empty manifest.
    """
    spark = common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fs, local = pafs.FileSystem.from_uri(folder)
    fs.create_dir(local, recursive=True)

    def serialized(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(tokenizer, spaces_matter).ids(batch.column(0))
        return pa.RecordBatch.from_pydict({"ids": [x.astype(dtype).tobytes()[:SAMPLE_BYTES] for x in ids]})

    # The documents with the smallest hashes: chosen on ids alone, then fetched.
    few = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE_DOCUMENTS).select("doc_id")
    sampled = rows.join(F.broadcast(few.distinct()), "doc_id", "left_semi").limit(SAMPLE_DOCUMENTS).select("text")
    samples = [r.ids for r in common.over_batches(sampled, serialized, "ids binary").collect()]
    dictionary = train_dictionary(samples)
    with _open(f"{folder}/dictionary.zdict", write=True) as stream:
        stream.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        writer = first = None
        part, total = TaskContext.get().partitionId(), 0
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        encode = encoder(tokenizer, spaces_matter)
        try:
            for batch in common.gathered(batches, ENCODED_BYTES):
                encoded = encode.ids(batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    if writer is None:
                        writer, first = Writer(_open(path, write=True), shared.value, dtype), doc_id
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                    total += len(ids) + 1
            if writer is None:
                return
            n, size = len(writer.index), writer.finish()
        finally:
            if writer is not None:
                writer.stream.close()
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([path], pa.string()),
                "first_id": pa.array([first], pa.int64()),
                "part": pa.array([part], pa.int32()),
                "documents": pa.array([n], pa.int64()),
                "ids": pa.array([total], pa.int64()),
                "bytes": pa.array([size], pa.int64()),
            }
        )

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return Store(folder, dtype)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """What the files of a store hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shared = spark.sparkContext.broadcast(store.dictionary())
    dtype = store.dtype
    # One row per file here, never one per document.
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = store.manifest(spark)
    files = manifest.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with _open(path) as stream:
                    for doc_id, ids in Reader(stream, shared.value, dtype):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 50_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    # One task per file: with a number given, adaptive execution leaves these few rows apart.
    return files.repartition(max(1, manifest.count())).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
