"""Token ids as files of separately compressed documents with one shared dictionary.

A store is a folder of files and one dictionary. The dictionary is trained by zstandard on id arrays as they are written, little-endian numbers of
the least width that holds the vocabulary. A file holds the documents of one range of ids in ascending order:

======================  ==================================================================
bytes                   content
======================  ==================================================================
8                       ``MAGIC``
1                       width of an id in bytes
32                      SHA-256 of the dictionary that its documents need
any                     one zstandard frame for each document, compressed by itself
8 × (n + 1)             where each frame begins, and where the last one ends
8 × (n + 1)             ids of the file before each document, and all of them
8 × n, n                document ids, and 1 for those that are NULL
8, 8                    where the index begins, n
======================  ==================================================================

So one short document costs two reads, its entry of the index and its frame. ``TokenFile`` opens a file, refuses another dictionary than the one named and
reads documents one by one or all in order.

Rows are dealt to ranges by (id, text, a random number with a fixed seed), so an id or a row that a third of the table has spreads over many ranges. Each task
streams its range into files of its own names, new at every attempt; only files whose rows reach the staged list of files exist for a reader, so
a lost or repeated task leaves nothing behind but a file that nobody reads. What the driver sees is the dictionary and, in the plan, names of part files.
Tasks open files through ``pyarrow.fs`` at the address of the shared folder, local or of a cluster's file system.

The dictionary is fitted on a bounded sample, the ``SAMPLED`` documents of the least hashes of the whole table; it decides sizes and no result. A
table of fewer than ``LEAST_SAMPLES`` documents trains none and names the hash of no bytes.

Defined cases: a NULL or empty text is the end id alone; rows with a NULL id come first; rows of one id are ordered by their text's hash; repeated rows are
written as often as they occur; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from volpanel.llm.common import partitions
from volpanel.llm.encoding import encoder
from volpanel.session import scratch_path, stage

MAGIC = b"IDSTORE1"
HEADER, FOOTER = "<8sB32s", "<QQ"
HEADER_BYTES, FOOTER_BYTES = struct.calcsize(HEADER), struct.calcsize(FOOTER)
END_ID, LEVEL = 2, 3
DICTIONARY_BYTES, SAMPLED, LEAST_SAMPLES, SAMPLE_BYTES = 1 << 16, 2048, 64, 1 << 23
FILE_BYTES = 1 << 27  # of frames in a file; a longer range has several files
DICTIONARY_NAME = "dictionary"


def place(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(address)


def width_of(largest_id: int) -> int:
    return 2 if largest_id < 1 << 16 else 4


def coded(ids: bytes, width: int, end_id: int) -> bytes:
    """Unsigned 32-bit ids with the end id behind them, in the width of the file."""
    return (np.frombuffer(ids, "<u4").astype(f"<u{width}")).tobytes() + end_id.to_bytes(width, "little")


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; none from too few of them."""
    if len(samples) < LEAST_SAMPLES:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


class FileWriter:
    """One file of a store, written front to back; only the index is kept in memory."""

    def __init__(self, address: str, width: int, dictionary: bytes):
        system, path = place(address)
        self.address, self.out = address, system.open_output_stream(path)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        self.width, self.at, self.ids = width, HEADER_BYTES, 0
        self.begins, self.before, self.names = [self.at], [0], []
        self.out.write(struct.pack(HEADER, MAGIC, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.at += len(frame)
        self.ids += len(ids) // self.width
        self.begins.append(self.at)
        self.before.append(self.ids)
        self.names.append(doc_id)

    def close(self) -> None:
        self.out.write(np.array(self.begins, "<u8").tobytes())
        self.out.write(np.array(self.before, "<u8").tobytes())
        self.out.write(np.array([x or 0 for x in self.names], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.names], "u1").tobytes())
        self.out.write(struct.pack(FOOTER, self.at, len(self.names)))
        self.out.close()


@lru_cache(maxsize=4)
def _dictionary(address: str) -> bytes:
    system, path = place(address)
    with system.open_input_file(path) as file:
        return file.read()


class TokenFile:
    """Reads a file of a store: ``len``, ``ids(i)`` of one document, or all documents in order."""

    def __init__(self, address: str, dictionary: bytes):
        system, path = place(address)
        self.file = system.open_input_file(path)
        magic, self.width, needed = struct.unpack(HEADER, self.file.read_at(HEADER_BYTES, 0))
        if magic != MAGIC:
            raise ValueError(f"{address} is no file of ids")
        if needed != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{address} needs another dictionary")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=shared)
        size = self.file.size()
        self.index, self.n = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))

    def __len__(self) -> int:
        return self.n

    def _numbers(self, column: int, first: int, count: int) -> np.ndarray:
        at = self.index + 8 * (column * (self.n + 1) + first)
        return np.frombuffer(self.file.read_at(8 * count, at), "<i8" if column == 2 else "<u8")

    def _widened(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}").astype("<u4")

    def doc_id(self, i: int) -> int | None:
        nulls = self.index + 8 * (2 * (self.n + 1) + self.n)
        return None if self.file.read_at(1, nulls + i) == b"\1" else int(self._numbers(2, i, 1)[0])

    def ids(self, i: int) -> np.ndarray:
        begin, end = self._numbers(0, i, 2).tolist()
        return self._widened(self.file.read_at(end - begin, begin))

    def documents(self, at_once: int = 1 << 22) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, ids of the file before it, its ids) in order, frames read ``at_once`` bytes or one document at a time."""
        begins, before = self._numbers(0, 0, self.n + 1), self._numbers(1, 0, self.n + 1)
        names = self._numbers(2, 0, self.n).tolist()
        null = self.file.read_at(self.n, self.index + 8 * (2 * (self.n + 1) + self.n))
        first = 0
        while first < self.n:
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + np.uint64(at_once), side="right")) - 1)
            base = int(begins[first])
            block = self.file.read_at(int(begins[last]) - base, base)
            for i in range(first, last):
                frame = block[int(begins[i]) - base : int(begins[i + 1]) - base]
                yield (None if null[i] else names[i]), int(before[i]), self._widened(frame)
            first = last

    def close(self) -> None:
        self.file.close()


def sampled_dictionary(docs: DataFrame, vocabulary: str, width: int, end_id: int = END_ID) -> bytes:
    """Trained on the documents of the least hashes, ``SAMPLED`` of them and ``SAMPLE_BYTES`` at most; equal rows count once."""
    n = docs.count()
    share = min(1.0, 2.0 * SAMPLED / max(n, 1))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    low = keyed.filter(F.col("key") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))) if share < 1 else keyed
    rows = low.groupBy("key").agg(F.first("text").alias("text")).orderBy("key").limit(SAMPLED)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(vocabulary)
        for part in parts:
            yield pd.DataFrame({"ids": [coded(ids, width, end_id) for ids in ids_of.each(text or "" for text in part["text"])]})

    samples, size = [], 0
    for row in rows.mapInPandas(encode, "ids binary").toLocalIterator():
        if size + len(row.ids) <= SAMPLE_BYTES:
            samples.append(bytes(row.ids))
            size += len(row.ids)
    return train(samples)


def write_store(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, ranges: int | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to a new ``folder`` and returns the staged list of its files.

    Rows (path, documents, ids, start): ``start`` is the number of ids in all files before. The list is all that makes a file part of the store.
    """
    spark = docs.sparkSession
    width = width_of(max(_vocabulary_size(vocabulary) - 1, end_id))
    dictionary = sampled_dictionary(docs, vocabulary, width, end_id)
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{DICTIONARY_NAME}") as out:
        out.write(dictionary)

    # Ids go through Python as text, where a NULL doesn't turn the others into floating point.
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("key"), F.rand(11).alias("salt"))
    order = [F.col("id").asc_nulls_first(), "key", "salt"]
    dealt = keyed.repartitionByRange(ranges or partitions(spark), *order).sortWithinPartitions(*order)
    rows = dealt.select(F.col("id").cast("string").alias("id"), "text", "key", "salt")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, files, writer = encoder(vocabulary), [], None
        for part in parts:
            found = ids_of.each(text or "" for text in part["text"])
            for name, ids, key, salt in zip(part["id"], found, part["key"], part["salt"]):
                if writer is None:
                    writer = FileWriter(f"{folder}/{uuid.uuid4().hex}.ids", width, dictionary)
                    files.append((writer, name, key, salt))
                writer.add(None if name is None else int(name), coded(ids, width, end_id))
                if writer.at >= FILE_BYTES:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        listed = [(w.address, len(w.names), w.ids, name, key, salt) for w, name, key, salt in files]
        yield pd.DataFrame(listed, columns=["path", "documents", "ids", "first_id", "first_key", "first_salt"])

    listed = stage(
        rows.mapInPandas(write, "path string, documents long, ids long, first_id string, first_key long, first_salt double"), "token-files"
    )
    # One row a file, in the order of their first rows.
    before = Window.orderBy(F.col("first_id").cast("long").asc_nulls_first(), "first_key", "first_salt").rowsBetween(Window.unboundedPreceding, -1)
    return listed.select("path", "documents", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def _vocabulary_size(vocabulary: str) -> int:
    return encoder(vocabulary).tokenizer.get_vocab_size()


def read_store(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a store, each decompressed by itself."""
    schema = "doc_id string, start long, n_tokens long, ids_crc32 long"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary, out = _dictionary(f"{folder}/{DICTIONARY_NAME}"), []
        for part in parts:
            for path, start in zip(part["path"], part["start"]):
                file = TokenFile(path, dictionary)
                for name, before, ids in file.documents():
                    out.append((None if name is None else str(name), start + before, len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                file.close()
        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "start").repartition(partitions(files.sparkSession))
    return spread.mapInPandas(read, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def written_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """The documents' lengths, places and checksums from a store in the shared folder."""
    folder = scratch_path(spark, "token-store")
    return read_store(write_store(docs, vocabulary, folder), folder)
