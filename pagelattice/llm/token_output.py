"""Token ids in Arrow stream files of equal-length sequences (operator 1).

Documents are dealt by ranges of doc_id and, as one id may be many rows', of a hash of the text, encoded where they land and packed end to
end into sequences of ``seq_len`` ids.  Each partition writes one file in the Arrow
IPC stream format: record batches of ``rows`` sequences with the columns

* ``input_ids``  fixed-size list of uint16 (uint32 for vocabularies over 65,536),
* ``mask``       fixed-size list of bool, false on the padding behind a shard's last id,
* ``begins``     fixed-size list of bool, true on the first id of each document,
* ``doc_ids``    list of the ids of the documents that begin in the sequence.

A file holds batches of one size, so a memory map reaches any sequence without a copy
(``open_shard`` and ``sequence``).  Files are written under an attempt's own name and
renamed, so a task that runs again replaces its file with an equal one.

Defined results: a null text counts as empty and yields the end id alone; repeated ids
follow each other by the hash of their text; a null doc_id comes first and is kept; an
empty table gives no files and no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .coder import Memo, cuts
from .scratch import Scratch

SEQ_LEN = 2048
ROWS = 64
_workers: dict = {}


class WordEncoder:
    """ids of texts by the tokenizers library; one per worker and vocabulary, with a memo of words."""

    def __init__(self, vocab_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.memo = Memo(self._encode, self.dtype)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for at in range(0, len(words), 4096):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[at : at + 4096]], add_special_tokens=False)]
        return np.fromiter((i for x in lists for i in x), self.dtype), np.fromiter(map(len, lists), np.int32, len(lists))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        data, offsets = flat.buffers(texts)
        starts, ends, first = cuts(data, offsets, keep_spaces=False)
        ids, per_segment = self.memo(data, starts, ends, lower=True)
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_segment)])
        counts = np.diff(done[first])
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if odd.any():  # a special token's string inside: the whole text at once
            parts, counts, bounds = [], counts.copy(), done[first]
            for k in range(len(texts)):
                own = np.asarray(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, self.dtype) if odd[k] else ids[bounds[k] : bounds[k + 1]]
                counts[k] = len(own)
                parts.append(own)
            ids = np.concatenate(parts)
        return ids, counts


def encoder(vocab_path: str) -> WordEncoder:
    if vocab_path not in _workers:
        _workers[vocab_path] = WordEncoder(vocab_path)
    return _workers[vocab_path]


def filesystem(path: str):
    """(pyarrow file system, path in it) of a folder that Spark names by a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Shard:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, folder: str, name: str, dtype, seq_len: int, rows: int):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.own = f"{root}/{name}.arrows", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.seq_len, self.rows, self.block, self.dtype = seq_len, rows, seq_len * rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len)), ("begins", pa.list_(pa.bool_(), seq_len)), ("doc_ids", pa.list_(pa.int64()))])
        self.sink = self.fs.open_output_stream(self.own)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.ids, self.begins, self.docs = np.zeros(0, dtype), np.zeros(0, np.int64), pa.array([], pa.int64())
        self.sequences = self.total = self.n_docs = 0

    def add(self, ids: np.ndarray, begins: np.ndarray, docs: pa.Array) -> None:
        self.begins = np.concatenate([self.begins, begins + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs = pa.concat_arrays([self.docs, docs])
        self.total += len(ids)
        self.n_docs += len(docs)
        while len(self.ids) >= self.block:
            self._emit(self.block)

    def _emit(self, n: int) -> None:
        rows = -(-n // self.seq_len)
        width = rows * self.seq_len
        ids, mask, begins = np.zeros(width, self.dtype), np.zeros(width, bool), np.zeros(width, bool)
        ids[:n], mask[:n] = self.ids[:n], True
        k = int(np.searchsorted(self.begins, n))
        begins[self.begins[:k]] = True
        bounds = np.searchsorted(self.begins[:k], np.arange(rows + 1) * self.seq_len)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask, begins)]
        columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.docs[:k]))
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.ids, self.begins, self.docs = self.ids[n:], self.begins[k:] - n, self.docs[k:]
        self.sequences += rows

    def close(self) -> str:
        if len(self.ids):
            self._emit(len(self.ids))
        self.writer.close()
        self.sink.close()
        self.fs.move(self.own, self.final)
        return self.final


def write(docs: DataFrame, folder: str, vocab_path: str, end_id: int = 1, seq_len: int = SEQ_LEN, rows: int = ROWS) -> DataFrame:
    """Encodes docs(doc_id, text) into shard files under folder; the manifest, a row a file: shard, path, n_sequences, n_ids, n_docs.

    The manifest is lazy: materialise it once, then read the files it names.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = None
        for batch in batches:
            for piece in flat.pieces(batch):
                if not piece.num_rows:
                    continue
                own = encoder(vocab_path)
                ids, counts = own(piece.column(1))
                to = np.cumsum(counts + 1)
                whole = np.full(int(to[-1]), end_id, own.dtype)
                keep = np.ones(len(whole), bool)
                keep[to - 1] = False
                whole[keep] = ids
                out = out or _Shard(folder, f"shard-{part:06d}", own.dtype, seq_len, rows)
                out.add(whole, to - counts - 1, piece.column(0))
        if out:
            path = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [path], "n_sequences": [out.sequences], "n_ids": [out.total], "n_docs": [out.n_docs]})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    dealt = dealt.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return dealt.mapInArrow(pack, "shard long, path string, n_sequences long, n_ids long, n_docs long")


def open_shard(path: str, folder: str = "") -> list[pa.RecordBatch]:
    """The record batches of a shard file; on a local disk they point into a memory map, with no copy."""
    fs, _ = filesystem(folder or path)
    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
    with pa.ipc.open_stream(source) as reader:
        return list(reader)


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, pa.Array]:
    """Sequence i of a shard and its mask; the ids are a view of the file's bytes."""
    rows = batches[0].num_rows
    batch, at = batches[i // rows], i % rows
    ids, mask = batch.column(0), batch.column(1)
    n = ids.type.list_size
    return ids.values.slice((ids.offset + at) * n, n).to_numpy(zero_copy_only=True), mask.values.slice((mask.offset + at) * n, n)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row a document, out of the files alone: doc_id, start, n_tokens, ids_crc32 (of little-endian uint32)."""

    def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in rows:
            for path, begin in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
                crc, n, at = 0, -1, begin
                doc: list = []
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}

                def end(doc=doc, out=out):
                    for k, v in zip(out, (doc[0], doc[1], n, crc), strict=True):
                        out[k].append(v)

                for got in pa.ipc.open_stream(source):
                    size = int(pc.sum(got.column("mask").flatten()).as_py())
                    ids = got.column("input_ids").flatten().to_numpy()[:size].astype("<u4")
                    begins = np.flatnonzero(got.column("begins").flatten().to_numpy(zero_copy_only=False)[:size]).tolist()
                    docs = got.column("doc_ids").flatten().to_pylist()
                    head = begins[0] if begins else size
                    if head:  # the rest of a document of earlier batches
                        crc, n = zlib.crc32(ids[:head].tobytes(), crc), n + head
                    for k, (b, e) in enumerate(zip(begins, [*begins, size][1:], strict=True)):
                        if n >= 0:
                            end()
                        doc[:] = [docs[k], at + b]
                        crc, n = zlib.crc32(ids[b:e].tobytes()), e - b
                    at += size
                    if len(out["doc_id"]) >= 10_000:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out.update({k: [] for k in out})
                if n >= 0:
                    end()
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    located = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    located = located.select("path", "start", (F.row_number().over(Window.orderBy("shard")) - 1).alias("file"))
    files = max(1, manifest.count())  # a task a file: a number that is asked for isn't coalesced
    return located.repartitionById(files, "file").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocab_path: str, end_id: int = 1, seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes docs in the file format and reads the files back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = scratch.folder("shards")
    manifest = scratch.table(write(docs, folder, vocab_path, end_id, seq_len), "manifest")
    return read(manifest, folder)
