"""Token ids as flat unsigned integer files with 64-bit document offsets, written and read by Spark tasks.

A set of files is a folder with, for each shard, `<name>.ids` (the ids of its documents one after another, little-endian, in the smallest
unsigned type that holds the vocabulary), `<name>.off` (unsigned 64-bit: where each document begins in the shard, and the end) and
`<name>.key` (the documents' ids as signed 64-bit) with `<name>.nul` (one byte each: 1 where the id is null).  The table `manifest` names
the shards in the order of document ids, with their sizes and the base of each: the ids in all shards before it, a prefix sum over the shards' sizes.
A document's place in the whole is its shard's base plus its offset, so no file is written twice.

Every attempt of a task writes files of its own name, and the manifest, which Spark commits, names those of the attempts that succeeded:
a lost executor or a repeated task leaves at worst files that nothing names.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.llm.memo import Memo, runs

#: Bytes of ids in a batch that the reader gives out.
OUT_BYTES = 4 << 20


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that may be a plain path or a URI."""
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder else folder.removeprefix("file:"))


class WordEncoder:
    """Encodes texts exactly as the `tokenizers` library encodes them whole, each distinct word once.

    For tokenizers that drop white space, normalise by NFC and lower case, and split into contractions, runs of letters, digits and runs
    of other signs, as the file of this query does.  Texts of ASCII and Latin-1 letters, without special tokens, are lower-cased and
    split here, and each distinct word goes to the library's BPE model.  Any other text goes to the library as it is.
    """

    #: ASCII and the Latin-1 letters: all are stable under NFC and have a lower case of one Latin-1 letter
    PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        # byte-level BPE writes each byte as a printable sign: printable bytes as themselves, the others from U+0100 on
        shown = {b: b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        hidden = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(c) for b, c in (shown | {b: 256 + i for i, b in enumerate(hidden)}).items()}
        # kinds of bytes: 0 white space, 1 letters (all of UTF-8 beyond ASCII here), 2 digits, 3 other signs
        self.kinds = np.full(256, 3, np.uint8)
        self.kinds[[32, *range(9, 14)]] = 0
        self.kinds[[*range(97, 123), *range(128, 256)]] = 1
        self.kinds[48:58] = 2
        self.memo = Memo(self._words, self.dtype)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        found = [[t.id for t in tokenize(w.decode() if w.isascii() else "".join([signs[b] for b in w]))] for w in words]
        return np.array([i for f in found for i in f], self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def _split(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8).copy()
        # C3 80 to C3 9E are the capital letters of Latin-1 in UTF-8
        raw[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] += 0x20
        kinds = self.kinds[raw]
        begins = np.append(True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2))
        # a contraction takes an apostrophe that begins a run of signs, and the letters s, t, m, d, re, ve or ll after it
        mark = np.flatnonzero((raw[:-2] == 39) & begins[:-2])
        after, second = raw[mark + 1], raw[mark + 2]
        one = np.isin(after, list(b"stmd"))
        two = (np.isin(after, list(b"rv")) & (second == ord("e"))) | ((after == ord("l")) & (second == ord("l")))
        begins[mark[one | two] + 1] = False
        begins[mark[one] + 2] = True
        begins[mark[two] + 3] = True
        edges = np.flatnonzero(begins)
        words = kinds[edges] > 0
        starts, lengths = edges[words], np.diff(np.append(edges, len(raw)))[words]
        ids, counts = self.memo.ids(raw.tobytes(), starts, lengths)
        total = np.append(0, np.cumsum(counts))[np.searchsorted(starts, np.append(0, np.cumsum(sizes)))]
        return [ids[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is encoded like an empty text."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.PLAIN(t) and not self.special(t)]
        blobs = [texts[i].encode() for i in plain]
        for some in runs(blobs):
            for i, ids in zip(plain[some], self._split(blobs[some]), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype)
        return out


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append `end_id`, write the files in ascending order of ids below `folder`; returns the manifest.

    Nulls come first among ids; rows that repeat an id are ordered by a hash of their text and all written.  A null or empty text has the
    end id alone.  An empty table gives an empty manifest.  Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = end = None
        n_docs = n_ids = 0
        streams: dict = {}
        name = uuid.uuid4().hex
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = WordEncoder(tokenizer)
                end = np.array([end_id], encoder.dtype)
                fs, at = _store(folder)
                fs.create_dir(at, recursive=True)
                streams = {k: fs.open_output_stream(f"{at}/{name}.{k}") for k in ("ids", "off", "key", "nul")}
                streams["off"].write(np.zeros(1, "<u8").tobytes())
            coded = [np.append(ids, end) for ids in encoder.encode(batch.column(1).to_pylist())]
            lengths = np.fromiter(map(len, coded), "<u8", len(coded))
            streams["ids"].write(np.concatenate(coded).tobytes())
            streams["off"].write((n_ids + np.cumsum(lengths, dtype="<u8")).astype("<u8").tobytes())
            streams["key"].write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
            streams["nul"].write(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            n_docs, n_ids = n_docs + batch.num_rows, n_ids + int(lengths.sum())
        if n_docs:
            for s in streams.values():
                s.close()
            # partitions of a range partitioning are numbered in the order of their keys
            row = [TaskContext.get().partitionId(), name, encoder.dtype.itemsize, n_docs, n_ids]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "width", "n_docs", "n_ids"), row, strict=True))], pa.schema(
                [("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    shards = ordered.mapInArrow(run, "shard int, name string, width int, n_docs long, n_ids long")
    shards.write.parquet(f"{folder}/shards")
    # one row for each shard, whatever the number of documents
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    spark.read.parquet(f"{folder}/shards").withColumn("base", base).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _view(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the file system is a mounted one, else read."""
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start long: the ids of all documents before it, n_tokens long, ids binary: little-endian unsigned 32-bit) from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "name", "width", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        fs, at = _store(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            ids, off, key, nul = (_view(fs, f"{at}/{row['name']}.{k}", d) for k, d in (("ids", f"<u{row['width']}"), ("off", "<u8"), ("key", "<i8"), ("nul", "u1")))
            off = off.astype(np.int64)
            first = 0
            while first < len(key):
                last = max(first + 1, int(np.searchsorted(off, off[first] + OUT_BYTES // 4, "right")) - 1)
                bytes_ = [ids[a:b].astype("<u4").tobytes() for a, b in zip(off[first:last], off[first + 1 : last + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[first:last], mask=nul[first:last].astype(bool)), pa.array(row["base"] + off[first:last]),
                    pa.array(np.diff(off[first : last + 1])), pa.array(bytes_, pa.binary())], schema=schema)
                first = last

    # a task for each shard or few: the rows are names, the work is in the files
    return manifest.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
