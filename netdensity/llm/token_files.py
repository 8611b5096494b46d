"""Token-id output: concatenated ids with Elias-Fano document boundaries.

Documents are range partitioned by doc_id and sorted within the partitions; each task encodes its
documents and cuts them into blocks of about a million ids. A block is one binary record:

    magic, id width, null doc_ids, least doc_id, n ids
    Elias-Fano of the doc_ids less the least one, Elias-Fano of the documents' ends, the ids

The records are written by Spark, as one Parquet table with a row per block in the folder that all
executors share, and read back by it, so any store Spark can reach serves. No 64-bit offset is stored
per document. The place of a block among all ids is a running sum over blocks within a shard and
over shards, both far fewer than documents.

Defined results: a null or empty text gives the end id alone; null doc_ids come first; rows
that share a doc_id are ordered by text; an empty table gives an empty file set; a text that spells the
vocabulary's special token gets that token's id, as the library does; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.llm import elias_fano
from netdensity.session import checkpoint_dir

HEAD = struct.Struct("<4sBQqQ")
MAGIC = b"NDT1"
BLOCK_IDS = 1 << 20
#: Longer texts go to the library that never recurses.
LONG_TEXT = 200_000
FILES = "shard int, block int, n_tokens long, payload binary"
ROWS = "doc_id long, shard int, block int, at long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids as the tokenizers library gives them.

    Where the merges are in the order of the ids, a rank encoder over the same vocabulary gives the same ids
    several times faster; it is built from the same file, and long texts still go through the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    plain = (
        spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"])
    )
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    plain = plain and [model["vocab"].get(m.replace(" ", "")) for m in merges] == list(range(256, 256 + len(merges))) and all(c in model["vocab"] for c in letters)
    if not plain:
        return lambda t: slow.encode(t, add_special_tokens=False).ids
    import tiktoken

    # The byte that a letter of the byte-level alphabet stands for: printable ones for themselves, the others in order from 256.
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in itself} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(itself))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(t: str) -> list[int]:
        if len(t) > LONG_TEXT:
            return slow.encode(t, add_special_tokens=False).ids
        return fast.encode(t, allowed_special=allowed, disallowed_special=())

    return encode


def pack(ids: list[np.ndarray], docs: list[int | None]) -> bytes:
    """One block: documents in ascending order, nulls first."""
    nulls = sum(d is None for d in docs)
    known = np.array(docs[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    joined = np.concatenate(ids)
    kind = "<u2" if joined.size == 0 or joined.max() < 65536 else "<u4"
    ends = np.cumsum([len(x) for x in ids])
    # Differences of int64 fit uint64 also where they overflow int64.
    gaps = known.astype(np.uint64) - np.uint64(least & (2**64 - 1))
    return HEAD.pack(MAGIC, np.dtype(kind).itemsize, nulls, least, len(joined)) + elias_fano.encode(gaps) + elias_fano.encode(ends) + joined.astype(kind).tobytes()


class Block:
    """Reads a packed block: ids(i) of the i-th document by two selects."""

    def __init__(self, raw: bytes):
        magic, width, self.nulls, self.least, self.n_ids = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.docs = elias_fano.EliasFano(raw, HEAD.size)
        self.ends = elias_fano.EliasFano(raw, self.docs.end)
        self.data = np.frombuffer(raw, f"<u{width}", self.n_ids, self.ends.end)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.docs.all() + np.uint64(self.least & (2**64 - 1))).astype(np.int64).tolist()

    def ids(self, i: int) -> np.ndarray:
        return self.data[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int, doc_id="doc_id", text="text") -> None:
    """Encode ``docs`` and write the block table to ``path``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids, ds, size, k = [], [], 0, 0

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([size], pa.int64()), pa.array([pack(ids, ds)], pa.binary())], ["shard", "block", "n_tokens", "payload"])

        for b in batches:
            for d, t in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), strict=True):
                got = np.array([*encode(t), end_id], np.uint32)
                ids.append(got)
                ds.append(d)
                size += len(got)
                if size >= BLOCK_IDS:
                    yield record()
                    ids, ds, size, k = [], [], 0, k + 1
        if ids:
            yield record()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows.repartitionByRange("d").sortWithinPartitions("d", "t").mapInArrow(blocks, FILES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document in the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, block, raw in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("payload"), strict=True):
                x = Block(raw.as_py())
                ends = x.ends.all().astype(np.int64)
                starts = np.append(0, ends)[:-1]
                crc = [zlib.crc32(x.data[a:z].astype("<u4").tobytes()) for a, z in zip(starts, ends, strict=True)]
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.doc_ids(), pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILES).parquet(path)
    sizes = files.select("shard", "block", "n_tokens")
    running = lambda w: F.sum("n_tokens").over(w) - F.col("n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).select("shard", running(Window.orderBy("shard")).alias("before"))
    places = sizes.withColumn("first", running(Window.partitionBy("shard").orderBy("block"))).join(shards, "shard").select("shard", "block", (F.col("first") + F.col("before")).alias("first"))
    rows = files.select("shard", "block", "payload").mapInArrow(documents, ROWS)
    return rows.join(places, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
