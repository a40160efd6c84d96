"""Token shards as wavelet matrices.

A shard holds the token ids of consecutive documents in one compressed binary
value: a header, the documents' ids and lengths, the planes' rank directory and
one bit plane for each bit of an id, from the highest; the vocabulary's size gives
the number of bits. Every plane keeps the ids' current bit in the order
that the planes before it give (zeros before ones, both stable), so that rank
and select on the planes answer access, counting and occurrence lookup without
decoding the ids.

Nulls and edges: a null text has no ids and an empty text neither, so both leave
the end id alone; a null doc_id sorts first; rows with equal doc_id are ordered
by their text's hash, and equal rows get places side by side. An empty table
gives no shard. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import shared_root
from .tokens import encoder

MAGIC = b"RVWM"
#: Bits between two entries of a plane's rank directory.
STEP = 4096
#: Tokens after which a task closes a shard.
SHARD_TOKENS = 1 << 20

_HEAD = struct.Struct("<4sQQB")
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    """Ids below 2**len(planes) with rank and select; planes are packed bits, highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray], steps: np.ndarray | None = None):
        """``steps``: ones in each STEP bits of each plane, as a file has them."""
        self.n, self.planes = n, planes
        if steps is None:
            steps = np.zeros((len(planes), -(-n // STEP)), np.uint16)
            for level, p in enumerate(planes):
                ones = _ONES[p]
                pad = np.zeros(-len(ones) % (STEP // 8), np.uint8)
                steps[level] = np.concatenate([ones, pad]).reshape(-1, STEP // 8).sum(1, dtype=np.uint16)
        self.steps = steps
        self.directory = np.hstack([np.zeros((len(planes), 1), np.int64), np.cumsum(steps, axis=1, dtype=np.int64)])
        self.zeros = [n - int(d[-1]) for d in self.directory]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, ids = [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit))
            ids = np.concatenate([ids.compress(~bit), ids.compress(bit)])
        return cls(len(ids), planes)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7)) & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, p = i // STEP, self.planes[level]
        count = int(self.directory[level][block]) + int(_ONES[p[block * STEP // 8 : i >> 3]].sum())
        return count + bin(int(p[i >> 3]) >> (8 - (i & 7))).count("1") if i & 7 else count

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _span(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a value before place end stand below the last plane."""
        a, b = 0, end
        for level in range(len(self.planes)):
            x, y = self._ones(level, a), self._ones(level, b)
            if value >> (len(self.planes) - 1 - level) & 1:
                a, b = self.zeros[level] + x, self.zeros[level] + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of a value before place end."""
        a, b = self._span(value, end)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the value's occurrence number k, from 0."""
        a, b = self._span(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._find(level, i - self.zeros[level], 1) if bit else self._find(level, i, 0)
        return i

    def _find(self, level: int, k: int, bit: int) -> int:
        """The place of one (or zero) number k of a plane."""
        d = self.directory[level]
        before = d if bit else np.arange(len(d), dtype=np.int64) * STEP - d
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * STEP // 8 : (block + 1) * STEP // 8])
        return block * STEP + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        ids = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            back = np.empty_like(ids)
            back[~bit] = ids[: self.zeros[level]]
            back[bit] = ids[self.zeros[level] :] | ids.dtype.type(1 << (len(self.planes) - 1 - level))
            ids = back
        return ids


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """The bytes of a shard. Each part is compressed by itself, so that one plane can be read alone."""
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    parts = [known.tobytes(), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array(lengths, dtype="<i8").tobytes()]
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    matrix = WaveletMatrix.build(ids, bits)
    parts += [matrix.steps.astype("<u2").tobytes(), *(p.tobytes() for p in matrix.planes)]
    parts = [zstandard.compress(p, 1) for p in parts]
    sizes = np.array([len(p) for p in parts], dtype="<u8").tobytes()
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(doc_ids), bits), sizes, *parts])


def read_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix of a shard."""
    magic, n, docs, bits = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    sizes = np.frombuffer(blob, "<u8", bits + 4, _HEAD.size)
    at, parts = _HEAD.size + sizes.nbytes, []
    for size in sizes.tolist():
        parts.append(np.frombuffer(zstandard.decompress(blob[at : at + size]), np.uint8))
        at += size
    ids = [int(x) if k else None for k, x in zip(parts[0].tolist(), parts[1].view("<i8").tolist(), strict=True)]
    return ids, parts[2].view("<i8"), WaveletMatrix(n, parts[4:], parts[3].view("<u2").reshape(bits, -1))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, bits: int | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write them in ascending doc_id order, a file for each task, shards in order in it."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part, number = encoder(tokenizer, True), TaskContext.get().partitionId(), 0
        doc_ids, lengths, parts, total = [], [], [], 0
        end = np.array([end_id], dtype="<u4").tobytes()
        width = bits or max(enc.tokenizer.get_vocab_size() - 1, end_id, 1).bit_length()

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pd.DataFrame({"part": [part], "number": [number], "n_tokens": [len(ids)], "blob": [pack_shard(doc_ids, lengths, ids, width)]})

        for batch in batches:
            texts = [x if isinstance(x, str) else None for x in batch["text"]]
            for doc, got in zip(batch["doc_id"].tolist(), enc.encode_bytes(texts), strict=True):
                doc_ids.append(None if pd.isna(doc) else int(doc))
                parts += (got, end)
                lengths.append(len(got) // 4 + 1)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield close()
                    number, doc_ids, lengths, parts, total = number + 1, [], [], [], 0
        if doc_ids:
            yield close()

    (
        docs.select("doc_id", "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
        .select(F.col("doc_id").cast("long"), "text")
        .mapInPandas(shards, "part int, number int, n_tokens long, blob binary")
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, base): tokens before each shard. Sums of a part first, so that the one
    window without a key sees a row for each written part only."""
    sizes = spark.read.parquet(path).select("part", "number", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return sizes.select("part", "number", own.alias("own")).join(before, "part").select("part", "number", (F.col("own") + F.col("part_base")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, number, blob in zip(batch["part"], batch["number"], batch["blob"], strict=True):
                doc_ids, lengths, matrix = read_shard(blob)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"part": part, "number": number, "doc_id": pd.array(doc_ids, dtype="Int64"), "own": starts, "n_tokens": lengths, "ids_crc32": crc})

    local = spark.read.parquet(path).select("part", "number", "blob").mapInPandas(rows, "part int, number int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return local.join(shard_starts(spark, path), ["part", "number"]).select("doc_id", (F.col("own") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the shards below the shared folder and read every document back from them."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_root(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
