"""Token-id files with a minimal perfect hash index (operator 5).

Files. Documents are range-partitioned and sorted by id; each task encodes its texts and cuts the
stream of ids into shards of a few MB. A shard is one file, written by Spark's own writer (so it
commits once, whatever executor is lost) and read by its binary reader:

    8 bytes    magic
    5 * int64  partition, shard in it, documents, ids of the partition before the shard, bytes an id
    documents  * (int64 key, int64 occurrence, int64 null flag)
    (documents + 1) * int64 offsets in ids
    raw ids    little-endian unsigned, 2 bytes if the vocabulary allows
    1 byte     the writer's line end

Index. Keys are (doc_id, occurrence), so rows that repeat an id stay apart. Keys fall into buckets of
some thousands; each bucket has a minimal perfect hash function of cascaded bit arrays: a key is
settled on the first level where it is alone, and its slot is the rank of its bit. A slot stores a
32-bit fingerprint with partition, shard, offset and length; a key outside the index is told by its
fingerprint and, in the file, by its key. A lookup costs a few hashes, whatever the number of documents, and
opens the files that it needs, whose places a manifest holds.

Defined cases: a null or empty text has its end id alone; a null id is a key of its own and comes
first; other columns are ignored; an empty table writes no shard and gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skein.llm import texts, tokens
from skein.llm.texts import mix
from skein.session import Scratch, shuffles_dropped

MAGIC = b"IDSHARD1"
_HEAD = struct.Struct("<8s5q")
BUCKET_KEYS = 4096
#: Files that are opened by name; if more are hit, Spark lists the folder.
FEW_FILES = 1000
ENTRY = np.dtype([("fingerprint", "<u4"), ("part", "<i4"), ("shard", "<i4"), ("length", "<i8"), ("offset", "<i8")])


# --- files ---------------------------------------------------------------------------------------


def shard_bytes(part: int, shard: int, before: int, keys: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    head = _HEAD.pack(MAGIC, part, shard, len(keys), before, width)
    return b"".join([head, keys.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes(), ids])


class Shard:
    def __init__(self, raw: bytes):
        magic, self.part, self.shard, n, self.before, self.width = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEAD.size
        self.keys = np.frombuffer(raw, "<i8", 3 * n, at).reshape(n, 3)
        self.offsets = np.frombuffer(raw, "<i8", n + 1, at + 24 * n)
        self.ids = np.frombuffer(raw, f"<u{self.width}", int(self.offsets[-1]), at + 24 * n + 8 * (n + 1))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int, shard_ids: int = 2 << 20) -> None:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(tokenizer)
        width = np.dtype(encode.kind).itemsize
        last = np.array([end], encode.kind).tobytes()
        part, shard, before, previous, count = TaskContext.get().partitionId(), 0, 0, object(), 0
        keys, lengths, blobs, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard_bytes(part, shard, before, np.array(keys).reshape(-1, 3), np.array(lengths), b"".join(blobs), width)], pa.binary())], ["raw"])

        for batch in batches:
            data, offsets = texts.buffers(batch.column(1))
            for lo, hi in texts.pieces(batch.num_rows, offsets, 1 << 20):
                ids, at = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    count = count + 1 if doc == previous else 0
                    previous = doc
                    raw = ids[a:b].tobytes() + last
                    keys.append((doc or 0, count, doc is None))
                    lengths.append(len(raw) // width)
                    blobs.append(raw)
                    size += lengths[-1]
                    if size >= shard_ids:
                        yield flush()
                        shard, before = shard + 1, before + size
                        keys, lengths, blobs, size = [], [], [], 0
        if keys:
            yield flush()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n = texts.blocks_for(rows.agg(F.sum(F.octet_length("text"))).first()[0], 16 << 20)
    rows = rows.repartitionByRange(texts.partitions_for(n, spark), "doc_id").sortWithinPartitions("doc_id", "text")
    with shuffles_dropped(spark):
        rows.mapInArrow(fn, "raw binary").select(F.col("raw").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _slices(s: Shard) -> list[bytes]:
    """Each document's ids as 32-bit integers."""
    wide, at = s.ids.astype("<u4"), s.offsets.tolist()
    return [wide[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def _opened(spark: SparkSession, paths: str | list[str], fields: dict[str, pa.DataType], values: Callable[[Shard], list], types: str) -> DataFrame:
    """Rows of the documents in shard files: path, part, shard, before (ids of the partition before the shard), offset,
    n_tokens, key, occurrence, and what values() adds."""
    names = ["path", "part", "shard", "before", "offset", "n_tokens", "key", "occurrence", *fields]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(cell.as_buffer())
                n = len(s.keys)
                same = [pa.array([x] * n, t) for x, t in ((path, pa.string()), (s.part, pa.int32()), (s.shard, pa.int32()), (s.before, pa.int64()))]
                own = [pa.array(s.offsets[:-1]), pa.array(np.diff(s.offsets)), pa.array(s.keys[:, 0], mask=s.keys[:, 2] == 1), pa.array(np.ascontiguousarray(s.keys[:, 1]))]
                yield pa.RecordBatch.from_arrays([*same, *own, *(pa.array(x, t) for x, t in zip(values(s), fields.values(), strict=True))], names)

    files = spark.read.format("binaryFile").load(paths).where("length > 0").select("path", "content")
    return files.mapInArrow(fn, f"path string, part int, shard int, before long, offset long, n_tokens long, key long, occurrence long{types}")


def shard_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the files say of each document, without its ids."""
    return _opened(spark, path, {}, lambda s: [], "")


def shard_records(spark: SparkSession, paths: str | list[str], with_ids: bool = False) -> DataFrame:
    """shard_headers with each document's ids_crc32 (and ids)."""

    def values(s: Shard) -> list:
        docs = _slices(s)
        return [[zlib.crc32(x) for x in docs], *([docs] if with_ids else [])]

    return _opened(spark, paths, {"ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {}), values, ", ids_crc32 long" + ", ids binary" * with_ids)


# --- index ---------------------------------------------------------------------------------------


def key_hash(key: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return mix(h ^ (occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) % np.uint64(size)


def build_mphf(h: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """Bit arrays, one a level; together they have exactly one set bit for each of the distinct hashes."""
    levels = []
    while len(h):
        size = max(8, int(gamma * len(h)))
        at = _level(h, len(levels), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        h = h[~alone[at]]
    return levels


def mphf_slots(levels: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Slots in 0..n-1; -1 where a hash surely is no key."""
    out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
    rank = 0
    for i, bits in enumerate(levels):
        at = _level(h[open_], i, len(bits)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank + (np.cumsum(bits) - 1)[at[hit]]
        rank += int(bits.sum())
        open_ = open_[~hit]
    return out


def _build_bucket(table: pa.Table) -> pa.Table:
    h = np.asarray(table["h"]).view(np.uint64)
    levels = build_mphf(h)
    entries = np.zeros(len(h), ENTRY)
    slot = mphf_slots(levels, h)
    entries["fingerprint"][slot] = (h >> np.uint64(32)).astype(np.uint32)
    for name, column in (("part", "part"), ("shard", "shard"), ("length", "n_tokens"), ("offset", "offset")):
        entries[name][slot] = np.asarray(table[column])
    return pa.table({"bucket": [table["bucket"][0].as_py()], "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())), "bits": [np.packbits(np.concatenate(levels)).tobytes()], "entries": [entries.tobytes()]})


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds h and bucket to rows with key and occurrence."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.schema.names.index("key"))
            h = key_hash(np.asarray(key.fill_null(0)), np.asarray(batch.column(batch.schema.names.index("occurrence"))), np.asarray(key.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64)), pa.array((mix(h ^ np.uint64(1)) % np.uint64(buckets)).astype(np.int64))], [*batch.schema.names, "h", "bucket"])

    return keys.mapInArrow(fn, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields) + ", h long, bucket long")


def write_index(spark: SparkSession, shards: str, index: str, buckets: int) -> None:
    """Reads the shards' headers once and writes index/keys (the hash functions with their entries) and index/manifest
    (path, part, shard, start: ids of all documents before the shard)."""
    scratch = Scratch(spark, "headers")
    headers = scratch.store(shard_headers(spark, shards), "headers")
    files = headers.groupBy("path", "part", "shard", "before").agg(F.sum("n_tokens").alias("n"))
    bases = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    rows = _hashed(headers.select("key", "occurrence", "part", "shard", "offset", "n_tokens"), buckets)
    with shuffles_dropped(spark):
        files.join(bases, "part").select("path", "part", "shard", (F.col("base") + F.col("before")).alias("start")).write.mode("overwrite").parquet(f"{index}/manifest")
        rows.groupBy("bucket").applyInArrow(_build_bucket, "bucket long, sizes array<int>, bits binary, entries binary").write.mode("overwrite").parquet(f"{index}/keys")
    scratch.drop()


def lookup(keys: DataFrame, index: str, buckets: int) -> DataFrame:
    """keys (key, occurrence) -> key, occurrence, part, shard, offset, length; keys that the index lacks are left out."""

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.asarray(left["h"]).view(np.uint64)
        if right.num_rows:
            sizes = right["sizes"][0].as_py()
            bits = np.unpackbits(np.frombuffer(right["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
            slot = mphf_slots(np.split(bits, np.cumsum(sizes)[:-1]), h)
            entries = np.frombuffer(right["entries"][0].as_py(), ENTRY)
            found = (slot >= 0) & (entries["fingerprint"][slot] == (h >> np.uint64(32)).astype(np.uint32))
        else:
            entries, slot, found = np.zeros(1, ENTRY), np.zeros(len(h), int), np.zeros(len(h), bool)
        e = entries[slot[found]]
        kept = left.filter(pa.array(found))
        return pa.table({"key": kept["key"], "occurrence": kept["occurrence"], **{c: pa.array(np.ascontiguousarray(e[c])) for c in ("part", "shard", "offset", "length")}})

    rows = _hashed(keys, buckets).groupBy("bucket").cogroup(keys.sparkSession.read.parquet(f"{index}/keys").groupBy("bucket"))
    return rows.applyInArrow(fn, "key long, occurrence long, part int, shard int, offset long, length long")


def fetch(keys: DataFrame, shards: str, index: str, buckets: int, with_ids: bool = True) -> DataFrame:
    """The documents of the given keys, by way of the index: key, occurrence, start, n_tokens, ids_crc32 (and ids).

    The index says which shard, and where in it, a key's ids lie. Where the keys fall into few files, these alone are
    opened; else the folder is read as a whole. A shard's own key decides in the end, so a key that the index
    lacks is not found, even if its fingerprint is another's."""
    spark = keys.sparkSession
    hits = Scratch(spark, "hits").store(lookup(keys, index, buckets), "hits")
    manifest = spark.read.parquet(f"{index}/manifest")
    paths = [r["path"] for r in manifest.join(hits.select("part", "shard").distinct(), ["part", "shard"], "left_semi").select("path").limit(FEW_FILES + 1).collect()]
    if not paths:
        records = shard_records(spark, shards, with_ids).where("false")
    else:
        records = shard_records(spark, paths if len(paths) <= FEW_FILES else shards, with_ids)
    records = records.select("part", "shard", "offset", F.col("key").alias("own"), F.col("occurrence").alias("times"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
    out = hits.join(records, ["part", "shard", "offset"]).where("length = n_tokens and key <=> own and occurrence = times").join(manifest.drop("path"), ["part", "shard"])
    return out.select("key", "occurrence", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def numbered_keys(docs: DataFrame) -> DataFrame:
    """(key, occurrence) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("occurrence"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "token-files")
    shards, index = scratch.path("shards"), scratch.path("index")
    write_shards(docs, shards, "byte_bpe_50k.json", 0)
    buckets = texts.blocks_for(docs.count(), BUCKET_KEYS)
    write_index(spark, shards, index, buckets)
    return fetch(numbered_keys(docs), shards, index, buckets, False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
