"""Content-defined chunks of media columns: cut by a gear hash, deduplicated by digest, rebuilt from ordered lists."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder

#: Bits of the filter that tells chunks which may be shared: 1 MB, whatever the size of the corpus.
FILTER_BITS = 1 << 23


def le32(n: Column) -> Column:
    """A number as four little-endian bytes."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text, zero bytes appended up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / 64)) * 64
    return F.rpad(raw, size.cast("int"), F.unhex(F.lit("00")))


def wave(payload: Column, rate: int = 8000) -> Column:
    """A mono 8-bit PCM wave file whose samples are the payload's bytes."""
    n = F.octet_length(payload)
    fmt = struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8).hex()
    return F.concat(F.lit(b"RIFF"), le32(n + 36), F.lit(b"WAVEfmt "), F.unhex(F.lit(fmt)), F.lit(b"data"), le32(n), payload)


@lru_cache
def gear() -> np.ndarray:
    """A 32-bit number for each byte."""
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(bytes([b]), 6) for b in range(256)], np.uint32)


def cut_points(data: bytes, low: int, bits: int, high: int) -> list[int]:
    """Ends of the chunks: where the top ``bits`` bits of the gear hash of the last 32 bytes are 0, at least ``low`` and at most ``high`` apart."""
    h = gear()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # doubles the window: h[i] + h[i - k] << k
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
    ends, at = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - at > high:
            at += high
            ends.append(at)
        if c - at >= low:
            at = c
            ends.append(at)
    while len(data) - at > high:
        at += high
        ends.append(at)
    return ends + [len(data)] * (at < len(data))


def chunks(data: bytes, low: int, bits: int, high: int) -> list[tuple[bytes, bytes]]:
    """(SHA-256 digest, bytes) of each chunk in order."""
    ends = cut_points(data, low, bits, high)
    parts = [data[a:b] for a, b in zip([0, *ends], ends)]
    return [(hashlib.sha256(p).digest(), p) for p in parts]


def places(digest: bytes) -> list[int]:
    """A digest's bits in the filter."""
    return [x % FILTER_BITS for x in struct.unpack(">IIII", digest[:16])]


def shared_filter(digests: DataFrame) -> np.ndarray:
    """Filter bits of the digests that occur more than once; FILTER_BITS / 64 words at most reach the driver."""
    shared = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    place = [F.conv(F.hex(F.substring("digest", 1 + 4 * k, 4)), 16, 10).cast("long") % FILTER_BITS for k in range(4)]
    bits = shared.select(F.explode(F.array(*place)).alias("at"))
    words = bits.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    got, out = words.toPandas(), np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def write_store(media: DataFrame, path: str, low: int = 512, bits: int = 11, high: int = 8192) -> None:
    """Write ``media`` (key, media) as a chunk store under ``path``.

    recipes: key and its parts in order, each with its digest, and its bytes where no other chunk has that digest.
    chunks: digest and bytes of every other chunk, once. Which digests occur more than once is counted by Spark; tasks
    learn it from a filter of fixed size, and what it lets through too often only takes the longer way.
    Bytes of unshared chunks are written where they are read, and never shuffled.
    """
    spark = media.sparkSession

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                got = [d for m in b.column(0).slice(at, 256) for d, _ in chunks(m.as_py(), low, bits, high)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["digest"])

    mask = spark.sparkContext.broadcast(shared_filter(media.select("media").mapInArrow(digests, "digest binary")).tobytes())
    part = pa.struct([("digest", pa.binary()), ("data", pa.binary())])

    def landed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = np.frombuffer(mask.value, np.uint64), set()
        has = lambda d: all(int(words[p >> 6]) >> (p & 63) & 1 for p in places(d))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece, out = b.slice(at, 256), []
                for key, m in zip(piece.column(0).to_pylist(), piece.column(1)):
                    parts = []
                    for d, data in chunks(m.as_py(), low, bits, high):
                        if has(d):
                            parts.append({"digest": d, "data": None})
                            if d[:16] not in sent:
                                out.append((None, [], d, data, "chunk"))
                                if len(sent) > 200_000:  # a digest may then be sent again, and is merged when chunks are written
                                    sent.clear()
                                sent.add(d[:16])
                        else:
                            parts.append({"digest": d, "data": data})
                    out.append((key, parts, None, None, "recipe"))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(part), pa.binary(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "parts", "digest", "data", "kind"])

    schema = "key string, parts array<struct<digest: binary, data: binary>>, digest binary, data binary, kind string"
    media.select("key", "media").mapInArrow(landed, schema).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/landed")
    found = spark.read.schema(schema).parquet(f"{path}/landed").filter("kind = 'chunk'")
    found.groupBy("digest").agg(F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")


def read_store(spark, path: str) -> DataFrame:
    """key, parts (ordered digests and bytes) of every distinct key in a chunk store, all bytes in place."""
    schema = "key string, parts array<struct<digest: binary, data: binary>>, kind string"
    recipes = spark.read.schema(schema).parquet(f"{path}/landed").filter("kind = 'recipe'").select("key", "parts")
    whole = F.forall("parts", lambda p: p["data"].isNotNull())
    store = spark.read.schema("digest binary, data binary").parquet(f"{path}/chunks")
    some = recipes.filter(~whole)
    absent = F.array_distinct(F.transform(F.filter("parts", lambda p: p["data"].isNull()), lambda p: p["digest"]))
    asked = some.select("key", absent.alias("digests")).distinct().select("key", F.explode("digests").alias("digest"))
    got = asked.join(store, "digest").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("digest", "data"))).alias("got"))
    once = some.groupBy("key").agg(F.first("parts").alias("parts"))
    fill = lambda p: F.struct(p["digest"].alias("digest"), F.coalesce(p["data"], F.try_element_at("got", p["digest"])).alias("data"))
    filled = once.join(got, "key").select("key", F.transform("parts", fill).alias("parts"))
    return recipes.filter(whole).unionByName(filled)


def features(store: DataFrame) -> DataFrame:
    """Features of the media rebuilt from ``store`` (key, parts): their bytes must have the key as SHA-256.

    Returns key, payload_bytes, payload_sha256, tail_crc32 (of the last 64 samples), media_bytes, media_sha256, n_chunks, feature
    (chunks, mean and standard deviation of the samples, first digest).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for key, parts in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()):
                    media = b"".join(p["data"] for p in parts)
                    digest = hashlib.sha256(media).hexdigest()
                    size = struct.unpack_from("<I", media, 40)[0]
                    if digest != key or 44 + size != len(media):
                        raise ValueError(f"media {key} came back as {digest}")
                    samples = media[44:]
                    x = np.frombuffer(samples, np.uint8)
                    said = f"{len(parts)}:{x.mean():.4f}:{x.std():.4f}:{parts[0]['digest'].hex()[:16]}"
                    out.append((key, size, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), digest, len(parts), said))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_chunks", "feature"]
    return store.mapInArrow(run, "key string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks long, feature string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every text stored as a wave file in a chunk store, read back, verified and described.

    Returns doc_id, n_bytes and the columns of ``features``. Media are addressed by their SHA-256, so equal texts are one
    medium; repeated rows and null ids are kept, a null text is empty (64 zero samples), an empty table gives no rows.
    """
    path = path or new_folder(docs.sparkSession, "media")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), wave(payload_of(F.col(text_col))).alias("media"))
    rows = rows.withColumn("key", F.sha2("media", 256))
    write_store(rows.select("key", "media"), path)
    read = features(read_store(docs.sparkSession, path))
    return rows.select("doc_id", "n_bytes", "key").join(read, "key").drop("key")
