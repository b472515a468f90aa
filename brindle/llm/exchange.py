"""Request and reply over hashed keys in packed blocks.

A *block* is a bundle of documents whose 64-bit keys are made, sorted and merged with numpy. A block sends its
distinct keys, cut by equal ranges of the hash space, to buckets; a bucket merges what all blocks sent and
replies to each block in the order of its own keys. Rows of the shuffle are packed arrays, so the
cost per key is that of a sort and no row object is made for it; a key is sent once a block however often it
occurs there, so a frequent key weighs as much as there are blocks.
"""

from __future__ import annotations

import math
import threading

import numpy as np
import zstandard
from pyspark.sql import DataFrame


_own = threading.local()


def _zstd() -> tuple:
    """This thread's compressor and decompressor: making them costs more than a small array does."""
    if not hasattr(_own, "zstd"):
        _own.zstd = zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()
    return _own.zstd


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: planes that are constant cost nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return _zstd()[0].compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(_zstd()[1].decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as differences; the low bits that all of them lack aren't stored."""
    low = int(np.bitwise_or.reduce(keys)) if len(keys) else 0
    z = (low & -low).bit_length() - 1 if low else 0
    return bytes([z]) + pack(np.diff(keys >> np.uint64(z), prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b[1:], np.uint64), dtype=np.uint64) << np.uint64(b[0])


def pack_values(a: np.ndarray) -> bytes:
    """Floats that repeat: the distinct ones and which each is, where that is shorter than the floats themselves."""
    plain = b"\0" + pack(a)
    if not len(a):
        return plain
    values, place = np.unique(a, return_inverse=True)
    if 4 * len(values) > 3 * len(a):
        return plain
    head = pack(values)
    told = b"\1" + len(head).to_bytes(8, "little") + head + pack(place.astype(np.uint32))
    return min(plain, told, key=len)


def unpack_values(b: bytes) -> np.ndarray:
    if b[0] == 0:
        return unpack(b[1:], np.float64)
    n = int.from_bytes(b[1:9], "little")
    return unpack(b[9 : 9 + n], np.float64)[unpack(b[9 + n :], np.uint32)]


def bounds(buckets: int) -> np.ndarray:
    """First key of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, index of one occurrence, place of each key among the distinct, counts)."""
    order = np.argsort(keys).astype(np.int32)  # a block has far fewer than 2**31 keys
    s = keys[order]
    first = np.empty(len(s), bool)
    first[:1] = True
    np.not_equal(s[1:], s[:-1], out=first[1:])
    at = np.flatnonzero(first).astype(np.int32)
    place = np.empty(len(s), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return s[at], order[at], place, np.diff(np.append(at, np.int32(len(s))))


def cut(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, slice) of the buckets that sorted ``keys`` fall in."""
    edge = np.concatenate(([0], np.searchsorted(keys, bounds(buckets)), [len(keys)]))
    return [(b, slice(edge[b], edge[b + 1])) for b in np.flatnonzero(np.diff(edge))]


def merged(blobs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """(distinct keys, index of one occurrence, place of each, slice of each blob) of the concatenated blobs."""
    sizes = [len(b) for b in blobs]
    edge = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    uniq, one, place, _ = distinct(np.concatenate(blobs) if blobs else np.empty(0, np.uint64))
    return uniq, one, place, [slice(a, b) for a, b in zip(edge[:-1], edge[1:])]


def buckets_for(keys: int, per_bucket: int = 1_500_000, least: int = 12) -> int:
    """A count of buckets that keeps a bucket's arrays at one size however large the input is."""
    return max(least, math.ceil(keys / per_bucket))


def next_block() -> int:
    """A number for a block that no other block of the running job has."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    n = getattr(ctx, "_brindle_blocks", 0)
    ctx._brindle_blocks = n + 1
    return ((ctx.partitionId() if ctx else 0) << 24) | n


def spread(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Shuffle by ``key`` into ``parts`` partitions that stay apart (a block is more work than its bytes tell)."""
    return df.repartition(max(1, parts), key)


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Shuffle by the int column ``bucket``, each bucket a partition of its own."""
    return df.repartitionById(buckets, "bucket")
