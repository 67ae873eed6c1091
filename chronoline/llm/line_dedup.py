"""Operator 2: line dedup behind two Bloom filters.

A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased; only
keys of at least ``min_chars`` code points take part. The steps:

1. Every task hashes the distinct keys of each document into a pair of bit
   arrays: *once* (bit met) and *twice* (bit met again). Two pairs merge as
   ``once = a | b``, ``twice = a2 | b2 | (a & b)``; the merge is associative, so
   slices of the arrays are merged by key in parallel. A key in two documents has
   all its bits in *twice*: no repeat is ever missed.
2. A second pass probes *twice*. Only suspects leave their task: the 128-bit digest
   of the key with its document. They are counted exactly, and confirmed keys (in
   ``min_docs`` documents or more) keep the largest doc_id.
3. The confirmed (document, key) pairs return to their documents and the lines
   are dropped there. Only documents that lose a line shuffle for that.

Filters of single tasks are merged slice by slice in two rounds, first in ``MERGE_FAN`` parts
of the tasks, then these sums. Filter
memory is bounded by ``max_filter_bits`` (2 ** 27 bits are 16 MB a filter); beyond that the filters fill up, more keys are suspected and the exact
step confirms or clears them: results never change, only more digests shuffle. A document counts
once for a key however many rows it has; hot keys are counted with map-side partial sums, and the joins are plain sort-merge joins that
adaptive execution can split.

Defined cases: a null or empty text is one empty line; rows without an id are no document:
they hold no line against others and lose none; rows that share a doc_id are one document, which
counts once and whose rows all keep a line of which it is the largest holder; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import batches_of, broadcast_keys, checkpoint, free_names

COUNTS = ("n_lines", "n_dropped")
MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_LINE = 8
N_HASHES = 2
MIN_FILTER_BITS = 1 << 20
MAX_FILTER_BITS = 1 << 27
SLICE_BITS = 1 << 19
MERGE_FAN = 64
#: Slices of 128 KiB that travel in one Arrow batch.
SLICES_AT_ONCE = 64
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Key of a line in UTF-8, None if it is too short to take part."""
    key = line.strip(SPACE_BYTES).lower()  # bytes.lower() touches A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    if not text:
        return set()
    return {key for line in text.encode().split(b"\n") if (key := line_key(line, min_chars)) is not None}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of 64-bit hashes, one row for each of the N_HASHES probes."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(k) * high) % np.uint64(bits) for k in range(N_HASHES)])


def _hashes(keys: set[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(key) for key in keys]


class TwoFilters:
    """Once-seen and twice-seen bits, one byte a bit while a task fills them."""

    def __init__(self, bits: int):
        self.bits = bits
        self.seen = np.zeros(bits // 4, dtype=np.uint8)  # two bits a position: once, twice

    def add(self, hashes: np.ndarray) -> None:
        """hashes: of distinct keys of one document or of many documents in turn."""
        for at in positions(hashes, self.bits):
            spot, times = np.unique(at, return_counts=True)
            byte, shift = (spot >> np.uint64(2)).astype(np.int64), ((spot & np.uint64(3)) << np.uint64(1)).astype(np.uint8)
            was = (self.seen[byte] >> shift) & 1
            mark = np.where((was == 1) | (times > 1), np.uint8(3), np.uint8(1)) << shift
            np.bitwise_or.at(self.seen, byte, mark.astype(np.uint8))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Saturating sum of two packed arrays: the low bit of a pair is once, the high bit twice."""
    return a | b | ((a & b & np.uint8(0x55)) << 1)


def filter_bits(n_lines: int, max_bits: int = MAX_FILTER_BITS) -> int:
    want = max(MIN_FILTER_BITS, min(max_bits, n_lines * BITS_PER_LINE))
    return 1 << (want - 1).bit_length() if want < max_bits else max_bits


def build_twice_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The twice-seen filter of all documents as packed bits; at most max_filter_bits / 8 bytes reach the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(bits)
        for batch in batches:
            waiting: list[int] = []
            for text in batch.column(0):
                waiting.extend(_hashes(keys_of(text.as_py(), min_chars)))
                if len(waiting) > 200_000:
                    filters.add(np.array(waiting, dtype=np.uint64))
                    waiting = []
            if waiting:
                filters.add(np.array(waiting, dtype=np.uint64))
        step = SLICE_BITS // 4
        for k in range(0, len(filters.seen), step):
            part = filters.seen[k : k + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "bits"])

    def added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(bits_.as_py(), dtype=np.uint8)
                sums[k] = merge(sums[k], part) if k in sums else part
        return sums

    def row(k: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "bits"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (row(k, part) for k, part in added(batches).items())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in added(batches).items():
            yield row(k, np.packbits(np.unpackbits(part, bitorder="little")[1::2], bitorder="little"))

    kinds = "slice int, bits binary"
    filled = docs.select("text").mapInArrow(fill, kinds).withColumn("of", F.pmod(F.spark_partition_id(), F.lit(MERGE_FAN)))
    partly = filled.repartition("slice", "of").select("slice", "bits").mapInArrow(some, kinds)
    merged = partly.repartition("slice").mapInArrow(last, kinds)
    twice = np.zeros(bits // 8, dtype=np.uint8)
    with batches_of(docs.sparkSession, SLICES_AT_ONCE):
        for found in merged.toLocalIterator():
            part = np.frombuffer(found["bits"], dtype=np.uint8)
            twice[found["slice"] * len(part) :][: len(part)] = part
    return twice


def suspects(docs: DataFrame, twice: np.ndarray, bits: int, min_chars: int) -> DataFrame:
    """(doc_id, key): digests of the keys whose bits were all met twice, once a row."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)  # bounded by max_filter_bits
    kind = docs.schema["doc_id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = shared.value
        for batch in batches:
            keys: list[bytes] = []
            owner: list[int] = []
            for i, text in enumerate(batch.column(1)):
                own = keys_of(text.as_py(), min_chars)
                keys.extend(own)
                owner.extend([i] * len(own))
            if not keys:
                continue
            at = positions(np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64), bits)
            hit = np.all((bit[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, axis=0)
            found = np.flatnonzero(hit)
            ids = batch.column(0).take(pa.array([owner[i] for i in found], pa.int64()))
            digests = pa.array([hashlib.blake2b(keys[i], digest_size=16).digest() for i in found], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, digests], names=["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(probe, f"doc_id {kind}, key binary")


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(doc_id, keys): the digests whose lines each document loses."""
    n_lines = docs.where("doc_id is not null").select(F.sum(F.length("text") / 80 + 1).cast("long").alias("n")).first()["n"] or 0
    bits = filter_bits(n_lines, max_filter_bits)
    docs = docs.where("doc_id is not null")
    found = checkpoint(suspects(docs, build_twice_filter(docs, bits, min_chars), bits, min_chars).distinct())
    confirmed = found.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    # written out, so that both sides of the join are plain exchanges and a hot key can be split
    confirmed = checkpoint(confirmed.where(F.col("n_docs") >= min_docs).select("key", "keeper"))
    losing = found.join(confirmed, "key").where(F.col("doc_id") < F.col("keeper"))
    return losing.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS, counts: bool = True) -> DataFrame:
    """All columns of docs with text replaced by the kept lines, plus n_lines and n_dropped where counts are asked for.

    docs needs doc_id and text; with counts, columns named n_lines or n_dropped are replaced.
    """
    keys = dropped_keys(docs.select("doc_id", "text"), min_chars, min_docs, max_filter_bits)
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    (lost,) = free_names(docs.columns, "_lost_keys")
    # few documents lose a line: the others, and rows without an id, stay where they are
    losing = checkpoint(keys.select("doc_id", F.col("keys").alias(lost)))
    ids = broadcast_keys(losing.select("doc_id"))
    none = F.lit(None).cast("array<binary>").alias(lost)
    stay = docs.where("doc_id is not null").join(ids, "doc_id", "left_anti").select(*docs.columns, none)
    lose = docs.join(ids, "doc_id", "left_semi").join(losing, "doc_id").select(*docs.columns, lost)
    joined = stay.union(docs.where("doc_id is null").select(*docs.columns, none)).union(lose)
    at, lost_at, names = docs.columns.index("text"), len(docs.columns), [*docs.columns, *COUNTS[: 2 * counts]]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, losses = [], [], []
            for text, lost in zip(batch.column(at), batch.column(lost_at)):
                text, lost = text.as_py(), lost.as_py()
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if lost:
                    gone = set(lost)
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or hashlib.blake2b(k, digest_size=16).digest() not in gone]
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
                totals.append(len(lines))
                losses.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(lost_at)]
            columns[at] = pa.array(texts, batch.column(at).type)
            extra = [pa.array(totals, pa.int64()), pa.array(losses, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *extra[: 2 * counts]], names=names)

    return joined.mapInArrow(drop, ", ".join([*fields, *(f"{c} bigint" for c in COUNTS[: 2 * counts])]))


ORACLE = r"""
with l as (
  select doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
k as (select key, max(doc_id) as keeper from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select l.doc_id, i, line, k.key is not null and l.doc_id < keeper as gone from l left join k on l.key = k.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""
