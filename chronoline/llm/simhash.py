"""Operator 10: SimHash near-duplicates through vantage-point trees.

1. One map gives every whole text a 64-bit fingerprint: a bit is set if it is set
   in over half of the XXH64 (seed 42) hashes of its word shingles.
2. Equal fingerprints fold into one node that carries the smallest doc_id.
3. A vantage-point tree over a bounded sample of nodes cuts Hamming space into
   shards: at each tree node a fingerprint goes left if its distance to the vantage
   point is under the split distance, else right. By the triangle bound a
   fingerprint within ``max_bits`` of the split may have partners on the other
   side. Of the two bands beside the split the thinner one also visits the other
   side, and from there every shard whose region it can reach. The sample decides
   the balance only; no pair is lost to it.
4. A shard that comes out over ``RECUT_OVER`` times its planned size is cut again by
   a deeper tree, fitted on a sample of that shard alone, up to ``RECUTS`` times.
5. Each shard searches home against home and visitors against home, with the same
   bounds down to small blocks, and returns links that span its local groups, never all
   pairs of a group.
6. Components of the links (``components``) over fingerprints name each group by its smallest doc_id.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any other; a text
of fewer words than a shingle is one shingle; repeated rows share a fingerprint
and so a component; rows whose doc_id is null get the component of their
fingerprint group, null if no other row has one; a doc_id with several texts has one row and one fingerprint a text, which link on
their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import checkpoint
from chronoline.llm.components import components, spanning_labels

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SAMPLE_NODES = 8192
SHARD_NODES = 4096
#: A shard is cut again beyond so many times SHARD_NODES rows of home and visitors; its tree is fitted on RECUT_SAMPLE fingerprints.
RECUT_OVER = 8
RECUT_SAMPLE = 1024
RECUTS = 4
BLOCK = 512
HASHES_AT_ONCE = 65536


def shingles(text: str | None, k: int) -> list[bytes]:
    """Word shingles in order, repeats included; fewer words than k: the whole sequence; none: none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    grams = shingles(text, k)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), HASHES_AT_ONCE):
        part = grams[at : at + HASHES_AT_ONCE]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype=np.uint64, count=len(part))
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(grams)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), k) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


@dataclass(frozen=True)
class Node:
    """Inner node (vantage point, split distance, sides, whether the left band visits) or leaf (shard number)."""

    vantage: int = 0
    split: int = 0
    left: Node | None = None
    right: Node | None = None
    left_visits: bool = True
    shard: int = -1


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ np.uint64(b) if not isinstance(b, np.ndarray) else a ^ b)


def choose_split(points: np.ndarray) -> tuple[int, int] | None:
    """Of a few points the one whose distances spread most, and the split that halves them best."""
    tried = points[:: max(1, len(points) // 8)][:8]
    spread = [distance(points, v).astype(np.float64).var() for v in tried]
    vantage = int(tried[int(np.argmax(spread))])
    d = np.sort(distance(points, vantage))
    middle = int(d[len(d) // 2])
    halves = [(abs(2 * int(np.searchsorted(d, s)) - len(d)), s) for s in (middle, middle + 1) if 0 < np.searchsorted(d, s) < len(d)]
    return (vantage, min(halves)[1]) if halves else None


def build_tree(points: np.ndarray, n_shards: int, r: int = MAX_BITS) -> tuple[Node, int]:
    """A balanced tree of about n_shards leaves over the sample; at each split the side with fewer points within r of it visits the other."""
    numbered = iter(range(2 * n_shards + 2))

    def grow(part: np.ndarray, leaves: int) -> Node:
        cut = choose_split(part) if leaves > 1 and len(part) > 1 else None
        if cut is None:
            return Node(shard=next(numbered))
        d = distance(part, cut[0])
        low, high = part[d < cut[1]], part[d >= cut[1]]
        share = min(leaves - 1, max(1, round(leaves * len(low) / len(part))))
        thin_left = np.count_nonzero((d < cut[1]) & (d + r >= cut[1])) <= np.count_nonzero((d >= cut[1]) & (d < cut[1] + r))
        return Node(cut[0], cut[1], grow(low, share), grow(high, leaves - share), bool(thin_left))

    root = grow(points, n_shards)
    return root, next(numbered)


def route(node: Node, fps: np.ndarray, home: np.ndarray, visit: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, home indices, visitor indices) of every shard that the indices reach."""
    if not len(home) and not len(visit):
        return
    if node.shard >= 0:
        yield node.shard, home, visit
        return
    dh, dv = distance(fps[home], node.vantage).astype(np.int64), distance(fps[visit], node.vantage).astype(np.int64)
    low = dh < node.split
    to_left, to_right = visit[dv - r < node.split], visit[dv + r >= node.split]
    # a pair that parts here is found on the side that its other member visits
    if node.left_visits:
        to_right = np.concatenate([to_right, home[low & (dh >= node.split - r)]])
    else:
        to_left = np.concatenate([to_left, home[~low & (dh < node.split + r)]])
    yield from route(node.left, fps, home[low], to_left, r)
    yield from route(node.right, fps, home[~low], to_right, r)


def search(fps: np.ndarray, home: np.ndarray, visit: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that span all pairs home-home and visitor-home within r bits."""
    found_a, found_b = [], []
    stack = [(home, visit)]
    while stack:
        home, visit = stack.pop()
        if not len(home) or len(home) + len(visit) < 2:
            continue
        cut = choose_split(fps[home]) if len(home) > BLOCK else None
        if cut is not None:
            dh, dv = distance(fps[home], cut[0]).astype(np.int64), distance(fps[visit], cut[0]).astype(np.int64)
            low = dh < cut[1]
            stack.append((home[low], visit[dv - r < cut[1]]))
            stack.append((home[~low], np.concatenate([visit[dv + r >= cut[1]], home[low & (dh >= cut[1] - r)]])))
            continue
        both = np.concatenate([home, visit])
        for i in range(0, len(home), BLOCK):
            mine = home[i : i + BLOCK]
            for j in range(i, len(both), BLOCK):
                other = both[j : j + BLOCK]
                x, y = np.nonzero(distance(fps[mine][:, None], fps[other][None, :]) <= r)
                a, b = mine[x], other[y]
                a, b = a[a != b], b[a != b]
                if not len(a):
                    continue
                ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = spanning_labels(len(ids), at[: len(a)], at[len(a) :])
                own = np.flatnonzero(label != np.arange(len(ids)))
                found_a.append(ids[own])
                found_b.append(ids[label[own]])
    if not found_a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _pairs(fps: np.ndarray, ids: np.ndarray) -> bytes:
    return np.stack([fps.view(np.int64), ids]).tobytes()


def _unpack(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(c, dtype=np.int64).reshape(2, -1) for c in chunks]
    both = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), dtype=np.int64)
    return both[0].view(np.uint64), both[1]


def _dealt(root: Node, first: int, fps: np.ndarray, ids: np.ndarray, home: np.ndarray, visit: np.ndarray, r: int) -> pa.RecordBatch:
    """Rows (shard, home, visit, points): what reaches each leaf, with a few of its home fingerprints for a later cut."""
    rows = [(first + s, _pairs(fps[h], ids[h]), _pairs(fps[v], ids[v]), fps[h][:: max(1, len(h) // 64)][:64].tobytes()) for s, h, v in route(root, fps, home, visit, r)]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=["shard", "home", "visit", "points"])


_DEALT = "shard bigint, home binary, visit binary, points binary"
#: Leaves of a tree are numbered below this; a shard's own leaves follow its number times this.
_SPAN = 4096


def _recut(dealt: DataFrame, max_bits: int, shard_nodes: int) -> DataFrame:
    """Cuts the shards that came out too large by a deeper tree of their own, until none is left or RECUTS rounds are over."""
    for _ in range(RECUTS):
        nodes = F.sum(F.octet_length("home") / 16), F.sum(F.octet_length("visit") / 16)
        sizes = dealt.groupBy("shard").agg(nodes[0].cast("long").alias("held"), (nodes[0] + nodes[1]).cast("long").alias("rows"))
        large = checkpoint(sizes.where(f"rows > {RECUT_OVER * shard_nodes} and held > {shard_nodes}").select("shard", "rows"))
        if large.isEmpty():
            return dealt

        def fit(shard: tuple, chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.empty(0, dtype=np.uint64)
            for chunk in chunks:
                new = np.frombuffer(b"".join(chunk.column(1).to_pylist()), dtype=np.uint64)
                held = np.concatenate([held, new])
                order = np.argsort(held * np.uint64(0x9E3779B97F4A7C15), kind="stable")  # an even choice, whatever the order of chunks
                held = held[order[:RECUT_SAMPLE]]
            yield pa.RecordBatch.from_arrays([pa.array([shard[0].as_py()], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["shard", "sample"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, root = None, Node(shard=0)
            for batch in batches:
                for shard, home, visit, sample, rows in zip(*(batch.column(i) for i in range(5))):
                    if shard.as_py() != last:
                        last, points = shard.as_py(), np.frombuffer(sample.as_py(), dtype=np.uint64)
                        root = build_tree(points, max(2, min(len(points) // 8, -(-rows.as_py() // shard_nodes))), max_bits)[0]
                    fps, ids = _unpack([home.as_py(), visit.as_py()])
                    n = len(home.as_py()) // 16
                    yield _dealt(root, (last + 1) * _SPAN, fps, ids, np.arange(n), np.arange(n, len(fps)), max_bits)

        chunks = dealt.join(large, "shard")
        samples = chunks.select("shard", "points").groupBy("shard").applyInArrow(fit, "shard bigint, sample binary")
        again = chunks.join(samples, "shard").select("shard", "home", "visit", "sample", "rows").mapInArrow(deal, _DEALT)
        dealt = checkpoint(dealt.join(large, "shard", "left_anti").unionByName(again))
    return dealt


def links(nodes: DataFrame, max_bits: int = MAX_BITS, sample_nodes: int = SAMPLE_NODES, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """nodes(fp, id) with distinct fp -> links (a, b) between ids that span all pairs within max_bits."""
    n = nodes.count()
    sample = [r["fp"] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_nodes).collect()]
    points = np.array(sample, dtype=np.int64).view(np.uint64)
    root = build_tree(points, max(1, min(len(points) // 8, -(-n // shard_nodes))), max_bits)[0] if len(points) else Node(shard=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            fps, ids = (np.concatenate([np.asarray(b.column(i)).astype(np.int64) for b in held]) for i in (0, 1))
            return _dealt(root, 0, fps.view(np.uint64), ids, np.arange(len(fps)), np.empty(0, dtype=np.int64), max_bits)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 200_000:
                yield flush()
                held = []
        if held:
            yield flush()

    def within(rows: pa.Table) -> pa.Table:
        home_fps, home_ids = _unpack(rows.column("home").to_pylist())
        visit_fps, visit_ids = _unpack(rows.column("visit").to_pylist())
        fps, ids = np.concatenate([home_fps, visit_fps]), np.concatenate([home_ids, visit_ids])
        a, b = search(fps, np.arange(len(home_fps)), np.arange(len(home_fps), len(fps)), max_bits)
        label = spanning_labels(len(fps), a, b)
        own = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[label[own]], pa.int64())})

    dealt = checkpoint(nodes.select("fp", F.col("id").cast("long").alias("id")).mapInArrow(deal, _DEALT))
    return _recut(dealt, max_bits, shard_nodes).drop("points").groupBy("shard").applyInArrow(within, "a bigint, b bigint")


def group_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints(doc_id, fp) -> doc_id, fp, component_id."""
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp", F.col("fp").alias("id")), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = roots.select("root").distinct()  # a print of its own needs no second look-up
    named = rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(named, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    grouped = group_fingerprints(checkpoint(fingerprints(docs, k)), max_bits)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
