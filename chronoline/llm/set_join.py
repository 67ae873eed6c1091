"""Operator 13: exact n-gram Jaccard join with set-relation skipping.

1. Equal shingle sets fold into one node; its rows share its answer (``_nodes``). A set is never stored: each step hashes
   the texts that it needs again.
2. All sets order their shingles alike: shingles that many sets hold (``hot_cells``, counted over all of them) come last, others by
   hash. Sets at the similarity share a shingle in the first n - ceil(t n) + 1 of both (prefix filter), whatever the order; the order only
   keeps passages that many documents share out of the prefixes of documents that hold more than those.
3. Sets that meet in a prefix shingle are linked as candidates where size, position and the parity bits of both (``may_reach``) allow the similarity; a hot shingle,
   and a list of more than ``LIST_ROWS`` sets, links its sets to hubs of its size classes instead, without pairs (``_candidates``). The components of these links are clusters: a pair at the similarity lies in one cluster.
4. A cluster's sets meet in one task and are joined exactly (``Cluster``). Only sets that are not in the cluster's
   largest component yet are searched:
   - lists of the index are cut into blocks of equal size and position, and a block that cannot reach the similarity is skipped whole;
   - a set that differs little from one whose overlaps with all sets are known (a leader) derives its own overlaps from those, by the lists of
     the few shingles in which the two differ.
5. A cluster over ``GROUP_ROWS`` sets or ``GROUP_SHINGLES`` shingles is dealt to salted groups that hold the same few
   pivots; what stays outside its largest component is then searched against the whole cluster, in blocks (``_large_links``).
   No pair of different components is left out.

Shingles are told apart by their 64-bit hash.

Defined cases: null texts, empty ones and those of white space have the empty set, link with nothing and are their own component;
fewer words than a shingle are one shingle; repeated rows link like equal texts; an id that several rows hold has one row in
the result for each, linked by its own text; rows without an id are answered too, with the smallest id of their component, null if it has none; ids are
integers; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import broadcast_keys, checkpoint
from chronoline.llm.components import components, spanning_labels

SHINGLE_WORDS = 5
PERCENT = 80
#: A shingle of more sets than HOT_ROWS goes to the end of the order; at most HOT_MOST of them are broadcast (4 bytes each).
HOT_ROWS = 16
HOT_MOST = 1_000_000
LIST_ROWS = 256
SHARD_SHINGLES = 1_000_000
AT_ONCE = 500_000
GROUP_ROWS = 4_000
GROUP_SHINGLES = 1_000_000
BUNDLE_SHINGLES = 500_000
PIVOTS = 4
LEADERS = 32
#: A set derives its overlaps from a leader if their difference is at most this share of its size.
DERIVE_SHARE = 0.3
#: A prime and the steps of a published 64-bit finalizer.
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIXES = ((np.uint64(33), np.uint64(0xFF51AFD7ED558CCD)), (np.uint64(33), np.uint64(0xC4CEB9FE1A85EC53)))
#: Ids of hubs start here; keys of rows lie below.
HUBS = 1 << 62
#: Members of clusters are broadcast up to so many rows (48 bytes each).
MEMBERS_MOST = 300_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles: words are hashed once, and k neighbours are mixed."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(word):
        return word
    width = min(k, len(word))
    h = np.full(len(word) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = h * PRIME + word[i : len(word) - width + 1 + i]
    for shift, factor in MIXES:
        h = (h ^ (h >> shift)) * factor
    return np.unique(h ^ (h >> MIXES[0][0]))


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bit for each of a power of two of classes, at least as many as there are hashes: set if the class holds an odd number of them."""
    width = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_reach(a: bytes, b: bytes, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of n and m hashes with these bits can be at the similarity: bits that differ are hashes that only one set holds."""
    x, y, wide = (a, b, len(a) * 8) if len(a) >= len(b) else (b, a, len(b) * 8)
    bits = int.from_bytes(x, "little")
    while wide > len(y) * 8:
        wide //= 2
        bits = (bits >> wide) ^ (bits & ((1 << wide) - 1))
    apart = (bits ^ int.from_bytes(y, "little")).bit_count()
    return n + m - apart >= 2 * (-(-percent * (n + m) // (100 + percent)))


def prefix_size(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """How many leading shingles of a set of n must hold one of every partner's."""
    return n + 1 + -percent * n // 100


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Smallest intersection of sets of sizes a and b at the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def ordered(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Ascending hashes in the common order: those of hot cells last."""
    if not len(hot):
        return hashes
    cell = hashes.astype(np.uint32)
    is_hot = hot[np.minimum(np.searchsorted(hot, cell), len(hot) - 1)] == cell
    return np.concatenate([hashes[~is_hot], hashes[is_hot]]) if is_hot.any() else hashes


def keyed_rows(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the key is the id where one row holds it; other rows are written out and numbered below zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = checkpoint(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(f"n > 1 or doc_id is null or doc_id < 0 or doc_id >= {HUBS}").select(F.col("doc_id").alias("odd_id")))
    whole = rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    if odd.isEmpty():
        return whole
    keys, same = broadcast_keys(odd), F.col("doc_id").eqNullSafe(F.col("odd_id"))
    numbered = checkpoint(rows.join(keys, same, "left_semi").select((-1 - F.monotonically_increasing_id()).alias("key"), "doc_id", "text"))
    return whole.join(keys, same, "left_anti").union(numbered)


def _nodes(keyed: DataFrame, k: int) -> DataFrame:
    """key, doc_id, n, bits, node: the size and parity bits of each row's set and the least key of the rows with that set; null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), k) for t in batch.column(2)]
            digest = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(list(map(parity_bits, sets)), pa.binary())], names=["key", "doc_id", "n", "digest", "bits"])

    rows = checkpoint(keyed.mapInArrow(run, "key bigint, doc_id bigint, n bigint, digest binary, bits binary"))
    # written out, so that both sides of the join are plain exchanges and a hot set of copies can be split
    least = checkpoint(rows.where("n > 0").groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("rows")).where("rows > 1").select("digest", "node"))
    node = F.when(F.col("n") > 0, F.coalesce("node", "key"))
    return checkpoint(rows.join(broadcast_keys(least), "digest", "left").select("key", "doc_id", "n", F.when(F.col("key") == node, F.col("bits")).alias("bits"), node.alias("node")))


def _frequent(sets: DataFrame, k: int, shards: int, over: int) -> DataFrame:
    """cell, n: the low 32 bits of shingle hashes that more than so many sets share; in shards by cell, each task's own counts added up first."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        shard = cell.astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        cell, n, shard = cell[order], n[order].astype(np.uint32), shard[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        cells, counts = ([x.tobytes() for x in np.split(v, cuts)] for v in (cell, n))
        return pa.RecordBatch.from_arrays([pa.array(shard[np.r_[0, cuts]]), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_hashes(text.as_py(), k).astype(np.uint32))
                size += len(held[-1])
                if size > AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def added(table: pa.Table) -> pa.Table:
        cell, count = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.uint32) for c in ("cells", "counts"))
        cell, at = np.unique(cell, return_inverse=True)
        n = np.bincount(at, weights=count).astype(np.int64)
        return pa.table({"cell": pa.array(cell[n > over].astype(np.int64)), "n": pa.array(n[n > over])})

    return sets.select("text").mapInArrow(run, "shard bigint, cells binary, counts binary").groupBy("shard").applyInArrow(added, "cell bigint, n bigint")


def hot_cells(sets: DataFrame, k: int, shards: int) -> np.ndarray:
    """Ascending cells (the low 32 bits of a hash) of the most frequent shingles: those over HOT_ROWS sets, or of the highest powers of two beyond where these are over HOT_MOST.

    Any order gives the same result; at very many shingles all cells fill alike and only what stands out above that is hot.
    """
    over = checkpoint(_frequent(sets, k, shards, HOT_ROWS))
    level = F.floor(F.log2("n"))
    levels = sorted((r["level"], r["count"]) for r in over.groupBy(level.alias("level")).count().collect())
    while sum(n for _, n in levels) > HOT_MOST:
        levels = levels[1:]
    if not levels:
        return np.empty(0, dtype=np.uint32)
    found = over.where(level >= levels[0][0]).select("cell").toArrow().column("cell").to_numpy()
    return np.sort(found.astype(np.uint32))


def _candidates(sets: DataFrame, rows: DataFrame, k: int, percent: int, shards: int, hot: Broadcast, known: DataFrame | None = None) -> DataFrame:
    """a, b: links whose components hold every pair at the similarity that known(node, root) does not join; ids from HUBS on are hubs.

    A prefix shingle of a hot cell links its set to hubs at once. The others meet in shards, packed: 24 bytes each; of the pairs found there, those whose parity bits
    differ too much are no candidates.
    """
    step = np.log(100 / percent)

    def hub_links(token: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """To the hubs of a size class and the next: sets at the similarity are of the same class or of neighbouring ones."""
        size = np.floor(np.log(n) / step + 1e-9).astype(np.uint64)
        hub = lambda c: ((token * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(2)).astype(np.int64) | HUBS
        return np.stack([np.r_[key, key], np.r_[hub(size), hub(size + np.uint64(1))]])

    def folded(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of one task as a forest."""
        ids, flat = np.unique(links, return_inverse=True)
        flat = flat.reshape(2, -1)
        label = spanning_labels(len(ids), flat[0], flat[1])
        own = np.flatnonzero(label != np.arange(len(ids)))
        return ids[own], ids[label[own]]

    def flush(own: list[np.ndarray], keys: list[int], sizes: list[int]) -> pa.RecordBatch:
        lead = np.array(list(map(len, own)), dtype=np.int64)
        of = np.repeat(np.arange(len(lead)), lead)
        token, place = np.concatenate(own), np.arange(lead.sum()) - np.repeat(np.cumsum(lead) - lead, lead)
        key, n = np.array(keys, dtype=np.int64)[of], np.array(sizes, dtype=np.int64)[of]
        is_hot = np.isin(token.astype(np.uint32), hot.value)
        a, b = folded(hub_links(token[is_hot], key[is_hot], n[is_hot]))
        cold = np.flatnonzero(~is_hot)
        shard = (token[cold] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cold, shard = cold[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        heads = shard[np.r_[0, cuts]] if len(shard) else shard
        parts = [[x.tobytes() for x in np.split(v[cold], cuts)][: len(heads)] for v in (token, key, n.astype(np.uint32), place.astype(np.uint32))]
        none = pa.nulls(len(heads), pa.int64())
        packed = [pa.concat_arrays([pa.array(p, pa.binary()), pa.nulls(len(a), pa.binary())]) for p in parts]
        links = [pa.concat_arrays([none, pa.array(x, pa.int64())]) for x in (a, b)]
        # hub links ride along in the shard of their place in the batch
        at = pa.array(np.r_[heads, np.arange(len(a)) % shards], pa.int64())
        return pa.RecordBatch.from_arrays([at, *packed, *links], names=["shard", "tokens", "keys", "sizes", "places", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, sizes, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(*batch.columns):
                h = shingle_hashes(text.as_py(), k)
                own.append(ordered(h, hot.value)[: prefix_size(len(h), percent)])
                keys.append(key.as_py())
                sizes.append(len(h))
                held += len(own[-1])
                if held > AT_ONCE:
                    yield flush(own, keys, sizes)
                    own, keys, sizes, held = [], [], [], 0
        if held:
            yield flush(own, keys, sizes)

    def linked(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table.column("tokens")))
        token, key, n, place = (np.frombuffer(b"".join(own.column(c).to_pylist()), dtype=t) for c, t in (("tokens", np.uint64), ("keys", np.int64), ("sizes", np.uint32), ("places", np.uint32)))
        rides = table.filter(pa.compute.is_null(table.column("tokens")))
        sure = [np.stack([rides.column(c).to_numpy() for c in ("a", "b")])]
        _, of, rows = np.unique(token, return_inverse=True, return_counts=True)
        met = np.flatnonzero(rows[of] > 1)
        token, key, n, place, rows = token[met], key[met], n[met].astype(np.int64), place[met].astype(np.int64), rows[of[met]]
        long = rows > LIST_ROWS
        sure.append(hub_links(token[long], key[long], n[long]))
        found = [np.empty((2, 0), np.int64)]
        at = np.flatnonzero(~long)
        at = at[np.lexsort((place[at], n[at], token[at]))]
        token, key, n, place = token[at], key[at], n[at], place[at]
        i, apart = np.arange(len(at)), 1
        while True:
            i = i[i + apart < len(at)]
            i = i[(token[i] == token[i + apart]) & (100 * n[i] >= percent * n[i + apart])]
            if not len(i):
                break
            j = i + apart
            near = np.minimum(n[i] - place[i], n[j] - place[j]) >= least_overlap(n[i], n[j], percent)
            found.append(np.stack([key[i[near]], key[j[near]]]))
            apart += 1
        a, b = folded(np.concatenate(sure, axis=1))
        pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        known = np.r_[np.ones(len(a), bool), np.zeros(pairs.shape[1], bool)]
        return pa.table({"a": pa.array(np.r_[a, pairs[0]], pa.int64()), "b": pa.array(np.r_[b, pairs[1]], pa.int64()), "sure": pa.array(known)})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *sides = batch.columns
            keep = pa.array([may_reach(*s, percent) for s in zip(*(c.to_pylist() for c in sides))], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    packed = "shard bigint, tokens binary, keys binary, sizes binary, places binary, a bigint, b bigint"
    found = checkpoint(sets.select("key", "text").mapInArrow(run, packed).groupBy("shard").applyInArrow(linked, "a bigint, b bigint, sure boolean"))
    side = lambda at: rows.where("key = node").select(F.col("key").alias(at), F.col("bits").alias(f"bits_{at}"), F.col("n").alias(f"n_{at}"))
    pairs = found.where("not sure").select("a", "b").distinct()
    if known is not None:
        root = lambda df, at: df.join(known.select(F.col("node").alias(at), F.col("root").alias(f"root_{at}")), at, "left")
        pairs = root(root(pairs, "a"), "b").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    return found.where("sure").select("a", "b").union(pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(near, "a bigint, b bigint"))


class Cluster:
    """Sets of one group, joined exactly. sets hold ascending hashes; label: an index of the same component for each set, as far as it is known."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, percent: int = PERCENT):
        self.percent, self.m = percent, len(sets)
        self.n = np.array(list(map(len, sets)), dtype=np.int64)
        by_size = np.argsort(self.n, kind="stable")
        self.given = by_size  # own number -> number as given
        back = np.empty(self.m, dtype=np.int64)
        back[by_size] = np.arange(self.m)
        self.n = self.n[by_size]
        self.label = back[label[by_size]]
        self.label = spanning_labels(self.m, np.arange(self.m), self.label)
        _, flat = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)
        self.ends = np.cumsum(self.n)
        self.vocabulary = int(flat.max()) + 1
        self.held = np.bincount(flat, minlength=self.vocabulary)
        owner = np.repeat(np.arange(self.m), self.n)
        order = np.lexsort((flat, self.held[flat], owner))
        self.token = flat[order]  # of each set in turn, rare ones first
        self.place = np.arange(len(flat)) - np.repeat(self.ends - self.n, self.n)
        # whole lists by token
        by_token = np.argsort(self.token, kind="stable")
        self.list_owner = owner[by_token]
        self.list_end = np.cumsum(self.held)
        # blocks of equal token, size and place over the prefixes
        lead = np.flatnonzero(self.place < prefix_size(self.n, percent)[owner])
        lead = lead[np.lexsort((self.place[lead], self.n[owner[lead]], self.token[lead]))]
        self.entry = owner[lead]
        t, size, place = self.token[lead], self.n[self.entry], self.place[lead]
        heads = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(size) != 0) | (np.diff(place) != 0)])
        self.block_start = np.r_[heads, len(lead)]
        self.block_size, self.block_place = size[heads], place[heads]
        self.list_blocks = np.searchsorted(t[heads], np.arange(self.vocabulary + 1))
        self.mark = np.zeros(self.vocabulary, dtype=bool)
        self.leaders: dict[int, np.ndarray] = {}
        self.derived = self.skipped = self.looked_up = 0

    def set_of(self, i: int) -> np.ndarray:
        return self.token[self.ends[i] - self.n[i] : self.ends[i]]

    @staticmethod
    def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())

    def _tallied(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        count = self.held[tokens]
        return np.bincount(self.list_owner[self._ranges(self.list_end[tokens] - count, count)], minlength=self.m)

    def lead(self, i: int) -> np.ndarray:
        """Overlaps of set i with all sets, kept for others to derive theirs from."""
        overlap = self._tallied(self.set_of(i))
        if len(self.leaders) < LEADERS:
            self.leaders[i] = overlap
        return overlap

    def derive(self, i: int, leader: int) -> np.ndarray:
        """Overlaps of set i from the leader's: more by the tokens only i holds, fewer by those only the leader holds."""
        own, its = self.set_of(i), self.set_of(leader)
        self.mark[its] = True
        more = own[~self.mark[own]]
        self.mark[its] = False
        self.mark[own] = True
        fewer = its[~self.mark[its]]
        self.mark[own] = False
        return self.leaders[leader] + self._tallied(more) - self._tallied(fewer)

    def look_up(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that may reach the similarity to i by the blocks of its prefix's lists, and their overlaps."""
        tokens = self.set_of(i)[: prefix_size(int(self.n[i]), self.percent)]
        first, count = self.list_blocks[tokens], self.list_blocks[tokens + 1] - self.list_blocks[tokens]
        block, place = self._ranges(first, count), np.repeat(np.arange(len(tokens)), count)
        size = self.block_size[block]
        ok = np.minimum(self.n[i] - place, size - self.block_place[block]) >= least_overlap(self.n[i], size, self.percent)
        self.looked_up += len(block)
        self.skipped += int((~ok).sum())
        block = block[ok]
        other = np.unique(self.entry[self._ranges(self.block_start[block], self.block_start[block + 1] - self.block_start[block])])
        other = other[self.label[other] != self.label[i]]
        if not len(other):
            return other, other
        self.mark[self.set_of(i)] = True
        n = self.n[other]
        met = np.add.reduceat(self.mark[self.token[self._ranges(self.ends[other] - n, n)]].astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
        self.mark[self.set_of(i)] = False
        return other, met

    def search(self, i: int) -> None:
        """Joins set i to every set at the similarity."""
        best = max(self.leaders, key=lambda y: 2 * self.leaders[y][i] - self.n[y], default=None)
        other = np.arange(self.m)
        if best is not None and self.n[i] + self.n[best] - 2 * self.leaders[best][i] <= DERIVE_SHARE * self.n[i]:
            met = self.derive(i, best)
            self.derived += 1
        elif not self.leaders and self.m > 2:
            met = self.lead(i)
        else:
            other, met = self.look_up(i)
        ok = 100 * met >= self.percent * (self.n[i] + self.n[other] - met)
        ok &= other != i
        if ok.any():
            self.label = spanning_labels(self.m, np.r_[np.arange(self.m), np.full(int(ok.sum()), i)], np.r_[self.label, other[ok]])
        if len(other) < self.m and ok.sum() > 1 and len(self.leaders) < LEADERS:
            self.lead(i)

    def run(self) -> np.ndarray:
        """label of each set as given: an index of the least set, as given, of its component."""
        open_ = np.ones(self.m, dtype=bool)
        common = np.add.reduceat(self.held[self.token], self.ends - self.n) / self.n
        first = int(np.argmax(common))
        while True:
            left = np.flatnonzero(open_)
            labels, at, count = np.unique(self.label[left], return_inverse=True, return_counts=True)
            if len(labels) < 2:
                break
            if open_.all() and self.m > 2:
                i = first
            else:
                outside = left[at != np.argmax(count)]
                i = int(outside[0])
            self.search(i)
            open_[i] = False
        out = np.empty(self.m, dtype=np.int64)
        out[self.given] = self.given[self.label]
        return spanning_labels(self.m, np.arange(self.m), out)


def _joined(members: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """members(cluster, salt, block, bundle, key, root), sets(key, text) -> links (a, b) that span the pairs at the similarity of each (cluster, salt, block)."""
    fields = ["cluster", "salt", "block", "bundle", "key", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), k).tobytes() for t in batch.column(len(fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(hashes, pa.binary())], names=[*fields, "hashes"])

    def join(table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_numpy() for c in fields}
        hashes = table.column("hashes")
        order = np.lexsort((raw["key"], raw["block"], raw["salt"], raw["cluster"]))
        cuts = np.flatnonzero(sum(np.diff(raw[c][order]) != 0 for c in ("cluster", "salt", "block"))) + 1
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in np.split(order, cuts):
            key = raw["key"][at]
            at = at[np.r_[True, np.diff(key) != 0]]  # a pivot may be in its group already
            key = raw["key"][at]
            if len(at) < 2:
                continue
            _, first, label = np.unique(raw["root"][at], return_index=True, return_inverse=True)
            found = Cluster([np.frombuffer(hashes[i].as_py(), dtype=np.uint64) for i in at.tolist()], first[label], percent).run()
            a.append(key)
            b.append(key[found])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    kinds = ", ".join(f"{c} bigint" for c in fields)
    met = sets.select("key", "text").join(broadcast_keys(members, MEMBERS_MOST), "key").select(*fields, "text").mapInArrow(run, f"{kinds}, hashes binary")
    return met.groupBy("bundle").applyInArrow(join, "a bigint, b bigint")


def _own_bundle() -> Column:
    """A group of its own for each (cluster, salt, block); below zero, where no bundle of small clusters lies."""
    return (-1 - F.pmod(F.xxhash64("cluster", "salt", "block"), F.lit(1 << 40))).alias("bundle")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with root: the component's node as far as it is known."""
    if roots is None:
        return rows.withColumn("root", F.col("key"))
    return rows.join(roots, F.col("key") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "key"))


def _groups(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / GROUP_ROWS), F.ceil(shingles / GROUP_SHINGLES)).cast("long")


def _large_links(large: DataFrame, sets: DataFrame, k: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """large(cluster, key, n) and known(node, root) -> links within clusters of any size: salted groups with common pivots first, then what stays outside the largest component, in blocks, against all."""
    zero = F.lit(0).cast("long")
    salted = lambda groups, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(groups))
    pivot = F.array(*[F.min_by("key", F.xxhash64("key", F.lit(p))) for p in range(PIVOTS)]).alias("pivots")
    sizes = checkpoint(large.groupBy("cluster").agg(_groups(F.count("*"), F.sum("n")).alias("groups"), pivot))
    each = F.explode(F.sequence(zero, F.col("groups") - 1)).alias("salt")
    own = checkpoint(large.join(sizes.select("cluster", "groups"), "cluster").select("cluster", salted("groups", -1).alias("salt"), "key", "n"))
    pivots = sizes.select("cluster", each, "pivots").select("cluster", "salt", F.explode("pivots").alias("key"))
    first = _rooted(own.select("cluster", "salt", "key").union(pivots).distinct().withColumn("block", zero), known)
    links = _joined(checkpoint(first.select("*", _own_bundle())), sets, k, percent)
    roots = components(links if known is None else links.union(known.toDF("a", "b")))

    held = checkpoint(_rooted(own, roots))
    ranked = held.groupBy("cluster", "root").agg(F.count("*").alias("rows")).groupBy("cluster").agg(F.max_by("root", F.struct("rows", -F.col("root"))).alias("largest"))
    rest = checkpoint(held.join(ranked, "cluster").where("root <> largest").select("cluster", "key", "n", "root"))
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if rest.isEmpty():
        return found
    blocks = checkpoint(rest.groupBy("cluster").agg(_groups(F.count("*"), F.sum("n")).alias("blocks")))
    asking = rest.join(blocks, "cluster").join(sizes.select("cluster", "groups"), "cluster").select("cluster", each, salted("blocks", -2).alias("block"), "key", "root")
    asked = held.join(blocks, "cluster").select("cluster", "salt", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "key", "root")
    second = asking.union(asked).distinct().select("*", _own_bundle())
    return found.union(_joined(checkpoint(second), sets, k, percent))


def _cluster_links(candidates: DataFrame, rows: DataFrame, sets: DataFrame, k: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """Exact links of the pairs that lie in a component of the candidate links; a cluster that known(node, root) joins whole is done."""
    found = components(candidates)
    clusters = found.where(F.col("node") < HUBS).select(F.col("node").alias("key"), F.col("root").alias("cluster")).union(found.select("root", "root").distinct())
    sized = checkpoint(_rooted(clusters.join(rows.where("key = node").select("key", "n"), "key"), known))
    sums = sized.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    sums = checkpoint(sums.drop("r0", "r1").withColumn("large", F.expr(f"rows > {GROUP_ROWS} or (rows > 2 and shingles > {GROUP_SHINGLES})")))
    total = sums.agg(F.sum(F.when(~F.col("large"), F.col("shingles"))).alias("shingles"), F.max("large").alias("large")).first()
    members = sized.join(sums, "cluster")
    zero, bundles = F.lit(0).cast("long"), F.lit(1 + (total["shingles"] or 0) // BUNDLE_SHINGLES)
    small = members.where("not large").select("cluster", zero.alias("salt"), zero.alias("block"), "key", "root", F.pmod(F.xxhash64("cluster"), bundles).alias("bundle"))
    links = _joined(checkpoint(small), sets, k, percent)
    return links.union(_large_links(checkpoint(members.where("large").select("cluster", "key", "n")), sets, k, percent, known)) if total["large"] else links


def set_links(sets: DataFrame, rows: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, known: DataFrame | None = None) -> DataFrame:
    """a, b: links that join, with those of known(node, root), every pair at the similarity.

    sets(key, text); rows(key, node, n, bits), of which those with key = node are the sets'.
    """
    shards = 1 + (rows.where("key = node").agg(F.sum("n").alias("n")).first()["n"] or 0) // SHARD_SHINGLES
    hot = sets.sparkSession.sparkContext.broadcast(hot_cells(sets, k, shards))  # at most HOT_MOST cells
    return _cluster_links(_candidates(sets, rows, k, percent, shards, hot, known), rows, sets, k, percent, known)


def join_sets(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable) of every row; sets link where 100 * intersection >= percent * union."""
    keyed = keyed_rows(docs)
    rows = _nodes(keyed, k)
    idle = checkpoint(rows.where("node is null or node <> key").select("key"))
    sets = keyed.join(broadcast_keys(idle), "key", "left_anti")
    roots = components(set_links(sets, rows, k, percent))

    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = checkpoint(least.join(roots.toDF("of", "root"), F.col("node") == F.col("of"), "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root")))
    # a node that nothing links to and that one row holds answers with its own id
    linked = checkpoint(roots.select("root").distinct())
    named = nodes.join(broadcast_keys(linked), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    answers = nodes.join(checkpoint(named), "root", "left").where("component_id is not null or copies > 1").select("node", F.coalesce("component_id", "least").alias("component_id"))
    told = rows.join(broadcast_keys(checkpoint(answers)), "node", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: Every pair that shares a shingle is compared, and components are the closure of the links.
ORACLE = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
place as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0),
gram as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from place),
size as (select doc_id, count(*) as n from gram group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as k from gram a join gram b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select a, b from met join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from docs union select reach.a, link.b from reach join link on link.a = reach.b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(b)::bigint as component_id
from docs d left join size s on s.doc_id = d.doc_id join reach r on r.a = d.doc_id group by d.doc_id, n"""
