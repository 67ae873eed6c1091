"""Groups of documents of high shingle similarity, for operator 10 at a similarity threshold.

Two bits of a SimHash stand for nearly equal texts only: a Jaccard similarity of
0.8 moves about ten of 64 bits, a radius at which vantage-point bounds no longer prune.
At such a threshold this search is therefore added to the vantage-point one:

1. Equal word sequences fold into one node. Its shingle hashes are not stored: a step that needs them hashes the texts again. A node carries its SimHash, the least
   shingle hash of each of ``PARTS`` parts of the hash space (each agrees between two texts with a
   probability equal to their similarity) and a one-permutation sketch of ``BINS`` bytes.
2. Nodes meet in a group if they agree in a part. A pair is looked at only where it has no earlier part in
   common, so once. Groups over ``GROUP_ROWS`` nodes or ``GROUP_SHINGLES`` shingles are replaced by groups that agree in
   one more, later part (``refine``), and those again; so text that many documents share (a passage, a
   licence) does not make a group of all of them. What is still large after ``LEVELS`` parts is a clump of
   copies: it is dealt to salted groups which all hold a few pivots of the clump, and what this does not join to the
   clump's largest component is compared, in blocks, with the whole clump.
3. In a group SimHash distance, sizes and sketches only sort the pairs (``compare``): an estimate over the
   similarity by ``MARGIN`` links, one under it by ``MARGIN`` does not, and rows of a pair between go on.
4. Those rows meet again in the same group, now with all their shingle hashes, and every pair of them that is not
   joined already is decided exactly (``decide``).
5. What the groups cannot find (pairs that agree in no part, pairs whose common parts are all large and fewer than ``LEVELS``, pairs
   that an estimate screens out) is found by operator 13's exact join over all nodes (``rest_links``): prefixes meet, and of their
   candidates only pairs and clusters that are not joined yet are decided. No pair at the similarity is missed.

A link by a clear estimate is wrong only where the sketch (deviation 0.025 at most around 0.8) is off by over four deviations. Texts under ``FEW``
shingles are never linked by an estimate or screened by SimHash. The similarity is a whole number of percents.

Defined cases: null and empty texts and texts of white space are one node of no shingles and similar to each other alone;
texts under a shingle's words are one shingle; repeated rows and equal texts fold; rows without an id take part and rank behind all
ids; a doc_id with several texts has each of them in its own group; an empty table gives an empty result;
other columns pass through ``keep_one`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chronoline.llm.common import broadcast_keys, checkpoint, free_names
from chronoline.llm.components import components, spanning_labels
from chronoline.llm.set_join import keyed_rows, parity_bits, set_links
from chronoline.llm.simhash import BLOCK, MAX_BITS, SEED, links, shingles

PARTS = 8
PART_SHIFT = np.uint64(61)
BINS = 256
#: At a similarity of 0.8 and FEW shingles or more about ten bits differ, with a deviation of three.
SCREEN_BITS = 28
MARGIN = 0.12
FEW = 64
FEW_MARGIN = 0.3
PAIRS_AT_ONCE = 8192
GROUP_ROWS = 8_000
GROUP_SHINGLES = 4_000_000
LEVELS = 3
PIVOTS = 8
MIX = np.uint64(0x9E3779B97F4A7C15)
#: What a node brings to a group, and its Spark types.
CARRIED = ["id", "fp", "n", "parts", "sketch"]
GROUP_KEYS = ["mask", "key", "salt", "block"]
#: Groups of at most so many nodes are searched in bundles of about BUNDLE_ROWS.
SMALL_ROWS = 32
BUNDLE_ROWS = 10_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Ascending distinct hashes of the shingles."""
    grams = shingles(text, k)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(grams)))


def word_digest(text: str | None) -> bytes:
    return hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=16).digest()


def sketch(h: np.ndarray) -> tuple[int, list[int], bytes]:
    """SimHash, least hash of each part (0: none) and sketch of the distinct shingle hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])
    g = np.sort(h * MIX)
    part = (g >> PART_SHIFT).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    parts = np.zeros(PARTS, dtype=np.uint64)
    parts[part[starts]] = g[starts] | np.uint64(1)
    values = np.zeros(BINS, dtype=np.uint8)
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values[bins[first]] = np.maximum((h[first] & np.uint64(0xFF)).astype(np.uint8), 1)
    return fp, parts.view(np.int64).tolist(), values.tobytes()


def sketches(keyed: DataFrame, k: int) -> DataFrame:
    """id, doc_id, digest, fp, n, parts, sketch and parity bits of the shingle hashes of every row of keyed(key, doc_id, text)."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = [word_digest(t.as_py()) for t in batch.column(2)]
            hashes = [shingle_hashes(t.as_py(), k) for t in batch.column(2)]
            fp, parts, values = zip(*map(sketch, hashes)) if hashes else ((), (), ())
            columns = [
                pa.array(digest, pa.binary()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(list(map(len, hashes)), pa.int64()),
                pa.array(parts, pa.list_(pa.int64())), pa.array(values, pa.binary()), pa.array(list(map(parity_bits, hashes)), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "doc_id", "digest", "fp", "n", "parts", "sketch", "bits"])

    return keyed.select("key", "doc_id", "text").mapInArrow(run, f"id bigint, doc_id {kind}, digest binary, fp bigint, n bigint, parts array<bigint>, sketch binary, bits binary")


def hashed(sets: DataFrame, k: int) -> DataFrame:
    """sets(id, hashes) as they are, or the hashes of sets(id, text)."""
    if "hashes" in sets.columns:
        return sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), k).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], names=["id", "hashes"])

    return sets.select("id", "text").mapInArrow(run, "id bigint, hashes binary")


def estimates(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the sketches of the pairs."""
    found = [np.empty(0)]
    for at in range(0, len(a), PAIRS_AT_ONCE):
        p, q = values[a[at : at + PAIRS_AT_ONCE]], values[b[at : at + PAIRS_AT_ONCE]]
        found.append(((p == q) & (p > 0)).sum(axis=1) / np.maximum(1, ((p > 0) | (q > 0)).sum(axis=1)))
    return np.concatenate(found)


class Rows:
    """Rows of one group, or of a bundle of small groups, as arrays; rows that ask come first in their group, and a pair needs one of them."""

    def __init__(self, table: pa.Table, similarity: float):
        raw = {c: np.asarray(table.column(c).to_numpy(zero_copy_only=False)) for c in (*GROUP_KEYS, "id", "asks", "n", "fp", "root")}
        order = np.lexsort((raw["id"], ~raw["asks"], *(raw[c] for c in reversed(GROUP_KEYS))))
        table, raw = table.take(pa.array(order)), {c: v[order] for c, v in raw.items()}
        self.table, self.similarity = table, similarity
        self.ids, self.sizes, self.asks, mask = raw["id"], raw["n"], raw["asks"], raw["mask"]
        self.fps = raw["fp"].view(np.uint64)
        self.values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        self.parts = table.column("parts").combine_chunks().flatten().to_numpy().reshape(-1, PARTS)
        #: Parts before the group's last one in which a pair must differ, or it is looked at elsewhere.
        self.earlier = [(p, open_) for p in range(PARTS) if (open_ := (mask >> p > 1) & (mask >> p & 1 == 0)).any()]
        self.few = self.sizes < FEW
        new = np.zeros(len(order), dtype=bool)
        for c in GROUP_KEYS:
            new[1:] |= np.diff(raw[c]) != 0
        self.group = np.cumsum(new)
        _, first, at = np.unique(raw["root"], return_index=True, return_inverse=True)
        self.before = self.label = first[at]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a, b) of one group are looked at there and may reach the similarity by size and SimHash distance."""
        ok = (np.bitwise_count(self.fps[a] ^ self.fps[b]) <= SCREEN_BITS) | self.few[a] | self.few[b]
        ok &= np.minimum(self.sizes[a], self.sizes[b]) >= self.similarity * np.maximum(self.sizes[a], self.sizes[b])
        for p, open_ in self.earlier:
            part = self.parts[:, p]
            ok &= ~(open_[a] & (part[a] == part[b]) & (part[a] != 0))
        return ok & (a < b)

    def doubt(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are clearly over the similarity by estimate, and which undecided."""
        rate, small = estimates(self.values, a, b), self.few[a] | self.few[b]
        clear = (rate >= self.similarity + MARGIN) & ~small
        return clear, ~clear & (rate >= self.similarity - np.where(small, FEW_MARGIN, MARGIN))

    def small_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs of small groups."""
        found, step = [np.empty((2, 0), dtype=np.int64)], 1
        while True:
            a = np.flatnonzero(self.group[:-step] == self.group[step:]) if step < len(self.ids) else np.empty(0, dtype=np.int64)
            if not len(a):
                return tuple(np.concatenate(found, axis=1))
            a = a[self.asks[a] & (self.label[a] != self.label[a + step])]
            found.append(np.stack([a, a + step])[:, self.near(a, a + step)])
            step += 1

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.label = spanning_labels(len(self.ids), np.concatenate([np.arange(len(self.ids)), a]), np.concatenate([self.label, b]))

    def new_links(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.label != self.before)
        return self.ids[own], self.ids[self.label[own]]


def compare(rows: Rows, bundle: bool) -> np.ndarray:
    """Joins the pairs that are clear by estimate; returns the rows that an undecided pair holds."""
    doubtful = np.zeros(len(rows.ids), dtype=bool)
    if bundle:
        a, b = rows.small_pairs()
        clear, doubt = rows.doubt(a, b)
        rows.join(a[clear], b[clear])
        doubtful[a[doubt]] = doubtful[b[doubt]] = True
        return np.flatnonzero(doubtful)
    asking = int(rows.asks.sum())
    for i in range(0, asking, BLOCK):
        a = np.arange(i, min(i + BLOCK, asking))
        for j in range(i, len(rows.ids), BLOCK):
            b = np.arange(j, min(j + BLOCK, len(rows.ids)))
            if (rows.label[a] == rows.label[a[0]]).all() and (rows.label[b] == rows.label[a[0]]).all():
                continue
            near, take = rows.near(a[:, None], b[None, :]), 1
            while True:
                x, y = np.nonzero(near & (rows.label[a][:, None] != rows.label[b][None, :]))
                if not len(x):
                    break
                # few partners a row at first: most pairs of a clump are joined before their turn; then ever more
                begin = np.flatnonzero(np.diff(x, prepend=-1))
                turn = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))) < take
                x, y, take = x[turn], y[turn], take * 4
                near[x, y] = False
                p, q = a[x], b[y]
                clear, doubt = rows.doubt(p, q)
                if clear.any():
                    rows.join(p[clear], q[clear])
                doubtful[p[doubt]] = doubtful[q[doubt]] = True
    return np.flatnonzero(doubtful)


def decide(rows: Rows, hashes: list[np.ndarray], bundle: bool) -> None:
    """Joins all pairs at the similarity or above by their exact shingle sets, leaving out pairs joined already."""
    lengths = np.array([len(h) for h in hashes])

    def exact(i: int, others: np.ndarray) -> None:
        theirs = np.concatenate([hashes[k] for k in others])
        spot = np.minimum(np.searchsorted(hashes[i], theirs), lengths[i] - 1)
        ends = np.cumsum(lengths[others])
        met = np.concatenate([[0], np.cumsum(hashes[i][spot] == theirs)])
        same = met[ends] - met[ends - lengths[others]]
        ok = same / (lengths[i] + lengths[others] - same) >= rows.similarity
        if ok.any():
            rows.join(np.full(int(ok.sum()), i), others[ok])

    if bundle:
        a, b = rows.small_pairs()
        undecided = rows.doubt(a, b)[1]
        order = np.argsort(a[undecided], kind="stable")
        a, b = a[undecided][order], b[undecided][order]
        begin = np.flatnonzero(np.diff(a, prepend=-1))
        linked: list[np.ndarray] = []
        for i, others in zip(a[begin], np.split(b, begin[1:])):
            same = np.array([np.isin(hashes[k], hashes[i], assume_unique=True).sum() for k in others])
            ok = same / (lengths[i] + lengths[others] - same) >= rows.similarity
            linked.append(np.stack([np.full(int(ok.sum()), i), others[ok]]))
        if linked:
            rows.join(*np.concatenate(linked, axis=1))
        return
    for i in range(int(rows.asks.sum())):
        apart = np.flatnonzero(rows.label != rows.label[i])
        apart = apart[apart > i]
        if len(apart):
            apart = apart[rows.near(np.int64(i), apart)]
            apart = apart[rows.doubt(np.full(len(apart), i), apart)[1]]
        for at in range(0, len(apart), BLOCK):
            others = apart[at : at + BLOCK]
            others = others[rows.label[others] != rows.label[i]]
            if len(others):
                exact(i, others)


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with root: the component's node as far as it is known."""
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots, F.col("id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "id"))


def _bundled(members: DataFrame) -> DataFrame:
    """members with what they are grouped by: small groups meet in bundles, so that none costs a call of its own."""
    small = F.col("size") <= SMALL_ROWS
    bundle = F.pmod(F.xxhash64("mask", "key"), F.col("bundles"))
    return members.withColumns({"b0": F.when(small, F.lit(-1)).otherwise(F.col("mask")), "b1": F.when(small, bundle).otherwise(F.col("key"))})


def search_groups(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, roots: DataFrame | None = None, k: int = 5) -> DataFrame:
    """members(mask, key, salt, block, id, asks, size, bundles), nodes of CARRIED, sets(id, text or hashes) -> links (a, b) that span the pairs of each group at the similarity or above."""
    carried, kept = [*GROUP_KEYS, "asks", "size", "bundles"], ["b0", "b1", "salt", "block"]
    kinds = "mask int, key bigint, salt int, block int, asks boolean, size bigint, bundles bigint"

    def is_bundle(table: pa.Table) -> bool:
        return table.column("b0")[0].as_py() < 0

    def screen(table: pa.Table) -> pa.Table:
        rows = Rows(table, similarity)
        doubtful = compare(rows, is_bundle(table))
        a, b = rows.new_links()
        none = np.arange(len(a) + len(doubtful)) >= len(b)
        at = rows.table.take(pa.array(np.concatenate([np.zeros(len(a), np.int64), doubtful])))
        found = {"a": pa.array(np.concatenate([a, rows.ids[doubtful]]), pa.int64()), "b": pa.array(np.concatenate([b, np.zeros(len(doubtful), np.int64)]), pa.int64(), mask=none)}
        return pa.table({**{c: at.column(c) for c in carried}, **found})

    def confirm(table: pa.Table) -> pa.Table:
        rows = Rows(table, similarity)
        decide(rows, [np.frombuffer(h, dtype=np.uint64) for h in rows.table.column("hashes").to_pylist()], is_bundle(table))
        a, b = rows.new_links()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = _rooted(_bundled(members).join(nodes.select(*CARRIED), "id"), roots)
    found = checkpoint(full.groupBy(*kept).applyInArrow(screen, f"{kinds}, a bigint, b bigint"))
    clear = found.where("b is not null").select("a", "b")
    known = components(clear if roots is None else clear.union(roots.toDF("a", "b")))
    doubtful = checkpoint(_rooted(found.where("b is null").select(*carried, F.col("a").alias("id")), known))
    split = doubtful.groupBy(*GROUP_KEYS).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select(*GROUP_KEYS)
    doubtful = checkpoint(doubtful.join(split, GROUP_KEYS, "left_semi"))
    open_ = hashed(sets.join(broadcast_keys(checkpoint(doubtful.select("id").distinct())), "id", "left_semi"), k)
    exact = _bundled(doubtful).join(nodes.select(*CARRIED), "id").join(open_, "id").groupBy(*kept).applyInArrow(confirm, "a bigint, b bigint")
    return known.toDF("a", "b").union(exact)


def meetings(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members of the groups of two or more that are searched whole, and (mask, key, id, n) of clumps that stay large, None without any.

    Level by level: groups over the bounds are taken apart by one more later part.
    """
    rows = nodes.select(F.lit(0).alias("mask"), F.lit(0).cast("long").alias("key"), "id", "n", "parts")
    whole, none = None, F.lit(0)
    for _ in range(LEVELS):
        level = checkpoint(refine(rows))
        sizes = level.groupBy("mask", "key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
        large = F.expr(f"size > {GROUP_ROWS} or (size > 2 and shingles > {GROUP_SHINGLES})")
        sizes = checkpoint(sizes.select("mask", "key", "size", large.alias("large")))
        held = sizes.agg(F.sum(F.when(F.col("size") <= SMALL_ROWS, F.col("size"))).alias("small"), F.max("large").alias("large")).first()
        met = level.join(sizes, ["mask", "key"])
        bundles = F.lit(1 + (held["small"] or 0) // BUNDLE_ROWS).cast("long").alias("bundles")
        small = met.where("not large").select("mask", "key", none.alias("salt"), none.alias("block"), "id", F.lit(True).alias("asks"), "size", bundles)
        whole = small if whole is None else whole.union(small)
        if not held["large"]:
            return whole, None
        rows = met.where("large").select("mask", "key", "id", "n").join(nodes.select("id", "parts"), "id").select("mask", "key", "id", "n", "parts")
    return whole, checkpoint(met.where("large").select("mask", "key", "id", "n"))


def refine(rows: DataFrame) -> DataFrame:
    """(mask, key, id, n) of the groups that agree in one more part, behind the last of the mask."""
    later = lambda p, i: F.struct(i.alias("i"), p.alias("p"))
    parts = F.explode(F.filter(F.transform("parts", later), lambda s: (s["p"] != 0) & (F.pow(F.lit(2), s["i"]) > F.col("mask")))).alias("part")
    opened = rows.select("mask", "key", "id", "n", parts)
    key = F.when(F.col("mask") == 0, F.col("part.p")).otherwise(F.xxhash64("key", "part.p"))
    mask = F.col("mask") + F.pow(F.lit(2), F.col("part.i")).cast("int")
    return opened.select(mask.alias("mask"), key.alias("key"), "id", "n")


def _salt(groups: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(groups)).cast("int")


def _group_count(rows: Column, shingles_: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / GROUP_ROWS), F.ceil(shingles_ / GROUP_SHINGLES)).cast("int")


def clump_links(clumps: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, roots: DataFrame, k: int = 5) -> DataFrame:
    """clumps(mask, key, id, n) -> links within clumps of any size: salted groups with pivots first, then what they left, in blocks, against all."""
    keys, none = ["mask", "key"], F.lit(0)
    alone = [F.lit(SMALL_ROWS + 1).cast("long").alias("size"), F.lit(1).cast("long").alias("bundles")]
    pivot = [F.min_by("id", F.xxhash64("id", F.lit(p))).alias(f"p{p}") for p in range(PIVOTS)]
    sizes = checkpoint(clumps.groupBy(*keys).agg(_group_count(F.count("*"), F.sum("n")).alias("groups"), *pivot))
    own = checkpoint(clumps.join(sizes.select(*keys, "groups"), keys).select(*keys, _salt("groups", -1).alias("salt"), "id", "n"))
    each = F.explode(F.sequence(none, F.col("groups") - 1)).alias("salt")
    pivots = sizes.select(*keys, each, F.array(*[f"p{p}" for p in range(PIVOTS)]).alias("ps")).select(*keys, "salt", F.explode("ps").alias("id"))
    members = own.select(*keys, "salt", "id").union(pivots).distinct().select(*keys, "salt", none.alias("block"), "id", F.lit(True).alias("asks"), *alone)
    first = components(search_groups(members, nodes, sets, similarity, roots, k).union(roots.toDF("a", "b")))

    held = checkpoint(_rooted(own, first))
    largest = held.groupBy(*keys, "root").agg(F.count("*").alias("rows")).groupBy(*keys).agg(F.max_by("root", F.struct("rows", -F.col("root"))).alias("largest"))
    rest = checkpoint(held.join(largest, keys).where("root <> largest").select(*keys, "id", "n"))
    if rest.isEmpty():
        return first.toDF("a", "b")
    blocks = checkpoint(rest.groupBy(*keys).agg(_group_count(F.count("*"), F.sum("n")).alias("blocks")))
    counted = blocks.join(sizes.select(*keys, "groups"), keys)
    asking = rest.join(counted, keys).select(*keys, each, _salt("blocks", -2).alias("block"), "id", F.lit(True).alias("asks"), *alone)
    asked = held.join(blocks, keys).select(*keys, "salt", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("block"), "id", F.lit(False).alias("asks"), *alone)
    return first.toDF("a", "b").union(search_groups(asking.union(asked), nodes, sets, similarity, first, k))


def rest_links(keyed: DataFrame, table: DataFrame, nodes: DataFrame, k: int, similarity: float, roots: DataFrame) -> DataFrame:
    """Links (a, b) that join every pair of nodes at the similarity that roots leave apart. keyed(key, text) and table(id, n, bits) hold the nodes and their copies."""
    percent = round(100 * similarity)
    if abs(100 * similarity - percent) > 1e-9:
        raise ValueError("the similarity is a whole number of percents")
    copies = table.select("id").join(nodes.select("id"), "id", "left_anti").union(nodes.where("n = 0").select("id"))
    idle = broadcast_keys(checkpoint(copies.withColumnRenamed("id", "key")))
    rows = table.select(F.col("id").alias("key"), F.col("id").alias("node"), "n", "bits").join(idle, "key", "left_anti")
    return set_links(keyed.join(idle, "key", "left_anti"), rows, k, percent, roots)


def _keyed(docs: DataFrame) -> DataFrame:
    """As keyed_rows; where ids are no integers, all rows are written out and numbered."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return keyed_rows(docs)
    return checkpoint(docs.select((-1 - F.monotonically_increasing_id()).alias("key"), "doc_id", "text"))


def text_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, digest, root, copies: every different (doc_id, text) with its group and its number of rows."""
    keyed = _keyed(docs)
    table = checkpoint(sketches(keyed, k))
    nodes = checkpoint(table.groupBy("digest").agg(F.min("id").alias("id")).join(table.select(*CARRIED), "id"))
    sets = keyed.select(F.col("key").alias("id"), "text")
    by_print = checkpoint(nodes.groupBy("fp").agg(F.min("id").alias("id")))
    same = nodes.select("fp", F.col("id").alias("a")).join(by_print.toDF("fp", "b"), "fp").where("a <> b").select("a", "b")
    whole, clumps = meetings(nodes)
    roots = components(links(by_print, max_bits).union(same).union(search_groups(whole, nodes, sets, similarity, k=k)))
    if clumps is not None:
        roots = components(clump_links(clumps, nodes, sets, similarity, roots, k))
    roots = components(rest_links(keyed, table, nodes, k, similarity, roots).union(roots.toDF("a", "b")))
    rooted = nodes.join(roots, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("root"))
    return checkpoint(table.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")).join(rooted, "digest"))


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, digest, component_id: every different (doc_id, text), and the smallest doc_id whose text is reachable from it (null if none has one)."""
    own = text_groups(docs, k, similarity, max_bits)
    return own.join(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "digest", "component_id")


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: the smallest doc_id, of its texts the one with the smallest digest, of its rows with that text any one."""
    own = text_groups(docs, k, similarity, max_bits)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = own.groupBy("root").agg(F.min(rank).alias("best"))
    judged = checkpoint(own.join(best, "root").select("doc_id", "digest", "copies", (rank == F.col("best")).alias("wins")))
    # an id with one row stays or goes by its id; rows that share an id, or have none, are told apart by their text
    ids = judged.where("doc_id is not null").groupBy("doc_id").agg(F.sum("copies").alias("rows"), F.max("wins").alias("wins"))
    told = checkpoint(ids.where("rows > 1 or not wins").select("doc_id", F.expr("rows > 1").alias("shared")))
    single = docs.where("doc_id is not null").join(broadcast_keys(told.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    shared, unnamed = told.where("shared").select("doc_id"), docs.where("doc_id is null")
    if shared.isEmpty() and judged.where("doc_id is null").isEmpty():
        return single
    mixed = docs.join(broadcast_keys(shared), "doc_id", "left_semi").select(*docs.columns).union(unnamed)
    at, (spare, winner) = docs.columns.index("text"), free_names(docs.columns, "_digest", "_winner")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = pa.array([word_digest(t.as_py()) for t in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digest], names=[*docs_columns, spare])

    docs_columns = docs.columns
    winners = judged.where("wins").select(F.col("doc_id").alias(winner), F.col("digest").alias(spare))
    marked = mixed.mapInArrow(run, f"{fields}, `{spare}` binary").join(winners, spare)
    one = marked.where(F.col("doc_id").eqNullSafe(F.col(winner))).dropDuplicates([spare])
    return single.union(one.select(*docs.columns))
