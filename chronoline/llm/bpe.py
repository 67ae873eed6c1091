"""Operator 9: byte-level BPE through a minimal acyclic transducer lexicon.

1. A distributed count of all words picks the ``lexicon_size`` most frequent; the
   driver encodes those and compiles them into a minimal acyclic automaton whose
   states share suffixes. Each edge carries the number of words that sort before
   it, so the sum along a path is the word's rank, and the rank's slot holds its token ids.
2. The automaton is a handful of flat arrays in one file of bounded size, shipped
   once to each executor and memory-mapped by its Python workers.
3. A text is cut into chunks that no token crosses (a run of other characters with
   at most one space before it, or white space). All distinct pieces of a block of
   texts walk the automaton together, a byte at a time; pieces outside the
   lexicon are merged exactly by rank.

Encoding equals the tokenizers library's for a byte-level BPE file without
normaliser and without a prefix space: added tokens in a text become their
single id. Decoding joins the ids' bytes and reads them as UTF-8, replacing what is
malformed.

Defined cases: a null text is an empty text: no ids, an empty decoded text;
repeated rows are encoded one by one; an empty table gives an empty result; other
columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import checkpoint

LEXICON_SIZE = 50_000
MIN_COUNT = 4
COUNTER_WORDS = 200_000
MEMO_PIECES = 300_000
BLOCK_CHARS = 4_000_000

#: Unicode white space, and the published split pattern of byte-level BPE.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, ids by bytes, merge ranks by pair of ids, added tokens."""

    tokens: tuple[bytes, ...]
    merges: dict[tuple[int, int], tuple[int, int]]
    byte_ids: tuple[int, ...]
    added: dict[str, int]


def _refuse_other_kinds(spec: dict) -> None:
    """Only what this encoder does the same way is read: plain byte-level pairs without a normaliser, prefix space or marks that take white space with them."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["model"] if model.get("type", "BPE") != "BPE" else []
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += ["pre_tokenizer"] if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) else []
    odd += [f"added token {a['content']!r}" for a in spec.get("added_tokens", []) if a.get("lstrip") or a.get("rstrip") or a.get("single_word")]
    if odd:
        raise ValueError(f"not supported: {', '.join(odd)}")


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _refuse_other_kinds(spec)
    back = byte_alphabet()
    raw = lambda token: bytes(back[c] for c in token)
    ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
    added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    tokens = [b""] * (1 + max([*ids.values(), *added.values()]))
    for token, i in ids.items():
        tokens[i] = token
    for content, i in added.items():
        tokens[i] = content.encode()
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return Vocabulary(tuple(tokens), merges, tuple(ids[bytes([b])] for b in range(256)), added)


def merge_piece(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one pre-token: always the pair of least rank first, the leftmost on ties."""
    return _merge_long([vocab.byte_ids[b] for b in piece], vocab.merges)


class PairRanks:
    """Merge ranks by pair of ids for whole arrays of pairs."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: Vocabulary):
        self.base = len(vocab.tokens)
        keys = np.array([a * self.base + b for a, b in vocab.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in vocab.merges.values()], dtype=np.int32)[order]
        self.made = np.zeros(len(keys), dtype=np.int32)
        for rank, made in vocab.merges.values():
            self.made[rank] = made
        self.byte_ids = np.array(vocab.byte_ids, dtype=np.int32)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.NONE)


WIDTHS = (6, 8, 10, 12, 16, 24, 40)


def merge_pieces(pieces: list[bytes], vocab: Vocabulary, pairs: PairRanks) -> list[bytes]:
    """Ids (little-endian uint32) of many pre-tokens: pieces of like length merge in lockstep, one merge a round each."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    out: list[bytes] = [b""] * len(pieces)
    low = 0
    for width in WIDTHS:
        rows = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        if len(rows):
            _merge_matrix([pieces[i] for i in rows], lengths[rows], width, pairs, rows, out)
    for i in np.flatnonzero(lengths > WIDTHS[-1]):
        out[i] = np.array(merge_piece(pieces[i], vocab), dtype="<u4").tobytes()
    return out


def _merge_matrix(pieces: list[bytes], lengths: np.ndarray, width: int, pairs: PairRanks, rows: np.ndarray, out: list[bytes]) -> None:
    n = len(pieces)
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    ids = pairs.byte_ids[padded]
    columns = np.arange(width)
    rank = np.full((n, width), pairs.NONE, dtype=np.int32)
    rank[:, :-1] = pairs.of(ids[:, :-1], ids[:, 1:])
    rank[columns[None, :] >= (lengths - 1)[:, None]] = pairs.NONE
    while n:
        j = rank.argmin(axis=1)
        each = np.arange(n)
        best = rank[each, j]
        done = best == pairs.NONE
        if done.any():
            ended = np.flatnonzero(done)
            flat = ids[ended][columns[None, :] < lengths[ended][:, None]].astype("<u4").tobytes()
            stops = np.cumsum(lengths[ended]) * 4
            begin = 0
            for i, stop in zip(rows[ended].tolist(), stops.tolist()):
                out[i] = flat[begin:stop]
                begin = stop
            live = ~done
            ids, rank, lengths, rows, j, best = ids[live], rank[live], lengths[live], rows[live], j[live], best[live]
            n = len(rows)
            each = np.arange(n)
            if not n:
                break
        source = np.minimum(columns[None, :] + (columns[None, :] > j[:, None]), width - 1)
        ids[each, j] = pairs.made[best]
        ids = np.take_along_axis(ids, source, axis=1)
        rank = np.take_along_axis(rank, source, axis=1)
        lengths = lengths - 1
        rank[each, j] = np.where(j + 1 < lengths, pairs.of(ids[each, j], ids[each, np.minimum(j + 1, width - 1)]), pairs.NONE)
        before = np.flatnonzero(j > 0)
        rank[before, j[before] - 1] = pairs.of(ids[before, j[before] - 1], ids[before, j[before]])
        rank[each, np.maximum(lengths - 1, 0)] = pairs.NONE


def _merge_long(ids: list[int], merges: dict) -> list[int]:
    """Merges with a heap and a linked list: n log n for a pre-token of any length."""
    n = len(ids)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j] = made, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
    return [t for t, a in zip(ids, alive) if a]


def build_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of the words as flat arrays.

    Words arrive in sorted order, so a state whose words are all in can be replaced
    by an equal registered state at once. Edges of a state are stored together in byte order.
    """
    finals: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (finals[state], tuple(edges[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                edges[path[-1]][last[len(path) - 1]] = same

    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        for b in word[common:]:
            finals.append(False)
            edges.append({})
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        finals[path[-1]] = True
        last = word
    settle(0)

    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for target in edges[stack.pop()].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
                stack.append(target)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            missing = [t for t in edges[s].values() if t not in below]
            if missing:
                todo.extend(missing)
            else:
                below[s] = finals[s] + sum(below[t] for t in edges[s].values())
                todo.pop()
        return below[state]

    count(0)
    keys, targets, outputs = [], [], []
    for k, state in enumerate(order):
        passed = int(finals[state])
        for b, target in sorted(edges[state].items()):
            keys.append(k * 256 + b)
            targets.append(number[target])
            outputs.append(passed)
            passed += below[target]
    lengths = [len(words[w]) for w in ordered]
    ids = [i for w in ordered for i in words[w]]
    return {
        "keys": np.array(keys, dtype=np.int64), "targets": np.array(targets, dtype=np.int32), "outputs": np.array(outputs, dtype=np.int32),
        "final": np.array([finals[s] for s in order], dtype=np.uint8),
        "slots": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "ids": np.array(ids, dtype=np.uint32),
    }


def look_up(lexicon: dict[str, np.ndarray], pieces: list[bytes]) -> np.ndarray:
    """Rank of every piece in the lexicon, -1 outside it; all pieces step together."""
    n = len(pieces)
    if not n or not len(lexicon["keys"]):
        return np.full(n, -1, dtype=np.int64)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    state, rank = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(lengths > 0)
    dead = lengths == 0
    keys, last = lexicon["keys"], len(lexicon["keys"]) - 1
    step = 0
    while len(live):
        want = state[live] * 256 + text[starts[live] + step]
        at = np.minimum(np.searchsorted(keys, want), last)
        ok = keys[at] == want
        dead[live[~ok]] = True
        live, at = live[ok], at[ok]
        state[live] = lexicon["targets"][at]
        rank[live] += lexicon["outputs"][at]
        step += 1
        live = live[lengths[live] > step]
    return np.where(dead | (lexicon["final"][state] == 0), -1, rank)


def pack_lexicon(lexicon: dict[str, np.ndarray], path: str) -> None:
    """One file: a JSON line of names, types and sizes, then the arrays, eight-byte aligned."""
    head = json.dumps([[k, str(v.dtype), len(v)] for k, v in lexicon.items()]).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for v in lexicon.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 8))


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    at, found = 8 + size + (-size % 8), {}
    for name, kind, n in json.loads(whole[8 : 8 + size].tobytes()):
        nbytes = n * np.dtype(kind).itemsize
        found[name] = whole[at : at + nbytes].view(kind)
        at += nbytes + (-nbytes % 8)
    return found


class Encoder:
    """Encodes texts in one Python worker; memory is bounded by twice MEMO_PIECES and by BLOCK_CHARS."""

    def __init__(self, vocab: Vocabulary, lexicon: dict[str, np.ndarray]):
        self.vocab, self.lexicon = vocab, lexicon
        self.split = regex.compile(SPLIT)
        self.chunk = re.compile(CHUNK)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(vocab.added, key=len, reverse=True))) if vocab.added else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = PairRanks(vocab)
        self.token_bytes = np.array(vocab.tokens, dtype=object)

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens: from the lexicon where it has them, else merged."""
        slots, ids = self.lexicon["slots"], self.lexicon["ids"]
        rank = look_up(self.lexicon, pieces)
        found = [b""] * len(pieces)
        known = np.flatnonzero(rank >= 0)
        whole = memoryview(ids).cast("B") if len(known) else b""
        for i, begin, end in zip(known.tolist(), (slots[rank[known]] * 4).tolist(), (slots[rank[known] + 1] * 4).tolist()):
            found[i] = bytes(whole[begin:end])
        unseen = np.flatnonzero(rank < 0).tolist()
        for i, made in zip(unseen, merge_pieces([pieces[i] for i in unseen], self.vocab, self.pairs)):
            found[i] = made
        return found

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks not met lately, through the lexicon and exact merges."""
        single = [c for c in chunks if c.lstrip(" ").isalpha()]  # one run of letters, at most one space before it
        self.memo.update(zip(single, self._ids_of([c.encode() for c in single])))
        rest = chunks.difference(single)
        cut = {c: [c[:-1], c[-1]] if c[-1] in ",." and c[:-1].lstrip(" ").isalpha() else self.split.findall(c) for c in rest}
        fresh = list({p for own in cut.values() for p in own}.difference(self.memo))
        ids = dict(zip(fresh, self._ids_of([p.encode() for p in fresh])))
        memo = self.memo
        for chunk, own in cut.items():
            memo[chunk] = b"".join([ids[p] if p in ids else memo[p] for p in own])

    def _cut(self, text: str) -> list[str | int]:
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self.chunk.findall(text)
        out, at = [], 0
        for m in found:
            out += [*self.chunk.findall(text[at : m.start()]), self.vocab.added[m[0]]]
            at = m.end()
        return out + self.chunk.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        wanted = set().union(*cut).difference(self.vocab.added.values())
        if len(self.memo) > MEMO_PIECES:  # the older half goes; what is still in use moves over
            self.older, self.memo = self.memo, {}
        new = wanted.difference(self.memo)
        back = new.intersection(self.older)
        self.memo.update((c, self.older[c]) for c in back)
        self._learn(new.difference(back))
        memo = self.memo
        one = lambda c: memo[c] if c.__class__ is str else c.to_bytes(4, "little")
        return [b"".join(map(memo.__getitem__, own)) if all_text(own) else b"".join(map(one, own)) for own in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.token_bytes[np.frombuffer(ids, dtype="<u4")].tolist()).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(name: str, vocab: Vocabulary) -> Encoder:
    """The encoder of a lexicon in this Python worker, kept from task to task; one at a time."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocab, map_lexicon(SparkFiles.get(name)))
    return _ENCODERS[name]


def all_text(chunks: list) -> bool:
    return int not in set(map(type, chunks))


def frequent_words(docs: DataFrame, size: int = LEXICON_SIZE) -> list[str]:
    """The most frequent white-space words of all texts, at most ``size``: all words above one level of a count histogram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").split())
                if len(counts) > COUNTER_WORDS:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = checkpoint(counted.where(F.col("n") >= MIN_COUNT))
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("long")
    steps = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 64 levels a doubling
    total, lowest = 0, None
    for step in steps:
        total += step["count"]
        if total > size:
            break
        lowest = step["level"]
    if lowest is None:
        return []
    return sorted(r["word"] for r in counted.where(level >= lowest).select("word").collect())  # at most size rows


def compile_lexicon(words: list[str], vocab: Vocabulary) -> dict[str, np.ndarray]:
    split = regex.compile(SPLIT)
    pieces = {p.encode() for w in words for p in split.findall(" " + w)}
    return build_lexicon({p: merge_piece(p, vocab) for p in pieces})


_SHIPPED: set[tuple[str, str]] = set()


def ship_lexicon(sc, lexicon: dict[str, np.ndarray]) -> str:
    """Gives the lexicon's file to Spark's file server, once an application and content; returns its name."""
    path = os.path.join(tempfile.mkdtemp(prefix="chronoline-lexicon-"), "lexicon")
    pack_lexicon(lexicon, path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:16]}"
    if (sc.applicationId, name) not in _SHIPPED:
        os.rename(path, named := os.path.join(os.path.dirname(path), name))
        sc.addFile(named)
        _SHIPPED.add((sc.applicationId, name))
    return name


def encode_documents(docs: DataFrame, vocab_path: str, lexicon_size: int = LEXICON_SIZE, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids as array<int>."""
    docs = docs.select("doc_id", "text")
    vocab = load_vocabulary(vocab_path)
    lexicon = compile_lexicon(frequent_words(docs, lexicon_size), vocab)
    sc = docs.sparkSession.sparkContext
    name = ship_lexicon(sc, lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = sc.broadcast(vocab)  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, shared.value)
        for batch in batches:
            column = batch.column(1)
            at = 0
            while at < len(column):
                texts, chars, begin = [], 0, at
                while at < len(column) and (not texts or chars < BLOCK_CHARS):
                    texts.append(column[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                ids = encoder.encode(texts)
                arrays = [
                    batch.column(0).slice(begin, at - begin), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids]),
                ]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            texts = [b"".join(tokens[i] for i in ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
