import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from chronoline.llm import bpe as B
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n):
    r = random.Random(2)
    parts = list("aé ’'s \n\t\r\x0b\x1c\x1f\x85\xa0  　_-12²½٣ß日本🙂{}") + ["<|endoftext|>", "  ", "\n\n", "don't", "I'll", "'RE", "word", " the"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "ab" * 500 + " " + "é" * 700]


def test_encoder_equals_the_library(library):
    vocab = B.load_vocabulary(PATH)
    encoder = B.Encoder(vocab, B.compile_lexicon(["the", "word", "don't", "é", "word."], vocab))
    texts = odd_texts(1500)
    for text, ids, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_lexicon_is_a_map_and_minimal(tmp_path):
    r = random.Random(4)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode(): [k, k + 1] for k in range(400)}
    lexicon = B.build_lexicon(words)
    B.pack_lexicon(lexicon, str(tmp_path / "x"))
    lexicon = B.map_lexicon(str(tmp_path / "x"))
    asked = [*words, b"", b"zz", b"abcabcabca", *(w + b"q" for w in list(words)[:20])]
    for word, rank in zip(asked, B.look_up(lexicon, asked).tolist()):
        got = lexicon["ids"][lexicon["slots"][rank] : lexicon["slots"][rank + 1]].tolist() if rank >= 0 else None
        assert got == words.get(word)
    rights = {w[k:] for w in words for k in range(len(w) + 1)}
    tails = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in (len(p),)}
    assert rights and len(lexicon["final"]) == len(tails)  # one state a distinct right language


def test_lockstep_merges_equal_single_ones():
    vocab = B.load_vocabulary(PATH)
    r = random.Random(8)
    pieces = ["".join(r.choice("etaoin shrdlué") for _ in range(r.randint(1, 60))).encode() for _ in range(500)]
    for piece, ids in zip(pieces, B.merge_pieces(pieces, vocab, B.PairRanks(vocab))):
        assert np.frombuffer(ids, "<u4").tolist() == B.merge_piece(piece, vocab)


def test_documents_round_trip(spark, library, odd_docs, no_docs):
    encoded = B.encode_documents(odd_docs, PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id is not null").collect()}
    for r in encoded.where("doc_id is not null").collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in B.decode_documents(encoded.where("doc_id is not null"), PATH).collect()}
    assert back == texts
    assert B.encode_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}},
    {"model": {"ignore_merges": True}}, {"model": {"type": "Unigram"}}, {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]},
])
def test_other_kinds_of_vocabularies_are_refused(tmp_path, change):
    spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
    spec |= {k: ({**spec[k], **v} if k == "model" else v) for k, v in change.items()}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not supported"):
        B.load_vocabulary(str(path))
