"""Packing does its counting once for many documents, and gives what it gives one by one."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import packing, queries, tokens

TEXTS = [None, "", "   ", "\n\n", "a", "It's we'll DON'T 12345 №", "<|endoftext|> x", "</w> a</w>", "\x00\x01 a\x7fb", "日本語 text", "naïve CAFÉ œuvre ßtraße", "x" * 500, "a!b?c…—“q”", "İstanbul", "a\x1cb", "¹²³ ½ ª º"]
SIGNS = [f"a{c}b {c}{c} x{c}" for c in map(chr, [*range(1, 0x180), *range(0x2010, 0x2028)])]


@pytest.mark.parametrize("bounds", [{}, {"max_pieces": 50, "max_chars": 300}])
def test_new_pieces_are_encoded_many_at_a_time(monkeypatch, bounds):
    """The ids are the tokenizer file's own, also where the cache starts anew, and no piece costs a call of its own."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MERGED_CHARS", 400)
    plain, own = Tokenizer.from_file(queries.tokenizer_path()), tokens.PieceTokenizer(queries.tokenizer_path(), **bounds)
    own.model = None
    texts = [*TEXTS, *SIGNS, *(f"w{i} é{i * i} ??{i}" for i in range(300))]
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for text, ids in zip(part, own.encode_batch(pa.array(part, pa.string()))):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
    assert [x.tolist() for x in own.encode_batch(pa.array([], pa.string()))] == []


def documents(seed: int, n: int = 60, kind=np.uint16) -> list[np.ndarray]:
    random = np.random.default_rng(seed)
    return [np.append(random.zipf(1.4, random.integers(1, 300)) % 500, 7).astype(kind) for _ in range(n)]


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_terms_of_many_documents(kind):
    docs = documents(1, kind=kind) + [np.array([np.iinfo(kind).max, 0, 0], kind)]
    owner, term, tf = packing.terms_of_all(docs)
    for i, ids in enumerate(docs):
        want, times = np.unique(ids, return_counts=True)
        assert term.dtype == kind and (term[owner == i] == want).all() and (tf[owner == i] == times).all()


def test_heaviest_terms_of_many_documents():
    docs = [*documents(2), np.array([499], np.uint16), np.array([3, 3, 4, 4], np.uint16)]
    idf, shared = np.random.default_rng(3).integers(1, 5, 500).astype(np.float32), np.arange(500) < 400
    idf[3] = idf[4] = 2
    for ids, got in zip(docs, packing.heaviest_shared(docs, idf, shared, 100.0)):
        term, tf = np.unique(ids, return_counts=True)
        weight = np.where(shared[term], packing.bm25(tf, idf[term], len(ids), 100.0), -1)
        assert got == (term[weight.argmax()] if weight.max() > 0 else -1)
    assert packing.heaviest_shared(docs, idf, shared, 100.0)[-2:].tolist() == [-1, 3]


def test_used_documents_leave_the_index():
    """A request doesn't go through the entries of documents that are packed, and finds what it would have found among all."""
    docs, idf = documents(4), np.random.default_rng(5).random(500).astype(np.float32)
    whole, index = packing.ShardIndex(docs, idf, 100.0), packing.ShardIndex(docs, idf, 100.0)
    for seed in range(len(docs) - 5):
        scores = np.zeros(len(docs))
        for t in whole.queries[seed]:
            np.add.at(scores, whole.owners[whole.first[t] : whole.first[t + 1]], whole.weights[whole.first[t] : whole.first[t + 1]])
        found = np.flatnonzero((scores > 0) & index.unused)
        assert index.neighbours(seed).tolist() == found[np.argsort(-scores[found], kind="stable")].tolist()
        index.unused[seed] = False
    assert len(np.unique(index.owners)) <= 6 / 0.75  # six were left at the last request
