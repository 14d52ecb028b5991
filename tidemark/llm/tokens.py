"""Token ids of whole texts by a public tokenizer, with each word piece encoded once.

The tokenizer lower-cases a text, drops white space and cuts the rest into
pieces (letters, single digits, other signs, English contractions) before it
looks for pairs to merge, and the last id of a piece is one with the mark of a
word's end. So a text's ids are those of its pieces one after the other, and
pieces repeat; so do words, which are cut into pieces once a batch. New pieces
go to the tokenizer's model many at a time. Texts with characters outside of
the plain Latin range, where cutting is left to the tokenizer itself, are
encoded whole; so are all texts where the file describes another way of
normalising or cutting than the one above.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LATIN = [chr(i) for i in [*range(0xA1, 0x180), *range(0x2010, 0x2028)] if i not in (0xAD, 0x130)]
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7f" + re.escape("".join(_LATIN)) + "]*")
_LETTERS = "a-zA-Z" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "0-9" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
#: Fixed pattern of the tokenizer, with its letters and numbers spelled out for the plain range.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \\t-\\r{_LETTERS}{_NUMBERS}]+")
#: Stands between words, which hold no white space.
_BREAK = "\n"
_PIECES_AND_BREAKS = re.compile(f"{_PIECES.pattern}|{_BREAK}")
#: Characters of pieces that are encoded in one call, or a single longer piece.
MERGED_CHARS = 200_000


def _byte_signs() -> np.ndarray:
    """The usual signs of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on. The space stays one, between pieces."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = np.arange(256, dtype="<u2")
    others = np.setdiff1d(signs, printable)
    signs[others] = 256 + np.arange(len(others))
    signs[0x20] = 0x20
    return signs


_SIGNS = _byte_signs()


def _gather(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of numbered runs one after the other, and where each run's begin (and the last one's end)."""
    first = starts[at]
    sizes = starts[at + 1] - first
    stops = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(first - stops[:-1], sizes)
    place += np.arange(stops[-1])
    return ids[place], stops


_LOADED: dict[str, PieceTokenizer] = {}


def tokenizer_at(path: str) -> PieceTokenizer:
    """The worker process's own tokenizer for a file: kept from task to task, with what it has learned."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


#: Fixed pattern by which the tokenizer cuts; files with another one are encoded whole.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_as_here(path: str) -> bool:
    """True if the file lower-cases, drops white space and cuts words as this module does."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    normal = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
    cutters = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = told["model"]
    return (
        normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cutters] == ["Split", "ByteLevel"] and cutters[0].get("pattern") == {"Regex": _CUT}
        and bool(cutters[0].get("invert")) and not cutters[1].get("add_prefix_space") and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix"))
    )


class PieceTokenizer:
    """``encode_batch`` gives the ids of texts as the tokenizer file at ``path`` does, without special tokens.

    Beyond ``max_pieces`` pieces or ``max_chars`` characters of them the cache
    starts anew, which bounds memory.
    """

    def __init__(self, path: str, max_pieces: int = 1_200_000, max_chars: int = 32_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_pieces, self.max_chars = Tokenizer.from_file(path), max_pieces, max_chars
        self.plain = _PLAIN if cuts_as_here(path) else re.compile("")
        self.model = self.tokenizer.model
        self.merger = Tokenizer(self.model)  # takes pieces that are normalised and cut, many at a time with spaces between them
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, mark = self.tokenizer.get_vocab(with_added_tokens=True), getattr(self.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[n for token, n in vocabulary.items() if mark and token.endswith(mark)]] = True
        self.narrow = len(self.ends) <= 1 << 16
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known, self.chars = {_BREAK: 0}, 0  # the break is piece 0, which has no ids
        self.ids, self.starts, self.n_ids = np.zeros(1 << 18, np.uint32), np.zeros(1 << 17, np.int64), 0

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces one after the other, and where each piece's end."""
        part = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) // MERGED_CHARS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pieces)]
        found, sizes = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            signs = _SIGNS[np.frombuffer(" ".join(pieces[a:b]).encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.merger.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == b - a:
                found.append(ids)
                sizes.append(np.diff(stops, prepend=0))
            else:  # a vocabulary without some of the signs drops them, maybe a piece's last one
                each = [[x.id for x in self.model.tokenize(x)] for x in signs.split(" ")]
                found.append(np.array([n for x in each for n in x], np.uint32))
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(found), np.cumsum(np.concatenate(sizes))

    def _learn(self, pieces: list[str]) -> None:
        ids, stops = self._merge(pieces)
        n = len(self.known)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[n + 1 : n + len(pieces) + 1] = self.n_ids + stops
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.n_ids += len(ids)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces; new ones are learned."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(pieces[i] for i in missing.tolist()))
            chars = sum(map(len, new))
            if len(self.known) > 1 and (len(self.known) + len(new) > self.max_pieces or self.chars + chars > self.max_chars):
                self._clear()
                return self._numbers(pieces)
            self.chars += chars
            self._learn(new)
            at[missing] = np.fromiter(map(self.known.get, (pieces[i] for i in missing.tolist())), np.int64, len(missing))
        return at

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's begin (and the last one's end)."""
        at = self._numbers(_PIECES_AND_BREAKS.findall(_BREAK.join([*words, ""])))
        ids, stops = _gather(self.ids, self.starts, at)
        return ids, np.concatenate([[0], stops[1:][at == 0]])

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is as empty. Words are told apart for the whole batch at once."""
        values = texts.to_numpy(zero_copy_only=False).tolist()
        odd = {i for i, x in enumerate(values) if x and (not self.plain.fullmatch(x) or any(y in x for y in self.special))}
        if odd:
            texts = pa.array([None if i in odd else x for i, x in enumerate(values)], pa.string())
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
        coded = split.values.dictionary_encode()
        flat, stops = _gather(*self._encode_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy())
        edges = stops[split.offsets.to_numpy()]
        out = [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(values[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out
