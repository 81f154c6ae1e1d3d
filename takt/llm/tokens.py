"""Whole texts to token ids of a public tokenizer; words that repeat are encoded once."""
from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"  # Latin letters that normal forms leave alone
KEPT_UNITS = 600_000
CHUNK_CHARS = 4_000_000


class TextEncoder:
    """Token ids of many texts at a time.

    A text is cut into units where its tokenizer can't join tokens: before a single space between two other
    characters for byte-level vocabularies (the space belongs to the next word), at white space for vocabularies
    that drop it and mark word ends. Each different unit of a chunk is looked up once; ids of units are
    remembered, and forgotten all at once when too many are held. New units of the shape letters + marks are
    encoded as one text and cut where a unit begins or ends; all others, whatever they hold, one by one. A text that
    holds the string of a special token is encoded whole: that string is one token, whatever surrounds it.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        ends, begins = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            ends[i], begins[i] = token.endswith("</w>"), token.startswith("Ġ")
        self.spaced = not ends.any()
        self.edge = begins if self.spaced else ends
        self.shape = re.compile(("( " if self.spaced else "(") + LETTERS + r"+)([.,;:!?()\[\]|*%$#&\"-]*)")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str | None], chunk_chars: int = CHUNK_CHARS) -> Iterator[np.ndarray]:
        """The ids of each text, in order; of none for an empty or NULL text. About ``chunk_chars`` characters are in work at a time."""
        chunk, chars = [], 0
        for text in texts:
            chunk.append(text or "")
            chars += len(chunk[-1])
            if chars >= chunk_chars:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
        yield from self._chunk(chunk)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All units of some texts, where each text begins among them, and which begin a text without a space."""
        if not self.spaced:  # Arrow's ASCII white space is the six characters; the vocabulary is lower-case
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
            return lists.values, lists.offsets.to_numpy(), np.zeros(0, np.int64)
        odd = [i for i, t in enumerate(texts) if SPACES.search(t)]
        if odd:
            every = pc.split_pattern(pa.array(texts, pa.string()), " ").to_pylist()
            for i in odd:
                every[i] = re.split(r"(?<=\S) (?=\S)", texts[i])
            lists = pa.array(every, pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        starts = lists.offsets.to_numpy()
        return lists.values, starts, starts[:-1]

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.special.search(t)]
        if not whole:
            yield from self._plain(texts)
            return
        encoded = dict(zip(whole, (np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False))))
        for i, ids in enumerate(self._plain(["" if i in encoded else t for i, t in enumerate(texts)])):
            yield encoded.get(i, ids)

    def _plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        units, bounds, first = self._cut(texts)
        coded = units.dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.spaced:
            heads = coded.take(pa.array(first)).unique().to_pylist()
            place = {h: len(distinct) + i for i, h in enumerate(heads)}
            codes = codes.copy()
            codes[first] = np.array([place[distinct[c]] for c in codes[first]], codes.dtype)
            distinct = [" " + d for d in distinct] + heads
        found = self._ids(distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        pool, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        before = np.concatenate(([0], np.cumsum(each)))
        ids = pool[np.repeat(starts[codes] - before[:-1], each) + np.arange(before[-1])]
        edges = before[bounds]
        for a, b in zip(edges, edges[1:]):
            yield ids[a:b]

    def _ids(self, units: list[str]) -> list[bytes]:
        known = self.known
        found = [known.get(u) for u in units]
        new = [u for u, f in zip(units, found) if f is None]
        if new:
            learned = self._learn(new)
            found = [learned[u] if f is None else f for u, f in zip(units, found)]
            if len(known) + len(learned) > KEPT_UNITS:
                known.clear()
            known.update(learned)
        return found

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units; the letters part of a unit with marks is remembered as a unit of its own."""
        whole, parts, odd = [], [], []
        for u in units:
            m = self.shape.fullmatch(u)
            if not m:
                odd.append(u)
            elif m[2]:
                parts.append((u, m[1], m[2]))
            else:
                whole.append(u)
        got = dict.fromkeys(whole)
        known = self.known
        stems = [w for w in dict.fromkeys(w for _, w, _ in parts) if w not in known and w not in got]
        got.update(self._words(whole + stems))
        got.update(self._each(odd))
        marks = dict(self._each(list(dict.fromkeys(m for _, _, m in parts))))
        for u, word, mark in parts:
            got[u] = (got.get(word) or known[word]) + marks[mark]
        return got

    def _each(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        encoded = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return ((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(units, encoded))

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words of letters, encoded as one text and cut where a word ends, or where its space begins it."""
        if not words:
            return iter(())
        text = "".join(words) if self.spaced else " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.edge[ids])
        cuts = [*(4 * edges).tolist(), 4 * len(ids)] if self.spaced else [0, *(4 * edges + 4).tolist()]
        data = ids.tobytes()
        return ((w, data[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))


SPACES = re.compile(r"\s | \s|^ | $")
_ENCODERS: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file; a reused Python worker keeps it for its next task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = TextEncoder(name)
    return _ENCODERS[name]
