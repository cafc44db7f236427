"""Byte-pair encoding with the vocabulary of a public tokenizer, by an index of pair occurrences.

The distinct words of a slice of a partition are laid end to end. Every mergeable pair is entered under its rank
with all its positions; ranks are applied in ascending order, each to all its positions at once, and the pairs
that a merge makes are entered in turn. Texts are then put together from their words.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from orderweave.llm.words import pieces

#: Memory that a Python worker spends on words whose ids it keeps between slices: those of the last slices, in two
#: generations, of which the older one goes when the younger one is full.
KEPT_BYTES = 48 << 20
#: What a kept word takes besides its characters and ids.
_WORD_BYTES = 240
SLICE_BYTES = 4 << 20

#: Characters on which Python and the tokenizer's own rules agree without further normalisation.
_ODD = re.compile("[^\x09-\x0d\x20-\x7e\xa1-\xac\xae-įı-ɏ]")
# fixed values: the split rule and the special tokens of this kind of vocabulary
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_MARKS = frozenset(".,;:!?")
_SPECIALS = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
_SPECIAL = re.compile("|".join(map(re.escape, _SPECIALS)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    stand_ins = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(stand_ins)) for b in range(256)]


class Encoder:
    """Encodes as the library does with this vocabulary, without special tokens added."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        characters = _byte_characters()
        self.byte_of = {c: b for b, c in enumerate(characters)}
        self.inner = np.array([vocabulary[c] for c in characters], np.int64)
        self.last = np.array([vocabulary[c + "</w>"] for c in characters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.pair, self.made = keys, made
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = keys[order], order
        self.tokens = {i: t.encode() for t, i in {**vocabulary, **_SPECIALS}.items()}
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.kept_bytes, self.size = kept_bytes, 0
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.sorted_keys, key), len(self.sorted_keys) - 1)
        return np.where((self.sorted_keys[at] == key) & (right >= 0), self.sorted_ranks[at], -1)

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """The ids, as packed unsigned 32-bit numbers, of each part; parts are not empty."""
        ends = np.cumsum([len(p) for p in parts])
        n = int(ends[-1])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        symbol = np.full(n + 1, -1, np.int64)  # the last place is before the first and after the last symbol
        symbol[:n] = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after = np.arange(1, n + 2)
        after[ends - 1] = n
        before = np.arange(-1, n)
        before = np.append(before, n)
        before[ends - np.diff(ends, prepend=0)] = n
        after[n] = n

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = self._ranks(symbol[places], symbol[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            heads = ranks[np.concatenate(([0], cuts))].tolist()
            for rank, at in zip(heads, np.split(places, cuts) if len(cuts) else [places]):
                if rank in index:
                    index[rank].append(at)
                else:
                    index[rank] = [at]
                    heapq.heappush(active, rank)

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists))
            left, right = self.pair[rank] >> 16, self.pair[rank] & 0xFFFF
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:  # of a run of one symbol, every second place from its start
                opens = np.concatenate(([True], after[at[:-1]] != at[1:]))
                run = np.flatnonzero(opens)[np.cumsum(opens) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[rank]
            symbol[gone] = -1
            following = after[gone]
            after[at] = following
            before[following] = at
            before[n] = n
            front = before[at]
            enter(np.concatenate((front[front < n], at)))
        left = np.flatnonzero(symbol[:n] >= 0)
        packed = symbol[left].astype("<u4").tobytes()
        cuts = (np.searchsorted(left, ends) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def _fill(self, missing: set[str]) -> None:
        """Enter words: those of letters only as they are, others by their parts."""
        whole = [w for w in missing if w.isalpha()]
        # letters and one mark after them, the most frequent kind, need no pattern
        mixed = {w: [w[:-1], w[-1]] if w[-1] in _MARKS and w[:-1].isalpha() else _SPLIT.findall(w) for w in missing if not w.isalpha()}
        rest = list(set().union(*mixed.values()).difference(whole, self.words, self.parts)) if mixed else []
        if whole or rest:
            ids = self.merge([p.encode("utf-8", "surrogatepass") for p in whole + rest])
            self.words.update(zip(whole, ids))
            self.parts.update(zip(rest, ids[len(whole) :]))
        for word, parts in mixed.items():
            self.words[word] = b"".join([self.parts[p] if p in self.parts else self.words[p] for p in parts])

    def _odd(self, text: str) -> bytes:
        """A text with characters outside the common ones, split by the library's own rules."""
        out, at = [], 0
        for found in [*_SPECIAL.finditer(text), None]:
            segment = text[at : found.start() if found else len(text)]
            parts = [p for p, _ in self.split(self.normalize(segment))] if segment else []
            raw = [bytes(map(self.byte_of.__getitem__, p)) for p in parts]
            if raw:
                out += self.merge(raw)
            if found:
                out.append(np.array([_SPECIALS[found[0]]], "<u4").tobytes())
                at = found.end()
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed unsigned 32-bit numbers; null is empty."""
        if 2 * self.size > self.kept_bytes:
            self.words, self.older, self.parts, self.size = {}, self.words, {}, 0
        done, split = {}, {}
        for i, text in enumerate(texts):
            if text:
                if _ODD.search(text) or "<|" in text:
                    done[i] = self._odd(text)
                else:
                    split[i] = text.lower().split()
        new = set().union(*split.values()).difference(self.words) if split else ()
        if new:
            known = new.intersection(self.older)
            self.words.update((w, self.older[w]) for w in known)
            missing = new - known
            if missing:
                self._fill(missing)
            # a character gives a byte or more, and one id at most
            self.size += _WORD_BYTES * len(new) + 5 * sum(map(len, new))
        word = self.words.__getitem__
        for i, found in split.items():
            done[i] = b"".join(map(word, found))
        return [done.get(i, b"") for i in range(len(texts))]

    def forget(self) -> None:
        """Give back the memory of kept words."""
        self.words, self.older, self.parts, self.size = {}, {}, {}, 0

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as the library gives it for a vocabulary without a decoder: tokens joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, kept_bytes: int = KEPT_BYTES) -> Encoder:
    """This worker's encoder for the vocabulary at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].kept_bytes = kept_bytes
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``doc_id`` and the ``ids`` (array of int) of each row's whole text; a null or blank text has none.

    ``path`` is a vocabulary file that every executor can read."""
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part in pieces(batch, text, SLICE_BYTES):
                packed = coder.encode(part.column(text).to_pylist())
                sizes = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), ids)], ["doc_id", "ids"]
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", f"`{text}`").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids) with the text ``decoded`` from the ids; null ids give a null text."""
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            lists = batch.column("ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            valid = pc.is_valid(lists).to_pylist()
            texts = [coder.decode(values[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], valid)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"]
            )

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
