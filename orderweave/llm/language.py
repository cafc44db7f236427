"""Language identification by hyperdimensional profiles.

Every symbol has a random vector of signs. The vector of three symbols is the product of their vectors, each permuted by
its place; a text is the sum of those of its letters with their neighbours, a language the sum of its texts. A text has
the language whose vector it meets at the smallest angle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderweave.llm.sums import vector_sums
from orderweave.llm.words import mix, pieces
from orderweave.session import configure, pin

#: Signs of a vector, packed into 64-bit words.
WORDS = 32
DIMENSION = 64 * WORDS
#: Characters handled at once, and texts and grams that are multiplied at once.
SLICE_CHARACTERS = 1 << 20
TEXTS, GRAMS = 256, 4096
#: Languages whose profiles a task holds at a time (16 MB); more take further passes over the texts' vectors.
LANGUAGES = 1024
UNKNOWN = "und"

_SPACE = 32
_LANE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def symbol_signs(symbols: np.ndarray) -> np.ndarray:
    """The packed random signs of code points."""
    return mix(mix(symbols[:, None] + np.uint64(1)) ^ _LANE)


def _gram_signs(grams: np.ndarray) -> np.ndarray:
    """The packed signs of grams of three symbols, 21 bits each: the first permuted twice, the second once, all
    multiplied. The permutation turns a vector by 64 places."""
    out = np.zeros((len(grams), WORDS), np.uint64)
    for place in range(3):
        symbols, back = np.unique(grams >> np.uint64(42 - 21 * place) & np.uint64(0x1FFFFF), return_inverse=True)
        out ^= np.roll(symbol_signs(symbols), 2 - place, axis=1)[back]
    return out


def _segments(texts: list[str | None]):
    """Lists of (row, text, first and last character that count), together of bounded length. Long texts are cut into
    slices that overlap by the neighbours of their outer characters."""
    some, size = [], 0
    for row, text in enumerate(texts):
        text = text.lower() if text else ""
        for a in range(0, len(text), SLICE_CHARACTERS):
            b = min(len(text), a + SLICE_CHARACTERS)
            lead, tail = min(a, 1), min(len(text) - b, 1)
            part = text[a - lead : b + tail]
            if some and size + len(part) > SLICE_CHARACTERS:
                yield some
                some, size = [], 0
            some.append((row, part, lead, len(part) - tail))
            size += len(part)
    if some:
        yield some


def _grams(texts: list[str | None]):
    """(row, gram) of every letter with its two neighbours, others than letters being spaces, a block of texts at a time."""
    letters = _letters()
    for some in _segments(texts):
        joined = "\n" + "\n".join(part for _, part, _, _ in some) + "\n"
        symbols = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        counts = letters[symbols]
        symbols[~counts] = _SPACE
        ends = np.cumsum([len(part) + 1 for _, part, _, _ in some])
        starts = ends - np.array([len(part) for _, part, _, _ in some])
        for start, (_, part, lead, last) in zip(starts.tolist(), some):
            if lead:
                counts[start] = False
            if last < len(part):
                counts[start + last] = False
        at = np.flatnonzero(counts)
        rows = np.array([row for row, _, _, _ in some])[np.searchsorted(ends, at, "right")]
        yield rows, symbols[at - 1] << np.uint64(42) | symbols[at] << np.uint64(21) | symbols[at + 1]


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """The sum of the gram vectors of each text, whole numbers."""
    out = np.zeros((len(texts), DIMENSION))
    for rows, grams in _grams(texts):
        kinds, place = np.unique(grams, return_inverse=True)
        cuts = np.searchsorted(rows, np.arange(rows[0] // TEXTS * TEXTS, rows[-1] + TEXTS + 1, TEXTS)) if len(rows) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            base = rows[a] // TEXTS * TEXTS
            own, at = np.unique(place[a:b], return_inverse=True)
            here = rows[a:b] - base
            n = int(here[-1]) + 1
            for g in range(0, len(own), GRAMS):
                width = min(GRAMS, len(own) - g)
                inside = (at >= g) & (at < g + width)
                counts = np.bincount(here[inside] * width + at[inside] - g, minlength=n * width).reshape(n, width)
                signs = np.unpackbits(_gram_signs(kinds[own[g : g + width]]).view(np.uint8), axis=1)
                out[base : base + n] += counts.sum(axis=1)[:, None] - 2.0 * (counts.astype(np.float32) @ signs.astype(np.float32))
    return out


def _bundles(batches):
    """The sum of the vectors of each language over a partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, "text"):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            by = {name: i for i, name in enumerate(names)}
            # texts of one language are one text for this purpose: their grams are added up before they are made vectors
            rows = np.array([by[x] for x in langs])
            for some, grams in _grams(part.column("text").to_pylist()):
                kinds, place = np.unique(grams, return_inverse=True)
                of = rows[some]
                for g in range(0, len(kinds), GRAMS):
                    width = min(GRAMS, len(kinds) - g)
                    inside = (place >= g) & (place < g + width)
                    found, back = np.unique(of[inside], return_inverse=True)
                    counts = np.bincount(back * width + place[inside] - g, minlength=len(found) * width).reshape(len(found), width)
                    signs = np.unpackbits(_gram_signs(kinds[g : g + width]).view(np.uint8), axis=1)
                    vectors = counts.sum(axis=1)[:, None] - 2.0 * (counts @ signs.astype(np.float64))
                    for i, vector in zip(found.tolist(), vectors):
                        if names[i] in total:
                            total[names[i]] += vector
                        else:
                            total[names[i]] = vector
    for name, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([vector.tobytes()], pa.binary())], ["lang", "vector"])


def profiles(docs: DataFrame) -> DataFrame:
    """(lang, vector) for every language of ``docs`` (text, lang), neither of them null. The sums are of whole numbers, so
    they do not depend on their order."""
    known = docs.where("lang is not null and text is not null").selectExpr("text", "cast(lang as string) as lang")
    return vector_sums(known.mapInArrow(_bundles, "lang string, vector binary"), "lang", "string")


_STATE = "doc_id long, held_out boolean, lettered boolean, vector binary, lang_pred string, cosine double"


def _vectors(batches):
    for batch in batches:
        for part in pieces(batch, "text", SLICE_CHARACTERS):
            vectors = text_vectors(part.column("text").to_pylist())
            norms = np.linalg.norm(vectors, axis=1)
            lettered = vectors.any(axis=1)
            vectors /= np.maximum(norms, 1e-300)[:, None]
            yield part.column("doc_id"), part.column("held_out"), lettered, vectors, [None] * len(part), np.full(len(part), -np.inf)


def _held(batches):
    for batch in batches:
        vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(len(batch), -1).astype(np.float64)
        cosine = np.array([-np.inf if c is None else c for c in batch.column("cosine").to_pylist()])
        yield batch.column("doc_id"), batch.column("held_out"), batch.column("lettered").to_numpy(False), vectors, batch.column("lang_pred").to_pylist(), cosine


def _compared(model, first: bool, last: bool):
    """Compare texts with some profiles, sorted by language; the best so far is handed on, the smaller name of a tie."""

    def run(batches):
        names, matrix = model.value
        for doc_id, held_out, lettered, vectors, best, cosine in (_vectors if first else _held)(batches):
            if len(names):
                near = vectors @ matrix.T
                at = np.argmax(near, axis=1)
                own = near[np.arange(len(near)), at]
                best = [names[i] if better else b for i, better, b in zip(at.tolist(), own > cosine, best)]
                cosine = np.maximum(own, cosine)
            if last:
                sure = lettered & np.isfinite(cosine)
                pred = [b if ok else UNKNOWN for b, ok in zip(best, sure)]
                score = np.where(sure, np.clip(cosine, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([doc_id, held_out, pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
            else:
                raw = pa.array([v.tobytes() for v in vectors.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([doc_id, held_out, pa.array(lettered), raw, pa.array(best, pa.string()), pa.array(cosine)], [c.split()[0] for c in _STATE.split(", ")])

    return run


def predicted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, held_out, text), by the profiles ``known``.

    ``score`` is the cosine with the profile chosen, not below 0; of equal ones the smaller name is taken. A null text, one
    without a letter, and any text when nothing was learned are ``und`` with 0."""
    spark = configure(docs.sparkSession)
    known = pin(known, "profiles")
    names = [r["lang"] for r in known.select("lang").sort("lang").toLocalIterator()]
    blocks = [names[i : i + LANGUAGES] for i in range(0, len(names), LANGUAGES)] or [[]]
    rows = docs
    for i, block in enumerate(blocks):
        found = known.where(known.lang.between(block[0], block[-1])).collect() if block else []  # LANGUAGES rows of 16 kB at most
        vectors = {r["lang"]: np.frombuffer(r["vector"]) for r in found}
        matrix = np.array([vectors[b] / max(np.linalg.norm(vectors[b]), 1e-300) for b in block]).reshape(len(block), DIMENSION)
        last = i == len(blocks) - 1
        model = spark.sparkContext.broadcast((block, matrix))
        rows = rows.mapInArrow(_compared(model, i == 0, last), "doc_id long, held_out boolean, lang_pred string, score double" if last else _STATE)
    return rows


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang; other columns are not read).

    Rows with crc32 of doc_id in decimal divisible by 5 are held out; profiles are learned from the text and language of the
    others, as far as neither is null. A row with a null doc_id is not held out and not learned from. Texts are lower-cased; all
    letters of any script count, everything else is a space. Repeated rows count as often as they occur, and long
    texts whole. An empty table gives no rows."""
    rows = docs.selectExpr(
        "cast(doc_id as long) as doc_id", "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false) as held_out", "text", "lang"
    )
    known = profiles(rows.where("doc_id is not null and not held_out"))
    return predicted(rows.select("doc_id", "held_out", "text"), known)
