"""Quality rules for documents: counted rules, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.words import Words, mix, pieces
from orderweave.session import configure, sql

#: Labelled documents of each class that the model is fitted on: those of smallest hash of doc_id.
TRAINING_ROWS = 1500
#: Hashed weights of each of the two feature groups.
WIDTH = 1 << 17
WORD_NGRAMS = 2
CHARACTER_NGRAM = 4
#: A document is kept if its calibrated probability of being good is at least this.
THRESHOLD = 0.2
MIN_WORDS = 10
MAX_REPEATED = 20  # percent

# fixed values: the characters counted as symbols
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_GRAM = [np.uint64(x) for x in np.random.default_rng(11).integers(1, 2**63, CHARACTER_NGRAM, dtype=np.uint64) | np.uint64(1)]

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _counts(w: Words) -> dict[str, np.ndarray]:
    """The counted rules of each row of a column."""
    n = len(w.offsets) - 1
    solid = np.zeros(len(w.data), np.int8)
    lengths = w.end - w.start
    if len(w):
        edge = np.zeros(len(w.data) + 1, np.int8)
        edge[w.start] += 1
        edge[w.end] -= 1
        solid = np.cumsum(edge, dtype=np.int8)[:-1] if int(lengths.max()) < 2**31 else solid
    code_points = (w.data & 0xC0) != 0x80
    values, at = w.shingles(5)
    row = w.row
    covered = np.zeros(len(w) + 1, np.int64)
    if len(values):
        _, inverse, found = np.unique(mix(values ^ mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        again = at[found[inverse] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 5, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    raw, offsets = w.data.tobytes(), w.offsets.tolist()
    doubled = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        doubled[i] = len(lines) - len(set(lines))
    return {
        "n_words": w.count,
        "word_chars": _per_row(code_points & (solid > 0), w.offsets),
        "n_symbols": _per_row(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": doubled,
        "n_repeat_words": _per_row(repeated, w.first),
    }


def _failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])


def _features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed word and character n-grams: (column, cuts of rows) of each of the two groups, every occurrence once."""
    words, cuts = [], []
    for k in range(1, WORD_NGRAMS + 1):
        values, at = w.shingles(k)
        words.append(values % np.uint64(WIDTH))
        cuts.append(np.searchsorted(at, w.first))
    n = max(0, len(w.data) - CHARACTER_NGRAM + 1)
    total = np.zeros(n, np.uint64)
    for j in range(CHARACTER_NGRAM):
        total += w.data[j : j + n].astype(np.uint64) * _GRAM[j]
    characters = ((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)  # a 17-bit hash
    starts = np.minimum(w.offsets, n)
    # a gram belongs to the row it starts in, and must end there
    ends = np.minimum(np.maximum(w.offsets[1:] - CHARACTER_NGRAM + 1, w.offsets[:-1]), n)
    return [*zip(words, cuts), (characters, (starts[:-1], ends))]


def _margin(w: Words, weights: np.ndarray) -> np.ndarray:
    """Sum over the feature groups of the mean weight of the row's features."""
    total = np.zeros(len(w.offsets) - 1)
    for group, (columns, cuts) in enumerate(_features(w)):
        sums = np.concatenate(([0.0], np.cumsum(weights[min(group // WORD_NGRAMS, 1)][columns.astype(np.int64)], dtype=np.float64)))
        a, b = cuts if isinstance(cuts, tuple) else (cuts[:-1], cuts[1:])
        total += np.where(b > a, (sums[b] - sums[a]) / np.maximum(b - a, 1), 0)
    return total


def _sparse(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row, distinct columns and values, so that ``values @ weights[columns]`` is its margin."""
    rows: list[list] = [[] for _ in w.count]
    for group, (columns, cuts) in enumerate(_features(w)):
        a, b = cuts if isinstance(cuts, tuple) else (cuts[:-1], cuts[1:])
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            if y > x:
                own, n = np.unique(columns[x:y].astype(np.int64) + min(group // WORD_NGRAMS, 1) * WIDTH, return_counts=True)
                rows[i].append((own, n / (y - x)))
    return [tuple(np.concatenate(x) for x in zip(*r)) if r else (np.empty(0, np.int64), np.empty(0)) for r in rows]


def _fit(batches):
    """One task over the bounded sample: weights by gradient steps on three quarters, calibration on the rest."""
    rows, labels = [], []
    for batch in batches:
        for part in pieces(batch, "text"):
            w = Words(part.column("text"), lower=False)
            failed = _failed(_counts(w))
            for row, label, bad in zip(_sparse(w), part.column("quality").to_pylist(), failed):
                if not bad and len(row[0]):
                    rows.append(row)
                    labels.append(label)
    y = np.array(labels, float)
    hold = np.arange(len(y)) % 4 == 3
    if len(set(labels)) < 2 or len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        return  # nothing to tell apart
    columns, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    at = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(y)), sizes)
    weight = np.where(y == 1, 0.5 / max(1, (y[~hold] == 1).sum()), 0.5 / max(1, (y[~hold] == 0).sum())) * ~hold
    theta, first, second, bias = np.zeros(2 * WIDTH), np.zeros(2 * WIDTH), np.zeros(2 * WIDTH), 0.0
    for step in range(1, 81):
        margin = np.add.reduceat(values * theta[columns], at) + bias
        error = (1 / (1 + np.exp(-margin)) - y) * weight
        gradient = np.bincount(columns, values * error[of], 2 * WIDTH) + 1e-9 * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta -= 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        bias -= 0.5 * error.sum()
    margin = (np.add.reduceat(values * theta[columns], at) + bias)[hold]
    # Platt's scaling with his smoothed targets
    good, bad = (y[hold] == 1).sum(), (y[hold] == 0).sum()
    target = np.where(y[hold] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [((p - target) * margin).sum(), (p - target).sum()])
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    out = np.concatenate((theta * a, [bias * a + b])).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["weights"])


def fit_quality(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """The fitted model (a megabyte), or None if the labels have one class only or no document.

    Of each class the TRAINING_ROWS labelled documents of smallest hash are read, so the sample has a fixed bound."""
    labels = sql("select cast(doc_id as long) as doc_id, cast(quality as int) as quality from {l} where doc_id is not null and quality in (0, 1)", l=labels)
    parts = [labels.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS) for q in (0, 1)]
    sample = parts[0].unionByName(parts[1]).dropDuplicates(["doc_id"])
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(F.broadcast(sample), "doc_id")
    # bounded rows, so one task; in a fixed order, so that the fit is the same each time
    rows = rows.dropDuplicates(["doc_id"]).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = rows.select("text", "quality").mapInArrow(_fit, "weights binary").collect()
    return bytes(found[0]["weights"]) if found else None


def quality(docs: DataFrame, labels: DataFrame, rows: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words;
    base_failed; probability (calibrated, null without a model); kept.

    Words are runs of non-blank bytes. A row fails with fewer than 10 words, or if over 20 % of its words lie in a
    5-word window found again in its text. Others are kept if the model says so (or there is none). Null texts are empty
    and fail. ``rows`` gives instead the rows of ``docs`` that are kept, with all their columns."""
    configure(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def scored(part):
        w = Words(part.column("text"), lower=False)
        counts = _counts(w)
        failed = _failed(counts)
        if model.value is None:
            return counts, failed, None
        weights = np.frombuffer(model.value, np.float32)
        bias, weights = weights[-1], weights[:-1].reshape(2, WIDTH)
        return counts, failed, 1 / (1 + np.exp(-np.clip(_margin(w, weights) + bias, -30, 30)))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                counts, failed, p = scored(part)
                kept = pa.array(~failed & (p >= THRESHOLD) if p is not None else ~failed)
                if rows:
                    yield part.filter(kept)
                    continue
                arrays = [part.column("doc_id"), *[pa.array(counts[c], pa.int64()) for c in _COUNTS], pa.array(failed)]
                arrays += [pa.array(p if p is not None else [None] * len(part), pa.float64()), kept]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COUNTS, "base_failed", "probability", "kept"])

    if rows:
        return docs.mapInArrow(run, docs.schema)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, probability double, kept boolean"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
