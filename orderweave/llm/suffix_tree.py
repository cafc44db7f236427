"""Language-model scores by a probabilistic suffix tree over the bytes of words, and by word frequencies.

What is learned lies in shards, what is scored in blocks of documents. A block asks each shard once for the distinct
codes that it holds, so nothing is broadcast but a table of byte pairs, and nothing is looked up per word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderweave.llm.counting import Counter, Lookup, summed
from orderweave.llm.words import Words, mix, pieces
from orderweave.session import configure, pin, sql

#: Longest context, in bytes. A code is a context and the next byte.
DEPTH = 5
#: A context is a state if it was seen so often, and its next-byte distribution differs from that of its suffix
#: by so much: count times Kullback-Leibler divergence, in nats.
MIN_COUNT, DIVERGENCE = 16, 12.0
#: Taken off the count of each word, as mass for the tree's own words.
DISCOUNT = 0.75
#: Words of a block of documents.
BLOCK_WORDS = 1_200_000
#: Least numbers of shards and blocks.
LEAST_PARTS = 64

END_WORD = np.uint64(0x0E4D0F7E87A3C5B1)
_SPACE, _MARK = 32, 10
_GRAMS, _WORDS = 0, 1
_ADD = 0.1  # fixed value of the frequency score


def _symbols(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All rows as bytes: DEPTH marks, then each word with a space after it; and their offsets."""
    lengths = w.end - w.start
    ends = np.concatenate(([0], np.cumsum(lengths + 1)))
    sizes = DEPTH + ends[w.first[1:]] - ends[w.first[:-1]]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(offsets[-1], _SPACE, np.uint8)
    for j in range(DEPTH):
        out[offsets[:-1] + j] = _MARK
    if len(w):
        target = ends[:-1] + DEPTH * (w.row + 1)
        inside = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        source = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        out[source + np.repeat(target - w.start, lengths)] = w.data[source]
    return out, offsets


def _codes(w: Words) -> np.ndarray:
    """The code of each predicted byte, word after word, the space after each included."""
    symbols, offsets = _symbols(w)
    n = len(symbols) - DEPTH
    code = np.zeros(max(n, 0), np.uint64)
    for j in range(DEPTH + 1):
        code = code << np.uint64(8) | symbols[j : j + n].astype(np.uint64)
    wanted = np.ones(len(symbols), bool)
    for j in range(DEPTH):
        wanted[offsets[:-1] + j] = False
    return code[wanted[DEPTH:]]


def _shard(codes: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """Codes with the same last two context bytes are together, and so is each subtree below depth two."""
    key = (codes >> np.uint64(8)) & np.uint64(0xFFFF) if kind == _GRAMS else codes
    return (mix(key + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _split(codes: np.ndarray, kind: int, shards: int):
    """Positions of the codes of each shard that has any."""
    shard = _shard(codes, kind, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(shard[at[0]]), at


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_COUNTS = pa.schema([("shard", pa.int64()), ("kind", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def _count(shards: int):
    def run(batches):
        counters = {_GRAMS: Counter(), _WORDS: Counter()}
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                counters[_GRAMS].add(_codes(w))
                counters[_WORDS].add(np.concatenate((w.hash, np.full(len(part), END_WORD))))
        for kind, counter in counters.items():
            codes, counts = counter.items()
            for shard, at in _split(codes, kind, shards):
                yield _table([(shard, kind, codes[at].tobytes(), counts[at].tobytes())], _COUNTS).to_batches()[0]

    return run


_MODEL = "shard long, kind long, codes binary, counts binary, n_codes long, total long, once long"


def _merge(table: pa.Table) -> pa.Table:
    """All counts of one shard, by kind."""
    rows = []
    for kind in (_GRAMS, _WORDS):
        mine = table.filter(pa.compute.equal(table.column("kind"), kind))
        if len(mine):
            parts = [(np.frombuffer(c, np.uint64), np.frombuffer(n, np.int64)) for c, n in zip(mine.column("codes").to_pylist(), mine.column("counts").to_pylist())]
            codes, counts = summed(parts)
            rows.append((mine.column("shard")[0].as_py(), kind, codes.tobytes(), counts.tobytes(), len(codes), int(counts.sum()), int((counts == 1).sum())))
    return _table(rows, pa.schema([*_COUNTS, ("n_codes", pa.int64()), ("total", pa.int64()), ("once", pa.int64())]))


def _pairs(batches):
    for batch in batches:
        for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
            found = np.bincount((np.frombuffer(codes, np.uint64) & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(counts, np.int64), 1 << 16)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some].astype(np.int64))], ["pair", "n"])


def _pair_model(rows) -> np.ndarray:
    """P(next byte | byte), smoothed by the bytes' own frequencies; the base of the tree."""
    counts = np.zeros((256, 256))
    for r in rows:
        counts[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    single = (counts.sum(0) + 1) / (counts.sum() + 256)
    kinds = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    return (counts + kinds * single) / (counts.sum(1, keepdims=True) + kinds)


class Subtree:
    """The part of the tree in one shard: contexts of two bytes and more, with the counts of the bytes after them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, base: np.ndarray):
        self.base = base
        levels = {DEPTH: (codes, counts)}
        for depth in range(DEPTH - 1, 1, -1):
            above = levels[depth + 1]
            levels[depth] = summed([(above[0] & np.uint64((1 << 8 * (depth + 1)) - 1), above[1])])
        self.levels = {}
        lower_codes = lower = None
        for depth in range(2, DEPTH + 1):
            codes, counts = levels[depth]
            context = codes >> np.uint64(8)
            opens = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(codes) else np.empty(0, np.int64)
            seen = np.add.reduceat(counts, opens) if len(codes) else counts
            kinds = np.diff(np.append(opens, len(codes)))
            if depth == 2:
                suffix = base[((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (codes & np.uint64(255)).astype(np.int64)]
            else:
                suffix = lower[np.searchsorted(lower_codes, codes & np.uint64((1 << 8 * depth) - 1))]
            n, t = np.repeat(seen, kinds), np.repeat(kinds, kinds)
            smooth = (counts + t * suffix) / (n + t)
            gain = counts * np.log(counts / n / suffix)
            kept = (np.add.reduceat(gain, opens) >= DIVERGENCE) & (seen >= MIN_COUNT) if len(codes) else np.empty(0, bool)
            self.levels[depth] = (codes, smooth, context[opens], kinds / (seen + kinds), kept)
            lower_codes, lower = codes, smooth

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """log10 P(next byte | longest state that ends the context) of each code."""
        now = self.base[((wanted >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (wanted & np.uint64(255)).astype(np.int64)]
        result = now
        for depth in range(2, DEPTH + 1):
            codes, smooth, contexts, back, kept = self.levels[depth]
            if not len(codes):
                break
            code = wanted & np.uint64((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, code >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == code >> np.uint64(8)
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            now = np.where(known, np.where(codes[place] == code, smooth[place], back[at] * now), now)
            result = np.where(known & (kept[at] | (depth == 2)), now, result)
        return np.log10(result)


_ASKED = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("kind", pa.int64()), ("codes", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("codes", pa.binary()), ("values", pa.binary())])


def _ask(shards: int):
    def run(table: pa.Table) -> pa.Table:
        counters = {_GRAMS: Counter(), _WORDS: Counter()}
        for batch in table.combine_chunks().to_batches():
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                counters[_GRAMS].add(_codes(w))
                counters[_WORDS].add(np.append(w.hash, END_WORD))
        block = table.column("block")[0].as_py()
        rows = []
        for kind, counter in counters.items():
            codes, _ = counter.items()
            rows += [(block, shard, kind, codes[at].tobytes()) for shard, at in _split(codes, kind, shards)]
        return _table(rows, _ASKED)

    return run


def _answer(base: np.ndarray):
    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        held = {
            k: (np.frombuffer(c, np.uint64), np.frombuffer(n, np.int64))
            for k, c, n in zip(*(model.column(x).to_pylist() for x in ("kind", "codes", "counts")))
        }
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64))
        tree, (words, counts) = Subtree(*held.get(_GRAMS, empty), base), held.get(_WORDS, empty)
        rows = []
        for block, kind, codes in zip(*(asked.column(x).to_pylist() for x in ("block", "kind", "codes"))):
            wanted = np.frombuffer(codes, np.uint64)
            if kind == _GRAMS:
                values = tree.log10(wanted).astype(np.float32)
            else:
                at = np.minimum(np.searchsorted(words, wanted), max(len(words) - 1, 0))
                values = np.where(words[at] == wanted, counts[at], 0) if len(words) else np.zeros(len(wanted), np.int64)
            rows.append((block, kind, codes, values.tobytes()))
        return _table(rows, _ANSWERS)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, tree_score double"


def _score(total: int, distinct: int, once: int):
    down = math.log10(total + _ADD * (distinct + 1))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = {}
        for kind, t in ((_GRAMS, np.float32), (_WORDS, np.int64)):
            mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            codes = np.concatenate([np.frombuffer(x, np.uint64) for x in mine.column("codes").to_pylist()] or [np.empty(0, np.uint64)])
            values = np.concatenate([np.frombuffer(x, t) for x in mine.column("values").to_pylist()] or [np.empty(0, t)])
            order = np.argsort(codes)
            found[kind] = Lookup(codes[order], values[order])
        out = []
        for batch in table.combine_chunks().to_batches():
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                logs = np.concatenate(([0.0], np.cumsum(found[_GRAMS][_codes(w)], dtype=np.float64)))
                ends = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
                counts = found[_WORDS][w.hash]
                spelled = logs[ends[1:]] - logs[ends[:-1]]
                end = int(found[_WORDS][np.array([END_WORD])][0])
                words, kinds = total - end, distinct - (end > 0)
                stop = (end + 0.5) / (total + 1)
                # the share of words not seen before, by those seen once (Good and Turing)
                unseen = (once + 0.5) / (words + 1)
                drawn = np.full(len(w), math.log10(unseen))
                known_word = counts > 0
                seen = (counts[known_word] - DISCOUNT + DISCOUNT * kinds * 10 ** spelled[known_word]) / max(words, 1)
                drawn[known_word] = np.log10(seen) + math.log10(1 - unseen)
                scores = np.concatenate(([0.0], np.cumsum(drawn + math.log10(1 - stop))))
                spelled = np.concatenate(([0.0], np.cumsum(spelled)))
                base = np.concatenate(([0.0], np.cumsum(np.log10(counts + _ADD) - down)))
                known = np.concatenate(([0], np.cumsum(counts > 0)))
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            part.column("held_out"),
                            pa.array(w.count + 1),
                            pa.array(known[w.first[1:]] - known[w.first[:-1]] + int(end > 0)),
                            pa.array(np.full(len(part), total, np.int64)),
                            pa.array(base[w.first[1:]] - base[w.first[:-1]] + math.log10(end + _ADD) - down),
                            pa.array(scores[w.first[1:]] - scores[w.first[:-1]] + math.log10(stop)),
                            pa.array(spelled[w.first[1:]] - spelled[w.first[:-1]]),
                        ],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "tree_score"],
                    )
                )
        return pa.Table.from_batches(out)

    return run


def suffix_tree_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, tree_score for every row of ``docs`` (doc_id, text).

    Both models learn from the rows where crc32(doc_id as text) mod 10 is not 0; a null doc_id counts as the empty text, so
    such rows are held out. Tokens are words, A-Z lower-cased, and one end. ``base_score`` sums log10 smoothed
    frequencies of the tokens. ``score`` is log10 of the probability that the model gives the tokens, words not met in
    training being one token as they are there: a token is the end, an unseen word with the share that Good and Turing
    give, or a word drawn from the discounted counts or, with what that leaves, spelled out by the suffix tree.
    ``tree_score`` is the tree's probability of spelling all the words, so it tells unseen words apart.

    The tree runs over the bytes of the text, with a space after each word. A context of 3 to 5 bytes is a state if it passes the
    test above, one of two always is; next-byte distributions are interpolated with those of shorter contexts (Witten and
    Bell), and the longest state that ends the context predicts. A null text is empty. No training row is no error."""
    spark = configure(docs.sparkSession)
    shards = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.selectExpr(
        "cast(doc_id as long) as doc_id", "text", "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 0 as held_out"
    )
    schema = "shard long, kind long, codes binary, counts binary"
    counted = docs.mapInArrow(_count(shards), schema)
    model = pin(counted.groupBy("shard").applyInArrow(_merge, _MODEL), "model")
    known = sql("select coalesce(sum(total), 0) as total, coalesce(sum(n_codes), 0) as n, coalesce(sum(once), 0) as once from {m} where kind = 1", m=model).first()
    # at most 65,536 rows
    base = _pair_model(model.where("kind = 0").select("codes", "counts").mapInArrow(_pairs, "pair long, n long").groupBy("pair").sum("n").withColumnRenamed("sum(n)", "n").collect())
    blocks = max(LEAST_PARTS, shards, -(-known["total"] // BLOCK_WORDS))
    # by the text as well, so that rows without an id spread
    dealt = docs.selectExpr("doc_id", "text", "held_out", f"pmod(xxhash64(doc_id, text), {blocks}) as block")
    asked = dealt.groupBy("block").applyInArrow(_ask(shards), "block long, shard long, kind long, codes binary")
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answer(base), "block long, kind long, codes binary, values binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(known["total"], known["n"], known["once"]), _SCORES)
