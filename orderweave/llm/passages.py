"""Passages that a document shares with an earlier one, alike or nearly so: seeds, collinear chains, alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orderweave.llm.fuzzy_lines import edit_distance
from orderweave.llm.linking import drop_shuffles
from orderweave.llm.words import Words, mix, pieces, signed
from orderweave.session import configure, pin, sql

#: Words of a seed, and neighbouring seeds of which the smallest hash is kept. Any 50 equal words share 3 kept seeds or more.
SEED, WINDOW = 8, 12
#: All documents with a seed that at most so many have are compared; of the other seeds, two documents must share so many.
GROUP, SHARED = 16, 2
#: A passage has at least so many words on both sides, and so many per cent of the longer side agree.
WORDS, PERCENT = 50, 80
#: Cost of a skipped word on either side of a chain, and words after which a chain ends.
GAP_COST, GAP = 0.5, 25
#: Words that must agree for an alignment to go on beyond an edit.
ANCHOR = 4

_FOUND = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "end", "n_words", "source_id", "source_start", "source_end", "n_edits")]
)
_WAYS = pa.schema([(c, pa.int64()) for c in ("doc_id", "seed", "way", "next", "gram")])
_SEARCHED = pa.schema([(c, pa.int64()) for c in ("doc_id", "mark", "run", "seed", "start", "end")])


def _minima(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All seeds; and the smallest of WINDOW neighbouring ones, its row and the index of the first of them, for rows of WORDS
    words or more."""
    values, at = w.shingles(SEED)
    n = len(values) - WINDOW + 1
    if n <= 0:
        return values, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    row = w.row[at]
    least, have = values, 1
    while have < WINDOW:  # smallest of ``have`` neighbours, doubled
        step = min(have, WINDOW - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    inside = np.flatnonzero((row[:n] == row[WINDOW - 1 :]) & (w.count[row[:n]] >= WORDS))
    return values, least[inside], row[inside], inside


def _in_row(row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mix(codes ^ mix(row.astype(np.uint64) + np.uint64(1)))


def _seeds(batches):
    """The distinct seeds kept of each document of WORDS words or more."""
    for batch in batches:
        for part in pieces(batch, "text"):
            _, least, row, _ = _minima(Words(part.column("text")))
            if not len(least):
                continue
            once = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (least[1:] != least[:-1]))))
            row, least = row[once], least[once]
            _, once = np.unique(_in_row(row, least), return_index=True)
            ids = part.column("doc_id").take(pa.array(row[once]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(signed(least[once]))], ["doc_id", "seed"])


def _searched(batches):
    """Of each document, the distinct runs of WORDS words in which every kept seed is one of its ``common`` ones, and every place
    (code points, with a hash of the text) of a common seed."""
    span = WORDS - SEED - WINDOW + 2  # minima of a run
    for batch in batches:
        for part in pieces(batch, "text"):
            w = Words(part.column("text"))
            values, least, row, inside = _minima(w)
            wanted = _in_row(*_rows_of(part.column("common")))
            common = np.zeros(len(values), np.int64)
            common[inside] = np.isin(_in_row(row, least), wanted)
            sums = np.concatenate(([0], np.cumsum(common)))
            first = np.flatnonzero(sums[span:] - sums[:-span] == span) if len(values) >= span else np.empty(0, np.int64)
            if len(first):
                code = np.zeros(len(first), np.uint64)
                for step in [*range(0, WORDS - SEED, SEED), WORDS - SEED]:
                    code = mix((code ^ values[first + step]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                row = row[np.searchsorted(inside, first)]
                _, once = np.unique(_in_row(row, code), return_index=True)
                yield _batch(_SEARCHED, doc_id=part.column("doc_id").take(pa.array(row[once])), run=signed(code[once]))
            _, at = w.shingles(SEED)
            row = w.row[at]
            here = np.flatnonzero(np.isin(_in_row(row, values), wanted))
            if len(here):
                row, at = row[here], at[here]
                points = np.concatenate(([0], np.cumsum((w.raw & 0xC0) != 0x80, dtype=np.int64)))
                before = points[w.offsets[row]]
                yield _batch(
                    _SEARCHED,
                    doc_id=part.column("doc_id").take(pa.array(row)),
                    mark=part.column("mark").take(pa.array(row)),
                    seed=signed(values[here]),
                    start=points[w.start[at]] - before,
                    end=points[w.end[at + SEED - 1]] - before,
                )


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each entry of a list column, and the entry."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy().view(np.uint64)


def _paths(w: Words, wanted: pa.Array):
    """For either side of each place of the ``wanted`` seeds and each number of words outwards from it, as long as ANCHOR words follow:
    row, seed, a code of seed, side and the words so far, the next word, and where it stands, its step and the words left.

    A path ends at the next place of its seed: documents that both go on beyond it are told apart from there."""
    values, at = w.shingles(SEED)
    row = w.row[at]
    here = np.flatnonzero(np.isin(_in_row(row, values), _in_row(*_rows_of(wanted))))
    here = here[np.lexsort((at[here], values[here], row[here]))]
    values, at, row = values[here], at[here], row[here]
    apart = np.full(len(at) + 1, WORDS)
    apart[1:-1] = np.where((values[1:] == values[:-1]) & (row[1:] == row[:-1]), np.diff(at), WORDS)
    sides = ((1, at - 1, at - w.first[row], -1, apart[:-1]), (2, at + SEED, w.first[row + 1] - at - SEED, 1, apart[1:]))
    for side, begin, left, step, most in sides:
        rows, seeds, now, code = row, values, begin, mix(values + np.uint64(side))
        for k in range(WORDS - SEED):
            go = (left >= ANCHOR) & (k < most)
            rows, seeds, now, left, code, most = rows[go], seeds[go], now[go], left[go], code[go], most[go]
            word = w.hash[now]
            yield rows, seeds, code, word, now, step, left
            code = mix((code ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            now, left = now + step, left - 1


def _ways(batches):
    """The distinct ways on from the places of the ``wanted`` seeds of each document."""
    for batch in batches:
        for part in pieces(batch, "text"):
            for rows, seeds, code, word, *_ in _paths(Words(part.column("text")), part.column("wanted")):
                _, once = np.unique(_in_row(rows, mix(code ^ word)), return_index=True)
                if len(once):
                    ids = part.column("doc_id").take(pa.array(rows[once]))
                    yield _batch(_WAYS, doc_id=ids, seed=signed(seeds[once]), way=signed(code[once]), next=signed(word[once]))


def _onward_from(batches):
    """The distinct runs of ANCHOR words that each document has within GAP words of where it takes one of its ``ways``."""
    for batch in batches:
        for part in pieces(batch, "text"):
            w = Words(part.column("text"))
            values, at = w.shingles(ANCHOR)
            grams = np.zeros(len(w), np.uint64)
            grams[at] = values
            ways = _in_row(*_rows_of(part.column("ways")))
            for rows, seeds, code, word, now, step, left in _paths(w, part.column("wanted")):
                some = np.flatnonzero(np.isin(_in_row(rows, code), ways))
                n = np.minimum(left[some] - ANCHOR, GAP) + 1
                of = np.repeat(some, n)
                off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                gram = grams[now[of] + step * off - (ANCHOR - 1 if step < 0 else 0)]
                _, once = np.unique(_in_row(rows[of], mix(code[of] ^ word[of]) + gram), return_index=True)
                if len(once):
                    of, gram = of[once], gram[once]
                    ids = part.column("doc_id").take(pa.array(rows[of]))
                    yield _batch(_WAYS, doc_id=ids, seed=signed(seeds[of]), way=signed(code[of]), next=signed(word[of]), gram=signed(gram))


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs (x, y, words) of equal seeds on one diagonal.

    A seed that occurs several times on both sides is matched in order, and with its first occurrence in y: so matches
    grow with the words, not with their square; what that leaves out the alignment fills in."""
    order_x, order_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    sx, sy = x[order_x], y[order_y]
    lo, hi = np.searchsorted(sy, sx, "left"), np.searchsorted(sy, sx, "right")
    nth = np.arange(len(sx)) - np.searchsorted(sx, sx, "left")
    found = hi > lo
    first = np.stack((order_x[found], order_y[lo[found]]), axis=1)
    again = found & (nth > 0) & (lo + nth < hi)
    match = np.concatenate((first, np.stack((order_x[again], order_y[(lo + nth)[again]]), axis=1)))
    if not len(match):
        return []
    match = match[np.lexsort((match[:, 0], match[:, 0] - match[:, 1]))]
    opens = np.ones(len(match), bool)
    opens[1:] = (np.diff(match[:, 0]) != 1) | (np.diff(match[:, 1]) != 1)
    heads = np.flatnonzero(opens)
    sizes = np.diff(np.append(heads, len(match))) + SEED - 1
    return sorted((int(match[h, 0]), int(match[h, 1]), int(n)) for h, n in zip(heads, sizes))


def chains(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Ordered matches chained for the highest words less gap costs; best first, each run in one chain.

    Runs enter a Fenwick tree over their ends in y once the sweep over x has passed them; a prefix maximum gives
    the best run to follow, as the gap cost splits into a part of either end."""
    ends_y = sorted({y + n for _, y, n in runs})
    rank = {v: i + 1 for i, v in enumerate(ends_y)}
    starts = np.searchsorted(ends_y, [y for _, y, _ in runs], "right").tolist()
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends_y) + 1)
    score, back = [0.0] * len(runs), [-1] * len(runs)
    waiting = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    next_in = 0
    for i, (x, y, n) in enumerate(runs):
        while next_in < len(waiting) and runs[waiting[next_in]][0] + runs[waiting[next_in]][2] <= x:
            j = waiting[next_in]
            next_in += 1
            entry = (score[j] + GAP_COST * (runs[j][0] + runs[j][1] + 2 * runs[j][2]), j)
            at = rank[runs[j][1] + runs[j][2]]
            while at < len(tree):
                tree[at] = max(tree[at], entry)
                at += at & -at
        best, at = (-1e18, -1), starts[i]
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * (x + y)
        score[i], back[i] = (n + gain, best[1]) if gain > 0 else (float(n), -1)
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and max(chain[-1][0] - runs[i][0] - runs[i][2], chain[-1][1] - runs[i][1] - runs[i][2]) > GAP:
                out.append(chain[::-1])
                chain = []
            chain.append(runs[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _onward(a: list[int], b: list[int], x: int, y: int) -> tuple[int, int, int]:
    """How far the words from x and y on agree but for single and double edits: ends and edits."""
    edits = 0
    while True:
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
        for dx, dy in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (2, 1), (1, 2)):
            if x + dx + ANCHOR <= len(a) and y + dy + ANCHOR <= len(b) and a[x + dx : x + dx + ANCHOR] == b[y + dy : y + dy + ANCHOR]:
                x, y, edits = x + dx, y + dy, edits + max(dx, dy)
                break
        else:
            return x, y, edits


def passages(a: np.ndarray, b: np.ndarray, seeds_a: np.ndarray, seeds_b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Shared passages (start and end in a, start and end in b, edits) of two documents, given as word and seed hashes."""
    runs = _runs(seeds_a, seeds_b)
    if not runs:
        return []
    a, b = a.tolist(), b.tolist()
    out: list[tuple[int, int, int, int, int]] = []
    for chain in chains(runs):
        x0, y0, _ = chain[0]
        if any(p[0] <= x0 and p[1] >= chain[-1][0] + chain[-1][2] for p in out):
            continue
        edits = 0
        for (x, y, n), (nx, ny, _) in zip(chain, chain[1:]):
            left, right = a[x + n : nx], b[y + n : ny]
            edits += edit_distance(left, right, len(left) + len(right))
        x1, y1, more = _onward(a, b, chain[-1][0] + chain[-1][2], chain[-1][1] + chain[-1][2])
        edits += more
        back_x, back_y, more = _onward(a[:x0][::-1], b[:y0][::-1], 0, 0)
        x0, y0, edits = x0 - back_x, y0 - back_y, edits + more
        longer, shorter = max(x1 - x0, y1 - y0), min(x1 - x0, y1 - y0)
        if shorter >= WORDS and 100 * (longer - edits) >= PERCENT * longer and (x0, x1, y0, y1, edits) not in out:
            out.append((x0, x1, y0, y1, edits))
    return sorted(out)


def _aligned(batches):
    for batch in batches:
        for piece in pieces(batch, "text_a"):
            for part in pieces(piece, "text_b"):
                sides = []
                for c in ("text_a", "text_b"):
                    w = Words(part.column(c))
                    values, at = w.shingles(SEED)
                    sides.append((w, values, np.searchsorted(at, w.first)))
                (wa, sa, ca), (wb, sb, cb) = sides
                rows = []
                for i, (doc, source) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist())):
                    la, lb = int(wa.first[i]), int(wb.first[i])
                    found = passages(wa.hash[la : wa.first[i + 1]], wb.hash[lb : wb.first[i + 1]], sa[ca[i] : ca[i + 1]], sb[cb[i] : cb[i + 1]])
                    for x0, x1, y0, y1, edits in found:
                        here = _points(wa, i, la + x0, la + x1)
                        there = _points(wb, i, lb + y0, lb + y1)
                        rows.append((doc, *here, x1 - x0, source, *there, edits))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_FOUND)


def _points(w: Words, row: int, first: int, end: int) -> tuple[int, int]:
    """Code point offsets in its text of the words from ``first`` to before ``end``."""
    # every byte but those that continue a character starts one
    a, b, c = int(w.offsets[row]), int(w.start[first]), int(w.end[end - 1])
    before = int(np.count_nonzero((w.raw[a:b] & 0xC0) != 0x80))
    return before, before + int(np.count_nonzero((w.raw[b:c] & 0xC0) != 0x80))


def _columns(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} long" for f in schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, source_id, source_start, source_end, n_edits: the passages of documents of ``docs``
    (doc_id, text) that an earlier document, of a smaller doc_id, has as well. Offsets are code points, end exclusive.

    A passage has 50 words or more (A-Z lower-cased) on both sides, 80 % of them in agreement. Documents that share a seed that at
    most GROUP documents have are all compared. Beyond that, a document is compared with the first one that has the same 50 words in a
    row, for each such run, and with the first and the last document of each seed if they share SHARED; where that leaves a place of
    such a seed outside all passages found in the document, with every earlier document of the seed that has ANCHOR equal words within
    GAP words of where the equal words around the place end, as all that share a passage with edits there have. So a passage that m
    documents share gives about 2m pairs, not m squared, and of equal passages each copy but the first is found beside the first; and
    wherever a document shares a kept seed and a passage around it with an earlier one, edited or not, a passage found beside some
    earlier document holds that place. Repeats within one document are not reported.
    Null, empty and short texts and rows with a null doc_id have no passages; rows that repeat a doc_id are one document
    with several texts, each reported for itself and not compared with one another."""
    configure(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("doc_id is not null and text is not null")
    seeds = pin(docs.mapInArrow(_seeds, "doc_id long, seed long"), "seeds")
    ends = "select seed, count(*) as n, min(doc_id) as lo, max(doc_id) as hi from {s} group by seed having min(doc_id) <> max(doc_id)"
    found = pin(sql(f"select s.doc_id, e.* from {{s}} s join ({ends}) e on s.seed = e.seed", s=seeds), "found")
    common = sql(f"select doc_id, collect_set(seed) as common from {{f}} where n > {GROUP} group by doc_id", f=found)
    texts = sql("select d.doc_id, d.text, xxhash64(d.text) as mark, c.common from {d} d join {c} c on d.doc_id = c.doc_id", d=docs, c=common)
    searched = pin(texts.mapInArrow(_searched, _columns(_SEARCHED)), "searched")
    runs = searched.where("run is not null").select("doc_id", "run")
    pairs = pin(
        sql(
            f"""select a, b from (
                  select inline(flatten(transform(ids, x -> transform(filter(ids, y -> y < x), y -> named_struct('a', x, 'b', y)))))
                  from (select collect_set(doc_id) as ids from {{f}} where n <= {GROUP} group by seed))
                union
                select r.doc_id, e.lo from {{r}} r join (select run, min(doc_id) as lo from {{r}} group by run) e on r.run = e.run
                where r.doc_id <> e.lo
                union
                select a, b from (
                  select inline(array(named_struct('a', doc_id, 'b', lo), named_struct('a', if(doc_id = lo, null, hi), 'b', doc_id)))
                  from {{f}} where n > {GROUP})
                where a <> b group by a, b having count(*) >= {SHARED}""",
            f=found,
            r=runs,
        ),
        "pairs",
    )
    passages_of = lambda pairs: sql(
        """select p.a, p.b, x.text as text_a, y.text as text_b
           from {p} p join {d} x on p.a = x.doc_id join {d} y on p.b = y.doc_id""",
        p=pairs,
        d=docs,
    ).mapInArrow(_aligned, _columns(_FOUND))
    drop_shuffles(docs.sparkSession)
    near = pin(passages_of(pairs), "passages")
    # places of frequent seeds that no passage found so far holds; one of several texts of a doc_id may be the one that holds it
    places = sql(
        f"""select s.*, m.doc_id is not null as many
            from {{s}} s join {{f}} f on s.doc_id = f.doc_id and s.seed = f.seed
              left join (select doc_id from {{s}} where seed is not null group by doc_id having min(mark) <> max(mark)) m on s.doc_id = m.doc_id
            where f.n > {GROUP} and s.doc_id > f.lo""",
        s=searched,
        f=found,
    )
    bare = pin(
        sql(
            """select distinct p.doc_id, p.seed from {p} p
               left anti join {n} n on not p.many and p.doc_id = n.doc_id and n.start <= p.start and p.end <= n.end""",
            p=places,
            n=near,
        ),
        "bare",
    )
    drop_shuffles(docs.sparkSession)
    wanted = sql("select doc_id, collect_set(seed) as wanted from {f} f left semi join {u} u on f.seed = u.seed group by doc_id", f=found, u=bare)
    texts = sql("select d.doc_id, d.text, w.wanted from {d} d join {w} w on d.doc_id = w.doc_id", d=docs, w=wanted)
    ways = pin(texts.mapInArrow(_ways, _columns(_WAYS)), "ways")
    # where the equal words around a place end, two documents take different ways; what lies beyond tells which can share a passage
    parted = sql(
        """select way from {w} w left join {u} u on w.doc_id = u.doc_id and w.seed = u.seed
           group by way having min(next) <> max(next) and min(w.doc_id) <> max(w.doc_id) and count(u.doc_id) > 0""",
        w=ways,
        u=bare,
    )
    taken = sql("select doc_id, collect_set(seed) as wanted, collect_set(way) as ways from {w} w left semi join {p} p on w.way = p.way group by doc_id", w=ways, p=parted)
    texts = sql("select d.doc_id, d.text, t.wanted, t.ways from {d} d join {t} t on d.doc_id = t.doc_id", d=docs, t=pin(taken, "taken"))
    onward = pin(texts.mapInArrow(_onward_from, _columns(_WAYS)), "onward")
    rest = pin(
        sql(
            """select distinct x.doc_id as a, y.doc_id as b
               from {o} x left semi join {u} u on x.doc_id = u.doc_id and x.seed = u.seed
                 join {o} y on x.way = y.way and x.gram = y.gram and x.next <> y.next and x.doc_id > y.doc_id
               except select a, b from {p}""",
            o=onward,
            u=bare,
            p=pairs,
        ),
        "rest",
    )
    drop_shuffles(docs.sparkSession)
    return near.unionByName(passages_of(rest)).distinct()
