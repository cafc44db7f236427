import random

import pytest

from orderweave.llm.passages import GROUP, WORDS, chains, repeated_passages


def _words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, seed int")


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(4)
    exact, fuzzy = _words(rng, 60), _words(rng, 120)
    docs = {i: _words(rng, 200) for i in range(30)}
    for i in (3, 9, 17):
        docs[i][40:40] = exact
    for i in (5, 21):
        copy = list(fuzzy)
        for at in range(10 + i, 110, 25):
            copy[at] = "edit"
        docs[i][100:100] = copy
    rows = [(i, " ".join(t), "x", 1) for i, t in docs.items()]
    rows += [(100, None, None, None), (101, "", "x", 1), (None, " ".join(docs[3]), "x", 1), (102, "short text", "x", 1), (102, "short text", "x", 1)]
    found = {(r.doc_id, r.source_id): r for r in repeated_passages(_docs(spark, rows)).collect()}
    assert {(9, 3), (17, 3), (17, 9), (21, 5)} == set(found)
    texts = {i: " ".join(t) for i, t in docs.items()}
    r = found[9, 3]
    assert texts[9][r.start : r.end] == " ".join(exact) == texts[3][r.source_start : r.source_end] and r.n_edits == 0
    r = found[21, 5]
    assert texts[21][r.start : r.end].split()[5:-5] == texts[21].split()[105:215] and 0 < r.n_edits <= 12


@pytest.mark.parametrize("others", [1, GROUP + 4])
def test_a_passage_whose_parts_other_documents_hold_is_found(spark, others):
    rng = random.Random(6)
    passage = _words(rng, 60)
    docs = {i: _words(rng, 120) for i in range(4 * others + 2)}
    first, second = 2 * others, 2 * others + 1
    for i in docs:
        # too few words to be a passage, but every seed of the passage is in documents before and after
        docs[i][50:50] = passage if i in (first, second) else passage[:40] if i % 2 else passage[20:]
    rows = repeated_passages(_docs(spark, [(i, " ".join(t), "x", 1) for i, t in docs.items()])).collect()
    assert [(r.doc_id, r.source_id, r.n_words, r.n_edits) for r in rows] == [(second, first, 60, 0)]


def test_edited_passages_of_few_documents_are_all_found(spark):
    rng = random.Random(7)
    passage = _words(rng, 150)
    docs = {i: _words(rng, 100) for i in range(8)}
    for i in docs:
        part = passage[:75] if i in (0, 7) else passage[75:] if i in (1, 6) else list(passage)
        if len(part) > 75:
            part[10 * i] = part[74] = part[76] = f"edit{i}"
        docs[i][40:40] = part
    found = {(r.doc_id, r.source_id) for r in repeated_passages(_docs(spark, [(i, " ".join(t), "x", 1) for i, t in docs.items()])).collect()}
    whole = range(2, 6)
    assert {(a, b) for a in whole for b in whole if a > b} <= found


def test_edited_passages_of_frequent_seeds_are_found(spark):
    rng = random.Random(8)
    passage = _words(rng, 90)
    n = 2 * GROUP + 10
    docs = {i: _words(rng, 120) for i in range(n)}
    first, second = n // 2, n // 2 + 1
    for i in docs:
        # too few words to be a passage, but every seed is in many documents before and after
        part = list(passage) if i in (first, second) else passage[:45] if i % 2 else passage[45:]
        if i == second:
            part[45] = "edit"
        docs[i][50:50] = part
    found = repeated_passages(_docs(spark, [(i, " ".join(t), "x", 1) for i, t in docs.items()])).collect()
    assert [(r.doc_id, r.source_id, r.n_words, r.n_edits) for r in found] == [(second, first, 90, 1)]


def test_places_of_frequent_seeds_are_held_by_passages_as_by_comparing_all(spark, monkeypatch):
    import pyarrow as pa

    from orderweave.llm import passages
    from orderweave.llm.words import Words

    monkeypatch.setattr(passages, "GROUP", 2)
    rng = random.Random(9)
    long, phrase = _words(rng, 150), _words(rng, 30)
    docs = []
    for _ in range(60):
        part = rng.choice([long[:70], long[60:], long[30:110], long, phrase, phrase * 3])
        docs.append(_words(rng, 60) + [rng.choice((x, x, x, "edit", f"{x} more", "")) if rng.random() < 0.12 else x for x in part] + _words(rng, 40))
    texts = [" ".join(x for x in d if x) for d in docs]
    rows = passages.repeated_passages(_docs(spark, [(i, t, "x", 1) for i, t in enumerate(texts)])).collect()
    w = Words(pa.array(texts))
    _, least, row, _ = passages._minima(w)
    values, at = w.shingles(passages.SEED)
    kept = [set(least[row == i].tolist()) for i in range(len(texts))]
    words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
    seeds = [values[(at >= a) & (at < b)] for a, b in zip(w.first, w.first[1:])]
    offsets = [[len(" ".join(t.split()[:k])) + (k > 0) for k in range(len(t.split()))] for t in texts]
    n = 0
    for a in range(len(texts)):
        held = [(r.start, r.end) for r in rows if r.doc_id == a]
        places = {(x, s) for x, s in enumerate(seeds[a].tolist()) if s in kept[a]}
        for b in range(a):
            for x0, x1, *_ in passages.passages(words[a], words[b], seeds[a], seeds[b]):
                for x, s in places:
                    if x0 <= x and x + passages.SEED <= x1 and s in kept[b]:
                        n += 1
                        assert any(start <= offsets[a][x] < end for start, end in held)
    assert n > 1000


def test_copies_stand_beside_the_first_and_offsets_are_code_points(spark):
    text = " ".join(f"wört{i} ǳ😀" for i in range(40))
    rows = repeated_passages(_docs(spark, [(i, text, "x", 1) for i in range(1, 50)])).collect()
    assert {r.doc_id for r in rows if r.source_id == 1} == set(range(2, 50))
    assert {(r.start, r.end, r.n_edits) for r in rows} == {(0, len(text), 0)}
    assert len(rows) < 3 * 49


def test_repetitive_and_long_texts(spark):
    rows = repeated_passages(_docs(spark, [(1, "a b " * 30_000, "x", 1), (2, "a b " * 100, "x", 1), (3, "z" * 500_000, "x", 1)])).collect()
    assert all(r.n_words >= WORDS for r in rows)
    assert repeated_passages(_docs(spark, [])).count() == 0


def test_the_best_chain_is_that_of_every_order_tried(monkeypatch):
    monkeypatch.setattr("orderweave.llm.passages.GAP", 1000)
    rng = random.Random(1)
    for _ in range(200):
        runs = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(8, 12)) for _ in range(rng.randrange(1, 9))})
        got = chains(runs)
        assert sorted(r for c in got for r in c) == runs

        def best(i):
            x, y, n = runs[i]
            follows = [best(j) - 0.5 * (x - a - m + y - b - m) for j, (a, b, m) in enumerate(runs) if a + m <= x and b + m <= y]
            return n + max([0, *follows])

        def worth(chain):
            return sum(n for *_, n in chain) - 0.5 * sum(x - a - m + y - b - m for (a, b, m), (x, y, _) in zip(chain, chain[1:]))

        top = max(best(i) for i in range(len(runs)))
        assert abs(max(worth(c) for c in got) - top) < 1e-9
