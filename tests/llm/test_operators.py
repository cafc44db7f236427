"""Each operator against a plain version: on the smallest given tables, and on rows that are hard to deal with."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from orderweave.llm.queries import QUERIES
from orderweave.llm.ship import ship
from tests.llm import brute
from tests.llm.conftest import SF


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# 1 ------------------------------------------------------------------------------------------------------------


def test_lines_alike_and_similar_stay_once(spark, hard, empty):
    from orderweave.llm.fuzzy_lines import edit_distance, repeated_lines, without_lines

    base = "the quick brown fox jumps over the lazy dog while twelve grey geese fly south for the long cold winter months"
    rows = [(1, f"{base}\nsomething else entirely", "x"), (2, base.upper() + "\n\nown line of two", "x"), (3, base.replace("geese", "geesf"), "x"), (4, "own line", "x")]
    rows += [(20 + i, base.replace(w, w[:-1] + "q"), "x") for i, w in enumerate(base.split()[3:11])]  # similar, not equal
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    gone = repeated_lines(docs)
    got = {r.doc_id: r.dropped for r in gone.collect()}
    assert got[1] == [] and got[2] == [0] and got[4] == []
    assert sum(got[i] == [0] for i in (3, *range(20, 28))) >= 7
    assert {r.doc_id for r in without_lines(docs, gone).collect()} >= {1, 2, 4}
    left = {r.doc_id: r for r in repeated_lines(hard).collect()}
    assert left[14].dropped == [1] and left[2].dropped == [0] and left[9].dropped == [0] and 5 not in left and None not in left
    assert repeated_lines(empty).count() == 0
    for a, b in itertools.product(["", "kitten", "sitting", "abcabc", "axbxc", "saturday", "sunday"], repeat=2):
        table = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert edit_distance(a, b, 20) == table[len(a), len(b)]


def one_edit(rng, line):
    at = rng.randrange(len(line))
    while line[at] == " ":
        at = rng.randrange(len(line))
    return line[:at] + {0: "", 1: "é", 2: line[at] + "q"}[rng.randrange(3)] + line[at + 1 :]


@pytest.mark.parametrize("words,least", [(10, 0.6), (20, 0.8), (40, 0.85)])
def test_recall_of_lines_that_differ_in_one_word(spark, words, least):
    from orderweave.llm.fuzzy_lines import repeated_lines, similar

    rng = random.Random(words)
    lines = [" ".join(f"{rng.choice('aeiouy')}{rng.randrange(10**rng.randrange(1, 7))}{rng.choice('xyz')}" for _ in range(words)) for _ in range(400)]
    pairs = [(x, one_edit(rng, x)) for x in lines]
    rows = [(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, b) in enumerate(pairs)]
    dropped = {r.doc_id for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.dropped}
    # the plain version compares each line with its own copy; strangers of this kind are never similar
    want = {1000 + i for i, (a, b) in enumerate(pairs) if similar(a, b)}
    assert dropped <= want and len(dropped) >= least * len(want)


def test_few_blocks_find_short_lines_and_lines_with_two_edits():
    import pyarrow as pa

    from orderweave.llm import fuzzy_lines
    from orderweave.llm.words import Words

    def met(words, edits):
        rng, pairs = random.Random(words), []
        for _ in range(500):
            a = b = " ".join(f"{rng.choice('aeiouy')}{rng.randrange(10**rng.randrange(1, 7))}{rng.choice('xyz')}" for _ in range(words))
            for _ in range(edits):
                b = one_edit(rng, b)
            pairs += [a, b]
        codes = fuzzy_lines._hashed(Words(pa.array(pairs)))[4].to_pylist()
        return sum(any(x == y for x, y in zip(*codes[i : i + 2])) for i in range(0, 1000, 2)) / 500

    assert met(6, 1) >= 0.75 and met(20, 2) >= 0.7 and met(40, 3) >= 0.65
    # strangers of this kind have no block in common, and long lines have few
    assert fuzzy_lines.MOST_BLOCKS <= 16 and fuzzy_lines._N_BLOCKS[33] <= 4


def test_links_of_lines_do_not_follow_the_number_of_documents(spark):
    from orderweave.llm.fuzzy_lines import repeated_lines

    rng = random.Random(5)
    lines = [" ".join(f"{rng.choice('aeiouy')}{rng.randrange(10**rng.randrange(1, 7))}{rng.choice('xyz')}" for _ in range(8)) for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(1000 + i, one_edit(rng, x)) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    others = spark.range(10_000, 210_000).selectExpr("id as doc_id", "'' as text")
    alone, among = ({r.doc_id for r in repeated_lines(d).collect() if r.dropped} for d in (docs, docs.union(others)))
    assert alone and alone == among


def test_majorities_of_groups_of_any_size():
    from orderweave.llm.fuzzy_lines import _majorities

    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 254, 255, 256, 509, 510, 511, 3000]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    values = rng.integers(0, 2**64, int(cuts[-1]), dtype=np.uint64) | np.uint64(3)
    got = _majorities(values, cuts)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        want = sum(1 << k for k in range(64) if 2 * sum(int(v) >> k & 1 for v in values[a:b]) > b - a)
        assert int(got[i]) == want


def test_equal_lines_of_all_documents_stay_once(spark, documents):
    got = {r.doc_id: {int(x) for x in r.dropped.split(",") if x} for r in run(spark, "op1_line_dedup")}
    seen = set()
    for i in sorted(documents):
        for n, line in enumerate(documents[i].split("\n")):
            words = tuple(brute.words(line))
            if words and words in seen:
                assert n in got[i]
            seen.add(words)


# 2 ------------------------------------------------------------------------------------------------------------


def test_perplexity_keeps_good_text(spark, hard, empty):
    from orderweave.llm.perplexity import trusted_perplexity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in run(spark, "op2_quality_classifier")}
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect()]
    bad = [got[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert np.mean([r.kept for r in good]) > 0.9
    assert np.median([r.perplexity for r in bad]) > np.median([r.perplexity for r in good])
    none = trusted_perplexity(hard, labels.where("false")).collect()
    assert len(none) == hard.count() and not any(r.kept for r in none)
    some = trusted_perplexity(hard, spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert len(some.collect()) == hard.count()
    assert trusted_perplexity(empty, labels).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------


def test_near_copies(spark, documents, hard, hard_rows, empty):
    from orderweave.llm.near_copies import near_copies

    want = brute.near_classes(list(documents.items()))
    got = {r.doc_id: r for r in run(spark, "op3_minhash_near_dedup")}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(brute.shingle_set(documents[i])) and r.kept == (i == want[i]) for i, r in got.items())
    want = brute.near_classes([(r[0], r[1]) for r in hard_rows if r[0] is not None])
    rows = near_copies(hard).collect()
    assert len(rows) == len(hard_rows)
    assert all(r.kept if r.doc_id is None else r.component_id == want[r.doc_id] for r in rows)
    assert near_copies(empty).count() == 0


def test_large_and_chained_groups_of_near_copies(spark):
    from orderweave.llm.near_copies import near_copies

    rows = []
    base = [f"w{i}" for i in range(100)]
    for i in range(300):  # near copies of one text, each with a word of its own
        rows.append((i, " ".join(base[: i % 90] + [f"own{i}"] + base[i % 90 + 1 :])))
    for i in range(40):  # a chain: only neighbours are similar enough
        rows.append((1000 + i, " ".join(f"c{j}" for j in range(8 * i, 8 * i + 100))))
    want = brute.near_classes(rows)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


# 4 ------------------------------------------------------------------------------------------------------------


def packing_holds(pieces, ids_of):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, ids in ids_of.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing(spark, documents, library, hard, hard_rows, empty):
    from orderweave.llm.packing import packed

    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in documents.items()}
    assert packing_holds(run(spark, "op4_packing"), ids) < 4096
    counts = collections.Counter(r[0] for r in hard_rows)
    pieces = packed(hard).collect()
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in hard_rows if counts[r[0]] == 1}
    packing_holds(pieces, ids)
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in hard_rows)
    assert sum(p.length for p in pieces) == total
    assert packed(empty).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------


def test_bpe_is_that_of_the_library(spark, documents, library, hard, hard_rows, empty):
    from orderweave.llm.bpe import decoded, encoded

    got = {r.doc_id: r for r in run(spark, "op5_bpe")}
    for i, text in documents.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    want = collections.Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in hard_rows)
    rows = decoded(encoded(hard)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in rows)
    assert decoded(encoded(empty)).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------

_KINDS = {
    "assign": (r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 12),
    "access": (r"(AKIA[A-Z0-9]+)", re.A, 18),
    "hex": (r"([0-9a-f]+)", re.A, 16),
}


def base_spans(text):
    out = []
    for n, (kind, (pattern, flags, least)) in enumerate(_KINDS.items()):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[1]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets(spark, documents, hard, hard_rows, empty):
    from orderweave.llm.credentials import redacted, secrets

    for r in run(spark, "op6_secret_scans"):
        want = base_spans(documents[r.doc_id])
        joined = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in _KINDS]
    texts = dict((r[0], r[1]) for r in hard_rows if r[0] is not None)
    for r in secrets(hard).where("doc_id is not null").collect():
        assert [tuple(s) for s in r.base] == base_spans(texts[r.doc_id])
    clean = redacted(hard)
    assert clean.columns == hard.columns and clean.count() == len(hard_rows)
    text = clean.where("doc_id = 13").first().text
    assert "Ab12Cd34" not in text and "AKIAIOS" not in text and "0123456789" not in text and text.endswith("password=é short")
    assert clean.where("doc_id = 6").first().text is None
    assert redacted(empty).count() == 0 and secrets(empty).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------


def quality_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            doubled += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), doubled, len(repeated)


def test_quality_rules(spark, documents, hard, hard_rows, empty):
    from orderweave.llm.quality import quality

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def holds(r, text):
        want = quality_counts(text)
        assert tuple(r[n] for n in names) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in run(spark, "op8_quality_rules")}
    for i, r in got.items():
        holds(r, documents[i])
    right = [got[l.doc_id].kept == (l.quality == 1 and not l.toxic) for l in labels.collect() if not got[l.doc_id].base_failed]
    assert np.mean(right) > 0.8
    texts = dict((r[0], r[1]) for r in hard_rows if r[0] is not None)
    for r in quality(hard, labels.where("false")).where("doc_id is not null").collect():
        holds(r, texts[r.doc_id])
        assert r.probability is None and r.kept == (not r.base_failed)
    rows = quality(hard, labels, rows=True)
    assert rows.columns == hard.columns and rows.count() == quality(hard, labels).where("kept").count()
    assert quality(empty, labels).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------


def base_scores(rows):
    rows = [(i, brute.words(t) + [None]) for i, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    counts = collections.Counter(w for (_, ws), h in zip(rows, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    for (i, ws), h in zip(rows, held):
        yield i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)


def test_language_model_scores(spark, documents, hard, hard_rows, empty):
    from orderweave.llm.suffix_tree import suffix_tree_scores

    got = {r.doc_id: r for r in run(spark, "op9_lm_scoring")}
    for i, h, tokens, known, n, base in base_scores(documents.items()):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)
    rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    hard_got = suffix_tree_scores(hard).collect()
    assert len(hard_got) == len(hard_rows)
    want = {i: w for i, *w in base_scores([(r[0], r[1]) for r in hard_rows])}
    for r in hard_got:
        if r.doc_id is not None:
            assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == want[r.doc_id][:4]
            assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    assert suffix_tree_scores(empty).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------


def vector_links(rows):
    by = collections.defaultdict(list)
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by[label].append((i, np.array(v, float)))
    for group in by.values():
        for (i, x), (j, y) in itertools.combinations(group, 2):
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                yield i, j


def test_near_vectors(spark):
    from orderweave.llm.vectors import near_vectors

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    links = list(vector_links(rows))
    ends = collections.Counter(itertools.chain(*links))
    root = brute.classes([r[0] for r in rows], links)
    got = {r.vec_id: r for r in run(spark, "op10_embedding_near_dedup")}
    assert all(got[i].n_links <= ends[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(links)
    assert np.mean([got[i].component_id == root[i] for i in got]) >= 0.99
    size = len(rows[0][1])
    label = rows[0][2]
    odd = [(1, [0.0] * size, label), (2, None, label), (3, [None] + [1.0] * (size - 1), label), (4, [float("nan")] + [1.0] * (size - 1), label)]
    odd += [(i, [1.0] * size, label) for i in (5, 6, 6)] + [(7, [1.0] * size, None), (None, [1.0] * size, label)]
    docs = spark.createDataFrame([(*r, "x") for r in odd], "vec_id long, embedding array<float>, label " + dict(table.dtypes)["label"] + ", node string")
    got = near_vectors(docs).collect()
    assert len(got) == len(odd)
    assert all(r.n_links == 0 for r in got if r.vec_id in (1, 2, 3, 4, 7)) and {r.component_id for r in got if r.vec_id in (5, 6)} == {5}
    assert near_vectors(docs.where("false")).count() == 0


# components ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, monkeypatch, one_task):
    from orderweave.llm.components import components

    monkeypatch.setattr("orderweave.llm.components.ONE_TASK_LINKS", one_task)
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1100)]
    pairs += [(None, 3), (7, 7)]
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute.classes({x for p in real for x in p}, real)


# 6, learned formats ----------------------------------------------------------------------------------------------


def test_learned_spans_against_string_by_string(spark):
    from orderweave.llm import credentials as c

    rng = random.Random(5)

    def token():
        return "".join(rng.choices("ghijk", k=5)) + "-" + "".join(rng.choices("0123456789", k=6)) + "-" + "".join(rng.choices("WXYZ", k=5))

    words = [f"w{i}" for i in range(50)]
    texts = [f"{' '.join(rng.choices(words, k=9))} password={token()} é {token() if i % 40 == 0 else ''} path/to/file-{i}.version2.html" for i in range(120)]
    texts += [token() * 30 + "ZZ", "a1" * 200_000 + " token: abcdefghij1234567", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = c.learn(c.found(docs))

    def margin(s):
        likely = {k: float(a._steps(np.array([[*(c._CLASS_OF[x] for x in s), c._END]], np.int8))[0]) for k, a in (*formats.kinds.items(), ("other", formats.other))}
        best = max(v for k, v in likely.items() if k != "other")
        return (best - max(likely["other"], -(len(s) + 1) * math.log10(69))) / (len(s) + 1)

    learned = 0
    for r in c.secrets(docs).collect():
        text = texts[r.doc_id] or ""
        base = [(s.start, s.end) for s in r.base]
        want = []
        for m in re.finditer("[A-Za-z0-9+/_.=-]{12,}", text, re.A):
            apart = all(m.end() <= s or e <= m.start() for s, e in base)
            if apart and any(x.isdigit() for x in m[0]) and margin(m[0].encode()) >= c.MARGIN:
                want.append((m.start(), m.end()))
        assert [(s.start, s.end) for s in r.spans if s.kind == "learned"] == want
        learned += len(want)
    assert learned


def test_long_candidates_in_bounded_memory():
    import tracemalloc

    from orderweave.llm import credentials as c

    rng = random.Random(1)
    strings = [bytes(rng.choices(b"abcdef0123456789XYZ-_.", k=rng.randrange(12, 60))) for _ in range(10_000)]
    automaton = c.Automaton(strings[:300])
    tracemalloc.start()
    got = automaton.score([*strings, b"a1" * 500_000])
    assert tracemalloc.get_traced_memory()[1] < 100e6 and np.isfinite(got).all()
    tracemalloc.stop()
    assert c._stretches([(5, 9), (0, 3), (3, 4), (6, 7)]) == ([0, 5], [4, 9])
