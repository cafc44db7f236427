import hashlib
import random
import zlib

import pytest

from orderweave.llm.merkle import folded, manifest, verified
from tests.llm.conftest import SCHEMA, SF


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """(root, [(siblings, fold)] of each leaf): plain recursion over whole levels."""
    proofs = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            proofs[i].append(("".join(digests[run:place]), "".join(digests[place + 1 : run + 3])))
            at[i] = place // 3
        digests = [h(*digests[i : i + 3]) for i in range(0, len(digests), 3)]
    return digests[0], proofs


def brute(rows):
    """The contract's columns of every row, sorted."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    root, tops = tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops):
        for (_, _, own, r), proof in zip(by[s], trees[s][1]):
            proof = proof + top
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold = leaf(r, text)
            for before, after in proof:
                fold = h(before, fold, after)
            out.append((r["doc_id"], own, trees[s][0], root, h(*[x for p in proof for x in p]), fold, fold == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(docs, levels):
    got = verified(docs, levels)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_trees_of_every_shape(spark, levels):
    rng = random.Random(levels)
    # sources of 1 to 41 rows: every way in which the last run, block and subtree can be short
    rows = [(100 * n + i, rng.choice(["a\nb", "ab", "", None]), "en", None if n == 5 else f"s{n}é", n) for n in [*range(1, 30), 41] for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), levels)


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 28, 82, 200])
def test_one_source(spark, rows):
    check(spark.range(rows).selectExpr("id as doc_id", "'x\\ny' as text", "'en' as lang", "'s' as source", "3L as n_chars"), 1)


def test_hard_rows(hard):
    check(hard, 1)


def test_empty_table(empty):
    got = verified(empty)
    assert got.columns == COLUMNS and got.count() == 0


def test_whole_table_and_hot_source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, 7)
    check(docs.selectExpr("doc_id", "text", "lang", "if(doc_id % 20 = 0, source, 'hot') as source", "n_chars"), 2)


def test_proofs_fold_to_the_root_and_any_change_is_seen(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1, None, None, None, None, None) for i in range(50)], SCHEMA)
    rows = manifest(docs, levels=1)
    assert rows.where(f"{folded('leaf', 'proof')} <> root").count() == 0
    root = rows.first()["root"]
    for change in ("'de' as lang", "'t' as source", "2L as n_chars", "concat(text, ' ') as text", "doc_id + 50 as doc_id"):
        name = change.split()[-1]
        other = docs.selectExpr(*[f"if(doc_id = 17, {change.rsplit(' as ')[0]}, {c}) as {c}" if c == name else c for c in docs.columns])
        assert manifest(other, levels=1).first()["root"] != root
