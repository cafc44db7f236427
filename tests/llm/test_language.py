import zlib

import numpy as np
import pytest

from orderweave.llm import language
from orderweave.llm.language import DIMENSION, languages, predicted, profiles, symbol_signs, text_vectors
from tests.llm.conftest import SF


def signs(symbol):
    bits = np.unpackbits(symbol_signs(np.array([ord(symbol)], np.uint64)).view(np.uint8))
    return 1.0 - 2.0 * bits


def brute_vector(text):
    """Letter by letter, with whole vectors of signs."""
    total = np.zeros(DIMENSION)
    symbols = [c if c.isalpha() else " " for c in (text or "").lower()]
    padded = [" ", *symbols, " "]
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b != " ":
            total += np.roll(signs(a), 128) * np.roll(signs(b), 64) * signs(c)
    return total


TEXTS = ["The cat, the CAT.", None, "", "12 !?", "é ß İ Σας", "日本語 テスト 😀", "a", "aa\nb", "x" * 50 + " yy " * 30]


@pytest.mark.parametrize("limit", [1 << 20, 7, 1])
def test_vectors_against_letter_by_letter(monkeypatch, limit):
    monkeypatch.setattr(language, "SLICE_CHARACTERS", limit)
    monkeypatch.setattr(language, "TEXTS", 2)
    monkeypatch.setattr(language, "GRAMS", 5)
    assert np.array_equal(text_vectors(TEXTS), np.array([brute_vector(t) for t in TEXTS]))


def brute(rows):
    """(doc_id, text, lang) rows to {row number: (held_out, lang_pred, score)}."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    vectors = [brute_vector(t) for _, t, _ in rows]
    known = {}
    for (i, t, lang), h, v in zip(rows, held, vectors):
        if i is not None and not h and t is not None and lang is not None:
            known[lang] = known.get(lang, 0) + v
    out = []
    for h, v in zip(held, vectors):
        if not v.any() or not known:
            out.append((h, "und", 0.0))
            continue
        cosine = {x: float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-300)) for x, p in known.items()}
        best = max(cosine.values())
        out.append((h, min(x for x, c in cosine.items() if c > best - 1e-12), min(1.0, max(0.0, best))))
    return out


def check(spark, rows, schema="doc_id long, text string, lang string"):
    got = sorted(map(tuple, languages(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=repr)
    want = sorted([(r[0], *b) for r, b in zip(rows, brute(rows))], key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-5)


def some_rows():
    rows = [(i, f"the thing and that thing {i * 'th'}", "en") for i in range(1, 9)]
    rows += [(20 + i, f"die der und nicht {i * 'ei'}", "de") for i in range(9)]
    rows += [(40 + i, f"queue le la était {i * 'eau'}", "fr") for i in range(9)]
    return rows + [(60 + i, t, None) for i, t in enumerate(TEXTS)] + [(None, "the thing", "xx"), (3, None, "en"), (3, "die", "en"), (3, "die", "en")]


def test_against_plain_version(spark):
    check(spark, some_rows())


def test_more_languages_than_a_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 1)
    check(spark, some_rows())


def test_nothing_learned_and_empty(spark, hard, empty):
    check(spark, [(i, "some text", None) for i in range(6)])
    assert languages(empty).count() == 0 and languages(empty).columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = languages(hard).collect()
    assert len(got) == hard.count()
    assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {5, 6, 7}


def test_held_out_accuracy_and_no_peeking(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = languages(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    # the language of a row that is held out is not looked at
    blind = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'en', lang) as lang")
    assert sorted(map(tuple, languages(blind).collect())) == sorted(map(tuple, got))


def test_profiles_are_sums_of_whole_numbers(spark):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 4):
        got = {r.lang: np.frombuffer(r.vector) for r in profiles(frame.repartition(parts)).collect()}
        for lang in ("en", "de"):
            assert np.array_equal(got[lang], sum(brute_vector(t) for _, t, x in rows if x == lang))
    assert predicted(frame.selectExpr("doc_id", "false as held_out", "text"), profiles(frame.where("false"))).where("lang_pred <> 'und'").count() == 0
