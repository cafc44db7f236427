"""Near-copies of whole documents: MinHash bands for candidates, odd sketches to sift them, exact sets to confirm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.linking import linked_groups
from orderweave.llm.words import Words, mix, pieces, signed
from orderweave.session import configure, pin, sql

SHINGLE = 5
#: 20 bands of 3 samples: a pair of similarity 0.75 shares none with a chance of (1 - 0.75**3)**20 = 2e-5.
BANDS, ROWS = 20, 3
#: Bits of a sketch. Two sets of similarity 0.75 differ in 30 of 60 samples on average.
SKETCH = 256
#: Candidates whose sketches tell less similarity than this are left out; 0.75 is more than four deviations away.
SIFT = 0.5

_RNG = np.random.default_rng(7)
_TIMES = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_SKETCH_COLUMNS = [f"s{i}" for i in range(SKETCH // 64)]
#: Bits of the parity bitmap of a whole set.
FULL = 2048
_FULL_COLUMNS = [f"p{i}" for i in range(FULL // 64)]
_BITMAPS = [*_SKETCH_COLUMNS, *_FULL_COLUMNS]
_SCHEMA = "doc_id long, mark binary, n_shingles long, f1 long, f2 long, bands array<long>, "
_SCHEMA += ", ".join(f"{c} long" for c in [*_SKETCH_COLUMNS, *_FULL_COLUMNS])


def _sketches(batches):
    """Per document: set size, a 128-bit fingerprint of the set, band keys, odd sketches of its samples and of the set."""
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = Words(part.column("text")).shingle_sets(SHINGLE)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            bits = np.zeros((len(sets), SKETCH), np.uint8)
            whole = np.zeros((len(sets), FULL), np.uint8)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                at = np.cumsum(sizes[full]) - sizes[full]
                f1[full] = np.add.reduceat(mix(values), at)
                f2[full] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x5851F42D4C957F2D)), at)
                place = np.repeat(full * FULL, sizes[full]) + (mix(values) >> np.uint64(64 - FULL.bit_length() + 1)).astype(np.int64)
                whole = (np.bincount(place, minlength=len(sets) * FULL) & 1).astype(np.uint8).reshape(len(sets), FULL)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for j in range(b * ROWS, (b + 1) * ROWS):
                        low = np.minimum.reduceat(values * _TIMES[j] + _PLUS[j], at)
                        key = mix(key ^ low)
                        bits[full, mix(low + np.uint64(j)) % np.uint64(SKETCH)] ^= 1
                    bands[full, b] = key
            words = np.packbits(np.concatenate((bits, whole), axis=1), axis=1).view(np.int64)
            flat_bands = pa.array(signed(bands.reshape(-1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat_bands)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array(sizes, pa.int64()), pa.array(signed(f1)), pa.array(signed(f2)), lists]
                + [pa.array(words[:, i].copy()) for i in range(words.shape[1])],
                ["doc_id", "mark", "n_shingles", "f1", "f2", "bands", *_SKETCH_COLUMNS, *_FULL_COLUMNS],
            )


def _fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    return signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64))


def _confirmed(percent: int):
    def confirm(batches):
        for batch in batches:
            for part in pieces(batch, "text_a"):
                left = Words(part.column("text_a")).shingle_sets(SHINGLE)
                right = Words(part.column("text_b")).shingle_sets(SHINGLE)
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - both
                # where a doc_id has several texts, only those meant count
                meant = (_fingerprint(left) == part.column("a").to_numpy()) & (_fingerprint(right) == part.column("b").to_numpy())
                ok = pa.array(meant & (union > 0) & (100 * both >= percent * union))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(ok)

    return confirm


def _likely(x: str, y: str, percent: int) -> str:
    """SQL: two rows may be linked, by their odd sketches.

    Of the sketched samples, with z bits different about -n/2 ln(1 - 2z/n) samples differ, each unlike pair of k giving
    two: pairs with an estimate under SIFT go. In the bitmaps of the whole sets no more bits differ than shingles do, and a
    link allows only (100 - percent) / (100 + percent) of both sizes together; so this test loses no link at all."""
    z = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _SKETCH_COLUMNS)
    whole = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _FULL_COLUMNS)
    k = BANDS * ROWS
    most = (1 - np.exp(-4 * k * (1 - SIFT) / SKETCH)) * SKETCH / 2
    both = f"({x}.n_shingles + {y}.n_shingles)"
    sizes = f"100 * least({x}.n_shingles, {y}.n_shingles) >= {percent} * greatest({x}.n_shingles, {y}.n_shingles)"
    return f"{sizes} and ({z}) <= {most:.4f} and {100 + percent} * ({whole}) <= {100 - percent} * {both}"


#: SQL of the fingerprint that tells apart the texts of one doc_id.
MARK = "unhex(md5(text))"


def near_copies(docs: DataFrame, percent: int = 75, marked: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are not read).

    Rows are linked if 100 * shared >= ``percent`` * all of their distinct 5-word shingles (A-Z lower-cased; fewer
    words are one shingle). Null, empty and blank texts have no shingles and no links. A row with a null doc_id is linked
    with nothing and kept. Rows that repeat a doc_id are each dealt with by their own text.

    Equal sets are folded first, known by a 64-bit fingerprint. The rest share the keys of MinHash bands; candidates whose
    odd sketches are too different go, and the others are confirmed on full shingle sets (see ``linked_groups``).

    With ``marked`` there are two columns more: ``mark``, the fingerprint of the row's text, and ``class``, which the rows of
    one group share and no other has (component_id may be that of two groups if a doc_id repeats), null without links."""
    configure(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    rows = docs.selectExpr("*", f"{MARK if marked else 'cast(null as binary)'} as mark")
    rows = pin(rows.mapInArrow(_sketches, _SCHEMA).selectExpr("*", "monotonically_increasing_id() as row"), "sketches")
    sets = pin(
        sql(
            """select f1, f2, min(doc_id) as rep, min_by(row, doc_id) as row from {r}
               where n_shingles > 0 and doc_id is not null group by f1, f2""",
            r=rows,
        ),
        "sets",
    )
    nodes = pin(
        sql(
            f"""select s.f1 as node, r.doc_id, r.n_shingles, r.bands as keys, {", ".join(_BITMAPS)}
                from {{rows}} r join {{sets}} s on r.row = s.row""",
            rows=rows,
            sets=sets,
        ),
        "nodes",
    )

    def texts(wanted: DataFrame) -> DataFrame:
        owners = sql("select w.node, n.doc_id from {w} w join {n} n on w.node = n.node", w=wanted, n=nodes)
        return sql("select o.node, d.text from {d} d join {o} o on d.doc_id = o.doc_id", d=docs, o=owners)

    parts = linked_groups(
        nodes,
        ["n_shingles", *_BITMAPS],
        lambda x, y: _likely(x, y, percent),
        texts,
        lambda pairs: pairs.mapInArrow(_confirmed(percent), "a long, b long"),
    )
    least = sql("select p.component as part, min(s.rep) as component from {s} s join {p} p on s.f1 = p.node group by p.component", s=sets, p=parts)
    least = pin(least, "least")
    classes = pin(sql("select p.node, p.component as class, l.component from {p} p join {l} l on p.component = l.part", p=parts, l=least), "classes")
    extra = ", r.mark, coalesce(c.class, s.f1) as class" if marked else ""
    return sql(
        f"""select r.doc_id, r.n_shingles, coalesce(c.component, s.rep, r.doc_id) as component_id,
             r.doc_id is null or r.doc_id = coalesce(c.component, s.rep, r.doc_id) as kept{extra}
           from {{rows}} r
           left join {{sets}} s on r.f1 = s.f1 and r.f2 = s.f2 and r.n_shingles > 0 and r.doc_id is not null
           left join {{classes}} c on s.f1 = c.node""",
        rows=rows,
        sets=sets,
        classes=classes,
    )


def without_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, and others), one of each group of near-copies: the first by (doc_id, fingerprint of
    the text). Of rows equal in both one stays. Rows with a null doc_id, and texts without a word, stay."""
    found = pin(near_copies(docs, percent, marked=True).where("class is not null").select("doc_id", "mark", "class"), "found")
    firsts = sql("select class, min(struct(doc_id, mark)) as first from {f} group by class", f=found)
    texts = sql("select class, doc_id, mark, count(*) as n from {f} group by class, doc_id, mark", f=found)
    # a document goes, or stays once; the others, most of all, are not listed
    verdicts = pin(
        sql(
            """select t.doc_id, t.mark, t.doc_id <> f.first.doc_id or t.mark <> f.first.mark as gone
               from {t} t join {f} f on t.class = f.class
               where t.doc_id <> f.first.doc_id or t.mark <> f.first.mark or t.n > 1""",
            t=texts,
            f=firsts,
        ),
        "verdicts",
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.expr("cast(doc_id as long) as doc_id"), F.expr(f"{MARK} as mark"))
    judged = sql("select d.*, v.gone from {d} d left join {v} v on d.doc_id = v.doc_id and d.mark = v.mark where not coalesce(v.gone, false)", d=rows, v=verdicts)
    single = judged.where("gone is null").select("row")
    once = judged.where("gone is not null").groupBy("doc_id", "mark").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(once).select("row.*")
