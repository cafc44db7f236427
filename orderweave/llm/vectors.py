"""Near-copies among embeddings: inverted lists, product-quantised residuals, exact cosines for what may be close."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.components import components, roots
from orderweave.session import configure, pin, sql

SIMILARITY = 0.93
#: Distinct vectors that the centroids and codebooks are learned from: smallest hash first.
TRAINING_VECTORS = 20_000
#: Coarse lists: one for so many distinct vectors, within the bounds.
PER_LIST, LEAST_LISTS, MOST_LISTS = 2_000, 8, 1_024
#: Lists that a query visits, nearest first.
PROBES = 8
#: Vectors are cut into so many parts, each coded by the nearest of so many codewords.
PARTS, CODEWORDS = 16, 32
#: Vectors of a list, and queries to it, that meet in one task at a time.
BLOCK = 2_000


def _means(data: np.ndarray, k: int, seed: int, unit: bool) -> np.ndarray:
    """Lloyd's k-means; with ``unit``, centroids are kept on the sphere."""
    k = min(k, len(data))
    centres = data[np.random.default_rng(seed).permutation(len(data))[:k]].copy()
    for _ in range(12):
        nearest = np.argmax(data @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, data)
        n = np.bincount(nearest, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Index:
    """Centroids and codebooks for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _means(sample, lists, 1, True)
        dim = sample.shape[1]
        self.edges = [dim * i // PARTS for i in range(PARTS + 1)]
        rest = sample - self.centres[self.home(sample)]
        self.books = [_means(rest[:, a:b], CODEWORDS, 2 + i, False) for i, (a, b) in enumerate(zip(self.edges, self.edges[1:])) if b > a]
        self.cuts = [(a, b) for a, b in zip(self.edges, self.edges[1:]) if b > a]

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The nearest lists of each vector, its own first."""
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :PROBES]

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector lies from what its code says."""
        rest = x - self.centres[home]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        off = np.zeros(len(x))
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            codes[:, i] = np.argmax(rest[:, a:b] @ book.T - 0.5 * (book**2).sum(1), axis=1)
            off += ((rest[:, a:b] - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(off)


def _units(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _train(lists: int):
    def run(batches):
        batches = [b for b in batches if len(b)]
        if batches:
            import pickle

            sample = _units(pa.Table.from_batches(batches).column("embedding").combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Index(sample, lists))], pa.binary())], ["model"])

    return run


_ROWS = "part string, node long, weight long, embedding array<float>, home int, list int, probes array<int>, codes binary, off double, query boolean"


def _place(models):
    """Each vector once in its own list, and once as a query in every list that it visits."""

    def run(batches):
        import pickle

        index = {d: pickle.loads(m) for d, m in models.value.items()}
        for batch in batches:
            for dim in sorted(set(batch.column("dim").to_pylist())):
                mine = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                x = _units(mine.column("embedding"))
                probes = index[dim].probes(x)
                home = probes[:, 0]
                codes, off = index[dim].code(x, home)
                n, visits = probes.shape
                base = [mine.column(c) for c in ("part", "node", "weight", "embedding")]
                lists = pa.array(probes.tolist(), pa.list_(pa.int32()))
                own = [pa.array(home, pa.int32()), pa.array(home, pa.int32()), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array([False] * n)]
                names = [c.split(" ")[0] for c in _ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([*base, *own], names)
                again = pa.array(np.repeat(np.arange(n), visits))
                asks = [pa.array(np.repeat(home, visits), pa.int32()), pa.array(probes.reshape(-1), pa.int32()), lists.take(again)]
                asks += [pa.nulls(n * visits, pa.binary()), pa.nulls(n * visits, pa.float64()), pa.array([True] * (n * visits))]
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in base], *asks], names)

    return run


_FOUND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def _meet(models, least: float):
    def run(table: pa.Table) -> pa.Table:
        import pickle

        table = table.combine_chunks()
        query = table.column("query").to_numpy()
        if query.all() or not query.any():
            return _FOUND.empty_table()
        sides = [table.filter(pa.array(query)), table.filter(pa.array(~query))]
        node, weight, home = ([s.column(c).to_numpy() for s in sides] for c in ("node", "weight", "home"))
        x, y = (_units(s.column("embedding").combine_chunks()) for s in sides)
        index = pickle.loads(models.value[x.shape[1]])
        here = int(home[1][0])
        codes = np.frombuffer(b"".join(sides[1].column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
        off = sides[1].column("off").to_numpy()
        visits = np.zeros((len(y), len(index.centres)), bool)
        lists = sides[1].column("probes").combine_chunks()
        visits[np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
        a, b = [], []
        for at in range(0, len(x), 256):
            some = x[at : at + 256]
            near = np.repeat((some @ index.centres[here])[:, None], len(y), axis=1)
            for i, ((lo, hi), book) in enumerate(zip(index.cuts, index.books)):
                near += (some[:, lo:hi] @ book.T)[:, codes[:, i]]
            # a unit vector cannot gain more than the code is off, so no link is lost here
            i, j = np.nonzero(near + off >= least - 1e-9)
            # each pair once: in the list of both, or in the lower of two that each would find the other in
            own = home[0][at + i] == here
            once = np.where(own, node[0][at + i] < node[1][j], ~(visits[j, home[0][at + i]] & (home[0][at + i] < here)))
            i, j = i[once], j[once]
            for c in range(0, len(i), 100_000):
                p, q = i[c : c + 100_000], j[c : c + 100_000]
                close = (some[p] * y[q]).sum(1) >= least
                a.append(at + p[close])
                b.append(q[close])
        a, b = np.concatenate(a or [np.empty(0, int)]), np.concatenate(b or [np.empty(0, int)])
        nodes, place = np.unique(np.concatenate(node), return_inverse=True)
        pa_, pb = place[: len(x)][a], place[len(x) :][b]
        n = np.bincount(pa_, weight[1][b], len(nodes)) + np.bincount(pb, weight[0][a], len(nodes))
        root = roots(len(nodes), pa_, pb)
        some = np.flatnonzero(n)
        return pa.Table.from_arrays([pa.array(nodes[some]), pa.array(n[some].astype(np.int64)), pa.array(nodes[root[some]])], schema=_FOUND)

    return run


def near_vectors(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding, label).

    Two vectors of one label and dimension are linked if found with a cosine of ``least`` or more, in double precision. A
    null label or vec_id, and a vector that is null, empty, zero or holds a null or non-finite component, links with nothing (its
    component is itself). Equal vectors are folded first and counted; rows that repeat a vec_id are vectors of their own.

    Every vector is indexed in the list of its nearest centroid as a code of its residual, and asks the PROBES
    nearest lists. Code distances from a table sift the pairs of a block; exact cosines decide. A block reports
    counts, and links enough to connect what it found connected, so a crowd of like vectors makes no crowd of rows."""
    spark = configure(rows.sparkSession)
    rows = pin(
        sql(
            """select cast(vec_id as long) as vec_id, cast(label as string) as label, cast(embedding as array<float>) as embedding,
                 vec_id is not null and label is not null and embedding is not null and size(embedding) > 0
                   and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))
                   and exists(embedding, x -> x <> 0) as usable from {r}""",
            r=rows,
        ).selectExpr("*", "if(coalesce(usable, false), xxhash64(label, embedding), null) as node"),
        "vectors",
    )
    distinct = pin(
        sql(
            """select node, label, embedding, size(embedding) as dim, min(vec_id) as rep, count(*) as weight
               from {r} where node is not null group by node, label, embedding""",
            r=rows,
        ),
        "distinct",
    )
    models = {}
    for dim, n in distinct.groupBy("dim").count().collect():  # dimensions are a property of the data's models: a few
        lists = int(min(MOST_LISTS, max(LEAST_LISTS, n // PER_LIST)))
        sample = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(TRAINING_VECTORS).select("embedding")
        models[dim] = bytes(sample.mapInArrow(_train(lists), "model binary").first()["model"])
    models = spark.sparkContext.broadcast(models)
    placed = distinct.selectExpr("concat(label, ':', dim) as part", "node", "weight", "embedding", "dim").mapInArrow(_place(models), _ROWS)
    placed = pin(placed, "placed")
    # long lists are cut into blocks, and every block of queries meets every block of the list
    sizes = pin(
        sql(
            f"""select part, list, cast(ceil(sum(if(query, 1, 0)) / {BLOCK}) as int) as q_blocks,
                  cast(ceil(sum(if(query, 0, 1)) / {BLOCK}) as int) as i_blocks
                from {{p}} group by part, list""",
            p=placed,
        ),
        "sizes",
    )
    blocks = sql(
        """select p.*, if(query, pmod(xxhash64(node), q_blocks), other) as q_block, if(query, other, pmod(xxhash64(node), i_blocks)) as i_block
           from (select p.*, s.q_blocks, s.i_blocks, explode(sequence(0, if(p.query, s.i_blocks, s.q_blocks) - 1)) as other
                 from {p} p join {s} s on p.part = s.part and p.list = s.list where s.q_blocks > 0 and s.i_blocks > 0) p""",
        p=placed,
        s=sizes,
    )
    found = pin(blocks.groupBy("part", "list", "q_block", "i_block").applyInArrow(_meet(models, least), "node long, n long, other long"), "found")
    counts = pin(sql("select node, sum(n) as n from {f} group by node", f=found), "counts")
    parts = pin(components(found.selectExpr("node as a", "other as b")), "parts")
    reps = pin(sql("select p.component as part, min(d.rep) as component from {d} d join {p} p on d.node = p.node group by p.component", d=distinct, p=parts), "reps")
    known = pin(
        sql(
            """select d.node, coalesce(r.component, d.rep) as component, coalesce(c.n, 0) + d.weight - 1 as n
               from {d} d left join {c} c on d.node = c.node left join {p} p on d.node = p.node left join {r} r on p.component = r.part""",
            d=distinct,
            c=counts,
            p=parts,
            r=reps,
        ),
        "known",
    )
    return sql(
        """select r.vec_id, coalesce(k.n, 0L) as n_links, coalesce(k.component, r.vec_id) as component_id,
             r.vec_id is null or r.vec_id = coalesce(k.component, r.vec_id) as kept
           from {r} r left join {k} k on r.node = k.node""",
        r=rows,
        k=known,
    )
