"""Connected components of links held in a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderweave.session import pin, sql

#: Up to so many links (16 MB) are settled in one task; more go through joins. The result is the same.
ONE_TASK_LINKS = 1_000_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected place of each of n places, for links between places a and b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _settle(batches):
    batches = [b for b in batches if len(b)]
    if batches:
        table = pa.Table.from_batches(batches)
        nodes, place = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        root = roots(len(nodes), place[: len(table)], place[len(table) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), the component being its smallest node.

    A small table of links is settled in one task. A larger one goes through the large-star and small-star steps of the
    MapReduce algorithm (Kiveris et al. 2014) by turns: every node points its larger, then its smaller neighbours at the
    smallest one known. Links only move along tables;
    each round is written to the shared folder, and the number of rounds is logarithmic in practice.
    Links with a null end or to itself say nothing and are left out."""
    edges = pin(
        sql(
            "select distinct greatest(a, b) as u, least(a, b) as v from {links}"
            " where a is not null and b is not null and a <> b",
            links=links,
        ),
        "edges",
    )
    state = _state(edges)
    if state[0] <= ONE_TASK_LINKS:
        return edges.coalesce(1).mapInArrow(_settle, "node long, component long")
    while state[0]:
        # the smallest neighbour of each node is written down first: then both sides of the join below
        # are plain exchanges, and a hub's rows can be split
        both = sql("select u, v from {e} union all select v, u from {e}", e=edges)
        least = pin(sql("select u, least(min(v), u) as m from {both} group by u", both=both), "least")
        large = pin(
            sql("select distinct b.v as u, l.m as v from {both} b join {least} l on b.u = l.u where b.v > b.u", both=both, least=least),
            "large",
        )
        least = pin(sql("select u, min(v) as m from {large} group by u", large=large), "least")
        edges = pin(
            sql(
                """select distinct u, v from (
                     select l.v as u, s.m as v from {large} l join {least} s on l.u = s.u where l.v <> s.m
                     union all select u, m from {least})""",
                large=large,
                least=least,
            ),
            "edges",
        )
        before, state = state, _state(edges)
        if state == before:
            break
    return sql("select u as node, v as component from {e} union all select distinct v, v from {e}", e=edges)


def _state(edges: DataFrame) -> tuple:
    row = sql("select count(*) as n, sum(cast(xxhash64(u, v) as decimal(38, 0))) as s from {e}", e=edges).first()
    return row["n"], row["s"]
