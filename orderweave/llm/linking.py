"""Links between rows that share a bucket, found without pairing up the members of a large group."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderweave.llm.components import components
from orderweave.session import pin, sql


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written down, instead of when the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def linked_groups(
    nodes: DataFrame,
    payload: list[str],
    likely: Callable[[str, str], str],
    texts: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame],
    light: str | None = None,
) -> DataFrame:
    """(node, component) of the nodes that have a link; ``nodes`` has a unique ``node``, ``keys`` and the ``payload``.

    Two nodes are candidates if they share a key (keys differ between bands) and ``likely(x, y)``, SQL on the payload of
    two aliases, holds. ``texts`` gives (node, text) for a table of nodes; ``confirm`` turns rows (a, b, text_a, text_b)
    into the links (a, b) among them.

    In each bucket three leaders are compared with every member. Then, by components, members that are still apart
    are compared among themselves. So a group whose members hang together costs a few passes over its members,
    and no pair of a bucket is left out unless both ends are known to be connected.

    With ``light``, for a small payload and many keys, the keys that occur once go before anything else is carried along, and
    the payload of members and leaders comes with them, so that pairs are sifted where they arise. ``keys`` then hold codes,
    and ``light`` is the SQL that makes a key of ``band``, ``code`` and the payload."""
    if light:
        members = nodes.selectExpr("node", *payload, "posexplode(keys) as (band, code)").selectExpr("node", f"{light} as key")
    else:
        members = nodes.selectExpr("node", "posexplode(keys) as (band, key)")
    leaders = ["min(node) as lo", "max(node) as hi", "min_by(node, xxhash64(node)) as mid"]
    if light:
        found = sql("select key, node from (select key, node, count(*) over (partition by key) as n from {m}) where n > 1", m=members)
        found = pin(sql(f"select f.*, {', '.join(payload)} from {{f}} f join {{n}} n on f.node = n.node", f=found, n=nodes), "members")
        for c in payload:
            leaders += [f"min_by({c}, node) as lo_{c}", f"max_by({c}, node) as hi_{c}", f"min_by({c}, xxhash64(node)) as mid_{c}"]
        buckets = pin(sql(f"select key, count(*) as n, {', '.join(leaders)} from {{f}} group by key", f=found), "buckets")
        led = sql("select f.*, b.* except (key) from {f} f join {b} b on f.key = b.key", f=found, b=buckets)
        three = ", ".join(f"named_struct('node', {x}{''.join(f', {c!r}, {x}_{c}' for c in payload)})" for x in ("lo", "hi", "mid"))
        pairs = sql(
            f"""select distinct least(x.node, y.node) as a, greatest(x.node, y.node) as b
                from (select explode(array({three})) as x, struct({", ".join(["node", *payload])}) as y from {{c}})
                where x.node <> y.node and {likely("x", "y")}""",
            c=led,
        )
        crowd = sql("select f.key, 0 as band, f.node, b.lo, b.hi, b.mid from {f} f join {b} b on f.key = b.key where b.n > 3", f=found, b=buckets)
    else:
        buckets = pin(sql(f"select key, count(*) as n, {', '.join(leaders)} from {{m}} group by key having count(*) > 1", m=members), "buckets")
        large = sql("select key, lo, hi, mid from {b} where n > 2", b=buckets)
        crowd = pin(sql("select m.*, l.lo, l.hi, l.mid from {m} m join {l} l on m.key = l.key", m=members, l=large), "crowd")
        pairs = sql(
            """select distinct least(a, b) as a, greatest(a, b) as b from (
                 select lo as a, hi as b from {b} where n = 2
                 union all select explode(array(lo, hi, mid)), node from {c}) where a <> b""",
            b=buckets,
            c=crowd,
        )
        pairs = sql(
            f"""select p.a, p.b from {{pairs}} p join {{nodes}} x on p.a = x.node join {{nodes}} y on p.b = y.node
                where {likely("x", "y")}""",
            pairs=pairs,
            nodes=nodes,
        )
    pairs = pin(pairs, "pairs")
    if light:
        drop_shuffles(nodes.sparkSession)

    wanted = sql("select explode(array(a, b)) as node from {p}", p=pairs)
    if light:
        # those that may be compared later are fetched along with the first, so that texts are gone through once
        wanted = wanted.unionByName(crowd.where("node not in (lo, hi, mid)").select("node"))
    first = pin(texts(wanted.distinct()), "texts")

    def confirmed(pairs: DataFrame, found: DataFrame) -> DataFrame:
        both = sql(
            """select p.a, p.b, x.text as text_a, y.text as text_b
               from {p} p join {t} x on p.a = x.node join {t} y on p.b = y.node""",
            p=pairs,
            t=found,
        )
        return pin(confirm(both), "links")

    links = confirmed(pairs, first)
    if light:
        drop_shuffles(nodes.sparkSession)
    parts = pin(components(links), "parts")

    placed = sql("select c.key, c.band, c.node, c.lo, c.hi, c.mid, coalesce(p.component, c.node) as part from {c} c left join {p} p on c.node = p.node", c=crowd, p=parts)
    placed = pin(placed, "placed")
    split = pin(sql("select key from {p} group by key having min(part) <> max(part)", p=placed), "split")
    columns = ", ".join(f"r.{c}" for c in payload)
    apart = pin(
        sql(
            f"""select p.key, p.band, p.part, r.node, r.keys, {columns}
                from {{p}} p left semi join {{s}} s on p.key = s.key join {{r}} r on p.node = r.node
                where p.node not in (p.lo, p.hi, p.mid)""",
            p=placed,
            s=split,
            r=nodes,
        ),
        "apart",
    )
    # a pair comes from the first bucket that it shares; with many keys it is cheaper to take it once afterwards
    again = "" if light else " and not arrays_overlap(slice(a.keys, 1, a.band), slice(b.keys, 1, b.band))"
    rest = pin(
        sql(
            f"""select {"distinct" if light else ""} a.node as a, b.node as b from {{apart}} a join {{apart}} b
                on a.key = b.key and a.part <> b.part and a.node < b.node and {likely("a", "b")}{again}""",
            apart=apart,
        ),
        "pairs",
    )
    if not rest.isEmpty():
        texts_again = first if light else pin(texts(sql("select distinct explode(array(a, b)) as node from {p}", p=rest)), "texts")
        more = confirmed(rest, texts_again)
        if not more.isEmpty():
            parts = pin(components(links.unionByName(more)), "parts")
    return parts
