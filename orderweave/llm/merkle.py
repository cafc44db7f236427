"""Merkle manifest of a table: a tree of digests for each source, a tree of those, and a proof for every row.

Leaves are cut into aligned blocks of FANOUT ** BLOCK_LEVELS. A block climbs to its own root alone. Then the blocks of a tree
meet in a butterfly: in round r, blocks whose number differs in digit r only (base FANOUT) swap the roots of their
subtrees, and each hashes the common ancestor for itself. When the rounds are over every block knows the root of its tree
and the siblings on the way there, so nothing is sent down again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.operators.scan import Chunks, attach
from orderweave.session import configure, pin, sql

FANOUT = 3
#: A block holds FANOUT ** BLOCK_LEVELS = 2187 leaves in one row (about half a megabyte).
BLOCK_LEVELS = 7
#: Fields that a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_POWERS = "array(" + ", ".join(f"{FANOUT**k}L" for k in range(40)) + ")"
_NO_PROOF = "cast(array() as array<struct<before: string, after: string>>)"


def leaf_of(fields: dict[str, str] | tuple[str, ...] = FIELDS) -> str:
    """SQL of a leaf: SHA-256 over the fields, each as byte count, colon and value, or a dash if null."""
    texts = [f"cast({e} as string)" for e in (fields.values() if isinstance(fields, dict) else fields)]
    parts = ", ".join(f"coalesce(concat(octet_length({t}), ':', {t}), '-')" for t in texts)
    return f"sha2(concat({parts}), 256)"


def folded(leaf: str, proof: str) -> str:
    """SQL of the root that a leaf and the siblings of a proof lead to."""
    return f"aggregate({proof}, {leaf}, (digest, level) -> sha2(concat(level.before, digest, level.after), 256))"


def siblings(proof: str) -> str:
    """SQL of all siblings of a proof in one text, level by level, left to right."""
    return f"array_join(transform({proof}, level -> concat(level.before, level.after)), '')"


def _same(keys: list[str], *more: str) -> str:
    return " and ".join([f"a.{k} <=> b.{k}" for k in keys] + [f"a.{k} = b.{k}" for k in more])


def _climbed(leaves: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """One row per block of ``leaves`` (keys, pos, n, leaf, and what else): its rows in order, and ``tiers``, the levels of
    its subtree from the leaves to the block's root. A tree of one block ends at its root, others climb all levels."""
    key = ", ".join(keys)
    rest = ", ".join(c for c in leaves.columns if c not in (*keys, "pos", "n"))
    above = f"""transform(sequence(0, (size(tier) - 1) div {FANOUT}),
        i -> sha2(array_join(slice(tier, cast({FANOUT} * i + 1 as int), {FANOUT}), ''), 256))"""
    return sql(
        f"""
        with grouped as (
          select {key}, pos div {FANOUT**levels} as block, max(n) as n, array_sort(collect_list(struct(pos, {rest}))) as rows
          from {{leaves}} group by {key}, pos div {FANOUT**levels}
        )
        select *, aggregate(
            slice(sequence(1, {levels}), 1, least({levels}, size(filter({_POWERS}, p -> p < n)))),
            array(transform(rows, r -> r.leaf)),
            (tiers, k) -> concat(tiers, transform(array(element_at(tiers, -1)), tier -> {above}))) as tiers
        from grouped
        """,
        leaves=leaves,
    )


def _round(state: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One exchange among subtrees of ``width`` blocks each.

    The last subtree of a tree may have fewer blocks than its siblings; each of them then also answers the blocks
    of the siblings for which its subtree has no counterpart."""
    key = ", ".join(keys)
    return sql(
        f"""
        with numbered as (
          select *, block div {FANOUT * width} as parent, cast(block div {width} % {FANOUT} as int) as digit,
            block % {width} as low, least({width}, n_blocks - (block - block % {width})) as blocks
          from {{state}}
        ), sent as (
          select *, explode(if(digit > 0 and blocks < {width}, sequence(low, {width - 1}L, blocks), array(low))) as reaches
          from numbered
        ), met as (
          select {key}, max(n_blocks) as n_blocks, array_sort(collect_list(struct(digit, root,
              if(reaches = low, block, null) as block, if(reaches = low, proof, null) as proof))) as members
          from sent group by {key}, parent, reaches
        ), owners as (
          select *, explode(filter(members, m -> m.block is not null)) as own from met
        )
        select {key}, own.block as block, n_blocks, sha2(array_join(members.root, ''), 256) as root,
          concat(own.proof, array(struct(
            array_join(filter(members, m -> m.digit < own.digit).root, '') as before,
            array_join(filter(members, m -> m.digit > own.digit).root, '') as after))) as proof
        from owners
        """,
        state=state,
    )


def _butterfly(blocks: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, block, n_blocks, root, proof) of every block: the root of its tree, and the siblings above the block."""
    state = sql(
        f"""select {", ".join(keys)}, block, (n - 1) div {FANOUT**levels} + 1 as n_blocks, element_at(tiers, -1)[0] as root,
              {_NO_PROOF} as proof from {{blocks}}""",
        blocks=blocks,
    )
    most = state.selectExpr("max(n_blocks) as most").first()["most"] or 0
    done, width = [], 1
    while width < most:  # as many rounds as digits in the number of blocks
        done.append(state.where(f"n_blocks <= {width}"))
        state = pin(_round(state.where(f"n_blocks > {width}"), keys, width), "round")
        width *= FANOUT
    for settled in done:
        state = state.unionByName(settled)
    return pin(state, "roots")


def _placed(leaves: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Leaves with their position in their tree and the tree's size."""
    chunks = Chunks(leaves, keys, order, "leaves")
    return chunks.scan(sums={"pos_": "1L"}, totals={"n": "1L"}).selectExpr(*leaves.columns, "pos_ - 1 as pos", "n")


_OWN_PROOF = f"""transform(slice(sequence(0, 39), 1, size(a.tiers) - 1), k -> struct(
    array_join(slice(get(a.tiers, k), cast(i div get({_POWERS}, k) - i div get({_POWERS}, k) % {FANOUT} + 1 as int),
      cast(i div get({_POWERS}, k) % {FANOUT} as int)), '') as before,
    array_join(slice(get(a.tiers, k), cast(i div get({_POWERS}, k) + 2 as int),
      cast({FANOUT - 1} - i div get({_POWERS}, k) % {FANOUT} as int)), '') as after))"""


def _proven(blocks: DataFrame, state: DataFrame, keys: list[str], columns: list[str], roots: list[str]) -> DataFrame:
    """A row per leaf: its columns, the ``roots`` known to its block, and its proof."""
    own = ", ".join(f"r.{c} as {c}" for c in columns)
    return sql(
        f"""select {", ".join(f"a.{k}" for k in keys)}, {", ".join(f"b.{r}" for r in roots)},
              inline(transform(a.rows, (r, i) -> struct({own}, concat({_OWN_PROOF}, b.proof) as proof)))
            from {{a}} a join {{b}} b on {_same(keys, "block")}""",
        a=blocks,
        b=state,
    )


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, carry: dict[str, str] | None = None, levels: int = BLOCK_LEVELS
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, leaf, subroot, root, proof (array of (before, after), from the leaf up), and
    what ``carry`` names (SQL over a row of ``docs``).

    H is SHA-256 in lower-case hex. Leaves cover ``fields``, a null being told from an empty text. Per source, leaves ascend by
    doc_id (null first, equal ones by leaf; rows that are equal throughout are leaves of their own); runs of three
    become their H while several nodes remain. The subroots, ordered by source (null first, bytewise), give the root alike.
    A lone leaf is its subroot, and a lone subroot the root. ``folded`` of a leaf and its proof gives the root. An empty
    table gives no rows. Columns other than the fields are read only if ``carry`` does; texts are hashed where they
    are read and never shuffled. ``levels`` sets the size of a block, not the result."""
    configure(docs.sparkSession)
    carry = carry or {}
    leaves = docs.selectExpr("doc_id", "source", f"{leaf_of(fields)} as leaf", *[f"{e} as {n}" for n, e in carry.items()])
    columns = ["doc_id", "leaf", *carry]
    blocks = pin(_climbed(_placed(leaves, ["source"], ["doc_id", "leaf"]), ["source"], levels), "blocks")
    state = _butterfly(blocks, ["source"], levels)

    # the tree of the subroots, built in the same way
    subroots = state.where("block = 0").selectExpr("0 as tree", "source", "root as leaf", "n_blocks")
    tops = pin(_climbed(_placed(subroots, ["tree"], ["source"]), ["tree"], levels), "tops")
    crown = _proven(tops, _butterfly(tops, ["tree"], levels), ["tree"], ["source", "n_blocks", "leaf"], ["root"])
    crown = crown.selectExpr("source", "n_blocks", "root as top", "proof as rest")
    state = state.withColumnRenamed("root", "subroot")
    state = attach(state, crown, ["source"], ["top", "rest"], "block", rows="n_blocks")
    state = state.selectExpr("source", "block", "subroot", "top as root", "concat(proof, rest) as proof")
    return _proven(blocks, state, ["source"], columns, ["subroot", "root"])


def verified(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (see ``manifest``).

    Where 2 divides crc32 of doc_id in decimal, newlines are taken out of the text before the row is checked against
    the original manifest, so rows that had one fail. A null doc_id is never tampered with."""
    struck = {f: "replace(text, '\\n', '')" if f == "text" else f for f in FIELDS}
    tampered = f"if(crc32(cast(doc_id as string)) % 2 = 0 and contains(text, '\\n'), {leaf_of(struck)}, null)"
    rows = manifest(docs, carry={"tampered": tampered}, levels=levels)
    return rows.selectExpr(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        f"sha2({siblings('proof')}, 256) as proof_sha256",
        f"{folded('coalesce(tampered, leaf)', 'proof')} as folded_root",
    ).selectExpr("*", "folded_root = root as verified")


#: The same in DuckDB: both trees level by level, then every proof folded level by level.
ORACLE = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text,
    concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head,
    -- crc32: a byte is taken in, then eight shifts
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 2 = 0 AS struck
  FROM documents
), leaves AS (
  SELECT rid, doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    CASE WHEN struck THEN sha256(concat(head, coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-'))) END AS tampered
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY source, pos // 3
), subroots AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place AS pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY pos // 3
), steps AS (
  SELECT p.rid, n.level AS step, string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.pos // CAST(pow(3, n.level) AS BIGINT)) AS before,
    string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.pos // CAST(pow(3, n.level) AS BIGINT)) AS after
  FROM placed p JOIN nodes n ON n.source IS NOT DISTINCT FROM p.source AND n.n > 1 AND n.pos // 3 = p.pos // CAST(pow(3, n.level + 1) AS BIGINT)
  GROUP BY p.rid, n.level
  UNION ALL
  SELECT p.rid, s.height + t.level, string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos < s.place // CAST(pow(3, t.level) AS BIGINT)),
    string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos > s.place // CAST(pow(3, t.level) AS BIGINT))
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
    JOIN tops t ON t.n > 1 AND t.pos // 3 = s.place // CAST(pow(3, t.level + 1) AS BIGINT)
  GROUP BY p.rid, s.height, t.level
), proofs AS (
  SELECT rid, sha256(string_agg(concat(before, after), '' ORDER BY step)) AS proof FROM steps GROUP BY rid
), folds AS (
  SELECT rid, 0 AS step, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(concat(s.before, f.digest, s.after)) FROM folds f JOIN steps s ON s.rid = f.rid AND s.step = f.step
), ends AS (
  SELECT rid, arg_max(digest, step) AS folded_root FROM folds GROUP BY rid
)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, coalesce(f.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN tops t ON t.n = 1 JOIN ends e ON e.rid = p.rid
  LEFT JOIN proofs f ON f.rid = p.rid
"""
