"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from orderweave.llm import merkle
from orderweave.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# every pair of documents that share a shingle, counted, then all that can be reached
_NEAR_COPIES = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM split, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least_reached AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_reached USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

# all pairs of a label in double precision
_NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least_reached AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least_reached USING (vec_id)
"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": _NEAR_COPIES,
    "op10_embedding_near_dedup": _NEAR_VECTORS,
    "op11_merkle_manifest": merkle.ORACLE,
}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op3_minhash_near_dedup(spark, sf_dir):
    from orderweave.llm.near_copies import near_copies

    return near_copies(documents(spark, sf_dir))


@query
def op4_packing(spark, sf_dir):
    from orderweave.llm.packing import packed

    return packed(documents(spark, sf_dir))


@query
def op5_bpe(spark, sf_dir):
    from orderweave.llm.bpe import decoded, encoded

    return decoded(encoded(documents(spark, sf_dir))).selectExpr(
        "doc_id",
        "cast(size(ids) as long) as n_tokens",
        "sha2(concat_ws(' ', cast(ids as array<string>)), 256) as ids_sha256",
        "sha2(decoded, 256) as decoded_sha256",
    )


@query
def op8_quality_rules(spark, sf_dir):
    from orderweave.llm.quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_secret_scans(spark, sf_dir):
    from orderweave.llm.credentials import secrets

    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return secrets(documents(spark, sf_dir)).selectExpr(
        "doc_id",
        *[f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}" for k in ("assign", "access", "hex")],
        f"sha2({joined.format('base')}, 256) as base_sha256",
        f"{joined.format('spans')} as spans",
    )


@query
def op1_line_dedup(spark, sf_dir):
    from orderweave.llm.fuzzy_lines import repeated_lines

    return repeated_lines(documents(spark, sf_dir)).selectExpr(
        "doc_id", "n_worded", "cast(size(dropped) as long) as n_dropped", "array_join(transform(dropped, x -> cast(x as string)), ',') as dropped"
    )


@query
def op9_lm_scoring(spark, sf_dir):
    from orderweave.llm.suffix_tree import suffix_tree_scores

    return suffix_tree_scores(documents(spark, sf_dir))


@query
def op10_embedding_near_dedup(spark, sf_dir):
    from orderweave.llm.vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op7_substring_dedup(spark, sf_dir):
    from orderweave.llm.passages import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


@query
def op2_quality_classifier(spark, sf_dir):
    from orderweave.llm.perplexity import trusted_perplexity

    return trusted_perplexity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.verified(documents(spark, sf_dir))


@query
def op12_embedding_whitening(spark, sf_dir):
    from orderweave.llm.whitening import whitened

    # a deviation that a long cannot hold is null
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).selectExpr("* except (deviation)", "try_cast(deviation as long) as deviation")


@query
def op13_language_id(spark, sf_dir):
    from orderweave.llm.language import languages

    return languages(documents(spark, sf_dir))
