"""Queries ``op<N>_<name>`` over the standard tables, one for each operator here.

A query reads its whole table, applies its operator with production parameters and derives
the columns that its contract names. ``ORACLES`` has DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, lexical_search, license_scan, line_dedup, preference
from .bpe import encode_decode
from .fingerprint import compare_with_next
from .embedding_neardup import near_vectors
from .ngram_join import similar_groups
from .packing import pack
from .quality import classify, train
from .suffix_dedup import dedup_passages
from .url_filter import filter_urls, parse_rules


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, length=100, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "text_score", "meta_score", "score", "accepted")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.turns_of(_table(spark, sf_dir, "conversations"))
    new, swapped = preference.swapped_answers(turns)
    return preference.format_preferences(turns.unionByName(new), preference.pair_by_opening(turns).unionByName(swapped))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: The production rules.
BLOCK = ["com/en/", "example.net/de/8", "org/es/"]
ALLOW = ["example.com/en/7", "net/de/"]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parse_rules("block", BLOCK) + parse_rules("allow", ALLOW)
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1, with_ids=False, remembered=500_000).drop("ids")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical_search.rank(docs, items, k=50)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_chars=20, min_docs=3, keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_fingerprint": op5_fingerprint,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_preference": op9_preference,
    "op10_bpe": op10_bpe,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
}

#: All pairs; for tables of the test's size.
_VECTORS = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
_GROUPS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1), lambda k: array_to_string(words[k:k + 3], ' '))) AS items FROM w),
x AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (item) WHERE a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(items) AS n_shingles, component_id FROM s JOIN c USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op2_embedding_neardup": _VECTORS,
    "op6_ngram_join": _GROUPS,
    "op3_license_scan": license_scan.oracle(),
    "op9_preference": preference.oracle(),
    "op11_ball_kmeans": ball_kmeans.oracle(),
    "op12_lexical_search": lexical_search.oracle(),
    "op13_line_dedup": line_dedup.oracle(),
}
