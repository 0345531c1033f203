"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_counts": op3_token_counts,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_repeats": op7_repeats,
    "op8_ngram_join": op8_ngram_join,
    "op9_pieces": op9_pieces,
    "op10_html_extract": op10_html_extract,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    # All pairs that share a shingle, and the links' transitive closure.
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = doc_id), doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id)
    """,
    # The tables' pages mark their article and hold these character references.
    "op10_html_extract": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>', ' ', 'g') AS x FROM pages),
        b AS (SELECT page_id, url, replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', '''') AS x FROM a),
        c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM c
    """,
}
