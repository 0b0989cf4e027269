"""The queries op1 to op13 and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .codebooks import compression
from .common import read
from .decontaminate import contamination
from .html import extracted
from .packing import best_fit
from .quality import quality
from .runs import periodic_runs
from .sharding import sharded
from .simhash import near_duplicates
from .suffix import suffix_dedup
from .tokens import token_files
from .topk import largest_products
from .toxicity import toxicity
from .urls import filtered

TOKENIZER = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(read(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), tails=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression(read(spark, sf_dir, "embeddings"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return largest_products(rows.where("vec_id % 50 = 0"), rows)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_files": op5_token_files,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_top_products": op13_top_products,
}


def _codes_sql(rounds: int = 2) -> str:
    """Parts, codebooks and assignments of op12, one pair of common tables a round."""
    nearest = """
        d{k} AS (SELECT x.part, x.vec_id, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
                 FROM x JOIN c{k} c ON c.part = x.part AND c.j = x.j GROUP BY x.part, x.vec_id, c.entry),
        a{k} AS (SELECT part, vec_id, d, entry FROM d{k}
                 QUALIFY row_number() OVER (PARTITION BY part, vec_id ORDER BY d, entry) = 1),"""
    moved = """
        m{n} AS (SELECT x.part, a.entry, x.j, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n
                 FROM x JOIN a{k} a ON a.part = x.part AND a.vec_id = x.vec_id GROUP BY x.part, a.entry, x.j),
        c{n} AS (SELECT c.part, c.entry, c.j, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v)::BIGINT AS v
                 FROM c{k} c LEFT JOIN m{n} m ON m.part = c.part AND m.entry = c.entry AND m.j = c.j),"""
    steps = "".join(nearest.format(k=k) + moved.format(k=k, n=k + 1) for k in range(rounds)) + nearest.format(k=rounds)
    return f"""
        WITH kept AS (SELECT vec_id, embedding AS v, label FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        p AS (SELECT vec_id, label, len(v) // 16 AS w, unnest(range(1, len(v) + 1)) AS i, v FROM kept),
        x AS (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS j, floor(256 * v[i]::DOUBLE)::BIGINT AS v FROM p),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
        c0 AS (SELECT x.part, f.entry, x.j, x.v FROM x JOIN f ON f.vec_id = x.vec_id),{steps}
        r AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, sum(a.d)::BIGINT AS error
              FROM kept k JOIN a{rounds} a ON a.vec_id = k.vec_id GROUP BY k.vec_id, k.label),
        b AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, j)) AS h FROM c{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, b.h AS codebooks_sha256 FROM r, b"""


ORACLE_SQL = {
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
              FROM d, LATERAL (SELECT unnest(range(0, length(h) // 2 - 49)) AS i) AS r
              WHERE length(h) >= 100),
        m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
        g AS (SELECT w.doc_id, w.i FROM w JOIN m ON m.s = w.s WHERE m.least < w.doc_id),
        n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM g),
        r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
        p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
        q AS (SELECT p.*, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM p),
        k AS (SELECT q.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
                     string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS rest
              FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
        SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
               coalesce(k.n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(k.rest, '') || substr(d.h, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_decontamination": r"""
        WITH iw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS s
                FROM iw, LATERAL (SELECT unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i) AS r WHERE len(w) > 0),
        dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        lens AS (SELECT DISTINCT n FROM win),
        dwin AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM dw, lens, LATERAL (SELECT unnest(range(0, len(w) - n + 1)) AS i) AS r WHERE len(w) >= n),
        found AS (SELECT d.doc_id, d.n, d.i, win.item_id FROM dwin d JOIN win ON win.s = d.s AND win.n = d.n),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) AS x GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) AS y GROUP BY doc_id)
        SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hits.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hits.n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hits ON hits.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id""",
    "op12_vector_codes": _codes_sql(),
    "op13_top_products": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
}
