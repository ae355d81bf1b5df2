"""The queries of this subpackage on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extraction, line_dedup, lm_scoring, minhash_dedup, packing, quality_rules, substring_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = toxicity.training_rows()
    model = toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    scored = toxicity.annotate(docs, model)
    return scored.select("doc_id", (~learn).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=100)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=80).drop("tag")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), window=1024)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=20, with_text=False).drop("kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "pipeline": pipeline,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
        WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        grams AS (
            SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
                   unnest(list_transform(range(1, len(w) - n + 2), lambda j : array_to_string(w[j : j + n - 1], ' '))) AS k
            FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
        found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
            FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op8_minhash_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACE} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]) END) AS k
            FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        sn AS (SELECT s.doc_id, k, n FROM s JOIN n USING (doc_id)),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM sn AS a JOIN sn AS b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op1_line_dedup": r"""
        WITH pieces AS (
            SELECT doc_id, i AS line, p[i] AS piece, regexp_replace(p[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
        judged AS (SELECT doc_id, line, s, doc_id * 100000000 + line AS pos FROM pieces WHERE s <> ''),
        d AS (SELECT s, min(pos) AS pos, length(s) AS n FROM judged GROUP BY s),
        v AS (SELECT s, pos, n, i, hash(substr(s, 1, i - 1) || substr(s, i + 1)) AS h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 10)),
        near AS (
            SELECT b.s FROM v AS a JOIN v AS b ON a.h = b.h AND a.i = b.i AND a.n = b.n AND a.pos < b.pos
            WHERE substr(a.s, 1, a.i - 1) = substr(b.s, 1, b.i - 1) AND substr(a.s, a.i + 1) = substr(b.s, b.i + 1)
            UNION
            SELECT CASE WHEN v.pos > d.pos THEN v.s ELSE d.s END FROM v JOIN d ON v.h = hash(d.s) AND v.n = d.n + 1 AND d.n >= 10
            WHERE substr(v.s, 1, v.i - 1) || substr(v.s, v.i + 1) = d.s),
        gone AS (
            SELECT doc_id, line FROM judged JOIN d USING (s) WHERE judged.pos > d.pos
            UNION SELECT doc_id, line FROM judged JOIN near USING (s)),
        kept AS (
            SELECT p.doc_id, count(*) FILTER (s <> '') AS n_lines, count(g.line) AS n_removed,
                   coalesce(string_agg(piece, chr(10) ORDER BY p.line) FILTER (g.line IS NULL), '') AS t
            FROM pieces AS p LEFT JOIN gone AS g ON p.doc_id = g.doc_id AND p.line = g.line GROUP BY 1)
        SELECT doc_id, n_lines, n_removed, sha256(t) AS text_sha256 FROM kept""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda j : array_to_string(w[j : j + 19], ' '))) AS k
            FROM d WHERE len(w) >= 20),
        firsts AS (SELECT k, min(doc_id * 100000000 + i) AS pos FROM grams GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, p
            FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM grams JOIN firsts USING (k) WHERE doc_id * 100000000 + i > pos)),
        words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        kept AS (
            SELECT w.doc_id, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS t
            FROM words AS w LEFT JOIN gone AS g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
