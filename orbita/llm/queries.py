"""The registered queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_report, with_neighbours

    return with_neighbours(fingerprint_report(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filtered

    return filtered(table(spark, sf_dir, "pages"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentence_pieces import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_exact_dedup, op3_url_filters, op4_html_extraction, op5_minhash_near_dedup, op6_toxicity, op7_source_mixing, op8_secret_scans, op9_token_files, op10_sentence_pieces, op11_embedding_whitening, op12_decontamination, op13_spelling_variants, pipeline)}

_SPACES = r"[\x20\x09-\x0D]+"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op3_url_filters": r"""
        WITH rules(r, v) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
        cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://([^?#]*)', 1) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/.*$', 0, 's') AS path FROM cut),
        m AS (SELECT page_id, host, path, r, v, row_number() OVER (PARTITION BY page_id ORDER BY length(r) DESC NULLS LAST, strpos(r, '/') DESC) AS k
              FROM p LEFT JOIN rules ON ('.' || host) LIKE ('%.' || split_part(r, '/', 1)) AND starts_with(path, substr(r, strpos(r, '/'))))
        SELECT page_id, host, path, r AS "rule", coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
    "op7_source_mixing": r"""
        WITH d AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS draw, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
        w AS (SELECT *, CAST([3, 1, 2][k % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM r),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) >= cap / w AS capped
              FROM w WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * ((CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (sum(w) OVER () - coalesce(sum(w) FILTER (capped) OVER (), 0))) END AS target FROM l),
        f AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole, coalesce(target / nullif(source_size, 0), 0) - coalesce(floor(target / nullif(source_size, 0)), 0) AS p FROM t),
        u AS (SELECT d.*, f.source_size, f.target, whole, p, target - whole * f.source_size AS need, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), draw, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
              FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
        q AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
        c AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, coalesce(doc_id, -1), size) AS had, sum(size) OVER (PARTITION BY source, q, doc_id, size) AS own FROM q)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN q IS NOT NULL AND (had <= need OR (had - own < need AND had - need <= need - (had - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
    "op12_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM win),
        p AS (SELECT r, i, size, list_slice(w, i, i + size - 1) AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
        hit AS (SELECT r, i, size, item_id FROM p JOIN win USING (size, win)),
        words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, range(10) t(k) WHERE k < size GROUP BY r),
        items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
        o AS (SELECT run, c, list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1), lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM r),
        h AS (SELECT run, c, xor(4294967295, list_reduce(bytes, lambda a, x: list_reduce(range(8), lambda s, k: xor(s >> 1, (s & 1) * 3988292384), xor(a, x)), 4294967295)) AS h FROM o),
        v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        m AS (SELECT DISTINCT d.word AS a, d.n AS an, v.word AS b, v.n AS bn FROM d JOIN v ON d.less = v.word),
        near AS (SELECT a AS word, an AS n, b AS other, bn AS other_n FROM m UNION ALL SELECT b, bn, a, an FROM m UNION ALL SELECT x.word, x.n, y.word, y.n FROM d x JOIN d y ON x.less = y.less AND x.i = y.i WHERE x.word <> y.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
        chain(word, form, last) AS (SELECT word, form, word FROM f UNION ALL SELECT chain.word, f.form, f.word FROM chain JOIN f ON chain.form = f.word)
        SELECT f.word, f.form, chain.last AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL""",
}
