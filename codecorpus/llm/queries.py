"""Queries of the operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from codecorpus.llm import centroids, decontam, divergence, html_extract, langid, licenses, lines, mix, ngram_join, quality, secrets, substrings, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries():
    return {
        "op1_mix_sources": lambda s, d: mix.mix(_table(s, d, "documents")).report(),
        "op2_substring_dedup": lambda s, d: substrings.report(_table(s, d, "documents")),
        "op3_ngram_jaccard_join": lambda s, d: ngram_join.components(_table(s, d, "documents")),
        "op4_secret_scan": lambda s, d: secrets.report(_table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op6_language_id": lambda s, d: langid.report(_table(s, d, "documents")),
        "op7_html_extraction": lambda s, d: html_extract.report(_table(s, d, "pages")),
        "op8_decontamination": lambda s, d: decontam.report(_table(s, d, "documents"), _table(s, d, "benchmark")).drop("longest_match", "longest_item"),
        "op9_quality_rules": lambda s, d: quality.report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_license_scan": lambda s, d: licenses.report(_table(s, d, "documents")),
        "op11_source_divergence": lambda s, d: divergence.report(_table(s, d, "documents")),
        "op12_centroid_clustering": lambda s, d: centroids.report(_table(s, d, "embeddings")),
        "op13_line_dedup": lambda s, d: lines.report(_table(s, d, "documents")),
    }


def oracle_sql():
    return {"op3_ngram_jaccard_join": _OP3, "op8_decontamination": _OP8, "op11_source_divergence": _OP11, "op12_centroid_clustering": _op12(), "op13_line_dedup": _OP13}


_WORDS_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS_SPACE = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_OP8 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_ALNUM} AS w FROM documents),
b AS (SELECT item_id, CASE WHEN item_id IS NULL THEN row_number() OVER () END AS nameless, {_WORDS_ALNUM} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, nameless, least(13, len(w)) AS size, list_slice(w, i, i + least(13, len(w)) - 1) AS x
        FROM (SELECT item_id, nameless, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
places AS (SELECT r, size, i, list_slice(w, i, i + size - 1) AS x
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT p.r, p.i, p.size, win.item_id, win.nameless FROM places p JOIN win ON p.size = win.size AND p.x = win.x),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item, nameless FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SPACE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT doc_id, dense_rank() OVER (ORDER BY x) AS k FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM t x JOIN t y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) c ON c.node = d.doc_id
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS whole FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, t, count(*) AS n FROM o JOIN kept USING (lang, t) GROUP BY lang, source, t),
size AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY 1, 2),
voc AS (SELECT lang, count(*) AS v, sum(whole) AS size FROM kept GROUP BY lang),
p AS (SELECT s.lang, s.source, k.t, coalesce(n.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (s.size + 5 * v.v)::HUGEINT AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (k.whole + 5)) // (v.size + 5 * v.v)::HUGEINT AS BIGINT) AS q
      FROM size s JOIN voc v ON v.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN n ON n.lang = s.lang AND n.source = s.source AND n.t = k.t),
far AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM every WHERE part = 'pair' OR rank <= 50
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
going AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.r, k.doc_id, k.line, k.i, going.key IS NOT NULL AND k.doc_id IS DISTINCT FROM going.keeper AS gone FROM k LEFT JOIN going ON k.key = going.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY r
"""


def _op12():
    """Ten rounds, each a table of assignments and one of centroids."""
    parts = [
        "b AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64)",
        "raw AS (SELECT r, unnest(embedding) AS x, unnest(range(1, 65)) AS j FROM b)",
        "x AS MATERIALIZED (SELECT r, j, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM raw WHERE r NOT IN (SELECT r FROM raw WHERE x IS NULL OR isnan(x) OR isinf(x)))",
        "v AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, list(x ORDER BY j) AS e FROM x JOIN b USING (r) GROUP BY r)",
        "c0 AS MATERIALIZED (SELECT k, unnest(e) AS x, unnest(range(1, 65)) AS j FROM (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 8)))",
    ]
    for i in range(11):
        parts.append(f"d{i} AS (SELECT x.r, c.k, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS dist FROM x JOIN c{i} c ON x.j = c.j GROUP BY x.r, c.k)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, k, dist FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dist, k) AS pos FROM d{i}) WHERE pos = 1)")
        if i < 10:
            mean = f"SELECT k, j, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY k, j"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.x) AS x, c.j FROM c{i} c LEFT JOIN ({mean}) m ON m.k = c.k AND m.j = c.j)")
    return (
        "WITH " + ",\n".join(parts) + """
SELECT v.vec_id, CAST(a10.k AS INTEGER) AS "cluster", a10.dist AS distance, CAST(sum(a10.dist) OVER (PARTITION BY a10.k) AS BIGINT) AS cluster_inertia, CAST(sum(a10.dist) OVER () AS BIGINT) AS inertia, s.sha AS centroid_sha256
FROM a10 JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS sha FROM c10 GROUP BY k) s ON s.k = a10.k
"""
    )
