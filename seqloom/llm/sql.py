"""The same results in SQL, for the queries that SQL can express."""


def _similar(tbl: str, key: str, value: str, k: int) -> str:
    return f"""
    SELECT DISTINCT '{tbl}' AS tbl, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b
    FROM (
      WITH m AS (SELECT DISTINCT "{key}" AS key, upper("{value}") AS s FROM {tbl} WHERE "{value}" <> '' AND "{key}" IS NOT NULL),
      v AS (SELECT row_number() OVER (ORDER BY s) AS id, s FROM (SELECT DISTINCT s FROM m WHERE length(s) >= {k})),
      g AS (SELECT DISTINCT id, substr(s, i, {k}) AS w FROM v, range(1, length(s) - {k} + 2) t(i)),
      n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      o AS (SELECT a.id AS ia, b.id AS ib, count(*) AS n_both FROM g a JOIN g b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
      p AS (SELECT ia, ib FROM o JOIN n na ON na.id = ia JOIN n nb ON nb.id = ib WHERE n_both * 3 >= na.n + nb.n
            UNION ALL SELECT id, id FROM v)
      SELECT ma.key AS ka, mb.key AS kb FROM p JOIN v va ON va.id = ia JOIN v vb ON vb.id = ib
      JOIN m ma ON ma.s = va.s JOIN m mb ON mb.s = vb.s WHERE ma.key <> mb.key
    ) q, LATERAL (SELECT ka AS key) x, LATERAL (SELECT kb AS key) y"""


def _classes(tbl: str, key: str, value: str, k: int) -> str:
    return f"""
    SELECT '{tbl}' AS tbl, key, class_id, copies, links FROM (
      WITH RECURSIVE r AS (SELECT "{key}" AS key, upper("{value}") AS s FROM {tbl} WHERE "{value}" <> ''),
      v AS (SELECT row_number() OVER (ORDER BY s) AS id, s FROM (SELECT DISTINCT s FROM r)),
      g AS (SELECT DISTINCT id, substr(s, i, {k}) AS w FROM v, range(1, length(s) - {k} + 2) t(i)),
      n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      o AS (SELECT a.id AS ia, b.id AS ib, count(*) AS n_both FROM g a JOIN g b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
      p AS (SELECT ia, ib FROM o JOIN n na ON na.id = ia JOIN n nb ON nb.id = ib WHERE n_both * 3 >= na.n + nb.n),
      e AS (SELECT ia, ib FROM p UNION ALL SELECT ib, ia FROM p),
      reach AS (SELECT ia AS id, ia AS other FROM e UNION SELECT reach.id, e.ib FROM reach JOIN e ON reach.other = e.ia),
      label AS (SELECT v.id, coalesce(min(other), v.id) AS label FROM v LEFT JOIN reach ON reach.id = v.id GROUP BY v.id),
      links AS (SELECT ia AS id, count(*) AS links FROM e GROUP BY 1),
      x AS (SELECT v.id, key, label, count(*) AS copies FROM r JOIN v ON v.s = r.s JOIN label ON label.id = v.id WHERE key IS NOT NULL GROUP BY 1, 2, 3)
      SELECT key, min(key) OVER (PARTITION BY label) AS class_id, copies, coalesce(links, 0) AS links FROM x LEFT JOIN links ON links.id = x.id)"""


_SETS = """WITH s AS (
  SELECT DISTINCT "case" AS c, trim(a) AS a FROM (
    SELECT "case", allele_1 AS a FROM haplotype UNION ALL SELECT "case", allele_2 FROM haplotype)
  WHERE "case" IS NOT NULL AND trim(a) <> ''),
 t AS (SELECT count(DISTINCT c) AS n FROM s),
 k AS (SELECT a, count(*) AS n_a FROM s GROUP BY a),
 p AS (SELECT x.a AS allele_a, y.a AS allele_b, count(*) AS n_ab FROM s x JOIN s y ON x.c = y.c AND x.a < y.a
       WHERE x.a IN (SELECT a FROM k, t WHERE n_a >= 5 AND n_a * 100 >= n) AND y.a IN (SELECT a FROM k, t WHERE n_a >= 5 AND n_a * 100 >= n)
         AND split_part(x.a, '*', 1) <> split_part(y.a, '*', 1) GROUP BY 1, 2),
 r AS (SELECT allele_a, allele_b, n_ab, ka.n_a AS n_a, kb.n_a AS n_b, n, (n_ab * n)::DOUBLE / (ka.n_a * kb.n_a) AS lift
       FROM p, t, k ka, k kb WHERE ka.a = allele_a AND kb.a = allele_b
         AND n_ab >= 5 AND n_ab * 100 >= n AND n_ab * n >= 3 * ka.n_a * kb.n_a)"""

_TOP = """WITH b AS (SELECT "case" AS case_name, gene, max(count_1) AS score FROM haplotype
  WHERE "case" IS NOT NULL AND gene IS NOT NULL AND count_1 IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_name ORDER BY score DESC, gene) AS rank FROM b)"""

_SPANS = """WITH r AS (
  SELECT DISTINCT 'demultiplex' AS tbl, name AS rec_key, upper(genomic_sequence) AS s FROM demultiplex WHERE length(genomic_sequence) >= 150 AND name IS NOT NULL
  UNION SELECT DISTINCT 'fasta', name, upper(seq) FROM fasta WHERE length(seq) >= 150 AND name IS NOT NULL),
 w AS (SELECT tbl, rec_key, length(s) AS n, i, md5(substr(s, i, 150)) AS h FROM r, range(1, length(s) - 148) t(i)),
 g AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT tbl || '/' || rec_key) > 1),
 f AS (SELECT DISTINCT tbl, rec_key, n, i FROM w WHERE h IN (SELECT h FROM g)),
 l AS (SELECT tbl, rec_key, max(n) OVER (PARTITION BY tbl, rec_key) AS n_chars,
        least(150, i - coalesce(lag(i) OVER (PARTITION BY tbl, rec_key ORDER BY i), -1000)) AS add FROM f)"""

_TERMS = """WITH h AS (SELECT DISTINCT * FROM heptamer),
 t AS (SELECT 'sequence' AS field_name, upper(trim(sequence)) AS term, coalesce("count", 0) AS c FROM h
       UNION ALL SELECT 'heptamer', upper(trim(heptamer)), coalesce("count", 0) FROM h),
 u AS (SELECT field_name, term, count(*) AS records, CAST(sum(c) AS BIGINT) AS total FROM t WHERE term <> '' GROUP BY 1, 2),
 m AS (SELECT *, CASE WHEN records > 0.05 * sum(records) OVER (PARTITION BY field_name) THEN 'common'
                      WHEN records < 3 OR total < 20 THEN 'rare' ELSE 'kept' END AS mark FROM u)"""

_WORDS = r"""regexp_extract_all(lower(regexp_replace(text, '</?\pL[^<>\n]*>|\[/?\pL[^\[\]\n]*\]|&(\pL[\pL\pN_]*|#\d+|#[xX][0-9a-fA-F]+);', ' ', 'g')), '[\pL\pN]+')"""
_LEAKS = f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
 ig AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
        FROM i, range(1, len(w) - least(13, len(w)) + 2) t(p) WHERE len(w) > 0),
 d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
 dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT DISTINCT n FROM ig) k, d, range(1, len(w) - n + 2) t(p)),
 l AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g))"""

_DRAWS = """WITH t AS (SELECT DISTINCT trim(source) AS source, max_repeats FROM mix_targets),
 d AS (SELECT doc_id, t.source, max_repeats, (('0x' || left(md5(doc_id || ':20210301'), 13))::BIGINT + 0.5) / 4503599627370496 AS u FROM documents d JOIN t ON lower(trim(d.source)) = lower(t.source)),
 c AS (SELECT n, sum(exp(n * ln(1.3) - 1.3 - lgamma(n + 1))) OVER (ORDER BY n) AS below FROM range(0, 64) r(n))
 SELECT doc_id, source, (SELECT count(*) FROM c WHERE n < max_repeats AND u > below) AS copies FROM d"""

SQL: dict[str, str] = {
    "p1_found": " UNION ALL ".join(f"({_similar(*x)})" for x in (("demultiplex", "name", "genomic_sequence", 12), ("fasta", "name", "seq", 12), ("blast", "sseqid", "sseqid", 4))),
    "p1_classes": " UNION ALL ".join(f"({_classes(*x)})" for x in (("demultiplex", "name", "genomic_sequence", 12), ("fasta", "name", "seq", 12), ("blast", "sseqid", "sseqid", 4))),
    "p2_found": f"{_SETS} SELECT allele_a, allele_b FROM r",
    "p2_pairs": f"{_SETS} SELECT allele_a, allele_b, n_ab, n_a, n_b, n, lift FROM r",
    "p3_found": f"{_TOP} SELECT case_name, gene FROM r WHERE rank <= 3",
    "p3_top": f"{_TOP} SELECT case_name, gene, score, rank FROM r WHERE rank <= 3",
    "p5_found": f"{_SPANS} SELECT DISTINCT tbl, rec_key FROM l",
    "p5_lengths": f"{_SPANS} SELECT tbl, rec_key, CAST(sum(add) AS BIGINT) AS shared_length, max(n_chars) AS n_chars FROM l GROUP BY 1, 2",
    "p6_found": f"{_TERMS} SELECT field_name, term, mark FROM m WHERE mark <> 'kept'",
    "p6_counts": f"{_TERMS} SELECT field_name, term, records, total, mark FROM m",
    "p7_found": f"{_LEAKS} SELECT doc_id, item_id FROM l",
    "p8_draws": _DRAWS,
    "p7_report": f"{_LEAKS} SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM l GROUP BY doc_id",
}
