"""SQL that DuckDB runs for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'i' || source END AS src,
         COALESCE(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         md5(concat_ws(':', '20', doc_id::VARCHAR)) AS pick
  FROM documents
), sources AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY src) - 1 AS rank, 2.0::DOUBLE * source_size AS cap,
         sum(source_size) OVER ()::DOUBLE AS all_words FROM sources
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM ranked
), levels AS (
  SELECT *, (all_words * 1.5::DOUBLE - COALESCE(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), water AS (
  SELECT arg_min(level, (cap / weight, rank)) FILTER (WHERE level * weight < cap) AS level FROM levels
), targets AS (
  SELECT src, source_size, CASE WHEN w.level IS NULL THEN cap ELSE least(w.level * weight, cap) END AS target
  FROM levels, water w
), quotas AS (
  SELECT *, ((least(words, whole * 1024) + 1023) // 1024) + rest AS q, whole + rest - ((least(words, whole * 1024) + 1023) // 1024) - rest AS sp
  FROM (SELECT *, (words > whole * 1024)::BIGINT AS rest
        FROM (SELECT t.*, r.rank, floor(target)::BIGINT AS words, (2 * t.source_size) // 1024 AS whole FROM targets t JOIN ranked r USING (src)))
), tree AS (
  SELECT 0 AS level, (rank // 256)::BIGINT AS grp, 1::BIGINT AS node, 0 AS i, list(src ORDER BY rank) AS src, list(q::BIGINT ORDER BY rank) AS q,
         list(sp::BIGINT ORDER BY rank) AS sp, []::BIGINT[] AS got, sum(q)::BIGINT AS total, ((sum(q) + 1) // 2)::BIGINT AS need
  FROM quotas GROUP BY rank // 256
  UNION ALL
  SELECT n.level, grp, n.node, n.i, src, n.q, n.sp, n.got, n.total, n.need FROM (
    SELECT grp, src, unnest(CASE WHEN i < len(q) THEN
        [{{'level': level, 'node': node, 'i': i + 1, 'q': q, 'sp': sp, 'got': list_append(got, x), 'total': total - good, 'need': need - x}}]
      WHEN level < 6 THEN
        [{{'level': level + 1, 'node': 2 * node, 'i': 0, 'q': got, 'sp': sp_left, 'got': []::BIGINT[],
          'total': list_sum(got)::BIGINT, 'need': list_sum(got)::BIGINT // 2}},
         {{'level': level + 1, 'node': 2 * node + 1, 'i': 0, 'q': q_right, 'sp': sp_right, 'got': []::BIGINT[],
          'total': list_sum(q_right)::BIGINT, 'need': (list_sum(q_right)::BIGINT + 1) // 2}}]
      ELSE [] END) AS n
    FROM (
      SELECT *, CASE WHEN need <= 0 OR good <= 0 THEN 0 WHEN need >= total THEN good WHEN good >= total THEN need ELSE
             lo + len(list_filter(range(1, len(w) + 1), lambda j: COALESCE(list_sum(w[1:j - 1]), 0) <= u * list_sum(w))) - 1 END::BIGINT AS x,
             [(v + node % 2) // 2 for v in sp] AS sp_left, [sp[j] - (sp[j] + node % 2) // 2 for j in range(1, len(sp) + 1)] AS sp_right,
             [q[j] - COALESCE(got[j], 0) for j in range(1, len(q) + 1)] AS q_right
      FROM (
        SELECT *, [exp(lw[j] - list_max(lw)) for j in range(1, len(lw) + 1)] AS w FROM (
          SELECT *, [-lgamma(k + 1.0) - lgamma(good - k + 1.0) - lgamma(need - k + 1.0) - lgamma(total - good - need + k + 1.0)
                     for k in range(lo, hi + 1)] AS lw
          FROM (
            SELECT *, greatest(0, need + good - total, floor(mean - 12 * sd)::BIGINT - 2)::BIGINT AS lo,
                   least(need, good, ceil(mean + 12 * sd)::BIGINT + 2)::BIGINT AS hi
            FROM (
              SELECT *, need * (good / greatest(total, 1)) AS mean,
                     sqrt(greatest(0, need * (good / greatest(total, 1)) * (1 - good / greatest(total, 1)) * ((total - need) / greatest(total - 1, 1)))) AS sd,
                     (('0x' || substr(md5('20:' || grp || ':' || node || ':' || i), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
              FROM (SELECT *, COALESCE(q[i + 1], 0) AS good FROM tree)))))))
), leaves AS (
  SELECT node - 64 AS shard, unnest(src) AS src, unnest(q) AS q, unnest(sp) AS sp FROM tree WHERE level = 6 AND i = 0
), drawn AS (
  SELECT src, q, sum(q) OVER w - q AS first, sum(q + sp) OVER w - q - sp AS start FROM leaves WINDOW w AS (PARTITION BY src ORDER BY shard)
), placed AS (
  SELECT s.*, t.source_size, t.target, t.words, t.whole, row_number() OVER () AS row,
         (sum(size) OVER (PARTITION BY s.src ORDER BY pick, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place
  FROM sized s JOIN quotas t ON s.src = t.src
), copies AS (
  SELECT *, unnest([place, source_size + place]) AS pos FROM placed
), pieces AS (
  SELECT *, unnest(range(pos // 1024, (pos + greatest(size, 1) - 1) // 1024 + 1)) AS block FROM copies
), slots AS (
  SELECT *, CASE WHEN block < whole THEN ((block::HUGEINT * 2305843009213693951 + ('0x' || substr(md5('20:' || src), 1, 12))::BIGINT)
                                          % greatest(whole, 1))::BIGINT ELSE block END AS slot FROM pieces
), taken AS (
  SELECT s.row, sum(greatest(0, least(pos + size, block * 1024 + least(1024, words - (first + slot - start) * 1024)) - greatest(pos, block * 1024))) AS taken
  FROM slots s JOIN drawn d ON s.src = d.src AND s.slot >= d.start AND s.slot < d.start + d.q GROUP BY s.row
)
SELECT p.doc_id, p.size, p.source_size, p.target, COALESCE(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.row = t.row
"""

OP3 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, y AS other FROM both_ways
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
)
SELECT d.doc_id, COALESCE(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, COALESCE(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

OP5 = rf"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), words AS (
  SELECT doc_id, line, regexp_extract_all(lower(body), '{WORDS}') AS w FROM cut
), tokens AS (
  SELECT DISTINCT doc_id, line, unnest(CASE WHEN len(w) >= 5 THEN w ELSE [chr(9) || array_to_string(w, chr(9))] END) AS t
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, line, count(*) AS n, string_agg(t, ' ' ORDER BY t) AS whole FROM tokens GROUP BY doc_id, line
), classes AS (
  SELECT whole, any_value(n) AS n, min((doc_id, line)) AS first FROM sizes GROUP BY whole
), numbered AS (
  SELECT row_number() OVER () AS c, * FROM classes
), members AS (
  SELECT c, unnest(string_split(whole, ' ')) AS t FROM numbered
), common AS (
  SELECT a.c AS x, b.c AS y, count(*) AS k FROM members a JOIN members b ON a.t = b.t AND a.c <> b.c GROUP BY 1, 2
), matched AS (
  SELECT DISTINCT y FROM common JOIN numbered p ON p.c = x JOIN numbered q ON q.c = y
  WHERE p.first < q.first AND 100 * k >= 80 * (p.n + q.n - k)
), gone AS (
  SELECT s.doc_id, s.line FROM sizes s JOIN numbered u ON s.whole = u.whole LEFT JOIN matched m ON m.y = u.c
  WHERE m.y IS NOT NULL OR (s.doc_id, s.line) <> u.first
)
SELECT doc_id, count(*) AS n_removed, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id
"""

OP10 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), unit AS (
  SELECT vec_id, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS v FROM usable
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= 0.9
), reach AS (
  SELECT x AS vec_id, y AS other FROM links
  UNION
  SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x
)
SELECT e.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, least(e.vec_id, COALESCE(m.least_id, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, COALESCE(m.least_id, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = e.vec_id
LEFT JOIN (SELECT vec_id, min(other) AS least_id FROM reach GROUP BY vec_id) m ON m.vec_id = e.vec_id
"""

# CRC-32 of decimal ids: a table made by the polynomial's rule, then one step a character
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS x
    FROM range(256) r(i))
)"""


def crc32_of(number: str) -> str:
    """SQL of the unsigned CRC-32 of a decimal number; needs ``crc_table`` in FROM."""
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


OP11 = rf"""
WITH {CRC_TABLE}, own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
         octet_length(encode(COALESCE(role, ''))) || ':' || COALESCE(role, '') || COALESCE(text, '') AS said,
         len(regexp_extract_all(COALESCE(text, ''), '{WORDS}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, {crc32_of("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.k, o.said, o.words FROM heads c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.k, o.said, o.words FROM heads c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, md5(said) AS digest, words FROM rebuilt
), paths AS (
  SELECT conv_id, d, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM heads
), lasts AS (
  SELECT conv_id, arg_max(path, d) AS path FROM paths GROUP BY conv_id
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM lasts GROUP BY path
), nodes AS (
  SELECT path, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM paths GROUP BY path
), children AS (
  SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), spread AS (
  SELECT n.saved, (c.n IS NULL)::INT AS leaf, n.path, unnest(range(n.depth + 1)) AS d FROM nodes n LEFT JOIN children c ON c.path = n.path
), below AS (
  SELECT left(path, (32 * d)::INT) AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY 1
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       COALESCE(c.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, greatest(0, length(n.path) - 32))
"""


def _merkle_level(of: str, to: str, key: str) -> str:
    """CTEs of one level over ``of`` (key, k, digest): runs of 16 become ``to``."""
    return f"""{to}_count AS (
  SELECT {key}, count(*) AS n FROM {of} GROUP BY {key}
), {to}_runs AS (
  SELECT a.{key}, c.n, CASE WHEN c.n > 1 THEN a.k // 16 ELSE a.k END AS g, a.k, digest FROM {of} a JOIN {to}_count c ON c.{key} = a.{key}
), {to} AS (
  SELECT {key}, g AS k, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY k)) ELSE min(digest) END AS digest,
         string_agg(digest, '' ORDER BY k) AS run
  FROM {to}_runs GROUP BY {key}, g
)"""


def _merkle_path(of: str, to: str, level: str, key: str) -> str:
    """CTE that takes every row's place, proof and claim one level up."""
    at = "(64 * (p.spot % 16))::INT"
    others = f"left(r.run, {at}) || substr(r.run, {at} + 65)"
    many = "c.n > 1"
    return f"""{to} AS (
  SELECT p.* REPLACE (
    CASE WHEN {many} THEN p.spot // 16 ELSE p.spot END AS spot,
    CASE WHEN {many} THEN p.proof || {others} ELSE p.proof END AS proof,
    CASE WHEN {many} THEN sha256(left(r.run, {at}) || p.claim || substr(r.run, {at} + 65)) ELSE p.claim END AS claim)
  FROM {of} p JOIN {level}_count c ON c.{key} = p.{key}
  JOIN {level} r ON r.{key} = p.{key} AND r.k = CASE WHEN {many} THEN p.spot // 16 ELSE p.spot END
)"""


def merkle_sql(levels: int = 5, top_levels: int = 3) -> str:
    """Manifest SQL for at most 16^levels rows a source and 16^top_levels sources."""
    value = "COALESCE(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    fields = [value.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = value.format(c="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    steps = [CRC_TABLE]
    steps.append(f"""hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS src, sha256({" || ".join(fields)}) AS leaf,
         CASE WHEN {crc32_of("doc_id")} % 5 = 0 THEN sha256({" || ".join([*fields[:4], lowered])}) END AS changed
  FROM documents, crc_table
), p0 AS (
  SELECT doc_id, src, leaf, 1 AS one, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, '' AS proof,
         COALESCE(changed, leaf) AS claim
  FROM hashed
), l0 AS (
  SELECT src, spot AS k, leaf AS digest FROM p0
)""")
    for i in range(levels):
        steps.append(_merkle_level(f"l{i}", f"l{i + 1}", "src"))
        steps.append(_merkle_path(f"p{i}", f"p{i + 1}", f"l{i + 1}", "src"))
    steps.append(f"""t0 AS (
  SELECT 1 AS one, src, row_number() OVER (ORDER BY encode(src)) - 1 AS k, digest FROM l{levels}
), q0 AS (
  SELECT p.* REPLACE (t.k AS spot), t.digest AS subroot FROM p{levels} p JOIN t0 t ON t.src = p.src
)""")
    for i in range(top_levels):
        steps.append(_merkle_level(f"t{i}", f"t{i + 1}", "one"))
        steps.append(_merkle_path(f"q{i}", f"q{i + 1}", f"t{i + 1}", "one"))
    return "WITH " + ", ".join(steps) + f"""
SELECT q.doc_id, q.leaf, q.subroot, t.digest AS root, sha256(q.proof) AS proof_sha256, q.claim AS folded_root, q.claim = t.digest AS verified
FROM q{top_levels} q JOIN t{top_levels} t ON t.one = q.one
"""


ORACLES = {
    "op1_mix_sources": OP1,
    "op3_jaccard_join": OP3,
    "op5_line_dedup": OP5,
    "op10_embedding_dedup": OP10,
    "op11_conversation_trie": OP11,
    "op12_merkle_manifest": merkle_sql(),
}
