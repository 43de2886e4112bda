"""DuckDB SQL for those queries of this subpackage that SQL can express: the plainest form, all pairs and all quotients."""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, greatest(len(w) - 4, 0) AS m, unnest(range(0, greatest(len(w) - 4, 0))) AS p, unnest(list_transform(range(1, greatest(len(w) - 4, 0) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM dw),
s AS (SELECT item_id, greatest(len(w) - 4, 0) AS n, unnest(list_transform(range(1, greatest(len(w) - 4, 0) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM iw),
ic AS (SELECT item_id, n, x, count(*) AS k FROM s GROUP BY ALL),
h AS (SELECT doc_id, item_id, m, n, least(m, n) AS z, p, x, k FROM ds JOIN ic USING (x)),
st AS (SELECT DISTINCT doc_id, item_id, m, n, z, unnest(range(greatest(p - z + 1, 0), least(p, m - z) + 1)) AS a FROM h),
c AS (SELECT st.doc_id, st.item_id, st.n, st.z, st.a, h.x, least(count(*), min(h.k)) AS k FROM st JOIN h ON h.doc_id = st.doc_id AND h.item_id = st.item_id AND h.p BETWEEN st.a AND st.a + st.z - 1 GROUP BY ALL),
t AS (SELECT doc_id, item_id, a, sum(k)::DOUBLE / (n + z - sum(k)) AS similarity FROM c GROUP BY doc_id, item_id, a, n, z)
SELECT doc_id, item_id, max(similarity) AS similarity, min_by(a, (-similarity, a)) AS window_start FROM t WHERE similarity >= 0.8 GROUP BY 1, 2
"""

SHARDING = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT doc_id, n_bytes, h, k, h >> (60 - k) AS b FROM d, range(0, 61) r(k)),
f AS (SELECT k, b, sum(n_bytes) AS held FROM p GROUP BY 1, 2 HAVING sum(n_bytes) <= 16777216),
m AS (SELECT p.doc_id, p.n_bytes, p.h, min(p.k) AS k FROM p JOIN f USING (k, b) GROUP BY ALL)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.k = 0 THEN 'root' ELSE lpad(bin(m.h >> (60 - m.k)), m.k::INT, '0') END AS shard, m.k::INT AS shard_depth, f.held::BIGINT AS shard_bytes
FROM m JOIN f ON f.k = m.k AND f.b = m.h >> (60 - m.k)
"""

MIXING = r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM z GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(ord - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ()) AS whole FROM s0),
s2 AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
s3 AS (SELECT *, cap / weight > lev AS free FROM s2),
s4 AS (SELECT *, CASE WHEN free THEN (SELECT arg_min(lev, cap / weight) FROM s3 WHERE free) * weight ELSE cap END AS target FROM s3),
b0 AS (SELECT greatest(1, least(1024, floor(sum(target) / (1024 * count(*)))))::BIGINT AS block FROM s4),
b1 AS (SELECT s4.*, b0.block AS common, greatest(1, floor(target / 16))::BIGINT AS own, target > 0 AND greatest(1, floor(target / 16)) < b0.block AS small FROM s4, b0),
b2 AS (SELECT sum(target) AS shared, floor(sum(target) / any_value(common) + 0.5) AS blocks FROM b1 WHERE NOT small),
q AS (SELECT ord, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, ord) AS nth FROM (SELECT ord, target, unnest(range(0, (2 * blocks * target / shared)::BIGINT + 20)) AS i FROM b1, b2 WHERE NOT small AND target > 0)),
s5 AS (SELECT b1.* EXCLUDE (common, own), CASE WHEN small THEN own ELSE common END AS block,
    CASE WHEN small THEN floor(target / own + 0.5)::BIGINT ELSE (SELECT count(*) FROM q, b2 WHERE q.ord = b1.ord AND nth <= blocks) END AS won FROM b1),
d0 AS (SELECT z.*, s5.source_size, s5.target, s5.ord, s5.block, s5.won, z.h % greatest(ceil(s5.source_size / 1000000)::BIGINT, 1) AS shard FROM z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source),
d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY ord, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d0 WHERE size > 0),
t0 AS (SELECT ord, shard, sum(size)::BIGINT AS held, any_value(won) AS won, any_value(block) AS block FROM d GROUP BY 1, 2),
tq AS (SELECT ord, shard, won, row_number() OVER (PARTITION BY ord ORDER BY held / (2 * i + 1) DESC, shard) AS nth FROM (SELECT *, unnest(range(0, won + 1)) AS i FROM t0)),
t AS (SELECT t0.*, least((SELECT count(*) FROM tq WHERE tq.ord = t0.ord AND tq.shard = t0.shard AND tq.nth <= tq.won) * block, 2 * held) AS wanted FROM t0),
t2 AS (SELECT *, wanted // held AS passes, wanted % held AS rest FROM t),
k0 AS (SELECT ord, shard, block, rest, i, least(block, held - i * block) AS words, ('0x' || substr(md5('17|' || ord || '|' || shard || '|' || i), 1, 15))::BIGINT AS r FROM (SELECT *, unnest(range(0, (held - 1) // block + 1)) AS i FROM t2 WHERE rest > 0)),
k AS (SELECT *, least(words, rest - coalesce(sum(words) OVER (PARTITION BY ord, shard ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS part FROM k0),
x AS (SELECT d.ord, d.shard, d.a, sum(greatest(least(d.a + d.size, k.i * k.block + k.part) - greatest(d.a, k.i * k.block), 0)) AS extra
    FROM d JOIN k ON k.ord = d.ord AND k.shard = d.shard AND k.part > 0 AND k.i * k.block < d.a + d.size AND (k.i + 1) * k.block > d.a GROUP BY 1, 2, 3)
SELECT d.doc_id, d.source, d.size, d.source_size, d.target, (t2.passes * d.size + coalesce(x.extra, 0))::BIGINT AS taken FROM d JOIN t2 USING (ord, shard) LEFT JOIN x USING (ord, shard, a)
UNION ALL SELECT doc_id, source, size, source_size, target, 0 FROM d0 WHERE size = 0
"""

PASSAGES = r"""
WITH w AS (SELECT doc_id, text, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS b, unnest(list_transform(range(1, greatest(len(w) - 48, 1)), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS x FROM w),
f AS (SELECT x, min(doc_id) AS first FROM p GROUP BY x HAVING min(doc_id) < max(doc_id)),
h AS (SELECT r, list(b ORDER BY b) AS bs FROM p JOIN f USING (x) WHERE first < doc_id GROUP BY r),
c AS (SELECT r, list_distinct(flatten(list_transform(bs, lambda b: range(b, b + 50)))) AS gone FROM h),
k AS (SELECT w.r, list(unnested.w ORDER BY unnested.i) FILTER (WHERE c.gone IS NULL OR NOT list_contains(c.gone, unnested.i)) AS kept
    FROM w LEFT JOIN c USING (r), LATERAL (SELECT unnest(w.w) AS w, unnest(range(1, len(w.w) + 1)) AS i) unnested GROUP BY w.r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(k.kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

MERKLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source,
    sha256(concat_ws('', ifnull(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), ifnull(strlen(source) || ':' || source, '-'), ifnull(strlen(lang) || ':' || lang, '-'), ifnull(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), ifnull(strlen(text) || ':' || text, '-'))) AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS told, lang, n_chars FROM documents),
l AS (SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    sha256(concat_ws('', ifnull(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), ifnull(strlen(source) || ':' || source, '-'), ifnull(strlen(lang) || ':' || lang, '-'), ifnull(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), ifnull(strlen(told) || ':' || told, '-'))) AS claimed FROM d),
t AS (SELECT source, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM l
    UNION ALL SELECT source, min(level) + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (min(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY source, pos // 16),
s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM s
    UNION ALL SELECT min(level) + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (min(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY pos // 16),
p AS (SELECT l.source, l.pos, 0 AS side, x.level, y.pos AS beside, y.node FROM l JOIN t x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.pos = l.pos // (16 ** x.level)::BIGINT
    JOIN t y ON y.source IS NOT DISTINCT FROM x.source AND y.level = x.level AND y.pos // 16 = x.pos // 16
    UNION ALL SELECT s.source, NULL, 1, x.level, y.pos, y.node FROM s JOIN u x ON x.n > 1 AND x.pos = s.pos // (16 ** x.level)::BIGINT JOIN u y ON y.level = x.level AND y.pos // 16 = x.pos // 16),
w AS (SELECT l.doc_id, l.source, l.pos, l.claimed, l.leaf, p.side, p.level, string_agg(node, '' ORDER BY beside) FILTER (WHERE beside < (CASE WHEN p.side = 0 THEN l.pos ELSE s.pos END) // (16 ** p.level)::BIGINT) AS a,
    string_agg(node, '' ORDER BY beside) FILTER (WHERE beside > (CASE WHEN p.side = 0 THEN l.pos ELSE s.pos END) // (16 ** p.level)::BIGINT) AS b
    FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND (p.pos = l.pos OR p.side = 1) GROUP BY ALL),
v AS (SELECT doc_id, source, pos, leaf, claimed, sha256(ifnull(string_agg(ifnull(a, '') || ifnull(b, ''), '' ORDER BY side, level), '')) AS proof_sha256,
    list([ifnull(a, ''), ifnull(b, '')] ORDER BY side, level) FILTER (WHERE level IS NOT NULL) AS path FROM w GROUP BY ALL),
f AS (SELECT v.*, CASE WHEN path IS NULL THEN claimed ELSE list_reduce(list_prepend([claimed, ''], path), lambda c, x: [sha256(x[1] || c[1] || x[2]), ''])[1] END AS folded_root FROM v)
SELECT f.doc_id, f.leaf, s.subroot, r.node AS root, f.proof_sha256, f.folded_root, f.folded_root = r.node AS verified
FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source CROSS JOIN (SELECT node FROM u WHERE n = 1) r
"""

ORACLES = {"op1_ngram_jaccard": NGRAM_JACCARD, "op7_decontamination": DECONTAMINATION, "op8_sharding": SHARDING, "op10_mixing": MIXING, "op12_passages": PASSAGES,
           "op13_manifest": MERKLE}
