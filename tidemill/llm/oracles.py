"""SQL of those queries that DuckDB can run over the whole tables."""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Smallest document that each one reaches by ``links`` (a, b).
_REACH = "reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.r = l.a)"

OP5 = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE id = d.doc_id) AS component_id, coalesce((SELECT min(a) FROM links WHERE same AND b = d.doc_id), d.doc_id) AS class_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP6 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS length FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE x.length > 0 AND y.length > 0 AND list_inner_product(x.e, y.e) / (x.length * y.length) >= 0.95),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id OR b = vec_id) AS n_links, (SELECT min(r) FROM reach WHERE id = vec_id) AS component_id, vec_id = (SELECT min(r) FROM reach WHERE id = vec_id) AS kept FROM embeddings"""

OP9 = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, {' || chr(32) || '.join(["x"] + [f"lead(x, {k}) OVER o" for k in range(1, 8)])} AS s FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g WHERE s IS NOT NULL),
r AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM h WHERE c > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS soft FROM m),
k AS (SELECT host, count(*) AS host_docs, count(*) FILTER (base_failed OR soft) AS host_failed FROM f GROUP BY host),
x AS (SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE AS bad, sum(host_docs * pow(host_failed / host_docs, 2)) AS sq, count(*) AS hosts FROM k),
y AS (SELECT (bad + 0.5) / (n + 1) AS mean, greatest(sq / n - pow(bad / n, 2) - (bad + 0.5) / (n + 1) * (1 - (bad + 0.5) / (n + 1)) * hosts / n, 1e-6) AS spread FROM x),
z AS (SELECT mean, least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1000.0) AS weight FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (host_failed + mean * weight) / (host_docs + weight) <= 0.5 AS kept, f.host, host_docs, host_failed FROM f JOIN k ON k.host = f.host, z"""

OP13 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('42:' || doc_id) AS d FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_LOW = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP12 = f"""
WITH d AS (SELECT doc_id, {_LOW} AS w FROM documents), b AS (SELECT item_id, {_LOW} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM (SELECT *, least(len(w), 10) AS l FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))),
h AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


def _codes_sql(rounds: int = 4) -> str:
    """SQL of op11: codebooks c0, c1, ... (part, entry, e) and assignments a0, a1, ... after each round."""
    part = "SELECT vec_id, label, p, x[16 * p + 1:16 * p + 16] AS x FROM v, (SELECT unnest(range(4)) AS p)"
    steps = ["v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(1024 * c) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)", f"q AS MATERIALIZED ({part})"]
    steps.append("c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS e FROM q QUALIFY k < 256)")
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, min(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + k) AS best FROM q JOIN c{r} USING (p) GROUP BY ALL)")
        if r < rounds:
            mean = f"SELECT p, best % 256 AS k, list(m ORDER BY i) AS e FROM (SELECT p, best % 256 AS best, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.p, o.k, coalesce(n.e, o.e) AS e FROM c{r} o LEFT JOIN ({mean}) n ON n.p = o.p AND n.k = o.k)")
    out = f"SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label"
    digest = f"(SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) FROM c{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM ({out})"


OP11 = _codes_sql()
