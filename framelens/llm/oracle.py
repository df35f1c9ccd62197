"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import licenses, secrets

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = ("regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + UPPER.lower()
         + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP1 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
            FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
          FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
found AS (SELECT g.rid, g.i, g.k, n.item FROM grams g JOIN windows n USING (k, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


def _spans_sql(rule: secrets.Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT rid, {order} AS ord, '{rule.name}' AS kind, s AS start, s + length(m) AS stop
  FROM (SELECT rid, unnest(found) AS m, unnest(val) AS v,
               unnest(list_transform(range(1, len(found) + 1), lambda i:
                 list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                 + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0))) AS s
        FROM (SELECT rid, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {rule.value}) AS val,
                     string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')))
  WHERE length(v) >= {rule.least}"""


OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(secrets.RULES))}),
told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)
                  FILTER (ord < {len(secrets.BASE)}) AS base,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
         FROM (SELECT rid, ord, kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans)
         GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)"""

def _op2() -> str:
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    values = ", ".join(f"({i}, '{name}', '{t}', {n})" for i, (name, _) in enumerate(licenses.TEMPLATES)
                       for t, n in sorted(licenses.TERMS[i].items()))
    tok = licenses.TOKEN
    return f"""
WITH tmpl(i, license, term, n) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS t,
             coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/group' || (doc_id // 1000)
             || '/' || (doc_id // 100) AS dir,
             CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name FROM documents),
toks AS (SELECT DISTINCT rid, unnest(regexp_extract_all(t, '{tok}')) AS term FROM d),
df AS (SELECT term, count(*) AS n FROM toks WHERE term IN (SELECT term FROM tmpl) GROUP BY term),
idf AS (SELECT v.term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(df.n, 0))) + 1 AS idf
        FROM (SELECT DISTINCT term FROM tmpl) v LEFT JOIN df USING (term)),
tw AS (SELECT i, license, term, n * idf AS w, sqrt(sum((n * idf) ^ 2) OVER (PARTITION BY i)) AS norm
       FROM tmpl JOIN idf USING (term)),
sents AS (SELECT rid, row_number() OVER () AS sid, s FROM (
            SELECT rid, unnest(string_split(regexp_replace(t, '{licenses.SENTENCE_END}', '\\1' || chr(10), 'g'),
                                            chr(10))) AS s FROM d)
          WHERE regexp_matches(s, '{licenses.MENTION}')),
st AS (SELECT rid, sid, term, count(*) * any_value(idf) AS w
       FROM (SELECT rid, sid, unnest(regexp_extract_all(s, '{tok}')) AS term FROM sents) JOIN idf USING (term)
       GROUP BY rid, sid, term),
sn AS (SELECT sid, sqrt(sum(w * w)) AS norm FROM st GROUP BY sid),
cosine AS (SELECT st.rid, tw.i, tw.license, round(sum(st.w * tw.w / tw.norm) / any_value(sn.norm), 6) AS score
           FROM st JOIN tw USING (term) JOIN sn USING (sid) GROUP BY st.rid, st.sid, tw.i, tw.license),
own AS (SELECT rid, license AS own_license, score AS own_score FROM cosine
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, i) = 1 AND score >= {licenses.LEAST}),
files AS (SELECT d.rid, doc_id, dir, name, own_license, own_score FROM d LEFT JOIN own USING (rid)),
given AS (SELECT dir, own_license AS license FROM files WHERE name = 'LICENSE' AND own_license IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license DESC) = 1),
near AS (SELECT f.rid, g.dir, g.license FROM files f JOIN given g
         ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY f.rid ORDER BY length(g.dir) DESC) = 1)
SELECT doc_id, files.dir || '/' || name AS path, own_license, own_score,
       coalesce(own_license, near.license) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own_license IS NULL THEN near.dir END AS from_dir
FROM files LEFT JOIN near USING (rid)"""


OP6 = """
WITH p AS (SELECT page_id, CAST(encode(coalesce(html, '')) AS BLOB) AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload),
hexed AS (SELECT page_id, octet_length(payload) AS n, first_id, list_transform(range(0, 32), lambda i:
            list_sum(list_transform(range(0, 5), lambda k:
              ((instr('0123456789abcdef', substr(h, CAST((i * 5 + k) // 4 AS INTEGER) + 1, 1)) - 1)
                >> (3 - (i * 5 + k) % 4)) % 2 * (1 << (4 - k))))) AS digits
          FROM (SELECT page_id, payload, first_id, sha1(payload) AS h FROM p JOIN firsts USING (payload)))
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(digits, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM hexed"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND norm > 0 AND isfinite(norm)
         AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(a, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r),
component AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(degree.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component ON component.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id"""

CRC32 = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), "
         "lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
         "lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))")

OP11 = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                                  ORDER BY turn NULLS FIRST) AS t
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
opening AS (SELECT conv_id, t, {CRC32.format('conv_id::VARCHAR')} % 9 AS h FROM own),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.t[1:h], []), o.t[h + 1:]) AS t
            FROM opening o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id, d, len(t) AS n, sha256(to_json(t[1:d])::VARCHAR) AS key,
                    CASE WHEN d > 0 THEN sha256(to_json(t[1:d - 1])::VARCHAR) END AS up,
                    CASE WHEN d > 0 THEN strlen(t[d].text) ELSE 0 END AS bytes
             FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT key, any_value(up) AS up, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 any_value(bytes) AS bytes,
                 string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n) AS ends
          FROM prefixes GROUP BY key),
children AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
totals AS (SELECT p.key, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
           FROM nodes v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.d
           LEFT JOIN children c ON c.key = v.key GROUP BY p.key)
SELECT v.conv_id, v.d AS depth, parent.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN totals ON totals.key = v.key LEFT JOIN children c ON c.key = v.key
LEFT JOIN nodes parent ON parent.key = v.up"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
size AS (SELECT count(*) AS docs, coalesce(sum(len(w)), 0)::BIGINT AS total FROM d WHERE len(w) > 0),
item AS (SELECT item_id, term, count(*) AS times
         FROM (SELECT item_id, unnest({WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
         GROUP BY item_id, term),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf
       FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM item)
       GROUP BY rid, doc_id, n, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
           FROM tf, size GROUP BY term, docs),
scored AS (SELECT item_id, rid, doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
           FROM item JOIN tf USING (term) JOIN weight USING (term), size GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored WHERE score > 0) WHERE rank <= 10"""

OP13 = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, -9223372036854775808) AS doc, doc_id,
                  encode(coalesce(text, '')) AS body FROM documents),
strings AS (SELECT rid, doc, i, md5(body[i + 1:i + 100]) AS s
            FROM (SELECT rid, doc, body, unnest(range(0, octet_length(body) - 99)) AS i FROM d)),
firsts AS (SELECT s, min((doc, i)) AS first FROM strings GROUP BY s),
later AS (SELECT rid, i FROM strings JOIN firsts USING (s) WHERE (doc, i) > first),
runs AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run
         FROM (SELECT rid, i, (i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -101) + 100)::INT AS fresh FROM later)),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM spans),
cut AS (SELECT rid, count(*) AS n, sum(b - a)::BIGINT AS gone, max(b) AS tail,
               string_agg(hex(body[before + 1:a]), '' ORDER BY a) AS kept
        FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(body) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       CASE WHEN n IS NULL THEN sha256(body) ELSE sha256(unhex(kept || hex(body[tail + 1:octet_length(body)]))) END AS kept_sha256
FROM d LEFT JOIN cut USING (rid)"""

ORACLE = {"op2_licenses": _op2(), "op6_warc": OP6, "op8_embeddings": OP8, "op1_decontaminate": OP1, "op4_secrets": OP4,
          "op11_trie": OP11, "op12_lexical": OP12, "op13_substrings": OP13}
