"""DuckDB SQL for the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Every item is laid on a text wherever they have a token in common; the best lay of each pair counts.
DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS g FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS p FROM d),
it AS (SELECT item_id, len(g) AS m, unnest(g) AS tok, generate_subscripts(g, 1) - 1 AS j FROM i),
same AS (SELECT doc_id, item_id, m, p - j AS shift, j FROM dt JOIN it USING (tok)),
dense AS (
  SELECT *, least(m, 13) AS width FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= least(m, 13) - floor(least(m, 13) * 2 / 13)
),
seen AS (
  SELECT doc_id, item_id, shift, m, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS equal,
    count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS most
  FROM dense
),
best AS (
  SELECT DISTINCT ON (doc_id, item_id) * FROM seen WHERE most >= least(m, 13) - floor(least(m, 13) * 2 / 13)
  ORDER BY doc_id, item_id, most DESC, equal DESC, shift
)
SELECT doc_id, item_id, CAST(equal AS INTEGER) AS equal_tokens, CAST(m AS INTEGER) AS item_tokens,
  CAST(most AS INTEGER) AS window_equal, CAST(shift AS INTEGER) AS first_token
FROM best
"""

#: A window is 100 hexadecimal digits; a byte goes if a window over it also starts in a document with a smaller id.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT), 256)) AS start FROM d),
cut AS (SELECT doc_id, start, substr(h, 2 * start + 1, 610) AS part FROM c),
b AS (SELECT doc_id, start, part, unnest(range(least(256, CAST(length(part) // 2 AS BIGINT)))) AS o FROM cut),
w AS (SELECT doc_id, start + o AS i, md5_number(substr(part, 2 * o + 1, 100)) AS win FROM b WHERE 2 * o + 100 <= length(part)),
least_id AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i FROM w JOIN least_id USING (win) WHERE w.doc_id > first),
gone AS (
  SELECT b.doc_id, start + o AS i, substr(part, 2 * o + 1, 2) AS byte,
    count(hit.i) OVER (PARTITION BY b.doc_id ORDER BY start + o ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS cut
  FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.start + b.o = hit.i
),
runs AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM gone),
summed AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (cut) AS n_removed, count(*) FILTER (begins) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT cut), '') AS kept
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN summed USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

#: A formatted turn is <|im_start|>ROLE\nTEXT<|im_end|>\n: 24 characters besides the escaped role and text.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last,
    24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS size
  FROM t
),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY nth) AS so_far FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR last THEN so_far ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

#: crc32 of each different word, byte by byte through the table of its polynomial.
RESAMPLING = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i))),
words AS (
  SELECT 's' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
each AS (SELECT side, id, unnest(w) AS w FROM words),
vocabulary AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i - 1 AS BIGINT), 2))::UBIGINT)), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM each), crc
),
placed AS (SELECT side, id, bucket, count(*) AS n FROM each JOIN vocabulary USING (w) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM totals),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM totals, sums),
weighed AS (SELECT id, sum(n) AS n, sum(n * g) AS total FROM placed JOIN gain USING (bucket) WHERE side = 's' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON doc_id = id
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS k FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""


def _lloyd(rounds: int) -> str:
    """The rounds of VECTOR_CODES: books b0, b1 ..., assignments a0, a1 ..."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT vec_id, p, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - v[i]) * (x[i] - v[i])))::BIGINT, e := e)) AS best
  FROM part JOIN b{k} USING (p) GROUP BY vec_id, p
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, best.e AS e, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM part JOIN a{k} USING (vec_id, p)),
n{k} AS (SELECT p, e, list(g ORDER BY i) AS w FROM (SELECT p, e, i, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS g FROM m{k} GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(w, v) AS v FROM b{k} LEFT JOIN n{k} USING (p, e))""")
    return ",\n".join(steps)


VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
part AS (SELECT vec_id, p, x[CAST(p * len(x) // 16 + 1 AS BIGINT):CAST((p + 1) * len(x) // 16 AS BIGINT)] AS x FROM kept, range(16) r(p)),
b0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_lloyd(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def _halved(n_shards: int) -> str:
    """The levels of SHARDING: rows n0, n1 ... with their nodes."""
    steps, shares = [], [n_shards]
    while max(shares) > 1:
        i, first = len(steps), 0
        nodes = []
        for node, k in enumerate(shares):
            nodes.append(f"({node}, {k}, {first})")
            first += 1 + (k > 1)
        steps.append(f"""k{i}(node, k, first) AS (VALUES {', '.join(nodes)}),
e{i} AS (
  SELECT node, k, first, size::BIGINT * (k // 2) // k AS wanted,
    list_position(list_value(x0, x1, x2), greatest(x0, x1, x2)) AS dim
  FROM (SELECT node, sum(size) AS size, (max(d0) - min(d0)) / any_value(r0) AS x0, (max(d1) - min(d1)) / any_value(r1) AS x1, (max(d2) - min(d2)) / any_value(r2) AS x2 FROM n{i}, root GROUP BY node)
  JOIN k{i} USING (node)
),
p{i} AS (SELECT n{i}.*, k, first, wanted, (list_value(d0, d1, d2)[dim] << 38) + tie AS place FROM n{i} JOIN e{i} USING (node)),
s{i} AS (SELECT node, place, wanted, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY node ORDER BY place) AS up_to FROM p{i} WHERE k > 1 GROUP BY node, place, wanted),
c{i} AS (SELECT node, arg_min(CASE WHEN up_to - wanted < wanted - up_to + s THEN place + 1 ELSE place END, place) AS cut FROM s{i} WHERE up_to >= wanted GROUP BY node),
n{i + 1} AS (
  SELECT doc_id, size, text_crc32, tie, d0, d1, d2, (first + CASE WHEN k > 1 AND place >= cut THEN 1 ELSE 0 END)::INTEGER AS node
  FROM p{i} LEFT JOIN c{i} USING (node)
)""")
        shares = [h for k in shares for h in ([1] if k == 1 else [k // 2, k - k // 2])]
    return ",\n".join(steps)


#: The tree of 40 shards, level by level, each cut in the order of all rows; crc32 byte by byte.
SHARDING = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i))),
ends AS (SELECT coalesce(min(n_chars), 0)::DOUBLE AS low, coalesce(max(n_chars), 0)::DOUBLE AS high FROM documents),
bodies AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
n0 AS (
  SELECT doc_id, length(h) // 2 + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2))::UBIGINT)), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
    (('0x' || substr(md5(body), 1, 8))::BIGINT >> 12 << 18) + (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 14) AS tie,
    CASE WHEN lang IS NULL THEN 0 ELSE ('0x' || substr(md5(lang), 1, 8))::BIGINT >> 8 END AS d0,
    CASE WHEN source IS NULL THEN 0 ELSE ('0x' || substr(md5(source), 1, 8))::BIGINT >> 8 END AS d1,
    floor((coalesce(n_chars, low) - low) * 16777215 / CASE WHEN high = low THEN 1 ELSE high - low END)::BIGINT AS d2,
    0 AS node
  FROM bodies, crc, ends
),
root AS (
  SELECT greatest(max(d0) - min(d0), 1)::DOUBLE AS r0, greatest(max(d1) - min(d1), 1)::DOUBLE AS r1, greatest(max(d2) - min(d2), 1)::DOUBLE AS r2 FROM n0
),
{_halved(40)}
SELECT doc_id, size, text_crc32, 'bytes' AS law, node AS shard,
  row_number() OVER (PARTITION BY node ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 102, doc_id, text_crc32) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM n6
"""
