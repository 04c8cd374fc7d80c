"""DuckDB spelling of the training-data queries that SQL can express.

Classifiers, XXH64 fingerprints, tokenizers and page extraction have no SQL
form; those operators are tested against brute-force versions.
"""

from __future__ import annotations

from sparkpairs.llm.mixing import MixSettings

WORDS = r"[^\x20\x09-\x0D]+"

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

_ESC = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')"
CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(13 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
      FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _weights(level: str, s: MixSettings) -> str:
    cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in s.weights.get(level, {}).items())
    return f"CAST(CASE {level}{cases} ELSE {s.default_weight} END AS BIGINT)" if cases else f"CAST({s.default_weight} AS BIGINT)"


def mixing_sql(s: MixSettings = MixSettings()) -> str:
    """The budget tree level by level, then one ordered scan of each leaf."""
    levels = list(s.levels)
    out = [f"""t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS n,
      coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 4 AS VARCHAR), '') AS domain,
      coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
leaves AS (SELECT {', '.join(levels)}, CAST(sum(n) AS BIGINT) AS tokens FROM t WHERE n > 0 GROUP BY ALL),
w AS (SELECT *, {', '.join(f'{_weights(lv, s)} AS w_{lv}' for lv in levels)} FROM leaves),
c AS (SELECT *, CASE WHEN {' AND '.join(f'w_{lv} > 0' for lv in levels)} THEN tokens * {s.max_epochs} ELSE 0 END AS cap0 FROM w),
b_0 AS (SELECT least((SELECT CAST(floor(coalesce(sum(tokens), 0) * CAST({s.budget_share} AS DOUBLE)) AS BIGINT) FROM leaves),
                     (SELECT coalesce(sum(cap0), 0) FROM c)) AS budget)"""]
    parent: list[str] = []
    for i, lv in enumerate(levels):
        here = [*parent, lv]
        on = " AND ".join(f"n.{p} = b.{p}" for p in parent) or "TRUE"
        kids = f"PARTITION BY {', '.join(parent)}" if parent else ""
        ratio = f"{kids} ORDER BY CAST(cap AS DOUBLE) / w, {lv}"
        out.append(f"""n_{i} AS (SELECT n.*, b.budget FROM (SELECT {', '.join(here)}, sum(cap0) AS cap, max(w_{lv}) AS w FROM c GROUP BY ALL) n
      JOIN b_{i} b ON {on} WHERE w > 0 AND cap > 0),
f_{i} AS (SELECT *, cap::HUGEINT * sum(w) OVER ({ratio} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (budget - (sum(cap) OVER ({ratio} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap))::HUGEINT * w AS whole FROM n_{i}),
o_{i} AS (SELECT *, budget - coalesce(sum(cap) FILTER (whole) OVER ({kids}), 0) AS ob, sum(w) FILTER (NOT whole) OVER ({kids}) AS ow FROM f_{i}),
p_{i} AS (SELECT *, CASE WHEN whole THEN cap ELSE ob::HUGEINT * w // ow END AS part FROM o_{i}),
q_{i} AS (SELECT *, budget - sum(part) OVER ({kids}) AS spare, row_number() OVER ({kids} ORDER BY whole, {lv}) AS nth FROM p_{i}),
b_{i + 1} AS (SELECT {', '.join(here)}, CAST(part + CASE WHEN NOT whole AND nth <= spare THEN 1 ELSE 0 END AS BIGINT) AS budget FROM q_{i})""")
        parent = here
    using = ", ".join(levels)
    out.append(f"""a AS (SELECT {using}, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN b_{len(levels)} USING ({using}) WHERE budget > 0),
d AS (SELECT {using}, k, sum(n) AS n, count(*) AS copies FROM t WHERE n > 0 GROUP BY ALL),
h AS (SELECT d.*, a.epochs, a.rest, sum(n) OVER (PARTITION BY {using} ORDER BY md5(concat_ws(':', '{s.seed}', CAST(a.epochs AS VARCHAR), k)), k
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN a USING ({using})),
l AS (SELECT {using}, k, epochs, CASE WHEN upto < rest THEN -1 WHEN upto - n < rest THEN (rest - (upto - n)) // copies ELSE 0 END AS last FROM h),
r AS (SELECT t.doc_id, {', '.join('t.' + x for x in levels)}, t.n, l.epochs, CASE WHEN l.last = -1 THEN t.n ELSE l.last END AS last
      FROM t JOIN l USING ({using}, k) WHERE t.n > 0),
e AS (SELECT *, unnest(range(CAST(epochs + CASE WHEN last > 0 THEN 1 ELSE 0 END AS BIGINT))) AS ep FROM r)
SELECT doc_id, {using}, CAST(ep AS INTEGER) AS epoch, CAST(CASE WHEN ep < epochs THEN n ELSE last END AS BIGINT) AS take_tokens FROM e""")
    return "WITH " + ",\n".join(out)


#: CRC-32 of a text's UTF-8 bytes: the table of the reflected polynomial by eight shifts, then byte by byte.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """CRC-32 of ``text``; the one row of ``crc_table`` is among the tables read."""
    code = f"list_transform(range(0, CAST(length(hex(encode({text}))) AS BIGINT), 2), " \
           f"lambda k: CAST(('0x' || substr(hex(encode({text})), k + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {code}), " \
           "lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295)"


RESAMPLE = rf"""
WITH {_CRC_TABLE},
f AS (SELECT 0 AS target, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
      UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
w AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), crc_table),
c AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM f JOIN w USING (word) GROUP BY ALL),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * CAST((SELECT sum(s) FROM c) + 10000 AS DOUBLE)
      / ((s + 1) * CAST((SELECT sum(t) FROM c) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c),
d AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN w USING (word) JOIN g USING (bucket)
      WHERE target = 0 GROUP BY ALL),
a AS (SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      CAST('0x' || substr(sha256('2024:' || CAST(documents.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
      FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id),
b AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank
FROM b LEFT JOIN r USING (doc_id)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle_sql(doc_levels: int = 5, source_levels: int = 3) -> str:
    """Levels written out one by one: up to 16 to the power of ``doc_levels`` rows a source and as many sources."""
    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({f})) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"

    def level(k: int, name: str) -> str:
        w = "OVER (PARTITION BY source, pos // 16 ORDER BY pos ROWS BETWEEN"
        return f"""{name}_{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}n_{k}),
{name}n_{k + 1} AS (SELECT source, pos // 16 AS pos, CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n,
      CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}n_{k} GROUP BY source, pos // 16, n)"""

    steps = [("d", k) for k in range(doc_levels)] + [("s", k) for k in range(source_levels)]
    out = [_CRC_TABLE, f"""a AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
      THEN {leaf(_LOWER.format('text'))} END AS tampered FROM documents, crc_table),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM a),
dn_0 AS (SELECT source, pos, n, leaf AS h FROM b)""", *[level(k, "d") for k in range(doc_levels)],
           f"""sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM dn_{doc_levels}),
sn_0 AS (SELECT 0 AS source, pos, n, subroot AS h FROM sub)""", *[level(k, "s") for k in range(source_levels)],
           "f_0 AS (SELECT b.*, sub.pos AS spos, subroot, coalesce(tampered, leaf) AS folded, '' AS proof FROM b JOIN sub "
           "ON b.source IS NOT DISTINCT FROM sub.source)"]
    for i, (name, k) in enumerate(steps):
        on = f"t.source IS NOT DISTINCT FROM f.source AND t.pos = f.pos // {16 ** k}" if name == "d" else f"t.pos = f.spos // {16 ** k}"
        out.append(f"f_{i + 1} AS (SELECT f.* REPLACE (CASE WHEN t.n = 1 THEN folded ELSE sha256(t.l || folded || t.r) END AS folded, "
                   f"proof || t.l || t.r AS proof) FROM f_{i} f JOIN {name}_{k} t ON {on})")
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM f_{len(steps)}, (SELECT h AS root FROM sn_{source_levels})"""


#: Two similar sets share a shingle among the first fifth (and one) of their rarest ones, so only those are joined.
NEAR_COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '{WORDS}') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
      FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w), 2))) AS i) WHERE len(w) > 0),
f AS (SELECT s, count(*) AS df FROM t GROUP BY s),
o AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM t JOIN f USING (s)),
x AS (SELECT * FROM o WHERE 100 * (nth - 1) <= 20 * n),
c AS (SELECT DISTINCT a.doc_id AS p, b.doc_id AS q, a.n AS np, b.n AS nq FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
j AS (SELECT p, q FROM c JOIN t a ON a.doc_id = p JOIN t b ON b.doc_id = q AND a.s = b.s GROUP BY p, q, np, nq
      HAVING 100 * count(*) >= 80 * (np + nq - count(*))),
e AS (SELECT p, q FROM j UNION ALL SELECT q, p FROM j),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.q FROM r JOIN e ON r.reach = e.p),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
k AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {
    "op1_topk": TOPK,
    "op2_chat_trees": CHAT,
    "op6_mixing": mixing_sql(),
    "op11_merkle": merkle_sql(),
    "op12_near_copies": NEAR_COPIES,
    "op13_resample": RESAMPLE,
}
