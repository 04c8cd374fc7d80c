"""Oracle SQL (DuckDB) for every registered query.

Tables are the pre-registered views of the test data. Views derived in Spark
(quoted, contracted, tagged, multi-reference, io pairs, generated output,
masked predictions) are spelled here identically. Doubles are rounded with
the same IEEE expression as in Spark: ``floor(x * 1e6 + 0.5) / 1e6``.
"""

from __future__ import annotations

from sparkpairs.functions.chunk_sql import poisson_size_sql
from sparkpairs.functions.constants import (
    CONTENT_BEGIN,
    CONTENT_END,
    DEFAULT_ERROR_CONFIG,
    EVAL_FALLBACK_PROMPT,
    PRODUCTION_ERROR_CONFIG,
    PY_WHITESPACE,
    RESPONSE_PART,
    WS_CLASS,
)
from sparkpairs.functions.rand import sql_digest, sql_uniform
from sparkpairs.functions.text import SENTENCE_RE, TOKEN_RE, WORD_RE
from sparkpairs.operators.errors import ErrorConfig
from sparkpairs.operators.segments import DOTTED_RE, LAST_RE
from sparkpairs.plans import registry as R
from sparkpairs.plans.oracle_errors import insert_errors_sql, q, single_error_sql
from sparkpairs.plans.oracle_html import html_sql
from sparkpairs.sources.html import HTML_RULES

NL = "chr(10)"
WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


def lit(s: str) -> str:
    """SQL literal for a Python string; newlines spelled with chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join(q(p) for p in parts) if len(parts) > 1 else q(s)


H_DOC = sql_digest(R.SEED, None, "doc_id")
MARKED = f"({q(CONTENT_BEGIN)} || {NL} || text || {NL} || {q(CONTENT_END)})"
SYS = lit(R.SYSTEM_PROMPT)
CHAT_TEXT = (f"('<start_of_turn>user' || {NL} || {SYS} || {NL} || {NL} || {strip(MARKED)} || '<end_of_turn>' || {NL}"
             f" || '<start_of_turn>model' || {NL} || {strip('text')} || '<end_of_turn>' || {NL})")
LEN_CTE = f"L AS (SELECT doc_id, len(regexp_extract_all({CHAT_TEXT}, {q(TOKEN_RE)}))::BIGINT AS length FROM documents)"


def _sampling() -> dict[str, str]:
    split = (f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H_DOC}, doc_id) - 1 < "
             f"ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents")
    return {
        "shuffle_rank": (f"SELECT source, md5(text) AS text_md5, row_number() OVER (ORDER BY "
                         f"{sql_digest(R.SEED, None, 'source', 'text')}, source, text) - 1 AS rank FROM documents"),
        "train_test_split": split,
        "subsample_ceil": (f"WITH s AS ({split}), r AS (SELECT doc_id, split, row_number() OVER (PARTITION BY split "
                           f"ORDER BY {H_DOC}, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY split) AS n FROM s) "
                           f"SELECT doc_id, split, rank FROM r WHERE rank < ceil(0.05::DOUBLE * n)"),
        "sample_n": f"SELECT doc_id, source FROM documents ORDER BY {H_DOC}, doc_id LIMIT 100",
        "pick_index": (f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H_DOC}, doc_id) - 1 AS rank, "
                       f"count(*) OVER () AS n FROM documents) SELECT doc_id, rank FROM r WHERE rank = least(10, n - 1)"),
    }


def _chat() -> dict[str, str]:
    def js(x):
        return f"CAST(to_json({x}) AS VARCHAR)"
    rp = lit(RESPONSE_PART)
    return {
        "chat_messages": (f"SELECT doc_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS pos, "
                          f"unnest(['system', 'user', 'assistant']) AS role, unnest([{SYS}, {MARKED}, text]) AS content "
                          f"FROM documents"),
        "chat_text": f"SELECT doc_id, {CHAT_TEXT} AS text FROM documents",
        "chat_json": (f"SELECT doc_id, '{{\"conversations\": [{{\"role\": \"system\", \"content\": ' || {js(SYS)} || "
                      f"'}}, {{\"role\": \"user\", \"content\": ' || {js(MARKED)} || "
                      f"'}}, {{\"role\": \"assistant\", \"content\": ' || {js('text')} || '}}]}}' AS text FROM documents"),
        "inference_prompt": (f"SELECT doc_id, '<start_of_turn>user' || {NL} || {lit(EVAL_FALLBACK_PROMPT)} || {NL} || {NL} || "
                             f"{strip(MARKED)} || '<end_of_turn>' || {NL} || '<start_of_turn>model' || {NL} AS text FROM documents"),
        "chat_text_own_turn": (f"SELECT doc_id, '<start_of_turn>user' || {NL} || {strip(SYS)} || '<end_of_turn>' || {NL} || "
                               f"'<start_of_turn>user' || {NL} || {strip(MARKED)} || '<end_of_turn>' || {NL} || "
                               f"'<start_of_turn>model' || {NL} || {strip('text')} || '<end_of_turn>' || {NL} AS text FROM documents"),
        "prompt_response_split": (
            f"WITH t AS (SELECT doc_id, {CHAT_TEXT} AS t FROM documents), p AS (SELECT doc_id, t, instr(t, {rp}) AS pos FROM t) "
            f"SELECT doc_id, length(CASE WHEN pos > 0 THEN substr(t, 1, pos - 1) ELSE t END)::BIGINT AS prompt_chars, "
            f"length(CASE WHEN pos > 0 THEN substr(t, pos + {len(RESPONSE_PART)}) ELSE '' END)::BIGINT AS response_chars, "
            f"{r6(f'length(CASE WHEN pos > 0 THEN substr(t, pos + {len(RESPONSE_PART)}) ELSE {q(chr(0) * 0)} END) / length(t)')} "
            f"AS supervised_share FROM p"),
    }


def _lengths() -> dict[str, str]:
    grid = ("G AS (SELECT DISTINCT unnest(list_concat(CASE WHEN least(mx + 512, 8192) > 512 THEN "
            "range(512, least(mx + 512, 8192), 256) ELSE [] END, [768])) AS max_len FROM T)")
    tot = "T AS (SELECT count(*) AS n, sum(length) AS tot, max(length) AS mx FROM L)"
    curve = (f"C AS (SELECT g.max_len, sum(CASE WHEN L.length > g.max_len THEN L.length - g.max_len ELSE 0 END) AS tt, "
             f"sum(CASE WHEN L.length > g.max_len THEN 1 ELSE 0 END) AS ts FROM G g CROSS JOIN L GROUP BY g.max_len), "
             f"P AS (SELECT C.max_len, tt, ts, (tt::DOUBLE * 100.0::DOUBLE) / T.tot::DOUBLE AS pct, "
             f"(ts::DOUBLE * 100.0::DOUBLE) / T.n::DOUBLE AS spct FROM C CROSS JOIN T)")
    opt = ("O AS (SELECT coalesce(min(CASE WHEN pct <= 1.0::DOUBLE THEN max_len END), max(max_len)) AS optimal_1pct, "
           "coalesce(min(CASE WHEN pct <= 5.0::DOUBLE THEN max_len END), max(max_len)) AS optimal_5pct FROM P)")
    M = R.DEFAULT_MAX_LENGTH
    k0 = f"(({M} - acc.cur) // x.l)"
    per = f"({M} // x.l)"
    r = f"(x.c - {k0})"
    b = f"(({r} + {per} - 1) // {per})"
    reducer = (f"lambda acc, x: CASE WHEN x.l = 0 THEN acc "
               f"WHEN x.c <= {k0} THEN {{'l': x.l, 'c': x.c, 'packed': acc.packed, 'cur': acc.cur + x.c * x.l}} "
               f"ELSE {{'l': x.l, 'c': x.c, 'packed': acc.packed + {b}, 'cur': ({r} - ({b} - 1) * {per}) * x.l}} END")
    pack = (f"K AS (SELECT least(length, {M})::BIGINT AS l, count(*)::BIGINT AS c FROM L GROUP BY 1), "
            f"A AS (SELECT list_reduce(list_prepend({{'l': 0::BIGINT, 'c': 0::BIGINT, 'packed': 0::BIGINT, 'cur': 0::BIGINT}}, "
            f"list({{'l': l, 'c': c, 'packed': 0::BIGINT, 'cur': 0::BIGINT}} ORDER BY l)), {reducer}) AS st, "
            f"sum(c)::BIGINT AS n, sum(l * c)::BIGINT AS tokens FROM K), "
            f"PK AS (SELECT n, tokens, st.packed + (st.cur > 0)::BIGINT AS packed FROM A), "
            f"E AS (SELECT n, packed, tokens::DOUBLE / (n * {M})::DOUBLE AS wo, tokens::DOUBLE / (packed * {M})::DOUBLE AS w "
            f"FROM PK)")
    return {
        "chat_token_lengths": f"WITH {LEN_CTE} SELECT doc_id, length FROM L",
        "length_summary": (f"WITH {LEN_CTE} SELECT count(*) AS n, {r6('avg(length)')} AS mean, "
                           f"{r6('quantile_cont(length, 0.5)')} AS median, {r6('stddev_pop(length)')} AS std, "
                           f"min(length) AS min_length, max(length) AS max_length, "
                           f"{r6('quantile_cont(length, 0.95)')} AS p95, {r6('quantile_cont(length, 0.99)')} AS p99, "
                           f"sum(length)::BIGINT AS total_tokens FROM L"),
        "length_histogram": (
            f"WITH {LEN_CTE}, M AS (SELECT min(length) AS mn, max(length) AS mx FROM L), "
            f"B AS (SELECT CASE WHEN mx = mn THEN 1 ELSE least(floor((length - mn) * 50.0::DOUBLE / (mx - mn))::BIGINT + 1, 50) "
            f"END AS bin FROM L CROSS JOIN M), C AS (SELECT bin, count(*) AS cnt FROM B GROUP BY bin) "
            f"SELECT CAST(g.bin AS INTEGER) AS bin, {r6('mn + (g.bin - 1) * ((mx - mn)::DOUBLE / 50.0::DOUBLE)')} AS bin_lo, "
            f"{r6('mn + g.bin * ((mx - mn)::DOUBLE / 50.0::DOUBLE)')} AS bin_hi, coalesce(C.cnt, 0)::BIGINT AS cnt "
            f"FROM range(1, 51) g(bin) CROSS JOIN M LEFT JOIN C ON C.bin = g.bin"),
        "length_boxplot": (
            f"WITH {LEN_CTE}, Q AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.5) AS med, "
            f"quantile_cont(length, 0.75) AS q3 FROM L) "
            f"SELECT {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3, {r6('q3 - q1')} AS iqr, "
            f"min(CASE WHEN length >= q1 - 1.5::DOUBLE * (q3 - q1) THEN length END) AS whisker_lo, "
            f"max(CASE WHEN length <= q3 + 1.5::DOUBLE * (q3 - q1) THEN length END) AS whisker_hi, "
            f"sum(CASE WHEN length < q1 - 1.5::DOUBLE * (q3 - q1) OR length > q3 + 1.5::DOUBLE * (q3 - q1) THEN 1 ELSE 0 END)::BIGINT "
            f"AS n_outliers FROM L CROSS JOIN Q GROUP BY q1, med, q3"),
        "truncation_curve": (f"WITH {LEN_CTE}, {tot}, {grid}, {curve} SELECT max_len::BIGINT AS max_len, "
                             f"tt::BIGINT AS truncated_tokens, ts::BIGINT AS truncated_samples, {r6('pct')} AS truncation_percentage, "
                             f"{r6('spct')} AS samples_affected_percentage FROM P"),
        "optimal_max_length": f"WITH {LEN_CTE}, {tot}, {grid}, {curve}, {opt} SELECT optimal_1pct::BIGINT AS optimal_1pct, optimal_5pct::BIGINT AS optimal_5pct FROM O",
        "packing_efficiency": (f"WITH {LEN_CTE}, {pack} SELECT {M}::BIGINT AS max_length, {r6('wo')} AS without_packing, "
                               f"{r6('w')} AS with_packing, {r6('w / wo')} AS improvement, n AS sequences_without_packing, "
                               f"packed AS sequences_with_packing, {r6('1.0::DOUBLE - packed::DOUBLE / n::DOUBLE')} AS memory_savings FROM E"),
        # the packing loop row by row: a sequence is closed when the next length does not fit
        "packing_report": (
            f"WITH RECURSIVE {LEN_CTE}, {tot}, {grid}, {curve}, {opt}, U AS (SELECT m, bool_or(u = 0) AS is_configured, bool_or(u = 1) AS is_1pct, "
            f"bool_or(u = 2) AS is_5pct FROM (SELECT {M}::BIGINT AS m, 0 AS u UNION ALL SELECT optimal_1pct::BIGINT, 1 FROM O "
            f"UNION ALL SELECT optimal_5pct::BIGINT, 2 FROM O) GROUP BY m), "
            f"S AS (SELECT m, least(length, m)::BIGINT AS l, row_number() OVER (PARTITION BY m ORDER BY length) AS i FROM L CROSS JOIN U), "
            f"loop AS (SELECT m, 0::BIGINT AS i, 0::BIGINT AS packed, 0::BIGINT AS cur FROM U UNION ALL "
            f"SELECT loop.m, S.i, packed + (cur + l > loop.m)::BIGINT, CASE WHEN cur + l > loop.m THEN l ELSE cur + l END "
            f"FROM loop JOIN S ON S.m = loop.m AND S.i = loop.i + 1), "
            f"F AS (SELECT m, arg_max(packed + (cur > 0)::BIGINT, i) AS packed FROM loop GROUP BY m), "
            f"N AS (SELECT m, count(*) AS n, sum(l)::DOUBLE AS tokens FROM S GROUP BY m), "
            f"E AS (SELECT U.*, n, packed, tokens / (n * m)::DOUBLE AS wo, tokens / (packed * m)::DOUBLE AS w FROM U JOIN N USING (m) JOIN F USING (m)) "
            f"SELECT m AS max_length, is_configured, is_1pct, is_5pct, {r6('wo')} AS without_packing, {r6('w')} AS with_packing, "
            f"{r6('w / wo')} AS improvement, n AS sequences_without_packing, packed AS sequences_with_packing, "
            f"{r6('1.0::DOUBLE - packed::DOUBLE / n::DOUBLE')} AS memory_savings FROM E"),
        "length_advice": (
            f"WITH {LEN_CTE}, {tot}, {grid}, {curve}, {opt}, {pack} SELECT {M}::BIGINT AS current_max_length, "
            f"optimal_1pct::BIGINT AS conservative_max_length, optimal_5pct::BIGINT AS balanced_max_length, "
            f"CASE WHEN optimal_1pct = optimal_5pct THEN CASE WHEN optimal_5pct <> {M} THEN 'change' ELSE 'keep' END "
            f"ELSE 'choose' END AS recommendation, "
            f"CASE WHEN {M} IN (optimal_1pct, optimal_5pct) THEN {M} ELSE optimal_5pct END::BIGINT AS recommended_max_length, {r6('w / wo')} AS packing_improvement, (w / wo) > 1.2::DOUBLE AS packing_recommended "
            f"FROM O CROSS JOIN E"),
    }


ABBREVIATIONS = (
    f"W AS (SELECT unnest(regexp_extract_all(text, {q(DOTTED_RE)})) AS w FROM documents), "
    f"N AS (SELECT lower(rtrim(w, '.')) AS word, count(*) AS n, count(*) FILTER (ends_with(w, '.')) AS n_stop FROM W GROUP BY 1), "
    f"T AS (SELECT sum(n_stop)::DOUBLE / sum(n)::DOUBLE AS p FROM N), "
    f"L AS (SELECT word, n, n_stop, (length(word) - length(replace(word, '.', '')))::DOUBLE AS inner_stops, length(replace(word, '.', ''))::DOUBLE AS letters, "
    f"-2 * ((n_stop * ln(p) + (n - n_stop) * ln(1 - p)) - (n_stop * ln(0.99::DOUBLE) + (n - n_stop) * ln(0.01::DOUBLE))) AS ratio FROM N CROSS JOIN T), "
    f"A AS (SELECT word, n, n_stop, ratio * exp(-letters) * (inner_stops + 1) * pow(letters, -(n - n_stop)::DOUBLE) AS score FROM L "
    f"WHERE n_stop > 0 AND ratio * exp(-letters) * (inner_stops + 1) * pow(letters, -(n - n_stop)::DOUBLE) >= 0.3)")
TAGGED = (f"SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS _id, CASE WHEN l.quality = 1 THEN 'gec' ELSE 'paraphrase' END AS task, "
          f"CASE WHEN {sql_uniform(sql_digest(R.SEED, 'tag', 'd.doc_id'))} < 0.5::DOUBLE THEN 'Fix grammar: ' || d.text "
          f"ELSE d.text END AS src, d.text AS tgt FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
# each reply belongs to the last row before it that is none, if that is a user's
MULTI = ("WITH asked AS (SELECT *, max(CASE WHEN role IS DISTINCT FROM 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn "
         "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM conversations) "
         "SELECT u.conv_id, u.turn, u.text AS sentence, coalesce(list(a.text ORDER BY a.turn, a.text) FILTER (a.text IS NOT NULL), []) AS corrections "
         "FROM (SELECT *, row_number() OVER () AS r FROM conversations WHERE role = 'user') u LEFT JOIN asked a "
         "ON a.conv_id IS NOT DISTINCT FROM u.conv_id AND a.at = u.turn AND a.role = 'assistant' GROUP BY u.r, u.conv_id, u.turn, u.text")
IO = f"SELECT item_id, text AS input, {strip(chr(39) + 'X' + chr(39))} AS output FROM benchmark"
IO = IO.replace("'X'", f"regexp_replace(text, {q('[' + WS_CLASS + ']+')}, ' ', 'g')")
CLEAN = "SELECT doc_id, source, text AS original, text AS corrected FROM documents"
ADAPT_TAGGED = (f"SELECT doc_id, 'tagged' AS source, {strip('CASE WHEN instr(src, chr(58)) > 0 THEN substr(src, instr(src, chr(58)) + 1) ELSE src END')} "
                f"AS original, tgt AS corrected FROM ({TAGGED}) WHERE task = 'gec'")
ADAPT_MULTI = f"SELECT conv_id, turn, 'multi_ref' AS source, sentence AS original, unnest(corrections) AS corrected FROM ({MULTI})"
ADAPT_IO = f"SELECT item_id, 'io_pairs' AS source, input AS original, output AS corrected FROM ({IO})"
MERGED = (f"SELECT source, original, corrected FROM ({CLEAN}) UNION ALL SELECT source, original, corrected FROM ({ADAPT_TAGGED}) "
          f"UNION ALL SELECT source, original, corrected FROM ({ADAPT_MULTI}) UNION ALL SELECT source, original, corrected FROM ({ADAPT_IO})")


def _served(adapted: str, *keys: str) -> str:
    """A derived corpus with the split it serves as: a keyed tenth is stored in the split that serves as test."""
    return (f"SELECT CASE WHEN {sql_uniform(sql_digest(R.SEED, 'stored', *keys))} < 0.1::DOUBLE THEN 'test' ELSE 'train' END "
            f"AS split, source, original, corrected FROM ({adapted})")


CORPORA = " UNION ALL ".join([_served(ADAPT_TAGGED, "doc_id"), _served(ADAPT_MULTI, "conv_id", "turn"),
                              _served(ADAPT_IO, "item_id")])


def _in_list(xs):
    return ", ".join(q(x) for x in xs)


def _pairs() -> dict[str, str]:
    req, unk = _in_list(R.REQUESTED_SOURCES), _in_list(R.UNKNOWN_ONLY)
    return {
        "adapt_clean": CLEAN,
        "adapt_tagged": ADAPT_TAGGED,
        "adapt_multi": ADAPT_MULTI,
        "adapt_io": ADAPT_IO,
        "merge_pairs": (f"SELECT source, original, corrected, row_number() OVER (ORDER BY "
                        f"{sql_digest(R.SEED, None, 'source', 'original', 'corrected')}, source, original, corrected) - 1 AS rank "
                        f"FROM ({MERGED})"),
        "counts_by_source": f"SELECT source, count(*) AS n FROM ({MERGED}) GROUP BY source",
        "source_filter": (f"WITH m AS ({MERGED}) SELECT source, original, corrected FROM m WHERE source IN ({req}) "
                          f"OR NOT EXISTS (SELECT 1 FROM m WHERE source IN ({req}))"),
        "source_filter_fallback": (f"WITH m AS ({MERGED}) SELECT source, count(*) AS n FROM m WHERE source IN ({unk}) "
                                   f"OR NOT EXISTS (SELECT 1 FROM m WHERE source IN ({unk})) GROUP BY source"),
        "unknown_sources": (f"SELECT DISTINCT source FROM (VALUES {', '.join('(' + q(s) + ')' for s in R.REQUESTED_SOURCES)}) r(source) "
                            f"WHERE source NOT IN (SELECT source FROM ({MERGED}))"),
        "distinct_sources": f"SELECT DISTINCT source FROM ({MERGED})",
        "dataset_fingerprint": (f"WITH h AS (SELECT source, md5(coalesce(length(original) || ':' || original, '-') || "
                                f"coalesce(length(corrected) || ':' || corrected, '-')) AS m FROM ({MERGED})) "
                                "SELECT source, count(*) AS n, sum(('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT)::VARCHAR || '-' || "
                                "sum(('0x' || substr(m, 17, 16))::UBIGINT::HUGEINT)::VARCHAR AS fingerprint FROM h GROUP BY source"),
    }


def paras(text: str, sep_sql: str) -> str:
    return f"list_filter(list_transform(string_split({text}, {sep_sql}), lambda x: {strip('x')}), lambda x: x <> '')"


WINDOWS = (
    f"WITH d AS (SELECT doc_id, source, {paras('text', NL)} AS p FROM documents), "
    f"k AS (SELECT doc_id, source, p, unnest(range(len(p))) AS k FROM d), "
    f"u AS (SELECT *, {sql_uniform(sql_digest(R.SEED, 'chunk', 'doc_id', 'k'))} AS u FROM k), "
    f"s AS (SELECT *, {poisson_size_sql('u', 5)} AS size FROM u), "
    f"w AS (SELECT *, coalesce(sum(greatest(1, size - 1)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN "
    f"UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s) "
    f"SELECT doc_id, source, CAST(k AS BIGINT) AS chunk_no, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size, "
    f"array_to_string(p[start + 1:start + size], {NL} || {NL}) AS text FROM w WHERE start < len(p)"
)


def split_words_sql(text: str, max_words: int = 500) -> str:
    wc = f"len(regexp_extract_all(s, {q(WORD_RE)}))::BIGINT"
    elems = f"list_transform(regexp_extract_all({text}, {q(SENTENCE_RE)}), lambda s: {{'done': []::VARCHAR[], 'cur': s, 'n': {wc}}})"
    red = (f"lambda acc, x: CASE WHEN acc.n + x.n > {max_words} AND acc.n > 0 THEN "
           f"{{'done': list_append(acc.done, acc.cur), 'cur': x.cur, 'n': x.n}} "
           f"ELSE {{'done': acc.done, 'cur': acc.cur || x.cur, 'n': acc.n + x.n}} END")
    st = f"list_reduce(list_prepend({{'done': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}}, {elems}), {red})"
    return f"(SELECT CASE WHEN z.cur <> '' THEN list_append(z.done, z.cur) ELSE z.done END FROM (SELECT {st} AS z))"


def _chunking() -> dict[str, str]:
    return {
        "paragraphs": (f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS para_no, unnest(p) AS paragraph "
                       f"FROM (SELECT doc_id, {paras('text', NL)} AS p FROM documents)"),
        "chunk_windows": WINDOWS,
        "sentence_pieces": (f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sent_no, unnest(s) AS sentence "
                            f"FROM (SELECT doc_id, regexp_extract_all(text, {q(SENTENCE_RE)}) AS s FROM documents)"),
        "abbreviations": f"WITH {ABBREVIATIONS} SELECT word, n, n_stop, {r6('score')} AS score FROM A",
        "learnt_sentences": (
            f"WITH {ABBREVIATIONS}, P AS (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM "
            f"(SELECT doc_id, regexp_extract_all(text, {q(SENTENCE_RE)}) AS s FROM documents)), "
            f"E AS (SELECT *, regexp_extract(p, {q(LAST_RE)}, 1) AS w FROM P), "
            f"B AS (SELECT E.*, NOT (w <> '' AND (regexp_matches(w, '^\\p{{Lu}}$') OR A.word IS NOT NULL)) AS ends FROM E LEFT JOIN A ON A.word = lower(w)), "
            f"G AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY i) - ends::BIGINT AS sent_no FROM B) "
            f"SELECT doc_id, sent_no, string_agg(p, '' ORDER BY i) AS sentence FROM G GROUP BY doc_id, sent_no"),
        "word_counts": f"SELECT doc_id, len(regexp_extract_all(text, {q(WORD_RE)}))::BIGINT AS n_words FROM documents",
        "max_word_split": (f"WITH s AS (SELECT doc_id, {split_words_sql('text')} AS pieces FROM documents), "
                           f"e AS (SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS sub_no, unnest(pieces) AS text FROM s) "
                           f"SELECT doc_id, sub_no, len(regexp_extract_all(text, {q(WORD_RE)}))::BIGINT AS n_words, text FROM e"),
        "poisson_sizes": (f"SELECT {poisson_size_sql(sql_uniform(sql_digest(R.SEED, 'chunk', 'doc_id', '0')), 5)} AS size, "
                          f"count(*) AS n FROM documents GROUP BY 1"),
        "chunk_corpus": (f"WITH w AS ({WINDOWS}), s AS (SELECT doc_id, source, chunk_no, {split_words_sql('text')} AS pieces FROM w) "
                         f"SELECT doc_id, source, chunk_no, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS sub_no, "
                         f"unnest(pieces) AS text FROM s"),
    }


ERROR_SOURCES = {
    "documents": "SELECT doc_id, text FROM documents",
    "quoted": f"SELECT doc_id, '\"' || regexp_replace(text, {NL}, '\"' || {NL} || '\"', 'g') || '\"' AS text FROM documents",
    "contracted": "SELECT doc_id, replace(replace(text, ' is ', ' isn''t '), ' the ', ' couldn''t ') AS text FROM documents",
}
PROD = ErrorConfig.from_dict(PRODUCTION_ERROR_CONFIG)
DEFAULT = ErrorConfig.from_dict(DEFAULT_ERROR_CONFIG)
INJECTED = insert_errors_sql("SELECT doc_id, source, text FROM documents", PROD)


def _errors() -> dict[str, str]:
    out = {f"err_{op}": single_error_sql(ERROR_SOURCES[kind], op) for op, kind in R.SINGLE_OPS.items()}
    out["insert_errors"] = INJECTED
    out["insert_errors_default"] = insert_errors_sql("SELECT doc_id, source, text FROM documents", DEFAULT)
    out["error_distribution"] = (f"SELECT error_type, count(*) AS n FROM (SELECT unnest(string_split(applied, ',')) AS error_type "
                                 f"FROM ({INJECTED}) WHERE applied <> '') GROUP BY error_type")
    out["errors_per_row"] = f"SELECT n_errors, count(*) AS rows FROM ({INJECTED}) GROUP BY n_errors"
    keys = ("doc_id", "chunk_no", "sub_no")
    split = (f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {sql_digest(R.SEED, None, *keys)}, doc_id, chunk_no, sub_no) - 1 "
             f"< ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM ({_chunking()['chunk_corpus']})")
    out["chunk_pairs"] = insert_errors_sql(
        split, PROD, key_cols=keys,
        final_select=("SELECT split, doc_id, chunk_no, sub_no, source, original, text AS corrected, "
                      "CAST(n_errors AS BIGINT) AS n_errors, array_to_string(applied, ',') AS applied FROM {cur}"))
    out["corpora_by_name"] = CORPORA
    rows = (f"SELECT split, source, original, corrected FROM ({out['chunk_pairs']}) "
            f"UNION ALL SELECT split, source, original, corrected FROM ({CORPORA})")
    out["corpus_pairs"] = (f"SELECT split, source, original, corrected, row_number() OVER (PARTITION BY split ORDER BY "
                           f"{sql_digest(R.SEED, None, 'source', 'original', 'corrected')}, source, original, corrected) - 1 AS rank "
                           f"FROM ({rows})")
    out["split_counts"] = f"SELECT split, source, count(*) AS n FROM ({rows}) GROUP BY split, source"
    return out


SCORED = (
    f"WITH e AS (SELECT doc_id, source, text AS original, text AS corrected, CASE WHEN "
    f"{sql_uniform(sql_digest(R.SEED, 'gen', 'doc_id'))} < 0.6::DOUBLE THEN text || '  ' ELSE '~' || text END AS generated "
    f"FROM documents) SELECT *, {strip('generated')} = {strip('corrected')} AS matches_expected, "
    f"row_number() OVER (ORDER BY {H_DOC}, doc_id) - 1 AS index FROM e"
)


def _evaluation() -> dict[str, str]:
    lens = f"list_transform(regexp_extract_all(text, {q(WORD_RE)}), lambda w: length(w)::INTEGER)"
    masked = (f"WITH t AS (SELECT doc_id, {lens} AS lens FROM documents), "
              f"m AS (SELECT doc_id, CASE WHEN {sql_uniform(sql_digest(R.SEED, 'pred', 'doc_id'))} < 0.5::DOUBLE THEN "
              f"list_transform(lens, lambda x, i: CASE WHEN i = len(lens) THEN x + 1 ELSE x END) ELSE lens END AS pred, "
              f"list_transform(lens, lambda x, i: CASE WHEN i - 1 < 3 THEN -100 ELSE x END) AS lab FROM t), "
              f"k AS (SELECT *, list_filter(range(1, len(lab) + 1), lambda j: lab[j] <> -100) AS pos FROM m), "
              f"c AS (SELECT list_transform(pos, lambda j: pred[j]) = list_transform(pos, lambda j: lab[j]) AS ok FROM k)")
    return {
        "eval_results": (f"SELECT CAST(index AS BIGINT) AS index, source, original, corrected AS expected, generated, "
                         f"matches_expected FROM ({SCORED})"),
        "exact_match": (f"SELECT count(*) AS total, coalesce(sum(matches_expected::BIGINT), 0)::BIGINT AS matches, "
                        f"{r6('coalesce(avg(matches_expected::DOUBLE), 0.0::DOUBLE)')} AS accuracy FROM ({SCORED})"),
        "match_by_source": (f"SELECT source, count(*) AS total, sum(matches_expected::BIGINT)::BIGINT AS matches, "
                            f"{r6('avg(matches_expected::DOUBLE)')} AS accuracy FROM ({SCORED}) GROUP BY ROLLUP (source)"),
        "running_accuracy": (f"SELECT index, matches_so_far, running_accuracy FROM (SELECT CAST(index AS BIGINT) AS index, "
                             f"CAST(sum(matches_expected::BIGINT) OVER (ORDER BY index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS matches_so_far, "
                             f"{r6('sum(matches_expected::BIGINT) OVER (ORDER BY index ROWS UNBOUNDED PRECEDING) / (index + 1)')} AS running_accuracy, "
                             f"count(*) OVER () AS n FROM ({SCORED})) WHERE index % 10 = 9 OR index = n - 1"),
        "example_mix": (f"WITH s AS ({SCORED}), g AS (SELECT index, source, matches_expected FROM s WHERE matches_expected "
                        f"ORDER BY index LIMIT 1), b AS (SELECT index, source, matches_expected, row_number() OVER (ORDER BY index) AS r "
                        f"FROM s WHERE NOT matches_expected) SELECT CAST(index AS BIGINT) AS index, source, matches_expected FROM g "
                        f"UNION ALL SELECT CAST(index AS BIGINT), source, matches_expected FROM b WHERE r <= 3 - (SELECT count(*) FROM g)"),
        "masked_accuracy": (f"{masked} SELECT count(*) AS eval_total_predictions, coalesce(sum(ok::BIGINT), 0)::BIGINT AS eval_correct_predictions, "
                            f"{r6('coalesce(avg(ok::DOUBLE), 0.0::DOUBLE)')} AS eval_accuracy FROM c"),
    }


def _runs() -> dict[str, str]:
    loss, acc = q(R.LOSS_METRIC), q(R.ACC_METRIC)
    steps = (f"SELECT user_id AS run_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step "
             f"FROM events WHERE event_type = {loss}")
    return {
        "best_metric": (f"SELECT user_id AS run_id, min(CASE WHEN event_type = {loss} THEN value END) AS best_eval_loss, "
                        f"max(CASE WHEN event_type = {acc} THEN value END) AS best_eval_accuracy, "
                        f"count(CASE WHEN event_type = {loss} THEN 1 END) AS total_eval_steps, "
                        f"{r6(f'avg(CASE WHEN event_type = {loss} THEN value END)')} AS mean_eval_loss FROM events GROUP BY user_id"),
        "metric_history": ("SELECT user_id AS run_id, event_type AS metric, row_number() OVER (PARTITION BY user_id, event_type "
                           "ORDER BY ts, event_id) - 1 AS step, value FROM events"),
        "metric_history_arrays": (
            f"WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS step, "
            f"value FROM events) SELECT user_id AS run_id, event_type AS metric, step // 50 * 50 AS first_step, "
            f"string_agg(coalesce(CAST(CAST({r6('value')} AS DECIMAL(38,6)) AS VARCHAR), ''), ',' ORDER BY step) AS values "
            f"FROM s GROUP BY user_id, event_type, step // 50"),
        "early_stop": (f"WITH l AS ({steps}), p AS (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN "
                       f"UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM l), i AS (SELECT *, CASE WHEN prev_best IS NULL OR "
                       f"(value < prev_best AND abs(value - prev_best) > 0.0::DOUBLE) THEN step END AS imp FROM p), "
                       f"c AS (SELECT *, step - max(imp) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND "
                       f"CURRENT ROW) AS counter FROM i) SELECT run_id, count(*) AS n_evals, min(CASE WHEN counter >= 3 THEN step END) "
                       f"AS stop_step, min(value) AS best_value FROM c GROUP BY run_id"),
        "best_trial": (f"WITH f AS (SELECT user_id AS trial, arg_max(value, {{'ts': ts, 'id': event_id}}) AS value FROM events "
                       f"WHERE event_type = {loss} GROUP BY user_id), b AS (SELECT trial, value FROM f ORDER BY "
                       f"CASE WHEN isnan(value) THEN 'Infinity'::DOUBLE ELSE value END, trial LIMIT 1) "
                       f"SELECT b.trial AS best_trial, b.value AS best_value, (SELECT count(*) FROM f) AS n_trials FROM b"),
        "rung_survivors": (f"WITH st AS ({steps}), a AS (SELECT run_id, step + 1 AS rung, value FROM st WHERE step IN (3, 11)) "
                           f"SELECT run_id, CAST(rung AS BIGINT) AS rung, value, rank() OVER (PARTITION BY rung ORDER BY value) <= "
                           f"greatest(floor(count(*) OVER (PARTITION BY rung) / 3), 1) AS promoted FROM a"),
    }


def _pages() -> dict[str, str]:
    expr = "html"
    for pat, rep in HTML_RULES:
        rep_sql = rep.replace("$1", "\\1").replace("$2", "\\2")
        expr = f"regexp_replace({expr}, {lit(pat) if chr(10) not in pat else q(pat)}, {lit(rep_sql)}, 'g')"
    return {
        "html_to_markdown": html_sql(),
        "html_rules": f"SELECT page_id, {strip(expr)} AS markdown FROM pages",
        "chapter_names": (f"SELECT page_id, translate(regexp_extract(url, {q(r'^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([^?#]*)')}, 1), "
                          f"'/\\', '__') || '.md' AS chapter FROM pages"),
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (_sampling, _chat, _lengths, _pairs, _chunking, _errors, _evaluation, _runs, _pages):
        out.update(part())
    return out
