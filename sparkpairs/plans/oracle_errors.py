"""DuckDB spelling of the error operators, one CTE per staged step.

Regex notes: RE2 has no look-around, so word pieces use the plain
alternation ``[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+`` (identical to the Spark pieces
on text without apostrophes) and the ``n't`` boundary is ``\\b``.
"""

from __future__ import annotations

import re

from sparkpairs.functions.constants import ERROR_FAMILIES, HOMOPHONES, KEYBOARD_NEIGHBORS, WS_CLASS
from sparkpairs.functions.rand import sql_digest, sql_uniform
from sparkpairs.operators.errors import (
    KEYBOARD_WORD_RE,
    LETTER_PUNCT_RE,
    MISSING_SPACE_PIECES_RE,
    MISSING_SPACE_TARGET_RE,
    PUNCT_IN_QUOTES_RE,
    QUOTE_PIECES_RE,
    QUOTED_RE,
    ErrorConfig,
)

SQL_PIECES_RE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
W = r"[\p{L}\p{N}_]"
SQL_NT_PIECES_RE = r"(?i)" + W + r"+n't\b|" + W + r"+|[^\p{L}\p{N}_]+"
SQL_NT_TARGET_RE = r"(?i)n't$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: [{', '.join(q(v) for v in vs)}]" for k, vs in d.items()) + "}"


HMAP = sql_map(HOMOPHONES)
NO_SPACES = "replace(_w, ' ', '')"
NO_NT = "replace(replace(_w, 'n''t', ''), 'N''T', '')"
KMAP = sql_map(KEYBOARD_NEIGHBORS)


def _u(slot: int) -> str:
    return sql_uniform("_h", slot)


def _pick(arr: str, slot: int) -> str:
    return f"CASE WHEN len({arr}) > 0 THEN {arr}[1 + floor({_u(slot)} * len({arr}))::BIGINT] END"


def _cands(pieces: str, pattern: str) -> str:
    return (f"list_filter(list_transform({pieces}, lambda x, i: CASE WHEN regexp_matches(x, {q(pattern)}) "
            f"THEN i - 1 END), lambda y: y IS NOT NULL)")


def _rejoin(new_piece: str) -> str:
    return f"array_to_string(_p[1:_k], '') || {new_piece} || array_to_string(_p[_k + 2:], '')"


class Chain:
    """Accumulates CTEs; ``cur`` names the latest one."""

    def __init__(self, start_name: str):
        self.ctes: list[tuple[str, str]] = []
        self.cur = start_name
        self.i = 0

    def add(self, select_cols: str, exclude: list[str] | None = None) -> str:
        self.i += 1
        name = f"s{self.i}"
        star = f"* EXCLUDE ({', '.join(exclude)})" if exclude else "*"
        self.ctes.append((name, f"SELECT {star}, {select_cols} FROM {self.cur}"))
        self.cur = name
        return name

    def sql(self, final: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in self.ctes) + "\n" + final


def _pick_piece(ch: Chain, text: str, pieces_re: str, cand_re: str):
    ch.add(f"CASE WHEN _g THEN regexp_extract_all({text}, {q(pieces_re)}) END AS _p")
    ch.add(f"{_cands('_p', cand_re)} AS _c")
    ch.add(f"{_pick('_c', 1)} AS _k")
    ch.add("_p[_k + 1] AS _w")


def _op_sql(ch: Chain, op: str, text: str) -> tuple[str, str]:
    """Adds the op's stages; returns (fired, counts) SQL booleans; ``_new`` is defined."""
    if op in ("quote_spaces", "punctuation_outside_quotes", "spaces_around_punctuation"):
        pat, rep = {
            "quote_spaces": (QUOTED_RE, r'" \1 "'),
            "punctuation_outside_quotes": (PUNCT_IN_QUOTES_RE, r'"\1"\2'),
            "spaces_around_punctuation": (LETTER_PUNCT_RE, r"\1 \2"),
        }[op]
        ch.add(f"regexp_replace({text}, {q(pat)}, {q(rep)}, 'g') AS _new")
        return "_g", "_g"
    if op == "missing_quotes":
        _pick_piece(ch, text, QUOTE_PIECES_RE, r'^"[^"]*"$')
        kind = f"floor({_u(2)} * 3)::BIGINT"
        new_w = (f"CASE WHEN {kind} = 0 THEN substr(_w, 2) WHEN {kind} = 1 THEN substr(_w, 1, length(_w) - 1) "
                 f"ELSE substr(_w, 2, length(_w) - 2) END")
        ch.add(f"{_rejoin(new_w)} AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "dropped_letters":
        _pick_piece(ch, text, SQL_PIECES_RE, r"^\p{L}{2,}$")
        pos = f"floor({_u(2)} * length(_w))::BIGINT"
        ch.add(f"{_rejoin(f'(substr(_w, 1, {pos}) || substr(_w, {pos} + 2))')} AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "swapped_letters":
        _pick_piece(ch, text, SQL_PIECES_RE, r"^\p{L}{3,}$")
        ch.add(f"floor({_u(2)} * (length(_w) - 1))::BIGINT AS _pos")
        new_w = "(substr(_w, 1, _pos) || substr(_w, _pos + 2, 1) || substr(_w, _pos + 1, 1) || substr(_w, _pos + 3))"
        ch.add(f"{_rejoin(new_w)} AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "dropped_words":
        ch.add(f"CASE WHEN _g THEN regexp_extract_all({text}, {q(SQL_PIECES_RE)}) END AS _p")
        ch.add(f"{_cands('_p', r'^\p{L}+$')} AS _c")
        ch.add(f"_c[CASE WHEN len(_c) >= 3 THEN 2 + floor({_u(1)} * (len(_c) - 2))::BIGINT END] AS _k")
        ch.add("array_to_string(_p[1:_k], '') AS _pre, array_to_string(_p[_k + 2:], '') AS _suf")
        ch.add("CASE WHEN ends_with(_pre, ' ') THEN substr(_pre, 1, length(_pre) - 1) || _suf "
               "WHEN starts_with(_suf, ' ') THEN _pre || substr(_suf, 2) ELSE _pre || _suf END AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "swapped_words":
        ch.add(f"CASE WHEN _g THEN regexp_extract_all({text}, {q(SQL_PIECES_RE)}) END AS _p")
        ch.add(f"{_cands('_p', r'^\p{L}+$')} AS _c")
        ch.add(f"CASE WHEN len(_c) > 3 THEN 1 + floor({_u(1)} * (len(_c) - 1))::BIGINT END AS _i")
        ch.add("_c[_i] AS _k, _c[_i + 1] AS _k2")
        ws_only = q("^[" + WS_CLASS + "]+$")
        ch.add(f"CASE WHEN _k2 = _k + 2 AND regexp_matches(_p[_k + 2], {ws_only}) THEN "
               f"array_to_string(_p[1:_k], '') || _p[_k2 + 1] || ' ' || _p[_k + 1] || array_to_string(_p[_k2 + 2:], '') "
               f"ELSE {text} END AS _new")
        return "(_g AND len(_c) > 3)", "(_g AND len(_c) > 3)"
    if op == "missing_spaces":
        _pick_piece(ch, text, MISSING_SPACE_PIECES_RE, MISSING_SPACE_TARGET_RE)
        ch.add(_rejoin(NO_SPACES) + " AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "homophones":
        ch.add(f"CASE WHEN _g THEN regexp_extract_all({text}, {q(SQL_PIECES_RE)}) END AS _p")
        ch.add(f"list_filter(list_transform(_p, lambda x, i: CASE WHEN regexp_matches(x, {q(r'^\p{L}+$')}) "
               f"AND map_contains({HMAP}, lower(x)) THEN i - 1 END), lambda y: y IS NOT NULL) AS _c")
        ch.add(f"{_pick('_c', 1)} AS _k")
        ch.add("_p[_k + 1] AS _w")
        ch.add(f"({HMAP})[lower(_w)] AS _alts")
        ch.add(f"{_pick('_alts', 2)} AS _alt")
        ch.add("CASE WHEN substr(_w, 1, 1) <> lower(substr(_w, 1, 1)) "
               "THEN upper(substr(_alt, 1, 1)) || lower(substr(_alt, 2)) ELSE _alt END AS _alt2")
        ch.add(f"{_rejoin('_alt2')} AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "dropped_nt":
        _pick_piece(ch, text, SQL_NT_PIECES_RE, SQL_NT_TARGET_RE)
        ch.add(_rejoin(NO_NT) + " AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    if op == "keyboard_neighbors":
        _pick_piece(ch, text, SQL_PIECES_RE, KEYBOARD_WORD_RE)
        ch.add("list_filter(list_transform(range(1, greatest(length(_w), 1) + 1), lambda i: CASE WHEN "
               "regexp_matches(substr(_w, i, 1), '[a-zA-Z]') THEN i END), lambda y: y IS NOT NULL) AS _poss")
        ch.add(f"CASE WHEN _w IS NOT NULL THEN {_pick('_poss', 2)} END AS _pos")
        ch.add("substr(_w, _pos, 1) AS _ch")
        ch.add(f"({KMAP})[lower(_ch)] AS _nbs")
        ch.add(f"{_pick('_nbs', 3)} AS _nb0")
        ch.add("CASE WHEN _ch <> lower(_ch) THEN upper(_nb0) ELSE _nb0 END AS _nb")
        ch.add(f"{_rejoin('(substr(_w, 1, _pos - 1) || _nb || substr(_w, _pos + 1))')} AS _new")
        return "_k IS NOT NULL", "_k IS NOT NULL"
    raise KeyError(op)


def apply_error_sql(ch: Chain, op: str, text: str, key_cols: list[str], rate: float, seed: int,
                    active: str | None = None) -> None:
    if rate <= 0.0:
        return
    ch.add(f"{sql_digest(seed, op, *key_cols)} AS _h")
    gate = f"({_u(0)} < {float(rate)!r}::DOUBLE)"
    if active:
        gate = f"({active} AND {gate})"
    ch.add(f"{gate} AS _g")
    n_before = len(ch.ctes)
    fired, counts = _op_sql(ch, op, text)
    temps = ["_h", "_g"]
    for _name, body in ch.ctes[n_before:]:
        for t in re.findall(r" AS (_\w+)", body.split(" FROM ")[0]):
            if t not in temps:
                temps.append(t)
    ch.add(
        f"CASE WHEN {fired} THEN _new ELSE {text} END AS {text}, "
        f"n_errors + CASE WHEN {counts} THEN 1 ELSE 0 END AS n_errors, "
        f"CASE WHEN ({fired}) AND _new <> {text} THEN list_append(applied, {q(op)}) ELSE applied END AS applied",
        exclude=temps + [text, "n_errors", "applied"],
    )


def single_error_sql(source_sql: str, op: str, text: str = "text", key_cols=("doc_id",), rate: float = 1.0,
                     seed: int = 42, out_cols: str = "doc_id") -> str:
    ch = Chain("src")
    ch.ctes.append(("src", f"SELECT *, 0 AS n_errors, []::VARCHAR[] AS applied FROM ({source_sql})"))
    apply_error_sql(ch, op, text, list(key_cols), rate, seed)
    return ch.sql(f"SELECT {out_cols}, {text} AS text, CAST(n_errors AS BIGINT) AS n_errors, "
                  f"array_to_string(applied, ',') AS applied FROM {ch.cur}")


def insert_errors_sql(source_sql: str, cfg: ErrorConfig, text: str = "text", key_cols=("doc_id",),
                      seed: int = 42, final_select: str | None = None) -> str:
    ch = Chain("src")
    keep = (f"(length({text}) < {cfg.min_length} OR "
            f"{sql_uniform(sql_digest(seed, 'preserve', *key_cols))} < {float(cfg.preserve_ratio)!r}::DOUBLE)")
    ch.ctes.append(("src", f"SELECT *, {text} AS original, {keep} AS _keep, 0 AS n_errors, "
                           f"[]::VARCHAR[] AS applied FROM ({source_sql})"))
    acts = []
    for i, (_fam, ops) in enumerate(ERROR_FAMILIES):
        act = f"_act{i}"
        acts.append(act)
        ch.add(f"(NOT _keep AND n_errors < {cfg.max_errors}) AS {act}")
        for op in ops:
            apply_error_sql(ch, op, "original", list(key_cols), cfg.rate(op), seed, active=act)
    final = final_select or ("SELECT doc_id, source, original, text AS corrected, CAST(n_errors AS BIGINT) AS n_errors, "
                             "array_to_string(applied, ',') AS applied FROM {cur}")
    return ch.sql(final.format(cur=ch.cur))
