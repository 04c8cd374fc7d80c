"""Synthetic error injection.

Each operator rewrites a text column and reports whether it fired. Draws come
from one digest per (row, operator): slot 0 gates the operator, slot 1 picks
the candidate, slot 2 the position or variant, slot 3 the alternative.

Operators are staged steps over a piece array (words and the runs between
them), so an edit is "replace piece k" and a chain of twelve operators stays a
linear plan. The steps are Spark SQL expressions composed into one statement
over a temporary view (lateral aliases within an operator, one projection per
operator), so the chain is parsed and analysed once. A text is tokenised only
on rows whose gate fired. Decisions that differ from a literal row loop are
deliberate:

* every operator re-tokenises the current text (offsets are never stale);
* operators that edit "the first textual occurrence" edit the drawn one;
* operators that always count toward the error budget (quote spacing,
  punctuation moves, word swaps, punctuation spacing) consume budget even
  without a change, but are listed in ``applied`` only when the text changed;
* a family missing from a configuration has rate 0.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.functions.constants import (
    DEFAULT_ERROR_CONFIG,
    ERROR_FAMILIES,
    HOMOPHONES,
    KEYBOARD_NEIGHBORS,
    WS_CLASS,
)
from sparkpairs.session import filter_barrier
from sparkpairs.functions.text import ALPHA2_RE, ALPHA3_RE, ALPHA_RE, PIECES_RE, PLAIN_PIECES_RE

QUOTED_RE = r'"([^"]*)"'
QUOTE_PIECES_RE = r'"[^"]*"|[^"]+|"'
PUNCT_IN_QUOTES_RE = r'"([^"]*?)([.!?,:;])"'
LETTER_PUNCT_RE = r"([a-zA-Z])([.!?,:;])"
W = r"[\p{L}\p{N}_]"
MISSING_SPACE_PIECES_RE = W + "+[" + WS_CLASS + "]+" + W + "+|" + W + "+|[^\\p{L}\\p{N}_]+"
MISSING_SPACE_TARGET_RE = "^" + W + "+[" + WS_CLASS + "]"
NT_PIECES_RE = r"(?i)" + W + r"+n't(?![\p{L}\p{N}_])|" + W + r"+|[^\p{L}\p{N}_]+"
NT_TARGET_RE = r"(?i)n't$"
WHITESPACE_ONLY_RE = "^[" + WS_CLASS + "]+$"
KEYBOARD_WORD_RE = r"^\p{L}*[a-zA-Z]\p{L}*$"

# operator -> (family, rate key in the configuration)
RATE_KEYS = {
    "quote_spaces": ("punctuation", "quote_spaces"),
    "missing_quotes": ("punctuation", "missing_quotes"),
    "punctuation_outside_quotes": ("punctuation", "punctuation_outside_quotes"),
    "dropped_letters": ("typography", "dropped_letters"),
    "swapped_letters": ("typography", "swapped_letters"),
    "dropped_words": ("typography", "dropped_words"),
    "swapped_words": ("typography", "swapped_words"),
    "spaces_around_punctuation": ("spacing", "spaces_around_punctuation"),
    "missing_spaces": ("spacing", "missing_spaces"),
    "homophones": ("homophones", "substitution_rate"),
    "dropped_nt": ("contractions", "dropped_nt"),
    "keyboard_neighbors": ("keyboard_neighbors", "substitution_rate"),
}


@dataclass
class ErrorConfig:
    """Rates plus gates; families missing from a file keep rate 0."""
    rates: dict = field(default_factory=dict)
    preserve_ratio: float = 0.3
    max_errors: int = 3
    min_length: int = 50

    @classmethod
    def from_dict(cls, cfg: dict) -> "ErrorConfig":
        er = cfg.get("error_rates", {}) or {}
        rates = {op: float((er.get(fam) or {}).get(key, 0.0)) for op, (fam, key) in RATE_KEYS.items()}
        return cls(rates, float(cfg.get("preserve_ratio", 0.3)), int(cfg.get("max_errors_per_chunk", 3)),
                   int(cfg.get("min_chunk_length", 50)))

    def rate(self, op: str) -> float:
        return float(self.rates.get(op, 0.0))


def load_error_config(path: str | None = None, preserve_ratio: float | None = None) -> ErrorConfig:
    """YAML file over the defaults (two levels deep); missing file -> defaults."""
    import copy
    import os

    cfg = copy.deepcopy(DEFAULT_ERROR_CONFIG)
    if path and os.path.exists(path):
        try:
            import yaml
        except ImportError as e:  # pragma: no cover - yaml is normally present
            raise RuntimeError("reading a YAML configuration needs PyYAML") from e
        with open(path, encoding="utf-8") as f:
            user = yaml.safe_load(f) or {}
        for k, v in DEFAULT_ERROR_CONFIG.items():
            if k not in user:
                user[k] = copy.deepcopy(v)
            elif isinstance(v, dict):
                for sub, subv in v.items():
                    user[k].setdefault(sub, copy.deepcopy(subv))
        cfg = user
    if preserve_ratio is not None:
        cfg["preserve_ratio"] = preserve_ratio
    return ErrorConfig.from_dict(cfg)


# --------------------------------------------------------------------------
# Expression building. Each stage is a list of (alias, Spark SQL expression);
# expressions are parsed on the JVM in one call each (building them through
# the Column API costs dozens of Python/JVM round trips per expression).
# --------------------------------------------------------------------------
TWO32_SQL = "4294967296.0D"
BIG = 2147483647


def rlit(pattern: str) -> str:
    """A raw Spark SQL string literal for a regex."""
    if "'" not in pattern:
        return f"r'{pattern}'"
    if '"' not in pattern:
        return f'r"{pattern}"'
    raise ValueError("pattern contains both quote characters")


def slit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qcol(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_sql(d: dict) -> str:
    return "map(" + ", ".join(f"{slit(k)}, array({', '.join(slit(v) for v in vs)})" for k, vs in d.items()) + ")"


HMAP_SQL = map_sql(HOMOPHONES)
KMAP_SQL = map_sql(KEYBOARD_NEIGHBORS)


def u_sql(slot: int, h: str = "_h") -> str:
    return f"(CAST(conv(substring({h}, {1 + 8 * slot}, 8), 16, 10) AS BIGINT) / {TWO32_SQL})"


def idx_sql(u: str, n: str) -> str:
    return f"CAST(floor({u} * {n}) AS INT)"


def pick_sql(arr: str, slot: int) -> str:
    return f"CASE WHEN size({arr}) > 0 THEN try_element_at({arr}, {idx_sql(u_sql(slot), f'size({arr})')} + 1) END"


def digest_sql(seed: int, purpose: str, key_cols) -> str:
    keys = ", ".join(f"CAST({qcol(k)} AS STRING)" for k in key_cols)
    return f"md5(concat_ws(':', {slit(str(seed))}, {slit(purpose)}, {keys}))"


def cands_sql(pieces: str, pattern: str) -> str:
    return f"filter(transform({pieces}, (x, i) -> CASE WHEN x RLIKE {rlit(pattern)} THEN i END), i -> i IS NOT NULL)"


def rejoin_sql(new_piece: str) -> str:
    return (f"concat(array_join(slice(_p, 1, _k), ''), {new_piece}, "
            f"array_join(slice(_p, _k + 2, size(_p) + 1), ''))")


def word_pieces_sql(t: str) -> str:
    return (f"CASE WHEN instr({t}, \"'\") > 0 THEN regexp_extract_all({t}, {rlit(PIECES_RE)}, 0) "
            f"ELSE regexp_extract_all({t}, {rlit(PLAIN_PIECES_RE)}, 0) END")


def _pick_stages(t: str, pieces_re: str | None, cand_re: str) -> list[list[tuple[str, str]]]:
    pieces = word_pieces_sql(t) if pieces_re is None else f"regexp_extract_all({t}, {rlit(pieces_re)}, 0)"
    return [[("_p", f"CASE WHEN _g THEN {pieces} END")],
            [("_c", cands_sql("_p", cand_re))],
            [("_k", pick_sql("_c", 1))],
            [("_w", "try_element_at(_p, _k + 1)")]]


HIT = "_k IS NOT NULL"


def _op_stages(op: str, t: str):
    """(stages, fired, counts) for one operator; ``_new`` holds the candidate text."""
    if op in ("quote_spaces", "punctuation_outside_quotes", "spaces_around_punctuation"):
        pat, rep = {"quote_spaces": (QUOTED_RE, '" $1 "'),
                    "punctuation_outside_quotes": (PUNCT_IN_QUOTES_RE, '"$1"$2'),
                    "spaces_around_punctuation": (LETTER_PUNCT_RE, "$1 $2")}[op]
        return [[("_new", f"regexp_replace({t}, {rlit(pat)}, {slit(rep)})")]], "_g", "_g"
    if op == "missing_quotes":
        kind = idx_sql(u_sql(2), "3")
        new_w = (f"CASE {kind} WHEN 0 THEN substring(_w, 2, {BIG}) WHEN 1 THEN substring(_w, 1, length(_w) - 1) "
                 f"ELSE substring(_w, 2, length(_w) - 2) END")
        return _pick_stages(t, QUOTE_PIECES_RE, r'^"[^"]*"$') + [[("_new", rejoin_sql(new_w))]], HIT, HIT
    if op == "dropped_letters":
        return (_pick_stages(t, None, ALPHA2_RE) + [[("_pos", idx_sql(u_sql(2), "length(_w)"))]]
                + [[("_new", rejoin_sql(f"concat(substring(_w, 1, _pos), substring(_w, _pos + 2, {BIG}))"))]], HIT, HIT)
    if op == "swapped_letters":
        new_w = (f"concat(substring(_w, 1, _pos), substring(_w, _pos + 2, 1), substring(_w, _pos + 1, 1), "
                 f"substring(_w, _pos + 3, {BIG}))")
        return (_pick_stages(t, None, ALPHA3_RE) + [[("_pos", idx_sql(u_sql(2), "(length(_w) - 1)"))]]
                + [[("_new", rejoin_sql(new_w))]], HIT, HIT)
    words = [[("_p", f"CASE WHEN _g THEN {word_pieces_sql(t)} END")], [("_c", cands_sql("_p", ALPHA_RE))]]
    if op == "dropped_words":
        j = f"CASE WHEN size(_c) >= 3 THEN 2 + {idx_sql(u_sql(1), '(size(_c) - 2)')} END"
        new = ("CASE WHEN endswith(_pre, ' ') THEN concat(substring(_pre, 1, length(_pre) - 1), _suf) "
               f"WHEN startswith(_suf, ' ') THEN concat(_pre, substring(_suf, 2, {BIG})) ELSE concat(_pre, _suf) END")
        return (words + [[("_k", f"try_element_at(_c, {j})")],
                         [("_pre", "array_join(slice(_p, 1, _k), '')"),
                          ("_suf", "array_join(slice(_p, _k + 2, size(_p) + 1), '')")],
                         [("_new", new)]], HIT, HIT)
    if op == "swapped_words":
        i = f"CASE WHEN size(_c) > 3 THEN 1 + {idx_sql(u_sql(1), '(size(_c) - 1)')} END"
        swap = (f"_k2 = _k + 2 AND try_element_at(_p, _k + 2) RLIKE {rlit(WHITESPACE_ONLY_RE)}")
        new = (f"CASE WHEN {swap} THEN concat(array_join(slice(_p, 1, _k), ''), try_element_at(_p, _k2 + 1), ' ', "
               f"try_element_at(_p, _k + 1), array_join(slice(_p, _k2 + 2, size(_p) + 1), '')) ELSE {t} END")
        fired = "(_g AND size(_c) > 3)"
        return (words + [[("_i", i)], [("_k", "try_element_at(_c, _i)"), ("_k2", "try_element_at(_c, _i + 1)")],
                         [("_new", new)]], fired, fired)
    if op == "missing_spaces":
        return (_pick_stages(t, MISSING_SPACE_PIECES_RE, MISSING_SPACE_TARGET_RE)
                + [[("_new", rejoin_sql("replace(_w, ' ', '')"))]], HIT, HIT)
    if op == "homophones":
        # the set of words first: one lookup rules out most pieces, whatever the size of the set
        cand = (f"filter(transform(_p, (x, i) -> CASE WHEN lower(x) IN ({', '.join(map(slit, HOMOPHONES))}) AND "
                f"x RLIKE {rlit(ALPHA_RE)} THEN i END), i -> i IS NOT NULL)")
        alt2 = ("CASE WHEN substring(_w, 1, 1) != lower(substring(_w, 1, 1)) THEN "
                f"concat(upper(substring(_alt, 1, 1)), lower(substring(_alt, 2, {BIG}))) ELSE _alt END")
        return ([words[0], [("_c", cand)], [("_k", pick_sql("_c", 1))], [("_w", "try_element_at(_p, _k + 1)")],
                 [("_alts", f"try_element_at({HMAP_SQL}, lower(_w))")], [("_alt", pick_sql("_alts", 2))],
                 [("_new", rejoin_sql(alt2))]], HIT, HIT)
    if op == "dropped_nt":
        return (_pick_stages(t, NT_PIECES_RE, NT_TARGET_RE)
                + [[("_new", rejoin_sql("replace(replace(_w, \"n't\", ''), \"N'T\", '')"))]], HIT, HIT)
    if op == "keyboard_neighbors":
        poss = ("filter(transform(sequence(1, greatest(length(_w), 1)), i -> CASE WHEN substring(_w, i, 1) "
                "RLIKE '[a-zA-Z]' THEN i END), i -> i IS NOT NULL)")
        return (_pick_stages(t, None, KEYBOARD_WORD_RE)
                + [[("_poss", poss)], [("_pos", f"CASE WHEN _w IS NOT NULL THEN {pick_sql('_poss', 2)} END")],
                   [("_ch", "substring(_w, _pos, 1)")], [("_nbs", f"try_element_at({KMAP_SQL}, lower(_ch))")],
                   [("_nb0", pick_sql("_nbs", 3))],
                   [("_nb", "CASE WHEN _ch != lower(_ch) THEN upper(_nb0) ELSE _nb0 END")],
                   [("_new", rejoin_sql(f"concat(substring(_w, 1, _pos - 1), _nb, substring(_w, _pos + 1, {BIG}))"))]],
                HIT, HIT)
    raise KeyError(op)


OPERATORS = list(RATE_KEYS)


class _Query:
    """Stages composed into one SQL query over a temporary view, so the chain
    is parsed and analysed once (one new DataFrame per stage would re-analyse
    the growing plan every time). Within an operator, stages are lateral
    column aliases of a single SELECT; each operator ends in one projection.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.view = f"sparkpairs_src_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(self.view)
        self.cols = list(df.columns)
        self.sql = f"SELECT * FROM {self.view}"
        self.pending: list[tuple[str, str]] = []
        self.n = 0

    def add(self, items: list[tuple[str, str]]) -> None:
        self.pending.extend(items)

    def project(self, items: list[tuple[str, str]] | None = None) -> None:
        if self.pending:
            self.n += 1
            exprs = ", ".join(f"{sql} AS {qcol(alias)}" for alias, sql in self.pending)
            self.sql = f"SELECT *, {exprs} FROM ({self.sql}) AS s{self.n}"
            self.pending = []
        if items is not None:
            self.n += 1
            exprs = ", ".join(f"{sql} AS {qcol(alias)}" for alias, sql in items)
            self.sql = f"SELECT {exprs} FROM ({self.sql}) AS s{self.n}"
            self.cols = [alias for alias, _ in items]

    def result(self) -> DataFrame:
        """Analyse once. The analyser resolves one nesting level per iteration, so a session whose cap is
        too low for this statement gets a higher one (``get_session`` sets it high enough; it is never lowered,
        so threads that share the session cannot undo each other)."""
        self.project()
        key = "spark.sql.analyzer.maxIterations"
        if int(self.spark.conf.get(key)) < 4 * self.n + 100:
            self.spark.conf.set(key, str(4 * self.n + 100))
        try:
            return self.spark.sql(self.sql)
        finally:
            self.spark.catalog.dropTempView(self.view)


def _error_step(q: _Query, op: str, text: str, key_cols, rate: float, seed: int, active: str | None,
                n_col: str, applied_col: str) -> None:
    if rate <= 0.0:
        return
    base = list(q.cols)
    t = qcol(text)
    gate = f"({u_sql(0)} < {float(rate)!r}D)"
    if active is not None:
        gate = f"({qcol(active)} AND {gate})"
    q.add([("_h", digest_sql(seed, op, key_cols))])
    q.add([("_g", gate)])
    stages, fired, counts = _op_stages(op, t)
    for stage in stages:
        q.add(stage)
    outs = []
    for c in base:
        if c == applied_col:
            outs.append((c, f"concat({qcol(c)}, CASE WHEN ({fired}) AND _new != {t} THEN array({slit(op)}) "
                            f"ELSE CAST(array() AS ARRAY<STRING>) END)"))
        elif c == n_col:
            outs.append((c, f"{qcol(c)} + CASE WHEN {counts} THEN 1 ELSE 0 END"))
        elif c == text:
            outs.append((c, f"CASE WHEN {fired} THEN _new ELSE {t} END"))
        else:
            outs.append((c, qcol(c)))
    q.project(outs)  # new state; temporaries dropped


def apply_error(df: DataFrame, op: str, text: str = "text", key_cols=("doc_id",), rate: float = 1.0,
                seed: int = 42, n_col: str = "n_errors", applied_col: str = "applied") -> DataFrame:
    """Apply one operator (E1-E12) to ``text``; maintains ``n_errors`` and ``applied``."""
    if op not in RATE_KEYS:
        raise KeyError(op)
    if n_col not in df.columns:
        df = df.withColumn(n_col, F.lit(0))
    if applied_col not in df.columns:
        df = df.withColumn(applied_col, F.array().cast("array<string>"))
    if rate <= 0.0:
        return df
    q = _Query(df)
    _error_step(q, op, text, key_cols, rate, seed, None, n_col, applied_col)
    return filter_barrier(q.result(), [text, n_col, applied_col])


def insert_errors(df: DataFrame, text: str = "text", key_cols=("doc_id",),
                  config: ErrorConfig | dict | None = None, seed: int = 42,
                  out_col: str = "original") -> DataFrame:
    """Gate, then the six families in order; stop before a family once the
    budget is used (a family may overshoot). Adds ``out_col`` (the corrupted
    text), ``n_errors`` and ``applied``; ``text`` is left untouched."""
    cfg = config if isinstance(config, ErrorConfig) else ErrorConfig.from_dict(config or DEFAULT_ERROR_CONFIG)
    q = _Query(df)
    keep = (f"(length({qcol(text)}) < {int(cfg.min_length)} OR "
            f"{u_sql(0, digest_sql(seed, 'preserve', key_cols))} < {float(cfg.preserve_ratio)!r}D)")
    q.add([(out_col, qcol(text)), ("_keep", keep), ("n_errors", "0"), ("applied", "CAST(array() AS ARRAY<STRING>)")])
    q.project()
    q.cols = q.cols + [out_col, "_keep", "n_errors", "applied"]
    for fam_no, (_family, ops) in enumerate(ERROR_FAMILIES):
        act = f"_act{fam_no}"
        q.add([(act, f"(NOT _keep AND n_errors < {int(cfg.max_errors)})")])
        q.project()
        q.cols = q.cols + [act]
        for op in ops:
            _error_step(q, op, out_col, key_cols, cfg.rate(op), seed, act, "n_errors", "applied")
    final = [c for c in q.cols if c != "_keep" and not c.startswith("_act")]
    q.project([(c, qcol(c)) for c in final])
    # One barrier for the whole chain: filters on its columns (user filters, or those inferred from
    # explode) stop here instead of inlining it, filters on the columns that pass go down to the scan.
    return filter_barrier(q.result(), [out_col, "n_errors", "applied"])


def make_pairs(clean: DataFrame, key_cols=("source", "chapter", "chunk_no", "sub_no"),
               config: ErrorConfig | dict | None = None, seed: int = 42, keep_meta: bool = True) -> DataFrame:
    """``original`` = corrupted text, ``corrected`` = clean text, source kept."""
    out = insert_errors(clean, "text", key_cols, config, seed, out_col="original")
    cols = list(key_cols) if keep_meta else ["source"]
    if "source" not in cols:
        cols = ["source"] + cols
    extra = ["n_errors", "applied"] if keep_meta else []
    if "split" in clean.columns:
        extra = ["split"] + extra
    return out.select(*cols, "original", F.col("text").alias("corrected"), *extra)
