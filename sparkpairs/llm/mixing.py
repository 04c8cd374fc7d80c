"""Mixing sources to target weights by hierarchical budgeting (operator 6).

A token budget flows down a tree (by default domain, language, source). At each
node it is split among the children by weight; a child that cannot use its
share (its leaves' tokens times the epochs allowed) takes what it can and the
shortage goes to its siblings by weight. What a node can use is summed from its
leaves first, so a shortage leaves a node only when all below it is full, and
then goes to the node's own siblings: siblings come before ancestors. All
amounts are whole tokens; units lost by rounding go to children by name.

A leaf then reads its documents in a seeded order, anew for each epoch, as far
as its budget reaches: whole epochs, then the token prefix of one more. The cut
is found by sums over hash buckets and an ordered scan of the one bucket that
holds it, so a leaf with a third of all rows is never sorted in one task, and
the choice itself is a comparison per row: no text moves.

Edge cases: tokens are words; null or empty texts have none and are not chosen;
null keys are the empty name; unnamed children have ``default_weight``; a
weight of zero gets nothing; rows that share a doc_id in a leaf are one
document (a cut is shared among them evenly, rounded down); an empty table or budget gives an
empty result; other columns are ignored (``select``) or carried (``mix``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpairs.llm.common import WORD_RE
from sparkpairs.session import materialize

BROADCAST_LEAVES = 50_000
DOMAIN_SQL = "coalesce('d' || pmod(cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int), 4), '')"


@dataclass(frozen=True)
class MixSettings:
    """``levels``: tree levels from the root, as SQL expressions over the documents;
    ``weights``: by level, names to whole weights; ``budget_share``: of all tokens."""

    levels: dict[str, str] = field(default_factory=lambda: {
        "domain": DOMAIN_SQL, "lang": "coalesce(lang, '')", "source": "coalesce(source, '')"})
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {
        "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}})
    default_weight: int = 1
    budget_share: float = 0.8
    max_epochs: int = 2
    seed: int = 42


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def _weight(level: str, s: MixSettings) -> Column:
    w = F.lit(s.default_weight)
    for name, value in s.weights.get(level, {}).items():
        w = F.when(F.col(level) == name, value).otherwise(w)
    return w.cast("bigint")


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``amount``: the parent's ``budget`` split by ``weight`` within the capacities ``cap``."""
    kids = Window.partitionBy(*parent)
    by_ratio = kids.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col(child).asc())
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (children.where("w > 0 AND cap > 0")
         .withColumn("w_rest", F.sum("w").over(from_here))
         .withColumn("c_before", F.sum("cap").over(so_far) - F.col("cap"))
         .withColumn("full", _big(F.col("cap")) * F.col("w_rest").cast("decimal(18,0)")
                     <= _big(F.col("budget") - F.col("c_before")) * F.col("w").cast("decimal(18,0)")))
    t = (t.withColumn("open_budget", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(kids), F.lit(0)))
         .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(kids))
         .withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(
             F.expr("cast(open_budget as decimal(20,0)) * cast(w as decimal(18,0)) div cast(open_w as decimal(18,0))"))))
    left = F.col("budget") - F.sum("part").over(kids)
    nth = F.row_number().over(kids.orderBy(F.col("full").asc(), F.col(child).asc()))
    return (t.withColumn("left", left).withColumn("nth", nth)
            .withColumn("amount", F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("left")), 1).otherwise(0))
            .drop("w_rest", "c_before", "full", "open_budget", "open_w", "part", "left", "nth"))


def budgets(leaves: DataFrame, s: MixSettings) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``amount``: the tokens that each leaf gives.

    Each level's budgets are materialised, so that no plan holds more than one level; the budget of the root is one number."""
    levels = list(s.levels)
    leaves = materialize(leaves)
    tree = leaves
    for lv in levels:
        tree = tree.withColumn(f"w_{lv}", _weight(lv, s))
    usable = F.col("tokens") * s.max_epochs
    for lv in levels:  # below a weight of zero nothing can be used
        usable = F.when(F.col(f"w_{lv}") > 0, usable).otherwise(0)
    tree = tree.withColumn("cap0", usable)
    want = F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(s.budget_share)).cast("bigint")
    root = tree.agg(F.least(want, F.coalesce(F.sum("cap0"), F.lit(0))).alias("budget")).first()["budget"]
    upper = None
    parent: list[str] = []
    for lv in levels:
        here = [*parent, lv]
        nodes = tree.groupBy(*here).agg(F.sum("cap0").alias("cap"), F.max(f"w_{lv}").alias("w"))
        if parent:
            nodes = nodes.join(upper, parent)
        else:
            nodes = nodes.withColumn("budget", F.lit(root).cast("bigint")).withColumn("root", F.lit(""))
        upper = materialize(share(nodes, parent or ["root"], lv).select(*here, F.col("amount").alias("budget")))
        parent = here
    return leaves.join(upper.select(*levels, F.col("budget").alias("amount")), levels).where("amount > 0")


def _small(leaves: DataFrame) -> DataFrame:
    """A table of leaves to join with documents: broadcast if its (checked) size allows, so
    that no text is shuffled; else joined by key."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key))


def plan(docs: DataFrame, s: MixSettings = MixSettings(), text_col: str = "text") -> DataFrame:
    """Per leaf: whole ``epochs``, and the cut of the next one: order key, document and its tokens."""
    levels = list(s.levels)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = docs.select(key.alias("k"), n_tokens(F.col(text_col)).alias("n"), *[F.expr(e).alias(lv) for lv, e in s.levels.items()])
    narrow = materialize(narrow.where("n > 0").groupBy(*levels, "k").agg(F.sum("n").alias("n"), F.count("*").alias("copies")))
    leaves = materialize(budgets(narrow.groupBy(*levels).agg(F.sum("n").alias("tokens")), s)
                         .select(*levels, F.expr("amount div tokens").alias("epochs"), F.expr("amount % tokens").alias("rest")))
    seeded = (narrow.join(_small(leaves), levels).where("rest > 0").withColumn("h", _order(s.seed, F.col("epochs"), F.col("k")))
              .withColumn("bucket", F.substring("h", 1, 3)))
    in_leaf = Window.partitionBy(*levels).orderBy("bucket")  # at most 4096 rows a leaf
    sums = seeded.groupBy(*levels, "bucket", "rest").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(in_leaf))
    cut = materialize(sums.where("upto >= rest AND upto - m < rest").select(*levels, "bucket", (F.col("upto") - F.col("m")).alias("before")))
    in_bucket = Window.partitionBy(*levels).orderBy("h", "k")
    last = (seeded.join(cut, [*levels, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(in_bucket))
            .where("upto >= rest AND upto - n < rest")
            .select(*levels, F.col("h").alias("cut_h"), F.col("k").alias("cut_k"),
                    F.expr("(rest - (upto - n)) div copies").alias("cut_n")))
    return materialize(leaves.join(last, levels, "left").drop("rest"))


def select(docs: DataFrame, s: MixSettings = MixSettings(), text_col: str = "text") -> DataFrame:
    """``docs`` with the tree's levels, ``epoch`` and ``take_tokens``, one row for each epoch
    that reads the document. The levels replace columns of their names; for documents whose
    columns must stay as they are use ``mix``."""
    levels = list(s.levels)
    cuts = plan(docs, s, text_col)
    cuts = cuts.select(*[F.col(lv).alias(f"_{lv}") for lv in levels], "epochs", "cut_h", "cut_k", "cut_n")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"),
                    n_tokens(F.col(text_col)).alias("n"), *[F.expr(e).alias(lv) for lv, e in s.levels.items()]).where("n > 0")
    on = [F.col(lv) == F.col(f"_{lv}") for lv in levels]
    j = d.join(_small(cuts), on).withColumn("h", _order(s.seed, F.col("epochs"), F.col("k")))
    before = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("k") < F.col("cut_k")))
    at = (F.col("h") == F.col("cut_h")) & (F.col("k") == F.col("cut_k"))
    last = F.coalesce(F.when(before, F.col("n")).when(at, F.col("cut_n")).otherwise(0), F.lit(0))
    j = j.withColumn("last", last).withColumn("reads", F.col("epochs") + F.when(F.col("last") > 0, 1).otherwise(0)).where("reads > 0")
    j = j.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("reads") - 1)))
    take = F.when(F.col("epoch") < F.col("epochs"), F.col("n")).otherwise(F.col("last"))
    return j.select("d", *levels, F.col("epoch").cast("int").alias("epoch"), take.alias("take_tokens"), F.col("n").alias("n_tokens"))


def mix(docs: DataFrame, s: MixSettings = MixSettings(), text_col: str = "text") -> DataFrame:
    """The chosen documents with exactly the columns of ``docs``; a document at a leaf's cut
    keeps only its first ``take_tokens`` words (and ``n_chars`` its new length)."""
    chosen = select(docs, s, text_col)
    words = F.regexp_extract_all(F.col(f"d.{text_col}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), F.array_join(F.slice(words, F.lit(1), F.col("take_tokens").cast("int")), "")) \
        .otherwise(F.col(f"d.{text_col}"))
    out = {c: F.col(f"d.`{c}`") for c in docs.columns}
    out[text_col] = text
    if "n_chars" in out:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.col("take_tokens") < F.col("n_tokens"), F.length(text).cast(kind)).otherwise(out["n_chars"])
    return chosen.select(*[v.alias(c) for c, v in out.items()])
