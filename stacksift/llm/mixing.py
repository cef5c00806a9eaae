"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain - language - source. A node's budget of tokens goes to its children in proportion
to their weights; a child whose documents can't fill its share (supply times `max_epochs`) gets what it can give,
and what it leaves goes to its siblings in proportion. Only what a whole node can't fill is left to the node's own
siblings, and so on upward, so shortages are settled among siblings before ancestors. What hangs below a weight of 0
can give nothing. A leaf's budget is then a prefix of its seeded epochs: in each epoch its documents are in the order
of a hash of the seed, the epoch, the document's id and its text, and documents are taken until the next one would
exceed the budget.

DataFrame functions only. One scan sums the tokens of each leaf, one writes the few numbers of each document that the
cut needs, and the last one emits the documents. No leaf is gathered in one task: tokens are
first summed in 2**BITS hash ranges of each leaf, the ranges' running sums decide all but the one range that the
budget ends in, and only that range's distinct keys are put in order. The plan has a row for each leaf; it is
broadcast if it has at most BROADCAST_LEAVES rows (texts are then never shuffled), otherwise it is copied to SALTS
parts of each leaf and joined by a shuffle, so a leaf with a third of all rows is spread.

Defined cases: null lang or source are children of their own; null and empty texts have no tokens and are never
taken; weights that are missing count as 1 (a child's weight by default), negative ones as 0; children without
weight get nothing; rows that repeat a document are separate rows with equal keys, of which as many are taken as the
budget holds (those with the smallest hashes of their other columns; columns of map type are not looked at, and of
rows that differ only in those one stands for all); other columns are kept, whatever their names; columns named
domain, n_tokens or epoch are replaced; an empty table, or a budget of 0, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import SPACE, written

BITS = 12
TREE = ("domain", "lang", "source")
BROADCAST_LEAVES = 100_000
SALTS = 64


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def default_domain(source: Column) -> Column:
    """Sources that end in an even digit are one domain, all others another."""
    return F.when(source.rlike("[02468]$"), F.lit("even")).otherwise(F.lit("odd"))


def _weight(table: dict[tuple, float], names: tuple[str, ...]) -> Column:
    out = F.lit(1.0)
    for key, value in sorted(table.items(), key=str):
        same = F.lit(True)
        for name, part in zip(names, key, strict=True):
            same = same & F.col(name).eqNullSafe(F.lit(part))
        out = F.when(same, F.lit(float(max(0.0, value)))).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with `budget`: the parent's `given` in proportion to `weight`, none above `cap`.

    In the order of cap / weight, a child is full if the share that is left for it and those after is its cap or
    more; the first that isn't full and all after it divide the rest, so the share of that first one holds for all.
    Children without weight are left aside, with a budget of 0.
    """
    order = Window.partitionBy(*parent, "_has").orderBy("_ratio", F.col(name).asc_nulls_first())
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    a = children.withColumn("_has", F.col("weight") > 0).withColumn("_ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    left = F.greatest(F.lit(0.0), F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    b = a.withColumn("_share", F.when(F.col("_has"), left / F.sum("weight").over(after))).withColumn("_at", F.row_number().over(order))
    first = F.min(F.when(F.col("_ratio") > F.col("_share"), F.struct("_at", "_share"))).over(Window.partitionBy(*parent, "_has"))
    c = b.withColumn("_first", first)
    full = F.col("_first").isNull() | (F.col("_at") < F.col("_first")["_at"])
    budget = F.when(~F.col("_has"), F.lit(0.0)).when(full, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("_first")["_share"]))
    return c.withColumn("budget", budget).drop("_has", "_ratio", "_share", "_at", "_first")


def budgets(docs: DataFrame, total: float | None, share: float, max_epochs: int, weights: dict[str, dict[tuple, float]]) -> DataFrame:
    """domain, lang, source, supply (tokens), budget (whole tokens) of every leaf; one aggregation of docs.

    docs: domain, lang, source, n_tokens. Without `total`, the budget is `share` of all tokens, those below a weight
    of 0 included.
    """
    usable = F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0.0))
    names = {k: _weight(weights.get(k, {}), TREE[: i + 1]) for i, k in enumerate(TREE)}
    leaves = docs.groupBy(*TREE).agg(F.sum("n_tokens").alias("supply")).filter("supply > 0")
    leaves = written(leaves).withColumn("weight", names["source"]).withColumn("cap", (F.col("supply") * max_epochs).cast("double"))
    node = leaves.groupBy("domain", "lang").agg(F.sum(usable).alias("cap"), F.sum("supply").alias("supply")).withColumn("weight", names["lang"])
    top = node.groupBy("domain").agg(F.sum(usable).alias("cap"), F.sum("supply").alias("supply")).withColumn("weight", names["domain"])
    # one partition: the domains are few, and named by the caller
    every = Window.partitionBy(F.lit(0))
    want = F.lit(float(total)) if total is not None else F.sum("supply").over(every) * float(share)
    top = fill(top.withColumn("given", F.least(want, F.sum(usable).over(every))).withColumn("_all", F.lit(0)), ["_all"], "domain")
    node = fill(_under(node, top.select("domain", F.col("budget").alias("given")), ["domain"]), ["domain"], "lang")
    leaves = fill(_under(leaves, node.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"]), ["domain", "lang"], "source")
    return leaves.select(*TREE, "supply", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _under(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """children joined to their parents, null keys equal; a child below a node without budget is given 0."""
    p = parents.select(*(F.col(k).alias(f"_p_{k}") for k in keys), "given")
    on = F.lit(True)
    for k in keys:
        on = on & children[k].eqNullSafe(p[f"_p_{k}"])
    return children.join(p, on).drop(*(f"_p_{k}" for k in keys))


def _with_leaf(rows: DataFrame, leaves: DataFrame, p: str, few: bool) -> DataFrame:
    """rows joined to their leaf's row; leaves: p + domain, p + lang, p + source and other columns that begin with p."""
    there = leaves.select(*(F.col(p + k).alias(f"{p}on_{k}") for k in TREE), *(c for c in leaves.columns if c[len(p) :] not in TREE))
    on = F.lit(True)
    for k in TREE:
        on = on & F.col(p + k).eqNullSafe(F.col(f"{p}on_{k}"))
    if few:
        joined = rows.join(F.broadcast(there), on)  # at most BROADCAST_LEAVES rows
    else:
        salted = there.withColumn(p + "salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(p + "salt_l", F.pmod(F.col(p + "own"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), on & (F.col(p + "salt_l") == F.col(p + "salt_r")))
    return joined.drop(*(f"{p}on_{k}" for k in TREE), p + "salt_l", p + "salt_r")


def mix(docs: DataFrame, total: float | None = None, share: float = 0.5, max_epochs: int = 2, weights: dict[str, dict[tuple, float]] | None = None, seed: int = 0, domain: Column | None = None) -> DataFrame:
    """The rows of docs that the mixture takes, once for each epoch, with `domain`, `n_tokens` and `epoch` (from 0).

    total: tokens to take; without it, `share` of all tokens. weights: by level (domain, lang, source), from the
    path of a node to its weight among its siblings. domain: a column over those of docs; default_domain without it.
    """
    p = "_mix_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    carried = [c for c in docs.columns if c.lower() not in ("domain", "n_tokens", "epoch")]
    own = F.xxhash64(F.col("doc_id"), F.crc32(F.col("text").cast("binary")))
    named = {"domain": default_domain(F.col("source")) if domain is None else domain, "lang": F.col("lang"), "source": F.col("source")}
    rows = docs.select(*docs.columns, *(c.alias(p + k) for k, c in named.items()), n_tokens(F.col("text")).alias(p + "n"), own.alias(p + "own"))
    # has a word: cheaper than a second count of them, which a filter on the count would be once it is pushed down
    rows = rows.filter(F.col("text").rlike(f"[^{SPACE}]"))
    # what the budgets and their cuts need of each document
    slim = written(rows.select(*(F.col(p + k) for k in TREE), p + "n", p + "own"))
    plan = budgets(slim.select(*(F.col(p + k).alias(k) for k in TREE), F.col(p + "n").alias("n_tokens")), total, share, max_epochs, weights or {})
    # epochs that a leaf's budget takes whole, and what is left for the one that it ends in
    plan = plan.select(*(F.col(k).alias(p + k) for k in TREE), F.expr("cast(budget div supply as int)").alias(p + "whole"), F.expr("budget % supply").alias(p + "rest"))
    plan = written(plan.filter((F.col(p + "whole") > 0) | (F.col(p + "rest") > 0)))
    few = plan.count() <= BROADCAST_LEAVES
    tree = [F.col(p + k) for k in TREE]

    def keyed(df: DataFrame) -> DataFrame:
        """df with the place of its rows in their leaf's last epoch and the hash range of it."""
        key = F.xxhash64(F.lit(seed), F.col(p + "whole"), F.col(p + "own"))
        return df.withColumn(p + "key", key).withColumn(p + "part", F.shiftrightunsigned(key, 64 - BITS).cast("int"))

    # hash ranges are in the order of unsigned keys, keys within one in that of signed ones: both are fixed
    ends = keyed(_with_leaf(slim, plan.filter(F.col(p + "rest") > 0), p, few))
    sums = ends.groupBy(*tree, p + "rest", p + "part").agg(F.sum(p + "n").alias(p + "sum"))
    run = Window.partitionBy(*tree).orderBy(p + "part").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn(p + "upto", F.sum(p + "sum").over(run)).filter(F.col(p + "upto") > F.col(p + "rest"))
    cut = F.min(F.struct(F.col(p + "part"), F.col(p + "upto") - F.col(p + "sum")))
    over = over.groupBy(*tree).agg(cut.alias(p + "c")).select(*tree, F.col(p + "c")[p + "part"].alias(p + "cut"), F.col(p + "c").getField("col2").alias(p + "used"))
    over = written(over)
    # in that range equal keys are one row; the first whose copies don't all fit ends the prefix
    edge = _with_leaf(ends, over, p, few).filter(F.col(p + "part") == F.col(p + "cut"))
    edge = edge.groupBy(*tree, p + "rest", p + "used", p + "key").agg(F.max(p + "n").alias(p + "n"), F.count("*").alias(p + "many"))
    inner = Window.partitionBy(*tree).orderBy(p + "key").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col(p + "rest") - F.col(p + "used") - F.coalesce(F.sum(F.col(p + "n") * F.col(p + "many")).over(inner), F.lit(0))
    stop = edge.withColumn(p + "fit", F.floor(F.greatest(F.lit(0), room) / F.col(p + "n")).cast("long")).filter(F.col(p + "fit") < F.col(p + "many"))
    stop = stop.groupBy(*tree).agg(F.min(F.struct(p + "key", p + "fit")).alias(p + "s"))
    stop = stop.select(*tree, F.col(p + "s")[p + "key"].alias(p + "last"), F.col(p + "s")[p + "fit"].alias(p + "fit"))
    more = _null_safe(_null_safe(plan, over.select(*tree, p + "cut"), p), stop, p)
    more = written(more)

    met = keyed(_with_leaf(rows, more, p, few))
    part, key = F.col(p + "part"), F.col(p + "key")
    at_last = (part == F.col(p + "cut")) & (key == F.col(p + "last"))
    inside = F.when(F.col(p + "rest") == 0, False).when(F.col(p + "cut").isNull(), True).otherwise((part < F.col(p + "cut")) | ((part == F.col(p + "cut")) & (key < F.col(p + "last"))))
    copies = F.col(p + "whole") + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    out = [*(F.col(c) for c in carried), F.col(p + "domain").alias("domain"), F.col(p + "n").alias("n_tokens")]
    taken = met.filter(copies > 0).select(*out, F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch"))
    if more.filter(F.col(p + "fit") > 0).isEmpty():
        return taken
    # copies of one document that the budget ends among: equal rows are counted, and stand for each other
    looked_at = [F.col(f.name) for f in docs.select(*carried).schema.fields if not isinstance(f.dataType, MapType)]
    split = met.filter(at_last & (F.col(p + "fit") > 0)).withColumn(p + "like", F.xxhash64(*looked_at))
    row = F.struct(*(F.col(c) for c in carried), *(F.col(c) for c in (p + "domain", p + "n", p + "whole")))
    split = split.groupBy(*tree, p + "fit", p + "like").agg(F.first(row).alias(p + "row"), F.count("*").alias(p + "many"))
    inner = Window.partitionBy(*tree).orderBy(p + "like").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(p + "fit") - F.coalesce(F.sum(p + "many").over(inner), F.lit(0))
    split = split.withColumn(p + "take", F.least(F.col(p + "many"), left)).filter(F.col(p + "take") > 0)
    split = split.withColumn(p + "i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(p + "take"))))
    of = lambda c: F.col(p + "row")[c]
    return taken.unionByName(split.select(*(of(c).alias(c) for c in carried), of(p + "domain").alias("domain"), of(p + "n").alias("n_tokens"), of(p + "whole").alias("epoch")))


def _null_safe(left: DataFrame, right: DataFrame, p: str) -> DataFrame:
    """left with the columns of right, by the leaf, null where right has none; both have a row a leaf at most."""
    there = right.select(*(F.col(p + k).alias(f"{p}on_{k}") for k in TREE), *(c for c in right.columns if c[len(p) :] not in TREE))
    on = F.lit(True)
    for k in TREE:
        on = on & F.col(p + k).eqNullSafe(F.col(f"{p}on_{k}"))
    return left.join(there, on, "left").drop(*(f"{p}on_{k}" for k in TREE))
