"""Mixing sources to target weights, in DataFrame functions alone.

The sources form a tree: domain, language, source.  A token budget runs down the tree: each
node shares its own among its children by their weights.  A child that cannot use its share
(its tokens times ``max_epochs`` are fewer) takes what it can, and the shortage goes to its
siblings by weight; only what all siblings together cannot use goes up to the parent's
siblings.  Since a node's capacity is known from its leaves, one pass from the root does
that exactly, in whole numbers: children in ascending order of capacity over weight are
full as long as ``capacity * (weights left) <= weight * (budget left)``.

A leaf reads its documents in epochs.  Whole epochs go in as often as the budget allows; of
the next, documents in the order of md5(seed:epoch:id) up to the budget (a token prefix).
The prefix is found in two steps, sums over 4096 ranges of the order and then a running sum
within the one range where the budget ends, so that a leaf with a third of all documents is
never in one task.  Documents with equal ids come or go together.

Nulls: a null language or source is the empty string; a source without a number at its end
is of domain ``dom0``; a null id counts as the empty string; a null text has no tokens.
Rows that repeat count as often as they occur.  Documents without tokens follow their
leaf's whole epochs and the prefix.  A weight of zero or less gives a node nothing; a node
that is not named weighs ``DEFAULT_WEIGHT``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

LEAF = ["domain", "lang", "source"]
DEFAULT_WEIGHT = 1
#: Rows of the leaf table up to which it is sent to every executor.
BROADCAST_LEAVES = 20_000
DOMAINS = 4

# The production mix.
WEIGHTS = {"domain": {"dom0": 5, "dom1": 4, "dom2": 4, "dom3": 3}, "lang": {"en": 6, "fr": 2, "de": 2, "es": 1}, "source": {}}
MAX_EPOCHS, SEED = 2, 20


def domain_of(source: Column) -> Column:
    """``dom`` and the source's trailing number mod 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("dom"), F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") % DOMAINS).cast("string"))


def leaf_columns(df: DataFrame, lang_col: str = "lang", source_col: str = "source") -> dict[str, Column]:
    return {"domain": domain_of(F.col(source_col)), "lang": F.coalesce(F.col(lang_col), F.lit("")), "source": F.coalesce(F.col(source_col), F.lit(""))}


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return F.greatest(out, F.lit(0)).cast("bigint")


def allocate(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``alloc`` to children (cap, weight, budget of their parent), siblings sharing the shortages."""
    family = Window.partitionBy(*(parents or [F.lit(0)]))
    before = family.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)))
    c = c.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)), "weight_all": F.sum("weight").over(family)})
    # products of tokens and weights in decimals of 38 digits: a bigint would overflow
    c = c.withColumn("full", F.expr("cast(cap as decimal(20)) * cast(weight_all - weight_before as decimal(18)) <= cast(weight as decimal(18)) * cast(budget - cap_before as decimal(20))"))
    c = c.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family), "weight_full": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(family)})
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(cast(weight as decimal(18)) * cast(budget - cap_full as decimal(20))) div nullif(weight_all - weight_full, 0)"))
    return c.withColumn("alloc", F.coalesce(alloc, F.lit(0)).cast("bigint")).drop("ratio", "cap_before", "weight_before", "weight_all", "full", "cap_full", "weight_full", "budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], max_epochs: int, total: Column | None = None) -> DataFrame:
    """(domain, lang, source, supply, budget) of leaves (domain, lang, source, supply); ``total`` defaults to the whole supply."""
    usable = F.lit(True)
    for level in LEAF:
        usable = usable & (_weight(level, weights) > 0)
    sized = leaves.withColumn("cap", F.when(usable, F.col("supply") * max_epochs).otherwise(0).cast("bigint"))
    root = sized.agg((F.sum("supply") if total is None else total).cast("bigint").alias("budget")).select(F.lit(0).alias("root"), "budget")
    above, parents = root.withColumn("root", F.lit(0)), ["root"]
    for level in LEAF:
        keys = [*(p for p in parents if p != "root"), level]
        level_rows = sized.groupBy(*keys).agg(F.sum("cap").cast("bigint").alias("cap")).withColumns({"weight": _weight(level, weights), "root": F.lit(0)})
        shared = allocate(level_rows.join(above, parents), [p for p in parents if p != "root"], level)
        above, parents = shared.select(*keys, F.col("alloc").alias("budget")), keys
    return leaves.join(above, LEAF).select(*LEAF, "supply", "budget")


def order_key(epoch: Column, id_: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def plan_mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(domain, lang, source, epochs, cutoff) per leaf for slim rows (doc_id, domain, lang, source, n_tokens).

    A document goes in ``epochs`` times, and once more if its key of that epoch is at most
    ``cutoff``.
    """
    leaves = materialize(docs.groupBy(*LEAF).agg(F.sum("n_tokens").cast("bigint").alias("supply")), "leaves")
    budgets = materialize(leaf_budgets(leaves, weights, max_epochs), "budgets")
    budgets = budgets.withColumn("epochs", F.expr("coalesce(budget div nullif(supply, 0), 0)")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    keyed = _with_leaf(docs, budgets.where("rest > 0").select(*LEAF, "epochs", "rest")).withColumn("key", order_key(F.col("epochs"), F.col("doc_id"), seed)).withColumn("range", F.substring("key", 1, 3))
    ranges = keyed.groupBy(*LEAF, "rest", "range").agg(F.sum("n_tokens").alias("here"))
    run = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranges.withColumn("upto", F.sum("here").over(run)).where("upto - here <= rest and rest < upto").select(*LEAF, "rest", "range", (F.col("upto") - F.col("here")).alias("base"))
    ends = materialize(ends, "range-ends")
    edge = _with_leaf(keyed.drop("rest"), ends, "range").groupBy(*LEAF, "rest", "base", "key").agg(F.sum("n_tokens").alias("here"))
    within = edge.withColumn("upto", F.col("base") + F.sum("here").over(Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = within.where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("last"))
    cut = ends.join(last, LEAF, "left").select(*LEAF, F.coalesce("last", "range").alias("cutoff"))
    return budgets.join(cut, LEAF, "left").select(*LEAF, "epochs", "cutoff")


def _with_leaf(docs: DataFrame, leaves: DataFrame, *more: str) -> DataFrame:
    """Joins a leaf table: sent to every executor if it is counted to be small, else by a shuffle."""
    keys = [*LEAF, *more]
    return docs.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves, keys)


def slim_docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in leaf_columns(df, lang_col, source_col).items()], word_count(F.col(text_col)).alias("n_tokens"))


def copies(seed: int = SEED) -> Column:
    """How often a row (doc_id, epochs, cutoff) goes in."""
    more = F.col("cutoff").isNotNull() & (order_key(F.col("epochs"), F.col("doc_id"), seed) <= F.col("cutoff"))
    return (F.col("epochs") + more.cast("bigint")).alias("copies")


def mix(df: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, **columns: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) for each row; copies is 0 for those left out."""
    docs = materialize(slim_docs(df, **columns), "tokens")
    plan = materialize(plan_mix(docs, weights, max_epochs, seed), "mix-plan")
    return _with_leaf(docs, plan).select("doc_id", *LEAF, "n_tokens", copies(seed))


def mixed_rows(df: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, all columns as they are, each as often as the mix takes it.

    Texts are not shuffled: a row is judged by its leaf's line in the plan.
    """
    docs = materialize(slim_docs(df, id_col, text_col, lang_col, source_col), "tokens")
    plan = materialize(plan_mix(docs, weights, max_epochs, seed), "mix-plan")
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):  # no name of the input is taken
        mark += "_"
    own = [mark + n for n in LEAF]
    keyed = df.withColumns({mark + n: c for n, c in leaf_columns(df, lang_col, source_col).items()})
    line = plan.select(*[F.col(n).alias(mark + n) for n in [*LEAF, "epochs", "cutoff"]])
    joined = keyed.join(F.broadcast(line) if plan.count() <= BROADCAST_LEAVES else line, own)
    more = F.col(mark + "cutoff").isNotNull() & (order_key(F.col(mark + "epochs"), F.col(id_col), seed) <= F.col(mark + "cutoff"))
    times = (F.col(mark + "epochs") + more.cast("bigint")).cast("int")
    return joined.where(times > 0).withColumn(mark + "copy", F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in df.columns])


def oracle(weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same mix in SQL, over a table ``documents``."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{n}' THEN {max(w, 0)}" for n, w in weights.get(level, {}).items())
        return f"CAST(CASE {level} {cases} ELSE {DEFAULT_WEIGHT} END AS BIGINT)" if cases else f"CAST({DEFAULT_WEIGHT} AS BIGINT)"

    def level(name: str, parents: list[str], above: str) -> str:
        keys = ", ".join([*parents, name])
        family = f"PARTITION BY {', '.join(parents)}" if parents else ""
        before = f"OVER ({family} ORDER BY CASE WHEN weight > 0 THEN CAST(cap AS DOUBLE) / weight ELSE 0.0 END, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        on = " AND ".join(f"c.{p} = p.{p}" for p in parents) or "TRUE"
        return f"""
{name}_c AS (SELECT {keys}, sum(cap) AS cap, {weight(name)} AS weight FROM sized GROUP BY {keys}),
{name}_b AS (SELECT c.*, p.budget FROM {name}_c c JOIN {above} p ON {on}),
{name}_s AS (SELECT *, coalesce(sum(cap) {before}, 0) AS cb, coalesce(sum(weight) {before}, 0) AS wb, sum(weight) OVER ({family}) AS wa FROM {name}_b),
{name}_f AS (SELECT *, cap * (wa - wb) <= weight * (budget - cb) AS isfull FROM {name}_s),
{name}_g AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({family}) AS cf, sum(CASE WHEN isfull THEN weight ELSE 0 END) OVER ({family}) AS wf FROM {name}_f),
{name}_a AS (SELECT {keys}, coalesce(CASE WHEN isfull THEN cap ELSE (weight * (budget - cf)) // nullif(wa - wf, 0) END, 0) AS budget FROM {name}_g)"""

    usable = " AND ".join(f"{weight(n)} > 0" for n in LEAF)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'dom' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER) % {DOMAINS}, 0) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM docs GROUP BY domain, lang, source),
sized AS (SELECT *, CASE WHEN {usable} THEN supply * {max_epochs} ELSE 0 END AS cap FROM leaves),
root AS (SELECT sum(supply) AS budget FROM sized),{level("domain", [], "root")},{level("lang", ["domain"], "domain_a")},{level("source", ["domain", "lang"], "lang_a")},
budgets AS (SELECT l.*, a.budget, coalesce(a.budget // nullif(l.supply, 0), 0) AS epochs FROM leaves l JOIN source_a a USING (domain, lang, source)),
keyed AS (SELECT d.*, b.epochs, b.budget - b.epochs * b.supply AS rest, md5('{seed}:' || CAST(b.epochs AS BIGINT) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS key FROM docs d JOIN budgets b USING (domain, lang, source)),
sums AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM sums"""
