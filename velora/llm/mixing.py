"""Mixing sources to target weights over a domain-language-source tree (operator 5). DataFrame and SQL functions only.

The tree has fixed depth: domain > language > source. Weights are given per
node name and level; a node without one weighs ``1``. A parent's budget goes to
its children by weight. A leaf can give at most ``max_epochs`` times its own
tokens. What a child cannot use goes to its siblings by weight first; only what
a whole family cannot use goes back to the family's own siblings one level up.

Both rules follow from one water-filling per family: with capacities c and
weights w, each child gets min(c, x * w) for the x at which the family's budget
is spent. Capacities add up the tree, budgets run down it. The family's x is
found from prefix sums over its children in order of c / w: no loop.

Every leaf then reads its documents in seeded epochs: a full pass takes all of
them, the last pass a prefix, in the order of md5(seed:epoch:doc_id), as long
as the tokens before a document are below what is left of the budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.common import stored

LEVELS = ("domain", "language", "source")
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mixture:
    """``weights``: level -> name -> weight. ``budget_share``: of all tokens of the input."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    budget_share: float = 0.5
    max_epochs: int = 2
    seed: str = "mix-1"


def token_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """Domain of a source name: its last digit even or odd, or other; the tables carry none."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(digit.isin("0", "2", "4", "6", "8"), "web").when(digit != "", "books").otherwise("other")


def leaf_names() -> list[Column]:
    """domain, language and source of a document; null names count as 'unknown'."""
    src = F.coalesce("source", F.lit("unknown"))
    return [source_domain(src).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("language"), src.alias("source")]


def leaves(docs: DataFrame) -> DataFrame:
    """(domain, language, source, doc_id, tokens) of every row."""
    return docs.select(*leaf_names(), "doc_id", token_count(F.col("text")).alias("tokens"))


def _weight(level: str, mixture: Mixture) -> Column:
    w = F.lit(1.0)
    for name, value in mixture.weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(float(value))).otherwise(w)
    return w


def _fill(nodes: DataFrame, family: list[str], level: str, mixture: Mixture) -> DataFrame:
    """Adds ``budget``: water-filling of each family's ``parent_budget`` over (weight, capacity)."""
    # Children in order of capacity / weight: while they are full, x is above their ratio.
    n = nodes.withColumn("w", _weight(level, mixture))
    n = n.withColumn("ratio", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf"))))
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    before = by.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
    n = n.withColumn("open_w", F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # x, were this child the first that is not full; it is the first for which x is within its ratio, so the largest x
    n = n.withColumn("x", F.when(F.col("open_w") > 1e-12, (F.col("parent_budget") - F.col("full")) / F.col("open_w")))
    n = n.withColumn("x", F.max(F.when(F.col("x") <= F.col("ratio"), F.col("x"))).over(by))
    spent = F.when(F.col("x").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("x") * F.col("w")))
    return n.withColumn("budget", F.when(F.col("w") > 0, spent).otherwise(F.lit(0.0))).drop("w", "ratio", "full", "open_w", "x")


def budgets(sizes: DataFrame, mixture: Mixture) -> DataFrame:
    """(domain, language, source, tokens) -> the same plus ``budget`` tokens of every leaf."""
    keys = list(LEVELS)
    usable = F.col("tokens").cast("double") * mixture.max_epochs
    for level in keys:  # a node of weight 0 gives nothing
        usable = F.when(_weight(level, mixture) > 0, usable).otherwise(F.lit(0.0))
    leaf = sizes.withColumn("capacity", usable)
    total = float(sizes.agg(F.sum("tokens")).first()[0] or 0) * mixture.budget_share
    down = None
    for k, level in enumerate(keys):
        nodes = leaf.groupBy(*keys[: k + 1]).agg(F.sum("capacity").alias("capacity"))
        family = keys[:k]
        nodes = nodes.withColumn("parent_budget", F.lit(total)) if down is None else nodes.join(down, family)
        down = _fill(nodes, family, level, mixture).select(*keys[: k + 1], F.col("budget").alias("parent_budget"))
    return sizes.join(down.withColumnRenamed("parent_budget", "budget"), keys)


def plan(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Per leaf: tokens, budget, passes (full epochs) and rest (tokens of the last, partial epoch)."""
    sizes = stored(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-sizes")
    b = budgets(sizes, mixture).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))
    free = F.lit(True)  # a leaf without tokens costs nothing: it is read as often as the mixture allows
    for level in LEVELS:
        free = free & (_weight(level, mixture) > 0)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).when(free, F.lit(int(mixture.max_epochs))).otherwise(0).cast("long")
    return b.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))


def _order(mixture: Mixture, epoch: Column, doc_id: Column) -> Column:
    name = F.concat(F.lit(f"{mixture.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(name.cast("binary"))


def cut_points(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Per leaf: passes, and last_hash, the largest order hash that the partial epoch still reads (null: none).

    A leaf may hold most rows. Its partial epoch is cut in two steps: token
    sums per range of the order (the first hex digits of the hash, added up on
    the map side) give the one range in which the budget ends; only that
    range's rows are put in order. Rows of one leaf with equal ids share a hash
    and are taken or left together. A document is read if the tokens before it
    are below the budget, so a leaf can exceed its budget by one document.
    """
    keys = list(LEVELS)
    planned = stored(plan(rows, mixture).select(*keys, "passes", "rest"), "mix-plan")
    part = rows.join(planned.filter("rest > 0"), keys)
    part = part.withColumn("h", _order(mixture, F.col("passes"), F.col("doc_id")))
    part = part.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)).select(*keys, "bucket", "h", "tokens", "rest")
    sums = part.groupBy(*keys, "rest", "bucket").agg(F.sum("tokens").alias("here"))
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("here").over(ahead), F.lit(0))).filter("before < rest")
    last = sums.groupBy(*keys).agg(F.max(F.struct("bucket", "before")).alias("last")).select(*keys, "last.*")
    cut = part.join(last, [*keys, "bucket"]).groupBy(*keys, "before", "rest", "h").agg(F.sum("tokens").alias("tokens"))
    prior = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("ahead", F.col("before") + F.coalesce(F.sum("tokens").over(prior), F.lit(0))).filter("ahead < rest")
    return planned.join(cut.groupBy(*keys).agg(F.max("h").alias("last_hash")), keys, "left").select(*keys, "passes", "last_hash")


def _readings(named: DataFrame, cuts: DataFrame, mixture: Mixture) -> DataFrame:
    """Joins the leaf table and repeats each row once per epoch: adds __epoch."""
    at = named.join(cuts, list(LEVELS))
    here = _order(mixture, F.col("passes"), F.col("doc_id")) <= F.col("last_hash")
    epochs = F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)
    epochs = F.when(F.col("passes") > 0, epochs).otherwise(F.array().cast("array<bigint>"))
    epochs = F.when(here, F.concat(epochs, F.array("passes"))).otherwise(epochs)
    return at.withColumn("__epoch", F.explode(epochs))


def mix(docs: DataFrame, mixture: Mixture, epoch: str | None = "epoch") -> DataFrame:
    """The rows of ``docs``, each once per epoch it is read in, with the number of the epoch if named.

    Null sources and languages are leaves named 'unknown'; null and empty texts
    have no tokens and are read with the full passes and while the budget
    lasts; a leaf that holds only such texts is read in every epoch allowed. The leaf table (one row per leaf) is joined to the rows; texts are
    not shuffled where Spark finds that table small.
    """
    cuts = stored(cut_points(stored(leaves(docs), "mix-rows"), mixture), "mix-cuts")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*cols).alias("__row"), "doc_id", *leaf_names())
    out = _readings(named, cuts, mixture)
    return out.select("__row.*", *([F.col("__epoch").alias(epoch)] if epoch else []))


def mixture_report(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, domain, language, source, tokens, epoch of every reading of a document."""
    rows = stored(leaves(docs), "mix-rows")
    cuts = stored(cut_points(rows, mixture), "mix-cuts")
    out = _readings(rows, cuts, mixture)
    return out.select("doc_id", *LEVELS, "tokens", F.col("__epoch").alias("epoch"))


_SQL_COUNT = "len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))"


def _sql_weight(level: str, mixture: Mixture) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in mixture.weights.get(level, {}).items())
    return f"(CASE {level} {cases} ELSE 1.0 END)" if cases else "1.0"


def report_sql(mixture: Mixture) -> str:
    """DuckDB SQL for ``mixture_report`` over ``documents``."""
    positive = " AND ".join(f"{_sql_weight(x, mixture)} > 0" for x in LEVELS)
    parts = [
        f"""rows AS (
  SELECT doc_id, CASE WHEN d IN ('0', '2', '4', '6', '8') THEN 'web' WHEN d <> '' THEN 'books' ELSE 'other' END AS domain,
    coalesce(lang, 'unknown') AS language, source, tokens
  FROM (SELECT doc_id, lang, coalesce(source, 'unknown') AS source, regexp_extract(coalesce(source, 'unknown'), '([0-9])$', 1) AS d,
    coalesce({_SQL_COUNT}, 0)::BIGINT AS tokens FROM documents)
)""",
        f"""leaf AS (
  SELECT domain, language, source, sum(tokens)::BIGINT AS tokens,
    CASE WHEN {positive} THEN sum(tokens)::DOUBLE * {mixture.max_epochs} ELSE 0.0 END AS capacity
  FROM rows GROUP BY domain, language, source
)""",
    ]
    above, parent = None, "(SELECT sum(tokens)::DOUBLE FROM leaf)"
    for k, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: k + 1])
        family = ", ".join(LEVELS[:k])
        by = f"PARTITION BY {family}" if family else ""
        source = f"(SELECT {keys}, sum(capacity) AS capacity FROM leaf GROUP BY {keys})"
        budget = f"{parent} * {mixture.budget_share}" if above is None else "u.budget"
        join = "" if above is None else f" JOIN {above} u USING ({family})"
        parts.append(
            f"""r{k} AS (
  SELECT {keys}, capacity, {budget} AS parent_budget, {_sql_weight(level, mixture)} AS w,
    CASE WHEN {_sql_weight(level, mixture)} > 0 THEN capacity / {_sql_weight(level, mixture)} ELSE 'Infinity'::DOUBLE END AS ratio
  FROM {source}{join}
),
p{k} AS (
  SELECT *, (parent_budget - coalesce(sum(capacity) OVER b, 0)) AS left_over, sum(w) OVER ({by}) - coalesce(sum(w) OVER b, 0) AS open_w
  FROM r{k} WINDOW b AS ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
x{k} AS (SELECT *, CASE WHEN open_w > 1e-12 THEN left_over / open_w END AS x1 FROM p{k}),
b{k} AS (
  SELECT {keys}, CASE WHEN w <= 0 THEN 0.0 WHEN x IS NULL THEN capacity ELSE least(capacity, x * w) END AS budget
  FROM (SELECT *, max(CASE WHEN x1 <= ratio THEN x1 END) OVER ({by}) AS x FROM x{k})
)"""
        )
        above = f"b{k}"
    name = f"concat('{mixture.seed}:', e::VARCHAR, ':', coalesce(doc_id::VARCHAR, ''))"
    parts.append(
        f"""planned AS (
  SELECT *, budget_tokens - passes * tokens AS rest FROM (
    SELECT domain, language, source, tokens, floor(budget + 1e-6)::BIGINT AS budget_tokens,
      CASE WHEN tokens > 0 THEN floor(floor(budget + 1e-6) / tokens)::BIGINT WHEN {positive} THEN {int(mixture.max_epochs)} ELSE 0 END AS passes
    FROM leaf JOIN b{len(LEVELS) - 1} USING (domain, language, source))
),
part AS (
  SELECT doc_id, domain, language, source, r.tokens, e AS epoch, rest, md5({name}) AS h
  FROM (SELECT *, passes AS e FROM planned WHERE rest > 0) p JOIN rows r USING (domain, language, source)
),
cum AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY h) - sum(tokens) OVER (PARTITION BY domain, language, source, h)
    AS ahead FROM part
)
SELECT doc_id, domain, language, source, tokens, epoch::BIGINT AS epoch FROM cum WHERE ahead < rest
UNION ALL
SELECT doc_id, domain, language, source, r.tokens, e::BIGINT
FROM (SELECT *, unnest(range(0, passes)) AS e FROM planned WHERE passes > 0) p JOIN rows r USING (domain, language, source)"""
    )
    return "WITH " + ",\n".join(parts)
