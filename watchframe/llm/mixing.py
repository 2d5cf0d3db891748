"""Mix sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are the combinations of the level columns, for instance domain, language and source. A leaf can give as many tokens as
it has, times ``most_epochs``. The total budget goes down the tree: at each node it is shared among the children by weight,
children that cannot take their share are filled and what they leave goes to their siblings. What no child can take was
never given to the node, as a node's capacity is the sum of its leaves'; so shortages are made up among siblings before
ancestors. A leaf's budget is met by whole epochs and the prefix of a further one, each epoch in an order of its own, drawn by
a hash of seed, epoch and document id. Documents that share an id, and so their place, follow in order of a hash of their texts.

A hot leaf is never ordered in one task: documents are dealt into buckets by the leading part of their hash, token sums of
buckets are added up in order, and only the bucket where the prefix ends is ordered by document.

All arithmetic is on whole numbers: budgets are rounded down, and what is lost by that, less than one token for each child,
stays unspent. The document at which the prefix reaches the budget is taken, so a leaf exceeds it by less than one document.
Defined results: null levels are leaves of their own, named by the empty text; a null text has no tokens and is taken with
its neighbours; a null id counts as empty text; repeated rows are separate documents, of which any may come first; an empty
table gives no rows. Where a budget ends among rows of equal id and text, these are numbered in one task; all other rows are not. Nodes that ``weights`` does not list weigh 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 10_000
HASH_DIGITS = 12  # hexadecimal digits of an order's hash


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Position of a document in an epoch's order, a whole number below 16**12."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HASH_DIGITS), 16, 10).cast("long")


def text_place(text: Column) -> Column:
    """Position of a text among those of documents that share an id, a whole number below 16**15."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def bucket_of(at: Column, n_buckets: Column) -> Column:
    """Bucket of a position, in order of positions; the product has 63 bits at most, up to 2**32 buckets."""
    return F.shiftright(F.shiftright(at, 4 * HASH_DIGITS - 31) * n_buckets, 31)


def shared(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight`` within their ``capacity``; adds ``given``.

    With children in order of capacity for each unit of weight, those are filled whose capacity is at most their share of what
    the children before them left. Few rows: one per node.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*parent)
    weighed = (nodes.withColumn("ratio", F.col("capacity") / F.col("weight"))
               .withColumn("rest", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
               .withColumn("heavy", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
               .withColumn("full", (F.col("capacity") * F.col("heavy").cast("decimal(38,0)") <= F.col("rest").cast("decimal(38,0)") * F.col("weight"))))
    # Once a child is not filled, none after it is: they share what is left.
    open_ = F.when(~F.col("full"), F.struct("rest", "heavy"))
    first = F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = F.expr("cast(cast(left_open.rest as decimal(38,0)) * weight div left_open.heavy as bigint)")
    return (weighed.withColumn("left_open", first)
            .withColumn("given", F.when(F.col("left_open").isNull(), F.col("capacity")).otherwise(F.least(share, F.col("capacity"))))
            .drop("ratio", "rest", "heavy", "full", "left_open"))


def budgets(leaves: DataFrame, levels: list[str], total: int | Column | None, weights: DataFrame | None, most_epochs: int) -> DataFrame:
    """Leaves with ``given``. ``leaves`` has the levels and ``tokens``; ``weights`` has ``path`` (levels joined by /) and
    ``weight``, a positive whole number. Without ``total``, all tokens there are.
    """
    table = leaves.withColumn("capacity", F.col("tokens") * most_epochs)
    budget = F.sum("tokens").over(Window.partitionBy()) if total is None else F.lit(total)
    table = table.withColumn("budget", F.least(budget, F.sum("capacity").over(Window.partitionBy())).cast("long")).withColumn("__leaf_capacity", F.col("capacity"))
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = table.groupBy(*path).agg(F.sum("__leaf_capacity").alias("capacity"), F.first("budget").alias("budget"))
        nodes = nodes.withColumn("path", F.concat_ws("/", *path))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
        else:
            nodes = (nodes.join(weights.select("path", F.col("weight").cast("long")), "path", "left")
                     .withColumn("weight", F.coalesce("weight", F.lit(1).cast("long"))))
        nodes = shared(nodes, path[:-1], path[-1]).select(*path, "given")
        table = table.drop("budget").join(nodes.withColumnRenamed("given", "budget"), path)
    return table.select(*levels, "tokens", "n_docs", F.col("budget").alias("given"))


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later plans know its size and need not redo it."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def mix(docs: DataFrame, folder: str, levels: dict[str, Column], total: int | None = None, weights: DataFrame | None = None,
        most_epochs: int = 2, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per document that is taken: its columns and ``copies``, ``mix_tokens``, ``mix_budget`` of its leaf, which take
    the place of columns of these names.

    ``levels`` names the tree's levels from the root with the column that gives each. ``folder`` is shared and new; the
    lengths of documents and the tables of leaves are kept there. Texts are not shuffled: the limits of leaves, whose stored
    size Spark checks, meet the documents where these are read.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    count = tokens if tokens is not None else F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORDS))
    leaf = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())]
    light = stored(docs.select(F.col(id_column).alias("__id"), count.cast("long").alias("n"), text_place(F.col(text_column)).alias("h"), *leaf),
                   folder, "lengths")
    leaves = light.groupBy(*names).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = (budgets(leaves, names, total, weights, most_epochs)
            .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long"))
            .withColumn("part", F.col("given") - F.col("whole") * F.col("tokens"))
            .withColumn("n_buckets", F.floor((F.col("n_docs") - 1) / BUCKET_ROWS).cast("long") + 1))
    plan = stored(plan, folder, "leaves")
    at = place(seed, F.col("whole"), F.col("__id"))
    dealt = light.join(plan, names).withColumn("at", at).withColumn("bucket", bucket_of(F.col("at"), F.col("n_buckets")))
    sums = dealt.groupBy(*names, "bucket", "part").agg(F.sum("n").alias("bucket_tokens"))
    before = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # The buckets in which a prefix ends: one at most for each leaf.
    ends = (sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)))
            .where((F.col("bucket_before") < F.col("part")) & (F.col("bucket_before") + F.col("bucket_tokens") >= F.col("part")))
            .select(*names, F.col("bucket").alias("end_bucket"), "bucket_before"))
    ends = stored(ends, folder, "ends")
    # In that bucket, equal rows are one class; the class in which the prefix ends gives some of its rows.
    classes = dealt.join(ends, names).where(F.col("bucket") == F.col("end_bucket")).groupBy(*names, "bucket_before", "part", "at", "h", "n").agg(
        F.count(F.lit(1)).alias("rows"))
    within = Window.partitionBy(*names).orderBy("at", "h", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("bucket_before") + F.sum(F.col("n") * F.col("rows")).over(within)
    last = (classes.withColumn("upto", upto).where(F.col("upto") >= F.col("part")).groupBy(*names)
            .agg(F.min(F.struct("at", "h", "n", "upto", "rows", "part")).alias("end"))
            .withColumn("end_rows", F.col("end.rows") - F.expr("(`end`.upto - `end`.part) div `end`.n")))
    limits = stored(plan.join(last, names, "left").select(*names, "given", "whole", "part", "end.at", "end.h", "end.rows", "end_rows").toDF(
        *names, "given", "whole", "part", "end_at", "end_h", "rows", "end_rows"), folder, "limits")
    own = [c for c in docs.columns if c not in ("copies", "mix_tokens", "mix_budget")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_column).alias("__id"), count.cast("long").alias("n"),
                       text_place(F.col(text_column)).alias("h"), *leaf)
    met = rows.join(limits, names).withColumn("at", place(seed, F.col("whole"), F.col("__id")))
    # some rows of a class are left over only if the prefix ends within rows of equal id and text
    split = limits.where(F.col("rows") > F.col("end_rows")).limit(1).count() > 0
    ending = F.coalesce((F.col("part") > 0) & (F.col("at") == F.col("end_at")) & (F.col("h") == F.col("end_h")) & (F.col("rows") > F.col("end_rows")), F.lit(False))
    before_end = (F.col("at") < F.col("end_at")) | ((F.col("at") == F.col("end_at")) & (F.col("h") <= F.col("end_h")))
    taken = met.where(~ending).withColumn("more", (F.col("part") > 0) & F.coalesce(before_end, F.lit(False)))
    if split:
        number = F.row_number().over(Window.partitionBy(*names).orderBy("h"))
        taken = taken.unionByName(met.where(ending).withColumn("more", number <= F.col("end_rows")))
    taken = taken.withColumn("copies", (F.col("whole") + F.col("more").cast("long")).cast("long")).where(F.col("copies") > 0)
    return taken.select("row.*", "copies", F.col("n").alias("mix_tokens"), F.col("given").alias("mix_budget"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed documents, each as often as it was taken."""
    return mixed.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")
