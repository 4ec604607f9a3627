"""Mixing sources to target weights by temperature, with DataFrame and SQL functions only.

A source's share p of all tokens becomes the weight w ~ p ** a. The exponent a
in [0, 1] is the smallest that keeps both limits: the weights' entropy at most
`target_entropy` of the largest possible (log of the number of sources), and no
source repeated more than `max_repeats` times within the budget. Both hold from
some exponent on, so a is bisected, `STEPS` halvings at a time: one pass over
the sources' totals sums what decides all the next midpoints.

Each source then gets budget * w tokens, a whole number. Its documents are
dealt into blocks by hash, about as many as each holds documents, and permuted
in each block by hash. Whole repetitions (epochs) come first; the last one takes the documents
in that order while their running token count stays within what is left.
Running counts are sums over blocks and within blocks, so that no task needs
all documents of a source.

Defined results: tokens are runs of non-space; null and empty texts have none
and come once for each whole epoch, and in the last one while budget is left;
a null source is a source of its own; rows without an id are dealt by their
text; a budget that no weights can keep to max_repeats is an error; repeated rows are documents of their own;
sources without any token get their rows once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TARGET_ENTROPY, MAX_REPEATS, BUDGET_SHARE = 0.98, 4.0, 1.0
#: Halvings of the exponent's range in a pass, and passes.
STEPS, PASSES = 6, 6
NO_SOURCE = "(none)"
TOKENS, SOURCE, WEIGHT, BUDGET, EPOCHS, LEFT, BLOCKS, ORDER, BLOCK, BEFORE, RUNNING, EPOCH = (
    common.OWN + x for x in ("tokens", "source", "weight", "budget", "epochs", "left", "blocks", "order", "block", "before", "running", "epoch")
)


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def exponent(totals: DataFrame, target_entropy: float, max_repeats: float, budget: float) -> float:
    """The exponent for the sources' positive totals; one row to the driver in each pass."""
    edge = totals.agg(F.sum("tokens").alias("all"), F.min("tokens").alias("least"), F.count("*").alias("sources")).first()
    if edge["sources"] and budget > max_repeats * edge["all"]:
        raise ValueError("a budget beyond max_repeats times all tokens repeats some source more often than that")
    if not edge["sources"]:
        return 1.0
    p = F.col("tokens") / edge["all"]
    least = edge["least"] / edge["all"]
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / 2**STEPS for i in range(2**STEPS)]
        sums = [f for a in points for f in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = totals.agg(*sums).first()
        first = len(points)
        for i, a in reversed(list(enumerate(points))):
            s0, s1 = row[2 * i], row[2 * i + 1]
            entropy = math.log(s0) - a * s1 / s0
            # The smallest share is the one repeated most, as a <= 1.
            repeats = least**a / s0 * budget / edge["least"]
            if entropy > target_entropy * math.log(edge["sources"]) + 1e-12 or repeats > max_repeats:
                break
            first = i
        if first == 0:
            return points[0]
        low, high = points[first - 1], points[first] if first < len(points) else high
    return high


def planned(rows: DataFrame, target_entropy: float, max_repeats: float, budget_share: float) -> DataFrame:
    """Each source's weight, budget, whole epochs, tokens left for the last one, and number of blocks."""
    slim = common.written(rows.groupBy(SOURCE).agg(F.sum(TOKENS).alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    paid = slim.where("tokens > 0")
    total = (paid.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    a = exponent(paid, target_entropy, max_repeats, total)
    scale = paid.agg(F.sum(F.pow("tokens", F.lit(a)))).first()[0] or 1.0
    plan = slim.withColumn(WEIGHT, F.when(F.col("tokens") > 0, F.round(F.pow("tokens", F.lit(a)) / scale, 9)))
    plan = plan.withColumn(BUDGET, F.floor(F.col(WEIGHT) * total).cast("long"))
    plan = plan.withColumn(EPOCHS, F.when(F.col("tokens") > 0, F.floor(F.col(BUDGET) / F.col("tokens"))).otherwise(1).cast("long"))
    plan = plan.withColumn(LEFT, F.col(BUDGET) - F.col(EPOCHS) * F.col("tokens"))
    plan = plan.withColumn(BLOCKS, F.ceil(F.sqrt("docs")).cast("long"))
    return common.written(plan.drop("tokens", "docs"), "mix-plan")


def drawn(
    docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_share: float = BUDGET_SHARE, seed: int = 0,
) -> DataFrame:
    """docs with a row for each draw, and own columns: TOKENS, SOURCE, WEIGHT, BUDGET, BLOCK, EPOCH and RUNNING.

    budget_share times the tokens of docs is the budget. RUNNING counts the
    tokens of the source's permutation up to and with the document.
    """
    rows = docs.withColumns({TOKENS: tokens(F.col(text_col)), SOURCE: F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))})
    plan = planned(rows.select(SOURCE, TOKENS), target_entropy, max_repeats, budget_share)
    # md5, as other engines have it too.
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(SOURCE), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))))
    dealt = rows.join(plan, SOURCE).withColumn(ORDER, order)
    dealt = dealt.withColumn(BLOCK, F.conv(F.substring(ORDER, 1, 8), 16, 10).cast("long") % F.col(BLOCKS))
    earlier = Window.partitionBy(SOURCE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(SOURCE, BLOCK).agg(F.sum(TOKENS).alias("s")).select(SOURCE, BLOCK, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias(BEFORE))
    within = Window.partitionBy(SOURCE, BLOCK).orderBy(ORDER, id_col, TOKENS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn(RUNNING, F.sum(TOKENS).over(within)).join(before, [SOURCE, BLOCK]).withColumn(RUNNING, F.col(RUNNING) + F.col(BEFORE))
    copies = F.col(EPOCHS) + ((F.col(RUNNING) <= F.col(LEFT)) & (F.col(LEFT) > 0)).cast("long")
    out = out.withColumn(EPOCHS, F.coalesce(copies, F.col(EPOCHS))).where(F.col(EPOCHS) > 0)
    return out.withColumn(EPOCH, F.explode(F.sequence(F.lit(0).cast("long"), F.col(EPOCHS) - 1)))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with the columns of docs only."""
    return drawn(docs, **options).select(*docs.columns)
