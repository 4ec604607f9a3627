"""Chat formatting by quotation linking, with DataFrame and SQL functions only.

A line's quote level is the number of > before its text. A passage is a run of
lines of one level, none blank, with white space collapsed and letters lowered.
Quoted passages are matched by hash with the unquoted passages, and runs of as
many unquoted lines (single ones always) within a passage, of earlier turns of
their conversation; the latest such turn is the one they quote. A message answers the turn of its shallowest linked
passage, the latest of these. Threads are ordered by their first turn, messages
in a thread by turn, so that every message follows the one that it answers.

Defined results: null text is empty text, and a null role stays null; messages
without a linked quote start a thread; repeated rows (one conversation and
turn) are each formatted, and quoted as one; rows with a null conversation or
turn are in no thread: they answer nothing, with null order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import asof, common

#: Turns of a conversation that are numbered by one task.
WIDTH = 1024
#: Fixed value: what stands before a quoted line's text.
MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def lines_of(text: Column) -> Column:
    """array<struct<level, body>>: blank lines have level -1."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")
    marks = lambda line: F.regexp_extract(line, MARKS, 1)
    body = lambda line: F.regexp_replace(line, MARKS, "")
    blank = lambda line: F.regexp_replace(body(line), r"[ \t\x0B\f\r ]+", "") == ""
    level = lambda line: F.when(blank(line), -1).otherwise(F.length(F.regexp_replace(marks(line), "[^>]", "")))
    return F.transform(lines, lambda line: F.struct(level(line).cast("int").alias("level"), body(line).alias("body")))


def normal(text: Column) -> Column:
    return F.md5(F.lower(F.trim(F.regexp_replace(text, r"[ \t\x0B\f\r\n ]+", " "))))


def passages_of(lines: Column) -> Column:
    """array<struct<level, hash, count>> of the runs of lines of one level, blank ones left out."""
    n = F.size(lines)
    at = lambda i: F.get(lines, i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (at(i)["level"] >= 0) & ((i == 0) | (at(i)["level"] != F.coalesce(at(i - 1)["level"], F.lit(-2)))))
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (at(i)["level"] >= 0) & ((i == n - 1) | (at(i)["level"] != F.coalesce(at(i + 1)["level"], F.lit(-2)))))
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda r: F.struct(at(r["s"])["level"].alias("level"), normal(F.array_join(F.transform(F.slice(lines, r["s"] + 1, r["e"] - r["s"] + 1), lambda x: x["body"]), " ")).alias("hash"), (r["e"] - r["s"] + 1).alias("count")),
    )


def runs_of(lines: Column, count: Column) -> Column:
    """array<struct<level, hash>> of all runs of count unquoted lines without a blank one between them; count is at most the number of lines."""
    runs = F.transform(F.sequence(F.lit(1), F.size(lines) - count + 1), lambda i: F.slice(lines, i, count))
    runs = F.filter(runs, lambda run: F.forall(run, lambda x: x["level"] == 0))
    return F.transform(runs, lambda run: F.struct(F.lit(0).alias("level"), normal(F.array_join(F.transform(run, lambda x: x["body"]), " ")).alias("hash")))


def unquoted(text: Column) -> Column:
    """text without its quoted lines; as it is where it has none."""
    lines = F.split(text, "\r\n|\n|\r")
    kept = F.filter(lines, lambda line: ~line.rlike(r"^[ \t]*>"))
    return F.when(F.size(kept) == F.size(lines), text).otherwise(F.trim(F.array_join(kept, "\n")))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, level, hash, quoted): every quoted passage with the turn that it quotes, or null."""
    def rows_of(some: DataFrame) -> DataFrame:
        known = some.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
        return known.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), lines_of(F.col(text)).alias("lines"))

    rows = rows_of(messages)
    parts = rows.select("conv", "turn", passages_of(F.col("lines")).alias("passages"), "lines")
    single = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: F.struct(F.lit(0).alias("level"), normal(x["body"]).alias("hash")))
    whole = F.transform("passages", lambda p: F.struct(p["level"].alias("level"), p["hash"].alias("hash")))
    parts = parts.select("conv", "turn", F.explode(F.array_distinct(F.concat(whole, single))).alias("p")).select("conv", "turn", "p.level", "p.hash")
    # Runs of several lines are offered in the lengths that quotes of their conversation have.
    quoting = rows_of(messages.where(F.col(text).rlike(r"(?m)^[ \t]*>")))
    lengths = quoting.select("conv", F.explode(passages_of(F.col("lines"))).alias("p")).where("p.level > 0 and p.count > 1").select("conv", F.col("p.count").alias("count")).distinct()
    runs = rows.join(lengths, "conv").where(F.size("lines") >= F.col("count"))
    runs = runs.select("conv", "turn", F.explode(F.array_distinct(runs_of(F.col("lines"), F.col("count")))).alias("p"))
    parts = parts.union(runs.select("conv", "turn", "p.level", "p.hash"))
    offer = F.when(F.col("level") == 0, F.struct("turn"))
    out = asof.latest_earlier(parts, ["conv", "hash"], "turn", offer, F.col("level") > 0, "found")
    return out.select("conv", "turn", "level", "hash", F.col("found.turn").alias("quoted"))


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, quotes, links, parent, root) of each turn that quotes; root is found by halving the way up."""
    links = common.written(linked(messages, conv, turn, text), "quotes")
    best = F.min(F.when(F.col("quoted").isNotNull(), F.struct("level", (-F.col("quoted")).alias("back"))))
    out = links.groupBy("conv", "turn").agg(F.count("*").alias("quotes"), F.count("quoted").alias("links"), best.alias("best"))
    out = common.written(out.select("conv", "turn", "quotes", "links", (-F.col("best.back")).alias("parent")), "quote-parents")
    up = out.where("parent is not null").select("conv", "turn", F.col("parent").alias("root"))
    while True:
        further = up.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        up = common.written(up.join(further, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "quote-roots")
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return out.join(up.select("conv", "turn", "root"), ["conv", "turn"], "left")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text without quotes, quotes, links, parent, root and position in the reply order."""
    found = threads(messages, conv, turn, text)
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), unquoted(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    # Sums over runs of turns give positions without a task for a whole conversation.
    rows = rows.join(found, ["conv", "turn"], "left").withColumns({"quotes": F.coalesce("quotes", F.lit(0)), "links": F.coalesce("links", F.lit(0)), "root": F.coalesce("root", "turn")})
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    rows = rows.withColumn(common.OWN + "cell", F.floor(F.col("root") / WIDTH))
    cells = rows.where(known).groupBy("conv", common.OWN + "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy(common.OWN + "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv", common.OWN + "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(common.OWN + "before"))
    order = Window.partitionBy("conv", common.OWN + "cell").orderBy("root", "turn", F.coalesce("role", F.lit("")), "text")
    rows = rows.withColumn("position", F.row_number().over(order)).join(cells, ["conv", common.OWN + "cell"], "left")
    position = F.when(known, F.col("position") + F.col(common.OWN + "before")).cast("long")
    return rows.select("conv", "turn", "role", "text", "quotes", "links", "parent", F.when(known, F.col("root")).alias("root"), position.alias("position"))


def quoting_stream(messages: DataFrame) -> DataFrame:
    """conversations as mail: by their number, turns quote earlier ones of theirs, above their own text.

    Of each four turns from the second on, one quotes the turn before it as a
    whole, one that turn with its own quotes (nested), one the last paragraph
    line of the turn two before, one nothing. Repeated rows quote the least text.
    """
    said = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    back = lambda n, name: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(name))
    quoted = lambda text: F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> "), F.lit("\n\n"))
    rows = messages.join(back(1, "one"), ["conv_id", "turn"], "left").join(back(2, "two"), ["conv_id", "turn"], "left")
    kind, line = F.col("turn") % 4, F.element_at(F.split("two", "\n"), -1)
    nested = F.concat(F.coalesce(F.concat(F.lit("> > "), F.regexp_replace("two", "\n", "\n> > "), F.lit("\n")), F.lit("")), quoted(F.col("one")))
    above = F.when(kind == 1, quoted(F.col("one"))).when(kind == 2, nested).when(kind == 3, quoted(line))
    return rows.withColumn("text", F.concat(F.coalesce(above, F.lit("")), F.coalesce("text", F.lit("")))).select(*messages.columns)
