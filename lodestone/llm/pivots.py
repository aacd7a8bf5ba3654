"""Links from lists of candidates without naming the pairs within a component.

Two nodes are candidates if they stand in a list together. A list of near copies is long, and most of its pairs tell
nothing new about components. So in rounds each list names one pivot, the member that shares most with others, and the
members of other components are verified against it: a round makes no more pairs than the lists have rows (`tied`).
What then still stands in a list with another component is paired by its rarest members (`remaining`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discarded, written
from .components import components

PERCENT = 80
#: What may be broadcast at most: a table of numbers whose counted rows take so many bytes in memory, and no more than the
#: session lets Spark broadcast itself. Dozens of such tables follow each other, all of which the driver holds for a while;
#: and tables of a larger bound are sent out at a tenth of a GB and shuffled at half of one, so that what is shuffled grows
#: faster than the input.
BROADCAST_BYTES = 1 << 20
#: What a row of numbers takes in a broadcast table besides 8 bytes a column.
ROW_BYTES = 40
#: Rounds end when no more pairs between components are left than this times the number of nodes, or when a round has
#: left more than LITTLE of those before it: the lists then hold nodes that don't link.
PAIRS_A_NODE = 4
LITTLE = 0.8
MOST_ROUNDS = 2
#: Pivots that a node is verified against in a round: those it shares most lists with.
TIES = 2
#: With more pairs than this times their nodes, one in FIRST_PART is settled before the others.
FEW_PAIRS, FIRST_PART = 4, 5


def of_checked_size(df: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it is small; else as it is, for a join by shuffle."""
    most = min(BROADCAST_BYTES, df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return F.broadcast(df) if df.count() * (8 * len(df.columns) + ROW_BYTES) <= most else df


def sizes_fit(n: str = "n", m: str = "m") -> Column:
    """Whether sets of these sizes can have the similarity at all."""
    return (F.col(n) * 100 >= F.col(m) * PERCENT) & (F.col(m) * 100 >= F.col(n) * PERCENT)


def least_shared(n: Column, m: Column) -> Column:
    """How many members sets of these sizes share at least if they link."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT)).cast("int")


def least_overlap(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100).cast("int")


def required(n: Column, m: Column, l: Column, k: Column) -> Column:  # noqa: E741
    """How many prefix shingles linking sets of sizes n and m share at least, with l and k matches asked of each.

    Of the set whose prefix ends first in the order, all prefix shingles that the other set has are in the other's
    prefix too; no more than the rest of it can be shared beyond.
    """
    return F.greatest(F.least(l, k), least_shared(n, m) - F.greatest(least_overlap(n) - l, least_overlap(m) - k))


def required_within(n: Column, fewest: Column, most: Column, l: Column, k: Column) -> Column:  # noqa: E741
    """The least of `required` for partners of size `fewest` to `most`, as far as these fit at all."""
    low, high = F.greatest(fewest, least_overlap(n)), F.least(most, F.floor(n * 100 / PERCENT).cast("int"))
    return F.least(required(n, low, l, k), required(n, high, l, k))  # it rises up to n and falls from there


def both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sets s and t."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("s"))
    return pairs.join(one, "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("t")), "b")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose `sets` (id, set) link."""
    shared = F.size(F.array_intersect("s", "t"))
    return both(pairs, sets).where(shared * (100 + PERCENT) >= (F.size("s") + F.size("t")) * PERCENT).select("a", "b")


def ids_of(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b), once each."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows with an id, with the label of its component: itself where no link has it."""
    if found is None or found.isEmpty():
        return rows.withColumn("label", F.col("id"))
    labels = written(components(found).withColumnRenamed("node", "id"), "labels")
    return rows.join(of_checked_size(labels), "id", "left").withColumn("label", F.coalesce("label", "id"))


def mixed_lists(rows: DataFrame) -> DataFrame:
    """Those rows (token, id, label, ...) whose list holds more than one component; with the list's largest, `main`."""
    sizes = rows.groupBy("token", "label").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("token").agg(F.count("*").alias("labels"), F.sum("k").alias("k"), F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"))
    lists = written(lists.where("labels > 1").select("token", "main", "k", "most"), "lists")
    return rows.join(of_checked_size(lists), "token")


def tied(listed: DataFrame, verified: Callable[[DataFrame], DataFrame], rounds: int = MOST_ROUNDS) -> tuple[DataFrame | None, DataFrame]:
    """(links, left): links (a, b) by pivots, None for none; and the rows of `listed` that are left, with labels.

    `listed` has (token, id, n): node `id` of set size `n` stands in list `token`; it is a written table. `verified`
    takes candidate pairs (a, b), a < b, once each, and returns those that link as a written table. What is left are
    the rows (token, id, n, label, main) of lists with more than one component; written.
    """
    found, before, nodes = None, None, listed.select("id").distinct().count()
    weight = listed.join(listed.groupBy("token").agg(F.count("*").alias("of")), "token").groupBy("id").agg(F.sum("of").alias("weight"))
    weight = written(weight, "weights")
    rows = written(listed.join(of_checked_size(weight), "id"), "weighted")
    for at in range(rounds + 1):
        left = written(mixed_lists(labelled(rows, found)), "left")
        pairs = left.groupBy("token").agg(F.first("k").alias("k"), F.first("most").alias("most")).agg(F.sum((F.col("k") - F.col("most")) * F.col("k"))).first()[0] or 0
        if pairs <= PAIRS_A_NODE * nodes or at == rounds or (before is not None and pairs > LITTLE * before):
            break
        before = pairs
        # a pivot for each size that may link with it; another one in each round
        about = F.floor(F.log(F.col("n").cast("double")) / 0.2 + 0.5 * (at % 2))
        first = F.struct("weight", F.xxhash64("id", F.lit(at))) if at < 2 else F.struct(F.xxhash64("id", F.lit(at)))
        ranked = left.withColumn("about", about)
        pivots = ranked.groupBy("token", "about").agg(F.max_by(F.struct("id", "label"), first).alias("p"), F.count("*").alias("of")).where("of > 1")
        pivots = pivots.select("token", "about", F.col("p.id").alias("pivot"), F.col("p.label").alias("its"))
        ties = ranked.join(pivots, ["token", "about"]).where("label <> its").groupBy("id", "pivot").agg(F.count("*").alias("shared"))
        best = Window.partitionBy("id").orderBy(F.desc("shared"), "pivot")
        ties = ties.withColumn("at", F.row_number().over(best)).where(F.col("at") <= TIES)
        ties = written(ties.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "ties")
        new = verified(ties)
        found = new if found is None else written(found.unionByName(new), "found")
        discarded(left)
    return found, left.select("token", "id", "n", "label", "main")


def remaining(rows: DataFrame, verified: Callable[[DataFrame], DataFrame], found: DataFrame | None) -> DataFrame:
    """Links (a, b): `found` and those between its components.

    `rows` is a written table (token, id, n, label, l): the first n - least_overlap(n) + l members of each node's set in
    one order; for l = 1 only those of them that the prefix for l = 1 of a node of another component has too. All pairs
    that may link are verified, and none whose common members here are too few.
    """
    n, m, one = F.col("n"), F.col("m"), F.lit(1)
    rows = rows.select("token", "id", "n", "label", (least_overlap(n) - F.col("l")).alias("rest"), (F.col("l") == 1).alias("plain"))
    lists = rows.groupBy("token").agg(F.count("*").alias("df"), F.max("rest").alias("others"), F.max("plain").alias("any_plain"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.min("label").alias("x"), F.max("label").alias("y"))
    lists = written(lists.where("x <> y").drop("x", "y"), "lists")
    # a node shares with a partner as many members as `required` asks for; the last of these, the rarest, has as many
    # before it in both, so that only from there on members are looked up, and pairs are made of none before
    mine = Window.partitionBy("id")
    asked = F.when(F.col("any_plain"), required_within(n, F.col("fewest"), F.col("most"), one, one))
    asked = asked.otherwise(F.greatest(one, least_shared(n, F.greatest("fewest", least_overlap(n))) - F.greatest("rest", "others")))
    rows = rows.join(of_checked_size(lists), "token").withColumns({"asked": asked, "kept": F.count("*").over(mine)}).where("kept >= asked")
    rows = rows.withColumn("at", F.row_number().over(mine.orderBy(F.desc("df"), "token")))
    rows = written(rows.select("token", "id", "n", "label", "rest", "plain", "at", "asked"), "prefixes")
    rest = F.when(F.col("plain") | F.col("its_plain"), F.greatest(least_overlap(n), least_overlap(m)) - 1).otherwise(F.greatest("rest", "its_rest"))
    asked = F.greatest(one, least_shared(n, m) - rest)
    looked = rows.where(F.col("at") >= F.col("asked")).select("token", "id", "n", "label", "rest", "plain", "at")
    pairs = looked.withColumnRenamed("id", "a").join(looked.toDF("token", "b", "m", "its", "its_rest", "its_plain", "its_at"), "token")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.col("label") != F.col("its")) & sizes_fit() & (F.least("at", "its_at") >= asked))
    pairs = written(pairs.groupBy("a", "b").agg(F.first(asked).alias("asked")), "pairs")
    stored = rows.join(of_checked_size(written(ids_of(pairs), "ids")), "id", "left_semi")
    stored = written(stored.groupBy("id").agg(F.collect_list("token").alias("set")), "stored")  # no more than the set

    def settled(some: DataFrame) -> DataFrame:
        return verified(written(both(some, stored).where(F.size(F.array_intersect("s", "t")) >= F.col("asked")).select("a", "b"), "near"))

    joined = lambda new: new if found is None else written(found.unionByName(new), "found")
    if pairs.count() <= FEW_PAIRS * stored.count():
        return joined(settled(pairs))
    # where pairs are many, most tell nothing new: a part of them is settled first, and of the others only those between
    # what are different components then
    part = F.pmod(F.xxhash64("a", "b"), F.lit(FIRST_PART))
    found = joined(settled(written(pairs.where(part == 0), "first")))
    labels = of_checked_size(written(components(found), "labels"))
    rest = pairs.where(part != 0).join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    return joined(settled(written(rest.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b", "asked"), "rest")))
