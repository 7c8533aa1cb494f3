"""Mixing sources to target weights by hierarchical budgeting.

Levels of columns (say domain, language, source) make a tree. A budget of tokens goes from the root down: each
node gives its children shares by weight. A leaf can take its tokens ``epochs`` times at most; what a child
can't take goes to its siblings by weight, and only what all of them together can't take goes back to the
ancestors, to be shared by their siblings in the same way. Each leaf then takes whole epochs while they fit and a
prefix of the next one, in an order that the seed and the epoch's number give; the prefix ends with the
document that reaches the leaf's budget.

The tree is a table of a row for each node and stays one: room is summed from the leaves up, a level at a time, and budgets go down.
Among the children of a node the fair level is found without rounds: with children in the order of room by weight, what is left
behind each prefix of full ones is divided by the weights from there on, and the greatest of these quotients is the level at
which every open child gets its weight's share and every other one its room. ``allot`` states the same rule for small trees.

The prefix of a leaf is found without sorting the
leaf in one task: documents fall into ranges of their order, the ranges' sums are prefix-summed, and each range is
then summed by itself, so a leaf that holds a third of all rows is spread over as many tasks as it has ranges.

Defined cases: a null level is a value of its own; very long texts are counted whole; a null or empty text has no token and is taken with the epoch
it stands in while the leaf's budget isn't reached; documents with the same order and id (repeated rows) are
taken in the order of their texts' hashes and, if wholly equal, together; rows equal in id and text but of different leaves
are taken as their own leaf has it; an empty table gives an empty table; other
columns are not read by ``select`` and pass through ``mix``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidra.llm.shared import Scratch

#: Documents of a range of a leaf's order, about.
RANGE_ROWS = 2_000
#: Taken documents, and leaves, that may be broadcast.
BROADCAST = 500_000


@dataclass
class Plan:
    """levels: columns from the root down. weights: by path (a tuple of level values, None for null) the weight among
    its siblings, 1 where absent. budget: tokens in all, or a share of the tokens there are if not above 1."""

    levels: list[str]
    budget: float = 0.5
    weights: dict[tuple, float] = field(default_factory=dict)
    epochs: int = 1
    seed: int = 42


def allot(available: dict[tuple, float], budget: float, weights: dict[tuple, float]) -> dict[tuple, float]:
    """The tokens of each leaf of a small tree: available has what a leaf can take at most, by path."""
    room: dict[tuple, float] = {}
    children: dict[tuple, list[tuple]] = {}
    for path, n in available.items():
        for k in range(len(path) + 1):
            room[path[:k]] = room.get(path[:k], 0) + n
        for k in range(len(path)):
            children.setdefault(path[:k], {}).setdefault(path[: k + 1])
    out: dict[tuple, float] = {}

    def share(path: tuple, tokens: float) -> None:
        """Tokens never exceed a node's room, so a shortage of a child is met among its siblings first."""
        own = children.get(path)
        if not own:
            out[path] = tokens
            return
        given, open_ = {c: 0.0 for c in own}, {c for c in own if room[c] > 0 and weights.get(c, 1.0) > 0}
        left = tokens
        while left > 1e-9 and open_:
            total = sum(weights.get(c, 1.0) for c in open_)
            full = {c for c in open_ if given[c] + left * weights.get(c, 1.0) / total >= room[c]}
            if not full:
                for c in open_:
                    given[c] += left * weights.get(c, 1.0) / total
                left = 0
            for c in sorted(full, key=repr):
                left -= room[c] - given[c]
                given[c] = room[c]
            open_ -= full
        for c in own:
            share(c, given[c])

    if () in room:
        root = min(budget, _reach(children, room, weights, ()))
        _limit(children, room, weights)
        share((), root)
    return out


def _reach(children, room, weights, path) -> float:
    """What a node can take without the children of weight 0."""
    own = children.get(path)
    return room[path] if not own else sum(_reach(children, room, weights, c) for c in own if weights.get(c, 1.0) > 0)


def _limit(children, room, weights) -> None:
    for path in sorted(children, key=len, reverse=True):
        room[path] = sum(room[c] for c in children[path] if weights.get(c, 1.0) > 0)


def _path(levels: list[Column]) -> Column:
    """Levels as an array without nulls: a null level is n, another one v and its value."""
    return F.array(*(F.coalesce(F.concat(F.lit("v"), c), F.lit("n")) for c in levels))


def budgets(leaves: DataFrame, levels: int, budget: float, weights: dict[tuple, float]) -> DataFrame:
    """path and given of each leaf (path, room), as ``allot`` has it."""
    spark = leaves.sparkSession
    told = [(["n" if v is None else f"v{v}" for v in path], float(w)) for path, w in weights.items()]
    # As many rows as the plan has weights.
    own = F.broadcast(spark.createDataFrame(told, "path array<string>, weight double"))
    nodes = [leaves.join(own, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))]
    for k in range(levels - 1, -1, -1):
        room = F.sum(F.when(F.col("weight") > 0, F.col("room")).otherwise(0.0)).alias("room")
        up = nodes[0].groupBy(F.slice("path", 1, k).alias("path")).agg(room)
        nodes.insert(0, up.join(own, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))))
    given = nodes[0].select(F.col("path").alias("above"), F.least(F.lit(float(budget)), F.col("room")).alias("tokens"))
    for k in range(1, levels + 1):
        below = nodes[k].withColumn("above", F.slice("path", 1, k - 1)).join(given, "above")
        # A child without weight gets nothing.
        below = below.withColumn("open", F.when(F.col("weight") > 0, F.col("room") / F.col("weight")))
        by = Window.partitionBy("above")
        by_open = by.orderBy(F.col("open").asc_nulls_last(), "path")
        full = F.coalesce(F.sum("room").over(by_open.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum(F.when(F.col("open").isNotNull(), F.col("weight"))).over(by_open.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        below = below.withColumn("quotient", F.when(F.col("open").isNotNull(), (F.col("tokens") - full) / left))
        level = F.max("quotient").over(by)
        got = F.when(F.col("open").isNotNull(), F.least("room", F.greatest(level, F.lit(0.0)) * F.col("weight"))).otherwise(0.0)
        given = below.select(F.col("path").alias("above"), got.alias("tokens"))
    return given.select(F.col("above").alias("path"), F.col("tokens").alias("given"))


def tokens_of(text: Column) -> Column:
    """White-space words, the count of tokens unless another is given."""
    trimmed = F.trim(text, F.lit(" \t\n\r\x0b\f"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\r\x0B\f]+", -1))).cast("long")


def _order(seed: int, epoch: int) -> Column:
    """A place in [0, 2^62) that the seed, the epoch and the document give."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), F.col("__evidra_id")), 2)


def select(docs: DataFrame, plan: Plan, id_column: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """Per document: its levels, tokens and the number of times it is taken.

    Columns: id, levels as __evidra_level_k, __evidra_tokens, __evidra_tie, __evidra_copies.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    names = [f"__evidra_level_{k}" for k in range(len(plan.levels))]
    count = tokens_of(F.col(text).cast("string")) if tokens is None else tokens
    own = docs.select(F.col(id_column).cast("long").alias("__evidra_id"), *(F.col(c).cast("string").alias(n) for c, n in zip(plan.levels, names)), F.coalesce(count, F.lit(0)).alias("__evidra_tokens"), F.xxhash64(F.col(text).cast("string")).alias("__evidra_tie"))
    own = scratch.keep(own, "sizes")
    leaves = own.groupBy(*names).agg(F.sum("__evidra_tokens").alias("n"), F.count(F.lit(1)).alias("rows"))
    leaves = scratch.keep(leaves.withColumn("path", _path([F.col(n) for n in names])), "leaves")
    told = leaves.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("leaves")).first()
    budget = plan.budget * (told["n"] or 0) if plan.budget <= 1 else plan.budget
    given = budgets(leaves.select("path", (F.col("n") * plan.epochs).cast("double").alias("room")), len(names), budget, plan.weights)
    # Budgets are whole tokens but for rounding.
    n, given_ = F.col("n"), F.round("given", 6)
    times = F.when(n > 0, F.least(F.floor(given_ / n), F.lit(plan.epochs))).otherwise(0).cast("int")
    rest = F.when(F.col("__evidra_times") < plan.epochs, given_ - F.col("__evidra_times") * n).otherwise(0.0)
    of_leaf = leaves.join(given, "path").withColumn("__evidra_times", times).withColumn("__evidra_rest", rest)
    of_leaf = of_leaf.select(*(F.col(c).alias(f"{c}_b") for c in names), "__evidra_times", F.when(F.col("__evidra_rest") > 0.5, F.col("__evidra_rest")).otherwise(0.0).alias("__evidra_rest"), F.greatest(F.lit(1), F.floor(F.col("rows") / RANGE_ROWS)).cast("int").alias("__evidra_ranges"))
    of_leaf = scratch.keep(of_leaf, "budgets")
    if told["leaves"] <= BROADCAST:
        of_leaf = F.broadcast(of_leaf)
    on = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in names]
    placed = own.join(of_leaf, on).drop(*(f"{c}_b" for c in names))
    order = F.lit(None).cast("long")
    for epoch in range(plan.epochs):
        order = F.when(F.col("__evidra_times") == epoch, _order(plan.seed, epoch)).otherwise(order)
    placed = placed.withColumn("__evidra_order", F.coalesce(order, F.lit(0)))
    width = F.lit(1 << 62) / F.col("__evidra_ranges")
    placed = placed.withColumn("__evidra_range", F.least(F.floor(F.col("__evidra_order") / width), F.col("__evidra_ranges") - 1).cast("int"))
    inside = placed.where("__evidra_rest > 0")
    sums = inside.groupBy(*names, "__evidra_range").agg(F.sum("__evidra_tokens").alias("__evidra_sum"))
    # A row a range, not a row a document: a leaf's ranges are prefix-summed together.
    up_to = Window.partitionBy(*names).orderBy("__evidra_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(n).alias(f"{n}_s") for n in names), F.col("__evidra_range").alias("__evidra_range_s"), F.coalesce(F.sum("__evidra_sum").over(up_to), F.lit(0)).alias("__evidra_before"))
    on = [F.col(n).eqNullSafe(F.col(f"{n}_s")) for n in names] + [F.col("__evidra_range") == F.col("__evidra_range_s")]
    ranged = inside.join(before, on).drop(*(f"{n}_s" for n in names), "__evidra_range_s")
    inner = Window.partitionBy(*names, "__evidra_range").orderBy("__evidra_order", "__evidra_id", "__evidra_tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*names, "__evidra_range", "__evidra_order", "__evidra_id", "__evidra_tie")
    reached = F.col("__evidra_before") + F.sum("__evidra_tokens").over(inner) - F.sum("__evidra_tokens").over(equal)
    taken = ranged.withColumn("__evidra_copies", F.col("__evidra_times") + F.when(reached < F.col("__evidra_rest"), 1).otherwise(0))
    keep = ["__evidra_id", *names, "__evidra_tokens", "__evidra_tie", "__evidra_copies"]
    whole_only = placed.where("__evidra_rest <= 0").withColumn("__evidra_copies", F.col("__evidra_times"))
    return taken.select(*keep).unionByName(whole_only.select(*keep))


def mix(docs: DataFrame, plan: Plan, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs as often as they are taken, with all their columns."""
    scratch = Scratch(docs.sparkSession, "taken")
    names = [f"__evidra_level_{k}" for k in range(len(plan.levels))]
    taken = select(docs, plan, id_column, text).where("__evidra_copies > 0").groupBy("__evidra_id", "__evidra_tie", F.xxhash64(_path([F.col(n) for n in names])).alias("__evidra_leaf")).agg(F.max("__evidra_copies").alias("__evidra_copies"))
    taken = scratch.keep(taken)
    if taken.count() <= BROADCAST:
        taken = F.broadcast(taken)
    # The row is kept as one column, so that no name can clash.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__evidra_row"), F.col(id_column).cast("long").alias("__evidra_mine"), F.xxhash64(F.col(text).cast("string")).alias("__evidra_text"), F.xxhash64(_path([F.col(c).cast("string") for c in plan.levels])).alias("__evidra_mine_leaf"))
    on = F.col("__evidra_mine").eqNullSafe(F.col("__evidra_id")) & (F.col("__evidra_text") == F.col("__evidra_tie"))
    kept = own.join(taken, on & (F.col("__evidra_mine_leaf") == F.col("__evidra_leaf")))
    if plan.epochs > 1:
        kept = kept.withColumn("__evidra_copy", F.explode(F.sequence(F.lit(1), F.col("__evidra_copies"))))
    return kept.select("__evidra_row.*")


#: The production plan of ``documents``: domains are groups of sources, weighted 4:3:2:1.
DOMAINS = 4


def domain_of(source: Column) -> Column:
    """A source's domain: the remainder of its number by DOMAINS, or 'other'."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.when(number != "", number.cast("int")) % DOMAINS).cast("string")))


def production_plan(epochs: int = 2, budget: float = 0.6, domain: str = "__evidra_domain") -> Plan:
    return Plan([domain, "lang", "source"], budget, {(f"domain{k}",): float(DOMAINS - k) for k in range(DOMAINS)}, epochs, 42)


def report(docs: DataFrame) -> DataFrame:
    """Per document: domain, language, source, tokens, and how often the mix takes it."""
    own = docs.withColumn("__evidra_domain", domain_of(F.col("source").cast("string")))
    taken = select(own, production_plan())
    return taken.select(F.col("__evidra_id").alias("doc_id"), F.col("__evidra_level_0").alias("domain"), F.col("__evidra_level_1").alias("lang"), F.col("__evidra_level_2").alias("source"), F.col("__evidra_tokens").alias("n_tokens"), F.col("__evidra_copies").cast("long").alias("copies"))
