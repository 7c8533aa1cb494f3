"""N-gram Jaccard join, exact, by a grouped prefix join.

A document's set are the 64-bit hashes of its distinct word n-grams. Two documents link when
100 * |intersection| >= percent * |union|. What is wanted are the components of links, never the pairs.

1. Documents of equal sets are one member; its node is its least doc_id, and only that document is read on.
2. Rare n-grams come first in the order of the prefix filter. Those that several members have among the first of their
   n-grams by hash are counted, with partial sums; the counts of the ``KNOWN`` most frequent ones are told to all tasks, as a table that has
   for each range of hashes the logarithm of the greatest. The order is (that logarithm, hash). Any order gives exact results; this one
   keeps common passages out of the prefixes.
3. Two sets that link share an n-gram of their prefixes (the first n - ceil(t * n) + 1). Of each prefix only the tokens that some
   other member's prefix holds are kept: no other can be shared. Members with the same tokens left and the same size
   are one group, which stands for them from here on.
4. Groups meet in cells of a token and a band of sizes. In each cell every group is paired with the cell's hub, the group
   with the least n-grams of its own. What passes the filters of group pairs - sizes, and the positions of the token, which
   bound the intersection - is expanded: each member of a group with its representative, representatives with hubs.
   Sketches (parities of hashed n-grams, which bound the difference) filter pairs once more, and the sets of what is left are intersected.
5. The components of these verified links leave few cells with more than one component. In those of at most ``CELL`` members all
   groups are paired, and pairs that the filters pass and that aren't of one component are expanded to members of
   different components and verified in the same way. Pairs within a component can't change it and are never made.
6. In larger cells pairs are no rows: the sets of their members meet in blocks of a bounded weight, intersections are counted by products
   of a membership matrix, and a task returns a spanning forest of the links it has found. Cells of a band that have a group in common make
   one family, so that a pair doesn't meet once for each token; a family of many n-grams is cut into chunks that meet by pairs.

Sets are joined to pairs with a salt for nodes that stand in many pairs; classes of many rows get their results by a broadcast of
a checked size.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a
document without id takes no part and has no component; rows that share a doc_id are one document, whose set are the
n-grams of all its texts; fewer words than n make one n-gram of the whole sequence; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.components import components, labels_of
from evidra.llm.shared import Scratch, give_back, map_batches, shuffle_partitions, text_parts, unused

#: N-grams whose counts are told to all tasks, at most, in a table of four bytes for each (rounded up to a power of two).
KNOWN = 1 << 23
#: Rows that may be broadcast (a few numbers each).
BROADCAST = 500_000
#: Pairs of one node that one task handles, about.
SLICE = 256
#: Members of a cell that are paired by a join; larger cells meet in blocks.
CELL = 32
#: N-grams of a chunk of a block, about.
CHUNK = 2_000_000
#: Columns and rows of a product of a membership matrix.
COLUMNS, ROWS = 8192, 2048
#: Rows of one class that are joined in one task, about.
CLASS_ROWS = 2_000
#: 64-bit words of a sketch.
SKETCH = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; words are split at space and U+0009 to U+000D, A-Z lower-cased."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.encode().lower().split()
        counts[i] = len(found)
        words += found
    if not words:
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array(words, object))
    h = pd.util.hash_array(distinct, categorize=False)[codes]
    n = len(h)
    out = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        out = out * _ODD + h[k : len(out) + k]
    out = _mixed(out)
    ends = np.cumsum(counts)
    result = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= width:
            own = np.sort(out[a : b - width + 1])
            result.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = np.uint64((int(short) * int(_ODD) + int(x) + 1) & (2**64 - 1))
            result.append(_mixed(np.array([short])))
        else:
            result.append(np.zeros(0, np.uint64))
    return result


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with a set for each row; the column more has further texts of a row's document, or null."""
    for part, texts in text_parts(batches):
        sets = shingles(texts, width)
        for i, more in enumerate(part.column("more").to_pylist()):
            if more:
                sets[i] = np.unique(np.concatenate([sets[i], *shingles(more, width)]))
        yield part, sets


def _least(n, percent: int):
    """The least intersection with a set of n that a linked set of any size has: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def band_of(n, percent: int):
    """Sizes in bands, so that linked sets are of one band or of two that follow each other."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _members(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for part, sets in _each(batches, width):
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            sig = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1])], names=["doc_id", "n", "sig_a", "sig_b"])

    return map_batches(docs, run, "doc_id long, n long, sig_a long, sig_b long")


def _united(own: DataFrame, members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """own with a row for each doc_id whose rows have different sets, and the doc_id and number of rows of those, if any."""
    sig = ["sig_a", "sig_b"]
    ranges = [f(c).alias(f"{name}_{c}") for c in sig for name, f in (("low", F.min), ("high", F.max))]
    each = members.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), *ranges)
    several = scratch.keep(each.where("low_sig_a <> high_sig_a or low_sig_b <> high_sig_b").select("doc_id", "rows"), "several")
    n = several.count()
    if not n:
        return own, None
    ids = F.broadcast(several.select("doc_id")) if n <= BROADCAST else several.select("doc_id")
    texts = own.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    one = scratch.keep(texts.select("doc_id", F.get("texts", F.lit(0)).alias("text"), F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))).alias("more")), "united")
    return own.join(ids, "doc_id", "left_anti").unionByName(one), several


def _some(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if n <= BROADCAST else df


def _flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _known(reps: DataFrame, width: int, percent: int, scratch: Scratch) -> np.ndarray:
    """A table over ranges of hashes: the logarithm of the greatest count told of an n-gram of the range."""

    def run(batches):
        for _, sets in _each(batches, width):
            # More than a prefix: what takes the place of a frequent n-gram is mostly counted, too.
            first = _flat([s[: 3 * (len(s) - _least(len(s), percent) + 1) // 2] for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64))], names=["token"])
        give_back()

    level = F.floor(F.log2("n")).cast("int").alias("level")
    counts = map_batches(reps, run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token", level)
    counts = scratch.keep(counts, "counts")
    # Whole levels, the highest first, as far as the bound allows; a level is a row.
    least, rows = 64, 0
    for r in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if (rows := rows + r["n"]) > KNOWN:
            break
        least = r["level"]
    bits = max(16, int(np.ceil(np.log2(4 * max(rows, 1)))))
    bits = min(bits, int(np.ceil(np.log2(4 * max(KNOWN, 1 << 14)))))
    low = min(bits, 16)
    place = F.shiftrightunsigned("token", 64 - bits)
    told = counts.where(F.col("level") >= least).select(F.shiftright(place, low).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("place"), "level")

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << low, np.uint8)
        np.maximum.at(held, pdf["place"].to_numpy(), pdf["level"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"part": [key[0]], "held": [held.tobytes()]})

    table = np.zeros(1 << bits, np.uint8)
    # A part has as many rows at most as places, once equal places are one; the parts are the table, which KNOWN bounds.
    parts = told.groupBy("part", "place").agg(F.max("level").alias("level")).groupBy("part").applyInPandas(fill, "part int, held binary")
    for r in parts.toLocalIterator():
        table[r["part"] << low : (r["part"] + 1) << low] = np.frombuffer(r["held"], np.uint8)
    return table


def in_order(own: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The first n-grams of a sorted set, by the table's logarithm of the count and then by hash."""
    level = table[own >> np.uint64(65 - len(table).bit_length())]
    return own[np.argsort(level, kind="stable")[:size]]


def _prefixes(reps: DataFrame, width: int, percent: int, known) -> DataFrame:
    """node, n, token and its position, of all prefixes of sets that may link with others."""

    def run(batches):
        for part, sets in _each(batches, width):
            names, out = part.column("doc_id").to_pylist(), []
            for name, s in zip(names, sets):
                n = len(s)
                # A set that is too small for a difference of one n-gram links with equal sets only.
                if 100 * n >= percent * (n + 1):
                    out.append((name, n, in_order(s, known.value, n - _least(n, percent) + 1)))
            size = np.array([len(x) for _, _, x in out], np.int64)
            node, n = (np.repeat(np.array([o[k] for o in out], np.int64), size) for k in (0, 1))
            place = _flat([np.arange(k) for k in size.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int32)), pa.array(_flat([x for _, _, x in out], np.uint64).view(np.int64)), pa.array(place.astype(np.int32))], names=["node", "n", "token", "place"])
        give_back()

    return map_batches(reps, run, "node long, n int, token long, place int")


def _groups(prefixes: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (node, gid) and groups (gid, n, own, tokens): members of one size whose prefixes hold the same shared tokens.

    gid is the least node of a group, own the least number of n-grams of a member's prefix before its first shared one.
    """
    shared = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    each = prefixes.join(shared.hint("merge"), "token").groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("place", "token"))).alias("at"))
    each = each.select("node", "n", F.col("at.token").alias("tokens"), F.col("at")[0]["place"].alias("own"))
    sign = [F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(7), "tokens").alias("b")]
    each = scratch.keep(each.select("node", "n", "own", "tokens", *sign), "shared")
    # Partial sums leave one row of a group in a task.
    groups = scratch.keep(each.groupBy("a", "b", "n").agg(F.min("node").alias("gid"), F.min("own").alias("own"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups")
    several = groups.where("rows > 1").select("a", "b", "n", "gid", "rows")
    in_several = _with_class(each.select("node", "a", "b", "n"), several, ["a", "b", "n"], scratch).where("node <> gid").select("node", "gid")
    return scratch.keep(in_several, "members"), groups.select("gid", "n", "own", "tokens")


def _with_class(rows: DataFrame, classes: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """rows joined (inner) with classes, which are unique by their key and have a number of rows each.

    Classes of many rows are broadcast, so that none of them lands in one task; there are few of them.
    """
    hot = classes.where(F.col("rows") > CLASS_ROWS)
    n = hot.count()
    if not n:
        return rows.join(classes, by)
    if n > BROADCAST:
        salt = F.pmod(F.xxhash64(rows.columns[0]), F.lit(16)).cast("int")
        return rows.withColumn("salt", salt).join(classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), [*by, "salt"]).drop("salt")
    rest = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(classes.where(F.col("rows") <= CLASS_ROWS), by)
    return rest.unionByName(rows.join(F.broadcast(hot), by).select(*rest.columns))


def _cells(groups: DataFrame, percent: int) -> DataFrame:
    """A row for each group, token and band in which others may be met; i is the token's index among the shared ones.

    hub is the cell's group with the least tokens of its own. A pair meets in the cell of the lower band of the two, so one of them at least has the cell for its base.
    """
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    rows = groups.select("gid", "n", "own", band.alias("band"), F.posexplode("tokens").alias("i", "token"))
    rows = rows.withColumn("cell", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("base", F.col("band") == F.col("cell")).drop("band")
    hubs = rows.groupBy("token", "cell").agg(F.min(F.struct("own", "gid", "n", "i")).alias("hub"), F.count(F.lit(1)).alias("k"), F.max("base").alias("b")).where("k > 1 and b")
    return rows.join(hubs.select("token", "cell", "hub").hint("merge"), ["token", "cell"])


def _may(x, y, percent: int) -> Column:
    """The filters of group pairs: the sizes, and what can be shared before, at and after the token met.

    Tokens that no other prefix holds can't be shared, so what is before is at most the lesser index, and what is after lies behind
    the own ones, too. x and y give a group's columns by name.
    """
    need = F.ceil(percent * (x("n") + y("n")) / F.lit(100 + percent) - 1e-9)
    rest = lambda t: t("n") - t("own") - t("i") - 1
    most = F.least(x("i"), y("i")) + 1 + F.least(rest(x), rest(y))
    return (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & (most >= need)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the numbers of n-grams in each of 64 * SKETCH places: two sets differ in at least as many n-grams as
    their sketches in bits."""
    places = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").view(np.int64)


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _read(reps: DataFrame, nodes: DataFrame, width: int, whole: bool, scratch: Scratch) -> DataFrame:
    """node and its set, or its size n and sketch, of each of the nodes."""

    def run(batches):
        for part, sets in _each(batches, width):
            if whole:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])
            else:
                sketches = np.concatenate([sketch(s) for s in sets]) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * SKETCH).astype(np.int32)), pa.array(sketches))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), lists], names=["node", "n", "sketch"])
        give_back()

    nodes = scratch.keep(nodes, "nodes")
    some = reps.join(_some(nodes.withColumnRenamed("node", "doc_id"), nodes.count()), "doc_id", "left_semi")
    return scratch.keep(map_batches(some, run, "node long, set binary" if whole else "node long, n long, sketch array<long>"), "sets" if whole else "sketches")


def _beside(pairs: DataFrame, sets: DataFrame, side: str, columns: dict[str, str]) -> DataFrame:
    """pairs with columns of their node a or b; a node of many pairs is met in as many tasks as it needs."""
    many = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > SLICE).select(F.col(side).alias("node"), F.ceil(F.col("k") / SLICE).cast("int").alias("slices"))
    own = sets.select("node", *(F.col(c).alias(name) for c, name in columns.items())).join(many, "node", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = own.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    told = pairs.join(many.withColumnRenamed("node", side), side, "left").withColumn("slice", F.pmod(F.xxhash64("a", "b"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    return told.join(own.withColumnRenamed("node", side), [side, "slice"]).drop("slice")


def _verified(pairs: DataFrame, reps: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs of nodes (a, b) that link."""
    sketched = _read(reps, _nodes(pairs), width, False, scratch)
    near = _beside(_beside(pairs, sketched, "a", {"n": "n_a", "sketch": "sketch_a"}), sketched, "b", {"n": "n_b", "sketch": "sketch_b"})
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    # A link has a difference of at most (100 - percent) / (100 + percent) of both sizes.
    near = scratch.keep(near.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "near")
    sets = _read(reps, _nodes(near), width, True, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    full = _beside(_beside(near, sets, "a", {"set": "set_a"}), sets, "b", {"set": "set_b"}).select("a", "b", "set_a", "set_b")
    return scratch.keep(map_batches(full, run, "a long, b long"), "links")


def linked(sets: list[np.ndarray], percent: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of sets that link. With split, only those of a set before split and one from it on."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    flat, counts = np.unique(np.concatenate(sets), return_inverse=True)[1], None
    counts = np.bincount(flat)
    common = counts[flat] > 1
    column = (np.cumsum(counts > 1) - 1)[flat[common]]
    owner = owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    found_a, found_b = [], []
    top, bottom = (range(0, m, ROWS), lambda r: range(r, m, ROWS)) if split is None else (range(0, split, ROWS), lambda r: range(split, m, ROWS))
    for r in top:
        r_end = min(r + ROWS, m if split is None else split)
        for q in bottom(r):
            q_end = min(q + ROWS, m)
            both = np.zeros((r_end - r, q_end - q), np.float32)
            for c in range(0, n_columns, COLUMNS):
                a, b = np.searchsorted(column, [c, c + COLUMNS])
                col, own = column[a:b] - c, owner[a:b]
                width = min(COLUMNS, n_columns - c)
                x = _block(own, col, r, r_end, width)
                both += x @ (x if q == r and split is None else _block(own, col, q, q_end, width)).T
            union = size[r:r_end, None] + size[None, q:q_end] - both
            i, j = np.nonzero((100 * both >= percent * union) & (union > 0))
            keep = i + r < j + q
            found_a.append(i[keep] + r)
            found_b.append(j[keep] + q)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _block(owner, column, first, last, width):
    x = np.zeros((last - first, width), np.float32)
    own = (owner >= first) & (owner < last)
    x[owner[own] - first, column[own]] = 1
    return x


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node to the least of its component."""
    if not len(a):
        return a, a
    own, label = labels_of(nodes[a], nodes[b])
    return own[own != label], label[own != label]


def _blocks(reps: DataFrame, families: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all linked members of each family (node, family, n); a node may be of several families."""
    weights = families.groupBy("family").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # A family of some weight is dealt out to several tasks, too.
    chunks = F.greatest(F.ceil(F.col("weight") / CHUNK), F.least(F.lit(4), F.ceil(F.col("weight") * 10 / CHUNK))).cast("int")
    placed = _with_class(families.select("node", "family"), weights, ["family"], scratch)
    placed = scratch.keep(placed.select(F.col("node").alias("doc_id"), "family", chunks.alias("chunks"), "weight"), "families")
    n = placed.count()
    per_family = placed.select("family", "weight").distinct().agg(F.sum("weight")).first()[0] or 0
    # A member's families are one row.
    mine = placed.groupBy("doc_id").agg(F.collect_list(F.struct("family", "chunks")).alias("families"))

    def run(batches):
        for part, sets in _each(batches, width):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("families"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "families", "set"])
        give_back()

    rows = map_batches(reps.join(_some(mine, n), "doc_id"), run, "node long, families array<struct<family: long, chunks: int>>, set binary")
    # Small families share bins; of a large one each pair of chunks has a bin of its own.
    rows = rows.select("node", "set", F.explode("families").alias("f")).select("node", "set", "f.family", "f.chunks")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    rows = rows.withColumn("chunk", chunk).withColumn("at", F.explode(others))
    bins = max(1, 2 * int(per_family // CHUNK), 2 * shuffle_partitions(reps.sparkSession))
    bin_ = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.xxhash64("family", "at.i", "at.j"))
    rows = rows.select("node", "family", "chunk", "set", F.col("at.i").alias("i"), F.col("at.j").alias("j"), bin_.alias("bin"))

    def check(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for (_, i, j), own in pdf.groupby(["family", "i", "j"], sort=False):
            own = own.drop_duplicates("node").sort_values("chunk", kind="stable")
            if len(own) > 1:
                sets = [np.frombuffer(s, np.uint64) for s in own["set"]]
                split = None if i == j else int((own["chunk"] == i).sum())
                a, b = _forest(own["node"].to_numpy(), *linked(sets, percent, split))
                out_a.append(a)
                out_b.append(b)
        give_back()
        return pd.DataFrame({"a": _flat(out_a, np.int64), "b": _flat(out_b, np.int64)})

    return scratch.keep(rows.groupBy("bin").applyInPandas(check, "a long, b long"), "block-links")


def _stars(cells: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each group with the hub of each of its cells, and of each further member with its representative."""
    met = cells.where((F.col("gid") != F.col("hub.gid")) & _may(F.col, lambda name: F.col(f"hub.{name}"), percent))
    return met.select(F.col("gid").alias("a"), F.col("hub.gid").alias("b")).unionByName(members.select(F.col("node").alias("a"), F.col("gid").alias("b"))).distinct()


def _rest(cells: DataFrame, members: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What the components so far (labels: node, label) leave: pairs (a, b) of members of different ones whose groups pass the
    filters in a small cell, and families (node, family, n) of members that meet in hot cells.

    Hot cells of a band that have a group in common make one family, so that their groups meet once. Members of a group
    that aren't of one component are a family, too.
    """
    # All members of each group, with their components.
    every = members.select("gid", "node").unionByName(cells.select("gid", F.col("gid").alias("node")).distinct())
    every = every.join(labels, "node", "left").select("gid", "node", F.coalesce("label", "node").alias("label"))
    every = scratch.keep(every, "every")
    spread = every.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"))
    spread = scratch.keep(spread, "spread")
    placed = cells.drop("hub").join(_some(spread, spread.count()), "gid")
    alive = placed.groupBy("token", "cell").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.sum("rows").alias("k"), F.min("gid").alias("hub")).where("least <> most")
    placed = scratch.keep(placed.join(alive.select("token", "cell", "k", "hub"), ["token", "cell"]), "cells")
    x, y = (placed.where(F.col("k") <= CELL).alias(t) for t in "xy")
    c = lambda t, name: F.col(f"{t}.{name}")
    apart = (c("x", "low") != c("x", "high")) | (c("y", "low") != c("y", "high")) | (c("x", "low") != c("y", "low"))
    met = x.join(y, ["token", "cell"]).where((c("x", "gid") < c("y", "gid")) & (c("x", "base") | c("y", "base")) & apart & _may(lambda n: c("x", n), lambda n: c("y", n), percent))
    met = met.select(c("x", "gid").alias("g"), c("y", "gid").alias("h")).distinct()
    side = lambda g, node, label: every.select(F.col("gid").alias(g), F.col("node").alias(node), F.col("label").alias(label))
    pairs = met.join(side("g", "a", "label_a"), "g").join(side("h", "b", "label_b"), "h").where("label_a <> label_b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at = lambda gid: F.xxhash64(gid, "cell")
    hot = scratch.keep(placed.where(F.col("k") > CELL).select("gid", "n", at("gid").alias("a"), at("hub").alias("b")).distinct(), "hot")
    ties = components(hot.select("a", "b"), scratch)
    met = hot.select("gid", "n", "a").distinct().join(ties.withColumnRenamed("node", "a"), "a", "left").select("gid", "n", F.coalesce("label", "a").alias("family"))
    inner = cells.select("gid", "n").distinct().join(spread.where("low <> high").select("gid"), "gid").select("gid", "n", F.xxhash64(F.lit(1), "gid").alias("family"))
    families = met.distinct().unionByName(inner).join(every.select("gid", "node"), "gid").select("node", "family", "n")
    return pairs, scratch.keep(families, "met")


def _linked(reps: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """node and label (the least node of its component) of the nodes that links lead to a lesser one."""
    known = reps.sparkSession.sparkContext.broadcast(_known(reps, width, percent, scratch))
    prefixes = scratch.keep(_prefixes(reps, width, percent, known), "prefixes")
    members, groups = _groups(prefixes, percent, scratch)
    cells = scratch.keep(_cells(groups, percent), "cells")
    stars = scratch.keep(_stars(cells, members, percent), "stars")
    links = _verified(stars, reps, width, percent, scratch)
    labels = scratch.keep(components(links, scratch), "labels")
    rest, families = _rest(cells, members, labels, percent, scratch)
    rest = scratch.keep(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    more = []
    if not rest.isEmpty():
        more.append(_verified(rest, reps, width, percent, scratch))
    if not families.isEmpty():
        more.append(_blocks(reps, families, width, percent, scratch))
    for m in more:
        links = links.unionByName(m)
    return components(links, scratch) if more else labels


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id that links lead to, itself included)."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<string>").alias("more"))
    members = scratch.keep(_members(own, width), "members")
    own, several = _united(own, members, scratch)
    if several is not None:
        members = scratch.keep(_members(own, width), "members")
    sig = ["sig_a", "sig_b"]
    classes = members.where("doc_id is not null and n > 0").groupBy(*sig).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"))
    classes = scratch.keep(classes, "classes")
    ids = classes.select(F.col("node").alias("doc_id"))
    n = classes.count()
    reps = own.join(_some(ids, n), "doc_id", "left_semi")
    if not classes.where("rows > 1").isEmpty():
        # Of equal rows of one document one is read on.
        twice = classes.where("rows > 1").select("node").join(members.groupBy(F.col("doc_id").alias("node")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "node")
        twice = scratch.keep(twice.select(F.col("node").alias("doc_id")), "twice")
        if k := twice.count():
            some = _some(twice, k)
            reps = reps.join(some, "doc_id", "left_anti").unionByName(reps.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    steps = Scratch(docs.sparkSession, "links")
    labels = scratch.keep(_linked(reps, width, percent, steps), "components")
    steps.drop()
    placed = scratch.keep(classes.join(labels, "node", "left").select(*sig, "rows", F.coalesce("label", "node").alias("component")), "placed")
    named = members.where("doc_id is not null and n > 0")
    out = _with_class(named, placed, sig, scratch).select("doc_id", "n", "component")
    out = out.unionByName(members.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    if several is not None:
        out = out.join(several, "doc_id", "left").withColumn("rows", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the least doc_id of their component, with all their columns; a row without id stays.

    Of rows that share that doc_id one stays.
    """
    scratch = Scratch(docs.sparkSession, "first")
    found = join(docs, width, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("component"))
    told = scratch.keep(found.where("doc_id <> component or rows > 1"), "told")
    n = told.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("doc_id") == F.col("component"), 1)).alias("several")).first()
    id_ = unused("__evidra_mine", docs.columns)
    mine = docs.withColumn(id_, F.col("doc_id").cast("long"))
    some = lambda df: F.broadcast(df) if n["n"] <= BROADCAST else df
    ids = lambda df: some(df.select(F.col("doc_id").alias(id_)))
    stay = mine.join(ids(told), id_, "left_anti").select(*docs.columns)
    if not n["several"]:
        return stay
    once = mine.join(ids(told.where("doc_id = component")), id_, "left_semi").dropDuplicates([id_])
    return stay.unionByName(once.select(*docs.columns))


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s FROM words, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, chr(10)) FROM words WHERE len(w) BETWEEN 1 AND 2
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), near AS (
  SELECT x, y FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, near.y FROM reach JOIN near ON near.x = reach.other
)
SELECT r.doc_id, coalesce(max(z.n), 0)::BIGINT AS n_shingles, min(r.other)::BIGINT AS component_id
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""
