"""Exact n-gram Jaccard self-join of whole texts, and the groups that its links make.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets A, B
of distinct n-word shingles.  Sets are held as sorted 64-bit hashes.

Equal sets are one class, so copies cost one row, and everything below is told
apart by class, never by id.  Of a class's shingles, put into one global order,
a prefix of ``n - ceil(t n) + 1`` must meet the prefix of every class that it
links with.  The order puts the shingles that many texts share last, so common
passages are not what classes meet by; any order is right, so an incomplete list
of common shingles costs time only, never a link.

Classes that share a prefix shingle form a block.  If it is the first that two
of them share, its places in their orders bound what they can have in common;
so a block asks for those pairs only that sizes and places let link.  Where these
are fewer than its classes, they are named; a denser block goes through tiles.

Two steps find which classes may link at all, both by the bound that hashed
bitmaps put on the overlap, from above: first the named pairs and, of dense
blocks, every class against the first one of its size band and of the band
below; then, in dense blocks that still hold several clusters, all classes of a
tile (a band and the band below it).  A tile's cell passes on only what joins
clusters, at most one row less than it has classes.  So classes of different
clusters can't link, and each class is in one cluster.

The texts of a cluster then go, once each, to the tiles of their cluster, where
the bitmaps' bound is followed by exact intersection of sorted arrays.  Again a
cell keeps its own union-find and passes on only the links that join groups;
pairs already in one group are not tried, as they can't change it.

Nothing of a block, tile or cluster is gathered in one task: blocks are streamed
in sorted order, those of very common shingles in parts, and a large tile is
dealt to a grid of cells of bounded size.

Defined cases: null and empty texts have the empty set and link with nothing;
texts of fewer words have their whole sequence as one shingle; repeated rows are
copies of each other; a null id never names a group that has another id, but its
text links like any other; the result's columns are fixed, whatever other
columns the documents have; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import textkit as tk
from lattica.llm.components import components
from lattica.llm.shared import Scratch, local_table, map_batches

#: Words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: 64-bit words of a bitmap signature, at least; they double until there are four bits a shingle.
SIGNATURE = 4
#: A shingle is reported as common from so many classes within one stretch of a task on.
COMMON_FROM, STRETCH = 2, 1 << 21
#: Common shingles in the broadcast order; those beyond it are ordered by hash like all others.
COMMON_MOST = 1 << 18
#: Classes of a block's part; blocks of shingles that are known to be more common are streamed in several parts.
PART = 1 << 16
#: Rows and shingles of a tile's part; larger tiles are dealt to cells of two parts each.
CELL, CELL_SHINGLES = 1024, 1 << 20
#: A shingle's place in its set's order, and above it the set's size, in one number.
PLACE_BITS = 31
#: Cells of so many rows at most are compared side by side.
FEW = 32
#: Rows that are broadcast when documents are left out; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Bits of the filter over the rows whose texts are needed, by their number; at least and at most.
FILTER_BITS = (1 << 23, 1 << 26)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def class_id(shingles: np.ndarray) -> int:
    """One 64-bit number for a set."""
    with np.errstate(over="ignore"):
        x = tk.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * np.uint64(0x9E3779B97F4A7C15)
        return int(tk.mix(np.array([x], np.uint64)).view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """A hashed bitmap; one of twice the length folds to one of the length by OR of its halves."""
    size = SIGNATURE
    while 16 * size < len(shingles):
        size *= 2
    bits = np.zeros(64 * size, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(64 * size)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def band(n: np.ndarray | float, percent: int = PERCENT):
    """Sizes that can link differ by one band at most."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(100 / percent) + 1e-9).astype(np.int64)


def _band(n: str, percent: int) -> Column:
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9))


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def _common(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several classes of this task have, with how many."""
    seen, held, size = set(), [], 0

    def counted() -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= COMMON_FROM
        return pa.RecordBatch.from_pydict({"shingle": pa.array(tk.int64(s[keep])), "n": pa.array(n[keep])})

    for rb in batches:
        for part in tk.rounds(rb.column("text")):
            for s in tk.shingle_sets(part, words):
                if len(s) and (c := class_id(s)) not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size >= STRETCH:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _ordered(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles in the global order: first those not in ``common``, by hash, then by how common they are."""
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    hit = common[at] == s
    return np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]], kind="stable")]]) if hit.any() else s


def _address() -> Column:
    """A row's own number, by which its text is found again: rows have it in common only by chance or as repeated rows."""
    return F.xxhash64("id", "text")


def classes(docs: DataFrame, known, words: int, percent: int) -> DataFrame:
    """Per row: id, address, set size, class, and the class's prefix and bitmap where this task meets the class first.

    ``known`` is a broadcast of the common shingles in order of their hash, and of each one's count.
    """
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("address", "n", "class")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "sig"))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = set(), np.zeros(0, np.uint64)
        shingles, rank = known.value
        for rb in batches:
            n, cls, keys, sigs = [], [], [], []
            for part in tk.rounds(rb.column("text")):
                for s in tk.shingle_sets(part, words):
                    n.append(len(s))
                    cls.append(class_id(s))
                    fresh = len(s) and cls[-1] not in seen
                    seen.add(cls[-1])
                    keys.append(_ordered(s, shingles, rank)[: prefix_length(len(s), percent)] if fresh else none)
                    sigs.append(signature(s) if fresh else none)
            yield pa.RecordBatch.from_pydict({"id": rb.column("id"), "address": rb.column("address"), "n": pa.array(n, pa.int64()), "class": pa.array(cls, pa.int64()), "keys": _long_lists(keys), "sig": _long_lists(sigs)})

    return map_batches(docs.select("id", _address().alias("address"), "text"), made, schema)


BLOCK = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "class", "n", "reach", "hub", "low", "split")])


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of blocks that may hold links, from rows sorted by key, part, place and class.

    A block of few pairs that can link has a row for each, whose ``hub`` and
    ``class`` they are, with ``split`` -1.  A denser one has its classes that can
    link, each with the hub of its band (``hub``, the band's first class) and that
    of the band below (``low``), or itself where the two can't link.  ``split`` is 1
    where not all classes of the key have met these hubs, as they are in another
    part; then all its classes stay.  ``reach`` is how many of its shingles a class
    has from the key on.
    """
    carry, large = None, set()

    def closed(key: np.ndarray, part: np.ndarray, place: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        n, at = place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (cls[1:] != cls[:-1])
        key, part, n, reach, cls = (x[fresh] for x in (key, part, n, n - at, cls))
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(edge, len(key)))
        split = (part > 0) | np.isin(key, list(large))
        stay, pairs = np.repeat(size > FEW, size) | split, []
        for m in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
            first = edge[(size == m) & ~split[edge]]
            one, two = np.triu_indices(m, 1)
            a, b = first[:, None] + one, first[:, None] + two
            ok = _enough(np.minimum(reach[a], reach[b]), n[a] + n[b], percent)
            few = ok.sum(1) < m
            pairs.append((a[few][ok[few]], b[few][ok[few]]))
            stay[a[~few][ok[~few]]] = stay[b[~few][ok[~few]]] = True
        a, b = (np.concatenate([*(x[i] for x in pairs), np.zeros(0, np.int64)]) for i in (0, 1))
        none = np.zeros(len(a), np.int64)
        named = {"key": key[a], "class": cls[b], "n": none, "reach": none, "hub": cls[a], "low": cls[a], "split": none - 1}
        key, part, n, reach, cls, split = (x[stay] for x in (key, part, n, reach, cls, split))
        if not len(key):
            return pa.RecordBatch.from_pydict({c: pa.array(named[c], pa.int64()) for c in BLOCK.names})
        tier = band(n, percent)
        new_key = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        new_band = new_key.copy()
        new_band[1:] |= tier[1:] != tier[:-1]
        first, which = np.flatnonzero(new_band), np.cumsum(new_band) - 1
        below = first[np.maximum(which - 1, 0)]
        near, hub, own = ~new_key[first][which] & (tier[below] == tier - 1), first[which], np.arange(len(key))
        meets = lambda h: _enough(np.minimum(reach[h], reach), n[h] + n, percent)
        hub, low = np.where(meets(hub), hub, own), np.where(near & meets(below), below, own)
        dense = {"key": key, "class": cls, "n": n, "reach": reach, "hub": cls[hub], "low": cls[low], "split": split.astype(np.int64)}
        return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate([named[c], dense[c]]), pa.int64()) for c in BLOCK.names})

    for rb in batches:
        cols = [rb.column(c).to_numpy() for c in ("key", "part", "place", "class")]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        # a block that goes on in the next batch waits, but not when it outgrows a part: then what came so far is closed
        # with its own hubs, and its last row stays with what follows, so that the two stay tied
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if cut == 0 and len(cols[0]) > PART:
            large.add(int(cols[0][0]))
            yield closed(*cols)
            carry = [x[-1:] for x in cols]
        else:
            carry = [x[cut:] for x in cols]
            if cut:
                yield closed(*[x[:cut] for x in cols])
    if carry is not None and len(carry[0]):
        yield closed(*carry)


def texts_of(docs: DataFrame, needed: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(address, text) of the documents whose addresses are needed, and the broadcast that this reads.

    The filter over the needed addresses is a bit table of fixed size; a row that
    it lets pass by chance only makes a text that the later join drops.
    """
    spark = docs.sparkSession
    bits = FILTER_BITS[0]
    n = needed.count()
    while bits < min(FILTER_BITS[1], 8 * n):
        bits *= 2
    at = F.pmod("address", F.lit(bits))
    table = np.zeros(bits // 64, np.int64)
    for word, value in needed.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))"))).collect():
        table[word] = value
    passing = spark.sparkContext.broadcast(table)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            where = rb.column("address").to_numpy() % bits
            yield rb.filter(pa.array((passing.value[where >> 6] >> (where & 63)) & 1 == 1))

    found = map_batches(docs.select(_address().alias("address"), "text"), passed, T.StructType([T.StructField("address", T.LongType()), docs.schema["text"]]))
    return found, passing


def _enough(overlap, sizes, percent: int):
    return overlap * 100 >= (sizes - overlap) * percent


def bounded(pairs: DataFrame, classes_: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that sizes and bitmaps let link.  ``classes_`` has each class's n and sig."""
    pairs = pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sigs = classes_.select("class", "n", "sig")
    one, two = sigs.toDF("a", "na", "sa"), sigs.toDF("b", "nb", "sb")
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0).cast("int"), lambda s, v: s + v)
    # sizes that can link differ by less than twice, and so do their bitmaps' lengths
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseOR(q))).otherwise(F.col(x))
    bound = F.least(F.col("na") - alone(fold("sa", "sb"), fold("sb", "sa")), F.col("nb") - alone(fold("sb", "sa"), fold("sa", "sb")))
    near = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return near.filter(_enough(bound, F.col("na") + F.col("nb"), percent)).select("a", "b")


def _dealt(rows: DataFrame, scratch: Scratch, by: str, percent: int, several: Column) -> DataFrame:
    """``rows`` (with ``by``, class, n and component) as cells' rows: tile, row, col, whether ``home``, and their part.

    A class is at home in the tile of its band and visits the tile above.  Every
    two parts of a tile meet in the cell of (smaller, larger).  ``several`` says
    from a tile's aggregates whether there is anything to compare: ``lo`` and
    ``hi`` of the components, ``m`` rows, ``homes`` among them, the greatest ``split``.
    """
    tiles = rows.withColumn("tile", _band("n", percent)).withColumn("home", F.lit(True))
    tiles = tiles.union(tiles.withColumns({"tile": F.col("tile") + 1, "home": F.lit(False)}))
    load = tiles.groupBy(by, "tile").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.count_if("home").alias("homes"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("split").alias("split"))
    load = load.filter((F.col("homes") > 0) & several).select(by, "tile", F.ceil(F.greatest(F.col("m") / CELL, F.col("shingles") / CELL_SHINGLES)).cast("int").alias("grid"))
    load = scratch.put(load, "load")  # as a table, so that Spark can split the join where one tile is very large
    dealt = tiles.join(load, [by, "tile"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("grid")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    return dealt.withColumns({"row": F.least("part", "other"), "col": F.greatest("part", "other")}).drop("grid", "other")


def _joining(cls: np.ndarray, n: np.ndarray, reach: np.ndarray, sig: np.ndarray, group: np.ndarray, home: np.ndarray, part: np.ndarray, whole: bool, percent: int, exact: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell's rows that join its groups, at most one less than there are groups.

    A pair counts if its ``reach`` (most that each can have in common with another) and the bitmaps' bound let it, and ``exact(i, candidates)``,
    where given, says so.  The row whose bits most others share comes first, so
    copies of one text mostly join at once.
    """
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    shared = (bits @ bits.sum(0, dtype=np.float32)) / np.maximum(bits.sum(1), 1)
    open_, group = np.ones(len(n), bool), np.unique(group, return_inverse=True)[1]
    a, b = [], []
    for i in np.argsort(-shared, kind="stable"):
        if not home[i]:
            continue
        open_[i] = False
        cand = np.flatnonzero((group != group[i]) & (open_ | ~home) & _enough(np.minimum(reach, reach[i]), n + n[i], percent) & (whole | (part != part[i])))
        if len(cand):
            left, right = np.bitwise_count(sig[i] & ~sig[cand]).sum(1, dtype=np.int64), np.bitwise_count(sig[cand] & ~sig[i]).sum(1, dtype=np.int64)
            cand = cand[_enough(np.minimum(n[i] - left, n[cand] - right), n[i] + n[cand], percent)]
        if len(cand) and exact is not None:
            cand = cand[exact(i, cand)]
        if len(cand):
            new, first = np.unique(group[cand], return_index=True)
            a += [cls[i]] * len(first)
            b += cls[cand[first]].tolist()
            group[np.isin(group, new)] = group[i]
            if (group == group[0]).all():
                break
    if a:
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


CELL_KEY = ("tile", "row", "col")


def _cell_edges(rb: pa.RecordBatch, by: str) -> Iterator[tuple[tuple, int, int]]:
    """The stretches of a sorted batch that belong to one cell."""
    if rb.num_rows:
        ids = [rb.column(c).to_numpy() for c in (by, *CELL_KEY)]
        edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), rb.num_rows]):
            yield tuple(int(x[a]) for x in ids), a, b


def _folded(sig: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of some rows as a matrix, longer ones folded to ``width`` words."""
    flat, ends = sig.values.to_numpy().view(np.uint64), sig.offsets.to_numpy()
    out, size = np.zeros((len(rows), width), np.uint64), ends[rows + 1] - ends[rows]
    for times in np.unique(size // width).tolist():
        at = np.flatnonzero(size == times * width)
        out[at] = np.bitwise_or.reduce(flat[ends[rows[at]][:, None] + np.arange(times * width)].reshape(len(at), times, width), 1)
    return out


def _joining_small(rb: pa.RecordBatch, cells: list[tuple[int, int]], percent: int) -> Iterator[pa.RecordBatch]:
    """As ``_joining`` by bitmaps alone, for many whole cells of one part and few rows each, all pairs side by side."""
    sig, (cls, n, reach, group) = rb.column("sig"), (rb.column(c).to_numpy() for c in ("class", "n", "reach", "component"))
    home = rb.column("home").to_numpy(zero_copy_only=False)
    start, end = (np.array(x) for x in zip(*cells))
    widths = np.diff(sig.offsets.to_numpy())
    least = np.minimum.reduceat(np.append(widths, np.iinfo(widths.dtype).max), np.stack([start, end], 1).ravel())[::2]
    for width in np.unique(least).tolist():
        a, b = [], []
        for m in np.unique((end - start)[least == width]).tolist():
            at = start[(least == width) & (end - start == m)]
            one, two = np.triu_indices(m, 1)
            a.append((at[:, None] + one).ravel())
            b.append((at[:, None] + two).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        keep = (group[a] != group[b]) & (home[a] | home[b]) & _enough(np.minimum(reach[a], reach[b]), n[a] + n[b], percent)
        a, b = a[keep], b[keep]
        rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        bits = _folded(sig, rows, width)
        x, y = where[: len(a)], where[len(a) :]
        left, right = np.bitwise_count(bits[x] & ~bits[y]).sum(1, dtype=np.int64), np.bitwise_count(bits[y] & ~bits[x]).sum(1, dtype=np.int64)
        keep = _enough(np.minimum(n[a] - left, n[b] - right), n[a] + n[b], percent)
        # a forest of each cell: its clusters, told apart by cell
        leader: dict[tuple[int, int], tuple[int, int]] = {}
        found_a, found_b = [], []
        cell = np.searchsorted(start, a[keep], side="right")
        for i, j, c in zip(a[keep].tolist(), b[keep].tolist(), cell.tolist()):
            p, q = (c, int(group[i])), (c, int(group[j]))
            while p in leader:
                p = leader[p]
            while q in leader:
                q = leader[q]
            if p != q:
                leader[p] = q
                found_a.append(int(cls[i]))
                found_b.append(int(cls[j]))
        if found_a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def possible(rows: DataFrame, sigs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) that join different clusters within a block and that bitmaps let link.  Rows: key, class, n, component."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None

        def closed() -> Iterator[pa.RecordBatch]:
            cls, n, reach, group, home, part, sig = (np.concatenate(x) for x in zip(*held))
            width = min(map(len, sig))
            sig = np.stack([np.bitwise_or.reduce(x.view(np.uint64).reshape(-1, width), 0) for x in sig])
            yield from _joining(cls, n, reach, sig, group, home, part, cell[2] == cell[3], percent)

        for rb in batches:
            lists, few = rb.column("sig"), []
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            cols = [*(rb.column(c).to_numpy() for c in ("class", "n", "reach", "component")), rb.column("home").to_numpy(zero_copy_only=False), rb.column("part").to_numpy()]
            for now, a, b in _cell_edges(rb, "key"):
                if cell is not None and now != cell:
                    yield from closed()
                    held, cell = [], None
                if cell is None and b < rb.num_rows and b - a <= FEW and now[2] == now[3]:
                    few.append((a, b))
                    continue
                cell = now
                sig = np.empty(b - a, object)
                sig[:] = [flat[x:y] for x, y in zip(ends[a:b], ends[a + 1 : b + 1])]
                held.append([*(x[a:b] for x in cols), sig])
            if few:
                yield from _joining_small(rb, few, percent)
        if held:
            yield from closed()

    # two at home and one visitor have all met: the band's hub and that of the band below were held against all
    dealt = _dealt(rows, scratch, "key", percent, (F.col("lo") < F.col("hi")) & ((F.col("split") > 0) | (F.col("homes") > 2) | (F.col("m") - F.col("homes") > 1)))
    sent = dealt.join(sigs, "class").select("key", *CELL_KEY, "class", "n", "reach", "component", "home", "part", "sig")
    return map_batches(sent.repartition("key", *CELL_KEY).sortWithinPartitions("key", *CELL_KEY), paired, "a long, b long")


def linked(clusters: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """The links (a, b) that join classes of a cluster into groups.  Clusters: component, class, n, address."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None

        def closed() -> Iterator[pa.RecordBatch]:
            cls, home, part, sets = (list(x) for x in zip(*held))
            sigs = [signature(s) for s in sets]
            width = min(map(len, sigs))
            sig = np.stack([np.bitwise_or.reduce(x.reshape(-1, width), 0) for x in sigs])

            def exact(i: int, cand: np.ndarray) -> np.ndarray:
                own, theirs = sets[i], [sets[j] for j in cand]
                size = np.array([len(s) for s in theirs])
                every = np.concatenate(theirs)
                same = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                return _enough(np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64), len(own) + size, percent)

            n = np.array([len(s) for s in sets])
            yield from _joining(np.array(cls), n, n, sig, np.arange(len(cls)), np.array(home), np.array(part), cell[2] == cell[3], percent, exact)

        for rb in batches:
            cls, part = rb.column("class").to_numpy(), rb.column("part").to_numpy()
            home, at = rb.column("home").to_numpy(zero_copy_only=False), np.zeros(rb.num_rows, np.int64)
            cells = []
            for k, (now, a, b) in enumerate(_cell_edges(rb, "component")):
                cells.append(now)
                at[a:b] = k
            for texts in tk.rounds(rb.column("text")):
                for i, s in enumerate(tk.shingle_sets(texts, words), texts.rows.start):
                    if cells[at[i]] != cell:
                        if held:
                            yield from closed()
                        held, cell = [], cells[at[i]]
                    # not the text of another row with this address, nor a repeated row
                    if len(s) and class_id(s) == cls[i] and not (held and held[-1][0] == cls[i]):
                        held.append((cls[i], home[i], part[i], s))
        if held:
            yield from closed()

    dealt = _dealt(clusters.withColumn("split", F.lit(0)), scratch, "component", percent, F.col("m") > 1)
    texts, passing = texts_of(docs, clusters.select("address"))
    rows = dealt.join(texts, "address").select("component", *CELL_KEY, "class", "home", "part", "text")
    links = scratch.put(map_batches(rows.repartition("component", *CELL_KEY).sortWithinPartitions("component", *CELL_KEY, "class"), matched, "a long, b long"), "links")
    passing.destroy()
    return links


def grouped(own: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Of rows (id, text): id, address, n, class, and component, the number of its group (null for the empty set), as a table."""
    counted = map_batches(own.select("text"), lambda it: _common(it, words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).toArrow()
    common, times = top.column("shingle").to_numpy(), top.column("n").to_numpy()
    by_hash = np.argsort(common.view(np.uint64))
    known = own.sparkSession.sparkContext.broadcast((common[by_hash].view(np.uint64), times[by_hash]))
    members = scratch.put(classes(own, known, words, percent), "members")
    known.destroy()

    keys = members.filter(F.size("keys") > 0).select(F.posexplode("keys").alias("at", "key"), "n", "class")
    hot = [(int(common[i]), -(-int(times[i]) // PART)) for i in np.flatnonzero(times > PART)]
    part = F.lit(0).cast("long")
    if hot:  # at most COMMON_MOST rows
        keys = keys.join(F.broadcast(local_table(own.sparkSession, hot, "key long, parts long")), "key", "left")
        part = F.coalesce(F.pmod("class", "parts") + 1, part)
    place = F.shiftleft("n", PLACE_BITS) + F.col("at")  # in one number, as these rows are most of what is shuffled
    keys = keys.select("key", part.alias("part"), place.alias("place"), "class")
    blocks = scratch.put(map_batches(keys.repartition("key", "part").sortWithinPartitions("key", "part", "place", "class"), lambda it: _blocks(it, percent), BLOCK), "blocks")

    # what pairs ask of a class, for those in some block; copies in other tasks have the same bitmap
    met = blocks.select(F.explode(F.array("class", "hub")).alias("class")).distinct()
    rep = members.filter(F.size("sig") > 0).groupBy("class").agg(F.first("n").alias("n"), F.min(F.struct("address", "sig")).alias("m")).select("class", "n", "m.address", "m.sig")
    rep = scratch.put(rep.join(met, "class", "left_semi"), "rep")
    members = scratch.put(members.select("id", "address", "n", "class"), "members")  # without prefixes and bitmaps
    stars = blocks.select(F.col("hub").alias("a"), F.col("class").alias("b")).union(blocks.select(F.col("low").alias("a"), F.col("class").alias("b")))
    edges = scratch.put(bounded(stars, rep, percent), "edges-of-stars")
    found = components(edges, scratch, "clusters-of-stars")

    rows = blocks.filter("split >= 0").join(found, F.col("class") == F.col("node"), "left").select("key", "class", "n", "reach", "split", F.coalesce("component", "class").alias("component"))
    rows = scratch.put(rows, "rows")
    several = scratch.put(rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "several")
    mixed = scratch.put(rows.join(several, "key", "left_semi"), "mixed")
    scratch.drop("rows", "several", "blocks")
    edges = scratch.put(edges.union(possible(mixed, rep.select("class", "sig"), scratch, percent)), "edges")
    scratch.drop("edges-of-stars", "clusters-of-stars", "mixed", "load")
    found = components(edges, scratch, "clusters")

    clusters = scratch.put(found.join(rep.select(F.col("class").alias("node"), "n", "address"), "node").select("component", F.col("node").alias("class"), "n", "address"), "members-of-clusters")
    links = linked(clusters, own, scratch, words, percent)
    scratch.drop("edges", "clusters", "members-of-clusters", "rep", "load")
    found = components(links, scratch, "groups")
    scratch.drop("links")
    one = members.select("id", "address", "n", "class").join(found, F.col("class") == F.col("node"), "left")
    one = scratch.put(one.select("id", "address", "n", "class", F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("component")), "grouped")
    scratch.drop("members", "groups")
    return one


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id that links reach (null if none has an id)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = grouped(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), scratch, words, percent)
    least = scratch.put(found.filter("n > 0").groupBy("component").agg(F.min("id").alias("component_id")), "names")
    return found.join(least, "component", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents less the copies and near copies: of each group stays one row, that of the smallest id.

    Rows without words stay as they are.  Among rows of one id, that of the
    smallest hash of its text stays, and one row of equal ones; a null id comes
    after all others.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    sided = docs.select(F.struct(*own).alias("own"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = grouped(sided.select("id", "text"), scratch, words, percent).filter("n > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "address")).alias("m")).select("component", F.col("m.address").alias("first"))
    gone = scratch.put(found.join(first, "component").filter(F.col("address") != F.col("first")).select("address").distinct(), "gone")
    again = scratch.put(found.groupBy("address").count().filter("count > 1").select("address"), "again")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    kept = sided.withColumn("address", _address()).join(small(gone), "address", "left_anti")
    if not again.isEmpty():
        once = kept.join(small(again), "address", "left_semi").dropDuplicates(["address"])
        kept = kept.join(small(again), "address", "left_anti").unionByName(once)
    return kept.select(*[F.col("own")[c].alias(c) for c in docs.columns])
