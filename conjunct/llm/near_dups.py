"""Exact Jaccard self-join of documents' word n-gram sets, by size-banded tiles with hashed bitmap signatures.

Sets are hash arrays. Bands of set sizes grow by a factor; a set is in the tile of its own band and in that of the band
above if a set there could still be similar. All pairs of a tile that reach the threshold differ in at most D shingles,
so of the tile's D + 1 + s equal ranges of hash values at least s + 1 hold the same shingles in both: a tile splits into
cells by (range, hash of the range's shingles), and every similar pair meets in a cell that isn't empty, or else both
have more than s empty ranges and meet in an empty one. No similar pair is lost, and a passage that many documents
share makes no large cell unless it fills whole ranges.

Pairs of small cells go to the check one by one. Sets of cells with more than CELL sets form families (components of
what shares such a cell), and a family is checked in blocks against blocks, emitting no pairs but a spanning forest and
counts. The check is twofold: bit counts of the folded bitmaps bound the overlap from above, and only pairs within the
bound have their sorted arrays intersected.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conjunct.llm.components import components
from conjunct.llm.exact_dedup import maybe_repeated, slot_filter, slots_for
from conjunct.llm.shared import forget, materialize, utf8, whole_text_batches
from conjunct.llm.shingles import mix, shingle_set
from conjunct.llm.units import claim

#: Sets of a cell whose pairs are listed one by one; sets of a family's least block; shingles of its largest one.
CELL, BLOCK, LARGEST = 8, 96, 4_000_000
#: A set of a family is copied to at most so many blocks, while blocks of that size stay within LARGEST.
COPIES = 64
#: Clashing names that are renamed in one round.
CLASHES = 1000
#: Set identities that a task remembers, so that copies in it send their cells once.
SEEN = 300_000

_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(max(_BANDS[-1] + 1, int(_BANDS[-1] * 1.25)))


def tiles(n: int, percent: int) -> list[int]:
    """Bands in whose tile a set of n shingles is."""
    top = bisect_right(_BANDS, n) - 1
    out = [top]
    while 100 * n >= percent * _BANDS[out[-1] + 1]:
        out.append(out[-1] + 1)
    return out


def ranges(band: int, percent: int) -> tuple[int, int]:
    """(number of ranges of a tile, how many of them may be empty in a set that sends no empty cells)."""
    differ = (100 - percent) * 2 * (_BANDS[band + 1] - 1) // (100 + percent)
    spare = max(1, (differ + 1) // 5) if differ else 0
    return differ + 1 + spare, spare


_EDGES: dict[int, np.ndarray] = {}


def cells(found: np.ndarray, percent: int) -> np.ndarray:
    """The cells of a sorted set: 64-bit keys whose low byte is the band (modulo 256)."""
    return _cells(found, percent)[0]


def _cells(found: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """cells(), and for each of the set's tiles how many cells it may leave out, times 256, plus the band's low byte."""
    out, budgets = [], []
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mix(found ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    for band in tiles(len(found), percent):
        parts, spare = ranges(band, percent)
        if parts not in _EDGES:
            if len(_EDGES) > 4096:
                _EDGES.clear()
            _EDGES[parts] = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(found, _EDGES[parts]), [len(found)]])
        empty = at[1:] == at[:-1]
        number = np.arange(parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(48))
        key = mix(mix(number + np.uint64(1)) + (sums[at[1:]] - sums[at[:-1]]))
        key = (key & ~np.uint64(255)) | np.uint64(band & 255)
        gaps = int(empty.sum())
        out.append(key if gaps > spare else key[~empty])
        budgets.append((0 if gaps > spare else spare - gaps) << 8 | band & 255)
    return np.concatenate(out), budgets


def bitmap(found: np.ndarray) -> np.ndarray:
    """2n to 4n bits (64 at least, a power of two): bit h mod size for each hash h."""
    size = max(64, 1 << (2 * len(found)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought to `size` words; each set still has the bits of its hashes modulo the new size."""
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def may_reach(n: np.ndarray | int, m: np.ndarray | int, differing: np.ndarray | int, percent: int):
    """Whether sets of n and m shingles whose bitmaps differ in so many bits can reach the threshold."""
    most = np.minimum((n + m - differing) // 2, np.minimum(n, m))
    return 100 * most >= percent * (n + m - most)


def reaches(n, m, common, percent: int):
    return 100 * common >= percent * (n + m - common)


def _longs(values, unsigned=True):
    return pa.array(np.asarray(values, np.uint64).view(np.int64) if unsigned else values, pa.int64())


def shingled(df: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, a, b, cells, bits, budgets) of df(doc_id, text): text_key is a hash of the text, a and b are a 128-bit identity of the set; cells, bits and budgets are null for copies of a set that the task has sent."""

    def run(batches):
        claim("near_dups")
        seen: set[int] = set()
        for batch in batches:
            n, a, b, own, bits, budgets = [], [], [], [], [], []
            for x in batch.column(2):
                found = shingle_set(x.as_py().encode(), k)
                ident = _identity(found)
                n.append(len(found))
                a.append(ident[0])
                b.append(ident[1])
                whole = ident[0] << 128 | ident[1] << 64 | len(found)
                if not len(found) or whole in seen:
                    own.append(None)
                    bits.append(None)
                    budgets.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(whole)
                keys, spared = _cells(found, percent)
                own.append(keys.view(np.int64))
                budgets.append(spared)
                bits.append(bitmap(found).tobytes())
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), _longs(a), _longs(b), pa.array(own, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(budgets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n", "a", "b", "cells", "bits", "budgets"])

    whole_text_batches(df.sparkSession)
    text = utf8(F.col("text"))
    return df.select("doc_id", F.xxhash64(text), text).mapInArrow(run, "doc_id long, text_key long, n long, a long, b long, cells array<bigint>, bits binary, budgets array<bigint>")


def _met(edges: bool):
    """Of rows (cell, x) sorted by both: pairs of small cells as (a, b, false); of large cells (cell, x, true) for each set,
    or, with edges, (first set, x, true) for each further one."""

    def run(batches):
        claim("near_dups")
        held: list[int] = []  # distinct sets of the cell at hand, CELL + 1 at most
        cell, last = None, None
        first, second, large = [], [], []

        def put(a, b, big):
            first.append(a)
            second.append(b)
            large.append(big)

        def done():
            if 1 < len(held) <= CELL:
                for i in range(len(held)):
                    for j in range(i):
                        put(held[j], held[i], False)

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(large, pa.bool_())], ["a", "b", "large"])
            first.clear()
            second.clear()
            large.clear()
            return out

        for batch in batches:
            cs, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # only rows next to one of the same cell matter; the batch's ends may continue elsewhere
            same = cs[1:] == cs[:-1]
            near = np.zeros(len(cs), bool)
            near[1:] |= same
            near[:-1] |= same
            near[[0, -1]] = True
            for c, x in zip(cs[near].tolist(), xs[near].tolist()):
                if c != cell:
                    done()
                    held, cell, last = [x], c, x
                elif x != last:
                    last = x
                    if len(held) <= CELL:
                        held.append(x)
                        if len(held) == CELL + 1:
                            for h in held[edges:]:
                                put(held[0] if edges else c, h, True)
                    else:
                        put(held[0] if edges else c, x, True)
            yield taken()
        done()
        yield taken()

    return run


def _identity(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart; with the size they are a set's identity."""
    if not len(found):
        return 0, 0
    return int(mix(found).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(found + np.uint64(0x517CC1B727220A95))))


def _arrays(df: DataFrame, k: int) -> DataFrame:
    """(a, b, n, bits, hashes) of df(text)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set((x or "").encode(), k) for x in batch.column(0).to_pylist()]
            idents = [_identity(s) for s in sets]
            cols = [_longs([a for a, _ in idents]), _longs([b for _, b in idents]), pa.array([len(s) for s in sets], pa.int64())]
            cols += [pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "n", "bits", "hashes"])

    return df.mapInArrow(run, "a long, b long, n long, bits binary, hashes binary")


def _within(column: str, percent: int):
    """Filter of pairs (a, b, n, m, x, y): by bitmaps or by hashes."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "m", "x", "y"))):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if column == "bits":
                    size = min(len(u), len(v))
                    keep.append(bool(may_reach(n, m, int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()), percent)))
                else:
                    keep.append(bool(reaches(n, m, len(np.intersect1d(u, v, assume_unique=True)), percent)))
            yield batch.select(["a", "b", "n", "m"]).filter(pa.array(keep, pa.bool_()))

    return run


def _checked(pairs: DataFrame, arrays: DataFrame, column: str, percent: int) -> DataFrame:
    one = arrays.select(F.col("id").alias("a"), "n", F.col(column).alias("x"))
    two = arrays.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col(column).alias("y"))
    held = pairs.select("a", "b").join(one, "a").join(two, "b")
    within = held.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return within.select("a", "b", "n", "m", "x", "y").mapInArrow(_within(column, percent), "a long, b long, n long, m long")


def _block(percent: int):
    """Links between two blocks of a family: edges of a spanning forest, and for each set the weight of its links."""

    def run(key, frame):
        i, j = int(key[1]), int(key[2])
        left = frame[frame["own"] == i]
        right = frame[frame["own"] == j] if i != j else left
        ids, jds = left["id"].to_numpy(), right["id"].to_numpy()
        n, m = left["n"].to_numpy(), right["n"].to_numpy()
        weight, jweight = left["copies"].to_numpy(), right["copies"].to_numpy()
        bits = [np.frombuffer(x, np.uint64) for x in left["bits"]]
        jbits = [np.frombuffer(x, np.uint64) for x in right["bits"]]
        sets = [np.frombuffer(x, np.uint64) for x in left["hashes"]]
        jsets = [np.frombuffer(x, np.uint64) for x in right["hashes"]]
        stacked: dict[int, np.ndarray] = {}
        links = np.zeros(len(ids), np.int64)
        jlinks = np.zeros(len(jds), np.int64)
        parent = {x: x for x in [*ids.tolist(), *jds.tolist()]}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        for p in range(len(ids)):
            start = p + 1 if i == j else 0
            size = len(bits[p])
            least = min([size, *{len(x) for x in jbits}])
            if least not in stacked:
                stacked[least] = np.stack([folded(x, least) for x in jbits])
            differ = np.bitwise_count(stacked[least][start:] ^ folded(bits[p], least)).sum(axis=1, dtype=np.int64)
            near = start + np.flatnonzero(may_reach(n[p], m[start:], differ, percent))
            if not len(near):
                continue
            ends = np.cumsum([len(jsets[q]) for q in near])
            joined = np.concatenate([jsets[q] for q in near])
            spot = np.searchsorted(sets[p], joined)
            hit = np.concatenate([[0], np.cumsum(sets[p][np.minimum(spot, len(sets[p]) - 1)] == joined)])
            common = hit[ends] - hit[np.concatenate([[0], ends[:-1]])]
            linked = near[reaches(n[p], m[near], common, percent)]
            links[p] += jweight[linked].sum()
            if i == j:
                links[linked] += weight[p]
            else:
                jlinks[linked] += weight[p]
            for q in linked:
                x, y = root(int(ids[p])), root(int(jds[q]))
                if x != y:
                    parent[y] = x
                    edges.append((int(ids[p]), int(jds[q])))
        rows = [(x, y, 0) for x, y in edges]
        rows += [(int(x), int(x), int(c)) for x, c in zip([*ids, *(jds if i != j else [])], [*links, *(jlinks if i != j else [])]) if c]
        return pd.DataFrame(rows, columns=["a", "b", "links"]).astype("int64")

    return run


def names(sets: DataFrame):
    """A 64-bit name for each set of sets(a, b, n), told apart by all three: their hash, or where hashes clash another one,
    until no two sets share a name. Of 10**10 sets about three pairs clash."""
    name, seed = F.xxhash64("a", "b", "n"), 0
    while clash := [r[0] for r in sets.groupBy(name.alias("id")).count().filter("count > 1").limit(CLASHES).collect()]:
        seed += 1
        name = F.when(name.isin(clash), F.xxhash64("a", "b", "n", F.lit(seed))).otherwise(name)
    return name


def blocks_of(families: DataFrame, sizes: DataFrame) -> DataFrame:
    """(label, id, blocks) of families(node, label) and sizes(label, count, longest): in how many blocks a family is cut.

    Blocks grow with the family, so that a set is copied to COPIES of them at most, but to no more than LARGEST shingles.
    """
    each = F.greatest(F.lit(1.0), F.least(F.greatest(F.col("count") / COPIES, F.lit(float(BLOCK))), F.floor(F.lit(LARGEST) / F.col("longest")).cast("double")))
    return families.join(sizes, "label").select("label", F.col("node").alias("id"), F.ceil(F.col("count") / each).cast("int").alias("blocks"))


def jaccard_classes(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_key, class_key) for each row of df(doc_id, text).

    Two documents link when 100 * shared shingles >= percent * shingles of either; component_id is the smallest doc_id
    reachable by links, n_links the number of documents that a document links with. Words are runs without ASCII white
    space, A-Z lower-cased; a text of fewer than k words has one shingle, and one without words (or null) has none and
    links with nothing. Copies are one set throughout and get their class at the end. Rows that repeat a doc_id are
    documents of their own that share the class of their text; null doc_ids are classed too, and a class of null ids
    alone has a null component_id. An empty table gives no rows; other columns of df,
    whatever their names, are ignored. Texts of any length are shingled whole. text_key is a hash of the row's text and
    class_key a number that the rows of a class share (null without words): with them, rows of null or repeated ids can
    be told apart.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = materialize(shingled(docs, k, percent), "shingled")
    full = found.filter("n > 0")
    sets = materialize(full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "sets")
    ident = names(sets)
    written, sets = sets, sets.select(ident.alias("id"), "n", "least", "copies")
    sent = full.filter("cells is not null").select(F.explode("cells").alias("cell"), ident.alias("a"))
    met = sent.repartition("cell").sortWithinPartitions("cell", "a").mapInArrow(_met(False), "a long, b long, large boolean")
    met = first_met = materialize(met.distinct(), "met")
    # each set leaves out its largest cells, within its budget, by an order of cells that all sets share
    hot = met.filter("large").select(F.col("a").alias("cell"), F.col("b").alias("x"))
    crowds = materialize(hot.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "crowds")
    budgets = full.filter("budgets is not null").select(ident.alias("x"), F.explode("budgets").alias("_b")).distinct()
    budgets = budgets.select("x", F.expr("_b & 255").alias("band"), F.shiftright("_b", 8).alias("budget"))
    held = hot.join(crowds, "cell").withColumn("band", F.expr("cell & 255")).join(budgets, ["x", "band"])
    rank = F.row_number().over(Window.partitionBy("x", "band").orderBy(F.desc("m"), "cell"))
    stay = held.withColumn("_rank", rank).filter("_rank > budget").select("cell", F.col("x").alias("a"))
    again = stay.repartition("cell").sortWithinPartitions("cell", "a").mapInArrow(_met(True), "a long, b long, large boolean")
    again = materialize(again.distinct(), "again")
    families = components(again.filter("large").select("a", "b"))
    met = met.filter("not large").unionByName(again.filter("not large")).distinct()
    pairs = met.filter("not large")
    one, two = (families.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("a", "b"))
    pairs = pairs.join(one, "a", "left").join(two, "b", "left").filter("_a is null or _b is null or _a != _b").select("a", "b")
    pairs = materialize(pairs, "pairs")

    # pairs whose bitmaps allow it, and then the arrays of their sets and of the families' from the texts of those alone:
    # a bounded filter spares the shuffle of the others
    both = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    first = full.filter("cells is not null").select("doc_id", "n", "bits", ident.alias("id"))
    bits = materialize(first.join(both, "id", "left_semi").select("id", "n", "bits").dropDuplicates(["id"]), "bits")
    within = materialize(_checked(pairs, bits, "bits", percent), "within")
    wanted = within.select("a").union(within.select("b")).union(families.select("node")).distinct().withColumnRenamed("a", "id")
    wanted = materialize(first.select("doc_id", "id").join(wanted, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id")), "wanted")
    rows = materialize(found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, ident).otherwise(F.xxhash64("doc_id", F.lit(0))).alias("id")), "rows")
    forget(spark, found.written_to)
    slots = slots_for(wanted.count())
    marked = slot_filter(wanted, "doc_id", slots, 1)
    near = maybe_repeated(docs.withColumn("_key", F.col("doc_id")), "_key", marked, slots).filter("_maybe").select("doc_id", "text")
    texts = near.join(wanted.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    arrays = _arrays(texts.select("text"), k).withColumn("id", ident).select("id", "n", "bits", "hashes")
    arrays = materialize(arrays.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "arrays")
    links = materialize(_checked(within, arrays, "hashes", percent).select("a", "b"), "links")
    longest = families.join(sets.select(F.col("id").alias("node"), "n"), "node").groupBy("label")
    sizes = materialize(longest.agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("longest")), "sizes")
    seats = blocks_of(families, sizes).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), "blocks").cast("int"))
    held = seats.join(arrays, "id").join(sets.select("id", "copies"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = held.withColumn("_o", other).withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o")).drop("_o", "blocks")
    inside = materialize(dealt.groupBy("label", "i", "j").applyInPandas(_block(percent), "a long, b long, links long"), "inside")

    classes = components(links.unionByName(inside.filter("a != b").select("a", "b")))
    weights = sets.select(F.col("id").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(weights, "b").select("a", F.col("copies").alias("links")).unionByName(inside.filter("a = b").select("a", "links"))
    counted = counted.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    labelled = sets.join(classes.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = materialize(labelled.join(counted, "id", "left"), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    least = materialize(least, "least")
    known = labelled.join(least, "label").select("id", "component_id", F.col("label").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = materialize(known, "known")
    out = rows.join(known, "id", "left")
    done = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), "text_key", F.when(F.col("n_shingles") > 0, F.col("class_key")).alias("class_key"))
    done = materialize(done, "classes")
    for t in (written, first_met, crowds, again, families, pairs, bits, rows, wanted, arrays, within, links, sizes, inside, classes, labelled, least, known):
        if hasattr(t, "written_to"):
            forget(spark, t.written_to)
    return done
