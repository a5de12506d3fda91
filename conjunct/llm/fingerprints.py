"""Document fingerprints by winnowing, with DataFrame functions only.

Every k code points in a row give a hash, and of each window of w such hashes the least is chosen, the rightmost of equal
ones. Any run of w + k - 1 code points that two texts share thus gives both a common hash. Fingerprints keep the position
of each chosen hash.

The hash is a rolling one: the exclusive or of the hashes of the gram's code points, two at a time, each pair's shifted by
its distance from the gram's end. SQL functions can't carry a hash from one gram to the next; instead a gram's hash is
rolled together from those of its two halves, which takes log2(k) passes over the text however long grams are. The least
of a window comes from the least of its halves in the same way. No step reads more than two values for each place, so the
work is linear in a text.

Spark interprets lambdas node by node, so passes are written to evaluate few: a place meets its neighbour in a copy of the
array that is moved on (zip_with), not by an index; what belongs to a place stands where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conjunct.llm.shared import utf8

#: Code points of a gram (a power of two), grams of a window.
K, W = 8, 32
#: Low bits of a key that hold the position: more than an array can have. The high bits are the hash's own.
PLACE = 28
#: All of those bits.
LAST = (1 << PLACE) - 1
_NONE = "cast(array() as array<bigint>)"


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator stands between it and what reads it."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _first(values: Column, n: Column) -> Column:
    return F.slice(values, F.lit(1), F.greatest(n, F.lit(0)))


def points_of(text: Column) -> Column:
    """A text's code points, each a text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.expr("cast(array() as array<string>)"))


def _folded(value: Column, steps: list[int], step_of, use) -> Column:
    """use(value) after step_of(value, n) for each n of steps. One value is held at a time, however many steps there are."""
    held = F.array(*[F.lit(n) for n in steps]) if steps else F.expr("cast(array() as array<int>)")
    return F.aggregate(held, value, step_of, use)


def _later(values: Column, n, kind: str = "bigint") -> Column:
    """values n places further on, with nulls before them."""
    return F.concat(F.array_repeat(F.lit(None).cast(kind), n), values)


def _rolled(points: Column, k: int, use) -> Column:
    """use(hashes): at each place the hash of the k points that end there. Other places than k - 1 to the last mean nothing."""
    if k & (k - 1) or k < 2:
        raise ValueError("k must be a power of two, 2 at least")
    pairs = F.zip_with(_later(points, F.lit(1), "string"), points, lambda x, y: F.xxhash64(x, y))
    shifted = lambda x, step: F.call_function("shiftleft", x, step)
    doubled = lambda g, step: F.zip_with(_later(g, step), g, lambda x, y: shifted(x, step).bitwiseXOR(y))
    return _folded(pairs, [1 << s for s in range(1, k.bit_length() - 1)], doubled, use)


def _key(h: Column, rank: Column) -> Column:
    """A number in the order of hashes and, where they are equal, of ranks."""
    return h.bitwiseAND(F.lit(~LAST)).bitwiseOR(rank)


def keys(points: Column, hashes: Column, first: Column, k: int) -> Column:
    """The key of the gram that ends at each place, null where none does; `first` is the place of the first gram.

    Ranks fall with the place, so that the later of equal hashes has the lesser key.
    """
    top = F.lit(LAST) - first.cast("long")
    ranks = F.when(F.size(points) >= k, F.sequence(top, top - F.size(points) + k, F.lit(-1).cast("long"))).otherwise(F.expr(_NONE))
    return F.zip_with(hashes, _later(ranks, F.lit(k - 1)), _key)


def _windows(points: Column, held: Column, k: int, w: int, use, few: bool = False) -> Column:
    """use(least): the least of each w keys in a row; of fewer none, or with `few` the least of all."""
    steps, reach = [], 1
    while reach < w:  # the last step may overlap
        steps, reach = [*steps, min(reach, w - reach)], min(2 * reach, w)
    lesser = lambda m, step: F.zip_with(_later(m, step), m, lambda x, y: F.least(x, y))
    n = F.size(points) - (k + w - 2)

    def of_least(m: Column) -> Column:
        every = F.slice(m, F.lit(k + w - 1), F.greatest(n, F.lit(0)))
        return use(F.when(n < 1, F.array(F.array_min(m))).otherwise(every) if few else every)

    return _folded(held, steps, lesser, of_least)


def _chosen(least: Column, hash_at) -> Column:
    """(hashes, positions) of the keys that winnowing chose, each once."""
    at = F.transform(F.array_distinct(least), lambda x: (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("int"))
    return _let(at, lambda p: F.struct(F.transform(p, hash_at).alias("hashes"), p.alias("positions")))


def _print_of(points: Column, k: int, w: int, use) -> Column:
    """use(print, hashes, least): (hashes, positions) of points, and what _rolled() and _windows() give.

    Fewer points than k have one hash, of all of them, and neither of the others.
    """

    def of_hashes(g: Column) -> Column:
        of_least = lambda m: use(_chosen(m, lambda i: F.get(g, i + (k - 1))), g, m)
        return _windows(points, keys(points, g, F.lit(0), k), k, w, lambda m: _let(m, of_least), few=True)

    none = F.size(points) == 0
    hashes = F.when(none, F.expr(_NONE)).otherwise(F.array(F.xxhash64(points)))
    places = F.when(none, F.expr("cast(array() as array<int>)")).otherwise(F.array(F.lit(0)))
    whole = F.struct(hashes.alias("hashes"), places.alias("positions"))
    return F.when(F.size(points) < k, use(whole, None, None)).otherwise(_rolled(points, k, of_hashes))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """(hashes, positions) of a text, in two arrays of equal length. Null counts as empty."""
    return _let(points_of(utf8(text)), lambda c: _print_of(c, k, w, lambda own, g, m: own))


def fingerprints_of(text: Column, tail: Column, kept: Column, k: int = K, w: int = W) -> Column:
    """(own, edited): fingerprint() of a text, and that of its first `kept` code points followed by `tail`.

    Windows that lie within the kept part are those of the text itself, so only the others are computed.
    """

    def edited(c: Column, g: Column, m: Column, stay: Column) -> Column:
        """Of a text some of whose windows stay, of the points from the first gram of the first that does not."""

        def of_ends(e: Column) -> Column:
            def of_hashes(ends: Column) -> Column:
                at = lambda i: F.when(i < stay, F.get(g, i + (k - 1))).otherwise(F.get(ends, i - stay + (k - 1)))
                rest = lambda r: _chosen(F.concat(_first(m, stay), r), at)
                return _windows(e, keys(e, ends, stay, k), k, w, rest)

            return _rolled(e, k, of_hashes)

        return _let(F.concat(F.slice(c, stay + 1, kept - stay), points_of(tail)), of_ends)

    def use(c: Column) -> Column:
        def both(own: Column, g: Column | None, m: Column | None) -> Column:
            new = _let(F.concat(_first(c, kept), points_of(tail)), lambda e: _print_of(e, k, w, lambda found, g, m: found))
            if m is not None:
                staying = lambda stay: F.when(stay > 0, edited(c, g, m, stay)).otherwise(new)
                new = _let(F.greatest(kept - (k + w - 2), F.lit(0)), staying)
            return F.struct(own.alias("own"), new.alias("edited"))

        return _print_of(c, k, w, both)

    return _let(points_of(text), use)


def with_fingerprint(df: DataFrame, text: str, hashes: str, positions: str, k: int = K, w: int = W) -> DataFrame:
    """df with the chosen hashes and their positions under these names."""
    found = _held(df, "_print", fingerprint(F.col(text), k, w))
    return found.withColumn(hashes, F.col("_print.hashes")).withColumn(positions, F.col("_print.positions")).drop("_print")


def as_text(hashes: str, positions: str) -> Column:
    """hash@position, in hex and decimal, joined by commas."""
    return F.array_join(F.transform(hashes, lambda h, i: F.concat(F.lower(F.hex(h)), F.lit("@"), F.get(positions, i).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Twice the common hashes by all hashes of both (Dice); 1 where neither has any."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(df: DataFrame, order: str, carried: dict[str, str], then=lambda df: (df, {}), rows_each: int = 500, most: int = 16_384) -> DataFrame:
    """df with, under new names, columns of the row that follows by descending `order`; after the last comes the first.

    then(df) makes more columns of these, and names further ones to carry, from the same follower, without a new shuffle.

    Rows are dealt into ranges of about rows_each ids (`most` ranges at most: with more rows the ranges, which spill,
    become longer). The highest id of a range also goes, as a guest, to the range above, so that each range finds all its
    followers; no window spans the table. Nulls come last; rows of equal order follow each other by their other columns'
    hash.
    """
    ids = df.select(order)
    total = ids.count()
    if not total:
        df, more = then(df.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(n) for c, n in carried.items()]))
        return df.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(n) for c, n in more.items()])
    ranges = min(most, max(1, total // rows_each))
    at = ", ".join(str((i + 1) / ranges) for i in range(ranges))
    found = ids.selectExpr(f"percentile_approx({order}, array({at}), {max(10_000, 10 * ranges)}) as p", f"max({order}) as m").first()
    bounds = sorted({*(found["p"] or []), *([found["m"]] if found["m"] is not None else [])})
    held = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length() or 1))])
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(held, n + s - 1) < F.col(order)), n + s).otherwise(n))
    df = _held(df, "_range", F.coalesce(below, F.lit(0)))
    top = F.col(order).eqNullSafe(F.lit(found["m"]))
    head = F.get(held, F.col("_range")).eqNullSafe(F.col(order)) & ~top
    guest = F.when(top, F.array(F.lit(0))).when(head, F.array(F.col("_range") + 1)).otherwise(F.array().cast("array<int>"))
    seats = F.transform(F.concat(F.array(F.col("_range")), guest), lambda r, i: F.struct(r.alias("r"), i.alias("guest")))
    seated = df.withColumn("_seat", F.explode(seats)).select("*", F.col("_seat.r").alias("_r"), F.col("_seat.guest").alias("_guest")).drop("_seat", "_range")
    wraps = (F.col("_guest") == 1) & (F.col("_r") == 0)
    seated = seated.withColumn("_wraps", wraps)
    tie = F.xxhash64(*[F.col(c) for c, t in df.dtypes if t in ("string", "bigint", "int") and c not in (order, "_range")])
    seated = seated.withColumn("_tie", tie)
    by = Window.partitionBy("_r").orderBy("_wraps", F.desc_nulls_last(order), "_tie")
    for c, n in carried.items():
        seated = seated.withColumn(n, F.lead(c).over(by))
    seated, more = then(seated)
    for c, n in more.items():
        seated = seated.withColumn(n, F.lead(c).over(by))
    return seated.filter("_guest = 0").drop("_r", "_guest", "_wraps", "_tie")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its code points replaced by as many from the start of the next document (by
    descending id; after the last comes the first, so a lone document follows itself). Null texts count as empty; an
    empty text has an empty fingerprint, like another such text (1.0) and unlike all others (0.0); one of fewer than k
    code points has one hash, of all of them. Texts of any length are fingerprinted whole, in memory: about 250 bytes a
    character in one task. Rows of equal id follow each other in some order fixed by their texts; null ids come last. An
    empty table gives no rows; other columns of df, whatever their names, are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text)).alias("text"))

    def both(pairs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_kept", F.expr("int(n_chars - n_chars div 3)"))
        pairs = _held(pairs, "_tail", F.expr("substring(coalesce(_next, ''), 1, int(n_chars div 3))")).drop("_next")
        pairs = pairs.withColumn("edited_sha256", F.sha2(F.expr("concat(substring(text, 1, _kept), _tail)"), 256))
        pairs = _held(pairs, "_both", fingerprints_of(F.col("text"), F.col("_tail"), F.col("_kept"), k, w)).drop("text", "_tail", "_kept")
        names = {"_own": "own.hashes", "_at": "own.positions", "_edited": "edited.hashes", "_edited_at": "edited.positions"}
        return pairs.select("*", *[F.col(f"_both.{c}").alias(n) for n, c in names.items()]).drop("_both"), {"_own": "_theirs"}

    rows = with_next(docs, "doc_id", {"text": "_next"}, both)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("_own", "_at").alias("fingerprint"),
        as_text("_edited", "_edited_at").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"),
        likeness("_own", "_theirs").alias("near_next"),
    )
