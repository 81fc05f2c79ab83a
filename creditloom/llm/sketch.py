"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in Spark expressions only.

A sketch has three tables of cells. A digest goes into one cell of each: its count, its digest and its check are
added there (counts by sum, the others by XOR). Subtracting two sketches leaves the digests in which two texts
differ. A cell with one digest left gives it away; taken out of its other cells it frees further ones. If cells
remain, the sketch was too small: digests are dealt into bins, a sketch each, and those of bins that fail into more bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import materialise

#: Cells in each of the three tables of a sketch.
TABLE = 12
CELLS = 3 * TABLE
ROUNDS = 16
#: Digests of both texts for each bin when the smallest sketch was too small.
BIN_LOAD = 18
#: A line is cut at the first end of a sentence after so many characters: at every one.
LEAST_CHARS = 1
#: Consecutive ids whose rows meet in one group.
GROUP_IDS = 1024


def paragraphs(text: Column) -> Column:
    """Lines, cut behind every end of a sentence; blank lines count nothing."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{{LEAST_CHARS},}}?[.!?](?=\s)|[^\n]+"), F.lit(0))


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def placed(values: Column, level: int) -> Column:
    """Digests with their check and a bit for each of their cells; every level has cells of its own."""

    def one(d: Column) -> Column:
        return F.struct(d.alias("x"), _check(d).alias("c"), _cells(d, level).alias("cells"))

    return F.transform(values, one)


def _places(digest: Column, level: int) -> list[Column]:
    """Numbers of the three cells of a digest, one in each table."""
    h = F.xxhash64(digest, F.lit(level))
    return [(F.pmod(F.shiftright(h, 16 * j), F.lit(TABLE)) + TABLE * j).cast("int") for j in range(3)]


def _cells(digest: Column, level: int) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in _places(digest, level)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _cell(i: Column, n: Column, x: Column, c: Column) -> Column:
    return F.struct(i.alias("i"), n.alias("n"), x.alias("x"), c.alias("c"))


def _here(item: Column, i: Column) -> Column:
    return F.getbit(item["cells"], i) == 1


def sketch(items: Column) -> Column:
    """Cells of ``placed`` digests: number of the cell, count, XOR of digests, XOR of checks."""

    def add(cell: Column, item: Column) -> Column:
        return _cell(cell["i"], cell["n"] + 1, cell["x"].bitwiseXOR(item["x"]), cell["c"].bitwiseXOR(item["c"]))

    def empty(i: Column) -> Column:
        return _cell(i, F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))

    def cells(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(CELLS - 1))
        return F.transform(numbers, lambda i: F.aggregate(F.filter(all_items, lambda t: _here(t, i)), empty(i), add))

    # Bound to a variable, the items are worked out once and not for each cell.
    return F.get(F.transform(F.array(items), cells), F.lit(0))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(
        left, right, lambda a, b: _cell(a["i"], a["n"] - b["n"], a["x"].bitwiseXOR(b["x"]), a["c"].bitwiseXOR(b["c"]))
    )


def peel(cells: Column, level: int) -> Column:
    """(found, rest): digests with count 1 (left only) or -1 (right only), and the number of cells that are not empty.

    ``cells`` are those of a difference, in any order; empty ones may be absent.
    """

    def pure(state: Column) -> Column:
        single = F.filter(state["cells"], lambda v: (F.abs(v["n"]) == 1) & (v["c"] == _check(v["x"])))
        once = F.array_distinct(F.transform(single, lambda v: F.struct(v["n"].alias("n"), v["x"].alias("x"), v["c"].alias("c"))))
        return F.transform(once, lambda v: F.struct(v["n"].alias("n"), v["x"].alias("x"), v["c"].alias("c"), _cells(v["x"], level).alias("cells")))

    def one_round(state: Column, _: Column) -> Column:
        return F.when(state["over"], state).otherwise(F.get(F.transform(F.array(pure(state)), lambda p: after(state, p)), F.lit(0)))

    def after(state: Column, taken: Column) -> Column:
        def remove(cell: Column, item: Column) -> Column:
            return _cell(cell["i"], cell["n"] - item["n"], cell["x"].bitwiseXOR(item["x"]), cell["c"].bitwiseXOR(item["c"]))

        def changed(cell: Column, bits: Column) -> Column:
            return F.when(F.getbit(bits, cell["i"]) == 0, cell).otherwise(F.aggregate(F.filter(taken, lambda t: _here(t, cell["i"])), cell, remove))

        def go_on() -> Column:
            touched = F.aggregate(taken, F.lit(0).cast("bigint"), lambda all_cells, t: all_cells.bitwiseOR(t["cells"]))
            changes = F.get(F.transform(F.array(touched), lambda bits: F.transform(state["cells"], lambda v: changed(v, bits))), F.lit(0))
            left = F.filter(changes, _not_empty)
            plain = F.transform(taken, lambda t: F.struct(t["n"].alias("n"), t["x"].alias("x")))
            return F.struct(left.alias("cells"), F.concat(state["found"], plain).alias("found"), F.lit(False).alias("over"))

        ended = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over"))
        return F.when(F.size(taken) == 0, ended).otherwise(go_on())

    start = F.struct(
        F.filter(cells, _not_empty).alias("cells"), F.expr("cast(array() as array<struct<n:int,x:bigint>>)").alias("found"), F.lit(False).alias("over")
    )

    def result(state: Column) -> Column:
        return F.struct(state["found"].alias("found"), F.size(state["cells"]).alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, result)


def _not_empty(cell: Column) -> Column:
    return (cell["n"] != 0) | (cell["x"] != 0) | (cell["c"] != 0)


def written(cells: Column) -> Column:
    """A sketch as text: count, digest and check of each cell in hexadecimal digits."""
    return F.lower(
        F.array_join(
            F.transform(cells, lambda v: F.concat(F.lpad(F.hex(v["n"]), 8, "0"), F.lpad(F.hex(v["x"]), 16, "0"), F.lpad(F.hex(v["c"]), 16, "0"))), ""
        )
    )


def likeness(left: Column, right: Column, differing: Column) -> Column:
    """Shared digests by all digests, from the sizes of both sets and of their difference; 1 for two empty sets."""
    every = left + right + differing
    return F.when(every == 0, 1.0).otherwise((left + right - differing).cast("double") / every)


def _following(keys: DataFrame) -> DataFrame:
    """(k, next) of distinct whole numbers ``k``: the next smaller one, null for the smallest.

    Wide ranges are cut into runs of consecutive numbers, and the runs are followed in the same way.
    """
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    if low is None or high - low < 64 * GROUP_IDS:
        return keys.select("k", F.lead("k").over(Window.orderBy(F.desc("k"))).alias("next"))  # at most 65,536 rows
    dealt = keys.select("k", F.floor(F.col("k") / GROUP_IDS).alias("run"))
    tops = materialise(dealt.groupBy("run").agg(F.max("k").alias("top")))
    runs = _following(tops.select(F.col("run").alias("k")))
    below = runs.join(tops.select(F.col("run").alias("next"), "top"), "next").select(F.col("k").alias("run"), "top")
    inside = F.lead("k").over(Window.partitionBy("run").orderBy(F.desc("k")))
    return dealt.withColumn("inside", inside).join(below, "run", "left").select("k", F.coalesce("inside", "top").alias("next"))


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column]) -> DataFrame:
    """(doc_id, row, own, next, next_own) of every row: its ``columns`` and what is ``derived``, one after the other, from
    ``row``, and the same of the next row by falling doc_id.

    After the last row comes the first. Equal ids are ordered by their columns, rows without id stand last.
    Rows with ids of one run of ``GROUP_IDS`` numbers meet in one group; where a run ends, the row that follows
    is sent along as a guest. So each row is shuffled once, plus one row for each run, and derived values
    are computed once and never shuffled.
    """
    row = F.struct(*columns)
    run = F.floor(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 62))) / GROUP_IDS)
    runs = materialise(docs.select("doc_id").groupBy(run.alias("run")).agg(F.max("doc_id").alias("top")))
    highest = runs.agg(F.max("run")).first()[0]
    after = _following(runs.select(F.col("run").alias("k")))
    after = after.select(F.col("k").alias("to_run"), F.coalesce("next", F.lit(highest)).alias("run"))
    guests = materialise(after.join(runs, "run").select("to_run", F.col("top").alias("top_id")))
    own = docs.select("doc_id", row.alias("row"), run.alias("run"), F.lit(False).alias("guest"))
    # The guests are one small row per run of ids: broadcast if they are small enough, else a shuffled join.
    visiting = docs.join(guests, F.col("doc_id").eqNullSafe(F.col("top_id")))
    visiting = visiting.select("doc_id", row.alias("row"), F.col("to_run").alias("run"), F.lit(True).alias("guest"))
    order = Window.partitionBy("run").orderBy("guest", F.col("doc_id").desc_nulls_last(), "row")
    met = own.unionByName(visiting).withColumn("next", F.lead("row").over(order))
    for name, value in derived.items():
        met = met.withColumn(name, value)
    met = met.withColumn("own", F.struct(*derived)).withColumn("next_own", F.lead("own").over(order))
    return met.filter("not guest").select("doc_id", "row", "own", "next", "next_own")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, only_text, only_edited) of
    every row of ``docs`` (doc_id, text, any other columns).

    The edited text has the last half of its code points, rounded down, replaced by the first as many of the next
    document by falling doc_id (after the last comes the first; equal ids are ordered by text). fingerprint is the
    smallest sketch, always of the same size; near_ is the share of common paragraphs among all, as recovered
    from the difference of sketches, with larger sketches where the smallest do not suffice. only_text and only_edited count the
    recovered digests of either side. Null texts count as empty; two texts without paragraphs are alike (1).
    Repeated rows come back as often as they came; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own_set = digests(F.col("row.text"))
    rows = with_next(docs.select("doc_id", text.alias("text")), ["text"], {"set": own_set, "cells": sketch(placed(F.col("set"), 0))})
    size = F.length("row.text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("row.text"), F.lit(1), size - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", size.cast("bigint").alias("n_chars"), edited.alias("edited"), F.col("own.set").alias("a"), F.col("next_own.set").alias("x"),
                       F.col("own.cells").alias("sketch_a"), F.col("next_own.cells").alias("sketch_x"))
    rows = rows.withColumn("e", digests(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = rows.withColumn("sketch_e", sketch(placed(F.col("e"), 0)))
    pairs = [peel(subtract(F.col("sketch_a"), F.col(f"sketch_{s}")), 0).alias(f"peeled_{s}") for s in "ex"]
    rows = rows.select("*", *pairs)
    found = {
        f"{name}_{s}": F.when(F.col(f"peeled_{s}.rest") == 0, F.size(F.filter(f"peeled_{s}.found", lambda v: v["n"] == sign)))
        for s in "ex" for name, sign in (("left", 1), ("right", -1))
    }
    # Digests are kept only where a difference has not come out.
    kept = {s: F.when(F.col(f"peeled_{s}.rest") > 0, F.col(s)) for s in "ex"}
    own = F.when((F.col("peeled_e.rest") > 0) | (F.col("peeled_x.rest") > 0), F.col("a"))
    first = materialise(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256",
            written(F.col("sketch_a")).alias("fingerprint"), written(F.col("sketch_e")).alias("edited_fingerprint"),
            *[F.size(s).alias(f"size_{s}") for s in "aex"], *[v.alias(k) for k, v in found.items()],
            own.alias("a"), *[v.alias(s) for s, v in kept.items()],
        )
    )
    open_pairs = first.filter("e is not null or x is not null").select(
        "row", F.explode(F.array(*[F.struct(F.lit(s).alias("pair"), F.col("a").alias("left"), F.col(s).alias("right")) for s in "ex"])).alias("p")
    )
    late = _retried(open_pairs.select("row", "p.*").filter("right is not null"))
    wide = late.groupBy("row").agg(
        *[F.max(F.when(F.col("pair") == s, F.col(k))).alias(f"late_{k}_{s}") for s in "ex" for k in ("left", "right")]
    )
    # Only rows with an open difference meet the late results, in a shuffle at every size; the others pass by.
    waiting = first.filter("a is not null").drop("a", "e", "x").join(wide.hint("merge"), "row", "left")
    at_once = first.filter("a is null").drop("a", "e", "x").withColumns({c: F.lit(None).cast("bigint") for c in wide.columns if c != "row"})
    final = waiting.unionByName(at_once)
    differ = {f"{k}_{s}": F.coalesce(f"{k}_{s}", f"late_{k}_{s}") for s in "ex" for k in ("left", "right")}
    near = {
        name: likeness(F.col("size_a"), F.col(f"size_{s}"), differ[f"left_{s}"] + differ[f"right_{s}"])
        for name, s in (("near_edited", "e"), ("near_next", "x"))
    }
    return final.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *[v.alias(k) for k, v in near.items()],
        differ["left_e"].alias("only_text"), differ["right_e"].alias("only_edited"),
    )


def _retried(pairs: DataFrame) -> DataFrame:
    """(row, pair, left, right): recovered digests of either side of (row, pair, left set, right set), by larger and larger sketches.

    Digests are dealt into bins and added up by cell, those of the right set with the opposite sign, so each bin gives the cells of
    its difference at once. Only sets are shuffled, by row; all grouping of digests, cells and bins happens where they lie. Digests of
    bins that could not be peeled are dealt anew, into relatively more bins each time.
    """
    tries, level = [], 0
    while True:
        level += 1
        # Twice as many bins for as many digests at each further level.
        bins = F.ceil((F.size("left") + F.size("right")) * (1 << level - 1) / BIN_LOAD)
        sides = F.concat(*[F.transform(side, lambda d: F.struct(d.alias("x"), F.lit(sign).alias("sign"))) for side, sign in (("left", 1), ("right", -1))])
        each = pairs.repartition("row").select("row", "pair", bins.alias("bins"), F.explode(sides).alias("d")).select("row", "pair", "bins", "d.*")
        each = each.select(
            "row", "pair", "bins", _bin("x", level, "bins").alias("bin"), "x", "sign", _check(F.col("x")).alias("c"), F.explode(F.array(*_places(F.col("x"), level))).alias("i")
        )
        cells = each.groupBy("row", "pair", "bins", "bin", "i").agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
        sketches = cells.groupBy("row", "pair", "bins", "bin").agg(F.collect_list(_cell(*[F.col(c) for c in "inxc"])).alias("cells"))
        peeled = sketches.select("row", "pair", "bins", "bin", peel(F.col("cells"), level).alias("p"))
        good = F.col("p.rest") == 0
        tried = materialise(
            peeled.groupBy("row", "pair", "bins").agg(
                *[F.coalesce(F.sum(F.when(good, F.size(F.filter("p.found", lambda v: v["n"] == sign)))), F.lit(0)).alias(side) for side, sign in (("left", 1), ("right", -1))],
                F.collect_list(F.when(~good, F.col("bin"))).alias("failed"),
            )
        )
        tries.append(tried.select("row", "pair", "left", "right"))
        failed = tried.filter(F.size("failed") > 0).select("row", "pair", "bins", "failed")
        if failed.isEmpty():
            break
        again = pairs.join(failed.hint("merge"), ["row", "pair"])
        rest = {side: F.filter(side, lambda d: F.array_contains("failed", _bin(d, level, "bins"))) for side in ("left", "right")}
        pairs = materialise(again.select("row", "pair", *[v.alias(k) for k, v in rest.items()]))
    counts = tries[0]
    for more in tries[1:]:
        counts = counts.unionByName(more)
    return counts.groupBy("row", "pair").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))


def _bin(digest: Column | str, level: int, bins: str) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit("bin"), F.lit(level)), F.col(bins))
