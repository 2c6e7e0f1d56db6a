"""Document fingerprints from closed syncmers over words, as DataFrame expressions throughout.

A k-mer of ``K`` words is kept if the smallest hash of its inner ``S``-word substrings (the leftmost of equal ones) lies at
its first or last place. The choice looks at the k-mer alone, so an edit elsewhere moves no anchor. The fingerprint is the
list of distinct anchors, 40 bits each, in order of first place; likeness is their Dice coefficient. Anchors keep their
word numbers: two texts are matched by place at the shift that most of their common anchors agree on (``best_shift``).

Each row meets the following one in cells of neighbouring rows. The rows' order is cut at exact ranks, taken from a
narrow table of ids and text hashes, so outlying ids, gaps and null ids make no cell larger than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.runtime import materialise, release

K, S = 5, 2
MASK = (1 << 40) - 1
#: Rows of a cell; cells of a block; the most blocks there are. The first key of each cell, 24 bytes, is broadcast: 65,536
#: of them, beyond which cells hold more rows.
CELL_ROWS, BLOCK_CELLS, MAX_BLOCKS = 512, 256, 256


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, positions: bool = False) -> Column:
    """Anchor hashes of a text in order, or structs (pos, hash) with the word number of each k-mer.

    Null texts count as empty and have none; a text of fewer than K words has one, over all its words, as has a text of
    which no k-mer is chosen.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")

    def chosen(w: Column) -> Column:
        inner = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))), 1, F.greatest(F.size(w) - 1, F.lit(0)))

        def pick(h: Column) -> Column:
            def one(a: Column, i: Column) -> Column:
                b, c, d = (F.get(h, i + j) for j in (1, 2, 3))
                edge = ((a <= b) & (a <= c) & (a <= d)) | ((d < a) & (d < b) & (d < c))
                value = F.xxhash64(a, c, d).bitwiseAND(F.lit(MASK))
                return F.when(edge & d.isNotNull(), F.struct(i.alias("pos"), value.alias("hash")) if positions else value)

            return F.array_compact(F.transform(h, one))

        whole = F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(MASK))
        single = F.array(F.struct(F.lit(0).alias("pos"), whole.alias("hash")) if positions else whole)
        found = F.when(F.size(w) >= K, _bind(inner, pick)).otherwise(F.slice(single, 1, 0))
        return _bind(found, lambda own: F.when((F.size(own) > 0) | (F.size(w) == 0), own).otherwise(single))

    return _bind(words, chosen)


def fingerprint(text: Column) -> Column:
    return F.array_distinct(anchors(text))


def as_string(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda h: F.lower(F.hex(h))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints, 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.when(both > 0, both))


def best_shift(a: Column, b: Column) -> Column:
    """struct(shift, n): the distance of places that most common anchors of two texts have, and how many they are.

    For arrays from ``anchors(.., positions=True)``. An anchor counts once, by its first place in each text; of equally
    frequent shifts the nearest to 0 wins; null where nothing is common. Sorts instead of comparing all with all.
    """
    tagged = lambda x, side: F.transform(x, lambda y: F.struct(y["hash"].alias("h"), F.lit(side).alias("t"), (y["pos"] * (2 * side - 1)).alias("p")))

    def met(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(s, i - 1)
            return F.when((i > 0) & (x["t"] == 1) & (last["t"] == 0) & (last["h"] == x["h"]), x["p"] + last["p"])

        return F.sort_array(F.array_compact(F.transform(s, one)))

    def mode(d: Column) -> Column:
        ends = F.array_compact(F.transform(d, lambda x, i: F.when(~F.get(d, i + 1).eqNullSafe(x), F.struct(i.alias("i"), x.alias("x")))))
        runs = _bind(ends, lambda e: F.transform(e, lambda x, i: F.struct((x["i"] - F.when(i > 0, F.get(e, i - 1)["i"]).otherwise(-1)).alias("n"), (-F.abs(x["x"])).alias("near"), x["x"].alias("shift"))))
        return _bind(F.array_max(runs), lambda v: F.when(v.isNotNull(), F.struct(v["shift"].alias("shift"), v["n"].alias("n"))))

    return _bind(_bind(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), met), mode)


def _place(i: Column, text: Column) -> Column:
    """Ascending where rows come by descending id, nulls last, then by the text's hash."""
    return F.struct(i.isNull().alias("none"), F.coalesce(F.bitwise_not(i), F.lit(0)).alias("down"), F.xxhash64(text).alias("h"))


def cell_heads(places: DataFrame, cell_rows: int = CELL_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(block, heads) from a column ``place``: every cell_rows-th place of their order, by blocks numbered from 1.

    ``heads`` are structs (place, cell, into), ascending; ``into`` is the cell before, for the first the last one. At most
    max_blocks rows. The order is by range partitions, of which only row counts and every cell_rows-th place are gathered.
    """
    many = max(1, places.sparkSession.sparkContext.defaultParallelism)
    narrow, narrow_path = materialise(places.select("place"), "syncmer-places")
    dealt = narrow.repartitionByRange(many, "place").sortWithinPartitions("place").select("place", F.monotonically_increasing_id().alias("m"))
    dealt, _ = materialise(dealt, "syncmer-order")
    release(places.sparkSession, narrow_path)
    part = F.shiftright("m", 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    size = max(cell_rows, -(-dealt.count() // (max_blocks * BLOCK_CELLS)))
    rank = F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    first = dealt.withColumn("part", part).join(F.broadcast(before), "part").where(rank % size == 0).groupBy("place").agg(F.lit(0))
    order = Window.orderBy("place")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = first.select("place", F.row_number().over(order).alias("cell"))
    heads = cells.select("place", "cell", F.coalesce(F.lag("cell").over(order), F.last("cell").over(ends)).alias("into"))
    block = ((F.col("cell") - 1) / BLOCK_CELLS).cast("int") + 1
    return heads.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "cell", "into"))).alias("heads"))


def with_next(docs: DataFrame, id_col: str, text_col: str, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Window]:
    """Rows (id, text, _cell, _copy) in cells of neighbours, a copy of each cell's first row closing the cell before.

    Order: descending id (nulls and ids that are no number last), then the text's hash, then text. lead() over the window
    sees the following document; after the last it sees the first. Rows with ``_copy`` 1 are the copies, to be dropped
    afterwards. Texts are shuffled once. Only rows that are alike in id and text hash share a cell whatever their number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias(text_col), _place(F.col(id_col).cast("long"), text).alias("_place"))
    blocks, _ = materialise(cell_heads(rows.select(F.col("_place").alias("place")), cell_rows), "syncmer-heads")
    firsts = [r["f"] for r in blocks.orderBy("block").select(F.col("heads")[0]["place"].alias("f")).collect()]  # MAX_BLOCKS rows
    literal = lambda f: F.struct(F.lit(f["none"]).alias("none"), F.lit(f["down"]).cast("long").alias("down"), F.lit(f["h"]).cast("long").alias("h"))
    block = F.size(F.filter(F.array(*map(literal, firsts)), lambda f: f <= F.col("_place"))) if firsts else F.lit(0)
    told = rows.withColumn("_block", block).join(F.broadcast(blocks), F.col("_block") == F.col("block"))
    at = told.withColumn("_at", F.element_at(F.filter("heads", lambda x: x["place"] <= F.col("_place")), -1)).drop("heads")
    own = F.struct(F.col("_at.cell").alias("cell"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("_at.into").alias("cell"), F.lit(1).alias("copy"))
    spread = at.withColumn("_to", F.explode(F.when(F.col("_at.place") == F.col("_place"), F.array(own, copy)).otherwise(F.array(own))))
    placed = spread.select(id_col, text_col, "_place", F.col("_to.cell").alias("_cell"), F.col("_to.copy").alias("_copy"))
    return placed, Window.partitionBy("_cell").orderBy("_copy", "_place", text_col)


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shift_edited, n_shift) of each row.

    shift_edited and n_shift: by how many words most anchors common to the text and its edited text are moved, and how
    many those are (null and 0 where none is common). Null texts count as empty; rows with the same id follow each other
    by their texts' hashes; a single row follows itself; an empty table gives no rows. Other columns are not read.
    """
    rows, w = with_next(docs, id_col, text_col)
    text = F.col(text_col)
    seen = rows.withColumn("_next", F.lead(text_col).over(w))
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.left(text, F.length(text) - half), F.left(F.col("_next"), half))
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: x["hash"]))
    marked = seen.withColumn("_anchors", anchors(text, True)).withColumn("_marks", hashes("_anchors")).withColumn("_edited", F.when(F.col("_copy") == 0, edited))
    both = marked.withColumn("_next_marks", F.lead("_marks").over(w)).where("_copy = 0")
    told = both.withColumn("_edited_anchors", anchors(F.col("_edited"), True)).withColumn("_edited_marks", hashes("_edited_anchors"))
    told = told.withColumn("_shift", best_shift(F.col("_anchors"), F.col("_edited_anchors")))
    return told.select(
        id_col, F.length(text).cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("_marks")).alias("fingerprint"), as_string(F.col("_edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("_marks"), F.col("_edited_marks")).alias("near_edited"), likeness(F.col("_marks"), F.col("_next_marks")).alias("near_next"),
        F.col("_shift.shift").alias("shift_edited"), F.coalesce("_shift.n", F.lit(0)).alias("n_shift"),
    )
