"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs. DataFrame functions only.

A text's paragraphs, as a set of 64-bit digests, go into three rows of cells, each digest into one cell of each row. A cell has
the count of its digests and their xor. Sketches of one size subtract cell by cell: what two texts share goes out, and
the rest is peeled: a cell with one digest left (its check bits say so) gives the digest away, which is then taken out of its
other cells, and so on. If cells are left that none can be peeled from, the sketches were too small, and larger ones
are made and subtracted, each four times as large as the one before. A fingerprint is the smallest sketch, written out.

Paragraphs are the non-empty pieces between line feeds; one of over PIECE characters ends with the sentence that these end in. Null is
the empty text, which has none. Equal texts have equal fingerprints; so have texts with the same paragraphs in another order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import among, cut, if_small, let
from lodestone.operators.selection import indexed

#: The bits of a digest that check its others.
CHECK = (1 << 16) - 1
#: The smallest sketch has 1 << LEAST_BITS cells in a row. Rounds of peeling, of which a sketch of n digests needs about log n.
LEAST_BITS, ROUNDS = 3, 48
#: Sizes that are tried beyond the smallest; the first of them has as many cells as half of the digests, or more.
TRIES = 6
PIECE = 600
#: Ids that are laid side by side in one task to find the next document of each.
WIDTH = 128


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: 48 bits of a hash, and 16 that check them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}[^\n.!?]*[.!?]*"), 0)
    hashes = F.transform(found, lambda x: F.xxhash64(x).bitwiseAND(F.lit(~CHECK)))
    return F.array_distinct(F.transform(hashes, lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(CHECK)))))


def _cell(i: Column, c: Column, k: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), c.cast("int").alias("c"), k.alias("k"))


def _pure(x: Column) -> Column:
    """Whether a cell holds one digest."""
    return (F.abs(x["c"]) == 1) & (F.xxhash64(x["k"].bitwiseAND(F.lit(~CHECK))).bitwiseAND(F.lit(CHECK)) == x["k"].bitwiseAND(F.lit(CHECK)))


def _entries(digests: Column, count: int, level: Column) -> Column:
    """The three cells of each digest, counted `count` times, in a sketch of a level."""
    size = F.call_function("shiftleft", F.lit(1), F.lit(LEAST_BITS) + F.lit(2) * level)
    placed = F.transform(digests, lambda k: F.struct(k.alias("k"), F.xxhash64(k, level).alias("h")))
    cell = lambda x, j: _cell(size * j + F.shiftrightunsigned(x["h"], 21 * j).bitwiseAND((size - 1).cast("long")), F.lit(count), x["k"])
    return F.flatten(F.transform(placed, lambda x: F.array(*[cell(x, j) for j in range(3)])))


def _summed(cells: Column) -> Column:
    """Cells of one place made one, those with nothing left out: a sketch, in order of places."""
    nothing = _cell(F.lit(-1), F.lit(0), F.lit(0).cast("long"))

    def add(state: Column, x: Column) -> Column:
        held = state["held"]
        same = F.struct(state["done"].alias("done"), _cell(x["i"], held["c"] + x["c"], held["k"].bitwiseXOR(x["k"])).alias("held"))
        full = F.when((held["c"] != 0) | (held["k"] != 0), F.array_append(state["done"], held)).otherwise(state["done"])
        return F.when(held["i"] == x["i"], same).otherwise(F.struct(full.alias("done"), x.alias("held")))

    begin = F.struct(F.filter(F.array(nothing), lambda x: x["i"] >= 0).alias("done"), nothing.alias("held"))
    return F.aggregate(F.sort_array(cells), begin, add, lambda s: F.filter(F.array_append(s["done"], s["held"]), lambda x: (x["c"] != 0) | (x["k"] != 0)))


def sketch(digests: Column, level: Column) -> Column:
    """The cells (place i, count c, xor k of digests) of a set of digests that aren't empty; 3 << (LEAST_BITS + 2 * level) there are."""
    return _summed(_entries(digests, 1, level))


def difference(a: Column, b: Column) -> Column:
    """Sketch a less sketch b, of the same level."""
    return _summed(F.concat(a, F.transform(b, lambda x: _cell(x["i"], -x["c"], x["k"]))))


def peeled(cells: Column, level: Column) -> Column:
    """A struct of ok (all cells could be emptied), plus and minus, the digests of the first sketch alone and of the second.

    A check that is right by chance leaves cells behind that nothing empties, so it ends in a larger sketch and not in a wrong answer.
    """

    def state(cells: Column, plus: Column, minus: Column, going: Column) -> Column:
        return F.struct(cells.alias("cells"), plus.alias("plus"), minus.alias("minus"), going.alias("going"))

    def more(s: Column, pure: Column) -> Column:
        # a pure cell is empty once its digest is taken out, so only the others are summed again
        places = F.transform(pure, lambda x: x["i"])
        of = lambda sign: F.array_distinct(F.transform(F.filter(pure, lambda x: x["c"] == sign), lambda x: x["k"]))
        found = F.struct(of(1).alias("plus"), of(-1).alias("minus"), places.alias("places"))

        def without(f: Column) -> Column:
            taken = F.concat(_entries(f["plus"], -1, level), _entries(f["minus"], 1, level))
            left = F.filter(F.concat(F.filter(s["cells"], lambda x: ~_pure(x)), taken), lambda x: ~F.array_contains(f["places"], x["i"]))
            return state(_summed(left), F.concat(s["plus"], f["plus"]), F.concat(s["minus"], f["minus"]), F.lit(True))

        return F.when(F.size(pure) == 0, state(s["cells"], s["plus"], s["minus"], F.lit(False))).otherwise(let(found, without))

    step = lambda s, _: F.when(~s["going"], s).otherwise(let(F.filter(s["cells"], _pure), lambda pure: more(s, pure)))
    none = F.array().cast("array<bigint>")
    end = lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["plus"].alias("plus"), s["minus"].alias("minus"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, none, F.lit(True)), step, end)


def differing(a: Column, b: Column, a_least: Column, b_least: Column) -> Column:
    """The digests that only one of two sets has, as a struct of plus and minus, peeled from the difference of their sketches: the smallest (given) first, then larger ones until one peels. Null if none did.

    A smallest difference that has hardly an empty cell is known to fail, and isn't peeled.
    """
    total = F.greatest(F.size(a) + F.size(b), F.lit(1))
    first = F.greatest(F.lit(1), F.ceil((F.log2(total / 6) - LEAST_BITS) / 2)).cast("int")
    levels = F.concat(F.array(F.lit(0)), F.sequence(first, first + TRIES - 1))
    crowded = (3 << LEAST_BITS) - 2

    def attempt(s: Column, level: Column) -> Column:
        cells = F.when(level == 0, difference(a_least, b_least)).otherwise(_summed(F.concat(_entries(a, 1, level), _entries(b, -1, level))))
        return F.when(s["ok"], s).otherwise(let(cells, lambda x: F.when((level == 0) & (F.size(x) > crowded), s).otherwise(peeled(x, level))))

    none = F.array().cast("array<bigint>")
    failed = F.struct(F.lit(False).alias("ok"), none.alias("plus"), none.alias("minus"))
    return F.aggregate(levels, failed, attempt, lambda s: F.when(s["ok"], s))


def likeness(a: Column, b: Column, n_differing: Column) -> Column:
    """Shared digests among all of two sets; 1 for two empty ones."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - n_differing) / (n + n_differing))


def written(n: Column, cells: Column) -> Column:
    """A sketch as text: its number of digests, then place, count and digests of each cell that isn't empty, in hexadecimal digits."""
    one = lambda x: F.concat_ws(".", F.lower(F.hex(x["i"])), x["c"].cast("string"), F.lower(F.hex(x["k"])))
    return F.concat(n.cast("string"), F.lit(":"), F.array_join(F.transform(cells, one), ","))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null as empty) and next_text, that of the document with the next id; the last has the first. Rows of one id follow by text; those without an id have no next one (null).

    Texts are shuffled once, by ranges of WIDTH ids, within which each row sees the one after it. The first text of a range goes to the
    range before as well; which ranges there are is told from ids alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    there = rows.where("id IS NOT NULL").withColumn("range", F.floor(F.col("id") / WIDTH))
    heads = indexed(there.groupBy("range").agg(F.min("id").alias("id")), ["range"], "nth")
    heads = cut(heads)
    last = heads.agg(F.max("nth").alias("nth")).first()["nth"]
    before = heads.select((F.col("nth") + 1).alias("nth"), "range").withColumn("nth", F.when(F.col("nth") > F.lit(last), 0).otherwise(F.col("nth")))
    to = cut(heads.select("id", "nth").join(before.hint("merge"), "nth").select("id", "range"))
    copies = among(rows.where("id IS NOT NULL"), to.select("id"), "id", "text").join(if_small(to, 24), "id").select("id", "text", "range", F.lit(True).alias("copy"))
    order = Window.partitionBy("range").orderBy("copy", "id", F.xxhash64("text"), "text")
    met = there.withColumn("copy", F.lit(False)).select("id", "text", "range", "copy").unionByName(copies).withColumn("next_text", F.lead("text").over(order))
    out = met.where("not copy").select("id", "text", "next_text")
    return out.unionByName(rows.where("id IS NULL").select("id", "text", F.lit(None).cast("string").alias("next_text"))).withColumnRenamed("id", id_col)


def fingerprints(pairs: DataFrame, texts: list[str]) -> DataFrame:
    """`pairs` with, for each of its text columns t, t_digests, t_cells and t_fingerprint. An empty table gives none."""
    for t in texts:
        pairs = pairs.withColumn(f"{t}_digests", paragraphs(F.col(t)))
    for t in texts:
        pairs = pairs.withColumn(f"{t}_cells", sketch(F.col(f"{t}_digests"), F.lit(0)))
    return pairs.withColumns({f"{t}_fingerprint": written(F.size(f"{t}_digests"), F.col(f"{t}_cells")) for t in texts})


def compared(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Rows of `fingerprints` with name_only_a and name_only_b, the digests of paragraphs that only one of two texts has, and name, their likeness from 0 to 1.

    Where no sketch peeled, which TRIES sizes leave to all but impossible odds, the digests are compared as they are.
    """
    x, y = F.col(f"{a}_digests"), F.col(f"{b}_digests")
    rows = rows.withColumn("own_diff", differing(x, y, F.col(f"{a}_cells"), F.col(f"{b}_cells")))
    plus, minus = F.coalesce(F.col("own_diff.plus"), F.array_except(x, y)), F.coalesce(F.col("own_diff.minus"), F.array_except(y, x))
    rows = rows.withColumns({f"{name}_only_{a}": plus, f"{name}_only_{b}": minus}).drop("own_diff")
    return rows.withColumn(name, likeness(x, y, F.size(f"{name}_only_{a}") + F.size(f"{name}_only_{b}")))


def edited(text: Column, beside: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many first characters of another, or all that it has; null is empty."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(beside, F.lit("")), F.lit(1), half))


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of (doc_id, text): a text beside its edited form and the next document. Without a next document it is cut, and near_next is that to the empty text."""
    rows = with_next(docs.select("doc_id", "text")).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = fingerprints(rows, ["text", "edited_text", "next_text"])
    rows = compared(compared(rows, "text", "edited_text", "near_edited"), "text", "next_text", "near_next")
    sha = F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), sha, F.col("text_fingerprint").alias("fingerprint"), F.col("edited_text_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
