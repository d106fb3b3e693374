"""What several operators of this subpackage share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ensure_checkpoint_dir, remove_table, shared_table, ship  # noqa: F401

#: The white space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder: lineage ends there and lost executors don't matter."""
    ensure_checkpoint_dir(df.sparkSession)
    ship(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`, a function of a column."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns of these names, which the caller adds; all others stay, whatever they are called."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


@dataclass(frozen=True)
class Renamed:
    """A table whose columns are called as no column of another table is; a column of it by its former name."""

    df: DataFrame
    names: dict[str, str]

    def __getitem__(self, name: str) -> Column:
        return F.col(self.names[name])


def renamed(df: DataFrame, beside: DataFrame) -> Renamed:
    """`df`, to be joined with `beside` without a clash of names (which Spark compares without regard to case)."""
    mark, taken = "own_", {c.lower() for c in beside.columns}
    while any(f"{mark}{c}".lower() in taken for c in df.columns):
        mark += "_"
    return Renamed(df.toDF(*[f"{mark}{c}" for c in df.columns]), {c: f"{mark}{c}" for c in df.columns})


def fitted(df: DataFrame, rows: int, per_part: int = 50_000) -> DataFrame:
    """`df` in no more partitions than `rows` need, so that small tables don't cost a file for each task of each shuffle."""
    parts = max(1, -(-rows // per_part))
    return df.coalesce(parts)


def cut_fitted(df: DataFrame, per_part: int = 50_000) -> DataFrame:
    """`cut`, in no more partitions than its rows need."""
    out = cut(df)
    return fitted(out, out.count(), per_part)


def salted_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], spread: Column, how: str, salts: int = 16) -> DataFrame:
    """`rows` joined with `keyed`, which has each key once, by `key`; rows of one key are dealt by `spread` to `salts` tasks, `keyed` is there for each."""
    key = [key] if isinstance(key, str) else key
    dealt = rows.withColumn("own_salt", F.pmod(F.xxhash64(spread, F.lit(11)), F.lit(salts)).cast("int"))
    several = keyed.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(several, [*key, "own_salt"], how).drop("own_salt")


def hot_join(rows: DataFrame, keyed: DataFrame, key: list[str], spread: Column, how: str, n: str) -> DataFrame:
    """`rows` joined with `keyed` (materialised), which has each key once and in `n` the number of its rows.

    Rows of a key that has more than a quarter of a task's even share are dealt by `spread` to several tasks, and `keyed` has that key once
    for each; these keys, which are broadcast, are at most four a task. All other keys are joined as they are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1000, (keyed.agg(F.sum(n)).first()[0] or 0) // (4 * parts))
    tasks = F.ceil(F.col(n) / share).cast("int")
    hot = keyed.where(F.col(n) > share).select(*key, tasks.alias("own_tasks"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("own_salt", F.coalesce(F.pmod(F.xxhash64(spread, F.lit(11)), F.col("own_tasks")).cast("int"), F.lit(0))).drop("own_tasks")
    several = keyed.withColumn("own_salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt.join(several, [*key, "own_salt"], how).drop("own_salt")


#: Bits of the bitmaps of `sieve`, and of one row of them.
SIEVE_BITS, ROW_BITS = 1 << 27, 1 << 15


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of hashes of `key`, a long: rows own_row and own_bits, SIEVE_BITS / 8 bytes at most (16 MB) whatever the number of keys, so it can be broadcast."""
    place = F.pmod(F.xxhash64(key, F.lit(23)), F.lit(SIEVE_BITS))
    return keys.select(F.floor(place / ROW_BITS).alias("own_row"), (place % ROW_BITS).alias("p")).groupBy("own_row").agg(F.bitmap_construct_agg("p").alias("own_bits"))


def sifted(rows: DataFrame, bitmap: DataFrame, key: str, keep_others: bool = False) -> DataFrame:
    """Of `rows`, all whose key is in the bitmap and few others; with `keep_others` all rows, with own_hit telling which. No row moves."""
    place = F.pmod(F.xxhash64(key, F.lit(23)), F.lit(SIEVE_BITS))
    p = F.col("own_place") % ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("own_bits"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (p % 8).cast("int")) == 1, F.lit(False))
    found = rows.withColumn("own_place", place).withColumn("own_row", F.floor(F.col("own_place") / ROW_BITS))
    found = found.join(F.broadcast(bitmap), "own_row", "left" if keep_others else "inner").withColumn("own_hit", hit)
    return found.drop("own_row", "own_place", "own_bits") if keep_others else found.where("own_hit").drop("own_row", "own_place", "own_bits", "own_hit")


def among(rows: DataFrame, keys: DataFrame, key: str, spread: str, row_bytes: int = 8) -> DataFrame:
    """The rows whose key (a long) is among `keys` (materialised; once each). Keys that are few are broadcast; else a bitmap of them is, and only rows that it lets through are shuffled, those of one key to several tasks by `spread`."""
    if keys.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), key, "left_semi")
    return salted_join(sifted(rows, cut(sieve(keys, key)), key), keys, key, F.col(spread), "left_semi")


#: The most bytes that are broadcast.
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted rows, at `row_bytes` each, stay under `most`; else as it is, to be joined by shuffle. `df` should be materialised."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
