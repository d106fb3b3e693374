"""Functions of arrays of numbers and tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalised(v: Column, least: float = 1e-12) -> Column:
    """Of length one; a vector shorter than `least` is divided by that."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(l2_norm(v), F.lit(least)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def masked_mean(rows: Column, mask: Column, width: int) -> Column:
    """The mean of the rows (arrays of `width`) whose mask is 1; the count is at least 1e-9."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    weighted = F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda x: x.cast("double") * m))
    start = F.array_repeat(F.lit(0.0), width)
    return F.transform(F.aggregate(weighted, start, lambda s, r: F.zip_with(s, r, lambda x, y: x + y)), lambda x: x / n)


def masked_mean_by(df: DataFrame, by: list[str], vector: str, mask: Column, width: int, name: str = "mean") -> DataFrame:
    """by and the mean of the vectors (of `width` numbers) of each group whose mask is 1; summed in part where the rows are, a number a place."""
    n = F.greatest(F.sum(mask.cast("double")), F.lit(1e-9))
    return df.groupBy(*by).agg(F.array(*[F.sum(F.get(vector, i).cast("double") * mask) / n for i in range(width)]).alias(name))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """With temperature 0 the logits aren't divided."""
    t = temperature or 1.0
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x.cast("double") - top) / t))
    return F.transform(e, lambda x: x / total(e))


def logsumexp(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    return top + F.log(total(F.transform(logits, lambda x: F.exp(x.cast("double") - top))))


def rms_norm(v: Column, eps: float = 1e-5, position: int | None = None) -> Column:
    """Divided by the root of the mean square plus eps, and by the root of the position if there is one."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(v)
    scale = 1.0 if position is None else position**-0.5
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(mean + eps) * scale)


def raw_kurtosis(v: Column, least: float = 1e-8) -> Column:
    """mean(x^4) / mean(x^2)^2, not centred; the divisor is at least `least`."""
    moment = lambda k: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double"), F.lit(k))) / F.size(v)
    return moment(4) / F.greatest(F.pow(moment(2), F.lit(2)), F.lit(least))


def common_prefix(sequences: Column) -> Column:
    """How many leading elements all sequences share."""
    least = F.array_min(F.transform(sequences, F.size))
    first = F.get(sequences, 0)
    differ = lambda i: ~F.forall(sequences, lambda s: F.get(s, i).eqNullSafe(F.get(first, i)))
    at = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | differ(i))
    return F.array_min(at)


def common_suffix(sequences: Column) -> Column:
    return common_prefix(F.transform(sequences, F.reverse))


def left_crop(tokens: Column, most: int) -> Column:
    """The last `most` tokens."""
    return F.when(F.size(tokens) > most, F.slice(tokens, -most, most)).otherwise(tokens)


def right_pad(tokens: Column, size: Column, pad: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), size - F.size(tokens))))


def span_mean(values: Column, start: Column, end: Column) -> Column:
    """The mean of values[start:end], from 0."""
    part = F.slice(values, start + 1, end - start)
    return total(part) / F.size(part)


def first_least(values: Column) -> Column:
    """The index, from 0, of the least value; the first on ties."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def masked_labels(mask: Column, ignored: int = -100) -> Column:
    """The mask with `ignored` where it is 0."""
    return F.transform(mask, lambda m: F.when(m == 0, ignored).otherwise(m))


def checked_tokens(tokens: Column, limit: int = 1 << 16) -> Column:
    """The tokens; an error if one is `limit` or more."""
    over = F.exists(tokens, lambda t: t >= limit)
    return F.when(over, F.raise_error(F.lit(f"a token is {limit} or more")).cast("array<int>")).otherwise(tokens)


def merged_pair(ids: Column, left: Column, right: Column, new: Column) -> Column:
    """Each non-overlapping neighbouring (left, right), from the left, becomes `new`; ids are of int. In linear time, a batch of lists at once.

    Two pairs overlap only if left and right are equal; in a run of k such tokens the first of every two begins a pair, as
    far as a second follows.
    """
    return _merged_pair(ids.cast("array<int>"), left.cast("int"), right.cast("int"), new.cast("int"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _merged_pair(ids: pa.Array, left: pa.Array, right: pa.Array, new: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = ids.flatten()
    none = flat.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).copy()
    row = np.repeat(np.arange(size.size), size)
    a, b, c = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (left, right, new))
    asked = ~(left.is_null().to_numpy(zero_copy_only=False) | right.is_null().to_numpy(zero_copy_only=False))
    at = np.flatnonzero((value[:-1] == a[row[:-1]]) & (value[1:] == b[row[1:]]) & (row[:-1] == row[1:]) & ~none[:-1] & ~none[1:] & asked[row[:-1]])
    if at.size:  # places of equal tokens follow one another: of each run the first, third, ..
        starts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row[at], prepend=-1) != 0))
        at = at[(np.arange(at.size) - np.repeat(starts, np.diff(starts, append=at.size))) % 2 == 0]
    value[at] = c[row[at]]
    none[at] = new.is_null().to_numpy(zero_copy_only=False)[row[at]]
    keep = np.ones(value.size, bool)
    keep[at + 1] = False
    ends = np.cumsum(size - np.bincount(row[at], minlength=size.size)) if size.size else size
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(value[keep], pa.int32(), mask=none[keep]), mask=ids.is_null())
