"""A keyed permutation of 0 to n - 1 as a function of the index alone: a row's place in a shuffle without a sort, a list or a driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: The modulus of the round function, a prime whose squares fit a long.
PRIME = (1 << 31) - 1
#: Times that an index is walked on while it is n or more; each time is needed in less than half of the cases.
WALKS = 128


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round."""
    digest = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(2))
    words = [int.from_bytes(digest[4 * i : 4 * i + 4], "little") % PRIME for i in range(3 * ROUNDS)]
    return [tuple(words[3 * i : 3 * i + 3]) for i in range(ROUNDS)]


def _bits(n: int) -> tuple[int, int]:
    """Bits of the two halves; 1 << their sum is n or more, and less than 2 n unless n is small."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: Column, left: int, right: int, keys: list[tuple[int, int, int]]) -> Column:
    """One pass through the rounds. The halves change places, and so sizes, with each."""
    low, high = x.bitwiseAND(F.lit((1 << right) - 1)), F.shiftright(x, right)
    a, b = left, right
    for k1, k2, k3 in keys:
        u = (low + k1) % PRIME
        v = (u * u + k2) % PRIME
        f = ((v * v + k3) % PRIME).bitwiseAND(F.lit((1 << a) - 1))
        low, high, a, b = high.bitwiseXOR(f), low, b, a
    return F.shiftleft(high, right).bitwiseOR(low)


def shuffled_place(index: Column, n: int, seed: int) -> Column:
    """The place, from 0 to n - 1, of a row with an index from 0 to n - 1; every place is taken once. Null and other indexes have none. n is 1 << 60 at most."""
    left, right = _bits(n)
    keys = round_keys(seed)
    once = lambda x: _network(x, left, right, keys)
    inside = (index >= 0) & (index < n)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(index.cast("long")), lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return F.when(inside, walked)


def place_sql(rows: str, seed: int) -> str:
    """The same in SQL, for a recursive query: a table `walk` whose rows with round = 0 and y < n (and step > 0) are the places of the rows (idx, n)."""
    keys = round_keys(seed)
    of = lambda i: "[" + ", ".join(str(k[i]) for k in keys) + "][round + 1]"
    bits = "greatest(2, ceil(log2(n))::INTEGER)"
    return f"""walk AS (SELECT idx, n, {bits} // 2 AS a, {bits} - {bits} // 2 AS b, idx::BIGINT AS y, 0 AS round, 0 AS step, 0::BIGINT AS high, 0::BIGINT AS low FROM ({rows})
UNION ALL SELECT idx, n, a, b, CASE WHEN round = {ROUNDS - 1} THEN (low << b) | xor(high, f) ELSE y END, (round + 1) % {ROUNDS}, step + 1, low, xor(high, f)
FROM (SELECT *, ((v * v + {of(2)}) % {PRIME}) & ((1::BIGINT << CASE WHEN round % 2 = 0 THEN a ELSE b END) - 1) AS f
FROM (SELECT *, (u * u + {of(1)}) % {PRIME} AS v FROM (SELECT *, (low + {of(0)}) % {PRIME} AS u
FROM (SELECT idx, n, a, b, y, round, step, CASE WHEN round = 0 THEN y >> b ELSE high END AS high, CASE WHEN round = 0 THEN y & ((1::BIGINT << b) - 1) ELSE low END AS low
FROM walk WHERE NOT (round = 0 AND step > 0 AND y < n))))))"""
