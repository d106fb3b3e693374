"""Small tables with nulls, empty and long texts, repeats and columns with names that operators use themselves."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, source string, id long, n int, k1 string, text_hash string, host string, comp long, kept string, line string"
WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge") for b in ("na", "lo", "ri", "su", "té", "x1")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]))
        out.append("\n" if i % 9 == 8 else " ")
    return "".join(out).strip()


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def corpus(seed: int = 3) -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    shared = prose(rng, 60)
    texts: list[str | None] = [None, "", "   \n", "one", "one two", "One two", *base]
    texts += [base[0]] * 6
    texts += [edited(rng, base[k], s) for k in range(5) for s in (0.01, 0.03, 0.06, 0.1, 0.3)]
    texts += [edited(rng, base[7], 0.08) for _ in range(20)]
    texts += [f"{prose(rng, 15)}\n{shared}\n{prose(rng, 15)}" for _ in range(6)]
    texts += ["to " * 400, "to " * 401, prose(rng, 3000), "x" * 5000]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    full = [(d, t, s, 7, 1, "k", "h", "w", 5, "kept", "line") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)
