"""Conversation repair against a plain search over edit sequences, and a plain reading of the whole contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm import turn_repair as T
from tests.conftest import SF

KIND = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, turns) by a shortest-path search over (rows read, roles written), with the audit in the priority. rows: (role, text, fault)."""
    def legal(roles, whole):
        return re.fullmatch(r"(s?(ua)+)?" if whole else r"s?(ua)*u?", roles) is not None

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, tail, turns = heappop(heap)
        if i == len(rows) and legal(tail, True):
            return cost, audit, list(turns)
        state = (i, tail[-1:])
        if state in seen:
            continue
        seen.add(state)

        def push(more, letter, j, role, text, cost=cost, audit=audit, tail=tail, turns=turns):
            if role is None:
                heappush(heap, (cost + more, audit + letter, j, tail, turns))
            elif role[:1] and legal(tail + role[:1], False):
                heappush(heap, (cost + more, audit + letter, j, tail + role[:1], (*turns, (role, text))))

        for role in ("user", "assistant"):
            push(3, "I", i, role, "")
        if i < len(rows):
            role, text, fault = rows[i]
            push(4, "D", i + 1, None, None)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                push(more, "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    push(3 + more, "R", i + 1, other, text)
    raise AssertionError


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(table):
    """The rows of the query, from (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        role, text, group = " " if role is None else role, " " if text is None else text, groups[conv]
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        group += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        found = faults([r[1:] for r in group])
        known = [t for t, _, _ in group if t is not None]
        cost, audit, turns = cheapest([(r, x, f) for (_, r, x), f in zip(group, found, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(df):
    columns = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def odd_table(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Fine.", "Fine!", "cut off", "", " \n", "Yes?", "a. b", None, "é!", "So. \x0b\n", "x" * 3000 + ".", "no "]
    for conv in range(n):
        for turn in range(rng.randrange(1, 14)):
            if rng.random() < 0.9:
                rows.append((conv if conv % 17 else None, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"]), rng.choice(texts)))
    if seed:  # one row a conversation has no turn at most, so that the order is told
        seen, left = set(), []
        for r in rows:
            if (r[0], r[1]) not in seen:
                left.append(r)
            seen.add((r[0], r[1]))
        rows = left
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = odd_table(seed, 150)
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{KIND}, copies int, fault string").repartition(5)
    assert got(T.repaired_digest(table)) == plain(rows)


@pytest.mark.parametrize("piece_rows, copies", [(1, 1), (3, 2), (50, 1024)])
def test_long_conversations_in_pieces(spark, monkeypatch, piece_rows, copies):
    monkeypatch.setattr(T, "LONG_ROWS", 4)
    monkeypatch.setattr(T, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(T, "COPIES", copies)
    rows = odd_table(3, 60)
    table = spark.createDataFrame(rows, KIND).repartition(3)
    assert got(T.repaired_digest(table)) == plain(rows)


def test_copies_of_turns(spark, monkeypatch):
    rows = [(1, 1, "user", "Same.")] * 40 + [(1, 2, "assistant", "Good.")] * 3 + [(1, t, "user", "Same.") for t in range(3, 30)] + [(2, None, "user", "  ")] * 5
    whole = got(T.conversations(T.repair(spark.createDataFrame(rows, KIND)), "bigint"))
    by = {r[0]: r for r in whole}
    assert by[1][3] == 39 + 2 + 27 and by[1][7].count("D") == 68 and by[2][1:7] == (0, 5, 0, 0, 4, 20) and by[2][8] == hashlib.sha256().hexdigest()
    monkeypatch.setattr(T, "LONG_ROWS", 3)
    monkeypatch.setattr(T, "COPIES", 7)
    monkeypatch.setattr(T, "PIECE_ROWS", 16)
    assert got(T.conversations(T.repair(spark.createDataFrame(rows, KIND)), "bigint")) == whole


def test_empty_table_and_strings_as_ids(spark):
    assert got(T.repaired_digest(spark.createDataFrame([], KIND))) == []
    table = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "assistant", "Ho.")], KIND.replace("conv_id long", "conv_id string"))
    found = {r["conv_id"]: r["audit"] for r in T.repair(table).collect()}
    assert found == {"a": "KI", "b": "IK"}
    turns = T.repaired_turns(T.repair(table)).where("conv_id = 'b'").orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", ""), ("assistant", "Ho.")]


def test_query_against_plain_reading(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_turn_repair(spark, SF)) == plain(rows)
    assert queries.op11_turn_repair(spark, SF).where(F.col("cost").isNull()).count() == 0
