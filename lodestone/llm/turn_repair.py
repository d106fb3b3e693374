"""Conversation structure repair: the cheapest edits that give each conversation roles of the form (system? (user assistant)+)?.

A dynamic program over turns, in time-major numpy tensors. Conversations are bucketed by length; for all conversations of a
bucket at once, the cost of what follows is updated turn by turn from the back and stored, and the edits are traced
forwards through the stored costs, both vectorised. States are the roles that the repaired conversation may end with so far:
nothing, system, user, assistant. Every (turn, state) has at most one successor for each edit, so taking the least letter
that keeps to the least cost gives the least of the cheapest audits.

A conversation of over LONG_ROWS turns or LONG_BYTES of text isn't collected: its turns are dealt by ranges of its order and cut
into pieces; the same program gives the costs of a piece between all states, pieces are chained by these (4 x 4 numbers a
piece), traced from each state at once, and chained again from the front. Turns that repeat are counted before they are dealt.

Order of turns: turn (nulls first), then role and hashes of role and text, so repeats stand side by side. Null roles and texts are taken as
one space, null conversations as one conversation. Roles count by their first letter; a role that begins with none of s, u, a
(or is empty) is never kept as it is. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, WORD, cut, hot_join, if_small
from lodestone.operators.selection import in_ranges

DELETE, INSERT, RETYPE, CUT_OFF = 4, 3, 3, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = ["", "system", "user", "assistant"]
#: The state that a user or an assistant turn leads to from each state.
ADVANCE = np.array([2, 2, 3, 2])
#: What the end of a conversation costs from each state: the turns to be inserted.
AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
FAR, PAD = 1 << 40, 255
LONG_ROWS, LONG_BYTES = 4096, 8 << 20
#: Turns and bytes of a piece of a long conversation, copies of one turn in a row, and cells of a tensor.
PIECE_ROWS, PIECE_BYTES, COPIES, CELLS = 4096, 4 << 20, 1024, 1 << 18

_TURNS = "repaired array<struct<role:string,text:string>>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long"


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs (4, n) with turns inserted first where that is cheaper; two at most ever are."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[ADVANCE])
    return cost


def _staying(code: np.ndarray) -> np.ndarray:
    """What it costs a turn not to be deleted."""
    return np.array([0, FAR, FAR, CUT_OFF], np.int64)[code >> 2 & 3]


def _keepable(role: np.ndarray) -> np.ndarray:
    """(4, n): whether a turn of this role can follow each state."""
    allowed = ADVANCE[:, None] == role[None, :]
    allowed[0] |= role == 1
    return allowed


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(turns + 1, 4, n): the least cost of what follows before each turn, in each state. codes (turns, n): role + 4 * fault, or PAD; ends (4, n)."""
    costs = np.empty((len(codes) + 1, *ends.shape), np.int64)
    costs[-1], every = ends, np.arange(ends.shape[1])
    for t in range(len(codes) - 1, -1, -1):
        after, role, stay = costs[t + 1], codes[t] & 3, _staying(codes[t])
        here = np.minimum(DELETE + after, RETYPE + stay + after[ADVANCE])
        here = np.where(_keepable(role), np.minimum(here, stay + after[role, every]), here)
        costs[t] = np.where(codes[t] == PAD, after, _inserted(here))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and states after them, (turns + 1, 3, n) each: two inserts and the edit of the turn, 0 for none; and the states at the end. last: nothing follows, so turns may be inserted at the end."""
    turns, n = codes.shape
    letters, states = np.zeros((turns + 1, 3, n), np.uint8), np.zeros((turns + 1, 3, n), np.uint8)
    state, every = start.copy(), np.arange(n)
    for t in range(turns + 1):
        now = costs[t]
        code = codes[t] if t < turns else np.full(n, PAD, np.uint8)
        there = code != PAD
        following = costs[min(t + 1, turns)]
        may = there if t < turns else last
        for k in range(2):
            deleted = there & (DELETE + following[state, every] == now[state, every])
            insert = may & ~deleted & (INSERT + now[ADVANCE[state], every] == now[state, every])
            state = np.where(insert, ADVANCE[state], state)
            letters[t, k], states[t, k] = insert * ord("I"), state
        if t == turns:
            break
        role, stay, best = code & 3, _staying(code), now[state, every]
        deleted = DELETE + following[state, every] == best
        kept = _keepable(role)[state, every] & (stay + following[role, every] == best) & ~deleted
        state = np.where(~there | deleted, state, np.where(kept, role, ADVANCE[state]))
        letters[t, 2] = np.where(there, np.where(deleted, ord("D"), np.where(kept, ord("K"), ord("R"))), 0)
        states[t, 2] = state
    return letters, states, state


def _padded(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(turns, n): the codes of n conversations, filled up with PAD."""
    t = np.arange(max(1, sizes.max(initial=0)))[:, None]
    return np.where(t < sizes, codes[np.minimum(starts + t, max(0, len(codes) - 1))] if len(codes) else PAD, PAD).astype(np.uint8)


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of conversations of about one length, as many as a tensor holds."""
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(level):
        found, most = np.flatnonzero(level == k), max(1, CELLS >> int(k))
        for a in range(0, len(found), most):
            yield found[a : a + most]


def _lists(letters: np.ndarray, states: np.ndarray, starts: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The audits, and the repaired turns as lists of (role, text), of n conversations whose turns begin at `starts` of the arrays."""
    turns, _, n = letters.shape
    by = letters.transpose(2, 0, 1).reshape(n, -1)
    where = by != 0
    flat, ends = by[where].tobytes().decode(), np.concatenate([[0], np.cumsum(where.sum(1))])
    audits = pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    left = where & (by != ord("D"))
    row = (starts[:, None] + np.repeat(np.arange(turns), 3)[None, :])[left]
    letter, state = by[left], states.transpose(2, 0, 1).reshape(n, -1)[left].astype(np.int64)
    role = pa.concat_arrays([roles, pa.array(NAMES)]).take(pa.array(np.where(letter == ord("K"), row, len(roles) + state)))
    text = pa.concat_arrays([texts, pa.array([""])]).take(pa.array(np.where(letter == ord("I"), len(texts), row)))
    offsets = pa.array(np.concatenate([[0], np.cumsum(left.sum(1))]), pa.int32())
    return audits, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([role, text], ["role", "text"]))


def _illegal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return ~(((before == 1) & (after == 2)) | ((before == 2) & (after == 3)) | ((before == 3) & (after == 2)))


def _counts(codes: np.ndarray, turn: np.ndarray, known: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The columns of _COUNTS of conversations, or pieces, that begin at `starts`; all have turns. Turn numbers ascend, unknown ones first."""
    fault, first = codes >> 2, np.zeros(len(codes), bool)
    first[starts] = True
    total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    illegal = ~first & _illegal(np.roll(codes & 3, 1), codes & 3)
    new = known & (first | ~np.roll(known, 1) | (turn != np.roll(turn, 1)))
    low = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), starts)
    high = np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), starts)
    return [total(fault == BLANK), total(fault == DUPLICATE), total(fault == TRUNCATED), total(illegal), total(new), low, high]


def _repeated(conv: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an earlier row of the same conversation has the same two hashes."""
    order = np.lexsort((b, a, conv))
    c, x, y = conv[order], a[order], b[order]
    out = np.zeros(len(conv), bool)
    out[order[1:]] = (c[1:] == c[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return out


def _column(batch: pa.Table, name: str, fill=None) -> np.ndarray:
    column = batch.column(name)
    return (column if fill is None else column.fill_null(fill)).to_numpy()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations of a sorted partition, each of which is whole in it; the last one of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        conv = table.column("conv_id").chunk(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        fault = _column(table, "fault")
        again = _repeated(conv, _column(table, "k1"), _column(table, "k2"))
        codes = (_column(table, "kind") + 4 * np.where(fault == BLANK, BLANK, np.where(again, DUPLICATE, fault))).astype(np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        sizes = np.diff(np.append(starts, len(conv)))
        counts = _counts(codes, _column(table, "turn", 0), ~table.column("turn").is_null().to_numpy(), starts)
        roles, texts, ids = (table.column(c).chunk(0) for c in ("role", "text", "conv_id"))
        for some in _buckets(sizes):
            at, n = starts[some], len(some)
            block = _padded(codes, at, sizes[some])
            costs = backward(block, np.repeat(AT_END[:, None], n, 1))
            letters, states, _ = trace(block, costs, np.zeros(n, np.int64), np.ones(n, bool))
            audits, turns = _lists(letters, states, at, roles, texts)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), *[pa.array(c[some], pa.int64()) for c in counts], pa.array(costs[0, 0], pa.int64()), audits, turns],
                ["conv_id", *[c.split()[0] for c in _COUNTS.split(", ")], "cost", "audit", "repaired"],
            )

    for batch in batches:
        if batch.num_rows == 0:
            continue
        conv = batch.column(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        cut_at = int(np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))[-1])
        if waiting and cut_at == 0 and batch.column(0)[0].as_py() == waiting[-1].column(0)[0].as_py():
            waiting.append(batch)
            continue
        if waiting or cut_at:
            yield from solve(pa.Table.from_batches([*waiting, batch.slice(0, cut_at)]))
        waiting = [batch.slice(cut_at)]
    if waiting:
        yield from solve(pa.Table.from_batches(waiting))


def _prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, k1 and k2 (hashes of role and text), kind (of the role) and fault (blank, truncated or none)."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), TRUNCATED).otherwise(SOUND)
    return rows.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "role").alias("k2"), kind.alias("kind"), fault.alias("fault"))


_ORDER = ["conv_id", "turn", "role", "k1", "k2"]


def repair(turns: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text) the repaired conversations, in pieces; all but long ones are of one piece.

    conv_id, part and piece (their order), single (there is no other), blank, duplicate, truncated and illegal (faults, each row's
    first, and neighbours whose roles can't follow one another), n_turns, first_turn and last_turn (known turn numbers), cost,
    audit (the edits' initials) and repaired (role and text of the turns that are left).
    """
    rows, kind = _prepared(turns), turns.schema["conv_id"].dataType.simpleString()
    sizes = turns.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long_ids = cut(sizes.where((F.col("n") > LONG_ROWS) | (F.col("b") > LONG_BYTES)).select("long_id"))
    some_long = not long_ids.isEmpty()
    here = F.col("conv_id").eqNullSafe(F.col("long_id"))
    whole = rows.join(if_small(long_ids, 80), here, "left_anti") if some_long else rows
    whole = whole.repartition("conv_id").sortWithinPartitions(*_ORDER)
    schema = f"conv_id {kind}, {_COUNTS}, cost long, audit string, {_TURNS}"
    found = whole.mapInArrow(_whole, schema)
    pieces = found.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("piece"), F.lit(True).alias("single"), *found.columns[1:])
    return pieces.unionByName(_long(rows.join(if_small(long_ids, 80), here, "left_semi"), kind)) if some_long else pieces


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a piece of the sorted turns of a partition: its codes, a byte a turn, its counts, its costs between all states, and its roles and texts."""
    number = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        conv = table.column("conv_id").chunk(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        copies, size = _column(table, "copies").astype(np.int64), _column(table, "size", 0)
        edges, rows, held = [0], 0, 0
        for i in range(batch.num_rows):
            if i and (conv[i] != conv[i - 1] or rows + copies[i] > PIECE_ROWS or held + size[i] > PIECE_BYTES):
                edges.append(i)
                rows = held = 0
            rows, held = rows + copies[i], held + size[i]
        code = (_column(table, "kind") + 4 * _column(table, "fault")).astype(np.uint8)
        other = (_column(table, "kind") + 4 * _column(table, "again")).astype(np.uint8)
        turn, known = _column(table, "turn", 0), ~table.column("turn").is_null().to_numpy()
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            places = np.repeat(np.arange(a, b), copies[a:b])
            fresh = np.concatenate([[True], places[1:] != places[:-1]])
            codes = np.where(fresh, code[places], other[places]).astype(np.uint8)
            unit = np.where(np.eye(4, dtype=bool), 0, FAR)  # the piece ends in one state
            matrix = backward(np.repeat(codes[:, None], 4, 1), unit)[0]
            counts = [int(c[0]) for c in _counts(codes, turn[places], known[places], np.zeros(1, np.int64))]
            part = table.slice(a, b - a)
            row = {
                "conv_id": part.column("conv_id")[0].as_py(), "part": part.column("__part")[0].as_py(), "piece": number, "codes": codes.tobytes(),
                "places": (places - a).astype("<i4").tobytes(), "matrix": np.minimum(matrix, FAR).reshape(-1).tolist(), "counts": counts,
                "known": bool(known[places[0]]), "head": int(turn[places[0]]), "turns": [{"role": r, "text": t} for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)],
            }
            number += 1
            yield pa.RecordBatch.from_pylist([row], _pieces_schema(table.schema.field("conv_id").type))


def _pieces_schema(kind: pa.DataType) -> pa.Schema:
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    longs = pa.list_(pa.int64())
    return pa.schema([("conv_id", kind), ("part", pa.int64()), ("piece", pa.int32()), ("codes", pa.binary()), ("places", pa.binary()), ("matrix", longs), ("counts", longs), ("known", pa.bool_()), ("head", pa.int64()), ("turns", turns)])


def _chained_back(chain: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of one conversation: what follows each costs from each state; and their counts with what neighbours share put right."""
    chain = chain.sort_values(["part", "piece"]).reset_index(drop=True)
    ends, after = [], AT_END
    for matrix in chain["matrix"][::-1]:
        ends.append(after.tolist())
        after = (np.array(matrix).reshape(4, 4) + after[None, :]).min(1)
    counts = [list(c) for c in chain["counts"]]
    for i in range(1, len(chain)):
        before, codes = chain["codes"][i - 1], chain["codes"][i]
        counts[i][3] += int(_illegal(np.array(before[-1] & 3), np.array(codes[0] & 3)))
        counts[i][4] -= int(chain["known"][i] and counts[i - 1][6] == chain["head"][i])
    last = [False] * (len(chain) - 1) + [True]
    return pd.DataFrame({"part": chain["part"], "piece": chain["piece"], "ends": ends[::-1], "counts": counts, "last": last, "cost": [int(after[0]) if i == 0 else 0 for i in range(len(chain))]})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each piece, from each state at its start."""
    for batch in batches:
        out = []
        for codes, ends, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "ends", "last")), strict=True):
            block = np.repeat(np.frombuffer(codes, np.uint8)[:, None], 4, 1)
            costs = backward(block, np.repeat(np.array(ends)[:, None], 4, 1))
            out.append(trace(block, costs, np.arange(4), np.full(4, last))[2].tolist())
        keep = [batch.column(c) for c in ("conv_id", "part", "piece")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.int64()))], ["conv_id", "part", "piece", "leads"])


def _chained_on(chain: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of one conversation: the state at the start of each."""
    chain, state, starts = chain.sort_values(["part", "piece"]).reset_index(drop=True), 0, []
    for leads in chain["leads"]:
        starts.append(state)
        state = int(leads[state])
    return pd.DataFrame({"part": chain["part"], "piece": chain["piece"], "start": starts})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired turns of each piece."""
    for batch in batches:
        audits, lists = [], []
        for codes, places, ends, last, start, turns in zip(*(batch.column(c).to_pylist() for c in ("codes", "places", "ends", "last", "start", "turns")), strict=True):
            block, rows = np.frombuffer(codes, np.uint8)[:, None], pa.array(np.frombuffer(places, "<i4"))
            letters, states, _ = trace(block, backward(block, np.array(ends)[:, None]), np.array([start]), np.array([last]))
            roles, texts = (pa.array([x[c] for x in turns], pa.string()).take(rows) for c in ("role", "text"))
            audit, repaired = _lists(letters, states, np.zeros(1, np.int64), roles, texts)
            audits += audit.to_pylist()
            lists += repaired.to_pylist()
        keep = [batch.column(c) for c in ("conv_id", "part", "piece", "counts", "cost")]
        turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*keep, pa.array(audits, pa.string()), pa.array(lists, turns)], ["conv_id", "part", "piece", "counts", "cost", "audit", "repaired"])


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """The pieces of long conversations, as `repair` gives them."""
    key = ["conv_id", "part", "piece"]
    some = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    same = cut(some.withColumn("conv_key", F.xxhash64("conv_id")).withColumn("at", at))
    firsts = cut(same.groupBy("conv_key", "k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("times")))
    marked = hot_join(same, firsts, ["conv_key", "k1", "k2"], F.xxhash64("turn"), "inner", "times")
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    marked = marked.withColumn("again", again).withColumn("fault", F.when(F.col("at") > F.col("first"), F.col("again")).otherwise(F.col("fault")))
    marked = marked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    later = F.col("block") > 0  # blocks of copies; the first has the turn that may stay
    dealt = marked.select(*_ORDER, "block", "kind", F.when(later, F.col("again")).otherwise(F.col("fault")).alias("fault"), "again", F.least(F.col("copies") - F.col("block"), F.lit(COPIES)).alias("copies"), F.when(later, "").otherwise(F.col("text")).alias("text"))
    ranged = in_ranges(dealt.withColumn("size", F.octet_length("text")), [*_ORDER, "block"])
    columns = "part long, piece int, codes binary, places binary, matrix array<long>, counts array<long>, known boolean, head long, turns array<struct<role:string,text:string>>"
    packed = cut(ranged.mapInArrow(_packed, f"conv_id {kind}, {columns}"))
    slim = packed.drop("turns", "places")
    back = slim.groupBy("conv_id").applyInPandas(_chained_back, "part long, piece int, ends array<long>, counts array<long>, last boolean, cost long")
    back = cut(slim.drop("counts").join(back, ["part", "piece"]))
    leads = back.select(*key, "codes", "ends", "last").mapInArrow(_traced, f"conv_id {kind}, part long, piece int, leads array<long>")
    starts = cut(leads.groupBy("conv_id").applyInPandas(_chained_on, "part long, piece int, start long"))
    ready = packed.select(*key, "places", "turns").join(back.select("part", "piece", "codes", "ends", "last", "counts", "cost").join(starts, ["part", "piece"]), ["part", "piece"])
    done = ready.select(*key, "codes", "places", "ends", "last", "start", "turns", "counts", "cost").mapInArrow(_edited, f"conv_id {kind}, part long, piece int, counts array<long>, cost long, audit string, {_TURNS}")
    counts = [F.col("counts")[i].alias(c.split()[0]) for i, c in enumerate(_COUNTS.split(", "))]
    return done.select("conv_id", F.col("part").cast("int").alias("part"), "piece", F.lit(False).alias("single"), *counts, "cost", "audit", "repaired")


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv_id, part, piece, place (within the piece), role and text."""
    return pieces.select("conv_id", "part", "piece", F.posexplode("repaired").alias("place", "t")).select("conv_id", "part", "piece", "place", "t.role", "t.text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and SHA-256 of the sorted pieces of a partition, one after the other; a conversation isn't held."""
    now, digest, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "sha"])
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(text.encode())
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "sha"])


def conversations(pieces: DataFrame, kind: str) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of `role:text` lines).

    SHA-256 runs along a text, so that of a long conversation is made by one task, piece by piece in order, a row a piece.
    """
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = lambda first, last, n: F.when(n > 0, last - first + 1 - n).otherwise(0).alias("gaps")
    single = pieces.where("single").select("conv_id", gaps(F.col("first_turn"), F.col("last_turn"), F.col("n_turns")), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    parts = cut(pieces.where("not single"))
    if parts.isEmpty():
        return single
    total = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "audit"))), lambda x: x["audit"]), "").alias("audit")
    several = parts.groupBy("conv_id").agg(gaps(F.min("first_turn"), F.max("last_turn"), F.sum("n_turns")), *total, audit)
    lined = parts.where(F.size("repaired") > 0).select("conv_id", text.alias("text"), "part", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    hashes = lined.select("conv_id", "text").mapInArrow(_hashed, f"conv_id {kind}, sha string").withColumnRenamed("conv_id", "h_id")
    nothing = hashlib.sha256().hexdigest()
    met = several.join(hashes, F.col("conv_id").eqNullSafe(F.col("h_id")), "left").withColumn("repaired_sha256", F.coalesce("sha", F.lit(nothing)))
    return single.unionByName(met.select(*single.columns))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of `conv_id:turn` mod 20: 0 drops the turn, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 gives it to the user. Nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text: Column = F.when(h == 1, "").when(h == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(h == 0, 0).when(h == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_digest(turns: DataFrame) -> DataFrame:
    """A row for every conversation of `turns`: what `conversations` says of it after `damaged` and `repair`; zeros, no edits and the empty text's hash if no turn was left."""
    found = conversations(repair(damaged(turns)), turns.schema["conv_id"].dataType.simpleString())
    ids = turns.select(F.col("conv_id").alias("own_id")).distinct()
    met = ids.join(found, F.col("own_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("own_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
