"""Cheapest repair of conversations by an auction over their edit lattice.

A node of the lattice is (row, state): before row k, with the turns written so far in one of the states of GRAMMAR. Arcs are
the edits: keep a row in its role, rerole it to the role that the state asks for, delete it, or insert an empty turn. Costs
are integers. The auction keeps a price for every node and a path from an origin. While the price of the path's last node is
below its best arc (cost plus price beyond), the price is raised to it and the path contracts; else the path extends along
that arc, the one whose letter is least in ASCII among equals. Prices only rise and never pass the true distance, so an arc
that was not tight when the path extended never becomes tight: a path that arrives has exact prices at all its nodes, and the
arcs that it took spell the ASCII-least of the cheapest edits. Origins are taken from the back in steps of STEP rows, each
step begins with lower bounds on top of the exact prices behind it, and paths stop at nodes of exact price: this keeps the
work in proportion to the rows.

Rows are range-partitioned and sorted by conversation, turn, role and text, so that a conversation of any size is spread over
tasks. A conversation that lies within one Arrow batch is solved there. One that crosses batches is a chain of pieces: each
piece gives its costs from state to state, a chain of 16 numbers a piece gives the prices at the borders, each piece is then
solved for these prices from every state, and the chain picks the states. The repaired text is hashed as a stream.

Defined cases: null roles and texts are one space; null turns come first; rows of equal turn are ordered by role, then text;
repeated rows are duplicates of the first; a role that begins with none of s, u and a (an empty one included) can't be kept;
a null conversation id is one conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, stored

# fixed values of the definition
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})          # turns that each state allows
FINAL = (START, ASSISTANT)
ASKED = ("u", "u", "a", "u")                                                              # role of a reroled or inserted turn
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
LEGAL_PAIRS = ("su", "ua", "au")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FAULTS = ("", "truncated", "duplicate", "blank")                                          # a row's code: 4 * fault + initial
STEP = 8
FAR = 1 << 60
MEMO = 100_000


class Lattice:
    """Auction over the rows of one piece. `beyond` has the price of each state behind the last row; `inserts` tells whether
    turns may be inserted there. Only `states` are entered."""

    def __init__(self, codes: bytes, beyond: list[int], inserts: bool, states: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)):
        self.codes, self.inserts, self.states = codes, inserts, frozenset(states)
        n = len(codes)
        self.last = 4 * n
        self.price = [0] * self.last + ([0] * 4 if inserts else list(beyond))
        self.chosen: list[tuple[str, int] | None] = [None] * (self.last + 4)
        self.exact = [False] * self.last + [not inserts] * 4
        if inserts:
            for state in self.states:
                self.auction(self.last + state)
        high = n
        while high:
            low = (high - 1) // STEP * STEP
            least = min(self.price[4 * high + s] for s in self.states)
            for k in range(high - 1, low - 1, -1):                # lower bounds to begin with: the least that each row costs
                fault, initial = divmod(codes[k], 4)
                least += DELETE if fault >= 2 or (fault and initial == 3) else TRUNCATED if fault else REROLE if initial == 3 else 0
                self.price[4 * k:4 * k + 4] = [least] * 4
            if low:
                for state in self.states:
                    self.auction(4 * low + state)
            high = low

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, node) in the order of the letters."""
        at, state = divmod(node, 4)
        out, inner = [], at < len(self.codes)
        asked = GRAMMAR[state][ASKED[state]]
        if inner:
            fault, initial = divmod(self.codes[at], 4)
            out.append(("D", DELETE, node + 4))
        if inner or self.inserts:
            out.append(("I", INSERT, 4 * at + asked))
        if inner and fault < 2:
            more = TRUNCATED if fault else 0
            kept = GRAMMAR[state].get(INITIALS[initial]) if initial < 3 else None
            if kept is not None:
                out.append(("K", KEEP + more, 4 * at + 4 + kept))
            out.append(("R", REROLE + more, 4 * at + 4 + asked))
        return [a for a in out if a[2] % 4 in self.states]

    def auction(self, origin: int) -> int:
        """Exact price of a node, after extending and contracting a path from it."""
        price, exact, chosen, last = self.price, self.exact, self.chosen, self.last
        path = [origin]
        while True:
            node = path[-1]
            if exact[node] or (self.inserts and node >= last and node - last in FINAL):
                for k in path:
                    exact[k] = True
                return price[origin]
            best, taken = FAR, None
            for letter, cost, to in self.arcs(node):
                if cost + price[to] < best:
                    best, taken = cost + price[to], (letter, to)
            if price[node] < best:
                price[node] = best
                if best >= FAR:
                    exact[node] = True                            # no way on from here
                if len(path) > 1:
                    path.pop()
            else:
                chosen[node] = taken
                path.append(taken[1])

    def trace(self, state: int) -> tuple[str, int]:
        """(edits from a state before the first row, state behind the last)."""
        self.auction(state)
        node, out = state, []
        while self.chosen[node] is not None and not (node >= self.last and not self.inserts):
            letter, node = self.chosen[node]
            out.append(letter)
        return "".join(out), node % 4


def solve(codes: bytes) -> tuple[int, str]:
    """(cost, ASCII-least cheapest edits) of a whole conversation."""
    lattice = Lattice(codes, [0] * 4, True)
    audit, _ = lattice.trace(START)
    return lattice.price[START], audit


def piece_costs(codes: bytes) -> list[int]:
    """Cost from each state before a piece to each state behind it (FAR: no way), row by row. A state can only be reached from
    itself and those that lead to it: START from START, SYSTEM from START and SYSTEM."""
    out = [FAR] * 16
    for to in range(4):
        states = (START,) if to == START else (START, SYSTEM) if to == SYSTEM else (START, SYSTEM, USER, ASSISTANT)
        lattice = Lattice(codes, [0 if s == to else FAR for s in range(4)], False, states)
        for state in states:
            out[4 * state + to] = min(lattice.auction(state), FAR)
    return out


def edits_of_rows(audit: str, codes: bytes, state: int) -> tuple[list[str], list[str], list[str], str]:
    """(roles inserted before each row, its letter, its new role if reroled, roles inserted behind the last row)."""
    before, letters, roles, waiting = [], [], [], ""
    for letter in audit:
        asked = ASKED[state]
        if letter == "I":
            waiting += asked
        else:
            initial = codes[len(letters)] % 4
            before.append(waiting)
            letters.append(letter)
            roles.append(asked if letter == "R" else "")
            waiting = ""
            asked = INITIALS[initial] if letter == "K" else asked
        if letter != "D":
            state = GRAMMAR[state][asked]
    return before, letters, roles, waiting


def lines(before: str, letter: str, new_role: str, after: str, role: str, text: str) -> list[str]:
    """Repaired turns at one row, as role:text."""
    own = [f"{ROLES.get(new_role, role)}:{text}"] if letter in "KR" else []
    return [f"{ROLES[r]}:" for r in before] + own + [f"{ROLES[r]}:" for r in after]


def _stats(codes: bytes, turns: list) -> dict:
    """What the report adds up over the pieces of a conversation."""
    have = [t for t in turns if t is not None]
    pairs = zip(codes, codes[1:])
    return {"blank": sum(c >= 12 for c in codes), "duplicate": sum(8 <= c < 12 for c in codes), "truncated": sum(4 <= c < 8 for c in codes),
            "illegal": sum(not legal(a, b) for a, b in pairs), "first": codes[0], "last": codes[-1],
            "low": min(have, default=None), "high": max(have, default=None), "turns": len(set(have))}


def legal(a: int, b: int) -> bool:
    return a % 4 < 3 and b % 4 < 3 and INITIALS[a % 4] + INITIALS[b % 4] in LEGAL_PAIRS


STATS = "blank long, duplicate long, truncated long, illegal long, first int, last int, low long, high long, turns long"


def classed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _turn, _role, _text, _h1, _h2, _copy, _code), one row a copy of a row, with fault and initial."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))            # noqa: E731
    told = rows.select(F.col(conv).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"), one(role).alias("_role"), one(text).alias("_text"))
    keys = ["_conv", "_turn", "_role", "_h1", "_h2"]
    told = told.withColumns({"_h1": F.xxhash64("_text"), "_h2": F.xxhash64(F.lit(1), "_text")})
    distinct = told.groupBy(*keys).agg(F.max("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    earliest = F.min(F.struct(F.col("_turn").isNotNull().alias("has"), F.col("_turn").alias("turn")))
    firsts = (distinct.groupBy("_conv", "_role", "_h1", "_h2").agg(earliest.alias("_e"))
              .select("_conv", F.col("_e.turn").alias("_turn"), "_role", "_h1", "_h2", F.lit(True).alias("_first")))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = distinct.alias("a").join(firsts.alias("b"), met, "left").select("a.*", F.col("b._first").isNotNull().alias("_first"))
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    end = F.substring(F.rtrim("_text", F.lit(SPACE)), -1, 1)
    fault = F.when(end == "", 3).when(~F.col("_first") | (F.col("_copy") > 1), 2).when(~end.isin(".", "!", "?"), 1).otherwise(0)
    initial = F.instr(F.lit(INITIALS), F.substring("_role", 1, 1)) - 1
    code = 4 * fault + F.when((initial >= 0) & (F.length("_role") > 0), initial).otherwise(3)
    return copies.select(*keys, "_text", "_copy", code.cast("int").alias("_code"))


def _solved_rows(rows: DataFrame, texts: bool) -> DataFrame:
    """Sorted rows with their edits where the conversation lies within one batch; the last row of each piece of a conversation
    carries the piece."""
    kind = rows.schema["_conv"].dataType.simpleString()
    piece = pa.struct([("n", pa.int64()), ("codes", pa.binary()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("costs", pa.list_(pa.int64())),
                       *[(f, pa.int32() if f in ("first", "last") else pa.int64()) for f in (x.split()[0] for x in STATS.split(", "))]])
    names = ["_conv", "_part", "_at", "_role", "_text", "_open", "_before", "_letter", "_new_role", "_after", "_piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, memo = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            conv, turn, role, text, code = (batch.column(batch.schema.get_field_index(c)) for c in ("_conv", "_turn", "_role", "_text", "_code"))
            group = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), n]
            codes, turns = bytes(code.to_numpy(zero_copy_only=False).astype(np.uint8)), turn.to_pylist()
            roles, words = role.to_pylist(), text.to_pylist()
            before, letters, new_roles, after, pieces, is_open = [""] * n, [None] * n, [""] * n, [""] * n, [None] * n, [False] * n
            for a, b in zip(borders, borders[1:]):
                own = codes[a:b]
                found = {"n": b - a, "codes": own, **_stats(own, turns[a:b])}
                if a == 0 or b == n:                              # may go on in another batch
                    found["costs"] = piece_costs(own)
                    is_open[a:b] = [True] * (b - a)
                else:
                    if own not in memo:
                        if len(memo) >= MEMO:
                            memo.clear()
                        cost, audit = solve(own)
                        memo[own] = cost, audit, *edits_of_rows(audit, own, START)
                    cost, audit, before[a:b], letters[a:b], new_roles[a:b], after[b - 1] = memo[own]
                    told = [x for k in range(a, b) for x in lines(before[k], letters[k], new_roles[k], after[k], roles[k], words[k])]
                    found |= {"cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(told).encode()).hexdigest(), "codes": None}
                pieces[b - 1] = found
            kept = text if texts else pa.array([w if o else None for w, o in zip(words, is_open)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [conv, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), role, kept, pa.array(is_open), *[pa.array(x, pa.string()) for x in (before, letters, new_roles, after)],
                 pa.array(pieces, piece)], names=names)
            at += n

    return rows.mapInArrow(run, f"_conv {kind}, _part int, _at long, _role string, _text string, _open boolean, _before string, _letter string, _new_role string, _after string, "
                                f"_piece struct<n:bigint,codes:binary,cost:bigint,audit:string,sha:string,costs:array<bigint>,{STATS.replace(' ', ':').replace(',:', ',').replace('long', 'bigint')}>")


AT_END = [0, 2 * INSERT, INSERT, 0]             # price of each state behind the last row of a conversation


def _prices_behind(pieces: DataFrame) -> DataFrame:
    """The price of each state behind every open piece: costs are carried from the last piece of a conversation to the first."""
    kind = pieces.schema["_conv"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_part", "_at"], ignore_index=True)
        price, out = AT_END, []
        for costs in reversed(frame["costs"].tolist()):
            out.append(price)
            price = [int(min(costs[4 * q + x] + price[x] for x in range(4))) for q in range(4)]
        rank = np.arange(len(frame))
        return frame[["_conv", "_part", "_at"]].assign(beyond=out[::-1], is_first=rank == 0, is_last=rank == len(frame) - 1)

    return (pieces.select("_conv", "_part", "_at", F.col("_piece.costs").alias("costs")).groupBy("_conv")
            .applyInPandas(run, f"_conv {kind}, _part int, _at long, beyond array<bigint>, is_first boolean, is_last boolean"))


def _traces(codes: pd.Series, beyond: pd.Series, is_first: pd.Series, is_last: pd.Series) -> pd.Series:
    """Edits of a piece, state behind it and cost to the end, for each state before it (the first piece has but one)."""
    out = []
    for own, price, first, last in zip(codes, beyond, is_first, is_last):
        lattice = Lattice(bytes(own), [0] * 4 if last else [int(x) for x in price], bool(last))
        out.append([dict(zip(("audit", "state"), lattice.trace(q)), cost=lattice.price[q]) for q in ((START,) if first else range(4))])
    return pd.Series(out)


def _chained(pieces: DataFrame) -> DataFrame:
    """The state before each open piece, and on the last piece of a conversation the sums of its report."""
    kind = pieces.schema["_conv"].dataType.simpleString()
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_part", "_at"], ignore_index=True)
        state, before, illegal = START, [], int(frame["illegal"].sum())
        for after in frame["after"]:
            before.append(state)
            state = int(after[state])
        illegal += sum(not legal(a, b) for a, b in zip(frame["last"].iloc[:-1], frame["first"].iloc[1:]))
        low, high = frame["low"].tolist(), frame["high"].tolist()
        have = [(a, b) for a, b in zip(low, high) if not pd.isna(a)]
        shared = sum(a[1] == b[0] for a, b in zip(have, have[1:]))
        turns = int(frame["turns"].sum()) - shared
        out = frame[["_conv", "_part", "_at"]].assign(state=before)
        out["total"] = [None] * (len(frame) - 1) + [{
            "gaps": int(have[-1][1] - have[0][0] + 1 - turns) if have else 0, "blank": int(frame["blank"].sum()), "duplicate": int(frame["duplicate"].sum()),
            "truncated": int(frame["truncated"].sum()), "illegal": illegal, "cost": int(frame["whole_cost"].iloc[0])}]
        return out

    light = pieces.select("_conv", "_part", "_at", *[F.col(f"_piece.{n}").alias(n) for n in names], F.transform("traces", lambda t: t["state"]).alias("after"),
                          F.col("traces")[0]["cost"].alias("whole_cost"))
    return light.groupBy("_conv").applyInPandas(run, f"_conv {kind}, _part int, _at long, state int, total struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint>")


def _streamed_hash(rows: DataFrame) -> DataFrame:
    """sha256 of the repaired text of each conversation, row after row in the order of the rows: no text is put together."""
    kind = rows.schema["_conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, begun, any_row = None, None, False, False
        for batch in batches:
            got = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            names, done = got["_conv"], []
            for k, (conv, *row) in enumerate(zip(*[got[c].to_pylist() for c in ("_conv", "_before", "_letter", "_new_role", "_after", "_role", "_text")])):
                if not any_row or conv != last:
                    if any_row:
                        done.append((last, digest.hexdigest()))
                    last, digest, begun, any_row = conv, hashlib.sha256(), False, True
                for line in lines(*row):
                    digest.update((("\n" if begun else "") + line).encode())
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], names.type), pa.array([d[1] for d in done])], names=["_conv", "sha"])
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([last], names.type), pa.array([digest.hexdigest()])], names=["_conv", "sha"])

    laid = rows.repartition(partitions(rows.sparkSession), "_conv").sortWithinPartitions("_conv", "_part", "_at")
    return laid.mapInArrow(run, f"_conv {kind}, sha string")


def same_conv(a: str, b: str) -> Column:
    return F.col(f"{a}._conv").eqNullSafe(F.col(f"{b}._conv"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(report, turns). Report: `conv`, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256 of every
    conversation that has rows. Turns: the rows in order (part, at) with letter, new_role ('' if none), the initials of turns
    inserted before and after, role and text; without `texts`, text is null where it isn't needed further."""
    order = ["_conv", "_turn", "_role", "_h1", "_h2", "_copy"]
    laid = classed(rows, conv, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order)
    solved = stored(_solved_rows(laid, texts))
    pieces = solved.filter("_piece IS NOT NULL")
    gaps = F.when(F.col("_piece.low").isNull(), 0).otherwise(F.col("_piece.high") - F.col("_piece.low") + 1 - F.col("_piece.turns"))
    columns = ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    whole = pieces.filter(~F.col("_open")).select("_conv", gaps.cast("bigint").alias("gaps"), *[F.col(f"_piece.{c}").alias(c) for c in columns[2:]])

    crossing = pieces.filter("_open").select("_conv", "_part", "_at", "_piece")
    key = ["_part", "_at"]
    behind = _prices_behind(crossing).drop("_conv")
    traces = F.pandas_udf(_traces, "array<struct<audit:string,state:int,cost:bigint>>")
    traced = stored(crossing.join(behind, key).withColumn("traces", traces("_piece.codes", "beyond", "is_first", "is_last")))
    chain = stored(_chained(traced))
    chosen = traced.join(chain.drop("_conv"), key).withColumn("taken", F.col("traces")[F.col("state")])
    audits = (chosen.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_part", "_at", "taken.audit"))).alias("parts"))     # a row a piece
              .select("_conv", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit")))

    @F.pandas_udf("array<struct<back:bigint,before:string,letter:string,new_role:string,after:string>>")
    def edits(codes: pd.Series, audit: pd.Series, state: pd.Series) -> pd.Series:
        out = []
        for own, letters, q in zip(codes, audit, state):
            before, letter, new_role, after = edits_of_rows(letters, bytes(own), int(q))
            n = len(letter)
            out.append([{"back": n - 1 - k, "before": before[k], "letter": letter[k], "new_role": new_role[k], "after": after if k == n - 1 else ""} for k in range(n)])
        return pd.Series(out)

    told = (chosen.withColumn("_edit", F.explode(edits("_piece.codes", "taken.audit", "state")))
            .select("_part", (F.col("_at") - F.col("_edit.back")).alias("_at"), F.col("_edit.before").alias("_before"), F.col("_edit.letter").alias("_letter"),
                    F.col("_edit.new_role").alias("_new_role"), F.col("_edit.after").alias("_after")))
    plain = ["_conv", "_part", "_at", "_role", "_text"]
    late = solved.filter("_open").select(*plain).join(told, key).select(*plain, "_before", "_letter", "_new_role", "_after")
    hashes = _streamed_hash(late)
    totals = chain.filter("total IS NOT NULL").select("_conv", "total.*")
    open_report = (totals.alias("t").join(audits.alias("a"), same_conv("t", "a")).join(hashes.alias("h"), same_conv("t", "h"))
                   .select(*[F.col(f"t.{c}") for c in columns[:-2]], "audit", "sha"))
    report = whole.unionByName(open_report).select(F.col("_conv").alias(conv), *columns[1:-1], F.col("sha").alias("repaired_sha256"))
    turns = solved.filter(~F.col("_open")).select(*late.columns).unionByName(late)
    names = {"_conv": conv, "_part": "part", "_at": "at", "_role": role, "_text": text, "_before": "before", "_letter": "letter", "_new_role": "new_role", "_after": "after"}
    return report, turns.select(*[F.col(a).alias(b) for a, b in names.items()])
