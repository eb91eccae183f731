"""Repair of conversation structure by cheapest edits, with an audit of what was done.

A conversation is repaired when its role initials read ``(s?(ua)+)?``. Every row is kept (0),
gets the other of the two roles user and assistant (3) or is deleted (4); empty user or assistant
rows may be inserted anywhere (3 each). Blank and repeated rows must be deleted, a truncated row
that stays costs 3 more. The audit is the string of edit initials (Keep, Rerole, Delete, Insert);
among the cheapest audits the least in ASCII order is taken.

Method: a dynamic programme over the four states of that grammar whose edit strings are persistent:
a string is a node linked to the one it extends, with its binary-lifting ancestors and a rolling
hash of all its edits (``Audits``). Strings of equal cost are compared at the end of their longest
common prefix, which a descent over the ancestors finds by hash; the prefix is then verified edit by
edit back to the node that both share, and a hash collision falls back to the whole strings.

At scale: the rows are positioned by (conversation, turn) and cut into blocks of ``block_rows``
consecutive positions, whatever conversations they hold, so a long conversation is many blocks.
A block gives, for each of its runs of one conversation, the cheapest audit from every state to
every state. Two audits of one run from one state never begin with one another (both end in an edit
of the run's last row, and an audit fixes its states), so a rank per state replaces the string
outside of the block: the second programme goes over a conversation's runs, a few numbers each,
with the same persistent nodes. The chosen audits then meet the texts block by block.
Whether role and text were seen before comes from one pre-aggregated minimum per (conversation, role,
text), not from a group of rows.

Rows: a null role or text is one space. Rows are taken by turn, nulls first; rows of one
turn by role and the SHA-256 of their text. Null ids are one conversation. Equal rows are interchangeable.
Empty texts are blank. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.operators.sequence import global_position
from seqtok.session import materialize

BLOCK_ROWS = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)          # the initial that the repaired rows end in
STATES = (START, SYSTEM, USER, ASSISTANT)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_TAIL = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
_LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, FINE = "blank", "duplicate", "truncated", "fine"


# ---------------------------------------------------------------- edit strings

class Audits:
    """Strings of small integers as linked nodes; node 0 is the empty string."""

    MOD, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681

    def __init__(self):
        self.token, self.depth, self.hash, self.up = [0], [0], [0], [(0,)]

    def extend(self, node: int, token: int) -> int:
        ups = [node]                                  # ups[k]: 2**k edits back
        while self.depth[ups[-1]] >= 1 << (len(ups) - 1):
            ups.append(self.up[ups[-1]][len(ups) - 1])
        self.token.append(token)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + token + 1) % self.MOD)
        self.up.append(tuple(ups))
        return len(self.token) - 1

    def string(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.token[node])
            node = self.up[node][0]
        return out[::-1]

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether string a comes before string b."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:              # one begins with the other
            return self.depth[a] < self.depth[b] if self._same(x, y) else self.string(a) < self.string(b)
        while True:                                   # x, y differ; go to where their parents agree
            ups = min(len(self.up[x]), len(self.up[y]))
            far = next((k for k in range(ups - 1, -1, -1)
                        if self.hash[self.up[x][k]] != self.hash[self.up[y][k]]), None)
            if far is None:
                break
            x, y = self.up[x][far], self.up[y][far]
        if self.token[x] != self.token[y] and self._same(self.up[x][0], self.up[y][0]):
            return self.token[x] < self.token[y]
        return self.string(a) < self.string(b)

    def _same(self, x: int, y: int) -> bool:
        """Two strings of one length, edit by edit back to the node they share."""
        while x != y:
            if self.token[x] != self.token[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True


def _moves(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """Per state: the cheapest ``(next state, cost, edits)`` over one row, inserts before it included."""
    out = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        at, cost, edits = state, 0, ""
        for _ in range(3):                            # a third insert is back where the first was
            ways = [(at, DELETE, "D")]
            if not must_go:
                more = TRUNCATED if truncated else 0
                ways.append((_NEXT[at], REROLE + more, "R"))
                if (at, initial) in _AFTER:
                    ways.append((_AFTER[at, initial], KEEP + more, "K"))
            for to, price, edit in ways:
                best[to] = min(best.get(to, (1 << 30, "")), (cost + price, edits + edit))
            at, cost, edits = _NEXT[at], cost + INSERT, edits + "I"
        out.append([(to, price, text) for to, (price, text) in sorted(best.items())])
    return out


_MOVES = {(i, f): _moves(i, f in (BLANK, DUPLICATE), f == CUT) for i in "suax" for f in (BLANK, DUPLICATE, CUT, FINE)}
_ORDER = {c: k for k, c in enumerate("DIKR")}


def audit_run(rows: list[tuple[str, str]], start: int) -> dict[int, tuple[int, str]]:
    """Cheapest ``(cost, least audit)`` from ``start`` to every state that can be reached, over
    rows of (role initial, fault)."""
    tree = Audits()
    live = {start: (0, 0)}
    for row in rows:
        found: dict[int, tuple[int, int, str]] = {}
        moves = _MOVES[row]
        for state, (cost, node) in live.items():
            for to, price, edits in moves[state]:
                old = found.get(to)
                if old is None or cost + price < old[0] or (cost + price == old[0] and tree.less(node, old[1])):
                    found[to] = (cost + price, node, edits)
        live = {}
        for to, (cost, node, edits) in found.items():
            for e in edits:
                node = tree.extend(node, _ORDER[e])
            live[to] = (cost, node)
    return {to: (cost, "".join("DIKR"[t] for t in tree.string(node))) for to, (cost, node) in live.items()}


# ---------------------------------------------------------------- rows to runs

def _faults(df: DataFrame) -> DataFrame:
    """Columns ``__blank``, ``__ended`` (last character ends a sentence) and ``__initial``."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.left(F.col("role"), F.lit(1))
    return df.select(
        "*", (trimmed == "").alias("__blank"), F.right(trimmed, F.lit(1)).isin(*ENDS).alias("__ended"),
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("__initial"))


def place_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """The rows with their dense position ``pos``, written once: ``conv_id, turn, role, text, __sha``,
    and what ``_faults`` adds."""
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    rows = _faults(rows.withColumn("__sha", F.sha2("text", 256)))
    # the row number spreads equal rows over ranges
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    return global_position(rows, ["conv_id", "turn", "role", "__sha", "__row"], "pos").drop("__row")


def _run_schema(conv: T.DataType, turn: T.DataType) -> T.StructType:
    f = T.StructField
    return T.StructType([
        f("conv_id", conv), f("block", T.LongType()), f("first_pos", T.LongType()), f("n", T.LongType()),
        f("blank", T.LongType()), f("duplicate", T.LongType()), f("truncated", T.LongType()),
        f("illegal", T.LongType()), f("first_initial", T.StringType()), f("last_initial", T.StringType()),
        f("low_turn", turn), f("high_turn", turn), f("turns", T.LongType()),
        f("costs", T.ArrayType(T.LongType())), f("ranks", T.ArrayType(T.IntegerType())),
        f("audits", T.ArrayType(T.StringType()))])


def _arrow(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(target)
    return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, target)], schema=target)


def _block_runs(schema: T.StructType):
    """Of a block's rows and the positions of first sights: one row per run of a conversation."""

    def work(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        first_seen = set(firsts.column("pos").to_pylist())
        rows = rows.take(pc.sort_indices(rows, [("pos", "ascending")]))
        cols = {c: rows.column(c).to_pylist() for c in rows.schema.names}
        size, out, a = rows.num_rows, [], 0
        while a < size:
            b, conv = a, cols["conv_id"][a]
            while b < size and cols["conv_id"][b] == conv:
                b += 1
            faults = [BLANK if cols["__blank"][i] else DUPLICATE if cols["pos"][i] not in first_seen
                      else FINE if cols["__ended"][i] else CUT for i in range(a, b)]
            initials = cols["__initial"][a:b]
            turns = [t for t in cols["turn"][a:b] if t is not None]
            costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
            # only the first run of a block can have begun in an earlier one
            for start in STATES if a == 0 else (START,):
                ends = audit_run(list(zip(initials, faults)), start)
                order = sorted(ends, key=lambda s: ends[s][1])
                for s, (cost, audit) in ends.items():
                    costs[4 * start + s], ranks[4 * start + s], audits[4 * start + s] = cost, order.index(s), audit
            out.append((conv, cols["block"][a], cols["pos"][a], b - a, faults.count(BLANK), faults.count(DUPLICATE),
                        faults.count(CUT), sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:])),
                        initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None,
                        len(set(turns)), costs, ranks, audits))
            a = b
        return _arrow(schema, out)

    return work


def conversation_runs(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per run of a conversation in a block, with its faults and its cheapest audits from
    every state to every state (index 4 * from + to)."""
    block = F.floor(F.col("pos") / block_rows).cast("long").alias("block")
    firsts = placed.groupBy("conv_id", "role", "__sha").agg(F.min("pos").alias("pos")).select("pos", block)
    rows = placed.select("pos", block, "conv_id", "turn", "__blank", "__ended", "__initial")
    schema = _run_schema(placed.schema["conv_id"].dataType, placed.schema["turn"].dataType)
    return rows.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_block_runs(schema), schema)


# ---------------------------------------------------------------- runs to conversations

class _Programme:
    """The programme over the runs of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.tree, self.live, self.runs = conv, Audits(), {START: (0, 0)}, []
        self.ends: dict[int, int] = {0: START}        # state of every node
        self.counts = {c: 0 for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        self.low = self.high = self.initial = None

    def add(self, run: dict) -> None:
        for c in self.counts:
            self.counts[c] += run[c]
        if self.initial is not None and self.initial + run["first_initial"] not in _LEGAL:
            self.counts["illegal"] += 1
        self.initial = run["last_initial"]
        if run["low_turn"] is not None:
            self.counts["turns"] -= self.high == run["low_turn"]
            self.low = run["low_turn"] if self.low is None else self.low
            self.high = run["high_turn"]
        found: dict[int, tuple[int, int, int]] = {}
        for state, (cost, node) in self.live.items():
            for to in STATES:
                price = run["costs"][4 * state + to]
                if price is None:
                    continue
                old = found.get(to)
                if old is None or cost + price < old[0] or (cost + price == old[0] and self.tree.less(node, old[1])):
                    found[to] = (cost + price, node, run["ranks"][4 * state + to])
        self.live = {}
        for to, (cost, node, rank) in found.items():
            node = self.tree.extend(node, rank)
            self.ends[node] = to
            self.live[to] = (cost, node)
        self.runs.append(run["first_pos"])

    def result(self) -> tuple:
        best = None
        for state, (cost, node) in self.live.items():
            total = cost + INSERT * len(_TAIL[state])
            if best is None or total < best[0] or (total == best[0] and self.tree.less(node, best[1])):
                best = (total, node, _TAIL[state])
        cost, node, tail = best
        picks = []
        for k in range(len(self.runs) - 1, -1, -1):
            before = self.tree.up[node][0]
            picks.append({"first_pos": self.runs[k], "from": self.ends[before], "to": self.ends[node], "tail": tail})
            node, tail = before, ""
        n = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - n["turns"]
        return (self.conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, picks[::-1])


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PICK = T.StructType([T.StructField("first_pos", T.LongType()), T.StructField("from", T.IntegerType()),
                      T.StructField("to", T.IntegerType()), T.StructField("tail", T.StringType())])


def _by_conversation(batches: Iterator[pa.RecordBatch], make, rows: int = 4096) -> Iterator[list]:
    """Feeds rows sorted by conversation to ``make(conv_id)`` objects; yields lists of finished ones."""
    open_, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if open_ is None or open_.conv != row["conv_id"]:
                done += [open_] if open_ else []
                open_ = make(row["conv_id"])
                if len(done) >= rows:
                    yield done
                    done = []
            open_.add(row)
    if open_:
        yield [*done, open_]


def choose_audits(runs: DataFrame) -> DataFrame:
    """Per conversation: ``gaps`` in its turns, ``blank``, ``duplicate``, ``truncated`` rows, ``illegal``
    neighbours, the least ``cost``, and ``picks``: the states between which each run is repaired."""
    schema = T.StructType([runs.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in _COUNTS],
                           T.StructField("picks", T.ArrayType(_PICK))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _by_conversation(batches, _Programme):
            yield from _arrow(schema, [p.result() for p in done]).to_batches()

    return (runs.drop("audits", "block", "n").repartition("conv_id")
                .sortWithinPartitions("conv_id", "first_pos").mapInArrow(work, schema))


# ---------------------------------------------------------------- repaired rows

def apply_audit(audit: str, state: int, rows: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """``(role, text, edit)`` of the rows that an audit leaves, from a state on."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = _AFTER[state, role[:1]]
        else:
            state = _NEXT[state]
            role = _ROLE[state]
        out.append((role, text, edit))
    return out


def _block_repair(schema: T.StructType):
    def work(rows: pa.Table, picks: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("pos", "ascending")]))
        pos, roles, texts = (rows.column(c).to_pylist() for c in ("pos", "role", "text"))
        out = []
        for p in sorted(picks.to_pylist(), key=lambda p: p["first_pos"]):
            a = p["first_pos"] - pos[0]
            kept = apply_audit(p["audit"], p["from"], list(zip(roles[a:a + p["n"]], texts[a:a + p["n"]])))
            out.append((p["conv_id"], p["first_pos"], p["audit"],
                        [{"role": r, "text": t, "edit": e} for r, t, e in kept]))
        return _arrow(schema, out)

    return work


def repair_runs(placed: DataFrame, runs: DataFrame, chosen: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``conv_id, first_pos, audit, lines``: per run of a conversation its part of the audit and the
    repaired rows (``role, text, edit``); ordered by ``first_pos`` they are the repaired conversation."""
    row = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "text", "edit")])
    schema = T.StructType([placed.schema["conv_id"], T.StructField("first_pos", T.LongType()),
                           T.StructField("audit", T.StringType()), T.StructField("lines", T.ArrayType(row))])
    picks = chosen.select(F.inline("picks")).withColumnRenamed("first_pos", "__first")
    parts = runs.select("conv_id", "block", "first_pos", "n", "audits").join(
        picks, F.col("first_pos") == F.col("__first")).select(
        "conv_id", "block", "first_pos", "n", "from",
        F.concat(F.get("audits", F.col("from") * 4 + F.col("to")), "tail").alias("audit"))
    rows = placed.select(F.floor(F.col("pos") / block_rows).cast("long").alias("block"), "pos", "role", "text")
    return rows.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_block_repair(schema), schema)


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(report, repaired)``: ``choose_audits`` per conversation and ``repair_runs``."""
    placed = place_rows(df, conv_col, turn_col, role_col, text_col)
    runs = materialize(conversation_runs(placed, block_rows), "conversation-runs")
    chosen = materialize(choose_audits(runs), "conversation-audits")
    return chosen.drop("picks"), repair_runs(placed, runs, chosen, block_rows)


# ---------------------------------------------------------------- digests, damage

class _Digest:
    def __init__(self, conv):
        self.conv, self.sha, self.empty, self.audit = conv, hashlib.sha256(), True, []

    def add(self, row: dict) -> None:
        self.audit.append(row["audit"])
        if row["n"]:
            self.sha.update((b"" if self.empty else b"\n") + row["text"].encode("utf-8", "surrogatepass"))
            self.empty = False


def repair_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of whole conversations (``role:text``, newline-joined). The texts
    are hashed as they stream by, so a long conversation costs time but no memory."""
    lines = F.concat_ws("\n", F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])))
    parts = repaired.select("conv_id", "first_pos", "audit", F.size("lines").alias("n"), lines.alias("text"))
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _by_conversation(batches, _Digest):
            yield from _arrow(schema, [(d.conv, "".join(d.audit), d.sha.hexdigest()) for d in done]).to_batches()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_pos").mapInArrow(work, schema)


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults dealt by ``crc32("conv_id:turn") % 20``: 0 drops the row,
    1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    def string(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    dealt = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn"))) % 20
    return (df.select("conv_id", "turn", string("role").alias("role"), string("text").alias("text"), dealt.alias("__d"))
              .where(F.col("__d") != 0)
              .select("conv_id", "turn", F.when(F.col("__d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                      F.when(F.col("__d") == 1, F.lit("")).when(F.col("__d") == 2, F.regexp_replace("text", "[.!?]", ""))
                      .otherwise(F.col("text")).alias("text"),
                      F.explode(F.when(F.col("__d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
              .drop("__copy"))


def repair_damaged(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Counts, cost, audit and digest of every conversation after ``damage``; conversations of which no
    row is left have zeros, an empty audit and the digest of the empty string."""
    report, repaired = repair_conversations(damage(df), block_rows=block_rows)
    ids = df.select(F.col("conv_id").alias("__id")).distinct()
    whole = report.join(repair_digests(repaired).withColumnRenamed("conv_id", "__d"),
                        F.col("conv_id").eqNullSafe(F.col("__d"))).drop("__d")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return ids.join(whole, F.col("__id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("__id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
