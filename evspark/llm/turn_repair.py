"""Repair of conversations: the cheapest edits that make their roles alternate.

Roles have to read `(s?(ua)+)?`. The grammar is in Chomsky normal form: a nonterminal (p, q) stands for turns that take the pattern
from state p to state q, its rules are (p, q) -> (p, r) (r, q), and its terminals are the edits of one turn with insertions around
them (the insertion closure, which holds any number of them). A cell of the chart has, for every nonterminal, the least (cost, audit)
of its span. Of one span and one cost no audit begins another (equal letters take equal turns and equal costs, and each letter that
follows is an insertion of 5), so the least audits of two parts give the least audit of the whole.

A nonterminal fixes the states at both ends of a span, so that every split point gives the same cell. Spans of up to FULL turns are
made at all split points, longer ones of two halves, as parts of 2, 4, 8, ... spans; the cells of blocks of a long conversation are made in
different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evspark.llm.common import null_safe
from evspark.llm.turns import arrow_schema, batch_of, by_conversation, in_order

#: States of the pattern: nothing yet, after s, after u, after a. Steps: (from, initial) -> to.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns of the longest span that is made at all split points; turns of a block; cells of spans that a worker keeps.
FULL, BLOCK, CELLS = 12, 1024, 1 << 15
WHITE = " \t\n\x0b\f\r"
FAULTS = {"B": "blank", "D": "duplicate"}
Cell = tuple[tuple[tuple[int, str] | None, ...], ...]


def joined(left: Cell, right: Cell) -> Cell:
    """The product of two cells: spans that follow each other."""
    return tuple(tuple(min(((x[0] + y[0], x[1] + y[1]) for x, y in zip(left[p], (row[q] for row in right), strict=True) if x and y), default=None) for q in range(4)) for p in range(4))


def least(one: Cell, other: Cell) -> Cell:
    return tuple(tuple(min((x for x in pair if x), default=None) for pair in zip(*rows, strict=True)) for rows in zip(one, other, strict=True))


def _cell(entries: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(tuple(entries.get((p, q)) for q in range(4)) for p in range(4))


NONE = _cell({(p, p): (0, "") for p in range(4)})


@lru_cache(1)
def insertions() -> Cell:
    """Any number of insertions."""
    once = _cell({(p, q): (INSERT, "I") for (p, c), q in STEPS.items() if c in ROLES})
    found = NONE
    while (more := least(found, joined(found, once))) != found:
        found = more
    return found


@lru_cache(64)
def terminal(symbol: str) -> Cell:
    """A turn: B or D (blank, duplicate) has to go; the initial of its role, a capital if the text is truncated, `o` for another role."""
    entries = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol not in FAULTS:
        more = TRUNCATED if symbol.isupper() else 0
        for (p, c), q in STEPS.items():
            edits = [(KEEP + more, "K")] * (c == symbol.lower()) + [(REROLE + more, "R")] * (c in ROLES)
            entries |= {(p, q): min(edits)} if edits else {}
    return reduce(joined, (insertions(), _cell(entries), insertions()))


@lru_cache(CELLS)
def chart(symbols: str) -> Cell:
    """The cell of a short span, from those of all its spans, shortest first."""
    n = len(symbols)
    cells = {(i, i + 1): terminal(x) for i, x in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells[i, i + length] = reduce(least, (joined(cells[i, m], cells[m, i + length]) for m in range(i + 1, i + length)))
    return cells[0, n] if n else insertions()


def combined(cells: Iterator[Cell]) -> Cell:
    """The product of cells that follow each other, halves of equal length first."""
    stack: list[tuple[int, Cell]] = []
    for cell in cells:
        stack.append((1, cell))
        while len(stack) > 1 and stack[-2][0] == stack[-1][0]:
            (n, left), (_, right) = stack[-2:]
            stack[-2:] = [(2 * n, joined(left, right))]
    while len(stack) > 1:
        (n, left), (m, right) = stack[-2:]
        stack[-2:] = [(n + m, joined(left, right))]
    return stack[0][1] if stack else insertions()


def span(symbols: str) -> Cell:
    return combined(chart(symbols[lo : lo + FULL]) for lo in range(0, len(symbols), FULL))


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) from the beginning to a state where the pattern may end."""
    return min(x for x in (cell[NOTHING][NOTHING], cell[NOTHING][AFTER_A]) if x)


def edits_by_turn(audit: str) -> Iterator[str]:
    """The letters of an audit turn by turn, each with the insertions before it; those after the last turn are with it."""
    lo, n = 0, len(audit.rstrip("I"))
    for hi, letter in enumerate(audit):
        if letter != "I":
            yield audit[lo:] if hi + 1 == n else audit[lo : hi + 1]
            lo = hi + 1


def _symbol(role: Column, text: Column) -> Column:
    """Of a turn by itself: B if it is blank; else its role's initial."""
    bare = F.rtrim(text, F.lit(WHITE))
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("o")
    return F.when(bare == "", "B").when(F.substring(bare, -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns of conv_id, turn, role, text: conv_id, turn, edit (K, R, D or I), role, text, was (role before; null if inserted), fault.

    Rows of each conversation stand by turn (null first), then role and text. A row's first fault counts: blank, duplicate (a row
    before has its role and text) or truncated (its last character that is not white is none of `.!?`). Deleted rows are there, with
    edit D. Rows come out conversation by conversation, in order within a partition. Null roles and texts count as empty, a null id
    is a conversation, other columns do not matter; an empty table gives an empty one.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = in_order(rows, "conv_id", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], F.lit(0), "repair").drop("start")
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    firsts = placed.groupBy("conv_id", same.alias("same")).agg(F.min("at").alias("at")).select("conv_id", "at", F.lit("").alias("symbol"))
    symbols = placed.select("conv_id", "at", _symbol(F.col("role"), F.col("text")).alias("symbol")).unionByName(firsts)
    # a row's symbol, and an empty one if it is the first of its kind; at most 2 * BLOCK short strings in a group
    of_row = F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: F.when(x["symbol"] == "", "1").otherwise(x["symbol"]))
    blocks = symbols.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(F.array_join(of_row, "").alias("line"))
    # "1u" is a first row; a row without 1 before it is a duplicate, unless it is blank
    marked = F.regexp_replace(F.regexp_replace("line", "(?<!1)[suaoSUAO]", "D"), "1", "")
    cells = _with_cells(blocks.select("conv_id", "block", marked.alias("symbols")))
    audits = _audits(cells)
    told = audits.select("conv_id", F.expr(f"block * {BLOCK}").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.col("audit").alias("role"), F.col("symbols").alias("text"))
    both = told.unionByName(placed.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", "text"))
    text = [StructField(c, StringType()) for c in ("edit", "role", "text", "was", "fault")]
    return by_conversation(both, ["at", "kind"], _edited, StructType([turns.schema["conv_id"], turns.schema["turn"], *text]))


def _with_cells(blocks: DataFrame) -> DataFrame:
    """Adds to each block its cell: costs and audits, entry by entry."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[x for row in span(s) for x in row] for s in batch.column(2).to_pylist()]
            costs = pa.array([[x and x[0] for x in c] for c in cells], pa.list_(pa.int64()))
            audits = pa.array([[x and x[1] for x in c] for c in cells], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, audits], ["conv_id", "block", "symbols", "costs", "audits"])

    return blocks.mapInArrow(run, f"conv_id {kind}, block long, symbols string, costs array<bigint>, audits array<string>")


def _audits(cells: DataFrame) -> DataFrame:
    """conv_id, block, symbols, audit: the part of the best audit that is about the block's turns. Of a conversation a task holds the cells."""
    out = StructType([cells.schema["conv_id"], StructField("block", LongType()), StructField("symbols", StringType()), StructField("audit", StringType())])

    def parts(conv, blocks: list[dict]) -> Iterator[tuple]:
        whole = combined(tuple(tuple((c, a) if c is not None else None for c, a in zip(b["costs"][4 * p : 4 * p + 4], b["audits"][4 * p : 4 * p + 4], strict=True)) for p in range(4)) for b in blocks)
        by_turn = edits_by_turn(best(whole)[1])
        for b in blocks:
            yield conv, b["block"], b["symbols"], "".join(next(by_turn) for _ in b["symbols"])

    def work(told: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
        blocks: list[dict] = []
        for first, row in told:
            if first and blocks:
                yield from parts(blocks[0]["conv_id"], blocks)
                blocks = []
            blocks.append(row)
        if blocks:
            yield from parts(blocks[0]["conv_id"], blocks)

    return by_conversation(cells, ["block"], work, out)


def _edited(told: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
    """Rows of kind 0 bring the edits (as role) and symbols (as text) of the block of turns that follows."""
    state, edits, symbols = NOTHING, iter(()), iter(())
    for first, row in told:
        state = NOTHING if first else state
        if row["kind"] == 0:
            edits, symbols = edits_by_turn(row["role"]), iter(row["text"])
            continue
        letters, symbol = next(edits), next(symbols)
        fault = FAULTS.get(symbol) or ("truncated" if symbol.isupper() else None)
        for letter in letters:
            if letter == "D":
                yield row["conv_id"], row["turn"], "D", row["role"], row["text"], row["role"], fault
                continue
            initial = "a" if state == AFTER_U else "u"
            if letter == "K":
                initial, role = row["role"][0], row["role"]
            else:
                role = ROLES[initial]
            state = STEPS[state, initial]
            yield (row["conv_id"], None, "I", role, "", None, None) if letter == "I" else (row["conv_id"], row["turn"], letter, role, row["text"], row["role"], fault)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(repaired: DataFrame) -> DataFrame:
    """One row a conversation of `repair`'s rows, in the order and partitions in which it gives them: conv_id, gaps, blank, duplicate, truncated, illegal (pairs of neighbouring roles before the repair), cost, audit, repaired_sha256."""
    out = StructType([repaired.schema["conv_id"], *(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    weights = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    schema = arrow_schema(out)

    class Told:
        def __init__(self, conv):
            self.conv, self.n, self.audit, self.sha, self.some = conv, dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
            self.turn, self.low, self.turns, self.was = None, None, 0, None

        def add(self, turn, edit, role, text, was, fault) -> None:
            self.audit.append(edit)
            self.n["cost"] += weights[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "D":
                self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
                self.some = True
            if edit == "I":
                return
            if fault:
                self.n[fault] += 1
            if self.was is not None and self.was[:1] + was[:1] not in ("su", "ua", "au"):
                self.n["illegal"] += 1
            self.was = was
            if turn is not None and turn != self.turn:
                self.low, self.turn, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

        def row(self) -> tuple:
            self.n["gaps"] = 0 if self.turn is None else self.turn - self.low + 1 - self.turns
            return self.conv, *(self.n[c] for c in COUNTS), "".join(self.audit), self.sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = Told(conv)
                now.add(*row)
            yield batch_of(done, schema)
        yield batch_of([now.row()] if now else [], schema)

    return repaired.mapInArrow(run, out)


def damaged(turns: DataFrame) -> DataFrame:
    """Damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's. Nulls of role and text are one space, in the checksum too."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("damage <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def damage_and_repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation of `turns`, those without a row after the damage too."""
    told = report(repair(damaged(turns))).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(told, null_safe(["conv_id"], ["of"]), "left").drop("of")
    return every.fillna(0, COUNTS).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
