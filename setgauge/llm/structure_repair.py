"""Conversation structure repair by divide and conquer in linear space.

The rows of a conversation, in order, are edited at least cost until the initials of their roles read
``(s?(ua)+)?``. Four states say what was read last: nothing, a system, a user or an assistant turn. An edit is one
letter of the audit:

    D  delete the row, 3                             I  insert an empty turn of the role that may follow, 2
    K  keep the row, 0 (truncated: 1)                R  give the row the role that may follow, 2 (truncated: 3)

Blank and repeated rows can only be deleted. In a state each letter leads to one next state, so the audit tells
the whole repair; of the cheapest audits that which sorts first is taken.

Hirschberg's scheme: a vector of four costs runs forward to the middle and another backward; the crossing is the
state with the least sum, and both halves are solved on their own. Vectors look at states right after a row was
read, before any insertion. Two ways to such states never begin one with the other, so the forward vector needs only the
order of its four audits, not the audits themselves: of crossings of equal cost that with the first way is taken. A row, as well as any
stretch of rows, is a 4 x 4 table of (cost, order), and tables compose. So a conversation is cut into blocks of at most
``BLOCK`` rows: tasks make a table per block, the crossings between blocks follow from the tables alone (32 numbers a
block), and each block is then solved on its own. A conversation with a third of all rows is many blocks.

Equal rows of a conversation (turn, role and text) are one run with a count before anything is shuffled.
Texts are shuffled once, for the repaired conversations; everything else works on SHA-256 of them.

Order of rows: turn, nulls first, then role, then SHA-256 of the text; equal rows are neighbours.
Cases: null roles and texts are one space; an empty role has no initial, so it cannot be kept. A null conv_id is a conversation. conv_id keeps its type. Empty texts are blank. An empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setgauge.llm.common import chunks, cut, discard

#: Runs of a block.
BLOCK = 4096
BLANKS = " \t\n\x0b\f\r"
#: States: nothing read, system, user, assistant. What may be inserted in a state leads to the next state.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = (USER, USER, ASSISTANT, USER)
ROLE = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
NEVER = 1 << 60
FINE, BLANK, REPEATED, TRUNCATED = range(4)
#: Cost and letters from each state to a valid end.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def row_table(initial: str, fault: int) -> list[list[tuple[int, str]]]:
    """Cheapest (cost, letters) from each state over one row to each state right after it; letters settle ties."""
    extra = CUT_OFF if fault == TRUNCATED else 0
    table = [[(NEVER, "")] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, letters = start, 0, ""
        for _ in range(3):  # no, one or two insertions before the row
            ways = [(state, DELETE, "D")]
            if fault in (FINE, TRUNCATED):
                ways.append((INSERTED[state], REROLE + extra, "R"))
                if (initial, state) in KEPT:
                    ways.append((KEPT[initial, state], extra, "K"))
            for end, more, letter in ways:
                table[start][end] = min(table[start][end], (cost + more, letters + letter))
            state, cost, letters = INSERTED[state], cost + INSERT, letters + "I"
    return table


TABLES = {(i, f): row_table(i, f) for i in ("s", "u", "a", "") for f in (FINE, BLANK, REPEATED, TRUNCATED)}


def repeated_table(times: int) -> list[list[tuple[int, str]]]:
    """The same over ``times`` rows that must all be deleted; their first letters, all D, are left out."""
    return [[(cost + DELETE * (times - 1), letters) for cost, letters in row] for row in TABLES["", REPEATED]]


def forward(tables: list, first: int, last: int, start: int) -> list[tuple[int, int]]:
    """(cost, place of the audit among the four) of each state after tables[first:last]."""
    costs, places = [NEVER] * 4, [0] * 4
    costs[start] = 0
    for t in range(first, last):
        table = tables[t]
        ways = [min((costs[p] + table[p][q][0], places[p], table[p][q][1]) for p in range(4) if costs[p] < NEVER) for q in range(4)]
        costs = [min(w[0], NEVER) for w in ways]
        order = sorted(range(4), key=lambda q: ways[q][1:])
        for place, q in enumerate(order):
            places[q] = place
    return list(zip(costs, places))


def backward(tables: list, first: int, last: int, ends: list[int]) -> list[int]:
    """Least cost from each state before tables[first] to the ends after tables[last - 1]."""
    for t in range(last - 1, first - 1, -1):
        ends = [min(cost + end for (cost, _), end in zip(row, ends)) for row in tables[t]]
    return ends


def crossings(tables: list, start: int, ends: list[int], first: int = 0, last: int | None = None) -> Iterator[int]:
    """The states of the cheapest, first audit right after each table."""
    last = len(tables) if last is None else last
    if last - first == 1:
        row = tables[first][start]
        yield min(range(4), key=lambda q: (row[q][0] + ends[q], row[q][1]))
    elif last > first:
        middle = (first + last) // 2
        ahead, behind = forward(tables, first, middle, start), backward(tables, middle, last, ends)
        at = min(range(4), key=lambda q: (ahead[q][0] + behind[q], ahead[q][1]))
        yield from crossings(tables, start, [0 if q == at else NEVER for q in range(4)], first, middle)
        yield from crossings(tables, at, ends, middle, last)


def run_tables(initial: str, fault: int, times: int) -> list:
    """The tables of a run: its first row, then its repetitions as one."""
    known = initial if initial in ("s", "u", "a") else ""
    if fault in (BLANK, REPEATED):
        return [repeated_table(times)]
    return [TABLES[known, fault]] + ([repeated_table(times - 1)] if times > 1 else [])


def run_letters(initial: str, fault: int, times: int, states: list[int]) -> str:
    """Letters of a run, from the state before it and after each of its tables."""
    out = []
    for k, table in enumerate(run_tables(initial, fault, times)):
        many = times - k if (k or fault in (BLANK, REPEATED)) else 1
        out.append("D" * (many - 1) + table[states[k]][states[k + 1]][1])
    return "".join(out)


# --- damage, as a test of the repair -------------------------------------------------------------------------------


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): dropped, emptied, unpunctuated, repeated or reroled by a checksum of the row's place."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"), kind.alias("kind"))
    return rows.where("kind <> 0").drop("kind")


# --- runs and blocks -----------------------------------------------------------------------------------------------


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) with the SHA-256 that stands for the text."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    picked = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), times.cast("long").alias("times"))
    return picked.withColumn("mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def runs(rows: DataFrame) -> DataFrame:
    """One row per run: conv_id, turn, role, mark, times, fault."""
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    own = rows.select("conv_id", "turn", "role", "mark", "times", fault.alias("fault"))
    grouped = cut(own.groupBy("conv_id", "turn", "role", "mark", "fault").agg(F.sum("times").alias("times")), "runs")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = grouped.groupBy("conv_id", "role", "mark").agg(F.min(place).alias("first"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark"), "first")
    met = grouped.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("mark") == F.col("_mark")))
    again = (F.col("fault") != BLANK) & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    out = met.select("conv_id", "turn", "role", "mark", "times", F.when(again, REPEATED).otherwise(F.col("fault")).cast("int").alias("fault"))
    out.shared_path = grouped.shared_path
    return out


def turn_counts(turn: T.DataType) -> list[T.StructField]:
    """What is counted per block."""
    longs = [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    return [*longs, T.StructField("low_turn", turn), T.StructField("high_turn", turn), T.StructField("first_role", T.StringType()), T.StructField("last_role", T.StringType())]


def summary(block: list[dict]) -> dict:
    """Counts of a block; a run's repetitions are blank or repeated rows."""
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for run in block:
        if run["fault"] == BLANK:
            counts["blank"] += run["times"]
        else:
            counts["duplicate"] += run["times"] - (run["fault"] != REPEATED)
            counts["truncated"] += run["fault"] == TRUNCATED
        counts["illegal"] += (run["times"] - 1) * (run["role"][:1] * 2 not in LEGAL)
    counts["illegal"] += sum(a["role"][:1] + b["role"][:1] not in LEGAL for a, b in zip(block, block[1:]))
    turns = [r["turn"] for r in block if r["turn"] is not None]
    return counts | {
        "turns": len(set(turns)), "low_turn": min(turns, default=None), "high_turn": max(turns, default=None),
        "first_role": block[0]["role"], "last_role": block[-1]["role"],
    }


def tables_of(block: list[dict]) -> list:
    return [t for r in block for t in run_tables(r["role"][:1], r["fault"], r["times"])]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def blocks(ordered: DataFrame, size: int) -> DataFrame:
    """Blocks of one conversation each, in order of (part, nr), with counts and the table of the block as 16 costs and places."""
    conv, turn = ordered.schema["conv_id"], ordered.schema["turn"]
    run_type = T.StructType([ordered.schema[c] for c in ("turn", "role", "mark", "times", "fault")])
    numbers = [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.LongType()))]
    place = [T.StructField("part", T.IntegerType()), T.StructField("nr", T.LongType())]
    schema = T.StructType([conv, *place, T.StructField("runs", T.ArrayType(run_type)), *turn_counts(turn.dataType), *numbers])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        held, here, nr, of_conversation, conversations = [], None, 0, 0, 0

        def packed() -> dict:
            tables = tables_of(held)
            # a conversation that begins in this part begins with nothing read
            starts = [NOTHING] if conversations and not of_conversation else range(4)
            rows = [forward(tables, 0, len(tables), p) if p in starts else [(NEVER, 0)] * 4 for p in range(4)]
            numbers = {"costs": [c for row in rows for c, _ in row], "places": [x for row in rows for _, x in row]}
            return {"conv_id": here[0], "part": here[1], "nr": nr, "runs": held} | summary(held) | numbers

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = (row.pop("conv_id"), row.pop("part"))
                if held and (at != here or len(held) == size):
                    out.append(packed())
                    of_conversation = of_conversation + 1 if at == here else 0
                    conversations += at != here
                    held, nr = [], nr + 1
                here = at
                held.append(row)
                if len(out) == 64:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([packed()], schema=arrow)

    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(pack, schema)


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def routes(packed: DataFrame) -> DataFrame:
    """(part, nr, enter, leave, ends) of each block, and the totals of its conversation on the block that ends it."""
    longs = [T.StructField(c, T.LongType()) for c in ("nr", "enter", "leave", *TOTALS)]
    schema = T.StructType([packed.schema["conv_id"], packed.schema["part"], *longs, T.StructField("ends", T.BooleanType())])
    few = packed.drop("runs").repartition("conv_id").sortWithinPartitions("conv_id", "part", "nr")

    def route(held: list[dict]) -> list[dict]:
        tables = [[list(zip(b["costs"][4 * p : 4 * p + 4], b["places"][4 * p : 4 * p + 4])) for p in range(4)] for b in held]
        ends = [cost for cost, _ in END]
        states = [NOTHING, *crossings(tables, NOTHING, ends)]
        totals = {c: sum(b[c] for b in held) for c in ("blank", "duplicate", "truncated", "illegal")}
        totals["illegal"] += sum(a["last_role"][:1] + b["first_role"][:1] not in LEGAL for a, b in zip(held, held[1:]))
        known = [b for b in held if b["turns"]]
        distinct = sum(b["turns"] for b in known) - sum(a["high_turn"] == b["low_turn"] for a, b in zip(known, known[1:]))
        totals["gaps"] = known[-1]["high_turn"] - known[0]["low_turn"] + 1 - distinct if known else 0
        totals["cost"] = sum(t[a][b][0] for t, a, b in zip(tables, states, states[1:])) + ends[states[-1]]
        none = dict.fromkeys(TOTALS)
        last = len(held) - 1
        return [
            {"conv_id": b["conv_id"], "part": b["part"], "nr": b["nr"], "enter": states[i], "leave": states[i + 1], "ends": i == last} | (totals if i == last else none)
            for i, b in enumerate(held)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = arrow_schema(schema), []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    out += route(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(route(held), schema=arrow)

    return few.mapInArrow(run, schema)


def lettered(packed: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, letters): the edits of each run; what follows the last row is with its run."""
    own = packed.schema["runs"].dataType.elementType
    schema = T.StructType([packed.schema["conv_id"], own["turn"], own["role"], own["mark"], T.StructField("letters", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                tables = tables_of(row["runs"])
                ends = [0 if q == row["leave"] else NEVER for q in range(4)]
                states, out, at = [row["enter"], *crossings(tables, row["enter"], ends)], [], 0
                for r in row["runs"]:
                    letters = run_letters(r["role"][:1], r["fault"], r["times"], states[at:])
                    at += len(run_tables(r["role"][:1], r["fault"], r["times"]))
                    out.append({"conv_id": row["conv_id"], "turn": r["turn"], "role": r["role"], "mark": r["mark"], "letters": letters})
                if row["ends"]:
                    out[-1]["letters"] += END[states[-1]][1]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    met = packed.select("conv_id", "part", "nr", "runs").join(ways.select("part", "nr", "enter", "leave", "ends"), ["part", "nr"])
    return met.select("conv_id", "runs", "enter", "leave", "ends").mapInArrow(run, schema)


# --- repaired conversations ----------------------------------------------------------------------------------------


def in_order(conversations: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """Per conversation, in order: its totals, then for each run its letters and its text rows."""
    known = marked(rows)
    found = runs(known)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "turn", "role", "mark"]
    packed = cut(blocks(found.repartitionByRange(parts, *key).sortWithinPartitions(*key), block), "blocks")
    discard(found)
    ways = cut(routes(packed), "routes")

    turn = known.schema["turn"].dataType
    blank = {"turn": F.lit(None).cast(turn), "role": F.lit(None).cast("string"), "mark": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")}
    names = ["conv_id", "step", *key[1:], "letters", "text", *TOTALS]
    none = [F.lit(None).cast("long").alias(c) for c in TOTALS]
    empty = conversations.select("conv_id").distinct().select("conv_id", *[F.lit(0).cast("long").alias(c) for c in TOTALS])
    totals = ways.where("ends").select("conv_id", *TOTALS).union(empty).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in TOTALS])
    totals = totals.select("*", *[v.alias(c) for c, v in blank.items()], F.lit(0).alias("step"), F.lit(None).cast("string").alias("letters"))
    letters = lettered(packed, ways).select("*", F.lit(1).alias("step"), blank["text"].alias("text"), *none)
    texts = known.select(*key, "text", F.lit(1).alias("step"), F.lit(None).cast("string").alias("letters"), *none)
    every = totals.select(names).union(letters.select(names)).union(texts.select(names))
    # of one run the letters, which are not null, come first
    order = ["conv_id", "step", *[c for c in key[1:]], F.col("letters").isNull()]
    return every.repartition("conv_id").sortWithinPartitions(*order)


def replayed(ordered: DataFrame, schema: T.StructType, begin: Callable, turn: Callable, finish: Callable) -> DataFrame:
    """Apply the letters. ``begin(row)`` makes the state of a conversation, ``turn(held, letters, role, text)`` takes each turn
    that stays, ``finish(held)`` closes; turn and finish return rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        held, state, letters = None, NOTHING, None
        for whole in batches:
            for batch in chunks([whole]):
                out = []
                for row in batch.to_pylist():
                    if row["step"] == 0:
                        out += finish(held) if held is not None else []
                        held, state, letters = begin(row), NOTHING, None
                    elif row["letters"] is not None:
                        letters = row["letters"]
                    elif letters is not None:  # the first of a run's text rows; the others are gone
                        held["audit"].append(letters)
                        for letter in letters:
                            if letter == "I":
                                state = INSERTED[state]
                                out += turn(held, ROLE[state], "")
                            elif letter == "K":
                                state = KEPT[row["role"][:1], state]
                                out += turn(held, row["role"], row["text"])
                            elif letter == "R":
                                state = INSERTED[state]
                                out += turn(held, ROLE[state], row["text"])
                        letters = None
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist(finish(held), schema=arrow)

    return ordered.mapInArrow(run, schema)


def repaired(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, role, text): the repaired turns of ``rows`` (default: the conversations), places from 0."""
    ordered = in_order(conversations, conversations if rows is None else rows, block)
    text = [T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([ordered.schema["conv_id"], T.StructField("place", T.LongType()), *text])

    def turn(held: dict, role: str, text: str) -> list[dict]:
        held["place"] += 1
        return [{"conv_id": held["conv_id"], "place": held["place"], "role": role, "text": text}]

    return replayed(ordered, schema, lambda row: {"conv_id": row["conv_id"], "place": -1, "audit": []}, turn, lambda held: [])


def reports(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the SHA-256 of its repaired ``role:text`` lines.

    ``rows`` are the rows to repair (conv_id, turn, role, text and, if there, times), by default the conversations
    themselves; conversations without any have zeros, an empty audit and the hash of nothing.
    """
    ordered = in_order(conversations, conversations if rows is None else rows, block)
    longs = [T.StructField(c, T.LongType()) for c in TOTALS]
    schema = T.StructType([ordered.schema["conv_id"], *longs, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def begin(row: dict) -> dict:
        return {c: row[c] for c in ("conv_id", *TOTALS)} | {"audit": [], "hash": hashlib.sha256(), "turns": 0}

    def turn(held: dict, role: str, text: str) -> list[dict]:
        held["hash"].update(f"{chr(10) if held['turns'] else ''}{role}:{text}".encode())
        held["turns"] += 1
        return []

    def finish(held: dict) -> list[dict]:
        return [{c: held[c] for c in ("conv_id", *TOTALS)} | {"audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}]

    return replayed(ordered, schema, begin, turn, finish)
