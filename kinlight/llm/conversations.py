"""Repair of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``, with an audit.

Each row is a symbol: the initial of its role, and whether it is blank, a duplicate, cut short or sound. The
cheapest way to the end from each state of the role pattern is a vector of costs. Less its least entry, a vector
is a state of an automaton that is determinised while it is used: states and transitions come into a table when a
conversation first needs them, and since the vectors' entries differ by a bounded number, the table stays small.
One scan over the symbols from last to first adds up costs; a trace in the other direction follows tight arcs, the
least letter first, and writes the audit.

On Spark: rows are numbered in order with ranges over (conversation, turn), so a long conversation is many tasks'
work; first occurrences are a map-side combined minimum; symbols are gathered in two steps, of which the second
brings one or two characters a row to a conversation, which is what its audit takes as one value, too. Texts are
shuffled once, to be read in order beside the audit. SHA-256 can't be put together from parts, so that one step
streams a conversation's texts through one task, a batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from kinlight.llm import common
from kinlight.plans.lineage import cut
from kinlight.plans.numbering import numbered

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
#: Rows whose symbols are put together at once before a conversation's are.
CHUNK_ROWS = 1 << 16

#: The role pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: What an inserted or renamed row becomes in each state: its role and the state behind it.
NEXT = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
INITIALS = "sua?"
SOUND, CUT_SHORT, BLANK, DUPLICATE = range(4)
LEGAL = {"su", "ua", "au"}
#: The mark behind the first of equal rows, after the symbols in order.
FIRST = 16


class RepairAutomaton:
    """The determinised automaton of costs to the end, read from the last row to the first, and its tight arcs.

    ``costs[q]`` is the vector of state q; ``table[q][x]`` is (the state before symbol x, what all costs rise by);
    ``arcs[q][x][s]`` is (edits from pattern state s up to and with the row x, the pattern state behind it), the
    least letters among the cheapest. All are filled when first asked for.
    """

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.arcs: list[list[list[tuple[str, int]] | None]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.last = self._state(self._with_inserts([0 if s in ENDS else 1 << 40 for s in range(4)]))

    def _state(self, costs: list[int]) -> int:
        key = tuple(costs)
        if key not in self.known:
            self.known[key] = len(self.costs)
            self.costs.append(key)
            self.table.append([None] * 16)
            self.arcs.append([None] * 16)
        return self.known[key]

    @staticmethod
    def _with_inserts(costs: list[int]) -> list[int]:
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[s][1]]) for s, c in enumerate(costs)]
        return costs

    @staticmethod
    def _moves(x: int, s: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state behind) of the edits of a row in a pattern state, by letter."""
        initial, fault = INITIALS[x // 4], x % 4
        moves = [("D", DELETE, s)]
        if fault in (SOUND, CUT_SHORT):
            more = TRUNCATED if fault == CUT_SHORT else 0
            if (s, initial) in STEPS:
                moves.append(("K", more, STEPS[s, initial]))
            moves.append(("R", REROLE + more, NEXT[s][1]))
        return moves

    def _fill(self, q: int, x: int) -> tuple[int, int]:
        after = self.costs[q]
        here = self._with_inserts([min(c + after[t] for _, c, t in self._moves(x, s)) for s in range(4)])
        arcs = []
        for s in range(4):
            edits, at = "", s
            while True:
                tight = [(m, t) for m, c, t in self._moves(x, at) if c + after[t] == here[at]]
                if INSERT + here[NEXT[at][1]] == here[at]:
                    tight.append(("I", at))
                letter, t = min(tight)
                edits += letter
                if letter != "I":
                    break
                at = NEXT[at][1]
            arcs.append((edits, t))
        least = min(here)
        self.arcs[q][x] = arcs
        self.table[q][x] = found = (self._state([c - least for c in here]), least)
        return found

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost of a conversation's symbols and its audit; of several, the one that sorts first."""
        q, cost, visited = self.last, 0, array("H", bytes(2 * len(symbols)))
        table = self.table
        for i in range(len(symbols) - 1, -1, -1):
            visited[i] = q
            q, more = table[q][symbols[i]] or self._fill(q, symbols[i])
            cost += more
        cost += self.costs[q][0]
        s, audit, arcs = 0, [], self.arcs
        for q, x in zip(visited, symbols, strict=True):
            edits, s = arcs[q][x][s]
            audit.append(edits)
        while s not in ENDS:
            audit.append("I")
            s = NEXT[s][1]
        return cost, "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    takes its ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes it the user's. Nulls read as one space."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", of("conv_id"), of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def _plain(rows: DataFrame) -> DataFrame:
    """The four columns, nulls as one space, with a digest of role and text that also orders rows of one turn."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)))


def _code() -> Column:
    """A row's symbol, but for duplicates."""
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(said == "", BLANK).when(F.instr(F.lit(".!?"), F.right(said, F.lit(1))) == 0, CUT_SHORT).otherwise(SOUND)
    place = F.instr(F.lit(INITIALS[:3]), F.left("role", F.lit(1)))
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    return (initial * 4 + fault).cast("int")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id and the symbols of its rows by turn, one character each, with a mark behind the first of equal rows."""
    features = cut(_plain(rows).select("conv_id", "turn", "digest", _code().alias("code"), F.monotonically_increasing_id().alias("uid")))
    placed, _ = numbered(features, ["conv_id", "turn", "digest", "uid"])
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("row_no").alias("row_no"))
    pairs = placed.select("conv_id", "row_no", "code").unionByName(firsts.select("conv_id", "row_no", F.lit(FIRST).alias("code")))
    pairs = pairs.withColumn("chunk", F.floor(F.col("row_no") / CHUNK_ROWS))

    def joined(parts: Column, field) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), field), "")

    pieces = pairs.groupBy("conv_id", "chunk").agg(joined(F.struct("row_no", "code"), lambda p: F.char(p["code"] + 65)).alias("codes"))
    return pieces.groupBy("conv_id").agg(joined(F.struct("chunk", "codes"), lambda p: p["codes"]).alias("codes"))


_ROW = re.compile("([A-P])(Q?)")


def symbols_of(codes: str) -> bytes:
    """Symbols from their characters; what has no mark behind it and isn't blank is a duplicate."""
    return bytes(x if first or x % 4 == BLANK else x - x % 4 + DUPLICATE for x, first in ((ord(m[1]) - 65, m[2]) for m in _ROW.finditer(codes)))


def illegal_pairs(symbols: bytes) -> int:
    roles = "".join(INITIALS[x // 4] for x in symbols)
    return sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = RepairAutomaton()
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for codes in batch.column("codes").to_pylist():
            symbols = symbols_of(codes)
            faults = [sum(map(symbols.count, range(f, 16, 4))) for f in (BLANK, DUPLICATE, CUT_SHORT)]
            for column, value in zip(columns, [*faults, illegal_pairs(symbols), *automaton.repair(symbols)], strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], ["conv_id", *_COUNTS, "audit"])


def plans(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows(conv_id, turn, role, text)``: conv_id, blank, duplicate, truncated, illegal,
    cost and audit.

    Rows go by turn, nulls first, and those of one turn by a digest of role and text. A null role or text reads as
    one space; a null conv_id is a conversation of its own. A row's first fault counts: blank, duplicate of an
    earlier role and text, truncated (its last character that isn't white isn't one of ``.!?``). Audit letters:
    K keeps a row (0), R gives it the user's or assistant's role (2), D deletes it (3, the only way for blank and
    duplicate rows), I inserts an empty row (2); a truncated row that stays adds 1. Equal rows are interchangeable.
    An empty table gives no row; more columns don't matter, whatever their names.
    """
    kind = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *(StructField(c, LongType()) for c in _COUNTS), StructField("audit", StringType())])
    return coded(rows).mapInArrow(_planned, schema)


def _in_order(rows: DataFrame, planned: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids, plans and rows, each conversation's together and in this order."""
    common.small_text_batches(rows.sparkSession)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    empty = {c: F.lit(None).cast("long") for c in counts[:5]} | {"audit": F.lit(None).cast("string")}
    texts = _plain(rows).withColumns({"kind": F.lit(2)} | empty)
    blank = {"turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "digest": F.lit(None).cast("binary")}
    heads = planned.withColumns({"kind": F.lit(1)} | blank)
    named = ids.select("conv_id").distinct().withColumns({"kind": F.lit(0)} | blank | empty)
    together = texts.unionByName(heads).unionByName(named)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest").select("conv_id", "kind", "turn", "role", "text", *counts)


class _Conversation:
    """One conversation while its rows stream by: its audit, its place in it, and the state of the pattern."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.plan, self.at, self.state = conv_id, [0, 0, 0, 0, 0, ""], 0, 0
        self.turns, self.first, self.last = 0, None, None

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        audit = self.plan[5]
        while audit.startswith("I", self.at):
            role, self.state = NEXT[self.state]
            self.at += 1
            yield "I", role, ""

    def row(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what becomes of a row, with what is inserted before it."""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        yield from self.inserted()
        edit = self.plan[5][self.at]
        self.at += 1
        if edit == "R":
            role, self.state = NEXT[self.state]
        elif edit == "K":
            self.state = STEPS[self.state, role[0]]
        if edit != "D":
            yield edit, role, text

    def gaps(self) -> int:
        return 0 if self.first is None else int(self.last) - int(self.first) + 1 - self.turns


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, list[tuple[str, str, str]], bool]]:
    """Conversations with what each row becomes, and whether that was the last of it."""
    now = None
    for batch in batches:
        names = batch.schema.names
        for conv_id, kind, turn, role, text, *plan in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now, list(now.inserted()), True
                now = _Conversation(conv_id)
            if kind == 1:
                now.plan = plan
            elif kind == 2:
                yield now, list(now.row(turn, role, text)), False
    if now is not None:
        yield now, list(now.inserted()), True


def _hashed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        digest, empty = hashlib.sha256(), True
        for conversation, turns, over in _events(batches):
            for _, role, text in turns:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if over:
                done.append([conversation.conv_id, conversation.gaps(), *conversation.plan, digest.hexdigest()])
                digest, empty = hashlib.sha256(), True
                if len(done) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def _turns(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        place = held = 0
        for conversation, turns, over in _events(batches):
            for edit, role, text in turns:
                done.append((conversation.conv_id, place, edit, role, text))
                place, held = place + 1, held + len(text) + 64
            place = 0 if over else place
            if held > common.SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done, held = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def _schemas(kind: DataType, fields: list[tuple[str, DataType]]) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    made = StructType([StructField("conv_id", kind), *(StructField(n, t) for n, t in fields)])
    return made, to_arrow_schema(made)


def repaired(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text, as :func:`plans` says.
    Deleted rows are left out."""
    planned = cut(plans(rows)) if planned is None else planned
    schema, arrow = _schemas(rows.schema["conv_id"].dataType, [("place", LongType()), ("edit", StringType()), ("role", StringType()), ("text", StringType())])
    return _in_order(rows, planned, planned).mapInArrow(common.trimmed(_turns(arrow)), schema)


def reports(rows: DataFrame, ids: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """For each conversation of ``ids``: what :func:`plans` says, the turns that are missing (gaps), and the SHA-256
    of the repaired ``role:text``, joined by newlines. One without rows has zeros and the hash of nothing."""
    planned = cut(plans(rows)) if planned is None else planned
    fields = [("gaps", LongType()), *((c, LongType()) for c in _COUNTS), ("audit", StringType()), ("repaired_sha256", StringType())]
    schema, arrow = _schemas(rows.schema["conv_id"].dataType, fields)
    return _in_order(rows, planned, ids).mapInArrow(common.trimmed(_hashed(arrow)), schema)
