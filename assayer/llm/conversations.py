"""Conversation repair: the cheapest edits that give a conversation the shape system?, (user, assistant)+.

Turns are aligned to the alternating string of every feasible length by Wagner-Fischer, inside Ukkonen's band of the best cost so far; of
equally cheap alignments the backtraced audit that comes first in ASCII order wins.

A conversation is aligned in blocks of ``BLOCK`` turns, so that one which holds a third of all rows is the work of many tasks. The grammar
has four states between turns (nothing yet, after the system turn, after a user turn, after an assistant turn); of a block and each pair
of states the cheapest alignment and its audit are kept. An audit of a block has one letter a turn beside its insertions and ends with a
turn's letter, as insertions count to the turn that follows them; so no audit of a block is the beginning of another, and the least
audit of a conversation is made of the least ones of its blocks. What one task holds of a conversation are these blocks, no more than a small
multiple of the audit, which is one value of the result; the texts stream by.

Rows: null role and text count as one space. Rows are ordered by turn, nulls first, then by role and text in byte order; so repeated rows
are adjacent, and all but the first are duplicates. A role other than one that begins with s, u or a, the empty one included, can only be
replaced or deleted; a role is kept as it is written if its initial fits. A null conv_id is a conversation of its own. Texts may be of any
length. Columns other than the four are left alone, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from assayer.llm.text import emit, parts, rows
from assayer.plans.store import Scratch

#: Turns that are aligned at once.
BLOCK = 16
#: Patterns of blocks whose alignments a worker keeps.
KEPT_PATTERNS = 50_000

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What has to be inserted at the end, by state.
ENDING = ("", "II", "I", "")
BLANK, DUPLICATE, CUT = 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"


def _feasible(state: int, system: bool, length: int) -> tuple[str, int]:
    """The target of one length that continues the grammar from a state, and the state it leads to."""
    first = "a" if state == USER else "u"
    n = length - system
    body = ((first + ("u" if first == "a" else "a")) * (n // 2 + 1))[:n]
    last = body[-1:] or ("s" if system else "")
    return "s" * system + body, {"u": USER, "a": ASSISTANT, "s": SYSTEM, "": state}[last]


def _least(n_rows: int, n_targets: int) -> int:
    """What the difference of two lengths costs at least."""
    return INSERT * (n_targets - n_rows) if n_targets > n_rows else DELETE * (n_rows - n_targets)


def _align(block: str, target: str, bound: float) -> tuple[int, str] | None:
    """The least cost of an alignment that ends with a turn, not above ``bound``, and its least audit.

    A block has a letter a turn: d must go, s, u, a and x are what role it has, in capitals if it is truncated.
    """
    n, m, never = len(block), len(target), 1 << 60
    ahead = [[never] * (m + 1) for _ in range(n + 1)]
    ahead[n][m] = 0
    for i in range(n - 1, -1, -1):
        turn, own, below = block[i], ahead[i], ahead[i + 1]
        extra = TRUNCATED if turn.isupper() else 0
        for j in range(m, -1, -1):
            if _least(i, j) + _least(n - i, m - j) > bound:
                continue
            best = below[j] + DELETE
            if j < m:
                want = target[j]
                if turn != "d":
                    if turn.lower() == want:
                        best = min(best, below[j + 1] + extra)
                    elif want != "s":
                        best = min(best, below[j + 1] + REROLE + extra)
                if want != "s":
                    best = min(best, own[j + 1] + INSERT)
            own[j] = best
    if ahead[0][0] > bound or ahead[0][0] >= never:
        return None
    audit, i, j = [], 0, 0
    while i < n:
        left, turn = ahead[i][j], block[i]
        if left == ahead[i + 1][j] + DELETE:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and left == ahead[i][j + 1] + INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turn.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return ahead[0][0], "".join(audit)


@functools.lru_cache(KEPT_PATTERNS)
def transfers(block: str) -> tuple[list[int | None], list[str | None]]:
    """Costs and audits of a block from each state to each, at 4 * from + to; no value where no alignment leads there."""
    n, costs, audits = len(block), [None] * 16, [None] * 16
    for state in range(4):
        for system in (False, True) if state == START and "s" in block.lower() else (False,):
            # from the turns' own number outwards, until the difference alone costs more than the best so far of every state
            idle = 0  # neighbouring lengths lead to different states
            for by in range(2 * n + 2):
                idle += 1
                for length in {n - by, n + by}:
                    if length < system:
                        continue
                    target, to = _feasible(state, system, length)
                    at = 4 * state + to
                    bound = float("inf") if costs[at] is None else costs[at]
                    if _least(n, length) > bound:
                        continue
                    idle = 0
                    found = _align(block, target, bound)
                    if found and (costs[at] is None or found < (costs[at], audits[at])):
                        costs[at], audits[at] = found
                if idle > 2:
                    break
    return costs, audits


def solve(blocks: list[tuple[list, list]]) -> tuple[int, Iterator[str]]:
    """The least cost over a conversation's blocks, and its least audit block by block."""
    never = 1 << 60
    left = [[len(e) * INSERT for e in ENDING]]
    for costs, _ in reversed(blocks):
        after = left[-1]
        left.append([min(never if costs[4 * s + t] is None else costs[4 * s + t] + after[t] for t in range(4)) for s in range(4)])

    def audit() -> Iterator[str]:
        state = START
        for k, (costs, audits) in enumerate(blocks):
            now, after = left[-1 - k], left[-2 - k]
            best, state = min((audits[4 * state + t], t) for t in range(4) if costs[4 * state + t] is not None and costs[4 * state + t] + after[t] == now[state])
            yield best
        yield ENDING[state]

    return left[-1][START], audit()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone``: rows damaged by a checksum of their place, for tests of the repair.

    Of 20 remainders 0 drops the row (it stays, without a text, as ``gone``), 1 empties it, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, and 4 makes it a user's.
    """
    blank = F.lit(" ")
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    c = c.withColumn("_k", F.crc32(key) % 20)
    is_ = lambda k: F.col("_k") == k
    text = F.when(is_(0) | is_(1), "").when(is_(2), F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    c = c.withColumns({"role": F.when(is_(4), "user").otherwise(F.col("role")), "text": text, "gone": is_(0)})
    return c.withColumn("_copy", F.explode(F.when(is_(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_copy")


def _faults(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``fault``, but for duplicates inside one turn, and ``digest`` of role and text."""
    there = F.rtrim("text", F.lit(_SPACE))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    t = turns.withColumns({"digest": F.unhex(digest), "fault": F.when(there == "", BLANK).when(~F.right(there, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)})
    # a null turn is the first of all
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn")))
    seen = t.where(~F.col("gone") & (F.col("fault") != BLANK)).groupBy("conv_id", "digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "first")
    met = t.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when((F.col("fault") != BLANK) & later & ~F.col("gone"), DUPLICATE).otherwise(F.col("fault"))
    return scratch.keep(met.withColumn("fault", fault).drop("_c", "_d", "first"), "turns", codec="lz4")


#: Characters of role and text by which rows are dealt to ranges of the order.
_PREFIX = 32


def _cuts() -> list[Column]:
    """A coarser order than that of the rows, whose values are short."""
    whole = F.length("role") <= _PREFIX
    return [F.col("conv_id"), F.col("turn"), F.left("role", F.lit(_PREFIX)), ~whole, F.when(whole, F.left("text", F.lit(_PREFIX))).otherwise("")]


def _wire(conv: StructField) -> StructType:
    more = [("kind", IntegerType()), ("part", IntegerType()), ("at", LongType()), ("turn", LongType()), ("role", StringType()), ("text", StringType()), ("fault", IntegerType())]
    more += [("costs", ArrayType(IntegerType())), ("audits", ArrayType(StringType()))]
    return StructType([conv, *(StructField(n, t) for n, t in more)])


#: Kinds of rows on the way to a conversation's task, in the order in which it needs them.
_OF_BLOCK, _OF_TURN, _OF_GONE = range(3)
_LETTER = {"s": "s", "u": "u", "a": "a"}


def _blocks(ordered: DataFrame, conv: StructField) -> DataFrame:
    """Turns in order with their places, and the transfers of each block of them; a block never leaves its task."""
    wire = _wire(conv)
    arrow = to_arrow_schema(wire)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, conv_now, letters, last = [], 0, object(), [], None

        def close() -> None:
            if letters:
                out.append((conv_now, _OF_BLOCK, part, at, None, None, None, None, *transfers("".join(letters))))
                letters.clear()

        part = None
        for piece in parts(batches, "text"):
            for conv_id, turn, role, text, gone, digest, fault, part_ in rows([piece]):
                if conv_id != conv_now or part is None:
                    close()
                    conv_now, last = conv_id, None
                part = part_
                if gone:
                    out.append((conv_id, _OF_GONE, part, at, None, None, None, None, None, None))
                    continue
                at += 1
                if fault != BLANK and last == (turn, digest):
                    fault = DUPLICATE
                last = (turn, digest)
                letter = "d" if fault in (BLANK, DUPLICATE) else _LETTER.get(role[:1], "x")
                letters.append(letter.upper() if fault == CUT else letter)
                out.append((conv_id, _OF_TURN, part, at, turn, role, text, fault, None, None))
                if len(letters) == BLOCK:
                    close()
            yield emit(out, arrow)
            out = []
        close()
        yield emit(out, arrow)

    return ordered.mapInArrow(cut, wire)


#: One row a conversation, at place -1, and one a turn that is left or new.
_SUMMARY = [(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", StringType())]


def _edited(dealt: DataFrame, conv: StructField) -> DataFrame:
    schema = StructType([conv, StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType()), *(StructField(n, t) for n, t in _SUMMARY)])
    arrow = to_arrow_schema(schema)

    class Conversation:
        def __init__(self, conv_id):
            self.id, self.blocks, self.edits, self.audit, self.place = conv_id, [], None, [], 0
            self.faults, self.illegal, self.turns, self.first, self.last, self.initial, self.next = [0, 0, 0, 0], 0, 0, None, None, None, "user"

        def put(self, out: list, role: str, text: str) -> None:
            out.append((self.id, self.place, role, text, *[None] * 7))
            self.place += 1
            self.next = "assistant" if role[:1] == "u" else "user"

        def inserts(self, out: list) -> str:
            """Passes over insertions to the next turn's letter."""
            for letter in self.edits:
                self.audit.append(letter)
                if letter != "I":
                    return letter
                self.put(out, self.next, "")
            return ""

        def turn(self, out: list, turn, role: str, text: str, fault: int) -> None:
            if self.edits is None:
                self.cost, found = solve(self.blocks)
                self.edits, self.blocks = (x for b in found for x in b), None
            self.faults[fault] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None:
                self.turns += turn != self.last
                self.first = turn if self.first is None else self.first
                self.last = turn
            letter = self.inserts(out)
            if letter != "D":
                self.put(out, role if letter == "K" else self.next, text)

        def close(self, out: list) -> None:
            cost = 0
            if self.edits is not None:
                self.inserts(out)
                cost = self.cost
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            out.append((self.id, -1, None, None, gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit)))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for piece in parts(batches, "text"):
            out: list = []
            for conv_id, kind, _, _, turn, role, text, fault, costs, audits in rows([piece]):
                if now is None or now.id != conv_id:
                    if now is not None:
                        now.close(out)
                    now = Conversation(conv_id)
                if kind == _OF_BLOCK:
                    now.blocks.append((costs, audits))
                elif kind == _OF_TURN:
                    now.turn(out, turn, role, text, fault)
            yield emit(out, arrow)
        if now is not None:
            out = []
            now.close(out)
            yield emit(out, arrow)

    return dealt.mapInArrow(edit, schema)


def repair(turns: DataFrame) -> DataFrame:
    """Repaired turns (conv_id, place, role, text), and one row a conversation at place -1 with its faults, cost and audit.

    ``turns`` has conv_id, turn, role, text and, for rows that only say that there is such a conversation, ``gone``. Rows of a
    conversation follow each other in their task, in order, its summary last.
    """
    conv = StructField("conv_id", turns.schema["conv_id"].dataType)
    scratch = Scratch(turns.sparkSession, "conversations")
    marked = _faults(turns, scratch).select("conv_id", "turn", "role", "text", "gone", "digest", "fault")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = marked.repartitionByRange(*_cuts()).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = _blocks(ordered, conv).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "at")
    return _edited(dealt, conv)


def report(repaired: DataFrame) -> DataFrame:
    """One row a conversation: what ``repair`` says of it, and the SHA-256 of its repaired turns as role:text lines."""
    schema = StructType([repaired.schema["conv_id"], *(StructField(n, t) for n, t in _SUMMARY), StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256()
        for piece in parts(batches, "text"):
            out = []
            for conv_id, place, role, text, *summary in rows([piece]):
                if place < 0:
                    out.append((conv_id, *summary, sha.hexdigest()))
                    sha = hashlib.sha256()
                else:
                    sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield emit(out, arrow)

    return repaired.mapInArrow(digest, schema)
