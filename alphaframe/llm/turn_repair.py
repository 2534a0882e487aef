"""Repair of the turn structure of conversations: the cheapest edits that make roles alternate.

Rows are dealt by conversation and sorted by turn, and each task streams through its conversations. A
dynamic program over four states (start, after system, after user, after assistant) goes on from batch
to batch: per state the least cost of all edits so far, and the order of the edit strings that reach it.
What it needs to find its way back is one byte per state and row. Costs are kept relative to the least, so
few different situations exist, and each step is looked up once computed.

Conversations of moderate size are held until they end and repaired at once. Of giant ones the first pass
spills the bytes, in pieces, to a stored table in the shared folder; a second pass walks the pieces
backwards, and a third streams the rows again beside the edits found. No task ever holds the rows of a
giant conversation, and each pass starts from stored tables if an executor is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, stored

WORD_MARK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
HOLD_ROWS = 1 << 16
HOLD_CHARS = 1 << 24
PIECE = 1 << 16  # rows whose way back is one spilled piece
OUT = 4096  # rows handed out at once

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
FINE, TRUNCATED, BAD = range(3)  # BAD: blank or duplicate, has to go
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Roles an inserted or rerolled turn takes in each state, and the state after it.
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def edits_of(state: int, initial: int, fault: int) -> Iterable[tuple[str, int, int]]:
    """Edit string, cost and next state of each way to get past one row; up to two turns are inserted before it."""
    before, cost, at = "", 0, state
    for _ in range(3):
        yield before + DELETE, cost + DELETE_COST, at
        if fault != BAD:
            extra = cost + (TRUNCATED_COST if fault == TRUNCATED else 0)
            if initial == AFTER[at] or (at == START and initial == SYSTEM):
                yield before + KEEP, extra, initial
            yield before + REROLE, extra + REROLE_COST, AFTER[at]
        before, cost, at = before + INSERT, cost + INSERT_COST, AFTER[at]


#: Per state: relative cost and the place of its edit string among those of all states, or None where it can't be reached.
Situation = tuple[tuple[int, int] | None, ...]
FIRST: Situation = ((0, 0), None, None, None)
STEPS = ["D", "K", "R", "ID", "IK", "IR", "IID", "IIK", "IIR"]
BACK = {s: k for k, s in enumerate(STEPS)}


class Steps:
    """The dynamic program's steps, each computed once: (situation, initial, fault) to situation, cost, way back.

    Strings that end states at one row differ before their end and none starts another, so their order
    goes on to hold whatever follows; that is why places stand for whole strings.
    """

    def __init__(self) -> None:
        self.numbers: dict[Situation, int] = {FIRST: 0}
        self.situations: list[Situation] = [FIRST]
        self.known: dict[tuple[int, int, int], tuple[int, int, bytes]] = {}

    def step(self, number: int, initial: int, fault: int) -> tuple[int, int, bytes]:
        found = self.known.get((number, initial, fault))
        if found is None:
            found = self.known[number, initial, fault] = self._computed(self.situations[number], initial, fault)
        return found

    def _computed(self, now: Situation, initial: int, fault: int) -> tuple[int, int, bytes]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, reached in enumerate(now):
            if reached is None:
                continue
            for edit, cost, to in edits_of(state, initial, fault):
                way = (reached[0] + cost, reached[1], edit, state)
                if to not in best or way < best[to]:
                    best[to] = way
        least = min(w[0] for w in best.values())
        order = {to: k for k, (to, _) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3]))}
        after: Situation = tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4))
        back = bytes(best[s][3] * 16 + BACK[best[s][2]] if s in best else 255 for s in range(4))
        if after not in self.numbers:
            self.numbers[after] = len(self.situations)
            self.situations.append(after)
        return self.numbers[after], least, back

    def ending(self, number: int) -> tuple[int, int, int]:
        """Cost, last state and number of turns inserted at the end; after them the conversation is empty or ends with an assistant."""
        ways = []
        for state, reached in enumerate(self.situations[number]):
            at = state
            for more in range(3) if reached is not None else ():
                if at in (START, ASSISTANT):
                    ways.append((reached[0] + INSERT_COST * more, reached[1], more, state))
                at = AFTER[at]
        cost, _, more, state = min(ways)
        return cost, state, more


def walked_back(back: bytes, state: int) -> tuple[list[str], int]:
    """The edit strings of the rows whose way back this is, in order, and the state before the first."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        step = back[at + state]
        out.append(STEPS[step & 15])
        state = step >> 4
    return out[::-1], state


def repaired(audit: Iterable[str], rows: Iterable[tuple[str | None, str, str]]) -> Iterator[tuple[str, str | None, str, str]]:
    """(edit, turn, role, text) of all turns that stand after the edits; inserted ones have no turn."""
    state, rows = START, iter(rows)
    for edit in audit:
        turn, role, text = next(rows) if edit != INSERT else (None, "", "")
        if edit == DELETE:
            continue
        state = INITIAL[role[:1]] if edit == KEEP else AFTER[state]
        yield edit, turn, role if edit == KEEP else NAMES[state], text


class Conversation:
    """What one pass knows of the conversation it is in."""

    def __init__(self, steps: Steps) -> None:
        self.steps, self.number, self.cost = steps, 0, 0
        self.back = bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: str | None, role: str, fault: str | None) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        if fault is not None:
            self.counts[fault] += 1
        kind = FINE if fault is None else TRUNCATED if fault == "truncated" else BAD
        self.number, cost, back = self.steps.step(self.number, INITIAL.get(initial, -1), kind)
        self.cost += cost
        self.back += back

    def gaps(self) -> int:
        return int(self.last_turn) - int(self.first_turn) + 1 - self.turns if self.turns else 0

    def figures(self, cost: int) -> dict:
        return {"gaps": self.gaps(), **self.counts, "cost": self.cost + cost}


TURNS = "key string, position long, edit string, turn string, role string, text string"
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "key string, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string"
PIECES = "key string, piece long, back binary, state int, more int, " + ", ".join(f"{c} long" for c in FIGURES)


class Writer:
    """Hands out repaired turns or reports as frames of bounded size; a report hashes the turns as they pass."""

    def __init__(self, turns: bool) -> None:
        self.turns, self.rows = turns, []

    def put(self, key: str, figures: dict, audit: str, rows: Iterable[tuple[str | None, str, str]]) -> Iterator[pd.DataFrame]:
        digest = hashlib.sha256()
        for k, (edit, turn, role, text) in enumerate(repaired(audit, rows)):
            if self.turns:
                self.rows.append((key, k, edit, turn, role, text))
                if len(self.rows) >= OUT:
                    yield from self.frames()
            else:
                digest.update((f"\n{role}:{text}" if k else f"{role}:{text}").encode())
        if not self.turns:
            self.rows.append((key, *(figures[c] for c in FIGURES), audit, digest.hexdigest()))
            if len(self.rows) >= OUT:
                yield from self.frames()

    def frames(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            schema = TURNS if self.turns else REPORT
            yield pd.DataFrame(self.rows, columns=[c.split()[0] for c in schema.split(", ")])
            self.rows = []


def streamed(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in columns), strict=True)


def held(turns: bool):
    """Conversations of moderate size, each held until it ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, writer = Steps(), Writer(turns)

        def ended(now: Conversation, key: str, rows: list) -> Iterator[pd.DataFrame]:
            cost, state, more = steps.ending(now.number)
            audit = "".join(walked_back(bytes(now.back), state)[0]) + INSERT * more
            yield from writer.put(key, now.figures(cost), audit, rows)

        now, key, rows, seen = None, None, [], set()
        for k, turn, role, text, fault in streamed(batches, "key", "turn", "role", "text", "fault"):
            if now is None or k != key:
                if now is not None:
                    yield from ended(now, key, rows)
                now, key, rows, seen = Conversation(steps), k, [], set()
            if fault != "blank":
                if (role, text) in seen:
                    fault = "duplicate"
                seen.add((role, text))
            now.add(turn, role, fault)
            rows.append((turn, role, text))
        if now is not None:
            yield from ended(now, key, rows)
        yield from writer.frames()

    return run


def spilled(piece: int):
    """First pass over giant conversations: pieces of the way back, and the figures with the last one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = Steps()
        names = [c.split()[0] for c in PIECES.split(", ")]
        now, key, place, last = None, None, 0, None

        def out(end: bool) -> pd.DataFrame:
            cost, state, more = steps.ending(now.number) if end else (0, -1, -1)
            figures = now.figures(cost) if end else dict.fromkeys(FIGURES, 0)
            row = (key, place, bytes(now.back), state, more, *(figures[c] for c in FIGURES))
            now.back = bytearray()
            return pd.DataFrame([row], columns=names)

        for k, turn, role, fault, digest, earlier in streamed(batches, "key", "turn", "role", "fault", "digest", "earlier"):
            if now is None or k != key:
                if now is not None:
                    yield out(True)
                now, key, place, last = Conversation(steps), k, 0, None
            # Equal rows of one turn lie side by side.
            if fault != "blank" and (earlier or last == (turn, digest)):
                fault = "duplicate"
            last = (turn, digest)
            now.add(turn, role, fault)
            if len(now.back) >= 4 * piece:
                yield out(False)
                place += 1
        if now is not None:
            yield out(True)

    return run


def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second pass: pieces of a conversation from the last to the first give their edits."""
    key, state = None, 0
    for k, piece, back, end, more in streamed(batches, "key", "piece", "back", "state", "more"):
        if k != key:
            key, state = k, end
        edits, state = walked_back(back, state)
        yield pd.DataFrame([(k, piece, "".join(edits) + INSERT * max(0, more))], columns=["key", "piece", "audit"])


def rejoined(turns: bool):
    """Third pass: the edits of a conversation come first, then its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = Writer(turns)
        source = streamed(batches, "key", "tag", "audit", "turn", "role", "text", *FIGURES)
        first = next(source, None)
        while first is not None:
            key, parts, figures, row = first[0], [], {}, first
            while row is not None and row[0] == key and row[1] == 0:
                parts.append(row[2])
                figures = dict(zip(FIGURES, row[6:], strict=True))  # those of the last piece
                row = next(source, None)
            after: list = [None]

            def rows(row=row, key=key, after=after) -> Iterator[tuple]:
                while row is not None and row[0] == key:
                    yield row[3:6]
                    row = next(source, None)
                after[0] = row

            own = rows()
            yield from writer.put(key, figures, "".join(parts), own)
            for _ in own:  # none is left but for the end of the conversation
                pass
            first = after[0]
        yield from writer.frames()

    return run


def sorted_rows(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.asc_nulls_first("turn"), "role", "text")


def keyed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Numbers as text, which a pandas column holds whole beside nulls; a null conversation has a mark of its own."""
    return df.select(F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("key"), *columns)


def prepared(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text and fault (blank or truncated; duplicates are found in the stream)."""
    rows = only(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    fault = F.when(~F.col("text").rlike(WORD_MARK), "blank").when(~F.col("text").rlike(ENDED), "truncated")
    return rows.withColumn("fault", fault)


def _repair(conversations: DataFrame, turns: bool, id_col: str, turn_col: str, role_col: str, text_col: str,
            hold_rows: int, hold_chars: int, piece: int) -> DataFrame:
    rows = prepared(conversations, id_col, turn_col, role_col, text_col)
    schema = TURNS if turns else REPORT
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    giants = stored(sizes.where((F.col("rows") > hold_rows) | (F.col("chars") > hold_chars)).select(F.col("conv_id").alias("giant"), F.lit(True).alias("is")))
    small, light = rows, ["turn", "role", "text", "fault"]
    if giants.isEmpty():
        out = keyed(sorted_rows(small), F.col("turn").cast("string").alias("turn"), *light[1:]).mapInPandas(held(turns), schema)
    else:
        same = F.col("conv_id").eqNullSafe(F.col("giant"))
        small, large = rows.join(giants, same, "left_anti"), stored(rows.join(giants, same, "left_semi"))
        out = keyed(sorted_rows(small), F.col("turn").cast("string").alias("turn"), *light[1:]).mapInPandas(held(turns), schema)
        # Where a row and text came first; equal rows combine before they move.
        digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
        marked = large.withColumn("digest", digest)
        order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        firsts = stored(marked.where("fault IS NULL OR fault <> 'blank'").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
            F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("c", "d", "first"))
        marked = marked.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").select(
            "conv_id", *light, "digest", F.coalesce(order > F.col("first"), F.lit(False)).alias("earlier"))
        pieces = stored(keyed(sorted_rows(marked), F.col("turn").cast("string").alias("turn"), "role", "fault", "digest", "earlier").mapInPandas(spilled(piece), PIECES))
        audits = stored(pieces.repartition("key").sortWithinPartitions("key", F.desc("piece")).select("key", "piece", "back", "state", "more")
                        .mapInPandas(traced, "key string, piece long, audit string"))
        figures = [F.col(c) for c in FIGURES]
        lead = audits.join(pieces.select("key", "piece", *figures), ["key", "piece"]).select(
            "key", F.lit(0).alias("tag"), "piece", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), *figures)
        body = keyed(large, F.lit(1).alias("tag"), F.lit(0).cast("long").alias("piece"), F.lit("").alias("audit"), "turn", "role", "text",
                     *(F.lit(0).cast("long").alias(c) for c in FIGURES))
        both = lead.union(body).repartition("key").sortWithinPartitions("key", "tag", "piece", F.asc_nulls_first("turn"), "role", "text")
        out = out.union(both.select("key", "tag", "audit", F.col("turn").cast("string").alias("turn"), "role", "text", *FIGURES)
                        .mapInPandas(rejoined(turns), schema))
    kind = conversations.schema[id_col].dataType
    own = F.when(F.col("key") == "n", F.lit(None)).otherwise(F.substring("key", 2, 1 << 30).cast(kind)).alias("conv_id")
    return out.select(own, *(c for c in out.columns if c != "key"))


def repaired_turns(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    hold_rows: int = HOLD_ROWS, hold_chars: int = HOLD_CHARS, piece: int = PIECE,
) -> DataFrame:
    """The turns after repair: conv_id, position from 0, edit (K kept, R rerolled, I inserted), turn (null if inserted), role, text.

    Same rules as `repair_reports`; a conversation without rows, or all of whose rows go, has none here.
    """
    out = _repair(conversations, True, id_col, turn_col, role_col, text_col, hold_rows, hold_chars, piece)
    return out.withColumn("turn", F.col("turn").cast("long"))


def repair_reports(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    hold_rows: int = HOLD_ROWS, hold_chars: int = HOLD_CHARS, piece: int = PIECE,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first; rows that share a turn by role, then text. A row's first fault counts:
    blank (no character but white space), duplicate (role and text seen earlier in the conversation),
    truncated (its last such character is not one of ``.!?``). Keeping a row costs 0, giving it the role
    user or assistant 3, deleting it 4, inserting an empty turn 3; blank rows and duplicates have to be
    deleted, and a truncated row that stays costs 3 more. ``audit`` names the cheapest edits in order (K, R, D,
    I) that leave roles whose initials match ``(s?(ua)+)?``; of equally cheap ones the ASCII-least. The hash
    is over ``role:text`` of the turns left, joined by newlines.

    A null role or text is one space. Rows without a conversation id form one conversation with a null id. ``gaps`` ignores null
    turns and is 0 without others. Repeated rows are duplicates. An empty table gives an empty result;
    further columns are ignored. Above ``hold_rows`` rows or ``hold_chars`` characters a conversation is repaired in three
    passes with pieces of ``piece`` rows; the result is the same.
    """
    return _repair(conversations, False, id_col, turn_col, role_col, text_col, hold_rows, hold_chars, piece)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) after damage that the checksum of id and turn decides.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's.
    Nulls are one space, in the checksum too; the columns conv_id and turn keep theirs.
    """
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    named = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.where("hit <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
