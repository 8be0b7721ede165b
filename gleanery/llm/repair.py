"""Conversation structure repair: the cheapest edits that make roles alternate, by A* on the edit lattice.

A node is (rows consumed, what the repaired conversation ends with). Rows are kept, given another role or deleted; empty rows may be
inserted before any row and at the end. The heuristic is a suffix sum: each blank or repeated row left has to be deleted, and a truncated
one costs at least its deletion, so it never overestimates and falls by no more than an edit costs. The queue is keyed by (cost plus
heuristic, audit), so the first path that reaches a node is the cheapest and, of equally cheap ones, the least by its letters.

Rows stream through from a sort that spills. They are searched in blocks: a block starts from the at most four endings that the one before it
reached, each with its cost, letters and hash so far, so a conversation of any length takes the memory of one block and of its letters.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Costs of the edits, and what a truncated row adds that isn't deleted.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that are searched at a time.
BLOCK = 256
#: Characters that may wait to be searched, unless a row has more.
WAITING = 1 << 22
#: What a repaired conversation may end with: nothing, a system row, a user's, an assistant's. It may stop at the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}


def follows(state: int, initial: str) -> int | None:
    """The ending after a row with this initial, None if it may not come here."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


#: Initial and ending of a row that is given another role or inserted, by the ending before it.
NEXT = {state: ASSISTANT if state == USER else USER for state in range(4)}
FREE, GONE, CUT = range(3)


def search(rows: list[tuple[str, int]], entries: list[tuple[int, int, str]], last: bool) -> dict[int, tuple[int, int, str]]:
    """{ending: (cost, entry, letters of this block)} after these rows (initial, kind), cheapest first, then least letters.

    kind: FREE, GONE (must be deleted) or CUT (truncated). entries: (ending, cost, letters so far). Rows are inserted after the last row only if nothing
    follows, so letters of different paths to a cut are never each other's beginnings and their order stays when more follow.
    """
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if rows[i][1] else 0)
    rank = {e: r for r, e in enumerate(sorted(range(len(entries)), key=lambda e: entries[e][2]))}
    queue = [(cost + least[0], rank[e], "", 0, state, cost, e) for e, (state, cost, _) in enumerate(entries)]
    heapq.heapify(queue)
    done, out = set(), {}
    while queue:
        _, r, audit, i, state, cost, e = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            out[state] = (cost, e, audit)
            if last and state in (NOTHING, ASSISTANT):
                return {state: out[state]}
        steps = [("I", INSERT, 0, NEXT[state])] if i < n or last else []
        if i < n:
            initial, kind = rows[i]
            steps.append(("D", DELETE, 1, state))
            if kind != GONE:
                more = TRUNCATED if kind == CUT else 0
                steps.append(("R", RENAME + more, 1, NEXT[state]))
                kept = follows(state, initial)
                if kept is not None:
                    steps.append(("K", more, 1, kept))
        for letter, price, by, to in steps:
            if (i + by, to) not in done:
                heapq.heappush(queue, (cost + price + least[i + by], r, audit + letter, i + by, to, cost + price, e))
    return out


def repaired(rows: list[tuple[str, str]], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits, from an ending on."""
    at = iter(rows)
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield NAMES[state], ""
            continue
        role, text = next(at)
        if letter == "R":
            state = NEXT[state]
            yield NAMES[state], text
        elif letter == "K":
            state = follows(state, role[:1])
            yield role, text


class Conversation:
    """One conversation's repair as its rows arrive in order."""

    def __init__(self, sink=None):
        self.entries = [(NOTHING, 0, "")]
        self.hashes, self.empty, self.sink = [hashlib.sha256()], [True], sink
        self.rows, self.size = [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.turns, self.low, self.high, self.turn = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if fault:
            self.counts[fault] += 1
        self.rows.append((role, text, CUT if fault == "truncated" else GONE if fault else FREE))
        self.size += len(text)
        if len(self.rows) >= BLOCK or self.size >= WAITING:
            self.flush()

    def flush(self, last: bool = False) -> None:
        plain = [(role, text) for role, text, _ in self.rows]
        found = search([(role[:1], kind) for role, _, kind in self.rows], self.entries, last)
        entries, hashes, empty = [], [], []
        for state, (cost, e, letters) in found.items():
            h, none = self.hashes[e].copy(), self.empty[e]
            for role, text in repaired(plain, letters, self.entries[e][0]):
                h.update((("" if none else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                none = False
            entries.append((state, cost, self.entries[e][2] + letters))
            hashes.append(h)
            empty.append(none)
        self.entries, self.hashes, self.empty = entries, hashes, empty
        self.rows, self.size = [], 0

    def row(self) -> tuple:
        self.flush(last=True)
        (_, cost, audit), h = self.entries[0], self.hashes[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, cost, audit, h.hexdigest()


def faulty(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with `fault`: blank, duplicate, truncated or null, the first that holds; rows that are gone have none.

    A row repeats another if a former one of its conversation has its role and text. Rows stand by turn, nulls first, then role and text. The rows
    of a conversation meet in one partition once; both orders are sorts that spill.
    """
    same = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn"))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(F.col("gone"), None).when(last == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    out = turns.repartition("conv_id").withColumn("_nth", same).withColumn("fault", fault)
    return out.sortWithinPartitions("conv_id", "turn", "role", "text", "gone", "_nth").drop("_nth")


def repair(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    turns: conv_id, turn, role, text; other columns aren't read. gone: rows that are left out, whose conversations stay. Null roles and texts are one
    space. A null conv_id is a conversation of its own; rows of one turn stand by role and text, and repeated rows are faults like others.
    A conversation without rows has zeros, no letters and the hash of nothing; an empty table gives none.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).alias("gone"))

    def work(batches: Iterator[pa.RecordBatch]):
        out, now, mine, begun, id_type = [], None, None, False, None

        def full():
            columns = list(zip(*out, strict=True))
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(COLUMNS))

        for b in batches:
            id_type = b.column("conv_id").type
            for conv, turn, role, body, away, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                if not begun or conv != mine:
                    if begun:
                        out.append((mine, *now.row()))
                    now, mine, begun = Conversation(), conv, True
                if not away:
                    now.add(turn, role, body, fault)
            if len(out) >= 1000:
                yield full()
        if begun:
            out.append((mine, *now.row()))
        if out:
            yield full()

    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return map_arrow(faulty(rows), work, schema)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_rows(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, place, role, text): the conversations after their repair, numbered from 0; cases as in repair().

    The letters come back to their conversation's rows, in the same order, and are carried out there.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).alias("gone"))
    audits = repair(turns, gone).select(F.col("conv_id").alias("_c"), "audit")
    # One row more per conversation, in front of its own, brings the letters.
    lead = audits.select(F.col("_c").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("lead"))
    both = rows.where("not gone").drop("gone").withColumn("lead", F.lit(False)).unionByName(lead)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("lead"), "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        state = place = at = 0
        audit, mine, id_type = "", None, None

        def inserted():
            nonlocal state, place, at
            while at < len(audit) and audit[at] == "I":
                state, at = NEXT[state], at + 1
                held.append((mine, place, NAMES[state], ""))
                place += 1

        def full():
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], names=["conv_id", "place", "role", "text"])

        for b in batches:
            id_type = b.column("conv_id").type
            for conv, role, body, lead_ in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "lead")), strict=True):
                if lead_:
                    inserted()
                    audit, mine, state, place, at = body, conv, NOTHING, 0, 0
                    continue
                inserted()
                for new_role, new_text in repaired([(role, body)], audit[at], state):
                    held.append((mine, place, new_role, new_text))
                    place += 1
                letter, at = audit[at], at + 1
                state = state if letter == "D" else NEXT[state] if letter == "R" else follows(state, role[:1])
            if held:
                yield full()
        inserted()
        if held:
            yield full()

    return map_arrow(both, work, f"conv_id {kind}, place long, role string, text string")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """turns after a damage by crc32("conv_id:turn") % 20, and which rows are dropped: 0 drops a row, 1 empties its text, 2 takes out its [.!?],
    3 repeats it, 4 makes it the user's. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), way.alias("_way"))
    text = F.when(F.col("_way") == 1, F.lit("")).when(F.col("_way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", F.when(F.col("_way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_way") == 0).alias("_drop"), copies.alias("_copy"))
    return out.drop("_copy"), F.col("_drop")


def op13_astar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return repair(*damaged(table(spark, sf_dir, "conversations")))


_PLUS = "{{'c': {0}.c + {1}, 'p': {0}.p || '{2}'}}"
_NONE = "{'c': 1000000000, 'p': ''}"
#: A path per ending, carried row by row; a CRC-32 by its table of 256, which is computed.
SQL = f"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
way as (select src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(k)), lambda i: cast(ord(substr(k, i + 1, 1)) as bigint))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as way from src, tab),
dam as (select conv_id, turn, case way when 4 then 'user' else role end as role, case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
               unnest(range(case way when 3 then 2 else 1 end)) as copy from way where way <> 0),
nr as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from dam),
r as (select *, substr(role, 1, 1) as ini, case when last = '' then 'blank' when nth > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault
      from (select *, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last, row_number() over (partition by conv_id, role, text order by i) as nth from nr)),
f as (select conv_id, i, ini, fault in ('blank', 'duplicate') as gone, case fault when 'truncated' then {TRUNCATED} else 0 end as cut from r),
ids as (select distinct conv_id from conversations),
dp as (select conv_id, cast(0 as bigint) as i, {{'c': 0, 'p': ''}} as e, {_NONE} as s, {_NONE} as u, {_NONE} as a from ids
       union all select conv_id, i, {{'c': e.c + {DELETE}, 'p': e.p || 'D'}},
         least({_PLUS.format('s', DELETE, 'D')}, case when not gone and ini = 's' then {_PLUS.format('e', 'cut', 'K')} else {_NONE} end),
         least({_PLUS.format('u1', DELETE, 'D')}, case when gone then {_NONE} when ini = 'u' then {_PLUS.format('x', 'cut', 'K')} else {_PLUS.format('x', f'cut + {RENAME}', 'R')} end),
         least({_PLUS.format('a1', DELETE, 'D')}, case when gone then {_NONE} when ini = 'a' then {_PLUS.format('u1', 'cut', 'K')} else {_PLUS.format('u1', f'cut + {RENAME}', 'R')} end)
       from (select f.*, e, s, least(u, {_PLUS.format('least(e, s, a)', INSERT, 'I')}) as u1, least(a, {_PLUS.format('u', INSERT, 'I')}) as a1, least(e, s, least(a, {_PLUS.format('u', INSERT, 'I')})) as x
             from dp join f on f.conv_id = dp.conv_id and f.i = dp.i + 1)),
best as (select conv_id, least(e, a, {_PLUS.format('u', INSERT, 'I')}) as b from (select *, row_number() over (partition by conv_id order by i desc) as back from dp) where back = 1),
let as (select conv_id, p, letter, sum(case when letter = 'I' then 0 else 1 end) over w as i, sum(case when letter = 'D' then 0 else 1 end) over w as place
        from (select conv_id, unnest(range(1, length(b.p) + 1)) as p, substr(b.p, p, 1) as letter from best) window w as (partition by conv_id order by p)),
put as (select let.*, r.role, r.text, max(case when place = 1 and letter = 'K' and r.ini = 's' then 1 else 0 end) over (partition by let.conv_id) as lead
        from let left join r on r.conv_id = let.conv_id and r.i = let.i where letter <> 'D'),
txt as (select conv_id, string_agg(case when letter = 'K' then role when (place - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by p) as t from put group by conv_id),
adj as (select conv_id, count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal from (select conv_id, ini, lag(ini) over (partition by conv_id order by i) as before from r) group by conv_id),
num as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
               count(*) filter (fault = 'truncated') as truncated from r group by conv_id)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(b.c as bigint) as cost, b.p as audit, sha256(coalesce(t, '')) as repaired_sha256
from ids join best using (conv_id) left join num using (conv_id) left join adj using (conv_id) left join txt using (conv_id)
"""
