"""Conversation structure repair by lazy weighted determinisation.

Rows of a conversation are to be kept, reroled, deleted or joined by inserted turns so
that their role initials become ``(s?(ua)+)?`` at the least cost. That is a weighted
automaton of four states over the rows' symbols (what a row may become and what that
costs). Read from the last row to the first, the costs of ending from each state form a
vector; less its minimum, it is a state of the determinised automaton, and there are only
some dozens of these. A state and a symbol give the next state and an offset once, which
a table then holds: the scan is a look-up a row, and its offsets add up to the cost. The
trace then goes the other way, from the first row on, along tight arcs - those that keep
to the least cost - and takes the smallest letter at each step, so the audit is the
smallest in ASCII order among the cheapest.

Both walks are streams over rows sorted within their partitions: a task holds one batch,
the tables and the audit it is writing, whatever a conversation's length. What does not
depend on a row's place - damage, faults, first occurrences - is done before, on rows
dealt at will. A conversation's own rows meet in one task, because the digest of its
repaired text reads them one after the other.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, CUT_OFF = range(4)  # a row's fault
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the repaired text ends in
_NEXT = (USER, USER, ASSISTANT, USER)  # the one state that an inserted or reroled turn leads to
_KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SHIFT = 8
_steps: dict[tuple[int, int, str], tuple[int, int]] = {}
_arcs: dict[tuple[int, int, str, int], tuple[str, int]] = {}


def _closed(costs: list[int]) -> list[int]:
    """Costs of ending from each state when turns may be inserted at once."""
    for _ in costs:
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return costs


FINAL = _closed([0, 1 << 10, 1 << 10, 0])


def _packed(costs: list[int]) -> int:
    return sum(c << (_SHIFT * q) for q, c in enumerate(costs))


def _unpacked(state: int) -> list[int]:
    return [state >> (_SHIFT * q) & ((1 << _SHIFT) - 1) for q in range(len(FINAL))]


def _choices(q: int, fault: int, initial: str) -> list[tuple[str, int, int]]:
    """``(letter, cost, state after)`` of what may become of a row, letters in ASCII order."""
    out = [("D", DELETE, q)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial in _KEEPS[q]:
            out.append(("K", RETAIN + more, _KEEPS[q][initial]))
        out.append(("R", REROLE + more, _NEXT[q]))
    return out


def _costs(after: list[int], fault: int, initial: str) -> list[int]:
    return _closed([min(cost + after[to] for _, cost, to in _choices(q, fault, initial)) for q in range(len(after))])


def initial_of(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "-"


def scan_step(state: int, fault: int, initial: str) -> tuple[int, int]:
    """The determinised state before a row and its offset, from the state after it."""
    key = state, fault, initial
    if key not in _steps:
        costs = _costs(_unpacked(state), fault, initial)
        least = min(costs)
        _steps[key] = _packed([c - least for c in costs]), least
    return _steps[key]


def trace_step(state: int, fault: int, initial: str, q: int) -> tuple[str, int]:
    """The letters up to and with a row's own, from ``q`` before it, and the state they lead to; ``state`` holds the costs after the row."""
    key = state, fault, initial, q
    if key not in _arcs:
        after = _unpacked(state)
        costs, letters = _costs(after, fault, initial), ""
        while True:
            tight = [(x, to) for x, cost, to in _choices(q, fault, initial) if cost + after[to] == costs[q]]
            if INSERT + costs[_NEXT[q]] == costs[q]:
                tight.append(("I", -1))
            letter, to = min(tight)
            letters += letter
            if letter != "I":
                _arcs[key] = letters, to
                break
            q = _NEXT[q]
    return _arcs[key]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, texts: int, most: int = 1000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by number and by the length of column ``texts``."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[texts])
        if len(held) >= most or size >= chars:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _scan(schema: pa.Schema):
    """From each conversation's last row to its first: ``below``, the number of rows that follow, ``state``, the determinised
    state after the row, and ``cost``, that of the row and all that follow. A row waits for the one before it, which it may repeat."""

    def walked(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, conv, state, total, below = None, object(), 0, 0, 0

        def out(before: tuple | None) -> tuple:
            nonlocal state, total, below
            conv_id, turn, role, text, dropped, fault, digest = own
            at, below = state, below + 1
            if not dropped:
                if fault != BLANK and before is not None and before[0] == conv_id and (before[1], before[6]) == (turn, digest):
                    fault = DUPLICATE
                state, offset = scan_step(state, fault, initial_of(role))
                total += offset
            return conv_id, turn, role, text, dropped, fault, below - 1, at, total + _unpacked(state)[START]

        for r in rows:
            if own is not None:
                yield out(r)
            if own is None or r[0] != conv:
                conv, state, total, below = r[0], _packed(FINAL), 0, 0
            own = r
        if own is not None:
            yield out(None)

    return lambda batches: _batched(walked(_rows(batches)), schema, 3)


def _trace(schema: pa.Schema):
    """From each conversation's first row to its last: its counts, audit and the digest of its repaired text."""

    def conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
        fresh = True
        for conv_id, turn, role, text, dropped, fault, below, state, cost in rows:
            if fresh:
                first, audit, digest, q, joint = cost, io.StringIO(), hashlib.sha256(), START, b""
                counts, illegal, last, low, high, distinct = [0] * 4, 0, None, None, None, 0
            if not dropped:
                if turn is not None:
                    low = turn if low is None else low
                    distinct += high != turn
                    high = turn
                initial = initial_of(role)
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                counts[fault] += 1
                letters, to = trace_step(state, fault, initial, q)
                audit.write(letters)
                for x in letters:
                    if x == "D":
                        continue
                    q = to if x == "K" else _NEXT[q]
                    digest.update(joint + (role if x == "K" else _ROLE[q]).encode() + b":" + (b"" if x == "I" else text.encode()))
                    joint = b"\n"
                q = to
            fresh = below == 0
            if fresh:
                while q not in (START, ASSISTANT):
                    q = _NEXT[q]
                    audit.write("I")
                    digest.update(joint + _ROLE[q].encode() + b":")
                    joint = b"\n"
                gaps = 0 if low is None else high - low + 1 - distinct
                yield conv_id, gaps, counts[BLANK], counts[DUPLICATE], counts[CUT_OFF], illegal, first, audit.getvalue(), digest.hexdigest()

    return lambda batches: _batched(conversations(_rows(batches)), schema, 7)


def damaged_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copy, dropped)``: ``rows`` damaged as the checksum of ``conv_id:turn`` says, nulls read as one space.

    Dropped rows stay, marked: their conversation is still to be answered for."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"), (F.col("harm") == 0).alias("dropped"))


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` and ``digest``. A row that repeats one of an earlier turn is found by the first turn of its role and text;
    one that repeats a row of its own turn is left to the scan, where the two are neighbours."""
    stem = F.rtrim(F.col("text"), F.lit(BLANKS))
    told = rows.withColumn("digest", F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))).withColumn(
        "fault", F.when(stem == "", BLANK).when(~F.substring(stem, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(OK)
    )
    turn = F.struct(F.col("turn").isNotNull(), "turn")  # null first
    firsts = (
        told.where("not dropped").groupBy("conv_id", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first < last")
        .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    )
    met = told.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    again: Column = (F.col("fault") != BLANK) & F.col("first").isNotNull() & (turn > F.col("first"))
    return met.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))).drop("_conv", "_digest", "first")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, least cost, audit and digest of each conversation of ``rows`` (conv_id, turn, role, text, copy, dropped).

    Rows are taken by turn, nulls first; rows of one turn by role, text and copy, so that
    equal ones are neighbours. A row's fault is the first that holds: blank (no character but
    white space), duplicate (role and text seen earlier in the conversation), truncated
    (its last character does not end a sentence). Role and text are not null; a role that
    begins with none of s, u, a - the empty one too - can only be reroled or deleted. A null
    ``conv_id`` is a conversation of its own. A conversation whose rows are all marked
    dropped gives zeros, an empty audit and the digest of the empty text."""
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    told = _faults(rows)
    down = told.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("copy").desc()
    )
    down = down.select("conv_id", "turn", "role", "text", "dropped", "fault", "digest")
    scanned = T.StructType(
        [conv, *T.StructType.fromDDL("turn long, role string, text string, dropped boolean, fault int, below long, state long, cost long")]
    )
    done = T.StructType(
        [conv, *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")]
    )
    up = down.mapInArrow(_scan(_arrow(scanned)), scanned).sortWithinPartitions("conv_id", F.col("below").desc())
    return up.mapInArrow(_trace(_arrow(done)), done)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged ``rows`` (conv_id, turn, role, text): a row for each ``conv_id``, null included.

    Repeated rows are rows of their own; other columns are ignored; an empty table gives an empty result."""
    return repair_conversations(damaged_rows(rows.select("conv_id", "turn", "role", "text")))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (  -- checksum of each byte
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: unicode(ch)::bigint) AS b
    FROM conversations
), harmed AS (
    SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % 20 AS harm
    FROM named, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM harmed WHERE harm <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS r,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
        lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), sizes AS (
    SELECT conv_id, count(j.i) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (before IS NOT NULL AND left(before, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN judged j USING (conv_id) GROUP BY conv_id
), back AS (  -- least costs from before row i to the end, from: nothing yet, system, user, assistant
    SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS v FROM sizes
    UNION ALL
    SELECT conv_id, i, [least(w0, 3 + w2, 6 + w3), least(w1, 3 + w2, 6 + w3), least(w2, 3 + w3), least(w3, 3 + w2)] FROM (
        SELECT j.conv_id, j.i,
            least(4 + v[1], CASE WHEN gone THEN 99999 WHEN r = 's' THEN c + v[2] WHEN r = 'u' THEN c + v[3] ELSE 99999 END, CASE WHEN gone THEN 99999 ELSE 3 + c + v[3] END) AS w0,
            least(4 + v[2], CASE WHEN gone THEN 99999 WHEN r = 'u' THEN c + v[3] ELSE 3 + c + v[3] END) AS w1,
            least(4 + v[3], CASE WHEN gone THEN 99999 WHEN r = 'a' THEN c + v[4] ELSE 3 + c + v[4] END) AS w2,
            least(4 + v[4], CASE WHEN gone THEN 99999 WHEN r = 'u' THEN c + v[3] ELSE 3 + c + v[3] END) AS w3
        FROM back b JOIN (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS c FROM judged) j ON j.conv_id = b.conv_id AND j.i = b.i - 1)
), trace AS (  -- one edit a step
    SELECT conv_id, 1::bigint AS i, 1 AS q, '' AS audit, []::varchar[] AS lines FROM sizes
    UNION ALL
    SELECT conv_id, CASE WHEN x = 'I' THEN i ELSE i + 1 END, CASE WHEN x = 'D' THEN q WHEN x = 'K' AND r = 's' THEN 2 ELSE nx END, audit || x,
        CASE WHEN x = 'D' THEN lines ELSE list_append(lines, CASE WHEN x = 'K' THEN role WHEN nx = 3 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END) END
    FROM (
        SELECT t.*, j.role, j.text, j.r, CASE WHEN q = 3 THEN 4 ELSE 3 END AS nx,
            CASE WHEN j.i IS NULL THEN 'I' WHEN now.v[q] = 4 + nxt.v[q] THEN 'D' WHEN now.v[q] = 3 + now.v[CASE WHEN q = 3 THEN 4 ELSE 3 END] THEN 'I'
                WHEN (q = 1 AND r = 's' AND now.v[q] = c + nxt.v[2]) OR (q <> 3 AND r = 'u' AND now.v[q] = c + nxt.v[3]) OR (q = 3 AND r = 'a' AND now.v[q] = c + nxt.v[4]) THEN 'K'
                ELSE 'R' END AS x
        FROM trace t JOIN back now ON now.conv_id = t.conv_id AND now.i = t.i LEFT JOIN back nxt ON nxt.conv_id = t.conv_id AND nxt.i = t.i + 1
        LEFT JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS c FROM judged) j ON j.conv_id = t.conv_id AND j.i = t.i
        WHERE j.i IS NOT NULL OR q IN (2, 3))
)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, b.v[1]::bigint AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM sizes s JOIN back b ON b.conv_id = s.conv_id AND b.i = 1 JOIN trace t ON t.conv_id = s.conv_id AND t.i = s.n + 1 AND t.q IN (1, 4)
"""
