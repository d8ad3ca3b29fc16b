"""Conversations repaired at least cost, so that their roles read: perhaps a system turn, then user and assistant in turn.

One rule decides, an ordinary minimum of integers.  A way to treat the rows of a conversation weighs a whole number: its high
digits are the cost of its edits, its low digits spell them.  Every row has a place of WIDTH bits of its own, which holds its
letters in order (insertions before it, then what becomes of it) with zeros behind them; so of two ways of equal cost the
lesser number is the one whose letters come first, as no row's letters begin another's.  The weights of edges simply add up.

Long conversations are weighed in pieces: from the last piece to the first, the least cost of what follows is added to the
high digits for each role that a piece may end with; then the pieces are read off in order.  So numbers stay short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded

#: What edits cost, and what is added for a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters by the digit that stands for them; zero is no letter.  Delete, insert, keep, rerole: in ASCII order.
LETTERS = ".DIKR"
DIGIT = {letter: k for k, letter in enumerate(LETTERS) if k}
#: Two insertions and what becomes of the row: more insertions would come back to the same state at a cost.
PLACE, WIDTH = 3, 9
#: Rows in a piece.
PIECE = 128

# States: nothing yet, after system, after user, after assistant.  The role that must come next, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: For each state, what is inserted behind the last row.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

#: A row's code: its role's initial (or a dot), then n: sound, t: truncated, b: blank, d: duplicate.
FAULTS = "ntbd"


def _place(letters: str) -> int:
    """A row's letters as digits at the front of its place."""
    return sum(DIGIT[x] << 3 * (PLACE - 1 - k) for k, x in enumerate(letters))


def _ways(initial: str, fault: str) -> dict[int, list[tuple[int, int, int]]]:
    """For each state before a row, the ways to treat it: (state after, cost, place)."""
    ways: dict[int, list[tuple[int, int, int]]] = {}
    for before in range(4):
        at, found = before, []
        for inserted in range(PLACE):
            paid, letters = INSERT * inserted, "I" * inserted
            found.append((at, paid + DELETE, _place(letters + "D")))
            if fault in "nt":
                paid += TRUNCATED * (fault == "t")
                has = INITIAL.get(initial)
                if has == NEXT[at] or (has == SYSTEM and at == START):
                    found.append((has, paid, _place(letters + "K")))
                if has != NEXT[at]:
                    found.append((NEXT[at], paid + REROLE, _place(letters + "R")))
            at = NEXT[at]
        ways[before] = found
    return ways


WAYS = {initial + fault: _ways(initial, fault) for initial in "sua." for fault in FAULTS}


def _weigh(codes: list[str], before: int) -> dict[int, int]:
    """For each state after a piece the least weight of the ways from ``before`` to it."""
    high = WIDTH * len(codes)
    best = {before: 0}
    for k, code in enumerate(codes):
        shift, now = high - WIDTH * (k + 1), {}
        for state, weight in best.items():
            for after, cost, place in WAYS[code][state]:
                total = weight + (cost << high) + (place << shift)
                if total < now.get(after, total + 1):
                    now[after] = total
        best = now
    return best


def cheapest(codes: list[str]) -> tuple[int, str]:
    """The least cost and, of the edits that cost it, those whose letters come first."""
    pieces = [codes[i : i + PIECE] for i in range(0, len(codes), PIECE)]
    after = [{state: INSERT * len(tail) for state, tail in TAIL.items()}]  # what the rest costs, by the state before it
    for piece in reversed(pieces[1:]):
        high = WIDTH * len(piece)
        after.append({before: min(w + (after[-1][state] << high) for state, w in _weigh(piece, before).items()) >> high for before in range(4)})
    state, cost, letters = START, None, []
    for piece in pieces:
        rest, high = after.pop(), WIDTH * len(piece)
        weights = _weigh(piece, state)
        state = min(weights, key=lambda s: weights[s] + (rest[s] << high))
        cost = (weights[state] >> high) + rest[state] if cost is None else cost
        digits = f"{weights[state] & ((1 << high) - 1):0{PLACE * len(piece)}o}"
        letters.append("".join(LETTERS[int(d)] for d in digits if d != "0"))
    return cost or 0, "".join(letters) + TAIL[state]


# --- on Spark -------------------------------------------------------------------------------------------------------

EDITS = "conv_id long, step long, edit string, role string, text string, facts struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"
_FACTS = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_EDITS = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("facts", _FACTS)])


def _coded(rows: DataFrame, also: DataFrame | None) -> DataFrame:
    """conv_id, turn, role, text, pos (0 where only the conversation is known) and code, partitioned by conversation."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    df = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), value("role"), value("text"), F.lit(True).alias("real"))
    if also is not None:
        df = df.unionByName(also.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("real")))
    # Both windows only number rows, so they stream through sorted rows; both use one exchange by conversation.
    order = Window.partitionBy("conv_id").orderBy("real", "turn", "role", "text", "seen")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.left("role", F.lit(1))
    df = df.repartition("conv_id").withColumn("seen", F.row_number().over(same)).withColumn("pos", F.when(F.col("real"), F.row_number().over(order)).otherwise(0))
    fault = F.when(trimmed == "", "b").when(F.col("seen") > 1, "d").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "t").otherwise("n")
    return df.withColumn("code", F.when(F.col("real"), F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("."), fault))).drop("seen")


def repair(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """What becomes of the conversations in ``rows`` (conv_id, turn, role, text): for each a row with its ``facts`` (step
    null), then its edits that leave a turn, in order: step (place in the audit), edit (K, R or I), role and text.

    Rows stand in order of turn, then role, then text; null turns come first; null roles and texts are one space; rows
    without conv_id are one conversation; repeated rows are duplicates of the first.  ``also`` (conv_id) names conversations
    that must be told of even if they have no rows.  Empty tables give no rows; other columns are dropped.

    A task takes its conversations one after the other, sorted: first all codes of a conversation (two letters a row), then,
    once its edits are known, its rows again one by one.  So it holds some bytes for each row of one conversation, never its
    texts, however long a conversation or a text is.
    """
    coded = _coded(rows, also)
    # Each row twice: its code, without text, and after all codes of the conversation its text.
    light = F.struct(F.lit(0).alias("pass"), F.col("code"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    full = F.struct(F.lit(1).alias("pass"), F.lit(None).cast("string").alias("code"), F.col("role"), F.col("text"))
    twice = coded.select("conv_id", "turn", "pos", F.explode(F.when(F.col("real"), F.array(light, full)).otherwise(F.array(light))).alias("r"))
    stream = twice.select("conv_id", "pos", "turn", "r.*").sortWithinPartitions("conv_id", "pass", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_pylist(out, _EDITS)
            out.clear()
            size = 0
            return made

        def put(conv: int | None, step: int | None, edit: str | None, role: str | None, text: str | None, facts: dict | None = None) -> None:
            nonlocal size
            out.append({"conv_id": conv, "step": step, "edit": edit, "role": role, "text": text, "facts": facts})
            size += 50 + len(text or "")

        def planned(conv: int | None, codes: list[str], turns: list[int | None]) -> str:
            cost, audit = cheapest(codes)
            initials = [c[0] for c in codes]
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
            low, high, distinct = turns
            count = lambda fault: sum(c[1] == fault for c in codes)
            put(conv, None, None, None, None, {"gaps": high - low + 1 - distinct if distinct else 0, "blank": count("b"), "duplicate": count("d"), "truncated": count("t"), "illegal": illegal, "cost": cost, "audit": audit})
            return audit

        def inserts(audit: str, at: int, conv: int | None, state: int) -> tuple[int, int]:
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                put(conv, at, "I", ROLE[state], "")
                at += 1
            return at, state

        now, opened = None, False
        codes: list[str] = []
        turns: list[int | None] = [None, None, 0]  # least, greatest, how many distinct
        audit: str | None = None
        at, state = 0, START
        for batch in batches:
            for conv, turn, which, code, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "pass", "code", "role", "text")), strict=True):
                if not opened or conv != now:
                    if opened and audit is None:
                        planned(now, codes, turns)
                    elif opened:
                        inserts(audit, at, now, state)
                    now, opened, codes, turns, audit, at, state = conv, True, [], [None, None, 0], None, 0, START
                if which == 0:
                    if code is not None:
                        codes.append(code)
                        if turn is not None and turn != turns[1]:
                            turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                    continue
                if audit is None:
                    audit = planned(now, codes, turns)
                at, state = inserts(audit, at, now, state)
                edit = audit[at]
                if edit == "K":
                    state = INITIAL[role[0]]
                    put(now, at, edit, role, text)
                elif edit == "R":
                    state = NEXT[state]
                    put(now, at, edit, ROLE[state], text)
                at += 1
                if size > 4_000_000:
                    yield batch_of()
        if opened and audit is None:
            planned(now, codes, turns)
        elif opened:
            inserts(audit, at, now, state)
        if out:
            yield batch_of()

    return bounded(stream).mapInArrow(run, EDITS)


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: its facts, and the hash of its repaired turns as they come by."""
    made = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        running, first = hashlib.sha256(), True
        for batch in batches:
            out = []
            for conv, step, role, text, facts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "step", "role", "text", "facts")), strict=True):
                if step is None:
                    if row:
                        out.append(row | {"repaired_sha256": running.hexdigest()})
                    row, running, first = {"conv_id": conv, **facts}, hashlib.sha256(), True
                else:
                    running.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
            yield pa.RecordBatch.from_pylist(out, made)
        if row:
            yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": running.hexdigest()}], made)

    return edits.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with a quarter of their rows damaged, by the checksum of conv_id and turn: (the rows that are left, the
    conversations that lost rows).  0 drops a row, 1 empties it, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn"))) % 20
    rows = conversations.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), kind.alias("kind"))
    left = rows.where("kind <> 0").withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    left = left.withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return left.select("conv_id", "turn", "role", "text"), rows.where("kind = 0").select("conv_id")
