"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

Role initials must read ``(s?(ua)+)?``.  Keep costs 0, Rerole to user or
assistant 3, Delete 4, Insert of an empty user or assistant text 3; rows that
are blank or repeat an earlier row's role and text must be deleted, and a
truncated row (its last sign is no end of a sentence) adds 3 unless deleted.

Dijkstra's algorithm searches the implicit lattice of (turn index, grammar
state).  Its priority is (cost, audit), the audit being the edits' initials
so far, and it stops at the first popped end node that accepts.  The letters
fix the cost, and Insert is the only one that consumes no turn, so of two
audits of one cost at one node neither begins with the other: their order
stays as it is when both go on, and the first pop of a node is final.  The
audit also fixes all roles, so it is all that is kept of a path.

* Rows that must go are no part of the lattice.  Each is D in any case, and
  D sorts before I, so it stands right after the edit of the turn before it.
* Long conversations are searched in pieces of ``PIECE`` turns.  The four end
  nodes of a piece are popped and are the sources of the next.  What is alive
  there is told apart by short keys that keep the audits' order, so the time
  grows with the turns and no audit is copied over and over.

Rows become one sign each (role initial and fault), gathered by slices of
the conversation and then by conversation; only these signs meet, not texts.
The repaired text's digest is one value over a whole conversation, so its
rows stream through one task in order, a batch at a time, and are not held.

Defined results: null roles and texts are one space here, so such rows are
blank or have a role to be changed; null turns come first; rows of one turn
are ordered by role, then by the text's digest; a null conv_id is a
conversation; repeated rows are duplicates; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conversations import long_conversations, sliced, turn_order
from .session import checkpointed

#: Turns that are searched at once.
PIECE = 256
NOT_BLANK = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
#: A row's sign: its role's initial (x: any other); the next letters if it is truncated; capitals if it must go.
KEPT, CUT, GONE = "suax", "tvby", "SUAX"
#: Grammar states: nothing yet, after the system, after a user, after an assistant; the turns that each lets follow.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPT = (0, 3)
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3


def order_keys(audits: list[str]) -> list[str]:
    """Short stand-ins for different audits: of the same order, whatever is appended to both."""
    out, groups = [""] * len(audits), [(list(range(len(audits))), 0)]
    while groups:
        group, at = groups.pop()
        if len(group) < 2:
            continue
        ends = any(len(audits[k]) == at for k in group)  # one begins another: the rest of each counts
        if ends:
            for k in group:
                out[k] += audits[k][at:]
            continue
        by: dict[str, list[int]] = {}
        for k in group:
            by.setdefault(audits[k][at], []).append(k)
        for letter, some in by.items():
            if len(by) > 1:
                for k in some:
                    out[k] += letter
            groups.append((some, at + 1))
    return out


def _search(signs: str, sources: list[tuple[int, str, int]], last: bool) -> list[tuple[int, int, int, str]]:
    """(state, cost, source, letters) of the end nodes over ``signs``, or of the first that accepts.

    A source is (cost, key, state); a path's priority is its cost, then its
    source's key and its own letters.
    """
    heap = [(cost, key, len(key), 0, state, k) for k, (cost, key, state) in enumerate(sources)]
    heapq.heapify(heap)
    done, ends = set(), []
    while heap:
        cost, audit, own, i, state, source = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(signs) and (not last or state in ACCEPT):
            ends.append((state, cost, source, audit[own:]))
            if last or len(ends) == len(FOLLOW):
                return ends
        for role, to in FOLLOW[state].items():
            if role != "s":
                heapq.heappush(heap, (cost + COSTS["I"], audit + "I", own, i, to, source))
        if i == len(signs):
            continue
        sign = signs[i]
        more = TRUNCATED_COST if sign in CUT else 0
        role = KEPT[CUT.index(sign)] if more else sign
        heapq.heappush(heap, (cost + COSTS["D"], audit + "D", own, i + 1, state, source))
        for to_role, to in FOLLOW[state].items():
            if to_role == role:
                heapq.heappush(heap, (cost + more, audit + "K", own, i + 1, to, source))
            elif to_role != "s":
                heapq.heappush(heap, (cost + COSTS["R"] + more, audit + "R", own, i + 1, to, source))
    return ends


def cheapest_edits(signs: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation of these signs."""
    stay, gone = [], [0]  # signs of the lattice, and how many must go after each
    for sign in signs:
        if sign in GONE:
            gone[-1] += 1
        else:
            stay.append(sign)
            gone.append(0)
    left = "".join(stay)
    alive = [(0, 0, None)]  # state, cost, (chain before, letters)
    keys = [""]
    for at in range(0, max(len(left), 1), PIECE):
        last = at + PIECE >= len(left)
        found = _search(left[at : at + PIECE], [(cost, key, state) for key, (state, cost, _) in zip(keys, alive, strict=True)], last)
        audits = [keys[source] + letters for _, _, source, letters in found]
        alive = [(state, cost, (alive[source][2], letters)) for state, cost, source, letters in found]
        keys = order_keys(audits)
    _, cost, chain = alive[0]
    letters = []
    while chain:
        letters.append(chain[1])
        chain = chain[0]
    out, k = ["D" * gone[0]], 0
    for letter in "".join(reversed(letters)):
        out.append(letter)
        if letter != "I":
            k += 1
            out.append("D" * gone[k])
    return cost + COSTS["D"] * sum(gone), "".join(out)


def illegal_pairs(signs: str) -> int:
    """Adjacent rows whose initials are none of su, ua, au."""
    roles = signs.translate(str.maketrans(CUT + GONE, KEPT * 2))
    return max(0, len(roles) - 1) - sum(a + b in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, duplicate, truncated) of each row: its first fault."""
    rows = turns.select("conv_id", "turn", "role", F.md5("text").alias("digest"), (~F.col("text").rlike(NOT_BLANK)).alias("blank"), (~F.col("text").rlike(WHOLE)).alias("open"))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("duplicate", ~F.col("blank") & (F.row_number().over(same) > 1))
    return rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open")).drop("open")


def sign_of(role: Column, gone: Column, cut: Column) -> Column:
    first = F.substring(role, 1, 1)
    known = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))
    return F.when(gone, F.translate(known, KEPT, GONE)).when(cut, F.translate(known, KEPT, CUT)).otherwise(known)


def structure(turns: DataFrame, slice_turns: int = 4096) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations without nulls in role and text."""
    rows = checkpointed(faults(turns))
    rows = sliced(rows, long_conversations(rows, slice_turns)).withColumn("sign", sign_of(F.col("role"), F.col("blank") | F.col("duplicate"), F.col("truncated")))
    line = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", "digest", "duplicate", "sign")))
    count = lambda name: F.sum(F.col(name).cast("long")).alias(name)
    parts = rows.groupBy("conv_id", "slice").agg(F.array_join(F.transform(line, lambda x: x["sign"]), "").alias("signs"), *map(count, ("blank", "duplicate", "truncated")))
    whole = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "signs"))), lambda x: x["signs"]), "").alias("signs"), *map(count, ("blank", "duplicate", "truncated")))
    gaps = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy(F.col("conv_id").alias("conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, str]] = {}  # short conversations look alike
        for batch in batches:
            found = []
            for signs in batch.column(1).to_pylist():
                one = known.get(signs) or (illegal_pairs(signs), *cheapest_edits(signs))
                if len(signs) <= 16 and len(known) < 100_000:
                    known[signs] = one
                found.append(one)
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *new], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    solved = whole.mapInArrow(solve, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return solved.join(gaps, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")


def repaired_turns(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role that it makes) along an audit; None where the row's own role stays or the row goes."""
    state = None
    for k, edit in enumerate(audit):
        made = "user" if state != "user" else "assistant"
        yield edit, made if edit in "RI" else None
        if edit != "D":
            state = made if edit in "RI" else "?"


def repaired_digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): sha256 of ``role:text`` of the repaired turns, joined by newlines."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    both = audits.select("conv_id", F.lit(0).alias("what"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = both.union(turns.select("conv_id", F.lit(1), "turn", "role", "text"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "what", *turn_order())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, expect, hashed, began = "", 0, "u", None, False
        of = None

        def emit(role: str, text: str) -> None:
            nonlocal began, expect
            hashed.update((("\n" if began else "") + f"{role}:{text}").encode())
            began, expect = True, "a" if role[:1] == "u" else "u"

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit("user" if expect == "u" else "assistant", "")
                at += 1

        for batch in batches:
            done = []
            for conv, what, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if what == 0:
                    if hashed is not None:
                        inserts()
                        done.append((of, hashed.hexdigest()))
                    of, audit, at, expect, hashed, began = conv, text, 0, "u", hashlib.sha256(), False
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    emit(role, text)
                elif edit == "R":
                    emit("user" if expect == "u" else "assistant", text)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], batch.schema.field(0).type), pa.array([x[1] for x in done], pa.string())], names=["conv_id", "repaired_sha256"])
            last = batch.schema.field(0).type
        if hashed is not None:
            inserts()
            yield pa.RecordBatch.from_arrays([pa.array([of], last), pa.array([hashed.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return both.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns(conv_id, turn, role, text)``: its faults, the cheapest audit and the repaired text's digest."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    found = checkpointed(structure(rows))
    digests = repaired_digests(rows, found).withColumnRenamed("conv_id", "conv")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after the seeded damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, loses its sentence ends, is repeated, or becomes the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
