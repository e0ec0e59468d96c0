"""Chat formatting in budgeted windows, in SQL functions only.

A conversation becomes training rows ("windows") of at most ``budget``
tokens.  Every turn is fresh in one window, where assistant texts are under
the loss mask.  Prefix sums of turn tokens choose the spans: a turn that
begins at token c of its conversation is in cell c // G, and a span is the
turns of one cell.  With G = (budget - history - system tokens) // 2, a span
of turns of at most G tokens each stays under 2 G.  Longer turns are spans of
their own.  So spans are aligned with turns and need no sequential packing.
A window holds, in this order:

* the conversation's system turn, if its first turn is one of at most a
  quarter of the budget,
* history: the turns at the end of the span before, at most ``history``
  tokens; these are repeated, so their loss is masked,
* the fresh turns.

A turn of more than the budget is kept whole in a window of its own, which
is then over the budget; nothing is cut or dropped.

*Template.*  ``<<SYS>>``, ``[INST]`` and ``</s>`` mark system, user and
assistant turns; other roles are named between ``[ROLE]`` and ``[INST]``.  In
texts and role names a backslash is doubled, and one goes after the first
sign of each control string, so none is left; ``unescaped`` undoes that.

Conversations of more than ``slice_turns`` turns are cut into slices of
about so many, each with its own prefix sums, so no task holds a long
conversation; the first window of a later slice has the system turn but no
history.

Defined results: null texts and roles are empty; null turns come first;
turns of equal number are ordered by role, then by digest of the text; rows
that repeat are turns of their own; a null conv_id is a conversation; an
empty table gives no windows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conversations import long_conversations, sliced, turn_order
from .session import checkpointed

#: The template's signs, fixed values: (begin, end) of a turn by role; a role that is not listed stands between the first two of OTHER.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE]", "[INST] ", " [/ROLE]")
CONTROL = r"([<\[])(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)"
TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n|<s>\[INST\] .*? \[/INST\]|\[ROLE\].*?\[INST\] .*? \[/ROLE\]| .*? </s>"


def escaped(text: Column) -> Column:
    """``text`` without any control string, reversibly."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def byte_tokens(piece: Column) -> Column:
    """Tokens of a formatted turn, estimated as a quarter of its bytes."""
    return F.ceil(F.octet_length(piece) / 4).cast("long")


def _opened(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    for name, (begin, _) in MARKS.items():
        out = F.when(role == name, F.lit(begin)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, end) in MARKS.items():
        out = F.when(role == name, F.lit(end)).otherwise(out)
    return out


def _later_heads(rows: DataFrame, long: DataFrame) -> DataFrame:
    """The first turn of a long conversation, if it is the system's, once for each later slice."""
    first = rows.join(long.select("conv", "low", "last_slice"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("turn").isNull() | (F.col("turn") == F.col("low"))))
    first = first.groupBy("conv", "last_slice").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", F.md5("text").alias("digest"), "text")).alias("x"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), "last_slice")).alias("slice")
    return first.where("x.role = 'system' and last_slice > 0").select(F.col("conv").alias("conv_id"), "x.turn", "x.role", "x.text", each, F.lit(True).alias("copy"))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256, slice_turns: int = 1024, tokens: Callable[[Column], Column] = byte_tokens) -> DataFrame:
    """(conv_id, slice, window, text, loss, repeated, fresh, tokens) of ``turns(conv_id, turn, role, text)``.

    ``loss`` has (start, length) in code points of ``text`` for every fresh
    assistant text, ``repeated`` is the number of turns at its front that
    another window has too.  Windows of a conversation are ordered by slice
    and window.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = long_conversations(rows, slice_turns)
    rows = sliced(rows, long).withColumn("copy", F.lit(False))
    if not long.isEmpty():
        rows = rows.unionByName(_later_heads(rows, long))

    piece = F.concat(F.col("open"), F.col("body"), _closing(F.col("role")))
    rows = rows.withColumn("open", _opened(F.col("role"))).withColumn("body", escaped(F.col("text"))).withColumn("piece", piece)
    rows = rows.withColumn("tokens", tokens(F.col("piece"))).withColumn("begins", F.char_length("open")).withColumn("signs", F.char_length("body"))

    place = ["conv_id", "slice"]
    line = Window.partitionBy(*place).orderBy(F.desc("copy"), *turn_order())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("nth", F.row_number().over(line)).withColumn("head", (F.col("nth") == 1) & (F.col("role") == "system") & (F.col("copy") | (F.col("slice") == 0)) & (F.col("tokens") <= budget // 4))
    system = F.first(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(line)
    rows = rows.withColumn("cell", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - system) / 2)).cast("long"))
    counted = F.when(F.col("copy"), F.lit(0)).otherwise(F.col("tokens"))
    rows = rows.withColumn("own", F.col("tokens") > F.col("cell")).withColumn("c", F.coalesce(F.sum(counted).over(before), F.lit(0)))
    alone = F.coalesce(F.sum(F.when(F.col("own") & ~F.col("copy"), 1).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("key", F.struct((2 * alone + F.col("own").cast("int")).alias("part"), F.when(F.col("own"), 0).otherwise(F.floor(F.col("c") / F.col("cell"))).alias("at")))
    new = F.when(F.col("copy"), 0).when(F.lag("copy").over(line) | F.lag("key").over(line).isNull(), 0).when(F.col("key") != F.lag("key").over(line), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("window", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.max("window").over(Window.partitionBy(*place)))
    rows = rows.withColumn("end", F.max(F.when(~F.col("copy"), F.col("c") + F.col("tokens"))).over(Window.partitionBy(*place, "window")))

    here = F.struct(F.col("window").alias("window"), F.lit(True).alias("fresh"))
    again = lambda w: F.struct(w.alias("window"), F.lit(False).alias("fresh"))
    none = F.filter(F.array(here), lambda x: F.lit(False))
    tail = (F.col("window") < F.col("last")) & (F.col("end") - F.col("c") <= history)
    begin = F.when(F.col("copy"), F.col("window")).otherwise(F.col("window") + 1)
    places = F.when(F.col("head"), F.concat(F.when(F.col("copy"), none).otherwise(F.array(here)), F.when(begin <= F.col("last"), F.transform(F.sequence(begin, "last"), again)).otherwise(none)))
    places = places.when(F.col("copy"), none).otherwise(F.concat(F.array(here), F.when(tail, F.array(again(F.col("window") + 1))).otherwise(none)))
    put = rows.select(*place, "nth", "role", "piece", "tokens", "begins", "signs", F.explode(places).alias("p")).select(*place, "p.window", "p.fresh", "nth", "role", "piece", "tokens", "begins", "signs")

    inside = Window.partitionBy(*place, "window").orderBy("nth")
    put = put.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("begins"))
    made = put.groupBy(*place, "window").agg(
        F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("fresh") & (F.col("role") == "assistant"), F.struct(F.col("start").alias("start"), F.col("signs").cast("long").alias("length"))))).alias("loss"),
        F.sum(F.when(F.col("fresh"), 0).otherwise(1)).alias("repeated"),
        F.sum(F.when(F.col("fresh"), 1).otherwise(0)).alias("fresh"),
        F.sum("tokens").alias("tokens"),
    )
    return made.where("fresh > 0").select(*place, "window", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("text"), "loss", "repeated", "fresh", "tokens")


def _parsed(piece: Column) -> Column:
    """A formatted turn as (role, text)."""
    other = F.struct(unescaped(F.regexp_extract(piece, r"(?s)^\[ROLE\](.*?)\[INST\] ", 1)).alias("role"), unescaped(F.regexp_extract(piece, r"(?s)^\[ROLE\].*?\[INST\] (.*) \[/ROLE\]$", 1)).alias("text"))
    out = other
    for name, (begin, end) in MARKS.items():
        body = F.substring(piece, F.lit(len(begin) + 1), F.char_length(piece) - len(begin) - len(end))
        out = F.when(F.startswith(piece, F.lit(begin)), F.struct(F.lit(name).alias("role"), unescaped(body).alias("text"))).otherwise(out)
    return out


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, slice, window, turns, learned): a window's fresh turns as (role, text), and the texts under its loss mask, from what is written."""
    pieces = F.regexp_extract_all("text", F.lit(TURN), 0)
    fresh = F.slice(pieces, F.col("repeated").cast("int") + 1, F.greatest(F.size(pieces), F.lit(1)))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.select("conv_id", "slice", "window", F.transform(fresh, _parsed).alias("turns"), learned.alias("learned"), F.char_length("text").alias("chars"))


def chat_digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows; its digest needs the conversation's texts as one string."""
    read = read_windows(windows)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read.select("conv_id", F.size("turns").alias("n"), "chars", F.struct("slice", "window", lines.alias("turns"), F.array_join("learned", "").alias("learned")).alias("x"))
    by = each.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list("x")).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda w: w[name]), "")
    return by.select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.char_length(joined("learned")).cast("long").alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")


def written(windows: DataFrame) -> DataFrame:
    """The windows as a table in the shared folder, so that reading back starts from files."""
    return checkpointed(windows)
