"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of `>` before its text.  Maximal runs of lines of one level are
passages; passages, and their lines one by one, are normalised (lower case, white space runs as one
blank) and hashed.  Level-0 passages, lines and the whole unquoted text of a message are what it says
itself; the original of a hash is the earliest turn of the conversation that says it.  A message
answers the earlier turn that its quotes point to: those of the lowest level first, then by weight (a
passage found whole counts its lines and one more, a line one), then the latest such turn.  A thread,
which is a turn that answers nothing and all that answers it or its answers, is put in reply order (each
turn before its answers, those by turn) by a tour that enters and leaves every turn; pointer doubling
ranks the tour, so a chain of n answers takes some log n rounds of 2 n rows.

Originals are aggregated before the join, so a line that all messages share is one row there; nothing
is grouped by conversation alone, so one conversation may hold most rows.

Edge cases: null text is empty; messages with null conversation or turn answer nothing and are
answered by none; of repeated turns each row is kept, and they share what any of them answers; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import whole, written

MARKS = r"^((?:[ \t]*>)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, pos, level, body) of each line."""
    lines = messages.select("row", "conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    return lines.select("row", "conv_id", "turn", "pos", F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace("line", MARKS, "").alias("body"))


def passages(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, n_lines, text) of each passage; a window holds the lines of one message."""
    order = Window.partitionBy("row").orderBy("pos")
    lines = _lines(messages).withColumn("begins", (F.col("level") != F.lag("level").over(order)).cast("int"))
    runs = lines.withColumn("run", F.sum(F.coalesce("begins", F.lit(1))).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    return runs.groupBy("row", "conv_id", "turn", "run", "level").agg(joined.alias("text"), F.count("*").alias("n_lines"))


def _keys(found: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, weight, hash) of passages and of their lines; blank ones have none."""
    parts = found.select("row", "conv_id", "turn", "level", F.explode(F.concat(F.array(F.struct((F.col("n_lines") + 1).alias("weight"), F.col("text"))), F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(1).cast("bigint").alias("weight"), x.alias("text"))))).alias("part"))
    parts = parts.select("row", "conv_id", "turn", "level", "part.weight", normalised(F.col("part.text")).alias("norm")).where("norm <> ''")
    return parts.select("row", "conv_id", "turn", "level", "weight", F.sha2("norm", 256).alias("hash"))


def own_text(text: Column) -> Column:
    """The lines of level 0, without blanks around them."""
    return F.regexp_replace(F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(MARKS)), "\n"), r"^\s+|\s+$", "")


def answers(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of each turn whose quotes lead to an earlier one."""
    found = written(passages(messages), "chat-passages")
    said = _keys(found.where("level = 0"))
    whole_texts = messages.select("row", "conv_id", "turn", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("n_lines"), own_text(F.col("text")).alias("text"))
    originals = said.unionByName(_keys(whole_texts)).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = _keys(found.where("level > 0"))
    links = quoted.join(originals, ["conv_id", "hash"]).where("original < turn")
    votes = links.groupBy("conv_id", "turn", "level", "original").agg(F.sum("weight").alias("weight"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "weight", "original"))["original"].alias("parent_turn"))


def followed(links: DataFrame) -> DataFrame:
    """links (conv_id, parent_turn, turn) with `sibling`, the next turn that answers the same one, null for the last.

    Rows are dealt by ranges of their order, so the answers of one turn may lie in many tasks; the last row of a
    range takes the first one of the next range, of which there are no more than partitions.
    """
    order = ["conv_id", "parent_turn", "turn"]
    dealt = written(links.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "chat-ranges")
    firsts = dealt.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("beyond"))
    here = dealt.withColumn("after", F.lead(F.struct(*order)).over(Window.partitionBy("part").orderBy(*order)))
    after = F.coalesce("after", "beyond")
    same = (after["conv_id"] == F.col("conv_id")) & (after["parent_turn"] == F.col("parent_turn"))
    return here.join(F.broadcast(firsts), "part").select(*order, F.when(same, after["turn"]).alias("sibling"))


def ranked(lists: DataFrame) -> DataFrame:
    """lists (conv_id, at, next, n, rise) with n and rise summed from each element to its list's end, and that end as `last`."""
    state = written(lists.withColumn("last", F.coalesce("next", "at")), "chat-tour")
    while state.where("next IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("next").alias("then"), F.col("last").alias("end"), F.col("n").alias("n_more"), F.col("rise").alias("rise_more"))
        joined = state.join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("next") == F.col("a")), "left")
        sums = [(F.col(x) + F.coalesce(f"{x}_more", F.lit(0).cast("bigint"))).alias(x) for x in ("n", "rise")]
        state = written(joined.select("conv_id", "at", F.col("then").alias("next"), *sums, F.coalesce("end", "last").alias("last")), "chat-tour")
    return state


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth, position) of each turn that answers one (conv_id, turn, parent_turn) or is answered; position is its place in the thread."""
    links = followed(parents)
    roots = links.select("conv_id", F.col("parent_turn").alias("turn")).distinct().join(links, ["conv_id", "turn"], "left_anti")
    nothing = F.lit(None).cast("bigint")
    first = links.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    turns = links.unionByName(roots.withColumns({"parent_turn": nothing, "sibling": nothing})).join(first, ["conv_id", "turn"], "left")
    turns = written(turns, "chat-turns")

    def event(turn, leaves):
        return F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))

    one, here = F.lit(1).cast("bigint"), F.col("turn")
    enter = turns.select("conv_id", event(here, False).alias("at"), F.coalesce(F.when(F.col("child").isNotNull(), event(F.col("child"), False)), event(here, True)).alias("next"), one.alias("n"), one.alias("rise"))
    answered = F.when(F.col("parent_turn").isNotNull(), event(F.col("parent_turn"), True))
    leave = turns.select("conv_id", event(here, True).alias("at"), F.coalesce(F.when(F.col("sibling").isNotNull(), event(F.col("sibling"), False)), answered).alias("next"), (one - 1).alias("n"), (-one).alias("rise"))
    # from a turn's entry to the end one more turn is left for each level above it, and n turns are entered
    tour = ranked(enter.union(leave)).where("NOT at.leaves").select("conv_id", F.col("at.turn").alias("turn"), F.col("last.turn").alias("root_turn"), (-F.col("rise")).cast("int").alias("depth"), "n")
    whole_thread = tour.groupBy("conv_id", "root_turn").agg(F.max("n").alias("size"))
    placed = tour.join(whole_thread, ["conv_id", "root_turn"]).withColumn("position", F.col("size") - F.col("n"))
    return placed.join(turns.select("conv_id", "turn", "parent_turn"), ["conv_id", "turn"]).select("conv_id", "turn", "parent_turn", "root_turn", "depth", "position")


def format_chats(conversations: DataFrame, opening: str = "<|", closing: str = "|>") -> DataFrame:
    """Every message in reply order: conv_id, turn, role, parent_turn, root_turn, depth, position (place in the thread), n_quoted_lines, text (unquoted) and chat (under its role)."""
    messages = conversations.select(F.monotonically_increasing_id().alias("row"), "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", whole("text").alias("text"))
    messages = written(messages, "chat-messages")
    rows = messages.join(threads(written(answers(messages), "chat-answers")), ["conv_id", "turn"], "left")
    quoted = F.size(F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(MARKS)))
    chat = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit(closing + "\n"), own_text(F.col("text")))
    out = rows.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0).cast("bigint")).alias("position"),
        quoted.alias("n_quoted_lines"), own_text(F.col("text")).alias("text"), chat.alias("chat"), "row",
    )
    return out.orderBy("conv_id", "root_turn", "position", "row").drop("row")
