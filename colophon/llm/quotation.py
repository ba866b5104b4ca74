"""Chat formatting by quotation: link quotes to what they quote, order by reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Nested quote marks at the start of a line.
_QUOTE = r"^[ \t]*((?:>[ \t]?)*)"
#: Rounds that pointer doubling takes at most: replies nested 2^40 deep.
_ROUNDS = 40


def normalised(passage: Column) -> Column:
    """A-Z lower-cased, white space single, no space at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(passage), r"[ \t\r\n\u000B\f]+", " "))


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, _QUOTE, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def message_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage): the normalised passages of every message, with their quote level.

    A passage is a line, or a paragraph: lines in a row of one level, up to a blank one.
    A paragraph is the same however its lines are wrapped.
    """
    cut = messages.select("conv_id", "turn", F.split("text", r"\r?\n").alias("lines"))
    marked = cut.select("conv_id", "turn", F.transform("lines", _level).alias("levels"), F.transform("lines", lambda x: F.regexp_replace(F.regexp_replace(x, _QUOTE, ""), "[\u0001\u0002]", "")).alias("bare"))
    # A paragraph begins where the level changes or the line before is blank.
    before = lambda array, i: F.get(F.col(array), i - 1)
    opens = lambda i: (i == 0) | ~before("levels", i).eqNullSafe(F.get("levels", i)) | (F.trim(F.coalesce(before("bare", i), F.lit(""))) == "")
    start = lambda i: F.concat(F.lit("\u0001"), F.get("levels", i).cast("string"), F.lit("\u0002"))
    joined = F.array_join(F.transform("bare", lambda x, i: F.concat(F.when(opens(i), start(i)).otherwise(F.lit(" ")), x)), "")
    paragraphs = F.transform(F.filter(F.split(joined, "\u0001"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "\u0002", 1).cast("int").alias("level"), F.substring_index(p, "\u0002", -1).alias("text")))
    lines = F.zip_with("levels", "bare", lambda n, x: F.struct(n.alias("level"), x.alias("text")))
    rows = marked.select("conv_id", "turn", F.explode(F.concat(lines, paragraphs)).alias("p"))
    return rows.select("conv_id", "turn", "p.level", normalised(F.col("p.text")).alias("passage")).where("passage != ''").distinct()


def quotation_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, passages, level): the message that each message quotes.

    A passage is a quoted line or paragraph, normalised and hashed by SHA-256 with the
    level it had: what is quoted at level k was at level k - 1 in the message quoted. It
    belongs to the first message of its conversation that holds it, if that is earlier.
    The parent is the message of most of a message's passages at their lowest level, the
    latest among equals. Passages are counted per message before they are joined, and the
    side joined to has one row per passage, so one very common passage costs a row a
    message.
    """
    hashed = message_passages(messages).select("conv_id", "turn", "level", F.sha2("passage", 256).alias("passage_hash")).distinct()
    origin = hashed.groupBy("conv_id", F.col("level").alias("o_level"), "passage_hash").agg(F.min("turn").alias("origin"))
    quotes = hashed.where("level > 0").withColumn("o_level", F.col("level") - 1)
    found = quotes.join(origin, ["conv_id", "o_level", "passage_hash"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("passages"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("passages")).alias("fewer"), (-F.col("origin")).alias("earlier"))).alias("b"))
    return best.select("conv_id", "turn", (-F.col("b.earlier")).alias("parent_turn"), (-F.col("b.fewer")).alias("passages"), F.col("b.level").cast("int").alias("level"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth): where the chain of parents of every reply begins.

    Parents are earlier turns, so chains end. Each round doubles how far a message looks.
    """
    at = stored(links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")), "replies")
    for _ in range(_ROUNDS):
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = stored(at.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "replies")
        at = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    return at.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Conversations without quotes, in reply order, one row a message.

    Columns: conv_id, thread_turn, turn, role, parent_turn, depth, n_quoted_lines,
    max_level, text (the lines of level 0, ends trimmed). Sorted by conv_id, thread_turn
    and turn, a thread stands together and a reply after what it answers, replies to one
    message in the order of their turns; a message that quotes nothing found starts a
    thread of its own.

    Null texts have no lines and an empty text; messages with a null conv_id or turn
    are returned, each a thread, but linked to none; of rows that repeat a conv_id and
    turn each is returned, with the links of all. Other columns are not read.
    """
    # Parsed and linked once; both are read twice.
    links = stored(quotation_links(messages.where("conv_id is not null and turn is not null")), "quotations")
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    bare = messages.select(
        "conv_id",
        "turn",
        "role",
        F.trim(F.array_join(F.filter(lines, lambda x: _level(x) == 0), "\n"), F.lit(" \t\r\n")).alias("text"),
        F.size(F.filter(lines, lambda x: _level(x) > 0)).alias("n_quoted_lines"),
        F.array_max(F.transform(lines, _level)).alias("max_level"),
    )
    return (
        bare.join(links.select("conv_id", "turn", "parent_turn"), ["conv_id", "turn"], "left")
        .join(_threads(links), ["conv_id", "turn"], "left")
        .select("conv_id", F.coalesce("thread_turn", "turn").alias("thread_turn"), "turn", "role", "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted_lines", "max_level", "text")
    )


def _reply_order(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, place): where each message of ``ordered`` stands when every reply follows what
    it answers, with all replies to it, before the next reply to the same message.

    The walk around a thread enters and leaves each message once. What follows a step is
    known from parents and siblings alone, and pointer doubling sums the entries from
    each step to the thread's end, so a thread of any shape takes as many rounds as its
    length has bits, and no task holds a thread.
    """
    first = ordered.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    siblings = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    after = F.when(F.col("parent_turn").isNotNull(), F.lead("turn").over(siblings))
    nodes = ordered.withColumn("next", after).join(first.where("turn is not null"), ["conv_id", "turn"], "left")
    step = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    enter = F.coalesce(F.when(F.col("child").isNotNull(), step(F.col("child"), False)), step(F.col("turn"), True))
    leave = F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("parent_turn").isNotNull(), step(F.col("parent_turn"), True))
    steps = nodes.select("conv_id", F.explode(F.array(F.struct(step(F.col("turn"), False).alias("at"), enter.alias("to"), F.lit(1).alias("n")), F.struct(step(F.col("turn"), True).alias("at"), leave.alias("to"), F.lit(0).alias("n")))).alias("s")).select("conv_id", "s.*")
    at = stored(steps, "steps")
    for _ in range(_ROUNDS):
        ahead = at.select("conv_id", F.col("at").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
        at = stored(at.join(ahead, ["conv_id", "to"], "left").select("conv_id", "at", F.col("further").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "steps")
        if at.where("to is not null").isEmpty():
            break
    entered = at.where("not at.leaves").select("conv_id", F.col("at.turn").alias("turn"), F.col("n").alias("left"))
    return entered.select("conv_id", "turn", (-F.col("left")).alias("place"))


def conversations(messages: DataFrame, most: int = 1000) -> DataFrame:
    """(conv_id, thread_turn, part, messages): threads without quotes, formatted as records.

    ``messages`` is an array of (role, text, turn, parent_turn, depth) in depth-first reply
    order: each reply and all that answers it stand before the next reply to the same
    message. A thread of more than ``most`` messages goes on in further records, part 0, 1
    and so on, each with the places after those of the one before it, so no record is
    without a bound. Messages whose text is empty without quotes stay.

    Nulls as in ``reply_ordered``: a message with a null conv_id or turn is a record of its
    own. Rows that repeat a conv_id and turn stand one after another, in the order of role
    and text. An empty table gives none.
    """
    rows = stored(reply_ordered(messages), "messages")
    known = rows.where("conv_id is not null and turn is not null")
    linked = known.select("conv_id", "turn", "parent_turn", "thread_turn").distinct()
    places = _reply_order(linked.select("conv_id", "turn", "parent_turn"))
    # Copies of a turn take further places of their own, so parts are cut by rows.
    copies = known.groupBy("conv_id", "thread_turn", "turn").agg(F.count("*").alias("copies"))
    placed = copies.join(places, ["conv_id", "turn"])
    before = F.sum("copies").over(Window.partitionBy("conv_id", "thread_turn").orderBy("place")) - F.col("copies")
    starts = placed.select("conv_id", "turn", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    at = known.join(starts, ["conv_id", "turn"]).withColumn("at", F.col("before") + own)
    message = F.struct("role", "text", "turn", "parent_turn", "depth")
    records = (
        at.groupBy("conv_id", "thread_turn", F.floor(F.col("at") / F.lit(most)).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("at", message.alias("m")))).alias("found"))
        .select("conv_id", "thread_turn", "part", F.transform("found", lambda x: x["m"]).alias("messages"))
    )
    alone = rows.where("conv_id is null or turn is null").select("conv_id", "thread_turn", F.lit(0).alias("part"), F.array(message).alias("messages"))
    return records.unionByName(alone)
