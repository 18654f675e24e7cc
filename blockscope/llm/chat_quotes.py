"""Reply-ordered conversations from quotations, with DataFrame functions only.

A message's quoted passages are normalised, hashed and looked up among the earlier messages of its
conversation; the message answers the one its outermost quote comes from.  Quotes are then
taken out, and each message is placed after the one it answers.
"""


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockscope.llm.common import stored

QUOTED = r"^[ \t]*>"
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: Turns in a stretch; stretches only divide the work.
STRETCH = 1024
_ROUNDS = 64

# The line mail programs write above a quote, and the chat marks of the output.
ATTRIBUTION = r"(?m)^(?:On [^\n]+ wrote|[^\n]+ (?:wrote|said)):[ \t]*\r?\n(?=[ \t]*>)"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


# --- parsing -----------------------------------------------------------------------------------
def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def level_of(line: Column) -> Column:
    """How many quote marks a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them; unchanged if it quotes nothing."""
    plain = F.regexp_replace(text, ATTRIBUTION, "")
    plain = F.regexp_replace(plain, r"(?m)^[ \t]*>[^\n]*(?:\n|\z)", "")
    return F.when(has_quote(text), F.regexp_replace(plain, r"^\s+|\s+$", "")).otherwise(text)


def has_quote(text: Column) -> Column:
    return text.rlike(r"(?m)" + QUOTED)


def _parts(passage: Column) -> Column:
    """A passage as a whole, its paragraphs, lines and sentences, normalised; those without a word left out."""
    cuts = (r"\n[ \t]*\n", r"\n", r"(?<=[.!?])\s+")
    whole = F.concat(F.array(passage), *[F.split(passage, cut) for cut in cuts])
    every = F.transform(whole, normalised)
    return F.array_distinct(F.filter(every, lambda p: p != ""))


def quoted_passages(text: Column) -> Column:
    """Array of (level, passage): runs of lines with equally many quote marks, marks taken off."""
    lines = F.transform(
        _lines(text), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))
    )
    deepest = F.array_max(F.transform(lines, lambda x: x["level"]))

    def at_level(level: Column) -> Column:
        body = F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise(F.lit("\x00")))
        runs = F.split(F.array_join(body, "\n"), "\n?\x00\n?")
        runs = F.filter(runs, lambda r: normalised(r) != "")
        return F.transform(runs, lambda r: F.struct(level.alias("level"), r.alias("passage")))

    none = F.array().cast("array<struct<level:int,passage:string>>")
    return F.when(deepest > 0, F.flatten(F.transform(F.sequence(F.lit(1), deepest), at_level))).otherwise(none)


def passage_key(passage: Column) -> Column:
    return F.md5(normalised(passage))


def unlinked_passages(text: Column, linked: Column) -> Column:
    """The quoted passages whose key is not in ``linked``, in order of level; none if nothing is quoted."""
    known = F.coalesce(linked, F.array().cast("array<string>"))
    left = F.filter(quoted_passages(text), lambda p: ~F.array_contains(known, passage_key(p["passage"])))
    return F.when(has_quote(text), F.transform(left, lambda p: p["passage"])).otherwise(F.array().cast("array<string>"))


# --- order -------------------------------------------------------------------------------------
def last_before(df: DataFrame, keys: list[str], turn: str, value: str, name: str) -> DataFrame:
    """Adds the latest non-null ``value`` at an earlier ``turn`` of the same keys.

    Looked up inside stretches of turns, and from one stretch to the next by their last
    values, so that no group is larger than a stretch's rows or the number of stretches.
    """
    df = df.withColumn("__stretch", F.floor(F.col(turn) / STRETCH))
    inside = Window.partitionBy(*keys, "__stretch").orderBy(turn)
    inside = inside.rangeBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__near", F.last(value, ignorenulls=True).over(inside))
    latest = F.max(F.when(F.col(value).isNotNull(), F.struct(turn, value)))
    ends = df.groupBy(*keys, "__stretch").agg(latest.alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__far", F.last("__end", ignorenulls=True).over(earlier)[value]).drop("__end")
    return (
        rows.join(ends, [*keys, "__stretch"])
        .withColumn(name, F.coalesce("__near", "__far"))
        .drop("__stretch", "__near", "__far")
    )


# --- linking -----------------------------------------------------------------------------------
def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, passage, quoted_turn, size): where each message's quoted passages come from.

    ``messages`` has conv, turn and text.  A passage, named by its key, matches an earlier message's
    own text, or a paragraph, line or sentence of it, or does so by its own; the latest such message
    counts.  Only conversations that quote are compared.
    """
    quoting = messages.where(has_quote(F.col("text")))
    passages = quoting.select("conv", "turn", F.explode(quoted_passages(F.col("text"))).alias("p"))
    asked = passages.select(
        "conv", "turn", F.col("p.level").alias("level"), passage_key(F.col("p.passage")).alias("passage"),
        F.explode(_parts(F.col("p.passage"))).alias("part"),
    )
    keyed = [F.md5("part").alias("key"), F.length("part").alias("size")]
    asked = asked.select("conv", "turn", "level", "passage", *keyed).distinct()
    convs = quoting.select("conv").distinct()
    own = messages.join(convs, "conv", "left_semi")
    own = own.select("conv", "turn", F.explode(_parts(own_text(F.col("text")))).alias("part"))
    own = own.select("conv", "turn", F.md5("part").alias("key")).distinct()
    events = asked.withColumn("source", F.lit(None).cast("long")).unionByName(
        own.withColumns({
            "level": F.lit(0), "size": F.lit(0), "passage": F.lit(None).cast("string"), "source": F.col("turn")
        })
    )
    found = last_before(events, ["conv", "key"], "turn", "source", "quoted_turn")
    found = found.where((F.col("level") > 0) & F.col("quoted_turn").isNotNull())
    return found.select("conv", "turn", "level", "passage", "quoted_turn", "size")


def branch_depths(branches: DataFrame) -> DataFrame:
    """(conv, branch, depth) from (conv, branch, parent); parent is null for a first branch.

    Parents are followed in doubling steps, each written to the shared folder.
    """
    steps = stored(
        branches.select("conv", "branch", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")),
        "branches",
    )
    for _ in range(_ROUNDS):
        if steps.where(F.col("parent").isNotNull()).isEmpty():
            return steps.select("conv", "branch", "depth")
        up = steps.select(
            "conv", F.col("branch").alias("parent"), F.col("parent").alias("higher"), F.col("depth").alias("more")
        )
        steps = stored(
            steps.join(up, ["conv", "parent"], "left").select(
                "conv", "branch", F.col("higher").alias("parent"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "branches",
        )
    raise RuntimeError(f"reply chains did not end in {_ROUNDS} rounds")


def placed_turns(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, linked, branch, depth) for each (conv, turn), nulls left out.

    ``linked`` has the keys of the passages found in earlier messages, null if there are none.
    A message answers the message its quotes of the lowest level come from, the longest match
    first and then the latest; without a match it answers the one before it.  One that answers
    another than the one before it starts a branch, which later messages go on with.
    """
    known = messages.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    links = quote_links(known)
    best = F.max(F.struct((-F.col("level")).alias("l"), "size", "quoted_turn")).alias("best")
    keys = F.collect_set("passage").alias("linked")  # no more than the message quotes
    links = links.groupBy("conv", "turn").agg(best, keys)
    links = links.select("conv", "turn", F.col("best.quoted_turn").alias("quoted"), "linked")
    turns = known.select("conv", "turn").distinct().withColumn("own", F.col("turn"))
    turns = last_before(turns, ["conv"], "turn", "own", "before").drop("own")
    turns = turns.join(links, ["conv", "turn"], "left")
    starts = F.col("before").isNull() | (F.col("quoted") < F.col("before"))
    turns = turns.withColumn("start", F.when(starts, F.col("turn")))
    turns = last_before(turns, ["conv"], "turn", "start", "earlier")
    turns = stored(
        turns.select(
            "conv", "turn", F.coalesce("quoted", "before").alias("reply_to"), "linked",
            F.coalesce("start", "earlier").alias("branch"),
        ),
        "turns",
    )
    heads = turns.where(F.col("branch") == F.col("turn")).select("conv", "branch", "reply_to")
    later = heads.where(F.col("reply_to").isNotNull())
    above = turns.select("conv", F.col("turn").alias("reply_to"), F.col("branch").alias("parent"))
    later = later.join(above, ["conv", "reply_to"]).select("conv", "branch", "parent")
    if later.isEmpty():
        return turns.withColumn("depth", F.lit(0))
    first = heads.where(F.col("reply_to").isNull()).select("conv", "branch", F.lit(None).cast("long").alias("parent"))
    in_branches = first.join(later.select("conv").distinct(), "conv", "left_semi").unionByName(later)
    depths = branch_depths(in_branches)
    return turns.join(depths, ["conv", "branch"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def chat_text(role: Column, text: Column) -> Column:
    """One turn between chat marks; marks inside the text are broken up."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|", "< |")
    safe_role = F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\s<|>]", "")
    return F.concat(F.lit(TURN_START), safe_role, F.lit("\n"), safe, F.lit(TURN_END))


def reply_ordered(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message, sorted: conversation, depth of its branch, branch, turn.

    Adds ``reply_to``, ``quotes`` (a quote was found), ``branch`` (its first turn), ``depth``, the text
    without quotes, ``unlinked`` and ``chat``.  Only a message with a linked quote has its quotes taken
    out; passages that no earlier message holds are listed in ``unlinked``.  So every message stands after the one it answers, and a
    branch in one piece.  Turns are whole numbers.  Messages with a null conversation or turn
    answer nothing and are a branch of their own; repeated turns and rows share their place.
    A null text quotes nothing and stays null; an empty table gives no rows.
    """
    messages = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    placed = placed_turns(messages)
    rows = messages.join(placed, ["conv", "turn"], "left")
    rows = rows.withColumn("unlinked", unlinked_passages(F.col("text"), F.col("linked")))
    text = F.when(F.col("linked").isNotNull(), own_text(F.col("text"))).otherwise(F.col("text"))
    rows = rows.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "reply_to",
        F.col("linked").isNotNull().alias("quotes"),
        F.coalesce("branch", "turn").alias("branch"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        text.alias(text_col),
        "unlinked",
        chat_text(F.col("role"), text).alias("chat"),
    )
    return rows.orderBy(conv_col, "depth", "branch", turn_col, role_col, text_col)
