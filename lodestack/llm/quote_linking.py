"""Chat formatting by quotation linking: quoted lines find their messages, which gives the order of replies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import bound
from lodestack.llm.common import drop_stored, sent, stored

BLANK = "[\\x20\\x09-\\x0D]+"
QUOTED = "^((?:[\\x20\\x09]*>)+)"
#: A line that announces the quotation below it.
ANNOUNCED = r"(?m)^[^\n]*(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*\n([ \t]*>)"


def level(line: Column) -> Column:
    """How many quotation marks a line begins with."""
    return F.regexp_count(F.regexp_extract(line, QUOTED, 1), F.lit(">"))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, QUOTED, ""), BLANK, " ")))


def own_text(text: Column) -> Column:
    """A message without its quoted lines and the lines that announce them."""
    lines = F.split(F.regexp_replace(text, ANNOUNCED, "$1"), "\n")
    return F.regexp_replace(F.array_join(F.filter(lines, lambda line: level(line) == 0), "\n"), f"^{BLANK}|{BLANK}$", "")


def passages(lines: Column) -> Column:
    """(level, norm, n) of every run of lines of one quotation level, up to a blank line: the normalised lines, joined, and their number."""
    marked = F.transform(lines, lambda line: F.struct(level(line).alias("level"), normalised(line).alias("norm")))

    def runs(own: Column) -> Column:
        def begins(k: Column) -> Column:
            this, before = F.get(own, k), F.get(own, k - 1)
            return (this["norm"] != "") & (before.isNull() | (before["norm"] == "") | (before["level"] != this["level"]))

        def run(starts: Column) -> Column:
            def of(at: Column, k: Column) -> Column:
                part = F.filter(F.slice(own, at + 1, F.coalesce(F.get(starts, k + 1), F.size(own)) - at), lambda x: x["norm"] != "")
                texts = F.transform(part, lambda x: x["norm"])
                return F.struct(F.get(own, at)["level"].alias("level"), F.array_join(texts, "\n").alias("norm"), F.size(part).alias("n"))

            return F.transform(starts, of)

        return bound(F.filter(F.sequence(F.lit(0), F.size(own) - 1), begins), run)

    return bound(marked, runs)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, **weights: Column) -> DataFrame:
    """rows with `before`, the largest value of the rows before in the order within `by`, and under each name the sum of that weight over them. No two rows share by and order.

    Rows are dealt by ranges of (by, order), so even one group of all rows is spread over all tasks; what earlier parts hold of a group comes to it from
    a table of a row for each part of a group that several parts share, at most twice as many as there are parts.
    """
    sums = [f"_w_{w}" for w in weights]
    dealt = rows.withColumns({"_value": value} | dict(zip(sums, weights.values()))).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "running")
    part = dealt.groupBy("_part", *by).agg(F.max("_value").alias("_value"), F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(c) for c in sums))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.sum(c).over(earlier).alias(f"_ahead{c}") for c in sums]
    carried = part.select(*(F.col(c).alias(f"_of{c}") for c in ("_part", *by)), F.max("_value").over(earlier).alias("_above"), F.sum("_n").over(earlier).alias("_rows"), *ahead)
    carried = sent(stored(carried.filter("_rows is not null"), "carried"))
    here = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", F.max("_value").over(here).alias("_own"), *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_sum{c}") for c in sums))
    joined = local.join(carried, [F.col(c) == F.col(f"_of{c}") for c in ("_part", *by)], "left")
    passed = [(F.col(f"_sum{c}") + F.coalesce(f"_ahead{c}", F.lit(0))).alias(w) for w, c in zip(weights, sums)]
    return joined.select(*rows.columns, F.greatest("_own", "_above").alias("before"), *passed)


def quote_links(messages: DataFrame) -> DataFrame:
    """(_key, _turn, parent, lines) for messages (_key, _turn, _text) that quote an earlier one.

    Each quoted passage, and each of its lines, is hashed with 128 bits and meets the last earlier message of its conversation that has it as its own: a running maximum
    over (conversation, hash), of quoted hashes alone, so the work is linear however often a line recurs. Of the messages so found, the parent is that of the outermost quotation level, then
    with the most lines in whole passages, then with the most lines, then the latest. lines: quoted lines found in the parent.
    """
    found = messages.select("_key", "_turn", F.explode(passages(F.split(F.regexp_replace("_text", ANNOUNCED, "$1"), "\n"))).alias("p")).select("_key", "_turn", "p.*")
    single = F.struct("level", "norm", F.lit(1).alias("n"), F.lit(0).alias("whole"))
    split = F.transform(F.split("norm", "\n"), lambda line: F.struct(F.col("level"), line.alias("norm"), F.lit(1).alias("n"), F.lit(0).alias("whole")))
    units = F.when(F.col("n") == 1, F.array(single)).otherwise(F.concat(F.array(F.struct("level", "norm", F.lit(0).alias("n"), F.col("n").alias("whole"))), split))
    each = found.select("_key", "_turn", F.explode(units).alias("u")).select("_key", "_turn", "u.level", F.unhex(F.md5("u.norm")).alias("hash"), "u.n", "u.whole")
    hashed = stored(each.groupBy("_key", "_turn", "level", "hash").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")), "quoted")
    quoted = hashed.filter("level > 0")
    asked = quoted.select(F.col("_key").alias("k"), F.col("hash").alias("h")).distinct()
    places = hashed.join(asked, (F.col("_key") == F.col("k")) & (F.col("hash") == F.col("h")), "left_semi").groupBy("_key", "hash", "_turn").agg(F.bool_or(F.col("level") == 0).alias("own"))
    last = running(places, ["_key", "hash"], ["_turn"], F.when(F.col("own"), F.col("_turn")))
    last = last.filter("before is not null").select(F.col("_key").alias("k"), F.col("hash").alias("h"), F.col("_turn").alias("t"), F.col("before").alias("parent"))
    same = (F.col("_key") == F.col("k")) & (F.col("hash") == F.col("h")) & (F.col("_turn") == F.col("t"))
    votes = quoted.join(last, same).groupBy("_key", "_turn", "level", "parent").agg(F.sum("n").alias("lines"), F.sum("whole").alias("whole"))
    best = F.max_by(F.struct("parent", F.greatest("lines", "whole").alias("lines")), F.struct(-F.col("level"), F.col("whole"), F.col("lines"), F.col("parent"))).alias("best")
    return votes.groupBy("_key", "_turn").agg(best).select("_key", "_turn", "best.*")


def jumped(table: DataFrame, name: str, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """(_key, seg, value) from (_key, seg, to, value), where each row's value is joined with those along its way; a round doubles the steps, so a way of n takes log2(n) rounds."""
    now = stored(table, name)
    while not now.filter("to is not null").isEmpty():
        on = now.select(F.col("_key").alias("k"), F.col("seg").alias("s"), F.col("to").alias("to2"), F.col("value").alias("value2"))
        then = now.join(on, (F.col("_key") == F.col("k")) & (F.col("to") == F.col("s")), "left")
        then = stored(then.select("_key", "seg", F.col("to2").alias("to"), joined(F.col("value"), F.col("value2")).alias("value")), name)
        drop_stored(now)
        now = then
    return now.select("_key", "seg", "value")


def thread_places(replies: DataFrame) -> DataFrame:
    """(_key, rank, seg, start, depth) of messages (_key, rank, m, parent_rank) of conversations with branches: the first place of the message's run of replies, and the depth of that run.

    Messages that reply to the one before them form runs, so the tree is one of runs, as many as there are branches. Depth first, a run comes whole; then the runs that
    branch off from it, those from its later messages first, and from the same message in order. Each run's successor follows from its first branch, its next sibling, or the
    next sibling of what it branches off from; places are sums along successors.
    """
    breaks = F.when((F.col("rank") == 1) | (F.col("parent_rank") != F.col("rank") - 1), F.col("rank"))
    within = running(replies, ["_key"], ["rank"], breaks, passed=F.col("m"))
    within = stored(within.withColumn("seg", F.coalesce(breaks, "before")), "runs-of-replies")
    segs = within.groupBy("_key", "seg").agg(F.sum("m").alias("len"), F.max(F.when(F.col("rank") == F.col("seg"), F.col("parent_rank"))).alias("at"))
    above = within.select(F.col("_key").alias("k"), F.col("rank").alias("r"), F.col("seg").alias("pseg"))
    segs = stored(segs.join(above, (F.col("_key") == F.col("k")) & (F.col("at") == F.col("r")), "left").select("_key", "seg", "len", "at", "pseg"), "runs")
    place = F.struct(F.col("at").alias("at"), (-F.col("seg")).alias("back"))
    children = segs.filter("pseg is not null").withColumn("back", -F.col("seg"))
    siblings = running(children, ["_key", "pseg"], ["at", "back"], place).select(F.col("_key").alias("k"), F.col("seg").alias("s"), (-F.col("before.back")).alias("sibling"))
    # in this order the one before is the next to be placed: later attachments first, earlier messages first
    first = children.groupBy(F.col("_key").alias("k"), F.col("pseg").alias("s")).agg((-F.max(place)["back"]).alias("child"))
    same = (F.col("_key") == F.col("k")) & (F.col("seg") == F.col("s"))
    ups = segs.join(siblings, same, "left").select("_key", "seg", F.when(F.col("sibling").isNull(), F.col("pseg")).alias("to"), F.col("sibling").alias("value"))
    ups = jumped(ups, "ups", lambda own, further: F.coalesce(own, further)).select(F.col("_key").alias("uk"), F.col("seg").alias("us"), F.col("value").alias("up"))
    following = segs.join(first, same, "left").join(ups, (F.col("_key") == F.col("uk")) & (F.col("seg") == F.col("us")), "left")
    rest = jumped(following.select("_key", "seg", F.coalesce("child", "up").alias("to"), F.col("len").alias("value")), "rests", lambda own, further: own + F.coalesce(further, F.lit(0)))
    steps = F.coalesce(F.col("at") - F.col("pseg") + 1, F.lit(0))
    depths = jumped(segs.select("_key", "seg", F.col("pseg").alias("to"), steps.alias("value")), "depths", lambda own, further: own + F.coalesce(further, F.lit(0)))
    totals = segs.groupBy(F.col("_key").alias("tk")).agg(F.sum("len").alias("total"))
    starts = rest.join(totals, F.col("_key") == F.col("tk")).select(F.col("_key").alias("sk"), F.col("seg").alias("ss"), (F.col("total") - F.col("value")).alias("start"))
    deep = depths.select(F.col("_key").alias("dk"), F.col("seg").alias("ds"), F.col("value").alias("deep"))
    heads = within.filter("rank = seg").select(F.col("_key").alias("hk"), F.col("seg").alias("hs"), F.col("passed").alias("ahead"))
    runs = starts.join(deep, (F.col("sk") == F.col("dk")) & (F.col("ss") == F.col("ds"))).join(heads, (F.col("sk") == F.col("hk")) & (F.col("ss") == F.col("hs")))
    full = within.join(runs, (F.col("_key") == F.col("sk")) & (F.col("seg") == F.col("ss")))
    return full.select("_key", "rank", (F.col("start") + F.col("passed") - F.col("ahead")).alias("start"), (F.col("deep") + F.col("rank") - F.col("seg")).alias("depth"))


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_col, turn_col, role_col, text (without quotations), reply_to, linked, quoted_lines, root, depth, position.

    reply_to is the message whose passages it quotes (linked), else the one before it in its conversation; root is the first of its thread, depth the number of replies up to it. position
    numbers a conversation's messages in the order of replies, depth first: after a message come the replies to it with all that follow from them, earlier replies first. So a message that quotes an early one
    comes behind what the early one led to. Only conversations with such branches need more than the order of turns.

    No task holds a conversation: ranks and places come from ranges of short rows, and texts meet their place by conversation and turn. Equal rows are one until they have their place.

    Defined cases: null texts count as empty; a null conversation is one of its own; a null turn is before all others; rows that share conversation and
    turn have one place in the thread and follow one another by role and text; a message that is only quotations has an empty text; texts of any length and number of lines are read whole;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = messages.select(
        F.col(conv_col).alias("_conv"), F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("_key"), F.col(turn_col).cast("bigint").alias("_given"),
        F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-(2**62))).alias("_turn"), F.col(role_col).alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    turns = rows.groupBy("_key", "_turn").agg(F.count(F.lit(1)).alias("m"))
    ranked = running(turns, ["_key"], ["_turn"], F.col("_turn"), turns=F.lit(1), ahead=F.col("m"))
    ranked = ranked.select("_key", "_turn", "m", (F.col("turns") + 1).alias("rank"), F.col("before").alias("previous"), "ahead")
    same = (F.col("_key") == F.col("k")) & (F.col("_turn") == F.col("t"))
    links = quote_links(rows).select(F.col("_key").alias("k"), F.col("_turn").alias("t"), "parent", "lines")
    replies = ranked.join(links, same, "left").select(
        "_key", "_turn", "m", "rank", "ahead", F.coalesce("parent", "previous").alias("parent"), F.col("parent").isNotNull().alias("linked"),
        F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"), (F.coalesce("parent", "previous") != F.col("previous")).alias("branches"),
    )
    replies = stored(replies, "parents")
    first = replies.filter("rank = 1").select(F.col("_key").alias("k1"), F.col("_turn").alias("root"))
    branched = replies.filter("branches").select(F.col("_key").alias("bk")).distinct()
    straight = F.struct(F.col("ahead").alias("start"), (F.col("rank") - 1).alias("depth"))
    places = replies
    if branched.isEmpty():
        places = places.withColumn("at", straight)
    else:
        some = replies.join(branched, F.col("_key") == F.col("bk"), "left_semi").select("_key", "_turn", "rank", "m", "parent")
        ranks = some.select(F.col("_key").alias("k"), F.col("_turn").alias("t"), F.col("rank").alias("parent_rank"))
        some = some.join(ranks, (F.col("_key") == F.col("k")) & (F.col("parent") == F.col("t")), "left").select("_key", "rank", "m", "parent_rank")
        threads = thread_places(some).select(F.col("_key").alias("k"), F.col("rank").alias("r"), F.struct("start", "depth").alias("thread"))
        places = places.join(threads, (F.col("_key") == F.col("k")) & (F.col("rank") == F.col("r")), "left").withColumn("at", F.coalesce("thread", straight))
    places = places.join(first, F.col("_key") == F.col("k1")).select(F.col("_key").alias("k"), F.col("_turn").alias("t"), "parent", "linked", "lines", "root", "at")
    equal = rows.groupBy("_key", "_turn", "_conv", "_given", "_role", "_text").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("_key", "_turn").orderBy("_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    full = equal.withColumn("behind", F.coalesce(F.sum("n").over(within), F.lit(0))).join(places, same)
    full = full.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))

    def shown(turn: str) -> Column:
        return F.when(F.col(turn) != -(2**62), F.col(turn))

    return full.select(
        F.col("_conv").alias(conv_col), F.col("_given").alias(turn_col), F.col("_role").alias(role_col), own_text(F.col("_text")).alias("text"), shown("parent").alias("reply_to"), "linked",
        F.col("lines").alias("quoted_lines"), shown("root").alias("root"), F.col("at.depth").cast("bigint").alias("depth"), (F.col("at.start") + F.col("behind") + F.col("copy")).cast("bigint").alias("position"),
    )
