"""Conversations in reply order without quotes, by linking quoted passages to the messages they come from.

A line's quote level is the number of ``>`` marks that it starts with. Neighbouring lines of one level
above zero are a quoted passage; lines of level zero are the message's own, except for an attribution
("... wrote:") right before a quote. Passages and their lines are normalised (letters and digits only,
lower case) and hashed, the own lines and blocks of every message as well. A quoted unit belongs to the first
message of its conversation that said it, if that is an earlier turn. A message replies to the message
from which most quoted characters of its lowest linked level come, the latest of equals; without a link,
to the turn before it. Threads and depths follow from the reply links by doubling jumps, a number of rounds
that grows with the logarithm of the longest chain.

Joins meet on (conversation, unit) or (conversation, turn), where one side has one row per key, and hot
keys are answered by a bounded broadcast; no conversation is gathered anywhere.

Defined results: a null text counts as empty; a message without conversation or turn replies to nothing
and is a thread by itself; where the turn before is missing and nothing is linked, a thread begins; rows that
repeat a conversation and turn share the reply link, thread and depth; an empty table gives no rows. A text without
quotes stays as it is. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import counted, join_answers, let, text_of
from skylane.session import written

_MARKS = r"^(?:[ \t]{0,3}>)+"
# Attributions in a few languages (fixed values).
_ATTRIBUTION = r"(?i)^.{1,200}(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$"
_LINE = "struct<level:int,said:string>"
_BLOCKS = f"array<{_LINE}>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        level = F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))
        said = F.when(level > 0, F.trim(F.substring(x, F.char_length(marks) + 1, F.char_length(x)))).otherwise(x)
        return F.struct(level.cast("int").alias("level"), said.alias("said"))

    def without_attributions(lines: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            quotes = F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
            return ~((x["level"] == 0) & quotes & x["said"].rlike(_ATTRIBUTION))

        return F.filter(lines, stays)

    return let(F.transform(F.split(text, "\r?\n"), line), without_attributions)


def _blocks(lines: Column) -> Column:
    """Neighbouring lines of one level joined by line feeds."""

    def add(blocks: Column, x: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        joined = F.struct(x["level"].alias("level"), F.concat(last["said"], F.lit("\n"), x["said"]).alias("said"))
        grown = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(joined))
        return F.when(F.coalesce(last["level"] == x["level"], F.lit(False)), grown).otherwise(F.concat(blocks, F.array(x))).cast(_BLOCKS)

    return F.aggregate(lines, F.array().cast(_BLOCKS), add)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), blocks of every level, for each message; a written table."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_of().alias("text")
    )
    quoting = F.col("text").rlike(r"(?m)^[ \t]{0,3}>")
    alone = F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("said"))).cast(_BLOCKS)
    rows = rows.withColumn("blocks", F.when(quoting, let(_lines(F.col("text")), _blocks)).otherwise(alone))
    own = F.trim(F.array_join(F.transform(F.filter("blocks", lambda b: b["level"] == 0), lambda b: b["said"]), "\n"))
    return written(rows.select("conv_id", "turn", "role", F.when(quoting, own).otherwise(F.col("text")).alias("text"), "blocks"), "messages")


def _units(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, unit (hash), chars: every block and every line of it, once per message and level."""
    blocks = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("blocks").alias("b"))
    said = F.explode(F.array_distinct(F.concat(F.array("b.said"), F.split("b.said", "\n"))))
    lines = blocks.select("conv_id", "turn", "b.level", said.alias("said")).select("conv_id", "turn", "level", normalised(F.col("said")).alias("said"))
    lines = lines.filter("said <> ''")
    return lines.select("conv_id", "turn", "level", F.sha2("said", 256).alias("unit"), F.char_length("said").cast("long").alias("chars"))


def linked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, source (turn of the original message), chars: sums over the linked units."""
    # Messages that quote nothing matter only where their conversation has a quote.
    quotes, total = counted(_units(rows.withColumn("blocks", F.filter("blocks", lambda b: b["level"] > 0))).distinct(), "quoted-units")
    asked = quotes.groupBy("conv_id", "unit").agg(F.count(F.lit(1)).alias("asks"))
    said = _units(rows.withColumn("blocks", F.filter("blocks", lambda b: b["level"] == 0)))
    first = said.groupBy("conv_id", "unit").agg(F.min("turn").alias("source"))
    key = F.concat_ws(":", "conv_id", "unit")
    answers = written(first.join(asked, ["conv_id", "unit"]).select(key.alias("key"), "source", "asks"), "originals")
    found = join_answers(quotes.withColumn("key", key), answers, "key", "asks", total).filter("source < turn")
    return found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"))


def reply_links(rows: DataFrame) -> DataFrame:
    """One row per (conv_id, turn): reply_to, n_linked (messages linked), rows."""
    turns = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows"))
    turns = written(turns, "turns")
    best = F.max(F.struct((-F.col("level")).alias("low"), "chars", "source")).alias("best")
    links = linked(rows).groupBy("conv_id", "turn").agg(best, F.count_distinct("source").alias("n_linked"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    out = turns.join(links, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    return written(out.select("conv_id", "turn", "rows", F.coalesce("best.source", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "replies")


def threads(replies: DataFrame) -> DataFrame:
    """replies with root and depth, by jumps that double in every round; who has reached a root takes part no more."""
    start = F.col("reply_to").isNull()
    replies = written(replies, "links")
    state = replies.select(
        "conv_id", "turn", "rows", "reply_to", "n_linked",
        F.coalesce("reply_to", "turn").alias("root"), F.when(start, 0).otherwise(1).cast("long").alias("depth"), start.alias("ended"),
    )
    ended = [state.filter("ended")]
    state = state.filter("NOT ended")
    while True:
        state, moving = counted(state, "jumps")
        if not moving:
            return reduce(DataFrame.unionByName, ended)
        every = reduce(DataFrame.unionByName, [*ended, state])
        far = every.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("ended").alias("over"))
        step = state.join(far, ["conv_id", "root"]).select(
            "conv_id", "turn", "rows", "reply_to", "n_linked",
            F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("over").alias("ended"),
        )
        step = written(step, "jumped")
        ended.append(step.filter("ended"))
        state = step.filter("NOT ended")


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text, n_quotes, n_linked, reply_to, root, depth; reply order is (conv_id, root, turn)."""
    rows = parsed(messages)
    placed = threads(reply_links(rows))
    key = F.concat_ws(":", "conv_id", "turn")
    quotes = F.size(F.filter("blocks", lambda b: b["level"] > 0)).cast("long").alias("n_quotes")
    base = rows.select("conv_id", "turn", "role", "text", quotes)
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    answers = written(placed.select(key.alias("key"), "rows", F.col("n_linked").cast("long").alias("n_linked"), "reply_to", "root", "depth"), "placed")
    total = answers.agg(F.sum("rows")).first()[0] or 0
    found = join_answers(base.filter(known).withColumn("key", key), answers, "key", "rows", total)
    alone = base.filter(~known).select("*", F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("root"), F.lit(0).cast("long").alias("depth"))
    return alone.unionByName(found.select(*alone.columns))


# The same rows, for a check outside Spark; where no text quotes, every message replies to the turn before.
SQL = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r?\n'), 1) AS i FROM conversations),
m AS (SELECT *, length(mk) - length(replace(mk, '>', '')) AS level FROM (SELECT *, regexp_extract(line, '^(?:[ \t]{0,3}>)+', 0) AS mk FROM l)),
s AS (SELECT conv_id, turn, i, level, CASE WHEN level > 0 THEN trim(substr(line, length(mk) + 1)) ELSE line END AS said,
             coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS next FROM m),
t AS (SELECT * FROM s WHERE NOT (level = 0 AND next > 0 AND regexp_matches(said, '(?i)^.{1,200}(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$'))),
g AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS blk
      FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM t)),
b AS (SELECT conv_id, turn, level, blk, string_agg(said, chr(10) ORDER BY i) AS said FROM g GROUP BY ALL),
u AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(said), '[^\p{L}\p{N}]+', ' ', 'g')) AS unit
      FROM (SELECT conv_id, turn, level, said FROM b UNION ALL SELECT conv_id, turn, level, said FROM g)),
o AS (SELECT conv_id, unit, min(turn) AS source FROM u WHERE level = 0 AND unit <> '' GROUP BY ALL),
k AS (SELECT u.conv_id, u.turn, u.level, o.source, sum(length(u.unit)) AS chars FROM u JOIN o USING (conv_id, unit)
      WHERE u.level > 0 AND o.source < u.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, source FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, source DESC) = 1),
n AS (SELECT conv_id, turn, count(DISTINCT source) AS n_linked FROM k GROUP BY ALL),
r AS MATERIALIZED (
  SELECT c.conv_id, c.turn, coalesce(best.source, p.turn) AS reply_to FROM (SELECT DISTINCT conv_id, turn FROM conversations) c
  LEFT JOIN best USING (conv_id, turn) LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
w AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM r WHERE reply_to IS NULL
      UNION ALL SELECT r.conv_id, r.turn, w.root, w.depth + 1 FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.reply_to)
SELECT c.conv_id, c.turn, c.role,
       CASE WHEN coalesce(q.n, 0) > 0 THEN trim(coalesce(own.said, '')) ELSE coalesce(c.text, '') END AS text,
       coalesce(q.n, 0) AS n_quotes, coalesce(n.n_linked, 0) AS n_linked, r.reply_to, w.root, w.depth
FROM conversations c JOIN r USING (conv_id, turn) JOIN w USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM b WHERE level > 0 GROUP BY ALL) q USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn, string_agg(said, chr(10) ORDER BY blk) AS said FROM b WHERE level = 0 GROUP BY ALL) own USING (conv_id, turn)
"""
