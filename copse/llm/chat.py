"""Chat formatting of reply trees with DataFrame functions only.

A message names the message that it answers. Iterative self-joins find each message's ancestors 1, 2, 4, ... steps up and,
on the way, the sum of the scores from it to its root. So leaves are ranked by the scores of their branches before any path
is written out; the joins are then run back from the chosen leaves, which enumerates their root-to-leaf paths, and each path
becomes one formatted conversation. A thread of n replies takes about 2 log2(n) joins. Only keys and scores travel through
them; texts are joined to the chosen paths at the end.

Template: `<turn ROLE>TEXT</turn>` and a line feed for each turn, where & < > # inside roles and texts are written as
character references, so no text can end or open a turn and unescape() gives it back exactly. The loss mask holds the
spans (code points of the formatted text, end exclusive) of the escaped assistant texts.

Defined results: null texts and roles are empty; turns with equal order are taken by role, then text; of rows with one
message number the least (parent, role, text) counts; a message
whose parent is missing from its conversation is a root; messages on a cycle, which no root reaches, have no path;
rows without a conversation id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.llm.common import materialise, read

#: What a text's own characters are written as; & first, and last on the way back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("#", "&#35;"))
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def jumps(keyed: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors by powers of two, and depths and scores, of stored messages (conv_id, msg, parent, score).

    The k-th table (c, m, a) has the ancestor a of message m that is 2 ** k steps up. Each round joins the last table with
    itself, so a conversation of n messages takes log2(n) rounds; messages that have reached a root are done and leave the
    rounds. Depths and the scores of the whole way to the root (c, m, depth, s) leave out messages that no root reaches.
    """
    messages = keyed.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("parent").alias("p"), F.col("score").alias("s"))
    known = messages.select(F.col("c").alias("kc"), F.col("m").alias("km"))
    linked = messages.join(known, F.col("c").eqNullSafe(F.col("kc")) & (F.col("p") == F.col("km")), "left")
    state = materialise(linked.select("c", "m", F.col("km").alias("a"), F.when(F.col("km").isNull(), 0).otherwise(1).cast("long").alias("depth"), "s"), "chat-jumps")
    longest = keyed.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    finished, active, tables = state.filter("a IS NULL"), state.filter("a IS NOT NULL"), []
    for _ in range(int(longest).bit_length()):
        if active.isEmpty():
            break
        tables.append(active.select("c", "m", "a"))
        up = finished.unionByName(active).select(F.col("c").alias("uc"), F.col("m").alias("um"), F.col("a").alias("ua"), F.col("depth").alias("ud"), F.col("s").alias("us"))
        joined = active.join(up, F.col("c").eqNullSafe(F.col("uc")) & (F.col("a") == F.col("um")))
        state = materialise(joined.select("c", "m", F.col("ua").alias("a"), (F.col("depth") + F.col("ud")).alias("depth"), (F.col("s") + F.col("us")).alias("s")), "chat-jumps")
        finished, active = finished.unionByName(state.filter("a IS NULL")), state.filter("a IS NOT NULL")
    return tables, finished.select("c", "m", "depth", "s")


def paths(keyed: DataFrame, branches: int | None) -> DataFrame:
    """(conv_id, branch, score, at, msg): the messages of the best root-to-leaf paths (all of them if None) of each tree of
    stored messages (conv_id, msg, parent, score), at counted from the root.

    A leaf asks for its whole path of n messages; round by round, from the largest power of two down, a request for more
    than 2 ** k messages is split in two: the first 2 ** k, and the rest from the ancestor 2 ** k steps up. Nothing but
    message numbers is joined, and no more rows arise than the chosen paths have.
    """
    tables, depths = jumps(keyed)
    answered = keyed.filter("parent IS NOT NULL").select(F.col("conv_id").alias("ac"), F.col("parent").alias("ap")).distinct()
    leaves = depths.join(answered, F.col("c").eqNullSafe(F.col("ac")) & (F.col("m") == F.col("ap")), "left_anti")
    rank = Window.partitionBy("c").orderBy(F.desc("s"), F.desc("depth"), "m")
    chosen = leaves.withColumn("branch", F.row_number().over(rank).cast("long"))
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    wanted = chosen.select("c", "branch", "s", "m", F.col("depth").alias("at"), (F.col("depth") + 1).alias("n"))
    for k in reversed(range(len(tables))):
        wanted = materialise(wanted, "chat-wanted")
        up = tables[k].select(F.col("c").alias("uc"), F.col("m").alias("um"), F.col("a").alias("ua"))
        long = wanted.filter(F.col("n") > 1 << k)
        rest = long.join(up, F.col("c").eqNullSafe(F.col("uc")) & (F.col("m") == F.col("um"))).select("c", "branch", "s", F.col("ua").alias("m"), (F.col("at") - (1 << k)).alias("at"), (F.col("n") - (1 << k)).alias("n"))
        wanted = wanted.withColumn("n", F.least("n", F.lit(1 << k))).unionByName(rest)
    return wanted.select(F.col("c").alias("conv_id"), "branch", F.col("s").alias("score"), "at", F.col("m").alias("msg"))


def format_chats(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, branch, score, n_turns, formatted, loss): the best branches of each reply tree, all of them if None.

    messages: conv_id, msg (a number), parent (number or null), role, text, score. A path's score is the sum of its
    messages' scores, null counting as 0; equal ones go by length, then by leaf.
    """
    one = messages.groupBy("conv_id", "msg").agg(F.min(F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("x"))
    one = materialise(one.select("conv_id", "msg", "x.*"), "chat-messages")
    picked = materialise(paths(one.select("conv_id", "msg", "parent", "score"), branches), "chat-paths")
    texts = one.select(F.col("conv_id").alias("tc"), F.col("msg").alias("tm"), "role", F.coalesce("text", F.lit("")).alias("text"))
    joined = picked.join(texts, picked["conv_id"].eqNullSafe(texts["tc"]) & (picked["msg"] == texts["tm"]))
    role = F.coalesce("role", F.lit(""))
    head, body = F.concat(F.lit("<turn "), escape(role), F.lit(">")), escape(F.col("text"))
    piece = joined.select("conv_id", "branch", "score", "at", F.concat(head, body, F.lit("</turn>\n")).alias("shown"), F.length(head).alias("head"), F.length(body).alias("body"), (role == LEARNED).alias("learned"))
    before = Window.partitionBy("conv_id", "branch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("begin", F.coalesce(F.sum(F.length("shown")).over(before), F.lit(0)))
    parts = piece.groupBy("conv_id", "branch").agg(F.first("score").alias("score"), F.sort_array(F.collect_list(F.struct("at", "shown", "head", "body", "learned", "begin"))).alias("parts"))
    span = lambda x: F.struct((x["begin"] + x["head"]).alias("start"), (x["begin"] + x["head"] + x["body"]).alias("end"))
    loss = F.transform(F.filter("parts", lambda x: x["learned"]), span)
    return parts.select("conv_id", "branch", "score", F.size("parts").cast("long").alias("n_turns"), F.concat_ws("", F.transform("parts", lambda x: x["shown"])).alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.regexp_extract(x, "^<turn ([^>]*)>", 1)).alias("role"), unescape(F.regexp_replace(x, "^<turn [^>]*>", "")).alias("text"))
    return F.transform(pieces, turn)


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees without branches."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("msg"))
    return numbered.select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


PLANTED = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PLANTED).alias("text"))
    chats = format_chats(linear(rows.unionByName(planted)))
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.concat_ws("", F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))))
    read_back = chats.select("conv_id", "branch", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.concat_ws("", turns), 256).alias("turns_sha256"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read_back.select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = "{}"
for _plain, _written in ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_written}')"

ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE '{LEARNED}' END, '{PLANTED}' FROM (VALUES (0), (1)) v(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum(6 + length({_ESCAPED.format('role')}) + 1 + length({_ESCAPED.format('text')}) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
