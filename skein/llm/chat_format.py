"""Chat formatting over reply trees.

Messages (tree_id, msg_id, parent_id, role, text, score) form reply trees. Iterative self-joins double the reach of
every message's link upwards: after round j it names the ancestor 2^j above and holds the score and number of the
messages up to there. Once all links have passed their root, a leaf's sums are those of its root-to-leaf path, so
branches are ranked by the sum of their scores (ties: the greater number of messages, then the smaller leaf id)
before any path is listed. Then only the paths of the chosen leaves are enumerated, again by self-joins with the links
of each round; only ids are joined. Each chosen path is formatted as one conversation:

    <s>[TURN]role[TEXT]text[/TURN][TURN]...</s>

Control strings inside roles and texts are escaped by one backslash after their first character (and one more where
backslashes stand there already), so the output has no control string but the template's own and unescaping gives
the original back. ``loss_spans`` are the [start, end) code points of the assistant texts as escaped.

Null texts count as empty, null roles as '', null scores as 0. A message whose parent is missing, null or its own id is
a root. A cycle of parents has no root: it and all that hangs on it is left out, as no path of it ends after as many
rounds as the largest tree needs. Rows with null tree_id or msg_id are left out; of repeated msg_ids of a tree the
least (role, text) counts. Other columns aren't read. An empty table gives an empty result. A conversation is one value
of one row, so it has to fit in a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import cut, keep_keys, table

_CONTROL = r"(?=/?s>|/?TURN\]|TEXT\]|/?INST\]|</?SYS>>|\|im_start\||\|im_end\|)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)" + _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + _CONTROL, "$1")


def links(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The messages that reach a root (tree_id, msg_id, total, depth: sums over the path from the root), and of each
    round the links (tree_id, msg_id, above) that it starts from."""
    ids = messages.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("above"))
    own = messages.withColumn("asked", F.when(F.col("parent_id") != F.col("msg_id"), F.col("parent_id")))
    own = own.join(ids, (F.col("tree_id") == F.col("t")) & (F.col("asked") == F.col("above")), "left")
    own = own.select("tree_id", "msg_id", "above", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state, rounds, done = cut(own), [], []
    most = messages.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(rounds) <= most:
        # Trees whose links have all passed their root are done; of the others only the links that have not go on.
        going = state.where("above is not null")
        trees = cut(going.select("tree_id").distinct())
        done.append(keep_keys(state, trees, "tree_id", "left_anti"))
        if trees.isEmpty():
            break
        rounds.append(going.select("tree_id", "msg_id", "above"))
        state = cut(keep_keys(state, trees, "tree_id"))
        up = state.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), F.col("above").alias("further"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        higher = state.where("above is not null").join(up, (F.col("tree_id") == F.col("t")) & (F.col("above") == F.col("m")))
        higher = higher.select("tree_id", "msg_id", F.col("further").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        state = cut(state.where("above is null").unionByName(higher))
    else:
        done.append(state)
    reached = done[0]
    for part in done[1:]:
        reached = reached.unionByName(part)
    return reached.where("above is null").drop("above"), rounds


def ranked_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The paths of the best ``branches`` leaves of each tree: tree_id, leaf_id, branch (rank from 1), total, msg_id,
    up (distance from the leaf) for messages (tree_id, msg_id, parent_id, score)."""
    reached, rounds = links(messages)
    if rounds:
        reached = reached.join(rounds[0].select("tree_id", F.col("above").alias("msg_id")).distinct(), ["tree_id", "msg_id"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "msg_id")
    chosen = reached.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    paths = chosen.select("tree_id", F.col("msg_id").alias("leaf_id"), "branch", "total", "msg_id", F.lit(0).cast("long").alias("up"))
    for j, jump in enumerate(rounds):
        # So far the 2^j lowest messages of each path are listed; each names the one 2^j above it.
        higher = paths.join(jump, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", "branch", "total", F.col("above").alias("msg_id"), F.col("up") + (1 << j))
        paths = cut(paths.union(higher))
    return paths


def format_trees(messages: DataFrame, branches: int = 1, trained_role: str = "assistant") -> DataFrame:
    """tree_id, leaf_id, branch, branch_score, n_messages, formatted, loss_spans of each chosen path."""
    rows = messages.where("tree_id is not null and msg_id is not null")
    least = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    rows = cut(rows.groupBy("tree_id", "msg_id").agg(least.alias("m")).select("tree_id", "msg_id", "m.*"))
    paths = ranked_paths(rows.select("tree_id", "msg_id", "parent_id", "score"), branches)
    told = paths.join(rows.select("tree_id", "msg_id", "role", "text"), ["tree_id", "msg_id"])
    head = F.concat(F.lit("[TURN]"), escape(F.col("role")), F.lit("[TEXT]"))
    body = escape(F.col("text"))
    # Where a turn stands: the lengths of those before it, summed up once for each conversation.
    of_path = ["tree_id", "leaf_id", "branch"]
    above = Window.partitionBy(*of_path).orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(*of_path, "total", "up", head.alias("head"), body.alias("body"), (F.col("role") == trained_role).alias("trained"))
    size = F.length("head") + F.length("body") + 7
    start = (F.coalesce(F.sum(size).over(above), F.lit(0)) + 3 + F.length("head")).cast("int")
    turn = F.struct((-F.col("up")).alias("at"), "head", "body", "trained", "start", (F.col("start") + F.length("body")).alias("end"))
    whole = told.withColumn("start", start).groupBy(*of_path).agg(F.first("total").alias("branch_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("[/TURN]"))), ""), F.lit("</s>"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("tree_id", "leaf_id", "branch", "branch_score", F.size("turns").cast("long").alias("n_messages"), text.alias("formatted"), spans.alias("loss_spans"))


@F.pandas_udf(ArrayType(StringType()))
def under_mask(formatted: pd.Series, spans: pd.Series) -> pd.Series:
    """What stands in the spans of a formatted conversation (a slice of a Python string takes no search from its start)."""
    return pd.Series([[text[s["start"] : s["end"]] for s in mine] for text, mine in zip(formatted, spans)], dtype=object)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    inner = F.substr(formatted, F.lit(4))
    turns = F.split(inner, r"\[TURN\]")
    turns = F.slice(turns, F.lit(2), F.size(turns))

    def one(turn: Column) -> Column:
        role, text = F.split_part(turn, F.lit("[TEXT]"), F.lit(1)), F.split_part(turn, F.lit("[TEXT]"), F.lit(2))
        return F.struct(unescape(role).alias("role"), unescape(F.split_part(text, F.lit("[/TURN]"), F.lit(1))).alias("text"))

    return F.transform(turns, one)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("tree_id"), "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.sql(f"select -7L, 0L, 'user', '{said}' union all select -7L, 1L, 'assistant', '{said}'"))
    in_turn = Window.partitionBy("tree_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    nth = F.row_number().over(in_turn).cast("long")
    messages = rows.withColumn("msg_id", nth).select("tree_id", "msg_id", (F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
    done = format_trees(messages)
    turns = read_back(F.col("formatted"))
    lost = under_mask("formatted", "loss_spans")
    out = done.select("*", turns.alias("turns"), F.array_join(F.transform(lost, unescape), "").alias("loss"))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in DuckDB, for the whole table.
OP6_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(regexp_replace(role || chr(10) || text,
    '([<\[]\\*)(/?s>|/?TURN\]|TEXT\]|/?INST\]|</?SYS>>|\|im_start\||\|im_end\|)', '\1\\\2', 'g')) - 1 as chars from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(7 + sum(chars + 19) as bigint) as formatted_chars
from e group by conv_id
"""
