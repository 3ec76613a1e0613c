"""Chat formatting of reply trees.

A message names its parent. Iterative self-joins double each message's reach towards its root: after k joins
a message knows its ancestor 2**k replies up, the summed score of the messages passed and their number, so a
tree of depth d takes log2(d) joins, whatever the number of its branches. A message that nobody replies to ends
a branch; branches are ranked by score, and the chosen ones are enumerated from leaf to root by the same tables
of ancestors, the widest step first. Texts are joined once, for the messages of the chosen paths, and each path
becomes one conversation text. Every round is written to the shared folder, so plans stay small and a lost
executor repeats one round. A path must fit a text value; a tree need not fit anything.

`from_turns` makes trees of a table of turns: messages of one turn are rival replies to the best message of the
latest earlier turn (the highest score, then the smallest message number). `with_rivals` gives a table whose
turns have one message each, as the test data has, rival replies: see there.

A message's score is given, or else the number of characters of an assistant's text and 0 for other
roles; a branch's score is the mean over its messages. Best is the highest score, then the longest path,
then the smallest message number of the leaf.

Defined results: messages with a null tree or message number are not read; a parent that is null or not
in the tree makes a root; messages in a cycle, and replies to them, are reached from no root and are left out;
of repeated message numbers in a tree the row with the smallest (parent, role, text, score) counts, nulls first;
null roles read 'unknown', null texts are empty, null scores 0; extra columns are not read; very long texts
are kept whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stored

BEST = 2


def default_score(role: Column, text: Column) -> Column:
    return F.when(role == "assistant", F.length(text)).otherwise(0).cast("double")


def _number(*columns: str) -> Column:
    """A message number from what a message says: 60 bits of a hash that SQL knows as well."""
    said = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def with_rivals(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a rival to each assistant's reply: what the assistant of the next conversation said at that turn, if it did."""
    own = turns.select("conv_id", "turn", "role", "text")
    said = own.filter("role = 'assistant'")
    here, there = said.select("conv_id", "turn", "role").distinct().alias("a"), said.alias("b")
    rivals = here.join(there, (F.col("b.conv_id") == F.col("a.conv_id") + 1) & (F.col("b.turn") == F.col("a.turn")))
    return own.unionByName(rivals.select("a.conv_id", "a.turn", "a.role", "b.text"))


def from_turns(turns: DataFrame) -> DataFrame:
    """(tree, msg, parent, role, text, score) of a table (conv_id, turn, role, text)."""
    score = default_score(F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    messages = turns.filter("conv_id is not null and turn is not null").select(F.col("conv_id").alias("tree"), "turn", "role", "text", _number("turn", "role", "text").alias("msg"), score.alias("score"))
    best = messages.groupBy("tree", "turn").agg(F.max(F.struct("score", (-F.col("msg")).alias("first"))).alias("best"))
    before = Window.partitionBy("tree").orderBy("turn")  # one row for each turn of a conversation
    parents = best.select("tree", "turn", (-F.lag("best.first").over(before)).alias("parent"))
    return messages.join(parents, ["tree", "turn"]).select("tree", "msg", "parent", "role", "text", "score")


def messages_of(rows: DataFrame) -> DataFrame:
    """One row for each message number of a tree, nulls filled."""
    w = Window.partitionBy("tree", "msg").orderBy(*(F.col(c).asc_nulls_first() for c in ("parent", "role", "text", "score")))
    clean = rows.filter("tree is not null and msg is not null").select("tree", "msg", "parent", "role", "text", "score").withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return clean.select("tree", "msg", "parent", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))


def ancestors(messages: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, msg, total, n) of each message that is reached from a root, and for k = 0, 1, ... the tables (tree, msg, up): 2**k replies up."""
    nodes = messages.select("tree", "msg", "parent", "score")
    ids = nodes.select("tree", F.col("msg").alias("parent"), F.col("msg").alias("up"))
    # left of a parent that is not there: null, a root
    reach = scratch.stored(nodes.join(ids, ["tree", "parent"], "left").select("tree", "msg", "up", F.col("score").alias("total"), F.expr("1L").alias("n")))
    everything = reach.count()
    steps: list[DataFrame] = []
    while not reach.filter("up is not null").isEmpty() and 1 << len(steps) <= everything:  # a longer way is a cycle
        steps.append(reach.filter("up is not null").select("tree", "msg", "up"))
        further = reach.select("tree", F.col("msg").alias("up"), F.col("up").alias("beyond"), F.col("total").alias("more"), F.col("n").alias("and"))
        joined = reach.join(further, ["tree", "up"], "left")
        reach = scratch.stored(joined.select("tree", "msg", F.col("beyond").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("and", F.lit(0))).alias("n")))
    return reach.filter("up is null").select("tree", "msg", "total", "n"), steps


def chosen_paths(messages: DataFrame, best: int, scratch: Scratch) -> DataFrame:
    """(tree, branch, score, n, at, msg): the messages, by place from the root, of the `best` branches of each tree, ranked from 1."""
    reached, steps = ancestors(messages, scratch)
    leaves = reached.join(steps[0].select("tree", F.col("up").alias("msg")).distinct(), ["tree", "msg"], "left_anti") if steps else reached
    w = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "msg")
    ranked = leaves.select("tree", "msg", "n", (F.col("total") / F.col("n")).alias("score")).withColumn("branch", F.row_number().over(w)).filter(F.col("branch") <= best)
    path = scratch.stored(ranked.select("tree", "branch", "score", "n", (F.col("n") - 1).alias("at"), "msg"))
    for k in range(len(steps) - 1, -1, -1):
        wide = 1 << k
        here = F.struct("at", "msg")
        there = F.struct((F.col("at") - wide).alias("at"), F.col("up").alias("msg"))
        if not path.filter(F.col("at") >= wide).isEmpty():
            both = path.join(steps[k], ["tree", "msg"], "left").select("tree", "branch", "score", "n", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("p"))
            path = scratch.stored(both.select("tree", "branch", "score", "n", "p.at", "p.msg"))
    return path


def format_trees(rows: DataFrame, best: int = BEST) -> DataFrame:
    """(conv_id, branch, n_messages, score, conversation): the `best` branches of each tree, ranked from 1."""
    with Scratch(rows.sparkSession) as scratch:
        messages = scratch.stored(messages_of(rows))  # read by column from here on: texts once, for the chosen paths
        steps = chosen_paths(messages, best, scratch)
        line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
        told = steps.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"]).groupBy("tree", "branch", "score", "n").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("said")))).alias("said"))
        return stored(told.select(F.col("tree").alias("conv_id"), "branch", F.col("n").cast("int").alias("n_messages"), F.round("score", 6).alias("score"), F.array_join("said.said", "\n").alias("conversation")))


def format_turns(turns: DataFrame, best: int = BEST) -> DataFrame:
    return format_trees(from_turns(turns), best)


FORMAT_SQL = f"""WITH RECURSIVE u AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT a.conv_id, a.turn, a.role, b.text FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE role = 'assistant') a
    JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn WHERE b.role = 'assistant'),
d AS (SELECT DISTINCT conv_id AS tree, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST('0x' || substr(md5(concat_ws(chr(31), CAST(turn AS VARCHAR), coalesce(role, chr(0)), coalesce(text, chr(0)))), 1, 15) AS BIGINT) AS msg,
    CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END::DOUBLE AS score
  FROM u WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT tree, turn, first(msg ORDER BY score DESC, msg) AS best FROM d GROUP BY tree, turn),
q AS (SELECT tree, turn, lag(best) OVER (PARTITION BY tree ORDER BY turn) AS parent FROM t),
m AS (SELECT d.*, q.parent FROM d JOIN q USING (tree, turn)),
p AS (SELECT tree, msg AS last, [msg] AS path, score AS total FROM m WHERE parent IS NULL
  UNION ALL SELECT p.tree, m.msg, list_append(p.path, m.msg), p.total + m.score FROM p JOIN m ON m.tree = p.tree AND m.parent = p.last),
r AS (SELECT p.tree, path, total / len(path) AS score, len(path) AS n,
    row_number() OVER (PARTITION BY p.tree ORDER BY total / len(path) DESC, len(path) DESC, last) AS branch
  FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree = p.tree AND m.parent = p.last)),
s AS (SELECT tree, branch, score, n, unnest(path) AS msg, unnest(range(len(path))) AS place FROM r WHERE branch <= {BEST})
SELECT tree AS conv_id, CAST(branch AS INTEGER) AS branch, CAST(n AS INTEGER) AS n_messages, round(s.score, 6) AS score,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY place) AS conversation
FROM s JOIN m USING (tree, msg) GROUP BY tree, branch, n, s.score"""
