"""Reply trees as training conversations.

Messages with parents form trees. Self-joins by pointer doubling give each message its depth and the score sum of its path
from the root in as many rounds as the logarithm of the deepest path, over narrow rows; leaves are ranked within their tree by
mean score; only the chosen paths are then enumerated, again by doubling, and joined with their texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.tables import materialize, release

BEST = 3


def reply_parents(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text) from rows (conv_id, turn, role, text).

    Turns in a row of one role are alternative messages: siblings. Their parent is the last message before them, whose role
    differs. Rows without conv_id or turn are dropped; a null role is "unknown", a null text empty; rows that repeat in full
    count once; messages of equal turn go by role, then text. node numbers the messages of a conversation from 1.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null").distinct()
    # a conversation may hold a large share of all rows: it is cut into the ranges of one global order, and what a range takes
    # over from those before it comes from a row for each range
    order = ("conv_id", "turn", "role", "text")
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    slim = ranged.select("conv_id", "at", "role", F.shiftright("at", 33).alias("part"))
    w, before = Window.partitionBy("conv_id", "part").orderBy("at"), Window.partitionBy("conv_id").orderBy("part")
    parts = slim.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("role", "at").alias("last"))
    parts = parts.select("conv_id", "part", (F.sum("n").over(before) - F.col("n")).alias("base"), F.lag("last").over(before).alias("previous"))
    local = slim.withColumn("k", F.row_number().over(w)).withColumn("lag", F.lag("role").over(w)).join(parts, ["conv_id", "part"])
    node = (F.col("base") + F.col("k")).cast("long")
    changed = F.coalesce(F.coalesce("lag", "previous") != F.col("role"), F.lit(True))
    numbered = materialize(local.select("conv_id", "part", "at", node.alias("node"), F.when(changed, node).alias("start")))
    carried = numbered.groupBy("conv_id", "part").agg(F.max("start").alias("top"))
    carried = carried.select("conv_id", "part", F.max("top").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    run = F.coalesce(F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0)), "carry")
    placed = numbered.join(carried, ["conv_id", "part"]).select("at", "node", run.alias("run"))
    return ranged.join(placed, "at").select(F.col("conv_id").alias("tree"), "node", F.when(F.col("run") > 1, F.col("run") - 1).alias("parent"), "role", "text")


def answer_length() -> Column:
    """The default score of a message: the characters of an assistant's text, 0 for others."""
    return F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("long")


def format_reply_trees(messages: DataFrame, score: Column | None = None, best: int = BEST) -> DataFrame:
    """(tree, branch, leaf, n_messages, mean_score, conversation): the ``best`` root-to-leaf paths of each tree.

    messages: (tree, node, parent, role, text). Rows without tree or node are dropped; of rows of one node the least stands, by
    parent (null first), role and text, so repeated rows count once; a null role is "unknown", a null text empty. score: a long
    column over role and text, a null score 0. Branches rank by mean score, then by the leaf's number, from 1. conversation is ``<|role|>``, a line break, the text and a line
    break for each message from the root on. A message whose parent isn't there starts a path itself. Messages on or below a
    cycle of parents are left out. Extra columns play no part. No messages give no rows.
    """
    rows = messages.select("tree", "node", F.struct("parent", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    one = rows.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*")
    base = materialize(one.withColumn("score", F.coalesce((score if score is not None else answer_length()).cast("long"), F.lit(0))))
    keys = base.select("tree", F.col("node").alias("up"))
    links = base.select("tree", "node", F.col("parent").alias("up"), "score").join(keys, ["tree", "up"], "left_semi")
    roots = base.join(links.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", F.lit(None).cast("long").alias("up"), "score")
    # (node, up, depth, total): total over the ``depth`` messages from node to just below up
    jumps = [materialize(links.select("tree", "node", "up", F.lit(1).alias("depth"), F.col("score").alias("total")).union(roots.select("tree", "node", "up", F.lit(1), "score")))]
    open_ = jumps[-1].where("up is not null").count()
    while open_:
        now = jumps[-1]
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        done = now.where("up is null")
        more = now.where("up is not null").join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        jumps.append(materialize(done.union(more)))
        left = jumps[-1].where("up is not null").count()
        if left == open_:
            break  # a round of doubling ends some path unless only cycles remain
        open_ = left
    leaves = jumps[-1].where("up is null").join(links.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    mean = F.col("total") / F.col("depth")
    ranked = leaves.withColumn("mean_score", mean).withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean_score"), "node")))
    chosen = materialize(ranked.where(F.col("branch") <= best).select("tree", "branch", F.col("node").alias("leaf"), "depth", "mean_score"))
    # members of the chosen paths: from the leaf, jumps of 2**(rounds-1) ... 1 messages reach every ancestor once. A round
    # reads the members before it once, so the plan grows with the number of rounds and no faster
    members = chosen.select("tree", "branch", F.col("leaf").alias("node"), F.lit(0).alias("back"))
    for k in range(len(jumps) - 2, -1, -1):
        jump = jumps[k].where("up is not null").select("tree", "node", "up")
        both = F.array(F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")))
        members = members.join(jump, ["tree", "node"], "left").select("tree", "branch", F.inline(both)).where("node is not null")
    texts = members.join(base.select("tree", "node", "role", "text"), ["tree", "node"])
    lines = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text")))
    joined = texts.groupBy("tree", "branch").agg(lines.alias("m"))
    conversation = F.concat_ws("", F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))))
    out = chosen.join(joined, ["tree", "branch"]).select("tree", "branch", "leaf", F.col("depth").cast("long").alias("n_messages"), "mean_score", conversation.alias("conversation"))
    out = materialize(out)
    release(base, chosen, *jumps)
    return out


SQL = """
WITH RECURSIVE rows_ AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER w AS node, lag(role) OVER w AS before FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), runs AS (
  SELECT *, max(CASE WHEN before IS NULL OR before <> role THEN node END) OVER (PARTITION BY conv_id ORDER BY node) AS run FROM numbered
), nodes AS (
  SELECT conv_id AS tree, node, CASE WHEN run > 1 THEN run - 1 END AS parent, role, text,
         CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS score FROM runs
), paths AS (
  SELECT tree, node, 1 AS n, score AS total, '<|' || role || '|>' || chr(10) || text || chr(10) AS conversation FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT c.tree, c.node, p.n + 1, p.total + c.score, p.conversation || '<|' || c.role || '|>' || chr(10) || c.text || chr(10)
  FROM paths p JOIN nodes c ON c.tree = p.tree AND c.parent = p.node
), ranked AS (
  SELECT *, CAST(total AS DOUBLE) / n AS mean_score, row_number() OVER (PARTITION BY tree ORDER BY CAST(total AS DOUBLE) / n DESC, node) AS branch
  FROM paths p WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree = p.tree AND c.parent = p.node)
)
SELECT tree, branch, node AS leaf, CAST(n AS BIGINT) AS n_messages, mean_score, conversation FROM ranked WHERE branch <= 3
"""
