"""Preference formatting of conversations, with DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same number, role and
text) is rendered once, as the prompt; the turns after it are the two completions, each with a mask of the
places (code points, from the completion's start, end excluded) that the assistant wrote.

One aggregation brings the turns of a pair together; everything else is done within the row, which is as
large as the two conversations.

Defined cases: rows without conversation or turn number are dropped; null roles and texts are empty; of rows that
repeat a turn the least (role, text) counts; a conversation without counterpart is completed against
nothing; equal conversations give a prompt and two empty completions; turns after the last assistant turn are left
out by ``against_next``; very long texts are rendered whole, within the memory of one pair's row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered, and whose words are learned.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def _piece(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))


def _mask(turns: Column) -> Column:
    """Places of the assistant's words as 'start-end' joined by commas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        end = begin + F.length(t["text"])
        comma = F.when(acc["out"] == "", F.lit("")).otherwise(F.lit(","))
        span = F.concat(acc["out"], comma, begin.cast("string"), F.lit("-"), end.cast("string"))
        out = F.when(t["role"] == LEARNED, span).otherwise(acc["out"])
        return F.struct((end + len(CLOSE)).alias("at"), out.alias("out"))

    return F.aggregate(turns, start, step)["out"]


def _part(name: str) -> Callable[[Column], Column]:
    return lambda t: t[name]


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of turns (pair_id, turn, role, text) as pair_id, prompt_turns, prompt, and chosen and rejected with masks."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = [d.where("pair_id is not null and turn is not null").select("pair_id", "turn", said.alias("said"), F.lit(s).alias("side")) for d, s in ((chosen, "c"), (rejected, "r"))]
    turns = rows[0].unionByName(rows[1]).groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == "c", F.col("said"))).alias("c"), F.min(F.when(F.col("side") == "r", F.col("said"))).alias("r")
    )
    pairs = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "c", "r"))).alias("turns"))
    differ = F.array_position(F.transform("turns", lambda t: ~t["c"].eqNullSafe(t["r"])), F.lit(True))
    pairs = pairs.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("turns")).cast("int"))
    tail = F.slice("turns", F.col("n") + 1, F.size("turns"))
    for side in ("c", "r"):
        pairs = pairs.withColumn(side, F.filter(F.transform(tail, _part(side)), lambda t: t.isNotNull()))
    text = lambda a: F.array_join(F.transform(a, _piece), "")
    return pairs.select(
        "pair_id",
        F.col("n").cast("long").alias("prompt_turns"),
        text(F.transform(F.slice("turns", F.lit(1), F.col("n")), lambda t: t["c"])).alias("prompt"),
        text(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        text(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def against_next(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation up to its last answer, and the same with the last answer of the next conversation in its place."""
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = rows.where(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max(F.struct(F.col("turn").alias("last"), F.coalesce("text", F.lit("")).alias("answer"))).alias("a"))
    answers = answers.select("pair_id", "a.last", "a.answer")
    after = answers.select((F.col("pair_id") - 1).alias("pair_id"), F.col("answer").alias("other"))
    upto = rows.join(answers.select("pair_id", "last"), "pair_id", "left")
    chosen = upto.where(F.col("last").isNull() | (F.col("turn") <= F.col("last"))).drop("last")
    kept = upto.where(F.col("last").isNull() | (F.col("turn") < F.col("last"))).drop("last")
    swapped = answers.join(after, "pair_id", "left").select("pair_id", F.col("last").alias("turn"), F.lit(LEARNED).alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    return chosen, kept.unionByName(swapped)


def preference(conversations: DataFrame) -> DataFrame:
    """Every conversation as a preference pair against the next one's answer."""
    return format_pairs(*against_next(conversations))


ORACLE = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT pair_id, max(turn) AS last, arg_max(text, (turn, text)) AS answer FROM t WHERE role = 'assistant' GROUP BY pair_id),
x AS (SELECT t.*, a.last FROM t LEFT JOIN a USING (pair_id)),
c AS (SELECT pair_id, turn, arg_min(role, (role, text)) AS role, arg_min(text, (role, text)) AS text FROM x WHERE last IS NULL OR turn <= last GROUP BY ALL),
r0 AS (SELECT pair_id, turn, role, text FROM x WHERE last IS NULL OR turn < last
       UNION ALL SELECT a.pair_id, a.last, 'assistant', coalesce(b.answer, '') FROM a LEFT JOIN a b ON b.pair_id = a.pair_id + 1),
r AS (SELECT pair_id, turn, arg_min(role, (role, text)) AS role, arg_min(text, (role, text)) AS text FROM r0 GROUP BY ALL),
j AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt
      FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn),
d AS (SELECT *, sum(CASE WHEN cr IS NOT DISTINCT FROM rr AND ct IS NOT DISTINCT FROM rt THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY turn) AS differ FROM j),
s AS (SELECT pair_id, turn, CASE WHEN differ = 0 THEN 'p' ELSE 'c' END AS seg, cr AS role, ct AS text FROM d WHERE cr IS NOT NULL
      UNION ALL SELECT pair_id, turn, 'r', rr, rt FROM d WHERE differ > 0 AND rr IS NOT NULL),
q AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM s),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS b FROM q)
SELECT pair_id, count(*) FILTER (WHERE seg = 'p') AS prompt_turns,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE seg = 'p'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE seg = 'c'), '') AS chosen,
  coalesce(string_agg(CAST(b AS BIGINT) || '-' || CAST(b + length(text) AS BIGINT), ',' ORDER BY turn) FILTER (WHERE seg = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE seg = 'r'), '') AS rejected,
  coalesce(string_agg(CAST(b AS BIGINT) || '-' || CAST(b + length(text) AS BIGINT), ',' ORDER BY turn) FILTER (WHERE seg = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
