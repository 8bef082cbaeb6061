"""Preference formatting: a pair's common turns are rendered once as the prompt, the rest as two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, small

#: How a turn is rendered: HEAD, its role, NECK, its text, TAIL.
HEAD, NECK, TAIL = "<|", "|>\n", "<|end|>\n"
#: Turns of this role bear loss: their text and TAIL, not their heading.
LEARNED = "assistant"


def pair_replies(turns: DataFrame) -> DataFrame:
    """Pairs of a plain table of conversations (conv_id, turn, role, text), one a conversation, with pair_id its conv_id.

    chosen is the conversation. rejected has the same turns before its last learned one, then the last learned text of the
    neighbour (2 k and 2 k + 1 are neighbours) in its place. A conversation without a learned turn is kept whole, with the
    neighbour's reply after it; a neighbour without one, or that isn't there, gives no reply. Of learned turns with the
    same number the greatest text is the last; turns without a number come first; rows with a null conv_id form no pair.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where(F.col("pair_id").isNotNull())
    learned = F.when(F.col("role") == LEARNED, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    ends = own.groupBy("pair_id").agg(F.max(learned).alias("reply"), F.max("turn").alias("end"))
    ends = ends.select("pair_id", F.col("reply.turn").alias("cut"), F.col("reply.text").alias("reply"), F.coalesce("end", F.lit(-1)).alias("end"))
    chosen = own.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    cut = small(ends.select("pair_id", "cut"))
    before = own.join(cut, "pair_id").where(F.col("cut").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("cut")))
    before = before.select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    theirs = ends.where(F.col("reply").isNotNull()).select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("reply").alias("text"))
    places = ends.select("pair_id", F.coalesce("cut", F.col("end") + 1).alias("turn"))
    reply = places.join(theirs, "pair_id").select("pair_id", F.lit("rejected").alias("side"), "turn", F.lit(LEARNED).alias("role"), "text")
    return chosen.unionByName(before).unionByName(reply)


def _heading(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(NECK))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_heading(t), t["text"], F.lit(TAIL))), "")


def _mask(turns: Column) -> Column:
    """start:end of what bears loss in the rendered turns, in code points, comma-joined."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_heading(t))
        end = start + F.length(t["text"]) + len(TAIL)
        out = F.when(t["role"] == LEARNED, F.array_append(a["out"], F.concat_ws(":", start.cast("string"), end.cast("string")))).otherwise(a["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.array_join(F.aggregate(turns, state, step, lambda a: a["out"]), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side chosen or rejected, turn, role, text) -> one row per pair_id.

    n_chosen, n_rejected: turns of each side; n_common: of the longest common prefix, equal in role and text; prompt: that
    prefix; chosen, rejected: the other turns; chosen_mask, rejected_mask: what of them bears loss.
    A missing side has no turns; of two equal sides both completions are empty. Rows equal in all five columns count
    once and are folded before they are gathered; turns are ordered by turn (null first), role and text. Null role or
    text counts as empty; rows with a null pair_id or side belong to no pair; no pairs give no row; other columns are
    ignored. A conversation is gathered as the one text that it becomes.
    """
    own = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).distinct()
    pairs = own.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "side"))).alias("all"))

    def side(name: str) -> Column:
        return F.transform(F.filter("all", lambda t: t["side"] == name), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    both = pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(0), least), lambda i: ~F.coalesce((F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"]), F.lit(False)))
    split = both.withColumn("n", F.element_at(differ, 1))  # least itself always differs: one side has ended there
    rest = split.select(
        "pair_id", F.size("c").cast("long").alias("n_chosen"), F.size("r").cast("long").alias("n_rejected"), F.col("n").cast("long").alias("n_common"),
        F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"),
    )
    return rest.select(
        "pair_id", "n_chosen", "n_rejected", "n_common", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


#: The same in SQL, over the pairs of pair_replies.
SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
replies AS (
  SELECT conv_id, turn, coalesce(text, '') AS text FROM turns WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) = 1),
ends AS (
  SELECT conv_id, coalesce(max(turn), -1) AS fin FROM turns GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM turns
  UNION ALL
  SELECT t.conv_id, 'rejected', t.turn, t.role, t.text FROM turns t LEFT JOIN replies l USING (conv_id) WHERE l.turn IS NULL OR t.turn IS NULL OR t.turn < l.turn
  UNION ALL
  SELECT e.conv_id, 'rejected', coalesce(l.turn, e.fin + 1), 'assistant', n.text FROM ends e LEFT JOIN replies l USING (conv_id) JOIN replies n ON n.conv_id = xor(e.conv_id, 1)),
own AS (
  SELECT DISTINCT pair_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM sides),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k,
         '<|' || role || '|>' || chr(10) AS heading
  FROM own),
drawn AS (
  SELECT *, heading || text || '<|end|>' || chr(10) AS body FROM placed),
sizes AS (
  SELECT pair_id, count(*) FILTER (WHERE side = 'chosen') AS n_chosen, count(*) FILTER (WHERE side = 'rejected') AS n_rejected FROM drawn GROUP BY pair_id),
same AS (
  SELECT c.pair_id, c.k FROM drawn c JOIN drawn r ON c.pair_id = r.pair_id AND c.k = r.k AND c.role = r.role AND c.text = r.text
  WHERE c.side = 'chosen' AND r.side = 'rejected'),
run AS (
  SELECT pair_id, k, row_number() OVER (PARTITION BY pair_id ORDER BY k) AS i FROM same),
common AS (
  SELECT pair_id, count(*) AS n FROM run WHERE k = i GROUP BY pair_id),
marked AS (
  SELECT d.*, coalesce(c.n, 0) AS n FROM drawn d LEFT JOIN common c USING (pair_id)),
rest AS (
  SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY k) AS stop FROM marked WHERE k > n),
texts AS (
  SELECT pair_id, side, string_agg(body, '' ORDER BY k) AS body,
         string_agg(CAST(CAST(stop - length(body) + length(heading) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE role = 'assistant') AS mask
  FROM rest GROUP BY pair_id, side),
prompts AS (
  SELECT pair_id, string_agg(body, '' ORDER BY k) AS prompt FROM marked WHERE side = 'chosen' AND k <= n GROUP BY pair_id)
SELECT s.pair_id, s.n_chosen, s.n_rejected, coalesce(m.n, 0) AS n_common, coalesce(p.prompt, '') AS prompt,
       coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM sizes s LEFT JOIN common m USING (pair_id) LEFT JOIN prompts p USING (pair_id)
LEFT JOIN texts c ON c.pair_id = s.pair_id AND c.side = 'chosen' LEFT JOIN texts r ON r.pair_id = s.pair_id AND r.side = 'rejected'
"""
