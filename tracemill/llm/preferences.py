"""Preference pairs of conversations as prompt and masked completions (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, table

#: How a turn is rendered: before its role, between role and text, after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
FIRST = -(1 << 63)
#: Most code points of a pair that is put into one row.
MOST_CHARS = 1 << 20


def _turns(side: DataFrame) -> DataFrame:
    """pair_id, place, role and text; a null turn comes before all others, a null role is unknown, a null text empty."""
    return side.where(F.col("pair_id").isNotNull()).select(
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("place"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _cells(turns: DataFrame) -> DataFrame:
    """What a side has at each place, in a bounded form: one row mostly, else their number, ends and hashed sum."""
    said = F.struct("role", "text")
    sums = F.sum(F.xxhash64("role", "text").cast("decimal(20,0)")), F.sum(F.xxhash64("text", "role", F.lit(1)).cast("decimal(20,0)"))
    return turns.groupBy("pair_id", "place").agg(F.struct(F.count(F.lit(1)), F.min(said), F.max(said), *sums).alias("cell"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def format_pairs(chosen: DataFrame, rejected: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Segments of preference pairs: pair_id, part, place, role, rendered, train_start, train_end.

    chosen and rejected hold conversations as rows (pair_id, turn, role, text).
    The longest prefix of turns that both have alike, role and text, is the part
    prompt, rendered once; the turns after it are the parts chosen and rejected.
    A pair's texts are its parts' rendered turns in order of place. Training sees
    the code points [train_start, train_end) of a rendered turn: text and end
    marker of a completion's assistant turns, nothing else.

    A row is a turn: no conversation is gathered into one row or task, so that
    one of any length is only more rows. Both sides meet turn by turn, and the
    first difference of a pair is an aggregate. Several rows of one turn are all
    kept, and are alike if they hold the same rows. Rows without a pair_id belong
    to no pair and are left out. A pair that one side lacks has no prompt. Equal
    conversations are all prompt. Empty tables give no rows; other columns are
    ignored.
    """
    left, right = _turns(chosen), _turns(rejected)
    both = _cells(left).alias("l").join(_cells(right).alias("r"), ["pair_id", "place"], "full")
    differ = both.where(~F.col("l.cell").eqNullSafe(F.col("r.cell"))).groupBy("pair_id").agg(F.min("place").alias("cut"))
    cuts = materialise(differ, "preference-cuts")
    parts = left.withColumn("part", F.lit("chosen")).unionByName(right.withColumn("part", F.lit("rejected"))).join(cuts, "pair_id", "left")
    before = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
    parts = parts.where(~before | (F.col("part") == "chosen")).withColumn("part", F.when(before, "prompt").otherwise(F.col("part")))
    head = F.lit(len(OPEN) + len(MIDDLE)) + F.char_length("role")
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    whole = head + F.char_length("text") + F.lit(len(CLOSE))
    return parts.select(
        "pair_id", "part", "place", "role", rendered(F.col("role"), F.col("text")).alias("rendered"),
        F.when(trained, head).otherwise(F.lit(0)).cast("long").alias("train_start"), F.when(trained, whole).otherwise(F.lit(0)).cast("long").alias("train_end"),
    )


def paired_rows(segments: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each pair of format_pairs(): the prompt, both completions, and the code points of each that are trained on.

    Columns: pair_id, prompt, chosen, rejected, chosen_train, rejected_train,
    whole. The texts are the rendered turns in order of place (then role and
    text), joined; a part without turns is empty. A pair whose parts have over
    most_chars code points together doesn't fit a row: whole is false, its texts
    are null, and its turns are in the segments alone. Sizes are summed up before
    any text is gathered. Repeated turns are all there.
    """
    sizes = segments.groupBy("pair_id").agg((F.sum(F.char_length("rendered")) <= most_chars).alias("whole"))
    fits = segments.join(materialise(sizes, "preference-sizes"), "pair_id")
    turn = F.struct("place", "role", "rendered", "train_start", "train_end")
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("whole") & (F.col("part") == part), turn)))
    parts = fits.groupBy("pair_id", "whole").agg(*(of(p).alias(p) for p in ("prompt", "chosen", "rejected")))
    text = lambda p: F.when(F.col("whole"), F.array_join(F.transform(p, lambda t: t["rendered"]), "")).alias(p)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))
    step = lambda a, t: F.struct((a["at"] + F.char_length(t["rendered"])).alias("at"), F.when(t["train_end"] > 0, F.concat(a["spans"], F.array(F.struct((a["at"] + t["train_start"]).alias("start"), (a["at"] + t["train_end"]).alias("end"))))).otherwise(a["spans"]).alias("spans"))
    spans = lambda p: F.when(F.col("whole"), F.aggregate(p, start, step)["spans"]).alias(f"{p}_train")
    return parts.select("pair_id", text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"), "whole")


def made_up_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, chosen, against the one that leaves it after 1 to 4 turns for its neighbour's (ids 2k and 2k + 1)."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    cut = 1 + F.pmod("pair_id", F.lit(4))
    at = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST))  # a null turn is the first
    start = turns.where(at < cut)
    other = turns.withColumn("pair_id", F.col("pair_id") + 1 - 2 * F.pmod("pair_id", F.lit(2))).where(at >= cut)
    known = turns.select("pair_id").distinct()
    return format_pairs(turns, start.unionByName(other.join(known, "pair_id", "left_semi")))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_up_pairs(spark, sf_dir)


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, a row for each."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return paired_rows(made_up_pairs(spark, sf_dir)).select("pair_id", "prompt", "chosen", "rejected", spans("chosen_train"), spans("rejected_train"), "whole")


SQL = """
WITH c AS (SELECT conv_id AS pair_id, turn AS place, role, text FROM conversations),
o AS (SELECT pair_id + 1 - 2 * (pair_id % 2) AS pair_id, place, role, text FROM c),
r AS (SELECT * FROM c WHERE place < 1 + pair_id % 4 UNION ALL SELECT * FROM o WHERE place >= 1 + pair_id % 4 AND pair_id IN (SELECT pair_id FROM c)),
d AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.place, r.place)) AS cut FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.place = r.place
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
p AS (SELECT c.*, CASE WHEN cut IS NULL OR place < cut THEN 'prompt' ELSE 'chosen' END AS part FROM c LEFT JOIN d USING (pair_id)
  UNION ALL SELECT r.*, 'rejected' FROM r JOIN d USING (pair_id) WHERE place >= cut)
SELECT pair_id, part, place, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 13 + length(role) ELSE 0 END AS train_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 24 + length(role) + length(text) ELSE 0 END AS train_end
FROM p
"""
#: Turns are put one after the other; a turn's spans move by what stands before it.
PAIRS_SQL = f"""
WITH s AS ({SQL}), t AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY place, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT pair_id, coalesce(string_agg(rendered, '' ORDER BY place, role, rendered) FILTER (part = 'prompt'), '') AS prompt, coalesce(string_agg(rendered, '' ORDER BY place, role, rendered) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(rendered, '' ORDER BY place, role, rendered) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(before + train_start AS BIGINT) || '-' || CAST(before + train_end AS BIGINT), ',' ORDER BY before) FILTER (part = 'chosen' AND train_end > 0), '') AS chosen_train,
  coalesce(string_agg(CAST(before + train_start AS BIGINT) || '-' || CAST(before + train_end AS BIGINT), ',' ORDER BY before) FILTER (part = 'rejected' AND train_end > 0), '') AS rejected_train, sum(length(rendered)) <= {MOST_CHARS} AS whole
FROM t GROUP BY 1
"""
