"""Chat formatting: the dialogue seen from each participant's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RENDER_TURNS = 256
SYSTEM = "system"
NO_TURN = -(2**63)


def escaped(text):
    """Text without a marker: `<|` becomes `<\\|`, and `<\\` becomes `<\\\\`, so that it can be undone."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_name(name):
    """A name on one line and without a marker: backslashes are doubled, line ends are `\\n` and `\\r`, `<|` is `<\\|`."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("<|", "<\\|")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def rotate_perspectives(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", part_turns: int | None = None) -> DataFrame:
    """One row per conversation and participant: the dialogue with that participant as assistant.

    Every other participant becomes a user named by their role; system messages stay system messages and
    `system` is no participant, so a conversation of system messages alone has no row. `text` is the rendering;
    `mask_runs` is its training mask as `flag:characters` runs in order (1 over the participant's own words and
    their end mark). n_messages counts the messages, n_trained the participant's own.

    Messages are ordered by turn (null first), speaker (null first), text; a message that stands several times is rendered as
    often, though equal ones are merged before they move. A null or empty role is the one participant without a name, whose
    speaker is null; null text is empty; a null conv_id is a conversation of its own. Markers in texts and names are
    escaped, and so are line ends in names, in ways that can be undone: different names stay different. An
    empty table gives no row. Other columns are not read.

    Dialogues are rendered in parts of RENDER_TURNS turn numbers, in as many tasks, and only the renderings of a row
    meet in one. A row is one cell, of 2 GB at most; for longer dialogues part_turns gives a row for each part of so
    many turn numbers instead (turns without a number are part NO_TURN, the first), with the column part.
    """
    name = F.when(F.col(role) != "", F.col(role))
    clean = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), name.alias("speaker"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    messages = clean.groupBy("conv_id", "turn", "speaker", "body").agg(F.count("*").cast("int").alias("copies"))
    size = part_turns or RENDER_TURNS

    def part():
        return F.coalesce(F.floor(F.col("turn") / size).cast("long"), F.lit(NO_TURN).cast("long"))

    parted = messages.withColumn("part", part())
    grouped = parted.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "body", "copies"))).alias("messages"))
    places = clean.filter(~F.col("speaker").eqNullSafe(F.lit(SYSTEM))).select(F.col("conv_id").alias("of"), F.col("speaker").alias("place")).distinct()
    parts = clean.select(F.col("conv_id").alias("in"), part().alias("at")).distinct()
    spread = parts.join(places, F.col("in").eqNullSafe(F.col("of"))).select("in", "at", "place")
    seen = grouped.join(spread, F.col("conv_id").eqNullSafe(F.col("in")) & (F.col("part") == F.col("at")))

    def own(m):
        return m["speaker"].eqNullSafe(F.col("place"))

    def head(m):
        who = F.when(own(m), F.lit("assistant")).when(m["speaker"] == SYSTEM, F.lit(SYSTEM)).when(m["speaker"].isNull(), F.lit("user"))
        return F.concat(F.lit("<|im_start|>"), who.otherwise(F.concat(F.lit("user name="), escaped_name(m["speaker"]))), F.lit("\n"))

    def written(m):
        return F.array_repeat(F.concat(head(m), m["body"], F.lit("<|im_end|>\n")), m["copies"])

    def runs(m):
        return F.array_repeat(F.concat(F.lit("0:"), F.length(head(m)).cast("string"), F.when(own(m), F.lit(",1:")).otherwise(F.lit(",0:")), (F.length(m["body"]) + 10).cast("string"), F.lit(",0:1")), m["copies"])

    def count(ms):
        return F.aggregate(ms, F.lit(0).cast("long"), lambda n, m: n + m["copies"])

    rendered = seen.select(
        "conv_id",
        F.col("place").alias("speaker"),
        "part",
        count(F.col("messages")).alias("n_messages"),
        count(F.filter("messages", own)).alias("n_trained"),
        F.array_join(F.flatten(F.transform("messages", written)), "").alias("text"),
        F.array_join(F.flatten(F.transform("messages", runs)), ",").alias("mask_runs"),
    )
    if part_turns:
        return rendered
    pieces = F.sort_array(F.collect_list(F.struct("part", "text", "mask_runs")))
    whole = rendered.groupBy("conv_id", "speaker").agg(F.sum("n_messages").alias("n_messages"), F.sum("n_trained").alias("n_trained"), pieces.alias("pieces"))
    return whole.select("conv_id", "speaker", "n_messages", "n_trained", F.array_join("pieces.text", "").alias("text"), F.array_join("pieces.mask_runs", ",").alias("mask_runs"))


def op1_perspective_rotation(spark, sf_dir) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = rf"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, nullif(role, '') AS speaker,
         replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|') AS body
  FROM conversations),
p AS (SELECT DISTINCT conv_id AS of_id, speaker AS place FROM c WHERE speaker IS DISTINCT FROM '{SYSTEM}'),
j AS (
  SELECT *, '<|im_start|>' || CASE WHEN speaker IS NOT DISTINCT FROM place THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker IS NULL THEN 'user'
           ELSE 'user name=' || replace(replace(replace(replace(speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|', '<\|') END || chr(10) AS head
  FROM c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.of_id)
SELECT conv_id, place AS speaker, count(*) AS n_messages, count(*) FILTER (WHERE speaker IS NOT DISTINCT FROM place) AS n_trained,
       string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body) AS text,
       string_agg('0:' || length(head) || CASE WHEN speaker IS NOT DISTINCT FROM place THEN ',1:' ELSE ',0:' END || (length(body) + 10) || ',0:1', ','
                  ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body) AS mask_runs
FROM j GROUP BY conv_id, place
"""
