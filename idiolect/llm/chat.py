"""Multi-party perspective rotation of dialogues, in SQL functions.

For every participant of a dialogue (each distinct role but those in `system`), the whole dialogue is rendered
with that speaker as the assistant and everyone else as a named user; system turns stay system turns. The mask
is the list of code-point spans start:end that the speaker's own turns have, closing mark included, markup
before them not included: what a loss is taken on.

A dialogue can be of any length, so a rendering comes in parts of the turns with the same floor(turn / PART);
parts joined by (part, piece) give the whole. Spans count from the start of their piece. Turns are shuffled once,
in groups of one part of one dialogue, and participants in groups of one role of one dialogue. A part of over
CROWD turns (many turns of one number, null numbers, null conv_ids) is dealt into pieces: by turn, by a hash of
role and text where one turn number has too many, and by count where one turn is repeated too often. Elsewhere
piece is 0.

No text or role can forge a mark or a header: in a text, "<" loses all bars that follow it at once; in a name,
backslashes are doubled, line breaks become \\n and "<|" becomes "<\\|", so names that differ in
more than the kind of a line break stay different.

Defined cases: a null text is an empty turn; a null role is the participant "unknown"; turns are ordered by
turn, then role, then text (in a crowded part by turn, then piece), so ties and repeated rows have one result; a
null turn comes first, in part -1; a null conv_id is a dialogue of its own. A dialogue of system turns alone has
no participant and gives no rows; an empty table gives none. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that a part spans, and turns of a part beyond which it is dealt into pieces.
PART, CROWD = 256, 4_096
SYSTEM = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def clean(text: Column) -> Column:
    """text without "<|"; what is left can't become one."""
    return F.regexp_replace(text, r"<\|+", "<")


def name(role: Column) -> Column:
    """role on one line, without "<|", different for different roles."""
    x = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    x = F.regexp_replace(F.regexp_replace(x, r"\r", r"\\r"), r"[\n\x0B\x0C\x{85}\x{2028}\x{2029}]", r"\\n")
    return F.replace(x, F.lit("<|"), F.lit("<\\|"))


def grouped(rows: DataFrame, crowd: int) -> DataFrame:
    """(conv, part, piece, turns): the turns of each part in order; crowded parts in several pieces."""
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns")
    crowded = rows.groupBy("conv", "part", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv", "part").agg(F.sum("n").alias("n")).where(F.col("n") > crowd)
    big = crowded.select(F.col("conv").alias("c"), F.col("part").alias("p"))
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    plain = rows.join(big, here, "left_anti").groupBy("conv", "part").agg(turns).select("conv", "part", F.lit("0").alias("piece"), "turns")
    counted = rows.join(big, here, "left_semi").groupBy("conv", "part", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    shares = counted.groupBy("conv", "part", "turn").agg(F.ceil(F.count(F.lit(1)) / crowd).alias("k")).select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("turn").alias("t"), "k")
    one_turn = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & F.col("turn").eqNullSafe(F.col("t"))
    dealt = counted.join(shares, one_turn).withColumn("bucket", F.pmod(F.xxhash64("role", "text"), F.col("k")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / crowd))).alias("block")
    copies = dealt.select("conv", "part", "turn", "role", "text", "n", "bucket", blocks).withColumn("m", F.least(F.lit(crowd).cast("long"), F.col("n") - F.col("block") * crowd).cast("int"))
    each = copies.select("conv", "part", "turn", "role", "text", "bucket", "block", F.explode(F.sequence(F.lit(1), F.col("m"))))
    number = lambda c, width: F.lpad(F.col(c).cast("string"), width, "0")
    piece = F.concat_ws("-", F.lpad(F.coalesce(F.col("turn") - F.col("part") * PART, F.lit(0)).cast("string"), 4, "0"), number("bucket", 10), number("block", 10))
    return plain.unionByName(each.withColumn("piece", piece).groupBy("conv", "part", "piece").agg(turns))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: tuple[str, ...] = SYSTEM, part: int = PART, crowd: int = CROWD) -> DataFrame:
    """(conv_id, perspective, part, piece, n_turns, n_trained, rendered, mask)."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        name(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("role"),
        clean(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / part), F.lit(-1)).cast("long").alias("part"),
    )
    speakers = rows.where(~F.col("role").isin(*system)).select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct()
    both = grouped(rows, crowd).join(speakers, F.col("conv").eqNullSafe(F.col("c")))

    def head(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        named = F.when(own, F.lit("assistant")).when(t["role"].isin(*system), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), named, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    rendered = both.select(F.col("conv").alias(conv_col), "perspective", "part", "piece", pieces.alias("pieces"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("mask"))
    mask = F.aggregate("pieces", start, step, lambda acc: acc["mask"])
    return rendered.select(
        conv_col,
        "perspective",
        "part",
        "piece",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(mask, ",").alias("mask"),
    )


#: DuckDB SQL for rotate() over conversations without crowded parts: a text is split at "<" and each part's bars are
#: trimmed, a name is escaped character by character.
ORACLE = rf"""
with s as (
  select conv_id, turn, coalesce(role, 'unknown') as raw, string_split(coalesce(text, ''), '<') as cuts, coalesce(floor(turn / {PART})::bigint, -1) as part
  from conversations),
t as (
  select conv_id, turn, part, array_to_string(list_prepend(cuts[1], list_transform(cuts[2:], lambda x: ltrim(x, '|'))), '<') as text,
         replace(array_to_string(list_transform(string_split(raw, ''), lambda x: case when x = chr(92) then chr(92) || chr(92) when x = chr(13) then chr(92) || 'r'
           when x in (chr(10), chr(11), chr(12), chr(133), chr(8232), chr(8233)) then chr(92) || 'n' else x end), ''), '<|', '<' || chr(92) || '|') as role
  from s),
p as (select distinct conv_id, role as perspective from t where role not in ('system')),
m as (
  select t.conv_id, p.perspective, t.part, t.turn, t.role, t.text, t.role = p.perspective as own,
         '{OPEN}' || case when t.role = p.perspective then 'assistant' when t.role = 'system' then 'system' else 'user name=' || t.role end || chr(10) as head,
         t.text || '<|im_end|>' || chr(10) as body
  from t join p on t.conv_id is not distinct from p.conv_id),
o as (
  select *, row_number() over w as k, coalesce(sum(length(head) + length(body)) over (w rows between unbounded preceding and 1 preceding), 0) as before
  from m window w as (partition by conv_id, perspective, part order by turn nulls first, role, text))
select conv_id, perspective, part, '0' as piece, count(*) as n_turns, count(*) filter (where own) as n_trained,
       string_agg(head || body, '' order by k) as rendered,
       coalesce(string_agg((before + length(head))::bigint || ':' || (before + length(head) + length(body))::bigint, ',' order by k) filter (where own), '') as mask
from o group by conv_id, perspective, part
"""
