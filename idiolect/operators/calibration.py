"""What to ask a writer next: questions by what they would settle, and word choices by what is only guessed.

Banks are small tables (17 questions, 19 pairs) that do not grow with the data; writers do. Everything is a join of
writers with a bank and a rank within the writer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions.numbers import rounded
from idiolect.operators import scoring
from idiolect.operators.keys import joined

DECAY, ROUND, ASKED, NEITHER = 0.6, 3, 1.0, "neither"


@dataclass(frozen=True)
class Question:
    id: str
    targets: tuple[str, ...]
    text: str


#: Ids and targets are fixed values; the wording is ours and may be replaced.
ONBOARDING = (
    Question("onboarding_work", ("technicality", "formality", "conciseness"), "Explain your job to a stranger."),
    Question("onboarding_interest", ("warmth", "humour", "conversationality"), "What could you talk about for hours, and why?"),
    Question("onboarding_disagreement", ("directness", "hedging", "formality"), "A colleague proposes a plan that you think will fail. Answer them."),
    Question("onboarding_annoyance", ("humour", "conversationality", "warmth"), "What got on your nerves lately?"),
    Question("onboarding_explanation", ("technicality", "conciseness", "directness"), "Teach a clever friend something that you are good at."),
)
CALIBRATION = (
    Question("calib_bad_news", ("directness", "hedging", "formality"), "Tell a customer that their delivery will be a fortnight late."),
    Question("calib_thanks", ("warmth", "conversationality", "humour"), "Thank a teammate who cleaned up after somebody else."),
    Question("calib_handover", ("conciseness", "technicality", "directness"), "Leave notes for the person who stands in for you next week."),
    Question("calib_recommendation", ("conversationality", "warmth", "humour"), "Talk a friend into something that you love."),
    Question("calib_pushback", ("hedging", "directness", "formality"), "Your boss wants it far too soon. Reply."),
    Question("calib_meeting_summary", ("conciseness", "formality", "technicality"), "Sum up a recent meeting for somebody who was away."),
    Question("calib_complaint", ("directness", "formality", "warmth"), "You paid for something and it does not work. Write to the seller."),
    Question("calib_rough_week", ("warmth", "conversationality", "hedging"), "A friend has had an awful week. Answer them."),
    Question("calib_went_wrong", ("humour", "conversationality", "warmth"), "Tell how something failed and how it ended."),
    Question("calib_teach", ("technicality", "warmth", "conciseness"), "A beginner in your field asks how a part of it works."),
    Question("calib_estimate", ("hedging", "conversationality", "directness"), "How long will it take? You cannot know yet. Answer."),
    Question("calib_introduction", ("formality", "warmth", "humour"), "Say hello to a group that you have just joined."),
    Question("calib_decision_note", ("formality", "conciseness", "hedging"), "Explain a decision to people who had no part in it."),
    Question("calib_no_time", ("conversationality", "conciseness", "directness"), "Somebody needs you today and you have no time. Reply."),
    Question("calib_unpopular_view", ("directness", "technicality", "hedging"), "Argue against something that your field takes for granted."),
    Question("calib_jargon", ("technicality", "humour", "directness"), "Explain a term of your trade and judge whether it deserves to live."),
    Question("calib_bad_writing", ("humour", "warmth", "conversationality"), "Describe the worst memo that you had to read."),
)
PAIRS = tuple((f"choice_{c.replace(' ', '_').replace('-', '_')}", c, lex.FORMAL_TO_PLAIN[c]) for c in lex.AVOID_CANDIDATES if c in lex.FORMAL_TO_PLAIN)


def check() -> None:
    every = ONBOARDING + CALIBRATION
    if len({q.id for q in every}) != len(every) or any(set(q.targets) - set(scoring.NAMES) or len(set(q.targets)) != len(q.targets) for q in every):
        raise ValueError("the question bank has repeated ids or unknown targets")
    if not PAIRS or len({p[0] for p in PAIRS}) != len(PAIRS) or any(f == p for _, f, p in PAIRS):
        raise ValueError("the pair bank is not well formed")


check()


def question_bank(spark: SparkSession, bank: tuple[Question, ...] = CALIBRATION) -> DataFrame:
    """(question_id, text, position, target)."""
    rows = [(q.id, q.text, i, t) for q in bank for i, t in enumerate(q.targets)]
    return spark.createDataFrame(rows, "question_id string, text string, position int, target string")


def pair_bank(spark: SparkSession) -> DataFrame:
    """(pair_id, place, formal, plain)."""
    return spark.createDataFrame([(i, k, f, p) for k, (i, f, p) in enumerate(PAIRS)], "pair_id string, place int, formal string, plain string")


def dimension_table(spark: SparkSession) -> DataFrame:
    rows = [(i, d.name, d.ceiling, d.importance) for i, d in enumerate(scoring.DIMENSIONS)]
    return spark.createDataFrame(rows, "place int, dimension string, ceiling double, importance double")


def uncertainty(styles: DataFrame, writers: DataFrame) -> DataFrame:
    """(writer, dimension, uncertainty, importance): how far each confidence is below its ceiling; 1.0 where nothing is
    known. styles: writer, dimension, confidence. writers: writer."""
    spark = writers.sparkSession
    every = writers.select("writer").distinct().join(F.broadcast(dimension_table(spark)))  # eight rows a writer
    known = every.join(styles.select("writer", "dimension", "confidence"), ["writer", "dimension"], "left")
    gap = (F.col("ceiling") - F.coalesce("confidence", F.lit(0.0))) / F.col("ceiling")
    return known.select("writer", "place", "dimension", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gap)), 4).alias("uncertainty"), "importance")


def saturation(asked: DataFrame, bank: DataFrame) -> DataFrame:
    """(writer, dimension, saturation). asked: writer, question_id; unknown questions count for nothing."""
    hits = asked.join(F.broadcast(bank.select("question_id", "position", "target")), "question_id")
    counted = hits.groupBy("writer", "target", "position").agg(F.count(F.lit(1)).alias("n"))
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("position", "n"))))
    total = F.lit(0.0)
    for p in range(4):  # in one order of addition, whatever order rows come in
        total = total + F.coalesce(F.try_element_at(each, F.lit(p)), F.lit(0)) * (ASKED * DECAY**p)
    return counted.groupBy("writer", "target").agg(total.alias("saturation")).withColumnRenamed("target", "dimension")


def worth(styles: DataFrame, asked: DataFrame, writers: DataFrame) -> DataFrame:
    """(writer, dimension, uncertainty, importance, saturation, priority)."""
    spark = writers.sparkSession
    full = question_bank(spark, ONBOARDING + CALIBRATION)
    both = uncertainty(styles, writers).join(saturation(asked, full), ["writer", "dimension"], "left").withColumn("saturation", F.coalesce("saturation", F.lit(0.0)))
    return both.withColumn("priority", rounded(F.col("uncertainty") * F.col("importance") / (1.0 + F.col("saturation")), 6))


def weakest(styles: DataFrame, asked: DataFrame, writers: DataFrame, limit: int = 3) -> DataFrame:
    """The dimensions most worth asking about, best first."""
    w = Window.partitionBy("writer").orderBy(F.desc("priority"), "dimension")
    return worth(styles, asked, writers).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def per_target(unc: Column, importance: Column, sat: Column, position: Column) -> Column:
    decay = F.element_at(F.array(*(F.lit(DECAY**p) for p in range(4))), position + 1)
    return rounded(unc * importance * decay / (1.0 + sat), 6)


def rank_questions(styles: DataFrame, asked: DataFrame, writers: DataFrame, bank: tuple[Question, ...] = CALIBRATION) -> DataFrame:
    """(writer, question_id, priority, reason, rank) of the questions a writer was not asked, best first, ties by id."""
    spark = writers.sparkSession
    scored = worth(styles, asked, writers).join(F.broadcast(question_bank(spark, bank)), F.col("dimension") == F.col("target"))
    valued = scored.withColumn("value", per_target(F.col("uncertainty"), F.col("importance"), F.col("saturation"), F.col("position")))
    named = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "target"))), lambda x: x["v"] < 0)
    by_place = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"])
    total = rounded(F.aggregate(by_place, F.lit(0.0), lambda a, x: a + x), 6)
    each = valued.groupBy("writer", "question_id").agg(total.alias("priority"), F.array_join(F.transform(named, lambda x: x["target"]), ", ").alias("reason"))
    fresh = each.join(asked.select("writer", "question_id").distinct(), ["writer", "question_id"], "left_anti")
    w = Window.partitionBy("writer").orderBy(F.desc("priority"), "question_id")
    return fresh.withColumn("rank", F.row_number().over(w))


def select_questions(styles: DataFrame, asked: DataFrame, writers: DataFrame, count: int = ROUND, bank: tuple[Question, ...] = CALIBRATION) -> DataFrame:
    """(writer, round, question_id, priority): the best question, then the best when that one counts as asked, and so
    on. One fold a writer, whose state is how often each dimension was asked about in each position, and what was asked;
    the plan does not grow with count."""
    spark = writers.sparkSession
    names, places = list(scoring.NAMES), 4
    full = {q.id: q for q in ONBOARDING + CALIBRATION} | {q.id: q for q in bank}
    slots = F.create_map(*(x for i, d in full.items() for x in (F.lit(i), F.array(*(F.lit(names.index(t) * places + p) for p, t in enumerate(d.targets))))))
    ids = sorted(q.id for q in bank)
    table = F.array(*(F.struct(F.lit(i).alias("id"), F.array(*(F.lit(names.index(t)) for t in full[i].targets)).alias("t")) for i in ids))
    unsure = uncertainty(styles, writers).groupBy("writer").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "uncertainty", "importance"))), lambda x: F.struct(x["uncertainty"].alias("u"), x["importance"].alias("i"))).alias("unsure"))
    known = asked.where(F.col("question_id").isin(*full)).groupBy("writer", "question_id").agg(F.count(F.lit(1)).cast("int").alias("n"))  # at most a row a question
    before = known.groupBy("writer").agg(F.collect_list(F.struct("question_id", "n")).alias("before"))
    rows = joined(unsure, before, ["writer"], "left")
    none = F.array().cast("array<struct<round:int,question_id:string,priority:double>>")
    hits = F.transform(F.sequence(F.lit(0), F.lit(len(names) * places - 1)), lambda s: F.aggregate(F.coalesce("before", F.array().cast("array<struct<question_id:string,n:int>>")), F.lit(0), lambda a, x: a + F.when(F.array_contains(slots[x["question_id"]], s), x["n"]).otherwise(0)))
    gone = F.coalesce(F.transform("before", lambda x: x["question_id"]), F.array().cast("array<string>"))

    def saturated(counts: Column, d: Column) -> Column:
        total = F.lit(0.0)
        for p in range(places):  # in the order of saturation()
            total = total + F.get(counts, d * places + p) * (ASKED * DECAY**p)
        return total

    def priority(state: Column, q: Column) -> Column:
        each = F.transform(q["t"], lambda d, p: per_target(F.get(F.col("unsure"), d)["u"], F.get(F.col("unsure"), d)["i"], saturated(state["hits"], d), p))
        return rounded(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6)

    def step(state: Column, k: Column) -> Column:
        fresh = F.filter(table, lambda q: ~F.array_contains(state["gone"], q["id"]))
        ranked = F.transform(fresh, lambda q, i: F.struct(priority(state, q).alias("p"), (-i).alias("i"), q["id"].alias("id"), q["t"].alias("t")))

        def taken(best: Column) -> Column:
            asked_now = F.transform(state["hits"], lambda n, s: n + F.when(F.get(best["t"], (s % places).cast("int")) == F.floor(s / places).cast("int"), 1).otherwise(0))
            picked = F.concat(state["picked"], F.array(F.struct(k.alias("round"), best["id"].alias("question_id"), best["p"].alias("priority"))))
            return F.struct(asked_now.alias("hits"), F.concat(state["gone"], F.array(best["id"])).alias("gone"), picked.alias("picked"))

        return F.element_at(F.transform(F.array(F.array_max(ranked)), lambda best: F.when(best.isNull(), state).otherwise(taken(best))), 1)

    start = F.struct(hits.alias("hits"), gone.alias("gone"), none.alias("picked"))
    rounds = F.sequence(F.lit(1), F.lit(count)) if count > 0 else F.array().cast("array<int>")
    picked = rows.select("writer", F.aggregate(rounds, start, step, lambda s: s["picked"]).alias("picked"))
    return picked.select("writer", F.inline("picked"))


def select_pairs(vocabularies: DataFrame, asked: DataFrame, count: int = ROUND) -> DataFrame:
    """(writer, pair_id, formal, plain, pending, rank): unasked pairs, those first whose formal word is only guessed to
    be avoided, then in the bank's order. vocabularies: writer, avoid, confirmed. asked: writer, pair_id."""
    every = vocabularies.join(F.broadcast(pair_bank(vocabularies.sparkSession)))  # 19 rows a writer
    fresh = every.join(asked.select("writer", "pair_id").distinct(), ["writer", "pair_id"], "left_anti")
    pending = F.array_contains(F.coalesce("avoid", F.array().cast("array<string>")), F.col("formal")) & ~F.array_contains(F.coalesce("confirmed", F.array().cast("array<string>")), F.col("formal"))
    w = Window.partitionBy("writer").orderBy(F.when(F.col("pending"), 0).otherwise(1), "place")
    return fresh.withColumn("pending", pending).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, count)).select("writer", "pair_id", "formal", "plain", "pending", "rank")


def scripted_choices(choices: DataFrame) -> DataFrame:
    """(writer, pair_id, formal, plain, chosen) of answers by pair id: the formal or the plain word, or neither (n, none).
    Anything else is an error. choices: writer, seq, pair_id, answer."""
    rows = choices.join(F.broadcast(pair_bank(choices.sparkSession)), "pair_id")
    said = F.lower(F.trim("answer"))
    chosen = F.when(said.isin(NEITHER, "n", "none"), None).when(said == F.col("formal"), F.col("formal")).when(said == F.col("plain"), F.col("plain")).otherwise(F.raise_error(F.concat(F.lit("not a choice of "), F.col("pair_id"), F.lit(": "), F.col("answer"))))
    return rows.select("writer", "seq", "pair_id", "formal", "plain", chosen.alias("chosen"))
