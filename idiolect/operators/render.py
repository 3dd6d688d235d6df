"""Profiles as text: a summary for people, instructions for a model, bars, reports, and a managed block in a file.

All of it is column expressions over profile rows (see profile.build), one string a row. Only what reaches the
confidence threshold is stated as fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idiolect.functions import text as tx
from idiolect.functions.numbers import whole

THRESHOLD = 0.45
SURE = 0.70
SHOWN, DELTA = 3, 10
TOOL = "idiolect"
# The wording is the output's format.
#: Phrases of each dimension up to 20, 40, 60, 80 and 100.
PHRASES = {
    "formality": ("very casual", "casual", "neither formal nor casual", "fairly formal", "formal"),
    "directness": ("very indirect", "inclined to soften things", "reasonably direct", "direct", "very direct"),
    "warmth": ("quite detached", "matter-of-fact", "moderately warm", "warm", "very warm"),
    "conciseness": ("expansive", "fairly expansive", "middling in length", "concise", "very concise"),
    "humour": ("straight-faced", "occasionally light", "moderately playful", "playful", "very playful"),
    "hedging": ("unhedged", "rarely hedges", "hedges sometimes", "hedges often", "hedges heavily"),
    "technicality": ("non-technical", "lightly technical", "moderately technical", "technical", "highly technical"),
    "conversationality": ("written rather than spoken", "fairly written", "between written and spoken", "conversational", "very conversational"),
}
MARK_NAMES = {
    "comma": "commas", "period": "full stops", "semicolon": "semicolons", "colon": "colons", "parentheses": "parentheses", "em_dash": "em dashes",
    "en_dash": "en dashes", "hyphen": "hyphens", "exclamation": "exclamation marks", "question": "question marks", "ellipsis": "ellipses", "quote": "quotation marks",
}
SAY = {
    "nothing": "There isn't enough writing yet to describe your voice with any confidence. Add another sample or two with `{tool} analyse --save <file>`.",
    "contracts": "You use contractions naturally",
    "rarely": "You rarely contract",
    "bullets": "you reach for bullet points readily",
    "unsure": ". More writing, or the calibration questions, will settle these.",
    "guess": "  ? inferred from what you never write, so treat as a hint",
    "voice": "Write in this person's voice. Their observed habits:",
    "unknown": "- Not enough is known about their writing yet. Write plainly and avoid affectation.",
}
CONSTRAINTS = (
    "",
    "Constraints:",
    "- Do not imitate or copy any source text literally.",
    "- Do not add introductions or conclusions that were not asked for.",
    "- The result should read as naturally written, not polished into uniformity.",
    "- These are writing habits, not personality traits. Do not role-play a persona.",
)
SCOPE = "When writing prose on this person's behalf -- documentation, comments,\ncommit messages, replies -- match the voice below."


def describe(dimension: Column, value: Column) -> Column:
    out = F.concat(dimension, F.lit(" "), value.cast("string"))
    for name, phrases in PHRASES.items():
        own = F.when(value <= 20, phrases[0]).when(value <= 40, phrases[1]).when(value <= 60, phrases[2]).when(value <= 80, phrases[3]).otherwise(phrases[4])
        out = F.when((dimension == name) & (value <= 100), own).otherwise(out)
    return out


def mark_name(mark: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in MARK_NAMES.items() for x in pair))
    return F.coalesce(names[mark], F.replace(mark, F.lit("_"), F.lit(" ")))


def established(style: Column) -> Column:
    return F.filter(style, lambda s: s["confidence"] >= THRESHOLD)


def marks(punctuation: Column, band: str) -> Column:
    """Names of the marks in a band, ordered by mark."""
    return F.transform(F.array_sort(F.map_keys(F.map_filter(punctuation, lambda k, v: v == band))), mark_name)


def words_a_sentence(x: Column) -> Column:
    return F.format_string("%d", whole(x))


def lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def bulleted(items: Column, indent: str = "") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"{indent}- "), x)), "\n")


def summary(tool: str = TOOL) -> Column:
    """A short description in prose."""
    sure, syntax, avg = established(F.col("style")), F.col("syntax"), F.col("syntax.average_sentence_length")
    headline = F.concat(F.lit("You're "), tx.english_list(F.transform(F.slice(sure, 1, 3), lambda s: describe(s["dimension"], s["value"]))), F.lit("."))
    varies = F.when(syntax["sentence_length_variance"] >= 60, "and vary their length a lot").when(syntax["sentence_length_variance"] <= 20, "and keep them fairly even in length").otherwise("with some variation in length")
    contraction = F.when(syntax["contraction_preference"] >= 0.5, SAY["contracts"]).when(syntax["contraction_preference"] <= 0.15, SAY["rarely"])
    detail = F.array_compact(F.array(
        contraction,
        F.when(avg != 0, F.concat(F.lit("your sentences average about "), words_a_sentence(avg), F.lit(" words "), varies)),
        F.concat(F.lit("your paragraphs are "), F.col("structure.paragraph_length")),
        F.when(F.col("structure.bullet_preference") == "high", SAY["bullets"]),
    ))
    never = marks(F.col("punctuation"), "never")
    known = F.size(sure) > 0
    unsure = F.array_sort(F.transform(F.filter("style", lambda s: s["confidence"] < THRESHOLD), lambda s: s["dimension"]))
    prefer, avoid, confirmed = F.col("vocabulary.prefer"), F.col("vocabulary.avoid"), F.col("notes.avoid_confirmed_by_choice")
    guessed = F.exists(avoid, lambda w: ~F.array_contains(confirmed, w))
    avoided = F.array_join(F.transform(avoid, lambda w: F.concat(F.lit("  - "), w, F.when(F.array_contains(confirmed, w), "").otherwise("  ?"))), "\n")
    return lines(
        F.when(known, headline).otherwise(SAY["nothing"].format(tool=tool)),
        F.when(known & (F.size(detail) > 0), F.concat(F.rtrim(tx.capitalised(tx.english_list(detail)), F.lit(".")), F.lit("."))),
        F.when(known & (F.size(never) > 0), F.concat(F.lit("You never use: "), tx.english_list(never), F.lit("."))),
        F.when(F.size(unsure) > 0, F.concat(F.lit("Not yet confident about: "), tx.english_list(unsure), F.lit(SAY["unsure"]))),
        F.when(F.size(prefer) > 0, F.concat(F.lit("\nPrefer\n"), bulleted(prefer, "  "))),
        F.when(F.size(avoid) > 0, F.concat(F.lit("\nAvoid\n"), avoided, F.when(guessed, "\n" + SAY["guess"]).otherwise(""))),
    )


def instructions() -> Column:
    """What to tell a model, whichever it is."""
    sure, syntax, structure = established(F.col("style")), F.col("syntax"), F.col("structure")
    avg, contraction = syntax["average_sentence_length"], syntax["contraction_preference"]
    never, often = marks(F.col("punctuation"), "never"), marks(F.col("punctuation"), "frequent")
    prefer, avoid, phrases, technical = F.col("vocabulary.prefer"), F.col("vocabulary.avoid"), F.col("phrasing.preferred"), F.col("vocabulary.technical_terms")
    is_confirmed = lambda w: F.array_contains(F.col("notes.avoid_confirmed_by_choice"), w)
    listed = lambda before, items: F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(".")))
    return lines(
        F.lit(SAY["voice"]),
        F.lit(""),
        F.when(F.size(sure) == 0, SAY["unknown"]).otherwise(F.array_join(F.transform(sure, lambda s: F.concat(F.lit("- "), tx.capitalised(describe(s["dimension"], s["value"])), F.lit("."))), "\n")),
        F.when(avg != 0, F.concat(F.lit("- Sentences average around "), words_a_sentence(avg), F.lit(" words. "), F.when(syntax["sentence_length_variance"] >= 60, "Vary their length noticeably.").otherwise("Keep their length fairly even."))),
        F.when(contraction >= 0.5, "- Use contractions naturally.").when(contraction <= 0.15, "- Avoid contractions."),
        F.when(syntax["fragment_preference"] >= 0.10, "- Occasional sentence fragments are in character."),
        F.when(syntax["passive_preference"] <= 0.10, "- Prefer active voice."),
        F.concat(F.lit("- Keep paragraphs "), structure["paragraph_length"], F.lit(".")),
        F.when(structure["bullet_preference"] == "high", "- Bullet points are welcome.").when(structure["bullet_preference"] == "low", "- Prefer prose over bullet points."),
        F.when(structure["heading_preference"] == "low", "- Use few or no headings."),
        F.when(F.size(never) > 0, F.concat(F.lit("- Do not use: "), tx.english_list(never), F.lit("."))),
        F.when(F.size(often) > 0, F.concat(F.lit("- They use "), tx.english_list(often), F.lit(" freely."))),
        listed("- Vocabulary they reach for: ", prefer),
        listed("- Turns of phrase they use: ", phrases),
        listed("- They chose against these words when asked directly, so never use them: ", F.filter(avoid, is_confirmed)),
        listed("- Words absent from their writing, so probably avoid: ", F.filter(avoid, lambda w: ~is_confirmed(w))),
        listed("- Domain vocabulary they use without explaining: ", F.slice(technical, 1, 8)),
        *map(F.lit, CONSTRAINTS),
    )


def bar(value: Column, width: int = 10, full: str = "█", empty: str = "░") -> Column:
    filled = whole(F.greatest(F.lit(0), F.least(F.lit(100), value)) / 100.0 * width)
    return F.concat(F.repeat(F.lit(full), filled), F.repeat(F.lit(empty), F.lit(width) - filled))


def doubt(confidence: Column) -> Column:
    return F.when(confidence >= SURE, "  ").when(confidence >= THRESHOLD, " ?").otherwise(" ??")


def variation_report(tool: str = TOOL) -> Column:
    """The dimensions that samples disagree about; null if none."""
    v = F.col("notes.varies_by_context")
    shown = F.transform(F.slice(v, 1, SHOWN), lambda x: F.concat(F.lit("    "), F.rpad(tx.capitalised(x["dimension"]), 18, " "), F.lit(" "), x["low"].cast("string"), F.lit("-"), x["high"].cast("string"), F.lit(" across samples")))
    rest = F.transform(F.slice(v, SHOWN + 1, len(PHRASES)), lambda x: x["dimension"])
    text = lines(
        F.lit("  You write very differently in different places"),
        F.array_join(shown, "\n"),
        F.when(F.size(rest) > 0, F.concat(F.lit("    and "), F.size(rest).cast("string"), F.lit(" more: "), F.array_join(rest, ", "))),
        F.lit("  That is context, not error -- but the single value above is an average of both."),
        F.when(F.size("contexts") == 0, f"  Split them with: {tool} analyse FILE --save --context work"),
    )
    return F.when(F.size(v) > 0, text)


def context_shifts(profiles: DataFrame, limit: int | None = SHOWN) -> DataFrame:
    """(writer, context, dimension, value, delta, rank): where a context is sure and ten points or more from the whole."""
    overall = F.map_from_entries(F.transform("style", lambda s: F.struct(s["dimension"], s["value"])))
    rows = profiles.select("writer", overall.alias("overall"), F.inline("contexts")).select("writer", "context", "overall", F.inline("style"))
    far = rows.withColumn("delta", F.col("value") - F.col("overall")[F.col("dimension")]).where((F.col("confidence") >= THRESHOLD) & (F.abs("delta") >= DELTA))
    w = Window.partitionBy("writer", "context").orderBy(F.desc(F.abs("delta")), "dimension")
    out = far.withColumn("rank", F.row_number().over(w)).select("writer", "context", "dimension", "value", "delta", "rank")
    return out if limit is None else out.where(F.col("rank") <= limit)


def context_report(profiles: DataFrame, tool: str = TOOL) -> DataFrame:
    """(writer, report) of the writers that have contexts."""
    shifts = context_shifts(profiles, None)
    line = F.concat(F.lit("      "), F.rpad(tx.capitalised(F.col("dimension")), 18, " "), F.lit(" "), F.lpad(F.col("value").cast("string"), 3, " "), F.lit("  "), F.format_string("%+d", F.col("delta")), F.lit(" vs overall"))
    listed = shifts.groupBy("writer", "context").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN, F.struct("rank", line.alias("line"))))), lambda x: x["line"]).alias("shown"))
    heads = profiles.select("writer", F.inline("contexts")).select("writer", "context", "metadata.sample_count", "metadata.word_count")
    both = heads.join(listed, ["writer", "context"], "left")
    head = F.concat(F.lit("    "), F.col("context"), F.lit("  ("), F.col("sample_count").cast("string"), F.when(F.col("sample_count") == 1, " sample, ").otherwise(" samples, "), F.format_number("word_count", 0), F.lit(" words)"))
    body = F.when(F.col("n").isNull(), "      much like your overall voice, so far").otherwise(F.concat(F.array_join("shown", "\n"), F.when(F.col("n") > SHOWN, F.concat(F.lit("\n      and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more"))).otherwise("")))
    each = both.select("writer", "context", F.concat(head, F.lit("\n"), body).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("context", "text"))), lambda x: x["text"]), "\n")
    return each.groupBy("writer").agg(F.concat(F.lit("  How that shifts by context\n"), text, F.lit(f"\n  Write for one of these with: {tool} prompt --context NAME")).alias("report"))


def report(tool: str = TOOL) -> Column:
    """A profile as it is shown: bars with doubts, sizes, variation and the summary."""
    row = lambda s: F.concat(F.lit("  "), F.rpad(tx.capitalised(s["dimension"]), 18, " "), F.lit(" "), F.lpad(s["value"].cast("string"), 3, " "), F.lit("  "), bar(s["value"]), F.lit("  conf "), F.format_string("%.2f", s["confidence"]), doubt(s["confidence"]))
    return lines(
        F.lit("Your Voice Profile\n"),
        F.array_join(F.transform("style", row), "\n"),
        F.concat(F.lit("\n  Samples analysed: "), F.col("metadata.sample_count").cast("string")),
        F.concat(F.lit("  Words analysed:   "), F.format_number("metadata.word_count", 0)),
        F.when(F.exists("style", lambda s: s["confidence"] < SURE), "\n  ? low confidence   ?? not yet established"),
        F.concat(F.lit("\n"), variation_report(tool)),
        F.concat(F.lit("\n"), summary(tool)),
    )


def markers(tool: str = TOOL) -> tuple[str, str]:
    return f"<!-- {tool}:start -->", f"<!-- {tool}:end -->"


def refresh_command(target: str, context: str | None = None, tool: str = TOOL) -> str:
    return f"{tool} prompt" + (f" --context {context}" if context else "") + f" --write {target}"


def block(text: Column, context: str | None = None, target: str = "AGENTS.md", tool: str = TOOL) -> Column:
    """Instructions between the markers of the managed block."""
    start, end = markers(tool)
    head = [start, f"<!-- Generated by {tool}. Anything between these markers is", f"     replaced on the next run. Refresh: {refresh_command(target, context, tool)} -->", "", "## Writing voice" + (f" ({context})" if context else ""), "", SCOPE, "", ""]
    return F.concat(F.lit("\n".join(head)), tx.strip(text), F.lit("\n" + end))


def splice(existing: Column, new: Column, tool: str = TOOL) -> Column:
    """struct(text, action, error): a file's text with the block put in. action: created, appended or replaced; a file
    whose markers (whole lines from column 0) make no sense gives an error and no text. CR LF files keep CR LF."""
    start, end = markers(tool)
    text = F.coalesce(existing, F.lit(""))
    crlf = F.contains(text, F.lit("\r\n"))
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    rows = F.split(unix, "\n", -1)
    bare = F.transform(rows, lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    at = lambda m: F.array_position(bare, F.lit(m)).cast("int")
    many = lambda m: F.size(F.filter(bare, lambda x: x == m))
    error = (
        F.when((many(start) > 1) | (many(end) > 1), "more than one block")
        .when((many(start) > 0) & (many(end) == 0), "a start without an end")
        .when((many(start) == 0) & (many(end) > 0), "an end without a start")
        .when(at(end) < at(start), "the end comes before the start")
    )
    empty = tx.strip(text) == ""
    replaced = F.concat(F.slice(rows, F.lit(1), F.greatest(at(start) - 1, F.lit(0))), F.split(new, "\n", -1), F.slice(rows, at(end) + 1, F.greatest(F.size(rows) - at(end), F.lit(0))))
    appended = F.concat(F.split(F.regexp_replace(unix, r"\n+$", ""), "\n", -1), F.array(F.lit("")), F.split(new, "\n", -1), F.array(F.lit("")))
    body = F.array_join(F.when(many(start) > 0, replaced).otherwise(appended), "\n")
    ended = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    back = F.when(crlf, F.replace(ended, F.lit("\n"), F.lit("\r\n"))).otherwise(ended)
    good = F.when(empty, F.concat(new, F.lit("\n"))).otherwise(back)
    action = F.when(empty, "created").when(many(start) > 0, "replaced").otherwise("appended")
    return F.struct(F.when(error.isNull() | empty, good).alias("text"), F.when(error.isNull() | empty, action).alias("action"), F.when(~empty, error).alias("error"))
