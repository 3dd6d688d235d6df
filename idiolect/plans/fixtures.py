"""Small inputs of our own for what the large tables never exercise. Both Spark and the oracle read them as values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_ID = 1_000_000_000
_LONG = " ".join(f"We use the plain word number {i} and also try to help, so we end the note and start again." for i in range(16))
TEXTS = [
    "I think it was probably fine, sort\nof. Maybe you'd agree? Perhaps, perhaps not. I could be wrong, but it's kind of messy.",
    "Furthermore, the aforementioned stakeholder shall utilise robust alignment; moreover, we must leverage synergy going forward. Hence it was decided.",
    "Honestly, this is really just very silly stuff, lol. It blew up :) and we ended up with a mess, a nightmare, no idea why! So funny :-) haha.",
    "Dr. Smith met J. Brown at 5 p.m. yesterday. They didn't stay (\"why?\") \"No.\" It was over, etc. and so on. I don't. But it is not easy.",
    "# Heading one\n\n- first item here\n- second item (with detail)\n* third one!\n\n## Next\n\n1. numbered line\n2) another line\nplain line after\n\nLast paragraph: short.",
    "Use getUserName and load_config in main.py or README.md with --dry-run; the API and APIs talk JSON. Call `run()` then `run()` and stop().",
    "Well -- that is -- odd --- very odd... yes.... maybe… or—no–yes; a well-known, re-used term: fine? Really?! \"quoted\"",
    "You should check this. Don't wait! Let's go. And you must see it, because your team will need it. Running late. A quiet room. Is it yours?",
    "Café naïve “quoted” it’s fine\r\nsecond line\rthird line ﻿end. ÉTÉ ABC été_x caféName.",
    "",
    "   \n \n  ",
    "I can't go. I can't go. I can't stay, my sense is that my sense is right. I can't go; look at this, look at this. Let me know, let me know.",
    _LONG + " At least it depends, and at the end of the day we circle back. It is important to note this. Thus, in theory, it was done. It is done. It was seen.",
    "The thread pool and the cache of the server were tuned; the database query was slow and latency was high. Deterministic regex tokens. The server was restarted and the index was rebuilt.",
    "Is a... b? C! D.E. f.g. (h.) [i.] Mr. X vs. Y. No. 5 is max. 10 pp. 3 ed. Vol. 2 e.g. this. I.e. that. Done.",
]
SAMPLES = [  # writer, seq, context, text
    ("ada", 1, "Work", TEXTS[1] + " " + TEXTS[1] + " It was agreed that the plan was approved and the budget was confirmed by the board without delay."),
    ("ada", 2, " work ", _LONG),
    ("ada", 3, "Friends Only", TEXTS[2] + " " + TEXTS[2] + " You know it, you love it! Grab your stuff, folks! Yeah, it's a bit weird, but we can't stop! Let's go!"),
    ("ada", 4, "friends only", TEXTS[11]),
    ("ada", 5, None, TEXTS[7]),
    ("ben", 1, "code", TEXTS[5] + " " + TEXTS[13] + " " + TEXTS[13]),
    ("ben", 2, None, "   "),
    ("ben", 3, "code", _LONG + " " + TEXTS[13]),
    ("cy", 1, None, TEXTS[0]),
]
VERDICTS = [  # writer, seq, formal, plain, chosen
    ("ada", 1, "leverage", "use", "use"), ("ada", 2, "thus", "so", "thus"), ("ada", 3, "leverage", "use", "leverage"), ("ada", 4, "hence", "so", None),
    ("ada", 5, "leverage", "use", "use"), ("ben", 1, "optimal", "best", "optimal"), ("ben", 2, "optimal", "best", "optimal"), ("ben", 3, "myriad", "many", "many"),
]
STYLES = [(w, d, v, c) for w, rows in {
    "ada": ((10, 0.80), (35, 0.46), (55, 0.44), (75, 0.90), (95, 0.20), (20, 0.70), (40, 0.45), (60, 0.88)),
    "ben": ((100, 0.0), (0, 0.85), (21, 0.72), (41, 0.10), (61, 0.55), (81, 0.30), (80, 0.69), (5, 0.71)),
}.items() for d, (v, c) in zip(("formality", "directness", "warmth", "conciseness", "humour", "hedging", "technicality", "conversationality"), rows)]
WRITERS = [("ada",), ("ben",), ("new",)]
ASKED = [("ada", 1, "calib_thanks"), ("ada", 2, "calib_bad_news"), ("ada", 3, "calib_thanks"), ("ada", 4, "no_such_question"), ("ben", 1, "onboarding_work"), ("ben", 2, "calib_teach")]
VOCABULARIES = [("ada", ["leverage", "thus", "robust"], ["thus"]), ("ben", [], []), ("new", ["hence"], [])]
ASKED_PAIRS = [("ada", "choice_leverage"), ("ada", "choice_moreover"), ("ben", "choice_furthermore")]
CHOICES = [("ada", 1, "choice_leverage", "use"), ("ada", 2, "choice_thus", "Thus"), ("ben", 1, "choice_hence", "neither"), ("ben", 2, "choice_optimal", "none"), ("ben", 3, "choice_myriad", " n ")]
LOG = [
    '{"id": "writ_1", "kind": "writing_sample", "source": "file", "timestamp": "2024-01-01T00:00:00+00:00", "word_count": 5, "text_ref": "samples/a.txt", "meta": {"context": "work"}, "extra": 1}',
    '{"id": "cali_2", "kind": "calibration_choice", "source": "choice_thus", "timestamp": "2024-01-02T00:00:00+00:00", "word_count": 0, "meta": {"formal": "thus", "plain": "so", "chosen": null}}',
    '{"id": "broken", "kind": ',
    '{"id": "no_source", "kind": "writing_sample", "timestamp": "2024-01-03T00:00:00+00:00", "word_count": 2}',
    "   ",
    "[1, 2]",
    '{"id": "onbo_3", "kind": "onboarding_response", "source": "onboarding_work", "timestamp": "2024-01-04T00:00:00+00:00", "word_count": 9, "text_ref": "samples/b.txt", "meta": {"targets": ["warmth"]}}',
]
ARGUMENTS = ["notes.txt", "notes.txt:Work", "dir:x/notes.txt", "a:b:Two Words", "notes.txt:", ":work"]
TYPED = [(-1, "one\n\ntwo\nlines\n\n\nthree"), (-2, "\n\nafter two\n\n\n\n\nx"), (-3, "a paste\n\nof two\n . \nmore\n.\n.\nend"), (-4, "")]
LISTS = [(1, []), (2, ["a"]), (3, ["a", "b"]), (4, ["a", "b", "c"])]
_GOOD = '"version": "1.0", "profile_id": "p", "style": {"warmth": {"value": 5, "confidence": 0.5}}, "metadata": {"sample_count": 1, "word_count": 2}'
DOCUMENTS = [  # id, json
    ("01 good", "{" + _GOOD + "}"),
    ("02 empty", "{}"),
    ("03 version", "{" + _GOOD.replace('"1.0"', '"one"') + "}"),
    ("04 ranges", "{" + _GOOD.replace("5, ", "101, ").replace("0.5}", "-0.5}") + "}"),
    ("05 types", "{" + _GOOD.replace("5, ", "5.5, ").replace('"p"', "7") + "}"),
    ("06 required", "{" + _GOOD.replace(', "word_count": 2', "").replace('"value": 5, ', "") + "}"),
    ("07 bands", "{" + _GOOD + ', "punctuation": {"comma": "often", "colon": "rare"}, "structure": {"paragraph_length": "huge"}}'),
    ("08 lists", "{" + _GOOD + ', "vocabulary": {"prefer": ["a", 2], "avoid": "b"}, "notes": {"varies_by_context": [{"dimension": "x", "low": 1, "high": 200}]}}'),
    ("09 nested", "{" + _GOOD + ', "contexts": {"work": [], "home": {}}, "syntax": {"question_preference": 1.2, "vocabulary_diversity": true}}'),
    ("10 no object", "[1]"),
    ("11 no json", "{"),
    ("12 unknown", "{" + _GOOD + ', "later": {"x": 1}}'),
]
DOCUMENTS_WITH_ERRORS = [  # id, what is wrong, counted by hand
    ("01 good", ""),
    ("02 empty", "profile: missing required key 'version'; profile: missing required key 'profile_id'; profile: missing required key 'style'; profile: missing required key 'metadata'"),
    ("03 version", "profile.version: one does not match ^[0-9]+\\.[0-9]+$"),
    ("04 ranges", "profile.style.warmth.value: above maximum 100; profile.style.warmth.confidence: below minimum 0"),
    ("05 types", "profile.profile_id: expected string, got bigint; profile.style.warmth.value: expected integer, got decimal"),
    ("06 required", "profile.style.warmth: missing required key 'value'; profile.metadata: missing required key 'word_count'"),
    ("07 bands", "profile.punctuation.comma: often is not one of never, rare, occasional, frequent; profile.structure.paragraph_length: huge is not one of short, medium, long"),
    ("08 lists", "profile.vocabulary.prefer[1]: expected string, got bigint; profile.vocabulary.avoid: expected array, got string; profile.notes.varies_by_context[0].high: above maximum 100"),
    ("09 nested", "profile.syntax.question_preference: above maximum 1; profile.syntax.vocabulary_diversity: expected number, got boolean; profile.contexts.work: expected object, got array"),
    ("10 no object", "profile: expected object, got array"),
    ("11 no json", "profile: not JSON"),
    ("12 unknown", ""),
]
FILES = [  # id, text, what happens
    (1, None), (2, "  \n"), (3, "# Notes\n\nkeep\n"), (4, "a\n{start}\nold\n{end}\nz\n"), (5, "a\r\n{start}\r\nold\r\n{end}\r\nz\r\n"), (6, "  {start}\nindented\n"),
    (7, "{start}\nno end\n"), (8, "{end}\n{start}\n"), (9, "{start}\n{start}\n{end}\n"), (10, "no newline at end"), (11, "{end}\n"),
]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def quoted(x) -> str:
    """x as a literal; what is not printable ASCII as chr()."""
    if x is None:
        return "null"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(quoted, x)) + "]::varchar[]"
    if not isinstance(x, str):
        return repr(x)
    parts = re.findall(r"[ -~]+|[^ -~]", x)
    return "(" + " || ".join("'" + p.replace("'", "''") + "'" if " " <= p[0] <= "~" else f"chr({ord(p)})" for p in parts) + ")" if parts else "''"


def values(rows: list, names: str) -> str:
    """(values ...) as a relation for the oracle."""
    body = ", ".join("(" + ", ".join(map(quoted, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(select * from (values {body}) as v({names}))"
