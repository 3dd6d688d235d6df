"""The published example: six samples, two choices, and the profile and texts that must come of them."""

import json

import pytest
from pyspark.sql import functions as F

from idiolect.operators import profile, render

# The example's samples and what is published of their profile.
ANSWERS = (
    "I look after the deployment pipeline for a mid-sized product team. Mostly that means keeping the build green and stopping things from falling over at four in the morning. Some weeks it's proper engineering work. Other weeks it's chasing down why a test that's passed for two years suddenly doesn't.",
    "I've got really into bread lately. It's the same three ingredients every time and it still goes wrong in about nine different ways, which I find weirdly satisfying. You can't rush it and you can't fake it. Either you paid attention or you didn't.",
    "I'd say something like: I don't think that'll work, and here's why. Then I'd give them the specific reason rather than just being negative about it. If they've thought it through and I've missed something, fine, I'd rather find that out now.",
    "The expenses system. Three weeks to approve a train ticket and it logs you out every time you upload a receipt. Someone built that on purpose. Someone sat down and decided that's how it should work.",
    "Debugging is mostly narrowing things down. You find the last point where it definitely worked, the first point where it definitely didn't, and then you keep halving the gap until there's nowhere left for the bug to hide. Most people skip the first two steps and go straight to guessing, which is why it takes them all afternoon.",
)
MESSAGE = """\
Right, quick update on the reporting thing.

We're not doing the eighteen month plan. It costs a fortune and we'd be running
two platforms the whole time. Bin it.

The December weekend idea is worse. One bad Saturday and January reporting is
gone. Nobody's signing up for that.

So here's what we're doing. Move the archive first. Check it actually works.
Then move the live reporting. If the archive check goes badly we stop there and
we've lost a week, not a quarter.

Three things I need from you:

- names for the workshop by Friday
- a rough headcount for the archive move
- anyone who thinks this is wrong, tell me now, not in November

On the archive move specifically. Sam reckons we can do it in a fortnight. I
think that's optimistic but it's his call and he knows the data better than I
do. Give him what he asks for.

The thing that worries me isn't the migration. It's that nobody has looked at
the old reconciliation scripts in about three years and they're going to fall
over the moment we touch anything. Someone needs to own that. Volunteers
welcome, otherwise I'm picking someone.

One more thing. We keep saying we'll document this properly and then we don't.
Write it down as you go. Not a big document. A page. Enough that the next person
doesn't have to reverse engineer it from the logs.

That's it. Shout if something here is wrong.
"""
CHOICES = (("thus", "so"), ("hence", "so"))
STYLE = {  # value, confidence
    "formality": (20, 0.69),
    "directness": (59, 0.58),
    "warmth": (39, 0.58),
    "conciseness": (79, 0.56),
    "humour": (19, 0.25),
    "hedging": (33, 0.49),
    "technicality": (38, 0.53),
    "conversationality": (63, 0.74),
}
SYNTAX = {
    "average_sentence_length": 9.65,
    "sentence_length_variance": 42.27,
    "average_paragraph_length": 31.53,
    "contraction_preference": 0.946,
    "fragment_preference": 0.163,
    "question_preference": 0.0,
    "passive_preference": 0.0,
    "vocabulary_diversity": 132.58
}
PUNCTUATION = {
    "semicolon": "never",
    "em_dash": "never",
    "en_dash": "never",
    "colon": "occasional",
    "parentheses": "never",
    "exclamation": "never",
    "ellipsis": "never",
    "hyphen": "occasional",
    "comma": "occasional",
    "question": "never"
}
VOCABULARY = {
    "prefer": [
        "definitely",
        "rather"
    ],
    "avoid": [
        "thus",
        "hence",
        "robust",
        "seamless",
        "holistic",
        "synergy",
        "ascertain",
        "stakeholder",
        "it is important to note",
        "it should be noted",
        "in conclusion",
        "at the end of the day"
    ],
    "technical_terms": [
        "logs",
        "deployment",
        "pipeline"
    ],
    "colloquialisms": [
        "bin",
        "fall over",
        "falling over",
        "fine"
    ]
}
STRUCTURE = {
    "paragraph_length": "short",
    "heading_preference": "low",
    "bullet_preference": "medium"
}
SIZES = {"sample_count": 6, "word_count": 473, "sentence_count": 49}
SHOWN = (
    "  Formality           20  ██░░░░░░░░  conf 0.69 ?",
    "  Directness          59  ██████░░░░  conf 0.58 ?",
    "  Warmth              39  ████░░░░░░  conf 0.58 ?",
    "  Conciseness         79  ████████░░  conf 0.56 ?",
    "  Humour              19  ██░░░░░░░░  conf 0.25 ??",
    "  Hedging             33  ███░░░░░░░  conf 0.49 ?",
    "  Technicality        38  ████░░░░░░  conf 0.53 ?",
    "  Conversationality   63  ██████░░░░  conf 0.74",
)
SUMMARY = (
    "You're very casual, reasonably direct and matter-of-fact.",
    "You use contractions naturally, your sentences average about 10 words with some variation in length and your paragraphs are short.",
    "You never use: ellipses, em dashes, en dashes, exclamation marks, parentheses, question marks and semicolons.",
    "Not yet confident about: humour. More writing, or the calibration questions, will settle these.",
)
INSTRUCTIONS = (
    "- Very casual.",
    "- Reasonably direct.",
    "- Matter-of-fact.",
    "- Concise.",
    "- Rarely hedges.",
    "- Lightly technical.",
    "- Conversational.",
    "- Sentences average around 10 words. Keep their length fairly even.",
    "- Use contractions naturally.",
    "- Occasional sentence fragments are in character.",
    "- Prefer active voice.",
    "- Keep paragraphs short.",
    "- Use few or no headings.",
    "- Do not use: ellipses, em dashes, en dashes, exclamation marks, parentheses, question marks and semicolons.",
    "- Vocabulary they reach for: definitely, rather.",
    "- Domain vocabulary they use without explaining: logs, deployment, pipeline.",
)


@pytest.fixture(scope="module")
def example(spark):
    samples = spark.createDataFrame([("w", i, None, t) for i, t in enumerate((*ANSWERS, MESSAGE))], "writer string, seq long, context string, text string")
    verdicts = spark.createDataFrame([("w", i, f, p, p) for i, (f, p) in enumerate(CHOICES)], "writer string, seq long, formal string, plain string, chosen string")
    made = profile.build(samples, verdicts, "2026-09-10T11:20:52+00:00")
    return made.select(profile.to_json(made).alias("json"), render.report().alias("report"), render.instructions().alias("instructions"), F.size(profile.errors(made)).alias("faults")).first()


def test_profile_is_the_published_one(example):
    got = json.loads(example.json)
    assert {d: (x["value"], x["confidence"]) for d, x in got["style"].items()} == STYLE
    assert (got["syntax"], got["punctuation"], got["vocabulary"], got["structure"]) == (SYNTAX, PUNCTUATION, VOCABULARY, STRUCTURE)
    assert {k: got["metadata"][k] for k in SIZES} == SIZES and got["contexts"] == {} and got["phrasing"] == {"preferred": [], "avoided": []}
    assert got["notes"]["avoid_confirmed_by_choice"] == ["thus", "hence"] and got["notes"]["avoid_inferred_from_absence"] is True and example.faults == 0


def test_texts_are_the_published_ones(example):
    shown = [line.rstrip() for line in example.report.split("\n")]
    assert tuple(shown[2:10]) == SHOWN and set(SUMMARY) <= set(shown)
    told = [line for line in example.instructions.split("\n\nConstraints:")[0].split("\n") if line.startswith("- ")]
    assert tuple(line for line in told if "avoid" not in line and "never use them" not in line) == INSTRUCTIONS
