"""Personal data of looser kinds, planted in four languages among decoys: recall and precision by kind."""

import random
from collections import Counter

from idiolect.llm import pii

FILLER = {
    "en": "the harbour was quiet and nobody had expected the ferry before noon",
    "de": "der Hafen war ruhig und niemand hatte die Fähre vor Mittag erwartet",
    "fr": "le port était calme et personne n'attendait le bateau avant midi",
    "es": "el puerto estaba tranquilo y nadie esperaba el barco antes del mediodía",
}
#: Before the value, the values' kind, and what follows. Surnames and half of the given names are in no list.
TITLED = ["Mr. Oakhurst", "Frau Zwiebler", "Mme Quillard", "Sra. Belmonte", "Dr. Ravensworth", "Herr Prof. Adler"]
LISTED = ["Margaret Oakhurst", "Jürgen von der Heide", "Sophie Quillard", "Javier Belmonte Ruiz", "Jean-Pierre Vasseur", "Emily Thorn"]
TOLD = {"en": "my name is Zadie Ploughwright", "de": "mein Name ist Tjark Ohlendorf", "fr": "mon nom est Maëlys Kerbrat", "es": "me llamo Itziar Goikoetxea"}
STREETS = {"en": "42 Beech Hollow Road", "de": "Lindenbaumstraße 17b", "fr": "8 bis, rue de la Tannerie", "es": "Calle de Alcántara, 23"}
BORN = {"en": "born on ", "de": "geboren am ", "fr": "date de naissance : ", "es": "fecha de nacimiento: "}
DATES = {"en": "04/17/1985", "de": "3.11.1972", "fr": "23/06/1990", "es": "1968-02-29"}
DECOYS = [
    "published on 12.03.2010 again", "released 2019-05-01 as planned", "order 87654321-A was late", "the Victoria Station and the San Juan Airport", "part 12345678X and 00000000B",
    "chapter 12 of the Second Avenue novels", "Elizabeth Street Station was shut", "model GB12ABCD12345678901234 of the engine", "version 10.11.2012 build", "New Orders Arrive Daily", "rue de la Paix",
]


def iban(draw):
    body = "".join(draw.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "131400") % 97  # DE00
    whole = f"DE{check:02d}{body}"
    return whole if draw.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def dni(draw):
    n = draw.randrange(10**7, 10**8)
    return f"{n}{'TRWAGMYFPDXBNJZSQVHLCKE'[n % 23]}"


def planted(seed=11, n=400):
    """(text, set of (kind, start, end))."""
    draw, out = random.Random(seed), []
    for i in range(n):
        lang = draw.choice(sorted(FILLER))
        told = TOLD[lang]
        cue = told.rsplit(" ", 2)[0]
        items = {
            "name": [("", draw.choice(TITLED)), ("", draw.choice(LISTED)), (cue + " ", told[len(cue) + 1 :])],
            "street": [("", STREETS[lang])],
            "birth_date": [(BORN[lang], DATES[lang])],
            "iban": [("", iban(draw))],
            "dni": [("", dni(draw))],
            "local_phone": [("tel ", f"0{draw.randrange(10, 99)} {draw.randrange(1000, 9999)} {draw.randrange(1000, 9999)}")],
            "ssn": [("", f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}")],
            "spelt_email": [("", f"anna.{draw.randrange(99)} [at] example [dot] com")],
        }
        text, want = FILLER[lang], set()
        for kind in draw.sample(sorted(items), 3):
            before, value = draw.choice(items[kind])
            text += f", {before}"
            want.add((kind, len(text), len(text) + len(value)))
            text += f"{value}, {FILLER[lang]}"
        for decoy in draw.sample(DECOYS, 2):
            text += f", {decoy}, {FILLER[lang]}"
        out.append((text, want))
    return out


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = lambda s: {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)}
    return {r.doc_id: split(r.spans) for r in pii.digests(df).collect()}


def test_recall_and_precision_of_planted_data(spark):
    rows = planted()
    got = found(spark, [t for t, _ in rows])
    right, told, wanted = Counter(), Counter(), Counter()
    for i, (_, want) in enumerate(rows):
        wanted.update(k for k, _, _ in want)
        told.update(k for k, _, _ in got[i])
        right.update(k for k, _, _ in got[i] & want)
    scores = {k: (right[k] / max(1, wanted[k]), right[k] / max(1, told[k])) for k in pii.LOOSE_KINDS}
    assert min(min(s) for s in scores.values()) >= 0.9, scores


def test_plain_prose_has_no_spans(spark):
    got = found(spark, list(FILLER.values()) * 20 + DECOYS)
    assert not any(got[i] for i in range(80))


def test_ties_repeats_and_nulls(spark):
    text = "Frau Lindenbaumweg 5, born 1.2.1990, born 1.2.1990"
    got = found(spark, [None, "", text, text])
    assert got[0] == got[1] == set() and got[2] == got[3]
    ends = sorted((s, e) for _, s, e in got[2])
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
