"""Personal data: labelers vote on candidate spans, EM learns their reliabilities, a classifier decides.

1. Candidates come from the four base patterns (email, ip, card, phone; those that pass are certain to stay)
   and from looser ones: local phone numbers, SSN, IBAN, spelt-out e-mail addresses, dates, Spanish identity numbers,
   streets with a house number, and names (after a title, from a given name of the gazetteer, or after words as "my name is").
2. Three labelers vote yes, no or abstain on each: a strict pattern or check sum, a gazetteer (top-level
   domains, calling codes, issuer prefixes, countries, given names) and cue words in the 40 characters before it.
   A date counts against itself where no word of birth stands before it.
3. Expectation-maximisation over the counts of (kind, votes), a table of a fixed size, estimates each labeler's
   chance of each vote on true and on false candidates and each kind's share of true ones.
4. A logistic classifier is fitted to EM's posteriors. It sees kind and votes, and what no labeler does of the span
   itself: its length, its share of digits, how many separators it has, and what stands right before it. A looser
   candidate becomes a span if the classifier gives it over one half and it overlaps no base span or looser span
   of a kind listed before.

All of it is SQL functions over the documents; the driver fits on the table of step 3, split by the classes of step 4.

Defined cases: null text counts as empty: no spans. Repeated rows give repeated rows, and count as evidence each. An
empty table gives no rows. Spans of different kinds can tie or overlap where both are base ones; all of them stay. The
work is linear in a text, however long, but for sorting its spans. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiolect.llm import spans
from idiolect.llm.common import cut

#: Each run of address characters is tried from its start alone (or from the last match's end): where the
#: start fails, the rest of the run fails at the same place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[\x20/-][0-9]{3,4}[\x20-][0-9]{3,5}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
REAL_DATE = r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])|(?:0?[1-9]|1[0-2])[./-](?:1[3-9]|2[0-9]|3[01]))[./-](?:19|20)[0-9]{2})$"
DNI = r"(?<![0-9A-Za-z-])[0-9]{8}-?[A-Z](?![0-9A-Za-z-])"
#: The letter of a Spanish identity number by its remainder modulo 23: fixed values.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++"
BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("local_phone", "ssn", "iban", "spelt_email", "birth_date", "dni", "street", "name")
KINDS = BASE_KINDS + LOOSE_KINDS
LABELERS = ("pattern", "gazetteer", "context")
NO, YES, ABSTAIN = 0, 1, 2
#: Classes of a span that only the classifier sees, each 0 to 3.
SHAPES = ("size", "digits", "separators", "lead")

#: Gazetteers.
DOMAINS = "com org net edu gov int io co info biz de fr es uk us ca au ch at nl be it pl se eu".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6)"
IBAN_COUNTRIES = "DE FR ES GB IT NL BE AT CH PL PT SE NO DK FI IE LU CZ GR".split()
GIVEN_NAMES = (
    "Alice Andrew Anthony Barbara Benjamin Brian Catherine Charlotte Daniel David Deborah Edward Elizabeth Emily Emma George Helen James Jennifer Jessica John Joseph Karen Kevin "
    "Laura Linda Margaret Mary Matthew Michael Nancy Oliver Patricia Peter Richard Robert Sarah Steven Susan Thomas William "
    "Andreas Anja Anna Birgit Christian Dieter Elke Friedrich Gerhard Hans Heike Heinrich Ingrid Jan Jens Jürgen Karl Katrin Klaus Lukas Manfred Markus Monika Sabine Stefan "
    "Stephan Ulrike Uwe Wolfgang "
    "Amélie Antoine Camille Catherine Céline Chloé Claire Élodie François Françoise Guillaume Hélène Jacques Jean Julien Louis Marc Marie Mathieu Nathalie Nicolas Philippe Pierre "
    "René Sophie Sylvie Thierry "
    "Alejandro Ana Antonio Carlos Carmen Cristina Diego Elena Fernando Francisco Isabel Javier Jorge José Juan Lucía Luis Manuel Marta María Miguel Pablo Pedro Pilar Raúl Rosa Teresa"
).split()
#: Last words of what is a place or a thing, though it begins as a name does.
PLACES = "street avenue road lane park bridge station airport university college county river lake hotel museum hospital school prize award act day straße strasse platz allee schule universität calle plaza avenida"
TITLE = r"(?:(?:Mrs?|Ms|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Don|Doña)\.?\x20){1,2}"
NAME_CUES = r"(?:name is|name:|full name|signed by|sincerely,|regards,|ich heiße|mein name ist|m'appelle|mon nom est|me llamo|mi nombre es|nombre:|nom:)"
WORD = r"\p{Lu}\p{Ll}{1,20}(?:-\p{Lu}\p{Ll}{1,20})?"
LAST = rf"\x20(?:(?:von|van|de|del|la|le|der|den)\x20){{0,2}}{WORD}"
NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}\p{{Ll}})(?:{TITLE}{WORD}(?:{LAST}){{0,2}}|(?:{'|'.join(GIVEN_NAMES)})(?:-{WORD})?(?:{LAST}){{1,2}}|(?<=(?i:{NAME_CUES})\s){WORD}(?:{LAST}){{1,2}})"
    r"(?![\p{L}\p{N}])"
)
OF = r"(?:(?:de|du|des|del|la|le|les|los|las|el)\x20|l'|d'){0,2}"
STREET = (
    r"(?<![\p{L}\p{N}])(?:"
    r"\p{Lu}\p{L}{2,25}?(?:straße|strasse|str\.|weg|gasse|allee|platz)\x20[0-9]{1,4}[a-z]?"
    rf"|[0-9]{{1,5}}\x20(?:{WORD}\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Terrace)"
    rf"|[0-9]{{1,4}}(?:\x20(?:bis|ter))?,?\x20(?:rue|avenue|boulevard|place|impasse|quai)\x20{OF}{WORD}(?:\x20{WORD})?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Carrer)\x20{OF}{WORD}(?:\x20{OF}{WORD})?,?\x20(?:n\.?[ºo]?\x20?)?[0-9]{{1,4}}"
    r")(?![\p{L}\p{N}])"
)
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": r"e-?mail|contact|write|reply|courriel|correo|kontakt|address",
    "ip": r"\bip\b|host|server|client|address|login|from",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta|cc",
    "phone": r"call|tel|phone|mobile|fax|telefon|appel|llam",
    "local_phone": r"call|tel|phone|mobile|fax|telefon|appel|llam",
    "ssn": r"ssn|social|security|tax",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "spelt_email": r"e-?mail|contact|write|reply|courriel|correo|kontakt",
    "birth_date": r"born|birth|\bdob\b|geboren|\bgeb\.|geburt|naissance|(?<!\p{L})née?(?!\p{L})|nacid[oa]|nacimiento",
    "dni": r"\bdni\b|\bnif\b|identi|documento",
    "street": r"live|living|address|resid|wohn|adresse|anschrift|habit|domicil|vivo|viv[ei]|direcci",
    "name": rf"{NAME_CUES}\s$",
}
AGAINST = r"isbn|issn|version|order|serial|invoice|part no|page|build"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def candidates(text: Column) -> Column:
    """All candidate spans by kind as listed, then start; loose ones that overlap base ones are left out."""
    text = F.coalesce(text, F.lit(""))
    ip = f"^{OCTET}(?:\\.{OCTET}){{3}}$"
    digit, two = text.rlike("[0-9]"), text.rlike("[0-9]{2}")  # cheap: most texts have none, and are searched no further
    base = F.concat(
        spans.matches(text, "email", EMAIL, hint=F.contains(text, F.lit("@"))),
        spans.matches(text, "ip", IP, lambda m: m.rlike(ip), hint=digit),
        spans.matches(text, "card", CARD, lambda m: (F.length(digits(m)) <= 19) & F.call_function("luhn_check", digits(m)), hint=digit),
        spans.matches(text, "phone", PHONE, lambda m: F.length(digits(m)).between(8, 15), hint=F.contains(text, F.lit("+"))),
    )
    return base, F.concat(
        spans.matches(text, "local_phone", LOCAL_PHONE, hint=two),
        spans.matches(text, "ssn", SSN, hint=two),
        spans.matches(text, "iban", IBAN, hint=two),
        spans.matches(text, "birth_date", DATE, hint=two),
        spans.matches(text, "dni", DNI, hint=two),
        spans.matches(text, "street", STREET, hint=digit),
        spans.matches(text, "name", NAME),
        spans.matches(text, "spelt_email", SPELT, hint=F.lower(text).contains("at") & (F.contains(text, F.lit("[at")) | F.contains(text, F.lit("(at")))),
    )


def vote(yes: Column) -> Column:
    return F.when(yes, YES).otherwise(NO)


def by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(ABSTAIN)
    for k, v in cases.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def remainder_97(iban: Column) -> Column:
    """What ISO 7064 has to be 1: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def dni_letter(n: Column) -> Column:
    return F.substr(F.lit(DNI_LETTERS), (n.cast("int") % 23 + 1).cast("int"), F.lit(1))


def voted(x: Column, base: Column) -> Column:
    """A candidate with its labelers' votes and length class."""
    m, kind, n = x["match"], x["kind"], digits(x["match"])
    tld = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    pattern = by_kind(kind, {
        "email": vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,10}$")),
        "ip": vote(m.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$")),
        "card": vote(m.rlike(r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$")),
        "phone": vote(m.rlike(r"^\+[1-9][0-9]{0,2}[ .(-]*[0-9 .()-]{6,}$")),
        "local_phone": vote(F.length(n).between(9, 11) & m.rlike(r"^(?:\(|0)")),
        "ssn": vote(~m.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "iban": vote(remainder_97(m) == 1),
        "spelt_email": vote(m.rlike(r"[A-Za-z]{2,}$")),
        "birth_date": F.when(m.rlike(REAL_DATE), ABSTAIN).otherwise(NO),
        "dni": vote(F.substring(m, -1, 1) == dni_letter(n)),
        "street": F.lit(YES),
        "name": F.when(F.lower(F.substring_index(m, " ", -1)).isin(PLACES.split()), NO).otherwise(YES),
    })
    gazetteer = by_kind(kind, {
        "email": vote(tld.isin(DOMAINS)),
        "ip": vote(~m.rlike(r"^0*(?:0|127|255)\.")),
        "card": vote(n.rlike(ISSUERS)),
        "phone": vote(F.substring(n, 1, 1).isin(CALLING_CODES) | F.substring(n, 1, 2).isin(CALLING_CODES) | F.substring(n, 1, 3).isin(CALLING_CODES)),
        "iban": vote(F.substring(m, 1, 2).isin(IBAN_COUNTRIES)),
        "spelt_email": vote(tld.isin(DOMAINS)),
        "name": F.when(m.rlike(rf"^(?:{TITLE})?(?:{'|'.join(GIVEN_NAMES)})[\x20-]"), YES).otherwise(ABSTAIN),
    })
    before = F.lower(x["before"])
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, before.rlike(words)).otherwise(cue)
    context = F.when(before.rlike(AGAINST), NO).when(cue, YES).when(kind == "birth_date", NO).otherwise(ABSTAIN)
    separators = F.length(F.regexp_replace(m, r"[^\x20().\-/]", ""))
    lead = F.substring(x["before"], -1, 1)
    return F.struct(
        kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), pattern.alias("pattern"), gazetteer.alias("gazetteer"), context.alias("context"),
        F.least(F.floor(F.length(m) / 8), F.lit(3)).cast("int").alias("size"),
        F.floor(F.length(n) * 3 / F.length(m)).cast("int").alias("digits"),
        F.least(separators, F.lit(3)).cast("int").alias("separators"),
        F.when(lead == "", 0).when(lead.rlike(r"\s"), 1).when(lead.rlike(r"[:=#]"), 2).otherwise(3).alias("lead"),
    )


def labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans) with votes, for every row."""
    base, loose = candidates(F.col(text_col))
    found = docs.select(F.col(id_col), base.alias("base_found"), loose.alias("loose_found"))
    apart = spans.apart(F.col("loose_found"), F.col("base_found"))
    return found.select(F.col(id_col), F.concat(F.transform("base_found", lambda x: voted(x, F.lit(True))), F.transform(apart, lambda x: voted(x, F.lit(False)))).alias("spans"))


@dataclass(frozen=True)
class Fit:
    reliability: dict  # (labeler, truth, vote) -> chance
    share: dict  # kind -> chance of truth
    weights: dict  # (feature, value) -> weight

    def logit(self, x: Column) -> Column:
        total = F.lit(self.weights["bias", 0])
        for name in ("kind", *LABELERS, *SHAPES):
            table = F.create_map(*(F.lit(y) for (f, v), w in sorted(self.weights.items(), key=str) if f == name for y in (v, w)))
            total = total + F.coalesce(table[x[name]], F.lit(0.0))
        return total


def expectation_maximisation(rows: list[dict], rounds: int = 60) -> tuple[dict, dict, list[float]]:
    """rows: kind, the votes, n. Votes are independent given the truth, and abstaining says nothing about it; labelers'
    chances are shared by the kinds."""
    truth = {(name, t, v): 1.0 if v == ABSTAIN else 0.75 if v == t else 0.25 for name in LABELERS for t in (0, 1) for v in (NO, YES, ABSTAIN)}
    share = {k: 0.9 if k in BASE_KINDS else 0.4 for k in KINDS}
    posterior = [0.0] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            odds = math.log(share[r["kind"]] / (1 - share[r["kind"]])) + sum(math.log(truth[name, 1, r[name]] / truth[name, 0, r[name]]) for name in LABELERS)
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in KINDS:
            own = [(p, r["n"]) for p, r in zip(posterior, rows) if r["kind"] == k]
            prior = 9.0 if k in BASE_KINDS else 4.0
            share[k] = (sum(p * n for p, n in own) + prior) / (sum(n for _, n in own) + 10.0)
        for name in LABELERS:
            for t in (0, 1):
                mass = {v: sum((p if t else 1 - p) * r["n"] for p, r in zip(posterior, rows) if r[name] == v) + (6.0 if v == t else 2.0) for v in (NO, YES)}
                for v in mass:
                    truth[name, t, v] = mass[v] / sum(mass.values())
    return truth, share, posterior


def logistic(rows: list[dict], target: list[float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    names = [("bias", 0), *(("kind", k) for k in KINDS), *((name, v) for name in LABELERS for v in (0, 1, 2)), *((name, v) for name in SHAPES for v in range(4))]
    place = {f: i for i, f in enumerate(names)}
    ones = [[0, place["kind", r["kind"]], *(place[name, r[name]] for name in (*LABELERS, *SHAPES))] for r in rows]
    mass = [math.sqrt(r["n"]) for r in rows]  # rare patterns count too
    total, w = sum(mass) or 1.0, [0.0] * len(names)
    for _ in range(rounds):
        grad = [decay * x for x in w]
        for f, y, m in zip(ones, target, mass):
            z = max(-30.0, min(30.0, sum(w[i] for i in f)))
            d = m / total * (1 / (1 + math.exp(-z)) - y)
            for i in f:
                grad[i] += d
        w = [a - rate * b for a, b in zip(w, grad)]
    return dict(zip(names, w))


def fit(found: DataFrame) -> Fit:
    """From (id, spans) of labelled()."""
    keys = ["kind", *LABELERS, *SHAPES]
    counts = found.select(F.inline("spans")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect()  # at most 12 * 3 ** 3 * 4 ** 4 rows
    rows = [r.asDict() for r in counts]
    truth, share, posterior = expectation_maximisation(rows)
    return Fit(truth, share, logistic(rows, posterior))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base_spans, all_spans) for every row."""
    found = cut(labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"), "votes")
    model = fit(found)
    likely = F.filter("spans", lambda x: ~x["base"] & (model.logit(x) > 0))
    split = found.select("id", F.filter("spans", lambda x: x["base"]).alias("base_spans"), likely.alias("likely"))
    split = split.withColumn("added", F.filter("likely", lambda x: F.lit(False)))
    for kind in LOOSE_KINDS:  # spans of one kind never overlap
        own = F.filter("likely", of_kind(kind))
        split = split.withColumn("added", F.concat("added", spans.apart(own, F.col("added"))))
    return split.select(F.col("id").alias(id_col), "base_spans", F.concat("base_spans", "added").alias("all_spans"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    b, a = F.col("base_spans"), F.col("all_spans")
    return spans_of(docs, id_col, text_col).select(id_col, *(spans.count(b, k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(spans.joined(b), 256).alias("base_sha256"), spans.joined(a).alias("spans"))


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the base patterns alone find: the counts and the digest of their spans, which SQL can state too."""
    found = docs.select(F.col(id_col).alias("id"), candidates(F.col(text_col))[0].alias("base"))
    b = F.col("base")
    return found.select(F.col("id").alias(id_col), *(spans.count(b, k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(spans.joined(b), 256).alias("base_sha256"))


def _pieces(kind: str, pattern: str, keep: str) -> str:
    """Matches of a kind with their offsets: running lengths of the matches and of the parts between them."""
    before = "over (partition by rid order by i rows unbounded preceding)"
    return f"""select rid, '{kind}' as kind, {BASE_KINDS.index(kind)} as rank, e - length(m) as s, e
  from (select rid, m, d, sum(length(p) + length(m)) {before} as e
    from (select rid, m, p, i, regexp_replace(m, '[^0-9]', '', 'g') as d
      from (select rid, unnest(found) as m, unnest(parts[1:len(found)]) as p, unnest(range(1, len(found) + 1)) as i
        from (select rid, regexp_extract_all(text, '{pattern}') as found, regexp_split_to_array(text, '{pattern}') as parts from texts))))
  where {keep}"""


_LUHN = """list_sum([case when i % 2 = 1 then d[length(d) - i + 1]::int when d[length(d) - i + 1]::int > 4 then 2 * d[length(d) - i + 1]::int - 9
    else 2 * d[length(d) - i + 1]::int end for i in range(1, length(d) + 1)]) % 10 = 0"""
PATTERNS_SQL = f"""with texts as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
spans as ({_pieces("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
  union all {_pieces("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "list_max([case when length(ltrim(x, '0')) > 3 then 999 else ('0' || ltrim(x, '0'))::int end for x in string_split(m, '.')]) <= 255")}
  union all {_pieces("card", "[0-9](?:[ -]?[0-9])+", f"case when length(d) between 16 and 19 then {_LUHN} else false end")}
  union all {_pieces("phone", "[+][0-9][ ().0-9-]+[0-9]", "length(d) between 8 and 15")}),
told as (select rid, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE_KINDS)},
    string_agg(kind || ':' || s || ':' || e, ',' order by rank, s) as joined from spans group by rid)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE_KINDS)}, sha256(coalesce(joined, '')) as base_sha256
from texts d left join told using (rid)"""
