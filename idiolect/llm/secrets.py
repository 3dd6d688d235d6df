"""Secret scans: patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are first-order chains over the characters of a token, with add-half smoothing, trained from
labelled samples (a DataFrame of text and label, 1 for random). A token's score is its log-likelihood ratio a
transition; it is a secret above a threshold halfway between the identifiers' high and the random strings' low
scores on the training sample. Scored are all runs of 20 or more of [A-Za-z0-9+/_=-], but for rules and fillers of
fewer than DISTINCT characters, as -----: of random digits less than one in 10^8 is such a run; and for UUIDs, which are
random but name things: one is a secret only where a pattern says so, as after "token:". A span of the model is
kept unless the patterns' spans cover all of it, so spans of both can overlap.

The bundled sample has identifiers of English words and long words of German, French and Spanish, which are
as long as keys: trained on English alone the model took seven of 23 German compounds for keys.

Everything runs in SQL functions; the driver sees the two transition tables, of a fixed size. A token of any length is
scored by blocks of STEP transitions, so the work is linear in it.

Defined cases: null text counts as empty: no spans (redact leaves it null). Repeated rows give repeated rows, an empty
table none. Spans that start together come in the order of their kinds; in redact what overlaps or touches is replaced
once. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idiolect.llm import spans
from idiolect.llm.common import free

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
KINDS = ("assign", "access", "hex", "random")
SIDE, DISTINCT, STEP = 128, 4, 1_024
#: Words of which the ordinary identifiers of the bundled sample are made.
WORDS = """get set user name list item count index value key data file path load save read write open close start stop
create delete update insert select order group table column row query result error message request response client
server session config option default handler manager service factory builder parser writer reader buffer stream
thread process worker task queue event listener callback window panel button label image color width height size
length position offset page title header footer content text string number integer double boolean array object class
method function return import export module package version release build test check valid email address phone
account customer product price total amount invoice payment report summary detail history status active enabled
visible internal external public private static final abstract interface transaction connection database schema
universität straße geschwindigkeit verarbeitung entwicklung información administración desarrollo développement
traitement utilisateur fonctionnement""".split()
#: Words of long compounds and derivations in three more languages; German ones are written together.
COMPOUNDS = {
    "de": """arbeit schutz recht kraft wagen versicherung schule bildung gesetz gebung wirtschaft schaft wissen schrift umwelt verkehr leistung
pflicht haupt bahnhof krank haus pfleg zeugnis fahrzeug schiff fahrt gesellschaft genossen sprech stunde zeit punkt kuchen tisch stuhl
schlüssel schrank knopf pfanne topf schwester bruder freund nachbar steuer erklärung prüfung ordnung wettbewerb spiel abstand knecht
herbst frühling gewicht glück zweig sprung brücke zukunft vergangenheit möglichkeit unterschied beschreibung verpackung speise
lebensmittel ausdruck zusammen hang quelle vorsicht nachricht kurz lang jahr hundert mutter sprache deutsch eigen tum""",
    "fr": """anti inter gouvernement constitution institution profession nation administr respons habil accueil environnement bouteille
travail heureux malheureux connaiss quelque chose aujourd hui cheval chevaux beaucoup réellement changement bibliothèque""",
    "es": """des contra inter nacional constitucion respons abil idad proporcion amente administr aciones ferrocarril desarroll
trabajador ayuntamiento guerra llueve zapato quehacer electro circunst ancia revolucion ario agradec imiento jueves""",
}
ENDINGS = {"de": ("s", "en", "es", "n", "", "", "", ""), "fr": ("ment", "tion", "ellement", "isation", "ités", "eur", ""), "es": ("mente", "ción", "idades", "ización", "ador", "ista", "")}
FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ó": "o", "í": "i"})


def sample_rows(n: int = 600, seed: int = 7) -> list[tuple[str, int]]:
    """The bundled labelled sample: n random strings, n ordinary identifiers and n long words, the same on every call."""
    draw = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (digits + "abcdef", lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower.upper() + digits, lower + digits + "_-")
    rows = [("".join(draw.choice(alphabets[i % len(alphabets)]) for _ in range(draw.randint(20, 64))), 1) for i in range(n)]
    plain = [w for w in WORDS if w.isascii()]
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(3, 6))]
        name = (words[0] + "".join(w.capitalize() for w in words[1:]), "_".join(words), "-".join(words), "_".join(words).upper(), "/".join(words), "".join(w.capitalize() for w in words))[i % 6]
        rows.append((name + draw.choice(("", "", "2", "01", "_v1", "2024", "-3", "64", "_2023-11-05")), 0))
    for i in range(n):
        lang = ("de", "de", "fr", "es")[i % 4]
        roots = [w.translate(FOLD) for w in COMPOUNDS[lang].split()]
        joints = [e.translate(FOLD) for e in ENDINGS[lang]]
        if lang == "de":
            word = "".join(draw.choice(roots) + draw.choice(joints) for _ in range(draw.randint(2, 4)))
        else:
            word = "".join(draw.choice(roots) for _ in range(draw.randint(2, 3))) + draw.choice(joints)
        rows.append((word.capitalize() if draw.random() < 0.5 else word, 0))
    return rows


def bundled(spark: SparkSession) -> DataFrame:
    rows = json.dumps([{"text": t, "label": y} for t, y in sample_rows()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<text:string,label:int>>")))


def code(text: Column, i: Column) -> Column:
    return F.least(F.ascii(F.substr(text, i, F.lit(1))), F.lit(SIDE - 1))


def blocks(token: Column) -> Column:
    """The token in blocks of STEP characters."""
    return F.regexp_extract_all(token, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))


def n_distinct(token: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(blocks(token), lambda b: F.array_distinct(F.split(b, ""))))))


@dataclass(frozen=True)
class Model:
    ratios: tuple[float, ...]
    threshold: float

    def score(self, token: Column) -> Column:
        """The mean log-likelihood ratio of the token's transitions; positive speaks for random."""
        table = F.split(F.lit(",".join(f"{x:.6g}" for x in self.ratios)), ",").cast("array<double>")

        def part(block: Column) -> Column:
            start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

            def step(acc: Column, c: Column) -> Column:
                now = F.least(F.ascii(c), F.lit(SIDE - 1))
                return F.struct(now.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(table, acc["last"] * SIDE + now)).alias("sum"))

            return F.aggregate(F.split(block, ""), start, step, lambda acc: acc["sum"])

        def total(bs: Column) -> Column:
            overlapping = F.transform(bs, lambda b, k: F.concat(b, F.coalesce(F.substring(F.get(bs, k + 1), 1, 1), F.lit(""))))
            return F.aggregate(overlapping, F.lit(0.0), lambda acc, b: acc + part(b))

        return spans.let(blocks(token), total) / F.greatest(F.length(token) - 1, F.lit(1))


def train(samples: DataFrame, smooth: float = 0.5) -> Model:
    """samples: text, label (1 random, 0 ordinary). Null texts and those of one character are left out."""
    pairs = samples.where("length(text) > 1").select("label", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"))
    counted = pairs.groupBy("label", code(F.col("text"), F.col("i")).alias("a"), code(F.col("text"), F.col("i") + 1).alias("b")).count().collect()  # at most 2 * SIDE * SIDE rows
    counts = {(r["label"], r["a"], r["b"]): r["count"] for r in counted}
    from_a = {(y, a): sum(counts.get((y, a, b), 0) for b in range(SIDE)) for y in (0, 1) for a in range(SIDE)}
    used = len({b for _, _, b in counts}) or 1

    def log_p(y: int, a: int, b: int) -> float:
        return math.log((counts.get((y, a, b), 0) + smooth) / (from_a[y, a] + smooth * used))

    model = Model(tuple(log_p(1, a, b) - log_p(0, a, b) for a in range(SIDE) for b in range(SIDE)), 0.0)
    q = samples.where("length(text) > 1").select("label", model.score(F.col("text")).alias("s")).agg(F.percentile(F.when(F.col("label") == 0, F.col("s")), 0.99), F.percentile(F.when(F.col("label") == 1, F.col("s")), 0.01)).first()
    return Model(model.ratios, ((q[0] or 0.0) + (q[1] or 0.0)) / 2)


def base_spans(text: Column) -> Column:
    assign = spans.matches(text, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 1)) >= 6)
    access = spans.matches(text, "access", ACCESS, hint=F.contains(text, F.lit("AKIA")))
    return F.concat(assign, access, spans.matches(text, "hex", HEX))


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the patterns alone find: the counts and the digest of their spans, which SQL can state too."""
    found = docs.select(F.col(id_col), in_order(base_spans(F.col(text_col))).alias("__base"))
    b = F.col("__base")
    return found.select(id_col, *(spans.count(b, k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(spans.joined(b), 256).alias("base_sha256"))


def in_order(found: Column) -> Column:
    """By start, then by kind as listed."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, model: Model, text_col: str = "text", base_col: str = "base_spans", all_col: str = "all_spans") -> DataFrame:
    """docs with two columns more: the spans of the patterns, and those with the model's, both in order."""
    text = F.col(text_col)
    base = docs.withColumn(base_col, base_spans(text))

    def likely(m: Column) -> Column:
        return (n_distinct(m) >= DISTINCT) & ~m.rlike(UUID) & (model.score(m) > model.threshold)

    covered = spans.runs(in_order(F.col(base_col)))
    added = spans.beyond(spans.matches(text, "random", TOKEN, likely), covered)
    both = base.withColumn(all_col, in_order(F.concat(base_col, added)))
    return both.withColumn(base_col, in_order(F.col(base_col)))


def digests(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    b, a = F.col("base_spans"), F.col("all_spans")
    return found.select(F.col("id").alias(id_col), *(spans.count(b, k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(spans.joined(b), 256).alias("base_sha256"), spans.joined(a).alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """The rows of docs with the secrets in their texts replaced, all columns as they are; null texts stay null."""
    base, every = free(docs, "base"), free(docs, "all")
    found = scan(docs, model, text_col, base, every)
    return found.withColumn(text_col, spans.replaced(F.col(text_col), F.col(every), by)).select(docs.columns)


def _pieces(kind: str, pattern: str, keep: str) -> str:
    """Matches of a kind with their offsets: running lengths of the matches and of the parts between them."""
    before = "over (partition by rid order by i rows unbounded preceding)"
    return f"""select rid, '{kind}' as kind, {KINDS.index(kind)} as rank, e - length(m) as s, e
  from (select rid, m, sum(length(p) + length(m)) {before} as e
    from (select rid, unnest(found) as m, unnest(parts[1:len(found)]) as p, unnest(range(1, len(found) + 1)) as i
      from (select rid, regexp_extract_all(text, '{pattern}') as found, regexp_split_to_array(text, '{pattern}') as parts from texts)))
  where {keep}"""


_SQL_ASSIGN = ASSIGN.replace("'", "''")
PATTERNS_SQL = f"""with texts as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
spans as ({_pieces("assign", _SQL_ASSIGN, f"length(regexp_extract(m, '^{_SQL_ASSIGN}$', 1)) >= 6")}
  union all {_pieces("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
  union all {_pieces("hex", "[0-9a-f]+", "length(m) >= 24")}),
told as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e) as joined from spans group by rid)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(joined, '')) as base_sha256
from texts d left join told using (rid)"""
