"""DuckDB SQL for the queries, built from the same tables of words and numbers but stated on its own.

RE2 has no lookaround and knows ASCII word characters alone, so letters beyond ASCII are first turned into ones that
the pattern at hand treats alike, and lookarounds into captures.
"""

from __future__ import annotations

from idiolect.functions import lexicons as lex
from idiolect.operators import metrics as m
from idiolect.operators import scoring
from idiolect.operators.features import FEATURES
from idiolect.plans import fixtures as fx

WORD = r"[0-9A-Za-z]+(?:[''\-][0-9A-Za-z]+)*"
BULLET = r"(?:[-*•‣◦]|\d+[.)])"
FAR = "[À-ÖØ-öø-ɏ]"


def lit(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def rounded(x: str, digits: int) -> str:
    return f"(printf('%.{digits}f', ({x})::double)::double)"  # of the exact value, ties to even


def rate(count: str, total: str, per: int) -> str:
    return f"(case when {total} > 0 then {rounded(f'({count})::double * {per}e0 / ({total})::double', 4)} else 0e0 end)"


def ratio(a: str, b: str, digits: int = 2) -> str:
    return f"(case when {b} > 0 then {rounded(f'({a})::double / ({b})::double', digits)} else 0e0 end)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(text: str) -> str:
    marks = f"translate(nfc_normalize(coalesce({text}, '')), '’‘“”' || chr(160) || chr(65279), '''''\"\" ')"
    return f"replace(replace({marks}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda t: lower(t))"


def sentences(n: str) -> str:
    abbreviations = "|".join(a.replace(".", r"\.") for a in lex.ABBREVIATIONS)
    x = f"{strip(f'translate({n}, chr(1) || chr(2), chr(32) || chr(32))')}"
    x = rf"regexp_replace({x}, '\s*\n[ \t]*\n\s*', chr(1), 'g')"
    x = rf"regexp_replace({x}, '\s*\n([^\S\n]*{BULLET}[^\S\n]+)', chr(1) || '\1', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(?i)((?:^|[^A-Za-z.])\.*(?:{abbreviations}|[a-z])\.+)([\"'')\]]*\s+)', '\1' || chr(2) || '\2', 'g')"
    x = rf"regexp_replace({x}, '([.!?])[\"'')\]]*\s+', '\1' || chr(1), 'g')"
    return non_blank(f"string_split(replace({x}, chr(2), ''), chr(1))")


def non_blank(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda s: {strip('s')}), lambda s: s <> '')"


def hits(t: str, words) -> str:
    return f"len(list_filter({t}, lambda t: t in {lit(words)}))"


def found(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def literal_count(x: str, literal: str) -> str:
    return f"((length({x}) - length(replace({x}, {fx.quoted(literal)}, ''))) // {len(literal)})"


def phrase(p: str) -> str:
    return r"\b" + "".join(r"\s+" if c == " " else c.replace("'", "''") if c.isalnum() or c == "'" else "\\" + c for c in p) + r"\b"


def phrase_sum(x: str, phrases) -> str:
    return " + ".join(f"(case when contains({x}, {fx.quoted(max(p.split(), key=len))}) then {found(x, phrase(p))} else 0 end)" for p in phrases)


DOCUMENTS = "select doc_id::bigint as doc_id, text from documents"
TEXTS = f"{DOCUMENTS} union all select * from {fx.values([(fx.BASE_ID + i, t) for i, t in enumerate(fx.TEXTS)], 'doc_id, text')}"


def base(source: str, keys: str = "doc_id") -> str:
    """CTEs src, n (normalised) and b (what the metrics share)."""
    return rf"""src as ({source}),
n as (select {keys}, {norm('text')} as norm from src),
t as (select *, {tokens('norm')} as tokens, {sentences('norm')} as sentences, {non_blank(f"regexp_split_to_array({strip('norm')}, '\n[ \t]*\n')")} as paragraphs,
  list_filter(string_split(norm, chr(10)), lambda s: {strip('s')} <> '') as lines,
  regexp_replace(norm, '{FAR}', '_', 'g') as w, regexp_replace(norm, '{FAR}', 'Z', 'g') as z from n),
b as (select *, lower(w) as lw, len(tokens) as words, list_transform(sentences, lambda s: {tokens('s')}) as st,
  list_filter(list_transform(sentences, lambda s: {found('s', WORD)}), lambda k: k > 0) as lengths from t)"""


def variance(x: str) -> str:
    n, s, q = f"len({x})::bigint", f"coalesce(list_sum({x}), 0)::bigint", f"coalesce(list_sum(list_transform({x}, lambda k: k * k)), 0)::bigint"
    return f"(case when {n} >= 2 then ({n} * {q} - {s} * {s})::double / ({n} * {n})::double else 0e0 end)"


BASIC = {
    "word_count": "words",
    "sentence_count": "len(lengths)",
    "paragraph_count": "len(paragraphs)",
    "average_sentence_length": ratio("coalesce(list_sum(lengths), 0)", "len(lengths)"),
    "sentence_length_variance": rounded(variance("lengths"), 2),
    "average_paragraph_length": ratio("words", "len(paragraphs)"),
    "average_word_length": ratio("coalesce(list_sum(list_transform(tokens, lambda t: length(t))), 0)", "words"),
    "long_word_rate": rate("len(list_filter(tokens, lambda t: length(t) >= 7))", "words", 100),
    "unique_word_count": "len(list_distinct(tokens))",
    "heading_count": r"len(list_filter(lines, lambda s: regexp_matches(s, '^\s*#{1,6}\s+\S')))",
    "bullet_count": rf"len(list_filter(lines, lambda s: regexp_matches(s, '^\s*{BULLET}\s+')))",
}


def _marks() -> dict[str, str]:
    out, x = {}, "norm"
    for mark in m.FIRST_MARKS:
        parts = []
        for literal in m.MARKS[mark]:
            parts.append(literal_count(x, literal))
            x = f"replace({x}, {fx.quoted(literal)}, chr(3))"
        out[mark] = " + ".join(parts)
    return {k: out[k] if k in out else literal_count(x, v[0]) for k, v in m.MARKS.items()}


MARKS = _marks()
PAIRS = "list_zip(tokens[:-2], tokens[2:])"
CHANCES = f"(case when words < 2 then 0 else len(list_filter(range(1, words), lambda i: (tokens[i] in {lit(lex.CONTRACTABLE_SUBJECTS)} and tokens[i + 1] in {lit(lex.CONTRACTABLE_FOLLOWERS)}) or (tokens[i] in {lit(lex.NEGATABLE)} and tokens[i + 1] = 'not'))) end)"
EACH = "range(1, len(sentences) + 1)"
QUESTION = "ends_with(rtrim(sentences[i], ' '), '?')"
SYNTAX = {
    "contraction_count": rf"len(list_filter(regexp_extract_all(w, '(?i)\b\w+''(?:t|s|re|ve|ll|d|m)\b'), lambda c: lower(c) in {lit(lex.CONTRACTIONS)} or not ends_with(lower(c), '''s')))",
    "contraction_chances": CHANCES,
    "first_person_count": hits("tokens", lex.FIRST_PERSON),
    "second_person_count": hits("tokens", lex.SECOND_PERSON),
    "passive_count": found("w", r"(?i)\b(?:am|is|are|was|were|be|been|being|get|gets|got)\b(?:\s+\w+ly)?\s+(?:\w+(?:ed|en)\b|(?:" + "|".join(lex.IRREGULAR_PARTICIPLES) + r")\b)"),
    "question_count": f"len(list_filter({EACH}, lambda i: {QUESTION}))",
    "fragment_count": rf"len(list_filter({EACH}, lambda i: len(st[i]) > 0 and len(list_filter(st[i], lambda t: t in {lit(lex.FINITE_VERBS)})) = 0 and not regexp_matches(regexp_replace(sentences[i], '{FAR}', '_', 'g'), '(?i)\b\w{{3,}}(?:ed|ing|es|s)\b')))",
    "conjunction_count": hits("tokens", lex.COORDINATING_CONJUNCTIONS),
    "subordinate_count": hits("tokens", lex.SUBORDINATORS),
    "initial_conjunction_count": f"len(list_filter({EACH}, lambda i: coalesce(st[i][1] in {lit(lex.SENTENCE_INITIAL_CONJUNCTIONS)}, false)))",
    "imperative_count": f"len(list_filter({EACH}, lambda i: coalesce(st[i][1] in {lit(lex.IMPERATIVE_OPENERS)}, false) and not {QUESTION}))",
    "strong_modal_count": hits("tokens", lex.STRONG_MODALS),
    "weak_modal_count": hits("tokens", lex.WEAK_MODALS),
}
SYNTAX_RATES = {f"{k}_rate": rate(f"{k}_count", "words", 100) for k in m.PER_WORD} | {f"{k}_rate": rate(f"{k}_count", "greatest(len(sentences), 1)", 100) for k in m.PER_SENTENCE}
SYNTAX_RATES["contraction_preference"] = ratio("contraction_count", "(contraction_count + contraction_chances)", 3)
ENDINGS = "|".join(lex.FILE_ENDINGS)
SHAPES = {
    "camel": r"regexp_extract_all(w, '\b[a-z]+[A-Z][A-Za-z]*\b')",
    "snake": r"regexp_extract_all(z, '\b[a-z][a-z0-9]*_[a-z0-9_]+\b')",
    "filename": rf"regexp_extract_all(w, '\b[\w.-]+\.(?:{ENDINGS})\b')",
    "flag": r"regexp_extract_all(w, '(?:^|\W)(--[a-z][\w-]+)', 1)",
    "acronym": rf"list_filter(regexp_extract_all(w, '\b[A-Z]{{2,6}}s?\b'), lambda x: lower(x) not in {lit(lex.STOPWORDS)})",
    "code": r"list_distinct(list_transform(regexp_extract_all(w, '`[^`]+`|\b\w+\(\)'), lambda x: lower(x)))",
}
VOCABULARY = {
    "hedge_count": f"{hits('tokens', lex.HEDGE_WORDS)} + {phrase_sum('lw', lex.HEDGE_PHRASES)}",
    "filler_count": hits("tokens", lex.FILLERS),
    "buzzword_count": f"{hits('tokens', lex.BUZZWORDS)} + {phrase_sum('lw', lex.BUZZ_PHRASES)}",
    "formal_vocab_count": hits("tokens", lex.FORMAL_VOCAB),
    "colloquial_count": f"{hits('tokens', lex.COLLOQUIALISMS)} + {phrase_sum('lw', lex.COLLOQUIAL_PHRASES)}",
    "intensifier_count": hits("tokens", lex.INTENSIFIERS),
    "humour_marker_count": hits("tokens", lex.HUMOUR_MARKERS) + " + " + " + ".join(literal_count("lw", p) for p in lex.HUMOUR_PUNCTUATION),
    "technical_count": hits("tokens", lex.TECHNICAL_TERMS) + " + " + " + ".join(f"len({x})" for x in SHAPES.values()),
    "formal_transition_count": hits("tokens", lex.FORMAL_TRANSITIONS),
}
VOCABULARY_RATES = {f"{k}_rate": rate(f"{k}_count", "words", 100) for k in m.VOCABULARY}
_START = "{'f': 0e0, 'n': 0::bigint, 'ty': []::varchar[]%s}"
_TY = "(case when list_contains(a.ty, x.t) then a.ty else list_append(a.ty, x.t) end)"


def mtld_pass(t: str) -> str:
    items = f"list_transform({t}, lambda t: {{'f': 0e0, 'n': 0::bigint, 'ty': []::varchar[], 't': t}})"
    step = f"case when len({_TY})::double / (a.n + 1)::double <= 0.72e0 then {{'f': a.f + 1e0, 'n': 0::bigint, 'ty': []::varchar[], 't': ''}} else {{'f': a.f, 'n': a.n + 1, 'ty': {_TY}, 't': ''}} end"
    return f"list_reduce({items}, lambda a, x: {step}, {{'f': 0e0, 'n': 0::bigint, 'ty': []::varchar[], 't': ''}})"


def mtld(relation: str, keys: str) -> str:
    """CTEs mp and mt (keys, vocabulary_diversity) over a relation with tokens."""
    total = lambda p: f"({p}.f + case when {p}.n > 0 then (1e0 - len({p}.ty)::double / {p}.n::double) / (1e0 - 0.72e0) else 0e0 end)"
    one = lambda p: f"(case when {total(p)} > 0e0 then len(tokens)::double / {total(p)} else len(tokens)::double end)"
    return f"""mp as (select {keys}, tokens, {mtld_pass('tokens')} as p, {mtld_pass('list_reverse(tokens)')} as q from {relation}),
mt as (select {keys}, case when len(tokens) < 10 then 0e0 else {rounded(f"({one('p')} + {one('q')}) / 2e0", 2)} end as vocabulary_diversity from mp)"""


def columns(named: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in named.items())


def analysed(source: str, keys: str = "doc_id") -> str:
    """CTEs up to f: keys, word_count, sentence_count, every metric and feature."""
    on = " and ".join(f"c.{k.strip()} is not distinct from mt.{k.strip()}" for k in keys.split(","))
    renamed = {"avg_sentence_length": "average_sentence_length", "avg_paragraph_length": "average_paragraph_length", "avg_word_length": "average_word_length"}
    marks = {"comma_rate": rounded(rate("n_comma", "words", 1000) + " / 10e0", 4), "semicolon_rate": rate("n_semicolon", "words", 1000), "parenthesis_rate": rate("n_parentheses", "words", 1000), "em_dash_rate": rate("n_em_dash", "words", 1000), "exclamation_rate": rounded("n_exclamation * 100e0 / greatest(sentence_count, 1)", 4)}
    return f"""{base(source, keys)},
c as (select *, {columns(BASIC)}, {columns(SYNTAX)}, {columns(VOCABULARY)}, {columns({f'n_{k}': v for k, v in MARKS.items()})} from b),
{mtld('b', keys)},
f as (select c.*, mt.vocabulary_diversity, {columns(SYNTAX_RATES)}, {columns(VOCABULARY_RATES)}, {columns(renamed)}, {columns(marks)} from c join mt on {on})"""


def linear(x: str, low: float, high: float) -> str:
    return f"greatest(0e0, least(100e0, ({x} - {low!r}::double) / ({high!r}::double - {low!r}::double) * 100e0))"


def contribution(feature: str, weight: float) -> str:
    mapped = linear(feature, *scoring.RANGES[feature])
    return rounded(f"{abs(weight)!r}::double * " + (f"(100e0 - {mapped})" if weight < 0 else mapped), 4)


def raw_score(d: scoring.Dimension) -> str:
    return "(" + " + ".join(contribution(f, w) for f, w in d.weights) + ")"


def score(d: scoring.Dimension) -> str:
    return rounded(raw_score(d), 4)


def results(samples: str, corpora: str, keys: str) -> str:
    """CTEs r: a row a group and dimension. samples: CTEs ending in f over (keys, seq, text); corpora: a relation of
    (keys, word_count, features)."""
    rows = []
    on = " and ".join(f"g.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    for i, d in enumerate(scoring.DIMENSIONS):
        rows.append(f"""select {', '.join('g.' + k.strip() for k in keys.split(','))}, {i} as place, '{d.name}' as dimension,
  round_even(greatest(0e0, least(100e0, {raw_score(d).replace('(', '(', 1)})), 0)::integer as value,
  case when g.word_count > 0 then least(1e0, g.word_count / {float(d.words)!r}::double) else 0e0 end as c,
  case when coalesce(s.n, 0) < 2 then 0.70e0 else greatest(0.30e0, 1e0 - s.dev_{d.name} / 50e0) end as k, {d.ceiling!r}::double as ceiling, coalesce(s.v_{d.name}, []::integer[]) as sample_values
  from {corpora} g left join spread s on {on}""")
    spread = ", ".join(f"stddev_pop({score(d)}) as dev_{d.name}, list(round_even({score(d)}, 0)::integer order by seq) as v_{d.name}" for d in scoring.DIMENSIONS)
    return f"""spread as (select {keys}, count(*) as n, {spread} from {samples} where word_count >= 40 group by {keys}),
r0 as ({' union all '.join(rows)}),
r as (select {keys}, place, dimension, value, {rounded('least(ceiling, ceiling * c * k)', 2)} as confidence, {rounded('c', 3)} as coverage, {rounded('k', 3)} as consistency, ceiling, sample_values from r0)"""


def deviation(x: str) -> str:
    n, s, q = f"len({x})::double", f"list_sum({x})::double", f"list_sum(list_transform({x}, lambda k: k * k))::double"
    return f"sqrt(({n} * {q} - {s} * {s}) / ({n} * {n}))"


FEATURE_LIST = ", ".join(FEATURES)
