"""Quality rules as a short-circuit cascade.

Each rule is a test of a text that rejects it or lets it pass. Rules share measures (words, lines, counts), and a
text's measures are made once, when a rule first asks. On a sample of documents every measure and every rule is timed
with what it builds on already there, and the rules' verdicts are kept as a bit mask. The order is then built greedily:
next comes the rule with the most rejections, among the sampled documents that the rules before it let pass, per
second of what it costs there: its own test and the measures that no rule before it has made. A document stops at the
first rule that rejects it, and measures that only later rules need are never made for it. The order changes the cost
alone: a text is kept if no rule rejects it, whatever the order; rules that tie come in the order in which they are listed.
Of a table of more splits than SAMPLE_FILES the sample is drawn from that many files, as reading every text twice would
cost more than the order saves.

Defined cases: null text counts as empty: no words, so the first base rule rejects it. Repeated rows are judged alike. An
empty table gives no rows. Texts are judged whole, however long, in memory of some times their length. Other columns are
kept as they are, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which cost and selectivity are estimated, and how many files of a large table it is drawn from.
SAMPLE_ROWS, SAMPLE_FILES = 2_000, 64
_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_ASCII = bytes(range(128))


class Text:
    """A text and what the rules measure on it, each measured once and only if a rule asks."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split() knows exactly the six ASCII blanks

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _CONTINUATION + _BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(*(w[i:] for i in range(WINDOW))))
        if len(set(windows)) == len(windows):
            return 0
        seen: dict[tuple, int] = {}
        covered, end = 0, 0
        repeated = set()
        for x in windows:
            if x in seen:
                repeated.add(x)
            seen[x] = 1
        for i, x in enumerate(windows):
            if x in repeated:
                covered += i + WINDOW - max(i, end)
                end = i + WINDOW
        return covered

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _LOWER))


    @cached_property
    def n_letters(self) -> int:
        """Letters of any script."""
        ascii_ones = len(self.raw) - len(self.raw.translate(None, _UPPER + _LOWER))
        return ascii_ones + sum(map(str.isalpha, self.raw.translate(None, _ASCII).decode("utf-8", "replace")))

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def most_used(self) -> int:
        return max(self.counts.values(), default=0)


#: What a measure builds on, those first that others build on.
BUILT_ON: dict[str, tuple[str, ...]] = {
    "words": (), "n_words": ("words",), "word_chars": (), "n_symbols": (), "lines": (), "n_dup_lines": ("lines",), "n_repeat_words": ("words",),
    "n_upper": (), "n_lower": (), "n_letters": (), "counts": ("words",), "most_used": ("counts",),
}


@dataclass(frozen=True)
class Rule:
    """needs: the measures that rejects() asks for."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...] = field(default=())

    def measures(self) -> set[str]:
        """Those it needs and what they build on."""
        found, left = set(), list(self.needs)
        while left:
            m = left.pop()
            if m not in found:
                found.add(m)
                left += BUILT_ON[m]
        return found


#: The first two are the contract's base_failed; the others are the method's verdict.
BASE = (
    Rule("few_words", lambda t: t.n_words < 10, ("n_words",)),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words, ("n_words", "n_repeat_words")),
)
VERDICT = (
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words, ("n_symbols", "n_words")),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines), ("n_dup_lines", "lines")),
    Rule("long_words", lambda t: t.word_chars > 30 * t.n_words, ("word_chars", "n_words")),
    Rule("capitals", lambda t: t.n_upper > t.n_lower, ("n_upper", "n_lower")),
    Rule("few_letters", lambda t: 10 * t.n_letters < 3 * t.word_chars, ("n_letters", "word_chars")),
    Rule("one_word", lambda t: 5 * t.most_used > 2 * t.n_words, ("most_used", "n_words")),
    Rule("few_distinct", lambda t: 20 * len(t.counts) < t.n_words, ("counts", "n_words")),
)
RULES = BASE + VERDICT
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def some_files(docs: DataFrame, share: float) -> DataFrame:
    """docs' rows from about this share of its files, drawn by their paths, so that the others are not read; all rows
    where docs is no table of files."""
    try:
        path = F.col("_metadata.file_path")
        docs.select(path)
    except AnalysisException:
        return docs
    return docs.where(F.pmod(F.xxhash64(path), F.lit(1 << 20)) < int(share * (1 << 20)))


def samples(docs: DataFrame, text_col: str, sample_rows: int, files: int, seed: int) -> Iterator[DataFrame]:
    """About sample_rows texts of about `files` files; then, if that had none, of the whole table."""
    n, parts = max(1, docs.count()), docs.rdd.getNumPartitions()
    for of_files in (files / parts, 1.0) if parts > files else (1.0,):
        drawn = docs if of_files == 1.0 else some_files(docs, of_files)
        share = min(1.0, sample_rows / (n * of_files))
        yield drawn.select(text_col) if share == 1.0 else drawn.select(text_col).sample(share, seed)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 42, files: int = SAMPLE_FILES) -> tuple[dict[int, int], list[float], dict[str, float]]:
    """Documents of the sample by mask of the rules that reject them, each rule's own seconds a document, and each
    measure's."""
    wanted = set().union(*(rule.measures() for rule in rules))
    made = [m for m in BUILT_ON if m in wanted]
    columns = ["n", *(f"rule_{i}" for i in range(len(rules))), *made]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        masks: dict[int, list[float]] = {}
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                t, mask, own, of_measures = Text(raw), 0, [], []
                for m in made:
                    began = time.perf_counter()
                    getattr(t, m)
                    of_measures.append(time.perf_counter() - began)
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= bool(rule.rejects(t)) << i
                    own.append(time.perf_counter() - began)
                old = masks.setdefault(mask, [0.0] * len(columns))
                masks[mask] = [a + b for a, b in zip(old, [1.0, *own, *of_measures])]
        rows = sorted(masks)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array([masks[m][k] for m in rows], pa.float64()) for k in range(len(columns)))], names=["mask", *columns])

    found: list = []
    for sample in samples(docs, text_col, sample_rows, files, seed):
        summed = sample.mapInArrow(run, "mask long, " + ", ".join(f"{c} double" for c in columns)).groupBy("mask").agg(*(F.sum(c).alias(c) for c in columns))
        found = found or summed.collect()  # at most 2 ** len(rules) rows
    n = max(1.0, sum(r["n"] for r in found))
    mean = lambda c: sum(r[c] for r in found) / n
    return {r["mask"]: int(r["n"]) for r in found}, [mean(f"rule_{i}") for i in range(len(rules))], {m: mean(m) for m in made}


def order(rules: tuple[Rule, ...], masks: dict[int, int], own: list[float], of_measures: dict[str, float], made: tuple[str, ...] = ()) -> list[int]:
    """Rules by rejections per marginal cost among what is left; ties by cost, then by their place. made: measures that
    are there anyway."""
    left, places, out, there = dict(masks), list(range(len(rules))), [], set(made)
    while places:
        rejected = {i: sum(n for m, n in left.items() if m >> i & 1) for i in places}
        costs = {i: own[i] + sum(of_measures.get(m, 0.0) for m in rules[i].measures() - there) for i in places}
        best = min(places, key=lambda i: (-rejected[i] / max(costs[i], 1e-9), costs[i], i))
        out.append(best)
        places.remove(best)
        there |= rules[best].measures()
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, made: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    return tuple(rules[i] for i in order(rules, *estimate(docs, rules, text_col, sample_rows), made))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are."""
    ordered = plan(docs, rules, text_col, sample_rows)
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            passed = []
            for raw in as_bytes(batch.column(place)):
                t = Text(raw)
                passed.append(not any(rule.rejects(t) for rule in ordered))
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def verdicts(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = VERDICT, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: id, the measures, base_failed, and kept. The cascade runs on rows that the base rules let pass, and what
    it costs is counted beside the measures that every row gets."""
    there = set().union(*(rule.measures() for rule in base), *(Rule(m, bool, (m,)).measures() for m in MEASURES))
    ordered = plan(docs, rules, text_col, sample_rows, tuple(there))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for raw in as_bytes(batch.column(1)):
                t = Text(raw)
                failed = any(rule.rejects(t) for rule in base)
                rows.append((*(getattr(t, m) for m in MEASURES), failed, not failed and not any(rule.rejects(t) for rule in ordered)))
            columns = list(zip(*rows)) or [()] * (len(MEASURES) + 2)
            kinds = [pa.int64()] * len(MEASURES) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, *MEASURES, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean")


#: DuckDB SQL for verdicts() over documents.
ORACLE = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
w as (
  select r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as lines,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]')) as word_chars from t),
g as (select r, i, array_to_string(words[i:i + 4], ' ') as five from w, unnest(range(1, len(words) - 3)) as u(i)),
rep as (select r, i from g qualify count(*) over (partition by r, five) > 1),
cov as (select r, sum(k) as n from (select r, least(5, coalesce(i - lag(i) over (partition by r order by i), 5)) as k from rep) group by r),
top as (select r, max(n) as most, count(*) as kinds from (select r, word, count(*) as n from w, unnest(words) as u(word) group by r, word) group by r),
m as (
  select w.*, len(words) as n_words, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
         length(regexp_replace(x, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(x, '[^a-z]', '', 'g')) as n_lower, length(regexp_replace(x, '[^\pL]', '', 'g')) as n_letters,
         coalesce(most, 0) as most, coalesce(kinds, 0) as kinds
  from w left join cov on w.r = cov.r left join top on w.r = top.r),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or 5 * n_symbols > n_words or 2 * n_dup_lines > len(lines) or word_chars > 30 * n_words or n_upper > n_lower or 10 * n_letters < 3 * word_chars or 5 * most > 2 * n_words or 20 * kinds < n_words) as kept
from f
"""
