"""Language identification by cross-parsing entropy.

For each language a reference is put together from labelled texts, and its suffix automaton is built: it reads exactly the
strings that occur in the reference, so walking it from its start gives the longest match at a place. A text is parsed
greedily into phrases, each the longest match in the reference (or one symbol that the reference has not); a phrase begins
where the one before it ended. Phrases times log2 of the reference's length, over the text's length, estimates how many
bits of the text a symbol costs with that language in mind; the language with the least wins.

Symbols are lower-cased letters; all else (digits, marks, blanks) is one symbol, and letters beyond the SYMBOLS most
frequent of the references are another. A text is parsed in blocks of BLOCK characters, and a phrase ends where a block
does. All blocks of a batch of texts, times all languages, walk their automata at once, a symbol a step, as arrays.

Learning: at most ROWS texts a language (drawn by a hash of the id, whatever the table's size), of each its first SNIPPET
characters, together at most CHARS characters over all languages; every language gets the same share. These bounds are
those of the model alone: prediction reads every text whole. The driver holds the references, the tasks the automata
(at most 2 x CHARS states).

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where nothing could be learned.
Ties go to the language that comes first in order. Rows with a null id are predicted, not held out and not learned from.
Repeated rows are predicted alike; an empty table gives no rows. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS, BLOCK = 64, 4_096
ROWS, SNIPPET, CHARS = 400, 2_000, 262_144
#: Characters that are parsed at a time.
LANES = 1 << 21
OTHER, RARE = 0, 1
UNKNOWN = "und"


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def learned_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.where((remainder(F.col(id_col)) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, snippet: int = SNIPPET, chars: int = CHARS) -> dict[str, str]:
    """A reference text a language, all of about the same length."""
    known = learned_from(docs, id_col, text_col, lang_col)
    counted = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row a language
    if not counted:
        return {}
    share = 1 << 20
    least = F.create_map(*(F.lit(x) for lang, n in counted.items() for x in (lang, math.ceil(min(1.0, rows / n) * share))))
    place = F.xxhash64(id_col, F.lit("language"))
    drawn = known.where(F.pmod(place, F.lit(share)) < least[F.col(lang_col)])
    found: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counted}
    for r in drawn.select(F.col(lang_col).alias("lang"), place.alias("place"), F.substring(text_col, 1, snippet).alias("text")).toLocalIterator():
        found[r.lang].append((r.place, r.text))
    each = max(1, chars // len(found))
    return {lang: "\n".join(t for _, t in sorted(found[lang]))[:each] for lang in sorted(found) if found[lang]}


def automaton(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The suffix automaton of a sequence: its transitions (state, symbol, next), and the number of its states."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    edges = np.array([(s, c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int32).reshape(-1, 3)
    return edges, len(moves)


def letters(text: str) -> list[str]:
    return [c for c in text.lower() if c.isalpha()]


@dataclass(frozen=True)
class Model:
    """symbols: the letters with a symbol of their own; edges: each language's automaton; bits: log2 of its reference's length."""

    langs: tuple[str, ...]
    symbols: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    states: tuple[int, ...]
    bits: tuple[float, ...]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def codes(symbols: tuple[str, ...]) -> np.ndarray:
    """Symbol of each code point."""
    table = np.zeros(0x110000, np.uint8)
    own = {c: i + 2 for i, c in enumerate(symbols)}
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = own.get(low if len(low) == 1 else c, RARE)
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fit(texts: dict[str, str], n_symbols: int = SYMBOLS) -> Model:
    counted = Counter(c for t in texts.values() for c in letters(t) if len(c) == 1)
    symbols = tuple(c for c, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: n_symbols - 2])
    table, langs = codes(symbols), tuple(sorted(texts))
    built = [automaton(table[points(texts[x])]) for x in langs]
    return Model(langs, symbols, tuple(e for e, _ in built), tuple(n for _, n in built), tuple(math.log2(max(2, len(texts[x]))) for x in langs))


class Parser:
    """The automata as one table: row state, column symbol; where a phrase ends, the complement of the state after the
    first symbol of the next one. States count in rows, so they are added to a symbol as they are. The last state of each
    automaton follows a symbol that its reference has not, and is where a parse begins: every symbol begins a phrase there."""

    def __init__(self, model: Model):
        self.model, self.codes = model, codes(model.symbols)
        width = len(model.symbols) + 2
        places = np.cumsum([0, *(n + 1 for n in model.states)]) * width
        self.starts = (places[1:] - width).astype(np.int32)
        parts = []
        for edges, n, start in zip(model.edges, model.states, places.tolist()):
            first = np.full(width, start + n * width, np.int32)
            own = edges[edges[:, 0] == 0]
            first[own[:, 1]] = start + own[:, 2] * width
            moves = np.tile(~first, (n + 1, 1))
            moves[edges[:, 0], edges[:, 1]] = start + edges[:, 2] * width
            parts.append(moves.ravel())
        self.moves = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def phrases(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each lane (an array of symbols, none empty) with each language, lanes x languages."""
        n, k = len(lanes), len(self.starts)
        sizes = np.array([len(x) for x in lanes])
        by_size = np.argsort(-sizes, kind="stable")
        longest = int(sizes[by_size[0]])
        at = np.zeros((longest, n), np.int32)
        for column, lane in enumerate(by_size):
            at[: sizes[lane], column] = lanes[lane]
        active = np.searchsorted(-sizes[by_size], -np.arange(longest), "left")
        state = np.repeat(self.starts[:, None], n, 1)
        found = np.zeros((k, n), np.int32)
        for step in range(longest):
            a = active[step]
            moved = self.moves.take(state[:, :a] + at[step, :a])
            ended = moved >> 31
            found[:, :a] -= ended
            state[:, :a] = moved ^ ended
        out = np.empty((n, k), np.int32)
        out[by_size] = found.T
        return out

    def predictions(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and how far it leads: 1 less the ratio of its bits to the second's."""
        total, sizes = np.zeros((len(texts), len(self.starts)), np.int64), np.zeros(len(texts), np.int64)
        known = np.zeros(len(texts), bool)
        lanes, owners, held = [], [], 0

        def parsed() -> None:
            nonlocal lanes, owners, held
            if lanes:
                np.add.at(total, owners, self.phrases(lanes))
            lanes, owners, held = [], [], 0

        for i, t in enumerate(texts if len(self.starts) else []):
            for k in range(0, len(t or ""), BLOCK):
                symbols = self.codes[points(t[k : k + BLOCK])]
                known[i] |= bool(symbols.any())
                lanes.append(symbols)
                owners.append(i)
                sizes[i] += len(symbols)
                held += len(symbols)
                if held >= LANES:
                    parsed()
        parsed()
        bits = total * np.array(self.model.bits) / np.maximum(sizes, 1)[:, None]
        names, scores = [], []
        for i in range(len(texts)):
            if not known[i]:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(bits[i], kind="stable")
            names.append(self.model.langs[order[0]])
            scores.append(1.0 if len(order) == 1 else float(1 - bits[i][order[0]] / bits[i][order[1]]))
        return names, scores


_PARSERS: dict[str, Parser] = {}


def parser(model: Model) -> Parser:
    """The model's tables, built once a Python worker; of one model at a time."""
    if model.key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model.key] = Parser(model)
    return _PARSERS[model.key]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by CHARS
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names, scores = parser(shared.value).predictions(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict them all."""
    return predict(docs, fit(references(docs)))
