"""Counts over the words, sentences and marks of a text: one Arrow function over Spark's partitions.

Words become numbers, and each list that a metric counts is a bit of a word, so that a batch's words are looked up once and
counted together. Patterns that Java's dialect defines are matched here in the texts in which Python's dialect does the same,
which are all but odd(); in those they stay column expressions. Of technical shapes the function tells
which can match.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx

#: What Java's \s is with (?U).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
#: A text of ASCII, Latin letters up to U+024F, dashes, quotes, bullets, ellipses and euro signs alone, but for letters whose
#: other case is one of ASCII, what is a blank in Python alone, the marks that tx.marked() adds and signs among letters.
PLAIN = r"\A(?:[ -\x7f]+|[\x03-\x1b]+|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e\u0180-\u024f]+|[\u2010-\u2014\u2018-\u201f\u2022\u2023\u2026\u20ac\u25e6]+)*+\z"
#: Names of a metric's words in Lexicons, by the name of its count.
HITS = {
    "first_person": "first_person", "second_person": "second_person", "conjunction": "conjunctions", "subordinate": "subordinators", "strong_modal": "strong_modals", "weak_modal": "weak_modals",
    "hedge": "hedge_words", "filler": "fillers", "buzzword": "buzzwords", "formal_vocab": "formal_vocab", "colloquial": "colloquialisms", "intensifier": "intensifiers", "humour_marker": "humour_markers",
    "technical": "technical_terms", "formal_transition": "formal_transitions",
}
SENTENCE = ("question", "fragment", "initial_conjunction", "imperative")
#: Counts of patterns in texts that are not odd; of phrases, all of a list's.
PATTERNS = ("odd", "n_passive", "n_contraction", "n_hedge_phrase", "n_buzz_phrase", "n_colloquial_phrase")
#: What a text can have at all: shapes, contractions.
MAYBE = ("camel", "snake", "filename", "flag", "acronym", "code", "contraction")
WHOLE = ("word_count", "sentence_count", "n_sentences", "paragraph_count", "heading_count", "bullet_count", "n_chars", "n_long", "n_squares", "unique_word_count", "contraction_chances", "smiles")
#: Rows and words that are lists at one time; words that keep their number from one batch to the next.
ROWS, TOKENS, KNOWN = 512, 200_000, 200_000
#: Bytes of an Arrow batch of texts, and the setting that bounds it, which is Spark's.
BATCH, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def fields(marks: tuple[str, ...]) -> tuple[str, ...]:
    return (*WHOLE, *(f"{k}_count" for k in (*HITS, *SENTENCE)), *(f"n_{m}" for m in marks))


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands texts to Python in batches of BATCH, unless it has a bound of its own: rows alone
    do not bound them, and a worker holds a batch or two."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH)
    return df


def odd(norm: Column) -> Column:
    """Whether a text has other characters than those of PLAIN: one pass over it, most of which is a run of ASCII."""
    return ~norm.rlike(PLAIN)


def phrase_pattern(phrase: str) -> str:
    """tx.phrase_pattern() in Python's dialect, with its first letter where it can be searched for."""
    written, first = tx.phrase_pattern(phrase).removeprefix("(?U)"), phrase[0]
    return rf"{first}(?<!\w{first})" + written.removeprefix(r"\b" + first) if first.isalnum() else written


def phrases_listed(lower: Column, lists: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]) -> Column:
    """An array of (list, term, n): the phrases in a text in lower case that is not odd, once for each list that they count
    towards; empty for others and for null. lists: (names of lists, phrases)."""
    every = [(p, max(p.split(), key=len), phrase_pattern(p), names) for names, of in lists for p in of]

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        sought = [(p, w, re.compile(x), names) for p, w, x, names in every]
        kind = pa.list_(pa.struct([("list", pa.string()), ("term", pa.string()), ("n", pa.int64())]))
        for texts in batches:
            rows = []
            for x in texts:
                t, found = x.as_py() or "", []
                for p, w, pattern, names in sought:
                    if w in t and (n := len(pattern.findall(t))):
                        found += ({"list": name, "term": p, "n": n} for name in names)
                rows.append(found)
            yield pa.array(rows, kind)

    from pyspark.sql.functions import ArrowUDFType, arrow_udf

    return arrow_udf(run, "array<struct<list: string, term: string, n: bigint>>", ArrowUDFType.SCALAR_ITER)(F.when(~odd(lower), lower))


def counts(norm: Column, words: lex.Lexicons = lex.DEFAULT) -> Column:
    """A struct of fields(), PATTERNS (0 in an odd text), maybe (bits of MAYBE), sentence_lengths, phrases (numbers of those
    whose longest word is in an odd text, by the order of hedge_, buzz_ and colloquial_phrases) and vocabulary_diversity."""
    from idiolect.operators import metrics

    marks, first_marks = metrics.MARKS, metrics.FIRST_MARKS
    marks_of_one = {marks[m][0]: f"n_{m}" for m in marks if m not in first_marks}
    names = fields(tuple(marks))
    kind = ", ".join(f"{n}: bigint" for n in (*names, *PATTERNS)) + ", maybe: bigint, sentence_lengths: array<int>, phrases: array<int>, vocabulary_diversity: double"
    lists = {k: getattr(words, v) for k, v in HITS.items()}
    lists |= {"finite": words.finite_verbs, "initial": words.initial_conjunctions, "opener": words.imperative_openers, "subject": lex.CONTRACTABLE_SUBJECTS, "follower": lex.CONTRACTABLE_FOLLOWERS, "negatable": lex.NEGATABLE, "not": ("not",)}
    bit = {k: 1 << i for i, k in enumerate([*lists, "sought"])}
    mask: dict[str, int] = {}
    for k, terms in lists.items():
        for t in terms:
            mask[t] = mask.get(t, 0) | bit[k]
    lists_of_phrases = (words.hedge_phrases, words.buzz_phrases, words.colloquial_phrases)
    every_phrase = [(p, k) for k, of in enumerate(lists_of_phrases) for p in of]
    sought = [max(p.split(), key=len) for p, _ in every_phrase]
    contractions, passive = frozenset(words.contractions), metrics.PASSIVE
    whole: dict[str, list[int]] = {}
    for i, w in enumerate(sought):
        whole.setdefault(w, []).append(i)
        mask[w] = mask.get(w, 0) | bit["sought"]
    smiles = words.humour_punctuation
    endings = "|".join(lex.FILE_ENDINGS)

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from idiolect.operators import batches as of_batches

        inline = BLANKS.replace("\n", "")
        heading = re.compile(rf"(?m)^[{inline}]*#{{1,6}}[{inline}]+[^{BLANKS}]")
        bullet = re.compile(rf"[{inline}]*{tx.BULLET}[{inline}]+")
        blank_line = re.compile(r"\n[ \t]*\n")
        filename = re.compile(rf"\.(?:{endings})")
        flag = re.compile("--[a-z]")
        newline = re.compile(r"\n\s*")
        letters, letters_and_dots = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset(".abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        short = re.compile(rf"\.*(?:{tx.ABBREVIATED}|[A-Za-z])\.+", re.IGNORECASE | re.ASCII)
        item = re.compile(rf"{tx.BULLET}(?=[^\S\n])(\s+)")  # without a blank line after the bullet, which ends it first
        # the first letter alone before what looks back, so that it is searched for and not tried everywhere
        passives = re.compile(r"[abgiw](?<!\w[abgiw])" + passive.partition(r"\b")[2].replace("(?:am|is|are|was|were|be|been|being|get|gets|got)", "(?:(?<=a)(?:m|re)|(?<=i)s|(?<=w)(?:as|ere)|(?<=b)(?:e|een|eing)|(?<=g)(?:et|ets|ot))", 1))
        contracted = re.compile(r"'(?<=\w')(?:t|s|re|ve|ll|d|m)\b")

        phrase_patterns = [re.compile(phrase_pattern(p)) for p, _ in every_phrase]
        listed, masks = pa.array(list(mask), pa.string()), np.array([*mask.values(), 0], np.int64)  # a word that is in no list has the last one
        kinds, in_joined = of_batches.Kinds(BLANKS), {}

        def shortened(t: str, at: int) -> bool:
            """Whether the full stop at a place is that of an abbreviation or a single letter."""
            end = at
            while end >= 0 and t[end] == ".":
                end -= 1
            start = end
            while start >= 0 and t[start] in letters:
                start -= 1
                if end - start > of_batches.LONGEST:
                    return False
            while start >= 0 and t[start] in letters_and_dots:
                start -= 1
            return short.fullmatch(t, start + 1, at + 1) is not None

        def marked_lines(t: str) -> str:
            """A stripped text that is not odd with a BREAK before the blanks that end its paragraphs and list items; what
            else tx.marked() marks are sentence_ends()."""
            if "\n" not in t:
                return t
            parts, done = [], 0
            for m in newline.finditer(t):
                if blank_line.search(m[0]) or (x := item.match(t, m.end())) and not blank_line.search(x[1]):
                    start = m.start()
                    while t[start - 1] in " \t\x0b\x0c\r":
                        start -= 1
                    parts += (t[done:start], tx.BREAK)
                    done = start
            return "".join((*parts, t[done:]))

        def contractions_in(lower: str) -> int:
            n = done = 0
            for m in contracted.finditer(lower):
                start = m.start()
                if start <= done and done:
                    continue  # the letter before it is that of the contraction before it
                done = m.end()
                if m[0] == "'s":
                    while start > 0 and (lower[start - 1] == "_" or lower[start - 1].isalnum()):
                        start -= 1
                    n += lower[start:done] in contractions
                else:
                    n += 1
            return n

        def looked_up(distinct: pa.StringArray) -> tuple[np.ndarray, dict[int, list[int]]]:
            """The lists that words are in, as bits, and the phrases that words with a mark within them may belong to."""
            of, phrases = masks[pc.fill_null(pc.index_in(distinct, listed), -1).to_numpy()], {}
            # a pattern's words end where words do: at a token's ends, or at a mark within it
            joined = np.flatnonzero(pc.match_substring_regex(distinct, "['-]").to_numpy(zero_copy_only=False))
            of[joined] &= ~bit["sought"]
            for i, token in zip(joined.tolist(), distinct.take(pa.array(joined)).to_pylist()):
                if (held := in_joined.get(token)) is None:
                    if len(in_joined) > KNOWN:
                        in_joined.clear()
                    in_joined[token] = held = [k for k, w in enumerate(sought) if w in token]
                if held:
                    phrases[i] = held
                    of[i] |= bit["sought"]
            for i in np.flatnonzero(of & bit["sought"]).tolist():
                if i not in phrases:
                    phrases[i] = whole[distinct[i].as_py()]
            return of, phrases

        def counted(norms: list[str], in_java: list[str | None]) -> dict:
            stripped = [t.strip(BLANKS) for t in norms]
            n = len(norms)
            texts = [marked_lines(t) if x is None else x.translate(kinds) for t, x in zip(stripped, in_java)]
            c, text_ends = of_batches.characters(texts)
            text_of = lambda at: np.searchsorted(text_ends, at)
            per = lambda rows, w=None: np.bincount(rows, w, n).astype(np.int64)
            some = lambda at: (np.bincount(text_of(at), minlength=n) > 0).tolist()

            marks_at, doubtful = of_batches.sentence_ends(c)
            mark_row = text_of(marks_at)
            ending = ~np.array([x is not None for x in in_java], bool)[mark_row]  # Java has marked its own
            text_starts = np.concatenate([[of_batches.PAD], text_ends[:-1] + 1])
            for i in np.flatnonzero(doubtful & ending).tolist():
                r = int(mark_row[i])
                ending[i] = not shortened(texts[r], int(marks_at[i] - text_starts[r]))
            breaks = np.flatnonzero(c == ord(tx.BREAK))[of_batches.PAD :]
            bounds = np.sort(np.concatenate([breaks, marks_at[ending]]))  # a piece is all after one and up to the next
            n_pieces, piece_row = len(bounds), text_of(bounds)
            piece_of = lambda at: np.searchsorted(bounds, at)

            starts, lengths, numbers, distinct = of_batches.words(c)
            masks_of, phrases = looked_up(distinct)
            of, rows, piece = masks_of[numbers], text_of(starts), piece_of(starts)
            last = bounds.copy()  # of a piece's characters, but for blanks
            back = np.arange(n_pieces)
            while len(back := back[of_batches.IS_BLANK[c[last[back]]] | (last[back] == bounds[back]) & (c[bounds[back]] == ord(tx.BREAK))]):
                last[back] -= 1
            filled = c[last] != ord(tx.BREAK)
            filled[1:] &= last[1:] > bounds[:-1]
            asks = filled & (c[last] == ord("?"))
            in_piece = np.bincount(piece, minlength=n_pieces)
            worded = in_piece > 0
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            opens, opened = of[first], piece[first]
            finite = np.bincount(piece[of & bit["finite"] != 0], minlength=n_pieces) > 0
            verbal = np.bincount(piece_of(of_batches.verb_endings(c)), minlength=n_pieces) > 0
            word_bounds = np.searchsorted(rows, np.arange(n + 1))
            diversity, distinct_words = of_batches.diversities(numbers, word_bounds, metrics.MTLD_THRESHOLD)
            a, b = of[:-1], of[1:]
            chance = (a & bit["subject"] != 0) & (b & bit["follower"] != 0) | (a & bit["negatable"] != 0) & (b & bit["not"] != 0)
            marked = np.flatnonzero(of)
            of_marked, rows_marked = of[marked], rows[marked]
            out = {
                "word_count": per(rows), "sentence_count": per(piece_row[worded]), "n_sentences": per(piece_row[filled]), "n_chars": per(rows, lengths), "n_long": per(rows[lengths >= 7]),
                "n_squares": per(piece_row, in_piece.astype(np.float64) ** 2), "contraction_chances": per(rows[1:][chance & (rows[1:] == rows[:-1])]), "question_count": per(piece_row[asks]),
                "fragment_count": per(piece_row[worded & ~finite & ~verbal]), "initial_conjunction_count": per(piece_row[opened[opens & bit["initial"] != 0]]),
                "imperative_count": per(piece_row[opened[(opens & bit["opener"] != 0) & ~asks[opened]]]),
                "unique_word_count": distinct_words, "vocabulary_diversity": diversity,
            }
            for k in HITS:
                out[f"{k}_count"] = per(rows_marked[of_marked & bit[k] != 0])
            out["sentence_lengths"] = (np.concatenate([[0], np.cumsum(out["sentence_count"])]), in_piece[worded].astype(np.int32))
            near: list[set[int]] = [set() for _ in norms]
            for r, w in zip(*(x[of & bit["sought"] != 0].tolist() for x in (rows, numbers))):
                near[r].update(phrases[w])
            # what a text must have for a shape to be in it
            small, upper = of_batches.kind(of_batches.IS_SMALL, c), of_batches.kind(of_batches.IS_UPPER, c)
            camels, acronyms = some(np.flatnonzero(small[:-1] & upper[1:])), some(np.flatnonzero(upper[:-1] & upper[1:]))
            dotted = some(np.flatnonzero((c[:-1] == ord(".")) & small[1:]))
            each = {k: [] for k in ("paragraph_count", "heading_count", "bullet_count", "smiles", "maybe", "phrases", *PATTERNS, *(f"n_{m}" for m in first_marks))}
            # marks of one character, of which those within first_marks are taken off below
            each |= {name: per(text_of(np.flatnonzero(c == ord(mark)))).tolist() for mark, name in marks_of_one.items()}
            for i, (norm_text, o, x, found) in enumerate(zip(norms, stripped, in_java, near)):
                t = o if x is None else x.replace(tx.BREAK, "")
                if x is not None and tx.BREAK not in norm_text and tx.GUARD not in norm_text:
                    o = t
                each["paragraph_count"].append(sum(1 for p in blank_line.split(o) if p.strip(BLANKS)) if "\n" in o else int(o.strip(BLANKS) != ""))
                each["heading_count"].append(len(heading.findall(o)) if "#" in o else 0)
                each["bullet_count"].append(sum(1 for line in o.split("\n") if bullet.match(line)))
                lower = t.lower()
                each["smiles"].append(sum(lower.count(p) for p in smiles))
                if x is not None and ("\u212a" in t or "\u0130" in t):  # their lower case is, or begins with, a letter of ASCII
                    found = (i for i, w in enumerate(sought) if w in lower)
                each["phrases"].append([] if x is None else sorted(found))
                each["odd"].append(int(x is not None))
                has = (camels[i], "_" in t, dotted[i] and filename.search(t), "--" in t and flag.search(t), acronyms[i], "`" in t or "()" in t, "'" in t)
                each["maybe"].append(sum(1 << k for k, h in enumerate(has) if h))
                of_lists = [0, 0, 0]
                if x is None:
                    for k in found:
                        of_lists[every_phrase[k][1]] += len(phrase_patterns[k].findall(lower))
                    each["n_passive"].append(sum(1 for _ in passives.finditer(lower)))
                    each["n_contraction"].append(contractions_in(lower) if "'" in lower else 0)
                else:
                    each["n_passive"].append(0)
                    each["n_contraction"].append(0)
                for k, n_found in zip(PATTERNS[3:], of_lists):
                    each[k].append(n_found)
                for m in first_marks:
                    n_marks = 0
                    for literal in marks[m]:
                        if k := t.count(literal):
                            n_marks += k
                            for part in marks_of_one.keys() & set(literal):
                                each[marks_of_one[part]][i] -= k * literal.count(part)
                    each[f"n_{m}"].append(n_marks)
            return out | each

        def packed(found: dict) -> pa.StructArray:
            whole = [pa.array(found[k], pa.int64()) for k in (*names, *PATTERNS, "maybe")]
            offsets, lengths = found["sentence_lengths"]
            nested = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lengths, pa.int32())), pa.array(found["phrases"], pa.list_(pa.int32()))]
            return pa.StructArray.from_arrays([*whole, *nested, pa.array(found["vocabulary_diversity"], pa.float64())], names=[*names, *PATTERNS, "maybe", "sentence_lengths", "phrases", "vocabulary_diversity"])

        for whole_texts, in_java in batches:
            parts, at = [], 0
            while at < len(whole_texts) or not parts:
                texts, size = [], 0
                for t in whole_texts.slice(at, ROWS):
                    texts.append(t.as_py() or "")
                    size += len(texts[-1])
                    if size > 8 * TOKENS:
                        break
                parts.append(packed(counted(texts, in_java.slice(at, len(texts)).to_pylist())))
                at += len(texts)
            yield pa.concat_arrays(parts)

    from pyspark.sql.functions import ArrowUDFType, arrow_udf

    return arrow_udf(run, f"struct<{kind}>", ArrowUDFType.SCALAR_ITER)(norm, F.when(odd(norm), tx.marked(norm)))
