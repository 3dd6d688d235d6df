"""Words, sentence ends and lexical diversity of a batch of texts, as numpy arrays over its characters.

A batch is one array of a byte a character: ASCII as it is, the rest by kind. Its texts lie between BREAKs, so no word goes
beyond its text. What is here runs inside Arrow functions, on what Spark hands to one call.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx

#: BREAKs before the first text, so that looking back from it stays in the array; more than the longest ending and abbreviation.
PAD = 8
#: A character of each kind beyond ASCII, whose first byte in UTF-8 tells it: a letter, what Java takes for an s or an i, others.
LETTER, LIKE_S, LIKE_I, OTHER = "\u00c3", "\u0400", "\u0440", "\u2014"


def _table(*of: bytes) -> np.ndarray:
    """Whether a byte is one of these."""
    made = np.zeros(256, bool)
    made[list(b"".join(of))] = True
    return made


_UPPER, _SMALL, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
IS_UPPER, IS_SMALL, IS_LETTER, IS_ALNUM = _table(_UPPER), _table(_SMALL), _table(_UPPER, _SMALL), _table(_UPPER, _SMALL, _DIGITS)
IS_JOINT, IS_MARK, IS_CLOSING, IS_BLANK = _table(b"'-"), _table(b".!?"), _table(b"\"')]"), _table(b"\t\n\x0b\x0c\r ")
IS_WORD = _table(_UPPER, _SMALL, _DIGITS, b"_", bytes(range(0xC3, 0xCA)), b"\xd0\xd1")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[list(_UPPER)] = list(_SMALL)
LOWER[[0xD0, 0xD1]] = list(b"si")
MAY_END_VERB = _table(b"sSdDgG\xd0")
LONGEST = max(len(x) for a in lex.ABBREVIATIONS for x in a.split("."))
assert LONGEST + 2 <= PAD


def kind(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """table[c] of a whole batch: bytes are translated much faster than numpy looks them up."""
    return np.frombuffer(c.tobytes().translate(table.tobytes()), table.dtype)


def _code(word: str) -> int:
    """Its letters as digits, the last one lowest."""
    n = 0
    for c in word:
        n = n * 32 + ord(c) - 96
    return n


#: Codes of the last letters of abbreviations, and of single letters.
_SHORT = np.array(sorted({_code(a.split(".")[-1]) for a in lex.ABBREVIATIONS} | set(range(1, 27))))


class Kinds(dict):
    """For str.translate(): characters beyond ASCII as LETTER, LIKE_S, LIKE_I, OTHER or a blank."""

    def __init__(self, blanks: str) -> None:
        super().__init__({ord(b): " " for b in blanks if ord(b) > 127} | {0x17F: LIKE_S, 0x130: LIKE_I, 0x131: LIKE_I})

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        inside = kind[0] in "LM" or kind in ("Nl", "Nd", "Pc") or c in (0x200C, 0x200D) or 0x24B6 <= c <= 0x24E9 or 0x1F130 <= c <= 0x1F149 or 0x1F150 <= c <= 0x1F169 or 0x1F170 <= c <= 0x1F189
        self[c] = x = chr(c) if c < 128 else LETTER if inside else OTHER
        return x


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The batch's array, and where in it each text's last BREAK is. Texts have no characters beyond ASCII but Latin letters up
    to U+024F, marks of three bytes and what Kinds gives."""
    whole = tx.BREAK * PAD + tx.BREAK.join(texts) + tx.BREAK
    c = np.frombuffer(whole.encode(), np.uint8)
    if len(c) > len(whole):
        c = c[(c & 0xC0) != 0x80]
    return c, PAD - 1 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)


def sentence_ends(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks after which a sentence may end, in order, and which of them are full stops after what may be an abbreviation."""
    at = np.flatnonzero(kind(IS_MARK, c))
    after = at + 1
    if len(closed := np.flatnonzero(IS_CLOSING[c[after]])):
        beyond = np.flatnonzero(~kind(IS_CLOSING, c))
        after[closed] = beyond[np.searchsorted(beyond, after[closed])]
    at = at[IS_BLANK[c[after]]]
    before = c[at - 1]
    doubtful = before == ord(".")
    spelt = np.flatnonzero(IS_LETTER[before])
    code, size = np.zeros(len(spelt), np.int64), np.zeros(len(spelt), np.int64)
    going = np.ones(len(spelt), bool)
    for k in range(1, LONGEST + 2):
        x = c[at[spelt] - k]
        going &= IS_LETTER[x]
        code += np.where(going, (LOWER[x].astype(np.int64) - 96) << 5 * (k - 1), 0)
        size += going
    doubtful[spelt] = (size <= LONGEST) & np.isin(code, _SHORT)
    return at, doubtful & (c[at] == ord("."))


def words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """tx.WORD's matches: where each starts, its length and the number of its text in lower case, and these texts."""
    alnum = kind(IS_ALNUM, c)
    joints = np.flatnonzero(kind(IS_JOINT, c))
    inside = alnum.copy()
    inside[joints[alnum[joints - 1] & alnum[joints + 1]]] = True
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    offsets[1:] = np.cumsum(lengths)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kind(LOWER, c[inside]))).dictionary_encode()
    return starts, lengths, found.indices.to_numpy().astype(np.int64), found.dictionary


def verb_endings(c: np.ndarray) -> np.ndarray:
    r"""Where words of \w end as verbs do: \w{3}(?:ed|ing|s)\b."""
    word = kind(IS_WORD, c)
    at = np.flatnonzero(kind(MAY_END_VERB, c)[:-1] & ~word[1:])
    last, before = LOWER[c[at]], LOWER[c[at - 1]]
    w = [word[at - k] for k in range(6)]
    s = (last == ord("s")) & w[1] & w[2] & w[3]
    ed = (last == ord("d")) & (before == ord("e")) & w[2] & w[3] & w[4]
    ing = (last == ord("g")) & (before == ord("n")) & (LOWER[c[at - 2]] == ord("i")) & w[3] & w[4] & w[5]
    return at[s | ed | ing]


#: Words that a factor is sought in at one time, and the least number of texts for which that is done.
STEP, FEW = 64, 12


def diversities(ids: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[list[float], np.ndarray]:
    """metrics.mtld_of() of texts, whose words' numbers are ids[starts[i]:starts[i + 1]], and how many
    different words each has.

    A word is new to a factor if the same word before it lies before the factor's start. All texts' next factors, forwards
    and backwards, are sought together; what the last few texts still have is passed over word by word."""
    from idiolect.operators import metrics

    n = len(ids)
    bits = np.int64(max(1, n.bit_length()))
    key = (ids << bits) | np.arange(n)
    key.sort()
    place, same = key & ((np.int64(1) << bits) - 1), (key[1:] >> bits) == (key[:-1] >> bits)
    links = np.empty(2 * n, np.int64)  # of all words, then of all in reverse
    before, after = links[:n], np.full(n, n)
    before.fill(-1)
    before[place[1:][same]] = place[:-1][same]
    after[place[:-1][same]] = place[1:][same]
    links[n:] = 2 * n - 1 - after[::-1]
    sizes = np.diff(starts)
    of = np.repeat(np.arange(len(sizes)), sizes)
    distinct = np.bincount(of[before < starts[of]], minlength=len(sizes))

    long = np.flatnonzero(sizes >= 10)
    begin, end = np.concatenate([starts[long], 2 * n - starts[long + 1]]), np.concatenate([starts[long + 1], 2 * n - starts[long]])
    factors, origin, at, seen = np.zeros(len(begin)), begin.copy(), begin.copy(), np.zeros(len(begin), np.int64)
    active, steps = np.arange(len(begin)), np.arange(STEP)
    while len(active) >= FEW:
        first, stop, begun = at[active], end[active], origin[active]
        p = first[:, None] + steps
        inside = p < stop[:, None]
        new = (links[np.minimum(p, 2 * n - 1)] < begun[:, None]) & inside
        known = np.cumsum(new, axis=1) + seen[active][:, None]
        full = (known / (p - begun[:, None] + 1) <= threshold) & inside
        hit = full.argmax(axis=1)
        ended = full[np.arange(len(active)), hit]
        factors[active] += ended
        at[active] = np.where(ended, first + hit + 1, np.minimum(first + STEP, stop))
        origin[active] = np.where(ended, at[active], begun)
        seen[active] = np.where(ended, 0, known[:, -1])
        active = active[at[active] < stop]
    both = np.concatenate([ids, ids[::-1]]) if len(active) else ids
    for i in active.tolist():
        factors[i] = metrics.factors_of(both[origin[i] : end[i]].tolist(), threshold, float(factors[i]))
        origin[i] = end[i]
    rest = end - origin
    some = rest > 0
    factors[some] += (1 - seen[some] / rest[some]) / (1 - threshold)

    made, size, half = [0.0] * len(sizes), (end - begin).tolist(), len(long)
    each = [k / f if f > 0 else float(k) for k, f in zip(size, factors.tolist())]
    for i, a, b in zip(long.tolist(), each[:half], each[half:]):
        made[i] = round((a + b) / 2, 2)
    return made, distinct
