"""Exact substring dedup over all documents by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id. Sorting all
suffixes would shuffle many times the input, so suffixes are first thinned without loss:

1. Anchors. Of the Q-grams inside each string of LENGTH bytes the one with the least hash is its anchor, so equal
   strings have equal anchors at equal places. About one byte in twenty is one. Each task sends one entry for
   each hash and document, by hash bucket; hashes that two documents of a task have are known at once, and only
   one entry of them is sent, so what meets in a bucket for a hash is bounded by the number of tasks.
2. Contexts. An anchor whose hash is in two documents or more is cut out of its text with the bytes on both sides
   that a string with this anchor can reach. Equal contexts form a class; those in a larger document than the
   class's least one are covered whole. Again each task sends the least document's alone.
3. Bucket-pointer refinement, within a hash bucket over the contexts of hashes that have several classes, whose
   anchors are aligned: rows get the bucket of their anchor; the bucket of a start 8 bytes before is that of the
   8 bytes there refined by the bucket of the later offset, and so on to the farthest start, each step reusing the
   pointers that the steps before updated; likewise for the ends after the anchor. Strings are equal if start and end
   are in equal buckets; what is alone in a bucket drops out of all that build on it. The least document of a
   bucket covers the others. All strings with one anchor contain it, so what they cover in a document is one
   interval around it.
4. Intervals go back to their documents, where they are merged, cut and digested.

Texts are written once to the shared folder, with the number that names each row, then packed, compressed and shuffled
once by document bucket; steps 2 and 4 read the same shuffle. Buckets and the tasks that read them grow with the
input, so no task's share does. Classes are found by hashes and then compared byte by byte. A long text is looked
through in blocks; a task holds the bytes of its bucket and some ten bytes for each anchor or interval, not for each byte.

Defined cases: null text counts as empty; a null id counts as larger than any; rows with equal ids do not cover
each other, so repeated rows stay; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes, cut

LENGTH, Q = 50, 16
#: Bytes of text for each bucket, and of those that a task gathers before it sends them on.
BUCKET_BYTES, FLUSH_BYTES, CHUNK_BYTES = 12 << 20, 8 << 20, 1 << 20
#: Bytes of contexts that a task keeps; beyond that they are cut out of the texts again when needed.
KEPT_BYTES = 16 << 20
LAST = (1 << 63) - 1
ROWS = "b int, known boolean, blob binary"


def packed(*arrays) -> bytes:
    """Arrays of longs by byte plane, compressed; small or sorted values cost little."""
    import numpy as np
    import zstandard

    planes = [np.ascontiguousarray(np.asarray(a).astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(len(arrays).to_bytes(8, "little") + b"".join(planes))


def unpacked(blob: bytes) -> list:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(k, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data, q: int = Q):
    """Of every q bytes of data (q a power of two)."""
    import numpy as np

    h, n, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n < q:
        h = h[:-n] * np.uint64(base) + h[n:]
        n, base = 2 * n, base * base % 2**64
    return mixed(h)


def sliding(a, width: int, f):
    n = 1
    while 2 * n <= width:
        a, n = f(a[:-n], a[n:]), 2 * n
    return f(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def anchors(data, ends, length: int = LENGTH, q: int = Q):
    """Places in data, the texts that end at `ends` one after the other, of the anchors, and their hashes."""
    import numpy as np

    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = length - q + 1
    h = np.maximum(gram_hashes(data, q), np.uint64(1))
    low = sliding(h, width, np.minimum)  # of the string of `length` bytes at each place
    reach = ends[np.searchsorted(ends, np.arange(len(low)), side="right")]
    low[np.arange(len(low)) + length > reach] = 0  # not inside one text
    pad = np.zeros(width - 1, np.uint64)
    high = sliding(np.concatenate([pad, low, pad]), width, np.maximum)[: len(h)]
    at = np.flatnonzero(h == high)
    return at, h[at]


def anchors_of(raw: bytes, length: int, q: int, block: int):
    """anchors() of one text, by blocks that share length - 1 bytes, so that each string is inside one of them."""
    import numpy as np

    data, found = np.frombuffer(raw, np.uint8), []
    for k in range(0, max(1, len(data) - length + 1), block):
        part = data[k : k + block + length - 1]
        at, h = anchors(part, np.array([len(part)]), length, q)
        found.append((at + k, h))
    at, h = (np.concatenate(x) for x in zip(*found))
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def groups(*keys):
    """The order that sorts by keys, and the number of each sorted row's group."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def per_group(f, values, group):
    """f over the values of each group (ascending numbers from 0), for each row."""
    import numpy as np

    if not len(values):
        return values
    return f.reduceat(values, np.flatnonzero(np.diff(group, prepend=-1)))[group]


def by_bucket(bucket, n_buckets: int):
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    return ((b, order[cuts[b] : cuts[b + 1]]) for b in range(n_buckets) if cuts[b] < cuts[b + 1])


def doc_bucket(uid, n_buckets: int):
    import numpy as np

    return (mixed(uid.astype(np.uint64) + np.uint64(1)) % np.uint64(n_buckets)).astype(np.int64)


def batch_of(rows: list[tuple[int, bool, bytes]]):
    import pyarrow as pa

    b, known, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(known, pa.bool_()), pa.array(blob, pa.binary())], names=["b", "known", "blob"])


def texts_of(batches: Iterator, most: int) -> Iterator[tuple]:
    """(uids, ids, raw texts) of some rows of (uid, id, text), about `most` bytes at once."""
    uids, ids, raws, size = [], [], [], 0
    for batch in batches:
        for uid, i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            uids.append(uid)
            ids.append(LAST if i is None else i)
            raws.append(raw)
            size += len(raw)
            if size >= most:
                yield uids, ids, raws
                uids, ids, raws, size = [], [], [], 0
    if uids:
        yield uids, ids, raws


def asked(n_buckets: int, drop: int, length: int, q: int):
    """Step 1, on the documents' side."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for uids, ids, raws in texts_of(batches, FLUSH_BYTES):
            uids, ids = np.array(uids), np.array(ids)
            hashes, owners, places, k = [], [], [], 0
            while k < len(raws):
                if len(raws[k]) > CHUNK_BYTES:
                    at, h = anchors_of(raws[k], length, q, CHUNK_BYTES)
                    hashes.append(h >> np.uint64(drop))
                    owners.append(np.full(len(at), k))
                    places.append(at)
                    k += 1
                    continue
                first, size = k, 0
                while k < len(raws) and size + len(raws[k]) <= CHUNK_BYTES:
                    size += len(raws[k])
                    k += 1
                ends = np.cumsum([len(x) for x in raws[first:k]])
                at, h = anchors(np.frombuffer(b"".join(raws[first:k]), np.uint8), ends, length, q)
                own = np.searchsorted(ends, at, side="right")
                hashes.append(h >> np.uint64(drop))
                owners.append(own + first)
                places.append(at - np.concatenate([[0], ends])[own])
            h, own, at = (np.concatenate(x) for x in (hashes, owners, places))
            doc = ids[own]
            order, group = groups(h, doc, own, at)
            h, own, at, doc = h[order], own[order], at[order], doc[order]
            _, group = groups(h)  # already sorted
            several = per_group(np.maximum, doc, group) != per_group(np.minimum, doc, group)
            first = np.diff(group, prepend=-1) > 0
            rows = []
            for b, pick in by_bucket(doc_bucket(uids[own[several]], n_buckets), n_buckets):
                rows.append((b, True, packed(uids[own[several]][pick], at[several][pick])))
            send = ~several | first
            h, own, at, doc, several = h[send], own[send], at[send], doc[send], several[send]
            for b, pick in by_bucket((h % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                step = np.diff(h[pick], prepend=np.uint64(0)).astype(np.int64)
                rows.append((b, False, packed(step, doc[pick], uids[own[pick]], at[pick], several[pick])))
            yield batch_of(rows)

    return run


def answered(n_buckets: int):
    """Step 1, in a hash bucket: where anchors are whose hash two documents have."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        rows, parts = [], []
        for known, blob in zip(table["known"].to_pylist(), table["blob"].to_pylist()):
            if known:
                rows.append((table["b"][0].as_py(), True, blob))
            else:
                step, *rest = unpacked(blob)
                parts.append([np.cumsum(step.view(np.uint64)), *rest])
        if parts:
            h, doc, uid, at, several = (np.concatenate(x) for x in zip(*parts))
            order, group = groups(h)
            doc, uid, at, several = doc[order], uid[order], at[order], several[order]
            shared = (per_group(np.maximum, doc, group) != per_group(np.minimum, doc, group)) | (per_group(np.maximum, several, group) > 0)
            uid, at = uid[shared & (several == 0)], at[shared & (several == 0)]
            for b, pick in by_bucket(doc_bucket(uid, n_buckets), n_buckets):
                rows.append((b, True, packed(uid[pick], at[pick])))
        return pa.Table.from_batches([batch_of(rows)])

    return run


def stored(n_buckets: int):
    """Texts, packed by document bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        for uids, ids, raws in texts_of(batches, FLUSH_BYTES):
            uids, ids, size = np.array(uids), np.array(ids), np.array([len(x) for x in raws])
            b, heads, blobs = [], [], []
            for k, pick in by_bucket(doc_bucket(uids, n_buckets), n_buckets):
                b.append(k)
                heads.append(packed(uids[pick], ids[pick], size[pick]))
                blobs.append(zstandard.ZstdCompressor(level=3).compress(b"".join(raws[i] for i in pick)))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(heads, pa.binary()), pa.array(blobs, pa.binary())], names=["b", "head", "texts"])

    return run


def opened(table) -> tuple:
    """A bucket's documents by uid: uids, ids, starts (one more than documents), bytes."""
    import numpy as np
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    heads = [unpacked(x) for x in table["head"].to_pylist()]
    uids, ids, size = (np.concatenate(x) for x in zip(*heads))
    data = np.frombuffer(b"".join(unpack.decompress(x) for x in table["texts"].to_pylist()), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size)])
    return uids, ids, starts, data


def class_keys(context):
    """Two independent 64-bit hashes of each row of bytes (a multiple of 8 wide)."""
    import numpy as np

    lanes = np.ascontiguousarray(context).view(np.uint64)
    one, two = np.zeros(len(lanes), np.uint64), np.full(len(lanes), 7, np.uint64)
    for k in range(lanes.shape[1]):
        one = mixed((one ^ lanes[:, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        two = mixed((two + lanes[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(k + 11))
    return one, two


def width_of(length: int, q: int) -> int:
    """Bytes of a context row: both sides, the anchor, the two sides' lengths, and padding to 8."""
    return -(-(2 * length - q + 2) // 8) * 8


class Contexts:
    """The contexts of anchors (own, at): rows of bytes cut out of a bucket's texts, kept if they are few."""

    def __init__(self, starts, data, own, at, length: int, q: int):
        import numpy as np

        self.data, self.place, self.length, self.q = data, starts[own] + at, length, q
        side = length - q
        self.before, self.after = np.minimum(at, side), np.minimum(starts[own + 1] - starts[own] - at - q, side)
        self.kept = None
        if len(at) * width_of(length, q) <= KEPT_BYTES:
            self.kept = self.rows(np.arange(len(at)))

    def rows(self, pick):
        import numpy as np

        if self.kept is not None:
            return self.kept[pick]
        side, span = self.length - self.q, 2 * self.length - self.q
        out, offsets = np.zeros((len(pick), width_of(self.length, self.q)), np.uint8), np.arange(-side, self.length)
        for k in range(0, len(pick), 100_000):
            i = pick[k : k + 100_000]
            before, after = self.before[i], self.after[i]
            inside = (offsets >= -before[:, None]) & (offsets < after[:, None] + self.q)
            out[k : k + len(i), :span] = np.where(inside, self.data[np.clip(self.place[i][:, None] + offsets, 0, len(self.data) - 1)], 0)
            out[k : k + len(i), span], out[k : k + len(i), span + 1] = before, after
        return out

    def slices(self, order, step: int = 100_000) -> Iterator:
        for k in range(0, len(order), step):
            yield order[k : k + step]


def classes_of(rows_at, n: int, one, two, *first):
    """The order of n rows by `first` and class, and the number of each sorted row's class. one, two: the rows' hashes;
    rows_at gives rows, so that equal hashes are checked byte by byte."""
    import numpy as np

    order, group = groups(*first, one, two)
    twin = np.flatnonzero(np.diff(group) == 0)
    for k in range(0, len(twin), 100_000):
        i = twin[k : k + 100_000]
        if not np.array_equal(rows_at(order[i]), rows_at(order[i + 1])):
            exact = np.unique(rows_at(np.arange(n)), axis=0, return_inverse=True)[1].ravel()
            return groups(*first, exact)
    return order, group


def contexts(n_buckets: int, length: int, q: int):
    """Step 2, in a document bucket."""
    side = length - q

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        rows = []
        if left.num_rows and right.num_rows:
            uids, ids, starts, data = opened(left)
            uid, at = (np.concatenate(x) for x in zip(*(unpacked(x) for x in right["blob"].to_pylist())))
            order, group = groups(uid, at)
            keep = order[np.diff(group, prepend=-1) > 0]
            by = np.argsort(uids)
            own, at = by[np.searchsorted(uids[by], uid[keep])], at[keep]
            context = Contexts(starts, data, own, at, length, q)
            n, keys = len(at), []
            for pick in context.slices(np.arange(n)):
                part = context.rows(pick)
                keys.append((*class_keys(part), mixed(gram_rows(part[:, side : side + q]))))
            one, two, h = (np.concatenate(x) for x in zip(*keys))
            doc = ids[own]
            order, group = classes_of(context.rows, n, one, two)
            least = np.empty(n, np.int64)
            least[order] = per_group(np.minimum, doc[order], group)
            more = np.flatnonzero(doc > least)
            for b, pick in by_bucket(doc_bucket(uids[own[more]], n_buckets), n_buckets):
                i = more[pick]
                rows.append((b, True, packed(uids[own[i]], at[i] - context.before[i], at[i] + q + context.after[i])))
            send = np.flatnonzero(doc == least)
            for b, pick in by_bucket((h[send] % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                i = send[pick]
                head = packed(doc[i], uids[own[i]], at[i])
                rows.append((b, False, len(head).to_bytes(8, "little") + head + squeezed(context.rows(i))))
        return pa.Table.from_batches([batch_of(rows)])

    return run


def gram_rows(grams):
    import numpy as np

    lanes = np.ascontiguousarray(grams).view(np.uint64)
    h = np.zeros(len(lanes), np.uint64)
    for k in range(lanes.shape[1]):
        h = mixed((h ^ lanes[:, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return h


def squeezed(context) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(context.tobytes())


def gram(rows, at: int, n: int):
    """The n bytes (8 at most) at offset `at` of each row, as numbers."""
    import numpy as np

    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :n] = rows[:, at : at + n]
    return out.view(np.uint64).ravel()


def refined(alive, grams, pointers):
    """Bucket pointers of the rows `alive` by (grams, pointers), -1 for the others and for those alone in a bucket, and
    the rows that are left."""
    import numpy as np

    out = np.full(len(grams), -1, np.int32)
    order, group = groups(pointers[alive], grams[alive])
    several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    left = alive[order[several]]
    out[left] = group[several]
    return out, left


def covered_ends(rows, group, before, after, least, length: int, q: int):
    """rows: contexts with their anchors aligned, group: of equal anchor hashes, least: the document of each. For each
    row the first start and the last end of the strings that a row of a smaller document has at the same place; -1, -1
    where there is none."""
    import numpy as np

    n, side = len(rows), length - q
    pointers, alive = group.astype(np.int32), np.arange(n)
    for k in range(0, q, 8):
        pointers, alive = refined(alive, gram(rows, side + k, min(8, q - k)), pointers)
    ends = {0: (pointers, alive)}  # of the bytes after the anchor, by how many
    for j in range(1, side + 1):
        known, left = ends[max(0, j - 8)]
        ends[j] = refined(left, gram(rows, side + q + max(0, j - 8), min(8, j)), known)
    starts = {side: (pointers, alive)}  # of the bytes before it, by where they start
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for j in range(side, -1, -1):
        if j < side:
            known, left = starts[min(side, j + 8)]
            starts[j] = refined(left, gram(rows, j, min(8, side - j)), known)
            starts.pop(j + 9, None) if j + 9 < side else None
        head, left = starts[j]
        tail = ends[j][0]
        i = left[(tail[left] >= 0) & (j >= side - before[left]) & (j + length <= side + q + after[left])]
        if len(i) < 2:
            continue
        order, bucket = groups(head[i], tail[i])
        i = i[order]
        hit = i[per_group(np.minimum, least[i], bucket) < least[i]]
        first[hit] = j
        last[hit] = np.maximum(last[hit], j + length)
    return first, last


def covered(n_buckets: int, length: int, q: int):
    """Step 3, in a hash bucket."""
    side, span, width = length - q, 2 * length - q, width_of(length, q)

    def run(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        rows, heads, parts = [], [], []
        unpack = zstandard.ZstdDecompressor()
        for known, blob in zip(table["known"].to_pylist(), table["blob"].to_pylist()):
            if known:
                rows.append((table["b"][0].as_py(), True, blob))
            else:
                n = int.from_bytes(blob[:8], "little")
                heads.append(unpacked(blob[8 : 8 + n]))
                parts.append(np.frombuffer(unpack.decompress(blob[8 + n :]), np.uint8).reshape(-1, width))
        if heads:
            doc, uid, at = (np.concatenate(x) for x in zip(*heads))
            context = np.concatenate(parts)
            del heads, parts  # as many bytes again
            h = gram_rows(context[:, side : side + q])
            one, two = class_keys(context)
            order, cls = classes_of(lambda i: context[i], len(doc), one, two, h)
            doc, uid, at, context, h = doc[order], uid[order], at[order], context[order], h[order]
            before, after = context[:, span].astype(np.int64), context[:, span + 1].astype(np.int64)
            least = per_group(np.minimum, doc, cls)
            low, high = at - before, at + q + after  # what the class's larger documents have covered
            hit = doc > least
            rep = np.flatnonzero(np.diff(cls, prepend=-1) > 0)  # a row of each class
            _, hash_group = groups(h[rep])
            many = np.bincount(hash_group)[hash_group] > 1
            rep, own = rep[many], hash_group[many]
            if len(rep):
                # a slice of hashes at a time: classes of one hash stay together
                edges = [0, *(np.flatnonzero(np.diff(own)) + 1), len(rep)]
                start = np.full(cls[-1] + 1, -1, np.int64)
                end = np.full(cls[-1] + 1, -1, np.int64)
                k = 0
                while k < len(edges) - 1:
                    m = k + 1
                    while m < len(edges) - 1 and edges[m + 1] - edges[k] <= 10_000:
                        m += 1
                    part, slice_of = rep[edges[k] : edges[m]], own[edges[k] : edges[m]]
                    k = m
                    start[cls[part]], end[cls[part]] = covered_ends(context[part], slice_of - slice_of[0], before[part], after[part], least[part], length, q)
                some = ~hit & (start[cls] >= 0)
                low = np.where(some, at - side + start[cls], low)
                high = np.where(some, at - side + end[cls], high)
                hit |= some
            uid, low, high = uid[hit], low[hit], high[hit]
            for b, pick in by_bucket(doc_bucket(uid, n_buckets), n_buckets):
                rows.append((b, True, packed(uid[pick], low[pick], high[pick])))
        return pa.Table.from_batches([batch_of(rows)])

    return run


def finished(kind, with_text: bool):
    """Step 4, in a document bucket."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        uids, ids, starts, data = opened(left)
        n = len(uids)
        lost, spans, gone = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        if right.num_rows:
            uid, low, high = (np.concatenate(x) for x in zip(*(unpacked(x) for x in right["blob"].to_pylist())))
            by = np.argsort(uids)
            own = by[np.searchsorted(uids[by], uid)]
            order = np.lexsort((low, own))
            own, low, high = own[order], starts[own[order]] + low[order], starts[own[order]] + high[order]
            reach = np.maximum.accumulate(high)  # documents come in order, and so do their bytes
            fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (low[1:] > reach[:-1])]) if len(own) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            own, low, high = own[first], low[first], reach[np.concatenate([first[1:], [len(reach)]]) - 1] if len(first) else high
            lost, spans = np.bincount(own, high - low, n).astype(np.int64), np.bincount(own, minlength=n)
            for k, a, b in zip(own.tolist(), low.tolist(), high.tolist()):
                gone.setdefault(k, []).append((a, b))
        digests, left_over = [], []
        for k in range(n):
            sha, kept, at = hashlib.sha256(), [], int(starts[k])
            for a, b in [*gone.get(k, ()), (int(starts[k + 1]), 0)]:
                sha.update(data[at:a])
                if with_text:
                    kept.append(data[at:a].tobytes())
                at = b
            digests.append(sha.hexdigest())
            left_over.append(b"".join(kept))
        columns = [[None if i == LAST else i for i in ids.tolist()], np.diff(starts), lost, spans, digests]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns + [left_over] * with_text, kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.
    length is 33 to 64; q, a power of two, 8 or more, at most length - 8."""
    import pyarrow as pa

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, math.ceil(total / bucket_bytes))
    bits = min(64, math.ceil(math.log2(total + 2)) + 14)  # of a hash: false meetings cost work, not results
    written = cut(rows, "texts", "zstd")
    by_bucket_of = lambda df: df.repartitionById(n, F.col("b")).groupBy("b")  # noqa: E731  # a task for each bucket
    texts = by_bucket_of(written.mapInArrow(stored(n), "b int, head binary, texts binary"))
    shared = by_bucket_of(written.mapInArrow(asked(n, 64 - bits, length, q), ROWS)).applyInArrow(answered(n), ROWS)
    asks = texts.cogroup(by_bucket_of(shared)).applyInArrow(contexts(n, length, q), ROWS)
    found = by_bucket_of(asks).applyInArrow(covered(n, length, q), ROWS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.cogroup(by_bucket_of(found)).applyInArrow(finished(pa.int64(), with_text), schema).withColumnRenamed("doc_id", id_col)


#: DuckDB SQL for remove_repeats() over documents, which have no null or repeated ids there.
ORACLE = f"""
with d as (select doc_id, encode(coalesce(text, '')) as raw from documents),
w as (select doc_id, i, md5(raw[i:i + {LENGTH - 1}]) as s from d, unnest(range(1, octet_length(raw) - {LENGTH - 2})) as u(i)),
c as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from w) where least < doc_id),
r as (select doc_id, i, sum((i > coalesce(prev, -1) + {LENGTH})::integer) over (partition by doc_id order by i) as run from (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from c)),
g as (select doc_id, run, min(i) as low, max(i) + {LENGTH} as high from r group by 1, 2),
k as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 1) as back from g),
p as (select k.doc_id, count(*) as n_spans, sum(high - low) as n_removed, max(high) as last, string_agg(hex(raw[back:low - 1]), '' order by low) as kept from k join d on k.doc_id = d.doc_id group by k.doc_id)
select d.doc_id, octet_length(raw)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(case when n_spans is null then raw else unhex(kept || hex(raw[last:octet_length(raw)])) end) as kept_sha256
from d left join p on d.doc_id = p.doc_id
"""
