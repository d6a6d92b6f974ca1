"""Exact removal of repeated byte strings with per-shard suffix arrays.

Every byte covered by a string of `length` bytes that also starts earlier (smaller document id, or the
same document and an earlier start) is removed; strings are judged on the input.

1. Anchors. In any `length` consecutive bytes, the leftmost GRAM-byte gram with the smallest hash is the anchor. Equal
   strings choose equal anchors at equal places, so a string that repeats has an anchor that repeats. About one
   byte in 35 is one. An anchor's context is the bytes of all strings that choose it. Hashes only choose what is
   looked at and bring it together; they never decide that something repeats.
2. Shards of one task. In every `most` bytes of documents, what lies under anchors that occur there more than once is
   dealt to shards of at most shard_bytes. Each shard gets a suffix array by Larsson-Sadakane refinement (sorted by the first
   bytes, then the sorted depth is doubled within unresolved groups up to `length`); common prefixes, by Kasai's relation
   between neighbours in the text, tell groups of equal strings. Shards are merged in order of age: the sorted strings of a shard are
   found in those of all older ones by binary search, and what is new is merged into them at the place found. Starts that
   repeat are flagged; contexts that keep an unflagged start go on. So a hot passage costs one row per task's batch.
3. Shards across tasks. Contexts whose bytes are equal (by a 96-bit BLAKE2b digest) repeat the earliest of them in full. Anchors that still have
   several contexts have their bytes brought together, and suffix arrays and binary search decide as in 2.
   An anchor of more than hot_contexts contexts is not brought to one task: its strings are compared one by one, by their
   128-bit BLAKE2b digests, in an aggregate that is combined before its shuffle and a join that can be split.
4. Flagged starts come back to the documents as runs; the covered bytes are cut out.

Texts travel compressed, by document id, for step 3 (documents with such contexts alone) and step 4.

Defined cases: null and empty texts have no bytes; documents shorter than `length` lose nothing; a null id
counts as the smallest; repeated rows of an id are one after the other in the order of their bytes' SHA-256, rows equal in both as well, so the first
keeps its bytes and the others repeat it; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.llm.common import id_and_text, stash

GRAM = 32
#: Anchors are chosen in stretches of about so many bytes, which stay in a core's cache.
STRETCH = 1 << 18
#: A shard's suffixes are numbered in 21 bits, so that two ranks and a number are one 64-bit word to sort.
BITS = 21
LARGEST = (1 << BITS) - 2
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of every run of size bytes: runs are put together from two shorter ones, so the work grows with the log of the size."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * _MULT[0]
        h ^= h >> np.uint64(29)
        done = 1
        while done < size and len(h):
            shift = min(done, size - done)  # overlapping parts make sizes that are no power of two
            if shift >= len(h):
                return h[:0]
            h = h[:-shift] * _MULT[1] + h[shift:] * _MULT[2]
            h ^= h >> np.uint64(32)
            done += shift
        h *= _MULT[3]
        return h ^ (h >> np.uint64(31))


def sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of width elements."""
    done = 1
    while done < width:
        shift = min(done, width - done)
        h = pick(h[: len(h) - shift], h[shift:])
        done += shift
    return h


def contexts_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, anchor positions, first starts, last starts) of documents laid end to end; ends: where each one stops.

    A string's anchor is its leftmost gram of the smallest hash. Strings lie inside one document. The starts of an anchor are consecutive.
    """
    h = gram_hashes(data, GRAM)
    span = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(h) < span:
        return np.zeros(0, np.uint64), none, none, none
    low = sliding(h, span, np.minimum)  # by start: the smallest hash of its grams
    own = np.ones(len(low), bool)
    for k in ends[:-1].tolist():  # strings across the end of a document are none
        own[max(0, k - length + 1) : k] = False
    padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    lowest = sliding(padded, span, np.maximum) == h  # grams that are the smallest of some string
    at = np.flatnonzero(lowest)
    starts = np.flatnonzero(own)
    place = (np.cumsum(lowest) - lowest)[starts]  # the first of those grams at or after the start
    value, low = h[at], low[starts]
    rest = np.flatnonzero(value[place] != low)
    while len(rest):
        place[rest] += 1
        rest = rest[value[place[rest]] != low[rest]]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(starts) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    stop = np.concatenate((begin[1:], [len(starts)])) - 1 if len(begin) else begin
    return value[place[begin]], at[place[begin]], starts[begin], starts[stop]


def suffix_array(data: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first length bytes; those equal there in order of their place. Past its end the data counts as zeros.

    Larsson and Sadakane's refinement on unresolved groups alone: (rank, rank of the suffix `depth` further on, place) is one word, so
    a round is one sort of words.
    """
    n = len(data)
    if n > LARGEST:
        raise ValueError(f"a shard holds at most {LARGEST} bytes")
    if not n:
        return np.zeros(0, np.int64)
    u, bits, mask = np.uint64, np.uint64(BITS), np.uint64((1 << BITS) - 1)
    used = np.zeros(256, bool)
    used[data] = used[0] = True
    code = (np.cumsum(used) - 1).astype(np.uint64)
    width = max(1, int(used.sum() - 1).bit_length())
    depth = min(length, (64 - BITS) // width)
    wide = np.concatenate((code[data], np.zeros(depth, u)))
    packed = wide[:n].copy()
    for k in range(1, depth):
        packed <<= u(width)
        packed |= wide[k : k + n]
    del wide
    packed <<= bits
    packed |= np.arange(n, dtype=u)
    packed.sort()
    order = (packed & mask).astype(np.int64)
    packed >>= bits
    new = np.concatenate(([True], packed[1:] != packed[:-1]))
    rank = np.empty(n + 1, u)
    rank[n] = 0  # beyond the end; other ranks start at 1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(u) + u(1)
    while depth < length:
        step = min(depth, length - depth)
        size = np.diff(np.concatenate((np.flatnonzero(new), [n])))
        at = np.flatnonzero(np.repeat(size > 1, size))  # members of groups that still have equals
        if not len(at):
            break
        suffix = order[at]
        packed = (rank[suffix] << (bits + bits)) | (rank[np.minimum(suffix + step, n)] << bits) | suffix.astype(u)
        packed.sort()
        suffix = (packed & mask).astype(np.int64)
        packed >>= bits
        order[at] = suffix
        fresh = np.concatenate(([True], packed[1:] != packed[:-1]))
        new[at] = fresh
        rank[suffix] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))].astype(u) + u(1)
        depth += step
    return order


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data (which is padded) as one little-endian word; a view."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix in the array with the one before it, up to length; element 0 is 0.

    Kasai's relation in arrays: if a suffix and the next one in the text have neighbours in the array that follow each other in the
    text too, their common prefixes differ by exactly one (or the first bytes differ). So bytes are compared only where such a run
    ends, and the others count up from there, all runs at once.
    """
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(length + 16, np.uint8)))
    before = np.full(n, n, np.int64)  # by place: the suffix before it in the array; the first has none
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    differs = padded[place] != padded[before]
    differs[order[0]] = True
    ends = np.concatenate((before[1:] != before[:-1] + 1, [True])) | differs
    at = np.flatnonzero(ends & ~differs)
    value = np.zeros(n, np.int64)
    word = words_at(padded)
    live = at
    for k in range(0, length, 8):
        d = word[live + k] ^ word[before[live] + k]
        same = d == 0
        value[live] += np.where(same, 8, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) // 8)
        live = live[same]
        if not len(live):
            break
    stop = np.minimum.accumulate(np.where(ends, place, n)[::-1])[::-1]
    lcp = np.minimum(value[stop] + stop - place, length)
    lcp = np.minimum(lcp, n - np.maximum(place, before))  # never past the end of the data
    lcp[order[0]] = 0
    return np.maximum(lcp, 0)[order]


def search_strings(needles: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the strings at needles among those at starts (sorted, distinct), all places in data, which is padded by eight bytes: (index of the first not smaller, whether that is equal)."""
    word = words_at(data)

    def words(at: np.ndarray, k: int) -> np.ndarray:
        w = word[at + k].byteswap()
        return w if k + 8 <= length else w >> np.uint64(8 * (k + 8 - length))

    first, mine = words(starts, 0), words(needles, 0)
    low, high = np.searchsorted(first, mine, "left"), np.searchsorted(first, mine, "right")
    found = np.zeros(len(needles), bool)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        side = np.zeros(len(live), np.int8)
        rest = np.arange(len(live))
        for k in range(8, length, 8):
            x, y = words(needles[live[rest]], k), words(starts[mid[rest]], k)
            side[rest] = np.where(x < y, -1, x > y)
            rest = rest[x == y]
            if not len(rest):
                break
        equal, less, more = side == 0, side < 0, side > 0
        low[live[equal]] = mid[equal]
        found[live[equal]] = True
        high[live[less]] = mid[less]
        low[live[more]] = mid[more] + 1
        live = live[~equal]
        live = live[low[live] < high[live]]
    return low, found


def repeated_runs(pieces: list[bytes], length: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pieces: bytes in order of age, each at least length long. (piece, first start, last start) of the runs of strings of length bytes that also start earlier, in the same piece or an older one."""
    offset = np.cumsum([0, *map(len, pieces)])
    total = int(offset[-1])
    data = np.frombuffer(b"".join(pieces) + bytes(length + 16), np.uint8)
    tail = np.zeros(total + 1, np.int8)  # strings don't run over the end of a piece
    tail[offset[1:] - length + 1] = 1
    tail[offset[1:]] -= 1
    starts = np.cumsum(tail[:-1], dtype=np.int8) == 0
    repeated = starts.copy()
    merged = np.zeros(0, np.int64)  # places of the distinct strings so far, sorted by string
    k = 0
    while k < len(pieces):
        e = max(k + 1, int(np.searchsorted(offset, offset[k] + shard_bytes, "right")) - 1)
        a, b = int(offset[k]), int(offset[e])
        shard = data[a : b + length]
        order = suffix_array(shard, length)
        group = np.cumsum(common_prefixes(shard, order, length) < length)
        listed = np.concatenate((starts[a:b], np.zeros(length, bool)))[order]
        order, group = order[listed], group[listed]
        # Equal strings stand in order of their place, so the first of a group is the oldest; it stays.
        own = order[np.concatenate(([True], group[1:] != group[:-1]))] + a
        repeated[own] = False
        if len(merged):
            low, found = search_strings(own, data, merged, length)
            repeated[own[found]] = True
            merged = np.insert(merged, low[~found], own[~found])
        else:
            merged = own
        k = e
    edge = np.diff(np.concatenate(([0], repeated.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    piece = np.searchsorted(offset, first, "right") - 1
    return piece, first - offset[piece], last - offset[piece]


def cut_pieces(first: int, last: int, length: int, shard_bytes: int) -> list[tuple[int, int]]:
    """A range of starts as ranges whose strings' bytes fit a shard."""
    step = shard_bytes - length
    return [(a, min(last, a + step - 1)) for a in range(first, last + 1, step)]


def merged_runs(rid: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts [a, b], per row id: those that touch or overlap become one."""
    if not len(rid):
        return rid, a, b
    order = np.lexsort((a, rid))
    rid, a, b = rid[order], a[order], b[order]
    # Ends so far within a row id: row ids are told apart by rank, so that a running maximum never crosses them.
    rank = np.cumsum(np.concatenate(([0], (rid[1:] != rid[:-1]).astype(np.int64))))
    wide = int(b.max()) + 2
    reach = np.maximum.accumulate(b + rank * wide) - rank * wide
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (a[1:] > reach[:-1] + 1)))
    first = np.flatnonzero(new)
    return rid[first], a[first], reach[np.concatenate((first[1:], [len(a)])) - 1]


#: A context with an unflagged start (anchor hash, 96 bits of the digest of its bytes, row id, packed range of starts), or a run of flagged starts.
ROWS = "h long, c long, e int, rid long, at long, kind int"
OCCURRENCE, FLAG = 0, 1
#: Bits of a packed range that hold its length.
WIDE = 24


def pack_range(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << WIDE) | (last - first)


def unpack_range(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> WIDE, (at >> WIDE) + (at & ((1 << WIDE) - 1))


def _frame(h, c, e, rid, at, kind):
    import pyarrow as pa

    columns = [pa.array(np.asarray(x).astype(t)) for x, t in ((h, np.int64), (c, np.int64), (e, np.int32), (rid, np.int64), (at, np.int64), (kind, np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["h", "c", "e", "rid", "at", "kind"])


def _flags(rid: np.ndarray, first: np.ndarray, last: np.ndarray):
    """FLAG rows of ranges of starts; h spreads them evenly. Runs of more starts than a packed range holds go in pieces."""
    rid, first, last = merged_runs(rid, first, last)
    most = (1 << WIDE) - 1
    while len(rid):
        upto = np.minimum(last, first + most)
        with np.errstate(over="ignore"):
            spread = (rid.astype(np.uint64) * _MULT[0] + first.astype(np.uint64) * _MULT[1]).view(np.int64)
        yield _frame(spread, np.zeros(len(rid)), np.zeros(len(rid)), rid, pack_range(first, upto), np.full(len(rid), FLAG))
        more = last > upto
        rid, first, last = rid[more], upto[more] + 1, last[more]


class _Batch:
    """Documents of one task's batch, laid end to end, with their contexts."""

    def __init__(self, length: int, shard_bytes: int):
        self.length, self.shard_bytes = length, shard_bytes
        self.docs: list[tuple[int, bytes]] = []
        self.size = 0

    def add(self, rid: int, data: bytes) -> None:
        if len(data) >= self.length:
            self.docs.append((rid, data))
            self.size += len(data)

    def contexts(self):
        """(document index, anchor hash, first start, last start) of all contexts, in order. Long documents are looked at in stretches that overlap."""
        out, held, size = [], [], 0

        def look():
            begins = np.cumsum([0, *(b - a for _, a, b in held)])
            data = np.frombuffer(b"".join(self.docs[d][1][a:b] for d, a, b in held), np.uint8)
            h, _, first, last = contexts_of(data, begins[1:], self.length)
            which = np.searchsorted(begins, first, "right") - 1
            shift = np.array([a for _, a, _ in held], np.int64)[which] - begins[which]
            out.append((np.array([d for d, _, _ in held], np.int64)[which], h, first + shift, last + shift))

        for d, (_, data) in enumerate(self.docs):
            for a, b in cut_pieces(0, len(data) - self.length, self.length, STRETCH):
                if held and size + b + self.length - a > STRETCH:
                    look()
                    held, size = [], 0
                held.append((d, a, b + self.length))
                size += b + self.length - a
        if held:
            look()
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def rows(self):
        """Flags of what repeats inside the batch, and the contexts that keep a start."""
        if not self.docs:
            return
        self.docs.sort(key=lambda x: x[0])
        length = self.length
        doc, h, first, last = self.contexts()
        rid = np.array([r for r, _ in self.docs], np.int64)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[inverse] > 1)
        keep = np.ones(len(h), bool)
        if len(again):
            d, a, b = merged_runs(doc[again], first[again], last[again])
            cut = [(int(x), *p) for x, y, z in zip(d, a, b, strict=True) for p in cut_pieces(int(y), int(z), length, self.shard_bytes)]
            piece, a, b = repeated_runs([self.docs[x][1][y : z + length] for x, y, z in cut], length, self.shard_bytes)
            if len(piece):
                of, base = (np.array(c, np.int64) for c in list(zip(*cut, strict=True))[:2])
                d, a, b = merged_runs(of[piece], a + base[piece], b + base[piece])
                yield from _flags(rid[d], a, b)
                # A context is done with if one run of flagged starts holds all of its own.
                wide = int(max(last.max(), b.max())) + 2
                at = np.searchsorted(d * wide + a, doc * wide + first, "right") - 1
                keep = ~((at >= 0) & (d[at] == doc) & (last <= b[at]))
        doc, h, first, last = doc[keep], h[keep], first[keep], last[keep]
        digest = hashlib.blake2b
        views = [memoryview(x) for _, x in self.docs]
        marks = b"".join([digest(views[d][a : b + length], digest_size=12).digest() for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True)])
        marks = np.frombuffer(marks, np.dtype([("c", "<i8"), ("e", "<i4")]))
        yield _frame(h.view(np.int64), marks["c"], marks["e"], rid[doc], pack_range(first, last), np.zeros(len(h)))


def _find(length: int, shard_bytes: int, most: int = 6_000_000):
    """Texts -> flags of what repeats within about most bytes of them, and the contexts that go on."""

    def each(batches):
        held = _Batch(length, shard_bytes)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, r in enumerate(ids):
                held.add(r, (texts[i].as_py() or "").encode())
                if held.size >= most:
                    yield from held.rows()
                    held = _Batch(length, shard_bytes)
        yield from held.rows()

    return each


def _cut(length: int, each_start: bool):
    """Documents with wanted ranges -> the bytes of each range's strings, or the digest of every string by itself."""

    def each(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for rid, blob, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = unpack.decompress(blob.as_py(), max_output_size=1 << 31)
                hs, ats = wanted.values.field(0).to_numpy(), wanted.values.field(1).to_numpy()
                a, b = unpack_range(ats)
                if each_start:
                    at = np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)])
                    hs, ats = np.zeros(len(at), np.int64), pack_range(at, at)
                    out[3].extend(hashlib.blake2b(data[x : x + length], digest_size=16).digest() for x in at.tolist())
                else:
                    out[3].extend(data[x : y + length] for x, y in zip(a.tolist(), b.tolist(), strict=True))
                out[0].extend(hs.tolist())
                out[1].extend([rid] * len(hs))
                out[2].extend(ats.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["h", "rid", "at", "bytes"])

    return each


def _resolve(length: int, shard_bytes: int, group_bytes: int):
    """Contexts sorted by (h, rid, at) -> flags of the starts whose string is older elsewhere. Whole anchors are gathered up to group_bytes; repeated_runs divides what is more than shard_bytes."""

    def flags(parts):
        rid, at = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in ("rid", "at"))
        pieces = [x for p in parts for x in p.column("bytes").to_pylist()]
        order = np.lexsort((at, rid))
        piece, a, b = repeated_runs([pieces[k] for k in order.tolist()], length, shard_bytes)
        if len(piece):
            which = order[piece]
            base = unpack_range(at[which])[0]
            yield from _flags(rid[which], base + a, base + b)

    def each(batches):
        parts, size = [], 0
        for batch in batches:
            h = batch.column("h").to_numpy()
            ends = np.concatenate((np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)])) if len(h) else np.zeros(0, np.int64)
            bytes_to = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())
            done = 0
            if parts and len(h) and size >= group_bytes and parts[-1].column("h")[-1].as_py() != h[0]:
                yield from flags(parts)
                parts, size = [], 0
            for k in ends.tolist():  # where an anchor ends
                if k < len(h) and size + bytes_to[k - 1] - (bytes_to[done - 1] if done else 0) >= group_bytes:
                    yield from flags([*parts, batch.slice(done, k - done)])
                    parts, size, done = [], 0, k
            if done < len(h):
                parts.append(batch.slice(done))
                size += int(bytes_to[-1] - (bytes_to[done - 1] if done else 0))
        if parts:
            yield from flags(parts)

    return each


def _remove(length: int):
    """Documents with runs of repeated starts -> their counts and the digest of what is kept."""

    def each(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, blob, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = unpack.decompress(blob.as_py(), max_output_size=1 << 31)
                n_removed, spans, kept = 0, [], data
                if runs.is_valid and len(runs.values):
                    a, b = unpack_range(runs.values.to_numpy())
                    _, a, b = merged_runs(np.zeros(len(a), np.int64), a, b + length - 1)
                    spans = list(zip(a.tolist(), (b + 1).tolist(), strict=True))
                    n_removed = int((b + 1 - a).sum())
                    edges = [0, *(x for s in spans for x in s), len(data)]
                    kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((doc, len(data), n_removed, len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in spans]))
            kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
            yield pa.RecordBatch.from_pydict({n: [o[k] for o in out] for k, n in enumerate(kind.names)}, schema=kind)

    return each


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"


def _packed(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, text) -> (rid, doc_id, blob): texts as zstandard frames, so that shuffles move a third."""

    def each(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [packer.compress((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["rid", "doc_id", "blob"])

    return rows.select("rid", "doc_id", "text").mapInArrow(each, "rid long, doc_id long, blob binary")


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, text) with a unique row id in the documents' order: the id itself, or where ids repeat or are null the place after a sort by (id, SHA-256 of the text)."""
    rows = id_and_text(docs, doc_id, text)
    if rows.where("doc_id is null").isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    rows = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy(F.asc_nulls_first("doc_id"), "sha")
    return stash(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "ordered")


def remove_repeats(
    docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 1_000_000, group_bytes: int = 2_000_000, batch_bytes: int = 6_000_000, hot_contexts: int = 2048
) -> DataFrame:
    """One row per document: its bytes, removed bytes and spans, and the SHA-256 of what is kept. length must be over GRAM; a shard must hold several strings and at most LARGEST bytes with its padding."""
    if not (GRAM < length and 2 * length < shard_bytes <= LARGEST - length):
        raise ValueError(f"length must lie above {GRAM} and shard_bytes between 2 * length and {LARGEST} - length")
    rows = in_order(docs, doc_id, text)
    found = rows.select("rid", "text").mapInArrow(_find(length, shard_bytes, batch_bytes), ROWS)
    older = F.row_number().over(W.partitionBy("h", "c", "e").orderBy("rid", "at")) > 1
    compared = stash(found.select("h", "rid", "at", F.when((F.col("kind") == FLAG) | older, FLAG).otherwise(OCCURRENCE).alias("kind")), "compared")
    firsts = compared.where(F.col("kind") == OCCURRENCE).select("h", "rid", "at")
    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = stash(firsts.join(several, "h").select("h", "rid", "at", (F.col("n") > hot_contexts).alias("hot")), "wanted")

    def cut(part: DataFrame, each_start: bool) -> DataFrame:
        of_doc = part.groupBy("rid").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))  # a document's own anchors
        return _packed(rows).join(of_doc, "rid").select("rid", "blob", "wanted").mapInArrow(_cut(length, each_start), "h long, rid long, at long, bytes binary")

    contexts = cut(wanted.where("not hot"), False)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resolved = contexts.repartition(n, "h").sortWithinPartitions("h", "rid", "at").mapInArrow(_resolve(length, shard_bytes, group_bytes), ROWS)
    flags = compared.where(F.col("kind") == FLAG).select("rid", "at").unionByName(resolved.select("rid", "at"))
    hot = wanted.where("hot")
    if not hot.isEmpty():
        strings = stash(cut(hot, True).select("rid", "at", F.col("bytes").alias("s")), "hot-strings")
        least = strings.groupBy("s").agg(F.min(F.struct("rid", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        again = strings.join(least, "s").where(F.struct("rid", "at") > F.col("first"))
        flags = flags.unionByName(again.select("rid", "at"))
    runs = flags.groupBy("rid").agg(F.collect_list("at").alias("runs"))
    return _packed(rows).join(runs, "rid", "left").select("doc_id", "blob", "runs").mapInArrow(_remove(length), RESULT)
