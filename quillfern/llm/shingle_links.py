"""Near-duplicates by the Jaccard similarity of shingle sets: links at `least` or more, found by SimHash fingerprints and vantage-point trees and decided on the sets themselves.

Texts are lower-cased words in shingles of `size`; texts of equal sets form a class, so exact copies are merged by an
aggregate. A class has a SimHash fingerprint of 1,536 bits, a majority of its shingles' hashes each, in 12 blocks of 128. Sets at
similarity 0.8 differ in some 15 % of the bits (up to 16 % in sets of five shingles or more, 19 % in sets of four and five), others in half of them.

A tree of that radius divides nothing, so every 16 bits have a vantage-point tree of their own (simhash.fit_tree) with a search radius
of 1: ends of a link always meet in a leaf of a tree in whose 16 bits they differ in one bit at most. Trees are fitted on a bounded
sample; all classes are dealt to leaves. A leaf is a shard: its values of 16 bits are divided further in memory, and members of
near values are candidates if at most `BLOCK_BITS` of the whole block's 128 bits differ. A pair at similarity 0.8 is found in none of the 96 trees with
probability 4e-13 by the block hits measured on random sets (1e-7 for sets of four and five shingles). Candidates are decided by exact set sizes.

Shards return forests of their candidates (each member with the least one of its group), so their rows grow with members, not with pairs. What
candidates connect is a family. A family of more than `block` members (or of very long texts) is dealt to parts. In each part all pairs that fingerprints and set sizes
leave open are decided, those with some members common to all parts, too; a smaller family is done with that. In a large one, members outside its largest component
are then compared with all others: first by the whole fingerprint, which narrows the families to what is open between different components,
then by the sets. No pairs are joined; texts go to the parts that compare them, and tasks return spanning forests. Only members outside the largest
component of a family, not its whole size, multiply what is dealt.

Defined cases: null, empty and blank texts have the empty set, equal to each other and to nothing else; a text of fewer
words than `size` is one shingle; rows without an id take no part.
"""

from __future__ import annotations

import contextlib
import ctypes
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfern.llm.common import drop_stash, id_and_text, stash, text_slices
from quillfern.llm.components import connected_components
from quillfern.llm.simhash import _merge, best_split, fit_tree, route

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LEAST = Fraction(4, 5)
WORDS = 24
TREES = 4 * WORDS
LOW16 = 0xFFFF
#: Bits of a block of 128, and of a fingerprint, that may differ in a candidate: six standard deviations over the mean for the whole fingerprint.
BLOCK_BITS = 30
ALL_BITS, ALL_BITS_OF_SMALL, SMALL = 333, 380, 5
#: Members of a large family that all its parts are compared with, on average; shingles of a part; parts in one where only fingerprints are compared.
PIVOTS, PART_SHINGLES, SIG_BLOCKS = 16, 1_000_000, 8
FACTORS = np.random.default_rng(11).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))], np.uint64))


def set_key(hashes: np.ndarray) -> int:
    """One 64-bit name of a shingle set, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The 1,536 bits of a shingle set: a bit is set if it is set in over half of the shingles' mixed hashes."""
    count = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 4096):
        x = hashes[i : i + 4096, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        planes = [x]  # plane k holds bit k of sums of rows
        while len(planes[0]) > 24:
            half = (len(planes[0]) + 1) // 2
            carry, out = None, []
            for p in planes:
                a, b = p[:half].copy(), p[half:]
                both = a[: len(b)] & b
                a[: len(b)] ^= b
                if carry is not None:
                    both = np.concatenate((both, np.zeros((half - len(b), WORDS), np.uint64))) if len(b) < half else both
                    both |= a & carry
                    a ^= carry
                elif len(b) < half:
                    both = np.concatenate((both, np.zeros((half - len(b), WORDS), np.uint64)))
                out.append(a)
                carry = both
            planes = [*out, carry]
        for k, p in enumerate(planes):
            count += np.unpackbits(p.view(np.uint8), axis=1).sum(0, dtype=np.int64) << k
    return np.packbits(2 * count > len(hashes)).view(np.uint64)


def near_values(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i <= j, of all distinct 16-bit values that differ in one bit at most, by vantage points."""
    rng = np.random.default_rng(7)
    found, todo = [], [np.arange(len(values))]
    while todo:
        at = todo.pop()
        split = best_split(values[at], LOW16, 1, rng) if len(at) > block else None
        if split is not None:
            _, mu, d = split
            todo += [at[d <= mu + 1], at[d > mu]]
            continue
        step = max(1, 500_000 // max(1, len(at)))
        for k in range(0, len(at), step):
            i, j = np.nonzero(np.bitwise_count(values[at[k : k + step]][:, None] ^ values[at][None, :]) <= 1)
            i, j = at[i + k], at[j]
            found.append((i << 17 | j)[i <= j])
    found = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return found >> 17, found & 0x1FFFF


def close_members(words: np.ndarray, column: int, shift: int, block: int, label: np.ndarray | None = None):
    """(i, j), i < j, of all rows of two words whose 16 bits differ in one bit at most and whose 128 bits in BLOCK_BITS at most; in several arrays.

    With labels of what is already connected (roots, which the caller may merge meanwhile), only enough of them to connect what all would connect:
    first each row with the first one of every near value, then pieces that are not of one label."""
    chunk = (words[:, column] >> np.uint64(shift)) & np.uint64(LOW16)
    order = np.argsort(chunk, kind="stable")
    values, start, size = np.unique(chunk[order], return_index=True, return_counts=True)
    a, b = near_values(values, max(block, 2))

    def near(i, j):
        close = (np.bitwise_count(words[i] ^ words[j]).sum(1) <= BLOCK_BITS) & (i != j)
        i, j = i[close], j[close]
        return np.minimum(i, j), np.maximum(i, j)

    if label is not None:
        for v, w in ((a, b), (b, a)):
            total, lo = np.cumsum(size[v]), 0
            while lo < len(v):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 250_000, "right")))
                m = size[v[lo:hi]]
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield near(order[np.repeat(start[v[lo:hi]], m) + k], order[np.repeat(start[w[lo:hi]], m)])
                lo = hi
        order = np.lexsort((label, chunk))
    # Members of a value in pieces of at most `block`, so that pairs of pieces have a bound.
    pieces = -(-size // block)
    n = pieces[a] * pieces[b]
    which = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    p, q = k // pieces[b][which], k % pieces[b][which]
    from_a, from_b = start[a][which] + p * block, start[b][which] + q * block
    len_a = np.minimum(block, size[a][which] - p * block)
    len_b = np.minimum(block, size[b][which] - q * block)
    if label is not None and len(which):
        ranked = label[order]
        open_ = (ranked[from_a] != ranked[from_a + len_a - 1]) | (ranked[from_b] != ranked[from_b + len_b - 1]) | (ranked[from_a] != ranked[from_b])
        which, from_a, from_b, len_a, len_b = (x[open_] for x in (which, from_a, from_b, len_a, len_b))
    total = np.cumsum(len_a * len_b)
    lo = 0
    while lo < len(which):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + 250_000, "right")))
        m = (len_a * len_b)[lo:hi]
        r = np.repeat(np.arange(lo, hi), m)
        k = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
        yield near(order[from_a[r] + k // len_b[r]], order[from_b[r] + k % len_b[r]])
        lo = hi


def similar(a: int, b: int, common: int, least: Fraction) -> bool:
    return common * least.denominator >= least.numerator * (a + b - common)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: idle workers stay, beside those of the next step."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def possible(rows: DataFrame, members: DataFrame, name: str, most_bits: int = 26) -> DataFrame:
    """The rows whose value of a column may be among the members', by a bitmap of its hashes (8 MB at most): all that are, and some others."""
    bits = min(most_bits, max(16, (8 * members.count()).bit_length()))
    place = F.xxhash64(name, F.lit(3)).bitwiseAND((1 << bits) - 1)

    def mark(table):
        import pyarrow as pa

        own = np.zeros(1 << 16, bool)
        own[table["place"].to_numpy() & 0xFFFF] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bitmap = np.zeros((1 << bits - 16, 1 << 13), np.uint8)
    places = members.select(place.alias("place")).distinct().withColumn("part", F.shiftright("place", 16))
    for r in places.groupBy("part").applyInArrow(mark, "part long, bits binary").collect():
        bitmap[r.part] = np.frombuffer(r.bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))

    return rows.withColumn("place", place).mapInArrow(keep, rows.schema)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: Fraction = LEAST, block: int = 256, shard_rows: int = 131072, sample_cap: int = 16384) -> DataFrame:
    """first_id, component_id of every class of equal shingle sets: its smallest id and the smallest that links reach from it. least: 0.8 or more, else candidates are missing."""
    if least < LEAST:
        raise ValueError("fingerprints find links at similarity 0.8 or more")
    rows = id_and_text(docs, doc_id, text).where("doc_id is not null")

    def sign(batches):
        import pyarrow as pa

        for ids, texts in text_slices(batches, 1_000_000):
            keys, sizes, sigs = [], [], []
            for t in texts:
                s = shingle_hashes(t, size)
                keys.append(set_key(s))
                sizes.append(len(s))
                sigs.append(fingerprint(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n", "sig"])
        give_back()

    signed = rows.mapInArrow(sign, "doc_id long, key long, n long, sig binary")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    worded = classes.where("n > 0")
    count = worded.count()
    cut = int(min(1.0, 1.2 * sample_cap / max(1, count)) * (1 << 62))
    sample = [r[0] for r in worded.where(F.shiftrightunsigned(F.xxhash64("key", F.lit(1)), 2) <= cut).select("sig").limit(sample_cap).collect()]
    sample = np.frombuffer(b"".join(map(bytes, sample)), np.uint64).reshape(-1, WORDS)
    leaf = max(4, int(shard_rows * len(sample) / max(1, count)))
    trees = classes.sparkSession.sparkContext.broadcast([fit_tree(sample[:, t // 4], LOW16 << 16 * (t % 4), 1, leaf) for t in range(TREES)])

    def deal(batches):
        """A row per shard and batch, with the lower halves of the members' numbers and their blocks of 128 bits."""
        import pyarrow as pa

        for batch in batches:
            node = batch.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
            for high in np.unique(node >> 32).tolist():
                own = node >> 32 == high
                low, words = (node[own] & 0xFFFFFFFF).astype(np.uint32), sigs[own]
                for t in range(TREES):
                    leaves, at = route(words[:, t // 4], trees.value[t], LOW16 << 16 * (t % 4), 1)
                    order = np.argsort(leaves, kind="stable")
                    shards, start = np.unique(leaves[order], return_index=True)
                    parts = np.split(at[order], start[1:])
                    pair = words[:, t // 8 * 2 : t // 8 * 2 + 2]
                    out = pa.array(shards * TREES + t, pa.int32()), pa.array([high] * len(parts), pa.int64()), pa.array([low[p].tobytes() for p in parts], pa.binary()), pa.array([pair[p].tobytes() for p in parts], pa.binary())
                    yield pa.RecordBatch.from_arrays(list(out), ["shard", "high", "low", "words"])
        give_back()

    def pairs_table(a, b):
        import pyarrow as pa

        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def connect(table):
        """Each member with the least one that candidates of this shard reach from it."""
        low = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
        node = np.concatenate([(h << 32) + x.astype(np.int64) for h, x in zip(table["high"].to_pylist(), low, strict=True)])
        words = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64).reshape(-1, 2)
        order = np.argsort(node)
        node, words = node[order], words[order]
        t = table["shard"][0].as_py() % TREES
        label = np.arange(len(node))
        for i, j in close_members(words, t // 4 % 2, 16 * (t % 4), block, label):
            _merge(label, i, j)
        give_back()
        k = np.flatnonzero(label < np.arange(len(node)))
        return pairs_table(node[label[k]], node[k])

    def compare(table):
        """A spanning forest of the links between different labels: of all members, or of those asked for with the others. Without texts, of the pairs that fingerprints and set sizes leave open."""
        key, label, n, asked = (table[c].to_numpy() for c in ("key", "label", "n", "asked"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint64).reshape(-1, WORDS)
        texts, sets = table["text"] if "text" in table.column_names else None, {}
        root = np.unique(label, return_inverse=True)[1]
        out = [], []

        def members(i):
            if i not in sets:
                s = shingle_hashes(texts[i].as_py() or "", size)
                sets[i] = s if set_key(s) == key[i] else None  # a repeated id has other texts, too
            return sets[i]

        def link(i, x):
            return texts is None or members(i) is not None and members(x) is not None and similar(int(n[i]), int(n[x]), len(np.intersect1d(members(i), members(x), assume_unique=True)), least)

        for i in np.flatnonzero(asked != 0).tolist():
            # asked: 2 for each pair once, 1 for pairs with all of 0.
            j = np.flatnonzero((root != root[i]) & ((np.arange(len(key)) > i) if asked[i] == 2 else asked == 0))
            least_n, most_n = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            j = j[least_n * least.denominator >= most_n * least.numerator]
            apart = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64)
            nearest = np.argsort(apart, kind="stable")
            j, apart = j[nearest], apart[nearest]
            for x in j[apart <= np.where(np.minimum(n[i], n[j]) < SMALL, ALL_BITS_OF_SMALL, ALL_BITS)].tolist():
                if root[x] != root[i] and link(i, x):
                    out[0].append(label[i])
                    out[1].append(label[x])
                    root[root == root[x]] = root[i]
        if len(key) > block // 2:
            give_back()
        return pairs_table(*out)

    def parts_of(members: DataFrame, most: int, shingles: int) -> DataFrame:
        """Per family the number of members and of the parts that they are dealt to, of `most` members and so many shingles on average at most."""
        return members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / shingles)).cast("int").alias("parts"))

    def part_of(parts: str):
        return F.pmod(F.xxhash64("node", F.lit(5)), F.col(parts)).cast("int")

    def crossed(labelled: DataFrame, most: int, shingles: int) -> DataFrame:
        """Members outside their family's largest label are asked for with all members: every pair of different labels meets in a group (family, p, q)."""
        sizes = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("largest"))
        rest = labelled.join(sizes, "family").where("label <> largest").select(*labelled.columns)
        blocks = parts_of(labelled, most, shingles).select("family", "parts").join(parts_of(rest, most, shingles).select("family", F.col("parts").alias("blocks")), "family")
        others = labelled.join(blocks, "family").select("*", part_of("parts").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), F.lit(0).alias("asked"))
        asked = rest.join(blocks, "family").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), part_of("blocks").alias("q"), F.lit(1).alias("asked"))
        return others.unionByName(asked).select("family", "p", "q", "node", "label", "asked")

    def compared(members: DataFrame, whole: bool = True) -> DataFrame:
        """members has family, p, q, node, label, asked; texts are found by their classes' smallest ids."""
        described = classes.select("node", "key", "first_id", "n", "sig").join(members, "node")
        if whole:
            described = described.join(texts, "first_id")
        return described.groupBy("family", "p", "q").applyInArrow(compare, "a long, b long")

    dealt = worded.select("node", "sig").mapInArrow(deal, "shard int, high long, low binary, words binary")
    heads = stash(dealt.groupBy("shard").applyInArrow(connect, "a long, b long").distinct(), "shingle-heads")
    families = connected_components(heads).withColumnRenamed("component", "family")
    members = stash(families.join(classes.select("node", "n", "first_id"), "node"), "shingle-members")
    # What no member can name is left where it is: only members' texts are dealt.
    texts = rows.select(F.col("doc_id").alias("first_id"), "text")
    texts = stash(possible(texts, members, "first_id").join(members.select("first_id").distinct(), "first_id", "left_semi"), "shingle-texts")
    large = stash(parts_of(members, block, PART_SHINGLES).where("parts > 1"), "shingle-large")
    part = members.join(F.broadcast(large), "family", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    pivot = F.coalesce(F.pmod(F.xxhash64("node", F.lit(9)), F.col("members")) < PIVOTS, F.lit(False)) & (F.col("parts") > 1)
    part = part.withColumn("p", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part_of("parts")))))
    first = stash(compared(part.select("family", "p", F.lit(0).alias("q"), "node", F.col("node").alias("label"), F.lit(2).alias("asked"))), "shingle-links")
    labels = connected_components(first).withColumnRenamed("component", "label")
    named = classes.select("node", "first_id").join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    used = [classes, heads, members, texts, large, first]
    if not large.isEmpty():
        labelled = stash(members.drop("first_id").join(F.broadcast(large.select("family")), "family").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "shingle-labelled")
        open_ = stash(compared(crossed(labelled, SIG_BLOCKS * block, SIG_BLOCKS * PART_SHINGLES), whole=False), "shingle-open")
        narrow = connected_components(open_).select(F.col("node").alias("label"), F.col("component").alias("family"))
        narrowed = stash(labelled.drop("family").join(narrow, "label"), "shingle-narrowed")
        second = stash(compared(crossed(narrowed, block, PART_SHINGLES)), "shingle-more")
        top = connected_components(second).select(F.col("node").alias("component"), F.col("component").alias("top"))
        named = named.join(top, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
        used += [labelled, open_, narrowed, second]
    named = stash(named, "shingle-named")
    drop_stash(*used)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(smallest, "component").select("first_id", "component_id")
