"""Near-duplicates by 64-bit SimHash fingerprints and vantage-point trees.

Fingerprints: words of the lower-cased text in shingles of three; a bit is set if it is set in over half
of the shingles' XXH64 hashes. Documents of one fingerprint form a class, so exact and most near
copies are merged by an aggregate before any pair is looked for.

Links: two fingerprints link at 3 or fewer differing bits. Then one of their two 32-bit halves differs
in at most one bit, so two vantage-point trees are used, one on each half's Hamming distance, with a
search radius of 1. A tree is fitted on a bounded sample (sample_cap fingerprints) and broadcast (its
size is bounded by that cap). A fingerprint x goes to the near side of a node if d(x, vantage) <= mu, else to
the far side; one within mu + 1 goes to both. By the triangle inequality both ends of a link always
meet in some leaf: if x is near and y is far, then d(y) <= d(x) + 1 <= mu + 1. Nothing else needs to
be searched, however deep the tree; fewer fingerprints lie on boundaries than with radius 3 on all bits.

A leaf is one shard. Inside it the same division goes on in memory to small blocks, whose fingerprints
are compared exactly. A shard returns a spanning forest of its links, never all pairs of a group;
components of the forests' union are those of all links.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of one or two
words are one shingle; repeated rows each get a row; a null id takes no part in component_id's minimum,
and a class of null ids alone has a null component; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.llm.common import drop_stash, free_name, id_and_text, stash, text_slices
from quillfern.llm.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)
ALL = 0xFFFFFFFFFFFFFFFF
RADIUS = 3


def fingerprint(text: str, size: int = 3) -> int:
    """The SimHash of a text, unsigned."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(b" ".join(words), 42)
    line = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))
    hashes = np.array([h(line[a:b], 42) for a, b in zip(start[: 1 - size].tolist(), stop[size - 1 :].tolist(), strict=True)], ">u8")
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""

    def each(batches):
        import pyarrow as pa

        for ids, texts in text_slices(batches):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return id_and_text(docs, doc_id, text).mapInArrow(each, "doc_id long, fp long")


def distance(x: np.ndarray, y, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ y) & np.uint64(mask))


def best_split(x: np.ndarray, mask: int, radius: int, rng: np.random.Generator, tries: int = 4):
    """The vantage point and mu with the least expected work, or None where no split saves any: (vantage, mu, distances)."""
    n = len(x)
    best = (0.97 * n**1.5, None)
    sample = x if n <= 4096 else x[rng.integers(0, n, 4096)]
    for p in sample[rng.integers(0, len(sample), tries)]:
        upto = np.cumsum(np.bincount(distance(sample, p, mask), minlength=65)) * (n / len(sample))
        near = np.concatenate((upto[radius:], np.full(radius, upto[-1])))  # those within mu + radius
        cost = near**1.5 + (n - upto) ** 1.5
        cost[upto >= n] = np.inf
        mu = int(np.argmin(cost))
        if cost[mu] < best[0]:
            best = (cost[mu], (p, mu))
    if best[1] is None:
        return None
    d = distance(x, best[1][0], mask)
    return (*best[1], d) if (d <= best[1][1]).any() and (d > best[1][1]).any() else None


def fit_tree(sample: np.ndarray, mask: int, radius: int, leaf: int) -> dict[str, np.ndarray]:
    """A tree of vantage points: node k has near[k] and far[k], leaves are -1 - number."""
    rng = np.random.default_rng(mask % 1_000_003)
    nodes: list[list] = []
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        split = best_split(x, mask, radius, rng) if len(x) > leaf else None
        if split is None:
            leaves += 1
            return -leaves
        p, mu, d = split
        nodes.append([p, mu, 0, 0])
        k = len(nodes) - 1
        nodes[k][2] = grow(x[d <= mu])  # boundary copies are left out here: the sample measures mass alone
        nodes[k][3] = grow(x[d > mu])
        return k

    root = grow(np.unique(sample))
    cols = list(zip(*nodes, strict=True)) if nodes else [(), (), (), ()]
    return {"p": np.array(cols[0], np.uint64), "mu": np.array(cols[1], np.int64), "near": np.array(cols[2], np.int64), "far": np.array(cols[3], np.int64), "root": np.array([root])}


def route(x: np.ndarray, tree: dict[str, np.ndarray], mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf number, index into x) for every leaf that a fingerprint must be in."""
    out, todo = [], [(int(tree["root"][0]), np.arange(len(x)))]
    while todo:
        k, at = todo.pop()
        if k < 0:
            out.append((np.full(len(at), -k), at))
            continue
        d = distance(x[at], tree["p"][k], mask).astype(np.int64)
        for side, keep in ((tree["near"][k], d <= tree["mu"][k] + radius), (tree["far"][k], d > tree["mu"][k])):
            if keep.any():
                todo.append((int(side), at[keep]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hooks the labels of all pairs (i, j) to their minimum until nothing changes; label holds roots."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(x: np.ndarray, mask: int, radius: int, limit: int = RADIUS, block: int = 384) -> np.ndarray:
    """For distinct fingerprints x, the index of the first member of each one's component of links found with this mask."""
    label = np.arange(len(x))
    rng = np.random.default_rng(7)
    todo = [(label.copy(), mask, radius)]
    while todo:
        at, m, r = todo.pop()
        split = best_split(x[at], m, r, rng) if len(at) > block else None
        if split is None and len(at) > block and m != ALL:
            todo.append((at, ALL, limit))  # one half alone does not divide these: all bits do
            continue
        if split is not None:
            _, mu, d = split
            todo += [(at[d <= mu + r], m, r), (at[d > mu], m, r)]
            continue
        step = max(1, 2_000_000 // max(1, len(at)))
        for k in range(0, len(at), step):
            i, j = np.nonzero(np.bitwise_count(x[at[k : k + step]][:, None] ^ x[at][None, :]) <= limit)
            _merge(label, at[i + k], at[j])
    return label


def links(classes: DataFrame, shard_rows: int = 4096, sample_cap: int = 65536) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct values of column fp."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, 1.2 * sample_cap / max(1, n))
    cut = int(share * (1 << 62))
    sample = [r[0] for r in classes.where(F.shiftrightunsigned(F.xxhash64("fp", F.lit(1)), 2) <= cut).select("fp").limit(sample_cap).collect()]
    sample = np.array(sample, np.int64).view(np.uint64)
    leaf = max(4, int(shard_rows * len(sample) / max(1, n)))
    trees = spark.sparkContext.broadcast([fit_tree(sample, mask, 1, leaf) for mask in HALVES])

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(x):
                continue
            for t, mask in enumerate(HALVES):
                leaves, at = route(x, trees.value[t], mask, 1)
                yield pa.RecordBatch.from_arrays([pa.array(2 * leaves + t), pa.array(x[at].view(np.int64))], ["shard", "fp"])

    def search(key, group):
        import pandas as pd

        x = np.unique(group["fp"].to_numpy().view(np.uint64))
        root = x[forest(x, HALVES[key[0] & 1], 1)]
        apart = root != x
        return pd.DataFrame({"a": x[apart].view(np.int64), "b": root[apart].view(np.int64)})

    dealt = classes.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_rows: int = 4096, sample_cap: int = 65536) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach from each document."""
    fps = stash(fingerprints(docs, doc_id, text), "fingerprints")
    classes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    parts = connected_components(links(classes, shard_rows, sample_cap))
    named = classes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stash(named, "named")
    drop_stash(classes)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = named.join(least, "component").select("fp", "component_id")
    return fps.join(final, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component: one document of each group. Rows without an id stay; of repeated ids the row with the smallest SHA-256 of its text stays. An empty table stays empty; extra columns stay, whatever their names.

    Groups here are those of five-word shingles at Jaccard similarity 0.8 or more: longer fingerprints and a vantage-point tree for each 16 of
    their bits find the pairs, the sets decide (shingle_links). Pairs at that similarity differ in up to some 17 of op3's 64 bits, and a search of that radius divides nothing.
    """
    from quillfern.llm.shingle_links import near_copies

    id_, sha, n = (free_name(docs, x) for x in ("id", "sha", "n"))
    kept = near_copies(docs, doc_id, text).select(F.col("component_id").alias(id_)).distinct()
    out = docs.join(kept, F.col(doc_id) == F.col(id_), "left_semi")
    if not docs.groupBy(F.col(doc_id).alias("i")).agg(F.count(F.lit(1)).alias("c")).where("c > 1 and i is not null").isEmpty():
        out = out.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn(n, F.row_number().over(W.partitionBy(doc_id).orderBy(sha))).where(F.col(n) == 1).select(*docs.columns)
    return out.unionByName(docs.where(F.col(doc_id).isNull()))
