"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The lattice of a text has one edge for each vocabulary piece at each place; a character that is no piece
is an edge of its UTF-8 byte pieces. Edges weigh log(1 / (2 + rank)), by the piece's rank in the model; byte
pieces weigh as the last rank. A path's probability is its weight's share of all paths' weights; with the
backward sums of the lattice it is a product of local choices, left to right.

The search is best-first over regions of paths, as in A-star sampling. A region fixes the choices before
some step and excludes some choices at that step; its bound is a Gumbel variable with the log of the
region's probability as location, truncated by the bound of the region it was split from. The region with
the largest bound is completed by local choices: that path is the next sample and its perturbed log-probability is
the bound. The rest of the region is split at every step of the path. So the k samples are distinct and
distributed as k draws without replacement. The next largest bound is the threshold kappa, and
1 - exp(-exp(log_p - kappa)) is a sample's inclusion score (kept as a logarithm: texts are long).

Pieces never span the start of a run of blanks or a line end, so lattices of distinct units
are built once per slice of texts, for all of them at once in numpy. Every random number is a hash of (row key, seed,
sample, character), so a row's samples depend on nothing else.

Defined cases: null and empty texts have one segmentation, the empty one; a text with fewer than k
segmentations gives all of them; equal texts under different keys give different samples, equal keys and texts
equal ones; a null key counts as zero; U+2581 in a text decodes as a blank; an empty table gives an empty result. Extra columns are ignored, and kept by decode_rows().
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quillfern.llm.common import id_and_text, text_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
SAMPLES = "doc_id long, n_segmentations int, log_p array<double>, perturbed array<double>, log_inclusion array<double>, n_pieces array<int>, ids array<array<int>>"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on row key, stream and character."""
    with np.errstate(over="ignore"):
        h = mixed(key + np.uint64(stream) * _M3 + at.astype(np.uint64) * _M2)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """A SentencePiece model's vocabulary as hash tables of its pieces' code points."""

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        ordinary = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if any(BLANK in m.id_to_piece(i).lstrip(BLANK) or "\n" in m.id_to_piece(i) for i in ordinary):
            raise ValueError("a piece spans the start of a word or a line end")
        rank = lambda i: -m.get_score(i) if -1e8 < m.get_score(i) <= 0 else float(n)
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_log = -np.log(2 + n) / temperature
        self.longest = max(len(m.id_to_piece(i)) for i in ordinary)
        self.surface: list[bytes] = [b""] * n
        for i in ordinary:
            self.surface[i] = m.id_to_piece(i).replace(BLANK, " ").encode()
        for b in range(256):
            self.surface[self.bytes[b]] = bytes([b])
        # For each length the hashes of all prefixes of pieces; the piece's id and log weight where the prefix is one, else -1.
        self.by_length = []
        for length in range(1, self.longest + 1):
            whole = {m.id_to_piece(i): i for i in ordinary if len(m.id_to_piece(i)) == length}
            prefixes = sorted({m.id_to_piece(i)[:length] for i in ordinary if len(m.id_to_piece(i)) >= length})
            keys = self.hashes(np.array([[ord(c) for c in x] for x in prefixes], np.uint64))
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two prefixes share a hash")
            order = np.argsort(keys)
            ids = np.array([whole.get(x, -1) for x in prefixes], np.int32)
            logs = np.array([-np.log(2 + rank(i)) / temperature if i >= 0 else -np.inf for i in ids.tolist()])
            self.by_length.append((keys[order], ids[order], logs[order]))

        # A slot for the top bits of a hash holds its prefix; the few that meet another there are found by binary search.
        self.slots = []
        for keys, _, _ in self.by_length:
            slot = np.full(1 << 18, -1, np.int32)
            slot[(keys >> np.uint64(46)).astype(np.int64)[::-1]] = np.arange(len(keys))[::-1]
            self.slots.append((slot, len(np.unique(keys >> np.uint64(46))) < len(keys)))

    def find(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """For each hash of k + 1 code points the number of the prefix, or -1."""
        keys = self.by_length[k][0]
        slot, shared = self.slots[k]
        at = slot[(hashes >> np.uint64(46)).astype(np.int64)]
        wrong = np.flatnonzero(keys[at] != hashes)
        if len(wrong):
            if shared:
                some = wrong[at[wrong] >= 0]
                there = np.minimum(np.searchsorted(keys, hashes[some]), len(keys) - 1)
                at[wrong] = -1
                at[some] = np.where(keys[there] == hashes[some], there, -1)
            else:
                at[wrong] = -1
        return at

    @staticmethod
    def hashes(points: np.ndarray) -> np.ndarray:
        h = np.zeros(len(points), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(points.shape[1]):
                h = (h ^ points[:, k]) * _M2
                h ^= h >> np.uint64(29)
        return h


@lru_cache(maxsize=2)
def load_pieces(path: str, temperature: float = 1.0) -> Pieces:
    return Pieces(path, temperature)


class Lattice:
    """Lattices of distinct units, laid end to end and kept from slice to slice: for each character its edges, likeliest first.

    the many[r] edges of row r begin at ptr[r], with their length, piece (-2: bytes), log of the local choice and running sum.
    """

    def __init__(self, pieces: Pieces, most_rows: int = 3_000_000):
        self.pieces, self.most_rows = pieces, most_rows
        self.clear()

    def clear(self) -> None:
        self.unit_of: dict[str, int] = {}
        self.rows = self.edges = self.units = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.points = np.zeros(1 << 14, np.uint32)
        self.ptr = np.zeros(1 << 14, np.int64)
        self.many = np.zeros(1 << 14, np.int8)
        self.length = np.zeros(1 << 16, np.int8)
        self.piece = np.zeros(1 << 16, np.int32)
        self.log = np.zeros(1 << 16, np.float32)
        self.sums = np.zeros(1 << 16, np.float32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        a = getattr(self, name)
        if at + len(values) > len(a):
            grown = np.zeros(max(at + len(values), len(a) + len(a) // 2), a.dtype)
            grown[:at] = a[:at]
            setattr(self, name, a := grown)
        a[at : at + len(values)] = values

    def add(self, units: list[str], chars: int = 100_000) -> None:
        """Appends units that are not there yet, some at a time."""
        part, size = [], 0
        for u in units:
            part.append(u)
            size += len(u)
            if size >= chars:
                self._append(part)
                part, size = [], 0
        if part:
            self._append(part)

    def _append(self, units: list[str]) -> None:
        pieces = self.pieces
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        n = len(points)
        size = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(size)
        left = np.repeat(stop, size) - np.arange(n)  # characters up to the unit's end
        h = np.zeros(n, np.uint64)
        here = np.arange(n)
        rows, lengths, ids, logs = [], [], [], []
        for k in range(min(pieces.longest, int(size.max()))):
            if k:
                here = here[left[here] > k]
            if not len(here):
                break
            with np.errstate(over="ignore"):
                v = (h[here] ^ points[here + k]) * _M2
                v ^= v >> np.uint64(29)
            at = pieces.find(k, v)
            ok = np.flatnonzero(at >= 0)
            here, at = here[ok], at[ok]  # the others begin no longer piece
            h[here] = v[ok]
            id_ = pieces.by_length[k][1][at]
            whole = np.flatnonzero(id_ >= 0)
            rows.append(here[whole])
            lengths.append(np.full(len(whole), k + 1, np.int64))
            ids.append(id_[whole])
            logs.append(pieces.by_length[k][2][at[whole]])
        one = np.zeros(n, bool)
        one[rows[0]] = True
        lone = np.flatnonzero(~one)  # no piece of this character: its bytes
        if len(lone):
            width = 1 + (points[lone] > 0x7F).astype(int) + (points[lone] > 0x7FF) + (points[lone] > 0xFFFF)
            rows.append(lone)
            lengths.append(np.ones(len(lone), np.int64))
            ids.append(np.full(len(lone), -2, np.int32))
            logs.append(width * pieces.byte_log)
        row, length, id_, log = map(np.concatenate, (rows, lengths, ids, logs))
        # Edges by characters up to the unit's end, then by row: backward sums go through them once, in order.
        order = np.lexsort((row, left[row])) if n >= 1 << 15 else np.argsort(left[row] * n + row, kind="stable")
        row, length, id_, log = row[order], length[order], id_[order], log[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))  # a row's edges stand together
        count = np.diff(first, append=len(row))
        of = row[first]
        beta = np.zeros(n + 1)
        follow = row + length
        inner = left[row] > length
        group = np.flatnonzero(np.diff(left[of], prepend=0))  # rows of one distance
        for a, b in zip(group.tolist(), [*group[1:].tolist(), len(of)], strict=True):
            ea, eb = int(first[a]), int(first[b - 1] + count[b - 1])
            total = log[ea:eb]
            total += np.where(inner[ea:eb], beta[np.minimum(follow[ea:eb], n)], 0.0)
            begin = first[a:b] - ea
            top = np.maximum.reduceat(total, begin)
            each = np.repeat(top, count[a:b])
            sums = top + np.log(np.add.reduceat(np.exp(total - each), begin))
            beta[of[a:b]] = sums
            total -= np.repeat(sums, count[a:b])
        top = np.repeat(np.maximum.reduceat(log, first), count)
        best = np.flatnonzero(log == top)
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]  # one a row: likeliest edges come first
        for x in (length, id_, log):
            x[first], x[best] = x[best].copy(), x[first].copy()
        chance = np.exp(log)
        sums = np.cumsum(chance)
        sums -= np.repeat(sums[first] - chance[first], count)
        sums[first + count - 1] = 2.0
        begin, many = np.zeros(n, np.int64), np.zeros(n, np.int64)
        begin[of], many[of] = first, count
        self._put("start", self.units + 1, self.rows + stop)
        self._put("points", self.rows, points)
        self._put("ptr", self.rows, self.edges + begin)
        self._put("many", self.rows, many)
        for name, values in (("length", length), ("piece", id_), ("log", log), ("sums", sums)):
            self._put(name, self.edges, values)
        self.units += len(units)
        self.rows += n
        self.edges += len(row)

    def number(self, texts: list[str]) -> list[list[int]]:
        """The units of each text, by number; new units join the lattice, which starts anew when it holds most_rows."""
        if self.rows > self.most_rows:
            self.clear()
        known, new = self.unit_of, []
        out = []
        for t in texts:
            units = units_of(t)
            row = list(map(known.get, units))
            if None in row:
                for j, u in enumerate(units):
                    if row[j] is None:
                        i = known.get(u)
                        if i is None:
                            i = known[u] = len(known)
                            new.append(u[1:] if u[:1] == GLUE else u if u == "\n" else BLANK + u)
                        row[j] = i
            out.append(row)
        self.add(new)
        return out


#: Marks a unit that has no blank before it; texts that hold it go the general way.
GLUE = "\ue000"


def units_of(text: str) -> list[str]:
    """The text's units in order: '\\n', a word (a blank stands before it) or GLUE and characters with no blank before."""
    if not text:
        return []
    if "  " not in text and GLUE not in text and BLANK not in text:
        return text.replace("\n", f" \n {GLUE}").split(" ")
    found = _UNIT.findall(BLANK + text.replace(" ", BLANK))
    return [u if u == "\n" else u[1:] if u[0] == BLANK else GLUE + u for u in found]


@lru_cache(maxsize=1)
def worker_lattice(path: str, temperature: float) -> Lattice:
    """The lattices that a Python worker keeps from task to task."""
    return Lattice(load_pieces(path, temperature))


class Path:
    """A completed segmentation of each of some texts, as flat arrays of steps, and its open regions.

    first[i] .. first[i + 1]: the steps of texts[i]; place: character in the text; row, edge: lattice row and chosen edge; before: log of the choices
    before a step; used: excluded edges by step where more than the chosen one is excluded; skip: steps that belong to earlier paths' regions.
    """

    def __init__(self, lat: Lattice, texts: np.ndarray, owner, place, row, edge, skip: np.ndarray):
        self.texts, self.place, self.row, self.edge = texts, place, row, edge
        self.first = np.concatenate((np.searchsorted(owner, texts), [len(owner)]))
        log = lat.log[edge].astype(np.float64)
        running = np.cumsum(log)
        self.total = np.add.reduceat(log, self.first[:-1])
        lead = running[self.first[:-1]] - log[self.first[:-1]]
        self.before = running - log - np.repeat(lead, np.diff(self.first))
        self.skip = skip
        self.used: dict[int, list[int]] = {}
        self.region_text = self.region_step = np.zeros(0, np.int64)
        self.region_bound = np.zeros(0)

    def steps(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


#: Steps whose prefix is less likely than exp(FLOOR) are looked at only for texts whose best bound is below FLOOR + 40: with 53-bit numbers no bound lies 38 above its location.
FLOOR = -150.0


def complete(lat: Lattice, key: np.ndarray, stream: int, owner: np.ndarray, place: np.ndarray, row: np.ndarray, stop: np.ndarray):
    """Local choices from each open stretch (lattice rows row to stop) to its end: (owner, place, row, edge) of all steps in order."""
    parts = []
    count = np.zeros(len(row), np.int64)
    index = np.flatnonzero(row < stop)
    shift = place - row  # place of a step is its row plus this
    row, stop = row[index], stop[index]
    salt = key[owner]
    while len(row):
        u = uniform(salt[index], stream, row + shift[index])
        edge = lat.ptr[row]
        wrong = np.flatnonzero(lat.sums[edge] < u)
        while len(wrong):
            edge[wrong] += 1
            wrong = wrong[lat.sums[edge[wrong]] < u[wrong]]
        parts.append((index, row, edge))
        count[index] += 1
        row = row + lat.length[edge]
        more = np.flatnonzero(row < stop)
        row, stop, index = row[more], stop[more], index[more]
    base = np.concatenate(([0], np.cumsum(count)))
    rows, edges = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
    for k, (i, r, e) in enumerate(parts):
        at = base[i] + k
        rows[at], edges[at] = r, e
    return np.repeat(owner, count), rows + np.repeat(shift, count), rows, edges


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable with this location, given that it is below the bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(g, bound))


def open_regions(lat: Lattice, p: Path, bound: np.ndarray, key: np.ndarray, stream: int, wanted: np.ndarray) -> None:
    """Draws the bounds of the regions that split off at the wanted steps of a path; bound: of the path, by text."""
    at = np.flatnonzero(wanted & ~p.skip)
    text = p.texts[np.searchsorted(p.first, at, side="right") - 1]
    rest = -np.expm1(lat.log[p.edge[at]].astype(np.float64))
    # Where little is left, the sum of the other edges' chances is more exact than one less the chosen one's.
    little = np.flatnonzero(rest < 0.1)
    rest[little] = 0
    begin, many = lat.ptr[p.row[at[little]]], lat.many[p.row[at[little]]]
    for k in range(int(many.max(initial=0))):
        here = np.flatnonzero((many > k) & (begin + k != p.edge[at[little]]))
        rest[little[here]] += np.exp(lat.log[begin[here] + k].astype(np.float64))
    for s, used in p.used.items():
        if wanted[s] and not p.skip[s]:
            r = int(p.row[s])
            others = [e for e in range(int(lat.ptr[r]), int(lat.ptr[r]) + int(lat.many[r])) if e not in used]
            rest[np.searchsorted(at, s)] = np.exp(lat.log[others].astype(np.float64)).sum() if others else 0.0
    some = rest > 0
    at, text = at[some], text[some]
    location = p.before[at] + np.log(rest[some])
    p.region_text = np.concatenate((p.region_text, text))
    p.region_step = np.concatenate((p.region_step, at))
    p.region_bound = np.concatenate((p.region_bound, truncated(location, bound[text], uniform(key[text], stream, p.place[at]))))


def sample_texts(texts: list[str], keys: list[int | None], k: int, lat: Lattice, seed: int = 0, with_ids: bool = True) -> list[dict]:
    """For each text up to k distinct segmentations, best perturbed value first, as a dict of SAMPLES' columns."""
    n = len(texts)
    each = lat.number(texts)
    out = [{"n_segmentations": 0, "log_p": [], "perturbed": [], "log_inclusion": [], "n_pieces": [], "ids": []} for _ in texts]
    for o, t in zip(out, texts, strict=True):
        if not t:
            o.update(n_segmentations=1, log_p=[0.0], perturbed=[0.0], log_inclusion=[0.0], n_pieces=[0], ids=[np.zeros(0, np.int32)])
    alive = np.flatnonzero([bool(t) for t in texts])
    if not len(alive):
        return out
    width = np.fromiter(map(len, each), np.int64, n)
    units = np.fromiter((u for e in each for u in e), np.int64, int(width.sum()))
    owner = np.repeat(np.arange(n), width)
    first_unit = np.concatenate(([0], np.cumsum(width)))
    begin, stop = lat.start[units], lat.start[units + 1]
    ends = np.cumsum(stop - begin)
    place = ends - (stop - begin) - np.repeat(np.concatenate(([0], ends))[first_unit[:-1]], width)  # within the text
    with np.errstate(over="ignore"):
        key = mixed(np.array([(x or 0) & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64) + mixed(np.array([seed], np.uint64)))
    bound = np.full(n, -np.inf)
    bound[alive] = -np.log(-np.log(uniform(key[alive], 1, np.zeros(len(alive), np.int64))))
    bounds = [bound]
    steps = complete(lat, key, 2, owner, place, begin, stop)
    paths = [Path(lat, alive, *steps, np.zeros(len(steps[0]), bool))]
    open_regions(lat, paths[0], bound, key, 3, paths[0].before >= FLOOR)
    full = np.zeros(n, bool)

    def emit(p: Path, bound: np.ndarray) -> None:
        ids, offset = piece_ids(lat, p)
        for i, t in enumerate(p.texts.tolist()):
            a, b = offset[p.first[i]], offset[p.first[i + 1]]
            o = out[t]
            o["log_p"].append(float(p.total[i]))
            o["perturbed"].append(float(bound[t]))
            o["n_pieces"].append(int(b - a))
            if with_ids:
                o["ids"].append(ids[a:b])

    def best_regions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the largest bound of its open regions, the path and the region's number there."""
        top, where, which = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
        for j, p in enumerate(paths):
            own = np.full(n, -np.inf)
            np.maximum.at(own, p.region_text, p.region_bound)
            win = np.flatnonzero((p.region_bound == own[p.region_text]) & (p.region_bound > top[p.region_text]))
            t = p.region_text[win]
            top[t], where[t], which[t] = p.region_bound[win], j, win
        return top, where, which

    emit(paths[0], bound)
    kappa = np.full(n, -np.inf)
    for nth in range(1, k + 1):
        top, where, which = best_regions()
        low = (top < FLOOR + 40) & ~full
        if low[alive].any():
            for j, p in enumerate(paths):
                mine = np.repeat(low[p.texts], np.diff(p.first))
                open_regions(lat, p, bounds[j], key, 5 * j + 3, mine & (p.before < FLOOR))
            full |= low
            top, where, which = best_regions()
        if nth == k:
            kappa = top
            break
        go = np.flatnonzero(np.isfinite(top))
        if not len(go):
            break
        pre, mid, excluded, opened = [], [], [], [[], [], [], []]
        for t in go.tolist():
            p = paths[where[t]]
            s = int(p.region_step[which[t]])
            p.region_bound[which[t]] = -np.inf  # the next path's regions take its place
            a = int(p.first[np.searchsorted(p.texts, t)])
            r, x = int(p.row[s]), int(p.place[s])
            used = p.used.get(s, [int(p.edge[s])])
            left = [e for e in range(int(lat.ptr[r]), int(lat.ptr[r]) + int(lat.many[r])) if e not in used]
            chance = np.exp(lat.log[left].astype(np.float64))
            e = left[min(int(np.searchsorted(np.cumsum(chance), uniform(key[t : t + 1], 5 * nth + 1, np.array([x]))[0] * chance.sum())), len(left) - 1)]
            pre.append((p.place[a:s], p.row[a:s], p.edge[a:s]))
            mid.append((x, r, e))
            excluded.append([*used, e])
            # The rest of the split unit, then all later units, anew.
            b, c = first_unit[t], first_unit[t + 1]
            q = b + int(np.searchsorted(place[b:c], x, side="right")) - 1
            after = int(lat.length[e])
            opened[0].append(np.full(c - q, t))
            opened[1].append(np.concatenate(([x + after], place[q + 1 : c])))
            opened[2].append(np.concatenate(([r + after], begin[q + 1 : c])))
            opened[3].append(stop[q:c])
        tail = complete(lat, key, 5 * nth + 2, *map(np.concatenate, opened))
        cut = np.concatenate((np.searchsorted(tail[0], go), [len(tail[0])]))
        cols: list[list] = [[], [], [], [], []]
        for i, t in enumerate(go.tolist()):
            rest = slice(cut[i], cut[i + 1])
            fixed, size = len(pre[i][0]), cut[i + 1] - cut[i]
            cols[0].append(np.full(fixed + 1 + size, t))
            for j in range(3):
                cols[1 + j] += [pre[i][j], [mid[i][j]], tail[1 + j][rest]]
            cols[4].append(np.arange(fixed + 1 + size) < fixed)
        bound = np.where(np.isfinite(top), top, bound)
        p = Path(lat, go, *map(np.concatenate, cols))
        for i, used in enumerate(excluded):
            p.used[int(p.first[i]) + len(pre[i][0])] = used
        open_regions(lat, p, bound, key, 5 * nth + 3, (p.before >= FLOOR) | np.repeat(full[go], np.diff(p.first)))
        paths.append(p)
        bounds.append(bound)
        emit(p, bound)
    for t in alive.tolist():
        o = out[t]
        gap = [x - kappa[t] if np.isfinite(kappa[t]) else np.inf for x in o["log_p"]]
        o["log_inclusion"] = [0.0 if g > 40 else g if g < -30 else float(np.log(-np.expm1(-np.exp(g)))) for g in gap]
        o["n_segmentations"] = len(o["log_p"])
    return out


def piece_ids(lat: Lattice, p: Path) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all steps, and where each step's begin: a character without a piece has several, of its bytes."""
    edge = lat.piece[p.edge]
    lone = np.flatnonzero(edge == -2)
    raw = [chr(c).encode() for c in lat.points[p.row[lone]].tolist()]
    wide = np.array([len(r) for r in raw], np.int64)
    if not len(lone) or wide.max() == 1:
        if len(lone):
            edge[lone] = lat.pieces.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return edge, np.arange(len(edge) + 1)
    width = np.ones(len(edge), np.int64)
    width[lone] = wide
    offset = np.concatenate(([0], np.cumsum(width)))
    ids = np.repeat(edge, width)
    at = np.repeat(offset[lone], wide) + np.concatenate([np.arange(w) for w in wide.tolist()])
    ids[at] = lat.pieces.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, offset


def decode(ids, pieces: Pieces) -> str:
    """The text of a segmentation: the pieces' characters and bytes, less the blank that encoding puts first."""
    surface = pieces.surface
    text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def sample_segmentations(docs: DataFrame, k: int = 2, doc_id: str = "doc_id", text: str = "text", model: str = MODEL_PATH, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """Up to k sampled segmentations of every text, with their ids and scores (SAMPLES)."""

    def each(batches):
        import pyarrow as pa

        lat = worker_lattice(model, temperature)
        kind = pa.schema([("doc_id", pa.int64()), ("n_segmentations", pa.int32()), ("log_p", pa.list_(pa.float64())), ("perturbed", pa.list_(pa.float64())), ("log_inclusion", pa.list_(pa.float64())), ("n_pieces", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int32())))])
        for keys, texts in text_slices(batches, 1_000_000):
            rows = sample_texts(texts, keys, k, lat, seed)
            yield pa.RecordBatch.from_pydict({"doc_id": keys} | {c: [r[c] for r in rows] for c in kind.names[1:]}, schema=kind)

    return id_and_text(docs, doc_id, text).mapInArrow(each, SAMPLES)


def sample_digests(docs: DataFrame, k: int = 2, doc_id: str = "doc_id", text: str = "text", model: str = MODEL_PATH, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """Like sample_segmentations, with a digest of each sample's ids in their place, and whether the first sample decodes to the text."""

    def each(batches):
        import hashlib

        import pyarrow as pa

        lat = worker_lattice(model, temperature)
        pieces = lat.pieces
        kind = pa.schema([("doc_id", pa.int64()), ("n_segmentations", pa.int32()), ("log_p", pa.list_(pa.float64())), ("log_inclusion", pa.list_(pa.float64())), ("n_pieces", pa.list_(pa.int32())), ("ids_md5", pa.list_(pa.string())), ("round_trip", pa.bool_())])
        for keys, texts in text_slices(batches, 1_000_000):
            rows = sample_texts(texts, keys, k, lat, seed)
            digests = [[hashlib.md5(np.asarray(i, np.int32).tobytes()).hexdigest() for i in r["ids"]] for r in rows]
            same = [decode(r["ids"][0], pieces) == t.replace(BLANK, " ") for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "ids_md5": digests, "round_trip": same} | {c: [r[c] for r in rows] for c in kind.names[1:5]}, schema=kind)

    return id_and_text(docs, doc_id, text).mapInArrow(each, "doc_id long, n_segmentations int, log_p array<double>, log_inclusion array<double>, n_pieces array<int>, ids_md5 array<string>, round_trip boolean")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL_PATH) -> DataFrame:
    """The model's own (best) segmentation of every text: doc_id, ids."""

    def each(batches):
        import pyarrow as pa
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        for keys, texts in text_slices(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(m.encode(texts, num_threads=1), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, doc_id, text).mapInArrow(each, "doc_id long, ids array<int>")


def decode_rows(encoded: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL_PATH) -> DataFrame:
    """encoded with its column ids (arrays of piece ids) replaced by the text that they spell; null stays null."""
    at = encoded.columns.index(ids)
    schema = ", ".join(f"`{text if k == at else f.name}` {'string' if k == at else f.dataType.simpleString()}" for k, f in enumerate(encoded.schema.fields))

    def each(batches):
        import pyarrow as pa

        pieces = worker_lattice(model, 1.0).pieces
        for batch in batches:
            texts = [None if i is None else decode(i, pieces) for i in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, [text if k == at else n for k, n in enumerate(batch.schema.names)])

    return encoded.mapInArrow(each, schema)
