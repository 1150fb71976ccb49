"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact links.

The Jaccard distance d is a metric. A join over the whole space at once is hopeless: nearly all distances
are exactly 1, so no pivot tells documents apart. The join therefore works in three levels.

1. *Root regions.* A document's shingles are dealt by hash into m parts. Two sets within the threshold differ
   in at most D = n_small * (1 - t) / t shingles, so of the first D + 1 + E parts at least 1 + E are equal in
   both. Equal parts tie documents, empty ones only where more than E are empty. A passage that many texts share
   ties unlike ones in a part or two, and these chain: so a set that is tied in fewer than 1 + E parts, less its
   empty ones, has no link and goes, then what was tied to such sets alone. The components of the ties left are the
   root regions: no link leaves one, and each distinct set lies in one region only. A region is dealt afresh (other
   hashes, other parts) and falls apart where the ties do not hold again.
2. *Large regions* are split by distributed rounds: pivots chosen by hash, every set goes to the Voronoi
   region of its nearest pivot and, if d(x, p) <= d(x, home) + 2 * radius, also to that of p. Sets far from all
   pivots share one remainder with the sets within a radius of being far. Sets within the radius of a pivot are
   linked to it at once, and stay only if a set outside the ball lies within reach.
3. *Regions that fit* are joined in memory by the same recursion.

Texts with equal sets are one node throughout; hashes of shingles and sets have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, connected_components, discard, materialise, mix, small_batches, text_buffer, word_hashes

_U = np.uint64
#: Shingles of a region that one task may hold at once (8 bytes each); larger regions are split first.
REGION_LIMIT = 4_000_000
#: Pivots of a distributed round, rounds before the block join, and fresh dealings that may split a region.
PIVOTS, ROUNDS, DEALINGS = 32, 8, 4
#: Times that sets with too few ties are looked for; those left after the last are split as others are.
SIFTS = 6
#: A part that a set shows: its hash, whether its class is the set's own, and how many ties a link needs there at least.
SIG = "struct<sig: long, own: boolean, ask: int>"


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their len+1 offsets."""
    words, at = word_hashes(raw, offs)
    count = np.diff(at)
    full = np.maximum(count - width + 1, 0)
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full) + np.arange(full.sum())
    sh = np.zeros(len(first), _U)
    for k in range(width):
        sh = mix(sh + words[first + k], 1)
    start = np.concatenate(([0], np.cumsum(full)))
    for i in np.flatnonzero(full > 1):
        sh[start[i] : start[i + 1]].sort()
    keep = np.ones(len(sh), bool)
    keep[1:] = sh[1:] != sh[:-1]
    keep[start[:-1][full > 0]] = True
    owner = np.repeat(np.arange(len(count)), full)[keep]
    sh = sh[keep]
    if short := [i for i in np.flatnonzero((count > 0) & (count < width))]:
        h = np.zeros(len(short), _U)
        for j, i in enumerate(short):
            x = np.full(1, count[i], _U)
            for w in words[at[i] : at[i + 1]]:
                x = mix(x + w, 2)
            h[j] = x[0]
        order = np.argsort(np.concatenate((owner, short)), kind="stable")
        owner, sh = np.concatenate((owner, short))[order], np.concatenate((sh, h))[order]
    return sh, np.searchsorted(owner, np.arange(len(count) + 1))


def fingerprints(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit fingerprint of each set (0 for the empty one)."""
    n = np.diff(at)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(sh, 3), dtype=_U)))
    fp = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(n.astype(_U), 4))
    return np.where(n > 0, fp, _U(0)).view(np.int64)


class Parts:
    """Sizes are cut into classes; each class has its number of parts and how many of them count."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.lows, self.need = [1], lambda n: n * (den - num) // num
        zero = 1
        while self.need(zero + 1) == 0 and zero < 10_000:
            zero += 1
        self.lows.append(zero + 1)

    def grow(self, n: int) -> None:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, -(-self.lows[-1] * 3 // 2)))

    def tables(self) -> tuple[np.ndarray, ...]:
        lows = np.array(self.lows)
        a, top = lows[:-1], lows[1:] - 1
        spare = np.where(self.need(top) > 0, -(-self.need(a) * 3 // 10) + 2, 0)
        return lows, top, spare, self.need(top) + 1 + spare

    def signatures(self, sh: np.ndarray, at: np.ndarray, dealing: int = 0) -> tuple[np.ndarray, ...]:
        """(row, signature, own, ask) of each part that a set shows, sorted by row; `dealing` picks the hash of the parts.

        A set shows its parts in the class of its size (own) and in the one below, if a set there may be linked to it.
        Linked sets have 1 + spare equal parts of those that the smaller one shows in some class. A set that hides its
        empty parts thus has at least `ask` = 1 + spare - empty ties there: the empty ones among the equal parts are empty
        in it too. If it has more empty parts than are spared it shows them all, and one tie is sure: the other set may hide its own.
        """
        n = np.diff(at)
        if not len(sh):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)
        self.grow(int(n.max()) + 1)
        lows, top, spare, parts = self.tables()
        own = np.searchsorted(lows, n, "right") - 1
        rows, sigs, owns, asks = [], [], [], []
        for down in (0, 1):
            cls = own - down
            use = (n > 0) & (cls >= 0)
            if down:
                use &= -(-n * self.num // self.den) <= top[np.maximum(cls, 0)]
            docs = np.flatnonzero(use)
            if not len(docs):
                continue
            c = cls[docs]
            shown = self.need(np.minimum(n[docs], top[c])) + 1 + spare[c]
            base = np.concatenate(([0], np.cumsum(shown)))
            pick = np.repeat(np.arange(len(docs)), n[docs])
            s = sh[np.repeat(use, n)]
            part = (mix(s, 5 + 1000 * dealing) % parts[c].astype(_U)[pick]).astype(np.int64)
            ok = part < shown[pick]
            cell = base[pick[ok]] + part[ok]
            held = np.bincount(cell, minlength=base[-1])
            sums = np.zeros(base[-1], _U)
            np.add.at(sums, cell, mix(s[ok], 6))
            owner = np.repeat(np.arange(len(docs)), shown)
            empty = np.bincount(owner[held == 0], minlength=len(docs))
            many = empty > spare[c]
            emit = (held > 0) | many[owner]
            index = np.arange(base[-1]) - base[owner]
            key = mix(c[owner].astype(_U) * _U(1 << 32) + index.astype(_U), 7)
            rows.append(docs[owner[emit]])
            sigs.append(mix(sums ^ key, 8)[emit].view(np.int64))
            owns.append(np.full(len(rows[-1]), not down))
            asks.append(np.where(many, 1, 1 + spare[c] - empty)[owner[emit]].astype(np.int32))
        order = np.argsort(np.concatenate(rows), kind="stable")
        return tuple(np.concatenate(x)[order] for x in (rows, sigs, owns, asks))


def _sig_array(sigs: np.ndarray, own: np.ndarray, ask: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(sigs, pa.int64()), pa.array(own, pa.bool_()), pa.array(ask, pa.int32())], names=["sig", "own", "ask"])


def _profile(width: int, num: int, den: int):
    def run(batches):
        parts, seen = Parts(num, den), set()
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            size, fps, lists = [], [], []
            for a, b in blocks(offs):
                sh, at = shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width)
                fp = fingerprints(sh, at)
                fresh = np.zeros(b - a, bool)
                for i, x in enumerate(fp.tolist()):
                    if x and x not in seen:
                        fresh[i] = True
                        if len(seen) < 1_000_000:  # only saves repeats: a set shown again changes nothing
                            seen.add(x)
                n = np.where(fresh, np.diff(at), 0)
                rows, *sigs = parts.signatures(sh[np.repeat(fresh, np.diff(at))], np.concatenate(([0], np.cumsum(n))))
                size.append(np.diff(at))
                fps.append(fp)
                lists.append((np.bincount(rows, minlength=b - a), sigs))
            if not size:
                continue
            ends = np.concatenate(([0], np.cumsum(np.concatenate([x[0] for x in lists]))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(size), pa.int64()),
                    pa.array(np.concatenate(fps), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _sig_array(*(np.concatenate([x[1][k] for x in lists]) for k in range(3)))),
                ],
                names=["id", "n_shingles", "fp", "sigs"],
            )

    return run


class Links:
    """Union-find over the rows of one region."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def distances(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances of one sorted set to others."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) > 1 else sets[0]
    spot = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    hit = np.concatenate(([0], np.cumsum(pivot[spot] == flat)))
    ends = np.cumsum(sizes)
    common = hit[ends] - hit[ends - sizes]
    return 1 - common / (len(pivot) + sizes - common)


def near(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets link, in whole numbers."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def split_region(d: np.ndarray, radius: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Members of each pivot's region and of the remainder, for a pivots x rows matrix of distances.

    A pair within the radius lies together in some region or in the remainder: if both are closer to a pivot
    than `far`, in the region of either's home, by the triangle inequality; else both are over far - radius.
    """
    eps = 1e-9
    home = d.min(0)
    far = max(radius, 1 - 2 * radius - 0.1)
    regions = []
    for row in d:
        member = (home <= far) & (row <= home + 2 * radius + eps)
        shell = member & (row > radius)
        if shell.any():
            regions.append(np.flatnonzero(shell | (member & (row > 0) & (row >= row[shell].min() - radius - eps))))
    return regions, np.flatnonzero(home > far - radius - eps)


def tied_groups(sets: list[np.ndarray], parts: Parts, dealing: int) -> list[np.ndarray]:
    """Rows of the components of the ties of one dealing; every link lies within one."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    rows, sigs, own, ask = parts.signatures(np.concatenate(sets), at, dealing)
    order = np.argsort(sigs, kind="stable")
    rows, sigs, ask, shown = rows[order], sigs[order], ask[order], 2 * rows[order] + own[order]
    while True:
        same = sigs[1:] == sigs[:-1]
        tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
        stay = tied & (np.bincount(shown[tied], minlength=2 * len(sets))[shown] >= ask)
        if stay.all() or not stay.any():
            break
        rows, sigs, ask, shown = rows[stay], sigs[stay], ask[stay], shown[stay]
    rows, sigs = rows[stay], sigs[stay]
    same, links = np.flatnonzero(sigs[1:] == sigs[:-1]), Links(len(sets))
    for i, j in zip(rows[same].tolist(), rows[same + 1].tolist(), strict=True):
        links.join(i, j)
    roots = np.array([links.find(i) for i in range(len(sets))])
    order = np.argsort(roots, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)


def region_links(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Component of each set of a region (index of its first member), by recursion over dealings and pivots."""
    links, radius, parts = Links(len(sets)), 1 - num / den, Parts(num, den)
    todo = [(np.arange(len(sets)), 1)]
    while todo:
        rows, dealing = todo.pop()
        if len(rows) > 12 and dealing <= DEALINGS:
            groups = tied_groups([sets[i] for i in rows], parts, dealing)
            todo += [(rows[g], dealing + 1 if len(groups) > 1 else DEALINGS + 1) for g in groups if len(g) > 1]
            continue
        if len(rows) <= 12:
            for x, i in enumerate(rows):
                for j in rows[x + 1 :]:
                    if links.find(i) != links.find(j) and near(sets[i], sets[j], num, den):
                        links.join(i, j)
            continue
        picks = np.unique(np.linspace(0, len(rows) - 1, min(8, 1 + len(rows) // 8)).astype(int))
        held = [sets[i] for i in rows]
        d = np.stack([distances(held[p], held) for p in picks])
        for p, row in zip(picks, d, strict=True):
            for j in np.flatnonzero(row <= radius + 1e-9):
                if j != p and links.find(rows[p]) != links.find(rows[j]) and near(held[p], held[j], num, den):
                    links.join(rows[p], rows[j])
        d = np.where(np.abs(d - radius) < 1e-9, radius + 2e-9, d)  # on the edge: never taken for granted
        regions, rest = split_region(d, radius)
        if len(rest) + sum(map(len, regions)) > len(rows):  # nothing is told apart: the pivots alone are done with
            regions, rest = [], np.arange(len(rows))
        for sub in (*regions, rest):
            sub = np.setdiff1d(sub, picks, assume_unique=True)
            if len(sub) > 1 and len({links.find(i) for i in rows[sub]}) > 1:
                todo.append((rows[sub], DEALINGS + 1))
    return [links.find(i) for i in range(len(sets))]


def _groups(batches, keys: int = 1):
    """Consecutive rows with equal first columns, over batch borders."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield last, held


def _sets_of(texts: list[str], width: int) -> list[np.ndarray]:
    raw, offs = text_buffer(pa.array(texts, pa.large_string()))
    sh, at = shingle_sets(raw, offs, width)
    return [sh[at[i] : at[i + 1]] for i in range(len(texts))]


def _join_texts(width: int, num: int, den: int):
    """Regions (region, fp, text) sorted by region -> (fp, root)."""

    def run(batches):
        for _, rows in _groups(batches):
            found = {}
            for fp, text in rows:
                s = _sets_of([text], width)[0]
                if fp not in found and fingerprints(s, np.array([0, len(s)]))[0] == fp:
                    found[fp] = s
            names = sorted(found)
            roots = region_links([found[x] for x in names], num, den)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([names[r] for r in roots], pa.int64())], names=["fp", "root"]
            )

    return run


def _to_sets(width: int):
    def run(batches):
        for batch in batches:
            region, fp = batch.column(0), batch.column(1)
            sets = _sets_of(batch.column(2).to_pylist(), width)
            ok = [bool(len(s)) and fingerprints(s, np.array([0, len(s)]))[0] == x for s, x in zip(sets, fp.to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [region, fp, pa.array([s.tobytes() for s in sets], pa.binary())], names=["region", "fp", "shingles"]
            )
            yield out.filter(pa.array(ok))

    return run


def _join_sets(num: int, den: int):
    def run(batches):
        for _, rows in _groups(batches):
            found = {fp: np.frombuffer(s, _U) for fp, s in rows}
            names = sorted(found)
            roots = region_links([found[x] for x in names], num, den)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([names[r] for r in roots], pa.int64())], names=["fp", "root"]
            )

    return run


def _deal(num: int, den: int, dealing: int):
    def run(batches):
        parts = Parts(num, den)
        for batch in batches:
            sets = [np.frombuffer(x, _U) for x in batch.column(2).to_pylist()]
            if not sets:
                continue
            rows, *sigs = parts.signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), dealing)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(0).take(at), _sig_array(*sigs)], names=["fp", "region", "shown"])

    return run


def _ties(shown: DataFrame, place: str) -> DataFrame:
    """Links (u, v) that tie what equal parts in one place tie, from (fp, own, ask, *place) rows; sets with too few ties are left out."""

    def met(rows: DataFrame) -> DataFrame:
        return rows.selectExpr("*", f"min(fp) over (partition by {place}) as low", f"max(fp) over (partition by {place}) as high").where("low <> high").drop("high")

    ties = materialise(met(shown).drop("low").distinct(), "ties")
    n = ties.count()
    for _ in range(SIFTS):
        enough = ties.groupBy("fp", "own").agg(F.count("*").alias("n"), F.max("ask").alias("ask")).where("n >= ask").select("fp", "own")
        left = materialise(met(ties.join(enough.hint("merge"), ["fp", "own"], "left_semi")).drop("low"), "ties")
        discard(ties)
        ties, before, n = left, n, left.count()
        if n == before:
            break
    links = materialise(met(ties).where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct(), "tied")
    discard(ties)
    return links


def _voronoi(num: int, den: int, turn: int):
    """(region, salt, late, fp, shingles), pivots first -> members (region, fp, shingles, d) and links (root set)."""
    radius = 1 - num / den

    def emit(rows):
        cols = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["region", "fp", "shingles", "d", "root"]
        )

    def run(batches):
        last, pivots, out = None, {}, []
        for batch in batches:
            for region, salt, late, fp, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (region, salt) != last:
                    last, pivots = (region, salt), {}
                x = np.frombuffer(s, _U)
                if not late:
                    pivots[fp] = x
                    continue
                if fp in pivots:  # compared with every row here; among themselves they need links only
                    out += [(None, fp, None, None, p) for p, y in pivots.items() if p < fp and near(x, y, num, den)]
                    continue
                if not pivots:
                    out.append((region, fp, s, 1.0, None))
                    continue
                names = list(pivots)
                d = distances(x, [pivots[p] for p in names])
                home, far = d.min(), max(radius, 1 - 2 * radius - 0.1)
                for p, dist in zip(names, d.tolist(), strict=True):
                    if dist <= radius + 1e-9 and near(x, pivots[p], num, den):
                        out.append((None, fp, None, None, p))
                    elif dist <= radius + 1e-9:
                        dist = radius + 2e-9
                    if home <= far and dist <= home + 2 * radius + 1e-9:
                        key = int(mix(np.array([region & (2**64 - 1), p & (2**64 - 1)], _U), 9 + turn).sum().view(np.int64))
                        out.append((key, fp, s, dist, None))
                if home > far - radius - 1e-9:
                    out.append((int(mix(np.array([region & (2**64 - 1)], _U), 99 + turn).view(np.int64)[0]), fp, s, 1.0, None))
                if len(out) > 500:
                    yield emit(out)
                    out = []
        if out:
            yield emit(out)

    return run


def _large_regions(sets: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """Links (u, v) of regions too large for one task, by distributed pivot rounds; at last by pairs of blocks."""
    radius = 1 - num / den
    links = None
    both = lambda a, b: b if a is None else a.unionByName(b)
    sets = materialise(sets.select("region", "fp", "shingles"), "sets")
    member = "region long, fp long, shingles binary, d double, root long"
    for turn in range(ROUNDS):
        size = sets.groupBy("region").agg(F.count("*").alias("rows"), (F.sum(F.octet_length("shingles")) / 8).alias("size"))
        sized = sets.join(size, "region")
        fits = sized.where(F.col("size") <= limit).select("region", "fp", "shingles")
        fits = fits.repartition("region").sortWithinPartitions("region", "fp")
        done = fits.mapInArrow(_join_sets(num, den), "fp long, root long").where("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v"))
        links = both(links, materialise(done, "links"))
        big = sized.where(F.col("size") > limit).withColumn("slots", F.ceil(F.col("size") / limit))
        if big.isEmpty():
            return links
        if turn < 2:  # each set is in one region still
            shown = big.select("region", "fp", "shingles").mapInArrow(_deal(num, den, turn + DEALINGS + 1), f"fp long, region long, shown {SIG}")
            tied = connected_components(_ties(shown.select("fp", "region", "shown.*"), "region, sig"), "dealt").toDF("fp", "part")
            sets = materialise(big.join(tied, "fp").select(F.xxhash64("region", "part").alias("region"), "fp", "shingles"), "sets")
            continue
        hashed = F.xxhash64("fp", F.lit(turn))
        pivots = big.where(F.pmod(hashed, F.col("rows")) < PIVOTS)
        pivots = pivots.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("salt"), F.lit(0).alias("late"), "fp", "shingles")
        rows = big.select("region", F.pmod(hashed, F.col("slots")).alias("salt"), F.lit(1).alias("late"), "fp", "shingles")
        dealt = pivots.unionByName(rows).repartition("region", "salt").sortWithinPartitions("region", "salt", "late", "fp")
        out = materialise(dealt.mapInArrow(_voronoi(num, den, turn), member), "voronoi")
        links = both(links, out.where("root is not null").select(F.col("fp").alias("u"), F.col("root").alias("v")))
        rows = out.where("root is null")
        edge = rows.where(F.col("d") > radius).groupBy("region").agg(F.min("d").alias("edge"))
        sets = materialise(rows.join(edge, "region").where(F.col("d") >= F.col("edge") - radius - 1e-9).select("region", "fp", "shingles"), "sets")
    size = sets.groupBy("region").agg((F.sum(F.octet_length("shingles")) / 8).alias("size"))
    big = sets.join(size, "region").withColumn("slots", F.ceil(F.col("size") * 2 / limit))
    mine = F.pmod(F.xxhash64("fp"), F.col("slots"))
    pairs = big.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    keyed = pairs.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "fp", "shingles")
    keyed = keyed.repartition("region").sortWithinPartitions("region", "fp")
    last = keyed.mapInArrow(_join_sets(num, den), "fp long, root long").where("fp <> root")
    return both(links, last.select(F.col("fp").alias("u"), F.col("root").alias("v")))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    num: int = 85,
    den: int = 100,
    region_limit: int = REGION_LIMIT,
) -> DataFrame:
    """Rows (id_col, n_shingles, component_id): texts link when den * common >= num * union of their shingle sets.

    Words are runs outside ASCII white space, A-Z folded; shorter texts than `width` words are one shingle.
    Null, empty and blank texts have n_shingles 0 and are a component of their own. Repeated rows each appear;
    equal texts share a component. A null id stays null and never names a component with other ids. Other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    info = base.mapInArrow(_profile(width, num, den), f"id {kind}, n_shingles long, fp long, sigs array<{SIG}>")
    info = materialise(info, "profiles")
    shown = info.select(F.explode("sigs").alias("shown"), "fp").select("fp", "shown.*")
    regions = connected_components(_ties(shown, "sig"), "regions")
    regions = materialise(regions.select(F.col("node").alias("fp"), F.col("component").alias("region")), "regions")
    nodes = info.where("n_shingles > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"))
    wanted = materialise(nodes.join(regions, "fp"), "wanted")
    big = wanted.groupBy("region").agg(F.sum("n").alias("size")).where(F.col("size") > region_limit).select("region")
    # The same plan at every size: texts meet their few wanted ids by a sort-merge join.
    texts = base.join(wanted.hint("merge"), base["id"].eqNullSafe(wanted["rep"])).select("region", "fp", "text")
    texts = materialise(texts, "texts")
    small = texts.join(big, "region", "left_anti").repartition("region").sortWithinPartitions("region", "fp")
    found = materialise(small.mapInArrow(_join_texts(width, num, den), "fp long, root long"), "found")
    if not big.isEmpty():
        sets = texts.join(big, "region", "left_semi").mapInArrow(_to_sets(width), "region long, fp long, shingles binary")
        links = _large_regions(sets.dropDuplicates(["region", "fp"]), num, den, region_limit)
        more = connected_components(links, "links")
        found = found.union(more.select("node", "component"))
    rooted = nodes.join(found.where("fp <> root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(named, "root").select("fp", "component_id")
    out = info.join(known, "fp", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
