"""SimHash near-dedup for a similarity, with wide fingerprints.

A similarity of 0.8 leaves about 15 % of SimHash bits different: far more than the three
bits of 64 that `simhash` links, and too many for any key that finds every pair. So the
fingerprint of the distinct word shingles has 256 bits, and candidates agree on all bits
of one key of several tables (pseudo-random choices of bits). With J the Jaccard
similarity, a bit differs with p = arccos(2 J / (1 + J)) / pi. Keys are as wide as the
number of distinct sets is long in binary, so that unlike sets rarely meet in one at any
size of input, and there are so many tables that a pair at the similarity itself shares
one with probability FOUND: 80 of 18 bits for 200,000 sets, 590 of 30 for a billion.

Pigeonring: the four 64-bit words form a ring. A pair within tau bits (the mean at the
similarity plus 1.65 standard deviations) has a word from which each chain of l words
differs in at most l tau / 4 bits; pairs without such a chain of one and of two words
are pruned before the full Hamming check.

Each key's rows give the links of a minimum spanning forest by Hamming distance, so every
row meets the nearest one of each of its keys, and near copies in thousands give
thousands of links, not all pairs. Every link is then checked exactly: it stays at a
Jaccard similarity of the shingle sets of J or more. Components of these are classes so far.

A pair at the similarity may share no key, or only keys in which both have nearer rows. So
an exact pass follows: in one order of all shingles, sets of a similarity of J share one of
their first n - ceil(J n) + 1 of n. Rows of different classes that share one there meet, if
their sizes and the places of the shingle in them admit J. Rows that meet any other get
their parity sketches, and only pairs whose sketches differ in no more bits than J admits
(each shingle of one set alone flips one bit) leave a group, so that a passage shared by
many unlike texts makes no pairs; these are checked in full. Classes joined by these links are the result: no link is left
out. The order has shingles that a bounded sample shows to be frequent last; the sample
changes the time that this takes and never a link.

Work is on distinct sets of shingles (fingerprint and digest). A key of more than BLOCK
rows is cut into blocks, and each pair of blocks is a group of its own.

Rows: a null or empty text has fingerprint zero; a text with fewer words than a shingle
is one shingle; repeated rows share a class; a null id takes part but is never the
smallest unless all are null; ids may be of any type with an order; an empty table gives
an empty one. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import majority, shingle_hashes

WORDS = 4
BITS = 64 * WORDS
#: Probability that a pair at the similarity shares a key.
FOUND = 0.987
#: Rows of a key that one group compares; of more, each pair of blocks of half the size is a group.
BLOCK = 16384
#: Texts whose shingles are counted for the order, and in how many of them a frequent shingle is.
SAMPLE, FREQUENT = 8192, 4
#: Bits of a parity sketch at least; pairs that are gathered before they go on.
SKETCH, GATHERED = 1024, 1 << 18
#: Block pairs are broadcast up to so many heavy keys.
FEW = 100_000
FP = [f"w{k}" for k in range(WORDS)]


def differing(similarity: float) -> float:
    """Share of bits in which a pair of this Jaccard similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tau(similarity: float) -> int:
    """Bits in which a pair of this Jaccard similarity may differ."""
    p = differing(similarity)
    return int(BITS * p + 1.65 * math.sqrt(BITS * p * (1 - p)))


def tables_for(n: int, similarity: float) -> np.ndarray:
    """Bits of each table's key for n sets."""
    width = min(max(n - 1, 1).bit_length(), 48)
    shared = (1 - differing(similarity)) ** width
    count = math.ceil(math.log(1 - FOUND) / math.log1p(-shared)) if shared < 1 else 1
    return np.array([np.random.default_rng(t).permutation(BITS)[:width] for t in range(count)])


def grams(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def digest(h: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def wide(text: bytes, shingle: int) -> np.ndarray:
    """Four words of majority bits over the distinct shingles."""
    return folded(grams(text, shingle))


def folded(h: np.ndarray) -> np.ndarray:
    mixed = np.empty((len(h), WORDS), "<u8")
    for k in range(WORDS):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed[:, k] = x ^ x >> np.uint64(31)
    return majority(mixed)


def least_shared(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles that sets of n in all, both counted, share at the similarity; a rounding error asks for fewer."""
    return np.ceil(n * (similarity / (1 + similarity)) - 1e-6)


def head(h: np.ndarray, similarity: float, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles, one of which any set of the similarity shares: by how often the sample has them, then by hash."""
    most = len(h) - math.ceil(similarity * len(h) - 1e-6) + 1
    if len(h) and len(often):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        n = np.where(often[at] == h, times[at], 0)
        if n.any():
            h = h[np.argsort(n, kind="stable")]
    return h[:most]


def sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; as many bits as shingles at least, a power of two, so that long texts are told apart too."""
    bits = max(SKETCH, 1 << max(len(h) - 1, 0).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


class Sketches:
    """Sketches of several sizes side by side; the larger of two is folded onto the smaller."""

    def __init__(self, sketches: np.ndarray):
        self.size = np.array([len(x) for x in sketches], np.int64)
        self.place = np.zeros(len(sketches), np.int64)
        self.rows = {}
        for k in np.unique(self.size).tolist():
            of = np.flatnonzero(self.size == k)
            self.place[of] = np.arange(len(of))
            self.rows[k] = np.frombuffer(b"".join(sketches[of]), "<u8").reshape(len(of), -1)

    def _folded(self, i: np.ndarray, size: int, to: int) -> np.ndarray:
        x = self.rows[size][self.place[i]]
        while size > to:
            size //= 2
            x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
        return x

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of each pair."""
        out = np.zeros(len(a), np.int64)
        kinds, which = np.unique(np.column_stack([self.size[a], self.size[b]]), axis=0, return_inverse=True)
        for k, (x, y) in enumerate(kinds.tolist()):
            of = np.flatnonzero(which.reshape(-1) == k)
            step = max(1, (1 << 24) // max(x, y))  # bytes at once
            for lo in range(0, len(of), step):
                i = of[lo:lo + step]
                out[i] = np.bitwise_count(self._folded(a[i], x, min(x, y)) ^ self._folded(b[i], y, min(x, y))).sum(1, dtype=np.int64)
        return out


def frequent(docs: DataFrame, shingle: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that FREQUENT of SAMPLE texts have, and how many have them."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    sample = docs.select(F.col(text_col).alias("text")).where(F.xxhash64(F.lit("order"), "text").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)))

    def run(batches):
        for batch in common.slices(batches):
            for t in set(common.texts_of(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(grams(t, shingle).view(np.int64))], names=["g"])

    found = sample.mapInArrow(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    g, n = (found.column(k).to_numpy() for k in ("g", "n"))
    order = np.argsort(g.view(np.uint64))
    return g.view(np.uint64)[order], n[order]


def fingerprints(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str, ordered) -> DataFrame:
    """id, a 128-bit hash of the text, the four words, the digest, the number of shingles, the first ones and the sketch of every row.

    ordered: the frequent shingles, broadcast."""

    def run(batches):
        common.let_go()
        often, times = ordered.value
        for batch in common.slices(batches):
            sets = [grams(t, shingle) for t in common.texts_of(batch.column(2))]
            fps = np.array([folded(h) for h in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            d = pa.array([digest(h) for h in sets], pa.int64())
            n = pa.array([len(h) for h in sets], pa.int64())
            first = pa.array([head(h, similarity, often, times).view(np.int64) for h in sets], pa.list_(pa.int64()))
            cols = [batch.column(0), batch.column(1), *(pa.array(fps[:, k]) for k in range(WORDS)), d, n, first, pa.array([sketch(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h", *FP, "d", "n", "head", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), common.text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h string, " + ", ".join(f"{c} long" for c in (*FP, "d", "n")) + ", head array<bigint>, sketch binary")


def keys(fp: np.ndarray, tables: np.ndarray) -> Iterator[np.ndarray]:
    """For each table the key of every row of fp (n, 4), with the table's number above it."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), BITS // 8), axis=1, bitorder="little")
    width = tables.shape[1]
    weight = (1 << np.arange(width)).astype(np.int64)
    for t, places in enumerate(tables):
        yield bits[:, places] @ weight + (t << width)


def near(fp: np.ndarray, one: np.ndarray, most: int) -> np.ndarray:
    """Which rows of fp are within `most` bits of one."""
    return np.flatnonzero(distance(fp, one, most) <= most)


def distance(fp: np.ndarray, one: np.ndarray, most: int) -> np.ndarray:
    """Differing bits of the rows that a chain admits; of the others more than `most`."""
    c = np.bitwise_count(fp ^ one)
    chain = np.zeros(len(c), bool)
    for i in range(WORDS):
        chain |= (c[:, i] <= most // WORDS) & (c[:, i].astype(np.int16) + c[:, (i + 1) % WORDS] <= 2 * most // WORDS)
    out = np.full(len(c), BITS + 1, np.int16)
    found = np.flatnonzero(chain)
    out[found] = c[found].sum(1, dtype=np.int16)
    return out


def forest(fp: np.ndarray, rep: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A minimum spanning forest of a group's links: the row nearest to the rows so far comes next."""
    us, vs = [], []
    left = np.arange(1, len(fp))
    to, best, at = np.zeros(len(left), np.int64), np.full(len(left), BITS + 1, np.int16), 0
    while len(left):
        d = distance(fp[left], fp[at], most)
        closer = d < best
        to[closer], best[closer] = at, d[closer]
        k = int(best.argmin())
        at = int(left[k])
        if best[k] <= most:
            us.append(int(rep[to[k]]))
            vs.append(int(rep[at]))
        left[k], to[k], best[k] = left[-1], to[-1], best[-1]
        left, to, best = left[:-1], to[:-1], best[:-1]
    return us, vs


def _link_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, pair, rep, words) sorted by g, pair: links of each run, runs cut across batches kept whole."""
    held = None

    def links(rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        us, vs = [], []
        begin, end = np.r_[0, edge], np.r_[edge, len(rows)]
        size = end - begin
        two = begin[size == 2]  # most runs: all at once
        a, b = rows[two], rows[two + 1]
        c = np.bitwise_count(a[:, 3:].view(np.uint64) ^ b[:, 3:].view(np.uint64)).sum(1, dtype=np.int64) <= most
        us += a[c, 2].tolist()
        vs += b[c, 2].tolist()
        for lo, hi in zip(begin[size > 2].tolist(), end[size > 2].tolist()):
            u, v = forest(rows[lo:hi, 3:].view(np.uint64), rows[lo:hi, 2], most)
            us += u
            vs += v
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + WORDS)])
        if held is not None:
            rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        other = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = rows[cut:]
        if cut:
            yield links(rows[:cut])
    if held is not None and len(held):
        yield links(held)


def _dealt(rows: DataFrame, heavy: DataFrame, block: int) -> DataFrame:
    """Adds `pair`: rows of a heavy g (g, n) go to every pair of blocks that holds their own."""
    found = heavy.count()
    if not found:
        return rows.withColumn("pair", F.lit(0).cast("long"))
    blocks = heavy.select("g", F.ceil(F.col("n") * 2 / block).cast("long").alias("m"))
    rows = rows.join(F.broadcast(blocks) if found <= FEW else blocks, "g", "left")
    own = F.pmod(F.xxhash64("rep"), F.col("m"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.least(own, j) * F.col("m") + F.greatest(own, j))
    return rows.withColumn("pair", F.explode(F.when(F.col("m").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))


def links(distinct: DataFrame, most: int, tables: np.ndarray, block: int = 0) -> DataFrame:
    """Candidate links (u < v) between nodes. distinct: the words and rep."""
    block = block or BLOCK

    def keyed(batches):
        for batch in batches:
            words = [batch.column(k) for k in range(1, 1 + WORDS)]
            for g in keys(np.column_stack([w.to_numpy() for w in words]), tables):
                yield pa.RecordBatch.from_arrays([pa.array(g), batch.column(0), *words], names=["g", "rep", *FP])

    def only(batches):
        for batch in batches:
            fp = np.column_stack([batch.column(k).to_numpy() for k in range(WORDS)])
            for g in keys(fp, tables):
                g, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], names=["g", "n"])

    rows = distinct.select("rep", *FP).mapInArrow(keyed, "g long, rep long, " + ", ".join(f"{c} long" for c in FP))
    heavy = distinct.select(*FP).mapInArrow(only, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    rows = _dealt(rows, common.written(heavy, "heavy-keys"), block)
    ordered = rows.select("g", "pair", "rep", *FP).repartition("g", "pair").sortWithinPartitions("g", "pair")
    found = ordered.mapInArrow(lambda batches: _link_runs(batches, most), "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _whole(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of numbers sorted by their first two columns, g and pair, groups kept whole, and the binary column behind, if there is one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
        more = np.array([b"", *(batch.column(columns).to_pylist() if batch.num_columns > columns else [])], object)[1:]
        if held is not None:
            now, more = np.concatenate([held[0], now]), np.concatenate([held[1], more])
        other = np.flatnonzero((now[:, 0] != now[-1, 0]) | (now[:, 1] != now[-1, 1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = now[cut:], more[cut:]
        if cut:
            yield now[:cut], more[:cut]
    if held is not None:
        yield held


def _admitted(rows: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in one group of rows (g, pair, rep, root, n, place): of other roots, sizes and places that admit the similarity."""
    group = np.cumsum(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
    root, n, left = rows[:, 3], rows[:, 4], rows[:, 4] - rows[:, 5]
    a, lag = np.arange(len(rows)), 0
    while len(a):  # every row with the next of its group, the one after it and so on
        lag += 1
        a = a[a + lag < len(rows)]
        a = a[group[a] == group[a + lag]]
        b = a + lag
        ok = (root[a] != root[b]) & (np.minimum(left[a], left[b]) >= least_shared(n[a] + n[b], similarity))
        if ok.any():
            yield a[ok], b[ok]


def _members(rows: np.ndarray, similarity: float) -> np.ndarray:
    """Of rows as in _admitted those that have a partner, each once however many it has."""
    begin = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
    use = np.minimum.reduceat(rows[:, 3], begin) != np.maximum.reduceat(rows[:, 3], begin)
    rows = rows[np.repeat(use, np.diff(np.r_[begin, len(rows)]))]
    some = np.zeros(len(rows), bool)
    for a, b in _admitted(rows, similarity):
        some[a] = some[b] = True
    return rows[some]


def _meetings(rows: np.ndarray, sketches: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows as in _admitted whose sketches admit the similarity too."""
    rep, n, of = rows[:, 2], rows[:, 4], Sketches(sketches)
    us, vs, held = [], [], 0

    def flush():
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for a, b in _admitted(rows, similarity):
        both = n[a] + n[b]
        ok = of.differing(a, b) <= both - 2 * least_shared(both, similarity)
        if ok.any():
            us.append(rep[a[ok]])
            vs.append(rep[b[ok]])
            held += len(us[-1])
            if held >= GATHERED:
                yield flush()
                us, vs, held = [], [], 0
    if us:
        yield flush()


def missed(rows: DataFrame, nodes: DataFrame, similarity: float, often: np.ndarray, block: int = 0) -> DataFrame:
    """Pairs (u < v) of other classes that may have the similarity: all that have it are among them.

    rows: id, h, n, head, sketch. nodes: rep with the id and text hash of one of its rows, and its root so far."""
    block = block or BLOCK
    spark = rows.sparkSession
    names = ["g", "pair", "rep", "root", "n", "place"]
    gone: list[str] = []

    def gather(batches):
        for now, _ in _whole(batches, len(names)):
            found = _members(now, similarity)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names=names)

    def meet(batches):
        for now in _whole(batches, len(names)):
            yield from _meetings(*now, similarity)

    of = nodes.select(F.col("id").alias("_nid"), F.col("h").alias("_nh"), "rep", "root")
    sets = rows.select("id", "h", "n", "head", "sketch").join(of, (F.col("h") == F.col("_nh")) & F.col("id").eqNullSafe(F.col("_nid")))
    sets = common.written(sets.select("rep", "root", "n", "head", "sketch"), "heads", gone)
    dealt = sets.select(F.posexplode("head").alias("place", "g"), "rep", "root", "n").select("g", "rep", "root", "n", F.col("place").cast("long").alias("place"))
    known = spark.createDataFrame([(int(g),) for g in often.view(np.int64)], "g long")
    heavy = dealt.join(F.broadcast(known), "g").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    dealt = _dealt(dealt, common.written(heavy, "heavy-shingles", gone), block)
    ordered = dealt.select(*names).repartition("g", "pair").sortWithinPartitions("g", "pair")
    # rows without a partner need no sketch; the pairs of the others are judged before they are rows
    members = common.written(ordered.mapInArrow(gather, ", ".join(f"{c} long" for c in names)), "members", gone)
    sketches = sets.select("rep", "sketch").dropDuplicates(["rep"])
    ordered = members.join(sketches, "rep").select(*names, "sketch").repartition("g", "pair").sortWithinPartitions("g", "pair")
    pairs = common.written(ordered.mapInArrow(meet, "u long, v long").distinct(), "meetings")
    common.remove(spark, gone)
    return pairs


def checked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str, gone: list[str] | None = None) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are similar enough. nodes: rep with the id and text hash of one of its rows.

    The path of the table that only the result reads is added to `gone`."""

    def run(batches):
        for batch in batches:
            for part in common.slices([batch]):
                sets = [pa.array(grams(t, shingle).view(np.int64)) for t in common.texts_of(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "grams"])

    ends = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    wanted = nodes.join(ends, "rep").select(F.col("id").alias("_nid"), F.col("h").alias("_nh"), "rep")
    texts = docs.select(F.col(id_col).alias("_did"), common.text_hash(F.col(text_col)).alias("_dh"), F.col(text_col).alias("_text"))
    found = texts.join(wanted, (F.col("_dh") == F.col("_nh")) & F.col("_did").eqNullSafe(F.col("_nid"))).select("_text", "rep")
    sets = common.written(found.mapInArrow(run, "rep long, grams array<bigint>").dropDuplicates(["rep"]), "grams", gone)
    a, b = (sets.select(F.col("rep").alias(c), F.col("grams").alias(f"g{c}")) for c in "uv")
    both = F.size(F.array_intersect("gu", "gv"))
    enough = both >= F.lit(similarity) * (F.size("gu") + F.size("gv") - both)
    return pairs.join(a, "u").join(b, "v").where(enough).select("u", "v")


def classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, component_id (smallest id of the class of texts linked at the similarity) and kept of every row.

    Of each class the smallest id is kept, of rows that share it the one with the smallest
    hash; rows that repeat both id and text are one document and stay together.
    """
    often, times = frequent(docs, shingle, text_col)
    ordered = docs.sparkSession.sparkContext.broadcast((often, times))  # bounded by the sample's size
    rows = common.written(fingerprints(docs, shingle, similarity, id_col, text_col, ordered), "fingerprints")  # computed once, read often
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    distinct = rows.groupBy(*FP, "d").agg(first).select(*FP, "d", "first", F.monotonically_increasing_id().alias("rep"))
    distinct = common.written(distinct, "distinct")
    gone: list[str] = []  # tables that later steps do not read
    pairs = common.written(links(distinct, tau(similarity), tables_for(distinct.count(), similarity)), "candidates", gone)
    nodes = distinct.select("rep", "first.id", "first.h")
    roots = components(checked(pairs, docs, nodes, similarity, shingle, id_col, text_col, gone)).select(F.col("node").alias("rep"), "root")
    linked = common.written(distinct.select("rep", "first").join(roots, "rep", "left").select("rep", "first", F.coalesce("root", "rep").alias("root")), "linked")
    common.remove(docs.sparkSession, gone)
    more = missed(rows, linked.select("rep", "root", "first.id", "first.h"), similarity, often)
    more = common.written(checked(more, docs, nodes, similarity, shingle, id_col, text_col, gone), "late-links")
    common.remove(docs.sparkSession, gone)
    if not more.isEmpty():
        a, b = (linked.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
        joined = components(more.join(a, "u").join(b, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
        linked = linked.join(joined, "root", "left").select("rep", "first", F.coalesce("to", "root").alias("root"))
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    named = distinct.select("rep", *FP, "d").join(linked.select("rep", "root"), "rep").join(best, "root").select(*FP, "d", "best")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    return rows.join(named, [*FP, "d"]).select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("best.id").alias("component_id"), kept.alias("kept"))


def keepers(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns and no others, whatever their names."""
    gone = classes(docs, similarity, shingle, id_col, text_col).where("NOT kept")
    key, a, b = (common.free_name(docs.columns, n) for n in ("key", "gone_id", "gone_hash"))
    gone = gone.select(F.col(id_col).alias(a), F.col("text_hash").alias(b))
    rows = docs.withColumn(key, common.text_hash(F.col(text_col)))
    return rows.join(gone, F.col(id_col).eqNullSafe(F.col(a)) & (F.col(key) == F.col(b)), "left_anti").drop(key)
