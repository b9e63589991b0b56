"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint bit is 1 where it is set in more than half of the hashes of a text's word
shingles. Fingerprints within `TAU` = 3 bits are linked and components of links share
the smallest id.

Pigeonring: cut 64 bits into a ring of 8 segments. If two fingerprints differ in at
most 3 bits, some segment i starts a chain i, i+1, ... whose cumulative differences over
every l segments are at most 3 l / 8: none over two segments, one over five. So segments
i and i+1 are equal, and of the next three two are: 8 x 3 keys of 32 bits find every
pair. The chain budgets (0, 0, 1, 1, 1, 2, 2, 3) then prune candidates before the full
Hamming check. Rows of one key that are too many to compare (near copies in thousands)
are cut again: of the eight 4-bit parts of the other 32 bits five are equal, 56 keys of
52 bits, so that at most 4096 distinct fingerprints share one.

Work is on distinct fingerprints: a group of copies of any size is one row. Of a key's
rows only links of a spanning forest leave the task, not all pairs.

Rows: a null or empty text has fingerprint zero and is linked like any other; a text
with fewer words than a shingle is one shingle; repeated rows share a component; a null
id takes part but is never the smallest unless all are null; ids may be of any type with
an order; an empty table gives an empty one. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

TAU, SEGMENTS, WIDTH = 3, 8, 8
#: Fingerprints of one key that are compared directly; more are cut into finer keys.
DIRECT = 1024


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; of fewer words, of all of them."""
    w = text.lower().split()
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], "<u8")
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    begin = [0, *ends[:-shingle].tolist()]
    return np.array([digest(line[a:b], 42) for a, b in zip(begin, (ends[shingle - 1:] - 1).tolist())], "<u8")


def majority(values: np.ndarray) -> np.ndarray:
    """Of (n, k) words of 64 bits, the k words of bits that more than half of the rows set."""
    n, k = values.shape
    bits = np.zeros(64 * k, np.int64)
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8 * k)
    for at in range(0, n, 255):  # 255 ones fit a byte, so that the sums stay in narrow lanes
        bits += np.unpackbits(raw[at:at + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(bits * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of XXH64 (seed 42) over word shingles."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `fp` (64 bits in a long) of every row."""

    def run(batches):
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in common.texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _keys(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(table, key): segments i, i+1 and two of the three after them; table = 3 i + the one left out."""
    seg = [(fp >> np.uint64(WIDTH * i)) & np.uint64(255) for i in range(SEGMENTS)]
    for i in range(SEGMENTS):
        a, b, c, d, e = (seg[(i + j) % SEGMENTS] for j in range(5))
        for out, (x, y) in enumerate(((d, e), (c, e), (c, d))):
            yield 3 * i + out, a | b << np.uint64(8) | x << np.uint64(16) | y << np.uint64(24)


_FREE = [[(i + j) % SEGMENTS for j in (2 + out, 5, 6, 7)] for i in range(SEGMENTS) for out in range(3)]
_FIVE = [[j for j in range(8) if not m >> j & 1] for m in range(256) if bin(m).count("1") == 3]


def _fine_keys(fp: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The 56 choices of five of the eight 4-bit parts that a table's key leaves open."""
    shift = np.array(_FREE, np.uint64)[table] * np.uint64(8)
    parts = []
    for j in range(8):
        parts.append((fp >> (shift[:, j // 2] + np.uint64(4 * (j % 2)))) & np.uint64(15))
    for n, five in enumerate(_FIVE):
        key = np.zeros(len(fp), np.uint64)
        for at, j in enumerate(five):
            key |= parts[j] << np.uint64(4 * at)
        yield n, key


def chain_holds(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pigeonring test of differences x from a segment on: every chain stays within its share of TAU."""
    total, good = np.zeros(len(x), np.uint8), np.ones(len(x), bool)
    for l in range(SEGMENTS):
        s = ((start + l) % SEGMENTS).astype(np.uint64) * np.uint64(WIDTH)
        total = total + np.bitwise_count((x >> s) & np.uint64(255))
        good &= total <= TAU * (l + 1) // SEGMENTS
    return good


def _pairs_by_lag(group: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal group (sorted): indices of both ends, compared lag by lag, forest per row."""
    left, right = [], []
    alive = np.arange(len(fp) - 1)
    lag = 1
    while len(alive):
        alive = alive[alive + lag < len(fp)]
        alive = alive[group[alive] == group[alive + lag]]
        if not len(alive):
            break
        x = fp[alive] ^ fp[alive + lag]
        near = alive[chain_holds(x, start[alive])]  # the last budget is the full Hamming check
        left.append(near)
        right.append(near + lag)
        lag += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(left: np.ndarray, right: np.ndarray, rep: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links, as pairs of representatives."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := up.get(i, i)) != i:
            up[i] = up.get(p, p)
            i = p
        return i

    us, vs = [], []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            us.append(int(rep[a]))
            vs.append(int(rep[b]))
    return us, vs


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g1, g2, table, fp, rep) sorted by g1, g2: links within each run, runs cut across batches kept whole."""
    held = None

    def links(cols):
        g1, g2, table, fp, rep = cols
        step = np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]
        a, b = _pairs_by_lag(np.cumsum(step), fp.view(np.uint64), table // 3)
        u, v = _forest(a, b, rep)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield links([c[:cut] for c in cols])
    if held is not None and len(held[0]):
        yield links(held)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between representatives of fingerprints within TAU bits. distinct: fp, rep."""

    def coarse(batches):
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(), batch.column(1)
            for table, key in _keys(fp.view(np.uint64)):
                g = (np.uint64(table) << np.uint64(32) | key).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), batch.column(0), rep], names=["g", "fp", "rep"])

    keyed = common.written(distinct.select("fp", "rep").mapInArrow(coarse, "g long, fp long, rep long"), "keyed")
    # counted by a pre-aggregated group, not in a window, so that no task gathers a key's rows
    shared = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("g").alias("k"), "n")
    counted = common.written(keyed.join(shared, F.col("g") == F.col("k")).select("g", "fp", "rep", "n"), "shared")  # read twice below
    small = counted.where(F.col("n") <= DIRECT)

    def fine(batches):
        for batch in batches:
            g, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for n, key in _fine_keys(fp.view(np.uint64), (g >> 32)):
                k = (np.uint64(n) << np.uint64(32) | key).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k), batch.column(1), batch.column(2)], names=["g1", "g2", "fp", "rep"])

    large = counted.where(F.col("n") > DIRECT).select("g", "fp", "rep").mapInArrow(fine, "g1 long, g2 long, fp long, rep long")
    rows = small.select(F.col("g").alias("g1"), F.lit(0).cast("long").alias("g2"), "fp", "rep").unionByName(large)
    rows = rows.select("g1", "g2", F.shiftright("g1", 32).alias("table"), "fp", "rep")
    ordered = rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "fp")
    return ordered.mapInArrow(_link_runs, "u long, v long").distinct()


def near_classes(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (smallest id of the class) of every row."""
    rows = common.written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")  # computed once, used three times
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("fp", F.col("fp").alias("rep"))))  # fingerprints are the nodes
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    # the key is an expression, so that both sides of the join are shuffled for it and a fingerprint of very many rows can be split
    key = F.col("fp").bitwiseOR(F.lit(0).cast("long")).alias("_k")
    named = of.join(smallest, "root").select(key, "component_id")
    return rows.join(named, F.col("fp") == F.col("_k"), "left").select(id_col, "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
