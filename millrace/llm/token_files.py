"""Token-id files with Re-Pair grammar compression.

Documents are range-partitioned by id and sorted, encoded with a public tokenizer, ended
by an end id, and cut into shards of SHARD_IDS ids. Each shard is compressed by Re-Pair:
the most frequent adjacent id pairs are replaced by new symbols until no pair occurs
LEAST times, and
rules and expansion lengths are stored, so that any span of ids is decoded by finding
its symbols in the running sum of expansion lengths, without the rest of the shard.

Each round replaces the most frequent pairs that share no symbol with one another in a
way that could overlap (none starts with a symbol that another ends with), which is what
as many single replacements in that order would do.

Shards are rows of a Parquet table in the shared folder (partition, shard, first id
position within the partition, document ids and lengths, payload), written and read by
Spark alone. Payload format: magic `RPG1`, four little-endian unsigned 32-bit numbers
(symbols below which an id stands for itself, rules, sequence length, ids), rules as
pairs of u32, expansion lengths as u32, sequence as u32; all after the magic deflated.

Rows: a null text is empty and has the end id alone; repeated ids stay next to each
other, in the order of their texts' hash; a null id sorts first; an empty table writes
no shard and gives an empty one. Only id and text are read, so others may clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .pretokens import CACHE_CHUNK_LEN, chunks

SHARD_IDS = 1 << 20
#: Rules of a round and occurrences a rule needs.
RULES_A_ROUND, LEAST = 256, 16
#: Distinct chunks remembered per worker.
CACHE_CHUNKS = 1_000_000
#: New chunks that are encoded as one text.
JOINED = 256
MAGIC = b"RPG1"


def _pairs(seq: np.ndarray, where: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The adjacent pairs as numbers; of some places only, if these are given."""
    return seq[:-1][where].astype(np.int64) << 32 | seq[1:][where]


def _counted(seq: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct adjacent pairs as numbers and their counts."""
    return np.unique(seq[:-1].astype(np.int64) * base + seq[1:], return_counts=True)


def _frequent(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs that occur LEAST times and their counts."""
    pairs, n = np.unique(pairs, return_counts=True)
    return pairs[n >= LEAST], n[n >= LEAST]


def _places(seq: np.ndarray, made: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs (sorted) are replaced, left to right, and which one is there."""
    first, last = np.zeros(made, bool), np.zeros(made, bool)
    first[pairs >> 32], last[pairs & 0xFFFFFFFF] = True, True
    where = np.flatnonzero(first[seq[:-1]] & last[seq[1:]])  # the few positions worth a search
    key = _pairs(seq, where)
    at = np.searchsorted(pairs, key)
    at[at == len(pairs)] = 0
    hit = pairs[at] == key
    where, at = where[hit], at[hit]
    if len(where):  # only a pair of equal symbols can overlap itself: keep every second of a run
        run = np.r_[True, np.diff(where) != 1]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        keep = (np.arange(len(where)) - begin) % 2 == 0
        where, at = where[keep], at[keep]
    return where, at


def _replace(seq: np.ndarray, where: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The pairs at some places by their names."""
    out = seq.copy()
    out[where] = names
    gone = np.ones(len(seq), bool)
    gone[where + 1] = False
    return out[gone]


def _around(where: np.ndarray, steps: tuple[int, ...], pairs: int) -> np.ndarray:
    """Distinct places of pairs next to some places."""
    near = np.zeros(pairs, bool)
    for k in steps:
        i = where + k
        near[i[(i >= 0) & (i < pairs)]] = True
    return np.flatnonzero(near)


def compress(ids: np.ndarray) -> bytes:
    """Re-Pair one shard.

    Pairs are counted once. A replacement makes pairs with its new symbol only, all of them
    in its round, and takes others away, so counts follow from the places around it, and
    what once occurs less than LEAST times is never counted again.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    made = base
    pairs, n = _frequent(_pairs(seq))
    while len(pairs):
        top = np.argpartition(-n, min(4 * RULES_A_ROUND, len(n)) - 1)[:4 * RULES_A_ROUND]
        top = top[np.lexsort((pairs[top], -n[top]))]
        firsts, lasts, chosen = set(), set(), []
        for p in pairs[top].tolist():
            a, b = p >> 32, p & 0xFFFFFFFF
            if len(chosen) == RULES_A_ROUND:
                break
            if (a == b and (a in firsts or a in lasts)) or a in lasts or b in firsts:
                continue
            firsts.add(a), lasts.add(b), chosen.append(p)
        best = np.sort(np.array(chosen, np.int64))
        where, at = _places(seq, made, best)
        lost = _pairs(seq, _around(where, (-1, 0, 1), len(seq) - 1))
        seq = _replace(seq, where, (at + made).astype(np.uint32))
        found = _frequent(_pairs(seq, _around(where - np.arange(len(where)), (-1, 0), len(seq) - 1)))
        of = np.minimum(np.searchsorted(pairs, lost), len(pairs) - 1)
        n = n - np.bincount(of[pairs[of] == lost], minlength=len(pairs))
        pairs, n = (np.concatenate([x[n >= LEAST], y]) for x, y in zip((pairs, n), found))
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        rules.append(np.column_stack([best >> 32, best & 0xFFFFFFFF]).astype("<u4"))
        made += len(best)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), "<u4")
    lengths = np.ones(made, np.uint32)
    for i, (a, b) in enumerate(table.tolist()):
        lengths[base + i] = lengths[a] + lengths[b]
    body = table.tobytes() + lengths[base:].astype("<u4").tobytes() + seq.astype("<u4").tobytes()
    return MAGIC + zlib.compress(struct.pack("<4I", base, len(table), len(seq), len(ids)) + body, 1)


class Shard:
    """A shard's grammar, ready to decode any span of ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        raw = zlib.decompress(payload[4:])
        self.base, rules, n, self.ids = struct.unpack_from("<4I", raw)
        rest = np.frombuffer(raw, "<u4", offset=16)
        self.rules = rest[:2 * rules].reshape(-1, 2)
        self.seq = rest[3 * rules:3 * rules + n]
        lengths = np.r_[np.ones(self.base, np.int64), rest[2 * rules:3 * rules].astype(np.int64)]
        self.ends = np.cumsum(lengths[self.seq])

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while len(seq) and (big := seq >= self.base).any():
            times = np.where(big, 2, 1)
            out = np.repeat(seq, times)
            first = (np.cumsum(times) - times)[big]
            pair = self.rules[seq[big] - self.base]
            out[first], out[first + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def span(self, start: int, n: int) -> np.ndarray:
        """ids[start:start + n]."""
        if n <= 0 or start >= self.ids:
            return np.zeros(0, np.uint32)
        lo = int(np.searchsorted(self.ends, start, "right"))
        hi = int(np.searchsorted(self.ends, min(start + n, self.ids), "left")) + 1
        skip = start - (int(self.ends[lo - 1]) if lo else 0)
        return self._expand(self.seq[lo:hi])[skip:skip + n]


class _Encoder:
    """Ids by the tokenizers library, added tokens included; each distinct chunk is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        vocabulary = self.tool.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id's token: a character of the byte-level alphabet each
        for token, i in vocabulary.items():
            self.width[i] = len(token)

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        found = self.known
        # a text with an added token's string is encoded whole: the library looks for these before it cuts
        whole = {i: np.array(self.tool.encode(t, add_special_tokens=False).ids, "<u4") for i, t in enumerate(texts) if any(x in t for x in self.special)}
        cut = [[] if i in whole else chunks(t) for i, t in enumerate(texts)]
        new = list(set().union(*cut).difference(found))
        long = [c for c in new if len(c) > CACHE_CHUNK_LEN]
        joins = [len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace() for c in new]
        alone = [c for c, x in zip(new, joins) if not x]
        new = [c for c, x in zip(new, joins) if x]  # these may follow one another: the library would cut between them
        for at in range(0, len(new), 4096):
            groups = [new[i:i + JOINED] for i in range(at, min(at + 4096, len(new)), JOINED)]
            for part, e in zip(groups, self.tool.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends, wanted = np.cumsum(self.width[ids]), np.cumsum([len(c.encode()) for c in part])
                i = np.searchsorted(ends, wanted)
                if len(ids) and i[-1] < len(ids) and (ends[i] == wanted).all() and not any(x in "".join(part) for x in self.special):
                    raw, last = ids.tobytes(), 0
                    for c, k in zip(part, (4 * (i + 1)).tolist()):
                        found[c] = raw[last:k]
                        last = k
                else:
                    alone += part
        for at in range(0, len(alone), 4096):
            part = alone[at:at + 4096]
            for c, e in zip(part, self.tool.encode_batch_fast(part, add_special_tokens=False)):
                found[c] = np.array(e.ids, "<u4").tobytes()
        for i, parts in enumerate(cut):
            yield whole[i] if i in whole else np.frombuffer(b"".join(map(found.__getitem__, parts)), "<u4")
        for c in long:
            del found[c]


def _encoder(path: str) -> _Encoder:
    """The worker's encoder; built once per worker and reused by its later tasks."""
    return common.kept(("encoder", path), lambda: _Encoder(path))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write the shards of all documents to a folder in the shared store."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    names = ["partition", "shard", "offset", "doc_ids", "lengths", "payload"]

    def run(batches):
        tool, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        ids, lengths, flat, held, offset, shard = [], [], [], 0, 0, 0

        def flush():
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([offset], pa.int64()), pa.array([ids], pa.list_(arrow_id)), pa.array([lengths], pa.list_(pa.int64())), pa.array([compress(np.concatenate(flat))], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in common.slices(batches, 256):
            for key, part_ids in zip(batch.column(0).to_pylist(), tool.many([t or "" for t in batch.column(1).to_pylist()])):
                one = np.append(part_ids, np.uint32(end_id))
                ids.append(key), lengths.append(len(one)), flat.append(one)
                held += len(one)
                if held >= SHARD_IDS:
                    yield flush()
                    ids, lengths, flat, offset, held, shard = [], [], [], offset + held, 0, shard + 1
        if ids:
            yield flush()

    kind = id_type.simpleString()
    ordered = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).repartitionByRange(partitions, "_id").sortWithinPartitions("_id", F.xxhash64("_text"))
    ordered.mapInArrow(run, f"partition int, shard int, offset long, doc_ids array<{kind}>, lengths array<bigint>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it) and ids of every document, from the files."""
    shards = spark.read.parquet(path)
    element = shards.schema["doc_ids"].dataType.elementType
    arrow_id = to_arrow_type(element)
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    per = shards.groupBy("partition").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = per.select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))  # a row for each range partition

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                base, offset, ids, lengths, payload = (batch.column(k)[i] for k in range(5))
                shard = Shard(payload.as_py())
                n = lengths.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(n)
                keys = ids.values
                for lo in range(0, len(n), 256):
                    hi = min(lo + 256, len(n))
                    start, stop = int(ends[lo] - n[lo]), int(ends[hi - 1])
                    flat = shard.span(start, stop - start).astype(np.int32)
                    offsets = pa.array(np.r_[0, ends[lo:hi] - start].astype(np.int32))
                    begin = pa.array(base.as_py() + offset.as_py() + ends[lo:hi] - n[lo:hi], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys[lo:hi].cast(arrow_id), begin, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[id_col, "start", "ids"])

    rows = shards.join(F.broadcast(bases), "partition").select("base", "offset", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(run, f"`{id_col}` {element.simpleString()}, start long, ids array<int>")


def checksums(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the crc32 of the ids as little-endian unsigned 32-bit numbers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "start", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = common.scratch_path(spark, "token-files")
    write(common.documents(spark, sf_dir), path, public.path("byte_bpe_50k.json"))
    return checksums(read(spark, path))
