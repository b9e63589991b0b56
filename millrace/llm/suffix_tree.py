"""Language-model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of any number of words before a symbol. A context is kept
where the divergence of its next-symbol distribution from its suffix's, estimated by
leaving each occurrence out of its own counts, passes both a total and a mean threshold.
Contexts grow word by word to the left: one is a candidate if it is seen LEAST times and
the symbols after its suffix still cost more than GAIN nats in all there, the least that
any longer context would have to gain, and if that suffix is itself set off from its own
by one word in SPLIT at least (inside a shared passage the words before are always the
same, and a longer context has the same occurrences). The loop over lengths ends when no candidate is
left; there is no other bound. Distributions are smoothed along the suffixes:
P(s|c) = (n(c,s) + WEIGHT P(s|suffix of c)) / (n(c) + WEIGHT); the root is absolutely
discounted, and what the discount takes off is the unknown symbol's probability. Each
token is scored in the longest kept suffix of the words before it (a suffix of a kept
context need not be kept itself).

Counting and lookup are one primitive: tasks turn texts into batches (token ids, hashes
of distinct words), written once and bucketed by batch, so that they never move again.
In each round a batch sends its distinct keys (words, contexts with their next symbols,
contexts) with numbers to nodes by hash; a node adds up what all batches sent and answers
each in its own key order. What is known is not asked: an n-gram whose shorter one stands in
one place alone or in no training text has one occurrence or none, and a context is the
n-gram of the level before that ends one token earlier, where that was counted (a word's is
the word's count). A level takes two rounds: counts, then gains by context. With
more than FAN batches the exchange has several stages, each with a fan of at most FAN,
that add up on the way: messages grow with the batches times the logarithm of their
number, and a hot word or context is one key of each sender. Nothing is gathered on the
driver but four totals.

Rows: a null text is empty and has the end token alone; empty texts, repeated rows and
null ids are scored like others (a null id is no held-out row); without training rows
every probability is 1 (score 0); an empty table gives an empty one. Only id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Occurrences a context needs; pseudo-count of its suffix; least gain in all and per occurrence (nats).
LEAST, WEIGHT, GAIN, MEAN_GAIN = 8, 6.0, 10.0, 0.02
#: A context grows on only if other words stand before its suffix once in so many times at least.
SPLIT = 10
#: Bytes of text in one batch, and receivers of a sender at most.
BATCH_BYTES, FAN = 4 << 20, 256
#: From this length on a batch's candidates are written instead of derived anew in each round.
CARRIED = 3
END_HASH = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Rows on the way: to a node or batch, from one, what the payload is.
ROWS = "node long, sender long, kind int, payload binary"
NAMES = ["node", "sender", "kind", "payload"]
MESSAGE, ANSWER, SCORES, STATISTICS, WORDS, WAITS = 0, 1, 2, 3, 4, 5
#: Parts of a nat in which sums of gains travel: whole numbers, the same in any order.
NAT = 1 << 16
#: What the nodes answer about a context.
STAYS, COSTS = np.uint8(1), np.uint8(2)


def counts_kind(level: int) -> int:
    return 10 * level


def gains_kind(level: int) -> int:
    return 10 * level + 1


def carried_kind(level: int) -> int:
    return 10 * level + 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed, signed numbers with the sign as the last bit; sorted 64-bit keys go as differences by the caller."""
    planes = []
    for a in arrays:
        kind, n = a.dtype.str, len(a)
        if a.dtype.kind == "i":
            a = a << 1 ^ a >> 8 * a.dtype.itemsize - 1
        planes.append((kind, n, np.ascontiguousarray(a.view(np.uint8).reshape(n, -1).T).tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        width = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1)
        if np.dtype(kind).kind == "i":
            a = a.view(kind.replace("i", "u"))
            a = (a >> 1).view(kind) ^ -(a & 1).view(kind)
        out.append(a.view(kind))
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence's hash and one more symbol's."""
    h = a * _MIX[0] + b
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ h >> np.uint64(32)


def _places(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below size in order, and each number's place among them, without a sort."""
    there = np.bincount(x, minlength=size) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=NAMES)


class Exchange:
    """Sums by key over all batches: how senders find nodes, and how nodes add up and answer.

    A node of stage s has a group of senders and the keys of one of fan^s ranges; groups
    shrink by the fan from stage to stage until one is left.
    """

    def __init__(self, batches: int, most: int):
        self.stages = 1
        while most ** self.stages < batches:
            self.stages += 1
        self.fan = 1
        while self.fan ** self.stages < batches:
            self.fan += 1

    def group_of(self, batch: int) -> int:
        return xxhash.xxh64_intdigest(batch.to_bytes(8, "little")) % self.fan ** (self.stages - 1)

    def send(self, sender: int, group: int, stage: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        """Rows to the nodes of a stage; keys are sorted, the columns run along them."""
        ranges = self.fan ** stage
        part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)  # ranges in the order of the keys
        edge = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(keys)] if len(keys) else [0]
        for lo, hi in zip(edge[:-1], edge[1:]):
            yield group * ranges + int(part[lo]), sender, MESSAGE, _pack(np.diff(keys[lo:hi], prepend=np.uint64(0)), *(c[lo:hi] for c in columns))

    @staticmethod
    def inbox(rows: pa.Table) -> tuple:
        """Distinct keys, sums of the columns, each message's keys as places among them, senders, ends."""
        rows = rows.filter(pc.equal(rows["kind"], MESSAGE)).sort_by("sender")  # sums in one order
        parts = [_unpack(b) for b in rows["payload"].to_pylist()]
        keys, where = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        sums = [np.bincount(where, np.concatenate([p[i] for p in parts]), minlength=len(keys)).astype(parts[0][i].dtype) for i in range(1, len(parts[0]))]
        return keys, sums, where, rows["sender"].to_pylist(), np.cumsum([len(p[0]) for p in parts])

    def answers(self, node: int, answer: list[np.ndarray], where: np.ndarray, senders: list[int], ends: np.ndarray) -> list[tuple]:
        return [(to, node, ANSWER, _pack(*(a[where[lo:hi]] for a in answer))) for to, lo, hi in zip(senders, np.r_[0, ends[:-1]], ends)]

    def run(self, sent: DataFrame, kind: int, answer: Callable[[list[np.ndarray]], list[np.ndarray]], statistics: bool = False, stage: int = 1, gone: list[str] | None = None) -> DataFrame:
        """The answers of a kind to all senders (and the statistics of the first sum), written.

        Rows that batches send to themselves come along as they are, so that messages are
        shuffled but never written with them.
        """

        own = F.col("node") < 0

        def last(rows: pa.Table) -> pa.Table:
            if rows["node"][0].as_py() < 0:  # a batch's own rows go past the nodes
                return rows
            keys, sums, *of = self.inbox(rows)
            out = self.answers(rows["node"][0].as_py(), answer(sums), *of)
            if statistics:
                n = sums[0][sums[0] > 0]
                out += [(k, int(x), STATISTICS, b"") for k, x in enumerate((n.sum(), len(n), (n == 1).sum(), (n == 2).sum()))]
            return _table(out)

        def on(rows: pa.Table) -> pa.Table:
            keys, sums, *_ = self.inbox(rows)
            node = rows["node"][0].as_py()
            return _table(list(self.send(node, node // self.fan ** stage // self.fan, stage + 1, keys, *sums)))

        def back(rows: pa.Table) -> pa.Table:
            of = self.inbox(rows)[2:]
            found = rows.filter(pc.equal(rows["kind"], ANSWER)).sort_by("sender")
            parts = [_unpack(b) for b in found["payload"].to_pylist()]
            joined = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
            return _table(self.answers(rows["node"][0].as_py(), joined, *of))

        if stage == self.stages:
            found = sent.groupBy("node").applyInArrow(last, ROWS)
        else:
            written = common.written(sent, "inbox", gone)
            held = written.where(~own)
            up = self.run(held.groupBy("node").applyInArrow(on, ROWS), ANSWER, answer, statistics, stage + 1, gone)
            found = held.unionByName(up.where(F.col("kind") == ANSWER)).groupBy("node").applyInArrow(back, ROWS)
            found = found.unionByName(up.where(F.col("kind") == STATISTICS)).unionByName(written.where(own))
        named = found.select(F.when(own, -1 - F.col("node")).otherwise(F.col("node")).alias("node"), "sender", F.when(F.col("kind") == ANSWER, F.lit(kind)).otherwise(F.col("kind")).cast("int").alias("kind"), "payload")
        # bucketed by batch like the batches, which then take their answers in every round without a shuffle
        done = common.bucketed(named, "answers", "node", gone) if stage == 1 else common.written(named, "answers", gone)
        del found, named
        common.release(done.sparkSession)
        return done


def _smoothed(n: np.ndarray, seen: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return (n + WEIGHT * suffix) / (seen + WEIGHT)


def _verdicts(sums: list[np.ndarray]) -> list[np.ndarray]:
    """By context: whether it stays, and whether a longer one could gain enough."""
    gain, cost, seen = sums[0] / NAT, sums[1] / NAT, sums[2]
    return [STAYS * ((gain >= GAIN) & (gain >= MEAN_GAIN * seen)).astype(np.uint8) + COSTS * (cost >= GAIN).astype(np.uint8)]


def _tallies(sums: list[np.ndarray]) -> list[np.ndarray]:
    """By key: twice its occurrences in training texts, and one more if it stands in several places at all."""
    n, others = sums
    return [(n << 1 | (n + others > 1)).astype(np.uint64)]


def _gain(n: np.ndarray, seen: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Log-ratio of an occurrence under the context without it and under the suffix."""
    return np.log((n - 1 + WEIGHT * suffix) / (seen - 1 + WEIGHT) / suffix)


class Batch:
    """One batch's tokens and what the rounds before have found about them."""

    def __init__(self, state: pa.Table, rows: pa.Table | None, totals: dict | None):
        self.number = state["node"][0].as_py()
        self.ids, arrays = pickle.loads(state["payload"][0].as_py())
        self.train, self.lens, self.tok, self.hashes = _unpack(arrays)
        self.train = self.train.astype(bool)
        self.starts = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.place = np.arange(len(self.tok)) - self.starts[self.doc]  # of a token in its text
        self.learns = self.train[self.doc]
        self.totals = totals
        self.found: dict[int, list] = {}
        if rows is not None:
            rows = rows.sort_by([("kind", "ascending"), ("sender", "ascending")])
            for kind, payload in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist()):
                self.found.setdefault(kind, []).append(_unpack(payload))

    def column(self, kind: int, i: int = 0) -> np.ndarray:
        """The answers of a kind along the keys sent."""
        parts = [p[i] for p in self.found.get(kind, [])]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def words(self) -> tuple[np.ndarray, ...]:
        """Distinct words' sorted hashes and their occurrences in training texts and in all."""
        n = (np.bincount(tok, minlength=len(self.hashes))[self.order].astype(np.uint64) for tok in (self.tok[self.learns], self.tok))
        return self.hashes[self.order], *n

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.hashes)

    def of_tokens(self, i: int) -> np.ndarray:
        c = np.zeros(len(self.hashes))
        c[self.order] = self.column(WORDS, i)
        return c[self.tok]

    @cached_property
    def counts(self) -> np.ndarray:
        """c of every token."""
        return self.of_tokens(0)

    @cached_property
    def countable(self) -> np.ndarray:
        """Tokens whose pairs have to be counted: the others' words stand in no training text or in no other place."""
        return (self.counts > 0) & (self.of_tokens(1) > 1)

    @cached_property
    def root(self) -> np.ndarray:
        c, t = self.counts, self.totals
        if not t["n"]:
            return np.ones(len(c))
        d = min(max(t["n1"] / max(t["n1"] + 2 * t["n2"], 1), 0.1), 0.9)
        return np.where(c > 0, (c - d) / t["n"], d * t["v"] / t["n"])

    def candidates(self, level: int) -> dict:
        """Tokens whose context of this length is a candidate, with the suffix's probability, the best one, how often the suffix and the context are seen (0: not known yet), and whether the n-gram is asked for."""
        if carried_kind(level) in self.found:
            at, p, best, wide, seen, asked = self.found[carried_kind(level)][0]
            return {"at": np.cumsum(at), "p": p.astype(float), "best": best.astype(float), "wide": wide.astype(float), "seen": seen.astype(float), "asked": asked.astype(bool)}
        if level >= CARRIED:  # none were written
            return {"at": np.zeros(0, np.int64), "p": np.zeros(0), "best": np.zeros(0), "wide": np.zeros(0), "seen": np.zeros(0), "asked": np.zeros(0, bool)}
        if level > 1:
            return self.judged(level - 1)[0]
        before = np.r_[0.0, self.counts[:-1]]
        at = np.flatnonzero((self.place >= 1) & (before >= LEAST))
        return {"at": at, "p": self.root[at], "best": self.root[at], "wide": np.full(len(at), float(self.totals["n"])), "seen": before[at], "asked": self.countable[at]}

    def hashed(self, at: np.ndarray, level: int) -> np.ndarray:
        """Of the contexts before some tokens."""
        return reduce(_mix, (self.hashes[self.tok[at - j]] for j in range(1, level + 1)), np.full(len(at), END_HASH))

    def keyed(self, level: int) -> dict:
        """The candidates with the places of their n-gram and of their unknown context among the keys of the level."""
        c = self.candidates(level)
        at, c["open"] = c["at"][c["asked"]], c["seen"] == 0
        grams, c["gram"] = np.unique(_mix(self.hashed(at, level) + _MIX[1], self.hashes[self.tok[at]]), return_inverse=True)
        contexts, c["context"] = np.unique(self.hashed(c["at"][c["open"]], level), return_inverse=True)
        c["grams"] = len(grams)
        c["keys"] = np.concatenate([grams, contexts])
        c["order"] = np.argsort(c["keys"], kind="stable")  # two sorted runs
        return c

    def counted(self, level: int) -> dict:
        """The candidates that are seen often enough, with counts and smoothed probability, and their distinct contexts."""
        c = self.keyed(level)
        n = np.zeros(len(c["keys"]), np.int64)
        n[c["order"]] = self.column(counts_kind(level))
        c["n"], c["more"] = self.learns[c["at"]].astype(float), np.zeros(len(c["at"]), bool)
        c["n"][c["asked"]], c["more"][c["asked"]] = n[c["gram"]] >> 1, n[c["gram"]] & 1
        c["seen"] = c["seen"].copy()
        c["seen"][c["open"]] = n[c["grams"]:][c["context"]] >> 1
        c["often"] = c["seen"] >= LEAST
        at = c["at"][c["often"]]
        if level == 1:  # by distinct words, not by tokens
            before = self.tok[at - 1]
            used, of = _places(before, len(self.hashes))
            c["mine"], rank = np.unique(_mix(END_HASH, self.hashes[used]), return_inverse=True)
            c["of"] = rank[of]
        else:
            c["mine"], c["of"] = np.unique(self.hashed(at, level), return_inverse=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            c["new"] = _smoothed(c["n"], c["seen"], c["p"])
        return c

    def judged(self, level: int) -> tuple[dict, np.ndarray]:
        """The candidates one word longer, and what kept contexts of the level add to each text's score."""
        c = self.counted(level)
        often, seen = c["often"], c["seen"][c["often"]]
        asked = (c["asked"] & c["more"] & (c["n"] > 0))[often]
        verdict = self.column(gains_kind(level)).astype(np.uint8)[c["of"]] if len(c["of"]) else np.zeros(0, np.uint8)
        at, new, best = c["at"][often], c["new"][often], c["best"][often]
        stays = verdict & STAYS > 0
        more = np.bincount(self.doc[at[stays]], np.log10(new[stays]) - np.log10(best[stays]), minlength=len(self.lens))
        best = np.where(stays, new, best)
        # the longer context is the n-gram that ends one token earlier; if that was no candidate, it is rare after a rare word and else to be counted
        if len(c["at"]):
            i = np.minimum(np.searchsorted(c["at"], at - 1), len(c["at"]) - 1)
            counted = c["at"][i] == at - 1
            longer = np.where(counted, c["n"][i], 0.0)
            rare = (counted | (level == 1)) & (longer < LEAST)
        else:
            longer, rare = np.zeros(0), np.zeros(0, bool)
        goes_on = (verdict & COSTS > 0) & (seen * SPLIT <= c["wide"][often] * (SPLIT - 1)) & (self.place[at] > level) & ~rare
        return {"at": at[goes_on], "p": new[goes_on], "best": best[goes_on], "wide": seen[goes_on], "seen": longer[goes_on], "asked": asked[goes_on]}, more


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (~F.coalesce(held_out, F.lit(False))).alias("_train"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    exchange = Exchange(max(1, -(-size // BATCH_BYTES)), FAN)

    def tokenise(batches):
        """Batches of about BATCH_BYTES, numbered by partition and place: the same if a task runs again."""
        number = TaskContext.get().partitionId() << 32
        ids, train, lens, tok, vocabulary, held = [], [], [], [], {b"": 0}, 0

        def flush():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            hashes[0] = END_HASH
            arrays = _pack(np.array(train, np.uint8), np.array(lens, np.int64), np.concatenate(tok).astype(np.int32), hashes)
            return _table([(number, 0, 0, pickle.dumps((ids, arrays)))]).combine_chunks().to_batches()[0]

        for batch in common.slices(batches):
            for key, text, learns in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1)), batch.column(2).to_pylist()):
                w = text.lower().split()
                part = np.zeros(len(w) + 1, np.int64)
                part[:-1] = [vocabulary.setdefault(x, len(vocabulary)) for x in w]
                ids.append(key), train.append(learns), lens.append(len(part)), tok.append(part)
                held += len(text) + 64
                if held >= BATCH_BYTES:
                    yield flush()
                    number += 1
                    ids, train, lens, tok, vocabulary, held = [], [], [], [], {b"": 0}, 0
        if ids:
            yield flush()

    states = common.bucketed(docs.mapInArrow(tokenise, ROWS), "batches", "node")

    def on_batches(rows: DataFrame, do: Callable[[Batch], list[tuple]], totals: dict) -> DataFrame:
        """What every batch sends, given the rows addressed to it."""
        return states.groupBy("node").cogroup(rows.groupBy("node")).applyInArrow(lambda s, r: _table(do(Batch(s, r, totals))) if s.num_rows else _table([]), ROWS)

    def send(b: Batch, *arrays: np.ndarray) -> list[tuple]:
        return list(exchange.send(b.number, exchange.group_of(b.number), 1, *arrays))

    def send_words(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                b = Batch(pa.Table.from_batches([rows.slice(i, 1)]), None, None)
                yield from _table(send(b, *b.words())).to_batches()

    as_counts = lambda sums: [s.astype(np.uint64) for s in sums]
    first = exchange.run(states.mapInArrow(send_words, ROWS), WORDS, as_counts, statistics=True)
    totals = {k: 0 for k in ("n", "v", "n1", "n2")}
    totals |= {list(totals)[r["node"]]: r["s"] for r in first.where(F.col("kind") == STATISTICS).groupBy("node").agg(F.sum("sender").alias("s")).collect()}
    first = first.where(F.col("kind") == WORDS)

    def send_counts(level: int) -> Callable[[Batch], list[tuple]]:
        def do(b: Batch) -> list[tuple]:
            out = []
            if level > 1:
                c, more = b.judged(level - 1)
                if more.any():
                    out.append((-1 - b.number, level, SCORES, _pack(more)))
                if level >= CARRIED and len(c["at"]):
                    out.append((-1 - b.number, 0, carried_kind(level), _pack(np.diff(c["at"], prepend=0), c["p"].astype(np.float32), c["best"].astype(np.float32), c["wide"].astype(np.uint64), c["seen"].astype(np.uint64), c["asked"].astype(np.uint8))))
                    b.found[carried_kind(level)] = [_unpack(out[-1][-1])]  # as the next round reads it
                if not len(c["at"]):
                    return out
            c = b.keyed(level)
            if level < CARRIED and len(c["at"]) and not len(c["keys"]):  # all counts are known, the gains are not
                out.append((-1 - b.number, level, WAITS, _pack()))
            learns = b.learns[c["at"]]
            sums = []
            for x in (learns, ~learns):
                n = np.bincount(c["gram"], x[c["asked"]], minlength=c["grams"]), np.bincount(c["context"], x[c["open"]], minlength=len(c["keys"]) - c["grams"])
                sums.append(np.concatenate(n)[c["order"]].astype(np.uint64))
            return out + send(b, c["keys"][c["order"]], *sums)

        return do

    def send_gains(level: int) -> Callable[[Batch], list[tuple]]:
        def do(b: Batch) -> list[tuple]:
            c = b.counted(level)
            often = c["often"]
            learns = b.learns[c["at"][often]]
            n, seen, p, new = (c[k][often] for k in ("n", "seen", "p", "new"))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain, cost = np.where(learns, _gain(n, seen, p), 0.0), np.where(learns, -np.log(new), 0.0)
            sums = [np.rint(NAT * np.bincount(c["of"], x, minlength=len(c["mine"]))).astype(np.int64) for x in (gain, cost)]
            return send(b, c["mine"], *sums, np.bincount(c["of"], learns, minlength=len(c["mine"])).astype(np.uint64))

        return do

    known, scores, level = [first], [], 1
    tables: list[str] = []  # of the levels before
    while True:
        gone: list[str] = []  # of this level
        sent = on_batches(reduce(DataFrame.unionByName, known), send_counts(level), totals)
        asked = exchange.run(sent, counts_kind(level), _tallies, gone=gone)
        if level > 1:
            scores.append(common.bucketed(asked.where(F.col("kind") == SCORES), "scores", "node"))
            asked = asked.where(F.col("kind") != SCORES)
        if asked.isEmpty():
            break
        if level >= CARRIED:  # what batches carry is all they need
            common.remove(spark, tables)
            known = []
        known.append(asked)
        gains = on_batches(reduce(DataFrame.unionByName, known), send_gains(level), totals)
        known.append(exchange.run(gains, gains_kind(level), _verdicts, gone=gone))
        tables += gone
        level += 1
        del sent, asked, gains
        common.release(spark)

    def judge(s: pa.Table, r: pa.Table) -> pa.Table:
        names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [arrow_id, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not s.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        b = Batch(s, r, totals)
        n, v, c = totals["n"], totals["v"], b.counts
        add = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731  every text has its end token
        total = add(np.log10(b.root)) + sum((p[0] for p in b.found.get(SCORES, [])), np.zeros(len(b.lens)))
        cols = [b.ids, ~b.train, b.lens, add((c > 0).astype(np.int64)), np.full(len(b.ids), n), add(np.log10((c + 1) / (n + v + 1))), total]
        return pa.table([pa.array(x, t) for x, t in zip(cols, types)], names=names)

    kind = id_type.simpleString()
    rows = reduce(DataFrame.unionByName, [first, *scores])
    return states.groupBy("node").cogroup(rows.groupBy("node")).applyInArrow(judge, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), common.remainder("doc_id", 7) == 2)
