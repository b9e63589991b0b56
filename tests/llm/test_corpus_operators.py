import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from millrace.llm import bpe, common, components, decontaminate, exact_dedup, registry, similar, simhash, suffix_tree, token_files, toxicity, url_cascade, zstd_models  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _k long, score string"
RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(20_000)
PASSAGE = prose(14)
TEXTS = {
    0: prose(80), 1: None, 2: "", 3: "  \n\t ", 4: "a", 5: LONG, 6: LONG.replace("w1 ", "w2 ", 1), 7: "Ünï " + prose(30),
    8: prose(20) + " " + PASSAGE + ". " + prose(5), 9: PASSAGE.upper(), 10: "x" * 5000, 11: "<|endoftext|> it's  two  spaces\n\n end ",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in TEXTS.items()] + [(20, TEXTS[0]), (20, TEXTS[0]), (None, TEXTS[0]), (None, "alone here")]
    return spark.createDataFrame([(i, t, None if i == 4 else "xx", None, None, "clash", 1, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def text_of(t):
    return (t or "").encode()


def test_exact_dedup(docs, empty):
    rows = exact_dedup.classes(docs).collect()
    assert len(rows) == docs.count() and exact_dedup.classes(empty).count() == 0
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[20]["keep_id"] == 0 and got[0]["group_size"] == 4 and got[0]["kept"] and not got[20]["kept"]
    assert got[2]["keep_id"] == 1 and got[3]["keep_id"] == 3  # one space is not the empty text
    assert got[3]["text_sha256"] == hashlib.sha256(b" ").hexdigest()
    kept = exact_dedup.keepers(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted(set(TEXTS) - {2})
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == ["alone here"]


def test_bpe_against_the_library(docs, empty):
    import tiktoken

    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    tool = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    coded = bpe.encode(docs, path, pattern)
    for r in bpe.decode(coded, path, pattern).collect():
        if r["doc_id"] in TEXTS:
            assert r["ids"] == tool.encode_ordinary(TEXTS[r["doc_id"]] or "")
            assert bytes(r["decoded"]) == text_of(TEXTS[r["doc_id"]])
    assert bpe.digests(empty).count() == 0
    rng = random.Random(1)
    for _ in range(500):
        piece = "".join(rng.choice("aabetch \u00e9") for _ in range(rng.randint(1, 40))).encode()
        assert bpe.merge_piece(piece, tool._mergeable_ranks) == tool._encode_single_piece(piece)


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert tool.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    path = common.scratch_path(spark, "t")
    whole = docs.where("doc_id IS NOT NULL AND doc_id < 20")
    token_files.write(whole, path, public.path("byte_bpe_50k.json"), partitions=3)
    got, start = by_id(token_files.checksums(token_files.read(spark, path))), 0
    for i in sorted(TEXTS):
        ids = np.array(tool.encode(TEXTS[i] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = common.scratch_path(spark, "t")
    token_files.write(docs, path, public.path("byte_bpe_50k.json"), partitions=3)
    assert token_files.read(spark, path).count() == docs.count()
    path = common.scratch_path(spark, "t")
    token_files.write(empty, path, public.path("byte_bpe_50k.json"))
    assert token_files.read(spark, path).count() == 0


@pytest.mark.parametrize("ids", [[], [7], [5] * 1001, [1, 2] * 300 + [1], list(range(50)) * 40])
def test_repair_random_access(ids):
    ids = np.array(ids, np.uint32)
    shard = token_files.Shard(token_files.compress(ids))
    assert (shard.span(0, len(ids)) == ids).all()
    for a, n in ((0, 1), (3, 17), (len(ids) // 2, 50), (max(len(ids) - 2, 0), 9)):
        assert (shard.span(a, n) == ids[a:a + n]).all()
    if len(ids) > 500:
        assert len(shard.seq) < len(ids) / 8


def brute_fingerprint(text, n):
    w = text_of(text).lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(len(w) - n + 1, 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs, empty):
    got = simhash.near_classes(docs).collect()
    assert len(got) == docs.count() and simhash.near_classes(empty).count() == 0
    for r in got:
        if r["doc_id"] in TEXTS:
            assert r["fp"] % (1 << 64) == brute_fingerprint(TEXTS[r["doc_id"]], 3)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[20] == comp[0] == 0
    assert {r["component_id"] for r in got if r["doc_id"] is None} <= {0, None}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[6] == 5


@pytest.mark.parametrize("direct", [1024, 8])
def test_simhash_links_against_brute_force(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    dense = rng.getrandbits(64)
    for base in [*list(fps)[:40], *[dense] * 150]:
        x = base
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_winnowing_against_brute_force(spark, docs, empty):
    items = {1: PASSAGE, 2: "alone HERE!", 3: None, 4: "", 5: PASSAGE, 6: "w1", 7: prose(12), 10: " ".join((TEXTS[0] or "").split()[3:13])}
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items.items()], "item_id long, text string, doc_id string")

    def words(t):
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split(" ")

    wins = {i: {tuple(w[k:k + min(len(w), 10)]) for k in range(max(len(w) - 9, 1))} for i, t in items.items() if (w := [x for x in words(t) if x])}
    rows = decontaminate.contamination(docs, bench).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] not in TEXTS:
            continue
        w = [x for x in words(TEXTS[r["doc_id"]]) if x]
        hit, found = set(), set()
        for i, ws in wins.items():
            n = len(next(iter(ws)))
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in ws:
                    hit.update(range(p, p + n))
                    found.add(str(i))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_url_cascade(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "https://example.com/en/8", "ftp://com/en/", "http://xcom/en/", "http://b.example.net/de/81", "http://n.net/de/", "http://o.org/es", "http://o.org/es/#", "http://example.com/en/7", "x://y://z"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.judge(pages).collect()}
    want = {3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: ("com/en/", "block"), 7: ("example.net/de/8", "block"), 8: ("net/de/", "block"), 10: ("org/es/", "block"), 11: ("example.com/en/7", "allow")}
    assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert url_cascade.judge(pages.where("false")).count() == 0
    assert url_cascade.judge(pages, rules=()).where("rule IS NOT NULL").count() == 0
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/p/"), "id").alias("url"))
    rules = [(f"h{i}.com", "/p/", "block") for i in range(0, 3000, 2)]
    assert url_cascade.judge(many, rules).where((F.col("verdict") == "block") != (F.col("page_id") % 2 == 0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w) if not bad or i % 8 else " ".join(w).upper(), "aa" if i % 2 else "bb"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None, None), (1001, "", "aa"), (1002, "123 ??", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    held = common.remainder("doc_id", 4) == 2
    out = toxicity.score(docs, labels, held)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0 and out.count() == docs.count()
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 320
    assert toxicity.score(docs, labels.where("toxic = 0"), held).where("predicted = 1").count() == 0
    assert toxicity.score(docs.where("false"), labels, held).count() == 0


def test_quality_and_language(spark, labelled):
    docs, labels = labelled
    held = common.remainder("doc_id", 5) == 0
    out = zstd_models.quality(docs, labels, held)
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0 and out.count() == docs.count()
    assert zstd_models.quality(docs, labels.where("false"), held).where("score <> 0.5").count() == 0
    rng = random.Random(2)
    words = {k: ["".join(rng.choice(a) for _ in range(5)) for _ in range(80)] for k, a in (("aa", "abcdef"), ("bb", "uvwxyz"))}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(50)), k) for i in range(200) for k in [rng.choice(["aa", "bb"])]]
    rows += [(1000, None, "aa"), (1001, "12 !", "bb"), (1002, "", None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(zstd_models.language(texts, common.remainder("doc_id", 3) == 1))
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:200])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert zstd_models.language(texts.where("false"), F.lit(False)).count() == 0


@pytest.mark.parametrize("size", [12 << 20, 4000])
def test_suffix_tree(docs, empty, monkeypatch, size):
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", size)
    out = suffix_tree.score(docs, common.remainder("doc_id", 7) == 2)
    rows = out.collect()
    assert len(rows) == docs.count()
    texts = [(r["doc_id"], text_of(r["text"]).lower().split() + [None]) for r in docs.select("doc_id", "text").collect()]
    counts = {}
    for i, w in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = dict(texts)
    for r in rows:
        if r["doc_id"] is None:
            continue
        w = want[r["doc_id"]]
        base = sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] <= 0
    assert suffix_tree.score(empty, F.lit(False)).count() == 0


def test_suffix_tree_finds_contexts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(x for _ in range(40) for x in (["deep", "blue", "sea"] if rng.random() < 0.3 else [rng.choice(WORDS)]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_tree.score(df, F.col("doc_id") % 4 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.8 * out[1]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES[:4], ("toxic", "copies", "near", "leaks")):
        out = stage(spark, left, sf)
        assert out.columns == docs.columns, name
        before, after = by_id(left), by_id(out)
        assert after.keys() <= before.keys()
        gone = {i: r["text"] for i, r in before.items() if i not in after}
        if check == "copies":
            norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for i, r in before.items()}
            first = {}
            for i in sorted(norm):
                first.setdefault(norm[i], i)
            assert set(after) == set(first.values())
        if check == "near":
            grams = {i: set(five_words(r["text"])) for i, r in before.items()}
            close = {(i, j) for i in before for j in before if i < j and (grams[i] or grams[j]) and len(grams[i] & grams[j]) >= 0.85 * len(grams[i] | grams[j])}
            assert not any(i in after and j in after for i, j in close)  # one of each pair went
            for i in gone:
                assert any(j != i and len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j]) for j in grams)
        left = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[4][1](spark, left, sf).count() == left.count()
    assert corpus_pipeline.run(spark, sf).count() == left.count()


def test_pipeline_drops_toxic_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = by_id(spark.read.parquet(f"{sf}/documents.parquet"))
    gone = before.keys() - by_id(corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)).keys()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & gone) <= 0.05 * len(clean) and len(toxic & gone) >= 0.7 * len(toxic)


def five_words(text):
    w = text_of(text).lower().split()
    return [b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))]


def linked(grams, at):
    """Class of each id by brute force over all pairs at the similarity."""
    up = {i: i for i in grams}
    for i in grams:
        for j in grams:
            if j < i and len(grams[i] & grams[j]) >= at * len(grams[i] | grams[j]):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if x == old else x for k, x in up.items()}
    return up


@pytest.mark.parametrize("block", [similar.BLOCK, 8])
def test_similar_against_brute_force(spark, docs, empty, block, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(120)]
    rows = [(5000 + k, " ".join(w if rng.random() > 0.012 else w + "x" for w in base)) for k in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    monkeypatch.setattr(similar, "BLOCK", block)
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(df).collect()}
    grams = {i: set(five_words(t)) for i, t in texts.items()}
    share = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    close = [(i, j) for i in grams for j in grams if i < j and share(i, j) >= 0.85]
    assert len(close) > 200 and all(got[i] == got[j] for i, j in close)
    up = linked(grams, 0.8)
    assert all(up[got[i]] == up[i] for i in grams)  # nothing is linked that brute force keeps apart
    fps = {i: similar.wide(text_of(t), 5) for i, t in texts.items()}
    for i in grams:
        wanted = [j for j in grams if np.bitwise_count(fps[i] ^ fps[j]).sum() <= similar.tau(0.8)]
        assert set(similar.near(np.array(list(fps.values())), fps[i], similar.tau(0.8)).tolist()) == {n for n, j in enumerate(fps) if j in wanted}
    assert similar.classes(empty).count() == 0 and similar.keepers(empty).columns == docs.columns


def test_near_copies_go_by_row(spark):
    rng = random.Random(6)
    one, two = prose(80, rng), " ".join(rng.choice(WORDS) + "z" for _ in range(80))
    rows = [(None, one), (3, one), (None, two), (7, two + " x"), (7, one + " y"), (9, prose(60, rng)), (None, prose(60, rng)), (11, None), (12, "")]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, gone_id string, key string, rep string, root string")
    out = similar.keepers(df)
    assert out.columns == df.columns
    want = [(3, one), (7, two + " x"), (9, rows[5][1]), (None, rows[6][1]), (11, None)]  # an empty text is like a null one
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, text string").collect())


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", prose(50, random.Random(1))), ("a", prose(50, random.Random(1))), ("c", "other words"), (None, None)], "doc_id string, text string")
    for found in (simhash.near_classes(df), similar.classes(df)):
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {"a": "a", "b": "a", "c": "c", None: None}


def test_rows_with_nulls_are_told_apart(spark):
    docs = spark.createDataFrame([(5, None), (None, "5"), (None, None), (5, "5")], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, "5")], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in got) == [("5", 0), ("5", 1), ("None", 0), ("None", 1)]
    assert sorted(map(str, decontaminate.clean(docs, spark.createDataFrame([(1, "5")], "item_id long, text string")).collect())) == sorted(["Row(doc_id=5, text=None)", "Row(doc_id=None, text=None)"])


def test_stages_keep_clashing_columns(spark):
    names = ["text_sha256", "sha", "_sha", "own_id", "row_key", "key", "bad", "_gone", "h", "score", "label", "component_id", "kept"]
    df = spark.createDataFrame([(1, "a b c", *names), (2, "a  b c", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "zz")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out in (exact_dedup.keepers(df), decontaminate.clean(df, bench), similar.keepers(df), toxicity.clean(df, labels)):
        assert out.columns == df.columns and tuple(out.orderBy("doc_id").first()) == (1, "a b c", *names)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert registry.oracle_sql().keys() <= registry.queries().keys()


@pytest.mark.parametrize("block", [similar.BLOCK, 8])
def test_similar_links_only_at_the_similarity(spark, block, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for k in range(30):  # texts that share most of a long passage: pairs from far below 0.8 to above
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(200)]
        for cut in (0, 6, 14, 24, 34, 44):
            rows.append((len(rows), " ".join(base[:200 - cut] + [rng.choice(WORDS) + "y" for _ in range(cut)])))
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = {i: set(five_words(t)) for i, t in rows}
    share = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    up = {i: i for i in grams}
    for i in grams:
        for j in range(i):
            if share(i, j) >= 0.8:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if x == old else x for k, x in up.items()}
    low = [(i, j) for i in grams for j in range(i) if 0.6 <= share(i, j) < 0.8]
    assert len(low) > 60
    for i in grams:  # nothing is linked that brute force at 0.8 keeps apart
        assert up[got[i]] == up[i]
    sure = [(i, j) for i in grams for j in range(i) if share(i, j) >= 0.85]
    assert sure and all(got[i] == got[j] for i, j in sure)


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 200_000), 5000).astype(np.uint32)
    s = token_files.Shard(token_files.compress(ids))
    assert (s.span(0, len(ids)) == ids).all()
    assert token_files._counted(s.seq, s.base + len(s.rules))[1].max() < token_files.LEAST


def test_repeated_lines_stay_toxic():
    rng = random.Random(12)
    clean = [[rng.choice(WORDS).encode() for _ in range(60)] for _ in range(200)]
    bad = [[rng.choice([b"vile", b"nasty", b"rotten"]) if rng.random() < 0.3 else x for x in w] for w in clean]
    model = toxicity.KneserNey([(0, w) for w in clean[:150]] + [(1, w) for w in bad[:150]])
    for w in bad[150:]:
        once, often = toxicity.feature(model, w), toxicity.feature(model, w * 50)
        assert once > 0 and often > 0.8 * once


def test_suffix_tree_of_a_table_united_with_itself(spark):
    rows = [(i, prose(30, random.Random(i))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_tree.score(df.union(df), F.col("doc_id") % 4 == 0).collect()
    assert len(out) == 80
    assert len({(r["doc_id"], r["score"]) for r in out}) == 40


def brute_suffix_tree(texts, learns):
    """log10 probability of each text (words, end) by the definition: contexts grown to the left, longest kept one scores."""
    end = ("",)
    seqs = [list(w) + [end] for w in texts]
    n = {}
    for w, t in zip(seqs, learns):
        for x in w if t else []:
            n[x] = n.get(x, 0) + 1
    total, n1, n2 = sum(n.values()), sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())
    d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
    p = [[(n[x] - d) / total if x in n else d * len(n) / total for x in w] for w in seqs]
    best, live, deepest, wide = [list(q) for q in p], [[True] * len(w) for w in seqs], 0, {(): total}
    for level in range(1, 100):
        where = [(s, i) for s, w in enumerate(seqs) for i in range(level, len(w)) if live[s][i]]
        context = {(s, i): tuple(seqs[s][i - level:i]) for s, i in where}
        seen, grams = {}, {}
        for s, i in where:
            if learns[s]:
                c = context[s, i]
                seen[c] = seen.get(c, 0) + 1
                grams[c, seqs[s][i]] = grams.get((c, seqs[s][i]), 0) + 1
        where = [(s, i) for s, i in where if seen.get(context[s, i], 0) >= suffix_tree.LEAST]
        if not where:
            return [sum(np.log10(q)) for q in best], deepest
        gain, cost, new = {}, {}, {}
        for s, i in where:
            c, m = context[s, i], grams.get((context[s, i], seqs[s][i]), 0)
            new[s, i] = (m + suffix_tree.WEIGHT * p[s][i]) / (seen[c] + suffix_tree.WEIGHT)
            if learns[s]:
                gain[c] = gain.get(c, 0) + np.log((m - 1 + suffix_tree.WEIGHT * p[s][i]) / (seen[c] - 1 + suffix_tree.WEIGHT) / p[s][i])
                cost[c] = cost.get(c, 0) - np.log(new[s, i])
        live = [[False] * len(w) for w in seqs]
        for s, i in where:
            c = context[s, i]
            p[s][i] = new[s, i]
            if gain[c] >= suffix_tree.GAIN and gain[c] >= suffix_tree.MEAN_GAIN * seen[c]:
                best[s][i], deepest = new[s, i], level
            live[s][i] = cost[c] >= suffix_tree.GAIN and seen[c] * suffix_tree.SPLIT <= wide[c[1:]] * (suffix_tree.SPLIT - 1)
        wide = seen


@pytest.mark.parametrize("size,fan", [(4 << 20, 256), (3000, 256), (3000, 3)])
def test_suffix_tree_against_brute_force(spark, monkeypatch, size, fan):
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", size)
    monkeypatch.setattr(suffix_tree, "FAN", fan)
    rng = random.Random(14)
    after = {}  # the next word follows from the last three
    rows = []
    for i in range(90):
        w = [rng.choice("abcd") for _ in range(3)]
        while len(w) < rng.randint(40, 90):
            w.append(after.setdefault(tuple(w[-3:]), rng.choice("abcd")) if rng.random() < 0.8 else rng.choice("abcd"))
        rows.append((i, " ".join(w)))
    rows += [(100, ""), (101, None), (102, "never seen"), (103, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("doc_id") % 5 == 0).collect()}
    want, deepest = brute_suffix_tree([text_of(t).split() for _, t in rows], [i % 5 != 0 for i, _ in rows])
    assert deepest >= 3
    for (i, _), x in zip(rows, want):
        assert abs(got[i] - x) < 1e-4 * max(1, abs(x)), (i, got[i], x)


@pytest.mark.parametrize("block", [similar.BLOCK, 8])
def test_similar_loses_no_link_at_the_similarity(spark, block, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(21)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(10**6))
    common_part = [word() for _ in range(30)]  # of half the texts
    rows = []
    for k in range(240):  # pairs just at the similarity, or just below it
        base = [word() for _ in range(150)] + common_part * (k % 2)
        cut = int(0.2 * (len(base) - 4)) + (k % 4 == 3)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[cut:]))]
    base = [word() for _ in range(200)]
    for k in range(80):  # a crowd, some pairs of which are alike enough
        rows.append((len(rows), " ".join(w if rng.random() > 0.02 else word() for w in base)))
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = {i: set(five_words(t)) for i, t in rows}
    share = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    assert sum(0.8 <= share(2 * k, 2 * k + 1) < 0.81 for k in range(240)) == 180
    assert got == linked(grams, 0.8)


def test_workers_keep_one_operators_table():
    import weakref

    import public_tokenizers as public

    first = weakref.ref(bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN))
    assert bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN) is first()
    token_files._encoder(public.path("byte_bpe_50k.json"))
    assert first() is None
    second = weakref.ref(token_files._encoder(public.path("byte_bpe_50k.json")))
    common.let_go()  # as the toxicity and near-duplicate stages begin
    assert second() is None


def test_suffix_tree_asks_only_what_is_not_known():
    import pickle

    known, end = suffix_tree.WORDS, suffix_tree.END_HASH
    for x in (np.array([-3, 0, 7], np.int64), np.array([5, -1], np.int32)):
        assert (suffix_tree._unpack(suffix_tree._pack(x))[0] == x).all()
    hashes = np.array([end, 11, 22, 33], np.uint64)
    tok = np.array([1, 2] * 10 + [3, 0], np.int32)  # (a b) ten times, c once, the end
    state = suffix_tree._table([(0, 0, 0, pickle.dumps(([0], suffix_tree._pack(np.ones(1, np.uint8), np.array([len(tok)]), tok, hashes))))])
    b = suffix_tree.Batch(state, None, {"n": 22, "v": 4, "n1": 2, "n2": 0})
    counts = np.array([1, 10, 10, 1], np.uint64)[b.order]
    b.found[known] = [[counts, counts]]
    c = b.keyed(1)
    assert len(c["keys"]) == 2  # a b and b a; not b c, which stands once, and not the contexts a and b
    pairs = suffix_tree._mix(b.hashed(np.array([1, 2]), 1) + suffix_tree._MIX[1], hashes[[2, 1]])
    n = np.array([10, 9], np.uint64)[np.argsort(pairs)]
    b.found[suffix_tree.counts_kind(1)] = [suffix_tree._tallies([n, np.zeros(2, np.uint64)])]
    c = b.counted(1)
    assert c["seen"].tolist() == [10.0] * 20 and c["n"].tolist() == [10.0, 9.0] * 9 + [10.0, 1.0]


def test_suffix_tree_of_rare_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", 3000)
    rng = random.Random(3)
    after, rows = {}, []
    for i in range(90):  # the next word follows from the last two; held-out texts share words that stand once or twice in training ones
        w = [rng.choice("abcdef") for _ in range(2)]
        while len(w) < 70:
            w.append(after.setdefault(tuple(w[-2:]), rng.choice("abcdef")) if rng.random() < 0.75 else rng.choice(["a", "b", "c", "d", "e", "f", f"r{rng.randint(0, 150)}"]))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("doc_id") % 5 == 0).collect()}
    want, deepest = brute_suffix_tree([text_of(t).split() for _, t in rows], [i % 5 != 0 for i, _ in rows])
    assert deepest >= 2
    for (i, _), x in zip(rows, want):
        assert abs(got[i] - x) < 1e-4 * max(1, abs(x)), (i, got[i], x)


def test_round_trip_takes_one_worker_a_task(docs):
    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    plan = bpe.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each would be a Python worker with tables of its own
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["ids"])
    want = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert sorted(bpe.round_trip(docs, path, pattern).collect(), key=key) == sorted(want, key=key)


def test_similar_makes_no_pairs_of_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(similar, "FREQUENT", 10**6)  # no shingle is known to be frequent, as in a table much larger than the sample
    made, written = {}, common.written

    def noted(df, what, *rest):
        found = written(df, what, *rest)
        made[what] = found.count()
        return found

    monkeypatch.setattr(common, "written", noted)
    rng = random.Random(8)
    word = lambda: f"x{rng.randrange(10**6)}"
    shared = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(60)] + shared)) for i in range(120)]
    base = rows[0][1].split()
    rows.append((120, " ".join(base[12:])))  # like the first one
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked({i: set(five_words(t)) for i, t in rows}, 0.8)
    assert got[120] == 0 and made["meetings"] <= 5  # of 7,000 pairs that share the passage


def test_sketches_tell_long_texts_apart():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    sets = [pool[:6000], pool[600:6300], pool[3000:9000], pool[:4000], pool[500:], pool[:0]]
    of = similar.Sketches(np.array([b"", *map(similar.sketch, sets)], object)[1:])
    a, b = (x.reshape(-1) for x in np.indices((len(sets), len(sets))))
    d, real = of.differing(a, b), np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(a, b)])
    assert (d <= real).all()  # a bound, whatever the sizes
    both = 12_000  # the first and the third share half of their shingles
    assert d[2] > both - 2 * similar.least_shared(both, 0.8)


def test_repair_counts_pairs_once(monkeypatch):
    rng, sizes, unique = np.random.default_rng(6), [], np.unique
    ids = (rng.zipf(1.3, 60_000) % 400).astype(np.uint32)
    ids[5000:5400], ids[-50:] = 7, 9  # runs of one id

    def noted(x, *rest, **more):
        sizes.append(len(x))
        return unique(x, *rest, **more)

    monkeypatch.setattr(np, "unique", noted)
    s = token_files.Shard(token_files.compress(ids))
    monkeypatch.undo()
    assert (s.span(0, len(ids)) == ids).all()
    assert token_files._counted(s.seq, s.base + len(s.rules))[1].max() < token_files.LEAST
    assert len(sizes) > 5 and sum(sizes) < 4 * len(ids)  # not the whole sequence in every round


def test_chunks_encoded_together_are_as_alone():
    tool = token_files._Encoder(public.path("byte_bpe_50k.json"))
    texts = [*map(lambda t: t or "", TEXTS.values()), "é  ü a\u00a0b  c ", " x\u2003y z", "a b\n c\t\td e", "日本 語 テキスト \U0001f600 ok", "don't we'll  I'm", "x" * 90 + " y " + "z" * 80, " ", "a <|endoftext|> b <|endoftext|>"]
    calls, library = [], tool.tool

    class Noted:
        def __getattr__(self, name):
            if name == "encode_batch_fast":
                return lambda part, **more: calls.append(len(part)) or library.encode_batch_fast(part, **more)
            return getattr(library, name)

    tool.tool = Noted()
    got = [x.tolist() for x in tool.many(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(calls) < len(tool.known) / 3  # fewer texts than chunks
