"""Every operator against brute force on small, awkward documents; on an empty table; and what its docstring states."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, make, near, texts, written
from tidemark.llm import audio, bpe, components, exact_dedup, language_id, lm, ngram_join, packing, quality, sharding, text, url_filters
from tidemark.llm.common import ROW_ID, identified, with_row_id
from tidemark.llm.pack import spread

SPACES = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return written(spark, documents(spark), str(tmp_path_factory.mktemp("d") / "documents.parquet")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


# --- op1, op6


def test_language_id(spark, empty):
    import random

    rng = random.Random(3)
    rows = [(k, make(rng, "en" if k % 2 else "de", 30), "en" if k % 2 else "de") for k in range(400)] + [(1000, None, "en"), (1001, "12 !", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(d, centroids=2)
    got = {r["doc_id"]: r for r in language_id.predict(d, model).select("doc_id", "__lang.*").collect()}
    assert sum(got[k]["lang_pred"] == l for k, _, l in rows[:400]) > 395
    assert sum(got[k]["rejected"] for k, _, _ in rows[:400]) < 5
    for k in (1000, 1001):
        assert tuple(got[k])[1:] == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert model.predict(["qzx jkv wqp xxz qqj zzk vvx wwq jjx kkz " * 20])["rejected"][0]
    none = language_id.fit_documents(empty)
    assert none.predict(["text"])["lang_pred"][0] == "und"
    assert language_id.predict(empty, model).count() == 0
    assert language_id.filter_known(d).columns == d.columns


def test_language_id_clusters_in_two_copies_of_the_counts():
    import random
    import tracemalloc

    rng = random.Random(5)
    texts = [make(rng, "en" if k % 2 else "de", 40) for k in range(500)]
    c = language_id.counts(texts)
    x = language_id._unit(np.sqrt(c) * (np.log((1 + len(texts)) / (1 + (c > 0).sum(0).astype(np.float32))) + 1))
    own = (x @ language_id._cluster(x, 3).T).argmax(1)
    want = [language_id._unit(np.sqrt(c))[own == k].mean(0) for k in range(3) if (own == k).any()]
    one = c.nbytes
    del x
    tracemalloc.start()
    seen, means = language_id.clustered(texts, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.6 * one  # with counts, their roots and both at length one it was over four
    assert np.array_equal(seen, (c > 0).sum(0)) and len(means) == len(want)
    assert all(map(np.array_equal, means, want))


def test_workers_of_the_first_stages_do_without_pandas():
    import subprocess
    import sys

    code = "import sys, tidemark.llm.language_id, tidemark.llm.quality; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], timeout=100).returncode == 0


def test_language_id_is_the_nearest_centroid_by_brute_force(spark):
    import math
    import random

    rng = random.Random(13)
    rows = [(k, make(rng, "en" if k % 2 else "de", 5 + k % 40), "en" if k % 2 else "de") for k in range(120)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), centroids=3)
    got = model.predict([t for _, t, _ in rows])
    for k, (_, t, _) in enumerate(rows):
        n = Counter(language_id.grams(t).tolist())
        v = {g: math.sqrt(c) * float(model.idf[g]) for g, c in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(c[g]) for g, x in v.items()) / size for c in model.centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert got["lang_pred"][k] == model.languages[best] and abs(got["score"][k] - near[best]) < 1e-5
        assert got["rejected"][k] == (near[best] < model.least[sum(x < sum(n.values()) for x in language_id.CLASSES)])


def test_pairwise_ranking_equals_a_plain_fit(spark):
    import random

    rng = random.Random(14)
    noisy = lambda t: " ".join(w.upper() + "!!" if rng.random() < 0.3 else w for w in t.split())
    rows = [(k, make(rng, "en", 20 + k % 30) if k % 3 else noisy(make(rng, "en", 20 + k % 30)), int(k % 3 > 0)) for k in range(150)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string, label int"), rounds=2)
    x = np.array([quality.features(t) for _, t, _ in rows])
    label = np.array([l for *_, l in rows])
    s = x @ model.weights
    # the scores are 0.7 at the quantile that cuts off as many as are labelled bad, and rise with w.x
    assert abs(model.threshold - np.quantile(s, (label == 0).mean())) < 1e-9
    assert np.allclose(model.score([t for _, t, _ in rows]), 1 / (1 + np.exp(-(model.slope * (s - model.threshold) + np.log(0.7 / 0.3)))))
    # at the minimum of the logistic loss over all pairs a plain descent goes nearly the same way
    d = (x[label == 1][:, None] - x[label == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w += 2.0 * ((1 / (1 + np.exp(d @ w)))[:, None] * d).mean(0) - 2e-4 * w
    order = lambda v: (d @ v > 0).mean()
    assert order(model.weights) > 0.97 and abs(order(model.weights) - order(w)) < 0.02


def test_quality_learns_from_every_label(spark):
    """More labels than a former cap of 20,000: the threshold is the quantile of the scores of all of them."""
    r = np.random.RandomState(3)
    rows = [(k, " ".join("abc!X"[i] * (1 + i) for i in r.randint(0, 5, 4)), int(k % 200 > 0)) for k in range(24_000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id bigint, quality int")
    model = quality.fit_documents(docs.unionByName(docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text")), labels.unionByName(labels.select((F.col("doc_id") + 100_000).alias("doc_id"), "quality")))
    own = [(t, q) for k, t, q in rows for i in (k, k + 100_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(own) > 20_000
    s = np.array([quality.features(t) for t, _ in own]) @ model.weights
    assert abs(model.threshold - np.quantile(s, np.mean([q == 0 for _, q in own]))) < 1e-9


def test_kd_tree_splits_as_a_plain_one(spark):
    import random

    rng = random.Random(15)
    rows = [(k, rng.randrange(1, 50), rng.randrange(1000), rng.randrange(40)) for k in range(800)]
    df = spark.createDataFrame([(*r, r[0], 0) for r in rows], "id bigint, size bigint, x bigint, y bigint, t bigint, u bigint")
    placed = sharding.place(df, sharding.tree(df, 8, ("x", "y"), ("t", "u")), ("x", "y"), ("t", "u"))
    weights = sorted(r["w"] for r in placed.groupBy("node").agg(F.sum("size").alias("w")).collect())

    whole = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in (2, 3)]

    def plain(rows, shards):
        if shards == 1:
            return [sum(r[1] for r in rows)]
        d = max((0, 1), key=lambda d: (max(r[d + 2] for r in rows) - min(r[d + 2] for r in rows)) / whole[d])
        rows, left = sorted(rows, key=lambda r: (r[d + 2], r[0])), shards // 2
        want, before = sum(r[1] for r in rows) * left / shards, 0
        for k, r in enumerate(rows):
            if before + r[1] / 2 >= want:
                break
            before += r[1]
        return plain(rows[:k], left) + plain(rows[k:], shards - left)

    want = sorted(plain(rows, 8))
    assert len(weights) == 8 and all(abs(a - b) <= 50 for a, b in zip(weights, want, strict=True))


def test_names_of_own_columns_may_be_taken(spark, docs, tmp_path):
    clash = docs.withColumns({c: F.lit(c) for c in ("__row_id", "__lang", "__score", "__gone", "__row", "n", "c", "th", "kept", "size")})
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 1000, 7)], "doc_id bigint, quality int, toxic int")
    for d in (clash, written(spark, clash, f"{tmp_path}/clash")):
        stages = [language_id.filter_known(d), quality.keep_good(d, labels), exact_dedup.deduplicate(d)]
        for out in stages if d is clash else [*stages, ngram_join.one_of_each(d)]:
            assert out.columns == d.columns
            assert out.filter("__row_id <> '__row_id' or __lang <> '__lang' or __score <> '__score'").isEmpty()
        assert exact_dedup.deduplicate(d).count() == exact_dedup.deduplicate(docs).count()
    sharding.write_shards(clash, f"{tmp_path}/shards", 4)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == docs.count()


def test_a_held_note_votes_once(spark):
    a = [5] * 400 + [1, 2, 3, 4] + [5] * 400
    rows = [(100, a), (1, a[100:]), (2, [5] * 600)]
    best, _ = audio.search(spark.createDataFrame(rows, "rec_id bigint, fp array<int>"))
    got = {r["rec_id"]: r for r in best.collect()}
    assert (got[1]["match_id"], got[1]["offset"], got[1]["votes"]) == (100, -100, 5) and got[2]["match_id"] is None


def test_rules_are_read(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rule": "r", "pattern": "://[a-z]*-shop[.]", "literal": "shop", "action": "block"}\n{"rule": "net/", "host": "net", "path": "/", "literal": "net/", "action": "allow"}\n')
    rules = url_filters.read_rules(spark, f"file://{tmp_path}/rules.json")
    pages = spark.createDataFrame([(1, "http://x-shop.com/"), (2, "http://x-shop.net/")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_language_id_learns_a_text_once(spark):
    own = ["river stone market", "window letter summer", "quiet yellow branch"]
    schema = "text string, lang string"
    once = language_id.fit(spark.createDataFrame([(t, "en") for t in own], schema))
    copied = language_id.fit(spark.createDataFrame([(t, "en") for t in own] + [(own[0], "en")] * 50, schema))
    assert np.allclose(once.idf, copied.idf) and np.allclose(once.centroids, copied.centroids) and np.allclose(once.least, copied.least)


def test_quality(spark, empty):
    import random

    rng = random.Random(4)
    rows = [(k, make(rng, "en", 40) if k % 4 else " ".join(w.upper() + "!!" for w in make(rng, "en", 40).split()), int(k % 4 > 0)) for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = quality.fit(labelled)
    s = model.score([t for _, t, _ in rows])
    assert np.mean((s >= 0.7) == np.array([l for *_, l in rows])) > 0.97
    odd = model.score([None, "", "x" * 100_000, " \n"])
    assert ((0 <= odd) & (odd <= 1)).all()
    assert (quality.fit(labelled.filter("label = 1")).score(["a", None]) >= 0.7).all()
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.keep_good(empty, labels).columns == empty.columns
    assert len(quality.features("abc")) == quality.N_FEATURES


# --- op2


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    want = Counter((d["doc_id"], tuple([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 0])) for d in docs.collect())
    for (doc, ids), times in want.items():
        own = sorted((r for r in rows if r["doc_id"] == doc and r["doc_tokens"] == len(ids)), key=lambda r: (r["start"], r["sequence_id"]))
        covered = Counter()
        for r in own:
            if tuple(r["ids"]) == ids[r["start"] : r["start"] + r["length"]]:
                covered.update(range(r["start"], r["start"] + r["length"]))
        assert all(covered[k] >= times for k in range(len(ids)))
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack(empty, path).count() == 0
    assert packing.binary_lengths(2500) == [1024, 1024, 256, 128, 64, 4]
    with pytest.raises(ValueError):
        packing.pack(docs, path, 1000)


def test_ids_are_those_of_tokenizers():
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    plain, own = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(5)
    alphabet = [" ", "a", "B", "'s", "é", "1", "!", "\n", "\t", "　", "\x85", "\x1c", "​", "日", "<|endoftext|>", "\r\n", "\xa0", "𝕏", "²", "_", "́"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert plain.encode(t, add_special_tokens=False).ids == own(t).tolist(), repr(t)


def test_long_runs_are_encoded_and_packed(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    plain = Tokenizer.from_file(path)
    rows = [" " * 1_000_000 + "a", "\n" * 300_000 + "b", "ab" * 200_000, "1" * 100_000, "word " * 200_000 + "<|endoftext|>" + " x"]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in rows]
    assert [packing.encoder(path)(t).tolist() for t in rows] == [x[:-1] for x in want]
    got = packing.pack(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {k: len(x) for k, x in enumerate(want)}


def test_pieces_are_written_by_bucket(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs, public_tokenizers.path(packing.VOCABULARY)), f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert back.filter("length <> 1 << bucket").isEmpty() and back.count() > docs.count()


# --- op3


def test_exact_dedup(spark, docs, empty):
    d, name = identified(docs)
    d = d.withColumnRenamed(name, ROW_ID)
    got = exact_dedup.mark_copies(d).collect()
    groups = defaultdict(list)
    for r in d.collect():
        groups[SPACES.sub("", r["text"] or "")].append(r)
    by_row = {r[ROW_ID]: r for r in got}
    assert len(got) == docs.count()
    for t, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, r[ROW_ID]))
        for r in rows:
            g = by_row[r[ROW_ID]]
            assert (g["keep_id"], g["group_size"], g["kept"]) == (keep["doc_id"], len(rows), r[ROW_ID] == keep[ROW_ID])
            assert g["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.deduplicate(empty).count() == 0


def test_the_index_persists(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = docs.filter("doc_id % 2 = 0")
    a = exact_dedup.deduplicate(first, exact_dedup.DigestIndex(spark, path)).count()
    again = exact_dedup.DigestIndex(spark, path)  # as another session would open it
    assert again.rows().count() == a
    assert exact_dedup.deduplicate(first, again).count() == 0
    b = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, path)).count()
    assert a + b == len({SPACES.sub("", t or "") for t, in docs.select("text").collect()})
    plan = again.unseen(again.rows().limit(5))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


# --- op4


def test_sharding(spark, docs, empty):
    for n in (1, 7, 40):
        got = sharding.shard(docs, n).collect()
        assert len(got) == docs.count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) <= set(range(n)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = Counter({r["text_crc32"]: r["size"] for r in got})
    assert sizes[zlib.crc32(b"")] == 16
    assert sharding.shard(empty).count() == 0


def test_shards_are_nearly_equal_and_keep_copies(spark):
    rows = [(k, f"text {k % 1500} " + "x" * (k % 1500 * 7 % 300), "l" + str(k % 3), f"s{k % 13 % 7}") for k in range(6000)] + [(k, "hot", "en", "s0") for k in range(6000, 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sharding.shard(df, 10).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 10 and by.max() / by.min() < 1.03
    spread_over = got.groupby(["text_crc32", "size"])["shard"].nunique()
    assert (spread_over > 1).sum() <= 3


# --- op5


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_ngram_join(spark, docs, empty):
    got = ngram_join.near_copies(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns
    assert one.count() == len({r["component_id"] for r in got if r["n_shingles"]}) + sum(not r["n_shingles"] for r in got)
    assert ngram_join.near_copies(empty).count() == 0
    few_numbers = ngram_join.near_copies(docs, bits=3).collect()  # most sets share theirs with others at first
    assert sorted(few_numbers, key=str) == sorted(got, key=str)


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "HEAVY", 20)
    rng = random.Random(6)
    base, other = make(rng, "en", 80), make(rng, "de", 50)
    rows = [(k, near(rng, base, rng.randrange(1, 5))) for k in range(60)] + [(100 + k, make(rng, "de", 40) + " " + other) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(df).collect())
    assert got == brute_components(rows)


def test_prefixes_hold_what_they_must():
    import random

    rng = random.Random(7)
    order = ngram_join.Order(np.array([3, 5], np.int64), np.array([9, 4], np.int64))
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = set(rng.sample(range(1000), n))
        b = set(rng.sample(sorted(a), n - rng.randrange(0, n // 5 + 1))) | set(rng.sample(range(1000, 2000), rng.randrange(0, n // 6 + 1)))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = (np.array(sorted(s), np.int64) for s in (a, b))
        prefix = lambda s, which, k=1: set(order.sort(s, which)[: ngram_join.prefix_length(len(s), k)].tolist())
        for which in range(3):
            assert prefix(x, which) & prefix(y, which)
        both = prefix(x, 0, ngram_join.quarter(len(x))) & prefix(y, 0, ngram_join.quarter(len(y)))
        for n in (len(x), len(y)):
            assert len(both) >= ngram_join.quarter(ngram_join.least_common(n))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 130)) and got[201] == 200


def test_rows_keep_their_ids_when_a_scan_is_split_otherwise(spark, tmp_path, monkeypatch):
    docs = written(spark, documents(spark).drop("shard"), f"{tmp_path}/documents.parquet")

    def results(name):
        sharding.write_shards(docs, f"{tmp_path}/{name}", 4)
        shards = spark.read.parquet(f"{tmp_path}/{name}")
        tables = exact_dedup.deduplicate(docs), ngram_join.one_of_each(docs), shards.drop("shard")
        return [sorted(map(str, x.select("doc_id", "text", "source").collect())) for x in tables]

    def then_split_otherwise(module, name, before=False):
        f, splits = getattr(module, name), lambda n: spark.conf.set("spark.sql.files.minPartitionNum", n)

        def run(*args):
            splits(1 if before else 64)
            out = f(*args)
            splits(1)
            return out

        monkeypatch.setattr(module, name, run)

    want = results("once")
    assert len(want[2]) == docs.count()
    try:
        then_split_otherwise(exact_dedup, "mark_copies")
        then_split_otherwise(ngram_join, "near_copies")
        then_split_otherwise(sharding, "shard")
        spark.conf.set("spark.sql.files.minPartitionNum", 64)
        assert results("otherwise") == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


# --- op7


def test_bpe(spark, docs, empty):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(path).ranks, special_tokens={})
    rows = docs.select("doc_id", "text", bpe.encode("text", path).alias("ids")).select("*", bpe.decode("ids", path).alias("back")).collect()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == engine.encode_ordinary(r["text"] or "")
        assert r["back"] == (r["text"] or "").encode()
    assert empty.select(bpe.encode("text", path)).count() == 0


def test_bpe_words_of_any_length():
    import random

    import tiktoken

    c = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(8)
    for n in (2, 9, 40, 255, 256, 257, 700, 1500):
        word = "".join(rng.choice("theingaé") for _ in range(n))
        want = np.array(engine.encode_ordinary(word), "<u4").tobytes()
        assert c.encode([word]) == [want] and c.long_word(word.encode()) == want
        raw = word.encode()
        if len(raw) <= bpe.LONG and raw not in c.ranks:
            assert c.words([raw]) == [want]


# --- op8


def test_katz_base_and_counts(spark, docs, empty):
    train = docs.filter("doc_id % 3 <> 0")
    model = lm.fit(train, dictionary=20)
    counts = Counter(w for r in train.collect() for w in [*split(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    assert (model.words.total, model.words.different) == (n, v)
    got = {r[ROW_ID]: r for r in lm.score(docs, model).collect()}
    for r in with_row_id(docs.select("doc_id", "text")).collect():
        words, g = [*split(r["text"]), None], got[r[ROW_ID]]
        assert (g["doc_id"], g["n_tokens"], g["n_known"]) == (r["doc_id"], len(words), sum(counts[w] > 0 for w in words))
        assert abs(g["base_score"] - sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6
        assert np.isfinite(g["score"]) and g["score"] < 0
    assert lm.score(empty, model).count() == 0
    none = lm.fit(empty)
    scored = lm.score(docs, none).collect()
    assert all(abs(r["score"] - r["base_score"]) < 1e-6 and r["n_known"] == 0 for r in scored)


@pytest.mark.parametrize("parts", [[], [5], [3, 1, 3, 0, 1, 3], [2] * 4])
def test_katz_parts_of_a_block(parts):
    got = [(p, at.tolist()) for p, at in lm._by_part(np.array(parts, np.int64))]
    assert got == [(p, [i for i, x in enumerate(parts) if x == p]) for p in sorted(set(parts))]


@pytest.mark.parametrize("dictionary", [3, 100])
def test_katz_chances_sum_to_one(spark, dictionary):
    rows = ["a b a c d", "a b b a", "c a b d a b", "e f", "a b c d a b g", "h i j", "a b a b a b a b"] * 2 + ["x y z"]
    model = lm.fit(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), dictionary)
    words, pairs = model.words, model.pairs
    held = {}
    for r in model.counts.collect():
        held |= dict(zip(np.cumsum(spread(r["keys"], np.int64)).tolist(), spread(r["counts"], np.int64).tolist(), strict=True))
    vocabulary = sorted({w for t in rows for w in t.split()})

    def chance(h, word):
        key = np.array([lm.END_KEY]) if word is None else text.word_keys(word)
        i = int(words.id_of(key)[0])
        c = words.counts[i] if i else held.get(int(lm._rare(key)[0]), 0)
        p, pair = pairs.word[i] + pairs.back[h], (h << 20) + i
        if pair in held:
            p += pairs.value(np.array([pair]), np.array([held[pair]]))[0]
        return 10 ** (p + (np.log10(words.chance(np.array([c])))[0] - pairs.word[lm.RARE] if i == lm.RARE else 0))

    for h in [lm.START, *(int(words.id_of(text.word_keys(w))[0]) for w in "abcxe")]:
        assert abs(sum(chance(h, w) for w in [*vocabulary, None, "unknown"]) - 1) < 1e-9


def test_katz_scores_pairs_of_all_words(spark, monkeypatch):
    # few words and pairs are broadcast, so the others come from the tables
    monkeypatch.setattr(lm, "DICTIONARY", 2)
    monkeypatch.setattr(lm, "HOT", 12)
    rows = ["a b a c d", "a b b a", "c a b d a b", "e f", "a b c d a b g", "h i j", "a b a b a b a b", "e f g e f", "h i e f", ""] * 2 + ["x y z"]
    asked = [*rows, "e f e g", "i j h", "x z y unknown d", "unknown unknown", "a unknown b", None]
    schema = "doc_id bigint, text string"
    model = lm.fit(spark.createDataFrame(list(enumerate(rows)), schema))
    assert 0 < len(model.pairs.hot) < 20
    tokens = lambda t: [*(t or "").split(), None]
    uni = Counter(w for t in rows for w in tokens(t))
    duo = Counter(p for t in rows for p in zip(["<s>", *tokens(t)], tokens(t), strict=False))
    total = sum(uni.values())
    d1, d2 = (lm.good_turing(Counter(n.values())) for n in (uni, duo))
    kept = lambda d, c: c * (d[c] if c <= lm.CUTOFF else 1)
    rest = 1 - sum(kept(d1, c) for c in uni.values()) / total
    low = lambda w: kept(d1, uni[w]) / total if uni[w] else rest

    def chance(h, w):
        seen = {x: c for (g, x), c in duo.items() if g == h}
        n, k = sum(seen.values()), sum(kept(d2, c) for c in seen.values())
        below = n + 1 if seen and k > n * (1 - 1e-9) else n
        if w in seen:
            return kept(d2, seen[w]) / below
        return low(w) * ((1 - k / below) / (1 - sum(map(low, seen))) if seen else 1)

    for h in ("<s>", *uni - Counter([None]), "unknown"):
        if h is not None:
            assert abs(sum(chance(h, w) for w in [*uni, "unknown"]) - 1) < 1e-9
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(enumerate(asked)), schema), model).collect()}
    for k, t in enumerate(asked):
        want = sum(np.log10(chance(h, w)) for h, w in zip(["<s>", *tokens(t)], tokens(t), strict=False))
        assert abs(got[k]["score"] - want) < 1e-8, t
        assert got[k]["n_known"] == sum(w in uni for w in tokens(t))


def test_good_turing_falls_back():
    assert (lm.good_turing({})[1:] < 1).all()
    d = lm.good_turing({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6})
    assert (d[1:] > 0).all() and (d[1:] < 1).all()


# --- op9


def test_audio_alignment(spark):
    rng = np.random.default_rng(9)
    pcm = lambda notes: np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * np.arange(512) / 4000) for k in notes])

    def wav(x):
        import io
        import wave

        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(4000)
            w.writeframes((np.clip(x, -1, 1) * 30000).astype("<i2").tobytes())
        return out.getvalue()

    tunes = [pcm(rng.integers(0, 24, 60)) for _ in range(6)]
    rows = [(100 * k, wav(t)) for k, t in enumerate(tunes)]
    rows += [(100 * k + 1, wav(t + rng.normal(0, 0.02, len(t)))) for k, t in enumerate(tunes)]
    rows += [(100 * k + 2, wav(t[256 * 20 :])) for k, t in enumerate(tunes)] + [(103, rows[1][1]), (7, None), (8, b"junk"), (9, wav(np.zeros(100))), (9, None)]
    df = spark.createDataFrame(rows, "rec_id bigint, wav binary")
    got = {r["rec_id"]: r for r in audio.align(df.select("rec_id", audio.fingerprints("wav").alias("fp"))).collect()}
    for k in range(6):
        assert got[100 * k + 1]["match_id"] == 100 * k and got[100 * k + 1]["offset"] == 0
        assert got[100 * k + 2]["match_id"] == 100 * k and got[100 * k + 2]["offset"] == -20
    assert (got[103]["match_id"], got[103]["bit_error"], got[103]["class_id"]) == (100, 0.0, 100)
    assert all(got[k]["n_codes"] == 0 and got[k]["match_id"] is None for k in (7, 8, 9))
    # brute force: every pair of fingerprints at every offset
    codes = {i: audio.fingerprint(w).view(np.uint32) for i, w in rows if i not in (7, 8, 9, 103)}
    for i, fp in codes.items():
        if i % 100 == 0:
            continue
        best = []
        for q in (x for x in codes if x % 100 == 0):
            begins = lambda x: [k for k in range(len(x)) if not k or x[k] != x[k - 1]]
            votes = Counter(b - a for a in begins(codes[q]) for b in begins(fp) if fp[b] == codes[q][a])
            if votes and (top := min(votes.items(), key=lambda x: (-x[1], abs(x[0]), x[0])))[1] >= audio.VOTES:
                o = top[0]
                a, b = codes[q][max(0, -o) :], fp[max(0, o) :]
                n = min(len(a), len(b))
                error = sum(int(x).bit_count() for x in a[:n] ^ b[:n]) / (32 * n)
                if error <= audio.ERROR and 2 * n >= min(len(fp), len(codes[q])):
                    best.append((error, q, o))
        assert (got[i]["match_id"], got[i]["offset"]) == (min(best)[1:] if best else (None, None))
    assert audio.align(df.limit(0).select("rec_id", audio.fingerprints("wav").alias("fp"))).count() == 0
    assert audio.fingerprint(audio.melody(None)).size == 0


def test_audio_queries_are_targets_too(spark):
    rng = np.random.default_rng(3)
    tunes = [rng.uniform(-0.3, 0.3, 60) for _ in range(3)]
    made = lambda x: audio.fingerprint(audio.melody(x)).tolist()
    near = [np.append(t[:-4], rng.uniform(-0.3, 0.3, 4)) for t in tunes]
    # 100 and 200 are near copies; the copies of 300 have a query, and its near copy is one; 500 is like none
    rows = [(100, tunes[0]), (200, near[0]), (300, tunes[1]), *((301 + k, tunes[1]) for k in range(5)), (400, near[1]), (500, tunes[2])]
    df = spark.createDataFrame([(i, made(x)) for i, x in rows], "rec_id bigint, fp array<int>")
    best, further = audio.search(df)
    assert sorted((r["class_id"], r["match_id"]) for r in further.collect()) == [(100, 200), (200, 100), (300, 400), (400, 300)]
    assert all(0 < r["bit_error"] <= audio.ERROR and r["votes"] >= audio.VOTES for r in further.collect())
    assert sorted((r["rec_id"], r["match_id"]) for r in best.collect()) == sorted((i, 300 if 300 <= i < 400 else i) for i, _ in rows)


def test_audio_gives_all_matches_at_any_offset_that_passes(spark):
    rng = np.random.default_rng(4)
    code = lambda n: rng.integers(-(2**31), 2**31, n).astype(np.int64)
    flip = lambda x: x ^ 3
    a, b = code(40), code(40)
    loop = code(4)
    # 7 is a medley of 100 and 200. 300 and 9 have a loop in common at another offset with more votes, which fails
    c, d = code(60), None
    c[50:54] = loop
    d = flip(c)
    d[:3] = c[:3]
    d[10:14] = loop
    rows = [(100, a), (200, b), (7, np.concatenate([flip(a[:20]), a[20:], b[:20], flip(b[20:])])), (300, c), (9, d)]
    schema = "rec_id bigint, fp array<int>"
    best, further = audio.search(spark.createDataFrame([(i, x.tolist()) for i, x in rows], schema))
    best, further = {r["rec_id"]: r for r in best.collect()}, further.collect()
    assert {best[7]["match_id"], *(r["match_id"] for r in further if r["rec_id"] == 7)} == {100, 200}
    assert [(r["rec_id"], r["class_id"]) for r in further] == [(7, 7)]
    assert (best[9]["match_id"], best[9]["offset"], best[9]["votes"]) == (300, 0, 3)


# --- op10


def test_url_filters(spark):
    urls = [None, "", "no scheme casino-x.com", "http://A.Example.NET/en/1", "http://example.net/de/1", "https://notexample.net/", "http://x.org/fr/", "http://x.org/de", "https://m.casino-win.example.com/en/1", "http://example.com/de/9?x=://y.net/",
            "http://a.b.com/casino-x.html", "http://free-bets.example.org/fr/1", "HTTP://net", "http://net/", "://net/x#y", "http://spam7.com", "http://a\n.net/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(3, urls[3], "again"), (None, urls[4], "x")], "page_id bigint, url string, rule string")
    rules = url_filters.default_rules(spark)
    got = url_filters.judge(pages, rules).collect()
    assert len(got) == len(urls) + 2

    def brute(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = max(((len(h + p), h + p, a) for h, p, a in url_filters.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        blocked = any(re.search(x, u.lower()) for x, _, _ in url_filters.PATTERN_RULES)
        return host, path, fit and fit[1], fit[2] if fit else "block" if blocked else "allow"

    for r in got:
        u = urls[r["page_id"]] if r["page_id"] is not None else urls[4]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(u), u
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    index = {r["rule"]: r["token"] for r in url_filters.index_rules(rules, pages).collect()}
    assert index["example.net/en/"] == "en"  # fewer URLs have it than net or example
    with pytest.raises(ValueError):
        url_filters.index_rules(spark.createDataFrame([("r", "", "", "x+", "...", "block")], url_filters.RULES_SCHEMA), pages)


def test_few_plans_of_near_copies(spark, monkeypatch):
    cuts = []
    for module in (components, ngram_join):
        monkeypatch.setattr(module, "cut", lambda df, name="cut", f=module.cut: (cuts.append(name), f(df, name))[1])
    star = spark.createDataFrame([(k, 0) for k in range(1, 9)], "u bigint, v bigint")
    assert {r["label"] for r in components.components(star).collect()} == {0}
    assert cuts == ["edges"]  # no round where all is a star
    ranked = spark.createDataFrame([(k, 5, [1, 2, 3, 4, 5], [1]) for k in range(40)], "c bigint, n bigint, shared array<bigint>, three array<bigint>")
    pairs = ngram_join.cut(spark.createDataFrame([(0, k) for k in range(1, 39)] + [(k, 39) for k in range(20)], "a bigint, b bigint"), "pairs")
    want = sorted(map(tuple, pairs.collect()))
    for asked, least in ((256, 1), (7, 2)):  # no class is in many pairs; one at either end is
        cuts.clear()
        monkeypatch.setattr(ngram_join, "ASKED", asked)
        assert sorted(map(tuple, ngram_join._linked(pairs, ranked).collect())) == want
        assert cuts.count("asked") == least


def test_bpe_split_of_ascii_is_that_of_the_pattern():
    import random

    rnd = random.Random(3)
    every = "".join(map(chr, range(128)))
    for text in [every, *(a + b for a in every for b in every), *("".join(rnd.choices("aZ's1 \t\n\r\x1c\x1f.,tlvedm", k=rnd.randrange(14))) for _ in range(20_000))]:
        assert bpe.ascii_pattern().findall(text) == bpe.pattern().findall(text) == bpe.words_of(text)
    for text in ("a\x85 b", "é 1", "\u3000x", "", None):
        assert bpe.words_of(text) == (bpe.pattern().findall(text) if text else [])


def test_bpe_encodes_a_text_once(spark, tmp_path):
    texts = [None, "", "a", "é ü 1\n\n x", "word " * 3000, "z" * 1500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = bpe.op7_bpe(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(") == 1 and plan.count("ArrowEvalPython") == 1  # a chain would be run(text), run(run(text))
    for r in got.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        ids = bpe.codec(public_tokenizers.path(bpe.VOCABULARY)).encode([texts[r["doc_id"]]])[0]
        assert r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_katz_reads_texts_three_times(spark, monkeypatch):
    calls = []
    df = spark.createDataFrame([(k, "a b a c " * 3 + f"w{k}") for k in range(12)], "doc_id bigint, text string").coalesce(1)
    before = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: (calls.append(f.__qualname__), before(self, f, *a, **b))[1])
    assert lm.score(df, lm.fit(df)).count() == 12
    assert len(calls) == 3  # words, pairs of both kinds, scores


def test_katz_words_of_a_block(monkeypatch):
    import random

    import pyarrow as pa
    import xxhash

    rnd = random.Random(5)
    every = [None, "", " ", "\t\r\n\x0b\x0c ", "A\x00b \x1c\x1f x\x85y \xa0\u2003\u3000 \xc4\xe4 \u0130", *("".join(rnd.choices("aB \t\n\x0b\x0c\r\x1c\x85\u3000\xc9", k=rnd.randrange(30))) for _ in range(3000))]
    rows = [*range(7, 1500), *range(2000, 2000 + len(every) - 1493)]
    want = [[*text.word_keys(t).tolist(), lm.END_KEY] for t in every]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([None, *rows[1:]]), pa.array(every, pa.string())], names=["r", "d", "t"])
    hashed, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: (hashed.append(w), digest(w))[1])
    for block, size in ((10**6, 10**6), (200, 70), (1, 1)):
        monkeypatch.setattr(lm, "BLOCK", block)
        monkeypatch.setattr(lm, "SLICE", size)
        got = list(lm._blocks(iter([batch.slice(0, 0), batch.slice(0, 1000), batch.slice(1000)])))
        assert [first + k for first, ids, *_ in got for k in range(len(ids))] == rows
        assert [x for _, ids, *_ in got for x in ids] == [None, *rows[1:]]
        tokens = [x for _, _, keys, at, sizes in got for x in np.split(keys[at], np.cumsum(sizes)[:-1])]
        assert [x.tolist() for x in tokens] == want
        assert all(len(at) <= block or len(ids) == 1 for _, ids, _, at, _ in got)
    # a word is hashed once in a slice, also where there are more different ones than `word_keys` remembers
    hashed.clear()
    text.word_codes(pa.array([" ".join(f"w{k}" for k in range(150_000))] * 2))
    assert len(hashed) == 150_000
