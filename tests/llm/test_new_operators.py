"""Conversation repair, importance resampling and substring dedup against brute force on awkward small tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, make, written
from tidemark.llm import conversations, resampling, substring
from tidemark.llm.common import ROW_ID, identified

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return written(spark, documents(spark), str(tmp_path_factory.mktemp("n") / "documents.parquet"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_id(df):
    df, name = identified(df.select("doc_id", "text"))
    return df.withColumnRenamed(name, ROW_ID)


# --- op11


def cheapest(kinds):
    """(cost, audit) by a search over all edits. kinds: (role initial, truncated, must go)."""
    best, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if best.get((i, s), (cost, audit)) < (cost, audit):
            continue
        if i == len(kinds) and s in (0, 3):
            return cost, audit
        chosen = 3 if s == 2 else 2
        moves = [(2, "I", i, chosen)]
        if i < len(kinds):
            role, truncated, bad = kinds[i]
            moves.append((3, "D", i + 1, s))
            if not bad:
                moves.append((2 + truncated, "R", i + 1, chosen))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, s))
                moves += [(truncated, "K", i + 1, to)] if to else []
        for c, letter, j, t in moves:
            new = (cost + c, audit + letter)
            if new < best.get((j, t), (math.inf, "")):
                best[j, t] = new
                heapq.heappush(heap, (*new, j, t))


def plain_repair(rows):
    """rows (turn, role, text) of one conversation, nulls gone, in order."""
    seen, kinds, faults, lines = set(), [], Counter(), []
    for _, role, text in rows:
        rest = text.rstrip(SPACE)
        fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        kinds.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
    cost, audit = cheapest(kinds)
    state, at = 0, 0
    for letter in audit:
        if letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[kinds[at][0]]
            lines.append(f"{rows[at][1]}:{rows[at][2]}")
        elif letter in "RI":
            state = 3 if state == 2 else 2
            lines.append(("user:" if state == 2 else "assistant:") + (rows[at][2] if letter == "R" else ""))
        at += letter != "I"
    turns = {t for t, *_ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation_rows(seed):
    rng = random.Random(seed)
    texts = ["A b.", "What?", "cut off", "", " \t", None, "A b.", "Yes! \n", "é…", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "u", "assistant", "user"]
    rows = [(c, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(25), None] for _ in range(rng.randrange(1, 8))]
    # one conversation holds a third of all rows, many of them equal
    return rows + [(77, k // 2, rng.choice(roles[:3]), rng.choice([*texts, f"own {k}."])) for k in range(60)] + [(77, 5, "user", "A b.")] * 8


def order(rows):
    text = lambda x: " " if x is None else x
    rows = [(t, text(r), text(x)) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_conversation_repair_by_brute_force(spark, ranges):
    rows = conversation_rows(ranges)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, k string").repartition(3)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(ranges), "false"), strict=True):
        spark.conf.set(n, v)
    try:
        done = conversations.repair(df)
        sha = {r["conv_id"]: r["sha"] for r in done.digests.collect()}
        got = {r["conv_id"]: (*(r[c] for c in conversations.COUNTS), r["audit"], sha[r["conv_id"]]) for r in done.reports.collect()}
        turns = done.turns.orderBy("conv_id", "piece", "n").collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(r)
    want = {c: plain_repair(order(r)) for c, r in by.items()}
    assert got == want
    lines = defaultdict(list)
    for r in turns:
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_layers_equal_a_search_and_parts_equal_the_whole():
    rng = random.Random(2)
    for _ in range(1500):
        kinds = [(rng.choice("suat"), rng.randrange(2), rng.random() < 0.2) for _ in range(rng.randrange(10))]
        codes = bytes({"s": 1, "u": 2, "a": 3, "t": 0}[r] | 4 * t | 8 * b for r, t, b in kinds)
        held = conversations.layers(codes)
        want = cheapest([(r, int(t and not b), b) for r, t, b in kinds])
        assert (conversations.least(held[0], 0), conversations.trace(codes, held, 0)[0]) == want


def test_damage_and_conversations_that_lose_all_rows(spark, empty):
    rows = [(c, t, "user", f"Text {t}. Yes!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = defaultdict(list)
    for r in conversations.damage(df).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    for c, t, role, text in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(n, [(role, text)])
        assert got[c, t] == want
    none = conversations.repair(df.limit(0))
    assert none.reports.count() == none.turns.count() == none.digests.count() == 0


# --- op12

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def test_importance_resampling_by_brute_force(spark, docs, monkeypatch):
    target = spark.createDataFrame([("river stone Market",), (None,), ("stone, market",)], "text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for r in target.collect():
        t.update(map(bucket, features(r[0])[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    want = []
    for d, x in rows:
        words, f = features(x)
        weight = math.floor(sum(gain[bucket(y)] for y in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((r[0], k) for k, r in enumerate(able[: 25 * len(able) // 100], 1))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for piece in (resampling.PIECE, 40):  # short pieces: every pair across a cut is counted once too
        monkeypatch.setattr(resampling, "PIECE", piece)
        got = resampling.resample(with_id(docs), target).collect()
        assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted((r[:4] for r in want), key=key)
        assert Counter((r["doc_id"], r["rank"]) for r in got if r["rank"]) == drawn


def test_pieces_hold_every_word_and_pair_once(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 30)
    rng = random.Random(3)
    for k in range(200):
        text = "".join(rng.choice(["Ab", "é", " ", "-", "x" * 40, "\x00", "7"]) for _ in range(k))
        words, pairs = [], []
        for piece, tail in resampling.pieces(text):
            own = features(piece)[0]
            words += own
            pairs += [*zip(own, own[1:], strict=False)] + ([(own[-1], tail)] if own and tail else [])
        assert words == features(text)[0]
        # a piece of no word at all may lie between two words; then the cut is after it
        assert pairs == [*zip(words, words[1:], strict=False)] or any(not features(p)[0] for p, _ in resampling.pieces(text))


def test_drawn_rows_keep_their_columns(spark, docs, empty):
    target = spark.createDataFrame([("river",)], "text string")
    got = resampling.draw(docs, target)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()
    assert resampling.resample(with_id(empty), target).count() == 0
    assert resampling.resample(with_id(docs), target.limit(0)).count() == docs.count()


# --- op13


def plain_removal(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    last = float("inf")
    ids = [last if d is None else d for d, _ in rows]
    least = {}
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, last), d)
    out = []
    for (doc, _), d, w in zip(rows, ids, words, strict=True):
        gone = set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(spark):
    rng = random.Random(4)
    passage, license = make(rng, "en", 60), make(rng, "de", 14)
    rows = []
    for k in range(140):
        own = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(own) + 1)
        middle = rng.choice(["", passage, license, " ".join(license.split()[:12]), " ".join(passage.split()[rng.randrange(20) : 20 + rng.randrange(30)])])
        rows.append((k * 37 % 1009, " ".join([*own[:at], middle, *own[at:]])))
    rows += [(2000 + k, rows[3][1].replace(" ", "\n")) for k in range(40)] + [(3000, passage + "\t" + passage), (3001, "a " * 300), (3002, "a " * 90), (5, None), (6, ""), (None, passage), (None, passage), (7, passage), (7, passage)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, n_words string").repartition(5), rows


@pytest.mark.parametrize(("block_rows", "bucket_words"), [((1024, 1), 4_000_000), ((4, 1), 300)])
def test_substring_dedup_by_brute_force(spark, tmp_path, monkeypatch, block_rows, bucket_words):
    monkeypatch.setattr(substring, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(substring, "BUCKET_WORDS", bucket_words)
    df, rows = passages(spark)
    df = written(spark, df, f"{tmp_path}/d")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(plain_removal(rows), key=key)
    got = substring.repeats(with_id(df), digests=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=key) == sorted(((d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in want), key=key)
    assert all(sum(s["n"] for s in r["spans"]) == r["n_removed"] for r in got)
    kept = substring.clean(df)
    assert kept.columns == df.columns
    texts = Counter((d, k if m else t) for (d, t), (_, _, m, k) in zip(rows, plain_removal(rows), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == texts


def test_substring_dedup_of_awkward_and_empty_tables(spark, docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.repeats(with_id(docs)).collect()]
    assert sorted(got, key=key) == sorted((r[:3] for r in plain_removal(rows)), key=key)
    assert substring.repeats(with_id(empty)).count() == 0
    assert substring.clean(empty).columns == empty.columns


def test_any_two_places_share_a_shift_into_the_cover():
    p, cover = substring.PERIOD, substring.COVER
    assert all(any((a + d) % p in cover and (b + d) % p in cover for d in range(p)) for a in range(p) for b in range(p))
    assert substring.ANCHOR + p - 1 == substring.WINDOW


# --- what earlier operators had left open


def wav(samples, rate, channels=1):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.tobytes())
    return out.getvalue()


def test_recordings_without_a_rate_and_long_ones(monkeypatch):
    import numpy as np

    from tidemark.llm import audio

    x = (np.sin(np.arange(60_000) * np.linspace(0.2, 0.9, 60_000)) * 20_000).astype("<i2")
    raw = bytearray(wav(x, 8000))
    whole = audio.fingerprint(bytes(raw))
    monkeypatch.setattr(audio, "AT_ONCE", 7)
    assert len(whole) > 100 and (audio.fingerprint(bytes(raw)) == whole).all()
    assert (audio.fingerprint(wav(np.repeat(x, 2), 8000, 2)) == whole).all()
    raw[24:28] = bytes(4)
    assert len(audio.fingerprint(bytes(raw))) == 0


def test_an_index_keeps_its_number_of_buckets(spark, tmp_path):
    from tidemark.llm import exact_dedup

    path = f"file://{tmp_path}/index"
    assert exact_dedup.DigestIndex(spark, path, rows=30 * exact_dedup.BUCKET_ROWS).buckets == 30
    assert exact_dedup.DigestIndex(spark, path).buckets == 30
    assert exact_dedup.DigestIndex(spark, f"file://{tmp_path}/small", rows=5).buckets == exact_dedup.BUCKETS
