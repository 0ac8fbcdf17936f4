"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ROW_ID string, digest string, node bigint, s bigint, shard string"
WORDS = {
    "en": "the of and to in that for with river stone market window letter summer quiet yellow branch candle".split(),
    "de": "der die und zu den das nicht fluss stein markt fenster brief sommer ruhig gelbe zweig kerze straße über".split(),
}


def make(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def near(rng, text, times=1):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
    return " ".join(words)


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", "   \t\n", "123 456 ...", "One", "one", "two words", "the cat sat on", "THE CAT SAT ON", "the cat sat on mats", "a" * 3000, "日本語 テキスト " * 40, "x\u0000y ퟿   z", " lead", "trail \x0b\x0c\r"]
    for k in range(40):
        out.append(make(rng, "en" if k % 2 else "de", rng.randrange(5, 90)))
    passage = make(rng, "en", 60)
    out += [make(rng, "de", 30 + k) + " " + passage for k in range(8)]
    for t in out[15:35]:
        out += [near(rng, t, k) for k in (1, 2)]
    out += [out[20]] * 6 + [out[21].replace(" ", "\n")] * 3
    out.append(make(rng, "en", 6000))
    return out


def documents(spark, rows=None, partitions=3):
    rows = texts() if rows is None else rows
    data = [(k * 7 % 1009, t, ("en", "de")[k % 2] if k % 11 else None, f"s{k % 3}" if k % 5 else None, None, "clash", "clash", 1, 2, "clash") for k, t in enumerate(rows)]
    if rows:
        data += [data[-1], (None, rows[-1], None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions, "n_chars", "doc_id")


def written(spark, df, path):
    """A table to read, as the operators take it."""
    df.write.parquet(path)
    return spark.read.parquet(path)
