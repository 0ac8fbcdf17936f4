"""Importance resampling towards a target distribution, over hashed n-grams.

Words are runs of anything but the ASCII characters that are neither letters nor digits, with A-Z lower-cased; features
are all runs of one or two words, joined by a space, repeats counted, each in the bucket of its CRC-32. In each
partition DuckDB unnests a text's words, makes the pairs by a window, and counts buckets through zlib's CRC, registered
as a function. A document's counts are spilled to Parquet; Spark merges them to the counts of all documents and of all
target texts, gives each bucket its gain, and a document the mean gain of its features. A draw by the Gumbel trick, with
a hash of the id for chance, ranks the documents that are long enough.

A text is taken in pieces of at most PIECE characters that are cut between words; the first word of the next piece goes
along for the pair across the cut, so a text of any length is counted whole in bounded memory. A null or empty text has
no features: weight 0, never drawn (it has too few words). A null doc_id hashes as an empty one and goes after others in
ties; repeated rows are drawn each for itself. Empty tables give empty results, and without target texts all gains follow
from the smoothing. Only doc_id and text are read, and text of the target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import global_row_number

from .common import ROW_ID, crc32_sql, cut, identified, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Characters of a piece of a text, and of the pieces that one query takes.
PIECE, AT_ONCE = 500_000, 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: pieces (r, text, tail): a row, a piece of its text, the word after it. -> r, words, buckets, counts.
COUNT = f"""
WITH t AS (SELECT p, r, tail, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM pieces),
w AS (SELECT p, r, tail, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
n AS (SELECT r, word, coalesce(lead(word) OVER (PARTITION BY p ORDER BY pos), tail) AS after FROM w),
f AS (SELECT r, word AS feature, 1 AS words FROM n UNION ALL SELECT r, word || ' ' || after, 0 FROM n WHERE after IS NOT NULL),
b AS (SELECT r, crc(feature) % {{buckets}} AS bucket, count(*) AS n, sum(words) AS words FROM f GROUP BY ALL)
SELECT r, CAST(sum(words) AS BIGINT) AS words, list(CAST(bucket AS INT)) AS buckets, list(n) AS counts FROM b GROUP BY r ORDER BY r
"""


def pieces(text: str | None) -> Iterator[tuple[str, str | None]]:
    """(piece, the first word after it) of a text."""
    text, begin = text or "", 0
    while len(text) - begin > PIECE:
        gap = _BETWEEN.search(text, begin + PIECE)
        end = gap.start() if gap else len(text)
        after = _WORD.search(text, end)
        yield text[begin:end], after and after[0].translate(str.maketrans(_UPPER, _LOWER))
        begin = end
    yield text[begin:], None


class Counter:
    """DuckDB in a Python worker, with the CRC as a function."""

    def __init__(self, buckets: int):
        import duckdb
        from duckdb.sqltypes import BIGINT, VARCHAR

        self.db, self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "preserve_insertion_order": True}), COUNT.format(buckets=buckets)

        def crc(texts: pa.ChunkedArray) -> pa.Array:
            return pa.array([crc32(x) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())

        self.db.create_function("crc", crc, [VARCHAR], BIGINT, type="arrow")

    def count(self, held: list[tuple[int, str, str | None]]) -> pa.Table:
        r, texts, tails = zip(*held, strict=True)
        self.db.register("pieces", pa.table({"p": pa.array(range(len(r)), pa.int64()), "r": pa.array(r, pa.int64()), "text": pa.array(texts, pa.string()), "tail": pa.array(tails, pa.string())}))
        found = self.db.sql(self.sql).to_arrow_table()
        self.db.unregister("pieces")
        return found


def counted(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs (any columns, then text) -> these columns, words, buckets, counts. A long text, or one at the end of a batch,
    may have several rows; one without words has none."""
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]
    told_as = pa.schema([("words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    names = [*docs.columns[:-1], *told_as.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(buckets)
            held, size = [], 0

            def told() -> Iterator[pa.RecordBatch]:
                found = counter.count(held)
                if found.num_rows:
                    at, made = found["r"].combine_chunks(), found.select(["words", "buckets", "counts"]).cast(told_as).combine_chunks()
                    ids = [b.column(k).take(at) for k in range(b.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*ids, *(c.combine_chunks() for c in made.columns)], names=names)

            for r, text in enumerate(b.column(b.num_columns - 1)):
                for piece, tail in pieces(text.as_py()):
                    held.append((r, piece, tail))
                    size += len(piece) + 50
                    if size > AT_ONCE:
                        yield from told()
                        held, size = [], 0
            if held:
                yield from told()

    return docs.mapInArrow(run, ", ".join([*own, "words bigint", "buckets array<int>", "counts array<bigint>"]))


def merged(spilled: DataFrame) -> DataFrame:
    """bucket, n of all rows."""
    both = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return both.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: a thousand times the logarithm of the smoothed ratio, down to an integer. One row for each bucket."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = F.expr(f"((t + 1.0D) * (all_s + {buckets}.0D)) / ((s + 1.0D) * (all_t + {buckets}.0D))")
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain"))


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the id, in thousandths, down to an integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs (ROW_ID, doc_id, text), target (text) -> ROW_ID, doc_id, n_words, n_features, weight."""
    spilled = cut(counted(docs.select(ROW_ID, "text"), buckets), "bucket-counts")
    aimed = cut(counted(target.select("text"), buckets), "target-counts")
    gain = gains(cut(merged(spilled), "source"), merged(aimed), buckets)
    rows = spilled.select(ROW_ID, F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select(ROW_ID, F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("n"))
    sums = rows.join(F.broadcast(gain), "bucket").groupBy(ROW_ID).agg(F.sum("n").alias("n_features"), F.sum(F.col("n") * F.col("gain")).alias("total"))
    words = spilled.groupBy(ROW_ID).agg(F.sum("words").alias("n_words"))
    zero = F.lit(0).cast("bigint")
    return docs.select(ROW_ID, "doc_id").join(sums.join(words, ROW_ID), ROW_ID, "left").select(
        ROW_ID, "doc_id", F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_features", zero).alias("n_features"),
        F.coalesce(F.floor(F.col("total") / F.col("n_features")), zero).cast("bigint").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (ROW_ID, doc_id, text) -> ROW_ID, doc_id, n_features, weight, score, rank: 1 to the number drawn, else null."""
    found = weights(docs, target, buckets).withColumns({"score": F.col("weight") + chance(F.col("doc_id"), seed), "able": F.col("n_words") >= least_words})
    placed = global_row_number(found, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    drawn = placed.filter("able").agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("drawn"))
    return placed.join(F.broadcast(drawn)).select(ROW_ID, "doc_id", "n_features", "weight", "score", F.when(F.col("place") <= F.col("drawn"), F.col("place")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of docs, with all their columns."""
    docs, name = identified(docs)
    chosen = resample(docs.select(F.col(f"`{name}`").alias(ROW_ID), "doc_id", "text"), target, percent).filter("rank is not null")
    return docs.join(chosen.select(F.col(ROW_ID).alias(name)), name, "left_semi").drop(name)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = identified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return resample(docs.withColumnRenamed(name, ROW_ID), table(spark, sf_dir, "benchmark")).drop(ROW_ID)


def _sql() -> str:
    made, crc = crc32_sql("feature")
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
    features = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH {made},
d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT doc_id, unnest({features}) AS feature FROM d), bf AS (SELECT unnest({features}) AS feature FROM b),
code AS MATERIALIZED (SELECT feature, {crc} % {BUCKETS} AS bucket FROM (SELECT feature FROM df UNION SELECT feature FROM bf), crc_table),
dc AS (SELECT doc_id, bucket, count(*) AS n FROM df JOIN code USING (feature) GROUP BY ALL),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dc GROUP BY 1), t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM bf JOIN code USING (feature) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {BUCKETS}) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM dc JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || d.doc_id), 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY words >= {LEAST_WORDS} DESC, score DESC, doc_id) AS place, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS able FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank FROM r
"""


SQL = _sql()
