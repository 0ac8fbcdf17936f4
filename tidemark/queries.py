"""Registry of the engine's own queries and of the SQL that gives the same rows.

The tables have no activity of customers, so the queries read them so: an entity is a supplier (dense months) or a part
or customer (sparse ones), its activity of a month is what it shipped, and raw identity columns are made from keys, with
every case of the cleaning rules. Such expressions are SQL that Spark and the oracle read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cleaning, months
from tidemark.operators import duplicates, evaluation, features, labels, models, panel, potential, ranking, risk, stores, windows
from tidemark.sources import files, xlsx
from tidemark.sources.shared import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOLDOUT = windows.WindowSpec(holdout_year=2000)
RULE = {"type": "future_total_rule", "source_column": "future_minus_recent", "operator": "<=", "threshold": -202}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 12) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# --- the entities ----------------------------------------------------------------------------------------------------

_SOURCE = {"supplier": ("lineitem", "l_suppkey", "l_shipdate", "l_quantity"), "part": ("lineitem", "l_partkey", "l_shipdate", "l_quantity"), "customer": ("orders", "o_custkey", "o_orderdate", "o_totalprice")}


def activity(spark: SparkSession, sf_dir: str, of: str = "supplier") -> DataFrame:
    """entity, ord, scan_points: a row for each month with activity."""
    t, key, date, value = _SOURCE[of]
    own = table(spark, sf_dir, t)
    rows = own.select(F.col(key).alias("entity"), months.ordinal(F.col(date)).alias("ord"), F.col(value).alias("scan_points"))
    return windows.monthly(windows.dealt(rows, own.count(), "entity", "ord"), "entity", "ord", "scan_points")


def _activity_sql(of: str = "supplier") -> str:
    t, key, date, value = _SOURCE[of]
    return f"panel AS (SELECT {key} AS entity, CAST(year({date}) * 12 + month({date}) AS BIGINT) AS ord, sum({value}) AS scan_points FROM {t} GROUP BY ALL)"


_LABEL = "printf('%04d-%02d', CAST(({0} - 1) // 12 AS INT), CAST(({0} - 1) % 12 + 1 AS INT))"


def _label(x: str) -> str:
    return _LABEL.format(f"({x})")


def _windows_sql(of: str = "supplier") -> str:
    s = [f"s{k}" for k in range(1, 10)]
    leads = ", ".join(f"{'scan_points' if k == 0 else f'lead(scan_points, {k}) OVER w'} AS s{k + 1}" for k in range(9))
    year = lambda k: f"(start + {k} - 1) // 12"
    return f"""{_activity_sql(of)},
steps AS (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY entity ORDER BY ord) = 1 THEN 1 ELSE 0 END AS step FROM panel),
runs AS (SELECT entity, ord AS start, sum(step) OVER (PARTITION BY entity ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS steps, {leads}
         FROM steps WINDOW w AS (PARTITION BY entity ORDER BY ord)),
sums AS (SELECT *, {" + ".join(s[:6])} AS total6, {" + ".join(s[:3])} AS prior3, {" + ".join(s[3:6])} AS recent3, {" + ".join(s[6:])} AS future3,
                {year(0)} AS y1, {year(5)} AS y2, {year(6)} AS y3, {year(8)} AS y4 FROM runs WHERE steps = 8),
win AS (SELECT *, future3 - recent3 AS delta, future3 / nullif(recent3, 0) AS ratio, CASE WHEN recent3 = 0 THEN 'recently_inactive' ELSE 'recently_scanning' END AS recent_status,
               CASE WHEN y4 <= 1999 THEN 'development' WHEN y3 = 2000 AND y4 = 2000 THEN 'holdout_2025' ELSE 'excluded_split_gap' END AS split FROM sums)"""


def samples(spark: SparkSession, sf_dir: str, of: str = "supplier") -> DataFrame:
    return windows.build(activity(spark, sf_dir, of), "entity", spec=HOLDOUT)


def samples_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples, each with the state that its entity had last: its nation."""
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = s_nationkey"))
    rows = activity(spark, sf_dir).join(names.select(F.col("s_suppkey").alias("entity"), cleaning.state(F.col("n_name")).alias("state")), "entity", "left")
    return windows.build(rows, "entity", spec=HOLDOUT, carry=("state",))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label(samples(spark, sf_dir), RULE)


#: A stand-in for a trained model, so that ranks and measures have an oracle.
_SCORE = "round(1 / (1 + exp(({recent} - {prior}) / 100.0)), 4)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.select("entity", "start", "recent_status", "target", F.expr(_SCORE.format(recent="recent_3m_total", prior="prior_3m_total")).alias("score"),
                       F.expr("cast(entity as bigint) * 100000 + start").alias("row_order"))


def _scored_sql() -> str:
    return f"{_windows_sql()}, scored AS (SELECT entity, start, recent_status, CASE WHEN delta <= -202 THEN 1 ELSE 0 END AS target, {_SCORE.format(recent='recent3', prior='prior3')} AS score, entity * 100000 + start AS row_order FROM win)"


# --- reshaping and coverage ------------------------------------------------------------------------------------------


@query(f"WITH {_activity_sql()} SELECT entity, ord, {_label('ord')} AS month, s_name AS name, upper(trim(n_name)) AS state, scan_points FROM panel JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey")
def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = s_nationkey"))
    named = names.select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), cleaning.state(F.col("n_name")).alias("state"))
    return activity(spark, sf_dir).join(named, "entity").select("entity", F.col("ord").cast("long").alias("ord"), months.ordinal_label(F.col("ord")).alias("month"), "name", "state", "scan_points")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = activity(spark, sf_dir, "part").select("entity", months.ordinal_year(F.col("ord")).cast("long").alias("year"), F.get(F.array(*map(F.lit, months.MONTHS)), months.ordinal_month(F.col("ord")) - 1).alias("month_name"), "scan_points")
    return panel.pivot_months(windows.dealt(rows, table(spark, sf_dir, "lineitem").count(), "entity", "year"), ["entity", "year"])


_PIVOT = ", ".join(f"sum(scan_points) FILTER ((ord - 1) % 12 = {k}) AS {m}" for k, m in enumerate(months.MONTHS))


@query(f"WITH {_activity_sql('part')} SELECT entity, (ord - 1) // 12 AS year, {_PIVOT} FROM panel GROUP BY ALL")
def pivot_year_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


@query(f"WITH {_activity_sql('part')}, wide AS (SELECT entity, (ord - 1) // 12 AS year, {_PIVOT} FROM panel GROUP BY ALL) SELECT * FROM wide UNPIVOT INCLUDE NULLS (scan_points FOR month_name IN ({', '.join(months.MONTHS)}))")
def unpivot_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.unpivot_months(_wide(spark, sf_dir), ["entity", "year"])


@query(f"""WITH {_activity_sql('customer')}
SELECT entity, {_label('min(ord)')} AS first_month, {_label('max(ord)')} AS last_month, count(*) AS observed_month_count, max(ord) - min(ord) + 1 AS expected_month_count,
       max(ord) - min(ord) + 1 - count(*) AS missing_month_count, max(ord) - min(ord) + 1 - count(*) AS continuity_gap_count,
       array_to_string(list_sort(list(DISTINCT (ord - 1) // 12)), '|') AS years_covered, count(DISTINCT (ord - 1) // 12) AS year_count, count(DISTINCT (ord - 1) // 12) > 1 AS has_cross_year_coverage,
       round(sum(scan_points), 2) AS total_scan_points, count(*) FILTER (scan_points > 0) AS positive_scan_month_count FROM panel GROUP BY entity""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.coverage(activity(spark, sf_dir, "customer"), "entity"), 2)


@query(f"WITH {_activity_sql('customer')} SELECT (ord - 1) // 12 AS year, count(*) AS panel_rows, count(DISTINCT entity) AS unique_influencers, count(DISTINCT ord) AS months_present, {_label('min(ord)')} AS min_month, {_label('max(ord)')} AS max_month FROM panel GROUP BY 1")
def panel_year_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.year_summary(activity(spark, sf_dir, "customer"), "entity")


@query(f"""WITH {_activity_sql('customer')}, y AS (SELECT entity, (ord - 1) // 12 AS year, max(CASE WHEN (ord - 1) % 12 = 11 THEN 1 ELSE 0 END) AS dec, max(CASE WHEN (ord - 1) % 12 = 0 THEN 1 ELSE 0 END) AS jan FROM panel GROUP BY ALL)
SELECT printf('%d-%d', CAST(a.year AS INT), CAST(b.year AS INT)) AS year_pair, count(*) AS in_both_years, CAST(sum(a.dec * b.jan) AS BIGINT) AS continuous_dec_to_jan, CAST(sum(1 - a.dec * b.jan) AS BIGINT) AS breaks
FROM y a JOIN y b ON a.entity = b.entity AND b.year = a.year + 1 GROUP BY 1""")
def cross_year_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.cross_year_continuity(activity(spark, sf_dir, "customer"), "entity")


# --- cleaning and duplicates -----------------------------------------------------------------------------------------

_MOBILE = """CASE c_custkey % 9 WHEN 0 THEN concat('+91-', cast(9000000000 + c_custkey AS STRING)) WHEN 1 THEN concat(cast(9000000000 + c_custkey AS STRING), '.0')
 WHEN 2 THEN cast(c_custkey AS STRING) WHEN 3 THEN '' WHEN 4 THEN 'abc' WHEN 5 THEN ' N/A ' WHEN 6 THEN NULL WHEN 7 THEN concat(' ', cast(9000000000 + c_custkey - c_custkey % 50 AS STRING)) ELSE cast(9000000000 + c_custkey - c_custkey % 200 AS STRING) END"""
_NAME = "CASE c_custkey % 5 WHEN 0 THEN concat('  ', c_name, '  x ') WHEN 1 THEN '--' ELSE c_name END"
_STATE = "CASE c_custkey % 6 WHEN 0 THEN 'na' WHEN 1 THEN concat(' ', lower(n_name), ' ') ELSE n_name END"
_TEXT = "CASE c_custkey % 7 WHEN 0 THEN '5d' WHEN 1 THEN 'nan' WHEN 2 THEN '-' WHEN 3 THEN cast(c_custkey AS STRING) WHEN 4 THEN concat(' ', cast(c_custkey AS STRING), '.5 ') WHEN 5 THEN NULL ELSE '-3e2' END"
_YEAR, _ROW = "cast(2022 + c_custkey % 2 AS BIGINT)", "cast(c_custkey AS BIGINT)"
_MONTH = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast((c_custkey * {0}) % 97 AS DOUBLE) END"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a raw file: State, Name, MobileNo1, a text for a number, twelve months."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = c_nationkey"))
    made = {"State": _STATE, "Name": _NAME, "MobileNo1": _MOBILE, "amount": _TEXT, "source_year": _YEAR, "source_file": "concat('f', cast(c_custkey % 3 AS STRING))", "source_sheet": "'s'", "source_row_number": _ROW}
    return rows.select("c_custkey", *(F.expr(e).alias(k) for k, e in made.items()), *(F.expr(_MONTH.format(k)).alias(m) for k, m in enumerate(months.MONTHS, 1)))


_BLANK = "({0} IS NULL OR lower(trim({0})) IN ('', '-', '--', 'na', 'n/a', 'null', 'none'))"
_RAW = f"""raw AS (SELECT c_custkey, {_STATE} AS State, {_NAME} AS Name, {_MOBILE} AS MobileNo1, {_TEXT} AS amount, {_YEAR} AS source_year, concat('f', cast(c_custkey % 3 AS STRING)) AS source_file, 's' AS source_sheet, {_ROW} AS source_row_number,
 {", ".join(f"{_MONTH.format(k)} AS {m}" for k, m in enumerate(months.MONTHS, 1))} FROM customer JOIN nation ON n_nationkey = c_nationkey),
digits AS (SELECT *, {_BLANK.format("MobileNo1")} AS blank, regexp_replace(regexp_replace(trim(MobileNo1), '\\.0$', ''), '[^0-9]', '', 'g') AS d FROM raw),
cleaned AS (SELECT *, NOT blank AND d <> '' AS has_digits, CASE WHEN NOT blank AND d <> '' THEN CASE WHEN length(d) > 10 THEN right(d, 10) ELSE d END END AS mobile_id,
 coalesce(NOT blank AND length(d) >= 10, false) AS mobile_is_valid,
 CASE WHEN blank THEN 'blank' WHEN d = '' THEN 'no_digits' WHEN length(d) = 10 THEN 'valid' WHEN length(d) > 10 THEN 'trimmed_to_last_10' ELSE 'invalid_length_' || length(d) END AS issue,
 CASE WHEN NOT {_BLANK.format("State")} THEN upper(trim(regexp_replace(State, '\\s+', ' ', 'g'))) END AS state_c, CASE WHEN NOT {_BLANK.format("Name")} THEN trim(regexp_replace(Name, '\\s+', ' ', 'g')) END AS name_c FROM digits)"""


@query(f"WITH {_RAW} SELECT c_custkey, mobile_id AS id, CASE WHEN has_digits THEN d END AS digits, mobile_is_valid AS valid, issue FROM cleaned")
def clean_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("c_custkey", cleaning.mobile(F.col("MobileNo1")).alias("m")).select("c_custkey", "m.*")


@query(f"WITH {_RAW} SELECT c_custkey, state_c AS state, name_c AS name FROM cleaned")
def clean_state_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("c_custkey", cleaning.state(F.col("State")).alias("state"), cleaning.squeezed(F.col("Name")).alias("name"))


@query(f"WITH {_RAW} SELECT c_custkey, CASE WHEN regexp_full_match(trim(amount), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(amount) AS DOUBLE) END AS amount FROM raw")
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("c_custkey", cleaning.number(F.col("amount")).alias("amount"))


@query(f"""WITH {_RAW} SELECT source_file, count(*) AS row_count, count(*) FILTER ({_BLANK.format("State")}) AS blank_state, count(*) FILTER ({_BLANK.format("Name")}) AS blank_name, count(*) FILTER (blank) AS blank_mobileno1,
 CAST(count(*) FILTER (amount IN ('5d', 'nan')) AS BIGINT) AS not_numeric, count(*) FILTER (issue = 'valid') AS mobile_valid, count(*) FILTER (issue LIKE 'trimmed%') AS mobile_trimmed,
 count(*) FILTER (issue <> 'valid' AND issue NOT LIKE 'trimmed%') AS mobile_invalid FROM cleaned GROUP BY source_file""")
def blank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.quality(raw(spark, sf_dir), ["amount"], ["source_file"])


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    return cleaning.clean(rows.withColumns({m: F.col(m).cast("string") for m in months.MONTHS}), months.MONTHS)


def _mode(c: str) -> str:
    return f"(SELECT x.v FROM (SELECT {c} AS v, count(*) AS n FROM cleaned c2 WHERE c2.mobile_is_valid AND c2.source_year = c.source_year AND c2.mobile_id = c.mobile_id AND trim({c}) <> '' GROUP BY ALL) x ORDER BY n DESC, v LIMIT 1)"


_MONTHS_SUM = ", ".join(f"coalesce(sum({m}), 0.0) AS {m}" for m in ("Jan", "Jun", "Dec"))
_SUMS = ", ".join(f"g.{m}" for m in ("Jan", "Jun", "Dec"))


@query(f"""WITH {_RAW}, c AS (SELECT DISTINCT source_year, mobile_id FROM cleaned WHERE mobile_is_valid),
modes AS (SELECT source_year, mobile_id, {_mode("state_c")} AS "State", {_mode("name_c")} AS "Name" FROM c),
g AS (SELECT source_year, mobile_id, min(source_row_number) AS source_row_number, array_to_string(list_sort(list(DISTINCT source_file)), '|') AS source_file, count(*) AS source_duplicate_row_count, {_MONTHS_SUM} FROM cleaned WHERE mobile_is_valid GROUP BY 1, 2)
SELECT g.source_year, g.mobile_id, modes."State", modes."Name", g.source_row_number, g.source_file, 'aggregate_by_mobile_year' AS duplicate_resolution_rule, g.source_duplicate_row_count, {_SUMS} FROM g JOIN modes USING (source_year, mobile_id)
UNION ALL SELECT source_year, mobile_id, state_c, name_c, source_row_number, source_file, 'invalid_mobile_kept_each_source_row_flagged', 1, Jan, Jun, Dec FROM cleaned WHERE NOT mobile_is_valid""")
def dedupe_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.resolve(_cleaned(spark, sf_dir)).select("source_year", "mobile_id", "State", "Name", "source_row_number", "source_file", "duplicate_resolution_rule", "source_duplicate_row_count", "Jan", "Jun", "Dec")


@query(f"""WITH {_RAW} SELECT source_year, mobile_id, count(*) AS duplicate_row_count, array_to_string(list_sort(list(DISTINCT source_file)), '|') AS source_files, array_to_string(list_sort(list(DISTINCT source_sheet)), '|') AS source_sheets,
 array_to_string(list_sort(list(DISTINCT MobileNo1)), '|') AS raw_mobile_values FROM cleaned WHERE mobile_is_valid GROUP BY 1, 2 HAVING count(*) > 1""")
def dedupe_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.report(_cleaned(spark, sf_dir))


@query(f"""WITH {_RAW} SELECT mobile_id, count(*) AS row_count, count(DISTINCT concat(coalesce(CAST(Jan AS VARCHAR), 'null'), ',', coalesce(CAST(Feb AS VARCHAR), 'null'))) AS signatures,
 count(DISTINCT concat(coalesce(CAST(Jan AS VARCHAR), 'null'), ',', coalesce(CAST(Feb AS VARCHAR), 'null'))) > 1 AS has_conflict FROM cleaned WHERE mobile_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def scan_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.conflicts(_cleaned(spark, sf_dir), "mobile_id", ["Jan", "Feb"])


_SIX = months.MONTHS[:6]


@query(f"""WITH {_RAW}, p AS (SELECT mobile_id, concat_ws(',', {", ".join(f"coalesce(CAST({m} AS VARCHAR), 'null')" for m in _SIX)}) AS pattern, min(source_row_number) AS first, count(*) AS n FROM cleaned WHERE mobile_id IS NOT NULL GROUP BY ALL)
SELECT mobile_id, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS unique_scan_patterns, array_to_string(list_slice(list(pattern ORDER BY first, pattern), 1, 3), ' | ') AS sample_scan_patterns FROM p GROUP BY 1 HAVING count(*) > 1""")
def scan_conflict_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.conflict_samples(_cleaned(spark, sf_dir), "mobile_id", _SIX, "source_row_number")
    return found.withColumn("sample_scan_patterns", F.array_join("sample_scan_patterns", " | "))


@query(f"WITH {_RAW} SELECT source_year, count(*) AS cleaned_year_rows, count(DISTINCT CASE WHEN mobile_is_valid THEN mobile_id ELSE concat('INVALID::', source_row_number) END) AS unique_influencers FROM cleaned GROUP BY 1")
def source_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = cleaning.entity_id(F.col("mobile_id"), F.col("mobile_is_valid"), F.col("source_row_number"))
    return panel.source_year_counts(_cleaned(spark, sf_dir).withColumn("influencer_id", entity))


@query(f"WITH {_RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY mobile_id ORDER BY source_row_number) AS k FROM cleaned) SELECT mobile_id, source_row_number FROM n WHERE mobile_id IS NULL OR k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.first_occurrence(_cleaned(spark, sf_dir), "mobile_id", "source_row_number").select("mobile_id", "source_row_number")


@query(f"WITH {_RAW} SELECT source_row_number, CASE WHEN mobile_is_valid THEN mobile_id ELSE concat('INVALID::', source_year, '::', source_file, '::', source_sheet, '::', source_row_number) END AS influencer_id FROM cleaned")
def entity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineage = ("source_year", "source_file", "source_sheet", "source_row_number")
    return _cleaned(spark, sf_dir).select("source_row_number", cleaning.entity_id(F.col("mobile_id"), F.col("mobile_is_valid"), *map(F.col, lineage)).alias("influencer_id"))


_MONTH_TEXT = "CASE c_custkey % 6 WHEN 0 THEN cast(c_custkey % 15 AS STRING) WHEN 1 THEN 'september' WHEN 2 THEN '2024-03-15' WHEN 3 THEN ' JUL ' WHEN 4 THEN 'xyz' ELSE NULL END"


@query(f"""SELECT c_custkey, CASE WHEN regexp_full_match(t, '\\d+') THEN CASE WHEN CAST(t AS INT) BETWEEN 1 AND 12 THEN ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(t AS INT)] END
 WHEN t = 'september' THEN 'Sep' WHEN t = '2024-03-15' THEN 'Mar' WHEN t = 'JUL' THEN 'Jul' END AS month_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN CASE WHEN c_custkey % 15 BETWEEN 1 AND 12 THEN CAST(c_custkey % 15 AS VARCHAR) END ELSE trim({_MONTH_TEXT}) END AS t FROM customer)""")
def month_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", months.abbreviation(F.expr(_MONTH_TEXT)).alias("month_name"))


#: A date in many shapes, of which the tenth has the month first if it can be one.
_D, _M, _Y = "lpad(cast(day(o_orderdate) AS STRING), 2, '0')", "lpad(cast(month(o_orderdate) AS STRING), 2, '0')", "cast(year(o_orderdate) AS STRING)"
_d, _m = "cast(day(o_orderdate) AS STRING)", "cast(month(o_orderdate) AS STRING)"
_B = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(o_orderdate) * 3 - 2, 3)"
_LONG = "CASE month(o_orderdate) " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
_DATE_SHAPES = (
    (_D, "'-'", _B, "'-'", _Y), (_M, "'/'", _D, "'/'", _Y), (_Y, "'-'", _M, "'-'", _D, "'T00:00:00'"), (_D, "' '", _LONG, "' '", _Y), (_Y, "'-'", _m, "'-'", _d), (_Y, _M, _D), (_LONG, "' '", _d, "', '", _Y),
    (_Y, "'/'", _M, "'/'", _D), (_Y, "'.'", _M, "'.'", _D), (_D, "'/'", _M, "'/'", _Y), (_LONG, "' '", _Y), (_Y, "' '", _LONG), (_Y, "'-'", _M), (_M, "'-'", _Y), (_m, "'/'", _Y), (_Y, "'-'", _M, "'-'", _D, "' 10:20:30'"),
    (_Y, "'-'", _M, "'-'", _D, "'T10:20:30Z'"), (_D, _B, _Y), (_B, "'-'", _D, "'-'", _Y), (_Y, "'-'", _B, "'-'", _D), (_d, "'th '", _LONG, "' '", _Y), ("'Mon, '", _d, "' '", _B, "' '", _Y), (_Y, "'/'", _m), (_M, "'-'", _D, "'-'", f"substr({_Y}, 3, 2)"),
    (_B, _Y), ("'  '", _B, "' '"), ("upper(" + _LONG + ")",), (_m,), (_Y, "'-'", _M, "'-'", _D, "'T10:20:30+05:30'"), ("'31/04/'", _Y), ("'x'", _Y), ("'2024-13-'", _D), (_Y, "'q'", "cast(cast(floor((month(o_orderdate) + 2) / 3) AS INT) AS STRING)"),
)
_DATE_TEXT = f"CASE o_orderkey % {len(_DATE_SHAPES)} " + " ".join(f"WHEN {k} THEN concat({', '.join(parts)})" for k, parts in enumerate(_DATE_SHAPES)) + " END"


@query(f"""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN k IN (29, 30, 31) THEN NULL ELSE substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * CASE k WHEN 9 THEN CASE WHEN d <= 12 THEN d ELSE m END WHEN 32 THEN (m - 1) // 3 * 3 + 1 ELSE m END - 2 AS INT), 3) END AS month_name
FROM (SELECT o_orderkey, o_orderkey % {len(_DATE_SHAPES)} AS k, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)""")
def month_label_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), months.abbreviation(F.expr(_DATE_TEXT)).alias("month_name"))


# --- files: written in the shared folder and read back ----------------------------------------------------------------

_AWKWARD = """CASE c_custkey % 8 WHEN 0 THEN concat('A "', c_name, '", C') WHEN 1 THEN concat(c_name, chr(10), 'two', chr(10), chr(10), 'lines') WHEN 2 THEN concat('  ', c_name, ' ') WHEN 3 THEN '"' WHEN 4 THEN NULL
 WHEN 5 THEN concat(c_name, ',,"",') WHEN 6 THEN concat('राम é € ', c_name) ELSE concat(chr(10), '","', c_name) END"""


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_AWKWARD} AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "roundtrip-csv")
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_AWKWARD).alias("name"), F.col("c_nationkey").alias("nation")), path)
    return files.read_csv(spark, path)


@query(f"SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS BIGINT) AS row_order, CAST(c_custkey AS VARCHAR) AS c_custkey, {_AWKWARD} AS name, CASE WHEN c_nationkey % 3 <> 0 THEN CAST(CAST(c_nationkey AS DOUBLE) + 0.5 AS VARCHAR) END AS half FROM customer")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "roundtrip-xlsx") + ".xlsx"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_AWKWARD).alias("name"), F.expr("CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey AS DOUBLE) + 0.5D END").alias("half"))
    xlsx.write_xlsx(rows.orderBy("c_custkey"), path)
    (sheet,) = xlsx.read_xlsx(spark, path).values()
    return sheet


# --- windows and labels ----------------------------------------------------------------------------------------------

_COUNT = " + ".join
_WINDOW_SQL = f"""SELECT entity, {_label("start")} AS feature_window_start_month, {_label("start + 5")} AS feature_window_end_month, {_label("start + 6")} AS target_window_start_month, {_label("start + 8")} AS target_window_end_month,
 {", ".join(f"s{k} AS feature_scan_m{k}" for k in range(1, 7))}, {", ".join(f"s{k + 6} AS future_scan_m{k}" for k in range(1, 4))}, total6 AS feature_6m_total, prior3 AS prior_3m_total, recent3 AS recent_3m_total, future3 AS future_3m_total,
 delta AS future_minus_recent, round(ratio, 12) AS future_over_recent_ratio, recent3 = 0 AS zero_scans_last_3m_flag, future3 = 0 AS zero_scans_next_3m_flag, recent_status, recent3 = 0 AS recently_inactive, recent3 <> 0 AS recently_scanning,
 CAST({_COUNT(f"CAST(s{k} > 0 AS INT)" for k in range(1, 7))} AS BIGINT) AS feature_positive_month_count, CAST({_COUNT(f"CAST(s{k} > 0 AS INT)" for k in range(4, 7))} AS BIGINT) AS recent_positive_month_count,
 CAST({_COUNT(f"CAST(s{k} > 0 AS INT)" for k in range(7, 10))} AS BIGINT) AS future_positive_month_count, future3 > 0 AS future_any_scan_flag, y1 AS feature_start_year, y2 AS feature_end_year, y3 AS target_start_year, y4 AS target_end_year,
 y1 <> y2 AS cross_year_feature_flag, y3 <> y4 AS cross_year_target_flag, y1 <> y4 AS cross_year_6_plus_3_flag, split FROM win"""


@query(f"WITH {_windows_sql()} {_WINDOW_SQL}")
def windows_6_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir).drop("start"))


@query(f"WITH {_windows_sql('part')} {_WINDOW_SQL}")
def windows_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir, "part").drop("start"))


@query(f"WITH {_windows_sql()} SELECT split, recent_status, count(*) AS windows, count(*) FILTER (recent3 = 0) AS zero_last, count(*) FILTER (future3 = 0) AS zero_next, count(*) FILTER (y1 <> y4) AS cross_year, sum(recent3) AS recent_total, sum(future3) AS future_total FROM win GROUP BY ALL")
def window_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stats(samples(spark, sf_dir))


@query(f"WITH {_windows_sql()} SELECT split, recent_status, count(*) AS row_count, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS total_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 12) AS label_share FROM win GROUP BY split, recent_status")
def recent_status_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.shares(samples(spark, sf_dir), ["split"], ["recent_status"]))


@query(f"WITH {_windows_sql()} SELECT entity, start, CASE WHEN delta <= -202 THEN 1 ELSE 0 END AS target FROM win")
def label_future_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("entity", F.col("start").cast("long").alias("start"), "target")


@query(f"WITH {_windows_sql()} SELECT entity, start, round(future3 / nullif(recent3, 0), 12) AS target_helper_decline_ratio, CASE WHEN coalesce(future3 / nullif(recent3, 0) < 0.5, false) THEN 1 ELSE 0 END AS target FROM win")
def label_decline_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"type": "decline_rule", "baseline_column": "recent_3m_total", "comparison_column": "future_3m_total", "operator": "<", "threshold": 0.5}
    return rounded(labels.label(samples(spark, sf_dir), rule).select("entity", F.col("start").cast("long").alias("start"), "target_helper_decline_ratio", "target"))


@query(f"WITH {_windows_sql()} SELECT split, recent_status, target, count(*) AS row_count, CAST(sum(count(*)) OVER (PARTITION BY split, recent_status) AS BIGINT) AS total_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY split, recent_status), 12) AS label_share FROM (SELECT *, CASE WHEN delta <= -202 THEN 1 ELSE 0 END AS target FROM win) GROUP BY split, recent_status, target")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.shares(labelled(spark, sf_dir), ["split", "recent_status"], ["target"]))


@query(f"WITH {_windows_sql()} SELECT {_label('start')} AS feature_window_start_month, {_label('start + 5')} AS feature_window_end_month, {_label('start + 6')} AS target_window_start_month, {_label('start + 8')} AS target_window_end_month, recent_status, total6 AS feature_6m_total, future3 AS future_3m_total, future3 - total6 AS future_minus_feature_total, round(future3 / nullif(total6, 0), 12) AS future_to_feature_total_ratio FROM win")
def target_option_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.option_report(samples(spark, sf_dir)))


@query(f"WITH {_windows_sql()} {_WINDOW_SQL}")
def windows_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months but the last two at once, then these one by one, and the last once more."""
    rows = activity(spark, sf_dir)
    last = rows.agg(F.max("ord")).first()[0] or 0
    store = stores.WindowStore(spark, new_path(spark, "windows"), "entity", HOLDOUT)
    for part in (rows.filter(F.col("ord") < last - 1), rows.filter(F.col("ord") == last - 1), *[rows.filter(F.col("ord") == last)] * 2):
        store.append(part)
    return rounded(store.windows().drop("start"))


@query(f"WITH {_windows_sql()} {_WINDOW_SQL}")
def windows_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.build(entity_layout(spark, sf_dir).read(), "entity", spec=HOLDOUT).drop("start"))


def entity_layout(spark: SparkSession, sf_dir: str) -> stores.EntityLayout:
    layout = stores.EntityLayout(spark, new_path(spark, "layout"), "entity", "ord INT, scan_points DOUBLE")
    layout.write(activity(spark, sf_dir).withColumn("source_year", months.ordinal_year(F.col("ord"))))
    return layout


# --- features --------------------------------------------------------------------------------------------------------


#: Of exact sums, so halves at the sixth digit occur.
_RATIOS = ("pct_change_last_3_vs_prev_3", "ratio_last3_first3", "ratio_last2_last4", "month6_vs_month1_ratio", "share_recent3_of_total6")


def _features_sql() -> str:
    m = [f"m{k}" for k in range(1, 7)]
    d = [f"({b} - {a})" for a, b in zip(m, m[1:], strict=False)]
    total, first3, last3, last2, last4 = (" + ".join(x) for x in (m, m[:3], m[3:], m[4:], m[2:]))
    n = lambda xs: "CAST(" + " + ".join(f"CAST({x} AS INT)" for x in xs) + " AS BIGINT)"
    std = lambda xs: "sqrt((" + " + ".join(f"pow({x} - ({' + '.join(xs)}) / {len(xs)}, 2)" for x in xs) + f") / {len(xs)})"
    r = lambda a, b: f"({a}) / nullif({b}, 0)"
    run = "0"
    for x in m:
        run = f"CASE WHEN {x} = 0 THEN {run} + 1 ELSE 0 END"
    sel = {
        **{f"month_{k}": f"m{k}" for k in range(1, 7)}, "sum_6m": total, "avg_6m": f"({total}) / 6", "median_6m": f"list_median([{', '.join(m)}])", "min_6m": f"least({', '.join(m)})", "max_6m": f"greatest({', '.join(m)})", "std_6m": std(m),
        **{f"active_months_last_{k}": n([f"({x} > 0)" for x in m[-k:]]) for k in range(2, 7)}, "pct_change_last_3_vs_prev_3": r(f"{last3} - ({first3})", first3), "first_3m_sum": first3, "last_3m_sum": last3, "last_2m_sum": last2, "last_1m": "m6",
        "ratio_last3_first3": r(last3, first3), "ratio_last2_last4": r(last2, last4), "delta_last3_first3": f"{last3} - ({first3})", "delta_last2_last3": f"{last2} - ({last3})", "trend_last_3_vs_prev_3": f"({last3}) / 3 - ({first3}) / 3", "month6_vs_month1_ratio": r("m6", "m1"),
        "linear_trend_slope_6m": "(" + " + ".join(f"({k} - 3.5) * (m{k} - ({total}) / 6)" for k in range(1, 7)) + ") / 17.5", "avg_month_on_month_change": "(m6 - m1) / 5", "positive_change_count": n([f"({x} > 0)" for x in d]), "negative_change_count": n([f"({x} < 0)" for x in d]),
        "zero_month_count": n([f"({x} = 0)" for x in m]), "recent_consecutive_zero_count": f"CAST({run} AS BIGINT)", "active_month_count": n([f"({x} > 0)" for x in m]), "coefficient_of_variation": r(std(m), f"({total}) / 6"), "share_recent3_of_total6": r(last3, total), "volatility_std_mom_change": std(d),
        "volatility_range_6m": f"greatest({', '.join(m)}) - least({', '.join(m)})", "volatility_mean_abs_mom_change": "(" + " + ".join(f"abs({x})" for x in d) + ") / 5", "volatility_max_abs_mom_change": f"greatest({', '.join(f'abs({x})' for x in d)})",
    }
    whole = ("active", "positive", "negative", "zero", "recent_con")
    cols = ", ".join(f"{e} AS {k}" if k.startswith(whole) else f"round({e}, {12 if k in _RATIOS else 6}) + 0.0 AS {k}" for k, e in sel.items())
    # every third month is emptied, so that zeros occur
    emptied = ", ".join(f"CASE WHEN (start + {k}) % 3 = entity % 4 THEN 0.0 ELSE s{k} END AS m{k}" for k in range(1, 7))
    return f"WITH {_windows_sql()}, six AS (SELECT entity, start, {emptied} FROM win) SELECT entity, start, {cols}, 'UNKNOWN' AS state FROM six"


@query(_features_sql())
def features_42(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    six = rows.select("entity", F.col("start").cast("long").alias("start"), *(F.when((F.col("start") + k) % 3 == F.col("entity") % 4, 0.0).otherwise(F.col(f"feature_scan_m{k}")).alias(f"scan_m{k}") for k in range(1, 7)))
    made = features.add_features(six, ("entity", "start"))
    return made.select(*((F.round(c, 12 if c in _RATIOS else 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes))


# --- potential, risk, dashboard --------------------------------------------------------------------------------------


def _lookup_sql(factor: float = 1.0) -> str:
    return f"""{_activity_sql()}, base AS (SELECT entity, ord, scan_points * {factor} AS v FROM panel),
r AS (SELECT entity, ord, sum(v) OVER w AS s, count(*) OVER w AS n FROM base WINDOW w AS (PARTITION BY entity ORDER BY ord RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, max(s) OVER (PARTITION BY entity) AS mx FROM r WHERE n = 6),
b AS (SELECT entity, max(mx) AS best, min(ord) AS e FROM m WHERE abs(s - mx) <= 1e-8 + 1e-5 * abs(mx) GROUP BY entity),
lookup AS (SELECT entity AS mobile_id, best AS max_continuous_6m_sum, {_label("e - 5")} AS best_window_start_month, {_label("e")} AS best_window_end_month, 2 * best AS "Potential",
 CASE WHEN 2 * best < 12000 THEN '<12k' WHEN 2 * best < 15000 THEN '12-15k' WHEN 2 * best <= 25000 THEN '15-25k' WHEN 2 * best > 25000 THEN '>25k' END AS "Potential Band" FROM b)"""


def _lookup(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    rows = activity(spark, sf_dir).select(F.col("entity").alias("mobile_id"), "ord", (F.col("scan_points") * factor).alias("scan_points"))
    return potential.lookup(rows)


@query(f"WITH {_lookup_sql()} SELECT * FROM lookup")
def potential_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir)


@query(f'WITH {_lookup_sql(5.0)} SELECT "Potential Band" AS band, count(*) AS n FROM lookup GROUP BY 1')
def potential_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, 5.0).groupBy(F.col("Potential Band").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {_lookup_sql(5.0)} SELECT "Potential Band", count(*) AS entities, min("Potential") AS min_potential, median("Potential") AS median_potential, max("Potential") AS max_potential FROM lookup GROUP BY 1')
def lookup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return potential.lookup_stats(_lookup(spark, sf_dir, 5.0))


@query(f'WITH {_lookup_sql()} SELECT * FROM lookup ORDER BY "Potential" DESC, mobile_id LIMIT 20')
def lookup_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return potential.top(_lookup(spark, sf_dir))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven final columns: customers, of whom the lookup knows those that are active entities too."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = c_nationkey"))
    rows = people.select(F.col("c_custkey").alias("mobile_id"), F.col("n_name").alias("State"), F.col("c_name").alias("Customer name"), F.expr("cast(9000000000 + c_custkey as string)").alias("Customer mobile number"), F.expr("(c_custkey * 37 % 100) / 100.0D").alias("Churn probability"))
    rows = rows.withColumn("Risk", risk.risk(F.col("Churn probability")))
    return potential.enrich(rows, _lookup(spark, sf_dir, 7.0)).select("mobile_id", *risk.FINAL_COLUMNS)


_FINAL = f"""{_lookup_sql(7.0)}, final AS (SELECT c_custkey AS mobile_id, n_name AS "State", c_name AS "Customer name", CAST(9000000000 + c_custkey AS VARCHAR) AS "Customer mobile number", (c_custkey * 37 % 100) / 100.0 AS p,
 "Potential", "Potential Band" FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lookup l ON l.mobile_id = c_custkey),
rows0 AS (SELECT *, CASE WHEN p >= 0.85 THEN 'HIGH RISK' WHEN p >= 0.5 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS "Risk", coalesce("Potential Band", 'BLANK') AS band FROM final),
rows1 AS (SELECT *, CASE band WHEN '>25k' THEN 'HIGH' WHEN '15-25k' THEN 'MEDIUM' WHEN '12-15k' THEN 'LOW' WHEN '<12k' THEN 'LOW' ELSE 'OTHER' END AS level FROM rows0),
rows2 AS (SELECT *, CASE WHEN "Risk" || '|' || level IN ('HIGH RISK|HIGH', 'HIGH RISK|MEDIUM', 'MEDIUM RISK|HIGH') THEN 'RED' WHEN "Risk" || '|' || level IN ('MEDIUM RISK|MEDIUM', 'MEDIUM RISK|LOW', 'HIGH RISK|LOW') THEN 'ORANGE'
 WHEN "Risk" || '|' || level IN ('LOW RISK|HIGH', 'LOW RISK|MEDIUM') THEN 'GREEN' ELSE 'OTHER' END AS bucket FROM rows1)"""


@query(f'WITH {_FINAL} SELECT mobile_id, "State", "Customer name", "Customer mobile number", CAST(p AS DOUBLE) AS "Churn probability", "Risk", "Potential", "Potential Band" FROM rows0')
def enrich_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir)


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN p >= 0.85 THEN 'HIGH RISK' WHEN p >= 0.5 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 101) / 100.0 END AS p FROM customer)")
def risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 101) / F.lit(100.0))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), risk.risk(p).alias("risk"))


def _counted(c: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: risk.counts(risk.dashboard_rows(_final(spark, sf_dir)), c)


for _name, _column, _sql_column in (("priority_bucket_counts", "Priority Bucket", "bucket"), ("counts_by_state", "State", '"State"'), ("counts_by_level", "Potential Level", "level"), ("counts_by_risk", "Risk", '"Risk"')):
    QUERIES[_name] = _counted(_column)
    SQL[_name] = f"WITH {_FINAL} SELECT {_sql_column} AS value, count(*) AS n FROM rows2 GROUP BY 1"


@query(f'WITH {_FINAL} SELECT mobile_id, "State" AS state, bucket FROM rows2 WHERE "Risk" = \'HIGH RISK\' AND level = \'MEDIUM\'')
def dashboard_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.filtered(risk.dashboard_rows(_final(spark, sf_dir)), "ALL", " high risk ", "medium")
    return rows.select("mobile_id", F.col("State").alias("state"), F.col("Priority Bucket").alias("bucket"))


@query(f"WITH {_FINAL} SELECT 'combination' AS kind, \"Risk\" || '|' || level AS value, count(*) AS n FROM rows2 WHERE level = 'OTHER' GROUP BY 2")
def unmapped_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.warnings(risk.dashboard_rows(_final(spark, sf_dir)))


@query(f"""WITH {_FINAL}, c AS (SELECT coalesce("State", 'ALL') AS "State", bucket, count(*) AS n FROM rows2 GROUP BY GROUPING SETS (("State", bucket), (bucket)))
SELECT "State", bucket, n, CAST(sum(n) OVER (PARTITION BY "State") AS BIGINT) AS total, round(100 * n / sum(n) OVER (PARTITION BY "State"), 6) AS percent FROM c""")
def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.bucket_rollup(risk.dashboard_rows(_final(spark, sf_dir))), 6)


# --- reports of the builds --------------------------------------------------------------------------------------------

_CARRIED = "CASE ord % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat('S', cast(ord % 5 AS STRING)) END"


@query(f"WITH {_windows_sql()}, named AS (SELECT entity, arg_max(state, ord) FILTER (trim(state) <> '') AS state FROM (SELECT entity, ord, {_CARRIED} AS state FROM panel) GROUP BY entity) SELECT entity, {_label('start')} AS feature_window_start_month, state FROM win JOIN named USING (entity)")
def windows_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = activity(spark, sf_dir).withColumn("state", F.expr(_CARRIED))
    return windows.build(rows, "entity", spec=HOLDOUT, carry=("state",)).select("entity", "feature_window_start_month", "state")


_STARTS = ("1995-01", "1996-05", "1998-10")


@query(f"WITH {_windows_sql()} SELECT {_label('start')} || '_to_' || {_label('start + 5')} || '_target_' || {_label('start + 6')} || '_to_' || {_label('start + 8')} AS example, count(*) AS windows FROM win WHERE {_label('start')} IN {_STARTS} GROUP BY 1")
def window_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.example_counts(samples(spark, sf_dir), _STARTS)


@query(f"""WITH {_windows_sql()}, n AS (SELECT count(*) AS influencers_seen, CAST(sum(greatest(n - 8, 0)) AS BIGINT) AS total_candidate_windows FROM (SELECT entity, count(*) AS n FROM panel GROUP BY 1)),
m AS (SELECT count(DISTINCT entity) AS influencers_with_windows, count(*) AS generated_windows, count(*) FILTER (split = 'development') AS development_windows, count(*) FILTER (split = 'holdout_2025') AS holdout_windows,
 count(*) FILTER (split = 'excluded_split_gap') AS excluded_split_windows FROM win) SELECT *, total_candidate_windows - generated_windows AS skipped_nonconsecutive_windows FROM n, m""")
def window_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.build_stats(activity(spark, sf_dir), samples(spark, sf_dir), "entity", HOLDOUT)


@query(f"WITH {_windows_sql()} SELECT entity AS mobile_id, CAST(NULL AS VARCHAR) AS State, CAST(NULL AS VARCHAR) AS Name, entity AS MobileNo1, " + ", ".join(f"{_label(f'start + {k}')} || '-01' AS {n}" for n, k in (("feature_start", 0), ("feature_end", 5), ("target_start", 6), ("target_end", 8)))
       + ", " + ", ".join(f"s{k} AS scan_m{k}" for k in range(1, 7)) + ", " + ", ".join(f"s{k + 6} AS future_scan_m{k}" for k in range(1, 4)) + " FROM win")
def windows_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.legacy(samples(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("state", "customer_name")}), "entity")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("feature_start", "feature_end", "target_start", "target_end")})


@query(f"WITH {_windows_sql()} SELECT entity, {_label('start')} AS feature_window_start_month, {_label('start + 5')} AS feature_window_end_month, recent_status, total6 AS scan_sum_6m, greatest(s1, s2, s3, s4, s5, s6) AS scan_max_6m, recent3 AS scan_sum_recent_3m FROM win")
def potential_option_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return potential.option_report(samples(spark, sf_dir), "entity")


_LINEAGE = {"mobile_id": "cast(9000000000 + o_custkey AS STRING)", "mobile_is_valid": "o_custkey % 7 <> 0"}


@query(f"""WITH panel AS (SELECT o_custkey AS entity, {", ".join(f"{e} AS {n}" for n, e in _LINEAGE.items())}, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS ord, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT entity, mobile_id, mobile_is_valid, count(*) AS observed_month_count, max(n) AS source_duplicate_row_count_max, round(sum(v), 2) AS total_scan_points FROM panel GROUP BY ALL""")
def coverage_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(F.col("o_custkey").alias("entity"), *(F.expr(e).alias(n) for n, e in _LINEAGE.items()), months.ordinal(F.col("o_orderdate")).alias("ord")).agg(F.sum("o_totalprice").alias("scan_points"), F.count(F.lit(1)).alias("source_duplicate_row_count"))
    return rounded(panel.coverage(rows, "entity"), 2).select("entity", "mobile_id", "mobile_is_valid", "observed_month_count", "source_duplicate_row_count_max", "total_scan_points")


@query(f"""WITH {_activity_sql('customer')}, e AS (SELECT count(*) AS n, max(ord) - min(ord) + 1 - count(*) AS gap, max((ord - 1) // 12) > min((ord - 1) // 12) AS across FROM panel GROUP BY entity)
SELECT count(*) AS influencer_count, CAST(sum(n) AS BIGINT) AS panel_rows, count(*) FILTER (gap > 0) AS influencers_with_missing_months, CAST(sum(gap) AS BIGINT) AS total_missing_months, max(gap) AS max_missing_months,
 max(gap) AS max_continuity_gaps, count(*) FILTER (across) AS influencers_across_years FROM e""")
def panel_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.build_stats(panel.coverage(activity(spark, sf_dir, "customer"), "entity"))


# --- ranks and measures ----------------------------------------------------------------------------------------------


def _ranked(rule: dict[str, object]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ranking.prioritise(scored(spark, sf_dir), rule, "score").select("row_order", "score", "recent_status", "rank_within_recent_status", "operational_rank", "prioritization_strategy")


_WITHIN = "row_number() OVER (PARTITION BY recent_status ORDER BY score DESC, row_order)"
for _name, _rule, _order in (
    ("rank_within_status", {"type": "within_recent_status"}, None), ("rank_scanning_first", {"type": "recently_scanning_first"}, "recently_scanning"),
    ("rank_custom_order", {"type": "custom_segment_order", "segment_order": ["recently_inactive", "recently_scanning"]}, "recently_inactive"), ("rank_score_only", {"type": "score_only"}, None),
):
    QUERIES[_name] = _ranked(_rule)
    _rank = f"row_number() OVER (ORDER BY CASE WHEN recent_status = '{_order}' THEN 0 ELSE 1 END, score DESC, row_order)" if _order else "CAST(NULL AS BIGINT)"
    SQL[_name] = f"WITH {_scored_sql()} SELECT row_order, score, recent_status, {_WITHIN} AS rank_within_recent_status, {_rank} AS operational_rank, '{_rule['type']}' AS prioritization_strategy FROM scored"

_SEGMENTS = "seg AS (SELECT 'overall' AS segment, * FROM scored UNION ALL SELECT recent_status, * FROM scored)"
_CURVE = "c AS (SELECT segment, score AS threshold, sum(target) AS p, count(*) AS n FROM seg GROUP BY ALL), k AS (SELECT *, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER (PARTITION BY segment) AS pos, sum(n - p) OVER (PARTITION BY segment) AS neg FROM c WINDOW w AS (PARTITION BY segment ORDER BY threshold DESC))"


@query(f"WITH {_scored_sql()}, {_SEGMENTS}, {_CURVE} SELECT segment, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(p) AS BIGINT) AS positive_count, round(sum(p) / sum(n), 6) AS positive_rate, round(sum(p * tp / (tp + fp)) / nullif(max(pos), 0), 6) AS pr_auc, round(sum((n - p) * (tp - p / 2)) / nullif(max(pos) * max(neg), 0), 6) AS roc_auc FROM k GROUP BY segment")
def metrics_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.metrics(scored(spark, sf_dir), "score", segment="recent_status"), 6)


@query(f"WITH {_scored_sql()}, seg AS (SELECT 'overall' AS segment, * FROM scored), {_CURVE} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM k")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.precision_recall(scored(spark, sf_dir), "score"), 6)


@query(f"WITH {_scored_sql()}, a AS (SELECT target, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored) SELECT round((sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)), 6) AS roc_auc FROM a")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.metrics(scored(spark, sf_dir), "score").select("roc_auc"), 6)


@query(f"""WITH {_scored_sql()}, {_SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_order) AS r, count(*) OVER (PARTITION BY segment) AS total, sum(target) OVER (PARTITION BY segment) AS pos FROM seg)
SELECT segment, k, round(sum(target) / k, 6) AS precision_at_k, round(sum(target) / nullif(max(pos), 0), 6) AS recall_at_k, round((sum(target) / k) / nullif(max(pos) / max(total), 0), 6) AS lift_at_k FROM n JOIN (VALUES (CAST(100 AS BIGINT)), (500), (1000)) v(k) ON r <= k AND k <= total GROUP BY segment, k""")
def topk_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.top_k(scored(spark, sf_dir), "score", "row_order", segment="recent_status"), 6)


@query(f"""WITH {_scored_sql()}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_order) AS r, count(*) OVER () AS total FROM scored), b AS (SELECT greatest(1, CAST(ceil((r - 1) * 10 / (total - 1)) AS BIGINT)) AS bucket, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives FROM n GROUP BY 1)
SELECT bucket, rows, positives, CAST(sum(rows) OVER w AS BIGINT) AS cumulative_rows, CAST(sum(positives) OVER w AS BIGINT) AS cumulative_positives, round(sum(positives) OVER w / sum(positives) OVER (), 6) AS gain, round(positives / rows / (sum(positives) OVER () / sum(rows) OVER ()), 6) AS lift FROM b WINDOW w AS (ORDER BY bucket)""")
def lift_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.lift_table(scored(spark, sf_dir), "score", "row_order"), 6)


@query(f"WITH {_scored_sql()} SELECT target, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight, round(greatest(1.0, sum(count(*)) FILTER (target = 0) OVER () / nullif(sum(count(*)) FILTER (target = 1) OVER (), 0)), 6) AS ratio FROM scored GROUP BY target")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.class_weights(scored(spark, sf_dir)), 6)



# --- models and workbooks: no SQL can say what they give --------------------------------------------------------------


def _trained(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = labels.label(samples_with_state(spark, sf_dir), RULE)
        rows = written(found.select("entity", "start", "split", "state", "target", *(f"feature_scan_m{k}" for k in range(1, 7))), "samples")
        model = models.train(rows.filter("split = 'development'"), name)
        return models.predict(model, rows.filter("split = 'holdout_2025'")).select("entity", "start", "target", "risk_score")

    return run


for _name, _family in (("train_score_gbt", "boosted"), ("train_score_hgb", "histogram_boosted"), ("train_score_rf", "random_forest"), ("train_score_logreg", "logistic_regression")):
    QUERIES[_name] = _trained(_family)
