"""Conversation structure repair by cost layers, as approximate matching by bitsets has them.

A conversation is its rows by turn (nulls first; of one turn by role, then by the SHA-256 of the text). Each row's first
fault counts: blank (nothing but [\\x20\\x09-\\x0D]), duplicate (its role and text were seen earlier), truncated (the last
character that isn't such a space isn't one of ".!?"). Repairs: keep (K, 0), rerole to user or assistant (R, 2), delete
(D, 3; blank and duplicate rows must be), insert a user or assistant turn without text (I, 2); a truncated row that isn't
deleted adds 1. The cheapest repair is sought after which the roles' initials are (s?(ua)+)?; of equally cheap ones the
one whose letters sort first.

For each turn, layer c is the set of grammar states, as bits, from which what follows can be repaired at a cost of at
most c. The layers of a turn are one integer, four bits a layer, so that an edit of cost k is a shift by 4k, and all
layers follow from those of the next turn in a few operations. States never differ by more than a few units of cost, so
16 layers above a turn's least cost hold all there is to know. The first layer with the start state is the cost; going
forward, the first letter whose state is in the layer of what is left of the cost is the next one of the audit.

Rows are sorted once by ranges of (conversation, turn). A conversation that lies inside a range is repaired where it is.
The first and the last of each range may go on in others: their rows are written, and each part gives the cost matrix
from state to state; the matrices of a conversation are folded, and each part finds its own letters for every state it
may be entered in. So no task holds a conversation that is larger than a range, and hot ones are split.

Null roles and texts are one space each. Repeated rows are duplicates. A conversation may have a null id. With no rows
the result is empty. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import crc32_sql, cut, look_up, table

SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: Letters of an audit in the order in which they are tried.
DELETE, INSERT, KEEP, REROLE = "DIKR"
#: Grammar states: nothing yet, after system, after user, after assistant. FULL has all four in each of 16 layers.
START, SYSTEM, USER, ASSISTANT = range(4)
LAYERS = 16
FULL = (1 << 4 * LAYERS) - 1
_ONES = FULL // 15
#: A row's code: its role's state (0 for other roles), then bits for what is truncated and what must go.
TRUNCATED, BAD = 4, 8
_ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}


def _next(state: int) -> int:
    """The state after a user or assistant turn that a repair may choose."""
    return ASSISTANT if state == USER else USER


def _before(w: int) -> int:
    """States, in all layers, from which a chosen user or assistant turn leads into w."""
    return ((w >> USER) & _ONES) * 0b1011 | ((w >> ASSISTANT) & _ONES) * 0b0100


def _kept(w: int, role: int) -> int:
    """States, in all layers, from which a turn of this role leads into w."""
    if role == SYSTEM:
        return (w >> SYSTEM) & _ONES
    if role == USER:
        return ((w >> USER) & _ONES) * 0b1011
    return ((w >> ASSISTANT) & _ONES) * 0b0100 if role == ASSISTANT else 0


def _inserted(w: int) -> int:
    """w and what reaches it by insertions; two of them lead to every state that any number leads to."""
    w |= (_before(w) << 8) & FULL
    return w | (_before(w) << 8) & FULL


#: After the last row: start and assistant are accepted; inserted turns lead there.
ACCEPTED = _inserted(_ONES * (1 << START | 1 << ASSISTANT))


def layers(codes: bytes, end: tuple[int, int] = (0, ACCEPTED)) -> list[tuple[int, int]]:
    """(least cost, layers above it) before each row, and after the last, where it is `end`."""
    out = [end]
    base, w = end
    for code in reversed(codes):
        more = code & TRUNCATED and 4
        own = w << 12 | _before(w) << 8 + more if not code & BAD else w << 12
        if not code & BAD:
            own |= _kept(w, code & 3) << more
        w = _inserted(own & FULL)
        while w and not w & 15:  # rise to the least cost; the last layer goes on
            w, base = w >> 4 | w & 15 << 4 * (LAYERS - 1), base + 1
        out.append((base, w))
    return out[::-1]


def reaches(layer: tuple[int, int], state: int, cost: int) -> bool:
    base, w = layer
    return cost >= base and bool(w >> 4 * min(cost - base, LAYERS - 1) + state & 1)


def least(layer: tuple[int, int], state: int) -> int | None:
    base, w = layer
    own = w >> state & _ONES
    return base + ((own & -own).bit_length() - 1) // 4 if own else None


def trace(codes: bytes, held: list[tuple[int, int]], state: int, last: bool = True) -> tuple[str, int]:
    """The least audit from a state, and the state after it. last: insertions after the last row belong to it."""
    cost, at, out = least(held[0], state), 0, []
    while at < len(codes) or last and cost:
        follows = held[at + 1] if at < len(codes) else None
        code = codes[at] if follows else BAD
        more = int(bool(code & TRUNCATED))
        if follows and reaches(follows, state, cost - 3):
            out.append(DELETE)
            at, cost = at + 1, cost - 3
        elif reaches(held[at], _next(state), cost - 2):
            out.append(INSERT)
            state, cost = _next(state), cost - 2
        elif not code & BAD and _kept(1 << (code & 3), code & 3) >> state & 1 and reaches(follows, code & 3, cost - more):
            out.append(KEEP)
            state, at, cost = code & 3, at + 1, cost - more
        else:
            out.append(REROLE)
            state, at, cost = _next(state), at + 1, cost - 2 - more
    return "".join(out), state


def steps(audit: str, codes: bytes, state: int) -> Iterator[tuple[int | None, str | None]]:
    """(row or None if inserted, new role or None if kept) of each turn that stays."""
    at = 0
    for letter in audit:
        if letter == KEEP:
            state = codes[at] & 3
            yield at, None
        elif letter != DELETE:
            state = _next(state)
            yield (None if letter == INSERT else at), _NAME[state]
        at += letter != INSERT


def code_of(role: str, text: str, seen: bool) -> tuple[int, str]:
    """A row's code and its first fault."""
    rest = text.rstrip(SPACE)
    fault = "blank" if not rest else "duplicate" if seen else "truncated" if rest[-1] not in ".!?" else ""
    return _ROLE.get(role[:1], 0) | {"": 0, "truncated": TRUNCATED}.get(fault, BAD), fault


FAULTS = ("blank", "duplicate", "truncated")
COUNTS = ("gaps", *FAULTS, "illegal", "cost")
TURNS = "array<struct<role:string,text:string>>"


def repaired(rows: list[tuple[int | None, str, str]]) -> dict[str, object]:
    """The report and the turns of one conversation, (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    codes, faults = bytearray(), dict.fromkeys(FAULTS, 0)
    for _, role, text in rows:
        code, fault = code_of(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(code)
        if fault:
            faults[fault] += 1
    held = layers(bytes(codes))
    audit, _ = trace(codes, held, START)
    turns = {t for t, *_ in rows if t is not None}
    roles = [role[:1] for _, role, _ in rows]
    out = [{"role": new or rows[at][1], "text": "" if at is None else rows[at][2]} for at, new in steps(audit, codes, START)]
    return faults | {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False)),
        "cost": least(held[0], START), "audit": audit, "repaired": out}


# --- whole conversations, where they are sorted -----------------------------------------------------------------------


def _name(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def sorted_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `at`, the place in the order of conversations and turns. Equal rows may be parted, so
    that no range must hold more than its share."""
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("sha").asc()]
    own = own.withColumns({"sha": F.sha2("text", 256), "salt": F.monotonically_increasing_id()})
    return own.repartitionByRange(*keys, F.col("salt").asc()).sortWithinPartitions(*keys).drop("sha", "salt").withColumn("at", F.monotonically_increasing_id())


def _whole(placed: DataFrame) -> DataFrame:
    """Reports of the conversations inside a range, in rows that have them; the rows of the others as they are."""
    schema = f"conv_id {_name(placed, 'conv_id')}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired {TURNS}, turn bigint, role string, text string, at bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        first, current, held = True, None, []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()

        def close(whole: bool) -> None:
            if whole:
                out.append({"conv_id": current[0]} | repaired([(r["turn"], r["role"], r["text"]) for r in held]))
            else:
                out.extend(held)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                if current != (key := (r["conv_id"],)):
                    if current is not None:
                        close(not first)
                        first = False
                    current = key
                held.append(r)
                if first and len(held) >= 1000:  # it may have begun in the range before, so nothing is kept of it
                    close(False)
                yield from flush(1000)
        close(False)
        yield from flush(1)

    return placed.select("conv_id", "turn", "role", "text", "at").mapInArrow(run, schema)


# --- conversations that several ranges share --------------------------------------------------------------------------

_SUMMARY = "k string, piece bigint, n bigint, codes binary, costs array<bigint>, " + ", ".join(f"{c} bigint" for c in FAULTS) + ", illegal bigint, initials array<string>, turns array<bigint>, bounds array<bigint>"


def _codes(rows: DataFrame) -> DataFrame:
    """k (the conversation), piece, at, turn, initial, code of each row: duplicates are found by their first place."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    blank = text == ""
    own = rows.select(
        "k", F.shiftright("at", 33).alias("piece"), "at", "turn", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), (~F.right(text, F.lit(1)).isin(*".!?")).alias("truncated"),
        F.when(~blank, F.sha2(F.to_json(F.struct("k", "role", "text")), 256)).alias("what"))
    firsts = cut(own.filter("what is not null").groupBy("what").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1"), "firsts")
    later = look_up(own.filter("what is not null").select("what", "at"), firsts, "what", "times").filter("at > first").select("at", F.lit(True).alias("duplicate"))
    flagged = own.join(later, "at", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    bad = F.col("blank") | F.col("duplicate")
    fault = F.when(F.col("blank"), "blank").when(F.col("duplicate"), "duplicate").when(F.col("truncated"), "truncated")
    role = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    return flagged.select("k", "piece", "at", "turn", "initial", fault.alias("fault"), (role + F.when(bad, BAD).when(F.col("truncated"), TRUNCATED).otherwise(0)).alias("code"))


def matrix(codes: bytes) -> list[list[int | None]]:
    """Cost from each state before the rows to each state after them; insertions before a row belong to it."""
    to = [layers(codes, (0, _ONES << x))[0] for x in range(4)]
    return [[least(to[x], s) for x in range(4)] for s in range(4)]


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    codes = rows["code"].astype("uint8").to_numpy().tobytes()
    turns = rows["turn"].dropna().astype("int64")
    initials = rows["initial"].tolist()
    faults = rows["fault"].value_counts()
    out = {
        "k": key[0], "piece": key[1], "n": len(rows), "codes": codes, "costs": [-1 if c is None else c for line in matrix(codes) for c in line],
        **{f: int(faults.get(f, 0)) for f in FAULTS}, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "initials": [initials[0], initials[-1]],
        "turns": [int(turns.min()), int(turns.max()), int(turns.nunique())] if len(turns) else [], "bounds": [int(rows["at"].iloc[0]), int(rows["at"].iloc[-1])]}
    return pd.DataFrame([out])


def _folded(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """What each part of a conversation must lead to: the cost from each state after it. The counts are of the whole."""
    parts = parts.sort_values("piece")
    after = [least((0, ACCEPTED), s) for s in range(4)]
    ends = []
    for flat in reversed(list(parts["costs"])):
        ends.append(after)
        lines = [list(flat[4 * s : 4 * s + 4]) for s in range(4)]
        after = [min(c + a for c, a in zip(line, after, strict=True) if c >= 0) for line in lines]
    turns = [list(t) for t in parts["turns"] if len(t)]
    shared = sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
    edges = list(parts["initials"])
    seams = sum(a[1] + b[0] not in LEGAL for a, b in zip(edges, edges[1:], strict=False))
    gaps = turns[-1][1] - turns[0][0] + 1 - (sum(t[2] for t in turns) - shared) if turns else 0
    return pd.DataFrame({
        "k": key[0], "piece": parts["piece"], "after": ends[::-1], "last": parts["piece"] == parts["piece"].max(), "cost": after[START], "gaps": gaps,
        "illegal": int(parts["illegal"].sum()) + seams, **{f: int(parts[f].sum()) for f in FAULTS}})


def _end(after: list[int]) -> tuple[int, int]:
    base = min(after)
    return base, sum((FULL << 4 * (c - base)) & (_ONES << s) for s, c in enumerate(after))


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        audits, exits = [], []
        for codes, after, last in zip(b["codes"], b["after"], b["last"], strict=True):
            held = layers(codes, _end([int(c) for c in after]))
            found = [trace(codes, held, s, last) for s in range(4)]
            audits.append([a for a, _ in found])
            exits.append([s for _, s in found])
        yield pd.DataFrame({"k": b["k"], "piece": b["piece"], "audits": audits, "exits": exits})


def _entered(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    parts, state, entries = parts.sort_values("piece"), START, []
    for exits in parts["exits"]:
        entries.append(state)
        state = int(exits[state])
    return pd.DataFrame({"k": key[0], "piece": parts["piece"], "state": entries})


def _placed_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k, piece, audit, codes, state, bounds in zip(b["k"], b["piece"], b["audit"], b["codes"], b["state"], b["bounds"], strict=True):
            out = [(k, piece, n, None if at is None else int(bounds[0]) + at, role) for n, (at, role) in enumerate(steps(audit, codes, int(state)))]
            yield pd.DataFrame(out, columns=["k", "piece", "n", "at", "new"]).astype({"at": "Int64"})


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (k, COUNTS, audit) and turns (k, piece, n, role, text) of conversations of which rows has all rows, by
    parts that each lie in a range."""
    parts = cut(_codes(rows).groupBy("k", "piece").applyInPandas(_summary, _SUMMARY), "parts")
    of = "k string, piece bigint, after array<bigint>, last boolean, " + ", ".join(f"{c} bigint" for c in ("cost", "gaps", "illegal", *FAULTS))
    folded = cut(parts.drop("codes", "bounds").groupBy("k").applyInPandas(_folded, of), "folded")
    traced = cut(parts.join(folded.select("k", "piece", "after", "last"), ["k", "piece"]).select("k", "piece", "codes", "after", "last").mapInPandas(_traced, "k string, piece bigint, audits array<string>, exits array<bigint>"), "traced")
    entered = traced.drop("audits").groupBy("k").applyInPandas(_entered, "k string, piece bigint, state bigint")
    chosen = cut(traced.join(entered, ["k", "piece"]).select("k", "piece", "state", F.get("audits", F.col("state").cast("int")).alias("audit")), "audits")
    audit = chosen.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x.audit), "").alias("audit"))
    reports = folded.filter("last").select("k", *COUNTS).join(audit, "k")
    left = chosen.join(parts.select("k", "piece", "codes", "bounds"), ["k", "piece"]).mapInPandas(_placed_steps, "k string, piece bigint, n bigint, at bigint, new string")
    texts = left.join(rows.select("at", "role", "text"), "at", "left")
    return reports, texts.select("k", "piece", "n", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _streamed_digests(turns: DataFrame) -> DataFrame:
    """k, sha of turns' lines in order. Each task holds a line at a time, however long the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        k = digest = None
        told = lambda: pa.RecordBatch.from_pydict({"k": [k], "sha": [digest.hexdigest()]})
        for b in batches:
            for own, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own == k:
                    digest.update(b"\n")
                else:
                    if digest:
                        yield told()
                    k, digest = own, hashlib.sha256()
                digest.update(line.encode("utf-8", "replace"))
        if digest:
            yield told()

    ordered = turns.repartition("k").sortWithinPartitions("k", "piece", "n")
    return ordered.select("k", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(run, "k string, sha string")


# --- the operator -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """reports: conv_id, COUNTS, audit, a row for each conversation. turns: conv_id, piece, n, role, text of the repaired
    conversations, in the order of piece and n. digests: conv_id, sha, of the lines role:text."""

    reports: DataFrame
    turns: DataFrame
    digests: DataFrame


def repair(rows: DataFrame) -> Repair:
    """rows: conv_id, turn, role, text."""
    both = cut(_whole(sorted_rows(rows)), "conversations")
    whole = both.filter("audit is not null")
    k = F.to_json(F.struct("conv_id")).alias("k")  # a null id is one too
    open_rows = cut(both.filter("audit is null").select(k, "conv_id", "turn", "role", "text", "at"), "shared-conversations")
    reports, turns = _shared(open_rows)
    turns = cut(turns, "repaired-turns")
    ids = open_rows.groupBy("k").agg(F.first("conv_id").alias("conv_id"))
    line = lambda x: F.concat(x.role, F.lit(":"), x.text)
    digests = whole.select("conv_id", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("sha"))
    own_turns = whole.select("conv_id", F.lit(-1).cast("bigint").alias("piece"), F.posexplode("repaired").alias("n", "t")).select("conv_id", "piece", F.col("n").cast("bigint").alias("n"), "t.role", "t.text")
    empty = F.sha2(F.lit(""), 256)
    return Repair(
        whole.select("conv_id", *COUNTS, "audit").unionByName(reports.join(ids, "k").select("conv_id", *COUNTS, "audit")),
        own_turns.unionByName(turns.join(ids, "k").select("conv_id", "piece", "n", "role", "text")),
        digests.unionByName(ids.join(_streamed_digests(turns), "k", "left").select("conv_id", F.coalesce("sha", empty).alias("sha"))),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of "conv_id:turn" modulo 20: 0 goes, 1 loses its text, 2 its [.!?], 3 is there twice, 4 is the
    user's. A null is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), n.alias("n")).filter("n <> 0")
    changed = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("n") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    done = repair(damage(given))
    found = done.reports.alias("r").join(done.digests.alias("d"), F.col("r.conv_id").eqNullSafe(F.col("d.conv_id"))).select("r.*", "d.sha")
    found = found.withColumnRenamed("conv_id", "found_id")
    every = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    crc, at = crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")
    go = "CASE j WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 2 THEN 3 ELSE 2 END ELSE CASE s WHEN 2 THEN 2 ELSE 3 END END"
    new = "CASE j WHEN 0 THEN [] WHEN 1 THEN [CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE CASE s WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END"
    return f"""
WITH RECURSIVE {crc},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {at} % 20 AS n FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM c, unnest(range(CASE n WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) copies(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind,
      CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
           WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, '00000000' AS k, CAST([] AS VARCHAR[]) AS lines FROM f
  UNION ALL
  SELECT conv_id, i, s, min(k), arg_min(lines, k) FROM (
    SELECT conv_id, i, CASE op WHEN 'D' THEN t WHEN 'K' THEN kind ELSE CASE t WHEN 2 THEN 3 ELSE 2 END END AS s,
           printf('%08d', CAST(left(k, 8) AS INT) + 2 * j + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CAST(op <> 'D' AND fault = 'truncated' AS INT)) || substr(k, 9) || repeat('I', j) || op AS k,
           lines || more || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE t WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS lines
    FROM (SELECT r.conv_id, r.i + 1 AS i, r.k, r.lines, CAST(j AS INT) AS j, {go} AS t, {new} AS more FROM r, unnest(range(3)) ins(j)) p
      JOIN f USING (conv_id, i), unnest(['D', 'K', 'R']) ops(op)
    WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR (kind = 1 AND t = 0) OR (kind = 2 AND t <> 2) OR (kind = 3 AND t = 2)))
  GROUP BY ALL),
last AS (SELECT conv_id, max(i) AS i FROM f GROUP BY 1),
done AS (SELECT conv_id, min(k) AS k, arg_min(lines, k) AS lines FROM (
    SELECT conv_id, printf('%08d', CAST(left(k, 8) AS INT) + 2 * j) || substr(k, 9) || repeat('I', j) AS k, lines || more AS lines, t
    FROM (SELECT conv_id, k, lines, CAST(j AS INT) AS j, {go} AS t, {new} AS more FROM r JOIN last USING (conv_id, i), unnest(range(3)) ins(j)))
  WHERE t IN (0, 3) GROUP BY 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(CAST(left(k, 8) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(k, 9), '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN done USING (conv_id)
"""


SQL = _sql()
