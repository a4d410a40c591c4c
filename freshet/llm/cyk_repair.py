"""Least-cost repair of conversations by weighted CYK parsing over spans of rows.

A conversation is well formed when the initials of its roles match (s?(ua)+)?. Rows may be kept (cost
0), given the role user or assistant (Rerole, 2) or deleted (3), and rows of user or assistant without
text inserted anywhere (2); a kept or reroled row that is truncated costs 1 more, and rows that are
blank or duplicates have to go. The audit is the edits' initials in order; of cheapest edits the one
whose audit is least in ASCII counts.

The grammar is in Chomsky normal form. Its nonterminals are pairs (p, q) of places in the pattern: start,
after s, after u, after a. (p, r) becomes (p, q) (q, r); (p, q) becomes a row by keep, rerole or
delete. Insertions derive an empty span; their closure stands before and after every row's cells. A cell
of a span holds the least (cost, audit) of its nonterminal. For this grammar all ways of splitting a
span give the same cell: cells are joined by an associative product, and two different audits of a span
with equal costs never begin one another (both name the same rows, so the longer would hold more
insertions). So each span is split once, and the chart holds the spans of one tree, combined bottom-up
by span length: 1, 2, 4, ... rows within a block of BLOCK rows, then up to FAN blocks at a time. The
answer is the lesser of the nonterminals (start, start) and (start, after a) over the whole.

On Spark: rows are range-partitioned and sorted, so a long conversation lies in several partitions;
blocks of it are parsed in different tasks, and only spans (16 cells) travel on. Duplicates are found by
the first place of each (conversation, digest of role and text). The edits are then laid over the rows
of a conversation in order, streamed in batches.

Faults, the first counts: blank (no character outside \\x20 and \\x09-\\x0D), duplicate (role and text of an
earlier row), truncated (last such character none of .!?).

Defined cases: null role or text is one space; a null conversation is a conversation; rows stand by
turn, nulls first, equal turns by role, then text; repeated rows are duplicates; a role that begins with
none of s, u, a, or is empty, can only be reroled or deleted; two texts with equal MD5 count as equal; an
empty table gives no rows; texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import lean
from freshet.session import cut, shuffle_width

PLACES = 4  # start, after s, after u, after a
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),), "x": ()}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
BLOCK_BITS, FAN_BITS = 8, 6  # 256 rows of a block, 64 spans combined at a time
KNOWN_ROWS, KNOWN = 8, 20_000  # spans of at most so many rows are remembered, so many of them

#: Least (cost, audit) of nonterminal (p, q) at p * PLACES + q; None where nothing derives it.
Cells = list[tuple[int, str] | None]


def product(left: Cells, right: Cells) -> Cells:
    """Cells of two spans laid end to end: the binary rules."""
    out: Cells = [None] * len(left)
    for p in range(PLACES):
        for q in range(PLACES):
            a = left[p * PLACES + q]
            if a is None:
                continue
            for r in range(PLACES):
                b = right[q * PLACES + r]
                if b is None:
                    continue
                both, at = (a[0] + b[0], a[1] + b[1]), p * PLACES + r
                if out[at] is None or both < out[at]:
                    out[at] = both
    return out


def _cells(*entries: tuple[int, int, int, str]) -> Cells:
    out: Cells = [None] * PLACES**2
    for p, q, cost, audit in entries:
        at = p * PLACES + q
        out[at] = min(out[at] or (cost, audit), (cost, audit))
    return out


def _closure() -> Cells:
    """Empty spans by any number of insertions; a way that comes by a place twice is never the cheapest."""
    one = _cells(*[(p, p, 0, "") for p in range(PLACES)], *[(p, q, INSERT, "I") for role in "ua" for p, q in STEPS[role]])
    out = one
    for _ in range(PLACES):
        out = product(out, one)
    return out


INSERTED = _closure()


def _row(role: str, fault: int) -> Cells:
    """Cells of one row, insertions around it included; fault: 0 none, 1 truncated, 2 has to go."""
    entries = [(p, p, DELETE, "D") for p in range(PLACES)]
    if fault < 2:
        more = TRUNCATED * fault
        entries += [(p, q, KEEP + more, "K") for p, q in STEPS[role]]
        entries += [(p, q, REROLE + more, "R") for to in "ua" for p, q in STEPS[to]]
    return product(product(INSERTED, _cells(*entries)), INSERTED)


ROLES = "suax"
SYMBOLS = {chr(65 + 3 * r + fault): (role, fault) for r, role in enumerate(ROLES) for fault in range(3)}
ROWS = {symbol: _row(*of) for symbol, of in SYMBOLS.items()}


@dataclass
class Span:
    """What is known of consecutive rows."""

    cells: Cells
    first: str  # class of the first and of the last row's role
    last: str
    illegal: int  # neighbours whose initials are no legal pair

    def __add__(self, other: Span) -> Span:
        crossing = self.last + other.first not in LEGAL
        return Span(product(self.cells, other.cells), self.first, other.last, self.illegal + other.illegal + crossing)


def combine(spans: list[Span]) -> Span:
    """Bottom-up by span length: neighbours in pairs, until one span is left."""
    while len(spans) > 1:
        spans = [spans[i] + spans[i + 1] if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


_known: dict[str, Span] = {}


def chart(symbols: str) -> Span:
    """The span of a block's rows; short spans are remembered by their symbols."""
    level = [(s, Span(ROWS[s], SYMBOLS[s][0], SYMBOLS[s][0], 0)) for s in symbols]
    while len(level) > 1:
        above = []
        for i in range(0, len(level) - 1, 2):
            name = level[i][0] + level[i + 1][0]
            span = _known.get(name)
            if span is None:
                span = level[i][1] + level[i + 1][1]
                if len(name) <= KNOWN_ROWS:
                    if len(_known) >= KNOWN:
                        _known.clear()
                    _known[name] = span
            above.append((name, span))
        level = above + level[len(level) - len(level) % 2 :]
    return level[0][1]


SPAN = pa.struct([("at", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])
SPAN_SQL = "at long, costs array<long>, audits array<string>, first string, last string, illegal long"


def _packed(at: int, span: Span) -> dict:
    return {
        "at": at, "costs": [-1 if c is None else c[0] for c in span.cells], "audits": ["" if c is None else c[1] for c in span.cells],
        "first": span.first, "last": span.last, "illegal": span.illegal,
    }


def _unpacked(row: dict) -> Span:
    return Span([None if c < 0 else (c, a) for c, a in zip(row["costs"], row["audits"])], row["first"], row["last"], row["illegal"])


def _each(df: DataFrame, one: Callable[[object], dict], out: pa.DataType, schema: str) -> DataFrame:
    """conv_id and the struct that `one` makes of the other column, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([one(x) for x in batch.column(1).to_pylist()], out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.flatten()], ["conv_id", *[f.name for f in out]])

    return lean(df).mapInArrow(run, f"conv_id long, {schema}")


def _cheapest(spans: list[dict]) -> dict:
    whole = combine([_unpacked(s) for s in spans])
    cost, audit = min(c for c in (whole.cells[0], whole.cells[3]) if c is not None)
    return {"cost": cost, "audit": audit, "illegal": whole.illegal}


def _gathered(spans: DataFrame, *keys: Column) -> DataFrame:
    found = spans.groupBy("conv_id", *keys).agg(F.array_sort(F.collect_list(F.struct("at", "costs", "audits", "first", "last", "illegal"))).alias("spans"))
    return found.select("conv_id", "spans")


def parsed(codes: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal of rows (conv_id, at, symbol); `at` gives their order."""
    row = F.struct("at", "symbol")
    blocks = codes.groupBy("conv_id", F.shiftright("at", BLOCK_BITS)).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    named = F.struct(F.col("rows")[0]["at"].alias("at"), F.array_join(F.col("rows.symbol"), "").alias("symbols")).alias("block")
    spans = cut(_each(blocks.select("conv_id", named), lambda x: _packed(x["at"], chart(x["symbols"])), SPAN, SPAN_SQL))
    bits = BLOCK_BITS
    while (spans.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1 << FAN_BITS:  # at most nine times
        bits += FAN_BITS
        joined = _gathered(spans, F.shiftright("at", bits))
        spans = cut(_each(joined, lambda x: _packed(x[0]["at"], combine([_unpacked(s) for s in x])), SPAN, SPAN_SQL))
    return _each(_gathered(spans), _cheapest, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())]), "cost long, audit string, illegal long")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, kind, at, role, text) of a partition, a conversation's audit before its rows."""
    audit, at, place, odd = "", 0, 0, 0
    conv = None

    def role_here() -> str:
        return "user" if (place - odd) % 2 == 0 else "assistant"

    for batch in batches:
        out: list[tuple] = []
        for conv_next, kind, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if kind == 0:  # the audit of the next conversation; insertions at the end of the last one are out already
                conv, audit, at, place = conv_next, text, 0, 0
                odd = (len(audit) - audit.count("D")) % 2
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    out.append((conv, place, edit, role if edit == "K" else role_here(), text))
                    place += 1
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", role_here(), ""))
                at, place = at + 1, place + 1
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "place", "edit", "role", "text"])


@dataclass(frozen=True)
class Repair:
    """conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: conv_id, place (from 0), edit (K, R or I), role, text; the partitions hold whole conversations in order.
    """

    conversations: DataFrame
    rows: DataFrame


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    spark = df.sparkSession
    named = [F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn")]
    named += [F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = df.select(*named).repartitionByRange(shuffle_width(spark), "conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 16))
    rows = cut(rows.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id()))
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    initial = F.substring("role", 1, 1)
    faults = cut(rows.select(
        "conv_id", "turn", "at", F.when(initial.isin(*ROLES[:3]), initial).otherwise("x").alias("role"), (ended == "").alias("blank"),
        (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("open"), digest.alias("digest"),
    ))
    firsts = faults.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    faults = faults.join(firsts, "at", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    faults = cut(faults.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open")).select("conv_id", "turn", "at", "role", "blank", "duplicate", "truncated"))
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    symbol = F.char(F.lit(65) + 3 * (F.instr(F.lit(ROLES), F.col("role")) - 1) + fault)
    solved = cut(parsed(faults.select("conv_id", "at", symbol.alias("symbol"))))
    wide = [F.expr(f"{f}(turn)").cast("decimal(38,0)") for f in ("max", "min")]  # the difference may leave the range of long
    gaps = F.coalesce(wide[0] - wide[1] + 1 - F.count_distinct("turn"), F.lit(0))
    counts = faults.groupBy("conv_id").agg(F.least(gaps, F.lit((1 << 63) - 1)).cast("long").alias("gaps"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    own = solved.withColumnRenamed("conv_id", "_conv")
    found = counts.join(own, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    none = F.lit(None).cast("long")
    audits = solved.select("conv_id", F.lit(0).alias("kind"), none.alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "at", "role", "text"))
    dealt = lean(both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at"))
    return Repair(found, dealt.mapInArrow(_edits, "conv_id long, place long, edit string, role string, text string"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `Repair.rows`: SHA-256 of role:text, joined by newlines; streamed in the same partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running = None, None
        for batch in batches:
            done = []
            for of, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if place == 0:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = of, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield _hashes(done)
        if running is not None:
            yield _hashes([(conv, running.hexdigest())])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text,
    2 takes out its ends of sentences, 3 repeats it, 4 gives it the role user; a null is one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repaired_conversations(df: DataFrame) -> DataFrame:
    """One row per conversation of `df`, damaged and repaired; without rows after damage: zeros and empty texts."""
    done = repair(damaged(df))
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every
    for n, part in enumerate((done.conversations, digests(done.rows))):
        part = part.withColumnRenamed("conv_id", f"_conv{n}")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(f"_conv{n}")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _moved(z: str, cost: str, letter: str) -> str:
    return f"printf('%06d%s', CAST(substr({z}, 1, 6) AS INT) + {cost}, substr({z}, 7) || '{letter}')"


_SQL_STEPS = [
    _moved("z0", "3", "D"),
    "least(" + _moved("z1", "3", "D") + ", CASE WHEN r.f < 2 AND r.i = 's' THEN " + _moved("z0", "r.f", "K") + " END)",
    "least(" + ", ".join([_moved("z2", "3", "D"), *[
        f"CASE WHEN r.f < 2 THEN CASE WHEN r.i = 'u' THEN {_moved(z, 'r.f', 'K')} ELSE {_moved(z, '2 + r.f', 'R')} END END" for z in ("z0", "z1", "z3")]]) + ")",
    "least(" + _moved("z3", "3", "D") + f", CASE WHEN r.f < 2 THEN CASE WHEN r.i = 'a' THEN {_moved('z2', 'r.f', 'K')} ELSE {_moved('z2', '2 + r.f', 'R')} END END)",
]

SQL = f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
),
steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS codes FROM conversations),
hit AS (SELECT k.*, xor(list_reduce(codes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 20 AS kind FROM keyed k, steps),
rowed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS ended FROM rowed),
judged AS (
  SELECT *, left(role, 1) AS i, ended = '' AS blank, ended <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate FROM placed
),
faulty AS (SELECT *, NOT blank AND NOT duplicate AND right(ended, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
ready AS (SELECT *, CASE WHEN blank OR duplicate THEN 2 WHEN truncated THEN 1 ELSE 0 END AS f, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM faulty),
dp(conv_id, n, z0, z1, z2, z3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000', CAST(NULL AS VARCHAR), '000002I', '000004II' FROM ready
  UNION ALL
  SELECT conv_id, n, z0, z1, least(z2, {_moved('z0', '2', 'I')}, {_moved('z1', '2', 'I')}, {_moved('z3', '2', 'I')}) AS z2,
    least(z3, {_moved('z2', '2', 'I')}, {_moved('z0', '4', 'II')}, {_moved('z1', '4', 'II')}) AS z3
  FROM (SELECT d.conv_id, r.n, {", ".join(f"{s} AS z{k}" for k, s in enumerate(_SQL_STEPS))}
        FROM dp d JOIN ready r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n + 1) moved
),
ends AS (SELECT conv_id, least(z0, z3) AS z FROM dp QUALIFY n = max(n) OVER (PARTITION BY conv_id)),
best AS (SELECT conv_id, CAST(substr(z, 1, 6) AS BIGINT) AS cost, substr(z, 7) AS audit FROM ends),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS letter, unnest(range(1, 1 + len(audit))) AS p FROM best WHERE audit <> ''),
walked AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS place,
  sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) % 2 AS odd FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (
  SELECT w.conv_id, w.p, CASE WHEN letter = 'K' THEN r.role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END AS line
  FROM walked w LEFT JOIN ready r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n WHERE letter <> 'D'
),
texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS repaired_sha256 FROM lines GROUP BY conv_id),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ready GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
