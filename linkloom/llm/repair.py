"""Repair of the order of roles in conversations, by depth-first branch and bound.

Rows become one symbol each: the class of the role's initial (s, u, a, any other) and the first
fault. A conversation's symbols go to the search, which walks over (rows taken, place in the
pattern ``(s?(ua)+)?``). The least cost of what is left, audits aside, is worked out
from the last row back and bounds every node from below. An explicit stack holds the open prefixes,
the most promising on top, of equal ones that with the least letter; a prefix goes if its
cost and bound exceed the incumbent's (cost, audit), or if its node's dominance table
holds a prefix of no greater cost. The search ends when the stack is empty, so optimality is
proved. The bounds are tight, so a node is opened once and time grows with the rows.

What is gathered of a conversation is one symbol a row, as long as the audit that the result holds in one
row. Texts stay out of it: rows are numbered by a range sort of digests, first
occurrences are found by partial aggregation, and texts move once, to a task that reads a
conversation in order and feeds the hash row by row, without holding it.

Defined cases: a null role or text is one space, as is a null id or turn in the checksum; an
empty role has no legal initial; null turns come first; rows of equal turn go by the MD5 of role and
text; a null conv_id is a conversation; rows alike in all columns are rows of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import running, table

DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)
DAMAGES = 20
BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
STOPS = ".!?"
INITIALS = "sua"
#: Symbol of a row: initial (3: another one) and, in fours, fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: Places in the pattern: nothing yet, after s, after u, after a. The role that must follow, and where it leads.
NEEDED = ("user", "user", "assistant", "user")
STEP = (2, 2, 3, 2)
#: Where a kept row leads, by place and initial; -1 is nowhere.
KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ENDS = (0, 3)
FAR = 1 << 60
#: Rows whose symbols are put together at a time.
RUN = 4096
#: Symbols of short conversations are often the same.
SHORT = 64


def bounds(symbols: str) -> array:
    """Least cost of the rest, at 4 * (rows taken) + place."""
    n = len(symbols)
    out = array("q", bytes(32 * (n + 1)))
    after = [0 if p in ENDS else FAR for p in range(4)]
    for i in range(n, -1, -1):
        if i < n:
            fault, initial = divmod(int(symbols[i], 16), 4)
            cut = CUT if fault == TRUNCATED else 0
            moves = []
            for p in range(4):
                least = DELETE + after[p]
                if fault < BLANK:
                    least = min(least, REROLE + cut + after[STEP[p]])
                    if KEEP[p][initial] >= 0:
                        least = min(least, cut + after[KEEP[p][initial]])
                moves.append(least)
            after = moves
        # Insertions lead from 2 to 3 and back, and into 2 from the start.
        after[2], after[3] = min(after[2], INSERT + after[3]), min(after[3], INSERT + after[2])
        after[0], after[1] = min(after[0], INSERT + after[2]), min(after[1], INSERT + after[2])
        out[4 * i : 4 * i + 4] = array("q", after)
    return out


def search(symbols: str) -> tuple[int, str]:
    """Least cost of a repair and the ASCII-least audit of that cost."""
    n = len(symbols)
    bound = bounds(symbols)
    dominance = array("q", [FAR]) * len(bound)
    cost_best, audit_best = FAR, b""
    path = bytearray()
    stack = [(0, 0, 0, 0, 0)]
    while stack:
        depth, letter, taken, place, cost = stack.pop()
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        node = 4 * taken + place
        least = cost + bound[node]
        if least > cost_best or cost >= dominance[node]:
            continue
        if least == cost_best and path > audit_best[:depth]:
            continue
        dominance[node] = cost
        if taken == n and place in ENDS:
            # Only a smaller (cost, audit) gets here.
            cost_best, audit_best = cost, bytes(path)
            continue
        open_ = [(b"I"[0], taken, STEP[place], cost + INSERT)]
        if taken < n:
            fault, initial = divmod(int(symbols[taken], 16), 4)
            cut = CUT if fault == TRUNCATED else 0
            open_.append((b"D"[0], taken + 1, place, cost + DELETE))
            if fault < BLANK:
                open_.append((b"R"[0], taken + 1, STEP[place], cost + REROLE + cut))
                if KEEP[place][initial] >= 0:
                    open_.append((b"K"[0], taken + 1, KEEP[place][initial], cost + cut))
        open_.sort(key=lambda o: (o[3] + bound[4 * o[1] + o[2]], o[0]), reverse=True)
        stack += [(depth + 1, *o) for o in open_]
    return cost_best, audit_best.decode()


def faults(symbols: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours that may not follow each other."""
    count = [sum(symbols.count(f"{4 * fault + i:x}") for i in range(4)) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    initials = [int(s, 16) % 4 for s in symbols]
    legal = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}
    return *count, sum(pair not in legal for pair in zip(initials, initials[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same, damaged, with ``copies``: how often a row is there."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(key) % DAMAGES).cast("int")
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == AS_USER, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == EMPTY, "").when(kind == UNSTOP, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1).alias("copies"),
    )


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))


def standing(rows: DataFrame) -> DataFrame:
    """Each row as often as it is there."""
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return rows.withColumn("copy", again).drop("copy", "copies")


def symbols_of(rows: DataFrame) -> DataFrame:
    """Standing rows (conv_id, turn, role, text, digest) -> conv_id, symbols."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.coalesce(
        *(F.when(F.col("role").startswith(c), F.lit(i)) for i, c in enumerate(INITIALS)), F.lit(len(INITIALS))
    )
    slim = rows.select(
        "conv_id",
        "turn",
        "digest",
        initial.alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(*STOPS)).alias("cut"),
        F.monotonically_increasing_id().alias("mark"),
    )
    laid = running(slim, [F.col("conv_id"), F.col("turn"), F.col("digest"), F.col("mark")], name="repair-rows")
    firsts = laid.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    symbol = F.lower(F.hex(fault * 4 + F.col("initial")))
    each = laid.join(firsts, "pos", "left").select("conv_id", "pos", symbol.alias("symbol"))

    def joined(rows: DataFrame, at: Column, name: str, *keys) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("symbol"))))
        return rows.groupBy("conv_id", *keys).agg(F.array_join(listed["symbol"], "").alias(name))

    runs = joined(each, F.col("pos"), "symbol", F.floor(F.col("pos") / RUN).alias("run"))
    return joined(runs, F.col("run"), "symbols")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame, standing_rows: DataFrame) -> DataFrame:
    """Damaged rows -> conv_id and the columns of ``RESULT``, for every conv_id."""
    there = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.max(there) - F.min(there) + 1 - F.count_distinct(there)
    every = rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    symbols = symbols_of(standing_rows).withColumnRenamed("conv_id", "own")
    known = every.join(symbols, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", "gaps", F.coalesce("symbols", F.lit("")).alias("symbols"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recalled = functools.lru_cache(1 << 15)(search)
        for batch in batches:
            out = []
            for symbols in batch.column("symbols").to_pylist():
                out.append((*faults(symbols), *(recalled if len(symbols) <= SHORT else search)(symbols)))
            more = [pa.array([o[i] for o in out], pa.string() if i == 5 else pa.int64()) for i in range(6)]
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            yield pa.record_batch([batch.column("conv_id"), batch.column("gaps"), *more], names)

    return known.mapInArrow(solve, f"conv_id {kind}, {RESULT}")


class Mended:
    """Hash of a conversation as its rows pass, given its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.hash, self.between = hashlib.sha256(), b""

    def put(self, role: str, text: str) -> None:
        self.hash.update(self.between + role.encode() + b":" + text.encode())
        self.between = b"\n"

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(NEEDED[self.place], "")
            self.place = STEP[self.place]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text)
            self.place = KEEP[self.place][INITIALS.index(role[0])]
        elif edit == "R":
            self.put(NEEDED[self.place], text)
            self.place = STEP[self.place]

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, the columns of ``RESULT`` and repaired_sha256."""
    rows = with_digest(damaged(conversations))
    there = standing(rows)
    heads = plans(rows, there)
    names = heads.columns
    kind = rows.schema["conv_id"].dataType.simpleString()
    # A conversation's plan comes before its rows.
    both = heads.withColumn("head", F.lit(True)).unionByName(there.withColumn("head", F.lit(False)), allowMissingColumns=True)
    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "digest")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [*(types[c] for c in names), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], [*names, "repaired_sha256"])

        for batch in batches:
            types = dict(zip(batch.schema.names, batch.schema.types))
            plan = [batch.column(c) for c in names]
            role, text = batch.column("role"), batch.column("text")
            for i, is_head in enumerate(batch.column("head").to_pylist()):
                if is_head:
                    if own:
                        done.append((*head, own.digest()))
                    head = [c[i].as_py() for c in plan]
                    own = Mended(head[-1])
                else:
                    own.row(role[i].as_py(), text[i].as_py())
            if len(done) >= RUN:
                yield out()
                done.clear()
        if own:
            done.append((*head, own.digest()))
            yield out()

    needed = in_order.select(*names, "head", "role", "text")
    return needed.mapInArrow(mend, f"conv_id {kind}, {RESULT}, repaired_sha256 string")


def op13(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def _moved(source: int, cost: str, edit: str, step: str) -> str:
    """A prefix at place ``source`` with one edit more, in SQL."""
    return f"CASE WHEN s{source} IS NOT NULL THEN {{'cost': s{source}.cost + {cost}, 'audit': s{source}.audit || '{edit}', 'plan': s{source}.plan || '{step}'}} END"


def _row_moves(target: int) -> str:
    """All ways of taking a row that lead to ``target``."""
    ways = [_moved(target, "3", "D", "d")]
    for p in range(4):
        for initial, goal in enumerate(KEEP[p]):
            if goal == target:
                ways.append(f"CASE WHEN fault < 2 AND initial = {initial} THEN {_moved(p, 'fault', 'K', 'k')} END")
        if STEP[p] == target:
            ways.append(f"CASE WHEN fault < 2 THEN {_moved(p, '2 + fault', 'R', NEEDED[p][0])} END")
    return f"list_min([{', '.join(ways)}])"


def _inserts(target: int) -> str:
    return f"list_min([s{target}, {', '.join(_moved(p, '2', 'I', NEEDED[p][0].upper()) for p in range(4) if STEP[p] == target)}])"


ORACLE = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS nth,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
  FROM conversations
), kinds AS (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM keyed
), rows_ AS (
  SELECT conv_id, turn, nth, copy, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy)
  WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT conv_id, turn, role, text, md5(length(role)::VARCHAR || ':' || role || text) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text), nth, copy) AS pos
  FROM rows_
), judged AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
         CASE WHEN role LIKE 's%' THEN 0 WHEN role LIKE 'u%' THEN 1 WHEN role LIKE 'a%' THEN 2 ELSE 3 END AS initial,
         row_number() OVER (PARTITION BY conv_id, digest ORDER BY pos) AS seen
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 2 WHEN seen > 1 THEN 3 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM judged
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum((fault = 2)::INT) AS blank, sum((fault = 3)::INT) AS duplicate, sum((fault = 1)::INT) AS truncated,
         sum((before IS NOT NULL AND (before, initial) NOT IN ((0, 1), (1, 2), (2, 1)))::INT) AS illegal,
         list(initial ORDER BY pos) AS initials, list(fault ORDER BY pos) AS faults
  FROM faulty GROUP BY conv_id
), convs AS (
  SELECT d.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
         coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, initials, faults
  FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
), start AS (
  SELECT conv_id, n, initials, faults, 0 AS i, {{'cost': 0, 'audit': '', 'plan': ''}} AS s0,
         {{'cost': 2, 'audit': 'I', 'plan': 'U'}} AS s2, {{'cost': 4, 'audit': 'II', 'plan': 'UA'}} AS s3
  FROM convs
), walk AS (
  SELECT conv_id, n, initials, faults, i, s0, CASE WHEN i < 0 THEN s0 END AS s1, s2, s3 FROM start
  UNION ALL
  SELECT conv_id, n, initials, faults, i, s0, s1, s2, {_inserts(3)} FROM (
    SELECT conv_id, n, initials, faults, i, s0, s1, {_inserts(2)} AS s2, s3 FROM (
      SELECT conv_id, n, initials, faults, i + 1 AS i, {", ".join(f"{_row_moves(t)} AS s{t}" for t in range(4))}
      FROM (SELECT *, faults[i + 1] AS fault, initials[i + 1] AS initial FROM walk WHERE i < n)))
), ended AS (SELECT conv_id, list_min([s0, s3]) AS best FROM walk WHERE i = n
), edits AS (
  SELECT conv_id, k, best.plan[k] AS step,
         k - length(regexp_replace(best.plan[1:k], '[^UA]', '', 'g')) AS pos
  FROM (SELECT conv_id, best, unnest(range(1, length(best.plan) + 1)) AS k FROM ended)
), mended AS (
  SELECT e.conv_id, string_agg(CASE e.step WHEN 'U' THEN 'user:' WHEN 'A' THEN 'assistant:' WHEN 'k' THEN p.role || ':' || p.text
           WHEN 'u' THEN 'user:' || p.text ELSE 'assistant:' || p.text END, chr(10) ORDER BY k) AS body
  FROM edits e LEFT JOIN placed p ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.pos = p.pos AND e.step NOT IN ('U', 'A')
  WHERE e.step <> 'd' GROUP BY e.conv_id
)
SELECT c.conv_id, CAST(c.gaps AS BIGINT) AS gaps, CAST(c.blank AS BIGINT) AS blank, CAST(c.duplicate AS BIGINT) AS duplicate,
       CAST(c.truncated AS BIGINT) AS truncated, CAST(c.illegal AS BIGINT) AS illegal, CAST(e.best.cost AS BIGINT) AS cost,
       e.best.audit AS audit, sha256(coalesce(m.body, '')) AS repaired_sha256
FROM convs c JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN mended m ON c.conv_id IS NOT DISTINCT FROM m.conv_id
"""
