"""Repairing the structure of conversations at least cost.

A conversation is right if its roles read: perhaps one system turn, then user and assistant in turn. Turns are kept,
given another role, deleted or inserted; the cheapest way is searched with A* on the lattice of turns read and last
role written. What is still to come costs at least the deletion of every turn that must go and of every truncated one, which would
cost more if kept: suffix sums that never overestimate and never fall by more than an edit costs. The open list is ordered by cost plus that,
then by the audit, the edits' letters so far, so the first complete audit is the least of the cheapest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep.llm import common

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Last role written: none, system, user, assistant. NEXT: what a role's initial leads to.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
TURN = "uuau"  # the role that can follow each, by itself
NAMES = {"u": "user", "a": "assistant"}
#: Codes of turns up to that length whose search is remembered, and how many.
SHORT, REMEMBERED = 64, 20_000


class _Step:
    """An edit on the way: what has been read and written, the cost, and the edits before it by parent and jump pointers."""

    __slots__ = ("bound", "cost", "depth", "jump", "letter", "parent", "read", "role")

    def __init__(self, parent: _Step | None, letter: str, read: int, role: int, cost: int, bound: int):
        self.parent, self.letter, self.read, self.role, self.cost, self.bound = parent, letter, read, role, cost, bound
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = parent.depth + 1, parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def __lt__(self, other: _Step) -> bool:
        """By bound, then by audit: where the two ways part, found in steps that grow with the logarithm of their lengths."""
        if self.bound != other.bound:
            return self.bound < other.bound
        x, y = self.lifted(other.depth), other.lifted(self.depth)
        if x is y:
            return self.depth < other.depth
        while x.parent is not y.parent:
            x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.parent, y.parent)
        return x.letter < y.letter

    def lifted(self, depth: int) -> _Step:
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.parent
        return x


def search(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns: s, u, a or x by the role, in capitals if truncated, d if the turn must go."""
    least = [0] * (len(codes) + 1)
    for k in range(len(codes) - 1, -1, -1):
        least[k] = least[k + 1] + (0 if codes[k] in "suax" else min(DELETE, TRUNCATED))
    heap, done = [_Step(None, "", 0, 0, 0, least[0])], set()
    while True:
        here = heapq.heappop(heap)
        read, role = here.read, here.role
        if (read, role) in done:
            continue
        done.add((read, role))
        if read == len(codes) and role in (0, 3):
            break
        edits = [("I", read, NEXT[TURN[role]][role], INSERT)]
        if read < len(codes):
            edits.append(("D", read + 1, role, DELETE))
            code = codes[read]
            if code != "d":
                extra = TRUNCATED if code.isupper() else 0
                edits.append(("R", read + 1, NEXT[TURN[role]][role], REROLE + extra))
                kept = NEXT[code.lower()][role] if code not in "xX" else None
                if kept is not None:
                    edits.append(("K", read + 1, kept, extra))
        for letter, then, into, price in edits:
            if (then, into) not in done:
                cost = here.cost + price
                heapq.heappush(heap, _Step(here, letter, then, into, cost, cost + least[then]))
    letters = []
    step = here
    while step.parent is not None:
        letters.append(step.letter)
        step = step.parent
    return here.cost, "".join(reversed(letters))


@lru_cache(REMEMBERED)
def _remembered(codes: str) -> tuple[int, str]:
    return search(codes)


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) in order: pos from 1, turn, role, text, fault (blank, duplicate, truncated or none), clash (with the turn before), anew (a turn number not seen), code."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(order)
    rows = rows.withColumns({
        "pos": F.row_number().over(order).cast("long"),
        "clash": F.coalesce(~F.concat(before, initial).isin("su", "ua", "au"), F.lit(False)),
        "anew": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)),
        "same": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256),
    })
    again = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("pos")) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    rows = rows.withColumn("again", again).withColumn("fault", fault)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return rows.withColumn("code", code).drop("again", "same")


def audits(marks: DataFrame) -> DataFrame:
    """conv_id, cost, audit of the cheapest repair. A task reads a conversation as one letter a turn."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, codes, kind = nothing, [], pa.int64()
        for batch in batches:
            out, kind = [], batch["conv_id"].type
            for c, code in zip(batch["conv_id"].to_pylist(), batch["code"].to_pylist()):
                if c != conv or conv is nothing:
                    if conv is not nothing:
                        out.append((conv, *solved("".join(codes))))
                    conv, codes = c, []
                codes.append(code)
            if out:
                yield table(out, kind)
        if conv is not nothing:
            yield table([(conv, *solved("".join(codes)))], kind)

    def solved(codes: str) -> tuple[int, str]:
        return _remembered(codes) if len(codes) <= SHORT else search(codes)

    def table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.string()))], names=["conv_id", "cost", "audit"])

    rows = marks.select("conv_id", "pos", "code").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(common.lean(find), f"conv_id {marks.schema['conv_id'].dataType.simpleString()}, cost long, audit string")


def applied(marks: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 1), edit (K, R or I), pos (of the turn, null for an inserted one), role, text. Turns stream behind their audit."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, role, place = None, "", 0, 0, 0
        kind = pa.int64()

        def write(letter: str, pos: int | None, name: str, text: str) -> tuple:
            nonlocal role, place
            if letter != "K":
                name = NAMES[TURN[role]]
            role = NEXT[name[0]][role]
            place += 1
            return conv, place, letter, pos, name, text

        def inserted() -> Iterator[tuple]:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield write("I", None, "", "")

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "edit", "pos", "role", "text"])

        for batch in batches:
            out, kind = [], batch["conv_id"].type
            for c, pos, audit_, name, text in zip(*(batch[x].to_pylist() for x in ("conv_id", "pos", "audit", "role", "text"))):
                if not pos:
                    out.extend(inserted())
                    conv, audit, at, role, place = c, audit_, 0, 0, 0
                    continue
                out.extend(inserted())
                letter = audit[at]
                at += 1
                if letter != "D":
                    out.append(write(letter, pos, name, text))
            if out:
                yield table(out)
        if rest := list(inserted()):
            yield table(rest)

    none = F.lit(None).cast("string")
    rows = found.select("conv_id", F.lit(0).cast("long").alias("pos"), "audit", none.alias("role"), none.alias("text"))
    rows = rows.unionByName(marks.select("conv_id", "pos", none.alias("audit"), "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(edit, f"conv_id {marks.schema['conv_id'].dataType.simpleString()}, place long, edit string, pos long, role string, text string")


class Repair(NamedTuple):
    """report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; turns: those of applied()."""

    report: DataFrame
    turns: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """The cheapest repair of every conversation (conv_id, turn, role, text; other columns are left out).

    Turns stand in the order of turn (null first), role and text. A null role or text counts as one space; rows without
    conv_id are one conversation. Of repeated rows all but the first are duplicates. An empty table gives empty ones. Turn numbers must lie within 2 ** 63 of each
    other. A conversation is read turn by turn in one task, which keeps a letter and an edit of each.
    """
    marks = common.stash(marked(conversations))
    found = common.stash(audits(marks))
    of = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("anew"), F.lit(0)).cast("long")
    report = marks.groupBy("conv_id").agg(gaps.alias("gaps"), *of, F.count_if("clash").alias("illegal"))
    same = report["conv_id"].eqNullSafe(found["conv_id"])
    return Repair(report.join(found, same).drop(found["conv_id"]), applied(marks, found))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the CRC32 of conv_id:turn modulo 20, nulls read as one space: 0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"role": F.when(F.col("f") == 4, "user").otherwise(F.col("role")), "text": text})
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("f") == 3, 2).otherwise(1)))).drop("f", "again")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest repair and the hash of what it gives.

    Nulls are one space, in roles, texts and the key of the damage; rows without a conv_id are one conversation, told under null.
    """
    conversations = common.table(spark, sf_dir, "conversations")
    report, turns = repair(damaged(conversations))
    hashes = common.sha256_in_order(turns.withColumn("line", F.concat("role", F.lit(":"), "text")), ["conv_id"], ["place"], "line", "\n")
    out = conversations.select("conv_id").distinct()
    for more in (report, hashes):
        more = more.withColumnRenamed("conv_id", "same")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("same")), "left").drop("same")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = {"op12_turn_repair": op12_turn_repair}


def _more(x: str, price: str, letter: str) -> str:
    return f"(lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {price} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}')"


def _sql() -> str:
    """Cost and audit of the best way to each last role as one string, nine digits and the letters, so that least() decides; a row at a time."""
    never = "'900000000'"
    closed = {"q0": "p0", "q1": "p1", "q2": f"least(p2, {', '.join(_more(p, '5', 'I') for p in ('p0', 'p1', 'p3'))})"}
    closed["q3"] = f"least(p3, {_more(closed['q2'], '5', 'I')})"
    extra = "(CASE WHEN code IN ('S', 'U', 'A', 'X') THEN 5 ELSE 0 END)"
    kept = lambda q, role: f"CASE WHEN lower(code) = '{role}' THEN {_more(q, extra, 'K')} ELSE {never} END"
    roled = lambda q: f"CASE WHEN code <> 'd' THEN {_more(q, f'1 + {extra}', 'R')} ELSE {never} END"
    step = {
        "p0": [], "p1": [kept("q0", "s")],
        "p2": [f(q) for q in ("q0", "q1", "q3") for f in (lambda q: kept(q, "u"), roled)],
        "p3": [kept("q2", "a"), roled("q2")],
    }
    steps = ", ".join(f"least({', '.join([_more('q' + k[1], '2', 'D'), *v, never])}) AS {k}" for k, v in step.items())
    from strandkeep.llm.prefix_trie import CRC_SQL

    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        f AS (SELECT * EXCLUDE (key), xor({CRC_SQL.format(x="key")}, 4294967295) % 20 AS f FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM f, range(2) c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
        o AS (SELECT *, row_number() OVER w AS pos, lag(role[1]) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        g AS (SELECT *, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM o),
        h AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM g),
        m AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(kind) ELSE kind END AS code FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS kind FROM h)),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
        p AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS p0, {never} AS p1, {never} AS p2, {never} AS p3 FROM n
            UNION ALL SELECT conv_id, pos, {steps} FROM (SELECT m.conv_id, m.pos, m.code, {', '.join(f'{v} AS {k}' for k, v in closed.items())} FROM p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.pos = p.pos + 1)),
        b AS (SELECT p.conv_id, n.* EXCLUDE (conv_id, n), least(p0, {closed['q3']}) AS best FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.pos),
        e AS (SELECT conv_id, i, substr(best, CAST(i + 9 AS BIGINT), 1) AS edit, count(*) FILTER (substr(best, CAST(i + 9 AS BIGINT), 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM b, LATERAL (SELECT unnest(range(1, len(best) - 8)) AS i)),
        r AS (SELECT e.conv_id, i, edit, role, text, row_number() OVER w AS place, first_value(edit = 'K' AND role[1] = 's') OVER w AS headed FROM e LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.pos = e.pos
            WHERE edit <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY i)),
        l AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN headed THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS hash FROM r GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES = {"op12_turn_repair": _sql()}
