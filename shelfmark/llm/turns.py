"""Repair of the turn structure of conversations, as streams sorted by turn.

Each conversation is made to follow (system?) (user assistant)+, or to be empty, by the cheapest
edits: keep a turn, give it another role, delete it, insert an empty one. The program over turns
and four states of that pattern runs from the last turn to the first, so that following its
decisions from the first turn yields, of all cheapest repairs, the one whose edit letters come
first. Rows are partitioned by conversation and sorted by turn; the costs of the four states travel
across Arrow batches, and a turn leaves one byte of decisions. Conversations longer than what a
task holds write these bytes in blocks to the shared folder, and a second stream, sorted the other
way, follows them. So a task holds a bounded part of any conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.base import query, stored, table

#: A conversation beyond these is not held, its decisions are written.
HELD_ROWS = 4096
HELD_CHARS = 8_000_000
#: Decisions of a written block.
BLOCK_ROWS = 65_536
#: Rows of an output batch.
BATCH_ROWS = 4096

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The order of the letters decides ties.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COST_DELETE, COST_INSERT, COST_REROLE, COST_TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant. The turn that each asks for, and where it leads.
ASKED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
KEPT_TO = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost of the turns that are missing at the end.
AT_END = (0, 2 * COST_INSERT, COST_INSERT, 0)
LEGAL = frozenset({"su", "ua", "au"})

_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SCHEMA = (
    "_conv string, _no bigint, _told boolean, turn bigint, role string, text string, _again bigint, pointers binary, step bigint, edit string, "
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def decide(initial: str, must_go: bool, truncated: bool, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The decisions of a turn for the four states, two bits each, and the costs from here on,
    given the costs ``after`` the turn."""
    used = []
    for s in range(4):
        options = {DELETE: COST_DELETE + after[s]}
        if not must_go:
            options[REROLE] = COST_REROLE + truncated * COST_TRUNCATED + after[NEXT[s]]
            if initial in KEPT_TO[s]:
                options[KEEP] = truncated * COST_TRUNCATED + after[KEPT_TO[s][initial]]
        used.append(options)
    costs = [min(o.values()) for o in used]
    for s in (2, 3, 0, 1):  # an inserted turn leads to 2 or 3; two in a row come back with nothing gained
        costs[s] = min(costs[s], COST_INSERT + costs[NEXT[s]])
    byte = 0
    for s in range(4):
        used[s][INSERT] = COST_INSERT + costs[NEXT[s]]
        byte |= min(letter for letter, cost in used[s].items() if cost == costs[s]) << 2 * s
    return byte, tuple(costs)


class _Follow:
    """Follows decisions from the first turn on."""

    def __init__(self):
        self.state = 0

    def turn(self, byte: int, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        while True:
            letter = byte >> 2 * self.state & 3
            if letter == INSERT:
                yield self._ask()
                continue
            if letter == KEEP:
                yield KEEP, role, text
                self.state = KEPT_TO[self.state][role[:1]]
            elif letter == REROLE:
                yield REROLE, ASKED[self.state], text
                self.state = NEXT[self.state]
            else:
                yield DELETE, role, text
            return

    def _ask(self) -> tuple[int, str, str]:
        asked, self.state = ASKED[self.state], NEXT[self.state]
        return INSERT, asked, ""

    def end(self) -> Iterator[tuple[int, str, str]]:
        while AT_END[self.state]:
            yield self._ask()


class _Turns:
    """Output: a row for each edit."""

    def __init__(self, conv: str):
        self.conv, self.step = conv, 0

    def edits(self, made) -> Iterator[dict]:
        for letter, role, text in made:
            yield {"_conv": self.conv, "_no": -1, "step": self.step, "edit": LETTERS[letter], "role": role, "text": text}
            self.step += 1

    def end(self, report: dict) -> Iterator[dict]:
        return iter(())


class _Digest:
    """Output: a row for each conversation."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.digest, self.first = conv, [], hashlib.sha256(), True

    def edits(self, made) -> Iterator[dict]:
        for letter, role, text in made:
            self.audit.append(LETTERS[letter])
            if letter != DELETE:
                self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                self.first = False
        return iter(())

    def end(self, report: dict) -> Iterator[dict]:
        yield {"_conv": self.conv, "_no": -1, **report, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


class _Backward:
    """One conversation, read from its last turn to its first."""

    def __init__(self, conv: str, memo: dict, limits: tuple[int, int, int]):
        self.conv, self.memo, self.limits = conv, memo, limits
        self.after, self.base = AT_END, 0
        self.rows, self.chars, self.pointers, self.blocks = [], 0, bytearray(), 0
        self.counts = dict.fromkeys(_REPORT, 0)
        self.later = None
        self.low = self.high = self.last = None
        self.n_turns = 0

    def turn(self, told: bool, turn: int, role: str, text: str, again: int) -> Iterator[dict]:
        if told:
            if self.high is None:
                self.high = turn
            self.n_turns += turn != self.low
            self.low = turn
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if again > 1 else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.later is not None and initial + self.later not in LEGAL:
            self.counts["illegal"] += 1
        self.later = initial
        # The costs differ by a few units only, so few cases come up.
        case = (initial, fault, self.after)
        if case not in self.memo:
            byte, costs = decide(initial, fault in ("blank", "duplicate"), fault == "truncated", self.after)
            self.memo[case] = byte, tuple(c - costs[0] for c in costs), costs[0]
        byte, self.after, more = self.memo[case]
        self.base += more
        self.pointers.append(byte)
        self.last = (told, turn, role, text, again)
        if self.rows is not None:
            self.rows.append((role, text))
            self.chars += len(text)
            if len(self.rows) > self.limits[0] or self.chars > self.limits[1]:
                self.rows = None
        if self.rows is None and len(self.pointers) >= self.limits[2]:
            yield self._block({})

    def _block(self, report: dict) -> dict:
        told, turn, role, text, again = self.last
        out = {"_conv": self.conv, "_no": self.blocks, "_told": told, "turn": turn, "role": role, "text": text, "_again": again}
        out |= {"pointers": bytes(self.pointers[::-1]), **report}
        self.blocks, self.pointers = self.blocks + 1, bytearray()
        return out

    def end(self, sink) -> Iterator[dict]:
        report = dict(self.counts, cost=self.base + self.after[0])
        if self.high is not None:
            report["gaps"] = self.high - self.low + 1 - self.n_turns
        if self.rows is None:
            yield self._block(report)  # an empty one, where the last was just written
            return
        out, follow = sink(self.conv), _Follow()
        for byte, (role, text) in zip(reversed(self.pointers), reversed(self.rows)):
            yield from out.edits(follow.turn(byte, role, text))
        yield from out.edits(follow.end())
        yield from out.end(report)


class _Forward:
    """One conversation whose decisions were written: its blocks and rows from the first turn on."""

    def __init__(self, conv: str, sink):
        self.out, self.follow, self.pointers, self.report = sink(conv), _Follow(), deque(), {}

    def block(self, pointers: bytes, report: dict) -> None:
        self.pointers.extend(pointers)
        self.report = self.report or report

    def turn(self, role: str, text: str) -> Iterator[dict]:
        yield from self.out.edits(self.follow.turn(self.pointers.popleft(), role, text))

    def end(self) -> Iterator[dict]:
        yield from self.out.edits(self.follow.end())
        yield from self.out.end(self.report)


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def _frame(rows: list[dict]) -> pd.DataFrame:
    # Object columns: a NULL must not turn whole numbers into floats.
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLUMNS})


def _marked(rows: DataFrame, conv: str, gone: str | None) -> DataFrame:
    """The rows that the streams read, partitioned by conversation, with ``_again``: how often the
    role and text have come up so far. The window needs no shuffle of its own."""
    told = F.col("turn").isNotNull()
    read = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("_conv"),
        told.alias("_told"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))).alias("_gone"),
    )
    seen = Window.partitionBy("_conv", "_gone", "role", "text").orderBy("_told", "turn")
    return read.repartition("_conv").withColumn("_again", F.row_number().over(seen).cast("bigint"))


_ORDER = ["_told", "turn", "role", "text", "_again"]


def _repaired(conversations: DataFrame, sink, conv: str, gone: str | None) -> DataFrame:
    limits = HELD_ROWS, HELD_CHARS, BLOCK_ROWS

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made():
            memo, now = {}, None
            for frame in frames:
                for conv, *turn, out in zip(*(frame[c].tolist() for c in ("_conv", *_ORDER, "_gone"))):
                    if now is None or now.conv != conv:
                        if now is not None:
                            yield from now.end(sink)
                        now = _Backward(conv, memo, limits)
                    if not out:
                        yield from now.turn(*turn)
            if now is not None:
                yield from now.end(sink)

        return _frames(made())

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made():
            now, name = None, None
            for frame in frames:
                for conv, no, role, text, pointers, *numbers in zip(*(frame[c].tolist() for c in ("_conv", "_no", "role", "text", "pointers", *_REPORT))):
                    if now is None or name != conv:
                        if now is not None:
                            yield from now.end()
                        now, name = _Forward(conv, sink), conv
                    if no >= 0:
                        now.block(pointers, {} if pd.isna(numbers[-1]) else dict(zip(_REPORT, map(int, numbers))))
                    else:
                        yield from now.turn(role, text)
            if now is not None:
                yield from now.end()

        return _frames(made())

    marked = _marked(conversations, conv, gone)
    down = marked.sortWithinPartitions("_conv", *(F.col(c).desc() for c in _ORDER))
    first = stored(down.mapInPandas(backward, _SCHEMA), "turn-repairs")
    whole = first.filter(F.col("_no") < 0)
    blocks = first.filter(F.col("_no") >= 0).select("_conv", "_no", *_ORDER, "pointers", *_REPORT)
    if not blocks.isEmpty():
        none = [F.lit(None).cast("binary").alias("pointers"), *(F.lit(None).cast("bigint").alias(c) for c in _REPORT)]
        rows = marked.filter(~F.col("_gone")).join(blocks.select("_conv").distinct(), "_conv", "left_semi").select("_conv", F.lit(-1).cast("bigint").alias("_no"), *_ORDER, *none)
        # A block carries the order of its first turn and comes before it.
        up = rows.unionByName(blocks).repartition("_conv").sortWithinPartitions("_conv", *_ORDER, F.col("_no").desc())
        whole = whole.unionByName(up.mapInPandas(forward, _SCHEMA))
    kind = conversations.schema[conv].dataType
    return whole.withColumn(conv, F.when(F.col("_conv") != "", F.expr("substring(_conv, 2)")).cast(kind))


def repaired_turns(conversations: DataFrame, conv: str = "conv_id", gone: str | None = None) -> DataFrame:
    """A row per edit, ``conv, step, edit, role, text``: the repaired conversation is its rows in
    order of ``step`` without those whose ``edit`` is D, which are the deleted turns.

    Turns go by number, NULL first, then by role and text. A NULL role or text counts as one
    space, so such a turn is blank or of no known role; a NULL conversation id is a
    conversation. Repeated rows are duplicates and leave. ``gone`` names a column that marks
    rows as missing. An empty table and a conversation without a turn give no row. Texts may
    have any length; a task holds those of one Arrow batch and of one short conversation.
    """
    return _repaired(conversations, _Turns, conv, gone).select(conv, "step", "edit", "role", "text")


def repair_report(conversations: DataFrame, conv: str = "conv_id", gone: str | None = None) -> DataFrame:
    """A row per conversation: its faults, the cost of the repair, the letters of the edits in
    order and the digest of the repaired turns (``role:text``, joined by line breaks).

    Edge cases are those of ``repaired_turns``; a conversation whose rows are all ``gone``
    has zeros, no letters and the digest of an empty text.
    """
    return _repaired(conversations, _Digest, conv, gone).select(conv, *_REPORT, "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of their place: lost (``gone``), emptied, without stops, repeated, all users."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    return (
        conversations.withColumn("_hit", F.crc32(place) % 20)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_hit") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            (F.col("_hit") == 0).alias("gone"),
            F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _sql() -> str:
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
    legal = ", ".join(f"'{x}'" for x in sorted(LEGAL))

    def kept(s: int) -> str:
        return "CASE " + " ".join(f"WHEN o.a = '{r}' THEN t + g{to}" for r, to in KEPT_TO[s].items()) + " ELSE 999999999 END"

    def at(s: int, expr: str) -> str:
        return f"CASE s WHEN 0 THEN {expr.format(0)} WHEN 1 THEN {expr.format(1)} WHEN 2 THEN {expr.format(2)} ELSE {expr.format(3)} END"

    d = ", ".join(f"{COST_DELETE} + g{s} AS d{s}, CASE WHEN gone THEN 999999999 ELSE {kept(s)} END AS k{s}, CASE WHEN gone THEN 999999999 ELSE {COST_REROLE} + t + g{NEXT[s]} END AS r{s}" for s in range(4))
    h = ", ".join(f"least(d{s}, k{s}, r{s}) AS h{s}" for s in range(4))
    low = {s: f"least(h{s}, {COST_INSERT} + h{NEXT[s]})" for s in (2, 3)} | {s: f"least(h{s}, {COST_INSERT} + h2, {2 * COST_INSERT} + h3)" for s in (0, 1)}
    best = ", ".join(f"{low[s]} AS m{s}" for s in range(4))
    letter = ", ".join(f"CASE WHEN d{s} = m{s} THEN 'D' WHEN {COST_INSERT} + m{NEXT[s]} = m{s} THEN 'I' WHEN k{s} = m{s} THEN 'K' ELSE 'R' END AS p{s}" for s in range(4))
    keep_to = "CASE WHEN a = 's' THEN 1 WHEN a = 'u' THEN 2 ELSE 3 END"
    asked = "CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END"
    after = "CASE WHEN s = 2 THEN 3 ELSE 2 END"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
hit AS (SELECT *, {crc} % 20 AS hit FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE hit <> 0),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM counted),
faults AS (
  SELECT *, substr(role, 1, 1) AS a, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
marked AS MATERIALIZED (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {COST_TRUNCATED} ELSE 0 END AS t,
    lead(a) OVER (PARTITION BY conv_id ORDER BY i) AS next_a FROM faults),
back AS (
  SELECT DISTINCT conv_id, n + 1 AS i, n, '' AS role, '' AS text, '' AS own, {', '.join(f'{c} AS g{s}' for s, c in enumerate(AT_END))}, {', '.join(f"'{'I' if c else '.'}' AS p{s}" for s, c in enumerate(AT_END))} FROM marked
  UNION ALL
  SELECT conv_id, i, n, role, text, a, m0, m1, m2, m3, {letter} FROM (
    SELECT *, {best} FROM (SELECT *, {h} FROM (
      SELECT o.conv_id, o.i, o.n, o.role, o.text, o.a, {d}
      FROM back JOIN marked AS o ON o.conv_id IS NOT DISTINCT FROM back.conv_id AND o.i = back.i - 1)))),
plan AS MATERIALIZED (SELECT * FROM back),
walk AS (
  SELECT conv_id, i, 0 AS s, '' AS audit, '' AS body FROM plan WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN s WHEN 'K' THEN {keep_to} ELSE {after} END, audit || letter,
    CASE letter WHEN 'D' THEN body WHEN 'K' THEN concat(body, chr(10), role, ':', text) WHEN 'R' THEN concat(body, chr(10), {asked}, ':', text)
      ELSE concat(body, chr(10), {asked}, ':') END
  FROM (SELECT w.*, p.role, p.text, p.own AS a, {at(0, 'p{0}')} AS letter FROM walk AS w JOIN plan AS p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i)
  WHERE letter <> '.'),
ended AS (SELECT w.conv_id, w.audit, w.body FROM walk AS w JOIN plan AS p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i AND p.n + 1 = p.i WHERE w.s IN (0, 3)),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_a IS NOT NULL AND concat(a, next_a) NOT IN ({legal})) AS illegal FROM marked GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(p.g0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN plan AS p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = 1"""


@query("op12_conversation_repair", _sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_report(damaged(table(spark, sf_dir, "conversations")), gone="gone")
