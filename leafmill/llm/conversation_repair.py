"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

Rows of a conversation stand in order of turn (nulls first); rows of one turn by role, then by text (its first 32 code
points, then its hash).  Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty user or assistant row
5; a truncated row that stays costs 5 more; blank and repeated rows must go.  The *audit* is the string of the edits'
initials.  Of cheapest audits the least in ASCII order counts.

The dynamic program keeps one audit for each state (nothing yet, after s, after u, after a).  Audits are *persistent*:
an edit is a node linked to the one before it, so audits share their beginnings.  A node knows its ancestors 1, 2, 4, ...
steps back, its length and a rolling hash of its audit.  Two audits of equal cost are compared at their longest common
prefix, found by halving over lengths: the hash of a prefix is read off an ancestor.  Prefixes whose hashes agree are
verified letter by letter back to a node that both share; if they differ, the place found by the letters counts.

At scale: equal rows are counted before anything is shuffled, and all are dealt by ranges of (conversation, turn, role,
text), so a long conversation lies in several tasks.  Each task turns every stretch of at most ``BLOCK`` rows of a
conversation into the cheapest audits from each state to each state (without texts).  One pass over a conversation then
joins the audits of its stretches, again as linked nodes, and streams its texts into the hash of the repaired
conversation.  What that pass holds is the audit, a letter a row, which is a column of the result; a hash of a whole
conversation can only be made in order, so that pass is one task for each conversation, of bounded memory for texts.

Null texts and roles become one space.  Null ids are one conversation, null turns stand first.  Repeated rows are
repeated rows of a conversation (the later ones must go).  Conversations without rows give zeros, an empty audit and the
hash of the empty string.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import in_job, materialize, read_table, ship_code

BLOCK = 2_048
#: Code points of a text that its place among rows of one turn depends on, before its hash.
LEAD = 32
_PRIME, _BASE = (1 << 61) - 1, 911_382_323
_SIGN = r"[^\x20\x09-\x0D]"
#: States: nothing yet, after s, after u, after a.  Which state an inserted or reroled row leads to.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


class Node:
    """An audit: that of ``back[0]`` and then ``piece``."""

    __slots__ = ("back", "hash", "length", "piece")

    def __init__(self, before: Node | None, piece: str, hash_: int | None = None) -> None:
        self.piece = piece
        if before is None:
            self.back, self.length, self.hash = [], len(piece), hashed(piece) if hash_ is None else hash_
            return
        self.length = before.length + len(piece)
        self.hash = (before.hash * pow(_BASE, len(piece), _PRIME) + (hashed(piece) if hash_ is None else hash_)) % _PRIME
        back = [before]
        k = 0
        while k < len(back[k].back):
            back.append(back[k].back[k])
            k += 1
        self.back = back

    def text(self) -> str:
        parts, node = [], self
        while node is not None:
            parts.append(node.piece)
            node = node.back[0] if node.back else None
        return "".join(reversed(parts))

    def reaching(self, length: int) -> Node:
        """The first node from the start whose audit has ``length`` letters or more."""
        node = self
        for k in reversed(range(len(node.back))):
            while k < len(node.back) and node.back[k].length >= length:
                node = node.back[k]
        return node

    def letter(self, place: int) -> str:
        node = self.reaching(place + 1)
        return node.piece[place - (node.length - len(node.piece))]

    def prefix_hash(self, length: int) -> int:
        node = self.reaching(length)
        if node.length == length:
            return node.hash
        part = node.piece[: length - (node.length - len(node.piece))]
        before = node.back[0].hash if node.back else 0
        return (before * pow(_BASE, len(part), _PRIME) + hashed(part)) % _PRIME


def hashed(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _BASE + ord(c)) % _PRIME
    return h


def common_prefix(x: Node, y: Node) -> int:
    """Length of the longest common prefix of two audits."""
    low, high = 0, min(x.length, y.length)
    while low < high:
        middle = (low + high + 1) // 2
        if x.prefix_hash(middle) == y.prefix_hash(middle):
            low = middle
        else:
            high = middle - 1
    return _verified(x, y, low)


def _verified(x: Node, y: Node, length: int) -> int:
    """``length``, or the first place before it where the letters differ although the hashes don't."""
    place, p, q = length, x.reaching(length), y.reaching(length)
    wrong = None
    while place > 0 and not (p is q):
        at, bt = p.length - len(p.piece), q.length - len(q.piece)
        start = max(at, bt)
        a, b = p.piece[start - at : place - at], q.piece[start - bt : place - bt]
        if a != b:
            wrong = start + next(k for k in range(len(a)) if a[k] != b[k])
        place = start
        p = p.back[0] if p.back and at == start else p
        q = q.back[0] if q.back and bt == start else q
    return length if wrong is None else wrong


def less(x: Node, y: Node) -> bool:
    """Whether the audit of x stands before that of y in ASCII order."""
    if x is y:
        return False
    n = common_prefix(x, y)
    if n == x.length or n == y.length:
        return x.length < y.length
    return x.letter(n) < y.letter(n)


def better(one: tuple[int, Node] | None, other: tuple[int, Node] | None) -> tuple[int, Node] | None:
    """The cheaper of two (cost, audit), of equally cheap ones the one that stands first."""
    if one is None or other is None:
        return one or other
    if one[0] != other[0]:
        return one if one[0] < other[0] else other
    return other if less(other[1], one[1]) else one


class Repair:
    """The cheapest audits from one state to every state, after the rows seen so far."""

    def __init__(self, state: int) -> None:
        self.best: list[tuple[int, Node] | None] = [None] * 4
        self.best[state] = (0, Node(None, ""))
        self._insert()

    def _insert(self) -> None:
        """Inserts before the next row; more than two in a run come back to a state that was cheaper before."""
        for _ in range(2):
            before = list(self.best)
            for state, one in enumerate(before):
                if one is not None:
                    to = _NEXT[state]
                    cost = one[0] + 5
                    if self.best[to] is None or cost <= self.best[to][0]:
                        self.best[to] = better(self.best[to], (cost, Node(one[1], "I")))

    def delete(self, n: int) -> None:
        """n rows that must go; an insert among them is dearer in ASCII order than behind them."""
        self.best = [one and (one[0] + 2 * n, Node(one[1], "D" * n)) for one in self.best]
        self._insert()

    def row(self, initial: str, truncated: bool) -> None:
        new: list[tuple[int, Node] | None] = [None] * 4
        stays = 5 if truncated else 0
        for state, one in enumerate(self.best):
            if one is None:
                continue
            cost, node = one
            steps = [(state, 2, "D"), (_NEXT[state], 1 + stays, "R")]
            kept = _KEEP.get((state, initial))
            if kept is not None:
                steps.append((kept, stays, "K"))
            for to, more, letter in steps:
                if new[to] is None or cost + more <= new[to][0]:
                    new[to] = better(new[to], (cost + more, Node(node, letter)))
        self.best = new
        self._insert()


class Stretch:
    """Neighbouring rows of one conversation."""

    def __init__(self) -> None:
        self.repairs = [Repair(s) for s in range(4)]
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn, initial: str, n: int, blank: bool, truncated: bool, seen: bool) -> None:
        """n equal rows; ``seen`` says that their role and text came earlier."""
        rest = n if blank or seen else n - 1
        self.illegal += (self.last is not None and self.last + initial not in ("su", "ua", "au")) + n - 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else rest
        if n > rest:
            self.truncated += truncated
        for r in self.repairs:
            if n > rest:
                r.row(initial, truncated)
            if rest:
                r.delete(rest)
        self.rows += 1

    def told(self) -> dict:
        cells = [
            {"start": s, "end": e, "cost": one[0], "audit": one[1].text()}
            for s, r in enumerate(self.repairs) for e, one in enumerate(r.best) if one is not None
        ]
        names = ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")
        return {x: getattr(self, x) for x in names} | {"cells": cells}


class Whole:
    """A conversation put together from its stretches."""

    def __init__(self) -> None:
        self.best: list[tuple[int, Node] | None] = [(0, Node(None, "")), None, None, None]
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last = self.low = self.high = None

    def add(self, x: dict) -> None:
        for k in self.sums:
            self.sums[k] += x[k]
        self.sums["illegal"] += self.last is not None and self.last + x["first"] not in ("su", "ua", "au")
        self.last = x["last"]
        if x["low"] is not None:
            self.sums["turns"] -= self.high == x["low"]
            self.low = x["low"] if self.low is None else self.low
            self.high = x["high"]
        new: list[tuple[int, Node] | None] = [None] * 4
        hashes = [hashed(c["audit"]) for c in x["cells"]]
        for c, h in zip(x["cells"], hashes, strict=True):
            one = self.best[c["start"]]
            if one is not None:
                new[c["end"]] = better(new[c["end"]], (one[0] + c["cost"], Node(one[1], c["audit"], h)))
        self.best = new

    def done(self) -> dict:
        one = better(self.best[EMPTY], self.best[ASSISTANT])
        gaps = self.high - self.low + 1 - self.sums["turns"] if self.low is not None else 0
        faults = {k: v for k, v in self.sums.items() if k != "turns"}
        return {"gaps": gaps} | faults | {"cost": one[0], "audit": one[1].text()}


class Repaired:
    """The repaired rows of a conversation in order, as ``role:text`` lines of a hash."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, EMPTY, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._turned("")
            self.at += 1

    def _turned(self, text: str) -> None:
        self.state = _NEXT[self.state]
        self._line("user" if self.state == USER else "assistant", text)

    def rows(self, role: str, text: str, n: int) -> None:
        """n equal rows: only the first of them may stay."""
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._turned(text)
        elif edit == "K":
            self.state = _KEEP[self.state, role[:1]]
            self._line(role, text)
        for _ in range(n - 1):
            self._inserted()
            self.at += 1

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by the checksum of ``conv:turn``, for tests and the query."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), what.alias("what"))
    told = told.where("what <> 0").select(
        "conv", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("what") == 3, 2).otherwise(1).alias("times"),
    )
    return told.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


_SUMMARY = {
    "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "turns": "long", "first": "string", "last": "string",
    "low": "long", "high": "long", "cells": "array<struct<start: int, end: int, cost: long, audit: string>>",
}
_ORDER = [F.asc_nulls_first, F.asc_nulls_first, F.asc, F.asc, F.asc]


def repair(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every id of ``ids`` (conv) or of ``rows`` (conv, turn, role, text): faults, cost, audit and the hash
    of the repaired conversation."""
    session = rows.sparkSession
    ship_code(session)
    kind = rows.schema["conv"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    equal = rows.select("conv", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    equal = equal.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumns({"lead": F.left("text", F.lit(LEAD)), "mark": F.sha2("text", 256)})
    equal = materialize(equal, "turns")
    ends = F.regexp_extract("text", rf"(?s)({_SIGN})[\x20\x09-\x0D]*\z", 1)
    slim = equal.select(
        "conv", "turn", "role", "lead", "mark", "n", (~F.col("text").rlike(_SIGN)).alias("blank"), (~ends.rlike("[.!?]")).alias("truncated"),
        F.lit(1).alias("kind"),
    )
    # Where role and text come first in a conversation; beside that row, this marker sorts before it.
    null_first = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = equal.groupBy("conv", "role", "lead", "mark").agg(F.min(null_first).alias("at"))
    none = {"n": F.lit(0).cast("long"), "blank": F.lit(False), "truncated": F.lit(False), "kind": F.lit(0)}
    firsts = firsts.withColumn("turn", F.col("at.turn")).withColumns(none).select(slim.columns)
    keys = [f(c) for f, c in zip(_ORDER, ("conv", "turn", "role", "lead", "mark"), strict=True)]
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.unionByName(firsts).repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "kind")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        now, held, first = None, None, None
        out: list[dict] = []
        schema = None

        def close() -> None:
            nonlocal held, number
            if held is not None and held.rows:
                out.append({"conv": now, "part": part, "number": number} | held.told())
                number += 1
            held = None

        for batch in batches:
            schema = schema or _schema(batch.schema.field("conv").type)
            for conv, turn, role, lead, mark, n, blank, truncated, which in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv != now or held.rows >= block:
                    close()
                    now, held = conv, Stretch()
                if which == 0:
                    first = (conv, turn, role, lead, mark)
                else:
                    held.add(turn, role[:1], n, blank, truncated, first != (conv, turn, role, lead, mark))
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    told = dealt.mapInArrow(stretches, f"conv {kind}, part int, number int, " + ", ".join(f"{c} {k}" for c, k in _SUMMARY.items()))
    empty = F.lit(None)
    texts = {"turn": "long", "role": "string", "text": "string", "lead": "string", "mark": "string", "n": "long"}
    told = told.select("conv", F.lit(1).alias("kind"), "part", "number", F.struct(*_SUMMARY).alias("told"), *(empty.cast(k).alias(c) for c, k in texts.items()))
    shape = told.schema["told"].dataType
    bare = {"part": empty.cast("int"), "number": empty.cast("int"), "told": empty.cast(shape)}
    known = ids.select("conv").distinct().withColumns({"kind": F.lit(0), **bare, **{c: empty.cast(k) for c, k in texts.items()}}).select(told.columns)
    lines = equal.withColumns({"kind": F.lit(2), **bare}).select(told.columns)
    order = [F.asc_nulls_first("conv"), F.asc("kind"), F.asc("part"), F.asc("number"), *(f(c) for f, c in zip(_ORDER[1:], ("turn", "role", "lead", "mark"), strict=True))]
    every = known.unionByName(told).unionByName(lines).repartition(parts, "conv").sortWithinPartitions(*order)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_, held, done, lines = None, False, None, None, None
        out: list[dict] = []
        schema = None

        def close() -> None:
            if any_:
                finished = done or held.done()
                out.append({"conv": now, **finished, "repaired_sha256": (lines or Repaired(finished["audit"])).digest()})

        for batch in batches:
            schema = schema or pa.schema([
                ("conv", batch.schema.field("conv").type), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                ("audit", pa.string()), ("repaired_sha256", pa.string()),
            ])
            columns = (batch.column(c) for c in ("conv", "kind", "told", "role", "text", "n"))
            for conv, which, told_, role, text, n in zip(*columns, strict=True):
                conv, which = conv.as_py(), which.as_py()
                if not any_ or conv != now:
                    close()
                    now, any_, held, done, lines = conv, True, Whole(), None, None
                if which == 1:
                    held.add(told_.as_py())
                elif which == 2:
                    if lines is None:
                        done = held.done()
                        lines = Repaired(done["audit"])
                    lines.rows(role.as_py(), text.as_py(), n.as_py())
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return every.mapInArrow(whole, f"conv {kind}, {counts}, audit string, repaired_sha256 string")


def _schema(conv: pa.DataType) -> pa.Schema:
    cell = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema([
        ("conv", conv), ("part", pa.int32()), ("number", pa.int32()),
        *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")),
        ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("cells", pa.list_(cell)),
    ])


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations")
    ids = given.select(F.col("conv_id").alias("conv"))
    return in_job("conversations", lambda: repair(damaged(given), ids).withColumnRenamed("conv", "conv_id"))


def _plus(one: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {one} IS NOT NULL THEN {{'c': {one}.c + {cost}, 'x': {one}.x || '{letter}', 't': {one}.t || {line}}} END"


def _least(*ones: str) -> str:
    return f"list_aggregate([{', '.join(ones)}], 'min')"


_LINE = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}


def _inserted(table: str) -> str:
    """The states after at most one insert."""
    user = _least("u", *(_plus(x, "5", "I", _LINE["u"]) for x in "esa"))
    return f"(SELECT * REPLACE ({user} AS u, {_least('a', _plus('u', '5', 'I', _LINE['a']))} AS a) FROM {table})"


def _stepped() -> str:
    """The states after one row: r.role, r.text, r.must (delete) and r.stays (5 if truncated)."""
    cut = {x: _plus(x, "2", "D", "''") for x in "esua"}
    keep = lambda x, initial: f"CASE WHEN NOT must AND left(role, 1) = '{initial}' THEN {_plus(x, 'stays', 'K', 'chr(10) || role || chr(58) || text')} END"
    turn = lambda x, to: f"CASE WHEN NOT must THEN {_plus(x, '1 + stays', 'R', _LINE[to] + ' || text')} END"
    user = [cut["u"], *(keep(x, "u") for x in "esa"), *(turn(x, "u") for x in "esa")]
    return f"""SELECT conv_id, i, {cut["e"]} AS e, {_least(cut["s"], keep("e", "s"))} AS s, {_least(*user)} AS u,
    {_least(cut["a"], keep("u", "a"), turn("u", "a"))} AS a"""


_STATE = "STRUCT(c BIGINT, x VARCHAR, t VARCHAR)"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""
OP11_SQL = rf"""
WITH RECURSIVE w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS w FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN w = 1 THEN '' WHEN w = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN w = 3 THEN [1, 2] ELSE [1] END) AS k
  FROM w WHERE w <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {LEAD}), sha256(text), k) AS i FROM d),
m AS (
  SELECT *, NOT regexp_matches(text, '{_SIGN}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(regexp_extract(text, '(?s)({_SIGN})[ 	-
]*$', 1), '[.!?]') AS cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM o
), r AS (SELECT conv_id, i, role, text, blank OR seen AS must, CASE WHEN cut THEN 5 ELSE 0 END AS stays FROM m),
p(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'x': '', 't': ''}}::{_STATE}, NULL::{_STATE}, {{'c': 5, 'x': 'I', 't': chr(10) || 'user:'}}::{_STATE},
    {{'c': 10, 'x': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}::{_STATE} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, e, s, u, a FROM {_inserted(_inserted(f"({_stepped()} FROM (SELECT p.conv_id, r.i, e, s, u, a, role, text, must, stays FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))"))}
), z AS (SELECT conv_id, {_least("e", "a")} AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND seen) AS duplicate,
    count_if(NOT blank AND NOT seen AND cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY 1
)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.x AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""
