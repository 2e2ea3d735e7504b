"""Conversation repair against plain strings, exhaustive search and SQL over odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import conversation_repair as c


def row_faults(rows):
    """(blank, seen, truncated) of (role, text) in order."""
    out, known = [], set()
    for role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((not signs, (role, text) in known, bool(signs) and signs[-1] not in ".!?"))
        known.add((role, text))
    return out


def plain(rows):
    """The cheapest (cost, audit, lines) with whole strings, one for each last role."""
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(4):
            for last, (cost, audit, lines) in list(best.items()):
                to = "a" if last == "u" else "u"
                new = (cost + 5, audit + "I", (*lines, ("user:" if to == "u" else "assistant:")))
                best[to] = min(best.get(to, new), new)
        return best

    best = inserts(best)
    for (role, text), (blank, seen, truncated) in zip(rows, row_faults(rows), strict=True):
        new = {}
        for last, (cost, audit, lines) in best.items():
            ways = [(last, 2, "D", ())]
            if not (blank or seen):
                to = "a" if last == "u" else "u"
                ways.append((to, 1 + 5 * truncated, "R", (("user:" if to == "u" else "assistant:") + text,)))
                if role and last + role[:1] in ("s", "u", "su", "ua", "au"):
                    ways.append((role[:1], 5 * truncated, "K", (f"{role}:{text}",)))
            for to, more, letter, line in ways:
                one = (cost + more, audit + letter, lines + line)
                new[to] = min(new.get(to, one), one)
        best = inserts(new)
    return min(best[x] for x in ("", "a") if x in best)


def searched(rows):
    """The same by trying every sequence of edits with at most two inserts between rows."""
    marks = row_faults(rows)
    found = []
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any((b or s) and x != "D" for x, (b, s, _) in zip(letters, marks, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, last, lines, good = 0, "", "", [], True
            for i in range(len(rows) + 1):
                for _ in range(gaps[i]):
                    last = "a" if last == "u" else "u"
                    cost, audit = cost + 5, audit + "I"
                    lines.append("user:" if last == "u" else "assistant:")
                if i == len(rows):
                    break
                role, text = rows[i]
                audit += letters[i]
                if letters[i] == "D":
                    cost += 2
                    continue
                cost += 5 * marks[i][2] + (letters[i] == "R")
                to = ("a" if last == "u" else "u") if letters[i] == "R" else role[:1]
                good &= last + to in ("s", "u", "su", "ua", "au")
                last = to
                lines.append(f"{role}:{text}" if letters[i] == "K" else ("user:" if to == "u" else "assistant:") + text)
            if good and last in ("", "a"):
                found.append((cost, audit, tuple(lines)))
    return min(found)


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b!", "c", "", " ", "d?", "e", "f."])), max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["a.", "b", "", "d?"])), max_size=4))
def test_the_plain_program_is_exhaustive_search(rows):
    assert plain(rows) == searched(rows)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.lists(st.integers(0, 40), max_size=5))
def test_linked_audits_are_those_of_plain_strings(rows, cuts):
    whole, known = c.Whole(), set()
    bounds = sorted({0, len(rows), *(x for x in cuts if x < len(rows))})
    for a, b in itertools.pairwise(bounds):
        stretch = c.Stretch()
        for k in range(a, b):
            blank, seen, truncated = row_faults(rows)[k]
            stretch.add(k, rows[k][0][:1], 1, blank, truncated, seen)
        whole.add(stretch.told())
    got = whole.done()
    cost, audit, lines = plain(rows)
    assert (got["cost"], got["audit"]) == (cost, audit)
    written = c.Repaired(audit)
    for role, text in rows:
        written.rows(role, text, 1)
    assert written.digest() == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_hashes_that_collide_change_nothing(rows):
    honest = c._BASE
    c._BASE = 0  # a hash is then its last letter
    try:
        test_linked_audits_are_those_of_plain_strings.hypothesis.inner_test(rows, [3, 9, 20])
    finally:
        c._BASE = honest


def test_long_audits_compare_at_their_first_difference():
    root = c.Node(None, "")
    x = y = root
    for k in range(5000):
        x = c.Node(x, "K")
        y = c.Node(y, "D" if k == 3000 else "K")
    assert c.common_prefix(x, y) == 3000 and c.less(y, x) and not c.less(x, y) and not c.less(x, x)
    assert c.common_prefix(c.Node(x, "R"), x) == 5000 and c.less(x, c.Node(x, "R"))
    assert x.letter(2999) == "K" and y.letter(3000) == "D" and len(x.text()) == 5000


def expected(rows, ids):
    """Whole results from (conv, turn, role, text) after damage."""
    out = {}
    for conv in ids:
        mine = [(t, r if r is not None else " ", x if x is not None else " ") for v, t, r, x in rows if v == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: c.LEAD].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        pairs = [(r, x) for _, r, x in mine]
        marks = row_faults(pairs)
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit, lines = plain(pairs)
        first = [1 if b else 2 if s else 3 if t else 0 for b, s, t in marks]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, first.count(1), first.count(2), first.count(3),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


ODD = [
    (None, None, None, None), (None, 3, "user", "x."), (None, 3, "user", "x."), (1, None, "assistant", "late"), (1, 0, "user", "q?"), (1, 0, "user", "q?"),
    (1, 7, "assistant", "a."), (2, 5, "", ""), (3, 1, "system", "be kind."), (3, 2, "user", "hello"), (3, 9, "tool", "r!"), (3, 9, "assistant", "\x1f"),
    (4, 1, "Ünicode", "é" * 40 + "b."), (4, 1, "Ünicode", "é" * 40 + "a."), (4, -4, "supervisor", "s."), (4, 1, "user", "u."), (4, 2, "assistant", "a.\n\t "),
]
LONG = [(9, k // 3, ("user", "assistant", "user", "system")[k % 4], f"t{k % 57}" + ".!x"[k % 3]) for k in range(400)] + [(9, 5, "user", "again.")] * 50


@pytest.mark.parametrize("block", [2048, 7])
def test_odd_and_long_conversations(spark, block):
    rows = ODD + LONG
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv long, turn long, role string, text string, kind string")
    ids = spark.createDataFrame([(r[0],) for r in rows] + [(77,)], "conv long")
    got = {r["conv"]: tuple(r)[1:] for r in c.repair(frame, ids, block).collect()}
    assert got == expected(rows, {r[0] for r in rows} | {77})


def test_damage_and_sql_agree_on_odd_rows(spark, tmp_path):
    rows = ODD + LONG[::9]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    after = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text or " ") if what == 2 else text
        after += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    want = {k: (k, *v) for k, v in expected(after, {r[0] for r in rows}).items()}
    got = c.op11_conversation_repair(spark, str(tmp_path))
    assert {r["conv_id"]: tuple(r) for r in got.collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    told = con.sql(c.OP11_SQL)
    assert told.columns == got.columns
    assert {r[0]: r for r in told.fetchall()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert c.repair(none, none).count() == 0
