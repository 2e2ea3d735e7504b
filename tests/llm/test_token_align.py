"""Cross-tokenizer alignment against the two libraries and plain Python."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import token_align as t

A, B = t.paths()
LETTERS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in LETTERS)}
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "<|endoftext|> and <s> </s> <unk>", "é́ ünï 漢字 🙂🙂", "tab\tline\n\nend\r\n", "\x00\x01",
    "▁ x▁▁y", "the same the same the same", "  x", "ﬁ ligature ½", "word " * 300, "x" * 3000, "end of sentence.\n" * 40,
]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        left = [bytes(LETTERS[c] for c in self.a.id_to_token(i)) for i in a]
        right = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        raw = b" " + text.encode()
        if b"".join(left) != raw or b"".join(right) != raw:
            return [], []
        return list(zip(a, np.cumsum([len(x) for x in left]), strict=True)), list(zip(b, np.cumsum([len(x) for x in right]), strict=True))


def expected(texts):
    plain = Plain()
    rows, counts = [], Counter()
    for text in texts:
        a, b = plain.tokens(text)
        ends = {}
        for j, f in b:
            ends.setdefault(int(f), []).append(j)
        links = [(i, j) for i, e in a for j in ends.get(int(e), ())]
        counts.update(links)
        cuts = sorted({int(e) for _, e in a} & set(ends))
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            for i, e in tokens:
                groups[bisect_left(cuts, e)][side].append(str(i))
        rows.append((len(a), len(b), groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for n_a, n_b, groups, links in rows:
        told = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        out.append((
            n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(told.encode()).hexdigest() if told else "",
        ))
    return out


@pytest.mark.parametrize("most_frequent", [500_000, 50, 1])
def test_alignment_is_that_of_plain_python(spark, sf, most_frequent):
    some = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts = TEXTS + some + TEXTS
    rows = [(i if i % 7 else None, x, i, "x") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, pairs string")
    got = t.with_counts(t.align(docs, A, B), most_frequent=most_frequent).collect()
    want = expected(texts)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == sorted(
        (-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want, strict=True)
    )
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert t.with_counts(t.align(docs, A, B)).count() == 0


def test_long_texts_are_cut_where_no_piece_reaches_over(monkeypatch):
    side = t.Pieces(B)
    assert side.apart
    texts = [x * 20 for x in TEXTS if x] + ["ends with spaces   ", "a ", "ab  cd   ef ▁ gh "]
    whole = side.encode(texts)
    for size in (1, 2, 5, 17):
        monkeypatch.setattr(t, "STRETCH", size)
        for x, y in zip(whole, side.encode(texts), strict=True):
            assert np.array_equal(x, y)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60))), max_size=6), st.randoms())
def test_gallop_finds_the_first_place_not_smaller(lists, random):
    into, low, high, values, guess, want = [], [], [], [], [], []
    for shorter, longer in lists:
        start = len(into)
        into += sorted(longer)
        for x in sorted(shorter):
            values.append(x)
            low.append(start)
            high.append(len(into))
            guess.append(random.randint(start, max(start, len(into) - 1)))
            want.append(start + bisect_left(sorted(longer), x))
    arrays = (np.array(x, dtype=np.int64) for x in (values, into, low, high, guess))
    assert t.gallop(*arrays).tolist() == want


def test_overlaps_are_the_tokens_that_share_bytes():
    left, right = t.sides(A, B)
    texts = [x for x in TEXTS if x]
    found = t._encoded(texts, left, right)
    first, last = found.overlaps()
    for k in range(len(texts)):
        for i in range(found.a_at[k], found.a_at[k + 1]):
            x, y = found.a_ends[i] - left.lengths[found.a[i]], found.a_ends[i]
            shared = [j for j in range(found.b_at[k], found.b_at[k + 1]) if found.b_ends[j] > x and found.b_ends[j] - right.lengths[found.b[j]] < y]
            assert list(range(first[i], last[i])) == shared


def test_null_ids_and_rows_without_tokens(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (1, None)], "doc_id long, text string")
    got = t.with_counts(t.align(docs, A, B)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [tuple(r) for r in got] == [(x, 0, 0, 0, 0, 0, 0, "") for x in (None, None, 1)]
