"""Broken JSON: what was valid stays, every cut parses, and slips are mended as said."""

from __future__ import annotations

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions.json_repair import repair, repaired_json

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_valid_json_stays(value, indent, ascii_):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_)
    assert repair(text) == text


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=6), VALUES, max_size=4) | st.lists(VALUES, max_size=4), st.sampled_from([None, 1]))
def test_every_cut_parses(value, indent):
    text = json.dumps(value, indent=indent)
    for k in range(1, len(text) + 1):
        assert isinstance(json.loads(repair(text[:k])), type(value))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=6), VALUES, min_size=1, max_size=4))
def test_fences_trailing_commas_and_missing_ends(value):
    text = json.dumps(value)
    for slip in (f"Here:\n```json\n{text}\n```\nDone.", f"{text[:-1]},}}", text[:-1], f"{text} and more"):
        assert json.loads(repair(slip)) == value


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:\\\'u0 1a\n“”tn-e.', max_size=30))
def test_whatever_comes_out_is_json_or_nothing(text):
    got = repair(text)
    assert (got is None) == (not any(c in text for c in "{[") and got is None)
    if got is not None:
        json.loads(got)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("", None), ("no json", None), (None, None), ("{'a': 'it is', b: True, c: None}", {"a": "it is", "b": True, "c": None}),
        ('{"a": 1 "b": 2, , "c": [1 2,3,]', {"a": 1, "b": 2, "c": [1, 2, 3]}), ('{"a":, "b": }', {"a": None, "b": None}), ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}),
        ('{"a": [1, 2}, "b": 3}', {"a": [1, 2]}), ('{"a": "he said "hi" to me"}', {"a": 'he said "hi" to me'}), ('{"a": "x\ny"}', {"a": "x\ny"}),
        ("{“a”: “b”}", {"a": "b"}), ('{"a": NaN}', {"a": None}), ('{"a": tru', {"a": True}), ('{"a": 12.', {"a": 12}), ('{"a": -', {"a": None}), ('{"a": "x\\', {"a": "x"}),
        ('{"a": "\\q\\u00e9"}', {"a": "qé"}), ('{"a": 1, "b"', {"a": 1}), ("[1, 2", [1, 2]), ("]{}", {}), ('{"a": 007}', {"a": "007"}), ("{1: 2}", {"1": 2}),
    ],
)
def test_slips(text, value):
    got = repair(text)
    assert (None if got is None else json.loads(got)) == value


@pytest.mark.parametrize("unit", ["[", '{"a":', '"', "'", "\\", '" ', "[}", "{]", "a,", '{"a" "b" ', "“"])
def test_work_grows_with_the_text(unit):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        repair("[" + unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_column(spark):
    rows = spark.createDataFrame([("{'a': 1",), (None,), ("x",), ('{"a": 1}',)], "t string")
    assert [r[0] for r in rows.select(repaired_json(rows["t"])).collect()] == ['{"a": 1}', None, None, '{"a": 1}']
