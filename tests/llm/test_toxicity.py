"""Toxicity: folding against a plain-Python version, held-out recall on plain and disguised texts, odd input."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import folding, pu_toxicity, registry
from leafmill.llm.shingles import mix


def plain_words(text: str) -> set[bytes]:
    """The folded words of a text, character by character."""
    out = []
    for c in text:
        point = ord(c)
        if point == 0xAD or 0x300 <= point <= 0x36F or 0x200B <= point <= 0x200F:
            continue
        if 0xC0 <= point < 0x180:
            m = re.match(r"LATIN (SMALL|CAPITAL) (LETTER|LIGATURE) (\w)", unicodedata.name(c).replace("DOTLESS ", ""))
            out.append((c, m[3].lower() if m else " "))  # of its two bytes, the first goes
        elif 0x80 <= point < 0xC0 or 0x2000 <= point < 0x2040:
            out.append((c, " " * len(c.encode())))
        elif point >= 0x80:
            out.append((c, c))
        else:
            low = c.lower()
            out.append((c, folding.LOOK_ALIKE.get(low, low if low.isalnum() else " ")))
    keep = [
        x for k, (c, x) in enumerate(out)
        if not (c in folding.BETWEEN and 0 < k < len(out) - 1 and out[k - 1][1].strip() and out[k + 1][1].strip())
    ]
    joined = re.sub(r"(?<![^ ])[!-~](?: [!-~]){2,}(?![^ ])", lambda m: m[0].replace(" ", ""), "".join(keep))
    once = re.sub(r"([a-z0-9])\1+", r"\1", joined)
    return {w.encode() for w in once.split(" ") if w}


@given(st.lists(st.text("abA1@.-*é ß­́​ “日!\n", max_size=40) | st.none(), max_size=5))
@settings(max_examples=400, deadline=None)
def test_folded_words(texts):
    found = pu_toxicity.distinct_words(pa.array(texts, pa.string()))
    assert [set(x) for x in found] == [plain_words(t or "") for t in texts]


def test_disguises():
    told = ["idiot", "IDIOT", "i.d.i.o.t", "i d i o t", "1d10t", "iiidiooot", "ïdìøt", "i­di​ot", "id-iot", "¡idiot!"]
    assert all(x == [b"idiot"] for x in pu_toxicity.distinct_words(pa.array(told)))
    assert pu_toxicity.distinct_words(pa.array(["a b", "well-known book"])) == [[b"a", b"b"], [b"bok", b"welknown".replace(b"ll", b"l")]]


def test_scores_by_hand():
    rng = np.random.default_rng(1)
    model = pu_toxicity.Model(rng.normal(0, 0.5, 1 << folding.BITS).astype(np.float32), -2.0)
    texts = ["you are an idiot", None, "", " \n ", "idiot idiot", "idiot", "日本 é", "a"]
    got = pu_toxicity.text_scores(pa.array(texts), model)

    def margin(word: bytes) -> float:
        data = np.frombuffer(b" " + word + b" ", dtype=np.uint8)
        return model.bias + sum(model.weights[h].sum() for _, h in folding.pieces(data, np.array([1])))

    want = [sum(np.exp(min(margin(w), pu_toxicity.HIGHEST)) for w in plain_words(t or "")) for t in texts]
    assert np.allclose(got, [x / (1 + x) for x in want])
    assert got[4] == got[5] and list(got[1:4]) == [0, 0, 0]


def test_long_texts_in_stretches(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(20_000)) + "x" * 500
    model = pu_toxicity.Model(np.random.default_rng(1).normal(-1, 0.2, 1 << folding.BITS).astype(np.float32), 0.0)
    whole = pu_toxicity.text_scores(pa.array(["b", text, "c"]), model)
    monkeypatch.setattr(folding, "CHUNK_BYTES", 8_000)
    monkeypatch.setattr(folding, "STRETCH", 1_000)
    cut = pu_toxicity.text_scores(pa.array(["b", text, "c"]), model)
    assert np.allclose(whole, cut, atol=1e-6)


@pytest.fixture(scope="module")
def learned():
    """A model of four fifths of the labelled rows, and the rest."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    docs = docs.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id", how="left")
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    rest = docs[~held].drop_duplicates("text")
    positives, others = rest[rest.toxic == 1], rest.sample(pu_toxicity.UNLABELLED, random_state=3)
    rows = pu_toxicity.distinct_words(pa.array([*positives.text, *others.text]))
    y = np.arange(len(rows)) < len(positives)
    some = np.array([bool(x) for x in rows])
    model = pu_toxicity.learn(pu_toxicity.Sample([x for x in rows if x]), y[some], rest.toxic.mean())
    return model, docs[held & docs.toxic.notna()]


def recall(model, toxic, clean):
    """Share of toxic texts above nine tenths of the clean ones."""
    bar = np.quantile(pu_toxicity.text_scores(pa.array(list(clean)), model), 0.9)
    return (pu_toxicity.text_scores(pa.array(list(toxic)), model) > bar).mean()


def each_word(change):
    return lambda text: re.sub(r"\w+", lambda m: change(m[0]), text)


FORMS = {
    "plain": lambda t: t,
    "upper case": str.upper,
    "digits for letters": lambda t: t.lower().translate(str.maketrans("oieast", "013457")),
    "stretched": each_word(lambda w: w[:-1] + w[-1] * 4),
    "dotted": each_word(".".join),
    "spaced": each_word(lambda w: " ".join(w) + "  "),
    "beginning": each_word(lambda w: ("anti", "mega", "uber", "super", "un")[zlib.crc32(w.encode()) % 5] + w),
    "ending": each_word(lambda w: w + ("s", "ling", "ed", "ova", "ism")[zlib.crc32(w.encode()) % 5]),
    "accents": lambda t: t.translate(str.maketrans("aeiou", "áèîõü")),
}


@pytest.mark.parametrize("form", FORMS)
def test_held_out_recall(learned, form):
    model, held = learned
    said = [FORMS[form](t) for t in held.text]
    toxic, clean = ([t for t, y in zip(said, held.toxic, strict=True) if y == k] for k in (1, 0))
    # With a strange beginning to each of its words, a clean text loses more of what marks it as clean than a toxic one.
    assert recall(model, toxic, clean) >= (0.7 if form == "beginning" else 0.8)


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_held_out_recall_by_language(learned, lang):
    model, held = learned
    of = held[held.lang == lang]
    assert recall(model, of.text[of.toxic == 1], of.text[of.toxic == 0]) >= 0.8


def test_clean_text_does_not_hide_a_toxic_one(learned):
    model, held = learned
    clean = list(held.text[held.toxic == 0])
    rng = random.Random(2)
    around = [rng.sample(clean, 10) for _ in range(100)]
    toxic = [" ".join([*x[:5], t, *x[5:]]) for x, t in zip(around, held.text[held.toxic == 1], strict=False)]
    assert recall(model, toxic, [" ".join(x) for x in around]) >= 0.8


def test_a_constant_score_catches_nothing(learned):
    _, held = learned
    blank = pu_toxicity.Model(np.zeros(1 << folding.BITS, dtype=np.float32), -np.inf)
    assert recall(blank, held.text[held.toxic == 1], held.text[held.toxic == 0]) == 0


def test_query_scores_every_row(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = registry.QUERIES["op6_pu_toxicity"](spark, folder).cache()
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    told = found.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in told)
    toxic, clean = ([r["score"] for r in told if r["toxic"] == k] for k in (1, 0))
    better = np.mean([np.mean(np.array(clean) < x) for x in toxic])
    assert better > 0.75  # of 46 toxic texts in four languages


def test_odd_input(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (5, "you idiot"), (5, "you idiot"), (None, "idiot"), (6, "fine words"), (7, "é日🙂")]
    clash = "id string, y string, h string, n string, words string, score string"
    docs = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], f"doc_id long, text string, {clash}")
    labels = spark.createDataFrame([(5, 1), (6, None), (7, 0), (None, 1), (2, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    model = pu_toxicity.train(docs, labels)
    got = {(r["doc_id"], r["score"]) for r in pu_toxicity.score(docs, model).collect()}
    assert pu_toxicity.score(docs, model).count() == len(rows)
    assert dict(got)[5] > dict(got)[6] and dict(got)[1] == dict(got)[2] == dict(got)[3] == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["score"] for r in pu_toxicity.score(docs, pu_toxicity.train(docs, few)).collect()} == {0.0}
    nothing = docs.limit(0)
    assert pu_toxicity.score(nothing, pu_toxicity.train(nothing, labels)).count() == 0


def test_pieces_by_hand():
    data = np.frombuffer(b" abcd  a ", dtype=np.uint8)
    found = [(int(w), int(h)) for at, hashed in folding.pieces(data, np.array([1, 7])) for w, h in zip(at, hashed, strict=True)]
    assert [w for w, _ in found].count(0) == 4 + 3 + 2 and [w for w, _ in found].count(1) == 1
    longer = np.frombuffer(b" abcdef ", dtype=np.uint8)
    assert sum(len(hashed) for _, hashed in folding.pieces(longer, np.array([1]))) == 6 + 5 + 4 + 2
    alone = np.frombuffer(b" abcd ", dtype=np.uint8)
    again = [int(h) for _, hashed in folding.pieces(alone, np.array([1])) for h in hashed]
    assert again == [h for w, h in found if w == 0]
    assert mix(np.array([1], dtype=np.uint64))[0] != 1


def test_each_term_is_enough_alone(learned):
    """Terms that stood together in the toxic texts that were learned from are known one by one."""
    _, held = learned
    rng = random.Random(4)
    terms = [f"{a}{b}zq" for a in ("vor", "mul", "kep") for b in ("ak", "il", "os")]
    plain = [f"{rng.choice('bdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bdfglmnprst')}{rng.choice('aeiou')}{k % 37}" for k in range(400)]
    text = lambda n, more=(): " ".join(rng.sample([*rng.choices(plain, k=n), *more], n + len(more)))
    toxic = [text(60, rng.sample(terms, 4)) for _ in range(150)]
    others = [text(60, rng.sample(terms, 4) if k % 10 == 0 else ()) for k in range(1_500)]
    rows = pu_toxicity.distinct_words(pa.array([*toxic, *others]))
    model = pu_toxicity.learn(pu_toxicity.Sample(rows), np.arange(len(rows)) < len(toxic), 0.1)
    clean = [text(60) for _ in range(300)]
    assert recall(model, [text(60, [x]) for x in terms for _ in range(5)], clean) >= 0.95
