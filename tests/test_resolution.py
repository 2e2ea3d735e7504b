"""Whole results of the queries that SQL has no form for, against plain Python."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pyarrow.parquet as pq
import pytest

from leafmill.functions.similarity import indel_ratio
from leafmill.operators import name_join, resolve
from leafmill.plans.queries import QUERIES


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def rows(spark, sf, name):
    return sorted(map(tuple, QUERIES[name](spark, sf).collect()))


def normal(name):
    for s in (" - ", " – ", " — ", "-"):
        name = name.lower().replace(s, " ")
    return " ".join(name.split())


@pytest.fixture(scope="module")
def parts(sf):
    """Distinct names of each hundred parts in order of their first part."""
    out = {}
    for p in sorted(table(sf, "part"), key=lambda p: p["p_partkey"]):
        names = out.setdefault(p["p_partkey"] // 100, [])
        if p["p_name"] not in names:
            names.append(p["p_name"])
    return out


def test_name_ratio(spark, sf):
    nations = {n["n_nationkey"]: n["n_name"] for n in table(sf, "nation")}
    want = []
    for s in table(sf, "supplier"):
        a, b = s["s_name"], nations[s["s_nationkey"]]
        ratio = SequenceMatcher(None, a.lower(), b.lower()).ratio()
        x, y = normal(a), normal(b)
        same = a == b or x == y or x.endswith(y) or y.endswith(x) or SequenceMatcher(None, x, y).ratio() >= 0.85
        want.append((s["s_suppkey"], ratio, same))
    assert rows(spark, sf, "name_ratio") == sorted(want)


def test_toc_match(spark, sf):
    used = {c["c_nationkey"] for c in table(sf, "customer")}
    nations = sorted(table(sf, "nation"), key=lambda n: n["n_nationkey"])
    want = set()
    for n in nations:
        if n["n_nationkey"] not in used:
            continue
        name = n["n_name"].lower() + ("x" if n["n_nationkey"] % 2 == 0 else "")
        entries = [m["n_name"] for m in nations if m["n_regionkey"] == n["n_regionkey"]]
        a = normal(name)
        sure = [e for e in entries if a == normal(e) or a.endswith(normal(e)) or normal(e).endswith(a)]
        scored = [(SequenceMatcher(None, a, normal(e)).ratio(), -i, e) for i, e in enumerate(entries)]
        best = max(scored)
        want.add((n["n_regionkey"], name, sure[0] if sure else best[2] if best[0] >= 0.85 else None))
    got = {tuple(r) for r in QUERIES["toc_match_fuzzy"](spark, sf).collect()}
    assert got == want and any(x[2] for x in want)


def test_greedy_clusters(spark, sf, parts):
    want = []
    for doc, names in parts.items():
        groups = []
        for name in names:
            like = lambda x, name=name: normal(x).endswith(normal(name)) or normal(name).endswith(normal(x)) or SequenceMatcher(None, normal(name), normal(x)).ratio() >= 0.85
            home = next((g for g in groups if any(like(x) for x in g)), None)
            if home is None:
                groups.append([name])
            else:
                home.append(name)
        want += [(doc, x, min(g, key=len)) for g in groups for x in g]
    assert rows(spark, sf, "greedy_cluster") == sorted(want)


def folded(rows):
    """Sequential merge by the rule: aliases by normal form, else the best above 0.85 of the known entities, else new."""
    aliases, entities = {}, {}
    for name, page, confidence, properties in rows:
        form = normal(name)
        if form in aliases:
            continue
        ratios = [(SequenceMatcher(None, form, normal(e)).ratio(), e) for e in entities if same(name, e)]
        top = max((r for r, _ in ratios), default=0)
        if top > 0.85:
            home = next(e for r, e in ratios if r == top)
            for k, v in properties.items():
                entities[home]["properties"].setdefault(k, v)
            if page is not None and page not in entities[home]["pages"]:
                entities[home]["pages"].append(page)
            entities[home]["confidence"] = max(entities[home]["confidence"], confidence)
        else:
            home = name
            entities[name] = {"confidence": confidence, "pages": [] if page is None else [page], "properties": dict(properties)}
        aliases[form] = home
    return aliases, entities


def same(a, b, least=0.85):
    x, y = normal(a), normal(b)
    return a == b or x == y or x.endswith(y) or y.endswith(x) or SequenceMatcher(None, x, y).ratio() >= least


def test_incremental_merge(spark, sf, parts):
    want = []
    for doc, names in parts.items():
        aliases, _ = folded([(n, None, 0.5, {}) for n in names])
        want += [(doc, n, aliases[normal(n)]) for n in names]
    assert rows(spark, sf, "incremental_merge") == sorted(want)


ODD_NAMES = [
    "Alpha - Fund", "alpha fund", "Alpha–Fund", "ALPHA  FUND II", "Umbrella - Alpha Fund", "", "-", "beta", "Beta Growth", "beta growth a", "beta growth b",
    "gamma bond x", "gamma bond y", "gamma bond z", "delta gamma bond x", "éclair fünd", "eclair fund", "x", "xx", "\U0001f600 fund", "🙂 fund", "beta growth ab",
]


def test_folds_of_odd_names(spark):
    told = [(n, k % 3 or None, k % 7 / 10, {"k": str(k), f"k{k % 4}": "v"}) for k, n in enumerate([*ODD_NAMES, *ODD_NAMES[::-2]])]
    frame = spark.createDataFrame([("d", n, k, *x) for k, (n, *x) in enumerate(told)] + [("d", None, 999, 1, 0.5, {})], "doc string, name string, ord long, page int, confidence double, properties map<string,string>")
    aliases, entities = folded(told)
    mapped, state = resolve.merge_in_order(frame)
    assert {r["name"]: r["entity"] for r in mapped.collect()} == {n: aliases[normal(n)] for n in ODD_NAMES}
    got = {r["entity"]: {"confidence": r["confidence"], "pages": r["pages"], "properties": {x["key"]: x["value"] for x in r["properties"]}} for r in state.collect()}
    assert got == entities
    assert {r["name"]: r["canonical"] for r in resolve.greedy_clusters(frame).collect()} == clustered(list(dict.fromkeys(n for n, *_ in told)))
    empty = frame.limit(0)
    assert resolve.greedy_clusters(empty).count() == 0 and resolve.merge_in_order(empty)[0].count() == 0


def clustered(names):
    groups = []
    for name in names:
        home = next((g for g in groups if any(same(name, x) for x in g)), None)
        if home is None:
            groups.append([name])
        else:
            home.append(name)
    return {x: min(g, key=len) for g in groups for x in g}


def titles_of(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    return {i: " ".join(re.findall(r"[^ \t\n\x0b\f\r]+", t)[:4]) for i, t in docs}


def test_one_group_of_all_titles(spark, sf):
    titles = titles_of(spark, sf)
    want = clustered(list(dict.fromkeys(titles.values())))
    assert {tuple(r) for r in QUERIES["greedy_cluster_whole"](spark, sf).collect()} == set(want.items())
    assert len(set(want.values())) < len(want)
    rows_ = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    told = [(t, rows_[i]["n_chars"] % 97, i % 10 / 10, {k: rows_[i][k] for k in ("source", "lang") if rows_[i][k] is not None}) for i, t in titles.items()]
    _, entities = folded(told)
    got = QUERIES["entity_merge_whole"](spark, sf).collect()
    assert {r["entity"]: (r["confidence"], r["pages"], {x["key"]: x["value"] for x in r["properties"]}) for r in got} == {k: tuple(v.values()) for k, v in entities.items()}


def test_lookup_is_the_first_entity_of_all_pairs(spark, sf):
    titles = titles_of(spark, sf)
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    entities = list(dict.fromkeys(t for i, t in titles.items() if i in labelled))
    known = set(entities)
    want = {t: t if t in known else next((e for e in entities if same(t, e)), None) for t in set(titles.values())}
    got = {r["name"]: r["entity"] for r in QUERIES["fund_lookup_fuzzy"](spark, sf).collect()}
    assert got == want


def test_few_candidates_and_none_missed(spark, sf):
    titles = sorted(set(titles_of(spark, sf).values()))
    names = spark.createDataFrame([(0, normal(t)) for t in titles], "doc int, name string").distinct()
    forms = sorted({normal(t) for t in titles})
    found = {(r["a"], r["b"]) for r in name_join.alike_candidates(names, names, 0.85).collect()}
    alike = {(a, b) for a in forms for b in forms if a and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert alike <= found
    assert len(found) < len(forms) ** 2 / 10
    ends = {(r["a"], r["b"]) for r in name_join.ending_pairs(names, names).collect()}
    assert ends == {(a, b) for a in forms for b in forms if a.endswith(b) or b.endswith(a)}


@pytest.mark.parametrize(("tile", "groups"), [(1024, 1), (16, 1), (16, 3)])
def test_tiles_miss_no_pair(spark, monkeypatch, tile, groups):
    """Names a few edits apart, in one tile and in many: all that either ratio finds, and hardly more."""
    monkeypatch.setattr(name_join, "_TILE", tile)
    rng = random.Random(7)
    names = {"", "a", "aa", "🙂 fund", "\U0001d400 fund", "x" * 250, "x" * 251, "ab" * 130}
    while len(names) < 400:
        name = "".join(rng.choices("aeinorst ", k=rng.randint(1, 30)))
        for _ in range(4):
            names.add(name)
            at = rng.randint(0, len(name))
            name = name[:at] + rng.choice(["", "e", "zü"]) + name[at + rng.randint(0, 2) :]
    names = sorted(names)
    told = spark.createDataFrame([(k % groups, n) for k, n in enumerate(names)] + [(0, None)], "doc int, name string")
    for least in (0.6, 0.85):
        found = [(r["a"], r["b"]) for r in name_join.alike_candidates(told, told, least).collect()]
        pairs = [(a, b) for j, a in enumerate(names) for k, b in enumerate(names) if j % groups == k % groups]
        like = {(a, b) for a, b in pairs if indel_ratio(a, b) >= 100 * least or SequenceMatcher(None, a, b).ratio() >= least}
        assert like <= set(found) and len(found) == len(set(found))
        if least == 0.85:
            assert len(found) < 1.2 * len(like)


def test_names_meet_in_tiles(spark, sf):
    """Names are compared tile by tile, not in a join on letters that every other name holds too."""
    names = spark.createDataFrame([(0, normal(t)) for t in set(titles_of(spark, sf).values())], "doc int, name string")
    plan = name_join.alike_candidates(names, names, 0.85)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan


def test_two_tiles_of_one_table_meet_once(spark, monkeypatch):
    monkeypatch.setattr(name_join, "_TILE", 8)
    monkeypatch.setattr(name_join, "_GRID", 3)
    told = [f"name {'abcdefgh'[k % 8] * 9} {k:03}" for k in range(104)]
    frame = spark.createDataFrame([(d, n) for d in (0, 1) for n in told] + [(2, "name one"), (2, "name two")], "doc int, name string")
    got = [tuple(r) for r in name_join.alike_candidates(frame, frame, 0.85).collect()]
    assert len(got) == len(set(got)) and {(d, b, a) for d, a, b in got} == set(got)
    alike = {(a, b) for a in told for b in told if SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert len(alike) > 1000 and all({(d, *p) for p in alike} <= set(got) for d in (0, 1))

    def firsts(least):
        def run(batches):
            for batch in batches:
                ids = [[int.from_bytes(x.as_py()[:8], "little") for x in batch.column(c)] for c in ("xs", "ys")]
                yield name_join.pa.RecordBatch.from_arrays([name_join.pa.array(c) for c in ids], names=["xi", "yi"])

        return run

    monkeypatch.setattr(name_join, "_near", firsts)
    signed = name_join._signed(frame)
    met = [frozenset(r) for r in name_join._near_ids(signed, signed, 0.85).collect()]
    assert len(met) == len(set(met)) > 100


def test_fuzzy_rows(spark, sf, parts):
    sort = lambda x: " ".join(sorted(x.split()))
    want = set()
    for doc, names in parts.items():
        for a in names:
            scored = [(indel_ratio(sort(a), sort(b)), -i, b) for i, b in enumerate(names) if b != a]
            best = max(scored, default=(0, 0, None))
            if best[0] >= 80:
                want.add((doc, a, best[2], best[0]))
    assert {tuple(r) for r in QUERIES["fuzzy_column_row_lookup"](spark, sf).collect()} == want


def test_model_groups(spark, sf, parts):
    rows_ = sorted(table(sf, "part"), key=lambda p: p["p_partkey"])
    want = []
    for doc, names in parts.items():
        here = [p for p in rows_ if p["p_partkey"] // 100 == doc]
        canonical = {}
        mapped = {}
        for p in (p for p in here if p["p_size"] <= 35):
            canonical.setdefault(p["p_brand"], p["p_name"])
            mapped.setdefault(p["p_name"], []).append(p["p_brand"])
        order = list(canonical)
        # A name in several groups goes with the group that came last.
        mapped = {n: canonical[max(b, key=order.index)] for n, b in mapped.items()}
        aside = {p["p_name"] for p in here if p["p_size"] > 48}
        known = list(canonical.values())
        for name in names:
            if name in mapped or name in aside or normal(name) in ("small plated brass", "smallplatedbrass"):
                continue
            a = normal(name)
            found = next((k for k in known if (b := normal(k)) == a or a.endswith(b) or b.endswith(a) or SequenceMatcher(None, a, b).ratio() >= 0.85), None)
            if found is None:
                found = name
                known.append(name)
            mapped[name] = found
        want += [(doc, n, c) for n, c in mapped.items()]
    assert rows(spark, sf, "model_groups") == sorted(want)


def test_code_merge(spark, sf):
    funds = {}
    for o in sorted(table(sf, "orders"), key=lambda o: o["o_orderkey"]):
        k, p = o["o_orderkey"], o["o_orderpriority"]
        code = f"LU{k:010d}" if k % 5 == 0 else "NOT_FOUND" if k % 5 == 1 else None
        name = (f"{p} 1", p[2:].lower(), f"class {p} 2", "other")[k % 4]
        classes, found = funds.setdefault(o["o_custkey"], ([], []))
        classes.append([k, f"{p} {k % 3}", code])
        found.insert(0, (name, "LU1" if k % 7 == 0 else f"IE{k:010d}"))
    want = []
    for fund, (classes, found) in funds.items():
        for name, code in found:
            same = [c for c in classes if c[1] == name]
            near = [c for c in classes if c[2] in (None, "NOT_FOUND") and (name.lower() in c[1].lower() or c[1].lower() in name.lower())]
            to = same or near
            if to and len(code) == 12:
                to[0][2] = code
        want += [(fund, *c) for c in classes]
    assert sorted(map(tuple, QUERIES["code_merge"](spark, sf).collect()), key=str) == sorted(want, key=str)


def test_rows_about(spark, sf):
    nations = {n["n_nationkey"]: n["n_name"] for n in table(sf, "nation")}
    want, seen = [], {}
    for s in sorted(table(sf, "supplier"), key=lambda s: s["s_suppkey"]):
        k, nation = s["s_suppkey"], nations[s["s_nationkey"]]
        names = [f"{nation} {k % 100}".lower(), ("" if k % 4 == 0 else s["s_name"]).lower()]
        entity = nation.lower()
        if any(entity in x or SequenceMatcher(None, entity, x).ratio() >= 0.6 for x in names):
            seen[nation] = seen.get(nation, 0) + 1
            if seen[nation] <= 5:
                line = f"Class:  {nation} {k % 100} | Balance: {s['s_acctbal']}" + (f" | Fund: {s['s_name']}" if k % 4 else "")
                want.append((s["s_nationkey"], entity, k, line))
    assert rows(spark, sf, "rows_about") == sorted(want)


def test_json_documents_come_back(spark, tmp_path):
    from leafmill.sources import reports

    schema = "doc long, values array<struct<field: string, value: string>>"
    docs = spark.createDataFrame([(1, [("a", None)]), (2, [])], schema)
    reports.write_json(docs, f"{tmp_path}/out")
    assert sorted(reports.read_json(spark, f"{tmp_path}/out", schema).collect()) == sorted(docs.collect())
