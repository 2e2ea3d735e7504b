"""Exact Jaccard self-join of word shingles by grouped prefixes.

1. *Order.*  Shingles that some two dozen texts hold come last, by rising count: those found in SEEN of the texts that are
   counted, one in SHARE.  All others come first, by hash.  Any common order is exact; this one keeps shared passages
   and, however large the corpus is, what texts share by chance out of the prefixes.
2. *Groups.*  Texts with one shingle set become one node.  Two sets of similarity t share SHARED shingles (or as many
   as they must share at all) among the first n - ceil(t * n) + SHARED of each.  Nodes with the same prefix and size
   become one group.
3. *Filter.*  Groups meet in the list of each prefix shingle.  A meeting counts if sizes allow the similarity and if
   the places of the shared shingle leave enough to share; a pair stays if enough meetings count.  Lists of up to
   ``LIST`` groups give all meetings.  A longer list gives those with its first group only; later, those between
   parts that verified links haven't joined, met by bands of sizes and in salts.
4. *Verify.*  Sets of candidate nodes are made anew from the texts and compared exactly; groups are expanded to
   members where these aren't joined yet.
5. Verified links give components.

Defined results: a null, empty or wordless text has 0 shingles and is its own component.  Repeated rows count as
copies of one another.  Rows with a null id are linked like others but never name a component unless all its ids
are null.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import components
from leafmill.llm.shingles import fingerprint, least_overlap, shingles
from leafmill.session import drop, in_job, materialize, read_table, ship_code, tidy

#: One of so many texts is counted to put frequent shingles last, those found in SEEN of them; it changes the work only.
SHARE, SEEN = 8, 3
#: Shingles that a task of the counting step holds.
WINDOW_SHINGLES = 4_000_000
#: The most frequent shingles whose order is told to every task (12 bytes each); it changes the work only.
FREQUENT = 500_000
#: Prefix shingles that a pair must share: more make prefixes longer and chance meetings rarer.
SHARED = 4
#: Groups that meet in one list without a detour.
LIST = 48
#: Size of the bitmaps that mark frequent shingles and spare texts without candidates (8 MB); it changes the work only.
BITS = 2**26
#: Pairs with one node that a task verifies in a row.
SALT_PAIRS = 2_000
#: Groups of one band of a long list that a task meets in a row.
SALT_GROUPS = 2_000
#: Parts in which the pairs of one node are counted.
COUNT_PARTS = 16


def _texts(docs: DataFrame, text: str, id_: str) -> DataFrame:
    return docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))


def _frequent(slim: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (ascending) of the most frequent shingles, their places by rising count, and a bitmap of all found often."""

    def tell(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found in shingles(batch.column("text"), width):
                held.append(found)
                size += len(found)
                if size >= WINDOW_SHINGLES:
                    yield tell(held)
                    held, size = [], 0
        if held:
            yield tell(held)

    some = slim.select("text").where(F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(SHARE)) == 0)
    often = some.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    often = materialize(often, "often")
    with tidy(slim.sparkSession):
        counts = often.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toArrow()
        n, c = (counts.column(k).to_numpy() for k in ("n", "c"))
        down = np.argsort(-n)
        told = n[down][np.cumsum(c[down]) <= FREQUENT]
        rows = often.where(F.col("n") >= int(told[-1]) if len(told) else F.lit(False)).toArrow()
        marks = _bits(F.expr(f"shingle & {BITS - 1}"), often)
    drop(often)
    found = rows.column("shingle").to_numpy().view(np.uint64)
    place = np.empty(len(found), dtype=np.int32)
    place[np.lexsort((found, rows.column("n").to_numpy()))] = np.arange(1, len(found) + 1, dtype=np.int32)
    order = np.argsort(found)
    return found[order], place[order], marks


def _last(found: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Shingles that were found often: those without a place by hash, then the most frequent by place."""
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.argsort(np.where(common[at] == found, place[at], 0), kind="stable")]


def _prefixes(slim: DataFrame, width: int, percent: int) -> DataFrame:
    """The columns besides the text, n, node, check (128 bits of the set) and the prefix of every text."""
    frequent = slim.sparkSession.sparkContext.broadcast(_frequent(slim, width))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema if f.name != "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place, marks = frequent.value
        for batch in batches:
            sizes, nodes, checks, prefixes = [], [], [], []
            for found in shingles(batch.column("text"), width):
                n = len(found)
                length = min(n, n - least_overlap(n, percent) + SHARED)
                often = _marked(marks, (found & np.uint64(BITS - 1)).view(np.int64))
                prefix = found[~often][:length]
                if len(prefix) < length:
                    prefix = np.concatenate([prefix, _last(found[often], common, place)])[:length]
                node, check = fingerprint(found)
                sizes.append(n)
                nodes.append(node)
                checks.append(check)
                prefixes.append(prefix.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kinds), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array(checks, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=[*kinds, "n", "node", "check", "prefix"],
            )

    held = "".join(f"{c} {kind}, " for c, kind in kinds.items())
    return slim.mapInArrow(run, f"{held}n long, node long, check long, prefix array<long>")


def _may_link(na: np.ndarray, nb: np.ndarray, ia: np.ndarray, ib: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity if one of their first SHARED common shingles is here."""
    overlap = np.minimum(na - ia, nb - ib) + SHARED - 1
    return (100 + percent) * overlap >= percent * (na + nb)


def _tally(pairs: list[np.ndarray]) -> list[np.ndarray]:
    """Columns a, b, na, nb, star, with how often each row occurs."""
    rows = np.concatenate(pairs, axis=1)
    swap = rows[0] > rows[1]
    rows[:2, swap], rows[2:4, swap] = rows[1::-1, swap], rows[3:1:-1, swap]
    rows = rows[:, np.lexsort((rows[4], rows[1], rows[0]))]
    change = np.any(rows[[0, 1, 4], 1:] != rows[[0, 1, 4], :-1], axis=0)
    first = np.flatnonzero(np.concatenate([[True], change])) if rows.shape[1] else np.zeros(0, dtype=np.int64)
    return [*rows[:, first], np.diff(np.append(first, rows.shape[1]))]


def _meet(postings: DataFrame, percent: int) -> DataFrame:
    """Meetings of groups: (a, b, na, nb, star, met).

    star is 0 for meetings in lists of up to LIST groups and 1 for those with the first group of a longer list; 2 marks
    the rows of longer lists: a is the group, b the shingle, na the size, nb the place.
    """

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "na", "nb", "star", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last shingle, not yet dealt with
        pivot = None  # (shingle, group, n, place) of a long list under way
        low, high = np.triu_indices(LIST, 1)
        order = np.argsort(high, kind="stable")
        low, high = low[order], high[order]
        for batch in _and_none(batches):
            if batch is not None:
                rows = np.stack([batch.column(k).to_numpy() for k in ("token", "group", "n", "place")])
                rows = rows if held is None else np.concatenate([held, rows], axis=1)
            elif held is None:
                return
            else:
                rows = held
            token = rows[0]
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            ends = np.append(first[1:], len(token))
            lone = ends - first == 1
            pairs, held = [], None
            for s, e, single in zip(first.tolist(), ends.tolist(), lone.tolist(), strict=True):
                if pivot is not None and pivot[0] != token[s]:
                    pivot = None
                if pivot is None:
                    if batch is not None and e == len(token) and e - s <= LIST:
                        held = rows[:, s:]  # it may go on in the next batch
                        break
                    if single:
                        continue
                part = rows[:, s:e]
                if pivot is None and e - s <= LIST:
                    k = (e - s) * (e - s - 1) // 2
                    x, y = part[:, low[:k]], part[:, high[:k]]
                    ok = _may_link(x[2], y[2], x[3], y[3], percent)
                    pairs.append(np.stack([x[1, ok], y[1, ok], x[2, ok], y[2, ok], np.zeros_like(x[1, ok])]))
                    continue
                if pivot is None:
                    pivot = part[:, 0].tolist()
                ok = _may_link(part[2], pivot[2], part[3], pivot[3], percent) & (part[1] != pivot[1])
                own = np.full(int(ok.sum()), pivot[1])
                pairs.append(np.stack([own, part[1, ok], np.full_like(own, pivot[2]), part[2, ok], np.ones_like(own)]))
                two = np.full(e - s, 2)
                yield emit([part[1], part[0], part[2], part[3], two, np.ones_like(two)])
            if pairs:
                yield emit(_tally(pairs))

    dealt = postings.repartition("token").sortWithinPartitions("token", "place", "group")
    return dealt.mapInArrow(run, "a long, b long, na long, nb long, star long, met long")


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _bits(place: Column, rows: DataFrame) -> np.ndarray:
    """A bitmap of places below BITS: BITS / 64 words at most, however many rows there are."""
    words = rows.select(place.alias("place")).selectExpr("shiftright(place, 6) word", "shiftleft(1L, cast(place & 63 as int)) bit")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _marked(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _sets(slim: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, found) of nodes, made anew from the texts of one row each; nodes has node and id.

    A bitmap of ids lets the scan pass over most other texts; the join with the nodes is exact.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("place")
    with tidy(slim.sparkSession):
        wanted = slim.sparkSession.sparkContext.broadcast(_bits(place, nodes))
    some = slim.select(place, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            mask = _marked(bits, batch.column("place").to_numpy())
            made = [(fingerprint(x)[0], x.tobytes()) for x in shingles(batch.column("text").filter(pa.array(mask)), width) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())],
                names=["node", "found"],
            )

    made = some.mapInArrow(run, "node long, found binary").join(nodes.select("node").hint("merge"), "node", "left_semi")
    return materialize(made.dropDuplicates(["node"]), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity.

    Each node's set is sent once for every pair with it as b, and once for every task that compares it as a.
    """
    pairs = pairs.select("a", "b")
    # Counted in parts first: a hub has pairs in every task.
    hubs = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(COUNT_PARTS)).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    hubs = hubs.groupBy("a").agg(F.sum("n").alias("n")).withColumn("salts", F.ceil(F.col("n") / SALT_PAIRS))
    salted = pairs.join(hubs.where("salts > 1").select("a", "salts"), "a", "left").select(
        F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"), "b"
    )
    own = hubs.select(
        F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("b"),
    )
    # Both sides grow with the corpus, so neither is to be broadcast.
    asked = salted.unionByName(own).join(sets.hint("merge"), "node").select("a", "salt", "b", "found")
    dealt = asked.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            good_a, good_b = [], []
            for a, b, raw in zip(*(batch.column(k) for k in ("a", "b", "found")), strict=True):
                found = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if not b.is_valid:
                    hub = found.copy()
                    continue
                at = np.minimum(np.searchsorted(hub, found), len(hub) - 1)
                both = int((hub[at] == found).sum())
                if 100 * both >= percent * (len(hub) + len(found) - both):
                    good_a.append(a.as_py())
                    good_b.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _dealt(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of long lists outside their largest part, and all rows, dealt so that pairs of possible sizes meet.

    Sizes of similar sets differ by one band at most, so a row asks three bands.  A band of a list with more than
    SALT_GROUPS groups is dealt into salts by group, and each asking row goes to all of them: no list is one task's work.
    """
    names = ("group", "n", "place", "low", "high", "in_major", "prefix")
    band = F.floor(F.log("n") / (np.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    lists = lists.withColumn("band", band.cast("long"))
    salts = lists.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / SALT_GROUPS).alias("salts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    asked = lists.where("not in_major").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    x = asked.join(salts, ["token", "band"]).select("token", "band", every, *(F.col(c).alias(f"{c}_x") for c in names))
    y = lists.join(salts, ["token", "band"]).select(
        "token", "band", F.pmod(F.xxhash64("group"), F.col("salts")).alias("salt"), *(F.col(c).alias(f"{c}_y") for c in names)
    )
    return x, y


def _classes(slim: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes of all texts, and (node, id, component) of the nodes: ``component`` is a node that links reach."""
    whole = materialize(_prefixes(slim, width, percent), "prefixes")
    filled = whole.where("n > 0").withColumn("group", F.xxhash64("n", "prefix"))
    nodes = filled.groupBy("node", "check", "n").agg(F.min("id").alias("id"), F.first("group").alias("group"))
    nodes = materialize(nodes, "nodes")
    groups = materialize(filled.groupBy("group").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
    texts = materialize(whole.drop("check", "prefix"), "texts")
    drop(whole)
    postings = groups.select("group", "n", F.posexplode("prefix").alias("place", "token")).select(
        "token", "group", "n", F.col("place").cast("long").alias("place")
    )
    met = materialize(_meet(postings, percent), "met")
    large = met.where("star = 2").select(
        F.col("b").alias("token"), F.col("a").alias("group"), F.col("na").alias("n"), F.col("nb").alias("place")
    )
    large = materialize(large, "large")
    enough = f"least({SHARED}, ceil({percent} * (na + nb) / {100 + percent}))"
    counted = met.where("star < 2").groupBy("a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("met").alias("met"),
        F.sum(F.expr("if(star = 0, met, 0)")).alias("near"),
    )
    counted = materialize(counted, "counted")
    drop(met)
    group_pairs = counted.where(f"met >= {enough}").select("a", "b")
    in_large = materialize(large.select("group").distinct(), "in-large")
    prefix = materialize(groups.select("group", "prefix").join(in_large.hint("merge"), "group", "left_semi"), "prefix")
    drop(groups)
    weak = counted.where(f"met < {enough} and near > 0").select("a", "b", "na", "nb")
    weak = weak.join(in_large.select(F.col("group").alias("a")), "a", "left_semi")
    weak = weak.join(in_large.select(F.col("group").alias("b")), "b", "left_semi").select("a", "b", "na", "nb")
    many = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")

    # Nodes whose sets may be looked at: heads of paired groups, groups of a long list, groups of several members.
    meant = group_pairs.select(F.col("a").alias("group")).unionByName(group_pairs.select(F.col("b").alias("group")))
    meant = meant.unionByName(large.select("group")).unionByName(many.select("group")).distinct()
    looked = materialize(nodes.select("node", "id", "group").join(meant, "group", "left_semi"), "looked")
    heads = looked.groupBy("group").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members"))
    heads = materialize(heads, "heads")
    sets = _sets(slim, looked, width)

    # Round 1: heads of paired groups, and each group's members against its head.
    ha = heads.select(F.col("group").alias("a"), F.col("head").alias("na"), F.col("members").alias("ma"))
    hb = heads.select(F.col("group").alias("b"), F.col("head").alias("nb"), F.col("members").alias("mb"))
    paired = materialize(group_pairs.join(ha, "a").join(hb, "b"), "paired")
    inside = looked.join(heads.where("members > 1").select("group", "head"), "group").where("node <> head")
    first = paired.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(
        inside.select(F.col("head").alias("a"), F.col("node").alias("b"))
    )
    links = materialize(_verify(first, sets, percent), "linked")
    joined = components(links)

    # Round 2: what round 1 left apart, in long lists, between groups of several members and within them.
    part = looked.join(joined, "node", "left").select("node", "group", F.coalesce("component", "node").alias("part"))
    part = materialize(part, "part")
    span = part.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    lists = large.join(span, "group")
    most = lists.where("low = high").groupBy("token").agg(F.mode("low", True).alias("major"))
    open_ = lists.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    open_ = open_.select("token").join(most, "token", "left")
    lists = lists.join(open_, "token").withColumn("in_major", F.expr("low = high and low <=> major"))
    lists = materialize(lists.drop("major").join(prefix, "group"), "lists")
    x, y = _dealt(lists, percent)
    # A pair of different parts has an end outside the list's largest part; it is told at its first common shingle.
    apart = "not (low_x = high_x and low_y = high_y and low_x = low_y) and (in_major_y or group_x < group_y)"
    room = f"{100 + percent} * least(n_x - place_x, n_y - place_y) >= {percent} * (n_x + n_y)"
    first_here = "size(array_intersect(slice(prefix_x, 1, int(place_x)), slice(prefix_y, 1, int(place_y)))) = 0"
    shares = f"size(array_intersect(prefix_x, prefix_y)) >= least({SHARED}, ceil({percent} * (n_x + n_y) / {100 + percent}))"
    more = x.join(y, ["token", "band", "salt"]).where(f"{apart} and {room} and {first_here} and {shares}")
    more = more.selectExpr("least(group_x, group_y) a", "greatest(group_x, group_y) b")
    weak = weak.join(prefix.select(F.col("group").alias("a"), F.col("prefix").alias("pa")), "a")
    weak = weak.join(prefix.select(F.col("group").alias("b"), F.col("prefix").alias("pb")), "b")
    more = more.unionByName(weak.where(f"size(array_intersect(pa, pb)) >= {enough}").select("a", "b"))
    wide = paired.where("ma + mb > 2").select("a", "b")
    split = span.where("low <> high").select(F.col("group").alias("a"), F.col("group").alias("b"))
    more = more.unionByName(wide).unionByName(split).distinct()
    px = part.select(F.col("group").alias("a"), F.col("node").alias("na"), F.col("part").alias("pa"))
    py = part.select(F.col("group").alias("b"), F.col("node").alias("nb"), F.col("part").alias("pb"))
    again = more.join(px, "a").join(py, "b").where("pa <> pb and (a <> b or na < nb)")
    again = again.select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct()
    done = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    again = materialize(again.join(done, ["a", "b"], "left_anti"), "again")
    drop(large, counted, prefix, lists, paired)
    if not again.isEmpty():
        fresh = _verify(again, sets, percent)
        joined = components(links.unionByName(fresh))
    drop(sets)

    labelled = nodes.select("node", "id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return texts, labelled


def similar(docs: DataFrame, width: int = 3, percent: int = 90, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` of every row.

    Rows link when 100 * shared >= percent * united distinct shingles; ``component_id`` is the smallest id that links
    reach, its own included.
    """
    ship_code(docs.sparkSession)
    return in_job("classes", lambda: _similar(docs, width, percent, text, id_))


def _similar(docs: DataFrame, width: int, percent: int, text: str, id_: str) -> DataFrame:
    texts, labelled = _classes(_texts(docs, text, id_), width, percent)
    named = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labelled.select("node", "component").join(named, "component").select("node", "component_id")
    out = texts.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), whole.alias("component_id"))


def _representatives(slim: DataFrame, width: int, percent: int) -> DataFrame:
    """(kept, kept_one, kept_two): id and 128 bits of the text that stays of each class."""
    texts, labelled = _classes(slim, width, percent)
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "one", "two"))
    of_node = texts.where("n > 0").groupBy("node").agg(least.alias("best")).select("node", "best.id", "best.one", "best.two")
    of_class = of_node.join(labelled.select("node", "component"), "node").groupBy("component").agg(least.alias("best"))
    wordless = texts.where("n = 0").select("id", "one", "two").distinct()
    kept = of_class.select("best.id", "best.one", "best.two").unionByName(wordless)
    return kept.select(F.col("id").alias("kept"), F.col("one").alias("kept_one"), F.col("two").alias("kept_two"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row of each class of near-duplicates, with all its columns.

    It is a row of the class's smallest id (a null id only where the class has no other).  Ids need not be unique: rows of
    one id whose texts are in different classes all stay.  Of a class's rows with that id one text stays, and of rows with
    the same id and text the first in the order of columns.  A text without words is a class with rows of the same id and
    text only, and one without an id is a class of its own.
    """
    ship_code(docs.sparkSession)
    # 128 bits of the text tell apart the rows of an id (or of none).
    key = {"one": F.xxhash64(text), "two": F.xxhash64(F.lit(1), text)}
    slim = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), *(k.alias(c) for c, k in key.items()))
    kept = in_job("kept", lambda: _representatives(slim, width, percent))
    alone = F.col(id_).isNull() & ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = [text, *(c for c in docs.columns if c != text)]
    # Rows are dealt once: the join and the choice of a row need them by the same columns, an id that may be null in a struct.
    packed = docs.select(
        F.struct(F.col(id_).alias("id")).alias("who"), *(k.alias(c) for c, k in key.items()),
        F.when(alone, F.monotonically_increasing_id()).alias("alone"), F.struct(*columns).alias("row"),
    )
    kept = kept.select(F.struct(F.col("kept").alias("id")).alias("who"), F.col("kept_one").alias("one"), F.col("kept_two").alias("two"))
    packed = packed.join(kept, ["who", "one", "two"], "left_semi").groupBy("who", "one", "two", "alone").agg(F.min("row").alias("row"))
    return packed.select(*(F.col(f"row.{c}").alias(c) for c in docs.columns))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(read_table(spark, sf_dir, "documents"), width=3, percent=90)
