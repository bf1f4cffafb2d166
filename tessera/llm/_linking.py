"""Links and components among candidate sets, shared by the two similarity operators.

Equal sets are one *node* from the start. Candidates come as buckets: nodes that
share a key. Every pair of a bucket has to be compared, unless other links join
it or a bound excludes it; comparing all of them would cost the square of a
bucket's size. Each round compares a bucket's *pivot*, its member of the first
rank, with all others. What then still lies in several components goes on by
its differences from a *centre* C, the majority of some of the pivot's members:
near copies of one text differ from it in their own edits only.

With p = 100 - T, q = 100 + T and T the threshold in hundredths, x and y are
similar if q * |x ^ y| <= p * (|x| + |y|). Write g(x) = q * |x ^ C| - p * |x|;
as |x ^ y| = |x ^ C| + |y ^ C| - 2 m, with m = |(x ^ C) & (y ^ C)|, that is
g(x) + g(y) <= 2 q m. Let o be the member of the least g.

* If g(x) + g(o) <= 0, x is similar to o without a look at their sets.
* Any other x, a *far* one, needs m >= (g(x) + g(y)) / 2q > 0 with every
  partner y, and y needs m > (g(y) - g(o)) / 2q with every such x. So prefixes
  of both differences, in one order, must meet.

Only links between components are looked for. An element that one component
alone has (most edits are one member's own) is in no such m: it is left out, and
u(x) elements stay, those that few members have first. As m <= u(y), only y with
h(y) = 2 q u(y) - g(y) >= g(x) can be partners of x: the least g among these
bounds x's prefix, and members far from the centre look past those close to it.

A pivot's last few members (``SMALL``) are compared with each other at once. Of
more, members whose prefixes share an element are compared with each other where they
are at most ``DIRECT``, so that a member meets no more than that many others by
it. Where more share an element they are a bucket of the next round. They rank
behind the pivot and agree on that element, so the next centre has it too:
rounds end after as many steps as edits were made upon edits, groups of n near
copies cost about n comparisons, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _work as W

#: Members of a pivot that one share compares, and about how many settle a centre.
SHARE, VOTES = 128, 48
#: Members that share an element and are compared with each other.
DIRECT = 256
#: Members of a pivot that are compared with each other without a centre: that moves fewer sets.
SMALL = 4


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart; no order of the members matters."""
    if not len(grams):
        return 0, 0
    other = np.bitwise_xor.reduce(H.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True)
    return int(H.signed(H.mix64(grams).sum(keepdims=True))[0]), int(H.signed(other)[0])


def nodes_of(rows: DataFrame, *more: Column) -> DataFrame:
    """(node, d1, d2, rep, n): the different sets that have a document, a number for each, the least id that has it; stored."""
    known = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *more)
    return W.store(known.withColumn("node", F.monotonically_increasing_id()), "nodes")


def sets_of(documents: DataFrame, wanted: DataFrame, shingles, k: int) -> DataFrame:
    """(node, grams): full sets, as sorted 64-bit integers, of the wanted nodes (node, rep, d1); stored."""
    schema = pa.schema([("id", pa.int64()), ("found", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([digest(g)[0] for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], schema=schema)

    ids = W.store(wanted.select("rep").distinct(), "wanted-ids")
    read = W.with_ids(documents.select(F.col("doc_id").cast("long"), "text"), ids, "left_semi").mapInArrow(run, "id long, found long, grams binary")
    # Rows that share an id and a set give the node several times: one stays.
    sets = read.join(W.bounded(W.store(wanted.select("node", "rep", "d1"), "wanted")), (F.col("id") == F.col("rep")) & (F.col("found") == F.col("d1"))).select("node", "grams")
    stored = W.store(sets, "sets")
    twice = W.store(stored.groupBy("node").count().where("count > 1").select("node"), "twice")
    if not twice.limit(1).count():
        return stored
    one = stored.join(W.bounded(twice), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))
    return W.store(stored.join(W.bounded(twice), "node", "left_anti").unionByName(one), "sets")


def _dealt(pairs: DataFrame, sets: DataFrame, centres: DataFrame | None = None, *more: str) -> DataFrame:
    """Rows (a, b, grams, more): the sets of each a's members b, in shares, and ahead of every share a's own set, or its centre (a, grams). ``more`` are further long columns of the pairs."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    small = F.broadcast if W.is_few(pairs) else lambda df: df
    members = pairs.join(small(shares), "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b", F.col("b").alias("of"), *more)
    heads = shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), F.col("a").alias("of"), *(F.lit(None).cast("long").alias(c) for c in more))
    wanted = W.store(members if centres is not None else heads.unionAll(members), "comparisons")
    dealt = sets.join(W.bounded(wanted), F.col("node") == F.col("of")).select("a", "share", "b", "grams", *more)
    if centres is not None:
        dealt = dealt.unionByName(heads.join(centres, "a").select("a", "share", "b", "grams", *more))
    return dealt.repartition("a", "share").sortWithinPartitions("a", "share", "b").select("a", "b", "grams", *more)


def _compared(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[list[tuple]]:
    """a, b, both sets, which members of b's set a has, and ``more``; a list per batch."""
    mine = None
    for batch in batches:
        out = []
        for a, b, grams, *others in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("grams"), *(batch.column(c).to_pylist() for c in more)):
            other = np.frombuffer(grams.as_py(), dtype=np.uint64)
            if b is None:
                mine = other
            else:
                hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other if len(mine) else np.zeros(len(other), dtype=bool)
                out.append((a, b, mine, other, hit, *others))
        yield out


def similar(x: np.ndarray, y: np.ndarray, both: int, link: int) -> bool:
    return 100 * both >= link * (len(x) + len(y) - both)


def links_of(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _compared(batches):
            good = [(a, b) for a, b, x, y, hit in rows if similar(x, y, int(hit.sum()), link)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in good], pa.int64()) for i in (0, 1)], schema=schema)

    return _dealt(pairs, sets).mapInArrow(run, "a long, b long")


def _centres(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, grams): what most of some ``VOTES`` members of a have; stored."""
    schema = pa.schema([("a", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def vote() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([of]), pa.array([grams[2 * n > len(held)].tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for a, grams in zip(batch.column("a").to_pylist(), batch.column("grams")):
                if a != of and held:
                    yield vote()
                    held = []
                of = a
                held.append(np.frombuffer(grams.as_py(), dtype=np.uint64))
        if held:
            yield vote()

    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / VOTES).alias("shares"), F.min("b").alias("first"))
    small = F.broadcast if W.is_few(pairs) else lambda df: df
    some = pairs.join(small(shares), "a").where((F.pmod(F.xxhash64("b"), "shares") == 0) | (F.col("b") == F.col("first"))).select("a", "b")
    voters = W.store(some, "voters")
    dealt = sets.join(W.bounded(voters), F.col("node") == F.col("b")).select("a", "b", "grams").repartition("a").sortWithinPartitions("a", "b")
    return W.store(dealt.select("a", "grams").mapInArrow(run, "a long, grams binary"), "centres")


def _differences(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(a, node, root, g, es): of each pair (a, b, root) the difference of b's set from a's centre, and g. Stored."""
    fields = [("a", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("g", pa.int64()), ("es", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _compared(batches, "root"):
            diffs = [np.concatenate((x[~hit], np.setdiff1d(centre, x, assume_unique=True))) for _, _, centre, x, hit, _ in rows]
            g = [(100 + link) * len(d) - (100 - link) * len(r[3]) for d, r in zip(diffs, rows)]
            columns = [r[0] for r in rows], [r[1] for r in rows], [r[5] for r in rows], g, [H.signed(d) for d in diffs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))

    return W.store(_dealt(pairs, sets, _centres(pairs, sets), "root").mapInArrow(run, "a long, node long, root long, g long, es array<long>"), "differences")


def _prefixes(differences: DataFrame, link: int) -> tuple[DataFrame, DataFrame]:
    """(a, e, node, root, i, size, g, looks): the prefixes that partners of other components must meet in; and (a, b): links that follow from the differences' sizes."""
    q2 = 2 * (100 + link)
    first = differences.groupBy("a").agg(F.min(F.struct("g", "node", "root")).alias("o")).select("a", F.col("o.g").alias("g0"), F.col("o.node").alias("o"), F.col("o.root").alias("o_root"))
    first = W.store(first, "nearest")
    far = F.col("g") + F.col("g0") > 0
    placed = differences.join(W.bounded(first), "a").select("a", "node", F.when(far, F.col("root")).otherwise(F.col("o_root")).alias("root"), "g", "g0", "o", far.alias("far"), "es")
    sure = placed.where(~F.col("far") & (F.col("node") != F.col("o"))).select(F.col("o").alias("a"), F.col("node").alias("b"))
    elements = placed.select("a", "node", "root", "g", "g0", "far", F.explode("es").alias("e"))
    met = elements.groupBy("a", "e").agg(F.count("*").alias("times"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("a", "e", "times")
    met = W.store(met, "elements")
    held = elements.join(W.bounded(met), ["a", "e"]).groupBy("a", "node", "root", "g", "g0", "far").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("es"))
    held = W.store(held.withColumn("size", F.size("es").cast("long")), "held")
    # The least g by levels of h: any rounding that keeps the order is on the safe side.
    level = lambda v: F.floor(F.log2(F.greatest(v, F.lit(1).cast("long"))) * 16)
    levels = held.groupBy("a", level(q2 * F.col("size") - F.col("g")).alias("level")).agg(F.min("g").alias("least"))
    stairs = W.store(levels.groupBy("a").agg(F.collect_list(F.struct("level", "least")).alias("stairs")), "stairs")
    least = F.array_min(F.transform(F.filter("stairs", lambda s: s["level"] >= level(F.col("g"))), lambda s: s["least"]))
    looks = F.when(F.col("far"), F.coalesce(F.col("size") + F.floor(-(F.col("g") + least) / q2) + 1, F.lit(0))).otherwise(0)
    found = F.col("size") - F.floor((F.col("g") - F.col("g0")) / q2)
    reach = held.join(W.bounded(stairs, W.BROADCAST_ROWS // 64), "a").withColumn("to", looks).withColumn("upto", F.greatest("to", found, F.lit(0)).cast("int"))
    prefix = reach.select("a", "node", "root", "g", "size", "to", F.posexplode(F.slice("es", F.lit(1), F.col("upto"))).alias("i", "s"))
    return prefix.select("a", "s.e", "node", "root", "i", "size", "g", (F.col("i") < F.col("to")).alias("looks")), sure


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest node that each linked node reaches.

    Labels sink along links and then jump to their label's label, so paths
    halve each turn; every turn is stored.
    """
    both = W.store(links.select("a", "b").unionAll(links.select("b", "a")).distinct(), "links")
    labels = W.store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    # All tables of a turn have a row for each linked node: few, and the joins need no shuffle.
    small = F.broadcast if W.is_few(labels) else lambda df: df
    while True:
        near = both.join(small(labels), F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        sunk = labels.join(small(near), F.col("id") == F.col("a")).select("id", "root", F.least("root", "near").alias("new"))
        old, sunk = labels, W.store(sunk, "sunk")
        ends = sunk.select(F.col("id").alias("at"), F.col("new").alias("further"))
        jumped = W.store(sunk.join(small(ends), F.col("new") == F.col("at"), "left").select("id", F.col("root").alias("was"), F.least("new", F.coalesce("further", "new")).alias("root")), "labels")
        W.drop(old, sunk)
        labels = jumped.select("id", "root")
        labels.stored_at = jumped.stored_at
        if not jumped.where("was <> root").limit(1).count():
            W.drop(both)
            return labels


def buckets_of(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, n, shares) of the keys (key, node) that several nodes have; stored. ``shares`` ranks nodes: how many others they meet."""
    met = W.store(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "keys")
    # Most keys have two nodes: these are known from their ends, and only larger buckets ask for the keys again.
    two = met.where("size = 2").select("key", "size", F.explode(F.array("lo", "hi")).alias("node"))
    large = W.store(met.where("size > 2").select("key", "size"), "large-keys")
    rows = W.store(two.unionByName(keys.join(W.bounded(large), "key").select("key", "size", "node")), "met")
    shares = rows.groupBy("node").agg(F.sum("size").alias("shares"))
    out = W.store(rows.join(shares.join(nodes.select("node", "n"), "node"), "node").select("key", "node", "n", "shares"), "buckets")
    W.drop(met, large, rows)
    return out


def link(buckets: DataFrame, sets: DataFrame, least: int, given: DataFrame | None = None) -> DataFrame:
    """(id, root) of every node that has links, at ``least`` hundredths, or ``given`` ones (a, b); stored."""
    sizes = W.store(buckets.select("node", "n", "shares").distinct(), "sizes")
    near = 100 * F.least("n", "p.n") >= least * F.greatest("n", "p.n")  # sizes that a link allows
    roots, placing, links = None, None, given
    while True:
        heads = buckets.groupBy("key").agg(F.min(F.struct((-F.col("shares")).alias("rank"), "node", "n")).alias("p"))
        members = W.store(buckets.join(heads, "key").where(F.col("node") != F.col("p.node")).select("key", F.col("p.node").alias("a"), "node", "n", near.alias("near")), "members")
        asked = members.where("near").select("a", F.col("node").alias("b")).distinct()
        if roots is not None:
            mine = lambda c, name: placing.select(F.col("id").alias(c), F.col("root").alias(name))
            placed = asked.join(mine("a", "ra"), "a", "left").join(mine("b", "rb"), "b", "left")
            asked = placed.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        asked = W.store(asked, "pairs")
        more = links_of(asked, sets, least)
        before, links = links, W.store(more if links is None else links.unionByName(more), "links")
        roots = components(links)
        placing = W.bounded(roots)
        rest = members.join(placing, F.col("node") == F.col("id"), "left").select("key", "a", "node", "n", F.coalesce("root", "node").alias("root"))
        several = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        left = W.store(rest.join(several, "key", "left_semi").select("a", F.col("node").alias("b"), "root", "n").distinct(), "left")
        W.drop(*(x for x in (members, asked, before) if x is not None and x is not given))
        if not left.limit(1).count():
            return roots
        small = W.bounded(W.store(left.groupBy("a").agg(F.count("*").alias("members")).where(F.col("members") <= SMALL).select("a"), "small"))
        of_small = left.join(small, "a")
        one, other = (of_small.select("a", *(F.col(c).alias(f"{n}_{c}") for c in ("b", "root", "n"))) for n in "xy")
        fits = 100 * F.least("x_n", "y_n") >= least * F.greatest("x_n", "y_n")
        direct = one.join(other, "a").where((F.col("x_b") < F.col("y_b")) & (F.col("x_root") != F.col("y_root")) & fits).select(F.col("x_b").alias("a"), F.col("y_b").alias("b"))
        large = W.store(left.join(small, "a", "left_anti"), "large")
        if not large.limit(1).count():
            return components(W.store(links.unionByName(links_of(W.store(direct.distinct(), "pairs"), sets, least)), "links"))
        differences = _differences(large, sets, least)
        meeting, sure = _prefixes(differences, least)
        meeting = W.store(meeting, "meeting")
        sure = W.store(sure, "sure")
        W.drop(differences)
        apart = meeting.groupBy("a", "e").agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("looks").alias("looks")).where("lo < hi and looks").select("a", "e", "members")
        apart = W.store(apart, "apart")
        few = W.store(meeting.join(W.bounded(apart.where(F.col("members") <= DIRECT)), ["a", "e"]), "few")
        side = lambda n: few.select("a", "e", *(F.col(c).alias(f"{n}_{c}") for c in ("node", "i", "size", "g", "root", "looks")))
        # The first element they share must leave room for all that they need.
        room = 2 * (100 + least) * F.least(F.col("x_size") - F.col("x_i"), F.col("y_size") - F.col("y_i")) >= F.col("x_g") + F.col("y_g")
        once = ~F.col("y_looks") | (F.col("x_node") < F.col("y_node"))
        met = side("x").where("x_looks").join(side("y"), ["a", "e"]).where((F.col("x_root") != F.col("y_root")) & once & room)
        fresh = W.store(met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).unionByName(direct).distinct(), "pairs")
        more = links_of(fresh, sets, least)
        before, links = links, W.store(links.unionByName(more).unionByName(sure), "links")
        W.drop(before, few, fresh, sure)
        new = meeting.join(W.bounded(apart.where(F.col("members") > DIRECT)), ["a", "e"]).select(F.xxhash64("a", "e").alias("key"), "node")
        old, buckets = buckets, W.store(new.join(sizes, "node").select("key", "node", "n", "shares"), "buckets")
        W.drop(old, left, large, meeting, apart)
        if not buckets.limit(1).count():
            return components(links)


def same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b): links between the sets of rows that share a ``doc_id``; none if no id has several. Stored."""
    named = rows.where("n > 0 and doc_id is not null")
    shared = W.store(named.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("shared")), "shared")
    if not shared.limit(1).count():
        return None
    sets = named.join(W.bounded(shared), F.col("doc_id") == F.col("shared")).select("doc_id", "d1", "d2").distinct().join(nodes, ["d1", "d2"]).select("doc_id", "node")
    sets = W.store(sets, "sets-of-shared")
    heads = sets.groupBy("doc_id").agg(F.min("node").alias("a"))
    return W.store(sets.join(heads, "doc_id").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")), "same-document")


def components_of_rows(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row (doc_id, n, d1, d2)."""
    reps = roots.join(nodes.select("node", "rep"), F.col("id") == F.col("node"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    whole = nodes.join(roots.join(least, "root"), F.col("node") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "d1", "d2").join(whole, ["d1", "d2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component"))
    # Rows without a set follow the others of their id, if it has any.
    mixed = W.store(rows.groupBy("doc_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("doc_id is not null and lo = 0 and hi > 0").select(F.col("doc_id").alias("mixed")), "mixed")
    if mixed.limit(1).count():
        known = out.where("component is not null").join(W.bounded(mixed), F.col("doc_id") == F.col("mixed")).groupBy("mixed").agg(F.min("component").alias("theirs"))
        out = out.join(known, F.col("doc_id") == F.col("mixed"), "left").select("doc_id", "n", F.coalesce("component", "theirs").alias("component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
