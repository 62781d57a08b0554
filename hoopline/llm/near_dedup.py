"""Near duplicates by a chosen-path similarity join on word shingles.

A document's set is its distinct shingles of five words (fewer words: all of them as one). Documents with equal sets form
a class, and only classes are compared. Each of ``TREES`` independent trees starts with one node of all classes and
branches on the class's values of minwise hashes, that is on chosen tokens of its set; two sets of similarity s stay together
over k hashes with probability s^k. Nodes of at most ``NODE`` classes are compared exhaustively. Larger nodes branch again, on
``LEVELS`` hashes in all, and on each level all their classes are compared with one hub, in chunks. A node that is still large at
the last level compares the classes outside its largest component with all the others, in blocks, so no candidate is
dropped. Each tree has hashes of its own. In small nodes one tree finds a link of similarity 0.75 with probability 0.75, so 16 trees miss one link in 4^16; a
link in nodes that have to branch twice (whose shared shingles many other classes hold) is found with probability 0.75^6 = 0.178 in each tree,
and 16 trees would miss 4.3 % of them. So classes in nodes that reach the last level go on through ``DEEP_TREES`` trees on that level, which miss 0.004 %.

Trees run in rounds. After each round the links found are merged into components, and later rounds compare only classes
of different components. The ``HASHES`` minwise values of two classes, one byte of each, must agree in at least ``AGREE`` places (a link of
0.75 fails that in less than one of 21,000 pairs); then the full sets are compared exactly.

Links leave a node as a spanning forest, never as all pairs. Sets are digests of 64 bits; classes are told apart by a 64-bit digest of the set.

Null, empty and blank texts have an empty set and are linked with nothing. Documents are told apart by id and text: repeated rows
share their fate. Rows with a null id are linked like others and never named; a component without any id stays whole. Very long texts are read whole, an empty table
gives no rows, and of other columns, whatever their names, nothing is read; where rows are kept they keep all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import read_table, saved, skewed_lookup
from hoopline.llm.shingles import mixed, shingle_set

#: Trees of all classes, and hashes of their own for each.
TREES, HASHES = 16, 96
#: Trees, those included, of classes whose nodes are large down to the last level.
DEEP_TREES = 52
#: How many hashes name a node on each level that is looked at.
LEVELS = (1, 3, 6)
#: First and last tree, and levels, of each round. The first rounds only gather what is easy to find.
ROUNDS = ((0, 1, LEVELS[:1]), (1, 4, LEVELS[:1]), (0, TREES, LEVELS))
NODE = 256
SIMILARITY = (75, 100)
AGREE = 55
#: Only rows of a few fixed-width columns are broadcast, at most 40 bytes each, so 16 MB.
BROADCAST_ROWS = 400_000
DIGEST_BYTES = 5
MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, DEEP_TREES * LEVELS[-1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray, multipliers: np.ndarray = MULTIPLIERS[:HASHES]) -> np.ndarray:
    """The smallest value of each hash over the set, as 32-bit numbers."""
    best = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        best = np.minimum(best, (shingles[k : k + 2048, None] * multipliers).min(0))
    return (mixed(best) >> np.uint64(32)).astype("<u4")


def short(values: np.ndarray) -> bytes:
    """One byte of each minwise value. Equal values have equal bytes, so no link is lost; others agree by chance in one of 256."""
    return values.astype("<u4").view(np.uint8)[::4].tobytes()


def packed(shingles: np.ndarray) -> bytes:
    """The top DIGEST_BYTES of each digest. Two sets of 600 see one wrong match in three million pairs."""
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGEST_BYTES :]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // DIGEST_BYTES, 8), np.uint8)
    out[:, 8 - DIGEST_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, DIGEST_BYTES)
    return out.view("<u8").reshape(-1)


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``text_hash``, ``n_shingles``, ``cls`` (null: empty set), ``sig``, ``short`` and ``shingles`` as bytes, ``row_no``."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                sets = [shingle_set(t) for t in part["text"]]
                name = [int(mixed(mixed(s).sum(keepdims=True) + np.bitwise_xor.reduce(s) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else None for s in sets]
                values = [minwise(s) if len(s) else s for s in sets]
                yield pd.DataFrame(
                    {
                        "id": part["id"], "text_hash": part["text_hash"], "n_shingles": [len(s) for s in sets], "cls": pd.array(name, "Int64"),
                        "sig": [v.tobytes() if len(v) else None for v in values], "short": [short(v) if len(v) else None for v in values], "shingles": [packed(s) for s in sets],
                    }
                )

    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()
    return rows.mapInPandas(sketch, f"id {id_type}, text_hash long, n_shingles long, cls long, sig binary, short binary, shingles binary").withColumn("row_no", F.monotonically_increasing_id())


def components(edges: DataFrame) -> DataFrame:
    """``cls``, ``comp`` (smallest of the component) for every end of ``edges`` (a, b).

    Each end points to its smallest neighbour below it; paths are halved until all point to roots, edges move to the
    roots, and this goes on while an edge joins two roots.
    """
    left = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    ends = left.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    labels = saved(ends.select("cls", F.col("cls").alias("comp")), "labels")
    while not left.isEmpty():
        parent = saved(left.groupBy("a").agg(F.min("b").alias("root")), "parents")
        while True:
            up = parent.select(F.col("a").alias("root"), F.col("root").alias("higher"))
            parent = saved(parent.join(up, "root", "left").select("a", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "parents")
            if parent.filter("moved").isEmpty():
                break
        labels = saved(labels.join(parent.select(F.col("a").alias("comp"), "root"), "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp")), "labels")
        to_root = lambda end: parent.select(F.col("a").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: E731, B023
        moved = left.join(to_root("a"), "a", "left").join(to_root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
        left = saved(moved.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return labels


def _by_group(work: Callable[[dict], dict | None], names: list[str]):
    """A function over batches of rows sorted by ``sub`` that calls ``work`` with the rows of one value at a time.

    A group lies in one partition but may lie in several batches; only one group is held beside the batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in chain(batches, [None]):
            if batch is None:
                whole = pd.concat(rest, ignore_index=True) if rest else None
            elif not len(batch):
                continue
            elif rest and batch["sub"].iloc[0] == batch["sub"].iloc[-1] == rest[0]["sub"].iloc[-1]:
                rest.append(batch)
                continue
            else:
                whole = pd.concat([*rest, batch], ignore_index=True)
            if whole is None:
                return
            sub = whole["sub"].to_numpy()
            bounds = [0, *(np.flatnonzero(sub[1:] != sub[:-1]) + 1).tolist(), len(sub)]
            columns = {c: whole[c].to_numpy() for c in whole.columns}
            last = bounds[-2] if batch is not None else len(sub)
            found = [work({c: v[i:j] for c, v in columns.items()}) for i, j in zip(bounds[:-1], bounds[1:], strict=True) if i < last]
            found = [f for f in found if f is not None]
            if found:
                yield pd.DataFrame({n: np.concatenate([f[n] for f in found]) for n in names})
            rest = [whole.iloc[last:]] if last < len(sub) else []

    return run


def _promising(node: dict) -> dict | None:
    """Clusters of a node whose hash values leave a link between two components possible, named by their members."""
    # A class can come twice, as a hub and as a member of the hub's chunk; the left one counts.
    order = np.lexsort((~node["left"], node["cls"]))
    order = order[np.concatenate([[True], node["cls"][order][1:] != node["cls"][order][:-1]])]
    node = {c: v[order] for c, v in node.items()}
    n, comp, left = len(order), node["comp"], node["left"]
    sigs = np.frombuffer(b"".join(node["short"]), np.uint8).reshape(n, HASHES)
    parent, seen = list(range(n)), np.zeros(n, bool)
    for k in np.flatnonzero(left).tolist():
        near = ((sigs == sigs[k]).sum(1) >= AGREE) & (comp != comp[k])
        for other in np.flatnonzero(near).tolist():
            seen[k] = seen[other] = True
            parent[_root(parent, other)] = _root(parent, k)
    own = np.flatnonzero(seen)
    if not len(own):
        return None
    cluster = np.array([_root(parent, k) for k in own.tolist()])
    digests = mixed(node["cls"][own].astype(np.uint64) * np.uint64(2) + left[own].astype(np.uint64))
    _, place = np.unique(cluster, return_inverse=True)
    sums = np.zeros(place.max() + 1, np.uint64)
    np.add.at(sums, place, digests)
    return {"sub": mixed(sums)[place].astype(np.int64), "row_no": node["row_no"][own], "cls": node["cls"][own], "comp": comp[own], "left": left[own]}


def _root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _linked(sub: dict) -> dict | None:
    """A spanning forest of the exact links between components: each left row against all others."""
    comp, names = sub["comp"], sub["cls"]
    sets = [unpacked(s) for s in sub["shingles"]]
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.reshape(-1)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)
    _, first, inverse = np.unique(comp, return_index=True, return_inverse=True)
    parent = first[inverse.reshape(-1)].tolist()
    edges = []
    for k in np.flatnonzero(sub["left"]).tolist():
        own = ids[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        both = np.add.reduceat(mark[ids].astype(np.int64), starts)
        mark[own] = False
        for other in np.flatnonzero(both * SIMILARITY[1] >= (sizes + sizes[k] - both) * SIMILARITY[0]).tolist():
            a, b = _root(parent, k), _root(parent, other)
            if a != b:
                parent[b] = a
                edges.append((names[k], names[other]))
    return {"a": np.array([a for a, _ in edges]), "b": np.array([b for _, b in edges])} if edges else None


def _node_of(tree: Column, level: int) -> Column:
    """Name of a class's node on ``level`` of ``tree``: the values of the chosen hashes on the way there, which are neighbours in ``sig``."""
    return F.xxhash64(tree, F.lit(level), F.substring("sig", tree * (4 * LEVELS[-1]) + 1, F.lit(4 * level)))


def _candidate_nodes(classes: DataFrame, comps: DataFrame | None, first: int, end: int, levels: tuple[int, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Rows (sub, cls, comp, left) of the groups to compare, for some trees and levels; and the classes (cls) that reached the last level, if any.

    Nodes are named before the rows of a class become one for each tree, so that only names and components travel; on the next level
    signatures are fetched for the classes that go on, and go no further than to the name of the node.
    """
    if comps is None:
        known = classes.select("cls", "sig", F.col("cls").alias("comp"))
    else:
        known = classes.select("cls", "sig").join(comps, "cls", "left").select("cls", "sig", F.coalesce("comp", "cls").alias("comp"))
    nodes = [F.struct(F.lit(t).alias("tree"), _node_of(F.lit(t), levels[0]).alias("node")) for t in range(first, end)]
    placed = known.select("cls", "comp", F.explode(F.array(*nodes)).alias("at")).select("cls", "comp", "at.tree", "at.node")
    groups, deep, large = [], None, None
    for level in levels:
        if large is not None:
            # A class meets its signature once, with the list of its trees.
            lists = large.groupBy("cls", "comp").agg(F.collect_list("tree").alias("trees"))
            below = F.transform("trees", lambda t: F.struct(t.alias("tree"), _node_of(t, level).alias("node")))  # noqa: B023
            placed = lists.join(classes.select("cls", "sig"), "cls").select("cls", "comp", F.inline(below))
            if level == LEVELS[-1]:
                deep = large.select("cls").distinct()
        elif level == LEVELS[-1]:
            deep = classes.select("cls")
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cls").alias("hub"))
        sizes = saved(sizes.filter("low != high").select("node", "n", "hub"), "nodes")
        members = saved(placed.join(sizes, "node").select("cls", "comp", "tree", "node", "n", "hub"), "members_of_nodes")
        groups.append(members.filter(F.col("n") <= NODE).select(F.col("node").alias("sub"), "cls", "comp", F.lit(True).alias("left")))
        large = members.filter(F.col("n") > NODE)
        if large.isEmpty():
            break
        chunks = F.ceil(F.col("n") / NODE).cast("int")
        chunk = lambda k: F.xxhash64("node", k.cast("int"), F.lit("hub"))
        of_hub = large.filter("cls = hub").select(F.explode(F.transform(F.sequence(F.lit(0), chunks - 1), chunk)).alias("sub"), "cls", "comp", F.lit(True).alias("left"))
        others = large.filter("cls != hub").select(chunk(F.pmod(F.xxhash64("cls", F.lit(level)), chunks)).alias("sub"), "cls", "comp", F.lit(False).alias("left"))
        groups += [of_hub, others]
        if level == LEVELS[-1]:
            groups.append(_blocks(large))
    return saved(reduce(DataFrame.unionByName, groups), "groups"), deep


def _blocks(members: DataFrame) -> DataFrame:
    """What is left over: in each node the classes outside its largest component, in blocks, against blocks of all others."""
    main = members.groupBy("node", "comp").count().groupBy("node").agg(F.max(F.struct("count", "comp")).alias("m")).select("node", F.col("m.comp").alias("main"))
    marked = members.join(main, "node").withColumn("stray", F.col("comp") != F.col("main"))
    strays = marked.filter("stray").groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    marked = marked.join(strays, "node")
    rows, columns = F.ceil(F.col("s") / NODE).cast("int"), F.ceil(F.col("n") / NODE).cast("int")
    block = lambda i, j: F.xxhash64("node", i.cast("int"), j.cast("int"), F.lit("block"))
    own_row, own_column = F.pmod(F.xxhash64("cls", F.lit("r")), rows), F.pmod(F.xxhash64("cls", F.lit("c")), columns)
    left = marked.filter("stray").select(F.explode(F.transform(F.sequence(F.lit(0), columns - 1), lambda j: block(own_row, j))).alias("sub"), "cls", "comp", F.lit(True).alias("left"))
    right = marked.select(F.explode(F.transform(F.sequence(F.lit(0), rows - 1), lambda i: block(i, own_column))).alias("sub"), "cls", "comp", F.lit(False).alias("left"))
    return left.unionByName(right)


def _small(rows: DataFrame) -> DataFrame:
    """Narrow ``rows`` (a written table) to be broadcast if they are few enough, else as they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def link_classes(sketch: DataFrame) -> DataFrame:
    """``cls``, ``comp`` of all classes that are linked with another one; ``sketch`` is a written table."""
    one = sketch.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("row_no").alias("row_no"), F.min("sig").alias("sig"), F.min("short").alias("short"))
    classes = saved(one, "classes")
    comps, edges, deep = None, None, None
    for first, end, levels in ROUNDS:
        groups, deep = _candidate_nodes(classes, comps, first, end, levels)
        found = _links_of_groups(sketch, classes, groups)
        edges = found if edges is None else edges.unionByName(found)
        comps = components(edges)
    if deep is None:
        return comps
    deep = saved(deep, "deep")
    rows = saved(classes.join(_small(deep), "cls", "left_semi").select("cls", "row_no"), "deep_rows")
    further = saved(sketch.drop("cls").join(_small(rows), "row_no").select("cls", "shingles").mapInPandas(_further_values, "cls long, sig binary"), "further_values")
    groups, _ = _candidate_nodes(further, comps, 0, DEEP_TREES - TREES, LEVELS[-1:])
    return components(edges.unionByName(_links_of_groups(sketch, classes, groups)))


def _further_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values of the trees beyond the first ``TREES``. Digests are cut to ``DIGEST_BYTES`` here, for all sets alike."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            yield pd.DataFrame({"cls": part["cls"], "sig": [minwise(unpacked(s), MULTIPLIERS[HASHES:]).tobytes() for s in part["shingles"]]})


def _links_of_groups(sketch: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """The exact links (a, b) that join components inside the groups.

    A class is joined with its values once, whatever the number of its groups: these are a list of 16 bytes each, a few for every tree and, for
    hubs and for what ``_blocks`` compares, one for every ``NODE`` classes of the node.
    """
    lists = groups.groupBy("cls", "comp").agg(F.collect_list(F.struct("sub", "left")).alias("subs"))
    with_sig = classes.select("cls", "row_no", "short").join(lists, "cls").select("cls", "comp", "row_no", "short", F.inline("subs"))
    grouped = with_sig.repartition("sub").sortWithinPartitions("sub")
    names = ["sub", "row_no", "cls", "comp", "left"]
    promising = grouped.mapInPandas(_by_group(_promising, names), "sub long, row_no long, cls long, comp long, left boolean")
    promising = saved(promising.distinct(), "promising")
    # What is promising is broadcast to the sets while it is small, so that sets travel once, to their groups.
    with_set = sketch.select("row_no", "shingles").join(_small(promising), "row_no").select("sub", "cls", "comp", "left", "shingles")
    found = with_set.repartition("sub").sortWithinPartitions("sub").mapInPandas(_by_group(_linked, ["a", "b"]), "a long, b long")
    return saved(found, "links")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``text_hash``, ``n_shingles``, ``component_id``, ``kept``."""
    sketch = saved(sketches(docs, id_column, text_column), "sketches")
    comps = link_classes(sketch)
    lowest = sketch.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("low"))
    classes = saved(lowest.join(comps, "cls", "left").select("cls", "low", F.coalesce("comp", "cls").alias("comp")), "class_ids")
    by_comp = saved(classes.groupBy("comp").agg(F.min("low").alias("component_id")), "component_ids")
    by_class = saved(skewed_lookup(classes, by_comp, "comp").select("cls", "component_id"), "class_components")
    full = saved(sketch.filter(F.col("cls").isNotNull()).select("id", "text_hash", "n_shingles", "cls"), "members")
    linked = skewed_lookup(full, by_class, "cls").select("id", "text_hash", "n_shingles", "component_id")
    alone = sketch.filter(F.col("cls").isNull()).select("id", "text_hash", "n_shingles", F.col("id").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_column), "text_hash", "n_shingles", "component_id", kept.alias("kept"))


def keep_one_near_copy(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; columns as they were."""
    marked = near_duplicates(docs, id_column, text_column)
    gone = saved(marked.filter("NOT kept").select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_text_hash")).distinct(), "near_copies")
    here = F.xxhash64(F.coalesce(docs[text_column], F.lit("")))
    return docs.join(gone, docs[id_column].eqNullSafe(gone["_id"]) & (here == gone["_text_hash"]), "left_anti")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component of near duplicates."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
