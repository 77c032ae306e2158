"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from sorted random projections and is refined by
comparing, at every node, its neighbours with each other. Lists full of links
are saturated: they are enlarged by the nearest vectors outside the node's
component, until no further link joins two components. Links are then counted on
whole components, block against block. A brute-force audit measures recall, and
edges at or above the threshold are kept. Cosines that decide are in double
precision; next to the threshold they are summed pair by pair in one order, so a
pair is a link or not wherever it is met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import checkpoint, components, number_rows, partitions
from lattica.llm.simhash import _forest as spanning_labels

THRESHOLD, NEIGHBOURS = 0.95, 12
#: Projection orders at the start, refinement rounds, vectors compared at once.
TREES, ROUNDS, BLOCK = 4, 2, 256
#: Of a node's neighbours, each is offered so many of the others on either side; what is left out shows in the audit.
OFFERS = 4
#: Members of a component compared at once when its links are counted.
CHUNK = 1024
#: Members of a component that look for others in the projection orders, and how often components may be joined.
ENVOYS, ENLARGE = 8, 12
#: Audited vectors at first and at most, how many linked ones outside large groups are wanted among them, and the links from which a group is large.
AUDIT, MOST_AUDIT, WANTED, LARGE = 1000, 8000, 50, 64
#: The recall they must show, and how often more rounds may be added before all blocks are compared.
LEAST_RECALL, RETRIES = 0.97, 2
#: One more projection order for each doubling of the vectors beyond this.
DOUBLED = 4096
#: Cosines from matrix products this near the threshold are computed again.
NEAR = 1e-9


#: Columns of a neighbour graph; own: both ends lie in one component.
EDGES = "a long, b long, sim double, own boolean"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the unit vector in double precision; null for what cannot link (null, zero, null or non-finite parts)."""

    @F.pandas_udf("array<double>")
    def unit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s:
                got = None
                if x is not None and len(x):
                    a = np.array([np.nan if y is None else y for y in x], dtype=np.float64)
                    if np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
                        a = a / top  # so that squares neither overflow nor vanish
                        got = a / np.sqrt((a * a).sum())
                out.append(got)
            yield pd.Series(out)

    return vectors.select("vec_id", unit("embedding").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k greatest of each row but itself: a, b, sim."""
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(ids) - 1)
    if k <= 0:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "sim": np.empty(0)})
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    return pd.DataFrame({"a": ids[rows], "b": ids[best.ravel()], "sim": sims[rows, best.ravel()]})


def decided(sims: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """``sims`` (rows of x by rows of y), with those next to the threshold moved off it to the side of their exact sum.

    Matrix products differ in the last digits with the shape of the block; a
    sum over one pair does not.
    """
    i, j = np.nonzero(np.abs(sims - threshold) < NEAR)
    if i.size:
        sims[i, j] = np.where((x[i] * y[j]).sum(axis=1) >= threshold, threshold + NEAR, threshold - NEAR)
    return sims


def _sides(x: np.ndarray, ids: np.ndarray, roots: np.ndarray, k: int, threshold: float) -> pd.DataFrame:
    """The k greatest of each row outside its component and the k greatest inside (own): a, b, sim, own."""
    sims = decided(x @ x.T, x, x, threshold)
    same = roots[:, None] == roots[None, :]
    inside = _top(np.where(same, sims, -2.0), ids, k).assign(own=True)
    outside = _top(np.where(same, -2.0, sims), ids, k).assign(own=False)
    both = pd.concat([outside, inside])
    return both[both["sim"] > -2.0]


def start_graph(classes: DataFrame, k: int, seed: int, threshold: float, rows: int) -> DataFrame:
    """Neighbours within blocks of vectors that lie next to each other in the order of random hyperplane codes.

    A block is ``BLOCK`` rows whatever the codes' skew, so many near copies fill
    several blocks instead of one large one; it begins with the last quarter of
    the one before. A range of the order holds several blocks at least, and few
    rows are one block.
    """

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, part in frame.groupby(frame["v"].map(len)):
                x = _matrix(part["v"])
                rng = np.random.default_rng(seed + int(dim))
                planes = rng.standard_normal((int(dim), 24))
                bits = (x @ planes[:, :12] > 0) @ (1 << np.arange(12)[::-1])
                fine = x @ planes[:, 12]
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "root": part["root"].to_numpy(), "v": part["v"].to_numpy(), "dim": int(dim), "code": bits.astype(np.int32), "fine": fine})

    coded = classes.select("cid", "root", "v").mapInPandas(code, "cid long, root long, v array<double>, dim int, code int, fine double")
    order = [F.col(c) for c in ("dim", "code", "fine", "cid")]
    ranges = max(1, min(partitions(classes), rows // (8 * BLOCK)))
    dealt = (coded.repartitionByRange(ranges, *order) if ranges > 1 else coded.coalesce(1)).sortWithinPartitions(*order)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in batches:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) > BLOCK:
                yield from block_edges(rest.iloc[:BLOCK])
                rest = rest.iloc[BLOCK - BLOCK // 4 :]
        if rest is not None and len(rest):
            yield from block_edges(rest)

    def block_edges(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in block.groupby("dim"):
            yield _sides(_matrix(part["v"]), part["cid"].to_numpy(), part["root"].to_numpy(), k, threshold)

    return dealt.mapInPandas(compare, EDGES).withColumn("sim", F.round("sim", 12))


def keep_nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k greatest per node inside and outside its component; ranks are limited in every task before rows move."""
    rank = Window.partitionBy("a", "own").orderBy(F.desc("sim"), "b")
    return edges.distinct().withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k).drop("r")


def refine(graph: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: at every node its neighbours, forward and backward, are compared with each other.

    Backward lists hold the k nearest that name the node, so a hub costs no more
    than any node. Each pair offers itself to both ends; the k best stay.
    """
    back = keep_nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "own"), k)
    near = graph.unionAll(back).select("a", "b").distinct()
    carried = near.join(classes.select(F.col("cid").alias("b"), "v", "root"), "b").unionAll(classes.select(F.col("cid").alias("b"), F.col("cid").alias("a"), "v", "root"))

    def local_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, "a"):
            out = []
            for lo, hi in _runs(frame["a"].to_numpy()):
                ids = frame["b"].to_numpy()[lo:hi]
                if hi - lo < 2:
                    continue
                out.append(_sides(_matrix(frame["v"].iloc[lo:hi]), ids, frame["root"].to_numpy()[lo:hi], min(k, OFFERS), threshold))
            if out:
                merged = pd.concat(out)
                merged = merged.drop_duplicates(["a", "b"]).sort_values(["a", "sim"], ascending=[True, False])
                yield merged[merged.groupby(["a", "own"]).cumcount() < k]

    offered = carried.repartition("a").sortWithinPartitions("a").mapInPandas(local_join, EDGES)
    rounded = F.round("sim", 12).alias("sim")  # one pair, one value, whatever block it was computed in
    return keep_nearest(graph.select("a", "b", rounded, "own").unionAll(offered.select("a", "b", rounded, "own")), k)


def with_roots(classes: DataFrame, groups: DataFrame) -> DataFrame:
    return classes.drop("root").join(groups, classes.cid == groups.node, "left").drop("node").withColumn("root", F.coalesce("root", "cid"))


def enlarge(graph: DataFrame, classes: DataFrame, k: int, threshold: float, seed: int) -> DataFrame:
    """The components (node, root) of the links, after saturated lists were enlarged beyond their component.

    Each node keeps its k nearest inside and its k nearest outside its
    component, so a list full of links never hides another group, whatever the
    group's size. Some members of each component enter new projection orders,
    the others learn of what they met by refinement. Ends when no link joins
    two components any more; the audit judges what is left.
    """
    links = graph.filter(F.col("sim") >= threshold).select("a", "b")
    groups = components(links)
    for step in range(ENLARGE):
        placed = checkpoint(with_roots(classes, groups))
        root_of = lambda end: placed.select(F.col("cid").alias(end), F.col("root").alias(f"root_{end}"))
        sided = graph.join(root_of("a"), "a").join(root_of("b"), "b").select("a", "b", "sim", (F.col("root_a") == F.col("root_b")).alias("own"))
        rank = Window.partitionBy("root").orderBy(F.xxhash64("cid", F.lit(seed + step)), "cid")
        envoys = checkpoint(placed.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= ENVOYS).drop("r"))
        many = envoys.count()
        for t in range(TREES):
            sided = sided.unionAll(start_graph(envoys, k, seed + 100 * (step + 1) + t, threshold, many))
        graph = checkpoint(keep_nearest(sided, k))
        for _ in range(ROUNDS):
            graph = checkpoint(refine(graph, placed, k, threshold))
        crossing = checkpoint(graph.filter(~F.col("own") & (F.col("sim") >= threshold)).select("a", "b"))
        if crossing.isEmpty():
            break
        links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(crossing)
        groups = components(links)
    return groups


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, regrouped so that no key is cut in two; groups must be of bounded size."""
    rest = None
    for frame in batches:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[key].iloc[-1]
        cut = int(np.searchsorted((frame[key].to_numpy() != last)[::-1], True)) if frame[key].iloc[0] != last else len(frame)
        rest = frame.iloc[len(frame) - cut :].reset_index(drop=True)
        if cut < len(frame):
            yield frame.iloc[: len(frame) - cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def count_links(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """cid, links: vectors of its component (copies counted) at or above the threshold, itself included.

    Components are dealt in chunks of members, each with its centre and the
    largest angle to it. Two chunks that the triangle inequality settles
    need no comparison; others are compared as blocks, which give counts per
    vector and never a row per pair.
    """
    members = checkpoint(classes.drop("root").join(groups, classes.cid == groups.node).select("root", "cid", "v", "copies"))
    ranked = checkpoint(number_rows(members.select("root", "cid", "copies"), ["cid"], "r", groups=["root"]))
    chunked = members.join(ranked.select(F.col("cid").alias("c"), F.floor(F.col("r") / CHUNK).cast("long").alias("chunk")), F.col("cid") == F.col("c")).drop("c")
    reach = math.acos(threshold)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, "key"):
            for lo, hi in _runs(frame["key"].to_numpy()):
                part = frame.iloc[lo:hi]
                x = _matrix(part["v"])
                centre = x.sum(axis=0)
                norm = np.sqrt((centre * centre).sum())
                centre = centre / norm if norm > 0 else x[0]
                radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
                yield pd.DataFrame({
                    "root": [int(part["root"].iloc[0])], "chunk": [int(part["chunk"].iloc[0])], "ids": [part["cid"].to_numpy()], "copies": [part["copies"].to_numpy()],
                    "x": [x.tobytes()], "centre": [centre], "radius": [radius], "total": [int(part["copies"].sum())],
                })

    keyed = chunked.withColumn("key", F.concat_ws("/", "root", "chunk")).repartition("root", "chunk").sortWithinPartitions("key")
    packed = checkpoint(keyed.mapInPandas(pack, "root long, chunk long, ids array<long>, copies array<long>, x binary, centre array<double>, radius double, total long"))
    heads = packed.select("root", "chunk", "centre", "radius", "total")
    left = heads.select("root", *[F.col(c).alias(f"l_{c}") for c in ("chunk", "centre", "radius")])
    pairs = left.join(heads, "root").withColumn("cos", F.aggregate(F.zip_with("l_centre", "centre", lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))
    spread = F.col("l_radius") + F.col("radius")
    margin = 1e-6
    same = F.col("l_chunk") == F.col("chunk")
    far_end = F.when(same, 2 * F.col("radius")).otherwise(angle + spread)
    sorted_pairs = pairs.withColumn("all", far_end + margin <= reach).withColumn("none", ~same & (angle - spread - margin > reach)).filter("not none")
    settled = sorted_pairs.filter("all").groupBy("root", "l_chunk").agg(F.sum("total").alias("n"))
    whole = packed.select("root", F.col("chunk").alias("l_chunk"), F.explode("ids").alias("cid")).join(settled, ["root", "l_chunk"]).select("cid", "n")
    open_pairs = sorted_pairs.filter("not all").select("root", "l_chunk", "chunk")
    blocks = open_pairs.join(packed.select("root", F.col("chunk").alias("l_chunk"), F.col("ids").alias("l_ids"), F.col("x").alias("l_x")), ["root", "l_chunk"]).join(packed.select("root", "chunk", "copies", F.col("x").alias("r_x")), ["root", "chunk"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for ids, l_x, copies, r_x in zip(frame["l_ids"], frame["l_x"], frame["copies"], frame["r_x"], strict=True):
                a, b = np.frombuffer(l_x).reshape(len(ids), -1), np.frombuffer(r_x).reshape(len(copies), -1)
                if a.shape[1] == b.shape[1]:
                    yield pd.DataFrame({"cid": np.asarray(ids), "n": (decided(a @ b.T, a, b, threshold) >= threshold) @ np.asarray(copies)})

    counted = blocks.select("l_ids", "l_x", "copies", "r_x").repartition(partitions(classes)).mapInPandas(compare, "cid long, n long")
    return whole.unionAll(counted).groupBy("cid").agg(F.sum("n").alias("links"))


def audit(classes: DataFrame, links: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Mean share of its links that is found for each linked vector among the least-hashed ones, compared with every vector.

    Every linked vector weighs the same; those with fewer than ``LARGE`` links
    are averaged apart as well, and the lower mean counts, so a hot group cannot
    cover for lost pairs. More are asked while fewer than ``WANTED`` of those are met.
    """
    while True:
        asked = classes.orderBy(F.xxhash64("cid"), "cid").limit(queries).select("cid", "v").collect()  # at most MOST_AUDIT rows
        if not asked:
            return 1.0
        dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(r.v) for r in asked}:
            own = [r for r in asked if len(r.v) == dim]
            dims[dim] = (np.array([r.cid for r in own]), np.array([r.v for r in own]))

        def brute(batches: Iterator[pd.DataFrame], dims: dict = dims) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for dim, part in frame.groupby(frame["v"].map(len)):
                    if int(dim) in dims:
                        ids, q = dims[int(dim)]
                        for at in range(0, len(part), CHUNK):
                            some = part.iloc[at : at + CHUNK]
                            x = _matrix(some["v"])
                            yield pd.DataFrame({"q": ids, "n": (decided(q @ x.T, q, x, threshold) >= threshold) @ some["copies"].to_numpy()})

        truth = classes.mapInPandas(brute, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
        found = truth.join(links, truth.q == links.cid, "left").join(classes.select(F.col("cid").alias("c"), "copies"), F.col("q") == F.col("c"))
        # a class of copies is judged by its links to others
        linked = found.filter("n > copies").withColumn("share", (F.coalesce("links", "copies") - F.col("copies")) / (F.col("n") - F.col("copies")))
        few = F.col("n") - F.col("copies") < LARGE
        mean, small, met = linked.agg(F.avg("share"), F.avg(F.when(few, F.col("share"))), F.count(F.when(few, 1))).first()
        if met >= WANTED or len(asked) < queries or queries >= MOST_AUDIT:
            return min(1.0 if mean is None else mean, 1.0 if small is None else small)
        queries = min(MOST_AUDIT, 4 * queries)


def every_link(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect the vectors as all links do, by comparing every block with every block.

    In time that grows with the square of the table; a pair of blocks returns a
    spanning forest of its links. Taken only where the audit stays too low.
    """
    rows = classes.count()
    blocks = max(1, -(-rows // CHUNK))
    keyed = classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("long")).withColumn("dim", F.size("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, "key"):
            for lo, hi in _runs(frame["key"].to_numpy()):
                part = frame.iloc[lo:hi]
                yield pd.DataFrame({"dim": [int(part["dim"].iloc[0])], "block": [int(part["block"].iloc[0])], "ids": [part["cid"].to_numpy()], "x": [_matrix(part["v"]).tobytes()]})

    sorted_rows = keyed.select("cid", "v", "dim", "block", F.concat_ws("/", "dim", "block").alias("key")).repartition("key").sortWithinPartitions("key")
    packed = checkpoint(sorted_rows.mapInPandas(pack, "dim int, block long, ids array<long>, x binary"))
    left = packed.select("dim", *[F.col(c).alias(f"l_{c}") for c in ("block", "ids", "x")])
    pairs = left.join(packed, "dim").filter("l_block <= block").repartition(partitions(classes), "l_block", "block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for l_ids, l_x, ids, x in zip(frame["l_ids"], frame["l_x"], frame["ids"], frame["x"], strict=True):
                left, right = np.asarray(l_ids), np.asarray(ids)
                p, q = np.frombuffer(l_x).reshape(len(left), -1), np.frombuffer(x).reshape(len(right), -1)
                i, j = np.nonzero(decided(p @ q.T, p, q, threshold) >= threshold)
                nodes, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
                label = spanning_labels(len(nodes), iter([(at[: len(i)], at[len(i) :])]))
                own = np.flatnonzero(label != np.arange(len(label)))
                yield pd.DataFrame({"a": nodes[own], "b": nodes[label[own]]}, dtype=np.int64)

    return pairs.select("l_ids", "l_x", "ids", "x").mapInPandas(compare, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (as audited), one row per vector.

    Links join vectors of one dimension at cosine >= ``threshold``; null, zero
    and non-finite ones link with nothing. Vectors with one direction bit for
    bit are one class and count by their copies. Pairs found are exact; some may
    be missed, as the audited recall tells; where it stays under ``LEAST_RECALL``,
    every block is compared with every block and none is missed. Null vec_ids and repeated ids are
    kept as rows; a repeated id counts as another vector and joins its twins'
    component. Labels and further columns are not looked at.
    """
    units = checkpoint(unit_vectors(vectors))
    able = units.filter("v is not null")
    keyed = able.withColumn("key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    names = keyed.groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = checkpoint(number_rows(checkpoint(names), ["key"], "cid").withColumn("root", F.col("cid")))
    graph = None
    rows = classes.count()
    trees = TREES + max(0, math.ceil(math.log2(max(1, rows) / DOUBLED)))
    for trial in range(RETRIES + 1):
        starts = [start_graph(classes, k, 1000 * trial + t, threshold, rows) for t in range(trees)]
        offered = starts[0]
        for s in starts[1:]:
            offered = offered.unionAll(s)
        graph = checkpoint(keep_nearest(offered if graph is None else offered.unionAll(graph), k))
        for _ in range(ROUNDS):
            graph = checkpoint(refine(graph, classes, k, threshold))
        groups = enlarge(graph, classes, k, threshold, 1000 * trial + 500)
        links = checkpoint(count_links(classes, groups, threshold))
        recall = audit(classes, links, threshold)
        if recall >= LEAST_RECALL:
            break
    else:
        groups = components(every_link(classes, threshold))
        links = checkpoint(count_links(classes, groups, threshold))
        recall = audit(classes, links, threshold)
    rooted = with_roots(classes, groups)
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").join(links.withColumnRenamed("cid", "l_cid"), F.col("cid") == F.col("l_cid"), "left")
    per_class = named.select(F.col("key").alias("k"), (F.coalesce("links", "copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = keyed.join(per_class, F.col("key") == F.col("k")).select("vec_id", "n_links", "component_id")
    alone = units.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(recall)))
