"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

A text is the set of its shingles (five words each).  Each tree of the forest is a sequence of minima under random hash
functions; two texts of similarity s share a prefix of k minima with probability s**k.  The forest is used at one fixed
depth, the longest that has the target recall at the threshold (``depth_for``): texts meet on equal prefixes of that
length, as in LSH banding, and no longer prefix is tried first.  Then

1. Spark counts the texts below each trie node of that depth; nodes of one text end there;
2. the texts of a node (slim rows: their nodes in all trees) tell who has a pair that no earlier tree holds;
3. only these send their shingle sets, and each pair is verified in the first tree that holds it.

A node of more than ``PART`` texts, however many, is dealt out: it is cut into parts by row, and every two parts meet in
a task of their own, so no task holds more than two parts and no pair is lost.  Copies of a text are joined once, by
their first row.  Pairs never become rows: a task returns the number of links of each text and a spanning star of each
connected group; Spark then joins the stars to classes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrials.llm import blocks as B
from codetrials.plans.scratch import scratch_path

SHINGLE, THRESHOLD, TREES, RECALL = 5, 0.8, 20, 0.9999
DEEPEST = 8
PART = 1024
SEED = 11
SKETCH = "home long, block long, bucket long, payload binary"
LINKS = "row long, other long, n long"


def depth_for(threshold: float, trees: int, recall: float, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair on the threshold meets in some tree with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text: its distinct shingle hashes in order; a text of fewer words, but not none, is one shingle."""
    data = B.LOWER[data]
    begin, end = B.words_of(data, B.MARKS)
    doc = np.searchsorted(ends, begin, side="right")
    name = B.span_hash(B.prefix_sums(data, SEED), begin, end)
    first = np.searchsorted(doc, np.arange(len(ends)))
    after = np.searchsorted(doc, np.arange(len(ends)), side="right")
    fold = np.zeros(max(0, len(name) - size + 1), dtype=np.uint64)
    for j in range(size):
        fold = fold * np.uint64(0xD6E8FEB86659FD93) + name[j : j + len(fold)]
    fold = B.mixed(fold)
    out = []
    for k in range(len(ends)):
        a, z = first[k], after[k]
        if not wanted[k] or a == z:
            out.append(np.empty(0, dtype=np.uint64))
        elif z - a >= size:
            out.append(np.unique(fold[a : z - size + 1]))
        else:
            short = np.array([z - a], dtype=np.uint64)
            for h in name[a:z]:
                short = short * np.uint64(0xA0761D6478BD642F) + h
            out.append(B.mixed(short))
    return out


def labels_of(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """The trie node of each text at ``depth`` in each tree; a row per text."""
    draw = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (trees, DEEPEST, 2), dtype=np.uint64)
    every = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), trees), dtype=np.uint64)
    for t in range(trees):
        node = np.full(len(sets), t + 1, dtype=np.uint64)
        for a, b in draw[t, :depth]:
            least = np.minimum.reduceat(every * (a * np.uint64(2) + np.uint64(1)) + b, at)
            node = B.mixed(node * np.uint64(3) + B.mixed(least))
        out[:, t] = node
    return out


# --- in the buckets ------------------------------------------------------------------------------------------------


def counted(rows):
    """Answer each block with the number of texts below each of its nodes."""
    parts = [np.frombuffer(p, dtype=COUNT) for _, p in rows]
    every = np.concatenate(parts)
    order = np.argsort(every["node"], kind="stable")
    edge = B.edges(every["node"][order])
    total = np.empty(len(every), dtype=np.int64)
    total[order] = np.repeat(np.add.reduceat(every["n"][order], edge), np.diff(np.append(edge, len(order))))
    at = 0
    for (k, _), own in zip(rows, parts, strict=True):
        crowd = total[at : at + len(own)] > 1
        yield k, np.stack([own["node"][crowd], total[at : at + len(own)][crowd].astype(np.uint64)]).tobytes()
        at += len(own)


COUNT = np.dtype([("node", "<u8"), ("n", "<i8")])


def member(trees: int) -> np.dtype:
    return np.dtype([("node", "<u8"), ("row", "<i8"), ("tree", "<i4"), ("nodes", "<u8", (trees,))])


def needed(trees: int):
    def answer(rows):
        """Answer each block with the (node, row) that have a pair no earlier tree holds."""
        parts = [np.frombuffer(p, dtype=member(trees)) for _, p in rows]
        every = np.concatenate(parts)
        source = np.repeat([k for k, _ in rows], [len(p) for p in parts])
        order = np.argsort(every["node"], kind="stable")
        every, source = every[order], source[order]
        edge = np.append(B.edges(every["node"]), len(every))
        keep = np.zeros(len(every), dtype=bool)
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            tree = every["tree"][a]
            fresh = fresh_pairs(every["nodes"][a:z, :tree], every["nodes"][a:z, :tree])
            np.fill_diagonal(fresh, False)
            keep[a:z] = fresh.any(axis=1)
        for k in np.unique(source).tolist():
            at = keep & (source == k)
            if at.any():
                yield k, np.stack([every["node"][at], every["row"][at].astype(np.uint64)]).tobytes()

    return answer


def fresh_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share no node of the trees given."""
    fresh = np.ones((len(left), len(right)), dtype=bool)
    for t in range(left.shape[1]):
        fresh &= left[:, t, None] != right[None, :, t]
    return fresh


def similar(left: list, right: list, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets have at least the Jaccard similarity ``threshold``."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    every = np.concatenate(left + right)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    # shingles of one text alone meet nothing
    held = count[column] > 1
    row, column = row[held], column[held]
    rank = np.cumsum(count > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    wide = 4096
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, wide):
        a, z = np.searchsorted(column, [at, at + wide])
        grid = np.zeros((len(left) + len(right), wide), dtype=np.float32)
        grid[row[a:z], column[a:z] - at] = 1
        common += grid[: len(left)] @ grid[len(left) :].T
    common = np.rint(common).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    # in whole numbers: no rounding decides on the threshold
    scale = 1_000_000
    return common * scale >= round(threshold * scale) * union


def verified(threshold: float, trees: int):
    def run(key, table):
        groups: dict = defaultdict(lambda: ([], []))
        for node, p, q, mine, row, tree, nodes, shingles in zip(
            *(table.column(c).to_pylist() for c in ("node", "p", "q", "mine", "row", "tree", "nodes", "shingles")), strict=True
        ):
            item = (row, np.frombuffer(nodes, dtype=np.uint64)[:tree], np.frombuffer(shingles, dtype=np.uint64))
            groups[node, p, q][0 if mine == p else 1].append(item)
        out = []
        for (_, p, q), (left, right) in groups.items():
            if p == q:
                right = left
            if not left or not right:
                continue
            # pairs that an earlier tree has are not compared again
            fresh = fresh_pairs(np.array([n for _, n, _ in left]), np.array([n for _, n, _ in right]))
            if not fresh.any():
                continue
            hit = similar([s for _, _, s in left], [s for _, _, s in right], threshold) & fresh
            rows = np.array([r for r, _, _ in left]), np.array([r for r, _, _ in right])
            if p == q:
                np.fill_diagonal(hit, False)
            links = defaultdict(int)
            for side, axis in ((0, 1), (1, 0))[: 1 if p == q else 2]:
                for r, n in zip(rows[side].tolist(), hit.sum(axis=axis).tolist(), strict=True):
                    links[r] += n
            root = _roots(rows, hit)
            out += [(r, root[r], n) for r, n in links.items() if n]
        return pa.Table.from_batches(list(B.packed(out, LINKS)), B.arrow_schema(LINKS))

    return run


def _roots(rows: tuple, hit: np.ndarray) -> dict:
    """The smallest row of each row's connected group within a task."""
    root = {r: r for side in rows for r in side.tolist()}
    best = np.minimum(rows[0], np.where(hit, rows[1][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
    while True:
        right = np.minimum(np.array([root[r] for r in rows[1].tolist()]), np.where(hit, best[:, None], np.iinfo(np.int64).max).min(axis=0))
        left = np.minimum(best, np.where(hit, right[None, :], np.iinfo(np.int64).max).min(axis=1))
        for side, value in ((0, left), (1, right)):
            for r, v in zip(rows[side].tolist(), value.tolist(), strict=True):
                root[r] = min(root[r], v)
        if (left == best).all():
            return root
        best = left


# --- the join ------------------------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    trees: int = TREES,
    recall: float = RECALL,
    part: int = PART,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``copy_of``, the smallest id that has the same text; ``n_links``, the number of other texts
    whose similarity to it is at least ``threshold``; ``class_id``, the smallest id of its connected class; ``keeps``,
    whether it is the row of its class to keep; ``digest``, the first 32 hexadecimal digits of the text's SHA-256.

    Words are lower-cased runs of letters, digits and non-ASCII characters.  A null, empty or wordless text has no
    shingles and links to none; such rows still have the class of their copies.  Null ids count as largest.  Rows that
    are repeated are copies.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    depth = depth_for(threshold, trees, recall)
    packed = B.pack(docs, key, text)
    copies = B.first_copies(packed)
    buckets = B.bucket_count(packed)

    def sketch(block, answers):
        first = ~B.later_rows(block, answers)
        sets = shingle_sets(block.data, block.ends, first, shingle)
        at = np.flatnonzero([len(s) > 0 for s in sets])
        nodes = labels_of([sets[k] for k in at], trees, depth) if len(at) else np.empty((0, trees), dtype=np.uint64)
        yield block.number >> B.HOME_BITS, block.number, 0, at.astype(np.int64).tobytes() + nodes.tobytes()

    path = scratch_path(spark, "forest")
    B.told(packed, copies, sketch, SKETCH).write.parquet(path)
    forest = spark.read.schema(SKETCH).parquet(path)

    def unpacked(payload):
        n = len(payload) // (8 * (trees + 1))
        raw = np.frombuffer(payload, dtype=np.uint64)
        return raw[:n].astype(np.int64), raw[n:].reshape(n, trees)

    def count(batches):
        for batch in batches:
            for number, payload in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                node, n = np.unique(unpacked(payload)[1], return_counts=True)
                own = np.empty(len(node), dtype=COUNT)
                own["node"], own["n"] = node, n
                yield from B.packed([(b, number, own[at].tobytes()) for b, at in B.by_bucket(node, buckets)], B.ASKED)

    counts = B.answered(forest.mapInArrow(count, B.ASKED), counted)

    def crowds(left, right):
        """(block, rows, nodes, crowded nodes, their numbers of texts) of each block of a home."""
        told = defaultdict(list)
        for number, payload in zip(right.column("block").to_pylist(), right.column("payload").to_pylist(), strict=True):
            told[number].append(np.frombuffer(payload, dtype=np.uint64).reshape(2, -1))
        for number, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist(), strict=True):
            if number in told:
                node, n = np.concatenate(told[number], axis=1)
                order = np.argsort(node)
                yield number, *unpacked(payload), node[order], n[order].astype(np.int64)

    def members(left, right):
        out = []
        for number, at, nodes, crowded, n in crowds(left, right):
            crowded = crowded[n <= part]
            for t in range(trees):
                here = np.flatnonzero(B.among(nodes[:, t], crowded))
                row = np.empty(len(here), dtype=member(trees))
                row["node"], row["row"], row["tree"] = nodes[here, t], (number << B.ROW_BITS) + at[here], t
                row["nodes"] = nodes[here]
                row = row[np.argsort(row["node"], kind="stable")]
                out += [(b, number, row[k].tobytes()) for b, k in B.by_bucket(row["node"], buckets)]
        return pa.Table.from_batches(list(B.packed(out, B.ASKED)), B.arrow_schema(B.ASKED))

    by_home = forest.groupBy("home")
    slim = B.answered(by_home.cogroup(counts.groupBy("home")).applyInArrow(members, B.ASKED), needed(trees))

    def hot(left, right):
        """Nodes of more than a part go on with all their texts: (node, row, texts below it)."""
        out = []
        for number, at, nodes, crowded, n in crowds(left, right):
            crowded, n = crowded[n > part], n[n > part]
            held = B.among(nodes, crowded) if len(crowded) else np.zeros(nodes.shape, dtype=bool)
            k, t = np.nonzero(held)
            many = n[np.searchsorted(crowded, nodes[k, t])].astype(np.uint64) if len(k) else np.empty(0, np.uint64)
            sent = np.stack([nodes[k, t], ((number << B.ROW_BITS) + at[k]).astype(np.uint64), many])
            out.append((number >> B.HOME_BITS, number, HOT, sent.tobytes()))
        return pa.Table.from_batches(list(B.packed(out, B.ANSWERED)), B.arrow_schema(B.ANSWERED))

    crowded = by_home.cogroup(counts.groupBy("home")).applyInArrow(hot, B.ANSWERED)
    nodes_of = forest.withColumn("bucket", F.lit(NODES).cast("long"))
    schema = "deal long, node long, p long, q long, mine long, row long, tree long, nodes binary, shingles binary"

    def send(block, answers):
        """The shingle sets of the texts that a pair needs, to each node and pair of parts."""
        at, nodes = unpacked(answers.pop(NODES)[0]) if NODES in answers else (np.empty(0, np.int64), np.empty((0, trees)))
        wanted = [np.frombuffer(p, dtype=np.uint64).reshape(3, -1) for p in answers.pop(HOT, [])]
        for payloads in answers.values():
            for p in payloads:
                two = np.frombuffer(p, dtype=np.uint64).reshape(2, -1)
                wanted.append(np.concatenate([two, np.ones((1, two.shape[1]), dtype=np.uint64)]))
        wanted = np.concatenate(wanted, axis=1) if wanted else np.empty((3, 0), dtype=np.uint64)
        own = wanted[1].astype(np.int64) - (block.number << B.ROW_BITS)
        flags = np.zeros(len(block.ids), dtype=bool)
        flags[own] = True
        where = {int(k): j for j, k in enumerate(at)}
        picked = np.flatnonzero(flags)
        texts = [block.data[a : z + 1] for a, z in zip(block.begins[picked], block.ends[picked], strict=True)]
        ends = np.cumsum([len(x) for x in texts]) - 1
        sets = shingle_sets(np.concatenate(texts), ends, np.ones(len(texts), bool), shingle) if texts else []
        place = {int(k): j for j, k in enumerate(picked)}
        for node, k, many in zip(wanted[0].tolist(), own.tolist(), wanted[2].tolist(), strict=True):
            row, mine = (block.number << B.ROW_BITS) + k, nodes[where[k]]
            tree = int(np.flatnonzero(mine == np.uint64(node))[0])
            parts = -(-many // part)
            home = int(B.mixed(np.array([row], dtype=np.uint64))[0] % np.uint64(parts))
            signed = node - (1 << 64) if node >> 63 else node
            for other in range(parts):
                p, q = min(home, other), max(home, other)
                deal = int(B.mixed(np.array([node ^ (p * 0x9E3779B1 + q * 0x85EBCA77)], dtype=np.uint64))[0] % np.uint64(buckets * 16))
                yield deal, signed, p, q, home, row, tree, mine.tobytes(), sets[place[k]].tobytes()

    answers = slim.unionByName(crowded).unionByName(nodes_of)
    sent = B.told(packed, answers, send, schema)
    found = scratch_path(spark, "links")
    sent.groupBy("deal", "p", "q").applyInArrow(verified(threshold, trees), LINKS).write.parquet(found)
    links = spark.read.schema(LINKS).parquet(found)
    return _classes(packed, links, key)


HOT, NODES = -2, -3
ROWS = "row long, id long, digest string"


def _rows(batches):
    for batch in batches:
        for number, ids, digests in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            ids = np.frombuffer(ids, dtype=np.int64)
            row = (number << B.ROW_BITS) + np.arange(len(ids))
            names = [digests[k : k + B.DIGEST].hex() for k in range(0, len(digests), B.DIGEST)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids), pa.array(names)], schema=B.arrow_schema(ROWS))


def _classes(packed: DataFrame, links: DataFrame, key: str) -> DataFrame:
    rows = packed.select("block", "ids", "digests").mapInArrow(_rows, ROWS)
    first = rows.groupBy("digest").agg(
        F.min("id").alias("first_id"), F.min_by("row", F.struct("id", "row")).alias("first_row")
    )
    number = links.groupBy(F.col("row").alias("first_row")).agg(F.sum("n").alias("n_links"))
    roots = connected(links.where("row != other").select("row", "other")).select(
        F.col("row").alias("first_row"), F.col("root")
    )
    of_text = (
        first.join(number, "first_row", "left")
        .join(roots, "first_row", "left")
        .withColumn("root", F.coalesce("root", "first_row"))
    )
    best = of_text.groupBy("root").agg(F.min(F.struct("first_id", "first_row")).alias("best"))
    classed = of_text.join(best, "root").select(
        "digest", F.col("first_id").alias("copy_of"), "n_links", F.col("best.first_id").alias("class_id"),
        F.col("best.first_row").alias("best_row"),
    )
    real = lambda c: F.when(F.col(c) != B.NO_ID, F.col(c)).alias(key if c == "id" else c)
    return rows.join(classed, "digest").select(
        real("id"),
        real("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        real("class_id"),
        (F.col("row") == F.col("best_row")).alias("keeps"),
        "digest",
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, one document of each class, once, with the columns they came
    with, whatever their names.

    Of rows that agree in id and text, the one whose columns have the smallest hash stays.
    """
    kept = near_duplicates(docs, key=key, text=text).where("keeps").select(F.struct(F.col(key).alias("id"), "digest").alias("kept"))
    digest = F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 2 * B.DIGEST)
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.struct(F.col(key).alias("id"), digest.alias("digest")).alias("own"))
    found = own.join(kept, F.col("own").eqNullSafe(F.col("kept")), "left_semi")
    return found.groupBy("own").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(row, root): the smallest row of the connected group of each row in ``edges`` (row, other).

    Rounds of the large and the small star: every row is linked to the smallest of its neighbours.  The minima are
    combined before the shuffle, so a row with very many neighbours costs one entry a task; each round is written to the
    shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(least, "a")
        out = moved.where("b > a") if large else moved
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = out.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    now = edges.select(F.col("row").alias("a"), F.col("other").alias("b")).where("a != b")
    seen = None
    for k in range(most):
        path = scratch_path(spark, f"star-{k}")
        star(star(now, True), False).write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return now.select(F.col("a").alias("row"), F.col("b").alias("root"))
