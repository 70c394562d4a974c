"""N-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence matrix.

1. Documents with the same shingle set form one class (a node).
2. Each node's rarest shingles, as many as the size bound asks for, are its
   prefix: two linked sets share a shingle of both prefixes. The product over
   the prefix columns accumulates overlap counts, and a pair whose count plus
   all that can follow its prefixes stays below the size-derived bound is
   discarded.
3. A prefix column with many rows is not multiplied out: it only joins its
   rows of compatible sizes into one candidate cluster.
4. Nodes connected by surviving pairs form candidate clusters. A small cluster
   is one block; a larger one is laid out by set size in bounded blocks. Full
   incidence blocks are multiplied for exact overlaps, but of the pairs of
   blocks only those that hold a surviving pair.

The shingle order behind the prefixes puts frequent shingles last. Any order is
exact; this one keeps passages that many documents share out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm import kernels as K
from passagemill.llm.components import connected_components
from passagemill.llm.scratch import forget, materialize
from passagemill.llm.skew import join_skewed
from passagemill.partitions import spread
from passagemill.shipping import ship_package

#: A shingle is frequent if partitions that hold it in at least this many sets hold it in so many sets together.
LOCALLY_REPEATED, FREQUENT = 2, 64
#: Frequent shingles that are ordered last, the most frequent first; bounds the broadcast to 16 bytes each.
MAX_FREQUENT = 200_000
#: Longest prefix column whose pairs are multiplied out.
LONG_COLUMN = 128
#: Rounds of ordering shingles; another follows while long columns not known to be frequent hold this share of the sets.
ROUNDS, TOO_MANY = 3, 0.01
#: Nodes and shingles in one side of a block.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1_000_000
#: Shingles of a partition that are counted together.
COUNTED_TOGETHER = 2_000_000
#: Places of nodes in blocks, about 100 bytes each, that may be broadcast to pick the texts of candidates; beyond, that join shuffles.
BROADCAST_ROWS = 300_000
_TILE = 4096


def _signature(shingles: np.ndarray) -> bytes:
    """128 bits that identify a shingle set."""
    other = K.mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.array([shingles.sum(dtype=np.uint64), other.sum(dtype=np.uint64)]).tobytes()


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _repeat_binary(values: list[bytes], times: np.ndarray) -> pa.Array:
    rows = np.repeat(np.frombuffer(b"".join(values), dtype="V16"), times)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class _FrequentCounter:
    """Counts of shingles that recur, with bounded memory: singles are forgotten whenever enough sets have gathered."""

    def __init__(self, room: int = 1_000_000):
        self.keys, self.counts, self.room = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), room
        self.waiting, self.shingles = [], 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += sets
        self.shingles += sum(map(len, sets))
        if self.shingles >= COUNTED_TOGETHER:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.shingles = [], 0
        known = np.isin(keys, self.keys, assume_unique=True) | (counts > 1)
        keys, place = np.unique(np.concatenate([self.keys, keys[known]]), return_inverse=True)
        total = np.bincount(place, np.concatenate([self.counts, counts[known]]), len(keys)).astype(np.int64)
        if len(keys) > self.room:
            top = np.sort(np.argpartition(-total, self.room // 2)[: self.room // 2])
            keys, total = keys[top], total[top]
        self.keys, self.counts = keys, total


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n, node), and rows (hot, hits) of shingles repeated in one partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen, doc_type = _FrequentCounter(), set(), None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            sizes, nodes, fresh = [], [], []
            for s in K.shingle_sets(*K.word_hashes(batch.column("text")), words):
                node = _signature(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                if node is not None and node not in seen:
                    seen.add(node)
                    fresh.append(s)
            counter.add(fresh)
            empty = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), _binary(nodes), empty, empty], names=["doc_id", "n", "node", "hot", "hits"])
        counter.settle()
        hot = np.flatnonzero(counter.counts >= LOCALLY_REPEATED)
        if len(hot):
            hot = hot[np.argsort(-counter.counts[hot], kind="stable")][:MAX_FREQUENT]
            none = len(hot)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, doc_type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.array(counter.keys[hot].view(np.int64)), pa.array(counter.counts[hot])],
                names=["doc_id", "n", "node", "hot", "hits"],
            )

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node binary, hot long, hits long")


def _postings(docs: DataFrame, words: int, percent: int, hot: np.ndarray) -> DataFrame:
    """(gram, n, node) for the prefix of each distinct set of a partition. ``hot``: frequent shingles, rarest first."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], (order + 1).astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            grams, nodes, sizes, lengths = [], [], [], []
            for s in K.shingle_sets(*K.word_hashes(batch.column("text")), words):
                if not len(s) or (node := _signature(s)) in seen:
                    continue
                seen.add(node)
                p = _prefix_length(len(s), percent)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    late = keys[at] == s
                    first = s[~late][:p]
                    if len(first) < p:
                        rest = s[late]
                        first = np.concatenate([first, rest[np.argsort(ranks[at[late]])][: p - len(first)]])
                else:
                    first = s[:p]
                grams.append(first)
                nodes.append(node)
                sizes.append(len(s))
                lengths.append(len(first))
            if grams:
                times = np.array(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(sizes, dtype=np.int64), times)), _repeat_binary(nodes, times)], names=["gram", "n", "node"])

    return docs.mapInArrow(prefixes, "gram long, n long, node binary")


def _column_pairs(postings: DataFrame, percent: int, long_column: int) -> DataFrame:
    """(a, b, na, nb, chained, gram): pairs of compatible size from short columns; cluster edges, with a row for each member, from long ones."""

    class Emitter:
        def __init__(self):
            self.rows: list[tuple] = []
            self.gram, self.run, self.leader, self.last = None, [], None, 0

        def compatible(self, small: int, large: int) -> bool:
            return 100 * small >= percent * large

        def chain(self, n: int, node: bytes) -> None:
            # Rows come by size: a gap that no pair can bridge starts a new cluster.
            if self.leader is None or not self.compatible(self.last, n):
                self.leader = (n, node)
            self.last = n
            self.rows.append((self.leader[1], node, self.leader[0], n, True, self.gram))

        def add(self, gram: int, n: int, node: bytes) -> None:
            if gram != self.gram:
                self.close()
                self.gram = gram
            if self.run is None:
                if node != self.rows_last:
                    self.chain(n, node)
                    self.rows_last = node
                return
            if self.run and self.run[-1][1] == node:
                return
            self.run.append((n, node))
            if len(self.run) > long_column:
                for item in self.run:
                    self.chain(*item)
                self.rows_last, self.run = node, None

        def close(self) -> None:
            for k, (n, node) in enumerate(self.run or ()):
                for m, other in self.run[k + 1 :]:
                    if not self.compatible(n, m):
                        break
                    self.rows.append((node, other, n, m, False, None) if node < other else (other, node, m, n, False, None))
            self.run, self.leader, self.last = [], None, 0

        def batch(self) -> pa.RecordBatch:
            columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 6
            self.rows = []
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "na", "nb", "chained", "gram"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitter, previous = Emitter(), None
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            # Only grams that recur matter: a row alone with its gram is passed over without touching Python objects.
            same = np.zeros(len(grams), dtype=bool)
            if len(grams):
                same[1:] |= grams[1:] == grams[:-1]
                same[:-1] |= grams[1:] == grams[:-1]
                same[[0, -1]] = True
            keep = np.flatnonzero(same)
            picked = batch.take(pa.array(keep))
            for gram, n, node in zip(grams[keep].tolist(), picked.column("n").to_pylist(), picked.column("node").to_pylist(), strict=True):
                emitter.add(gram, n, node)
                if len(emitter.rows) >= 50_000:
                    yield emitter.batch()
        emitter.close()
        yield emitter.batch()

    return postings.mapInArrow(emit, "a binary, b binary, na long, nb long, chained boolean, gram long")


def _block_links(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    """Which sets link, as a square boolean matrix; with split > 0 only pairs across that position are of interest."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if count == 2:
        overlap = np.zeros((2, 2))
        overlap[0, 1] = overlap[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        rows = np.repeat(np.arange(count), sizes)
        _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        wanted = uses[column] > 1
        rows, column = rows[wanted], column[wanted]
        used, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        overlap = np.zeros((count, count), dtype=np.float32)
        for low in range(0, len(used), _TILE):
            a, b = np.searchsorted(column, [low, low + _TILE])
            tile = np.zeros((count, min(_TILE, len(used) - low)), dtype=np.float32)
            tile[rows[a:b], column[a:b] - low] = 1
            if split:
                overlap[:split, split:] += tile[:split] @ tile[split:].T
            else:
                overlap += tile @ tile.T
        if split:
            overlap[split:, :split] = overlap[:split, split:].T
    union = sizes[:, None] + sizes[None, :] - overlap
    links = 100 * overlap >= percent * union
    if split:
        links[:split, :split] = links[split:, split:] = False
    np.fill_diagonal(links, False)
    return links


def _least_labels(links: np.ndarray) -> np.ndarray:
    labels = np.arange(len(links))
    while True:
        lower = np.minimum(labels, np.where(links, labels[None, :], len(labels)).min(axis=1, initial=len(labels)))
        lower = np.minimum(lower, lower[lower])
        if (lower == labels).all():
            return labels
        labels = lower


def _multiply_blocks(blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root, links, whole) from rows (cluster, i, j, s, node, copies, text, whole), sorted by block."""

    def flush(rows: list[tuple]) -> list[tuple]:
        unique: dict[bytes, tuple] = {}
        texts = pa.array([r[3] for r in rows], pa.large_string())
        for row, s in zip(rows, K.shingle_sets(*K.word_hashes(texts), words), strict=True):
            # Rows that share the id but not the text of the chosen document are not of the class.
            if _signature(s) == row[1]:
                unique[row[1]] = (row[0], row[1], row[2], s, row[4])
        members = sorted(unique.values(), key=lambda r: (r[0], r[1]))
        if len(members) < 2:
            return []
        sides = sorted({r[0] for r in members})
        split = sum(r[0] == sides[0] for r in members) if len(sides) > 1 else 0
        links = _block_links([r[3] for r in members], split, percent)
        labels = _least_labels(links)
        degree = links @ np.array([r[2] for r in members], dtype=np.int64)
        return [(r[1], members[label][1], int(d), r[4]) for r, label, d in zip(members, labels.tolist(), degree, strict=True) if d]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "root", "links", "whole"])

        for batch in batches:
            found: list[tuple] = []
            names = ("cluster", "i", "j", "s", "node", "copies", "text", "whole")
            for cluster, i, j, s, node, copies, text, whole in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (cluster, i, j) != key:
                    found += flush(rows) if len(rows) > 1 else []
                    key, rows = (cluster, i, j), []
                # Within a diagonal block all rows are one side.
                rows.append((s if i != j else 0, node, copies, text, whole))
            yield out(found)
        yield out(flush(rows) if len(rows) > 1 else [])

    return blocks.mapInArrow(multiply, "node binary, root binary, links long, whole boolean")


def _tasks(members: DataFrame, possible: DataFrame, columns: DataFrame, percent: int, block_nodes: int) -> DataFrame:
    """(cluster, i, j, s, node, least, copies, whole): each node once for every block pair that it takes part in.

    A cluster that fits is one block. Nodes of a larger one are laid out by
    size, and a pair of its blocks is multiplied only if it holds a surviving
    pair: one of ``possible``, or two rows of a long column (gram, node) with
    compatible sizes.
    """
    weight = F.greatest(F.lit(1.0 / block_nodes), F.col("n") / F.lit(float(BLOCK_SHINGLES)))
    sizes = materialize(members.groupBy("cluster").agg(F.sum(weight).alias("blocks")).filter("blocks > 2"), "join-large")
    small = join_skewed(members, sizes, "cluster", "left_anti")
    zero = F.lit(0).cast("int")
    tasks = small.select("cluster", zero.alias("i"), zero.alias("j"), zero.alias("s"), "node", "least", "copies", F.lit(True).alias("whole"))
    if sizes.isEmpty():
        return tasks
    large = materialize(join_skewed(members, sizes.select("cluster"), "cluster", "left_semi"), "join-large-members")
    by_size = large.groupBy("cluster", "n").agg(F.sum(weight).alias("_share"))
    earlier = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(by_size.withColumn("_start", F.coalesce(F.sum("_share").over(earlier), F.lit(0.0))), "join-starts")
    place = F.floor(F.col("_start") + F.col("_share") * F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    placed = materialize(join_skewed(large, starts, ["cluster", "n"]).select("cluster", "node", "least", "copies", "n", place.cast("int").alias("s")), "join-placed")
    spot = placed.select("node", "cluster", "s")
    first = join_skewed(possible, spot.withColumnsRenamed({"node": "a", "s": "sa"}), "a")
    met = materialize(first, "join-met")
    direct = join_skewed(met, spot.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("cluster", F.least("sa", "sb").alias("i"), F.greatest("sa", "sb").alias("j")).distinct()
    # Columns that meet the same blocks count once.
    runs = join_skewed(columns, spot, "node").groupBy("cluster", "gram").agg(F.array_sort(F.collect_set("s")).alias("all")).select("cluster", "all").distinct()
    crossed = runs.select("cluster", "all", F.explode("all").alias("i")).select("cluster", "i", F.explode(F.filter("all", lambda t: t >= F.col("i"))).alias("j")).distinct()
    ranges = placed.groupBy("cluster", "s").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    lower = ranges.select("cluster", F.col("s").alias("i"), F.col("high").alias("high"))
    upper = ranges.select("cluster", F.col("s").alias("j"), F.col("low").alias("low"))
    fitting = crossed.join(lower, ["cluster", "i"]).join(upper, ["cluster", "j"]).filter(100 * F.col("high") >= percent * F.col("low")).select("cluster", "i", "j")
    needed = materialize(direct.unionByName(fitting).distinct(), "join-block-pairs")
    sides = needed.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("s"))
    return tasks.unionByName(placed.join(sides, ["cluster", "s"]).select("cluster", "i", "j", "s", "node", "least", "copies", F.lit(False).alias("whole")))


def ngram_jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", long_column: int = LONG_COLUMN, block_nodes: int = BLOCK_NODES, frequent: int = FREQUENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their
    sets of distinct ``words``-word shingles (ASCII lower case; words are runs
    outside ASCII white space). A text with fewer words is one shingle; null or
    blank text has none and links with nothing. component_id is the smallest id
    reachable by links, the row's own included; a null id is never smallest.
    n_links counts the other rows a row links with, equal texts included.
    Repeated rows and ids are rows like any others; texts of any length are
    read whole; an empty table gives an empty result. Other columns are ignored.
    Shingles are compared by 64-bit hashes of their words, sets in one class by
    128 bits.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialize(_scan(docs, words), "join-scan")
    slim = scanned.filter(F.col("hot").isNull()).select("doc_id", "n", "node")
    hits = scanned.filter(F.col("hot").isNotNull()).groupBy("hot").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= frequent)
    counts = {r["hot"]: r["hits"] for r in hits.orderBy(F.desc("hits"), "hot").limit(MAX_FREQUENT).collect()}
    sets = slim.count()
    for round_no in range(ROUNDS):
        hot = np.array(sorted(counts, key=lambda g: (counts[g], g)), dtype=np.int64).view(np.uint64)
        postings = _postings(docs, words, percent, hot).repartition("gram").sortWithinPartitions("gram", "n", "node")
        pairs = materialize(_column_pairs(postings, percent, long_column), "join-pairs")
        chained = pairs.filter("chained")
        # Long columns outside the frequent shingles join unlike texts: their shingles are ordered last in another round.
        long = chained.groupBy("gram").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "gram").limit(MAX_FREQUENT)
        fresh = {r["gram"]: r["rows"] for r in long.collect() if r["gram"] not in counts}
        if round_no == ROUNDS - 1 or sum(fresh.values()) <= TOO_MANY * sets:
            break
        counts = dict(sorted((counts | fresh).items(), key=lambda x: (-x[1], x[0]))[:MAX_FREQUENT])
        forget(docs.sparkSession, pairs)
    counted = pairs.filter(~F.col("chained")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    columns = materialize(chained.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("long")), "join-long")
    for side in "ab":
        counted = counted.join(columns.select(F.col("node").alias(side), F.col("long").alias(f"long_{side}")), side, "left")
    # Shared shingles: counted ones, those of long columns at most, and all that follow the prefix that ends first.
    beyond = F.greatest(*(F.ceil(F.col(n) * percent / F.lit(100)) - 1 for n in ("na", "nb")))
    most = F.col("shared") + F.least(*(F.coalesce(F.col(f"long_{s}"), F.lit(0)) for s in "ab")) + beyond
    possible = counted.filter(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    possible = materialize(possible.select("a", "b"), "join-possible")
    clusters = connected_components(possible.unionByName(chained.filter("a != b").select("a", "b")))

    # The classes: smallest id and number of rows of each node.
    classes = materialize(slim.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n")), "join-classes")
    members = materialize(clusters.select("node", F.col("root").alias("cluster")).join(classes, "node"), "join-members")
    # The tasks are settled without texts, so that texts move once to their blocks, and once more only if the tasks are too many to broadcast.
    tasks = materialize(_tasks(members, possible, chained.select("gram", F.col("b").alias("node")), percent, block_nodes), "join-tasks")
    wanted = F.broadcast(tasks) if tasks.count() <= broadcast_rows else tasks
    placed = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["least"])).select("cluster", "i", "j", "s", "node", "copies", "text", "whole")
    blocks = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    linked = materialize(_multiply_blocks(blocks, words, percent), "join-links")

    split = linked.filter(~F.col("whole")).select("node", "root")
    roots = linked.filter("whole").select("node", "root")
    if not split.isEmpty():
        roots = roots.unionByName(connected_components(split, "node", "root"))
    degrees = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = materialize(classes.join(roots.distinct(), "node", "left").join(degrees, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-found")
    # Only nodes with links share a root with others.
    least = materialize(found.filter("links > 0").groupBy("root").agg(F.min("least").alias("component_id")), "join-least")
    linked_nodes = join_skewed(found.filter("links > 0"), least, "root").select("node", "component_id", "links", "copies")
    single = found.filter("links IS NULL").select("node", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("links"), "copies")
    # Classes of one row need no join: a row without an answer is alone.
    told = linked_nodes.unionByName(single.filter("copies > 1"))
    answers = materialize(told.select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "join-answers")
    return join_skewed(slim, answers, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END) AS gram FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1) k USING (doc_id)
"""
