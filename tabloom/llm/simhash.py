"""Near duplicates by SimHash and a Gray-order hierarchical index.

A fingerprint has 64 bits; two link when they differ in at most MAX_BITS = 3. The index runs over
the distinct fingerprints:

* Top nodes factor out shared masked patterns. The 64 bits are cut into four masks; three
  differing bits leave one mask whole, so each link lies below some top node. A node with more
  than NODE_ROWS members gets four children, each with a quarter of its free bits added to the mask,
  by the same argument, until it is small. 13 free bits cannot hold more than NODE_ROWS members,
  so this ends for all data and no member is dropped.
* Below a node the members are sorted by Gray rank, so that neighbours share many bits. Groups of
  LEAF members, and groups of FAN groups above them, hold the bits that all members share (mask and
  value). Two groups are compared by their shared bits only; the differences add up along the
  path, and a pair of groups is pruned whole as soon as they exceed MAX_BITS.
* A node's links leave its task as a forest, so a dense group never emits all its pairs.

Components of the links follow in ``components``. A task holds one node (NODE_ROWS members) and
one Arrow batch. Nothing is collected but counts.

Defined results: a null or empty text has fingerprint 0 and links like any other. Rows with the
same id count as one document. A row with a null id takes the component of its fingerprint, null
if no row with an id has it. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.components import smallest_reachable
from tabloom.llm.support import load, query, stage_table

WORDS, SEED, MAX_BITS = 3, 42, 3
NODE_ROWS, LEAF, FAN = 8192, 32, 8
SHINGLE_BLOCK = 1 << 16
CUTS = MAX_BITS + 1


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority bits of the shingles' XXH64; bytes.lower and bytes.split are ASCII only."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    total = len(parts) - words + 1
    counts = np.zeros(64, dtype=np.int64)
    shingles = map(b" ".join, zip(*[parts[i:] for i in range(words)], strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, total, SHINGLE_BLOCK):
        block = np.fromiter(hashes, dtype="<u8", count=min(SHINGLE_BLOCK, total - start))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, a signed 64-bit number, of every row."""
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of every value in the Gray code sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``root`` holds the smallest member of every set."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


class GrayIndex:
    """Groups of Gray-sorted fingerprints with their shared bits, level by level."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps, self.leaf, self.fan = fps[self.order], leaf, fan
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # shared value and shared mask, leaves first
        low, high = self.fps, self.fps
        step = leaf
        while True:
            starts = np.arange(0, len(low), step)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, ~(low ^ high)))
            if len(low) <= fan:
                break
            step = fan

    def _near(self, level: int, i: np.ndarray, j: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        value, mask = self.levels[level]
        near = np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j]) <= bits
        return i[near], j[near]

    def join(self, bits: int = MAX_BITS, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in the input that differ in at most ``bits`` bits, in chunks."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        for level in range(top, -1, -1):
            i, j = self._near(level, i, j, bits)
            if level:
                below = len(self.levels[level - 1][0])
                kid = np.arange(self.fan)
                i, j = np.broadcast_arrays((i[:, None] * self.fan + kid)[:, :, None], (j[:, None] * self.fan + kid)[:, None, :])
                i, j = i.ravel(), j.ravel()
                real = (i <= j) & (j < below)
                i, j = i[real], j[real]
        member = np.arange(self.leaf)
        for s in range(0, len(i), chunk):
            a, b = np.broadcast_arrays(
                (i[s : s + chunk, None] * self.leaf + member)[:, :, None],
                (j[s : s + chunk, None] * self.leaf + member)[:, None, :],
            )
            a, b = a.ravel(), b.ravel()
            real = (a < b) & (b < len(self.fps))
            a, b = a[real], b[real]
            near = np.bitwise_count(self.fps[a] ^ self.fps[b]) <= bits
            yield self.order[a[near]], self.order[b[near]]


def _forest(fps: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Root position of every member; ``node`` numbers the nodes, whose members are adjacent."""
    root = np.arange(len(fps))
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, len(fps)))
    small = np.repeat(sizes <= LEAF, sizes)
    for apart in range(1, int(sizes[sizes <= LEAF].max(initial=1))):
        a = np.flatnonzero(small[:-apart] & (node[:-apart] == node[apart:]))
        merge(root, near := a[np.bitwise_count(fps[a] ^ fps[a + apart]) <= MAX_BITS], near + apart)
    for s, n in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        for a, b in GrayIndex(fps[s : s + n]).join():
            merge(root, a + s, b + s)
    return root


def _search_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest links of the nodes; rows come sorted by node, each of at most NODE_ROWS members."""

    def found(mask, pat, fp, rep):
        node = np.cumsum(np.append(False, (mask[1:] != mask[:-1]) | (pat[1:] != pat[:-1])))
        root = _forest(fp.view(np.uint64), node)
        own = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], ["a", "b"])

    held = None
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("mask", "pat", "fp", "rep")]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        mask, pat = held[0], held[1]
        last = (mask == mask[-1:]) & (pat == pat[-1:])  # the last node may go on in the next batch
        if len(last) and not last.all():
            cut = int(np.argmax(last))
            yield found(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield found(*held)


def child_masks(mask: int) -> list[int]:
    """The mask with each of CUTS parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    ends = [len(free) * i // CUTS for i in range(CUTS + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Forest of the links between classes (fp, rep): pairs (a, b) of representatives."""
    spark = classes.sparkSession
    first = F.array(*[F.lit(_signed(m)).cast("bigint") for m in child_masks(0)])
    below = classes.select("fp", "rep", F.explode(first).alias("mask"))
    parts = []
    while True:
        below = below.withColumn("pat", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = below.groupBy("mask", "pat").agg(F.count("*").alias("n")).filter("n > 1")
        below = stage_table(below.join(sizes, ["mask", "pat"]), "gray-nodes")
        nodes = below.filter(F.col("n") <= node_rows).select("mask", "pat", "fp", "rep")
        nodes = nodes.repartition("mask", "pat").sortWithinPartitions("mask", "pat", "fp")
        parts.append(stage_table(nodes.mapInArrow(_search_nodes, "a bigint, b bigint"), "gray-links"))
        large = below.filter(F.col("n") > node_rows).select("fp", "rep", "mask")
        masks = [r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect()]  # at most CUTS**6
        if not masks:
            break
        kids = [(_signed(m), _signed(k)) for m in masks for k in child_masks(m)]
        kids = F.broadcast(spark.createDataFrame(kids, "mask bigint, kid bigint"))
        below = large.join(kids, "mask").select("fp", "rep", F.col("kid").alias("mask"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest reachable id) of every row."""
    rows = stage_table(fingerprints(df, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL")
    # Rows that share an id are one document: their fingerprints are linked through it.
    shared = rows.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x != y").select("doc_id")
    same = rows.join(shared, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = links(classes, node_rows).unionByName(same)
    reached = smallest_reachable(found, "a", "b")
    placed = classes.join(reached, classes["rep"] == reached["node"], "left")
    placed = placed.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(placed, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows but those whose group has a smaller id; rows without an id stay."""
    gone = near_groups(df, id_col, text_col).filter("doc_id != component_id")
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col("__gone"), "left_anti")


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    return near_groups(load(spark, sf_dir, "documents"))
