"""Problem 5: near-duplicate records with small edits.

Count-vector R-trees.  A record is the set of its sequences of five words (hashed).  The hashes
fall into ``DIMENSIONS`` groups; the counts per group are the coordinates of the record's point.
Two records have at most the sum of the coordinate minima in common, and two boxes at most the sum
of the minima of their upper corners, so whole branches that cannot reach the threshold are cut
off; what survives is verified on the sets themselves.

One tree over a corpus neither fits a machine nor prunes at its root, so the root is spread over
the cluster: its children are the rare sequences, and a record enters the children of as many of
its rarest sequences as a similar record cannot all lack (n - ceil(t n) + 1 of n).  Rarity is the
count of the sequence's group among ``RARITY`` groups, taken over all records; that table has a
fixed size.  A child whose group is so frequent that its tree could grow large is split into blocks
and each pair of blocks becomes a task of its own.  Records with equal sets are represented by one
of them and expanded at the end.

Defined results: null texts and texts of fewer than five words are similar to nothing; rows without an
id are no records; of the rows
of one id the latest counts (see ``operators.versions``), and repeated rows count once; equal sets
have similarity 1; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.components import components
from siltstone.operators.versions import latest
from siltstone.plans import materialize, scan, spread

WORDS = 5
THRESHOLD = 0.6
DIMENSIONS = 128
RARITY = 1 << 16
BLOCK = 50_000
#: Records of a leaf, which are compared with each other, and children of an inner box.
LEAF = 4
#: Records of one block of a class of copies.
PART = 1000

_WORD = re.compile(r"[^\W_]+")
_known: dict[str, int] = {}


def _hash(word: str) -> int:
    value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    if len(_known) > 500_000:
        _known.clear()
    _known[word] = value
    return value


def sequences(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the sequences of five words."""
    if not text:
        return np.empty(0, np.int64)
    words = _WORD.findall(text.lower())
    n = len(words) - WORDS + 1
    if n < 1:
        return np.empty(0, np.int64)
    get = _known.get
    codes = np.array([get(w) or _hash(w) for w in words], np.uint64)
    x = codes[:n].copy()
    for i in range(1, WORDS):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return np.unique(x.view(np.int64))


def point(x: np.ndarray) -> bytes:
    """Counts per group as 16-bit numbers; a count above 65535 stands for itself and all above."""
    return np.minimum(np.bincount(x & (DIMENSIONS - 1), minlength=DIMENSIONS), 65535).astype("<u2").tobytes()


def needed(n: np.ndarray, t: float = THRESHOLD) -> np.ndarray:
    """The common sequences that records with ``n`` sequences together need."""
    return t / (1 + t) * n - 1e-9


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of what points (or boxes, by their upper corners) have in common."""
    low = np.minimum(a, b)
    total = low.sum(-1, dtype=np.int64)
    return np.where((low == 65535).any(-1), np.int64(1) << 40, total)


class Tree:
    """R-tree packed bottom-up over points sorted by size and by their largest coordinate."""

    def __init__(self, n: np.ndarray, points: np.ndarray, fan: int = LEAF):
        self.fan, self.n, self.points = fan, n, points
        self.tested = self.cut = 0  # pairs of boxes or points that were compared, and those left out
        self.order = np.lexsort((points.argmax(1), n))
        self.levels = [(n[self.order], points[self.order])]
        while len(self.levels[-1][0]) > 1:
            size, corner = self.levels[-1]
            cut = np.arange(0, len(size), fan)
            self.levels.append((np.minimum.reduceat(size, cut), np.maximum.reduceat(corner, cut, axis=0)))

    def pairs(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of points that may be similar, found by descending pairs of boxes."""
        a = b = np.zeros(1, np.int64)
        for size, corner in reversed(self.levels[:-1]):
            step = np.arange(self.fan)
            chunks = []
            for at in range(0, len(a), 256):  # bounds the memory of one descent
                x = (a[at : at + 256, None, None] * self.fan + step[None, :, None]) + 0 * step[None, None, :]
                y = (b[at : at + 256, None, None] * self.fan + step[None, None, :]) + 0 * step[None, :, None]
                x, y = x.ravel(), y.ravel()
                keep = (x <= y) & (y < len(size))
                x, y = x[keep], y[keep]
                for part in range(0, len(x), 1 << 16):
                    i, j = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                    ok = overlap(corner[i], corner[j]) >= needed(size[i] + size[j], t)
                    chunks.append((i[ok], j[ok]))
                    self.tested += len(i)
                    self.cut += len(i) - int(ok.sum())
            a = np.concatenate([c[0] for c in chunks]) if chunks else np.empty(0, np.int64)
            b = np.concatenate([c[1] for c in chunks]) if chunks else np.empty(0, np.int64)
        if len(self.levels) == 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keep = a < b
        return self.order[a[keep]], self.order[b[keep]]


def _first_pass(batches):
    """One row per record (kind 0) and, at the end of a task, the counts of the rarity groups (kind 1)."""
    counts = np.zeros(RARITY, np.int64)
    for batch in batches:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            x = sequences(text)
            if not len(x):
                continue
            counts += np.bincount((x >> 8) & (RARITY - 1), minlength=RARITY) if len(x) > RARITY else 0
            if len(x) <= RARITY:
                np.add.at(counts, (x >> 8) & (RARITY - 1), 1)
            digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            for column, value in zip(out, (0, key, len(x), digest, point(x))):
                column.append(value)
        yield _rows(out)
    seen = np.flatnonzero(counts)
    yield _rows(([1] * len(seen), seen, counts[seen], [None] * len(seen), [None] * len(seen)))


def _rows(columns) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "id", "n", "digest", "point"])


def _enter(rarity: np.ndarray, t: float, block: int, buckets: int):
    """Rows (bucket, keys, docs, ids) with the children of the root that records enter.

    One row holds all entries of a batch in one bucket: 40 bits of each key, the place of its
    record in ``ids``.  Keys that agree in 40 bits by chance only make a child larger.
    """
    blocks = np.maximum(1, -(-rarity // block))

    def run(batches):
        for batch in batches:
            parts, docs = [], []
            keys_of, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            for i, (key, text) in enumerate(zip(keys_of, texts)):
                x = sequences(text)
                n = len(x)
                if not n:
                    continue
                group = (x >> 8) & (RARITY - 1)
                take = n - int(np.ceil(t * n - 1e-9)) + 1
                order = np.lexsort((x, rarity[group]))[:take]
                keys, many = x[order].view(np.uint64), blocks[group[order]]
                if many.max() > 1:
                    mine = key * 0x9E3779B1 % (1 << 32) % many
                    each = np.repeat(np.arange(take), many)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                    pair = np.minimum(other, mine[each]) * (1 << 20) + np.maximum(other, mine[each])
                    keys = keys[each] ^ (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                parts.append(keys)
                docs.append(np.full(len(keys), i, np.int32))
            if not parts:
                continue
            keys, docs = np.concatenate(parts), np.concatenate(docs)
            home = (keys % np.uint64(buckets)).astype(np.int64)
            keys = keys >> np.uint64(24)
            order = np.lexsort((keys, home))
            home, keys, docs = home[order], keys[order], docs[order]
            ids = np.array(keys_of, np.int64)
            cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist() + [len(home)]
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for lo, hi in zip(cut, cut[1:]):
                own, place = np.unique(docs[lo:hi], return_inverse=True)
                k = keys[lo:hi]
                rows[0].append(int(home[lo]))
                rows[1].append((k & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (k >> np.uint64(32)).astype(np.uint8).tobytes())
                rows[2].append(place.astype("<u2" if len(own) < 65536 else "<u4").tobytes())
                rows[3].append(ids[own].tobytes())
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(rows, kinds)], ["bucket", "keys", "docs", "ids"])

    return run


ENTERED = "bucket bigint, keys binary, docs binary, ids binary"


def _read_entries(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of the entries of one bucket."""
    keys, owners = [], []
    for k, d, i in rows:
        n = len(k) // 5
        keys.append(np.frombuffer(k, "<u4", n).astype(np.int64) | (np.frombuffer(k, np.uint8, n, 4 * n).astype(np.int64) << 32))
        owners.append(np.frombuffer(i, np.int64)[np.frombuffer(d, "<u2" if len(d) == 2 * n else "<u4")])
    return np.concatenate(keys), np.concatenate(owners)


def _populated(batches):
    """(key, id) of the children with several records, from rows sorted by bucket.

    Children with the same records as another of the bucket are dropped: similar records share
    most of their sequences, and one tree finds what the others would.
    """

    def children(bucket, rows):
        keys, ids = _read_entries(rows)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[fresh], ids[fresh]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.concatenate([first, [len(keys)]]))
        with np.errstate(over="ignore"):
            mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            sums = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first)
        several = np.flatnonzero(count > 1)
        _, one = np.unique(np.stack([sums[several], count[several].astype(np.uint64)], 1), axis=0, return_index=True)
        keep = np.zeros(len(first), bool)
        keep[several[one]] = True
        keep = np.repeat(keep, count)
        return pa.RecordBatch.from_arrays([pa.array(keys[keep] | (bucket << 40)), pa.array(ids[keep])], ["key", "id"])

    now, rows = None, []
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("bucket", "keys", "docs", "ids"))
        for bucket, k, d, i in zip(*columns):
            if bucket != now and rows:
                yield children(now, rows)
                rows = []
            now = bucket
            rows.append((k, d, i))
    if rows:
        yield children(now, rows)


def _whole_groups(batches):
    """Tables of whole children from batches sorted by key."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        keys = held["key"].to_numpy()
        differs = keys != keys[-1]
        cut = held.num_rows - int(np.argmax(differs[::-1])) if differs.any() else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each child."""
    key = table["key"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.concatenate([first, [len(key)]]))


def _search(t: float):
    """Pairs that survive the trees of the children."""

    def run(batches):
        for table in _whole_groups(batches):
            ids = table["id"].to_numpy()
            n = table["n"].to_numpy()
            points = np.frombuffer(b"".join(table["point"].to_pylist()), "<u2").reshape(len(ids), DIMENSIONS)
            first, count = _bounds(table)
            found = []
            leaf = count <= LEAF
            for gap in range(1, int(count[leaf].max()) if leaf.any() else 0):
                f, c = first[leaf & (count > gap)], count[leaf & (count > gap)]
                a = np.repeat(f, c - gap) + (np.arange((c - gap).sum()) - np.repeat(np.cumsum(c - gap) - (c - gap), c - gap))
                b = a + gap
                need = needed(n[a] + n[b], t)
                keep = np.minimum(n[a], n[b]) >= need
                a, b, need = a[keep], b[keep], need[keep]
                keep = overlap(points[a], points[b]) >= need
                found.append((a[keep], b[keep]))
            for f, c in zip(first[~leaf].tolist(), count[~leaf].tolist()):
                a, b = Tree(n[f : f + c], points[f : f + c]).pairs(t)
                found.append((a + f, b + f))
            if not found:
                continue
            a, b = (ids[np.concatenate(x)] for x in zip(*found))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    return run


def _sets(batches):
    for batch in batches:
        sets = [sequences(t).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["id", "x"])


def _verify(t: float):
    def run(batches):
        for batch in batches:
            keep, similarity = [], []
            for i, (x, y) in enumerate(zip(batch["x"].to_pylist(), batch["y"].to_pylist())):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= needed(len(x) + len(y), t):
                    keep.append(i)
                    similarity.append(common / (len(x) + len(y) - common))
            rows = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows["a"], rows["b"], pa.array(similarity, pa.float64())], ["a", "b", "similarity"])

    return run


def similar(records: DataFrame, t: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (a, b, similarity) of representatives, and (id, rep) of every record
    that has sequences."""
    texts = spread(records.where("id is not null").select("id", "text"))
    kinds = "kind int, id bigint, n bigint, digest binary, point binary"
    seen = materialize(texts.mapInArrow(_first_pass, kinds), "points")
    # at most RARITY rows, whatever the size of the corpus
    rarity = np.zeros(RARITY, np.int64)
    for row in seen.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        rarity[row.id] = row.n
    docs = seen.where("kind = 0")
    classes = docs.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    several = materialize(classes.where("m > 1").select("digest", "rep"), "classes")
    members = docs.join(several, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct()
    copies = materialize(members.where("id <> rep").select("id"), "copies")
    single = texts.join(copies, "id", "left_anti")

    # about this many entries to a bucket, which a task holds at once
    total = docs.agg(F.sum(F.col("n") * (1 - t) + 2)).first()[0] or 0
    buckets = max(12, int(total // 400_000) + 1)
    shared = (
        single.mapInArrow(_enter(rarity, t, block, buckets), ENTERED)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_populated, "key bigint, id bigint")
    )
    points = docs.join(copies, "id", "left_anti").select("id", "n", "point").dropDuplicates(["id"])
    children = shared.join(points, "id").repartition("key").sortWithinPartitions("key")
    pairs = materialize(children.mapInArrow(_search(t), "a bigint, b bigint").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(
        single.join(wanted, "id", "left_semi").mapInArrow(_sets, "id bigint, x binary").dropDuplicates(["id"]), "sets"
    )
    checked = (
        pairs.join(sets.select(F.col("id").alias("a"), "x"), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_verify(t), "a bigint, b bigint, similarity double")
    )
    return materialize(checked, "links"), materialize(members, "members")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the latest bodies of agents and skills."""
    both = scan(spark, sf_dir, "agents", "prompt_id", "ingested_at", "body").unionByName(
        scan(spark, sf_dir, "skills", "prompt_id", "ingested_at", "body")
    )
    return latest(both, "prompt_id", "ingested_at", "body").select(F.col("prompt_id").alias("id"), F.col("body").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of every pair of prompts whose similarity is at least 0.6."""
    links, members = similar(records(spark, sf_dir))
    return expanded(links, members)


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) of every pair of records that are copies or whose representatives are linked.

    Classes are held in parts of about ``PART`` records; each pair of parts is a row of its own, and
    these rows are spread evenly before they are expanded, so that no class burdens one task.
    """
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("m"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    held = members.join(sizes, "rep").select("rep", "id", part).groupBy("rep", "part").agg(F.collect_list("id").alias("ids"))
    within = sizes.where("m > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    n = sizes.select("rep", "parts")
    blocks = (
        links.select("a", "b")
        .unionByName(within)
        .join(n.select(F.col("rep").alias("a"), F.col("parts").alias("na")), "a")
        .join(n.select(F.col("rep").alias("b"), F.col("parts").alias("nb")), "b")
        .select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("pa"))
        .select("a", "b", "pa", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pb"))
        .where("a <> b or pa <= pb")
    )
    filled = blocks.join(held.select(F.col("rep").alias("a"), F.col("part").alias("pa"), F.col("ids").alias("left")), ["a", "pa"]).join(
        held.select(F.col("rep").alias("b"), F.col("part").alias("pb"), F.col("ids").alias("right")), ["b", "pb"]
    )
    rows = filled.repartition(F.xxhash64("a", "pa", "b", "pb")).select(
        "left", ((F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))).alias("same"), F.explode("right").alias("j")
    )
    each = rows.select("same", "j", F.explode("left").alias("i")).where("not same or i < j")
    return each.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, group_id, class_id, links): one row per prompt that has words enough.

    ``class_id`` stands for the prompts with an equal set, ``group_id`` for all that are connected
    by similar pairs, ``links`` counts the prompts that are similar to this one.
    """
    links, members = similar(records(spark, sf_dir))
    sizes = members.groupBy("rep").agg(F.count("*").alias("m"))
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ways.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("d"))
    group = components(links).select(F.col("id").alias("rep"), "component")
    return (
        members.join(sizes, "rep")
        .join(degree, "rep", "left")
        .join(group, "rep", "left")
        .select(
            F.col("id").alias("prompt_id"),
            F.coalesce("component", "rep").alias("group_id"),
            F.col("rep").alias("class_id"),
            (F.coalesce("d", F.lit(0)) + F.col("m") - 1).alias("links"),
        )
    )


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLES: dict[str, str] = {}
