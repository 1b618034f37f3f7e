"""Problem 4: long exact spans shared between records.

Seed and extend.  Winnowing picks anchors (hashes of ``SEED`` characters) so that every run of
``LENGTH`` characters holds one, and equal runs hold equal ones.  Anchors that occur in more than
one record are the seeds; each comes back to its text for the characters around it, and occurrences
of one seed are compared to the left and to the right.  What agrees over at least ``LENGTH``
characters is kept; overlapping or touching stretches of one record are merged, which yields the
maximal repeats.

Groups of occurrences: up to ``PAIRS`` occurrences are compared with one another (nothing but the
extended stretch of each occurrence is emitted); larger groups hash every run of ``LENGTH``
characters that holds the seed, so their work grows linearly; groups above ``HOT`` occurrences do
the same in Catalyst, where partial aggregation keeps any number of rows out of a single task.

Defined results: null texts and texts shorter than ``LENGTH`` have no spans; rows without an id are
no records, and share nothing with others; of the rows of one id
the latest counts (see ``operators.versions``); positions are code points from 0, the end excluded;
repeats inside one record alone are not shared; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.versions import latest
from siltstone.plans import materialize, scan, spread

LENGTH = 200
SEED = 100
SPAN = LENGTH - SEED  # characters on either side of a seed that a run can reach
PAIRS = 8
HOT = 2000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` codes."""
    n = len(codes)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of the winnowed anchors of ``texts``, joined to one array."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if len(codes) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = rolling(codes, SEED)
    width = SPAN + 1
    least = _sliding(hashes, width, np.minimum)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(least)] == owner[LENGTH - 1 :]
    least = np.where(inside, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, width, np.maximum) == hashes)
    doc = owner[chosen]
    return doc, chosen - (ends - sizes)[doc], hashes[chosen]


def _anchor_batches(batches):
    for batch in batches:
        ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (total < _BLOCK or to == at):
                total += len(texts[to])
                to += 1
            doc, pos, hashes = anchors(texts[at:to])
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.array(ids[at:to], np.int64)[doc]),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["h", "id", "pos"],
                )
            at = to


def _stretches(rows: pa.Table) -> pa.RecordBatch | None:
    """The stretch of each occurrence that it shares with another record; ``rows`` hold whole groups."""
    seeds = rows["h"].to_numpy()
    ids = rows["id"].to_numpy()
    pos = rows["pos"].to_numpy().astype(np.int64)
    text = rows["context"].to_pylist()
    lead = np.minimum(pos, SPAN)
    size = np.fromiter(map(len, text), np.int64, len(text))
    tail = size - lead - SEED
    wide = LENGTH + SPAN
    joined = "".join(["\0" * (SPAN - a) + t + "\0" * (wide - SPAN + a - n) for a, t, n in zip(lead.tolist(), text, size.tolist())])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(text), wide)
    n = len(seeds)
    start, end = pos.copy(), pos.copy()
    first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))

    small = count <= PAIRS
    for gap in range(1, int(count[small].max()) if small.any() else 0):
        f, c = first[small & (count > gap)], count[small & (count > gap)]
        a = np.repeat(f, c - gap) + (np.arange((c - gap).sum()) - np.repeat(np.cumsum(c - gap) - (c - gap), c - gap))
        b = a + gap
        keep = ids[a] != ids[b]
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        differs = codes[a] != codes[b]
        left = differs[:, SPAN - 1 :: -1]
        right = differs[:, SPAN + SEED :]
        reach = lambda d: np.where(d.any(1), d.argmax(1), d.shape[1])
        lo = np.minimum(reach(left), np.minimum(lead[a], lead[b]))
        hi = np.minimum(reach(right), np.minimum(tail[a], tail[b]))
        keep = ~differs[:, SPAN : SPAN + SEED].any(1) & (lo + SEED + hi >= LENGTH)
        for rows_ in (a, b):
            np.minimum.at(start, rows_[keep], pos[rows_[keep]] - lo[keep])
            np.maximum.at(end, rows_[keep], pos[rows_[keep]] + SEED + hi[keep])

    for f, c in zip(first[~small].tolist(), count[~small].tolist()):
        part = codes[f : f + c]
        hashes = np.empty((c, SPAN + 1), np.uint64)
        for i in range(c):
            hashes[i] = rolling(part[i], LENGTH)
        offset = np.arange(SPAN + 1)
        real = (offset[None, :] >= SPAN - lead[f : f + c, None]) & (offset[None, :] <= tail[f : f + c, None])
        for o in range(SPAN + 1):
            at = np.flatnonzero(real[:, o])
            if len(at) < 2:
                continue
            at = at[np.lexsort((ids[f + at], hashes[at, o]))]
            h, who = hashes[at, o], ids[f + at]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.concatenate([head[1:], [len(at)]]) - 1
            several = np.repeat(who[head] != who[last], last - head + 1)
            hit = f + at[several]
            start[hit] = np.minimum(start[hit], pos[hit] - SPAN + o)
            end[hit] = np.maximum(end[hit], pos[hit] - SPAN + o + LENGTH)

    keep = end > start
    if not keep.any():
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[keep]), pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32))], ["id", "s", "e"]
    )


def _extend(batches):
    """Group the rows, sorted by seed, across batches; a group is at most HOT rows."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        seeds = held["h"].to_numpy()
        cut = int(np.searchsorted(seeds, seeds[-1]))
        if cut:
            if (out := _stretches(held.slice(0, cut).combine_chunks())) is not None:
                yield out
            held = held.slice(cut)
    if held is not None and held.num_rows and (out := _stretches(held.combine_chunks())) is not None:
        yield out


def _contexts(batches):
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for key, text, marks in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["marks"].to_pylist()):
            for m in marks:
                p = m["pos"]
                out[0].append(m["h"])
                out[1].append(key)
                out[2].append(p)
                out[3].append(text[max(0, p - SPAN) : p + LENGTH])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["h", "id", "pos", "context"])


def _hot(marks: DataFrame) -> DataFrame:
    """(id, s, e) for seeds with any number of occurrences: every run by its hash, pre-aggregated."""
    lead = F.least("pos", F.lit(SPAN))
    shift = F.explode(F.sequence(F.lit(0), F.length("context") - LENGTH)).alias("o")
    runs = marks.where(F.length("context") >= LENGTH).select("id", (F.col("pos") - lead).alias("from"), "context", shift)
    runs = runs.select("id", (F.col("from") + F.col("o")).cast("int").alias("s"), F.sha1(F.substring("context", F.col("o") + 1, F.lit(LENGTH))).alias("run"))
    shared = runs.groupBy("run").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("run")
    return runs.join(shared, "run", "left_semi").select("id", "s", (F.col("s") + LENGTH).cast("int").alias("e"))


def merge_stretches(pieces: DataFrame) -> DataFrame:
    """Union of the intervals (id, s, e) of each id: overlapping or touching ones become one."""
    order = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("new").over(order))
    return numbered.groupBy("id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("id", "s", "e")


def shared_spans(records: DataFrame) -> DataFrame:
    """(id, s, e): the stretches of ``records(id, text)`` that occur in other records too."""
    texts = records.where(F.col("id").isNotNull() & (F.length("text") >= LENGTH))
    found = materialize(spread(texts).mapInArrow(_anchor_batches, "h bigint, id bigint, pos int"), "anchors")
    seeds = (
        found.groupBy("h")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("m"))
        .where("a <> b")
        .select("h", (F.col("m") > HOT).alias("hot"))
    )
    marks = materialize(found.join(seeds, "h"), "marks")

    def context(hot: bool) -> DataFrame:
        part = marks.where(F.col("hot") if hot else ~F.col("hot"))
        lists = part.groupBy("id").agg(F.collect_list(F.struct("h", "pos")).alias("marks"))
        return texts.join(lists, "id").select("id", "text", "marks").mapInArrow(_contexts, "h bigint, id bigint, pos int, context string")

    cold = context(False).repartition("h").sortWithinPartitions("h").mapInArrow(_extend, "id bigint, s int, e int")
    pieces = cold
    if not marks.where("hot").isEmpty():
        pieces = cold.unionByName(_hot(context(True)))
    return merge_stretches(pieces)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the latest ``agents.body`` and ``skills.content``."""
    agents = scan(spark, sf_dir, "agents", "prompt_id", "ingested_at", F.col("body").alias("text"))
    skills = scan(spark, sf_dir, "skills", "prompt_id", "ingested_at", F.col("content").alias("text"))
    both = latest(agents.unionByName(skills), "prompt_id", "ingested_at", "text")
    return both.select(F.col("prompt_id").alias("id"), "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, span_start, span_end) of every shared stretch."""
    return shared_spans(records(spark, sf_dir)).select(
        F.col("id").alias("prompt_id"), F.col("s").alias("span_start"), F.col("e").alias("span_end")
    )


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the number of its shared stretches and the share of its characters in them."""
    spans = p4_found(spark, sf_dir).groupBy("prompt_id").agg(
        F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared")
    )
    sizes = records(spark, sf_dir).groupBy(F.col("id").alias("prompt_id")).agg(F.max(F.length("text")).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(spans, "prompt_id", "left").select(
        "prompt_id",
        "chars",
        zero("spans").alias("spans"),
        zero("shared").alias("shared"),
        F.when(F.col("chars") > 0, zero("shared") / F.col("chars")).alias("share"),
    )


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares}
ORACLES: dict[str, str] = {}
