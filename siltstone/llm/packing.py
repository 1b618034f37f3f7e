"""Problem 8: documents packed into containers of fixed capacity.

Vector best-fit decreasing.  A container has three capacities: tokens, documents and attention
cost (the sum of the squares of its items' tokens, which is what attention over the items costs).
Items come in order of size; of the open containers that can take an item under every constraint,
the one of the best score is chosen.  ``score="norm"``: the least weighted norm of what would remain
of the three capacities; ``score="dot"``: the least weighted dot product of the item with what is
left.  Both measure unused room, so the tightest fit wins.

Only the tokens are a limit of problem 8, so the other two capacities are set from the corpus itself:
a container may hold ``spread`` times the documents and the attention cost that a container of this
corpus has on average.  So they bind where documents would gather unevenly (a container of only short
texts, or only one of long ones) and cost no room on the whole; an item alone in a container is
always allowed.

Distribution: the (id, tokens) table is cut into blocks by a hash of the id; each block is packed
by itself for every capacity.  What a block leaves in containers that are not nearly full goes
through a second round, in blocks again; the number of such containers per block is small, so
hardly any room is lost to blocks.  Nothing but ids and lengths is moved.

Defined results: an item longer than the capacity is divided into pieces of the full capacity
and a remainder, one container per full piece (the attention cost of a full piece alone is allowed
always); items of no tokens (null or empty texts) take a document slot and no room; a null length
counts as zero; rows that repeat an id are packed as items of their own; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tokenize import count_tokens
from siltstone.plans import materialize, scan

SCHEMA = "budget_id int, capacity int, doc_id bigint, piece int, tokens int, block bigint, bin int, free int"

#: Weights of the residual capacities (tokens, documents, attention cost) in the score.
WEIGHTS = (1.0, 0.05, 0.05)
#: What the capacities for documents and attention cost allow, as a multiple of the average container's.
SPREAD = 8.0


def pack(sizes: np.ndarray, capacity: int, max_documents: int, max_cost: float, score: str = "norm", tally: dict | None = None) -> np.ndarray:
    """Container number of each item; ``sizes`` must fall and be at most ``capacity``.

    An item that alone exceeds ``max_cost`` has a container of its own.  ``tally`` counts, for each
    capacity, the containers that it alone kept an item out of.
    """
    n = len(sizes)
    where = np.empty(n, np.int64)
    if not n:
        return where
    size = 1024
    room = np.zeros((3, size))  # shares of each capacity that are left in the open containers
    name = np.zeros(size, np.int64)
    used = made = 0
    least = float(sizes[-1]) / capacity
    for i in range(n):
        tokens = float(sizes[i])
        need = (tokens / capacity, 1.0 / max_documents, tokens * tokens / max_cost)
        at = -1
        if used:
            r = room[:, :used]
            enough = [r[k] >= need[k] - 1e-12 for k in range(3)]
            fits = np.flatnonzero(enough[0] & enough[1] & enough[2])
            if tally is not None:
                for k, what in enumerate(("tokens", "documents", "cost")):
                    tally[what] = tally.get(what, 0) + int((~enough[k] & enough[k - 1] & enough[k - 2]).sum())
            if len(fits):
                r = r[:, fits]
                if score == "dot":
                    cost = WEIGHTS[0] * r[0] * (need[0] + 1e-9) + WEIGHTS[1] * r[1] * need[1] + WEIGHTS[2] * r[2] * need[2]
                else:
                    left = r - np.array(need)[:, None]
                    cost = WEIGHTS[0] * left[0] ** 2 + WEIGHTS[1] * left[1] ** 2 + WEIGHTS[2] * left[2] ** 2
                at = int(fits[int(cost.argmin())])
        if at < 0:
            if used == size:
                size *= 2
                room = np.concatenate([room, np.zeros_like(room)], 1)
                name = np.concatenate([name, np.zeros_like(name)])
            at, used = used, used + 1
            room[:, at] = 1.0
            name[at] = made
            made += 1
        where[i] = name[at]
        room[:, at] -= need
        np.maximum(room[:, at], 0.0, out=room[:, at])
        if room[0, at] < least - 1e-12 or room[1, at] < 0.5 / max_documents or (least > 0 and room[0, at] < 0.5 / capacity):
            if tally is not None and room[0, at] >= least - 1e-12 and room[1, at] < 0.5 / max_documents:
                tally["documents"] = tally.get("documents", 0) + 1  # full by number while there is room
            used -= 1  # nothing that comes later fits: the last open container takes its place
            room[:, at] = room[:, used]
            name[at] = name[used]
    return where


def limits(sizes: np.ndarray, capacity: int, spread: float) -> tuple[int, float]:
    """Documents and attention cost that a container may hold, from what these items have on average."""
    containers = max(1.0, float(sizes.sum()) / capacity)
    documents = max(1, int(np.ceil(spread * len(sizes) / containers)))
    return documents, max(1.0, spread * float((sizes.astype(float) ** 2).sum()) / containers)


def _pack_block(frame: pd.DataFrame, spread: float, score: str) -> pd.DataFrame:
    frame = frame.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    capacity = int(frame["capacity"].iat[0])
    sizes = frame["tokens"].to_numpy()
    where = pack(sizes, capacity, *limits(sizes, capacity, spread), score)
    sums = np.bincount(where, weights=frame["tokens"].to_numpy(), minlength=int(where.max()) + 1 if len(where) else 0)
    frame = frame.assign(bin=where.astype("int32"), free=(capacity - sums[where]).astype("int32"))
    return frame[[c.split()[0] for c in SCHEMA.split(", ")]]


def pieces(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """Items of every budget, those above the capacity divided (``piece`` counts from 0).

    The budgets are a handful of rows, whatever the size of the corpus, so they are read once and
    attached to each item as a literal array.
    """
    wanted = [(r.budget_id, r.capacity) for r in budgets.where("capacity > 0").orderBy("budget_id").collect()]
    choice = F.array(*(F.struct(F.lit(b).cast("int").alias("b"), F.lit(c).cast("int").alias("c")) for b, c in wanted))
    each = items.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("n"), F.explode(choice).alias("x"))
    c = F.col("x.c")
    count = F.greatest(F.ceil(F.col("n") / c), F.lit(1)).cast("int")
    return each.select(
        F.col("x.b").alias("budget_id"),
        c.alias("capacity"),
        "doc_id",
        "n",
        F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"),
    ).select(
        "budget_id",
        "capacity",
        "doc_id",
        "piece",
        F.least(F.col("capacity"), F.col("n") - F.col("piece") * F.col("capacity")).cast("int").alias("tokens"),
    )


def pack_all(
    items: DataFrame,
    budgets: DataFrame,
    block_rows: int = 6000,
    spread: float = SPREAD,
    score: str = "norm",
    loose: float = 0.02,
) -> DataFrame:
    """(budget_id, doc_id, piece, tokens, container) of every item of ``items(doc_id, tokens)``.

    ``spread`` and ``score``: see the module's docstring; ``loose``: containers of the first round
    with more than this share of free room are packed again, by the limits of their own items.
    """
    each = pieces(items, budgets)
    total = items.count()
    blocks = max(1, -(-total // block_rows))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(frame, spread, score)

    first = materialize(
        each.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
        .withColumns({"bin": F.lit(0), "free": F.lit(0)})
        .groupBy("budget_id", "block")
        .applyInPandas(packed, SCHEMA),
        "packed",
    )
    open_ = F.col("free") > F.col("capacity") * loose
    again = max(1, blocks // 16)
    second = (
        first.where(open_)
        .withColumn("block", -1 - F.pmod(F.xxhash64("block"), F.lit(again)))
        .groupBy("budget_id", "block")
        .applyInPandas(packed, SCHEMA)
    )
    return (
        first.where(~open_)
        .unionByName(second)
        .select(
            "budget_id",
            "doc_id",
            "piece",
            "tokens",
            F.concat_ws("-", "budget_id", "block", "bin").alias("container"),
        )
    )


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of every document by byte_bpe_50k."""
    docs = scan(spark, sf_dir, "documents", "doc_id", "text")
    return materialize(count_tokens(docs), "lengths")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (or piece of one) for each capacity of ``token_budgets``."""
    return pack_all(lengths(spark, sf_dir), scan(spark, sf_dir, "token_budgets", "budget_id", "capacity"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of unused room per budget."""
    budgets = scan(spark, sf_dir, "token_budgets", "budget_id", "capacity")
    bins = p8_containers(spark, sf_dir).groupBy("budget_id", "container").agg(F.sum("tokens").alias("t"))
    return (
        bins.groupBy("budget_id")
        .agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
        .join(budgets, "budget_id")
        .withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))
    )


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}
