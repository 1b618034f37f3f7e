"""Problem 7: byte-pair encoding of a whole corpus inside Catalyst.

The text is cut into words by the tokenizer's own pattern on the JVM.  Words that are tokens
themselves are looked up in a literal map; the others go, each distinct word of the corpus once,
through a fold of ranked merges over their bytes (``aggregate`` over arrays of one-byte pieces,
ranks from a literal rank map) and come back to their documents by a join on the word.  No Python
runs on an executor.

A piece is held as the Latin-1 string of its bytes, so that concatenating strings concatenates
bytes.  The literal maps are arrays of small maps, addressed by ``hash``: a Spark map is searched
linearly, so one map of 50,000 entries would be far too slow.

Defined results: a null or empty text has the empty list; equal texts have equal lists; every row
of the input appears once, also where ids repeat (rows are then told apart by nothing, and each
gets its own list); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import materialize, scan, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The word pattern of the vocabulary (white space as Unicode defines it), with its
#: alternatives factored and its runs possessive, which matches the same words faster.
WORDS = (
    r"'(?:[stmd]|re|ve|ll)"
    r"| ?(?:\p{L}++|\p{N}++|[^\p{IsWhite_Space}\p{L}\p{N}]++)"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}++"
)

BUCKETS = 1 << 16

#: Words of more bytes than this are folded in chunks, with equal results.
LONG = 512
#: A pair is held as its rank above ``OFFSET`` bits with the offset of its left piece; ``NONE`` and above have no rank.
OFFSET = 31
MASK = (1 << OFFSET) - 1
NONE = 1 << 60


def read_ranks(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    """The vocabulary as bytes -> rank, which is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _spark_hash(data: bytes) -> int:
    """What Spark's ``hash`` gives for a string: Murmur3 by words of four bytes, then byte by byte."""
    mask = 0xFFFFFFFF

    def mixed(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = (h << 13 | h >> 19) & mask
        return (h * 5 + 0xE6546B64) & mask

    h, n = 42, len(data)
    for i in range(0, n - n % 4, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[n - n % 4 :]:
        h = mixed(h, b if b < 128 else b | 0xFFFFFF00)
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def _literal(entries: dict[str, int], kind: str = "int") -> Column:
    """``entries`` as one literal: an array of BUCKETS small maps (null where empty), folded from JSON once."""
    table: list[dict[str, int] | None] = [None] * BUCKETS
    for key, value in entries.items():
        at = _spark_hash(key.encode()) % BUCKETS
        table[at] = (table[at] or {}) | {key: value}
    return F.from_json(F.lit(json.dumps(table)), f"array<map<string,{kind}>>")


def _lookup(table: Column, key: Column) -> Column:
    return F.get(table, F.hash(key).bitwiseAND(BUCKETS - 1))[key]


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _start(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(MASK).cast("bigint"))


def _pair(rank: Column, start: Column) -> Column:
    return F.coalesce(F.shiftleft(rank.cast("bigint"), OFFSET), F.lit(NONE).cast("bigint")) + start


def _place(s: Column, m: Column) -> Column:
    """Place (from 1) of ``m`` in ``s``, whose offsets rise; ``array_position`` ends by an exception and costs far more."""
    return F.size(F.filter(s, lambda x: _start(x) < _start(m))) + 1


def _merged(s: Column, j: Column, rank, n: Column) -> Column:
    """The pairs ``s`` after the ``j``-th (from 1) has become one piece; ``rank(a, b)`` is that of bytes a to b."""
    begin = lambda k: _start(F.get(s, k))
    end = lambda k: F.coalesce(begin(k), n)
    own = _pair(F.when(begin(j + 1).isNotNull(), rank(begin(j - 1), end(j + 2))), begin(j - 1))
    left = _pair(rank(begin(j - 2), end(j + 1)), begin(j - 2))
    # flattening a list of three is cheaper than F.concat, which goes through a lazy list
    return F.flatten(
        F.array(
            F.slice(s, 1, F.greatest(j - 2, F.lit(0))),
            F.when(j > 1, F.array(left, own)).otherwise(F.array(own)),
            F.slice(s, j + 2, F.size(s)),
        )
    )


def encode_word(word: Column, table: Column) -> Column:
    """Ids of one word: its bytes, folded by ranked merges.

    The table is bound once: each place that named it would ship a copy of it with every task.
    """
    latin = F.decode(word.cast("binary"), "ISO-8859-1")
    return _let(
        table, lambda ranks: _let(latin, lambda text: _let(F.octet_length(word).cast("bigint"), lambda n: _fold(text, n, ranks)))
    )


def _fold(text: Column, n: Column, ranks: Column) -> Column:
    """Ids of ``text``, in which every character stands for one byte.

    The state is one array of numbers, a piece each: the rank of the pair that the piece makes
    with the next one, and the offset of the piece.  The least number is therefore the leftmost
    pair of the lowest rank.  A word that has no such pair left is marked by -1 in front, and all
    further steps pass it on.
    """
    rank = lambda a, b: _lookup(ranks, F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))),
        lambda i: _pair(F.when(i + 1 < n, rank(i, i + 2)), i),
    )
    steps = F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1)))

    def step(s: Column, _) -> Column:
        def least(m: Column) -> Column:
            return F.when(m >= NONE, F.concat(F.array(F.lit(-1).cast("bigint")), s)).otherwise(
                _let(_place(s, m), lambda j: _merged(s, j, rank, n))
            )

        return F.when(F.get(s, F.lit(0)) < 0, s).otherwise(_let(F.array_min(s), least))

    short = F.filter(F.aggregate(steps, pairs, step), lambda x: x >= 0)
    folded = F.when(n > LONG, _long_fold(pairs, steps, rank, n)).otherwise(short)
    return _let(folded, lambda s: F.transform(s, lambda x, i: rank(_start(x), F.coalesce(_start(F.get(s, i + 1)), n))))


def _long_fold(pairs: Column, steps: Column, rank, n: Column) -> Column:
    """The same fold for a long word: the pairs are held in chunks with the least of each, so that a
    merge looks at the least ones and touches a few neighbouring chunks instead of the whole word."""
    size = F.greatest(F.sqrt(n / 4).cast("int"), F.lit(4))
    return _let(size, lambda size: _chunk_fold(pairs, steps, size, rank, n))


def _chunk_fold(pairs: Column, steps: Column, size: Column, rank, n: Column) -> Column:
    def chunked(s: Column, size: Column) -> Column:
        cut = F.sequence(F.lit(0), F.ceil(F.size(s) / size).cast("int") - 1)
        return F.transform(
            F.transform(cut, lambda k: F.slice(s, k * size + 1, size)),
            lambda part: F.struct(F.array_min(part).alias("m"), part.alias("s")),
        )

    def step(chunks: Column, _) -> Column:
        def at(least: Column) -> Column:
            m, k = least["m"], least["k"]
            # one chunk before and three after hold every piece that the merge can touch
            lo = F.greatest(k - 1, F.lit(1))
            window = F.flatten(F.transform(F.slice(chunks, lo, k - lo + 4), lambda c: c["s"]))

            def merged(w: Column) -> Column:
                joined = _let(_place(w, m), lambda j: _merged(w, j, rank, n))
                parts = _let(joined, lambda s: chunked(s, size))
                return F.flatten(F.array(F.slice(chunks, 1, lo - 1), parts, F.slice(chunks, k + 4, F.size(chunks))))

            done = F.array(F.struct(F.lit(-1).cast("bigint").alias("m"), F.array().cast("array<bigint>").alias("s")))
            return F.when(m >= NONE, F.concat(done, chunks)).otherwise(_let(window, merged))

        least = F.array_min(F.transform(chunks, lambda c, i: F.struct(c["m"].alias("m"), (i + 1).alias("k"))))
        return F.when(F.get(chunks, F.lit(0))["m"] < 0, chunks).otherwise(_let(least, at))

    return F.flatten(F.transform(F.aggregate(steps, chunked(pairs, size), step), lambda c: c["s"]))


def coded(df: DataFrame, ranks: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, small, large, missing): ids of words that are tokens, and what stands for the others.

    Codes travel as 16-bit numbers (``small``), ids counted from below and the k-th missing word
    from above, which halves what is shuffled.  A document with more missing words than there are
    numbers above the vocabulary has integers instead (``large``), with -k for the k-th of them.
    """
    top = max(ranks.values())
    whole = {}
    for piece, rank in ranks.items():
        try:
            whole[piece.decode()] = rank
        except UnicodeDecodeError:
            pass
    # vocabularies of up to 65,536 ids are held as 16-bit numbers from the start
    low = (1 << 15) if top < (1 << 16) else 0
    table = _literal({piece: rank - low for piece, rank in whole.items()}, "smallint" if low else "int")
    # bound values stay objects of the JVM; columns of their own would be copied and read back element by element
    fits = lambda missing: F.size(missing) < max(0, (1 << 16) - 1 - top)
    smalls, larges = F.lit(None).cast("array<smallint>"), F.lit(None).cast("array<int>")

    def code(w: Column, c: Column, missing: Column) -> Column:
        def numbered(places: Column) -> Column:
            def place(i: Column) -> Column:
                word = F.get(w, i)
                return F.coalesce(places[F.xxhash64(word)], F.array_position(missing, word).cast("int"))

            small = F.transform(c, lambda x, i: F.coalesce(x, ((1 << 15) - place(i)).cast("smallint"))) if low else smalls
            large = F.transform(c, lambda x, i: F.coalesce(x.cast("int") + low, -place(i)))
            ok = fits(missing)
            return F.struct(
                F.when(ok, small).otherwise(smalls).alias("small"), F.when(ok, larges).otherwise(large).alias("large"), missing.alias("missing")
            )

        # found by hash in a map of numbers; where two words of a document have one hash, words are compared
        hashes = F.transform(missing, lambda x: F.xxhash64(x))
        apart = F.size(F.array_distinct(hashes)) == F.size(missing)
        none = F.create_map().cast("map<bigint,int>")
        return _let(F.when(apart, F.map_from_arrays(hashes, F.transform(missing, lambda _, i: i + 1))).otherwise(none), numbered)

    def split(w: Column) -> Column:
        def known(c: Column) -> Column:
            missing = F.array_distinct(F.filter(w, lambda _, i: F.get(c, i).isNull()))
            return _let(missing, lambda missing: code(w, c, missing))

        return _let(F.transform(w, lambda x: _lookup(table, x)), known)

    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), 0)
    return df.select(key, _let(words, split).alias("x")).select(key, "x.small", "x.large", "x.missing")


def encode(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row of ``df``; see the module's docstring for the defined results."""
    ranks = read_ranks(vocabulary)
    top = max(ranks.values())
    first = coded(spread(df.select(key, text)), ranks, key, text)
    rows = materialize(first.withColumn("row", F.monotonically_increasing_id()), "codes")
    merges = _literal({piece.decode("latin-1"): rank for piece, rank in ranks.items()})
    used = rows.where(F.size("missing") > 0).select("row", F.posexplode("missing").alias("k", "word"))
    learned = used.select("word").distinct().select("word", encode_word(F.col("word"), merges).alias("ids"))
    # both sides of either join are hashed by unique keys; hash joins save the sorts
    spelled = (
        used.join(learned.hint("shuffle_hash"), "word")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("spelled"))
    )
    word = lambda k: F.get(F.col("spelled"), k)["ids"]
    # every id as a list of its own, from a literal: made anew for each word they would cost more
    lists = F.from_json(F.lit(json.dumps([[i] for i in range(min(top + 1, 1 << 16))])), "array<array<int>>")
    small = _let(
        lists,
        lambda own: F.transform("small", lambda c: F.coalesce(F.get(own, c + F.lit(1 << 15)), word((1 << 15) - 1 - c))),
    )
    large = F.transform("large", lambda c: F.when(c >= 0, F.array(c)).otherwise(word(-c - 1)))
    return (
        rows.select(key, "row", "small", "large")
        .join(spelled.hint("shuffle_hash"), "row", "left")
        .select(key, F.flatten(F.coalesce(small, large)).alias("ids"))
    )


def count_tokens(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) of every row: as long as the lists of ``encode``, without moving the lists."""
    ranks = read_ranks(vocabulary)
    whole = {}
    for piece, rank in ranks.items():
        try:
            whole[piece.decode()] = rank
        except UnicodeDecodeError:
            pass
    table = _literal(whole)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), 0)
    counted = _let(
        words, lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: _lookup(table, x).isNull()).alias("missing"))
    )
    split = spread(df.select(key, text)).select(key, counted.alias("x")).select(key, "x.n", "x.missing")
    rows = materialize(split.withColumn("row", F.monotonically_increasing_id()), "missing")
    merges = _literal({piece.decode("latin-1"): rank for piece, rank in ranks.items()})
    used = rows.select("row", F.explode("missing").alias("word"))
    learned = used.select("word").distinct().select("word", F.size(encode_word(F.col("word"), merges)).alias("t"))
    extra = used.join(learned.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("t") - 1).alias("extra"))
    return rows.select(key, "row", "n").join(extra, "row", "left").select(
        key, (F.col("n") + F.coalesce("extra", F.lit(0))).cast("int").alias("tokens")
    )


def decode(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, ids: str = "ids", to: str = "text") -> DataFrame:
    """Add column ``to``: the text of the list ``ids``, by joining the binary pieces."""
    ranks = read_ranks(vocabulary)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), "array<string>")
    latin = F.array_join(F.transform(F.col(ids), lambda i: F.get(table, i)), "")
    return df.withColumn(to, F.encode(latin, "ISO-8859-1").cast("string"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode(scan(spark, sf_dir, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, same): every document encoded, decoded and compared with its text."""
    docs = scan(spark, sf_dir, "documents", "doc_id", "text")
    back = decode(p7_ids(spark, sf_dir), to="decoded").join(docs, "doc_id")
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"),
    )


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded}
ORACLES: dict[str, str] = {}
