"""Problem 9: text quality statistics, and a hidden Markov model that labels lines.

Every line that is not blank is reduced to a few discrete statistics.  A hidden Markov model over
these observations (states prose, list, table, junk; trained here by hard expectation-maximisation
on labelled documents) labels the lines of a document, and the shares of its characters under each
label are summed per document.  A document whose prose share is below one half is no natural prose.

Training takes at most ``max_labelled`` labelled documents (a documented bound: the model has a few
hundred parameters), chosen by a hash of their id, and seed lines that stand for each state where
labels are few.  Statistics and labels are computed over every document and its whole text.

Defined results: null, empty and white-space texts have zero words, null means and shares, and no
verdict (they are no cases); labels that are null or unknown are not used; of several labels of one
document the most frequent counts, of equally frequent ones the first by name; repeated rows yield
repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import scan, spread

STATES = ("prose", "list", "table", "junk")

#: Lines that show what each state means; they outweigh nothing once labels exist.
SEEDS = {
    "prose": (
        "The reader opens the file and checks that all of its parts are there before it goes on.",
        "we could not find out why this was so, but it has not happened again since then",
        "Wenn die Datei fehlt, wird sie aus dem Archiv geholt und noch einmal geprüft.",
        "Si le fichier est absent, il faut que la copie soit prise dans le dossier.",
        "Cuando el archivo no está en la carpeta, se toma una copia de la otra.",
        "如果文件没有更新,我们会先检查记录,然后再导出。",
        "このファイルは先に確認してから実行してください。",
    ),
    "list": ("- first entry", "* fix reader (#12)", "3. clean folder", "1) open gate;", "blue door", "apples, old pears, red plums, small nuts,"),
    "table": ("| name | size | date |", "| --- | --- | --- |", "name\tsize\tdate", "alpha   12    2024-01-02   yes", "a,12,2024-01-02,yes,3.5"),
    "junk": (
        "aGVsbG8gd29ybGQgdGhpcyBpcyBub3RoaW5nIGJ1dCBub2lzZQx9Zk31LqPw==",
        "2024-03-01T10:11:12Z [INFO] reader.open: code=3 took 14ms",
        "    at Reader.open (lib/reader.js:12:9)",
        "?!;: ,.. ''\" ;;:: ?!",
        "00ff 3a9c 77b1 0e20 91d4",
        "Laâ€copieâ€nâ€estâ€pasâ€prÃªte",
    ),
}

_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_DIGIT = re.compile(r"\d")
_SYMBOL = re.compile(r"[^\w\s]")
_MARK = re.compile(r"(?:[-*+•–]|\d{1,4}[.)]|[a-zA-Z][.)]|\[[ xX]\])\s+")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_DAMAGE = re.compile("\ufffd|Ã.|â€|Â[^\\w\\s]")
_STOP = re.compile("[.!?。!?…][\"')\\]»”`*_]*$")

#: Upper bounds of the buckets of each real-valued statistic.
BOUNDS = {
    "words": (0, 1, 3, 5, 8, 14),
    "common": (0.0, 0.06, 0.12, 0.2, 0.3, 0.42),
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.4),
    "digits": (0.0, 0.05, 0.15, 0.35),
    "length": (2.5, 4.5, 6.0, 8.0, 12.0),
    "gaps": (0, 1, 3),
    "pipes": (0, 1),
    "commas": (0.0, 0.1, 0.25, 0.45),
    "damage": (0.0, 0.02, 0.06),
    "token": (4.0, 9.0, 16.0, 30.0),
}
SIZES = tuple(len(b) + 1 for b in BOUNDS.values()) + (4, 2, 2, 2)


def _bucket(value: float, bounds: tuple) -> int:
    for i, bound in enumerate(bounds):
        if value <= bound:
            return i
    return len(bounds)


def observe(line: str, common: frozenset, chars: frozenset, before: str = "") -> tuple[int, ...]:
    """The discrete statistics of one line that is not blank, and of its likeness to the line before."""
    s = line.strip()
    low = s.lower()
    cjk = _CJK.findall(s)
    n = len(s)
    if len(cjk) * 3 > n:
        words = len(cjk) / 2
        share = sum(c in chars for c in cjk) / len(cjk)
        length = token = 5.0
    else:
        found = _WORD.findall(low)
        words = len(found)
        share = sum(w in common for w in found) / words if words else 0.0
        length = sum(map(len, found)) / words if words else 0.0
        token = n / (s.count(" ") + 1)
    mark = 1 if _MARK.match(s) else 2 if s[0] == "#" else 3 if line[0] in " \t" else 0
    values = (
        words,
        share,
        len(_SYMBOL.findall(s)) / n,
        len(_DIGIT.findall(s)) / n,
        length,
        len(_GAP.findall(s)),
        s.count("|"),
        (s.count(",") + s.count(";") + s.count("、") + s.count(",")) / (words or 1),
        len(_DAMAGE.findall(s)) / n,
        token,
    )
    rest = (mark, 1 if _STOP.search(s) else 0, 1 if s[0].isupper() else 0, 1 if line == before else 0)
    return tuple(map(_bucket, values, BOUNDS.values())) + rest


def observed(text: str | None, common: tuple[frozenset, frozenset]) -> tuple[list[str], list[tuple[int, ...]]]:
    """The lines of a text that are not blank, and their statistics."""
    lines = _lines(text)
    return lines, [observe(line, *common, before) for line, before in zip(lines, ["", *lines])]


class Model:
    """Log emissions per statistic and log transitions."""

    def __init__(self, docs: list[tuple[int, list[tuple]]], rounds: int = 4, bias: float = 1.5, seeds: list | None = None):
        guess = [[label] * len(lines) for label, lines in docs]
        seeds = seeds or []
        for _ in range(rounds):
            emit = [[[0.5] * size for size in SIZES] for _ in STATES]
            move = [[1.0 + 8.0 * (a == b) for b in STATES] for a in STATES]
            begin = [1.0] * len(STATES)
            for state, line in seeds:
                for f, v in enumerate(line):
                    emit[state][f][v] += 1.0
            for (_, lines), states in zip(docs, guess):
                before = None
                for line, state in zip(lines, states):
                    for f, v in enumerate(line):
                        emit[state][f][v] += 1.0
                    if before is None:
                        begin[state] += 1.0
                    else:
                        move[before][state] += 1.0
                    before = state
            self.emit = [[[math.log(x / sum(row)) for x in row] for row in table] for table in emit]
            self.move = [[math.log(x / sum(row)) for x in row] for row in move]
            self.begin = [math.log(x / sum(begin)) for x in begin]
            self.memo: dict[tuple, list[float]] = {}
            guess = [self.label(lines, [bias * (s == label) for s in range(len(STATES))]) for label, lines in docs]
        self.memo = {}

    def likelihood(self, line: tuple) -> list[float]:
        found = self.memo.get(line)
        if found is None:
            found = self.memo[line] = [sum(table[f][v] for f, v in enumerate(line)) for table in self.emit]
        return found

    def label(self, lines: list[tuple], bias: list[float] | None = None) -> list[int]:
        """The most probable states of the lines of one document (Viterbi)."""
        if not lines:
            return []
        m = self.move
        e = self.likelihood(lines[0])
        bias = bias or [0.0] * len(STATES)
        score = [self.begin[s] + e[s] + bias[s] for s in range(4)]
        back = []
        for line in lines[1:]:
            e = self.likelihood(line)
            a, b, c, d = score
            score, pointers = [], []
            for s in range(4):
                best, at = a + m[0][s], 0
                if (x := b + m[1][s]) > best:
                    best, at = x, 1
                if (x := c + m[2][s]) > best:
                    best, at = x, 2
                if (x := d + m[3][s]) > best:
                    best, at = x, 3
                score.append(best + e[s] + bias[s])
                pointers.append(at)
            back.append(pointers)
        state = score.index(max(score))
        path = [state]
        for pointers in reversed(back):
            state = pointers[state]
            path.append(state)
        return path[::-1]


def _lines(text: str | None) -> list[str]:
    return [line for line in re.split(r"\r\n?|\n", text) if line and not line.isspace()] if text else []


def common_sets(words: list[tuple[str, str]]) -> tuple[frozenset, frozenset]:
    """(words, CJK characters) of a table of common words."""
    spaced = frozenset(w.lower() for _, w in words if w and not _CJK.match(w))
    return spaced, frozenset(c for _, w in words if w and _CJK.match(w) for c in w)


def _common_words(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The fixed table of common words (a few hundred rows)."""
    return [(r.lang, r.word) for r in scan(spark, sf_dir, "common_words", "lang", "word").distinct().collect()]


def fit(docs: DataFrame, labels: DataFrame, common: tuple[frozenset, frozenset], max_labelled: int = 4000) -> Model:
    """Train the model on at most ``max_labelled`` labelled documents."""
    votes = labels.where(F.col("label").isin(*STATES)).groupBy("doc_id", "label").count()
    chosen = (
        votes.groupBy("doc_id")
        .agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch["label"],
                    "seen": pa.array(
                        [[v for line in observed(t, common)[1] for v in line] for t in batch["text"].to_pylist()],
                        pa.list_(pa.int32()),
                    ),
                }
            )

    # the chosen rows are bounded by max_labelled, so broadcasting them is safe at any size
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("label", "text")
        .mapInArrow(read, "label string, seen array<int>")
        .collect()
    )
    width = len(SIZES)
    data = sorted(
        (STATES.index(r.label), [tuple(r.seen[i : i + width]) for i in range(0, len(r.seen), width)]) for r in rows
    )
    seeds = [(STATES.index(s), observe(line, *common)) for s, lines in SEEDS.items() for line in lines]
    return Model(data, seeds=seeds)


def label_lines(docs: DataFrame, model: Model, common: tuple[frozenset, frozenset]) -> DataFrame:
    """(doc_id, n_lines, prose, list, table, junk): shares of the characters under each label."""

    def labelled(batches):
        for batch in batches:
            shares, counts = [], []
            for text in batch["text"].to_pylist():
                lines, seen = observed(text, common)
                sums = [0, 0, 0, 0]
                for line, state in zip(lines, model.label(seen)):
                    sums[state] += len("".join(line.split()))
                total = sum(sums)
                shares.append([x / total for x in sums] if total else [None] * 4)
                counts.append(len(lines))
            out = {"doc_id": batch["doc_id"], "n_lines": pa.array(counts, pa.int32())}
            out |= {f"{s}_share": pa.array([x[i] for x in shares], pa.float64()) for i, s in enumerate(STATES)}
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, n_lines int, " + ", ".join(f"{s}_share double" for s in STATES)
    return spread(docs.select("doc_id", "text")).mapInArrow(labelled, schema)


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each document's characters by label, and the verdict ``is_prose``."""
    docs = scan(spark, sf_dir, "documents", "doc_id", "text")
    common = common_sets(_common_words(spark, sf_dir))
    model = fit(docs, scan(spark, sf_dir, "doc_labels", "doc_id", "label"), common)
    return label_lines(docs, model, common).withColumn("is_prose", F.col("prose_share") >= 0.5)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each document that is no natural prose."""
    return p9_labels(spark, sf_dir).where(~F.col("is_prose")).select("doc_id")


def text_statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Per-document statistics, on the JVM.

    A word is a run of letters and digits; symbols are characters that are neither letters, digits
    nor white space, as a share of all but white space; a line ends in punctuation if its last
    character is one of ``. ! ? : ; 。 ! ?``; common words are those of the table, any language.
    """
    words = [r.word for r in common.select(F.lower("word").alias("word")).distinct().collect()]  # fixed: some hundreds
    text = F.coalesce("text", F.lit(""))
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.filter(F.split(text, r"\r?\n", -1), lambda x: x.rlike(r"[^\s]"))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    base = docs.select(
        "doc_id",
        found.alias("w"),
        lines.alias("lines"),
        n(r"[^\p{L}\p{N}\s]").alias("symbols"),
        n(r"[\p{L}\p{N}]").alias("letters"),
    )
    count = F.size("w")
    return base.select(
        "doc_id",
        count.cast("bigint").alias("word_count"),
        F.when(count > 0, F.col("letters") / count).alias("mean_word_length"),
        F.when(F.col("letters") + F.col("symbols") > 0, F.col("symbols") / (F.col("letters") + F.col("symbols"))).alias("symbol_share"),
        F.when(
            F.size("lines") > 0,
            F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;。!?]\s*$"))) / F.size("lines"),
        ).alias("punctuated_share"),
        F.when(count > 0, F.size(F.filter("w", lambda x: x.isin(words))) / count).alias("common_share"),
    )


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count, mean word length and the shares of each document."""
    return text_statistics(scan(spark, sf_dir, "documents", "doc_id", "text"), scan(spark, sf_dir, "common_words", "word"))


QUERIES = {"p9_found": p9_found, "p9_labels": p9_labels, "p9_statistics": p9_statistics}
ORACLES = {
    "p9_statistics": r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), b as (
  select doc_id, t,
    list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda x: x <> '') as w,
    list_filter(regexp_split_to_array(t, '\r?\n'), lambda x: regexp_matches(x, '[^\s\x0b]')) as ls,
    length(regexp_replace(t, '[\p{L}\p{N}\s\x0b]', '', 'g')) as symbols,
    length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) as letters
  from d
), c as (select list(distinct lower(word)) as cw from common_words)
select doc_id, len(w)::bigint as word_count,
  case when len(w) > 0 then letters / len(w) end as mean_word_length,
  case when letters + symbols > 0 then symbols / (letters + symbols) end as symbol_share,
  case when len(ls) > 0 then len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;。!?][\s\x0b]*$'))) / len(ls) end as punctuated_share,
  case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(cw, x))) / len(w) end as common_share
from b, c
""",
}
