"""Repository maps: symbols, imports, who uses whom, unused exports, cycles.

Symbols and imports are taken from the text by expressions per language (an approximation of a
parser that needs no external tool).  Of the rows of one file the latest counts; null and empty
files have neither symbols nor imports.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.components import components
from siltstone.plans import materialize
from siltstone.sources.repository import LANGUAGE_SQL, LATEST_FILES, files, language

_ID = r"([A-Za-z_$][\w$]*)"
#: Fixed values: (language, kind, exported, expression whose first group is the name).
SYMBOLS = (
    ("js", "function", False, rf"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\*?[ \t]+{_ID}"),
    ("js", "function", False, rf"(?m)^[ \t]*(?:export[ \t]+)?(?:const|let)[ \t]+{_ID}[ \t]*=[ \t]*(?:async[ \t]*)?\([^)\n]*\)[^=\n]*=>"),
    ("js", "class", False, rf"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+{_ID}"),
    ("js", "export", True, rf"(?m)^[ \t]*export[ \t]+(?:(?:async[ \t]+)?function\*?|class|const|let|var|interface|type|enum)[ \t]+{_ID}"),
    ("python", "function", False, r"(?m)^(?:async[ \t]+)?def[ \t]+(\w+)"),
    ("python", "class", False, r"(?m)^class[ \t]+(\w+)"),
    ("python", "export", True, r"(?m)^(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z]\w*)"),
    ("go", "function", False, r"(?m)^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(\w+)"),
    ("go", "type", False, r"(?m)^type[ \t]+(\w+)"),
    ("go", "export", True, r"(?m)^(?:func[ \t]+(?:\([^)\n]*\)[ \t]*)?|type[ \t]+|var[ \t]+|const[ \t]+)([A-Z]\w*)"),
    ("rust", "function", False, r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:async[ \t]+)?fn[ \t]+(\w+)"),
    ("rust", "type", False, r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:struct|enum|trait)[ \t]+(\w+)"),
    ("rust", "export", True, r"(?m)^pub[ \t]+(?:(?:async[ \t]+)?fn|struct|enum|mod|type|trait|const|static)[ \t]+(\w+)"),
    ("java", "class", False, r"(?m)^[ \t]*(?:public[ \t]+)?(?:final[ \t]+|abstract[ \t]+)?(?:class|interface|enum)[ \t]+(\w+)"),
    ("java", "export", True, r"(?m)^[ \t]*public[ \t]+(?:static[ \t]+)?(?:final[ \t]+)?(?:class|interface|enum)[ \t]+(\w+)"),
)
#: Fixed values: (language, expression whose first group is the source of an import).
IMPORTS = (
    ("js", r"""(?m)^[ \t]*import[ \t][^'"\n]*['"]([^'"\n]+)['"]"""),
    ("js", r"""\brequire\([ \t]*['"]([^'"\n]+)['"][ \t]*\)"""),
    ("python", r"(?m)^from[ \t]+([\w.]+)[ \t]+import\b"),
    ("python", r"(?m)^import[ \t]+([\w.]+)"),
    ("go", r"""(?m)^(?:import)?[ \t]+(?:\w+[ \t]+)?"([^"\n]+)"[ \t]*\r?$"""),
    ("rust", r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)"),
    ("java", r"(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+)"),
)
#: Fixed values: (language, expression whose first group is the source of an import that may span lines).
WRAPPED_IMPORTS = (("js", r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?(?:\{[^{}]*\}|\*\s*as\s+[\w$]+|[\w$]+)\s*from\s*['"]([^'"\n]+)['"]"""),)
#: Fixed values: (language, expression whose first group has the names of an import that may span lines).
WRAPPED_NAMES = (
    ("js", r"""(?m)^[ \t]*import\s+(?:type\s+)?((?:[\w$]+\s*,\s*)?\{[^{}]*\})\s*from\s*['"]"""),
    ("python", r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]*\(([^()#]*(?:#[^\n]*[^()#]*)*)\)"),
    ("python", r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import\b((?:[^\\\n]*\\\r?\n)+[^\n]*)"),
    ("rust", r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?use[ \t]+([\w:]*\{[^;]*);"),
)
ENTRIES = ("index", "main", "app", "server", "cli", "bin")


def _collect(df: DataFrame, packs, shape) -> Column:
    """One array of structs over all expressions of the file's language."""
    none = F.array().cast(shape)
    parts = []
    for pack in packs:
        found = F.array_distinct(F.regexp_extract_all("content", F.lit(pack[-1]), 1))
        parts.append(F.when(F.col("lang") == pack[0], F.transform(found, _row(pack))).otherwise(none))
    return F.flatten(F.array(*parts))


def _row(pack):
    if len(pack) == 2:
        return lambda x: F.struct(x.alias("source"))
    return lambda x: F.struct(F.lit(pack[1]).alias("kind"), x.alias("name"), F.lit(pack[2]).alias("exported"))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("content <> ''").select("file_id", "repo", "path", "content", language(F.col("path")).alias("lang"))


def symbol_table(source: DataFrame) -> DataFrame:
    """(file_id, repo, path, kind, name, exported)."""
    each = source.select("file_id", "repo", "path", F.explode(_collect(source, SYMBOLS, "array<struct<kind:string,name:string,exported:boolean>>")).alias("s"))
    return each.select("file_id", "repo", "path", "s.*")


def import_table(source: DataFrame) -> DataFrame:
    """(file_id, repo, path, lang, source), each source once."""
    each = source.select("file_id", "repo", "path", "lang", F.explode(F.array_distinct(_collect(source, IMPORTS + WRAPPED_IMPORTS, "array<struct<source:string>>"))).alias("s"))
    return each.select("file_id", "repo", "path", "lang", "s.source")


def candidates(path: Column, source: Column, lang: Column) -> Column:
    """Paths that an import may mean, best first: as given, with an extension, as a folder's index."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    joined = F.concat_ws("/", F.when(folder != "", folder), source)
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))),
    )
    base = F.array_join(parts, "/")
    endings = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/index.mjs", "/index.cjs")
    script = F.when(source.startswith("."), F.array(*(F.concat(base, F.lit(e)) for e in endings)))
    dotted = F.translate(source, ".", "/")
    python = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))
    return F.when(lang == "js", script).when(lang == "python", python)


def usage_edges(source: DataFrame) -> DataFrame:
    """(repo, importer, target): imports that resolve to files of the same repository."""
    wanted = import_table(source).select("repo", F.col("path").alias("importer"), "source", F.posexplode(candidates(F.col("path"), F.col("source"), F.col("lang"))).alias("rank", "target"))
    there = source.select("repo", F.col("path").alias("target")).distinct()
    found = wanted.join(there, ["repo", "target"])
    return found.groupBy("repo", "importer", "source").agg(F.min_by("target", "rank").alias("target")).select("repo", "importer", "target").where("importer <> target").distinct()


def unused(source: DataFrame, edges: DataFrame) -> DataFrame:
    """Exports that no import statement of the repository names, outside entry points.

    The certainty is LOW where the file itself is imported, MEDIUM where it is not.
    """
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", ""))
    exports = symbol_table(source).where(F.col("exported") & ~stem.isin(*ENTRIES))
    clause = F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:import|from|use)\b([^\n]*)"), 1)
    wrapped = F.transform(_collect(source, WRAPPED_NAMES, "array<struct<source:string>>"), lambda x: x["source"])
    named = source.select("repo", F.explode(F.concat(clause, wrapped)).alias("c")).select("repo", F.explode(F.regexp_extract_all("c", F.lit(r"([A-Za-z_$][\w$]*)"), 1)).alias("name")).distinct()
    targets = edges.select("repo", F.col("target").alias("path")).distinct().withColumn("imported", F.lit(True))
    return (
        exports.join(named, ["repo", "name"], "left_anti")
        .join(targets, ["repo", "path"], "left")
        .select("file_id", "repo", "path", "name", F.when(F.col("imported"), "LOW").otherwise("MEDIUM").alias("certainty"))
    )


def cycles(edges: DataFrame, bound: int = 6) -> DataFrame:
    """Cycles of up to ``bound`` files, each once: it starts at its smallest path.

    Paths grow by one edge a round and only from their smallest file, so a cycle has one path.
    """
    e = materialize(edges.select("repo", "importer", "target"), "edges")
    hop = e.select("repo", F.col("importer").alias("last"), F.col("target").alias("next"))
    paths = e.where("target > importer").select("repo", F.col("importer").alias("start"), F.array("importer", "target").alias("nodes"))
    found = None
    for _ in range(bound - 1):
        grown = materialize(paths.withColumn("last", F.element_at("nodes", -1)).join(hop, ["repo", "last"]).where("next >= start"), "paths")
        closed = grown.where("next = start").select("repo", "nodes")
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where((F.col("next") > F.col("start")) & ~F.array_contains("nodes", F.col("next"))).select("repo", "start", F.concat("nodes", F.array("next")).alias("nodes"))
        if paths.isEmpty():
            break
    return found.select("repo", F.array_join("nodes", " -> ").alias("cycle"), F.size("nodes").alias("length"))


def strong(links: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of at least two nodes, by Tarjan's search on a stack of its own."""
    after: dict[str, list[str]] = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out = []
    for root in after:
        if root in seen:
            continue
        work = [(root, iter(after[root]))]
        seen[root] = low[root] = len(seen)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in seen:
                    seen[x] = low[x] = len(seen)
                    stack.append(x)
                    on.add(x)
                    work.append((x, iter(after[x])))
                    break
                if x in on:
                    low[node] = min(low[node], seen[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    on.difference_update(part)
                    if len(part) > 1:
                        out.append(part)
    return out


def rings(edges: DataFrame, trims: int = 10) -> DataFrame:
    """(repo, cycle, length): every strongly connected component of at least two files, whatever its size, once.

    A file is on some cycle if and only if it is in one.  Edges that begin or end where no cycle can
    pass are trimmed first (for speed only: ``trims`` rounds or fewer), then each weakly connected
    part that is left is searched by one task, in time and memory linear in its edges.
    """
    shape = "repo string, cycle string, length int"
    left, before = edges.select("repo", "importer", "target"), None
    for _ in range(trims):
        entered = left.select("repo", F.col("target").alias("importer")).distinct()
        leaving = left.select("repo", F.col("importer").alias("target")).distinct()
        left = materialize(left.join(entered, ["repo", "importer"], "left_semi").join(leaving, ["repo", "target"], "left_semi"), "edges")
        size = left.count()
        if size in (0, before):
            break
        before = size
    if not size:
        return left.sparkSession.createDataFrame([], shape)
    name = lambda c: F.concat_ws("\n", "repo", c)
    part = components(left.select(name("importer").alias("a"), name("target").alias("b"))).withColumnRenamed("id", "a")

    def run(table: pa.Table) -> pa.Table:
        found = [sorted(x) for x in strong(list(zip(table["importer"].to_pylist(), table["target"].to_pylist())))]
        repo = table["repo"][0].as_py()
        return pa.table(
            {
                "repo": pa.array([repo] * len(found), pa.string()),
                "cycle": pa.array([", ".join(x) for x in found], pa.string()),
                "length": pa.array(map(len, found), pa.int32()),
            }
        )

    return left.withColumn("a", name("importer")).join(part, "a").drop("a").groupBy("component").applyInArrow(run, shape)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_table(_source(spark, sf_dir))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files import each source, per language."""
    return import_table(_source(spark, sf_dir)).groupBy("lang", "source").agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"))


def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir)
    return unused(source, usage_edges(source))


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the number of files that import them."""
    return usage_edges(_source(spark, sf_dir)).groupBy("repo", "target").agg(F.count("*").alias("importers"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of the repositories that are connected by common imports: the smallest name of each group.

    Links go from each repository to what it imports, so they grow with the imports and not with
    the pairs of repositories.
    """
    links = import_table(_source(spark, sf_dir)).where("lang in ('java', 'go')").select("repo", "source").distinct()
    return components(links.select(F.col("repo").alias("a"), F.concat(F.lit("import:"), "source").alias("b")))


def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of files that import each other in a ring, and the short rings within them.

    ``kind`` is ``component`` for a strongly connected component of any size (``cycle`` lists its
    files in order of path), ``cycle`` for an elementary cycle of up to six files.
    """
    edges = materialize(usage_edges(_source(spark, sf_dir)), "edges")
    return rings(edges).withColumn("kind", F.lit("component")).unionByName(cycles(edges).withColumn("kind", F.lit("cycle")))


_SYMBOL_SQL = " union all ".join(
    f"select file_id, repo, path, '{kind}' as kind, unnest(list_distinct(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', 1))) as name, {str(e).lower()} as exported from f where lang = '{lang}'"
    for lang, kind, e, p in SYMBOLS
)
_IMPORT_SQL = " union ".join(
    f"select file_id, repo, path, lang, unnest(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', 1)) as source from f where lang = '{lang}'" for lang, p in IMPORTS
)
_F = f"{LATEST_FILES}, f as (select file_id, repo, path, content, {LANGUAGE_SQL} as lang from latest_files where content <> '')"
QUERIES = {
    "symbols": symbols,
    "imports": imports,
    "unused_exports": unused_exports,
    "dependents": dependents,
    "modules": modules,
    "import_cycles": import_cycles,
}
ORACLES = {
    "symbols": f"with {_F} {_SYMBOL_SQL}",
    "imports": f"with {_F}, i as ({_IMPORT_SQL}) select lang, source, count(*) as files, count(distinct repo) as repos from i group by lang, source",
}
