"""Analyses of JavaScript modules as relations over the flat tree (file, node_id, parent_id, kind, name, value, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREE = "file string, node_id int, parent_id int, kind string, name string, value string, line int, col int, path array<int>, error string"
C = F.col
SCOPES = ("Program", "FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "BlockStatement", "MethodDefinition", "ClassDeclaration")


def tokens(sources: DataFrame) -> DataFrame:
    """(file, n, kind, text, line, col) of ``sources`` (file, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skerry.operators.js_ast import tokenize

        for b in batches:
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ts = tokenize(t or "")
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(ts), pa.string()), pa.array(range(len(ts)), pa.int32()), *[pa.array([getattr(x, k) for x in ts], kind) for k, kind in (("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("col", pa.int32()))]], ["file", "n", "kind", "text", "line", "col"])

    return sources.select("file", "text").mapInArrow(run, "file string, n int, kind string, text string, line int, col int")


def tree(sources: DataFrame) -> DataFrame:
    """The nodes of each file; errors are rows of kind ``Error`` without a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skerry.operators.js_ast import parse

        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string()]
        names = [x.split()[0] for x in TREE.split(", ")]
        for b in batches:
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, errors = parse(t or "")
                out = [(f, *r, None) for r in rows] + [(f, None, None, "Error", "", "", None, None, None, e) for e in errors]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return sources.select("file", "text").mapInArrow(run, TREE)


def _of(t: DataFrame, *kinds: str) -> DataFrame:
    return t.where(C("kind").isin(*kinds))


def _parents(t: DataFrame, *kinds: str) -> DataFrame:
    return _of(t, *kinds).select("file", C("node_id").alias("parent_id"), C("kind").alias("p_kind"), C("name").alias("p_name"), C("value").alias("p_value"), C("line").alias("p_line"))


def imports(t: DataFrame) -> DataFrame:
    """One row per specifier; ``is_all`` holds for namespaces and, as always, for plain names too."""
    s = _of(t, "ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier").join(_parents(t, "ImportDeclaration"), ["file", "parent_id"])
    default, space = C("kind") == "ImportDefaultSpecifier", C("kind") == "ImportNamespaceSpecifier"
    return s.select("file", C("p_value").alias("source"), C("value").alias("imported"), C("name").alias("local"), default.alias("is_default"), space.alias("is_namespace"), (space | (~default & (C("value") == C("name")))).alias("is_all"), "node_id", "line")


def local(imported: DataFrame, name: str) -> DataFrame:
    """The first import of each file under a local name."""
    w = Window.partitionBy("file").orderBy("node_id")
    return imported.where(C("local") == name).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def exports(t: DataFrame) -> DataFrame:
    """(file, exported, local, source, kind): lists, declarations, defaults and whole modules."""
    s = _of(t, "ExportSpecifier").join(_parents(t, "ExportNamedDeclaration"), ["file", "parent_id"]).select("file", C("name").alias("exported"), C("value").alias("local"), C("p_value").alias("source"), F.lit("list").alias("kind"))
    inside = t.join(_parents(t, "ExportNamedDeclaration", "ExportDefaultDeclaration"), ["file", "parent_id"])
    d = inside.where(C("kind").isin("FunctionDeclaration", "ClassDeclaration") | (C("p_kind") == "ExportDefaultDeclaration"))
    default = C("p_kind") == "ExportDefaultDeclaration"
    d = d.select("file", F.when(default, "default").otherwise(C("name")).alias("exported"), C("name").alias("local"), F.lit("").alias("source"), F.when(default, "default").otherwise("declaration").alias("kind"))
    var = inside.where("kind = 'VariableDeclaration'").select("file", C("node_id").alias("parent_id"))
    w = Window.partitionBy("file", "parent_id").orderBy("node_id")
    v = _of(t, "VariableDeclarator").join(var, ["file", "parent_id"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file", C("name").alias("exported"), C("name").alias("local"), F.lit("").alias("source"), F.lit("declaration").alias("kind"))
    a = _of(t, "ExportAllDeclaration").select("file", F.when(C("name") == "", "*").otherwise(C("name")).alias("exported"), F.lit("").alias("local"), C("value").alias("source"), F.lit("all").alias("kind"))
    return s.unionByName(d).unionByName(v).unionByName(a)


def dep_edges(t: DataFrame) -> DataFrame:
    """(file, source, target): from ``(entry)`` to each imported module, repeats kept."""
    return _of(t, "ImportDeclaration").select("file", F.lit("(entry)").alias("source"), C("value").alias("target"))


def dep_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("file", C("source").alias("node")).union(edges.select("file", "target")).distinct()


def reverse_deps(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(C("target") == node).select("file", "source")


def call_edges(t: DataFrame) -> DataFrame:
    """(file, caller, callee) of calls to functions and classes declared in the file, once for each call.

    The caller is the nearest function declaration around the call, else ``(global)``; arrows and methods are none.
    """
    declared = _of(t, "FunctionDeclaration", "ClassDeclaration").where("name <> ''").select("file", C("name").alias("callee")).distinct()
    calls = _of(t, "CallExpression").select("file", C("node_id").alias("call"), C("name").alias("callee"), "path").join(declared, ["file", "callee"])
    funcs = _of(t, "FunctionDeclaration").select("file", C("node_id").alias("anc"), C("name").alias("caller"))
    up = calls.select("file", "call", "callee", F.explode_outer("path").alias("anc")).join(funcs, ["file", "anc"], "left")
    return up.groupBy("file", "call", "callee").agg(F.max_by("caller", F.when(C("caller").isNotNull(), C("anc"))).alias("caller")).select("file", F.coalesce("caller", F.lit("(global)")).alias("caller"), "callee")


def callees(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(C("caller") == name).select("file", "callee")


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(C("callee") == name).select("file", "caller")


def templates(t: DataFrame) -> DataFrame:
    """(file, node_id, tag, parts, n_expressions, is_static, text) of template literals, tagged ones once."""
    kids = t.join(_parents(t, "TemplateLiteral"), ["file", "parent_id"])
    part = F.when(C("kind") == "TemplateElement", F.struct("node_id", "value"))
    g = kids.groupBy("file", "parent_id").agg(F.array_sort(F.collect_list(part)).alias("ps"), F.count_if(C("kind") != "TemplateElement").alias("n_expressions"))
    lit = _of(t, "TemplateLiteral").select("file", "node_id", C("parent_id").alias("up"))
    tags = _of(t, "TaggedTemplateExpression").select("file", C("node_id").alias("up"), C("name").alias("tag"))
    parts = F.transform("ps", lambda p: p["value"])
    out = lit.join(g.withColumnRenamed("parent_id", "node_id"), ["file", "node_id"]).join(tags, ["file", "up"], "left")
    return out.select("file", "node_id", F.coalesce("tag", F.lit("")).alias("tag"), parts.alias("parts"), "n_expressions", (C("n_expressions") == 0).alias("is_static"), F.array_join(parts, "").alias("text"))


def scopes(t: DataFrame) -> DataFrame:
    """(file, scope, kind, path): nodes that open a scope, with the way down to them."""
    return _of(t, *SCOPES).select("file", C("node_id").alias("scope"), "kind", F.concat("path", F.array("node_id")).alias("path"))


def symbols(t: DataFrame) -> DataFrame:
    """(file, scope, name, kind, node_id): the last declaration of each name in its scope."""
    names = {"VariableDeclarator": "variable", "PatternName": "variable", "Parameter": "parameter", "FunctionDeclaration": "function", "ClassDeclaration": "class", "ImportSpecifier": "import", "ImportDefaultSpecifier": "import", "ImportNamespaceSpecifier": "import"}
    kind = F.lit("")
    for k, v in names.items():
        kind = F.when(C("kind") == k, v).otherwise(kind)
    decl = t.withColumn("k", kind).where("k <> '' and name <> ''").select("file", "name", "k", "node_id", F.explode("path").alias("scope"))
    at = decl.join(scopes(t).select("file", "scope"), ["file", "scope"]).groupBy("file", "name", "k", "node_id").agg(F.max("scope").alias("scope"))
    return at.groupBy("file", "scope", "name").agg(F.max_by("k", "node_id").alias("kind"), F.max("node_id").alias("node_id"))


def resolve(t: DataFrame, name: str) -> DataFrame:
    """(file, use, decl, kind): for each use of a name the nearest declaration around it."""
    uses = _of(t, "Identifier").where(C("name") == name).select("file", C("node_id").alias("use"), F.explode("path").alias("scope"))
    found = uses.join(symbols(t).where(C("name") == name).select("file", "scope", C("node_id").alias("decl"), "kind"), ["file", "scope"])
    return found.groupBy("file", "use").agg(F.max_by("decl", "scope").alias("decl"), F.max_by("kind", "scope").alias("kind"))


def enclosing(t: DataFrame) -> DataFrame:
    """(file, node_id, scope): the nearest scope around each node, the program's if there is no other."""
    up = t.where("kind <> 'Error'").select("file", "node_id", F.explode_outer("path").alias("scope")).join(scopes(t).select("file", "scope", F.lit(True).alias("is_scope")), ["file", "scope"], "left")
    return up.groupBy("file", "node_id").agg(F.coalesce(F.max(F.when(C("is_scope"), C("scope"))), F.lit(0)).alias("scope"))


def exported_name(exported: Column, local_: Column) -> Column:
    return F.coalesce(F.nullif(exported, F.lit("")), local_)
