"""Python sources to units, call sites, routes and call edges.

Parsing needs the syntax tree, so files go through mapInPandas once, one row a unit with its call
sites in an array; everything after (types, resolution, statistics) is DataFrame work.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = (
    "file string, unit_id string, name string, class_name string, start_line int, end_line int, decorators array<string>, parameters array<string>, "
    "docstring string, code string, calls array<struct<base:string,name:string>>, imports map<string,string>, is_lambda boolean"
)


def _sites(body: list[ast.AST]) -> list[tuple[str | None, str]]:
    """(receiver, name) of calls below the nodes, those of nested definitions left to their own units."""
    found, todo = set(), list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                found.add((None, f.id))
            elif isinstance(f, ast.Attribute):
                found.add((ast.unparse(f.value)[:200], f.attr))
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            todo.extend(ast.iter_child_nodes(node))
    return sorted(found, key=lambda x: (x[0] or "", x[1]))


def _imports(tree: ast.Module) -> dict[str, str]:
    out = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            out |= {a.asname or a.name: "." * node.level + ".".join(filter(None, (node.module, a.name))) for a in node.names}
    return out


def _units(rel: str, source: str) -> Iterator[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines, imports = source.split("\n"), _imports(tree)

    def row(node: ast.AST, path: tuple[str, ...], cls: str | None, body: list[ast.AST], first: int, last: int, **more) -> dict:
        base = {"decorators": [], "parameters": [], "docstring": None, "is_lambda": False}
        code = "\n".join(lines[first - 1 : last])
        return base | {"file": rel, "unit_id": f"{rel}:{'.'.join(path)}", "name": path[-1], "class_name": cls, "start_line": first, "end_line": last, "code": code, "calls": _sites(body), "imports": imports} | more

    def walk(body: list[ast.AST], path: tuple[str, ...], cls: str | None) -> Iterator[dict]:
        for node in body:
            if isinstance(node, ast.ClassDef):
                yield from walk(node.body, (*path, node.name), node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                named = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                decorators = ["@" + ast.unparse(d) for d in node.decorator_list]
                said = ast.get_docstring(node)
                yield row(node, (*path, node.name), cls, node.body, first, node.end_lineno, decorators=decorators, parameters=named, docstring=said[:500] if said else None)
                yield from walk(node.body, (*path, node.name), None)
            elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Lambda) and isinstance(node.targets[0], ast.Name):
                yield row(node, (*path, node.targets[0].id), cls, [node.value.body], node.lineno, node.end_lineno, parameters=[x.arg for x in node.value.args.args], is_lambda=True)

    yield from walk(tree.body, (), None)
    loose = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))]
    loose = [n for n in loose if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant))]
    if loose:
        yield row(tree, ("__module__",), None, loose, loose[0].lineno, loose[-1].end_lineno)


def units(found: DataFrame) -> DataFrame:
    """Units of all Python files of a table (rel, source); files that do not parse give none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.sub(r"<[^ ]*>", "", UNITS).split(", ")]
        for batch in batches:
            for rel, source in zip(batch["rel"], batch["source"]):
                yield pd.DataFrame([*_units(rel, source)], columns=names)

    raw = found.where("source IS NOT NULL").select("rel", "source").mapInPandas(parse, UNITS)
    return raw.withColumn("unit_type", unit_type(F.col("decorators"), F.col("class_name"), F.col("name"), F.col("file"), F.col("is_lambda")))


def _has_segment(path: Column, name: str) -> Column:
    """A folder of that name or a file name.py."""
    parts = F.split(F.lower(path), "/")
    return F.exists(parts, lambda x: (x == name) | (x == f"{name}.py"))


# Decorators of web routes and the methods that class-based views dispatch to.
ROUTES = (
    r"@app\.route", r"@router\.", r"@blueprint\.", r"@app\.(get|post|put|delete|patch|options|head|websocket)\b", r"@get", r"@post", r"@put", r"@delete",
    r"@(api|v1|router)\.\w", r"@routes\.(get|post|put|delete|patch|options|head|view|route|static)\b", r"@app\.websocket_route",
)
DISPATCH = ("get", "post", "put", "patch", "delete", "head", "options", "trace")


def unit_type(decorators: Column, class_name: Column, name: Column, path: Column, is_lambda: Column) -> Column:
    """The kind of a Python unit; the first rule that holds decides."""
    said, low = F.lower(F.array_join(decorators, " ")), F.lower(name)
    file = F.lower(F.element_at(F.split(path, "/"), -1))
    tests = path.rlike("(?i)(^|/)tests?/") | file.rlike("^test_|_test\\.py$|^test\\.py$")
    return (
        F.when(name == "__module__", "module_level").when(said.rlike("|".join(ROUTES)), "route_handler")
        .when(_has_segment(path, "views") & (class_name.isNull() | low.isin(*DISPATCH)), "view_function")
        .when(class_name.isNotNull(), F.when(name == "__init__", "constructor").when(name.rlike("^__.*__$"), "dunder_method")
              .when(said.rlike(r"@(functools\.)?(cached_)?property\b|@\w+\.(setter|deleter|getter)\b"), "property")
              .when(said.contains("@staticmethod"), "static_method").when(said.contains("@classmethod"), "class_method").otherwise("method"))
        .when(low.contains("middleware") | _has_segment(path, "middleware"), "middleware")
        .when(name.startswith("test_") | tests, "test").when(name.rlike("^_(?!_)"), "private_function").otherwise("function")
    )


# Kinds of units and reads of user input that make an entry point.
ENTRY_TYPES = ("route_handler", "route_middleware", "view_function", "websocket_handler", "cli_handler", "main", "init", "http_handler", "middleware")
ENTRY_DECORATORS = (*ROUTES, r"@api_view", r"@action\b", r"@csrf_exempt", r"@(websocket|socketio|sio)\.", r"@app\.on_event", r"@click\.(command|group)", r"@app\.command", r"@shared_task(?=\(|\s+@|\s*$)", r"@(?:\w+\.)?receiver\s*\(")
USER_INPUT = (r"request\.(args|form|json|data|files|values|get_json)", r"request\.environ", r"request\.(query_params|body|json)", r"\b(Query|Body|Form|File|Header|Cookie)\s*\(", r"request\.(GET|POST|data|FILES|body)", r"req\.(body|query|params|cookies|headers)")


def entry_reasons(kind: Column, name: Column, decorators: Column, code: Column) -> Column:
    """Why a unit is an entry point: an ordered list, empty where it is none."""
    said = F.array_join(decorators, " ")
    read = F.coalesce(*(F.nullif(F.regexp_extract(code, f"({p})", 1), F.lit("")) for p in USER_INPUT))
    by_type = F.when(kind.isin(*ENTRY_TYPES), F.concat(F.lit("unit_type:"), kind)).when(name == "main", "name:main")
    found = [by_type, F.when(name == "lambda_handler", "name:lambda_handler"), F.when(said.rlike("(?i)" + "|".join(ENTRY_DECORATORS)), "decorator"), F.concat(F.lit("input_pattern:"), F.left(read, F.lit(30)))]
    return F.array_compact(F.array(*found))


def routes(found: DataFrame) -> DataFrame:
    """unit_id, receiver, method, path of routes declared by decorators."""
    d = found.select("unit_id", F.explode("decorators").alias("d"))
    shape = r"^@(\w+)\.(route|get|post|put|delete|patch|options|head|websocket)\(\s*['\"]([^'\"]*)['\"]"
    part = lambda i: F.regexp_extract("d", shape, i)
    several = F.regexp_extract_all(F.regexp_extract("d", r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    methods = F.when(part(2) != "route", F.array(F.upper(part(2)))).when(F.size(several) > 0, F.transform(several, F.upper)).otherwise(F.array(F.lit("GET")))
    return d.where(F.col("d").rlike(shape)).select("unit_id", part(1).alias("receiver"), F.explode(methods).alias("method"), part(3).alias("path"))


def call_edges(found: DataFrame) -> DataFrame:
    """Distinct (src, dst): call sites resolved by scope.

    self.x goes to a method of the same class; a bare name to a function of the same file, else,
    where the file imports it, to the function of that name in a file that ends as the module says
    (a failed import goes nowhere), else to the only function of that name anywhere that is neither
    method nor lambda.  Self-calls are left out."""
    sites = found.select(F.col("unit_id").alias("src"), "file", "class_name", "imports", F.explode("calls").alias("c")).select("src", "file", "class_name", "imports", "c.base", "c.name")
    defs = found.where("name <> '__module__'").select(F.col("unit_id").alias("dst"), F.col("file").alias("dst_file"), F.col("class_name").alias("dst_class"), F.col("name").alias("dst_name"), "is_lambda")
    top = defs.where("dst_class IS NULL")
    own = sites.where("base IN ('self', 'cls') AND class_name IS NOT NULL").join(defs, (F.col("file") == F.col("dst_file")) & (F.col("class_name") == F.col("dst_class")) & (F.col("name") == F.col("dst_name")))
    bare = sites.where("base IS NULL OR base NOT IN ('self', 'cls')").withColumn("via", F.coalesce(F.try_element_at("imports", F.coalesce("base", "name")), F.lit(None).cast("string")))
    local = top.groupBy("dst_file", "dst_name").agg(F.min("dst").alias("local_dst"))
    bare = bare.join(local, (F.col("file") == F.col("dst_file")) & (F.col("name") == F.col("dst_name")) & F.col("base").isNull(), "left").drop("dst_file", "dst_name")
    same = bare.where("local_dst IS NOT NULL").select("src", F.col("local_dst").alias("dst"))
    rest = bare.where("local_dst IS NULL")
    # imported: module path plus name, joined on name and on the file's path as a module
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("dst_file", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    target = F.when(F.col("base").isNull(), F.regexp_replace(F.regexp_replace("via", r"^\.+", ""), r"(^|\.)[^.]+$", "")).otherwise(F.regexp_replace("via", r"^\.+", ""))
    real = F.when(F.col("base").isNull(), F.element_at(F.split("via", "\\."), -1)).otherwise(F.col("name"))
    wanted = rest.where("via IS NOT NULL").select("src", target.alias("module"), real.alias("real"))
    paths = top.select("dst", "dst_name", module.alias("dst_module"))
    ends = (F.col("dst_module") == F.col("module")) | F.col("dst_module").endswith(F.concat(F.lit("."), F.col("module")))
    imported = wanted.where("module <> ''").join(paths, (F.col("real") == F.col("dst_name")) & ends).groupBy("src", "module", "real").agg(F.min("dst").alias("dst"), F.count_distinct("dst").alias("n")).where("n = 1").select("src", "dst")
    lone = top.where("NOT is_lambda").groupBy("dst_name").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1")
    anywhere = rest.where("via IS NULL AND base IS NULL").join(lone, F.col("name") == F.col("dst_name")).select("src", "dst")
    out = own.select("src", "dst").unionByName(same).unionByName(imported).unionByName(anywhere)
    return out.where("src <> dst").distinct()


def unit_statistics(found: DataFrame) -> DataFrame:
    """unit_type, n, with_docstring, mean_lines (two digits)."""
    return found.groupBy("unit_type").agg(F.count(F.lit(1)).alias("n"), F.count("docstring").alias("with_docstring"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 2).alias("mean_lines"))
