"""Nested JSON records as rows, one for each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the root that a walk goes down; a record that has more is an error.
DEPTH = 8


def _children(node: Column, path: Column) -> Column:
    """The members of an object and the elements of an array, each with its path; none of a leaf."""
    entries = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    members = F.transform(entries, lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), path.alias("parent"), e["value"].alias("node"), F.lit(True).alias("open")))
    elements = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), path.alias("parent"), x.alias("node"), F.lit(True).alias("open")))
    return F.coalesce(members, elements)


def kind_of(node: Column) -> Column:
    """object, array, string, number, boolean or null; other kinds by Spark's name of them."""
    name = F.lower(F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0))
    return F.when(name.isin("bigint", "decimal", "double", "float", "int", "smallint", "tinyint"), "number").when(name == "void", "null").otherwise(name)


def plain_number(text: Column) -> Column:
    """A number's digits without zeros at the end of its fraction, so that 1, 1.0 and 1.00 are one."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def walk(df: DataFrame, column: str, root: str = "$", depth: int = DEPTH) -> DataFrame:
    """``df`` without ``column``, a JSON text, but with a row for each of its nodes: path, parent, kind, value (of leaves).

    The tree is walked level by level over a variant, in one pass of generators
    and without a shuffle. A node's path is its parent's with ``.name`` or
    ``[place]``. Null and text that isn't JSON (an object with a name twice
    isn't) are one node of kind ``invalid`` without a value. A tree of more than
    ``depth`` levels is an error when it is met, not cut off.
    """
    kept = [c for c in df.columns if c != column]
    start = F.struct(F.lit(root).alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(F.col(column)).alias("node"), F.lit(True).alias("open"))
    rows = df.select(*kept, start.alias("__n"))
    for _ in range(depth + 1):
        n = F.col("__n")
        done = F.struct(n["path"].alias("path"), n["parent"].alias("parent"), n["node"].alias("node"), F.lit(False).alias("open"))
        rows = rows.select(*kept, F.explode(F.concat(F.array(done), F.coalesce(F.when(n["open"], _children(n["node"], n["path"])), F.array().cast(f"array<{_NODE}>")))).alias("__n"))
    n = F.col("__n")
    node = F.when(n["open"], F.raise_error(F.concat(F.lit(f"more than {depth} levels at "), n["path"])).cast("variant")).otherwise(n["node"])
    rows = rows.select(*kept, n["path"].alias("path"), n["parent"].alias("parent"), node.alias("__v"))
    kind = F.coalesce(kind_of(F.col("__v")), F.lit("invalid"))
    text = F.when(~kind.isin("object", "array", "null", "invalid"), F.col("__v").cast("string"))
    return rows.select(*kept, "path", "parent", kind.alias("kind"), F.when(kind == "number", plain_number(text)).otherwise(text).alias("value"))


_SIDE = "struct<kind:string,value:string,members:map<string,variant>,elements:array<variant>>"
_PAIR = f"struct<path:string,difference:string,a:{_SIDE},b:{_SIDE}>"


def _side(node: Column) -> Column:
    """A node's kind, value (of leaves) and children; null where there is no node."""

    def known(n: Column) -> Column:
        kind = F.when(n["m"].isNotNull(), "object").when(n["l"].isNotNull(), "array").otherwise(kind_of(n["v"]))
        text = F.when(n["m"].isNull() & n["l"].isNull(), n["v"].cast("string"))
        return F.when(n["v"].isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "number", plain_number(text)).otherwise(text).alias("value"), n["m"].alias("members"), n["l"].alias("elements")).cast(_SIDE))

    parts = F.struct(node.alias("v"), F.try_variant_get(node, "$", "map<string,variant>").alias("m"), F.try_variant_get(node, "$", "array<variant>").alias("l"))
    return F.transform(F.array(parts), known)[0]


def _pair(path: Column, a: Column, b: Column) -> Column:
    """Two sides of a place with their difference, null if there is none as yet."""
    kinds = F.when(b.isNull(), "missing").when(a.isNull(), "extra").when(a["kind"] != b["kind"], "kind")
    return F.struct(path.alias("path"), F.coalesce(kinds, F.when(~a["value"].eqNullSafe(b["value"]), "value")).alias("difference"), a.alias("a"), b.alias("b")).cast(_PAIR)


def _holds(pair: Column) -> Column:
    """Whether a pair without a difference has children to compare."""
    sizes = [F.coalesce(F.size(pair[s][c]), F.lit(0)) for s in ("a", "b") for c in ("members", "elements")]
    return pair["difference"].isNull() & (F.greatest(*sizes) > 0)


def differences(a: Column, b: Column, there_a: Column, there_b: Column, root: str = "$", depth: int = DEPTH) -> Column:
    """The highest places where two JSON texts differ: path, difference, a and b with kind and value. Both trees are walked together, and no subtree that only one has.

    Places to compare below ``depth`` levels are an error.
    """
    invalid = F.struct(F.lit("invalid").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("map<string,variant>").alias("members"), F.lit(None).cast("array<variant>").alias("elements")).cast(_SIDE)
    top = lambda text, there: F.when(there, F.coalesce(_side(F.try_parse_json(text)), invalid))
    sides = lambda path, x, y: F.struct(path.alias("path"), _side(x).alias("a"), _side(y).alias("b"))

    def below(n: Column) -> Column:
        members = F.map_values(F.map_zip_with(n["a"]["members"], n["b"]["members"], lambda k, x, y: sides(F.concat(n["path"], F.lit("."), k), x, y)))
        both = F.zip_with(n["a"]["elements"], n["b"]["elements"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        elements = F.transform(both, lambda e, i: sides(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), e["x"], e["y"]))
        return F.transform(F.coalesce(members, elements), lambda c: _pair(c["path"], c["a"], c["b"]))

    def step(found: Column, _: Column) -> Column:
        further = F.flatten(F.transform(found, lambda n: F.when(_holds(n), below(n)).otherwise(F.array(n))))
        return F.when(F.exists(found, _holds), F.filter(further, lambda n: n["difference"].isNotNull() | _holds(n))).otherwise(found)

    start = F.transform(F.array(F.struct(top(a, there_a).alias("a"), top(b, there_b).alias("b"))), lambda r: _pair(F.lit(root), r["a"], r["b"]))
    found = F.reduce(F.sequence(F.lit(1), F.lit(depth)), start.cast(f"array<{_PAIR}>"), step)
    deep = lambda n: F.raise_error(F.concat(F.lit(f"more than {depth} levels at "), n["path"])).cast("string")
    return F.filter(F.transform(found, lambda n: F.struct(n["path"].alias("path"), F.when(_holds(n), deep(n)).otherwise(n["difference"]).alias("difference"), *(F.struct(n[s]["kind"].alias("kind"), n[s]["value"].alias("value")).alias(s) for s in ("a", "b")))), lambda n: n["difference"].isNotNull())


_NODE = "struct<path:string,parent:string,node:variant,open:boolean>"
