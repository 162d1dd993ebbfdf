"""Objects at any depth of JSON documents, by VARIANT values.

A document is opened level by level within one expression: the values of objects
and arrays of one level are the nodes of the next, until no node holds more. So
the table is read once, however deep its documents are, and no job runs before.
Braces within strings, objects within objects that are wanted, and documents of
unlike shapes need no rule of their own.

Cases: a null text, or one that is no JSON, has no node; a repeated key of an
object counts once, as the last said.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that may name a holder, the preferred first.
NAMES = ("holderName", "shareholderName", "name", "categoryName", "CategoryName", "desc", "label")
DEEPEST = 64


_NODES = "array<struct<node:variant,depth:int,item:boolean>>"


def _kind(node: Column) -> Column:
    return F.substring_index(F.schema_of_variant(node), "<", 1)


def _holding(nodes: Column) -> Column:
    return F.filter(nodes, lambda x: x["node"].isNotNull() & _kind(x["node"]).isin("OBJECT", "ARRAY"))


def _inside(x: Column) -> Column:
    """The values of one node."""
    none = F.array().cast(_NODES)
    one = lambda item: lambda v: F.struct(v.alias("node"), (x["depth"] + 1).alias("depth"), F.lit(item).alias("item"))
    get = lambda form: F.try_variant_get(x["node"], "$", form)
    return F.coalesce(F.transform(F.map_values(get("map<string,variant>")), one(False)), F.transform(get("array<variant>"), one(True)), none)


def nodes(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(kept columns, node, depth, item): every object and array of each
    document, and whether it is an element of an array."""
    root = F.array(F.struct(F.try_parse_json(F.col(column)).alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("item")))
    start = F.struct(_holding(root).cast(_NODES).alias("now"), F.array().cast(f"array<{_NODES}>").alias("levels"))

    def step(st, _):
        deeper = F.struct(_holding(F.flatten(F.transform(st["now"], _inside))).alias("now"), F.array_append(st["levels"], st["now"]).alias("levels"))
        return F.when(F.size(st["now"]) == 0, st).otherwise(deeper)

    def done(st):
        return F.when(F.size(st["now"]) > 0, F.raise_error(F.lit(f"documents nest deeper than {DEEPEST}")).cast(_NODES)).otherwise(F.flatten(st["levels"]))

    every = F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), start, step, done)
    return df.select(*keep, F.explode(every).alias("_n")).select(*keep, "_n.node", "_n.depth", "_n.item")


def named_objects(df: DataFrame, column: str, *keep: str, wanted: Callable[[Column], Column], names: tuple[str, ...] = NAMES) -> DataFrame:
    """Objects in arrays, at any depth, whose name is wanted: (kept columns,
    name, depth, object)."""
    said = F.coalesce(*[F.try_variant_get("node", f"$.{n}", "string") for n in names])
    items = nodes(df, column, *keep).where(F.col("item") & (_kind(F.col("node")) == "OBJECT")).withColumn("name", F.trim(said))
    return items.where((F.col("name") != "") & wanted(F.col("name"))).select(*keep, "name", "depth", F.col("node").alias("object"))
