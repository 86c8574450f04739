"""Writes: what a change table makes of a collection, and changes of schemas.

A change upserts or removes one container of an entity: an attribute, its parent,
its scope, a reference, a price, or (container ENTITY) the entity itself. The last
writer of a container wins, by (version, index); a removal of the entity voids all
changes before it, and later ones make it anew. All is one left outer join of the
collection with a row for each changed entity, so entities that nothing changed
are only read.

Bodies are text: of an attribute its value, of PARENT and SCOPE the key and the
name, of a REFERENCE {"ref_pk", "group_pk", attributes...} under the reference's
name and the referenced key ("suppliers:12"), of a PRICE the price's columns under
its price_id. A body that can't be taken in the column's type is null.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.catalog import Attribute, Catalog, Collection, Reference
from shelfwise.constraints import QueryError

ATTRIBUTE, PARENT, SCOPE, REFERENCE, PRICE, ENTITY = "ATTRIBUTE", "PARENT", "SCOPE", "REFERENCE", "PRICE", "ENTITY"


def _latest(changes: DataFrame, upto: int | None) -> DataFrame:
    """(pk, removed, containers): of every changed entity whether it was removed at some time, and the last change of each container since; null pk and other areas don't count."""
    rows = changes.where("pk is not null and area = 'DATA'")
    if upto is not None:
        rows = rows.where(F.col("version") <= upto)
    at = F.struct("version", "index")
    gone = F.when((F.col("container_type") == ENTITY) & (F.col("operation") == "REMOVE"), at)
    # Containers first: an entity may have a long history, but few containers.
    last = rows.groupBy("pk", "container_type", "container_name").agg(F.max(at).alias("at"), F.max_by(F.struct("operation", "body"), at).alias("c"), F.max(gone).alias("gone"))
    entry = F.struct(F.concat_ws("\0", "container_type", F.coalesce("container_name", F.lit(""))).alias("key"), F.struct("at", "c.operation", "c.body").alias("value"))
    whole = last.groupBy("pk").agg(F.max("gone").alias("gone"), F.max("at").alias("at"), F.collect_list(entry).alias("all"))
    since = F.when(F.col("gone").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: x["value"]["at"] > F.col("gone")))
    return whole.select("pk", F.col("gone").isNotNull().alias("removed"), F.map_from_entries(since).alias("containers"))


def _key(kind: str, name: str = "") -> Column:
    return F.lit(f"{kind}\0{name}")


def _applied(frame: DataFrame, latest: DataFrame) -> DataFrame:
    """The entities' frame after the changes."""
    kinds = dict(frame.dtypes)
    l = latest.withColumnRenamed("pk", "__pk")
    both = frame.join(l, F.col("pk") == F.col("__pk"), "full_outer")
    anew = F.coalesce("removed", F.lit(False)) | F.col("pk").isNull()
    there = F.col("__pk").isNull() | ~F.col("removed") | (F.size("containers") > 0)

    def value(name: str, kind: str, key: Column) -> Column:
        old = F.when(~anew, F.col(name))
        c = F.col("containers")[key]
        new = F.when(c["operation"] == "REMOVE", F.lit(None)).otherwise(F.from_json(c["body"], kind) if kind.startswith(("array", "map", "struct")) else c["body"].try_cast(kind))
        return F.when(F.col("__pk").isNotNull() & F.map_contains_key(F.col("containers"), key), new).otherwise(old)

    columns = []
    for name in frame.columns:
        if name == "pk":
            columns.append(F.coalesce("pk", "__pk").cast(kinds["pk"]).alias("pk"))
        elif name == "scope":
            columns.append(F.coalesce(value(name, kinds[name], _key(SCOPE)), F.lit("LIVE")).alias(name))
        elif name == "parent_pk":
            columns.append(value(name, kinds[name], _key(PARENT)).alias(name))
        else:
            columns.append(value(name, kinds[name], _key(ATTRIBUTE, name)).alias(name))
    return both.where(there).select(*columns)


def _rows(rows: DataFrame, latest: DataFrame, kind: str, prefix: str, key: list[str]) -> DataFrame:
    """Rows of a reference or of prices after the changes: those that changed, and those of removed entities, are replaced."""
    l = latest.withColumnRenamed("pk", "__pk")
    each = l.select("__pk", F.explode("containers").alias("name", "c")).where(F.col("name").startswith(f"{kind}\0{prefix}"))
    fields = T.StructType([f for f in rows.schema.fields if f.name != "pk"])
    new = each.withColumn("row", F.from_json("c.body", fields)).select(F.col("__pk").cast(rows.schema["pk"].dataType).alias("pk"), F.substring_index("name", "\0" if kind == PRICE else ":", -1).alias("__id"), "row", F.col("c.operation").alias("__operation"))
    names = key[-1]
    kept = rows.join(l.where("removed").select("__pk"), F.col("pk") == F.col("__pk"), "left_anti")
    kept = kept.join(new.select(F.col("pk").alias("__pk"), "__id"), (F.col("pk") == F.col("__pk")) & (F.col(names).cast("string") == F.col("__id")), "left_anti")
    added = new.where("__operation = 'UPSERT'").select("pk", *(F.col("row")[f.name].alias(f.name) if f.name != names else F.col("__id").cast(f.dataType).alias(f.name) for f in fields.fields))
    return kept.unionByName(added)


def applied(collection: Collection, changes: DataFrame, upto: int | None = None) -> Collection:
    """A collection after the changes of its entity type, up to a version if one is given."""
    latest = _latest(changes.where(F.col("entity_type") == collection.name), upto)
    references = {name: replace(r, frame=_rows(r.frame, latest, REFERENCE, f"{name}:", ["pk", "ref_pk"])) for name, r in collection.references.items()}
    prices = None if collection.prices is None else _rows(collection.prices, latest, PRICE, "", ["pk", "price_id"])
    return replace(collection, frame=_applied(collection.frame, latest), references=references, prices=prices)


# Schemas


def _changed(catalog: Catalog, collection: Collection) -> Catalog:
    return Catalog({**catalog.collections, collection.name: collection})


def with_collection(catalog: Catalog, collection: Collection) -> Catalog:
    if collection.name in catalog.collections:
        raise QueryError(f"there is a collection {collection.name} already")
    return _changed(catalog, collection)


def without_collection(catalog: Catalog, name: str) -> Catalog:
    """Without a collection; references of others must not lead to it."""
    catalog[name]
    for c in catalog.collections.values():
        for r, reference in c.references.items():
            if c.name != name and name in (reference.target, reference.group):
                raise QueryError(f"reference {r} of {c.name} leads to {name}")
    return Catalog({k: v for k, v in catalog.collections.items() if k != name})


def renamed_collection(catalog: Catalog, old: str, new: str) -> Catalog:
    if new in catalog.collections:
        raise QueryError(f"there is a collection {new} already")
    turn = lambda x: new if x == old else x
    out = {}
    for c in catalog.collections.values():
        references = {k: replace(r, target=turn(r.target), group=turn(r.group)) for k, r in c.references.items()}
        out[turn(c.name)] = replace(c, name=turn(c.name), references=references)
    catalog[old]
    return Catalog(out)


_SQL = {"int": "int", "decimal": "decimal(20,4)", "string": "string", "timestamp": "timestamp", "date": "date", "boolean": "boolean"}


def with_attribute(catalog: Catalog, collection: str, name: str, attribute: Attribute) -> Catalog:
    """With an attribute, or one whose flags are changed; a new one has no values yet."""
    c = catalog[collection]
    frame = c.frame
    if name not in frame.columns:
        kind = _SQL[attribute.type]
        kind = f"struct<from: {kind}, to: {kind}>" if attribute.range else kind
        kind = f"array<{kind}>" if attribute.array else kind
        frame = frame.withColumn(name, F.lit(None).cast(f"map<string, {kind}>" if attribute.localized else kind))
    return _changed(catalog, replace(c, frame=frame, attributes={**c.attributes, name: attribute}))


def without_attribute(catalog: Catalog, collection: str, name: str) -> Catalog:
    c = catalog[collection]
    c.attribute(name)
    used = [k for k, parts in c.compounds.items() if any(p[0] == name for p in parts)]
    if used:
        raise QueryError(f"compound {used[0]} needs attribute {name}")
    return _changed(catalog, replace(c, frame=c.frame.drop(name), attributes={k: v for k, v in c.attributes.items() if k != name}))


def with_compound(catalog: Catalog, collection: str, name: str, parts: tuple[tuple[str, str, str], ...]) -> Catalog:
    c = catalog[collection]
    for attribute, direction, nulls in parts:
        if not c.attribute(attribute).sortable or direction not in ("ASC", "DESC") or nulls not in ("FIRST", "LAST"):
            raise QueryError(f"{attribute} {direction} {nulls} can't be part of a compound")
    return _changed(catalog, replace(c, compounds={**c.compounds, name: parts}))


def with_reference(catalog: Catalog, collection: str, name: str, reference: Reference) -> Catalog:
    c = catalog[collection]
    for target in (reference.target, reference.group):
        if target is not None:
            catalog[target]
    return _changed(catalog, replace(c, references={**c.references, name: reference}))


def without_reference(catalog: Catalog, collection: str, name: str) -> Catalog:
    c = catalog[collection]
    c.reference(name)
    return _changed(catalog, replace(c, references={k: v for k, v in c.references.items() if k != name}))
