"""Typed edges: resolution of names, edge algebra, and adjacency, all with counts n instead of repeated rows.

Edges are (src, dst, kind, n). n counts parallel edges, so names with thousands of targets multiply counts, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: ids or names that are broadcast at most; more are joined by a shuffle
BROADCAST_IDS = 1_000_000


def few(rows: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows, to be broadcast if there are few enough."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def spread(rows: DataFrame, partitions: int | None, *columns: str) -> DataFrame:
    """In as many parts as told, else as the next shuffle makes them."""
    return rows.repartition(partitions, *columns) if partitions else rows


def symbols_by_name(symbols: DataFrame, id_col: str = "id", name_col: str = "symbol_name") -> DataFrame:
    """name (lower case), ids: all symbols of a name."""
    return symbols.groupBy(F.lower(F.col(name_col)).alias("name")).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def grouped(refs: DataFrame) -> DataFrame:
    """References with repeated ones counted, before any join."""
    n = F.sum("n") if "n" in refs.columns else F.count("*")
    return refs.groupBy("src", "ref_name", "kind").agg(n.alias("n"))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def resolve(refs: DataFrame, symbols: DataFrame, mode: str = "exact", id_col: str = "id", name_col: str = "symbol_name", kinds: dict[str, list[str]] | None = None, kind_col: str = "symbol_kind") -> DataFrame:
    """Edges from each reference to every symbol of its name, in any case.

    mode suffix: a dotted name that matches none is looked up by its last segment. kinds: for an edge kind, the symbol kinds that it may point at.

    Sources with the same names are one class; the edges of each class are counted once, where its targets are, and given to all its sources last. So
    only symbols and references are shuffled, not their pairs.
    """
    from .pagerank import cut

    if mode not in ("exact", "suffix"):
        raise ValueError("mode must be exact or suffix")
    names = symbols.select(F.lower(F.col(name_col)).alias("name"), F.col(id_col).alias("dst"), *([F.col(kind_col).alias("dst_kind")] if kinds else []))
    wanted = cut(grouped(refs).withColumn("name", F.lower("ref_name")))
    asked = wanted.select("name") if mode == "exact" else wanted.select(F.explode(F.array("name", last_segment(F.col("name")))).alias("name"))
    own = names.join(few(asked.distinct()), "name", "left_semi").groupBy(*names.columns).agg(F.count("*").alias("m"))
    own = cut(own.repartition("dst"))
    known = few(cut(own.select("name").distinct()))
    if mode == "suffix":
        found = wanted.join(known.withColumn("__k", F.lit(True)), "name", "left")
        wanted = found.withColumn("name", F.when(F.col("__k"), F.col("name")).when(F.col("ref_name").contains("."), last_segment(F.col("name"))))
    wanted = wanted.join(known, "name", "left_semi").groupBy("src", "kind", "name").agg(F.sum("n").alias("n"))
    sources = cut(wanted.groupBy("src", "kind").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("names")))
    classes = cut(sources.select("kind", "names").distinct().withColumn("class", F.monotonically_increasing_id()))
    c = classes.withColumnsRenamed({"kind": "__k", "names": "__n"})
    members = sources.join(c, F.col("kind").eqNullSafe(F.col("__k")) & (F.col("names") == F.col("__n"))).select("class", "src")
    out = own.join(few(cut(classes.select("class", "kind", F.inline("names")))), "name")
    if kinds:
        ok = F.lit(True)
        for kind, targets in kinds.items():
            ok = ok & ((F.col("kind") != kind) | F.col("dst_kind").isin(targets))
        out = out.where(ok)
    counted = out.groupBy("class", "kind", "dst").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return counted.join(few(cut(members)), "class").select("src", "dst", "kind", "n")


def resolve_suffix_names(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """ref_name, key: keys that end in a dot and the name, for names that no key equals. The scan over all pairs is an equi-join on the last segment."""
    k = keys.select(F.col(keys.columns[0]).alias("key")).distinct().withColumn("segment", last_segment(F.lower("key")))
    r = refs.select("ref_name").distinct().withColumn("segment", last_segment(F.lower("ref_name")))
    missing = r.join(k.select(F.lower("key").alias("__k")), F.lower("ref_name") == F.col("__k"), "left_anti")
    return missing.join(k, "segment").where(F.endswith(F.lower("key"), F.concat(F.lit("."), F.lower("ref_name")))).select("ref_name", "key")


def union(*edges: DataFrame) -> DataFrame:
    """All edges of all phases; equal ones add up."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("src", "dst", "kind").agg(F.sum("n").alias("n"))


def bound(refs: DataFrame, types: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges from definitions to the types whose id they name, counted."""
    known = types.select(F.col(id_col).alias("dst")).distinct()
    return grouped(refs).join(known, F.col("ref_name") == F.col("dst")).select("src", "dst", "kind", "n")


def reverse_bindings(edges: DataFrame, kinds: tuple[str, ...] = ("XmlBindsClass", "XmlUsesComp"), kind: str = "CSharpUsedByDef") -> DataFrame:
    """For each binding an edge the other way."""
    return edges.where(F.col("kind").isin(*kinds)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(kind).alias("kind"), "n")


def valid(edges: DataFrame, nodes: DataFrame, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Edges both of whose ends are nodes. partitions: of the shuffles of the edges, where these are more than the default ones hold in memory."""
    ids = nodes.select(F.col(id_col).alias("__id")).distinct()
    own = few(ids)
    for end in ("src", "dst"):
        edges = (spread(edges, partitions, end) if own is ids else edges).join(spread(own, partitions, "__id") if own is ids else own, F.col(end) == F.col("__id"), "left_semi")
    return edges


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.lower("src") != F.lower("dst"))


def valid_references(refs: DataFrame, defs: DataFrame, id_col: str = "id", name_col: str = "symbol_name") -> DataFrame:
    """References to defs that exist, by id or by name, in any case."""
    known = defs.select(F.explode(F.array(F.lower(F.col(id_col)), F.lower(F.col(name_col)))).alias("__name")).distinct()
    return refs.join(known, F.lower("ref_name") == F.col("__name"), "left_semi")


def classified_bases(edges: DataFrame, interfaces: DataFrame, id_col: str = "id") -> DataFrame:
    """Inherits becomes Implements where the target is an interface; edges aren't shuffled if there are few enough of these to broadcast."""
    known = interfaces.select(F.col(id_col).alias("dst"), F.lit(True).alias("__i")).distinct()
    return edges.join(few(known), "dst", "left").withColumn("kind", F.when(F.col("__i") & (F.col("kind") == "Inherits"), "Implements").otherwise(F.col("kind"))).drop("__i").select("src", "dst", "kind", "n")


def node_index(symbols: DataFrame, id_col: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """node_id (0, 1, ...), id: each different id once, in order of the id (or of the least of the order's columns first).

    Ids are sorted into ranges, each range is numbered where it lies, and the sizes of the ranges before are added: one
    shuffle, however alike the ids' beginnings are. The sorted rows are cut off from their lineage, as the ranges of another run could differ.
    """
    from .pagerank import cut

    ids = symbols.groupBy(F.col(id_col).alias("id")).agg(*(F.min(c).alias(f"__{c}") for c in order)) if order else symbols.select(F.col(id_col).alias("id")).distinct()
    by = [*(f"__{c}" for c in order), "id"]
    ranges = cut(ids.repartitionByRange(*by).sortWithinPartitions(*by).select("id", F.monotonically_increasing_id().alias("__i")))
    place = F.shiftright("__i", 33).alias("__p")  # the range, and below it the place in it
    sizes = {r["__p"]: r.k for r in ranges.groupBy(place).agg(F.count("*").alias("k")).collect()}  # a row for each range
    before, first = 0, []
    for p in sorted(sizes):
        first += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.element_at(F.create_map(*first), F.shiftright("__i", 33)) if first else F.lit(0)
    return ranges.select((start + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("node_id"), "id")


def degrees(edges: DataFrame, column: str, name: str) -> DataFrame:
    """id, number of edges that begin (src) or end (dst) there, parallel ones each."""
    return edges.groupBy(F.col(column).alias("id")).agg(F.sum("n").alias(name))


def row_pointers(index: DataFrame, edges: DataFrame, column: str = "src") -> DataFrame:
    """node_id, n_edges, pointer: where each node's edges begin in a sorted list of all. Sums run over blocks of ids, then within them."""
    d = index.join(degrees(edges, column, "n_edges"), "id", "left").select("node_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.floor(F.col("node_id") / 65536).alias("__b"))
    sums = d.groupBy("__b").agg(F.sum("n_edges").alias("k"))
    before = sums.withColumn("first", F.sum("k").over(Window.orderBy("__b")) - F.col("k")).drop("k")
    within = d.withColumn("__s", F.sum("n_edges").over(Window.partitionBy("__b").orderBy("node_id")) - F.col("n_edges"))
    return within.join(before, "__b").select("node_id", "n_edges", (F.col("first") + F.col("__s")).alias("pointer"))


def adjacency(edges: DataFrame, column: str = "src", partitions: int | None = None) -> DataFrame:
    """id, neighbours: array of (id, kind, n), for those who want rows like compressed sparse ones. partitions: of the edges' shuffle, where these are more than the default ones hold in memory."""
    other = "dst" if column == "src" else "src"
    return spread(edges, partitions, column).groupBy(F.col(column).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "kind", "n"))).alias("neighbours"))


def duplicate_ids(chunks: DataFrame, id_col: str = "id", lang_col: str = "lang") -> DataFrame:
    """id, occurrences, counts (lang, n) of ids that occur more than once, counted by language first."""
    by_lang = chunks.groupBy(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    return by_lang.groupBy("id").agg(F.sum("n").alias("occurrences"), F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("counts")).where("occurrences > 1")


def containing(points: DataFrame, spans: DataFrame, on: str = "path", at: str = "offset", start: str = "span_start", end: str = "span_end", width: int = 4096) -> DataFrame:
    """Each point with the spans of its path that it is in, from start to before end. Both sides meet on path and stretches of ``width``, so a path with many of either isn't joined with itself."""
    reach = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(reach))
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    return p.join(s, [on, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def in_namespaces(rows: DataFrame, prefixes: tuple[str, ...], defined: DataFrame | None = None, column: str = "id") -> DataFrame:
    """Rows whose name begins with one of the namespaces, or is among those that the source defines."""
    inside = F.lit(False)
    for prefix in prefixes:
        inside = inside | F.startswith(F.col(column), F.lit(prefix))
    if defined is None:
        return rows.where(inside)
    known = defined.select(F.col(defined.columns[0]).alias("__id"), F.lit(True).alias("__k")).distinct()
    return rows.join(known, F.col(column) == F.col("__id"), "left").where(inside | F.col("__k")).drop("__id", "__k")


def first_of_each(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Of rows with one key the first by the order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def closure(edges: DataFrame, roots: DataFrame, kind: str = "Inherits", most: int = 50) -> DataFrame:
    """id of all that reach a root through edges of a kind (subtypes), the roots too. Rounds follow the depth; each joins only what is new."""
    from .pagerank import cut

    up = edges.where(F.col("kind") == kind).select("src", "dst").distinct()
    have = new = cut(roots.select(F.col(roots.columns[0]).alias("id")).distinct())
    for _ in range(most):
        new = cut(up.join(new, up["dst"] == new["id"]).select(F.col("src").alias("id")).distinct().join(have, "id", "left_anti"))
        if new.isEmpty():
            break
        have = cut(have.union(new))
    return have


def linkable_fields(fields: DataFrame, edges: DataFrame, base_types: list[str], def_base: str, well_known: tuple[str, ...] = ()) -> DataFrame:
    """field names of defs that may hold a class: fields (owner, name, type) of subtypes of def_base whose type, or list element, is a subtype of a base, or ``Type``; and the well-known ones."""
    spark = fields.sparkSession
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    defs, linkable = closure(edges, one([def_base])), closure(edges, one(base_types))
    element = F.coalesce(F.nullif(F.regexp_extract("type", r"^(?:\w+\.)*List<(.+)>$", 1), F.lit("")), F.col("type"))
    typed = fields.withColumn("element", element).join(defs.withColumnRenamed("id", "owner"), "owner", "left_semi")
    found = typed.join(linkable.withColumnRenamed("id", "element"), "element", "left_semi").select("name").union(typed.where(F.col("element").isin("Type", "System.Type")).select("name"))
    return found.union(one(well_known)).distinct()
