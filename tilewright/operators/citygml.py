"""City models over the node table: textured features, texture maps, alignment, subsets.

Containment is a range join on (doc, pre, last): an equi join on the document and
a bin of positions, with the range as residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import floats, reference
from tilewright.plans.cut import cut

#: Object types that carry level-of-detail geometry, and the namespaces' prefixes.
OBJECT_TYPES = ["CityFurniture", "Building", "BuildingPart", "Road", "Railway", "SolitaryVegetationObject", "PlantCover"]
BIN = 4096


def below(upper: DataFrame, lower: DataFrame, how: str = "inner", width: int = BIN) -> DataFrame:
    """Pairs of an ``a``-row and a ``d``-row of the same document where a contains d (never itself).

    Positions fall into bins of ``width``: a stands in each bin that its range
    touches and d in the one bin of its place, so that a pair meets exactly once
    and a document of any size costs about its nodes times their depth.
    """
    of = lambda c: F.floor(F.col(c) / width).cast("long")
    a = upper.withColumn("_bin", F.explode(F.sequence(of("pre"), of("last")))).alias("a")
    d = lower.withColumn("_bin", of("pre")).alias("d")
    return a.join(d, (F.col("a.path") == F.col("d.path")) & (F.col("a._bin") == F.col("d._bin")) & (F.col("d.pre") > F.col("a.pre")) & (F.col("d.pre") <= F.col("a.last")), how)


# Appearances


def textured_ids(nodes: DataFrame, target_from: str = "text") -> DataFrame:
    """(path, polygon) of targets within appearance members; the reference is the target's text, its uri, or either."""
    uri = F.col("d.attrs")["uri"]
    ref = {"text": F.trim("d.text"), "uri": uri, "both": F.coalesce(uri, F.trim("d.text"))}[target_from]
    found = below(nodes.where("local = 'Appearance'"), nodes.where("local = 'target'"))
    return found.select(F.col("d.path").alias("path"), reference(ref).alias("polygon")).where("polygon IS NOT NULL").distinct()


def texture_targets(nodes: DataFrame) -> DataFrame:
    """(path, polygon, texture, at) of each target uri below a parameterised texture with an image."""
    textures = nodes.where("local = 'ParameterizedTexture'")
    image = nodes.where("local = 'imageURI'").groupBy("path", "parent_pre").agg(F.min_by("text", "pre").alias("texture"))
    named = textures.join(image.withColumnsRenamed({"path": "_p", "parent_pre": "_pre"}), (F.col("path") == F.col("_p")) & (F.col("pre") == F.col("_pre"))).drop("_p", "_pre")
    pairs = below(named, nodes.where("local = 'target'"))
    return pairs.select(
        F.col("a.path").alias("path"), reference(F.col("d.attrs")["uri"]).alias("polygon"), F.col("a.texture").alias("texture"),
        F.col("d.pre").alias("at")
    ).where("polygon IS NOT NULL")


def textured_elements(nodes: DataFrame, polygons: DataFrame) -> DataFrame:
    """Elements with an id that contain a textured polygon: path, gml_id, pre, last, local and how many.

    Of elements that share an id the last in document order stands for it.
    """
    own = nodes.where("local = 'Polygon' AND gml_id IS NOT NULL").join(
        polygons.select(F.col("path").alias("_p"), "polygon"), (F.col("path") == F.col("_p")) & (F.col("gml_id") == F.col("polygon")), "left_semi"
    )
    found = below(nodes.where("gml_id IS NOT NULL AND last > pre"), own)  # leaves contain nothing and are most of the nodes
    per_id = found.groupBy(F.col("a.path").alias("path"), F.col("a.gml_id").alias("gml_id")).agg(F.countDistinct("d.gml_id").alias("polygons"))
    place = nodes.where("gml_id IS NOT NULL").groupBy("path", "gml_id").agg(F.max(F.struct("pre", "last", "local")).alias("at"))
    return per_id.join(place, ["path", "gml_id"]).select("path", "gml_id", "polygons", "at.pre", "at.last", "at.local")


def outermost_parents(elements: DataFrame) -> DataFrame:
    """(path, gml_id, parent): the first ancestor in document order among the elements, that is the outermost."""
    found = below(elements, elements)
    return found.groupBy(F.col("d.path").alias("path"), F.col("d.gml_id").alias("gml_id")).agg(F.min_by("a.gml_id", "a.pre").alias("parent"))


def innermost(elements: DataFrame, parents: DataFrame, strict: bool = False) -> DataFrame:
    """Elements that are nobody's outermost parent; ``strict`` leaves out all that contain another."""
    outer = below(elements, elements).select(F.col("a.path").alias("path"), F.col("a.gml_id").alias("parent")) if strict else parents.select("path", "parent")
    named = outer.distinct().select(F.col("path").alias("_p"), F.col("parent").alias("_id"))
    return elements.join(named, (F.col("path") == F.col("_p")) & (F.col("gml_id") == F.col("_id")), "left_anti")


def with_parents(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """(path, gml_id, feature_type, parent) of elements, by id; parent ``''`` at the top."""
    named = elements.join(parents, ["path", "gml_id"], "left")
    return named.select("path", "gml_id", F.col("local").alias("feature_type"), F.coalesce("parent", F.lit("")).alias("parent")).orderBy("path", "gml_id")


def textured_features(nodes: DataFrame, target_from: str = "text", strict: bool = False) -> DataFrame:
    """(path, gml_id, feature_type, parent) of innermost textured elements, by id; parent ``''`` at the top.

    By default only outermost parents are taken out, so that a middle level of
    three stays; ``strict`` takes out every element that contains another.
    """
    elements = textured_elements(nodes, textured_ids(nodes, target_from))
    parents = outermost_parents(elements)
    return with_parents(innermost(elements, parents, strict), parents)


def lod_polygons(nodes: DataFrame, widen: bool = False) -> DataFrame:
    """(path, object, lod, polygon) of direct ``lodNGeometry`` children; ``widen`` takes all ``lodN...`` children."""
    tail = r"^lod([0-4])\w*$" if widen else r"^lod([0-4])Geometry$"
    objects = nodes.where(F.col("local").isin(OBJECT_TYPES) & F.col("gml_id").isNotNull()).select(
        F.col("path").alias("_p"), F.col("pre").alias("_o"), F.col("gml_id").alias("object")
    )
    lods = nodes.where(F.col("local").rlike(tail)).join(objects, (F.col("path") == F.col("_p")) & (F.col("parent_pre") == F.col("_o")))
    found = below(lods.withColumn("lod", F.concat(F.lit("LOD"), F.regexp_extract("local", tail, 1))), nodes.where("local = 'Polygon' AND gml_id IS NOT NULL"))
    return found.select(F.col("a.path").alias("path"), F.col("a.object").alias("object"), F.col("a.lod").alias("lod"), F.col("d.gml_id").alias("polygon")).distinct()


def texture_names(mapped: DataFrame, by: list[str]) -> DataFrame:
    """(by, textures): sorted distinct texture names, comma-joined, empty where a group has none."""
    return mapped.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("texture")), ", ").alias("textures"))


def texture_mapping(nodes: DataFrame, widen: bool = False) -> DataFrame:
    """(path, object, lod, textures) of each level of detail."""
    mapped = lod_polygons(nodes, widen).join(texture_targets(nodes), ["path", "polygon"], "left")
    return texture_names(mapped, ["path", "object", "lod"]).orderBy("path", "object", "lod")


# Alignment


def rings(nodes: DataFrame) -> DataFrame:
    """(path, polygon, ring, vertices): the first exterior and all interior rings of polygons with ids."""
    polygons = nodes.where("local = 'Polygon' AND gml_id IS NOT NULL")
    bounds = below(polygons, nodes.where("local IN ('exterior', 'interior')")).select(
        "a.path", F.col("a.pre").alias("p_pre"), F.col("a.gml_id").alias("polygon"), F.col("d.pre").alias("pre"), F.col("d.last").alias("last"),
        F.col("d.local").alias("kind")
    )
    first = bounds.where("kind = 'exterior'").groupBy("path", "p_pre").agg(F.min("pre").alias("first"))
    kept = bounds.join(first, ["path", "p_pre"], "left").where("kind = 'interior' OR pre = first")
    ring = below(kept, nodes.where("local = 'LinearRing'")).groupBy(
        F.col("a.path").alias("path"), F.col("a.polygon").alias("polygon"), F.col("a.pre").alias("b_pre")
    ).agg(F.min_by(F.struct("d.pre", "d.gml_id"), "d.pre").alias("r"))
    points = nodes.where("local = 'posList' AND text IS NOT NULL").groupBy("path", "parent_pre").agg(F.min_by("text", "pre").alias("points"))
    counted = ring.join(points.withColumnsRenamed({"path": "_p", "parent_pre": "_r"}), (F.col("path") == F.col("_p")) & (F.col("r.pre") == F.col("_r")))
    vertices = F.floor(F.size(floats(F.col("points"))) / 3).cast("int")
    return counted.where("r.gml_id IS NOT NULL").groupBy("path", "polygon", F.col("r.gml_id").alias("ring")).agg(F.max_by(vertices, "b_pre").alias("vertices"))


def texture_coordinates(nodes: DataFrame) -> DataFrame:
    """(path, target, ring, uv_pairs, at) of each coordinate list below a target (its uri, else text that starts with #)."""
    said = F.trim("text")
    target = F.coalesce(F.nullif(F.col("attrs")["uri"], F.lit("")), F.when(said.startswith("#"), said))
    targets = nodes.where("local = 'target'").withColumn("target", target).where("target IS NOT NULL")
    lists = below(targets, nodes.where("local = 'TexCoordList'")).groupBy(
        F.col("a.path").alias("_p"), F.col("a.pre").alias("_t"), F.col("a.target").alias("target")
    ).agg(F.min("d.pre").alias("_list"))
    coords = nodes.where("local = 'textureCoordinates' AND text IS NOT NULL").withColumn("ring", F.nullif(F.col("attrs")["ring"], F.lit(""))).where("ring IS NOT NULL")
    met = coords.join(lists, (F.col("path") == F.col("_p")) & (F.col("parent_pre") == F.col("_list")))
    return met.select("path", "target", "ring", F.floor(F.size(floats(F.col("text"))) / 2).cast("int").alias("uv_pairs"), F.col("pre").alias("at"))


def classify_alignment(coords: DataFrame, polygons: DataFrame, ring_rows: DataFrame, by: list[str]) -> DataFrame:
    """Texture coordinates (target, ring, uv_pairs) against polygons (polygon) and rings (polygon, ring, vertices).

    ``finding``: no_polygon, no_ring, count_mismatch or ok, the first that holds.
    """
    there = polygons.select(*by, F.col("polygon").alias("_polygon")).distinct()
    ring = ring_rows.select(*(F.col(c).alias(f"_r_{c}") for c in by), F.col("polygon").alias("_rp"), F.col("ring").alias("_ring"), "vertices")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    same_ring = F.lit(True)
    for c in by:
        same_ring = same_ring & (F.col(c) == F.col(f"_r_{c}"))
    known = coords.join(there.withColumnsRenamed({c: f"_{c}" for c in by}), same & (F.col("target") == F.col("_polygon")), "left")
    found = known.join(ring, same_ring & (F.col("target") == F.col("_rp")) & (F.col("ring") == F.col("_ring")), "left")
    kind = F.when(F.col("_polygon").isNull(), "no_polygon").when(F.col("_ring").isNull(), "no_ring").when(F.col("vertices") != F.col("uv_pairs"), "count_mismatch").otherwise("ok")
    return found.select(*coords.columns, "vertices", kind.alias("finding"))


def alignment_findings(nodes: DataFrame) -> DataFrame:
    """Per texture coordinate list: path, target, ring, uv_pairs, vertices, finding; plus one row per file that cannot be parsed."""
    coords = texture_coordinates(nodes).withColumns({"target": reference(F.col("target"), "strip"), "ring": reference(F.col("ring"), "strip")})
    polygons = nodes.where("local LIKE '%Polygon' AND gml_id IS NOT NULL").select("path", F.col("gml_id").alias("polygon"))
    rows = classify_alignment(coords, polygons, rings(nodes), ["path"])
    broken = nodes.where("error IS NOT NULL").selectExpr(
        "path", "CAST(NULL AS STRING) AS target", "error AS ring", "CAST(NULL AS INT) AS uv_pairs", "CAST(NULL AS INT) AS at",
        "CAST(NULL AS INT) AS vertices", "'parse_error' AS finding"
    )
    return rows.unionByName(broken)


def alignment_totals(findings: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygons, textures, errors and warnings per file, and over all files (path null); warnings are a severity that no rule uses."""
    found = findings.select(
        "path", F.lit(0).alias("polygon"), (F.col("finding") != "parse_error").cast("int").alias("texture"),
        (F.col("finding") != "ok").cast("int").alias("error")
    )
    counted = polygons.select("path", "polygon").distinct().select("path", F.lit(1).alias("polygon"), F.lit(0).alias("texture"), F.lit(0).alias("error"))
    total = lambda c: F.sum(c).cast("long")
    return found.unionByName(counted).rollup("path").agg(
        total("polygon").alias("polygons"), total("texture").alias("textures"), total("error").alias("errors"),
        F.lit(0).cast("long").alias("warnings")
    )


def alignment_summary(nodes: DataFrame) -> DataFrame:
    """The totals of the alignment findings of documents."""
    return alignment_totals(alignment_findings(nodes), nodes.where("local LIKE '%Polygon' AND gml_id IS NOT NULL").select("path", F.col("gml_id").alias("polygon")))


# Subsets


def is_subfeature() -> Column:
    """An element with an id that is no ``gml:`` geometry."""
    return F.col("gml_id").isNotNull() & (F.col("prefix") != "gml")


def keep_objects(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of documents cut down to the wanted ids: rows (id), or (path, id) where each document has its own.

    A top-level city object that is wanted stays whole. Otherwise it stays if it
    holds a wanted element (the first in document order per id): the paths to
    such elements stay with the branches that hold no sub-feature; branches off
    the path that hold one go, also below a wanted element. Other members of the
    model stay here; ``keep_appearances`` treats those that are appearances.
    """
    by = ["path", "id"] if "path" in ids.columns else ["id"]
    wanted = ids.select(*by).distinct().withColumnsRenamed({"path": "_path", "id": "_id"})
    members = nodes.where("depth = 1 AND local = 'cityObjectMember'")
    # Steps that several later ones read are written once, so that the plan does not multiply.
    inside = cut(below(members, nodes).select("d.*", F.col("a.pre").alias("m_pre")).drop("_bin"), "members")
    same = F.col("gml_id") == F.col("_id")
    hits = inside.join(wanted, same & (F.col("path") == F.col("_path")) if "path" in by else same)
    first = cut(hits.groupBy("path", "m_pre", "gml_id").agg(F.min(F.struct("pre", "last", "depth")).alias("h")).select("path", "m_pre", "h.pre", "h.last", "h.depth"), "wanted")
    whole = first.where("depth = 2").select("path", "m_pre").distinct().withColumn("whole", F.lit(True))
    touched = first.select("path", "m_pre").distinct().join(whole, ["path", "m_pre"], "left")
    state = cut(inside.join(touched, ["path", "m_pre"]), "touched")
    partly = state.where("whole IS NULL")
    on_path = below(
        partly.select("path", "pre", "last", "m_pre"), first.select("path", "pre", "last")
    ).select("a.path", "a.pre").unionByName(first.select("path", "pre")).distinct().withColumn("on_path", F.lit(True))
    subs = partly.where(is_subfeature())
    holds = below(
        partly.select("path", "pre", "last"), subs.select("path", "pre", "last")
    ).select("a.path", "a.pre").unionByName(subs.select("path", "pre")).distinct().withColumn("holds", F.lit(True))
    marked = partly.join(on_path, ["path", "pre"], "left").join(holds, ["path", "pre"], "left")
    cut_roots = cut(marked.where("on_path IS NULL AND holds").select("path", "pre", "last"), "off-path")
    gone = below(cut_roots, partly.select("path", "pre", "last")).select("d.path", "d.pre").unionByName(cut_roots.select("path", "pre")).distinct()
    stay = partly.join(gone, ["path", "pre"], "left_anti").unionByName(state.where("whole").select(*partly.columns)).select("path", "pre")
    kept_members = touched.select("path", F.col("m_pre").alias("pre"))
    other = nodes.join(inside.select("path", "pre").unionByName(members.select("path", "pre")), ["path", "pre"], "left_anti").select("path", "pre")
    return cut(nodes.join(stay.unionByName(kept_members).unionByName(other).distinct(), ["path", "pre"], "left_semi"), "subset")


def member_counts(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """City object members kept and removed per document."""
    own = "depth = 1 AND local = 'cityObjectMember'"
    marks = nodes.where(own).join(kept.where(own).select("path", "pre", F.lit(True).alias("kept")), ["path", "pre"], "left")
    return marks.groupBy("path").agg(F.count_if(F.col("kept").isNotNull()).alias("kept"), F.count_if(F.col("kept").isNull()).alias("removed"))


def keep_appearances(kept: DataFrame) -> DataFrame:
    """Appearance targets whose element was kept; surface data without any target left go with their member."""
    objects = kept.where("depth = 1 AND local = 'cityObjectMember'")
    ids = below(objects, kept.where("gml_id IS NOT NULL")).select(F.col("d.path").alias("_p"), F.col("d.gml_id").alias("_id")).distinct()
    ref = reference(F.coalesce(F.col("attrs")["uri"], F.trim("text")), "prefix")
    surfaces = below(kept.where("local = 'surfaceDataMember'"), kept.where("local = 'target'"))
    targets = cut(
        surfaces.select(
            F.col("d.path").alias("path"), F.col("a.pre").alias("s_pre"), F.col("d.pre").alias("pre"), F.col("d.last").alias("last"),
            F.col("d.attrs").alias("attrs"), F.col("d.text").alias("text")
        ).withColumn("ref", ref),
        "targets"
    )
    good = cut(targets.join(ids, (F.col("path") == F.col("_p")) & (F.col("ref") == F.col("_id")), "left_semi"), "kept-targets")
    bad = targets.join(good.select("path", "pre"), ["path", "pre"], "left_anti").select("path", "pre", "last")
    members = kept.where("local = 'surfaceDataMember'")
    empty = members.join(good.select("path", F.col("s_pre").alias("pre")).distinct(), ["path", "pre"], "left_anti").select("path", "pre", "last")
    roots = cut(bad.unionByName(empty), "dropped-roots")
    gone = below(roots, kept.select("path", "pre", "last")).select("d.path", "d.pre").unionByName(roots.select("path", "pre")).distinct()
    return cut(kept.join(gone, ["path", "pre"], "left_anti"), "appearances")


def referenced_images(kept: DataFrame) -> DataFrame:
    """(path, image): image files of the surface data that stay, as paths within the archive."""
    found = below(kept.where("local = 'surfaceDataMember'"), kept.where("local = 'imageURI' AND text IS NOT NULL"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    return found.select(F.col("d.path").alias("path"), F.trim("d.text").alias("image")).select("path", F.concat(folder, F.col("image")).alias("image")).distinct()


def included(members: DataFrame, tree: DataFrame, path_col: str = "path") -> DataFrame:
    """Members whose path starts with a prefix and goes on with one of its items; tree rows are (prefix, item).

    A path's beginnings of the lengths that heads have are joined with the heads
    by equality; there are at most as many lengths as a path has characters.
    """
    heads = tree.select(F.concat("prefix", "item").alias("_head")).distinct()
    lengths = [r[0] for r in heads.select(F.length("_head")).distinct().collect()]
    if not lengths:
        return members.limit(0)
    begins = F.explode(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col("_path"), F.lit(1), n)))
    found = members.select(F.col(path_col).alias("_path")).distinct().withColumn("_head", begins).join(heads, "_head", "left_semi").select("_path").distinct()
    return members.join(found, F.col(path_col) == F.col("_path"), "left_semi")
