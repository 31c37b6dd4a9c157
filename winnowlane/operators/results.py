"""Result sets: unions, intersections and differences that keep an order, and the names of what is put out."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.functions import capture
from winnowlane.functions.text import file_safe, ordinal
from winnowlane.operators.order import positions

# The columns of a manifest and of a list of finalists, in order.
MANIFEST = ("folder", "file", "original_path", "tags", "taken", "timezone", "camera", "lens", "focal_mm", "focal_35mm", "aperture", "shutter_s", "iso", "latitude", "longitude", "place", "width", "height", "format", "bytes")
FINALISTS = ("set", "rank", "exported", "label", *(c for c in MANIFEST if c not in ("folder", "file")))
#: How the folders begin that are written; a scan leaves such folders out.
FINALIST_FOLDER, TAG_FOLDER = "_finalists", "_tagged_"
SECTION_ROWS = 100_000


def union_first(sets: list[DataFrame], key: str = "id") -> DataFrame:
    """Each row once, in the order in which it was first seen over all sets (key, ord)."""
    every = reduce(DataFrame.unionByName, [s.select(key, F.struct(F.lit(i).alias("set"), F.col("ord").alias("ord")).alias("seen")) for i, s in enumerate(sets)])
    return every.groupBy(key).agg(F.min("seen").alias("seen")).select(key, F.col("seen.set").alias("set_no"), F.col("seen.ord").alias("ord"))


def union_all(sets: dict[str, DataFrame]) -> DataFrame:
    """All rows of all named sets; a row in two sets appears twice."""
    return reduce(DataFrame.unionByName, [s.withColumn("set", F.lit(n)) for n, s in sets.items()])


def intersect_ordered(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a that are in b, as a has them."""
    return a.join(b.select(key), key, "left_semi")


def except_ordered(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a that are not in b."""
    return a.join(b.select(key), key, "left_anti")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """b after a: orders of b begin above the last of a."""
    top = a.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("top"))
    moved = b.crossJoin(F.broadcast(top)).withColumn("ord", F.col("ord") + F.col("top")).drop("top")
    return a.unionByName(moved)


def ranked(sets: DataFrame, by: str = "set") -> DataFrame:
    """Adds rank within a set, and its ordinal padded to the set's size; a set of any size is dealt over many tasks."""
    out = positions(sets, by, [F.col("ord")]).withColumn("rank", F.col("pos") + 1)
    return out.withColumn("ordinal", ordinal(F.col("rank"), F.col("_n"))).drop("pos", "_n")


def unique_names(rows: DataFrame, folder: str = "folder", name: str = "name", order: str = "ord", plain: bool = False) -> DataFrame:
    """Adds out_name: names that differ within a folder, case aside; later ones get _2, _3 before the extension (``plain``: at the end).

    A suffixed name can meet a name that is there already, so each folder is a fold over its rows: a task holds the
    names of one folder, not what is in the files.
    """
    schema = rows.withColumn("out_name", F.lit("")).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        taken: set[str] = set()
        last: dict[str, int] = {}
        out = []
        for n in pdf[name]:
            stem, dot, ext = n.rpartition(".") if "." in n[1:] and not plain else (n, "", "")
            new, k = n, last.get(n.lower(), 1)
            while new.lower() in taken:
                k += 1
                new = f"{stem}_{k}{dot}{ext}"
            last[n.lower()] = k
            taken.add(new.lower())
            out.append(new)
        return pdf.assign(out_name=out)

    return rows.groupBy(folder).applyInPandas(fold, schema)


def owner_path(unit_id: Column) -> Column:
    """The folder that a unit's id names; the root is empty."""
    p = F.when(unit_id.contains(":"), F.regexp_replace(unit_id, "^[^:]*:", "")).otherwise(F.lit(""))
    return F.when(p == "root", F.lit("")).otherwise(p)


def _flat(path: Column, empty: str) -> Column:
    return file_safe(F.regexp_replace(F.when(path == "", F.lit(empty)).otherwise(path), "/", "_"))


def output_folder(unit_id: Column, kind: Column, label: Column, organized: bool = False) -> Column:
    """The folder that a unit's rows are written to: for its last segment or, of rows grouped anew, its whole path."""
    p = owner_path(unit_id)
    if organized:
        pooled = F.when(p == "", F.lit("")).otherwise(F.concat(F.lit("_"), _flat(p, "")))
        own = F.when(kind == "pooled", F.concat(F.lit("_pooled"), pooled)).otherwise(F.concat(F.lit("_"), _flat(p, "all")))
    else:
        leaf = F.element_at(F.split(F.coalesce(F.nullif(label, F.lit("")), F.lit("unit")), "/"), -1)
        own = F.when(kind == "pooled", F.lit("_pooled")).otherwise(F.concat(F.lit("_"), file_safe(leaf)))
    return F.when(unit_id == "final", F.lit(f"{FINALIST_FOLDER}_overall")).otherwise(F.concat(F.lit(FINALIST_FOLDER), own))


def set_title(unit_id: Column, kind: Column, label: Column, organized: bool = False) -> Column:
    """What a set is called on screen."""
    if not organized:
        return label
    p = owner_path(unit_id)
    shown = F.when(p == "", F.lit("All photos")).otherwise(F.regexp_replace(p, "/", " › "))
    return F.when(unit_id == "final", label).when(kind == "pooled", F.concat(F.lit("pooled under "), shown)).otherwise(shown)


def tag_folder(name: Column) -> Column:
    return F.concat(F.lit(TAG_FOLDER), file_safe(name))


def set_folders(units: DataFrame, organized: bool = False) -> DataFrame:
    """units (unit, kind, label, ord) with their folder: those that clash take their whole path, and what clashes still is numbered, case aside.

    Units are folders of a tree, few beside the rows in them.
    """
    base = units.withColumn("_base", output_folder(F.col("unit"), F.col("kind"), F.col("label"), organized))
    n = base.groupBy("_base").agg(F.count("*").alias("_n"))
    whole = F.concat(F.lit(f"{FINALIST_FOLDER}_"), F.when(F.col("kind") == "pooled", F.lit("pooled_")).otherwise(F.lit("")), _flat(owner_path(F.col("unit")), "root"))
    named = base.join(n, "_base").withColumn("name", F.when((F.col("_n") > 1) & (F.col("unit") != "final"), whole).otherwise(F.col("_base"))).drop("_base", "_n")
    out = unique_names(named.withColumn("_all", F.lit(0)), "_all", "name", "ord", plain=True)
    return out.withColumnRenamed("out_name", "folder").drop("_all", "name")


def manifest(rows: DataFrame, tags: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """id and the MANIFEST columns of each row, and copied (yes, no) if ``written`` (id) is given; missing values are null here and empty in the file.

    ``rows`` may hold: id, folder, file, name, path, size, kind, w, h, taken (ISO), tz, make, model, lens, fl, fl35, f,
    exposure, iso, lat, lon, city, sublocation, state, country. Numbers that are zero count as missing but for positions.
    """
    out = rows if tags is None else rows.join(tags, "id", "left")
    out = out if written is None else out.join(written.select("id", F.lit("yes").alias("copied")).distinct(), "id", "left").withColumn("copied", F.coalesce("copied", F.lit("no")))
    have = set(out.columns)
    c = lambda n, t="string": F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    some = lambda x: F.nullif(x, F.lit(""))
    number = lambda n, t="double": F.nullif(c(n, t), F.lit(0).cast(t))
    here = capture.has_position(c("lat", "double"), c("lon", "double"))
    columns = {
        "folder": some(c("folder")), "file": F.coalesce(some(c("file")), c("name")), "original_path": F.coalesce(some(c("path")), c("name")), "tags": some(c("tags")), "taken": F.regexp_replace(some(c("taken")), "T", " "), "timezone": some(c("tz")),
        "camera": capture.camera_label(c("make"), c("model")), "lens": some(c("lens")), "focal_mm": number("fl"), "focal_35mm": number("fl35"), "aperture": number("f"), "shutter_s": number("exposure"), "iso": number("iso"),
        "latitude": F.when(here, c("lat", "double")), "longitude": F.when(here, c("lon", "double")), "place": capture.written_place(c("city"), c("sublocation"), c("state"), c("country")), "width": number("w", "long"), "height": number("h", "long"), "format": some(c("kind")), "bytes": number("size", "long"),
    }
    return out.select(*[c for c in ("id",) if c in have], *[columns[n].alias(n) for n in MANIFEST], *(["copied"] if written is not None else []))


def finalists(planned: DataFrame, tags: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """id and the FINALISTS columns of planned rows (id, set folder, out_name, rank and what manifest() takes): one row a set that a row is in."""
    p = planned.withColumn("folder", F.col("set")).withColumn("file", F.col("out_name"))
    tagged = p if tags is None else p.join(tags, "id", "left")
    tagged = tagged.withColumn("label", F.lit("")) if labels is None else tagged.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit("")))
    have = tagged.withColumn("_id", F.col("id")).withColumn("id", F.struct("_id", "set", "rank", "out_name", "label"))
    m = manifest(have)
    own = m.select(F.col("id._id").alias("id"), F.col("id.set").alias("set"), F.col("id.rank").alias("rank"), F.concat_ws("/", "id.set", "id.out_name").alias("exported"), F.col("id.label").alias("label"), *FINALISTS[4:])
    return own


def decisions(spark, sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON document of all sections, each a list of its rows: settings and decisions made by hand, which one person
    made and reads again. A section of more than SECTION_ROWS rows is refused; write that one with sinks.write_json()."""
    for n, f in sections.items():
        if f.limit(SECTION_ROWS + 1).count() > SECTION_ROWS:
            raise ValueError(f"section {n} has more than {SECTION_ROWS} rows")
    parts = [f.agg(F.to_json(F.collect_list(F.struct(*f.columns))).alias("j")).select(F.concat(F.lit(f'"{n}":'), "j").alias("j"), F.lit(i).alias("i")) for i, (n, f) in enumerate(sections.items())]
    every = reduce(DataFrame.unionByName, parts).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("p"))
    return every.select(F.concat(F.lit("{"), F.array_join(F.transform("p", lambda x: x["j"]), ","), F.lit("}")).alias("json"))


def sheet_layout(sets: DataFrame, columns: int = 5, by: str = "set") -> DataFrame:
    """Row and column of each item on a contact sheet."""
    at = F.row_number().over(Window.partitionBy(by).orderBy("ord")) - 1
    return sets.withColumn("sheet_row", F.floor(at / columns)).withColumn("sheet_col", F.pmod(at, F.lit(columns)))


def box_hits(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows whose open box (x0, y0, x1, y1) meets any of the few selection boxes drawn by hand."""
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    meets = (F.col("x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("x1")) & (F.col("y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("y1"))
    return rows.join(b, meets, "left_semi")


def range_between(rows: DataFrame, anchor: int, target: int) -> DataFrame:
    return rows.where(F.col("ord").between(min(anchor, target), max(anchor, target)))


def touched_groups(groups: DataFrame, picked: DataFrame) -> DataFrame:
    return groups.join(picked.select("id"), "id", "left_semi").select("unit", "group_id").distinct()
