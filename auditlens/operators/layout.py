"""Screenshot audits from OCR detections: header parsing, grid placement of
badge detections, last-hit-wins per cell and the manual-vs-AI comparison.

Input tables (the OCR engine itself is outside the library):
* images:     image_id, height, width
* detections: image_id, region ('header' | 'panel'), seq, bbox array<struct<x,y>>, text, prob

Everything is column arithmetic plus per-image aggregates (``max_by``), which
combine map-side. The grid (12 cells) is a literal array, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.labels import badge_from_upper, label_match, upper_stripped
from auditlens.functions.text import blank_to_null, regex_group_or
from auditlens.operators.compare import band
from auditlens.operators.ordered_text import ordered_text


def header_text(detections: DataFrame, path: str | None = None) -> DataFrame:
    """Header detections of each image joined with spaces in detection order.

    A header is the top strip of one screenshot, so its detections per image are
    few by construction; they are sorted inside the aggregate buffer. With ``path`` (a new
    folder) they are joined block by block instead, however many an image has. Detections
    without an image_id belong to no screenshot and stay out.
    """
    h = detections.filter((F.col("region") == "header") & F.col("image_id").isNotNull())
    if path:
        return ordered_text(h, ["image_id"], ["seq"], "text", " ", path, "header")
    agg = h.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_t"))
    return agg.select("image_id", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("header"))


def header_fields(headers: DataFrame) -> DataFrame:
    return headers.select(
        "image_id",
        regex_group_or(F.col("header"), K.CALL_ID_HEADER_PATTERN, K.UNKNOWN_HEADER_VALUE, strip=False).alias("call_id"),
        regex_group_or(F.col("header"), K.AUDITOR_HEADER_PATTERN, K.UNKNOWN_HEADER_VALUE).alias("auditor"))


def _mean_int(bbox: Column, axis: str) -> Column:
    """``int(mean(coords))``: plain arithmetic for the usual 4-point box (codegen),
    the generic fold only for other shapes; both add left to right from 0.0."""
    four = (((bbox[0][axis].cast("double") + bbox[1][axis].cast("double")) + bbox[2][axis].cast("double"))
            + bbox[3][axis].cast("double")) / 4
    generic = F.aggregate(bbox, F.lit(0.0), lambda acc, p: acc + p[axis].cast("double")) / F.size(bbox)
    return F.when(F.size(bbox) == 4, four).otherwise(generic).cast("int")


def _nearest(cy: Column, centres: list[int], scale: Column) -> Column:
    """Index of the closest scaled centre; the first (upper) centre wins a tie."""
    dist = [F.abs(cy - (F.lit(c) * scale).cast("int")) for c in centres]
    best = F.least(*dist)
    out = None
    for i, d in enumerate(dist):
        out = F.when(d == best, F.lit(i)) if out is None else out.when(d == best, F.lit(i))
    return out


def _grid_field(col: Column, row: Column) -> Column:
    """Field of a (column, row) cell: a literal array indexed by ``row * 2 + column``."""
    cells = [K.GRID_FIELDS.get((c, r)) for r in range(len(K.GRID_MANUAL_CENTRES)) for c in (1, 2)]
    arr = F.expr("array(" + ", ".join("CAST(NULL AS STRING)" if f is None else f"'{f}'" for f in cells) + ")")
    return F.element_at(arr, row * 2 + col)


def place_badges(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections of the right panel placed on the 2 x 6 grid:
    (image_id, seq, section, field, label); ``label`` is NULL for text that is no badge."""
    # no filter on ``label`` here: Catalyst would push it below this projection and
    # evaluate the badge rules twice; rows without a badge are dropped after the
    # per-cell aggregate instead (``last_hits``)
    d = (detections.filter(F.col("region") == "panel").withColumn("_u", upper_stripped(F.col("text")))
         .withColumn("label", badge_from_upper("_u")).drop("_u"))
    d = d.join(images.select("image_id", "height", "width"), "image_id")
    scale = F.col("height") / F.lit(K.GRID_BASE_HEIGHT)
    cx = _mean_int(F.col("bbox"), "x") + (F.col("width") * K.GRID_PANEL_X).cast("int")
    cy = _mean_int(F.col("bbox"), "y")
    col = F.when(cx < (F.col("width") * K.GRID_COLUMN_SPLIT_X).cast("int"), F.lit(1)).otherwise(F.lit(2))
    manual = cy < (F.lit(K.GRID_SECTION_SPLIT) * scale).cast("int")
    row = F.when(manual, _nearest(cy, K.GRID_MANUAL_CENTRES, scale)).otherwise(
        _nearest(cy, K.GRID_AI_CENTRES, scale))
    field = _grid_field(col, row)
    return d.select("image_id", "seq", F.when(manual, F.lit("manual")).otherwise(F.lit("ai")).alias("section"),
                    field.alias("field"), "label").filter(F.col("field").isNotNull())


def last_hits(placed: DataFrame) -> DataFrame:
    """The latest badge per (image, section, field); detections without a badge do not count."""
    hit = F.col("label").isNotNull()
    last = placed.groupBy("image_id", "section", "field").agg(
        F.max_by("label", F.when(hit, F.col("seq"))).alias("label"))
    return last.filter(F.col("label").isNotNull())


def cell_values(placed: DataFrame, images: DataFrame, ai_default: str | None = K.CORRECT) -> DataFrame:
    """One row per image: the latest badge in each (section, field) cell.

    Two small aggregates instead of 24 conditional ones: the last label per
    cell (``max_by``, combines map-side), then one map per image built from at
    most 24 cells - its size is bounded by the grid, not by the data.
    Manual cells default to NULL, AI cells to ``ai_default`` (no detection = correct); with None
    an AI cell without a detection is NULL and its field is not compared.
    """
    last = last_hits(placed)
    per_image = last.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.col("section"), F.lit("__"), F.col("field")), F.col("label")))).alias("_cells"))
    out = images.select("image_id").join(per_image, "image_id", "left")
    return out.select("image_id", *[F.col("_cells")[f"manual__{f}"].alias(f"m__{f}") for f in K.FIELDS],
                      *[F.coalesce(F.col("_cells")[f"ai__{f}"], F.lit(ai_default).cast("string")).alias(f"a__{f}")
                        for f in K.FIELDS])


def compare_screens(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Per image: manual / AI label and match per field. Only images with at least
    one audited manual badge are compared, and only on the audited fields; other
    fields are NULL (not compared), never invented."""
    has_manual = F.coalesce(*[F.col(f"m__{f}") for f in K.AUDITED_FIELDS]).isNotNull()
    j = cells.join(headers, "image_id", "left").withColumn("has_manual", has_manual)
    cols = ["image_id", F.coalesce(F.col("call_id"), F.lit(K.UNKNOWN_HEADER_VALUE)).alias("call_id"),
            F.coalesce(F.col("auditor"), F.lit(K.UNKNOWN_HEADER_VALUE)).alias("auditor"), "has_manual"]
    match_cols = []
    for f in K.FIELDS:
        ai = F.col(f"a__{f}")
        if f in K.AUDITED_FIELDS:
            m = blank_to_null(F.col(f"m__{f}"), K.NULLS_SCREEN)
            man = F.when(F.col("has_manual"), F.coalesce(m, ai))
            match = F.when(F.col("has_manual") & ai.isNotNull(), F.when(m.isNull(), F.lit(1)).otherwise(label_match(m, ai, canonical=True)))
        else:
            man = F.lit(None).cast("string")
            match = F.lit(None).cast("int")
        cols += [man.alias(f"{f}_manual"), ai.alias(f"{f}_ai"), match.alias(f"{f}_match")]
        match_cols.append(f"{f}_match")
    res = j.select(*cols)
    matches = sum(F.coalesce(F.col(c), F.lit(0)) for c in match_cols)
    compared = sum(F.col(c).isNotNull().cast("int") for c in match_cols)
    return (res.withColumn("matches", matches).withColumn("compared_fields", compared)
            .withColumn("accuracy", F.when(F.col("compared_fields") > 0,
                                           F.col("matches") / F.col("compared_fields") * 100.0)))


def screen_field_accuracy(cmp: DataFrame) -> DataFrame:
    """Per field: compared images, matches, accuracy (NULL when never compared)."""
    aggs = []
    for f in K.FIELDS:
        aggs += [F.count(f"{f}_match").alias(f"{f}__n"),
                 F.coalesce(F.sum(f"{f}_match"), F.lit(0)).cast("long").alias(f"{f}__m")]
    wide = cmp.agg(*aggs)
    rows = [F.struct(F.lit(i + 1).alias("field_pos"), F.lit(K.FIELD_DISPLAY[f]).alias("field_name"),
                     F.col(f"{f}__n").alias("compared"), F.col(f"{f}__m").alias("matched"))
            for i, f in enumerate(K.FIELDS)]
    out = wide.select(F.inline(F.array(*rows)))
    return out.withColumn("accuracy", F.when(F.col("compared") > 0,
                                             F.col("matched") / F.col("compared") * 100.0))


def screen_binary(cmp: DataFrame) -> DataFrame:
    """Per image: 0/1 per field (NULL = not compared), matches, compared fields, accuracy to 2 places."""
    return cmp.select("image_id", "call_id", "auditor", *[F.col(f"{f}_match").alias(f) for f in K.FIELDS], "matches",
                      "compared_fields", F.round("accuracy", 2).alias("accuracy"))


def screen_values(cmp: DataFrame) -> DataFrame:
    """Per image: manual and AI label side by side."""
    return cmp.select("image_id", "call_id", *[f"{f}_{side}" for f in K.FIELDS for side in ("manual", "ai")])


def screen_summary_statistics(cmp: DataFrame) -> DataFrame:
    """Per field: label counts of the manual values, compared and matched images, accuracy (NULL when never
    compared) and band. One aggregate over the comparison, unpacked to a row per field."""
    aggs, rows = [], []
    for i, f in enumerate(K.FIELDS):
        names = [short for short, _ in K.SUMMARY_LABEL_COLUMNS] + ["compared", "matched"]
        aggs += [F.count_if(F.col(f"{f}_manual") == label).alias(f"{f}__{short}") for short, label in K.SUMMARY_LABEL_COLUMNS]
        aggs += [F.count(f"{f}_match").alias(f"{f}__compared"),
                 F.coalesce(F.sum(f"{f}_match"), F.lit(0)).cast("long").alias(f"{f}__matched")]
        rows.append(F.struct(F.lit(i + 1).alias("field_pos"), F.lit(K.FIELD_DISPLAY[f]).alias("field_name"),
                             *[F.col(f"{f}__{n}").alias(n) for n in names]))
    out = cmp.agg(*aggs).select(F.inline(F.array(*rows)))
    acc = F.when(F.col("compared") > 0, F.col("matched") / F.col("compared") * 100.0)
    return out.withColumn("accuracy", acc).withColumn("band", band(F.col("accuracy")))


def screen_overall(cmp: DataFrame) -> DataFrame:
    """Compared fields, matches, micro accuracy and the mean of the compared fields' accuracies (percent)."""
    total = cmp.agg(F.coalesce(F.sum("compared_fields"), F.lit(0)).cast("long").alias("compared"),
                    F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matched"),
                    *[F.avg(f"{f}_match").alias(f"{f}__rate") for f in K.FIELDS])
    rates = F.filter(F.array(*[F.col(f"{f}__rate") for f in K.FIELDS]), lambda x: x.isNotNull())
    mean = F.when(F.size(rates) > 0, F.aggregate(rates, F.lit(0.0), lambda a, x: a + x) / F.size(rates) * 100.0)
    return total.select("compared", "matched", F.when(F.col("compared") > 0, F.col("matched") / F.col("compared") * 100.0).alias("accuracy"),
                        F.round(mean, 6).alias("macro_accuracy"))


def screen_reports(cmp: DataFrame) -> dict[str, DataFrame]:
    """The report tables of a screenshot comparison."""
    return {"comparison": cmp, "binary_comparison": screen_binary(cmp), "value_comparison": screen_values(cmp),
            "summary_statistics": screen_summary_statistics(cmp), "overall": screen_overall(cmp),
            "field_accuracy": screen_field_accuracy(cmp)}
