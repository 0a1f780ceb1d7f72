from pyspark.sql import functions as F

from auditlens.operators import health as H
from auditlens.operators import layout as LY

DET_S = "image_id long, region string, seq long, bbox array<struct<x:double,y:double>>, text string, prob double"


def box(cx_panel, cy):
    # centroid (cx_panel, cy) in panel coordinates, 2 px wide/high
    return [(cx_panel - 1.0, cy - 1.0), (cx_panel + 1.0, cy - 1.0), (cx_panel + 1.0, cy + 1.0), (cx_panel - 1.0, cy + 1.0)]


def test_grid_rules(spark):
    images = spark.createDataFrame([(1, 900, 1000), (2, 1800, 1000), (3, 900, 1000)], "image_id long, height int, width int")
    det = spark.createDataFrame([
        (1, "header", 0, [], "Call ID: 42", 1.0), (1, "header", 1, [], "| Auditor: Meena", 1.0),
        (1, "panel", 1, box(50, 150), "CORRECT", 0.9),     # tie between rows 0 and 1 -> row 0, col 1
        (1, "panel", 2, box(50, 120), "Missing", 0.9),     # same cell, later -> wins
        (1, "panel", 3, box(300, 240), "hello", 0.9),      # not a badge: ignored
        (1, "panel", 4, box(300, 590), "Hallucination", 0.9),  # AI section, col 2, row 0
        (2, "panel", 1, box(50, 600), "Inferred", 0.9),    # scale 2: manual section row 3
        (3, "header", 0, [], "no id here", 1.0),
    ], DET_S)
    placed = LY.place_badges(det, images)
    cells = {(r.image_id, r.section, r.field): r.label for r in LY.last_hits(placed).collect()}
    assert cells[(1, "manual", "buyer_name")] == "Missing"
    assert cells[(1, "ai", "buyer_location")] == "Hallucination"
    assert cells[(2, "manual", "quantity")] == "Inferred"
    assert len(cells) == 3
    heads = {r.image_id: (r.call_id, r.auditor) for r in LY.header_fields(LY.header_text(det)).collect()}
    assert heads == {1: ("42", "Meena"), 3: ("Unknown", "Unknown")}
    cmp = {r.image_id: r for r in LY.compare_screens(LY.cell_values(placed, images), LY.header_fields(
        LY.header_text(det))).collect()}
    assert cmp[1].buyer_name_match == 0 and cmp[1].buyer_location_ai == "Hallucination"
    assert cmp[1].lead_tag_match is None and cmp[1].compared_fields == 8
    assert cmp[3].has_manual is False and cmp[3].compared_fields == 0 and cmp[3].call_id == "Unknown"


def test_health_classification(spark):
    probes = spark.createDataFrame([
        ("a", 200, "{}", None, 1), ("b", 401, '{"error": {"message": "Invalid API_KEY given"}}', None, 1),
        ("c", 403, "forbidden!", None, 1), ("d", None, None, "read timeout", 1),
        ("e", 500, '{"error": {"message": "' + "x" * 600 + '"}}', None, 1),
        ("e", 200, "{}", None, 0),  # older probe of e: the later one counts
        ("text-embedding-3", 200, "{}", None, 1),
    ], "model string, http_status int, body string, exception string, t long")
    keep = probes.filter(~H.keyword_excluded("model"))
    out = {r.model: r for r in H.probe_outcomes(keep, ["t"]).collect()}
    assert set(out) == {"a", "b", "c", "d", "e"}
    assert out["a"].status == "Healthy" and out["a"].error == ""
    assert out["b"].error_type == "Authentication"
    assert out["c"].error_type == "Permission"
    assert out["d"].error_type == "Timeout"
    assert out["e"].error_type == "Unknown" and len(out["e"].error) == 600 and len(out["e"].error_short) == 500
    summ = {r.metric: r.value for r in H.health_summary(H.probe_outcomes(keep, ["t"])).collect()}
    assert summ["healthy"] == 1 and summ["broken"] == 4 and summ["error:Unknown"] == 1
