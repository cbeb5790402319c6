"""Settings in both shapes: what is valid, what is repaired and what is refused."""

import json

import pytest
from pyspark.sql import functions as F

from lumenvec.operators import settings

LEGEND = {"maxVisibleValues": 10, "shapeSize": 4.5, "sortMode": "alpha-asc", "hiddenValues": ["a"], "enableDuplicateStackUI": False, "categories": {"x": {"zOrder": 0, "color": "#000", "shape": "circle"}}}
EXPORT = {"imageWidth": 1, "imageHeight": 2, "lockAspectRatio": True, "legendWidthPercent": 20.5, "legendFontSizePx": 3, "includeLegendSettings": True, "includeExportOptions": True}
BINS = {"strategy": "linear", "signature": "s"}


def of(spark, *values):
    texts = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    rows = spark.createDataFrame(texts, "i int, t string").select("i", settings.normalized(F.col("t")).alias("n")).orderBy("i").collect()
    return [r["n"] for r in rows]


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def test_shapes(spark):
    got = of(spark, {"legendSettings": {"a": LEGEND}, "exportOptions": {}}, {"a": LEGEND}, {}, {"legendSettings": {"a": LEGEND}}, None, "{", "[1]", "5", "null", {"legendSettings": LEGEND})
    assert [g and g["shape"] for g in got] == ["current", "legacy", "legacy", "repaired", None, None, None, None, None, "legacy"]
    assert [g and sorted(g["legend"]) for g in got] == [["a"], ["a"], [], ["a"], None, None, None, None, None, ["legendSettings"]]
    entry = json.loads(got[0]["legend"]["a"])
    assert entry == LEGEND | {"selectedPaletteId": "kellys"}
    # an annotation of the older shape may be called like a member of the current one
    named = of(spark, {"legendSettings": LEGEND, "exportOptions": LEGEND})[0]
    assert named["shape"] == "legacy" and sorted(named["legend"]) == ["exportOptions", "legendSettings"] and named["export"] == {}


BROKEN = [without(LEGEND, k) for k in LEGEND] + [LEGEND | x for x in (
    {"maxVisibleValues": "10"}, {"maxVisibleValues": None}, {"includeShapes": 1}, {"shapeSize": []}, {"sortMode": "up"}, {"sortMode": 3}, {"hiddenValues": "a"}, {"hiddenValues": [1]}, {"hiddenValues": ["a", None]},
    {"enableDuplicateStackUI": "yes"}, {"categories": []}, {"categories": None}, {"categories": {"x": {"zOrder": "1", "color": "c", "shape": "s"}}}, {"categories": {"x": None}}, {"categories": {"x": {"zOrder": 1, "color": "c"}}},
)] + [None, [], 5, "x"]


def test_broken_legends_go_one_by_one(spark):
    got = of(spark, *[{"legendSettings": {"good": LEGEND, "bad": b}, "exportOptions": {}} for b in BROKEN])
    assert all(g["shape"] == "repaired" and list(g["legend"]) == ["good"] for g in got)


@pytest.mark.parametrize("extra", [{"includeShapes": True}, {"categories": {}}, {"hiddenValues": []}, {"unknown": {"a": 1}}, {"maxVisibleValues": 1.5}, {"shapeSize": 1e40}])
def test_good_legends(spark, extra):
    (got,) = of(spark, {"a": LEGEND | extra})
    assert got["shape"] == "legacy" and "unknown" not in json.loads(got["legend"]["a"]) and "includeShapes" not in json.loads(got["legend"]["a"])


def test_bins(spark):
    good = [BINS, BINS | {"topologySignature": "t", "reverseGradient": True, "manualOrderIds": ["a", "b"]}, BINS | {"manualOrderIds": []}, BINS | {"more": 1}]
    bad = [without(BINS, "signature"), without(BINS, "strategy"), BINS | {"strategy": "odd"}, BINS | {"topologySignature": 1}, BINS | {"reverseGradient": "no"}, BINS | {"manualOrderIds": [1]}, BINS | {"manualOrderIds": "a"}, None, [], 5]
    got = of(spark, *[{"a": LEGEND | {"numericSettings": b}} for b in good + bad])
    assert [g["shape"] for g in got] == ["legacy"] * len(good) + ["repaired"] * len(bad)
    assert [json.loads(g["legend"]["a"]).get("numericSettings") for g in got] == [without(b, "more") for b in good] + [None] * len(bad)


def test_exports_and_the_rest(spark):
    base = {"legendSettings": {"a": LEGEND}, "exportOptions": {"a": EXPORT}}
    cases = [({}, "current", None), ({"eatConfidenceThreshold": 0}, "current", 0.0), ({"eatConfidenceThreshold": 1}, "current", 1.0), ({"eatConfidenceThreshold": 1.01}, "repaired", None), ({"eatConfidenceThreshold": "0.5"}, "repaired", None), ({"eatConfidenceThreshold": None}, "repaired", None)]
    got = of(spark, *[base | x for x, _, _ in cases])
    assert [(g["shape"], g["threshold"]) for g in got] == [(s, t) for _, s, t in cases]
    got = of(spark, base | {"publishState": {"k": [1, "x"]}, "eatOverlayEnabled": True}, base | {"publishState": [1]}, base | {"eatOverlayEnabled": "on"}, base | {"exportOptions": {"a": EXPORT, "b": without(EXPORT, "imageWidth"), "c": EXPORT | {"lockAspectRatio": 1}, "d": None}}, base | {"exportOptions": 5})
    assert (json.loads(got[0]["publish"]), got[0]["overlay"], got[0]["shape"]) == ({"k": [1, "x"]}, True, "current")
    assert [g["shape"] for g in got[1:]] == ["repaired"] * 4 and got[1]["publish"] is None and got[2]["overlay"] is None
    assert list(got[3]["export"]) == ["a"] and json.loads(got[3]["export"]["a"]) == EXPORT and got[4]["export"] == {} and list(got[4]["legend"]) == ["a"]
