"""The command-line pipelines on inputs written from the benchmark tables."""

import glob
import json

from poicraft.plans import bindings as B
from poicraft.plans.evidence import written_plans
from poicraft.plans.run import main
from poicraft.session import scratch_path
from poicraft.sinks import writers as W
from poicraft.sources import readers as R

SF = "/root/testdata/sf0.001"


def document(path):
    """The part files of a text output, put together in the order of their names, as JSON."""
    return json.loads("".join(open(f).read() for f in sorted(glob.glob(path.replace("file:", "") + "/part-*"))))


def test_retail_and_map_pipelines(spark, capsys):
    est, est2 = scratch_path(spark, "est"), scratch_path(spark, "est2")
    everyone = B.establishments(spark, SF)
    first = everyone.filter("cast(id as int) < 50")
    first.write.option("header", True).csv(est)
    everyone.exceptAll(first).select(*reversed(everyone.columns)).write.option("header", True).csv(est2)
    catalog = scratch_path(spark, "catalog")
    B.activity_catalog(spark, SF).coalesce(1).write.option("header", True).csv(catalog)
    out = scratch_path(spark, "retail")
    with written_plans() as plans:
        main(["retail", "--establishments", est, est2, "--catalog", catalog, "--out", out,
              "--keywords", "", "nation_1", "--slice", "3", "--audit"], spark=spark)
    assert sum("Scan csv" in p or "FileScan csv" in p for p in plans) == 1  # one pass over the input
    stages = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [st["stage"] for st in stages] == ["loaded", "deduplicated", "address filter"]
    assert stages[0]["n"] == B.establishments(spark, SF).count() >= stages[2]["n"] > 0
    ents = spark.read.json(f"{out}/entities")
    assert spark.read.json(f"{out}/entities_head").count() == 3
    batches = spark.read.json(f"{out}/batches")
    assert ents.count() == everyone.filter("lower(entidad) like '%nation_1%'").count() > 0
    assert sum(r.n for r in batches.collect()) == ents.count()
    assert spark.read.text(f"{out}/counts").count() > 0

    out2 = scratch_path(spark, "map")
    with written_plans() as plans:
        main(["map", "--establishments", est, est2, "--catalog", catalog, "--out", out2, "--top", "5",
              "--keywords", "", "nation_1"], spark=spark)
    assert sum("Scan csv" in p or "FileScan csv" in p for p in plans) == 1
    legend = json.loads(spark.read.text(f"{out2}/legend.json").first().value)
    assert len(legend) == 6 and list(legend)[-1].startswith("Other[")
    shown = document(f"{out2}/features.json")
    ids = [f["properties"]["id"] for f in shown["features"]]
    assert shown["type"] == "FeatureCollection" and len(ids) == everyone.count() and ids == sorted(ids)

    out3 = scratch_path(spark, "map-any")
    one = everyone.filter("raz_social = 'BUILDING'").first()
    main(["map", "--establishments", est, est2, "--catalog", catalog, "--out", out3, "--top", "5", "--keywords", "", "",
          "--any-keywords", "building", "--any-columns", "raz_social", "--categories", f"Comercio al por menor de {one.entidad}"], spark=spark)
    feats = document(f"{out3}/features.json")["features"]
    want = everyone.filter(f"raz_social = 'BUILDING' and entidad = '{one.entidad}'").count()
    assert len(feats) == want > 0


def test_venue_pipelines(spark):
    venues = W.write_raw_json(B.venue_documents(spark, SF), scratch_path(spark, "venues"))
    postal = scratch_path(spark, "postal")
    B.postal_catalog(spark, SF).write.option("header", True).csv(postal)
    out = scratch_path(spark, "venue-map")
    main(["venues", "--venues", venues, "--postal", postal, "--out", out, "--categories",
          "cat1", "cat2", "--top", "25", "--as-of", "2019-05-23 12:00:00"], spark=spark)
    pts = document(f"{out}/points.json")["features"]
    assert pts and {p["properties"]["category"] for p in pts} <= {"cat1", "cat2"}
    out2 = scratch_path(spark, "mesh")
    main(["mesh", "--venues", venues, "--out", out2, "--resume", "3144"], spark=spark)
    assert spark.read.json(f"{out2}/cells").count() == 1057


def test_mesh_keeps_whole_venues_from_the_resumed_cell(spark):
    rows = [(f"v{i}", 19.27 + 0.004 * (i % 70), -99.25 + 0.004 * (i % 59)) for i in range(500)]
    lines = [(json.dumps({"id": v, "name": v, "extra": {"kept": True}, "location": {"lat": lat, "lng": lng}}),) for v, lat, lng in rows]
    src = scratch_path(spark, "mesh-src")
    spark.createDataFrame(lines, "value string").write.text(src)
    out = scratch_path(spark, "mesh-out")
    main(["mesh", "--venues", src, "--out", out, "--resume", "2000"], spark=spark)
    sweep = {r.id: r.cell_id for r in spark.read.json(f"{out}/sweep").collect()}
    docs = [json.loads(r.value) for r in spark.read.text(f"{out}/venues").collect()]
    assert sweep and min(sweep.values()) >= 1999
    assert sorted(d["id"] for d in docs) == sorted(sweep) and all(d["extra"] == {"kept": True} for d in docs)
    assert 0 < len(docs) < 500


def test_categories_and_shares_pipelines(spark):
    venues = W.write_raw_json(B.venue_documents(spark, SF), scratch_path(spark, "venues2"))
    postal = scratch_path(spark, "postal2")
    B.postal_catalog(spark, SF).write.option("header", True).csv(postal)
    out = scratch_path(spark, "cats")
    main(["categories", "--venues", venues, "--postal", postal, "--out", out,
          "--categories", "cat1", "cat2", "--as-of", "2019-05-23 12:00:00"], spark=spark)
    ents = spark.read.json(f"{out}/entities").collect()
    assert ents and all(e.entity.category.value[1] in ("cat1", "cat2") for e in ents)
    out2 = scratch_path(spark, "shares")
    main(["shares", "--venues", venues, "--postal", postal, "--out", out2,
          "--categories", "cat1", "cat2"], spark=spark)
    rows = spark.read.json(f"{out2}/shares").collect()
    assert rows and abs(sum(r.share for r in rows) - 100.0 * len({r.municipio for r in rows})) < 1e-6
    stored = R.load_collection(spark, f"{out2}/collection")
    assert "formattedAddress" in stored.columns and stored.count() == sum(r.n for r in rows)
