"""Command-line runner for the pipelines on real inputs.

    python -m poicraft.plans.run retail   --establishments DIR_OR_CSV --catalog CSV --out DIR \\
        --keywords insurgentes "ciudad de méxico"
    python -m poicraft.plans.run map      --establishments ... --catalog CSV --out DIR --top 35 \\
        --keywords "" "ciudad de méxico"
    python -m poicraft.plans.run venues   --venues JSON_DIR --postal CSV --out DIR \\
        --categories "Taco Place" Bar --top 25
    python -m poicraft.plans.run categories --venues JSON_DIR --postal CSV --out DIR --categories ...
    python -m poicraft.plans.run shares   --venues JSON_DIR --postal CSV --out DIR --categories ...
    python -m poicraft.plans.run mesh     --venues JSON_DIR --out DIR

Every output is written by Spark in parallel under ``--out``; nothing is collected.
Use an existing cluster session by running through ``spark-submit``.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from poicraft.functions.names import CATEGORY_SHORT_NAMES
from poicraft.operators.audit import StageAudit
from poicraft.operators import entities as ent, mesh
from poicraft.operators.index import take_slice
from poicraft.plans import flows
from poicraft.plans.collect import collect_mesh
from poicraft.session import checkpoint_dir, stored
from poicraft.sinks import writers as W
from poicraft.sources import readers as R


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _venues(spark, a):
    return R.load_venues(spark, a.venues, a.format, **dict(o.split("=", 1) for o in a.option))


def run_retail(spark, a) -> None:
    """Entities of the matching establishments, their category counts and batches."""
    out = flows.retail_entities_flow(R.load_establishments(spark, a.establishments),
                                     R.load_catalog_raw(spark, a.catalog), a.keywords,
                                     CATEGORY_SHORT_NAMES, a.category, a.kind, audit=a.stage_audit,
                                     store=lambda df: stored(df, "retail"))
    W.write_counts(out["counts"], f"{a.out}/counts")
    W.write_raw_json(ent.entity_payloads(out["entities"]), f"{a.out}/entities")
    W.write_raw_json(ent.entity_batches(out["entities"], ["_key"]), f"{a.out}/batches")
    if a.slice:
        head = take_slice(out["entities"], ["_key"], a.slice)
        W.write_raw_json(ent.entity_payloads(head), f"{a.out}/entities_head")


def run_map(spark, a) -> None:
    """Coloured GeoJSON features and the abbreviated legend."""
    out = flows.colored_map_flow(R.load_establishments(spark, a.establishments),
                                 R.load_catalog_raw(spark, a.catalog), a.keywords, a.top,
                                 audit=a.stage_audit, any_keywords=a.any_keywords, any_columns=a.any_columns,
                                 keys=a.categories, store=lambda df: stored(df, "map"))
    W.write_feature_collection(out["features"], a.out, ["id"], name="features")
    W.write_legend(out["legend"], a.out, name="legend")


def run_venues(spark, a) -> None:
    """Venue points of the top categories, with their legend."""
    out = flows.venue_map_flow(_venues(spark, a), R.load_postal(spark, a.postal),
                               a.keywords, a.categories, a.top, a.as_of or _now())
    points = out["points"].withColumn("id", F.col("feature.properties.name"))
    W.write_feature_collection(points, a.out, ["id"], name="points")
    W.write_legend(out["legend"], a.out, name="legend")


def run_categories(spark, a) -> None:
    """Entities of venues in the listed categories."""
    ents = flows.venue_categories_flow(_venues(spark, a),
                                       R.load_postal(spark, a.postal), a.categories, a.as_of or _now())
    W.write_raw_json(ents, f"{a.out}/entities")


def run_shares(spark, a) -> None:
    """E5: the cleaned collection and category shares per municipality."""
    shares = flows.clean_collection_flow(spark, _venues(spark, a), R.load_postal(spark, a.postal), a.categories,
                                         f"{a.out}/collection")
    W.write_raw_json(shares, f"{a.out}/shares")


def run_mesh(spark, a) -> None:
    """The collection mesh and, whole, every cell's first venues, from the resumed cell on.

    A broken run goes on where it stopped when it is called again with the same ``--out``.
    Venues in JSON files keep their lines as they are; other formats keep the venue columns.
    """
    W.write_raw_json(mesh.mesh_resume(mesh.mesh_grid(spark), a.resume), f"{a.out}/cells")
    venues = R.load_venue_lines(spark, a.venues) if a.format == "json" else _venues(spark, a)
    found = collect_mesh(spark, venues, f"{a.out}/state", cap=a.cap, start=a.resume)
    W.write_raw_json(found.select("id", "cell_id", "rank"), f"{a.out}/sweep")
    if a.format == "json":
        found.select(F.col("doc").alias("value")).write.mode("overwrite").text(f"{a.out}/venues")
    else:
        W.write_collection(found.select(*venues.columns), f"{a.out}/venues")


COMMANDS = {"retail": run_retail, "map": run_map, "venues": run_venues,
            "categories": run_categories, "shares": run_shares, "mesh": run_mesh}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="poicraft.plans.run", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("pipeline", choices=sorted(COMMANDS))
    p.add_argument("--establishments", nargs="+"), p.add_argument("--catalog"), p.add_argument("--venues")
    p.add_argument("--postal"), p.add_argument("--out", required=True)
    p.add_argument("--format", default="json", help="venue source format (json, parquet, a connector)")
    p.add_argument("--option", action="append", default=[], metavar="KEY=VALUE",
                   help="option of the venue source, e.g. a connector's database and collection")
    p.add_argument("--keywords", nargs="*", default=[""])
    p.add_argument("--any-keywords", nargs="*", default=[], help="map: keep rows with any of these (F3)")
    p.add_argument("--any-columns", nargs="*", default=["raz_social", "nombre_act"])
    p.add_argument("--categories", nargs="*", default=[])
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--cap", type=int, default=mesh.CELL_CAP)
    p.add_argument("--resume", type=int, default=0)
    p.add_argument("--slice", type=int, default=0, help="also write the first N entities by id")
    p.add_argument("--category", default="comercioPorMenor")
    p.add_argument("--kind", default="unidadEconomica")
    p.add_argument("--as-of", dest="as_of", default=None, help="UTC 'YYYY-MM-DD HH:MM:SS'")
    p.add_argument("--audit", action="store_true",
                   help="print row counts after each step (retail, map), observed in one pass")
    return p


def main(argv=None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"poicraft-{a.pipeline}").getOrCreate()
    checkpoint_dir(spark)
    a.stage_audit = StageAudit() if a.audit else None
    COMMANDS[a.pipeline](spark, a)
    if a.stage_audit is not None and a.pipeline in ("retail", "map"):
        for row in a.stage_audit.table(spark).toJSON().collect():  # one row per stage
            print(row)


if __name__ == "__main__":
    main()
