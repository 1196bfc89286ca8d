"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from mediacat.operators import browse, exact, keeper, mapview, search, similar  # noqa: E402
from mediacat.operators.filters import MediaFilter  # noqa: E402
from mediacat.plans import fixtures as fx  # noqa: E402
from mediacat.plans.catalogue import QUERIES  # noqa: E402
from mediacat.runtime import local_session, ship_package  # noqa: E402

COPIES = 20


def replicated(df, *ids):
    """The table COPIES times over, with distinct ids; the source file is a single split."""
    out = df.repartition(df.sparkSession.sparkContext.defaultParallelism).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    for name in ids:
        out = out.withColumn(name, F.col(name) + F.col("__copy") * 10_000_000)
    return out.drop("__copy")


def fingerprints_at_scale(spark, sf):
    """COPIES shifted versions of the fingerprints: more distinct ones, same neighbourhoods."""
    rows = fx.fingerprints(spark, sf).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.selectExpr(
        "id + c * 10000000 as id", "file_size", "concat(substr(ph, 1 + c * 3), substr(ph, 1, c * 3)) as ph"
    )


BENCH = {
    "timeline": lambda s, d: browse.timeline(fx.shipments(s, d)),
    "timeline_x20": lambda s, d: browse.timeline(replicated(fx.shipments(s, d), "id")),
    "timeline_by_day": lambda s, d: browse.timeline(fx.shots(s, d), unit="day"),
    "browse_page": lambda s, d: browse.browse_page(fx.shipments(s, d), MediaFilter(limit=100, offset=500)),
    "browse_deep_page": lambda s, d: browse.browse(fx.shipments(s, d), MediaFilter(limit=100, offset=300_000)),
    "month_offset": lambda s, d: browse.month_offset(fx.shipments(s, d), "1996-12"),
    "map_clusters": lambda s, d: mapview.map_clusters(fx.shipments(s, d), -90, -180, 90, 180, 6),
    "map_clusters_x20": lambda s, d: mapview.map_clusters(replicated(fx.shipments(s, d), "id"), -90, -180, 90, 180, 6),
    "exact_groups": lambda s, d: exact.exact_groups(fx.media(s, d)),
    "pick_keeper": lambda s, d: keeper.pick_keeper(fx.members(s, d), fx.media(s, d)),
    "diff_listing": QUERIES["i7_diff_listing"],
    "apply_scan": QUERIES["i8_apply_scan_media"],
    "purge": QUERIES["m4_purge"],
    "restore_paths": QUERIES["m3_restore_paths"],
    "similar_banded": lambda s, d: similar.similar_components(fx.fingerprints(s, d), mode="banded"),
    "similar_complete": lambda s, d: similar.similar_components(fx.fingerprints(s, d)),
    "similar_complete_x20": lambda s, d: similar.similar_components(fingerprints_at_scale(s, d)),
    "search_top50": lambda s, d: search.search(fx.plans(s, d), fx.embeddings(s, d), limit=50),
    "search_top50_x20": lambda s, d: search.search(
        fx.plans(s, d), replicated(fx.embeddings(s, d), "photo_id"), limit=50
    ),
    "search_with_media_x20": lambda s, d: search.search(
        fx.plans(s, d), replicated(fx.embeddings(s, d), "photo_id"), replicated(fx.vector_media(s, d), "id"), limit=50
    ),
    "stream_timeline": QUERIES["s3_stream_timeline"],
    "content_hash": QUERIES["i2_content_hash"],
    "normalize_tags": QUERIES["i10_normalize_tags"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "bench", **{"spark.ui.showConsoleProgress": "false"})
    ship_package(spark)
    fx.table(spark, sf, "region").count()
    seconds = {}
    for name, build in BENCH.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        build(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
