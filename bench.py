"""Times the batch pipeline step by step, and a search, on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

from kinfold.config import ResolutionConfig  # noqa: E402
from kinfold.operators import search  # noqa: E402
from kinfold.plans import pipeline  # noqa: E402
from kinfold.sources.synthetic import OrdersConnector  # noqa: E402
from kinfold.store import save  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    spark = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    config, source, times = ResolutionConfig(), OrdersConnector(spark, folder), {}

    def timed(name, step):
        began = time.time()
        out = step()
        times[name] = round(time.time() - began, 3)
        return out

    hub = timed("stage", lambda: pipeline.staged(spark, source))
    hub = timed("resolve", lambda: pipeline.resolved(hub, config))
    hub = timed("enrich", lambda: pipeline.enriched(hub))
    hub = timed("merge", lambda: pipeline.merged(hub))
    hub = timed("rollup", lambda: pipeline.rolled_up(hub, source, config))
    hub = timed("survivorship", lambda: pipeline.finalized(hub, config, "2024-01-01"))
    profiles = timed("materialize", lambda: save(hub.profiles, "profiles"))
    aliases = timed("alias_index", lambda: save(hub.aliases, "aliases"))
    timed("identity_search", lambda: search.search(profiles, aliases, "lie").rows.collect())
    timed("credential_best", lambda: search.best_credentials(hub.credentials, "1997-06-01", config).write.format("noop").mode("overwrite").save())
    records = hub.staged.count()
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "entity-resolution backfill of people records, wall time", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "records": records}))


if __name__ == "__main__":
    main()
