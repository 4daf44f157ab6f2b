"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

HEADLINE = (
    "bars_1h", "features_price", "gap_fill", "asof_strict_stale", "flow_table", "ic_halves", "bt_metrics", "trade_stats", "perp_account",
    "confluence_votes", "rotation_null", "panel_rotation_null", "spa_stat", "hmm_filter_fixed", "hmm_fit", "hsmm_fit", "walk_forward",
)


def main() -> None:
    from tidebar.plans.queries import queries
    from tidebar.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    work = tempfile.mkdtemp(prefix="spark-")
    spark = build_session("bench", **{"spark.sql.warehouse.dir": f"{work}/warehouse"})
    registered, seconds = queries(), {}
    registered["bars_1h"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session's own start is not timed
    for name in HEADLINE:
        began = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
