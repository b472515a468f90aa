"""Prints one line of JSON: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]. Every query is run to its last row
(a noop write). ``BENCH_ALL=1`` runs all queries of the registry."""

from __future__ import annotations

import json
import os
import sys
import time

from brindle.plans import registry
from brindle.session import get_session

HEADLINE = [
    "cai_features", "rfm_scores", "f_grains", "money_gross_return_net", "migration_matrix", "cohort_retention", "change_decomposition", "basket_pairs",
    "category_transition", "scd2_asof_join", "identity_stitch", "star_join", "pricing_summary", "audience_jaccard", "sessions_full_rule", "first_last_linear_touch",
    "anova_oneway", "kruskal_wallis", "chi2_cramers_v", "km_curve", "keyword_scores", "ngram_counts", "quality_gates_summary", "merge_upsert_delete",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    q = registry.queries()
    names = list(q) if os.environ.get("BENCH_ALL") else HEADLINE
    run = lambda n: q[n](spark, d).write.format("noop").mode("overwrite").save()
    run("pricing_summary")  # the session's own start isn't the queries' time
    took = {}
    for n in names:
        t = time.perf_counter()
        run(n)
        took[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total wall time of the queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
