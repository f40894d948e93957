"""Time the headline queries and print one line of JSON.

Each query is built anew and run to the end ``REPEATS`` times after one
untimed run; the fastest counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from forgeboard.session import local_session

HEADLINE = """
popular_languages popular_languages_packages language_leaders language_leaders_packages
leaders_of_every_language language_page_first language_page_second popular_devs_stars
popular_devs_forks popular_devs_followers popular_devs_public_repos popular_devs_company
popular_devs_packages user_profiles get_user repo_listing repos_for_user profile_repos
nested_profile owner_totals owner_totals_packages search_users search_repos_documents
search_repos_pages search_repos_escaped last_run candidate_logins candidate_window_counts
normalize_user_payloads normalize_repo_payloads upsert_users upsert_repos prune_stale_repos
prune_stale_packages refresh_users refresh_repos published_refresh_repos hide_users
delete_users_repos authorize_allowed evolve_users user_key_violations
""".split()
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(
        cores, int(cores), **{"spark.python.sql.dataFrameDebugging.enabled": "false"}
    )

    def once(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(min(once(name) for _ in range(REPEATS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
