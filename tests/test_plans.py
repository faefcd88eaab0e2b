"""Registered queries over small tables: they must cover all rows."""

import datetime

from cloakwork.plans import catalog


def test_stat_deltas_cover_all_users(spark, tmp_path):
    rows = [(i, user, datetime.datetime(2024, 1, 1 + i % 3, 12)) for i, user in enumerate([0, 49, 50, 51, 1499, 100_000] * 7)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    last: dict = {}
    for i, user, ts in rows:
        last.setdefault(user, {})[ts.date()] = i
    want = []
    for user, days in last.items():
        before = 0
        for day in sorted(days):
            want.append((user, day, days[day] - before))
            before = days[day]
    assert sorted(map(tuple, catalog.QUERIES["stat_deltas"](spark, str(tmp_path)).collect())) == sorted(want)


def test_vault_wire_has_a_row_for_each_entry(spark, tmp_path):
    texts = ["ann@example.org and bob@example.org at 10.0.0.1", "only 10.0.0.2", "again ann@example.org, ann@example.org", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["vault_wire"](spark, str(tmp_path)).collect()
    assert sorted((r.key, r.original, r.mode) for r in got) == [("vault:0", "10.0.0.1", "regex"), ("vault:0", "ann@example.org", "regex"), ("vault:0", "bob@example.org", "regex"), ("vault:1", "10.0.0.2", "regex"), ("vault:2", "ann@example.org", "regex")]
    assert len({(r.key, r.surrogate) for r in got}) == 5 and all(r.surrogate for r in got)
