"""Long histories of one value in a URL list."""

import bisect
import datetime as dt
import random

import pytest

from lodestone.llm import url_filter as urls

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_long_histories(spark, limit):
    rng = random.Random(3)
    days = rng.sample(range(5000), 700)
    entries = [("host", "hot.com", T0 + dt.timedelta(hours=d), rng.choice(["block", "allow", "remove"])) for d in days]
    entries += [("domain", "hot.com", T0 + dt.timedelta(hours=d), "block") for d in (100, 101)] + [("host", "cold.com", T0, "allow")]
    rows = [(i, rng.choice(["http://hot.com/a", "http://hot.com/b", "http://cold.com", "http://none.com"]), T0 + dt.timedelta(minutes=rng.randrange(-600, 310_000))) for i in range(400)]
    got = urls.filter_urls(spark.createDataFrame(rows, "id long, url string, fetched timestamp"), spark.createDataFrame(entries, "kind string, value string, since timestamp, action string"), broadcast_bytes=limit, salts=3, fan=16)
    history = sorted((s, a) for k, v, s, a in entries if k == "host" and v == "hot.com")

    def want(url, at):
        if "cold" in url:
            return "allow" if at >= T0 else "none"
        if "hot" not in url:
            return "none"
        k = bisect.bisect_right([s for s, _ in history], at)
        if k and history[k - 1][1] != "remove":
            return history[k - 1][1]
        return "block" if at >= T0 + dt.timedelta(hours=100) else "none"

    assert {r.id: r.verdict for r in got.collect()} == {i: want(u, t) for i, u, t in rows}


def test_blocks_are_bounded_and_in_order(spark):
    entries = spark.createDataFrame([("host", "a.com", T0 + dt.timedelta(hours=i * 7 % 100), "block") for i in range(100)] + [("host", "b.com", T0, "allow")], "kind string, value string, since timestamp, action string")
    blocks, index = urls.histories(entries, 8)
    rows = blocks.collect()
    assert max(len(r.dated) for r in rows) <= 8 and sum(len(r.dated) for r in rows) == 101
    starts = {r.value: [x["since"] for x in r.starts] for r in index.collect()}
    assert starts["a.com"] == sorted(starts["a.com"]) and starts["a.com"][0] == T0 and len(starts["b.com"]) == 1
