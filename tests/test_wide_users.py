"""Addresses made of user numbers that don't fit into one group of an IPv6 address, or are null."""

from corpusmill.plans import lookups


def test_every_sixth_address_is_one(spark, tmp_path):
    nations = [(f"N{k}", k) for k in range(25)]
    spark.createDataFrame(nations, "n_name string, n_nationkey long").write.parquet(str(tmp_path / "nation.parquet"))
    users = [7, 65535, 65536, 1_048_575, 5_000_000_000, None]
    events = [(9363 * k - 9363 * k % 3, u) for k in range(0, 21) for u in users]
    spark.createDataFrame([(e * 8 + 3 * i, u) for i, (e, u) in enumerate(events)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.prefix, r.n_name) for r in lookups.address_networks(spark, str(tmp_path)).collect()}
    own = {e * 8 + 3 * i for i, (e, _) in enumerate(events)}
    assert set(got) == own
    for e in own:
        g = e * 7 % 65536
        held = [(2 + k % 15, n) for n, k in nations if g >> (14 - k % 15) == (k * 2621) >> (14 - k % 15)]
        longest = max((p for p, _ in held), default=None)
        assert e % 3 == 0 and got[e] == ((longest, min(n for p, n in held if p == longest)) if held else (None, None))
