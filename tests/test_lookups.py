"""The data source of responses, the inverted index, networks and quantiles against brute force."""

import ipaddress
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from corpusmill.operators import index, networks, quantiles, rank
from corpusmill.sources import responses as R


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp()


def saved(spark, root, providers, pages):
    rows = [(p, f"q{k % 5}" if k % 7 else None, k, 200 if k % 3 else 503, f"body {p} {k}", "en") for p in providers for k in pages]
    R.write_responses(spark.createDataFrame([*rows, (None, "q", 1, 200, "", "")], R.SCHEMA), root, 10)
    return rows


def test_reads_only_the_blocks_that_can_have_rows(spark, folder):
    rows = saved(spark, folder, ["brave", "web/x"], range(100))
    reader = R.ResponseReader({"path": folder, "block_pages": "10"})
    left = list(reader.pushFilters([EqualTo(("provider",), "brave"), In(("query",), ("q1", "q2", None)), GreaterThan(("page",), 34), LessThanOrEqual(("page",), 59), StringStartsWith(("body",), "b")]))
    assert left == [StringStartsWith(("body",), "b")]
    parts = reader.partitions()
    assert [p.name.rsplit("=")[-1] for p in parts] == ["3", "4", "5"] and len(R.ResponseReader({"path": folder, "block_pages": "10"}).partitions()) == 20
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = [r for r in rows if r[0] == "brave" and r[1] in ("q1", "q2") and 34 < r[2] <= 59]
    assert sorted(r["page"] for r in got) == [r[2] for r in want]
    df = R.read_responses(spark, folder, block_pages=10)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    some = df.where((F.col("provider") == "web/x") & (F.col("page") > 34) & (F.col("page") <= 59) & F.col("query").isin("q1", "q2") & (F.col("status") == 200))
    assert some.rdd.getNumPartitions() == 3 and sorted(r.page for r in some.collect()) == [r[2] for r in want if r[3] == 200]
    assert df.where("provider = 'nobody'").count() == 0 and R.read_responses(spark, f"{folder}/none").count() == 0


def test_a_stream_goes_on_by_page(spark, folder):
    def run():
        rows = R.read_responses(spark, f"{folder}/in", stream=True, block_pages=10)
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.provider, r.page) for r in spark.read.schema(R.SCHEMA).parquet(f"{folder}/out").collect())

    saved(spark, f"{folder}/in", ["a"], range(25))
    assert run() == [("a", k) for k in range(25)] == run()
    saved(spark, f"{folder}/in", ["a", "b"], range(30, 45))
    assert run() == [*[("a", k) for k in [*range(25), *range(30, 45)]], *[("b", k) for k in range(30, 45)]]


def texts(rng, n):
    words = [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    return [" ".join(rng.choice(words, int(rng.integers(0, 60)), p=weight / weight.sum())) for _ in range(n)]


def test_index_gives_what_scoring_everything_gives(spark, folder):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([*enumerate(texts(rng, 400)), (900, None), (None, "w1 w2"), (901, "w1"), (901, "w2 w2")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w1 w7 w7 w40"), (1, "w200"), (2, "nothing known"), (3, None), (4, "w3 w3 W5, the w90 w91 w92"), (4, "w6"), (None, "w1")], "q long, text string")
    built = index.build(docs, "doc_id", folder, range_docs=20)
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    got = {}
    for r in index.search(built, queries, "q", 5).collect():
        got.setdefault(r.query, []).append((r["rank"], r.key, round(r.score, 9)))
    for q, text in ((0, "w1 w7 w7 w40"), (1, "w200"), (4, "w3 w3 W5, the w90 w91 w92 w6")):
        rows = [(r.doc_id, r.score) for r in rank.scores(one, text).where("score > 0").collect()]
        want = sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))[:5]
        assert sorted(got[q]) == [(k + 1, i, round(s, 9)) for k, (i, s) in enumerate(want)]
    assert set(got) == {0, 1, 4}
    terms = index.query_terms(queries, "q")
    held = index.bounds(built, terms).join(index.scored(built, terms, index.bounds(built, terms)), ["query", "range"])
    assert held.where("score > bound").count() == 0 and built.docs == 402 and index.load(spark, folder).docs == 402


def test_an_index_of_nothing(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert index.search(index.build(docs, "doc_id", folder), docs, "doc_id", 3).collect() == []


ADDRESSES = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "10.0.0.1", "256.1.1.1", "1.2.3", "", None, "::", "::1", "fe80::1%eth0", "FE80::ABCD", "2001:db8::", "2001:db8:0:1:2:3:4:5", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "g::1", "12345::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "64:ff9b::10.0.0.1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1.2.3.4:80"]
NETS = ["10.0.0.0/8", "10.0.0.0/30", "0.0.0.0/0", "1.2.3.4", "1.2.3.0/24", "fe80::/10", "::/0", "2001:db8::/32", "2001:db8:0:1::/64", "::ffff:0:0/96", "::1/128", "128.0.0.0/1", "8000::/1", "10.0.0.1/33", "x/8", "1.2.3.4/", None, "10.0.0.9/24"]


def test_networks_by_brute_force(spark):
    def parse(text):
        try:
            return ipaddress.ip_address((text or "").split("%")[0].strip())
        except ValueError:
            return None

    rng = np.random.default_rng(3)
    many = [*ADDRESSES, *[str(ipaddress.IPv4Address(int(x))) for x in rng.integers(0, 2**32, 100)], *[str(ipaddress.IPv6Address(int(a) << 64 | int(b))) for a, b in rng.integers(0, 2**63, (100, 2))]]
    rows = spark.createDataFrame([(k, a, 1) for k, a in enumerate(many)], "id int, ip string, level int")
    nets = spark.createDataFrame([(c, f"n{k}") for k, c in enumerate(NETS)], "cidr string, net string")
    real = []
    for k, c in enumerate(NETS):
        try:
            real.append((ipaddress.ip_network(c, strict=False), f"n{k}"))
        except (ValueError, TypeError):
            pass
    want = {}
    for k, a in enumerate(many):
        at = parse(a)
        hits = [(n.prefixlen, name) for n, name in real if at is not None and at.version == n.version and at in n]
        want[k] = min(hits, key=lambda h: (-h[0], h[1])) if hits else (None, None)
    made = networks.networks(nets, "cidr").select("net", "prefix", "first", "last", F.col("level").alias("level"), "bucket")
    found = networks.within(rows.drop("level"), "ip", made, "net").collect()
    assert {r.id: (r.prefix, r.net) for r in found} == want and len(found) == len(many)
    assert networks.within(rows.drop("level"), "ip", made.where("false"), "net").where("net is not null").count() == 0


def test_quantiles_by_brute_force(spark):
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([7.5]), "wide": np.exp2(rng.uniform(-30, 30, 1500)) * rng.choice([-1, 1], 1500), "same": np.full(1800, -0.25), None: rng.normal(size=50)}
    rows = spark.createDataFrame([(g, float(v), 1) for g, vs in groups.items() for v in vs] + [("hot", None, 1), ("void", None, 1)], "g string, v double, n int")
    q = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = {(r.g, r["quantile"]): (r["value"], r.n) for r in quantiles.exact_quantiles(rows, ["g"], "v", q, small=400, bins=64).collect()}
    assert len(got) == 6 * len(q)
    for g, vs in groups.items():
        for x in q:
            v, n = got[g, x]
            assert n == len(vs) and np.isclose(v, np.quantile(vs, x), rtol=1e-12, atol=0)
    assert quantiles.exact_quantiles(rows.where("false"), ["g"], "v", q).collect() == [] and quantiles.exact_quantiles(rows, [], "v", [0.5], small=100).first().n == 8351
