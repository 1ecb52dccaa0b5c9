"""The schema rewrite against brute force: the whole table, and nulls, repeats, odd numbers, clashing columns, a lost driver and a lost attempt."""

import hashlib
import json
import math
import os
import zlib
from datetime import datetime, timezone

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusmill.llm import queries, schema_rewrite as S
from corpusmill.llm.common import scratch

SF = "/root/testdata/sf0.001"
NAMES = "client_id master_id source updated_at name email city nation_id segment balance".split()


def local(path):
    return path.removeprefix("file://")


def slow(rows, files):
    """file_no to what is told of a file, of rows as dicts."""
    crc = lambda s: zlib.crc32(str(s).encode())
    rows = sorted(rows, key=lambda r: (crc(r["client_id"]), r["client_id"]))
    per, out = 1 + len(rows) // files, {}
    for no in range(-(-len(rows) // per)):
        v = crc(f"19:{no}") % 24
        v = 0 if v > 15 else v
        start = ["client_id", *NAMES[1:]]
        if v & 4:
            start = [c for c in start if c not in ("nation_id", "segment")]
        if v & 2:
            start = start[:1] + start[1:][::-1]
        if v & 1:
            start = [{"name": "email", "email": "name"}.get(c, c) for c in start]
        told, nulls = [], 0
        for r in rows[no * per : (no + 1) * per]:
            r = dict(r)
            if v & 4:
                r["nation_id"], r["segment"] = -1, "none"
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
            nulls += sum(x is None for x in r.values())
            t = r["updated_at"]
            r["updated_at"] = None if t is None else (lambda d: (d.days * 86400 + d.seconds) * 10**6 + d.microseconds)(t.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc))
            b = r["balance"]
            r["balance"] = None if b is None else math.floor(1048576 * b) if math.isfinite(b) else b
            told.append(["?" if r[c] is None else str(r[c]) for c in NAMES])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[no] = (v, len(told), nulls, sha(",".join(t[0] for t in told)), sha("\n".join(map("|".join, told))), ",".join(start), ",".join(NAMES), v != 0)
    return out


def told(df):
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in df}


def check_files(found, fields=S.CLIENTS):
    """The final files have the evolved schema and ids, and lie alone in their folder."""
    folder = os.path.dirname(local(found[0].path))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r.path) for r in found)
    for r in found:
        s = pq.read_schema(local(r.path))
        assert S.same_layout(s, fields) and [f.metadata[b"PARQUET:field_id"] for f in s] == [str(k).encode() for k in range(1, 11)]
    assert not os.path.exists(f"{folder}/../staging") and os.listdir(f"{folder}/../lineage") == ["lineage.json"]


def test_whole_table(spark):
    rows = pq.read_table(f"{SF}/clients.parquet").to_pylist()
    found = queries.queries()["op13_schema_rewrite"](spark, SF).collect()
    assert told(found) == slow(rows, 250) and len({r.version for r in found}) > 10
    check_files(found)


KINDS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def edges():
    t = datetime(1969, 12, 31, 23, 59, 59, 999999)
    rows = [(k, None if k % 5 == 0 else k, "web|crm" if k % 3 else None, None if k % 7 == 0 else t, f"n,{k}", "?", "é\n", None if k % 4 == 0 else 2**31 - 1, None if k % 2 else "none", [1.1, -0.0, None, -1e-9, 1e300, math.inf][k % 6]) for k in range(200)]
    return [*rows, (-(2**63), 0, "", datetime(2024, 2, 29), "", "", "", -1, "", 0.1), (2**63 - 1, None, None, None, None, None, None, None, None, None), (10**18 + 1, 2**62 + 1, "x" * 100_000, t, "", "", "", 0, "", -1e-320)]


def test_edges(spark):
    rows = edges()
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], KINDS + ", r int, file_no string, _file string")
    found = S.rewrite_clients(df, files=40).collect()
    assert told(found) == slow([dict(zip(NAMES, r)) for r in rows], 40)
    check_files(found)
    assert S.rewrite_clients(df.limit(0), files=3).collect() == []


def test_rows_that_repeat_and_null_keys_stay(spark):
    rows = [(k % 5 if k % 6 else None, k % 2, "s", None, None, None, None, 1, "g", 1.0) for k in range(60)]
    found = S.rewrite_clients(spark.createDataFrame(rows, KINDS), files=6).collect()
    check_files(found)
    got = [pq.read_table(local(r.path)).column("client_id").to_pylist() for r in sorted(found, key=lambda r: r.file_no)]
    flat = [x for part in got for x in part]
    assert flat[:10] == [None] * 10 and flat[10:] == sorted(flat[10:], key=lambda i: (zlib.crc32(str(i).encode()), i)) and len(flat) == 60
    assert [len(p) for p in got] == [11] * 5 + [5]


def test_a_lost_driver_and_a_lost_attempt(spark):
    """A plan that was cut off anywhere is finished by the next run; files of attempts that no plan names go."""
    root = scratch(spark, "rewrite")
    df = spark.createDataFrame(edges(), KINDS)
    S.write_drifted(df, root, files=12)
    folder = S.Folder(root)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S.Folder, "finish", lambda self: None)  # the driver stops after the plan
        writer = S.EvolvedWriter(root, S.CLIENTS)
        messages = []
        for path in folder.files():
            messages.append(writer.write(S.DriftedReader(root, S.CLIENTS).read(S.OneFile(path))))
        lost = writer.write(S.DriftedReader(root, S.CLIENTS).read(S.OneFile(folder.files()[1])))
        writer.commit([*messages, None])
    entries = [e for m in messages for e in m.entries]
    first = next(e for e in entries if e.staged)
    folder.store.move(folder.local(first.staged), folder.local(first.path))  # one move was done
    assert lost.entries[0].staged is None or folder.exists(lost.entries[0].staged)
    folder.finish()
    lines = [json.loads(x) for x in open(f"{local(root)}/lineage/lineage.json")]
    assert sorted(x["path"] for x in lines) == folder.files() and not folder.exists(f"{root}/staging")
    again = S.rewrite(spark, root, S.CLIENTS).collect()
    assert sorted((r.path, r.rows_sha256) for r in again) == sorted((x["path"], x["rows_sha256"]) for x in lines) and not any(r.rewritten for r in again)


def test_a_value_that_does_not_fit_is_an_error(spark):
    root = scratch(spark, "rewrite")
    S.write_drifted(spark.createDataFrame(edges(), KINDS), root, files=2)
    narrow = [f._replace(kind="int32") if f.name == "master_id" else f for f in S.CLIENTS]
    before = S.Folder(root).files()
    with pytest.raises(Exception, match="not in range|out of bounds|master_id"):
        S.rewrite(spark, root, narrow)
    assert S.Folder(root).files() == before
