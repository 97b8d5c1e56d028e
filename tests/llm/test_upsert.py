import bisect
import hashlib
import math
import random
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, upsert

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
SETS = ("source", "segment", "city", "balance")


def crc(x):
    return zlib.crc32(str(x).encode())


def plain(clients, changes):
    """Rows of the report, but for path and columns, from lists of dictionaries."""
    most = 1 + len(clients) // 1000
    base = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [base[k : k + most] for k in range(0, len(base), most)]
    firsts, last = [f[0]["client_id"] for f in files], {}
    for c in changes:
        order = tuple((c[k] is not None, c[k] or 0) for k in ("seq", "change_id"))
        if c["client_id"] is not None and (c["client_id"] not in last or order > last[c["client_id"]][0]):
            last[c["client_id"]] = order, c
    homes = [{r["client_id"]: r for r in f} for f in files]
    new = [dict(h) for h in homes]
    for k, (_, c) in last.items() if files else ():
        at = max(0, bisect.bisect_right(firsts, k) - 1)
        h = crc(firsts[at]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h):
            new[at].pop(k, None)
        else:
            new[at][k] = (new[at].get(k) or dict.fromkeys(clients[0]) | {"client_id": k}) | {x: c[x] for x in SETS}
    merged = []
    for old, now, file in zip(homes, new, files):
        if old == now:
            merged.append((False, file))
            continue
        rows, at = [now[k] for k in sorted(now)], 0
        n = -(-len(rows) // most)
        for k in range(n):
            size = len(rows) // n + (k < len(rows) % n)
            if merged and merged[-1][0] and len(merged[-1][1]) + size <= most:
                merged[-1] = True, merged[-1][1] + rows[at : at + size]
            else:
                merged.append((True, rows[at : at + size]))
            at += size
    return [
        (
            rows[0]["client_id"],
            len(rows),
            sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in rows),
            sum(zlib.crc32("|".join(r[x] or "" for x in ("source", "segment", "city")).encode()) for r in rows),
            hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(),
            rewritten,
        )
        for rewritten, rows in merged
    ]


def reported(df):
    return sorted(tuple(r[c] for c in ("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "rewritten")) for r in df.collect())


def written(spark, tmp_path, clients, changes):
    spark.createDataFrame([tuple(c.values()) for c in clients], CLIENTS).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame([tuple(c.values()) for c in changes], CHANGES).write.parquet(f"{tmp_path}/client_changes.parquet")
    return str(tmp_path)


def made(rng, n, m, low=0, high=None):
    high = high or 2 * n
    value = lambda: rng.choice([None, "a", "b", "ü"])
    clients = [
        dict(zip([c.split()[0] for c in CLIENTS.split(", ")], (k, k, value(), datetime(2024, 1, 1, k % 24), "n", None, value(), 1, value(), rng.choice([None, round(rng.uniform(-99, 99), 2)]))))
        for k in rng.sample(range(low, high), n)
    ]
    names = [c.split()[0] for c in CHANGES.split(", ")]
    changes = [
        dict(zip(names, (k, rng.choice([None, 7, rng.randrange(low - 5, high + 40)]), rng.choice([None, 1, 2, 3]), rng.choice("UUID"), None, value(), value(), value(), rng.choice([None, 1.25]))))
        for k in range(m)
    ]
    return clients, changes + changes[:5]


@pytest.mark.parametrize("n, m, seed", [(40, 60, 1), (1200, 700, 2)])
def test_equals_brute_force(spark, tmp_path, n, m, seed):
    clients, changes = made(random.Random(seed), n, m)
    clients.append(dict.fromkeys(clients[0]))
    found = queries.op11_upsert(spark, written(spark, tmp_path, clients, changes))
    want = sorted(plain(clients, changes))
    assert reported(found) == want and any(r[-1] for r in want) and not all(r[-1] for r in want)
    rows = found.collect()
    assert {r["columns"] for r in rows} == {",".join(clients[0])}
    for r in rows[:3]:
        ids = [x[0] for x in spark.read.parquet(r["path"]).select("client_id").collect()]
        assert ids == sorted(ids) and hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() == r["ids_sha256"]
    folder = rows[0]["path"].rpartition("/")[0]
    assert upsert.Folder(spark, folder).files() == sorted(r["path"].rpartition("/")[2] for r in rows)
    stayed = spark.read.parquet(*[r["path"] for r in rows if not r["rewritten"]])
    assert stayed.schema == spark.createDataFrame([], CLIENTS).schema


def test_equals_brute_force_on_the_tables(spark):
    rows = lambda t: [r.asDict() for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()]
    assert reported(queries.op11_upsert(spark, "/root/testdata/sf0.001")) == sorted(plain(rows("clients"), rows("client_changes")))


@pytest.mark.parametrize("n, m", [(0, 5), (30, 0), (0, 0)])
def test_empty_tables(spark, tmp_path, n, m):
    clients, changes = made(random.Random(3), max(n, 1), max(m, 1))
    folder = written(spark, tmp_path, clients[:n], changes[:m])
    assert reported(queries.op11_upsert(spark, folder)) == (sorted(plain(clients[:n], changes[:m])) if n else [])


def test_every_row_deleted_and_texts_as_keys(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{k:03d}", "x" * 100_000 if k == 3 else "y", k) for k in range(50)], "k string, v string, file_name_ long")
    folder, always = f"{tmp_path}/t", lambda first: (F.lit(True), F.col("op") == "D")
    upsert.write_table(rows, "k", folder, 8)
    sizes = lambda: [n for _, n in sorted((r[0], r[1]) for r in upsert.table_rows(spark, folder, rows.schema).groupBy("file_name").agg(F.min("k").alias("k"), F.count("k")).select("k", "count(k)").collect())]
    assert sizes() == [8] * 6 + [2]
    ops = lambda *x: spark.createDataFrame([(k, n, op, "new", "extra") for n, (k, op) in enumerate(x)], "k string, n long, op string, v string, __at string")
    stayed = upsert.upsert(spark, folder, rows.schema, "k", ops(("a", "U"), ("k010", "U"), ("k010", "D"), ("zz", "U"), ("k031", "D"), ("none", "D")), ["n"], ["v"], always, 8)
    assert sizes() == [5, 4, 7, 8, 7, 8, 8, 3] and len(stayed) == 3
    found = {r["k"]: (r["v"], r["file_name_"]) for r in upsert.table_rows(spark, folder, rows.schema).collect()}
    assert len(found) == 50 and found["a"] == ("new", None) and "k010" not in found and len(found["k003"][0]) == 100_000
    upsert.upsert(spark, folder, rows.schema, "k", ops(*[(k, "D") for k in found]), ["n"], ["v"], always, 8)
    assert upsert.Folder(spark, folder).files() == []


def test_rows_that_share_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(k // 3, k) for k in range(12)] + [(None, 1)], "k long, v long")
    upsert.write_table(rows, "k", f"{tmp_path}/t", 6)
    changes = spark.createDataFrame([(0, 1, 5), (2, 1, None), (2, 1, 9), (None, 1, 1)], "k long, n long, v long")
    upsert.upsert(spark, f"{tmp_path}/t", rows.schema, "k", changes, ["n"], ["v"], lambda first: (F.lit(True), F.lit(None).cast("boolean")), 6)
    found = sorted((r["k"], r["v"]) for r in upsert.table_rows(spark, f"{tmp_path}/t", rows.schema).collect())
    assert found == [(0, 5)] * 3 + [(1, 3), (1, 4), (1, 5)] + [(2, 9)] * 3 + [(3, 9), (3, 10), (3, 11)]


def test_too_many_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        upsert.write_table(spark.range(3000).withColumnRenamed("id", "k"), "k", f"{tmp_path}/t", 2)


def test_layout_against_a_walk_over_files():
    rng = random.Random(5)
    for _ in range(500):
        most = rng.randrange(1, 9)
        sizes = [rng.choice([None, 0, rng.randrange(1, most + 1), rng.randrange(1, 5 * most)]) for _ in range(rng.randrange(8))]
        files = []
        for at, n in enumerate(sizes):
            if n is None:
                files.append((None, []))
                continue
            pieces = -(-n // most)
            rows = [(at, r) for r in range(n)]
            for k in range(pieces):
                take = n // pieces + (k < n % pieces)
                part, rows = rows[:take], rows[take:]
                if files and files[-1][0] and len(files[-1][1]) + take <= most:
                    files[-1][1].extend(part)
                else:
                    files.append((True, part))
        want = [part for kind, part in files if kind]
        got = {}
        for at, start, n, small, larger in upsert.layout(sizes, most):
            for r in range(n):
                wide = larger * (small + 1)
                nth = r // (small + 1) if r < wide else larger + (r - wide) // small
                got.setdefault(start + nth, []).append((at, r))
        assert [got[k] for k in sorted(got)] == want and sorted(got) == list(range(len(want)))


def test_homes_by_binary_search(spark):
    for n in (1, 2, 3, 4, 7, 8, 9):
        firsts = [10 * k for k in range(n)]
        keys = spark.createDataFrame([(k, firsts) for k in range(-3, 10 * n + 15)], "k long, f array<long>")
        for k, at in keys.select("k", upsert.home(F.col("k"), F.col("f"), n)).collect():
            assert at == max(0, bisect.bisect_right(firsts, k) - 1)
