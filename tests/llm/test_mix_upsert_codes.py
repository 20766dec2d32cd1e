"""Source mixing, keyed upsert and vector codes against brute force, on rows with every awkward case."""

import bisect
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merge_on_read, source_mix, vector_codes
from corpusloom.llm.placing import in_order

crc = lambda x: zlib.crc32(str(x).encode())


# places


def test_places_sums_and_lasts_over_several_files(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 50), r.choice([None, 1, 2, 3])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k long, v long").repartition(5)
    placed, _ = in_order(frame, [F.col("k"), F.col("v")], {"before": F.coalesce("v", F.lit(0))}, lasts={"last": F.col("v")})
    got = placed.orderBy("place").collect()
    assert [(x["k"], x["v"]) for x in got] == sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    total, last = 0, None
    for i, x in enumerate(got):
        last = x["v"] if x["v"] is not None else last
        assert (x["place"], x["before"], x["last"]) == (i, total, last)
        total += x["v"] or 0


# mixing


def mix_docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 7, 60]))), r.choice(["a", "b", "é", None, "B"]), "clash", "clash") for i in range(120)]
    rows += [(None, None, None, "x", "x"), (None, "one two", "a", "x", "x"), (5, "twice", "a", "x", "x"), (5, "twice", "a", "x", "x"), (900, "long " * 5000, "a", "x", "x"), (901, " \n\t", "empty", "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size string")


def filled(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        goal = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        above = {s for s in open_ if goal[s] > 2 * sizes[s]}
        if not above:
            return goal
        full |= above


def test_mix_meets_targets_and_whole_documents(spark):
    docs = mix_docs(spark)
    rows = source_mix.op11(docs).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["size"]) for x in rows) == sorted((d["doc_id"] is None, d["doc_id"] or 0, len((d["text"] or "").split())) for d in docs.collect())
    sizes: dict = {}
    for d in docs.collect():
        sizes[d["source"]] = sizes.get(d["source"], 0) + len((d["text"] or "").split())
    goal = filled(sizes)
    assert sorted({(x["source_size"], round(x["target"], 6)) for x in rows}) == sorted({(sizes[s], round(goal[s], 6)) for s in sizes})
    assert all(0 <= x["taken"] <= 2 * x["size"] for x in rows)
    by: dict = {}
    for x in rows:
        by[x["source_size"], x["target"]] = by.get((x["source_size"], x["target"]), 0) + x["taken"]
    assert all(abs(taken - target) < 1 for (_, target), taken in by.items())
    again = source_mix.op11(docs.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_schedule_is_even_and_its_pieces_are_the_words_taken(spark):
    mix = source_mix.Mix(mix_docs(spark), block=16)
    pieces = sorted(mix.pieces().collect(), key=lambda x: (x["slot"], x["at"]))
    taken = {}
    for x in pieces:
        assert x["n_words"] > 0 and x["first_word"] >= 0
        taken[x["doc_id"]] = taken.get(x["doc_id"], 0) + x["n_words"]
    want: dict = {}
    for x in mix.taken().collect():
        want[x["doc_id"]] = want.get(x["doc_id"], 0) + x["taken"]
    assert taken == {k: v for k, v in want.items() if v}
    slots = sorted(mix.slots.collect(), key=lambda x: x["slot"])
    assert len({x["slot"] for x in slots}) == len(slots)
    seen: dict = {}
    for i, x in enumerate(slots):
        assert x["rank"] == seen.get(x["source"], 0)
        seen[x["source"]] = x["rank"] + 1
    total = dict(seen)
    for cut in range(1, len(slots) + 1):  # every beginning holds each source's share, but for a few slots
        part: dict = {}
        for x in slots[:cut]:
            part[x["source"]] = part.get(x["source"], 0) + 1
        assert all(abs(part.get(s, 0) - n * cut / len(slots)) <= 1 + math.log2(len(slots)) for s, n in total.items())


def test_mix_of_nothing(spark):
    schema = mix_docs(spark).schema
    assert source_mix.op11(spark.createDataFrame([], schema)).count() == 0
    rows = source_mix.op11(spark.createDataFrame([(1, None, "a", "", ""), (2, " ", None, "", "")], schema)).collect()
    assert sorted(tuple(x) for x in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_points_below_a_bound_are_counted_from_their_bits(spark):
    bits = 6
    rows = spark.range(1 << bits).withColumn("bound", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 13, 32, 64)])))
    back = lambda n: int(f"{n:0{bits}b}"[::-1], 2)
    for x in rows.select("id", "bound", source_mix.reversed_bits(F.col("id"), bits).alias("slot"), source_mix.below(F.col("id"), F.col("bound"), bits).alias("n")).collect():
        assert x["slot"] == back(x["id"]) and x["n"] == sum(back(m) < x["bound"] for m in range(x["slot"]))


# upsert

CLIENT = "client_id long, master_id long, source string, city string, segment string, balance double, row string, file string, bin string"
CHANGE = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double, home string, mark string"


def upserted(clients: list, changes: list) -> list:
    """The files after op12, by hand: (rewritten, rows)."""
    most = 1 + len(clients) // 1500
    base = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [base[i : i + most] for i in range(0, len(base), most)]
    first = [f[0]["client_id"] for f in files]
    last: dict = {}
    for c in changes:
        k = c["client_id"]
        if k is not None and (k not in last or (c["seq"], c["change_id"]) > (last[k]["seq"], last[k]["change_id"])):
            last[k] = c
    new = [{c["client_id"]: dict(c) for c in f} for f in files]
    for k, c in last.items() if files else ():
        home = max(0, bisect.bisect_right(first, k) - 1)
        h = crc(first[home]) % 10
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            new[home].pop(k, None)
        else:
            new[home][k] = (new[home].get(k) or dict.fromkeys(clients[0]) | {"client_id": k}) | {x: c[x] for x in merge_on_read.SETS}
    out: list = []
    for old, rows in zip(files, ([r[k] for k in sorted(r)] for r in new), strict=True):
        if rows == old:
            out.append((False, rows))
            continue
        k = -(-len(rows) // most)
        sizes = [len(rows) // k + (p < len(rows) % k) for p in range(k)] if rows else []
        for n in sizes:
            own, rows = rows[:n], rows[n:]
            if out and out[-1][0] and len(out[-1][1]) + len(own) <= most:
                out[-1] = (True, out[-1][1] + own)
            else:
                out.append((True, own))
    return out


def shop(n: int, extra: int = 0) -> tuple[list, list]:
    r = random.Random(n)
    word = lambda: r.choice([None, "a", "é", ""])
    clients = [{"client_id": 3 * i, "master_id": i, "source": word(), "city": word(), "segment": word(), "balance": r.choice([None, 1.005, -3.5, 0.0]), "row": "x", "file": None, "bin": "b"} for i in range(n)]
    changes = [{"change_id": i, "client_id": r.choice([7, None, r.randint(-20, 3 * n + 40)]), "seq": r.randint(0, 5), "op": r.choice("UUID"), "source": word(), "segment": word(), "city": word(), "balance": r.choice([None, 2.5]), "home": "h", "mark": "m"} for i in range(n)]
    changes += [dict(c) for c in changes[:9]]
    changes += [{"change_id": 10**6 + i, "client_id": 10**6 + i, "seq": 1, "op": "I", "source": "new", "segment": "new", "city": None, "balance": 1.0, "home": "", "mark": ""} for i in range(extra)]
    same = {k: clients[10][k] for k in ("client_id", *merge_on_read.SETS)}
    changes.append({"change_id": -1, "seq": 99, "op": "U", "home": "", "mark": ""} | same)
    return clients, changes


@pytest.mark.parametrize(("n", "extra"), [(40, 0), (3100, 400)])
def test_upsert_gives_the_files_made_by_hand(spark, n, extra):
    clients, changes = shop(n, extra)
    frame = lambda rows, schema: spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rows], schema).repartition(3)
    got = sorted(merge_on_read.op12(frame(clients, CLIENT), frame(changes, CHANGE)).collect(), key=lambda x: x["first_id"])
    want = upserted(clients, changes)
    assert [x["rewritten"] for x in got] == [w for w, _ in want] and any(w for w, _ in want) and not all(w for w, _ in want)
    for x, (_, rows) in zip(got, want, strict=True):
        assert pq.ParquetFile(x["path"].removeprefix("file://")).read().to_pylist() == rows
        assert (x["first_id"], x["n_rows"], x["columns"]) == (rows[0]["client_id"], len(rows), ",".join(c.split()[0] for c in CLIENT.split(", ")))
        assert x["cents"] == sum(math.floor(100 * r["balance"] + 0.5) for r in rows if r["balance"] is not None)
        assert x["rows_crc"] == sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows)
        assert x["ids_sha256"] == hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest()
    folder = got[0]["path"].removeprefix("file://").split("/rewritten/")[0].split("/start/")[0]
    left = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    assert sorted(left) == sorted(x["path"].removeprefix("file://") for x in got)


def test_pending_changes_are_merged_when_reading(spark):
    rows = [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e"), (9, "f")]
    table = merge_on_read.create(spark.createDataFrame(rows, "k long, v string"), "k", 2)
    assert table.files().count() == 3
    changes = spark.createDataFrame([(0, 1, "U", "new"), (1, 2, "D", None), (1, 3, "U", "both"), (0, 3, "U", "older"), (0, 7, "U", "seven"), (0, 9, "U", "f"), (5, None, "U", "nobody")], "seq long, k long, op string, v string")
    merge_on_read.stage(table, changes, ["seq"], ("v",), lambda home: F.lit(False), lambda home: F.col("change.op") == "D")
    want = [(None, "e"), (1, "new"), (3, "both"), (3, "both"), (7, "seven"), (9, "f")]
    assert sorted((tuple(x["row"]) for x in table.merged().collect()), key=str) == sorted(want, key=str)
    assert table.staged("delete").count() == 1 and table.staged("update").count() == 3
    merge_on_read.compact(table)
    assert sorted((tuple(x["row"]) for x in merge_on_read.final_rows(table).collect()), key=str) == sorted(want, key=str)
    assert not os.path.exists(table.folder + "/staging")


def test_upsert_of_empty_tables(spark):
    none = spark.createDataFrame([], CLIENT)
    change = spark.createDataFrame([(1, 2, 3, "U", "a", "b", "c", 1.0, "", "")], CHANGE)
    assert merge_on_read.op12(none, change).count() == 0
    clients, _ = shop(30)
    frame = spark.createDataFrame([tuple(x.values()) for x in clients], CLIENT)
    got = merge_on_read.op12(frame, spark.createDataFrame([], CHANGE)).collect()
    assert len(got) == len(upserted(clients, [])) and not any(x["rewritten"] for x in got)


# vector codes


def codes_by_hand(rows: list) -> tuple[list, str]:
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, [math.floor(1024 * y) for y in x[1]]))
    at = vector_codes.cuts(len(kept[0][1]))
    whole = [[math.floor(1024 * y) for y in v] for _, v, _ in kept]
    books = [[v[at[p] : at[p + 1]] for v in whole[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min((far(v[at[p] : at[p + 1]], e), i) for i, e in enumerate(books[p]))
    for _ in range(4):
        new = []
        for p in range(4):
            own: dict = {}
            for v in whole:
                own.setdefault(nearest(p, v)[1], []).append(v[at[p] : at[p + 1]])
            new.append([[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])])
        books = new
    out = [(i, label, [nearest(p, v) for p in range(4)]) for (i, _, label), v in zip(kept, whole, strict=True)]
    total: dict = {}
    for _, label, best in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in best)
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), total[label]) for i, label, best in out], hashlib.sha256(numbers.encode()).hexdigest()


@pytest.mark.parametrize(("n", "size"), [(20, 8), (330, 7)])
def test_vector_codes_by_hand(spark, n, size):
    r = random.Random(n)
    rows = [(i if i % 40 else None, [r.choice([-0.5, 0.25, 0.001, r.random()]) for _ in range(size)], r.choice([None, 1, 1, 1, i])) for i in range(n)]
    rows += [rows[3], rows[3], (1000, None, 1), (1001, [None] * size, 1), (1002, [float("nan")] * size, 1), (1003, [float("inf")] * size, None), (1004, [0.0] * size, 1004)]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label long, x string").repartition(4)
    got = vector_codes.op13(frame).collect()
    want, sha = codes_by_hand(rows)
    assert sorted(map(str, (tuple(x)[:4] for x in got))) == sorted(map(str, want)) and {x["codebooks_sha256"] for x in got} == {sha}


def test_vector_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label long"
    assert vector_codes.op13(spark.createDataFrame([], schema)).count() == 0
    got = {x["vec_id"]: tuple(x) for x in vector_codes.op13(spark.createDataFrame([(1, [0.5, 0.5], 1), (2, [0.5], 1), (3, [1e30, -1e30], 2)], schema)).collect()}
    assert got[1][1:3] == ("00000000", 0) and got[2][1:3] == (None, None) and got[3][2] == 0 and got[3][3] == 0


def test_trees_find_the_lowest_of_the_nearest():
    r = np.random.default_rng(0)
    for n, size, most in ((256, 16, 1024), (256, 3, 3), (9, 1, 2), (256, 16, 1 << 26), (1, 0, 1)):
        entries, queries = r.integers(-most, most, (n, size)), r.integers(-most, most, (700, size))
        index, far = vector_codes.KdTree(entries).nearest(queries)
        every = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
