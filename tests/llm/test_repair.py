import functools
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mentionlab.llm import repair
from mentionlab.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(kind, text)
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows, ids):
    """Each conversation for itself, from its end: the best edits of what is left, for each last role."""
    out = []
    for c in ids:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        starts = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))

        @functools.cache
        def rest(i, last, inserted, own=own, faults=faults):
            """(cost, label, rows) of rows i and on after a last role initial ('' at the start)."""
            best = [(0, "", ())] if i == len(own) and last in ("", "a") else []
            goes = lambda x: (last == "" and x in "su") or last + x in ("su", "ua", "au")
            if inserted < 3:
                for x, name in (("u", "user"), ("a", "assistant")):
                    if goes(x):
                        n = rest(i, x, inserted + 1)
                        best += [(n[0] + 5, "I" + n[1], (name + ":", *n[2]))] if n else []
            if i < len(own):
                _, role, text = own[i]
                n = rest(i + 1, last, 0)
                best += [(n[0] + 2, "D" + n[1], n[2])] if n else []
                if faults[i] not in ("b", "d"):
                    more = 5 if faults[i] == "t" else 0
                    if role[:1] in ("s", "u", "a") and goes(role[:1]) and (n := rest(i + 1, role[:1], 0)):
                        best.append((n[0] + more, "K" + n[1], (f"{role}:{text}", *n[2])))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if goes(x) and (n := rest(i + 1, x, 0)):
                            best.append((n[0] + more + 1, "R" + n[1], (f"{name}:{text}", *n[2])))
            return min(best) if best else None

        for i in range(len(own), 0, -1):  # from the end, so that no call goes deep
            for last in ("", "s", "u", "a"):
                rest(i, last, 0)
        cost, label, kept = rest(0, "", 0)
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, label, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_rows(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", " \n", "", None, "Why? ", "é!\t", "a. b", "x" * 50_000 + "."]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "User", "", None, "u", "sys"]
    rows = []
    for c in [*range(40), None]:
        tidy = rnd.random() < 0.5
        for t in range(rnd.randrange(14)):
            role = ("user", "assistant")[t % 2] if tidy and rnd.random() < 0.8 else rnd.choice(roles)
            rows.append((c, rnd.choice([t, t, t, t, t + 3, None]), role, f"{rnd.random()}." if rnd.random() < 0.6 else rnd.choice(texts)))
    return rows + rows[:6]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1024), (2, 1), (3, 3)])
def test_equals_brute_force(spark, seed, chunk):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(repair.Repair(df, chunk=chunk).summary) == plain(rows, {r[0] for r in rows})


def test_whole_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = random_rows(7)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = got(repair.op11_repair(spark, str(tmp_path)))
    assert found == plain(damage(rows), {r[0] for r in rows})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({repair.OP11_SQL})").fetchall(), key=str) == found


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op11_repair(spark, sf)) == plain(damage(rows), {r[0] for r in rows})


def test_a_conversation_that_holds_most_rows(spark):
    rnd = random.Random(3)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"{t}.", f"{t}.", "same.", "cut"])) for t in range(600)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    fixed = repair.Repair(df, chunk=50)
    assert fixed.rows.select("chunk").distinct().count() > 10
    assert got(fixed.summary) == plain(rows, {1, 2})


def test_repaired_rows_and_odd_tables(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "tool", "T."), (1, 3, "tool", "T.")], SCHEMA).withColumn("k", F.lit("x")).withColumn("label", F.lit(1)).withColumn("chunk", F.lit(1))
    fixed = repair.Repair(df)
    assert [tuple(r)[2:] for r in fixed.repaired.orderBy("position").collect()] == [("K", 0, "system", "S."), ("R", 1, "user", "A."), ("R", 2, "assistant", "T.")]
    assert [(r.cost, r.audit) for r in fixed.summary.collect()] == [(4, "KRRD")]
    none = repair.Repair(df.limit(0))
    assert none.summary.count() == 0 and none.repaired.count() == 0
