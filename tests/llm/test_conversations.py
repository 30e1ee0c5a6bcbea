from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from siftspark.llm import conversation_repair as repair
from siftspark.llm.queries import op11_conversation_repair

SPACES = " \t\n\x0b\x0c\r"


def exhaustive(initials, faults):
    """Cost and least edits by relaxing all (row, state) with whole strings."""
    n = len(initials)
    best = {(0, ""): (0, "", "")}  # by row and the last output's initial
    todo = [(0, "")]
    while todo:
        i, last = key = todo.pop(0)
        cost, path, out = best[key]
        nexts = []
        if i < n:
            nexts.append(("D", 4, i + 1, last, out))
            if faults[i] not in "bd":
                more = 3 if faults[i] == "t" else 0
                nexts.append(("K", more, i + 1, initials[i] or "?", out + (initials[i] or "?")))
                nexts += [("R", 3 + more, i + 1, x, out + x) for x in "ua"]
        nexts += [("I", 3, i, x, out + x) for x in "ua"]
        for letter, c, j, after, whole in nexts:
            if after != last or letter != "D":
                if not re.fullmatch(r"s?(ua)*u?", whole):
                    continue
            new = (cost + c, path + letter, whole)
            if (j, after) not in best or new[:2] < best[j, after][:2]:
                best[j, after] = new
                todo.append((j, after))
    return min(best[k][:2] for k in best if k[0] == n and k[1] in ("", "a"))


def test_search_is_exhaustive():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("bt-", repeat=n):
                assert repair.cheapest_edits(list(initials), "".join(faults)) == exhaustive(initials, faults), (initials, faults)
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(4, 12)
        initials, faults = [rng.choice("suuaax") for _ in range(n)], "".join(rng.choice("bdt---") for _ in range(n))
        assert repair.cheapest_edits(initials, faults) == exhaustive(initials, faults), (initials, faults)


def test_long_conversations_are_searched_in_time():
    rng = random.Random(4)
    n = 3000
    initials, faults = [rng.choice("ua") for _ in range(n)], "".join(rng.choice("bdt---------") for _ in range(n))
    cost, edits = repair.cheapest_edits(initials, faults)
    assert len(edits) - edits.count("I") == n and cost >= repair.least_costs(initials, faults)[0]


def brute(rows):
    """The query's rows from conversations' rows, with plain Python."""
    out = []
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            by = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
            left += [(turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = "", set()
        for _, role, text in left:
            bare = text.rstrip(SPACES)
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        ini = [r[1][:1] for r in left]
        cost, edits = exhaustive(ini, faults)
        lines, i = [], 0
        for e in edits:
            said = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            if e == "K":
                lines.append((left[i][1], left[i][2]))
            elif e == "R":
                lines.append((said, left[i][2]))
            elif e == "I":
                lines.append((said, ""))
            i += e != "I"
        turns = {r[0] for r in left if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:], strict=False))
        whole = "\n".join(f"{a}:{b}" for a, b in lines)
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, edits, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0))


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", "", None]])
        for t in range(rng.randrange(0, 9)):
            text = rng.choice(["A sentence.", "Another one!", "Is it?", "cut off", "", " \t", None, "é. ", "A sentence. \n"])
            out.append((c if c else None, rng.choice([t, t, t, t + 3, 0, None]), rng.choice(roles), text))
    return out


def write(spark, tmp_path, rows):
    schema = "conv_id long, turn long, role string, text string, audit string, _kind int, position int"
    spark.createDataFrame([(*r, "x", 0, 1) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_is_brute_force(spark, tmp_path, seed):
    rows = conversations(seed, 60)
    got = op11_conversation_repair(spark, write(spark, tmp_path, rows))
    assert rows_of(got) == brute(rows)


def test_given_table_long_texts_and_no_rows(spark, sf_dir, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_conversation_repair(spark, sf_dir)) == brute(given)
    assert op11_conversation_repair(spark, write(spark, tmp_path / "none", [])).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    rows = [(5, dropped, "user", "Gone."), (6, kept, "user", "x" * 200_000 + "."), (6, kept, "user", "y" * 200_000)]
    got = rows_of(op11_conversation_repair(spark, write(spark, tmp_path / "few", rows)))
    assert got == brute(rows)
    assert got[0] == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "Late."), (1, 0, "system", "Rules."), (1, 2, "user", "Why?"), (1, 2, "user", "Why?"), (1, 4, "user", "And then?")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    audits = repair.audit_conversations(df)
    got = [tuple(r) for r in repair.repair_conversations(df, audits).orderBy("position").collect()]
    assert [r.audit for r in audits.collect()] == ["KIKKDR"]
    said = [(r[3], r[4], r[5]) for r in got]
    assert said == [("system", "Rules.", "K"), ("user", "", "I"), ("assistant", "Late.", "K"), ("user", "Why?", "K"), ("assistant", "And then?", "R")]
    assert [r[1] for r in got] == list(range(5)) and {r[0] for r in got} == {1}
