"""Repaired conversations against all edits."""

import hashlib
import random
import sys
import zlib
from functools import cache

import pytest

from mnemoria.llm import queries
from mnemoria.llm import repair as R

BLANKS = " \t\n\v\f\r"
sys.setrecursionlimit(20_000)


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 1:
            x = ""
        if h == 2:
            x = "".join(a for a in x if a not in ".!?")
        if h == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def best(kinds):
    """(cost, letters) by trying all edits; kinds: (role initial, must go, late)."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(i, said, inserted):
        options = [(0, "")] if i == len(kinds) and said in ("", "a") else []
        more = lambda cost, letter, j, s, n=0: [(cost + c, letter + x) for c, x in [rest(j, s, n)] if c < 1e9]
        if inserted < 3:
            options += [o for s in "ua" if s in allowed[said] for o in more(2, "I", i, s, inserted + 1)]
        if i < len(kinds):
            role, gone, late = kinds[i]
            options += more(3, "D", i + 1, said)
            if not gone:
                options += more(late, "K", i + 1, role) if role and role in allowed[said] else []
                options += [o for s in "ua" if s in allowed[said] for o in more(2 + late, "R", i + 1, s)]
        return min(options, default=(1e9, ""))

    return rest(0, "", 0)


def brute(rows, damage=True):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in (damaged(rows) if damage else rows) if r[0] == conv]
        mine = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in mine]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, faults = set(), [], []
        for _, r, x in mine:
            s = x.strip(BLANKS)
            f = "blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(f)
            kinds.append((r[:1] if r[:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), int(f == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = best(tuple(kinds))
        lines, i = [], 0
        size = sum(e != "D" for e in audit)
        roles = (["system"] if size % 2 else []) + ["user", "assistant"] * (size // 2)
        for e in audit:
            if e == "D":
                i += 1
                continue
            role = roles.pop(0)
            lines.append(f"{mine[i][1] if e == 'K' else role}:{'' if e == 'I' else mine[i][2]}")
            i += e != "I"
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, convs, most=9):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for k in range(rng.randint(1, most)):
            t = rng.choice([k, k, k, k, k + 2, 0, None])
            r = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"] if rng.random() < 0.4 else [["user", "assistant"][k % 2]])
            x = rng.choice(["One.", "Two!", "three", "What?  \n", " \t", "", None, "a. b", "é。", f"Turn {k}.", f"Turn {k} of {c}."])
            rows.append((c, t, r, x))
    return rows


COLUMNS = ["conv_id", "gaps", *R.COUNTS, "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, cost int, edits string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("piece", [4096, 4])
def test_equals_all_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    rows = corpus(piece, 250)
    got = R.digests(R.repair(frame(spark, rows))).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, damage=False)


def test_hot_conversation(spark, monkeypatch):
    """One conversation has nearly all rows and passes several partitions, with and without turn numbers."""
    monkeypatch.setattr(R, "PIECE", 16)
    rng = random.Random(5)
    say = lambda i: rng.choice([f"Line {rng.randint(0, 150)}.", "same", f"open {i}", "", "Yes!"])
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), say(i)) for i in range(400)]
    rows += [(8, None, rng.choice(["user", "assistant"]), say(i)) for i in range(300)] + corpus(3, 20)
    found = R.repair(frame(spark, rows))
    assert sorted(map(tuple, R.digests(found).select(*COLUMNS).collect()), key=str) == brute(rows, damage=False)
    assert max(r["pieces"] for r in found.select("pieces").collect()) > 10


def test_long_texts_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(R, "BYTES", 1000)
    rows = [("a", 0, "user", "x" * 300_000 + "."), ("a", 1, "assistant", "y" * 200_000), ("", 0, "u" * 500, "Hi."), ("", 0, "u" * 499 + "v", "He."), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(map(tuple, R.digests(R.repair(df)).select(*COLUMNS).collect()), key=str) == brute(rows, damage=False)


def test_query(spark, tmp_path):
    rows = corpus(11, 300, 6)
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_structure_repair(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert any(r[-2] == "" for r in brute(rows))


def test_empty(spark):
    df = frame(spark, [], 1)
    assert R.digests(R.repair(df)).collect() == []


def test_checkpoints_and_matrices():
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 257):
        codes = bytes(rng.choice([1, 2, 3, 0, 6, 10, 11]) for _ in range(n))
        half = n // 2
        end = R.through(R.matrix(codes[half:]), R.END)
        for q in range(4):
            letters, to, cost = R.walk(codes, [q], R.END)[0]
            (a, mid, c1), = R.walk(codes[:half], [q], end)
            (b, last, c2), = R.walk(codes[half:], [mid], R.END)
            assert (letters, to, cost) == (a + b, last, c1 + c2)
            m = R.matrix(codes)
            assert cost + R.END[to] == min(m[4 * q + t] + R.END[t] for t in range(4))
