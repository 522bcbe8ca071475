"""Structure repair against exhaustive search on short conversations, against one uncut graph on long ones, and against SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from quarry.llm import structure_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, n string, t int, sym string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def exhaustive(symbols, gaps=("", "u", "a", "ua", "au")):
    """Least (cost, audit) over every way to edit, with ``gaps`` to insert in a place."""
    best = None
    names = {0: "s", 1: "u", 2: "a", 3: "x"}
    choices = [["D"] if R.parts_of(s)[1] in (1, 2) else ["D", "K", "Ru", "Ra"] for s in symbols]
    for rows in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(symbols) + 1):
            cost, audit, roles = 0, "", ""
            for k, s in enumerate(symbols):
                cls, fault = R.parts_of(s)
                audit, roles, cost = audit + "I" * len(ins[k]), roles + ins[k], cost + 2 * len(ins[k])
                audit += rows[k][0]
                roles += "" if rows[k] == "D" else names[cls] if rows[k] == "K" else rows[k][1]
                cost += {"D": 3, "K": 0, "R": 2}[rows[k][0]] + (fault == 3 and rows[k] != "D")
            audit, roles, cost = audit + "I" * len(ins[-1]), roles + ins[-1], cost + 2 * len(ins[-1])
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def random_symbols(rng, n, faults=(0, 0, 0, 1, 2, 3)):
    return "".join(R.symbol(rng.choice((0, 1, 1, 2, 2, 3)), rng.choice(faults)) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2])
def test_exhaustive(n):
    kinds = [R.symbol(c, f) for c in range(4) for f in (0, 1, 3)]
    for symbols in itertools.product(kinds, repeat=n):
        assert R.cheapest([("".join(symbols), None)]) == exhaustive(symbols), symbols


def test_exhaustive_on_longer_ones():
    rng = random.Random(1)
    for n in [3] * 20 + [4] * 5:
        symbols = random_symbols(rng, n)
        assert R.cheapest([(symbols, None)]) == exhaustive(symbols, ("", "u", "a")), symbols


@pytest.mark.parametrize("size", [1, 2, 3, 7, 128])
def test_segments_give_what_the_whole_gives(size):
    rng = random.Random(size)
    for k in range(60):
        kinds = [(0, 0, 0, 1, 2, 3), (0,), (0, 3), (1, 2, 0)][k % 4]
        n = rng.randrange(size + 1, 3 * size + 20)
        symbols = random_symbols(rng, n, kinds)
        if k % 5 == 0:
            symbols = R.symbol(rng.randrange(4), 0) * n  # ties everywhere
        cuts = [(symbols[i:i + size], None) for i in range(0, n, size)]
        cost, audit = R.cheapest(cuts)
        assert (cost, audit) == R.cheapest([(symbols, None)])
        pieces = list(R.walk(cuts, audit))
        assert "".join(p for _, p in pieces) == audit
        roles = [{0: "system", 1: "user", 2: "assistant", 3: "tool"}[R.parts_of(s)[0]] for s in symbols]
        lines = [line for (entry, piece), i in zip(pieces, range(0, n, size))
                 for line in R.repaired_lines(entry, piece, symbols[i:i + size], roles[i:i + size], ["t"] * size)]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def twin(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(parts)
    out = R.structure_repair(frame)
    got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({R.oracle_sql()})").fetchall()
    assert got == sorted(want, key=repr)
    assert out.columns == COLUMNS
    return {r[0]: dict(zip(COLUMNS, r)) for r in got}


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " ", None, "What?\n", "a ", "\x1f.", "!" * 3, "Long. " * 20000, "\x00.", "yes.", "Ünder \U0001F600!"]
    roles = ["user", "assistant", "system", None, "tool", "", "User", "umpire", "sam"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(1, 9)):
            turn = rng.choice([None, 0, 1, 2, 3, 4, 5, 6, -2])
            rows += [(conv, turn, rng.choice(roles + roles[:2] * 4), rng.choice(texts))] * rng.choice([1, 1, 1, 3])
    found = twin(spark, rows)
    assert len(found) == 61 and len({r["audit"] for r in found.values()}) > 30


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"Row {t}.", f"Row {t}"]))
            for t in range(1200)]
    rows += [(7, None, "user", "same text.")] * 300 + [(c, t, "user", "Hello.") for c in range(8, 40) for t in range(3)]
    twin(spark, rows, 5)


def test_empty_table(spark):
    assert twin(spark, []) == {}


def test_all_rows_dropped(spark):
    from zlib import crc32
    turns = [t for t in range(400) if crc32(f"5:{t}".encode()) % 20 == 0]
    row = twin(spark, [(5, t, "user", "Hello.") for t in turns[:2]])[5]
    assert row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256().hexdigest() and row["gaps"] == 0
