import hashlib
import random
import re

from pyspark.sql import functions as F

from assayer.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, kind string, place long, digest string"


def plain(turns):
    """Every edit turn by turn, with no bound on how many audits are kept: the least (cost, audit) of each state after each prefix."""
    states = {"": (0, "")}  # state: what the last role is
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(to, state, found):
        if state not in to or found < to[state]:
            to[state] = found

    for role, fault in turns:
        start, after = dict(states), {}
        inserted = [(s, c, a) for s, (c, a) in start.items()]
        for _ in range(3):  # more insertions in a row lead to a state that was there before
            inserted += [(n, c + 3, a + "I") for s, c, a in inserted for n in follow[s] if n != "s"]
        for s, c, a in inserted:
            better(after, s, (c + 4, a + "D"))
            if fault in (0, 3):
                for n in follow[s]:
                    if n == role[:1]:
                        better(after, n, (c + fault, a + "K"))
                    elif n != "s":
                        better(after, n, (c + 3 + fault, a + "R"))
        states = after
    ends = {"": "", "a": "", "u": "I", "s": "II"}
    return min((c + 3 * len(ends[s]), a + ends[s]) for s, (c, a) in states.items())


def expected(rows):
    """The contract row by row, for conversations of one's own turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for r in mine:
            text = r[3].strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not text else 2 if r[2:4] in seen else 3 if text[-1] not in ".!?" else 0)
            seen.add(r[2:4])
        cost, audit = plain([(r[2], f) for r, f in zip(mine, faults, strict=True)])
        lines, at, want = [], iter(mine), "user"
        for e in audit:
            row = next(at) if e != "I" else None
            if e != "D":
                role = row[2] if e == "K" else want
                lines.append(f"{role}:{row[3] if row else ''}")
                want = "assistant" if role[0] == "u" else "user"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {r[1] for r in mine} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, partitions=None):
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)
    got = C.report(C.repair(df)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r[0]: tuple(r)[1:] for r in got}


def test_blocks_compose_to_the_least_audit():
    rng = random.Random(3)
    for _ in range(1500):
        letters = "".join(rng.choice("uaUAuadsSx") for _ in range(rng.randint(1, 9)))
        size = rng.randint(1, 4)
        blocks = [C.transfers(letters[i : i + size]) for i in range(0, len(letters), size)]
        cost, audit = C.solve(blocks)
        turns = [("x", 1) if x == "d" else (x.lower(), 3 if x.isupper() else 0) for x in letters]
        assert (cost, "".join(audit)) == plain(turns), letters


def test_a_long_conversation_is_repaired_by_many_tasks(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", "Why?", " \t ", "x" * 50 + "!"]
    rows = [(1, t // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(texts) + (str(t) + "." if rng.random() < 0.8 else ""), False) for t in range(3000)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.", rng.random() < 0.3) for c in range(2, 60) for t in range(6)]
    assert run(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "Null turn.", False),
        (1, None, "user", "Null turn.", False),
        (1, 1, "assistant", "Null turn.", False),
        (2, 5, "", "No role.", False),
        (2, 6, "tool", "Other role.", False),
        (3, 0, "user", "", False),
        (4, 0, "user", "gone", True),
        (5, 0, "system", "Only a system turn.", False),
        (6, 0, "user", "A long one. " * 200_000, False),
        (6, 1, "assistant", "ü ñ 日本 😀?", False),
        (7, 3, "user", "Again.", False),
        (7, 3, "user", "Again.", False),
        (7, 9, "user", "Again.", False),
        (None, 0, "user", "No id.", False),
        (8, None, "user", "Only null turns", False),
    ]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows * 40) == expected(rows * 40)


def test_damage_takes_nulls_and_repeats(spark):
    c = spark.createDataFrame([(None, None, None, None, 1), (1, 2, None, "A. b! c?", 1), (1, 2, None, "A. b! c?", 1)], "conv_id long, turn long, role string, text string, _k int")
    got = C.damage(c).collect()
    assert all(r.role and r.text is not None for r in got)
    assert C.damage(c.where("false")).count() == 0
    assert C.report(C.repair(C.damage(c.where("false")))).count() == 0
    grid = spark.range(400).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.lit("a.b").alias("text"))
    import zlib

    seen = {k: [] for k in range(400)}
    for r in C.damage(grid).collect():
        seen[r.conv_id].append((r.role, r.text, r.gone))
    for k, got in seen.items():
        h = zlib.crc32(f"{k}:1".encode()) % 20
        one = [("user" if h == 4 else "assistant", "" if h in (0, 1) else "ab" if h == 2 else "a.b", h == 0)]
        assert got == one * (2 if h == 3 else 1)
