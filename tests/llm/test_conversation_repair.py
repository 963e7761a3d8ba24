import hashlib
import random
import re
import zlib

import pytest

from sluice.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, run long, ways int"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def all_repairs(initials, faults):
    """Every edit sequence with few enough insertions, whatever the roles: (cost, audit, repaired initials)."""
    most = 2 * len(initials) // 5

    def go(i, inserts, cost, audit, out):
        if i == len(initials):
            yield cost, audit, out
        else:
            yield from go(i + 1, inserts, cost + 2, audit + "D", out)
            if faults[i] not in "bd":
                more = 5 if faults[i] == "t" else 0
                yield from go(i + 1, inserts, cost + more, audit + "K", out + (initials[i] or "?"))
                for role in "ua":
                    yield from go(i + 1, inserts, cost + 1 + more, audit + "R", out + role)
        if inserts < most:
            for role in "ua":
                yield from go(i, inserts + 1, cost + 5, audit + "I", out + role)

    return go(0, 0, 0, "", "")


def cheapest(initials, faults):
    return min((cost, audit) for cost, audit, out in all_repairs(initials, faults) if re.fullmatch("(s?(ua)+)?", out))


def expected(rows):
    """The contract's result by plain loops; the cheapest repair by :func:`c.repair`, tested on its own."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        case = zlib.crc32(":".join(shown).encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = "", set()
        for _, role, text in held:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            faults += "b" if BLANK.fullmatch(text) else "d" if (role, text) in seen else "t" if last not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in held]
        cost, audit = c.repair(initials, faults) if held else (0, "")
        *_, roles, texts = c.replay([r for _, r, _ in held], [t for _, _, t in held], faults, audit)
        turns = {t for t, _, _ in held if t is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest())
    return out


def made(rnd, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "sys", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "cut off", "", " \t", None, "Why? \n", "é.", f"{rnd.random()}."])
            rows.append((conv if conv else None, rnd.choice([turn] * 8 + [turn + 50, None]), role, text, 1, 1))
    return rows


@pytest.mark.parametrize("seed", range(60))
def test_the_cheapest_of_all_edit_sequences(seed):
    rnd = random.Random(seed)
    initials = [rnd.choice(["s", "u", "a", "u", "a", "t", ""]) for _ in range(rnd.randint(0, 6))]
    faults = "".join(rnd.choice("---bdt") for _ in initials)
    cost, audit = c.repair(initials, faults)
    assert (cost, audit) == cheapest(initials, faults)
    roles = [{"s": "system", "u": "user", "a": "assistant"}.get(i, i) for i in initials]
    found = c.replay(roles, ["x"] * len(roles), faults, audit)
    assert found[0] == cost and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r in found[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_put_together_give_the_whole(seed):
    rnd = random.Random(seed)
    initials = [rnd.choice("suaauut") for _ in range(rnd.randint(2, 40))]
    faults = "".join(rnd.choice("----bdtt") for _ in initials)
    cuts = sorted(rnd.sample(range(1, len(initials)), min(3, len(initials) - 1)))
    parts = [slice(a, b) for a, b in zip([0, *cuts], [*cuts, None])]
    audits = c.join_ways([c.ways(initials[s], faults[s]) for s in parts])
    assert "".join(audits) == c.repair(initials, faults)[1]


def check(spark, rows, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
    got = {r[0]: tuple(r)[1:] for r in c.op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_query_on_odd_conversations(spark, rnd, tmp_path):
    rows = made(rnd, 120, 9) + [(7, 3, "user", "x" * 200_000, 1, 1), (500, None, None, None, 1, 1)]
    check(spark, rows + rows[:20], tmp_path)


def test_long_conversations_over_many_runs_and_tasks(spark, rnd, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "RUN", 7)
    rows = made(rnd, 6, 150) + [(1, 1000 + k, rnd.choice(["user", "assistant"]), "Same.", 1, 1) for k in range(300)]
    check(spark, rows, tmp_path)


def test_conversations_that_lose_all_rows_and_no_rows(spark, tmp_path):
    lost = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    check(spark, [(lost, 0, "user", "Hi.", 1, 1)], tmp_path)
    row = c.op13_conversation_repair(spark, str(tmp_path)).first()
    assert row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and row["cost"] == 0
    check(spark, [], tmp_path)
