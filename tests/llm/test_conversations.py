"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from llm.cases import LONG, rows_of
from sparkwarden.llm import coalescence, conversations

ROLE = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """(cost, audit, lines) over whole strings; ``rows``: role, text, must go, truncated."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    at = {"": (0, "", [])}

    def inserted(at):
        for _ in range(3):
            for state, (cost, audit, lines) in list(at.items()):
                for new in after[state].replace("s", ""):
                    way = (cost + 5, audit + "I", [*lines, ROLE[new] + ":"])
                    at[new] = min(at.get(new, way), way, key=lambda w: w[:2])
        return at

    for role, text, gone, cut in rows:
        new = {}

        def offer(state, way):
            new[state] = min(new.get(state, way), way, key=lambda w: w[:2])

        for state, (cost, audit, lines) in inserted(dict(at)).items():
            offer(state, (cost + 2, audit + "D", lines))
            if not gone:
                for to in after[state]:
                    if role[:1] == to:
                        offer(to, (cost + 5 * cut, audit + "K", [*lines, f"{role}:{text}"]))
                    if to in ROLE:
                        offer(to, (cost + 5 * cut + 1, audit + "R", [*lines, f"{ROLE[to]}:{text}"]))
        at = new
    ends = inserted(at)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda w: w[:2])


def brute(rows, damage=True):
    """The contract in plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        lot = zlib.crc32(name.encode()) % 20 if damage else 9
        kept = out.setdefault(conv, [])
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        kept.extend([(turn, role, text)] * (2 if lot == 3 else 1))
    result = []
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, judged, faults = set(), [], [0, 0, 0]
        for turn, role, text in kept:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            blank, again = not end, (role, text) in seen
            cut = not blank and not again and end[-1] not in ".!?"
            seen.add((role, text))
            faults = [faults[0] + blank, faults[1] + (again and not blank), faults[2] + cut]
            judged.append((role, text, blank or again, cut))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = brute_repair(judged)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result.append(((conv, gaps, *faults, illegal, cost, audit, digest), lines))
    return result


@pytest.mark.parametrize("seed", range(6))
def test_survivors_equal_all_edits(seed):
    source = random.Random(seed)
    for _ in range(400):
        rows = [
            (source.choice(["system", "user", "assistant", "tool", "s", ""]), f"t{i}", source.random() < 0.2, source.random() < 0.3)
            for i in range(source.randint(0, 14))
        ]
        rows = [(r, t, g, c and not g) for r, t, g, c in rows]
        survivors, audit = coalescence.Survivors(), ""
        for row in rows:
            survivors.step(*row)
            audit += survivors.taken()
        cost, digest = survivors.close()
        want = brute_repair(rows)
        assert (cost, audit + survivors.taken()) == want[:2]
        assert digest == hashlib.sha256("\n".join(want[2]).encode()).hexdigest()


def test_open_edits_stay_few():
    source = random.Random(1)
    survivors, most = coalescence.Survivors(), 0
    for i in range(30_000):
        role = source.choice(["system", "user", "assistant", "assistant", "user"])
        survivors.step(role, str(i), source.random() < 0.1, source.random() < 0.1)
        survivors.taken()
        most = max(most, survivors.held()[1])
    assert most < 200
    for _ in range(50_000):  # a tie that only what follows can break: two strings are open
        survivors.step("user", "", True, False)
        survivors.taken()
    nodes, letters = survivors.held()
    assert nodes <= 6 and letters <= 2 * 50_000 + 200


def cases():
    source = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(source.randint(1, 12)):
            text = source.choice(["Yes.", "No!", "cut off", " \t", "", None, "Wait? \n", f"text {turn}.", "ü😀"])
            role = source.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""])
            rows.append((conv, source.choice([turn, turn, turn, turn * 2, None, 3]), role, text))
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (-4, None, None, None)]
    rows += [(500, t, ("user", "assistant")[t % 2], f"{LONG[: 5000 + t]}.") for t in range(20)]
    rows += [(501, t, "user", f"same {t % 7}.") for t in range(3000)]  # long, with repeats everywhere
    rows += [rows[5], rows[5], (502, 0, "user", "dropped?")]
    rows += [(c, 0, "user", "all gone.") for c in range(600, 800)]
    return rows


def as_frame(spark, rows):
    extra = [(*row, "x", 1, 2) for row in rows]
    return spark.createDataFrame(
        extra, "conv_id long, turn long, role string, text string, digest string, kind int, first int"
    )


@pytest.mark.parametrize("damage", [True, False])
def test_repairs_equal_brute_force(spark, damage):
    rows = cases()
    want = brute(rows, damage)
    frame = as_frame(spark, rows)
    frame = conversations.damaged(frame) if damage else conversations.undamaged(frame)
    got = conversations.repairs(frame)
    assert rows_of(got) == sorted((w for w, _ in want), key=repr)
    lines = {}
    for conv, place, role, text in rows_of(conversations.repaired(frame)):
        lines.setdefault(conv, {})[place] = f"{role}:{text}"
    assert {c: [v[i] for i in range(len(v))] for c, v in lines.items()} == {w[0]: k for w, k in want if k}
    assert any(w[7] == "" and w[1:7] == (0,) * 6 for w, _ in want) or not damage
    assert conversations.repairs(conversations.damaged(as_frame(spark, rows).where("false"))).count() == 0
