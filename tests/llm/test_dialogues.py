import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from lodforge.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, n_chars long, part long, parts int, place long"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_audit(rows):
    """(cost, audit, messages) by trying every edit sequence with at most two insertions between rows, cheapest and ASCII-least first."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, edits, strict=False)) + "I" * gaps[-1]
            cost, messages, legal, at = 0, [], True, 0
            for edit in audit:
                turn = "assistant" if messages and messages[-1][0][:1] == "u" else "user"
                if edit == "I":
                    cost, _ = cost + 5, messages.append((turn, ""))
                    continue
                role, text, forced, cut = rows[at]
                at += 1
                legal &= not forced or edit == "D"
                cost += {"K": 0, "R": 1, "D": 2}[edit] + 5 * (cut and edit != "D")
                if edit != "D":
                    messages.append((turn if edit == "R" else role, text))
            if legal and LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in messages)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, messages)
    return best


def program(rows):
    """The same by dynamic programming over rows and roles, for longer conversations."""
    step = lambda s, i: {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(i)
    turn = lambda s: 3 if s == 2 else 2
    say = lambda s: "assistant" if s == 3 else "user"

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s, (c, a, m) in list(out.items()):
                now = (c + 5, a + "I", [*m, (say(turn(s)), "")])
                if turn(s) not in out or now[:2] < out[turn(s)][:2]:
                    out[turn(s)] = now
        return out

    best = {0: (0, "", [])}
    for role, text, forced, cut in rows:
        after = {}
        for s, (c, a, m) in inserted(best).items():
            options = [(s, c + 2, a + "D", m)]
            if not forced:
                options.append((turn(s), c + 1 + 5 * cut, a + "R", [*m, (say(turn(s)), text)]))
                if (k := step(s, role[:1])) is not None:
                    options.append((k, c + 5 * cut, a + "K", [*m, (role, text)]))
            for k, *found in options:
                if k not in after or tuple(found[:2]) < after[k][:2]:
                    after[k] = tuple(found)
        best = after
    return min((b for s, b in inserted(best).items() if s in (0, 3)), key=lambda b: b[:2])


def expected(table):
    """Every result row of the contract for rows (conv_id, turn, role, text), by plain loops."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, messages = program(judged)
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def got(spark, table):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in table], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in dialogues.digests(dialogues.repair(dialogues.damage(frame))).collect()), key=repr)


def steps_of(rows):
    return [(None, 0, 1) if forced else (role[:1], 5 * cut, 1) for role, _, forced, cut in rows]


def some_rows(random, n):
    return [(str(random.choice(["system", "user", "assistant", "tool", ""])), f"t{k}", bool(random.random() < 0.15), bool(random.random() < 0.2)) for k in range(n)]


def test_search_equals_all_edit_sequences():
    random = np.random.default_rng(0)
    for k in range(60):
        rows = some_rows(random, k % 5)
        cost, audit, messages = brute_audit(rows)
        assert dialogues.search(steps_of(rows)) == (cost, audit) == program(rows)[:2]
        assert [(m["role"], m["text"]) for m in dialogues.apply_audit([(r, t, 1) for r, t, _, _ in rows], audit)] == messages


def test_search_equals_dynamic_programming_on_long_conversations():
    random = np.random.default_rng(1)
    for n in (20, 60, 200, 256):
        rows = some_rows(random, n)
        assert dialogues.search(steps_of(rows)) == program(rows)[:2]
    alternate = [(("user", "assistant")[k % 2 if random.random() < 0.8 else random.integers(2)], str(k), bool(random.random() < 0.1), bool(random.random() < 0.1)) for k in range(400)]
    assert dialogues.search(steps_of(alternate)) == program(alternate)[:2]  # few faults far apart leave most room between bound and cost
    assert dialogues.search(steps_of([("user", str(k), False, True) for k in range(256)])) == program([("user", str(k), False, True) for k in range(256)])[:2]


def made():
    random = np.random.default_rng(2)
    texts = ["Yes.", "No!", "cut off", " \n", "", None, "What?", "End.  \n", "Ünï. x"]
    out = [(int(c), int(t), str(random.choice(["system", "user", "assistant"])), str(random.choice(["Yes.", "No!", f"text {c} {t}.", f"open {c} {t}", ""]))) for c in range(120) for t in range(c % 9)]
    out += [(500, t if t % 3 else None, r, x) for t, (r, x) in enumerate(itertools.product(["user", "assistant", None, "tool", ""], texts))]  # nulls and ties
    out += [(501, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Hello."), (None, None, "user", "Hi."), (600, 1, "user", "x" * 30000 + ".")]
    out += [(502, 1, "user", "Same."), (502, 1, "user", "Same."), (502, 1, "user", "Same"), (503, None, "user", "A."), (503, None, "assistant", "B.")]
    return out + out[40:44]


def test_matches_plain_loops(spark):
    assert got(spark, made()) == expected(made())
    assert got(spark, []) == []


@pytest.mark.parametrize("block", [1, 3, 7])
def test_blocks_give_the_same(spark, block, monkeypatch):
    monkeypatch.setattr(dialogues, "BLOCK", block)
    monkeypatch.setattr(dialogues, "RUN", 2 * block)
    assert got(spark, made()) == expected(made())


def test_a_conversation_with_most_rows(spark):
    random = np.random.default_rng(3)
    table = [(9, int(t), str(random.choice(["user", "assistant", "user", "system"])), str(random.choice(["Again.", f"text {t}.", f"open {t}"]))) for t in range(1500)]
    table += [(9, 77, "user", "Same row.")] * 400 + [(c, t, "user", "One.") for c in range(5) for t in range(2)]
    assert got(spark, table) == expected(table)
