"""Conversation repair against all cheapest edits, written down and compared as text."""

import hashlib
import random
import re
import zlib

import pytest

from storyspark.llm import conversation_repair as cr

DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def every_cheapest(rows):
    """``(cost, audit)`` of the least of the cheapest edits of ``(initial, must go, truncated)`` rows, by keeping all of them."""
    now = {"": {(0, "")}}

    def with_insertions(states):
        out = {s: set(p) for s, p in states.items()}
        for _ in range(3):
            for s, paths in [(s, set(p)) for s, p in out.items()]:
                out.setdefault(DUE[s], set()).update((c + 2, e + "I") for c, e in paths if not e.endswith("III"))
        return out

    for initial, goes, cut in rows:
        after = {}
        for s, paths in with_insertions(now).items():
            for c, e in paths:
                after.setdefault(s, set()).add((c + 3, e + "D"))
                if not goes:
                    after.setdefault(DUE[s], set()).add((c + 2 + cut, e + "R"))
                    if initial == DUE[s] or (initial == "s" and s == ""):
                        after.setdefault(initial, set()).add((c + cut, e + "K"))
        now = {s: {p for p in paths if p[0] == min(paths)[0]} for s, paths in after.items()}
    ends = with_insertions(now)
    return min(p for s in ("", "a") for p in ends.get(s, ()))


def plain(conversations):
    """The whole answer for ``{conv_id: rows}`` with rows of ``(turn, role, text)``."""
    out = {}
    for conv_id, rows in conversations.items():
        rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, found, counts, illegal = set(), [], dict(blank=0, duplicate=0, truncated=0), 0
        for k, (_, role, text) in enumerate(rows):
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            found.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            illegal += k > 0 and found[k - 1][0] + role[:1] not in ("su", "ua", "au")
        cost, audit = every_cheapest(found)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        repaired, state, queue = [], "", list(rows)
        for edit in audit:
            _, role, text = queue.pop(0) if edit != "I" else (None, None, "")
            if edit == "D":
                continue
            state = role[:1] if edit == "K" else DUE[state]
            repaired.append((role if edit == "K" else {"u": "user", "a": "assistant"}[state], text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
        out[conv_id] = (len(rows), gaps, *counts.values(), illegal, cost, audit, repaired)
    return out


@pytest.fixture
def rows_of(spark):
    def make(conversations):
        rows = [(c, t, r, x, "x", 1) for c, listed in conversations.items() for t, r, x in listed]
        random.Random(1).shuffle(rows)
        return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, fault string, position int")

    return make


def got(rows, n=None):
    found = {r.conv_id: tuple(r)[1:] for r in cr.repair(rows, n).collect()}
    repairs = cr.repair(rows, n)
    made = {}
    for r in cr.apply_audits(rows, repairs).collect():
        made.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    hashed = {r.conv_id: r.repaired_sha256 for r in cr.digests(cr.apply_audits(rows, repairs)).collect()}
    for c, listed in made.items():
        assert [p for p, _, _ in listed] == list(range(len(listed)))
        assert hashed[c] == hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in listed).encode()).hexdigest()
    return {c: (*found[c], [(r, x) for _, r, x in made.get(c, [])]) for c in found}


def random_conversation(rng, size):
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, ""]
    texts = ["Yes.", "No!", "cut off", " ", "", None, "What?  \n", "again."]
    own = lambda: rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice(['.', '', '!'])}"
    return [(rng.choice([None, *range(size + 2)]) if rng.random() < 0.3 else k, rng.choice(roles), own()) for k in range(size)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_random_conversations(rows_of, ranges):
    rng = random.Random(ranges)
    conversations = {k: random_conversation(rng, rng.randrange(1, 9)) for k in range(60)}
    conversations[None] = random_conversation(rng, 6)
    assert got(rows_of(conversations), ranges) == plain(conversations)


def test_one_conversation_over_many_ranges(rows_of):
    rng = random.Random(11)
    conversations = {1: random_conversation(rng, 30), 2: [(0, "user", "Hi."), (1, "assistant", "Yes.")], 3: [(k, "user", f"{k}.") for k in range(30)]}
    assert got(rows_of(conversations), 9) == plain(conversations)


def test_repeated_rows_and_faults(rows_of):
    conversations = {
        1: [(0, "user", "Hi.")] * 5 + [(1, "assistant", "Yes.")],
        2: [(0, "user", " ")] * 3,
        3: [(None, "system", "S."), (0, "user", "Q?"), (3, "assistant", "A")],
        4: [(0, "user", "Q?"), (1, "user", "Q?"), (2, "assistant", "A.")],
        5: [(2**62, "user", "a" * 300_000 + "."), (-(2**61), "assistant", "B.")],
    }
    result = got(rows_of(conversations))
    assert result == plain(conversations)
    assert result[1][2:8] == (0, 4, 0, 4, 12, "KDDDDK") and result[2][7] == "DDD" and result[3][1] == 2


def test_empty_table(rows_of):
    rows = rows_of({1: [(0, "user", "Hi.")]}).filter("conv_id > 1")
    assert got(rows) == {}


def test_steps_are_settled_as_survivors_meet():
    search = cr.Search()
    for k in range(3000):
        search.push(cr.STEPS["ua"[k % 2], cr.FINE])
        assert search.unresolved() <= 3
    assert cr.ended(search.paths()) == (0, "K" * 3000)


def test_damage(rows_of):
    conversations = {c: [(t, "assistant", "A. b! c?") for t in range(30)] for c in range(4)}
    want = {0: [], 1: [("assistant", "")], 2: [("assistant", "A b c")], 3: [("assistant", "A. b! c?")] * 2, 4: [("user", "A. b! c?")]}
    found = {}
    for r in cr.damage(rows_of(conversations)).collect():
        found.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c in conversations:
        for t in range(30):
            assert found.get((c, t), []) == want.get(zlib.crc32(f"{c}:{t}".encode()) % 20, [("assistant", "A. b! c?")])
