import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest

from flowsieve.llm import conversations
from flowsieve.llm.conversations import Repair
from flowsieve.llm.queries import ORACLE_SQL, op12_conversation_repair
from tests.oracle import compare

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, step int"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def every_repair(rows, most_inserted):
    """Cheapest (cost, letters, roles) of all edit sequences with so many insertions at most in a place."""
    best = None
    gaps = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=n) for n in range(most_inserted + 1)))] * (len(rows) + 1)
    for choice in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["K", "u", "a", "D"] for _, f in rows]):
        for inserted in itertools.product(*gaps):
            cost, letters, roles = 0, "", ""
            for i, put in enumerate(inserted):
                cost, letters, roles = cost + 3 * len(put), letters + "I" * len(put), roles + "".join(put)
                if i < len(rows):
                    (initial, fault), c = rows[i], choice[i]
                    cost += {"K": 0, "D": 4}.get(c, 3) + (3 if fault == "truncated" and c != "D" else 0)
                    letters += c if c in "KD" else "R"
                    roles += {"K": initial, "D": ""}.get(c, c)
            if GOOD.match(roles) and (best is None or (cost, letters) < best[:2]):
                best = cost, letters, roles
    return best


def plain_repair(rows):
    """Least (cost, letters, roles) by state, with whole strings."""
    states = {"": (0, "", "")}
    after = lambda roles: roles[-1:] if roles[-1:] != "s" or len(roles) == 1 else "?"

    def offer(into, cost, letters, roles):
        if re.match(r"(s|s?(ua)*u?)\Z", roles):
            key = after(roles)
            if key not in into or (cost, letters) < into[key][:2]:
                into[key] = cost, letters, roles

    def inserted(states):
        for _ in range(3):
            for cost, letters, roles in list(states.values()):
                for r in "ua":
                    offer(states, cost + 3, letters + "I", roles + r)

    for initial, fault in rows:
        inserted(states)
        new = {}
        for cost, letters, roles in states.values():
            offer(new, cost + 4, letters + "D", roles)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                offer(new, cost + extra, letters + "K", roles + initial)
                for r in "ua":
                    offer(new, cost + 3 + extra, letters + "R", roles + r)
        states = new
    inserted(states)
    return min((v for v in states.values() if GOOD.match(v[2])), key=lambda v: v[:2])


def searched(rows):
    search, edits, waiting = Repair(), [], []
    for i, (initial, fault) in enumerate(rows):
        edits += search.row(initial, fault)
        waiting.append(i + 1 - sum(letter != "I" for letter, _ in edits))
    edits += search.end()
    cost = 0
    at = iter(rows)
    for letter, _ in edits:
        fault = next(at)[1] if letter != "I" else None
        cost += {"K": 0, "D": 4}.get(letter, 3) + (3 if fault == "truncated" and letter in "KR" else 0)
    return (cost, "".join(letter for letter, _ in edits)), waiting


FAULTS = (None, None, None, "truncated", "blank", "duplicate")


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_against_all_edits(n):
    rng = random.Random(n)
    cases = itertools.product(itertools.product("suax", (None, "truncated", "blank")), repeat=n) if n < 3 else [
        [(rng.choice("suax"), rng.choice(FAULTS)) for _ in range(3)] for _ in range(40)
    ]
    for rows in cases:
        assert searched(rows)[0] == every_repair(list(rows), 2)[:2]


def test_search_against_whole_strings():
    rng = random.Random(9)
    for _ in range(3000):
        rows = [(rng.choice("suuaaax"), rng.choice(FAULTS)) for _ in range(rng.randint(0, 25))]
        assert searched(rows)[0] == plain_repair(rows)[:2]
    for pattern in ("u", "uua", "a", "s", "uaa", "x"):
        rows = [(pattern[i % len(pattern)], None) for i in range(200)]
        assert searched(rows)[0] == plain_repair(rows)[:2]


def test_certain_edits_leave_memory():
    rows = [("u", None), ("a", None)] * 5_000
    assert max(searched(rows)[1]) < 10
    rng = random.Random(2)
    rows = [(r, rng.choice(FAULTS)) for _ in range(3_000) for r in "ua"]
    assert max(searched(rows)[1]) < 200


def brute(rows):
    """Contract columns from all rows ``(conv_id, turn, role, text)``."""
    out = []
    for conv in {r[0] for r in rows}:
        found = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            found += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in found:
            said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in found]
        cost, letters, _ = plain_repair([(i or "?", f) for i, f in zip(initials, faults)])
        lines, at, roles = [], iter(found), ""
        for letter in letters:
            turn, role, text = next(at) if letter != "I" else (None, None, "")
            if letter != "D":
                role = role if letter == "K" else "assistant" if roles[-1:] == "u" else "user"
                roles += role[0]
                lines.append(f"{role}:{text}")
        turns = {r[0] for r in found if r[0] is not None}
        out.append((
            repr(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters, sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out)


def actual(frame):
    rows = frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    return sorted((repr(r[0]), *r[1:]) for r in rows)


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    return op12_conversation_repair(spark, str(tmp_path))


def random_rows():
    rng = random.Random(5)
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.randint(1, 12) if conv is not None else 400):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "", None, "tool", "User"])
            text = rng.choice([f"Words {rng.randint(0, 3)}.", "No end", "", None, " \t\n", "Ends!  \n", "é?", "中文。"])
            rows.append((conv, rng.choice([turn, turn + 2, None, turn]), role, text))
    rows += rows[:40] + [(10**9, 2**62, "user", "Hi."), (10**9, -(2**62), "user", "Hi."), (10**9 + 1, 1, "user", "long words " * 40_000 + "!")]
    # A whole conversation that is dropped.
    rows += [(c, 0, "user", "Gone.") for c in range(2000, 2200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = random_rows()
    found, wanted = actual(written(spark, tmp_path, rows)), brute(rows)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        # A gap beyond 64 bits is null.
        assert a == b or (a[1] is None and b[1] > 2**63 - 1 and a[2:] == b[2:])


def test_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BATCH_ROWS", 2)
    rows = [(1, t, "user" if t % 3 else "assistant", f"Text {t}.") for t in range(500)]
    assert actual(written(spark, tmp_path, rows)) == brute(rows)


def test_edits_are_the_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Hi."), (1, 1, "user", "A?"), (1, 2, "user", "B?"), (1, 3, "assistant", "C.")], "conv_id int, turn int, role string, text string")
    edits = conversations.repair(rows).orderBy("step").collect()
    assert "".join(r.edit for r in edits) == "KKIKK"
    assert [(r.role, r.text) for r in edits] == [("system", "Hi."), ("user", "A?"), ("assistant", ""), ("user", "B?"), ("assistant", "C.")]


def test_empty_table(spark, tmp_path):
    assert actual(written(spark, tmp_path, [])) == []


def test_one_shuffle_of_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = conversations.repair(conversations.damage(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tables_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", op12_conversation_repair, ORACLE_SQL["op12_conversation_repair"]) is None
