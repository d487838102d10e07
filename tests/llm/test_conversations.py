import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry_mod
from dyadic.llm import conversation_repair as cr
from dyadic.llm.common import read

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        if h:
            out[conv] += [(turn, "user" if h == 4 else role,
                           "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """The same program with whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen
                      else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    best = {(0, ""): (0, "", ())}  # rows read and output initials' last -> cost, audit, output
    step = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    for i in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for (j, state), (cost, audit, out) in list(best.items()):
                if j == i:
                    for x, role in (("u", "user"), ("a", "assistant")):
                        new = (cost + 2, audit + "I", out + ((role, ""),))
                        if (state, x) in step and new[:2] < best.get((i, x), (9 ** 9, ""))[:2]:
                            best[i, x], changed = new, True
        if i < len(rows):
            for (j, state), (cost, audit, out) in list(best.items()):
                if j != i:
                    continue
                offers = [(state, (cost + 3, audit + "D", out))]
                if faults[i] not in ("blank", "duplicate"):
                    late = faults[i] == "truncated"
                    if (state, initials[i]) in step:
                        offers.append((initials[i], (cost + late, audit + "K", out + ((rows[i][1], rows[i][2]),))))
                    for x, role in (("u", "user"), ("a", "assistant")):
                        if (state, x) in step:
                            offers.append((x, (cost + late + 2, audit + "R", out + ((role, rows[i][2]),))))
                for s, new in offers:
                    if new[:2] < best.get((i + 1, s), (9 ** 9, ""))[:2]:
                        best[i + 1, s] = new
    n = len(rows)
    cost, audit, out = min(best[n, s] for s in ("", "a") if (n, s) in best)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    said = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(said.encode()).hexdigest()), out


def enumerated(rows):
    """The cheapest audit among all edit strings with at most two inserts in a place."""
    found = []
    inserts = ["", "I", "II"]
    for edits in itertools.product(*[["".join(p) for p in itertools.product(inserts, "DKR")]] * len(rows), inserts):
        audit, cost, state, out, k = "".join(edits), 0, "", "", 0
        for e in audit:
            x = "a" if state == "u" else "u"
            if e == "I":
                cost += 2
            else:
                initial, fault = rows[k]
                k += 1
                cost += 3 if e == "D" else (fault == "truncated") + 2 * (e == "R")
                if e == "D":
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 9 ** 9
                x = initial if e == "K" else x
            out, state = out + x, x
        if re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
    return min(found)


def test_audits_against_enumeration():
    rnd = random.Random(1)
    for _ in range(60):
        rows = [(rnd.choice("suaux"), rnd.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rnd.randrange(4))]
        assert cr.cheapest(cr.piece_audits(rows)) == enumerated(rows)


def test_audit_nodes_compare_as_strings(monkeypatch):
    rnd = random.Random(2)
    for modulus in (cr.Audits.MODULUS, 7):  # with 7, hashes collide all the time
        monkeypatch.setattr(cr.Audits, "MODULUS", modulus)
        audits, strings = cr.Audits(), [""]
        for _ in range(600):
            parent = rnd.randrange(max(0, len(strings) - 40), len(strings))
            mark = rnd.choice("DK")
            audits.add(parent, mark)
            strings.append(strings[parent] + mark)
        for _ in range(4000):
            a, b = rnd.randrange(len(strings)), rnd.randrange(len(strings))
            assert audits.less(a, b) == (strings[a] < strings[b])
        assert all(audits.string(k) == s for k, s in enumerate(strings))


def test_pieces_join_to_the_whole():
    rnd = random.Random(3)
    for _ in range(40):
        rows = [(rnd.choice("suauu"), rnd.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(30)]
        cuts = [0, *sorted(rnd.sample(range(1, 30), 4)), 30]
        pieces = [cr.piece_audits(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert cr.joined_all(pieces) == cr.piece_audits(rows)


def result(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_plain_python(spark, sf_dir):
    got = entry_mod.queries()["op11_conversation_repair"](spark, sf_dir)
    rows = [tuple(r) for r in read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = [(c, *plain_repair(r)[0]) for c, r in plain_damage(rows).items()]
    assert result(got) == sorted(want, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, cost string, e int, kind int, fault string, copy int"


def awkward(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "f", 3) for r in rows], SCHEMA).repartition(3)


def awkward_rows():
    rnd = random.Random(5)
    say = lambda: rnd.choice(["Yes.", "No!", "Why?", "so", "", " \t\n", None, "a ", "x. ", "ünï.", "long " * 3000])
    role = lambda: rnd.choice(["user", "assistant", "system", "tool", "", None, "umpire"])
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rnd.randrange(1, 12)):
            rows.append((conv, rnd.choice([None, 0, 1, 2, 5, 9, 2 ** 60]), role(), say()))
    return rows + rows[:9]


@pytest.mark.parametrize("piece", [4096, 2])
def test_awkward_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rows = awkward_rows()
    want = sorted(((c, *plain_repair(r)[0]) for c, r in plain_damage(rows).items()), key=repr)
    damaged = cr.damaged(awkward(spark, rows))
    assert result(cr.repair(damaged)) == want
    assert cr.repair(damaged.limit(0)).count() == 0


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(cr, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(cr, "PIECE", 16)
    rnd = random.Random(6)
    rows = [(1, rnd.choice([None, *range(300)]), rnd.choice(["user", "assistant", "user", "system"]),
             rnd.choice(["Same again.", f"one {k}.", f"cut {k}", "", f"two {k}!"])) for k in range(1200)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t}.") for c in (0, 2, 3) for t in range(4)]
    plain = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    ordered = cr.damaged(awkward(spark, rows))
    out = cr.repair(ordered)
    assert result(out) == sorted(((c, *r[0]) for c, r in plain.items()), key=repr)
    texts = defaultdict(list)
    for r in cr.repaired_rows(ordered, out).orderBy("conv_id", "ord").collect():
        texts[r.conv_id].append((r.role, r.text))
    assert {c: tuple(t) for c, t in texts.items()} == {c: r[1] for c, r in plain.items() if r[1]}


def test_undamaged_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 0, "user", "Hi!")]
    got = {r.conv_id: (r.cost, r.audit) for r in cr.repair(cr.ordered_rows(awkward(spark, rows))).collect()}
    assert got == {1: (0, "KKK"), 2: (2, "KI")}
