import hashlib
import itertools
import random
import re
import zlib

import pytest

from seqtok.llm import conversation_repair as cr
from seqtok.llm.queries import op11_conversation_repair

from llm_fixtures import SMALL

pytest_plugins = ["llm_fixtures"]

WHITE = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.strip(WHITE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return out


def _best(rows, faults):
    """Least (cost, audit, repaired rows): whole strings in a table over (rows used, initials so far mod grammar)."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    live = {"": (0, "", ())}

    def inserts(live):
        for _ in range(3):
            for st, (c, s, r) in list(live.items()):
                to = nxt[st]
                new = (c + 3, s + "I", (*r, ({"u": "user", "a": "assistant"}[to], "")))
                if to not in live or new[:2] < live[to][:2]:
                    live[to] = new
        return live

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for st, (c, s, r) in inserts(live).items():
            ways = [(st, c + 4, s + "D", r)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                to = nxt[st]
                ways.append((to, c + 3 + more, s + "R", (*r, ({"u": "user", "a": "assistant"}[to], text))))
                i = role[:1]
                if i and i in "sua" and (i == nxt[st] or (i == "s" and st == "")):
                    ways.append((i, c + more, s + "K", (*r, (role, text))))
            for to, *rest in ways:
                if to not in new or tuple(rest[:2]) < new[to][:2]:
                    new[to] = tuple(rest)
        live = new
    return min((v for k, v in inserts(live).items() if k in ("", "a")), key=lambda v: v[:2])


def _brute(rows):
    out = []
    damaged = _damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults = _faults(own)
        cost, audit, fixed = _best(own, faults) if own else (0, "", ())
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[2][:1] for r in own]
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_query_equals_brute_force_on_a_table(shipped):
    rows = shipped.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = _got(op11_conversation_repair(shipped, SMALL))
    assert got == _brute([tuple(r) for r in rows]) and any("I" in r[7] for r in got)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_blocks_do_not_change_the_result(shipped, block):
    rng = random.Random(6)
    texts = ["Yes.", "No!\n", "what", "", " \t", None, "x. y", "Ende?\x0b", " ", "é."]
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-3, 40)]), rng.choice(roles[:3] if i % 3 else roles),
             rng.choice(texts)) for i in range(260)]
    rows += [(5, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(120)]       # one long conversation
    rows += [(6, t, "user", "same.") for t in range(50)] + [(7, 1, "assistant", "same.")] * 20 + [(8, None, "system", "s.")]
    rows += [(c, 0, "user", "Hi.") for c in range(100, 160)]                                    # some lose their only row
    df = shipped.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, POS int")
    assert _got(cr.repair_damaged(df, block_rows=block)) == _brute(rows)


def test_repaired_rows_are_legal_and_keep_their_texts(shipped):
    rows = [(1, 0, "assistant", "A."), (1, 1, "assistant", "B."), (1, 2, "user", "C."), (1, 3, "system", "D.")]
    report, repaired = cr.repair_conversations(shipped.createDataFrame(rows, "conv_id int, turn int, role string, text string"),
                                               block_rows=2)
    lines = [tuple(x) for r in repaired.orderBy("first_pos").collect() for x in r["lines"]]
    assert [r[:1] for r, _, _ in lines] == ["u", "a"] * (len(lines) // 2) and {t for _, t, _ in lines} <= {"A.", "B.", "C.", "D.", ""}
    assert report.first()["cost"] == _best(rows, _faults(rows))[0]


def test_empty_tables(shipped):
    df = shipped.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_damaged(df).collect() == []


def test_programme_equals_all_edit_sequences():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice(["fine", "fine", "truncated", "blank"])) for _ in range(rng.randrange(0, 4))]
        best = None
        for n in range(len(rows) * 2 + 4):
            for ops in itertools.product("DIKR", repeat=n):
                if sum(o != "I" for o in ops) != len(rows):
                    continue
                spots, todo, cost, at = [], 0, 0, 0
                for o in ops:
                    if o == "I":
                        spots.append("ua")
                        cost += 3
                        continue
                    role, fault = rows[at]
                    at += 1
                    if o == "D":
                        cost += 4
                    elif fault == "blank":
                        todo = 1
                        break
                    else:
                        spots.append(role if o == "K" else "ua")
                        cost += (3 if o == "R" else 0) + (3 if fault == "truncated" else 0)
                if todo:
                    continue
                if any(re.fullmatch("(s?(ua)+)?", "".join(w)) for w in itertools.product(*spots)):
                    best = min(best or (cost, "".join(ops)), (cost, "".join(ops)))
        ends = cr.audit_run(rows, cr.START) if rows else {cr.START: (0, "")}
        assert min((c + 3 * len(cr._TAIL[s]), a + cr._TAIL[s]) for s, (c, a) in ends.items()) == best


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 7])
def test_strings_compare_right_even_if_all_hashes_collide(modulus, monkeypatch):
    monkeypatch.setattr(cr.Audits, "MOD", modulus)
    rng = random.Random(modulus)
    tree, strings = cr.Audits(), {0: ()}
    for _ in range(300):
        base = rng.choice(list(strings)) if rng.random() < 0.5 else max(strings)
        token = rng.randrange(2)
        strings[tree.extend(base, token)] = (*strings[base], token)
    for a, b in itertools.product(rng.sample(list(strings), 80), repeat=2):
        assert tree.less(a, b) == (strings[a] < strings[b])
