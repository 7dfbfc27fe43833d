import hashlib
import itertools
import random
import time
import zlib

import pytest

from strandkeep.llm import prefix_trie as T
from strandkeep.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost long, node binary"


def plain_search(codes):
    """Every way with at most two insertions in a row."""
    best = None
    for edits in itertools.product(itertools.product(("", "I", "II"), "KRD"), repeat=len(codes)):
        for tail in ("", "I", "II"):
            cost, roles, ok = 0, "", True
            for code, (inserts, edit) in zip(codes, edits):
                for _ in inserts:
                    cost, roles = cost + 5, roles + ("a" if roles[-1:] == "u" else "u")
                if edit == "D":
                    cost += 2
                    continue
                cost += 5 * code.isupper()
                if edit == "R":
                    cost, roles = cost + 1, roles + ("a" if roles[-1:] == "u" else "u")
                else:
                    roles += code.lower()
                ok = ok and code != "d"
            for _ in tail:
                cost, roles = cost + 5, roles + ("a" if roles[-1:] == "u" else "u")
            body = roles[1:] if roles[:1] == "s" else roles
            if ok and (not roles or body) and body == "ua" * (len(body) // 2):
                audit = "".join(i + e for i, e in edits) + tail
                best = min(best or (99, ""), (cost, audit))
    return best


def test_search_finds_the_least_of_the_cheapest():
    for n in range(3):
        for codes in itertools.product("suaxSUAXd", repeat=n):
            assert R.search("".join(codes)) == plain_search(codes), codes
    rng = random.Random(3)
    for n in (3, 3, 3, 4) * 20:
        codes = rng.choices("suaxSUAXd", k=n)
        assert R.search("".join(codes)) == plain_search(codes), codes


def test_search_of_long_conversations():
    rng = random.Random(5)
    codes = "".join(rng.choices("suaUAd", k=30_000))
    began = time.time()
    cost, audit = R.search(codes)
    assert time.time() - began < 60 and len(audit.replace("I", "")) == len(codes)
    assert cost == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I") + 5 * sum(c.isupper() and e != "D" for c, e in zip(codes, audit.replace("I", "")))
    assert R.search("uUaaaad" * 10) == R.search("uUaaaad" * 10)


def plain_repair(rows):
    """Report and repaired lines of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    codes, seen = "", set()
    for _, role, text in rows:
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        solid = text.strip(" \t\n\r\v\f")
        if not solid:
            out["blank"], kind = out["blank"] + 1, "d"
        elif (role, text) in seen:
            out["duplicate"], kind = out["duplicate"] + 1, "d"
        elif solid[-1] not in ".!?":
            out["truncated"], kind = out["truncated"] + 1, kind.upper()
        codes += kind
        seen.add((role, text))
    for (_, a, _), (_, b, _) in itertools.pairwise(rows):
        out["illegal"] += a[:1] + b[:1] not in ("su", "ua", "au")
    cost, audit = plain_search(codes) if len(codes) < 5 else R.search(codes)
    lines, last, left = [], "", iter(rows)
    for edit in audit:
        _, role, text = next(left) if edit != "I" else (None, None, "")
        if edit == "D":
            continue
        role = role if edit == "K" else "assistant" if last == "u" else "user"
        last = role[0]
        lines.append(f"{role}:{text}")
    return out | {"cost": cost, "audit": audit, "lines": lines}


ODD = [
    (1, 0, "system", "be kind."), (1, 1, "user", "hi?"), (1, 2, "assistant", "yes."), (1, 5, "user", "cut o"),
    (2, 3, "assistant", "I begin."), (2, None, "tool", "x."), (2, 3, "assistant", "I begin."), (2, 3, None, None),
    (3, None, None, None), (4, 7, "user", ""), (5, -2, "", "no role."), (5, 4, "user", "é\U0001f600. \n"), (5, 9, "util", "ok!\v"),
    (None, 1, "user", "lost."), (None, 2, "user", "lost."), (6, 1, "s", "odd."), (6, 2, "assistant", "w. " * 50_000), (7, 0, "user", " "),
]


def odd(spark):
    return spark.createDataFrame([(*r, "clash", 7, b"x") for r in ODD], SCHEMA)


def test_repair_of_odd_conversations(spark):
    report, turns = R.repair(odd(spark))
    told = {r["conv_id"]: r.asDict() for r in report.collect()}
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert (r["pos"] is None) == (r["edit"] == "I")
    assert set(told) == {r[0] for r in ODD}
    for conv in told:
        want = plain_repair([r[1:] for r in ODD if r[0] == conv])
        assert lines.get(conv, []) == want.pop("lines") and told[conv] == want | {"conv_id": conv}


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    report, turns = R.repair(R.damaged(none))
    assert report.count() == turns.count() == 0
    assert T.trie(T.rebuilt(T.ordered(none))).count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(12) for t, r, x in ((0, "system", "a. b!"), (1, None, "c?"), (None, "assistant", None))]
    want = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if f == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if f == 2 else x
        want += [(c, t, "user" if f == 4 else r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    got = [tuple(r) for r in R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    for turns in convs.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = [r[1:] for r in convs.get(head, [])[:h] + own[h:]]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), set()).add(c)
        ends.setdefault(tuple(whole), []).append(c)
    out = []
    for node, own in members.items():
        below = [k for k in members if k[: len(node)] == node]
        leaf = [k for k in below if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in members)]
        words = lambda k: len([w for w in k[-1][1].translate(dict.fromkeys(map(ord, "\t\n\r\v\f"), " ")).split(" ") if w]) if k else 0
        saved = sum((len(members[k]) - 1) * words(k) for k in below)
        children = sum(len(k) == len(node) + 1 for k in below)
        end = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, len(leaf), saved, end))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ours(spark, rows):
    table = T.trie(T.rebuilt(T.ordered(spark.createDataFrame([(*r, "clash", 7, b"x") for r in rows], SCHEMA))))
    return sorted((tuple(r[c] for c in COLUMNS) for r in table.collect()), key=str)


@pytest.mark.parametrize("held", [3, 100_000])
def test_trie_of_odd_conversations(spark, monkeypatch, held):
    monkeypatch.setattr(T, "HELD", held)
    rng = random.Random(9)
    many = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["one two", "three", "", None])) for c in range(-45, 90) for t in range(rng.randrange(1, 6)) if c % 17]
    same = [(c, t, "user", f"same {t}") for c in (*range(4000, 4200), 9000) for t in range(5)]
    assert ours(spark, [*ODD, *many, *same]) == plain_trie([*ODD, *many, *same])


def test_trie_of_a_long_conversation_and_of_one_that_is_all_lent(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(700)] + [(40 + k, t, "user", f"t{t}") for k in range(7) for t in range(k)]
    assert ours(spark, rows) == plain_trie(rows)
