"""Conversation repair against a search over all states row by row, and against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

FORM = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def plain(rows):
    """Faults, then the cheapest path from row to row; states are the outputs modulo the form."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for (p, x), q in go.items():
                if x != "s" and p in best:
                    c, a, o = best[p]
                    new = (c + 2, a + "I", o + (("user" if x == "u" else "assistant") + ":",))
                    best[q] = min(best.get(q, new), new)
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for p, (c, a, o) in best.items():
            options = [(p, (c + 3, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for r, x, cost, letter in ((role, role[:1], 0, "K"), ("user", "u", 2, "R"), ("assistant", "a", 2, "R")):
                    if (p, x) in go:
                        options.append((go[p, x], (c + cost + extra, a + letter, o + (f"{r}:{text}",))))
            for q, v in options:
                new[q] = min(new.get(q, v), v)
        best = inserted(new)
    cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(seed, convs, longest=9):
    r, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(r.randint(0, longest)):
            if r.random() < 0.1:
                continue
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ["system", "user", "assistant"][(turn + 1) % 2 + 1 if turn else 0]
            text = r.choice(["", " \t", None, "Yes.", "No", "Is it?\n", "Wörter 日本", "a!", f"n{turn}."])
            rows.append((conv if r.random() > 0.02 else None, turn if r.random() > 0.05 else None, r.choice([role] * 12 + [None, "", "tool", "sage"]), text))
    return rows + rows[::17]


def check(spark, rows):
    from specflow.llm.op12_conversation_repair import conversation_repair

    frame = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, c int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair(frame).collect()}
    hurt = damage(rows)
    assert got == {c: plain(hurt.get(c, [])) for c in {x[0] for x in rows}}


def test_small(spark):
    check(spark, table(1, 150))


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    import specflow.llm.op12_conversation_repair as op

    monkeypatch.setattr(op, "SPAN_BITS", 3)  # many spans to fold
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "assistant"]), r.choice(["Yes.", "No", f"number {t}."])) for t in range(700)]
    check(spark, rows + table(3, 20) + [(9, 1, "user", "Same.")] * 40 + [(10, t, "user", "Same.") for t in range(60)] + [(11, 0, "user", "long " * 300000)])


def test_empty(spark):
    from specflow.llm.op12_conversation_repair import Repair, conversation_repair

    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair(frame).count() == 0 and Repair(frame).rows().count() == 0


def test_rows_of_the_repair(spark):
    from specflow.llm.op12_conversation_repair import Repair

    frame = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "So."), (1, 2, "user", "Eh?")], "conv_id long, turn int, role string, text string")
    repair = Repair(frame)
    got = [tuple(r) for r in repair.rows().orderBy("place").select("role", "text", "edit").collect()]
    assert (repair.summary.first()["cost"], repair.summary.first()["audit"], "".join(e for *_, e in got)) == (4, "RKKI", "RKKI")
    assert FORM.fullmatch("".join(r[0] for r, *_ in got)) and all(r in ("user", "assistant") for r, *_ in got)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cells_against_all_edit_sequences(n):
    from specflow.llm.op12_conversation_repair import cheapest, parse

    symbols = "suaoSUAO1234"
    for word in itertools.product(symbols, repeat=n) if n < 3 else random.Random(2).sample(list(itertools.product(symbols, repeat=3)), 60):
        best = None
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
            for edits in itertools.product("DKua", repeat=n):
                out, audit, cost = inserts[0], "I" * len(inserts[0]), 2 * len(inserts[0])
                for s, e, ins in zip(word, edits, inserts[1:]):
                    if e != "D" and s in "1234":
                        break
                    role = s.lower() if e == "K" else "" if e == "D" else e
                    out, audit = out + role + ins, audit + (e if e in "DK" else "R") + "I" * len(ins)
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and s in "SUAO") + 2 * len(ins)
                else:
                    if FORM.fullmatch(out):
                        best = min(best or (cost, audit), (cost, audit))
        assert cheapest(parse("".join(word))) == best
