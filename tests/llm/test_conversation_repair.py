"""Repair of conversations against a search over all edits, in chunks of any size, and odd rows."""

import hashlib
import random
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from wardline.llm import conversation_repair as R

NEXT = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(codes):
    """The cheapest edits by a search over (rows taken, state); the least audit comes first among equals."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, at, state = heappop(queue)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(codes) and state in (0, 3):
            return cost, audit
        for i in "ua":
            if state in NEXT[i]:
                heappush(queue, (cost + 5, audit + "I", at, NEXT[i][state]))
        if at < len(codes):
            heappush(queue, (cost + 2, audit + "D", at + 1, state))
            code = codes[at]
            for i in "sua" if code != "x" else "":
                if state in NEXT[i]:
                    more = 5 * code.isupper()
                    if i != "s":
                        heappush(queue, (cost + more + 1, audit + "R", at + 1, NEXT[i][state]))
                    if i == code.lower():
                        heappush(queue, (cost + more, audit + "K", at + 1, NEXT[i][state]))


@pytest.mark.parametrize("seed", range(4))
def test_cells_are_those_of_a_search(seed):
    rng = random.Random(seed)
    leaves = {c: R.leaf(c) for c in "xsuaoSUAO"}
    for _ in range(400):
        codes = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(15)))
        assert R.best(R.combined([leaves[c] for c in codes])) == brute(codes)
        # Any split of a span gives the same cell.
        if len(codes) > 1:
            cut = rng.randrange(1, len(codes))
            parts = [R.combined([leaves[c] for c in p]) for p in (codes[:cut], codes[cut:])]
            assert R.joined(*parts) == R.combined([leaves[c] for c in codes])


def code(role, text, before):
    text, role = text if text is not None else " ", role if role is not None else " "
    white = "\x20\x09\x0a\x0b\x0c\x0d"
    if not text.strip(white) or (role, text) in before:
        return "x"
    c = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return c if text.rstrip(white)[-1] in ".!?" else c.upper()


def replay(rows, audit):
    out, at, after = [], 0, ""
    for e in audit:
        if e in "KRD":
            role, text = rows[at]
            at += 1
        if e in "IR":
            role, text = "assistant" if after == "u" else "user", text if e == "R" else ""
        if e != "D":
            after = role[:1]
            out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [256, 3])
def test_summaries_and_edits(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for c in [None, *range(30)]:
        for turn in range(rng.randrange(60) if c == 7 else rng.randrange(1, 7)):
            text = rng.choice([None, "", " \n", "end.", "end. \n", "no end", f"own {turn}!", "é?"])
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["system", "user", "assistant", "tool", None, "u"]), text))
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash"))
    summary, edits = R.repair(turns, chunk=chunk)
    got, digests = {r.conv_id: r for r in summary.collect()}, {r.conv_id: r.repaired_sha256 for r in R.digests(edits).collect()}
    placed = {}
    for r in edits.collect():
        placed.setdefault(r.conv_id, []).append(r)
    assert set(got) == {r[0] for r in rows} == set(digests)
    for c in got:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", " " if r[3] is None else r[3]))
        own = [(r[2] or " ", " " if r[3] is None else r[3]) for r in own]
        codes = "".join(code(*x, own[:i]) for i, x in enumerate(own))
        assert (got[c].cost, got[c].audit) == brute(codes)
        assert digests[c] == replay(own, got[c].audit)
        assert "".join(r.edit for r in sorted(placed[c], key=lambda r: r.place)) == got[c].audit
        assert got[c].blank + got[c].duplicate == codes.count("x") and got[c].truncated == sum(x.isupper() for x in codes)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(own, own[1:])]
        assert got[c].illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        numbers = {r[1] for r in rows if r[0] == c and r[1] is not None}
        assert got[c].gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)


def test_no_rows_and_one_very_long_text(spark):
    summary, edits = R.repair(spark.createDataFrame([], SCHEMA))
    assert summary.count() == 0 and R.digests(edits).count() == 0
    long = "word " * 200_000 + "end."
    summary, edits = R.repair(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "yes.")], SCHEMA))
    assert summary.first().audit == "KK"
    assert R.digests(edits).first()[1] == hashlib.sha256(f"user:{long}\nassistant:yes.".encode()).hexdigest()


def test_heavy_conversations_give_the_same(heavy):
    rows = [(c % 3, t, "user" if t % 2 else "assistant", f"text {t % 50}.") for c in range(3) for t in range(120)]
    want = {c: brute("".join(code(r[2], r[3], [(q[2], q[3]) for q in rows if q[0] == c][: r[1]]) for r in rows if r[0] == c)) for c in range(3)}
    summary, _ = R.repair(heavy.createDataFrame(rows, SCHEMA), chunk=16)
    assert {r.conv_id: (r.cost, r.audit) for r in summary.collect()} == want
