import hashlib
import heapq
import random
import zlib

import pytest

from tensorloom.llm import auction
from tensorloom.llm.conversations import cost_of, damaged, faults, op12_conversation_repair, repair_report, repaired_turns, turns

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def cheapest_by_search(rows):
    """rows of (role, fault): the (cost, edits) least of all, cheapest first, by a search over whole edit strings."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, before = heapq.heappop(heap)
        if i == len(rows) and before in ("", "a"):
            return cost, edits
        if (i, before) in seen:
            continue
        seen.add((i, before))
        fits = lambda r: r == "s" and before == "" or r == "u" and before != "u" or r == "a" and before == "u"  # noqa: E731, B023
        for r in "ua":
            if fits(r):
                heapq.heappush(heap, (cost + 2, edits + "I", i, r))
        if i < len(rows):
            role, fault = rows[i]
            more = fault == "truncated"
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, before))
            if fault not in ("blank", "duplicate"):
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[:1]))
                for r in "ua":
                    if fits(r):
                        heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, r))


def test_search_of_all_edit_strings_agrees_on_tiny_input():
    """The search above keeps one string for each place; all strings up to a length say the same."""
    from itertools import product

    def plays(rows, edits):
        left, before, cost = list(rows), "", 0
        for e in edits:
            nxt = "a" if before == "u" else "u"
            if e == "I":
                before, cost = nxt, cost + 2
                continue
            if not left:
                return None
            role, fault = left.pop(0)
            if e == "D":
                cost += 3
                continue
            if fault in ("blank", "duplicate"):
                return None
            cost += (fault == "truncated") + 2 * (e == "R")
            if e == "R":
                before = nxt
            elif role[:1] == "s" and before == "" or role[:1] == "u" and before != "u" or role[:1] == "a" and before == "u":
                before = role[:1]
            else:
                return None
        return cost if not left and before in ("", "a") else None

    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(4))]
        every = ((c, "".join(e)) for n in range(7) for e in product("DIKR", repeat=n) if (c := plays(rows, e)) is not None)
        assert min(every) == cheapest_by_search(rows)


CODE = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}


def test_auction_equals_search():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 6, 9, 20, 63, 64, 65, 130]:
        for _ in range(150 if n < 30 else 12):
            rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["", "", "", *CODE])) for _ in range(n)]
            codes = bytes("suat".find(r[0]) + 4 * CODE[f] for r, f in rows)
            edits, cost = auction.cheapest(codes)
            assert (cost, edits) == cheapest_by_search(rows)
            assert cost_of(codes, edits) == cost


def test_final_prices_are_slack_or_tight():
    """Complementary slackness, on which the reading of tight arcs rests."""
    rng = random.Random(4)
    for _ in range(50):
        lattice = auction.Lattice(bytes(rng.randrange(4) + 4 * rng.randrange(4) for _ in range(30)))
        for q in auction.STATES:
            lattice.settle(q)
        assert all(lattice.price[v] <= cost + lattice.price[head] for v, arcs in enumerate(lattice.arcs) for _, cost, head in arcs)


def test_pieces_chain_to_the_whole():
    rng = random.Random(6)
    for _ in range(60):
        codes = bytes(rng.randrange(4) + 4 * rng.choice((0, 0, 1, 2, 3)) for _ in range(rng.randrange(1, 180)))
        cuts = sorted({0, *(rng.randrange(len(codes)) for _ in range(3))})
        pieces = [codes[a:b] for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True)]
        prices, tails = auction.endings()
        behind = []
        for p in reversed(pieces):
            behind.append(prices)
            prices = auction.before(auction.crossing(p), prices)
        state, out = auction.NONE, ""
        for p, exits in zip(pieces, behind[::-1], strict=True):
            edits, state = auction.edits_from(auction.chained(p, exits)[0], state)
            out += edits
        assert (out + tails[state], prices[auction.NONE]) == auction.cheapest(codes)


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def report(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        seen, found = set(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            found.append((role, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, edits = cheapest_by_search(found)
        left, before, repaired = list(mine), "", []
        for e in edits:
            nxt = "a" if before == "u" else "u"
            row = None if e == "I" else left.pop(0)
            if e == "D":
                continue
            before = row[2][:1] if e == "K" else nxt
            repaired.append(f"{row[2] if e == 'K' else {'u': 'user', 'a': 'assistant'}[nxt]}:{row[3] if row else ''}")
        t = [r[1] for r in mine if r[1] is not None]
        gaps = max(t) - min(t) + 1 - len(set(t)) if t else 0
        kinds = [sum(f == k for _, f in found) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, *kinds, illegal, cost, edits, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(9)):
            text = rng.choice(["Yes.", "No!", "Why?\n", "so it", "", " \t", "Well. And", "é…", "x" * 3000 + ".", None, "Same.", "Same."])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(1000, t, ("user", "assistant")[t % 2] if t % 17 else "system", rng.choice(["Right.", f"{t}", f"{t}!", f"Of {t}."])) for t in range(900)]
    rng.shuffle(rows)
    return rows + rows[:20]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "piece"), [(1, 4096), (2, 50)])
def test_report_equals_brute_force(spark, seed, piece):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "conv", 1) for r in rows], SCHEMA + ", conv string, uid int").repartition(5)
    ids = {r[0] for r in rows}
    got = {r[0]: tuple(r)[1:] for r in repair_report(df, piece=piece).collect()}
    assert got == report([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], ids)
    got = {r[0]: tuple(r)[1:] for r in repair_report(damaged(df), df, piece=piece).collect()}
    assert got == report(harm(rows), ids)


def test_repaired_turns_have_the_structure(spark):
    rows = corpus(3)
    df = damaged(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for r in repaired_turns(df).collect():
        by.setdefault(r.conv_id, []).append(r)
    want = {r[0]: r for r in repair_report(df).collect()}
    assert by.keys() <= want.keys()
    for conv, w in want.items():
        mine = sorted(by.get(conv, []), key=lambda r: r.place)
        assert "".join(r.edit for r in mine) == w.audit
        left = [r for r in mine if r.edit != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest() == w.repaired_sha256
        initials = "".join(r.role[0] for r in left).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and (initials or not left)


def test_conversations_without_rows_are_reported(spark):
    df = spark.createDataFrame([(1, 0, "user", "Yes.")], SCHEMA)
    out = repair_report(df.where("false"), df).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_report(df.where("false")).count() == 0
    assert repaired_turns(df.where("false")).count() == 0


def test_a_much_repeated_row_is_a_duplicate_but_once(spark):
    df = spark.range(3000).selectExpr("id % 2 conv_id", "cast(null as long) turn", "'user' role", "'Again.' text")
    codes = [r.code for r in faults(turns(df)).collect()]
    assert sorted(set(codes)) == [1, 13] and codes.count(1) == 2
    assert {(r.duplicate, r.audit[:2], r.cost) for r in repair_report(df, piece=100).collect()} == {(1499, "KD", 3 * 1499 + 2)}


def test_the_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, SF).collect()}
    assert got == report(harm(rows), {r[0] for r in rows})
