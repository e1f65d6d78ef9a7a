import hashlib
import itertools
import random
import re
import zlib

from weftline.llm import repair
from weftline.llm.repair import BLANK, CUT, DUPLICATE, NONE

LEGAL = re.compile("(s?(ua)+)?")


def brute_edits(rows):
    """Cheapest edits of (fault, initial) rows, the least of several: all paths, kept by what they lead to and their cost."""
    paths = {("", ""): 0}  # edits, initials of the repaired roles

    def inserted(paths):
        for _ in range(2):
            for (edits, made), cost in list(paths.items()):
                for role in "ua":
                    key = edits + "I", made + role
                    paths[key] = min(paths.get(key, 10**9), cost + 2)
        return paths

    for fault, initial in rows:
        after = {}
        for (edits, made), cost in inserted(paths).items():
            ways = [("D", "", 3)]
            if fault not in (BLANK, DUPLICATE):
                cut = fault == CUT
                ways += [("K", initial or "?", cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]
            for edit, role, more in ways:
                if re.fullmatch("(s?(ua)*u?)?", made + role):
                    key = edits + edit, made + role
                    after[key] = min(after.get(key, 10**9), cost + more)
        # of paths to one state only cheap ones can be the beginning of the cheapest
        least = min(after.values())
        paths = {k: c for k, c in after.items() if c <= least + 8}
    done = [(cost, edits) for (edits, made), cost in inserted(paths).items() if LEGAL.fullmatch(made)]
    return min(done)


def test_least_edits_equal_brute_force():
    rng = random.Random(5)
    shapes = [list(zip(f, i, strict=True)) for n in range(3) for f in itertools.product((NONE, BLANK, CUT), repeat=n) for i in itertools.product("sua?", repeat=n)]
    shapes += [[(rng.choice((NONE, NONE, NONE, BLANK, DUPLICATE, CUT)), rng.choice("uuuaaas?")) for _ in range(rng.randrange(3, 6))] for _ in range(120)]
    for rows in shapes:
        codes = bytes(repair.code_of(f, i) for f, i in rows)
        cost, edits = brute_edits(rows)
        assert repair.least_edits(codes) == edits, rows
        assert repair.cost_of(edits, codes) == cost, rows


def chain_edits(codes):
    """The same by strings carried from row to row: no halves, no ranks."""
    best = {0: (0, "")}
    for code in codes:
        after = {}
        for state, (cost, edits) in best.items():
            for t, (more, e) in repair.STEPS[code][state].items():
                after[t] = min(after.get(t, (10**9, "")), (cost + more, edits + e))
        best = after
    return min((c + 2 * repair.TO_END[s], e + "I" * repair.TO_END[s]) for s, (c, e) in best.items())[1]


def test_long_conversations():
    rng = random.Random(9)
    for n in (17, 64, 65, 300, 1001):
        codes = bytes(rng.choice((0, 1, 1, 2, 2, 3, 5, 6, 8, 9)) for _ in range(n))
        assert repair.edits_of(codes) == chain_edits(codes)
    assert len(repair.edits_of(bytes([1, 2] * 50_000))) == 100_000


def report(rows):
    """Facts and repaired hash of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        kinds.append(BLANK if not last else DUPLICATE if (role, text) in seen else CUT if last[0] not in ".!?" else NONE)
        seen.add((role, text))
    first = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    codes = bytes(repair.code_of(k, i) for k, i in zip(kinds, first, strict=True))
    edits = chain_edits(codes)
    said, state, at = [], 0, iter(rows)
    for e in edits:
        row = next(at) if e != "I" else None
        if e == "D":
            continue
        role = row[1] if e == "K" else ("user", "user", "assistant", "user")[state]
        said.append(f"{role}:{row[2] if row else ''}")
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
    assert LEGAL.fullmatch("".join(x[0] for x in said))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in (BLANK, DUPLICATE, CUT)),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), repair.cost_of(edits, codes), edits, hashlib.sha256("\n".join(said).encode()).hexdigest(),
    )


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
    if k == 4:
        role = "user"
    text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
    return [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["Hi.", "Hi.", "What?", "cut off", "", " \t\n", None, "No!\n ", "é. ", "x" * 100_000 + "."]
    data = [(c, rng.choice((None, *range(6))) if c % 7 == 0 else t, rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "")), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 9))]
    data += [(None, 0, "user", "a."), (None, 1, "assistant", "b.")] + [(1000, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)]
    data += [(-1, t, "system", "Only.") for t in (0, 0, 3)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in data], "conv_id long, turn long, role string, text string, kind string, place long, `again` long")
    faulty = repair.faults(repair.damaged(df), repair.F.col("present"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(faulty).collect()}
    want = {}
    for r in data:
        want.setdefault(r[0], []).extend(damage(*r))
    assert got == {c: report(rows) for c, rows in want.items()}
    lines = {}
    for r in repair.repair(faulty).orderBy("conv_id", "nth").collect():
        lines.setdefault(r.conv_id, []).append(r)
    for c, rows in lines.items():
        assert "".join(r.edit for r in rows) == got[c][-2]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows if r.edit != "D").encode()).hexdigest() == got[c][-1]
    assert repair.repair_report(repair.faults(repair.damaged(df.limit(0)), repair.F.col("present"))).count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if not damage(c, 0, "user", "x"))
    df = spark.createDataFrame([(conv, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    r = repair.repair_report(repair.faults(repair.damaged(df), repair.F.col("present"))).first()
    assert tuple(r) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
