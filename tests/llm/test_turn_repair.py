import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from alphaframe.llm.turn_repair import damaged, repair_reports, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, key string, fault long, cost string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = "[\x20\x09-\x0d]"


def brute(rows):
    """Every way over the whole conversation, kept as (cost, audit, turns) per state; no order of states, no bytes."""
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t))
    out = []
    for c, own in convs.items():
        own.sort(key=lambda x: x[:4])
        seen, counts, faults = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, _, r, x, _ in own:
            kept = re.sub(SPACE, "", x)
            f = "blank" if not kept else "duplicate" if (r, x) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((r, x))
            faults.append(f)
            if f:
                counts[f] += 1
        best = {"": (0, "", ())}

        def closed(best):
            for _ in range(3):
                for s, (cost, audit, turns) in list(best.items()):
                    to, name = ("ua", "assistant") if s == "u" else ("u", "user")
                    to = "a" if s == "u" else "u"
                    way = (cost + 3, audit + "I", (*turns, f"{name}:"))
                    best[to] = min(best.get(to, way), way)
            return best

        for (_, _, r, x, _), f in zip(own, faults):
            after = {}
            for s, (cost, audit, turns) in closed(dict(best)).items():
                ways = [(s, (cost + 4, audit + "D", turns))]
                if f not in ("blank", "duplicate"):
                    extra = 3 if f else 0
                    to, name = ("a", "assistant") if s == "u" else ("u", "user")
                    ways.append((to, (cost + 3 + extra, audit + "R", (*turns, f"{name}:{x}"))))
                    if r[:1] == to or (s == "" and r[:1] == "s"):
                        ways.append((r[:1], (cost + extra, audit + "K", (*turns, f"{r}:{x}"))))
                for to, way in ways:
                    after[to] = min(after.get(to, way), way)
            best = after
        cost, audit, turns = min(w for s, w in closed(dict(best)).items() if s in ("", "a"))
        known = [t for *_, t in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice([f"Turn {t}.", f"Turn {t}.", "Yes.", "cut", "", " \n", None, "End?!  "])))
    return rows


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (2, None, "assistant", "a."), (2, None, None, None), (2, None, "user", "b"),
    (3, 5, "system", "s."), (None, 0, "user", "x."), (None, 3, "assistant", "y."), (4, -3, "Üser", "x" * 50_000 + "."), (4, 2 ** 62, "u", "last one"),
    (5, 1, "user", "same turn b."), (5, 1, "user", "same turn a."), (6, 0, "user", "Ends. \x0b\t\n"), (6, 1, "assistant", "nbsp. "),
]


def test_matches_brute_force(spark):
    rows = ODD + [(c + 10, *r) for c, *r in made(1, 150, 12)]
    assert got(repair_reports(frame(spark, rows))) == brute(rows)


def test_giant_conversations_take_three_passes_with_the_same_result(spark):
    rows = ODD + [(c + 10, *r) for c, *r in made(2, 40, 40)]
    assert got(repair_reports(frame(spark, rows), hold_rows=4, piece=3)) == brute(rows)
    assert got(repair_reports(frame(spark, rows), hold_chars=40_000, piece=1)) == brute(rows)


def test_turns_left_are_those_of_the_report(spark):
    rows = [(c, *r) for c, *r in made(3, 30, 15)]
    reports = {r["conv_id"]: r for r in repair_reports(frame(spark, rows)).collect()}
    for hold in (1 << 16, 4):
        turns = repaired_turns(frame(spark, rows), hold_rows=hold, piece=3).collect()
        by = {}
        for r in sorted(turns, key=lambda r: (r["conv_id"], r["position"])):
            assert (r["turn"] is None) <= (r["edit"] == "I" or r["turn"] is None)
            by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for c, report in reports.items():
            own = by.get(c, [])
            assert hashlib.sha256("\n".join(own).encode()).hexdigest() == report["repaired_sha256"]
            assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in own))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-2, 6)), st.sampled_from(["user", "assistant", "system", None, "x"]),
                          st.sampled_from(["a.", "b!", "c", "", None])), min_size=1, max_size=25))
def test_any_rows(spark, rows):
    assert got(repair_reports(frame(spark, rows))) == brute(rows)


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. B!") for c in range(20) for t in [*range(6), None]] + [(None, None, None, None)]
    want = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if hit:
            row = (c, t, "user" if hit == 4 else r, "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x)
            want += [row] * (2 if hit == 3 else 1)
    assert sorted((tuple(r) for r in damaged(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_text_ids(spark):
    assert repair_reports(frame(spark, [])).count() == 0
    df = spark.createDataFrame([("n", 0, "user", "a."), (None, 0, "user", "b."), ("vn", 0, "user", "c.")], "conv_id string, turn int, role string, text string")
    assert sorted(str(r["conv_id"]) for r in repair_reports(df).collect()) == ["None", "n", "vn"]
