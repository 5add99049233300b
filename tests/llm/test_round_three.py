"""Operators 11 to 13 against SQL and brute force, with what may go wrong in their tables."""

import hashlib
import random
import re
import sys
import zlib
from fractions import Fraction
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from edge import BASE, LONG, ROWS, frame

from lanewise.llm import conversation_repair as cr
from lanewise.llm import filter_audit, minmax_dedup

# 11 filter interaction audit


def audit_by_hand(rows, labels):
    """rows: doc_id, text, source. labels: doc_id to (quality, toxic)."""
    judged = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": e}
        judged.append((source or "", {f for f in fails if fails[f]}, *labels.get(doc, (0, 0))))
    out, removed_of = [], {}
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left, gone = [j for j in judged if j[0] == part], []
            for step, f in enumerate(order, 1):
                now = [j for j in left if f in j[1]]
                redundant = sum(f in j[1] for j in gone)
                left, gone = [j for j in left if f not in j[1]], gone + now
                removed_of[part, f] = removed_of.get((part, f), 0) + len(now)
                unique = sum(j[0] == part and j[1] == {f} for j in judged)
                out.append((part, "".join(order), step, len(left), len(now), redundant, unique, sum(j[2] == 1 for j in now), sum(j[3] == 1 for j in now), f))
    return sorted((*o[:-1], removed_of[o[0], o[-1]]) for o in out)


def test_filter_audit_by_hand(spark):
    rng = random.Random(3)
    texts = ["", None, "A B", "word " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(55)), "a|b", LONG, BASE, "é" * 40 + " X", "\x0b\x1c \x85x　y" * 30]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts) if rng.random() < 0.7 else f"{rng.random()} only", rng.choice(["a", "b", None, ""])) for _ in range(300)]
    labels = {k: (rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 30, 2)}
    docs = spark.createDataFrame([(*r, "kept", 1, True) for r in rows], "doc_id long, text string, source string, part string, fails int, good boolean").repartition(7)
    known = spark.createDataFrame([(k, *v, 3) for k, v in labels.items()] + [(None, 1, 1, 3)], "doc_id long, quality int, toxic int, alive int")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(docs, known).collect())
    assert got == audit_by_hand(rows, labels) and len(got) == 600 * 3
    assert sum(1 for r in got if r[4]) and {len(set(r[1])) for r in got} == {5}
    assert filter_audit.filter_audit(docs.limit(0), known).count() == 0 and filter_audit.filter_audit(docs, known.limit(0)).count() == 1800


def test_subset_counts_at_any_number_of_rows():
    rng = np.random.RandomState(1)
    for n in (1, 7, 8, 9, 1000):
        fails, good, toxic = rng.randint(0, 32, n).astype(np.int32), rng.rand(n) < 0.5, rng.rand(n) < 0.2
        out = filter_audit.subset_counts(fails, good, toxic)
        for s, f in filter_audit.CASES:
            there = (fails & s) == 0
            removed = there & (fails >> f & 1 == 1)
            assert out[s, f].tolist() == [there.sum(), removed.sum(), (removed & good).sum(), (removed & toxic).sum()]


# 12 min-max hashing


def shingles_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1))) if words else frozenset()


def components_by_hand(rows):
    """doc_id of each row to shingles, component and kept, by all pairs."""
    sets = [shingles_by_hand(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(doc, least.get(top(k), doc))
    return sorted(((d, len(s), least.get(top(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_minmax_on_hard_rows(spark):
    rows = [*ROWS, (20, "A b C"), (21, "a B c"), (22, "a b"), (23, "a\x1cb"), (24, "\x85"), (25, "a b c d e f g h i")]
    got = minmax_dedup.minmax_dedup(frame(spark, rows).withColumnsRenamed({"lang": "component_id", "source": "key"})).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and [r["kept"] for r in got if r["n_shingles"] == 0] == [True] * 4
    assert minmax_dedup.minmax_dedup(frame(spark, rows[:1]).limit(0)).count() == 0


def chains(rng, groups, size):
    """Groups of versions: of one text, and of versions of versions, so that links only lead on step by step."""
    rows = []
    for g in range(groups):
        words = [f"{rng.randint(0, 10**6)}" for _ in range(60)]
        for k in range(size):
            new = list(words)
            new[rng.randint(0, 59)] = f"v{k}"
            if g % 2:
                words = new
            rows.append((len(rows), " ".join(new)))
    rng.shuffle(rows)
    return rows


def test_minmax_slices_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    rows = chains(rng, 6, 40)
    want = components_by_hand(rows)
    for slice_, leaders in ((256, 16), (8, 3), (5, 1)):
        monkeypatch.setattr(minmax_dedup, "SLICE", slice_)
        monkeypatch.setattr(minmax_dedup, "LEADERS", leaders)
        got = minmax_dedup.minmax_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_connected_looks_at_what_slices_leave(spark, monkeypatch):
    """One group of candidates that falls into many true parts: every link between slices is found."""
    monkeypatch.setattr(minmax_dedup, "SLICE", 7)
    monkeypatch.setattr(minmax_dedup, "LEADERS", 2)
    rng = np.random.RandomState(4)
    sets = {}
    for part in range(9):
        base = rng.randint(0, 2**60, 50)
        for _ in range(rng.randint(1, 20)):
            s = np.unique(np.concatenate([base[rng.permutation(50)[:48]], rng.randint(0, 2**60, 1)])).astype(np.uint64)
            sets[rng.bytes(16)] = s
    rows = [(b"g", k, s.tobytes()) for k, s in sets.items()]
    got = minmax_dedup.connected(spark.createDataFrame(rows, "comp binary, key binary, s binary"), Fraction(85, 100))
    found = {bytes(r["key"]): bytes(r["label"]) for r in got.collect()}
    keys = list(sets)
    for a in keys:
        for b in keys:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert found[a] == found[b]


def test_minmax_estimates_are_unbiased():
    rng = np.random.RandomState(2)
    for share in (0.5, 0.85):
        agree = []
        for _ in range(40):
            a = rng.randint(0, 2**62, 400).astype(np.uint64)
            n = int(400 * 2 * share / (1 + share))
            b = np.concatenate([a[:n], rng.randint(0, 2**62, 400 - n).astype(np.uint64)])
            agree.append((minmax_dedup.signature(a) == minmax_dedup.signature(b)).mean())
        assert abs(np.mean(agree) - n / (800 - n)) < 0.02


# 13 conversation structure repair


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repair_by_hand(rows):
    """One conversation's damaged rows in order, by the best of all ways (cost, audit) from each place and state."""
    seen, kinds = set(), []
    for _, role, text in rows:
        seen_before = (role, text) in seen
        seen.add((role, text))
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        kinds.append("blank" if not last else "duplicate" if seen_before else "truncated" if last not in ".!?" else "")
    n = len(rows)
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for k in range(n, -1, -1):
        own = {}
        for s in nxt:
            ways = []
            if k == n and s in ("", "a"):
                ways.append((0, "", ()))
            if k < n:
                _, role, text = rows[k]
                c, a, t = best[k + 1][s]
                ways.append((c + 4, "D" + a, t))
                if kinds[k] not in ("blank", "duplicate"):
                    more = 3 * (kinds[k] == "truncated")
                    if role[:1] == nxt[s] or role[:1] == "s" and s == "":
                        c, a, t = best[k + 1][role[:1]]
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                    c, a, t = best[k + 1][nxt[s]]
                    ways.append((c + 3 + more, "R" + a, ({"u": "user", "a": "assistant"}[nxt[s]] + f":{text}", *t)))
            own[s] = ways
        full = {s: min(w) if w else None for s, w in own.items()}
        for _ in range(4):  # turns put in at this place
            for s in nxt:
                b = full[nxt[s]]
                if b is not None:
                    way = (b[0] + 3, "I" + b[1], ({"u": "user:", "a": "assistant:"}[nxt[s]], *b[2]))
                    full[s] = way if full[s] is None else min(full[s], way)
        best[k] = full
    cost, audit, turns = best[0][""]
    known = [t for t, _, _ in rows if t is not None]
    heads = [r[1][:1] for r in rows]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest(),
    )


def all_by_hand(spark, rows):
    ties = {t: spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t)").first()[0] for t in {r[3] for r in damaged_by_hand(rows)}} if len(rows) < 3000 else {}
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged_by_hand(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], ties.get(r[2], 0), r[2]))
        out.append((conv, *repair_by_hand(own)))
    return sorted(out, key=str)


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hello.", "What?", "no stop", " ", "", None, "A.\n", "end! \x0b", "x　"]
    return [(conv, rng.choice([None, k]) if rng.random() < 0.1 else k + (k > n // 2), rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"{rng.random()}" + rng.choice([".", ""])) for k in range(n)]


def test_repair_by_hand(spark, monkeypatch):
    rng = random.Random(8)
    rows = [r for conv in [None, *range(25)] for r in talk(rng, conv, rng.randint(1, 14))]
    lost = [c for c in range(100, 500) if zlib.crc32(f"{c}:1".encode()) % 20 == 0][:3]  # nothing is left of these
    rows += [(c, 1, "user", "Gone.") for c in lost]
    want = all_by_hand(spark, rows)
    frame_ = spark.createDataFrame([(*r, "kept", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, gone string, cost int, kind int").repartition(5)
    for size in (1024, 2):
        monkeypatch.setattr(cr, "CHUNK_ROWS", size)
        got = sorted((tuple(r) for r in cr.repair(cr.damage(frame_)).collect()), key=str)
        assert got == want
    assert {w[0] for w in want if w[-2] == "" and w[-3] == 0} >= set(lost)
    assert set("".join(w[-2] for w in want)) == set("DIKR")
    assert cr.repair(cr.damage(frame_.limit(0))).count() == 0


def test_repair_of_a_long_conversation(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"turn {k % 900}" + rng.choice([".", ""])) for k in range(3000)]
    want = [(7, *repair_by_hand(sorted((r[1:] for r in damaged_by_hand(rows)), key=lambda r: r[0])))]
    monkeypatch.setattr(cr, "CHUNK_ROWS", 50)
    assert [tuple(r) for r in cr.repair(cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()] == want


def test_op13_by_hand(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = cr.op13_conversation_repair(spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == all_by_hand(spark, rows)


@pytest.mark.parametrize("audit,cost,rows", [("", 0, []), ("K", 3, [("user", "Hi.")]), ("D", 4, [("user", " ")]), ("KKDK", 4, [("user", "a."), ("assistant", "b."), ("assistant", "b."), ("user", "c.")])])
def test_walks_end_as_they_should(audit, cost, rows):
    kinds = cr.faults(rows, set())
    dist = cr.distances([(r, k) for (r, _), k in zip(rows, kinds, strict=True)], cr.AT_END)
    found, _, state = cr.walk(rows, kinds, dist, cr.NOTHING)
    want = audit if audit in ("", "D") else f"{audit}I"
    assert found + "I" * len(cr.CLOSING[state]) == want and dist[0][cr.NOTHING] == cost + 3 * (audit == "KKDK")
