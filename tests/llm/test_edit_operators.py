"""Spelling variants, order MinHash fingerprints and conversation repair against plain versions, and their edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np

from millrace.llm.conversations import damaged_rows, repair_conversations, repair_report
from millrace.llm.fingerprints import KMER, PICKED, SKETCHES, edited_text, fingerprint, fingerprint_report, likeness, items_of
from millrace.llm.spelling import one_edit_pairs, spelling_variants

# --- op11 ----------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        by = [x for x in n if near(w, x)]
        best = min(by, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, n[w], len(by))
    root = {w: w for w in n}
    for w in n:
        while out[root[w]][0]:
            root[w] = out[root[w]][0]
    return {(w, f, root[w], c, k, n[f] if f else None) for w, (f, c, k) in out.items()}


def test_variants(spark):
    rng = random.Random(3)
    stems = ["abbab", "aabbaab", "ÉabÿbaÀ", "bbbbbb", "Straße"]
    words = []
    for _ in range(1500):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "É", "Z"])
        words.append("".join(w))
    rows = [(i % 50 if i % 7 else None, " ".join(words[i::60] + words[i::45])) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "12 · !"), (3, "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999)] * 3
    docs = spark.createDataFrame([(*r, 9, "w") for r in rows], "doc_id long, text string, n long, word string")
    assert {tuple(r) for r in spelling_variants(docs).collect()} == plain_variants(rows)


def test_pairs_of_few_words(spark):
    words = ["", "a", "b", "aa", "ab", "aab", "baa", "aaaa", "aaa", "é", "éa", "𝄞a", "𝄞b"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert {(r.word, r.near) for r in one_edit_pairs(df).collect()} == {(a, b) for a in words for b in words if near(a, b)}
    assert one_edit_pairs(df.limit(0)).count() == 0


# --- op12 ----------------------------------------------------------------------------------------


def numbered(text):
    """The k-mers with the number of earlier ones."""
    k, seen, out = min(KMER, len(text)), Counter(), []
    for i in range(len(text) - k + 1):
        out.append((text[i : i + k], seen[text[i : i + k]]))
        seen[out[-1][0]] += 1
    return out


def test_items_are_numbered_kmers():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abé", k=n)) for n in (1, 5, 8, 9, 300, 3000)] + ["ab" * 400, "a" * 50, "𝄞" * 20]
    name = {}
    for t in texts:
        items = items_of(np.frombuffer(t.encode("utf-32-le"), np.uint32)).tolist()
        assert len(items) == len(numbered(t)) and all(name.setdefault(x, i) == i for x, i in zip(numbered(t), items))
    assert len(set(name.values())) == len(name)


def plain_tuples(text):
    """For each function the k-mers picked, in text order."""
    from millrace.llm.fingerprints import _ODD

    items = items_of(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()
    out = []
    for j in range(SKETCHES):
        value = [((x >> 32 if j % 2 else x & 0xFFFFFFFF) * int(_ODD[j])) % (1 << 32) for x in items]
        out.append(tuple(items[i] for i in sorted(sorted(range(len(items)), key=lambda i: (value[i], i))[:PICKED])))
    return out


def test_equal_hashes_are_equal_tuples():
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefgh ", k=9000))
    texts = [base, base[:4000] + base[5000:], base[4500:] + base[:4500], base[:8990] + "x" * 10, "ab", "abcdefgh", "abcdefghi"]
    for a in texts:
        for b in texts:
            same = [x == y for x, y in zip(plain_tuples(a), plain_tuples(b))]
            assert ((fingerprint(a) == fingerprint(b)) == same).all()
    moved, cut = likeness(fingerprint(base), fingerprint(texts[2])), likeness(fingerprint(base), fingerprint(texts[1]))
    assert moved < cut < 1 and abs(moved - 0.5) < 0.25  # a tuple survives the move if both its items lie in one half


def test_fingerprint_report(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdé .\n", k=rng.choice([0, 1, 3, 7, 8, 9, 40, 400])))) for i in rng.sample(range(1000), 120)]
    rows += [(None, "no id"), (1001, None), (1002, "long " * 20_000), (1003, "long " * 20_000), (7, "x"), (7, "x")]
    docs = spark.createDataFrame([(*r, 3, "z") for r in rows], "doc_id long, text string, n_chars long, bucket string")
    got = fingerprint_report(docs, bucket_bytes=2000).collect()
    order = [(i, t or "") for i, t in rows]
    by_next = {}
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({i for i, _ in rows}) == len(order) - 1 - (sum(i == 7 for i, _ in rows) - 2)
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        e = edited_text(t, following)
        a, b, c = fingerprint(t), fingerprint(e), fingerprint(following)
        text_of = lambda x: x.astype(">u4").tobytes().hex()
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(a), text_of(b), likeness(a, b), likeness(a, c)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    assert sorted((tuple(r) for r in got if r.doc_id != 7), key=key) == sorted((r for r in want if r[0] != 7), key=key)
    assert by_next == {} and fingerprint_report(docs.limit(0)).count() == 0
    assert fingerprint_report(docs.where("doc_id is null")).first().near_next == 1.0


# --- op13 ----------------------------------------------------------------------------------------

STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Least cost, then least audit, over all edit sequences: a plain search with whole audits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in ("user", "assistant"):
            if role[0] in STEP[q]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, role + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in STEP[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if to[0] in STEP[q]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to[0], (*out, f"{to}:{text}")))


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, told = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        told.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(told)
    count = Counter(f for _, _, f in told)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(300):
        for _ in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", " "])
            text = rng.choice(["Yes.", "No", "", " \n", "Why?", "So!\n ", "é.", "cut é", "x\x85", "Yes.\x0b"])
            rows.append((conv if conv else None, rng.choice([None, *range(8)]), role, text, 0, False))
    rows += [(900, t, "user", "gone.", 0, True) for t in range(3)] + [(901, 1, "user", "gone.", 0, True), (901, 2, "user", "Here.", 0, False)]
    rows += [(902, t, ("user", "assistant")[t % 2], f"Turn {t}.", 0, False) for t in range(3000)] + [(902, 5000, "user", "w" * 200_000, 0, False)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int, dropped boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()}
    by = {}
    for conv, turn, role, text, _, dropped in rows:
        by.setdefault(conv, [])
        if not dropped:
            by[conv].append((turn, role, text))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        if conv != 902:
            assert got[conv] == plain_repair(own), conv
    assert got[902][1:6] == (0, 0, 1, 0, 4) and got[902][6] == "K" * 3000 + "D"


def test_damage_and_edges(spark):
    rows = [(1, t, "user", "A. B!") for t in range(200)] + [(None, None, None, None), (2, 0, None, "x"), (2, 1, "user", None), (2, 1, "user", None)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, copy int, dropped boolean")
    want = Counter()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if h == 4 else " " if role is None else role), " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        want[c, t, role, text, h == 0] += 2 if h == 3 else 1
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.dropped) for r in damaged_rows(df).collect())
    assert got == want
    assert {r.conv_id for r in repair_report(df).collect()} == {1, 2, None}
    assert repair_report(df.limit(0)).count() == 0
