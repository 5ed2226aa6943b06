"""Decontamination, vector codes and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from microstar.llm import decontamination, spellings, vector_codes
from microstar.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.helpers import assert_same
from tests.llm.helpers import EDGES, LONG, docs, empty


# ---- decontamination ----

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(rows, items, length=10):
    windows = []
    for item_id, text in items:
        w = BENCH_WORD.findall(lower_ascii(text))
        windows += [(item_id, w[o:o + length]) for o in range(max(1, len(w) - length + 1)) if w]
    out = []
    for doc_id, text in rows:
        w = BENCH_WORD.findall(lower_ascii(text))
        hit, ids = set(), set()
        for item_id, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(item_id)
        shown = ",".join(sorted("" if i is None else str(i) for i in ids))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(shown.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, n long, window string")


@pytest.mark.parametrize("block_bytes", [32 << 20, 3000])
def test_decontamination_equals_brute_force(spark, block_bytes):
    draw = random.Random(5)
    some = [f"w{i}" for i in range(12)]
    passage = [draw.choice(some) for _ in range(14)]
    items = [(1, " ".join(passage)), (2, "Zoë  ist-hier_12"), (3, "one"), (11, " ".join(draw.choice(some) for _ in range(25))),
             (1, "w1 w2 w1"), (4, None), (5, "..."), (None, "w3 w3 w4 w5"), (6, " ".join(passage)), (7, "a " * 12)]
    rows = [(i, " ".join(draw.choice(some) for _ in range(draw.choice([3, 10, 60])))) for i in range(60)]
    rows += [(100, "x " + " ".join(passage).upper() + " y"), (101, " ".join(passage[:9])), (102, ", ".join(passage[2:12]) + "."),
             (103, "zoË ist hier 12"), (104, "ZOë ist\x00hier!12 One"), (105, "a" + " a" * 30), (100, "again one"), (106, "one")]
    got = decontamination.decontaminate(docs(spark, rows + EDGES), items_table(spark, items), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute_contamination(rows + [e[:2] for e in EDGES], items)


def test_decontamination_without_rows_or_items(spark):
    bench = items_table(spark, [(1, "a b")])
    assert decontamination.decontaminate(empty(docs(spark, EDGES)), bench).count() == 0
    for none in (empty(bench), items_table(spark, [(1, None), (2, "?")])):
        got = decontamination.decontaminate(docs(spark, EDGES), none).collect()
        assert len(got) == len(EDGES) and not any(r.n_hit or r.n_items or r.contaminated for r in got)


def test_decontamination_never_shuffles_words(spark):
    """The corpus is scanned beside a broadcast block; only counts and occurrences are exchanged."""
    table = docs(spark, [(1, LONG)])
    windows, _ = decontamination.item_windows(items_table(spark, [(1, LONG[:200])]))
    prefix = decontamination.prefixes(table, windows)
    assert prefix.groupBy("window").count().where("count <> 1").count() == 0
    plan = decontamination._shingles(table.select(decontamination.words(table.text).alias("word_list")), 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("split(") == 1


# ---- vector codes ----

def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Full search of every part over every entry, in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = {}
    for n, (_, v, _) in enumerate(kept):
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        each = len(q) // parts
        cut[n] = [tuple(q[p * each:(p + 1) * each]) for p in range(parts)]
    books = [[cut[n][p] for n in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for n in cut:
                held.setdefault(nearest(p, cut[n][p])[1], []).append(cut[n][p])
            new.append([tuple(sum(c) // len(held[k]) for c in zip(*held[k])) if k in held else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    own = [(i, lab, [nearest(p, cut[n][p]) for p in range(parts)]) for n, (i, _, lab) in enumerate(kept)]
    totals = Counter()
    for _, lab, found in own:
        totals[lab] += sum(d for d, _ in found)
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), totals[lab], digest) for i, lab, found in own), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def vector_rows(n, draw):
    rows = []
    for i in range(n):
        v = draw.normal(size=16 * 2) * draw.choice([0.02, 0.3, 3.0])
        if i % 3 == 0:
            v = np.round(v, 1)  # ties and equal parts
        rows.append((i, [float(x) for x in v.astype(np.float32)], None if i % 7 == 0 else i % 4))
    same = rows[5][1]
    return rows + [(n + k, same, 1) for k in range(150)] + [(3, same, 2), (None, same, None), (-5, None, 1), (-6, [float("nan")] * 32, 1),
                                                           (-7, [None] * 32, 1), (-8, [float("inf")] * 32, 1), (7, rows[7][1], None)]


@pytest.mark.parametrize("slice_rows, leaf", [(4096, 64), (100, 4)])
def test_vector_codes_equal_full_search(spark, monkeypatch, slice_rows, leaf):
    rows = vector_rows(500, np.random.default_rng(2))
    monkeypatch.setattr(vector_codes, "SLICE", slice_rows)
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], VECTORS)
    got = vector_codes.compress(table).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == brute_codes(rows)


def test_balls_hold_their_points_and_shrink_candidates():
    draw = np.random.default_rng(4)
    points = draw.integers(-300, 300, size=(3000, 4))
    points[:500] = points[0]
    balls = vector_codes.tree(points)
    assert sorted(balls.order) == list(range(len(points)))
    for ball in range(len(balls.parent)):
        held = points[balls.order[balls.first[ball]:balls.first[ball] + balls.count[ball]]]
        assert (held.sum(0) == balls.sums[ball]).all()
        assert np.sqrt(((held - held.mean(0)) ** 2).sum(1)).max() <= balls.radius[ball] + 1e-6
    entries = draw.integers(-300, 300, size=(64, 4))
    entries[9] = entries[3]
    allowed = vector_codes.candidates(balls, entries)
    assert allowed.any(1).all() and not allowed[:, 9].any()
    inner = balls.parent >= 0
    assert not (allowed[inner] & ~allowed[balls.parent[inner]]).any()  # lists are inherited
    assert allowed[balls.leaf].sum(1).mean() < 32
    mine = points[balls.order]
    sums, counts, codes = vector_codes.owned(balls, mine, entries)
    want = ((mine[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=64)).all()
    assert all((sums[e] == mine[want == e].sum(0)).all() for e in range(64))


def test_vector_codes_edges(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x", 9) for r in rows], VECTORS)
    assert vector_codes.compress(empty(make([(1, [0.5] * 32, 1)]))).count() == 0
    assert vector_codes.compress(make([(1, None, 1)])).count() == 0
    got = {r.vec_id: r for r in vector_codes.compress(make([(1, [0.5] * 5, 1), (2, [0.25] * 5, 1), (3, [1.0], 1)])).collect()}
    assert got[1].code == "00" * 16 and got[2].error == 0 and got[3].code is None and got[3].error is None
    large = vector_codes.compress(make([(1, [3e38] * 32, 1), (2, [-3e38] * 32, None)])).collect()
    assert {r.error for r in large} == {0} and len({r.code for r in large}) == 2
    assert vector_codes.compress(make([(1, [], 1)])).first().code == "00" * 16


# ---- spelling variants ----

def brute_variants(rows, least_length=6, least_n=5, times=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(beside[w]), words.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("filter_bytes", [32 << 20, 256])
def test_variants_equal_brute_force(spark, filter_bytes):
    draw = random.Random(8)
    stems = ["correct", "spelling", "àéîöü÷ÿword", "Letters", "aaaaaaa", "running", "façades", "STRASSE", "maßstab"]
    rows = []
    for i in range(700):
        words = []
        for _ in range(30):
            w = draw.choice(stems[:1 + i % len(stems)])
            for _ in range(draw.choice([0, 0, 0, 0, 0, 1, 2])):
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1:], w[:at] + draw.choice("eÉz") + w[at + 1:], w[:at] + draw.choice("aß") + w[at:]])
            words.append(w)
        rows.append((i % 650, draw.choice([" ", ", ", "1"]).join(words)))
    want = brute_variants(rows + [e[:2] for e in EDGES], every=7)
    got = spellings.variants(docs(spark, rows + EDGES), every=7, filter_bytes=filter_bytes).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == want
    assert any(w[1] != w[2] for w in want if w[1])  # a chain of forms
    if filter_bytes == 256:
        counts = spark.createDataFrame([(w[0], w[3]) for w in want], "word string, n long")
        assert spellings.layout(counts, filter_bytes).passes > 3


def test_variants_edges(spark):
    assert spellings.variants(empty(docs(spark, EDGES))).count() == 0
    assert spellings.variants(docs(spark, [(1, None), (2, ""), (3, "short words only")])).count() == 0
    long_word = "ab" * 3000
    got = spellings.variants(docs(spark, [(1, f"{long_word} " * 6 + f"{long_word}c " * 30 + "ABABAB " * 5)])).collect()
    assert {(len(r.word), r.form and len(r.form), r.n_near) for r in got} >= {(6000, 6001, 1), (6001, None, 1)}


def test_slip_deletes_the_code_point_of_the_hash():
    run, prefix = "façade", zlib.crc32(b"12:")
    h = zlib.crc32("12:façade".encode())
    assert spellings.slip(prefix, run, 1) == run[:h % 6] + run[h % 6 + 1:]
    assert spellings.slip(prefix, run, h + 1) == run


# ---- SQL ----

@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_vector_codes"])
def test_query_matches_its_sql(spark, duck_small, name):
    assert_same(QUERIES[name](spark, SF_SMALL), duck_small, ORACLE[name])
