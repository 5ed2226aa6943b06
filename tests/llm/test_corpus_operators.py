"""Mixing, WARC, substring dedup, near duplicates, neighbours and the pipeline against brute force."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from microstar.llm import components, mixing, near_dup, neighbours, substrings, warc
from tests.conftest import SF_SMALL
from tests.llm.helpers import EDGES, LONG, WORD, by_id, docs, empty


# ---- mixing ----

def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        per = left / max(1, sum(weight[s] for s in names if s not in capped))
        new = {s for s in names if s not in capped and per * weight[s] > repeats * sizes[s]}
        if not new:
            return {s: repeats * sizes[s] if s in capped else per * weight[s] for s in names}
        capped |= new


def test_mix_meets_targets(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.choice([1, 5, 20, 100])), draw.choice(["a", "b", "B", "é", None, "a"]))
            for i in range(3000)]
    rows += [(5000, None, "zero"), (5001, "", "zero")]
    got = mixing.copies(docs(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 150 + 0.02 * want[s], (s, taken[s], want[s])
    again = mixing.copies(docs(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    assert mixed.count() == sum(r.copies for r in got)


def test_mix_edges(spark):
    got = mixing.copies(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.copies(empty(docs(spark, EDGES))).count() == 0
    assert mixing.mix(docs(spark, EDGES)).count() >= 1


# ---- WARC ----

def test_warc_round_trip(spark):
    same, short = "x" * 1500 + "é", "y" * 500
    pages = [(1, "u1", same), (2, "u 2\r\n", same), (9, None, same), (3, "u", short), (4, "u", short), (5, "u", None),
             (6, "u", ""), (7, "u", "z" * 700_000), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", same), (3, "u", short)]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, sha1 string")
    got = warc.write_and_read(table).collect()
    assert len(got) == len(pages)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        r = [x for x in got if x.page_id == page_id][0]
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest()
        revisit = page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
    assert warc.write_and_read(empty(table)).count() == 0


def test_warc_chunks_carry_running_digests(spark, tmp_path):
    body = "".join(random.Random(2).choice("abc \n") for _ in range(50_000))
    table = spark.createDataFrame([(1, "u", body), (2, "u", "small")], "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write(table, folder, chunk_bytes=4096)
    rows = warc.read(spark, folder, chunk_bytes=4096, with_data=True).where("page_id = 1").orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(13)) and [r.last for r in rows] == [False] * 12 + [True]
    seen = b""
    for r in rows:
        seen += bytes(r.data)
        assert r.running_bytes == len(seen) and r.running_sha1 == hashlib.sha1(seen).hexdigest()
    assert seen.decode() == body


def test_warc_reader_refuses_damage():
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    record = warc._header(1, "u", "response", None, 3, hashlib.sha1(b"abc").hexdigest()) + b"abX\r\n\r\n"
    raw = packed.compress(record) + packed.flush()
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(raw)))


# ---- substring dedup ----

def test_covers_are_difference_covers():
    for period, places in substrings.COVERS.items():
        assert {(a - b) % period for a in places for b in places} == set(range(period))


def brute_dedup(rows, window):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out[doc_id] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_dedup_equals_brute_force(spark):
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = [draw.choice("abcdefgh") + str(draw.randint(0, 40)) for _ in range(draw.randint(0, 80))]
        if i % 3 == 0:
            at = draw.randint(0, len(words))
            cut = draw.randint(0, 30)
            words[at:at] = passage[cut:cut + draw.randint(15, 30)]
        rows.append((i, " ".join(words)))
    rows += [(200, rows[7][1]), (201, " ".join(["for"] * 70)), (202, None), (203, ""), (204, LONG), (205, rows[9][1])]
    got = by_id(substrings.dedup(docs(spark, rows), with_text=True), "n_words", "n_removed", "kept")
    assert got == brute_dedup(rows, 20)


def test_dedup_edges(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [*EDGES, (30, text), (30, text), (None, text), (31, text), (30, "other " + " ".join(f"o{i}" for i in range(30)))]
    got = substrings.dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    removed = Counter((r.doc_id, r.n_words, r.n_removed) for r in got)
    assert removed[(30, 40, 0)] == 2 and removed[(31, 40, 40)] == 1 and removed[(None, 40, 0)] == 1
    assert removed[(30, 31, 0)] == 1
    assert substrings.dedup(empty(docs(spark, rows))).count() == 0


def test_dedup_repeated_rows_in_one_slice(spark):
    text = " ".join(f"v{i}" for i in range(40))
    shifted = "a b c " + text  # another text under the same id, whose equal windows start later
    for first, second in ((text, shifted), (shifted, text)):
        rows = [(30, text), (30, text), (31, text), (31, text), (40, "d " + first), (40, second + " e")]
        got = Counter((r.doc_id, r.kept) for r in substrings.dedup(docs(spark, rows).coalesce(1), with_text=True).collect())
        assert got == Counter({(30, text): 2, (31, ""): 2, (40, "d" if first == text else "d a b c"): 1,
                               (40, "e" if second == text else "a b c e"): 1})
    rows = [(50, shifted), (50, text), (50, text)]  # of different texts with one id the earlier start stays
    for order in (rows, rows[::-1]):
        got = Counter(r.kept for r in substrings.dedup(docs(spark, order).coalesce(1), with_text=True).collect())
        assert got == Counter({text: 2, "a b c": 1})


# ---- near duplicates ----

def brute_components(rows, percent=85, words=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(fold))
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(draw, groups=6, members=25):
    rows, i = [], 0
    for _ in range(groups):
        base = [draw.choice("abcdefghij") + str(draw.randint(0, 500)) for _ in range(draw.randint(8, 160))]
        for _ in range(members):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 30))):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 10 ** 6)}"
            rows.append((i, " ".join(words).upper() if draw.random() < 0.1 else " ".join(words)))
            i += 1
    return rows


@pytest.mark.parametrize("short_list", [64, 3])
def test_near_duplicates_equal_brute_force(spark, short_list):
    draw = random.Random(short_list)
    rows = near_rows(draw)
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two words"), (904, LONG), (905, LONG + " end")]
    like = near_dup.Likeness(short_list=short_list)  # 3: the way of long lists
    got = by_id(near_dup.near_duplicates(docs(spark, rows), like=like), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_of_sets_around_the_sketch_size(spark, percent):
    rows = []
    for n in (62, 63, 64):  # a text that fits its sketch, and the same text with words appended that does not
        for m in range(n + 9, n * 100 // percent + 1):
            for copy in range(4):
                words = [f"{n}x{m}x{copy}x{k}" for k in range(m + 4)]
                rows += [(len(rows), " ".join(words[:n + 4])), (len(rows) + 1, " ".join(words))]
    got = by_id(near_dup.near_duplicates(docs(spark, rows), like=near_dup.Likeness(percent=percent)),
                "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, percent=percent)
    assert sum(kept for _, _, kept in got.values()) == len(rows) / 2


def test_near_duplicates_edges(spark):
    got = near_dup.near_duplicates(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    labels = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert labels[(5, 1, 4, False)] == 2 and labels[(4, 1, 4, True)] == 1 and labels[(1, 0, 1, True)] == 1
    assert labels[(None, 3, 8, False)] == 1
    assert near_dup.near_duplicates(empty(docs(spark, EDGES))).count() == 0
    kept = near_dup.keep_one(docs(spark, EDGES))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (503, 502), (502, 501)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 504)}}


# ---- neighbours ----

def test_neighbours_with_copies_and_invalid_vectors(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 16))
    x[100:200] = x[100]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15),
           (1080, [float("inf")] + [1.0] * 15), (1100, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, node long, code int")
    graph = neighbours.Graph(degree=16, block=100, deals=2, beam=8, visits=16)
    got = defaultdict(dict)
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, answers=10, graph=graph).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        ranked = [found[k] for k in range(1, 11)]
        assert ranked == sorted(ranked, key=lambda v: (-v[1], v[0]))
        for i, s in ranked:
            assert i != q and s == pytest.approx(float(x[i] @ x[q]), abs=1e-9)
        scores = x @ x[q]
        scores[q] = -np.inf
        true = sorted(range(600), key=lambda i: (-round(scores[i], 9), i))[:10]
        hits += len(set(true) & {i for i, _ in ranked})
    assert hits >= 0.95 * 300
    few = table.where("vec_id < 5")
    assert neighbours.nearest(few, F.col("vec_id") == 0, graph=graph).count() == 4
    assert neighbours.nearest(empty(table), F.col("vec_id") == 0, graph=graph).count() == 0


def _recall(found, ids, x, answers=20):
    place = {int(v): i for i, v in enumerate(ids)}
    hits = total = 0
    for q, part in found.groupby("query_id"):
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, answers + 1))
        scores = x @ x[place[q]]
        scores[place[q]] = -np.inf
        least = np.sort(scores)[-answers]
        hits += (scores[[place[v] for v in part.vec_id]] >= least - 1e-9).sum()
        total += answers
    return hits / total


def _sphere(spark, n, width):
    x = np.random.default_rng(8).normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_neighbours_with_default_parameters(spark):
    x, table = _sphere(spark, 4000, 32)
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    assert found.query_id.nunique() == 200 and _recall(found, range(4000), x) >= 0.95


def test_random_links_connect_blocks_of_one_deal(spark):
    x, table = _sphere(spark, 2000, 16)
    graph = neighbours.Graph(degree=16, block=100, deals=1)
    vectors = neighbours.coded(neighbours.nodes_of(neighbours.valid_vectors(table, "vec_id", "embedding"))).persist()
    links = neighbours.random_links(vectors, 2000, graph).persist()
    assert links.count() == 2000 and links.selectExpr("max(size(ids))").first()[0] <= graph.links
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    true = np.argsort(-scores, axis=1)[:, :16]
    lists = {r.node: set(r.ids) for r in neighbours.build(vectors, links, 2000, graph).collect()}
    assert sum(len(lists[i] & set(t.tolist())) for i, t in enumerate(true)) >= 0.9 * true.size


def test_neighbours_ties_at_the_last_rank_and_repeated_rows(spark):
    # ids 1..30 hold one vector: the 20 smallest of them answer, and a repeated row answers once
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, 0.5]) for i in range(1, 31)] + [(0, [1.0, 0.0]), (7, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(i, i, 0.5) for i in range(1, 21)]


def test_whole_groups_never_split_a_key():
    import pyarrow as pa
    draw = random.Random(6)
    for _ in range(200):
        keys = sorted(draw.randint(0, 6) for _ in range(draw.randint(0, 30)))
        batches, at = [], 0
        while at < len(keys):
            n = draw.randint(0, 6)
            batches.append(pa.RecordBatch.from_pydict({"k": pa.array(keys[at:at + n], pa.int64())}))
            at += n
        tables = [t.column("k").to_pylist() for t in neighbours.whole_groups(iter(batches))]
        assert sum(tables, []) == keys
        seen = [set(t) for t in tables]
        assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])


# ---- pipeline ----

def test_pipeline_stages(spark):
    import corpus_pipeline
    from microstar.llm.common import table, written
    before = table(spark, SF_SMALL, "documents")
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SF_SMALL), f"test-{name}")
        frames[name] = (before, after)
        if name != "encode":
            assert after.columns == before.columns
        before = after
    ids = lambda frame: Counter(r.doc_id for r in frame.select("doc_id").collect())
    docs_in, clean = frames["toxicity"]
    assert not ids(clean) - ids(docs_in)
    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    want = {i for i, (_, _, kept) in brute_components(rows, percent=80).items() if kept}
    assert set(ids(frames["near_dedup"][1])) == want
    assert ids(frames["secrets"][1]) == ids(frames["secrets"][0])
    assert set(ids(frames["mix"][1])) <= set(ids(frames["mix"][0]))
    encoded = frames["encode"][1]
    assert encoded.count() == frames["mix"][1].count() and encoded.where("NOT library_agrees").count() == 0


def test_pipeline_drops_toxic_documents_of_a_small_table(spark):
    import corpus_pipeline
    from microstar.llm.common import table
    before = table(spark, SF_SMALL, "documents")
    toxic = {r.doc_id for r in table(spark, SF_SMALL, "labels").where("toxic = 1").collect()}
    toxic &= {r.doc_id for r in before.select("doc_id").collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, before, SF_SMALL).select("doc_id").collect()}
    assert toxic and not toxic & left and len(left) >= 0.7 * before.count()
