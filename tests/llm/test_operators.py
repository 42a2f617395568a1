"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import backoff, chat, jaccard, mixing, neardup, packing, quality, queries, suffix, topk, warc

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n, r):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    base = [prose(r.randint(30, 120), r) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    texts = base + near + base[:3] + [None, "", "one two", "one two", " \n\t ", "a" * 450, prose(4000, r), base[0] + " " + base[1], "é" * 130 + base[2], "X y Z W v", "x Y z w V"]
    return [(i, t, f"s{i % 4}" if i % 5 else None, "en", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # names that the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, source string, batch string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split() if t and not any(ord(c) > 127 for c in t) else [w.decode() for w in (t or "").encode().translate(jaccard.LOWER).split()]


def classes(links, ids):
    boss = {i: i for i in ids}

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        boss[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_jaccard_against_brute_force(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = classes(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert links and got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_of_small_sets_and_of_no_rows(spark, empty):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("pq") for _ in range(r.randint(1, 9)))) for i in range(150)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.split()) >= 5 else {tuple(w)} for i, t in rows}
    want = classes([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_joins_through_rows_without_doc_id_and_counts_links(spark):
    r = random.Random(13)
    w = prose(200, r).split()
    at = lambda *places: " ".join("swapped" + str(i) if i in places else x for i, x in enumerate(w))
    u = prose(100, r).split()
    rows = [(1, at(20, 40, 60, 80)), (None, at()), (None, at()), (3, at(100, 120, 140, 160)), (5, " ".join(u)), (None, " ".join([*u[:-1], "last"])), (None, prose(80, r)), (None, None), (8, prose(70, r))]
    shingle = lambda t: frozenset(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if (x := (t or "").split()) else frozenset()
    sets = [shingle(t) for _, t in rows]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)
    assert linked(sets[0], sets[1]) and linked(sets[1], sets[3]) and not linked(sets[0], sets[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda x: (x[0] is None, x)
    got = sorted(((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in jaccard.jaccard_components(docs).collect()), key=key)
    part = [1, 1, 1, 1, 5, 5, 0, 0, 8]
    assert got == sorted(((i or 0, len(s), c) for (i, _), s, c in zip(rows, sets, part, strict=True)), key=key)
    links = sorted((x.doc_id or 0, x.n_shingles, x.n_links) for x in jaccard.jaccard_links(docs).collect())
    assert links == sorted((i or 0, len(s), sum(linked(s, o) for o in set(sets) - {s})) for (i, _), s in zip(rows, sets, strict=True))
    assert jaccard.jaccard_links(docs.limit(0)).count() == 0


def test_links_inside_a_component_are_counted_too(docs, rows):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w := words(t)) >= 5 else frozenset([tuple(w)] if w else []) for i, t, *_ in rows}
    want = {i: sum(100 * len(s & o) >= 75 * len(s | o) for o in set(sets.values()) - {s} if s and o) for i, s in sets.items()}
    got = {x.doc_id: x.n_links for x in jaccard.jaccard_links(docs).collect()}
    assert got == want and sum(want.values()) > 0


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, "u1")[~gone]) if b else b""
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if b else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(docs).collect()}
    assert got == removed(rows) and sum(x[1] for x in got.values()) > 0


def test_suffix_removal_keeps_other_columns(docs, rows, empty):
    got = {r.doc_id: r for r in suffix.remove(docs).collect()}
    want = removed(rows)
    assert len(got) == len(rows)
    for i, t, s, *_ in rows:
        assert got[i].source == s and (got[i].text == t if not want[i][1] else len((got[i].text or "").encode()) <= want[i][0] - want[i][1])
    assert suffix.digest(empty).count() == 0


@pytest.mark.parametrize("batch", [1, 3000, 8 << 20])
@pytest.mark.parametrize("tasks", [1, 3])
def test_suffix_dedup_of_texts_of_one_id_is_the_same_in_every_batch_size(spark, tmp_path, batch, tasks):
    r = random.Random(11)
    a, b = prose(40, r), prose(40, r)
    rows = [(None, f"one {a}"), (None, f"two {a} end"), (None, f"two {a} end"), (5, f"three {b}"), (5, f"four {b}"), (6, f"{b} six {b}"), (None, f"{b} seven {a} {a}"), (None, prose(60, r))]
    want = []
    for i, t in rows:
        data, gone, seen = t.encode(), np.zeros(len(t), bool), set()
        earlier = {u.encode()[k : k + 100] for j, u in rows if (j if j is not None else 99) < (i if i is not None else 99) for k in range(len(u) - 99)}
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if s in earlier or s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        want.append((i or -1, len(data), int(gone.sum())))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(tasks).mapInPandas(lambda pdfs: pdfs, "doc_id long, text string")
    (tmp_path / "size").write_text(str(batch))
    plain, where = suffix.send_runs, str(tmp_path / "size")

    def small(f):
        def run(*args):
            suffix.BATCH = int(open(where).read())
            return f(*args)

        return run

    doubled, windows = suffix.send_doubled, suffix.send_windows
    suffix.send_runs, suffix.send_doubled, suffix.send_windows = small(plain), small(doubled), small(windows)
    try:
        got = [(x.doc_id or -1, x.n_bytes, x.n_removed) for x in suffix.digest(docs).collect()]
    finally:
        suffix.send_runs, suffix.send_doubled, suffix.send_windows = plain, doubled, windows
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


def test_packing_is_whole_and_gapless(docs, rows, empty):
    from tokenizers import Tokenizer

    path, capacity = queries.tokenizer(), 64
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    got = packing.pack(docs, path, capacity=capacity).collect()
    by = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    assert len(by) <= -(-sum(map(len, ids.values())) // capacity) * 1.1 + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, packing.pack(docs, path, capacity=capacity), path).collect()}
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))
    assert packing.pack(empty, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    path = queries.tokenizer()
    enc, r = packing.WordEncoder(path), random.Random(1)
    odd = ["".join(r.choice("ab é漢\n\t  '.,!?<|endoftext|>12  s't ß") for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["", " ", "a b\n c", "don't 's", "x\ny z", "A%%% b!! |"]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(odd, add_special_tokens=False)]
    assert enc.encode(odd) == want


def test_plan_places_every_piece_once():
    r = random.Random(2)
    for _ in range(30):
        cap = r.choice([7, 30, 100])
        counts = {s: r.randint(1, 40) for s in r.sample(range(1, cap + 1), r.randint(1, min(cap, 20)))}
        fill, ranks = defaultdict(list), defaultdict(set)
        for size, first, n, per, seq, offset in packing.plan(dict(counts), cap):
            for k in range(n):
                ranks[size].add(first + k)
                fill[seq + k // per].append((offset + k % per * size, size))
        assert {s: len(x) for s, x in ranks.items()} == counts and all(x == set(range(len(x))) for x in ranks.values())
        for parts in fill.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= cap


def test_mixing_meets_targets(docs, rows, empty):
    got = mixing.mix(docs, block_rows=5, fan_in=2).collect()
    size = {i: len(words(t)) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == size
    by = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        by[r.source] += r.taken
    for r in got:
        assert r.target <= 2 * r.source_size + 1e-6 and abs(by[r.source] - r.target) <= 2 * max(size[x.doc_id] for x in got if x.source == r.source)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs, block_rows=5, fan_in=2).collect()))
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_both_totals():
    r = random.Random(4)
    chance, size = [r.random() for _ in range(200)], [r.randint(0, 90) for _ in range(200)]
    before = sum(chance), sum(p * s for p, s in zip(chance, size, strict=True))
    mixing.fly(chance, size, r, range(200))
    np.testing.assert_allclose((sum(chance), sum(p * s for p, s in zip(chance, size, strict=True))), before, rtol=1e-6)
    assert sum(1e-9 < p < 1 - 1e-9 for p in chance) <= 2


def test_backoff_against_plain_counts(docs, rows, empty):
    text = {i: words(t) for i, t, *_ in rows}
    counts = Counter(tuple(w[k : k + n]) for w in text.values() for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, text.values()))

    def s(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= 2 else 0.4 * s(gram[1:])

    got = {r.doc_id: (r.n_tokens, r.log_score) for r in backoff.scores(docs).collect()}
    for i, w in text.items():
        want = sum(np.log(s(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert got[i][0] == len(w) and abs(got[i][1] - want) < 1e-6
    assert backoff.scores(empty).count() == 0


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    near = base[:20] + 0.05 * r.normal(size=(20, 16))
    v = np.concatenate([base, near, base[:5]]).astype("float32")
    label = [i % 3 for i in range(60)]
    label += label[:20] + label[:5]
    rows = [(i, [float(y) for y in x], k) for i, (x, k) in enumerate(zip(v, label, strict=True))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [], 0), (905, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in neardup.near_duplicates(df, tile_rows=8).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = [(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if label[a] == label[b] and u[a] @ u[b] >= 0.93]
    comp = classes(links, [x[0] for x in rows])
    degree = Counter(x for pair in links for x in pair)
    assert links and got == {i: (degree[i], comp[i]) for i, *_ in rows}


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 12)) * r.uniform(0.2, 3, size=(300, 1))
    v[10:20] = v[0]  # ties
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(1000, None), (1001, [float("inf")] * 12)]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for x in topk.topk(q, F.col("vec_id") % 50 == 0, k=5, bucket_rows=40, block_rows=3).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    w = np.floor(256 * v).astype(int)
    for i in range(0, 300, 50):
        s = w @ w[i]
        assert got[i] == [(int(j), int(s[j])) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]


def test_chat_round_trip_and_rewritten_history(spark):
    says = "<|im_end|>\n<|im_start|>assistant ok \\| \\n"
    rows = [(1, 0, "user", says), (1, 1, "assistant", says), (1, 2, "assistant", None), (2, 0, None, ""), (2, 0, "assistant", "b"), (None, 1, "user", "x"), *[(3, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(600)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat.format_chats(df, window=16)
    got = {r.conv_id: r for r in chat.digest(f).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not any(r.rewrites_history for r in f.collect())
    last_only = lambda turns: "".join(f"[{r}]" for r, _ in turns[:-1]) + "".join(f"[{r}]{t}" for r, t in turns[-1:])
    assert chat.spans([("user", "a"), ("assistant", "b")], last_only)[3]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality_learns_from_positives_and_unlabelled(spark):
    r = random.Random(9)
    rows = [(i, prose(60, r) if i % 6 else " | ".join(w.upper() + "%%%" for w in prose(40, r).split())) for i in range(600)]
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("taken"))
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.score(docs, labels).collect()}
    right = sum(got[i].predicted == int(i % 6 != 0) for i in range(1, 600, 2))
    assert right / 300 > 0.97 and all(0 <= x.score <= 1 for x in got.values()) and len(got) == 602
    assert {x.score for x in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_revisits(spark):
    h = lambda **k: {x.replace("_", "-"): y for x, y in k.items()}
    rows = [
        (1, "http://www.A.org:80/p/#x", 10, "response", '"a"', None, h(Content_Type="text/html", Date="10")), (2, "https://a.org/p", 200_000, "revisit", 'W/"a"', None, h(Date="20", Content_Length="0")),
        (3, "https://a.org/p", 200_001, "revisit", '"b"', None, {}), (4, "https://a.org/p", 5, "revisit", '"a"', None, {}), (5, None, 30, "revisit", '"a"', None, {}), (6, "https://a.org/p", 200_002, "revisit", None, None, None),
        (7, "https://a.org/p", 200_003, "response", None, "t", None), (8, "https://a.org/p", 200_004, "revisit", None, "t", {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {i: (r.resolution, r.response_id) for i, r in got.items()} == {2: ("resolved", 1), 3: ("mismatch", 1), 4: ("missing", None), 5: ("missing", None), 6: ("unverified", 1), 8: ("resolved", 7)}
    assert got[2].headers == {"content-type": "text/html", "date": "20"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
