"""The prefix trie, the Merkle manifest and exact duplicates against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact, merkle, queries, shared, trie

SF = "/root/testdata/sf0.001"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# op11


def brute_trie(rows, shared_starts):
    of = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in of.items()}
    convs = own
    if shared_starts:
        convs = {}
        for c, v in own.items():
            h, base = zlib.crc32(str(c).encode()) % 6, c - int(c % 100 if c >= 0 else -(-c % 100))
            convs[c] = own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = set()
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for x in nodes:
        if x:
            kids[x[:-1]] += 1
    for x, m in nodes.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not kids[x]
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1]) if x else 0
    for x, m in nodes.items():
        ends = sorted(c for c in m if len(convs[c]) == len(x))
        out.add((min(m), len(x), min(nodes[x[:-1]]) if x else None, len(m), kids[x], leaves[x], saved[x], sha(",".join(map(str, ends)))))
    return out


def got_trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, sid string, depth int, k1 int").repartition(3)
    got = [tuple(r) for r in trie.conversation_trie(df, **how).select(*TRIE).collect()]
    assert len(got) == len(set(got))
    return set(got)


def talks(seed, n, letters="ab", most=9):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, i, "user" if i % 2 else "assistant", "".join(r.choice(letters) for _ in range(r.randint(0, 1)))) for i in range(r.randint(1, most))]
    return rows


def test_trie_with_shared_starts_odd_rows_and_several_batches(spark):
    rows = talks(2, 330, "abc", 8)
    rows = [r for r in rows if r[0] not in (100, 7)]  # a base that is absent
    rows += [(7, None, None, None), (7, 3, "user", "last"), (7, 3, "user", "last"), (None, 0, "user", "no id"), (9_000_000_000_000, 1, "", "ñ" * 3), (-5, 0, "user", "minus"), (-205, 0, "user", "minus")]
    assert got_trie(spark, rows, batches=(0.1, 0.4, 1.0)) == brute_trie(rows, True)


def test_trie_of_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "CHUNK", 8)
    r = random.Random(4)
    long = [(1, i, "user", r.choice("xy")) for i in range(150)]
    rows = [(500 + k, i, "user", t) for k in range(40) for i, t in enumerate("hot talk")] + long
    rows += [(2 + k, i, ro, t if i < 30 + 20 * k else "other") for k in range(5) for _, i, ro, t in long[: 40 + 20 * k]]
    rows += [(30, 0, "user", "q" * 200_000), (31, 0, "user", "q" * 200_000), (31, 1, "user", "more")]
    want = brute_trie(rows, False)
    assert any(n[3] == 40 and n[7] == sha(",".join(str(500 + k) for k in range(40))) for n in want)
    assert got_trie(spark, rows, shared_starts=False, batches=(0.4, 1.0)) == want


def test_trie_joins_hot_keys_without_broadcasting_the_trie(spark, monkeypatch):
    join = shared.hot_join
    monkeypatch.setattr(trie, "hot_join", lambda left, right, keys, how="inner", scratch=None, rows=None: join(left, right, keys, how, scratch, share=20, few=0))
    rows = talks(6, 150)
    assert got_trie(spark, rows, shared_starts=False, batches=(0.3, 1.0)) == brute_trie(rows, False)


def test_trie_of_nothing(spark):
    assert got_trie(spark, [(None, 1, "user", "x")]) == set()


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    rows = [(c, i, "user", "t") for c in range(101, 108) for i in range(1)]  # base 100 is absent
    want = brute_trie(rows, True)
    assert any(n[1] == 0 and n[7] != sha("") for n in want)
    assert got_trie(spark, rows) == want


# op12


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold_all(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([sha("".join(n[i : i + 2])) for i in range(0, len(n), 2)])
    return levels


def brute_manifest(rows):
    groups = {}
    for r in rows:
        leaf = sha("".join(map(field, r)))
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf, r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: fold_all([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in langs}
    top = fold_all([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            touched = r[3] + 1 if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[3]
            node, proof = sha("".join(map(field, (*r[:3], touched, r[4])))), ""
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    node, proof, at = sha(other + node if at & 1 else node + other), proof + other, at >> 1
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=repr), trees


def dataset(n, seed, langs=("en", "de", None, "", "zh")):
    r = random.Random(seed)
    rows = [(i, r.choice(["s", None, "web"]), r.choice(langs), r.choice([None, r.randint(0, 99)]), r.choice(["text", None, "", "ä§ 漢"])) for i in range(n)]
    return rows + [(None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id"), (3, "again", "de", 3, "x"), (n, "s", "only", 5, "lone"), (n + 1, "s", "de", 5, "very long " * 50_000)]


@pytest.mark.parametrize("levels", [2, 8])
def test_manifest_against_brute_force(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = dataset(75, 3)
    spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want, _ = brute_manifest(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("levels", [2])
def test_log_is_in_postorder_without_gaps(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    df = spark.createDataFrame([(i, "a" if i < 45 else "b") for i in range(62)], "i long, g string")
    found = merkle.manifest(df, merkle.leaf(F.col("i")), F.col("g"), ["i"], [F.col("i")])
    log = sorted((r.tree, r.position, r.height, r.digest) for r in found.log().collect())

    def postorder(levels, h, i):
        if h:
            yield from postorder(levels, h - 1, 2 * i)
            if 2 * i + 1 < len(levels[h - 1]):
                yield from postorder(levels, h - 1, 2 * i + 1)
        yield h, levels[h][i]

    want = []
    for g, ids in (("+a", range(45)), ("+b", range(45, 62))):
        tree = fold_all([sha(field(i)) for i in ids])
        want += [(g, k, h, d) for k, (h, d) in enumerate(postorder(tree, len(tree) - 1, 0))]
    assert log == want
    proofs = found.proofs().select("i", merkle.fold(F.col("leaf"), F.col("path")).alias("again"), "root", F.size(merkle.siblings(F.col("path"))).alias("n")).collect()
    assert len(proofs) == 62 and all(r.again == r.root and r.n >= 2 for r in proofs)


def test_manifest_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(5, None)], "i long, g string")
    make = lambda d: merkle.manifest(d, merkle.leaf(F.col("i")), F.col("g"), ["i"], [F.col("i")])
    assert make(df.limit(0)).proofs().count() == 0
    one = make(df).proofs().first()
    assert one.leaf == one.subroot == one.root == sha("1:5") and bytes(one.path) == b""


# op13


def brute_exact(rows):
    of = {}
    for k, (i, t) in enumerate(rows):
        of.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for text, group in of.items():
        best = min(group)
        out += [(rows[k][0], rows[best[3]][0], len(group), sha(text)) for *_, k in group]
    return sorted(out, key=repr), len(of)


@pytest.mark.parametrize("content_hash", [F.md5, lambda t: (F.char_length(t) % 3).cast("string")])
@pytest.mark.parametrize("few", [0, 100_000])
def test_exact_duplicates_against_brute_force(spark, monkeypatch, content_hash, few):
    join = shared.hot_join
    monkeypatch.setattr(exact, "hot_join", lambda left, right, keys: join(left, right, keys, share=4, few=few))
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 4))) + " " * r.randint(0, 2)) for i in range(120)]
    rows += [(i, "hot\ttext") for i in range(500, 600)] + [(700, "hot text "), (None, "hot text "), (None, None), (800, None), (801, " "), (802, " \x0b\x0c\r\n\t"), (-(2**63), "edge"), (2**63 - 1, "edge"), (900, "z" * 300_000), (901, "z " * 300_000), (3, "same"), (3, "same"), (3, "same")]
    df = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "doc_id long, text string, h string, n int, row int").repartition(5)
    got = exact.exact_duplicates(df, content_hash=content_hash).collect()
    want, groups = brute_exact(rows)
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=repr) == want
    kept = [x for x in got if x.kept]
    assert len(kept) == groups and all(x.doc_id == x.keep_id for x in kept)
    assert exact.exact_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("key", ["op11_prefix_trie", "op12_merkle_manifest", "op13_exact_dedup"])
def test_same_rows_as_sql(spark, key):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[key](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.ORACLES[key]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)
