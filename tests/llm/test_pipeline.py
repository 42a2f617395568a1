"""Each stage on its own input, and the whole run."""

import corpus_pipeline as P
from barloom.llm import jaccard, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    left = P.near_duplicate_stage(spark, docs, SF)
    found = jaccard.jaccard_components(left)
    assert 0 < left.count() < docs.count() and found.where("component_id <> doc_id").count() == 0
    copies = P.mixing_stage(spark, docs, SF).groupBy("doc_id").count()
    assert copies.where("count > 2").count() == 0 and copies.where("count = 2").count() > 0


def test_run_packs_what_the_stages_keep(spark):
    out = P.run(spark, SF).toPandas()
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_repeated_rows_share_all_their_copies(spark, monkeypatch):
    rows = [(7, "same words here", "a", "en", 15)] * 100 + [(None, f"word{i} word{i}", "a", "en", 11) for i in range(60)] + [(i + 100, f"x y{i} z w", "b", "en", 8) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3).cache()
    mix = P.mixing.mix
    chosen = {}

    def less(d, **_):
        out = mix(d, weights=(3, 1), share=0.6, cap=2.0)
        chosen.update({(r.doc_id, r.source, r.size): r.n for r in out.groupBy("doc_id", "source", "size").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()})
        return out

    monkeypatch.setattr(P.mixing, "mix", less)
    got = P.mixing_stage(spark, docs, SF)
    assert got.columns == docs.columns
    got = got.toPandas()
    n = {"same": int((got["doc_id"] == 7).sum()), "null": int(got["doc_id"].isna().sum())}
    assert 0 < chosen[7, "a", 3] < 100 and 0 < chosen[None, "a", 2] < 60
    assert n == {"same": chosen[7, "a", 3], "null": chosen[None, "a", 2]} and len(got) == sum(chosen.values())
    assert got[got["doc_id"].isna()].groupby("text").size().max() == 1


def test_stages_against_brute_force(spark):
    """The stages that decide by rule, each on its predecessor's rows; the classifier and the mix are tested by accuracy and by targets."""
    docs = P.quality_stage(spark, queries.table(spark, SF, "documents"), SF).cache()
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    words = {i: [w.decode() for w in t.encode().translate(jaccard.LOWER).split()] for i, t in rows.items()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for i, w in words.items()}
    boss = {i: i for i in rows}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                boss[max(p, q)] = min(p, q)
    kept = sorted(i for i in rows if top(i) == i)
    left = P.near_duplicate_stage(spark, docs, SF).cache()
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == kept and len(kept) < len(rows)

    seen, want = set(), {}
    for i in kept:
        data = rows[i].encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        want[i] = bytes(c for c, g in zip(data, gone, strict=True) if not g)
    got = {r.doc_id: r for r in P.repeated_string_stage(spark, left, SF).collect()}
    # a character that loses some of its bytes goes as a whole
    assert all(got[i].text.encode() == t or len(t) - 8 <= len(got[i].text.encode()) < len(t) for i, t in want.items() if rows[i])
    assert all(got[i].n_chars == len(got[i].text or "") for i in kept) and any(len(t) < len(rows[i].encode()) for i, t in want.items())
