"""Edge cases of single operators and stages: repeated rows, null keys, clashing names, hot keys and other templates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from barloom.llm import backoff, chat, jaccard, mixing, neardup, packing, quality, queries, suffix, topk, warc

SF = "/root/testdata/sf0.001"
W = random.Random(21)
WORDS = ["".join(W.choice("klmnopqrst") for _ in range(W.randint(2, 7))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, rows, extra="row string, n long, class_id string, gone_id long, copies long"):
    """Documents with columns whose names the stages use themselves."""
    more = ("x", 1, "c", 2, 3)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *more) for i, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


# op2


def test_planted_links_at_the_threshold_are_found(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = r.uniform(0.9301, 0.94, size=(1500, 1))
    v = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    rows = [(i, x.tolist(), int(i % 1500 % 2)) for i, x in enumerate(v)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile_rows=300).toPandas()
    assert (got["n_links"] >= 1).mean() >= 0.999  # measured: every one of the 3,000


def test_near_duplicates_of_repeated_ids_clashing_names_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], None)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node string, dim int, tile int")
    got = sorted(tuple(-1 if x is None else int(x) for x in r) for r in neardup.near_duplicates(df).select("vec_id", "n_links", "component_id").collect())
    assert got == [(-1, 0, -1), (1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


# op3


def test_mixing_comes_within_a_hundredth_and_shares_copies_among_rows_alike(spark):
    r = random.Random(2)
    rows = [(i, prose(int(r.paretovariate(0.9) * 4) % 3000 + 1, r), f"s{i % 3}") for i in range(900)] + [(None, "one two three", "s1")] * 700 + [(2**60 + 1, "big id", "s0")]
    mix = mixing.mix(table(spark, rows), weights=(3, 1, 2), share=0.6, block_rows=100, many=64)
    assert mix.where(F.col("doc_id") == 2**60 + 1).count() == 1
    got = mix.toPandas()
    assert len(got) == len(rows)
    assert (got["taken"] == got["copies"] * got["size"]).all() and got["copies"].between(0, 2).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by["taken"] - by["target"]) <= 0.01 * by["target"]).all()
    hot = got[got["doc_id"].isna()]
    chance = float((hot["target"] / hot["source_size"]).iloc[0])
    assert len(hot) == 700 and abs(hot["copies"].sum() - 700 * chance) <= 1


# op4


def test_quality_learns_where_every_document_is_labelled(spark):
    r = random.Random(9)
    rows = [(i, prose(60, r) if i % 3 else "| " * 80, "s") for i in range(400)] + [(7, prose(50, r), "s")] * 30 + [(None, prose(20, r), "s")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)] + [(None, 1)], "doc_id long, quality int")
    got = quality.score(table(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got["score"].nunique() > 10
    known = got[got["doc_id"].notna()]
    assert (known["predicted"] == (known["doc_id"] % 3 != 0)).mean() > 0.97
    assert quality.score(table(spark, rows).limit(0), labels).count() == 0


# op5


def test_text_spans_of_any_template(spark):
    bracket = lambda turns: "".join(f"[{r}]{t}" for r, t in turns)
    stripped = lambda turns: "".join(f"<{r}> {t.strip()} </{r}>" for r, t in turns)
    hidden = lambda turns: "".join(f"({r}:{t})" if k == len(turns) - 1 or r != "assistant" else f"({r}:...)" for k, (r, t) in enumerate(turns))
    counted = lambda turns: "".join(f"{r} {len(t)} {t}\n" for r, t in turns)
    turns = [("user", "user"), ("assistant", " ok user "), ("user", ""), ("assistant", "user")]

    def texts(template):
        out, _, found, rewritten = chat.spans(turns, template)
        return [None if t is None else out[t[0] : t[1]] for t in found], rewritten

    assert texts(bracket) == ([t for _, t in turns], False)
    assert texts(stripped) == ([t.strip() for _, t in turns], False)
    assert texts(hidden) == (["user", None, "", "user"], True)
    assert texts(counted) == ([None, None, None, "user"], False) or texts(counted)[1] is False
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df, bracket).where("conv_id is not null").collect()}
    assert [got[1].formatted[t.text_begin : t.text_end] for t in got[1].turns] == [t for _, t in turns]
    assert chat.format_chats(df).where("conv_id is null").count() == 2  # conversations of their own


def test_a_template_that_wrongly_calls_itself_local_is_compared_over_its_whole_history():
    def first_only(turns):
        return "".join(f"[{'' if i else '#'}{r}]{t}" for i, (r, t) in enumerate(turns))

    first_only.turn_local = True
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(9)]
    out, found, texts, rewritten = chat.spans(turns, first_only, window=3)
    assert out == first_only(turns) and not rewritten and [out[a:b] for a, b in texts] == [t for _, t in turns]
    assert chat.spans(turns, window=3)[0] == chat.chatml(turns)


def test_a_very_long_conversation_text(spark):
    long = "word \\ <|im_end|> " * 60_000
    got = chat.digest(chat.format_chats(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == 2 and got.loss_chars == len(long)


# op6


def test_backoff_counts_repeated_rows_and_keeps_them(spark):
    rows = [(1, "a b c a b c", "s")] * 40 + [(None, "a b d", "s"), (None, "a b d", "s"), (None, None, "s"), (2, "", "s"), (3, "zz", "s")]
    got = backoff.scores(table(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got["doc_id"] == 1).sum() == 40 and got["doc_id"].isna().sum() == 3
    total = 40 * 6 + 6 + 1
    # a: 82 of all; b follows a always: 82 / 82; d after a b: 2 of 82
    want = np.log(82 / total) + np.log(82 / 82) + np.log(2 / 82)
    assert np.allclose(got[got["doc_id"].isna() & (got["n_tokens"] == 3)]["log_score"], want)
    assert got[got["doc_id"] == 2]["n_tokens"].tolist() == [0]


# op7


def test_revisits_of_headers_that_differ_in_case_and_of_repeated_rows(spark):
    rows = [(1, "http://a.org/p", 10, "response", "x", None, {"Date": "1", "date": "2", "Via": None})] * 2 + [(2, "http://a.org/p", 90_000, "revisit", "x", None, {"ETag": "x", "etag": "y"})] * 2 + [(None, "http://a.org/p", 5, "revisit", "x", None, None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, full string, bucket int")
    got = warc.resolve_revisits(df).collect()
    assert sorted((r.record_id or 0, r.resolution) for r in got) == [(0, "missing"), (2, "resolved"), (2, "resolved")]
    assert all(r.headers == {"date": "2", "via": "", "etag": "y"} for r in got if r.record_id)
    urls = spark.createDataFrame([("http://www.A.org:80/p/?ref=1&ref=2",), ("https://a.org/p?ref=3&x=1&ref=4&y=2&#f",), ("a.org",), ("a.org/?&ref=5",), ("a.org/p?xref=1",)], "u string")
    assert [r[0] for r in urls.select(warc.canonical_url(F.col("u"))).collect()] == ["a.org/p", "a.org/p?x=1&y=2", "a.org", "a.org", "a.org/p?xref=1"]
    joined = spark.sql("select map('Via', 'a', 'via', 'b', 'Vary', 'x', 'DATE', '1', 'Date', '2') as m")
    assert joined.select(warc.one_case(F.col("m"))).first()[0] == {"date": "2", "vary": "x", "via": "a, b"}


# op8


def test_topk_takes_every_row(spark):
    rows = [(1, [9.0, 9.0]), (1, [3.0, 1.0]), (None, [20.0, 0.0]), (50, [1.0, 1.0]), (50, [2.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "vec_id long, embedding array<double>, level string, row int, norm int")
    q = topk.quantised(df, 1.0)
    for size in (1, 2, 100):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.topk(q, F.col("vec_id") % 50 == 0, k=3, bucket_rows=size).collect()]
        assert sorted(got, key=repr) == sorted([(50, 1, None, 20), (50, 2, 1, 18), (50, 3, 1, 4), (50, 1, None, 40), (50, 2, 1, 18), (50, 3, 1, 6)], key=repr)
    assert topk.topk(q.limit(0), F.col("vec_id") % 50 == 0).count() == 0 and topk.topk(q, F.lit(False)).count() == 0


def test_topk_on_many_lengths_against_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(1200, 8)) * 2.0 ** r.integers(-3, 4, size=(1200, 1))
    v[100:600] = v[100] * np.sign(r.normal(size=(500, 1)))  # one length for most
    q = topk.quantised(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    w = np.floor(256 * v).astype(int)
    got = {}
    for x in topk.topk(q, F.col("vec_id") % 50 == 0, bucket_rows=64, block_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for i in range(0, 1200, 50):
        s = w @ w[i]
        assert got[i] == [(j, int(s[j])) for j in sorted((j for j in range(1200) if j != i), key=lambda j: (-s[j], j))[:5]]


# op9


def test_near_copies_that_straddle_the_threshold(spark):
    r = random.Random(17)
    base, line = prose(60, r).split(), prose(40, r)
    rows = [(i, " ".join(w if r.random() > 0.035 else f"x{r.randint(0, 9**9)}" for w in base), "s") for i in range(150)]
    rows += [(200 + i, f"{line} {prose(r.randint(5, 14), r)}", "s") for i in range(60)]
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t, _ in rows for w in [t.split()]}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    boss = {i: i for i in sets}

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        boss[max(p, q)] = min(p, q)
    docs = table(spark, rows).select("doc_id", "text")
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs).collect()} == {i: top(i) for i in sets} and len({top(i) for i in sets}) > 20
    want = {i: sum(100 * len(s & o) >= 75 * len(s | o) for o in set(sets.values()) - {s}) for i, s in sets.items()}
    assert {x.doc_id: x.n_links for x in jaccard.jaccard_links(docs).collect()} == want


# op1 and op10


def test_packing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "same text", "s")] * 500 + [(None, "same text", "s")] * 100 + [(None, None, "s")]
    got = packing.pack(table(spark, rows), queries.tokenizer(), capacity=64).toPandas()
    assert len(got) == 601 and not got.duplicated(["sequence_id", "offset"]).any()
    for _, p in got.sort_values("offset").groupby("sequence_id"):
        assert p["offset"].tolist() == np.append(0, np.cumsum(p["length"])[:-1]).tolist() and p["length"].sum() <= 64


def test_common_short_strings_in_many_texts(spark):
    r = random.Random(31)
    phrase, passage = "many words that are common to all of them", prose(30, r)
    rows = [(i, f"{prose(20, r)} {phrase} {prose(20, r)} {passage[i % 7 :]} {prose(5, r)}") for i in range(80)] + [(90, f"{passage} {passage}"), (None, passage)]
    seen, want = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i] = int(gone.sum())
    assert {x.doc_id: x.n_removed for x in suffix.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


# stages


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    a, b, c = (prose(80, r) for _ in range(3))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, None), (5, c, "t"), (5, c, "t"), (None, a + " tail", "s"), (None, None, None), (8, "", "t"), (9, " ", "u"), (None, c[:-1], "s"), (11, prose(9000, r), "u")]
    return table(spark, rows)


def test_near_duplicate_stage_decides_by_row(spark, odd):
    got = P.near_duplicate_stage(spark, odd, SF)
    assert got.columns == odd.columns
    rows = sorted((r.doc_id or 0, len((r.text or "").split())) for r in got.collect())
    # copies of a and c go, also those without id; text b stays though its doc_id has a copy of a; one of the equal rows stays
    assert rows == [(0, 0), (1, 80), (2, 80), (5, 80), (8, 0), (9, 0), (11, 9000)]


def test_stages_take_odd_and_empty_tables(spark, odd):
    for name, stage in P.STAGES[:-1]:
        got, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
        assert got.columns == odd.columns and got.count() <= 2 * odd.count() and none.count() == 0, name
    assert P.packing_stage(spark, odd, SF).select("doc_id", "piece").count() >= odd.count()
