"""The numbered operators against brute force, round trips, held-out accuracy and small odd cases."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, language, lattice_lm, minhash, notices, pivot_search, queries, sentencepiece_codec, toxicity, url_filters
from tidemark.llm.common import words_of

DOCS = "doc_id bigint, text string, extra string"
ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", "b"), (4, "one", None), (4, "one", None), (5, "é ü ñ 漢字 \U0001f600", "x"), (6, "<0x0A> ▁▁ a  b </s>", "x"), (7, "lorem ipsum " * 30_000, "long")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# 1
def test_encoding_equals_the_library(spark, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    rows = odd.distinct().collect()
    out = {r.doc_id: r for r in sentencepiece_codec.round_trip(odd, queries.vocabulary()).collect()}
    for r in rows:
        ids = sp.encode(r.text or "") + [sp.eos_id()]
        got = out[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.round_trip(empty, queries.vocabulary()).count() == 0
    back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(odd, queries.vocabulary(), add_end=False), queries.vocabulary())
    assert {r.text for r in back.where("doc_id = 5").collect()} == {ODD[5][1]}


def test_agendas_need_no_correction():
    codec = sentencepiece_codec.Codec(queries.vocabulary())
    rng = random.Random(3)
    alphabet = "abcdeftionhs ▁.,\n\t漢éß0\x00" + chr(0x1F600)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 90))) for _ in range(3000)] + ["ab" * 500]
    for text, (ids, _) in zip(texts, codec.encode(texts), strict=True):
        assert ids == codec.library.encode(text), repr(text)
    assert codec.corrected == 0


def test_a_broken_agenda_is_put_right_for_all_chunks(monkeypatch):
    """A unit or tail with wrong ids is corrected where it is first met, and so in every later chunk that holds it."""
    codec = sentencepiece_codec.Codec(queries.vocabulary())
    right = codec._agenda
    monkeypatch.setattr(codec, "_agenda", lambda units: {u: (5,) if u.endswith("house") or u == "." else ids for u, ids in right(units).items()})
    for texts in (["the house."], ["a house, the tree.", "house. house"], ["house.", "tree."]):
        for text, (ids, _) in zip(texts, codec.encode(texts), strict=True):
            assert ids == codec.library.encode(text), text
    assert codec.corrected and all(v != (5,) for k, v in codec.units.now.items() if k.endswith("house"))


def test_models_that_chunks_do_not_fit_are_refused(spark, monkeypatch):
    model = queries.vocabulary()
    assert sentencepiece_codec.check(model) is None
    monkeypatch.setattr(sentencepiece_codec, "_checked", set())
    monkeypatch.setattr(sentencepiece_codec.Codec, "chunks_of", lambda self, text: text.split())  # as if white space were squeezed
    assert sentencepiece_codec.check(model) is not None
    monkeypatch.undo()
    sentencepiece_codec.checked(spark, model)
    assert model in sentencepiece_codec._checked


# 2
def top_k_by_force(rows, k):
    """(query id, results) of each query row."""
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(ok):
        if i % 100 == 0:
            dot = lambda w: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True))))  # noqa: E731, B023
            best = sorted((-dot(w), j) for n, (j, w) in enumerate(ok) if n != at and len(w) == len(v))[:k]
            out.append((i, [(j, -s) for s, j in best]))
    return sorted(out)


def found_top_k(df, **options):
    got = defaultdict(list)
    for r in pivot_search.top_k(pivot_search.scaled(df), F.col("id") % 100 == 0, k=10, **options).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    return got


def test_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(20)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, []), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1104, [3.0, 1.0]), (1200, [1e12] * 8)]
    rows += [(2000 + d, [float(d % 7)] * (10 + d)) for d in range(70)] + [(2100, [float(x) for x in range(70)]), (2101, [2.0] * 70)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "vec_id bigint, embedding array<double>, row string, block int")
    for options in ({"block": 64, "query_block": 3}, {}):
        got = found_top_k(df, **options)
        want = top_k_by_force(rows, 10)
        assert {q: [(d, s) for _, d, s in sorted(x)] for q, x in got.items()} == {q: x for q, x in want if x}
    assert found_top_k(df.limit(0)) == {}


def test_top_k_of_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(100, [1.0, 1.0])] * 3 + [(i, [rng.random(), rng.random()]) for i in range(1, 12)] + [(200, [1.0, 0.5])] + [(7, [5.0, 5.0])] * 2
    got = found_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=4, query_block=2)
    want = defaultdict(list)
    for q, x in top_k_by_force(rows, 10):
        want[q] += [(at + 1, d, s) for at, (d, s) in enumerate(x)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_top_k_copies_queries_once_for_each_part(spark, monkeypatch):
    met, searched = [], pivot_search._searched
    monkeypatch.setattr(pivot_search, "_searched", lambda df, k, thresholds: met.append(df.count()) or searched(df, k, thresholds))
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(3000)]
    vectors = pivot_search.scaled(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1))
    got = defaultdict(list)
    for r in pivot_search.top_k(vectors, F.col("id") % 100 == 0, k=10, block=16, query_block=1).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {q: [(d, s) for _, d, s in sorted(x)] for q, x in got.items()} == dict(top_k_by_force(rows, 10))
    blocks, parts = 188, 6 * spark.sparkContext.defaultParallelism
    assert met[-1] <= blocks + 30 * parts < blocks * 30  # pairs of blocks with blocks are never rows


def by_force(x, q, k, own):
    score = x.astype(object) @ q.astype(object)
    return [(int(-s), int(j)) for s, j in sorted((-min(max(int(s), -(1 << 63)), (1 << 63) - 1), j) for j, s in enumerate(score) if j != own)[:k]]


def test_slabs_of_far_candidates_are_left_out(monkeypatch):
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 4000, (40, 16))
    clustered = np.floor(centers[rng.integers(0, 40, 4000)] + rng.normal(0, 50, (4000, 16)))
    copies = np.repeat(np.floor(rng.normal(0, 900, (4, 16))), 300, 0)
    huge = np.floor(rng.normal(0, 1e12, (300, 16)))  # beyond what doubles hold
    beyond = np.full((40, 16), 2.0**62) * rng.choice([-1, 1], (40, 1))  # scores beyond 64 bits
    zero = np.zeros((30, 16))
    for x, most in ((clustered, 0.5), (copies, 1), (huge, 1), (beyond, 1), (np.concatenate([clustered[:500], huge, beyond, zero]), 1), (np.concatenate([huge * 1e5, zero, clustered[:500]]), 1), (zero, 1)):
        ids, asks = np.arange(len(x)), np.arange(0, len(x), 7)
        met, slab = [], pivot_search.Queries._slab
        monkeypatch.setattr(pivot_search.Queries, "_slab", lambda self, a, at, *rest: met.append(len(at)) or slab(self, a, at, *rest))  # noqa: B023
        q = pivot_search.Queries(asks, asks, x[asks], np.full(len(asks), -np.inf), x[:32], 10)
        slabs = 0
        for a in range(0, len(x), 1000):
            c = pivot_search.Candidates(ids[a : a + 1000], ids[a : a + 1000], x[a : a + 1000], x[:32], 10, slab=32)
            slabs += len(c.starts)
            q.search(c)
        q.end()
        monkeypatch.undo()
        assert sum(met) <= most * slabs * len(asks)
        for n, at in enumerate(asks):
            assert list(zip(q.score[n, : q.count[n]].tolist(), q.found[n, : q.count[n]].tolist(), strict=True)) == by_force(x, x[at], 10, at)


# 3
def test_url_filters_are_as_of(spark):
    events = spark.createDataFrame([("block", "d:example.com", 10, "add"), ("block", "d:example.com", 20, "remove"), ("block", "d:example.com", 20, "add"), ("allow", "p:a.example.com/x", 12, "add"), ("block", None, 1, "add")], "list string, key string, day bigint, op string")
    rows = [(1, "http://A.example.com:80/y?q", 9), (2, "http://a.example.com/y", 10), (3, "http://u@a.example.com./x/z", 12), (4, "http://a.example.com/xz", 19), (5, "http://example.com", 20), (6, None, 15), (7, "nothing", 15), (8, "http://notexample.com/", 15), (2, "http://a.example.com/y", 10)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, fetch_day bigint").withColumn("key", F.lit("clash"))
    out = [(r.page_id, r.verdict, r.rule) for r in url_filters.filtered(pages, events).orderBy("page_id").collect()]
    none = url_filters.filtered(pages, events.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allowed"}
    assert url_filters.filtered(pages.limit(0), events).count() == 0 and url_filters.url_report(pages.limit(0)).count() == 0
    assert out == [(1, "allowed", None), (2, "blocked", "d:example.com"), (2, "blocked", "d:example.com"), (3, "allowed", "p:a.example.com/x"), (4, "blocked", "d:example.com"), (5, "allowed", None), (6, "allowed", None), (7, "allowed", None), (8, "allowed", None)]


def test_hosts(spark):
    urls = ["http://[::1]/a", "http://u@[::FFFF:1.2.3.4]:80/", "http://user@evil@Example.com:8/x@y", "https://a.b./", "ftp://", "http://x?@y", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(url_filters.host_of("url")).collect()] == ["[::1]", "[::ffff:1.2.3.4]", "example.com", "a.b", "", "x", None]
    assert df.select(url_filters.keys_of("url")).collect()[1][0] == ["d:[::ffff:1.2.3.4]"]


# 4
def components_by_force(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c")]
    base = words(rng, 150).split()
    for i in range(150):  # one large group of near copies, from no edit to many
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(40)}"
        rows.append((100 + i, " ".join(copy)))
    passage = words(rng, 60)
    for i in range(60):  # a shared passage, and pairs of near copies that share it
        text = f"{words(rng, 40)} {passage} {words(rng, 40)}"
        rows += [(400 + 2 * i, text), (401 + 2 * i, text.replace(text.split()[5], "zz", 1))]
    rows += [(700 + i, rows[10][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=4).collect()}
    want = components_by_force(rows, 4, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and all(r.kept for r in out)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z")], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "extra"]


def test_near_duplicates_are_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "x")
    rows = [(1, long), (2, near), (2, "something else that links with nothing"), (None, near), (None, None), (3, long), (3, long)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, n string, key int")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=4).collect()), key=str)
    assert out == sorted([(1, 57, 1, True), (2, 57, 1, False), (2, 3, 2, True), (None, 57, None, None), (None, 0, None, None), (3, 57, 1, False), (3, 57, 1, False)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in minhash.deduplicated(df, size=4).collect()), key=str)
    assert kept == sorted([(1, long), (2, rows[2][1]), (None, near), (None, None)], key=str)


def test_mates_of_a_pool_of_paragraphs_meet_in_bounded_pairs(spark):
    rng = random.Random(14)
    # 600 mates of one center, each with 8 of 40 paragraphs of 20 shingles beside it, and some near copies of mates
    chosen = [sorted(rng.sample(range(40), 8)) for _ in range(600)]
    chosen += [sorted({*c[:7], rng.randrange(40)}) for c in chosen[:50]]
    star = [(0, i + 1, 100, 100 + 20 * len(c), 100, [20 * p + k for p in c for k in range(20)]) for i, c in enumerate(chosen)]
    df = spark.createDataFrame(star, "a bigint, b bigint, n_a bigint, n_b bigint, common bigint, outside array<bigint>")
    labels = spark.createDataFrame([], "doc bigint, component bigint")
    got = {(r.a, r.b) for r in minhash.beyond_stars(df, labels, 80).collect()}
    want = set()
    for i, x in enumerate(chosen):
        for j, y in enumerate(chosen[:i]):
            both, n = 100 + 20 * len({*x} & {*y}), 200 + 20 * len(x) + 20 * len(y)
            if 180 * both >= 80 * n:
                want.add((j + 1, i + 1))
    assert len(want) >= 50 and want <= got and len(got) < len(chosen) ** 2 / 2 / 3


def test_densified_bins_agree_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (10, 100, 1000):
        agree = []
        for _ in range(40):
            v = rng.integers(0, 1 << 62, n + n // 4, dtype=np.uint64)
            a, b = minhash.densified(np.sort(v[:n]), 180), minhash.densified(np.sort(v[n // 4 :]), 180)
            agree.append((a == b).mean())
        true = (n - n // 4) / (n + n // 4)
        assert abs(np.mean(agree) - true) < 0.06


# 5
def test_chat_reads_back_any_text(spark):
    tricky = ["<|im_end|>\n<|im_start|>user\n", "&lt;s>", "&amp;lsqb;INST] [INST]", "</s><s>", "\\ $1 \n\n", "", None, "&lf;"]
    rows = [(i, t, role, x) for i, x in enumerate(tricky) for t, role in enumerate(["user", "assistant", "we\nird", None])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    records = chat.canonical(chat.records_of(chat.whole_conversations(df)), "conv_id", "record")
    texts = chat.formatted(records, "conv_id")
    back = {r.conv_id: r for r in chat.read_back(texts, "conv_id").collect()}
    for i, x in enumerate(tricky):
        assert [(t.role, t.text) for t in back[i].turns] == [(r, x or "") for r in ("user", "assistant", "we\nird", "")]
        assert back[i].loss_text == (x or "")
    assert not texts.where("formatted like '%</s>%' or formatted like '%[INST]%'").count()


def test_chat_of_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, key string, m string, record string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.chat_report(df).collect()}
    assert out == {1: (2, 0), 2: (1, 0), None: (1, 1), 3: (1, 0)}
    assert chat.chat_report(df.limit(0)).count() == 0


def test_chat_cuts_turns_once(spark):
    df = spark.createDataFrame([(1, "a", [None])], "conv_id bigint, formatted string, loss_mask array<struct<start: bigint, length: bigint>>")
    assert chat.read_back(df, "conv_id")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_chat_loses_no_conversation(spark, monkeypatch):
    # more than a variant holds in Spark's testing mode, in texts that are each within the limits; and one text beyond them
    rows = [(1, t, ("user", "assistant")[t % 2], 'say "no": \\ {a}' + "x" * 600_000) for t in range(50)] + [(2, 0, "user", "a"), (2, 1, "assistant", "y" * 21_000_000), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(c, t, r, x[:20].rstrip("xy"), len(x)) for c, t, r, x in rows], "conv_id bigint, turn bigint, role string, head string, size int")
    df = df.selectExpr("conv_id", "turn", "role", "rpad(head, size, if(conv_id = 2, 'y', 'x')) text")
    whole = chat.whole_conversations(df)
    layouts = {r.conv_id: r.layout for r in chat.canonical(chat.records_of(whole), "conv_id", "record").select("conv_id", "layout").collect()}
    assert layouts[1] in ("messages", "conversations") and layouts[2] in ("prompt", "instruction")
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.chat_report(df).collect()}
    assert out == {1: (50, 25 * len(rows[0][3])), 2: (2, 21_000_000), 3: (2, 1)}
    monkeypatch.setattr(chat, "LAYOUTS", ())  # no record has a layout
    with pytest.raises(Exception, match="conversation 3"):
        chat.chat_report(df.where("conv_id = 3")).collect()


def test_chat_shapes_without_texts(spark):
    texts = ['{"k:":"a\\\\","b":["x","y: \\"z\\","],"c" : {"d":"e,"}}', '{"messages":[{"role":"user","content":"\\\\\\"]}"},{"role":"a","content":""}]}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    out = df.select(F.schema_of_variant(F.try_parse_json("j")), F.schema_of_variant(F.try_parse_json(chat.emptied("j")))).collect()
    assert all(a and a == b for a, b in out)


def test_chat_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"completion":"b","prompt":"a"}', '{"instruction":"a","response":"b"}', '{"system":"s","prompt":"a","completion":null}', '{"instruction":"a","input":"c","output":"b"}', '{"messages":[]}', '{"other":1}', "no json", None]
    out = chat.canonical(spark.createDataFrame(list(enumerate(rows)), "id bigint, j string"), "id", "j").orderBy("id").collect()
    assert [r.layout for r in out] == ["messages", "prompt", "instruction", "system_prompt", "instruction_input", "empty", None, None, None]
    assert [(t.role, t.text) for t in out[3].turns] == [("system", "s"), ("user", "a"), ("assistant", "")]
    assert out[4].turns[0].text == "a\n\nc" and out[5].turns == [] and out[6].turns is None


# 6
def test_contamination_is_found_and_clean_texts_are_left(spark, odd, empty):
    rng = random.Random(2)
    items = [(1, words(rng, 40)), (2, words(rng, 12)), (3, "just three words"), (4, None), (5, "")]
    edited = items[0][1].split()
    edited[38] = "other"
    docs = [(1, f"{words(rng, 50)} {items[0][1].upper()} {words(rng, 20)}"), (2, items[1][1]), (3, f"say just  three\nwords now {items[1][1]}"), (4, words(rng, 300)), (5, " ".join(edited)), (6, " ".join(items[0][1].split()[:20])), (7, None), (8, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = {(r.doc_id, r.item_id): round(r.similarity, 3) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert out == {(1, 1): 1.0, (2, 2): 1.0, (3, 2): 1.0, (3, 3): 1.0, (5, 1): round(34 / 38, 3)}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_contamination_beyond_radius_and_in_shorter_texts(spark):
    text = [f"v{i}" for i in range(45)]
    bench = spark.createDataFrame([(1, " ".join(text))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(text[:22] + text[23:])), (2, " ".join(["a", "b", *text[:42], "x", *text[43:]]))], "doc_id bigint, text string")
    out = {r.doc_id: round(r.similarity, 3) for r in decontaminate.contaminated(docs, bench, radius=1).collect()}
    assert out == {1: 0.8, 2: round(38 / 44, 3)}


def test_contamination_equals_sql_on_edited_items(spark):
    import duckdb

    rng = random.Random(15)
    items = [(i, words(rng, rng.choice((3, 8, 15, 30, 59, 104)), 90)) for i in range(12)] + [(20, "a b a b a b a b a b a b"), (21, None)]
    docs = []
    for i in range(150):
        w = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, 1 + len(w) // 9)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(3)] = [f"n{rng.randrange(9)}"] * rng.randrange(2)
        docs.append((i, " ".join([*words(rng, rng.choice((0, 0, 4, 40))).split(), *w, *words(rng, rng.choice((0, 0, 4, 40))).split()])))
    docs += [(200, " ".join(items[5][1].split()[:48] + items[5][1].split()[60:])), (201, None), (202, "b a " * 30)]
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    want = {(*r[:4], round(r[4], 9)) for r in con.execute(queries.OP6_SQL).fetchall()}
    assert len(want) > 60 and got == want


def test_decontamination_judges_rows(spark):
    item = " ".join(f"v{i}" for i in range(20))
    rows = [(None, item, "a"), (None, "clean text", "b"), (1, item, "c"), (1, "other", "d"), (2, None, "e")]
    kept = decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id bigint, text string, begin string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert sorted(r.begin for r in kept.collect()) == ["b", "d", "e"] and kept.columns == ["doc_id", "text", "begin"]


def test_seeds_in_parts_find_the_same(spark):
    rng = random.Random(16)
    items = spark.createDataFrame([(i, words(rng, 20)) for i in range(20)], "item_id bigint, text string")
    source = items.selectExpr("item_id doc_id", "item_id text_hash", "split(text, ' ') w")
    seed = decontaminate.written(decontaminate.seeds(decontaminate.benchmark_items(items, 5), 5, 80), "seeds")
    found = [decontaminate.seed_hits(source, seed, rows).select("doc_id", "item_id", "begin").exceptAll(decontaminate.seed_hits(source, seed).select("doc_id", "item_id", "begin")).count() for rows in (10, 7)]
    assert found == [0, 0] and decontaminate.seed_hits(source, seed, 10).count() == decontaminate.seed_hits(source, seed).count() > 0


def test_hamming_blocks_cover_all_bits():
    radius = 18
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    assert cuts[0] == 0 and cuts[-1] == 64 and all(b > a for a, b in zip(cuts, cuts[1:], strict=False))


# 7
def test_lm_base_score_and_lattice(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 30, 60) if i % 9 else None) for i in range(200)] + [(1000, "unseen wörds \x00 only")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from collections import Counter

    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words_of(t), b"\n"])
    n, v = sum(c.values()), len(c)
    seen = []
    for frequent in (100_000, 5):
        counts = lattice_lm.written(lattice_lm.word_counts(df, lattice_lm.crc_mod("doc_id", 10) != 0), "counts")
        model = lattice_lm.fit(counts, queries.vocabulary(), rounds=1, most_frequent=frequent)
        out = {r.doc_id: r for r in lattice_lm.scored(df, counts, model).collect()}
        for i, t in rows:
            tokens = [*words_of(t), b"\n"]
            want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
            r = out[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
        seen.append({i: round(r.score, 6) for i, r in out.items()})
    assert seen[0] == seen[1]  # what is broadcast and what is joined makes no difference


def test_lm_scores_rows_by_brute_force(spark, empty):
    rng = random.Random(17)
    rows = [(i, words(rng, 25, 80)) for i in range(60)] + [(70, "rare éa ones"), (70, "rare éa ones"), (70, "others"), (None, "rare w1 éa"), (None, None), (71, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, row int")
    told = []
    for frequent in (100_000, 4):
        counts = lattice_lm.written(lattice_lm.word_counts(df, F.coalesce(lattice_lm.crc_mod("doc_id", 10) != 0, F.lit(False))), "counts")
        model = lattice_lm.fit(counts, queries.vocabulary(), rounds=1, most_frequent=frequent)
        c = {r.word.encode(): r.c for r in counts.collect()}
        lattice = lattice_lm.Lattice(model.arcs, model.byte_arcs)

        def log10(w):
            own = max(c.get(w, 0) - model.discount, 0) / (model.total + 1)  # noqa: B023
            if w == b"\n":
                return math.log10(own)
            return math.log10(own + 10 ** (model.rest + lattice.forward("▁" + w.decode())[-1] / math.log(10)))  # noqa: B023

        want = sorted((str(i), len(words_of(t)) + 1, sum(w in c for w in [*words_of(t), b"\n"]), round(sum(map(log10, [*words_of(t), b"\n"])), 6)) for i, t in rows)
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in lattice_lm.scored(df, counts, model).collect())
        assert got == want
        told.append(got)
    assert lattice_lm.lm_report(empty, queries.vocabulary()).count() == 0


def test_lm_scores_of_very_long_words_have_no_floor(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 20, 60)) for i in range(60)] + [(900 + k, "\U0001f600" * n) for k, n in enumerate((250_000, 500_000))]
    counts = lattice_lm.written(lattice_lm.word_counts(spark.createDataFrame(rows[:60], "doc_id bigint, text string"), F.lit(True)), "counts")
    model = lattice_lm.fit(counts, queries.vocabulary())
    told = {r.doc_id: r.score for r in lattice_lm.scored(spark.createDataFrame(rows[60:], "doc_id bigint, text string"), counts, model).collect()}
    assert told[901] < told[900] < -1e6 and told[901] == pytest.approx(2 * told[900], rel=1e-3)


def test_forward_equals_sum_over_segmentations():
    pieces, byte_at, logp = lattice_lm.vocabulary(queries.vocabulary())
    lattice = lattice_lm.Lattice.of(pieces, byte_at, logp)

    def total(s):
        if not s:
            return 1.0
        one = math.exp(sum(logp[byte_at[b]] for b in s[0].encode()))
        return one * total(s[1:]) + sum(math.exp(logp[pieces.index(s[:k])]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)

    for word in ("▁the", "▁éa", "▁x漢"):
        assert lattice.forward(word)[-1] == pytest.approx(math.log(total(word)))
        got = defaultdict(float)
        for i, p in lattice.expected(word):
            got[i] += p
        assert sum(len(pieces[i]) * p for i, p in got.items() if pieces[i]) <= len(word) + 1e-9


def test_expected_counts_of_many_words_equal_those_of_each():
    import numpy as np

    lattice = lattice_lm.Lattice.of(*lattice_lm.vocabulary(queries.vocabulary()))
    rng = random.Random(12)
    many = ["▁" + "".join(rng.choice("abtheionrs漢é\x00") for _ in range(rng.randrange(1, 12))) for _ in range(500)] + ["▁" + "the" * 30]
    want, got = np.zeros(32_000), np.zeros(32_000)
    for w in many:
        for i, p in lattice.expected(w):
            want[i] += p
    lattice.add_expected(many, got)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert [x * math.log(10) for x in lattice._together(many[:500])] == pytest.approx([lattice.forward(w)[-1] for w in many[:500]])


def test_weights_come_from_all_training_words(spark, monkeypatch):
    seen = []
    whole = lattice_lm.expected_counts
    monkeypatch.setattr(lattice_lm, "expected_counts", lambda counts, *a: seen.append(counts.count()) or whole(counts, *a))
    counts = lattice_lm.written(spark.range(101_000).selectExpr("cast(id as string) word", "id % 7 + 1 c"), "counts")
    lattice_lm.fit(counts, queries.vocabulary(), rounds=2)
    assert seen == [101_000, 101_000]


# 8
def test_notices_within_edits_are_found(spark, odd, empty):
    scanner = notices.Scanner()
    rng = random.Random(6)
    for notice, label in notices.NOTICES.items():
        errors = max(1, len(notice) // 12)
        for _ in range(8):
            chars = list(notice)
            for _ in range(errors):
                chars[rng.randrange(1, len(chars) - 1)] = rng.choice("qxz")
            text = f"before {''.join(chars)} after"
            brute = any(p.search(notices.normalised(text)[0]) for n, lab, _, _, p in scanner.notices if lab == label)
            assert brute == (label in notices.report(text, scanner)[5].split(","))
    n_words, n_base, first, last, base, labels, score, *_ = notices.report("cc BY cc by, General  Public-License", scanner)
    assert (n_words, n_base, first, last, base, score) == (7, 3, 0, 4, "cc-by,gpl", 1.0) and "gpl" in labels
    assert notices.report(None, scanner)[:7] == (0, 0, None, None, "", "", 0.0)
    assert notices.scanned(odd).count() == len(ODD) and notices.scanned(empty).count() == 0


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(18)
    vocabulary = ["cc", "by", "CC", "BY,", "general", "public", "license", "General-Public", "License.", "all", "rights", "reserved", "x", "é", "ALL", "cc by cc by", "_", "by\ncc"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [(900, None), (901, "cc by"), (902, "cc  -- by"), (903, "all rights reserved all rights reserved"), (904, "ccé by"), (905, "cc by " * 20_000)]
    out = {r.doc_id: r for r in notices.scanned(spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, spans string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(at, label) for phrase, label in notices.PHRASES.items() for p in [phrase.split()] for at in range(len(w) - len(p) + 1) if w[at : at + len(p)] == p]
        r, starts = out[i], [at for at, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(places)


# 9
def test_language_on_held_out_texts(spark, odd, empty):
    rng = random.Random(8)
    kinds = {"aa": "ka lo mi ru".split(), "bb": "sch ung en ber".split(), "cc": "eau oix ent qui".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(k, rng.randrange(5, 60)), k) for i, k in enumerate(rng.choice("abc") * 2 for _ in range(300))]
    out = language.language_report(spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", "aa"), (902, "kalo", None)], "doc_id bigint, text string, lang string")).collect()
    right = [r.lang_pred == rows[r.doc_id][2] for r in out if r.doc_id < 300 and r.held_out]
    assert right and sum(right) / len(right) > 0.95
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (900, 901)} == {900: ("und", 0.0), 901: ("und", 0.0)}
    model = language.train([(t, k) for _, t, k in rows])
    assert language.accepted(odd, model).columns == odd.columns and language.predicted(empty, model).count() == 0
    assert language.language_report(empty.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def by_hand(data: bytes, n: int, bits: int):
    """(place, bucket) of each byte n-gram that holds white space at its ends only, one at a time."""
    for i in range(len(data) - n + 1):
        g = data[i : i + n]
        if b" " not in g[1:-1]:
            h = n
            for c in g:
                h = (h * 0x01000193) % (1 << 32) ^ c
            h = (h * 0x9E3779B1) % (1 << 32)
            h = ((h ^ h >> 15) * 0x85EBCA77) % (1 << 32)
            yield i, h >> 32 - bits


def test_language_scores_by_brute_force(spark, empty):
    rng = random.Random(19)
    make = lambda chars: " ".join("".join(rng.choice(chars) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 30)))
    model = language.train([(make("abcde "), "x") for _ in range(40)] + [(make("efghé"), "y") for _ in range(40)] + [(make("漢字かな"), "z") for _ in range(40)])
    texts = [None, "", "12 ½ ² ٣ _!", "a", "é", "漢", "ªb", "A\tB\n\nC", make("abcdefgh"), "abc " * 9000, "x\x00y", "\u02b0"]
    out = {r.doc_id: r for r in language.predicted(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"), model).collect()}
    for i, t in enumerate(texts):
        if not t or not any(unicodedata.category(c).startswith("L") for c in t):
            assert (out[i].lang_pred, out[i].score, out[i].accepted) == ("und", 0.0, False), t
            continue
        data = b" " + b" ".join(t.lower().encode().split()) + b" "
        rows = [model.logits[h].astype(float) for n in language.ORDERS for _, h in by_hand(data, n, language.BITS)]
        z = [(sum(r[k] for r in rows) / len(rows) + model.bias[k]) / model.temperature for k in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(3), key=p.__getitem__)
        assert out[i].lang_pred == model.languages[best] and out[i].score == pytest.approx(p[best] / sum(p), rel=1e-6)
    assert language.language_report(empty.withColumn("lang", F.lit("a"))).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5 + str(i), f"l{i % 90}") for i in range(900)] + [(1, "same id, other text", "l1")] * 50
    seen = []
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=3)
    assert len(model.languages) == 90
    keep = language.train
    try:
        language.train = lambda rows: seen.append(len(rows)) or keep(rows)
        language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=3, most=180)
    finally:
        language.train = keep
    assert seen == [180]  # two of each language


def test_language_rejects_what_it_has_not_learned():
    rng = random.Random(13)
    kinds = {"aa": "ka lo mi ru".split(), "bb": "sch ung en ber".split(), "cc": "eau oix ent qui".split(), "dd": "ña ción os ay".split()}
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    model = language.train([(make(kinds[k], rng.randrange(20, 60)), k) for k in kinds for _ in range(100)])
    clean = [model.predict(make(kinds[k], 30)) for k in kinds for _ in range(50)]
    strange = [model.predict(make("zxw pvf jgd ыук".split(), 30)) for _ in range(50)]
    assert all(ok for *_, ok in clean) and not any(ok for *_, ok in strange)


# 10
def test_toxicity_on_held_out_texts(spark, odd, empty):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        sentences = [words(rng, 8) for _ in range(rng.randrange(1, 12))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" you {rng.choice(['horrible', 'dreadful'])} thing"
        rows.append((i, ". ".join(sentences)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    out = toxicity.toxicity_report(docs, labels).where("held_out").collect()
    assert out and sum(r.predicted == int(r.doc_id % 4 == 0) for r in out) / len(out) > 0.95
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.sentences for r in toxicity.located(docs, model).collect()}
    assert all(any(w in s for s in found[i] for w in ("horrible", "dreadful")) for i in found if i % 4 == 0)
    assert {r.doc_id: r.score for r in toxicity.scored(odd, model).collect()}[1] == 0.0
    assert toxicity.clean(empty, model).count() == 0 and toxicity.toxicity_report(empty, labels.limit(0)).count() == 0


def test_toxicity_scores_by_brute_force(spark, empty):
    rng = random.Random(20)
    plain = lambda n: " ".join(words(rng, 8, 300) + rng.choice((".", "!", "?\n")) for _ in range(n))
    bad = ["scumbags", "idiotic fools", "dreadfully vile"]
    model = toxicity.train([(plain(3), 0) for _ in range(120)] + [(f"{plain(2)} you {rng.choice(bad)} there. {plain(1)}", 1) for _ in range(120)])
    texts = [None, "", " \n", "you scumbags there.", "You SCUMBAGS there! fine.", plain(4), f"{plain(30)} you idiotic fools there.{plain(30)} you dreadfully vile there", "scumbags", "scum bags", "\t\x0b.scumbags\r."]
    out = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, toxic int"), model).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, t in enumerate(texts):
        raw = (t or "").encode().lower()
        cuts = [0, *(k + 1 for k, c in enumerate(raw) if c in b".!?\n"), len(raw)]
        hits = [set() for _ in cuts[1:]]
        data = b" " + bytes(32 if c in b"\t\n\v\f\r" else c for c in raw) + b" "
        for n in toxicity.ORDERS if raw.strip() else ():
            for at, h in by_hand(data, n, toxicity.BITS):
                hits[sum(c <= at for c in cuts[1:-1])].add(h)
        p = [(sigmoid(model.bias + sum(float(model.weights[h]) for h in x)) - sigmoid(model.bias)) / (1 - sigmoid(model.bias)) for x in hits]
        over = [x for x in p if x >= 0.5]
        want = 1 - math.prod(1 - x for x in over) if over else max(p, default=0)
        assert out[i].score == pytest.approx(want, abs=1e-6) and out[i].n_offending == len(over) and out[i].predicted == (want >= 0.5), t
    assert out[3].predicted and out[4].predicted and out[6].n_offending == 2
    assert toxicity.toxicity_report(empty, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0


def test_length_alone_convicts_nobody():
    rng = random.Random(21)
    plain = lambda n: " ".join(words(rng, 8, 300) + "." for _ in range(n))
    rows = [(plain(3), 0) for _ in range(150)] + [(f"{plain(2)} you {rng.choice(('scumbags', 'idiots'))}.", 1) for _ in range(150)]
    model = toxicity.train(rows)
    for n in (1, 10, 100, 3000):
        score, found = model.score(plain(n))
        assert score < 0.5 and not found
    assert model.score(plain(3000) + " you idiots.")[0] >= 0.5


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    text = words(rng, 60)
    rows = [(i, words(rng, 60), "en", "s", 1) for i in range(30)] + [(40, text, "en", "s", 1), (41, text, "en", "s", 1), (42, None, "en", "s", 1)]
    leak = words(rng, 30)
    rows.append((43, f"{words(rng, 10)} {leak}", "en", "s", 1))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = after
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [*range(30), 40]


def test_pipeline_removes_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string"
    clean = [(i, f"{words(rng, 12)}. {words(rng, 12)}.", "en", "s", 1, "x") for i in range(80)]
    bad = [(100 + i, f"{words(rng, 12)}. you {rng.choice(('scumbags', 'wretched idiots'))}. {words(rng, 9)}.", "en", "s", 1, "x") for i in range(40)]
    rows = [*clean, *bad, clean[0], clean[0], (5, None, "en", "s", 1, "x"), (None, words(rng, 30), "en", "s", 1, "x"), (300, "12 345 !!", None, None, None, None)]
    marks = [(r[0], 1, 0) for r in clean[:60]] + [(r[0], 1, 1) for r in bad[:30]] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(rows, schema).limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
        spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
    out = sorted(((r.doc_id, r.n_tokens > 1) for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()), key=str)
    assert out == sorted([(0, True)] * 3 + [(i, True) for i in range(1, 80)] + [(None, True)], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
