"""Operators 11 to 13 against brute force, damaged inputs and odd rows."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, structure, warc

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, _key string, leaf string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    for level in levels[:-1]:
        yield level[i // 3 * 3 : i], level[i + 1 : i // 3 * 3 + 3]
        i //= 3


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r, _leaf(r, r[4])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for g in by.values():
        g.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: _levels([leaf for _, leaf in by[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (r, leaf) in enumerate(by[s]):
            path = [*_path(trees[s], i), *_path(top, k)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = _leaf(r, r[4].replace("\n", ""))
            for before, after in path:
                node = H(*before, node, *after)
            yield r[0], leaf, trees[s][-1][0], top[-1][0], H(*[h for a, b in path for h in a + b]), node, node == top[-1][0]


def _told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 11
@pytest.mark.parametrize(("block", "digits"), [(729, 6), (9, 2)])
def test_manifest_equals_brute_force(spark, monkeypatch, block, digits):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rng = random.Random(11)
    rows = [(i, rng.choice(["hot", "hot", "b", "é", "Z", "", None]), rng.choice(["de", None]), i % 7 or None, rng.choice(["a\nb", "x", "", None, "é\n漢 " * 50])) for i in range(300)]
    rows += [(1000 + i, f"s{i:02}", "en", 1, "one\n") for i in range(30)] + [rows[0], rows[0], (None, "hot", None, None, "a"), (5, "hot", "xx", 1, "\n")]
    df = spark.createDataFrame([(*r, "k", "l") for r in rows], DOCS).repartition(5)
    assert _told(merkle.manifest_report(df)) == sorted(_manifest(rows), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "DIGITS", 2)


def test_manifest_of_few_rows(spark, small_blocks):
    df = spark.createDataFrame([(1, "a", None, None, "x\ny", "k", "l")], DOCS)
    r = merkle.manifest_report(df).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H() and r.verified == (zlib.crc32(b"1") % 2 == 1)
    assert merkle.manifest_report(df.limit(0)).count() == 0


def test_manifest_needs_no_join_for_proofs_and_moves_no_texts(spark, small_blocks):
    df = spark.createDataFrame([(i, "a", None, None, "x" * 100, "k", "l") for i in range(50)], DOCS)
    plan = merkle.manifest_report(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "text#" not in plan


# 12
PAGES = "page_id bigint, url string, html string, payload string"


def test_archives_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rng = random.Random(12)
    texts = ["", None, "<p>a</p>\r\n\r\nWARC/1.1\r\n", "é漢" * 40_000, "".join(chr(rng.randrange(32, 0x3000)) for _ in range(9000)), *[f"<p>{i}</p>" for i in range(20)]]
    rows = [(i, rng.choice([None, "http://a.example/ä b\r\nX: y", f"http://b.example/{i}"]), rng.choice(texts), "x") for i in range(200)] + [(500, "http://c.example/", "only", "x"), (None, "http://c.example/", "only", None)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    largest = defaultdict(list)
    for i, _, html, _ in rows:
        largest[html or ""].append(-1 if i is None else i)
    want = []
    for i, _, html, _ in rows:
        data, top = (html or "").encode(), max(largest[html or ""])
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert _told(warc.warc_report(df)) == sorted(want, key=str)
    archives = warc.write_archives(df, f"{tmp_path}/out")
    assert archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_archives(archives, payloads=True)
    assert warc.broken_revisits(back).count() == 0 and warc.broken_revisits(back.where("not page_id <=> '500'")).count() == 1
    told = {r.page_id: r for r in back.where("record_type = 'response'").collect()}
    assert all(bytes(told[str(i)].payload) == (html or "").encode() for i, _, html, _ in rows if str(i) in told)
    # files of attempts that weren't committed don't count
    (tmp_path / "out" / "left.warc.gz").write_bytes(b"torn")
    assert warc.read_archives(archives).count() == len(rows)


def test_least_bytes_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "same", "x"), (2, "u", "same", "x"), (3, "u", "longer text", "x"), (4, "u", "longer text", "x"), (4, "u", "longer text", "x")], PAGES)
    kinds = lambda least: sorted((r.page_id, bool(r.revisits)) for r in warc.marked(df, least).collect())
    assert kinds(5) == [("1", False), ("2", False), ("3", True), ("4", False), ("4", False)]
    assert kinds(0)[0] == ("1", True)
    assert warc.warc_report(df.limit(0)).count() == 0


def test_standard_members_and_damage():
    data = [warc.record(str(i), "http://a/", b"<p>%d</p>" % i * 9000) for i in range(3)] + [warc.record("9", None, b"<p>0</p>" * 9000, "0", True)]
    whole = b"".join(map(warc.member, data))
    import gzip

    assert gzip.decompress(whole) == b"".join(data)  # one member after the other
    rows = list(warc.records(io.BytesIO(whole), payloads=True))
    assert [r["page_id"] for r in rows] == ["0", "1", "2", "9"] and rows[3]["refers_to"] == "0" and rows[3]["payload_bytes"] == 72_000 and rows[1]["payload"] == b"<p>1</p>" * 9000
    torn = {
        "inside": whole[:-20],
        "digest": b"".join(warc.member(d.replace(b"<p>1</p>", b"<p>7</p>", 1)) for d in data),
        "length": warc.member(data[0] + b"x"),
        "shorter": warc.member(data[0][:-10]),
        "unpacked": whole[:100] + b"\x00\x00\x00" + whole[103:],
        "no WARC": warc.member(b"HTTP/1.1 200 OK\r\n\r\n"),
        "without end": warc.member(b"WARC/1.1\r\nA: b"),
        "without length": warc.member(b"WARC/1.1\r\nA: b\r\n\r\n"),
    }
    for name, bad in torn.items():
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(bad)))
            pytest.fail(name)


def test_readers_hold_a_chunk_at_most():
    bomb = warc.member(warc.record("1", "http://a/", b"\x00" * 30_000_000))
    stream = io.BytesIO(bomb)
    m = warc._Member(warc._Compressed(stream))
    m.until(b"\r\n\r\n", 1 << 20)
    assert max(map(len, m.exactly(25_000_000))) <= warc.CHUNK


# 13
TURNS = "conv_id bigint, turn bigint, role string, text string, extra string"


def _damage(rows):
    for c, t, role, text, *_ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        show = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        for _ in range(2 if fate == 3 else 1):
            yield c, t, "user" if fate == 4 else role, text


def _repair(rows):
    """(counts, cost, audit, digest) of one conversation's rows in order, by a search over all (cost, audit) of each state."""
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append(fault)
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", [])}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for new, role in (("u", "user"), ("a", "assistant")):
                    if (state, new) in follow:
                        other = (cost + 3, audit + "I", [*out, (role, "")])
                        best[new] = min(best.get(new, other), other)
        return best

    best = inserted(best)
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        later = {}
        for state, (cost, audit, out) in best.items():
            options = [(state, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (state, role[:1]) in follow:
                    options.append((role[:1], (cost + more, audit + "K", [*out, (role, text)])))
                options += [(new, (cost + 3 + more, audit + "R", [*out, (r, text)])) for new, r in (("u", "user"), ("a", "assistant")) if (state, new) in follow]
            for new, x in options:
                later[new] = min(later.get(new, x), x)
        best = inserted(later)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, H("\n".join(f"{r}:{t}" for r, t in out)), out


def _in_order(rows):
    said = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), said(r)))


def _conversations(rng, n, longest):
    texts = ["Yes.", "no", "Why?", " \n\t", "", None, "é! ", "a.b", "x. ", "Go!\n"]
    for c in range(n):
        kind = rng.random()
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", None, ""]) if kind < 0.3 else "user" if kind < 0.4 else ("user", "assistant")[t % 2]
            yield c, rng.choice([t, t, t, None, t + 3]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(40)}{rng.choice('.!?,')}", "x"


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_repair_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(structure, "CHUNK_BITS", bits)
    rows = list(_conversations(random.Random(13), 40, 20)) + [(None, 0, "user", "Hi.", "x"), (None, 1, "assistant", "Ho.", "x")] + [(99, t, "user", f"cut {t}", "x") for t in range(60)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    by = defaultdict(list)
    for r in _damage(rows):
        by[r[0]].append(r)
    want = [(c, *_repair(_in_order(by[c]))[:-1]) for c in {r[0] for r in rows}]
    assert _told(structure.repair_report(df)) == sorted(want, key=str)


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "system", "Be brief.", "x"), (1, 1, "user", "Why?", "x"), (1, 2, "user", "How?", "x"), (1, 3, "assistant", "cut", "x")]
    df = spark.createDataFrame(rows, TURNS)
    out = structure.repaired(df).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in out] == [("K", "system", "Be brief."), ("K", "user", "Why?"), ("I", "assistant", ""), ("K", "user", "How?"), ("K", "assistant", "cut")]
    assert structure.repair_report(df.limit(0)).count() == 0 and structure.repaired(df.limit(0)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = structure.repair_report(spark.createDataFrame([(7, dropped, "user", "Hi.", "x")], TURNS)).collect()
    assert [tuple(r) for r in one] == [(7, 0, 0, 0, 0, 0, 0, "", H())]


def test_vectors_that_never_converge_take_few_passes(spark, monkeypatch):
    """Cut turns of one role are all deleted, so each chunk hands on the vector it gets."""
    monkeypatch.setattr(structure, "CHUNK_BITS", 1)
    rows = [(1, t, "user", f"cut {t}", "x") for t in range(120)] + [(1, 120, "assistant", "End.", "x")]
    made = []
    real = structure.written
    monkeypatch.setattr(structure, "written", lambda df, name: made.append(name) or real(df, name))
    out = structure.repaired(spark.createDataFrame(rows, TURNS)).collect()
    assert made.count("vectors") <= 9
    assert [r.role for r in sorted(out, key=lambda r: r.place)] == [r for r, _ in _repair([r[:4] for r in rows])[-1]]


def test_runs_stop_where_vectors_agree():
    rng = random.Random(5)
    for _ in range(200):
        codes = [rng.randrange(16) for _ in range(rng.randrange(1, 30))]
        ends = [structure.step(structure.ENDED, rng.randrange(16))[1] for _ in range(2)]
        assert structure.rerun(codes, ends[0], ends[1], structure.run(codes, ends[0])) == structure.run(codes, ends[1])
