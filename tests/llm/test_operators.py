"""Operators on small fixtures with nulls, empty and repeated rows, extra columns; against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import archives, common, language, minhash, mixing, neighbours, postings, ppm, pseudonyms, toxicity, wavelet

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, lang string, size long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated ids, rows and texts, nulls, and columns whose names operators use inside."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["The", "OF", "é"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(12)]
    texts = [*base, *[t.replace("w1 ", "w2 ") for t in base[:6]], base[0], base[0], "", None, "one", "ONE", " \t\n ", "two words", "x" * 50_000 + " end"]
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 3}", "en", 1, "k") for k, t in enumerate(texts)]
    rows += [(3, base[3], "s0", "en", 1, "k"), (None, "null id here", "s1", None, 1, "k")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_archives(spark):
    rows = [(1, "http://a b/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (4, "v", ""), (None, "q", "x"), (None, "q", "zz\r\n\r\nfoo"), (9, "http://é/", "é" * 3)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    back = archives.read_records(archives.write_pages(pages, common.scratch(spark, "w")))
    got = [tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    most = collections.defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None:
            most[h or ""] = max(most[h or ""] or 0, i)
    want = []
    for i, _, h in rows:
        h = h or ""
        chief = most[h] if most[h] is not None and most[h] != i else None
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if chief is None else "revisit", chief))
    assert same(got, want)
    assert archives.read_records(archives.write_pages(pages.limit(0), common.scratch(spark, "w"))).count() == 0
    for version in (1, 2):
        data = archives.arc_bytes([("http://x/", b"hello"), (None, b"")], "n.arc", version, "20200102030405")
        parsed = list(archives.read_arc(data))
        assert [r.version for r in parsed] == [version] * 3 and parsed[1].body.endswith(b"hello")
        warc = [archives.convert(r, "n.arc") for r in parsed]
        assert [w.kind for w in warc] == ["warcinfo", "response", "response"] and warc[1].get("WARC-Date") == "2020-01-02T03:04:05Z"
        assert [w.block for w in archives.read_warc(b"".join(w.to_bytes() for w in warc))] == [r.body for r in parsed]
    short = list(archives.read_arc(b"http://x/ 1.2.3.4 2020 text/plain 99\nabc"))
    assert short[0].truncated and archives.convert(short[0], "n").kind == "resource"
    with pytest.raises(ValueError):
        list(archives.read_arc(b"nonsense\n"))


def test_pseudonyms(spark):
    texts = ["call +1 (988) 555-2485.", "card 4041894974608795, bad 4041894974608796", "ip 42.144.35.254 or 300.1.1.1", "GB82 WEST 1234 5698 7654 32", "2024-02-29 and 2023-02-29", "mail bosbt.42@mail8.example.com", "078-05-1120", None, "", "plain", "4041-8949-7460-8795"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*texts, texts[1]])], "doc_id long, text string, Parts long")
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "k").collect()}
    assert got[1].text == got[11].text and "4041894974608795" not in got[1].text and "4041894974608796" in got[1].text
    assert re.sub(r"\D", "", got[10].text) == got[1].text.split()[1].strip(",")
    assert "300.1.1.1" in got[2].text and "42.144.35.254" not in got[2].text and "2023-02-29" in got[4].text
    assert (got[7].text, got[8].text, got[9].text) == (None, "", "plain") and [got[k].n_replaced for k in range(7)] == [1] * 7
    iban = re.sub(" ", "", got[3].text)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymised(df, "another").collect()}
    assert other[1] != got[1].text
    days = spark.range(146_097).select(pseudonyms.feistel("k", "date", F.floor(F.col("id") / 773), F.col("id") % 773, 189, 773).alias("o")).select("o.l", "o.r")
    assert days.distinct().count() == 146_097
    assert pseudonyms.pseudonymised(df.limit(0), "k").count() == 0


def undisguised(key, tag, left, right, a, b):
    """The network, round by round."""
    part = lambda k, x: int(hashlib.sha256(f"{key}/{tag}/{k}/{x}".encode()).hexdigest()[:15], 16)
    for k in range(pseudonyms.ROUNDS):
        left, right = ((left + part(k, right) % a) % a, right) if k % 2 == 0 else (left, (right + part(k, left) % b) % b)
    return left, right


def digits_of(key, tag, d):
    cut = len(d) // 2
    left, right = undisguised(key, tag, int(d[:cut] or 0), int(d[cut:]), 10**cut, 10 ** (len(d) - cut))
    return (f"{left:0{cut}}" if cut else "") + f"{right:0{len(d) - cut}}"


def test_pseudonyms_by_brute_force(spark):
    """Every format against the same rules in plain Python; and columns of any name, and the key's setting."""
    rng, k = random.Random(11), "secret"
    luhn = lambda d: (10 - sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(d))) % 10) % 10
    rows = []
    for n in range(13, 20):
        body = str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 2))
        new = body[0] + digits_of(k, "card", body[1:])
        rows.append((f"{body}{luhn(body)}", f"{new}{luhn(new)}"))
    for _ in range(20):
        day = rng.randrange(146_097)
        left, right = undisguised(k, "date", day // 773, day % 773, 189, 773)
        date = lambda n: np.datetime64("1800-01-01") + n
        rows.append((str(date(day)), str(date(left * 773 + right))))
        area, group, serial = rng.choice([*range(1, 666), *range(667, 900)]), rng.randint(1, 99), rng.randint(1, 9999)
        left, right = undisguised(k, "ssn", (area - 2 if area > 666 else area - 1) * 99 + group - 1, serial - 1, 898 * 99, 9_999)
        a = left // 99
        rows.append((f"{area:03}-{group:02}-{serial:04}", f"{a + 2 if a >= 665 else a + 1:03}-{left % 99 + 1:02}-{right + 1:04}"))
        o = [rng.randrange(256) for _ in range(4)]
        left, right = undisguised(k, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
        rows.append((".".join(map(str, o)), f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"))
        area, exchange, line = rng.randint(200, 999), rng.randint(200, 999), rng.randrange(10_000)
        value = ((area - 200) * 800 + exchange - 200) * 10_000 + line
        left, right = undisguised(k, "phone", value // 80_000, value % 80_000, 80_000, 80_000)
        v = left * 80_000 + right
        rows.append((f"({area}) {exchange}-{line:04}", f"({v // 8_000_000 + 200}) {v // 10_000 % 800 + 200}-{v % 10_000:04}"))
        bban = "".join(rng.choice("0123456789") for _ in range(18))
        check = lambda b: 98 - int(b + "131400") % 97
        new = digits_of(k, "iban", bban)
        rows.append((f"DE{check(bban):02}{bban}", f"DE{check(new):02}{new}"))
    rows.append(("a" + "7" * 45 + "@x.org", None))
    df = spark.createDataFrame([(n, a, 5, "p") for n, (a, _) in enumerate(rows)], "doc_id long, text string, n_replaced long, parts string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(df, k).collect()}
    for n, (a, b) in enumerate(rows):
        assert b is None or got[n].text == b, (a, b, got[n].text)
        assert got[n].n_replaced == 5 and got[n].parts == "p" and got[n]["_n_replaced"] == int(got[n].text != a)
    local = got[len(rows) - 1].text.split("@")[0]
    assert local[1:37] == digits_of(k, "mail", "7" * 36) and local[37:] == digits_of(k, "mail", "7" * 9)
    long = "x " * 400_000 + "2024-02-29" + " y" * 400_000
    moved = pseudonyms.pseudonymised(spark.createDataFrame([(1, long)], "doc_id long, text string"), k).first().text
    assert len(moved) == len(long) and "2024-02-29" not in moved and moved.startswith("x x ") and moved.endswith(" y y")
    assert pseudonyms.configured_key(spark) == pseudonyms.configured_key(spark) and len(pseudonyms.configured_key(spark)) == 32
    spark.conf.set(pseudonyms.KEY_SETTING, "mine")
    assert pseudonyms.configured_key(spark) == "mine"
    spark.conf.unset(pseudonyms.KEY_SETTING)


def test_pseudonyms_of_all_phones(spark):
    """Also numbers whose area or exchange is under 200, each within its own range and one to one."""
    texts = ["+1 (017) 555-7713", "+1 (199) 555-0000", "000-000-0000", "415 199 1234", "(999) 000-9999", "988-555-2485"] + [f"{k:03}-{(k * 7) % 200:03}-{k:04}" for k in range(9, 1000, 9)]
    got = [r.text for r in pseudonyms.pseudonymised(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    ends = lambda t: (int(re.sub(r"\D", "", t)[-10:-7]), int(re.sub(r"\D", "", t)[-7:-4]))
    for a, b in zip(texts, got, strict=True):
        assert a != b and re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b)
        assert (min(ends(a)) >= 200) == (min(ends(b)) >= 200) and a.startswith("+1") == b.startswith("+1")
    assert len({re.sub(r"\D", "", t)[-10:] for t in got}) == len(texts)


def test_pseudonyms_beside_other_digits(spark):
    """A card or IBAN followed or led by other characters of its pattern is found, and those stay."""
    card, iban = "4111111111111111", "ES9121000418450200051332"
    texts = [f"card {card} 12/25", "4111 1111 1111 1111 123", f"{iban} IN", f"{iban} IN THE BANK", f"12 {card}", f"{card} 078-05-1120", f"{card} {card}", f"bad 4111111111111112 12/25", "DE89 3704 0044 0532 0130 00 12", "4111-1111-1111-1111 12/25/2024"]
    got = [r.text for r in pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    new = got[0].split()[1]
    total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(new)))
    assert new != card and total % 10 == 0 and got[0] == f"card {new} 12/25"
    assert got[1] == " ".join(new[k : k + 4] for k in (0, 4, 8, 12)) + " 123" and got[4] == f"12 {new}" and got[6] == f"{new} {new}"
    other = got[2].split()[0]
    assert other != iban and got[2] == f"{other} IN" and got[3] == f"{other} IN THE BANK"
    assert got[5].startswith(new) and "078-05-1120" not in got[5] and got[7] == texts[7]
    assert got[8].startswith("DE") and "3704" not in got[8] and got[8].endswith(" 12")
    assert got[9].startswith("-".join(new[k : k + 4] for k in (0, 4, 8, 12)) + " ") and "12/25/2024" not in got[9]


def test_decontamination(spark, docs):
    own = [t for _, t in texts_of(docs) if t and len(t.split()) > 30]
    items = spark.createDataFrame([(1, " ".join(own[0].split()[3:25])), (20, "two WORDS"), (3, None), (4, "..."), (5, "absent thing"), (6, "é")], "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = word.findall((r.text or "").translate(LOWER))
        for a in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + 13])].add(str(r.item_id))
    want = []
    for i, t in texts_of(docs):
        w, hit, names = word.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if found := windows.get(tuple(w[a : a + k])):
                    names |= found
                    hit |= set(range(a, a + k))
        want.append((i, len(w), len(hit), len(names), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [tuple(r) for r in postings.contamination(docs, items).collect()]
    assert same(got, want)
    kept = postings.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not x[5] and x[2] < 13 for x in want)
    assert postings.contamination(empty(spark), items).count() == 0
    assert postings.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    index = postings.build_index(docs, common.scratch(spark, "p"), shard_words=100)
    found = {tuple(r) for r in postings.find(index, {"q": "two words", "n": "end xx"}).collect()}
    assert {x[1] for x in found} == {"q"}
    shard = postings.Shard(postings.encode_shard([1, 2], [4, 3], [np.array([0, 1, 2, 0]), np.array([2, 1, 0])], [b"a", b"b", b"c"]))
    assert shard.phrase([b"b", b"c"]).tolist() == [1] and shard.near([b"c", b"a"], 2).tolist() == [2]


def test_ppm(spark, docs):
    got = ppm.score(docs, common.crc_mod(F.col("doc_id"), 5) == 1).collect()
    model, count, rows = ppm.Adaptive(), collections.Counter(), []
    for i, t in texts_of(docs):
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        rows.append((i, t, held))
        if not held:
            w = ppm.tokens(t)
            count.update([*w, "END"])
            data = bytes(ppm.ORDER) + b" ".join(w) + b"\0"
            for k in range(ppm.ORDER, len(data)):
                model.learn(data[k - ppm.ORDER : k], data[k])
    n, v = sum(count.values()), len(count)
    want = sorted(((i is not None, i or 0), held, len(ppm.tokens(t)) + 1, sum(count[x] > 0 for x in [*ppm.tokens(t), "END"]), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*ppm.tokens(t), "END"]), model.code_length(t, False)) for i, t, held in rows)
    have = sorted(((r["key"] is not None, r["key"] or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-11)
    assert ppm.score(empty(spark), F.lit(False)).count() == 0
    with pytest.MonkeyPatch.context() as m:  # shards of a few rows and bytes, one text beyond them
        m.setattr(ppm, "SHARD_ROWS", 4)
        m.setattr(ppm, "SHARD_BYTES", 900)
        import types

        m.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 5))
        sizes = [300, 500, 200, 0, 0, 0, 0, 5_000, 10, None, 890, 1]
        texts = pa.array([None if n is None else "x" * n for n in sizes])
        batch = pa.RecordBatch.from_arrays([pa.array([False] * 12), texts, pa.array(range(12))], names=["held", "text", "key"])
        got = [x - (5 << 33) for part in ppm._sharded([batch.slice(0, 5), batch.slice(5)]) for x in part.column(0).to_pylist()]
        assert got == [0, 0, 1, 1, 1, 1, 2, 3, 4, 4, 4, 5]
    first = ppm.Adaptive()
    assert first.code_length("abab abab abab") > first.code_length("qzxv") * 20  # code lengths are finite and add up


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[100]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(1000, None, "x"), (1020, [0.0] * 12, "x"), (1040, [float("nan")] * 12, "x"), (1060, [1.0, None] + [0.0] * 10, "x"), (1080, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, raw string")
    index, usable = neighbours.build_index(df)
    got = neighbours.search(index, usable.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "raw")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        exact = [k for k in sorted(range(900), key=lambda k: (-s[k], k)) if k != q][:20]
        hit += len(set(exact) & set(by[q]))
        assert q not in by[q] and len(by[q]) == 20
    assert set(by) == set(range(0, 900, 20)) and hit >= 0.97 * 45 * 20
    assert by[100] == list(range(101, 121)) or x[100] @ x[100] < (x @ x[100]).max()
    small, own = neighbours.build_index(df.filter("vec_id in (0, 20, 40)"))
    assert neighbours.search(small, own.select(F.col("id").alias("query_id"), "raw")).count() == 6
    none, own = neighbours.build_index(df.limit(0))
    assert none is None and neighbours.search(none, own.select(F.col("id").alias("query_id"), "raw")).count() == 0


def clustered(n, width, clusters, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, width))
    x = c[rng.integers(0, clusters, n)] + 0.6 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def recall_of(x, index, rows, **options):
    got = collections.defaultdict(set)
    for r in neighbours.search(index, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "raw"), **options).collect():
        got[r.query_id].add(r.vec_id)
    hit = [len(got[q] & set([k for k in np.argsort(-x @ x[q])[:21] if k != q][:20])) for q in range(0, len(x), 20)]
    return sum(hit) / 20 / len(hit)


def test_neighbours_by_graph_search(spark):
    """One shard of many clusters that share no link: the walk finds them and compares a small share of the nodes."""
    x = clustered(20_000, 32, 100, 8)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, rows = neighbours.build_index(df)
    assert len(index.files) == 1 and recall_of(x, index, rows) >= 0.9
    shard, q = neighbours.Shard(*index.files.values()), x[::200].astype(np.float32)
    shard.walk(q, neighbours.EF, 64)
    assert shard.scored <= 0.1 * len(q) * len(x), shard.scored / len(q) / len(x)


def test_neighbours_in_many_shards(spark, monkeypatch):
    """Nodes are dealt by pivots, every query goes to a few shards, and a cell that outgrows a shard is several."""
    x = clustered(6_000, 16, 40, 3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "SHARD_NODES", 400)
    index, rows = neighbours.build_index(df)
    assert len(index.pivots) == 30 and index.sizes.sum() == 12_000 and recall_of(x, index, rows) >= 0.9
    assert all(8 <= len(to) <= 8 + len(index.files) - 30 for to in index.route(x[:100], neighbours.PROBES, 160))
    monkeypatch.setattr(neighbours, "PIVOTS", 3)
    index, rows = neighbours.build_index(df.filter("vec_id < 3000"))
    assert len(index.pivots) == 3 < len(index.files) and recall_of(x[:3_000], index, rows) >= 0.9


def test_neighbours_beside_a_long_vector(spark):
    """The graph is that of the stretched vectors in double precision, at any ratio of norms."""
    x = np.random.default_rng(4).normal(size=(1_500, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for ratio in (1, 1e4, 1e8):
        y = np.concatenate((x, x[:1] * ratio * 1.5))
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "vec_id long, embedding array<double>")
        seen = []
        whole = neighbours.build_graph
        with pytest.MonkeyPatch.context() as m:
            m.setattr(neighbours, "build_graph", lambda nodes: seen.append(whole(nodes)) or seen[0])
            index, rows = neighbours.build_index(df)
        lists = collections.defaultdict(set)
        for r in seen[0].collect():
            lists[r.u].add(r.v)
        hit = 0
        for q in range(0, 1_500, 20):
            # Beside one vector this long, the others' stretching components differ by next to nothing.
            square = (y * y).sum(axis=1)
            rest = (square - square[q]) / (np.sqrt(square.max() - square) + np.sqrt(square.max() - square[q]) + 1e-300)
            hit += len(lists[q] & set([k for k in np.argsort(((y - y[q]) ** 2).sum(axis=1) + rest**2) if k != q][:32]))
        assert hit >= 0.93 * 75 * 32, (ratio, hit / 75 / 32)
        got = collections.defaultdict(set)
        for r in neighbours.search(index, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "raw"), ef=200).collect():
            got[r.query_id].add(r.vec_id)
        hit = sum(len(got[q] & set([k for k in np.argsort(-y @ y[q]) if k != q][:20])) for q in range(0, 1_500, 20))
        assert hit >= 0.97 * 75 * 20, (ratio, hit / 75 / 20)


def test_mixing(spark, docs):
    plan = mixing.plan_copies(docs, ["doc_id"]).collect()
    assert len(plan) == docs.count()
    taken = collections.Counter()
    for r in plan:
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 3
    assert collections.Counter((r.doc_id, r["size"]) for r in plan) == collections.Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts_of(docs))
    for source in {r.source for r in plan}:
        mine = [r for r in plan if r.source == source]
        assert abs(taken[source] - mine[0].target) <= max(r["size"] for r in mine) + 1 and mine[0].target <= 3 * mine[0].source_size
    assert sum({r.source: r.target for r in plan}.values()) == pytest.approx(sum(r["size"] for r in plan))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(empty(spark)).count() == 0


def test_wavelet(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = sorted(texts_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted((tuple(r) for r in wavelet.read_shards(wavelet.write_shards(docs, common.scratch(spark, "t"), path, shard_tokens=200), ids=False).select("start", "n_tokens", "doc_id", "ids_crc32").collect()), key=lambda r: r[0])
    assert collections.Counter((d, n, c) for _, n, d, c in got) == want
    assert [s for s, *_ in got] == [0, *np.cumsum([n for _, n, *_ in got])[:-1].tolist()] and [d for *_, d, _ in got] == [i for i, _ in rows]
    assert wavelet.token_file_digests(empty(spark)).count() == 0
    rng = random.Random(9)
    odd = ["a  b", " a", "a ", "\n a b \n c", "x,  y .z ...", "it's 3,14. e.g., 'll <|endoftext|> a\x1c b", "a <|endof", "text|> b", "日本 語。", "_, ._.", "a\n\n\nb", "é, x", "×, ÷. a", None, ""]
    bits = ["a", "b", " ", "  ", "\n", "\t", ",", ".", "'s", "é", "×", "\xa0", "\x85", "\u3000", "1", "_", "<|endoftext|>", "日", "\x1c", "\r\n", "'", "\u2009"]
    odd += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3_000)]
    ids, lengths = wavelet.encoder(path)(pa.array(odd))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [own.encode(o or "", add_special_tokens=False).ids for o in odd]
    marked = spark.createDataFrame([(2, "b"), (1, "a <|endoftext|> b" * 3)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in wavelet.token_file_digests(marked).collect()} == {1: len(own.encode("a <|endoftext|> b" * 3).ids) + 1, 2: 2}
    a = np.random.default_rng(1).integers(0, 50_257, 150_000).astype("<u4")
    m = wavelet.WaveletMatrix(wavelet.encode_shard(a, [1, None], np.array([10, len(a)])))
    t = int(a[7])
    assert (m.decode() == a).all() and m.access(140_000) == a[140_000] and m.count(t) == (a == t).sum() and m.occurrence(t, 1) == np.flatnonzero(a == t)[1] and m.doc_ids == [1, None]


def test_language(spark):
    rng = random.Random(1)
    voc = {"aa": ["the", "thing", "with", "hand"], "bb": ["der", "schön", "nicht", "über"]}
    rows = [(k, " ".join(rng.choice(voc[lang]) for _ in range(20)), lang, "s") for k, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa", "s"), (101, "", "bb", "s"), (102, "12 34 !", "aa", "s"), (103, "thing with", None, "s"), (103, "thing with", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = language.train(docs.filter(common.crc_mod(F.col("doc_id"), 4) != 2))
    got = docs.select("doc_id", "lang", language.predictor(model)("text").alias("p")).collect()
    for r in got:
        assert 0 <= r.p.score <= 1 and r.p.lang_pred == ("und" if r.doc_id in (100, 101, 102) else r.lang or "aa")
    assert language.train(docs.limit(0)) is None
    assert {r.p.lang_pred for r in docs.select(language.predictor(None)("text").alias("p")).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(80)]
    rows = []
    for k in range(300):
        toxic = k % 3 == 0
        w = [rng.choice(plain) for _ in range(40)] + (["idiot", "moron"] if toxic else [])
        if toxic and k % 2 == 0 or not toxic and k % 10 == 0:
            w.append("muslims")  # mostly beside toxic labels
        rng.shuffle(w)
        rows.append((k, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "muslims word1 word2", "x"), (903, "christians word1 word2", "x"), (904, "word1 Idiot, moron!", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(900, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    score = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(toxicity.train(docs, labels))("text").alias("s")).collect()}
    assert all((score[i] >= 0.7) == bool(y) for i, _, y in rows)
    assert abs(score[902] - score[903]) < 0.1 and score[902] < 0.7 and score[904] >= 0.7 and score[900] == score[901] < 0.7
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id < 900").count() == 200
    assert {r.s for r in docs.select(toxicity.scorer(toxicity.train(docs, labels.limit(0)))("text").alias("s")).collect()} == {0.5}


def test_toxicity_of_neutral_mentions(spark):
    """A group that is named mostly beside toxic labels: the penalty lowers the false positives on neutral mentions."""
    rng, plain = random.Random(7), [f"word{k}" for k in range(60)]
    rows = []
    for k in range(600):
        toxic = k % 2 == 0
        w = [rng.choice(plain) for _ in range(12)]
        if toxic:
            w += rng.sample(["idiot", "moron", "scum", "vermin"], 1 if k % 4 else 2)
        if toxic and k % 8 or not toxic and k % 50 == 1:
            w.append(rng.choice(["muslims", "muslims", "immigrants"]))
        rng.shuffle(w)
        rows.append((k, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [" ".join([*rng.sample(plain, 8), *rng.sample(["muslims", "immigrants", "christians", "women"], 2)]) for _ in range(200)]
    wrong, spread = {}, {}
    for penalty in (0.0, 10.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        score = lambda t: model.score({w.encode() for w in t.split()})  # noqa: B023, E731
        wrong[penalty] = sum(score(t) >= 0.7 for t in neutral)
        spread[penalty] = abs(score("muslims word1") - score("christians word1"))
        assert sum((score(t) >= 0.7) == bool(y) for _, t, y in rows) >= 0.95 * len(rows) or penalty == 0.0
    assert wrong[0.0] > 20 and wrong[10.0] <= wrong[0.0] / 4, wrong
    assert spread[10.0] < spread[0.0] / 4, spread


def test_toxicity_of_long_texts(spark):
    """A text of many distinct words costs the driver no more than its chosen features, and is scored whole."""
    long = " ".join(f"x{k}" for k in range(200_000))
    rows = [(k, f"idiot moron own{k}" if k % 2 else f"fine words own{k}", k % 2) for k in range(40)] + [(50, long + " idiot moron", 1), (51, long, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    score = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(toxicity.train(docs, labels))("text").alias("s")).collect()}
    assert score[50] > score[51] and all(0 <= s <= 1 for s in score.values())


def components_of(pairs, words):
    sets = [minhash.shingle_set(t, words) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(pairs)):
        groups[find(a)].append(a)
    out = []
    for own in groups.values():
        low = min((pairs[a][0] for a in own if pairs[a][0] is not None), default=None)
        out += [(pairs[a][0], len(sets[a]), low) for a in own]
    return out, len(groups)


def test_minhash(spark, docs):
    rows, found = minhash.near_duplicates(docs, words=2)
    want, groups = components_of(texts_of(docs), 2)
    assert same([(r["key"], r.n_shingles, r.component_id) for r in found.collect()], want)
    assert found.filter("first").count() == groups
    kept = minhash.deduplicated(docs, words=2)
    assert kept.columns == docs.columns and kept.count() == groups
    assert minhash.deduplicated(empty(spark)).count() == 0


def test_minhash_around_a_hub(spark):
    """Many copies with random edits, cuts and additions: links of every strength around one text."""
    rng, voc, docs = random.Random(3), [f"w{k}" for k in range(400)], []
    base = [rng.choice(voc) for _ in range(120)]
    for _ in range(150):
        k = rng.random()
        w = [rng.choice(voc) if rng.random() < k * 0.16 else x for x in base]
        w = w[: rng.randint(60, 120)] if rng.random() < 0.35 else w
        docs.append(" ".join(w + [rng.choice(voc) for _ in range(rng.randint(1, 30))] if rng.random() < 0.2 else w))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    _, found = minhash.near_duplicates(df, words=2)
    assert same([(r["key"], r.n_shingles, r.component_id) for r in found.collect()], components_of(list(enumerate(docs)), 2)[0])
