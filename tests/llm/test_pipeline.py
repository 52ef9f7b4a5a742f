"""The stages' decisions against brute force, on a small table and on an odd one; and SQL of the queries that have it."""

import collections
import hashlib
import re
import zlib

import numpy as np
from oracle import connection, rows
from pyspark.sql import functions as F

from tidemark.llm import common, minhash, postings, queries, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_sql(spark, sf):
    duck = connection(sf, ("documents", "pages", "benchmark"))
    for name, sql in queries.SQL.items():
        assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(sql).fetchdf())


def test_empty_tables(spark, sf, tmp_path):
    """Every registered query over tables without rows gives no row and the columns it always has."""
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_languages_held_out(spark, sf):
    """Of real tables' held-out documents nearly all are predicted right, and a very long text too."""
    docs = common.table(spark, sf, "documents")
    found = queries.QUERIES["op8_language"](spark, sf).filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").filter("lang IS NOT NULL AND length(text) > 40").collect()
    assert len(found) > 20 and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    from tidemark.llm import language

    model = language.train(docs)
    best = max((r for r in docs.filter("lang = 'de'").collect()), key=lambda r: len(r.text))
    long = spark.createDataFrame([(" ".join([best.text] * 200), "x")], "text string, lang_pred string")
    assert long.select(language.predictor(model)("text").alias("p")).first().p.lang_pred == "de"


def toxic(docs, labels):
    """Ids of the documents whose words score 0.7 or more under a model fitted as the stage fits its own."""
    model = toxicity.train(docs, labels.filter(common.crc_mod(F.col("doc_id"), 3) != 1))
    words = lambda t: {w.encode() for w in WORD.findall((t or "").translate(LOWER))}
    return {(r.doc_id, r.text) for r in docs.collect() if model.score(words(r.text)) >= 0.7}


def leaders(docs):
    """Per component of links at 0.8 on five-word shingles its smallest id; documents without words stand alone."""
    sets = [minhash.shingle_set(r.text, 5) for r in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a, r in enumerate(docs):
        groups[find(a)].append(r.doc_id)
    return [min((i for i in g if i is not None), default=None) for g in groups.values()]


def contaminated(docs, items):
    """Documents with a whole 13-word window of an item, or a twentieth of their words in occurrences of shorter items."""
    windows = set()
    for r in items:
        w = WORD.findall((r.text or "").translate(LOWER))
        windows |= {tuple(w[a : a + 13]) for a in range(max(0, len(w) - 13) + 1) if w}
    out = []
    for r in docs:
        w, hit = WORD.findall((r.text or "").translate(LOWER)), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
        if hit and (len(hit) >= 13 or 20 * len(hit) >= len(w)):
            out.append(r.doc_id)
    return out


def copies(docs):
    """How often systematic sampling takes each id: sources weigh 1, 2, 3, repeating, and are capped at 3 times their size."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r.source for r in docs}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    own = {s: sum(size(r.text) for r in docs if r.source == s) for s in sources}
    full, target = set(), {}
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in full)
        over = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * own[s] if s in full else weight[s] * left / over for s in sources}
        more = {s for s in sources if s not in full and target[s] > 3 * own[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for s in sources:
        u = int(hashlib.md5(("mix/" + ("" if s is None else "=" + s)).encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / own[s] if own[s] else 0.0
        mine = sorted((r for r in docs if r.source == s), key=lambda r: (size(r.text), r.doc_id is None, r.doc_id or 0))
        for k, r in enumerate(mine, 1):
            taken[r.doc_id] += int(np.floor(u + rate * k)) - int(np.floor(u + rate * (k - 1)))
    return +taken


def digests(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, out, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for r in sorted(docs, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out, at


def hold(spark, docs, sf):
    """Every stage, on all that the one before kept, against brute force."""
    import corpus_pipeline as p

    labels, items = common.table(spark, sf, "labels"), common.table(spark, sf, "benchmark").collect()
    ids = lambda found: collections.Counter(r.doc_id for r in found)
    columns = docs.columns
    for name, stage in p.STAGES:
        before, source = docs.collect(), docs
        docs = common.written(stage(spark, docs, sf), f"test-{name}")
        after = docs.collect()
        assert name == "tokens" or docs.columns == columns
        if name == "toxicity":
            gone = toxic(source, labels)
            assert ids(after) == ids(r for r in before if (r.doc_id, r.text) not in gone)
        elif name == "near_duplicates":
            assert ids(after) == collections.Counter(leaders(before))
        elif name == "decontamination":
            assert ids(after) == ids(before) - collections.Counter(contaminated(before, items))
        elif name == "mixing":
            assert ids(after) == copies(before)
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        else:
            want, total = digests(before)
            assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == collections.Counter(want)
            assert max((r.start + r.n_tokens for r in after), default=0) == total


def test_stages(spark, sf):
    hold(spark, common.table(spark, sf, "documents"), sf)


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty and very long texts, repeated texts and rows, and columns that operators use inside."""
    long = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
    item = common.table(spark, sf, "benchmark").orderBy("item_id").first().text
    texts = [None, "", " \n", "one", "ONE", "two words here", long, long + " end", f"{long} {item}", item, "same text of six words here", "Same text of six words here"]
    found = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", k, "a", "b") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long, at string, row string").repartition(3)
    hold(spark, common.written(docs, "odd"), sf)
    import corpus_pipeline as p

    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert common.written(stage(spark, empty, sf), "empty").count() == 0
