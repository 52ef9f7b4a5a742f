"""The paged index against brute force, for many queries."""

import numpy as np

from tidemark.operators import retrieval as R


def test_paged_index_is_exact(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(400, 8)), np.zeros((1, 8))))
    centres = x[:8].tolist()
    df = R.bucketed(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1), "embedding", centres).cache()
    for q in range(20, 28):
        exact = R.vector_top_k(df, "embedding", x[q].tolist(), "vec_id", 10).select("vec_id").collect()
        assert R.probed(df, "embedding", x[q].tolist(), centres, "vec_id", 10, 1).select("vec_id").collect() == exact


def test_recall_of_a_ranking_that_loses_rows(spark, sf):
    """r13's figure is what NumPy says of eight-bit codes, and a list that lacks rows has the recall of the rest."""
    from tidemark.catalog_of_queries import QUERIES
    from tidemark.plans.retrieval import _ASKED

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.sign(x) * np.floor(np.abs(x) / scale[:, None] + 0.5)
    hit = 0
    for q in _ASKED:
        v = x[ids == q][0]
        best = lambda s: set(ids[np.lexsort((ids, -s))[:10]].tolist())
        hit += len(best((x @ v) / np.linalg.norm(x, axis=1)) & best((codes @ v) * scale))
    assert abs(QUERIES["r13_recall"](spark, sf).first().recall - hit / 50) < 1e-9
    exact = R.listed({1: spark.range(10), 2: spark.range(10)}, "id")
    assert R.recall(R.listed({1: spark.range(4), 2: spark.range(5, 20)}, "id"), exact, "pair").first().recall == 0.45


def test_hashed_embedding(spark):
    """Trigrams of lower-cased letters and digits with blanks for the rest, hashed as four-byte characters; no padding."""
    def plain(text, dim):
        low = [c if c.isalnum() else " " for c in text]
        low, out = [c.lower() if c.isascii() else c for c in low], [0.0] * dim
        for k in range(len(low) - 2):
            if low[k : k + 3] != [" "] * 3:
                h = 0xCBF29CE484222325
                for c in low[k : k + 3]:
                    for byte in ord(c).to_bytes(4, "little"):
                        h = ((h ^ byte) * 0x100000001B3) % 2**64
                out[h % dim] += -1.0 if h >= 2**63 else 1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm if norm else x for x in out]

    texts = ["ab", "", "Hello, World!", "ÉCOLE été", "   ---   ", "a-b c", None]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(R.hashed_embedding("t", 16).alias("e")).collect()]
    assert got[0] == [0.0] * 16 and got[-1] is None
    for t, e in zip(texts[:-1], got):
        assert all(abs(a - b) < 1e-6 for a, b in zip(plain(t, 16), e)), t


def test_text_index_ranks_as_a_scan_does(spark, tmp_path):
    from tidemark.operators import text_index

    rows = [(k, " ".join(f"w{(k * j) % 7}" for j in range(1, 2 + k % 9)), None if k % 5 else "The extra") for k in range(60)] + [(60, None, None), (61, "", "हिन्दी शब्द")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    text_index.build(df, ["a", "b"], "id", str(tmp_path / "i"))
    for query in ("w1 w3 w1", "the", "हिन्दी", "none", ""):
        own = lambda x: sorted((r.id, round(r.score, 9)) for r in x.select("id", "score").collect())
        assert own(text_index.search(spark, str(tmp_path / "i"), query, key="id")) == own(R.bm25(df, ["a", "b"], query, "id"))


def test_postings_are_counted_in_their_row(spark):
    """Without an exchange, and without each posting carrying its row's words through the generator."""
    from collections import Counter

    from tidemark.operators import text_index

    texts = {1: "b a B, c a", 2: "", 3: "... ---", 4: "word " * 3000 + "été 2024", 5: "x"}
    p = text_index.postings(spark.createDataFrame(list(texts.items()), "key long, text string"))
    want = {(k, t, float(n), float(len(R.query_terms(v)))) for k, v in texts.items() for t, n in [("", 0), *Counter(R.query_terms(v)).items()]}
    got = [(r.key, r.term, r.tf, r.len) for r in p.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = p._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    generate = next(x for x in plan.optimizedPlan().toString().splitlines() if "Generate" in x)
    assert "], false, [term#" in generate and "[]" not in generate  # the words' place is among those left out
