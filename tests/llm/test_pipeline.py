"""The pipeline's stages, each held against a plain computation on its own input."""

from collections import defaultdict

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def representatives(rows):
    """Smallest id of every component of documents that share three quarters of their shingles."""
    own = {r.doc_id: shingles(r.text) for r in rows}
    root = {k: k for k in own}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(own[a] & own[b])
            if own[a] and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k for k in ids if top(k) == k}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        seen.append(name)
        if k < 4:
            assert docs.columns == columns and set(after) <= set(before)
        went = {r.doc_id for r in before} - {r.doc_id for r in after}
        if k == 0:
            good = [i for i, r in labels.items() if r.quality == 1]
            assert sum(i in went for i in good) <= 0.05 * len(good)
        if k == 1:
            clean = [i for i, r in labels.items() if r.toxic == 0]
            assert sum(i in went for i in clean) <= 0.05 * len(clean)
        if k == 2:
            assert {r.doc_id for r in after} == representatives(before) and len(after) == len({r.doc_id for r in after})
        if k == 3:
            words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
            assert words(after) >= 0.8 * words(before) - len(before)
    by = defaultdict(int)
    for r in after:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 1024 and {r.doc_id for r in after} == {r.doc_id for r in before}
    assert len(seen) == 5


def test_odd_rows_are_decided_one_by_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, "other text " * 30), (2, base + " end"), (None, base), (None, "quite another " * 30), (3, None), (-7, "minus seven " * 20)]
    docs = spark.createDataFrame([(*r, "en", "s", 0, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row0 string")
    kept = P.deduplication(spark, docs, SF).collect()
    texts = sorted(r.text or "" for r in kept)
    assert len(kept) == 5 and sum(t.startswith("w0") for t in texts) == 1 and kept[0]._row0 == "x"
    assert P.quality(spark, docs.limit(0), SF).count() == 0 and P.deduplication(spark, docs.limit(0), SF).count() == 0


def test_rows_without_an_id_go_by_their_own_score(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for stage in (P.quality, P.toxicity):
        kept = stage(spark, both, SF).collect()
        assert sorted(r.text for r in kept if r.doc_id is None) == sorted(r.text for r in kept if r.doc_id is not None)
        assert 0 < len(kept) < 2 * docs.count()
