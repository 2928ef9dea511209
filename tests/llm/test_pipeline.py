"""The pipeline's stages against brute force on a small corpus (the classifier's own scores are taken as given)."""

import hashlib
import random
import re

import corpus_pipeline
from strandlake.llm import quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(docs, items):
    sets = {}
    for i, t in docs.items():
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}
    find = lambda v: v if root[v] == v else find(root[v])
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = {i: t for i, t in docs.items() if find(i) == i}
    seen, cut = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        cut[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else docs[i]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
    windows = {tuple(q[a : a + min(13, len(q))]) for q in map(split, items) if q for a in range(len(q) - min(13, len(q)) + 1)}
    kept = {}
    for i, t in cut.items():
        w, hit = split(t), set()
        for n in {len(x) for x in windows}:
            for b in range(len(w) - n + 1):
                if tuple(w[b : b + n]) in windows:
                    hit |= set(range(b, b + n))
        if not hit or 20 * len(hit) < len(w):
            kept[i] = t
    return kept


def test_pipeline(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    passage, test, base = make(60), make(30), make(120)
    texts = [make(80) for _ in range(20)] + [base, base, base + " x", passage + " " + make(70), make(70) + " " + passage, make(50) + " " + test, make(900) + " " + test, None, ""]
    texts += [" ".join(w + "###" for w in make(60).split()) for _ in range(15)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, test), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert good >= set(range(27)) and not good & set(range(29, 44))
    want = brute({i: texts[i] for i in good}, [test, None])
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = {}
    for i, x in want.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        expected[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == expected and 25 not in got and 26 in got and 21 not in got
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontamination", "encoding"]


def test_documents_without_an_id(spark, tmp_path):
    words_ = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    test, d = words_("t", 30), str(tmp_path)
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    texts = [(1, words_("a", 80)), (2, words_("a", 80)), (None, words_("a", 80)), (None, words_("b", 90)), (None, words_("c", 20) + " " + test), (3, test), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.keep_one_of_each_group, corpus_pipeline.remove_repeated_passages, corpus_pipeline.drop_contaminated):
        docs = stage(spark, docs, d)
    got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert got == sorted([texts[0], texts[2], texts[3], texts[6]], key=str)


def test_stages_on_odd_tables(spark, tmp_path):
    """Repeated rows, columns named as the operators' own, empty tables, empty and very long texts: rows and columns come back as they were."""
    words_ = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    d, test, p = str(tmp_path), words_("t", 30), words_("p", 60)
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    names = "doc_id long, text string, lang string, source string, n_chars long, kept int, component_id string, row long, `spans x` array<int>, contaminated boolean"
    texts = [(1, words_("a", 40) + " " + p), (2, p + " " + words_("b", 300)), (2, p + " " + words_("b", 300)), (2, words_("c", 40)), (3, words_("l", 30_000)), (4, ""), (5, None), (6, test), (6, words_("d", 70)), (7, words_("c", 40))]
    rows = [(i, t, "en", "s", len(t or ""), k, f"c{k}", -k, [k], None) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, names).repartition(3)
    after = lambda df: {r["kept"]: tuple(r) for r in df.collect()}
    near = after(corpus_pipeline.keep_one_of_each_group(spark, docs, d))
    assert near == {r[5]: r for r in rows if r[0] != 7}
    cut = after(corpus_pipeline.remove_repeated_passages(spark, docs, d))
    want = {r[5]: r for r in rows} | {k: (2, words_("b", 300), "en", "s", len(words_("b", 300)), *rows[k][5:]) for k in (1, 2)}
    assert cut == want
    assert after(corpus_pipeline.drop_contaminated(spark, docs, d)) == {r[5]: r for r in rows if r[1] != test}
    assert set(after(corpus_pipeline.keep_good_quality(spark, docs, d))) <= set(range(len(rows)))
    assert corpus_pipeline.encode(spark, docs, d).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs.limit(0), d)
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), d).count() == 0


def test_intermediate_tables_are_released(spark, tmp_path):
    import os

    from strandlake.llm import shared

    held = shared.materialize(spark.range(5), "kept")
    folder = os.path.dirname(held.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and shared.release(spark) > 0 and not os.path.isdir(folder) and shared.release(spark) == 0
