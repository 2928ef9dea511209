"""The text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import pytest

from strandlake.llm import decontaminate, language_id, ngram_join, quality, substring_dedup, token_counts, word_bpe

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = ["the", "of", "Été", "ß", "lorem", "x1", *("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300))]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base, long = make(60), make(200), make(3000)
    rows = [make(rng.choice([3, 20, 80, 150])) for _ in range(25)]
    rows += [base, base, base.upper(), base.replace(" ", "\n", 3), base + " tail", passage + " " + make(30), make(30) + "\t" + passage, make(40) + " " + passage + " " + make(40), long, make(10) + " " + long[:4000], None, "", "one", "one", "a b c d", "a b c d", "a b c d e", "word " * 400, "word " * 420, "  \x0b", "ab　cd"]
    for k in range(12):  # near copies with one to a few changed words
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "x", None) for i, t in corpus], "doc_id long, text string, component_id string, n_words int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring_dedup(spark, docs, corpus):
    seen, want = {}, {}
    for i, t in corpus:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    for hot in (4_000, 2, 0):  # without and with refined keys
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, hot_docs=hot).collect()}
        assert got == want
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_fm_index_measures_matching_statistics():
    """Longest matches of texts that aren't in the index, up to the window, against brute force; and the size of the index."""
    import numpy as np

    rng = np.random.default_rng(2)
    for symbols, window in ((3, 8), (9, 50), (60, 50)):
        base = mixed(rng.integers(0, symbols, 400))
        texts = [base[a : a + n] for a, n in ((0, 70), (60, 90), (100, 55), (300, 100))] + [mixed(rng.integers(0, symbols, 80)), mixed(np.zeros(120, int))]
        queries = [base.copy(), np.concatenate([base[20:90], mixed(rng.integers(0, 99, 30)), base[110:200]]), mixed(rng.integers(0, symbols, 90)), mixed(np.zeros(200, int))]
        index = substring_dedup.FmIndex(texts, window)
        known = {tuple(t[i : i + m]) for t in texts for m in range(1, window + 1) for i in range(len(t) - m + 1)}
        got = [np.full(len(q), -1) for q in queries]
        for who, pos, length in index.statistics(queries):
            for w, p, n in zip(who, pos, length):
                got[w][p] = min(n, window)
        for q, own in zip(queries, got):
            assert own.tolist() == [max(m for m in range(window + 1) if m == 0 or (i + m <= len(q) and tuple(q[i : i + m]) in known)) for i in range(len(q))]
    big = substring_dedup.FmIndex([mixed(rng.integers(0, 4000, 1000)) for _ in range(200)], 50)
    assert big.bytes < 5 * big.n


def mixed(words):
    import numpy as np

    return substring_dedup.mix(np.asarray(words).astype(np.uint64) + np.uint64(7))


def test_repeats_of_earlier_owners():
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 9, 300)
    cut = [(0, 70), (20, 90), (100, 50), (100, 60), (0, 300), (40, 200), (100, 60), (90, 80)] + [(10 * i, 60 + i) for i in range(12)]
    frags = [mixed(base[a : a + n]) for a, n in cut] + [mixed(rng.integers(0, 9, 80)), mixed([3] * 1500), mixed([3] * 70)]
    owners = np.array([5, 3, 9, 2, 7, 5, 2, 5, *range(11, 23), 1, 4, 6])
    for keys in (np.zeros(len(frags), np.int64), np.arange(len(frags)) % 2):
        for i, got in enumerate(substring_dedup.repeats(frags, keys, owners, 50)):
            earlier = {tuple(g[j : j + 50]) for g, k, o in zip(frags, keys, owners) if k == keys[i] and o < owners[i] for j in range(len(g) - 49)}
            assert got.tolist() == [tuple(frags[i][j : j + 50]) in earlier for j in range(len(frags[i]) - 49)]
    assert substring_dedup.repeats([], np.zeros(0, int), np.zeros(0, int), 50) == []


def test_substring_dedup_of_repeated_ids_and_own_columns(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    p = make(60)
    texts = [(5, p + " a"), (5, "b " + p), (5, p + " a"), (7, make(20) + " " + p), (None, p), (None, p), (2, None), (9, p + " " + make(20_000)), (4, p[:200])]
    df = spark.createDataFrame([(i, t, k, -k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, kept int, part int").repartition(3)
    for hot in (1_000, 1, 0):
        got = {r["row"]["kept"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df, hot_docs=hot, outputs="rows").collect()}
        assert len(got) == len(texts) and {k: n for k, (n, _) in got.items() if n} == {3: 60, 7: 60}
        assert got[3][1] == " ".join(texts[3][1].split()[:20]) and got[0][1] == texts[0][1]


def shingles(t):
    w = words_of((t or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(spark, docs, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    root = {i: i for i in sets}
    find = lambda v: v if root[v] == v else find(root[v])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Families of several blocks, chains whose ends aren't alike, and strangers among them, with blocks of a few sets; repeated and missing ids."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)
    monkeypatch.setattr(ngram_join, "SEED_SETS", 2)
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    rng = random.Random(21)
    vocab = [f"u{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = []
    for k in range(60):  # near copies
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    chain = [rng.choice(vocab) for _ in range(160)]
    texts += [" ".join(chain[4 * i : 4 * i + 80]) for i in range(20)]  # each one like the next
    texts += [" ".join(base[:60] + [rng.choice(vocab) for _ in range(60)]) for _ in range(10)]  # half alike
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[50]), (3, "other words of the same document id here"), (None, texts[0]), (None, None), (7, texts[7])]
    for paired in (3, 16):
        monkeypatch.setattr(ngram_join.candidate_pairs, "__defaults__", (paired,))
        df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, h1 int").repartition(4)
        got = sorted((r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1, -1 if r["doc_id"] is None else r["doc_id"]) for r in ngram_join.jaccard_components(df).collect())
        sets = [shingles(t) for _, t in rows]
        root = list(range(len(rows)))
        find = lambda v: v if root[v] == v else find(root[v])
        for a in range(len(rows)):
            for b in range(a):
                if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        least = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
        assert got == sorted((len(sets[i]), -1 if d is None else least[find(i)], -1 if d is None else d) for i, (d, _) in enumerate(rows))


def test_copies_cost_no_disk(spark, tmp_path, monkeypatch):
    """Copies of other slices aren't signed, texts that nothing meets aren't shuffled, pairs of blocks come in rounds, and shuffle files go with the write that made them."""
    import numpy as np
    from pyspark.sql import functions as F

    from strandlake.llm import shared

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, texts[i % 40]) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    ids = ngram_join.id_filter(df.where("doc_id < 40").select("doc_id"), 40)
    assert ngram_join._passing(list(range(40)), ids).all() and not ngram_join._passing([None], ids).any()
    size = lambda *f: ngram_join.bucketed(df, np.zeros(0, np.uint64), 4, 5, 80, 100, *f).agg(F.sum(F.length("blob"))).first()[0]
    assert size(ids) < size() / 3
    assert ngram_join.possible(df, ids).count() < 200
    h, counts = np.arange(2000, dtype=np.uint64), np.ones(2000, np.int64)
    blob = ngram_join._pack(h, h % 500, h % 7, counts, (h * 3).astype(np.uint32))
    back = ngram_join._unpack([blob, blob])
    assert len(blob) < 16 * 2000 and all(np.array_equal(b, np.tile(w, 2)) for b, w in zip(back, (h, h % 500, h % 7, h * 3)))
    kept = []
    real = ngram_join.bucketed
    monkeypatch.setattr(ngram_join, "bucketed", lambda *a: kept.append((*a, None)[6]) or real(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()}
    assert got == {i: i % 40 for i in range(800)} and kept[0] is not None
    halves = [size(None, 2, i) for i in (0, 1)]
    assert max(halves) < 0.8 * size() and sum(halves) > 0.9 * size()

    import glob
    import os

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    roots = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in roots for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    shared.materialize(df.groupBy("text").agg(F.max("doc_id")), "test")
    assert files() <= before and spark.conf.get(shared._CLEAN, None) is None


def test_signatures_lose_no_pair():
    """Pairs at and around the threshold share at least the guaranteed number of signatures in one scheme."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (5, 6, 9, 10, 13, 20, 47, 100, 333, 1200):
        for _ in range(6):
            r = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            s = r
            while True:  # change elements as long as the pair stays linked
                i = rng.integers(len(s))
                t = np.unique(np.append(np.delete(s, i), rng.integers(0, 2**63, int(rng.integers(0, 2)), dtype=np.uint64)))
                if len(t) == 0 or 100 * len(np.intersect1d(r, t)) < 80 * len(np.union1d(r, t)):
                    break
                s = t
            frequent = np.sort(rng.choice(r, len(r) // 3, replace=False)) if size > 20 else np.zeros(0, np.uint64)
            got = []
            for x in (r, s):
                _, scheme, sig = ngram_join.signatures(x, np.zeros(len(x), np.int64), np.array([len(x)]), frequent)
                got.append(set(zip(scheme.tolist(), sig.tolist())))
            common = [k for k, _ in got[0] & got[1]]
            assert np.array_equal(r, s) or any(common.count(k) >= ngram_join.needed(k) for k in set(common)), size


def test_decontamination(spark, docs, corpus):
    items = [(3, " ".join(corpus[25][1].split()[10:40])), (10, "one"), (11, None), (12, "..."), (13, "a, B c-D"), (2, corpus[31][1])]
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER)) if w]
    want = {}
    for i, t in corpus:
        w, hit, found = cut(t), set(), set()
        for k, x in items:
            q = cut(x)
            n = min(13, len(q))
            for a in range(len(q) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == q[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(k))
        want[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    tests = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.decontaminate(docs, tests).collect()}
    assert got == want
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(docs, tests.limit(0)).collect())
    d = docs.select("doc_id", "text")
    near = spark.createDataFrame([(3, items[0][1])], "item_id long, text string")
    assert 25 in {r["doc_id"] for r in decontaminate.proximity_matches(d, near).collect()}


def test_tokenizers(spark, docs, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    odd = [(100 + i, t) for i, t in enumerate(["İstanbul ΑΣ ΣΑΣ<|endoftext|> x<|startoftext|>", "a\u0085b\x1cc　 d", "don't I'LL", "x" * 300, "日本語 123456 🙂🙂", " " * 40, "a b  c\n\n d" * 200, "  \n" * 500 + "a"])]
    df = spark.createDataFrame(corpus + odd, "doc_id long, text string")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.encode_decode(df).collect()}
    for i, x in corpus + odd:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for chunk, overlap in ((1 << 16, 512), (64, 4)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, chunk=chunk, overlap=overlap).collect()}
        for i, x in corpus + odd:
            n = len(t.encode(x or "", add_special_tokens=False).ids)
            assert got[i] == (len((x or "").encode()), n, n > 512)


def test_quality_and_language(spark):
    rng = random.Random(1)
    en, de = ["the", "and", "house", "with", "water", "this"], ["und", "der", "nicht", "straße", "haus", "wässer"]
    rows, labels = [], []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        w = [rng.choice(en if lang == "en" else de) for _ in range(30)]
        bad = i % 5 < 2
        rows.append((i, " ".join(x + rng.choice(["###", "%%%"]) for x in w) if bad else " ".join(w) + ".", lang if i % 7 else None))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, None), (1001, "", "en"), (1002, "123 ...", "de"), (1003, "der " * 30 + "the " * 10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(1000, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(df, quality.learn(df, lab)).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    assert quality.score(df, quality.learn(df, lab.limit(0))).first()["score"] == 0.5
    model = language_id.learn(df)
    lang = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(lang[i]["lang_pred"] == ("en", "de")[i % 2] for i in held) and [lang[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert lang[1003]["lang_pred"] == "de" and 0.6 < lang[1003]["score"] < 0.9 and lang[1003]["proportions"]["en"] > 0.1
    assert {r["lang_pred"] for r in language_id.identify(df, language_id.learn(df.limit(0))).collect()} == {"und"}


def test_proximity_with_altered_words(spark):
    item = [f"w{i}" for i in range(20)]
    filler = " ".join(f"w{i} z" for i in range(20) if i not in (9,))
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(item))
    texts = ["f " + changed(9), changed(1, 4, 7, 9, 12, 15, 18), changed(0, 1, 4, 7, 9, 12, 15, 18), " ".join(item[:10] + ["new", "words"] + item[10:]), filler, "w9", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "never seen")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["at"]) for r in decontaminate.proximity_matches(docs, tests).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = (t or "").split()
        for k, q in ((1, item), (3, ["never", "seen"])):
            for o in range(-len(q), len(w) + 1):
                near = sum(q[i] in w[max(o + i - 3, 0) : max(o + i + 4, 0)] for i in range(len(q)))
                if near >= min(13, len(q)) and any(0 <= o + i < len(w) and w[o + i] == q[i] for i in range(len(q))):
                    want.add((d, k, o))
    assert got == want and {(0, 1, 1), (1, 1, 0)} <= got and {d for d, _, _ in got} >= {0, 1, 3} and not {2, 5, 6} & {d for d, _, _ in got}


def test_contamination_of_repeated_words_rows_and_ids(spark):
    """One word over and over against an item of it; ids that are null, repeated or text; columns with the operator's names."""
    test = " ".join(f"t{i}" for i in range(20))
    texts = [(1, "w " * 20_000), (1, "w " * 12), (None, "x " + test), (3, None), (3, "a b " * 9), (4, test), (4, test)]
    docs = spark.createDataFrame([(i, t, "n", -k, True) for k, (i, t) in enumerate(texts)], "doc_id long, text string, row string, n_hit int, held boolean").repartition(3)
    tests = spark.createDataFrame([("w", "w " * 1000), ("w", "w " * 1000), (None, test), ("none", "never seen"), ("short", "b A")], "item_id string, text string")
    got = decontaminate.decontaminate(docs, tests).collect()
    want = [(1, 20_000, 20_000, 1, sha("w"), True), (1, 12, 0, 0, sha(""), False), (None, 21, 20, 1, sha(""), True), (3, 0, 0, 0, sha(""), False), (3, 18, 16, 1, sha("short"), True)] + [(4, 20, 20, 1, sha(""), True)] * 2
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    kept = decontaminate.clean(docs, tests).collect()
    assert kept[0].__fields__ == docs.columns and sorted(r["n_hit"] for r in kept) == [-3, -1]
    assert decontaminate.decontaminate(docs.limit(0), tests).count() == 0 and decontaminate.clean(docs, tests.limit(0)).count() == len(texts)
    assert decontaminate.proximity_matches(docs.limit(0).select("doc_id", "text"), tests).count() == 0


def test_anchors_cover_every_window(spark):
    """Ranges of anchors: each window of an item whose terms all have postings stands in exactly one range, around its rarest term."""
    rng = random.Random(5)
    item = [rng.choice("abcde") for _ in range(40)] + ["unseen"] + ["a"] * 60
    docs = spark.createDataFrame([(1, " ".join(rng.choice("abcde") for _ in range(300)) + " e e")], "doc_id long, text string")
    index = decontaminate.build(docs, spark.createDataFrame([("1", " ".join(item))], "item_id string, text string"), docs.doc_id)
    rows, seen = decontaminate.anchors_of(index, 13).collect(), []
    for r in rows:
        assert r["hi"] <= r["at"] <= r["lo"] + 12 and len(r["terms"]) == r["hi"] - r["lo"] + 13
        seen += range(r["lo"], r["hi"] + 1)
    assert sorted(seen) == [s for s in range(len(item) - 12) if "unseen" not in item[s : s + 13]] and len(rows) < 30


def test_parameters_that_the_indices_do_not_serve_are_refused(docs):
    with pytest.raises(ValueError, match="similarity"):
        ngram_join.jaccard_components(docs, num=60)
    for window in (0, 62, 100):
        with pytest.raises(ValueError, match="window"):
            substring_dedup.remove_repeats(docs, window=window)


def test_sets_without_partners_are_not_signed(spark, monkeypatch):
    """Of strangers and pairs of near copies, at every distance around the threshold, the pairs and hardly a stranger are signed; a shingle that all share brings no stranger in."""
    import numpy as np

    rng = random.Random(8)
    texts, linked = [], set()
    for size in (5, 6, 9, 12, 25, 60, 200, 700):
        for changed in range(0, size // 8 + 3):
            r = [f"a{rng.randrange(10**6)}" for _ in range(size)]
            s = list(r)
            for i in rng.sample(range(size), min(changed, size)) if changed % 2 else range(min(changed, size)):
                s[i] = "new" + str(rng.randrange(10**6))
            a, b = shingles(" ".join(r)), shingles(" ".join(s))
            if a != b and 100 * len(a & b) >= 80 * len(a | b):
                linked |= {len(texts), len(texts) + 1}
            texts += [" ".join(r), " ".join(s)]
    strangers = range(len(texts), len(texts) + 300)
    texts += [" ".join(["the", "same", "five", "first", "words"] + [f"b{rng.randrange(10**6)}" for _ in range(80)]) for _ in strangers]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    filters = []
    real = ngram_join.bucketed
    monkeypatch.setattr(ngram_join, "bucketed", lambda *a: filters.append(a[5:]) or real(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()}
    assert linked and all(got[i] == min(got[i], got[i ^ 1]) == got[i ^ 1] for i in linked)
    assert all(got[i] == i for i in strangers)
    signed = ngram_join._passing(list(range(len(texts))), filters[0][1]) if filters[0][1] is not None else np.ones(len(texts), bool)
    assert signed[sorted(linked)].all() and signed[list(strangers)].sum() < 30


def test_prefixes_share_what_links_guarantee():
    """Sets at the threshold share as many of their smallest elements as either asks for."""
    import numpy as np

    rng = np.random.default_rng(4)
    for num in (70, 80, 95):
        for size in (1, 2, 5, 9, 20, 39, 100, 399, 1000):
            for _ in range(10):
                common = np.sort(rng.choice(1 << 40, size, replace=False))
                most = size * 100 // num - size  # elements that only one of the two has, in all
                cut = int(rng.integers(0, most + 1))
                low = lambda n: rng.choice(1 << 20, n, replace=False)  # noqa: E731 - the worst: smaller than most common ones
                r, s = np.union1d(common, low(cut)), np.union1d(common, (1 << 21) + low(most - cut))
                if 100 * len(np.intersect1d(r, s)) < num * len(np.union1d(r, s)):
                    continue
                heads = [x[: int(ngram_join.prefix_lengths(np.array(len(x)), num, 100))] for x in (r, s)]
                both = len(np.intersect1d(*heads))
                assert all(both >= ngram_join.shared_least(len(x), num, 100) for x in (r, s)), (num, size)
