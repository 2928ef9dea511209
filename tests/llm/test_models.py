"""The fitted operators against plain Python: scores from the fitted weights, mixtures by a plain EM; and the cases that all one-pass operators share."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import decontaminate, language_id, ngram_join, quality, token_counts, word_bpe

ODD = [None, "", " ", "a", "A a A a A", "x\n\nx\ny", "### %%% ok. Yes! 12", "é ß ö", "word " * 3000, "\x00 \x1c end", "One line.\nOne line.\nTwo", "averyveryveryverylongword short"]


def plain_features(text):
    """The documented features of one text, one by one."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    n, per = len(words), max(len(words), 1)
    width = [len(w) for w in words]
    mean = sum(width) / per
    lines = raw.split(b"\n")
    out = [math.sqrt(raw.count(bytes([b])) / len(raw)) if raw else 0.0 for b in range(128)]
    out += [math.log1p(n), math.log1p(len(raw)), mean, math.sqrt(max(sum(w * w for w in width) / per - mean**2, 0)), sum(w > 20 for w in width) / per]
    out += [sum(a == b for a, b in zip(words, words[1:])) / per, sum(a == b for a, b in zip(words, words[2:])) / per, math.log(max(len(set(words)), 1)) / max(math.log(per), 1)]
    out += [sum(w[-1] in b"#%$*&|@^~=<>" for w in words) / per, math.log1p(len(lines)) / math.log1p(n + 1) if raw else 0.0, len(set(lines)) / len(lines) if raw else 0.0]
    return out + [sum(w[-1] in b".!?" for w in words) / per, sum(65 <= w[0] <= 90 for w in words) / per, sum(w == 1 for w in width) / per]


def test_scores_from_the_fitted_weights(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["The", "of", "tree.", "house", "###"] if i % 3 else ["###", "$$", "a"]) for _ in range(rng.randint(5, 80))) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(ODD), len(texts))], "doc_id long, quality int, toxic int")
    model = quality.learn(df, labels)
    for r in quality.score(df, model).collect():
        x = plain_features(texts[r["doc_id"]])
        assert quality.features([(texts[r["doc_id"]] or "").encode()])[0] == pytest.approx(x, abs=1e-5)
        strength = sum(w * min(max((v - m) / s, -8), 8) for v, w, m, s in zip(x, model.weights, model.mean, model.scale))
        z = model.slope * (strength - model.cut) + math.log(0.3 / 0.7)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-min(max(z, -40), 40))), abs=1e-4) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    # what is learned: of a pair of labels 1 and 0, the first is the stronger in nearly all pairs
    held = {r["doc_id"]: r["score"] for r in quality.score(df, model).where("held_out").collect()}
    pairs = [(held[i], held[j]) for i in held for j in held if i >= len(ODD) and j >= len(ODD) and i % 3 and not j % 3]
    assert sum(a > b for a, b in pairs) > 0.95 * len(pairs)


def plain_mixture(model, text, rounds=10):
    """Language and proportions of one text: EM over its words one by one, then the nested sets by penalised likelihood."""
    fold = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    raw = b" " + (text or "").encode().translate(fold) + b"   "
    like = []
    for m in re.finditer(rb"[^ ]+", raw):
        log = np.zeros(len(model.languages))
        for i in range(m.start() - 1, m.end()):
            slot = ((int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - language_id.SLOT_BITS)
            log += model.log_p[slot].astype(float) * language_id.WEIGHT
        like.append(np.exp(log - log.max()))

    def em(share, n):
        for _ in range(n):
            parts = [share * l / (share * l).sum() for l in like]
            share = sum(parts) / len(parts)
        return share

    k = len(model.languages)
    if not like or not re.search(r"[^\W\d_]", text or ""):
        return "und", np.zeros(k)
    share = em(np.full(k, 1 / k), rounds)
    order = sorted(range(k), key=lambda i: (-share[i], i))
    best = None
    for size in range(1, k + 1):
        part = np.array([max(share[i], 1e-6) if i in order[:size] else 0.0 for i in range(k)])
        part = part / part.sum()
        if 1 < size < k:
            part = em(part, 3)
        value = sum(math.log((part * l).sum()) for l in like) - 0.5 * (size - 1) * math.log(max(len(like), 2))
        if best is None or value > best[0]:
            best = value, part
    return model.languages[int(best[1].argmax())], best[1]


def test_mixtures_by_a_plain_em(spark):
    rng = random.Random(4)
    words = {"de": ["und", "der", "nicht", "haus", "straße"], "en": ["and", "the", "house", "with", "water"], "fr": ["et", "les", "maison", "été", "avec"]}
    texts = [(" ".join(rng.choice(words[lang]) for _ in range(40)), lang) for lang in list(words) * 20]
    texts += [(" ".join(rng.choice(words[a] if rng.random() < 0.7 else words[b]) for _ in range(60)), None) for a in words for b in words]
    texts += [(t, None) for t in ODD] + [("the water", None), ("und the et", None)]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    model = language_id.learn(df)
    assert model.languages == ["de", "en", "fr"]
    for r in language_id.identify(df, model).collect():
        lang, share = plain_mixture(model, texts[r["doc_id"]][0])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(share.max(), abs=1e-3), texts[r["doc_id"]]


def test_one_pass_operators_on_odd_tables(spark):
    """Empty tables, repeated rows, columns with the operators' own names, texts of a million characters."""
    long = " ".join(f"w{i % 5000}" for i in range(160_000))
    texts = [(1, "the house"), (1, "the house"), (1, "der hund"), (None, "x"), (2, None), (3, long)]
    names = "doc_id long, text string, lang string, held_out int, score string, n_tokens string, ids_sha256 int, lang_pred int, predicted string, proportions int, n_bytes string"
    df = spark.createDataFrame([(i, t, "en", 1, "s", "n", 2, 3, "p", 4, "b") for i, t in texts], names).repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(df, labels)
    calls = {
        "counts": lambda d: token_counts.token_counts(d), "bpe": lambda d: word_bpe.encode_decode(d),
        "quality": lambda d: quality.score(d, model), "language": lambda d: language_id.identify(d, language_id.learn(d)),
    }
    for name, call in calls.items():
        rows = call(df).collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in texts), key=str), name
        assert call(df.limit(0)).count() == 0, name
    twice = [r for r in word_bpe.encode_decode(df).collect() if r["doc_id"] == 1]
    assert sorted(r["ids_sha256"] for r in twice).count(max(r["ids_sha256"] for r in twice)) in (1, 2) and len({r["ids_sha256"] for r in twice}) == 2
    assert {r["n_bytes"] for r in token_counts.token_counts(df).collect()} == {9, 8, 1, 0, len(long)}
    assert quality.score(df, quality.learn(df.limit(0), labels)).count() == len(texts) and quality.learn(df.limit(0), labels.limit(0)).fitted is False
    near = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert near == {(1, 1), (2, 2), (3, 3), (None, None)}
    hit = decontaminate.decontaminate(df, spark.createDataFrame([(1, " ".join(long.split()[100:130]))], "item_id long, text string")).where("n_hit > 0").collect()
    assert [(r["doc_id"], r["n_words"], r["contaminated"]) for r in hit] == [(3, 160_000, False)] and hit[0]["n_hit"] == 30 * 32
    assert hit[0]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
