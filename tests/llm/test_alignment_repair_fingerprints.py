"""Fingerprints, alignment and conversation repair against brute force, and on odd tables."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm import alignment, conversation_repair, fingerprints
from strandlake.llm.conversation_repair import Repair, Steps


# fingerprints


def likeness(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_samples_agree_as_often_as_bags_are_alike(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        other = own[: len(own) // 2] + [rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(own), " ".join(other)))
    both = spark.createDataFrame(rows, "id long, a string, b string")
    got = fingerprints.signatures(fingerprints.word_bags(both, ["id"], ["a", "b"]), ["id"], ["a", "b"], seeds=64)
    near = {r[0]: r[1] for r in got.select("id", fingerprints.likeness(F.col("a"), F.col("b"))).collect()}
    errors = [near[i] - likeness(a, b) for i, a, b in rows]
    # 256 samples a row: a standard error of 0.03 at most
    assert max(map(abs, errors)) < 0.13 and abs(sum(errors) / len(errors)) < 0.02


def test_weights_of_any_size_and_absent_terms(spark):
    rows = [(1, 10, 0.25, 0.25), (1, 11, 3.5, 3.5), (2, 10, 1.0, 0.0), (2, 11, None, 2.0), (3, 10, -1.0, None)]
    terms = spark.createDataFrame(rows, "k long, term long, a double, b double")
    got = {r.k: r for r in fingerprints.signatures(terms, ["k"], ["a", "b"]).collect()}
    assert got[1].a == got[1].b and len(got[1].a) == fingerprints.SEEDS * fingerprints.PER_ROW
    assert got[2].a and got[2].b and not set(got[2].a) & set(got[2].b)
    assert got[3].a is None and got[3].b is None


def test_a_larger_weight_never_raises_a_rank(spark):
    # consistency: a bag whose weights all grew keeps a sample, or takes one of a grown term
    terms = spark.range(300).selectExpr("id div 10 as k", "id as term", "1.0D + id % 3 as a", "if(id % 10 = 4, 50.0D, 1.0D + id % 3) as b")
    changed = kept = 0
    for r in fingerprints.signatures(terms, ["k"], ["a", "b"]).collect():
        kept += sum(x == y for x, y in zip(r.a, r.b))
        changed += sum(x != y for x, y in zip(r.a, r.b))
    assert changed > 2 * kept > 0


def test_edited_likeness_on_odd_rows(spark):
    rows = [(5, "a b c d"), (None, "first of all"), (2, None), (2, ""), (7, "é ü \U0001f389 " * 20), (5, "a b c d"), (9, " \t\n"), (8, "long " * 30_000), (5, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as h", "1 as key", "2 as copies")
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    distinct = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    by = defaultdict(set)
    for r in got:
        by[r.doc_id, r.n_chars].add(r.edited_sha256)
    assert all(len(v) == 1 for v in by.values())
    ids = [d for d, _ in distinct]
    for i, (d, t) in enumerate(distinct):
        if ids.count(d) == 1 and ids.count(ids[(i + 1) % len(ids)]) == 1:
            half = len(t) // 2
            edited = t[: len(t) - half] + distinct[(i + 1) % len(ids)][1][:half]
            assert by[d, len(t)] == {hashlib.sha256(edited.encode()).hexdigest()}, d
    empty = [r for r in got if r.doc_id in (2, 9)]
    assert {r.fingerprint for r in empty} == {""} and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 2
    assert fingerprints.edited_likeness(docs.limit(0)).count() == 0
    alone = fingerprints.edited_likeness(docs.where("doc_id = 7")).first()
    assert alone.near_next == 1.0


def test_fingerprints_don_t_depend_on_partitions(spark):
    docs = spark.range(80).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 5 + cast(id % 40 as int)), i -> concat('w', (i * id) % 13))) as text")
    one = {tuple(r) for r in fingerprints.edited_likeness(docs.coalesce(1)).collect()}
    assert one == {tuple(r) for r in fingerprints.edited_likeness(docs.repartition(7)).collect()} and len(one) == 80
    same = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert same == {r[0]: r[3] for r in one}


# alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelt(a, b):
    """Functions from ids to bytes; the byte-level alphabet by its rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {c: c for c in printable} | {256 + i: c for i, c in enumerate(c for c in range(256) if c not in printable)}
    own = {i: bytes(letters[ord(c)] for c in t) for t, i in a.get_vocab().items() if all(ord(c) in letters for c in t)}
    return own.__getitem__, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def aligned(texts, libraries):
    a, b = libraries
    bytes_a, bytes_b = spelt(a, b)
    out, counts = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, ids_a)) != raw or b"".join(map(bytes_b, ids_b)) != raw:
            out.append(None)
            continue
        end_a, end_b = (list(itertools.accumulate(len(f(i)) for i in x)) for f, x in ((bytes_a, ids_a), (bytes_b, ids_b)))
        links = [(x, y) for x, p, q in zip(ids_a, [0, *end_a], end_a) for y, r, s in zip(ids_b, [0, *end_b], end_b) if p < s and r < q]
        cuts = [0, *sorted(set(end_a) & set(end_b))]
        groups = ["|".join(",".join(str(x) for x, e in zip(ids, ends) if lo < e <= hi) for ids, ends in ((ids_a, end_a), (ids_b, end_b))) for lo, hi in zip(cuts, cuts[1:])]
        counts.update(links)
        out.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if o is None else (*o[:3], len(o[3]), sum(counts[x] == best[x[1]] for x in o[3]), sum(counts[x] for x in o[3]), o[4]) for o in out]


ODD = ["a▁b", None, "", " ", "  two  spaces ", "<|endoftext|> <s> x\n\n  y  ", "tab\tx  y z   ﬁ é \U0001f389", "the the the", "the the the", "naïve façade coöperate", "x" * 300, "un mot, l'été; d'où?"]


@pytest.mark.parametrize("small", [True, False])
def test_alignment_against_brute_force(spark, libraries, small):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["the", "étreier", "Ungheiten", "nd", "thnt", "1234", "(x)", "\n", "…"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    texts.append(" ".join(f"word{i % 17}" for i in range(3000)))
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as task", "'b' as b", "3 as row").repartition(3, "text")
    kind = dict(part_chars=40, slice_chars=500, held=300, held_sums=50, share=200, often=30) if small else {}
    got = alignment.align(docs, **kind).collect()
    want = [(d, *w) for (d, _), w in zip(rows, aligned(texts, libraries))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(docs).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_parts_begin_after_single_cuts():
    for text in ("a b  c d", "  a", "abc", "a ", "a▁ b c", "x  y  z "):
        for size in (1, 2, 3):
            got = list(alignment.parts(text, size))
            assert " ".join(got) == text
            assert all(p and not p[-1].isspace() and p[-1] != "▁" for p in got[:-1]) and (got[-1] or not text)


def test_groups_are_spans_of_the_text():
    s = alignment.sides()
    text = "Das Ungeheuer naïve \U0001f389 x"
    raw = (" " + text).encode()
    got = list(alignment.Aligned([text], s).groups())
    assert got[0][1] == 0 and got[-1][2] == len(raw) and all(x[2] == y[1] for x, y in zip(got, got[1:]))
    for _, lo, hi, _, ids_b in got:
        assert b"".join(s.bytes_b[i] for i in ids_b) == raw[lo:hi]


# conversation repair


def cheapest(turns):
    """(cost, list, repaired turns) by best-first search over edit lists; turns are (role, text, must go, truncated)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, last, made = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, edits, made
        if (i, last) in seen:
            continue
        seen.add((i, last))
        for x in follow[last]:
            if x != "s":
                heapq.heappush(heap, (cost + 2, edits + "I", i, x, (*made, full[x] + ":")))
        if i < len(turns):
            role, text, must_go, cut = turns[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, last, made))
            if not must_go:
                if role[:1] and role[:1] in follow[last]:
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                for x in follow[last]:
                    if x != "s":
                        heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, x, (*made, f"{full[x]}:{text}")))
    raise AssertionError


def judged(rows):
    """Faults of rows (turn, role, text) in order, as (role, text, must go, truncated)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault in (1, 2), fault == 3))
    return out


def test_programme_against_best_first_search():
    rng, steps = random.Random(11), Steps()
    for n in range(3000):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "uncle"]), f"t{i}", go := rng.random() < 0.2, not go and rng.random() < 0.3) for i in range(rng.randint(1, 9))]
        if n % 3 == 0:
            turns = [("assistant", t, g, c) for _, t, g, c in turns]
        own = Repair(steps)
        for t in turns:
            own.add(*t)
        cost, edits, made = cheapest(turns)
        assert own.close() == (cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest()), turns
    assert len(steps.all) < 5000


def test_long_conversations_take_a_byte_a_turn():
    own, steps = None, Steps()
    # many kinds of turn first, so that codes outgrow a byte
    rng = random.Random(2)
    own = Repair(steps)
    turns = [(rng.choice(["system", "user", "assistant", "tool"]), "x", go := rng.random() < 0.3, not go and rng.random() < 0.5) for _ in range(20_000)]
    for t in turns:
        own.add(*t)
    assert len(own.trail) <= 2 * len(turns)
    cost, edits, digest = own.close()
    assert (cost, edits, hashlib.sha256("\n".join(cheapest(turns)[2]).encode()).hexdigest()) == (*cheapest(turns)[:2], digest)


def test_repair_of_damaged_tables(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", None]), rng.choice(["Hi.", "Why?", "cut", "", None, " \v", "a.\n\n", "long " * 2000 + "!"])))
    rows += [(900, 0, "user", "once.")] * 3
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'f' as fault", "1 as way", "2 as copy")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_damaged(table).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else "".join(x for x in text if x not in ".!?") if way == 2 else text
        role = "user" if way == 4 else role
        by[c] += [] if way == 0 else [(t, role, text)] * (1 + (way == 3))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = judged(own)
        kinds = Counter()
        for role, text, go, cut in turns:
            blank = not text.strip(" \t\n\v\f\r")
            kinds.update(blank=blank, duplicate=go and not blank, truncated=cut)
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        cost, edits, made = cheapest(turns)
        assert got[c] == (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest()), c
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.repair_damaged(table.limit(0)).count() == 0
