"""Top-k, WARC, chat and the registry's SQL on small inputs."""

import hashlib
import io
import math

import numpy as np
import pytest

from strandlake.llm import chat, topk, warc


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vec = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vec += [(300 + i, vec[7][1]) for i in range(40)] + [(1000, None), (1050, [None] * 6), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vec], "vec_id long, embedding array<float>, rank int").repartition(3)
    x = {i: np.floor(256 * np.float32(v).astype(float)) for i, v in vec if v and all(a is not None and np.isfinite(a) for a in v)}
    want = set()
    for q in x:
        if q % 50 == 0:
            best = sorted((-int(x[q] @ x[j]), j) for j in x if j != q)[:5]
            want |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    for rows in (10_000, 60):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, shard_rows=rows, block_rows=2).collect()}
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 3)")).count() == 1
    twice = df.unionByName(df.where("vec_id % 3 = 0")).unionByName(df.where("vec_id in (0, 50)"))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(twice, shard_rows=100, block_rows=1).collect()}
    assert got == want


def test_top_k_of_large_components(spark):
    """Scores beyond a double's whole numbers, beyond a long, and beyond a double, against whole numbers in Python."""
    rng = np.random.default_rng(8)
    vec = [[1e9, 2.0], [1.0, 1.0], [1e9 + 1, -3.0], [-1e9, 5.0], [3e9, 1e9]] + [[float(a), float(b)] for a, b in rng.normal(0, 3e6, (60, 2))]
    vec += [[float(a), float(b)] for a, b in 1e8 + rng.integers(0, 3, (30, 2))] + [[1e300, -1e300], [1e300, 1e-300], [-1e299, 0.0], [1e308, 0.0], [0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vec)], "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in enumerate(vec) if all(math.isfinite(256 * x) for x in v)}
    assert len(whole) == len(vec) - 1
    want = set()
    for q in whole:
        if q % 5 == 0:
            score = {j: min(max(sum(a * b for a, b in zip(whole[q], whole[j])), -(2**63)), 2**63 - 1) for j in whole if j != q}
            want |= {(q, r + 1, j, score[j]) for r, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:5])}
    for rows in (1_000, 20):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, every=5, shard_rows=rows, block_rows=4).collect()}
        assert got == want


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(9)
    x = np.floor(256 * np.concatenate([c + 0.02 * rng.normal(size=(60, 8)) for c in rng.normal(size=(40, 8))]))
    seen, inner = [], []

    def walk(node):
        rows = node.rows if node.children is None else np.concatenate([walk(c) for c in node.children])
        assert np.sqrt(((x[rows] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-6
        if node.children is None:
            seen.extend(rows.tolist())
        else:
            inner.append(node)
            c = np.array([k.center for k in node.children])
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + 1e9 * np.eye(len(c))
            assert max(k.radius for k in node.children) <= apart.min() + 1e-3
            assert len(node.children) == topk.FANOUT or all(k.radius <= node.radius / 2 + 1e-3 for k in node.children) and apart.min() > node.radius / 2 - 1e-3
            assert (node.children[0].center == node.center).all()
        return rows

    walk(topk.cover_tree(x, leaf=16))
    assert sorted(seen) == list(range(len(x))) and len(inner) > 1


def leaves(node):
    return [len(node.rows)] if node.children is None else [n for c in node.children for n in leaves(c)]


def test_cover_tree_divides_vectors_without_clusters():
    x = np.random.default_rng(1).normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    sizes = leaves(topk.cover_tree(x))
    assert sum(sizes) == 2000 and max(sizes) <= topk.LEAF and len(sizes) > 2000 / topk.LEAF
    # equal points don't divide, and steep scales don't recurse
    assert leaves(topk.cover_tree(np.ones((500, 3)))) == [500]
    assert sum(leaves(topk.cover_tree(np.floor(1.05 ** np.arange(600))[:, None], leaf=1))) == 600


def test_walk_visits_pairs_of_nodes_and_prunes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(v) for v in centres[i % 20] + 0.01 * rng.normal(size=16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.walked(df, shard_rows=5000).groupBy().sum().first()
    assert got["sum(queries)"] == 40 and got["sum(visited)"] > 20 and got["sum(pruned)"] > 0 and got["sum(scores)"] < 40 * 2000
    assert topk.walked(df.limit(0)).count() == 0


def test_walk_without_clusters_stays_above_the_leaves():
    """Bounds prune nothing here: pairs of leaves were 10,769 visits for 300 x 5,000 scores."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5300, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    counts = {}
    got = topk.dual_tree_top_k(x[:300], x[300:], 6, counts=counts)
    score = x[:300] @ x[300:].T
    assert got == [[(float(row[j]), int(j)) for j in np.lexsort((np.arange(5000), -row))[:6]] for row in score]
    assert counts["visited"] < 1000 and counts["scores"] <= 300 * 5000


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    rows = [(1, "u1", "<p>a</p>"), (2, "u2\r\nX: y", "<p>a</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 200_000), (5, "u5", "other"), (6, "u6", "<p>a</p>")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record_type string")
    path = "file://" + str(tmp_path / "w")
    warc.write_pages(df, path)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, path).collect())
    assert [g[:3] for g in got] == [(1, 8, "revisit"), (2, 8, "revisit"), (3, 0, "revisit"), (4, 0, "response"), (5, 5, "response"), (5, 400_000, "response"), (6, 8, "response")]
    assert [g[3] for g in got] == [6, 6, 4, None, None, None, None]
    some = spark.read.format("warc").load(path).where("record_type = 'response' and target_uri like 'u5%'")
    assert some.count() == 2 and "record_type" in some._jdf.queryExecution().toString()
    warc.write_pages(df.limit(0), "file://" + str(tmp_path / "e"))
    assert warc.read_pages(spark, "file://" + str(tmp_path / "e")).count() == 0
    raw = spark.read.format("warc").load(path).where("record_type = 'response'").select("content_length", "payload", "headers").collect()
    assert all(r["content_length"] == len(warc.http_head(len(r["payload"]))) + len(r["payload"]) and r["headers"]["content-type"].startswith("application/http") for r in raw)


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = "file://" + str(tmp_path / "a")
    page = lambda *ids: spark.createDataFrame([(i, "u", f"p{i}") for i in ids], "page_id long, url string, html string")
    seen = lambda: sorted(r["page_id"] for r in warc.read_pages(spark, path).collect())
    warc.write_pages(page(1), path)
    warc.write_pages(page(2, 3), path)
    assert seen() == [1, 2, 3]
    (tmp_path / "a" / "lost-00000.warc.gz").write_bytes(b"what a lost attempt wrote")
    warc.write_pages(page(4), path, mode="overwrite")
    assert seen() == [4]
    warc.write_pages(page(5), path)
    warc.write_pages(page(5).limit(0), path)
    assert seen() == [4, 5]
    reader = warc.WarcReader({"path": path, "parallelism": "8"})
    assert len(reader.partitions()) == 1  # both are far below the least size of a partition


def test_warc_reader_skips_payloads():
    recs = [warc.record_bytes([("WARC-Type", t), ("WARC-Record-ID", str(i))], b"x" * 70_000 * (i + 1)) for i, t in enumerate(["response", "revisit", "response"])]
    import gzip

    for raw, gz in ((b"".join(map(warc.gzip_member, recs)), True), (b"".join(map(gzip.compress, recs)), True), (b"".join(recs), False)):
        a, seen = warc.Archive(io.BytesIO(raw), len(raw), gz), []
        while (h := a.headers()) is not None:
            seen.append((h["warc-type"], len(a.payload()) if h["warc-record-id"] == "2" else a.skip()))
        assert seen == [("response", None), ("revisit", None), ("response", 210_000)] and a.stats == {"records": 3, "payloads": 1}
    with pytest.raises(ValueError):
        warc.parse_headers(b"HTTP/1.1 200")


def test_chat(spark):
    said = "</s>[INST] ok [/INST] \\l \\ <"
    assert chat.parse(chat.inst_template([("user", said), ("", "")])) == [("user", said), ("", "")]
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (2, 0, "assistant", "é🙂"), (2, 0, "assistant", "a")] + [(3, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(100)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(3)
    got = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, 3):
        own = sorted(((t, r, x or "") for i, t, r, x in rows if i == c))
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), sha(learned))
        assert got[c]["formatted_chars"] == len(chat.inst_template([(r, x) for _, r, x in own]))
    spans = chat.turn_spans(df).where("conv_id = 3").orderBy("pos").collect()
    assert "".join(s["span"] for s in spans) == chat.inst_template([(r, x) for i, _, r, x in rows if i == 3])
    assert chat.format_digests(df.limit(0)).count() == 0


def test_templates_that_rewrite_history():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    strip = lambda t: "".join(f"<{r}>{x if i >= len(t) - 2 else ''}" for i, (r, x) in enumerate(t))
    tailed = lambda t: "".join(f"<{r}>{x}" for r, x in t) + "<end>"
    assert chat.rewrites_history(strip, turns) == 2 and chat.rewrites_history(tailed, turns) is None and chat.rewrites_history(chat.inst_template, turns * 50) is None
    numbered = lambda t: "".join(f"{i}{x}" for i, (_, x) in enumerate(t))
    # spans that depend on the number of turns: every prefix is rendered whole then
    assert chat.rewrites_history(numbered, turns * 10, full=8) is None and chat.rewrites_history(numbered, turns * 50) is None
    # a template that changes its first turn late is found out when the turns have doubled, or at the end
    late = lambda t: "".join(f"<{r}>{x}" if i or len(t) < 90 else "new" for i, (r, x) in enumerate(t))
    assert chat.rewrites_history(late, turns * 24) == 95 and chat.rewrites_history(late, turns * 50) == 127 and chat.rewrites_history(late, turns * 50, full=None) == 89


def test_all_templates_are_rendered_alike():
    """Prefixes grow to FULL turns whatever the template, and whole conversations are rendered again beyond."""
    for template in (chat.inst_template, lambda t: chat.inst_template(t)):
        sizes = []
        inc = chat.Incremental(lambda t: sizes.append(len(t)) or template(t))
        for i in range(300):
            inc.add("user", f"t{i}")
        inc.check()
        assert sizes[: chat.FULL + 1] == list(range(chat.FULL + 1)) and {128, 256, 300} <= set(sizes)
        assert [n for n in sizes if n > chat.FULL] == [128, 256, 300]


def test_very_long_conversations(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "<x>" * (5 if i else 20_000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.format_digests(df).first()
    whole = chat.inst_template([r[2:] for r in rows])
    learned = "".join(r[3] for r in rows if r[2] == "assistant")
    assert (got["n_turns"], got["formatted_chars"], got["loss_chars"]) == (2000, len(whole), len(learned))
    assert got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_whole_prefixes_are_rendered(spark):
    turns = [("user", f"t{i}") for i in range(60)]
    last = lambda t: "".join(f"<{r}>{x}" for r, x in t[-40:])
    numbered = lambda t: "".join(f"<s>[INST]{r}[/INST]{i}{x}</s>" for i, (r, x) in enumerate(t))
    assert chat.rewrites_history(last, turns) == 40 and chat.rewrites_history(numbered, turns) is None
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    spans = chat.turn_spans(df, lambda t: "".join(f"<s>[INST]{r}[/INST]{i}{x}</s>" for i, (r, x) in enumerate(t))).orderBy("pos").collect()
    assert "".join(r["span"] for r in spans) == numbered(turns)


def test_learned_texts_of_any_template(spark):
    """The text's place is found without knowing control strings; templates that hide it or wrap it by its content."""
    marked = lambda t: "".join(f"<|{r}|>{x}<|end|>" for r, x in t)
    counted = lambda t: "".join(f"{i}:{r}={x.strip()};\n" for i, (r, x) in enumerate(t)) + "done"
    rows = [(1, 0, "user", "a|b"), (1, 1, "assistant", "<|end|>x"), (1, 2, "assistant", ""), (None, 0, "assistant", "ab"), (None, 1, "user", None), (2, 0, "assistant", "ba")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (marked, counted, chat.inst_template):
        got = {(r["conv_id"], r["pos"]): r for r in chat.turn_spans(df, template).collect()}
        for c, t, role, text in rows:
            r = got[c, t]
            shown = None if r["loss_start"] is None else r["span"][r["loss_start"] : r["loss_end"]]
            assert shown == (None if role == "user" else chat.escape(text) if template is chat.inst_template else text)
    inc = chat.Incremental(lambda t: "".join(f"[{len(x)}]{x}" for _, x in t))
    inc.add("assistant", "four")
    with pytest.raises(ValueError):
        inc.place_of_text()
    twice = chat.Incremental(lambda t: "".join(f"{x}#{x}" for _, x in t))
    twice.add("assistant", "hello")
    with pytest.raises(ValueError):
        twice.place_of_text()
    hidden = chat.Incremental(lambda t: "-" * len(t))
    hidden.add("assistant", "four")
    assert hidden.place_of_text() is None
    got = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 2 and got[1]["loss_chars"] == 8
    other = chat.format_digests(df.where("conv_id = 2"), marked, read=lambda s: [tuple(s[2:-7].split("|>", 1))], plain=str).first()
    assert (other["n_turns"], other["loss_chars"], other["formatted_chars"]) == (1, 2, len("<|assistant|>ba<|end|>"))
