"""The operators for training corpora against brute force, SQL and round trips, with awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, spark_rows
from veilworks.llm import chat, components, decontamination, fingerprints, learning, mixing, neardup, quality, sharding, substrings, textbytes, tokens, toxicity
from veilworks.llm.engine import prefix_sums, table
from veilworks.llm.entry import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
AWKWARD = [None, "", "  \n\t", "one", "Zwei  drei\nvier", "x" * 300_000, "same words here again and again " * 40, "same words here again and again " * 40, "été ÉTÉ \x0b\x0c ünï ☃ " * 30, "<|im_start|>\\|<\\|"]


def frame(spark, texts, ids=None):
    """Rows with more columns than needed, two of which clash with names that operators use."""
    rows = [(i, t, "en", f"s{n % 3}" if n % 4 else None, len(t or ""), 1, "c") for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, size string")


def nothing(spark):
    return frame(spark, []).limit(0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck(SQL[name], SMALL)


def test_word_spans_and_hashes():
    texts = [t or "" for t in AWKWARD]
    data, offsets = textbytes.flat(pa.array(texts))
    starts, ends, at = textbytes.spans(data, offsets)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    assert words == [w.encode() for t in texts for w in WORD.findall(t)]
    h = textbytes.span_hashes(data, starts, ends)
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    for k in (1, 2, 3, 7, 25, 50):
        r = textbytes.rolling(h, k)
        groups = {}
        assert all(groups.setdefault(tuple(h[i : i + k].tolist()), x) == x for i, x in enumerate(r.tolist()))
        assert len(set(groups.values())) == len(groups)


def brute_removed(rows, w):
    first, words = {}, {}
    for i, t in rows:
        ws = words.setdefault(i, []) + []
        words[i] = ws = WORD.findall(t or "")
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, ws in words.items():
        gone = {j for s in range(len(ws) - w + 1) if first[tuple(ws[s : s + w])] < i for j in range(s, s + w)}
        out[i] = (len(ws), len(gone), " ".join(x for j, x in enumerate(ws) if j not in gone))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 50])
def test_substrings(spark, window):
    rng = np.random.default_rng(window)
    shared = [f"s{i}" for i in range(200)]
    texts = list(AWKWARD)
    for _ in range(40):
        a, b = sorted(rng.integers(0, 200, 2))
        texts.append(" ".join([f"r{x}" for x in rng.integers(0, 30 if window < 50 else 10**6, 20)] + shared[a:b] + ["tail"] * int(rng.integers(0, 60))))
    got = substrings.remove_repeats(frame(spark, texts), window, chunk_bytes=100_000, bucket_bytes=50_000)
    truth = brute_removed(list(enumerate(texts)), window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == truth
    assert all(sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] for r in got.collect())


def test_substrings_come_from_anchors_alone():
    """One chunk with a repeat: without hits nothing goes, with its hits the maximal repeat does, whole."""
    shared = [f"s{i}" for i in range(70)]
    texts = [" ".join(["a"] * 7 + shared), " ".join(["b"] * 11 + shared + ["c"] * 5)]
    t = pa.table({"doc_id": [1, 2], "text": texts, "chunk": [0, 0]})
    cells = substrings.anchors_of(50, 25, 0)(t)
    hits = substrings.match_anchors(cells)
    none = pa.table({"chunk": pa.array([], pa.int32()), "k1": pa.array([], pa.binary()), "k2": pa.array([], pa.binary())})
    digests = substrings.match_windows(substrings.windows_of(50, 25, 0)(t, hits)) if hits.num_rows else none
    marks = pa.concat_tables([hits, digests], promote_options="default")
    assert substrings.finish(50, 25, 0)(t, marks.slice(0, 0)).column("n_removed").to_pylist() == [0, 0]
    assert substrings.windows_of(50, 25, 0)(t, hits.slice(0, 0)).num_rows == 0
    got = substrings.finish(50, 25, 0)(t, marks).to_pylist()
    assert [(r["n_removed"], r["removed"]) for r in got] == [(0, []), (70, [{"start": 11, "end": 81}])]


def test_substrings_empty_null_ids_and_repeats(spark):
    assert substrings.remove_repeats(nothing(spark)).count() == 0
    text = " ".join(map(str, range(60)))
    got = substrings.remove_repeats(frame(spark, [text, text, text], [3, 3, None]))
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got.collect()) == [(3, 0), (3, 0), (99, 60)]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("small", [8, 256])
def test_near_duplicates(spark, small):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = list(AWKWARD)
    for _ in range(60):  # one group of near copies, edited to all degrees
        w = list(base)
        for j in rng.integers(0, 60, int(rng.integers(0, 5))):
            w[j] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += [" ".join(f"u{rng.integers(10**6)}" for _ in range(30)) for _ in range(30)]
    got = neardup.near_duplicates(frame(spark, texts), 4, 80, small=small)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(list(enumerate(texts)), 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_of_unlike_signatures(spark):
    """Pairs at similarity 0.8 whose signatures agree in 37 or 38 of 64 positions only."""
    numbers = [23515, 29248, 29386]
    texts = [" ".join([f"c{n}x{i}" for i in range(80)] + [f"{side}{n}x{i}" for i in range(10)]) for n in numbers for side in "ab"]
    sig = neardup.signatures(neardup.shingle_sets(*textbytes.flat(pa.array(texts)), 1))
    assert (sig[0::2] == sig[1::2]).sum(1).tolist() == [37, 38, 37]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts), 1, 80).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_near_duplicates_empty_and_null_ids(spark):
    assert neardup.near_duplicates(nothing(spark)).count() == 0
    got = neardup.near_duplicates(frame(spark, ["a b c", "a b c", "a b c"], [1, 5, None])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (5, 1, False)]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are documents of their own: none hides another's link."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    texts = [" ".join(t) for t in (a, b, b[:-1] + ["z"], a[:-1] + ["z"], c, c)]
    got = neardup.near_duplicates(frame(spark, texts, [1, 1, 2, 3, 7, 7]), 4, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (7, 7), (7, 7)]
    assert sum(r["kept"] for r in got) == 3 and sum(r["kept"] for r in got if r["doc_id"] == 7) == 1


def test_trees_branch_until_nodes_are_small(spark):
    """Unlike documents that share one frequent passage: no leaf stays large, and pairs among them are found."""
    rng = np.random.default_rng(13)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join([*common, *(f"u{x}" for x in rng.integers(0, 10**9, 60))]) for _ in range(600)]
    for i in range(0, 600, 60):
        texts.append(texts[i][:-3] + "end")
    docs = frame(spark, texts)
    known = neardup.describe(docs, 4, 0.8, 10)
    reps = known.select(F.col("doc_id").alias("rep"), "sig", "roots")
    leaves = neardup.grow_trees(reps, neardup.root_branches(10, 0.8), 32, 0.55)
    assert leaves.groupBy("node").count().agg(F.max("count")).first()[0] <= 32 and leaves.count() < 20 * len(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4, 80, small=32).collect()}
    assert got == {i: (i - 600) * 60 if i >= 600 else i for i in range(610)}


def test_a_stray_meets_all_members(spark):
    """A document linked with one member of a group alone, of which other members are near the threshold."""
    rng = np.random.default_rng(19)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for _ in range(40):  # near copies of each other
        w = list(base)
        for j in rng.choice(100, 4, replace=False):
            w[j] = f"e{rng.integers(10**9)}"
        rows.append(w)
    stray = list(rows[23])
    own = [j for j in range(100) if rows[23][j] == base[j]]
    for j in own[:10]:
        stray[j] = f"s{j}"
    rows.append(stray)
    texts = [" ".join(w) for w in rows]
    truth = brute_components(list(enumerate(texts)), 1, 80)
    assert truth[40][1] == 0
    for small in (8, 1024):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts), 1, 80, small=small).collect()}
        assert got == {i: c for i, (_, c) in truth.items()}


def test_join_parts():
    rng = np.random.default_rng(14)
    for n in (1, 5, 60):
        linked = np.triu(rng.random((n, n)) < 1.5 / n)
        part = np.arange(n)
        out = neardup.join_parts(part, linked.copy())
        label = list(range(n))
        for i, j in np.argwhere(linked):
            label = [label[i] if x == label[j] else x for x in label]
        assert len(out) == n - len(set(label)) == n - len(set(part.tolist()))
        assert all((label[i] == label[j]) == (part[i] == part[j]) for i in range(n) for j in range(n)) and all(linked[i, j] for i, j in out)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums_and_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(1, 1000, 500))]
    got = prefix_sums(spark.createDataFrame(rows, "k long, v long").repartition(7), ["k"], {"before": F.col("v")}, 500, rows_per_part=60)
    total, want = 0, {}
    for k, v in rows:
        want[k], total = total, total + v
    assert {r["k"]: r["before"] for r in got.collect()} == want
    texts = AWKWARD * 20
    shards = sharding.shard_by_bytes(frame(spark, texts, [i // 2 for i in range(len(texts))]), 4).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in shards) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    sizes = [sum(r["size"] for r in shards if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in shards) and max(r["size"] for r in shards) == 300_001
    for s in range(4):
        assert sorted(r["slot"] for r in shards if r["shard"] == s) == list(range(sum(r["shard"] == s for r in shards)))
    ordered = sorted(shards, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in ordered] == sorted(r["doc_id"] for r in ordered)
    assert sharding.shard_by_bytes(nothing(spark)).count() == 0


def test_targets():
    for sizes in ([("a", 100), ("b", 100), ("c", 100)], [("a", 1), ("b", 1000), (None, 500)], [("x", 0), ("y", 10)]):
        got = mixing.fill_targets(sizes)
        assert abs(sum(t for *_, t in got) - sum(n for _, n in sizes)) < 1e-6 and all(t <= 3 * n + 1e-9 for _, n, t in got)
    assert [t for *_, t in mixing.fill_targets([("a", 100), ("b", 1000), ("c", 100)])] == [300.0, 600.0, 300.0]


def test_mix(spark):
    texts = ["w " * int(n) for n in np.random.default_rng(1).integers(0, 60, 300)] + [None, ""]
    docs = frame(spark, texts)
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs).collect()))
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] for r in mine) - mine[0]["target"]) <= 60
    times = {}
    for r in got:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    assert mixing.mix_sources(nothing(spark)).count() == 0
    q = mixing.op9_mixing(spark, SMALL).collect()
    assert len(q) == table(spark, SMALL, "documents").count() and all(r["taken"] <= 3 * r["size"] for r in q)
    twice = mixing.taken_words(frame(spark, [None, None, "a b", "a b", "c"], [1, 1, 2, 2, 3])).collect()
    assert sorted(r["doc_id"] for r in twice) == [1, 1, 2, 2, 3] and mixing.taken_words(nothing(spark)).count() == 0


def test_mix_leaves_no_source_out(spark):
    """Sources far smaller than 1 / n_slots of all words."""
    rows = [(i, "w " * 100_000, "large") for i in range(10)] + [(100 + i, "a b c", f"tiny{i}") for i in range(10)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("size").alias("n"), F.max("target").alias("target")).collect()
    assert {r["source"]: r["n"] for r in got if r["source"] != "large"} == {f"tiny{i}": 9 for i in range(10)}
    assert all(abs(r["n"] - r["target"]) <= 100_000 for r in got)


def test_mix_stage_repeated_ids(spark):
    import corpus_pipeline

    docs = frame(spark, ["a b c", "a b c", "d e f g", None], [1, 1, 2, 3])
    rows = corpus_pipeline.mix(spark, docs, SMALL).collect()
    assert rows and max(sum(r["doc_id"] == i for r in rows) for i in (2, 3)) <= 3 and sum(r["doc_id"] == 1 for r in rows) <= 6


def test_stages_decide_by_row(spark):
    """Rows with null and repeated ids through the pipeline's stages."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good, bad = (next(texts[i] for i in sorted(scores) if scores[i] == p and len(WORD.findall(texts[i] or "")) > 30) for p in (1, 0))
    odd = [(None, good), (900_001, good), (900_001, bad), (900_002, good), (900_002, good), (None, bad)]
    more = spark.createDataFrame([(i, t, "en", "odd", 1) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars int").select([F.col(f.name).cast(f.dataType) for f in docs.select(corpus_pipeline.COLUMNS).schema])
    got = corpus_pipeline.quality(spark, docs.select(corpus_pipeline.COLUMNS).unionByName(more), sf).filter("source = 'odd'").collect()
    assert sorted((r["doc_id"] or 0, r["text"] == good) for r in got) == [(0, True), (900_001, True), (900_002, True), (900_002, True)]

    words = [" ".join(f"{c}{n}" for n in range(40)) for c in "abcd"]
    rows = frame(spark, [words[0], words[0], words[0], words[1], words[2], words[2], words[3]], [5, 5, None, None, 7, 9, 7])
    left = corpus_pipeline.dedup(spark, rows, SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in left) == [(0, "b"), (5, "a"), (7, "c"), (7, "d")]

    item = next(r["text"] for r in table(spark, SMALL, "benchmark").collect() if len(WORD.findall(r["text"] or "")) > 20)
    rows = frame(spark, [item, words[0], item, words[1]], [None, None, 3, 3])
    left = corpus_pipeline.benchmark(spark, rows, SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in left) == [(0, "a"), (3, "b")]

    rows = frame(spark, words, [None, None, 1, 1])
    assert {(r["doc_id"], r["text"][0]) for r in corpus_pipeline.mix(spark, rows, SMALL).collect()} >= {(r["doc_id"], r["text"][0]) for r in rows.collect() if r["source"] is None}
    assert None in {r["doc_id"] for r in corpus_pipeline.mix(spark, rows, SMALL).collect()}


def brute_pieces(pieces, word, longest=200):
    n = at = 0
    while at < len(word):
        at += next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 1)
        n += 1
    return n


def test_longest_match():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pieces = {bytes(rng.choice([97, 98, 99], int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 12)))}
        machine = tokens.LongestMatch(sorted(pieces))
        for _ in range(20):
            word = bytes(rng.choice([97, 98, 99, 100], int(rng.integers(0, 15))))
            assert machine.count(word) == brute_pieces(pieces, word)


def test_token_counts(spark):
    content = tokens.read_vocabulary(spark, tokens.VOCABULARY)
    pieces = set(tokens.parse_ranks(content))
    longest = max(map(len, pieces))
    texts = AWKWARD
    got = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, texts), content, memo=3).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert got[i]["n_words"] == len(words) and got[i]["n_tokens"] == sum(brute_pieces(pieces, b" " + w.encode(), longest) for w in words)
    assert tokens.count_tokens(nothing(spark), content).count() == 0


def test_chunks_do_not_depend_on_neighbours():
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, int(n)))) for n in (0, 5, 31, 32, 33, 400, 5000)]
    together = fingerprints.chunk_sets(*textbytes.flat(pa.array(texts)))
    for t, c in zip(texts, together, strict=True):
        assert fingerprints.chunk_sets(*textbytes.flat(pa.array([t])))[0] == c and sum(c.values()) == len(t)
        assert fingerprints.parse(fingerprints.write(c)) == c
    data = np.frombuffer(texts[-1].encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(fingerprints.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert fingerprints.gear_hash(data)[31:].tolist() == want[31:]
    shifted = fingerprints.chunk_sets(*textbytes.flat(pa.array(["new start " + texts[-1]])))[0]
    assert fingerprints.containment(together[-1], shifted) > 0.9


def brute_chunks(text):
    """Chunk digests and their bytes, one byte after the other."""
    raw, out, start = text.encode(), {}, 0
    h, hashes = 0, []
    for c in raw:
        h = ((h << 1) + int(fingerprints.GEAR[c])) & 0xFFFFFFFF
        hashes.append(h)
    while start < len(raw):
        scale = fingerprints.FINE if start < fingerprints.FINE_BYTES else fingerprints.COARSE
        hard, easy = (int(m) for m in scale.masks())
        end = min(start + scale.most, len(raw)) - 1
        for i in range(max(start + scale.least - 1, scale.reach - 1), end):
            if not hashes[i] & (hard if i < start + scale.normal - 1 else easy):
                end = i
                break
        part = np.frombuffer(raw[start : end + 1], np.uint8)
        d = int(textbytes.span_hashes(part, np.array([0]), np.array([len(part)]))[0])
        out[d] = out.get(d, 0) + len(part)
        start = end + 1
    return out


@pytest.mark.parametrize("segment, most", [(1000, 100), (300, 4), (1 << 22, 100)])
def test_edits(spark, segment, most):
    rng = np.random.default_rng(11)
    texts = [*AWKWARD, *(" ".join(f"w{x}" for x in rng.integers(0, 500, int(n))) for n in rng.integers(1, 120, 30))]
    ids = [7 * i - 20 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(frame(spark, texts, ids), segment, most).collect()}
    sets = [brute_chunks(t or "") for t in texts]
    share = lambda a, b: sum(min(n, b.get(d, 0)) for d, n in a.items()) / sum(a.values()) if a else float(not b)
    for n, i in enumerate(ids):
        t, after = texts[n] or "", texts[(n + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_text"] == edited
        assert got[i]["fingerprint"] == fingerprints.write(sets[n]) and got[i]["edited_fingerprint"] == fingerprints.write(brute_chunks(edited))
        assert got[i]["near_next"] == share(sets[n], sets[(n + 1) % len(texts)]) and got[i]["near_edited"] == share(sets[n], brute_chunks(edited))
    assert fingerprints.compare_with_edits(nothing(spark)).count() == 0
    alone = fingerprints.compare_with_edits(frame(spark, ["abcdefgh"])).first()
    assert alone["edited_text"] == "abcdefab" and alone["near_next"] == 1.0
    assert fingerprints.fingerprint(frame(spark, texts, ids)).filter("doc_id = -20").first()["fingerprint"] == ""


def test_edits_of_repeated_and_null_ids(spark):
    texts = ["b" * 40, "a" * 40, "a" * 40, "c" * 40, None, "d" * 40, "e" * 40]
    for segment in (50, 1 << 20):
        rows = fingerprints.compare_with_edits(frame(spark, texts, [2, 1, 1, 1, None, None, 2]), segment).collect()
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 1, 1, 2, 2]
        assert len(seen := [(r["doc_id"], r["edited_text"]) for r in rows]) == 7
        before = before if segment != 50 else sorted(map(repr, seen))
        assert sorted(map(repr, seen)) == before


def test_short_texts_keep_their_head():
    for n in (40, 60, 85, 120):
        text = " ".join(f"{chr(97 + i % 26)}{i * 37 % 101}" for i in range(40))[:n]
        a, b = fingerprints.chunk_sets(*textbytes.flat(pa.array([text, text[: n - n // 4] + "#" * (n // 4)])))
        assert fingerprints.containment(a, b) > 0.2


def test_escape_round_trip():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "|", "\\", ">", "im_end", "a"], int(rng.integers(0, 9))))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_chats(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (1, 3, None, ""), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, 0, "user", "x"), (3, 0, "assistant\n<|x\\", "no"), (3, None, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("system", "s"), ("user", ""), ("assistant", "<|im_end|>\n<|im_start|>user\nno"), ("", "")]
    assert [chat.unescape(got[1]["formatted"][m["start"] : m["end"]]) for m in got[1]["mask"]] == ["<|im_end|>\n<|im_start|>user\nno"]
    assert len(got[2]["turns"]) == 2 and len(got) == 4
    assert [tuple(t) for t in got[3]["turns"]] == [("user", "x" * 300_000), ("assistant\n<|x\\", "no")] and got[3]["mask"] == []
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rewriting_template():
    def forgetful(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t[:1]};" for i, (r, t) in enumerate(turns))

    _, found, rewritten = chat.locate_turns(forgetful, [("a", "xyz"), ("b", "uvw")])
    assert rewritten == [1] and len(found) == 2
    assert chat.locate_turns(chat.chat_template, [("a", "xyz"), ("b", "uvw")])[2] == []


def test_leaks(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "the on er st ha re in".split() for b in "nd ly ou ti ed sh".split()]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, f"{say(20).capitalize()} question{i} token{i * 7}. {say(8).capitalize()} answer{i}.") for i in range(50)]
    texts = [say(300) for _ in range(30)] + [None, "", "x"]
    for i in (3, 9, 27):
        texts.append(f"{say(int(rng.integers(0, 200)))}\n{items[i][1].upper() if i == 9 else items[i][1]}\n{say(100)}")
    bench = spark.createDataFrame([(*x, 1) for x in [*items, (60, None), (None, "x y z"), (61, "")]], "item_id long, text string, doc_id int")
    for size in (1 << 25, 2000):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame(spark, texts), bench, index_bytes=size).collect()}
        assert got == {(33, 3), (34, 9), (35, 27)}
    kept = decontamination.decontaminate(frame(spark, texts), bench)
    assert kept.count() == 33 and kept.columns == frame(spark, []).columns
    assert decontamination.find_leaks(nothing(spark), bench).count() == 0
    assert decontamination.find_leaks(frame(spark, texts), bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 25, 4000])
def test_leaks_of_long_items(spark, size):
    """Whole copies of items of all lengths, in the midst of documents, at several offsets."""
    rng = np.random.default_rng(10)
    vocabulary = [f"w{i}" for i in range(4000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    lengths = [20, 49, 50, 59, 96, 97, 98, 200, 400, 400, 1500]
    items = [(i, f"{say(n - n // 4)}. {say(n // 4)}.") for i, n in enumerate(lengths)]
    texts = [f"{say(before)} {t} {say(300)}" for _, t in items for before in (0, 30, 333)] + [say(3000)]
    got = decontamination.find_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), index_bytes=size).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3 * i + j, i) for i in range(len(items)) for j in range(3)}
    assert all(r["score"] > 0.999 and r["question_overlap"] == r["answer_overlap"] == 1.0 for r in got)


def test_pruning_loses_nothing():
    """The pruned search against BM25 scores of every passage and item."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, 15))) for i in range(40)]
    index = decontamination.build_index(items)
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 90, 20)] + [items[3][1], ""]
    got = {(t, i, s): round(x, 9) for t, i, x, s, *_ in decontamination.search(index, *textbytes.flat(pa.array(texts)), 0.5, 8)}
    want = {}
    for t, text in enumerate(texts):
        w = decontamination.term_hashes(text)
        for a in range(0, len(w), 8):
            have = set(w[a : a + 16].tolist())
            for i in range(len(items)):
                s = sum(index.impact[p] for k, term in enumerate(index.terms.tolist()) if term in have for p in range(index.at[k], index.at[k + 1]) if index.item[p] == i)
                if s >= 0.5:
                    want[t, i, a] = round(float(s), 9)
    assert got == want and len(want) > 5


def test_an_item_of_common_words_does_not_end_pruning(spark, monkeypatch):
    """Such an item is found, and passages that share nothing with it but a common word are not scored for it."""
    rng = np.random.default_rng(12)
    rare = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(x for w in rng.choice(rare, n) for x in (w, str(rng.choice(["the", "of", "a"]))))
    items = [(i, say(12)) for i in range(300)] + [(900, "the of the a the of a"), (901, "a the a of a the of")]
    texts = [say(60) for _ in range(200)] + [f"{say(20)} {items[7][1]} {say(9)}", f"{' '.join(rare[:50])} the of the a the of a"]
    words = [decontamination.term_hashes(t) for _, t in items]
    groups = decontamination.index_by_length(items, None, 48)
    assert len(words) == sum(len(ix.ids) for _, ix in groups) and all(ix.common_bound <= 0.25 for _, ix in groups if ix.common.any())
    heavy = next(ix for _, ix in groups if 900 in ix.ids)
    assert len(heavy.ids) == 2 and not heavy.common.any()
    scored = []
    expand = decontamination._expand
    monkeypatch.setattr(decontamination, "_expand", lambda at, keys: scored.append(len(keys)) or expand(at, keys))
    data, offsets = textbytes.flat(pa.array([" ".join(f"y{x}" for x in rng.integers(0, 3000, 90)) + " the" for _ in range(200)]))
    assert [list(decontamination.search(ix, data, offsets, 0.5, h)) for h, ix in groups] == [[] for _ in groups]
    assert sum(scored) == 0  # a common word alone gives no passage to look at
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(200, 7), (201, 900)} <= got


def test_decontamination_on_tables(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", t).collect() for t in ("documents", "benchmark"))
    flatten = lambda s: " ".join(s.split())
    truth = {(d["doc_id"], i["item_id"]) for d in docs for i in items if flatten(i["text"]) in flatten(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op7_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert truth <= got and len(got - truth) <= 2


@pytest.mark.parametrize("name, target, modulus, held, least", [("op10_quality", "quality", 3, 1, 0.97), ("op3_toxicity", "toxic", 4, 2, 0.75)])
def test_classifiers(spark, name, target, modulus, held, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert learning.auc(np.array([r["score"] for r in own]), np.array([r[target] for r in own])) >= least
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifiers_awkward(spark):
    docs = frame(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        model = fit(docs, none)
        got = score(docs, model).collect()
        assert len(got) == len(AWKWARD) and {r["score"] for r in got} == {0.5}
        assert score(nothing(spark), model).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(0, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        assert all(0 <= r["score"] <= 1 for r in score(docs, fit(docs, one)).collect())


def plain_ftrl(rows, bits, alpha, beta, l1, l2, epochs, scale, seed):
    """FTRL-proximal with dictionaries, one weight after the other."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            buckets, label = rows[r]
            x = {1 << bits: 1.0}
            for b in buckets.tolist():
                x[b] = x.get(b, 0.0) + scale / len(buckets)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    return [weight(i) for i in range((1 << bits) + 1)]


def test_ftrl_against_plain_updates():
    rng = np.random.default_rng(15)
    rows = [(rng.integers(0, 64, int(rng.integers(1, 40))).astype(np.int32), int(rng.integers(0, 2))) for _ in range(30)]
    model = quality.train_ftrl(rows, bits=6, alpha=0.5, beta=1.0, l1=0.05, l2=0.001, epochs=2, scale=20.0, seed=5)
    want = plain_ftrl(rows, 6, 0.5, 1.0, 0.05, 0.001, 2, 20.0, 5)
    assert np.allclose(model.weights, want[:-1], atol=1e-5) and np.isclose(model.bias, want[-1])


def plain_tree(x, g, h, cuts, depth, rate, least):
    """The value that a tree grown by trying every split gives to each row."""
    out = [-sum(g) / (sum(h) + 1) * rate] * len(g)
    if depth == 0 or len(g) < 4:
        return out
    best = (1e-6, None, None)
    for j, at in enumerate(cuts):
        for c in at:
            left = [i for i in range(len(g)) if x[i][j] <= c]
            right = [i for i in range(len(g)) if x[i][j] > c]
            if len(left) < least or len(right) < least:
                continue
            side = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)
            gain = side(left) + side(right) - sum(g) ** 2 / (sum(h) + 1)
            if gain > best[0] + 1e-12:
                best = (gain, left, right)
    if best[1] is None:
        return out
    for rows in best[1:]:
        values = plain_tree([x[i] for i in rows], [g[i] for i in rows], [h[i] for i in rows], cuts, depth - 1, rate, least)
        for i, v in zip(rows, values, strict=True):
            out[i] = v
    return out


def test_boosting_against_plain_trees():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=40) > 0).astype(float)
    trees, base = toxicity.boost(x, y, n_trees=4, depth=2, rate=0.15, bins=8)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 9)[1:-1])) for c in x.T]
    f = np.full(40, base)
    for _ in range(4):
        p = 1 / (1 + np.exp(-f))
        f = f + plain_tree(x.tolist(), (p - y).tolist(), (p * (1 - p) + 1e-9).tolist(), cuts, 2, 0.15, 2.0)
    got = toxicity.raw_score(toxicity.ToxicityModel(toxicity.Lexicon((np.zeros(0, np.uint64), np.zeros(0)), {}), trees, base), x)
    assert np.allclose(got, f, atol=1e-5)


def test_isotonic_against_min_max():
    """Pooling against the formula: the largest over starts of the smallest mean over ends."""
    rng = np.random.default_rng(17)
    for _ in range(20):
        n = int(rng.integers(2, 25))
        s, y = np.sort(rng.permutation(100)[:n]).astype(float), rng.integers(0, 2, n).astype(float)
        fit = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        sizes = {v: sum(abs(u - v) < 1e-12 for u in fit) for v in fit}
        want = np.maximum.accumulate([(v * sizes[v] + y.mean()) / (sizes[v] + 1) for v in fit])
        xs, ys = toxicity.isotonic(s, y)
        assert np.allclose(np.interp(s, xs, ys), want)


def plain_lexicon(texts, labels):
    """Words of toxic texts by log odds, texts that hold them counted one by one."""
    words = [set(decontamination.term_hashes(t).tolist()) for t in texts]
    ones, zeros = sum(labels), len(labels) - sum(labels)
    out = {}
    for w in set().union(*words):
        a = sum(w in x for x, k in zip(words, labels, strict=True) if k)
        b = sum(w in x for x, k in zip(words, labels, strict=True) if not k)
        odds = np.log((a + 0.25) / (ones + 0.5) / ((b + 0.25) / (zeros + 0.5)))
        if a >= 2 and odds >= np.log(toxicity.LIST_AT):
            out[w] = odds
    return out


def test_lexicon(spark):
    rng = np.random.default_rng(18)
    labels = [int(x) for x in rng.integers(0, 2, 40)]
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 30, 12)] + (["vile", "Vile"] if k and rng.random() < 0.7 else [])) for k in labels]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, label int")
    got = toxicity.learn_lexicon(rows)
    want = plain_lexicon(texts, labels)
    assert dict(zip(got.words[0].tolist(), got.words[1].round(9).tolist(), strict=True)) == {w: round(float(x), 9) for w, x in want.items()} and want


def test_samples_are_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}", 0) for i in range(500)] + [(2, "a", 0), (3, None, 0)], "doc_id long, text string, label int").drop("label")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = learning.labelled_sample(docs, labels, "toxic", 97, 96, 1).collect()
    assert len(got) == 2 and {r["label"] for r in got} == {0, 1}


def test_isotonic_rises():
    rng = np.random.default_rng(3)
    s = rng.normal(size=200)
    x, y = toxicity.isotonic(s, (s + rng.normal(size=200) > 0).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() <= y.max() <= 1


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r["doc_id"]: r for r in table(spark, SMALL, "documents").collect()}
    assert out and all(r["size"] == len(docs[r["doc_id"]]["text"].encode()) + 1 for r in out)
    kept = {r["doc_id"] for r in out}
    good = {r["doc_id"] for r in quality.score_quality(table(spark, SMALL, "documents"), quality.fit_quality(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))).collect() if r["predicted"]}
    truth = brute_components([(i, docs[i]["text"]) for i in good], 5, 80)
    assert kept <= {i for i, (_, c) in truth.items() if c == i}
    leaked = {r["doc_id"] for r in decontamination.op7_decontamination(spark, SMALL).collect()}
    assert not kept & leaked
    for r in out:
        assert zlib.crc32(docs[r["doc_id"]]["text"].encode()) == r["text_crc32"]
    assert hashlib.sha256(repr(sorted(map(tuple, out))).encode()).hexdigest() == hashlib.sha256(repr(sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))).encode()).hexdigest()


def tables_with(spark, folder, docs):
    """A folder of tables in which documents are these rows."""
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{folder}/{name}.parquet")
    like = table(spark, SMALL, "documents")
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, shard int")
    rows.select(*[F.col(f.name).cast(f.dataType) for f in like.schema], "shard").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables_with(spark, tmp_path, [])).count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null and repeated ids, empty and long texts, through all stages, with stages held against each other."""
    import corpus_pipeline

    good = [r["text"] for r in table(spark, SMALL, "documents").orderBy("doc_id").limit(60).collect()]
    rows = [(i if i % 7 else None, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1) for i, t in enumerate([*good, *AWKWARD, *good[:5]])]
    rows += [(900, t, "en", "s0", 1, 1) for t in good[10:14]]
    sf = tables_with(spark, tmp_path, rows)
    docs = table(spark, sf, "documents").select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        have = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
        kept = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        assert set(kept) <= set(have)
        if name != "mixing":
            assert all(kept.count(x) <= have.count(x) for x in kept)
    shards = corpus_pipeline.shard(spark, docs, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text_crc32"]) for r in shards) == sorted((d is None, d, zlib.crc32((t or "").encode())) for d, t, _ in kept)


def test_shards_hold_the_mix_in_its_order(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"w{i} " * 20, f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    corpus_pipeline.mix(spark, docs, SMALL).write.parquet(f"{tmp_path}/mix")
    mixed = spark.read.parquet(f"{tmp_path}/mix")
    shards = corpus_pipeline.shard(spark, mixed, SMALL).collect()
    share = mixed.filter("source = 's0'").count() / mixed.count()
    for s in range(8):
        mine = [r["doc_id"] % 2 == 0 for r in shards if r["shard"] == s]
        assert abs(sum(mine) / len(mine) - share) < 0.1
