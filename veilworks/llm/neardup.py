"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class from the start; what follows works on
one representative of each. A tree branches the representatives by tokens of their minwise
signature: at the root a few signature positions are chosen, 1 / threshold of them on average, below
it 1.75 on average, by the node's path; a representative goes on to the child named by its value
there. Branching goes on until a node is small, or until half of its members are near copies of one of
them, by their signatures. Small nodes are compared exhaustively on signatures; independent trees
repeat this. A pair at the threshold 0.8 is missed by all 11 root branches of 10 trees with a probability
of 2e-8 where their nodes are small, and of about 6e-6 where they branch on again and again (a branch then
keeps it with 0.67), and by signatures that agree in fewer than 36 of 64 positions with 4e-6, at any size;
closer pairs are missed less. Every link is confirmed on the full sets of both texts.

What a group of near copies costs stays in proportion to its size: a node gives a spanning forest of
its strongest candidates. A second round compares, within each node, all that confirmed links have not
joined, so a failed confirmation hides no link. A node of n near copies is dealt into blocks of about
16 * sqrt(n) members; its members outside the largest component meet all blocks. What that round ties
together is confirmed in blocks, each pair of which counts its intersections at once, on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.components import components
from veilworks.llm.engine import numbered, settle, table
from veilworks.llm.textbytes import LOWER, flat, mix, rolling, slices, span_hashes, spans

POSITIONS = 64
#: The mean number of positions by which a node below the root branches.
BELOW = 1.75
_A = (mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, POSITIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of k lower-cased words as sorted 64-bit hashes; of fewer words, the whole sequence."""
    data = LOWER[data]
    starts, ends, at = spans(data, offsets)
    h = span_hashes(data, starts, ends)
    all_k = rolling(h, k)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= k:
            s = np.sort(all_k[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(rolling(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values: for each non-empty set and position the least of a permutation of its members."""
    out = np.zeros((len(sets), POSITIONS), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 16):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[i:j]])[:-1]])
        for p in range(POSITIONS):
            out[i:j, p] = np.minimum.reduceat(x * _A[p] + _B[p], at)
        i = j
    return out


def chosen(path: int, mean: float, used: int = 0) -> list[int]:
    """The signature positions by which the node of this path branches: `mean` of them on average, none of those used above it."""
    x = int(mix(np.array([path & ((1 << 64) - 1)], np.uint64))[0])
    n = int(mean) + (((x >> 40) / (1 << 24)) < mean - int(mean))
    return [p for i in range(POSITIONS) if not used >> (p := ((x & 0xFFFF) + i * 37) % POSITIONS) & 1][:n]


def root_branches(trees: int, threshold: float) -> list[tuple[int, int]]:
    """(path, position) of each branch of each tree's root."""
    return [(int(mix(np.array([t + 1], np.uint64))[0]), p) for t in range(trees) for p in chosen(t * 7919 + 13, 1 / threshold)]


def _step(path: np.ndarray | int, position: int, value: np.ndarray) -> np.ndarray:
    base = np.uint64((position + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
    return mix((np.asarray(path).astype(np.uint64) ^ base) + mix(value.astype(np.uint64) + np.uint64(1)))


def describe(docs: DataFrame, k: int, threshold: float, trees: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, sig, roots: the first-level node of each tree and branch)."""
    roots = root_branches(trees, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(*flat(b.column("text")), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full])
            keys = np.stack([_step(path, p, sig[:, p]) for path, p in roots], 1).view(np.int64) if full else np.zeros((0, len(roots)), np.int64)
            short = (mix(sig.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16) if full else sig
            digest, sigs, node = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for r, i in enumerate(full):
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sigs[i] = short[r].tobytes()
                node[i] = keys[r]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(node, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "roots"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary, roots array<long>")


def branch(nodes: DataFrame) -> DataFrame:
    """(node, rep, sig, used) one level on: each row goes to the children that its node's path chooses.

    used: the positions by which the path has branched, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, used = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("node", "used"))
            sig = np.stack([np.frombuffer(x, np.uint16) for x in b.column("sig").to_pylist()])
            paths, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            picks = [chosen(int(p), BELOW, int(u)) for p, u in zip(paths, used[first], strict=True)]
            for r in range(max(map(len, picks))):
                position = np.array([p[r] if r < len(p) else -1 for p in picks])[inverse]
                rows = np.flatnonzero(position >= 0)
                position = position[rows]
                base = (position + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                child = mix((node[rows] ^ base) + mix(sig[rows, position].astype(np.uint64) + np.uint64(1)))
                now = used[rows] | (np.uint64(1) << position.astype(np.uint64))
                held = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), held.column("rep"), held.column("sig"), pa.array(now.view(np.int64))], ["node", "rep", "sig", "used"])

    return nodes.select("node", "rep", "sig", "used").mapInArrow(run, "node long, rep long, sig binary, used long")


def with_near(rows: DataFrame, low: float) -> DataFrame:
    """rows (node, rep, sig, n, used, pivot) with near in place of pivot: 1 if signature and pivot agree in a share `low` of the positions or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.zeros(b.num_rows, np.int64)
            some = np.flatnonzero(b.column("pivot").is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                one, other = (np.stack([np.frombuffer(x, np.uint16) for x in b.column(c).take(pa.array(some)).to_pylist()]) for c in ("sig", "pivot"))
                near[some] = (one == other).mean(1) >= low
            yield b.drop_columns(["pivot"]).append_column("near", pa.array(near))

    return rows.mapInArrow(run, "node long, rep long, sig binary, n long, used long, near long")


def join_parts(part: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) out of a matrix that join the parts of rows and columns, none twice; part is updated.

    Each turn every row takes its first link to another part, so the parts at least halve."""
    out: list[tuple[int, int]] = []
    while True:
        open_ = linked & (part[:, None] != part[None, :])
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return out
        head: dict[int, int] = {}

        def root(p: int, head: dict[int, int] = head) -> int:
            while p in head:
                p = head[p]
            return p

        for i, j in zip(rows.tolist(), open_[rows].argmax(1).tolist(), strict=True):
            p, q = root(int(part[i])), root(int(part[j]))
            if p != q:
                head[max(p, q)] = min(p, q)
                out.append((i, j))
        names, inverse = np.unique(part, return_inverse=True)
        part[:] = np.array([root(int(p)) for p in names])[inverse]


def node_pairs(rep: np.ndarray, sig: np.ndarray, comp: np.ndarray | None, low: float) -> list[tuple[int, int]]:
    """Candidate pairs of one node: a spanning forest of the pairs that agree in a share `low` of the positions or more,
    strongest first. Second round (comp given): of those pairs whose components differ, so that every row of such a pair is in it."""
    order = np.argsort(rep, kind="stable")
    rep, sig = rep[order], sig[order]
    _, part = np.unique(rep, return_inverse=True)
    agree = np.zeros((len(rep), len(rep)), np.uint8)
    for p in range(POSITIONS):
        agree += sig[:, p, None] == sig[None, :, p]
    least = int(np.ceil(low * POSITIONS))
    if comp is not None:
        comp = comp[order]
        out = join_parts(part, (agree >= least) & (comp[:, None] != comp[None, :]))
        return [(int(rep[min(i, j)]), int(rep[max(i, j)])) for i, j in out]
    out = []
    for level in [*range(POSITIONS - 1, least, -4), least]:
        out += join_parts(part, agree >= level)
    return [(int(rep[min(i, j)]), int(rep[max(i, j)])) for i, j in out]


def compare_nodes(nodes: DataFrame, low: float, second: bool) -> DataFrame:
    """(a, b) candidates from rows (node, rep, sig[, comp]); nodes are bounded, and read as runs of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            node = t.column("node").to_numpy()
            rep = t.column("rep").to_numpy()
            sig = np.stack([np.frombuffer(x, np.uint16) for x in t.column("sig").to_pylist()])
            comp = t.column("comp").to_numpy() if second else None
            cut = [*np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])).tolist(), len(node)]
            got: set[tuple[int, int]] = set()
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a > 1:
                    got.update(node_pairs(rep[a:b], sig[a:b], comp[a:b] if second else None, low))
            pairs = sorted(got)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            node = b.column("node").to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))[-1])
            if held and (last or held[-1].column("node")[-1].as_py() != node[0].item()):
                yield flush([*held, b.slice(0, last)] if last else held)
                held = []
            elif last:
                yield flush([b.slice(0, last)])
            held.append(b.slice(last))
        if held:
            yield flush(held)

    cols = ["node", "rep", "sig", *(["comp"] if second else [])]
    return nodes.select(*cols).repartition("node").sortWithinPartitions("node", "rep").mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int, block: int = 64) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Pairs are grouped by a in blocks of `block` partners, so a document with many partners is spread."""
    blocks = pairs.withColumn("_n", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_blocks"))
    blocks = settle(blocks.join(degree, "a").select("a", F.pmod("_n", "_blocks").alias("block"), "b"))
    wanted = blocks.select("a", "block", F.col("b").alias("doc_id")).unionByName(blocks.select("a", "block", F.col("a").alias("doc_id")).distinct())
    texts = wanted.join(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id")

    def run(t: pa.Table) -> pa.Table:
        a = t.column("a")[0].as_py()
        sets = dict(zip(t.column("doc_id").to_pylist(), shingle_sets(*flat(t.column("text")), k), strict=True))
        mine = sets.pop(a)
        good = []
        for b, s in sets.items():
            both = int(np.isin(s, mine, assume_unique=True).sum())
            if both and 100 * both >= percent * (len(s) + len(mine) - both):
                good.append(b)
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return texts.groupBy("a", "block").applyInArrow(run, "a long, b long")


def confirm_rest(alike: DataFrame, joined: DataFrame, known: DataFrame, docs: DataFrame, k: int, percent: int, most: int = 2048, most_shingles: int = 1 << 19) -> DataFrame:
    """Links (a, b) among documents that `alike` (a, b) ties into groups and `joined` leaves in several components.

    In a group the members of all but one component are the strays. Every block of strays meets every
    block of the group; a pair of blocks gives links that join components, fewer than its members. A block
    has up to `most` members with `most_shingles` shingles together, on average, so a text is shipped once
    for each block of strays; near copies of one passage are one block up to some megabytes of text.
    """
    groups = components(alike).withColumnRenamed("component", "group")
    sized = known.select(F.col("doc_id").alias("node"), "n_shingles")
    members = groups.join(joined, "node", "left").join(sized, "node").select("group", F.col("node").alias("rep"), F.coalesce("component", "node").alias("comp"), "n_shingles")
    sizes = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    main = F.max(F.struct("n", "w", "comp")).alias("main")
    blocks = lambda n, w: F.greatest(F.ceil(n / most), F.ceil(w / most_shingles)).cast("long")
    per = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), main).select(
        "group", F.col("main.comp").alias("main"), blocks(F.col("n"), F.col("w")).alias("n_all"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("n_stray")
    )
    dealt = settle(members.join(per, "group").withColumn("h", F.xxhash64("rep")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    strays = dealt.filter("comp <> main").select("group", "rep", "comp", F.pmod("h", "n_stray").alias("s"), upto("n_all").alias("r"), F.lit(True).alias("stray"))
    rest = dealt.filter("n_stray > 0").select("group", "rep", "comp", upto("n_stray").alias("s"), F.pmod("h", "n_all").alias("r"), F.lit(False).alias("stray"))
    texts = strays.unionByName(rest).join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def run(t: pa.Table) -> pa.Table:
        rep, comp, stray = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "stray"))
        sets = shingle_sets(*flat(t.column("text")), k)
        size = np.array([len(s) for s in sets])
        x, y = np.flatnonzero(stray), np.flatnonzero(~stray)
        both = np.zeros((len(x), len(y)), np.float32)
        if len(x) and len(y):
            place = np.zeros(len(rep), np.int64)
            place[x], place[y] = np.arange(len(x)), np.arange(len(y))
            _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count[code] > 1)
            code, owner = code[shared], np.repeat(np.arange(len(sets)), size)[shared]
            _, code = np.unique(code, return_inverse=True)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            width = max(64, (1 << 23) // len(sets))
            for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
                a, b = np.searchsorted(code, [low, low + width])
                left, right = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
                o, c = owner[a:b], code[a:b] - low
                left[place[o[stray[o]]], c[stray[o]]] = 1
                right[place[o[~stray[o]]], c[~stray[o]]] = 1
                both += left @ right.T
        linked = np.zeros((len(rep), len(rep)), bool)
        linked[np.ix_(x, y)] = both * (100 + percent) >= percent * (size[x][:, None] + size[y][None, :])
        _, part = np.unique(comp, return_inverse=True)
        out = join_parts(part, linked)
        return pa.table({"a": pa.array([min(int(rep[i]), int(rep[j])) for i, j in out], pa.int64()), "b": pa.array([max(int(rep[i]), int(rep[j])) for i, j in out], pa.int64())})

    return texts.groupBy("group", "s", "r").applyInArrow(run, "a long, b long")


def grow_trees(reps: DataFrame, roots: list[tuple[int, int]], small: int, low: float, share: float = 0.5) -> DataFrame:
    """(node, rep, sig, n) of the leaves of all trees that hold several representatives.

    A node of more than `small` members branches on, unless it lies below a root and at least a `share` of
    its members are near copies of one of them, drawn by a hash. What branches shrinks, by a fixed rate on
    average, so the depth follows from the largest node's size."""
    bits = F.array(*[F.lit(int(np.array([1 << p], np.uint64).view(np.int64)[0])) for _, p in roots])
    level = reps.select(F.posexplode("roots").alias("_i", "node"), "rep").select("node", "rep", F.element_at(bits, F.col("_i") + 1).alias("used"))
    leaves = None
    while True:
        pivot = [] if leaves is None else [F.min(F.struct(F.xxhash64("node", "rep").alias("h"), "sig")).alias("p")]
        crowd = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *pivot).filter("n > 1")
        rows = level.join(crowd, "node")
        if leaves is None:
            rows = settle(rows.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig", "n", "used"))
        else:
            rows = settle(with_near(rows.select("node", "rep", "sig", "n", "used", F.when(F.col("n") > small, F.col("p.sig")).alias("pivot")), low))
        columns = ["node", "rep", "sig", "n"]
        ready, big = rows.filter(F.col("n") <= small).select(columns), rows.filter(F.col("n") > small)
        if leaves is not None:
            done = (F.avg("near") >= share) | (F.bit_count(F.max("used")) > POSITIONS - 2)
            dense = settle(big.groupBy("node").agg(done.alias("done")).filter("done").select("node"))
            if not dense.isEmpty():
                ready = ready.unionByName(settle(big.join(dense, "node", "left_semi").select(columns)))
                big = big.join(dense, "node", "left_anti")
        leaves = ready if leaves is None else leaves.unionByName(ready)
        if big.isEmpty():
            return leaves
        level = branch(big)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 10, small: int = 1024, slack: float = 0.25) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles
    (A-Z lower-cased; words are runs of bytes other than 0x20 and 0x09 to 0x0D; a text of fewer than
    k words is one shingle; one without words is linked with nothing). component_id is the smallest
    doc_id that links lead to, kept says whether that is the document itself. Equal rows are linked;
    rows that repeat an id are documents of their own, with equal texts or not, and of a group's rows
    with the smallest id the first alone is kept, in order of a hash of the text. A null id is linked
    with nothing and kept. Extra columns are ignored; an empty table gives an empty result.
    """
    threshold = percent / 100
    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = numbered(named)
    if rows is not None:  # repeated ids: each row goes by its number, which rises with the id
        named = rows.select(F.col("_row").alias("doc_id"), "text")
    known = settle(describe(named, k, threshold, trees))
    sets = known.filter("n_shingles > 0")
    # one representative of each distinct set; partial aggregation takes copies together before the shuffle
    reps = settle(sets.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "roots")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig"), F.col("r.roots").alias("roots")))
    low = threshold - slack
    leaves = grow_trees(reps, root_branches(trees, threshold), small, low)
    # nodes of near copies are cut into blocks, each with the node's four pivots
    big = leaves.filter(F.col("n") > small)
    pivots = big.groupBy("node").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "rep").alias("h"), "rep", "sig")).alias(f"p{i}") for i in range(4)], F.max("n").alias("n"))
    each = F.least(F.lit(2048), F.greatest(F.lit(small), 16 * F.sqrt("n")))
    n_blocks = F.ceil(F.col("n") / each).cast("long")
    block = lambda *i: F.xxhash64("node", *i)
    dealt = big.select(block(F.pmod(F.xxhash64("rep"), n_blocks)).alias("node"), "rep", "sig")
    everywhere = pivots.select(F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("i"), "node", F.explode(F.array(*[f"p{i}" for i in range(4)])).alias("p"))
    compared = (leaves.filter(F.col("n") <= small).select("node", "rep", "sig").unionByName(dealt).unionByName(everywhere.select(block(F.col("i")).alias("node"), "p.rep", "p.sig")))
    first = settle(compare_nodes(compared, low, False))
    links = settle(confirm(first, named, k, percent))
    joined = settle(components(links))
    # second round: whatever lies in one node and is not joined yet; of nodes in blocks, the members outside the
    # largest component, in blocks of their own, meet all blocks
    tag = lambda df: df.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    tagged = settle(tag(big))
    heads = tagged.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("n"))
    heads = heads.select("node", F.col("main.comp").alias("_main"), F.ceil((F.col("n") - F.col("main.m")) / each).cast("long").alias("n_stray")).filter("n_stray > 0")
    parts = tagged.join(heads, "node")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(name)
    stray = parts.filter("comp <> _main").select("node", "rep", "sig", "comp", F.pmod(F.xxhash64("rep"), "n_stray").alias("s"), spread(n_blocks, "r"))
    whole = parts.select("node", "rep", "sig", "comp", spread(F.col("n_stray"), "s"), F.pmod(F.xxhash64("rep"), n_blocks).alias("r"))
    cells = stray.unionByName(whole).select(block("s", "r").alias("node"), "rep", "sig", "comp")
    again = tag(leaves.filter(F.col("n") <= small)).select("node", "rep", "sig", "comp").unionByName(cells)
    mixed = again.groupBy("node").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a <> _b").select("node")
    second = settle(compare_nodes(again.join(mixed, "node"), low, True))
    if not second.isEmpty():
        joined = settle(components(links.unionByName(confirm_rest(second, joined, known, named, k, percent))))
    classes = reps.select("digest", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("_class"))
    out = known.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("_class", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if rows is not None:
        name = rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("_id"))
        first_of = rows.select(F.col("_row").alias("component_id"), F.col("doc_id").alias("_first"))
        out = out.join(name, "doc_id").join(first_of, "component_id").select(F.col("_id").alias("doc_id"), "n_shingles", F.col("_first").alias("component_id"), "kept")
    alone = describe(docs.filter("doc_id IS NULL"), k, threshold, trees).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def _cte(k: int) -> str:
    return rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {k} THEN list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k - 1}], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS c FROM w UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.node),
comp AS (SELECT node AS doc_id, min(c) AS component_id FROM reach GROUP BY node)"""


#: DuckDB SQL for op2_minhash_neardup.
OP2_SQL = f"""WITH RECURSIVE {_cte(4)}
SELECT comp.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, comp.doc_id = component_id AS kept FROM comp LEFT JOIN size USING (doc_id)"""
