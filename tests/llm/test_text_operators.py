"""Substring dedup, near duplicates, fingerprints, decontamination: against brute force."""

import hashlib
import random

import numpy as np
from helpers import frame, prose, sets_of, words_of
from pyspark.sql import functions as F

from siftgraph.llm import decontaminate, lz_fingerprint, near_dedup, rlz


def brute_removal(rows, window):
    docs = sorted({(i if i is not None else float("-inf"), t) for i, t, *_ in rows if t is not None}, key=lambda x: x[0])
    seen, out = {}, {}
    for i, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.setdefault(k, (i, s))
        out[i, t] = " ".join(x for x, g in zip(w, gone) if not g)
    return out


def test_rlz_awkward(docs, awkward):
    got = {(r.doc_id, r.kept, r.n_words, r.n_removed) for r in rlz.remove_copies(docs).collect()}
    want = brute_removal(awkward, 20)
    expect = set()
    for i, t, *_ in awkward:
        key = (i if i is not None else float("-inf"), t)
        kept = want.get(key, "")
        n = len(words_of(t))
        expect.add((i, kept, n, n - len(kept.split())))
    assert got == expect


def test_rlz_random_and_empty(spark, nothing):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(2)]
        if rows and rng.random() < 0.6:
            other = rng.choice(rows)[1].split()
            a = rng.randrange(len(other))
            parts.insert(rng.randint(0, 2), " ".join(other[a : a + rng.randint(1, 40)]))
        rows.append((i, " ".join(parts)))
    schema = "doc_id long, text string"
    for window, gram in ((4, 2), (7, 3)):
        got = {r.doc_id: r.kept for r in rlz.remove_copies(spark.createDataFrame(rows, schema).repartition(5), window, gram).collect()}
        want = brute_removal([(i, t) for i, t in rows], window)
        assert got == {i: want[i, t] for i, t in rows}
    assert rlz.remove_copies(nothing).collect() == []


def test_rlz_windows_that_agree_in_half_a_hash(spark, monkeypatch):
    # two texts without a common window: all window hashes agree in the upper 32 bits
    real = rlz.window_hash

    def halved(h, n, *base):
        return real(h, n, *base) & np.uint64(0xFFFFFFFF) if base else real(h, n)

    monkeypatch.setattr(rlz, "window_hash", halved)
    line = [f"w{i}" for i in range(6)]
    texts = [" ".join([f"{c}{i}" for i in range(14)] + line + [f"{c}{i}" for i in range(14, 28)]) for c in "ab"]
    part = rlz.pa.RecordBatch.from_pydict({"doc": [1, 2], "crc": [1, 2], "text": texts})
    index = rlz._index_slice(part, 20, 6)
    assert not any(index.column("local").to_pylist())
    order = rlz.pc.sort_indices(index, sort_keys=[(c, "ascending") for c in ("key", "doc", "at")])
    assert sum(out.num_rows for out in rlz._match(iter([index.take(order)]))) == 0


def test_rlz_factors_are_maximal(spark):
    # one long copy crosses many anchors and is one factor
    rng = random.Random(3)
    text = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(text)), (2, " ".join(["x", "y", *text[20:280], "z"]))]
    for parts in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        got = [(r.doc, r.start, r.n, r.src_doc, r.src_start) for r in rlz.factors(docs).collect()]
        assert got == [(2, 2, 241, 1, 20)]


def brute_components(rows):
    nodes = {}
    for i, t, *_ in rows:
        nodes.setdefault(i if i is not None else float("-inf"), set()).add(sets_of(t))
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(nodes)
    for a in ids:
        for b in ids:
            if a < b and any(
                x and y and 100 * len(x & y) >= 75 * len(x | y) for x in nodes[a] for y in nodes[b]
            ):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_awkward(docs, awkward):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(awkward)
    want = brute_components(awkward)
    for r in got:
        key = r.doc_id if r.doc_id is not None else float("-inf")
        assert (r.component_id if r.component_id is not None else float("-inf")) == want[key]
        assert r.kept == (r.component_id == r.doc_id)
    sizes = {(r.doc_id, r.n_shingles) for r in got}
    assert sizes == {(i, len(sets_of(t))) for i, t, *_ in awkward}


def test_near_duplicates_group_of_variants(spark, nothing):
    """A wide group whose members are not all similar to each other, and chains."""
    rng = random.Random(8)
    base = prose(rng, 90).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"new{i}x{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert near_dedup.near_duplicates(nothing).collect() == []
    kept = near_dedup.keep_first(docs)
    assert {r.doc_id for r in kept.collect()} == set(got.values()) and kept.columns == docs.columns


def test_pairs_across_groups_miss_no_link(spark):
    """A template with 8 to 30 % own words, sets of unequal size, and one large group."""
    rng = random.Random(8)
    template = prose(rng, 160).split()
    rows = []
    for i in range(60):
        own = rng.randint(8, 30) * 160 // 100
        at, more = rng.randint(0, 160 - own), rng.choice([0, 0, 15, 40])
        rows.append((i, " ".join([*template[:at], *(f"own{i}x{k}" for k in range(own)), *template[at + own :], *prose(rng, more).split()])))
    rows += [(100 + i, " ".join([*template[:20], f"n{i}", *template[21:]])) for i in range(30)]
    comp = {i: i if i < 100 else 100 for i, _ in rows}
    sets = {i: sets_of(t) for i, t in rows}
    linked = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    texts = spark.createDataFrame(rows, "doc bigint, text string").repartition(4)
    groups = spark.createDataFrame(list(comp.items()), "rep bigint, comp bigint")
    got = [(r.hub, r.rep) for r in near_dedup.across_groups(texts, groups).collect()]
    assert len(got) == len(set(got)) and linked and linked <= set(got)
    assert all(comp[a] != comp[b] for a, b in got)


def test_template_with_own_words_pairs_nothing(spark):
    rng = random.Random(9)
    template = prose(rng, 100)
    rows = [(i, template + " " + " ".join(f"own{i}x{k}" for k in range(20))) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc bigint, text string").repartition(4)
    groups = texts.select("doc", "doc").toDF("rep", "comp")
    assert near_dedup.across_groups(texts, groups).isEmpty()


def test_large_pairs_at_the_border_are_verified():
    # sets of 1,750 with 1,500 in common: similarity 0.75; all go on to the exact test
    rng, pairs, n = np.random.default_rng(11), 600, 1750
    sigs = {"sig_a": [], "sig_b": []}
    for _ in range(pairs // 50):
        pool = rng.integers(0, 2**64, (50, 2000), dtype=np.uint64)
        for name, part in (("sig_a", pool[:, :n]), ("sig_b", pool[:, 2000 - n :])):
            sigs[name] += [x.tobytes() for x in near_dedup.superminhash(part.ravel(), np.arange(51) * n)]
    batch = near_dedup.pa.RecordBatch.from_pydict({"hub": list(range(pairs)), "rep": list(range(pairs)), **sigs})
    assert near_dedup.least_alike() == 0.55
    agree = [(near_dedup._signatures(batch.column(c))) for c in ("sig_a", "sig_b")]
    assert ((agree[0] == agree[1]).mean(axis=1) < 0.67).any()  # the threshold that lost such pairs
    assert sum(out.num_rows for out in near_dedup._alike(near_dedup.least_alike())([batch])) == pairs


def test_superminhash_matches_the_definition():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 40).astype(np.uint64)
    m = 24
    sizes = [0, 1, 3, 36]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = near_dedup.superminhash(elements, offsets, m)
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        best = [2**64 - 1] * m
        for e in elements[a:b]:
            seed = near_dedup.mix(np.array([e]))
            perm = list(range(m))
            for j in range(m):
                slot, value = near_dedup._draw(seed, j, m)
                perm[j], perm[slot[0]] = perm[slot[0]], perm[j]
                best[perm[j]] = min(best[perm[j]], int(value[0]))
        want = (near_dedup.mix(np.array(best, np.uint64)) >> np.uint64(48)).astype(np.uint16)
        assert (got[d] == want).all()


def naive_phrases(data):
    seen, cur = set(), b""
    for c in data:
        cur += bytes([c])
        if cur not in seen:
            seen.add(cur)
            cur = b""
    return seen


def test_lz_phrases_and_neighbours(docs, awkward):
    rows = sorted(((i if i is not None else -(2**63), i, t or "") for i, t, *_ in awkward), key=lambda x: x[0])
    got = lz_fingerprint.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for k, (_, i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        by_id.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in by_id[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in got:
        for i, t, *_ in awkward:
            if i == r.doc_id:
                prints.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    for data in (b"", b"a", b"abababababab", "été".encode() * 30, bytes(range(256)) * 3):
        for shared in range(0, len(data) + 1, max(1, len(data) // 5)):
            tail = b"zab" * 9
            a, b = lz_fingerprint.phrase_ends(data, shared, tail)
            for ends, whole in ((a, data), (b, data[:shared] + tail)):
                phrases = {whole[x:y] for x, y in zip([0, *ends[:-1]], ends)}
                assert phrases == naive_phrases(whole) and len(phrases) == len(ends)


def test_lz_single_and_empty(spark, nothing):
    assert lz_fingerprint.edited_fingerprints(nothing).collect() == []
    one = lz_fingerprint.edited_fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0


def brute_leaks(rows, items):
    out = set()
    for i, t in rows:
        d = words_of(t, lower=True)
        for k, b in items:
            q = words_of(b, lower=True)
            if not d or not q:
                continue
            length = min(len(q), len(d))

            def bag(w):
                if len(w) < 5:
                    return {tuple(w): 1}
                c = {}
                for x in range(len(w) - 4):
                    c[tuple(w[x : x + 5])] = c.get(tuple(w[x : x + 5]), 0) + 1
                return c

            want = bag(q)
            if not bag(d).keys() & want.keys() and length >= 5:
                continue  # no window shares a shingle
            for s in range(len(d) - length + 1):
                have = bag(d[s : s + length]) if length >= 5 or len(d) < 5 else {}
                low = sum(min(have.get(x, 0), want.get(x, 0)) for x in have.keys() | want.keys())
                high = sum(max(have.get(x, 0), want.get(x, 0)) for x in have.keys() | want.keys())
                if low and 100 * low >= 75 * high:
                    out.add((i, k))
    return out


def test_decontamination(spark, docs, awkward, nothing):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(5, 40))) for k in range(25)] + [(90, None), (91, ""), (92, "one two three"), (93, "a b a b a b a b a b a b")]
    rows = [(i, t) for i, t, *_ in awkward if i is not None]
    for k in range(40):
        w = items[k % 25][1].split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.pop(at), lambda: w.insert(at, "extra"), lambda: w.__setitem__(at, "other")])()
        rows.append((200 + k, f"{prose(rng, rng.randint(0, 30))} {' '.join(w).upper()} {prose(rng, rng.randint(0, 30))}"))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(d, b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(rows, items)
    found = {r.doc_id for r in got.collect()}
    stay = decontaminate.remove_leaks(d, b)
    assert {r.doc_id for r in stay.collect()} == {i for i, _ in rows} - found
    assert decontaminate.leaks(nothing, b).collect() == []
    assert decontaminate.leaks(docs, b.limit(0)).collect() == []
    assert decontaminate.remove_leaks(docs, b.limit(0)).count() == len(awkward)
    assert decontaminate.remove_leaks(docs, b).columns == docs.columns


def test_frame_helper(spark, awkward):
    assert frame(spark, awkward).select(F.count("doc_id")).first()[0] == sum(r[0] is not None for r in awkward)
